"""Closed forms of models and layouts: attention cost, masks, positions, sharding, schedules, numeric features, tests."""

from __future__ import annotations

#: Student t of 97.5 % by degrees of freedom.
T975 = "(1, 12.706), (2, 4.303), (3, 3.182), (4, 2.776), (5, 2.571), (6, 2.447), (7, 2.365), (8, 2.306), (9, 2.262), (10, 2.228), (11, 2.201), (12, 2.179), (13, 2.160), (14, 2.145), (15, 2.131), (16, 2.120), (18, 2.101), (20, 2.086), (25, 2.060), (30, 2.042)"
#: Periods of the value features, and the characters of the codebook.
PERIODS = (2, 5, 10, 100, 1000, 10000)
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
F = lambda x: f"cast({x} as double)"
I = lambda x: f"cast({x} as bigint)"  # noqa: E731, E741


def _triangle(d, n):
    return d.div(f"({n}) * (({n}) + 1)", 2)


def _capped(d, n, cap):
    """Sum over queries 1..n of the keys that each may read, cap at most."""
    return f"(case when {cap} >= {n} then {_triangle(d, n)} else {_triangle(d, cap)} + ({n} - {cap}) * {cap} end)"


def attention_schemes(d):
    """Operations and bytes of the cache of a layer by scheme and context."""
    n, kv = "n", "2 * 8 * 128 * 2"
    rows = {
        "dense": (f"4 * 4096 * {_triangle(d, n)}", f"n * {kv}"),
        "window": (f"4 * 4096 * {_capped(d, n, '4096')}", f"least(n, 4096) * {kv}"),
        "window_sinks": (f"4 * 4096 * {_capped(d, n, '4096')}", f"least(n, 4100) * {kv}"),
        "topk": (f"4 * 4096 * {_capped(d, n, '2048')} + 2 * 64 * 128 * {_triangle(d, n)}", "n * (512 + 64) * 2"),
        "mla": (f"4 * 4096 * {_triangle(d, n)}", "n * (512 + 64) * 2"),
        "linear": ("n * 4 * 128 * 128 * 32", "32 * 128 * 128 * 2"),
        "delta": ("n * 8 * 128 * 128 * 32", "32 * 128 * 128 * 2"),
        "selected": (f"{d.div(f'4 * 4096 * {_triangle(d, n)}', 16)} + 4 * 4096 * {_capped(d, n, '1024')} + 4 * 4096 * {_capped(d, n, '512')}", f"n * {kv}"),
    }
    return " union all ".join(f"select '{k}' as scheme, n, {I(f)} as flops, {I(b)} as cache_bytes from (select {I('1024')} * i as n from (select {d.series('1', '32')} as i) g) q" for k, (f, b) in rows.items())


def model_totals(d):
    """Whole-model operations: local and global layers dealt by ratio, linear and full layers likewise."""
    parts = {"local_global": (f"4 * 4096 * {_capped(d, 'n', '1024')}", f"4 * 4096 * {_triangle(d, 'n')}", 5), "linear_hybrid": ("n * 8 * 128 * 128 * 32", f"4 * 4096 * {_triangle(d, 'n')}", 3)}
    cheap = lambda r: I(f"round(48 * {r} / cast({r} + 1 as double))")
    return " union all ".join(f"select '{k}' as scheme, n, {cheap(r)} as cheap_layers, {cheap(r)} * ({a}) + (48 - {cheap(r)}) * ({b}) as flops from (select {I('2048')} * i as n from (select {d.series('1', '16')} as i) g) q" for k, (a, b, r) in parts.items())


def cache_layouts(d):
    """Bytes a token and in all of the cache layouts of one model."""
    rows = {"mha": ("2 * 32 * 128 * 2", None), "gqa": ("2 * 8 * 128 * 2", None), "mqa": ("2 * 128 * 2", None), "mla": ("(512 + 64) * 2", None), "swa": ("2 * 8 * 128 * 2", "least(n, 4096 + 4) * 2 * 8 * 128 * 2"), "linear": ("0", "32 * 128 * 128 * 2")}
    return " union all ".join(f"select '{k}' as layout, n, {I(t)} as per_token, {I(f'32 * ({a or f"n * {t}"})')} as total from (select {I('4096')} * i as n from (select {d.series('1', '8')} as i) g) q" for k, (t, a) in rows.items())


def mask_counts(d):
    """Allowed pairs of each mask predicate on a grid of 96 queries and keys."""
    f = lambda x, n: d.div(x, n)
    masks = {
        "full": "true", "causal": "j <= i", "window": "j <= i and i - j < 8", "window_sinks": "j <= i and (j < 4 or i - j < 8)",
        "strided": "j <= i and (i - j < 8 or (i - j) % 8 = 0)", "fixed": f"j <= i and ({f('i', 8)} = {f('j', 8)} or j % 8 >= 7)",
        "window_global": "j <= i and (i - j < 8 or j < 2 or i < 2)", "segment": f"j <= i and {f('i', 16)} - {f('j', 16)} <= 1", "blocks": f"j <= i and {f('i', 16)} = {f('j', 16)}",
    }
    grid = f"(select i, j from (select {d.series('0', '95')} as i) a cross join (select {d.series('0', '95')} as j) b)"
    return f"select {', '.join(f'{I(f"sum(case when {m} then 1 else 0 end)")} as {k}' for k, m in masks.items())} from {grid} g"


def block_select_counts(d):
    """Content masks: of the earlier blocks of keys the two with the highest mean product with the query, and the own one."""
    dot = d.dot("q.embedding", "k.embedding")
    rows = "select vec_id, embedding from embeddings where vec_id < 96"
    return f"""with s as (select q.vec_id as i, k.vec_id as j, {dot} as s from ({rows}) q join ({rows}) k on k.vec_id <= q.vec_id),
b as (select i, {d.div('j', 16)} as block, avg(s) as mean from s where {d.div('j', 16)} < {d.div('i', 16)} group by 1, 2),
best as (select i, block from (select i, block, row_number() over (partition by i order by round(mean, 9) desc, block) as rn from b) r where rn <= 2 union all select distinct i, {d.div('i', 16)} from s)
select best.i, count(*) as allowed from best join s on s.i = best.i and {d.div('s.j', 16)} = best.block group by best.i"""


def bucketed_vectors(d):
    """Sign buckets of vectors on their first dimensions, and the nearest of three centroids, each a stored vector."""
    signs = " || ".join(f"case when {d.element('e.embedding', k)} >= 0 then '1' else '0' end" for k in (1, 2, 3, 4))
    return f"""select vec_id, bucket, centroid from (select e.vec_id, {signs} as bucket, c.vec_id as centroid, row_number() over (partition by e.vec_id order by round({d.dot('e.embedding', 'c.embedding')}, 9) desc, c.vec_id) as rn
from embeddings e cross join (select vec_id, embedding from embeddings where vec_id < 3) c) q where rn = 1"""


def softmax_scores(d):
    """Softmax of the products of a query vector with the keys before it."""
    return f"""with s as (select q.vec_id as i, k.vec_id as j, {d.dot('q.embedding', 'k.embedding')} as s from (select * from embeddings where vec_id < 32) q join (select * from embeddings where vec_id < 32) k on k.vec_id <= q.vec_id),
m as (select i, max(s) as top from s group by i), e as (select s.i, s.j, exp(s.s - m.top) as e from s join m on m.i = s.i), t as (select i, sum(e) as total from e group by i)
select e.i, e.j, round(e.e / t.total, 6) as p from e join t on t.i = e.i"""


def positional_encodings(d):
    """Sine and cosine positions, and rotary angles plain, interpolated, by base and by parts (extension 4, length 2048)."""
    theta = "pow(cast(10000 as double), -2.0e0 * i / 64)"
    r = f"(2048 * {theta} / (2 * pi()))"
    by_parts = f"(case when {r} >= 32 then cast(1 as double) when {r} <= 1 then cast(0.25 as double) else (1 - ({r} - 1) / 31) / 4 + ({r} - 1) / 31 end)"
    return f"""select pos, i, round(sin(pos * {theta}), 6) as s, round(cos(pos * {theta}), 6) as c, round(pos * {theta} / 4, 6) as interpolated, round(pos * {theta} * pow(cast(4 as double), -2.0e0 * i / 62), 6) as by_base, round(pos * {theta} * {by_parts}, 6) as by_parts
from (select {d.series('0', '63')} as pos) a cross join (select {d.series('0', '31')} as i) b"""


def rotated_vectors(d):
    """Vectors with each pair of dimensions turned by the angle of their position."""
    a = "(p * pow(cast(10000 as double), -2.0e0 * k / 64))"
    x, y = F(d.element("embedding", "2 * k + 1")), F(d.element("embedding", "2 * k + 2"))
    return f"""select vec_id, k, round({x} * cos{a} - {y} * sin{a}, 5) + 0e0 as x, round({x} * sin{a} + {y} * cos{a}, 5) + 0e0 as y
from (select vec_id, embedding, vec_id % 128 as p, cast(k as int) as k from (select vec_id, embedding, {d.series('0', '31')} as k from embeddings) g) q"""


def alibi_slopes(d):
    return f"select h, heads, round(pow(cast(2 as double), -(8.0 * (h + 1)) / heads), 9) as slope from (select {d.series('0', '31')} as h) a cross join (select 8 as heads union all select 16 union all select 32) b where h < heads"


def shard_sizing(d):
    """Parameters padded to a multiple of the ranks, values a rank holds and bytes that a ring moves for it."""
    padded = f"{d.div('p + n - 1', 'n')} * n"
    return f"select p, n, {I(padded)} as padded, {I(d.div(padded, 'n'))} as per_rank, {I(f'2 * (n - 1) * {d.div(padded, chr(110))} * 8')} as reduce_bytes, {I(f'(n - 1) * {d.div(padded, chr(110))} * 8')} as gather_bytes from (select {I('1009')} * i * i as p from (select {d.series('1', '40')} as i) a) x cross join (select 2 as n union all select 8 union all select 32) y"


def layer_padding(d):
    """Parameters of a layer by width, padded for the ranks, and the share of padding."""
    count = "(12 * w * w + 13 * w)"
    return f"select w, n, {I(count)} as params, {I(f'{d.div(f"{count} + n - 1", "n")} * n')} as padded, round(({d.div(f'{count} + n - 1', 'n')} * n - {count}) / cast({count} as double), 9) as waste from (select {I('64')} * i as w from (select {d.series('1', '16')} as i) a) x cross join (select 3 as n union all select 7 union all select 32) y"


def flops_per_token(d):
    """Operations a token of a decoder by width and layers, matrix products counted."""
    return f"select w, layers, {I('layers * 24 * w * w + 2 * w * 50257 + layers * 4 * 1024 * w')} as forward, {I('3 * (layers * 24 * w * w + 2 * w * 50257 + layers * 4 * 1024 * w)')} as training, {I('7 * layers + 1')} as products from (select {I('128')} * i as w from (select {d.series('1', '12')} as i) a) x cross join (select {d.series('2', '6')} as layers) y"


def collective_movement(d):
    """Sums by element over ranks, the part each rank keeps, and what every rank holds after gathering."""
    base = f"select r, k, {I('r * 100 + k')} as v from (select {d.series('0', '3')} as r) a cross join (select {d.series('0', '15')} as k) b"
    return f"with x as ({base}), s as (select k, {I('sum(v)')} as total from x group by k) select ranks.r, s.k, s.total, s.k >= ranks.r * 4 and s.k < (ranks.r + 1) * 4 as kept from s cross join (select distinct r from x) ranks"


def lr_schedules(d):
    """Warm-up with cosine, with a plateau and linear fall, and with a linear cool-down, by step of 200."""
    warm = "cast(least(step + 1, 20) as double) / 20"
    return f"""select step, round(case when step < 20 then {warm} else 0.1 + 0.45 * (1 + cos(pi() * (step - 20) / 180.0)) end, 9) as cosine,
round(case when step < 20 then {warm} when step < 160 then 1.0 else (200 - step) / 40.0 end, 9) as plateau, round({warm} * greatest(0.0, 1 - greatest(0, step - 100) / 100.0), 9) as cooled from (select {d.series('0', '199')} as step) q"""


def adam_ratio(d):
    """Ratio of the bias corrections by step, and the last step outside a hundredth of one."""
    ratio = "sqrt(1 - pow(cast(0.999 as double), t)) / (1 - pow(cast(0.9 as double), t))"
    return f"with r as (select t, {ratio} as ratio from (select {d.series('1', '6000')} as t) q) select count(*) as steps, max(case when abs(ratio - 1) > 0.01 then t end) as last_outside, round(min(ratio), 6) as least, round(max(ratio), 6) as most from r"


def numeric_features(d):
    """Linear, sign, logarithm and phase features of whole numbers; a phase is of the non-negative remainder."""
    mod = lambda t: f"((v % {t} + {t}) % {t})"
    phase = ", ".join(f"round(sin(2 * pi() * {mod(t)} / {t}.0), 6) + 0e0 as s{t}, round(cos(2 * pi() * {mod(t)} / {t}.0), 6) + 0e0 as c{t}" for t in PERIODS)
    return f"select v, v / 16384.0e0 as lin, {F('sign(v)')} as sgn, round(case when v = 0 then -1.0 else log10(abs(v)) end, 9) as lg, {phase} from (select g * 37 as v from (select {d.series('-300', '300')} as g) r) q"


def decoded_numbers(d):
    """Numbers read back from their features: by the linear one, and digit by digit from the phase of ten."""
    digit = lambda k: f"({d.div('abs(v)', 10**k)} % 10)"
    angle = lambda k: f"atan2(sin(2 * pi() * {digit(k)} / 10.0), cos(2 * pi() * {digit(k)} / 10.0))"
    back = lambda k: I(f"round(({angle(k)} / (2 * pi()) + 1) * 10) % 10")
    return f"select v, {I('round(v / 16384.0e0 * 16384)')} as by_line, {I(f'sign(v) * ({" + ".join(f"{10**k} * {back(k)}" for k in range(5))})')} as by_phase from (select g * 37 as v from (select {d.series('-300', '300')} as g) r) q"


def char_codebook(d):
    """Points of a spiral on the sphere, one for each character, and the closest other character."""
    n = len(ALPHABET)
    z, phi = f"(1 - 2 * (i + 0.5e0) / {n})", "(pi() * (3 - sqrt(cast(5 as double))) * i)"
    p = f"select i, sqrt(1 - {z} * {z}) * cos{phi} as x, sqrt(1 - {z} * {z}) * sin{phi} as y, {z} as z from (select {d.series('0', str(n - 1))} as i) g"
    return f"with p as ({p}) select i, c, j, round(s, 6) as cosine from (select a.i, substring('{ALPHABET}', {'cast(a.i + 1 as int)'}, 1) as c, b.i as j, a.x * b.x + a.y * b.y + a.z * b.z as s, row_number() over (partition by a.i order by round(a.x * b.x + a.y * b.y + a.z * b.z, 9) desc, b.i) as rn from p a join p b on a.i <> b.i) q where rn = 1"


def embedded_words(d):
    """Words as slots of codebook points (each over the root of the length) read back by the nearest point of a slot."""
    n = len(ALPHABET)
    z, phi = f"(1 - 2 * (i + 0.5e0) / {n})", "(pi() * (3 - sqrt(cast(5 as double))) * i)"
    book = f"select i, substring('{ALPHABET}', cast(i + 1 as int), 1) as c, sqrt(1 - {z} * {z}) * cos{phi} as x, sqrt(1 - {z} * {z}) * sin{phi} as y, {z} as z from (select {d.series('0', str(n - 1))} as i) g"
    words = f"select r_regionkey as id, {d.replace('lower(r_name)', '[^a-z0-9]', '')} as word from region"
    return f"""with book as ({book}), w as ({words}), slots as (select id, word, s, x / sqrt(cast(length(word) as double)) as x, y / sqrt(cast(length(word) as double)) as y, z / sqrt(cast(length(word) as double)) as z from (select id, word, cast(s as int) as s from (select id, word, {d.series('1', 'length(word)')} as s from w) g) q join book on book.c = substring(q.word, q.s, 1)),
near as (select slots.id, slots.word, slots.s, book.c, row_number() over (partition by slots.id, slots.s order by round(slots.x * book.x + slots.y * book.y + slots.z * book.z, 9) desc, book.i) as rn from slots cross join book)
select id, word, {d.concat_ordered('c', chr(39) * 2, 's')} as decoded from near where rn = 1 group by id, word"""


def embedding_variants(d):
    """Vectors with a range of dimensions set to zero: the readout, the homomorphic and the character part."""
    norm = lambda keep: f"round(sqrt({d.total(d.each(d.range(1, 64), 'i', f'case when {keep} then {F(d.element('embedding', 'i'))} * {F(d.element('embedding', 'i'))} else cast(0 as double) end'))}), 5)"
    return f"select vec_id, {norm('true')} as whole, {norm('i > 3')} as readout, {norm('i <= 32')} as homomorphic, {norm('i between 9 and 48')} as characters from embeddings"


def random_rows(d):
    """Rows of hashed numbers scaled to one norm: a function of seed, row and dimension alone."""
    return f"""with u as (select r, k, 2 * ({d.unit("concat_ws(chr(31), 11, 'rand_emb', r, k)")}) - 1 as v from (select {d.series('0', '15')} as r) a cross join (select {d.series('0', '15')} as k) b), n as (select r, sqrt(sum(v * v)) as norm from u group by r)
select u.r, u.k, round(u.v / n.norm * 1.5, 6) as v from u join n on n.r = u.r"""


def counter_random(d):
    """Numbers that depend on seed and coordinate alone: 64 bits, a fraction, and a whole number of a range."""
    key = "concat_ws(chr(31), 42, 'draw', i)"
    return f"select i, cast({d.u64(key)} as decimal(20, 0)) as u64, round({d.unit(key)}, 12) as fraction, {I(f'10 + {d.u64(key)} % 90')} as ranged from (select {d.series('0', '199')} as i) q"


def random_crops(d):
    """Starts of windows of 32 words drawn from the hash of seed, document and draw."""
    return f"select doc_id, k, {I(f'{d.u64("concat_ws(chr(31), 7, doc_id, k)")} % greatest(n - 31, 1)')} as start from (select doc_id, n_words as n, k from (select doc_id, cast({d.count('text', '[^ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r]+')} as bigint) as n_words from documents) a cross join (select {d.series('0', '2')} as k) b) q"


def grid_points(d):
    """All points of a grid between two corners."""
    return f"select x, y, round(-2 + x * 0.25, 4) as px, round(-1 + y * 0.125, 4) as py from (select {d.series('0', '16')} as x) a cross join (select {d.series('0', '16')} as y) b"


def synthetic_sets(d):
    """Two noisy rings, a noisy sine and one-hot rows, from hashed draws."""
    u = lambda tag: d.unit(f"concat_ws(chr(31), 3, '{tag}', i)")
    return f"""select i, i % 2 as ring, round((1 + i % 2 + 0.2 * ({u('r')} - 0.5)) * cos(2 * pi() * {u('a')}), 6) as x, round((1 + i % 2 + 0.2 * ({u('r')} - 0.5)) * sin(2 * pi() * {u('a')}), 6) as y,
round(sin(i / 16.0e0) + 0.1 * ({u('n')} - 0.5), 6) as wave, i % 8 as hot from (select {d.series('0', '255')} as i) q"""


def arithmetic_examples(d):
    """Sums and products of two operands; held out where an operand lies in the hole, training sets by hashed rank."""
    return f"""with e as (select op, a, b, case when op = 'add' then a + b else a * b end as c, a between 40 and 59 or b between 40 and 59 as held, {d.u64("concat_ws(chr(31), 5, op, a, b)")} as u from (select {d.series('0', '99')} as a) x cross join (select {d.series('0', '99')} as b) y cross join (select 'add' as op union all select 'mul') o)
select op, a, b, c, held, case when held then null when rk <= 500 then 500 when rk <= 2000 then 2000 when rk <= 8000 then 8000 end as smallest_set from (select *, row_number() over (partition by op, held order by u, a, b) as rk from e) q"""


def serialised_examples(d):
    """Examples as padded symbols: digits of both operands, operator, result; and the place where the answer starts."""
    t = "concat(cast(a as varchar(9)), '+', cast(b as varchar(9)), '=')"
    return f"select a, b, rpad(concat({t}, cast(a + b as varchar(9)), '.'), 12, '_') as padded, length({t}) as answer_at from (select {d.series('0', '40')} as a) x cross join (select {d.series('0', '40')} as b) y"


def property_checks(d):
    """Algebra of the numeric features over a range: sums add, halves scale, phases turn, signs mirror."""
    s = lambda v, t: f"sin(2 * pi() * (({v}) % {t}) / {t}.0)"
    c = lambda v, t: f"cos(2 * pi() * (({v}) % {t}) / {t}.0)"
    checks = {"line_adds": "abs((a + b) / 16384.0e0 - (a / 16384.0e0 + b / 16384.0e0)) < 1e-12", "phase_turns": f"abs({s('a + b', 100)} - ({s('a', 100)} * {c('b', 100)} + {c('a', 100)} * {s('b', 100)})) < 1e-9", "unit_phase": f"abs(pow({s('a', 10)}, 2) + pow({c('a', 10)}, 2) - 1) < 1e-12", "log_of_product": "a = 0 or b = 0 or abs(log10(cast(a * b as double)) - log10(cast(a as double)) - log10(cast(b as double))) < 1e-9", "period": f"abs({s('a + 10', 10)} - {s('a', 10)}) < 1e-9"}
    grid = f"(select {d.series('0', '120')} as a) x cross join (select {d.series('0', '120')} as b) y"
    return " union all ".join(f"select '{k}' as property, {I(f'sum(case when {e} then 0 else 1 end)')} as broken, count(*) as cases from {grid}" for k, e in checks.items())


def tolerance_checks(d):
    """Columns against bounds: finite, and within a relative or absolute tolerance of a recomputed value."""
    return f"select l_returnflag, {I('sum(case when l_extendedprice is null then 1 else 0 end)')} as missing, {I('sum(case when abs(l_extendedprice * (1 - l_discount) - (l_extendedprice - l_extendedprice * l_discount)) <= greatest(1e-9, 1e-9 * abs(l_extendedprice)) then 0 else 1 end)')} as apart from lineitem group by l_returnflag"


def display_formats(d):
    """Numbers as they are shown: bytes, counts of tokens and escaped text."""
    unit = "case when n >= 1073741824 then concat(cast(round(n / 1073741824.0e0, 2) as varchar(20)), ' GiB') when n >= 1048576 then concat(cast(round(n / 1048576.0e0, 2) as varchar(20)), ' MiB') when n >= 1024 then concat(cast(round(n / 1024.0e0, 2) as varchar(20)), ' KiB') else concat(cast(n as varchar(20)), ' B') end"
    esc = "replace(replace(replace(left(text, 200), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"select doc_id, {unit} as shown, concat(cast(round(n / 1000000.0e0, 2) as varchar(20)), 'M') as millions, {d.sha(esc)} as escaped from (select doc_id, text, n_chars * n_chars as n from documents) q"


QUERIES = {f.__name__: f for f in (attention_schemes, model_totals, cache_layouts, mask_counts, block_select_counts, bucketed_vectors, softmax_scores, positional_encodings, rotated_vectors, alibi_slopes, shard_sizing, layer_padding, flops_per_token, collective_movement, lr_schedules, adam_ratio, numeric_features, decoded_numbers, char_codebook, embedded_words, embedding_variants, random_rows, counter_random, random_crops, grid_points, synthetic_sets, arithmetic_examples, serialised_examples, property_checks, tolerance_checks, display_formats)}
