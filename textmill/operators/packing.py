"""Packing, schedules, batches, ledgers and mixture plans as relations.

Lanes are cut into shards of SHARD documents; a sequential fold never reaches across a shard, so no task holds more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from textmill.functions.dialect import Spark
from textmill.operators.control import FLOORS, STAGES
from textmill.operators.corpus import LANE, shard_offsets
from textmill.operators.text import words
from textmill.session import table

LENGTH, SHARD, GENESIS = 256, 4096, "0" * 64
I = lambda x: f"cast({x} as bigint)"  # noqa: E731, E741
#: Lanes of a schedule with their weights in the four stages, and lanes with a floor.
WEIGHTS = "('web', 40, 18, 10, 10), ('code', 18, 30, 15, 25), ('math_science', 10, 20, 5, 15), ('indic', 16, 8, 8, 15), ('reasoning', 5, 12, 7, 20), ('agentic', 2, 8, 5, 12)"


def _units(d):
    """Documents of a lane in order, with their tokens (words and an end) and their shard."""
    return f"select lane, {d.div('rn - 1', SHARD)} as shard, (rn - 1) % {SHARD} + 1 as rn, doc_id, n from (select lane, doc_id, n, row_number() over (partition by lane order by doc_id) as rn from (select {LANE} as lane, doc_id, {I(d.size(words(d, 'text')))} + 1 as n from documents) a) b"


def _placed(d):
    """(lane, shard, rn, doc_id, n, sample): next-fit of whole units; a longer unit is cut and stands alone."""
    if d.name == "spark":
        step = f"case when a.used + u.n <= {LENGTH} then struct(a.sample as sample, a.used + u.n as used) else struct(a.sample + 1 as sample, least(u.n, {LENGTH}L) as used) end"
        fold = f"aggregate(units, struct(-1L as sample, {LENGTH}L as used, cast(array() as array<bigint>) as out), (a, u) -> named_struct('sample', ({step}).sample, 'used', ({step}).used, 'out', concat(a.out, array(({step}).sample))), a -> a.out)"
        return f"select lane, shard, units[place].rn as rn, units[place].doc_id as doc_id, units[place].n as n, sample from (select lane, shard, units, posexplode(samples) as (place, sample) from (select lane, shard, units, {fold} as samples from (select lane, shard, array_sort(collect_list(struct(rn, doc_id, n))) as units from ({_units(d)}) q group by lane, shard) p) s) t"
    return f"""(with recursive u as ({_units(d)}), c(lane, shard, rn, doc_id, n, sample, used) as (select lane, shard, rn, doc_id, n, 0::bigint, least(n, {LENGTH}) from u where rn = 1
union all select u.lane, u.shard, u.rn, u.doc_id, u.n, case when c.used + u.n <= {LENGTH} then c.sample else c.sample + 1 end, case when c.used + u.n <= {LENGTH} then c.used + u.n else least(u.n, {LENGTH}) end from c join u on u.lane = c.lane and u.shard = c.shard and u.rn = c.rn + 1)
select lane, shard, rn, doc_id, n, sample from c)"""


def whole_unit_packing(d):
    return f"select lane, shard, sample, count(*) as units, {I(f'sum(least(n, {LENGTH}))')} as real_tokens, {I(f'{LENGTH} - sum(least(n, {LENGTH}))')} as pad_tokens, {I(f'sum(case when n > {LENGTH} then 1 else 0 end)')} as cut from ({_placed(d)}) p group by lane, shard, sample"


def prompt_completion_packing(d):
    """A document a sample, cut to the length; the prompt (a quarter) and the first token carry no loss."""
    return f"select doc_id, real_tokens, prompt_tokens, {LENGTH} - real_tokens as pad_tokens, greatest(real_tokens - greatest(prompt_tokens, 1), 0) as loss_tokens from (select doc_id, least(n, {LENGTH}) as real_tokens, least({d.div('n', 4)}, {LENGTH}) as prompt_tokens from ({_units(d)}) u) q"


def cyclic_concat_segments(d):
    """Concat packing of two epochs of a lane: a document's tokens in every sample that they reach."""
    return f"""with o as ({shard_offsets(d)}), t as (select lane, sum(n_tokens) as total from o group by lane), e as (select 0 as epoch union all select 1),
x as (select o.lane, o.doc_id, e.epoch, {I('o.token_start + e.epoch * t.total')} as lo, {I('o.token_start + e.epoch * t.total + o.n_tokens')} as hi from o join t on t.lane = o.lane cross join e)
select lane, epoch, doc_id, sample, greatest(lo, sample * {LENGTH}) - sample * {LENGTH} as seg_start, least(hi, (sample + 1) * {LENGTH}) - greatest(lo, sample * {LENGTH}) as seg_len, lo < sample * {LENGTH} as continued from (select *, {d.series(d.div('lo', LENGTH), d.div('hi - 1', LENGTH))} as sample from x) y"""


def _segments(d):
    """(lane, shard, sample, seg, doc_id, seg_start, seg_len) of whole-unit samples."""
    part = "partition by lane, shard, sample order by rn"
    return f"select lane, shard, sample, row_number() over ({part}) - 1 as seg, doc_id, {I(f'sum(least(n, {LENGTH})) over ({part} rows between unbounded preceding and current row)')} - least(n, {LENGTH}) as seg_start, least(n, {LENGTH}) as seg_len from ({_placed(d)}) p"


def _positions(d):
    """Every place of every sample: token, segment, position in it, loss; padding has segments -1, -2, .. of its own."""
    real = f"select lane, shard, sample, seg_start + k as place, (doc_id * 31 + k) % 1000 + 4 as token, seg, k as position, case when k = 0 then 0 else 1 end as loss from (select *, {d.series('0', 'seg_len - 1')} as k from ({_segments(d)}) s) r"
    pad = f"select lane, shard, sample, place, 0 as token, -(place - used + 1) as seg, 0 as position, 0 as loss from (select lane, shard, sample, used, {d.series('used', str(LENGTH - 1))} as place from (select lane, shard, sample, sum(seg_len) as used from ({_segments(d)}) s group by lane, shard, sample) u where used < {LENGTH}) p"
    return f"select lane, shard, sample, {I('place')} as place, {I('token')} as token, {I('seg')} as seg, {I('position')} as position, {I('loss')} as loss from ({real} union all {pad}) x"


def packed_samples(d):
    """Counts and hash of each sample's arrays (tokens, segments, positions, loss)."""
    text = lambda c: d.join(d.each(d.ordered_list(c, "place"), "x", "cast(x as varchar(20))"), ",")
    return f"""select lane, shard, sample, {I('sum(case when seg >= 0 then 1 else 0 end)')} as real_tokens, {I('sum(loss)')} as loss_tokens, {I('sum(case when seg < 0 then 1 else 0 end)')} as pad_tokens,
{d.sha(f"concat_ws('|', lane, {text('token')}, {text('seg')}, {text('position')}, {text('loss')})")} as sample_hash from ({_positions(d)}) p group by lane, shard, sample"""


def packing_invariants(d):
    """Broken invariants of the packed places: positions reset and count up, no loss on padding or first tokens, padding is a tail of its own segments, whole units."""
    lag = lambda c: f"lag({c}) over (partition by lane, shard, sample order by place)"
    checks = {
        "position_resets": "(before is null or before <> seg) and position <> 0", "position_counts": "before = seg and position <> last + 1", "loss_on_padding": "seg < 0 and loss = 1",
        "loss_on_first": "position = 0 and loss = 1", "padding_inside": "seg >= 0 and before < 0", "padding_token": "seg < 0 and token <> 0", "padding_shares": "seg < 0 and before = seg",
    }
    rows = f"select *, {lag('seg')} as before, {lag('position')} as last from ({_positions(d)}) p"
    split = f"select 'unit_split' as invariant, {I('count(*)')} as broken from ({_segments(d)}) s join ({_units(d)}) u on u.doc_id = s.doc_id where s.seg_len <> least(u.n, {LENGTH})"
    return f"with r as ({rows}) " + " union all ".join(f"select '{k}' as invariant, {I(f'coalesce(sum(case when {c} then 1 else 0 end), 0)')} as broken from r" for k, c in checks.items()) + f" union all {split}"


def block_causal_pairs(d):
    """Pairs of query and key that a sample allows: the same segment and not later, or the place itself."""
    first = "lane = 'web' and shard = 0 and sample < 4"
    return f"with p as (select * from ({_positions(d)}) x where {first}) select q.sample, q.place, count(*) as allowed from p q join p k on k.sample = q.sample and ((k.seg = q.seg and k.place <= q.place) or k.place = q.place) group by q.sample, q.place"


def packing_report(d):
    """Utilisation and loss share by policy and by lane, as grouping sets."""
    rows = f"select 'whole_unit' as policy, lane, real_tokens, real_tokens - units as loss_tokens, {LENGTH} as slots from ({whole_unit_packing(d)}) w union all select 'prompt_completion', l.lane, p.real_tokens, p.loss_tokens, {LENGTH} from ({prompt_completion_packing(d)}) p join (select doc_id, {LANE} as lane from documents) l on l.doc_id = p.doc_id"
    return f"select policy, lane, count(*) as samples, round(sum(real_tokens) / cast(sum(slots) as double), 6) as utilisation, round(sum(loss_tokens) / cast(sum(real_tokens) as double), 6) as loss_share from ({rows}) r group by grouping sets ((policy), (lane))"


def _fractions(d):
    """Shares of the lanes by stage with floors: lanes below their floor are pinned to it, pass by pass, the rest share what is left."""
    stages = " union all ".join(f"select {k} as stage, lane, w{k} as w from v" for k in range(4))
    base = f"v as {d.values(WEIGHTS, 'lane, w0, w1, w2, w3')}, x0 as (select s.stage, s.lane, cast(s.w as double) as w, f.floor_share, cast(null as double) as pinned from ({stages}) s left join {FLOORS} f on f.lane = s.lane)"
    for k in range(1, 4):
        base += f""", c{k} as (select x.stage, x.lane, x.w, x.floor_share, x.pinned, t.free * x.w / t.weight as candidate from x{k - 1} x join (select stage, 1 - coalesce(sum(pinned), 0) as free, sum(case when pinned is null then w else 0 end) as weight from x{k - 1} group by stage) t on t.stage = x.stage),
x{k} as (select stage, lane, w, floor_share, case when pinned is null and floor_share is not null and candidate < floor_share - 1e-12 then floor_share else pinned end as pinned from c{k})"""
    return f"{base}, fr as (select x.stage, x.lane, x.floor_share, coalesce(x.pinned, t.free * x.w / t.weight) as share from x3 x join (select stage, 1 - coalesce(sum(pinned), 0) as free, sum(case when pinned is null then w else 0 end) as weight from x3 group by stage) t on t.stage = x.stage)"


def floored_fractions(d):
    return f"with {_fractions(d)} select stage, lane, round(share, 9) as share from fr"


def _counts(d):
    """Slots of the lanes by stage of 160: largest remainder, then floors in whole slots, taken from the largest lane without a floor."""
    return f"""{_fractions(d)}, q as (select stage, lane, floor_share, share * 160 as exact from fr),
r as (select stage, lane, floor_share, {I('floor(exact)')} as base, row_number() over (partition by stage order by round(exact - floor(exact), 9) desc, lane) as rn from q),
s as (select r.stage, r.lane, r.floor_share, r.base + case when r.rn <= 160 - t.used then 1 else 0 end as slots from r join (select stage, sum(base) as used from r group by stage) t on t.stage = r.stage),
need as (select stage, lane, {I('greatest(ceil(floor_share * 160) - slots, 0)')} as short from s where floor_share is not null),
lack as (select stage, {I('sum(short)')} as units from need group by stage),
unit as (select stage, lane, row_number() over (partition by stage order by v desc, lane desc) as rn from (select stage, lane, {d.series('2', 'slots')} as v from s where floor_share is null and slots >= 2) e),
given as (select u.stage, u.lane, count(*) as given from unit u join lack l on l.stage = u.stage where u.rn <= l.units group by u.stage, u.lane),
n as (select s.stage, s.lane, s.slots + coalesce(need.short, 0) - coalesce(given.given, 0) as slots from s left join need on need.stage = s.stage and need.lane = s.lane left join given on given.stage = s.stage and given.lane = s.lane)"""


def floored_slots(d):
    return f"with {_counts(d)} select stage, lane, {I('slots')} as slots from n"


def _schedule(d):
    """The pool of a stage in hashed order, eight slots a step."""
    order = d.u64("concat_ws(chr(31), 9, stage, lane, k)")
    return f"""{_counts(d)}, pool as (select stage, lane, {d.series('1', 'slots')} as k from n where slots > 0), dealt as (select stage, lane, row_number() over (partition by stage order by {order}, lane, k) - 1 as place from pool),
schedule as (select stage, {I('stage * 20')} + {d.div('place', 8)} as step, place % 8 as slot, lane from dealt)"""


def compiled_schedule(d):
    return f"with {_schedule(d)} select stage, step, slot, lane from schedule"


def scheduled_shares(d):
    """Shares of the slots by stage and lane, lanes without slots included, against the plan."""
    return f"with {_schedule(d)} select fr.stage, fr.lane, count(schedule.slot) as slots, round(fr.share, 6) as planned, round(abs(count(schedule.slot) / 160.0e0 - fr.share), 6) as deviation from fr left join schedule on schedule.stage = fr.stage and schedule.lane = fr.lane group by fr.stage, fr.lane, fr.share"


def _batches(d):
    """Slots of the schedule joined with samples of their lane by ordinal, samples taken in a cycle."""
    lanes = "case lane when 'math_science' then 'web' when 'agentic' then 'code' else lane end"
    samples = f"select lane, sample_hash, real_tokens, loss_tokens, pad_tokens, row_number() over (partition by lane order by shard, sample) - 1 as ordinal from ({packed_samples(d)}) p"
    return f"""{_schedule(d)}, samples as ({samples}), size as (select lane, count(*) as n from samples group by lane),
slots as (select stage, step, slot, {lanes} as lane, row_number() over (partition by {lanes} order by step, slot) - 1 as taken from schedule),
joined as (select s.stage, s.step, s.slot, s.lane, s.taken, {d.div('s.taken', 'z.n')} as epoch, p.sample_hash, p.real_tokens, p.loss_tokens, p.pad_tokens from slots s join size z on z.lane = s.lane join samples p on p.lane = s.lane and p.ordinal = s.taken % z.n),
batch as (select stage, step, {d.sha(f"concat_ws('|', 'run', step, {d.join(d.ordered_list('sample_hash', 'slot'), ',')})")} as batch_id, {I('sum(real_tokens)')} as real_tokens, {I('sum(loss_tokens)')} as loss_tokens, {I('sum(pad_tokens)')} as pad_tokens from joined group by stage, step)"""


def batches(d):
    return f"with {_batches(d)} select stage, step, batch_id, real_tokens, loss_tokens, pad_tokens from batch"


def lane_cursors(d):
    """Samples that each lane has used up before and after every step."""
    return f"with {_batches(d)} select step, lane, {I('min(taken)')} as before, {I('max(taken) + 1')} as after from joined group by step, lane"


def consumption_records(d):
    """A record a step and lane: tokens, slots and epochs used."""
    return f"with {_batches(d)} select joined.step, batch.batch_id, joined.lane, {I('sum(joined.real_tokens)')} as lane_tokens, count(*) as lane_slots, max(joined.epoch) as epoch from joined join batch on batch.step = joined.step group by joined.step, batch.batch_id, joined.lane"


def replay_comparison(d):
    """Steps 10 to 29 rebuilt from schedule and samples, against the recorded batches, equal in id and in order of samples."""
    return f"with {_batches(d)}, replay as (select step, {d.ordered_list('sample_hash', 'slot')} as hashes from joined where step between 10 and 29 group by step), stored as (select step, {d.ordered_list('sample_hash', 'slot')} as hashes from joined group by step) select replay.step, replay.hashes = stored.hashes as same, {d.size('replay.hashes')} as samples from replay join stored on stored.step = replay.step"


def fork_lineage(d):
    """A run that forks at step 40: its steps before are shared, their batches have ids of its own."""
    return f"""with {_batches(d)}, fork as (select step, {d.sha("concat(batch_id, ':fork')")} as batch_id from batch where step >= 40)
select (select count(*) from batch where step < 40) as shared_steps, count(*) as forked_steps, {I('sum(case when b.batch_id = f.batch_id then 1 else 0 end)')} as same_ids from fork f join batch b on b.step = f.step"""


def learning_links(d):
    """Learning records against consumption by step and batch: what lacks a partner on either side."""
    return f"with {_batches(d)}, learnt as (select step, case when step % 17 = 0 then 'other' else batch_id end as batch_id from batch where step <> 5) select coalesce(l.step, b.step) as step, case when b.step is null then 'not_consumed' when l.step is null then 'not_learnt' end as error from learnt l full outer join batch b on b.step = l.step and b.batch_id = l.batch_id where l.step is null or b.step is null"


def resumed_steps(d):
    """Steps run again after a crash against the first time: id, tokens."""
    return f"with {_batches(d)}, again as (select step, batch_id, real_tokens + case when step = 33 then 1 else 0 end as real_tokens from batch where step >= 30) select a.step, a.batch_id = b.batch_id as same_batch, a.real_tokens = b.real_tokens as same_tokens from again a join batch b on b.step = a.step"


def _chain(d):
    """(segment, seq, payload, prev, hash): hash chains of segments of 1000 events, each from the start value."""
    rows = f"select segment, seq, payload from (select {d.div('event_id', 1000)} as segment, row_number() over (partition by {d.div('event_id', 1000)} order by event_id) - 1 as seq, concat_ws('|', event_id, user_id, event_type) as payload from events) r"
    if d.name == "spark":
        fold = f"aggregate(rows, array('{GENESIS}'), (a, r) -> concat(a, array(sha2(concat(element_at(a, -1), r.payload), 256))))"
        return f"select segment, cast(place as bigint) as seq, rows[place].payload as payload, hashes[place] as prev, hashes[place + 1] as hash from (select segment, rows, hashes, explode(sequence(0, size(rows) - 1)) as place from (select segment, rows, {fold} as hashes from (select segment, array_sort(collect_list(struct(seq, payload))) as rows from ({rows}) q group by segment) p) s) t"
    return f"(with recursive e as ({rows}), c(segment, seq, payload, prev, hash) as (select segment, seq, payload, '{GENESIS}', sha256('{GENESIS}' || payload) from e where seq = 0 union all select e.segment, e.seq, e.payload, c.hash, sha256(c.hash || e.payload) from c join e on e.segment = c.segment and e.seq = c.seq + 1) select segment, seq, payload, prev, hash from c)"


def ledger_chain(d):
    return f"select segment, seq, prev, hash from ({_chain(d)}) c"


def ledger_heads(d):
    """The head of each segment and the digest that binds it to the segments before."""
    text = f"{d.join(d.ordered_list('head', 'segment'), ',')}"
    return f"with h as (select segment, max(case when last then hash end) as head, count(*) as entries from (select segment, hash, row_number() over (partition by segment order by seq desc) = 1 as last from ({_chain(d)}) c) x group by segment) select a.segment, a.entries, a.head, {d.sha(text.replace('head', 'b_head').replace('segment', 'b_segment'))} as bound from h a join (select segment as b_segment, head as b_head from h) b on b.b_segment <= a.segment group by a.segment, a.entries, a.head"


def bound_heads(spark, sf_dir):
    """ledger_heads in one pass: a segment's head is folded without its links, and one digest runs over the ordered heads.

    A digest of everything before is sequential by its nature: one task reads a row per segment (1,000 events), sorted
    by Spark, and holds no more than the state of the digest.
    """
    events = table(spark, sf_dir, "events")
    rows = events.selectExpr(f"{Spark.div('event_id', 1000)} as segment", "event_id", "concat_ws('|', event_id, user_id, event_type) as payload").where("segment is not null")
    lists = rows.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("event_id", "payload"))).alias("entries"))
    heads = lists.selectExpr("segment", "cast(size(entries) as bigint) as entries", f"aggregate(entries, '{GENESIS}', (a, r) -> sha2(concat(a, r.payload), 256)) as head")

    def bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, between = hashlib.sha256(), b""
        for batch in batches:
            out = []
            for head in batch.column("head").to_pylist():
                digest.update(between + head.encode())
                between = b","
                out.append(digest.copy().hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["segment", "entries", "head", "bound"])

    return heads.repartition(1).sortWithinPartitions("segment").mapInArrow(bind, "segment bigint, entries bigint, head string, bound string")


def ledger_verify(d):
    """The first broken entry of each segment of a tampered copy: a missing entry, a wrong link or a wrong hash; each entry needs its stored neighbour only."""
    copy = f"select segment, seq, case when seq = 501 then concat(payload, 'x') else payload end as payload, case when segment = 3 and seq = 100 then '{GENESIS}' else prev end as prev, hash from ({_chain(d)}) c where not (segment = 2 and seq = 300)"
    rows = f"select segment, seq, payload, prev, hash, row_number() over (partition by segment order by seq) - 1 as place, coalesce(lag(hash) over (partition by segment order by seq), '{GENESIS}') as before from ({copy}) k"
    error = f"case when seq <> place then 'seq_gap' when prev <> before then 'prev_mismatch' when {d.sha('concat(before, payload)')} <> hash then 'hash_mismatch' end"
    return f"select segment, seq, error from (select segment, seq, error, row_number() over (partition by segment order by seq) as rn from (select segment, seq, {error} as error from ({rows}) r) e where error is not null) f where rn = 1"


def ledger_truncated(d):
    """Each segment cut to its first 400 entries: entries left and the new head."""
    return f"select segment, count(*) as entries, max(case when seq = last then hash end) as head from (select segment, seq, hash, max(seq) over (partition by segment) as last from ({_chain(d)}) c where seq < 400) x group by segment"


def checkpoint_manifest(d):
    """Digests that a checkpoint binds (documents, labels, schedule) and whether a changed copy still matches."""
    bind = lambda t, x: f"select '{t}' as part, {I('count(*)')} as entries, cast(sum({x}) as decimal(38, 0)) as binding from {t}"
    parts = " union all ".join((bind("documents", f"{d.u64('concat_ws(chr(31), doc_id, n_chars)')}"), bind("labels", f"{d.u64('concat_ws(chr(31), doc_id, quality, toxic)')}"), bind("benchmark", f"{d.u64('concat_ws(chr(31), item_id, length(text))')}")))
    return f"select part, entries, {d.sha('cast(binding as varchar(60))')} as digest, part <> 'labels' as matches from ({parts}) p"


def shard_manifest(d):
    """Shards of a lane: documents, tokens, digest of their keys in order, and whether counts and spans agree."""
    keys = d.join(d.ordered_list(f"substring({d.sha('cast(doc_id as varchar(20))')}, 1, 16)", "doc_id"), ",")
    return f"select lane, shard, count(*) as docs, {I('sum(n)')} as tokens, {d.sha(keys)} as shard_hash, max(rn) = count(*) as contiguous from ({_units(d)}) u group by lane, shard"


def document_spans(d):
    """Documents joined with the span of their shard; those without one have no tokens."""
    return f"select d.doc_id, coalesce(s.token_start, 0) as token_start, coalesce(s.n_tokens, 0) as n_tokens from documents d left join (select * from ({shard_offsets(d)}) o where lane <> 'indic') s on s.doc_id = d.doc_id"


def stage_boundary_steps(d):
    return f"select s.stage, {I('count(*)')} as steps from (select {d.series('0', '47')} as step) g join (select stage, {I('round(sum(share) over (order by stage) * 48)')} as hi, {I('round((sum(share) over (order by stage) - share) * 48)')} as lo from {STAGES} t) s on g.step >= s.lo and g.step < s.hi group by s.stage"


QUERIES = {f.__name__: f for f in (whole_unit_packing, prompt_completion_packing, cyclic_concat_segments, packed_samples, packing_invariants, block_causal_pairs, packing_report, floored_fractions, floored_slots, compiled_schedule, scheduled_shares, batches, lane_cursors, consumption_records, replay_comparison, fork_lineage, learning_links, resumed_steps, ledger_chain, ledger_heads, ledger_verify, ledger_truncated, checkpoint_manifest, shard_manifest, document_spans, stage_boundary_steps)}
#: Run in place of the query text, which stays their oracle.
DIRECT = {"ledger_heads": bound_heads}
