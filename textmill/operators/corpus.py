"""Corpus operators: dedup, joins, decontamination, masks, packing, ledgers, windows, statistics."""

from __future__ import annotations

from textmill.operators.text import shingle_words, words

LANE = "case lang when 'en' then 'web' when 'de' then 'code' when 'fr' then 'indic' else 'reasoning' end"


def exact_dedup(d):
    """The first of equal texts stays: digests are aggregated, so a large group of copies is one row a task."""
    return f"with h as (select doc_id, {d.sha('text')} as h from documents), f as (select h, min(doc_id) as first_id from h group by h) select h.doc_id, h.doc_id = f.first_id as kept from h join f on f.h = h.h"


def prefix_slice(d):
    """Rows in order until a budget of characters is reached: sums of blocks of 1024 ids, then of the rows of a block."""
    return f"with b as (select {d.div('doc_id', 1024)} as block, sum(n_chars) as n from documents group by 1), o as (select block, sum(n) over (order by block) - n as before from b) select doc_id, cum from (select d.doc_id, d.n_chars, cast(o.before + sum(d.n_chars) over (partition by {d.div('d.doc_id', 1024)} order by d.doc_id) as bigint) as cum from documents d join o on o.block = {d.div('d.doc_id', 1024)} where o.before < 1000000) q where cum - n_chars < 1000000"


def quality_gate(d):
    return "select d.doc_id, l.quality from documents d join labels l on l.doc_id = d.doc_id where l.quality >= 1"


def missing_scores(d):
    return "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)"


def label_histogram(d):
    return "select lang, quality, toxic, count(*) as docs from documents join labels on labels.doc_id = documents.doc_id group by grouping sets ((lang, quality, toxic), (lang), ())"


def _grams(d, table, key, n):
    return f"select distinct {key}, gram from (select {key}, {d.join(d.slice('w', 'i', str(n)), ' ')} as gram from (select {key}, w, {d.series('1', d.size('w') + f' - {n - 1}')} as i from (select {key}, {words(d, d.replace(d.replace('lower(text)', '[^a-z0-9]+', ' '), ' +', ' '))} as w from {table}) a where {d.size('w')} >= {n}) b) c"


def benchmark_fingerprints(d):
    return f"with g as ({_grams(d, 'benchmark', 'item_id', 13)}) select item_id, count(*) as grams, {d.sha('min(gram)')} as first_gram from g group by item_id"


def firewall_leaks(d):
    return f"with e as (select distinct {d.sha('text')} as h from documents where doc_id % 20 = 0) select doc_id, 'eval_firewall' as reason from documents where doc_id % 20 <> 0 and {d.sha('text')} in (select h from e)"


def corpus_hash(d):
    """Digest of a language's text digests in order, by their first two hex digits, and the digest over these 256 parts."""
    join = lambda x: f"concat_ws(chr(10), array_sort(collect_list({x})))" if d.name == "spark" else f"string_agg({x}, chr(10) order by {x})"
    return f"select lang, {d.sha(join('part'))} as content_hash from (select lang, concat(substring(h, 1, 2), {d.sha(join('h'))}) as part from (select lang, {d.sha('text')} as h from documents) q group by lang, substring(h, 1, 2)) p group by lang"


def conversation_loss_mask(d):
    return "select conv_id, cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars, cast(sum(length(text)) as bigint) as total_chars, round(sum(case when role = 'assistant' then length(text) else 0 end) / cast(sum(length(text)) as double), 6) as loss_share from conversations group by conv_id"


def role_transition_anomalies(d):
    return "select conv_id, turn, role, prev from (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as prev from conversations) q where prev = role or (prev is null and role = 'assistant') or (role = 'system' and turn > 0)"


def grouped_turns(d):
    return f"select conv_id, role, {d.sha(d.concat_ordered('text', 'chr(10) || chr(10)', 'turn'))} as joined_sha, count(*) as turns from conversations group by conv_id, role"


def first_user_message(d):
    return "select conv_id, text from (select conv_id, text, row_number() over (partition by conv_id order by turn) as rn from conversations where role = 'user') q where rn = 1"


def degenerate_loops(d):
    return """with s as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) as island from events)
select user_id, event_type, min(event_id) as first_event, count(*) as run_length from s group by user_id, event_type, island having count(*) >= 4"""


def shard_offsets(d):
    """Token offsets of the documents of a lane: sums of blocks of 1024 ids, then of the documents of a block."""
    block = d.div("doc_id", 1024)
    return f"""select x.doc_id, x.lane, cast(o.before + sum(x.n + 1) over (partition by x.lane, x.block order by x.doc_id) - (x.n + 1) as bigint) as token_start, x.n + 1 as n_tokens from (select doc_id, {LANE} as lane, {block} as block, cast({d.size(words(d, 'text'))} as bigint) as n from documents) x
join (select lane, block, sum(n) over (partition by lane order by block) - n as before from (select {LANE} as lane, {block} as block, cast(sum({d.size(words(d, 'text'))} + 1) as bigint) as n from documents group by 1, 2) s) o on o.lane = x.lane and o.block = x.block"""


def concat_packing_segments(d):
    length = 256
    return f"""with o as ({shard_offsets(d)})
select lane, sample, doc_id, greatest(token_start, sample * {length}) as seg_start, least(token_start + n_tokens, (sample + 1) * {length}) as seg_end
from (select *, {d.series(d.div('token_start', length), d.div(f'token_start + n_tokens - 1', length))} as sample from o) q"""


def largest_remainder_slots(d):
    return """with w as (select lang, count(*) as n from documents group by lang), s as (select lang, n * 384.0 / (select sum(n) from w) as q from w),
r as (select lang, cast(floor(q) as bigint) as base, row_number() over (order by q - floor(q) desc, lang) as rn from s)
select lang, base + case when rn <= 384 - (select sum(base) from r) then 1 else 0 end as slots from r"""


def mixture_shares(d):
    return f"select {LANE} as lane, count(*) as docs, round(count(*) / cast((select count(*) from documents) as double), 6) as share from documents group by 1"


def trailing_median(d):
    """Events of a user in order with the upper median of the 30 values before."""
    if d.name == "spark":
        med = "element_at(array_sort(collect_list(value) over w), cast(floor(size(collect_list(value) over w) / 2) as int) + 1)"
    else:
        med = "list_sort(list(value) over w)[len(list(value) over w) // 2 + 1]"
    return f"select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) as rn, case when count(value) over w > 0 then {med} end as med from events window w as (partition by user_id order by ts, event_id rows between 30 preceding and 1 preceding)"


def event_spikes(d):
    return f"select event_id, med from ({trailing_median(d)}) q where rn > 8 and value > 1.5 * med"


def regression(d):
    return "select event_type, count(*) as n, round(regr_slope(value, cast(event_id as double)), 9) as slope, round(regr_r2(value, cast(event_id as double)), 6) as r2 from events group by event_type"


def grouping_loss(d):
    return "select l_returnflag, l_linestatus, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 8) as weighted, round(avg(l_discount), 8) as plain from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())"


def vector_topk(d):
    dot = "aggregate(zip_with(a.embedding, b.embedding, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)" if d.name == "spark" else "list_dot_product(a.embedding::double[], b.embedding::double[])"
    return f"select q, v, rk from (select a.vec_id as q, b.vec_id as v, row_number() over (partition by a.vec_id order by round({dot}, 9) desc, b.vec_id) as rk from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0) s where rk <= 5"


def attention_cost_table(d):
    return f"select n, cast(4 * n * n * 128 as bigint) as dense_flops, cast(4 * 128 * (case when n <= 1024 then {d.div('n * (n + 1)', 2)} else {d.div('1024 * 1025', 2)} + (n - 1024) * 1024 end) as bigint) as window_flops from (select cast(512 as bigint) * i as n from (select {d.series('1', '64')} as i) g) q"


def lr_schedule(d):
    return f"select step, round(case when step < 10 then (step + 1) / 10.0 else 0.5 * (1 + cos(pi() * (step - 10) / 90.0)) end, 9) as lr from (select {d.series('0', '99')} as step) q"


def faithful_units_by_lang(d):
    return f"select lang, cast(sum({d.size(shingle_words(d, 'text'))}) as bigint) as units from documents group by lang"


def consecutive_windows(d):
    return f"select doc_id, start from (select doc_id, n, i * 255 as start from (select doc_id, n, {d.series('0', d.div('n - 1', 255))} as i from (select doc_id, cast({d.size(words(d, 'text'))} as bigint) as n from documents) a where n > 0) c) b where start < n"


QUERIES = {f.__name__: f for f in (exact_dedup, prefix_slice, quality_gate, missing_scores, label_histogram, benchmark_fingerprints, firewall_leaks, corpus_hash, conversation_loss_mask, role_transition_anomalies, grouped_turns, first_user_message, degenerate_loops, shard_offsets, concat_packing_segments, largest_remainder_slots, mixture_shares, event_spikes, regression, grouping_loss, vector_topk, attention_cost_table, lr_schedule, faithful_units_by_lang, consecutive_windows)}
