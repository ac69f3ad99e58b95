"""Control tables, splits, joins by range and checks of ledgers, packing and schedules."""

from __future__ import annotations

from textmill.operators.corpus import LANE, label_histogram
from textmill.operators.text import words

#: Shares of the four stages of a schedule and the floors of three lanes, as SQL relations.
STAGES = "(select 0 as stage, cast(0.40 as double) as share union all select 1, 0.30 union all select 2, 0.15 union all select 3, 0.15)"
FLOORS = "(select 'indic' as lane, cast(0.08 as double) as floor_share union all select 'reasoning', 0.03 union all select 'agentic', 0.02)"


def strip_class_counts(d):
    kinds = {"zero_width": "\\x{200B}", "bom": "\\x{FEFF}", "soft_hyphen": "\\x{00AD}", "replacement": "\\x{FFFD}", "bidi": "[\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]", "private_use": "[\\x{E000}-\\x{F8FF}]", "control": "[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}-\\x{9F}]", "kept_joiner": "[\\x{200C}\\x{200D}]"}
    return f"select lang, {', '.join(f'cast(sum({d.count("text", p)}) as bigint) as {k}' for k, p in kinds.items())} from documents group by lang"


def strip_fences(d):
    t = d.replace("text", "(?s)```.*?(?:```|\\z)", "")
    return f"select doc_id, {d.sha(t)} as plain_sha, cast(length(text) - length({t}) as bigint) as removed from documents"


def visible_text(d):
    t = d.replace("text", "[ \\t\\n\\r\\x{0B}\\x{0C}]", "")
    return f"select doc_id, cast(length({t}) as bigint) as visible_chars, {d.sha(t)} as visible_sha from documents"


def short_hash(d):
    return f"select doc_id, substring({d.sha('text')}, 1, 12) as short from documents"


def canary_ids(d):
    return f"select i, substring({d.sha("concat('canary-', cast(i as varchar(20)))")}, 1, 16) as canary from (select {d.series('0', '63')} as i) q"


def min_token_gate(d):
    return f"select d.doc_id, case when l.quality = 0 then 'low_quality' when d.n < 12 then 'too_short' end as reason from (select doc_id, {d.size(words(d, 'text'))} as n from documents) d left join labels l on l.doc_id = d.doc_id where l.quality = 0 or d.n < 12"


def repeated_actors(d):
    return "select user_id, count(*) as n from events group by user_id having count(*) > 1"


def weighted_and_plain_means(d):
    return "with s as (select lang, source, sum(n_chars) as total, count(*) as n from documents group by lang, source) select lang, round(cast(sum(total) as double) / sum(n), 6) as weighted, round(avg(cast(total as double) / n), 6) as mean_of_means from s group by lang"


def rollup_counts(d):
    return "select lang, source, count(*) as docs from documents group by rollup (lang, source)"


def missing_label_errors(d):
    return "select coalesce(d.doc_id, l.doc_id) as doc_id, case when d.doc_id is null then 'no_document' else 'no_label' end as error from documents d full outer join labels l on l.doc_id = d.doc_id where d.doc_id is null or l.doc_id is null"


def length_bands(d):
    """Documents by band of length: the range join as an equi-join on the band that a length falls in."""
    return f"select b.band, b.lo, b.hi, count(d.doc_id) as docs from (select i as band, i * 2000 as lo, i * 2000 + 1999 as hi from (select {d.series('0', '80')} as i) q) b left join documents d on {d.div('d.n_chars', 2000)} = b.band and d.n_chars between b.lo and b.hi group by b.band, b.lo, b.hi"


def slope_change(d):
    x = "cast(event_id as double)"
    mid = "(select (min(event_id) + max(event_id)) / cast(2 as double) from events)"
    return f"select event_type, round(regr_slope(case when {x} < {mid} then value end, {x}), 9) as before, round(regr_slope(case when {x} >= {mid} then value end, {x}), 9) as after from events group by event_type"


def blocked_split(d):
    block = d.div("doc_id", 16)
    return f"with b as (select doc_id, {block} as block from documents), n as (select block, count(*) as n from b group by block) select b.doc_id, b.block, b.block % 12 = 6 and n.n = 16 as held_out from b join n on n.block = b.block"


def first_and_last_means(d):
    return "select user_id, round(avg(case when up <= 10 then value end), 9) as first_mean, round(avg(case when down <= 10 then value end), 9) as last_mean from (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as up, row_number() over (partition by user_id order by ts desc, event_id desc) as down from events) q group by user_id"


def contiguity_check(d):
    return "select conv_id, count(*) as turns, count(distinct turn) as distinct_turns, min(turn) = 0 and max(turn) = count(*) - 1 and count(distinct turn) = count(*) as contiguous from conversations group by conv_id"


def cyclic_position(d):
    return f"select event_id, {d.div('event_id', 48)} as epoch, event_id % 48 as ordinal from events"


def turn_word_jaccard(d):
    w = lambda x: d.distinct(words(d, f"lower({x})"))
    return f"select conv_id, turn, round({d.overlap('a', 'b')} / cast(greatest({d.size('a')} + {d.size('b')} - {d.overlap('a', 'b')}, 1) as double), 6) as jaccard from (select conv_id, turn, {w('text')} as a, {w('prev')} as b from (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as prev from conversations) q where prev is not null) s"


def benchmark_word_sets(d):
    e = lambda t: f"(select distinct w from (select {d.explode(words(d, 'lower(text)'))} as w from {t}) q)"
    return f"with b as {e('benchmark')}, t as {e('conversations')} select 'both' as part, count(*) as n from (select w from b intersect select w from t) x union all select 'benchmark_only', count(*) from (select w from b except select w from t) y union all select 'all', count(*) from (select w from b union select w from t) z"


def run_matrix(d):
    return f"select l.lang, s.seed, m.size from (select distinct lang from documents) l cross join (select {d.series('0', '4')} as seed) s cross join (select {d.series('1', '3')} as size) m"


def repeat_by_weight(d):
    return f"select item_id, repeat_no from (select item_id, {d.series('1', 'item_id % 3 + 1')} as repeat_no from benchmark) q"


def block_causal_counts(d):
    return f"select conv_id, cast(sum({d.div('n * (n + 1)', 2)}) as bigint) as allowed from (select conv_id, turn, cast(length(text) as bigint) as n from conversations) q group by conv_id"


def stage_boundaries(d):
    half_even = "bround(48 * share)" if d.name == "spark" else "round_even(48 * share, 0)"
    return f"select stage, cast(case when stage = 3 then 48 else sum(n) over (order by stage) end as bigint) as stage_end from (select stage, {half_even} as n from {STAGES} s) q"


def floor_token_demand(d):
    return f"select lane, cast(floor(floor_share * 256 * 8 * 48) as bigint) as demand from {FLOORS} f"


def lane_floor_check(d):
    return f"with n as (select {LANE} as lane, count(*) as docs from documents group by 1) select f.lane, coalesce(n.docs, 0) / cast((select sum(docs) from n) as double) + 1e-9 >= f.floor_share as passed from {FLOORS} f left join n on n.lane = f.lane"


def label_share_range(d):
    return f"select lang, min(docs) as fewest, max(docs) as most from ({label_histogram(d)}) h where lang is not null and toxic is not null group by lang"


QUERIES = {f.__name__: f for f in (strip_class_counts, strip_fences, visible_text, short_hash, canary_ids, min_token_gate, repeated_actors, weighted_and_plain_means, rollup_counts, missing_label_errors, length_bands, slope_change, blocked_split, first_and_last_means, contiguity_check, cyclic_position, turn_word_jaccard, benchmark_word_sets, run_matrix, repeat_by_weight, block_causal_counts, stage_boundaries, floor_token_demand, lane_floor_check, label_share_range)}
