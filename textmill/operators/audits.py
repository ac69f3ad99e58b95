"""Mixture plans, trajectories, records, statistics of runs and token streams: checks and reports as relations.

Tables that the data folder lacks (plans, trajectories, run results) are small relations of values; each query takes its
relation as a parameter.
"""

from __future__ import annotations

from textmill.operators.models import T975
from textmill.operators.text import VISIBLE, words

I = lambda x: f"cast({x} as bigint)"  # noqa: E731, E741
F = lambda x: f"cast({x} as double)"
_Q = "''"

#: Values of a plan: stage, billions of tokens, whether it anneals, and the percent of each lane.
STAGES = "('A', 12000, false, 40, 18, 16, 26), ('B', 3000, false, 18, 30, 8, 44), ('C', 600, false, 10, 15, 8, 67), ('D', 400, true, 10, 25, 15, 50)"
#: Values of a plan: lane, unique billions, epochs allowed, synthetic and reserved billions, anneal synthetic, pool, floor.
SUPPLY = "('web', 5500, 4, 0, 100, 0, 100, null), ('code', 1500, 4, 0, 60, 40, 100, null), ('indic', 385, 4, 1520, 15, 45, 60, 8), ('other', 3065, 2, 1950, 32, 148, 180, 3)"
#: Values of a plan: tier, total and synthetic billions, unique billions (null: built), epochs allowed, share allowed.
TIERS = "('verified', 900, 0, 250, 4, null), ('unverified', 500, 0, 135, 4, null), ('translated', 700, 700, null, 1, 0.35), ('romanised', 168, 168, null, 1, null)"
#: Values of bands of reasoning length: number, first and last token, percent by stage.
BANDS = "(0, 1, 500, 20, 25), (1, 501, 2000, 30, 25), (2, 2001, 8000, 25, 25), (3, 8001, 32000, 15, 15), (4, 32001, 131072, 10, 10)"
#: Messages of trajectories: id, place, role, text, call id (assistant) or answered id (tool), signature of the call.
MESSAGES = """('t1', 0, 'system', 'be brief', null, null), ('t1', 1, 'user', 'fix the bug', null, null), ('t1', 2, 'assistant', 'look', 'c1', 'ls'), ('t1', 3, 'tool', 'files', 'c1', null), ('t1', 4, 'assistant', 'edit', 'c2', 'ed'), ('t1', 5, 'tool', 'Traceback (most recent call last)', 'c2', null), ('t1', 6, 'assistant', 'done', 'c3', 'submit'),
('t2', 0, 'system', 's', null, null), ('t2', 1, 'user', 'loop', null, null), ('t2', 2, 'assistant', 'a', 'c1', 'ls'), ('t2', 3, 'assistant', 'a', 'c2', 'ls'), ('t2', 4, 'assistant', 'plain', null, null), ('t2', 5, 'assistant', 'a', 'c3', 'ls'), ('t2', 6, 'assistant', 'a', 'c4', 'ls'),
('t3', 0, 'user', 'no system', null, null), ('t3', 1, 'assistant', 'x', 'c1', 'ls'), ('t3', 2, 'tool', 'y', 'c9', null), ('t3', 3, 'assistant', 'no call', null, null),
('t4', 0, 'system', 's', null, null), ('t4', 1, 'robot', 'who', null, null), ('t4', 2, 'assistant', 'x', 'c1', 'submit')"""
#: Trajectories: id, instance, solved, patch.
RUNS = "('t1', 'django-money__django-money.835c1ab8.func', true, 'diff'), ('t2', 'psf__requests.1234.x', true, 'diff'), ('t3', 'plain.9', false, ''), ('t4', 'psf__requests.99.y', true, ' ')"
#: Results of a sweep: arm, seed, logarithm of the rate, loss.
SWEEP = "('adam', 1, -12, 3.10), ('adam', 1, -11, 2.90), ('adam', 1, -10, 2.95), ('adam', 1, -9, 3.40), ('sgd', 1, -8, 3.30), ('sgd', 1, -7, 3.05), ('sgd', 1, -6, 3.00), ('lion', 1, -13, 3.2), ('lion', 1, -12, 3.0), ('lion', 1, -11, 3.1)"
#: Confirmation runs: arm, seed, loss, configuration.
CONFIRMED = "('adam', 1, 2.88, 'k1'), ('adam', 2, 2.90, 'k1'), ('adam', 3, 2.89, 'k1'), ('sgd', 1, 2.99, 'k1'), ('sgd', 2, 3.01, 'k1'), ('lion', 1, 2.99, 'k1'), ('lion', 2, 2.97, 'k1'), ('lamb', 1, 2.5, 'k2')"
#: Records of a timeline: id, kind, date, era, source, paper.
RECORDS = "('r1', 'core', '2017-06-12', 1, 'https://arxiv.org/abs/1706.03762', '1706.03762'), ('r2', 'side', '2019-13-01', 1, 'https://example.org/x', null), ('r3', 'other', '2020-05-28', 9, 'ftp://x', '20.1'), ('r4', 'core', '2021-02-30x', 2, null, '2101.00001')"


def _plan(d):
    lanes = ("web", "code", "indic", "other")
    return f"st as {d.values(STAGES, 'stage, tokens, anneal, web, code, indic, other')}, sh as ({' union all '.join(f"select stage, {F('tokens')} as tokens, anneal, '{x}' as lane, {F(x)} as pct from st" for x in lanes)}), su as {d.values(SUPPLY, 'lane, uniq, cap, synth, reserved, anneal_synth, pool, floor_pct')}, ti as {d.values(TIERS, 'tier, total, synth, uniq, cap, cap_share')}, ba as {d.values(BANDS, 'band, lo, hi, a, b')}, al as (select lane, sum(case when anneal then 0 else tokens * pct / 100 end) as main, sum(case when anneal then tokens * pct / 100 else 0 end) as anneal from sh group by lane)"


def plan_shares(d):
    """The plan's nested shares as long rows."""
    return f"with {_plan(d)} select stage, lane, anneal, tokens, pct, tokens * pct / 100 as billions from sh"


def lane_allocation(d):
    return f"with {_plan(d)} select lane, round(main, 6) as main, round(anneal, 6) as anneal from al"


def plan_totals(d):
    return f"with {_plan(d)} select anneal, {I('sum(tokens)')} as tokens, count(*) as stages, (select {I('sum(pool)')} from su) as reserve from st group by anneal"


def supply_checks(d):
    """Each lane's main allocation against what it has, the epochs that implies, and its floor in every stage."""
    return f"""with {_plan(d)}, fl as (select sh.lane, min(sh.pct) as least from sh group by sh.lane)
select su.lane, al.main <= (su.uniq - su.reserved) * su.cap + su.synth + 0.01 as supplied, round(greatest(0, al.main - su.synth) / greatest(0.001, su.uniq - su.reserved), 6) as epochs, greatest(0, al.main - su.synth) / greatest(0.001, su.uniq - su.reserved) > su.cap as beyond, fl.least + 1e-9 >= coalesce(su.floor_pct, 0) as floor_kept, al.anneal <= su.pool + 0.01 as pool_kept, su.pool <= su.reserved + su.anneal_synth + 0.01 as pool_backed from su join al on al.lane = su.lane join fl on fl.lane = su.lane"""


def tier_checks(d):
    total = "(select main + anneal from al where lane = 'indic')"
    return f"""with {_plan(d)} select tier, case when cap_share is not null then total <= cap_share * {total} + 0.01 end as share_kept, case when uniq is not null then (total - synth) / {F('uniq')} <= cap + 0.05 else synth + 0.01 >= total end as epochs_kept, (select abs(sum(total) - {total}) <= greatest(1.0, 0.01 * {total}) from ti) as sums_up from ti"""


def band_contiguity(d):
    """Bands follow each other without gaps from 1, and their shares sum to a hundred."""
    return f"with {_plan(d)} select band, lo = coalesce(lag(hi) over (order by band), 0) + 1 and lo <= hi as contiguous, (select sum(a) = 100 and sum(b) = 100 from ba) as whole from ba"


def mixture_audit(d):
    """All checks of a plan as rows: key, passed."""
    return f"""with {_plan(d)}
select 'shares_' || stage as key, abs(sum(pct) - 100) <= 0.01 as passed from sh group by stage
union all select 'budget', abs(sum(tokens) - 16000) <= 0.01 from st
union all select 'supply_' || su.lane, al.main <= (su.uniq - su.reserved) * su.cap + su.synth + 0.01 from su join al on al.lane = su.lane
union all select 'floor_' || su.lane, min(sh.pct) + 1e-9 >= max(su.floor_pct) from su join sh on sh.lane = su.lane where su.floor_pct is not null group by su.lane
union all select 'reserve', (select sum(tokens) from st where anneal) <= (select sum(pool) from su) + 0.01
union all select 'known_lanes', not exists (select 1 from sh where lane not in (select lane from su)) and not exists (select 1 from su where lane not in (select lane from sh))
union all select 'bands', max(hi) = 131072 and min(lo) = 1 from ba"""


def _runs(d):
    return f"m as {d.values(MESSAGES, 'traj, pos, role, text, call_id, sig')}, r as {d.values(RUNS, 'traj, instance_id, resolved, patch')}"


def trajectory_schema(d):
    """Schema errors of trajectories: no leading system turn, unknown roles, answers to calls that the latest assistant turn did not make."""
    return f"""with {_runs(d)}, a as (select m.*, max(case when role = 'assistant' then pos end) over (partition by traj order by pos) as latest from m)
select a.traj, {I("sum(case when a.pos = 0 and a.role <> 'system' then 1 else 0 end)")} as no_system, {I("sum(case when a.role not in ('system', 'user', 'assistant', 'tool') then 1 else 0 end)")} as unknown_roles, {I("sum(case when a.role = 'tool' and (c.call_id is null or c.call_id <> a.call_id) then 1 else 0 end)")} as stray_answers
from a left join m c on c.traj = a.traj and c.pos = a.latest group by a.traj"""


def trajectory_gates(d):
    """Failed gates of each trajectory: not solved, no final call, fewer than two call turns, four equal calls in a row, no patch."""
    return f"""with {_runs(d)}, calls as (select traj, pos, sig, row_number() over (partition by traj order by pos) - row_number() over (partition by traj, sig order by pos) as island from m where role = 'assistant' and sig is not null),
loops as (select traj, max(n) as longest from (select traj, sig, island, count(*) as n from calls group by traj, sig, island) x group by traj),
ends as (select traj, role, sig from (select traj, role, sig, row_number() over (partition by traj order by pos desc) as rn from m) y where rn = 1), turns as (select traj, count(*) as n from calls group by traj)
select r.traj, not r.resolved as not_solved, not (ends.role = 'assistant' and ends.sig is not null) as no_final_call, coalesce(turns.n, 0) < 2 as single_call, coalesce(loops.longest, 0) >= 4 as looping, trim(r.patch) = '' as no_patch from r join ends on ends.traj = r.traj left join turns on turns.traj = r.traj left join loops on loops.traj = r.traj"""


def trajectory_statistics(d):
    """Per trajectory, and over all: assistant turns, calls, share of observations with errors, by decade of turns (50 at most)."""
    one = f"select traj, {I("sum(case when role = 'assistant' then 1 else 0 end)")} as turns, {I('sum(case when sig is not null then 1 else 0 end)')} as calls, {I("sum(case when role = 'tool' then 1 else 0 end)")} as seen, {I(f"sum(case when role = 'tool' and {d.matches('text', 'Traceback|Error|error:')} then 1 else 0 end)")} as errors from m group by traj"
    return f"with {_runs(d)}, one as ({one}) select least({d.div('turns', 10)} * 10, 50) as decade, count(*) as trajectories, round(avg(turns), 6) as mean_turns, {I('sum(calls)')} as calls, round(sum(errors) / {F('greatest(sum(seen), 1)')}, 6) as error_share from one group by 1"


def trajectory_transcript(d):
    """Canonical transcript of a trajectory, its repository, its task and the digest of task and patch."""
    seg = "'<' || role || '>' || chr(10) || text || coalesce(chr(10) || '<tool_call>' || sig, '')"
    head = "split_part(instance_id, '.', 1)"
    return f"""with {_runs(d)}, t as (select traj, {d.concat_ordered(seg, 'chr(10)', 'pos')} as body, max(case when role = 'user' then text end) as task from m group by traj)
select t.traj, {d.sha('t.body')} as transcript_sha, case when strpos({head}, '__') > 0 then substring({head}, strpos({head}, '__') + 2) else {head} end as repo, t.task, {d.sha("concat(coalesce(t.task, ''), chr(10), r.patch)")} as task_key, replace(case when strpos({head}, '__') > 0 then substring({head}, strpos({head}, '__') + 2) else {head} end, '-', '_') in ('requests', 'django', 'flask') as eval_repo from t join r on r.traj = t.traj""".replace("strpos(", "instr(" if d.name == "spark" else "strpos(")


def network_task_flag(d):
    """Trajectories and conversations whose user text speaks of addresses of the network."""
    return f"select conv_id, max(case when role = 'user' and {d.matches('lower(text)', '(^|[^a-z])(ip|ipv4|ipv6|subnet|cidr)([^a-z]|$)')} then 1 else 0 end) as ip_task from conversations group by conv_id"


def thought_equals_content(d):
    return f"select count(*) as turns, {I('sum(case when text = prev then 1 else 0 end)')} as repeated from (select text, lag(text) over (partition by conv_id order by turn) as prev, role from conversations) q where role = 'assistant'"


def tag_extraction(d):
    """Reasoning and solution of answers with tags, what is left without them, missing tags with the head of the text, and tags that remain."""
    rows = "('a1', '<|begin_of_thought|> think <|end_of_thought|> <|begin_of_solution|> 42 <|end_of_solution|>'), ('a2', 'plain answer'), ('a3', '<|begin_of_thought|> only thought <|end_of_thought|> rest <|begin_of_solution|>'), ('a4', '<|begin_of_solution|>s1<|end_of_solution|><think>x</think> Human: hi')"
    thought, solution, tag = "(?s)<\\|begin_of_thought\\|>(.*?)<\\|end_of_thought\\|>", "(?s)<\\|begin_of_solution\\|>(.*?)<\\|end_of_solution\\|>", "<\\|(?:begin|end)_of_(?:thought|solution)\\|>"
    clean = lambda x: f"trim({d.replace(x, tag, '')})"
    answer = f"case when {d.matches('t', solution)} then {clean(d.extract('t', solution))} else {clean(d.replace('t', thought, ''))} end"
    return f"select id, {clean(d.extract('t', thought))} as reasoning, {answer} as answer, not {d.matches('t', solution)} as no_solution, not {d.matches('t', thought)} as no_thought, {I(d.count('t', tag))} as tags, {I(d.count(answer, tag))} as left_over, {I(d.count('t', '</?think>|<.im_start.>|\\[INST\\]|### Response:'))} as markers, {I(d.count('t', '(?m)(^|> )(Human|Assistant):'))} as roles, left(replace(t, chr(10), ' '), 40) as head from {d.values(rows, 'id, t')}"


def flattened_blocks(d):
    """Content given as text or as a list of blocks, as one text: the text blocks joined by line feeds."""
    return f"select conv_id, {d.sha(d.join(d.keep(d.ordered_list("case when role <> 'system' then text end", 'turn'), 'b', 'b is not null'), '|'))} as flat_sha from conversations group by conv_id"


def canonical_records(d):
    """Records as JSON with sorted keys and no blanks, and their digest."""
    j = """concat('{"kind":"', event_type, '","user":', cast(user_id as varchar(20)), ',"value":', cast(cast(round(value * 100) as bigint) as varchar(20)), '}')"""
    return f"select event_id, {d.sha(j)} as record_sha from events"


def json_parsing(d):
    """JSON text parsed: rows that hold the key, and rows that do not parse, by kind of event."""
    good = f"{d.matches('props', '^[{].*[}]$')}"
    return f"select event_type, count(*) as n, {I(f'sum(case when {good} then 0 else 1 end)')} as failed, {I('sum(cast(' + d.extract('props', '\"k\": *([0-9]+)') + ' as bigint))')} as total from events group by event_type"


def record_validation(d):
    """Violations of records: unknown kinds, dates that are none, sources without a web address, malformed papers, eras out of range."""
    rules = {"kind": "kind not in ('core', 'side')", "date": f"not {d.matches('date', '^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$')}", "source": f"source is null or not {d.matches(f'coalesce(source, {_Q})', '^https?://')}", "paper": f"paper is not null and not {d.matches(f'coalesce(paper, {_Q})', '^[0-9]{4}[.][0-9]{4,5}$')}", "era": "era not between 0 and 8"}
    return f"with r as {d.values(RECORDS, 'id, kind, date, era, source, paper')} " + " union all ".join(f"select id, '{k}' as field from r where {c}" for k, c in rules.items())


def required_ids(d):
    """Ids that one side has and the other lacks, both ways, and whether the sets are equal."""
    return "with a as (select distinct doc_id from documents), b as (select distinct doc_id from labels) select 'unlabelled' as side, count(*) as ids, count(*) = 0 as subset from (select doc_id from a except select doc_id from b) x union all select 'unknown', count(*), count(*) = 0 from (select doc_id from b except select doc_id from a) y"


def chronological(d):
    """Records in total order (date, then kind, then id) with their number, and the first three of each kind."""
    return "select user_id, event_type, event_id, ordinal, first_three from (select user_id, event_type, event_id, row_number() over (partition by user_id order by ts, event_type, event_id) as ordinal, row_number() over (partition by user_id, event_type order by ts, event_id) <= 3 as first_three from events) q where user_id % 10 = 0"


def length_batches(d):
    """Documents in order of length, dealt to batches of 16, with the padding each batch costs."""
    return f"select band, batch, count(*) as docs, {I('max(n_chars) * count(*) - sum(n_chars)')} as padding from (select {d.div('n_chars', 512)} as band, n_chars, {d.div(f'row_number() over (partition by {d.div("n_chars", 512)} order by n_chars, doc_id) - 1', 16)} as batch from documents) q group by band, batch"


def regression_interval(d):
    """Slope, intercept, standard error, prediction at event 20,000 and its 95 % half-width, t interpolated between tabulated degrees."""
    x, y = F("event_id % 40"), "value"
    t = f"t as {d.values(T975, 'dof, t')}"
    return f"""with {t}, s as (select event_type, {F('count(*)')} as n, avg({x}) as mx, avg({y}) as my, regr_sxx({y}, {x}) as sxx, regr_sxy({y}, {x}) as sxy, regr_syy({y}, {x}) as syy from events where event_id < 100 group by event_type),
f as (select *, sxy / sxx as slope, sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2)) as sigma, {I('n - 2')} as dof from s where n > 2),
q as (select f.*, (select max(dof) from t where t.dof <= f.dof) as lo, (select min(dof) from t where t.dof >= f.dof) as hi from f)
select q.event_type, round(slope, 6) as slope, round(my - slope * mx, 6) as intercept, round(sigma / sqrt(sxx), 6) as se, round(my + slope * (50 - mx), 6) as predicted, round(coalesce(a.t + case when b.dof = a.dof then 0 else (b.t - a.t) * (q.dof - a.dof) / (b.dof - a.dof) end, 1.96e0) * sigma * sqrt(1 + 1 / n + (50 - mx) * (50 - mx) / sxx), 6) as half_width from q left join t a on a.dof = q.lo left join t b on b.dof = q.hi""".replace("(select max(dof) from t where t.dof <= f.dof)", "(select max(t.dof) from t where t.dof <= f.dof)").replace("(select min(dof) from t where t.dof >= f.dof)", "(select min(t.dof) from t where t.dof >= f.dof)")


def sweep_vertices(d):
    """Best rate of each arm: the vertex of the parabola through the best point and its neighbours; the point itself on an edge."""
    return f"""with s as {d.values(SWEEP, 'arm, seed, lr, loss')}, n as (select arm, {F('lr')} as x1, {F('loss')} as y1, {F('lag(lr) over (partition by arm order by lr)')} as x0, {F('lag(loss) over (partition by arm order by lr)')} as y0, {F('lead(lr) over (partition by arm order by lr)')} as x2, {F('lead(loss) over (partition by arm order by lr)')} as y2, row_number() over (partition by arm order by loss, lr) as rn from s),
b as (select *, (x2 * (y1 - y0) + x1 * (y0 - y2) + x0 * (y2 - y1)) / ((x0 - x1) * (x0 - x2) * (x1 - x2)) as a, (x2 * x2 * (y0 - y1) + x1 * x1 * (y2 - y0) + x0 * x0 * (y1 - y2)) / ((x0 - x1) * (x0 - x2) * (x1 - x2)) as b from n where rn = 1)
select arm, x0 is null or x2 is null as on_edge, round(case when a > 0 then -b / (2 * a) else x1 end, 6) as best from b"""


def fair_comparison(d):
    """Verdict on each pair of arms: refused where configurations differ, ranges overlap or the gap is within the larger range."""
    return f"""with c as {d.values(CONFIRMED, 'arm, seed, loss, config')}, g as (select arm, min(config) as config, {F('avg(loss)')} as mean, {F('min(loss)')} as lo, {F('max(loss)')} as hi from c group by arm)
select a.arm as a, b.arm as b, round(b.mean - a.mean, 6) as gap, round(greatest(a.hi - a.lo, b.hi - b.lo), 6) as pooled, case when a.config <> b.config then 'differ' when not (a.hi < b.lo or b.hi < a.lo) or abs(b.mean - a.mean) <= greatest(a.hi - a.lo, b.hi - b.lo) then 'noise' when b.mean > a.mean then 'a' else 'b' end as verdict from g a join g b on a.arm < b.arm"""


def missing_runs(d):
    """Planned runs whose digest of configuration has no result yet."""
    key = d.sha("concat_ws('|', lang, source)")
    return f"select lang, source, substring({key}, 1, 16) as run_key from (select distinct lang, source from documents) p where not exists (select 1 from (select distinct lang as l, source as s from documents where doc_id % 3 = 0) r where r.l = p.lang and r.s = p.source)"


def run_matrix_summary(d):
    """Mean, deviation and values of results by arm over seeds, each metric a row, and whether the arms share a configuration."""
    return f"""with c as {d.values(CONFIRMED, 'arm, seed, loss, config')}, u as (select arm, seed, 'loss' as metric, {F('loss')} as v, config from c union all select arm, seed, 'perplexity', exp({F('loss')}), config from c)
select arm, metric, count(*) as runs, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as deviation, {d.join(d.each(d.ordered_list('round(v, 3)', 'seed'), 'x', 'cast(x as varchar(20))'), ' ')} as listed, count(distinct config) = 1 as one_config from u group by arm, metric"""


def error_rates(d):
    """Errors of quantity guesses by flag, by mode and over all: exact, mean absolute, within a tenth."""
    g = f"round({F('l_extendedprice')} / 1500)"
    return f"select l_returnflag, l_linestatus, count(*) as n, round(avg(case when {g} = l_quantity then 1.0e0 else 0 end), 6) as exact, round(avg(abs({g} - l_quantity)), 6) as mean_error, round(avg(case when abs({g} - l_quantity) <= 0.1 * l_quantity then 1.0e0 else 0 end), 6) as within from lineitem group by grouping sets ((), (l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))"


def masked_means(d):
    """Mean loss over the places that count, against the mean over all places, and the factor between them."""
    m = "case when role = 'assistant' then 1 else 0 end"
    return f"select conv_id, round(sum({m} * length(text)) / {F(f'greatest(sum({m}), 1)')}, 6) as masked_mean, round(sum({m} * length(text)) / {F('count(*)')}, 6) as wrong_mean, round(sum({m}) / {F('count(*)')}, 6) as factor from conversations group by conv_id"


def lane_losses(d):
    """Loss sums, tokens, means and distinct sources by language and shard of sixteen documents."""
    return f"select lang, {d.div('doc_id', 64)} as shard, {I('sum(n_chars)')} as tokens, round(sum(n_chars * 0.5e0) / greatest(sum(n_chars), 1), 6) as mean, count(distinct source) as sources from documents group by lang, {d.div('doc_id', 64)}"


def gram_hit_rate(d):
    """Share of the four-word sequences of benchmark items that documents with an even id hold, by item."""
    g = lambda t, k: f"select distinct {k}, {d.join(d.slice('w', 'i', '4'), ' ')} as gram from (select {k}, w, {d.series('1', d.size('w') + ' - 3')} as i from (select {k}, {words(d, 'lower(text)')} as w from {t}) a where {d.size('w')} >= 4) b"
    return f"with b as ({g('benchmark', 'item_id')}), s as (select distinct t.gram from ({g('documents', 'doc_id')}) t where t.doc_id % 2 = 0 and t.gram in (select gram from b)) select b.item_id, count(*) as grams, round(count(s.gram) / {F('count(*)')}, 6) as hit_rate from b left join s on s.gram = b.gram group by b.item_id"


def performance_counters(d):
    """Rates from merged counters by phase: sums over steps, tokens a second, null where no time passed."""
    return f"select event_type as phase, count(*) as steps, round(sum(value), 4) as seconds, {I('sum(event_id % 512)')} as tokens, round(sum(event_id % 512) / nullif(sum(value), 0), 4) as tokens_per_second from events group by event_type"


def rolled_back_counters(d):
    """Counters accumulated over steps, without those after the last checkpoint of an interrupted run."""
    return f"select event_type, {I('sum(event_id % 512)')} as tokens, count(*) as steps, max(event_id) as last_step from events where event_id < {d.div('(select max(event_id) from events)', 100)} * 100 group by event_type"


def collective_counts(d):
    """Collectives of the first step: calls and bytes by kind."""
    return f"select l_returnflag as kind, count(*) as calls, {I('sum(l_quantity * 8)')} as bytes from lineitem where l_orderkey < 100 group by l_returnflag"


def peak_memory(d):
    """The rank with the most memory by component: sums over parts, largest over ranks, ties to the smallest."""
    return f"select part, rank, bytes from (select l_returnflag as part, l_suppkey % 8 as rank, {I('sum(l_quantity)')} as bytes, row_number() over (partition by l_returnflag order by sum(l_quantity) desc, l_suppkey % 8) as rn from lineitem group by l_returnflag, l_suppkey % 8) q where rn = 1"


def memory_model(d):
    """Bytes as a linear function of the batch, and the largest batch that fits a bound."""
    return f"select event_type, round(regr_slope(value, {F('event_id % 64')}), 9) as per_unit, round(regr_intercept(value, {F('event_id % 64')}), 6) as fixed, {I(f'floor((1000 - regr_intercept(value, {F("event_id % 64")})) / nullif(abs(regr_slope(value, {F("event_id % 64")})), 0))')} as largest from events group by event_type"


def admission_summary(d):
    """Events by decision and reason, and documents by their last decision."""
    e = f"select doc_id, 1 as pass, case when n_chars > 3000 then 'DEFER' when n_chars < 60 then 'REJECT' else 'ACCEPT' end as decision from documents union all select doc_id, 2, case when n_chars > 6000 then 'DEFER' else 'ACCEPT' end from documents where n_chars > 3000"
    return f"with e as ({e}) select 'events' as kind, decision, count(*) as n from e group by decision union all select 'final', decision, count(*) from (select doc_id, decision, row_number() over (partition by doc_id order by pass desc) as rn from e) f where rn = 1 group by decision"


def sustained_damage(d):
    """First event of each user's run of two or more whose value exceeds the median of the 30 before by 20, after eight."""
    from textmill.operators.corpus import trailing_median

    return f"""with m as (select user_id, event_id, rn, coalesce(value > med + 20, false) and rn > 8 as high from ({trailing_median(d)}) q), i as (select user_id, event_id, rn, rn - row_number() over (partition by user_id order by rn) as island from m where high)
select user_id, min(first_event) as first_event from (select user_id, island, min(event_id) as first_event from i group by user_id, island having count(*) >= 2) x group by user_id"""


def blind_peak(d):
    """The step of each user with the highest median of five around it, ignoring the first four; ties to the first."""
    mid = "over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following)"
    med = f"element_at(array_sort(collect_list(value) {mid}), cast(floor(size(collect_list(value) {mid}) / 2) as int) + 1)" if d.name == "spark" else f"list_sort(list(value) {mid})[len(list(value) {mid}) // 2 + 1]"
    return f"select user_id, rn as peak from (select user_id, rn, row_number() over (partition by user_id order by med desc, rn) as best from (select user_id, {med} as med, row_number() over (partition by user_id order by ts, event_id) as rn from events) q where rn > 4) b where best = 1"


def log_slope_change(d):
    """Slope of the logarithm of a user's values over the ten steps up to the 12th minus that over the ten after."""
    return f"select user_id, round(regr_slope(case when rn between 3 and 12 then lg end, {F('rn')}) - regr_slope(case when rn between 13 and 22 then lg end, {F('rn')}), 6) as change from (select user_id, case when value > 0 then ln(value) end as lg, row_number() over (partition by user_id order by ts, event_id) as rn from events) q where user_id % 7 = 0 group by user_id"


def stream_segments(d):
    """Segments and positions of a token stream with start marks, and the places that carry loss: not before a start."""
    return f"""with s as (select conv_id, turn, role = 'user' as bos, row_number() over (partition by conv_id order by turn) as place from conversations)
select conv_id, turn, {I('sum(case when bos then 1 else 0 end) over (partition by conv_id order by place)')} as segment, place - coalesce(max(case when bos then place end) over (partition by conv_id order by place), 1) as position, not coalesce(lead(bos) over (partition by conv_id order by place), true) as loss from s"""


def shift_audit(d):
    """Rates at which a target equals the place before, its own and the next, and whether the targets are shifted by one."""
    return f"select user_id, round(avg(case when target = event_type then 1.0e0 else 0 end), 6) as same, round(avg(case when target = after then 1.0e0 else 0 end), 6) as next, round(avg(case when target = before then 1.0e0 else 0 end), 6) as previous, avg(case when target = after then 1.0e0 else 0 end) >= 0.99 as shifted from (select user_id, event_type, after as target, after, before from (select user_id, event_type, lead(event_type) over (partition by user_id order by ts, event_id) as after, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) q where after is not null and before is not null) r group by user_id"


def byte_tokens(d):
    """Byte-level ids of snippets: four reserved ids, then bytes; and the text read back from them."""
    if d.name == "spark":
        ids = "transform(sequence(1, octet_length(t)), i -> cast(conv(substring(hex(t), 2 * i - 1, 2), 16, 10) as int) + 4)"
        return f"select doc_id, size(ids) as n, sha2(array_join(ids, ','), 256) as ids_sha, decode(unhex(array_join(transform(ids, i -> lpad(hex(i - 4), 2, '0')), '')), 'utf-8') as back from (select doc_id, {ids} as ids from (select doc_id, left(text, 60) as t from documents where length(text) > 0) q) r"
    return "select doc_id, len(ids)::int as n, sha256(array_to_string(ids, ',')) as ids_sha, t as back from (select doc_id, t, list_transform(range(octet_length(encode(t))), lambda byte_no: ('0x' || substring(hex(encode(t)), 2 * byte_no + 1, 2))::int + 4) as ids from (select doc_id, left(text, 60) as t from documents where length(text) > 0) q) r"


def frozen_identity(d):
    """Digest of a frozen vocabulary: its words by rank; a second freeze with the same content keeps it."""
    v = f"select w, row_number() over (order by n desc, w) as rk from (select w, count(*) as n from (select {d.explode(words(d, 'lower(text)'))} as w from benchmark) q group by w) c"
    return f"with v as ({v}) select count(*) as entries, {d.sha(d.join(d.ordered_list('w', 'rk'), '|'))} as identity from v"


def first_rows(d):
    """The first rows of a table in the order of its key."""
    return "select doc_id, lang, source, n_chars from (select doc_id, lang, source, n_chars, row_number() over (order by doc_id) as rn from (select * from documents where doc_id < 100) f) q where rn <= 25"


def telugu_share(d):
    """Share of Telugu letters among letters, and the language gate that rests on shares of letters."""
    letters = d.count("text", "\\p{L}")
    return f"select doc_id, round({d.count('text', '[\\x{0C05}-\\x{0C39}\\x{0C3D}\\x{0C58}-\\x{0C5D}\\x{0C60}\\x{0C61}]')} / {F(f'greatest(1, {letters})')}, 6) as telugu, lang <> 'en' and {d.count('text', '[A-Za-z]')} / {F(f'greatest(1, {letters})')} < 0.5 as gated from documents"


def detected_language(d):
    """Language of documents by stop words of four languages (und without any), against the language they claim."""
    lists = {"en": ("the", "and", "of", "to"), "de": ("der", "die", "und", "das"), "fr": ("le", "la", "et", "les"), "es": ("el", "los", "y", "que")}
    hits = ", ".join(f"{d.size(d.keep('w', 'x', f"x in ({', '.join(repr(s) for s in v)})"))} as {k}" for k, v in lists.items())
    top = "greatest(en, de, fr, es)"
    pick = f"case when {top} = 0 then 'und' when en = {top} then 'en' when de = {top} then 'de' when fr = {top} then 'fr' else 'es' end"
    return f"select detected, lang as claimed, count(*) as docs, detected in ('en', 'de', 'fr', 'es', 'und') as known_code from (select lang, {pick} as detected from (select lang, {hits} from (select lang, {words(d, 'lower(text)')} as w from documents) a) b) c group by detected, lang"


QUERIES = {f.__name__: f for f in (plan_shares, lane_allocation, plan_totals, supply_checks, tier_checks, band_contiguity, mixture_audit, trajectory_schema, trajectory_gates, trajectory_statistics, trajectory_transcript, network_task_flag, thought_equals_content, tag_extraction, flattened_blocks, canonical_records, json_parsing, record_validation, required_ids, chronological, length_batches, regression_interval, sweep_vertices, fair_comparison, missing_runs, run_matrix_summary, error_rates, masked_means, lane_losses, gram_hit_rate, performance_counters, rolled_back_counters, collective_counts, peak_memory, memory_model, admission_summary, sustained_damage, blind_peak, log_slope_change, stream_segments, shift_audit, byte_tokens, frozen_identity, first_rows, telugu_share, detected_language)}
