"""Queries of bad cases, packages and gates, gold sets, clusters and extended metrics, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confera.functions.lexicon import SYNTHETIC
from confera.functions.text import js_round, keyword_overlap
from confera.operators import badcase, calibration, extended, kpi, metrics, outcomes, regression, signals, similarity, store
from confera.plans.evaluate import Evaluation
from confera.plans.registry import query, r, raw_turns, table, unit

_WITH_EVALUATION: list[tuple] = []


def evaluation_query(sql):  # noqa: ANN001, ANN201
    """A query whose SQL begins with all pieces of the evaluation; registered when those are there. sql: text, or a function of their module."""

    def register(f):  # noqa: ANN001, ANN202
        _WITH_EVALUATION.append((sql, f))
        return f

    return register


def register_later() -> None:
    from confera.plans import oracle

    for sql, f in _WITH_EVALUATION:
        query(oracle.chain(*oracle.FULL) + (sql if isinstance(sql, str) else sql(oracle)))(f)


def evaluated(spark, sf_dir) -> Evaluation:
    return Evaluation(raw_turns(spark, sf_dir), SYNTHETIC).keep()


# ---- cases -----------------------------------------------------------------------------------------------------------

_TOPICS = """, dd as (select session_id, seg, own_domain, own_label, sum(hundredths) as total, min(turn_index) as seen from g group by 1, 2, 3, 4),
tp as (select session_id, seg, own_label as topic from (select *, row_number() over (partition by session_id, seg order by total desc, seen) as k from dd) where k = 1),
tr as (select session_id, seg, min(turn_index) as start_turn, max(turn_index) as end_turn, arg_min(content, turn_index) as head, string_agg('[turn ' || turn_index || '] [' || role || '] ' || content, chr(10) order by turn_index) as transcript from x group by 1, 2),
bc as (select cases.*, topic, start_turn, end_turn, head, transcript, session_id || '_topic_' || seg as id, 'generic:' || topic || ':' || array_to_string(tags, '+') as grp from cases join tp using (session_id, seg) join tr using (session_id, seg))"""


def _has(*tags: str) -> str:
    return "(" + " or ".join(f"list_contains(tags, '{t}')" for t in tags) + ")"


@evaluation_query(_TOPICS + f""" select id as topic_segment_id, topic, start_turn, end_turn, grp as duplicate_group, md5(transcript) as transcript,
case when {_has('goal_failed')} then 'goal-missed' when {_has('recovery_failed')} then 'recovery-failed' when {_has('escalation_keyword')} then 'escalation-risk' else 'failure-sign' end || ' at turn ' || start_turn || ': ' || case when length(head) > 24 then left(head, 23) || '…' else head end as title,
case when {_has('goal_failed')} then 'replay-failed-session' when {_has('recovery_failed')} then 'add-repair-sequence' when {_has('question_repeat', 'understanding_barrier')} then 'answer-first' when {_has('escalation_keyword')} then 'add-escalation-fallback' else 'add-to-pool' end as suggested_action from bc""")
def badcase_details(spark, sf_dir):
    """Title, action, group and transcript of every bad case."""
    cases = evaluated(spark, sf_dir).bad_cases
    return cases.select("topic_segment_id", "topic", "start_turn", "end_turn", "duplicate_group", F.md5("transcript").alias("transcript"), "title", "suggested_action")


def _left(table: dict[str, float]) -> str:
    return unit("1.0::double" + "".join(f" - case when {_has(t)} then {w}::double else 0 end" for t, w in table.items()))


@evaluation_query(f", bl as (select session_id, seg, {_left(badcase.OBJECTIVE_PENALTY)} as objective_score, {_left(badcase.SUBJECTIVE_PENALTY)} as subjective_score from cases) select session_id, seg as topic_segment_index, objective_score, subjective_score, {unit('(objective_score + subjective_score) / 2')} as case_score from bl")
def baseline_scores(spark, sf_dir):
    return badcase.baseline_scores(evaluated(spark, sf_dir).bad_cases).select("session_id", "topic_segment_index", "objective_score", "subjective_score", "case_score")


@evaluation_query(""", sp as (select *, coalesce(rt, least(ft + 2, (select max(turn_index) from x where x.session_id = rv.session_id))) as till from rv where ft is not null),
ke as (select x.session_id, x.turn_index, x.role, x.content, row_number() over (partition by x.session_id order by x.turn_index) as k from x join sp using (session_id) where x.turn_index between greatest(1, ft - 1) and till)
select session_id, turn_index, role, case when length(content) > 120 then left(content, 120) || '…' else content end as content from ke where k <= 5""")
def trace_evidence(spark, sf_dir):
    """The turns around each failure."""
    e = evaluated(spark, sf_dir)
    return outcomes.trace_evidence(e.enriched, e.recoveries)


@query("""with t as (select conv_id::varchar as session_id, (turn + 1)::int as turn_index, role, text from conversations), e as (select distinct session_id, substr(text, 5) as said from t),
m as (select e.*, t.turn_index, t.role, t.text, row_number() over (partition by e.session_id, said order by t.turn_index) as k from e join t using (session_id) where contains(said, case when length(text) > 20 then left(text, 20) || '…' else text end) or contains(text, said))
select session_id, said, turn_index, role, text as content from m where k = 1""")
def matched_evidence(spark, sf_dir):
    """Quotations, of every turn from its fifth character on, and the first turn that each may come from."""
    turns = raw_turns(spark, sf_dir)
    said = turns.select("session_id", F.substr("content", F.lit(5)).alias("said")).distinct()
    return badcase.match_evidence(said, turns)


@evaluation_query(f""", w as (select (select {r('coalesce(avg(emotion), 0)', 1)} from x) as em, (select count(*) from x where emotion <= 40) as low, (select count(*) from x where is_switch) as sw, (select count(*) from x where is_question and role = 'user') as qs,
    (select floor(coalesce(avg((status = 'achieved')::int), 0) * 100 + 0.5)::int from goals) as gp, (select count(*) from goals where status = 'failed') as fg, (select count(*) from rv where status = 'completed') as rc, (select count(*) from rv where status = 'failed') as rf,
    (select severity from s where signal_key = 'interest_decline') as il, (select severity from s where signal_key = 'understanding_barrier') as ub, (select severity from s where signal_key = 'recovery_failure') as er, (select score from d where dimension = 'empathy') as ep, (select floor(avg_response_gap_sec + 0.5)::int from o) as gap),
l as (select [em::varchar || '|' || low, gp || '|' || fg, gap::varchar, sw::varchar, qs || '|' || ub, rc || '|' || rf, il || '|' || er, ep::varchar] as f from w)
select i - 1 as seq, f[i] as facts from (select f, unnest(range(1, 9)) as i from l)""")
def advice(spark, sf_dir):
    """The facts that each line of advice names; the lines themselves are fixed texts around them."""
    e = evaluated(spark, sf_dir)
    facts = metrics.report_facts(e.enriched, e.objective, e.dimensions, e.signals, e.goals, e.recoveries)
    bare = ["|".join(re.findall(r"\{\w+\}", text)) for text in metrics.ADVICE]
    return metrics.suggestions(facts, bare).withColumnRenamed("text", "facts")


_BASE = """rg as (select * from (values {}) v(seq, metric, source, more, thr)), bs as (select seq, metric, source as category, case when value is null then null else {} end as score, thr::double as threshold from rg left join mv using (source, metric))""".format(
    ", ".join(str((k, m, s, int(b), t)) for k, (m, s, b, t) in enumerate(kpi.REGISTRY)), unit("case when more = 1 then value else 1 - value end")
)
_KPI_ORDER = ", ".join(str((len(kpi.REGISTRY) + k, name, ok)) for k, (name, ok, _, _) in enumerate(kpi.CUSTOMER_SUPPORT))
_PROXY = ", ".join(str((len(kpi.REGISTRY) + len(kpi.CUSTOMER_SUPPORT) + k, f"scenario.customer_support.{m}", t, p)) for k, (m, t, p) in enumerate(kpi.SCENARIO_METRICS))
_REGISTRY = f""", {_BASE}, re as (select seq, metric, category, score, threshold from bs union all select v.seq, 'business.' || v.kpi, 'business', kpis.score, v.thr::double from (values {_KPI_ORDER}) v(seq, kpi, thr) left join kpis using (kpi)
    union all select v.seq, v.name, bs.category, bs.score, v.thr::double from (values {_PROXY}) v(seq, name, thr, metric) left join bs using (metric)),
rs as (select seq::int as seq, metric, category, score, threshold, score >= threshold as success from re)"""


def _registry(spark, sf_dir) -> DataFrame:
    e = evaluated(spark, sf_dir)
    return kpi.scenario_registry(e.values, e.kpis)


@evaluation_query(_REGISTRY + " select *, case when success is null then 'skipped' else 'ready' end as status from rs")
def metric_registry(spark, sf_dir):
    """Base metrics, business KPIs and the scenario's own metrics by proxy."""
    return _registry(spark, sf_dir)


@evaluation_query(_REGISTRY + f""", gq as (select {r('coalesce(avg(success::int), 0)', 4)} as pass_rate, count(success) as ready, count(*) - count(success) as skipped, list(metric order by seq) filter (not success and category <> 'synthetic') as fails, bool_or(metric = 'trace_step_efficiency' and success is null) as untraced from rs),
gz as (select *, list_concat(list_concat(case when pass_rate < 0.6 then ['FAILED:pass_rate'] else [] end, list_transform(coalesce(fails, [])[1:3], lambda m: 'WARNING:' || m)), case when untraced then ['INFO:no_trace'] else [] end) as reasons from gq)
select pass_rate, ready, skipped, case when pass_rate < 0.6 then 'failed' when len(reasons) > 0 then 'warning' else 'passed' end as gate, array_to_string(reasons, ',') as reasons from gz""")
def registry_gate(spark, sf_dir):
    return kpi.registry_gate(_registry(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


@evaluation_query(""", mq as (select dimension, score, (case dimension when 'empathy' then 2 else 1 end) as rows from d union all select dimension, 3, 1 from d)
select dimension, greatest(1.0, least(5.0, floor(sum(score * rows)::double / sum(rows) * 100 + 0.5) / 100)) as score from mq group by 1""")
def merged_dimensions(spark, sf_dir):
    """The rule's dimensions and a second judge's, merged by the rows that each has seen."""
    d = evaluated(spark, sf_dir).dimensions
    first = d.select("dimension", F.col("score").cast("double").alias("score"), F.when(F.col("dimension") == "empathy", 2).otherwise(1).alias("rows"))
    return signals.merge_dimensions(first.unionByName(d.select("dimension", F.lit(3.0).alias("score"), F.lit(1).alias("rows"))))


def _signal_evidence(o) -> str:  # noqa: ANN001
    row = lambda test, end="": f"(select struct_pack(s := session_id, t := turn_index, c := content, z := seg_end) from x where {test} order by session_seq {end}, turn_index {end} limit 1)"
    unresolved = "exists (select 1 from low where low.unresolved and low.session_id = x.session_id and low.turn_index = x.turn_index)"
    return f""", se as (select 'interest_decline' as k, coalesce({row("role = 'user'", 'desc')}, {row('true', 'desc')}) as e union all select 'understanding_barrier', coalesce({row("role = 'user' and " + o.rx('content', o.L.confusion))}, {row("role = 'user' and is_question")}, {row('true')})
    union all select 'recovery_failure', coalesce({row(unresolved)}, {row('emotion <= 40')}, {row('true')}))
select k as signal_key, '[turn ' || e.t || '] ' || e.c as evidence, e.s || ':' || case k when 'interest_decline' then greatest(1, e.t - 2) || '-' || e.t when 'understanding_barrier' then e.t || '-' || e.t else e.t || '-' || least(e.t + 4, e.z) end as evidence_turn_range from se"""


@evaluation_query(_signal_evidence)
def signal_evidence(spark, sf_dir):
    """The turn that each signal names, and its range."""
    return evaluated(spark, sf_dir).signals.select("signal_key", "evidence", "evidence_turn_range")


def _goal_evidence(o) -> str:  # noqa: ANN001
    said = lambda n: f"case when length(content) > {n} then left(content, {n}) || '…' else content end"
    first = lambda text, test: f"arg_min('{text} at turn ' || turn_index || ': ' || {said(60)}, turn_index) filter (role = 'user' and {test})"
    return f""", ge as (select session_id, {first('gave up', 'back <= 2 and ' + o.rx('content', *o.L.goal_give_up))} as w1, {first('escalated', o.rx('content', *o.L.goal_escalation))} as w2, {first('unsolved', o.rx('content', *o.L.goal_failure))} as w3,
    arg_max('solved at turn ' || turn_index || ': ' || {said(80)}, turn_index) filter (role = 'assistant' and {o.rx('content', *o.L.goal_resolution)}) as v1, arg_max('closed with: ' || {said(60)}, turn_index) filter (role = 'user') as v2, 'emotion rose to ' || arg_max(emotion, turn_index) as v3 from ranked group by 1)
select session_id, array_to_string(list_filter([case when f1 then w1 end, case when f2 then w2 end, case when f3 then w3 end, case when f4 then 'asked again, times: ' || rep.c end], lambda v: v is not null), '|') as failure_reasons,
    array_to_string(list_filter([case when a1 then v1 end, case when a2 then v2 end, case when a3 then v3 end], lambda v: v is not null), '|') as achievement_evidence from gv join ge using (session_id) left join rep using (session_id)"""


@evaluation_query(_goal_evidence)
def goal_evidence(spark, sf_dir):
    """What speaks for and against each session's goal."""
    goals = evaluated(spark, sf_dir).goals
    return goals.select("session_id", F.array_join("failure_reasons", "|").alias("failure_reasons"), F.array_join("achievement_evidence", "|").alias("achievement_evidence"))


# ---- packages, gates and runs ----------------------------------------------------------------------------------------


def _scopes(tags: str = "tags") -> str:
    named = ", ".join(f"case when {_has(*names).replace('tags', tags)} then '{layer}' end" for layer, names in regression.EDIT_SCOPE.items())
    kept = f"list_filter([{named}], lambda v: v is not null)"
    return f"case when len({kept}) > 0 then {kept} else ['prompt', 'orchestration'] end"


_PRIORITY = f"case when {_has(*regression.HARD_TAGS)} or severity >= 0.72 then 'P0' when severity >= 0.48 then 'P1' else 'P2' end"
_SELECTED = ", sel as (select * from cases order by severity desc, session_seq, seg limit 5), pk as (select count(*) as n, max(severity) as severity, list_distinct(flatten(list(tags))) as tags from sel)"
_VALUES = f""", pv as (select 'user_question_repeat_rate' as metric, question_repeat_rate as value from o union all select 'escalation_keyword_hit_rate', escalation_rate from o union all select 'avg_response_gap_sec', avg_response_gap_sec from o
    union all select case dimension when 'empathy' then 'empathy_score' when 'on_topic' then 'off_topic_score' else 'emotion_recovery_score' end, score from d where dimension in ('empathy', 'on_topic', 'recovery')
    union all select 'goal_completion_rate', coalesce(avg((status = 'achieved')::int), 0) from goals union all select 'recovery_completion_rate', coalesce(avg((status = 'completed')::int), 0) from rv where status <> 'none'
    union all select 'scenario_average_score', {r('avg(score)', 4)} from kpis)"""
_TARGET_ROWS = ", ".join(f"('{m}', {'null' if t is None else list(t)}, '{d}', {x}::double, {b}::double, {lo}::double, {hi}::double, {n})" for m, t, d, x, b, lo, hi, n in regression.TARGETS)
_TARGETED = f"""{_SELECTED}{_VALUES}, tg as (select metric, direction, coalesce(value, 0) as current, greatest(low, least(high, floor(greatest(coalesce(value, 0) + case direction when 'increase' then step else -step end, bound) * pow(10.0::double, places) + 0.5) / pow(10.0::double, places))) as target
    from (values {_TARGET_ROWS}) v(metric, asked, direction, step, bound, low, high, places) left join pv using (metric) where case when asked is null then value < bound else list_has_any(asked, (select tags from pk)) end and (select n from pk) > 0)"""


@evaluation_query(_SELECTED + f" select session_id, seg as topic_segment_index, severity, {_PRIORITY} as priority, array_to_string({_scopes()}, ',') as edit_scope from sel")
def package_cases(spark, sf_dir):
    """The five worst cases: a package's size is fixed."""
    return regression.select_cases(evaluated(spark, sf_dir).bad_cases).select("session_id", "topic_segment_index", "severity", "priority", F.array_join("edit_scope", ",").alias("edit_scope"))


def _package(spark, sf_dir) -> tuple[Evaluation, DataFrame]:
    e = evaluated(spark, sf_dir)
    return e, regression.remediation_package(regression.select_cases(e.bad_cases))


@evaluation_query(_SELECTED + f", ct as (select tag, count(*) as n from (select unnest(tags) as tag from sel) group by 1 order by 2 desc, 1 limit 5) select n as cases, {_PRIORITY} as priority, array_to_string({_scopes()}, ',') as edit_scope, (select string_agg(tag, ',' order by n desc, tag) from ct) as dominant_tags from pk where n > 0")
def remediation_package(spark, sf_dir):
    _, package = _package(spark, sf_dir)
    return package.select("cases", "priority", F.array_join("edit_scope", ",").alias("edit_scope"), F.array_join("dominant_tags", ",").alias("dominant_tags"))


@evaluation_query(_TARGETED + " select metric, direction, current, target from tg")
def target_metrics(spark, sf_dir):
    e, package = _package(spark, sf_dir)
    return regression.target_metrics(package, regression.package_values(e))


_GUARDED = f"""{_TARGETED}, gd as (select metric || case direction when 'increase' then '_min' else '_max' end as guard, metric, case direction when 'increase' then 'gte' else 'lte' end as comparator, {r('target', 4)} as threshold from tg
    union all select 'dangerous_reply_count', null, 'lte', 0 from pk where n > 0 union all select 'max_regressions', null, 'lte', 0 from pk where n > 0 union all select 'avg_latency_regression_max_ratio', null, 'lte', 1.2 from pk where list_contains(tags, 'long_response_gap')),
nw as (select metric, value * case when metric like 'a%' then 0.5::double else 1.25::double end as value from pv),
rt as (select tg.*, nw.value as now, coalesce(case direction when 'increase' then nw.value > current else nw.value < current end, false) as improved, coalesce(case direction when 'increase' then nw.value >= target else nw.value <= target end, false) as passed from tg left join nw using (metric)),
gv2 as (select guard, comparator, threshold, case guard when 'max_regressions' then (select count(*)::double from rt where not improved and not passed) when 'dangerous_reply_count' then 0
    when 'avg_latency_regression_max_ratio' then (select case when p.value > 0 then n.value / p.value end from pv p, nw n where p.metric = 'avg_response_gap_sec' and n.metric = 'avg_response_gap_sec') else nw.value end as v from gd left join nw using (metric)),
gr as (select guard, comparator, threshold, {r('v', 4)} as value, coalesce(case comparator when 'gte' then v >= threshold else v <= threshold end, guard = 'avg_latency_regression_max_ratio') as passed from gv2)"""


def _replay(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Targets and guards of the package against a replay: the same values, gaps halved and all else a quarter higher."""
    e, package = _package(spark, sf_dir)
    before = regression.package_values(e)
    now = before.withColumn("value", F.col("value") * F.when(F.col("metric").startswith("a"), 0.5).otherwise(1.25))
    targets = regression.target_metrics(package, before)
    results = regression.replay_targets(targets, now)
    return results, regression.guard_results(regression.acceptance_guards(package, targets), results, before, now)


@evaluation_query(_GUARDED + " select guard, comparator, threshold, value, passed from gr")
def replay_guards(spark, sf_dir):
    return _replay(spark, sf_dir)[1]


@evaluation_query(_GUARDED + f""", ws as (select count(*) as metrics, count(*) filter (improved) as improved, count(*) filter (passed) as passed, count(*) filter (not improved and not passed) as regressed from rt), wr as (select *, {r('coalesce(improved::double / nullif(metrics, 0), 1)', 4)} as win_rate from ws)
select *, case when win_rate >= 0.65 and (select coalesce(bool_and(passed), true) from gr) then 'passed' else 'failed' end as gate from wr""")
def replay_validation(spark, sf_dir):
    return regression.replay_validation(*_replay(spark, sf_dir))


@evaluation_query(_VALUES + f""", a as (select metric, value from pv where metric in ('scenario_average_score', 'avg_response_gap_sec', 'escalation_keyword_hit_rate') union all select 'bad_case_count', count(*)::double from cases)
select metric, a.value as left_value, a.value * 0.5::double as right_value, {r('a.value * 0.5::double - a.value', 4)} as delta from a""")
def compared_runs(spark, sf_dir):
    """A run against one of half its values."""
    own = regression.run_values(evaluated(spark, sf_dir))
    out = regression.compare_runs(own, own.withColumn("value", F.col("value") * 0.5))
    return out.select("metric", F.col("left").alias("left_value"), F.col("right").alias("right_value"), "delta")


_LINKS = """lk as (select c_custkey as run_id, case when c_custkey % 5 <> 0 then c_custkey + 3 end as validation_id, ['failed', 'partial', 'passed'][c_custkey % 3 + 1] as baseline_status from customer), va as (select s_suppkey as validation_id, ['failed', 'partial', 'passed'][s_suppkey % 2 + 2] as status from supplier),
dl as (select lk.*, va.status, case when lk.validation_id is null then 'not_linked' when va.status is null then 'missing' when rank > base then 'improved' when rank < base then 'regressed' else 'unchanged' end as delta
    from lk left join va using (validation_id), lateral (select case va.status when 'passed' then 2 when 'partial' then 1 else 0 end as rank, case lk.baseline_status when 'passed' then 2 when 'partial' then 1 else 0 end as base)),
kp5 as (select * from dl order by run_id desc limit {n})"""


def _links(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    status = F.array(F.lit("failed"), F.lit("partial"), F.lit("passed"))
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    links = table(spark, sf_dir, "customer").select(c.alias("run_id"), F.when(c % 5 != 0, c + 3).alias("validation_id"), F.element_at(status, (c % 3 + 1).cast("int")).alias("baseline_status"))
    return links, table(spark, sf_dir, "supplier").select(s.alias("validation_id"), F.element_at(status, (s % 2 + 2).cast("int")).alias("status"))


@query(f"with {_LINKS.format(n=5)} select run_id, status, delta from kp5")
def release_deltas(spark, sf_dir):
    """The five latest runs: the report's size is fixed."""
    return regression.release_readiness(*_links(spark, sf_dir)).select("run_id", "status", "delta")


@query(f"with {_LINKS.format(n=1_000_000)}, z as (select count(*) filter (delta = 'improved') as improved, count(*) filter (delta = 'regressed') as regressed, count(*) filter (delta = 'missing') as missing, count(*) filter (delta = 'not_linked') as not_linked, count(*) filter (delta = 'unchanged') as unchanged from dl) select *, case when regressed > 0 then 'blocked' when missing + not_linked > 0 then 'pending' else 'ready' end as status from z")
def release_status(spark, sf_dir):
    """The status over all runs, not the last five."""
    return regression.readiness_status(regression.release_readiness(*_links(spark, sf_dir), last=2**31 - 1))


@query("""with st as (select o_orderpriority as scope, o_orderkey as item, case o_orderkey % 4 when 0 then null when 1 then false else o_custkey % 7 > 0 end as passed from orders),
k as (select scope, list(item order by item)[1:3] as blockers from st where not passed group by 1), c as (select scope, count(*) filter (passed) as p, count(*) filter (not passed) as f, count(*) filter (passed is null) as u from st group by 1)
select scope, case when f = 0 and u = 0 then 'passed' when f > 0 and p = 0 then 'failed' when p = 0 and f = 0 then 'ready' else 'partial' end as status, array_to_string(coalesce(blockers, []), ',') as blockers from c left join k using (scope)""")
def workflow_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey") % 4
    steps = o.select(F.col("o_orderpriority").alias("scope"), F.col("o_orderkey").alias("item"), F.when(n == 1, False).when(n > 1, F.col("o_custkey") % 7 > 0).alias("passed"))
    return regression.workflow_status(steps.withColumn("item", F.col("item").cast("bigint"))).withColumn("blockers", F.array_join(F.transform("blockers", lambda x: x.cast("string")), ","))


@query(f"select count(*) as cases, {r('avg(c_acctbal::double)', 4)} as avg_before, {r('avg(case when c_custkey % 4 > 0 then c_acctbal::double * 0.5::double end)', 4)} as avg_after from customer")
def batch_summary(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return regression.batch_summary(c.select(F.col("c_acctbal").cast("double").alias("before"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal").cast("double") * 0.5).alias("after")))


@query(f"select doc_id, {unit('(doc_id % 6) / 5.0::double * 0.35::double + (doc_id % 11) / 10.0::double * 0.3::double + (doc_id % 3) / 2.0::double * 0.15::double + (1 - (doc_id % 7) / 6.0::double) * 0.2::double')} as score from documents")
def case_scores(spark, sf_dir):
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", regression.case_score((n % 6).cast("double"), (n % 11) / 10.0, (n % 3) / 2.0, (n % 7) / 6.0).alias("score"))


# ---- gold sets -------------------------------------------------------------------------------------------------------


@evaluation_query(""", pf as (select session_id, seg, tags from cases) select session_id || '_topic_' || seg as case_id, 'empathy' as dimension, case when list_contains(tags, 'emotion_drop') then 2 else 3 end as score from pf
union all select session_id || '_topic_' || seg, 'on_topic', case when list_contains(tags, 'off_topic_shift') or list_contains(tags, 'understanding_barrier') then 2 else 4 end from pf union all select session_id || '_topic_' || seg, 'not_preachy', 4 from pf
union all select session_id || '_topic_' || seg, 'recovery', case when list_contains(tags, 'recovery_failed') then 1 when list_contains(tags, 'emotion_drop') then 2 else 3 end from pf""")
def prefilled_labels(spark, sf_dir):
    return calibration.prefill_labels(evaluated(spark, sf_dir).bad_cases.select(F.col("topic_segment_id").alias("case_id"), "tags"))


@query("""with c as (select conv_id, count(*)::int as messages, count(*) filter (role = 'user')::int as user_messages, count(*) filter (role = 'assistant')::int as assistant_messages from conversations group by 1),
n as (select *, 'Conv ' || conv_id as case_id, row_number() over (order by 'Conv ' || conv_id) - 1 as i from c)
select 'v2_conv-' || conv_id || '_label' as task_id, case_id, 'P1' as priority, 'draft' as status, ['ann', 'bo', 'cy'][i % 3 + 1] as assignee, ['di', 'ed'][i % 2 + 1] as reviewer, messages, user_messages, assistant_messages, conv_id % 2 = 0 as has_notes from n""")
def annotation_tasks(spark, sf_dir):
    """A task for every conversation; assignees and reviewers take turns."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("rows"))
    cases = c.select(F.concat(F.lit("Conv "), F.col("conv_id").cast("string")).alias("case_id"), "rows", F.when(F.col("conv_id") % 2 == 0, "seen").otherwise(" ").alias("notes"))
    return calibration.annotation_tasks(cases, "v2", ["ann", "bo", "cy"], ["di", "ed"])


def _drafts(spark, sf_dir) -> DataFrame:
    """labels as drafts: dimensions, goal and trace by a rule on the id, with faults of every kind."""
    n = F.col("doc_id")
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), (F.lit(1.0) + (n + k) % 6).alias("score"), F.when((n + k) % 9 == 0, " ").otherwise("said").alias("evidence")) for k, d in enumerate(calibration.GOLD_DIMENSIONS)])
    goal = F.struct(F.when(n % 13 == 0, "lost").otherwise("achieved").alias("status"), (n % 7).cast("double").alias("score"), F.when(n % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e"))).alias("evidence"))
    trace = F.struct(F.when(n % 5 == 0, "none").otherwise("completed").alias("status"), (n % 3).cast("double").alias("quality"))
    return table(spark, sf_dir, "labels").select(n.alias("case_id"), F.when(n % 8 == 0, F.slice(dims, 1, 3)).otherwise(dims).alias("dimensions"), F.when(n % 4 == 3, "draft").otherwise("approved").alias("status"), F.when(n % 17 == 0, "").otherwise("ann").alias("labeler"), goal.alias("goal"), trace.alias("trace"))


_DRAFT = """dr as (select doc_id as n, case when doc_id % 4 = 3 then 'draft' else 'approved' end as status from labels),
er as (select n, status, list_filter(list_concat(list_concat(case when n % 8 = 0 then ['missing:recovery'] else [] end,
    list_concat(list_filter(list_transform([0, 1, 2, 3], lambda k: case when (n + k) % 6 = 5 and not (k = 3 and n % 8 = 0) then 'range:' || ['empathy', 'on_topic', 'not_preachy', 'recovery'][k + 1] end), lambda v: v is not null),
        list_filter(list_transform([0, 1, 2, 3], lambda k: case when (n + k) % 9 = 0 and not (k = 3 and n % 8 = 0) then 'evidence:' || ['empathy', 'on_topic', 'not_preachy', 'recovery'][k + 1] end), lambda v: v is not null))),
    [case when n % 17 = 0 then 'labeler' end, case when n % 13 = 0 then 'goal:status' end, case when n % 7 = 6 then 'goal:score' end, case when n % 11 = 0 then 'goal:evidence' end, case when n % 5 = 0 and n % 3 <> 0 then 'trace:none' end, case when status <> 'approved' then 'not-approved' end]), lambda v: v is not null) as errors from dr)"""


@query(f"with {_DRAFT} select n as case_id, array_to_string(errors, ',') as errors, len(errors) = 0 as valid from er")
def validated_labels(spark, sf_dir):
    return calibration.validate_labels(_drafts(spark, sf_dir)).select("case_id", F.array_join("errors", ",").alias("errors"), "valid")


@query(f"with {_DRAFT} select count(*) filter (len(errors) = 0) as imported, count(*) filter (status <> 'approved') as skipped, count(*) filter (status = 'approved' and len(errors) > 0) as failed from er")
def imported_labels(spark, sf_dir):
    return calibration.import_labels(calibration.validate_labels(_drafts(spark, sf_dir)))[1]


@query("""with d as (select count(*) as drafts, count(*) filter (doc_id % 4 <> 3) as approved, count(*) filter (doc_id % 11 = 0) as without_evidence from labels), c as (select count(*) as cases from documents), l as (select count(*) as labels from labels where quality = 1)
select cases, drafts, approved, without_evidence, labels, greatest(0, 300 - cases) as case_gap, greatest(0, 240 - approved) as approved_gap, cases >= 300 as pool_ready, approved >= 240 as labels_ready, labels = approved as imported_all, without_evidence = 0 as evidence_ready from d, c, l""")
def coverage_readiness(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    drafts = labels.select("doc_id", F.when(F.col("doc_id") % 4 == 3, "draft").otherwise("approved").alias("review_status"), (F.col("doc_id") % 11 == 0).alias("no_evidence"))
    return calibration.coverage_readiness(table(spark, sf_dir, "documents"), drafts, labels.filter("quality = 1"), 300)


@query("""with t as (select source, lang, doc_id % 3 = 0 as ok, doc_id % 5 = 0 as free from documents), c as (select source, lang, count(*) as tasks, count(*) filter (ok) as approved, count(*) filter (free) as unassigned from t group by 1, 2) select *, greatest(0, 12 - approved) as missing from c""")
def gold_coverage(spark, sf_dir):
    n = F.col("doc_id")
    tasks = table(spark, sf_dir, "documents").select("source", "lang", F.when(n % 3 == 0, "approved").otherwise("draft").alias("status"), F.when(n % 5 > 0, "ann").alias("assignee"))
    return calibration.coverage_gaps(calibration.gold_coverage(tasks, "source", "lang"), 12)


@query("select coalesce(nullif(trim(source), ''), 'unassigned') as key, count(*) as count from documents group by 1")
def scene_counts(spark, sf_dir):
    return calibration.count_by(table(spark, sf_dir, "documents"), F.col("source"))


@query(f"""with j as (select doc_id, (doc_id % 5)::double as g, case when doc_id % 3 > 0 then (doc_id % 4)::double end as t from documents), m as (select 'goal_completion' as field, (case when doc_id % 2 = 0 then g + 1 else g end) - g as dl from j union all select 'recovery_trace', t * 0.5::double - t from j)
select field, count(dl) as cases, {r('avg(dl)', 4)} as avg_delta, coalesce(abs({r('avg(dl)', 4)}) >= 0.4, false) as warns from m group by 1""")
def field_drift(spark, sf_dir):
    """Drift of two judges in goal completion and recovery."""
    n = F.col("doc_id")
    base = table(spark, sf_dir, "documents").select(n.alias("case_id"), (n % 5).cast("double").alias("goal_completion"), F.when(n % 3 > 0, (n % 4).cast("double")).alias("recovery_trace"))
    other = base.select("case_id", F.when(F.col("case_id") % 2 == 0, F.col("goal_completion") + 1).otherwise(F.col("goal_completion")).alias("goal_completion"), (F.col("recovery_trace") * 0.5).alias("recovery_trace"))
    return calibration.field_drift(base, other)


@query(f"""with j as (select doc_id, source, (doc_id % 5)::double as gold, (doc_id % 3)::double as pred from documents), d as (select case doc_id % 2 when 0 then 'a' else 'b' end as dimension, avg(case when doc_id % 2 = 0 then 1.0::double else 0.25::double end) as dl from documents group by 1),
v as (select {r('avg(abs(pred - gold))', 4)} as mae, count(*)::double as n, {r('avg((doc_id % 4 = doc_id % 6)::int)', 4)} as ga, {r('avg((doc_id % 5 = doc_id % 10)::int)', 4)} as ra from j)
select 'overall_mae' as "check", mae as value, 1.8::double as "limit", mae <= 1.8 as passed from v union all select 'samples', n, 4, n >= 4 from v union all select 'goal_accuracy', ga, 0.25::double, ga >= 0.25 from v union all select 'recovery_accuracy', ra, 0.25::double, ra >= 0.25 from v
union all select 'drift:' || dimension, abs({r('dl', 4)}), 0.4::double, abs({r('dl', 4)}) <= 0.4 from d""")
def judge_gate(spark, sf_dir):
    """The gate over agreement of scores and statuses, and drift."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    overall = d.agg(js_round(F.avg(F.abs((n % 3) - (n % 5)).cast("double")), 4).alias("mae"), F.count(F.lit(1)).alias("samples"))
    status = lambda a, b: calibration.status_agreement(d.select((n % a).cast("string").alias("gold_status"), (n % b).cast("string").alias("predicted_status")))
    scores = d.select(n.alias("case_id"), F.when(n % 2 == 0, "a").otherwise("b").alias("dimension"), F.lit(1.0).alias("score"))
    drift = calibration.judge_drift(scores, scores.withColumn("score", F.col("score") + F.when(F.col("dimension") == "a", 1.0).otherwise(0.25)))
    return calibration.judge_gate(overall, status(4, 6), status(5, 10), drift)


# ---- clusters and duplicates -----------------------------------------------------------------------------------------


def vector_cases(spark, sf_dir) -> DataFrame:
    """embeddings as cases: metrics of their first places, tags and groups by label and id, a hash that some share."""
    n = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings")
    tags = F.array_compact(F.array(F.concat(F.lit("t"), (F.col("label") % 4).cast("string")), F.when(n % 3 == 0, "odd"), F.when(n % 7 == 0, "rare")))
    metrics_ = F.transform(F.slice("embedding", 1, 15), lambda x: js_round(F.abs(x.cast("double")) * 0.3, 4))
    return e.select(n.alias("case_id"), F.concat(F.lit("h"), F.when(n % 50 == 1, "same").otherwise(n.cast("string"))).alias("hash"), F.concat(F.lit("g"), F.col("label").cast("string")).alias("duplicate_group"), "embedding", metrics_.alias("metrics"), tags.alias("tags"), ((n % 100) / 100).alias("severity"), n.alias("seq"))


_CASES = f"""vc as (select vec_id as case_id, 'h' || case when vec_id % 50 = 1 then 'same' else vec_id::varchar end as hash, 'g' || label as grp, list_transform(embedding, lambda x: x::double) as e, list_transform(embedding[1:15], lambda x: {r('abs(x::double) * 0.3::double', 4)}) as m,
    list_filter(['t' || (label % 4), case when vec_id % 3 = 0 then 'odd' end, case when vec_id % 7 = 0 then 'rare' end], lambda v: v is not null) as tags, (vec_id % 100) / 100.0::double as severity from embeddings)"""
_SIM = r("list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))", 4)
_FAR = r("sqrt(list_sum(list_transform(range(1, 16), lambda i: (a.m[i] - b.m[i]) * (a.m[i] - b.m[i])))) / sqrt(15)", 4)
_APART = r("(len(list_filter(a.tags, lambda z: not list_contains(b.tags, z))) + len(list_filter(b.tags, lambda z: not list_contains(a.tags, z))))::double / len(list_distinct(list_concat(a.tags, b.tags)))", 4)
_CLUSTERED = f"""{_CASES}, ln as (select a.case_id as a, b.case_id as b from vc a join vc b on a.case_id <> b.case_id where a.hash = b.hash or {_SIM} >= 0.93 or (a.grp = b.grp and (({_SIM} >= 0.86 and {_FAR} <= 0.22) or ({_FAR} <= 0.12 and {_APART} <= 0.2)))),
cc(case_id, label) as (select case_id, case_id from vc union select ln.b, cc.label from cc join ln on ln.a = cc.case_id), cl as (select case_id, min(label) as cluster from cc group by 1)"""


def _clusters(spark, sf_dir) -> DataFrame:
    cases = vector_cases(spark, sf_dir)
    return cases.join(similarity.components(cases, similarity.case_links(cases), "case_id"), "case_id")


@query(f"with recursive {_CLUSTERED} select case_id, cluster from cl")
def case_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir).select("case_id", "cluster")


@query(f"with recursive {_CLUSTERED} select cluster, count(*) as size, {r('avg(severity)', 4)} as avg_severity, min(grp) as label from cl join vc using (case_id) group by 1")
def cluster_summary(spark, sf_dir):
    """Clusters with size, severity and label; which of equally severe cases stands for one isn't fixed, so it is left out."""
    return similarity.cluster_summary(_clusters(spark, sf_dir)).drop("representative")


@query(f"""with {_CASES}, nw as (select * from vc where case_id % 5 = 0), pl as (select * from vc where case_id % 5 > 0), ex as (select nw.case_id, min(pl.case_id) as exact_id from nw join pl using (hash) group by 1),
p as (select a.case_id, b.case_id as other, {_SIM} as sim, {_FAR} as far, list_sort(a.tags) = list_sort(b.tags) as alike from nw a, pl b),
se as (select case_id, arg_min(other, (-sim, other)) as other, max(sim) as sim from p group by 1), st as (select case_id, arg_min(other, (far, other)) as other, min(far) as far from p where alike group by 1)
select nw.case_id, case when exact_id is not null then 'exact' when se.sim >= 0.95 then 'semantic' when st.far <= 0.1 then 'structural' else 'none' end as layer, coalesce(exact_id, case when se.sim >= 0.95 then se.other end, case when st.far <= 0.1 then st.other end) as matched_id from nw left join ex using (case_id) left join se using (case_id) left join st using (case_id)""")
def duplicate_layers(spark, sf_dir):
    """Every fifth case against the others as a pool: equal hash, then vectors, then metrics."""
    cases = vector_cases(spark, sf_dir)
    return similarity.duplicate_layer(cases.filter("case_id % 5 = 0"), cases.filter("case_id % 5 > 0"))


_TOPIC_TAGS = _TOPICS + f""", ss as (select session_id, count(*) as n, avg((emotion <= 40)::int) as low, coalesce(avg(gap), 0) as gap, count(distinct seg) - 1 as moves, count(*) filter (role = 'user') as users from x group by 1),
fp as (select session_id, left(regexp_replace(content, '[？?，,。.!！ \\t\\n\\r]', '', 'g'), 18) as fp, count(*) as c from x where role = 'user' group by 1, 2), rr as (select session_id, sum(c - 1) as repeats from fp where fp <> '' group by 1),
sg as (select sid, max(score) filter (signal_key = 'understanding_barrier') as barrier, max(score) filter (signal_key = 'recovery_failure') as unrecovered from (select s.signal_key, s.score, ev.sid from s join ev using (signal_key)) group by 1),
ds as (select coalesce(max(score) filter (dimension = 'empathy'), 3) as empathy, coalesce(max(score) filter (dimension = 'on_topic'), 3) as on_topic, coalesce(max(score) filter (dimension = 'not_preachy'), 3) as not_preachy from d),
ks as (select coalesce(avg(score), 0.5) as kpi, list('kpi:' || kpi || ':' || status) filter (status <> 'healthy') as kt from kpis),
fx as (select bc.id as case_id, bc.grp, bc.tags as failure_tags, bc.severity, bc.transcript, bc.start_turn, bc.head, list_sort(list_concat(list_transform(bc.tags, lambda t: 'failure:' || t), ['scenario:generic'], coalesce(kt, []))) as tags,
    [bc.severity::double, {unit('ss.n / 20')}, {unit('ss.low')}, {unit('ss.gap / 120')}, {unit('greatest(0, moves) / 3')}, {unit('coalesce(repeats, 0) / greatest(1, users)')}, case when list_contains(bc.tags, 'escalation_keyword') then 1 else 0 end,
    case goals.status when 'failed' then 1 when 'partial' then 0.6 when 'unclear' then 0.35 else 0 end, case rv.status when 'failed' then 1 when 'completed' then 0.2 else 0 end, {unit('coalesce(barrier, 0)')}, {unit('coalesce(unrecovered, 0)')},
    {unit('1 - on_topic / 5')}, {unit('1 - empathy / 5')}, {unit('1 - not_preachy / 5')}, {unit('1 - kpi')}]::double[] as m
    from bc join ss using (session_id) left join rr using (session_id) left join goals on goals.session_id = bc.session_id left join rv on rv.session_id = bc.session_id left join sg on sg.sid = bc.session_id, ds, ks)"""


def features(spark, sf_dir) -> DataFrame:
    e = evaluated(spark, sf_dir)
    return similarity.case_features(e.bad_cases, e.enriched, e.goals, e.recoveries, e.signals, e.dimensions, e.kpis).checkpoint()  # evaluated() has set the folder


@evaluation_query(_TOPIC_TAGS + " select case_id, m as metrics, array_to_string(tags, '|') as tags from fx")
def case_snapshots(spark, sf_dir):
    """The features that every bad case of the conversations is compared by."""
    return features(spark, sf_dir).select("case_id", "metrics", F.array_join("tags", "|").alias("tags"))


def _bad_clusters_sql(oracle) -> str:
    from confera.plans.text_queries import _FNV, _GRAMS, _WORDS

    words = _WORDS.replace("(text)", "(transcript)")
    same = _SIM
    title = f"case when {_has('goal_failed').replace('tags', 'failure_tags')} then 'goal-missed' when {_has('recovery_failed').replace('tags', 'failure_tags')} then 'recovery-failed' when {_has('escalation_keyword').replace('tags', 'failure_tags')} then 'escalation-risk' else 'failure-sign' end || ' at turn ' || start_turn || ': ' || case when length(head) > 24 then left(head, 23) || '…' else head end"
    return _TOPIC_TAGS + f""", tw as (select case_id, {words} as words from fx), tk as (select case_id, {_GRAMS} as tokens from tw), one as (select case_id, unnest(tokens) as token from tk), bins as (select case_id, {_FNV.format('token')} % 64 as bin, count(*) as c from one group by 1, 2),
norms as (select case_id, sqrt(sum(c * c)::double) as n from bins group by 1), em as (select case_id, map_from_entries(list((bin, c))) as m, any_value(n) as n from bins join norms using (case_id) group by 1),
vc as (select fx.*, list_transform(range(64), lambda b: {r("coalesce(em.m[b] / em.n, 0)", 6)}) as e from fx left join em using (case_id)),
ln as (select a.case_id as a, b.case_id as b from vc a join vc b on a.case_id <> b.case_id where a.transcript = b.transcript or {same} >= 0.93 or (a.grp = b.grp and (({same} >= 0.86 and {_FAR} <= 0.22) or ({_FAR} <= 0.12 and {_APART} <= 0.2)))),
lm as materialized (select * from ln), cc(case_id, label) as (select case_id, case_id from vc union select lm.b, cc.label from cc join lm on lm.a = cc.case_id), cl as (select case_id, min(label) as cluster from cc group by 1), mb as (select vc.*, cluster from vc join cl using (case_id)),
aw as (select a.cluster, a.case_id, sum(floor(sqrt(list_sum(list_transform(range(1, 16), lambda i: (a.m[i] - b.m[i]) * (a.m[i] - b.m[i])))) / sqrt(15) * 10000 + 0.5)) as away from mb a join mb b using (cluster) group by 1, 2),
rp as (select cluster, arg_min(case_id, (away, case_id)) as representative from aw group by 1), tg as (select cluster, tag, count(*) as n from (select cluster, unnest(failure_tags) as tag from mb) group by 1, 2),
tl as (select cluster, list(tag order by n desc, tag)[1:3] as tags from tg group by 1), bs as (select cluster, count(*) as size, {r('avg(severity)', 4)} as avg_severity, arg_min(grp, case_id) as g from mb group by 1)
select 'cluster_' || regexp_replace(g, '[^A-Za-z0-9:_-]+', '-', 'g') || '_' || size as cluster_id, 'generic · ' || array_to_string(tl.tags, ' + ') as label, size, representative, {title} as title, avg_severity, array_to_string(tl.tags, '|') as tags
from bs join rp using (cluster) join tl using (cluster) join mb on mb.case_id = rp.representative"""


@evaluation_query(" select session_id, turn_index, emotion as emotion_score from x")
def emotion_curve(spark, sf_dir):
    """The emotion of every turn, as its chart takes it."""
    return metrics.emotion_curve(evaluated(spark, sf_dir).enriched)


@query("select conv_id, turn, role, text from conversations order by conv_id, turn limit 20")
def previewed_turns(spark, sf_dir):
    """The first 20 turns: a preview."""
    return store.preview(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), order=["conv_id", "turn"])


@evaluation_query(_bad_clusters_sql)
def badcase_clusters(spark, sf_dir):
    """From conversations to clusters of their bad cases: features, links, connected parts, and what stands for each."""
    cases = features(spark, sf_dir)
    members = cases.join(similarity.components(cases, similarity.case_links(cases), "case_id"), "case_id").checkpoint()
    out = similarity.describe_clusters(members)
    return out.select("cluster_id", "label", "size", "representative", "title", "avg_severity", F.array_join("tags", "|").alias("tags"))


@query("""with recursive d as (select doc_id, source, length(coalesce(text, '')) as n from documents), k as (select *, lag(n) over w as prev, row_number() over w as i from d window w as (partition by source order by doc_id)),
s(source, i, saved, last) as (select source, i, true, n from k where i = 1 union all select k.source, k.i, abs(k.n - s.n_prev) > 400 or not s.saved, k.n from (select source, i, saved, last as n_prev from s) s join k on k.source is not distinct from s.source and k.i = s.i + 1)
select doc_id as case_id, saved from s join k on k.source is not distinct from s.source and k.i = s.i""")
def strictly_harvested(spark, sf_dir):
    """Documents in order, of which one is left out if the one before it of its source was saved and is about as long."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("s"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    before = Window.partitionBy("s").orderBy("doc_id")
    near = d.withColumns({"b": F.lag("doc_id").over(before), "m": F.lag("n").over(before)}).filter("abs(n - m) <= 400")
    return similarity.harvest_strictly(d.select(F.col("doc_id").alias("case_id"), F.col("doc_id").alias("seq")), near.select(F.col("doc_id").alias("a"), "b"))


@query("""with d as (select doc_id, md5(coalesce(text, '')) as hash from documents), st as (select hash, 'old' || min(doc_id) as stored_id from d where doc_id % 4 = 0 group by 1), nw as (select * from d where doc_id % 4 > 0), fr as (select hash, min(doc_id) as first from nw group by 1)
select doc_id::varchar as case_id, stored_id is null and first = doc_id as saved, coalesce(stored_id, case when first <> doc_id then first::varchar end) as matched_id from nw left join st using (hash) join fr using (hash)""")
def harvested_cases(spark, sf_dir):
    """Three of four documents harvested into a registry that holds the fourth."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    stored = d.filter("doc_id % 4 = 0").groupBy("hash").agg(F.min("doc_id").alias("doc_id")).select(F.concat(F.lit("old"), F.col("doc_id").cast("string")).alias("case_id"), "hash")
    new = d.filter("doc_id % 4 > 0").select(F.col("doc_id").cast("string").alias("case_id"), F.col("doc_id").alias("seq"), "hash")
    return similarity.harvest_cases(new, stored).drop("seq")


@query("""with p as (select p_partkey as case_id, p_type as topic, p_size as score from part),
m as (select n.*, s.case_id as match_id, s.score as stored_score, row_number() over (partition by n.case_id order by abs(n.score - s.score), s.case_id) as k, count(*) over (partition by n.case_id) as matches
    from p n join p s using (topic) where abs(n.score - s.score) <= 2 and n.case_id <> s.case_id)
select p.*, coalesce(m.matches, 0) as matches, m.match_id, m.stored_score from p left join m on m.case_id = p.case_id and k = 1""")
def same_topic_cases(spark, sf_dir):
    """How many stored cases of the topic have a score near each case's, and the nearest: parts by type and size."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_type").alias("topic"), F.col("p_size").alias("score"))
    return store.near_duplicates(p, p)


@query("""with u as (select source, count(distinct md5(text)) as found from (select source, text from documents) group by 1), w as (select source, 60 as n from u union all select 'absent', 2),
f as (select w.source, n, least(coalesce(found, 0), 60) as found from w left join u on u.source is not distinct from w.source where w.source is not null) select source, n, found, n - found as missing from f where found < n""")
def sample_shortfalls(spark, sf_dir):
    """Sources with fewer than sixty distinct texts."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", F.md5("text").alias("hash"))
    sample = similarity.stratified_sample(docs, "source", "doc_id", "hash", 60)
    names = table(spark, sf_dir, "documents").filter("source is not null").select("source").distinct().withColumn("n", F.lit(60))
    wanted = names.unionByName(spark.range(1).select(F.lit("absent").alias("source"), F.lit(2).alias("n")))
    return similarity.sample_shortfalls(sample, wanted, "source")


# ---- extended metrics ------------------------------------------------------------------------------------------------


def _calls(spark, sf_dir) -> DataFrame:
    n, e = F.col("event_id"), table(spark, sf_dir, "events")
    args = lambda shift: F.create_map(F.lit("a"), (n % 3).cast("string"), F.lit("b"), ((n + shift) % 2).cast("string"))
    return e.select(F.concat(F.lit("t"), (n % 4).cast("string")).alias("tool_name"), F.when(n % 5 > 0, F.concat(F.lit("t"), (n % 2).cast("string"))).alias("expected_tool"), args(0).alias("arguments"), F.when(n % 7 > 0, args(n % 3 % 2)).alias("expected_arguments"), (n % 6 > 0).alias("succeeded"))


_CALLS = """cl as (select (case when event_id % 5 = 0 or event_id % 2 = event_id % 4 then 0.5::double else 0 end) + 0.3::double * (case when event_id % 7 = 0 then 1 else (1 + (event_id % 2 = (event_id + event_id % 3 % 2) % 2)::int) / 2.0::double end) + (case when event_id % 6 > 0 then 0.2::double else 0.1::double end) as x, event_id % 6 > 0 as ok from events)"""


@query(f"with {_CALLS}, v as (select 'tool_correctness' as metric, {r('avg(x)', 2)} as score from cl union all select 'task_completion', {r('avg(ok::int)', 2)} from cl) select metric, score, score >= 0.7 as success from v")
def tool_metrics(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    return extended.tool_correctness(calls).unionByName(extended.task_completion(calls))


@query(f"""with f as (select f.conv_id, f.turn, coalesce(contains((select string_agg(a.text, ' ' order by a.turn) from conversations a where a.conv_id = f.conv_id and a.role = 'assistant' and a.turn > f.turn), left(f.text, 8)), false) as kept from conversations f where f.role = 'user'),
v as (select {r('avg(kept::int)', 2)} as score from f) select 'knowledge_retention' as metric, score, score >= 0.7 as success from v""")
def retention_score(spark, sf_dir):
    """By whole facts: each counts as kept by its first eight characters."""
    turns = raw_turns(spark, sf_dir)
    facts = turns.filter("role = 'user'").select("session_id", F.col("turn_index").alias("introduced"), F.col("content").alias("fact"))
    return extended.retention_score(extended.knowledge_retention(facts, turns))


_SETS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[^一-龥a-z0-9 ]', ' ', 'g'), ' +'), lambda x: length(x) >= 2))"


@query(f"""with p as (select conv_id, arg_min(text, turn) filter (role = 'user') as q, arg_max(text, turn) filter (role = 'assistant') as a, count(*) as n from conversations group by 1), f as (select * from p order by conv_id limit 1), k as (select {_SETS.format("coalesce(q, '')")} as q, {_SETS.format("coalesce(a, '')")} as a from f),
v as (select {r('coalesce(len(list_intersect(q, a)) / nullif(len(q), 0)::double, 0)', 2)} as qa, {r('coalesce(len(list_intersect(a, q)) / nullif(len(a), 0)::double, 0)', 2)} as aq, len(q) > 0 as asked from k),
m as (select 'answer_relevancy' as metric, qa as score from v union all select 'contextual_relevancy', case when asked then 1 else 0 end from v union all select 'faithfulness', aq from v union all select 'hallucination', {r('1 - aq', 2)} from v) select metric, score, score >= 0.7 as success from m""")
def context_scores(spark, sf_dir):
    """Of the first context, as the rules have it: a conversation's question, its last answer, and the question as context."""
    cases = kpi.eval_cases(raw_turns(spark, sf_dir))
    contexts = cases.select(F.coalesce("input", F.lit("")).alias("query"), F.coalesce("actual_output", F.lit("")).alias("response"), F.array(F.coalesce("input", F.lit(""))).alias("contexts"), F.col("session_id").cast("bigint").alias("turn_index"))
    return extended.context_scores(contexts)


_BIAS = " + ".join(f"regexp_matches(said, '{p}')::int" for p in extended.BIAS_PATTERNS)


@query(f"with d as (select doc_id, case doc_id % 3 when 0 then 'Black people are ' || coalesce(text, '') when 1 then '女人总是 and 学生都 ' || coalesce(text, '') else coalesce(text, '') end as said from documents), h as (select doc_id, ({_BIAS})::int as hits from d) select doc_id, hits, {r('greatest(0, 1 - hits * 0.3::double)', 2)} as score from h")
def bias_scores(spark, sf_dir):
    n, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    said = F.when(n % 3 == 0, F.concat(F.lit("Black people are "), t)).when(n % 3 == 1, F.concat(F.lit("女人总是 and 学生都 "), t)).otherwise(t)
    return extended.bias_by_pattern(table(spark, sf_dir, "documents"), "doc_id", said)


@query(f"""with c as (select conv_id, bool_or(role = 'user') as i, bool_or(role = 'assistant') as o from conversations group by 1) select 'input' as field, count(*) filter (i) as available_in, bool_or(i) as available from c union all select 'actual_output', count(*) filter (o), bool_or(o) from c union all select 'turns', count(*), true from c union all select 'timestamps', count(*), true from c""")
def case_capabilities(spark, sf_dir):
    return kpi.capability_report(kpi.eval_cases(raw_turns(spark, sf_dir)))


@query(f"with p as (select conv_id, arg_min(text, turn) filter (role = 'user') as q from conversations group by 1), k as (select a.conv_id, {_SETS.format('a.q')} as x, {_SETS.format('b.q')} as y from p a join p b on b.conv_id = a.conv_id + 1) select conv_id, {r('coalesce(len(list_intersect(x, y)) / nullif(len(x), 0)::double, 0)', 2)} as overlap from k where x is not null and y is not null")
def keyword_overlaps(spark, sf_dir):
    """Of each conversation's question with the next one's."""
    c = kpi.eval_cases(raw_turns(spark, sf_dir)).filter("input is not null").select(F.col("session_id").cast("bigint").alias("conv_id"), "input")
    after = c.select((F.col("conv_id") - 1).alias("conv_id"), F.col("input").alias("next"))
    return c.join(after, "conv_id").select("conv_id", keyword_overlap(F.col("input"), F.col("next")).alias("overlap"))
