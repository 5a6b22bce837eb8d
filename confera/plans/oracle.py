"""The same results in SQL, written from the definitions of the operators."""

from __future__ import annotations

from confera.functions.lexicon import SYNTHETIC as L


def more_sql() -> dict[str, str]:
    """The SQL that stands beside its query, in the modules of queries that have it so."""
    from confera.plans import case_queries, source_queries, text_queries
    from confera.plans.registry import SQL as beside

    assert text_queries.QUERIES
    source_queries.register_later()
    case_queries.register_later()
    return beside


def rx(column: str, *patterns: str) -> str:
    return "(" + " or ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


def r(x: str, n: int) -> str:
    return f"(floor(({x}) * {10**n}.0::double + 0.5) / {10**n}.0::double)"


def clamp(x: str, low: float, high: float, n: int) -> str:
    return f"greatest({low}::double, least({high}::double, {r(x, n)}))"


def chain(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts)


_DOMAIN = "case " + " ".join(f"when {rx('content', p)} then {{}}" for p, *_ in L.domains[:-1]) + " else {} end"


def domain(k: int) -> str:
    values = [d[k] for d in L.domains]
    return _DOMAIN.format(*[f"'{v}'" if isinstance(v, str) else str(v) for v in values])


KEYWORD = "case " + " ".join(f"when contains(content, '{k}') then '{k}'" for k, _ in L.keywords) + " end"
WEIGHT = "case " + " ".join(f"when contains(content, '{k}') then {w}::double" for k, w in L.keywords) + " end"

TURNS = f"""t0 as (select conv_id::varchar as session_id, conv_id as session_seq, (turn + 1)::int as turn_index, role, text as content,
    (1577836800000 + conv_id * 86400000 + 1000 * sum((conv_id * 37 + turn * 53) % 240) over (partition by conv_id order by turn))::bigint as ts_ms from conversations),
t1 as (select *, floor((ts_ms - lag(ts_ms) over s) / 1000.0::double + 0.5)::bigint as gap0, turn_index = max(turn_index) over (partition by session_id) and role = 'assistant' as is_dropoff,
    {rx('content', L.question)} as is_question, greatest(1, ceil(length(content) / 1.6::double))::int as token_estimate, length(content)::int as content_length,
    hour(make_timestamp(ts_ms * 1000))::int as active_hour from t0 window s as (partition by session_id order by turn_index)),
t as (select * exclude (gap0), case when gap0 < 0 then 0 else gap0 end as gap from t1)"""

_MARKED = """g as (select *, coalesce(lag(seg) over s <> seg, false) as is_switch, lag(role) over s as prev_role, lag(is_question) over s as prev_question from g0 window s as (partition by session_id order by turn_index))"""
_OWN = f"{domain(2)} as own_domain, {domain(1)} as own_label, {domain(3)} as hundredths"

# The running-sum part of the rules.
ROW_SEGMENTS = f"""g0 as (select *, (1 + sum((role = 'user' and {rx('content', L.switch, L.negative_break)} and not {rx('content', L.continuation)} and turn_index > 1)::int)
    over (partition by session_id order by turn_index))::int as seg, {_OWN} from t),
{_MARKED}"""

# The scan, a turn of every session a step; its state is the list of domains of the open segment with their sums, in order of appearance.
_LEAD = "list_filter(sums, lambda y: y.s = list_max(list_transform(sums, lambda z: z.s)))[1].d"
_COMPATIBLE = "(p.lead, c.own_domain) in (" + ", ".join(f"('{x}', '{y}')" for x, y in sorted(L.compatible)) + ")" if L.compatible else "false"
SEGMENTS = f"""k0 as (select *, {_OWN}, {rx('content', L.switch, L.negative_break)} as breaks, {rx('content', L.practice)} as practice, {rx('content', L.assistant_wrap)} as wrap, {rx('content', L.wrap_up)} as closing, {rx('content', L.continuation)} as goes_on from t),
scan(session_id, turn_index, seg, sums) as (select session_id, turn_index, 1, [{{'d': own_domain, 's': hundredths}}] from k0 where turn_index = 1
    union all select session_id, turn_index, case when splits then seg + 1 else seg end, case when splits then [{{'d': own_domain, 's': hundredths}}] when list_contains(list_transform(sums, lambda y: y.d), own_domain)
        then list_transform(sums, lambda y: case when y.d = own_domain then {{'d': y.d, 's': y.s + hundredths}} else y end) else list_append(sums, {{'d': own_domain, 's': hundredths}}) end
    from (select c.*, p.seg, p.sums, not c.goes_on and case when c.role = 'user' and c.breaks then true when p.lead = c.own_domain then false when c.role = 'user' and c.practice then true
        when {_COMPATIBLE} or c.own_domain = 'casual' or (c.role = 'assistant' and not c.wrap) then false when c.own_domain = 'wrap_up' then c.closing else c.practice or c.hundredths >= 84 end as splits
        from (select *, {_LEAD} as lead from scan) p join k0 c on c.session_id = p.session_id and c.turn_index = p.turn_index + 1)),
g0 as (select t.*, scan.seg, {_OWN} from t join scan using (session_id, turn_index)),
{_MARKED}"""

CUES = f"""c0 as (select *, min(turn_index) over (partition by session_id, seg) as seg_start from g),
c1 as (select session_id, seg, count(*) as n_rows, count(*) filter ({rx('content', L.negative)}) as neg, count(*) filter ({rx('content', L.positive)}) as pos,
    count(*) filter (role = 'assistant' and {rx('content', L.empathy)}) as emp, count(*) filter (role = 'assistant' and {rx('content', L.preachy)}) as pre,
    coalesce(avg(gap) filter (gap > 0 and turn_index > seg_start), 0) as avg_gap, coalesce(avg(content_length) filter (role = 'user'), 0) as ulen, coalesce(avg(content_length) filter (role = 'assistant'), 0) as alen,
    arg_max(role, turn_index) as last_role, coalesce(arg_min({rx('content', L.negative)}, turn_index) filter (role = 'user'), false) as first_neg,
    coalesce(arg_max({rx('content', L.positive)}, turn_index) filter (role = 'user'), false) as last_pos from c0 group by all),
c2 as (select *, case when neg >= pos + 2 then 'negative' when pos >= neg + 2 then 'positive' when neg > 0 and pos > 0 then 'mixed' else 'neutral' end as polarity,
    case when greatest(neg, pos) / n_rows::double >= 0.5 then 'high' when greatest(neg, pos) / n_rows::double >= 0.25 then 'medium' else 'low' end as intensity from c1),
c3 as (select *, {clamp("case polarity when 'negative' then 34 + pos * 2 - neg * 1.5::double when 'positive' then 72 + pos * 2 - neg when 'mixed' then 55 + pos - neg else 52 end", 0, 100, 1)} as base from c2)"""

EMOTION = f"""e0 as (select *, {clamp('(pos - neg) / n_rows::double * 12', -8, 8, 1)} as valence,
    {clamp('(case when ulen >= 14 then 2.5 when ulen <= 7 then -2.5 else 0 end + case when alen >= 28 then -1.5 when alen <= 10 then -1 else 0.8 end)::double', -8, 8, 1)} as len_w, {clamp('emp * 1.5::double - pre * 3', -8, 8, 1)} as style,
    (case when avg_gap > 90 then -5 when avg_gap > 45 then -2 when avg_gap > 0 and avg_gap < 20 then 1.5 else 0 end)::double as gap_w,
    (case when first_neg and last_pos then 6 when first_neg and emp > 0 then 3.5 when polarity = 'negative' and emp = 0 then -3 else 0 end)::double as rec,
    {clamp("(case when last_role = 'assistant' then 1.2 else 0 end + case when polarity = 'negative' and intensity = 'high' then 2.8 else 0 end + case when ulen <= 6 and polarity = 'negative' then 1.5 else 0 end)::double", 0, 8, 1)} as risk from c3),
e as (select *, {clamp('base + valence + len_w + style + gap_w + rec - risk', 0, 100, 1)} as emotion from e0),
x as (select g.*, e.emotion, e.n_rows as seg_rows, max(g.turn_index) over (partition by g.session_id, g.seg) as seg_end from g join e using (session_id, seg))"""

ALL = (TURNS, SEGMENTS, CUES, EMOTION)
FP = "left(regexp_replace(content, '[？?，,。.!！ \\t\\n\\r]', '', 'g'), {})"

OBJECTIVE = f"""f as (select session_id, count(distinct seg) as segs, bool_or(role = 'assistant' and {rx('content', L.resolution_signal)}) as res, bool_or({rx('content', L.escalation_signal)}) as esc from g group by 1),
q as (select coalesce({r('sum(c - 1) / sum(c)::double', 4)}, 0) as rate from (select {FP.format(18)} as fp, count(*) as c from g where role = 'user' and is_question group by 1) where fp <> ''),
u as (select row_number() over (order by session_seq, turn_index) - 1 as i, content_length as y from g where role = 'user'),
o as (select {r('(select coalesce(avg(gap), 0) from g)', 2)} as avg_response_gap_sec, {r('avg(segs - 1)', 4)} as topic_switch_rate, {r('avg(res::int)', 4)} as resolution_rate, {r('avg(esc::int)', 4)} as escalation_rate,
    (select {r("avg(is_question::int)", 4)} from g where role = 'user') as user_question_rate, (select {r('avg(content_length)', 2)} from g where role = 'user') as avg_user_length, (select {r('avg(content_length)', 2)} from g where role = 'assistant') as avg_assistant_length,
    (select rate from q) as question_repeat_rate, (select {r('coalesce((count(*)::double * sum(i::double * y) - sum(i)::double * sum(y)) / nullif(count(*)::double * sum(i::double * i) - sum(i)::double * sum(i), 0), 0)', 4)} from u) as length_trend from f)"""

_drift = "(x.prev_role = 'user' and x.prev_question and x.role = 'assistant' and x.is_switch)"


def signal(key: str, base: float, rules: list[tuple[str, float]], found: float, none: float, frame: str) -> str:
    score = " + ".join([f"{base}::double"] + [f"case when {test} then {w}::double else 0 end" for test, w in rules])
    any_ = " or ".join(test for test, _ in rules)
    return f"select '{key}' as signal_key, {clamp(score, 0, 1, 2)} as score, case when {any_} then {found}::double else {none}::double end as confidence from {frame}"


SIGNALS = f"""users as (select x.*, row_number() over (order by session_seq, turn_index) - 1 as i, count(*) over () as n from x where role = 'user'),
halves as (select *, i < greatest(1, ceil(n / 2.0::double)) as early from users),
h as (select coalesce(avg(content_length) filter (early), 0) as el, coalesce(avg(content_length) filter (not early), 0) as ll, coalesce(avg(coalesce(gap, 0)) filter (early), 0) as eg, coalesce(avg(coalesce(gap, 0)) filter (not early), 0) as lg,
    coalesce(avg(is_question::int) filter (early), 0) as eq, coalesce(avg(is_question::int) filter (not early), 0) as lq from halves),
b as (select bool_or(role = 'user' and {rx('content', L.confusion)}) as confused, bool_or(coalesce({_drift}, false)) as drifted,
    coalesce((select max(c) >= 2 from (select {FP.format(18)} as fp, count(*) as c from x where role = 'user' and is_question group by 1) where fp <> ''), false) as repeated from x),
low as (select *, emotion <= 40 and not coalesce(max(emotion) over (partition by session_id order by turn_index range between 1 following and 4 following) >= 60, false) as unresolved,
    lag(emotion) over (partition by session_id order by turn_index) as before from x),
lo as (select bool_or(unresolved) as unresolved, coalesce(bool_or(is_dropoff and before <= 40), false) as left_low from low),
s0 as ({signal('interest_decline', 0.22, [('ll < el * 0.78::double', 0.26), ('lg > greatest(30, eg * 1.4::double)', 0.28), ('(lq < eq and eq > 0)', 0.18)], 0.78, 0.62, 'h')}
    union all {signal('understanding_barrier', 0.2, [('confused', 0.3), ('repeated', 0.28), ('drifted', 0.18)], 0.81, 0.6, 'b')}
    union all {signal('recovery_failure', 0.22, [('unresolved', 0.34), ('left_low', 0.22)], 0.83, 0.64, 'lo')}),
s as (select *, case when score >= 0.7 then 'high' when score >= 0.4 then 'medium' else 'low' end as severity from s0)"""

DIMENSIONS = f"""dm as (select count(*) as n, count(*) filter (role = 'assistant') as a, count(*) filter (role = 'assistant' and {rx('content', L.dimension_empathy)}) as kind, count(*) filter (role = 'assistant' and {rx('content', L.dimension_preachy)}) as pre,
    count(*) filter (is_switch) as sw, count(*) filter (emotion <= 40) as low, count(*) filter (emotion >= 65) as high, (select score from s where signal_key = 'understanding_barrier') as bar, (select score from s where signal_key = 'recovery_failure') as fail from x),
d as (select 'empathy' as dimension, case when a = 0 then 1 else {clamp('kind / a::double * 5', 1, 5, 0)} end::int as score from dm
    union all select 'on_topic', {clamp('5 - sw / n::double * 8 - bar * 2', 1, 5, 0)}::int from dm union all select 'not_preachy', case when a = 0 then 1 else {clamp('5 - pre / a::double * 10', 1, 5, 0)} end::int from dm
    union all select 'recovery', case when low = 0 then {clamp('4 - fail', 1, 5, 0)} else {clamp('high / low::double * 2.5::double + (1 - fail)', 1, 5, 0)} end::int from dm)"""

GOALS = f"""ranked as (select *, row_number() over (partition by session_id, role order by turn_index desc) as back, count(*) over (partition by session_id) as n_turns from x),
rep as (select session_id, max(c) as c from (select session_id, {FP.format(20)} as fp, count(*) as c from x where role = 'user' and is_question group by 1, 2) where fp <> '' group by 1),
gf as (select session_id, bool_or(role = 'user' and back <= 2 and {rx('content', *L.goal_give_up)}) as f1, bool_or(role = 'user' and {rx('content', *L.goal_escalation)}) as f2, bool_or(role = 'user' and {rx('content', *L.goal_failure)}) as f3,
    max(turn_index) filter (role = 'assistant' and {rx('content', *L.goal_resolution)}) as solved, max(turn_index) filter (role = 'user' and is_question) as asked,
    coalesce(arg_max({rx('content', *L.goal_appreciation)} and length(trim(content)) <= 20, turn_index) filter (role = 'user'), false) as a2,
    max(n_turns) >= 4 and arg_max(emotion, turn_index) >= 65 and arg_max(emotion, turn_index) - avg(emotion) filter (turn_index <= greatest(1, n_turns // 3)) >= 15 as a3 from ranked group by 1),
gv as (select gf.*, coalesce(c >= 3, false) as f4, solved is not null and not coalesce(asked > solved, false) as a1 from gf left join rep using (session_id)),
gs as (select *, f1::int + f2::int + f3::int + f4::int as bad, a1::int + a2::int + a3::int as good from gv),
goal as (select *, case when bad > 0 and good = 0 then 'failed' when good > 0 and bad = 0 then 'achieved' when good > 0 then 'partial' else 'unclear' end as status from gs),
goals as (select *, case status when 'failed' then case when bad >= 2 then 1 else 2 end when 'achieved' then case when good >= 2 then 5 else 4 end else 3 end as score,
    (case status when 'failed' then 0.74 when 'achieved' then 0.76 when 'partial' then 0.6 else 0.45 end)::double as confidence from goal)"""

RECOVERY = f"""fc0 as (select session_id, min(turn_index) filter (emotion <= 40) as low, min(turn_index - 1) filter ({_drift}) as ign, min(turn_index) filter (role = 'user' and {rx('content', L.confusion)}) as conf from x group by 1),
fc as (select session_id, least(low, ign, conf) as ft, case when low is not null and low <= least(coalesce(ign, low), coalesce(conf, low)) then 'emotion-drop'
    when ign is not null and ign <= coalesce(conf, ign) then 'ignore' else 'understanding-barrier' end as kind from fc0 where coalesce(low, ign, conf) is not null),
fe as (select fc.*, coalesce(x.emotion, 40) as fs from fc left join x on x.session_id = fc.session_id and x.turn_index = fc.ft),
near as (select fe.session_id, x.turn_index, x.emotion >= 60 or x.emotion - fs >= 20 or {rx('x.content', *L.apology, *L.rephrase, *L.clarification)} as ok from fe join x on x.session_id = fe.session_id and x.role = 'assistant' and x.turn_index > ft and x.turn_index <= ft + 4),
pt as (select session_id, min(turn_index) filter (ok) as first_ok, max(turn_index) as last_any from near group by 1),
rv0 as (select goals.session_id, goals.status as goal, ft, coalesce(first_ok, case when goals.status in ('achieved', 'partial') then last_any end) as rt from goals left join fc using (session_id) left join pt using (session_id)),
rv as (select *, case when ft is null then 'none' when rt is null then 'failed' else 'completed' end as status from rv0)"""

KPI = f"""mv as (select 'objective' as source, 'resolution_rate' as metric, {clamp('resolution_rate', 0, 1, 4)} as value from o union all select 'objective', 'escalation_rate', {clamp('escalation_rate', 0, 1, 4)} from o
    union all select 'objective', 'question_repeat_rate', {clamp('question_repeat_rate', 0, 1, 4)} from o union all select 'objective', 'topic_switch_rate', {clamp('topic_switch_rate / 3', 0, 1, 4)} from o
    union all select 'objective', 'avg_response_gap_sec', {clamp('avg_response_gap_sec / 120', 0, 1, 4)} from o union all select 'subjective', dimension, {clamp('score / 5.0::double', 0, 1, 4)} from d
    union all select 'signal', signal_key, score from s union all select 'subjective', 'goal_completion', {clamp('avg(score / 5.0::double)', 0, 1, 4)} from goals),
refs as (select * from (values ('resolution_rate', 0.75, 0.5, 'subjective', 'goal_completion', 0.5), ('resolution_rate', 0.75, 0.5, 'objective', 'resolution_rate', 0.3), ('resolution_rate', 0.75, 0.5, 'objective', 'question_repeat_rate', -0.2),
    ('resolution_rate', 0.75, 0.5, 'signal', 'understanding_barrier', -0.2), ('escalation_control', 0.72, 0.48, 'objective', 'escalation_rate', -0.45), ('escalation_control', 0.72, 0.48, 'subjective', 'on_topic', 0.35),
    ('escalation_control', 0.72, 0.48, 'signal', 'recovery_failure', -0.2), ('escalation_control', 0.72, 0.48, 'objective', 'avg_response_gap_sec', -0.1), ('service_efficiency', 0.7, 0.45, 'objective', 'avg_response_gap_sec', -0.35),
    ('service_efficiency', 0.7, 0.45, 'objective', 'topic_switch_rate', -0.25), ('service_efficiency', 0.7, 0.45, 'objective', 'resolution_rate', 0.2), ('service_efficiency', 0.7, 0.45, 'signal', 'understanding_barrier', -0.1),
    ('service_efficiency', 0.7, 0.45, 'subjective', 'empathy', 0.1)) v(kpi, ok, deg, source, metric, w)),
al as (select kpi, ok, deg, w::double as w, {clamp('case when w >= 0 then coalesce(value, 0.5) else 1 - coalesce(value, 0.5) end', 0, 1, 4)} as a from refs left join mv using (source, metric)),
k as (select kpi, ok, deg, {clamp('sum(a * abs(w)) / sum(abs(w))', 0, 1, 4)} as score from al group by 1, 2, 3),
kpis as (select kpi, score, case when score >= ok then 'healthy' when score >= deg then 'degraded' else 'at_risk' end as status from k)"""

_TAGS = [
    ("emotion_drop", "low"), ("escalation_keyword", "esc"), ("goal_failed", "goal = 'failed'"), ("goal_partial", "goal = 'partial'"), ("goal_unclear", "goal = 'unclear'"), ("long_response_gap", "max_gap >= 60"), ("off_topic_shift", "(drifted or moved)"), ("question_repeat", "repeated"), ("recovery_failed", "rec = 'failed'"), ("understanding_barrier", "(confused or kws > 0)"),
]
CASES = f"""tf as (select session_id, seg, min(session_seq) as session_seq, coalesce(sum({WEIGHT}) filter (role = 'user'), 0) as kw, count({KEYWORD}) filter (role = 'user') as kws, coalesce(max(gap), 0) as max_gap, count(*) as n, count(*) filter (is_switch) as sw,
    bool_or(role = 'user' and {rx('content', L.confusion)}) as confused, bool_or({rx('content', L.case_escalation)}) as esc, bool_or(emotion <= 40) as low, bool_or(coalesce({_drift}, false)) as drifted from x group by 1, 2),
rq as (select distinct session_id, seg from (select session_id, seg, {FP.format(18)} as fp, count(*) as c from x where role = 'user' and is_question group by 1, 2, 3) where fp <> '' and c >= 2),
ev as (select signal_key, severity, case signal_key when 'interest_decline' then (select arg_max(session_id, (session_seq, turn_index)) from x where role = 'user')
    when 'understanding_barrier' then coalesce((select arg_min(session_id, (session_seq, turn_index)) from x where role = 'user' and {rx('content', L.confusion)}), (select arg_min(session_id, (session_seq, turn_index)) from x where role = 'user' and is_question), (select arg_min(session_id, (session_seq, turn_index)) from x))
    else coalesce((select arg_min(session_id, (session_seq, turn_index)) from low where unresolved), (select arg_min(session_id, (session_seq, turn_index)) from x where emotion <= 40), (select arg_min(session_id, (session_seq, turn_index)) from x)) end as sid from s),
hv0 as (select tf.*, (select count(*) from ev where severity = 'high' and sid = tf.session_id) as hs, sw > 0 or (select topic_switch_rate from o) >= 0.8 as moved, rq.seg is not null as repeated, goals.status as goal, rv.status as rec
    from tf left join rq using (session_id, seg) left join goals using (session_id) left join rv using (session_id)),
hv as (select *, least(1, {r('kw + case when max_gap >= 60 then 0.18::double else 0 end + case when n <= 2 and kws > 0 then 0.12::double else 0 end + case when moved then 0.1::double else 0 end + hs * 0.14::double', 4)}) as h from hv0),
cs as (select session_id, session_seq, seg, {clamp("h + case goal when 'failed' then 0.34::double when 'partial' then 0.2::double when 'unclear' then 0.12::double else 0 end + case when rec = 'failed' then 0.24::double else 0 end + case when repeated then 0.18::double else 0 end + case when confused then 0.16::double else 0 end + case when esc then 0.22::double else 0 end + case when low then 0.14::double else 0 end + case when drifted then 0.16::double else 0 end + case when max_gap >= 60 then 0.1::double else 0 end", 0, 1, 4)} as severity,
    list_filter([{', '.join(f"case when {test} then '{tag}' end" for tag, test in _TAGS)}], lambda v: v is not null) as tags from hv),
cases as (select * from cs where len(tags) > 0)"""

QUALITY = "case rv.status when 'none' then 0 when 'failed' then 1.6::double else " + clamp("5 - (rt - ft) * 0.5::double + case rv.goal when 'achieved' then 1 when 'partial' then 0.5::double when 'failed' then -0.6::double else 0 end", 0, 5, 1) + " end"
FULL = (*ALL, OBJECTIVE, SIGNALS, DIMENSIONS, GOALS, RECOVERY, KPI, CASES)
_REG = [("avg_response_gap_sec", "objective", 0, 0.78), ("topic_switch_rate", "objective", 0, 0.72), ("resolution_rate", "objective", 1, 0.68), ("goal_completion", "subjective", 1, 0.7), ("empathy", "subjective", 1, 0.68), ("on_topic", "subjective", 1, 0.68), ("service_call_grounding", "structured", 1, 0.85), ("service_result_availability", "structured", 1, 0.95), ("schema_slot_compliance", "structured", 1, 0.95), ("trace_step_efficiency", "trace", 1, 0.72), ("synthetic_coverage", "synthetic", 1, 0.5)]

_JUDGED = """gold as (select doc_id as case_id, 'quality' as dimension, (1 + 4 * quality)::double as gold from labels union all select doc_id, 'toxic', (1 + 4 * toxic)::double from labels),
judge as (select doc_id as case_id, 'quality' as dimension, (case when contains(text, '###') then 1 when length(text) - length(replace(text, ' ', '')) + 1 < 50 then 2 else 4 end)::double as predicted from documents
    union all select doc_id, 'toxic', (case when regexp_matches(text, 'idiot|moron|scum|trash|stupid') then 5 when contains(text, '!!') then 2 else 1 end)::double from documents),
pairs as (select * from gold join judge using (case_id, dimension))"""
_KAPPA = """mg as (select dimension, label, sum(g) as g, sum(p) as p from (select dimension, gb as label, 1 as g, 0 as p from bk union all select dimension, pb, 0, 1 from bk) group by 1, 2),
pe as (select dimension, count(*) as labels, sum(g::double * p) / (sum(g)::double * sum(g)) as pe from mg group by 1),
po as (select dimension, avg((gb = pb)::int) as po from bk group by 1),
kp as (select dimension, case when labels <= 1 or pe = 1 then 1 else %s end as kappa from pe join po using (dimension))""" % r("(po - pe) / (1 - pe)", 4)
_AGREE = f"""rk as (select *, rank() over (partition by dimension order by gold) + (count(*) over (partition by dimension, gold) - 1) / 2.0::double as rg, rank() over (partition by dimension order by predicted) + (count(*) over (partition by dimension, predicted) - 1) / 2.0::double as rp from pairs),
bk as (select dimension, least(5, greatest(1, floor(gold + 0.5))) as gb, least(5, greatest(1, floor(predicted + 0.5))) as pb from pairs),
{_KAPPA},
ag as (select dimension, count(*) as samples, {r('avg(abs(predicted - gold))', 4)} as mae, {r('sqrt(avg((predicted - gold) * (predicted - gold)))', 4)} as rmse,
    {r('coalesce((count(*) * sum(rg * rp) - sum(rg) * sum(rp)) / nullif(sqrt(count(*) * sum(rg * rg) - sum(rg) * sum(rg)) * sqrt(count(*) * sum(rp * rp) - sum(rp) * sum(rp)), 0), 0)', 4)} as spearman from rk group by 1),
agreed as (select * from ag join kp using (dimension))"""

_EVENTS = """ev as (select user_id as case_id, 's' || (event_id % 2)::varchar as service, event_id as turn_index, floor(value / 50)::bigint::varchar as v from events),
st as (select * from ev where turn_index % 3 <> 0 and turn_index % 7 <> 0), ca as (select * from ev where turn_index % 3 = 0), re as (select * from ev where turn_index % 7 = 0),
asof_rows as (select ca.case_id, ca.service, ca.turn_index, ca.v, max(st.turn_index) as state_turn, arg_max(st.v, st.turn_index) as sv from ca left join st on st.case_id = ca.case_id and st.service = ca.service and st.turn_index <= ca.turn_index group by 1, 2, 3, 4)"""
_SPANS = """sp as (select event_id as span_id, user_id as trace_id, case event_id % 4 when 0 then 'tool' when 1 then 'retrieval' else 'chat' end as kind, epoch_ms(ts) as start_ms, epoch_ms(ts) + 1000 * (event_id % 7) as end_ms, event_id % 5 <> 0 as is_pair from events)"""
_UNIT = "list_transform(embedding, lambda x: x::double)"
_COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
_KEYS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[^一-龥a-z0-9 ]', ' ', 'g'), ' +'), lambda x: length(x) >= 2))"
_TOXIC = ["傻逼", "白痴", "去死", "操你", "fuck", "shit", "idiot", "stupid", "滚", "废物", "垃圾", "无能", "去你妈"]

SQL: dict[str, str] = {
    "turn_order": chain(TURNS) + " select session_id, turn_index, role, ts_ms, active_hour from t",
    "response_gap": chain(TURNS) + " select session_id, turn_index, gap as response_gap_sec from t",
    "enriched_flags": chain(TURNS) + " select session_id, turn_index, is_dropoff, is_question, token_estimate, content_length from t",
    "dropoff_histogram": chain(TURNS) + " select turn_index, count(*) as sessions from t where is_dropoff group by 1",
    "depth_histogram": "select case when n <= 3 then '1-3' when n <= 8 then '4-8' else '9+' end as bucket, count(*) as sessions from (select conv_id, max(turn) + 1 as n from conversations group by 1) group by 1",
    "active_hour_by_role": chain(TURNS) + " select coalesce(active_hour::varchar, 'unknown') as hour, role, count(*) as turns from t group by 1, 2",
    "question_repeat_rate": chain(TURNS) + f", p as (select {FP.format(3)} as fp, count(*) as c from t where role = 'user' and is_question group by 1) select {r('sum(c - 1) / sum(c)::double', 4)} as repeat_rate, max(c) as most, sum(c - 1)::bigint as repeats from p where fp <> ''",
    "length_trend": chain(TURNS) + f", u as (select row_number() over (order by session_seq, turn_index) - 1 as i, content_length as y from t where role = 'user') select {r('regr_slope(y, i)', 4)} as length_trend from u",
    "domain_classify": chain(TURNS) + f" select session_id, turn_index, {domain(2)} as domain, {domain(3)} as hundredths from t",
    "negative_keyword_first": chain(TURNS) + f" select session_id, turn_index, {KEYWORD} as keyword, {WEIGHT} as weight from t where {KEYWORD} is not null",
    "row_segments": chain(TURNS, ROW_SEGMENTS) + """, dd as (select session_id, seg, own_domain, own_label, sum(hundredths) as total, min(turn_index) as seen from g group by 1, 2, 3, 4),
tp as (select session_id, seg, own_domain, own_label, row_number() over (partition by session_id, seg order by total desc, seen) as k from dd),
sg as (select session_id, seg, min(turn_index) as start_turn, max(turn_index) as end_turn, count(*) as message_count, avg(hundredths) as mean, left(coalesce(arg_min(content, turn_index) filter (role = 'user'), arg_min(content, turn_index)), 20) as head from g group by 1, 2)
select session_id, seg as topic_segment_index, session_id || '_topic_' || seg as topic_segment_id, own_label as topic, own_domain as topic_domain, own_label || case when head <> '' then '：' || head else '' end as topic_summary, """ + clamp('mean / 100', 0, 1, 2) + """ as topic_confidence, start_turn, end_turn, message_count from sg join tp using (session_id, seg) where k = 1""",
    "topic_segments": chain(TURNS, SEGMENTS) + " select session_id, turn_index, seg as topic_segment_index from g",
    "evaluate_sessions": chain(*FULL) + f", bc as (select session_id, count(*) as bad_cases, max(severity) as worst from cases group by 1) select b.*, goals.status as goal, goals.score as goal_score, rv.status as recovery, {QUALITY} as quality_score, bad_cases, worst from (select session_id, max(turn_index) as turns, max(seg) as segments, avg(emotion) as emotion from x group by 1) b join goals using (session_id) join rv using (session_id) left join bc using (session_id)",
    "emotion_baseline": chain(TURNS, SEGMENTS, CUES) + " select session_id, seg as topic_segment_index, neg as n_negative, pos as n_positive, polarity as emotion_polarity, intensity as emotion_intensity, base as emotion_base_score from c3",
    "emotion_factors": chain(*ALL) + " select session_id, seg as topic_segment_index, valence as valence_weight, len_w as length_weight, style as style_weight, gap_w as gap_weight, rec as recovery_weight, risk as risk_penalty, emotion as emotion_score from e",
    "objective_metrics": chain(TURNS, SEGMENTS, OBJECTIVE) + " select * from o",
    "turning_points": chain(*ALL) + f", m as (select *, emotion - lag(emotion) over (partition by session_id order by turn_index) as dl from x) select session_id, turn_index, case when dl > 0 then 'up' else 'down' end as direction, {r('dl', 1)} as score_delta from m where abs(dl) >= 12",
    "unresolved_low": chain(*ALL) + " select session_id, turn_index, emotion as emotion_score from x where emotion <= 40 and not exists (select 1 from x y where y.session_id = x.session_id and y.turn_index > x.turn_index and y.turn_index <= x.turn_index + 4 and y.emotion >= 60)",
    "interest_decline": chain(*ALL, SIGNALS) + " select signal_key, score, severity, confidence, (select arg_max(session_id || ':' || greatest(1, turn_index - 2) || '-' || turn_index, (session_seq, turn_index)) from x where role = 'user') as evidence_turn_range from s where signal_key = 'interest_decline'",
    "implicit_signals": chain(*ALL, SIGNALS) + " select signal_key, score, severity, confidence from s",
    "rule_dimensions": chain(*ALL, SIGNALS, DIMENSIONS) + " select dimension, score from d",
    "goal_verdict": chain(*ALL, GOALS) + " select session_id, status, score, confidence, array_to_string(list_filter([case when f1 then 'user-give-up' end, case when f2 then 'escalation-keyword' end, case when f3 then 'explicit-failure-phrase' end, case when f4 then 'user-repeat-question-3x' end, case when a1 then 'assistant-resolution-stated' end, case when a2 then 'user-appreciation-close' end, case when a3 then 'emotion-uplift-at-close' end], lambda v: v is not null), ',') as rules from goals",
    "failure_candidates": chain(*ALL, GOALS, RECOVERY) + " select session_id, ft as failure_turn, kind as failure_kind from fc",
    "recovery_window": chain(*ALL, GOALS, RECOVERY) + f" select session_id, status, ft as failure_turn, rt as recovery_turn, rt - ft as span_turns, {QUALITY} as quality_score from rv",
    "kpi_weighted": chain(*FULL) + " select kpi, score, status from kpis",
    "signal_projection": chain(*FULL) + " select 'run_business-kpi_' || replace(kpi, '_', '-') as id, 'run' as run_id, 'business_kpi' as kind, kpi as metric, score as value from kpis",
    "metric_passrate": chain(*FULL) + f", rg as (select * from (values {', '.join(str(x) for x in _REG)}) v(metric, source, more, thr)), rs as (select {clamp('case when more = 1 then value else 1 - value end', 0, 1, 4)} >= thr and value is not null as ok, value is null as skip from rg left join mv using (source, metric)), pr as (select count(*) filter (ok and not skip) as passed, count(*) filter (not ok and not skip) as failed, count(*) filter (skip) as skipped, {r('avg(ok::int) filter (not skip)', 4)} as pass_rate from rs) select *, case when pass_rate >= 0.6 then 'passed' else 'failed' end as gate from pr",
    "badcase_severity": chain(*FULL) + " select session_id, seg as topic_segment_index, severity, array_to_string(tags, '+') as tags from cases",
    "dominant_tags": chain(*FULL) + " select tag, count(*) as cases from (select unnest(tags) as tag from cases) group by 1 order by 2 desc, 1 limit 3",
    "severity_topk": chain(*FULL) + " select session_id, seg as topic_segment_index, severity from cases order by severity desc, session_seq, seg limit 10",
    "switch_counts": chain(TURNS, SEGMENTS) + " select session_id, count(*) filter (is_switch) as switches from g group by 1",
    "eval_cases": "select conv_id::varchar as session_id, arg_min(text, turn) filter (role = 'user') as input, arg_max(text, turn) filter (role = 'assistant') as actual_output, count(*) as turn_count from conversations group by 1",
    "pii_email": "select doc_id, len(regexp_extract_all(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b'))::int as pii_hits, length(regexp_replace(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b', '[REDACTED_EMAIL]', 'g'))::int as redacted_length from documents where regexp_matches(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b')",
    "keyword_overlap": f"with p as (select conv_id::varchar as session_id, coalesce(arg_min(text, turn) filter (role = 'user'), '') as a, coalesce(arg_max(text, turn) filter (role = 'assistant'), '') as b from conversations group by 1), q as (select session_id, {_KEYS.format('a')} as x, {_KEYS.format('b')} as y from p) select session_id, {r('coalesce(len(list_intersect(x, y)) / nullif(len(x), 0)::double, 0)', 2)} as overlap from q",
    "cosine_topk": f"with v as (select vec_id, {_UNIT} as v from embeddings), p as (select a.vec_id as query_id, b.vec_id as item_id, {r(_COS, 4)} as similarity from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0), k as (select *, row_number() over (partition by query_id order by similarity desc, item_id)::int as rank from p) select * from k where rank <= 5",
    "vector_classes": "select vec_id, min(vec_id) over (partition by embedding) as representative, count(*) over (partition by embedding) as copies from embeddings",
    "similarity_pairs": f"with v as (select min(vec_id) as vec_id, {_UNIT} as v from embeddings group by embedding), p as (select a.vec_id as a, b.vec_id as b, {r(_COS, 4)} as similarity from v a join v b on a.vec_id < b.vec_id) select * from p where similarity >= 0.35",
    "cluster_medoids": f"with v as (select vec_id, label, {_UNIT} as v from embeddings), p as (select a.label, a.vec_id, sum({_COS}) as c from v a join v b on a.label = b.label group by 1, 2), k as (select *, row_number() over (partition by label order by {r('c', 6)} desc, vec_id) as k, count(*) over (partition by label) as size from p) select label, size, vec_id as medoid from k where k = 1",
    "stratified_sample": "with u as (select source, md5(text) as h, min(doc_id) as doc_id from documents group by 1, 2), k as (select source, doc_id, row_number() over (partition by source order by md5('seed:' || doc_id), doc_id)::int as rank from u) select * from k where rank <= 5",
    "agreement_scores": chain(_JUDGED, _AGREE) + " select dimension, samples, mae, rmse, spearman, kappa from agreed",
    "agreement_overall": chain(_JUDGED, _AGREE) + f" select sum(samples)::bigint as samples, {r('avg(mae)', 4)} as mae, {r('avg(rmse)', 4)} as rmse, {r('avg(spearman)', 4)} as spearman, {r('avg(kappa)', 4)} as kappa from agreed",
    "agreement_status": chain(_JUDGED, "bk as (select dimension, case when gold > 3 then 'toxic' else 'clean' end as gb, case when predicted > 3 then 'toxic' else 'clean' end as pb from pairs where dimension = 'toxic')", _KAPPA) + f" select (select count(*) from bk) as samples, (select {r('avg((gb = pb)::int)', 4)} from bk) as accuracy, kappa from kp",
    "judge_drift": chain(_JUDGED) + f", m as (select dimension, case when case_id % 3 = 0 then 1.0::double else 0 end as dl from judge) select dimension, count(*) as cases, {r('avg(dl)', 4)} as avg_delta, {r('max(abs(dl))', 4)} as max_delta, abs({r('avg(dl)', 4)}) >= 0.4 as warns from m group by 1",
    "asof_state": chain(_EVENTS) + " select case_id, service, turn_index, state_turn from asof_rows",
    "call_grounding": chain(_EVENTS) + f" select service, count(*) as calls, {r('avg(case when state_turn is null then 0 when sv = v then 1 else 0 end)', 4)} as grounding from asof_rows group by 1",
    "semi_results": chain(_EVENTS) + " select service, count(*) as answered from ca where exists (select 1 from re where re.turn_index // 10 = ca.turn_index // 10 and re.service = ca.service) group by 1",
    "anti_unknown": "select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
    "tool_turn_counter": chain(_SPANS) + ", w as (select *, coalesce(sum((kind = 'chat' and is_pair)::int) over (partition by trace_id order by start_ms, span_id rows between unbounded preceding and 1 preceding), 0)::bigint as turn_index from sp) select span_id, trace_id, turn_index from w where kind = 'tool'",
    "prior_retrievals": chain(_SPANS) + " select c.span_id, count(b.span_id) as retrievals, arg_max(b.span_id, (b.end_ms, b.span_id)) as last_retrieval from sp c left join sp b on b.trace_id = c.trace_id and b.kind = 'retrieval' and b.end_ms <= c.start_ms where c.kind = 'chat' group by 1",
    "latest_upsert": "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) where k = 1",
    "trend_points": f"with d as (select strftime(ts, '%Y-%m-%d') as run_id, {r('avg(value)', 2)} as avg_emotion, {r('avg((value > 50)::int) * 100', 1)} as goal_percent, sum((event_type = 'error')::int)::bigint as bad_cases, {r('avg(value / 1000) * 100', 1)} as kpi_percent from events group by 1) select * from d order by run_id desc limit 20",
    "offline_regression": f"with m as (select {r('s.s_acctbal::double / 10000 - c.c_acctbal::double / 10000', 4)} as dl from customer c left join supplier s on s.s_suppkey = c.c_custkey) select count(*) as total, count(dl) as executed, count(*) - count(dl) as skipped, count(*) filter (dl >= 0.03) as improved, count(*) filter (dl <= -0.03) as regressed, {r('avg(dl)', 4)} as avg_delta, count(dl) > 0 and count(*) filter (dl <= -0.03) <= 0 as passed from m",
    "fact_retention": chain(TURNS) + " select f.session_id, f.turn_index as introduced, coalesce(contains(string_agg(a.content, ' ' order by a.turn_index), left(any_value(f.content), 8)), false) as retained from t f left join t a on a.session_id = f.session_id and a.role = 'assistant' and a.turn_index > f.turn_index where f.role = 'user' group by 1, 2",
    "lexicon_toxicity": "with h as (select doc_id, " + " + ".join(f"contains(lower(text), '{w}')::int" for w in _TOXIC) + f" as hits from documents) select doc_id, hits::int as hits, {r('greatest(0, 1 - hits * 0.3::double)', 2)} as score from h where hits > 0",
    "vector_components": f"with recursive v as (select vec_id, {_UNIT} as v from embeddings), p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where {r(_COS, 4)} >= 0.35), c(vec_id, label) as (select vec_id, vec_id from v union select p.b, c.label from c join p on p.a = c.vec_id) select vec_id, min(label) as cluster from c group by 1",
    "summary_cards": chain(*FULL) + f""", w as (select (select count(distinct session_id) from x) as ss, (select count(*) from x) as tt, (select {r('avg(emotion)', 1)} from x) as em, (select avg((status = 'achieved')::int) from goals) as gr, o.* from o)
select 'sessions' as key, ss::varchar as value from w union all select 'turns', tt::varchar from w union all select 'avg_emotion', em::varchar from w union all select 'goal_completion', floor(gr * 100 + 0.5)::int::varchar || '%' from w
union all select 'avg_gap', avg_response_gap_sec::varchar || 's' from w union all select 'topic_switch_rate', floor(topic_switch_rate * 100 + 0.5)::int::varchar || '%' from w union all select 'question_rate', floor(user_question_rate * 100 + 0.5)::int::varchar || '%' from w""",
    "synthesis_plan": """with p as (select i, ['goal_failed', 'off_topic_shift', 'recovery_failed'] as modes from (select doc_id as i from documents)), q as (select i, case when i % 5 <> 0 then modes[i % 2 + 2] else modes[i % 3 + 1] end as m from p),
s as (select i, m, i + length(m) as sh, floor((0.68::double + 0.12::double + (i % 4) * 0.04::double) * 100 + 0.5) / 100 as r0 from q), t as (select *, least(0.95::double, r0) as rarity from s)
select i + 1 as cell, m as failure_mode, ['impatient', 'novice', 'expert', 'anxious', 'loyal'][i % 5 + 1] as persona, ['add_constraint', 'switch_tone', 'inject_noise', 'multi_turn', 'missing_context', 'contradict'][sh % 6 + 1] as operator_1,
    ['add_constraint', 'switch_tone', 'inject_noise', 'multi_turn', 'missing_context', 'contradict'][(sh + 3) % 6 + 1] as operator_2, rarity, case when rarity >= 0.78 then 'hard' when rarity >= 0.52 then 'medium' else 'easy' end as difficulty from t""",
}

SQL |= more_sql()
