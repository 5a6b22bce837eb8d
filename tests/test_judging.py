"""Calibration against recorded agreement, similarity, regression gates and stores."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from confera.operators import balls, calibration, regression, similarity, store

#: Gold and judge scores of four cases in four dimensions, goals and recoveries; with the agreement recorded for them.
GOLD = {"empathy": [4, 3, 4, 5], "on_topic": [4, 5, 4, 5], "not_preachy": [5, 4, 5, 4], "recovery": [3, 3, 5, 5], "goal": [4, 5, 3, 5], "trace": [0, 0, 4, 5]}
JUDGE = {"empathy": [1, 1, 3, 1], "on_topic": [5, 5, 5, 3], "not_preachy": [5, 5, 5, 5], "recovery": [4, 4, 4, 1], "goal": [4, 3, 2, 3], "trace": [0, 0, 0, 1.6]}
RECORDED = {"empathy": (2.5, 2.7386, 0.0, -0.0667), "on_topic": (1.0, 1.2247, -0.5774, -0.2), "not_preachy": (0.5, 0.7071, 0.0, 0.0), "recovery": (1.75, 2.1794, -0.5774, 0.0), "goal": (1.25, 1.5, 0.3333, 0.0769), "trace": (1.85, 2.6249, 0.8165, 0.2)}


def frame(spark, table):
    return spark.createDataFrame([(f"c{k}", d, float(x), None) for d, xs in table.items() for k, x in enumerate(xs)], "case_id string, dimension string, score double, error string")


def test_recorded_agreement(spark):
    got = calibration.agreement(calibration.score_pairs(frame(spark, GOLD), frame(spark, JUDGE)))
    rows = {r.dimension: r for r in got.collect()}
    for d, want in RECORDED.items():
        assert (rows[d].mae, rows[d].rmse, rows[d].spearman, rows[d].kappa) == pytest.approx(want, abs=1e-4), d
    o = calibration.overall_agreement(got.filter(F.col("dimension").isin("empathy", "on_topic", "not_preachy", "recovery"))).head()
    assert (o.samples, o.mae, o.rmse, o.spearman, o.kappa) == pytest.approx((16, 1.4375, 1.7125, -0.2887, -0.0667), abs=1e-4)


def test_recorded_status_agreement(spark):
    pairs = lambda rows: calibration.status_agreement(spark.createDataFrame(rows, "gold_status string, predicted_status string")).head()
    goal = pairs([("achieved", "achieved"), ("achieved", "unclear"), ("partial", "failed"), ("achieved", "unclear")])
    assert (goal.accuracy, goal.kappa) == pytest.approx((0.25, 0.0769), abs=1e-4)
    trace = pairs([("none", "none"), ("none", "none"), ("completed", "none"), ("completed", "failed")])
    assert (trace.accuracy, trace.kappa) == pytest.approx((0.5, 0.2), abs=1e-4)
    assert pairs([("a", "a"), ("a", "a")]).kappa == 1.0


def test_edges_of_spearman(spark):
    one = spark.createDataFrame([("c", "d", 3.0, 2.0)], "case_id string, dimension string, gold double, predicted double")
    assert calibration.agreement(one).head().spearman is None
    flat = spark.createDataFrame([(str(k), "d", 3.0, float(k)) for k in range(4)], "case_id string, dimension string, gold double, predicted double")
    assert calibration.agreement(flat).head().spearman == 0.0


def test_drift_and_gate(spark):
    drift = calibration.judge_drift(frame(spark, JUDGE), frame(spark, JUDGE).withColumn("score", F.col("score") + 0.5))
    assert all(r.warns and r.avg_delta == 0.5 for r in drift.collect())
    overall = calibration.overall_agreement(calibration.agreement(calibration.score_pairs(frame(spark, GOLD), frame(spark, JUDGE))))
    status = calibration.status_agreement(spark.createDataFrame([("a", "a"), ("b", "a")], "gold_status string, predicted_status string"))
    checks = {r.check: r.passed for r in calibration.judge_gate(overall, status, status, drift).collect()}
    assert checks["overall_mae"] and not checks["drift:empathy"]


def test_gold_labels(spark):
    df = spark.createDataFrame([("a", [("x", 3.0), ("y", 9.0)], "approved"), ("b", [("x", 1.0), ("y", 2.0)], "approved"), ("c", [("x", 1.0)], None)], "case_id string, dimensions array<struct<dimension:string,score:double>>, status string")
    got = {r.case_id: r.errors for r in calibration.validate_labels(df, ["x", "y"]).collect()}
    assert got == {"a": ["range:y"], "b": [], "c": ["missing:y", "not-approved"]}
    people = [r.assignee for r in calibration.assign_round_robin(df, ["p", "q"]).orderBy("case_id").collect()]
    assert people == ["p", "q", "p"]


def brute_pairs(vectors, least):
    import math

    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    return {(i, j) for i in range(len(vectors)) for j in range(i + 1, len(vectors)) if math.floor(cos(vectors[i], vectors[j]) * 1e4 + 0.5) / 1e4 >= least}


def test_similar_pairs_of_many_rows_are_exact(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    vectors = [[x + rng.gauss(0, 1) for x in centres[k % 5]] for k in range(100)]  # alike at about 0.5
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "id bigint, v array<double>")
    zeros = spark.range(1000, 21_000).selectExpr("id", "array_repeat(0.0D, 64) as v")
    got = [(r.a, r.b) for r in balls.similar_pairs(df.unionByName(zeros), "id", "v", 0.35).collect()]
    want = brute_pairs(vectors, 0.35)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    classes = {r.id: (r.representative, r.copies) for r in similarity.vector_classes(df.unionByName(zeros), "id", "v").collect()}
    assert classes[5] == (5, 1) and classes[20_000] == (1000, 20_000) and len(classes) == 20_100


def test_similar_pairs_and_components(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    vectors = [[x + rng.gauss(0, 0.15) for x in centres[k % 6]] for k in range(60)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "id bigint, v array<double>")
    want = brute_pairs(vectors, 0.93)
    exact = {(r.a, r.b) for r in balls.similar_pairs(df, "id", "v", 0.93, tile=10).collect()}
    assert exact == want and want
    comps = {r.id: r.cluster for r in similarity.components(df, spark.createDataFrame(list(want), "a bigint, b bigint"), "id").collect()}
    assert all(comps[a] == comps[b] for a, b in want) and all(comps[k] <= k for k in comps)


def test_top_matches_are_exact(spark):
    rng = random.Random(2)
    vectors = {k: [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)] for k in range(60)}
    df = spark.createDataFrame([(k, v) for k, v in vectors.items()] + [(99, None)], "id bigint, v array<double>")
    got = {(r.query_id, r["rank"]): (r.item_id, r.similarity) for r in similarity.top_matches(df.filter("id % 20 = 0"), df, "id", "v", 3, tile=7).collect()}

    def sim(a, b):
        n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return math.floor(sum(x * y for x, y in zip(a, b)) / n * 1e4 + 0.5) / 1e4 if n else 0.0

    for q in (0, 20, 40):
        want = sorted((-sim(vectors[q], v), k) for k, v in vectors.items() if k != q)[:3]
        assert [got[q, n + 1] for n in range(3)] == [(k, -s) for s, k in want]


def test_chain_is_one_component(spark):
    nodes = spark.createDataFrame([(k,) for k in range(50)], "id bigint")
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 48)], "a bigint, b bigint")
    got = {r.id: r.cluster for r in similarity.components(nodes, links, "id").collect()}
    assert got == {k: 0 if k < 49 else 49 for k in range(50)}


def test_duplicate_layers(spark):
    schema = "case_id string, hash string, embedding array<double>, metrics array<double>, tags array<string>"
    pool = spark.createDataFrame([("p1", "h1", [1.0, 0.0], [0.1, 0.2], ["a"]), ("p2", "h2", [0.0, 1.0], [0.9, 0.9], ["b"])], schema)
    cands = spark.createDataFrame([("x", "h1", [0.5, 0.5], [0.5, 0.5], ["z"]), ("y", "h9", [0.99, 0.01], [0.5, 0.5], ["z"]), ("z", "h8", [0.7, 0.7], [0.9, 0.85], ["b"]), ("w", "h7", [0.7, 0.7], [0.5, 0.5], ["q"])], schema)
    got = {r.case_id: (r.layer, r.matched_id) for r in similarity.duplicate_layer(cands, pool).collect()}
    assert got == {"x": ("exact", "p1"), "y": ("semantic", "p1"), "z": ("structural", "p2"), "w": ("none", None)}


def test_case_links_and_summary(spark):
    schema = "case_id string, hash string, duplicate_group string, embedding array<double>, metrics array<double>, tags array<string>, severity double"
    rows = [("a", "h", "g1", [1.0, 0.0], [0.0], ["t"], 0.5), ("b", "h", "g2", [0.0, 1.0], [0.9], ["u"], 0.7), ("c", "k", "g2", [0.1, 1.0], [0.9], ["u"], 0.9), ("d", "m", "g3", [0.7, -0.7], [0.4], ["v"], 0.1)]
    cases = spark.createDataFrame(rows, schema)
    comps = similarity.components(cases, similarity.case_links(cases), "case_id")
    assert {r.case_id: r.cluster for r in comps.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}
    top = similarity.cluster_summary(comps.join(cases, "case_id")).head()
    assert (top["size"], top.avg_severity, top.representative) == (3, 0.7, "c")


def test_regression(spark):
    before = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5)], "case_id string, score double")
    after = spark.createDataFrame([("a", 0.53), ("b", 0.46)], "case_id string, score double")
    r = regression.offline_regression(before, after).head()
    assert (r.total, r.executed, r.skipped, r.improved, r.regressed, r.avg_delta, r.passed) == (3, 2, 1, 1, 1, -0.005, False)
    steps = spark.createDataFrame([("x", "1", True), ("x", "2", False), ("y", "1", None), ("z", "1", True)], "scope string, item string, passed boolean")
    assert {r.scope: r.status for r in regression.workflow_status(steps).collect()} == {"x": "partial", "y": "ready", "z": "passed"}
    links = spark.createDataFrame([("r1", "v1", "partial"), ("r2", "v2", "passed"), ("r3", None, "passed"), ("r4", "v9", "passed")], "run_id string, validation_id string, baseline_status string")
    vals = spark.createDataFrame([("v1", "passed"), ("v2", "failed")], "validation_id string, status string")
    deltas = regression.release_readiness(links, vals)
    assert {r.run_id: r.delta for r in deltas.collect()} == {"r1": "improved", "r2": "regressed", "r3": "not_linked", "r4": "missing"}
    assert regression.readiness_status(deltas).head().status == "blocked"


def test_synthesis(spark):
    plan = regression.synthesis_plan(spark, 12).collect()
    assert all(0.12 <= r.rarity <= 0.95 for r in plan) and {r.difficulty for r in plan} == {"hard"}
    made = spark.createDataFrame([(None, "hard", 0.5, 0.9), ("m", "hard", 1.0, 1.0), ("m", "easy", None, None)], "failure_mode string, difficulty string, rarity double, quality double")
    assert [r.baseline_score for r in regression.synthesis_baseline(made).collect()] == [0.86, 0.364, 0.55]
    cases = spark.createDataFrame([("a", 1, "m", True, "m", 6, True, True, "x" * 100, True, 1), ("b", 2, "m", True, "m", 6, True, True, "x" * 100, True, 1), ("c", 3, None, False, "m", 1, True, False, "y", False, 0)], "case_id string, seq int, cell_mode string, has_cell boolean, failure_mode string, n_turns int, has_user boolean, has_assistant boolean, norm string, covers boolean, operators int")
    got = {r.case_id: (r.score, r.accepted) for r in regression.synthesis_quality(cases, 4, 8).collect()}
    assert got == {"a": (1.0, True), "b": (0.6, False), "c": (0.08, False)}


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 3, "new"), ("j", 2, "x")], "id string, updated_at int, v string")
    assert {r.id: r.v for r in store.upsert(rows, rows.limit(0), ["id"]).collect()} == {"k": "new", "j": "x"}
    assert [r.v for r in store.listing(rows, 1, id="k").collect()] == ["new"]
    store.write_results({"t": rows}, f"{tmp_path}/out", "r1")
    assert spark.read.parquet(f"{tmp_path}/out/t").filter("run_id = 'r1'").count() == 3
    near = store.near_duplicates(spark.createDataFrame([("a", "t", 0.5)], "case_id string, topic string, score double"), spark.createDataFrame([("b", "t", 0.1), ("c", "u", 0.5)], "case_id string, topic string, score double"))
    assert [(r.match_id, r.matches) for r in near.collect()] == [("b", 1)]
    rng = random.Random(8)
    cases = [(k, rng.choice(["hot", "hot", "t", None]), rng.choice([0.0, 1.0, 1.5, 2.0, 3.0, 4.5, 7.0])) for k in range(80)]
    df = spark.createDataFrame(cases, "case_id bigint, topic string, score double")
    got = {r.case_id: (r.matches, r.match_id, r.stored_score) for r in store.near_duplicates(df, df.filter("case_id % 3 > 0")).collect()}
    for k, topic, score in cases:
        met = sorted((abs(s - score), j, s) for j, t, s in cases if topic is not None and t == topic and j % 3 and j != k and abs(s - score) <= 2)
        assert got[k] == (len(met), *((met[0][1], met[0][2]) if met else (None, None)))
    pool = spark.createDataFrame([(k, f"s{k % 2}", f"h{k % 5}") for k in range(20)], "id bigint, stratum string, hash string")
    got = similarity.stratified_sample(pool, "stratum", "id", "hash", 3).collect()
    assert len(got) == 6 and len({(r.stratum, r.hash) for r in got}) == 6


def _near(a, b):
    cosine = sum(x * y for x, y in zip(a[1], b[1])) / math.sqrt(sum(x * x for x in a[1]) * sum(x * x for x in b[1]))
    far = math.sqrt(sum((x - y) ** 2 for x, y in zip(a[2], b[2])) / len(a[2]))
    tags = len(a[3] ^ b[3]) / len(a[3] | b[3])
    r = lambda x: math.floor(x * 1e4 + 0.5) / 1e4
    return r(cosine), r(far), r(tags)


def _made_cases(rng, n, start=0):
    out = []
    for k in range(n):
        base = rng.randrange(6)
        out.append((start + k, [math.sin(base + j) + rng.gauss(0, rng.choice([0.05, 0.3, 1])) for j in range(8)], [min(1.0, max(0.0, base / 6 + rng.gauss(0, 0.1))) for _ in range(5)], set(rng.sample(["a", "b", "c"], rng.randint(1, 2))), f"h{rng.randrange(40)}" if rng.random() < 0.3 else f"u{start + k}", rng.choice(["g1", "g1", "g2"])))
    return out


CASE = "case_id bigint, embedding array<double>, metrics array<double>, tags array<string>, hash string, duplicate_group string"


def test_case_links_against_brute_force(spark):
    rng = random.Random(4)
    cases = _made_cases(rng, 60)
    cases += [(100 + k, *cases[k][1:]) for k in range(10)]  # copies of features
    df = spark.createDataFrame([(i, e, m, sorted(t), h, g) for i, e, m, t, h, g in cases], CASE)
    want = set()
    for x, a in enumerate(cases):
        for b in cases[:x]:
            cosine, far, tags = _near(a, b)
            if a[4] == b[4] or cosine >= 0.93 or (a[5] == b[5] and ((cosine >= 0.86 and far <= 0.22) or (far <= 0.12 and tags <= 0.2))):
                want.add((a[0], b[0]))
    closure = lambda links: {frozenset(s) for s in _joined([c[0] for c in cases], links).values()}
    got = {(r.a, r.b) for r in similarity.case_links(df, tile=9).collect()}
    assert closure(got) == closure(want) and 3 < len(closure(want)) < 60 and len(got) < len(want) + 70


def _joined(nodes, links):
    of = {n: {n} for n in nodes}
    for a, b in links:
        if of[a] is not of[b]:
            of[a] |= of[b]
            for x in of[b]:
                of[x] = of[a]
    return of


def test_duplicate_layer_against_brute_force(spark):
    rng = random.Random(5)
    pool, new = _made_cases(rng, 50), _made_cases(rng, 40, 1000)
    frame = lambda rows: spark.createDataFrame([(i, e, m, sorted(t), h, g) for i, e, m, t, h, g in rows], CASE)
    got = {r.case_id: (r.layer, r.matched_id) for r in similarity.duplicate_layer(frame(new), frame(pool)).collect()}
    seen = Counter()
    for c in new:
        exact = [p[0] for p in pool if p[4] == c[4]]
        semantic = min((-_near(c, p)[0], p[0]) for p in pool)
        structural = min(((_near(c, p)[1], p[0]) for p in pool if p[3] == c[3]), default=(9, None))
        want = ("exact", min(exact)) if exact else ("semantic", semantic[1]) if -semantic[0] >= 0.95 else ("structural", structural[1]) if structural[0] <= 0.1 else ("none", None)
        assert got[c[0]] == want
        seen[want[0]] += 1
    assert len(seen) == 4


def test_harvest(spark):
    new = spark.createDataFrame([(1, 10, "a"), (2, 11, "b"), (3, 12, "a"), (4, 13, "z"), (5, 9, "c")], "case_id bigint, seq bigint, hash string")
    stored = spark.createDataFrame([(90, "z"), (91, "z")], "case_id bigint, hash string")
    assert {r.case_id: (r.saved, r.matched_id) for r in similarity.harvest_cases(new, stored).collect()} == {1: (True, None), 2: (True, None), 3: (False, 1), 4: (False, 90), 5: (True, None)}
    rng = random.Random(6)
    order = list(range(40))
    rng.shuffle(order)
    near = [(a, b) for a in range(40) for b in range(a) if rng.random() < 0.06]
    cases = spark.createDataFrame([(c, k) for k, c in enumerate(order)], "case_id bigint, seq bigint")
    saved = set()
    for c in order:
        if not any((c, s) in near or (s, c) in near for s in saved):
            saved.add(c)
    got = {r.case_id for r in similarity.harvest_strictly(cases, spark.createDataFrame(near, "a bigint, b bigint")).filter("saved").collect()}
    assert got == saved


def test_remediation_package_and_replay(spark):
    rows = [(f"s{k}", k, sev, tags) for k, (sev, tags) in enumerate([(0.3, ["goal_partial"]), (0.9, ["recovery_failed", "long_response_gap"]), (0.5, ["question_repeat"]), (0.5, ["emotion_drop"]), (0.2, ["escalation_keyword"]), (0.1, ["goal_failed"])])]
    cases = spark.createDataFrame(rows, "topic_segment_id string, session_seq int, severity double, tags array<string>").withColumn("topic_segment_index", F.lit(1))
    selected = regression.select_cases(cases)
    assert [(r.topic_segment_id, r.priority, r.edit_scope) for r in selected.collect()] == [("s1", "P0", ["orchestration", "code"]), ("s2", "P1", ["orchestration"]), ("s3", "P1", ["prompt", "orchestration"]), ("s0", "P2", ["prompt"]), ("s4", "P0", ["policy"])]
    package = regression.remediation_package(selected)
    head = package.first()
    assert (head.cases, head.priority, head.edit_scope, head.dominant_tags) == (5, "P0", ["prompt", "policy", "orchestration", "code"], ["emotion_drop", "escalation_keyword", "goal_partial", "long_response_gap", "question_repeat"])
    values = spark.createDataFrame([("goal_completion_rate", 0.8), ("recovery_completion_rate", 0.25), ("emotion_recovery_score", 2.0), ("user_question_repeat_rate", 0.2), ("empathy_score", 4.5), ("escalation_keyword_hit_rate", 0.05), ("avg_response_gap_sec", 31.4), ("scenario_average_score", 0.6)], "metric string, value double")
    targets = regression.target_metrics(package, values)
    assert {r.metric: (r.direction, r.current, r.target) for r in targets.collect()} == {
        "goal_completion_rate": ("increase", 0.8, 0.95), "recovery_completion_rate": ("increase", 0.25, 0.6), "emotion_recovery_score": ("increase", 2.0, 4.0), "user_question_repeat_rate": ("decrease", 0.2, 0.12), "empathy_score": ("increase", 4.5, 5.0),
        "escalation_keyword_hit_rate": ("decrease", 0.05, 0.0), "avg_response_gap_sec": ("decrease", 31.4, 21.0), "scenario_average_score": ("increase", 0.6, 0.75),
    }
    assert regression.target_metrics(package, values.filter("metric <> 'scenario_average_score'")).filter("metric = 'scenario_average_score'").isEmpty()
    guards = regression.acceptance_guards(package, targets)
    now = spark.createDataFrame([("goal_completion_rate", 0.96), ("recovery_completion_rate", 0.7), ("emotion_recovery_score", 4.0), ("user_question_repeat_rate", 0.1), ("empathy_score", 4.0), ("escalation_keyword_hit_rate", 0.0), ("avg_response_gap_sec", 40.0), ("scenario_average_score", 0.8)], "metric string, value double")
    results = regression.replay_targets(targets, now)
    held = {r.guard: (r.value, r.passed) for r in regression.guard_results(guards, results, values, now).collect()}
    assert held["max_regressions"] == (2.0, False) and held["dangerous_reply_count"] == (0.0, True) and held["goal_completion_rate_min"] == (0.96, True) and held["avg_response_gap_sec_max"] == (40.0, False) and held["avg_latency_regression_max_ratio"] == (1.2739, False)
    out = regression.replay_validation(results, regression.guard_results(guards, results, values, now)).first()
    assert (out.metrics, out.improved, out.regressed, out.win_rate, out.gate) == (8, 6, 2, 0.75, "failed")
    assert regression.replay_validation(results).first().gate == "passed" and regression.replay_validation(results.limit(0)).first().win_rate == 1.0


def test_labels_are_validated_and_imported(spark):
    dims = "array<struct<dimension:string,score:double,evidence:string>>"
    full = [(d, 3.0, "said so") for d in calibration.GOLD_DIMENSIONS]
    rows = [
        ("a", full, "approved", "x", "y", "2026-01-01", ("achieved", 4.0, ["e"]), ("none", 0.0)), ("b", full[:3], "approved", "x", " ", "2026-01-01", ("achieved", 4.0, []), ("none", 1.0)), ("c", full, "draft", "x", "y", "z", ("lost", 6.0, [" "]), ("failed", None)),
        ("q", [*full[:3], ("recovery", 7.0, "")], "approved", "x", "y", "z", ("failed", 0.0, ["e"]), ("completed", 5.0)), ("n", full, None, None, None, None, None, None),
    ]
    labels = spark.createDataFrame(rows, f"case_id string, dimensions {dims}, status string, labeler string, reviewer string, reviewed_at string, goal struct<status:string,score:double,evidence:array<string>>, trace struct<status:string,quality:double>")
    known = spark.createDataFrame([(c,) for c in "abcn"], "case_id string")
    checked = calibration.validate_labels(labels, cases=known)
    errors = {r.case_id: set(r.errors) for r in checked.collect()}
    assert errors["a"] == set() and errors["b"] == {"missing:recovery", "reviewer", "goal:evidence", "trace:none"}
    assert errors["c"] == {"goal:status", "goal:score", "goal:evidence", "trace:quality", "not-approved"} and errors["q"] == {"range:recovery", "evidence:recovery", "unknown-case"}
    assert {"labeler", "reviewer", "reviewed_at", "goal:status", "trace:status", "not-approved"} <= errors["n"]
    come, counts = calibration.import_labels(checked)
    assert [r.case_id for r in come.collect()] == ["a"] and tuple(counts.first()) == (1, 2, 2)


def test_gold_set_work(spark):
    rows = "array<struct<role:string,content:string>>"
    cases = spark.createDataFrame([("B 2", [("user", "x"), ("assistant", "y"), ("user", "z")], " note"), ("a1", [], None)], f"case_id string, rows {rows}, notes string")
    tasks = {r.case_id: tuple(r)[2:] + (r.task_id,) for r in calibration.annotation_tasks(cases, "v2", ["p", "q"], ["r"]).collect()}
    assert tasks == {"B 2": ("P1", "draft", "p", "r", 3, 2, 1, True, "v2_b-2_label"), "a1": ("P1", "draft", "q", "r", 0, 0, 0, False, "v2_a1_label")}
    drafts = spark.createDataFrame([("a", "approved", False), ("b", "approved", True), ("c", "draft", False)], "case_id string, review_status string, no_evidence boolean")
    r = calibration.coverage_readiness(spark.range(4), drafts, spark.range(2), 5).first()
    assert (r.cases, r.approved, r.case_gap, r.approved_gap, r.pool_ready, r.labels_ready, r.imported_all, r.evidence_ready) == (4, 2, 1, 2, False, False, True, False)
    assert [tuple(x) for x in calibration.count_by(drafts, F.nullif(F.col("review_status"), F.lit("draft"))).collect()] == [("approved", 2), ("unassigned", 1)]
    runs = lambda rows: spark.createDataFrame(rows, "case_id string, goal_completion double, recovery_trace double")
    drift = {r.field: (r.cases, r.avg_delta, r.warns) for r in calibration.field_drift(runs([("a", 3.0, None), ("b", 4.0, None)]), runs([("a", 4.0, 2.0), ("b", 4.0, 1.0), ("c", 1.0, 1.0)])).collect()}
    assert drift == {"goal_completion": (2, 0.5, True), "recovery_trace": (0, None, False)}


def test_near_metrics_are_met_in_blocks(monkeypatch):
    import numpy as np
    import pandas as pd

    from confera.operators import balls

    rng = np.random.default_rng(3)
    m = np.round(rng.random((240, 15)) * 0.35, 4)
    tags = pd.Series([sorted(rng.choice(list("abcdef"), size=n, replace=False)) for n in rng.integers(0, 7, 240)])
    left, right = np.arange(0, 130), np.arange(110, 240)
    monkeypatch.setattr(similarity, "BLOCK", 1500)
    far = balls.rounded(np.sqrt(((m[:, None] - m[None]) ** 2).sum(axis=2)) / np.sqrt(15))
    apart = np.array([[0 if not set(a) | set(b) else round(len(set(a) ^ set(b)) / len(set(a) | set(b)), 4) for b in tags] for a in tags])
    want = {(i, j) for i in left for j in right if i != j and far[i, j] <= 0.12 and apart[i, j] <= 0.2}
    got = {(i, j) for x, y in similarity._near_in_metrics(m, tags, left, right, balls.Forest(np.arange(240)), 0.12, 0.2) for i, j in zip(x.tolist(), y.tolist()) if far[i, j] <= 0.12}
    assert got == want and want
    parts, made = balls.Forest(np.arange(240)), 0
    for x, y in similarity._near_in_metrics(m, tags, left, right, parts, 0.12, 0.2):
        made += len(x)
        close = far[x, y] <= 0.12
        parts.join(x[close], y[close])
    assert made <= len(want) + 20_000 and {(parts.root[i], parts.root[j]) for i, j in want} == {(parts.root[i],) * 2 for i, _ in want}
