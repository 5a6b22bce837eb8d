"""The queries over the driver tables, one per operator or group of them; each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confera.functions import pii, text
from confera.functions.lexicon import SYNTHETIC
from confera.operators import badcase, balls, calibration, dialogue, emotion, extended, kpi, metrics, outcomes, regression, segment, sessionize, signals, similarity, store, traces
from confera.plans import case_queries, source_queries, text_queries  # noqa: F401  register their queries
from confera.plans.evaluate import Evaluation
from confera.plans.registry import QUERIES, raw_turns, table
from confera.plans.registry import query as registered

query = registered()


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize.flag_turns(raw_turns(spark, sf_dir), SYNTHETIC)


def evaluated(spark: SparkSession, sf_dir: str) -> Evaluation:
    return Evaluation(raw_turns(spark, sf_dir), SYNTHETIC).keep()


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.topic_segments(flagged(spark, sf_dir), SYNTHETIC)


@query
def turn_order(spark, sf_dir):
    raw = raw_turns(spark, sf_dir).withColumn("ingest_seq", F.col("turn_index")).drop("turn_index", "active_hour")
    return sessionize.number_turns(raw).select("session_id", "turn_index", "role", "ts_ms", "active_hour")


@query
def response_gap(spark, sf_dir):
    return flagged(spark, sf_dir).select("session_id", "turn_index", "response_gap_sec")


@query
def enriched_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("session_id", "turn_index", "is_dropoff", "is_question", "token_estimate", "content_length")


@query
def dropoff_histogram(spark, sf_dir):
    return metrics.dropoff_histogram(flagged(spark, sf_dir))


@query
def depth_histogram(spark, sf_dir):
    return metrics.depth_histogram(raw_turns(spark, sf_dir))


@query
def active_hour_by_role(spark, sf_dir):
    return metrics.active_hours(raw_turns(spark, sf_dir), "role")


@query
def question_repeat_rate(spark, sf_dir):
    return metrics.repeat_rate(flagged(spark, sf_dir), 3)


@query
def length_trend(spark, sf_dir):
    return metrics.length_trend(flagged(spark, sf_dir))


@query
def domain_classify(spark, sf_dir):
    return raw_turns(spark, sf_dir).select("session_id", "turn_index", SYNTHETIC.domain(F.col("content")).alias("d")).select("session_id", "turn_index", "d.domain", "d.hundredths")


@query
def negative_keyword_first(spark, sf_dir):
    return raw_turns(spark, sf_dir).select("session_id", "turn_index", SYNTHETIC.keyword(F.col("content")).alias("k")).filter("k is not null").select("session_id", "turn_index", "k.keyword", "k.weight")


@query
def row_segments(spark, sf_dir):
    """Segments by the running-sum part of the rules, described."""
    return segment.describe_segments(segment.row_splits(flagged(spark, sf_dir), SYNTHETIC))


@query
def topic_segments(spark, sf_dir):
    """The sequential scan with all rules."""
    return segment.topic_segments(flagged(spark, sf_dir), SYNTHETIC).select("session_id", "turn_index", "topic_segment_index")


@query
def emotion_baseline(spark, sf_dir):
    cues = emotion.emotion_cues(segmented(spark, sf_dir), SYNTHETIC)
    return emotion.emotion_baseline(cues).select("session_id", "topic_segment_index", "n_negative", "n_positive", "emotion_polarity", "emotion_intensity", "emotion_base_score")


@query
def emotion_factors(spark, sf_dir):
    scored = emotion.segment_emotions(segmented(spark, sf_dir), SYNTHETIC)
    return scored.select("session_id", "topic_segment_index", "valence_weight", "length_weight", "style_weight", "gap_weight", "recovery_weight", "risk_penalty", "emotion_score")


@query
def objective_metrics(spark, sf_dir):
    return evaluated(spark, sf_dir).objective


@query
def turning_points(spark, sf_dir):
    return evaluated(spark, sf_dir).turning_points


@query
def unresolved_low(spark, sf_dir):
    return signals.unresolved_low(evaluated(spark, sf_dir).enriched).filter("unresolved").select("session_id", "turn_index", "emotion_score")


@query
def interest_decline(spark, sf_dir):
    return signals.interest_decline(evaluated(spark, sf_dir).enriched).select("signal_key", "score", "severity", "confidence", "evidence_turn_range")


@query
def implicit_signals(spark, sf_dir):
    return evaluated(spark, sf_dir).signals.select("signal_key", "score", "severity", "confidence")


@query
def rule_dimensions(spark, sf_dir):
    return evaluated(spark, sf_dir).dimensions


@query
def goal_verdict(spark, sf_dir):
    return evaluated(spark, sf_dir).goals.select("session_id", "status", "score", "confidence", F.array_join("triggered_rules", ",").alias("rules"))


@query
def failure_candidates(spark, sf_dir):
    return outcomes.failure_candidates(evaluated(spark, sf_dir).enriched, SYNTHETIC).select("session_id", "failure_turn", "failure_kind")


@query
def recovery_window(spark, sf_dir):
    return evaluated(spark, sf_dir).recoveries.select("session_id", "status", "failure_turn", "recovery_turn", "span_turns", "quality_score")


@query
def kpi_weighted(spark, sf_dir):
    return evaluated(spark, sf_dir).kpis.select("kpi", "score", "status")


@query
def metric_passrate(spark, sf_dir):
    return kpi.pass_rate(evaluated(spark, sf_dir).registry)


@query
def badcase_severity(spark, sf_dir):
    return evaluated(spark, sf_dir).bad_cases.select("session_id", "topic_segment_index", "severity", F.array_join("tags", "+").alias("tags"))


@query
def dominant_tags(spark, sf_dir):
    return badcase.dominant_tags(evaluated(spark, sf_dir).bad_cases)


@query
def severity_topk(spark, sf_dir):
    """The ten worst cases: a report."""
    return badcase.by_severity(evaluated(spark, sf_dir).bad_cases, 10).select("session_id", "topic_segment_index", "severity")


@query
def summary_cards(spark, sf_dir):
    return evaluated(spark, sf_dir).summary


@query
def evaluate_sessions(spark, sf_dir):
    """The flagship: every stage, with the sequential segmentation."""
    return evaluated(spark, sf_dir).sessions


@query
def switch_counts(spark, sf_dir):
    return metrics.switch_counts(evaluated(spark, sf_dir).enriched)


@query
def eval_cases(spark, sf_dir):
    return kpi.eval_cases(raw_turns(spark, sf_dir)).select("session_id", "input", "actual_output", "turn_count")


@query
def pii_email(spark, sf_dir):
    email = [p for p in pii.PATTERNS if p[0] == "email"]
    return pii.redact(table(spark, sf_dir, "documents"), "text", email).filter("pii_hits > 0").select("doc_id", "pii_hits", F.length("text").alias("redacted_length"))


@query
def pii_full(spark, sf_dir):
    redacted = pii.redact(table(spark, sf_dir, "documents"), "text")
    return redacted.filter("pii_hits > 0").select("doc_id", "pii_hits", F.array_join("pii_categories", ",").alias("categories"))


@query
def keyword_overlap(spark, sf_dir):
    """Of each conversation, the overlap of its first user message with its last assistant message."""
    return kpi.eval_cases(raw_turns(spark, sf_dir)).select("session_id", text.keyword_overlap(F.coalesce("input", F.lit("")), F.coalesce("actual_output", F.lit(""))).alias("overlap"))


@query
def cosine_topk(spark, sf_dir):
    """The five nearest vectors of every twentieth vector: the query set is fixed, the search covers all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return similarity.top_matches(vectors.filter("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 5).select("query_id", "item_id", "similarity", "rank")


@query
def similarity_pairs(spark, sf_dir):
    """Pairs of different vectors; vector_classes tells which vectors a representative stands for."""
    return balls.similar_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.35)


@query
def vector_classes(spark, sf_dir):
    return similarity.vector_classes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query
def vector_components(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    same = similarity.vector_classes(vectors, "vec_id", "embedding").select(F.col("vec_id").alias("a"), F.col("representative").alias("b"))
    links = balls.similar_links(vectors, "vec_id", "embedding", 0.35).unionByName(same.filter("a <> b"))
    return similarity.components(vectors, links, "vec_id")


@query
def cluster_medoids(spark, sf_dir):
    return similarity.medoids(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select("label", "size", "medoid")


@query
def stratified_sample(spark, sf_dir):
    """Five documents of each source, of distinct texts, in a seeded order: a sampling operator."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("hash"))
    return similarity.stratified_sample(docs, "source", "doc_id", "hash", 5).select("source", "doc_id", "rank")


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """labels as gold scores (1 to 5), and scores by a rule on the text as a judge's."""
    docs, gold = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    unpack = lambda c: F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), x.cast("double").alias("score")) for d, x in c.items()])).alias("x")
    labels = gold.select(F.col("doc_id").alias("case_id"), unpack({"quality": 1 + 4 * F.col("quality"), "toxic": 1 + 4 * F.col("toxic")})).select("case_id", "x.*")
    words = F.length("text") - F.length(F.translate("text", " ", "")) + 1
    rules = {"quality": F.when(F.contains("text", F.lit("###")), 1).when(words < 50, 2).otherwise(4), "toxic": F.when(F.col("text").rlike("idiot|moron|scum|trash|stupid"), 5).when(F.contains("text", F.lit("!!")), 2).otherwise(1)}
    return labels, docs.select(F.col("doc_id").alias("case_id"), unpack(rules)).select("case_id", "x.*")


@query
def agreement_scores(spark, sf_dir):
    return calibration.agreement(calibration.score_pairs(*judged(spark, sf_dir)))


@query
def agreement_overall(spark, sf_dir):
    return calibration.overall_agreement(calibration.agreement(calibration.score_pairs(*judged(spark, sf_dir))))


@query
def agreement_status(spark, sf_dir):
    pairs = calibration.score_pairs(*judged(spark, sf_dir)).filter("dimension = 'toxic'")
    return calibration.status_agreement(pairs.select(F.when(F.col("gold") > 3, "toxic").otherwise("clean").alias("gold_status"), F.when(F.col("predicted") > 3, "toxic").otherwise("clean").alias("predicted_status")))


@query
def judge_drift(spark, sf_dir):
    _, judge = judged(spark, sf_dir)
    moved = judge.withColumn("score", F.col("score") + F.when(F.col("case_id") % 3 == 0, 1.0).otherwise(0.0))
    return calibration.judge_drift(judge, moved)


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events as dialogue annotations: most are states, every third a call, every seventh a result of a user's service."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string")).alias("service"), F.col("event_id").alias("turn_index"), "event_type", F.floor(F.col("value") / 50).cast("string").alias("slot_value"))
    n = F.col("turn_index")
    kinds = {k: e.filter(test).drop("event_type") for k, test in (("call", n % 3 == 0), ("result", n % 7 == 0), ("state", (n % 3 != 0) & (n % 7 != 0)))}
    as_map = lambda d, c: d.withColumn(c, F.create_map(F.lit("amount"), F.array("slot_value"))).drop("slot_value")
    return as_map(kinds["state"], "slot_values"), as_map(kinds["call"], "parameters"), kinds["result"].drop("slot_value")


@query
def asof_state(spark, sf_dir):
    state, call, _ = states(spark, sf_dir)
    return dialogue.latest_state(call, state).select("case_id", "service", "turn_index", "state_turn")


@query
def call_grounding(spark, sf_dir):
    state, call, _ = states(spark, sf_dir)
    return dialogue.call_grounding(call, state).groupBy("service").agg(F.count(F.lit(1)).alias("calls"), text.js_round(F.avg("grounded"), 4).alias("grounding"))


@query
def semi_results(spark, sf_dir):
    _, call, result = states(spark, sf_dir)
    near = result.withColumn("turn_index", F.floor(F.col("turn_index") / 10))
    return dialogue.answered_calls(call.withColumn("turn_index", F.floor(F.col("turn_index") / 10)), near).groupBy("service").agg(F.count(F.lit(1)).alias("answered"))


@query
def anti_unknown(spark, sf_dir):
    """Documents that no label knows, as references without a definition."""
    return dialogue.unknown_references(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query
def tool_turn_counter(spark, sf_dir):
    """events as spans of traces: the number of chat pairs that a trace has completed before each tool span."""
    return traces.turns_before(event_spans(spark, sf_dir)).filter("kind = 'tool'").select("span_id", "trace_id", "turn_index")


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 4 == 0, "tool").when(F.col("event_id") % 4 == 1, "retrieval").otherwise("chat")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.col("event_id").alias("span_id"), F.col("user_id").alias("trace_id"), kind.alias("kind"), ms.alias("start_ms"), (ms + 1000 * (F.col("event_id") % 7)).alias("end_ms"), F.col("props").alias("input"), (F.col("event_id") % 5 != 0).alias("is_pair"))


@query
def prior_retrievals(spark, sf_dir):
    return traces.retrievals_before(event_spans(spark, sf_dir)).select("span_id", "retrievals", "last_retrieval")


@query
def latest_upsert(spark, sf_dir):
    """The last event of each user and type, as upserts keep it."""
    e = table(spark, sf_dir, "events").withColumnRenamed("ts", "updated_at")
    return store.latest(e, ["user_id", "event_type"], ["updated_at", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query
def trend_points(spark, sf_dir):
    """Runs are days of events."""
    e = table(spark, sf_dir, "events")
    runs = e.select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.date_trunc("day", "ts").alias("generated_at"), F.col("value").alias("emotion"), (F.col("value") > 50).alias("achieved"), (F.col("event_type") == "error").cast("int").alias("bad_cases"), (F.col("value") / 1000).alias("kpi"))
    return metrics.trend_points(runs).select("run_id", "avg_emotion", "goal_percent", "bad_cases", "kpi_percent")


@query
def offline_regression(spark, sf_dir):
    """Customers as cases: their balance against that of the supplier of the same key, as scores before and after."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    before = c.select(F.col("c_custkey").alias("case_id"), (F.col("c_acctbal") / 10000).cast("double").alias("score"))
    after = s.select(F.col("s_suppkey").alias("case_id"), (F.col("s_acctbal") / 10000).cast("double").alias("score"))
    return regression.offline_regression(before, after)


@query
def signal_projection(spark, sf_dir):
    return store.project_signals("run", evaluated(spark, sf_dir).kpis.select(F.lit("business_kpi").alias("kind"), F.col("kpi").alias("metric"), F.col("score").alias("value")))


@query
def fact_retention(spark, sf_dir):
    """Whether what a user says first is taken up by a later assistant turn, by its first eight characters."""
    turns = raw_turns(spark, sf_dir)
    facts = turns.filter("role = 'user'").select("session_id", F.col("turn_index").alias("introduced"), F.col("content").alias("fact"))
    return extended.knowledge_retention(facts, turns).select("session_id", "introduced", "retained")


@query
def lexicon_toxicity(spark, sf_dir):
    return extended.toxicity_by_lexicon(table(spark, sf_dir, "documents"), "doc_id", F.col("text")).filter("hits > 0")


@query
def synthesis_plan(spark, sf_dir):
    """A coverage cell for each document as a seed, by its number."""
    return regression.plan_cells(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))
