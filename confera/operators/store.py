"""Stored results: keyed upserts, the signal star schema, case registries and canonical files."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confera.functions.text import customer_id, evidence_range, run_file_id, stable_id

CANONICAL = ["session_id", "timestamp", "role", "content"]


def use_shared_folder(spark) -> str:
    """The folder that checkpoints go to: spark.checkpoint.dir. Unset, it is an error on a cluster, and a folder of this machine where the master is local."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        found = "file://" + tempfile.mkdtemp(prefix="confera-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: max_by, which combines before it shuffles."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*key, "__r.*")


def upsert(stored: DataFrame, new: DataFrame, key: list[str], order: str = "updated_at") -> DataFrame:
    return latest(stored.unionByName(new), key, [order])


def listing(rows: DataFrame, most: int, order: str = "updated_at", **equal: str) -> DataFrame:
    for c, v in equal.items():
        rows = rows.filter(F.col(c) == v)
    return rows.orderBy(F.desc(order)).limit(most)


def project_signals(run_id: str, values: DataFrame) -> DataFrame:
    """values: kind, metric, value. Rows of the signal tables, each with a stable id."""
    return values.select(stable_id(F.lit(run_id), F.col("kind"), F.col("metric")).alias("id"), F.lit(run_id).alias("run_id"), "kind", "metric", F.col("value").cast("double").alias("value"))


def project_evaluation(run_id: str, evaluation) -> dict[str, DataFrame]:  # noqa: ANN001
    """The seven tables of one evaluation; evidence once per id."""
    from confera.operators.metrics import metrics_long

    e = evaluation
    segments = e.enriched.groupBy("topic_segment_id").agg(F.first("session_id").alias("session_id"), F.first("topic").alias("topic"), F.min("turn_index").alias("start_turn"), F.max("turn_index").alias("end_turn"), F.first("emotion_score").alias("emotion_score"))
    spans = e.signals.select("signal_key", "evidence", evidence_range(F.col("evidence_turn_range")).alias("r")).select(stable_id(F.lit(run_id), F.col("signal_key"), F.col("r.session_id"), F.col("r.start_turn")).alias("id"), "r.*", "evidence").dropDuplicates(["id"])
    return {
        "evaluation_runs": e.enriched.agg(F.lit(run_id).alias("run_id"), F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("turns")),
        "topic_segments": segments, "objective_signals": project_signals(run_id, metrics_long(e.objective).withColumn("kind", F.lit("objective"))), "subjective_signals": project_signals(run_id, e.dimensions.select(F.lit("subjective").alias("kind"), F.col("dimension").alias("metric"), F.col("score").alias("value"))),
        "business_kpi_signals": project_signals(run_id, e.kpis.select(F.lit("business_kpi").alias("kind"), F.col("kpi").alias("metric"), F.col("score").alias("value"))), "evidence_spans": spans, "risk_tags": e.bad_cases.select("topic_segment_id", F.explode("tags").alias("tag")),
    }


def write_canonical_csv(turns: DataFrame, path: str) -> None:
    turns.orderBy("session_seq", "turn_index").select(F.col("session_id").alias("sessionId"), "timestamp", "role", "content").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# The header of the enriched CSV, in order, with the column that each takes.
ENRICHED_CSV = {
    "sessionId": "session_id", "timestamp": "timestamp", "role": "role", "content": "content", "turnIndex": "turn_index", "topic": "topic", "topicSegmentId": "topic_segment_id", "topicSegmentIndex": "topic_segment_index", "topicSummary": "topic_summary",
    "topicStartTurn": "start_turn", "topicEndTurn": "end_turn", "topicSource": "topic_source", "topicConfidence": "topic_confidence", "emotionPolarity": "emotion_polarity", "emotionIntensity": "emotion_intensity", "emotionLabel": "emotion_label",
    "emotionBaseScore": "emotion_base_score", "emotionScore": "emotion_score", "emotionEvidence": "emotion_evidence", "emotionSource": "emotion_source", "emotionConfidence": "emotion_confidence", "emotionValenceWeight": "valence_weight",
    "emotionLengthWeight": "length_weight", "emotionStyleWeight": "style_weight", "emotionGapWeight": "gap_weight", "emotionRecoveryWeight": "recovery_weight", "emotionRiskPenalty": "risk_penalty", "responseGapSec": "response_gap_sec",
    "isDropoffTurn": "is_dropoff", "isQuestion": "is_question", "isTopicSwitch": "is_topic_switch", "activeHour": "active_hour", "tokenCountEstimate": "token_estimate",
}


def enriched_csv(enriched: DataFrame) -> DataFrame:
    """The 33 columns as text, null as empty, lists joined by |. A column that the table lacks is empty."""
    kinds = dict(enriched.dtypes)

    def text(column: str):  # noqa: ANN202
        if column not in kinds:
            return F.lit("")
        c = F.col(column)
        return F.coalesce(F.array_join(c, "|") if kinds[column].startswith("array") else F.regexp_replace(c.cast("string"), r"\.0$", "") if kinds[column] in ("double", "float") else c.cast("string"), F.lit(""))

    return enriched.select(*[text(column).alias(name) for name, column in ENRICHED_CSV.items()])


def write_enriched_csv(enriched: DataFrame, path: str) -> None:
    enriched_csv(enriched).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def save_baseline(snapshot: DataFrame, path: str, customer: str, run_id: str) -> None:
    """Stores the rows of one run of one customer; storing it again replaces them. Names become safe parts of the path."""
    one = snapshot.sparkSession.range(1).select(customer_id(F.lit(customer)).alias("c"), run_file_id(F.lit(run_id)).alias("r")).first()
    snapshot.write.mode("overwrite").parquet(f"{path}/customer={one.c}/run={one.r}")


def read_baselines(spark, path: str) -> DataFrame:
    """Every stored row with customer and run; filters on these two read only the folders they need."""
    return spark.read.parquet(path)


def find_baseline(baselines: DataFrame, run_id: str, customer: str | None = None) -> DataFrame:
    """The rows of a run: of the customer, or of the first customer by name that has it."""
    of_run = baselines.filter(F.col("run").cast("string") == run_file_id(F.lit(run_id)))
    if customer is not None:
        return of_run.filter(F.col("customer").cast("string") == customer_id(F.lit(customer)))
    return of_run.join(of_run.agg(F.min("customer").alias("customer")), "customer", "left_semi")


def baseline_list(baselines: DataFrame, customer: str) -> DataFrame:
    """run, created_at, label of a customer's baselines, the latest first."""
    own = baselines.filter(F.col("customer").cast("string") == customer_id(F.lit(customer)))
    return own.groupBy("run").agg(F.max("created_at").alias("created_at"), F.max("label").alias("label")).orderBy(F.desc("created_at"), "run")


# The columns of the index of a case registry.
CASE_INDEX = ["case_id", "case_set_type", "topic_label", "baseline_case_score", "baseline_version", "duplicate_group_key", "created_at"]


def case_index(cases: DataFrame) -> DataFrame:
    """A row of each stored case, the latest where a case was stored again; a missing group is empty."""
    kept = latest(cases, ["case_id"], ["created_at"])
    return kept.select(*[F.coalesce("duplicate_group_key", F.lit("")).alias(c) if c == "duplicate_group_key" else F.col(c) for c in CASE_INDEX])


def case_manifest(cases: DataFrame) -> DataFrame:
    """case_set_type, case_count, updated_at."""
    return cases.groupBy("case_set_type").agg(F.count_distinct("case_id").alias("case_count"), F.max("created_at").alias("updated_at"))


def append_cases(cases: DataFrame, path: str) -> None:
    """Adds cases to the registry, a folder for each set type; readers see whole appends."""
    cases.write.mode("append").partitionBy("case_set_type").parquet(path)


def write_results(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Parquet by run: a run is written again without touching others."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/run_id={run_id}")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def preview(df: DataFrame, rows: int = 20, order: list[str] | None = None) -> DataFrame:
    """The first rows, in an order if one is given: each task keeps as many, and those meet."""
    return (df.orderBy(*order) if order else df).limit(rows)


def near_duplicates(case: DataFrame, stored: DataFrame, within: float = 2.0) -> DataFrame:
    """case with matches (stored cases of its topic whose score is within reach, itself left out) and the best one's match_id
    and stored_score: the nearest score, then the least id.

    Stored cases of one topic and score are one counted row with its two least ids, and scores meet by bands of the reach, so
    a topic of any size is counted and never lists its pairs.
    """
    band = F.floor(F.col("score") / within).cast("bigint")
    two = F.slice(F.array_sort(F.array_agg("case_id")), 1, 2)
    # Two groupings: the least ids of a hot score come together in parts.
    part = stored.groupBy("topic", "score", F.pmod(F.xxhash64("case_id"), F.lit(256)).alias("part")).agg(F.count(F.lit(1)).alias("n"), two.alias("ids"))
    known = part.groupBy("topic", "score").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, 2).alias("ids")).select("topic", F.col("score").alias("stored_score"), "n", "ids", band.alias("band"))
    asked = case.select("topic", "score").distinct().select("topic", "score", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    met = asked.join(known, ["topic", "band"]).withColumn("far", F.abs(F.col("score") - F.col("stored_score"))).filter(F.col("far") <= within)
    near = met.select("topic", "score", "n", F.transform("ids", lambda i: F.struct(F.col("far").alias("far"), i.alias("match_id"), F.col("stored_score").alias("stored_score"))).alias("best"))
    near = near.groupBy("topic", "score").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, 2).alias("best"))
    own = stored.select("case_id", "topic", "score").distinct().withColumn("own", F.lit(1))
    out = case.join(near, ["topic", "score"], "left").join(own, ["case_id", "topic", "score"], "left")
    best = F.get(F.filter("best", lambda b: b["match_id"] != F.col("case_id")), F.lit(0))
    return out.select(*case.columns, (F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("matches"), best["match_id"].alias("match_id"), best["stored_score"].alias("stored_score"))
