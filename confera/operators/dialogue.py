"""Metrics of schema-guided dialogues: states, calls, results and references to a schema.

Frames hold: case_id, turn_index, role, service, actions (array of struct act, slot), slots (array of struct slot, start,
exclusive_end), state (struct active_intent, slot_values map to arrays, requested_slots), call (struct method, parameters
map to arrays), results (count).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confera.functions.text import js_round, ratio

#: Fixed values.
TRANSACTIONS = "(?i)(Reserve|Book|Buy|Transfer|Payment|Make|Add)"
CONFIRMING = "(?i)(CONFIRM|OFFER|NOTIFY_SUCCESS)"
IGNORED_ACTION_SLOTS = ("intent", "count")


def actions(frames: DataFrame) -> DataFrame:
    return frames.select("case_id", "turn_index", "role", "service", F.explode("actions").alias("a")).select("case_id", "turn_index", "role", "service", "a.act", "a.slot")


def slot_mentions(frames: DataFrame, utterance: str = "utterance") -> DataFrame:
    """Spans with their text; spans that don't fit the utterance go."""
    spans = frames.select("case_id", "turn_index", "service", utterance, F.explode("slots").alias("s"))
    fits = (F.col("s.start") >= 0) & (F.col("s.exclusive_end") > F.col("s.start")) & (F.col("s.exclusive_end") <= F.length(utterance))
    return spans.filter(fits).select("case_id", "turn_index", "service", "s.slot", F.substr(F.col(utterance), F.col("s.start") + 1, F.col("s.exclusive_end") - F.col("s.start")).alias("value"))


def states(frames: DataFrame) -> DataFrame:
    return frames.filter("state is not null").select("case_id", "turn_index", "service", "state.*")


def calls(frames: DataFrame) -> DataFrame:
    return frames.filter("call is not null").select("case_id", "turn_index", "service", "call.*")


def latest_state(call: DataFrame, state: DataFrame) -> DataFrame:
    """Each call with the latest state of its case and service up to its turn (as-of, left): state_turn, slot_values.

    One window over the union of both, so a call meets one row and not all states before it.
    """
    key = ["case_id", "service"]
    marked = state.select(*key, "turn_index", F.struct(F.col("turn_index").alias("turn"), "slot_values").alias("state"), F.lit(0).alias("is_call"), F.lit(None).cast(call.select(F.struct("*")).schema[0].dataType).alias("own"))
    asked = call.select(*key, "turn_index", F.lit(None).cast(marked.schema["state"].dataType).alias("state"), F.lit(1).alias("is_call"), F.struct("*").alias("own"))
    upto = Window.partitionBy(*key).orderBy("turn_index", "is_call").rowsBetween(Window.unboundedPreceding, 0)
    met = marked.unionByName(asked).withColumn("s", F.last("state", ignorenulls=True).over(upto)).filter("is_call = 1")
    return met.select("own.*", F.col("s.turn").alias("state_turn"), F.col("s.slot_values").alias("slot_values"))


def call_grounding(call: DataFrame, state: DataFrame) -> DataFrame:
    """Calls with grounded: the share of parameters whose values the latest state holds; 1 without parameters, 0 without a state."""
    met = latest_state(call, state)
    held = lambda k, v: F.forall(v, lambda x: F.coalesce(F.array_contains(F.coalesce(F.try_element_at("slot_values", k), F.array().cast("array<string>")), x), F.lit(False)))
    fit = F.size(F.map_filter("parameters", held))
    return met.withColumn("grounded", F.when(F.size("parameters") == 0, 1.0).when(F.col("state_turn").isNull(), 0.0).otherwise(fit / F.size("parameters")))


def answered_calls(call: DataFrame, result: DataFrame, strict: bool = False) -> DataFrame:
    """Calls with a result of the same turn and service; of the same case too if strict."""
    return call.join(result.select("turn_index", "service", *(["case_id"] if strict else [])).distinct(), ["turn_index", "service", *(["case_id"] if strict else [])], "left_semi")


def confirmed_calls(call: DataFrame, frames: DataFrame) -> DataFrame:
    """Transactional calls with confirmed: an assistant frame of the case and service confirmed or offered before them."""
    first = actions(frames).filter((F.col("role") == "assistant") & F.col("act").rlike(CONFIRMING)).groupBy("case_id", "service").agg(F.min("turn_index").alias("first"))
    met = call.filter(F.col("method").rlike(TRANSACTIONS)).join(first, ["case_id", "service"], "left")
    return met.withColumn("confirmed", F.coalesce(F.col("first") < F.col("turn_index"), F.lit(False)))


def slot_references(frames: DataFrame) -> DataFrame:
    """case_id, service, slot of every mention: a bag, not a set."""
    st, key = states(frames), ["case_id", "service"]
    parts = [
        actions(frames).filter(F.col("slot").isNotNull() & ~F.col("slot").isin(*IGNORED_ACTION_SLOTS)).select(*key, "slot"), slot_mentions(frames).select(*key, "slot"), st.select(*key, F.explode(F.map_keys("slot_values")).alias("slot")),
        st.select(*key, F.explode("requested_slots").alias("slot")), calls(frames).select(*key, F.explode(F.map_keys("parameters")).alias("slot")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.coalesce(F.col("slot"), F.lit("")) != "")


def unknown_references(references: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    return references.join(known.select(*on).distinct(), on, "left_anti")


def one_schema_each(schema: DataFrame) -> DataFrame:
    """The first schema row of each service."""
    return schema.withColumn("k", F.row_number().over(Window.partitionBy("service").orderBy("seq"))).filter("k = 1").drop("k")


def known_rate(references: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """references, unknown, rate (1 with no reference)."""
    met = references.join(known.select(*on).distinct().withColumn("known", F.lit(True)), on, "left")
    return met.agg(F.count(F.lit(1)).alias("references"), F.count_if(F.col("known").isNull()).alias("unknown")).withColumn("rate", ratio(F.col("references") - F.col("unknown"), F.col("references"), 1.0))


def _mean(df: DataFrame, value: Column, otherwise: float) -> DataFrame:
    return df.agg(js_round(F.coalesce(F.avg(value), F.lit(otherwise)), 4).alias("v"))


def structured_metrics(frames: DataFrame, schema: DataFrame) -> DataFrame:
    """metric, value. schema: service, seq, intents (array), slots (array)."""
    schema = one_schema_each(schema)
    st, ca = states(frames), calls(frames)
    result = frames.filter("results > 0").select("case_id", "turn_index", "service")
    hit = answered_calls(ca, result).agg(F.count(F.lit(1)).alias("hit")).join(ca.agg(F.count(F.lit(1)).alias("n"))).select(js_round(ratio(F.col("hit"), F.col("n")), 4).alias("v"))
    counts = frames.agg(
        F.count_distinct("case_id").alias("case_count"), F.count_distinct("service").alias("service_count"), F.count(F.lit(1)).alias("frame_count"), F.coalesce(F.sum(F.size("actions")), F.lit(0)).alias("action_count"),
        F.count("state").alias("dialogue_state_count"), F.count("call").alias("service_call_count"), F.count_if(F.col("results") > 0).alias("service_result_count"),
    )
    mentions = slot_mentions(frames).agg(F.count(F.lit(1)).alias("slot_mention_count"))
    sized = schema.agg(F.count(F.lit(1)).alias("schema_service_count"), F.coalesce(F.sum(F.size("intents")), F.lit(0)).alias("schema_intent_count"), F.coalesce(F.sum(F.size("slots")), F.lit(0)).alias("schema_slot_count"))
    intents = st.filter("active_intent is not null and active_intent not in ('', 'NONE')").select("service", F.col("active_intent").alias("intent"))
    named = lambda df, metric: df.select(F.lit(metric).alias("metric"), F.col("v").cast("double").alias("value"))
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("x")).select("x.*")
    out = long(counts).unionByName(long(mentions)).unionByName(long(sized))
    checks = [("schema_service", frames.select("service").distinct(), schema, ["service"]), ("schema_intent", intents, schema.select("service", F.explode("intents").alias("intent")), ["service", "intent"]), ("schema_slot", slot_references(frames), schema.select("service", F.explode("slots").alias("slot")), ["service", "slot"])]
    for name, refs, known, on in checks:
        r = known_rate(refs, known, on)
        out = out.unionByName(named(r.select(js_round(F.col("rate"), 4).alias("v")), f"{name}_coverage_rate")).unionByName(named(r.select(F.col("unknown").alias("v")), f"unknown_{name}_references"))
    rates = {
        "intent_coverage_rate": _mean(st, (F.coalesce(F.col("active_intent"), F.lit("")).isin("", "NONE") == F.lit(False)).cast("int"), 0.0), "state_slot_coverage_rate": _mean(st, (F.size("slot_values") > 0).cast("int"), 0.0), "service_call_grounding_rate": _mean(call_grounding(ca, st), F.col("grounded"), 0.0),
        "service_result_availability_rate": hit, "transactional_confirmation_rate": _mean(confirmed_calls(ca, frames), F.col("confirmed").cast("int"), 1.0),
    }
    for metric, df in rates.items():
        out = out.unionByName(named(df, metric))
    return out
