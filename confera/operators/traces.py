"""Spans of traces to turns, retrieval contexts and tool calls.

Spans hold: span_id, trace_id, kind, start_ms, end_ms, input, output (JSON text), and is_pair for chat spans: whether it has
a user message and an assistant answer. Spans without a time come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confera.functions.text import unit4


def in_time():
    return Window.partitionBy("trace_id").orderBy(F.coalesce("start_ms", F.lit(0)), "span_id")


def turns_before(spans: DataFrame) -> DataFrame:
    """Adds turn_index: the chat pairs that the trace completed before the span."""
    done = F.coalesce(((F.col("kind") == "chat") & F.col("is_pair")).cast("int"), F.lit(0))
    return spans.withColumn("turn_index", F.coalesce(F.sum(done).over(in_time().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def retrievals_before(spans: DataFrame) -> DataFrame:
    """Chat spans with the number of retrievals of their trace that had ended by their start, and the last of them.

    Ends and starts are one sorted sequence per trace; a running count answers every chat without meeting each retrieval.
    """
    end = F.coalesce("end_ms", "start_ms", F.lit(0))
    ended = spans.filter("kind = 'retrieval'").select("trace_id", "span_id", end.alias("at"), F.lit(0).alias("o"))
    chats = spans.filter("kind = 'chat'").select("trace_id", "span_id", F.coalesce("start_ms", F.lit(0)).alias("at"), F.lit(1).alias("o"))
    upto = Window.partitionBy("trace_id").orderBy("at", "o", "span_id").rowsBetween(Window.unboundedPreceding, 0)
    met = ended.unionByName(chats).withColumns({"retrievals": F.sum(1 - F.col("o")).over(upto), "last_retrieval": F.last(F.when(F.col("o") == 0, F.col("span_id")), ignorenulls=True).over(upto)})
    return met.filter("o = 1").select("trace_id", "span_id", "retrievals", "last_retrieval")


def _text(v: Column) -> Column:
    """Text of a message's content: a string, an object with text, or parts."""
    parts = F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")), F.lit(""))), "")
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.try_variant_get(v, "$.text", "string"), parts)


def chat_messages(spans: DataFrame) -> DataFrame:
    """Messages of chat spans: from input.messages, input.input, or input as an array or a string."""
    v = F.try_parse_json("input")
    listed = F.coalesce(F.try_variant_get(v, "$.messages", "array<variant>"), F.try_variant_get(v, "$.input", "array<variant>"), F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")))
    single = F.coalesce(F.try_variant_get(v, "$.input", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    rows = spans.filter("kind = 'chat'").withColumns({"listed": listed, "single": single})
    many = rows.filter("listed is not null").select("trace_id", "span_id", "start_ms", F.posexplode("listed").alias("pos", "m")).select("trace_id", "span_id", "start_ms", "pos", F.try_variant_get("m", "$.role", "string").alias("role"), _text(F.try_variant_get("m", "$.content", "variant")).alias("content"))
    one = rows.filter("listed is null and single is not null").select("trace_id", "span_id", "start_ms", F.lit(0).alias("pos"), F.lit("user").alias("role"), F.col("single").alias("content"))
    return many.unionByName(one).filter(F.col("role").isin("user", "assistant", "system") & (F.coalesce("content", F.lit("")) != ""))


def assistant_output(output: Column) -> Column:
    """A string, choices[0].message.content, output or content."""
    v = F.try_parse_json(output)
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.try_variant_get(v, "$.choices[0].message.content", "string"), F.try_variant_get(v, "$.output", "string"), F.try_variant_get(v, "$.content", "string"))


def retrieval_documents(spans: DataFrame) -> DataFrame:
    """Texts of retrieval outputs: strings, page_content, text, or a list under documents."""
    v = F.try_parse_json("output")
    listed = F.coalesce(F.try_variant_get(v, "$.documents", "array<variant>"), F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")))
    docs = spans.filter("kind = 'retrieval'").select("trace_id", "span_id", "start_ms", "end_ms", F.posexplode(listed).alias("pos", "d"))
    text = F.coalesce(F.when(F.schema_of_variant("d") == "STRING", F.try_variant_get("d", "$", "string")), F.try_variant_get("d", "$.page_content", "string"), F.try_variant_get("d", "$.text", "string"))
    return docs.select("trace_id", "span_id", "start_ms", "end_ms", "pos", text.alias("text")).filter("text is not null")


def tool_calls(spans: DataFrame) -> DataFrame:
    """Tool spans with name, arguments (JSON text), turn_index and success."""
    v = F.try_parse_json("input")
    args = F.coalesce(F.to_json(F.try_variant_get(v, "$.arguments", "variant")), F.to_json(v), F.to_json(F.struct(F.col("input").alias("raw"))))
    return turns_before(spans).filter("kind = 'tool'").select("trace_id", "span_id", "turn_index", F.col("name").alias("tool_name"), args.alias("arguments"), (F.col("status") == "ok").alias("succeeded"))


def project(spans: DataFrame) -> dict[str, DataFrame]:
    """rows, contexts, documents, tool_calls of traces, as the evaluation takes them; contexts refer to documents by their number."""
    messages = chat_messages(spans)
    last_user = messages.filter("role = 'user'").groupBy("span_id").agg(F.max_by("content", "pos").alias("query"))
    answered = spans.filter("kind = 'chat'").select("trace_id", "span_id", "start_ms", "end_ms", assistant_output(F.col("output")).alias("response")).join(last_user, "span_id", "left")
    paired = spans.join(answered.select("span_id", F.col("query").isNotNull().alias("q"), (F.coalesce("response", F.lit("")) != "").alias("r")), "span_id", "left").withColumn("is_pair", F.coalesce(F.col("q") & F.col("r"), F.lit(False)))
    out = answered.filter("response <> ''").select("trace_id", "span_id", F.coalesce("end_ms", "start_ms").alias("start_ms"), F.lit(1 << 30).alias("pos"), F.lit("assistant").alias("role"), F.col("response").alias("content"))
    rows = messages.unionByName(out).select(F.col("trace_id").alias("session_id"), F.col("start_ms").alias("ts_ms"), "role", "content", "span_id", "pos")
    documents = placed_documents(spans)
    chat = turns_before(paired).filter("kind = 'chat' and is_pair").select("trace_id", "span_id", "start_ms", "turn_index").join(answered.select("span_id", "query", "response"), "span_id")
    contexts = documents_before(chat, documents).select("trace_id", "span_id", "turn_index", "query", "response", "documents")
    return {"rows": rows, "contexts": contexts, "documents": documents, "tool_calls": tool_calls(paired)}


def placed_documents(spans: DataFrame) -> DataFrame:
    """trace_id, place (from 1), ended, start_ms, span_id, pos, text: the documents of a trace once each, in the order in which they had come."""
    docs = retrieval_documents(spans).select("trace_id", F.coalesce("end_ms", "start_ms").alias("ended"), "start_ms", "span_id", "pos", "text").filter("ended is not null")
    return docs.withColumn("place", F.row_number().over(Window.partitionBy("trace_id").orderBy("ended", "start_ms", "span_id", "pos")).cast("bigint"))


def documents_before(chats: DataFrame, documents: DataFrame) -> DataFrame:
    """chats (trace_id, span_id, start_ms, ...) with documents: how many of their trace's had come when they began.

    As these are the first so many, the number says which: a chat carries no text of them. Ends and starts are one sorted
    sequence per trace, and a running count answers every chat.
    """
    ended = documents.select("trace_id", F.col("ended").alias("at"), F.lit(0).alias("o"), F.lit(None).cast("string").alias("chat"))
    began = chats.select("trace_id", F.col("start_ms").alias("at"), F.lit(1).alias("o"), F.col("span_id").cast("string").alias("chat"))
    upto = Window.partitionBy("trace_id").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    counted = ended.unionByName(began).withColumn("documents", F.sum(1 - F.col("o")).over(upto)).filter("o = 1").select(F.col("chat").alias("span_id"), F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"))
    return chats.join(counted, "span_id")


def expand_contexts(projected: dict[str, DataFrame]) -> DataFrame:
    """The contexts with their documents' texts in a list, in the order in which they had come: as long as that list is."""
    contexts, documents = projected["contexts"], projected["documents"]
    texts = documents.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda d: d["text"]).alias("texts"))
    out = contexts.join(texts, "trace_id", "left").withColumn("contexts", F.when(F.col("documents") > 0, F.slice("texts", F.lit(1), F.col("documents").cast("int"))).otherwise(F.array().cast("array<string>")))
    return out.drop("texts")


def step_efficiency(spans: DataFrame) -> DataFrame:
    """trace_id, spans, errors, value: the share of spans that ended well, less 0.08 for each that ended with a warning."""
    n = lambda *kinds: F.count_if(F.col("status").isin(*kinds))
    out = spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"), n("error").alias("errors"), n("success", "ok", "warning").alias("good"), n("warning").alias("warned"))
    return out.select("trace_id", "spans", "errors", unit4(F.col("good") / F.col("spans") - F.col("warned") * 0.08).alias("value"))


def evict(stored: DataFrame, most: int = 200) -> DataFrame:
    """The latest traces of a buffer."""
    return stored.orderBy(F.desc("ingested_at"), F.desc("trace_id")).limit(most)
