"""Redaction of personal data, in a fixed order: what an earlier pattern replaced a later one no longer sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word boundary of ASCII letters, digits and _, as the patterns mean it; Java's own takes letters of every script for words.
_B = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

#: Category, pattern (Java syntax) and replacement, in the order of their use.
PATTERNS = [
    ("email", rf"(?i){_B}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{_B}", "[REDACTED_EMAIL]"),
    ("phone", r"(?<!\d)(?:\+?86[-\s]?)?1[3-9]\d{9}(?!\d)", "[REDACTED_PHONE]"),
    ("id_card", r"(?<!\d)\d{17}[\dXx](?!\d)", "[REDACTED_ID]"),
    ("bank_card", r"(?<!\d)(?:\d[ -]?){15,19}(?!\d)", "[REDACTED_CARD]"),
    ("order_id", r"(?i)(?:订单号|order(?:\s*id)?|单号)[:：\s-]*[A-Z0-9_-]{5,}", "[REDACTED_ORDER]"),
]


#: What a text must have for a pattern to be worth a search; categories that aren't named are always sought.
NEEDS = {"email": r"@", "phone": r"\d{11}", "id_card": r"\d{17}", "bank_card": r"\d", "order_id": r"(?i)order|单号"}


def redact(df: DataFrame, column: str = "content", patterns: list[tuple[str, str, str]] = PATTERNS) -> DataFrame:
    """df with the column redacted, pii_hits (count) and pii_categories (those found, sorted).

    A pattern is counted where the text has what it needs, and replaced where it was found.
    """

    def let(value: Column, body) -> Column:  # noqa: ANN001
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def step(text: Column, left: list, counts: list[Column]) -> Column:
        if not left:
            hits = sum(counts, F.lit(0))
            found = F.array_sort(F.array_compact(F.array(*[F.when(n > 0, F.lit(name)) for (name, *_), n in zip(patterns, counts)])))
            return F.struct(text.alias("text"), hits.alias("hits"), found.alias("found"))
        name, pattern, token = left[0]
        n = F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
        counted = F.when(text.rlike(NEEDS[name]), n).otherwise(0) if name in NEEDS else n
        done = let(counted, lambda n: F.struct(n.alias("n"), F.when(n > 0, F.regexp_replace(text, pattern, token)).otherwise(text).alias("t")))
        return let(done, lambda s: step(s["t"], left[1:], [*counts, s["n"]]))

    redacted = df.withColumn("__r", step(F.col(column), patterns, []))
    return redacted.withColumns({column: F.col("__r.text"), "pii_hits": F.col("__r.hits"), "pii_categories": F.col("__r.found")}).drop("__r")


def redaction_report(redacted: DataFrame) -> DataFrame:
    categories = redacted.select(F.explode("pii_categories").alias("c")).agg(F.array_sort(F.collect_set("c")).alias("categories"))
    counts = redacted.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("pii_hits") > 0).alias("rows_changed"), F.coalesce(F.sum("pii_hits"), F.lit(0)).alias("hits"))
    return counts.join(categories)  # one row each
