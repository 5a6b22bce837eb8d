"""I-Match fingerprints: hashes of the terms a text keeps from randomised subsets of a lexicon of middling terms.

The lexicon has the terms within a band of inverse document frequency: those too common to tell texts apart and those too
rare to survive an edit fall out. A text keeps its distinct terms of the lexicon, sorted, and hashes them. As one changed term
changes that hash, further hashes are taken of what it keeps from random subsets of the lexicon. A family of subsets is
nested: each term has a random number in it, and the subset of 2^b holds the terms whose number is below 2^b. A text is hashed
on the smallest subset of a family that holds any of its terms, so long and short texts both hash a few terms, and two texts
agree in a family when no term that only one of them has is among those few. The likeness of two fingerprints is the share of
hashes in which they agree.

Everything is an expression within the row: no text and no list of terms is shuffled. The lexicon comes as a scalar subquery,
dealt into a fixed number of slots by the hash of its terms. Its size is bounded by the band, not by the corpus: a term in at
least 1/rarest of all texts takes part in so many of the texts' distinct terms that there are at most (mean distinct terms of
a text) x rarest of them: with 250 and 5,000 at most 1.25 million hashes of 8 bytes, and on real texts a few ten thousand.
Terms are told apart by a 64-bit hash in the lexicon only.

Defined results: a null text counts as empty. A text with no term of the lexicon keeps all its terms instead, and one without
any term keeps its whole text as the only one. Equal texts have equal fingerprints, and so have texts that keep the same terms. Every row counts
in the document frequencies, rows of null ids and copies too. A very long text is one row's expression. An empty table gives
an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confera.llm.common import checkpointed, let
from confera.operators.order import numbered

#: What parts terms: anything but ASCII letters, digits and characters beyond ASCII (Java syntax), after lower-casing.
NO_TERM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The band: a term of the lexicon is in two texts at least, in one of RAREST texts at least, and at most in one of COMMONEST.
RAREST, COMMONEST = 5_000, 10
FAMILIES = 16
SLOTS = 1 << 16
#: Numbers of a family are crc32 * a modulo a prime; a below 2^30, so that the product stays within a long.
PRIME = 2_147_483_647
DIGITS = 8


def multipliers(families: int = FAMILIES) -> list[int]:
    """The a of each family, odd, by a rule: steps of a linear congruence."""
    out, x = [], 20_011
    for _ in range(families):
        x = (x * 48_271 + 11) % PRIME
        out.append(x % (1 << 30) | 1)
    return out


def distinct_terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), NO_TERM)), "")


def lexicon(docs: DataFrame, text_col: str = "text", rarest: int = RAREST, commonest: int = COMMONEST) -> DataFrame:
    """term, df of the terms within the band. Only numbers per term are shuffled, after a task has added up its own."""
    counts = docs.select(F.explode(distinct_terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return counts.filter((F.col("df") >= 2) & (F.col("df") * rarest >= total) & (F.col("df") * commonest <= total))


def slotted(terms: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row: the hashes of the lexicon's terms in an array per slot. As many arrays as slots, whatever the lexicon."""
    h = terms.select(F.xxhash64("term").alias("h")).select(F.pmod("h", F.lit(slots)).cast("int").alias("slot"), "h")
    every = terms.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"), F.lit(None).cast("bigint").alias("h"))
    per = h.unionByName(every).groupBy("slot").agg(F.collect_list("h").alias("hashes"))
    return per.agg(F.sort_array(F.collect_list(F.struct("slot", "hashes"))).alias("s")).select(F.col("s.hashes").alias("slots"))


def _kept(words: Column, slots: Column, text: Column, n_slots: int) -> Column:
    h = lambda w: F.xxhash64(w)
    band = F.filter(words, lambda w: F.array_contains(F.get(slots, F.pmod(h(w), F.lit(n_slots)).cast("int")), h(w)))
    whole = F.array(F.concat(F.lit(" "), text))  # a term has no space, so this is none
    return let(band, lambda b: F.sort_array(F.when(F.size(b) > 0, b).when(F.size(words) > 0, words).otherwise(whole)))


def _digest(terms: Column) -> Column:
    return F.substring(F.md5(F.array_join(terms, " ")), 1, DIGITS)


def _family(codes: Column, a: int) -> Column:
    """The digest of what the text keeps from the smallest subset of the family that holds any of it, by the terms' numbers."""
    numbers = F.transform(codes, lambda c: c * F.lit(a).cast("bigint") % F.lit(PRIME).cast("bigint"))
    bound = lambda y: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(F.array_min(y))))
    return let(numbers, lambda y: let(bound(y), lambda below: _digest(F.filter(y, lambda v: v < below).cast("array<string>"))))


def described(rows: DataFrame, slots: DataFrame, text: Column, name: str, more: Callable[[Column], Column], families: int = FAMILIES, n_slots: int = SLOTS) -> DataFrame:
    """rows with `name`: a structure of the text's fingerprint and of what else is asked for of it, under its own name.

    text is an expression over rows, and both it and the lexicon are named once: so the optimizer hands the lexicon to the
    expression itself, and no row ever holds a copy of it.
    """

    def hashes(terms: Column) -> Column:
        codes = F.transform(terms, lambda t: F.crc32(t))
        return let(codes, lambda c: F.concat(_digest(terms), *[_family(c, a) for a in multipliers(families)]))

    def describe(text: Column, slots: Column) -> Column:
        kept = let(distinct_terms(text), lambda words: _kept(words, slots, text, n_slots))
        return F.struct(let(kept, hashes).alias("fingerprint"), more(text))

    given = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.col("__slots").alias("slots"))
    return rows.withColumn("__slots", slots.scalar()).select(*[F.col(f"`{c}`") for c in rows.columns], let(given, lambda g: describe(g["text"], g["slots"])).alias(name))


def n_chars(text: Column) -> Column:
    return F.length(text).cast("long").alias("n_chars")


def likeness(a: Column, b: Column, families: int = FAMILIES) -> Column:
    """The share of hashes in which two fingerprints agree, from 0 to 1."""
    part = lambda f, i: F.substring(f, i * DIGITS + 1, F.lit(DIGITS))
    same = F.filter(F.array(*[F.lit(i) for i in range(families + 1)]), lambda i: part(a, i) == part(b, i))
    return F.size(same) / F.lit(families + 1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rarest: int = RAREST, commonest: int = COMMONEST) -> DataFrame:
    """One row per row: doc_id, fingerprint."""
    slots = checkpointed(slotted(lexicon(docs, text_col, rarest, commonest)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return described(rows, slots, F.col("text"), "is", n_chars).select("doc_id", "is.fingerprint")


def _key(id_col: Column) -> Column:
    """A text for each id that no other has, and one for null: a plain join finds it."""
    return F.coalesce(F.concat(F.lit("="), id_col.cast("string")), F.lit(""))


def edit_study(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rarest: int = RAREST, commonest: int = COMMONEST) -> DataFrame:
    """How fingerprints bear an edit: of each text and of its edited form, whose last half is the next document's beginning.

    One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Documents follow
    each other by id (nulls first), then by the hash of their text; the first follows the last. Rows that repeat an id and a
    text are one document, and each of them gets its result. The order is made from ids and lengths alone; then each text
    sends the part of its beginning that the one before it needs, and its fingerprint, and meets it in the exchange that
    its own text went through already.
    """
    slots = checkpointed(slotted(lexicon(docs, text_col, rarest, commonest)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = [_key(F.col("doc_id")).alias("key"), F.xxhash64(text).alias("h")]
    ring = checkpointed(numbered(rows.select("doc_id", *keys, F.length(text).cast("long").alias("n")).distinct(), F.asc_nulls_first("doc_id"), "h"))
    total = max(1, ring.count())
    before = ring.select(F.col("key").alias("before_key"), F.col("h").alias("before_h"), F.floor(F.col("n") / 2).cast("int").alias("need"), ((F.col("place") + 1) % total).alias("place"))
    sent_to = ring.select("key", "h", "place").join(before, "place").drop("place")

    rows = described(rows, slots, F.col("text"), "is", n_chars).select("doc_id", text.alias("text"), *keys, "is.fingerprint", "is.n_chars")
    # What is sent names every column of rows, so that both joins ask for one and the same exchange, which then runs once.
    sent = F.struct(F.substring("text", F.lit(1), F.col("need")).alias("head"), "fingerprint", "doc_id", "n_chars")
    heads = rows.join(sent_to, ["key", "h"]).select("before_key", "before_h", sent.alias("next"))
    heads = heads.groupBy(F.col("before_key").alias("key"), F.col("before_h").alias("h")).agg(F.min("next").alias("next"))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.col("next.head"))
    met = rows.join(heads, ["key", "h"]).select("doc_id", "text", "fingerprint", "n_chars", "next")
    met = described(met, slots, edited, "now", lambda t: F.sha2(t, 256).alias("sha256"))
    return met.select(
        "doc_id", "n_chars", F.col("now.sha256").alias("edited_sha256"), "fingerprint", F.col("now.fingerprint").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("now.fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next.fingerprint")).alias("near_next"),
    )
