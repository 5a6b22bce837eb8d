"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

One narrow sketch (length and prefix hash of each normalised text) is grouped twice, each time only over what the level
before left; both groupings combine before they shuffle, so a group of copies of any size is one row per task. The keys
that survive go into a Bloom filter that is sized by their number, and only texts that pass it are read and hashed whole. A
filter that is too full (it has a largest size, which bounds its broadcast) lets more texts through to the full hash but
never changes the result. No text is shuffled for the decision.

Defined results: a null text counts as empty. Nulls among the ids rank last. Of rows that repeat both the id and the
text, one stays. A very long text is folded and hashed within its row. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confera.llm.common import checkpointed, folded, own_name

#: Most 64-bit words of a Bloom filter: bounds its broadcast to about 30 MB. It has 16 bits a key up to 4 million keys.
FILTER_WORDS = 1 << 20
PREFIX_CHARS = 256


def _key(norm: Column, prefix_chars: int) -> tuple[Column, Column]:
    return F.length(norm), F.xxhash64(F.substring(norm, 1, prefix_chars))


def _word(h: Column, words: int) -> Column:
    return F.pmod(h, F.lit(words))


def _mask(h: Column) -> Column:
    """Four bits of one word, from bits of the hash that did not choose the word."""
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int")) for at in (20, 27, 34, 41)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def _filter(hashes: DataFrame, most: int) -> tuple[DataFrame, int]:
    """hashes: a column h. The words of a blocked Bloom filter of them, and how many words it has."""
    kept = checkpointed(hashes)
    words = min(most, 1 << max(6, (kept.count() // 4).bit_length()))
    return checkpointed(_bits(kept, words)), words


def _survivors(sketch: DataFrame, most: int) -> tuple[DataFrame, int]:
    """sketch: n, ph. A filter of the keys (length, prefix hash) of two rows or more."""
    by_length, words = _filter(sketch.groupBy("n").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.xxhash64("n").alias("h")), most)
    left = _passing(sketch.withColumn("h", F.xxhash64("n")), by_length, words).filter("hit").drop("hit", "h")
    return _filter(left.groupBy("n", "ph").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.xxhash64("n", "ph").alias("h")), most)


def _bits(hashes: DataFrame, words: int) -> DataFrame:
    return hashes.groupBy(_word(F.col("h"), words).alias("word")).agg(F.bit_or(_mask(F.col("h"))).alias("bits"))


def _passing(df: DataFrame, bits: DataFrame, words: int) -> DataFrame:
    """df with hit: whether its h may be in the filter. The filter has `words` rows at most, hence the broadcast."""
    mask = _mask(F.col("h"))
    df = df.withColumn("word", _word(F.col("h"), words)).join(F.broadcast(bits), "word", "left")
    return df.withColumn("hit", F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False))).drop("word", "bits")


def _sketch(docs: DataFrame, text_col: str, prefix_chars: int) -> DataFrame:
    n, ph = _key(F.col("norm"), prefix_chars)
    return checkpointed(docs.select(folded(F.col(text_col)).alias("norm")).select(n.alias("n"), ph.alias("ph")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digests: bool = False, prefix_chars: int = PREFIX_CHARS, filter_words: int = FILTER_WORDS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    digests: also give the digest of texts that the first two levels settled; else it is null for them. As that asks for the
    full hash of every text, it is then taken with the sketch, in one pass over the texts.
    """
    n, ph = _key(F.col("norm"), prefix_chars)
    sha = F.sha2(F.col("norm"), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), folded(F.col(text_col)).alias("norm"))
    if digests:
        rows = checkpointed(rows.select("doc_id", n.alias("n"), ph.alias("ph"), sha.alias("text_sha256")))
        bits, words = _survivors(rows.select("n", "ph"), filter_words)
        rows = _passing(rows.withColumn("h", F.xxhash64("n", "ph")), bits, words).select("doc_id", "hit", "text_sha256")
    else:
        bits, words = _survivors(_sketch(docs, text_col, prefix_chars), filter_words)
        rows = _passing(rows.withColumn("h", F.xxhash64(n, ph)), bits, words)
        rows = checkpointed(rows.select("doc_id", "hit", F.when(F.col("hit"), sha).alias("text_sha256")))

    alone = rows.filter(~F.col("hit")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = rows.filter("hit").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    # Written, so that the join below has a plain exchange on both sides and Spark can split a hot group's rows.
    groups = checkpointed(again.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("times").alias("group_size")))
    met = again.join(groups, "text_sha256").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    met = met.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256")
    return alone.unionByName(met)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = PREFIX_CHARS, filter_words: int = FILTER_WORDS) -> DataFrame:
    """The rows that stay, with all their columns. Texts that the first two levels settle are not shuffled."""
    bits, words = _survivors(_sketch(docs, text_col, prefix_chars), filter_words)
    columns, norm, row = docs.columns, own_name(docs, "norm"), own_name(docs, "row")
    n, ph = _key(F.col("norm"), prefix_chars)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias(row), folded(F.col(text_col)).alias("norm")).withColumn("h", F.xxhash64(n, ph))
    packed = _passing(packed, bits, words)
    order = F.struct(F.col(f"{row}.`{id_col}`").isNull(), F.col(f"{row}.`{id_col}`"))
    met = packed.filter("hit").groupBy(F.sha2("norm", 256).alias(norm)).agg(F.min_by(row, order).alias(row))
    return packed.filter(~F.col("hit")).select(row).unionByName(met.select(row)).select(f"{row}.*")
