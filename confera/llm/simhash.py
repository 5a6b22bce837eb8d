"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, linked at few differing bits, by pivot distance tables.

Every distinct fingerprint gets a row of a pivot table: its Hamming distances to many fixed reference fingerprints. The
references come in families: one spread by a hash, and the same with all bits of one 16-bit quarter turned. By the triangle
inequality linked fingerprints differ by at most `bits` in every coordinate; and as the difference between two coordinates
of a family is the distance within one quarter, and at most `bits` quarters of a linked pair hold a differing bit, in all
other quarters a linked pair has no coordinate difference at all. So the table itself is the search: fingerprints are dealt
by their coordinates over each choice of quarters that a linked pair may share, pairs that meet nowhere are discarded with
no comparison, and a fingerprint that meets none is done. With ten families the coordinates of two quarters tell apart about
2^31 classes, so few unlinked pairs survive in tables well below that size; from about 10^9 fingerprints nearly all survive,
and the verification below does all the work.

Survivors are verified through references of their own: each names itself and its one-bit neighbours, and two of them are
within two bits exactly if they name a common one. Each is linked to the least that names it, which keeps every component
with a number of links in proportion to the members, however many near copies a group has; no pairs of a group are listed.
Components follow by star contraction over representatives.

Defined results: a null or blank text has fingerprint zero and links like any other. Repeated rows give a row each. Null
ids rank last; a component of null ids alone has a null component_id. A very long text is hashed in blocks within its row.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from confera.llm.common import checkpointed, own_name, text_batches
from confera.llm.components import components
from confera.llm.shingles import similar_links, sketch

BITS = 2
#: Families of reference fingerprints; each has five.
FAMILIES = 10


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Words of ASCII-lower-cased text in shingles of `size`; a bit is 1 if set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, len(words)
    if n <= size:
        return digest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist())
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), dtype="<u8", count=n - size + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_QUARTERS = [0xFFFF << 16 * q for q in range(4)]


def pivots(families: int = FAMILIES) -> list[int]:
    """Reference fingerprints, five a family: one spread by the hash itself, then it with each quarter turned; signed."""
    bases = [xxhash.xxh64_intdigest(f"pivot {i}".encode(), 0) for i in range(families)]
    return [_signed(x) for b in bases for x in (b, *(b ^ m for m in _QUARTERS))]


def pivot_table(distinct: DataFrame, families: int = FAMILIES) -> DataFrame:
    """fp, row: the distances of each fingerprint to all references."""
    distances = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("tinyint") for p in pivots(families)]
    return distinct.select("fp", F.array(*distances).alias("row"))


def surviving(distinct: DataFrame, *, bits: int = BITS, families: int = FAMILIES) -> DataFrame:
    """distinct: distinct fingerprints in fp. fp of those that the pivot table leaves with a possible partner."""
    within = [F.xxhash64(F.lit(q), *[F.get("row", F.lit(5 * j)) - F.get("row", F.lit(5 * j + 1 + q)) for j in range(families)]) for q in range(4)]
    shares = [F.xxhash64(F.lit(k), *[within[q] for q in pick]) for k, pick in enumerate(combinations(range(4), 4 - bits))]
    # Dealt anew: distinct fingerprints are so few bytes that they would come in a task or two, and the table is the work.
    spread = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pivot_table(spread, families).select("fp", F.explode(F.array(*shares)).alias("share"))
    # Two of a share are enough to know that it has partners; the least and the largest combine before the shuffle.
    met = dealt.groupBy("share").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least != most")
    # The key as an expression of its own: an exchange on both sides of the join, so that hot shares can be split.
    return dealt.join(met.select(F.col("share").bitwiseXOR(F.lit(0)).alias("share")), "share").select("fp").distinct()


def fingerprint_links(distinct: DataFrame, *, bits: int = BITS, families: int = FAMILIES) -> DataFrame:
    """distinct: distinct fingerprints in fp. Links (a, b) within bits, whose components are those of all pairs within bits."""
    if not 0 <= bits <= 2:
        raise ValueError("0 to 2 differing bits")
    if bits == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    left = checkpointed(surviving(distinct, bits=bits, families=families))
    turned = [F.lit(0), *[F.lit(_signed(1 << i)) for i in range(64)]]
    named = left.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(t.cast("bigint")) for t in turned])).alias("name"))
    if bits == 1:  # a name that a survivor has is the partner itself
        return named.filter("fp > name").join(left.select(F.col("fp").alias("name")), "name", "left_semi").select(F.col("fp").alias("a"), F.col("name").alias("b"))
    least = named.groupBy("name").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).filter("b != most").select(F.col("name").bitwiseXOR(F.lit(0)).alias("name"), "b")
    return named.join(least, "name").filter("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits: int = BITS, families: int = FAMILIES) -> DataFrame:
    """One row per row: doc_id, fingerprint, component_id."""
    prints, of = _rooted(docs, id_col, text_col, bits=bits, families=families)
    return prints.join(of.drop("root"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(docs: DataFrame, id_col: str, text_col: str, *, bits: int = BITS, families: int = FAMILIES, similarity: float | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp of every row; and fp, root (which names the component, with or without ids), component_id of every fp."""
    text = F.col(f"`{text_col}`")
    columns = [F.col(f"`{id_col}`").alias("doc_id"), _fingerprints(text).alias("fp")]
    if similarity is None:
        prints = checkpointed(text_batches(docs).select(*columns))
    else:
        kept = checkpointed(text_batches(docs).select(*columns, F.xxhash64(text).alias("node"), sketch(text).alias("s")).select("doc_id", "fp", "node", "s.sketch", "s.keys"))
        prints = kept.select("doc_id", "fp")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = fingerprint_links(classes.select("fp"), bits=bits, families=families)
    if similarity is not None:
        links = links.unionByName(similar_links(docs, kept.withColumnRenamed("fp", "name"), text_col, similarity=similarity))
    roots = components(links)
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints, rooted.join(named, "root").select(F.col("fp").bitwiseXOR(F.lit(0)).alias("fp"), "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without those that a smaller id of their component makes superfluous.

    similarity: links texts also whose sets of five-word shingles are as alike as that. Fingerprints of such texts differ
    in more bits than any pivot table can tell from chance, so these links come from sketches (`shingles`).

    An id that repeats stays once in each component that it is the least of. A row of null id stays, as nothing tells it
    from others of null id.
    """
    prints, of = _rooted(docs, id_col, text_col, **options)
    again = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    if not again.isEmpty():  # an id doesn't tell the row: rows meet their components by their own fingerprints
        fp, root, least, row = (own_name(docs, c) for c in ("fp", "root", "least", "row"))
        key = F.col(f"`{id_col}`")
        rows = docs.withColumns({fp: _fingerprints(F.col(f"`{text_col}`")), row: F.when(key.isNull(), F.monotonically_increasing_id())})
        rows = rows.join(of.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(least)), fp)
        rows = rows.filter(key.isNull() | (key == F.col(least))).dropDuplicates([id_col, root, row])
        return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
    found = prints.join(of, "fp")
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col))
    return docs.join(gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
