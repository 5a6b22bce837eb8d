"""Texts whose sets of word shingles are alike (Jaccard), found by min-hash bands and held against the sets themselves.

Every text has a sketch: the least value of its shingles under each of BANDS * ROWS hash functions, of which a byte each is
kept, and one key a band over the ROWS whole values. Two texts of similarity s share a band's key with probability s^ROWS,
so a pair at 0.8 meets in one of the bands with probability 0.99, one at 0.9 nearly always.

Texts that share a key are linked by leaders: a scan over the sorted rows of a key compares each text with the leaders so
far, links it to the first that is surely like it or else to the most like, and makes it a leader too unless one was surely
like it. A group of near copies so gives a link a member, never its pairs. A key of many texts is scanned in parts, and then
its leaders; what a task holds is a sketch for each leader of one key. Links that the sketches leave in doubt are verified
on the sets of the whole texts.

So a link may be missed beside the pairs that no band brings together: where the most alike leader by the sketches isn't
the most alike by the sets, and in a chain whose middle was folded into a leader that its ends aren't like. The README
tells what is found.

Defined results: texts with fewer words than a shingle have the whole sequence as their one shingle; texts without words
(null, empty, blank) link to nothing. Repeated texts are one node. An empty table gives no links. A very long text is sketched in
blocks. Only the text column is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confera.llm.common import checkpointed

#: Words of a shingle, and the similarity from which texts are alike.
SIZE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 7
#: How far an estimate over all sketch bytes may be off: its standard deviation at 0.8 is 0.034.
DOUBT = 0.12
#: A key of more texts than this is scanned in parts of half as many.
PART = 4096

_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_FACTORS = np.array([xxhash.xxh64_intdigest(f"factor {k}".encode()) | 1 for k in range(BANDS * ROWS)], dtype=np.uint64)[:, None]
_TERMS = np.array([xxhash.xxh64_intdigest(f"term {k}".encode()) for k in range(BANDS * ROWS)], dtype=np.uint64)[:, None]
SKETCH = "struct<sketch:binary,keys:array<bigint>>"


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ASCII-lower-cased words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    hashed = np.fromiter((digest[w] for w in words), dtype=np.uint64, count=len(words))
    n, size = max(1, len(words) - size + 1), min(size, len(words))
    rolled = hashed[:n].copy()
    for k in range(1, size):
        rolled = rolled * _STEP + hashed[k : k + n]
    rolled ^= rolled >> np.uint64(32)
    rolled *= _MIX
    return np.unique(rolled ^ (rolled >> np.uint64(29)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def sketch_of(text: str | None, size: int = SIZE) -> tuple[bytes | None, list[int] | None]:
    """A byte of each least value, and a key of each band; nothing for a text without words."""
    own = shingles(text, size)
    if not len(own):
        return None, None
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(least, (own[at : at + 1024] * _FACTORS + _TERMS).min(axis=1), out=least)
    short = (((least ^ (least >> np.uint64(29))) * _MIX) >> np.uint64(56)).astype(np.uint8)
    raw, width = least.tobytes(), 8 * ROWS
    keys = [xxhash.xxh64_intdigest(raw[j * width : (j + 1) * width], j) for j in range(BANDS)]
    return short.tobytes(), [k - (1 << 64) if k >> 63 else k for k in keys]


def sketch(text: Column, size: int = SIZE) -> Column:
    """struct(sketch, keys) of a text; both null for a text without words."""

    @F.pandas_udf(SKETCH)
    def sketched(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch_of(t, size) for t in texts], columns=["sketch", "keys"])

    return sketched(text)


def _scan(similarity: float, most: int):  # noqa: ANN202
    """Rows (key, part, n, node, name, sketch) sorted by key, part and node: each row's link, and the leaders of large keys."""
    sure, possible = similarity + DOUBT, similarity - DOUBT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, count, nodes, known = None, 0, [], np.empty((16, BANDS * ROWS), dtype=np.uint8)
        for batch in batches:
            out = []
            for key, part, n, node, name, sketch in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "n", "node", "name", "sketch"))):
                if of != (key, part):
                    of, count, nodes, known = (key, part), 0, [], np.empty((16, BANDS * ROWS), dtype=np.uint8)
                own, leads, to, like = np.frombuffer(sketch, dtype=np.uint8), True, (None, None), None
                if count:
                    # A byte agrees by chance once in 256.
                    alike = ((known[:count] == own).mean(axis=1) * 256 - 1) / 255
                    best = int(alike.argmax())
                    leads = alike[best] < sure
                    # The first that is well above, so that a group's members name the same leader under all keys.
                    well = alike >= min(alike[best], similarity + DOUBT / 2)
                    best = int((alike >= sure).argmax() if not leads else well.argmax())
                    if alike[best] >= possible:
                        to, like = nodes[best], float(alike[best])
                if leads:
                    if count == len(known):
                        known = np.concatenate([known, np.empty_like(known)])
                    known[count] = own
                    nodes.append((node, name))
                    count += 1
                if to[0] is not None or (leads and n > most):
                    out.append((key, n, node, name, sketch if leads and n > most else None, *to, like))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64()))], names=["key", "n", "node", "name", "sketch", "to_node", "to_name", "alike"])

    return run


_FOUND = "key bigint, n bigint, node bigint, name bigint, sketch binary, to_node bigint, to_name bigint, alike double"


def _scanned(rows: DataFrame, similarity: float, most: int) -> DataFrame:
    ordered = rows.select("key", "part", "n", "node", "name", "sketch").repartition("key", "part").sortWithinPartitions("key", "part", "node")
    return checkpointed(ordered.mapInArrow(_scan(similarity, most), _FOUND))


def similar_links(docs: DataFrame, sketches: DataFrame, text_col: str = "text", *, similarity: float = SIMILARITY, size: int = SIZE, most: int = PART) -> DataFrame:
    """sketches: name, node (xxhash64 of the text), sketch, keys of every row of docs. Links (a, b) between names of texts that are alike."""
    once = sketches.filter("sketch is not null").dropDuplicates(["node"])
    met = once.select("node", F.explode("keys").alias("key"))
    shared = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").bitwiseXOR(F.lit(0)).alias("key"), "n")
    # Sketches join after the keys that nothing shares are gone.
    members = met.join(shared, "key").join(once.select(F.col("node").bitwiseXOR(F.lit(0)).alias("node"), "name", "sketch"), "node")
    part = F.when(F.col("n") > most, F.pmod(F.xxhash64("node"), F.ceil(F.col("n") * 2 / most))).otherwise(F.lit(0)).cast("bigint")
    first = _scanned(members.withColumn("part", part), similarity, most)
    second = _scanned(first.filter("sketch is not null").withColumn("part", F.lit(0).cast("bigint")), similarity, most)
    pairs = first.unionByName(second).filter("to_node is not null and node != to_node")
    pairs = pairs.groupBy("node", "to_node").agg(F.first("name").alias("a"), F.first("to_name").alias("b"), F.max("alike").alias("alike"))
    pairs = checkpointed(pairs.filter("a != b"))
    sure = pairs.filter(F.col("alike") >= similarity + DOUBT)
    doubtful = pairs.filter(F.col("alike") < similarity + DOUBT)
    asked = doubtful.select("node").union(doubtful.select("to_node")).distinct()
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.xxhash64(text).alias("node"), text.alias("text")).join(asked, "node", "left_semi").dropDuplicates(["node"])
    both = doubtful.join(texts, "node").join(texts.select(F.col("node").alias("to_node"), F.col("text").alias("to_text")), "to_node")

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        sets = lru_cache(64)(lambda t: shingles(t, size))
        return pd.Series([jaccard(sets(x), sets(y)) >= similarity for x, y in zip(a, b)], dtype=bool)

    return sure.select("a", "b").unionByName(both.filter(verified("text", "to_text")).select("a", "b"))
