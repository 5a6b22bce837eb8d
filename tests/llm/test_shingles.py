"""Texts alike by their shingles, against the sets themselves."""

import random

import pytest
from pyspark.sql import functions as F
from test_contract_ops import docs_of, word_shingles

from confera.llm import shingles, simhash
from confera.llm.components import components


def _jaccard(a, b):
    a, b = word_shingles(a), word_shingles(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def _edited(rng, words, edits):
    words = list(words)
    for k in range(edits):
        words[rng.randrange(len(words))] = f"edit{k}"
    return " ".join(words)


def _links(spark, rows, **options):
    docs = docs_of(spark, rows).withColumnRenamed("source", "__sketch").withColumn("keys", F.lit("clash")).repartition(3)
    kept = docs.select(F.col("doc_id").alias("name"), F.xxhash64("text").alias("node"), shingles.sketch(F.col("text")).alias("s")).select("name", "node", "s.sketch", "s.keys")
    return shingles.similar_links(docs, kept, **options)


def test_shingles_are_sets_of_words():
    rng = random.Random(3)
    for n in (0, 1, 4, 5, 6, 40, 3000):
        text = " ".join(rng.choice("ab cd Ef \u00c4x gh".split()) for _ in range(n))
        assert len(shingles.shingles(text)) == len(word_shingles(text))
        other = _edited(rng, text.split() or ["x"], 1)
        assert shingles.jaccard(shingles.shingles(text), shingles.shingles(other)) == pytest.approx(_jaccard(text, other))
    assert shingles.sketch_of(None) == shingles.sketch_of(" \n ") == (None, None)


def test_pairs_from_bare_likeness_to_copies(spark):
    rng = random.Random(5)
    rows, pairs = [], []
    for k in range(240):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(base), "s"), (len(rows) + 1, _edited(rng, base, k % 8), "s")]
    found = {tuple(sorted(r)) for r in _links(spark, rows).collect()}
    near = {p: _jaccard(rows[p[0]][1], rows[p[1]][1]) for p in pairs}
    alike = {p for p, s in near.items() if 0.8 <= s < 1}  # equal texts are one node
    assert found <= set(near) and all(near[p] >= 0.8 for p in found)
    assert len(found & alike) >= 0.95 * len(alike) and {p for p in alike if near[p] >= 0.9} <= found
    assert {p for p, s in near.items() if s < 0.8}


@pytest.mark.parametrize("most", [4096, 16])
def test_a_large_group_gives_links_by_its_members(spark, most):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(k, _edited(rng, base, 2), "s") for k in range(200)] + [(1000 + k, " ".join(f"v{rng.randrange(5000)}" for _ in range(80)), "s") for k in range(40)]
    links = _links(spark, rows, most=most).cache()
    assert links.distinct().count() < 10 * 200
    roots = components(links).collect()
    assert {r.root for r in roots} == {0} and {r.node for r in roots} == set(range(200))


def test_odd_rows(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(90_000)}" for _ in range(60_000)]
    rows = [(None, None, None), (1, None, "s"), (2, "", "s"), (3, " \n", "s"), (4, "two words", "s"), (5, "Two  words", None), (6, "two words", "s"), (7, "other words", "s"), (8, " ".join(long), "s"), (9, _edited(rng, long, 500), "s"), (8, " ".join(long), "s")]
    assert {tuple(sorted(r)) for r in _links(spark, rows).collect()} in ({(4, 5), (8, 9)}, {(5, 6), (8, 9)})
    assert _links(spark, []).count() == 0


def test_keep_one_by_likeness(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(9, " ".join(base), "s"), (5, _edited(rng, base, 2), "s"), (7, " ".join(reversed(base)), "s"), (None, " ".join(base), "s"), (11, None, "s"), (12, "", "s")]
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.keep_one(docs_of(spark, rows), similarity=0.8).collect())
    assert got == [(False, 5), (False, 7), (False, 11), (True, 0)]
    assert {r.doc_id for r in simhash.keep_one(docs_of(spark, rows)).collect()} == {9, 5, 7, 11, None}
