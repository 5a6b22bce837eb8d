"""Resampling, I-Match and the source audit against brute force and SQL, with nulls, ties, repeats, long texts and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from confera.llm import imatch, importance, utf8
from confera.llm.divergence import source_divergence
from confera.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, h string, words int, slots int, term string, score double, rank int, place int, is string, now string, key string, part string"
DATA = Path("/root/testdata/sf0.001")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "x", 2, 3, "y", 0.5, 4, 5, "z", "w", "k", "p") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["alpha", "Beta", "GAMMA", "d", "été", "Straße", "don't", "x1", "日本", "İx", "naïve", "0", "b-c"] + [f"w{k}" for k in range(60)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "\n", ". ", "--", "\x00"]) for _ in range(n))
    out = [(k, text(rng.choice([0, 1, 5, 19, 20, 21, 60, 300])), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None])) for k in range(90)]
    out += [(200, out[4][1], "en", "s1"), (201, None, "en", "s9"), (202, "", None, None), (203, "!!! ... 12", "fr", "only"), (204, "ab" * 3000 + " " + "c" * 90 + " end" * 30, "en", "s1")]
    return out + [out[5], out[5], (None, "a null id has words " * 6, "en", "s2"), (None, out[7][1], "de", "s1"), (None, None, None, None)]


WORD11 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD11.findall((text or "").translate(FOLD))
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def drawn(rows, target, percent=25, least=20):
    own, aim = [features(t) for _, t, *_ in rows], [features(t)[1] for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for f in aim for b in f)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    out = []
    for (i, *_), (n, f) in zip(rows, own):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-x[4], x[0] is None, x[0] or 0) for x in out if x[1] >= least)
    return out, able[: len(able) * percent // 100]


def test_importance(spark, rows):
    target = ["alpha beta beta", "w1 w2 w3 naïve", None, ""]
    aim = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id bigint, text string, n int")
    want, best = drawn(rows, target)
    got = importance.importance_scores(docs_of(spark, rows), aim).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(best) + 1)) and best
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked] == best
    whole = importance.resample(docs_of(spark, rows), aim)
    assert whole.columns == docs_of(spark, rows).columns
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in ranked}


def test_importance_of_empty_tables(spark, rows):
    none, some = docs_of(spark, []), docs_of(spark, rows)
    aim = spark.createDataFrame([(1, "alpha")], "item_id bigint, text string")
    assert importance.importance_scores(none, aim).count() == importance.resample(none, aim).count() == 0
    want, best = drawn(rows, [])
    got = importance.importance_scores(some, aim.limit(0)).collect()
    assert Counter((r.doc_id, r.score) for r in got) == Counter((x[0], x[4]) for x in want)
    assert sum(r["rank"] is not None for r in got) == len(best)


@pytest.mark.parametrize("block", [16, 64, 1 << 20])
def test_words_in_blocks(block):
    rng = random.Random(block)
    texts = ["".join(rng.choice("abAB01 .-é日\x00\n") for _ in range(rng.choice([0, 1, 3, 40, 400]))) for _ in range(40)] + [None, "a" * 500, "a b", "", "é" * 90 + " ", " " * 100, "x " * 60]
    column = pa.array(texts, pa.string()).slice(1)
    found = defaultdict(list)
    for b in utf8.word_blocks(column, utf8.byte_classes(True), block):
        spans = list(zip(b.of, b.starts, b.ends))
        for of, lo, hi in spans[1:] if b.seen else spans:
            found[int(b.rows[of])].append(bytes(b.low[lo:hi]).decode())
        if b.seen:
            assert bytes(b.low[b.starts[0] : b.ends[0]]).decode() == last
        last = bytes(b.low[b.starts[-1] : b.ends[-1]]).decode() if len(b.starts) else None
        words = utf8.as_strings(b.low, b.starts, b.ends).to_pylist()
        assert words == [bytes(b.low[lo:hi]).decode() for _, lo, hi in spans]
    assert dict(found) == {k: w for k, t in enumerate(texts[1:]) if (w := WORD11.findall((t or "").translate(FOLD)))}


def test_features_across_blocks(monkeypatch):
    text = "".join(random.Random(3).choice(["ab", "c", "ddd" * 30, "é"]) + " " for _ in range(300))
    want = Counter(features(text)[1])
    for block in (20, 100, 1 << 20):
        monkeypatch.setattr(importance, "word_blocks", lambda c, k, b=block: utf8.word_blocks(c, k, b))
        blocks = list(importance.text_features(pa.array([text])))
        assert sum(int(n.sum()) for *_, n in blocks) == features(text)[0]
        assert Counter((np.concatenate([crc for _, _, crc, _ in blocks]) % 10_000).tolist()) == want


def brute_fingerprints(rows, texts, rarest=imatch.RAREST, commonest=imatch.COMMONEST):
    """Fingerprints of texts over the lexicon of rows."""
    terms = lambda t: {w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w}
    df = Counter(w for _, t, *_ in rows for w in terms(t))
    band = {w for w, c in df.items() if c >= 2 and c * rarest >= len(rows) >= c * commonest}
    md = lambda parts: hashlib.md5(" ".join(parts).encode()).hexdigest()[: imatch.DIGITS]
    out = []
    for t in texts:
        kept = sorted(terms(t) & band or terms(t) or {" " + (t or "")}, key=lambda w: w.encode())
        parts = [md(kept)]
        for a in imatch.multipliers():
            y = [zlib.crc32(w.encode()) * a % imatch.PRIME for w in kept]
            parts.append(md(str(v) for v in y if v < 1 << len(f"{min(y):b}")))
        out.append("".join(parts))
    return out


def plain(rows):
    """Without characters whose lower case is a matter of tables."""
    return [(i, t and t.replace("İ", "I"), lang, s) for i, t, lang, s in rows]


def test_imatch(spark, rows):
    rows = plain(rows)
    prints = brute_fingerprints(rows, [t for _, t, *_ in rows])
    got = imatch.fingerprints(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter(zip([i for i, *_ in rows], prints))
    by_text = defaultdict(set)
    for (_, t, *_), p in zip(rows, prints):
        by_text[t or ""].add(p)
    assert all(len(p) == 1 for p in by_text.values()) and len({p for s in by_text.values() for p in s}) > 0.9 * len(by_text)


def test_imatch_bears_an_edit(spark, rows):
    rows = plain(rows)
    distinct = sorted({(i, t or "") for i, t, *_ in rows if i is not None})  # rows of null ids come first, in the order of a hash
    got = imatch.edit_study(docs_of(spark, [r for r in rows if r[0] is not None])).collect()
    assert len(got) == sum(r[0] is not None for r in rows)
    own = [r for r in rows if r[0] is not None]
    edited = {}
    for k, (i, t) in enumerate(distinct):
        half = len(t) // 2
        edited[i] = (t[: len(t) - half] + distinct[(k + 1) % len(distinct)][1][:half], distinct[(k + 1) % len(distinct)][1], t)
    texts = [x for v in edited.values() for x in v]
    prints = dict(zip(texts, brute_fingerprints(own, texts)))
    share = lambda a, b: sum(a[k : k + 8] == b[k : k + 8] for k in range(0, len(a), 8)) / (imatch.FAMILIES + 1)
    for r in got:
        e, after, t = edited[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), prints[t], prints[e])
        assert abs(r.near_edited - share(prints[t], prints[e])) < 1e-12 and abs(r.near_next - share(prints[t], prints[after])) < 1e-12
    whole = imatch.edit_study(docs_of(spark, rows)).collect()
    assert Counter(r.doc_id for r in whole) == Counter(r[0] for r in rows)


def test_imatch_of_few_rows(spark):
    assert imatch.edit_study(docs_of(spark, [])).count() == imatch.fingerprints(docs_of(spark, [])).count() == 0
    one = imatch.edit_study(docs_of(spark, [(1, "abcd", "en", "s")])).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    assert imatch.edit_study(docs_of(spark, [(None, None, None, None)])).collect()[0].n_chars == 0


def test_no_row_holds_the_lexicon(spark, rows):
    study = imatch.edit_study(docs_of(spark, rows))
    assert "AS __slots" not in study._jdf.queryExecution().optimizedPlan().toString()


def audit(rows, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, lang, s in rows:
        lang, s = lang or "", s or ""
        words = term.findall((t or "").translate(FOLD))
        groups[lang].add(s)
        counts[lang, s].update(words)
        in_docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [w for w, c in in_docs[lang].items() if c >= 3]
        total = {s: sum(counts[lang, s][w] for w in kept) for s in sources}
        p = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            mine = {w: p(counts[lang, s][w], total[s]) for w in kept}
            pairs = [(-sum(f(mine[w], p(counts[lang, o][w], total[o])) for w in kept), o.encode(), o) for o in sources if o != s]
            both = {w: p(sum(counts[lang, o][w] for o in sources), sum(total.values())) for w in kept}
            terms = [(-f(mine[w], both[w]), w.encode(), w) for w in kept if counts[lang, s][w] and mine[w] > both[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return out


@pytest.mark.parametrize("top", [200, 3])
def test_divergence(spark, rows, top):
    got = source_divergence(docs_of(spark, rows), top_terms=top).collect()
    assert Counter(tuple(r) for r in got) == Counter(audit(rows, top))
    assert any(r.part == "pair" and r.value for r in got) and any(r.part == "term" for r in got)


def test_divergence_of_odd_tables(spark):
    assert source_divergence(docs_of(spark, [])).count() == 0
    rows = [(k, "rare words", "en", f"s{k}") for k in range(2)] + [(9, None, "fr", "alone")]
    assert Counter(tuple(r) for r in source_divergence(docs_of(spark, rows)).collect()) == Counter([("en", "s0", "pair", "s1", 0, 1), ("en", "s1", "pair", "s0", 0, 1)])
    hot = [(k, "same words here", "en", "hot") for k in range(60)] + [(100 + k, "other here", "en", f"s{k}") for k in range(4)]
    assert Counter(tuple(r) for r in source_divergence(docs_of(spark, hot)).collect()) == Counter(audit(hot))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_importance", "op12_imatch", "op13_divergence"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert got == sorted((tuple(plain(x) for x in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
