"""Line dedup, revisit resolution and the pipeline against brute force."""

import re
from collections import Counter, defaultdict

import pytest

from confera.llm import line_dedup, revisits
from test_contract_ops import SCHEMA, _components, _simhash, docs_of, le32, norm, token_ids, word_shingles  # noqa: F401


def _norm(line):
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def _cut(text, end):
    at = 0
    for m in re.finditer(end, text):
        yield text[at : m.end()]
        at = m.end()
    if at < len(text):
        yield text[at:]


def _expected(spark, rows, end, least):
    """Brute force: for each distinct row of id and text the units that go, and its text without them."""
    docs = list(dict.fromkeys((i, t) for i, t, _ in rows))
    hashes = [r[0] for r in spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], "k int, t string").orderBy("k").selectExpr("xxhash64(t)").collect()]
    ranked = sorted(zip(docs, hashes), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1]))
    first, copies, want, left = {}, Counter(), [], {}
    times = Counter((i, t) for i, t, _ in rows)
    for (i, t), _ in ranked:
        at, run, marked = 0, [], []
        for n, part in enumerate(_cut(t or "", end)):
            key = _norm(part)
            if key:
                copies[key] += times[(i, t)]
                run = [*run, (n, at, len(part), key)] if key in first else []
                if run:
                    marked.append(run)
                first.setdefault(key, (i, at))
            at += len(part)
        gone = {u for run in marked for u in run if sum(len(x[3].split()) for x in max((r for r in marked if r[0] == run[0]), key=len)) >= least}
        want += [(i, at, m, len(key.split()), *first[key], key) for _, at, m, key in gone]
        cuts = {a: m for _, a, m, _ in gone}
        left[(i, t)] = None if t is None else "".join(c for k, c in enumerate(t) if not any(a <= k < a + m for a, m in cuts.items()))
    return Counter((*w[:6], copies[w[6]]) for w in want), left


@pytest.mark.parametrize(("unit", "end", "least"), [("line", r"\n", 1), ("line", r"\n", 6), ("clause", r"[.,;:!?][\x20\x09-\x0D]+|\n", 4), ("clause", r"[.,;:!?][\x20\x09-\x0D]+|\n", 1), ("paragraph", r"\n[ \t\r]*(?:\n[ \t\r]*)+", 1)])
def test_line_dedup_against_brute_force(spark, unit, end, least):
    import random

    rng = random.Random(3)
    parts = ["one", "Two words.", "a b c d e, ", "été  ß\t日本. ", "x", ", ", "\n", "\n\n", "\n \n", " ", "end!", "A B C", "tail: "]
    rows = [(rng.choice([1, 2, 3, 4, 5, 5, 6, None, None]), "".join(rng.choice(parts) for _ in range(rng.randrange(25))), "s") for _ in range(40)]
    rows += [(8, None, "s"), (None, None, "s"), (9, "", "s"), (10, " \n\n ", "s"), rows[0], rows[0], rows[5], (11, "very long line " * 20_000 + "\nAnd on.", "s"), (5, "completely other text that must stay whole please", "s"), (12, "and on.", "s")]
    docs = docs_of(spark, rows)
    want, left = _expected(spark, rows, end, least)
    got = line_dedup.repeated_units(docs, unit=unit, min_run_words=least)
    assert Counter(tuple(r) for r in got.drop("text_hash").collect()) == want and want
    out = line_dedup.substring_dedup(docs, unit=unit, min_run_words=least)
    assert out.columns == [*docs.columns, "removed_spans"]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, left[(i, t)]) for i, t, _ in rows)
    assert line_dedup.substring_dedup(docs.limit(0), unit=unit).count() == 0


def test_line_dedup_of_clashing_ids(spark):
    other = "completely other text that must stay whole please"
    rows = [(5, "head\nsame line here\ntail", "s"), (3, "same line here", "s"), (5, other, "s"), (None, "same line here\nx", "s"), (None, "x", "s")]
    out = Counter((r.doc_id, r.text) for r in line_dedup.substring_dedup(docs_of(spark, rows)).collect())
    # Of "x" one of the two rows of null id keeps it, by the hash of the whole text.
    assert out[(5, "head\ntail")] == out[(3, "same line here")] == out[(5, other)] == 1
    assert sorted(t for (i, t), n in out.items() if i is None) == ["", "x"]


def _canon(u):
    u = u.split("#")[0]
    head = re.match(r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", u)
    head = head[1] if head else ""
    path, _, query = u[len(head) :].partition("?")
    head = re.sub(r"^(https://[^/?]*):443$", r"\1", re.sub(r"^(http://[^/?]*):80$", r"\1", head.lower()))
    kept = sorted(x for x in query.split("&") if x and not re.match(r"(utm_[^=]*|ref|fbclid|gclid)(=|$)", x))
    return head + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")


@pytest.mark.parametrize("span", [86_400, 50])
def test_revisits(spark, span):
    import random

    rng = random.Random(1)
    urls = ["http://A.com:80/x/?b=1&utm_source=q&a=2#f", "http://a.com/x?a=2&b=1", "https://b.org:443", "https://b.org/", "https://c.net/y", None]
    records = []
    for k in range(300):
        kind = rng.choice(["response", "revisit", "revisit", "metadata"])
        headers = {"etag": rng.choice(['"1"', 'W/"1"', '"2"']), "last-modified": rng.choice(["m1", "m2"]), "content-length": str(k), "date": f"d{k}", "x": "y"}
        for h in list(headers):
            if rng.random() < 0.3:
                del headers[h]
        records.append((k, rng.choice(urls), rng.choice([None, *range(0, 400)]), kind, headers if rng.random() < 0.95 else None, "extra"))
    df = spark.createDataFrame(records, "record_id bigint, url string, ts bigint, kind string, headers map<string,string>, status string")
    got = {r.record_id: r for r in revisits.resolve_revisits(df, span_seconds=span).collect()}
    assert set(got) == {r[0] for r in records if r[3] == "revisit"}
    seen = Counter()
    for i, u, ts, kind, headers, _ in records:
        if kind != "revisit":
            continue
        r, headers = got[i], headers or {}
        base = max(((t, j, h or {}) for j, v, t, k, h, _ in records if k == "response" and u is not None and ts is not None and v is not None and t is not None and _canon(v) == _canon(u) and t < ts), key=lambda x: x[:2], default=None)
        if base is None:
            status = "no_base"
        elif "etag" in headers:
            status = "resolved" if headers["etag"].removeprefix("W/") == base[2].get("etag", "?").removeprefix("W/") else "mismatch"
        else:
            status = "resolved" if "last-modified" not in headers or headers["last-modified"] == base[2].get("last-modified") else "mismatch"
        seen[status] += 1
        assert (r.status, r.base_id, r.base_ts) == ((status, base[1], base[0]) if status == "resolved" else (status, None, None))
        if status == "resolved":
            assert r.headers == base[2] | {k: v for k, v in headers.items() if k in revisits.PERMITTED}
    assert len(seen) == 3
    assert revisits.resolve_revisits(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    import random
    import zlib

    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 60, 200]))) for _ in range(150)]
    texts += [t + " idiot scum loser" for t in texts[:40]] + texts[40:60] + [t.replace(" ", "\n", 3) for t in texts[60:70]] + [t[:-1] for t in texts[70:90]] + [None, ""]
    rows = [(k, t, rng.choice(["a", "b", None])) for k, t in enumerate(texts)]
    docs_of(spark, rows).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    toxic = {k for k, t in enumerate(texts) if t and "idiot" in t}
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(len(texts))], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, columns, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), None, []
    for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns
        ids.append(sorted(r.doc_id for r in docs.collect()))
    by = dict(enumerate(texts))
    assert ids[0] == sorted(set(by) - toxic)
    least = {}
    for i in ids[0]:
        least.setdefault(norm(by[i]), i)
    assert ids[1] == sorted(least.values())
    prints = [(i, _simhash(by[i])) for i in ids[1]]
    sets = [word_shingles(by[i]) for i, _ in prints]
    alike = _components(prints, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0)
    assert ids[2] == sorted(i for (i, _), c in zip(prints, alike) if i == c) and alike != _components(prints)
    taken = Counter(ids[3])
    assert set(taken) <= set(ids[2]) and max(taken.values()) <= 2
    got = pipeline.run(spark, str(tmp_path)).collect()
    want = Counter()
    for i, n in taken.items():
        tokens = [*token_ids(by[i]), 0]
        for k, at in enumerate(range(0, len(tokens), 2048)):
            want[(i, k, at, zlib.crc32(le32(tokens[at : at + 2048])))] += n
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 2048 for p in places.values())


def test_pipeline_of_an_empty_table_and_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    odd = [(None, None, "s"), (None, "", None), (1, "same words here", "s"), (1, "same words here", "s"), (2, "long " * 30_000, None), (3, "other words there", "t")]
    for name, rows, most in (("empty", [], 0), ("odd", odd, 12)):
        docs_of(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.coalesce(1).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len({(r.doc_id, r.start) for r in got}) <= 60 and (len(got) > 0) == bool(most)
