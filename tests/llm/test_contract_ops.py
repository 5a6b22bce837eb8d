"""The dealt operators against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from confera.llm import mixing, packing, quality_rules, simhash, sstable, toxicity, url_filter
from confera.llm.bloom import Cascade
from confera.llm.exact_dedup import drop_copies, exact_dedup
from confera.llm.queries import BLOCKED_HOSTS, URL_RULES, tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int, n int, h string, norm string, row int, fp int, draw int, score double, size string, name string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 1, 2, "x", "y", 3, 4, 5, 0.5, "z", "w") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "d", "été", "Straße.", "the", "of", "the", "naïve", "x1", "don't", "<|endoftext|>", "日本", "#tag", "50%"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 40, 80, 300]))) for _ in range(60)]
    texts += [texts[8], texts[9].replace(" ", " \n\t"), None, "", " \n ", "a b c d " * 30, "line one\nline one\nline two\n\n" * 20, "word " * 3000]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    out = [(i, t, rng.choice(["s1", "s2", None, "S"])) for i, t in zip(ids, texts)]
    return out + [out[3], (None, "a null id", "s1"), (None, texts[8], None)]


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(spark, rows):
    import hashlib

    got = exact_dedup(docs_of(spark, rows), digests=True).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[hashlib.sha256(norm(t).encode()).hexdigest()].append(i)
    kept = Counter()
    for r in got:
        ids = [i for i in groups[r.text_sha256] if i is not None]
        assert r.group_size == len(groups[r.text_sha256])
        assert r.keep_id == (min(ids) if ids else None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    stayed = drop_copies(docs_of(spark, rows))
    assert stayed.columns == docs_of(spark, rows).columns
    assert sorted((r.doc_id is None, r.doc_id) for r in stayed.collect()) == sorted((r.doc_id is None, r.doc_id) for r in got if r.kept)
    full_filter = exact_dedup(docs_of(spark, rows), digests=True, filter_words=1, prefix_chars=1).collect()
    assert sorted(map(str, full_filter)) == sorted(map(str, got))


def test_quality_statistics(spark, rows):
    got = {(r.doc_id, r.word_chars, r.n_words): r for r in quality_rules.text_statistics(docs_of(spark, rows)).collect()}
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        cover = {p for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for p in (k, k + 1, k + 2)}
        r = got[(i, sum(map(len, w)), len(w))]
        assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))


def test_decision_list_against_brute_force(spark):
    """The ordered conditional against the rules applied one by one in Python."""
    rng = random.Random(17)
    rows = [(k, rng.choice([True, False]), *[rng.randrange(1, 90) for _ in range(7)]) for k in range(300)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits"]
    df = spark.createDataFrame([(k, bad or r[2] > 70, *r) for k, bad, *r in rows], "doc_id bigint, bad boolean, " + ", ".join(f"{n} bigint" for n in names))
    learned = quality_rules.learn_rules(df)
    assert learned.rules
    features = lambda r: {"n_words": r.n_words, "mean_word": r.word_chars / max(r.n_words, 1), "symbols": r.n_symbols / max(r.n_words, 1), "dup_lines": r.n_dup_lines, "repeated": r.n_repeat_words / max(r.n_words, 1), "upper": r.n_upper / max(r.word_chars, 1), "digits": r.n_digits / max(r.word_chars, 1)}
    for r in df.withColumn("rejected", learned.rejects()).collect():
        x = features(r)
        assert r.rejected == any(all((x[c.feature] >= c.threshold) == c.above for c in rule.conditions) for rule in learned.rules)


def test_quality_rules_learn(spark):
    rng = random.Random(1)
    clean = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(80)), "s") for i in range(120)]
    junk = [(1000 + i, " ".join(f"w{rng.randrange(10**6)}{'#' if k % 2 else '%%'}" for k in range(80)), "s") for i in range(60)]
    docs = docs_of(spark, clean + junk)
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in clean[:80]] + [(i, 0, 0) for i, _, _ in junk[:40]] + [(None, 0, 0), (5, None, 1)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert all(got[i].kept for i, _, _ in clean) and not any(got[i].kept for i, _, _ in junk)
    for r in got.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    none = quality_rules.quality_rules(docs, labels.limit(0)).collect()
    assert all(r.kept for r in none)
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0


def _url_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for v, rule in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (v, rule)
    spam = any(host == h or host.endswith("." + h) for h in BLOCKED_HOSTS)
    return host, path, best and best[1], best[0] if best else "block" if spam else "allow"


def test_url_filter(spark):
    urls = ["http://A.example.net/en/1?x=/de/", "https://example.net/en", "https://example.net/en/", "https://x.net", "https://net/", "http://notexample.net/fr/", "https://b.example.com/de/x#/en/", "https://example.com/den", "http://a.org/fr/", "http://org.com/fr/", None, "", "no scheme", "http://www.spam-farm.example.org/en/1", "http://xspam-farm.example.org/", "http://spam-farm.example.org/fr/1", "http://a..net/", "x://y://z.net/", "http://Ä.NET/", "http://example.net:80/en/"] * 2
    pages = spark.createDataFrame([(i, u, "h", "block") for i, u in enumerate(urls)], "page_id bigint, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, URL_RULES, BLOCKED_HOSTS).collect()}
    assert got == {i: _url_verdict(u) for i, u in enumerate(urls)}
    assert url_filter.url_filter(pages.limit(0), URL_RULES, BLOCKED_HOSTS).count() == 0


def test_url_filter_with_a_long_list(spark):
    hosts = [f"h{k}.site{k % 977}.test" for k in range(100_000)]
    wanted = [hosts[k] for k in range(0, 100_000, 997)]
    urls = [f"http://{h}/en/1" for h in wanted] + [f"https://a.b.{h.upper()}?x" for h in wanted] + [f"http://x{h}/" for h in wanted] + [f"http://site{k}.test/" for k in range(500)] + ["http://" + "a." * 200 + hosts[3]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in url_filter.url_filter(pages, URL_RULES, hosts + hosts[:5]).collect()}
    assert got == {i: "block" if i < 2 * len(wanted) or i == len(urls) - 1 else "allow" for i in range(len(urls))}
    assert {r.verdict for r in url_filter.url_filter(pages, [], []).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(5000).selectExpr("concat('k', id) key")
    listed = spark.range(5000).filter("id % 37 = 3").selectExpr("concat('k', id) key")
    cascade = Cascade.build(universe, listed)
    assert len(cascade.levels) > 1
    got = {r.key for r in universe.filter(cascade.contains(universe.key)).collect()}
    assert got == {r.key for r in listed.collect()}
    assert not universe.filter(Cascade.build(universe, listed.limit(0)).contains(universe.key)).count()
    assert not Cascade.build(universe.limit(0), listed).levels


def token_ids(text):
    from tokenizers import Tokenizer

    token_ids.t = getattr(token_ids, "t", None) or Tokenizer.from_file(tokenizer_path())
    return token_ids.t.encode(text or "", add_special_tokens=False).ids


def le32(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_agrees_with_the_tokenizer(file):
    import public_tokenizers
    from tokenizers import Tokenizer

    from confera.llm.tokens import Encoder

    rng = random.Random(11)
    plain = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA0, 0x100)]]
    odd = [*"İıſŒœΣσςÅ日本語", "\x0b", "\x1c", "\x85", "\u00a0", "\u0301", "\u0331", "\u0307", "\u3000", "😀", "<|startoftext|>", "<|StartOfText|>", "<|endoftext|>", "'S", "'re", "ß", " H", "I"]
    path = public_tokenizers.path(file)
    own, library = Encoder(path), Tokenizer.from_file(path)
    assert own.apart == (file == "word_bpe_49k.json")
    texts = [None, "", " \n"] + ["".join(rng.choice(plain if k % 2 else plain + odd * 4) for _ in range(rng.randrange(30))) for k in range(4000)]
    texts.append(" ".join(texts[3:]))
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        assert own.encode(part) == [le32(library.encode(t or "", add_special_tokens=False).ids) for t in part]


@pytest.mark.parametrize("ends", [True, False])
def test_encoder_gives_the_library_many_new_pieces_at_once(ends, tmp_path):
    import json
    from pathlib import Path

    from tokenizers import Tokenizer

    from confera.llm.tokens import TOGETHER, Encoder

    spec = json.loads(Path(tokenizer_path()).read_text())
    if not ends:  # the last token of pieces that end with one of these letters is gone, and the library drops the letter
        model = spec["model"]
        lost = {t for t in model["vocab"] if t in ("y</w>", "!</w>", "7</w>") or t.endswith("y</w>")}
        model["vocab"] = {t: i for t, i in model["vocab"].items() if t not in lost}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        model["merges"] = [p for p in pairs if not {*p, "".join(p)} & lost]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    own, library, handed = Encoder(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json")), []
    own.whole = lambda texts, whole=own.whole: handed.extend(texts) or whole(texts)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeioxyßéü") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    words += ["don't", "'re", "'", "''s", "!", "!!", "7", "77", "</w>", "a</w>", "<|w>", "x÷y", "日本", "A!", "İ", "\u3000", "e\u0301"]
    texts = [" ".join(rng.sample(words, 40)) for _ in range(200)] + [" ".join(words), *words]
    assert own.encode(texts) == [le32(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert not ends or len(handed) < 3000 / TOGETHER + 300
    assert len(own.known) > 2500


def test_pack(spark, rows):
    got = packing.pack(docs_of(spark, rows), tokenizer_path(), with_ids=True).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = [*token_ids(t), 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(i, k, at, len(part), zlib.crc32(le32(part)))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(r.length for r in got) // 2048)
    assert packing.pack(docs_of(spark, rows).limit(0), tokenizer_path()).count() == 0


def _fewest(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[j] += items[i]
            go(i + 1, bins)
            bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_bin_completion_against_brute_force():
    rng = random.Random(2)
    for _ in range(120):
        items = sorted((rng.randint(1, 30) for _ in range(9)), reverse=True)
        counts = np.bincount(items, minlength=31)
        solution = packing.bin_completion(counts, 30)
        left = counts.copy()
        for pattern, times in solution:
            assert sum(s * c for s, c in pattern) <= 30
            for s, c in pattern:
                left[s] -= c * times
        assert not left.any()
        assert sum(t for _, t in solution) == _fewest(items, 30)
        assert packing.lower_bound(counts, 30) <= _fewest(items, 30)


def test_bin_completion_of_few_short_lengths():
    # Three of each make 2040 of 2048; best-fit decreasing keeps the lengths apart: 1,100 sequences.
    counts = np.bincount([350] * 3000 + [330] * 3000, minlength=2049)
    assert sum(t for _, t in packing.bin_completion(counts)) == 1000


def test_fillings_are_the_undominated_ones():
    rng = random.Random(8)
    for _ in range(60):
        room = rng.randint(5, 30)
        items = sorted((rng.randint(1, 20) for _ in range(8)), reverse=True)
        every = {tuple(items[i] for i in range(8) if m >> i & 1) for m in range(256)}
        fits = [f for f in every if sum(f) <= room]

        def parts(f, sizes):  # whether the items of f fit into places of these sizes
            return not f or any(s >= f[0] and parts(f[1:], (*sizes[:k], s - f[0], *sizes[k + 1 :])) for k, s in enumerate(sizes))

        best = {f for f in fits if not any(g != f and parts(f, g) for g in fits)}
        counts = np.bincount([*items, 31], minlength=32)
        got = [f for f in packing.fillings(counts, 31, room, room) if f is not None]
        assert best <= set(got) and len(got) == len(set(got)) and all(f in fits for f in got)


def test_token_store(spark, rows, tmp_path):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in sstable.token_store(docs_of(spark, rows), tokenizer_path()).collect())
    assert Counter((i, n, c) for _, i, n, c in got) == Counter((i, len(token_ids(t)) + 1, zlib.crc32(le32([*token_ids(t), 1]))) for i, t, _ in rows)
    at, ids = 0, []
    for start, i, n, _ in got:
        assert start == at
        at += n
        ids.append((i is not None, i or 0))
    assert ids == sorted(ids)
    assert sstable.token_store(docs_of(spark, rows).limit(0), tokenizer_path()).count() == 0


def test_lookup_by_id(spark, rows, tmp_path):
    docs = docs_of(spark, rows)
    shards = sstable.write_shards(docs, tokenizer_path(), f"file://{tmp_path}/shards", shard_bytes=200)
    assert len(shards) > 4 and sum(r["docs"] for r in shards) == len(rows)
    wanted = spark.createDataFrame([(i,) for i in [None, 5, -3, 101, 102, 102, 120, 10**15, rows[3][0]]], "doc_id bigint")
    got = Counter((r.doc_id, bytes(r.ids)) for r in sstable.lookup(wanted, shards).collect())
    keys = {r.doc_id for r in wanted.collect()}
    assert got == Counter((i, le32([*token_ids(t), 1])) for i, t, _ in rows if i in keys)
    with pytest.raises(TypeError):
        sstable.write_shards(docs, tokenizer_path(), f"file://{tmp_path}/none", id_col="text")


def test_shard_lookup(tmp_path):
    rng = random.Random(3)
    ids = sorted([rng.randrange(-(10**12), 10**12) for _ in range(3000)] + [7] * 5)
    values = [struct.pack(f"<{n}I", *[rng.randrange(1 << rng.choice([8, 15, 20])) for _ in range(n)]) for n in (rng.randrange(0, 40) for _ in ids)]
    path = tmp_path / "x.sst"
    with path.open("wb") as f:
        w = sstable.Writer(f, block_bytes=500)
        w.add(sstable.key_of(None), b"")
        for i, v in zip(ids, values):
            w.add(sstable.key_of(i), v)
        w.close()
    with path.open("rb") as f:
        shard = sstable.Shard(f)
        assert list(shard) == [(None, b""), *zip(ids, values)]
        by = defaultdict(list)
        for i, v in zip(ids, values):
            by[i].append(v)
        assert all(shard.get(i) == by[i] for i in [*ids[::7], 7, 10**13, 8])
        assert sum(shard.may_have(i) for i in range(10**13, 10**13 + 500)) < 25


def _simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def word_shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def _components(prints, linked=lambda a, b: False):
    n = len(prints)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2 or linked(a, b):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(n)]


@pytest.mark.parametrize("families", [10, 1])
def test_near_duplicates(spark, rows, families):
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    near = []
    for k in range(70):  # a chain of small changes
        base = list(base)
        base[rng.randrange(200)] = f"v{k}"
        near.append((5000 - k, " ".join(base), "s"))
    every = rows + near
    got = simhash.near_duplicates(docs_of(spark, every), families=families).collect()
    prints = [(i, _simhash(t)) for i, t, _ in every]
    want = Counter((i, f"{p:016x}", c) for (i, p), c in zip(prints, _components(prints)))
    assert Counter(tuple(r) for r in got) == want
    assert len({c for _, _, c in want}) < len(every) - 20
    stayed = simhash.keep_one(docs_of(spark, every)).collect()
    assert Counter(r.doc_id for r in stayed if r.doc_id is not None) == Counter({c for _, _, c in want if c is not None})


def test_keep_one_with_repeated_and_null_ids(spark):
    rng = random.Random(6)
    a, b, c, d, e = (" ".join(f"{k}{rng.randrange(900)}" for _ in range(80)) for k in "abcde")
    # 3 and 7 repeat: 3 with unrelated texts and a copy, 7 with a copy of 1 and a text of its own.
    rows = [(None, a, "s"), (None, b, "s"), (None, b, "s"), (3, c, "s"), (3, d, "s"), (3, d, "s"), (1, a, "s"), (7, a, "s"), (7, e, "s"), (9, c, "s"), (None, None, "s")]
    got = Counter((r.doc_id, r.text) for r in simhash.keep_one(docs_of(spark, rows)).collect())
    assert got == Counter([(None, a), (None, b), (None, b), (None, None), (3, c), (3, d), (1, a), (7, e)])


def test_fingerprint_links_find_every_pair(spark):
    rng = random.Random(6)
    points = {rng.getrandbits(64) for _ in range(50)}
    for p in list(points)[:20]:
        for _ in range(25):
            for k in range(rng.randrange(1, 5)):
                p ^= 1 << rng.randrange(64)
            points.add(p)
    points |= {0, 1, 1 << 63, (1 << 63) | 1, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    for bits in (0, 1, 2):
        links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), bits=bits).collect()
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= bits for a, b in ((r.a, r.b) for r in links))
        assert _closure(signed, [(r.a, r.b) for r in links]) == _closure(signed, [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits])


def test_pivot_table_discards_pairs_and_keeps_links(spark):
    rng = random.Random(12)
    points = {rng.getrandbits(64) for _ in range(3000)}
    points |= {p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for p in sorted(points)[:60]}
    points |= {p ^ 0x0007_0007_0007_0007 for p in sorted(points)[:60]}  # near, but not linked
    every = np.array(sorted(points), dtype=np.uint64)
    linked = [(int(a), int(b)) for a in every for b in every[np.bitwise_count(every ^ a) <= 2] if a < b]
    partners = {x for pair in linked for x in pair}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in points], "fp bigint")
    table = {r.fp: r.row for r in simhash.pivot_table(df).collect()}
    references = simhash.pivots()
    assert len(references) == 50 and all(row == [((fp ^ x) & (1 << 64) - 1).bit_count() for x in references] for fp, row in list(table.items())[:50])
    kept = {r.fp for r in simhash.surviving(df).collect()}
    assert {signed(p) for p in partners} <= kept
    # Of about 4.9 million pairs hardly any is left: the table does the search.
    assert len(kept) <= len(partners) + 10
    # Fewer references tell less apart, but lose no link.
    assert kept <= {r.fp for r in simhash.surviving(df, families=1).collect()}
    assert len(linked) > 50 and all(max(abs(x - y) for x, y in zip(table[signed(a)], table[signed(b)])) <= 2 for a, b in linked)


def _closure(nodes, links):
    of = {n: {n} for n in nodes}
    for a, b in links:
        if of[a] is not of[b]:
            of[a] |= of[b]
            for x in of[b]:
                of[x] = of[a]
    return {frozenset(s) for s in of.values()}


def test_toxicity(spark):
    rng = random.Random(7)
    plain = [f"{a}{b}" for a in ("mor", "tan", "vel", "ist", "kor", "pen") for b in ("a", "en", "ish", "ort", "ul", "ine", "os")]

    def text(bad=(), n=60):
        w = [rng.choice(plain) for _ in range(n)]
        for b in bad:
            w.insert(rng.randrange(len(w)), b)
        return " ".join(w)

    rude = ["idiot", "scum", "zorqua", "zorqui", "zorqlen", "zorqat"]
    toxic = [(i, text(rng.sample(rude, 2)), "s") for i in range(200)]
    clean = [(1000 + i, text(["trash can"] * (i % 3 == 0)), "s") for i in range(600)]
    disguised = [(3000, text(["іdiоt", "ѕcum"]), "s"), (3001, text(["1d10t", "$cum"]), "s"), (3002, text(["zorqnew", "zorqova"]), "s"), (3003, text(["ＩＤＩＯＴ", "SCUM"]), "s")]
    fine = [(4000, text(["2019", "4k", "covid19"]), "s"), (4001, None, "s"), (4002, "", "s"), (4003, text(n=20000), "s")]
    docs = docs_of(spark, toxic + clean + disguised + fine + [(None, "idiot scum idiot", "s")])
    labels = spark.createDataFrame([(i, 1, 1) for i, _, _ in toxic] + [(i, 1, 0) for i, _, _ in clean] + [(None, 1, 1), (9, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[i].predicted == 1 for i, _, _ in toxic + disguised)
    assert all(got[i].predicted == 0 and 0 <= got[i].score <= 1 for i, _, _ in clean + fine)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got if i is not None)
    assert got[None].predicted == 1 and not got[None].held_out
    stayed = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert stayed == {i for i, r in got.items() if not r.predicted}
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_toxicity_exceptions():
    lexicon = toxicity.Lexicon({"trash": 6.0}, {"zor": 5.0}, ["trash can"], -4.0)
    score = toxicity.Scorer(lexicon).score
    assert score("you are trash") > 0.7 > score("the trash can is full")
    assert score("the trash can, you trash") > 0.7
    assert score("azor blah") < 0.1 < score("zorblah")


def _naive_score(lexicon, text):
    """Every pattern sought at every place of the folded text."""
    folded = toxicity.fold(text)
    entries = {f" {w} ": x for w, x in lexicon.words.items()}
    heads = {f" {w}": x for w, x in lexicon.beginnings.items()}
    covered = {(k, k + len(p) + 1) for p in lexicon.exceptions for k in range(len(folded)) if folded.startswith(f" {p} ", k)}
    times = defaultdict(list)
    for k in range(len(folded)):
        met = [(x, p) for p, x in [*entries.items(), *heads.items()] if folded.startswith(p, k)]
        if met:
            x, p = max(met, key=lambda m: m[0])
            if not any(a <= k and k + len(p) - 1 <= b for a, b in covered):
                times[p].append(x)
    total = lexicon.prior + sum(x[0] * (1 + math.log(len(x))) for x in times.values()) - math.log1p((folded.count(" ") - 1) / 400)
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))


def test_scorer_against_a_naive_matcher():
    rng = random.Random(13)
    letters = ["ab", "ba", "abc", "cab", "b", "a", "é", "x1", "aa", "bb"]
    for _ in range(150):
        words = lambda n: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 2))) for _ in range(n)]
        lexicon = toxicity.Lexicon({toxicity.fold(w).strip(): rng.uniform(1, 9) for w in words(8)}, {toxicity.fold(w).strip(): rng.uniform(1, 9) for w in words(5)}, [toxicity.fold(" ".join(words(2))).strip() for _ in range(6)], rng.uniform(-9, 0))
        scorer = toxicity.Scorer(lexicon)
        for text in [" ".join(words(rng.randrange(60))) for _ in range(6)] + ["", None, ". , -", "AB  ab\nab"]:
            assert scorer.score(text) == pytest.approx(_naive_score(lexicon, text))


def test_toxicity_of_ties_repeats_and_empty_tables(spark):
    docs = docs_of(spark, [(1, "zorq ab", "s"), (2, "zorq ab", "s"), (2, "zorq ab", "s"), (3, None, "s")])
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, 0), (2, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0 and toxicity.drop_toxic(docs.limit(0), labels.limit(0)).count() == 0


def _targets(sizes, weights, total):
    open_, out = set(range(len(sizes))), {}
    while True:
        rest = total - sum(out.values())
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / w > 2 * sizes[i]}
        if not over:
            return {**out, **{i: rest * weights[i] / w for i in open_}}
        out |= {i: 2 * sizes[i] for i in over}
        open_ -= over


def test_mix(spark, rows):
    rng = random.Random(8)
    more = [(10_000 + k, "w " * rng.randrange(1, 90), rng.choice(["s1", "s1", "s1", "S", "s2", "", None])) for k in range(900)]
    every = rows + more
    docs = docs_of(spark, every)
    got = mixing.mix(docs).collect()
    names = sorted({s for _, _, s in every}, key=lambda s: (s is None, (s or "").encode()))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = [sum(size(t) for _, t, s in every if s == n) for n in names]
    want = _targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes))
    taken = Counter()
    at = {}
    for i, n in enumerate(names):
        at[sizes[i]] = want[i]
    for r in got:
        assert r.target == pytest.approx(at[r.source_size]) and 0 <= r.taken <= 2 * r.size
        taken[r.source_size] += r.taken
    longest = max(size(t) for _, t, _ in every)
    assert all(abs(taken[s] - at[s]) <= longest for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    repeated = Counter((r.doc_id, r.text, r.source) for r in mixing.repeat_documents(docs).collect())
    by = Counter()
    for (i, t, s), n in repeated.items():
        by[i] += n * size(t)
    assert +by == +sum((Counter({r.doc_id: r.taken}) for r in got), Counter())
    assert mixing.mix(docs.limit(0)).count() == 0
