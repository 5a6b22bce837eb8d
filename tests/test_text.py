import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from confera.functions import pii, text


@pytest.fixture(scope="module")
def one(spark):
    return lambda column, **values: spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).head().x


def test_rounding_is_half_up(one):
    for x, n, want in ((0.5, 0, 1.0), (-0.5, 0, 0.0), (2.345, 2, 2.35), (1.25, 1, 1.3), (-1.25, 1, -1.2)):
        assert one(text.js_round(F.col("a"), n), a=x) == pytest.approx(want)


def test_clamps(one):
    assert one(text.factor(F.lit(9.96))) == 8.0
    assert one(text.penalty(F.lit(-3.0))) == 0.0
    assert one(text.grade(F.lit(3.5))) == 4
    assert one(text.ratio(F.lit(1), F.lit(0), 0.5)) == 0.5


def test_lengths_and_truncation(one):
    assert one(text.utf16_length(F.col("a")), a="a😀b") == 4
    assert one(text.token_estimate(F.lit(""))) == 1
    assert one(text.token_estimate(F.lit("12345678"))) == 5
    assert one(text.truncated(F.lit("abcdef"), 4)) == "abcd…"
    assert one(text.truncated(F.lit("abcdef"), 4, 3)) == "abc…"
    assert one(text.trimmed(F.lit("　 a "))) == "a"


def test_times(one):
    assert one(text.parse_time_ms(F.lit("2026-04-15T20:00:00+08:00"))) == 1776254400000
    assert one(text.parse_time_ms(F.lit("never"))) is None


def test_fingerprint(one):
    assert one(text.question_fingerprint(F.lit("为什么 还没　处理？！"))) == "为什么还没处理"
    assert len(one(text.question_fingerprint(F.lit("x" * 50), 20))) == 20


def test_hashes(one):
    assert one(text.fnv1a(F.lit("abc"))) == 0x1A47E90B
    a, b = "Ｈｅｌｌｏ，  world!", "hello world"
    assert one(text.transcript_hash(F.lit(a))) == one(text.transcript_hash(F.lit(b)))
    assert one(text.nfkc(F.lit("①ﬁ"))) == unicodedata.normalize("NFKC", "①ﬁ")
    assert one(text.lexical_tokens(F.lit("ab abc d"))) == ["ab", "ab", "bc", "d"]


def test_vectors(one):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(text.cosine(arr(1, 0), arr(1, 0, 0))) == 1.0
    assert one(text.cosine(arr(0, 0), arr(1, 0))) == 0.0
    assert one(text.metric_distance(arr(1, 1), arr(0, 0))) == 1.0
    tags = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(text.tag_distance(tags("a", "b"), tags("b", "c"))) == 0.6667
    assert one(text.keyword_overlap(F.lit("red blue fish"), F.lit("a red fish"))) == 0.67


def test_collapse_and_slug(one):
    assert one(text.collapse_repeats(F.lit("no no no no yes"))) == "no no no yes"
    assert one(text.slug(F.lit("  A b/C  "))) == "a-b-c"
    assert one(text.slug(F.lit("!!"))) == "unknown"
    assert tuple(one(text.evidence_range(F.lit("s1:3-7")))) == ("s1", 3, 7)


def test_redaction_order(spark):
    rows = [("mail a.b@c.org now",), ("电话 13812345678",), ("11010519491231002X",), ("卡 6222 0212 3456 7890 123",), ("订单号：SF882910",), ("nothing",)]
    got = [tuple(r) for r in pii.redact(spark.createDataFrame(rows, "content string")).select("content", "pii_hits", F.array_join("pii_categories", ",")).collect()]
    assert [g[2] for g in got] == ["email", "phone", "id_card", "bank_card", "order_id", ""]
    assert got[0][0] == "mail [REDACTED_EMAIL] now" and got[5][1] == 0
    report = pii.redaction_report(pii.redact(spark.createDataFrame(rows, "content string"))).head()
    assert (report.rows, report.rows_changed, report.hits) == (6, 5, 5) and "email" in report.categories


def test_json_in_answers(spark):
    rows = ['{"a": 1}', 'well: {"a": "}", "b": {"c": 2}} done', "{bad} then {\"ok\": true}", "none", None]
    got = [r.x for r in spark.createDataFrame([(x,) for x in rows], "t string").select(text.extract_json(F.col("t")).alias("x")).collect()]
    assert got == ['{"a": 1}', '{"a": "}", "b": {"c": 2}}', '{"ok": true}', None, None]


def test_redaction_against_python(spark):
    import random
    import re

    from confera.functions import pii

    rng = random.Random(3)
    parts = ["a.b@x.org", "@", "13812345678", "+86 13912345678", "1234567890123456", "6222 0212 3456 7890 123", "11010519491231002X", "Order id: AB-12345", "订单号：XY12345", "order", "单号 1", "x", " ", "-", "1", "23", "，"]
    texts = [None, ""] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(9))) for _ in range(400)]
    got = pii.redact(spark.createDataFrame(list(enumerate(texts)), "id int, content string")).orderBy("id").collect()
    for r, text in zip(got, texts):
        hits, found = 0, []
        for name, pattern, token in pii.PATTERNS:
            text, n = (None, 0) if text is None else re.subn(pattern, token, text, flags=re.ASCII)
            hits += n
            found += [name] * (n > 0)
        assert (r.content, r.pii_hits, r.pii_categories) == (text, hits, sorted(found))


def test_collapsing_takes_one_pass(spark):
    rng = random.Random(8)
    by_hand = lambda words: [w for i, w in enumerate(words) if i < 3 or words[i - 3 : i] != [w] * 3]
    texts = [rng.choice(["", " ", "\n"]) + rng.choice([" ", "  ", "\t", "\u00a0"]).join(rng.choice(["no", "nono", "a.b", "$1", "\\"]) for _ in range(rng.choice([1, 3, 9, 60]))) + rng.choice(["", " "]) for _ in range(200)]
    texts += [" ".join(f"w{k}" for k in range(300_000)), "no " * 100_000]
    began = time.time()
    got = {r.k: r.c for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.collapse_repeats(F.col("t")).alias("c")).collect()}
    assert time.time() - began < 60  # what copied the words so far for each word took minutes
    assert got == {k: " ".join(by_hand(re.split(r"\s+", t))) for k, t in enumerate(texts)}
