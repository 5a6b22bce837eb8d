"""Column functions that give the same numbers and texts as the engine's rules are defined on: rounding, lengths, regexes."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def js_round(x: Column, places: int = 0) -> Column:
    """Half up, towards positive infinity, on doubles; the same form in SQL is floor(x * 10^n + 0.5) / 10^n."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float, high: float, places: int | None = None) -> Column:
    x = x if places is None else js_round(x, places)
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def factor(x: Column) -> Column:
    return clamp(x, -8, 8, 1)


def penalty(x: Column) -> Column:
    return clamp(x, 0, 8, 1)


def score100(x: Column) -> Column:
    return clamp(x, 0, 100, 1)


def confidence(x: Column) -> Column:
    return clamp(x, 0, 1, 2)


def unit4(x: Column) -> Column:
    return clamp(x, 0, 1, 4)


def grade(x: Column) -> Column:
    """An integer from 1 to 5."""
    return clamp(x, 1, 5, 0).cast("int")


def quality(x: Column) -> Column:
    return clamp(x, 0, 5, 1)


def ratio(part: Column, whole: Column, otherwise: float | None = 0.0) -> Column:
    """part / whole, or the stated value where there is nothing to divide by."""
    out = F.try_divide(part.cast("double"), whole.cast("double"))
    return out if otherwise is None else F.coalesce(out, F.lit(float(otherwise)))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units: code points, and one more for each beyond the basic plane."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(utf16_length(text) / 1.6)).cast("int")


def parse_time_ms(text: Column) -> Column:
    """Milliseconds of an ISO time, null if it can't be read."""
    return F.unix_millis(F.try_to_timestamp(text))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def truncated(text: Column, limit: int, keep: int | None = None) -> Column:
    """At most limit characters, else the first `keep` and an ellipsis (keep: limit, or limit - 1 in the strict form)."""
    keep = limit if keep is None else keep
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit("…"))).otherwise(text)


def question_fingerprint(text: Column, size: int = 18) -> Column:
    return F.substring(F.regexp_replace(text, r"(?U)[？?，,。.!！\s]", ""), 1, size)


def first_of(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first rule that holds."""
    out = None
    for test, value in rules:
        out = F.when(test, value) if out is None else out.when(test, value)
    return otherwise if out is None else out.otherwise(otherwise)


def band(x: Column, high: float, medium: float) -> Column:
    return F.when(x >= high, "high").when(x >= medium, "medium").otherwise("low")


def depth_bucket(turns: Column) -> Column:
    return F.when(turns <= 3, "1-3").when(turns <= 8, "4-8").otherwise("9+")


def _nfkc(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKC", text)


def nfkc(text: Column) -> Column:
    """Compatibility composition. ASCII texts have no other form: they go to Python as nulls and stay as they are."""

    @F.pandas_udf(StringType())
    def run(texts):  # noqa: ANN001, ANN202
        return texts.map(_nfkc)

    return F.coalesce(run(F.when(~text.rlike(r"^[\x00-\x7F]*$"), text)), text)


# Punctuation that the transcript normaliser drops; the tokenizer also takes the slash.
PUNCTUATION = "，。！？、；：“”‘’（）【】《》.,!?;:'\"()[]<>_-"


def _any_of(chars: str) -> str:
    """The characters as a class, in Java syntax."""
    return "[" + "".join("\\" + c if c in "[]-^\\&" else c for c in chars) + "]"


def normalise_transcript(text: Column) -> Column:
    text = F.lower(F.trim(F.regexp_replace(nfkc(text), r"(?U)\s+", " ")))
    return F.regexp_replace(text, _any_of(PUNCTUATION), "")


def transcript_hash(text: Column) -> Column:
    return F.sha2(normalise_transcript(text), 256)


def lexical_tokens(text: Column) -> Column:
    """Tokens of at most two characters whole, longer ones as their two-character grams."""
    plain = F.regexp_replace(F.lower(nfkc(text)), _any_of(PUNCTUATION + "/"), " ")
    words = F.filter(F.split(plain, r"(?U)[\s\x{FEFF}]+"), lambda x: x != "")
    return F.flatten(F.transform(words, lambda w: F.when(F.length(w) <= 2, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(2))))))


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over UTF-16 code units."""
    units = F.transform(F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-16BE")), "(....)", "$1,"), ","), lambda x: F.conv(x, 16, 10).cast("bigint"))
    return F.aggregate(F.filter(units, lambda x: x.isNotNull()), F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(4294967295).cast("bigint")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)).cast("double") * F.coalesce(y, F.lit(0.0)).cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero; the shorter one counts as filled up with zeros."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def metric_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))) * (F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))))
    return js_round(F.coalesce(F.try_divide(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)), F.sqrt(F.greatest(F.size(a), F.size(b)).cast("double"))), F.lit(0.0)), 4)


def tag_distance(a: Column, b: Column) -> Column:
    apart = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return js_round(ratio(apart, F.size(F.array_union(a, b))), 4)


def keyword_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^一-龥a-z0-9 ]", " "), " +"), lambda x: F.length(x) >= 2))


def keyword_overlap(a: Column, b: Column) -> Column:
    own = keyword_set(a)
    return js_round(ratio(F.size(F.array_intersect(own, keyword_set(b))), F.size(own)), 2)


def collapse_repeats(text: Column, most: int = 3) -> Column:
    """At most `most` equal words in a row. A word before `most` more of its kind goes, so a text of any length is one pass."""
    spaced = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.regexp_replace(spaced, r"(?<![^ ])([^ ]++) (?=\1" + r" \1" * (most - 1) + r"(?![^ ]))", "")


def slug(text: Column) -> Column:
    out = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9一-龥]+", "-"), "^-+|-+$", ""), 1, 120)
    return F.when(F.coalesce(out, F.lit("")) == "", "unknown").otherwise(out)


def context_id(text: Column) -> Column:
    """A workspace or user as part of a path: runs of anything else than letters, digits, _ and - become one -."""
    return _or_default(F.lower(F.regexp_replace(F.regexp_replace(text, "(?i)[^a-z0-9_-]+", "-"), "^-+|-+$", "")), "default")


def customer_id(text: Column) -> Column:
    """A customer as a folder: plain names as they are, at most 64 characters; others by a short hash."""
    name = F.substring(trimmed(text), 1, 128)
    return F.when(name.rlike("^[a-zA-Z0-9_-]+$"), F.substring(name, 1, 64)).otherwise(F.concat(F.lit("h_"), F.substring(F.sha2(name, 256), 1, 24)))


def run_file_id(text: Column) -> Column:
    return _or_default(F.regexp_replace(F.regexp_replace(text, r'(?U)[\\/:*?"<>|\s]+', "-"), "^-+|-+$", ""), "run")


def _or_default(text: Column, otherwise: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", otherwise).otherwise(text)


def stable_id(*parts: Column) -> Column:
    return F.concat_ws("_", *[slug(F.coalesce(p.cast("string"), F.lit(""))) for p in parts])


def evidence_range(text: Column) -> Column:
    """session, start and end of 'session:a-b'."""
    num = lambda k: F.try_to_number(F.regexp_extract(text, r":(\d+)-(\d+)", k), F.lit("9999999999")).cast("int")
    return F.struct(F.nullif(F.regexp_extract(text, r"^([^:]+):", 1), F.lit("")).alias("session_id"), num(1).alias("start_turn"), num(2).alias("end_turn"))


def _first_object(text: str | None) -> str | None:
    """The text if it is JSON, else its first balanced object that is; strings and escapes don't count as braces."""
    if not text:
        return None
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    start = text.find("{")
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for at in range(start, len(text)):
            c = text[at]
            if quoted:
                quoted, escaped = (escaped or c != '"'), (c == "\\" and not escaped)
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    try:
                        json.loads(text[start : at + 1])
                        return text[start : at + 1]
                    except ValueError:
                        break
        start = text.find("{", start + 1)
    return None


def extract_json(text: Column) -> Column:
    """JSON in the answer of a judge, as text; null if there is none."""

    @F.pandas_udf(StringType())
    def run(texts):  # noqa: ANN001, ANN202
        return texts.map(_first_object)

    return run(text)
