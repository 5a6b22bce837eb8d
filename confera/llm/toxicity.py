"""Toxicity by a weighted lexicon, matched by Aho-Corasick over text in which look-alikes are folded.

Text is folded first: compatibility forms, lower case, look-alike letters of other scripts to Latin ones, and digits and
marks inside a word to the letters they stand for. The lexicon is learned from a sample of labelled rows, of `max_rows` of
each label at most: for every folded word and every beginning of a word, how many families of toxic and of clean texts have
it. A family is what shares its least 3-word shingle, and one text stands for it, so copies of a text count as about one. Entries that are frequent enough and far likelier in toxic texts
get their log likelihood ratio as weight; of nested beginnings the most general that is as telling stays. Two-word
phrases around an entry that clean texts use are learned as exceptions and cover the entry within them.

A text's score is the sum of its entries' weights, each counted with diminishing effect when repeated, less a prior and a
part that grows with the log of its length, through the logistic function. The sample's ids are few enough to broadcast,
so no text is shuffled to meet its label; the driver gets the lexicon, of `max_entries` at most by weight and support, and
of exception phrases `MAX_EXCEPTIONS` at most, the commonest in clean texts. Both bound the fitted model, as the sample
does; every text is scored with all of it.

Defined results: a null or empty text scores as one without entries. A row without a usable label is scored but not learned
from; of an id's repeated labels the largest counts. With no toxic label, or an empty table, every text scores 0. Texts that
are equal score alike. A very long text is folded and matched whole, within its row. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confera.llm.common import checkpointed, text_batches

#: Letters of other scripts by the Latin letter they look like.
HOMOGLYPHS = {
    "a": "аɑα", "b": "Ьᖯ", "c": "сϲ", "d": "ԁɗ", "e": "еҽєε", "g": "ɡց", "h": "һհ", "i": "іιı", "j": "јϳ", "k": "кκ", "l": "ӏǀⅼ", "m": "м",
    "n": "ոп", "o": "оοօσ", "p": "рρ", "q": "ԛ", "r": "гᴦ", "s": "ѕꜱ", "t": "тτ", "u": "υսц", "v": "ѵν", "w": "ѡԝω", "x": "хχ", "y": "уүγ", "z": "ᴢ",
}
#: Digits and marks by the letter they stand for inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}

_LETTER = {ord(x): latin for latin, others in HOMOGLYPHS.items() for x in others}
_MARKED = re.compile(r"[^\W\d_]+(?:[\d@$!|€]+[^\W\d_]+)+|(?<![^\W_])[\d@$!|€]+[^\W\d_]{2,}[^\W_]*|[^\W\d_]{2,}[013457]+(?![^\W_])")
_DIGIT = {ord(k): v for k, v in SUBSTITUTES.items()}
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÿ]*")
_APART = re.compile(r"[\W_]+")
_MARK = re.compile(r"[\d@$!|€]")
#: What stands between words, among the first 256 characters, by the blank that takes its place.
_BLANK = {c: " " for c in range(256) if not chr(c).isalnum()}

MIN_SUPPORT, MIN_SHARE, MIN_WEIGHT = 5, 0.004, 3.5
PREFIXES = range(3, 9)
MAX_ENTRIES = 20_000
MAX_EXCEPTIONS = 5_000
#: Labelled rows of each label that the lexicon is learned from, at most.
MAX_ROWS = 30_000


def fold(text: str | None) -> str:
    """Folded words between single spaces, with one before the first and after the last."""
    if not text:
        return " "
    if not _PLAIN.fullmatch(text):
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if unicodedata.category(c) != "Cf") if any(unicodedata.category(c) == "Cf" for c in set(text)) else text
    text = text.lower()
    if not (plain := bool(_PLAIN.fullmatch(text))):
        text = text.translate(_LETTER)
    if _MARK.search(text):
        text = " ".join([_MARKED.sub(lambda m: m[0].translate(_DIGIT), w) if _MARK.search(w) else w for w in text.split()])
    words = (text.translate(_BLANK) if plain else _APART.sub(" ", text)).split()
    return f" {' '.join(words)} " if words else " "


def family(words: list[str]) -> int:
    """The least hash of a 3-word shingle: shared by most copies of a text and hardly by others."""
    n = len(words)
    shingles = [" ".join(words)] if n < 3 else map(" ".join, zip(words, words[1:], words[2:]))
    least = min(xxhash.xxh64_intdigest(s, 7) for s in shingles)
    return least - (1 << 64) if least >> 63 else least


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    prior: float = -6.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        patterns: dict[str, list[tuple[str, float]]] = {}
        for w, weight in self.words.items():
            patterns.setdefault(f" {w} ", []).append(("entry", weight))
        for w, weight in self.beginnings.items():
            patterns.setdefault(f" {w}", []).append(("entry", weight))
        for phrase in self.exceptions:
            patterns.setdefault(f" {phrase} ", []).append(("exception", 0.0))
        for pattern, what in patterns.items():
            found.add_word(pattern, (pattern, what))
        if patterns:
            found.make_automaton()
        return found if patterns else None


class Scorer:
    """Scores texts; made once in each task."""

    def __init__(self, lexicon: Lexicon):
        self.prior, self.automaton = lexicon.prior, lexicon.automaton()

    def score(self, text: str | None) -> float:
        folded = fold(text)
        if self.automaton is None:
            return 0.0
        at: dict[int, tuple[str, float]] = {}  # per place of a word the heaviest entry that begins there
        covered: list[tuple[int, int]] = []
        for end, (pattern, what) in self.automaton.iter(folded):
            start = end - len(pattern) + 1
            for kind, weight in what:
                if kind == "exception":
                    covered.append((start, end))
                elif start not in at or weight > at[start][1]:
                    at[start] = (pattern, weight)
        times: dict[str, list[float]] = {}
        for start, (pattern, weight) in at.items():
            if not any(a <= start and start + len(pattern) - 1 <= b for a, b in covered):
                times.setdefault(pattern, []).append(weight)
        total = sum(w[0] * (1 + math.log(len(w))) for w in times.values())
        x = self.prior + total - math.log1p((folded.count(" ") - 1) / 400)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_sample(labels: DataFrame, id_col: str = "doc_id", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, toxic: labelled rows that are not held out, all or the `max_rows` of each label with the least hashes."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    one = lambda label: usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return checkpointed(one(1).unionByName(one(0)))


def _texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text and the columns of ids, which has 2 * max_rows rows at most, hence the broadcast."""
    own = text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    return own.join(F.broadcast(ids), "doc_id")


def _representatives(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, toxic of one text of each family, a toxic one if there is one."""

    def families(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, toxic, text in zip(batch["doc_id"], batch["toxic"], batch["text"]):
                if words := fold(text).split():
                    out.append((doc_id, int(toxic), family(words)))
            yield pd.DataFrame(out, columns=["doc_id", "toxic", "family"])

    kind = dict(sample.dtypes)["doc_id"]
    found = _texts(docs, sample, id_col, text_col).select("doc_id", "toxic", "text").mapInPandas(families, f"doc_id {kind}, toxic int, family bigint")
    return checkpointed(found.groupBy("family").agg(F.max(F.struct("toxic", "doc_id")).alias("x")).select("x.doc_id", "x.toxic").distinct())


def _entries(rows: DataFrame) -> DataFrame:
    """whole, entry, pos, neg: the distinct folded words of each row and the distinct beginnings of them, counted by label."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[tuple[bool, str], list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = set(fold(text).split())
                for entry in words:
                    counts.setdefault((True, entry), [0, 0])[int(toxic)] += 1
                for entry in {w[:n] for w in words for n in PREFIXES if len(w) > n}:
                    counts.setdefault((False, entry), [0, 0])[int(toxic)] += 1
            yield pd.DataFrame([(*k, pos, neg) for k, (neg, pos) in counts.items()], columns=["whole", "entry", "pos", "neg"])

    found = rows.select("text", "toxic").mapInPandas(count, "whole boolean, entry string, pos bigint, neg bigint")
    return found.groupBy("whole", "entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_rows: int = MAX_ROWS, min_support: int = MIN_SUPPORT, min_share: float = MIN_SHARE, min_weight: float = MIN_WEIGHT, max_entries: int = MAX_ENTRIES) -> Lexicon:
    chosen_ids = _representatives(docs, training_sample(labels, id_col, max_rows), id_col, text_col)
    families = {r["toxic"]: r["count"] for r in chosen_ids.groupBy("toxic").count().collect()}
    toxic, clean = families.get(1, 0), families.get(0, 0)
    if not toxic or not clean:
        return Lexicon(prior=-40.0)
    support = max(min_support, math.ceil(min_share * toxic))
    rows = _texts(docs, chosen_ids, id_col, text_col)
    entries = checkpointed(_entries(rows).filter("pos > 0"))
    ratio = F.log((F.col("pos") + 0.5) / (toxic + 1.0)) - F.log((F.col("neg") + 0.5) / (clean + 1.0))
    chosen = entries.withColumn("weight", ratio).filter((F.col("pos") >= support) & (F.col("weight") >= min_weight))
    # A beginning must pass for several words, none of them most of it; else the word itself is the entry.
    heads = F.array(*[F.when(F.length("entry") > n, F.substring("entry", 1, n)) for n in PREFIXES])
    forms = entries.filter("whole").select("pos", F.explode(F.array_compact(heads)).alias("entry")).groupBy("entry").agg(F.count(F.lit(1)).alias("forms"), F.max("pos").alias("top"))
    wide = chosen.filter(~F.col("whole")).join(forms, "entry").filter((F.col("forms") >= 3) & (F.col("top") < 0.8 * F.col("pos")))
    chosen = chosen.filter("whole").unionByName(wide.select(*chosen.columns))
    picked = chosen.orderBy(F.desc("weight"), F.desc("pos"), "entry", "whole").limit(max_entries).collect()
    if not picked:
        return Lexicon(prior=-40.0)
    met = checkpointed(_occurrences(rows, Lexicon({r["entry"]: r["weight"] for r in picked if r["whole"]}, {r["entry"]: r["weight"] for r in picked if not r["whole"]})))
    # What only copies of a text have always stands between the same words; a telling entry stands anywhere.
    spread = {(r["whole"], r["entry"]): r["n"] for r in met.filter("toxic = 1").groupBy("whole", "entry").agg(F.count_distinct("before", "after").alias("n")).collect()}
    picked = [r for r in picked if spread.get((r["whole"], r["entry"]), 0) >= max(min_support, 0.5 * r["pos"])]
    heads_found = {r["entry"]: r["weight"] for r in picked if not r["whole"]}
    beginnings = {}
    for head, weight in heads_found.items():
        shorter = [heads_found[head[:k]] for k in range(3, len(head)) if head[:k] in heads_found]
        if not shorter or weight > max(shorter) + 1:
            beginnings[head] = weight
    words = {r["entry"]: r["weight"] for r in picked if r["whole"]}
    words = {w: x for w, x in words.items() if not any(beginnings.get(w[:k], -9.0) >= x - 1 for k in range(3, len(w) + 1))}
    usual = _exceptions(met, words, beginnings, toxic, clean) if words or beginnings else []
    return Lexicon(words, beginnings, usual, -math.log(clean / toxic) - 2.5)


def _occurrences(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """whole, entry, before, word, after, toxic: where entries stand, each once a text."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for batch in batches:
            out = []
            for text, label in zip(batch["text"], batch["toxic"]):
                folded = fold(text)
                met = set()
                for end, (pattern, _) in automaton.iter(folded):
                    start = end - len(pattern) + 1
                    stop = folded.index(" ", start + 1)
                    before = folded[folded.rfind(" ", 0, start) + 1 : start] if start else ""
                    after = folded[stop + 1 : folded.find(" ", stop + 1)] if stop + 1 < len(folded) else ""
                    met.add((pattern.endswith(" "), pattern.strip(), before, folded[start + 1 : stop], after))
                out += [(*x, int(label)) for x in met]
            yield pd.DataFrame(out, columns=["whole", "entry", "before", "word", "after", "toxic"])

    return rows.select("text", "toxic").mapInPandas(find, "whole boolean, entry string, before string, word string, after string, toxic int")


def _exceptions(met: DataFrame, words: dict[str, float], beginnings: dict[str, float], toxic: int, clean: int, most: int = MAX_EXCEPTIONS) -> list[str]:
    """Phrases of an entry and a word beside it that clean texts have, and hardly any toxic one."""
    own = met.filter((F.col("whole") & F.col("entry").isin(list(words))) | (~F.col("whole") & F.col("entry").isin(list(beginnings))))
    pairs = own.select("toxic", F.explode(F.array(F.when(F.col("before") != "", F.concat_ws(" ", "before", "word")), F.when(F.col("after") != "", F.concat_ws(" ", "word", "after")))).alias("phrase"))
    counted = pairs.filter("phrase is not null").groupBy("phrase").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    usual = counted.filter((F.col("neg") >= 3) & ((F.col("neg") + 0.5) / (clean + 1) > 2 * (F.col("pos") + 0.5) / (toxic + 1)))
    return [r["phrase"] for r in usual.orderBy(F.desc("neg"), "phrase").limit(most).collect()]


def scores(lexicon: Lexicon):
    """A column function: text to score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(lexicon)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, lexicon: Lexicon | None = None) -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted."""
    lexicon = lexicon or learn_lexicon(docs, labels, id_col, text_col)
    out = text_batches(docs).select(F.col(id_col).alias("doc_id"), scores(lexicon)(F.col(text_col)).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns; each row is judged on its own, so nothing is shuffled."""
    lexicon = learn_lexicon(docs, labels, id_col, text_col)
    return text_batches(docs).filter(scores(lexicon)(F.col(f"`{text_col}`")) < threshold)
