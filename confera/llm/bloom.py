"""Bloom filter cascade: exact membership in a list, for every key of a known universe, without a join.

Level 0 encodes the listed keys of the universe; level 1 the keys of the rest of the universe that level 0 lets through; level 2 the listed
keys that level 1 lets through; and so on until none is left. A key of the universe is listed if the first
level that turns it away is odd, or if none does and the number of levels is odd. A level is one array of 64-bit words in the
query's expression, named once for all its hashes; it grows with the list (about 1.44 log2(universe / list) bits a listed
key), not with the rows, and its size is checked against a limit.

Defined results: a null key is in no list (the answer is null). A repeated listed key counts once. An empty list has no level
and contains nothing; no more does one over an empty universe.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confera.llm.common import checkpointed, let

#: Largest level in 64-bit words (8 MB); a longer list is refused with an error, never cut.
MAX_WORDS = 1 << 20
_HALF = math.sqrt(0.5)


class Level:
    def __init__(self, depth: int, bits: int, hashes: int, words: dict[int, int] | None = None):
        self.depth, self.bits, self.hashes = depth, bits, hashes
        self.words = words or {}

    def places(self, key: Column) -> list[Column]:
        """Bit numbers by double hashing, with a seed of their own at each level; no sum can overflow."""
        m = F.lit(self.bits).cast("long")
        a, b = (F.pmod(F.xxhash64(F.lit(2 * self.depth + k), key), m) for k in (0, 1))
        return [F.pmod(a + i * b, m) for i in range(self.hashes)]

    def fill(self, keys: DataFrame) -> Level:
        """keys: a column key. Aggregates to at most bits / 64 rows before anything reaches the driver."""
        at = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("at")).select(F.shiftright("at", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int")).alias("b"))
        self.words = {r["w"]: r["b"] for r in at.groupBy("w").agg(F.bit_or("b").alias("b")).collect()}
        return self

    def passes(self, key: Column) -> Column:
        """Whether the level lets the key through. The words are one array constant, folded once."""
        text = ",".join(str(self.words.get(i, 0)) for i in range((self.bits + 63) // 64))
        words = F.split(F.lit(text), ",").cast("array<bigint>")

        def all_set(words: Column) -> Column:
            out = F.lit(True)
            for at in self.places(key):
                one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
                out = out & (F.get(words, F.shiftright(at, 6).cast("int")).bitwiseAND(one) != 0)
            return out

        return let(words, all_set)


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, universe: DataFrame, listed: DataFrame, *, max_words: int = MAX_WORDS, max_levels: int = 64) -> Cascade:
        """universe, listed: keys in a column key, those of the universe distinct; only listed keys of the universe matter."""
        keys = listed.select("key").filter("key is not null").distinct()
        inside = checkpointed(universe.select("key").join(keys, "key", "left_semi"))
        outside = universe.select("key").join(keys, "key", "left_anti")
        n = inside.count()
        others = universe.count() - n if n else 0
        levels: list[Level] = []
        wanted, rest = inside, outside
        while n and len(levels) < max_levels:
            rate = min(0.5, n * _HALF / max(1, others)) if not levels else 0.5
            bits = max(64, math.ceil(1.44 * n * math.log2(1 / rate)))
            if (bits + 63) // 64 > max_words:
                raise ValueError(f"{n} keys need {bits} bits; raise max_words ({max_words}) to hold them")
            level = Level(len(levels), bits, max(1, round(math.log2(1 / rate)))).fill(wanted)
            levels.append(level)
            # Written, as each level has but a part of the keys of the one before; else every level would filter them all anew.
            wanted, rest = checkpointed(rest.filter(level.passes(F.col("key")))), wanted
            n, others = wanted.count(), n
        if n:
            raise ValueError(f"{n} keys are still undecided after {max_levels} levels")
        return cls(levels)

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(~level.passes(key), F.lit(level.depth % 2 == 1)).otherwise(out)
        return out
