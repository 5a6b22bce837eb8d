"""URL filters over rules of host and path prefix and a list of hosts, decided by Bloom filter cascades.

Every URL gives its candidate keys: each suffix of its host at a dot, alone (for listed hosts) and with each prefix of its
path as long as some rule's path. The distinct candidates of the whole table are the universe over which the cascades are
exact, so the decision of a row needs no join: its candidates are tested within the row and the longest rule wins.

Defined results: a null URL, or one without ://, has an empty host and path, fits nothing and is allowed. Rules compare
hosts in lower case (A-Z) and paths as they are. A rule given twice counts once; one that both allows and blocks blocks.
An empty list blocks nothing. Of a very long URL the host's suffixes make as many candidates as the host has dots; its path
makes one for each length that a rule's path has. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confera.llm.bloom import Cascade
from confera.llm.common import checkpointed, let

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ://, up to / ? # or the end; then up to ? # or the end."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring(@, instr(@, '://') + 3)".replace("@", "url"))), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column) -> Column:
    """The host and what follows each of its dots, longest first; none for an empty host."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(let(F.split(host, r"\."), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "."))))


def _candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys host + prefix of the path, longest host first and longest prefix first within it."""
    heads = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)]), lambda x: x.isNotNull())
    return F.flatten(F.transform(_suffixes(host), lambda s: F.transform(heads, lambda h: F.concat(s, h))))


# Words whose pairs name unwanted hosts (first-second under a zone), for `unwanted_hosts`.
FIRST = "ads adult auto best bet big bonus buy cash casino cheap click cool cracked crypto daily deal diet easy fake fast free gold hot instant keto lotto lucky mega miracle money new online payday pirate poker porn pro quick replica rich save secret sexy slot spam super top vip warez win xxx".split()
SECOND = "ads bets blog bonus bots cams cash casino chat club coin coins cracks dates deals diet downloads farm games gifts girls keys loans lotto meds money offers pills play poker porn prizes promo seo shop slots spam stream tips torrents track traffic vids warez watches win wins x zone".split()
ZONES = ["example.com", "example.net", "example.org"]


def unwanted_hosts(first: list[str] = FIRST, second: list[str] = SECOND, zones: list[str] = ZONES) -> list[str]:
    """A list of hosts by a rule, for tables whose hosts are invented: every pair of the words under every zone."""
    return [f"{a}-{b}.{z}" for z in zones for a in first for b in second]


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], blocked_hosts: list[str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """rules: (verdict, host/path). One row per row: page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    made = {k: {f"{h.translate(str.maketrans(_UPPER, _LOWER))}/{p}" for v, rule in rules if v == k for h, _, p in [rule.partition("/")]} for k in ("block", "allow")}
    made["allow"] -= made["block"]
    lengths = sorted({len(x) - x.index("/") for keys in made.values() for x in keys})
    hosts = {h.translate(str.maketrans(_UPPER, _LOWER)) for h in blocked_hosts}

    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = split_url(F.col("url"))
    parts = parts.select("page_id", host.alias("host"), path.alias("path"))
    with_path, bare = _candidates(F.col("host"), F.col("path"), lengths), _suffixes(F.col("host"))
    universe = checkpointed(parts.select(F.explode(F.concat(with_path, bare)).alias("key")).distinct())
    listed = lambda keys: spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(sorted(keys))), "array<string>")).alias("key"))
    block, allow, spam = (Cascade.build(universe, listed(keys)) for keys in (made["block"], made["allow"], hosts))

    longest = F.aggregate(
        with_path,
        F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("verdict")),
        lambda a, k: F.when((a["key"].isNull()) | (F.length(k) > F.length(a["key"])), F.when(block.contains(k), F.struct(k.alias("key"), F.lit("block").alias("verdict"))).when(allow.contains(k), F.struct(k.alias("key"), F.lit("allow").alias("verdict"))).otherwise(a)).otherwise(a),
    )
    judged = parts.select("page_id", "host", "path", longest.alias("best"), F.exists(bare, lambda h: spam.contains(h)).alias("spam"))
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("spam"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))
