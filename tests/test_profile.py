"""Profiles of JSON values against a plain walk."""

import json
import random
from collections import Counter

from confera.sources import mapping


def test_value_profile(spark):
    rng = random.Random(2)

    def value(depth):
        kind = rng.choice(["leaf", "list", "object"]) if depth < 6 else "leaf"
        if kind == "list":
            return [value(depth + 1) for _ in range(rng.randint(0, 5))]
        if kind == "object":
            return {f"k{k}": value(depth + 1) for k in range(rng.randint(0, 3))}
        return rng.choice([None, True, 1, 2.5, "x", ""])

    records = [{"a": value(0), "b": value(1)} for _ in range(80)] + [[], 3, {f"key{k}": k for k in range(30)}]

    def walk(v, path, depth, out):
        name = {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(v)]
        out.add((path, name))
        if depth < 4 and isinstance(v, list):
            for x in v[:3]:
                walk(x, path + "[*]", depth + 1, out)
        if depth < 4 and isinstance(v, dict):
            for k, x in list(v.items())[:20]:
                walk(x, f"{path}.{k}", depth + 1, out)
        return out

    want = Counter(x for r in records for x in walk(r, "$", 0, set()))
    texts = [json.dumps(r) for r in records] + ["{broken", "", None]
    df = spark.createDataFrame([(t, 1, "x") for t in texts], "value string, records int, path string").repartition(3)
    got = {(r.path, r.type): (r.records, r.coverage) for r in mapping.value_profile(df, most=10_000).collect()}
    assert {k: n for k, (n, _) in got.items()} == dict(want) | {("", "unparsed"): 3}
    assert all(abs(c - want[k] / len(records)) < 1e-4 for k, (_, c) in got.items() if k[0])
    few = {r.path for r in mapping.value_profile(df).collect()}
    assert len(few) == 31 and "" in few and "$.a" in few
    assert mapping.value_profile(df.limit(0)).count() == 0
    assert mapping.source_format(mapping.value_profile(spark.createDataFrame([('{"d": [{"dialogue_id": "1", "turns": []}]}',)], "value string"))) == "sgd"
    assert mapping.source_format(mapping.value_profile(spark.createDataFrame([('{"id": 1, "text": "", "characteristic_form": ""}',)], "value string"))) == "assetops"
    assert mapping.source_format(mapping.value_profile(df)) == "custom"


def test_a_value_of_any_depth(spark):
    deep = "[" * 500 + "]" * 500
    rows = {(r.path, r.type) for r in mapping.value_profile(spark.createDataFrame([(deep,)], "value string")).collect()}
    assert rows == {("$" + "[*]" * k, "array") for k in range(5)}
