"""Readers of large files: each file cut into many splits gives the rows it gives in one piece."""

import json
import random

import pytest

from confera.sources import readers, splits


@pytest.fixture
def tiny_splits(spark):
    """Splits of 700 bytes, so that small files have many."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def words(rng, alphabet, n=25):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))


def test_lines_are_numbered_in_their_file(spark, tmp_path, tiny_splits):
    rng = random.Random(1)
    texts = {f"f{k}.txt": [words(rng, "ab é日") for _ in range(rng.choice([0, 1, 5, 400]))] for k in range(6)}
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    got = {}
    for r in splits.numbered_lines(spark, str(tmp_path)).collect():
        got.setdefault(r.file.rpartition("/")[2], {})[r.n] = (r.line, r.block)
    assert {k: [v[n][0] for n in range(len(v))] for k, v in got.items()} == {k: v for k, v in texts.items() if v}
    assert max(len({b for _, b in v.values()}) for v in got.values()) > 5


def test_json_lists_are_cut_at_their_elements(spark, tmp_path, tiny_splits):
    rng = random.Random(2)
    word = lambda: words(rng, 'ab{}[]"\\,:\n é日')
    items = [{"sessionId": f"s{k % 7}", "timestamp": word(), "role": rng.choice(["USER", "assistant", "robot"]), "content": word(), "x": [{"y": word()}, [1, {"z": {}}]]} for k in range(120)]
    (tmp_path / "a.json").write_text(json.dumps(items, ensure_ascii=False, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"meta": [{"q": "}"}], "messages": items[:30]}))
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text(json.dumps(items[:1]) + "\n\n")
    (tmp_path / "e.json").write_text("\n".join(json.dumps(x) for x in items[:20]))
    (tmp_path / "f.json").write_text("[1, null, " + json.dumps(items[3]) + ", \"x\"]")
    (tmp_path / "g.json").write_text("")
    elements, others = splits.json_documents(spark, str(tmp_path))
    assert elements.filter("file like '%a.json'").select("nth").distinct().count() == 120
    assert sorted(r.file[-6] for r in others.collect()) == ["b", "e"]
    got = sorted((r.session_id, r.role, r.content) for r in readers.read_json(spark, str(tmp_path)).collect())
    want = [(x["sessionId"], x["role"].lower(), x["content"]) for x in items + items[:30] + items[:1] + items[:20] + [items[3]] if x["role"] != "robot"]
    assert got == sorted(want)
    order = [r.content for r in readers.read_json(spark, str(tmp_path / "a.json")).orderBy("ingest_seq").collect()]
    assert order == [x["content"] for x in items if x["role"] != "robot"]


def test_headings_hold_across_splits(spark, tmp_path, tiny_splits):
    lines, want, session = [], [], "t_session"
    rng = random.Random(3)
    for k in range(300):
        if rng.random() < 0.05:
            session = f"s{k}"
            lines.append(f"## session: {session}" if k % 2 else f"[session: {session}]")
        else:
            lines.append(f"user: line {k} of many words")
            want.append((session, f"line {k} of many words"))
        if rng.random() < 0.1:
            lines.append("")
    (tmp_path / "t.txt").write_text("\r\n".join(lines))
    (tmp_path / "plain.txt").write_text("\n".join(f"plain {k}" for k in range(200)))
    rows = readers.read_text(spark, str(tmp_path)).orderBy("ingest_seq").collect()
    assert [(r.session_id, r.content) for r in rows if not r.content.startswith("plain")] == want
    assert [r.role for r in rows if r.content.startswith("plain")] == ["user", "assistant"] * 100


def test_csv_by_header_name_of_each_file(spark, tmp_path, tiny_splits):
    (tmp_path / "a.csv").write_text("sessionId,timestamp,role,content\n" + "".join(f's{k},t{k},User,"hi, ""{k}"""\n' for k in range(60)) + ",t,user,empty session\n")
    (tmp_path / "b.csv").write_text("\ufeff\n content , role,timestamp,note,sessionId\r\n\r\nhello,ASSISTANT,t1,x,b1\r\nshort,user,t2,x\r\nquoted \"\",system,t3,\"a,b,c\",\"\"\r\nno role,robot,t4,x,b4\r\n")
    (tmp_path / "c.csv").write_text("sessionId,role,content\nlost,user,no time\n")
    (tmp_path / "d.csv").write_text("")
    rows = {(r.session_id, r.ts_raw, r.role, r.content) for r in readers.read_csv(spark, str(tmp_path / "*.csv")).collect()}
    want = {(f"s{k}", f"t{k}", "user", f'hi, "{k}"') for k in range(60)} | {("", "t", "user", "empty session"), ("b1", "t1", "assistant", "hello"), ("unknown", "t2", "user", "short")}
    assert {r for r in rows if r[2] != "system"} == want
    assert [(r[0], r[1]) for r in rows if r[2] == "system"] == [("", "t3")]
    assert readers.read_csv(spark, str(tmp_path / "c.csv")).count() == 0
