"""Files, layout, tokenizers, events and requests."""

import json

from pyspark.sql import functions as F

from termweave.functions.oov import with_tokenizer
from termweave.sources import files, layout, store, vocabulary as V
from termweave.streaming import events, requests


def test_files(spark, tmp_path):
    root = tmp_path / "proj"
    for name, data in {"README": b"# Title\nText\n", "docs/a/b.md": "café\r\nx".encode(), "src/m.py": b"\xef\xbb\xbfa = 1", "node_modules/x.md": b"no", "src/blob.json": b"a\0b", "docs/w.txt": "wide".encode("utf-16"), "docs/pic.png": b"x", "big.md": b"y" * 2000}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    docs, skipped = files.read_documents(files.discover(spark, str(root), max_bytes=1000))
    got = {r.path: r for r in docs.collect()}
    assert set(got) == {"README", "docs/a/b.md", "src/m.py", "docs/w.txt"}
    assert (got["README"].kind, got["README"].line_count) == ("markdown", 2) and got["src/m.py"].text == "a = 1" and got["docs/w.txt"].text == "wide" and got["docs/a/b.md"].line_count == 2
    assert [r.relative_path for r in skipped.collect()] == ["src/blob.json"]


def test_layout(spark, tmp_path):
    assert not layout.inspect(str(tmp_path))["valid"]
    base = layout.init(str(tmp_path))
    assert layout.inspect(str(tmp_path))["valid"] and V.load(spark, f"{base}/vocabulary.json").terms.count() == 1
    assert json.loads(open(layout.write_manifest(str(tmp_path))).read())["valid"]


def test_tokenizer_scores(spark):
    def load():
        return lambda s: ["payment", "##core", "##v", "##2"] if s == "PaymentCoreV2" else ["[UNK]"]

    df = spark.createDataFrame([("PaymentCoreV2",), ("Zq",), ("Zq",)], "surface string")
    got = sorted((r.surface, r.oov_tokenizer_score) for r in with_tokenizer(df, load).collect())
    # 4 pieces of 3 fragments: extra 1/6, continued 3/4, none unknown, proxy 0.58 * 2/4 + 0.34 * 2/4 + 0.35 / 4
    assert got[0] == ("PaymentCoreV2", round(0.52 / 6 + 0.16 * 0.75 + 0.10 * round(0.29 + 0.17 + 0.0875, 4), 4))
    assert len(got) == 3 and got[1] == got[2]


def test_event_stream(spark, tmp_path):
    w = store.Workspace(spark, f"file://{tmp_path}/ws")
    for d in ("accepted", "rejected"):
        w.append_event("a b", d)
    for _ in range(2):
        events.keep_latest(events.read_events(spark, f"file://{tmp_path}/ws/review_events"), f"file://{tmp_path}/latest", f"file://{tmp_path}/cp").awaitTermination()
        w.append_event("c", "accepted")
    last = sorted((tmp_path / "latest").glob("batch=*"), key=lambda p: int(p.name.split("=")[1]))[-1]
    assert {(r.key, r.decision) for r in spark.read.parquet(str(last)).collect()} >= {("a b", "rejected"), ("c", "accepted")}


def test_requests(spark, tmp_path):
    v = V.from_mapping(spark, {"terms": [{"id": "t.a", "canonical": "alpha one", "tools": ["go"], "evidence": [{"snippet": "said so"}]}]})
    call = lambda n, tool, **a: json.dumps({"jsonrpc": "2.0", "id": n, "method": "tools/call", "params": {"name": tool, "arguments": a}})
    rows = [call(1, "resolve_term", text="use alphaOne"), call("two", "guard_tool_call", text="alpha one", tool_name="stop"), call(3, "find_evidence", term_id="t.a"), call(4, "nothing"), '{"jsonrpc":"2.0","id":5,"method":"ping"}', "{broken", '{"jsonrpc":"2.0","method":"notifications/initialized"}', '{"id":6,"method":"odd"}', "7", f"[{call(8, 'resolve_term', text='none')},{call(9, 'check_language', text='alpha one')}]"]
    lines = spark.createDataFrame([(str(k), r) for k, r in enumerate(rows)], "row_id string, value string")
    got = {r.row_id: json.loads(r.response) for r in requests.answer(lines, v, v.evidence).collect()}
    inner = lambda k: json.loads(got[k]["result"]["content"][0]["text"])
    assert got["0.0"]["id"] == 1 and inner("0.0")["primary_term_id"] == "t.a"
    assert got["1.0"]["id"] == "two" and inner("1.0")["status"] == "blocked" and inner("2.0")["evidence"][0]["snippet"] == "said so"
    assert got["3.0"]["result"]["isError"] and got["4.0"]["result"] == {} and got["5.0"]["error"]["code"] == -32700 and "6.0" not in got
    assert got["7.0"]["error"]["code"] == -32601 and got["8.0"]["error"]["code"] == -32600
    assert inner("9.0")["status"] == "unknown" and inner("9.1")["status"] == "resolved"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(rows[0] + "\n" + rows[4] + "\n")
    requests.serve(spark.readStream.text(f"{tmp_path}/in"), v, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.text(f"{tmp_path}/out").where(F.col("value").contains('"id":1')).count() == 1
