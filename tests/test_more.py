"""Cache, datasets, evidence lookup, encoders, merged documents, text helpers."""

import json

import pytest
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.operators import nearmiss, review, safety
from termweave.plans import fixtures, workflows
from termweave.plans.cache import VocabularyCache
from termweave.sources import vocabulary as V

DOC = {"scopes": [{"id": "s"}], "terms": [{"id": "a", "canonical": "access token", "aliases": ["bearer pass"]}, {"id": "b", "canonical": "rate limit"}]}


def test_cache(spark, tmp_path):
    path = tmp_path / "v.json"
    path.write_text(json.dumps(DOC))
    c = VocabularyCache(size=1)
    v = c.load(spark, str(path))
    assert c.load(spark, str(path)) is v and (c.hits, c.misses) == (1, 1)
    assert c.surfaces(v) is c.surfaces(v) and c.surfaces(v, False) is not c.surfaces(v)
    path.write_text(json.dumps({"terms": DOC["terms"][:1]}))
    assert c.load(spark, str(path)).fingerprint != v.fingerprint
    c.clear()
    assert not c.documents


def test_dataset(spark, tmp_path):
    rows = [("e1", 1, "k1", "accepted", "n", 0.9, 2, "none", True), ("e2", 2, "k2", "accepted", "", 0.9, 2, "none", True), ("e3", 3, "k2", "rejected", "n", 0.9, 2, "none", True), ("e4", 4, "k4", "accepted", "n", 0.1, 2, "none", True), ("e5", 5, "k5", "accepted", "n", 0.9, None, "none", True), ("e6", 6, "k6", "accepted", "n", 0.9, 1, "high", True)]
    e = spark.createDataFrame(rows, "event_id string, seq int, key string, decision string, note string, candidate_score double, positive_count int, highest_risk string, has_candidate boolean")
    e = e.withColumns({"created_at": F.timestamp_seconds("seq"), "high_count": F.lit(None).cast("int"), "safety_action": F.lit(None).cast("string")})
    assert {r.quality: r.n for r in review.quality_counts(review.build_dataset(e)).collect()} == {"usable": 1, "low_signal": 1, "incomplete": 1, "conflicting": 2, "unsafe": 1}
    assert [r.event_id for r in review.build_dataset(e, "usable", 2).orderBy("event_id").collect()] == ["e1", "e2"]
    review.export_dataset(review.build_dataset(e, "unsafe"), f"file://{tmp_path}/out")
    (line,) = [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    assert line["event_id"] == "e6" and list(line) == sorted(line)


def test_responses(spark):
    rows = [("k", 0, '{"recommendation":"accept","confidence":1.7,"canonical_name":" X ","risk_flags":["a"]}'), ("k", 1, '{"recommendation":"maybe"}'), ("k", 2, "no json")]
    got = [(r.recommendation, r.confidence, r.canonical_name, r.error) for r in review.parse_responses(spark.createDataFrame(rows, "key string, seq int, response string")).orderBy("seq").collect()]
    assert got == [("accept", 1.0, "X", None), (None, None, None, "invalid response"), (None, None, None, "invalid response")]


def test_evidence_lookup(spark):
    ask = spark.createDataFrame([(1, "a", "k"), (2, "z", "k")], "request_id int, term_id string, key string")
    lex = spark.createDataFrame([("a", 0, "from vocabulary")], "owner_id string, evidence_ord int, snippet string")
    ws = spark.createDataFrame([("k", n, f"w{n}") for n in range(1, 9)], "key string, ord int, text string")
    got = [(r.request_id, r.source, r.snippet) for r in review.find_evidence(ask, lex, ws, 2).orderBy("request_id", "rank").collect()]
    assert got == [(1, "vocabulary", "from vocabulary"), (1, "workspace", "w1"), (2, "workspace", "w1"), (2, "workspace", "w2")]


def test_encoder(spark):
    v = V.from_mapping(spark, DOC)
    s = nearmiss.suggest(spark.createDataFrame([("authToken",), ("rateLimits",)], "name string"), v, min_confidence=0.3)

    def load():
        return lambda texts: [(1.0, 0.0) if "oken" in t else (0.0, 1.0) for t in texts]

    got = {(r["name"], r.term_id): r.semantic for r in nearmiss.rerank_with(s, load).collect()}
    assert got[("authToken", "a")] == 1.0 and all(x in (1.0, -1.0) for x in got.values())


def test_merged_document(spark, tmp_path):
    change = lambda **k: V.from_mapping(spark, {**DOC, "terms": [DOC["terms"][0] | k, DOC["terms"][1]]})
    base, ours, theirs = V.from_mapping(spark, DOC), change(tags=["x"]), change(tools=["t"])
    doc = workflows.write_merged(base, ours, theirs, f"{tmp_path}/m.json")
    a = next(t for t in doc["terms"] if t["id"] == "a")
    assert a["tags"] == ["x"] and a["tools"] == ["t"] and json.loads((tmp_path / "m.json").read_text()) == doc
    with pytest.raises(V.VocabularyError):
        workflows.write_merged(base, change(canonical="one"), change(canonical="two"), f"{tmp_path}/n.json")
    assert not (tmp_path / "n.json").exists()


def test_rendering_for_models(spark):
    packs = spark.createDataFrame([("k", "cap", [("a.md", 1, 2, "x <b> & ```")], None)], "key string, surface string, positive_snippets array<struct<path:string,start_line:int,end_line:int,text:string>>, negative_snippets array<struct<path:string,start_line:int,end_line:int,text:string>>")
    text = safety.pack_for_review(packs).first().rendered
    assert "a.md:1-2" in text and "&lt;b&gt; &amp; ` ` `" in text
    df = spark.createDataFrame([("a\x00b\t<" + "x" * 50,)], "s string")
    assert df.select(T.sanitize("s", 10).alias("t")).first().t == "ab\t&lt;xx…"


def test_fixture_edits(spark):
    names = spark.createDataFrame([("red ring",), ("small bolt",), ("old rod",)], "p_name string")
    import tempfile

    folder = tempfile.mkdtemp()
    names.write.parquet(f"{folder}/part.parquet")
    v = fixtures.catalog(spark, folder)
    assert v.terms.count() == 3 and fixtures.edited(v, "ours").terms.count() == 5 and fixtures.edited(v, "theirs").terms.count() == 6
