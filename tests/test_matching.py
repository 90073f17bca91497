"""Matching, resolving, gating and evaluation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from termweave.functions.normalize import normalize, unicode_metadata
from termweave.operators import drift, evaluate, match, resolve
from termweave.plans import fixtures
from termweave.sources import behaviour, vocabulary as V

DOC = {
    "version": 1,
    "scopes": [{"id": "billing"}, {"id": "api"}],
    "terms": [
        {"id": "billing.credit_limit", "canonical": "credit limit", "scopes": ["billing"], "tools": ["billing.update_credit_limit"], "aliases": ["customer cap", {"surface": "limit", "scopes": ["billing"]}]},
        {"id": "api.rate_limit", "canonical": "rate limit", "scopes": ["api"], "tools": ["api.update_rate_limit"], "aliases": [{"surface": "limit", "scopes": ["api"]}, {"surface": "throttle", "deprecated": True}]},
        {"id": "api.key", "canonical": "API key", "scopes": ["api"], "aliases": [{"surface": "API_KEY", "case_sensitive": True}]},
    ],
}


@pytest.fixture(scope="module")
def v(spark):
    return V.from_mapping(spark, DOC)


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "text_id int, text string")


def statuses(spark, v, rows, requested=None):
    got = resolve.resolve(texts(spark, *rows), v, requested).collect()
    return [(r.status, r.term_ids) for r in sorted(got, key=lambda r: r.text_id)]


def test_resolve(spark, v):
    rows = ["please raise the limit", "increase the customer cap", "the rateLimit and RATE_LIMIT", "crate limits", "", None, "ratelimit"]
    got = statuses(spark, v, rows)
    assert got[0] == ("ambiguous", ["api.rate_limit", "billing.credit_limit"])
    assert [s for s, _ in got[1:]] == ["resolved", "resolved", "unknown", "unknown", "unknown", "resolved"]
    assert statuses(spark, v, rows[:1], F.array(F.lit("billing"))) == [("resolved", ["billing.credit_limit"])]


def test_scores_and_order(spark, v):
    m = match.match_all(texts(spark, "rate limit rate_limit limit"), match.surface_dimension(v))
    c = {r.term_id: r for r in resolve.candidates(m, v).collect()}
    assert c["api.rate_limit"].score == 10 + 10 + 20 + 5 and c["api.rate_limit"].match_count == 3
    assert c["api.rate_limit"].matched_surfaces == ["rate limit", "rate_limit", "limit"]


def test_case_sensitive_alias_suppresses_variant(spark, v):
    dim = {(r.search_surface, r.kind, r.case_sensitive) for r in match.surface_dimension(v).where("term_id = 'api.key'").collect()}
    assert ("API_KEY", "alias", True) in dim and ("api_key", "canonical", False) not in dim and ("api-key", "canonical", False) in dim
    got = match.match_all(texts(spark, "API_KEY api_key"), match.surface_dimension(v)).collect()
    assert [(r.start, r.kind) for r in got] == [(0, "alias")]


def test_deprecated_alias(spark, v):
    assert statuses(spark, v, ["throttle"])[0][0] == "resolved"
    got = match.match_all(texts(spark, "throttle"), match.surface_dimension(v), include_deprecated=False)
    assert got.count() == 0


def test_unicode_offsets(spark, v):
    text = "ａ ｃｕｓｔｏｍｅｒ​cap ﬁne  limit"
    got = {(r.matched_text, r.start, r.end) for r in match.match_all(texts(spark, text), match.surface_dimension(v)).collect()}
    assert ("ｃｕｓｔｏｍｅｒ​cap", 2, 14) in got and ("limit", 20, 25) in got


def test_normalize():
    norm, back, found = normalize("\uff41\u00a0b\u202e c")
    assert norm == "a b c" and back == [0, 1, 2, 4, 5]
    assert [f["kind"] for f in found] == ["compatibility", "non_ascii_space", "bidi_control"]


def test_fast_path_equals_slow(spark):
    rows = ["a b", " a  b ", "", "tab\tx", "é", "x" * 20_000, None]
    got = unicode_metadata(texts(spark, *rows)).collect()
    assert {r.text_id: r.norm for r in got} == {k: normalize(t or "")[0] for k, t in enumerate(rows)}


def test_guard(spark, v):
    calls = spark.createDataFrame([(0, "raise the limit", "x"), (1, "customer cap", "billing.update_credit_limit"), (2, "customer cap", "api.update_rate_limit"), (3, "send mail", "x"), (4, "an API key", "x"), (5, "send‮ mail", "x")], "text_id int, text string, tool_name string")
    got = {r.text_id: (r.status, r.action, r.is_allowed) for r in resolve.guard(calls, v).collect()}
    assert got == {0: ("needs_clarification", "ask_clarification", False), 1: ("allowed", "proceed", True), 2: ("blocked", "block", False), 3: ("no_match", "proceed", True), 4: ("allowed", "proceed", True), 5: ("blocked", "block", False)}


def test_guard_calls_of_one_id(spark):
    """A longer match in another call's text crowds out a call's own term, but not its tool."""
    v = V.from_mapping(spark, {"terms": [{"id": "p.ring", "canonical": "red ring", "tools": ["use.ring"]}, {"id": "p.widget", "canonical": "red widget", "tools": ["use.widget"]}]})
    calls = spark.createDataFrame([(7, "use red ring", "use.ring"), (7, "use red widget", "use.widget"), (8, "use red ring", "use.widget"), (9, "red ring, red widget", "use.ring")], "text_id int, text string, tool_name string")
    got = sorted((r.text_id, r.tool_name, r.status) for r in resolve.guard(calls, v).collect())
    assert got == [(7, "use.ring", "allowed")] * 2 + [(7, "use.widget", "allowed")] * 2 + [(8, "use.widget", "blocked"), (9, "use.ring", "needs_clarification")]


def test_order_lines_of_one_id(spark, tmp_path):
    """Keys from 1,000,000 on reach into the next order's ids: equal texts of an id are one, different ones stay."""
    spark.createDataFrame([(5, "red ring", "a"), (1_000_005, "red ring", "b"), (6, "red ring", "a"), (1_000_006, "hot rod", "b")], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0, 1_000_005, 1), (1, 5, 1), (0, 1_000_006, 1), (1, 6, 1)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r.text_id, r.noun) for r in fixtures.order_lines(spark, str(tmp_path)).collect())
    assert got == [(10_000_051, "ring"), (10_000_061, "ring"), (10_000_061, "rod")]


def test_random_texts_match_as_by_search(spark):
    rng = random.Random(0)
    alphabet = "ab1_ .-é"
    surfaces = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5))).strip() for _ in range(40)} - {""})
    surfaces = [s for s in surfaces if normalize(s)[0] == s]
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    dim = spark.createDataFrame([(s, s, "alias", [], False, False, s) for s in surfaces], "term_id string, surface string, kind string, scopes array<string>, case_sensitive boolean, deprecated boolean, search_surface string")
    got = {(r.text_id, r.surface, r.start) for r in match.match_all(texts(spark, *rows), dim).collect()}
    want, word = set(), re.compile(r"[\w]")
    for k, t in enumerate(rows):
        norm, back, _ = normalize(t)
        for s in surfaces:
            for m in re.finditer(f"(?={re.escape(s)})", norm):
                a, b = m.start(), m.start() + len(s)
                free = (a == 0 or not (word.match(norm[a]) and word.match(norm[a - 1]))) and (b == len(norm) or not (word.match(norm[b - 1]) and word.match(norm[b])))
                if free:
                    want.add((k, s, back[a]))
    assert got == want


def test_large_vocabulary(spark, v, monkeypatch):
    t, dim = texts(spark, "credit limit", "API_KEY and RATE-limit", None, "credit limit"), match.surface_dimension(v)
    want = sorted(map(str, match.match_all(t, dim).collect()))
    monkeypatch.setattr(match, "BROADCAST_ROWS", 0)
    assert sorted(map(str, match.match_all(t, dim).collect())) == want and len(want) > 3


def test_longest(spark, v):
    m = match.match_longest(match.match_all(texts(spark, "credit limit and limit"), match.surface_dimension(v))).collect()
    assert sorted((r.start, r.term_id) for r in m) == [(0, "billing.credit_limit"), (17, "api.rate_limit")]


def test_evaluation(spark, v, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"id":"a","text":"the limit","expected_status":"ambiguous","tool_calls":[{"tool_name":"t","expected_allowed":false}]}\n{"id":"b","text":"nothing","expected_status":"resolved"}\n')
    q = behaviour.read_queries(spark, str(path))
    m = {r.metric: (r.passed, r.total, r.ratio) for r in evaluate.metrics(*evaluate.run_evaluation(q, v)).collect()}
    assert m["resolution_status"] == (1, 2, 0.5) and m["ambiguity_detection"] == (1, 1, 1.0) and m["wrong_tool_prevention"] == (1, 1, 1.0)
    assert m["canonicalization"] == (0, 0, None) and behaviour.query_problems(q).count() == 0


@pytest.mark.parametrize("change", [{"version": 2}, {"terms": [{"id": "x", "canonical": "y", "scopes": ["nowhere"]}]}, {"scopes": [{"id": "a"}, {"id": "a"}]}, {"terms": [{"id": "", "canonical": "y"}]}, {"terms": [{"id": "x", "canonical": "same"}, {"id": "z", "canonical": "Same"}]}])
def test_bad_documents(spark, change):
    with pytest.raises(V.VocabularyError):
        V.from_mapping(spark, change)


def test_documents_round_trip(spark, v, tmp_path):
    again = V.from_mapping(spark, V.to_document(v))
    assert sorted(map(str, again.terms.collect())) == sorted(map(str, v.terms.collect()))
    (tmp_path / "v.yaml").write_text("version: 1\nterms:\n  - id: a.b\n    canonical: some name\n    aliases: [other name]\n")
    assert V.load(spark, str(tmp_path / "v.yaml")).aliases.count() == 1


def test_drift(spark):
    v = V.from_mapping(spark, {"terms": [{"id": "auth.access_token", "canonical": "access token"}]})
    lines = spark.createDataFrame([("a.py", 1, "accessToken = 1"), ("a.py", 2, "authToken = 2"), ("a.py", 3, "credentialBlob = 3"), ("a.py", 4, "def issue_c():")], "path string, line_number int, text string")
    known, unknown = drift.known_occurrences(lines, v), drift.unknown_identifiers(lines, v)
    assert [r.matched_text for r in known.collect()] == ["accessToken"]
    assert {(r.name, r.review_kind) for r in unknown.collect()} == {("authToken", "likely_alias"), ("credentialBlob", "likely_new_term"), ("issue_c", "unresolved_identifier")}
    s = drift.summary(lines, known, unknown).first()
    assert (s.known_count, s.likely_alias_count, s.likely_new_term_count, s.hidden_count) == (1, 1, 1, 1)


def test_drift_searches_each_text_once(spark, monkeypatch):
    v = V.from_mapping(spark, {"terms": [{"id": "auth.access_token", "canonical": "access token", "scopes": []}]})
    rows = [(f"{k % 7}.py", k, "accessToken = some_blob") for k in range(200)] + [("0.py", 0, "accessToken = other_blob"), ("0.py", 0, "accessToken = some_blob"), ("0.py", 1, None)]
    lines, seen = spark.createDataFrame(rows, "path string, line_number int, text string"), []
    monkeypatch.setattr(drift, "match_all", lambda texts, *a: seen.append(texts.count()) or match.match_all(texts, *a))
    known, unknown = drift.known_occurrences(lines, v), drift.unknown_identifiers(lines, v)
    assert seen == [2, 3]  # texts, then names
    s = drift.summary(lines, known, unknown).first()
    assert (s.added_line_count, s.known_count, s.likely_new_term_count, s.likely_alias_count) == (203, 200, 201, 0)
    assert known.where("path = '0.py' AND line_number = 0").count() == 1
    assert drift.known_occurrences(lines, v, F.array(F.lit("x"))).count() == 200
