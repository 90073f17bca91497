"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest

pytest.importorskip("public_tokenizers")

from termweave.llm import decontam, line_dedup, minhash, packed_ids, packing, pii, quality_gbdt, quality_rules, token_counts, toxicity
from termweave.llm.queries import BYTE_BPE, WORD_BPE, tokenizer_path

PER_ROW = {
    "token_counts": lambda d, labels: token_counts.count_tokens(d, tokenizer_path(BYTE_BPE)),
    "toxicity": lambda d, labels: toxicity.score_toxicity(d, labels),
    "packed_ids": lambda d, labels: packed_ids.read_shards(packed_ids.write_shards(d, tokenizer_path(BYTE_BPE))),
    "line_dedup": lambda d, labels: line_dedup.dedup_lines(d),
    "pii": lambda d, labels: pii.find_personal_data(d),
    "quality_gbdt": lambda d, labels: quality_gbdt.score_quality(d, labels),
    "quality_rules": lambda d, labels: quality_rules.judge_quality(d),
    "minhash": lambda d, labels: minhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_for_each_row(name, odd, odd_rows, labels):
    got = PER_ROW[name](odd, labels).toPandas()
    assert len(got) == len(odd_rows)
    ids = sorted(-1 if i is None or i != i else int(i) for i in got["doc_id"])
    assert ids == sorted(-1 if i is None else i for i, _ in odd_rows)
    same = got[got["doc_id"] == 5].drop(columns=[c for c in ("start",) if c in got]).astype(str)
    assert len(same.drop_duplicates()) == 1


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(name, empty, labels):
    assert PER_ROW[name](empty, labels).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "quality_gbdt"])
def test_no_labels(name, odd, odd_rows, labels):
    got = PER_ROW[name](odd, labels.where("false")).toPandas()
    assert len(got) == len(odd_rows) and got["score"].between(0, 1).all()


def test_packing(odd, empty):
    got = packing.pack_documents(odd, tokenizer_path(WORD_BPE)).toPandas()
    assert (got["length"] <= 2048).all() and (got["length"] >= 1).all()
    assert packing.pack_documents(empty, tokenizer_path(WORD_BPE)).count() == 0


def test_decontamination(odd, empty, benchmark):
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(odd, benchmark).collect()}
    assert got == {(d, 1) for d in (4, 5, 6, 40, None)}
    left = decontam.remove_leaks(odd, benchmark)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()}.isdisjoint({4, 5, 6, 40, None})
    assert decontam.find_leaks(empty, benchmark).count() == 0
    assert decontam.find_leaks(odd, benchmark.where("false")).count() == 0


def test_decontamination_beyond_broadcast(odd, benchmark, monkeypatch):
    want = {tuple(r) for r in decontam.find_leaks(odd, benchmark).collect()}
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_PAIRS", 0)
    assert {tuple(r) for r in decontam.find_leaks(odd, benchmark).collect()} == want
    assert decontam.remove_leaks(odd, benchmark).count() == odd.count() - 7


def test_near_dedup_beyond_broadcast(odd, monkeypatch):
    want = sorted(map(str, minhash.near_duplicates(odd).collect()))
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 2)
    assert sorted(map(str, minhash.near_duplicates(odd).collect())) == want
