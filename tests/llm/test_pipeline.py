"""The pipeline's stages, each on what its predecessor kept."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline

from .conftest import LINE, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    item = prose(rng, 40)
    rows = [(k, prose(rng, 120), 1) for k in range(60)]
    rows += [(100 + k, "*** $$$ " * 60 + prose(rng, 5), 0) for k in range(30)]
    rows += [(200 + k, f"{prose(rng, 60)}\n{LINE}\n{prose(rng, 60)}", 1) for k in range(6)]
    rows += [(300, rows[3][1], 1), (301, rows[3][1] + " more", 1), (400, f"{prose(rng, 50)} {item} {prose(rng, 50)}", 1)]
    at = tmp_path_factory.mktemp("tables")
    docs = [(d, t, "en", "s", len(t)) for d, t, _ in rows] + [(500, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, q, 0) for d, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen, columns = [], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id: r for r in docs.collect()})
        assert k == 4 or docs.columns == columns
    clean = set(range(60)) | set(range(200, 206)) | {300, 301, 400}
    assert clean <= set(seen[0]) and not set(range(100, 130)) & set(seen[0])
    assert set(seen[1]) == set(seen[0])
    assert [LINE in seen[1][200 + k].text for k in range(6)] == [False] * 5 + [True]
    assert seen[1][200].n_chars == len(seen[1][200].text)
    assert {3, 300, 301} & set(seen[2]) == {3} and set(seen[1]) - set(seen[2]) == {300, 301}
    assert set(seen[2]) - set(seen[3]) == {400}
    assert set(seen[4]) == set(seen[3])


def test_stages_on_odd_rows(spark, folder, odd, empty):
    for docs in (odd, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            assert k == 4 or out.columns == docs.columns
            out.count()


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
