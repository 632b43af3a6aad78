"""The pipeline's stages: their decisions take effect, and the whole run on a small table."""

import random
import sys

import pytest

import corpus_pipeline as P
from tests.llm.test_free import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    words = [f"word{i}" for i in range(500)]
    rows = []
    for i in range(240):
        t = " ".join(r.choice(words) for _ in range(r.randint(40, 80)))
        if i % 8 == 0:
            t = " ".join(r.choice(["%%%", "###", "buy", "now"]) for _ in range(60))
        rows.append((i, t))
    rows += [(300 + i, rows[1][1]) for i in range(20)]
    rows += [(400 + i, rows[2][1] + f" tail{i}") for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t)) for i, t in rows]
    path = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 0), 0) for i in range(240) if i % 2], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    return path, {i: t for i, t, *_ in rows}


def test_stages(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = P.quality(spark, docs, path)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & set(range(0, 240, 8)) and len(ids & {i for i in range(240) if i % 8}) >= 208
    one = P.exact(spark, docs.unionByName(docs.where("doc_id = 5")), path)
    ids = [r.doc_id for r in one.collect()]
    assert len(ids) == len(set(texts.values())) and 319 in ids and 1 not in ids and ids.count(5) == 1
    apart = P.near(spark, one, path)
    want = jaccard({i: texts[i] for i in ids}, 5, 80)
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i in ids if want[i][1] == i)
    mixed = P.mixing(spark, apart, path)
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and set(counts.values()) <= {1, 2} and counts


def test_run(spark, folder):
    out = P.run(spark, folder[0])
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() > 200


def test_rows_without_ids_and_clashing_columns(spark, folder):
    rows = [(None, "alpha beta", None, None, None, 1), (None, None, None, None, None, 2), (7, "gamma", "en", "s", 5, 3), (7, "gamma", "en", "s", 5, 3)]
    docs = spark.createDataFrame(rows, SCHEMA + ", kept int")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder[0])
        assert docs.columns[-1] == "kept", name
    assert P.STAGES[-1][1](spark, docs, folder[0]).count() >= 1
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, empty, folder[0]).count() == 0
    assert "corpus_pipeline" in sys.modules
