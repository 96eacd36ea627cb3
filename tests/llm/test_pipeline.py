"""The pipeline's stages against plain versions of their decisions, on a small corpus with planted cases."""

import corpus_pipeline
import pytest
from brute import base_spans, base_statistics, contained
from test_jaccard_groups import groups_of

from rankloom.llm import quality_rules, secret_scan, simhash_groups

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = docs.where("n_chars > 2000").limit(3)
    docs = docs.union(extra.selectExpr("doc_id + 100000", "text", "lang", "source", "n_chars")).union(docs.limit(2)).unionByName(
        spark.createDataFrame([(200000, None, None, None, None)], docs.schema))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(simhash_groups.stored(stage(spark, out[-1], SMALL), name))
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(spark, stages):
    trees = quality_rules.fit_quality_trees(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = []
    for d, t in rows(stages[0]):
        n, _, _, _, repeat = base_statistics(t)
        score = trees.score(quality_rules.statistics([t or ""])[1])[0]
        if n >= 50 and 100 * repeat <= 50 * n and score >= 0.5:
            want.append((d, t))
    assert sorted(rows(stages[1])) == sorted(want)


def test_near_duplicate_stage(stages):
    before = rows(stages[1])
    want = set(groups_of(before).values())  # five-word shingles, Jaccard similarity of 0.8 or more
    assert sorted(d for d, _ in rows(stages[2])) == sorted(want) and set(rows(stages[2])) <= set(before)
    assert len(before) > len(want)


def test_decontamination_stage(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {d for _, d in contained(rows(stages[2]), items)}
    assert bad and sorted(rows(stages[3])) == sorted(r for r in rows(stages[2]) if r[0] not in bad)


def test_secrets_stage(stages):
    after = {r["doc_id"]: r for r in stages[4].collect()}
    before = rows(stages[3])
    assert sorted(after) == sorted(d for d, _ in before)
    for d, t in before:
        if base_spans(t):
            assert secret_scan.MARK in after[d]["text"] and not base_spans(after[d]["text"])
        elif secret_scan.MARK not in after[d]["text"]:
            assert after[d]["text"] == t
        assert after[d]["n_chars"] == len(after[d]["text"])


def test_packing_stage(stages):
    pieces = stages[5].collect()
    assert {p["doc_id"] for p in pieces} == {d for d, _ in rows(stages[4])}
    places = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:]):
        assert (o2 == o + n and o2 < 1024) if s == s2 else (o2 == 0 and o + n <= 1024)


def test_run_is_registered():
    assert corpus_pipeline.QUERIES["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5
