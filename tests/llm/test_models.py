"""Backoff scores, language labels and classifiers: brute force and held-out accuracy."""

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from brute import WORD

from rankloom.llm import backoff_scores, language_crf, quality_nbsvm, queries, toxicity_zstd
from rankloom.llm.labelled import labelled_sample, sampled

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"


def brute_scores(rows, alpha=0.4):
    words = {d: WORD.findall(t or "") for d, t in rows}
    pairs = {d: Counter(zip([None, *ws], ws)) for d, ws in words.items()}
    all_pairs, firsts, all_words = Counter(), Counter(), Counter()
    for d, ws in words.items():
        all_pairs.update(pairs[d])
        all_words.update(ws)
    for (c, _), n in all_pairs.items():
        firsts[c] += n
    total = sum(all_words.values())
    out = {}
    for d, ws in words.items():
        own_words, own_firsts = Counter(ws), Counter([None, *ws[:-1]]) if ws else Counter()
        s = 0.0
        for (c, w), m in pairs[d].items():
            n = all_pairs[c, w] - m
            s += m * (math.log(n / (firsts[c] - own_firsts[c])) if n else math.log(alpha * max(all_words[w] - own_words[w], 1) / total))
        out[d] = (len(ws), s)
    return out


@pytest.mark.parametrize("bucket_words,frequent", [(2_500_000, 100_000), (3000, 50), (3000, 1)])
def test_backoff_scores_equal_brute_force(spark, bucket_words, frequent):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (9003, "lonely"), (9004, "the " * 5000), (9005, "the the unheard-of the")]
    want = brute_scores(rows)
    got = backoff_scores.backoff_scores(spark.createDataFrame(rows, DOCS), bucket_words=bucket_words, frequent=frequent).collect()
    assert len(got) == len(want)
    for r in got:
        n, s = want[r["doc_id"]]
        assert r["n_words"] == n and abs(r["log_score"] - s) < 1e-6 * max(1, abs(s))
        assert (r["score"] is None) == (n == 0)


def test_backoff_of_odd_ids_and_empty_tables(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a b c"), (2, None)]
    got = {r["doc_id"]: r["n_words"] for r in backoff_scores.backoff_scores(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 4, 2: 0}
    assert backoff_scores.backoff_scores(spark.createDataFrame([], DOCS)).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    sizes, k = [1, 6, 40, 3], 3
    e, t = rng.normal(size=(sum(sizes), k)), rng.normal(size=(k, k))
    first = np.zeros(len(e), bool)
    first[np.cumsum(sizes) - sizes] = True
    got = language_crf.marginals(e, first, t, block=4)
    pairs = language_crf.pair_shares(e, first, t)
    want, total = np.zeros((6, k)), 0.0
    for labels in itertools.product(range(k), repeat=6):
        w = sum(math.exp(t[i, labels[0]]) for i in range(k)) * math.exp(sum(e[1 + i, x] for i, x in enumerate(labels)) + sum(t[a, b] for a, b in zip(labels, labels[1:])))
        total += w
        for i, x in enumerate(labels):
            want[i, x] += w
    assert np.abs(got[1:7] - want / total).max() < 1e-12
    assert np.abs(got[~first] - pairs[~first].sum(1)).max() < 1e-12


def test_languages(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = language_crf.fit_languages(docs)
    rows = docs.limit(0).collect() or [tuple(r) for r in docs.select("doc_id", "text").collect()]
    de, en = (next(r["text"] for r in docs.where(f"lang = '{x}' and n_chars between 500 and 900 and doc_id % 4 = 1").collect()) for x in ("de", "en"))
    edges = [(-1, None), (-2, "12 . !!"), (-3, ""), (-4, "€ — 3"), (-5, en + " " + de), (-6, en * 200)]
    got = {r["doc_id"]: r for r in language_crf.predicted_languages(spark.createDataFrame(rows + edges, DOCS), model).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [d for d in lang if queries.fold and __import__("zlib").crc32(str(d).encode()) % 4 == 2]
    assert np.mean([got[d]["lang_pred"] == lang[d] for d in held]) > 0.98
    assert all((got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0) for d in (-1, -2, -3, -4))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[-6]["lang_pred"] == "en"
    labels = language_crf.labelled_words(spark.createDataFrame(edges, DOCS).where("doc_id = -5"), model).first()["labels"]
    cut = len(en.split())
    assert np.mean([x == "en" for x in labels[:cut]]) > 0.95 and np.mean([x == "de" for x in labels[cut:]]) > 0.95


def test_languages_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    model = language_crf.fit_languages(docs)
    assert [tuple(r) for r in language_crf.predicted_languages(docs, model).collect()] == [(1, "und", 0.0)]
    assert language_crf.predicted_languages(docs.limit(0), model).count() == 0


def auc(p, y):
    p, y = np.asarray(p), np.asarray(y)
    return np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])


@pytest.mark.parametrize("name,label,least", [("op9_quality_nbsvm", "quality", 0.95), ("op10_toxicity_compression", "toxic", 0.8)])
def test_classifiers_on_held_out_documents(spark, name, label, least):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, MIDDLE).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc([r["score"] for r in held], [labels[r["doc_id"]] for r in held]) > least


@pytest.mark.parametrize("fit,score", [(quality_nbsvm.fit_quality, quality_nbsvm.quality_scores), (toxicity_zstd.fit_toxicity, toxicity_zstd.toxicity_scores)])
def test_classifiers_on_edge_cases(spark, fit, score):
    docs = spark.createDataFrame([(i, f"word{i % 7} other words {i}", 0.5) for i in range(60)] + [(100, None, 0.5), (101, "", 0.5), (102, "x " * 100_000, 0.5), (103, "x", 0.5), (103, "x", 0.5)],
                                 DOCS + ", score double")
    names = "doc_id long, quality int, toxic int"
    for rows in ([], [(i, 1, 1) for i in range(60)], [(i, i % 2, i % 2) for i in range(60)] + [(None, 1, 1), (3, None, None), (5, 0, 0)]):
        model = fit(docs, spark.createDataFrame(rows, names))
        got = score(docs, model).collect()
        assert len(got) == 65 and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 103}) == 1
        assert score(docs.limit(0), model).count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    w, b = quality_nbsvm.dual_coordinate_descent([(np.arange(5), r) for r in x], y, np.full(200, 10.0), 5, rounds=200)
    assert np.mean(np.sign(x @ w + b) == y) > 0.97
    loss = lambda w, b: 0.5 * (w @ w + b * b) + 10 * np.maximum(0, 1 - y * (x @ w + b)).sum()
    assert all(loss(w, b) <= 1.005 * loss(w + d, b) for d in 0.05 * rng.normal(size=(50, 5)))


def test_toxic_starts():
    table = {b"mean": (1, 40), b"meany": (0, 38), b"meanyx": (0, 5), b"than": (500, 60), b"thank": (100, 20)}
    assert toxic_starts(table) == {b"meany": 40}


def toxic_starts(table):
    return toxicity_zstd.toxic_starts(table, 500, 60, 10, 6.0)


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    import zlib

    docs = spark.createDataFrame([(i, "t") for i in range(4000)], DOCS)
    labels = spark.createDataFrame(pd.DataFrame({"doc_id": range(4000), "quality": 1}))
    rows = labelled_sample(docs, labels, "quality", 500, (3, 1)).collect()
    assert 300 < len(rows) <= 1000 and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in rows)


def test_long_words_with_different_tails_are_different_indicators():
    a, b = ("http://example.org/" + "a-1" * 10 + x for x in ("-b/c", "_9"))
    assert set(quality_nbsvm.indicators([a])[1]) != set(quality_nbsvm.indicators([b])[1])
    assert quality_nbsvm.shape_of(a.encode()) != quality_nbsvm.shape_of(b.encode())


@pytest.mark.parametrize("rows", [10, 10**6, 10**10, 10**13])
def test_samples_keep_their_size_for_any_number_of_rows(spark, rows):
    n = 200_000
    share = 2000 / n  # a sample as for ``rows`` rows, drawn from n of them
    ids = spark.range(n)
    wanted = max(1, int(rows * share))
    got = ids.where(sampled(wanted, rows, "id", seed=3)).count()
    assert abs(got - n * wanted / rows) <= 0.1 * n * wanted / rows + 5
    assert ids.where(sampled(rows, rows, "id", seed=3)).count() == n
