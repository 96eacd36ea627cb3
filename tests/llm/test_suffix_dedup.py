"""Removal of repeated strings against a plain version, and the sort of suffixes by itself."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm import suffix_dedup as SD
from rankloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def plain_removal(rows, length=50):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        if d is not None:
            for i in range(len(raw) - length + 1):
                w = raw[i:i + length]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if d is not None and first[raw[i:i + length]] < d:
                gone[i:i + length] = True
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def planted():
    rng = random.Random(5)
    words = ["the", "élan", "of", "日本", "x", "question", "aaaa"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))
    passage, line = text(40), "All rights reserved. Terms and conditions apply here as ever."
    rows = [(i, text(rng.randrange(0, 60))) for i in range(40)]
    rows += [(100 + i, text(6) + passage[i:] + text(5)) for i in range(25)]
    rows += [(200 + i, passage) for i in range(10)] + [(300 + i, (line + "\n") * i) for i in range(8)]
    rows += [(400, "z" * 500), (401, "z" * 49), (402, "z" * 50), (403, "yz" * 100 + "z" * 60), (404, None), (405, ""), (None, passage), (5, passage), (5, passage + "more")]
    rows += [(100, text(6) + passage), (-7, passage[:60])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"part_bytes": 2000, "large": 1000}], ids=["buckets", "large buckets dealt again"])
def test_equals_plain_version(spark, options):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(SD.without_repeats(docs, **options)) == plain_removal(rows)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = found(QUERIES["op13_suffix_array_dedup"](spark, SMALL))
    assert got == plain_removal(rows) and any(r[2] for r in got)


def test_empty_table_clashing_columns_and_kept_bytes(spark):
    assert SD.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = planted()[:60]
    clash = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1), F.lit("q"), F.lit(0)).toDF("doc_id", "text", "part", "Text", "lo")
    got = SD.without_repeats(clash, keep_text=True)
    assert found(got) == plain_removal(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got.collect())


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=20, max_size=300).map(str.encode), st.sampled_from([17, 20, 24, 50]))
def test_deep_shallow_sort_finds_all_equal_strings(raw, length):
    starts = np.arange(max(0, len(raw) - length + 1))
    got = {}
    for members, group in SD.equal_strings(raw, starts, length):
        for m, g in zip(members.tolist(), group.tolist()):
            got.setdefault((id(members), g), set()).add(m)
    want = {}
    for s in starts.tolist():
        want.setdefault(raw[s:s + length], set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_each_string_is_in_one_context():
    raw = random.Random(1).randbytes(5000)
    ends = np.array([10, 10, 700, 2000, 2049, 5000])
    first, n, anchor, _ = SD.contexts(raw, ends, 50)
    got = [s for f, k in zip(first.tolist(), n.tolist()) for s in range(f, f + k)]
    assert got == [s for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()) for s in range(a, b - 49)]
    assert ((anchor >= first + n - 1) & (anchor + 16 <= first + 50)).all()


def bucket_of(rows):
    """All contexts of some texts in one bucket."""
    raw = [t.encode() for _, t in rows]
    source = SD.Slice({"slice": 0, "ids": [d for d, _ in rows], "sizes": SD.packed(np.array(list(map(len, raw)), np.int32)), "raw": SD.packed(b"".join(raw))}, 50)
    own, zero = np.arange(len(source.first)), np.zeros(len(source.first), np.int64)
    sent = SD.blocks(zero, zero, source.cells(own), source.n, source.anchor - source.first, source.owner, source.start, source)
    return SD.Bucket(sent.to_pandas(), 50), source


def test_copies_are_repeats_without_a_sort(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(3)]
    rows = [(10 * k + i, t) for k in range(4) for i, t in enumerate(texts)]
    sorted_, sort = [], SD.equal_strings
    monkeypatch.setattr(SD, "equal_strings", lambda raw, starts, *a, **b: sorted_.append(len(starts)) or sort(raw, starts, *a, **b))
    spans = [s for found in SD.repeats_in(bucket_of(rows)[0], 50) for s in found.itertuples()]
    assert not sum(sorted_)
    assert {s.number for s in spans} == set(range(3, 12)) and {(s.number, p) for s in spans for p in range(s.lo, s.hi)} == {(k, p) for k in range(3, 12) for p in range(3000)}


def test_repeats_in_a_slice_do_not_depend_on_the_order_of_equal_anchors(monkeypatch):
    rows = [(i, t) for i, t in planted() if i is not None and t]
    want = bucket_of(rows)[1].repeat
    monkeypatch.setattr(SD, "HELD", 3)
    assert want.any() and bucket_of(rows)[1].repeat.tolist() == want.tolist()


def test_a_slice_sends_a_bucket_one_row_for_many_texts(spark):
    """Rows that travel are slices times buckets: a few megabytes are one slice."""
    docs = spark.range(50, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("some words and number "), F.col("id")), 4000).alias("text"))
    cut = SD.text_slices(docs)
    assert cut.count() == 1
    sent = SD.sent_anchors(cut, 4, 50).collect()
    assert len(sent) == len({(r["slice"], r["part"]) for r in sent}) <= 4


@pytest.mark.parametrize("length", [30, 50, 90])
def test_anchors_of_other_lengths(spark, length):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(SD.without_repeats(docs, length=length)) == plain_removal(rows, length)
