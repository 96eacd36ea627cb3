"""SimHash groups and benchmark decontamination against their definitions."""

import numpy as np
import pytest
from brute import components, contained, fingerprint

from rankloom.llm import decontaminate, simhash_groups

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return rows + [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "one two"), (9004, "one two"), (9005, "ONE  two"), (None, "one two"), (9006, long)]


def test_groups_equal_all_pairs(spark, corpus):
    got = simhash_groups.near_duplicate_groups(spark.createDataFrame(corpus, DOCS)).collect()
    want = components([(d, fingerprint(t)) for d, t in corpus])
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in got) == sorted((str(d), f, c) for d, f, c in want)


@pytest.mark.parametrize("tile_rows,tile_limit", [(64, 16384), (64, 100), (4096, 150)])
def test_tiles_lose_no_link(spark, tile_rows, tile_limit):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 40, dtype=np.int64).view(np.uint64)
    prints = {int(s) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for s in np.repeat(seeds, 15)}
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in sorted(prints)], "fp long")
    links = simhash_groups.similar_prints(df, 4, tile_rows, tile_limit)
    root = {r["node"] % 2**64: r["root"] for r in simhash_groups.star_rounds(links).collect()}
    want = {f: c for _, f, c in components([(i, p) for i, p in enumerate(sorted(prints))])}
    groups = {}
    for p in prints:
        groups.setdefault(root.get(p, p), set()).add(want[p])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_one_of_each_group_stays(spark, corpus):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in corpus], "doc_id long, text string, _k1 string, component_id int")
    got = simhash_groups.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    want = {c for _, _, c in components([(d, fingerprint(t)) for d, t in corpus])}
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)
    assert {(r["_k1"], r["component_id"]) for r in got.collect()} == {("x", 1)}


def test_group_without_ids_keeps_one(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (None, None)], DOCS)
    assert simhash_groups.drop_near_duplicates(docs).count() == 2


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c d e f")], DOCS)
    assert simhash_groups.near_duplicate_groups(docs).count() == 0
    assert simhash_groups.drop_near_duplicates(docs).count() == 0
    assert decontaminate.contained_items(docs, items).count() == 0
    assert decontaminate.contained_items(full, items).count() == 0
    assert decontaminate.drop_contaminated(full, items).count() == 1


def test_contained_items_equal_all_pairs(spark, corpus):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    words = items[0][1].split()
    docs = corpus + [
        (8001, "x " * 300 + items[1][1].upper() + " y" * 300), (8002, " ".join(words[:len(words) // 2])), (8003, " ".join(words[2:])),
        (8004, items[2][1].replace(" ", " , ")), (8004, items[2][1].replace(" ", " , ")), (8005, "alpha beta")]
    items += [(7001, items[1][1]), (7002, None), (7003, ""), (7004, "alpha beta"), (None, "alpha beta")]
    got = decontaminate.contained_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    found = [(r["item_id"], r["doc_id"]) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == contained(docs, [i for i in items if i[0] is not None])
    assert {(1, 8001), (7001, 8001), (7004, 8005)} <= set(found)


def test_contaminated_documents_go(spark, corpus):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    docs = spark.createDataFrame([(d, t, "z") for d, t in corpus], "doc_id long, text string, text_key string")
    got = decontaminate.drop_contaminated(docs, items)
    bad = {d for _, d in contained(corpus, [(r["item_id"], r["text"]) for r in items.collect()])}
    assert got.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(d) for d, _ in corpus if d not in bad)


def test_short_items_are_found_inside_long_texts(spark):
    long_ = "well " * 300 + "The answer, is FOUR indeed " + "so " * 300
    docs = spark.createDataFrame([(1, long_), (2, "the answer is five"), (3, "answer is four"), (4, None), (5, "four"), (6, "forty four")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "the answer is four"), (11, "Four"), (12, ""), (13, "well well well well well well")], "item_id long, text string")
    got = {(r["item_id"], r["doc_id"]) for r in decontaminate.contained_items(docs, items).collect()}
    assert got == {(10, 1), (11, 1), (11, 3), (11, 5), (11, 6), (13, 1)}
