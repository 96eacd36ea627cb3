"""The prefix trie against a plain version, its bands and its hot keys."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.llm import conversation_trie as CT
from rankloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        worth = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += worth
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def planted():
    rng = random.Random(3)
    rows = []
    for c in range(60):
        if c in (10, 31):
            continue  # a family without its first conversation, and a gap
        for t in range(rng.randrange(1, 14)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "long text"])))
    for c in (200, 201, 230):  # copies of a long conversation
        rows += [(c, t, "user", f"turn {t % 7}") for t in range(90)]
    rows += [(300, None, "user", "x"), (300, None, "user", "b"), (300, 1, "z", "y"), (300, 1, "a", "y"), (300, 1, "a", "y"), (300, -4, "a", "n")]
    rows += [(None, 1, "user", "no conversation"), (205, 0, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [2, 8])
def test_equals_plain_version(spark, height):
    rows = planted()
    assert found(CT.conversation_trie(spark.createDataFrame(rows, SCHEMA), height=height)) == plain_trie(rows)


def test_slices_of_long_conversations_and_of_ids(spark, monkeypatch):
    monkeypatch.setattr(CT, "SLICE", 4)
    monkeypatch.setattr(CT, "ID_SLICE", 3)
    rows = planted() + [(c, t, "user", "same") for c in range(400, 460) for t in range(9, 12)]
    assert found(CT.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(rows)


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert CT.conversation_trie(empty).count() == 0
    rows = planted()[:50]
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "depth": F.lit(1), "a": F.lit(None), "bytes": F.lit("q"), "Place": F.lit(0)})
    assert found(CT.conversation_trie(clash)) == plain_trie(rows)


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    rounds = []
    inner = CT.band_totals

    def counted(*args):
        rounds.append(1)
        return inner(*args)

    monkeypatch.setattr(CT, "band_totals", counted)
    rows = [(7, t, "user", f"{t}") for t in range(300)]
    got = found(CT.conversation_trie(spark.createDataFrame(rows, SCHEMA), height=8))
    assert got == plain_trie(rows) and len(rounds) == 3


def test_query_on_the_given_table(spark):
    small = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op12_conversation_trie"](spark, small)) == plain_trie(rows)
