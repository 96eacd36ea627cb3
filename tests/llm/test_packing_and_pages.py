"""Packing and page extraction against exact round trips."""

import time
import tracemalloc
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankloom.llm import host_consensus, pack_two_fit, queries

SMALL = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"
FAST, WHOLE = pack_two_fit.TextTokenizer(BPE), Tokenizer.from_file(BPE)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t 　\x1cab'stD3é日🙂!.$<|>", max_size=40))
def test_ids_equal_the_whole_tokenizer(text):
    assert np.frombuffer(FAST.packed_ids(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a<|endoftext|> b", "  ", "   a", "a \n", "a\n b", "a \n b", "a  b   c", "x\r\n y", "I'll don't 's"])
def test_ids_of_odd_texts(text):
    assert np.frombuffer(FAST.packed_ids(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=30))
def test_patterns_use_every_piece_once(counts):
    patterns = pack_two_fit.two_fit_patterns(counts, 64)
    used = Counter()
    for lengths, times in patterns:
        assert sum(lengths) <= 64 and times > 0
        for n in lengths:
            used[n] += times
    assert used == Counter(counts)
    total = sum(n * c for n, c in counts.items())
    bins = sum(t for _, t in patterns)
    assert bins <= max(1, 2 * -(-total // 64)) if total else bins == 0


def test_two_fit_replaces_the_smallest():
    # greedy: 50, 10 leaves 4; replacing 10 by 8 and 6 fills the bin
    assert pack_two_fit.two_fit_patterns({50: 1, 10: 1, 8: 1, 6: 1}, 64)[0] == ([50, 8, 6], 1)


def test_packing_round_trip(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (9003, "same text"), (9003, "same text"), (9004, "word " * 30_000)]
    placed = pack_two_fit.pack_documents(spark.createDataFrame(rows, DOCS), BPE, keep_ids=True).cache()
    pieces = placed.collect()
    by_doc = {}
    for p in pieces:
        assert p["length"] == len(p["input_ids"]) <= 1024 and p["ids_crc32"] == zlib.crc32(np.array(p["input_ids"], "<u4").tobytes())
        by_doc.setdefault(p["doc_id"], []).append(p)
    for doc_id, text in rows:
        own = sorted(by_doc[doc_id], key=lambda p: (p["piece"], p["sequence_id"], p["offset"]))
        ids = [*WHOLE.encode(text or "", add_special_tokens=False).ids, 2]
        if doc_id == 9003:
            assert [p["input_ids"] for p in own] == [ids, ids]
            continue
        assert sum((p["input_ids"] for p in own), []) == ids
        assert [p["start"] for p in own] == np.cumsum([0, *[p["length"] for p in own]])[:-1].tolist()
        assert all(p["length"] == 1024 for p in own[1:])
    bins = {}
    for p in pieces:
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.02 * sum(p["length"] for p in pieces) / 1024 + 1
    sequences = pack_two_fit.packed_sequences(placed).collect()
    assert sum(len(s["input_ids"]) for s in sequences) == sum(p["length"] for p in pieces) and len(sequences) == len(bins)


def test_packing_of_an_empty_table(spark):
    assert pack_two_fit.pack_documents(spark.createDataFrame([], DOCS), BPE).count() == 0


def test_ranks_of_one_hot_length(spark):
    pieces = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "cast(7 + int(id % 10 = 0) as long) as length", "id as ids_crc32")
    for n, own in ((7, 4500), (8, 500)):
        assert sorted(r["rank"] for r in pack_two_fit.ranked(pieces, 9).where(f"length = {n}").collect()) == list(range(own))


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="post-%d"><div id="cookie-notice"><p>%s</p></div>
<nav><a href="/">Home</a></nav><div class="wrap"><div class="content item-%d"><h1>Big  &amp; bold</h1><p>First <b>part<br>here<p>Second&nbsp;part, <a href="#">linked</a>.
<ul><li>one<li>two</ul><script>if (a < b) "</p>";</script><form><p>Sign up</p></form></div><div class="comments"><p>%s</p></div></div>
<aside><p>%s</p></aside><footer>&copy; x</footer></body></html>"""
TEXT = "Big & bold First part here Second part, linked. one two"


def test_parts_of_a_page():
    page = PAGE % (3, "cookies " * 50, 17, "I like it very much. " * 40, "more " * 80)
    text, path = host_consensus.extract(page, [])
    assert text == TEXT and path == "/html/body.post-#/div.wrap/div.content.item-#"


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain & simple", "plain & simple"), ("<p>a<p>b", "a b"), ("<!-- <p>x</p>", ""), ("<script>x", ""), ("a < b", "a < b"),
    ("<p>x &#233; &eacute; &unknown; &lt;p&gt;</p>", "x é é &unknown; <p>"), ("<div><br/>a<img src='x>y'/>b</div>", "ab"), ("</p></div>x", "x")])
def test_odd_pages(page, text):
    assert host_consensus.extract(page, [])[0] == text


def test_consensus_beats_a_page_of_comments(spark):
    usual = [(i, "https://a.example/%d" % i, PAGE % (i, "", i, "ok", "")) for i in range(30)]
    odd = PAGE.replace('class="comments"', 'class="talk"') % (99, "", 99, "a long discussion " * 60, "")
    rows = [*usual, (99, "https://a.example/odd", odd), (100, None, None), (101, "https://b.example/", "<p>alone</p>"), (101, "https://b.example/", "<p>alone</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    winners = host_consensus.winning_paths(pages)
    got = host_consensus.main_texts(pages, winners, winners.count()).collect()
    assert [r["text"] for r in got if r["page_id"] < 100] == [TEXT] * 31
    assert [(r["text"], r["n_chars"]) for r in got if r["page_id"] == 100] == [("", 0)] and [r["text"] for r in got if r["page_id"] == 101] == ["alone"] * 2
    assert host_consensus.main_texts(pages.limit(0), winners.limit(0), 0).count() == 0


def test_query_equals_the_article_element(spark):
    import html

    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries.QUERIES["op5_host_consensus_text"](spark, SMALL).collect():
        article = re.search("<article>(.*)</article>", rows[r["page_id"]], re.S)[1]
        plain = re.sub("<[^>]+>", "", re.sub("<br>|</?p>|</?h1>", " ", article))
        assert r["text"] == " ".join(html.unescape(plain).split()) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("page", [
    "<div class='x-1'>" * 50_000 + "deep", "<a href='x" * 50_000, '<p class="y>' * 50_001 + "end", "<span>" * 50_000 + "</b>" * 50_000, "<script>" * 50_000, "<a>t" * 50_000,
    "<!-- " * 50_000, "<p>one " * 50_000], ids=str.split("deep quotes odd-quotes unmatched scripts links comments paragraphs"))
def test_long_broken_pages_take_time_and_memory_by_length(page):
    began = time.process_time()
    host_consensus.extract(page, [])
    assert time.process_time() - began < 5
    tracemalloc.start()
    host_consensus.extract(page, [])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20


def test_an_article_in_two_parts_is_whole():
    page = "<body><div class='menu'>m</div><section><div class='part a1'><p>first half of it</p></div><div class='ad'>x</div><div class='rest'><p>second half</p></div></section></body>"
    paths = ["/body/section/div.a#.part", "/body/section/div.rest"]
    assert host_consensus.extract(page, paths)[0] == "first half of it second half"
    assert host_consensus.extract(page, paths[::-1])[0] == "first half of it second half"
