"""Tokenizer alignment against a plain version from its definition."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm import token_alignment as TA
from rankloom.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
SMALL = "/root/testdata/sf0.001"


def plain_alignment(rows):
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}

    def bytes_a(i):
        return bytes(byte_of[c] for c in whole.id_to_token(i))

    def bytes_b(i):
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def spans(ids, of):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(of(i)), i))
            at += len(of(i))
        return out

    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            a, b = whole.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
            raw = (" " + text).encode()
            if b"".join(map(bytes_a, a)) != raw or b"".join(map(bytes_b, b)) != raw:
                a = b = []
        a, b = spans(a, bytes_a), spans(b, bytes_b)
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        counts.update(links)
        cuts = sorted({x[1] for x in a} & {y[1] for y in b})
        groups, start = [], 0
        for end in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if start <= s and e <= end) for side in (a, b)))
            start = end
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(((d, na, nb, g, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha)
                   for d, na, nb, g, links, sha in docs), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


ODD = ["", None, "a", " lead", "tail  ", "two  spaces\n\n and\ttab", "<|endoftext|> <s> <unk> <0x41>", "aaaaaaaaaaaaaaaaaaaa", "naïve 日本語 😀 ▁ piece", "▁", "日本語テキスト",
       "x" * 3000, "https://example.org/a-b_c?d=1&e=%20", "l'été d'où 12345678", "\r\n\r\n", "same words same words", "same words same words"]


@pytest.mark.parametrize("frequent", [1, 40, TA.FREQUENT])
def test_equals_plain_version(spark, frequent):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    rows = [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id here")] + [(d, (t or "")[:600]) for d, t in given]
    got, counts = TA.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), A, B, frequent=frequent)
    want = plain_alignment(rows)
    assert found(got) == want
    assert counts.agg(F.sum("n")).first()[0] == sum(r[4] for r in want)


def test_identity_map_holds_the_same_bytes():
    pair = TA.TokenizerPair(A, B)
    known = [(i, j) for i, j in enumerate(pair.identity) if j >= 0]
    assert len(known) > 5000 and all(pair.bytes_a[i] == pair.bytes_b[j] for i, j in known)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert TA.align_tokenizers(empty, A, B)[0].count() == 0
    rows = [(1, "some words"), (1, "some words"), (2, "other words")]
    clash = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x"), F.lit(1), F.lit("q")).toDF("doc_id", "text", "row", "code", "Text")
    assert found(TA.align_tokenizers(clash, A, B)[0]) == plain_alignment(rows)


def test_long_white_space_and_long_words(spark):
    rows = [(1, " " * 200_000), (2, "ab" * 100_000), (3, "word " * 50_000)]
    got = {r["doc_id"]: r for r in TA.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), A, B)[0].collect()}
    assert got[3]["n_groups"] > 40_000 and all(got[i]["n_a"] for i in (1, 2, 3))


def test_query_has_a_row_per_document(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = QUERIES["op11_tokenizer_alignment"](spark, SMALL)
    assert got.columns == COLUMNS and got.count() == docs.count()
