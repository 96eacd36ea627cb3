"""Queries of the corpus operators and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import backoff_scores, conversation_trie, decontaminate, host_consensus, language_crf, pack_two_fit, quality_nbsvm, quality_rules, secret_scan, simhash_groups, suffix_dedup, token_alignment, toxicity_zstd
from rankloom.llm.labelled import fold

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    def add(build: Builder) -> Builder:
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DECONTAMINATION_SQL = """
WITH d AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM documents),
i AS (SELECT item_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM benchmark),
dw AS (SELECT doc_id, string_split(t, ' ') AS w FROM d WHERE t <> ''),
iw AS (SELECT item_id, string_split(t, ' ') AS w FROM i WHERE t <> ''),
ds AS (SELECT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM dw)
  UNION SELECT doc_id, array_to_string(w[k:k + q - 1], ' ') AS s FROM (SELECT doc_id, w, q, unnest(range(1, len(w) - q + 2)) AS k FROM dw, (SELECT DISTINCT len(w) AS q FROM iw WHERE len(w) < 5) WHERE len(w) >= q)),
si AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM iw)),
n AS (SELECT item_id, count(*) AS n_shingles FROM si GROUP BY item_id),
m AS (SELECT item_id, doc_id, count(*) AS n_shared FROM si JOIN ds USING (s) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, n_shared, n_shingles, n_shared / n_shingles AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles - 1e-9
"""


@query("op1_benchmark_decontamination", DECONTAMINATION_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


BACKOFF_SQL = """
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, CASE WHEN k = 1 THEN '' ELSE w[k - 1] END AS c, w[k] AS w FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM t)),
own AS (SELECT doc_id, c, w, count(*) AS m FROM p GROUP BY ALL),
pairs AS (SELECT c, w, sum(m) AS n FROM own GROUP BY ALL),
firsts AS (SELECT c, sum(m) AS n FROM own GROUP BY ALL),
own_firsts AS (SELECT doc_id, c, sum(m) AS n FROM own GROUP BY ALL),
words AS (SELECT w, sum(m) AS n FROM own GROUP BY ALL),
own_words AS (SELECT doc_id, w, sum(m) AS n FROM own GROUP BY ALL),
total AS (SELECT sum(n) AS n FROM words),
s AS (SELECT own.doc_id, sum(m) AS n_words, sum(m * CASE WHEN pairs.n > m THEN ln(pairs.n - m) - ln(firsts.n - own_firsts.n)
        ELSE ln(0.4) + ln(greatest(words.n - own_words.n, 1)) - ln(total.n) END) AS log_score
      FROM own JOIN pairs USING (c, w) JOIN firsts USING (c) JOIN own_firsts USING (doc_id, c) JOIN words USING (w) JOIN own_words USING (doc_id, w), total
      GROUP BY own.doc_id)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, round(log_score / n_words, 6) AS score FROM documents LEFT JOIN s USING (doc_id)
"""


@query("op4_stupid_backoff_scores", BACKOFF_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = backoff_scores.backoff_scores(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", F.round("score", 6).alias("score"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(ord_: int, pattern: str, least: int, group: int = 0) -> str:
    kind, p = secret_scan.KINDS[ord_], _quoted(pattern)
    return (f"SELECT doc_id, {ord_} AS ord, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS q, "
            f"regexp_split_to_array(t, {p}) AS g FROM d")


_RUN = "[A-Za-z0-9+/_=-]{20,}"
_W = secret_scan.WINDOW
_CHARS = f"string_split(substr(f, i::BIGINT, {_W}), '')"
_ENTROPY = (f"log2({_W}) - list_min(list_transform(range(1, length(f) - {_W - 2}), lambda i: list_sum(list_transform(list_distinct({_CHARS}), "
            f"lambda c: len(list_filter({_CHARS}, lambda y: y = c)) * log2(len(list_filter({_CHARS}, lambda y: y = c))))))) / {_W}.0")
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(f, {_quoted(p)}) THEN {bits}" for _, p, bits in secret_scan.CLASSES) + " END"
_ALLOWED = " OR ".join(f"regexp_matches(f, {_quoted(p)})" for p in secret_scan.ALLOWED)
_CUT = _quoted(secret_scan.CUT)
_LEN = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({_found(0, secret_scan.ASSIGN, 6, 1)}
  UNION ALL {_found(1, secret_scan.ACCESS, 20)} UNION ALL {_found(2, secret_scan.HEX, 24)} UNION ALL {_found(3, _RUN, _W)}),
u AS (SELECT doc_id, ord, kind, least, m, q, g, unnest(range(1, len(m) + 1)) AS k FROM r),
s AS (SELECT doc_id, ord, kind, least, length(q[k]) AS n, m[k] AS f, (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::BIGINT AS a FROM u),
b AS (SELECT doc_id, ord, kind, a, a + length(f) AS z FROM s WHERE ord < 3 AND n >= least),
n AS (SELECT doc_id, a, a + length(f) AS z, f, row_number() OVER () AS run FROM s WHERE ord = 3),
c AS (SELECT run, b.a AS x, b.z AS y FROM n JOIN b ON b.doc_id = n.doc_id AND b.a < n.z AND n.a < b.z
  UNION ALL SELECT run, q0, q0 + length(m[k]) FROM (SELECT run, m, k, (a + {_LEN.format('g[1:k]')} + {_LEN.format('m[1:k - 1]')})::BIGINT AS q0 FROM (
    SELECT run, a, regexp_extract_all(f, {_CUT}) AS m, regexp_split_to_array(f, {_CUT}) AS g, unnest(range(1, len(regexp_extract_all(f, {_CUT})) + 1)) AS k FROM n))
  UNION ALL SELECT run, z, z FROM n),
w AS (SELECT run, greatest(n.a, coalesce(max(y) OVER (PARTITION BY run ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n.a)) AS a, x AS z, n.a AS base, n.f AS whole, doc_id FROM c JOIN n USING (run)),
v AS (SELECT doc_id, a, z, substr(whole, a - base + 1, z - a) AS f FROM w WHERE z - a >= {_W}),
e AS (SELECT doc_id, 3 AS ord, 'entropy' AS kind, a, z FROM v WHERE regexp_matches(f, '[0-9]|[a-z][A-Z]') AND NOT ({_ALLOWED}) AND {_ENTROPY} >= {_CLASS}),
x AS (SELECT * FROM b UNION ALL SELECT * FROM e),
y AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
  string_agg(concat(kind, ':', a, ':', z), ',' ORDER BY a, ord) FILTER (ord < 3) AS base, string_agg(concat(kind, ':', a, ':', z), ',' ORDER BY a, ord) AS spans FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN y USING (doc_id)
"""


@query("op7_secret_scan", SECRETS_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_scan.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("secret_spans")).alias("spans"))


@query("op8_simhash_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash_groups.hex_print("fp").alias("fingerprint"), "component_id")


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality_rules.fit_quality_trees(docs, table(spark, sf_dir, "labels"))
    rows = quality_rules.quality_verdicts(docs.select("doc_id", "text"), trees)
    return rows.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "quality_score")


@query("op6_best_two_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_two_fit.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_quality_nbsvm")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = quality_nbsvm.fit_quality(docs, table(spark, sf_dir, "labels"))
    rows = quality_nbsvm.quality_scores(docs, scorer)
    return rows.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_toxicity_compression")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_zstd.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    rows = toxicity_zstd.toxicity_scores(docs, model)
    return rows.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_language_crf")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = language_crf.predicted_languages(docs, language_crf.fit_languages(docs))
    return rows.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op5_host_consensus_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    winners = simhash_groups.stored(host_consensus.winning_paths(pages), "host-paths")
    return host_consensus.main_texts(pages, winners, winners.count())


# crc32 by its shift register, one byte of the id's digits after the other
_CRC = ("xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), "
        "lambda r, b: list_reduce(list_concat([xor(r, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))")
TRIE_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
    {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS m FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(m ORDER BY k) AS own, {_CRC} % 9 AS h FROM t GROUP BY conv_id),
p AS (SELECT o.conv_id, list_concat(coalesce(f.own[1:o.h], []), o.own[o.h + 1:]) AS path FROM o LEFT JOIN o AS f ON f.conv_id = o.conv_id - o.conv_id % 5),
x AS (SELECT conv_id, d, path[1:d] AS path, d = len(path) AS last FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM p)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM x GROUP BY path, d),
c AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
w AS (SELECT n.path, n.d, (c.d IS NULL)::BIGINT AS leaf, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.path[n.d].t) END AS saved
  FROM n LEFT JOIN c ON c.d = n.d AND c.path = n.path),
s AS (SELECT path[1:k] AS path, k AS d, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT path, leaf, saved, unnest(range(0, d + 1)) AS k FROM w) GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.d = n.d AND s.path = n.path LEFT JOIN c ON c.d = n.d AND c.path = n.path LEFT JOIN n AS u ON u.d = n.d - 1 AND u.path = n.path[1:n.d - 1]
"""


@query("op12_conversation_trie", TRIE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query("op11_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = token_alignment.align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_suffix_array_dedup")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
