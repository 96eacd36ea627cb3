"""Keyword extraction: TF-IDF, frequent terms, phrases, weighted terms, importance, site similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom import lookups as L
from rankloom.functions import text as TX
from rankloom.functions.scores import ctr_tier, expected_ctr
from rankloom.operators.skew import HOT_ROWS, salted_join
from rankloom.sources.tables import kept


# So many terms at most are looked up without moving the rows of their documents.
FREQUENT_TERMS = 100_000
# The words at the start of a body in which a keyword counts as prominent: part of the score's definition.
HEAD_WORDS = 100


def tokens(text: Column) -> Column:
    """Latin words of three letters or more, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), F.lit(1))


def without(words: Column, stopwords: Sequence[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(list(stopwords)))


def page_text() -> Column:
    """Page fields as one text, the title three times and the first headings twice."""
    h1, h2 = F.array_join("h1", " "), F.array_join("h2", " ")
    return F.concat_ws(" ", "title", "title", "title", h1, h1, "meta_description", h2, "body_text")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often it is named."""
    return F.transform(F.array(value), use)[0]


def counted(words: Column) -> Column:
    """Distinct words of an array and their numbers (``term, n``), in order of the words: run lengths of the sorted array."""
    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))), lambda i: (i <= F.size(s)) & ((i == 1) | (F.get(s, i - 1) != F.get(s, i - 2))))
        return _bound(begins, lambda b: F.transform(b, lambda i, k: F.struct(
            F.get(s, i - 1).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s) + 1) - i).cast("long").alias("n"))))

    return _bound(F.sort_array(words), runs)


def most_frequent(counts: Column, k: int) -> Column:
    """The ``k`` cells ``term, n`` with the largest numbers, by term where these are equal."""
    ranked = F.slice(F.sort_array(F.transform(counts, lambda c: F.struct((-c["n"]).alias("m"), c["term"].alias("term")))), 1, k)
    return F.transform(ranked, lambda c: F.struct(c["term"].alias("term"), (-c["m"]).alias("n")))


def _ranked_rows(rows: DataFrame, key: str, cells: Column, term: str, n: str) -> DataFrame:
    """A row for each cell with its rank from 1."""
    return rows.select(key, F.posexplode(cells).alias("_p", "_c")).select(
        key, (F.col("_p") + 1).alias("rank"), F.col("_c.term").alias(term), F.col("_c.n").alias(n))


def term_counts(docs: DataFrame, text: Column, key: str = "url") -> DataFrame:
    """Occurrences per document and term, counted inside the row: each row is a document of its own."""
    return docs.select(key, F.explode(counted(tokens(text))).alias("c")).select(key, F.col("c.term").alias("term"), F.col("c.n").alias("tf"))


def _weights(counts: DataFrame, n_docs: int, features: int | None) -> DataFrame:
    """``term, df, idf`` of all terms, or of the most frequent ones."""
    vocabulary = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    if features is not None:
        vocabulary = vocabulary.orderBy(F.desc("total"), "term").limit(features)
    idf = F.log((1.0 + F.lit(n_docs)) / (1.0 + F.col("df"))) + 1.0
    return vocabulary.select("term", "df", idf.alias("idf"))


def _with_weights(counts: DataFrame, weights: DataFrame, features: int | None, spread: str) -> DataFrame:
    """Join ``weights`` (by term, with ``df``) to stored counts.

    Terms of at least a ``FREQUENT_TERMS``-th of all rows, which are no more than that, are broadcast, so that most rows stay where
    they are; the rows of the others are joined by term, split where a term has over a million.
    """
    if features is not None:
        return counts.join(F.broadcast(weights.drop("df")), "term")
    weights = kept(weights, "term-weights")
    rows = weights.agg(F.sum("df")).head()[0] or 0
    often = F.col("df") * FREQUENT_TERMS >= F.lit(rows)
    hot = weights.where(~often & (F.col("df") > HOT_ROWS)).select("term", F.ceil(F.col("df") / HOT_ROWS).cast("int").alias("_parts"))
    common = F.broadcast(weights.where(often).drop("df"))
    rare = salted_join(counts.join(common.select("term"), "term", "left_anti"), weights.where(~often).drop("df"), ["term"], F.col(spread), hot=hot)
    return counts.join(common, "term").unionByName(rare)


def tfidf(docs: DataFrame, text: Column, key: str = "url", features: int | None = None, excluded: Sequence[str] = ()) -> DataFrame:
    """Weight of each term in each document, scaled to unit length per document.

    ``features`` keeps the most frequent terms of the corpus only; such a vocabulary has a fixed size bound and is broadcast.
    Without it all terms count; those of many documents are broadcast, the others joined by term.
    """
    counts = term_counts(docs, text, key)
    counts = kept(counts.where(~F.col("term").isin(list(excluded))) if excluded else counts, "term-counts")
    weighted = _with_weights(counts, _weights(counts, docs.count(), features), features, key)
    weighted = weighted.select(key, "term", ((1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("w") / length).alias("weight"))


def _top(rows: DataFrame, key: str, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    numbered = rows.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.where(F.col(rank) <= k)


def tfidf_keywords(docs: DataFrame, text: Column, key: str = "url", k: int = 10, features: int | None = None,
                   excluded: Sequence[str] = (), stopwords: Sequence[str] = L.TERM_STOPWORDS) -> DataFrame:
    """Most distinctive terms per document: of the best ``2k`` those that are no stop words, at most ``k``."""
    weights = tfidf(docs, text, key, features, excluded).withColumn("weight", F.round("weight", 9))
    best = _top(weights, key, [F.desc("weight"), F.col("term")], 2 * k, "_r")
    kept = best.where(~F.col("term").isin(list(stopwords)))
    return _top(kept, key, [F.col("_r")], k).select(key, "rank", "term", "weight")


def frequent_keywords(docs: DataFrame, text: Column, key: str = "url", k: int = 10,
                      stopwords: Sequence[str] = L.TERM_STOPWORDS) -> DataFrame:
    """Most common terms per document that are no stop words."""
    return _ranked_rows(docs, key, most_frequent(counted(without(tokens(text), stopwords)), k), "term", "tf")


def _grams(words: Column, n: int) -> Column:
    last = F.size(words) - (n - 1)
    return F.when(
        last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))


def phrases(docs: DataFrame, text: Column, key: str = "url", k: int = 10) -> DataFrame:
    """Phrases of two and three words: of the ``2k`` most common those seen twice or of three words, at most ``k``."""
    grams = _bound(without(tokens(text), L.PHRASE_STOPWORDS), lambda w: F.concat(_grams(w, 2), _grams(w, 3)))
    best = most_frequent(counted(grams), 2 * k)
    chosen = F.filter(best, lambda c: (c["n"] >= 2) | (F.size(F.split(c["term"], " ")) == 3))
    return _ranked_rows(docs, key, F.slice(chosen, 1, k), "phrase", "n")


def weighted_terms(pages: DataFrame, k: int = 10) -> DataFrame:
    """Words and word pairs of a page by weighted frequency; pairs seen twice replace their words."""
    h1 = F.array_join("h1", " ")
    text = F.concat_ws(" ", "title", "title", "title", h1, h1, "body_text")
    words = without(tokens(text), L.FIELD_STOPWORDS)
    counts = pages.select("url", _bound(words, lambda w: F.struct(
        counted(w).alias("singles"), F.filter(counted(_grams(w, 2)), lambda c: c["n"] >= 2).alias("pairs"))).alias("_c"))
    singles, pairs = F.col("_c.singles"), F.col("_c.pairs")
    used = F.array_distinct(F.flatten(F.transform(pairs, lambda c: F.split(c["term"], " "))))
    # words of a pair stand right before their own cell in the sorted array
    marks = F.transform(used, lambda t: F.struct(t.alias("term"), F.lit(0).cast("long").alias("n")))
    rest = _bound(F.sort_array(F.concat(marks, singles)), lambda a: F.filter(
        a, lambda c, i: (c["n"] > 0) & ((i == 0) | (F.get(a, i - 1)["term"] != c["term"]))))
    return _ranked_rows(counts, "url", most_frequent(F.concat(rest, pairs), k), "keyword", "freq")


def keyword_importance(pages: DataFrame, k: int = 10, suggestions: DataFrame | None = None,
                       positions: DataFrame | None = None, intent: Column | None = None) -> DataFrame:
    """Importance, density and prominence of the weighted terms of each page.

    ``suggestions`` has ``url, suggestions`` (array); ``positions`` has ``url, keyword, position``.
    """
    usable = pages.where("not is_error and body_text <> ''")
    terms = weighted_terms(usable, k).select("url", "keyword", "freq")
    body = TX.squeeze(F.col("body_text"))
    texts = usable.select(
        "url", TX.squeeze(F.concat_ws(" \u0001 ", "title", F.array_join("h1", " "))).alias("_top"),
        TX.squeeze(F.concat_ws(" \u0001 ", F.array_join("h2", " "), F.array_join("h3", " "))).alias("_sub"),
        body.alias("_body"), F.array_join(F.slice(tokens(F.col("body_text")), 1, HEAD_WORDS), " ").alias("_head"),
        F.greatest(F.regexp_count(body, F.lit("[a-z]{3,}")), F.lit(1)).alias("_n"),
    )
    # at most k terms per page: they meet the page's text once, and the rows leave without it
    lists = terms.groupBy("url").agg(F.collect_list(F.struct("keyword", "freq")).alias("_terms"))
    looked_up = F.transform("_terms", lambda t: F.struct(
        t["keyword"].alias("keyword"), t["freq"].alias("freq"), TX.in_text(t["keyword"], F.col("_top")).alias("_in_top"),
        TX.in_text(t["keyword"], F.col("_sub")).alias("_in_sub"), TX.in_text(t["keyword"], F.col("_head")).alias("prominent"),
        F.round(100.0 * F.regexp_count("_body", TX.whole_word(t["keyword"])) / F.col("_n"), 2).alias("density")))
    rows = texts.join(lists, "url").select("url", F.inline(looked_up))
    if suggestions is not None:
        rows = rows.join(suggestions, "url", "left")
        pattern = TX.whole_word(F.col("keyword"))
        hit = F.coalesce(F.exists("suggestions", lambda s: F.rlike(s, pattern)), F.lit(False))
    else:
        hit = F.lit(False)
    if positions is not None:
        rows = rows.join(positions, ["url", "keyword"], "left")
    else:
        rows = rows.withColumn("position", F.lit(None).cast("int"))
    points = (
        F.when(F.col("_in_top"), 3).otherwise(0) + F.when(F.col("_in_sub"), 2).otherwise(0)
        + F.when(F.col("freq") > 5, 2).otherwise(0) + F.when(hit, 3).otherwise(0)
    )
    rows = rows.withColumn("score", points)
    score = F.col("score")
    intent = intent if intent is not None else F.lit("informational")
    return rows.select(
        "url", "keyword", "freq", "score",
        F.when(score >= 6, "HIGH").when(score >= 3, "MEDIUM").otherwise("LOW").alias("importance"),
        "density", "prominent", F.col("position").alias("serp_position"),
        F.when(F.col("position").isNotNull(), expected_ctr(F.col("position"), intent)).alias("expected_ctr"),
        F.when(F.col("position").isNotNull(), ctr_tier(F.col("position"))).alias("ctr_tier"),
    )


def site_similarity(docs: DataFrame, text: Column, target: str, features: int | None = None, excluded: Sequence[str] = ()) -> DataFrame:
    """Cosine similarity in percent between the text of the target site and of every other site.

    With ``features`` only the most frequent terms count, and the vector of the target is small enough to be broadcast.
    """
    counts = term_counts(docs, text, "site").groupBy("site", "term").agg(F.sum("tf").alias("tf"))
    counts = kept(counts.where(~F.col("term").isin(list(excluded))) if excluded else counts, "site-terms")
    n_sites = docs.select("site").distinct().count()
    strength = lambda tf: (1.0 + F.log(tf.cast("double"))) * F.col("idf")
    own = counts.where(F.col("site") == target).select("term", F.col("tf").alias("_own"))
    weights = kept(_weights(counts, n_sites, features).join(own, "term", "left").withColumn("tw", strength(F.col("_own"))).drop("_own"), "own-weights")
    own_norm = weights.agg(F.sqrt(F.sum(F.col("tw") * F.col("tw")))).head()[0] or 1.0
    joined = _with_weights(counts.where(F.col("site") != target), weights, features, "site").withColumn("w", strength(F.col("tf")))
    sums = joined.groupBy("site").agg(
        F.sum(F.col("w") * F.coalesce("tw", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.select("site", F.round(100.0 * F.col("dot") / (F.col("norm") * F.lit(own_norm)), 1).alias("similarity"))
