"""Keywords of a page table: distinctive terms, phrases and suggestions merged, rated and scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankloom.functions import text as TX
from rankloom.operators import keyword_sets as KS, text_mining as TM


def _lists(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Ranked values (at most a few per page) as one array per page."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", value)))
    return rows.groupBy("url").agg(F.transform(ordered, lambda x: x[value]).alias(out))


def enrich_keywords(pages: DataFrame, suggestions: DataFrame | None = None, positions: DataFrame | None = None,
                    most: int = 15) -> DataFrame:
    """Loaded pages with ``keywords``, ``keywords_ngrams``, ``competition`` and ``keywords_scored``.

    The text branches run over the body once each and come back to the page as arrays of bounded length.
    """
    loaded = pages.where("not is_error and status_code = 200 and body_text <> ''").drop(
        "keywords", "keywords_ngrams", "competition", "keywords_scored")
    terms = _lists(TM.tfidf_keywords(loaded, TM.page_text(), "url"), "term", "_terms")
    grams = _lists(TM.phrases(loaded, F.col("body_text"), "url", k=8), "phrase", "keywords_ngrams")
    scored = TM.keyword_importance(loaded, suggestions=suggestions, positions=positions)
    fields = [c for c in scored.columns if c != "url"]
    tier = F.when(F.col("importance") == "HIGH", 0).when(F.col("importance") == "MEDIUM", 1).otherwise(2)
    lists = scored.groupBy("url").agg(
        F.array_sort(F.collect_list(F.struct(tier.alias("_t"), (-F.col("freq")).alias("_f"), "keyword", F.struct(*fields).alias("s"))))
        .alias("_l"))
    lists = lists.select("url", F.transform("_l", lambda x: x["s"]).alias("keywords_scored"))
    out = loaded.join(terms, "url", "left").join(grams, "url", "left").join(lists, "url", "left")
    if suggestions is not None:
        out = out.join(suggestions, "url", "left")
    else:
        out = out.withColumn("suggestions", F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    merged = KS.merge_keywords(F.coalesce("_terms", empty), F.coalesce("keywords_ngrams", empty), F.coalesce("suggestions", empty), most)
    out = out.withColumn("keywords", merged).withColumn("keywords_ngrams", F.coalesce("keywords_ngrams", empty))
    return out.withColumn("competition", TX.competition(F.col("keywords"))).drop("_terms", "suggestions")
