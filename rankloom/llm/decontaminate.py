"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Texts are lower-cased, everything but letters and digits separates words, shingles have five words. An item of q distinct
shingles is contained in a document that holds at least ``threshold * q`` of them, whatever the document's length.

Items are partitioned by size (powers of two). The MinHash sketch of an item is its k smallest shingle hashes, k being one more than the
shingles an item of its size class may miss: a document that contains the item must hold one of them, so the search
loses nothing. Document hashes above the largest sketch value cannot match and are not exploded; classes too large for a
document are not probed. Candidates are verified on the shingles themselves.

Only built-in functions are used. Defined results: null and empty texts have no shingle and match nothing; a text of one to
four words is one shingle of all its words, and an item of that kind is found wherever its words follow each other, as documents are probed
for shingles of as many words too; equal items are found each; rows alike in id and text are reported once; items
without an id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.batches import numbered, picked
from rankloom.llm.simhash_groups import bounded, stored

SHINGLE = 5
THRESHOLD = 0.8


def word_array(text: str) -> Column:
    """Lower-case words of letters and digits."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def shingle_starts(words: str, width: int) -> Column:
    size = F.size(words)
    return F.when(size == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(size - width, F.lit(0))))


def shingle_texts(words: str, width: int = SHINGLE) -> Column:
    return F.array_distinct(F.transform(shingle_starts(words, width), lambda i: F.array_join(F.slice(F.col(words), i + 1, width), " ")))


def with_short_shingles(words: Column, widths: list[int], make) -> Column:
    """Shingles of the common width and those of the widths of short items; ``make(words, start, width)`` gives one."""
    starts = lambda w, k: F.when(F.size(w) < k, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))))
    common = lambda w: F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))))
    one = lambda w, k: lambda i: make(w, i, k)
    # the word array is bound once by a one-element transform, so that it is split once per text and not once per word
    return F.flatten(F.transform(F.array(words), lambda w: F.concat(
        F.transform(common(w), one(w, SHINGLE)), *[F.transform(starts(w, k), one(w, k)) for k in widths])))


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``item_id, shingle, h, n_shingles, n_needed, rank``: rank orders the shingles of an item by hash."""
    words = picked(items, item_id=id_col, text=text_col).where(F.col("item_id").isNotNull()).select("item_id", word_array("text").alias("words"))
    return (
        words.select("item_id", shingle_texts("words").alias("shingles"))
        .groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles"))
        .where(F.size("shingles") > 0)
        .withColumn("n_shingles", F.size("shingles"))
        .withColumn("n_needed", F.ceil(F.lit(threshold) * F.col("n_shingles") - F.lit(1e-9)).cast("int"))
        .withColumn("sorted", F.array_sort(F.transform("shingles", lambda s: F.struct(text_hash(s).alias("h"), s.alias("shingle")))))
        .select("item_id", "n_shingles", "n_needed", F.posexplode("sorted").alias("rank", "cell"))
        .select("item_id", "n_shingles", "n_needed", "rank", "cell.h", "cell.shingle")
    )


def text_hash(shingle: Column) -> Column:
    """The hash that ``shingle_hashes`` gives, from the shingle's text."""
    words = F.split(shingle, " ")
    return F.xxhash64(*[F.get(words, F.lit(k)) for k in range(SHINGLE)])


def item_sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The MinHash sketch of each item; its length follows from the largest size of the item's class."""
    size_class = F.floor(F.log2("n_shingles")).cast("int")
    upper = F.pow(F.lit(2), F.col("size_class") + 1) - 1
    return (
        shingles.withColumn("size_class", size_class)
        .withColumn("k", F.floor(upper - threshold * upper + 1e-9) + 1)
        .where(F.col("rank") < F.col("k"))
        .select("item_id", "size_class", "n_needed", "h")
    )


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``item_id, doc_id, text_key, n_shared, n_shingles, containment`` for each item that a document contains."""
    shingles = stored(item_shingles(items, item_col, item_text_col, threshold), "item-shingles")
    sketches = item_sketches(shingles, threshold)
    width = F.size(F.split("shingle", " "))
    widths = [r[0] for r in shingles.where(width < SHINGLE).select(width).distinct().collect()]  # four values at most
    top = sketches.agg(F.max("h"), F.count("*")).first()
    texts = picked(docs, doc_id=id_col, text=text_col).withColumn("text_key", F.xxhash64("text"))
    probes = (
        texts.select("doc_id", "text_key", shingle_hashes_of_text("text", widths).alias("hashes"))
        .select("doc_id", "text_key", F.size("hashes").alias("n"), F.explode(F.filter("hashes", lambda h: h <= F.lit(top[0] or 0))).alias("h"))
    )
    hits = (
        probes.join(bounded(sketches, top[1]), "h").where(F.col("n") >= F.col("n_needed"))
        .groupBy("item_id", "doc_id", "text_key").agg(F.count("*").alias("sketch_hits"))
    )
    hits = stored(hits, "decontamination-candidates")
    wanted = hits.groupBy("text_key").agg(F.collect_set("item_id").alias("items"))
    n_wanted = wanted.count()
    verified = (
        texts.join(bounded(wanted, n_wanted), "text_key")
        .groupBy("text_key").agg(F.first("text").alias("text"), F.first("items").alias("items"))
        .withColumn("words", word_array("text"))
        .select("text_key", "items", F.explode(F.array_distinct(with_short_shingles(
            F.col("words"), widths, lambda w, i, k: F.array_join(F.slice(w, i + 1, k), " ")))).alias("shingle"))
        .join(bounded(shingles.select("item_id", "shingle", "n_shingles", "n_needed"), shingles.count()), "shingle")
        .where(F.array_contains("items", F.col("item_id")))
        .groupBy("text_key", "item_id", "n_shingles", "n_needed").agg(F.count_distinct("shingle").alias("n_shared"))
        .where(F.col("n_shared") >= F.col("n_needed"))
    )
    return hits.select("item_id", "doc_id", "text_key").join(verified, ["item_id", "text_key"]).select(
        "item_id", "doc_id", "text_key", F.col("n_shared").cast("long").alias("n_shared"), F.col("n_shingles").cast("long").alias("n_shingles"),
        (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def shingle_hashes_of_text(text: str, widths: list[int] | None = None) -> Column:
    """Shingle hashes straight from a text column, those of short widths included."""
    no_word = F.lit(None).cast("string")
    return with_short_shingles(word_array(text), widths or [], lambda w, i, k: F.xxhash64(*[F.get(w, i + j) if j < k else no_word for j in range(SHINGLE)]))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options: object) -> DataFrame:
    """Documents that contain no item, with all their columns."""
    # contamination depends on the text alone
    found = contained_items(picked(docs, text=text_col).withColumn("doc_id", F.lit(0).cast("long")), items, **options)
    keys = stored(found.select(F.col("text_key").alias("_found")).distinct(), "contaminated-texts")
    inner = numbered(docs)
    text = F.xxhash64(f"c{docs.columns.index(text_col)}")
    return inner.join(bounded(keys, keys.count()), text == F.col("_found"), "left_anti").toDF(*docs.columns)
