"""Organic results from saved result pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankloom import lookups as L
from rankloom.functions import urls as U

# Link forms on a result page, in order of trust.
RESULT_PATTERNS = [
    r'(?i)href="/url\?q=(https?://[^&"]+)&',
    r'(?i)href="(https?://[^"]+)"',
    r'(?i)data-url="(https?://[^"]+)"',
    r"(?i)<cite[^>]*>(https?://[^<\s]+)</cite>",
]
_ENGINE = r"(^|\.)(" + "|".join(L.ENGINE_HOSTS) + r")\."


def organic_results(pages: DataFrame) -> DataFrame:
    """``query_id, pos, url`` of the results of each saved page (``query_id, html``), without repeats.

    Hosts of the search engine itself are dropped. A page holds a bounded list of links, so its list is made unique
    inside the row and nothing is shuffled.
    """
    found = F.concat(*[F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in RESULT_PATTERNS])
    decoded = F.transform(found, lambda u: F.substring_index(F.coalesce(F.try_url_decode(u), u), "&", 1))
    kept = F.filter(
        F.transform(decoded, lambda u: F.trim(u)), lambda u: F.startswith(u, F.lit("http")) & ~F.rlike(U.host(u), F.lit(_ENGINE)))
    rows = pages.select("query_id", F.posexplode(F.array_distinct(kept)).alias("pos", "url"))
    return rows.select("query_id", (F.col("pos") + 1).alias("pos"), "url")
