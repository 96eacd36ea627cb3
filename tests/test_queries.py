"""A part of the registered queries against their SQL, on the data set they are checked at."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check_oracle as CO  # noqa: E402

from rankloom import catalog  # noqa: E402

catalog.load()
SMALL = "/root/testdata/sf0.01"
NAMES = [
    "iss_02_labels_with_duplicates", "iss_14_page_validator", "tec_17_page_audit", "tec_18_inbound_links", "jon_01_broken_links", "jon_10_pagination_breaks",
    "agg_04_technical_summary", "win_05_rank_drops", "set_01_issue_diff", "txt_01_tfidf_keywords", "txt_07_near_duplicates", "gra_02_pagerank", "src_02i_head_links",
    "aud_08_final_score", "cmp_03_trust",
]


@pytest.fixture(scope="module")
def con():
    if not Path(SMALL).exists():
        pytest.skip("no driver tables")
    connection = duckdb.connect()
    for t in CO.TABLES:
        connection.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    message, _, ok = CO.compare(spark, con, SMALL, name)
    assert ok, message


def test_names_are_unique_and_described():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 150
