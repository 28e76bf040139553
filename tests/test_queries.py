"""The page, raster and source queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidemark.plans import driver_queries, page_queries

SF = "/root/testdata/sf0.001"
SMALL = ["q02_fuzzy_lookup", "q03_exact_then_fuzzy", "q15_fuzzy_substring", "q24_header_words", "q29_not_covered", "q32_corrections", "q35_regions"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [*page_queries.QUERIES, *SMALL])
def test_query_against_its_sql(spark, duck, name):
    made = page_queries.QUERIES.get(name) or driver_queries.QUERIES[name]
    frame = made(spark, SF)
    names = sorted(frame.columns)
    found = duck.execute(page_queries.SQL.get(name) or driver_queries.SQL[name])
    order = [c[0] for c in found.description]
    assert sorted(order) == names
    want = [tuple(plain(r[order.index(n)]) for n in names) for r in found.fetchall()]
    got = [tuple(plain(r[n]) for n in names) for r in frame.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_every_status_but_one_stands_in_the_pages():
    assert {s for _, s, *_ in page_queries.OUTCOMES} == {"ok", "unmatched", "partial_weight_detection", "id_matched_no_weight_region", "error"}
