import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.pages import SAMPLE, SAMPLE_SIZE, images_of, mapping_of, words_of
from tidemark.functions.words import edits
from tidemark.operators import identify


def match(spark, pages, sizes, ids):
    got = identify.page_matches(words_of(spark, pages), images_of(spark, sizes), mapping_of(spark, [(i, 1) for i in ids]))
    return {r["image_id"]: (r["id"], r["distance"], r["source"], list(r["word_ords"])) for r in got.collect()}


def test_pages_are_matched_by_precedence(spark):
    fragments = [("30", 90, 100, 100, 140, 140), ("903", 88, 150, 102, 210, 141), ("0", 92, 215, 101, 235, 142), ("935", 85, 240, 103, 300, 143), ("208021", 95, 100, 600, 250, 640)]
    pages = {
        "exact": SAMPLE, "none": [("123123123", 90, 0, 0, 100, 30)], "near": [("307775719", 90, 0, 0, 100, 30)], "unsure": [("307775718", 10, 0, 0, 100, 30)],
        "glyphs": [("3O99526I4", 90, 600, 40, 800, 80)], "place": [("287798368", 78, 600, 60, 800, 100), ("287798369", 95, 100, 500, 250, 520)], "parts": fragments,
        "clean": [("307775718", 95, 0, 0, 100, 30), *fragments], "file": [("307775719", 90, 0, 0, 100, 30)],
    }
    sizes = {k: (1000, 700) for k in pages} | {"exact": SAMPLE_SIZE, "file": (1000, 700, "scan_307479457_1.png"), "parts": (1000, 3000), "clean": (1000, 3000)}
    ids = ["307775718", "307479457", "309952614", "287798368", "287798369", "309030935"]
    got = match(spark, pages, sizes, ids)
    assert got["exact"] == ("307775718", 0, "ocr", [0])
    assert "none" not in got and "unsure" not in got
    assert got["near"] == ("307775718", 1, "ocr_fuzzy", [0])
    assert got["glyphs"] == ("309952614", 0, "ocr_confusion_repair", [0])
    assert got["place"][0] == "287798368"
    assert got["parts"] == ("309030935", 0, "ocr_fragments", [0, 1, 2, 3])
    assert got["clean"][0] == "307775718" and got["clean"][3] == [0]
    assert got["file"][:3] == ("307479457", 0, "filename_exact_sheet_match")


def test_chains_pass_over_what_does_not_fit():
    parts = [("1", 90.0, 0, 0, 10, 20, 0), ("9", 50.0, 15, 200, 25, 220, 1), ("2", 80.0, 20, 1, 30, 21, 2), ("3", 70.0, 400, 0, 410, 20, 3)]
    got = [(t, c, o) for t, c, o, *_ in identify.chains(parts, 20)]
    assert ("12", 80.0, [0, 2]) in got and not any("9" in t and len(t) > 1 for t, _, _ in got)
    assert all(len(t) <= 1 or "3" not in t for t, _, _ in got)


@pytest.mark.parametrize("k", [1, 2])
def test_near_lookup_finds_what_a_nested_loop_finds(spark, k):
    rng = random.Random(k)
    make = lambda: "".join(rng.choice("0123") for _ in range(rng.randrange(0, 7)))
    left, right = [make() for _ in range(120)], [make() for _ in range(120)]
    a = spark.createDataFrame([(n, s) for n, s in enumerate(left)], "n int, s string")
    b = spark.createDataFrame([(n, s) for n, s in enumerate(right)], "m int, t string")
    got = sorted((r["n"], r["m"], r["_distance"]) for r in identify.fuzzy_lookup(a, "s", b, "t", k).collect())
    assert got == sorted((n, m, edits(s, t)) for n, s in enumerate(left) for m, t in enumerate(right) if edits(s, t) <= k)


def test_near_lookup_is_a_hash_join(spark):
    a, b = spark.createDataFrame([(1, "a")], "n int, s string"), spark.createDataFrame([(1, "b")], "m int, t string")
    plan = identify.fuzzy_lookup(a, "s", b, "t", 1)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_header_ids_and_shown_numbers(spark):
    pages = {"p": [("12345678", 60, 600, 20, 800, 60), ("1234567", 90, 100, 100, 200, 120), ("99999999", 99, 600, 600, 800, 640), ("12345678", 70, 600, 30, 800, 90), ("77", 99, 0, 0, 5, 5)]}
    words, images = words_of(spark, pages), images_of(spark, {"p": (1000, 700)})
    got = identify.header_ids(words, images).collect()
    assert [(r["id"], r["source"]) for r in got] == [("12345678", "image_header_ocr")] or got[0]["id"] == "12345678"
    shown = [r["number"] for r in identify.shown_numbers(words).orderBy("place").collect()]
    assert shown[:3] == ["12345678", "1234567", "99999999"] and "77" not in shown


def test_better_analysis(spark):
    df = spark.createDataFrame([("a", 0, None, 2, 2), ("a", 1, 1, 0, 0), ("a", 2, 0, 0, 0), ("b", 0, None, 1, 1), ("b", 1, None, 1, 2), ("c", 0, 0, 1, 1), ("c", 1, 0, 1, 1)], "image_id string, attempt int, distance int, regions int, anchors int")
    got = {r["image_id"]: r["attempt"] for r in identify.better_analysis(df, "image_id").collect()}
    assert got == {"a": 2, "b": 1, "c": 0}


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_edits_is_a_metric(a, b):
    assert edits(a, b) == edits(b, a) and (edits(a, b) == 0) == (a == b) and edits(a, b) <= max(len(a), len(b))


def test_weights_side_by_side_are_no_id(spark):
    pair = lambda t: [(t, 90, 205, 350, 255, 365), (t, 90, 325, 350, 375, 365)]
    # one edit from an id, and the id itself
    pages = {"near": pair("30.01"), "same": pair("300.01"), "pieces": [("3001", 90, 205, 350, 255, 365), ("30002", 90, 260, 350, 310, 365)]}
    got = match(spark, pages, {k: (1000, 1000) for k in pages}, ["300130001", "3000130001", "300130002"])
    assert set(got) == {"pieces"} and got["pieces"][:3] == ("300130002", 0, "ocr_fragments")
