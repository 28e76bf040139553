import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers, text, words

TOKENS = [
    "WEIGHT", "WE1GHT(kg)", "WElGHT", "WEGHT", "We|ght", "Freight", "Frelght", "freight weight", "ACTUAL", "CTUAL", "[ACTUAL", "(LxWxH)[ACTUAL", "ACTUAL WEIGHT LONG TOKEN", "CHARGED", "Charger", "chargers", "CHARGEABLE", "CHARGD", "cherged", "Charges", "charge",
    "802.91", "12", "1234567", "12,5", "»N.n", "abcd.e", "", None, " 40.00 ", "3O99526I4", "12.3456", "x.y", "actuals", "weigh", "eight", "1.", "٣٤",
]

PAIRS = [
    (text.header_text, words.header_text), (text.qualifier_text, words.qualifier_text), (text.is_weight_header, words.is_weight_header), (text.is_qualifier, words.is_qualifier), (text.is_actual_token, words.is_actual_token),
    (text.is_charged_token, words.is_charged_token), (text.column_kind, words.column_kind), (text.is_number, words.is_number), (text.is_damaged_number, words.is_damaged_number),
]


def test_columns_and_python_forms_agree(spark):
    df = spark.createDataFrame([(t,) for t in TOKENS], "t string").repartition(1)
    rows = df.select("t", *[c(F.col("t")).alias(f"c{k}") for k, (c, _) in enumerate(PAIRS)]).collect()
    for r in rows:
        for k, (_, plain) in enumerate(PAIRS):
            assert r[f"c{k}"] == plain(r["t"]), (r["t"], plain.__name__)


@pytest.mark.parametrize(("token", "want"), [("WE1GHT(kg)", True), ("WElGHT", True), ("WEGHT", True), ("Freight", False), ("Frelght", False), ("WEIGHT", True)])
def test_headers(token, want):
    assert words.is_weight_header(token) is want


def test_qualifiers():
    assert not words.is_qualifier("Charger") and not words.is_qualifier("chargers") and words.is_qualifier("CTUAL") and words.is_qualifier("chargd")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_numeric_readings(spark):
    read = lambda t: one(spark, text.numeric_variants(F.lit(t)))
    assert read("3O99526I4") == ["3995264", "309952614"]
    assert read("307775718") == ["307775718"] and read("abc") == [] and read("12a") == ["12"] and read("ABCDEFG1") == ["1"]
    assert one(spark, text.digit_runs(F.lit("a1234567b123456789012345c12"))) == ["1234567", "123456789012"]
    assert one(spark, text.number_value(F.lit("12,5"))) == 12.5 and one(spark, text.number_value(F.lit("1e3"))) is None
    assert one(spark, text.safe_id_name(F.lit("a/b c"))) == "a_b_c" and one(spark, text.safe_upload_name(F.lit("é x.png"))) == "__x.png"


@pytest.mark.parametrize(("value", "places", "want"), [(40.0, 2, "40.00"), (170.55, 2, "170.55"), (1.005, 2, "1.00"), (0.25, 1, "0.3"), (8.345, 2, "8.35"), (900.0, 0, "900"), (170.555, 0, "170.56"), (12.5, 0, "12.5"), (None, 2, None)])
def test_weights_are_printed_exactly(spark, value, places, want):
    df = spark.createDataFrame([(value, places)], "v double, p int")
    assert df.select(numbers.format_weight("v", "p").alias("x")).first()["x"] == want


def test_quantile_definitions(spark):
    a = F.array(*[F.lit(x) for x in (10.0, 1.0, 2.0, 3.0)])
    assert one(spark, numbers.upper_median(a)) == 3.0
    assert one(spark, numbers.floor_percentile(a, 0.5)) == 3.0 and one(spark, numbers.floor_percentile(a, 1.0)) == 10.0
    assert one(spark, numbers.floor_percentile(F.array().cast("array<double>"), 0.5)) == 0
    assert [one(spark, numbers.own_decimals(F.lit(x))) for x in (3.0, 3.5, 802.91, 0.125)] == [0, 1, 2, 3]


def test_display_and_raster_limits(spark):
    assert one(spark, numbers.duration_text(F.lit(850))) == "850 ms" and one(spark, numbers.duration_text(F.lit(125_000))) == "2m 05s"
    assert one(spark, numbers.bytes_text(F.lit(2048))) == "2.0 KB" and one(spark, numbers.status_text(F.lit("partial_weight_detection"))) == "Partial Weight Detection"
    assert one(spark, numbers.ocr_scale(F.lit(1000), F.lit(800), F.lit(3.0))) == 3.0 and one(spark, numbers.ocr_scale(F.lit(4000), F.lit(3000), F.lit(5.0))) < 1.21
    assert not one(spark, numbers.try_quarter_turns(F.lit(1600), F.lit(1200))) and one(spark, numbers.try_quarter_turns(F.lit(1200), F.lit(1600)))
    box = F.struct(F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(30.0).alias("x1"), F.lit(40.0).alias("y1"))
    assert tuple(one(spark, numbers.to_page(box, F.lit(2.0), F.lit(100.0), F.lit(50.0)))) == (105.0, 60.0, 115.0, 70.0)
