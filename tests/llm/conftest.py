import pytest


@pytest.fixture
def docs(spark):
    def make(rows, extra=False):
        """A documents frame of (doc_id, text[, source]) rows; extra: columns whose names operators use inside."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            from pyspark.sql import functions as F

            for name in ("key", "score", "size", "y", "n", "cid", "rank", "host"):
                frame = frame.withColumn(name, F.lit("x"))
        return frame

    return make


#: Null, empty, blank and very long texts, repeated rows and a null id.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word " * 60_000), (5, "repeated row of a text"), (5, "repeated row of a text"), (None, "a text without an id"), (7, "ünïcödé 文字 ؟")]


@pytest.fixture
def odd():
    return list(ODD)
