"""Pages of words that several tests read."""

from tidemark.model import IMAGES, WORDS

# A label's words as a scan gave them.
SAMPLE = [
    ("307775718", 95.0, 2108, 193, 2486, 245), ("307775718", 91.0, 3498, 297, 3615, 317), ("ACTUAL", 96, 939, 1160, 1119, 1191), ("CHARGED", 95, 1408, 1163, 1624, 1195),
    ("WEIGHT", 94, 1406, 1186, 1565, 1261), ("802.91", 94.0, 937, 1324, 1081, 1358), ("802.91", 96.0, 1407, 1325, 1547, 1358), ("417248.0", 92, 573, 1068, 756, 1100),
]
SAMPLE_SIZE = (4032, 3024)


def words_of(spark, pages):
    rows = [(image, 0, "base", k, t, float(c), (float(x0), float(y0), float(x1), float(y1))) for image, words in pages.items() for k, (t, c, x0, y0, x1, y1) in enumerate(words)]
    return spark.createDataFrame(rows, WORDS)


def images_of(spark, sizes):
    return spark.createDataFrame([(i, f"{i}.jpg" if len(s) < 3 else s[2], s[0], s[1], 1) for i, s in sizes.items()], IMAGES)


def mapping_of(spark, pairs):
    return spark.createDataFrame([(k + 2, i, float(w)) for k, (i, w) in enumerate(pairs)], "row_number int, id string, weight double")
