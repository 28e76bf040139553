"""Images and words of a batch: files by their type, word tables, nested reader output, and the reader's contract."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.config import INTAKE, IntakeConfig
from tidemark.functions import text
from tidemark.model import BBOX
from tidemark.session import ship_package

#: Bytes that image files begin with.
MAGIC = {"jpg": "ffd8ff", "png": "89504e47"}
#: A file's beginning, in which its size stands: Exif data has 64 KB at most, and may be followed by other data.
HEADER_BYTES = 1 << 18


def accepted(path, kinds: tuple[str, ...]):
    return text.extension(path).isin(*kinds)


def image_files(spark: SparkSession, folder: str, config: IntakeConfig = INTAKE) -> DataFrame:
    """(image_id, filename, length, content) of the image files of a folder; the path is the id, so equal names don't collide."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.filter(accepted(F.col("path"), config.image_types)).filter(F.col("length") <= config.max_file_mb * 1024 * 1024)
    return files.select(F.col("path").alias("image_id"), text.safe_upload_name(text.file_name(F.col("path"))).alias("filename"), "length", "content")


def too_many(files: DataFrame, config: IntakeConfig = INTAKE) -> bool:
    return files.limit(config.max_files + 1).count() > config.max_files


def image_size(content: bytes) -> tuple[int | None, int | None, int]:
    """(width, height, orientation) by an image file's header: PNG, or JPEG with its Exif orientation; 1 without one."""
    if content[:4].hex() == MAGIC["png"] and len(content) >= 24:
        return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big"), 1
    width = height = None
    orientation, at = 1, 2
    if content[:3].hex() != MAGIC["jpg"]:
        return None, None, 1
    while at + 4 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        body = content[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            orientation = exif_orientation(body[6:])
        # frame headers; C4, C8 and CC are tables
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            break
        at += 2 + size
    return width, height, orientation


def exif_orientation(tiff: bytes) -> int:
    """The orientation tag (0x0112) of the first directory, from 1 to 8; 1 if it has none."""
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if order is None:
        return 1
    number = lambda lo, n: int.from_bytes(tiff[lo : lo + n], order)
    first = number(4, 4)
    for k in range(number(first, 2)):
        entry = first + 2 + 12 * k
        if number(entry, 2) == 0x0112:
            value = number(entry + 8, 2)
            return value if 1 <= value <= 8 else 1
    return 1


@F.pandas_udf(StructType([StructField(n, IntegerType()) for n in ("width", "height", "orientation")]))
def header_sizes(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([image_size(bytes(c)) if c is not None else (None, None, 1) for c in content], columns=["width", "height", "orientation"]).astype({"width": "Int32", "height": "Int32", "orientation": "Int32"})


def image_meta(files: DataFrame) -> DataFrame:
    """images of files, by their headers, sides swapped for quarter turns; without a readable header the sizes are null (see ``with_sizes``)."""
    ship_package(files.sparkSession)
    return with_sizes(files, files.select("image_id", header_sizes(F.substring("content", 1, HEADER_BYTES)).alias("m")).select("image_id", "m.*"))


def with_sizes(images: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sizes and orientations from a table (image_id, width, height, orientation), sides swapped for quarter turns."""
    known = images.select("image_id", "filename").join(sizes, "image_id", "left")
    turned = F.coalesce(F.col("orientation"), F.lit(1)) >= 5
    return known.select("image_id", "filename", F.when(turned, F.col("height")).otherwise(F.col("width")).alias("width"), F.when(turned, F.col("width")).otherwise(F.col("height")).alias("height"), F.coalesce("orientation", F.lit(1)).alias("orientation"))


def flatten_blocks(pages: DataFrame) -> DataFrame:
    """Words of nested reader output (image_id, blocks: array of paragraphs of lines of words), in reading order."""
    blocks = pages.select("image_id", F.posexplode("blocks").alias("b", "block"))
    paragraphs = blocks.select("image_id", "b", F.posexplode("block.paragraphs").alias("p", "paragraph"))
    lines = paragraphs.select("image_id", "b", "p", F.posexplode("paragraph.lines").alias("l", "line"))
    words = lines.select("image_id", "b", "p", "l", F.posexplode("line.words").alias("w", "word"))
    numbered = words.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("b", "p", "l", "w", "word"))).alias("all"))
    return numbered.select("image_id", F.posexplode("all").alias("word_ord", "x")).select(
        "image_id", F.lit(0).alias("rotation"), F.lit("base").alias("pass"), "word_ord", "x.word.text", F.col("x.word.confidence").cast("double").alias("confidence"), F.col("x.word.bbox").cast(BBOX).alias("bbox")
    )


Reader = Callable[[bytes], list[tuple[str, float, float, float, float, float]]]


def read_words(files: DataFrame, make_reader: Callable[[], Reader], name: str = "base") -> DataFrame:
    """Words of image files by a reader: bytes to (text, confidence, x0, y0, x1, y1) in reading order.

    make_reader is called once for each task, so an engine's model is loaded once. A file that the reader
    can't read gives no words, which later counts as unmatched.
    """

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make_reader()
        for page in pages:
            rows = []
            for image, content in zip(page["image_id"], page["content"]):
                try:
                    words = reader(bytes(content))
                except Exception:  # noqa: BLE001  one bad file never fails the batch
                    words = []
                rows += [(image, 0, name, k, t, float(c), {"x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)}) for k, (t, c, x0, y0, x1, y1) in enumerate(words)]
            yield pd.DataFrame(rows, columns=["image_id", "rotation", "pass", "word_ord", "text", "confidence", "bbox"])

    ship_package(files.sparkSession)
    return files.select("image_id", "content").mapInPandas(run, f"image_id string, rotation int, pass string, word_ord int, text string, confidence double, bbox {BBOX}")


def merge_passes(passes: list[DataFrame]) -> DataFrame:
    """Words of several passes over the same pages; of words equal in text and rounded box the earlier pass's stays."""
    from tidemark.operators.ordered import half_up, union_first

    keys = [F.col("image_id"), F.col("text"), *[half_up(F.col(f"bbox.{n}")) for n in ("x0", "y0", "x1", "y1")]]
    tagged = [p.withColumn("_place", F.lit(k) * (1 << 20) + F.col("word_ord")) for k, p in enumerate(passes)]
    merged = union_first(tagged, keys, "_place")
    return merged.withColumn("word_ord", F.col("_place").cast("int")).drop("_place")
