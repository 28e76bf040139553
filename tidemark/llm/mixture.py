"""Mixing of sources to target weights by capped water-filling.

Each source has a weight. The mix wants ``budget`` times the corpus' words, shared by weight; a source can
give at most ``max_epochs`` times its own words. Sources over that limit are clamped and the excess goes to
the others by weight, again and again, until no target is above its limit. A source's target is then taken
as whole repetitions of all its documents, plus a fractional one: documents in a seeded order until the
target's rest is used up, the last one in part.

Only DataFrame operations run here. A source's rows are never gathered in one task: the seeded order is
walked by sums over 4096 hash ranges, then over 4096 sub-ranges of the one range in which the rest ends.
The sub-range left, 1/16,777,216 of a source, is ordered by a window, rows equal in id and size as one.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of its own, after
all others; repeated rows each count and each have a place in the order; ties in the seeded order go by doc_id (null
first), then size; a very long text is counted in place, by one pass of a regular expression; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

BLANKS = "[\\x20\\x09-\\x0D]"
WORDS = "[^\\x20\\x09-\\x0D]+"
RANGES = 4096


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters; null counts as empty.

    Each run with the blanks after it becomes one character, so no array of words is built.
    """
    body = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANKS}++", "")
    return F.length(F.regexp_replace(body, f"[^\\x20\\x09-\\x0D]++{BLANKS}*+", "x")).cast("long")


def rank_sources(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Give the sources, by code point and null last, the weights in turn.

    Ranks come from a range sort and the counts of its partitions, so no task holds all sources.
    """
    keyed = sizes.withColumn("_nul", F.col("source").isNull().cast("int")).withColumn("_bin", F.col("source").cast("binary"))
    ranged = cut(keyed.repartitionByRange("_nul", "_bin").sortWithinPartitions("_nul", "_bin").withColumn("_id", F.monotonically_increasing_id()))
    parted = ranged.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each partition of the sort
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.pmod(F.col("_before") + F.col("_row"), F.lit(len(weights))).cast("int")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    return parted.join(before, "_part").select("source", "source_size", F.element_at(listed, place + 1).alias("weight"))


def fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Targets of (source, source_size, weight): clamp what is over its limit, reshare, until none is.

    The loop moves two sums per round to the driver, no rows. Every round clamps a source or ends.
    """
    sources = cut(sources)
    limit = F.col("source_size") * F.lit(float(max_epochs))
    want = float(sources.agg(F.sum("source_size")).first()[0] or 0) * budget
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.lit(level[0]) * F.col("weight") / F.lit(level[1]) > limit
        used, rest, n = sources.agg(
            F.sum(F.when(over, limit)).alias("used"), F.sum(F.when(~over, F.col("weight"))).alias("rest"), F.count(F.when(over, 1)).alias("n")
        ).first()
        if n == clamped or not rest:
            break
        level, clamped = (want - float(used or 0), float(rest)), n
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    share = F.lit(level[0]) * F.col("weight") / F.lit(level[1])
    return sources.withColumn("target", F.when(share > limit, limit).otherwise(share))


def seeded(seed: int, n_hex: int, start: int = 1) -> Column:
    """Hexadecimal digits of a seeded digest of the document's id and size, as a number."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    return F.conv(F.substring(digest, start, n_hex), 16, 10).cast("long")


def boundary(sums: DataFrame, by: list[str], bucket: str, need: Column) -> DataFrame:
    """Of each group the bucket in which the running sum first reaches need, and the sum before it."""
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("_run", F.sum("_sum").over(w))
    hit = run.filter(F.col("_run") >= need)
    return hit.groupBy(*by).agg(F.min(F.struct(F.col(bucket), (F.col("_run") - F.col("_sum")).alias("_prior"))).alias("_hit"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 17, also: Sequence[str] = ()) -> DataFrame:
    """Each document's part of the mix: doc_id, source, size, source_size, target, taken, repeats, and the columns in also, by which ties go last."""
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *also)
    base = cut(base.withColumn("_r1", seeded(seed, 3)).withColumn("_r2", seeded(seed, 3, 4)).withColumn("_r3", seeded(seed, 8, 7)))
    sums = cut(base.groupBy("source", "_r1").agg(F.sum("size").alias("_sum")))
    sources = sums.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    targets = fill(rank_sources(sources, weights), budget, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("_whole", ratio.cast("long"))
    targets = cut(targets.withColumn("_need", F.floor(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long")).withColumnRenamed("source", "_s"))

    def known(frame: DataFrame) -> DataFrame:
        return frame.join(targets, F.col("source").eqNullSafe(F.col("_s")))

    first = boundary(known(sums).filter(F.col("_need") > 0), ["source"], "_r1", F.col("_need"))
    first = cut(first.select(F.col("source").alias("_s1"), F.col("_hit._r1").alias("_b1"), F.col("_hit._prior").alias("_p1")))
    inner = base.join(first, F.col("source").eqNullSafe(F.col("_s1")) & (F.col("_r1") == F.col("_b1")))
    inner_sums = inner.groupBy("source", "_p1", "_r2").agg(F.sum("size").alias("_sum"))
    second = boundary(known(inner_sums), ["source", "_p1"], "_r2", F.col("_need") - F.col("_p1"))
    second = second.select(F.col("source").alias("_s2"), F.col("_hit._r2").alias("_b2"), (F.col("_p1") + F.col("_hit._prior")).alias("_p2"))
    edges = cut(targets.join(first, F.col("_s").eqNullSafe(F.col("_s1")), "left").join(second, F.col("_s").eqNullSafe(F.col("_s2")), "left")
                .select("_s", "source_size", "target", "_whole", "_need", "_b1", "_b2", "_p2"))
    all_ = base.join(edges, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    at = F.when(F.col("_need") <= 0, F.lit(1)).when(F.col("_r1") != F.col("_b1"), F.sign(F.col("_r1") - F.col("_b1"))).otherwise(F.sign(F.col("_r2") - F.col("_b2"))).cast("int")
    all_ = all_.withColumn("_at", at)
    clear = all_.filter(F.col("_at") != 0).withColumn("_part", F.when(F.col("_at") < 0, F.col("size")).otherwise(F.lit(0)))
    # rows equal in all that orders them are one row with a count until their shares are known
    given = ["source_size", "target", "_whole", "_need", "_p2"]
    last = all_.filter(F.col("_at") == 0).groupBy("source", "_r3", "doc_id", "size", *also, *given).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("source").orderBy("_r3", "doc_id", "size", *also).rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("_left", F.col("_need") - F.col("_p2") - F.sum(F.col("_n") * F.col("size")).over(w) + F.col("_n") * F.col("size"))
    last = last.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    last = last.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.col("_k") * F.col("size"))))
    wanted = ["doc_id", "source", "size", "source_size", "target", "_whole", "_part", *also]
    both = clear.select(*wanted).unionByName(last.select(*wanted))
    taken = (F.col("_whole") * F.col("size") + F.col("_part")).cast("long")
    repeats = F.when(F.col("size") > 0, taken / F.col("size")).otherwise(F.lit(0.0))
    return both.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"), repeats.alias("repeats"), *also)


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix, for DuckDB: the order by (digest, doc_id, size) is walked by one window.
OP4_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (SELECT source, source_size, ([3.0, 1.0, 2.0])[1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS weight FROM src),
level AS (
  SELECT *, 2.0::DOUBLE * source_size AS lim,
    coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0)::DOUBLE AS used,
    (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS rest,
    1.5::DOUBLE * sum(source_size) OVER () AS want
  FROM ranked WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cutoff AS (SELECT (want - used) AS num, rest AS den FROM level WHERE (want - used) * weight / rest <= lim ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN num * weight / den > lim THEN lim ELSE num * weight / den END AS target FROM level, cutoff),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
docs AS (
  SELECT b.doc_id, b.size, p.source_size, p.target, p.whole, floor(p.target - p.whole * p.source_size)::BIGINT AS need,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY substr(md5('17|' || coalesce(b.doc_id::VARCHAR, '') || '|' || b.size::VARCHAR), 1, 14), b.doc_id NULLS FIRST, b.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM base b JOIN parts p ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target::DOUBLE AS target,
  (whole * size + greatest(0, least(size, need - run + size)))::BIGINT AS taken FROM docs
"""
