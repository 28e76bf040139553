"""Which of several readings of a page to go on with: passes over parts or enlargements, and quarter turns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import MATCH, MatchConfig
from tidemark.functions import numbers
from tidemark.operators import identify, layout
from tidemark.operators.pages import by_page
from tidemark.session import keep


def analyse(words: DataFrame, images: DataFrame, mapping: DataFrame, config: MatchConfig = MATCH) -> DataFrame:
    """(image_id, distance, regions, anchors): the match of each page, null without one, and how much of its table was read."""
    lengths = identify.id_lengths(mapping)

    def rule(rows: list[dict]) -> list[tuple]:
        sizes, _, page = layout.parts_of(rows)
        if not sizes:
            return []
        width, height = sizes[0]["width"], sizes[0]["height"]
        found = identify.readings(page, identify.chains(identify.fragments_of(page), config.max_chain_length), width, height, lengths, config)
        own = layout.page_words(page)
        heads = layout.find_anchors(own)
        return [(r["image_id"], found, len(layout.find_values(own, heads, height, config)), len(heads)) for r in sizes]

    pages = keep(by_page(layout.page_rows(words, images), rule, f"image_id string, readings {identify.READINGS}, regions int, anchors int", order=layout.PARTS))
    found = identify.matched(pages, images, mapping, lengths, config).select("image_id", "distance")
    return pages.select("image_id", "regions", "anchors").join(found, "image_id", "left").select("image_id", "distance", "regions", "anchors")


def choose_pass(passes: Sequence[DataFrame], images: DataFrame, mapping: DataFrame, turned: Sequence[int] = (), config: MatchConfig = MATCH) -> DataFrame:
    """(image_id, attempt): of each page the pass whose analysis is best, the earliest on ties.

    turned: places of the passes that were read after a quarter turn; only pages that are portrait enough to lie on
    their side have those.
    """
    portrait = images.filter(numbers.try_quarter_turns(F.col("width"), F.col("height")))
    # all passes are analysed at once: a pass's page is a page of its own
    own = lambda df, k: df.withColumn("image_id", F.concat(F.lit(f"{k}:"), F.col("image_id")))
    read = reduce(DataFrame.unionByName, (own(words, k) for k, words in enumerate(passes)))
    pages = reduce(DataFrame.unionByName, (own(portrait if k in turned else images, k) for k in range(len(passes))))
    tried = analyse(read, pages, mapping, config).withColumn("attempt", F.substring_index("image_id", ":", 1).cast("int"))
    return identify.better_analysis(tried.withColumn("image_id", F.expr("substring(image_id, instr(image_id, ':') + 1)")), "image_id").select("image_id", "attempt")


def words_of_best(passes: Sequence[DataFrame], chosen: DataFrame) -> DataFrame:
    """The words of each page's chosen pass."""
    tagged = None
    for k, words in enumerate(passes):
        part = words.withColumn("attempt", F.lit(k))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.join(chosen, ["image_id", "attempt"], "left_semi").drop("attempt")
