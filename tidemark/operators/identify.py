"""Which known id a page carries: candidates from words, exact and near lookups, and their precedence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import MATCH, MatchConfig
from tidemark.functions import numbers, text
from tidemark.functions import words as W
from tidemark.operators import layout
from tidemark.operators.ordered import keep_first, top_k
from tidemark.operators.pages import by_page
from tidemark.session import keep

CANDIDATES = "image_id string, cand_ord int, text string, confidence double, word_ords array<int>, source string, x0 double, y0 double, x1 double, y1 double"
_NOT_DIGIT = re.compile("[^0-9]")


def chains(fragments: list[tuple[str, float, float, float, float, float, int]], longest: int) -> list[tuple[str, float, list[int], float, float, float, float]]:
    """Every prefix of every greedy chain of digit fragments (digits, confidence, x0, y0, x1, y1, ord).

    From each fragment in turn, from left to right, the chain takes up whatever follows closely enough at
    about the same height, and passes over what doesn't.
    """
    line = sorted(fragments, key=lambda f: f[2])
    out = []
    for i, (digits, sure, x0, y0, x1, y1, place) in enumerate(line):
        ords, reach, height, middle = [place], x1, y1 - y0, (y0 + y1) / 2
        box = [x0, y0, x1, y1]
        out.append((digits, sure, ords, *box))
        for more, sure2, a0, b0, a1, b1, place2 in line[i + 1 :]:
            level = (b0 + b1) / 2
            if not -0.8 * height <= a0 - reach <= 5 * height or abs(level - middle) > 2 * height:
                continue
            if len(digits) >= longest:
                break
            digits, sure, ords = digits + more, min(sure, sure2), [*ords, place2]
            reach, height, middle = max(reach, a1), (height + b1 - b0) / 2, level
            box = [min(box[0], a0), min(box[1], b0), max(box[2], a1), max(box[3], b1)]
            out.append((digits, sure, ords, *box))
    return out


def fragment_candidates(words: DataFrame, config: MatchConfig = MATCH, min_length: int | None = None, min_confidence: float | None = None) -> DataFrame:
    """Numbers put together from neighbouring fragments; one task sees one page's words at a time."""
    low = config.min_id_length if min_length is None else min_length
    sure = config.min_confidence if min_confidence is None else min_confidence

    def rule(page: list[dict]) -> list[tuple]:
        parts = [(r["digits"], r["confidence"], r["x0"], r["y0"], r["x1"], r["y1"], r["word_ord"]) for r in page]
        return [(page[0]["image_id"], k, t, c, o, "ocr_fragments" if len(o) > 1 else "ocr", *box) for k, (t, c, o, *box) in enumerate(chains(parts, config.max_chain_length)) if c >= sure and len(t) >= low]

    flat = words.select("image_id", "word_ord", text.digits(F.col("text")).alias("digits"), "confidence", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    return by_page(flat.filter("digits != ''"), rule, CANDIDATES)


#: Fragments stand behind all single words.
BEHIND = 1 << 20


#: A page's readings that may be ids.
READINGS = "array<struct<cand_ord:int,text:string,confidence:double,score:double,source:string,word_ords:array<int>>>"


def _score(x0: float, y0: float, x1: float, y1: float, width: float | None, height: float | None, median: float) -> float:
    """``numbers.position_score`` of one candidate."""
    if not (width or 0) > 0 or not (height or 0) > 0:
        return 0.0
    mid_x, mid_y = (x0 + x1) / 2, (y0 + y1) / 2
    return (30.0 if mid_y <= height * 0.22 else 12.0 if mid_y <= height * 0.34 else 0.0) + (12.0 if mid_x >= width * 0.38 else 0.0) + (8.0 if y1 - y0 >= median * 1.35 else 0.0)


def fragments_of(page: list[dict]) -> list[tuple[str, float, float, float, float, float, int]]:
    """A page's fragments for chains()."""
    read = ((W.digits(r["text"]), r) for r in page)
    return [(d, r["confidence"], r["x0"], r["y0"], r["x1"], r["y1"], r["word_ord"]) for d, r in read if d]


def readings(page: list[dict], chained: list[tuple], width: float | None, height: float | None, lengths: tuple[int, int], config: MatchConfig = MATCH) -> list[dict]:
    """Candidates for a page's id: single words, then chains of fragments, the best one of each text.

    lengths: of the known ids; what is longer or shorter by more than the edits allowed is near none of them. Weights
    that stand side by side are no id in pieces: chains of nothing but decimals don't count.
    """
    low, high = max(config.min_id_length, lengths[0] - config.fuzzy_distance), lengths[1] + config.fuzzy_distance
    tall = sorted(h for r in page if (h := r["y1"] - r["y0"]) > 0)
    median = tall[len(tall) // 2] if tall else 1.0
    weights = {r["word_ord"] for r in page if W.is_decimal(r["text"])}
    best: dict[str, dict] = {}

    def take(place: int, text: str, sure: float | None, source: str, ords: list[int], *box: float) -> None:
        if sure is None or sure < config.min_confidence or not low <= len(text) <= high:
            return
        score = sure + _score(*box, width, height, median)
        if text not in best or (-score, place) < (-best[text]["score"], best[text]["cand_ord"]):
            best[text] = {"cand_ord": place, "text": text, "confidence": sure, "score": score, "source": source, "word_ords": ords}

    for r in page:
        plain = W.digits(r["text"])
        for k, text in enumerate(W.numeric_variants(r["text"])):
            take(r["word_ord"] * 2 + k, text, r["confidence"], "ocr" if text == plain else "ocr_confusion_repair", [r["word_ord"]], r["x0"], r["y0"], r["x1"], r["y1"])
    for k, (text, sure, ords, *box) in enumerate(chained):
        if len(ords) == 1 or not weights.issuperset(ords):
            take(k + BEHIND, text, sure, "ocr_fragments" if len(ords) > 1 else "ocr", ords, *box)
    return list(best.values())


def header_id(page: list[dict], chained: list[tuple], width: float | None, height: float | None) -> tuple[str | None, str | None]:
    """(id, source) of ``header_ids`` for one page."""
    if height is None:
        return None, None
    seen = [(r["word_ord"], W.digits(r["text"]), r["confidence"], "image_header_ocr", r["x0"], r["y0"], r["x1"], r["y1"]) for r in page]
    seen += [(k + BEHIND, text, sure, "image_header_fragments", *box) for k, (text, sure, _, *box) in enumerate(chained)]
    first: dict[str, int] = {}
    last: dict[str, tuple] = {}
    for place, text, sure, source, x0, y0, x1, y1 in seen:
        if 7 <= len(text) <= 12 and (y0 + y1) / 2 <= height * 0.25:
            first.setdefault(text, place)
            right = width is not None and (x0 + x1) / 2 >= width * 0.38
            score = (sure or 0.0) + (35.0 if right else 0.0) + (20.0 if (y0 + y1) / 2 <= height * 0.16 else 0.0) + (18.0 if 8 <= len(text) <= 10 else 0.0) + min(15.0, y1 - y0)
            last[text] = (-score, first[text], text, source)
    return min(last.values())[2:] if last else (None, None)


#: Lengths that no text has.
NO_LENGTHS = (1 << 20, 0)


def id_lengths(mapping: DataFrame) -> tuple[int, int]:
    """Lengths of the shortest and the longest known id; none fits without ids."""
    low, high = mapping.agg(F.min(F.length("id")), F.max(F.length("id"))).first()
    return (low, high) if low is not None else NO_LENGTHS


def exact_lookup(df: DataFrame, key: str, reference: DataFrame, id_: str) -> DataFrame:
    """Rows of df whose key is a known id, with the reference's columns; small references are broadcast by size."""
    return df.join(reference, df[key] == reference[id_])


def _shorter(s: Column) -> Column:
    """The strings left when one character is deleted."""
    places = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))
    return F.transform(places, lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))


def deletions(c: Column, k: int) -> Column:
    """All strings left when up to k characters are deleted."""
    out = F.array(c)
    for _ in range(k):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, _shorter))))
    return out


def fuzzy_lookup(df: DataFrame, key: str, reference: DataFrame, id_: str, k: int) -> DataFrame:
    """Pairs of df and reference rows whose key and id are within k edits, with _distance.

    Two strings within k edits share a string that is left when up to k characters are deleted from each, so
    equality on those replaces the comparison of all pairs. Distinct keys and ids are paired, then verified
    and joined back: repeated keys cost no more comparisons.
    """
    keys = df.select(F.col(key).alias("_key")).distinct().withColumn("_left", F.explode(deletions(F.col("_key"), k)))
    ids = reference.select(F.col(id_).alias("_id")).distinct().withColumn("_right", F.explode(deletions(F.col("_id"), k)))
    pairs = keys.join(ids, F.col("_left") == F.col("_right")).select("_key", "_id").distinct()
    close = pairs.withColumn("_distance", F.levenshtein("_key", "_id", k)).filter(F.col("_distance").between(0, k))
    return df.join(close, df[key] == F.col("_key")).join(reference, F.col("_id") == reference[id_]).drop("_key", "_id")


def page_matches(words: DataFrame, images: DataFrame, mapping: DataFrame, config: MatchConfig = MATCH) -> DataFrame:
    """One match for each page: exact by its words, else by its file name, else near by its words."""
    lengths = id_lengths(mapping)

    def rule(rows: list[dict]) -> list[tuple]:
        sizes, _, page = layout.parts_of(rows)
        width, height = (sizes[0]["width"], sizes[0]["height"]) if sizes else (None, None)
        return [(rows[0]["image_id"], found)] if (found := readings(page, chains(fragments_of(page), config.max_chain_length), width, height, lengths, config)) else []

    return matched(by_page(layout.page_rows(words, images), rule, f"image_id string, readings {READINGS}", order=layout.PARTS), images, mapping, lengths, config)


def matched(pages: DataFrame, images: DataFrame, mapping: DataFrame, lengths: tuple[int, int], config: MatchConfig = MATCH) -> DataFrame:
    """The matches of pages (image_id, readings)."""
    columns = ["image_id", "id", "distance", "confidence", "score", "source", "word_ords"]
    cands = pages.select("image_id", F.explode("readings").alias("c")).select("image_id", "c.*")
    ids = mapping.select(F.col("id").alias("_known"), F.col("row_number").alias("_row"))
    order = [F.desc("score"), F.asc("cand_ord"), F.asc("_row")]
    page = Window.partitionBy("image_id")
    # a page's known readings stand first; where the first one isn't known, none is
    tried = cands.join(ids, F.col("text") == F.col("_known"), "left")
    tried = keep(tried.withColumn("_rank", F.row_number().over(page.orderBy(F.col("_known").isNull(), *order))).withColumn("_hit", F.max(F.col("_known").isNotNull()).over(page)))
    by_words = tried.filter("_rank = 1 and _hit").select("image_id", F.col("_known").alias("id"), F.lit(0).alias("distance"), "confidence", "score", "source", "word_ords")
    named = keep(filename_matches(images, mapping, lengths).join(by_words.select("image_id"), "image_id", "left_anti"))
    left = tried.filter("not _hit").drop("_known", "_row").join(named.select("image_id"), "image_id", "left_anti")
    near = fuzzy_lookup(left, "text", ids, "_known", config.fuzzy_distance)
    near = near.select("image_id", F.col("_known").alias("id"), F.col("_distance").alias("distance"), "confidence", (F.col("score") - F.col("_distance") * config.distance_penalty).alias("score"), F.lit("ocr_fuzzy").alias("source"), "word_ords", "cand_ord", "_row")
    return by_words.unionByName(named).unionByName(top_k(near, "image_id", order).select(*columns))


def filename_matches(images: DataFrame, mapping: DataFrame, lengths: tuple[int, int] | None = None) -> DataFrame:
    """Known ids among the digit runs of a file name; the longest, first on ties. lengths: of the known ids, where at hand."""
    runs = images.select("image_id", F.posexplode(text.digit_runs(text.file_name(F.col("filename")))).alias("_place", "_run"))
    if lengths:
        runs = runs.filter(F.length("_run").between(*lengths))
    hits = runs.join(mapping.select(F.col("id").alias("_known")), F.col("_run") == F.col("_known"))
    best = top_k(hits, "image_id", [F.desc(F.length("_run")), F.asc("_place")])
    return best.select(
        "image_id", F.col("_known").alias("id"), F.lit(0).alias("distance"), F.lit(100.0).alias("confidence"), F.lit(100.0).alias("score"), F.lit("filename_exact_sheet_match").alias("source"), F.array().cast("array<int>").alias("word_ords")
    )


def header_ids(words: DataFrame, images: DataFrame, config: MatchConfig = MATCH) -> DataFrame:
    """The number that looks most like the page's own id, from its top quarter, whether it is known or not."""
    single = words.select("image_id", F.col("word_ord").alias("cand_ord"), text.digits(F.col("text")).alias("text"), "confidence", F.lit("image_header_ocr").alias("source"), "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    merged = fragment_candidates(words, config, 7, float("-inf")).select("image_id", (F.col("cand_ord") + BEHIND).alias("cand_ord"), "text", "confidence", F.lit("image_header_fragments").alias("source"), "x0", "y0", "x1", "y1")
    both = single.unionByName(merged).filter(F.length("text").between(7, 12)).join(images.select("image_id", "width", "height"), "image_id")
    top = both.withColumn("mx", (F.col("x0") + F.col("x1")) / 2).withColumn("my", (F.col("y0") + F.col("y1")) / 2).filter(F.col("my") <= F.col("height") * 0.25)
    # of equal numbers the last reading counts, at the place of the first
    w = Window.partitionBy("image_id", "text")
    last = top.withColumn("_first", F.min("cand_ord").over(w)).withColumn("_last", F.max("cand_ord").over(w)).filter("cand_ord = _last")
    score = numbers.header_score(F.col("confidence"), F.col("mx"), F.col("my"), F.col("y1") - F.col("y0"), F.length("text"), F.col("width"), F.col("height"))
    best = top_k(last.withColumn("score", score), "image_id", [F.desc("score"), F.asc("_first")])
    return best.select("image_id", F.col("text").alias("id"), "confidence", "score", "source")


def shown_numbers(words: DataFrame, config: MatchConfig = MATCH, singles: int = 15, merged: int = 5) -> DataFrame:
    """Numbers read on a page, for whoever reviews it: the first single ones, then the longest put together."""
    read = words.filter(F.col("confidence") >= config.min_confidence).select("image_id", "word_ord", text.digits(F.col("text")).alias("number"))
    plain = keep_first(read.filter(F.length("number").between(4, 18)), ["image_id", "number"], "word_ord")
    first = plain.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy("word_ord"))).filter(F.col("place") <= singles)
    long = top_k(fragment_candidates(words, config, 6), "image_id", [F.desc(F.length("text")), F.asc("cand_ord")], merged)
    long = long.withColumn("place", F.lit(singles) + F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc(F.length("text")), F.asc("cand_ord"))))
    new = long.select("image_id", F.col("text").alias("number"), "place").join(first.select("image_id", "number"), ["image_id", "number"], "left_anti")
    return first.select("image_id", "number", "place").unionByName(new.select("image_id", "number", "place"))


def better_analysis(df: DataFrame, by: str) -> DataFrame:
    """The better of several analyses of a page: a match, then its distance, regions, anchors; first on ties.

    df: columns ``by``, attempt, distance (null without a match), regions, anchors.
    """
    rank = [F.col("distance").isNull().cast("int").asc(), F.coalesce("distance", F.lit(99)).asc(), F.desc("regions"), F.desc("anchors"), F.asc("attempt")]
    return top_k(df, by, rank)
