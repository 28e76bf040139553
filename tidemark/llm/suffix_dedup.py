"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts somewhere else. Equal strings get
equal ranks; the rank of a longer string comes from the pair of ranks at its place and at an offset from it.
Ranks are 64-bit names (as Karp, Miller and Rosenberg name substrings), so they compare across the corpus
without an order of all its positions, and what Spark sorts and groups is always a pair of them.

1. Within each text ranks double from 1 byte on. Of every LENGTH-byte string the leftmost position with the
   smallest rank of ``SEED`` bytes stands for it: equal strings pick the same place, so a string can only repeat
   if its sample's rank does. The consecutive strings that share a sample are a cell, about one in 60 bytes.
   Spark ranks the samples; cells whose sample is unique leave.
2. Cells: the pair (rank of the sample, rank of all the cell's bytes). If it repeats, all strings of the cell
   repeat, and nothing more has to be known of them. One cell stands for each different content from here on.
3. Cells whose sample also stands in other surroundings are looked at in blocks of 16 strings, then 4, then 1,
   at the same offsets from the sample in all texts. Of each block two pairs are ranked: that of its core, the
   bytes which all its strings have in common (185, 197, then 200), and that of all its bytes. A block with a
   unique core has no string that repeats and leaves. A block that repeats as a whole is done. Only the others
   are cut into smaller blocks. Every step is one count of pairs, combined before the shuffle, whatever the
   number of places that share a sample, so no sample's cells ever have to meet.

Two different strings with the same sample are taken for equal with probability about 2**-128 (the pair), two
different texts for equal with about 2**-64.

Defined results: null and empty texts, and texts under LENGTH bytes, lose nothing; overlaps within one text
count as repeats; equal texts repeat each other and have the same result, which is kept once; a null doc_id is
an id like others; an empty table gives an empty result; other columns are ignored, whatever their names.
Strings never run across texts. A very long text is read in parts of ``PIECE`` bytes that overlap by a string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, fresh_names, hidden, lean, prepare, release
from tidemark.llm.textvec import Block, U, blocks, column_bytes, mix, odd_numbers

LENGTH, SEED = 200, 64
BLOCK, PIECE = 1 << 17, 1 << 20
#: Strings of a block, step by step; a third of LENGTH at most, so that two ranks cover a block and lie in its core.
WIDTHS = (16, 4, 1)
#: A cell has fewer strings than LENGTH.
STRING_BITS = 12
_FIRST = odd_numbers(256, 77)


def double(names: np.ndarray, step: int) -> np.ndarray:
    """Ranks of h + step bytes from ranks of h bytes, step at most h: of the pairs at i and i + step."""
    if len(names) <= step:
        return np.zeros(0, U)
    x = names[step:] ^ (names[step:] >> U(29))
    x *= U(0xD6E8FEB86659FD93)
    x += names[:-step] * U(0x9FB21C651E98DF25)
    x ^= x >> U(32)
    x *= U(0xE7037ED1A0B428DB)
    return x


def ranks(names: np.ndarray, have: int, want: int) -> np.ndarray:
    """Ranks of ``want`` bytes, by doubling ranks of ``have`` bytes."""
    while have < want:
        step = min(have, want - have)
        names = double(names, step)
        have += step
    return names


def smallest(names: np.ndarray, width: int) -> np.ndarray:
    """For each window of width ranks the place of the smallest one, leftmost on ties; windows double too."""
    bits = U(24)
    low = (names >> bits << bits) | np.arange(len(names), dtype=U)
    have = 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return (low & ((U(1) << bits) - U(1))).astype(np.int64)


def parts_of(block: Block, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, offsets, first byte in its text, bytes): a block of whole texts, or parts of one long text.

    A part has every string that starts in it, so parts overlap by length - 1 bytes.
    """
    if block.n == 1 and len(block.data) > PIECE:
        for lo in range(0, len(block.data) - length + 1, PIECE):
            data = block.data[lo : lo + PIECE + length - 1]
            yield np.zeros(1, np.int64), np.array([0, len(data)]), np.array([lo]), data
    elif len(block.data) >= length:
        yield np.arange(block.n), block.off, np.zeros(block.n, np.int64), block.data


def samples_of(data: np.ndarray, off: np.ndarray, length: int, seed: int):
    """(SEED ranks, strings that lie within one text, their texts, their samples)."""
    names = ranks(_FIRST[data], 1, seed)
    sample = smallest(names, length - seed + 1)
    sizes = np.diff(off)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(sample)]
    at = np.flatnonzero(np.arange(length, length + len(sample)) <= off[owner + 1])
    return names, at, owner[at], sample[at]


def cells_of(data: np.ndarray, off: np.ndarray, length: int, seed: int, contents: bool = True):
    """(text, first string, strings, rank of sample, rank of content) of the cells of some texts."""
    names, at, owner, sample = samples_of(data, off, length, seed)
    head = np.flatnonzero(np.concatenate([[True], (sample[1:] != sample[:-1]) | (owner[1:] != owner[:-1])])) if len(at) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(at)))
    first, rank = at[head], names[sample[head]]
    if not contents:
        return None, None, count, rank, None
    strings = ranks(names, seed, length)
    # a cell has fewer strings than a string has bytes, so its first and last string cover it
    content = mix(mix(strings[first]) + strings[first + count - 1] * U(3) + count.astype(U) * U(0x9E3779B97F4A7C15))
    return owner[head], first, count, rank, content


def text_key() -> Column:
    """Name of a text; equal texts have equal results."""
    return F.xxhash64("text").alias("key")


def seed_ranks(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """Ranks of all cells' samples, with their number in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cells_of(data, off, length, seed, contents=False)[3] for block in blocks(batch.column(0), BLOCK) for _, off, _, data in parts_of(block, length)]
            rank, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, U), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64)), pa.array(n, pa.int64())], ["seed_rank", "n"])

    return docs.select("text").mapInArrow(lean(run), "seed_rank long, n long")


def cells(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(seed_rank, content, key, start, strings) of all cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            out = []
            for block in blocks(batch.column(1), BLOCK):
                for texts, off, base, data in parts_of(block, length):
                    owner, first, count, rank, content = cells_of(data, off, length, seed)
                    out.append((rank.view(np.int64), content.view(np.int64), key[texts[owner] + block.first], first - off[owner] + base[owner], count))
            if out:
                rank, content, keys, start, count = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(content), pa.array(keys), pa.array(start, pa.int32()), pa.array(count, pa.int16())], ["seed_rank", "content", "key", "start", "strings"])

    return docs.select(text_key(), "text").mapInArrow(lean(run), "seed_rank long, content long, key long, start int, strings short")


def bodies(docs: DataFrame, wanted: DataFrame, length: int, seed: int) -> DataFrame:
    """Each cell of wanted (key, cells: array of (start, strings)) with its bytes: key, at, lead, body.

    lead: the sample's place, from the cell's first string on.
    """
    texts = docs.select(text_key(), "text").dropDuplicates(["key"]).join(wanted, "key").select("key", "text", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column(1))
            lists = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            inner = lists.flatten()
            start, count = inner.field(0).to_numpy().astype(np.int64), inner.field(1).to_numpy().astype(np.int64)
            size = count + length - 1
            step = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), PIECE))
            for lo, hi in zip(step, [*step[1:], len(row)]):
                if lo == hi:
                    continue
                ends = np.cumsum(size[lo:hi])
                first = ends - size[lo:hi]
                flat = data[np.arange(ends[-1]) + np.repeat(off[row[lo:hi]] + start[lo:hi] - first, size[lo:hi])]
                lead = smallest(ranks(_FIRST[flat], 1, seed), length - seed + 1)[first] - first
                body = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[lo:hi])), pa.array(start[lo:hi], pa.int32()), pa.array(lead, pa.int32()), body], ["key", "at", "lead", "body"])

    return texts.mapInArrow(lean(run), "key long, at int, lead int, body binary")


PAIR = ["core", "core_next", "all", "all_next"]


def rank_pairs(cells: DataFrame, todo: DataFrame, width: int, length: int) -> DataFrame:
    """Rank pairs of all blocks of width strings in todo (key, at, first, strings, open), at one offset from their samples.

    (core, core_next): of the bytes that all strings of a whole block share; (all, all_next): of the block's own bytes.
    """
    half = (length + WIDTHS[0]) // 2 if 3 * WIDTHS[0] <= length + 3 else (length + width) // 2
    jobs = todo.groupBy("key", "at").agg(F.collect_list(F.struct("first", "strings", "open")).alias("blocks"))
    rows = cells.join(jobs, ["key", "at"]).select("key", "at", "lead", "body", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column(3))
            names = ranks(_FIRST[data], 1, half)
            lists = batch.column(4)
            job = lists.flatten()
            cell = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at, sample = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(np.int64)
            first, n = job.field(0).to_numpy().astype(np.int64) - at[cell], job.field(1).to_numpy().astype(np.int64)
            # the strings of all jobs, by their offset from the sample
            own = np.repeat(np.arange(len(cell)), n)
            place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + first[own]
            step = (sample[cell[own]] - place) // width
            head = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (step[1:] != step[:-1])])) if len(own) else np.zeros(0, np.int64)
            count, own, place, step = np.diff(np.append(head, len(own))), own[head], place[head], step[head]
            base = off[cell[own]]
            core = base + sample[cell[own]] - step * width
            whole = base + place
            kind = step.astype(U) * U(0x9E3779B97F4A7C15)
            shape = (sample[cell[own]] - place).astype(U) * U(0x9E3779B97F4A7C15) + count.astype(U)
            pairs = [mix(names[core] + kind), names[core + length + 1 - width - half], mix(names[whole] + shape), names[whole + count + length - 1 - half]]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(p.view(np.int64)) for p in pairs), batch.column(0).take(pa.array(cell[own])), batch.column(1).take(pa.array(cell[own])), pa.array(place + at[cell[own]], pa.int32()), pa.array(count, pa.int32()), job.field(2).take(pa.array(own))],
                [*PAIR, "key", "at", "first", "strings", "open"],
            )

    return rows.mapInArrow(lean(run), ", ".join(f"{p} long" for p in PAIR) + ", key long, at int, first int, strings int, open boolean")


def refine(cells: DataFrame, todo: DataFrame, length: int) -> DataFrame:
    """(key, start, strings): the strings of open blocks that stand elsewhere too, step by step of WIDTHS."""
    widths = [w for w in WIDTHS if w == 1 or 3 * w <= length + 3]
    found = None
    for width in widths:
        rows = cut(rank_pairs(cells, todo, width, length))
        one = F.min(F.struct("key", "at", "first", "strings", "open")).alias("one")
        groups = cut(rows.groupBy(*PAIR).agg(F.count("*").alias("n"), one))
        again = groups.filter("n > 1").select(*PAIR)
        part = cut(rows.filter("open").join(again, PAIR, "left_semi").select("key", F.col("first").alias("start"), "strings"))
        found = part if found is None else found.union(part)
        if width > 1:
            # of cores in several surroundings one block of each goes on, if any of them is still open
            fresh = (F.col("n") == 1) & F.col("one.open")
            kinds = groups.groupBy("core", "core_next").agg(F.count("*").alias("kinds"), F.max(fresh).alias("asked")).filter("kinds > 1 and asked")
            todo = cut(groups.join(kinds, ["core", "core_next"], "left_semi").select("one.key", "one.at", "one.first", "one.strings", fresh.alias("open")))
        del rows, groups, again
        release(cells.sparkSession)
    return found


def as_number(start: Column, strings: Column) -> Column:
    return F.shiftleft(start.cast("long"), STRING_BITS) + strings


def repeated(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(key, spans: array of (start, strings)): where strings start that also start elsewhere, by text."""
    if not seed <= length < 1 << STRING_BITS:
        raise ValueError(f"length must be from {seed} to {(1 << STRING_BITS) - 1}")
    spark = docs.sparkSession
    again = cut(seed_ranks(docs, length, seed).groupBy("seed_rank").agg(F.sum("n").alias("n")).filter("n > 1").select("seed_rank"))
    alive = cut(cells(docs, length, seed).join(again, "seed_rank"))
    del again
    release(spark)
    contents = cut(alive.groupBy("seed_rank", "content").agg(F.count("*").alias("n"), F.min(F.struct("key", "start", "strings")).alias("one")))
    # all cells of a text but those whose content stands once; of these contents the one cell is known.
    # A cell as one number, as sets of numbers are compared by hash; copies of a text add nothing to its set
    single = contents.filter("n = 1").groupBy(F.col("one.key").alias("key")).agg(F.collect_list(as_number(F.col("one.start"), F.col("one.strings"))).alias("single"))
    spans = alive.groupBy("key").agg(F.collect_set(as_number(F.col("start"), F.col("strings"))).alias("spans")).join(single, "key", "left")
    spans = spans.select("key", F.when(F.col("single").isNull(), F.col("spans")).otherwise(F.array_except("spans", "single")).alias("spans"))
    back = F.transform("spans", lambda n: F.struct(F.shiftright(n, STRING_BITS).cast("int").alias("start"), n.bitwiseAND(F.lit((1 << STRING_BITS) - 1)).cast("int").alias("strings")))
    spans = cut(spans.select("key", back.alias("spans")))
    del alive
    release(spark)
    # samples in several surroundings, of which one stands once
    kinds = contents.groupBy("seed_rank").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
    todo = cut(contents.join(kinds, "seed_rank", "left_semi").select("one.key", F.col("one.start").alias("at"), F.col("one.start").alias("first"), F.col("one.strings").cast("int").alias("strings"), (F.col("n") == 1).alias("open")))
    del contents, kinds
    release(spark)
    wanted = todo.groupBy("key").agg(F.collect_list(F.struct(F.col("at").alias("start"), "strings")).alias("cells"))
    bytes_of = cut(bodies(docs, wanted, length, seed))
    release(spark)
    more = refine(bytes_of, todo, length).groupBy("key").agg(F.collect_list(F.struct("start", "strings")).alias("spans"))
    return spans.union(more)


MADE = ["n_bytes", "n_removed", "n_spans", "sha256"]


def remove(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> tuple[DataFrame, list[str]]:
    """docs with text reduced to what stays, and four more columns, whose names the list gives: MADE, made unlike those of docs.

    Bytes of a character that a cut splits are left out of text; the digest is of all bytes that stay.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    made = fresh_names(names, MADE)
    spans = repeated(docs.select("text"), length, seed)
    inner = hidden(docs)
    spans = spans.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    at = names.index("text")
    joined = inner.withColumn("key", F.xxhash64(F.col(f"c{at}"))).join(spans, "key", "left").select(*inner.columns, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            data, off = column_bytes(column)
            lists = batch.column(len(names))
            inner = lists.flatten()
            start, count = inner.field(0).to_numpy(zero_copy_only=False), inner.field(1).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            texts, removed, runs_, digests = column.to_pylist() if lists.null_count < batch.num_rows else column, [], [], []
            for k in range(batch.num_rows):
                text = data[off[k] : off[k + 1]]
                s = start[ends[k] : ends[k + 1]].astype(np.int64)
                if len(s):
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + count[ends[k] : ends[k + 1]] + length - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    runs_.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    removed.append(int(gone.sum()))
                    text = text[~gone]
                    texts[k] = text.tobytes().decode("utf-8", "ignore")
                else:
                    runs_.append(0)
                    removed.append(0)
                digests.append(hashlib.sha256(text.tobytes()).hexdigest())
            columns = batch.columns[: len(names)]
            columns[at] = texts if texts is column else pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(off), pa.int64()), pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()), pa.array(digests, pa.string())], [*names, *made])

    kinds = dict(zip(made, (T.LongType(), T.LongType(), T.LongType(), T.StringType())))
    return joined.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in kinds.items())])), made


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, made = remove(docs)
    return out.select("doc_id", *(F.col(m).alias(n) for m, n in zip(made, ("n_bytes", "n_removed", "n_spans", "kept_sha256"))))


def strip_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """The documents without their repeated bytes, with their own columns; those left without text go."""
    out, made = remove(docs, length, seed)
    return out.filter((F.col(made[1]) == 0) | (F.length(F.trim("text")) > 0)).select(*docs.columns)


#: The same by brute force, for DuckDB: all strings of 200 bytes, their digests counted.
OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 400)) AS w FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d)),
rep AS (SELECT w FROM win GROUP BY w HAVING count(*) > 1),
starts AS (SELECT rid, i FROM win WHERE w IN (SELECT w FROM rep)),
marked AS (SELECT rid, i, CASE WHEN i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 1 ELSE 0 END AS fresh FROM starts),
numbered AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS span FROM marked),
spans AS (SELECT rid, min(i) AS s, max(i) + 200 AS e FROM numbered GROUP BY rid, span),
edges AS (SELECT rid, s, e, lag(e, 1, 0) OVER (PARTITION BY rid ORDER BY s) AS before FROM spans),
cut AS (SELECT rid, sum(e - s)::BIGINT AS removed, count(*) AS n, max(e) AS last FROM edges GROUP BY rid),
pieces AS (SELECT e.rid, string_agg(substr(d.h, 2 * e.before + 1, 2 * (e.s - e.before)), '' ORDER BY e.s) AS kept FROM edges e JOIN d ON e.rid = d.rid GROUP BY e.rid)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(c.removed, 0)::BIGINT AS n_removed, coalesce(c.n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN c.rid IS NULL THEN d.h ELSE p.kept || substr(d.h, 2 * c.last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut c ON d.rid = c.rid LEFT JOIN pieces p ON d.rid = p.rid
"""
