"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Sets. Each text becomes the set of its distinct shingles of ``WIDTH`` words and a signature of ``VALUES``
   minimum hashes. Texts with equal sets make one class, which is all that goes on; copies cost one row each.
2. Forest. A tree reads the signature from its own place on; classes that share its first ``DEPTH`` values are a
   region. Classes alone in their region drop out by a count before signatures move.
3. Neighbours. Each tree is one sorted order of the signatures, in which the longest common prefixes stand side
   by side, as deep as a region needs. Each class meets the ``REACH`` before it in every order; the most alike
   of all is confirmed on the full sets. Connected components follow. This costs a sort, whatever a region's
   size, and puts a group of near copies into a few components.
4. The rest, with nothing left out. A region goes on only if several components meet in it, and only classes of
   different components are compared. Regions are dealt into blocks: a component with over ``CROWD`` classes has
   blocks of its own, which meet all blocks but its own; the others share blocks, which meet all. So no task
   holds a region, at any size of it, and N classes of one component beside k others cost N * k comparisons and
   k / CROWD copies of the N rows, not N * N. Classes that have a candidate (signatures that agree in ``AGREE``
   or more) go once more through it with their texts, and candidates are confirmed on the full sets where they
   stand. Within a task, a pair whose components are joined already is passed over, so a task emits fewer links
   than it has components.

A pair with Jaccard 0.8 is missed by the signatures with probability under 0.0005, and by ten trees with
probability under 0.0001, in a region of any size. Many classes that are alike but not linked (say, a family
with similarities of 0.7 throughout) are the costly case: they are compared with each other in step 4.

Defined results: null and empty texts have no shingles, are linked with nothing and are their own component;
a text with fewer words than WIDTH is one shingle of all its words; equal rows share a component; a null
doc_id never becomes a component's id unless the component has no other; repeated doc_ids have all their rows
in the result; ties between neighbours go to the larger class name; an empty table gives an empty result; other
columns are ignored, whatever their names. Very long texts make blocks of their own by their number of shingles
(``LOAD``), so that the sets that a task holds are bounded by that or by two sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, hidden, lean, prepare
from tidemark.llm.graph import connected_components
from tidemark.llm.textvec import LOWER, NOT_BLANK, U, blocks, mix, odd_numbers, shingles, unique_by_text, whole

WIDTH, PERCENT = 4, 80
VALUES, TREES, DEPTH, REACH = 128, 10, 2, 16
#: Classes and shingles of a block.
CROWD, LOAD = 1024, 2_000_000
AGREE = 0.68
ROWS_PER_PARTITION = 40_000
BROADCAST_IDS, CONFIRMED_AT_ONCE = 1_000_000, 64


def shingle_sets(block, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle) pairs of a block, by text and shingle."""
    w = block.words(NOT_BLANK, LOWER[block.data])
    h = w.hashes()
    inside = whole(w, width)
    doc, values = w.doc[: len(inside)][inside], shingles(h, width)[inside]
    short = np.flatnonzero((w.count > 0) & (w.count < width))
    if len(short):
        own = [shingles(h[w.first[d] : w.first[d + 1]], int(w.count[d]))[0] ^ U(0xA5A5A5A5) for d in short]
        doc, values = np.concatenate([doc, short]), np.concatenate([values, np.array(own, U)])
    return unique_by_text(doc, values)


def identities(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """64-bit names of the texts' sets."""
    out = np.zeros(n, U)
    if len(doc):
        head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        sums = np.add.reduceat(mix(values), head), np.add.reduceat(mix(values ^ U(0x5851F42D4C957F2D)), head), np.diff(np.append(head, len(doc))).astype(U)
        out[doc[head]] = mix(mix(mix(sums[0]) + sums[1]) + sums[2])
    return out


def signatures(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Minimum hashes, 16 bits of each."""
    out = np.zeros((n, VALUES), np.uint16)
    if len(doc):
        head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        odd, plus = odd_numbers(VALUES, 5), odd_numbers(VALUES, 6)
        for k in range(VALUES):
            low = np.minimum.reduceat((values * odd[k] + plus[k]) >> U(32), head)
            out[doc[head], k] = (mix(low) & U(0xFFFF)).astype(np.uint16)
    return out


def describe(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n, cid, sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                doc, values = shingle_sets(block, width)
                sig = signatures(doc, values, block.n).astype(">u2").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n).cast(pa.int64()), batch.column(1).slice(block.first, block.n), pa.array(np.bincount(doc, minlength=block.n), pa.int64()),
                     pa.array(identities(doc, values, block.n).view(np.int64), pa.int64()), pa.array([sig[k * VALUES * 2 : (k + 1) * VALUES * 2] for k in range(block.n)], pa.binary())],
                    ["doc_id", "text_key", "n", "cid", "sig"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(lean(run), "doc_id long, text_key long, n long, cid long, sig binary")


def tree_place(tree: int) -> int:
    return tree * (VALUES // TREES)


def crowded(classes: DataFrame) -> DataFrame:
    """(tree, head, cid, n, sig) of the classes that share the first DEPTH values of a tree with another."""
    size = 2 * DEPTH
    heads = F.array(*[F.substring("sig", 2 * tree_place(t) + 1, size) for t in range(TREES)])
    short = classes.select("cid", F.posexplode(heads).alias("tree", "head"))
    shared = short.groupBy("tree", "head").agg(F.count("*").alias("m")).filter("m > 1")
    kept = short.join(shared, ["tree", "head"]).select("cid", F.col("tree").cast("int").alias("tree"), "head")
    return kept.join(classes.select("cid", "n", "sig"), "cid").select("tree", "head", "cid", "n", "sig")


def signature_rows(column: pa.Array) -> np.ndarray:
    """(rows, VALUES) of a column of signatures."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(">u2").reshape(-1, VALUES).astype(np.uint16)


def neighbours(rows: DataFrame, count: int) -> DataFrame:
    """(cid, other, agree): of each row the most alike of the REACH rows before it in its tree's order and region.

    Rows on two sides of a cut between partitions don't meet here; step 4 leaves no pair out.
    """
    order = F.concat(F.expr(f"substring(sig, 1 + 2 * {VALUES // TREES} * tree)"), F.expr(f"substring(sig, 1, 2 * {VALUES // TREES} * tree)"))
    parts = max(1, math.ceil(count / ROWS_PER_PARTITION))
    ranged = rows.select("tree", order.alias("order"), "cid").repartitionByRange(parts, "tree", "order", "cid").sortWithinPartitions("tree", "order", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, tree, cid = np.zeros((0, VALUES), np.uint16), np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(cid)
            sig = np.concatenate([sig, signature_rows(batch.column(1))])
            tree, cid = np.concatenate([tree, batch.column(0).to_numpy()]), np.concatenate([cid, batch.column(2).to_numpy()])
            best, at = np.zeros(len(cid), np.int64), np.zeros(len(cid), np.int64)
            for lag in range(1, min(REACH, len(cid) - 1) + 1):
                r = np.arange(max(lag, old), len(cid))
                r = r[(tree[r] == tree[r - lag]) & (sig[r, :DEPTH] == sig[r - lag, :DEPTH]).all(axis=1)]
                agree = (sig[r] == sig[r - lag]).sum(axis=1)
                better = agree > best[r]
                best[r[better]], at[r[better]] = agree[better], r[better] - lag
            hit = np.flatnonzero(best >= AGREE * VALUES)
            yield pa.RecordBatch.from_arrays([pa.array(cid[hit]), pa.array(cid[at[hit]]), pa.array(best[hit] / VALUES)], ["cid", "other", "agree"])
            sig, tree, cid = sig[-REACH:], tree[-REACH:], cid[-REACH:]

    return ranged.mapInArrow(lean(run), "cid long, other long, agree double")


class Pieces:
    """Rows of whole pieces, in order of the pieces; rows of a piece that are of two components are compared."""

    def __init__(self, table: pa.Table, percent: int = PERCENT):
        batch = table.drop_columns([n for n in ("text",) if n in table.column_names]).combine_chunks().to_batches()[0]
        self.cid, self.comp, self.tree, self.n, self.piece, self.block, self.crossed = (
            batch.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "comp", "tree", "n", "piece", "block", "crossed")
        )
        self.sig, self.percent = signature_rows(batch.column("sig")), percent
        places = [tree_place(t) for t in range(TREES)]
        self.heads = np.zeros((len(self.cid), TREES), np.uint64)
        for d in range(DEPTH):
            self.heads = self.heads * U(1 << 16) + self.sig[:, [p + d for p in places]]
        self.text = table.column("text") if "text" in table.column_names else None

    def compare(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, earlier rows, agreement) of the candidates that meet in this tree first, one distance at a time."""
        rows, lag = np.arange(len(self.cid)), 0
        while True:
            lag += 1
            rows = rows[rows >= lag]
            rows = rows[self.piece[rows] == self.piece[rows - lag]]
            if not len(rows):
                return
            before = rows - lag
            # two blocks of one region: pairs inside a block have a piece of their own
            own = (self.comp[rows] != self.comp[before]) & (~self.crossed[rows] | (self.block[rows] != self.block[before]))
            # sets whose sizes differ more can't be linked
            own &= 100 * np.minimum(self.n[rows], self.n[before]) >= self.percent * np.maximum(self.n[rows], self.n[before])
            r = rows[own]
            same = self.heads[r] == self.heads[r - lag]
            r = r[same.any(axis=1) & (same.argmax(axis=1) == self.tree[r])]
            if len(r):
                agree = (self.sig[r] == self.sig[r - lag]).view(np.uint8).sum(axis=1, dtype=np.uint8) / VALUES
                ok = agree >= AGREE
                if ok.any():
                    yield r[ok], r[ok] - lag, agree[ok]


def whole_pieces(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[Pieces]:
    """The stream in parts that split no piece."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        piece = batch.column("piece").to_numpy()
        if waiting and waiting[-1].column("piece")[-1].as_py() != piece[0]:
            yield Pieces(pa.Table.from_batches(waiting), percent)
            waiting = []
        last = int(np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))[-1])
        if last:
            yield Pieces(pa.Table.from_batches([*waiting, batch.slice(0, last)]), percent)
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield Pieces(pa.Table.from_batches(waiting), percent)


def across(percent: int) -> Callable:
    """Rows that have a candidate in another component: (tree, cid), both ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in whole_pieces(batches, percent):
            hit = np.zeros(len(s.cid), bool)
            for rows, before, _ in s.compare():
                hit[rows] = hit[before] = True
            at = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array(s.tree[at], pa.int32()), pa.array(s.cid[at])], ["tree", "cid"])

    return run


def sets_of(column: pa.Array, width: int) -> list[np.ndarray]:
    out = []
    for block in blocks(column):
        doc, values = shingle_sets(block, width)
        at = np.searchsorted(doc, np.arange(block.n + 1))
        out += [values[a:b] for a, b in zip(at[:-1], at[1:])]
    return out


def linked(a: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets have 100 * intersection >= percent * union with a."""
    sizes = np.array([len(x) for x in others])
    joined = np.concatenate(others)
    at = np.searchsorted(a, joined)
    at[at == len(a)] = 0
    common = np.add.reduceat((a[at] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return 100 * common >= percent * (len(a) + sizes - common)


def confirm(width: int, percent: int) -> Callable:
    """Links (u, v) between components, by name, among the rows of a stream of pieces with texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in whole_pieces(batches, percent):
            found = list(s.compare())
            if not found:
                continue
            rows, before, agree = (np.concatenate(x) for x in zip(*found))
            sets = [x for chunk in s.text.chunks for x in sets_of(chunk, width)]
            # what is joined here already; the likeliest pairs first
            name = np.unique(s.comp, return_inverse=True)[1]
            order = np.lexsort((-agree, rows))
            rows, before = rows[order], before[order]
            head = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            u, v = [], []
            for lo, hi in zip(head, [*head[1:], len(rows)]):
                r = rows[lo]
                for at in range(lo, hi, CONFIRMED_AT_ONCE):
                    others = before[at : min(hi, at + CONFIRMED_AT_ONCE)]
                    others = others[name[others] != name[r]]
                    if not len(others):
                        continue
                    for b in others[linked(sets[r], [sets[b] for b in others], percent)]:
                        if name[b] != name[r]:
                            u.append(int(s.comp[r]))
                            v.append(int(s.comp[b]))
                            name[name == name[b]] = name[r]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def blocks_of(classes: Column, shingles_: Column) -> Column:
    """Blocks of that many classes with that many shingles in all."""
    return F.ceil(F.greatest(classes / F.lit(CROWD), shingles_ / F.lit(LOAD))).cast("int")


def deal(rows: DataFrame) -> DataFrame:
    """rows (tree, head, cid, comp, n and more) of regions in which components meet, with piece, block and crossed.

    A row of a component with blocks of its own stands in one piece with each block of others; any other row in
    one with each block, its own included. The tables of regions and of large components are small: the second
    has a row for at least CROWD classes or LOAD shingles.
    """
    region = ["tree", "head"]
    per = cut(rows.groupBy(*region, "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s")))
    mixed = per.groupBy(*region).agg(F.count("*").alias("comps"), F.sum("c").alias("all_c"), F.sum("s").alias("all_s")).filter("comps > 1")
    large = per.filter((F.col("c") > CROWD) | (F.col("s") > LOAD)).join(mixed.select(*region), region, "left_semi").withColumn("blocks", blocks_of(F.col("c"), F.col("s")))
    before = F.sum("blocks").over(Window.partitionBy(*region).orderBy("comp").rowsBetween(Window.unboundedPreceding, -1))
    large = cut(large.withColumn("first", F.coalesce(before, F.lit(0)).cast("int")))
    sums = large.groupBy(*region).agg(F.sum("blocks").alias("own"), F.sum("c").alias("own_c"), F.sum("s").alias("own_s"))
    rest = lambda n: F.col(f"all_{n}") - F.coalesce(f"own_{n}", F.lit(0))
    own = F.coalesce("own", F.lit(0)).cast("int")
    regions = mixed.join(sums, region, "left").select(*region, own.alias("own"), (own + blocks_of(rest("c"), rest("s"))).alias("total"))
    known = rows.join(regions, region).join(large.select(*region, "comp", "blocks", "first"), [*region, "comp"], "left")
    is_large = F.col("first").isNotNull()
    first, blocks_ = F.coalesce("first", "own"), F.coalesce("blocks", F.col("total") - F.col("own"))
    known = known.withColumn("_first", first).withColumn("_end", first + blocks_).withColumn("block", (first + F.pmod(F.xxhash64("cid"), blocks_)).cast("int"))
    meets = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda x: ~is_large | (x < F.col("_first")) | (x >= F.col("_end")))
    dealt = known.withColumn("_with", F.explode(meets))
    piece = F.xxhash64("tree", "head", F.least("block", "_with"), F.greatest("block", "_with"))
    return dealt.withColumn("piece", piece).withColumn("crossed", F.col("block") != F.col("_with")).select(*rows.columns, "piece", "block", "crossed")


def in_pieces(rows: DataFrame, process: Callable, schema: str) -> DataFrame:
    """Apply process to the pieces of rows (tree, head, cid, comp, n, sig and more)."""
    return deal(rows).repartition("piece").sortWithinPartitions("piece", "block", "cid").mapInArrow(lean(process), schema)


def with_texts(docs: DataFrame, need: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, text) of one text of each class in need (cid)."""
    wanted = cut(need.select("cid").distinct().join(classes.select("cid", "low"), "cid").select("cid", F.col("low.doc_id").alias("_id"), F.col("low.text_key").alias("_key")))
    if wanted.count() <= BROADCAST_IDS:  # 24 bytes each
        wanted = F.broadcast(wanted)
    found = docs.select("doc_id", "text").withColumn("_text_key", F.xxhash64("text"))
    return found.join(wanted, (F.col("_text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("cid", "text")


def confirm_pairs(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (cid, other) whose sets are linked; each pair is decided beside its texts.

    Pairs are dealt by their second class and a salt, with that class's text once for each salt, so a class
    that is everybody's neighbour is spread.
    """
    salt = F.pmod(F.xxhash64("cid"), F.lit(64)).cast("int")
    pairs = cut(pairs.select("cid", "other").withColumn("salt", salt))
    roles = pairs.select("cid", F.col("other").alias("hub"), "salt", F.lit(1).alias("role"))
    hubs = pairs.select(F.col("other").alias("cid"), F.col("other").alias("hub"), "salt", F.lit(0).alias("role")).distinct()
    texts = with_texts(docs, pairs.select("cid").union(pairs.select(F.col("other").alias("cid"))), classes)
    rows = texts.join(roles.union(hubs), "cid").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, np.zeros(0, U)
        for batch in batches:
            sets = sets_of(batch.column("text"), width)
            cid, own, role = (batch.column(n).to_pylist() for n in ("cid", "hub", "role"))
            u, v = [], []
            for k, mine in enumerate(sets):
                if role[k] == 0:
                    hub, hub_set = own[k], mine
                elif hub == own[k] and len(mine) and len(hub_set) and linked(hub_set, [mine], percent)[0]:
                    u.append(cid[k])
                    v.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.mapInArrow(lean(run), "u long, v long")


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n, cid) of every row, and (cid, group) of every class that has shingles."""
    prepare(docs.sparkSession)
    base = cut(describe(docs, width))
    low = F.min(F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "text_key")).alias("low")
    classes = cut(base.filter("n > 0").groupBy("cid").agg(low, F.first("n").alias("n"), F.first("sig").alias("sig")))
    rows = cut(crowded(classes))
    count = rows.count()
    found = classes.select("cid", F.col("cid").alias("group"))
    if not count:
        return base, found
    # the most alike of all trees, of each class
    near = neighbours(rows, count).groupBy("cid").agg(F.max(F.struct("agree", "other")).alias("best")).select("cid", F.col("best.other").alias("other"))
    links = cut(confirm_pairs(docs, near, classes, width, percent))
    parts = cut(connected_components(links).select(F.col("node").alias("cid"), "component"))
    labelled = cut(rows.join(parts, "cid", "left").select("tree", "head", "cid", "n", "sig", F.coalesce("component", "cid").alias("comp")))
    flagged = cut(in_pieces(labelled, across(percent), "tree int, cid long").distinct())
    found = classes.select("cid").join(parts, "cid", "left").select("cid", F.coalesce("component", "cid").alias("group"))
    if not flagged.isEmpty():
        texts = with_texts(docs, flagged, classes)
        again = labelled.join(flagged, ["tree", "cid"]).join(texts, "cid").select("tree", "head", "cid", "n", "sig", "comp", "text")
        # components of components
        more = connected_components(in_pieces(again, confirm(width, percent), "u long, v long"))
        found = found.join(more.select(F.col("node").alias("group"), "component"), "group", "left").select("cid", F.coalesce("component", "group").alias("group"))
    return base, cut(found)


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    base, found = groups(docs, width, percent)
    full = base.filter("n > 0").select("doc_id", "n", "cid").join(found, "cid")
    names = cut(full.groupBy("group").agg(F.min("doc_id").alias("name")))
    named = full.join(names, "group").select("doc_id", F.col("n").alias("n_shingles"), F.col("name").alias("component_id"))
    bare = base.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.unionByName(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one with the smallest id, with its own columns; texts without words all stay.

    Of equal rows one stays; a row with a null id stands for its group only if no other does.
    """
    base, found = groups(docs.select("doc_id", "text"), width, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "text_key")).alias("first")
    chosen = base.filter("n > 0").join(found, "cid").groupBy("group").agg(first).select(F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("key"))
    rows = base.filter("n > 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"))
    chosen = cut(chosen.join(rows, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))).select("id", "key", "rows"))
    several = not chosen.filter("rows > 1").isEmpty()
    if chosen.count() <= BROADCAST_IDS:  # 24 bytes each
        chosen = F.broadcast(chosen)
    inner = hidden(docs)
    doc_id, text = (F.col(f"c{docs.columns.index(n)}") for n in ("doc_id", "text"))
    wordy = F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    named = inner.filter(wordy).join(chosen, (F.xxhash64(text) == F.col("key")) & doc_id.cast("long").eqNullSafe(F.col("id")))
    kept = named.filter("rows = 1").select(*inner.columns) if several else named.select(*inner.columns)
    if several:
        kept = kept.unionByName(named.filter("rows > 1").dropDuplicates(["id", "key"]).select(*inner.columns))
    return kept.unionByName(inner.filter(~wordy)).toDF(*docs.columns)


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by brute force, for DuckDB: all pairs that share a shingle, and their reach.
OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
one AS (SELECT list_sort(s) AS s, min(rid) AS cid, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY ALL),
x AS (SELECT cid, n, unnest(s) AS g FROM one),
pairs AS (SELECT a.cid AS u, b.cid AS v FROM x a JOIN x b ON a.g = b.g AND a.cid < b.cid GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
reach(a, b) AS (SELECT cid, cid FROM one UNION SELECT r.a, e.v FROM reach r JOIN both_ e ON r.b = e.u),
comp AS (SELECT a AS cid, min(b) AS k FROM reach GROUP BY a),
rows_ AS (SELECT s.rid, s.doc_id, len(s.s) AS n, c.k FROM s LEFT JOIN one o ON list_sort(s.s) = o.s LEFT JOIN comp c ON o.cid = c.cid),
named AS (SELECT k, min(doc_id) AS name FROM rows_ WHERE k IS NOT NULL GROUP BY k)
SELECT r.doc_id, r.n::BIGINT AS n_shingles, CASE WHEN r.k IS NULL THEN r.doc_id ELSE m.name END AS component_id,
  coalesce(r.doc_id = CASE WHEN r.k IS NULL THEN r.doc_id ELSE m.name END, false) AS kept
FROM rows_ r LEFT JOIN named m ON r.k = m.k
"""
