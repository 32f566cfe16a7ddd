"""N-gram Jaccard join of whole documents, as a blocked product of the document by n-gram incidence matrix.

Equal sets are one class from the start. Of every other set only the rarest columns are multiplied at first:
two sets with a Jaccard similarity of t share at least one of their n - ceil(t * n) + 1 first columns, whatever
the order, so columns that a sample shows to be frequent go last. Partial products carry how many overlaps are
still possible from their place in either set, and pairs below the overlap that their sizes ask for are
discarded. Pairs that are left are multiplied whole, a block of documents with one document at a time.

A column is first multiplied with one document only, the one with the fewest rare columns. Only where that
leaves more than one component are its other pairs tried, those across components. So a group of near copies
costs its size and not its square, and no link that could join two components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from larkspur.llm import tokens
from larkspur.llm.components import components
from larkspur.plans.session import broadcast_if_small, drop_written, tables_written, written

#: Documents at most, about, whose n-grams tell which columns are frequent, and the number of these: they change the order of columns, never a result.
SAMPLE_DOCS, FREQUENT = 5_000, 1 << 18
#: Documents that are multiplied with another at once.
BLOCK_ROWS = 1_000
#: Words of 64 bits that hold the parity of a set's columns.
MASKS = 8
#: Sets of more than LARGE columns have a mask of WIDE words besides: in the narrow one half of all bits would differ whatever they hold.
LARGE, WIDE = 1_024, 32


def _sets(block: tokens.Block, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; the whole of a text with fewer words."""
    words, bounds = block.words, block.bounds
    grams = np.zeros(len(words), np.uint64)
    n = len(words) - width + 1
    if n > 0:
        for k in range(width):
            grams[:n] += words[k : k + n] * tokens.step_power(np.array([k]))[0]
        grams = tokens.mix(grams)
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        if end - begin >= width:
            yield np.unique(grams[begin : end - width + 1])
        elif end > begin:
            part = words[begin:end] * tokens.step_power(np.arange(end - begin))
            yield tokens.mix(np.array([part.sum() + np.uint64(end - begin)], np.uint64))
        else:
            yield words[:0]


def _parity(s: np.ndarray, words: int) -> np.ndarray:
    """Whether an odd number of columns falls on each of 64 * words bits."""
    odd = np.bincount((s & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-grams that many of a bounded sample of documents hold, sorted, and their ranks, rarest first."""
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(total, 1))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tokens.blocks(batch.column(0)):
                found = list(_sets(block, width))
                yield pa.RecordBatch.from_arrays([pa.array(tokens.signed(np.concatenate(found)))], names=["g"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    top = sample.select("text").mapInArrow(grams, "g long").groupBy("g").count().where("count >= 3").orderBy(F.desc("count"), "g").limit(FREQUENT)
    rows = top.toArrow()
    hashes, counts = rows.column("g").to_numpy().view(np.uint64), rows.column("count").to_numpy()
    ranks = np.empty(len(rows), np.int64)
    ranks[np.lexsort((hashes, counts))] = np.arange(len(rows))
    order = np.argsort(hashes)
    return hashes[order], ranks[order]


def similar(docs: DataFrame, width: int = 5, percent: int = 80, carry: Sequence[str] = ()) -> DataFrame:
    """Components of documents whose sets of width-word n-grams have a Jaccard similarity of percent/100 or more.

    docs: doc_id, text; other columns are ignored. Returns (doc_id, n_shingles, component_id) for every row.
    Words are runs of anything but ASCII white space, A-Z as a-z; a text with fewer words than width is one
    n-gram; an empty or null text has none, links with nothing and is its own component. A null doc_id takes
    part but never names a component: it gets the smallest id of its component, null if there is none. Rows
    that share a doc_id are one document only if their sets link. Sets are told apart by 64-bit hashes.
    With carry, columns of docs by name, each row has these too and root, which tells components apart by
    more than their least id; it is null for a text without words.
    """
    docs = docs.select("doc_id", "text", *carry)
    spark, earlier = docs.sparkSession, tables_written()
    tokens.bound_batches(spark)
    frequent = spark.sparkContext.broadcast(_frequent(docs, width))

    mask_names = [f"m{i}" for i in range(MASKS)]
    held = ["n", "rare", "firsts", *mask_names, "wide"]

    def need(n: int) -> int:
        return -(-percent * n // 100)

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = frequent.value
        for batch in batches:
            for block in tokens.blocks(batch.column("text")):
                sets, firsts, masks, wide, out = list(_sets(block, width)), [], [], [], []
                for s in sets:
                    at = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
                    often = known[at] == s if len(known) else np.zeros(len(s), bool)
                    keep = len(s) - need(len(s)) + 1 if len(s) else 0
                    rare = s[~often]
                    first = rare[:keep]
                    if len(first) < keep:
                        rest = s[often]
                        first = np.concatenate([first, rest[np.argsort(ranks[at[often]])[: keep - len(first)]]])
                    firsts.append(first)
                    masks.append(_parity(s, MASKS))
                    wide.append(_parity(s, WIDE) if len(s) > LARGE else None)
                    out.append((len(s), tokens.mix(s).sum(dtype=np.uint64), len(rare)))
                n, key, rare_n = (np.array(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(block.rows[0], block.rows[1] - block.rows[0]) for c in ("doc_id", *carry)), pa.array(n.astype(np.int64)), pa.array(tokens.signed(key.astype(np.uint64))), pa.array((rare_n * 1_000_000 // np.maximum(n, 1)).astype(np.int64)), tokens.lists(tokens.signed(np.concatenate(firsts)), np.array([len(x) for x in firsts])), *(pa.array(np.ascontiguousarray(m)) for m in np.array(masks).T), pa.array(wide, pa.list_(pa.int64()))],
                    names=["doc_id", *carry, "n", "node", *held[1:]],
                )

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry))
    rows = written(docs.mapInArrow(incidence, f"{kinds}, n long, node long, rare long, firsts array<long>, " + ", ".join(f"{m} long" for m in mask_names) + ", wide array<long>"))
    classes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in held))
    cells = classes.select("node", "n", "rare", F.posexplode("firsts").alias("pos", "col"))
    # a set has a column once, so a count above one means several sets
    shared = cells.groupBy("col").count().where("count > 1").select("col")
    cells = written(cells.join(shared, "col"))
    cells = written(cells.join(cells.groupBy("col").agg(F.min(F.struct("rare", "node", "n", "pos")).alias("pivot")), "col"))

    def possible(x: str, y: str, before: str) -> str:
        """What the overlap can still be, from the places of this column, meets what the sizes ask for."""
        n_x, n_y, p_x, p_y = f"{x}n", f"{y}n", f"{x}pos", f"{y}pos"
        return f"{100 + percent} * (1 + {before} + least({n_x} - {p_x}, {n_y} - {p_y}) - 1) >= {percent} * ({n_x} + {n_y})"

    pairs = written(cells.where("node <> pivot.node").where(possible("", "pivot.", "least(pos, pivot.pos)")).select(F.col("pivot.node").alias("p"), F.col("node").alias("x")).distinct())
    links = _verified(docs, classes, pairs, frequent, width, percent)
    found = components(links)

    # columns that still hold several components; q: how many shared columns of the row come before this one
    roots = cells.select("col", "node", "n", "pos", F.col("pivot.node").alias("pivot")).join(found, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("q", F.row_number().over(Window.partitionBy("node").orderBy("pos")) - 1)
    split = roots.groupBy("col").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(F.col("node") != F.col("pivot"), "root")).alias("top")).where("lo <> hi").select("col", F.col("top.root").alias("main"))
    roots = written(roots.join(split, "col").select("col", "node", "n", "pos", "q", "root", "main").join(classes.select("node", *mask_names, "wide"), "node"))
    # columns that a set holds are counted by parity in a few bits: bits that differ are no more than columns that do
    differ = " + ".join(f"bit_count(x.{m} ^ y.{m})" for m in mask_names)
    most = f"{100 - percent} * (x.n + y.n)"
    wider = "aggregate(zip_with(x.wide, y.wide, (a, b) -> bit_count(a ^ b)), 0, (s, v) -> s + v)"  # null where a set is not large
    x, y = roots.where("root <> main").alias("x"), roots.alias("y")
    across = x.join(y, F.expr("x.col = y.col and x.root <> y.root and (y.root = y.main or x.node < y.node)" + f" and {possible('x.', 'y.', 'least(x.q, y.q)')} and {100 + percent} * ({differ}) <= {most} and coalesce({100 + percent} * {wider} <= {most}, true)"))
    more = across.select(F.col("x.node").alias("p"), F.col("y.node").alias("x")).distinct()
    more = more.join(pairs, ["p", "x"], "left_anti").join(pairs.select(F.col("p").alias("x"), F.col("x").alias("p")), ["p", "x"], "left_anti")
    found = components(links.unionByName(_verified(docs, classes, written(more), frequent, width, percent)))
    drop_written(earlier, keep=[rows, found])

    out = ["doc_id", F.col("n").alias("n_shingles"), "component_id", *carry, *(["root"] if carry else [])]
    member = rows.select("doc_id", *carry, "n", "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.select("node", "doc_id").join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("doc_id").alias("component_id"))
    linked = member.where("n > 0").join(least, "root").select(*out)
    return linked.unionByName(member.where("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("root", F.lit(None).cast("long")).select(*out))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, frequent: Broadcast, width: int, percent: int) -> DataFrame:
    """Those of pairs (p, x) whose whole sets are similar enough, as (a, b).

    The first block of columns is the sets' first columns, of which `classes` has them all: what they have in common
    and what is left of either set bounds the overlap. Then come the whole sets, with columns cut to 32
    bits, which can only add to an overlap; where a few more would decide, the whole columns are multiplied.
    """

    earlier = tables_written()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = frequent.value
        for batch in batches:
            firsts, to = batch.column("firsts"), batch.column("to").to_pylist()
            n, size = batch.column("n").to_numpy(), np.asarray(firsts.value_lengths()).astype(np.int64)
            h = np.asarray(firsts.flatten()).astype(np.int64).view(np.uint64)
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            often = known[at] == h if len(known) else np.zeros(len(h), bool)
            # in the order of the columns: rare ones by hash, then frequent ones by rank
            code = (h >> np.uint64(33)).astype(np.uint32)
            code[often] = np.uint32(1 << 31) + ranks[at[often]].astype(np.uint32)
            edge, node = np.concatenate([[0], np.cumsum(size)]), batch.column("node").to_numpy()
            for i, some in enumerate(to):
                yield from _sent(some, node[i], int(n[i]), code[edge[i] : edge[i + 1]].view(np.int32))

    def whole(bits: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                node, to = batch.column("node").to_numpy(zero_copy_only=False), batch.column("to").to_pylist()
                for block in tokens.blocks(batch.column("text")):
                    for i, s in enumerate(_sets(block, width), block.rows[0]):
                        # rows that share a doc_id can hold other texts
                        if len(s) and tokens.signed(tokens.mix(s).sum(dtype=np.uint64, keepdims=True))[0] == node[i]:
                            yield from _sent(to[i], node[i], len(s), tokens.signed(s) if bits == 64 else (s >> np.uint64(32)).astype(np.uint32).view(np.int32))

        return run

    def texts(some: DataFrame) -> DataFrame:
        wanted = broadcast_if_small(written(classes.select("node", F.col("doc_id").alias("own_id")).join(_to(some), "node")))
        return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["own_id"])).select("text", "node", "to")

    row = "p long, part int, own boolean, node long, n long, cols array<{}>"
    first = classes.select("node", "n", "firsts").join(_to(pairs), "node").mapInArrow(coded, row.format("int"))
    left = written(_multiplied(first, percent, "bound").select("p", F.col("node").alias("x")))
    short = written(_multiplied(texts(left).mapInArrow(whole(32), row.format("int")), percent, "short"))
    unsure = written(short.where("not sure").select("p", F.col("node").alias("x")))
    long = _multiplied(texts(unsure).mapInArrow(whole(64), row.format("long")), percent, "whole")
    links = written(short.where("sure").unionByName(long).select(F.col("p").alias("a"), F.col("node").alias("b")).distinct())
    drop_written(earlier, keep=[links])
    return links


def _to(pairs: DataFrame) -> DataFrame:
    """(node, to): the blocks that each set goes to, in lists of about BLOCK_ROWS. The sets that meet p are dealt to blocks of about as many, p goes to each of its blocks."""
    parts = written(pairs.groupBy("p").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts")))
    dealt = pairs.join(parts, "p").select(F.col("x").alias("node"), "p", F.pmod(F.hash("x"), F.col("parts")).alias("part"), F.lit(False).alias("own"))
    own = parts.select(F.col("p").alias("node"), "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("own"))
    lists = F.ceil(F.count("*").over(Window.partitionBy("node")) / BLOCK_ROWS)
    both = dealt.unionByName(own).withColumn("list", F.pmod(F.hash("p", "part"), lists))
    return both.groupBy("node", "list").agg(F.collect_list(F.struct("p", "part", "own")).alias("to")).select("node", "to")


def _sent(to: list[dict], node: int, n: int, cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(to), 64):
        some = to[at : at + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array([t["p"] for t in some]), pa.array([t["part"] for t in some], pa.int32()), pa.array([t["own"] for t in some]), pa.array(np.full(len(some), node)), pa.array(np.full(len(some), n)), tokens.lists(np.tile(cols, len(some)), np.full(len(some), len(cols)))],
            names=["p", "part", "own", "node", "n", "cols"],
        )


def _multiplied(rows: DataFrame, percent: int, kind: str) -> DataFrame:
    """(p, node, sure) of the pairs that stay: each block's rows are multiplied with the row of its p, which comes first."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_n = np.zeros(0, np.int64), 0
        for batch in batches:
            p, own, node, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "own", "node", "n"))
            flat = np.asarray(batch.column("cols").flatten())
            flat = flat.view(np.uint32) if flat.dtype == np.int32 else flat
            edge = np.concatenate([[0], np.cumsum(np.asarray(batch.column("cols").value_lengths()).astype(np.int64))])
            turns = np.unique(np.concatenate([[0], np.flatnonzero(own), [len(batch)]]))
            for begin, end in zip(turns[:-1], turns[1:], strict=True):
                if own[begin]:
                    held, held_n = np.sort(flat[edge[begin] : edge[begin + 1]]), n[begin]
                    begin += 1
                if begin == end or not len(held):
                    continue
                part, at, size = flat[edge[begin] : edge[end]], edge[begin:end] - edge[begin], np.diff(edge[begin : end + 1])
                hit = held[np.minimum(np.searchsorted(held, part), len(held) - 1)] == part
                overlap, total = np.add.reduceat(hit.astype(np.int64), at), n[begin:end] + held_n
                if kind == "bound":
                    # up to the lesser of both last columns everything in common has been met; equal codes may be of different columns
                    last, own_last = part[at + size - 1], held[-1]
                    stop = np.minimum(last, own_last)
                    met = np.where(last < own_last, size, np.add.reduceat((part < np.repeat(stop, size)).astype(np.int64), at))
                    own_met = np.where(own_last < last, len(held), np.searchsorted(held, stop))
                    overlap = overlap + np.minimum(n[begin:end] - met, held_n - own_met)
                keep = (100 + percent) * overlap >= percent * total
                sure = (100 + percent) * (overlap - 8) >= percent * total if kind == "short" else keep
                yield pa.RecordBatch.from_arrays([pa.array(p[begin:end][keep]), pa.array(node[begin:end][keep]), pa.array(sure[keep])], names=["p", "node", "sure"])

    sorted_rows = rows.repartition("p", "part").sortWithinPartitions("p", "part", F.desc("own"))
    return sorted_rows.mapInArrow(product, "p long, node long, sure boolean")
