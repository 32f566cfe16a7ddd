"""Dedup of long passages with sparse suffix arrays.

Suffixes are kept only where a minimiser of their words begins: of every `window` consecutive k-grams the one
with the least hash. Two copies of a passage keep the same suffixes. The suffixes of all texts are sorted by their
first words (range partitions, sorted inside), and each is compared with its neighbours: those that begin like a
neighbour of another text are candidates. Order is by text within equal beginnings, so a frequent beginning is
spread over partitions, and a text's equal suffixes count as one entry.

A candidate is then extended left and right: all passages of min_words words around it for which it is the first
minimiser are sorted and compared with their neighbours in the same way. Any passage of min_words words that
two texts share holds, within its first `window` k-grams, a minimiser that both keep, with at least
min_words - window + 1 words to its right, so none is missed. Spans are unions of such passages, which makes them as
long as the match. Words stand in the sort keys by 64-bit hashes of the first words, which keeps equal beginnings
together as the words themselves would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from larkspur.llm import tokens
from larkspur.plans.session import drop_written, tables_written, written

GRAM, WINDOW = 8, 32


def _minimisers(block: tokens.Block, sums: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all passages of min_words words, and where the first window of each has its least k-gram (of equals the first)."""
    n = len(block.words)
    if n < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    here = np.arange(n - GRAM + 1)
    value, place, width = tokens.mix(tokens.spans(sums, here, here + GRAM)), here, 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        less = value[step:] < value[:-step]
        value, place = np.where(less, value[step:], value[:-step]), np.where(less, place[step:], place[:-step])
        width += step
    owner = np.repeat(np.arange(len(block.bounds) - 1), np.diff(block.bounds))
    start = np.arange(n - min_words + 1)
    start = start[owner[start] == owner[start + min_words - 1]]
    return start, place[start]


def _compared(rows: DataFrame, order: list[str], entry: str) -> DataFrame:
    """rows, whose first column is key, with before and after: whether the entry before or after theirs, by key and order, has their key.

    Rows of the same key and entry are one entry; order tells entries apart, so all its rows are in one partition.
    """
    own = rows.columns

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of the entry that is open: what comes after is not known yet
        held: list[pa.RecordBatch] = []
        held_key = held_entry = None
        held_before, first = False, True

        def out(part: pa.RecordBatch, before: np.ndarray, after: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(before), pa.array(after), pa.array(edge)], names=[*own, "before", "after", "edge"])

        def closed(after: bool, edge: bool) -> Iterator[pa.RecordBatch]:
            for part in held:
                yield out(part, np.full(len(part), held_before), np.full(len(part), after), np.full(len(part), edge or first))

        for batch in batches:
            if not len(batch):
                continue
            key, name = batch.column("key").to_numpy(), batch.column(entry).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])]))
            if held and key[0] == held_key and name[0] == held_entry:
                stop = starts[1] if len(starts) > 1 else len(key)
                held.append(batch.slice(0, stop))
                starts = starts[1:]
            if not len(starts):
                continue
            if held:
                yield from closed(bool(key[starts[0]] == held_key), False)
                first = False
            # all entries of this batch but the last are known
            keys = key[starts]
            same = keys[1:] == keys[:-1]
            before = np.concatenate([[bool(held) and bool(keys[0] == held_key)], same])
            if len(starts) > 1:
                size = np.diff(starts)
                part = batch.slice(starts[0], starts[-1] - starts[0])
                edge = np.zeros(len(starts) - 1, bool)
                edge[0] = first
                yield out(part, np.repeat(before[:-1], size), np.repeat(same, size), np.repeat(edge, size))
                first = False
            held, held_key, held_entry, held_before = [batch.slice(starts[-1])], keys[-1], name[starts[-1]], bool(before[-1])
        if held:
            yield from closed(False, True)

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in own)
    sorted_rows = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    table = written(sorted_rows.mapInArrow(neighbours, f"{schema}, before boolean, after boolean, edge boolean"))
    # entries at the edges of partitions, two for each: their neighbours may be in the partitions beside
    edges = table.where("edge").groupBy("key", *order).agg(F.max("before").alias("b"), F.max("after").alias("a"))
    line = Window.orderBy("key", *order)
    edges = edges.select("key", F.col(entry).alias("_entry"), (F.col("b") | F.coalesce(F.lag("key").over(line) == F.col("key"), F.lit(False))).alias("b"), (F.col("a") | F.coalesce(F.lead("key").over(line) == F.col("key"), F.lit(False))).alias("a"))
    mended = table.where("edge").join(F.broadcast(edges.withColumnRenamed("key", "_key")), (F.col("key") == F.col("_key")) & (F.col(entry) == F.col("_entry")))
    return table.where("not edge").select(*own, "before", "after").unionByName(mended.select(*own, F.col("b").alias("before"), F.col("a").alias("after")))


def repeated_passages(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """What each text shares with other documents in passages of min_words (40 at least) words or more.

    docs: doc_id, text; other columns are ignored. Returns a row for each row of docs: doc_id; n_words;
    n_repeated, words within passages that another document has too; n_removed, those of them within passages
    that an earlier document has (the smallest doc_id is earliest, a null doc_id last); spans, array of
    (begin, end, removed) in words, the passages merged. Words are runs of anything but ASCII white space, A-Z as
    a-z. Repeats within one text do not count. Equal texts under different ids repeat each other wholly if
    they have min_words words. Rows that share doc_id and text are one document. Null and empty texts have none.
    """
    if min_words < GRAM + WINDOW:
        raise ValueError(f"min_words is {GRAM + WINDOW} at least")
    depth, earlier = min_words - WINDOW + 1, tables_written()
    tokens.bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text").withColumn("rid", F.xxhash64("text"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tokens.blocks(batch.column("text")):
                sums = tokens.prefix_sums(block.words)
                at = np.unique(_minimisers(block, sums, min_words)[1])
                own = np.searchsorted(block.bounds, at, "right") - 1
                key = tokens.mix(tokens.spans(sums, at, at + depth))
                yield pa.RecordBatch.from_arrays([pa.array(tokens.signed(key)), batch.column("rid").take(pa.array(own + block.rows[0]))], names=["key", "rid"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tokens.blocks(batch.column("text")):
                rows = slice(*block.rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows], batch.column("rid")[rows], pa.array(np.diff(block.bounds).astype(np.int64))], names=["doc_id", "rid", "n_words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = written(docs.mapInArrow(sizes, f"doc_id {kind}, rid long, n_words long"))
    # of equal texts the earliest stands for all
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    classes = written(table.where(F.col("n_words") >= min_words).groupBy("rid").agg(F.min(order).alias("first"), F.max(order).alias("end")))

    suffix = docs.select("text", "rid").mapInArrow(suffixes, "key long, rid long").distinct()  # copies of a text are one
    found = _compared(suffix, ["rid"], "rid").where("before or after").groupBy("rid").agg(F.collect_set("key").alias("keys"))
    found = written(found.join(classes, "rid").select(F.col("rid").alias("own"), "first", "keys"))
    texts = docs.join(found, (docs["rid"] == found["own"]) & docs["doc_id"].eqNullSafe(found["first.doc_id"])).select("text", "rid", "first", "keys")

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, size = batch.column("keys").flatten().to_numpy(), batch.column("keys").value_lengths().to_numpy()
            edge = np.concatenate([[0], np.cumsum(size)])
            for block in tokens.blocks(batch.column("text")):
                sums = tokens.prefix_sums(block.words)
                start, least = _minimisers(block, sums, min_words)
                own = np.searchsorted(block.bounds, start, "right") - 1
                key = tokens.signed(tokens.mix(tokens.spans(sums, least, least + depth)))
                keep = np.zeros(len(start), bool)
                turns = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]]) if len(own) else np.zeros(1, np.int64)
                for b, e in zip(turns[:-1], turns[1:], strict=True):
                    r = own[b] + block.rows[0]
                    keep[b:e] = np.isin(key[b:e], wanted[edge[r] : edge[r + 1]])
                start, own = start[keep], own[keep]
                at = pa.array(own + block.rows[0])
                key = tokens.mix(tokens.spans(sums, start, start + min_words))
                yield pa.RecordBatch.from_arrays([pa.array(tokens.signed(key)), batch.column("first").take(at), batch.column("rid").take(at), pa.array((start - block.bounds[own]).astype(np.int32))], names=["key", "first", "rid", "pos"])

    passages = texts.mapInArrow(extended, f"key long, first struct<last:boolean,doc_id:{kind}>, rid long, pos int")
    # entries of a key are in the order of their documents: all but its first have it from an earlier one
    met = _compared(passages, ["first", "rid"], "rid").where("before or after").select("rid", "pos", F.col("before").alias("late"))
    # passages that begin where others still go on are one span with them
    way = Window.partitionBy("rid", "late").orderBy("pos")
    opens = F.coalesce(F.col("pos") - F.lag("pos").over(way) > min_words, F.lit(True)).cast("int")
    merged = met.distinct().withColumn("opens", opens).withColumn("span", F.sum("opens").over(way)).groupBy("rid", "late", "span").agg(F.min("pos").alias("begin"), (F.max("pos") + min_words).cast("int").alias("end"))
    spans = merged.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("late", "begin", "end"))).alias("s"))
    spans = written(spans.select("rid", F.transform("s", lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), x["late"].alias("removed"))).alias("spans")))
    copies = classes.where("first.doc_id is distinct from end.doc_id").select("rid", F.col("first").alias("copy_of"))
    own = classes.select("rid").join(spans, "rid", "left").join(copies, "rid", "left")
    whole = "array(named_struct('begin', 0, 'end', cast(n_words as int), 'removed', copy_of.doc_id is distinct from doc_id))"
    drop_written(earlier, keep=[table, classes, spans])
    return (
        table.join(own, "rid", "left")
        .withColumn("spans", F.expr(f"case when copy_of is null then coalesce(spans, array()) when copy_of.doc_id is distinct from doc_id then {whole} else array_union({whole}, filter(coalesce(spans, array()), x -> x.removed)) end"))
        .select("doc_id", "n_words", F.expr(_covered("spans")).alias("n_repeated"), F.expr(_covered("filter(spans, x -> x.removed)")).alias("n_removed"), "spans")
    )


def _covered(spans: str) -> str:
    """Words within spans, those of overlapping ones once."""
    acc = "named_struct('n', 0L, 'e', 0)"
    sorted_spans = f"array_sort(transform({spans}, x -> named_struct('begin', x.begin, 'end', x.end)))"
    return f"aggregate({sorted_spans}, {acc}, (a, x) -> named_struct('n', a.n + greatest(0, x.end - greatest(a.e, x.begin)), 'e', greatest(a.e, x.end)), a -> a.n)"
