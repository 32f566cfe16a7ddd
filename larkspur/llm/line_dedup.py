"""Line dedup: equal lines, and lines one word apart, stay once, where they come first.

The edit bound is one word, for lines of MIN_WORDS words or more: of shorter ones a word is more than a fifth.

The deletion neighbourhood of a line holds the line without any one of its words. Two lines are within one
word of each other just if (substitution) both lose the word at the same place and become equal, or
(insertion, deletion) one loses a word and becomes the other. Neighbourhoods are made only for lines that
share their first or last half with another line, as all lines within one word of each other do; this is
exact, and keeps the number of variants near the number of real candidates. A group of equal variants
is met through its earliest line, so it costs its size. All tables here grow with the documents, so none is
broadcast by a hint: sizes that Spark measures decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.llm import tokens
from larkspur.plans.session import drop_written, tables_written, written

#: Words from which lines may differ by one: its edit similarity, 1 - 1 / words, is 0.8 or more.
MIN_WORDS = 5
#: Columns that dedup_lines() adds or uses on its way.
ADDED = {"n_lines", "n_dropped", "rid", "own_id", "own_rid", "gone"}
_LINE = "line_no int, h1 long, h2 long, k0 long, k1 long, k2 long, k3 long"
_FOLD = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def _lines(block: tokens.Block) -> tuple[np.ndarray, ...]:
    """Per line of a block: its text, number, begin and end in bytes, begin and end in words."""
    breaks = np.flatnonzero(block.data == 10)
    kinds = np.searchsorted(breaks, block.offsets[:-1])
    # a text begins a line, and so does each byte after a line feed, which may be the end of its text
    owner = np.repeat(np.arange(len(block.offsets) - 1), np.diff(np.append(kinds, len(breaks))) + 1)
    first = np.searchsorted(owner, np.arange(len(block.offsets) - 1))
    number = np.arange(len(owner)) - first[owner]
    begin = np.where(number == 0, block.offsets[owner], 0)
    inner = number > 0
    begin[inner] = breaks[kinds[owner[inner]] + number[inner] - 1] + 1
    end = np.append(begin[1:] - 1, block.offsets[-1])
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    end[last] = block.offsets[owner[last] + 1]
    return owner, number, begin, end, np.searchsorted(block.starts, begin), np.searchsorted(block.starts, end)


def _rows(batch: pa.RecordBatch, min_words: int) -> Iterator[pa.RecordBatch]:
    for block in tokens.blocks(batch.column("text")):
        owner, number, _, _, s, e = _lines(block)
        filled = e > s
        owner, number, s, e = owner[filled], number[filled], s[filled], e[filled]
        sums, n = tokens.prefix_sums(block.words), e - s
        other = tokens.prefix_sums(tokens.mix(block.words ^ np.uint64(0x5BF03635)))
        h1 = tokens.mix(tokens.spans(sums, s, e) + n.astype(np.uint64))
        h2 = tokens.mix(tokens.spans(other, s, e) + n.astype(np.uint64))
        keys = []
        # lines that differ by a word are in one class of lengths, or n is the least of its own and also stands in the one below
        for group, member in ((n // 4, n >= min_words), (n // 4 - 1, (n > min_words) & (n % 4 == 0))):
            for part, (b, t) in enumerate(((s, s + 2 * group), (e - 2 * group, e))):
                key = tokens.mix(tokens.spans(sums, np.where(member, b, s), np.where(member, t, s)) + (4 * group + part).astype(np.uint64))
                keys.append(pa.array(tokens.signed(key), mask=~member))
        at = pa.array(owner + block.rows[0])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("rid").take(at), pa.array(number.astype(np.int32)), pa.array(tokens.signed(h1)), pa.array(tokens.signed(h2)), *keys],
            names=["doc_id", "rid", "line_no", "h1", "h2", "k0", "k1", "k2", "k3"],
        )


def _variants(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The deletion neighbourhood of each line, as far as its shared ends leave room for an edit; lost is the place of the word that is left out, -1 for the whole line."""
    for block in tokens.blocks(batch.column("line")):
        rows = slice(*block.rows)
        head, tail = (batch.column(c).to_numpy(zero_copy_only=False)[rows] for c in ("head", "tail"))
        sums, s, e = tokens.prefix_sums(block.words), block.bounds[:-1], block.bounds[1:]
        n = e - s
        line = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(block.words)) - np.repeat(s, n)
        end = 2 * ((n - 1) // 4)
        wanted = head[line] & (place >= end[line]) | tail[line] & (place < (n - end)[line])
        line, place, here = line[wanted], place[wanted], np.flatnonzero(wanted)
        rest = tokens.spans(sums, s[line], here) + tokens.spans(sums, here + 1, e[line]) * tokens.step_power(place)
        keys = tokens.mix(np.concatenate([rest + (n[line] - 1).astype(np.uint64), tokens.spans(sums, s, e) + n.astype(np.uint64)]))
        own = pa.array(np.concatenate([line, np.arange(len(n))]) + block.rows[0])
        yield pa.RecordBatch.from_arrays([pa.array(tokens.signed(keys)), pa.array(np.concatenate([place, np.full(len(n), -1)]).astype(np.int32)), batch.column("h1").take(own)], names=["key", "lost", "h1"])


def _within_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those pairs of lines whose edit distance in words is one: what is left between the common head and tail is a word at most.

    The common head and tail are found by halving, in the hashes of all beginnings and ends of a batch's lines at once.
    """
    for batch in batches:
        keep = []
        for x, y in zip(*(tokens.blocks(batch.column(c), size=1 << 40) for c in ("line", "other")), strict=True):
            sums = [tokens.prefix_sums(t.words) for t in (x, y)]
            begin, n = [t.bounds[:-1] for t in (x, y)], [np.diff(t.bounds) for t in (x, y)]

            def longest(most: np.ndarray, of: Callable) -> np.ndarray:
                low, high = np.zeros(len(most), np.int64), most.copy()
                while (low < high).any():
                    middle = (low + high + 1) // 2
                    same = of(0, middle) == of(1, middle)
                    low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
                return low

            head = longest(np.minimum(*n), lambda i, k: tokens.spans(sums[i], begin[i], begin[i] + k))
            tail = longest(np.minimum(*n) - head, lambda i, k: tokens.spans(sums[i], begin[i] + n[i] - k, begin[i] + n[i]))
            keep.append(np.maximum(*n) - head - tail <= 1)
        part = batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))
        yield pa.RecordBatch.from_arrays([part.column("place")], names=["place"])


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, rid, line_no) of each line that goes: an earlier one is equal or, if both have min_words (4 at least) words or more, one word away.

    docs: doc_id, rid, text. Earlier: smaller (doc_id, rid, line_no), a null doc_id last. A line is compared
    with every earlier one, also with those that go themselves. Lines without a word are never dropped; null and empty texts have none.
    """
    tokens.bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _rows(batch, min_words)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("own")
            at, fields = own.value_lengths().to_numpy(), own.flatten()
            owner, texts = np.repeat(np.arange(len(at)), at), batch.column("text").to_pylist()
            out, last, split = [], -1, []
            for o, k in zip(owner.tolist(), fields.field("line_no").to_pylist(), strict=True):
                if o != last:
                    last, split = o, texts[o].split("\n")
                out.append(split[k])
            yield pa.RecordBatch.from_arrays([*(fields.field(c) for c in ("h1", "h2", "head", "tail")), pa.array(out, pa.string())], names=["h1", "h2", "head", "tail", "line"])

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _variants(batch)

    lines = written(docs.select("doc_id", "rid", "text").mapInArrow(rows, f"doc_id {kind}, rid long, {_LINE}"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "line_no")
    kinds = written(lines.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count("*").alias("c"), *(F.first(f"k{i}").alias(f"k{i}") for i in range(4))))
    several = kinds.where("c > 1").select("h1", "h2", "place")
    again = lines.join(several, ["h1", "h2"]).where(place != F.col("place")).select("doc_id", "rid", "line_no")

    # lines that share their first or last half with another line
    ends = F.array(*(F.struct(F.col(f"k{i}").alias("half"), F.lit(i % 2 == 0).alias("head")) for i in range(4)))
    halves = kinds.where("k0 is not null").select("h1", F.explode(F.filter(ends, lambda x: x["half"].isNotNull())).alias("x")).select("h1", "x.half", "x.head")
    shared = written(halves.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("half"))
    near = halves.join(shared, "half").groupBy("h1").agg(F.max("head").alias("head"), F.max(~F.col("head")).alias("tail"))
    near = written(near.join(kinds.select("h1", "h2", "place"), "h1"))
    wanted = near.groupBy(F.col("place.doc_id").alias("own_id"), F.col("place.rid").alias("own_rid")).agg(F.sort_array(F.collect_list(F.struct("place.line_no", "h1", "h2", "head", "tail"))).alias("own"))
    held = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["own_id"]) & (docs["rid"] == wanted["own_rid"])).select("text", "own")
    spelt = written(held.mapInArrow(spell, "h1 long, h2 long, head boolean, tail boolean, line string").dropDuplicates(["h1", "h2"]))

    keys = written(spelt.select("h1", "head", "tail", "line").mapInArrow(variants, "key long, lost int, h1 long"))
    met = written(keys.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key"))
    keys = keys.join(met, "key").join(near.select("h1", "h2", "place"), "h1").withColumn("spot", F.struct("place", "h1", "h2"))
    keys = written(keys.select("key", "lost", "spot"))
    cut = keys.where("lost >= 0")
    pairs = [
        cut.join(cut.groupBy("key", "lost").agg(F.min("spot").alias("first")), ["key", "lost"]),
        cut.join(keys.where("lost < 0").groupBy("key").agg(F.min("spot").alias("first")), "key"),
        keys.where("lost < 0").join(cut.groupBy("key").agg(F.min("spot").alias("first")), "key"),
    ]
    late = reduce(DataFrame.unionByName, (p.where("first.place < spot.place").select("spot", "first") for p in pairs)).distinct()
    late = late.select("spot.place", F.col("spot.h1").alias("h1"), F.col("spot.h2").alias("h2"), F.col("first.h1").alias("o1"), F.col("first.h2").alias("o2"))
    late = late.join(spelt.select("h1", "h2", "line"), ["h1", "h2"]).join(spelt.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other")), ["o1", "o2"])
    late = late.select("place", "line", "other").mapInArrow(_within_one, f"place struct<last:boolean,doc_id:{kind},rid:long,line_no:int>").distinct()
    return again.unionByName(late.select("place.doc_id", "place.rid", "place.line_no"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the lines that dropped_lines() names taken out of text; columns n_lines and n_dropped are added, replacing any of that name.

    Lines are ended by line feeds. A null text stays null with no lines; an empty one has one line, which stays.
    Rows with the same doc_id and text are one document: what goes from one goes from all. A text of many lines costs
    their number.
    """
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    docs, earlier = docs.select(*keep).withColumn("rid", F.xxhash64("text")), tables_written()
    gone = dropped_lines(docs, min_words).groupBy(F.col("doc_id").alias("own_id"), F.col("rid").alias("own_rid")).agg(F.collect_set("line_no").alias("gone"))
    gone = written(gone)
    drop_written(earlier, keep=[gone])
    out = docs.join(gone, docs["doc_id"].eqNullSafe(gone["own_id"]) & (docs["rid"] == gone["own_rid"]), "left")
    at = keep.index("text")

    def taken_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, lost = [], [], []
            for value, numbers in zip(batch.column(at).cast(pa.large_binary()), batch.column(len(keep)), strict=True):
                text, numbers = value.as_py(), numbers.as_py()
                n.append(0 if text is None else text.count(b"\n") + 1)
                lost.append(len(numbers or ()))
                if numbers:
                    lines, out = text.split(b"\n"), set(numbers)
                    text = b"\n".join(x for i, x in enumerate(lines) if i not in out)
                texts.append(text)
            columns = [pa.array(texts, pa.large_binary()).cast(batch.schema.field(i).type) if i == at else batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(lost, pa.int64())], names=[*keep, "n_lines", "n_dropped"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return out.select(*keep, "gone").mapInArrow(taken_out, f"{kinds}, n_lines long, n_dropped long")
