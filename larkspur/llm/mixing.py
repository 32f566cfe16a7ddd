"""Mixing sources to target weights, by a curriculum that changes over time. DataFrame functions only.

Each source has a target of words and a schedule, its weight at any time of training from 0 to 1. The
integral of the schedule is the source's demand up to that time. Documents stand in a source in the order of a
hash; the words before a document are its place in the demand, and the time when the demand gets there is its
position. Sorting by position mixes the sources as scheduled. A source whose target is above its size goes
round again; one whose target is below it stops early.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.llm import tokens
from larkspur.operators.relational import running
from larkspur.plans.session import broadcast_if_small, written

#: Weights of sources in code point order, repeating; copies of a document at most.
WEIGHTS, MAX_COPIES = (5, 2, 1), 3
#: Schedules for the weights in turn: weights at equal steps of time, linear between them, only their shape counts.
SCHEDULES = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))
#: Parts that a source is counted in; inside one, words are summed document by document.
CELLS = 1024
#: The order of the mix: by position; the rest tells copies at one position apart.
ORDER = ("position", "doc_id", "copy", "rank", "place", "size")
#: Columns that placed() adds or uses on its way.
ADDED = {"size", "source_size", "target", "rank", "place", "copies", "taken", "_key", "_cell", "_source", "_own_cell", "_before"}
_WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """sizes (source, source_size) with rank and target.

    Targets share the sum of all sizes by weight. One above max_copies times its size stops there, and what
    it leaves is shared by weight among the others, until none is above. Sources reach their bound in
    the order of bound to weight, so one pass over them in that order finds who does. Sums run range by range, so sources can be many.
    """
    bounded = running(sizes, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")})
    bounded = bounded.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")).withColumn("bound", max_copies * F.col("source_size"))
    leveled = running(bounded, [(F.col("bound") / F.col("w")).asc(), F.asc("rank")], {"bound_before": F.col("bound"), "w_before": F.col("w")})
    leveled = written(leveled)
    whole = leveled.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    leveled = leveled.join(F.broadcast(whole)).withColumn("level", (F.col("all_size") - F.col("bound_before")) / (F.col("all_w") - F.col("w_before")))  # one row
    leveled = leveled.withColumn("open", F.col("level") * F.col("w") <= F.col("bound"))
    final = leveled.where("open").agg(F.min(F.struct(F.col("bound") / F.col("w"), "rank", "level")).alias("final"))
    return leveled.join(F.broadcast(final)).select("source", "source_size", "rank", F.when(F.col("open"), F.col("final.level") * F.col("w")).otherwise(F.col("bound").cast("double")).alias("target"))  # one row


def placed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """docs with size, source_size, target, rank, place (words of the source before it) and copies taken.

    A copy is taken if its middle is within the target, so a source misses its target by half a document at
    most. Documents are ordered by a hash of doc_id (of the text where that is null), then doc_id, size and a hash of the
    text: rows that share an id and source stand one after the other. Null and empty texts have size 0; a null source is a
    source, the last; a text of any length is one document. Columns of the names given are replaced.
    """
    docs = docs.select(*(c for c in docs.columns if c.lower() not in ADDED))
    named = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    key = F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long")
    sized = docs.withColumn("size", words()).withColumn("_key", key)
    sized = sized.withColumn("_cell", (F.col("_key") / ((1 << 32) // CELLS)).cast("int"))
    # CELLS rows for each source at most
    cells = written(sized.groupBy("source", F.col("_cell").alias("cell")).agg(F.sum("size").alias("cell_size")))
    before = F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell")) - F.col("cell_size")
    table = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, max_copies).withColumnRenamed("source", "_source")
    cells = cells.withColumn("_before", before)
    cells = written(cells.join(table, cells["source"].eqNullSafe(table["_source"])).select("_source", F.col("cell").alias("_own_cell"), "_before", "source_size", "target", "rank"))
    # a part in CELLS of a source at a time
    inside = Window.partitionBy("source", "_cell").orderBy("_key", "doc_id", "size", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    out = sized.withColumn("place", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(broadcast_if_small(cells), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_cell") == F.col("_own_cell")))
    out = out.withColumn("place", F.col("_before") + F.col("place"))
    copies = sum(((e * F.col("source_size") + F.col("place") + F.col("size") / 2) < F.col("target")).cast("int") for e in range(max_copies))
    return out.withColumn("copies", copies).drop("_key", "_cell", "_source", "_own_cell", "_before")


def _segments(knots: Sequence[float]) -> list[tuple[float, float, float, float]]:
    """(start, area before, weight at start, half the slope) of each linear piece, the whole area scaled to 1."""
    step, area, out = 1 / (len(knots) - 1), 0.0, []
    total = sum((a + b) / 2 * step for a, b in zip(knots, knots[1:], strict=False))
    for i, (a, b) in enumerate(zip(knots, knots[1:], strict=False)):
        out.append((i * step, area / total, a / total, (b - a) / step / 2 / total))
        area += (a + b) / 2 * step
    return out


def _time(share: Column, schedule: Column) -> Column:
    """When a schedule's demand reaches share of its whole: the quadratic of the piece that holds it, solved for time."""
    piece = F.element_at(F.filter(schedule, lambda g: g["area"] <= share), -1)
    left = share - piece["area"]
    root = F.sqrt(piece["w"] * piece["w"] + 4 * piece["half"] * left)
    return piece["t"] + 2 * left / F.when(piece["w"] + root == 0, F.lit(1.0)).otherwise(piece["w"] + root)


def copied(out: DataFrame, schedules: Sequence[Sequence[float]] = SCHEDULES, by_source: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """A row of a table as placed() gives it for each copy that is taken, with copy (from 0) and position (0 to 1)."""
    as_column = lambda knots: F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("t", "area", "w", "half"), g, strict=True))) for g in _segments(knots)))
    schedule = F.element_at(F.array(*map(as_column, schedules)), (F.col("rank") % len(schedules) + 1).cast("int"))
    for source, knots in (by_source or {}).items():
        schedule = F.when(F.col("source").eqNullSafe(F.lit(source)), as_column(knots)).otherwise(schedule)
    out = out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    share = F.least((F.col("copy") * F.col("source_size") + F.col("place")) / F.greatest("target", F.lit(1.0)), F.lit(1.0))
    return out.withColumn("position", _time(share, schedule))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES, schedules: Sequence[Sequence[float]] = SCHEDULES, by_source: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """A row of docs for each copy that is taken, with copy (from 0), position (0 to 1), sorted by position.

    by_source gives schedules of single sources; the others have those of `schedules` in turn. Documents
    without words come once at their place if that is within the target.
    """
    docs = docs.select(*(c for c in docs.columns if c.lower() not in {"copy", "position"}))
    docs, back = tokens.set_aside(docs, ADDED)  # those that only clash on the way stay
    return copied(placed(docs, weights, max_copies), schedules, by_source).orderBy(*ORDER).select(*back, "copy", "position")


def taken(docs: DataFrame) -> DataFrame:
    """What mix() makes of every row of docs: doc_id, size, source_size, target, taken, position, mix_rows.

    taken is the words of all its copies, position that of its first copy, null if none is taken. mix_rows are the numbers,
    from 0, of its copies among the rows of the mix, in order and joined by commas. Copies are sorted without their texts.
    """
    kept = ["doc_id", "size", "source_size", "target"]
    out = written(placed(docs).select(*kept, "source", "rank", "place", "copies", F.monotonically_increasing_id().alias("_row")))
    mixed = running(copied(out), [*ORDER, "_row"], {"number": F.lit(1).cast("long")})
    numbers = F.array_join(F.sort_array(F.collect_list("number")).cast("array<string>"), ",")
    some = mixed.groupBy("_row", *kept).agg(F.sum("size").alias("taken"), F.min("position").alias("position"), numbers.alias("mix_rows")).drop("_row")
    none = out.where("copies = 0").select(*kept, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("double").alias("position"), F.lit("").alias("mix_rows"))
    return some.unionByName(none)
