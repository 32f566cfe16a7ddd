"""Relational building blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def group_by(df: DataFrame, keys: Sequence[str], max_of: Sequence[str] = (), min_of: Sequence[str] = (), sum_of: Sequence[str] = (), peek: Sequence[str] = (), peek_rest: bool = True) -> DataFrame:
    """One row for each group, with a reducer for each column; of several the first of max, min, sum, peek counts.

    Arrays are reduced element by element, maps (sparse vectors) index by index. Peek takes the smallest value, so that
    reruns agree; of arrays and maps any. Columns keep the order of df; those with no reducer are peeked at, or left out without peek_rest.
    """
    kinds, plain, wide = dict(df.dtypes), [], {}
    for c in df.columns:
        if c in keys:
            continue
        name = next((n for n, cols in (("max", max_of), ("min", min_of), ("sum", sum_of), ("peek", peek)) if c in cols), "peek" if peek_rest else None)
        if name is None:
            continue
        if name != "peek" and kinds[c].startswith(("array", "map")):
            wide[c] = name
        else:
            plain.append(({"max": F.max, "min": F.min, "sum": F.sum}.get(name) or (F.first if kinds[c].startswith("map") else F.min))(c).alias(c))
    got = df.groupBy(*keys).agg(*plain) if plain else df.select(*keys).distinct()
    for c, name in wide.items():
        part = elementwise(df, keys, c, name).select(*(F.col(k).alias(f"_{k}") for k in keys), c)
        same = reduce(lambda a, b: a & b, (got[k].eqNullSafe(part[f"_{k}"]) for k in keys))
        got = got.join(part, same, "left").drop(*(f"_{k}" for k in keys))
    return got.select(*(c for c in df.columns if c in got.columns))


def elementwise(df: DataFrame, keys: Sequence[str], c: str, name: str) -> DataFrame:
    """(keys, c) with the max, min or sum of arrays by position, or of maps by index: elements are reduced by partial aggregates, no group's vectors are held together."""
    step = {"max": F.max, "min": F.min, "sum": F.sum}[name]
    sparse = dict(df.dtypes)[c].startswith("map")
    parts = df.select(*keys, F.explode(c).alias("_i", "_x")) if sparse else df.select(*keys, F.posexplode(F.col(c).cast("array<double>")).alias("_i", "_x"))
    cells = parts.groupBy(*keys, "_i").agg(step("_x").alias("_x"))
    pairs = F.array_sort(F.collect_list(F.struct("_i", "_x")))
    return cells.groupBy(*keys).agg((F.map_from_entries(pairs) if sparse else F.transform(pairs, lambda p: p["_x"])).alias(c))


def running(df: DataFrame, order: Sequence[Column | str], sums: Mapping[str, Column]) -> DataFrame:
    """df with, for each name of sums, the sum of its column over all rows before a row by order, 0 for the first.

    Rows are dealt to range partitions and written once; sums of partitions (a row each) give what is before a
    partition, a window inside it the rest, so no task holds more than a partition. order has to tell rows apart.
    """
    from larkspur.plans.session import written

    cols = [F.asc(c) if isinstance(c, str) else c for c in order]
    dealt = df.withColumns({f"_{n}": c for n, c in sums.items()}).repartitionByRange(*cols).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt)
    parts = dealt.groupBy("_part").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in sums))
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *(F.sum(f"_{n}").over(whole).alias(f"_{n}_before") for n in sums))
    inside = Window.partitionBy("_part").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = dealt.withColumns({n: F.sum(f"_{n}").over(inside) for n in sums}).join(F.broadcast(parts), "_part")  # a row for each partition
    return out.withColumns({n: zero(F.col(n)) + zero(F.col(f"_{n}_before")) for n in sums}).select(*df.columns, *sums)


def add_id(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """A dense id from 1 in the order given, which has to tell rows apart."""
    return running(df, order, {column: F.lit(1).cast("long")}).withColumn(column, F.col(column) + 1)


def dense_rank(df: DataFrame, column: str, order: Sequence[Column]) -> DataFrame:
    """The number, from 1, of a row's value among the distinct values of order: these are numbered, and rows get theirs by a join."""
    keys = {f"_k{i}": c for i, c in enumerate(order)}
    values = df.select(*(c.alias(n) for n, c in keys.items())).distinct()
    ranked = running(values, [F.asc(n) for n in keys], {column: F.lit(1).cast("long")}).withColumn(column, F.col(column) + 1)
    same = reduce(lambda a, b: a & b, (c.eqNullSafe(ranked[n]) for n, c in keys.items()))
    return df.join(ranked, same).drop(*keys)


def ancestors(df: DataFrame, path: str) -> DataFrame:
    """A row for each prefix of an array path."""
    return df.withColumn(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.slice(path, 1, i))))


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def tag_tfidf(df: DataFrame, tag: str, tokens: str, normal: bool = True) -> DataFrame:
    """(tag, token, score): tf * ln(tags / tags with the token), over distinct token sequences; each tag's scores sum to 1 if normal."""
    from larkspur.plans.session import written

    rows = df.select(tag, tokens).withColumn("_h", F.struct(F.xxhash64(tokens), F.hash(tokens), F.size(tokens)))
    # equal sequences meet by their hash
    tf = written(rows.groupBy(tag, "_h").agg(F.first(tokens).alias("_t")).select(tag, F.explode("_t").alias("token")).groupBy(tag, "token").agg(F.count("*").alias("tf")))
    n = tf.agg(F.countDistinct(tag).alias("tags"))
    df_ = tf.groupBy("token").agg(F.count("*").alias("df"))
    scored = tf.join(df_, "token").join(F.broadcast(n)).withColumn("s", F.col("tf") * F.log(F.col("tags") / F.col("df")))  # one row
    score = F.try_divide(F.col("s"), F.sum("s").over(Window.partitionBy(tag))) if normal else F.col("s")
    return scored.withColumn("score", score).select(tag, "token", "score")


def cooccurrence(df: DataFrame, key: str, tokens: str, entity: str) -> DataFrame:
    """(token, coo, lift, score) of tokens in rows that hold entity: lift is (coo / entity rows) / (token rows / rows)."""
    rows = df.select(key, F.array_distinct(tokens).alias("t")).withColumn("e", F.array_contains("t", entity))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.col("e").cast("long")).alias("ne"))
    counts = rows.select("e", F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("c"), F.sum(F.col("e").cast("long")).alias("coo")).where((F.col("coo") > 0) & (F.col("token") != F.lit(entity)))
    lift = (F.col("coo") / F.col("ne")) / (F.col("c") / F.col("n"))
    return counts.join(F.broadcast(total)).select("token", "coo", lift.alias("lift"), (F.col("coo") * lift).alias("score"))  # one row


def fold_log(df: DataFrame, key: str, ts: str, kind: str, value: str) -> DataFrame:
    """The last state of each entity of a log: a delete sticks until a create; the newest non-null value wins since the last create."""
    rank = F.struct(ts, kind, value)
    last_create = F.max(F.when(F.col(kind) == "create", rank))
    seen = df.groupBy(key).agg(last_create.alias("made"), F.max(F.when(F.col(kind) == "delete", rank)).alias("gone"))
    rows = df.join(seen, key).where(F.col("made").isNull() | (rank >= F.col("made"))).where(F.col("gone").isNull() | (F.col("made") > F.col("gone")))
    return rows.groupBy(key).agg(F.max_by(value, F.when(F.col(value).isNotNull(), rank)).alias(value), F.max(ts).alias(ts))


def distribution(shares: Sequence[float], tolerance: float = 0.01, most: int = 100) -> list[int]:
    """Positions by turn, each to the fold that is furthest below its share, until shares are met within tolerance."""
    out: list[int] = []
    while len(out) < most:
        now = [out.count(i) / len(out) if out else 0.0 for i in range(len(shares))]
        if out and sum(abs(a - b) for a, b in zip(shares, now, strict=True)) <= tolerance:
            break
        out.append(max(range(len(shares)), key=lambda i: (shares[i] - now[i], -i)))
    return out


def hash_fold(cols: Sequence[str], folds: int, seed: int = 0) -> Column:
    """A fold by hash of columns, so that a group never straddles two."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(folds))


def random_split(df: DataFrame, folds: int = 1, train: float = 0.75, group: Sequence[str] = (), strata: Sequence[str] = (), seed: int = 38) -> list[tuple[DataFrame, DataFrame]]:
    """(train, test) pairs: one by ratio for a single fold, else each fold is the test once. With strata each of their values is split by rank."""
    cols = list(group) or df.columns
    if strata:
        w = Window.partitionBy(*strata)
        at = (F.row_number().over(w.orderBy(F.xxhash64(*cols, F.lit(seed)), *df.columns)) - 1) / F.count("*").over(w)
    else:
        at = F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    marked = df.withColumn("_at", at)
    bounds = [(train, 1.0)] if folds <= 1 else [(i / folds, (i + 1) / folds) for i in range(folds)]
    return [(marked.where(~F.col("_at").between(b, e) | (F.col("_at") == e)).drop("_at"), marked.where((F.col("_at") >= b) & (F.col("_at") < e)).drop("_at")) for b, e in bounds]


def rank_split(df: DataFrame, order: Sequence[str], shares: Sequence[float], group: Sequence[str] = (), measure: str | None = None) -> DataFrame:
    """fold by turns of the distribution of shares over dense ranks, descending.

    With group, all rows of a group get its fold; groups are ranked by their columns, then by measure of the columns of order:
    sum, avg or count.
    """
    turns = distribution(shares)
    take = F.element_at(F.array(*map(F.lit, turns)), ((F.col("_rank") - 1) % len(turns) + 1).cast("int"))
    if not group:
        return dense_rank(df, "_rank", [_descending(df, c) for c in order]).withColumn("fold", take).drop("_rank")
    of = {"sum": F.sum, "avg": F.avg, "count": F.count}[measure or "sum"]
    groups = df.groupBy(*group).agg(*(of(c).alias(f"_m{i}") for i, c in enumerate(order)))
    ranked = running(groups, [*(F.desc(c) for c in group), *(F.desc(f"_m{i}") for i in range(len(order)))], {"_rank": F.lit(1).cast("long")}).withColumn("_rank", F.col("_rank") + 1)
    ranked = ranked.select(*(F.col(c).alias(f"_{c}") for c in group), take.alias("fold"))
    same = reduce(lambda a, b: a & b, (df[c].eqNullSafe(ranked[f"_{c}"]) for c in group))
    return df.join(ranked, same).drop(*(f"_{c}" for c in group))


def _descending(df: DataFrame, c: str) -> Column:
    """A number that sorts the other way; text and others by a struct are not turned, so they are refused."""
    kind = dict(df.dtypes)[c]
    if kind in ("date", "timestamp"):
        return -F.unix_micros(F.col(c).cast("timestamp"))
    if kind in ("string", "binary", "boolean") or kind.startswith(("array", "map", "struct")):
        raise ValueError(f"{c} is no number")
    return -F.col(c)


def curves(df: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, tp, fp, tn, fn, precision, recall, fpr, f1 and _area (what it adds to the area under the ROC curve) for each distinct score; positive means score >= threshold.

    Scores are first summed by value; their running sums are made range by range.
    """
    s, y = F.col(f"`{score}`"), F.col(f"`{label}`")
    by = df.where(s.isNotNull() & y.isNotNull()).groupBy(s.alias("threshold")).agg(F.sum((y == 1).cast("long")).alias("p"), F.sum((y != 1).cast("long")).alias("n"))
    total = by.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("ap"), F.coalesce(F.sum("n"), F.lit(0)).alias("an"))
    out = running(by, [F.desc("threshold")], {"tp": F.col("p"), "fp": F.col("n")}).join(F.broadcast(total))  # one row
    # what a threshold adds to the area under the ROC curve: its negatives by the mean of the positives before and after
    out = out.withColumn("_area", F.try_divide(F.col("n") * (F.col("tp") + F.col("p") / 2), F.col("ap") * F.col("an")))
    out = out.select("threshold", (F.col("tp") + F.col("p")).alias("tp"), (F.col("fp") + F.col("n")).alias("fp"), "ap", "an", "_area")
    out = out.select("threshold", "tp", "fp", (F.col("an") - F.col("fp")).alias("tn"), (F.col("ap") - F.col("tp")).alias("fn"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp"), F.col("ap")).alias("recall"), F.try_divide(F.col("fp"), F.col("an")).alias("fpr"), "_area")
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def area_under_roc(curve: DataFrame) -> DataFrame:
    """auc of what curves() gives, one row."""
    return curve.agg(F.sum("_area").alias("auc"))


def optimal_threshold(curve: DataFrame, optimize: str = "f1") -> DataFrame:
    """The row of curves() that is best: f1, precision:x, recall:x, prec/recall:x or accuracy; threshold 0 if none meets x."""
    kind, _, at = optimize.partition(":")
    x = float(at or 0)
    rows, by = {
        "precision": (curve.where(F.col("precision") >= x), F.struct("recall", "threshold")),
        "recall": (curve.where(F.col("recall") >= x), F.struct("precision", "threshold")),
        "prec/recall": (curve.where("recall > 0"), F.struct(-F.abs(F.col("precision") / F.col("recall") - x), "threshold")),
        "accuracy": (curve, F.struct(F.col("tp") + F.col("tn"), "threshold")),
    }.get(kind, (curve, F.struct("f1", "threshold")))
    columns = [c for c in curve.columns if c != "_area"]
    best = rows.agg(F.max_by(F.struct(*columns), by).alias("b"))
    return best.select(F.coalesce("b.threshold", F.lit(0.0)).alias("threshold"), *(F.col(f"b.{c}").alias(c) for c in columns if c != "threshold"))


def base_threshold(curve: DataFrame) -> DataFrame:
    """The row of curves() at the least threshold of one half or more, else at the greatest below."""
    t = F.col("threshold")
    return curve.drop("_area").orderBy((t < 0.5).asc(), F.when(t >= 0.5, t).asc(), t.desc()).limit(1)


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def top_n(rows: Column, n: int, smallest: bool = False) -> Column:
    """The n greatest or smallest elements of an array, in order."""
    ordered = F.sort_array(rows, asc=smallest)
    return F.slice(ordered, 1, n)


def zip_longest(a: Column, b: Column, default_a: Column, default_b: Column) -> Column:
    """An array of structs a, b of both arrays' elements, the shorter one filled up with its default, and nulls, too."""
    return F.zip_with(a, b, lambda x, y: F.struct(F.coalesce(x, default_a).alias("a"), F.coalesce(y, default_b).alias("b")))
