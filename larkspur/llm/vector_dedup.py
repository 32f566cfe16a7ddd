"""Near-duplicate vectors by iterative quantisation.

A rotation is learned that makes the signs of the rotated vectors balanced codes of few bits lost. Codes are
cut into bands. In each band's table a vector asks for its own value and for those that its cheapest flips
give: the cost of a bit is how far the vector is from changing its sign there. What is near enough in the
whole code is ranked again by the cosine of the vectors themselves.

How many flips are needed depends on the vectors, so it is measured when the rotation is learned: on sampled vectors
and partners made for them, just near enough and displaced as the sample's vectors differ, a number of flips has to
find RECALL of them. Where none does (vectors so alike that signs tell nothing), each label is multiplied in blocks.

A value of a band that many vectors hold and many ask for is multiplied in blocks, too, so a group of near copies
makes no row for each of its pairs. Each pair that meets belongs to one value of one band, so it is counted once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.components import components
from larkspur.plans.session import dropped, written

#: Vectors the rotation is learned from, about: a sample by hash. Bits of a code, bands of it, rounds of learning.
SAMPLE, BITS, BANDS, ROUNDS = 8_192, 64, 5, 30
#: Numbers of values that a vector may ask for in a band, the bits flipped at once, and the share of made partners to be found.
PROBES, FLIPS, RECALL, MADE = (8, 24, 64, 160, 320), 3, 0.995, 2_000
#: Holders and askers of a value from which it is multiplied in blocks, and the vectors of a block.
HOT, BLOCK = 64, 1_024
_WHOLE = -1


def rotation(sample: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and principal directions rotated so that signs lose least (iterative quantisation); min(dim, BITS) columns."""
    bits, rng = min(dim, BITS), np.random.default_rng(7)
    mean = sample.mean(0) if len(sample) else np.zeros(dim)
    x = sample - mean
    top = np.linalg.eigh(x.T @ x if len(x) else np.eye(dim))[1][:, ::-1][:, :bits]
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    v = x @ top
    for _ in range(ROUNDS if len(v) else 0):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return mean, top @ turn


def _bands(bits: int) -> list[np.ndarray]:
    return [p for p in np.array_split(np.arange(bits), BANDS) if len(p)]


def _flips(size: int) -> np.ndarray:
    """A row for each way to flip up to FLIPS of size bits."""
    ways = [c for k in range(FLIPS + 1) for c in combinations(range(size), k)]
    out = np.zeros((len(ways), size))
    for i, c in enumerate(ways):
        out[i, list(c)] = 1
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bits of unit vectors, and what each costs to flip: 16-bit integers, so that all sums of them are the same everywhere."""
    place = (x - model["mean"]) @ model["turn"]
    return place >= 0, np.minimum(np.floor(place**2 * model["scale"]), 65_535)


def _limits(cost: np.ndarray, probes: int) -> np.ndarray:
    """For each row and band the cost up to which it asks: that of its probes-th cheapest way."""
    out = []
    for p in _bands(cost.shape[1]):
        ways = cost[:, p] @ _flips(len(p)).T
        k = min(probes, ways.shape[1]) - 1
        out.append(np.partition(ways, k, axis=1)[:, k])
    return np.stack(out, 1)


def _asks(differ: np.ndarray, cost: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each row and band whether it asks for the value that differs from its own in these bits."""
    out = []
    for j, p in enumerate(_bands(cost.shape[1])):
        d = differ[:, p]
        out.append(((d * cost[:, p]).sum(1) <= limit[:, j]) & (d.sum(1) <= FLIPS))
    return np.stack(out, 1)


def learned(sample: np.ndarray, dim: int, threshold: float) -> dict:
    """mean, turn, scale, radius (distance at the threshold) and probes, None where signs can't tell."""
    mean, turn = rotation(sample, dim)
    place = (sample - mean) @ turn if len(sample) else np.zeros((1, turn.shape[1]))
    top = max(float(np.quantile(place**2, 0.95)), 1e-30)
    model = {"mean": mean, "turn": turn, "scale": 65_535 / top, "radius": max(0.0, 2 - 2 * threshold) ** 0.5, "probes": PROBES[0]}
    if len(sample) < 2 or model["radius"] == 0:
        return model
    rng = np.random.default_rng(11)
    x, u, v = (sample[rng.integers(len(sample), size=MADE)] for _ in range(3))
    way = u - v + 1e-6 * rng.normal(size=x.shape)
    way -= (way * x).sum(1, keepdims=True) * x
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    y = threshold * x + (1 - threshold**2) ** 0.5 * way  # cosine is the threshold: the hardest partners that count
    (bit_x, cost_x), (bit_y, cost_y) = _coded(x, model), _coded(y, model)
    differ = (bit_x != bit_y).astype(float)
    for probes in PROBES:
        met = (_asks(differ, cost_x, _limits(cost_x, probes)) | _asks(differ, cost_y, _limits(cost_y, probes))).any(1)
        if met.mean() >= RECALL:
            return model | {"probes": probes}
    return model | {"probes": None}


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return values, np.concatenate([[0], np.cumsum(sizes)])


def _signs(batch: pa.RecordBatch, side: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Bits and costs of rows whose codes are equally long."""
    raw = batch.column(f"costs{side}")
    bits = len(raw[0].as_py()) // 2
    cost = np.frombuffer(b"".join(raw.to_pylist()), np.uint16).reshape(len(batch), bits).astype(float)
    code = batch.column(f"code{side}").to_numpy().view(np.uint64)
    return (code[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(bool), cost


def _owned(band: np.ndarray, a: np.ndarray, b: np.ndarray, differ: np.ndarray, cost: tuple, limit: tuple) -> np.ndarray:
    """Of pairs in which a asks for the value of b in band: those that count here, not in an earlier band or the other way round."""
    to, back = _asks(differ, cost[0], limit[0]), _asks(differ, cost[1], limit[1])
    first = (to | back).argmax(1)
    here = np.arange(len(band))
    return (first == band) & to[here, first] & ((a < b) | ~back[here, first])


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Links between vectors of equal label whose cosine is threshold or more.

    vectors: vec_id, embedding (array of float or double), label; other columns are ignored. Returns for each row vec_id,
    n_links (other rows linked directly), component_id (the smallest vec_id of its component), kept (it is that
    one). A null label, and a vector that is null, zero or has a null or non-finite component, links with
    nothing. Vectors of different length do not link; any number of lengths goes, each has a rotation of its own. Equal
    vectors of a label are one class, which other vectors meet once; each of its rows has a link to every other, also
    where they share a vec_id. A null vec_id counts as a row and is never kept, nor names a component.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", "label")
    good = F.expr("label is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = rows.withColumn("node", F.when(good, F.xxhash64("label", F.transform("embedding", lambda x: x + 0.0))))
    classes = written(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"), F.first("label").alias("label")).withColumn("dim", F.size("embedding")))

    tables, last = [], 0
    while True:  # one length after the other
        got = classes.where(F.col("dim") > last).agg(F.min("dim")).first()[0]
        if got is None:
            break
        last = got
        tables.append(_linked(classes.where(F.col("dim") == last), last, threshold))
    if tables:
        found = tables[0]
        for t in tables[1:]:
            found = found.unionByName(t)
    else:
        found = spark.createDataFrame([], "a long, b long, w long")
    found = written(found)
    dropped(*(t for t in tables))
    degree = found.where("w > 0").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("others"))
    roots = classes.select("node", "n", "least").join(components(found.where("b is not null").select("a", "b")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    known = roots.join(least, "root").join(degree, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").where("node is not null").join(known, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked(classes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(a, b, w) of the classes of one length: a has links to w rows besides its own (with b null, or 0 with b, which is in its component)."""
    spark = classes.sparkSession
    share = min(1.0, SAMPLE / classes.count())
    # SAMPLE bounds what is collected
    sample = classes.where(F.pmod(F.col("node"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("node", "embedding").orderBy("node").limit(4 * SAMPLE).toArrow()
    values = sample.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    model = spark.sparkContext.broadcast(learned(_unit(values.reshape(-1, dim)), dim, threshold))
    kind = classes.schema["label"].dataType.simpleString()
    if model.value["probes"] is None:
        sides = classes.select("label", F.lit(_WHOLE).cast("long").alias("key"), "node", F.explode(F.array(F.lit(True), F.lit(False))).alias("asks"))
        counts = classes.groupBy("label").agg(F.count("*").alias("p")).select("label", F.lit(_WHOLE).cast("long").alias("key"), "p", F.col("p").alias("t"))
        full = classes.select("node", "n", "embedding", F.lit(0).cast("long").alias("code"), F.lit(b"").alias("costs"))
        return written(_multiplied(sides, counts, full, model, threshold))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            if not len(batch):
                continue
            values, _ = _matrix(batch.column("embedding"))
            bit, cost = _coded(_unit(values.reshape(-1, dim)), m)
            code = (bit.astype(np.uint64) << np.arange(bit.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)
            limit = _limits(cost, m["probes"])
            own, asked, at = [], [], []
            for j, p in enumerate(_bands(bit.shape[1])):
                flips = _flips(len(p))
                place = 1 << np.arange(len(p), dtype=np.int64)
                key = bit[:, p] @ place | j << 40
                row, way = np.nonzero(cost[:, p] @ flips.T <= limit[:, j, None])
                own.append(key)
                asked.append(key[row] ^ (flips @ place).astype(np.int64)[way])
                at.append(row)
            at, asked = np.concatenate(at), np.concatenate(asked)
            order = np.argsort(at, kind="stable")
            # bits that can differ from a partner's: those that are cheapest until the way is half the squared distance; rounding down costs adds to them
            ranked = np.cumsum(np.sort(cost, axis=1), axis=1)
            far = (ranked <= m["radius"] ** 2 / 2 * m["scale"] + 1).sum(1)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(batch)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "label", "n", "embedding")), pa.array(code.view(np.int64)), pa.array([r.tobytes() for r in cost.astype(np.uint16)], pa.binary()), pa.array(far.astype(np.int32)), pa.array(list(np.stack(own, 1)), pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(asked[order]))],
                names=["node", "label", "n", "embedding", "code", "costs", "far", "bands", "probes"],
            )

    vector = classes.schema["embedding"].dataType.simpleString()
    coded = written(classes.select("node", "label", "n", "embedding").mapInArrow(codes, f"node long, label {kind}, n long, embedding {vector}, code long, costs binary, far int, bands array<long>, probes array<long>"))
    held = coded.select("label", F.explode("bands").alias("key"), F.col("node").alias("b"), F.col("code").alias("code_b"), F.col("far").alias("far_b"))
    asked = coded.select("label", F.explode("probes").alias("key"), F.col("node").alias("a"), F.col("code").alias("code_a"), F.col("far").alias("far_a"))
    counts = asked.groupBy("label", "key").agg(F.count("*").alias("p")).join(held.groupBy("label", "key").agg(F.count("*").alias("t")), ["label", "key"])
    hot = written(counts.where(F.least("p", "t") > HOT))
    pairs = asked.join(hot, ["label", "key"], "left_anti").join(held, ["label", "key"])
    pairs = pairs.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) <= F.greatest("far_a", "far_b"))).select("a", "b", F.shiftright("key", 40).cast("int").alias("band"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            if not len(batch):
                continue
            x, y = (_unit(_matrix(batch.column(c))[0].reshape(-1, dim)) for c in ("x", "y"))
            batch = batch.filter(pa.array((x * y).sum(1) >= threshold))
            if not len(batch):
                continue
            (bit_a, cost_a), (bit_b, cost_b) = _signs(batch, "_a"), _signs(batch, "_b")
            a, b, band = (batch.column(c).to_numpy() for c in ("a", "b", "band"))
            keep = _owned(band, a, b, (bit_a != bit_b).astype(float), (cost_a, cost_b), (_limits(cost_a, m["probes"]), _limits(cost_b, m["probes"])))
            part = batch.filter(pa.array(keep))
            a, b = part.column("a"), part.column("b")
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]), pa.concat_arrays([b, a]), pa.concat_arrays([part.column("n_b"), part.column("n_a")])], names=["a", "b", "w"])

    full = coded.select("node", "n", "embedding", "code", "costs")
    side = lambda s, v: full.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("embedding").alias(v), F.col("code").alias(f"code_{s}"), F.col("costs").alias(f"costs_{s}"))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    links = both.mapInArrow(rank, "a long, b long, w long")
    if hot.isEmpty():
        out = written(links)
    else:
        sides = asked.select("label", "key", F.col("a").alias("node"), F.lit(True).alias("asks")).unionByName(held.select("label", "key", F.col("b").alias("node"), F.lit(False).alias("asks")))
        out = written(links.unionByName(_multiplied(sides, hot, full, model, threshold)))
    dropped(coded, hot)
    return out


def _multiplied(sides: DataFrame, counts: DataFrame, full: DataFrame, model: Broadcast, threshold: float) -> DataFrame:
    """(a, b, w) of the links between askers and holders of the values in counts (label, key, p askers, t holders): for each block of both how many links each of its classes has, and one that joins it to the others."""
    parts = counts.select("label", "key", F.ceil(F.col("p") / BLOCK).cast("int").alias("np"), F.ceil(F.col("t") / BLOCK).cast("int").alias("nt"))
    dealt = sides.join(parts, ["label", "key"])
    own = lambda n: F.pmod(F.hash("node", F.lit(5)), F.col(n))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spots = F.when(F.col("asks"), F.transform(every("nt"), lambda j: F.xxhash64("label", "key", own("np"), j))).otherwise(F.transform(every("np"), lambda i: F.xxhash64("label", "key", i, own("nt"))))
    dealt = dealt.select("key", "node", "asks", F.explode(spots).alias("spot")).join(full, "node")

    def links(block: pa.Table) -> pa.RecordBatch:
        asks = block.column("asks").combine_chunks().to_numpy(zero_copy_only=False)
        ask, hold = (block.filter(pa.array(s)).combine_chunks().to_batches() for s in (asks, ~asks))
        if not ask or not hold:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["a", "b", "w"])
        ask, hold, m = ask[0], hold[0], model.value
        dim = len(m["mean"])
        x, y = (_unit(_matrix(s.column("embedding"))[0].reshape(-1, dim)) for s in (ask, hold))
        a, b = ask.column("node").to_numpy(), hold.column("node").to_numpy()
        key = block.column("key")[0].as_py()
        i, j = np.nonzero((x @ y.T >= threshold) & (a[:, None] < b if key == _WHOLE else a[:, None] != b))
        if key != _WHOLE and len(i):
            (bit_a, cost_a), (bit_b, cost_b) = _signs(ask), _signs(hold)
            limit_a, limit_b = _limits(cost_a, m["probes"]), _limits(cost_b, m["probes"])
            keep = []
            for at in range(0, len(i), 1 << 15):  # bounded memory
                p, q = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                keep.append(_owned(np.full(len(p), key >> 40), a[p], b[q], (bit_a[p] != bit_b[q]).astype(float), (cost_a[p], cost_b[q]), (limit_a[p], limit_b[q])))
            keep = np.concatenate(keep)
            i, j = i[keep], j[keep]
        n_a, n_b = ask.column("n").to_numpy(), hold.column("n").to_numpy()
        w = np.concatenate([np.bincount(i, n_b[j], len(a)), np.bincount(j, n_a[i], len(b))]).astype(np.int64)
        # components of the block: the least place that can be reached, passed on until nothing changes
        root = np.arange(len(w))
        while len(i):
            new = root.copy()
            np.minimum.at(new, i, root[j + len(a)])
            np.minimum.at(new, j + len(a), new[i])
            new = new[new]
            if (new == root).all():
                break
            root = new
        node = np.concatenate([a, b])
        has, joined = w > 0, root != np.arange(len(w))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[has], node[joined]])), pa.concat_arrays([pa.nulls(int(has.sum()), pa.int64()), pa.array(node[root[joined]])]), pa.array(np.concatenate([w[has], np.zeros(int(joined.sum()), np.int64)]))], names=["a", "b", "w"])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            spot = batch.column("spot").to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(spot[1:] != spot[:-1]) + 1, [len(spot)]]) if len(spot) else np.zeros(1, np.int64)
            for begin, end in zip(edge[:-1], edge[1:], strict=True):
                if held and held[-1].column("spot")[0].as_py() != spot[begin]:
                    yield links(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield links(pa.Table.from_batches(held))

    return dealt.repartition("spot").sortWithinPartitions("spot").mapInArrow(product, "a long, b long, w long")
