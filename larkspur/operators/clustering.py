"""Constrained clustering of phrases, and a binary hierarchy over its clusters."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from larkspur.functions import vectors as V
from larkspur.operators import relational as R
from larkspur.plans.session import dropped, written

# --- distances


def weight(size: float, of: str = "distance") -> float:
    """How much nearer a phrase counts to a centre made for a badly tagged phrase: size ** 0.5 / size ** 0.4 of phrases like it."""
    return size**0.5 / size**0.4 if size > 0 else 1.0


def weighted_centroid(a: Sequence[float], n: float, b: Sequence[float], m: float) -> list[float]:
    return [(x * n + y * m) / (n + m) for x, y in zip(a, b, strict=True)]


#: Distances that a task holds at once, phrases times centres.
CELLS = 1 << 21


def _nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of distances the first of the least, rounded to 12 digits, and that; only what is next to the least is rounded."""
    low = d.min(1)
    row, column = np.nonzero(~(d > low[:, None] + 2e-12))
    value = np.round(d[row, column], 12)
    order = np.lexsort((column, value, row))
    first = order[np.unique(row[order], return_index=True)[1]]
    return column[first], value[first]


def assigned(phrases: DataFrame, centres: Sequence[tuple[int, Sequence[float], float]], onward: Mapping[int, Sequence[int]] | None = None) -> DataFrame:
    """phrases (vector and more) with cluster and distance, that of the nearest of centres (id, vector, weight), the least id of equals.

    Distance is 1 - cosine, times the centre's weight; a zero vector is 1 away from all. A phrase whose nearest centre is a key of onward
    goes to the nearest of the centres listed there. Centres are held by every task, and phrases multiplied with them a
    block of CELLS at a time; k and the length of vectors bound that.
    """
    centres = sorted(centres, key=lambda c: c[0])
    ids = np.array([c[0] for c in centres], np.int64)
    matrix = np.array([c[1] for c in centres], float).reshape(len(centres), -1)
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    # the few different lists of centres to go on to, by position, and which of them each centre has
    at, lists, kinds = {c: i for i, c in enumerate(ids.tolist())}, {}, np.full(len(ids), -1)
    for i, some in (onward or {}).items():
        kinds[at[i]] = lists.setdefault(tuple(sorted(at[c] for c in some)), len(lists))
    held = phrases.sparkSession.sparkContext.broadcast((ids, matrix / np.where(size == 0, 1, size), np.array([c[2] for c in centres], float), kinds, [np.array(x) for x in lists]))

    @F.pandas_udf("cluster long, distance double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, unit, weights, kinds, lists = held.value
        rows = max(1, min(4096, CELLS // len(names)))
        for vectors in batches:
            out_id, out_d = [], []
            for at in range(0, len(vectors), rows):
                x = np.stack([np.asarray(v, float) for v in vectors[at : at + rows]])
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(n == 0, 1, n)
                best, d = _nearest((1 - x @ unit.T) * weights)
                kind = kinds[best]
                for j in np.unique(kind[kind >= 0]):
                    some = kind == j
                    again, d[some] = _nearest((1 - x[some] @ unit[lists[j]].T) * weights[lists[j]])
                    best[some] = lists[j][again]
                out_id.append(names[best])
                out_d.append(d)
            yield pd.DataFrame({"cluster": np.concatenate(out_id) if out_id else [], "distance": np.concatenate(out_d) if out_d else []})

    return phrases.withColumn("_n", nearest("vector")).select(*phrases.columns, F.col("_n.cluster").alias("cluster"), F.col("_n.distance").alias("distance"))


def means(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector, n): the mean of each group's vectors by position."""
    cells = table.select(key, F.posexplode(vector).alias("_i", "_x")).groupBy(key, "_i").agg(F.avg("_x").alias("_x"))
    rows = table.groupBy(key).agg(F.count("*").alias("n"))
    return cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda p: p["_x"]).alias(vector)).join(rows, key)


# --- constrained k-means


@dataclass
class Clustering:
    """centres: id to vector; tags: id to the tags it holds; cost: mean distance of each round."""

    centres: dict[int, list[float]]
    tags: dict[int, set[str]] = field(default_factory=dict)
    cost: list[float] = field(default_factory=list)


def constrained_kmeans(phrases: DataFrame, k: int, min_rounds: int = 2, max_rounds: int = 20, start: Clustering | None = None, seed: int = 38) -> tuple[DataFrame, Clustering]:
    """phrases (phrase_id, vector, tags, not_tags: arrays, empty or null for most) with cluster and distance, and the clustering.

    A round: centres are the means of the last assignment, or those of start, or else the first phrase of each tag; phrases in the
    order of a hash, each vector once, fill up to k. Each tag goes to the centre that is nearest to its phrases' mean,
    nearest first, one to a centre. A tagged phrase whose nearest centre has another tag, or one that it must not have,
    makes a centre of its own for this round, under a negative id, so that phrases like it leave the wrong one; these then go to the nearest centre with the
    tag, or without any. It ends when the mean distance no longer falls after min_rounds, or after max_rounds. Tagged phrases are
    made by hand, so the driver and each task hold them; a round multiplies all phrases with those that make a centre once. Everything else is sums over all phrases.
    """
    rows = phrases.withColumn("vector", V.dense("vector")).where("vector is not null")
    hand = rows.where("size(tags) > 0 or size(not_tags) > 0").select("phrase_id", "vector", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("not_tags", F.array().cast("array<string>")).alias("not_tags")).orderBy("phrase_id").collect()
    by_tag: dict[str, list] = {}
    for r in hand:
        for t in r.tags:
            by_tag.setdefault(t, []).append(np.array(r.vector))
    centres = dict(start.centres) if start else {i: list(by_tag[t][0]) for i, t in enumerate(sorted(by_tag)[:k])}
    # each vector once, k of them at most
    spread = rows.groupBy(F.xxhash64("vector").alias("h")).agg(F.min_by("vector", "phrase_id").alias("v")).orderBy(F.xxhash64("h", F.lit(seed)), "h").limit(k + len(centres)).collect()
    known = {tuple(np.round(c, 12)) for c in centres.values()}
    for r in spread:
        if len(centres) < k and tuple(np.round(r.v, 12)) not in known:
            known.add(tuple(np.round(r.v, 12)))
            centres[max(centres, default=-1) + 1] = list(r.v)
    out, costs, last = None, [], None
    while True:
        tags = _dealt(by_tag, centres)
        forced = _forced(hand, centres, tags)
        now = assigned(rows, [*((i, c, 1.0) for i, c in centres.items()), *((-1 - j, v, weight(n)) for j, (v, _, n) in enumerate(forced))], _onward(forced, centres, tags))
        before, out = out, written(now)
        if before is not None:
            dropped(before)
        cost = out.agg(F.avg("distance")).first()[0] or 0.0
        costs.append(cost)
        if len(costs) >= max_rounds or len(costs) >= min_rounds and last is not None and cost >= last - 1e-12:
            return out, Clustering(centres, tags, costs)
        last = cost
        # k rows
        centres = centres | {r.cluster: list(r.vector) for r in means(out.where("cluster >= 0"), "cluster", "vector").collect()}


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / size) if size else 0.0


def _dealt(by_tag: Mapping[str, list], centres: Mapping[int, Sequence[float]]) -> dict[int, set[str]]:
    """Each tag's centre: pairs are taken nearest first, a centre has one tag."""
    middle = {t: np.mean(v, axis=0) for t, v in by_tag.items()}
    pairs = sorted((round(1 - _cosine(v, np.array(c)), 12), t, i) for t, v in middle.items() for i, c in centres.items())
    out: dict[int, set[str]] = {}
    placed: set[str] = set()
    for _, t, i in pairs:
        if t not in placed and i not in out:
            out[i] = {t}
            placed.add(t)
    return out


def _forced(hand: Sequence, centres: Mapping[int, Sequence[float]], tags: Mapping[int, set[str]]) -> list[tuple[np.ndarray, set[str], int]]:
    """(vector, its tags, phrases with that vector) of tagged phrases whose nearest centre does not suit them."""
    found: dict[tuple, list] = {}
    ids = sorted(centres)
    matrix = np.array([centres[i] for i in ids], float)
    unit = lambda m: m / np.where((size := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, size)
    for at in range(0, len(hand), rows := max(1, CELLS // len(ids))):
        some = hand[at : at + rows]
        near, _ = _nearest(1 - unit(np.array([r.vector for r in some], float)) @ unit(matrix).T)
        for r, i in zip(some, near, strict=True):
            own = tags.get(ids[i], set())
            if r.tags and own and not own & set(r.tags) or own & set(r.not_tags):
                found.setdefault(tuple(r.vector), [np.array(r.vector), set(r.tags), 0])[2] += 1
    return [tuple(x) for _, x in sorted(found.items())]


def _onward(forced: Sequence, centres: Mapping[int, Sequence[float]], tags: Mapping[int, set[str]]) -> dict[int, list[int]]:
    """Where phrases of the centres made for this round go: to the nearest lasting centre with their tag, else to the nearest without any, else to the nearest."""
    return {-1 - j: [i for i in centres if wanted & tags.get(i, set())] or [i for i in centres if not tags.get(i)] or list(centres) for j, (_, wanted, _) in enumerate(forced)}


# --- hierarchy


@dataclass
class Tree:
    """centre: sum of the clusters below; tags: those that all have; ids: the clusters below."""

    centre: np.ndarray
    tags: frozenset
    ids: tuple
    children: tuple = ()


def hierarchy(centres: Mapping[int, Sequence[float]], tags: Mapping[int, set[str]] | None = None) -> dict[int, list[int]]:
    """The path of each cluster from the root, as child numbers: a binary tree over k clusters, built level by level.

    A level of n nodes has 2 ** (ceil(log2(n)) - 1) parents. Nodes of one tag are paired first, nearest first, then the rest. While there are
    too many parents two are put together, such with a tag in common last; while there are too few a pair is parted, untagged ones
    first. A parent's centre is the sum, its tags are those that both have. Clusters are few, so this runs on the driver.
    """
    tags = tags or {}
    level = [Tree(np.array(c, float), frozenset(tags.get(i, ())), (i,)) for i, c in sorted(centres.items())]
    while len(level) > 1:
        wanted = 2 ** (int(np.ceil(np.log2(len(level)))) - 1)
        groups = _paired(level)
        while len(groups) > wanted:  # the nearest of those whose union loses least
            a, b = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: _union_cost(groups[p[0]], groups[p[1]], p))
            groups[a] += groups.pop(b)
        while len(groups) < wanted:
            i = min((i for i, g in enumerate(groups) if len(g) > 1), key=lambda i: (bool(frozenset.intersection(*(t.tags for t in groups[i]))), i))
            groups.append([groups[i].pop()])
        level = [g[0] if len(g) == 1 and len(level) == len(groups) else Tree(sum(t.centre for t in g), frozenset.intersection(*(t.tags for t in g)), tuple(x for t in g for x in t.ids), tuple(g)) for g in groups]
    out: dict[int, list[int]] = {}

    def walk(node: Tree, path: list[int]) -> None:
        if not node.children:
            out[node.ids[0]] = path
        for n, child in enumerate(node.children):
            walk(child, [*path, n])

    for root in level:
        walk(root, [0])
    return out


def _paired(level: Sequence[Tree]) -> list[list[Tree]]:
    left, groups = list(range(len(level))), []
    near = sorted((round(1 - _cosine(level[i].centre, level[j].centre), 12), i, j) for i in left for j in left if i < j)
    for tagged in (True, False):
        for _, i, j in near:
            if i in left and j in left and (bool(level[i].tags & level[j].tags) if tagged else not (level[i].tags and level[j].tags)):
                groups.append([level[i], level[j]])
                left.remove(i)
                left.remove(j)
    return groups + [[level[i]] for i in left]


def _union_cost(a: Sequence[Tree], b: Sequence[Tree], place: tuple) -> tuple:
    own = [frozenset.intersection(*(t.tags for t in g)) for g in (a, b)]
    apart = bool(own[0]) and bool(own[1]) and not own[0] & own[1]
    return apart, len(a) + len(b), round(1 - _cosine(sum(t.centre for t in a), sum(t.centre for t in b)), 12), place


def hierarchy_stats(phrases: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, phrases, cost, documents) of every node: phrases (doc_id, cluster, distance), paths (cluster, path)."""
    rows = phrases.join(paths, "cluster").groupBy("doc_id", "path").agg(F.count("*").alias("n"), F.sum("distance").alias("cost"))
    return R.ancestors(rows, "path").groupBy("doc_id", "path").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost")).groupBy("path").agg(F.sum("n").alias("phrases"), F.sum("cost").alias("cost"), F.count("*").alias("documents"))


def cluster_quality(phrases: DataFrame, clustering: Clustering) -> DataFrame:
    """One row: phrases, clusters, empty (centres without a phrase), cost, tagged (tagged phrases), kept (those whose cluster has one of their tags), wrong (those whose cluster has a tag that they must not have)."""
    own = F.create_map(*(x for i, t in clustering.tags.items() for x in (F.lit(i), F.array(*map(F.lit, sorted(t)))))) if clustering.tags else F.lit(None).cast("map<int,array<string>>")
    tags = F.coalesce(own[F.col("cluster").cast("int")], F.array().cast("array<string>"))
    has = F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0
    return phrases.agg(
        F.count("*").alias("phrases"), F.countDistinct("cluster").alias("clusters"), (F.lit(len(clustering.centres)) - F.countDistinct("cluster")).alias("empty"), F.avg("distance").alias("cost"),
        F.sum(has.cast("long")).alias("tagged"), F.sum((has & F.arrays_overlap("tags", tags)).cast("long")).alias("kept"), F.sum(F.coalesce(F.arrays_overlap("not_tags", tags), F.lit(False)).cast("long")).alias("wrong"),
    )


def top_words(words: DataFrame, paths: DataFrame, most: int = 100) -> DataFrame:
    """(path, word, n, rank) of the words that most phrases of a node have: words (cluster, word), each node has those of its clusters."""
    counts = words.groupBy("cluster", "word").agg(F.count("*").alias("n")).join(paths, "cluster").select("path", "word", "n")
    nodes = R.ancestors(counts, "path").groupBy("path", "word").agg(F.sum("n").alias("n"))
    return nodes.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= most)


def node_names(top: DataFrame, words: int = 3) -> DataFrame:
    """(path, name): the first words of each node that its parent does not have among its own first ones."""
    parent = top.where(F.col("rank") <= words).select(F.col("path").alias("_up"), F.col("word").alias("_w"))
    up = F.slice("path", F.lit(1), F.size("path") - 1)
    own = top.withColumn("_p", up).join(parent, (F.col("_p") == F.col("_up")) & (F.col("word") == F.col("_w")), "left_anti")
    first = own.withColumn("_rn", F.row_number().over(Window.partitionBy("path").orderBy("rank"))).where(F.col("_rn") <= words)
    return first.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " ").alias("name"))


def tree_slice(nodes: DataFrame, level: tuple[int, int] | None = None, size: tuple[float, float] | None = None, ratio: tuple[float, float] | None = None, pattern: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """Nodes (path, phrases, cost, documents, name, tags) within bounds of level, number of phrases and cost a phrase, whose name matches and that have one of tags."""
    out = nodes.where(F.size("path").between(*level)) if level else nodes
    out = out.where(F.col("phrases").between(*size)) if size else out
    out = out.where((F.col("cost") / F.col("phrases")).between(*ratio)) if ratio else out
    out = out.where(F.col("name").rlike(pattern)) if pattern else out
    return out.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else out


def tree_range(nodes: DataFrame, value: str) -> DataFrame:
    """(low, high) of a column over all nodes."""
    return nodes.agg(F.min(value).alias("low"), F.max(value).alias("high"))


# --- trees as JSON


def nested(rows: Sequence[Mapping], key: str = "path") -> dict:
    """A tree {…, children: [...]} of rows with paths; a missing node on the way is empty."""
    root: dict = {"children": []}
    index: dict[tuple, dict] = {(): root}

    def node(path: tuple) -> dict:
        if path not in index:
            index[path] = {"children": []}
            node(path[:-1])["children"].append(index[path])
        return index[path]

    for row in sorted(rows, key=lambda r: tuple(r[key])):
        node(tuple(row[key])).update({k: list(v) if k == key else v for k, v in row.items()})
    return root["children"][0] if len(root["children"]) == 1 else root


def flattened(tree: Mapping, path: tuple = ()) -> Iterator[dict]:
    """The nodes of a nested tree as rows, with the path by child numbers where they have none."""
    own = tuple(tree.get("path", path))
    yield {k: v for k, v in tree.items() if k != "children"} | {"path": list(own)}
    for i, child in enumerate(tree.get("children", ())):
        yield from flattened(child, (*own, i))


def write_tree(nodes: DataFrame, path: str) -> None:
    """One JSON document of all nodes, which are as many as twice the clusters."""
    rows = [r.asDict(recursive=True) for r in nodes.toLocalIterator()]
    nodes.sparkSession.createDataFrame([(json.dumps(nested(rows), default=list),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_tree(spark: SparkSession, path: str) -> list[dict]:
    """The nodes of a tree written as JSON."""
    (row,) = spark.read.text(path, wholetext=True).collect()
    return list(flattened(json.loads(row.value)))


#: Folders that a task writes.
FOLDERS = 100


def write_phrases(phrases: DataFrame, path: str, chunk: int = 500, order: Sequence[str] = ("distance", "phrase_id")) -> None:
    """JSON lines in folders by cluster and chunk of about 500 phrases in order, and an index of the chunks."""
    spark = phrases.sparkSession
    at = F.row_number().over(Window.partitionBy("cluster").orderBy(*order)) - 1
    dealt = written(phrases.withColumn("chunk", F.floor(at / chunk)).withColumn("_at", at))
    # a folder costs time however few bytes it has: tasks are dealt folders, and none are put together for being small
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), dealt.select("cluster", "chunk").distinct().count() // FOLDERS)
    dealt.repartition(tasks, "cluster", "chunk").sortWithinPartitions("cluster", "chunk", "_at").drop("_at").write.mode("overwrite").partitionBy("cluster", "chunk").json(f"{path}/phrases")
    dealt.groupBy("cluster", "chunk").agg(F.count("*").alias("phrases"), F.min("distance").alias("nearest"), F.max("distance").alias("farthest")).write.mode("overwrite").json(f"{path}/index")
    dropped(dealt)


def read_phrases(spark: SparkSession, path: str, cluster: int, chunk: int) -> DataFrame:
    """A page: the phrases of one chunk; others are not read."""
    return spark.read.json(f"{path}/phrases").where((F.col("cluster") == cluster) & (F.col("chunk") == chunk))


# --- what users say of clusters


def context_nodes(context: DataFrame) -> DataFrame:
    """(path, tag, is_tag) of context (kind `tagged` or `inverse`, key, tags): keys are paths joined by commas."""
    rows = context.where("kind in ('tagged', 'inverse')").select(F.transform(F.split("key", ","), lambda x: x.cast("int")).alias("path"), F.explode("tags").alias("tag"), (F.col("kind") == "tagged").alias("is_tag"))
    return rows


def context_phrases(context: DataFrame) -> DataFrame:
    """(doc_id, phrase_id, tag, is_tag) of context rows of kind `phrases`: keys are doc@phrase@tag, tags `true` or `false`."""
    parts = F.split("key", "@")
    return context.where("kind = 'phrases'").select(parts[0].cast("long").alias("doc_id"), parts[1].cast("long").alias("phrase_id"), parts[2].alias("tag"), (F.get("tags", F.lit(0)) == "true").alias("is_tag"))


def merged_tags(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, tags, not_tags) of rows (key, tag, is_tag): a tag that is said to be and not to be is."""
    sets = rows.groupBy(*key).agg(F.array_sort(F.collect_set(F.when(F.col("is_tag"), F.col("tag")))).alias("tags"), F.array_sort(F.collect_set(F.when(~F.col("is_tag"), F.col("tag")))).alias("_not"))
    return sets.withColumn("not_tags", F.array_except("_not", "tags")).drop("_not")


def leaf_tags(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cluster, tags): those that users gave to a cluster's node or one above it."""
    above = R.ancestors(paths.select("cluster", "path"), "path")
    return above.join(nodes.where("is_tag"), "path").groupBy("cluster").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
