"""Tag logs, trees of tags, topic classifiers over token vectors, and topics found by a genetic search."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# --- logs


def fold_tags(log: DataFrame) -> DataFrame:
    """The last state of each tag of log (id, timestamp, operation, filter, and any columns of its definition), in the order of timestamps.

    A deleted tag comes back by a create only; addFilter and removeFilter change the filter of what is there, from the last
    create or update on; every other operation takes the place of the one before. Deleted tags are left out, and so are those that
    never had more than filter changes. Of equal timestamps the operation's name, then the filter decides.
    """
    state = [c for c in log.columns if c not in ("id", "operation", "timestamp", "filter")]
    row = F.struct("timestamp", "operation", "filter", *state)
    rows = log.groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("log"))  # the log of a tag, made by hand
    kind = rows.schema["log"].dataType.elementType.simpleString()
    empty = F.lit(None).cast(kind)
    filters = ("addFilter", "removeFilter")

    def step(old, new):
        op = new["operation"]
        added, less = F.array_sort(F.array_union(old["filter"], new["filter"])), F.array_except(old["filter"], new["filter"])
        gone = old["operation"] == "delete"
        same = lambda f: F.struct(new["timestamp"].alias("timestamp"), old["operation"].alias("operation"), f.alias("filter"), *(old[c].alias(c) for c in state))
        return (
            F.when(old.isNull(), F.when(op.isin(*filters), empty).otherwise(new))
            .when(gone & (op != "create"), old)
            .when(op == "addFilter", same(added)).when(op == "removeFilter", same(less)).otherwise(new)
        )

    out = rows.select("id", F.aggregate("log", empty, step).alias("s")).where("s is not null and s.operation <> 'delete'")
    return out.select("id", "s.timestamp", "s.filter", *(f"s.{c}" for c in state))


def fold_annotations(log: DataFrame, key: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """The newest row of each key of log (timestamp, operation and more): columns of fill take the newest value that is not null, and a delete stays until a create.

    Deleted ones stay, with operation `delete`; a null operation is a create.
    """
    op = F.coalesce("operation", F.lit("create"))
    rest = [c for c in log.columns if c not in {*key, *fill, "operation", "timestamp"}]
    at = F.struct("timestamp", op, *rest, *fill)
    made, gone = F.max(F.when(op == "create", at)), F.max(F.when(op == "delete", at))
    newest = F.max_by(F.struct(op.alias("operation"), *rest), at)
    got = log.groupBy(*key).agg(newest.alias("n"), made.alias("m"), gone.alias("g"), F.max("timestamp").alias("timestamp"), *(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in fill))
    deleted = F.col("g").isNotNull() & (F.col("m").isNull() | (F.col("g") > F.col("m")))
    return got.select(*key, "timestamp", F.when(deleted, "delete").otherwise(F.col("n.operation")).alias("operation"), *(F.col(f"n.{c}").alias(c) for c in rest), *fill)


# --- trees of tags


@dataclass(frozen=True)
class Tag:
    """A tag gives its out classes to what has all of its filter's classes, or 0 for everything."""

    id: int
    out: tuple[int, ...]
    filter: frozenset[int] = frozenset()
    children: tuple[int, ...] = ()


def tag_tree(tags: Sequence[Tag]) -> dict[int, Tag]:
    """Tags with their children: a tag is below the last one in order that gives a class of its filter. Raises ValueError for a tag whose filter no tag gives, or a loop."""
    done: dict[int, Tag] = {}
    left = sorted(tags, key=lambda t: t.id)
    parent: dict[int, int] = {}
    while left:
        ready = [t for t in left if not t.filter - {0} or any(f in d.out for f in t.filter for d in done.values())]
        if not ready:
            raise ValueError(f"no tag gives the classes of {[t.id for t in left]}")
        for t in ready:
            above = [d.id for d in done.values() if any(f in d.out for f in t.filter) and d.id != t.id]
            if t.filter - {0}:
                parent[t.id] = above[-1]
        done |= {t.id: t for t in ready}
        left = [t for t in left if t not in ready]
    return {i: replace(t, children=tuple(sorted(c for c, p in parent.items() if p == i))) for i, t in done.items()}


def depth_first(tree: Mapping[int, Tag], roots: Sequence[int] | None = None) -> Iterator[tuple[int, Tag]]:
    """(depth, tag) from the roots down."""
    below = {c for t in tree.values() for c in t.children}
    todo = [(0, i) for i in sorted(roots if roots is not None else set(tree) - below, reverse=True)]
    while todo:
        depth, i = todo.pop()
        yield depth, tree[i]
        todo += [(depth + 1, c) for c in reversed(tree[i].children)]


def leaves(tree: Mapping[int, Tag]) -> list[Tag]:
    return [t for _, t in depth_first(tree) if not t.children]


# --- nodes that give classes to token spans


@dataclass
class Node:
    """links: from a class to those that may follow from it; models: (weights, offset) of each of these. mode says which tokens are looked at: noFilter, allIn (those with all of filter's classes) or anyIn (negative ones shut out)."""

    name: str
    links: dict[int, tuple[int, ...]]
    models: dict[int, tuple[list[float], float]] = field(default_factory=dict)
    mode: str = "noFilter"
    filter: tuple[int, ...] = ()
    children: list[Node] = field(default_factory=list)
    kind: str = "classifier"

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Node:
        def made(d: dict) -> Node:
            return Node(d["name"], {int(k): tuple(v) for k, v in d["links"].items()}, {int(k): (list(v[0]), v[1]) for k, v in d["models"].items()}, d["mode"], tuple(d["filter"]), [made(c) for c in d["children"]], d["kind"])

        return made(json.loads(text))


def score(vector: np.ndarray, model: tuple[list[float], float]) -> float:
    """A linear margin as a score from 0 to 1."""
    return 0.5 + float(np.arctan(2 * (np.dot(vector, model[0]) + model[1])) / np.pi)


def passes(node: Node, classes: set[int]) -> bool:
    if node.mode == "noFilter":
        return True
    wanted, shut = {f for f in node.filter if f >= 0}, {-f for f in node.filter if f < 0}
    if shut & classes:
        return False
    return wanted <= classes if node.mode == "allIn" else not wanted or bool(wanted & classes)


def classified(node: Node, vectors: np.ndarray, facts: dict[int, dict[int, int]], scores: dict[int, float], window: int = 2) -> None:
    """Adds to facts (class: {token: token where its span begins}) and scores what a classifier node finds.

    For each link the tokens that have the class it comes from, in order: each alone; then a span that grows to the right while it is within
    `window` of its begin or of its best end, and is then shortened from the left while that is better, which counts if it beats its best
    single token; then all together. A class is given where its score is above one half, and keeps its highest score.
    """
    for source, targets in node.links.items():
        places = sorted(facts.get(source, {}))
        if not places:
            continue
        for target in targets:
            if target not in node.models:
                continue
            of = lambda some, m=node.models[target]: score(vectors[list(some)].sum(0), m)
            single = {p: of([p]) for p in places}

            def give(some: Sequence[int], s: float, target: int = target) -> None:
                if s > 0.5:
                    for p in some:
                        facts.setdefault(target, {}).setdefault(p, some[0])
                    scores[target] = max(scores.get(target, 0.0), s)

            for p in places:
                give([p], single[p])
            at = 0
            while at < len(places):
                best, top = at, single[places[at]]
                end = at + 1
                while end < len(places) and (end <= at + window or end <= best + window):
                    if (s := of(places[at : end + 1])) > top:
                        best, top = end, s
                    end += 1
                begin = at
                while begin < best and (s := of(places[begin + 1 : best + 1])) >= top:
                    begin, top = begin + 1, s
                span = places[begin : best + 1]
                if len(span) > 1 and top > max(single[p] for p in span):
                    give(span, top)
                at = best + 1
            give(places, of(places))


def walk(node: Node, vectors: np.ndarray, facts: dict[int, dict[int, int]], scores: dict[int, float]) -> None:
    """A node and those below it, classifiers before the others, on the tokens that pass its filter."""
    classes_of = lambda p: {c for c, held in facts.items() if p in held}
    kept = {p for p in range(len(vectors)) if passes(node, classes_of(p))}
    own = {c: {p: b for p, b in held.items() if p in kept} for c, held in facts.items()}
    if node.kind == "classifier":
        classified(node, vectors, own, scores)
    elif node.kind == "analogy":
        analogous(node, vectors, own, scores)
    for c, held in own.items():
        facts.setdefault(c, {}).update(held)
    for child in sorted(node.children, key=lambda n: n.kind != "classifier"):
        walk(child, vectors, facts, scores)


def analogous(node: Node, vectors: np.ndarray, facts: dict[int, dict[int, int]], scores: dict[int, float]) -> None:
    """A class for a token that stands to one of the source class as the node's pairs do: the cosine of their difference with the mean one, as a score."""
    for source, targets in node.links.items():
        for target in targets:
            if target not in node.models:
                continue
            mean = np.array(node.models[target][0])
            for p in sorted(facts.get(source, {})):
                for q in range(len(vectors)):
                    d = vectors[q] - vectors[p]
                    size = np.linalg.norm(d) * np.linalg.norm(mean)
                    s = 0.5 + 0.5 * float(d @ mean / size) if q != p and size else 0.0
                    if s > 0.5:
                        facts.setdefault(target, {}).setdefault(q, q)
                        scores[target] = max(scores.get(target, 0.0), s)


def analogy_model(pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[list[float], float]:
    """The mean difference of pairs (from, to)."""
    return list(np.mean([b - a for a, b in pairs], axis=0)), 0.0


def fit_node(name: str, links: Mapping[int, Sequence[int]], examples: Mapping[int, Sequence[np.ndarray]], rest: Sequence[np.ndarray] = (), rounds: int = 200) -> Node:
    """A classifier node: for each class a linear model of its examples against those of its siblings and the rest, both sides weighing the same, by ridge regression on signs."""
    models = {}
    for target in (t for ts in links.values() for t in ts):
        yes = [np.asarray(v, float) for v in examples.get(target, ())]
        no = [np.asarray(v, float) for c, vs in examples.items() if c != target for v in vs] + [np.asarray(v, float) for v in rest]
        if not yes or not no:
            continue
        x = np.column_stack([np.vstack(yes + no), np.ones(len(yes) + len(no))])
        y = np.array([1.0] * len(yes) + [-1.0] * len(no))
        w = np.array([1 / len(yes)] * len(yes) + [1 / len(no)] * len(no))
        beta = np.linalg.solve((x.T * w) @ x + 1e-3 * np.eye(x.shape[1]), (x.T * w) @ y)
        models[target] = list(beta[:-1]), float(beta[-1])
    return Node(name, {k: tuple(v) for k, v in links.items()}, models)


def tag_texts(df: DataFrame, tokens: str, vectors: str, node: Node) -> DataFrame:
    """df with facts (class: {token: begin of its span}) and scores (class: score) of its token vectors; every token has class 0 at first."""
    held = df.sparkSession.sparkContext.broadcast(node)

    @F.pandas_udf("facts map<int,map<int,int>>, scores map<int,double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rows in batch:
                x = np.stack([np.asarray(v, float) for v in rows]) if rows is not None and len(rows) else np.zeros((0, 1))
                facts, scores = {0: {i: i for i in range(len(x))}}, {}
                if len(x):
                    walk(held.value, x, facts, scores)
                out.append((facts, scores))
            yield pd.DataFrame(out, columns=["facts", "scores"])

    return df.withColumn("_t", run(F.col(vectors))).select(*df.columns, "_t.facts", "_t.scores")


def merged(a: Node, b: Node, weights: tuple[float, float] = (0.5, 0.5)) -> Node:
    """Two versions of a node, fitted on parts of the examples: models are averaged, children by name, classes of either side stay."""
    both = {t: ([x * weights[0] + y * weights[1] for x, y in zip(a.models[t][0], b.models[t][0], strict=True)], a.models[t][1] * weights[0] + b.models[t][1] * weights[1]) if t in a.models and t in b.models else (a.models.get(t) or b.models[t]) for t in a.models | b.models}
    links = {k: tuple(dict.fromkeys((*a.links.get(k, ()), *b.links.get(k, ())))) for k in a.links | b.links}
    theirs = {c.name: c for c in b.children}
    children = [merged(c, theirs.pop(c.name), weights) if c.name in theirs else c for c in a.children]
    return replace(a, models=both, links=links, children=[*children, *theirs.values()])


def renumbered(node: Node, classes: Mapping[int, int]) -> Node:
    """A copy of a node and those below with other class numbers; those not named stay."""
    of = lambda c: -classes.get(-c, -c) if c < 0 else classes.get(c, c)
    return replace(node, links={of(k): tuple(map(of, v)) for k, v in node.links.items()}, models={of(k): v for k, v in node.models.items()}, filter=tuple(map(of, node.filter)), children=[renumbered(c, classes) for c in node.children])


# --- clusters that follow a stream of documents


@dataclass
class Online:
    """k classes by top words, each a unit vector, with running centres; children split off classes that have grown."""

    k: int
    words: int = 5
    split: float = 50.0
    top: list[list[np.ndarray]] = field(default_factory=list)
    centre: list[np.ndarray] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    children: dict[int, Online] = field(default_factory=dict)

    def gap(self) -> float:
        """How much nearer classes are to their own top words than to the others'."""
        own = [np.mean([float(w @ c) for w in ws]) for ws, c in zip(self.top, self._units(), strict=True) if ws]
        other = [float(w @ c) for i, ws in enumerate(self.top) for w in ws for j, c in enumerate(self._units()) if i != j]
        return float(np.mean(own) - np.mean(other)) if own and other else 0.0

    def _units(self) -> list[np.ndarray]:
        return [c / (np.linalg.norm(c) or 1.0) for c in self.centre]

    def learn(self, tokens: np.ndarray) -> int | None:
        """Takes a document's token vectors in; the class it goes to, None while there are none."""
        size = np.linalg.norm(tokens, axis=1, keepdims=True)
        units = (tokens / np.where(size == 0, 1, size))[size[:, 0] > 0]
        if not len(units):
            return None
        if not self.top:
            self.top, self.centre, self.weight = [[] for _ in range(self.k)], [np.zeros(units.shape[1]) for _ in range(self.k)], [0.0] * self.k
        for u in units:  # classes are filled in turn, near-equal words once
            short = min(range(self.k), key=lambda i: (len(self.top[i]), i))
            if len(self.top[short]) < self.words and all(float(u @ w) <= 0.999 for ws in self.top for w in ws):
                self.top[short].append(u)
        filled = [i for i in range(self.k) if self.top[i]]
        alike = {i: units @ np.stack(self.top[i]).T for i in filled}
        best = max(filled, key=lambda i: (round(float(alike[i].max(0).mean()), 12), -i))
        value = float(alike[best].max(0).mean())
        self.centre[best] = self.centre[best] + units.mean(0) * max(value, 0.0)
        self.weight[best] += max(value, 0.0)
        self._replace(best, units)
        if self.weight[best] > self.split and all(w > self.split for i, w in enumerate(self.weight) if self.top[i]):
            self.children.setdefault(best, Online(self.k, self.words, self.split))
        if best in self.children:
            self.children[best].learn(tokens)
        return best

    def _replace(self, i: int, units: np.ndarray) -> None:
        """The top word that is farthest from its class's centre gives way to a word of the document that is nearer to it, and nearer to it than to the centre of all."""
        own = self._units()[i]
        everything = sum(self.centre) / (np.linalg.norm(sum(self.centre)) or 1.0)
        worst = min(range(len(self.top[i])), key=lambda j: float(self.top[i][j] @ own))
        for u in units:
            if float(u @ own) > float(self.top[i][worst] @ own) and float(u @ own) > float(u @ everything) and all(float(u @ w) <= 0.999 for w in self.top[i]):
                self.top[i][worst] = u
                break

    def merge(self, other: Online) -> None:
        """Takes in what another part of the documents has taught: each of its classes joins the most alike of this one's that is still free."""
        if not self.top:
            self.__dict__.update(other.__dict__)
            return
        pairs = sorted(((-round(float(a @ b), 12), i, j) for i, a in enumerate(self._units()) for j, b in enumerate(other._units())))
        done_i, done_j = set(), set()
        for _, i, j in pairs:
            if i in done_i or j in done_j:
                continue
            done_i.add(i)
            done_j.add(j)
            self.centre[i], self.weight[i] = self.centre[i] + other.centre[j], self.weight[i] + other.weight[j]
            own = self._units()[i]
            words = sorted([*self.top[i], *other.top[j]], key=lambda w: -float(w @ own))
            self.top[i] = words[: self.words]
            if j in other.children:
                if i in self.children:
                    self.children[i].merge(other.children[j])
                else:
                    self.children[i] = other.children[j]


def cluster_online(df: DataFrame, key: str, vectors: str, k: int, words: int = 5, split: float = 50.0, parts: int = 8) -> Online:
    """Classes learned from all documents' token vectors: each of `parts` parts, dealt by hash, is learned in the order of keys, and parts are merged. What reaches the driver is k classes of each part."""
    import pickle

    dealt = df.select(F.pmod(F.xxhash64(key), F.lit(parts)).alias("_part"), F.col(key).alias("_key"), F.col(vectors).alias("_v")).repartition(parts, "_part").sortWithinPartitions("_part", "_key")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, Online] = {}
        for frame in frames:
            for part, v in zip(frame["_part"], frame["_v"], strict=True):
                if v is not None and len(v):
                    found.setdefault(part, Online(k, words, split)).learn(np.stack([np.asarray(x, float) for x in v]))
        yield pd.DataFrame({"part": list(found), "model": [pickle.dumps(m) for m in found.values()]})

    out = Online(k, words, split)
    for row in dealt.mapInPandas(learn, "part long, model binary").orderBy("part").collect():
        out.merge(pickle.loads(row.model))
    return out


# --- topics by a genetic search


def readings(vectors: np.ndarray, window: int) -> np.ndarray:
    """The sums of all stretches of `window` token vectors, as unit vectors; of a shorter text the sum of all."""
    sums = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors, axis=0)])
    out = sums[window:] - sums[:-window] if len(vectors) >= window else sums[-1:]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def genetic_topics(df: DataFrame, key: str, vectors: str, topics: int = 10, population: int = 100, window: int = 10, max_rounds: int = 20, sample: int = 2_000, seed: int = 38) -> np.ndarray:
    """Topics (topics x length) as sentences that tell readings of a bounded sample of documents best apart.

    A group of sentences is worth the mean over readings of the best likeness less the mean of the others. Each round the better half of
    groups, drawn by rank, are crossed: a child takes from both parents the sentences farthest from those it has, and each then moves
    to its own best reading. The best `population` of old and new live on, until their worth no longer rises. The sample is by hash of key.
    """
    rows = df.where(F.size(vectors) > 0).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(sample).select(vectors).toPandas()[vectors]
    texts = np.concatenate([readings(np.stack([np.asarray(v, float) for v in t]), window) for t in rows])
    rng = np.random.default_rng(seed)

    def worth(group: np.ndarray) -> float:
        s = texts @ group.T
        top = s.max(1)
        return float(np.mean(top - (s.sum(1) - top) / max(1, len(group) - 1)))

    def moved(group: np.ndarray) -> np.ndarray:
        s = texts @ group.T
        own = s.argmax(1)
        return np.stack([texts[np.where(own == i, s[:, i], -2).argmax()] if (own == i).any() else g for i, g in enumerate(group)])

    groups = [texts[rng.choice(len(texts), size=min(topics, len(texts)), replace=False)] for _ in range(population)]
    rated = sorted(((worth(g), i) for i, g in enumerate(groups)), reverse=True)
    groups = [groups[i] for _, i in rated]
    total = sum(w for w, _ in rated)
    chance = np.arange(len(groups), 0, -1) / np.arange(len(groups), 0, -1).sum()
    for _ in range(max_rounds):
        children = []
        for _ in range(population // 2):
            a, b = rng.choice(len(groups), size=2, p=chance)
            pool = np.concatenate([groups[a], groups[b]])
            child = [pool[int(rng.integers(len(pool)))]]
            while len(child) < len(groups[a]):
                child.append(pool[(pool @ np.stack(child).T).max(1).argmin()])
            children.append(moved(np.stack(child)))
        rated = sorted(((worth(g), -i) for i, g in enumerate([*groups, *children])), reverse=True)[:population]
        every = [*groups, *children]
        groups, new = [every[-i] for _, i in rated], sum(w for w, _ in rated)
        if new <= total + 1e-9:
            break
        total = new
    return groups[0]


def topic_scores(df: DataFrame, vectors: str, topics: np.ndarray, window: int = 10, least: float = 0.5) -> DataFrame:
    """df with topics: an array, for each topic its best likeness to a stretch of the text, whether that is `least` or more, and where these stretches begin and end."""
    held = df.sparkSession.sparkContext.broadcast(topics / np.maximum(np.linalg.norm(topics, axis=1, keepdims=True), 1e-12))
    kind = "array<struct<score:double,flag:boolean,segments:array<struct<begin:int,end:int>>>>"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for rows in batch:
                if rows is None or not len(rows):
                    out.append([{"score": 0.0, "flag": False, "segments": []} for _ in held.value])
                    continue
                s = readings(np.stack([np.asarray(v, float) for v in rows]), window) @ held.value.T
                found = []
                for i in range(s.shape[1]):
                    spans: list[dict] = []
                    for b in np.flatnonzero(s[:, i] >= least).tolist():
                        e = min(b + window, len(rows))
                        if spans and b <= spans[-1]["end"]:
                            spans[-1]["end"] = e
                        else:
                            spans.append({"begin": b, "end": e})
                    found.append({"score": float(s[:, i].max()), "flag": bool(s[:, i].max() >= least), "segments": spans})
                out.append(found)
            yield pd.Series(out, dtype=object)

    return df.withColumn("topics", run(F.col(vectors)))
