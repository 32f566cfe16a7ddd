"""Benchmark decontamination with a generalised suffix automaton of the items' words.

Documents are streamed through the automaton, which keeps the longest run of words up to here that occurs in
any item. Only stretches of words that items use can match, so others are stepped over.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import partial
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from larkspur.llm import tokens
from larkspur.plans.session import dropped, written

#: Every byte that is not part of a word is a space, A-Z are a-z: words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Characters of the items of an automaton, about: it is broadcast, some 100 bytes a character at most. More items make several, one after the other.
PART_CHARS = 4_000_000


class Automaton:
    """Of all items; state 0 is empty. Each window (size words of an item, or a whole shorter one) is found where it ends."""

    def __init__(self, items: list[list[bytes]], size: int) -> None:
        self.size, self.ids = size, {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        words = [[self.ids.setdefault(w, len(self.ids)) for w in item] for item in items]
        for item in words:
            last = 0
            for w in item:
                last = self._add(last, w)
        #: windows[state]: items that have the window of `size` words that ends there; short[state]: (words, item) of shorter ones
        self.windows: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.least = min((min(size, len(x)) for x in words if x), default=0)
        #: last[state]: the state that holds its last `size` words
        self.last = list(range(len(self.length)))
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for v in by_length:
            if self.length[self.link[v]] >= size:
                self.last[v] = self.last[self.link[v]]
        for k, item in enumerate(words):
            state, n = 0, 0
            for w in item:
                state, n = self.step(state, n, w)
                if n >= size:
                    self.windows.setdefault(self.window(state), set()).add(k)
            if 0 < len(item) < size:
                self.short.setdefault(self.holding(state, len(item)), []).append((len(item), k))
        #: nearest[state]: it or the next of its suffixes that ends a short item; these have different lengths, fewer than size
        self.nearest = [0] * len(self.length)
        for v in by_length if self.short else ():
            self.nearest[v] = v if v in self.short else self.nearest[self.link[v]]

    def _add(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, w, known)
        new = self._state(self.length[last] + 1)
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            to = self.next[at][w]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, w, to)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.length.append(length)
        self.link.append(0)
        return len(self.length) - 1

    def _split(self, at: int, w: int, to: int) -> int:
        twin = self._state(self.length[at] + 1)
        self.next[twin] = dict(self.next[to])
        self.link[twin], self.link[to] = self.link[to], twin
        while at >= 0 and self.next[at].get(w) == to:
            self.next[at][w] = twin
            at = self.link[at]
        return twin

    def step(self, state: int, n: int, w: int) -> tuple[int, int]:
        """The state after w, and how many words match up to here."""
        while state and w not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, n + 1)

    def holding(self, state: int, n: int) -> int:
        """The state that holds the last n words of this one."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def window(self, state: int) -> int:
        return self.last[state]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words within windows that occur, overlapping ones merged, and the items that have them."""
        if not self.least or len(words) < self.least:
            return [], set()
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        known = np.concatenate([[False], ids >= 0, [False]])
        turns = np.flatnonzero(known[1:] != known[:-1])
        spans: list[list[int]] = []
        seen: set[int] = set()
        items: set[int] = set()
        for begin, end in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if end - begin < self.least:
                continue
            state = n = 0
            for at, w in enumerate(ids[begin:end].tolist(), begin + 1):
                state, n = self.step(state, n, w)
                width = 0
                if n >= self.size:
                    seen.add(self.last[state])
                    width = self.size
                up = self.nearest[state] if self.short else 0
                while up > 0:
                    for size, k in self.short[up]:
                        if size <= n:
                            items.add(k)
                            width = max(width, size)
                    up = self.nearest[self.link[up]]
                if width:
                    if spans and at - width <= spans[-1][1]:
                        spans[-1][0], spans[-1][1] = min(spans[-1][0], at - width), at
                    else:
                        spans.append([at - width, at])
        return merged(spans), items.union(*(self.windows[v] for v in seen))


def merged(spans: Iterable[Sequence[int]]) -> list[tuple[int, int]]:
    """Spans in the order of their ends, those that meet united; a later, wider one can reach back over several."""
    out: list[tuple[int, int]] = []
    for b, e in spans:
        while out and b <= out[-1][1]:
            b = min(b, out.pop()[0])
        out.append((b, e))
    return out


def parts(benchmark: DataFrame) -> list[DataFrame]:
    """The items (item_id, text) of benchmark in parts of about PART_CHARS characters, dealt by hash; a longer item makes its part longer."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    n = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // PART_CHARS + 1
    return [rows.where(F.pmod(F.xxhash64("item_id", "text", F.lit(5)), F.lit(n)) == i) for i in range(n)]


def automaton(items: DataFrame, window: int = 10) -> tuple[Automaton, list[str | None]]:
    """Of the items (item_id, text) of a part, which bounds them, and their ids as strings."""
    rows = items.collect()
    rows.sort(key=lambda r: (r[0] or "", r[1] or ""))
    return Automaton([(t or "").encode().translate(_FOLD).split() for _, t in rows], window), [i for i, _ in rows]


def _batches(column: pa.Array) -> Iterator[bytes]:
    for value in pc.fill_null(column.cast(pa.large_binary()), b""):
        yield value.as_py()


def _scanned(docs: DataFrame, items: DataFrame, window: int, text: str, kept: bool) -> DataFrame:
    """docs with _words, _spans and _items: what the items of one part hit is added to what is there; the text stays if kept."""
    tables = docs.sparkSession.sparkContext.broadcast(automaton(items, window))
    names = [c for c in docs.columns if c not in ("_words", "_spans", "_items") and (kept or c != text)]
    at, old = docs.columns.index(text), [docs.columns.index(c) for c in ("_spans", "_items") if c in docs.columns]
    own = [docs.columns.index(c) for c in names]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, ids = tables.value
        for batch in batches:
            n, hit, listed = [], [], []
            before = [batch.column(i).to_pylist() for i in old] or [[()] * len(batch)] * 2
            for value, spans, items in zip(_batches(batch.column(at)), *before, strict=True):
                words = value.translate(_FOLD).split()
                new, found = machine.hits(words)
                n.append(len(words))
                hit.append(merged(sorted([*((x["b"], x["e"]) for x in spans), *new], key=lambda x: x[1])))
                listed.append(sorted({ids[i] for i in found}.union(items) - {None}))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), pa.array(n, pa.int64()), pa.array([[{"b": b, "e": e} for b, e in x] for x in hit], _SPANS), pa.array(listed, pa.list_(pa.string()))], names=[*names, "_words", "_spans", "_items"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.mapInArrow(scan, f"{kinds}, _words long, _spans array<struct<b:int,e:int>>, _items array<string>")


_SPANS = pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())]))


def _hit(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """docs (doc_id, text) as (doc_id, _words, _spans, _items) for all parts of benchmark; between two parts they are written, so that one automaton is held at a time."""
    some = parts(benchmark)
    for i, items in enumerate(some):
        last = i == len(some) - 1
        out = _scanned(docs, items, window, "text", not last)
        if last:
            return out
        before, docs = docs, written(out)
        if i:
            dropped(before)
    raise AssertionError("there is a part")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs (doc_id, text).

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window. Words
    within any occurrence of a window are hit. Null and empty texts have no words; texts and items may be of any length and
    number. Items with a null item_id hit words, but are not listed; equal item_ids are one item. With no item nothing is hit.
    """
    tokens.bound_batches(docs.sparkSession)
    ids = F.array_join("_items", ",")
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["b"])
    out = _hit(docs.select("doc_id", "text"), benchmark, window)
    return out.select("doc_id", F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"))


def _without(text: bytes, spans: Sequence[tuple[int, int]]) -> bytes:
    """text without the words of spans and what stands between them."""
    codes = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    starts = np.flatnonzero(codes & ~np.concatenate([[False], codes[:-1]]))
    ends = np.flatnonzero(codes & ~np.concatenate([codes[1:], [False]])) + 1
    out, at = [], 0
    for b, e in spans:
        out.append(text[at : starts[b]])
        at = int(ends[e - 1])
    return b"".join([*out, text[at:]])


def cleaned(text: bytes, machine: Automaton, max_coverage: float) -> bytes | None:
    """text without hit spans; None if they cover more than max_coverage of its words. What moves together is looked at again."""
    first = True
    while True:
        words = text.translate(_FOLD).split()
        spans, _ = machine.hits(words)
        if not spans:
            return text
        if first and sum(e - b for b, e in spans) > max_coverage * len(words):
            return None
        first = False
        text = _without(text, spans)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs without the spans that contamination() hits; a document of which they are more than max_coverage goes.

    Null and empty texts stay, and so do repeated rows and all other columns. Where several automata are needed, all spans of a
    text are found before any is taken out, round by round until none is left.
    """
    tokens.bound_batches(docs.sparkSession)
    some = parts(benchmark)
    if len(some) > 1:
        return _rounds(docs, some, window, max_coverage)
    tables = docs.sparkSession.sparkContext.broadcast(automaton(some[0], window)[0])
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = tables.value
        for batch in batches:
            column = batch.column(at).cast(pa.large_binary())
            out, keep = [], []
            for value in column:
                text = value.as_py()
                new = text if text is None else cleaned(text, machine, max_coverage)
                keep.append(text is None or new is not None)
                out.append(new)
            columns = [pa.array(out, pa.large_binary()).cast(batch.schema.field(i).type) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def _rounds(docs: DataFrame, some: list[DataFrame], window: int, max_coverage: float) -> DataFrame:
    """decontaminate() with several automata: rounds over written tables; rows in which nothing is hit any more are left aside."""
    names, at = docs.columns, docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch], own: list[int]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
            new = [_without(t.as_py(), [(x["b"], x["e"]) for x in s]) for t, s in zip(batch.column(own[at]).cast(pa.large_binary()), spans, strict=True)]
            columns = [pa.array(new, pa.large_binary()).cast(batch.schema.field(i).type) if i == own[at] else batch.column(i) for i in own]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    done, first = None, True
    while True:
        found = docs
        for items in some:
            before, found = found, written(_scanned(found, items, window, "text", True))
            if before is not docs:
                dropped(before)
        hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["b"])
        clean = found.where("size(_spans) = 0").select(*names)
        done = clean if done is None else done.unionByName(clean)
        left = found.where("size(_spans) > 0")
        left = left.where(hit <= max_coverage * F.col("_words")) if first else left
        if left.isEmpty():
            return done
        first, own = False, [found.columns.index(c) for c in names]
        docs = written(left.mapInArrow(partial(cut, own=own), docs.schema))
