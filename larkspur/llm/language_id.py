"""Language ID: multinomial naive Bayes over hashed character n-grams.

The matrix of log-probabilities (buckets by languages) is broadcast; texts are scored in numpy, each n-gram
adding its bucket's row. Learning counts buckets by partition and sums the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from larkspur.llm import tokens
from larkspur.plans.session import dropped, written

BUCKETS, SIZES = 1 << 16, (1, 2, 3)
#: Documents that each language is learned from, about: a sample by hash of id and text, all if there are fewer. Languages that one model holds (a quarter of a MB each).
SAMPLE_DOCS, PART_LANGS = 4_000, 64
_PIECE = 1 << 20  # characters at once
#: Columns that identify() adds on its way.
ADDED = {"held_out", "lang_pred", "score", "_lang", "_top", "_all", "_new"}


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text is 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _buckets(codes: np.ndarray, size: int) -> np.ndarray:
    """Of the n-grams that begin at each code point; the last size - 1 begin none."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(n, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(size):
        h = (h ^ codes[k : k + n]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of texts with a space before, between and after, and the text that each is of; long texts come in overlapping pieces."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), _PIECE):
            part = " " * (at == 0) + text[max(0, at - 2 * (at > 0)) : at + _PIECE] + " " * (at + _PIECE >= len(text))
            held.append((i, _codes(part)))
            size += len(part)
            if size >= _PIECE:
                yield np.concatenate([c for _, c in held]), np.repeat([i for i, _ in held], [len(c) for _, c in held])
                held, size = [], 0
    if held:
        yield np.concatenate([c for _, c in held]), np.repeat([i for i, _ in held], [len(c) for _, c in held])


def parts(docs: DataFrame) -> Iterator[list[tuple[str, int]]]:
    """The languages of docs and their numbers of documents, in order, PART_LANGS at a time."""
    counts, last = written(docs.where("lang is not null and text is not null").groupBy("lang").count()), None
    while True:
        some = [tuple(r) for r in (counts if last is None else counts.where(F.col("lang") > last)).orderBy("lang").limit(PART_LANGS).collect()]
        if some:
            yield some
        if len(some) < PART_LANGS:
            dropped(counts)
            return
        last = some[-1][0]


def _grams(codes: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of n-grams, and the text that each is of; those that go over from one text to the next are none."""
    for size in SIZES:
        b = _buckets(codes, size)
        inside = at[: len(b)] == at[size - 1 :]
        yield b[inside], at[: len(b)][inside]


def learn(docs: DataFrame, some: list[tuple[str, int]]) -> np.ndarray:
    """Log-probabilities of buckets by language (of some, with numbers of documents), from text and lang of docs; the last row has the logarithms of those numbers."""
    langs = [x for x, _ in some]
    number = F.create_map(*(F.lit(x) for i, k in enumerate(langs) for x in (k, i)))
    share = F.create_map(*(F.lit(x) for k, n in some for x in (k, min(1.0, SAMPLE_DOCS / n))))
    known = docs.where(F.col("lang").isin(langs) & F.col("text").isNotNull())
    sample = known.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(6)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select(number[F.col("lang")].alias("number"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            own = batch.column("number").to_numpy().astype(np.int64)
            for codes, at in _pieces(batch.column("text").to_pylist()):
                for b, text in _grams(codes, at):
                    np.add.at(total.reshape(-1), own[text] * BUCKETS + b, 1)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])], names=["lang", "bucket", "n"])

    # a row for each language of the part and bucket at most
    rows = sample.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((BUCKETS, len(langs)), 0.5, np.float32)
    table[rows.column("bucket").to_numpy(), rows.column("lang").to_numpy()] += rows.column("n").to_numpy()
    return np.vstack([np.log(table / table.sum(0, dtype=float)), np.log([n for _, n in some])]).astype(np.float32)


def scored(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """docs with _lang, the likeliest of langs, _top, its log-likelihood, and _all, the likelihood of all of them relative to it; better ones that are there stay, _all then counts these languages, too."""
    model = docs.sparkSession.sparkContext.broadcast(table)

    @pandas_udf("lang string, top double, all double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        logs, names = model.value, np.array(langs, object)
        for texts in batches:
            total = np.repeat(logs[BUCKETS:].astype(float), len(texts), 0)
            for codes, at in _pieces(["" if x is None else x for x in texts]):
                for b, text in _grams(codes, at):
                    if len(b):
                        first = np.flatnonzero(np.diff(text, prepend=-1))
                        np.add.at(total, text[first], np.add.reduceat(logs[b], first, axis=0, dtype=float))
            top = total.max(1)
            yield pd.DataFrame({"lang": names[total.argmax(1)], "top": top, "all": np.exp(total - top[:, None]).sum(1)})

    names = [c for c in docs.columns if c not in ("_lang", "_top", "_all")]
    new = docs.withColumn("_new", score.asNondeterministic()("text"))
    if len(names) == len(docs.columns):
        return new.select(*names, F.col("_new.lang").alias("_lang"), F.col("_new.top").alias("_top"), F.col("_new.all").alias("_all"))
    better = F.col("_new.top") > F.col("_top")
    top = F.greatest("_new.top", "_top")
    both = F.col("_new.all") * F.exp(F.col("_new.top") - top) + F.col("_all") * F.exp(F.col("_top") - top)
    return new.select(*names, F.when(better, F.col("_new.lang")).otherwise(F.col("_lang")).alias("_lang"), top.alias("_top"), both.alias("_all"))


def identify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) with held_out, lang_pred and score, its posterior probability; columns of these names are replaced.

    Learned from the rows that are not held out and have a lang, any number of languages. A null text or one without a
    letter (Unicode L) is `und` with score 0, and so is any text if no language was learned. Whole texts are scored; equal
    rows are scored alike.
    """
    tokens.bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    out = docs = docs.select(*keep).withColumn("held_out", held_out())
    learn_from, models, stored = docs.where("not held_out"), 0, None
    for some in parts(learn_from):
        if models:  # one part's model at a time
            new = written(out)
            if stored is not None:
                dropped(stored)
            stored = out = new
        out = scored(out, [x for x, _ in some], learn(learn_from, some))
        models += 1
    if not models:
        out = out.select("*", F.lit("und").alias("_lang"), F.lit(0.0).alias("_top"), F.lit(float("inf")).alias("_all"))
    und = ~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return out.select(*keep, "held_out", F.when(und, "und").otherwise(F.col("_lang")).alias("lang_pred"), F.when(und, 0.0).otherwise(1 / F.col("_all")).alias("score"))


def in_known_language(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows of docs whose language is told with at least min_score, with their columns as they are; texts without a letter go."""
    renamed, back = tokens.set_aside(docs, ADDED)
    return identify(renamed).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(*back)
