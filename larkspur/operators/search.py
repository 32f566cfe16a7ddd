"""Text lookup joins: the best row of a table for a query by BM25, in blocks of rows for queries that a task can hold, else in joins and sums."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from larkspur.functions import text as X
from larkspur.plans.session import broadcast_if_small, is_small, written

K1, B = 1.2, 0.75
#: What parts the words of a query. Fixed value.
QUERY_BREAK = r"[^\p{L}]+"


def index(table: DataFrame, key: str, text: str, acronyms: bool = False, whole: bool = False, only: DataFrame | None = None, merge: bool = True) -> DataFrame:
    """Postings (token, _key, tf, dl) of a table, and for each row with a token one of the token '' that has its dl.

    They can be written and read again, and united. whole takes each text as one token. only, written tokens, is what
    postings are kept of: the table is read once, and no others are shuffled. A text's tokens are counted where it is read; without merge
    those of rows with one key and length are not added up, which write_index() does.
    """
    if whole:
        words = F.array(F.lower(F.col(text)))
    else:
        words = acronym_tokens(text) if acronyms else X.tokens(text)
    rows = table.select(F.col(key).alias("_key"), words.alias("t")).where("size(t) > 0")
    rows = rows.select("_key", F.size("t").alias("dl"), F.array_sort("t").alias("t"))
    ends = F.filter(F.sequence(F.lit(1), F.col("dl")), lambda i: (i == F.col("dl")) | (F.get("t", i) != F.get("t", i - 1)))
    rows = rows.select("_key", "dl", "t", ends.alias("e"))
    runs = F.transform("e", lambda e, i: F.struct(F.get("t", e - 1).alias("token"), (e - F.coalesce(F.get("e", i - 1), F.lit(0))).cast("long").alias("tf")))
    rows = rows.select("_key", "dl", F.explode(F.concat(F.array(F.struct(F.lit("").alias("token"), F.lit(1).cast("long").alias("tf"))), runs)).alias("p")).select("p.token", "_key", "dl", "p.tf")
    if only is not None:
        rows = rows.join(broadcast_if_small(only), "token").select("token", "_key", "dl", "tf")
    return rows.groupBy("token", "_key", "dl").agg(F.sum("tf").alias("tf")) if merge else rows


def write_index(postings: DataFrame, path: str) -> None:
    """Stores postings, those of a token together; the shuffle by token is the only one that postings without merge take."""
    postings.repartition("token").groupBy("token", "_key", "dl").agg(F.sum("tf").alias("tf")).sortWithinPartitions("token").write.mode("overwrite").parquet(path)


def merged_index(*postings: DataFrame) -> DataFrame:
    """One index of several whose keys are different: what is known of tokens is of all of them."""
    return reduce(DataFrame.unionByName, postings)


def acronym_tokens(x: Column | str) -> Column:
    """Tokens lower-cased; two capitals are doubled, so that they weigh as a term of their own, single signs are left out."""
    return F.transform(F.filter(X.tokens(x, lower=False), lambda t: F.length(t) > 1), lambda t: F.when(t.rlike("^[A-Z]{2}$"), F.repeat(t, 2)).otherwise(F.lower(t)))


def weighed(postings: DataFrame) -> DataFrame:
    """Postings with w, the BM25 weight of a token in a row, by the statistics of the whole index."""
    rows = postings.where("token = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    real = postings.where("token <> ''")
    df = real.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return real.join(df, "token").join(F.broadcast(rows)).select("token", "_key", w.alias("w"))  # one row


def _terms(queries: DataFrame, terms: DataFrame, max_edits: int, prefix_length: int) -> DataFrame:
    """(token, term, times): the terms that each token of queries asks for: itself, four times as much with max_edits, and then, for more than two letters, those as near that begin alike."""
    asked = queries.select("token").distinct()
    own = asked.select("token", F.col("token").alias("term"), F.lit(4.0 if max_edits else 1.0).alias("times"))
    if not max_edits:
        return own
    prefix = lambda c: F.substring(c, 1, prefix_length)
    known = terms.select(F.col("token").alias("term")).distinct().withColumn("p", prefix("term")).withColumn("n", F.length("term"))
    # within the bound lengths differ by it at most: prefix and length find candidates by a hash join
    some = asked.where(F.length("token") > 2).withColumn("p", prefix("token")).withColumn("n", F.explode(F.sequence(F.length("token") - max_edits, F.length("token") + max_edits)))
    near = some.join(known, ["p", "n"]).where(F.levenshtein("token", "term", max_edits) >= 0).select("token", "term", F.lit(1.0).alias("times"))
    return own.unionByName(near).groupBy("token", "term").agg(F.sum("times").alias("times"))


def contributions(queries: DataFrame, postings: DataFrame, max_edits: int = 0, prefix_length: int = 1) -> DataFrame:
    """queries (q, token, boost and more) with _key and s, what the token adds to the score of that row."""
    terms = _terms(queries, postings, max_edits, prefix_length)
    return queries.join(terms, "token").join(weighed(postings).withColumnRenamed("token", "term"), "term").withColumn("s", F.col("boost") * F.col("times") * F.col("w")).drop("term", "times", "w")


def scores(queries: DataFrame, postings: DataFrame, max_edits: int = 0, prefix_length: int = 1) -> DataFrame:
    """(q, _key, score, tags) of queries (q, token, boost); tags are the tokens that matched."""
    found = contributions(queries, postings, max_edits, prefix_length)
    return found.groupBy("q", "_key").agg(F.sum("s").alias("score"), F.array_sort(F.collect_set("token")).alias("tags"))


def best(scored: DataFrame, min_score: float = 0.0, popularity: DataFrame | None = None, digits: int = 6, hits: int = 1) -> DataFrame:
    """The rows with the highest scores of each query, `hits` of them, the smallest key of equals first; popularity (_key, pop) multiplies the score."""
    if popularity is not None:
        scored = scored.join(popularity, "_key").withColumn("score", F.col("score") * F.col("pop"))
    scored = scored.where(F.col("score") >= min_score)
    by = F.struct((-F.round("score", digits)).alias("_s"), F.col("_key").alias("_k"))
    if hits == 1:  # partial aggregates: a row for each query leaves a partition
        return scored.groupBy("q").agg(F.min_by(F.struct(*scored.columns), by).alias("b")).select("b.*")
    return scored.withColumn("_rn", F.row_number().over(Window.partitionBy("q").orderBy(by))).where(F.col("_rn") <= hits).drop("_rn")


def best_of(*found: DataFrame) -> DataFrame:
    """Of the best rows of several indexes, each with statistics of its own, those with the strictly highest score; of equals the first index's."""
    every = reduce(DataFrame.unionByName, (f.withColumn("_from", F.lit(i)) for i, f in enumerate(found)))
    return every.groupBy("q").agg(F.max_by(F.struct(*found[0].columns), F.struct("score", -F.col("_from"))).alias("b")).select("b.*")


# --- the best rows in blocks: pairs of query and row are summed and ranked in a task's memory, none is shuffled or written

#: Pairs of query and row, and what is added to them, that a task holds at once.
CELLS = 1 << 20


class Blocks:
    """A table's rows as counts of the terms asked for: (_key, dl, ids, tfs, pop), written, with what BM25 knows of the table.

    Each row is counted where it is read. `plain` is false where keys repeat or cannot be ordered here: such tables take joins.
    """

    def __init__(self, table: DataFrame, key: str, text: str, terms: DataFrame, acronyms: bool = False, whole: bool = False, popularity: str | None = None) -> None:
        spark = table.sparkSession
        self.terms = sorted(r[0] for r in terms.select("token").distinct().collect() if r[0])
        held = spark.sparkContext.broadcast(self.terms)
        words = F.array(F.lower(F.col(text))) if whole else acronym_tokens(text) if acronyms else X.tokens(text)
        pop = F.lit(1.0) if popularity is None else F.col(popularity).cast("double")
        rows = table.select(F.col(key).alias("_key"), pop.alias("pop"), words.alias("t")).where("size(t) > 0")
        kind = rows.schema["_key"].dataType
        self.plain = kind.typeName() in ("byte", "short", "integer", "long", "string", "date", "timestamp")

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pa.array(held.value, pa.string())
            m = max(len(known), 1)
            for batch in batches:
                t = batch.column("t")
                n = pc.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = pc.fill_null(pc.index_in(t.flatten().cast(pa.string()), value_set=known), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(n)), n)
                code, tf = np.unique((row * m + ids)[ids >= 0], return_counts=True)
                at = pa.array(np.searchsorted(code // m, np.arange(len(n) + 1)).astype(np.int32))
                lists = (pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (code % m, tf))
                yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("pop"), pa.array(n), *lists], ["_key", "pop", "dl", "ids", "tfs"])

        self.rows = written(rows.mapInArrow(counted, f"_key {kind.simpleString()}, pop double, dl long, ids array<int>, tfs array<int>"))
        self.plain = self.plain and self.rows.groupBy("_key").count().where("count > 1").isEmpty()
        if not self.plain:
            return

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, n, dl = np.zeros(len(held.value), np.int64), 0, 0
            for batch in batches:
                df += np.bincount(batch.column("ids").flatten().to_numpy(), minlength=len(df))
                n, dl = n + len(batch), dl + (pc.sum(batch.column("dl")).as_py() or 0)
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some], pa.int64()), pa.array([n, dl, *df[some]], pa.int64())], ["i", "n"])

        sums = {r.i: r.n for r in self.rows.select("ids", "dl").mapInArrow(summed, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
        self.n, self.mean = sums.get(-1, 0), sums.get(-2, 0) / max(sums.get(-1, 0), 1)
        self.df = np.array([sums.get(i, 0) for i in range(len(self.terms))], float)

    def best(self, asked: DataFrame, hits: int = 1, min_score: float = 0.0, digits: int = 6) -> DataFrame:
        """(q, _key, score): as best() of scores(), of asked (q, token, boost), a small table."""
        spark = self.rows.sparkSession
        at = {t: i for i, t in enumerate(self.terms)}
        got = [(r.q, at[r.token], r.boost) for r in asked.groupBy("q", "token").agg(F.sum("boost").cast("double").alias("boost")).where("boost is not null").collect() if r.token in at]
        names = list(dict.fromkeys(g[0] for g in got))
        place = {q: i for i, q in enumerate(names)}
        got.sort(key=lambda g: g[1])
        begin = np.searchsorted([g[1] for g in got], np.arange(len(self.terms) + 1))
        idf = np.log(1 + (self.n - self.df + 0.5) / (self.df + 0.5))
        held = spark.sparkContext.broadcast((names, begin, np.array([place[g[0]] for g in got], np.int64), np.array([g[2] for g in got], float), idf, self.mean))
        kinds = {"q": asked.schema["q"].dataType.simpleString(), "_key": self.rows.schema["_key"].dataType.simpleString()}
        q_type = to_arrow_type(asked.schema["q"].dataType)

        def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, begin, query, boost, idf, mean = held.value
            if not names:
                return
            wide = len(names)
            for batch in batches:
                batch = batch.take(pc.sort_indices(batch.column("_key"), null_placement="at_start"))  # of equals the first place has the least key
                ids, tf = (batch.column(c).flatten().to_numpy() for c in ("ids", "tfs"))
                n = pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False)
                pop, dl = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("pop", "dl"))
                row = np.repeat(np.arange(len(n)), n)
                w = idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / mean)) * pop[row]
                many = begin[ids + 1] - begin[ids]
                end = np.concatenate(([0], np.cumsum(n)))
                cost = np.cumsum(np.add.reduceat(np.append(many, 0), np.minimum(end[:-1], len(many))) * (n > 0) + 1)
                low = 0
                while low < len(n):
                    done = cost[low - 1] if low else 0
                    high = max(low + 1, int(np.searchsorted(cost, done + CELLS, "right")))
                    part = slice(end[low], end[high])
                    times = many[part]
                    which = np.repeat(begin[ids[part]] - np.cumsum(times) + times, times) + np.arange(times.sum())
                    pair = np.repeat(row[part] - low, times) * wide + query[which]
                    add = np.repeat(w[part], times) * boost[which]
                    if len(pair) * 8 > (high - low) * wide:  # most queries meet most rows
                        score = np.bincount(pair, add, (high - low) * wide)
                        met = np.zeros(len(score), bool)
                        met[pair] = True
                    else:
                        code, back = np.unique(pair, return_inverse=True)
                        score, met = np.bincount(back, add, len(code)), None
                    if met is not None:
                        code = np.flatnonzero(met)
                        score = score[code]
                    keep = score >= min_score
                    code, score = code[keep], score[keep]
                    at = _first(code % wide, code // wide, score, wide, hits, digits)
                    keys = batch.column("_key").take(pa.array(code[at] // wide + low))
                    q = pa.array([names[i] for i in code[at] % wide], q_type)
                    yield pa.RecordBatch.from_arrays([q, keys, pa.array(score[at], pa.float64())], ["q", "_key", "score"])
                    low = high

        found = self.rows.mapInArrow(ranked, f"q {kinds['q']}, _key {kinds['_key']}, score double")
        return best(found, min_score, digits=digits, hits=hits)


def _first(q: np.ndarray, row: np.ndarray, score: np.ndarray, wide: int, hits: int, digits: int) -> np.ndarray:
    """Places of the `hits` first pairs of each query by rounded score, falling, and row."""
    near = np.arange(len(q))
    if hits == 1:  # only what rounds to the greatest can be it
        top = np.full(wide, -np.inf)
        np.maximum.at(top, q, score)
        near = np.flatnonzero(score >= top[q] - 2 * 10.0**-digits)
    order = near[np.lexsort((row[near], -np.round(score[near], digits), q[near]))]
    begin = np.searchsorted(q[order], np.arange(wide))
    return order[np.arange(len(order)) - begin[q[order]] < hits]


def best_rows(asked: DataFrame, table: DataFrame, key: str, text: str, hits: int = 1, min_score: float = 0.0) -> DataFrame:
    """(q, _key, score): the best rows of a table for queries asked (q, token, boost). A query's pairs with rows stay in a task where a task can hold what is asked."""
    asked = written(asked)
    if is_small(asked):
        blocks = Blocks(table, key, text, asked)
        if blocks.plain:
            return blocks.best(asked, hits, min_score)
    only = written(asked.select("token").unionByName(asked.sparkSession.sql("select '' as token")).distinct())
    return best(scores(asked, written(index(table, key, text, only=only))).select("q", "_key", "score"), min_score, hits=hits)


# --- strategies: which tokens of a query count


def predicted_span(words: Column, weights: Column) -> Column:
    """Around the greatest weight, if above 0.75, up to two words either way of more than 0.75 of it; the words of that span."""
    begin, n = _span(weights)
    return F.when(n > 0, F.slice(words, begin + 1, n)).otherwise(F.array().cast("array<string>"))


def _span(weights: Column) -> tuple[Column, Column]:
    """Begin and length of the predicted span."""
    top = F.array_max(weights)
    at = (F.array_position(weights, top) - 1).cast("int")
    strong = lambda i: F.coalesce(F.when(i >= 0, F.get(weights, i)) > 0.75 * top, F.lit(False))
    left = F.when(strong(at - 2), at - 2).when(strong(at - 1), at - 1).otherwise(at)
    right = F.when(strong(at + 2), at + 2).when(strong(at + 1), at + 1).otherwise(at)
    return left, F.when(top > 0.75, right - left + 1).otherwise(0)


def _standard(asked: DataFrame, search: Callable, max_edits: int) -> DataFrame:
    """All tokens."""
    return search(_weighted(asked, 0.4, max_edits))


def _predict(asked: DataFrame, search: Callable, max_edits: int) -> DataFrame:
    """The tokens of the predicted span, which then all count wholly; without weights all tokens."""
    if "_ws" not in asked.columns:
        return search(asked)
    begin, n = _span(F.col("_ws"))
    inside = asked.where((F.col("at") >= begin) & (F.col("at") < begin + n))
    return search(inside)


def _ngram(asked: DataFrame, search: Callable, max_edits: int, n_ngrams: int = 3) -> DataFrame:
    """Of queries of more than n_ngrams tokens the best window of so many, grown to either side while its best score rises; -1 turns that off."""
    asked = _weighted(asked, 0.6, max_edits)
    return search(asked) if n_ngrams < 0 else search(asked, window=n_ngrams)


def _weighted(asked: DataFrame, least: float, max_edits: int) -> DataFrame:
    """Tokens below least are left out, from 0.8 on they count wholly; fuzzy ones by their weight."""
    if "_w" not in asked.columns:
        return asked
    w = F.col("_w")
    if max_edits:
        return asked.withColumn("boost", F.col("boost") * w)
    return asked.where(w >= least).withColumn("boost", F.col("boost") * F.when(w < 0.8, w).otherwise(1.0))


STRATEGIES: dict[str, Callable] = {"standard": _standard, "ngram": _ngram, "predict": _predict}


def best_window(found: DataFrame, n: int = 3, min_score: float = 0.0) -> DataFrame:
    """N-gram strategy over contributions found (q, _key, at, s, size): the best window of n tokens, the first of equals, grown by the token to its left or right while its best score rises.

    Returns (q, _key, score, start, stop). Each round is a sum over contributions, so a query may meet any number of rows;
    a direction that once brought nothing is left.
    """
    found = written(found.select("q", "_key", "at", "s", "size"))
    low, high = F.greatest(F.col("at") - n + 1, F.lit(0)), F.least("at", F.greatest(F.col("size") - n, F.lit(0)))
    windows = found.where(low <= high).withColumn("start", F.explode(F.sequence(low, high))).groupBy("q", "start", "_key").agg(F.sum("s").alias("score"), F.first("size").alias("size"))
    state = windows.groupBy("q").agg(F.min_by(F.struct("_key", "score", "start", "size"), F.struct(-F.round("score", 9), "start", "_key")).alias("b")).select("q", "b.*")
    state = written(state.withColumn("stop", F.least(F.col("start") + n, F.col("size"))).withColumn("ways", F.array(F.lit(-1), F.lit(1))))
    done = None
    while True:
        grown = state.withColumn("way", F.explode("ways")).withColumn("b", F.col("start") - (F.col("way") < 0).cast("int")).withColumn("e", F.col("stop") + (F.col("way") > 0).cast("int"))
        grown = grown.where((F.col("b") >= 0) & (F.col("e") <= F.col("size"))).select("q", "way", "b", "e", F.col("score").alias("now"))
        sums = found.join(grown, "q").where((F.col("at") >= F.col("b")) & (F.col("at") < F.col("e"))).groupBy("q", "way", "b", "e", "now", "_key").agg(F.sum("s").alias("score"))
        tops = sums.groupBy("q", "way").agg(F.min_by(F.struct("_key", "score", "b", "e", "now"), F.struct(-F.round("score", 9), "_key")).alias("t")).where(F.round("t.score", 9) > F.round("t.now", 9))
        step = written(tops.groupBy("q").agg(F.min_by("t", F.struct(-F.round("t.score", 9), "way")).alias("t"), F.array_sort(F.collect_list("way")).alias("ways")))
        rest = state.join(step, "q", "left_anti").select("q", "_key", "score", "start", "stop")
        done = rest if done is None else done.unionByName(rest)
        if step.isEmpty():
            return done.where(F.col("score") >= min_score)
        state = written(state.select("q", "size").join(step, "q").select("q", "t._key", "t.score", F.col("t.b").alias("start"), "size", F.col("t.e").alias("stop"), "ways"))


# --- the lookup join


def lookup(
    left: DataFrame, right: DataFrame, query: str, text: str, right_key: str, *, max_edits: int = 0, prefix_length: int = 1, min_score: float = 0.0, boost_acronyms: bool = False,
    popularity: str | None = None, weights: str | None = None, stop_words: Iterable[str] = (), right_select: list[str] | None = None, where: Callable[[DataFrame], DataFrame] = lambda d: d,
    equal: Mapping[str, str] | None = None, tokenize: str | None = QUERY_BREAK, strategy: str | Callable = "standard", strategy_params: Mapping[str, object] | None = None, tokens: bool = False, postings: DataFrame | None = None,
) -> DataFrame:
    """left with the best row of right for its query: a left join, null where nothing matches.

    query is text, parted by the pattern tokenize (None: it is one token, and so are the texts of right); with `tokens` it is an
    array of tokens. An array of texts otherwise: each is a query, and the column `array` holds their results in order.
    Columns of right follow those of left, then _score_, _tags_ (matched tokens), _startIndex_ and _endIndex_ (their span
    in the query). where filters rows of right first; equal, of right's columns to left's, asks for equal values, null
    ones aside. Stop words are left out as they are spelt. Weights is an array aligned with the query's tokens. strategy is
    one of STRATEGIES or a function like those, with its params. postings is a stored index of right.
    """
    if left.schema[query].dataType.typeName() == "array" and not tokens:
        options = {"max_edits": max_edits, "prefix_length": prefix_length, "min_score": min_score, "boost_acronyms": boost_acronyms, "popularity": popularity, "stop_words": stop_words, "where": where, "equal": equal, "tokenize": tokenize, "strategy": strategy, "strategy_params": strategy_params, "postings": postings}
        return _lookup_array(left, right, query, text, right_key, right_select, options)
    run = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    params = dict(strategy_params or {})
    known = run.__code__.co_varnames[3 : run.__code__.co_argcount]
    if unknown := set(params) - set(known):
        raise ValueError(f"strategy has no {', '.join(sorted(unknown))}")

    left = written(left.withColumn("_q", F.monotonically_increasing_id()))  # else ids could differ where left is read again
    words = F.col(query) if tokens else F.array(F.col(query)) if tokenize is None else F.filter(F.split(F.col(query), tokenize), lambda t: t != "")
    stop = list(stop_words)
    asked = left.where(F.col(query).isNotNull()).select("_q", words.alias("_words"), *(F.col(c).alias(f"_eq{i}") for i, c in enumerate((equal or {}).values())), *([F.col(weights).alias("_ws")] if weights else []))
    if stop:  # weights go with their tokens
        keep = F.filter(F.transform("_words", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: ~x["t"].isin(stop))
        asked = asked.withColumn("_words", keep)
        asked = asked.withColumn("_ws", F.transform("_words", lambda x: F.get("_ws", x["i"]))) if weights else asked
        asked = asked.withColumn("_words", F.transform("_words", lambda x: x["t"]))
    others = [c for c in asked.columns if c not in ("_q", "_words")]
    asked = asked.select(F.col("_q").alias("q"), F.posexplode("_words").alias("at", "raw"), F.size("_words").alias("size"), *others)
    short = F.col("raw").rlike("^[A-Z]{2}$")
    token = F.when(short, F.repeat("raw", 2)).otherwise(F.lower("raw")) if boost_acronyms else F.lower("raw")
    boost = F.when(short, 15.0 if max_edits else 4.0).otherwise(1.0) if boost_acronyms else F.lit(1.0)
    asked = asked.select("q", "at", "size", token.alias("token"), boost.alias("boost"), *others, *([F.get("_ws", F.col("at")).alias("_w")] if weights else []))
    asked = written(asked)

    rows = where(right)
    made: dict[str, object] = {}

    def blocks() -> Blocks | None:
        if "blocks" not in made:
            fits = postings is None and not max_edits and not equal and is_small(asked)
            found = Blocks(rows, right_key, text, asked, boost_acronyms, tokenize is None, popularity) if fits else None
            made["blocks"] = found if found and found.plain else None
        return made["blocks"]

    def stored() -> DataFrame:
        if "index" not in made:
            only = None
            if postings is None and not max_edits:  # else terms that are near are wanted, too
                only = written(asked.select("token").unionByName(left.sparkSession.sql("select '' as token")).distinct())
            made["index"] = written(index(rows, right_key, text, boost_acronyms, tokenize is None, only) if postings is None else postings)
        return made["index"]

    pop = rows.select(F.col(right_key).alias("_key"), F.col(popularity).alias("pop")) if popularity else None

    def search(some: DataFrame, window: int | None = None) -> DataFrame:
        if window is None and blocks():
            top = written(blocks().best(some, 1, min_score))
            words = left.sparkSession.createDataFrame(list(enumerate(blocks().terms)), "i int, token string")
            met = blocks().rows.join(F.broadcast(top), "_key").select("q", "_key", "score", F.explode("ids").alias("i"))  # a row for each query at most
            return spans(met.join(words, "i").join(some.select("q", "at", "token"), ["q", "token"]))
        found = contributions(some, stored(), max_edits, prefix_length)
        if equal:
            own = rows.select(F.col(right_key).alias("_key"), *(F.col(c).alias(f"_own{i}") for i, c in enumerate(equal)))
            found = found.join(own, "_key")
            for i in range(len(equal)):
                found = found.where(F.col(f"_eq{i}").isNull() | (F.col(f"_eq{i}") == F.col(f"_own{i}")))
        if pop is not None:
            found = found.join(pop, "_key").withColumn("s", F.col("s") * F.col("pop"))
        found = written(found.select("q", "at", "size", "token", "_key", "s"))
        if window is None:
            top = best(found.groupBy("q", "_key").agg(F.sum("s").alias("score")), min_score).withColumns({"start": F.lit(0), "stop": F.lit(2**31 - 1)})
        else:
            top = best_window(found, window, min_score)
        return spans(found.join(top, ["q", "_key"]).where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop"))))

    def spans(met: DataFrame) -> DataFrame:
        return met.groupBy(F.col("q").alias("_q"), "_key").agg(F.first("score").cast("float").alias("_score_"), F.array_sort(F.collect_set("token")).alias("_tags_"), F.min("at").alias("_startIndex_"), F.max("at").alias("_endIndex_"))

    top = run(asked, search, max_edits, **params)
    keep = right_select or right.columns
    matched = top.join(rows, F.col("_key") == F.col(right_key)).select("_q", *keep, "_score_", "_tags_", "_startIndex_", "_endIndex_")
    return left.join(matched, "_q", "left").drop("_q")


def _lookup_array(left: DataFrame, right: DataFrame, query: str, text: str, right_key: str, right_select: list[str] | None, options: dict) -> DataFrame:
    keep = right_select or right.columns
    left = written(left.withColumn("_row", F.monotonically_increasing_id()))
    parts = left.select("_row", F.posexplode(query).alias("_at", "_query"))
    found = lookup(parts, right, "_query", text, right_key, right_select=right_select, **options)
    result = F.struct(*keep, "_score_", "_tags_", "_startIndex_", "_endIndex_")
    listed = found.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", result.alias("r")))), lambda x: x["r"]).alias("array"))
    return left.join(listed, "_row", "left").drop("_row")


def lookups(left: DataFrame, right: DataFrame, queries: Sequence[str], text: str, right_key: str, right_select: list[str] | None = None, **options) -> DataFrame:
    """left with a struct `<query>_res` of the best row of right for each query column; its fields are null where nothing matches."""
    keep = right_select or right.columns
    left = written(left.withColumn("_row", F.monotonically_increasing_id()))
    one = left.select("_row", F.posexplode(F.array(*queries)).alias("_at", "_query"))
    found = lookup(one, right, "_query", text, right_key, right_select=right_select, **options)
    result = F.struct(*keep, "_score_", "_tags_", "_startIndex_", "_endIndex_")
    wide = found.groupBy("_row").agg(*(F.max(F.when(F.col("_at") == i, result)).alias(f"{c}_res") for i, c in enumerate(queries)))
    return left.join(wide, "_row").drop("_row")


# --- embeddings by token


def token_vectors(df: DataFrame, tokens: str, embeddings: DataFrame, output: str, how: str = "sum", stop_words: Iterable[str] = ()) -> DataFrame:
    """df with the vectors of an array of tokens, from embeddings (token, vector): their `sum`, or an `array` aligned with the tokens in which those that are not known are null.

    Stop words have no vector. A sum over no known token is null. Rows are told apart by an id of their own.
    """
    df = written(df.withColumn("_row", F.monotonically_increasing_id()))
    parts = df.select("_row", F.posexplode(tokens).alias("_at", "token"))
    stop = list(stop_words)
    if stop:
        parts = parts.withColumn("token", F.when(~F.col("token").isin(stop), F.col("token")))
    known = embeddings.dropDuplicates(["token"]).select("token", F.col("vector").cast("array<double>").alias("vector"))
    found = parts.join(known, "token", "left")
    if how == "array":
        out = found.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "vector"))), lambda x: x["vector"]).alias(output))
    else:
        cells = found.where("vector is not null").select("_row", F.posexplode("vector").alias("_i", "_x")).groupBy("_row", "_i").agg(F.sum("_x").alias("_x"))
        out = cells.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda p: p["_x"]).alias(output))
    return df.join(out, "_row", "left").drop("_row")


def hit_percent(df: DataFrame, tokens: str, embeddings: DataFrame) -> DataFrame:
    """(words, hits, percent): how many of all tokens have a vector."""
    parts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    found = parts.join(embeddings.select("token", F.lit(1).alias("known")).distinct(), "token", "left")
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("hits")).withColumn("percent", F.try_divide(100 * F.col("hits"), F.col("words")))


# --- beam search


def best_path(candidates: Sequence[Sequence], chances: Mapping[tuple, float] | Callable, default: object = None, most: int = 32) -> list:
    """One of the candidates for each place, so that the product of the chances of neighbours is about the greatest.

    Paths are grown from the last chosen place until there are `most` of them, then the next place of the likeliest, the last of
    equals, is chosen, and only paths through it go on. Where no path can go on, `default` is chosen. chances is a
    function of two neighbours, or a map by both and a kind, of which the product counts.
    """
    if not callable(chances):
        kinds, table = sorted({k[2] for k in chances}), chances

        def chances(a: object, b: object) -> float:
            out = 1.0
            for kind in kinds:
                out *= table.get((a, b, kind), 0.0)
            return out

    chosen: list = []
    paths = [((c,), 1.0) for c in (candidates[0] if candidates else ())]
    while len(chosen) < len(candidates):
        if not paths:
            paths = [((default,), 0.0)]
        while 0 < len(paths) < most and len(chosen) + len(paths[0][0]) < len(candidates):
            grown = [((*p, c), s * chances(p[-1], c)) for p, s in paths for c in candidates[len(chosen) + len(p)]]
            if not grown:
                break
            paths = grown
        top = max(s for _, s in paths)
        first = [p[0] for p, s in paths if s == top][-1]
        chosen.append(first)
        # what is left are paths from the chosen place; it alone is grown again
        rest = [(p[1:], s) for p, s in paths if p[0] == first and len(p) > 1]
        if rest or len(chosen) == len(candidates):
            paths = rest
        else:
            paths = [((c,), chances(first, c)) for c in candidates[len(chosen)]]
    return chosen
