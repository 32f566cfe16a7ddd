"""Pipeline stages, out-of-fold predictions, thresholds, classifiers by label component, score calibration and tests."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol, HasRawPredictionCol, HasSeed
from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.functions import text as X, vectors as V
from larkspur.operators import relational as R, search as S


class Stage(Transformer):
    """Any function of a DataFrame as a pipeline stage."""

    def __init__(self, function: Callable[[DataFrame], DataFrame]) -> None:
        super().__init__()
        self.function = function

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.function(dataset)


class ColumnStage(Transformer, HasInputCol, HasOutputCol):
    """A function of a Column, from inputCol to outputCol."""

    @keyword_only
    def __init__(self, *, function: Callable[[Column], Column] | None = None, inputCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        given = dict(self._input_kwargs)
        self.function = given.pop("function", None) or self.column
        self._set(**given)

    def column(self, x: Column) -> Column:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), self.function(F.col(self.getInputCol())))


class SocialCleaner(ColumnStage):
    def column(self, x: Column) -> Column:
        return X.clean_social(x)


class ArrayHasher(ColumnStage):
    """Hashed term frequencies of a token array as a sparse map."""

    num_features = 2048

    def column(self, x: Column) -> Column:
        return V.hashed_counts(x, self.num_features)


class RawToScore(ColumnStage):
    """A score from 0 to 1 of a two-class raw prediction, a vector or an array."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = F.col(self.getInputCol())
        x = x if dataset.schema[self.getInputCol()].dataType.typeName() == "array" else vector_to_array(x)
        return dataset.withColumn(self.getOutputCol(), V.margin_score(x))


class SentenceSplitter(Transformer, HasInputCol, HasOutputCol):
    """Phrases of a text, a row for each with its number, or an array of them."""

    def __init__(self, inputCol: str, outputCol: str, phraseIdCol: str = "phraseId", least: int = 3, most: int = 20, explode: bool = True) -> None:
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.phrase_id, self.least, self.most, self.explode = phraseIdCol, least, most, explode

    def _transform(self, dataset: DataFrame) -> DataFrame:
        phrases = X.sentences(self.getInputCol(), self.least, self.most)
        rest = [c for c in dataset.columns if c != self.getInputCol()]
        if self.explode:
            return dataset.select(*rest, F.posexplode(phrases).alias(self.phrase_id, self.getOutputCol()))
        return dataset.select(*rest, phrases.alias(self.getOutputCol()))


def group_by_stage(keys: Sequence[str], **reducers) -> Stage:
    return Stage(lambda df: R.group_by(df, keys, **reducers))


def add_id_stage(column: str, order: Sequence[str]) -> Stage:
    return Stage(lambda df: R.add_id(df, column, order))


class TagVectorizer(Estimator, HasInputCol, HasOutputCol):
    """Learns the most frequent tags of an array column: of those in min_freq rows or more the first top_classes, by number and then by name; trimmed, in lower case."""

    def __init__(self, inputCol: str, outputCol: str, min_freq: int = 1, top_classes: int = 1 << 18) -> None:
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.min_freq, self.top_classes = min_freq, top_classes

    def _fit(self, dataset: DataFrame) -> TagVectorizerModel:
        tags = dataset.select(F.explode(F.array_distinct(normal_tags(self.getInputCol()))).alias("tag"))
        counts = tags.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= self.min_freq)
        # top_classes bounds what is collected
        top = [r.tag for r in counts.orderBy(F.desc("n"), "tag").limit(self.top_classes).collect()]
        return TagVectorizerModel(self.getInputCol(), self.getOutputCol(), top)


class TagVectorizerModel(Model, HasInputCol, HasOutputCol):
    def __init__(self, inputCol: str, outputCol: str, tags: list[str]) -> None:
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.tags = tags

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own = normal_tags(self.getInputCol())
        return dataset.withColumn(self.getOutputCol(), F.transform(F.array(*map(F.lit, self.tags)), lambda t: F.array_contains(own, t).cast("double")))


def normal_tags(tags: str) -> Column:
    return F.transform(F.col(tags), lambda t: F.lower(F.trim(t)))


class TokenVectors(Transformer, HasInputCol, HasOutputCol):
    """Embeddings of an array of tokens, see search.token_vectors()."""

    def __init__(self, inputCol: str, outputCol: str, embeddings: DataFrame, how: str = "sum", stop_words: Iterable[str] = ()) -> None:
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.embeddings, self.how, self.stop_words = embeddings, how, tuple(stop_words)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return S.token_vectors(dataset, self.getInputCol(), self.embeddings, self.getOutputCol(), self.how, self.stop_words)


def train_embeddings(df: DataFrame, tokens: str, size: int = 300, min_count: int = 10, iterations: int = 1, seed: int = 38) -> DataFrame:
    """(token, vector) learned from an array of tokens."""
    from pyspark.ml.feature import Word2Vec

    model = Word2Vec(inputCol=tokens, outputCol="_v", vectorSize=size, minCount=min_count, maxIter=iterations, seed=seed).fit(df)
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vector"))


# --- folds


class FoldsPredictor(Estimator, HasSeed):
    """Predictions for rows that their model has not seen.

    fit() fits the estimator on all rows; transform() of the model trains it for each fold on the others, in parallel, and
    returns the predictions of each fold's own rows. Rows that meet force_train are in every training set and predicted by
    none; those that meet force_test are in no training set and predicted by a model of all the others.
    """

    folds = Param(Params._dummy(), "folds", "number of folds", TypeConverters.toInt)

    def __init__(self, estimator: Estimator, folds: int = 5, group: Sequence[str] = (), force_train: str | None = None, force_test: str | None = None, seed: int = 38, threads: int = 4) -> None:
        super().__init__()
        self._set(folds=folds, seed=seed)
        self.estimator, self.group, self.force_train, self.force_test, self.threads = estimator, group, force_train, force_test, threads

    def _fit(self, dataset: DataFrame) -> FoldsPredictorModel:
        return FoldsPredictorModel(self, self.estimator.fit(dataset))


class FoldsPredictorModel(Model):
    def __init__(self, parent: FoldsPredictor, full: Transformer) -> None:
        super().__init__()
        self.parent_, self.full = parent, full

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p, never = self.parent_, F.lit(False)
        train = F.coalesce(F.expr(p.force_train), never) if p.force_train else never
        test = F.coalesce(F.expr(p.force_test), never) if p.force_test else never
        rest = dataset.where(~train & ~test)
        always = dataset.where(train & ~test)

        def predicted(pair: tuple[DataFrame, DataFrame]) -> DataFrame:
            return p.estimator.fit(pair[0].unionByName(always)).transform(pair[1])

        pairs = R.random_split(rest, p.getOrDefault(p.folds), group=p.group, seed=p.getSeed())
        if p.force_test:
            pairs.append((rest, dataset.where(test)))
        with ThreadPool(p.threads) as pool:
            parts = pool.map(predicted, pairs)
        return reduce(DataFrame.unionByName, parts)


def fold_performance(df: DataFrame, estimator: Estimator, folds: int = 5, label: str = "label", prediction: str = "prediction", seed: int = 38) -> DataFrame:
    """(rows_, tp, fp, tn, fn, precision, recall, f1) of an estimator's predictions out of folds; 1 is positive."""
    out = FoldsPredictor(estimator, folds, seed=seed).fit(df).transform(df)
    yes, no = F.col(label) == 1, F.col(label) != 1
    hit, miss = F.col(prediction) == 1, F.col(prediction) != 1
    n = lambda c: F.sum(c.cast("long"))
    sums = out.agg(F.count("*").alias("rows_"), n(yes & hit).alias("tp"), n(no & hit).alias("fp"), n(no & miss).alias("tn"), n(yes & miss).alias("fn"))
    sums = sums.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
    return sums.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


# --- thresholds and metrics


class BinaryOptimalEvaluator(Estimator, HasLabelCol):
    """Chooses the threshold of a score column, see relational.optimal_threshold(), and keeps its metrics and those at about one half."""

    def __init__(self, scoreCol: str = "score", labelCol: str = "label", predictionCol: str = "prediction", optimize: str = "f1", where: str | None = None) -> None:
        super().__init__()
        self._set(labelCol=labelCol)
        self.score, self.prediction, self.optimize, self.where = scoreCol, predictionCol, optimize, where

    def _fit(self, dataset: DataFrame) -> BinaryOptimalEvaluatorModel:
        from larkspur.plans.session import written

        rows = dataset.where(self.where) if self.where else dataset
        curve = written(R.curves(rows, self.score, self.getLabelCol()))
        best = R.optimal_threshold(curve, self.optimize).first().asDict()
        base = R.base_threshold(curve).first()
        best["auc"] = R.area_under_roc(curve).first().auc
        p = chi_square(rows.select((F.col(self.score) >= best["threshold"]).cast("int").alias("a"), F.col(self.getLabelCol()).alias("b")), "a", "b").first()
        best["p_value"] = p.p_value if p else None
        return BinaryOptimalEvaluatorModel(self.score, self.prediction, best, base.asDict() if base else {})


class BinaryOptimalEvaluatorModel(Model):
    def __init__(self, score: str, prediction: str, metrics: dict, base: dict) -> None:
        super().__init__()
        self.score, self.prediction, self.metrics, self.base = score, prediction, metrics, base

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return apply_threshold(dataset, self.score, self.metrics["threshold"], self.prediction)


def apply_threshold(df: DataFrame, score: str, threshold: float, output: str) -> DataFrame:
    """1.0 where score is threshold or more, else 0.0; arrays one by one."""
    one = lambda x: F.when(x >= threshold, 1.0).otherwise(0.0)
    return df.withColumn(output, F.transform(score, one) if df.schema[score].dataType.typeName() == "array" else one(F.col(score)))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, expected) for all pairs of values of two columns; rows with a null are left out."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    rows, cols = known.groupBy("a").agg(F.sum("n").alias("na")), known.groupBy("b").agg(F.sum("n").alias("nb"))
    total = known.agg(F.sum("n").alias("all"))
    # values of both are categories, some tens
    grid = rows.crossJoin(F.broadcast(cols)).crossJoin(F.broadcast(total))
    return grid.join(known, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), (F.col("na") * F.col("nb") / F.col("all")).alias("expected"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """(statistic, degrees, p_value) of the test whether two columns are independent."""
    from larkspur.plans.session import written

    cells = written(contingency(df, a, b))
    out = cells.agg(F.sum((F.col("n") - F.col("expected")) ** 2 / F.col("expected")).alias("statistic"), ((F.countDistinct("a") - 1) * (F.countDistinct("b") - 1)).alias("degrees"))
    return out.withColumn("p_value", F.pandas_udf(lambda s, d: s.combine(d, _chi_tail), "double")("statistic", "degrees"))


def _chi_tail(x: float, degrees: int) -> float | None:
    """The chance of a chi-square value of x or more: the upper incomplete gamma function by its series or continued fraction."""
    if x is None or math.isnan(x) or degrees < 1:
        return None
    a, x = degrees / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def balanced_sample(df: DataFrame, label: str, n: int, key: Sequence[str], seed: int = 38) -> DataFrame:
    """n rows of each label, or all there are, in the order of a hash of key."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(*key, F.lit(seed)), *key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


# --- classifiers


class DiscreteVectorClassifier(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRawPredictionCol):
    """A binary model for each component of an array label, fitted in parallel; prediction and raw prediction are arrays with a component for each."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", rawPredictionCol: str = "rawPrediction", classifier: Callable[[], Estimator] | None = None, threads: int = 4) -> None:
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, rawPredictionCol=rawPredictionCol)
        self.classifier, self.threads = classifier, threads

    def _fit(self, dataset: DataFrame) -> DiscreteVectorClassifierModel:
        from pyspark.ml.classification import LinearSVC

        from larkspur.plans.session import written

        x, y = self.getFeaturesCol(), self.getLabelCol()
        features = array_to_vector(F.col(x).cast("array<double>")) if dataset.schema[x].dataType.typeName() == "array" else F.col(x)
        array = y if dataset.schema[y].dataType.typeName() == "array" else vector_to_array(y)
        # vectors are no column of a written table's readers elsewhere, so they are made again
        rows = dataset.select(features.alias("_x"), (F.col(array) if isinstance(array, str) else array).alias("_y")).where("_x is not null and _y is not null")
        rows = written(rows)
        n = rows.agg(F.max(F.size("_y"))).first()[0] or 0
        make = self.classifier or (lambda: LinearSVC(maxIter=30, regParam=1e-3))

        def one(i: int) -> Transformer:
            return make().setFeaturesCol("_x").setLabelCol("_l").fit(rows.select("_x", F.coalesce(F.get("_y", F.lit(i)), F.lit(0.0)).cast("double").alias("_l")))

        with ThreadPool(self.threads) as pool:
            return DiscreteVectorClassifierModel(self, pool.map(one, range(n)))


class DiscreteVectorClassifierModel(Model):
    def __init__(self, parent: DiscreteVectorClassifier, models: list) -> None:
        super().__init__()
        self.parent_, self.models = parent, models

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = self.parent_
        x = p.getFeaturesCol()
        out = dataset.withColumn("_x", array_to_vector(F.col(x).cast("array<double>")) if dataset.schema[x].dataType.typeName() == "array" else F.col(x))
        for i, m in enumerate(self.models):
            out = m.setFeaturesCol("_x").setPredictionCol(f"_p{i}").setRawPredictionCol(f"_r{i}").transform(out)
        raw, guess = F.array(*(vector_to_array(f"_r{i}") for i in range(len(self.models)))), F.array(*(F.col(f"_p{i}") for i in range(len(self.models))))
        return out.withColumn(p.getRawPredictionCol(), raw).withColumn(p.getPredictionCol(), guess).drop("_x", *(f"_{k}{i}" for i in range(len(self.models)) for k in "pr"))


#: Different margins that Platt's fit fetches at once; beyond them each step is a sum in Spark.
FETCH = 100_000


def platt_fit(df: DataFrame, margin: str, label: str, rounds: int = 100) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(a * margin + b)) is the likeliest chance of label 1, by Newton steps with line search; each step is one sum over all rows.

    Targets are (n1 + 1) / (n1 + 2) and 1 / (n0 + 2). Rows with a null are left out.
    """
    from larkspur.plans.session import written

    rows = df.select(F.col(margin).cast("double").alias("m"), (F.col(label) > 0).alias("y")).where("m is not null and y is not null")
    rows = written(rows.groupBy("m", "y").agg(F.count("*").alias("n")))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    yes, no = counts.get(True, 0), counts.get(False, 0)
    target = F.when(F.col("y"), (yes + 1) / (yes + 2)).otherwise(1 / (no + 2))

    held = rows.select("m", "y", "n").toArrow() if rows.count() <= FETCH else None  # few enough for the driver

    def sums(a: float, b: float) -> tuple[float, ...]:
        if held is not None:
            m, n = held.column("m").to_numpy(), held.column("n").to_numpy()
            t = np.where(held.column("y").to_numpy(), (yes + 1) / (yes + 2), 1 / (no + 2))
            z = m * a + b
            p = 1 / (1 + np.exp(np.clip(z, -700, 700)))
            h, g = n * p * (1 - p), n * (t - p)
            return tuple(float(x.sum()) for x in (n * (t * z + np.logaddexp(0, -z)), h * m**2, h, h * m, g * m, g))
        z = F.col("m") * a + b
        p = 1 / (1 + F.exp(z))
        # ln(1 + exp(z)) without overflow
        loss = F.col("n") * (target * z + F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0)))
        h, g = F.col("n") * p * (1 - p), F.col("n") * (target - p)
        return tuple(x or 0.0 for x in rows.agg(*(F.sum(x) for x in (loss, h * F.col("m") ** 2, h, h * F.col("m"), g * F.col("m"), g))).first())

    a, b = 0.0, math.log((no + 1) / (yes + 1))
    now = sums(a, b)
    for _ in range(rounds):
        loss, h11, h22, h21, g1, g2 = now
        if abs(g1) < 1e-5 and abs(g2) < 1e-5:
            break
        h11, h22 = h11 + 1e-12, h22 + 1e-12
        det = h11 * h22 - h21 * h21
        da, db = -(h22 * g1 - h21 * g2) / det, -(h11 * g2 - h21 * g1) / det
        slope, step = g1 * da + g2 * db, 1.0
        while step >= 1e-10:
            new = sums(a + step * da, b + step * db)
            if new[0] < loss + 1e-4 * step * slope:
                a, b, now = a + step * da, b + step * db, new
                break
            step /= 2
        else:
            break
    return a, b


class TermLikelihood(Estimator, HasInputCol, HasOutputCol):
    """How likely a term belongs to an entity: a linear classifier of embeddings learned from terms of a dictionary, with Platt scores.

    terms (term array of tokens, label 0 or 1); a term of several tokens has the mean of their vectors. Classes are balanced to the lesser.
    """

    def __init__(self, inputCol: str, outputCol: str, terms: DataFrame, embeddings: DataFrame, seed: int = 38) -> None:
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.terms, self.embeddings, self.seed = terms, embeddings, seed

    def _fit(self, dataset: DataFrame) -> TermLikelihoodModel:
        from pyspark.ml.classification import LinearSVC

        from larkspur.plans.session import written

        rows = S.token_vectors(self.terms.select("term", "label"), "term", self.embeddings, "_v").where("_v is not null")
        rows = rows.withColumn("_v", F.transform("_v", lambda x: x / F.size("term"))).withColumn("_k", F.array_join("term", " "))
        counts = rows.groupBy("label").count().agg(F.min("count")).first()[0] or 0
        some = written(balanced_sample(rows, "label", counts, ["_k"], self.seed).withColumn("_x", array_to_vector("_v")).select("_x", F.col("label").cast("double").alias("label")))
        model = LinearSVC(featuresCol="_x", labelCol="label", maxIter=50, regParam=1e-3).fit(some)
        margins = model.transform(some).select(F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("m"), "label")
        return TermLikelihoodModel(self.getInputCol(), self.getOutputCol(), self.embeddings, model, platt_fit(margins, "m", "label"))


class TermLikelihoodModel(Model, HasInputCol, HasOutputCol):
    """Of each token of an array its likelihood, in order; null for one without a vector."""

    def __init__(self, inputCol: str, outputCol: str, embeddings: DataFrame, model: Transformer, platt: tuple[float, float]) -> None:
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.embeddings, self.model, self.platt = embeddings, model, platt

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, offset = [float(x) for x in self.model.coefficients.toArray()], float(self.model.intercept)
        margin = lambda v: F.aggregate(F.zip_with(v, F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(offset), lambda s, x: s + x)
        out = S.token_vectors(dataset, self.getInputCol(), self.embeddings, "_vs", "array")
        return out.withColumn(self.getOutputCol(), F.transform("_vs", lambda v: F.when(v.isNotNull(), V.platt_score(F.array(-margin(v), margin(v)), *self.platt)))).drop("_vs")
