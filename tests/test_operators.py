"""Fixtures with known answers, and invariants of operators that SQL does not express."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as X, vectors as V
from larkspur.operators import entities as E, relational as R, search as S
from larkspur.plans.pipeline import Pipeline, Plan, Step
from larkspur.sources import files
from larkspur.streaming import microbatch


def looked_up(spark, left, right, **options):
    a = spark.createDataFrame([(i, q) for i, q in enumerate(left)], "i int, query string")
    b = spark.createDataFrame(list(enumerate(right)), "k int, text string")
    return [r.text for r in S.lookup(a, b, "query", "text", "k", **options).orderBy("i").collect()]


def test_lookup(spark):
    assert looked_up(spark, ["foo", "bar"], ["this is bar", "I am out of here!"]) == [None, "this is bar"]
    assert looked_up(spark, ["Twitter", "Fort Worth"], ["Titter Khel", "I am out of here!", "Fort Worth, TX"], min_score=1.0) == [None, "Fort Worth, TX"]
    places = ["Illinois, IL", "Wœrth, FR", "Fort Worth, TX", "Des Plaines, US, IL", "Sainte-Anne-des-Plaines, CA", "Beau Bassin MU", "Ohio, OH, US", "Columbus, US, OH", "Columbus, NI"]
    asked = ["Fort Worth, TX", "Des Plaines, IL", "IL", "OH", "Columbus, OH"]
    assert looked_up(spark, asked, places, boost_acronyms=True) == ["Fort Worth, TX", "Des Plaines, US, IL", "Illinois, IL", "Ohio, OH, US", "Columbus, US, OH"]
    assert looked_up(spark, ["Colombus"], places, max_edits=1)[0] in {"Columbus, US, OH", "Columbus, NI"}
    assert looked_up(spark, [None, ""], places) == [None, None]


def test_window_strategy(spark):
    places = ["Wœrth, FR", "Sainte-Anne-des-Plaines, CA", "Cardiff", "South Wales Valley", "New Glasgow, Californien CA", "North west Glasgow GB Scotland", "Glasgow South France"]
    right = spark.createDataFrame(list(enumerate(places)), "k int, text string")
    words = "In South east of CA lies the beauty of Glasgow in Scotland England".lower().split()
    asked = spark.createDataFrame([(0, i, w) for i, w in enumerate(words)], "q int, at int, token string")
    found = asked.join(S.weighed(S.index(right, "k", "text")), "token").select("q", "_key", "at", F.col("w").alias("s"), F.lit(len(words)).alias("size"))
    (best,) = S.best_window(found, 3).collect()
    assert places[best._key] == "North west Glasgow GB Scotland" and best.start >= 9


def test_splits(spark):
    rows = spark.range(1000).selectExpr("cast(id as int) as id", "cast(id % 2 as int) as col1", "cast(id % 7 as int) as col2")
    for folds, group, strata in ((1, (), ()), (5, (), ()), (1, ("col1", "col2"), ()), (5, (), ("col1",)), (1, (), ("col1",))):
        pairs = R.random_split(rows, folds, 0.75, group, strata)
        assert len(pairs) == max(1, folds)
        for train, test in pairs:
            a, b = {r.id for r in train.collect()}, {r.id for r in test.collect()}
            assert not a & b and len(a | b) == 1000
            assert group or abs(len(b) / 1000 - (1 / folds if folds > 1 else 0.25)) < 0.1
            if group:
                assert not {(r % 2, r % 7) for r in a} & {(r % 2, r % 7) for r in b}
    assert [r.id for r in R.random_split(rows)[0][1].collect()] == [r.id for r in R.random_split(rows)[0][1].collect()]
    assert R.distribution([0.5, 0.25, 0.25]) == [0, 1, 2, 0]


def test_threshold(spark):
    rows = [(0.1 + i / 1000, 1.0) for i in range(20)] + [(0.2 + i / 1000, 0.0) for i in range(140)]
    rows += [(0.5 + i / 1000, 1.0) for i in range(10)] + [(0.52 + i / 1000, 0.0) for i in range(190)]
    rows += [(0.75 + i / 1000, 1.0) for i in range(90)] + [(0.85 + i / 1000, 0.0) for i in range(10)]
    curve = R.curves(spark.createDataFrame(rows, "score double, label double"), "score", "label")
    best = R.optimal_threshold(curve).first()
    assert (best.threshold, best.tp, best.tn, best.fp, best.fn) == (0.75, 90, 330, 10, 30)
    assert R.optimal_threshold(curve, "precision:2").first().threshold == 0
    assert R.optimal_threshold(curve, "recall:0.9").first().recall >= 0.9
    base = curve.where("threshold = 0.5").first()
    assert round(base.precision, 3) == 0.333 and round(base.recall, 3) == 0.833 and round(base.f1, 3) == 0.476


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.simplify(F.lit("L'Été Noël-d'Or"))) == "   ete noel   or".replace("   ete", "  ete")
    assert one(X.links_as_blanks(F.lit("see http://a.b/c now"))) == "see " + " " * len("http://a.b/c") + " now"
    assert one(X.clean_social(F.lit("RT @me: #fun :) http://x.y a@b.com"), {":)": 1})) == "   user : fun  great   link  a@b.com"
    assert one(X.stem(F.lit("rapidement"))) == "rapid" and one(X.stem(F.lit("as"))) == "as"
    assert one(X.house_number(F.lit("12 rue de la Paix 75002 Paris"))) == "12" and one(X.postcode(F.lit("12 rue 75002 Paris"))) == "75002"
    assert one(X.text_similarity(F.lit("rue de la Paix"), F.lit("Rue de la paix"), 1.0, 0.0)) == pytest.approx(1)
    assert one(X.matching_score(F.lit("maison"), F.lit("maisom"))) == pytest.approx(1 - 1 / 6)
    assert [tuple(r) for r in one(X.split_runs(F.lit("ab. cd")))] == [("ab", 0, 0), (". ", 1, 0), ("cd", 2, 1)]
    assert one(S.predicted_span(F.split(F.lit("a b c d e"), " "), F.array(*map(F.lit, (0.1, 0.7, 0.9, 0.2, 0.8))))) == ["b", "c", "d", "e"]


def test_vectors(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert one(V.cosine(lit(1, -2, 4, 10), lit(1, 2, 7, -10))) == pytest.approx(-75 / (121**0.5 * 154**0.5))
    a, b = (F.create_map(*(F.lit(x) for p in m for x in p)) for m in (((3, 2.0), (8, 1.0)), ((3, 2.0), (6, 1.0), (45, 0.5))))
    assert one(V.sparse_add(a, b)) == {3: 4.0, 8: 1.0, 6: 1.0, 45: 0.5} and one(V.sparse_cosine(a, b)) == pytest.approx(4 / (5**0.5 * 5.25**0.5))
    assert one(V.common_dimensions(a, b)) == 2.0
    counts = one(V.hashed_counts(F.split(F.lit("This is the best on the earth !"), " ")))
    assert len(counts) == 7 and sum(counts.values()) == 8 and sorted(counts.values()) == [1.0] * 6 + [2.0]
    assert one(V.closest(lit(1, 0), F.array(lit(0, 1), lit(2, 0.1)))) == 1
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (0.0, 4.0))))
    assert [one(V.in_polygon(F.lit(x), F.lit(y), ring)) for x, y in ((1.0, 1.0), (3.0, 3.0), (2.0, 2.0), (0.0, 0.0))] == [True, False, True, True]


def test_pipeline(spark, tmp_path):
    steps = [Step("a", {"one": lambda d: d.withColumn("x", F.lit(1)), "two": lambda d: d.withColumn("x", F.lit(2))}, snapshot=True, reuse_snapshot=True), Step("b", {"sum": lambda d: d.agg(F.sum("x").alias("s"))}, rename={"s": "total"})]
    p = Pipeline("m", steps, str(tmp_path / "snap"), str(tmp_path / "log"))
    runs = p.run(spark.range(3), Plan().switch(a=["one", "two"]).merge(Plan().set("a", "two").repeat(2)), outputs=["a"])
    assert [df.first().total for _, df, _ in runs] == [3, 6, 6, 6] and runs[0][2]["a"].count() == 3
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_sources(spark, tmp_path):
    odd = spark.range(2).withColumnRenamed("id", "a b")
    assert files.checkpoint(odd, str(tmp_path / "c")).columns == ["a b"] and files.restore(spark, str(tmp_path / "none")) is None
    (tmp_path / "e.txt").write_text("2 2\nx 1 2.5\ny 3 4\n")
    assert [(r.token, r.vector) for r in files.read_embeddings(spark, str(tmp_path / "e.txt")).collect()] == [("x", [1.0, 2.5]), ("y", [3.0, 4.0])]
    pages = spark.createDataFrame([("u", '<a href="v">'), ("v", "<A HREF='w'>"), ("w", '<a href="u">')], "url string, html string")
    assert {(r.url, r.depth) for r in files.crawl(pages, "u").collect()} == {("u", 0), ("v", 1), ("w", 2)}
    assert files.newest_file(spark, str(tmp_path / "e.txt")).first().path.endswith("e.txt")


def test_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "in" / "events"))
    stream = microbatch.parquet_stream(spark, str(tmp_path / "in" / "events"), schema.simpleString()[7:-1].replace(":", " "))
    q = microbatch.hourly_sink(stream.where("event_type is not null"), "ts", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.json(str(tmp_path / "out")).count() == spark.read.parquet(f"{sf}/events.parquet").where("event_type is not null").count()


def test_relational(spark):
    rows = spark.createDataFrame([("a", 1, [1.0, 5.0], "x"), ("a", 2, [3.0, 2.0], "y"), ("b", None, None, None)], "k string, n int, v array<double>, s string")
    out = {r.k: r for r in R.group_by(rows, ["k"], max_of=["v"], sum_of=["n"]).collect()}
    assert (out["a"].n, out["a"].v, out["a"].s) == (3, [3.0, 5.0], "x") and out["b"].n is None
    assert R.group_by(rows, ["k"], max_of=["n"], peek_rest=False).columns == ["k", "n"]
    log = spark.createDataFrame([(1, 1, "create", "a"), (1, 2, "update", None), (1, 3, "update", "b"), (2, 1, "create", "c"), (2, 2, "delete", None), (2, 3, "update", "d"), (3, 1, "delete", None), (3, 2, "create", "e")], "k int, ts int, kind string, v string")
    assert {r.k: r.v for r in R.fold_log(log, "k", "ts", "kind", "v").collect()} == {1: "b", 3: "e"}


def test_entities(spark):
    flat = spark.createDataFrame([("g", "t", 1, 0, ["new", "york"]), ("g", "t", 1, 1, ["city"]), ("g", "t", 2, 0, ["paris"]), ("g", "t", 3, 5, ["rome"])], "tag_group string, tag string, entity_group int, entity_index int, synonym array<string>")
    nested = E.group_entities(flat)
    assert sorted(r.legs for r in nested.collect()) == [[[["new", "york"]], [["city"]]], [[["paris"], ["rome"]]]]
    assert E.group_entities(E.ungroup_entities(nested)).exceptAll(nested).count() == 0 and E.ungroup_entities(nested).count() == 4
    texts = spark.createDataFrame([("the city of New York",), ("new city york",), ("city of new yorke",), ("",)], "text string").join(nested.where("size(legs) = 2"))
    rows = texts.select(F.split("text", " ").alias("t"), "legs").select(E.entity_in_text("t", "legs").alias("a"), E.entity_in_text("t", "legs", 0.7).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(True, True), (False, False), (False, True), (False, False)]
