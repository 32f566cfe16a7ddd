"""Entity dictionaries: an entity is a list of legs, a leg a list of synonyms, a synonym a list of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.functions import text as X, vectors as V


def group_entities(flat: DataFrame) -> DataFrame:
    """(tag_group, tag, legs) of rows (tag_group, tag, entity_group, entity_index, synonym).

    Rows of one entity_index are synonyms of a leg, legs are in the order of entity_index. Entities of a tag with a
    single leg become one, whose leg has the synonyms of all. Synonyms are sorted and keep repeats.
    """
    tag = ["tag_group", "tag"]
    legs = flat.groupBy(*tag, "entity_group", "entity_index").agg(F.sort_array(F.collect_list("synonym")).alias("leg"))
    whole = legs.groupBy(*tag, "entity_group").agg(F.sort_array(F.collect_list(F.struct("entity_index", "leg"))).alias("legs"))
    whole = whole.select(*tag, F.col("legs.leg").alias("legs"))
    single = whole.where(F.size("legs") == 1).groupBy(*tag).agg(F.array(F.sort_array(F.flatten(F.flatten(F.collect_list("legs"))))).alias("legs"))
    return single.unionByName(whole.where(F.size("legs") > 1))


def ungroup_entities(entities: DataFrame) -> DataFrame:
    """The rows that group_entities() takes; entities of a tag are numbered from 1, their legs from 0."""
    numbered = entities.withColumn("entity_group", F.row_number().over(Window.partitionBy("tag_group", "tag").orderBy("legs")))
    legs = numbered.select("tag_group", "tag", "entity_group", F.posexplode("legs").alias("entity_index", "leg"))
    return legs.select("tag_group", "tag", "entity_group", "entity_index", F.explode("leg").alias("synonym"))


def _matches(tokens: Column, synonym: Column, at: Column, min_score: float) -> Column:
    part = F.slice(tokens, at + 1, F.size(synonym))
    return (at + F.size(synonym) <= F.size(tokens)) & F.forall(F.zip_with(synonym, part, lambda a, b: X.matching_score(a, b)), lambda s: s >= min_score)


def entity_in_text(tokens: Column | str, legs: Column | str, min_score: float = 1.0) -> Column:
    """Whether each leg has a synonym whose tokens follow each other in tokens, each matched by min_score or more."""
    tokens, legs = (F.col(c) if isinstance(c, str) else c for c in (tokens, legs))
    places = F.transform(tokens, lambda _, i: i)
    return F.forall(legs, lambda leg: F.exists(leg, lambda s: F.exists(places, lambda i: _matches(tokens, s, i, min_score))))


def non_entity_tokens(tokens: Column | str, legs: Column | str, min_score: float = 1.0) -> Column:
    """Tokens at which not every leg has a synonym that begins there."""
    tokens, legs = (F.col(c) if isinstance(c, str) else c for c in (tokens, legs))
    return F.filter(tokens, lambda _, i: ~F.forall(legs, lambda leg: F.exists(leg, lambda s: _matches(tokens, s, i, min_score))))


# --- assigning entities to texts

#: Status of an entity by those of its synonyms: the first of these that any has counts. Fixed values.
STATUS_ORDER = ("proposed", "refined", "ok")
TRACE = "struct<iteration:int,userStatus:string,changed:boolean,score:double,changedOn:timestamp,stability:double>"


def trace(iteration: Column | int = -1, status: Column | str | None = None, changed: bool = False, score: float = 0.0) -> Column:
    """A new trace."""
    values = (F.lit(iteration).cast("int"), F.lit(status).cast("string"), F.lit(changed), F.lit(float(score)), F.lit("1900-01-01").cast("timestamp"), F.lit(0.0))
    return F.struct(*(v.alias(n) for v, n in zip(values, ("iteration", "userStatus", "changed", "score", "changedOn", "stability"), strict=True)))


def _moved(t: Column, changed: Column, iteration: Column, keep_changed: bool) -> Column:
    return t.withField("changed", (F.when(changed, True).otherwise(t["changed"]) if keep_changed else changed)).withField("changedOn", F.when(changed, F.current_timestamp()).otherwise(t["changedOn"])).withField("iteration", F.when(changed, iteration).otherwise(t["iteration"])).withField("stability", t["stability"] + F.when(changed, 1.0).otherwise(-1.0))


def with_changed(t: Column | str, changed: Column, iteration: Column | int) -> Column:
    """The trace after its entity has been looked at: a change has its time and iteration, and adds one to stability, none takes one away."""
    t = F.col(t) if isinstance(t, str) else t
    return _moved(t, F.coalesce(changed, F.lit(False)), F.lit(iteration).cast("int"), False)


def with_status(t: Column | str, status: Column, iteration: Column | int) -> Column:
    """The trace with a status; another one than before is a change."""
    t = F.col(t) if isinstance(t, str) else t
    return _moved(t, ~status.eqNullSafe(t["userStatus"]), F.lit(iteration).cast("int"), True).withField("userStatus", status)


def assign_entities(texts: DataFrame, synonyms: DataFrame, iteration: int = 0, min_score: float = 0.8) -> DataFrame:
    """texts (id, tag_group, tag, entities, trace, tokens) with the best tag, its matched synonyms and a new trace.

    synonyms is flat: tag_group, tag, entity_group, entity_index (the leg), synonym (tokens), status and, if tokens have vectors, vector
    and vectors in texts, aligned with tokens. Only tags of the text's group, and of its tag if it has one, are
    looked at. A synonym scores by the best stretch of as many tokens; a leg by its best synonym of min_score or more; an
    entity with a synonym in every leg by the mean of its legs; the tag with the best one is the text's, of equals the
    first by name. Then status is `validated` if all its synonyms are ok, else `matched`; without a tag it is
    `pending`. Texts whose status is `fixed` stay. Each row of texts is told apart by an id of its own.
    """
    from larkspur.plans.session import written

    texts = written(texts.withColumn("_row", F.monotonically_increasing_id()))
    open_ = texts.where(~F.col("trace.userStatus").eqNullSafe("fixed"))
    vectors = "vectors" in texts.columns and "vector" in synonyms.columns
    asked = open_.select("_row", F.col("tag_group").alias("_group"), F.col("tag").alias("_tag"), "tokens", *(["vectors"] if vectors else []))
    some = synonyms.where("size(synonym) > 0")
    met = asked.join(some, (F.col("_group") == some["tag_group"]) & (F.col("_tag").isNull() | (F.col("_tag") == some["tag"])))
    n = F.size("synonym")
    word = F.array_join("synonym", " ")

    def score(at: Column) -> Column:
        cosine = V.cosine(F.get("vectors", at), F.col("vector")) if vectors else None
        return X.matching_score(F.array_join(F.slice("tokens", at + 1, n), " "), word, cosine)

    places = F.when(F.size("tokens") > 0, F.sequence(F.lit(0), F.size("tokens") - 1)).otherwise(F.array().cast("array<int>"))
    scored = met.withColumn("_s", F.array_max(F.transform(places, score))).where(F.col("_s") >= min_score)
    entity = ["_row", "tag", "entity_group"]
    legs = scored.groupBy(*entity, "entity_index").agg(F.max_by(F.struct("_s", word.alias("word"), "status"), F.struct("_s", word)).alias("best"))
    found = legs.groupBy(*entity).agg(F.count("*").alias("found"), F.avg("best._s").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("entity_index", "best"))), lambda x: x["best"]["word"]).alias("words"), F.collect_set("best.status").alias("statuses"))
    size = synonyms.groupBy("tag_group", "tag", "entity_group").agg(F.countDistinct("entity_index").alias("size"))
    found = found.join(open_.select("_row", "tag_group"), "_row").join(size, ["tag_group", "tag", "entity_group"]).where("found = size")
    status = F.coalesce(*(F.when(F.array_contains("statuses", s), s) for s in STATUS_ORDER))
    best = found.groupBy("_row").agg(F.min_by(F.struct("tag", "score", "words", status.alias("status")), F.struct((-F.round("score", 12)).alias("s"), "tag", "entity_group")).alias("b"))
    out = texts.join(best, "_row", "left")
    fixed = F.col("trace.userStatus").eqNullSafe("fixed")
    hit = F.col("b").isNotNull()
    tag = F.when(fixed, F.col("tag")).when(hit, F.col("b.tag"))
    seen = with_status(with_changed(F.when(hit, F.col("trace").withField("score", F.col("b.score"))).otherwise(F.col("trace")), ~F.col("b.tag").eqNullSafe(F.col("tag")), iteration), F.when(~hit, "pending").when(F.col("b.status") == "ok", "validated").otherwise("matched"), iteration)
    return out.select(*(c for c in texts.columns if c not in ("_row", "tag", "entities", "trace")), F.when(fixed | ~hit, F.col("entities")).otherwise(F.col("b.words")).alias("entities"), F.when(fixed, F.col("trace")).otherwise(seen).alias("trace"), tag.alias("tag")).select(*(c for c in texts.columns if c != "_row"))


def tag_competition(scored: DataFrame, most: int) -> DataFrame:
    """(tag_group, tag, token, score) of the tokens that each tag keeps against all other tags of its group, the best `most` of them.

    scored (tag_group, tag, token, score, vector): scores are TF-IDF; the best 10 * most of a tag take part, in parts of their sum. A
    tag loses a token where another tag of the group has it with the same strength or more: score times the cosine of the token's
    vector with the sum of the tag's others, or score alone where a vector is missing. Tags meet by token, not in pairs:
    the strongest other tag decides.
    """
    from larkspur.plans.session import written

    own = Window.partitionBy("tag_group", "tag")
    rows = scored.withColumn("_rn", F.row_number().over(own.orderBy(F.desc("score"), "token"))).where(F.col("_rn") <= 10 * most).drop("_rn")
    rows = written(rows.withColumn("score", F.col("score") / F.sum("score").over(own)))
    cells = rows.where("vector is not null").select("tag_group", "tag", F.posexplode("vector").alias("i", "x")).groupBy("tag_group", "tag", "i").agg(F.sum("x").alias("x"))
    sums = cells.groupBy("tag_group", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("_sum"))
    rows = rows.join(sums, ["tag_group", "tag"], "left").withColumn("_strong", F.col("score") * V.cosine("vector", V.minus("_sum", "vector")))
    meet = Window.partitionBy("tag_group", "token")
    # of the others the strongest, with and without vectors: the two greatest tell that of every tag
    second = lambda c: F.slice(F.reverse(F.array_sort(F.collect_list(c).over(meet))), 1, 2)
    seen = rows.withColumns({"_a": second("_strong"), "_b": second("score"), "_n": F.count("*").over(meet), "_bare": F.sum(F.col("vector").isNull().cast("int")).over(meet)})
    other = lambda c, mine: F.when(F.get(c, F.lit(0)) == F.col(mine), F.get(c, F.lit(1))).otherwise(F.get(c, F.lit(0)))
    plain = F.col("_strong").isNull() | (F.col("_bare") > 0)
    lost = F.when(plain, other("_b", "score") >= F.col("score")).otherwise(other("_a", "_strong") >= F.col("_strong"))
    kept = seen.where((F.col("_n") == 1) | ~F.coalesce(lost, F.lit(False))).withColumn("score", F.coalesce("_strong", "score"))
    return kept.withColumn("_rn", F.row_number().over(own.orderBy(F.desc("score"), "token"))).where(F.col("_rn") <= most).select("tag_group", "tag", "token", "score")


def refine_by_cooccurrence(texts: DataFrame, entities: DataFrame, most: int = 10, min_count: int = 2) -> DataFrame:
    """(tag, token, coo, score) of the tokens that are most typical of the texts in which a tag's tokens occur.

    texts (id, tokens), entities (tag, token). Score is co-occurrences times their lift, coo / texts of the tag over texts of
    the token / texts; the `most` best of each tag are new to it.
    """
    words = texts.select("id", F.explode(F.array_distinct("tokens")).alias("token"))
    total = texts.agg(F.count("*").alias("n"))
    tagged = words.join(entities.select("tag", "token").distinct(), "token").select("tag", "id").distinct()
    ne = tagged.groupBy("tag").agg(F.count("*").alias("ne"))
    c = words.groupBy("token").agg(F.count("*").alias("c"))
    coo = tagged.join(words, "id").join(entities.select("tag", "token").distinct(), ["tag", "token"], "left_anti").groupBy("tag", "token").agg(F.count("*").alias("coo")).where(F.col("coo") >= min_count)
    scored = coo.join(ne, "tag").join(c, "token").join(F.broadcast(total)).withColumn("score", F.col("coo") * (F.col("coo") / F.col("ne")) / (F.col("c") / F.col("n")))  # one row
    return scored.withColumn("_rn", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc(F.round("score", 9)), "token"))).where(F.col("_rn") <= most).select("tag", "token", "coo", "score")
