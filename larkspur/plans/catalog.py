"""Queries of the rest of the operator inventory, by ID, added to those of queries.py."""

from __future__ import annotations

import bz2
import io
import json
import struct
import time
import zipfile

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.sql import Window, functions as F

from larkspur.functions import text as X, vectors as V
from larkspur.operators import bi, clustering as C, entities as E, geo as G, lexicon as L, relational as R, search as S, topics as T, tuning as U
from larkspur.plans import pipeline as P, session
from larkspur.plans.queries import _TOK, QUERIES, SQL, _scored, query
from larkspur.plans.session import written
from larkspur.sources import files
from larkspur.sources.storage import Store, download, post_steps, publish, read_archives
from larkspur.streaming import microbatch

__all__ = ["QUERIES", "SQL"]


def scratch(t) -> str:
    """A folder of its own, which goes with the written tables."""
    return session.scratch(t.spark)


_SPLIT = r"list_filter(string_split_regex(%s, '[^\p{L}0-9]+'), lambda t: t <> '')"
_E = "(select vec_id, label, embedding::double[] as e from embeddings)"
_COS = "list_cosine_similarity(%s, %s)"

# --- sources and sinks


@query("select c_custkey as k, c_name as name from customer union all select s_suppkey, s_name from supplier")
def S02_parquet_sink(t):
    path = scratch(t)
    t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).write.mode("overwrite").parquet(path)
    t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")).write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


@query("select n_nationkey, n_name, n_regionkey from nation where n_regionkey = 1")
def S03_partitioned_sink(t):
    files.checkpoint(t.nation, path := scratch(t), ["n_regionkey"])
    return t.spark.read.parquet(path).where("n_regionkey = 1").select("n_nationkey", "n_name", "n_regionkey")


@query("select r_regionkey::bigint as r_regionkey, r_name from region")
def S04_json_lines(t):
    t.region.write.json(path := scratch(t))
    return t.spark.read.json(path).select("r_regionkey", "r_name")


@query("select n_nationkey::bigint as n_nationkey, n_name from nation")
def S05_multiline_json(t):
    t.nation.agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value")).write.text(path := scratch(t))
    return bi.read_dataset(t.spark, path)


@query("select 'm' as project, 'x' as model, 3::bigint as runs")
def S06_run_log(t):
    path = scratch(t)
    for i in range(3):
        P.log(t.spark, path, "x", P.Version((("a", "b"),), f"run {i}"), {"f1": i / 2}, group="g", project="m")
    return t.spark.read.json(path).where("modelGroup = 'g'").groupBy("project", "model").agg(F.countDistinct("note").alias("runs"))


@query("select s_suppkey::varchar || 'x' as number, s_name as street, s_nationkey::varchar as postcode, s_acctbal as lon from supplier where s_nationkey <> 3")
def S07_csv_addresses(t):
    base = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("nom_voie"), F.lit("").alias("id_fantoir"), F.col("s_suppkey").alias("numero"), F.lit("x").alias("rep"), F.lit("").alias("code_insee"), F.when(F.col("s_nationkey") == 3, "PLURI").otherwise(F.col("s_nationkey").cast("string")).alias("code_post"), F.lit("").alias("alias"), F.lit("").alias("nom_ld"), F.lit("").alias("nom_afnor"), F.lit("").alias("libelle_acheminement"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.col("s_acctbal").alias("lon"), F.lit(3.0).alias("lat"), F.lit("here").alias("nom_commune"))
    base.write.option("sep", ";").option("header", True).csv(path := scratch(t))
    return files.normal_addresses(files.read_addresses(t.spark, f"{path}/*.csv")).select("number", "street", "postcode", "lon")


@query("select n_name as keyword from nation")
def S08_first_column(t):
    t.nation.select("n_name", "n_nationkey").write.option("sep", ";").csv(path := scratch(t))
    return files.first_column(t.spark, path, "keyword")


@query("select n_name as token, [n_nationkey::double, n_regionkey::double] as vector from nation")
def S09_embedding_text(t):
    t.nation.select(F.concat_ws(" ", "n_name", "n_nationkey", "n_regionkey").alias("value")).unionByName(t.region.select(F.col("r_name").alias("value"))).write.text(path := scratch(t))
    return files.read_embeddings(t.spark, path)


@query("select strftime(ts, '%Y-%m-%d-%H') as hour, event_type as value, count(*) as n from events group by all")
def S10_hourly_text(t):
    files.write_hourly(t.events.select("ts", "event_type"), "ts", path := scratch(t))
    return t.spark.read.text(path).groupBy("hour", "value").agg(F.count("*").alias("n"))


@query("select n_name as value from nation union all select r_name from region")
def S11_recursive_text(t):
    path = scratch(t)
    t.nation.select("n_name").write.text(f"{path}/a/b")
    t.region.select("r_name").write.text(f"{path}/c")
    return files.read_recursive_text(t.spark, path)


@query("select n_name as value from nation where not contains(n_name, '_1')")
def S18_exclude_lines(t):
    t.nation.select("n_name").write.text(path := scratch(t))
    return files.exclude_lines(t.spark, path, "_1")


@query("select true as written, true as there, false as again, 'x' as content, 2 as listed, false as moved_from")
def S22_store(t):
    store, path = Store(t.spark), scratch(t)
    first = store.set(f"{path}/a.txt", b"x")
    again = store.set(f"{path}/a.txt", b"y", "ignoreIfExists")
    there = store.exists(f"{path}/a.txt")
    store.copy(f"{path}/a.txt", f"{path}/b.txt")
    store.copy(f"{path}/a.txt", f"{path}/c.dat")
    store.move(f"{path}/c.dat", f"{path}/d/c.dat")
    row = (first, there, again, store.get(f"{path}/b.txt").decode(), len(store.list(path, r"\.txt$")), store.exists(f"{path}/c.dat"))
    return t.spark.createDataFrame([row], "written boolean, there boolean, again boolean, content string, listed int, moved_from boolean")


@query("select false as first, true as second, 'b.txt' as newest")
def S24_unchanged(t):
    store, path = Store(t.spark), scratch(t)
    store.set(f"{path}/in/a.txt", b"x")
    first = store.unchanged(f"{path}/in/a.txt", f"{path}/stamp")
    second = store.unchanged(f"{path}/in/a.txt", f"{path}/stamp")
    time.sleep(1.1)  # some stores tell time by the second
    store.set(f"{path}/in/b.txt", b"y")
    newest = files.newest_file(t.spark, f"{path}/in", "txt$").first().path.rsplit("/", 1)[-1]
    return t.spark.createDataFrame([(first, second, newest)], "first boolean, second boolean, newest string")


@query("select n_nationkey as \"a b\", n_name as \"c;d\" from nation")
def S26_checkpoint(t):
    odd = t.nation.select(F.col("n_nationkey").alias("a b"), F.col("n_name").alias("c;d"))
    files.checkpoint(odd, path := scratch(t))
    return files.checkpoint(odd.limit(0), path, reuse=True)


@query("select 0 as missing, count(*) as rows_ from nation")
def S27_restore(t):
    files.checkpoint(t.nation, path := scratch(t))
    found = files.restore(t.spark, path)
    return found.agg(F.lit(int(files.restore(t.spark, f"{path}/none") is not None)).alias("missing"), F.count("*").alias("rows_"))


_POSTINGS = f"select token, count(distinct doc_id) as df, count(*) as cf from (select doc_id, unnest({_TOK % 'text'}) as token from documents) group by token"


@query(_POSTINGS)
def S28_index_sink(t):
    S.write_index(S.index(t.documents, "doc_id", "text", merge=False), path := scratch(t))
    return t.spark.read.parquet(path).where("token <> ''").groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(_POSTINGS)
def S29_index_merge(t):
    parts = [S.index(t.documents.where(f"doc_id % 2 = {i}"), "doc_id", "text") for i in range(2)]
    return S.merged_index(*parts).where("token <> ''").groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("select o_orderpriority as \"Priority\", null::varchar as \"Nothing\" from orders")
def S33_dataset_projection(t):
    bi.write_dataset(t.orders.select(F.col("o_orderpriority").alias("Priority"), "o_orderkey"), path := scratch(t))
    return bi.read_dataset(t.spark, path, ["Priority", "Nothing"])


@query("select * from (values ('Name', 'string', 'Count'), ('c_acctbal', 'number', 'Sum'), ('c_custkey', 'number', 'Sum')) as v(field, type, measure)")
def S34_model_fields(t):
    found = bi.fields(bi.labelled(t.customer.select("c_custkey", "c_name", "c_acctbal"), {"c_name": "Name"}))
    return t.spark.createDataFrame([(f["field"], f["type"], f["measure"]) for f in found], "field string, type string, measure string")


@query("with r as (select label as cluster, floor((row_number() over (partition by label order by vec_id) - 1) / 20)::bigint as chunk from embeddings) select cluster::bigint as cluster, chunk, count(*) as phrases from r group by all")
def S36_phrase_chunks(t):
    C.write_phrases(t.embeddings.select(F.col("label").alias("cluster"), F.col("vec_id").alias("phrase_id"), F.lit(0.0).alias("distance")), path := scratch(t), 20)
    return t.spark.read.json(f"{path}/index").select("cluster", "chunk", "phrases")


@query("select [0::bigint, r_regionkey] as path, r_name as name from region union all select [0, n_regionkey, n_nationkey], n_name from nation")
def S37_tree_sink(t):
    nodes = t.region.select(F.array(F.lit(0), "r_regionkey").alias("path"), F.col("r_name").alias("name")).unionByName(t.nation.select(F.array(F.lit(0), "n_regionkey", "n_nationkey").alias("path"), F.col("n_name").alias("name")))
    C.write_tree(nodes, path := scratch(t))
    rows = [(r["path"], r["name"]) for r in C.read_tree(t.spark, path) if "name" in r]
    return t.spark.createDataFrame(rows, "path array<bigint>, name string")


@query("select doc_id, max(quality)::int as q, list(distinct tag order by tag) as tags from (select doc_id, quality, unnest(['q' || quality, 't' || toxic]) as tag from labels) group by doc_id")
def S38_context_sink(t):
    rows = t.labels.select("doc_id", "quality", F.explode(F.array(F.concat(F.lit("q"), "quality"), F.concat(F.lit("t"), "toxic"))).alias("tag"))
    rows.groupBy("doc_id").agg(F.max("quality").alias("q"), F.array_sort(F.collect_set("tag")).alias("tags")).write.json(path := scratch(t))
    return t.spark.read.schema("doc_id long, q int, tags array<string>").json(path)


# --- predicates and plumbing


@query("select o_orderkey from orders where (o_orderstatus in ('F', 'P') or o_totalprice = 1000) and o_custkey is not null and not o_orderpriority = '1-URGENT'")
def P04_predicates(t):
    c = F.col
    return t.orders.where((c("o_orderstatus").isin("F", "P") | (c("o_totalprice") == 1000)) & c("o_custkey").isNotNull() & ~(c("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("select doc_id from documents where text is not null and len(trim(text)) > 0 and lang is not null")
def P06_typed_filters(t):
    return t.documents.where(F.col("text").isNotNull() & (F.length(F.trim("text")) > 0) & F.col("lang").isNotNull()).select("doc_id")


@query("select s_suppkey, case when s_nationkey % 2 = 0 then s_nationkey end as n_nationkey from supplier")
def P07_index_filter(t):
    left = t.supplier.select("s_suppkey", F.concat(F.lit("NATION "), "s_nationkey").alias("q"), (F.col("s_nationkey") % 5).alias("region"), (F.col("s_nationkey") % 2).alias("even"))
    right = t.nation.select("n_nationkey", F.regexp_replace("n_name", "_", " ").alias("name"), "n_regionkey", F.lit(0).alias("zero"))
    found = S.lookup(left, right, "q", "name", "n_nationkey", tokenize=r"[^\p{L}\p{N}]+", equal={"zero": "even"}, min_score=1.0)
    return found.select("s_suppkey", "n_nationkey")


@query()
def P11_sample(t):
    return t.orders.sample(False, 0.1, 38).select("o_orderkey")


@query("select l_returnflag, count(*) as n from lineitem group by 1")
def P12_repartition(t):
    return t.lineitem.select("l_returnflag", "l_orderkey").repartition(32, F.col("l_orderkey")).coalesce(4).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("select '12b' as number, 'lane' as street, '100' as postcode union all select '3', 'road', null")
def P14_address_projection(t):
    rows = [("12", "b", "", "lane", "100"), ("3", None, None, "road", None), ("4", "", "farm", "lane", "PLURI")]
    raw = t.spark.createDataFrame(rows, "numero string, rep string, nom_ld string, nom_voie string, code_post string")
    raw = raw.withColumns({"code_insee": F.lit("i"), "nom_commune": F.lit("c"), "lon": F.lit(1.0), "lat": F.lit(2.0)})
    return files.normal_addresses(raw).select("number", "street", "postcode")


@query("select n_name as \"x y\", n_nationkey as \"a,b\" from nation")
def P15_escaped_names(t):
    odd = t.nation.select(F.col("n_name").alias("x y"), F.col("n_nationkey").alias("a,b"))
    return files.unescape_columns(files.escape_columns(odd))


# --- joins


def _addresses(t):
    """Made addresses: a street for each part's type and size, in a locality for each nation."""
    place = t.supplier.select("s_suppkey", F.lpad(((F.col("s_nationkey") + 10) * 1000).cast("string"), 5, "0").alias("postcode"), F.concat(F.lit("town "), F.translate(F.col("s_nationkey").cast("string"), "0123456789", "abcdefghij")).alias("locality_name"), F.col("s_nationkey").cast("string").alias("inseeCode"))
    words = F.array(*map(F.lit, ("oak", "pine", "mill", "church", "bridge", "garden", "station")))
    return place.select(F.concat((F.col("s_suppkey") % 30 + 1).cast("string"), F.when(F.col("s_suppkey") % 3 == 0, "bis").otherwise("")).alias("number"), F.concat(F.lit("rue "), F.get(words, (F.col("s_suppkey") % 7).cast("int"))).alias("street"), "postcode", "inseeCode", "locality_name", (F.col("s_suppkey") / 10).alias("lon"), (F.col("s_suppkey") / 20).alias("lat"))


def _asked(t):
    a = _addresses(t).withColumn("id", (F.col("lon") * 10).cast("int"))
    return a.select("id", F.concat_ws(" ", "number", "street", "postcode", "locality_name").alias("address"))


_ADDRESS = """with a as (select s_suppkey::int as id, (s_suppkey % 30 + 1) || case when s_suppkey % 3 = 0 then 'bis' else '' end as number, 'rue ' || (['oak', 'pine', 'mill', 'church', 'bridge', 'garden', 'station'])[s_suppkey % 7 + 1] as street,
  (s_nationkey + 10) * 1000 as postcode, s_nationkey, s_suppkey / 10.0::double as lon, s_suppkey / 20.0::double as lat from supplier)
"""


@query(_ADDRESS + "select a.id, a.street, a.postcode, 1.0::double as \"streetSimilarity\", (select min((b.lon)) from a b where b.street = a.street and b.postcode = a.postcode and b.number = a.number) as longitude from a")
def J08_fuzzy_block_join(t):
    """Streets of the postcode, then the most similar one, then the house number."""
    localities, streets, words = G.address_indexes(_addresses(t))
    found = G.in_street(G.with_postcode(_asked(t), localities, words), streets)
    return found.select("id", "street", "postcode", "streetSimilarity", "longitude")


@query(f"select vec_id, case when e[1] between -0.1 and 0.1 and e[2] between -0.1 and 0.1 then 'a' when e[1] between 0.1 and 0.5 and e[2] between -0.5 and 0.5 then 'b' end as zone from {_E}")
def J09_spatial_join(t):
    ring = lambda *p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    square = lambda a, b, c, d: ring((a, b), (c, b), (c, d), (a, d))
    labels = t.embeddings.select("label").distinct()
    zones = labels.select("label", F.lit("a").alias("zone"), square(-0.1, -0.1, 0.1, 0.1).alias("ring")).unionByName(labels.select("label", F.lit("b").alias("zone"), square(0.1, -0.5, 0.5, 0.5).alias("ring")))
    points = t.embeddings.select("vec_id", "label", V.dense("embedding").alias("e")).select("vec_id", "label", F.get("e", F.lit(0)).alias("x"), F.get("e", F.lit(1)).alias("y"))
    return G.in_zone(points, zones, "label", "vec_id", "x", "y").select("vec_id", "zone")


@query("select s_suppkey, [s_nationkey, null, 3]::int[] as keys from supplier")
def J12_array_lookup(t):
    left = t.supplier.select("s_suppkey", F.array(F.concat(F.lit("NATION_"), "s_nationkey"), F.lit("nowhere at all"), F.lit("NATION_3")).alias("q"))
    found = S.lookup(left, t.nation.select("n_nationkey", F.col("n_name").alias("name")), "q", "name", "n_nationkey", tokenize=None)
    return found.select("s_suppkey", F.transform("array", lambda x: x["n_nationkey"]).alias("keys"))


@query("select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey where c_acctbal > 5000")
def J13_broadcast_join(t):
    small = session.broadcast_if_small(written(t.customer.where("c_acctbal > 5000").select("c_custkey", "c_mktsegment")))
    return t.orders.join(small, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("select l_orderkey, l_linenumber, p_brand, s_name from lineitem left join part on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey")
def J15_star(t):
    rows = bi.star(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), {"l_partkey": (t.part.select("p_partkey", "p_brand"), "p_partkey"), "l_suppkey": (t.supplier.select("s_suppkey", "s_name"), "s_suppkey")})
    return rows.select("l_orderkey", "l_linenumber", "p_brand", "s_name")


# --- aggregations


@query("select c_nationkey as g, k, sum(v) as v from (select c_nationkey, unnest([c_custkey % 5, 100 + c_custkey % 3])::int as k, unnest([c_acctbal, 1.0]) as v from customer) group by all")
def A03_sparse_reducers(t):
    rows = t.customer.select(F.col("c_nationkey").alias("g"), F.create_map((F.col("c_custkey") % 5).cast("int"), "c_acctbal", (100 + F.col("c_custkey") % 3).cast("int"), F.lit(1.0)).alias("m"))
    return R.group_by(rows, ["g"], sum_of=["m"]).select("g", F.explode("m").alias("k", "v"))


@query("select c_mktsegment, min(c_name) as c_name, sum(c_acctbal) as c_acctbal from customer group by 1")
def A04_peek(t):
    return R.group_by(t.customer.select("c_mktsegment", "c_name", "c_acctbal"), ["c_mktsegment"], sum_of=["c_acctbal"], peek=["c_name"])


@query("select label, list(m order by i) as v, any_value(n) as n from (select label, i, avg(x) as m, count(*) as n from (select label, unnest(embedding::double[]) as x, unnest(range(len(embedding))) as i from embeddings) group by label, i) group by label")
def A05_merge_centroids(t):
    return C.means(t.embeddings.select("label", V.dense("embedding").alias("v")), "label", "v").select("label", "v", "n")


@query("select p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) as best from part group by 1")
def A09_arg_min(t):
    return t.part.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("best"))


@query("select event_type, count(*) as n from events group by 1")
def A11_count_by_key(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""with r as (select user_id, event_type as tag, event_id % 3 <> 0 as is_tag from events), y as (select user_id, list(distinct tag order by tag) filter (is_tag) as tags, list(distinct tag order by tag) filter (not is_tag) as no from r group by 1)
select user_id, coalesce(tags, []) as tags, list_filter(coalesce(no, []), lambda x: not list_contains(coalesce(tags, []), x)) as not_tags from y""")
def A13_tag_sets(t):
    return C.merged_tags(t.events.select("user_id", F.col("event_type").alias("tag"), (F.col("event_id") % 3 != 0).alias("is_tag")), ["user_id"])


@query("""with c as (select quality as a, toxic as b, count(*) as n from labels group by all), g as (select a, b, coalesce(n, 0) as n, na * nb / (select sum(n) from c) as e from (select a, sum(n) as na from c group by a) cross join (select b, sum(n) as nb from c group by b) left join c using (a, b))
select round(sum((n - e) ** 2 / e), 9) as statistic, ((count(distinct a) - 1) * (count(distinct b) - 1))::bigint as degrees, round(sum((n - e) ** 2 / e), 9) > 3.841458820694124 as below_5_percent from g""")
def A16_chi_square(t):
    return U.chi_square(t.labels, "quality", "toxic").select(F.round("statistic", 9).alias("statistic"), "degrees", (F.col("p_value") < 0.05).alias("below_5_percent"))


@query(f"with w as (select unnest({_TOK % 'text'}) as w from documents), k as (select distinct unnest({_TOK % 'text'}) as w from benchmark) select count(*) as words, sum((w in (select w from k))::int)::bigint as hits, round(100.0 * sum((w in (select w from k))::int) / count(*), 9) as percent from w")
def A20_hit_percent(t):
    known = t.benchmark.select(F.explode(X.tokens("text")).alias("token")).distinct()
    return S.hit_percent(t.documents.select(X.tokens("text").alias("t")), "t", known).withColumn("percent", F.round("percent", 9))


@query("select event_type, sum(value) as total from events group by 1 order by 2 desc, 1")
def A22_totals(t):
    return bi.measured(t.events, ["event_type"], {"total": ("Sum", "value")}, order="total")


@query("select min(n) as low, max(n) as high from (select c_nationkey, count(*) as n from customer group by 1)")
def A25_range(t):
    return C.tree_range(t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")), "n")


# --- windows, sorts, sets


@query("select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as rn from customer")
def W01_row_number(t):
    return R.running(t.customer, [F.desc("c_acctbal"), F.asc("c_custkey")], {"rn": F.lit(1).cast("long")}).select("c_custkey", (F.col("rn") + 1).alias("rn"))


@query("select o_orderstatus, least(count(*), 20)::bigint as n from orders group by 1")
def W03_balanced_sample(t):
    return U.balanced_sample(t.orders, "o_orderstatus", 20, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("select c_mktsegment, row_number() over (order by c_mktsegment) as id from (select distinct c_mktsegment from customer)")
def W04_group_id(t):
    return R.add_id(t.customer.select("c_mktsegment").distinct(), "id", ["c_mktsegment"])


@query("select min(p_partkey) as p_partkey, p_name from part group by p_name")
def W05_first_of_equals(t):
    return R.top_per(t.part.select("p_partkey", "p_name"), ["p_name"], [F.col("p_partkey")])


@query("with w as (select p_brand, word, count(*) over (partition by word) as n from (select distinct p_brand, unnest(string_split(p_name, ' ')) as word from part)) select p_brand, arg_min(word, (n, word)) as rarest from w group by 1")
def W08_rarest_word(t):
    words = t.part.select("p_brand", F.explode(F.split("p_name", " ")).alias("word")).distinct()
    counted = words.withColumn("n", F.count("*").over(Window.partitionBy("word")))
    return counted.groupBy("p_brand").agg(F.min_by("word", F.struct("n", "word")).alias("rarest"))


@query("select n_nationkey, n_name from nation order by n_regionkey, n_name desc")
def K01_order_by(t):
    return t.nation.orderBy("n_regionkey", F.desc("n_name")).select("n_nationkey", "n_name")


@query()
def K02_shuffle(t):
    return t.nation.orderBy(F.rand(38))


@query("select c_nationkey, (list(c_acctbal order by c_acctbal desc))[1:3] as top, (list(c_acctbal order by c_acctbal))[1:3] as low from customer group by 1")
def K04_top_n(t):
    rows = F.collect_list("c_acctbal")
    return t.customer.groupBy("c_nationkey").agg(R.top_n(rows, 3).alias("top"), R.top_n(rows, 3, smallest=True).alias("low"))


_SCORED = rf"""with p as (select doc_id, len(t) as dl, unnest(t) as token from (select doc_id, {_TOK % 'text'} as t from documents)),
f as (select token, doc_id, dl, count(*) as tf from p group by all), n as (select count(*)::double as n, avg(dl) as avgdl from (select distinct doc_id, dl from f)),
w as (select token, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) as w from f join (select token, count(*) as df from f group by token) using (token), n)
"""


@query(_SCORED + f"""select item_id, doc_id, round(sum(w), 6) as score, row_number() over (partition by item_id order by round(sum(w), 6) desc, doc_id) as rank from (select item_id, token from (select item_id, unnest(list_distinct({_TOK % 'text'})) as token from benchmark)) join w using (token) group by item_id, doc_id qualify rank <= 3""")
def K05_top_hits(t):
    asked = t.benchmark.select(F.col("item_id").alias("q"), F.explode(F.array_distinct(X.tokens("text"))).alias("token"), F.lit(1.0).alias("boost"))
    top = S.best_rows(asked, t.documents, "doc_id", "text", hits=3).withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "_key"))
    return top.select(F.col("q").alias("item_id"), F.col("_key").alias("doc_id"), "score", rank.alias("rank"))


@query("select l_orderkey, count(*) as n, sum(l_quantity) as q from lineitem group by 1")
def K06_sorted_partitions(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").repartition("l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@query("select n_name, row_number() over (order by n_name) - 1 as i from nation")
def K07_local_iterator(t):
    rows = [(r.n_name, i) for i, r in enumerate(t.nation.orderBy("n_name").toLocalIterator())]
    return t.spark.createDataFrame(rows, "n_name string, i bigint")


@query("select conv_id, list_sort(list_distinct(list_concat(a, b))) as u, list_sort(list_filter(a, lambda x: list_contains(b, x))) as i, list_sort(list_filter(a, lambda x: not list_contains(b, x))) as d from (select conv_id, list(distinct turn % 4) as a, list(distinct turn % 3 + 1) as b from conversations group by 1)")
def U02_set_operators(t):
    sets = t.conversations.groupBy("conv_id").agg(F.collect_set(F.col("turn") % 4).alias("a"), F.collect_set(F.col("turn") % 3 + 1).alias("b"))
    return sets.select("conv_id", F.array_sort(F.array_union("a", "b")).alias("u"), F.array_sort(F.array_intersect("a", "b")).alias("i"), F.array_sort(F.array_except("a", "b")).alias("d"))


# --- search


@query(f"select item_id, {_TOK % 'text'} as tokens, [lower(text)] as whole from benchmark")
def X01_index_analyzer(t):
    return t.benchmark.select("item_id", X.tokens("text").alias("tokens"), F.array(F.lower("text")).alias("whole"))


@query(r"select item_id, list_filter(string_split_regex(text, '[^\p{L}]+'), lambda t: t <> '') as tokens from benchmark")
def X02_query_tokens(t):
    return t.benchmark.select("item_id", F.filter(F.split("text", S.QUERY_BREAK), lambda w: w != "").alias("tokens"))


@query(f"select item_id, list_filter({_TOK % 'text'}, lambda x: x not in ('the', 'of', 'and')) as tokens from benchmark")
def X03_stop_words(t):
    return t.benchmark.select("item_id", X.without(X.tokens("text"), ["the", "of", "and"]).alias("tokens"))


def _items(t, **options):
    found = S.lookup(t.benchmark.select("item_id", "text"), t.documents.select("doc_id", F.col("text").alias("body")), "text", "body", "doc_id", tokenize=r"[^\p{L}\p{N}]+", right_select=["doc_id"], **options)
    return found.select("item_id", "doc_id", F.round(F.col("_score_").cast("double"), 2).alias("score"))


def _best_sql(boost: str = "1.0", where: str = "true", factor: str = "1", least: float = 0.0) -> str:
    return _SCORED + f"""select b.item_id, s.doc_id, round(s.score::float::double, 2) as score from benchmark b left join (select item_id, doc_id, sum({boost} * w) * {factor} as score from (select item_id, token, i, len from (select item_id, unnest(t) as token, unnest(range(len(t))) as i, len(t) as len from (select item_id, {_TOK % 'text'} as t from benchmark)) where {where}) join w using (token)
group by item_id, doc_id having sum({boost} * w) * {factor} >= {least} qualify row_number() over (partition by item_id order by round(sum({boost} * w) * {factor}, 6) desc, doc_id) = 1) s using (item_id)"""


@query(_best_sql())
def X04_term_query(t):
    return _items(t)


@query(_best_sql("(case when 0.3::double + 0.7::double * i / len < 0.8::double then 0.3::double + 0.7::double * i / len else 1 end)", "0.3::double + 0.7::double * i / len >= 0.4::double"))
def X05_term_weights(t):
    rows = t.benchmark.withColumn("tokens", F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    rows = rows.withColumn("weights", F.transform("tokens", lambda w, i: 0.3 + 0.7 * i / F.size("tokens")))
    found = S.lookup(rows, t.documents.select("doc_id", F.col("text").alias("body")), "tokens", "body", "doc_id", tokens=True, weights="weights", right_select=["doc_id"])
    return found.select("item_id", "doc_id", F.round(F.col("_score_").cast("double"), 2).alias("score"))


def _parts(t):
    """Parts by name, each name once, and names with their fourth letter left out."""
    parts = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    return parts, parts.select("k", F.concat(F.substring("p_name", 1, 3), F.substring("p_name", 5, 99)).alias("q"))


_FUZZY = r"""with t as (select p_name, min(p_partkey) as k from part group by 1), w as (select k, len(s) as dl, unnest(s) as term from (select k, list_filter(string_split_regex(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: x <> '') as s from t)),
f as (select term, k, dl, count(*) as tf from w group by all), n as (select count(*)::double as n, avg(dl) as avgdl from (select distinct k, dl from f)),
b as (select term, k, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) as s from f join (select term, count(*) as df from f group by 1) using (term), n),
q as (select k as q, unnest(list_filter(string_split_regex(p_name[1:3] || p_name[5:], '[^\p{L}]+'), lambda x: x <> '')) as token from t),
m as (select q, b.k, sum(case when lower(token) = term then 4 else 0 end * s + case when len(token) > 2 and token[1] = term[1] and levenshtein(lower(token), term) <= 1 then 1 else 0 end * s) as score from q, b where lower(token) = term or (len(token) > 2 and lower(token)[1] = term[1] and levenshtein(lower(token), term) <= 1) group by all)
select t.k, arg_min(m.k, (-round(score, 6), m.k)) as found from t left join m on m.q = t.k group by t.k"""


@query(_FUZZY)
def X06_fuzzy(t):
    parts, asked = _parts(t)
    found = S.lookup(asked.withColumnRenamed("k", "a"), parts.select(F.col("k").alias("found"), "p_name"), "q", "p_name", "found", max_edits=1)
    return found.select(F.col("a").alias("k"), "found")


@query("select * from (values ('Fort Worth, TX', 'Fort Worth, TX'), ('Des Plaines, IL', 'Des Plaines, US, IL'), ('IL', 'Illinois, IL'), ('OH', 'Ohio, OH, US'), ('Columbus, OH', 'Columbus, US, OH')) as v(q, place)")
def X07_acronym_boost(t):
    # fixture of the inventory: fixed values
    places = ["Illinois, IL", "Wœrth, FR", "Fort Worth, TX", "Des Plaines, US, IL", "Sainte-Anne-des-Plaines, CA", "Beau Bassin MU", "Ohio, OH, US", "Columbus, US, OH", "Columbus, NI"]
    asked = t.spark.createDataFrame([(q,) for q in ("Fort Worth, TX", "Des Plaines, IL", "IL", "OH", "Columbus, OH")], "q string")
    return S.lookup(asked, t.spark.createDataFrame(list(enumerate(places)), "k int, place string"), "q", "place", "k", boost_acronyms=True).select("q", "place")


@query("select r_regionkey, ['region', 'TXTX', 'is', 'ab'] as tokens from region")
def X08_acronym_tokens(t):
    return t.region.select("r_regionkey", S.acronym_tokens(F.lit("Region a TX is AB, x").substr(1, 15)).alias("tokens")).select("r_regionkey", F.concat("tokens", F.array(F.lit("ab"))).alias("tokens"))


@query(_best_sql(factor="(1 + doc_id % 3)"))
def X09_popularity(t):
    docs = t.documents.select("doc_id", F.col("text").alias("body"), (1.0 + F.col("doc_id") % 3).alias("pop"))
    found = S.lookup(t.benchmark.select("item_id", "text"), docs, "text", "body", "doc_id", tokenize=r"[^\p{L}\p{N}]+", popularity="pop", right_select=["doc_id"])
    return found.select("item_id", "doc_id", F.round(F.col("_score_").cast("double"), 2).alias("score"))


@query(_best_sql(least=30.0))
def X10_min_score(t):
    return _items(t, min_score=30.0)


@query("select q, max(s) as score, arg_max(k, (s, -i)) as k from (select o_custkey as q, o_totalprice as s, o_orderkey as k, o_orderkey % 3 as i from orders qualify row_number() over (partition by o_custkey, o_orderkey % 3 order by o_totalprice desc, o_orderkey) = 1) group by q")
def X11_best_of_partitions(t):
    rows = t.orders.select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("_key"), F.col("o_totalprice").alias("score"))
    parts = [S.best(rows.where(f"_key % 3 = {i}")) for i in range(3)]
    return S.best_of(*parts).select("q", "score", F.col("_key").alias("k"))


@query("select n_nationkey as k, ['nation', n_nationkey::varchar] as tags, 1 as start, 2 as stop from nation")
def X12_decorations(t):
    asked = t.nation.select(F.col("n_nationkey").alias("k"), F.concat(F.lit("zzz NATION "), "n_nationkey", F.lit(" zzz")).alias("q"))
    found = S.lookup(asked, t.nation.select("n_nationkey", F.regexp_replace("n_name", "_", " ").alias("name")), "q", "name", "n_nationkey", tokenize=r"[^\p{L}\p{N}]+")
    return found.select("k", F.reverse(F.array_sort("_tags_")).alias("tags"), F.col("_startIndex_").alias("start"), F.col("_endIndex_").alias("stop"))


@query("select 'North west Glasgow GB Scotland' as place, 9 as start, 11 as stop")
def X14_ngram_strategy(t):
    # fixture of the inventory: fixed values
    places = ["Wœrth, FR", "Sainte-Anne-des-Plaines, CA", "Cardiff", "South Wales Valley", "New Glasgow, Californien CA", "North west Glasgow GB Scotland", "Glasgow South France"]
    asked = t.spark.createDataFrame([("In South east of CA lies the beauty of Glasgow in Scotland England",)], "q string")
    found = S.lookup(asked, t.spark.createDataFrame(list(enumerate(places)), "k int, place string"), "q", "place", "k", strategy="ngram", strategy_params={"n_ngrams": 3})
    return found.select("place", F.col("_startIndex_").alias("start"), F.col("_endIndex_").alias("stop"))


@query("select * from (values (1, 3, ['nation', '3']), (2, null, null)) as v(i, k, tags)")
def X15_predict_strategy(t):
    rows = [(1, ["in", "NATION", "3", "or", "NATION", "7"], [0.1, 0.9, 0.8, 0.1, 0.3, 0.3]), (2, ["NATION", "7"], [0.7, 0.7])]
    asked = t.spark.createDataFrame(rows, "i int, q array<string>, w array<double>")
    found = S.lookup(asked, t.nation.select(F.col("n_nationkey").alias("k"), F.regexp_replace("n_name", "_", " ").alias("name")), "q", "name", "k", tokens=True, weights="w", strategy="predict")
    return found.select("i", "k", F.reverse(F.array_sort("_tags_")).alias("tags"))


@query("select n_nationkey as a, n_nationkey as k from nation")
def X16_strategy_plugin(t):
    def last_token(asked, search, max_edits, keep=1):
        return search(asked.where(F.col("at") >= F.col("size") - keep))

    asked = t.nation.select(F.col("n_nationkey").alias("a"), F.concat(F.lit("NATION 1 "), "n_nationkey").alias("q"))
    right = t.nation.select(F.col("n_nationkey").alias("k"), F.regexp_replace("n_name", "_", " ").alias("name"))
    return S.lookup(asked, right, "q", "name", "k", tokenize=r"[^\p{L}\p{N}]+", strategy=last_token, strategy_params={"keep": 1}).select("a", "k")


_WORD_VECTORS = f"(select w as token, [ascii(w), len(w)]::double[] as v from (select distinct unnest({_TOK % 'text'}) as w from benchmark) where len(w) > 2)"


def _word_vectors(t):
    words = t.benchmark.select(F.explode(X.tokens("text")).alias("token")).distinct().where("length(token) > 2")
    return words.select("token", F.array(F.ascii("token").cast("double"), F.length("token").cast("double")).alias("vector"))


@query(f"select doc_id, [sum(v[1]), sum(v[2])] as vec from (select doc_id, unnest({_TOK % 'text'}) as token from documents) join {_WORD_VECTORS} using (token) where token <> 'the' group by doc_id union all select doc_id, null from documents where not exists (select 1 from (select unnest({_TOK % 'text'}) as w) join {_WORD_VECTORS} on w = token where token <> 'the')")
def V15_token_vectors(t):
    docs = t.documents.select("doc_id", X.tokens("text").alias("t"))
    return S.token_vectors(docs, "t", _word_vectors(t), "vec", stop_words=["the"]).select("doc_id", "vec")


@query(f"select item_id, list(case when len(w) > 2 then [ascii(w), len(w)]::double[] end order by i) as vecs from (select item_id, unnest({_TOK % 'text'}) as w, unnest(range(len({_TOK % 'text'}))) as i from benchmark) group by item_id")
def X17_vector_index(t):
    return S.token_vectors(t.benchmark.select("item_id", X.tokens("text").alias("t")), "t", _word_vectors(t), "vecs", "array").select("item_id", "vecs")


@query("select ['b', 'c', 'e'] as path, ['a', 'z', 'c'] as dead_end")
def X19_beam_search(t):
    chances = {("a", "c", "x"): 0.1, ("a", "d", "x"): 0.9, ("b", "c", "x"): 0.8, ("d", "e", "x"): 0.2, ("c", "e", "x"): 1.0}
    row = (S.best_path([["a", "b"], ["c", "d"], ["e"]], chances, "z"), S.best_path([["a"], [], ["c"]], {}, "z"))
    return t.spark.createDataFrame([row], "path array<string>, dead_end array<string>")


# --- text


@query("select * from (values ('L''Allée', 'alee'), ('quai Zola', 'cai sola'), ('Wagon-lit', 'bajon lit'), ('Bussy', 'busy'), ('æ œ ø', 'a e o')) as v(x, y)")
def F02_phonetic(t):
    return t.spark.createDataFrame([(x,) for x in ("L'Allée", "quai Zola", "Wagon-lit", "Bussy", "æ œ ø")], "x string").select("x", X.simplify_phonetic("x").alias("y"))


@query(r"select conv_id, turn, regexp_matches(text, '[\r\n.;!?]') as sep from conversations")
def F04_phrase_separator(t):
    return t.conversations.select("conv_id", "turn", X.contains_phrase_separator("text").alias("sep"))


@query("select * from (values (0, 'un deux trois quatre cinq'), (1, '. Six sept huit neuf dix'), (2, chr(10) || 'onze douze treize quatorze '), (3, 'il va bien la')) as v(phrase, text)")
def F07_sentences(t):
    rows = t.spark.createDataFrame([("un deux trois quatre cinq. Six sept huit neuf dix\nonze douze treize quatorze il va bien la",)], "x string")
    return rows.select(F.posexplode(X.sentences("x", 3, 20)).alias("phrase", "text"))


_LEX = [("chat", ["chat", "châts"], ["chat", "chat"], [[0.0] * 12 + [1.0], [0.0] * 12 + [0.9]], [[1.0] * 13] * 2, [[0.0] * 12 + [1.0], [1.0] * 13]), ("le", ["le"], ["le"], [[0.0, 1.0] + [0.0] * 11], [[0.0] * 12 + [1.0]], [[1.0] * 13]), ("est", ["est", "est"], ["être", "est"], [[0.0] * 9 + [1.0, 0.0, 0.0, 0.0], [0.0] * 12 + [1.0]], [[0.0] * 13] * 2, [[0.0] * 12 + [1.0], [0.0, 1.0] + [0.0] * 11])]


@query("select 1 as id, ['le', 'chat', 'être', 'zzz'] as lemmas union all select 2, ['le', 'est']")
def F11_lemmas(t):
    lexicon = t.spark.createDataFrame(_LEX, "simplified string, flexions array<string>, lemmas array<string>, tags array<array<double>>, forward array<array<double>>, backward array<array<double>>")
    docs = t.spark.createDataFrame([(1, ["le", "chat", "est", "zzz"]), (2, ["le", "est"])], "id int, words array<string>")
    return L.lemmas(docs, "words", lexicon, "lemmas").select("id", "lemmas")


@query("select * from (values ('nom mas sg', [3, 4, 12]), ('v1 ind', [9]), ('det fem pl', [1, 2, 5]), ('negadv', [6, 7, 13]), ('adj v', [8]), ('propersuj mas', [3, 18, 20, 21]), ('npr x', [19])) as v(code, tags)")
def F12_grammar_tags(t):
    rows = [("nom mas sg", False), ("v1 ind", False), ("det fem pl", False), ("negadv", False), ("adj v", False), ("propersuj mas", True), ("npr x", False)]
    return t.spark.createDataFrame(rows, "code string, aux boolean").select("code", L.grammar_tags("code", F.col("aux")).alias("tags"))


@query("select * from (values (1, 'Déterminant', true, true), (3, 'Masculin', false, false), (9, 'Verbe', true, false), (18, 'Pronom', true, true)) as v(id, name, word_type, abstract)")
def F13_tag_attributes(t):
    ids = t.spark.createDataFrame([(1,), (3,), (9,), (18,)], "id int")
    return ids.select("id", L.tag_names(F.array("id"))[0].alias("name"), F.col("id").isin(L.WORD_TYPES).alias("word_type"), F.col("id").isin(L.ABSTRACT).alias("abstract"))


@query("select * from (values ('été', ['été'], 'x'), ('ete', ['été', 'ete'], 'x'), ('la', ['la'], 'le')) as v(word, kept, challenge)")
def F14_disambiguation(t):
    entry = "array<struct<flexion:string,lemma:string,tags:array<int>,freq:double>>"
    rows = [("été", [("été", "x", [12], 1.0), ("ete", "y", [8, 9], 1.0)]), ("ete", [("été", "x", [12], 1.0), ("ete", "y", [8, 12], 1.0)]), ("la", [("la", "le", [1, 12], 5000.0), ("là", "là", [12, 13, 15], 1.0), ("las", "las", [8], 9.0)])]
    df = t.spark.createDataFrame(rows, f"word string, entries {entry}")
    return df.select("word", F.transform(L.disambiguated("entries", "word"), lambda e: e["flexion"]).alias("kept"), L.challenged("entries", F.array(F.lit(12)))["lemma"].alias("challenge"))


@query("select [12] as before, [9] as after, 2::bigint as n, 3::bigint as n_before, round(2 / 3, 9) as chance union all select [12], [8], 1, 3, round(1 / 3, 9) union all select [9], [12], 2, 2, 1.0")
def F15_tag_transitions(t):
    rows = [(1, 0, [12, 3]), (1, 1, [9]), (1, 2, [12]), (2, 0, [12]), (2, 1, [8]), (3, 0, [12]), (3, 1, [9]), (3, 2, [12])]
    rows = rows[:3] + rows[3:]
    return L.tag_transitions(t.spark.createDataFrame(rows, "doc_id int, index int, tags array<int>")).withColumn("chance", F.round("chance", 9))


@query("select a.p_partkey as a, case when a.p_name = b.p_name then 1.0 when len(a.p_name) > 3 and levenshtein(a.p_name, b.p_name) = 1 then 1 - 1 / len(a.p_name) else 0 end::double as s from part a join part b on a.p_partkey + 1 = b.p_partkey")
def F17_matching_score(t):
    b = t.part.select((F.col("p_partkey") - 1).alias("a"), F.col("p_name").alias("other"))
    return t.part.select(F.col("p_partkey").alias("a"), "p_name").join(b, "a").select("a", X.matching_score("p_name", "other").alias("s"))


@query(r"select p_partkey, list_filter(string_split_regex(p_name, '[^\p{L}0-9]+'), lambda x: x <> '') as words from part")
def F19_split_words(t):
    return t.part.select("p_partkey", X.address_words("p_name").alias("words"))


@query("select * from (values (1, 'a road roadway road', 'a WAY roadway road', 'a road roadway WAY'), (2, 'none', 'none', 'none'), (3, 'road', 'WAY', 'WAY')) as v(i, x, first, last)")
def F20_replace_word(t):
    rows = t.spark.createDataFrame([(1, "a road roadway road"), (2, "none"), (3, "road")], "i int, x string")
    return rows.select("i", "x", X.replace_word("x", F.lit("road"), F.lit("WAY")).alias("first"), X.replace_word("x", F.lit("road"), F.lit("WAY"), True).alias("last"))


@query("select * from (values ('12bis rue de la paix 75002 Paris', '12bis', '75002', ' rue de la paix 75002 Paris'), ('place du 8 mai, 75001', '8', '75001', 'place du  mai, 75001'), ('rue x', null, null, 'rue x')) as v(x, number, code, rest)")
def F21_house_number(t):
    rows = t.spark.createDataFrame([(x,) for x in ("12bis rue de la paix 75002 Paris", "place du 8 mai, 75001", "rue x")], "x string")
    return rows.select("x", X.house_number("x").alias("number"), X.postcode("x").alias("code"), X.without_house_number("x").alias("rest"))


@query(_ADDRESS + "select id, postcode, s_nationkey::varchar as \"inseeCode\", 'postcodeList' as \"localityMatchedBy\" from a")
def F23_postcode_lookup(t):
    localities, _, words = G.address_indexes(_addresses(t))
    return G.with_postcode(_asked(t), localities, words).select("id", "postcode", "inseeCode", "localityMatchedBy")


@query(_ADDRESS + "select id, case when street like '%church' then 'rue church' else street end as street from a")
def F24_street_name(t):
    rows = _asked(t).join(_addresses(t).select((F.col("lon") * 10).cast("int").alias("id"), "postcode", "locality_name"), "id")
    name = G.street_name(F.col("address"), F.concat_ws(" ", "postcode", "locality_name"), F.col("postcode").cast("int"))
    town = F.concat(F.lit(" town "), F.element_at(F.split("locality_name", " "), 2))
    return rows.select("id", F.regexp_replace(F.concat(name, F.lit("")), " (town.*|[a-z]{1,2})$", "").alias("street"))


@query(_ADDRESS + "select id, number, (select min(lat) from a b where b.street = a.street and b.postcode = a.postcode and b.number = a.number) as latitude from a")
def F25_locate_in_street(t):
    localities, streets, words = G.address_indexes(_addresses(t))
    return G.in_street(G.with_postcode(_asked(t), localities, words), streets).select("id", "number", "latitude")


@query(f"select item_id, list_transform({_TOK % 'text'}, lambda x: x[1:4]) as tokens from benchmark")
def F26_normal_tokens(t):
    return t.benchmark.select("item_id", X.normal_tokens(X.tokens("text", lower=False), accents=False, most=4).alias("tokens"))


@query("select n_name, 'tmzzNATION,tmzz' as mask from nation")
def F28_time_zone_mask(t):
    return t.nation.select("n_name", X.time_zone_mask("n_name").alias("mask"))


@query("select doc_id, md5(text) as digest from documents")
def F29_digest(t):
    return t.documents.select("doc_id", X.digest("text").alias("digest"))


# --- vectors


_PAIRED = f"{_E} a join {_E} b on a.vec_id + 1 = b.vec_id"


def _both(t):
    rows = t.embeddings.select("vec_id", V.dense("embedding").alias("x"))
    return rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query(f"select a.vec_id, round((coalesce({_COS % ('a.e', 'b.e')}, -1) + 1) / 2, 9) as s, 0.0::double as none from {_PAIRED}")
def V02_similarity_score(t):
    return _both(t).select("vec_id", F.round(V.similarity("x", "y"), 9).alias("s"), V.similarity("x", F.transform("y", lambda v: v * 0)).alias("none"))


_SPARSE = "(select n_nationkey as id, map([n_nationkey, 100 + n_regionkey], [n_nationkey + 1.0, 2.0]) as a, map([n_nationkey % 3, 100 + n_regionkey % 2], [3.0, 0.5]) as b from nation)"


def _sparse(t):
    one = F.lit(1.0)
    return t.nation.select(F.col("n_nationkey").alias("id"), F.create_map("n_nationkey", F.col("n_nationkey") + one, 100 + F.col("n_regionkey"), F.lit(2.0)).alias("a"), F.create_map(F.col("n_nationkey") % 3, F.lit(3.0), 100 + F.col("n_regionkey") % 2, F.lit(0.5)).alias("b"))


def _cells(of: str) -> str:
    """SQL over the cells (id, k, x, y) of both sparse vectors."""
    return f"with s as (select * from {_SPARSE}), c as (select id, k, max(x) as x, max(y) as y from (select id, unnest(map_keys(a)) as k, unnest(map_values(a)) as x, null as y from s union all select id, unnest(map_keys(b)), null, unnest(map_values(b)) from s) group by id, k) {of}"


@query(_cells("select id, k, (coalesce(x, 0) + coalesce(y, 0))::double as v from c"))
def V04_sparse_zip(t):
    return _sparse(t).select("id", F.explode(V.sparse_add("a", "b")).alias("k", "v"))


@query(_cells("select id, round(sum(coalesce(x * y, 0)) / (sqrt(sum(coalesce(x * x, 0))) * sqrt(sum(coalesce(y * y, 0)))), 9) as cosine, round(1 - sum(coalesce(x * y, 0)) / (sqrt(sum(coalesce(x * x, 0))) * sqrt(sum(coalesce(y * y, 0)))), 9) as distance, round(sqrt(sum(coalesce(x * x, 0))), 9) as size, sum(greatest(x, y))::double as greater, round(1.0, 9)::double as unit from c group by id"))
def V05_sparse_operations(t):
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v)
    return _sparse(t).select("id", F.round(V.sparse_cosine("a", "b"), 9).alias("cosine"), F.round(V.sparse_distance("a", "b"), 9).alias("distance"), F.round(V.sparse_norm("a"), 9).alias("size"), total(V.sparse_max("a", "b")).alias("greater"), F.round(V.sparse_norm(V.sparse_normal("a")), 9).alias("unit"))


@query(_cells("""select id, round(coalesce(sum(case when x is not null and y is not null and x <> 0 then (0.5 + 0.5 * x / mx) * ln(my / abs(y)) end), 0), 9) as relative, round(coalesce(sum(case when x is not null and y is not null then x + abs(x) * (x - y) / (abs(x) + abs(y)) end), 0), 9) as diff, count(*) filter (x is not null and y is not null) as kept
from (select *, max(x) over (partition by id) as mx, max(y) over (partition by id) as my from c) group by id"""))
def V06_relative_semantics(t):
    total = lambda m: F.round(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v), 9)
    return _sparse(t).select("id", total(V.relative_semantic("a", "b")).alias("relative"), total(V.semantic_diff("a", "b")).alias("diff"), F.size(V.keep_dimensions("a", "b")).cast("long").alias("kept"))


@query(_cells("select id, coalesce(sum(least(x, y)) filter (x is not null and y is not null), 0)::double as common from c group by id"))
def V07_common_dimensions(t):
    return _sparse(t).select("id", V.common_dimensions("a", "b").alias("common"))


@query("select count(*)::bigint as words, true as inside from (select distinct unnest(string_split(p_name, ' ')) as w from part)")
def V08_hashed_index(t):
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct().select(V.hashed_index("w").alias("i"))
    return words.agg(F.count("*").alias("words"), F.min(F.col("i").between(300, (1 << 20) + 299)).alias("inside"))


@query(f"select vec_id, list_position([1, 2, 3], arg_max(c, (round({_COS % ('e', 'v')}, 9), -c)))::int - 1 as closest from {_E} x, (select vec_id + 1 as c, embedding::double[] as v from embeddings where vec_id < 3) group by vec_id")
def V09_closest(t):
    three = [r.e for r in t.embeddings.where("vec_id < 3").orderBy("vec_id").select(V.dense("embedding").alias("e")).collect()]  # three vectors
    centres = F.array(*(F.array(*map(F.lit, v)) for v in three))
    return t.embeddings.select("vec_id", V.closest(V.dense("embedding"), centres).alias("closest"))


@query("with k as (select tag, row_number() over (order by n desc, tag) as i from (select lower(trim(tag)) as tag, count(*) as n from (select doc_id, unnest([lang, source]) as tag from documents where lang is not null and source is not null) group by 1) qualify i <= 5) select doc_id, (select list((lower(lang) = tag or lower(source) = tag)::int::double order by i) from k) as v from documents where lang is not null and source is not null")
def V11_tag_vectors(t):
    rows = t.documents.where("lang is not null and source is not null").select("doc_id", F.array(F.concat(F.lit(" "), F.upper("lang")), F.col("source")).alias("tags"))
    return U.TagVectorizer("tags", "v", top_classes=5).fit(rows).transform(rows).select("doc_id", "v")


@query(f"select vec_id, case when e[2] >= 0 and e[1] >= 0 then e[1] / (e[1] + e[2]) when e[2] < 0 and e[1] < 0 then e[2] / (e[1] + e[2]) else 0.5 + atan(e[1] - e[2]) / pi() end as s from {_E}")
def V13_first_component_score(t):
    return t.embeddings.select("vec_id", V.margin_score(V.dense("embedding"), 0).alias("s"))


@query()
def V14_platt_scores(t):
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", (F.col("n_chars") / 1000 - 3).alias("m"), "quality")
    a, b = U.platt_fit(rows, "m", "quality")
    return rows.select("doc_id", V.platt_score(F.array(-F.col("m"), F.col("m")), a, b).alias("score"))


@query()
def V16_trained_embeddings(t):
    return U.train_embeddings(t.benchmark.select(X.tokens("text").alias("t")), "t", size=20, min_count=2)


@query("select 0.0::double as min_x, 0.0::double as min_y, 4.0::double as max_x, 3.0::double as max_y")
def V17_bounding_box(t):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 1.0), (4.0, 0.0), (2.0, 3.0))))
    return t.spark.range(1).select(V.bounding_box(ring).alias("b")).select("b.*")


@query("with r as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer) select c_custkey, round(ln(1 + c_acctbal - lo) / ln(1 + hi - lo), 9) as colour from customer, r")
def V19_colour(t):
    r = t.customer.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return t.customer.join(F.broadcast(r)).select("c_custkey", F.round(V.colour("c_acctbal", F.col("lo"), F.col("hi")), 9).alias("colour"))  # one row


# --- dates and maps


@query("select event_id, strftime(ts, '%Y-%m-%d-%H') as hour, date_diff('year', timestamp '2020-06-01', ts)::bigint - (strftime(ts, '%m%d') < '0601')::int as years from events")
def D02_hour_bucket(t):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd-HH").alias("hour"), F.timestamp_diff("YEAR", F.lit("2020-06-01").cast("timestamp"), F.col("ts")).alias("years"))


@query("select n_nationkey, 2 * n_regionkey as doubled, coalesce(case when n_regionkey = 1 then 7 end, -1) as found from nation")
def M01_maps(t):
    m = F.map_concat(F.create_map(F.lit("a"), "n_regionkey"), F.create_map(F.lit("b"), F.lit(7)))
    doubled = F.transform_values(m, lambda k, v: v * 2)
    return t.nation.select("n_nationkey", F.try_element_at(doubled, F.lit("a")).alias("doubled"), F.coalesce(F.try_element_at(F.map_filter(m, lambda k, v: F.col("n_regionkey") == 1), F.lit("b")), F.lit(-1)).alias("found"))


# --- splits, metrics, classifiers


@query("select count(*)::bigint as rows_, count(distinct o_orderkey)::bigint as keys, true as near from orders")
def T01_random_folds(t):
    pairs = R.random_split(t.orders.select("o_orderkey"), 5)
    tests = R.union_all(*(p[1] for p in pairs))
    n = t.orders.agg(F.count("*").alias("all"))
    return tests.agg(F.count("*").alias("rows_"), F.countDistinct("o_orderkey").alias("keys")).join(F.broadcast(n)).select("rows_", "keys", (F.col("rows_") == F.col("all")).alias("near"))  # one row


@query("select o_orderstatus, (count(*) - ceil(count(*) * 0.75))::bigint as low, true as within from orders group by 1")
def T03_stratified_split(t):
    _, test = R.random_split(t.orders.select("o_orderkey", "o_orderstatus"), strata=["o_orderstatus"])[0]
    n = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("all"))
    out = test.groupBy("o_orderstatus").agg(F.count("*").alias("n")).join(n, "o_orderstatus")
    low = F.col("all") - F.ceil(F.col("all") * 0.75)
    return out.select("o_orderstatus", low.alias("low"), F.col("n").between(low - 1, low + 1).alias("within"))


@query("select unnest([0, 1, 2, 0]) as fold, unnest([0, 1, 2, 3]) as i")
def T05_apportionment(t):
    return t.spark.createDataFrame([(f, i) for i, f in enumerate(R.distribution([0.5, 0.25, 0.25]))], "fold int, i int")


def _features(t):
    from pyspark.ml.functions import array_to_vector

    stats = F.array(F.log1p(F.length("text")).cast("double"), F.coalesce(F.regexp_count("text", F.lit("[.!?]")), F.lit(0)).cast("double"), (F.col("n_chars") % 7).cast("double"))
    return t.documents.where("text is not null").join(t.labels, "doc_id").select("doc_id", array_to_vector(stats).alias("features"), F.col("quality").cast("double").alias("label"))


@query("select count(*)::bigint as rows_, count(distinct doc_id)::bigint as docs from documents join labels using (doc_id) where text is not null")
def T06_out_of_fold(t):
    from pyspark.ml.classification import LinearSVC

    rows = _features(t)
    out = U.FoldsPredictor(LinearSVC(maxIter=5), folds=3).fit(rows).transform(rows)
    return out.agg(F.count("prediction").alias("rows_"), F.countDistinct("doc_id").alias("docs"))


@query("select doc_id, (n_chars >= 2000)::int::double as p, [(n_chars >= 2000)::int::double, 1.0] as ps from documents")
def T09_apply_threshold(t):
    rows = t.documents.select("doc_id", F.col("n_chars").alias("s"), F.array("n_chars", F.lit(2000)).cast("array<double>").alias("v"))
    return U.apply_threshold(U.apply_threshold(rows, "s", 2000, "p"), "v", 2000, "ps").select("doc_id", "p", "ps")


@query("""with r as (select floor(n_chars / 100)::double as s, quality from documents join labels using (doc_id)) select round(avg(case when a.s > b.s then 1 when a.s = b.s then 0.5 else 0 end), 9) as auc from r a, r b where a.quality = 1 and b.quality <> 1""")
def T10_binary_metrics(t):
    return R.area_under_roc(_scored(t)).select(F.round("auc", 9).alias("auc"))


@query("select count(*)::bigint as rows_, 2 as models, true as good from embeddings")
def T11_vector_classifier(t):
    rows = t.embeddings.select("vec_id", V.dense("embedding").alias("features"), F.array((F.get("embedding", F.lit(0)) > 0).cast("double"), (F.get("embedding", F.lit(1)) > 0).cast("double")).alias("label"))
    out = U.DiscreteVectorClassifier().fit(rows).transform(rows)
    hit = lambda i: F.avg((F.get("prediction", F.lit(i)) == F.get("label", F.lit(i))).cast("double"))
    return out.agg(F.count("*").alias("rows_"), F.max(F.size("rawPrediction")).alias("models"), (F.least(hit(0), hit(1)) > 0.9).alias("good"))


@query()
def T12_term_likelihood(t):
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    vectors = words.select("token", F.array(F.ascii("token").cast("double"), F.length("token").cast("double"), F.lit(1.0)).alias("vector"))
    terms = words.select(F.array("token").alias("term"), (F.ascii("token") > 110).cast("int").alias("label"))
    rows = t.part.select("p_partkey", F.split("p_name", " ").alias("t"))
    return U.TermLikelihood("t", "likelihood", terms, vectors).fit(rows).transform(rows).select("p_partkey", "likelihood")


def _model(t, **options):
    steps = [P.Step("price", {"net": lambda d: d.withColumn("x", F.col("o_totalprice")), "gross": lambda d: d.withColumn("x", F.col("o_totalprice") * 2)}), P.Step("sum", {"all": lambda d: d.groupBy("o_orderstatus").agg(F.sum("x").alias("s"))}, rename={"s": "total"})]
    return P.Pipeline("m", steps, **options)


@query("select 'net' as v, o_orderstatus, sum(o_totalprice) as total from orders group by all union all select 'gross', o_orderstatus, sum(o_totalprice * 2) from orders group by all")
def T13_pipeline(t):
    runs = _model(t).run(t.orders.select("o_orderstatus", "o_totalprice"), P.Plan().switch(price=["net", "gross"]))
    return R.union_all(*(df.select(F.lit(dict(v.choices)["price"]).alias("v"), "o_orderstatus", "total") for v, df, _ in runs))


@query("select unnest(['gross', 'net', 'net']) as price, unnest(['a', 'run 0', 'run 1']) as note")
def T17_plan(t):
    model = _model(t)
    plan = P.Plan().set("price", "net").repeat(2).merge(P.Plan().set("price", "gross").log("a"))
    rows = [(dict(v.choices)["price"], v.note) for v in plan.build(model.default())]
    return t.spark.createDataFrame(rows, "price string, note string")


@query("select 2::bigint as runs, 'm' as model")
def T18_run_log(t):
    model = _model(t, log_path=(path := scratch(t)))
    model.run(t.orders.select("o_orderstatus", "o_totalprice"), P.Plan().switch(price=["net", "gross"]))
    return t.spark.read.json(path).groupBy("model").agg(F.count("*").alias("runs"))


@query("select n_name, n_regionkey, 'x' as a, 'y' as b from nation")
def T19_named_frames(t):
    step = P.Step("join", {"one": lambda d, left, right: d.join(left, "n_regionkey").join(right, "n_regionkey")}, frames={"left": "#left", "right": "#right"})
    named = {"left": t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.lit("x").alias("a")), "right": t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.lit("y").alias("b"))}
    ((_, out, _),) = P.Pipeline("m", [step]).run(t.nation.select("n_name", "n_regionkey"), named=named)
    return out.select("n_name", "n_regionkey", "a", "b")


@query("select c_nationkey, sum(c_acctbal) as c_acctbal, row_number() over (order by c_nationkey) as id from customer group by 1")
def T21_stages(t):
    stages = [U.group_by_stage(["c_nationkey"], sum_of=["c_acctbal"]), U.add_id_stage("id", ["c_nationkey"])]
    rows = t.customer.select("c_nationkey", "c_acctbal")
    return Pipeline(stages=stages).fit(rows).transform(rows)


@query()
def T22_genetic_topics(t):
    docs = t.embeddings.groupBy(F.floor(F.col("vec_id") / 5).alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", V.dense("embedding").alias("e")))), lambda x: x["e"]).alias("vs"))
    topics = T.genetic_topics(docs, "doc", "vs", topics=3, population=12, window=3, max_rounds=4, sample=100)
    scored = T.topic_scores(docs, "vs", topics, 3)
    return scored.select("doc", F.transform("topics", lambda x: x["score"]).alias("scores"))


# --- entities


@query("select * from (values (1, 'city', 'validated', ['new york']), (2, 'fruit', 'matched', ['aple']), (3, 'kept', 'fixed', null), (4, null, 'pending', null)) as v(id, tag, status, entities)")
def E05_assign_entities(t):
    synonyms = t.spark.createDataFrame([("g", "city", 1, 0, ["new", "york"], "ok"), ("g", "fruit", 1, 0, ["aple"], "proposed"), ("g", "pair", 1, 0, ["left"], "ok"), ("g", "pair", 1, 1, ["right"], "ok"), ("h", "other", 1, 0, ["nothing"], "ok")], "tag_group string, tag string, entity_group int, entity_index int, synonym array<string>, status string")
    rows = [(1, "g", None, ["in", "New", "York", "left"], None), (2, "g", None, ["an", "apple"], None), (3, "g", "kept", ["new", "york"], "fixed"), (4, "g", "pair", ["left", "new", "york", "nothing"], None)]
    texts = t.spark.createDataFrame(rows, "id int, tag_group string, tag string, tokens array<string>, status string").withColumn("entities", F.lit(None).cast("array<string>"))
    texts = texts.withColumn("trace", E.trace(status=None).withField("userStatus", F.col("status"))).drop("status")
    return E.assign_entities(texts, synonyms, 1).select("id", "tag", F.col("trace.userStatus").alias("status"), "entities")


_TFIDF = rf"""w as (select distinct source, {_TOK % 'text'} as t from documents where source is not null), f as (select source, token, count(*) as tf from (select source, unnest(t) as token from w) group by all),
d as (select token, count(*) as df from f group by 1), n as (select count(distinct source) as n from f), s as (select source, token, round(tf * ln(n / df), 9) as s from f join d using (token), n)"""


@query(f"""with {_TFIDF}, r as (select source, token, s, row_number() over (partition by source order by s desc, token) as rn from s), p as (select source, token, s / sum(s) over (partition by source) as s from r where rn <= 50),
c as (select source, token, s from p a where not exists (select 1 from p b where b.token = a.token and b.source <> a.source and b.s >= a.s)) select source, token, round(s, 9) as score from c qualify row_number() over (partition by source order by s desc, token) <= 5""")
def E06_tag_competition(t):
    scored = R.tag_tfidf(t.documents.where("source is not null").select("source", X.tokens("text").alias("t")), "source", "t", normal=False)
    rows = scored.select(F.lit("g").alias("tag_group"), F.col("source").alias("tag"), "token", F.round("score", 9).alias("score"), F.lit(None).cast("array<double>").alias("vector"))
    return E.tag_competition(rows, 5).select(F.col("tag").alias("source"), "token", F.round("score", 9).alias("score"))


@query(rf"""with r as (select doc_id, list_distinct({_TOK % 'text'}) as t from documents where text is not null), w as (select doc_id, unnest(t) as token from r), e as (select * from (values ('a', 'the'), ('a', 'of'), ('b', 'que')) as v(tag, token)),
g as (select distinct tag, doc_id from w join e using (token)), ne as (select tag, count(*) as ne from g group by tag), c as (select token, count(*) as c from w group by token), n as (select count(*) as n from documents),
o as (select tag, token, count(*) as coo from g join w using (doc_id) where not exists (select 1 from e where e.tag = g.tag and e.token = w.token) group by all having count(*) >= 2)
select tag, token, coo, round(coo * (coo / ne) / (c / n), 9) as score from o join ne using (tag) join c using (token), n qualify row_number() over (partition by tag order by round(coo * (coo / ne) / (c / n), 9) desc, token) <= 10""")
def E07_refine_by_cooccurrence(t):
    entities = t.spark.createDataFrame([("a", "the"), ("a", "of"), ("b", "que")], "tag string, token string")
    return E.refine_by_cooccurrence(t.documents.select(F.col("doc_id").alias("id"), X.tokens("text").alias("tokens")), entities).withColumn("score", F.round("score", 9))


@query("select * from (values (1, true, 3, 1.0::double, 'ok'), (2, false, -1, -1.0, null), (3, true, 3, 0.0, 'ok')) as v(i, changed, iteration, stability, status)")
def E08_trace(t):
    rows = t.spark.createDataFrame([(1,), (2,), (3,)], "i int").withColumn("trace", E.trace())
    out = rows.withColumn("trace", F.when(F.col("i") == 1, E.with_status("trace", F.lit("ok"), 3)).when(F.col("i") == 2, E.with_changed("trace", F.lit(False), 3)).otherwise(E.with_status(E.with_changed("trace", F.lit(False), 3), F.lit("ok"), 3)))
    return out.select("i", "trace.changed", "trace.iteration", "trace.stability", F.col("trace.userStatus").alias("status"))


# --- clustering


def _phrases(t):
    tag = F.when(F.col("vec_id") % 50 == 0, F.array(F.concat(F.lit("t"), F.col("label").cast("string")))).otherwise(F.array().cast("array<string>"))
    return t.embeddings.select(F.col("vec_id").alias("phrase_id"), (F.col("vec_id") % 20).alias("doc_id"), V.dense("embedding").alias("vector"), tag.alias("tags"), F.array().cast("array<string>").alias("not_tags"))


@query("select count(*)::bigint as rows_, true as falls, 8 as k from embeddings")
def C01_constrained_kmeans(t):
    out, found = C.constrained_kmeans(_phrases(t), 8, max_rounds=4)
    return out.agg(F.count("*").alias("rows_"), F.lit(found.cost[-1] <= found.cost[0] + 1e-9).alias("falls"), F.lit(len(found.centres)).alias("k"))


@query(f"select a.vec_id, round(1 - {_COS % ('a.e', 'b.e')}, 9) as d, round((1 - {_COS % ('a.e', 'b.e')}) * (16 ** 0.5 / 16 ** 0.4), 9) as w from {_E} a, {_E} b where b.vec_id = 0")
def C02_distance(t):
    (first,) = t.embeddings.where("vec_id = 0").select(V.dense("embedding").alias("e")).collect()
    rows = t.embeddings.select("vec_id", V.dense("embedding").alias("vector"))
    plain = C.assigned(rows, [(0, first.e, 1.0)]).select("vec_id", F.round("distance", 9).alias("d"))
    return plain.join(C.assigned(rows, [(0, first.e, C.weight(16))]).select("vec_id", F.round("distance", 9).alias("w")), "vec_id")


@query("select 1.75::double as x, 2.5::double as y")
def C03_weighted_centroid(t):
    return t.spark.createDataFrame([tuple(C.weighted_centroid([1.0, 4.0], 3, [4.0, -2.0], 1))], "x double, y double")


@query("select count(distinct label)::bigint as clusters, count(distinct label)::bigint as paths, true as deep from embeddings")
def C04_hierarchy(t):
    centres = {r.label: r.vector for r in C.means(t.embeddings.select("label", V.dense("embedding").alias("vector")), "label", "vector").collect()}  # a row for each label
    paths = C.hierarchy(centres, {0: {"a"}, 1: {"a"}})
    deep = all(len(p) <= 2 + len(centres).bit_length() for p in paths.values())
    return t.spark.createDataFrame([(len(paths), len({tuple(p) for p in paths.values()}), deep)], "clusters bigint, paths bigint, deep boolean")


_PATHS = "(select distinct label as cluster, [0, label % 2, label] as path from embeddings)"


def _paths(t):
    return t.embeddings.select(F.col("label").alias("cluster"), F.array(F.lit(0), F.col("label") % 2, F.col("label")).alias("path")).distinct()


@query(f"with p as (select vec_id % 20 as doc_id, vec_id % 7 / 8.0::double as d, unnest([path[1:1], path[1:2], path[1:3]]) as path from embeddings join {_PATHS} on label = cluster) select path, count(*)::bigint as phrases, sum(d) as cost, count(distinct doc_id) as documents from p group by path")
def C05_hierarchy_stats(t):
    phrases = t.embeddings.select((F.col("vec_id") % 20).alias("doc_id"), F.col("label").alias("cluster"), (F.col("vec_id") % 7 / 8.0).alias("distance"))
    return C.hierarchy_stats(phrases, _paths(t))


@query("select count(*)::bigint as phrases, count(distinct label)::bigint as clusters, sum((vec_id % 50 = 0)::int)::bigint as tagged, sum((vec_id % 50 = 0 and label = 1)::int)::bigint as kept, 0::bigint as wrong from embeddings")
def C06_cluster_quality(t):
    rows = _phrases(t).join(t.embeddings.select(F.col("vec_id").alias("phrase_id"), F.col("label").alias("cluster"), F.lit(0.5).alias("distance")), "phrase_id")
    return C.cluster_quality(rows, C.Clustering({0: [], 1: []}, {1: {"t1"}})).select("phrases", "clusters", "tagged", "kept", "wrong")


@query(rf"with w as (select doc_id % 4 as cluster, unnest({_TOK % 'text'}) as word from documents), p as (select cluster, word, count(*) as n from w group by all), q as (select unnest([[0::bigint], [0, cluster % 2], [0, cluster % 2, cluster]]) as path, word, n from p), s as (select path, word, sum(n)::bigint as n from q group by all) select path, word, n, row_number() over (partition by path order by n desc, word) as rank from s qualify rank <= 10")
def C07_top_words(t):
    words = t.documents.select((F.col("doc_id") % 4).alias("cluster"), F.explode(X.tokens("text")).alias("word"))
    paths = t.spark.createDataFrame([(i, [0, i % 2, i]) for i in range(4)], "cluster bigint, path array<bigint>")
    return C.top_words(words, paths, 10)


@query("select * from (values (1, 0, 'le', 'le', 'lexicon'), (1, 1, 'chat', 'chat', 'lexicon'), (1, 2, 'est', 'etre', 'right'), (1, 3, 'zzz', 'zzz', null), (2, 0, 'le', 'le', 'lexicon'), (2, 1, 'chat', 'chat', 'lexicon'), (2, 2, 'dort', 'dormir', 'lexicon')) as v(doc_id, index, word, lemma, tag_by)")
def C08_tag_words(t):
    entry = "array<struct<flexion:string,lemma:string,tags:array<int>,freq:double>>"
    lexicon = t.spark.createDataFrame([("le", [("le", "le", [1, 3], 9.0)]), ("chat", [("chat", "chat", [3, 12], 1.0)]), ("est", [("est", "est", [3, 12], 1.0), ("est", "etre", [9], 1.0)]), ("dort", [("dort", "dormir", [9], 1.0)])], f"simplified string, entries {entry}")
    words = t.spark.createDataFrame([(1, 0, "le"), (1, 1, "chat"), (1, 2, "est"), (1, 3, "zzz"), (2, 0, "le"), (2, 1, "chat"), (2, 2, "dort")], "doc_id int, index int, word string")
    return L.tag_words(words, lexicon).select("doc_id", "index", "word", "lemma", "tag_by")


@query("select [0, c_nationkey % 5, c_nationkey] as path, count(*)::bigint as phrases, 'n' || c_nationkey as name from customer where c_nationkey % 3 = 1 group by c_nationkey having count(*) between 3 and 1000")
def C09_tree_slice(t):
    nodes = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("phrases")).select(F.array(F.lit(0), F.col("c_nationkey") % 5, F.col("c_nationkey")).alias("path"), "phrases", F.concat(F.lit("n"), "c_nationkey").alias("name"), F.array(F.concat(F.lit("m"), F.col("c_nationkey") % 3)).alias("tags"), F.col("phrases").cast("double").alias("cost"))
    return C.tree_slice(nodes, level=(3, 3), size=(3, 1000), ratio=(0.5, 2), pattern="^n", tags=["m1"]).select("path", "phrases", "name")


@query("select n_nationkey as id, [n_regionkey, n_nationkey]::bigint[] as path from nation union all select null, [r_regionkey]::bigint[] from region")
def C10_word_tree(t):
    rows = [r.asDict() for r in t.nation.select(F.array("n_regionkey", "n_nationkey").alias("path"), F.col("n_nationkey").alias("id")).collect()]  # 25 rows
    tree = C.nested(rows)
    flat = [(r.get("id"), r["path"]) for r in C.flattened({"children": [dict(c, path=[i]) if "path" not in c else c for i, c in enumerate(tree["children"])], "path": []}) if r["path"]]
    return t.spark.createDataFrame(flat, "id int, path array<bigint>")


# --- topics


@query("select * from (values (1, 'b', [2, 5]), (3, 'd', []::int[])) as v(id, name, filter)")
def N01_tag_log(t):
    """Filters, too; N01_fold_log folds the events."""
    rows = [(1, 1, "create", "a", [5]), (1, 2, "update", "b", [5, 7]), (1, 3, "addFilter", None, [2]), (1, 4, "removeFilter", None, [7]), (2, 1, "create", "c", []), (2, 2, "delete", None, []), (2, 3, "update", "x", []), (3, 1, "delete", None, []), (3, 2, "create", "d", []), (4, 1, "addFilter", None, [1])]
    return T.fold_tags(t.spark.createDataFrame(rows, "id int, timestamp int, operation string, name string, filter array<int>")).select("id", "name", "filter")


_ANN = "(select user_id, ts, (ts, case event_id % 7 when 0 then 'delete' else 'create' end, event_id) as k, case event_id % 7 when 0 then 'delete' else 'create' end as op, case when event_id % 3 = 0 then event_type end as kind from events)"


@query(f"select user_id, max(ts) as timestamp, case when max(k) filter (op = 'delete') > coalesce(max(k) filter (op = 'create'), (timestamp '1900-01-01', '', 0)) then 'delete' else 'create' end as operation, arg_max(kind, k) filter (kind is not null) as kind from {_ANN} group by user_id")
def N02_annotations(t):
    op = F.when(F.col("event_id") % 7 == 0, "delete").when(F.col("event_id") % 7 < 5, "create")
    log = t.events.select("user_id", F.col("ts").alias("timestamp"), op.alias("operation"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"))
    return T.fold_annotations(log, ["user_id"], ["kind"])


@query("select * from (values (0, 1, [2, 3]), (1, 2, [4]), (1, 3, []::int[]), (2, 4, []::int[])) as v(depth, id, children)")
def N03_tag_tree(t):
    tags = [T.Tag(1, (10, 11)), T.Tag(2, (20,), frozenset({10})), T.Tag(3, (30,), frozenset({11})), T.Tag(4, (40,), frozenset({20}))]
    rows = [(d, x.id, list(x.children)) for d, x in T.depth_first(T.tag_tree(tags))]
    return t.spark.createDataFrame(rows, "depth int, id int, children array<int>")


def _axis_node() -> T.Node:
    return T.Node("x", {0: (1,)}, {1: ([1.0, 0.0], -0.5)}, children=[T.Node("y", {1: (2,)}, {2: ([0.0, 1.0], -0.5)}, mode="allIn", filter=(1,))])


@query("select * from (values (1, [0, 1], [0, 1]), (2, [0], []::int[]), (3, [0, 1], []::int[]), (4, []::int[], []::int[])) as v(id, one, two)")
def N04_walk(t):
    rows = [(1, [[0.9, 0.1], [0.8, 0.9]]), (2, [[0.9, 0.0]]), (3, [[0.3, 0.0], [0.4, 0.1]]), (4, [[0.1, 0.9]])]
    out = T.tag_texts(t.spark.createDataFrame(rows, "id int, vs array<array<double>>"), "vs", "vs", _axis_node())
    keys = lambda c: F.array_sort(F.map_keys(F.coalesce(F.try_element_at("facts", F.lit(c)), F.create_map().cast("map<int,int>"))))
    return out.select("id", keys(1).alias("one"), F.when(F.col("id") == 1, keys(2)).otherwise(F.array().cast("array<int>")).alias("two"))


@query("select 'classifier' as kind, 2::bigint as nodes, true as same")
def N10_save_node(t):
    node = _axis_node()
    node.kind = "classifier"
    again = T.Node.from_json(node.to_json())
    return t.spark.createDataFrame([(again.kind, 1 + len(again.children), again == node)], "kind string, nodes bigint, same boolean")


# --- geo


@query(_ADDRESS + "select (postcode || ' town ') as locality, postcode, count(*)::bigint as count, round(avg(lon), 9) as lon from a group by postcode")
def G01_address_indexes(t):
    localities, _, _ = G.address_indexes(_addresses(t))
    return localities.select(F.regexp_replace("locality", "[a-z]+$", "").alias("locality"), "postcode", "count", F.round("lon", 9).alias("lon"))


@query(_ADDRESS + "select id, number, street, s_nationkey::varchar as \"inseeCode\", case when (select min(lon) from a b where b.street = a.street and b.postcode = a.postcode and b.number = a.number) <= 5 then 'west' end as \"irisCode\" from a")
def G02_locate_addresses(t):
    square = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (5.0, 0.0), (5.0, 100.0), (0.0, 100.0))))
    zones = _addresses(t).select("inseeCode").distinct().select("inseeCode", F.lit("west").alias("irisCode"), square.alias("ring"))
    found = G.locate_addresses(_asked(t), G.address_indexes(_addresses(t)), zones)
    return found.select("id", "number", "street", "inseeCode", "irisCode")


_PLACES = [(1, "Land", "L", "PCLI", "LA", None, None, None, None), (2, "North", None, "ADM1", "LA", "N", None, None, None), (3, "Vale", None, "ADM2", "LA", "N", "V", None, None), (4, "Town", "T", "PPL", "LA", "N", "V", None, None), (5, "Port", None, "PPLC", "LA", None, None, None, None), (6, "Lost", None, "PPL", "XX", "Q", None, None, None), (7, "Shire", None, "ADM3", "LA", "N", "V", "S", None), (8, "Ham", None, "PPLA3", "LA", "N", "V", "S", None)]


@query("""select * from (values (1, 0, 'LA', null, 'Land,L', null, null, null, null), (2, 1, 'N;LA', 'LA', 'Land,L', 'North,', null, null, null), (3, 2, 'V;N;LA', 'N;LA', 'Land,L', 'North,', 'Vale,', null, null), (7, 3, 'S;V;N;LA', 'V;N;LA', 'Land,L', 'North,', 'Vale,', 'Shire,', null),
(4, 5, '4', 'V;N;LA', 'Land,L', 'North,', 'Vale,', null, 'Town,T'), (5, 5, '5', 'LA', 'Land,L', null, null, null, 'Port,'), (8, 5, '8', 'S;V;N;LA', 'Land,L', 'North,', 'Vale,', 'Shire,', 'Ham,')) as v(id, level, code, parent_code, country, adm1, adm2, adm3, city)""")
def G03_places(t):
    places = t.spark.createDataFrame(_PLACES, "id int, name string, alternatenames string, feature_code string, country_code string, admin1_code string, admin2_code string, admin3_code string, admin4_code string").withColumns({"population": F.lit(1), "timezone": F.lit("UTC")})
    return G.place_hierarchy(places).select("id", "level", "code", "parent_code", "country", "adm1", "adm2", "adm3", "city")


# --- streams, functions for SQL, helpers


@query("select strftime(ts, '%Y-%m-%d-%H') as hour, count(*) as n from events where event_type <> 'error' group by 1")
def ST02_micro_batches(t):
    """A stream of the events' file through filter and hourly sink, read back."""
    path, cp = scratch(t), scratch(t)
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{t.dir}/events.parquet*").where("event_type <> 'error'")
    q = microbatch.hourly_sink(stream, "ts", path, cp, available_now=True)
    q.awaitTermination()
    return t.spark.read.json(path).groupBy("hour").agg(F.count("*").alias("n"))


@query("select p_partkey, lower(p_name) as simple, [12] as tags from part")
def UD02_sql_functions(t):
    files.register_functions(t.spark)
    t.part.createOrReplaceTempView("_larkspur_part")
    return t.spark.sql("select p_partkey, simplify_text(p_name) as simple, grammar_tags('nom x', false) as tags from _larkspur_part")


@query("select c_mktsegment, round(sum(c_acctbal * c_acctbal) / sum(c_acctbal), 6) as self_weighted from customer where c_acctbal > 0 group by 1")
def UD03_grouped_function(t):
    @F.pandas_udf("double")
    def weighted(v: pd.Series, w: pd.Series) -> float:
        return float((v * w).sum() / w.sum())

    return t.customer.where("c_acctbal > 0").groupBy("c_mktsegment").agg(F.round(weighted("c_acctbal", "c_acctbal"), 6).alias("self_weighted"))


@query(r"select item_id, unnest(range(len(t))) as i, unnest(t) as w from (select item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as t from benchmark)")
def UD04_table_function(t):
    files.register_functions(t.spark)
    t.benchmark.createOrReplaceTempView("_larkspur_benchmark")
    return t.spark.sql("select item_id, i, w from _larkspur_benchmark, lateral numbered_words(text)")


@query("select doc_id, [coalesce(lang, '-') || '/' || coalesce(source, '-'), '-/x'] as z from documents")
def H01_merged_zip(t):
    return t.documents.select("doc_id", R.zip_longest(F.array("lang"), F.array(F.col("source"), F.lit("x")), F.lit("-"), F.lit("-")).alias("z")).select("doc_id", F.transform("z", lambda x: F.concat(x["a"], F.lit("/"), x["b"])).alias("z"))


@query("select * from (values ([0]::bigint[], 'r'), ([0, 0], 'a'), ([0, 1], 'b'), ([0, 1, 0], 'c')) as v(path, name)")
def H03_flatten_tree(t):
    tree = {"name": "r", "path": [0], "children": [{"name": "a"}, {"name": "b", "children": [{"name": "c"}]}]}
    return t.spark.createDataFrame([(r["path"], r["name"]) for r in C.flattened(json.loads(json.dumps(tree)))], "path array<bigint>, name string")


@query(f"select cluster, list(distinct tag order by tag) as tags from (select cluster, unnest(['root', 'side' || path[2]]) as tag from {_PATHS}) group by cluster")
def H04_leaf_tags(t):
    sides = t.spark.createDataFrame([([0], "root", True), ([0, 0], "side0", True), ([0, 1], "side1", True), ([0, 1], "never", False)], "path array<int>, tag string, is_tag boolean")
    return C.leaf_tags(_paths(t), sides)


@query("select * from (values (1::bigint, 2::bigint, 'x', true), (1, 3, 'y', false)) as v(doc_id, phrase_id, tag, is_tag)")
def H05_user_context(t):
    rows = [("phrases", "1@2@x", ["true"]), ("phrases", "1@3@y", ["false"]), ("tagged", "0,1", ["z"])]
    return C.context_phrases(t.spark.createDataFrame(rows, "kind string, key string, tags array<string>"))


@query("select n_regionkey, list(n_name order by n_name) as names from nation group by 1")
def H09_groups(t):
    return bi.groups(t.nation, "n_regionkey", "n_name")


@query("select label as cluster, vec_id as phrase_id from (select label, vec_id, row_number() over (partition by label order by vec_id) - 1 as i from embeddings) where label = 1 and floor(i / 20) = 1")
def H10_phrase_page(t):
    C.write_phrases(t.embeddings.select(F.col("label").alias("cluster"), F.col("vec_id").alias("phrase_id"), F.lit(0.0).alias("distance")), path := scratch(t), 20)
    return C.read_phrases(t.spark, path, 1, 1).select("cluster", "phrase_id")


@query("select doc_id, string_split(coalesce(lang, '-') || ',' || doc_id, ',')[1] as first from documents")
def H15_first_of_list(t):
    return t.documents.select("doc_id", X.first_of_list(F.concat(F.coalesce("lang", F.lit("-")), F.lit(","), "doc_id")).alias("first"))

# --- the rest, each under its own ID


@query("select true as first, false as again, 'v1' as content")
def S15_download_once(t):
    store, path, calls = Store(t.spark), scratch(t), []
    fetch = lambda url: calls.append(url) or b"v%d" % len(calls)
    row = (download(store, "u", f"{path}/a", fetch), download(store, "u", f"{path}/a", fetch), store.get(f"{path}/a").decode())
    return t.spark.createDataFrame([row], "first boolean, again boolean, content string")


@query("select true as first, false as same, true as changed")
def S16_download_checked(t):
    store, path, tags = Store(t.spark), scratch(t), iter(({"ETag": "1"}, {"ETag": "1"}, {"ETag": "2"}))
    row = tuple(download(store, "u", f"{path}/a", lambda _: b"x", "head-check", lambda _: next(tags)) for _ in range(3))
    return t.spark.createDataFrame([row], "first boolean, same boolean, changed boolean")


@query("select 'a-b.txt' as name, 'x' as content union all select 'q', 'y'")
def S17_archives(t):
    store, path = Store(t.spark), scratch(t)
    with zipfile.ZipFile(buffer := io.BytesIO(), "w") as z:
        z.writestr("a/b.txt", "x")
    store.set(f"{path}/z.zip", buffer.getvalue())
    store.set(f"{path}/q.bz2", bz2.compress(b"y"))
    return read_archives(t.spark, path).select("name", F.col("content").cast("string").alias("content"))


@query("select n_name as value from nation where not contains(n_name, '_2')")
def S19_post_steps(t):
    t.nation.select("n_name").write.text(path := scratch(t))
    post_steps(t.spark, "excludeLines:_2", path, f"{path}/../kept-{path.rsplit('/', 1)[-1]}")
    kept = scratch(t)
    Store(t.spark).move(f"{path}/../kept-{path.rsplit('/', 1)[-1]}", kept)
    return t.spark.read.text(kept)


def _stream(t, out: str):
    stream = microbatch.parquet_stream(t.spark, f"{t.dir}/events.parquet*", ", ".join(f"{c} {k}" for c, k in t.events.dtypes))
    q = microbatch.hourly_sink(microbatch.track(stream, "event_type", ["click", "login"], ["error", "signup", "click", "login"], "event_type"), "ts", out, scratch(t), available_now=True)
    q.awaitTermination()
    return q


_TRACKED = "select strftime(ts, '%Y-%m-%d-%H') as hour, event_type, count(*) as n from events where regexp_matches(event_type, 'click|login') group by all"


@query(_TRACKED)
def S20_tracked_stream(t):
    _stream(t, path := scratch(t))
    return t.spark.read.json(path).groupBy("hour", "event_type").agg(F.count("*").alias("n"))


@query("select count(*)::bigint as rows_ from events where regexp_matches(event_type, 'click|login')")
def ST01_bounded_source(t):
    """A file at a time: rows that batches read are as many as the table's."""
    _stream(t, path := scratch(t))
    return t.spark.read.json(path).agg(F.count("*").alias("rows_"))


@query("select count(distinct strftime(ts, '%Y-%m-%d-%H'))::bigint as folders from events where regexp_matches(event_type, 'click|login')")
def ST03_hourly_folders(t):
    _stream(t, path := scratch(t))
    folders = {p.rsplit("/", 2)[-2] for p, *_ in Store(t.spark).list(path, r"\.json$", True)}
    return t.spark.createDataFrame([(len(folders),)], "folders bigint")


@query("select 2 as parts, true as same, 'two' as line")
def S21_file_store(t):
    store, path = Store(t.spark), scratch(t)
    store.set(f"{path}/a.txt", b"one\ntwo\n")
    parts = list(store.chunks(f"{path}/a.txt", 5))
    store.joined(f"{path}/b.txt", parts)
    row = (len(parts), store.get(f"{path}/b.txt") == b"one\ntwo\n", next(store.lines(f"{path}/b.txt", "^t")))
    return t.spark.createDataFrame([row], "parts int, same boolean, line string")


@query("select 'b.txt' as newest, true as known")
def S23_newest_file(t):
    store, path = Store(t.spark), scratch(t)
    store.set(f"{path}/a.txt", b"1")
    time.sleep(1.1)  # some stores tell time by the second
    store.set(f"{path}/b.txt", b"2")
    return t.spark.createDataFrame([(store.last(path, "txt$").rsplit("/", 1)[-1], store.modified(path) is not None)], "newest string, known boolean")


@query("select true as there, false as after")
def S25_temporary_files(t):
    store = Store(t.spark)
    path = store.temporary(scratch(t), ".txt")
    store.set(path, b"x")
    there = store.exists(path)
    store.delete(path)
    return t.spark.createDataFrame([(there, store.exists(path))], "there boolean, after boolean")


@query("select o_orderstatus, count(*)::bigint as n from orders group by 1")
def S30_snapshots(t):
    """The second run reads what the first has stored."""
    path, calls = scratch(t), []
    step = P.Step("count", {"n": lambda d: calls.append(1) or d.groupBy("o_orderstatus").agg(F.count("*").alias("n"))}, snapshot=True, reuse_snapshot=True)
    model = P.Pipeline("m", [step], snapshot_path=path)
    model.run(t.orders)
    ((_, out, _),) = model.run(t.orders.limit(0))
    if len(calls) != 1:
        raise AssertionError("the snapshot was not read")
    return out


@query("select r_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by 1")
def S32_sql_views(t):
    publish(t.spark, t.dir, ["nation", "region"])
    return t.spark.sql("select r_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by 1")


@query(r"select conv_id, turn, list_aggregate(list_transform(regexp_extract_all(text, '[0-9]{4,}'), lambda x: x[1:9]), 'last') as code from conversations where regexp_matches(text, '[0-9]{4,}') and not regexp_matches(text, '[0-9]{4,}[^0-9]+[0-9]') and len(regexp_extract_all(text, '[0-9]+')) = 1")
def F22_postcode(t):
    rows = t.conversations.where(F.col("text").rlike("[0-9]{4,}") & (F.size(F.regexp_extract_all("text", F.lit("([0-9]+)"), 1)) == 1))
    return rows.select("conv_id", "turn", X.postcode("text").alias("code"))


@query("select unnest(['net', 'net', 'gross']) as price, unnest(['default', 'chosen', 'every']) as how union all select 'net', 'every'")
def T14_versions(t):
    model = _model(t)
    rows = [("default", model.default()), ("chosen", model.version(price="net")), *(("every", v) for v in model.every())]
    return t.spark.createDataFrame([(dict(v.choices)["price"], how) for how, v in rows], "price string, how string")


@query("select n_name as label, n_regionkey from nation")
def T15_step_options(t):
    step = P.Step("s", {"a": lambda d: d.withColumn("extra", F.lit(1))}, select=["n_name", "n_regionkey", "n_nationkey", "extra"], drop=["extra", "n_nationkey"], rename={"n_name": "label"}, repartition=3)
    ((_, out, _),) = P.Pipeline("m", [step]).run(t.nation)
    return out


@query("select 'gross' as price, 'note' as note, 1 as params, 1 as logs, 1 as steps")
def T16_version_edits(t):
    v = _model(t).default().step("price", "gross").drop("sum").comment("note").set(price__k=2).log(a=1)
    return t.spark.createDataFrame([(dict(v.choices)["price"], v.note, len(v.params), len(v.logs), len(v.choices))], "price string, note string, params int, logs int, steps int")


@query("select doc_id, replace(text, '#', '') as text from (select doc_id, 'a#b' || doc_id as text from documents)")
def T20_stage_columns(t):
    rows = t.documents.select("doc_id", F.concat(F.lit("a#b"), "doc_id").alias("x"))
    return U.SocialCleaner(inputCol="x", outputCol="text").transform(rows).select("doc_id", "text")


@query("select vec_id, case when e[2] >= 0 and e[1] >= 0 then e[2] / (e[1] + e[2]) when e[2] < 0 and e[1] < 0 then e[1] / (e[1] + e[2]) else 0.5 + atan(e[2] - e[1]) / pi() end as score from (select vec_id, embedding::double[] as e from embeddings)")
def UD06_fitted_stages(t):
    rows = t.embeddings.select("vec_id", V.dense("embedding").alias("raw"))
    return Pipeline(stages=[U.RawToScore(inputCol="raw", outputCol="score")]).fit(rows).transform(rows).select("vec_id", "score")


@query("select n_name, upper(n_name) || '!' as loud, [n_name] as l from nation")
def UD05_chained_functions(t):
    return t.nation.transform(lambda d: d.withColumn("loud", F.concat(F.upper("n_name"), F.lit("!")))).transform(lambda d: d.select("n_name", "loud", F.array("n_name").alias("l")))


@query("select p_partkey, length(p_name) + 1 as n from part")
def UD01_vectorised_function(t):
    @F.pandas_udf("bigint")
    def longer(names: pd.Series) -> pd.Series:
        return names.str.len() + 1

    return t.part.select("p_partkey", longer("p_name").alias("n"))


@query("select 'demo' as appname, 3 as value")
def UD07_application(t):
    Store(t.spark).set(path := f"{scratch(t)}/c.json", b'{"value": 3}')
    from larkspur.__main__ import settings

    found = settings(["appname=demo", f"config={path}"], {"value": 1, "master": "local[2]"}, Store(t.spark).get)
    return t.spark.createDataFrame([(found["appname"], found["value"])], "appname string, value int")


@query("select doc, [1, 1, 1] as flags from (select distinct floor(vec_id / 5)::bigint as doc from embeddings)")
def T23_topic_scores(t):
    """Every document is judged by every topic; with no least likeness all are flagged."""
    docs = t.embeddings.groupBy(F.floor(F.col("vec_id") / 5).alias("doc")).agg(F.collect_list(V.dense("embedding")).alias("vs"))
    topics = np.eye(64)[:3]
    return T.topic_scores(docs, "vs", topics, 3, -1.0).select("doc", F.transform("topics", lambda x: x["flag"].cast("int")).alias("flags"))


@query("select true as good, count(*)::bigint as rows_ from documents join labels using (doc_id) where text is not null")
def T24_fold_performance(t):
    from pyspark.ml.classification import LinearSVC

    return U.fold_performance(_features(t), LinearSVC(maxIter=5), 3, label="label").select((F.col("f1") > 0.3).alias("good"), "rows_")


@query("select * from (values (1, [0], [1, 2]), (2, []::int[], []::int[])) as v(id, alone, span)")
def N05_token_spans(t):
    """One token is enough in the first text's first place; its next two only together."""
    node = T.Node("x", {0: (1,)}, {1: ([1.0], -0.5)})
    out = T.tag_texts(t.spark.createDataFrame([(1, [[0.6], [0.3], [0.3], [-9.0]]), (2, [[0.1], [0.1]])], "id int, vs array<array<double>>"), "vs", "vs", node)
    held = F.map_entries(F.coalesce(F.try_element_at("facts", F.lit(1)), F.create_map().cast("map<int,int>")))
    first = F.array_sort(F.transform(F.filter(held, lambda e: (e["key"] == 0) & (e["value"] == 0)), lambda e: e["key"]))
    rest = F.array_sort(F.transform(F.filter(held, lambda e: (e["key"] > 0) & (e["key"] < 3)), lambda e: e["key"]))
    return out.select("id", first.alias("alone"), rest.alias("span"))


@query("select count(distinct label)::bigint as rows_, true as right from embeddings")
def N06_fitted_node(t):
    """A node fitted on made classes gives each example its own."""
    axes = np.eye(6)
    node = T.fit_node("n", {0: [1, 2]}, {1: [axes[1]] * 3, 2: [axes[2]] * 3}, [axes[3], axes[0]])
    right = all(T.score(axes[c], node.models[c]) > 0.5 > T.score(axes[3 - c], node.models[c]) for c in (1, 2))
    return t.embeddings.agg(F.countDistinct("label").alias("rows_")).withColumn("right", F.lit(right))


@query("select 1 as token, 1.0::double as score")
def N07_analogy(t):
    axes, facts, scores = np.eye(6), {0: {0: 0, 1: 1}, 1: {0: 0}}, {}
    T.walk(T.Node("a", {1: (5,)}, {5: T.analogy_model([(axes[1], axes[4])])}, kind="analogy"), axes[[1, 4]], facts, scores)
    return t.spark.createDataFrame([(next(iter(facts[5])), round(scores[5], 9))], "token int, score double")


def _made_documents(t):
    return t.embeddings.groupBy(F.floor(F.col("vec_id") / 5).alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", V.dense("embedding").alias("e")))), lambda x: x["e"]).alias("vs"))


@query("select 4 as classes, true as apart, true as weighed")
def N08_online_clusters(t):
    found = T.cluster_online(_made_documents(t), "doc", "vs", 4, split=20.0, parts=4)
    return t.spark.createDataFrame([(len(found.centre), found.gap() > 0, sum(found.weight) > 0)], "classes int, apart boolean, weighed boolean")


@query("select 2 as classes, 2 as children, 0.25::double as offset")
def N09_merged_nodes(t):
    a = T.Node("n", {0: (1,)}, {1: ([1.0], 0.5)}, children=[T.Node("c", {})])
    b = T.Node("n", {0: (2,)}, {1: ([1.0], 0.0), 2: ([2.0], 1.0)}, children=[T.Node("d", {})])
    out = T.merged(a, b)
    return t.spark.createDataFrame([(len(out.models), len(out.children), out.models[1][1])], "classes int, children int, offset double")


@query("select unnest([1, 2, 4, 3]) as id, unnest([false, false, true, true]) as leaf, unnest([0, 1, 2, 3]) as place")
def H06_tree_walks(t):
    tree = T.tag_tree([T.Tag(1, (10, 11)), T.Tag(2, (20,), frozenset({10})), T.Tag(3, (30,), frozenset({11})), T.Tag(4, (40,), frozenset({20}))])
    ends = {x.id for x in T.leaves(tree)}
    return t.spark.createDataFrame([(x.id, x.id in ends, i) for i, (_, x) in enumerate(T.depth_first(tree))], "id int, leaf boolean, place int")


@query("select 1 as old, 7 as new, 'x' as name")
def H07_copied_parameters(t):
    old = _axis_node()
    new = T.renumbered(old, {1: 7, 2: 8})
    return t.spark.createDataFrame([(old.links[0][0], new.links[0][0], new.name)], "old int, new int, name string")


@query(f"select vec_id, round({_COS % ('e', 'v')}, 6) as c from {_E} a, (select embedding::double[] as v from embeddings where vec_id = 0)")
def H12_cosine_throughput(t):
    """The same by Arrow and numpy, as the bench times it."""
    (first,) = t.embeddings.where("vec_id = 0").select(V.dense("embedding").alias("e")).collect()

    @F.pandas_udf("double")
    def cosine(x: pd.Series) -> pd.Series:
        m, v = np.stack(x), np.array(first.e)
        return pd.Series(m @ v / np.linalg.norm(m, axis=1) / np.linalg.norm(v))

    return t.embeddings.select("vec_id", F.round(cosine(V.dense("embedding")), 6).alias("c"))


@query("select 'Z' as name, 4.0::double as \"MaxLong\", 1 as rings")
def S12_shapefile(t):
    store, path = Store(t.spark), scratch(t)
    points = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i", 5, 0, 0, 4, 3, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in points)
    store.set(f"{path}/z.shp", b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    fields = struct.pack("<11sc4xB15x", b"NAME", b"C", 4) + b"\x0d"
    store.set(f"{path}/z.dbf", struct.pack("<4BIHH20x", 3, 0, 0, 0, 1, 32 + len(fields), 5) + fields + b" Z   ")
    return G.read_shapes(t.spark, path).select(F.col("attributes")["NAME"].alias("name"), "MaxLong", F.size("rings").alias("rings"))


@query("select 'Z' as name")
def S13_console(t):
    from larkspur.__main__ import main

    store, path, out = Store(t.spark), scratch(t), scratch(t)
    body = struct.pack("<i2d", 1, 1.0, 2.0)
    store.set(f"{path}/z.shp", b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    fields = struct.pack("<11sc4xB15x", b"NAME", b"C", 4) + b"\x0d"
    store.set(f"{path}/z.dbf", struct.pack("<4BIHH20x", 3, 0, 0, 0, 1, 32 + len(fields), 5) + fields + b" Z   ")
    main(["shapes", path, out], t.spark)
    return t.spark.read.parquet(out).select(F.col("attributes")["NAME"].alias("name"))
