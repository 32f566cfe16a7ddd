"""Queries by ID of the operator inventory, and SQL for most; catalog.py adds the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from larkspur.functions import text as X, vectors as V
from larkspur.operators import clustering as C, entities as E, relational as R, search as S
from larkspur.plans.session import written
from larkspur.sources import files
from larkspur.streaming import microbatch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WORDS = r"[^\p{L}\p{N}]+"
_TOK = r"list_filter(string_split_regex(lower(%s), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_PLAIN = "translate(lower(%s), 'çèéêëàáâãäåæœìíîïðñòóôõöøùúûü', 'ceeeeaaaaaaaeiiiioooooooouuuu')"


# --- scans, projections, filters, column plumbing


@query("select * from nation")
def S01_parquet_scan(t):
    return t.nation


@query("select user_id, event_type, json_extract_string(props, '$.k')::varchar as k, count(*) as n from events group by all")
def JS01_json_field(t):
    return t.events.groupBy("user_id", "event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("select page_id, count(distinct l) as n_links from (select page_id, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)) as l from pages) group by page_id")
def S14_links(t):
    return files.links(t.pages).groupBy("page_id").agg(F.count("*").alias("n_links"))


@query("select o_orderkey, o_totalprice * 1.1 as gross, o_orderpriority as priority from orders where o_totalprice > 1000 and o_orderstatus in ('F', 'O')")
def P01_project_filter(t):
    return t.orders.where((F.col("o_totalprice") > 1000) & F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", (F.col("o_totalprice") * F.lit(1.1)).alias("gross"), F.col("o_orderpriority").alias("priority"))


@query("select c_custkey as id, c_name as name from customer")
def P02_drop_rename(t):
    return t.customer.drop("c_acctbal", "c_mktsegment", "c_nationkey").withColumnsRenamed({"c_custkey": "id", "c_name": "name"})


@query("select l_orderkey, l_linenumber from lineitem where l_discount > 0.05 and l_returnflag <> 'N'")
def P03_sql_filter(t):
    return t.lineitem.where("l_discount > 0.05 and l_returnflag <> 'N'").select("l_orderkey", "l_linenumber")


@query("select o_orderkey, o_orderkey % 7 as bucket from orders where o_orderkey % 7 in (1, 3)")
def P05_modulo_bucket(t):
    return t.orders.select("o_orderkey", (F.col("o_orderkey") % 7).alias("bucket")).where(F.col("bucket").isin(1, 3))


@query("select distinct o_orderstatus, o_orderpriority from orders")
def P08_distinct(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query(f"select doc_id, count(*) as n from (select doc_id, unnest({_TOK % 'text'}) as w from documents) group by doc_id")
def P09_explode(t):
    return t.documents.select("doc_id", F.explode(X.tokens("text")).alias("w")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("select vec_id, unnest([[label], [label, vec_id % 3], [label, vec_id % 3, vec_id % 5]]) as path from (select vec_id, label::bigint as label from embeddings)")
def P10_ancestors(t):
    path = F.array(F.col("label").cast("long"), F.col("vec_id") % 3, F.col("vec_id") % 5)
    return R.ancestors(t.embeddings.select("vec_id", path.alias("path")), "path")


@query("select c_custkey, row_number() over (order by c_acctbal, c_custkey) as id from customer")
def P13_add_id(t):
    return R.add_id(t.customer.select("c_custkey", "c_acctbal"), "id", ["c_acctbal", "c_custkey"]).select("c_custkey", "id")


# --- joins


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def J01_inner(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("select l1.l_orderkey, l1.l_linenumber, l2.l_tax from lineitem l1 join lineitem l2 on l1.l_orderkey = l2.l_orderkey and l1.l_linenumber = l2.l_linenumber and l2.l_tax > 0.03")
def J02_composite(t):
    return t.lineitem.select("l_orderkey", "l_linenumber").join(t.lineitem.select("l_orderkey", "l_linenumber", "l_tax").where("l_tax > 0.03"), ["l_orderkey", "l_linenumber"])


@query("select a.vec_id as a, count(*) as n from embeddings a join embeddings b on [a.label, a.vec_id % 3] = [b.label, b.vec_id % 3] group by 1")
def J03_array_key(t):
    key = F.array(F.col("label").cast("long"), F.col("vec_id") % 3).alias("k")
    counts = t.embeddings.groupBy(key).agg(F.count("*").alias("n"))
    return t.embeddings.select(F.col("vec_id").alias("a"), key).join(counts, "k").select("a", "n")


@query("select d.doc_id, l.quality from documents d left join labels l on d.doc_id = l.doc_id")
def J04_left(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def J05_anti(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("select coalesce(c_nationkey, s_nationkey) as k, nc, ns from (select c_nationkey, count(*) as nc from customer group by 1) full join (select s_nationkey, count(*) as ns from supplier group by 1) on c_nationkey = s_nationkey")
def J06_full(t):
    c = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("nc"))
    return c.join(t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("ns")), "k", "full")


@query("select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey")
def J07_pairs_in_group(t):
    a, b = (t.nation.select(F.col("n_name").alias(x), F.col("n_nationkey").alias(f"k{x}"), "n_regionkey") for x in "ab")
    return a.join(b, "n_regionkey").where("ka <> kb").select("a", "b")


_LOOKUP = rf"""
with p as (select doc_id, len(t) as dl, unnest(t) as token from (select doc_id, {_TOK % 'text'} as t from documents)),
f as (select token, doc_id, dl, count(*) as tf from p group by all),
n as (select count(*)::double as n, avg(dl) as avgdl from (select distinct doc_id, dl from f)),
w as (select token, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) as w
      from f join (select token, count(*) as df from f group by token) using (token), n),
q as (select item_id, token, count(*) as boost from (select item_id, unnest({_TOK % 'text'}) as token from benchmark) group by all),
s as (select item_id, doc_id, sum(boost * w) as score from q join w using (token) group by all)
select b.item_id, s.doc_id, round(s.score, 4) as score from benchmark b left join (select * from s qualify row_number() over (partition by item_id order by round(score, 6) desc, doc_id) = 1) s using (item_id)
"""


@query(_LOOKUP)
def J10_lookup(t):
    """The flagship: for each item's whole text the best document by BM25."""
    asked = t.benchmark.select(F.col("item_id").alias("q"), F.explode(X.tokens("text")).alias("token")).groupBy("q", "token").agg(F.count("*").alias("boost"))
    top = S.best_rows(asked, t.documents, "doc_id", "text")
    return t.benchmark.join(top, F.col("item_id") == F.col("q"), "left").select("item_id", F.col("_key").alias("doc_id"), F.round("score", 4).alias("score"))


@query("select s_suppkey, n_nationkey as k1, null::int as k2 from supplier join nation on s_nationkey = n_nationkey")
def J11_lookups(t):
    """Several query columns, a struct of results for each."""
    left = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("q1"), F.lit("nowhere").alias("q2"))
    found = S.lookups(left, t.nation.select("n_nationkey", F.col("n_name").alias("name")), ["q1", "q2"], "name", "n_nationkey", tokenize=_WORDS)
    return found.select("s_suppkey", F.col("q1_res.n_nationkey").alias("k1"), F.col("q2_res.n_nationkey").alias("k2"))


@query("select s_suppkey, n_nationkey from supplier join nation on s_nationkey = n_nationkey")
def X13_standard_lookup(t):
    left = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("q"))
    return S.lookup(left, t.nation.select("n_nationkey", F.col("n_name").alias("name")), "q", "name", "n_nationkey", tokenize=_WORDS).select("s_suppkey", "n_nationkey")


_CENTRES = "select label, list(m order by i) as c from (select label, i, avg(x) as m from (select label, unnest(e) as x, unnest(range(len(e))) as i from (select label, embedding::double[] as e from embeddings)) group by label, i) group by label"


@query(f"select vec_id, arg_max(c.label, (round(list_cosine_similarity(e, c.c), 9), -c.label)) as centre from (select vec_id, embedding::double[] as e from embeddings) v, ({_CENTRES}) c group by vec_id")
def J14_nearest_centre(t):
    """Centres are multiplied with blocks of vectors."""
    rows = t.embeddings.select("vec_id", "label", V.dense("embedding").alias("vector"))
    centres = [(r.label, r.vector, 1.0) for r in C.means(rows, "label", "vector").collect()]  # a row for each label
    return C.assigned(rows.drop("label"), centres).select("vec_id", F.col("cluster").cast("int").alias("centre"))


@query("select n_name, coalesce(n, 0) as n from nation left join (select c_nationkey, count(*) as n from customer where c_acctbal > 0 group by 1) on n_nationkey = c_nationkey")
def J16_choropleth(t):
    n = t.customer.where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return t.nation.join(n, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


# --- aggregations


@query("select l_orderkey, sum(l_quantity) as l_quantity, max(l_extendedprice) as l_extendedprice, min(l_discount) as l_discount, min(l_shipdate) as l_shipdate from lineitem group by 1")
def A01_group_by(t):
    rows = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    return R.group_by(rows, ["l_orderkey"], max_of=["l_extendedprice"], min_of=["l_discount"], sum_of=["l_quantity"])


@query("select label, list(m order by i) as v from (select label, i, max(x) as m from (select label, unnest(e) as x, unnest(range(len(e))) as i from (select label, embedding::double[] as e from embeddings)) group by label, i) group by label")
def A02_vector_max(t):
    return R.group_by(t.embeddings.select("label", V.dense("embedding").alias("v")), ["label"], max_of=["v"])


@query("select c_mktsegment, sum(c_acctbal * c_nationkey) / sum(c_nationkey) as mean from customer group by 1")
def A06_weighted_mean(t):
    return t.customer.groupBy("c_mktsegment").agg((F.sum(F.col("c_acctbal") * F.col("c_nationkey")) / F.sum("c_nationkey")).alias("mean"))


@query("select n_regionkey, list(n_name order by n_name) as names from nation group by 1")
def A07_parallel_arrays(t):
    return t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))


@query("select c_nationkey, arg_max(c_custkey, (c_acctbal, c_custkey)) as best, arg_min(c_custkey, (c_acctbal, c_custkey)) as worst from customer group by 1")
def A08_best_of_group(t):
    by = F.struct("c_acctbal", "c_custkey")
    return t.customer.groupBy("c_nationkey").agg(F.max_by("c_custkey", by).alias("best"), F.min_by("c_custkey", by).alias("worst"))


@query(f"select lang, token, count(*) as n from (select lang, unnest({_TOK % 'text'}) as token from documents) group by all")
def A10_term_counts(t):
    return t.documents.select("lang", F.explode(X.tokens("text")).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))


@query("select k, sum(n) as rows_, sum(v) as cost, count(distinct user_id) as users from (select unnest([event_type, event_type || '/' || (user_id % 3)]) as k, user_id, count(*) as n, sum(value) as v from events group by 1, 2) group by k")
def A12_path_rollup(t):
    paths = F.explode(F.array("event_type", F.concat("event_type", F.lit("/"), (F.col("user_id") % 3).cast("string"))))
    first = t.events.select(paths.alias("k"), "user_id", "value").groupBy("k", "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return first.groupBy("k").agg(F.sum("n").alias("rows_"), F.sum("v").alias("cost"), F.count("user_id").alias("users"))


@query("select sum((quality = 1 and toxic = 0)::int) as tp, sum((quality = 0 and toxic = 0)::int) as fp, sum((quality = 1 and toxic = 1)::int) as fn, sum((quality = 0 and toxic = 1)::int) as tn from labels")
def A14_confusion(t):
    of = lambda q, x: F.sum(((F.col("quality") == q) & (F.col("toxic") == x)).cast("long"))
    return t.labels.agg(of(1, 0).alias("tp"), of(0, 0).alias("fp"), of(1, 1).alias("fn"), of(0, 1).alias("tn"))


_CURVE = """with r as (select floor(n_chars / 100)::double as threshold, quality from documents join labels using (doc_id)),
b as (select threshold, sum((quality = 1)::int) as p, sum((quality <> 1)::int) as n from r group by 1),
c as (select threshold, (sum(p) over w)::bigint as tp, (sum(n) over w)::bigint as fp, (sum(p) over ())::bigint as ap, (sum(n) over ())::bigint as an from b window w as (order by threshold desc)),
k as (select threshold, tp, fp, an - fp as tn, ap - tp as fn, tp / (tp + fp) as precision, tp / ap as recall from c)
"""


def _scored(t):
    return R.curves(t.documents.join(t.labels, "doc_id").select(F.floor(F.col("n_chars") / 100).cast("double").alias("s"), "quality"), "s", "quality")


@query(_CURVE + "select *, fp / (fp + tn) as fpr, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) end as f1 from k")
def A15_curves(t):
    return _scored(t).drop("_area")


@query(_CURVE + "select threshold, tp, fp, tn, fn, precision, recall, fp / (fp + tn) as fpr, 2 * precision * recall / (precision + recall) as f1 from k where precision + recall > 0 order by f1 desc, threshold desc limit 1")
def T08_best_threshold(t):
    return R.optimal_threshold(_scored(t))


@query(rf"""with w as (select distinct source, {_TOK % 'text'} as t from documents), f as (select source, token, count(*) as tf from (select source, unnest(t) as token from w) group by all),
d as (select token, count(*) as df from f group by 1), n as (select count(distinct source) as n from f), s as (select source, token, tf * ln(n / df) as s from f join d using (token), n)
select source, token, s / sum(s) over (partition by source) as score from s""")
def A17_tag_tfidf(t):
    return R.tag_tfidf(t.documents.select("source", X.tokens("text").alias("t")), "source", "t")


@query(rf"""with r as (select list_distinct({_TOK % 'text'}) as t from documents where text is not null), e as (select t, list_contains(t, 'the') as e from r), n as (select count(*) as n, sum(e::int) as ne from e),
c as (select token, count(*) as c, sum(e::int) as coo from (select e, unnest(t) as token from e) where token <> 'the' group by token)
select token, coo::bigint as coo, (coo / ne) / (c / n) as lift, coo * ((coo / ne) / (c / n)) as score from c, n where coo > 0""")
def A18_cooccurrence(t):
    return R.cooccurrence(t.documents.select("doc_id", X.tokens("text").alias("t")), "doc_id", "t", "the")


@query(f"select tag, n, row_number() over (order by n desc, tag) - 1 as index from (select tag, count(*) as n from (select unnest({_TOK % 'text'}) as tag from benchmark) group by tag having count(*) >= 2) qualify index < 50")
def A19_dictionary(t):
    counts = t.benchmark.select(F.explode(X.tokens("text")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).where("n >= 2")
    return counts.orderBy(F.desc("n"), "tag").limit(50).select("tag", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "tag")) - 1).alias("index"))


@query("select o_orderstatus, sum(o_totalprice) as total, count(*) as n, count(distinct o_custkey) as customers, avg(o_totalprice) as mean from orders group by 1")
def A21_measures(t):
    return t.orders.groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.avg("o_totalprice").alias("mean"))


@query("with b as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem) select least(9, floor((l_extendedprice - lo) / (hi - lo) * 10))::bigint as bin, count(*) as n from lineitem, b group by 1")
def A23_histogram(t):
    b = t.lineitem.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    at = F.least(F.lit(9), F.floor((F.col("l_extendedprice") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10)).cast("long")
    return t.lineitem.select("l_extendedprice").join(F.broadcast(b)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row


@query("select o_orderpriority, sum(o_totalprice) filter (o_orderstatus = 'F') as F, sum(o_totalprice) filter (o_orderstatus = 'O') as O, sum(o_totalprice) filter (o_orderstatus = 'P') as P from orders group by 1")
def A24_pivot(t):
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice"))


# --- windows, top-k, sets


@query("select c_custkey, c_nationkey from customer qualify row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) <= 3")
def W02_top_per_group(t):
    return R.top_per(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_custkey", "c_nationkey")


@query("select n_nationkey, dense_rank() over (order by n_regionkey) as r from nation")
def W06_dense_rank(t):
    return R.dense_rank(t.nation, "r", [F.col("n_regionkey")]).select("n_nationkey", "r")


@query("select o_orderkey, sum(o_totalprice) over w as s, avg(o_totalprice) over w as a, count(*) over w as n from orders window w as (partition by o_custkey)")
def W07_group_windows(t):
    w = Window.partitionBy("o_custkey")
    return t.orders.select("o_orderkey", F.sum("o_totalprice").over(w).alias("s"), F.avg("o_totalprice").over(w).alias("a"), F.count("*").over(w).alias("n"))


@query("select event_id, sum(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row) as s from events")
def W09_sliding_sum(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return t.events.select("event_id", F.sum("value").over(w).alias("s"))


@query(rf"select item_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i : i + 2])) as gram from (select item_id, {_TOK % 'text'} as t from benchmark) where len(t) >= 3")
def W10_ngrams(t):
    return t.benchmark.select("item_id", F.explode(X.ngrams(X.tokens("text"), 3)).alias("gram"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def K03_limit(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("select c_nationkey as k from customer union all select s_nationkey from supplier")
def U01_union(t):
    return R.union_all(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")))


# --- text


@query(f"select doc_id, md5(regexp_replace(translate({_PLAIN % 'text'}, chr(39) || '-', chr(1) || ' '), '[ld](\\x01)', ' \\1', 'g').replace(chr(1), ' ')) as h from documents")
def F01_fold_accents(t):
    return t.documents.select("doc_id", F.md5(X.simplify("text")).alias("h"))


@query("select doc_id, regexp_matches(lower(text), '[çèéêëàáâãäåæœìíîïðñòóôõöøùúûü]') as accents, regexp_matches(text, '[\\r\\n.;!?]') as phrases from documents")
def F03_contains(t):
    return t.documents.select("doc_id", X.contains_accents("text").alias("accents"), X.contains_phrase_separator("text").alias("phrases"))


@query(r"select page_id, regexp_replace('see ' || url || ' now', '(?i)https?://[\w:#@%/;$()~_?+-=\\.&]*', repeat(' ', length(regexp_extract('see ' || url || ' now', '(?i)https?://[\w:#@%/;$()~_?+-=\\.&]*')))) as text from pages")
def F05_links_as_blanks(t):
    return t.pages.select("page_id", X.links_as_blanks(F.concat(F.lit("see "), "url", F.lit(" now"))).alias("text"))


@query(r"""with r as (select conv_id, turn, regexp_extract_all(text, '(\p{L}+|[^\p{L}]+)', 1) as w from conversations), x as (select conv_id, turn, unnest(w) as word, unnest(range(len(w))) as i from r)
select conv_id, turn, word, i, coalesce(sum(regexp_matches(word, '[\r\n.;!?]')::int) over (partition by conv_id, turn order by i rows between unbounded preceding and 1 preceding), 0)::bigint as phrase from x""")
def F06_split_runs(t):
    runs = t.conversations.select("conv_id", "turn", F.explode(X.split_runs("text")).alias("r"))
    return runs.select("conv_id", "turn", F.col("r.word").alias("word"), F.col("r.index").cast("long").alias("i"), F.col("r.phrase").cast("long").alias("phrase"))


@query("select * from (values (1, '   user : fun great  link '), (2, 'a@b.com   x'), (3, ' user  and x_@y')) as v(i, text)")
def F08_clean_social(t):
    rows = t.spark.createDataFrame([(1, "RT @me: #fun:)http://x.y"), (2, "a@b.com via x"), (3, "@you and x_@y")], "i int, text string")
    return rows.select("i", X.clean_social("text", {":)": 1}).alias("text"))


@query(f"select item_id, {_TOK % 'text'} as tokens from benchmark")
def F09_tokens(t):
    return t.benchmark.select("item_id", X.tokens("text").alias("tokens"))


@query("select * from (values ('nation', 'nat'), ('chanter', 'chant'), ('rapidement', 'rapid'), ('as', 'as'), ('finesse', 'finess'), ('mange', 'mang'), ('heureux', 'heureux'), ('patience', 'pati'), ('laboratoire', 'labor'), ('rose', 'ros'), ('vent', 'vent')) as v(word, stem)")
def F10_stem(t):
    words = ("nation", "chanter", "rapidement", "as", "finesse", "mange", "heureux", "patience", "laboratoire", "rose", "vent")
    return t.spark.createDataFrame([(w,) for w in words], "word string").select("word", X.stem("word").alias("stem"))


@query("select a.p_partkey as a, levenshtein(a.p_name, b.p_name) as d from part a join part b on a.p_partkey + 1 = b.p_partkey")
def F16_levenshtein(t):
    b = t.part.select((F.col("p_partkey") - 1).alias("a"), F.col("p_name").alias("other"))
    return t.part.select(F.col("p_partkey").alias("a"), "p_name").join(b, "a").select("a", F.levenshtein("p_name", "other").cast("long").alias("d"))


@query()
def F18_text_similarity(t):
    b = t.part.select((F.col("p_partkey") - 1).alias("a"), F.col("p_name").alias("other"))
    return t.part.select(F.col("p_partkey").alias("a"), "p_name").join(b, "a").select("a", X.text_similarity("p_name", "other", 0.7, 0.7).alias("s"))


# --- vectors


_PAIR = "from embeddings a join embeddings b on a.vec_id + 1 = b.vec_id"


def _pairs(t):
    rows = t.embeddings.select("vec_id", V.dense("embedding").alias("x"))
    return rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query(f"select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as c, round((list_cosine_similarity(a.embedding::double[], b.embedding::double[]) + 1) / 2, 9) as s {_PAIR}")
def V01_cosine(t):
    return _pairs(t).select("vec_id", F.round(V.cosine("x", "y"), 9).alias("c"), F.round(V.similarity("x", "y"), 9).alias("s"))


@query(f"select a.vec_id, list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda z: z[1] + z[2]) as s, list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda z: z[1] - z[2]) as d, round(sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])), 9) as n {_PAIR}")
def V03_sum_minus_norm(t):
    return _pairs(t).select("vec_id", V.add("x", "y").alias("s"), V.minus("x", "y").alias("d"), F.round(V.norm("x"), 9).alias("n"))


@query()
def V10_hashed_counts(t):
    return t.benchmark.select("item_id", F.to_json(V.hashed_counts(X.tokens("text"))).alias("v"))


@query("select vec_id, case when a >= 0 and b >= 0 then b / (a + b) when a < 0 and b < 0 then a / (a + b) when b <= 0 then 0.5 - atan(a - b) / pi() else 0.5 + atan(b - a) / pi() end as s from (select vec_id, embedding[1]::double as a, embedding[2]::double as b from embeddings)")
def V12_margin_score(t):
    return t.embeddings.select("vec_id", V.margin_score(V.dense("embedding")).alias("s"))


# --- dates, splits, logs, streams


@query("select o_orderkey, year(o_orderdate) as y, day(o_orderdate) as d, strftime(o_orderdate, '%Y-%m-%d-%H') as hour from orders")
def D01_date_parts(t):
    return t.orders.select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"), F.dayofmonth("o_orderdate").cast("long").alias("d"), F.date_format("o_orderdate", "yyyy-MM-dd-HH").alias("hour"))


@query("select o_orderkey, case (dense_rank() over (order by o_totalprice desc, o_orderkey desc) - 1) % 4 when 1 then 1 else 0 end as fold from orders")
def T04_rank_split(t):
    return R.rank_split(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], [0.75, 0.25]).select("o_orderkey", "fold")


@query()
def T02_group_split(t):
    return t.orders.select("o_orderkey", "o_custkey", R.hash_fold(["o_custkey"], 5, 38).alias("fold"))


_LOG = """with r as (select user_id, ts, kind, v, (ts, kind, v) as k from (select user_id, ts, case event_id % 11 when 0 then 'delete' when 1 then 'create' else 'update' end as kind, event_type as v from events)),
s as (select user_id, max(k) filter (kind = 'create') as made, max(k) filter (kind = 'delete') as gone from r group by 1)
select user_id, arg_max(v, k) as v, max(ts) as ts from r join s using (user_id) where (made is null or k >= made) and (gone is null or made > gone) group by 1"""


@query(_LOG)
def N01_fold_log(t):
    kind = F.when(F.col("event_id") % 11 == 0, "delete").when(F.col("event_id") % 11 == 1, "create").otherwise("update")
    return R.fold_log(t.events.select("user_id", "ts", kind.alias("kind"), F.col("event_type").alias("v")), "user_id", "ts", "kind", "v")


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by all")
def ST05_windowed_counts(t):
    return microbatch.windowed_counts(t.events, "ts", "event_type")


@query("select doc_id from documents where regexp_matches(lower(text), 'the|que') and lang in ('en', 'fr')")
def ST04_track(t):
    return microbatch.track(t.documents, "text", ["the", "que"], ["en", "fr"]).select("doc_id")


@query("select r_name as a, n_name as b, r_name || '/' || n_name as path from nation join region on n_regionkey = r_regionkey union all select r_name, null, r_name from region")
def G03_place_hierarchy(t):
    low = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("a"), F.col("n_name").alias("b"), F.concat_ws("/", "r_name", "n_name").alias("path"))
    return R.union_all(low, t.region.select(F.col("r_name").alias("a"), F.lit(None).cast("string").alias("b"), F.col("r_name").alias("path")))


@query("select vec_id, e[1] >= -0.1 and e[1] <= 0.1 and e[2] >= -0.1 and e[2] <= 0.1 as inside from (select vec_id, embedding::double[] as e from embeddings)")
def V18_in_polygon(t):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1))))
    return t.embeddings.select("vec_id", V.dense("embedding").alias("e")).select("vec_id", V.in_polygon(F.element_at("e", 1), F.element_at("e", 2), ring).alias("inside"))


# --- entity dictionaries


_FLAT = "select 's' as tag_group, s_nationkey as tag, s_suppkey % 4 as entity_group, s_suppkey % 3 as entity_index, [s_name] as synonym from supplier"
_NESTED = f"""with l as (select tag_group, tag, entity_group, entity_index, count(*) as n from ({_FLAT}) group by all), e as (select tag_group, tag, entity_group, count(*) as legs, sum(n)::bigint as n from l group by all)
select tag_group, tag, 1::bigint as legs, sum(n)::bigint as n from e where legs = 1 group by all union all select tag_group, tag, legs, n from e where legs > 1"""


def _flat(t):
    return t.supplier.select(F.lit("s").alias("tag_group"), F.col("s_nationkey").alias("tag"), (F.col("s_suppkey") % 4).alias("entity_group"), (F.col("s_suppkey") % 3).alias("entity_index"), F.array("s_name").alias("synonym"))


@query(_NESTED)
def E01_group_entities(t):
    return E.group_entities(_flat(t)).select("tag_group", "tag", F.size("legs").cast("long").alias("legs"), F.size(F.flatten("legs")).cast("long").alias("n"))


@query(f"select tag_group, tag, synonym[1] as name from ({_FLAT})")
def E02_ungroup_entities(t):
    return E.ungroup_entities(E.group_entities(_flat(t))).select("tag_group", "tag", F.element_at("synonym", 1).alias("name"))


def _legs(*legs):
    return F.array(*(F.array(*(F.array(*map(F.lit, s.split())) for s in leg)) for leg in legs))


@query(rf"select item_id, list_contains(t, 'the') and (list_contains(t, 'of') or list_contains(t, 'and')) as found from (select item_id, {_TOK % 'text'} as t from benchmark)")
def E03_entity_in_text(t):
    return t.benchmark.select("item_id", E.entity_in_text(X.tokens("text"), _legs(["the"], ["of", "and"])).alias("found"))


@query(rf"select item_id, list_filter({_TOK % 'text'}, lambda x: x not in ('the', 'of')) as tokens from benchmark")
def E04_non_entity_tokens(t):
    return t.benchmark.select("item_id", E.non_entity_tokens(X.tokens("text"), _legs(["the", "of"])).alias("tokens"))
