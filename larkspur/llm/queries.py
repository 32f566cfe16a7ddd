"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm import chat_format, decontaminate, language_id, line_dedup, mixing, ngram_join, quality, suffix_dedup, url_filter, vector_dedup

#: Schemas that op9 checks tool calls against.
TOOLS = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "additionalProperties": False},
    "lookup": {"type": "object", "required": ["id"], "properties": {"id": {"type": ["string", "integer"]}}},
}


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, embeddings, pages, benchmark, labels, conversations = map(_table, ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("spans", lambda x: F.concat(x["begin"], F.lit("-"), x["end"], F.when(x["removed"], "r").otherwise("")))
    return suffix_dedup.repeated_passages(documents(spark, sf_dir)).withColumn("spans", F.array_join(spans, ","))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = documents(spark, sf_dir), labels(spark, sf_dir)
    return quality.score_quality(docs, quality.learn(docs, marks.where(~language_id.held_out())))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "text")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(embeddings(spark, sf_dir), 0.98)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(documents(spark, sf_dir), width=3, percent=90)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(conversations(spark, sf_dir), TOOLS)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(pages(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("trust", "distrust")})


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_mixing, op3_quality, op4_line_dedup, op5_decontaminate, op6_language_id, op7_vector_dedup, op8_ngram_join, op9_chat_format, op10_url_filter, pipeline)
}

SQL: dict[str, str] = {}

SQL["op2_mixing"] = r"""
with d as (
  select row_number() over () as r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, md5(coalesce(text, '')))), 1, 8))::bigint as k from documents
), s as (select source, sum(size)::bigint as source_size, row_number() over (order by encode(source) nulls last) - 1 as rank from d group by source),
w as (select *, ([5, 2, 1])[(rank % 3 + 1)::int]::bigint as w, 3 * source_size as bound from s),
l as (select *, ((sum(source_size) over ())::double - coalesce(sum(bound) over (order by bound / w, rank rows between unbounded preceding and 1 preceding), 0)::double)
             / (sum(w) over (order by bound / w, rank rows between current row and unbounded following))::double as level from w),
t as (select source, rank, source_size, case when level * w <= bound
        then (select arg_min(level, (bound / w, rank)) from l where level * w <= bound) * w else bound::double end as target from l),
p as (select d.r, t.rank, d.doc_id, d.size, t.source_size, t.target, coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::double as place
      from d join t on d.source is not distinct from t.source),
c as (select r, p.doc_id, rank, place, size, e, least((e * source_size + place) / greatest(target, 1), 1) as share from p, range(3) x(e) where e * source_size + place + size / 2 < target),
g(rank3, t, area, w, half) as (values (0, 0, 0, 1, 0), (1, 0, 0, 0.5, 0.5), (1, 0.5, 0.375, 1, 0.5), (2, 0, 0, 1.5, -0.5), (2, 0.5, 0.625, 1, -0.5)),
i as (select c.*, t::double as t, share - area::double as left_, w::double as w, half::double as half from c join g on rank % 3 = rank3 and area::double <= share
      qualify row_number() over (partition by r, e order by area desc) = 1),
o as (select *, t + 2 * left_ / (w + sqrt(w * w + 4 * half * left_)) as position from i),
n as (select *, row_number() over (order by position, doc_id nulls first, e, rank, place, size, r) - 1 as number from o),
m as (select r, min(position) as position, string_agg(number::varchar, ',' order by number) as mix_rows from n group by r)
select doc_id, size, source_size, target,
       (size * ((place + size / 2 < target)::int + (source_size + place + size / 2 < target)::int + (2 * source_size + place + size / 2 < target)::int))::bigint as taken,
       position, coalesce(mix_rows, '') as mix_rows from p left join m using (r)
"""

SQL["op1_suffix_dedup"] = r"""
with d as (
  select row_number() over () as r, doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), t as (select text, row_number() over () as tid, any_value(w) as w, min(doc_id) as first, max(doc_id) as last from d where len(w) >= 50 group by text
), g as (select tid, first, unnest(range(0, len(w) - 49)) as p, w from t
), k as (select tid, first, p, md5(array_to_string(w[p + 1 : p + 50], ' ')) as g from g
), m as (select k.tid, k.p, s.first < k.first as late from k join (select g, min(first) as first from k group by g having count(distinct tid) > 1) s using (g)
), o as (select tid, p, late, coalesce(p - lag(p) over (partition by tid, late order by p) > 50, true)::int as opens from (select distinct * from m)
), i as (select tid, late, p, sum(opens) over (partition by tid, late order by p) as i from o
), x as (select tid, late, min(p) as b, max(p) + 50 as e from i group by tid, late, i
), y as (select tid, string_agg(b || '-' || e || case when late then 'r' else '' end, ',' order by late, b) as spans, string_agg(b || '-' || e || 'r', ',' order by b) filter (late) as late_spans from x group by tid
), q as (select tid, unnest(range(p, p + 50)) as q, late from m
), c as (select tid, count(distinct q) as n, count(distinct q) filter (late) as nl from q group by tid
), z as (select d.doc_id, len(d.w)::bigint as n_words, t.first, t.last, coalesce(c.n, 0) as n, coalesce(c.nl, 0) as nl, coalesce(y.spans, '') as spans, coalesce(y.late_spans, '') as late_spans
         from d left join t using (text) left join c using (tid) left join y using (tid))
select doc_id, n_words, case when first = last or first is null then n else n_words end::bigint as n_repeated, case when first = last or first is null or first = doc_id then nl else n_words end::bigint as n_removed,
       case when first = last or first is null then spans when first <> doc_id then '0-' || n_words || 'r' else concat_ws(',', '0-' || n_words, nullif(late_spans, '')) end as spans from z
"""

SQL["op5_decontaminate"] = r"""
with norm(s) as (select 1), d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), n as (select item_id, least(10, len(w))::bigint as size, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p, w from i where len(w) > 0
), g as (select distinct item_id, size, array_to_string(w[p : p + size - 1], ' ') as gram from n
), m as (select d.r, s.size, unnest(range(1, len(w) - s.size + 2)) as p, w from d, (select distinct size from g) s where len(w) >= s.size
), h as (select m.r, m.p, m.size, g.item_id from m join g on g.size = m.size and g.gram = array_to_string(m.w[m.p : m.p + m.size - 1], ' ')
), x as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + size)) as q from h) group by r
), y as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from h group by r)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join x using (r) left join y using (r)
"""

SQL["op7_vector_dedup"] = """
with recursive v as (select row_number() over () as r, vec_id, embedding::double[] as e, label from embeddings),
good as (select r, vec_id, e, label, sqrt(list_dot_product(e, e)) as n from v where label is not null and e is not null and len(e) > 0
         and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_dot_product(e, e) > 0),
l as (select a.r as a, b.r as b, b.vec_id from good a join good b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
c as (select r as a, r as b from v union select c.a, l.b from c join l on c.b = l.a),
m as (select c.a, min(v.vec_id) as component_id from c join v on v.r = c.b group by c.a)
select v.vec_id, (select count(*) from l where l.a = v.r)::bigint as n_links, m.component_id, coalesce(v.vec_id = m.component_id, false) as kept from v join m on m.a = v.r
"""

SQL["op8_ngram_join"] = r"""
with recursive d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (select r, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from d
), k as (select r, len(g) as n, list_sort(g) as g from s
), t as (select g, min(r) as r, any_value(n) as n from k where n > 0 group by g
), e as (select r, n, unnest(g) as x from t
), f as (select x, count(*) as c from e group by x having count(*) > 1
), o as (select a.r as a, b.r as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from (e semi join f using (x)) a join (e semi join f using (x)) b on a.x = b.x and a.r < b.r and 10 * a.n >= 9 * b.n and 10 * b.n >= 9 * a.n group by 1, 2
), l as (select a, b from o where 100 * c >= 90 * (na + nb - c)), u as (select a, b from l union all select b, a from l
), c as (select r as a, r as b from t union select c.a, u.b from c join u on c.b = u.a
), q as (select k.r, t.r as rep from k join t on k.g = t.g), z as (select c.a, min(d.doc_id) as component_id from c join q on q.rep = c.b join d on d.r = q.r group by c.a)
select d.doc_id, k.n::bigint as n_shingles, coalesce(z.component_id, d.doc_id) as component_id from d join k using (r) left join q using (r) left join z on z.a = q.rep
"""

_LINK = r"""(?i)href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)"""
_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL["op10_url_filter"] = rf"""
with recursive p as (
  select row_number() over () as r, page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_ASCII}) as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages
), k as (select *, case when ('.' || host) like '%.example.net' and path like '/en/%' then 'example.net/en/' when ('.' || host) like '%.example.com' and path like '/de/%' then 'example.com/de/'
          when ('.' || host) like '%.org' and path like '/fr/%' then 'org/fr/' when ('.' || host) like '%.net' and path like '/%' then 'net/' end as rule from p
), v as (select *, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' end as ruled from k
), l as (select distinct host as a, translate(b, {_ASCII}) as b from (select host, unnest(regexp_extract_all(html, '{_LINK}', 1)) as b from v where host <> '') where host <> translate(b, {_ASCII})
), e as (select 'trust' as way, a, b from l union all select 'distrust', b, a from l
), d as (select way, a, b, count(*) over (partition by way, a) as d from e
), h as (select host, avg(coalesce(ruled = 'allow', false)::int) as trust, avg(coalesce(ruled = 'block', false)::int) as distrust from v where host <> '' group by host
), s as (select 'trust' as way, host, trust / (select sum(trust) from h) as mass from h where trust > 0 union all select 'distrust', host, distrust / (select sum(distrust) from h) from h where distrust > 0
), t as (select 0 as i, way, host, 0.15::double * mass as mass from s union all select t.i + 1, d.way, d.b, 0.85::double * sum(t.mass / d.d) from t join d on d.way = t.way and d.a = t.host where t.i < 150 group by t.i + 1, d.way, d.b
), m as (select host, coalesce(sum(mass) filter (way = 'trust'), 0) as trust, coalesce(sum(mass) filter (way = 'distrust'), 0) as distrust from t group by host)
select page_id, v.host, path, rule, coalesce(ruled, case when distrust > 0.5 * (trust + distrust) then 'block' else 'allow' end) as verdict, round(coalesce(trust, 0), 6) as trust, round(coalesce(distrust, 0), 6) as distrust
from v left join m using (host)
"""
