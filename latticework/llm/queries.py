"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html_extract, langid, mixing, neardup, packing, pii, quality, substring_dedup, url_filter
from .common import UPPER, table

#: Canonical URLs that the registered query lists: sites whose names say what they are.
LISTED = tuple(f"{name}.example.{end}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), listed).drop("url")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(_held_out(), F.lit(False)))
    model = langid.fit(docs.where("not held_out"))
    return langid.identify(docs.drop("lang"), model).drop("text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    # rounded: logarithms differ in the last place between engines
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def queries() -> dict:
    own = [op1_substring_dedup, op2_mixing, op3_ann, op4_pii, op5_url_filter, op6_near_duplicates, op7_html_extract, op8_language_id, op9_packing, op10_quality]
    return {f.__name__: f for f in own}


_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "op1_substring_dedup": f"""
with d as (select doc_id, {_WORDS.format("text")} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
least_doc as (select k, min(doc_id) as m from win group by k),
gone as (select distinct doc_id, i + o as p from (select doc_id, i, unnest(range(0, 50)) as o from win join least_doc using (k) where m < doc_id)),
each_word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, string_agg(x, ' ' order by p) as t from each_word anti join gone using (doc_id, p) group by doc_id),
n as (select doc_id, count(*) as n from gone group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join n using (doc_id) left join kept using (doc_id)""",
    "op3_ann": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where embedding is not null),
u as (select vec_id, e, list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b) as s from v),
c as (select q.vec_id as query_id, u.vec_id, list_reduce(list_transform(list_zip(u.e, q.e), lambda x: x[1] * x[2]), lambda a, b: a + b) / sqrt(q.s) / sqrt(u.s) as score from u q join u on q.vec_id <> u.vec_id where q.vec_id % 50 = 0 and q.s > 0 and u.s > 0)
select query_id, cast(r as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from c) where r <= 5""",
    "op5_url_filter": f"""
with t as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as t from pages),
b as (select page_id, regexp_extract(coalesce(t, ''), '^([^?#]*)', 1) as b from t),
h as (select page_id, regexp_extract(b, '^([^/]*)', 1) as h, b from b),
p as (select page_id, translate(h, '{UPPER}', '{UPPER.lower()}') as host, substr(b, length(h) + 1) as path from h),
l as (select unnest({[u[:-1] for u in LISTED]!r}) as l),
r as (select *, case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/' when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/' when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/' when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule from p),
c as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') as bare from r where rule is null),
hit as (select distinct page_id, l from c join l on (bare = l or ends_with(bare, '.' || l)) and starts_with(path, '/'))
select page_id, host, path, rule, l || '/' as listed, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null or l is not null then 'block' else 'allow' end as verdict from r left join hit using (page_id)""",
    "op6_near_duplicates": f"""
with recursive d as (select doc_id, {_WORDS.format(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} as w from documents),
s as (select distinct doc_id, k from (select doc_id, array_to_string(w[i:i + 4], ' ') as k from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from d where len(w) > 0))),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 75 * (x.n + y.n - c)),
both_ways as (select a, b from l union all select b, a from l),
r as (select doc_id as d, doc_id as m from d union select b, m from r join both_ways on a = d),
m as (select d as doc_id, min(m) as component_id from r group by d)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, doc_id = component_id as kept from d left join n using (doc_id) join m using (doc_id)""",
}


def _quality_sql() -> str:
    """Base counts, histograms, references and distances, in long form: a row for each document and bin."""
    vocabulary = sorted({w for own in quality.COMMON_WORDS.values() for w in own})
    quoted = lambda c: "'" + c.replace("'", "''") + "'"
    number = lambda c: f"(length(t) - length(regexp_replace(t, {quoted(c)}, '', 'g')))"
    classes = [f"(length(t) - {' - '.join(map(number, quality.CLASSES))})", *map(number, quality.CLASSES)]
    space = quality.CLASSES[2]
    return f"""
with d as (select doc_id, coalesce('l' || lang, '') as lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') as p from documents),
win as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
twice as (select doc_id, k from win group by 1, 2 having count(*) > 1),
rep as (select doc_id, count(distinct i + o) as n from (select doc_id, i, unnest(range(0, 5)) as o from win join twice using (doc_id, k)) group by 1),
b as (select doc_id, lang, cast(len(w) as bigint) as n_words, cast(length(t) - {number(space)} as bigint) as word_chars, cast({number(quality.SYMBOLS)} as bigint) as n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
h as (select doc_id, lang, 'c' as kind, unnest(range(0, {len(classes)})) as bin, unnest([{', '.join(f'cast({c} as double)' for c in classes)}]) as n from d
  union all select doc_id, lang, 'w', unnest(range(0, {len(vocabulary) + 1})), unnest(list_append(list_transform({vocabulary!r}, lambda v: cast(len(list_filter(p, lambda x: x = v)) as double)), cast(len(list_filter(p, lambda x: not list_contains({vocabulary!r}, x))) as double))) from d),
r as (select lang, kind, bin, sum(n) as n from h where lang <> '' group by all union all select '', kind, bin, sum(n) from h group by all),
f as (select h.doc_id, h.kind, h.n as a, sum(h.n) over (partition by h.doc_id, h.kind) as sa, r.n as c, sum(r.n) over (partition by h.doc_id, h.kind) as sc from h join r using (lang, kind, bin)),
g as (select doc_id, kind, sa, sc, case when sa > 0 then a / sa end as p, case when sc > 0 then c / sc end as q from f),
j as (select doc_id, kind, any_value(sa) as sa, any_value(sc) as sc, sqrt(greatest(0.0, sum((case when p > 0 then p * log2(2 * p / (p + q)) else 0.0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0.0 end) / 2))) as js from g group by 1, 2),
x as (select b.*, case when c.sa >= {quality.LEAST_CHARS} and c.sc > 0 then c.js end as class_far, case when v.sa >= {quality.LEAST_WORDS} and v.sc > 0 then v.js end as word_far, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words from b join j c on c.doc_id = b.doc_id and c.kind = 'c' join j v on v.doc_id = b.doc_id and v.kind = 'w' left join rep on rep.doc_id = b.doc_id),
y as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from x)
select doc_id, n_words, word_chars, n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, n_repeat_words, base_failed, round(class_far, 6) as class_distance, round(word_far, 6) as word_distance, not base_failed and coalesce(class_far <= {quality.CLASS_DISTANCE}, true) and coalesce(word_far <= {quality.WORD_DISTANCE}, true) as kept from y"""


def oracle_sql() -> dict[str, str]:
    return {**SQL, "op10_quality": _quality_sql()}
