"""The registered queries of the corpus operators and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, html_text, language_id, line_dedup, mixing, mpeg_audio, simhash, substring, toxicity, url_filter, vector_codes
from .common import only

#: (host, path, verdict) of the rules that op4 applies.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

#: The tokenizer file that op12 reads on the driver.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: str, n: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    stored = mpeg_audio.audio_digests(mpeg_audio.store_texts(docs))
    return stored.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "digest.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(crc_mod("doc_id", 4) != 2))
    return language_id.identify(only(docs, "doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(only(table(spark, sf_dir, "pages"), "page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.drop_repeated_spans(table(spark, sf_dir, "documents"), keep_text=False)
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    return toxicity.fit(only(docs, "doc_id", "text"), labels.where(crc_mod("doc_id", 3) != 1))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(only(docs, "doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_main_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(only(table(spark, sf_dir, "documents"), "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    tables = bpe.read_tokenizer(tokenizer)
    encoded = bpe.encode_texts(only(table(spark, sf_dir, "documents"), "doc_id", "text"), tables).drop("text")
    return bpe.decode_ids(encoded, tables).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.label_errors(table(spark, sf_dir, "embeddings")).drop("label")


def _vector_codes_sql() -> str:
    """All rounds written out; a part's integers are a list, a codebook is a list of lists by part."""
    parts = "unnest([1, 2, 3, 4]) as p, w"
    nearest = """select {cols}, list_min(list_transform(list_zip(range(len(c)), c), lambda e: {{'d': list_sum(list_transform(list_zip(x, e[2]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'e': e[1]}})) as best
  from x join b{k} using (p)"""
    sql = f"""with i as (select vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
s as (select *, len(v) // 4 as w, row_number() over (order by vec_id, v) as k from i),
x as (select k, vec_id, label, p, list_slice(v, (p - 1) * w + 1, p * w) as x from (select *, {parts.split(', w')[0]} from s)),
b0 as (select p, list(x order by k) as c from x where k <= 256 group by p)"""
    for k in range(4):
        sql += f""",
n{k} as ({nearest.format(cols='p, x', k=k)}),
u{k} as (select p, e, list(m order by j) as x from (select p, best.e as e, j, floor(sum(y)::hugeint / count(*))::bigint as m, sum(y) as s, count(*) as n
  from (select p, best, unnest(x) as y, unnest(range(len(x))) as j from n{k}) group by p, best.e, j) group by p, e),
b{k + 1} as (select p, list(coalesce(u{k}.x, o.x) order by o.e) as c from (select p, unnest(c) as x, unnest(range(len(c))) as e from b{k}) o left join u{k} using (p, e) group by p)"""
    sql += f""",
f as ({nearest.format(cols='p, k, vec_id, label', k=4)}),
r as (select k, vec_id, label, string_agg(lower(lpad(printf('%x', best.e), 2, '0')), '' order by p) as code, sum(best.d)::bigint as error from f group by k, vec_id, label),
h as (select sha256(string_agg(t, ',' order by p)) as h from (select p, array_to_string(list_transform(c, lambda e: array_to_string(e, ',')), ',') as t from b4))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from r, h"""
    return sql


QUERIES = {f.__name__: f for f in (
    op1_mpeg_audio, op2_simhash, op3_language_id, op4_url_filter, op5_substring_dedup, op6_toxicity, op7_decontaminate, op8_html_text, op9_mixing, op10_line_dedup,
    op11_source_divergence, op12_bpe, op13_vector_codes)}

ORACLE = {
    "op4_url_filter": r"""
with parts as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
rules(h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits as (select page_id, host, path, h || p as rule, v, row_number() over (partition by page_id, host, path order by length(h) + length(p) desc, length(h) desc) as k
  from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select parts.page_id, parts.host, parts.path, f.rule, coalesce(f.v, 'allow') as verdict
from parts left join (select distinct page_id, host, path, rule, v from fits where k = 1) f on parts.page_id is not distinct from f.page_id and parts.host = f.host and parts.path = f.path""",
    "op9_mixing": r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size, md5('mix-1:' || coalesce(doc_id::varchar, '')) as mark from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rank from d group by source),
w as (select *, ((rank - 1) % 3 + 1)::bigint as weight, 3 * source_size as cap from s),
l as (select *, coalesce(sum(cap) over f, 0) as cb, coalesce(sum(weight) over f, 0) as wb, sum(source_size) over () as total, sum(weight) over () as weights
      from w window f as (order by cap::double / weight, rank rows between unbounded preceding and 1 preceding)),
b as (select *, row_number() over (order by cap::double / weight, rank) as k, weight * (total - cb) <= cap * (weights - wb) as free from l),
c as (select min(k) as k from b where free),
t as (select b.source, b.source_size, case when b.k < x.k then b.cap::double else (b.weight * (x.total - x.cb))::double / (x.weights - x.wb)::double end as target
      from b, b x, c where x.k = c.k),
p as (select *, case when source_size > 0 then least(floor(target / source_size), 3) else 0 end::bigint as whole from t),
o as (select d.doc_id, d.size, p.source_size, p.target, p.whole, round(p.target)::bigint - p.whole * p.source_size as rest,
             coalesce(sum(d.size) over (partition by d.source order by d.mark, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
      from d join p on d.source is not distinct from p.source)
select doc_id, size::bigint as size, source_size, target, (whole * size + greatest(least(rest - before, size), 0))::bigint as taken from o""",
    "op11_source_divergence": r"""
with d as (select coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as id from documents),
t as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as w from d),
k as (select lang, w from t group by lang, w having count(distinct id) >= 30),
s as (select lang, count(*) as v from k group by lang),
c as (select lang, source, w, count(*) as n from t join k using (lang, w) group by lang, source, w),
g as (select g.lang, g.source, coalesce(s.v, 0) as v, coalesce(sum(c.n), 0) as total from (select distinct lang, source from d) g left join s on s.lang = g.lang left join c on c.lang = g.lang and c.source = g.source group by all),
a as (select lang, sum(total) as total from g group by lang),
p as (select g.lang, g.source, k.w, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v)::hugeint as p
      from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.w = k.w),
q as (select k.lang, k.w, 1 + (1000000000::hugeint * (sum(c.n) + 5)) // (any_value(a.total) + 5 * any_value(s.v))::hugeint as q
      from k join c on c.lang = k.lang and c.w = k.w join a on a.lang = k.lang join s on s.lang = k.lang group by k.lang, k.w),
pair as (select x.lang, x.source, y.source as item, coalesce(sum(abs(px.p - py.p)), 0)::bigint as value
         from g x join g y on x.lang = y.lang and x.source <> y.source left join p px on px.lang = x.lang and px.source = x.source
         left join p py on py.lang = y.lang and py.source = y.source and py.w = px.w group by x.lang, x.source, y.source),
term as (select p.lang, p.source, p.w as item, (p.p - q.q)::bigint as value from p join q on q.lang = p.lang and q.w = p.w where p.n > 0 and p.p > q.q)
select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pair
union all select * from (select lang, source, 'term' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from term) where rank <= 50""",
    "op13_vector_codes": _vector_codes_sql(),
}
