"""Queries over text, identity and pay functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, pay, spans, text
from ..operators import evidence
from .registry import query, table
from .views import cte, view

_SUFFIX = ", ".join(f"'{w}'" for w in text.COMPANY_SUFFIXES)
_EVIDENCE = ", ".join(f"'{w}'" for w in text.EVIDENCE_SUFFIXES)
_STOP = ", ".join(f"'{w}'" for w in text.TITLE_STOP)
_NOISE = "|".join(text.TITLE_NOISE)

#: DuckDB macros of the functions below.
COMPANY_SQL = f"""(CASE WHEN len(list_filter(string_split_regex(regexp_replace(lower(company), '[^a-z0-9 ]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ({_SUFFIX}))) > 0
  THEN array_to_string(list_filter(string_split_regex(regexp_replace(lower(company), '[^a-z0-9 ]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ({_SUFFIX})), ' ')
  ELSE trim(regexp_replace(lower(company), '[^a-z0-9 ]', ' ', 'g')) END)"""
LOOSE_SQL = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '\(.*?\)', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\b({_NOISE})\b', ' ', 'g'), '[ \t]+', ' ', 'g'))"
STRICT_SQL = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), '\b({_NOISE})\b', ' ', 'g'), '[ \t]+', ' ', 'g'))"


@query(
    cte("postings")
    + f"""
SELECT doc_id, {COMPANY_SQL} AS company_key,
  array_to_string(list_filter(string_split_regex(regexp_replace(lower(company), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ({_EVIDENCE})), ' ') AS evidence_key,
  {LOOSE_SQL} AS title_loose, {STRICT_SQL} AS title_strict
FROM postings"""
)
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "postings")
    return p.select(
        "doc_id", text.company_key(F.col("company")).alias("company_key"), text.evidence_key(F.col("company")).alias("evidence_key"),
        text.title_key(F.col("title")).alias("title_loose"), text.title_key(F.col("title"), strict=True).alias("title_strict"),
    )


_ATS = ", ".join(f"'{s}'" for s in identity.ATS_SOURCES)
_HASH = "substr(sha256({}), 1, 20)"
#: Group key and uid of named companies.
IDENTITY_SQL = f"""SELECT *, {_HASH.format("ckey || '|' || loose")} AS group_key,
  {_HASH.format(f"ckey || '|' || strict || CASE WHEN source IN ({_ATS}) THEN '|' || external_id ELSE '|aggregator:' || disc END")} AS uid
FROM (SELECT *, {COMPANY_SQL} AS ckey, {LOOSE_SQL} AS loose, {STRICT_SQL} AS strict,
  {_HASH.format("CAST(length(source) AS VARCHAR) || ':' || source || '|' || CAST(length(external_id) AS VARCHAR) || ':' || external_id")} AS disc FROM postings)"""


@query(cte("postings") + f" SELECT doc_id, group_key, uid FROM ({IDENTITY_SQL})")
def opening_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "postings")
    key = [F.col(c) for c in ("company", "title", "source", "url", "external_id")]
    return p.select("doc_id", identity.group_key(*key).alias("group_key"), identity.opening_uid(*key).alias("uid"))


@query(r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host,
  regexp_extract(url, '^https?://[^/?#]*(/[^?#]*)?', 1) AS path, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query FROM pages)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || query AS identity_url,
  host || path AS host_path, (host = 'example.com' OR ends_with(host, '.example.com')) AND (path = '/en' OR starts_with(path, '/en/')) AS on_site
FROM p""")
def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^https?://[^/?#]*(/[^?#]*)?", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", identity.identity_url(url).alias("identity_url"), F.concat(host, path).alias("host_path"), identity.site_operand(url, "example.com/en").alias("on_site")
    )


@query(r"""
WITH u AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://boards.greenhouse.io/acme' || page_id || '/jobs/7' WHEN 1 THEN 'https://jobs.lever.co/globex' || page_id
  WHEN 2 THEN 'https://acme' || page_id || '.recruitee.com/o/x' WHEN 3 THEN 'https://hooli.wd5.myworkdayjobs.com/en-US/site' || page_id || '/job/1'
  WHEN 4 THEN 'https://evil.example/?u=https://jobs.lever.co/a' WHEN 5 THEN 'https://apply.workable.com/w' || page_id || '/j/1' WHEN 6 THEN 'https://x' || page_id || '.bamboohr.com/careers' ELSE url END AS url FROM pages)
SELECT page_id,
  CASE WHEN url LIKE 'https://boards.greenhouse.io/%' THEN 'greenhouse' WHEN url LIKE 'https://jobs.lever.co/%' THEN 'lever' WHEN regexp_matches(url, '^https://[^/]*\.recruitee\.com/') THEN 'recruitee'
    WHEN regexp_matches(url, '^https://[^/]*\.myworkdayjobs\.com/') THEN 'workday' WHEN url LIKE 'https://apply.workable.com/%' THEN 'workable' WHEN regexp_matches(url, '^https://[^/]*\.bamboohr\.com/') THEN 'bamboohr' END AS platform,
  CASE WHEN url LIKE 'https://boards.greenhouse.io/%' OR url LIKE 'https://jobs.lever.co/%' OR url LIKE 'https://apply.workable.com/%' THEN regexp_extract(url, '^https://[^/]*/([^/]+)', 1)
    WHEN regexp_matches(url, '^https://[^/]*\.(recruitee|bamboohr)\.com/') THEN regexp_extract(url, '^https://([a-z0-9-]+)\.', 1)
    WHEN regexp_matches(url, '^https://[^/]*\.myworkdayjobs\.com/') THEN 'hooli/' || regexp_extract(url, '/en-US/([^/]+)', 1) END AS address
FROM u""")
def url_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    k = F.col("page_id") % 8
    made = (
        F.when(k == 0, F.concat(F.lit("https://boards.greenhouse.io/acme"), n, F.lit("/jobs/7")))
        .when(k == 1, F.concat(F.lit("https://jobs.lever.co/globex"), n))
        .when(k == 2, F.concat(F.lit("https://acme"), n, F.lit(".recruitee.com/o/x")))
        .when(k == 3, F.concat(F.lit("https://hooli.wd5.myworkdayjobs.com/en-US/site"), n, F.lit("/job/1")))
        .when(k == 4, F.lit("https://evil.example/?u=https://jobs.lever.co/a"))
        .when(k == 5, F.concat(F.lit("https://apply.workable.com/w"), n, F.lit("/j/1")))
        .when(k == 6, F.concat(F.lit("https://x"), n, F.lit(".bamboohr.com/careers")))
        .otherwise(F.col("url"))
    )
    found = table(spark, sf_dir, "pages").select("page_id", identity.url_platform(made).alias("hit"))
    return found.select("page_id", "hit.platform", "hit.address")


@query(r"""
SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    replace(replace(replace(replace(replace(replace(
      replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '&lt;', '<'), '&quot;', '"'), '&amp;', '&'),
      '</p>', chr(10)), '<br>', chr(10)), '<br/>', chr(10)), '<br />', chr(10)), '</li>', chr(10)), '<li>', ' - '),
    '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages)""")
def stripped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


_SPAN = r"[Tt]h[a-z]+tion"


@query(rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{_SPAN}') AS m, string_split_regex(text, '{_SPAN}') AS g FROM documents),
s AS (SELECT doc_id, text, unnest(generate_series(1, len(m))) AS i, m, g FROM d WHERE len(m) > 0)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS n,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start,
  m[i] AS match FROM s""")
def pattern_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(spans.spans(F.col("text"), _SPAN)).alias("n", "s"))
    return found.select("doc_id", "n", F.col("s.start").alias("start"), F.col("s.match").alias("match"))


@query(r"""
WITH d AS (SELECT doc_id, text, regexp_extract(text, '(?i)[a-z]*tionre') AS m, strpos(text, regexp_extract(text, '(?i)[a-z]*tionre')) AS p FROM documents),
h AS (SELECT doc_id, text, m, substr(text, 1, p - 1) AS head, substr(text, p + length(m)) AS rest FROM d WHERE m <> '')
SELECT doc_id, m AS match, trim(regexp_replace(regexp_extract(head, '[^.\n!?;]*$'), '\s+', ' ', 'g')) AS clause,
  substr(trim(regexp_replace(regexp_extract(head, '[^.\n!?]*$') || m || regexp_extract(rest, '^[^.\n]*[.\n]?'), '\s+', ' ', 'g')), 1, 180) AS sentence
FROM h""")
def match_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("text")
    d = table(spark, sf_dir, "documents").filter(body.rlike("(?i)[a-z]*tionre")).withColumn("s", F.get(spans.spans(body, "(?i)[a-z]*tionre"), F.lit(0)))
    s = F.col("s")
    return d.select("doc_id", F.col("s.match").alias("match"), spans.clause_before(body, s).alias("clause"), spans.sentence_around(body, s).alias("sentence"))


@query(cte("postings") + r"""
, t AS (SELECT doc_id, 'Base salary: $' || CAST(60 + doc_id % 90 AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN ',000 to $' || CAST(160 + doc_id % 40 AS VARCHAR) || ',000' WHEN 1 THEN 'k' WHEN 2 THEN ' per hour' ELSE ' bonus' END AS pay, doc_id % 4 AS k, 60 + doc_id % 90 AS a, 160 + doc_id % 40 AS b FROM postings)
SELECT doc_id, CAST(CASE k WHEN 0 THEN a * 1000 WHEN 1 THEN a * 1000 WHEN 2 THEN a * 2080 END AS BIGINT) AS lo, CAST(CASE k WHEN 0 THEN b * 1000 END AS BIGINT) AS hi,
  CASE WHEN k = 3 THEN 'absent' ELSE 'body' END AS source FROM t""")
def pay_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    a, b, k = (60 + n % 90).cast("string"), (160 + n % 40).cast("string"), n % 4
    tail = F.when(k == 0, F.concat(F.lit(",000 to $"), b, F.lit(",000"))).when(k == 1, "k").when(k == 2, " per hour").otherwise(" bonus")
    p = view(spark, sf_dir, "postings").withColumn("pay", F.concat(F.lit("Base salary: $"), a, tail))
    null = F.lit(None).cast("long")
    band = pay.extract_band(null, null, F.lit(""), F.col("pay"), F.lit(""))
    return p.select("doc_id", band.alias("band")).select("doc_id", "band.lo", "band.hi", "band.source")


@query(cte("postings") + r"""
SELECT doc_id,
  CASE WHEN comp_min IS NULL AND comp_max IS NULL THEN 'not stated' ELSE
   CASE WHEN comp_min IS NOT NULL AND comp_max IS NOT NULL THEN CASE WHEN comp_min = comp_max THEN '$' || (comp_min // 1000) || 'k' ELSE '$' || (comp_min // 1000) || 'k-$' || (comp_max // 1000) || 'k' END
        WHEN comp_min IS NOT NULL THEN '$' || (comp_min // 1000) || 'k+' ELSE 'up to $' || (comp_max // 1000) || 'k' END
   || CASE comp_source WHEN 'unknown' THEN ' (source unknown)' ELSE '' END END AS shown,
  CAST((CASE WHEN NOT ats AND looked AND coalesce(url_direct, '') = '' THEN 2 ELSE 0 END) + (CASE WHEN NOT ats AND looked AND coalesce(company_site, '') = '' THEN 2 ELSE 0 END)
   + (CASE WHEN comp_min % 2080 = 0 AND comp_max % 2080 = 0 AND comp_min >= 100000 THEN 3 ELSE 0 END) AS INTEGER) AS ghost_points
FROM (SELECT *, source IN ('greenhouse', 'lever', 'workday') AS ats, url_direct IS NOT NULL OR company_site IS NOT NULL AS looked FROM postings)""")
def ghost_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "postings")
    points = pay.ghost_points(identity.is_ats(F.col("source")), F.col("url_direct"), F.col("company_site"), F.col("comp_min"), F.col("comp_max"), F.lit(""))
    return p.select("doc_id", pay.show_band(F.col("comp_min"), F.col("comp_max"), F.col("comp_source")).alias("shown"), points.alias("ghost_points"))


@query(rf"""
WITH t AS (SELECT p_partkey, p_brand, list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), lambda w: w NOT IN ({_STOP}))) AS w FROM part)
SELECT a.p_partkey AS left_key, b.p_partkey AS right_key, CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))) AS overlap
FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
WHERE CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))) >= 0.6""")
def title_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("key"), text.title_tokens(F.concat_ws(" ", "p_name", "p_type")).alias("words"))
    return evidence.title_overlaps(t, "p_partkey", 0.6)


@query(r"""
SELECT c_custkey, list_filter(list_distinct_ordered, lambda s: length(s) >= 2) AS slugs FROM (
  SELECT c_custkey, CASE WHEN len(w) > 2 THEN CASE WHEN len(w) = 1 THEN [j] ELSE [j, h, i] END WHEN len(w) = 1 THEN [j] ELSE [j, h] END AS list_distinct_ordered FROM (
    SELECT c_custkey, w, array_to_string(w, '') AS j, array_to_string(w, '-') AS h, array_to_string(list_transform(w, lambda x: x[1]), '') AS i FROM (
      SELECT c_custkey, string_split(regexp_replace(lower(c_name || ' ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' Labs' ELSE '' END), '[^a-z0-9]+', ' ', 'g'), ' ') AS w0,
        list_filter(w0, lambda x: x <> '' AND x NOT IN ('labs', 'co', 'group')) AS w FROM customer)))""")
def slug_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("c_name"), F.lit(" "), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, " Labs").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", text.slug_candidates(name).alias("slugs"))


@query(r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^\s*[=+\-@]') THEN '''' || t ELSE t END AS cell, length(regexp_replace(trim(regexp_replace(t, '[\s]+', ' ', 'g')), ' +', ' ', 'g')) AS n_flat
FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '=' || role ELSE role || ' says  hi' END AS t FROM conversations)""")
def spreadsheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("="), F.col("role"))).otherwise(F.concat(F.col("role"), F.lit(" says  hi")))
    c = table(spark, sf_dir, "conversations").withColumn("t", t)
    return c.select("conv_id", "turn", text.formula_guard(F.col("t")).alias("cell"), F.length(text.sanitize(F.col("t"))).cast("long").alias("n_flat"))
