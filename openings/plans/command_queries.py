"""Queries over rails in context and over commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commands, rails
from ..operators.screen import compile_terms
from .registry import query, table
from .screen_queries import demanded, quote, undenied
from .views import cte, view


@query(cte("postings") + f""", t AS (SELECT doc_id, description AS whole FROM postings),
m AS (SELECT doc_id, whole, {undenied('whole', rails.QUOTA)} AS q, {undenied('whole', rails.CLEARANCE)} AS c FROM t)
SELECT doc_id, CASE WHEN q IS NOT NULL THEN 'quota' WHEN c IS NOT NULL THEN 'clearance' END AS rail, CASE WHEN q IS NOT NULL THEN {quote('whole', 'q', rails.QUOTA)} WHEN c IS NOT NULL THEN {quote('whole', 'c', rails.CLEARANCE)} END AS quote FROM m""")
def denied_rails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rails.denied_rails(view(spark, sf_dir, "postings"), {"quota": rails.QUOTA, "clearance": rails.CLEARANCE}).select("doc_id", "rail", "quote")


@query(cte("postings") + f""" SELECT doc_id, len({demanded('description', 'cpq')}) > 0 AS demanded FROM postings""")
def required_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "postings").select("doc_id", rails.requires_product(F.col("description"), compile_terms(["cpq"])).isNotNull().alias("demanded"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS deadline FROM orders")
def posting_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, day = F.col("o_orderkey") % 4, F.to_date("o_orderdate")
    said = (
        F.when(n == 0, F.concat(F.lit("Starts 2001-01-01. Apply by "), F.date_format(day, "MMMM d, yyyy"), F.lit(". Application deadline: 2099-01-01")))
        .when(n == 1, F.concat(F.lit("Posting closes on "), F.date_format(day, "M/d/yyyy"), F.lit(".")))
        .when(n == 2, F.concat(F.lit("applications accepted until "), F.date_format(day, "yyyy-MM-dd")))
        .otherwise(F.concat(F.lit("Benefits start "), F.date_format(day, "yyyy-MM-dd")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", rails.deadline(said).alias("deadline"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Page ' || page_id || chr(10) || 'does & more' ELSE '' END AS description FROM pages""")
def jsonld_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    script = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<script type="application/ld+json">[{"@type":"Organization"},{"@type":"JobPosting","description":"<p>Page '), n, F.lit('</p>does &amp; more"}]</script>'))).when(F.col("page_id") % 3 == 1, F.lit('<script type="application/ld+json">{broken</script>')).otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", rails.jsonld_description(F.concat(script, "html")).alias("description"))


@query(cte("app_events") + """, d AS (SELECT *, row_number() OVER (PARTITION BY uid, stage, day ORDER BY event_id) AS n FROM app_events WHERE stage IS NOT NULL)
SELECT uid, arg_max(stage, (ts, event_id)) AS stage, CASE arg_max(stage, (ts, event_id)) WHEN 'rejected' THEN 'rejected' ELSE 'applied' END AS status FROM d WHERE n = 1 GROUP BY uid""")
def recorded_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "app_events").select("uid", "stage", F.col("ts").alias("at"), F.lit("").alias("detail"), F.col("event_id").alias("ord"))
    return commands.record_stages(e)[1]


@query(cte("openings") + """, m AS (SELECT event_id AS ord, CAST(event_id * 3 AS BIGINT) AS uid, CASE event_id % 6 WHEN 0 THEN 'applied' WHEN 1 THEN 'ignored' WHEN 2 THEN 'apllied' WHEN 3 THEN 'rejected' WHEN 4 THEN 'new' ELSE 'reviewed' END AS status FROM events)
SELECT o.uid, 'status:' || m.status AS kind FROM m JOIN openings o USING (uid) WHERE m.status <> 'apllied' AND m.status <> o.status""")
def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "openings").select("uid", "status", F.lit("").alias("notes"))
    marks = table(spark, sf_dir, "events").selectExpr(
        "event_id AS ord", "event_id * 3 AS uid", "CASE event_id % 6 WHEN 0 THEN 'applied' WHEN 1 THEN 'ignored' WHEN 2 THEN 'apllied' WHEN 3 THEN 'rejected' WHEN 4 THEN 'new' ELSE 'reviewed' END AS status", "'' AS notes", "ts AS at"
    )
    return commands.set_statuses(o, marks)[1].select("uid", "kind")


@query("""WITH l AS (SELECT p_partkey AS uid, p_brand AS group_key, p_type AS url FROM part WHERE p_size = 7), b AS (SELECT p_partkey AS uid, p_brand AS group_key, p_type AS url FROM part WHERE p_size > 40)
SELECT old_uid, new_uid FROM (SELECT l.uid AS old_uid, b.uid AS new_uid, row_number() OVER (PARTITION BY l.uid ORDER BY CASE WHEN l.url = b.url THEN 0 ELSE 1 END, b.uid) AS n FROM l JOIN b USING (group_key)) WHERE n = 1""")
def legacy_adoptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), F.col("p_brand").alias("group_key"), F.col("p_type").alias("url"), "p_size", F.col("p_partkey").alias("ord"))
    return commands.adopt_legacy(p.filter("p_size = 7"), p.filter("p_size > 40"))


@query("""WITH h AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN upper('src' || s_suppkey) ELSE 'src' || s_suppkey END AS source, s_nationkey AS n FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT 'src' || s_suppkey AS stable, CAST(coalesce((SELECT max(n) FROM h WHERE source = 'src' || s_suppkey), (SELECT max(n) FROM h WHERE source = 'src' || (s_suppkey + 1)), (SELECT max(n) FROM h WHERE lower(source) = 'src' || s_suppkey), (SELECT max(n) FROM h WHERE lower(source) = 'src' || (s_suppkey + 1))) AS BIGINT) AS last_count FROM supplier""")
def health_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("src"), F.col("s_suppkey").cast("string"))
    h = s.filter("s_suppkey % 7 <> 0").select(F.when(F.col("s_suppkey") % 3 == 0, F.upper(name)).otherwise(name).alias("source"), F.col("s_nationkey").cast("long").alias("last_count"))
    return commands.health_of(s.select(name.alias("stable"), F.concat(F.lit("src"), (F.col("s_suppkey") + 1).cast("string")).alias("legacy")), h)


_KINDS = {0: ("lanes", "lane"), 3: ("titel_block", "title_block"), 6: ("sgnal", "signal"), 9: ("zzz", None)}


@query(f"""WITH p AS (SELECT p_partkey AS ord, CASE p_partkey % 12 {' '.join(f"WHEN {n} THEN {chr(39) + h + chr(39) if h else 'NULL'}" for n, (_, h) in _KINDS.items())} END AS hint FROM part)
SELECT ord, 'unknown kind' AS problem, hint FROM p WHERE ord % 3 = 0 UNION ALL SELECT ord, 'blank pattern', NULL FROM p WHERE ord % 5 = 0 UNION ALL SELECT ord, 'bad weight', NULL FROM p WHERE ord % 4 = 0""")
def profile_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.coalesce(*[F.when(k % 12 == n, name) for n, (name, _) in _KINDS.items()], F.lit("lane"))
    r = table(spark, sf_dir, "part").select(k.alias("ord"), kind.alias("kind"), F.when(k % 5 == 0, " ").otherwise(F.col("p_name")).alias("pattern"), F.when(k % 4 == 0, F.concat(F.lit("1"), k.cast("string"), F.lit("00"))).otherwise("50").alias("weight"))
    return commands.profile_violations(r, ["lane", "signal", "title_block"])


@query("""SELECT doc_id, NOT (doc_id % 3 = 0) AND length(text) <= 5900 AS needed FROM (SELECT doc_id, text FROM documents)""")
def fetches_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    body = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "\nRequirements:\n- x").otherwise(F.lpad(F.lit(""), 100, "x")))
    return d.select("doc_id", rails.fetch_needed(body).alias("needed"))
