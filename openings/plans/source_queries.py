"""Queries over payload parsing: payloads are built from the tables, one a board, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import integrity, payloads
from .registry import query, table
from .views import cte, view


PAGE = 50


def _landed(items: DataFrame, source: str, board: str, item: str, body: str, order: str) -> DataFrame:
    """raw_payloads with pages of at most PAGE items a board, whatever the table's size: `item` is one item's struct, `body` the whole body over `items`."""
    page = F.expr(f"CAST(({order}) div {PAGE} AS INT)").alias("page_no")
    made = items.groupBy(F.expr(board).alias("board"), page).agg(F.array_sort(F.collect_list(F.struct(F.expr(order).alias("o"), F.expr(item).alias("v")))).alias("x"))
    made = made.withColumn("items", F.transform("x", lambda x: x["v"]))
    return made.select(F.lit(source).alias("source"), "board", "page_no", F.expr(body).alias("body"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS external_id, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN 'Austin; Berlin' ELSE 'Denver' END AS location, p_type AS department,
 CASE WHEN p_partkey % 9 = 0 THEN 'item' END AS reject, 'About ' || p_name || chr(10) || 'Now & then' AS description FROM part""")
def parsed_greenhouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _landed(
        table(spark, sf_dir, "part"), "greenhouse", "p_brand",
        """named_struct('id', p_partkey, 'title', CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END, 'absolute_url', concat('https://x.example.com/', p_partkey), 'content', concat('&lt;p&gt;About ', p_name, '&lt;/p&gt;Now &amp;amp; then'),
           'location', named_struct('name', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'Denver' END), 'offices', array(named_struct('name', 'Austin'), named_struct('name', 'Berlin')), 'departments', array(named_struct('name', p_type)))""",
        "to_json(named_struct('jobs', items, 'meta', named_struct('total', size(items))))", "p_partkey",
    )
    return payloads.parse(raw, payloads.SPECS["greenhouse"]).select("external_id", "title", "location", "department", "reject", "description")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS external_id, p_name AS title, CASE p_size % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE END AS remote_flag, p_type || chr(10) || 'You' || chr(10) || 'bring ' || p_brand AS description FROM part""")
def parsed_lever(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _landed(
        table(spark, sf_dir, "part"), "lever", "p_brand",
        "named_struct('id', CAST(p_partkey AS STRING), 'text', p_name, 'description', p_type, 'lists', array(named_struct('text', 'You', 'content', concat('bring ', p_brand))), 'workplaceType', CASE p_size % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'onsite' WHEN 2 THEN 'Hybrid' ELSE 'unspecified' END, 'hostedUrl', 'https://l.example.com/1')",
        "to_json(items)", "p_partkey",
    )
    return payloads.parse(raw, payloads.SPECS["lever"]).select("external_id", "title", "remote_flag", "description")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS external_id, CASE WHEN p_size % 3 = 0 THEN p_size * 1000 WHEN p_size % 3 = 1 THEN p_size * 2000 END AS comp_min, CASE WHEN p_size % 3 = 0 THEN p_size * 1500 WHEN p_size % 3 = 1 THEN p_size * 2500 END AS comp_max FROM part""")
def parsed_ashby(spark: SparkSession, sf_dir: str) -> DataFrame:
    component = lambda lo, hi, kind="Salary": f"named_struct('compensationType', '{kind}', 'minValue', CAST(p_size * {lo} AS DOUBLE), 'maxValue', CAST(p_size * {hi} AS DOUBLE))"
    raw = _landed(
        table(spark, sf_dir, "part"), "ashby", "p_brand",
        f"""named_struct('id', CAST(p_partkey AS STRING), 'title', p_name, 'jobUrl', 'https://a.example.com/1', 'compensation', named_struct('compensationTiers', CASE p_size % 3
            WHEN 0 THEN array(named_struct('components', array({component(1000, 1500)}, {component(1, 2, 'Equity')}))) WHEN 1 THEN array(named_struct('components', array({component(1, 1)})), named_struct('components', array({component(2000, 2500)}))) END))""",
        "to_json(named_struct('jobs', items))", "p_partkey",
    )
    return payloads.parse(raw, payloads.SPECS["ashby"]).select("external_id", "comp_min", "comp_max")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS external_id, s_name AS title, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 THEN NULL ELSE CAST(floor(s_acctbal) AS BIGINT) END AS comp_min, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 THEN 'salary predicted by the feed, not stated' END AS comp_text FROM supplier""")
def parsed_adzuna(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _landed(
        table(spark, sf_dir, "supplier"), "adzuna", "s_nationkey",
        "named_struct('id', CAST(s_suppkey AS STRING), 'title', s_name, 'redirect_url', 'https://z.example.com/1', 'salary_min', floor(s_acctbal), 'salary_max', CASE WHEN s_suppkey % 5 = 0 THEN floor(s_acctbal) ELSE floor(s_acctbal) + 500 END, 'salary_is_predicted', CASE WHEN s_suppkey % 3 = 0 THEN '1' ELSE '0' END)",
        "to_json(named_struct('count', size(items), 'results', items))", "s_suppkey",
    )
    return payloads.parse(raw, payloads.SPECS["adzuna"]).select("external_id", "title", "comp_min", "comp_text")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS external_id, s_name AS title FROM supplier")
def parsed_remoteok(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _landed(
        table(spark, sf_dir, "supplier"), "remoteok", "s_nationkey", "named_struct('id', CAST(s_suppkey AS STRING), 'position', s_name, 'url', 'https://r.example.com/1')",
        "concat('[{\"legal\":\"terms\"},', substring(to_json(items), 2))", "s_suppkey",
    )
    return payloads.parse(raw, payloads.SPECS["remoteok"]).select("external_id", "title")


@query("SELECT CAST(c_custkey AS VARCHAR) AS external_id, c_name AS title, '/jobs/' || c_custkey || '/x' AS url, c_mktsegment AS location FROM customer")
def parsed_icims(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = """concat('<li class="iCIMS_JobCardItem"><a href="/jobs/', c_custkey, '/x"><h3 class="t"> ', c_name, '</h3></a><span class="job location"> ', c_mktsegment, '</span></li>')"""
    raw = _landed(table(spark, sf_dir, "customer"), "icims", "c_nationkey", card, "concat('<ul>', array_join(items, '\\n'), '</ul>')", "c_custkey")
    return payloads.parse(raw, payloads.SPECS["icims"]).select("external_id", "title", "url", "location")


@query("SELECT CAST(c_custkey AS VARCHAR) AS external_id, c_name AS title, c_mktsegment AS department, 'Your role' || chr(10) || 'sell' AS description FROM customer")
def parsed_personio(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = "concat('<position><id>', c_custkey, '</id><name>', c_name, '</name><department>', c_mktsegment, '</department><jobDescriptions><jobDescription><name>Your role</name><value>sell</value></jobDescription></jobDescriptions></position>')"
    raw = _landed(table(spark, sf_dir, "customer"), "personio", "c_nationkey", item, "concat('<workzag-jobs>', array_join(items, ''), '</workzag-jobs>')", "c_custkey")
    return payloads.parse(raw, payloads.SPECS["personio"]).select("external_id", "title", "department", "description")


@query("SELECT CAST(c_custkey AS VARCHAR) AS external_id, c_name AS title, CAST(count(*) OVER (PARTITION BY c_nationkey, c_custkey // 50) AS BIGINT) AS reported_total FROM customer")
def parsed_phenom(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _landed(
        table(spark, sf_dir, "customer"), "phenom", "c_nationkey", "named_struct('jobId', CAST(c_custkey AS STRING), 'title', c_name, 'applyUrl', 'https://p.example.com/1')",
        "concat('<script>phApp.ddo = ', to_json(named_struct('eagerLoadRefineSearch', named_struct('totalHits', size(items), 'data', named_struct('jobs', items)))), '; phApp.x = 1;</script>')", "c_custkey",
    )
    return payloads.parse(raw, payloads.SPECS["phenom"]).select("external_id", "title", "reported_total")


@query("""SELECT p_brand AS external_id, string_agg(city, '; ' ORDER BY first) AS location FROM (SELECT p_brand, CASE WHEN p_size % 2 = 0 THEN 'Austin' ELSE 'Berlin' END AS city, min(p_partkey) AS first FROM part GROUP BY ALL) GROUP BY p_brand""")
def merged_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _landed(
        table(spark, sf_dir, "part"), "workable", "'all'", "named_struct('title', p_brand, 'shortcode', p_brand, 'url', 'https://w.example.com', 'city', CASE WHEN p_size % 2 = 0 THEN 'Austin' ELSE 'Berlin' END)",
        "to_json(named_struct('name', 'Acme', 'jobs', items))", "p_partkey",
    )
    return payloads.merge_locations(payloads.parse(raw, payloads.SPECS["workable"])).select("external_id", "location")


_PAGES = "WITH r AS (SELECT 'src' || CAST(user_id % 7 AS VARCHAR) AS source, CAST(user_id AS VARCHAR) AS board, CAST(event_id % 3 AS INTEGER) AS page_no, event_id AS pos, event_type || CAST(CAST(floor(value) AS INTEGER) % 40 AS VARCHAR) AS external_id FROM events)"


def _page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('src', CAST(user_id % 7 AS STRING)) AS source", "CAST(user_id AS STRING) AS board", "CAST(event_id % 3 AS INT) AS page_no", "event_id AS pos", "concat(event_type, CAST(CAST(floor(value) AS INT) % 40 AS STRING)) AS external_id"
    )


@query(
    _PAGES
    + """, n AS (SELECT *, row_number() OVER w AS n, lag(page_no) OVER w AS before FROM r WINDOW w AS (PARTITION BY source, board, external_id ORDER BY page_no, pos))
SELECT source, board, pos, CASE WHEN n > 1 AND before = page_no THEN 'page' WHEN n > 1 THEN 'earlier' END AS repeat FROM n"""
)
def deduped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.dedupe_pages(_page_rows(spark, sf_dir)).select("source", "board", "pos", "repeat")


@query(
    _PAGES
    + """, g AS (SELECT source, board, count(DISTINCT external_id) FILTER (WHERE pos % 17 <> 0) AS fetched, CAST(60 AS BIGINT) AS total, count(*) FILTER (WHERE pos % 17 = 0) AS rejected FROM r GROUP BY ALL)
SELECT *, CASE WHEN rejected > 0 THEN 'partial' WHEN fetched > total THEN 'partial' WHEN fetched < total THEN 'capped' ELSE 'whole' END AS verdict FROM g"""
)
def reconciled_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _page_rows(spark, sf_dir).withColumns({"reported_total": F.lit(60).cast("long"), "reject": F.when(F.col("pos") % 17 == 0, "item")})
    return integrity.reconcile_totals(rows)


@query(
    cte("source_runs")
    + """, b AS (SELECT DISTINCT source, 'b' || CAST(run_id % 5 AS VARCHAR) AS board FROM source_runs), p AS (SELECT source, 'b' || CAST(run_id % 4 AS VARCHAR) AS board, max(CASE WHEN error IS NULL THEN 200 ELSE 500 END) AS status, bool_and(run_id % 50 <> 0) AS parsed, CAST(sum(count) AS BIGINT) AS items FROM source_runs WHERE run_id % 3 = 0 GROUP BY ALL)
SELECT b.source, b.board, CASE WHEN status IS NULL THEN 'no response' WHEN status <> 200 THEN 'http ' || CAST(status AS VARCHAR) WHEN NOT parsed THEN 'unparsable' WHEN items = 0 THEN 'healthy zero' ELSE 'items' END AS state FROM b LEFT JOIN p USING (source, board)"""
)
def classified_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "source_runs")
    boards = r.select("source", F.concat(F.lit("b"), (F.col("run_id") % 5).cast("string")).alias("board")).distinct()
    p = r.filter("run_id % 3 = 0").select("source", F.concat(F.lit("b"), (F.col("run_id") % 4).cast("string")).alias("board"), F.when(F.col("error").isNull(), 200).otherwise(500).alias("http_status"), (F.col("run_id") % 50 != 0).alias("parsed"), F.col("count").alias("items"))
    return integrity.classify_result(boards, p)


@query(
    _PAGES
    + """, p AS (SELECT source, board, page_no, count(external_id) AS n FROM r GROUP BY ALL), l AS (SELECT *, lag(n) OVER (PARTITION BY source, board ORDER BY page_no) AS before, max(n) OVER (PARTITION BY source, board) AS usual FROM p)
SELECT source, board, page_no FROM l WHERE n > 0 AND before < usual"""
)
def short_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.short_pages(_page_rows(spark, sf_dir))
