"""Queries over the registry, runs, listings and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import identity_url, public_url
from ..operators import listing, rails, registry, runs
from ..sources import landed
from .registry import query, table
from .views import cte, view

ADDRESSES = {"greenhouse": ("slug",), "lever": ("slug",), "workday": ("tenant", "site"), "icims": ("host",)}
BOARDS = (
    "s_suppkey AS ord", "CASE WHEN s_suppkey % 17 = 0 THEN ' ' ELSE s_name END AS name", "CASE s_suppkey % 6 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'workday' WHEN 3 THEN 'icims' WHEN 4 THEN 'unheard' ELSE 'greenhouse' END AS ats",
    "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE concat('s', CAST(s_suppkey AS STRING)) END AS slug", "CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 't' END AS tenant", "CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'x' END AS site", "CASE WHEN s_suppkey % 2 = 1 AND s_suppkey % 3 = 0 THEN ' ' ELSE s_name END AS host",
    "CASE s_suppkey % 9 WHEN 0 THEN 'maybe' WHEN 1 THEN 'FALSE' END AS active", "CASE s_suppkey % 8 WHEN 0 THEN 'yes' END AS rails_exempt",
)


@query(
    f"""WITH b AS (SELECT {', '.join(BOARDS)} FROM supplier)
SELECT ord, unnest(list_filter([CASE WHEN trim(name) = '' THEN 'name is missing' END, CASE WHEN ats = 'unheard' THEN 'unknown ats' END, CASE WHEN ats = 'icims' AND trim(host) = '' THEN 'host is missing' END,
 CASE WHEN ats = 'workday' AND site = '' THEN 'site is missing' END, CASE WHEN ats IN ('greenhouse', 'lever') AND slug IS NULL THEN 'slug is missing' END, CASE WHEN ats = 'workday' AND tenant = '' THEN 'tenant is missing' END,
 CASE WHEN active = 'maybe' THEN 'active is no flag' END, CASE WHEN rails_exempt = 'yes' THEN 'rails_exempt is no flag' END], lambda x: x IS NOT NULL)) AS problem FROM b"""
)
def registry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.registry_violations(table(spark, sf_dir, "supplier").selectExpr(*BOARDS), ADDRESSES)


_FEEDS = ("c_custkey AS ord", "CASE c_custkey % 4 WHEN 0 THEN 'remotive' WHEN 1 THEN 'himalayas' WHEN 2 THEN NULL ELSE 'unheard' END AS name", "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '-3' ELSE CAST(c_custkey % 70 AS STRING) END AS pages", "CASE c_custkey % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'usa' END AS country")


@query(
    f"""WITH f AS (SELECT {', '.join(_FEEDS)} FROM customer)
SELECT ord, unnest(list_filter([CASE WHEN name IS NULL OR name = 'unheard' THEN 'unknown feed' END, CASE WHEN pages IS NOT NULL AND NOT coalesce(TRY_CAST(pages AS INTEGER) BETWEEN 1 AND 50, FALSE) THEN 'pages must be a whole number from 1 to 50' END,
 CASE WHEN country = 'usa' THEN 'country must be two letters' END], lambda x: x IS NOT NULL)) AS problem FROM f"""
)
def feed_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.feed_violations(table(spark, sf_dir, "customer").selectExpr(*_FEEDS), ("remotive", "himalayas"), {"pages": (1, 50)})


_OWN = ("CASE n_nationkey % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'workday' END AS source", "concat('board:', CASE n_nationkey % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'workday' END) AS board_id", "CASE WHEN n_nationkey = 1 THEN '' ELSE n_name END AS company", "CASE WHEN n_nationkey = 0 THEN 'core' END AS lane", "CASE WHEN n_nationkey < 2 THEN 'A' END AS tier", "n_nationkey = 2 AS rails_exempt")


@query(
    cte("postings") + f""", b AS (SELECT {', '.join(_OWN)} FROM nation WHERE n_nationkey < 3)
SELECT p.doc_id, coalesce(nullif(b.company, ''), p.company) AS company, coalesce(b.lane, 'aggregator') AS registry_lane, coalesce(b.tier, 'D') AS tier, coalesce(b.rails_exempt, FALSE) AS rails_exempt FROM postings p LEFT JOIN b ON p.source = b.source AND p.board = b.board_id"""
)
def attached_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = table(spark, sf_dir, "nation").filter("n_nationkey < 3").selectExpr(*_OWN)
    return registry.attach(view(spark, sf_dir, "postings"), boards).select("doc_id", "company", "registry_lane", "tier", "rails_exempt")


_NAMES = ("c_custkey AS ord", "concat(c_mktsegment, ' Works of ', c_name, ' Inc.') AS asked", "concat(CASE c_custkey % 4 WHEN 0 THEN 'The ' WHEN 1 THEN 'Jobs at ' ELSE '' END, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'WORKS' END, CASE WHEN c_custkey % 5 = 0 THEN ' works' ELSE '' END, CASE WHEN c_custkey % 2 = 0 THEN concat(' ', c_name) ELSE '' END) AS declared")
_TOKENS = "list_filter(string_split_regex(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s&]', ' ', 'g'), '\\s+'), lambda w: w NOT IN ('', 'inc', 'the', 'jobs', 'at', 'of'))"


@query(
    f"""WITH n AS (SELECT ord, {_TOKENS.format('asked')} AS a, {_TOKENS.format('declared')} AS d FROM (SELECT {', '.join(_NAMES)} FROM customer))
SELECT ord, len(list_intersect(list_distinct(a), list_distinct(d))) / len(list_distinct(a)) >= 0.6 AS covered FROM n"""
)
def covered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*_NAMES).select("ord", registry.covers_name(F.col("asked"), F.col("declared")).alias("covered"))


@query()
def compared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared names against asked ones; tests compare it with plain Python (SQL has no such ratio)."""
    return registry.compare_names(table(spark, sf_dir, "customer").selectExpr(*_NAMES)).select("ord", "verdict")


@query("""WITH b AS (SELECT 'board:' || (p_partkey % 97) AS board_id, max(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) AS active FROM part WHERE p_partkey % 97 < 50 GROUP BY 1)
SELECT 'https://x/' || c_custkey AS url, CASE WHEN c_custkey % 11 <> 0 THEN 'board:' || (c_custkey % 97) END AS board_id,
 CASE WHEN c_custkey % 11 = 0 THEN 'unresolved' WHEN b.active IS NULL THEN 'new' WHEN b.active = 1 THEN 'known' ELSE 'inactive' END AS state FROM customer LEFT JOIN b ON c_custkey % 11 <> 0 AND b.board_id = 'board:' || (c_custkey % 97)""")
def known_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "customer").selectExpr("concat('https://x/', c_custkey) AS url", "CASE WHEN c_custkey % 11 <> 0 THEN concat('board:', c_custkey % 97) END AS board_id")
    return registry.known_boards(found, table(spark, sf_dir, "part").filter("p_partkey % 97 < 50").selectExpr("concat('board:', p_partkey % 97) AS board_id", "p_size % 2 = 0 AS active"))


@query("""WITH b AS (SELECT 'ats:' || (c_custkey // 2) AS legacy, 'id:' || CASE WHEN c_custkey % 10 = 1 THEN 0 ELSE c_custkey END AS stable FROM customer WHERE c_custkey % 4 IN (0, 1, 2)),
one AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY legacy) AS n, count(*) OVER (PARTITION BY stable) AS m FROM b) WHERE n = 1 AND m = 1),
h AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'id:' || (o_orderkey % 1500) ELSE 'ats:' || (o_orderkey % 700) END AS source, min(o_orderkey) AS last_run FROM orders GROUP BY 1)
SELECT coalesce(one.stable, h.source) AS source, h.last_run FROM h LEFT JOIN one ON h.source = one.legacy WHERE one.stable IS NULL OR one.stable NOT IN (SELECT source FROM h)""")
def migrated_health_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "customer").filter("c_custkey % 4 IN (0, 1, 2)").selectExpr("'ats' AS ats", "CAST(c_custkey div 2 AS STRING) AS name", "concat('id:', CASE WHEN c_custkey % 10 = 1 THEN 0 ELSE c_custkey END) AS board_id")
    h = table(spark, sf_dir, "orders").selectExpr("CASE WHEN o_orderkey % 3 = 0 THEN concat('id:', o_orderkey % 1500) ELSE concat('ats:', o_orderkey % 700) END AS source", "o_orderkey").groupBy("source").agg(F.min("o_orderkey").alias("last_run"))
    return registry.migrate_health_keys(h, b)


_FOUND = ("l_orderkey", "l_linenumber", "CASE l_suppkey % 3 WHEN 0 THEN 'Greenhouse' WHEN 1 THEN ' lever ' ELSE 'personio' END AS source",
          "concat(CASE WHEN l_partkey % 7 = 0 THEN 'http' ELSE 'https' END, '://', CASE l_partkey % 5 WHEN 0 THEN 'boards.greenhouse.io' WHEN 1 THEN 'jobs.lever.co' WHEN 2 THEN 'acme.personio.de' WHEN 3 THEN 'evilgreenhouse.io' ELSE 'user:pw@jobs.lever.co' END, CASE WHEN l_partkey % 11 = 0 THEN '/' ELSE '/acme/1' END) AS url")
_HOSTS = [("greenhouse", "greenhouse.io"), ("_lever_", "lever.co"), ("lever", "lever.co"), ("personio", "personio.com"), ("personio", "personio.de")]


@query(
    f"""WITH f AS (SELECT {', '.join(_FOUND)} FROM lineitem), g AS (SELECT *, lower(trim(source)) AS k, regexp_extract(url, '^https://([^/?#@:]+)(/[^?#]+)', 1) AS host FROM f)
SELECT l_orderkey, l_linenumber, url FROM g WHERE (k = 'greenhouse' AND (host = 'greenhouse.io' OR ends_with(host, '.greenhouse.io'))) OR (k = 'lever' AND ends_with(host, '.lever.co')) OR (k = 'personio' AND ends_with(host, '.personio.de'))"""
)
def allowed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").selectExpr(*_FOUND)
    return registry.allowed_urls(found, spark.createDataFrame(_HOSTS, "source string, suffix string")).select("l_orderkey", "l_linenumber", "url")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'feed:' || lower(s_name) ELSE 'lever:' || s_name END AS label, CASE WHEN s_nationkey < 10 THEN n_name ELSE 'unknown' END AS attribution, CASE WHEN s_nationkey < 10 THEN s_nationkey ELSE 24 END AS poll_hours FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def source_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = registry.source_label(F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise("Lever "), F.col("s_name"))
    feeds = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("name"), label.alias("label"))
    policies = table(spark, sf_dir, "nation").filter("n_nationkey < 10").selectExpr("n_nationkey AS name", "n_name AS attribution", "CAST(n_nationkey AS INT) AS poll_hours")
    return registry.with_policy(feeds, policies).select("s_suppkey", "label", "attribution", F.col("poll_hours").cast("int").alias("poll_hours"))


@query(cte("postings") + " SELECT doc_id, regexp_matches(title, '(?i)(^|[^\\p{L}\\p{N}_])(the|x\\d+)([^\\p{L}\\p{N}_]|$)') AS some, TRUE AS all_ FROM postings")
def relevant_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "postings").select("doc_id", registry.relevant(F.col("title"), ["the", "/x\\d+/"]).alias("some"), registry.relevant(F.col("title"), []).alias("all_"))


@query(cte("postings") + " SELECT doc_id, title, length(substr(description, 1, 20000)) AS scored FROM postings WHERE regexp_matches(title, '(?i)(^|[^\\p{L}\\p{N}_])(die|les?)([^\\p{L}\\p{N}_]|$)')")
def audited_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing.audit(view(spark, sf_dir, "postings"), ["die", "/les?/"])
    return found.select("doc_id", "title", F.length(listing.clipped(F.col("description"))).cast("long").alias("scored"))


@query(cte("app_events") + """, o AS (SELECT o_custkey AS uid, max(o_orderkey) AS newest FROM orders GROUP BY 1) SELECT e.event_id, e.uid, e.kind, o.newest FROM app_events e LEFT JOIN o USING (uid) ORDER BY e.ts DESC, e.event_id DESC LIMIT 50""")
def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest events: the listing's own limit."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("uid")).agg(F.max("o_orderkey").alias("newest"))
    return listing.history(view(spark, sf_dir, "app_events").withColumnRenamed("ts", "at"), o, 50).select("event_id", "uid", "kind", "newest")


@query("""WITH n AS (SELECT c_mktsegment AS k, count(*) AS n, arg_max(c_name, (c_nationkey, c_custkey)) AS last FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING' GROUP BY 1), s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'machinery' ELSE 'AUTOMOBILE' END AS company FROM part)
SELECT p_partkey AS uid, s.company || ' Inc.' AS company, coalesce(n.n, 0) AS notes, n.last AS last_note FROM s LEFT JOIN n ON lower(s.company) = lower(n.k)""")
def company_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING'").selectExpr("concat('The ', c_mktsegment, ', LLC') AS company", "c_nationkey AS at", "c_custkey AS ord", "c_name AS detail")
    openings = table(spark, sf_dir, "part").selectExpr("p_partkey AS uid", "concat(CASE p_partkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'machinery' ELSE 'AUTOMOBILE' END, ' Inc.') AS company")
    return listing.relationships(notes, openings)


@query("SELECT * FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name, c_custkey) AS n FROM customer) WHERE n <= 3")
def reason_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    got = listing.samples(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_name", "c_custkey"], 3)
    return got.select("c_mktsegment", "c_custkey", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_name", "c_custkey")).alias("n"))


@query("""WITH a AS (SELECT c_custkey AS uid, c_mktsegment AS company, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_nationkey END AS silent, coalesce(CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_nationkey END >= 10, FALSE) AS due FROM customer)
SELECT uid, row_number() OVER (ORDER BY due DESC, silent DESC NULLS LAST, lower(company), uid) AS place FROM a QUALIFY place <= 25""")
def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 most urgent follow-ups."""
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey AS uid", "c_mktsegment AS company", "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_nationkey END AS days_silent", "coalesce(CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_nationkey END >= 10, false) AS follow_up_due")
    from pyspark.sql import Window

    top = listing.follow_up_order(a).limit(25)
    w = Window.orderBy(F.desc("follow_up_due"), F.desc_nulls_last("days_silent"), F.lower("company"), "uid")  # 25 rows
    return top.select("uid", F.row_number().over(w).alias("place"))


@query("""WITH h AS (SELECT l_returnflag AS query, l_partkey AS url, l_orderkey * 8 + l_linenumber AS ord FROM lineitem), f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord) = 1 AS first FROM h)
SELECT query, count(*) AS hits, count(DISTINCT url) AS urls, count(*) FILTER (first) AS first_seen FROM f GROUP BY query""")
def query_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of hits of one ord the one that stands first in the table is the earlier one."""
    place = "struct(_metadata.file_path, _metadata.row_index) AS place"
    return listing.query_yields(table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS query", "l_partkey AS url", "l_orderkey * 8 + l_linenumber AS ord", place))


@query("""WITH d AS (SELECT DISTINCT p_brand AS family, p_type AS query FROM part), a AS (SELECT DISTINCT p_type AS query FROM part WHERE p_size > 45)
SELECT family, count(*) AS planned, count(a.query) AS attempted, count(*) - count(a.query) AS missing FROM d LEFT JOIN a USING (query) GROUP BY family""")
def query_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return listing.query_coverage(p.selectExpr("p_brand AS family", "p_type AS query"), p.filter("p_size > 45").selectExpr("p_type AS query"))


@query("""SELECT count(*) FILTER (o_orderkey % 5 = 0) AS ambiguous, count(*) FILTER (o_orderkey % 5 = 1) AS unmatched, count(*) FILTER (o_orderkey % 7 = 0) AS invalid, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0) AS undated FROM orders""")
def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.evidence_counts(table(spark, sf_dir, "orders").selectExpr("CASE o_orderkey % 5 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'unmatched' ELSE 'matched' END AS verdict", "CASE WHEN o_orderkey % 7 = 0 THEN 'bad' END AS problem", "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS day"))


@query(cte("postings") + " SELECT DISTINCT trim(company) AS company FROM postings WHERE trim(company) <> ''")
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.companies(view(spark, sf_dir, "postings"))


@query(cte("openings") + """ SELECT 'error' AS severity, 'pay upside down' AS "check", count(*) AS n FROM openings WHERE comp_min > comp_max HAVING n > 0
UNION ALL SELECT 'warning', 'acted on, not surfaced', count(*) AS n FROM openings WHERE status IN ('applied', 'rejected') AND gate NOT IN ('QUALIFIED', 'VERIFY') HAVING n > 0""")
def doctor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "openings")
    named = lambda df, severity, check: df.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"))
    return listing.doctor([named(o.filter("comp_min > comp_max"), "error", "pay upside down"), named(runs.corrupt_history(o), "warning", "acted on, not surfaced")])


@query(cte("openings") + " SELECT uid, status, gate FROM openings WHERE status IN ('applied', 'rejected') AND gate IN ('EXCLUDED', 'SLOT-BLOCKED')")
def corrupt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.corrupt_history(view(spark, sf_dir, "openings"))


@query("""SELECT c_custkey, 'evidence:' || lower(c_mktsegment) || '|' || lower(c_name) || '|' || CASE c_custkey % 3 WHEN 0 THEN 'http://a/' || c_custkey WHEN 1 THEN 'r' || c_custkey ELSE '' END AS key FROM customer""")
def evidence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    key = listing.synthetic_key(F.concat("c_mktsegment", F.lit(", Inc.")), F.concat(F.lit(" "), "c_name"), F.when(n == 0, F.concat(F.lit("HTTP://a/"), c)).otherwise(" "), F.lit(None).cast("string"), F.when(n == 1, F.concat(F.lit("R"), c)))
    return table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"))


_MARKS = "o_custkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'finish' ELSE 'start' END AS kind, CAST(o_orderdate AS DATE) AS day"
_RUNS = f"r AS (SELECT run_id, min(day) FILTER (kind = 'start') AS started, max(day) FILTER (kind = 'finish') AS finished FROM (SELECT {_MARKS} FROM orders) GROUP BY run_id HAVING started IS NOT NULL)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_rows(table(spark, sf_dir, "orders").selectExpr(*[c.strip() for c in _MARKS.split(", ")]).withColumnRenamed("day", "at"))


@query(f"WITH {_RUNS} SELECT run_id, started, finished, CASE WHEN finished IS NULL THEN 'running' ELSE 'done' END AS state FROM r")
def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


@query("""WITH l AS (SELECT l_orderkey AS run_id, l_suppkey % 5 AS source, arg_max(l_returnflag <> 'R', (l_linenumber * 10000000 + l_partkey, l_returnflag = 'R')) AS ok FROM lineitem GROUP BY 1, 2)
SELECT run_id, count(*) AS attempted, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (NOT ok) = 0 AS complete FROM l GROUP BY run_id""")
def run_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_scopes(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS run_id", "l_suppkey % 5 AS source", "l_returnflag <> 'R' AS ok", "l_linenumber * 10000000 + l_partkey AS ord"))


@query(f"""WITH {_RUNS}, s AS (SELECT c_custkey AS uid, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS first_seen_run FROM customer)
SELECT uid, CASE WHEN r.run_id IS NOT NULL AND r.finished IS NULL AND s.first_seen_run <> 4 THEN 4 ELSE s.first_seen_run END AS first_seen_run, coalesce(r.run_id IS NOT NULL AND r.finished IS NULL AND s.first_seen_run <> 4, FALSE) AS recovered FROM s LEFT JOIN r ON s.first_seen_run = r.run_id""")
def recovered_newness(spark: SparkSession, sf_dir: str) -> DataFrame:
    sighted = table(spark, sf_dir, "customer").selectExpr("c_custkey AS uid", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS first_seen_run")
    out = runs.recover_newness(sighted, _runs(spark, sf_dir), F.lit(4).cast("long"))
    return out.select("uid", F.col("first_seen_run").cast("long").alias("first_seen_run"), F.coalesce("recovered", F.lit(False)).alias("recovered"))


@query(cte("openings") + " SELECT uid, coalesce(CASE WHEN uid % 3 = 0 THEN NULL ELSE uid % 10 END = 7, first_seen = DATE '1995-06-01', FALSE) AS is_new FROM openings")
def new_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "openings").withColumn("first_seen_run", F.when(F.col("uid") % 3 != 0, F.col("uid") % 10))
    return runs.newness(o, F.lit(7), F.lit("1995-06-01").cast("date")).select("uid", "is_new")


@query(f"WITH {_RUNS} SELECT max(run_id) AS last_run, CAST(DATE '1998-08-10' - max(started) AS INTEGER) AS age, count(*) FILTER (finished IS NULL) AS unfinished, DATE '1998-08-10' - max(started) >= 7 AS stale FROM r")
def run_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.freshness(_runs(spark, sf_dir), F.lit("1998-08-10").cast("date"))


_TRACKED = "SELECT 'HTTPS://x.example.com/' || (l_orderkey) || '#top' AS url, l_returnflag AS section FROM lineitem WHERE l_linenumber = 7"
_STORED = "SELECT o_orderkey AS uid, CASE o_orderkey % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'rejected' ELSE 'new' END AS status, 'https://x.example.com/' || (CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE o_orderkey END) AS url, o_orderpriority AS company, o_clerk AS title FROM orders"


def _tracker(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stored = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS uid", "CASE o_orderkey % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'rejected' ELSE 'new' END AS status", "concat('https://x.example.com/', CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE o_orderkey END) AS url", "o_orderpriority AS company", "CAST(o_custkey AS STRING) AS title")
    tracked = table(spark, sf_dir, "lineitem").filter("l_linenumber = 7").selectExpr("concat('HTTPS://x.example.com/', l_orderkey, '#top') AS url", "l_returnflag AS section")
    return listing.tracker_plan(stored, tracked, identity_url)


_STORED = _STORED.replace("o_clerk", "CAST(o_custkey AS VARCHAR)")
_PLAN = f"WITH t AS (SELECT lower(string_split(url, '#')[1]) AS k, min(section) AS section FROM ({_TRACKED}) GROUP BY 1), s AS (SELECT *, count(*) OVER (PARTITION BY url) AS n FROM ({_STORED}))"


@query(_PLAN + " SELECT uid, section, status AS from_status, 'applied' AS to_status FROM s JOIN t ON s.url = t.k WHERE n = 1 AND status = 'new'")
def tracker_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracker(spark, sf_dir)[0]


@query(_PLAN + " SELECT uid, '- [' || upper(status) || '] ' || company || ' - ' || title || ' - ' || url AS line FROM s WHERE status <> 'new' AND url NOT IN (SELECT k FROM t)")
def tracker_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracker(spark, sf_dir)[1]


@query("""WITH o AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'Requirements:' || chr(10) || '- x' ELSE text END AS d, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'nothing' ELSE 'Requirements:' || chr(10) || '- y' END AS f FROM documents),
n AS (SELECT *, NOT regexp_matches(d, '(?im)^[ \\t*#_-]*(minimum |basic |required |preferred )?(requirements|qualifications)[ \\t:*_]*$') AND length(d) <= 6000 AS needed FROM o)
SELECT doc_id AS uid, needed AND doc_id % 4 IN (2, 3) AS written_back, CASE WHEN needed AND doc_id % 4 IN (2, 3) THEN length(f) ELSE length(d) END AS size FROM n""")
def enriched_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    o = d.select(n.alias("uid"), F.when(n % 3 == 0, F.concat("text", F.lit("\nRequirements:\n- x"))).otherwise(F.col("text")).alias("description"))
    details = d.filter("doc_id % 4 <> 0").select(n.alias("uid"), F.when(n % 4 == 1, "nothing").otherwise("Requirements:\n- y").alias("fetched"))
    return listing.enriched(o, details, rails.fetch_needed).select("uid", "written_back", F.length("description").cast("long").alias("size"))


@query("""WITH o AS (SELECT 'b' || o_orderkey AS uid, CASE WHEN o_orderkey % 2 = 0 THEN 'remotive' ELSE 'Himalayas' END AS source, 'https://a.example.com/' || (o_orderkey % 5) AS url FROM orders),
s AS (SELECT l_orderkey * 8 + l_linenumber AS n, 'b' || l_orderkey AS old, CASE WHEN l_orderkey % 2 = 0 THEN 'remotive' ELSE 'himalayas' END AS source, 'https://a.example.com/' || (l_partkey % 5) AS url, l_linenumber FROM lineitem),
m AS (SELECT o.uid AS old_uid, 'n' || s.n AS new_uid, CASE WHEN s.l_linenumber = 1 THEN 1 ELSE 2 END AS rule FROM s JOIN o ON s.old = o.uid WHERE CASE WHEN s.l_linenumber = 1 THEN s.source = o.source ELSE lower(s.source) = lower(o.source) END AND s.url = o.url),
b AS (SELECT *, row_number() OVER (PARTITION BY old_uid ORDER BY rule, new_uid) AS k FROM m)
SELECT old_uid, new_uid, CASE rule WHEN 1 THEN 'blank-company' ELSE 'named-aggregator' END AS rule FROM b WHERE k = 1""")
def rekeyed_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").selectExpr("concat('b', o_orderkey) AS uid", "CASE WHEN o_orderkey % 2 = 0 THEN 'remotive' ELSE 'Himalayas' END AS source", "concat('https://a.example.com/', o_orderkey % 5) AS url")
    sightings = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('n', l_orderkey * 8 + l_linenumber) AS uid", "CASE WHEN l_linenumber = 1 THEN concat('b', l_orderkey) END AS blank_uid", "CASE WHEN l_linenumber > 1 THEN concat('b', l_orderkey) END AS named_uid",
        "CASE WHEN l_orderkey % 2 = 0 THEN 'remotive' ELSE 'himalayas' END AS source", "concat('https://a.example.com/', l_partkey % 5) AS url",
    )
    return listing.rekey(stored, sightings, identity_url)


@query("""SELECT grain, row_number() OVER (PARTITION BY grain ORDER BY json) AS ord, json FROM (
 SELECT 'segments' AS grain, '{"c_mktsegment":"' || c_mktsegment || '","n":' || count(*) || '}' AS json FROM customer GROUP BY c_mktsegment
 UNION ALL SELECT 'nations', '{"c_nationkey":' || c_nationkey || ',"n":' || count(*) || '}' FROM customer GROUP BY c_nationkey)""")
def analytics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    count = F.count(F.lit(1)).alias("n")
    return listing.analytics_json(segments=c.groupBy("c_mktsegment").agg(count), nations=c.groupBy("c_nationkey").agg(count))


_LINES = "CASE c_custkey % 6 WHEN 0 THEN '# a comment' WHEN 1 THEN '  ' WHEN 2 THEN '{broken' WHEN 3 THEN '[1, 2]' ELSE concat('{\"company\": \"', c_name, '\", \"status\": \"applied\"}') END"


@query("""SELECT c_custkey AS line_no, CASE WHEN c_custkey % 6 >= 4 THEN c_name END AS company, CASE WHEN c_custkey % 6 IN (2, 3) THEN 'not an object' END AS problem FROM customer WHERE c_custkey % 6 > 1""")
def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "customer").selectExpr("c_custkey AS line_no", f"{_LINES} AS line")
    return landed.evidence_lines(lines, "company STRING, title STRING, status STRING, url STRING, day STRING").select("line_no", "company", "problem")


@query("""SELECT p_partkey, 'jobspy:' || CASE p_partkey % 2 WHEN 0 THEN 'indeed' ELSE 'google' END AS source, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size * 1000 AS BIGINT) END AS comp_min, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'https://d/' || p_partkey END AS url_direct FROM part""")
def tabular_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE p_partkey % 2 WHEN 0 THEN 'Indeed' ELSE 'google' END AS site", "CASE WHEN p_partkey % 3 = 0 THEN double('NaN') ELSE double(p_size * 1000) END AS min_amount", "CASE WHEN p_partkey % 5 = 0 THEN 'nan' ELSE concat('https://d/', p_partkey) END AS job_url_direct")
    return landed.tabular(rows).select("p_partkey", "source", "comp_min", "url_direct")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 1234 WHEN 1 THEN p_size END AS amount FROM part""")
def whole_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 6
    said = F.when(n == 0, " 1,234 ").when(n == 1, F.col("p_size").cast("string")).when(n == 2, "-5").when(n == 3, "0").when(n == 4, "12.5")
    return table(spark, sf_dir, "part").select("p_partkey", landed.positive_whole(said).cast("int").alias("amount"))


@query("""SELECT page_id, page_id % 5 IN (0, 1) AS icims, page_id % 5 = 3 AS jobvite FROM pages""")
def proven_empty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 5
    head = F.when(n == 0, "<div class='iCIMS_NoResults'>x</div>").when(n == 1, "<div class='iCIMS_Main'>There are currently <b>no open</b> positions</div>").when(n == 2, "<div class='iCIMS_Main'>no jobs? Just a moment, log in</div>").when(n == 3, "<p class='jv-page-message'>No open positions</p><div class='jv-wrapper'></div>").otherwise("")
    page = F.concat(head, F.regexp_replace("html", "(?i)icims|jv-|log.?in", ""))
    return table(spark, sf_dir, "pages").select("page_id", landed.icims_empty(page).alias("icims"), landed.jobvite_empty(page).alias("jobvite"))


_URLS = "CASE c_custkey % 12 WHEN 0 THEN concat('HTTPS://Example.com/a(b)?q=[', c_custkey, ']') WHEN 1 THEN 'http://127.0.0.1/x' WHEN 2 THEN 'https://user@example.com/' WHEN 3 THEN 'ftp://example.com' WHEN 4 THEN 'https://printer.local/x' WHEN 5 THEN 'https://single/x' WHEN 6 THEN 'https://0177.0.0.1/' WHEN 7 THEN 'https://8.8.8.8:99999/' WHEN 8 THEN concat('https://8.8.8.8:8443/', c_custkey) WHEN 9 THEN 'https://a.example.com/with blank' WHEN 10 THEN 'https://-bad.example.com/' END"


@query("""SELECT c_custkey, CASE c_custkey % 12 WHEN 0 THEN 'https://example.com/a%28b%29?q=%5B' || c_custkey || '%5D' WHEN 8 THEN 'https://8.8.8.8:8443/' || c_custkey ELSE '' END AS url FROM customer""")
def public_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", public_url(F.expr(_URLS)).alias("url"))
