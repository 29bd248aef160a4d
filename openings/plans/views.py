"""The library's tables as views of the driver's tables.

Each view is a list of SQL expressions over one table that Spark and DuckDB
read alike, so that queries and their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import table

_CASE = lambda key, values, kind="'{}'": "CASE " + key + " " + " ".join(f"WHEN {i} THEN " + (kind.format(v) if v is not None else "NULL") for i, v in enumerate(values)) + " END"

_CASE_OF = lambda key, values: "CASE " + key + " " + " ".join(f"WHEN {k} THEN concat('{v}')" if "\n" not in v else f"WHEN {k} THEN concat('" + v.replace("\n", "', chr(10), '") + "')" for k, v in values.items()) + " ELSE '' END"

#: Sentences that some postings end with, so that each rail has something to read.
SAID = {
    3: "\nYou will own a sales quota.", 4: "\nThis is not a quota-carrying role.", 5: "\nYou must hold a security clearance.", 6: "\nNo security clearance is required.", 7: "\nMust have deep knowledge of CPQ.",
    8: "\nCPQ is a plus.", 9: "\nRequirements:\n- 15 years of it", 10: "\nThe CTA is required.", 11: "\nApply by June 1, 2020.", 17: "\nApply by June 1, 2030.", 18: "\nRequirements:\n- two products\n- CPQ", 19: "\nRequirements:\n- familiarity with CPQ",
}
LOCATIONS = ("Austin, TX", "Remote (US)", "Berlin, Germany", "Remote", "", "3 Locations", "United States", "Toronto, Canada", "Remote - US, Canada", "Denver, CO", "Remote, in")
COMPANIES = ("Acme Inc.", "The Globex Group", "Initech, LLC", "Umbrella Corp", "Hooli Labs", "Stark Technologies", "Wayne-Enterprises Ltd")
SOURCES = ("greenhouse", "lever", "freehire:greenhouse", "remotive", "workday")

POSTINGS = [
    "doc_id",
    "CAST(doc_id AS STRING) AS external_id",
    _CASE("doc_id % 7", COMPANIES) + " AS company",
    "concat(" + _CASE_OF("doc_id % 31", {14: "the CPQ ", 15: "the Rivalforce "}) + ", trim(substring(text, 1, 40))) AS title",
    _CASE("doc_id % 11", LOCATIONS) + " AS location",
    _CASE("doc_id % 5", SOURCES) + " AS source",
    "concat('https://jobs.example.com/', source, '/', CAST(doc_id % 400 AS STRING)) AS url",
    "CASE WHEN doc_id % 5 IN (0, 1, 4) THEN concat('board:', source) ELSE '' END AS board",
    "CASE doc_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS remote_flag",
    "CASE WHEN doc_id % 3 = 0 THEN 60000 + (doc_id % 90) * 1000 WHEN doc_id % 17 = 0 THEN 25 END AS comp_min",
    "CASE WHEN doc_id % 6 = 0 THEN 80000 + (doc_id % 120) * 1000 END AS comp_max",
    "CASE WHEN doc_id % 3 = 0 THEN 'board' WHEN doc_id % 17 = 0 THEN 'unknown' ELSE 'absent' END AS comp_source",
    "lang AS department",
    _CASE("doc_id % 3", ("A", "B", "C")) + " AS tier",
    "CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 13 < 5 THEN '' ELSE concat('https://apply.example.com/', CAST(doc_id % 50 AS STRING)) END AS url_direct",
    "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 < 4 THEN '' ELSE concat('https://', source, '.example.com/') END AS company_site",
    "concat(" + _CASE_OF("doc_id % 31", {12: "Onsite 5x per week. ", 13: "You must be based in Denver Metro. ", 16: "You must be based in the United States. "}) + ", text, " + _CASE_OF("doc_id % 31", SAID) + ") AS description",
]

#: Stored openings: one an order.
OPENINGS = [
    "o_orderkey AS uid",
    "o_custkey",
    "CASE o_orderstatus WHEN 'F' THEN 'applied' WHEN 'P' THEN 'rejected' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'ignored' ELSE 'new' END END AS status",
    "CASE o_orderkey % 5 WHEN 0 THEN 'EXCLUDED' WHEN 1 THEN 'SLOT-BLOCKED' WHEN 2 THEN 'VERIFY' ELSE 'QUALIFIED' END AS gate",
    "CAST(o_orderkey % 101 AS INT) AS score",
    "CAST(floor(o_totalprice) AS BIGINT) AS comp_max",
    "CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice * 0.8) AS BIGINT) WHEN o_orderkey % 31 = 0 THEN CAST(floor(o_totalprice * 1.2) AS BIGINT) END AS comp_min",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'board' WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'body' END AS comp_source",
    "CASE WHEN o_orderkey % 9 = 0 THEN 'comp: above the screen' ELSE concat('location: ', o_orderpriority) END AS reasons",
    "CAST(o_orderdate AS DATE) AS first_seen",
    "CASE WHEN o_orderkey % 19 = 0 THEN CAST(o_orderdate AS DATE) END AS delisted_on",
    "o_orderpriority AS lane",
]

#: Sightings of openings: one a line item.
SIGHTINGS = [
    "l_orderkey AS uid",
    "CASE l_suppkey % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'freehire:lever' WHEN 3 THEN 'remotive' ELSE 'himalayas' END AS source",
    "concat('https://x.example.com/', CAST(l_partkey AS STRING)) AS url",
    "CAST(l_shipdate AS DATE) AS seen_on",
    "l_linenumber",
    "CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN 'EXCLUDED' WHEN 1 THEN 'SLOT-BLOCKED' WHEN 2 THEN 'VERIFY' ELSE 'QUALIFIED' END AS gate",
    "CAST(l_quantity AS INT) AS score",
    "CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN '' ELSE concat('https://a.example.com/', CAST(l_suppkey AS STRING)) END AS url_direct",
]

#: Application events: a user is an application.
EVENTS = [
    "event_id",
    "user_id AS uid",
    "CAST(ts AS DATE) AS day",
    "ts",
    "CASE event_type WHEN 'signup' THEN 'application:applied' WHEN 'click' THEN 'application:interviewing' WHEN 'purchase' THEN 'application:offer' WHEN 'error' THEN 'application:rejected' ELSE 'note' END AS kind",
    "CASE event_type WHEN 'signup' THEN 'applied' WHEN 'click' THEN 'interviewing' WHEN 'purchase' THEN 'offer' WHEN 'error' THEN 'rejected' END AS stage",
    "CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 END AS stage_no",
]

#: One poll of a source a day, from events of a user as a source.
SOURCE_RUNS = [
    "event_id AS run_id",
    "concat('source', CAST(user_id % 25 AS STRING)) AS source",
    "ts AS at",
    "CASE WHEN event_id % 11 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS count",
    "CASE WHEN event_type = 'error' THEN 'HTTP 500' END AS error",
]

_VIEWS = {"postings": ("documents", POSTINGS), "openings": ("orders", OPENINGS), "sightings": ("lineitem", SIGHTINGS), "app_events": ("events", EVENTS), "source_runs": ("events", SOURCE_RUNS)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = _VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*columns)


def cte(*names: str) -> str:
    """The same views for DuckDB, as the head of a WITH clause."""
    return "WITH " + ",\n".join(f"{n} AS (SELECT {', '.join(_VIEWS[n][1])} FROM {_VIEWS[n][0]})" for n in names)
