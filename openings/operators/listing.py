"""Listings and counts over openings, events, evidence and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import company_key, evidence_key, lower
from .screen import compile_terms

BODY_MOST = 20_000


def history(events: DataFrame, openings: DataFrame, limit: int) -> DataFrame:
    """The newest events with what is known of their opening (nulls where it is gone): at desc, event_id desc; the first `limit`."""
    return events.join(openings, "uid", "left").orderBy(F.desc("at"), F.desc("event_id")).limit(limit)


def relationships(notes: DataFrame, openings: DataFrame) -> DataFrame:
    """openings (uid, company) with notes and last_note of their company's relationship notes (company, at, ord, detail)."""
    own = notes.groupBy(company_key(F.col("company")).alias("key_")).agg(F.count(F.lit(1)).alias("notes"), F.max_by("detail", F.struct("at", "ord")).alias("last_note"))
    return openings.withColumn("key_", company_key(F.col("company"))).join(own, "key_", "left").select(*openings.columns, F.coalesce("notes", F.lit(0)).alias("notes"), "last_note")


def follow_up_order(applications: DataFrame) -> DataFrame:
    """Due ones first, the longest silent before others (unknown last), then by company and uid."""
    return applications.orderBy(F.desc("follow_up_due"), F.desc_nulls_last("days_silent"), lower(F.col("company")), "uid")


def samples(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group by order (which must be total)."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("n_") <= n).drop("n_")


def query_yields(hits: DataFrame) -> DataFrame:
    """(query, hits, urls, first_seen): all hits of a query, its distinct urls, and how many of these no earlier hit of any query had.

    Hits are in order by ord (nulls last), those of one ord by place, if hits have that column.
    """
    at = F.struct(F.col("ord").isNull(), "ord", *[c for c in ("place",) if c in hits.columns])
    each = hits.groupBy("query", "url").agg(F.count(F.lit(1)).alias("n_"), F.min(at).alias("at_"))
    w = Window.partitionBy("url").orderBy("at_", "query")
    marked = each.withColumn("first_", F.row_number().over(w) == 1)
    return marked.groupBy("query").agg(F.sum("n_").alias("hits"), F.count("url").alias("urls"), F.count_if("first_").alias("first_seen"))


def query_coverage(planned: DataFrame, attempted: DataFrame) -> DataFrame:
    """(family, planned, attempted, missing) of planned (family, query) against attempted (query): distinct queries."""
    done = attempted.select("query").distinct().withColumn("done_", F.lit(True))
    return planned.select("family", "query").distinct().join(done, "query", "left").groupBy("family").agg(F.count(F.lit(1)).alias("planned"), F.count("done_").alias("attempted"), F.count_if(F.col("done_").isNull()).alias("missing"))


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """One row: ambiguous, unmatched, invalid and undated lines of evidence (verdict, problem, day)."""
    return evidence.agg(F.count_if(F.col("verdict") == "ambiguous").alias("ambiguous"), F.count_if(F.col("verdict") == "unmatched").alias("unmatched"), F.count_if(F.col("problem").isNotNull()).alias("invalid"), F.count_if(F.col("day").isNull() & F.col("problem").isNull()).alias("undated"))


def companies(openings: DataFrame) -> DataFrame:
    """Distinct company names as they are written; blank ones aren't names."""
    return openings.select(F.trim("company").alias("company")).filter("company <> ''").distinct()


def doctor(findings: list[DataFrame]) -> DataFrame:
    """(severity, check, n) of findings (severity, check), errors first."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out.groupBy("severity", "check").agg(F.count(F.lit(1)).alias("n"))


def synthetic_key(company: Column, title: Column, *ids: Column) -> Column:
    """Identity of evidence without an opening: company, title, and the first of url, job id and requisition that isn't blank."""
    own = F.coalesce(*[F.nullif(F.trim(F.coalesce(i, F.lit(""))), F.lit("")) for i in ids], F.lit(""))
    return F.concat(F.lit("evidence:"), F.concat_ws("|", evidence_key(company), F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lower(own)))


def audit(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Postings whose title has one of the terms, screened out or not."""
    return postings.filter(F.coalesce("title", F.lit("")).rlike(compile_terms(terms, strict=True)))


def clipped(description: Column) -> Column:
    """What of a description is scored when an opening comes back: its first 20,000 code points."""
    return F.substring(F.coalesce(description, F.lit("")), 1, BODY_MOST)


def tracker_plan(openings: DataFrame, tracked: DataFrame, url_key) -> tuple[DataFrame, DataFrame]:
    """(updates, appends): stored openings that the tracker has as applied and the store not, and applied ones that the tracker lacks.

    openings: uid, company, title, url, status; tracked: url, section.  Urls
    are compared by url_key.  A tracker url of several openings changes none.
    """
    keyed = openings.withColumn("key_", url_key(F.col("url"))).withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy("key_")))
    lines = tracked.groupBy(url_key(F.col("url")).alias("key_")).agg(F.min("section").alias("section")).filter("key_ <> ''")
    updates = keyed.filter("n_ = 1").join(lines, "key_").filter(~F.col("status").isin("applied", "rejected")).select("uid", "section", F.col("status").alias("from_status"), F.lit("applied").alias("to_status"))
    line = F.concat(F.lit("- ["), F.upper("status"), F.lit("] "), F.concat_ws(" - ", "company", "title", "url"))
    appends = keyed.filter(F.col("status").isin("applied", "rejected")).join(lines.select("key_"), "key_", "left_anti").select("uid", line.alias("line"))
    return updates, appends


def enriched(openings: DataFrame, details: DataFrame, needed) -> DataFrame:
    """openings with the description that was fetched for them, where theirs needs one and the fetched one doesn't; written_back tells which.

    details: uid, fetched (one row an opening).  needed: description -> boolean.
    """
    better = needed(F.col("description")) & F.col("fetched").isNotNull() & ~needed(F.col("fetched"))
    marked = openings.join(details, "uid", "left").withColumn("written_back", F.coalesce(better, F.lit(False)))
    return marked.select(*[F.when(F.col("written_back"), F.col("fetched")).otherwise(F.col(c)).alias(c) if c == "description" else F.col(c) for c in openings.columns], "written_back")


def rekey(stored: DataFrame, sightings: DataFrame, url_key) -> DataFrame:
    """(old_uid, new_uid, rule): stored rows under an older identity that a sighting proves to be its own.

    stored: uid, source, url.  sightings: uid, blank_uid (its former identity
    without a company), named_uid (its former one at an aggregator), source,
    url.  Rules in order: blank-company (same source and url to the letter),
    named-aggregator (same source whatever its case, same url by url_key), both
    only for the row of just that former identity.  A stored row goes to one
    sighting, the smallest uid of its first rule; none goes to itself.
    """
    old = stored.select(F.col("uid").alias("old_uid"), F.col("source").alias("s_"), F.col("url").alias("u_"))
    blank = sightings.join(old, (sightings["blank_uid"] == old["old_uid"]) & (sightings["source"] == old["s_"]) & (sightings["url"] == old["u_"])).select("old_uid", "uid", F.lit(1).alias("rule"))
    # url_key may call the JVM, which Spark allows in columns but not in conditions of a join
    known = old.select("old_uid", F.lower("s_").alias("source_key"), url_key(F.col("u_")).alias("url_key"))
    keyed = sightings.filter("named_uid IS NOT NULL").select("uid", F.col("named_uid").alias("old_uid"), F.lower("source").alias("source_key"), url_key(F.col("url")).alias("url_key"))
    named = keyed.join(known, ["old_uid", "source_key", "url_key"]).select("old_uid", "uid", F.lit(2).alias("rule"))
    best = blank.unionByName(named).filter("old_uid <> uid").groupBy("old_uid").agg(F.min(F.struct("rule", "uid")).alias("m"))
    return best.select("old_uid", F.col("m.uid").alias("new_uid"), F.when(F.col("m.rule") == 1, "blank-company").otherwise("named-aggregator").alias("rule"))


def analytics_json(**grains: DataFrame) -> DataFrame:
    """(grain, ord, json): the rows of each grain as JSON; ord numbers them by their JSON."""
    out = None
    for name, df in grains.items():
        rows = df.select(F.lit(name).alias("grain"), F.to_json(F.struct(*df.columns)).alias("json"))
        out = rows if out is None else out.unionByName(rows)
    return out.select("grain", F.row_number().over(Window.partitionBy("grain").orderBy("json")).alias("ord"), "json")
