"""Coverage of the registry: which platforms, boards and feeds are worked, and what's missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active(flag: Column) -> Column:
    """Entries are active unless they say otherwise."""
    return F.coalesce(flag, F.lit(True))


def unique_endpoints(boards: DataFrame) -> DataFrame:
    """boards with one row an endpoint (its id whatever the case): the registry's first."""
    return boards.withColumn("n_", F.row_number().over(Window.partitionBy(F.lower("board")).orderBy("ord"))).filter("n_ = 1").drop("n_")


def ledger(boards: DataFrame, supported: DataFrame) -> DataFrame:
    """(fact, subject, n): active boards by platform, duplicate endpoints, platforms supported but not represented, and the reverse.

    boards: board, ats, active, ord.  supported: ats.
    """
    live = boards.filter(active(F.col("active")))
    fact = lambda name, df, subject, n: df.select(F.lit(name).alias("fact"), F.col(subject).cast("string").alias("subject"), n.cast("long").alias("n"))
    by = live.groupBy("ats").agg(F.count(F.lit(1)).alias("n"))
    twice = live.groupBy(F.lower("board").alias("board")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    gaps = supported.select("ats").distinct().join(live.select("ats").distinct(), "ats", "left_anti")
    unknown = live.select("ats").distinct().join(supported.select("ats"), "ats", "left_anti")
    return (
        fact("active", by, "ats", F.col("n"))
        .unionByName(fact("duplicate", twice, "board", F.col("n")))
        .unionByName(fact("not represented", gaps, "ats", F.lit(0)))
        .unionByName(fact("not supported", unknown, "ats", F.lit(0)))
    )


def feed_readiness(required: Column, present: Column, is_active: Column) -> Column:
    """struct(state, missing): operational, dormant (inactive) or lacking keys; key names only."""
    missing = F.array_sort(F.array_except(required, present))
    state = F.when(~active(is_active), "dormant").when(F.size(missing) > 0, "lacking keys").otherwise("operational")
    return F.struct(state.alias("state"), missing.alias("missing"))


def orphans(openings: DataFrame, known: DataFrame) -> DataFrame:
    """Platform openings that no active board can show again: their board isn't known, or (without a board) their source and company aren't.

    openings: uid, source, board, company.  known: source, board, company.
    """
    has_board = F.coalesce("board", F.lit("")) != ""
    a = openings.filter(has_board).join(known.select("board").distinct(), "board", "left_anti").select("uid")
    b = openings.filter(~has_board).join(known.select("source", "company").distinct(), ["source", "company"], "left_anti").select("uid")
    return a.unionByName(b)


def alias_gaps(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """(family, missing): families of product names of which the rules cover some but not all.  terms: term; aliases: family, alias."""
    marked = aliases.join(terms.select(F.lower("term").alias("alias"), F.lit(True).alias("hit")).distinct(), "alias", "left")
    g = marked.groupBy("family").agg(F.count("hit").alias("covered"), F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("alias")))).alias("missing"))
    return g.filter((F.col("covered") > 0) & (F.size("missing") > 0)).select("family", "missing")


def query_matrix(terms: DataFrame, domains: list[str], places: list[str]) -> DataFrame:
    """(query, kind): every term with every domain, and with every place, both of which are short configuration lists."""
    listed = lambda kind, values: F.transform(F.array(*[F.lit(v) for v in values]), lambda v: F.struct(v.alias("v"), F.lit(kind).alias("kind")))
    each = terms.select("term", F.explode(F.concat(listed("domain", domains), listed("place", places))).alias("x"))
    site = F.concat(F.lit('"'), "term", F.lit('" site:'), "x.v")
    return each.select(F.when(F.col("x.kind") == "domain", site).otherwise(F.concat(F.lit('"'), "term", F.lit('" '), "x.v")).alias("query"), "x.kind")
