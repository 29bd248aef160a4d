"""The registry of boards and feeds: its checks, what it lends to postings, and how names and urls are held against it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.frames import settle
from .screen import compile_terms

# Words that a board's declared name may have or leave out.
NAME_NOISE = (
    "inc", "inc.", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "the", "group", "holdings", "a", "of", "and", "&", "careers", "career", "opportunities", "jobs", "job", "listings", "at", "us", "usa", "part",
)
LABEL_DEFAULTS = {"lane": "aggregator", "tier": "D"}


def source_label(ats: Column, name: Column) -> Column:
    """How a source is called: platform:Name, or feed:name where there is no platform."""
    plain = F.trim(F.coalesce(name, F.lit("")))
    return F.when(F.trim(F.coalesce(ats, F.lit(""))) == "", F.concat(F.lit("feed:"), F.lower(plain))).otherwise(F.concat(F.lower(F.trim(ats)), F.lit(":"), plain))


def registry_violations(boards: DataFrame, addresses: dict[str, tuple[str, ...]]) -> DataFrame:
    """(ord, problem), one row a problem: boards without a name, of an unknown platform, or without a field of its address; flags that aren't flags.

    boards: ord, name, ats, active, rails_exempt (as text) and the address fields.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    flag = lambda c: F.when(F.col(c).isNotNull() & ~F.lower(c).isin("true", "false"), F.lit(f"{c} is no flag"))
    fields = sorted({f for own in addresses.values() for f in own})
    missing = [F.when(F.col("ats").isin([a for a, own in addresses.items() if f in own]) & blank(f), F.lit(f"{f} is missing")) for f in fields]
    problems = F.array_compact(F.array(F.when(blank("name"), F.lit("name is missing")), F.when(blank("ats"), F.lit("ats is missing")).when(~F.col("ats").isin(*addresses), F.lit("unknown ats")), *missing, flag("active"), flag("rails_exempt")))
    return boards.select("ord", F.explode(problems).alias("problem"))


def feed_violations(feeds: DataFrame, known: tuple[str, ...], bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """(ord, problem): feeds of unknown name, whole numbers out of bounds, countries that aren't two letters.  Columns are text; null is the default and fine."""
    numbers = [
        F.when(F.col(c).isNotNull() & ~F.coalesce(F.col(c).rlike(r"^\d{1,9}$") & F.col(c).try_cast("int").between(low, high), F.lit(False)), F.lit(f"{c} must be a whole number from {low} to {high}"))
        for c, (low, high) in bounds.items()
    ]
    country = F.when(F.col("country").isNotNull() & ~F.col("country").rlike(r"^[A-Za-z]{2}$"), F.lit("country must be two letters"))
    return feeds.select("ord", F.explode(F.array_compact(F.array(F.when(~F.coalesce(F.col("name").isin(*known), F.lit(False)), F.lit("unknown feed")), *numbers, country))).alias("problem"))


def attach(postings: DataFrame, boards: DataFrame) -> DataFrame:
    """postings with company, registry_lane, tier and rails_exempt of their board (source, board_id); those of feeds get the defaults.

    boards: source, board_id, company, lane, tier, rails_exempt, one row a board.  A posting's own company stands where its board names none.
    """
    own = boards.select("source", F.col("board_id").alias("board"), F.col("company").alias("b_company"), F.col("lane").alias("registry_lane"), F.col("tier").alias("b_tier"), F.col("rails_exempt").alias("b_exempt"))
    rest = [c for c in postings.columns if c not in ("company", "tier", "rails_exempt", "registry_lane")]
    return postings.join(own, ["source", "board"], "left").select(
        *rest, F.coalesce(F.nullif("b_company", F.lit("")), "company").alias("company"), F.coalesce("registry_lane", F.lit(LABEL_DEFAULTS["lane"])).alias("registry_lane"),
        F.coalesce("b_tier", F.lit(LABEL_DEFAULTS["tier"])).alias("tier"), F.coalesce("b_exempt", F.lit(False)).alias("rails_exempt"),
    )


def _tokens(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}_\s&]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin(*NAME_NOISE))


def covers_name(target: Column, declared: Column, least: float = 0.6) -> Column:
    """The declared name has at least this share of the target's words (true where either has none)."""
    want, got = F.array_distinct(_tokens(target)), F.array_distinct(_tokens(declared))
    return (F.size(want) == 0) | (F.size(got) == 0) | (F.size(F.array_intersect(want, got)) / F.size(want) >= least)


@F.pandas_udf(DoubleType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def compare_names(names: DataFrame) -> DataFrame:
    """names (asked, declared) with verdict ok, review or bad.

    A redirect is bad, no name is for review.  Equal names, one that is most
    (0.6) of the other, ones alike by 0.85 or with 0.75 of their words in
    common are ok; ones whose first words have nothing to do with each other
    are bad; one word of several is for review.  Only names that are still
    open are compared letter by letter.
    """
    parts = settle(names, a_=_tokens(F.col("asked")), d_=_tokens(F.col("declared")))
    parts = settle(parts, fa_=F.array_join("a_", ""), fd_=F.array_join("d_", ""))
    a, d, fa, fd = F.col("a_"), F.col("d_"), F.col("fa_"), F.col("fd_")
    first = lambda x: F.get(x, F.lit(0))
    shorter, longer = F.when(F.length(fa) <= F.length(fd), fa).otherwise(fd), F.when(F.length(fa) <= F.length(fd), fd).otherwise(fa)
    within = (shorter != "") & F.contains(longer, shorter) & (F.length(shorter) / F.length(longer) >= 0.6)
    common = F.size(F.array_intersect(a, d)) / F.greatest(F.lit(1), F.size(F.array_union(a, d)))
    sure = (
        F.when(F.col("declared").startswith("__REDIRECT__"), "bad").when(F.trim(F.coalesce("declared", F.lit(""))) == "", "review").when((F.size(a) == 0) | (F.size(d) == 0), "review").when(fa == fd, "ok")
        .when((first(a) != first(d)) & ~F.array_contains(d, first(a)) & ~F.array_contains(a, first(d)), "bad").when((F.size(a) >= 2) & (F.size(d) == 1) & (first(a) == first(d)), "review").when(within | (common >= 0.75), "ok")
    )
    open_ = settle(parts, sure_=sure)
    done = open_.filter("sure_ IS NOT NULL").select(*names.columns, F.col("sure_").alias("verdict"))
    return done.unionByName(open_.filter("sure_ IS NULL").select(*names.columns, F.when(_alike("fa_", "fd_") >= 0.85, "ok").otherwise("review").alias("verdict")))


def known_boards(found: DataFrame, boards: DataFrame) -> DataFrame:
    """found (url, board_id) with state: new, known, inactive (in the registry, switched off), or unresolved (no board_id)."""
    own = boards.groupBy("board_id").agg(F.max(F.coalesce("active", F.lit(True))).alias("active_"))
    state = F.when(F.col("board_id").isNull(), "unresolved").when(F.col("active_").isNull(), "new").when(F.col("active_"), "known").otherwise("inactive")
    return found.join(own, "board_id", "left").select("url", "board_id", state.alias("state"))


def migrate_health_keys(health: DataFrame, boards: DataFrame) -> DataFrame:
    """health with legacy keys (ats:Name) renamed to stable board ids, where one legacy key and one board id belong to each other alone.

    A row whose stable key has one already goes.  health: source and others; boards: ats, name, board_id.
    """
    keys = boards.select(F.concat_ws(":", "ats", "name").alias("legacy"), F.col("board_id").alias("stable"))
    alone = keys.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("legacy"))).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("stable"))).filter("n = 1 AND m = 1 AND legacy <> stable").select("legacy", "stable")
    taken = health.select(F.col("source").alias("stable"), F.lit(True).alias("taken_")).distinct()
    joined = health.join(alone, health["source"] == alone["legacy"], "left").join(taken, "stable", "left")
    return joined.filter(F.col("stable").isNull() | F.col("taken_").isNull()).select(*[F.coalesce("stable", "source").alias(c) if c == "source" else F.col(c) for c in health.columns])


def allowed_urls(found: DataFrame, hosts: DataFrame) -> DataFrame:
    """The rows of found (source, url) on a host that the allow-list has for their source: https, no credentials, the host or one below it, and a path.

    hosts: source, suffix.
    """
    shape = r"(?i)^https://([^/?#@:]+)(?::\d+)?(/[^?#]+)"
    seen = found.withColumns({"host_": F.lower(F.regexp_extract(F.trim("url"), shape, 1)), "key_": F.regexp_replace(F.lower(F.trim("source")), r"[^a-z0-9]+", "_")})
    own = hosts.groupBy(F.col("source").alias("key_")).agg(F.collect_set("suffix").alias("suffixes"))  # an allow-list's few hosts a source
    fits = F.exists("suffixes", lambda s: (F.col("host_") == s) | F.col("host_").endswith(F.concat(F.lit("."), s)))
    return seen.filter("host_ <> ''").join(own, "key_").filter(fits).select(*found.columns)


def with_policy(feeds: DataFrame, policies: DataFrame) -> DataFrame:
    """feeds with the policy of their source (attribution, storage, poll_hours); unknown ones must be asked for."""
    return feeds.join(policies, "name", "left").select(*feeds.columns, F.coalesce("attribution", F.lit("unknown")).alias("attribution"), F.coalesce("poll_hours", F.lit(24)).alias("poll_hours"))


def relevant(title: Column, terms: list[str]) -> Column:
    """A title worth a detail request; true for all where there are no terms."""
    return title.rlike(compile_terms(terms)) if terms else F.lit(True)
