"""Winners among sightings of one opening, and identity across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import cross_source_key, is_ats

# Gates from the weakest.
SURFACED = {"VERIFY": 0, "QUALIFIED": 1}
DEMOTED = {"EXCLUDED": 0, "SLOT-BLOCKED": 1}


def gate_rank(gate: Column, order: dict[str, int]) -> Column:
    """A gate's place in an order; null for gates outside it."""
    return F.coalesce(*[F.when(gate == g, F.lit(r)) for g, r in order.items()])


def _decisive(sightings: DataFrame, source: str) -> DataFrame:
    """A group's authoritative sightings, or all of them where it has none (one flag a uid, before any ranking)."""
    any_ats = F.max(is_ats(F.col(source)).cast("int")).over(Window.partitionBy("uid"))
    return sightings.withColumn("any_ats", any_ats).filter((F.col("any_ats") == 0) | is_ats(F.col(source))).drop("any_ats")


def pick_surfaced(sightings: DataFrame, ties: list[str], evidence: tuple[str, ...] = ("url_direct",), richness: Column | None = None) -> DataFrame:
    """One surfaced sighting a uid: the best gate, then score, richness, and the tie columns (all of them, so that no order is arbitrary).

    Only authoritative sightings decide where a uid has any, so a third-party
    copy can't keep up what the employer's own fails.  Evidence columns are
    taken from the best sighting that has one; checked and empty ("") outranks
    never checked (null).
    """
    decisive = _decisive(sightings, "source").withColumn("rank_", gate_rank(F.col("gate"), SURFACED)).filter("rank_ IS NOT NULL")
    order = [F.desc("rank_"), F.desc("score"), F.desc(is_ats(F.col("source")).cast("int"))] + ([richness.desc()] if richness is not None else []) + [F.desc_nulls_last(c) for c in ties]
    ranked = decisive.withColumn("n_", F.row_number().over(Window.partitionBy("uid").orderBy(*order)))
    best = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("n_"))), F.max(F.when(F.col(c) == "", F.lit("")))).alias(f"best_{c}")
    found = ranked.groupBy("uid").agg(*[best(c) for c in evidence])
    kept = [F.col(f"best_{c}").alias(c) if c in evidence else F.col(c) for c in sightings.columns]
    return ranked.filter("n_ = 1").join(found, "uid").select(*kept)


def pick_demoted(sightings: DataFrame, kept: DataFrame, ties: list[str]) -> DataFrame:
    """One demoted sighting of each uid that isn't kept: the best gate, then score."""
    left = _decisive(sightings.join(kept.select("uid").distinct(), "uid", "left_anti"), "source")
    left = left.withColumn("rank_", gate_rank(F.col("gate"), DEMOTED)).filter("rank_ IS NOT NULL")
    order = Window.partitionBy("uid").orderBy(F.desc("rank_"), F.desc("score"), *[F.asc_nulls_last(c) for c in ties])
    return left.withColumn("n_", F.row_number().over(order)).filter("n_ = 1").select(*sightings.columns)


def sighting_ledger(sightings: DataFrame) -> DataFrame:
    """(uid, source): the latest url and day of each; all sources stay."""
    return sightings.groupBy("uid", "source").agg(F.max(F.struct("seen_on", "url")).alias("last")).select("uid", "source", F.col("last.url").alias("url"), F.col("last.seen_on").alias("seen_on"))


def exact_identities(postings: DataFrame) -> DataFrame:
    """(doc_id, native_uid) of discovered postings whose platform, company and url agree with exactly one native opening.

    postings: doc_id, uid, company, source, url.  Where several native openings
    share the key none is taken.
    """
    keyed = postings.select("doc_id", "uid", "source", cross_source_key(F.col("company"), F.col("source"), F.col("url")).alias("key")).filter("key IS NOT NULL")
    native = keyed.filter(is_ats(F.col("source"))).groupBy("key").agg(F.min("uid").alias("native_uid"), F.max("uid").alias("other")).filter("native_uid = other").select("key", "native_uid")
    return keyed.filter(~is_ats(F.col("source"))).join(native, "key").select("doc_id", "native_uid")


def representatives(sightings: DataFrame) -> DataFrame:
    """The sighting that stands for each group: score, platform first, pay known, place known, longest text, then uid; with the group's size."""
    known = lambda c: (F.col(c).isNotNull() & (F.col(c).cast("string") != "")).cast("int").desc()
    w = Window.partitionBy("group_key")
    order = w.orderBy(F.desc("score"), is_ats(F.col("source")).cast("int").desc(), known("comp_max"), known("location"), F.desc(F.length("description")), "uid")
    return sightings.select("*", F.row_number().over(order).alias("n_"), F.count(F.lit(1)).over(w).alias("group_size")).filter("n_ = 1").drop("n_")
