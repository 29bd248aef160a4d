"""Checks of stored tables: each finding is one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
GATES = ("QUALIFIED", "VERIFY", "SLOT-BLOCKED", "EXCLUDED")
SPREAD, MOST_PAY = 10, 2_000_000


def invariants(openings: DataFrame) -> DataFrame:
    """(uid, check) of every broken invariant of an opening."""
    lo, hi = F.col("comp_min"), F.col("comp_max")
    known = lo.isNotNull() | hi.isNotNull()
    checks = {
        "pay quoted but not stored": F.col("reasons").startswith("comp:") & ~known,
        "pay ends out of order": hi < lo,
        "pay spread too wide": hi > SPREAD * lo,
        "pay without provenance": known & (F.coalesce("comp_source", F.lit("")) == ""),
        "provenance without pay": ~known & F.col("comp_source").isin("board", "body"),
        "unknown gate": ~F.col("gate").isin(*GATES),
    }
    return openings.select("uid", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))).alias("check"))


def repaired_pay(openings: DataFrame) -> DataFrame:
    """openings with impossible bands (too wide, or beyond any pay) set to null."""
    bad = F.coalesce((F.col("comp_max") > SPREAD * F.col("comp_min")) | (F.col("comp_max") > MOST_PAY) | (F.col("comp_min") > MOST_PAY), F.lit(False))
    marked = openings.withColumn("repaired", bad)
    return marked.withColumns({c: F.when(~F.col("repaired"), F.col(c)) for c in ("comp_min", "comp_max")})


def differences(published: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, published, stored) of all values that disagree, and of rows that only one side has (field: missing)."""
    a, b = published.alias("a"), stored.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    missing = F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull()
    value = lambda side, c: F.col(f"{side}.{c}").cast("string")
    found = [F.when(~missing & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.struct(F.lit(c).alias("field"), value("a", c).alias("published"), value("b", c).alias("stored"))) for c in columns]
    lost = F.when(missing, F.struct(F.lit("missing").alias("field"), F.col(f"a.{key}").cast("string").alias("published"), F.col(f"b.{key}").cast("string").alias("stored")))
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.explode(F.array_compact(F.array(*found, lost))).alias("d")).select(key, "d.field", "d.published", "d.stored")


def row_digest(columns: list[str]) -> Column:
    """sha256 of a row's values: each with its length before it, null apart from every text."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.lit("s"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("n")) for c in columns]), 256)


def fingerprint(df: DataFrame, by: list[str] | None = None, depth: int = 2) -> DataFrame:
    """A hash tree over the rows: (by..., prefix, rows, digest), the root having the empty prefix.

    Rows stand in the order of their digests, so neither partitioning nor the
    order of files counts; a row that repeats counts each time.  A leaf holds
    the rows whose digests share their first `depth` hex digits: its digest is
    the sha256 of "row digest:times" of them all, in order; an inner node's is
    that of its children's digests.  Two tables (of the same `by`) are equal
    where their roots are, and differ under the prefixes whose digests differ.
    Choose `depth` so that 16^depth leaves hold some thousand rows each.
    """
    by, columns = by or [], [c for c in df.columns if c not in (by or [])]
    rows = df.select(*by, row_digest(columns).alias("digest")).groupBy(*by, "digest").agg(F.count(F.lit(1)).alias("rows"))
    node = lambda parts: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "\n"), 256)
    level = rows.select(*by, F.substring("digest", 1, depth).alias("prefix"), "rows", F.col("digest").alias("at"), F.concat("digest", F.lit(":"), F.col("rows").cast("string")).alias("part"))
    out = None
    for length in range(depth, -1, -1):
        level = level.groupBy(*by, "prefix").agg(F.sum("rows").alias("rows"), node("part").alias("digest"))
        out = level if out is None else out.unionByName(level)
        level = level.select(*by, F.substring("prefix", 1, length - 1 if length > 1 else 0).alias("prefix"), "rows", F.col("prefix").alias("at"), F.col("digest").alias("part"))
    return out


def stale(published: DataFrame, state: DataFrame, by: list[str], today: Column) -> DataFrame:
    """(by..., stale, why) of every published report: rendered on another day, or from rows that are no longer those of the state.

    published: by..., digest (a root of fingerprint), day.  state: the tree of
    the present rows.  A report whose rows are all gone is stale, too.
    """
    roots = state.filter("prefix = ''").select(*by, F.col("digest").alias("now"))
    why = F.when(F.col("day").isNull() | (F.col("day") != today), "another day").when(~F.col("digest").eqNullSafe(F.col("now")), "rows changed")
    return published.join(roots, by, "left").select(*by, why.isNotNull().alias("stale"), why.alias("why"))
