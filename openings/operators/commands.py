"""Commands of the user as tables: status marks, application stages, notes on employers, identity repairs."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import get_close_matches

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import identity_url

# Fixed values.
STATUSES = ("new", "reviewed", "applied", "rejected", "ignored")
STAGE_STATUS = {"applied": "applied", "interviewing": "applied", "offer": "applied", "rejected": "rejected", "withdrawn": "applied"}


def set_statuses(openings: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(openings, events, refused): the last valid mark of each opening applied, an event where a status changes, marks with an unknown status or opening.

    openings: uid, status, notes.  marks: uid, status, notes, at, ord.  Marks of
    one opening count one after another, so events compare each with the one before.
    """
    known = openings.select("uid", F.col("status").alias("stored"))
    checked = marks.join(known, "uid", "left")
    why = F.when(~F.col("status").isin(*STATUSES), "unknown status").when(F.col("stored").isNull(), "unknown opening")
    refused = checked.withColumn("why", why).filter("why IS NOT NULL").select("uid", "status", "why")
    w = Window.partitionBy("uid").orderBy("ord")
    valid = checked.filter(why.isNull()).select("*", F.coalesce(F.lag("status").over(w), "stored").alias("before"))
    events = valid.filter(~F.col("status").eqNullSafe(F.col("before"))).select("uid", "at", F.concat(F.lit("status:"), "status").alias("kind"), F.coalesce("notes", F.lit("")).alias("detail"))
    last = valid.groupBy("uid").agg(F.max_by("status", "ord").alias("new_status"), F.max_by("notes", F.when(F.coalesce("notes", F.lit("")) != "", F.col("ord"))).alias("new_notes"))
    merged = openings.join(last, "uid", "left").select(
        *[F.coalesce("new_status", "status").alias(c) if c == "status" else F.coalesce("new_notes", "notes").alias(c) if c == "notes" else F.col(c) for c in openings.columns]
    )
    return merged, events, refused


def record_stages(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, statuses): stages once each (uid, stage, day, detail), and the status that each application's newest one drives.

    commands: uid, stage, at, detail, ord.  A late, older stage is kept and
    doesn't set the status back; of one moment the later command counts.
    """
    valid = commands.filter(F.col("stage").isin(*STAGE_STATUS))
    w = Window.partitionBy("uid", "stage", F.to_date("at"), F.coalesce("detail", F.lit(""))).orderBy("ord")
    events = valid.withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_")
    newest = events.groupBy("uid").agg(F.max(F.struct("at", "ord", "stage")).alias("m"))
    status: Column = F.coalesce(*[F.when(F.col("m.stage") == s, F.lit(v)) for s, v in STAGE_STATUS.items()])
    return events, newest.select("uid", F.col("m.stage").alias("stage"), status.alias("status"))


def append_once(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored and what of new it doesn't have yet by keys (null-safe), each key once."""
    same = [F.coalesce(F.col(f"n.{k}").cast("string"), F.lit("\x00")) == F.coalesce(F.col(f"s.{k}").cast("string"), F.lit("\x00")) for k in keys]
    fresh = new.dropDuplicates(keys).alias("n").join(stored.select(*keys).distinct().alias("s"), same, "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def adopt_legacy(legacy: DataFrame, batch: DataFrame) -> DataFrame:
    """(old_uid, new_uid): each legacy row goes to one opening of its group, one with its url before others, then by batch order.

    legacy: uid, group_key, url.  batch: uid, group_key, url, ord.  Each group's
    first opening, and the first of each of its urls, are found before the join,
    so that no legacy row meets its whole group.
    """
    first = lambda keys, name: batch.groupBy(*keys).agg(F.min_by("uid", F.struct("ord", "uid")).alias(name))
    own, any_ = first(["group_key", "url"], "own_"), first(["group_key"], "any_")
    adopted = legacy.join(any_, "group_key").join(own, ["group_key", "url"], "left")
    return adopted.select(F.col("uid").alias("old_uid"), F.coalesce("own_", "any_").alias("new_uid"))


def health_of(sources: DataFrame, health: DataFrame) -> DataFrame:
    """(stable, row) of each source's health: by its stable id, its legacy label, or either whatever the case; ties by the larger count.

    sources: stable, legacy.  health: source, last_count.
    """
    exact = health.groupBy("source").agg(F.max("last_count").alias("n"))
    folded = health.groupBy(F.lower("source").alias("source")).agg(F.max("last_count").alias("n"))
    out = sources
    for i, (table, key) in enumerate(((exact, F.col("stable")), (exact, F.col("legacy")), (folded, F.lower("stable")), (folded, F.lower("legacy")))):
        t = table.select(F.col("source").alias(f"key_{i}"), F.col("n").alias(f"n_{i}"))
        out = out.join(t, key == F.col(f"key_{i}"), "left")
    return out.select("stable", F.coalesce("n_0", "n_1", "n_2", "n_3").alias("last_count"))


def _same_place(a: Column, b: Column) -> Column:
    """Whether two urls are one as in identity_url; of https ones, closing slashes of the path and the order of the query's parts don't count."""

    def place(url: Column) -> Column:
        whole = identity_url(url)
        parts = F.array_join(F.array_sort(F.split(F.regexp_extract(whole, r"\?(.*)$", 1), "&")), "&")
        return F.when(whole.startswith("https://"), F.concat(F.regexp_replace(F.regexp_extract(whole, r"^[^?]*", 0), "/+$", ""), F.lit("?"), parts)).otherwise(F.nullif(whole, F.lit("")))

    return F.coalesce(place(a) == place(b), F.lit(False))


def continuous_detail(preview: Column, detail: Column) -> Column:
    """Whether a detail record belongs to its preview: company, title and source agree where given, and if it names a url or id one of them does.

    Both are structs with company, title, source, url, external_id.  Companies
    and titles agree if their words do; ids must be equal as they are.
    """
    words = lambda c: F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}+#.]+"), F.lit(0)), " ")
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    agree = [(words(detail[f]) == "") | (words(detail[f]) == words(preview[f])) for f in ("company", "title", "source")]
    names = (text(detail["url"]) != "") | (text(detail["external_id"]) != "")
    same = _same_place(preview["url"], detail["url"]) | ((text(preview["external_id"]) != "") & (text(preview["external_id"]) == text(detail["external_id"])))
    return agree[0] & agree[1] & agree[2] & (~names | same)


def nearest_keys(kinds: DataFrame, known: list[str], least: float = 0.6) -> DataFrame:
    """(kind, hint): the known key with the largest Ratcliff-Obershelp ratio to each distinct kind, if it is `least` or more (ties by the later name)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [get_close_matches(k, known, n=1, cutoff=least) for k in batch["kind"]]
            yield batch.assign(hint=[f[0] if f else None for f in found])

    return kinds.select("kind").filter("kind IS NOT NULL").distinct().mapInPandas(run, "kind string, hint string")


def profile_violations(rules: DataFrame, known_kinds: list[str]) -> DataFrame:
    """(ord, problem, hint) of rules that a profile can't hold: unknown kinds (with the nearest known one), blank patterns, weights that aren't whole numbers from 0 to 100.

    rules: ord, kind, pattern, weight (text).  Hints are looked up once for each distinct unknown kind; a null kind is unknown and has none.
    """
    strange = ~F.coalesce(F.col("kind").isin(*known_kinds), F.lit(False))
    hints = nearest_keys(rules.filter(strange), known_kinds)
    none = F.lit(None).cast("string")
    found = F.array_compact(
        F.array(
            F.when(strange, F.struct(F.lit("unknown kind").alias("problem"), F.col("hint"))),
            F.when(F.trim(F.coalesce("pattern", F.lit(""))) == "", F.struct(F.lit("blank pattern").alias("problem"), none.alias("hint"))),
            F.when(F.col("weight").isNotNull() & ~F.coalesce(F.col("weight").rlike(r"^\d{1,3}$") & (F.try_to_number("weight", F.lit("999")) <= 100), F.lit(False)), F.struct(F.lit("bad weight").alias("problem"), none.alias("hint"))),
        )
    )
    return rules.join(hints, "kind", "left").select("ord", F.explode(found).alias("f")).select("ord", "f.problem", "f.hint")
