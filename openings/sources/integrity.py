"""Whether what was fetched of a source is whole: page replays, totals, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
MOST_REASONS = 8


def whole_count(c: Column) -> Column:
    """A non-negative whole number from text; null for anything else."""
    return F.when(F.trim(c.cast("string")).rlike(r"^\d{1,18}$"), F.trim(c.cast("string")).cast("long"))


def dedupe_pages(rows: DataFrame) -> DataFrame:
    """rows with repeat: null for an item's first occurrence, "page" for one within its page, "earlier" for one of an earlier page, "replay" on pages that repeat another page's items.

    rows: source, board, page_no, pos, external_id.
    """
    pages = rows.groupBy("source", "board", "page_no").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "external_id"))), lambda x: F.coalesce(x["external_id"], F.lit(""))), "\x1f"), 256).alias("print_"))
    replay = pages.select("*", F.row_number().over(Window.partitionBy("source", "board", "print_").orderBy("page_no")).alias("nth")).select("source", "board", "page_no", (F.col("nth") > 1).alias("replayed"))
    w = Window.partitionBy("source", "board", "external_id").orderBy("page_no", "pos")
    marked = rows.join(replay, ["source", "board", "page_no"]).select("*", F.row_number().over(w).alias("n_"), F.lag("page_no").over(w).alias("before_"))
    repeat = F.when(F.col("replayed"), "replay").when((F.col("n_") > 1) & (F.col("before_") == F.col("page_no")), "page").when(F.col("n_") > 1, "earlier")
    return marked.withColumn("repeat", repeat).drop("n_", "before_", "replayed")


def reconcile_totals(rows: DataFrame) -> DataFrame:
    """(source, board, fetched, total, verdict): distinct items against the largest total that the provider reports."""
    g = rows.groupBy("source", "board").agg(F.countDistinct(F.when(F.col("reject").isNull(), F.col("external_id"))).alias("fetched"), F.max("reported_total").alias("total"), F.count(F.when(F.col("reject").isNotNull(), 1)).alias("rejected"))
    verdict = F.when(F.col("rejected") > 0, "partial").when(F.col("fetched") > F.col("total"), "partial").when(F.col("fetched") < F.col("total"), "capped")
    return g.withColumn("verdict", F.coalesce(verdict, F.lit("whole")))


def source_verdict(reasons: DataFrame) -> DataFrame:
    """(source, verdict): "partial: …" before "capped: …", at most eight distinct reasons in the order first seen.

    reasons: source, at, kind, reason.
    """
    first = reasons.groupBy("source", "kind", "reason").agg(F.min("at").alias("at"))
    g = first.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((F.col("kind") != "partial").cast("int").alias("no"), "at", "reason"))).alias("r"), F.bool_or(F.col("kind") == "partial").alias("partial"))
    shown = F.array_join(F.transform(F.slice("r", 1, MOST_REASONS), lambda x: x["reason"]), "; ")
    return g.select("source", F.concat(F.when(F.col("partial"), "partial: ").otherwise("capped: "), shown).alias("verdict"))


def classify_result(boards: DataFrame, payloads: DataFrame) -> DataFrame:
    """(source, board, state) of every board: no response, http n, unparsable, healthy zero, or items.

    payloads: source, board, http_status, parsed (boolean), items.
    """
    g = payloads.groupBy("source", "board").agg(F.max("http_status").alias("status"), F.bool_and("parsed").alias("parsed"), F.sum("items").alias("items"))
    state = (
        F.when(F.col("status").isNull(), "no response")
        .when(F.col("status") != 200, F.concat(F.lit("http "), F.col("status").cast("string")))
        .when(~F.col("parsed"), "unparsable")
        .when(F.col("items") == 0, "healthy zero")
        .otherwise("items")
    )
    return boards.join(g, ["source", "board"], "left").select("source", "board", state.alias("state"))


def short_pages(rows: DataFrame) -> DataFrame:
    """Pages with items that follow a shorter-than-usual page: the provider skipped some (source, board, page_no)."""
    pages = rows.groupBy("source", "board", "page_no").agg(F.count("external_id").alias("n"))
    w = Window.partitionBy("source", "board").orderBy("page_no")
    usual = F.max("n").over(Window.partitionBy("source", "board"))
    return pages.select("*", F.lag("n").over(w).alias("before"), usual.alias("usual")).filter("n > 0 AND before < usual").select("source", "board", "page_no")
