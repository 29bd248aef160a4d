"""Exact duplicates by sorting contents: copies end up side by side and are compared whole.

1. Texts are normalised: runs of ASCII white space become one space.
2. One range shuffle, whose splitters Spark samples from the normalised bytes,
   deals them out; each task sorts its range externally, so that equal texts
   are neighbours.  A window over the sorted rows starts a new group wherever
   a row differs, byte for byte, from the one before it, and takes the group's
   smallest identifier.  Texts are shuffled once; nothing is hashed to decide
   whether two of them are equal.  A splitter is a text's first `HEAD`
   characters and a hash that orders texts of one head, so that what is
   sampled stays small however long texts are.
3. A text with so many copies that they would fill a task is sorted in pieces:
   (text, piece) is the sort key then.  Which texts these are follows from
   sums of bytes by a hash of the text (8 bytes a row are shuffled for it, and
   two texts of one hash are at worst cut without need).  Each piece gives up
   its first row alone; those rows are grouped by their whole texts, and
   the outcome goes back to the pieces.

`PIECES` bounds both the number of texts that are cut (and so the broadcast of
their hashes) and a piece's bytes, a 65536th of all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable, release

#: A text is cut when its copies hold more than a 65536th of all bytes: fewer than that many texts are.
PIECES = 65536
#: Copies of fewer bytes than this aren't cut.
LEAST_BYTES = 1 << 17
#: What a row takes besides its text.
ROW_BYTES = 64

#: Characters of a text in a splitter.
HEAD = 64

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: str) -> F.Column:
    """text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACES, " ")


def _large(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(hash, pieces) of the texts whose copies are cut, fewer than PIECES rows."""
    weight = F.octet_length("body").cast("long") + ROW_BYTES
    sums = durable(rows.groupBy(F.xxhash64("body").alias("hash")).agg(F.sum(weight).alias("bytes")).filter(F.col("bytes") > least_bytes), "heavy_texts")
    total = rows.agg(F.sum(weight)).first()[0] or 0
    piece = max(least_bytes, total // PIECES + 1)
    cut = durable(sums.filter(F.col("bytes") > piece).select("hash", F.ceil(F.col("bytes") / piece).alias("pieces")), "cut_texts")
    release(sums)
    return cut


def _runs(docs: DataFrame, id_col: str, text_col: str, least_bytes: int, *carried: F.Column) -> tuple[DataFrame, DataFrame]:
    """The sorted rows (doc_id, body, piece, place and least within the run of equal texts, size of the run, what is carried) and the table of cut texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("body"), *carried)
    large = _large(rows, least_bytes)
    # copies are dealt to pieces by their ids; rows without one by their place
    spread = F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())), "pieces")
    keyed = (
        rows.withColumn("head", F.substring("body", 1, HEAD)).withColumn("hash", F.xxhash64("body"))
        .join(F.broadcast(large), "hash", "left").withColumn("piece", F.when(F.col("pieces").isNotNull(), spread).otherwise(F.lit(-1)))
    )
    run = Window.partitionBy("head", "hash", "body", "piece").orderBy(F.col("doc_id").asc_nulls_last())
    return (
        keyed.repartitionByRange("head", "hash", "piece")
        .withColumn("place", F.row_number().over(run))
        .withColumn("least", F.first("doc_id").over(run))
        .withColumn("size", F.count(F.lit(1)).over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ), large


def _order(least: str) -> F.Column:
    return F.struct(F.col(least).isNull(), least, "piece")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One row a row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are (null counts as the empty
    text; a text of white space only is one space, not empty).  keep_id is the
    smallest id of the rows with the text, group_size their number and
    text_sha256 the lowercase hex digest of the normalised text.  kept is true
    for exactly one row a group: one with the smallest id.  Rows that repeat
    the smallest id with the same text are told apart arbitrarily, and a null
    id stays only where no row of the text has another (keep_id is null then).
    Only id_col and text_col are read, whatever else docs has.  An empty table
    gives an empty result.
    """
    rows, large = _runs(docs, id_col, text_col, least_bytes)
    shown = ["doc_id", F.col("least").alias("keep_id"), F.col("size").alias("group_size"), (F.col("place") == 1).alias("kept"), F.sha2("body", 256).alias("text_sha256")]
    if large.isEmpty():
        return rows.select(*shown)
    # the sorted rows without their texts, but for the first of each piece
    slim = durable(rows.select(*shown, "piece", F.when((F.col("piece") >= 0) & (F.col("place") == 1), F.col("body")).alias("body")), "sorted")
    release(large)
    whole = slim.filter("body IS NOT NULL").groupBy("body").agg(
        F.min(_order("keep_id")).alias("best"),
        F.sum("group_size").alias("all_size"),
        F.collect_list("piece").alias("pieces"),  # at most PIECES numbers
    )
    named = whole.select(F.sha2("body", 256).alias("text_sha256"), F.explode("pieces").alias("piece"), F.col("best.keep_id").alias("all_keep"), F.col("best.piece").alias("winner"), "all_size")
    cut = slim.filter("piece >= 0").join(named, ["text_sha256", "piece"]).select(
        "doc_id", F.col("all_keep").alias("keep_id"), F.col("all_size").alias("group_size"), (F.col("kept") & (F.col("piece") == F.col("winner"))).alias("kept"), "text_sha256"
    )
    return slim.filter("piece < 0").drop("piece", "body").unionByName(cut)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """docs with the row that exact_groups keeps of each group of equal texts; all columns stay."""
    rows, _ = _runs(docs, id_col, text_col, least_bytes, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    firsts = rows.filter("place = 1")
    cut = firsts.filter("piece >= 0").groupBy("body").agg(F.min_by("row", _order("least")).alias("row"))
    return firsts.filter("piece < 0").select("row.*").unionByName(cut.select("row.*"))
