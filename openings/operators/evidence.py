"""Evidence of applications against stored postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard

# Fixed values.
OVERLAP, MARGIN = 0.6, 0.15
#: Least overlaps that are looked for in turn, after overlap - margin; at the last one any shared word pairs two titles.
FLOORS = (0.2, 1e-6)


def _sets(df: DataFrame, uid: str) -> DataFrame:
    """One row a distinct (key, word set) with words: the smallest id and the number of rows."""
    titled = df.filter(F.size("words") > 0).select("key", F.array_sort("words").alias("words"), F.col(uid).alias("id"))
    return titled.groupBy("key", "words").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def _prefixes(sets: DataFrame, ranks: DataFrame, floor: float) -> DataFrame:
    """sets with prefix: their rarest words, as many as a set with overlap `floor` or more must share one of."""
    ordered = (
        sets.select("key", "words", F.explode("words").alias("word")).join(ranks, "word", "left")
        .groupBy("key", "words").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("rank", F.lit(0)).alias("rank"), "word"))).alias("w"))
    )
    n = F.size("w")
    keep = n - F.ceil(n * F.lit(floor) - F.lit(1e-9)).cast("int") + 1
    first = F.transform(F.slice("w", F.lit(1), F.least(keep, n)), lambda x: x["word"])
    return sets.join(ordered.select("key", "words", first.alias("prefix")), ["key", "words"])


def title_candidates(asked: DataFrame, offered: DataFrame, floor: float) -> DataFrame:
    """Pairs of distinct title sets of one company that may overlap by `floor` or more: key, asked and offered words, id, copies.

    asked: key, words.  offered: key, words, id, copies.  Both sides look each
    other up by their rarest words only, so words that most titles hold pair
    nothing; a pair comes once, at the first word that its prefixes share.
    """
    ranks = offered.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("rank"))
    a = _prefixes(asked, ranks, floor).select("key", F.col("words").alias("asked_"), F.col("prefix").alias("ap"), F.explode("prefix").alias("word"))
    o = _prefixes(offered, ranks, floor).select("key", F.col("words").alias("offered_"), "id", "copies", F.col("prefix").alias("op"), F.explode("prefix").alias("word"))
    pairs = a.join(o, ["key", "word"]).filter(F.get(F.array_intersect("ap", "op"), F.lit(0)) == F.col("word"))
    return pairs.select("key", "asked_", "offered_", "id", "copies")


def title_overlaps(titles: DataFrame, uid: str, least: float) -> DataFrame:
    """(left_key, right_key, overlap): pairs of one company's titles, the smaller id left, whose overlap is `least` or more (above 0).

    titles: the id, key, words.  Distinct word sets are compared, once a pair
    and only where they share one of their rarest words; then each stands for its titles.
    """
    sets = _sets(titles, uid)
    alike = title_candidates(sets.select("key", "words"), sets, least).select("key", "asked_", "offered_", jaccard(F.col("asked_"), F.col("offered_")).alias("overlap")).filter(F.col("overlap") >= least)
    each = lambda name, words: titles.select(F.col(uid).alias(name), "key", F.array_sort("words").alias(words))
    # what goes in is small and what comes out isn't: partitions of a fixed number aren't merged by the size of their input
    n = titles.sparkSession.sparkContext.defaultParallelism * 4
    left = alike.join(each("left_key", "asked_"), ["key", "asked_"]).select("key", "offered_", "left_key", "overlap").repartition(n, "key", "offered_")
    pairs = left.join(each("right_key", "offered_").repartition(n, "key", "offered_"), ["key", "offered_"])
    return pairs.filter("left_key < right_key").select("left_key", "right_key", "overlap")


def best_overlaps(asked: DataFrame, offered: DataFrame, floors: list[float]) -> DataFrame:
    """(key, asked_, top): each asked title's overlaps above 0 with offered ones, best first, as (score, copies, id): at least those that hold its two best postings.

    A title whose two best postings reach a floor is done; only the others
    look for lower overlaps.
    """
    found, left = None, asked
    for floor in floors:
        scored = title_candidates(left, offered, floor).withColumn("score", jaccard(F.col("asked_"), F.col("offered_"))).filter(F.col("score") >= floor)
        # Two sets have few distinct overlaps, so what is listed a title stays small.
        levels = scored.groupBy("key", "asked_", "score").agg(F.sum("copies").alias("copies"), F.min("id").alias("id"))
        top = levels.groupBy("key", "asked_").agg(F.sort_array(F.collect_list(F.struct("score", "copies", "id")), asc=False).alias("top"), F.sum("copies").alias("n"))
        done = (top if floor == floors[-1] else top.filter("n > 1")).drop("n")
        left = left.join(done.select("key", F.col("asked_").alias("words")), ["key", "words"], "left_anti")
        found = done if found is None else found.unionByName(done)
    return found


def match_evidence(evidence: DataFrame, postings: DataFrame, overlap: float = OVERLAP, margin: float = MARGIN) -> DataFrame:
    """One row an evidence row: line, verdict (matched, ambiguous, unmatched), uid, best, runner_up.

    evidence: line, key (company), words (title set; null without a title).
    postings: uid, key, words.  A title matches when the best overlap reaches
    `overlap` and leads the next by `margin`; without a title only a company's
    single posting does.  best and runner_up are the overlaps of the company's
    two best postings (0 without a title or a shared word, null without such a posting).
    Titles that repeat within a company are compared once, and only titles that
    share one of their rarest words are compared at all.  A null key is no company.
    """
    offered = _sets(postings, "uid")
    asked = evidence.filter(F.size("words") > 0).select("key", F.array_sort("words").alias("words")).filter("key IS NOT NULL").distinct()
    top = best_overlaps(asked, offered, [overlap - margin, *[f for f in FLOORS if f < overlap - margin]]).withColumn("best_", F.get("top", F.lit(0)))
    top = top.select(F.col("key"), F.col("asked_"), F.col("best_.score").alias("first"), F.col("best_.id").alias("uid_"), F.when(F.col("best_.copies") > 1, F.col("best_.score")).otherwise(F.get("top", F.lit(1))["score"]).alias("second"))
    sole = postings.filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("candidates"), F.min("uid").alias("sole_"))
    e = evidence.withColumn("asked_", F.when(F.size("words") > 0, F.array_sort("words")))
    at_least = lambda n, score: F.when(F.col("candidates") >= n, F.coalesce(score, F.lit(0.0)))
    joined = e.join(sole, "key", "left").join(top, ["key", "asked_"], "left").withColumns({"best": at_least(1, "first"), "runner_up": at_least(2, "second")})
    verdict = (
        F.when(F.col("candidates").isNull(), "unmatched")
        .when(F.col("words").isNull(), F.when(F.col("candidates") == 1, "matched").otherwise("ambiguous"))
        .when((F.col("best") >= overlap) & (F.col("best") - F.coalesce("runner_up", F.lit(0.0)) >= margin), "matched")
        .when(F.col("best") >= overlap, "ambiguous")
        .otherwise("unmatched")
    )
    chosen = F.when(verdict == "matched", F.when(F.col("words").isNull(), F.col("sole_")).otherwise(F.col("uid_")))
    return joined.select("line", verdict.alias("verdict"), chosen.alias("uid"), "best", "runner_up")


def closed_doors(live: DataFrame, rejected: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """Live postings of employers that rejected the user: problem where the titles overlap much, note where a little (the first rejection counts).

    live, rejected: uid, key, words.  Each company's first rejection is found before the join.
    """
    first = rejected.groupBy("key").agg(F.min(F.struct("uid", "words")).alias("r")).select("key", F.col("r.uid").alias("rejected_uid"), F.col("r.words").alias("rejected_words"))
    scored = live.join(first, "key").withColumn("overlap", jaccard(F.col("words"), F.col("rejected_words"))).filter("overlap > 0")
    return scored.select("uid", "rejected_uid", F.when(F.col("overlap") >= overlap, "problem").otherwise("note").alias("severity"), "overlap")


def tracker_drift(tracker: DataFrame, postings: DataFrame) -> DataFrame:
    """One row a tracker url: drift (one posting has its host and a path equal to or under it), ambiguous (several), history (none).

    tracker: line, host, path.  postings: uid, host, path.
    """
    t, p = tracker.alias("t"), postings.alias("p")
    under = (F.col("p.path") == F.col("t.path")) | F.col("p.path").startswith(F.concat(F.rtrim(F.col("t.path"), F.lit("/")), F.lit("/")))
    hits = t.join(p, (F.col("t.host") == F.col("p.host")) & under, "left").groupBy("t.line").agg(F.count("p.uid").alias("hits"), F.min("p.uid").alias("uid"))
    verdict = F.when(F.col("hits") == 0, "history").when(F.col("hits") == 1, "drift").otherwise("ambiguous")
    return hits.select("line", verdict.alias("verdict"), "hits", F.when(F.col("hits") == 1, F.col("uid")).alias("uid"))


def employer_aliases(asked: DataFrame, employers: DataFrame) -> DataFrame:
    """(asked, employer) where a name is an employer's key, or the initials of exactly one.

    asked: name (lower case).  employers: employer, key (words).
    """
    initials = employers.filter(F.size(F.split("key", " ")) > 1).select("employer", F.array_join(F.transform(F.split("key", " "), lambda w: F.substring(w, 1, 1)), "").alias("name"))
    one = lambda df: df.groupBy("name").agg(F.min("employer").alias("employer"), F.countDistinct("employer").alias("n")).filter("n = 1").drop("n")
    exact, acronym = one(employers.select("employer", F.col("key").alias("name"))), one(initials).withColumnRenamed("employer", "by_initials")
    return asked.join(exact, "name", "left").join(acronym, "name", "left").select("name", F.coalesce("employer", "by_initials").alias("employer")).filter("employer IS NOT NULL")
