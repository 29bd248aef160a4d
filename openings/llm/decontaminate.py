"""Benchmark decontamination with spaced-seed hashing.

A mask is a fixed set of token places within a window; the tokens at the other
places are ignored.  Hashes of all masked windows of the test items and of all
training texts are joined; around every hit the two token runs are compared
place by place, and the best stretch through the hit is kept if it is long
enough and alike enough.  Substituted tokens cost a place, not the hit: one of
the masks jumps over them.

Training windows are looked up in a bitmap of the test hashes first (32 bits a
hash and four probes, at most 128 MB), so that what is shuffled is hits and not
the corpus.  Hits that stand no further apart than the longest item is long
travel as one run, with as many tokens around it: whatever an item can overlap
is in one run, and all runs together are at most a few times the texts that
have a hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap, may_be, size_for
from .durable import durable
from .words import _STEP, NOT_ALNUM, cut_words, mix

#: Places that count, in windows of up to 11 tokens, for items of 13 tokens or more.  One of them hits in any 13 to 26 places of
#: which 80 % agree, however the others lie; longer stretches fall into such pieces, one of which agrees as much.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 8, 9, 10), (0, 1, 3, 5, 6, 10), (0, 1, 2, 3, 4, 5))
#: The same in windows of 5 tokens for shorter items, all of which but one token must overlap.
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (1, 2, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4))
SHORT = 13
LEAST_TOKENS = 5

def _windows(hashes: np.ndarray, bounds: np.ndarray, mask: tuple[int, ...], number: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows that lie within one text, and the hashes of their tokens under the mask."""
    span = mask[-1] + 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = np.full(n, number + 1, np.uint64)
    for j, place in enumerate(mask):
        key += hashes[place : place + n] * _STEP[8 + j]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = row[:n] == row[span - 1 :]
    return np.flatnonzero(inside), mix(key[inside])


def _all_masks() -> tuple[tuple[int, ...], ...]:
    return (*MASKS, *SHORT_MASKS)


def test_hashes(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(hash, item_id, at) of all masked windows, and (item_id, n, tokens) of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in cut_words(batch.column(1), NOT_ALNUM):
                tokens = [words.hashes[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
                ids = batch.column(0).slice(words.first, len(tokens))
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in tokens], pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary())], ["item_id", "n", "tokens"])

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0), batch.column(2), strict=True):
                tokens = np.frombuffer(raw.as_buffer(), np.uint64)
                for number, mask in enumerate(_all_masks()):
                    if (len(tokens) >= SHORT) == (number < len(MASKS)):
                        at, key = _windows(tokens, np.array([0, len(tokens)]), mask, number)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array([item.as_py()] * len(at), pa.int64()), pa.array(at)], ["hash", "item_id", "at"])

    kept = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "item_id long, n long, tokens binary").filter(F.col("n") >= LEAST_TOKENS)
    kept = durable(kept.distinct(), "items")
    return durable(kept.mapInArrow(hash_, "hash long, item_id long, at long").distinct(), "tests"), kept


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_overlap: int = 13,
    identity: float = 0.8,
) -> DataFrame:
    """One row a (text, test item) that overlap: doc_id, item_id, start, length, matched, share.

    Tokens are the alphanumeric words of the whole texts, A-Z lower-cased.  An
    overlap is a stretch of `length` places without shift, through a hit of one
    of the masks, at least `least_overlap` tokens long (all of a shorter item,
    but for its outermost token), of which `matched` >= identity * length agree;
    of each shift the longest counts.  start is its first token in the text,
    share = matched / tokens of the item; of several the one with most matches
    (then the smallest start) is given.

    Items of fewer than LEAST_TOKENS tokens are too short to be evidence and
    match nothing.  Null and empty texts have no tokens.  Rows that repeat an
    id are answered together; so are those whose id is null.  Only the named
    columns are read; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    tests, kept = test_hashes(items, item_col, item_text_col)
    facts = kept.agg(F.coalesce(F.max("n"), F.lit(0)).alias("longest"), F.coalesce(F.min("n") < SHORT, F.lit(False)).alias("short")).first()
    reach, short = facts["longest"], facts["short"]
    hashes = tests.select("hash").distinct()
    shipped = spark.sparkContext.broadcast(bitmap(hashes, size_for(hashes.count())))

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        masks = [(i, m) for i, m in enumerate(_all_masks()) if i < len(MASKS) or short]
        for batch in batches:
            for words in cut_words(batch.column(1), NOT_ALNUM):
                found, keys = [], []
                for number, mask in masks:
                    at, key = _windows(words.hashes, words.bounds, mask, number)
                    hit = may_be(known, key)
                    at, key = at[hit], key[hit]
                    found.append(at)
                    keys.append(key)
                at, key = np.concatenate(found), np.concatenate(keys)
                if not len(at):
                    continue
                by = np.argsort(at, kind="stable")
                at, key = at[by], key[by]
                row = np.searchsorted(words.bounds, at, side="right") - 1
                cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(at) > reach)) + 1
                ids = batch.column(0).slice(words.first, words.last - words.first)
                first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
                begin = np.maximum(at[first] - reach, words.bounds[row[first]])
                end = np.minimum(at[last - 1] + reach, words.bounds[row[first] + 1])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(row[first])),
                        pa.array(begin - words.bounds[row[first]]),
                        pa.array([words.hashes[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(key.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(at - np.repeat(begin, last - first))),
                    ],
                    ["doc_id", "begin", "tokens", "hashes", "places"],
                )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, begin, run, item, n, tokens, shift, places in zip(*[batch.column(c) for c in ("doc_id", "begin", "tokens", "item_id", "n", "item_tokens", "shift", "places")], strict=True):
                run, tokens = np.frombuffer(run.as_buffer(), np.uint64), np.frombuffer(tokens.as_buffer(), np.uint64)
                shift = shift.as_py()
                lo, hi = max(0, shift), min(len(run), shift + len(tokens))
                best = _best_stretch(run[lo:hi] == tokens[lo - shift : hi - shift], [p - lo for p in places.as_py()], identity)
                need = min(least_overlap, n.as_py() - (n.as_py() < least_overlap))
                if best and best[1] >= need:
                    out.append((doc.as_py(), item.as_py(), begin.as_py() + lo + best[0], best[1], best[2], best[2] / n.as_py()))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start", "length", "matched", "share"])

    runs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        seek, "doc_id long, begin long, tokens binary, hashes array<long>, places array<long>"
    )
    runs = durable(runs.withColumn("run", F.monotonically_increasing_id()), "runs")
    hits = runs.select("run", F.explode(F.arrays_zip("hashes", "places")).alias("h")).select("run", F.col("h.hashes").alias("hash"), F.col("h.places").alias("place"))
    shifts = hits.join(tests, "hash").groupBy("run", "item_id", (F.col("place") - F.col("at")).alias("shift")).agg(F.collect_set("place").alias("places"))
    item = kept.select("item_id", "n", F.col("tokens").alias("item_tokens"))
    leaks = (
        shifts.join(runs.select("run", "doc_id", "begin", "tokens"), "run")
        .join(item, "item_id")
        .mapInArrow(verify, "doc_id long, item_id long, start long, length long, matched long, share double")
    )
    best = F.max(F.struct("matched", (-F.col("start")).alias("start"), "length", "share")).alias("best")
    return leaks.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.start")).alias("start"), "best.length", "best.matched", "best.share"
    )


def _best_stretch(same: np.ndarray, seeds: list[int], identity: float) -> tuple[int, int, int] | None:
    """(start, length, matches) of the longest stretch through a seed with matches >= identity * length, both ends matching."""
    ones = np.flatnonzero(same)
    if not len(ones):
        return None
    # with matches counted up to each match, a stretch from match a to match b is alike enough
    # if count(b) - count(a) + 1 >= identity * (b - a + 1): compare one potential of either end
    order = np.arange(len(ones))
    rise = order + 1 - identity * (ones + 1)
    fall = order - identity * ones
    least = np.minimum.accumulate(fall)
    a = np.searchsorted(-least, -(rise + 1e-9), side="left")  # the first start whose potential is low enough
    b = np.flatnonzero(a <= order)
    a, seeds = a[b], np.sort(np.asarray(seeds))
    seeded = np.searchsorted(seeds, ones[b], side="right") > np.searchsorted(seeds, ones[a], side="left")
    a, b = a[seeded], b[seeded]
    if not len(b):
        return None
    at = int(np.argmax(ones[b] - ones[a]))
    return int(ones[a[at]]), int(ones[b[at]] - ones[a[at]] + 1), int(b[at] - a[at] + 1)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the rows whose text overlaps a test item (see find_leaks); all columns stay."""
    id_col = options.get("id_col", "doc_id")
    leaked = find_leaks(docs, items, **options).select(F.col("doc_id").alias("openings_leak")).distinct()
    return docs.join(leaked, docs[id_col].cast("long").eqNullSafe(leaked["openings_leak"]), "left_anti")
