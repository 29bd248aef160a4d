"""Mixing sources to target weights, in fixed-length blocks of words.

Each source's documents, in a fixed order, are one run of words that is cut
evenly into blocks of at most `block_words` (a small source into shorter ones,
so that `least_blocks` of them come near any target).  A source's share of the
mix is a number of block draws.  Each output shard holds the same number of
blocks; how many of them come from each source is drawn, shard by shard, by
multinomial counts over what the sources have left of their draws.  The k-th draw of a source takes block perm(k mod n) where perm is a
pseudorandom permutation of the source's n block numbers that is keyed by
source and epoch, so a block is taken floor(k/n) or ceil(k/n) times.  Blocks
are then joined by (source, block).

The driver sees one row a source (name and size), nothing else; counts are
drawn where Spark holds the sources, and no number of draws is too large.
Offsets of documents within a source are prefix sums in two levels (hashed
chunks of a source, then the chunks' totals), so a source that holds a third
of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

WORD = r"[^\x20\x09-\x0D]+"
RANGE = 1 << 16


def word_count(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words to take of each source: share * all sizes by (repeating) weight, none above most * its size.

    What a source can't hold is shared among the others by weight, again until
    none is above.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    total, fixed, open_ = share * sum(sizes), {}, set(range(len(sizes)))
    while open_:
        left, sum_ = total - sum(fixed.values()), sum(weight[i] for i in open_)
        over = [i for i in open_ if left * weight[i] / sum_ > most * sizes[i]]
        if not over:
            return [fixed[i] if i in fixed else left * weight[i] / sum_ for i in range(len(sizes))]
        fixed |= {i: most * sizes[i] for i in over}
        open_ -= set(over)
    return [fixed[i] for i in range(len(sizes))]


def permute(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1 at k: a Feistel network on the next even power of two, walked back into range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = k.astype(np.uint64), np.ones(len(k), bool)
    while todo.any():
        x, h, m, s = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for i in range(4):
            f = (right + s + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & m)
        out[todo] = (left << h) | right
        todo = out >= n.astype(np.uint64)
    return out.astype(np.int64)


def _halve(left: np.ndarray, blocks: int, seed: list[int]) -> np.ndarray:
    """Of `left` blocks of each source a random choice of so many in all: multinomial counts over what the sources have left."""
    rng, total = np.random.default_rng(seed), int(left.sum())
    if total < 10**9:
        return rng.multivariate_hypergeometric(left, blocks, method="marginals")
    # beyond what the exact draw takes: a binomial a source, then evened out to the number asked for
    out = rng.binomial(left, blocks / total)
    off = blocks - int(out.sum())
    room = left - out if off > 0 else out
    step = np.minimum(room, (room * (abs(off) / int(room.sum()))).astype(np.int64))
    step[np.argsort(-room, kind="stable")[:1]] += abs(off) - int(step.sum())
    return out + np.sign(off) * step


def shard_counts(draws: np.ndarray, shard_blocks: int, seed: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, blocks of each source in it, blocks of each source in earlier shards) of the shards low..high-1.

    Every shard but the last has shard_blocks blocks, and its sources are drawn
    from what each has left.  The draw halves a range of shards again and again,
    keyed by the range, so that any shard is found in a logarithmic number of
    draws, alike in every task.
    """
    total = int(draws.sum())

    def part(a: int, b: int, own: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if b <= low or a >= high:
            return
        if b - a == 1:
            yield a, own, before
            return
        mid = (a + b) // 2
        left = _halve(own, (mid - a) * shard_blocks, [seed, a, b])
        yield from part(a, mid, left, before)
        yield from part(mid, b, own - left, before + left)

    if total:
        yield from part(0, -(-total // shard_blocks), draws, np.zeros(len(draws), np.int64))


def block_count(size: int, block_words: int, least_blocks: int) -> int:
    return max(-(-size // block_words), min(size, least_blocks))


@dataclass
class Mix:
    """sources: source, source_no, source_size, blocks, short (words of a short block), long (number of blocks one word longer), target, draws.
    rows: row columns with size, source_no and at (the row's first word within its source; null without words).
    pieces: source_no, block, at (the row's), first (word within the row), words - a block's parts.
    slots: shard, slot, source_no, epoch, block - the mix.
    """

    sources: DataFrame
    rows: DataFrame
    pieces: DataFrame
    slots: DataFrame


def _block_of(word: Column) -> Column:
    """The block of a word of its source: the first `long` blocks have short + 1 words, the others `short`."""
    longer = F.col("long") * (F.col("short") + 1)
    return F.when(word < longer, F.floor(word / (F.col("short") + 1))).otherwise(F.col("long") + F.floor((word - longer) / F.col("short"))).cast("long")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 128,
    least_blocks: int = 32,
    shard_blocks: int = 4096,
    seed: int = 11,
    carry: tuple[str, ...] = (),
) -> Mix:
    """Plan the mix of all rows of docs; see Mix.

    Sources stand in code-point order, null last, and weigh `weights` in turn.
    There is a shard for every `shard_blocks` draws.  Null and empty texts have
    size 0 and are never taken.  Rows that repeat an id are rows of their own.
    A source's order is that of (hash of id, text and size, id, size, text
    hash), so reruns agree whatever the partitioning.  Columns other than the
    named ones (and `carry`, kept in rows) aren't read.  An empty table gives
    an empty plan.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
        *[F.col(c).alias(f"carry_{c}") for c in carry],
    )
    base = durable(base, "sizes")
    # one row a source
    found = sorted(
        base.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: (r.source is None, (r.source or "").encode())
    )
    sizes = [r["size"] for r in found]
    want = targets(sizes, weights, share, most)
    blocks = [block_count(s, block_words, least_blocks) for s in sizes]
    draws = [min(int(most * n), round(t * n / s)) if s else 0 for t, n, s in zip(want, blocks, sizes, strict=True)]
    sources = spark.createDataFrame(
        [(r.source, i, s, n, s // n if n else 0, s % n if n else 0, t, k) for i, (r, s, n, t, k) in enumerate(zip(found, sizes, blocks, want, draws, strict=True))],
        "source string, source_no int, source_size long, blocks long, short long, long long, target double, draws long",
    )
    shards = max(1, -(-sum(draws) // shard_blocks))

    drawn, counted = np.array(draws, np.int64), np.array(blocks, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for shard, got, before in shard_counts(drawn, shard_blocks, seed, int(own.min()), int(own.max()) + 1) if len(own) else ():
                used = np.flatnonzero(got)
                columns = [np.full(len(used), shard, np.int32), used.astype(np.int32), before[used], got[used], counted[used], (np.cumsum(got) - got)[used]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "source_no", "first", "count", "blocks", "slot"])

    tasks = max(1, min(shards // 64, 4096))  # shards of a task stand side by side
    planned = spark.range(0, shards if sum(draws) else 0, 1, tasks).mapInArrow(deal, "shard int, source_no int, first long, count long, blocks long, slot long")
    ranges = planned.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(RANGE).cast("long"))).alias("skip"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, slot, s, first, count, n, skip in zip(*[batch.column(c).to_pylist() for c in ("shard", "slot", "source_no", "first", "count", "blocks", "skip")], strict=True):
                k = np.arange(first + skip, first + min(count, skip + RANGE))
                epoch, place = k // n, k % n
                key = np.uint64((seed * 0x9E3779B1 + s * 0x85EBCA77C2B2AE63) % (1 << 64)) ^ (epoch.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                at = permute(place, np.full(len(k), n), key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), shard, np.int32)), pa.array(slot + k - first), pa.array(np.full(len(k), s, np.int32)), pa.array(epoch), pa.array(at)],
                    ["shard", "slot", "source_no", "epoch", "block"],
                )

    slots = ranges.repartition("shard", "source_no", "skip").mapInArrow(run, "shard int, slot long, source_no int, epoch long, block long")

    # chunks of about 2000 rows, at most 2^20
    chunks = min(1 << 20, max(64, sum(r["rows"] for r in found) // 2000))
    chunk = F.pmod(F.xxhash64("id", "text_key", "size"), F.lit(chunks)).alias("chunk")
    numbered = base.join(sources.select("source", "source_no", "short", "long"), base["source"].eqNullSafe(sources["source"])).drop(sources["source"]).select("*", chunk)
    inside = Window.partitionBy("source_no", "chunk").orderBy("id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        numbered.groupBy("source_no", "chunk").agg(F.sum("size").alias("sum"))
        .withColumn("before", F.coalesce(F.sum("sum").over(Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("source_no", "chunk", "before")
    )
    rows = (
        numbered.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(sums, ["source_no", "chunk"])
        .withColumn("at", F.when(F.col("size") > 0, F.col("before") + F.col("within")))
        .drop("chunk", "before", "within", "text_key")
    )
    start = lambda b: b * F.col("short") + F.least(b, F.col("long"))
    pieces = (
        rows.filter("size > 0")
        .select("source_no", "at", "size", "short", "long", F.explode(F.sequence(_block_of(F.col("at")), _block_of(F.col("at") + F.col("size") - 1))).alias("block"))
        .select(
            "source_no", "block", "at",
            (F.greatest("at", start(F.col("block"))) - F.col("at")).alias("first"),
            (F.least(F.col("at") + F.col("size"), start(F.col("block") + 1)) - F.greatest("at", start(F.col("block")))).alias("words"),
        )
    )
    return Mix(sources, rows, pieces, slots)


def taken_words(mix: Mix) -> DataFrame:
    """One row a row of docs: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    times = mix.slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = (
        mix.pieces.join(times.hint("merge"), ["source_no", "block"])  # the planner takes the slots for as small as their plan
        .groupBy("source_no", "at").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    )
    return (
        mix.rows.join(taken, ["source_no", "at"], "left")
        .join(mix.sources.select("source_no", "source_size", "target"), "source_no")
        .select(
            F.col("id").cast("long").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"
        )
    )


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: shard, slot, source, epoch, block, words, doc_ids, text - one row a slot.

    A block's text is its documents' words in order with what stands between
    them; parts of different documents are separated by a blank line.  Nulls,
    repeated rows and empty tables are answered as in mix_sources.
    """
    mix = mix_sources(docs, id_col, source_col, text_col, carry=(text_col,), **options)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(WORD)
        for batch in batches:
            no, at, ids, text, short, longer = (batch.column(c).to_pylist() for c in ("source_no", "at", "id", "text", "short", "long"))
            out: list[tuple] = []
            for n, a, i, t, q, r in zip(no, at, ids, text, short, longer, strict=True):
                block, first, begin, w, last = None, 0, 0, 0, None
                for w, m in enumerate(word.finditer(t), a):
                    own = w // (q + 1) if w < r * (q + 1) else r + (w - r * (q + 1)) // q
                    if own != block:
                        if block is not None:
                            out.append((n, block, first, i, w - first, t[begin:last]))
                        block, first, begin = own, w, m.start()
                    last = m.end()
                if block is not None:
                    out.append((n, block, first, i, w + 1 - first, t[begin:last]))
                if len(out) >= 5000:
                    yield _record(out)
                    out = []
            yield _record(out)

    parts = (
        mix.rows.filter("size > 0")
        .select("source_no", "at", F.col("id").cast("long").alias("id"), F.col(f"carry_{text_col}").alias("text"), "short", "long")
        .mapInArrow(cut, "source_no int, block long, at long, id long, words long, text string")
    )
    whole = parts.groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct("at", "id", "words", "text"))).alias("p")).select(
        "source_no", "block",
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("words"),
        F.transform("p", lambda x: x["id"]).alias("doc_ids"),
        F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"),
    )
    return (
        mix.slots.hint("merge").join(whole, ["source_no", "block"])
        .join(mix.sources.select("source_no", "source"), "source_no")
        .select("shard", "slot", "source", "epoch", "block", "words", "doc_ids", "text")
    )


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["source_no", "block", "at", "id", "words", "text"]
    )
