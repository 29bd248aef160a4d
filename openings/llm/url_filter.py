"""URL filters with a Bloom filter cascade.

A cascade answers membership of listed keys exactly for every key of a known
universe: level 1 is a Bloom filter of the listed keys, level 2 of the
universe's keys that level 1 takes wrongly, level 3 of the listed keys that
level 2 takes wrongly, and so on until none is left.  A key is listed if the
first level that lacks it is an even one.

Here the universe is all (host suffix, path prefix) keys of the urls at hand;
rules are listed keys.  One cascade tells rules from other keys, a second one
block rules from allow rules.  Urls are then judged where they stand, without
a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import packed
from .durable import durable

#: A cascade larger than this isn't broadcast; the listed keys are joined instead.
MAX_BYTES = 64 << 20
FIRST_BITS, FIRST_HASHES = 15, 10
LATER_BITS, LATER_HASHES = 2, 1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Cascade:
    """levels: (bitmap's bytes, number of bits, hashes)."""

    levels: tuple[tuple[np.ndarray, int, int], ...]

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for x, _, _ in self.levels)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        todo = np.arange(len(h1))
        for i, (bitmap, bits, hashes) in enumerate(self.levels):
            inside = _inside(bitmap, h1[todo], h2[todo], bits, hashes, i)
            out[todo[~inside]] = i % 2 == 1
            todo = todo[inside]
        out[todo] = len(self.levels) % 2 == 1
        return out


def _places(h1: np.ndarray, h2: np.ndarray, bits: int, hashes: int, level: int) -> Iterator[np.ndarray]:
    h1, h2 = h1.astype(np.uint64), h2.astype(np.uint64) | np.uint64(1)
    for j in range(hashes):
        x = (h1 ^ np.uint64(((level + 1) * 0x9E3779B97F4A7C15) % (1 << 64))) + h2 * np.uint64(j + 1 + 31 * level)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        yield (x ^ (x >> np.uint64(29))) % np.uint64(bits)


def _inside(bitmap: np.ndarray, h1: np.ndarray, h2: np.ndarray, bits: int, hashes: int, level: int) -> np.ndarray:
    out = np.ones(len(h1), bool)
    for at in _places(h1, h2, bits, hashes, level):
        out &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _bitmap(keys: DataFrame, bits: int, hashes: int, level: int) -> np.ndarray:
    """Bits of all keys (h1, h2), put together in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(list(_places(h1, h2, bits, hashes, level)))).astype(np.int64))], ["slot"])

    return packed(keys.select("h1", "h2").mapInArrow(run, "slot long"), bits)


def keyed(df: DataFrame, key: str = "key") -> DataFrame:
    """df with the two hashes of its key."""
    return df.select("*", F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"))


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """The cascade of listed.key over universe.key (both distinct); None if its first level would pass max_bytes.

    Keys of the universe that aren't listed are held apart from the listed ones
    exactly; listed keys outside the universe are kept too.
    """
    members = durable(keyed(listed.select("key").distinct()), "listed")
    others = keyed(universe.select("key").distinct().join(members.select("key"), "key", "left_anti"))
    levels: list[tuple[np.ndarray, int, int]] = []
    inside, outside = members, others
    count = inside.count()
    while count:
        per, hashes = (FIRST_BITS, FIRST_HASHES) if not levels else (LATER_BITS, LATER_HASHES)
        bits = 64 * max(2, math.ceil(count * per / 64))
        if sum(x.nbytes for x, _, _ in levels) + bits // 8 > max_bytes:
            return None
        if len(levels) == 64:
            raise ValueError("keys that no hash holds apart")
        bitmap, level = _bitmap(inside, bits, hashes, len(levels)), len(levels)
        levels.append((bitmap, bits, hashes))

        def passed(batches: Iterator[pa.RecordBatch], bitmap=bitmap, bits=bits, hashes=hashes, level=level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_inside(bitmap, batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), bits, hashes, level)))

        # what this level takes wrongly is what the next one lists
        inside, outside = durable(outside.select("key", "h1", "h2").mapInArrow(passed, "key string, h1 long, h2 long"), "level"), inside
        count = inside.count()
    return Cascade(tuple(levels))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ://, up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end.  Both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Keys host suffix + path prefix, the longest first; suffixes of at most `labels` labels, prefixes of the lengths at hand."""
    parts = F.split(host, r"\.", -1)
    most = F.least(F.size(parts), F.lit(labels))
    suffixes = F.when(host != "", F.transform(F.sequence(F.lit(1), most), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))).otherwise(
        F.array().cast("array<string>")
    )
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\x00"), p))))
    return F.array_sort(both, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """One row a row of pages: page_id, host, path, rule, verdict.

    rules: (verdict, host, path), verdict "allow" or "block", as a list or as a
    DataFrame of these columns, which no driver needs to hold.  A rule fits its
    host and all subdomains where the url's path starts with the rule's; the
    longest (host and path together, then the smaller string) wins.  rule is
    host + path of the winner, else null, and the verdict is then `default`.
    Of rules with one host and path the last of a list counts, of a DataFrame
    the one that blocks.  Rules with a null column don't count.

    Null urls and urls without :// have an empty host and path, fit no rule
    and get the default.  Repeated rows and null ids are each answered.  Other
    columns aren't read; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(v, h, p) for (h, p), v in {(h, p): v for v, h, p in rules}.items()], "verdict string, host string, path string")
    listed = rules.dropna(subset=["verdict", "host", "path"]).groupBy(F.concat("host", F.lit("\x00"), "path").alias("key")).agg(F.max("verdict").alias("verdict"))
    shapes = rules.select((F.size(F.split("host", r"\.", -1))).alias("labels"), F.length("path").alias("length")).dropna().distinct().collect()  # as many as hosts have labels times paths' lengths
    labels = max((r.labels for r in shapes), default=1)
    lengths = sorted({r.length for r in shapes}, reverse=True)
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    split = split.select("*", candidate_keys(F.col("host"), F.col("path"), labels, lengths).alias("keys"))
    universe = split.select(F.explode("keys").alias("key")).distinct()
    rule_cascade = build_cascade(listed, universe, max_bytes)
    block_cascade = build_cascade(listed.filter("verdict = 'block'"), listed, max_bytes) if rule_cascade else None
    if not rule_cascade or not block_cascade:  # beyond the size bound: the same keys by a join
        numbered = durable(split.withColumn("row", F.monotonically_increasing_id()), "urls")
        found = numbered.select("page_id", "host", "path", "row", F.posexplode_outer("keys").alias("pos", "key")).join(listed, "key", "left")
        best = found.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.min(F.when(F.col("verdict").isNotNull(), F.struct("pos", "key", "verdict"))).alias("best"))
        return best.select("page_id", "host", "path", F.replace("best.key", F.lit("\x00"), F.lit("")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    shipped = spark.sparkContext.broadcast((rule_cascade.levels, block_cascade.levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rule, by_block = map(Cascade, shipped.value)
        for batch in batches:
            lists, h1, h2 = batch.column("keys"), batch.column("h1"), batch.column("h2")
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            h1, h2 = h1.flatten().to_numpy(zero_copy_only=False), h2.flatten().to_numpy(zero_copy_only=False)
            keys = lists.flatten()
            hits = np.flatnonzero(by_rule.listed(h1, h2))
            rows, first = np.unique(row[hits], return_index=True)  # the longest stands first
            chosen = hits[first]
            blocked = by_block.listed(h1[chosen], h2[chosen])
            at = np.full(batch.num_rows, -1)
            at[rows] = chosen
            verdict = np.full(batch.num_rows, default, dtype=object)
            verdict[rows] = np.where(blocked, "block", "allow")
            rule = keys.take(pa.array(np.where(at >= 0, at, 0), mask=at < 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), rule, pa.array(verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    hashed = split.select(
        "page_id", "host", "path", "keys",
        F.transform("keys", lambda k: F.xxhash64(F.lit(1), k)).alias("h1"),
        F.transform("keys", lambda k: F.xxhash64(F.lit(2), k)).alias("h2"),
    )
    judged = hashed.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
    return judged.withColumn("rule", F.replace("rule", F.lit("\x00"), F.lit("")))
