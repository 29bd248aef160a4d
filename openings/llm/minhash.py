"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes its set of k-word shingles (64-bit hashes), a 128-bit
   digest of the sorted set and a MinHash signature.  Rows with one digest are
   one node, so that exact copies cost one row from here on; nodes are numbered
   once, when their table is written.
2. Signatures are cut into bands; nodes that agree on a band meet in a bucket.
   Bands are chosen so that a pair at the threshold shares none with at most
   `miss` probability.  No bucket ever emits its pairs: each member is paired
   with the bucket's smallest node only (linear in the bucket).
3. Candidate pairs are compared one batch of signature places after another,
   and dropped as soon as the posterior probability that their similarity
   reaches the threshold falls below `miss` (uniform prior, Beta posterior).
4. Survivors are confirmed on their full sets, the likeliest partner of a node
   first; a pair whose ends are already connected needs no confirmation.
5. Buckets that still hold more than one component are compared across their
   components, in numpy blocks of bounded size, with the same sequential test,
   and confirmed likewise.  So every pair that shares a bucket is either
   connected or was tested: nothing is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap, may_be, size_for
from .components import components
from .durable import durable, release
from .words import SPACES, cut_words, shingles

_rng = np.random.default_rng(97)
_MULTIPLY = (_rng.integers(0, 1 << 31, 1024, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, 1024, dtype=np.uint32)

ROWS_A_BAND = 6
BATCH = 32
BLOCK = 512


def bands_for(threshold: float, miss: float, rows: int = ROWS_A_BAND) -> int:
    """Bands of which a pair at the threshold shares none with at most `miss` probability."""
    bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
    per_batch = max(1, math.ceil(bands * rows / BATCH))
    return max(bands, per_batch * BATCH // rows)


@lru_cache
def least_matches(threshold: float, miss: float, places: int, batch: int = BATCH) -> tuple[tuple[int, int], ...]:
    """(n, m): after n compared places a pair with fewer than m matches is dropped.

    Pr[similarity >= threshold | m of n] under a uniform prior is the upper
    tail of Beta(m + 1, n - m + 1).
    """
    grid = np.linspace(0.0005, 0.9995, 1000)
    out = []
    for n in [*range(batch, places, batch), places]:
        need = 0
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(log - log.max())
            if mass[grid >= threshold].sum() / mass.sum() >= miss:
                need = m
                break
        out.append((n, need))
    return tuple(out)


def signatures(values: np.ndarray, bounds: np.ndarray, places: int) -> np.ndarray:
    """MinHash signatures (rows x places) of sets values[bounds[i]:bounds[i+1]], none of them empty.

    A place is the low half of the smallest of 32-bit hashes: equal minima stay
    equal, different ones fall together once in 65536 times, which at worst
    sends a pair to confirmation on its full sets.
    """
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, places), np.uint16)
    for i in range(places):
        out[:, i] = np.minimum.reduceat(x * _MULTIPLY[i] ^ _SHIFT[i], bounds[:-1]).astype(np.uint16)
    return out


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for words in cut_words(texts, SPACES):
        made, bounds = shingles(words, k)
        yield words.first, [np.unique(made[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def shingle_features(docs: DataFrame, id_col: str, text_col: str, k: int, places: int) -> DataFrame:
    """One row a row of docs: id, n_shingles, d1 and d2 (the set's digest; null for an empty set) and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _sets(batch.column(1), k):
                ids = batch.column(0).slice(first, len(sets))
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                digests, signs = [(None, None)] * len(sets), [None] * len(sets)
                if len(full):
                    bounds = np.concatenate([[0], np.cumsum(sizes[full])])
                    made = signatures(np.concatenate([sets[i] for i in full]), bounds, places)
                    for i, row in zip(full, made, strict=True):
                        digests[i] = _digest(sets[i].tobytes())
                        signs[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes), *(pa.array([d[j] for d in digests], pa.int64()) for j in range(2)), pa.array(signs, pa.binary())],
                    ["id", "n_shingles", "d1", "d2", "sign"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, n_shingles long, d1 long, d2 long, sign binary"
    )


def _bands(nodes: DataFrame, bands: int) -> DataFrame:
    width = ROWS_A_BAND * 2
    # the last byte of a bucket's number is its band
    buckets: Column = F.array(*[(F.xxhash64(F.lit(b), F.substring("sign", 1 + b * width, width)).bitwiseAND(F.lit(-256))).bitwiseOR(F.lit(b)) for b in range(bands)])
    return nodes.select("node", F.explode(buckets).alias("bucket"))


def _close(n: str, m: str, threshold: float) -> Column:
    """Sets of these sizes can reach the threshold."""
    return F.least(n, m) >= F.floor(F.greatest(n, m) * F.lit(threshold))


def _possible(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key (long) is among the keys (one column), and some others: a bitmap keeps the rest out of the shuffles.  Null keys go."""
    bits = bitmap(keys, size_for(keys.count()))
    place = rows.columns.index(key)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(place)
            mark = may_be(bits, own.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) & own.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(mark))

    return rows.mapInArrow(keep, rows.schema)


def _sequential(pairs: DataFrame, threshold: float, miss: float, places: int) -> DataFrame:
    """(a, b, matches) of the pairs (a, b, sign_a, sign_b) that no batch of places ruled out."""
    steps = least_matches(threshold, miss, places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, places) for c in ("sign_a", "sign_b")]
            alive, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, need in steps:
                matches[alive] += (signs[0][alive, done:n] == signs[1][alive, done:n]).sum(axis=1)
                alive, done = alive[matches[alive] >= need], n
            keep = pa.array(alive)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(keep), batch.column("b").take(keep), pa.array(matches[alive])], ["a", "b", "matches"]
            )

    return pairs.select("a", "b", "sign_a", "sign_b").mapInArrow(run, "a long, b long, matches long")


def _members(asked: DataFrame, nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, members): the full sets of the asked nodes, made again from a text of theirs.

    The text is found by the node's smallest id (of rows that repeat it with
    other texts the one with the node's set counts), or, where none of the
    node's rows has an id, by the set's digest among the rows without one.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _sets(batch.column(3), k):
                wanted = [batch.column(c).slice(first, len(sets)).to_pylist() for c in range(3)]
                out = [(node, raw) for node, *digest, s in zip(*wanted, sets, strict=True) if len(s) and _digest(raw := s.tobytes()) == tuple(digest)]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.int64()), pa.array([raw for _, raw in out], pa.binary())], ["node", "members"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch.column(0), k):
                raw = [s.tobytes() for s in sets if len(s)]
                found = [_digest(r) for r in raw]
                yield pa.RecordBatch.from_arrays([*(pa.array([d[j] for d in found], pa.int64()) for j in range(2)), pa.array(raw, pa.binary())], ["d1", "d2", "members"])

    wanted = durable(nodes.join(asked.select("node").distinct(), "node").select("node", "rep", "d1", "d2"), "wanted")
    some = _possible(docs, "id", wanted.filter("rep IS NOT NULL").select("rep"))
    made = wanted.join(some, wanted["rep"] == some["id"]).select("node", "d1", "d2", "text").mapInArrow(make, "node long, members binary")
    if not wanted.filter("rep IS NULL").isEmpty():
        nameless = docs.filter("id IS NULL").select("text").mapInArrow(digests, "d1 long, d2 long, members binary")
        # copies without an id are many rows of one digest: one of them goes on
        first = nameless.join(wanted.filter("rep IS NULL"), ["d1", "d2"]).select("node", "members").dropDuplicates(["node"])
        made = made.unionByName(first)
    made = durable(made, "members")  # an id that repeats may give a node twice, which repeats a comparison
    release(wanted)
    return made


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("x", "y")]
            keep = pa.array([i for i, (x, y) in enumerate(zip(*sets, strict=True)) if _linked(x, y, percent)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    members = _members(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs, k)
    x = members.select(F.col("node").alias("a"), F.col("members").alias("x"))
    y = members.select(F.col("node").alias("b"), F.col("members").alias("y"))
    links = durable(pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(test, "a long, b long"), "links")
    release(members)
    return links


def _digest(raw: bytes) -> tuple[int, int]:
    both = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def _survivors(table: pa.Table, threshold: float, steps: tuple, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs (i, j) of different components in one block that no batch of places ruled out, with their matches.

    A block holds at most BLOCK rows of either side; sides "l" and "r" are
    compared with each other, and a block with one side only with itself.  A
    pair that shares an earlier band is left to that band's block.
    """
    side = np.array(table.column("side").to_pylist()) == "r"
    n, comp = table.column("n").to_numpy(), table.column("comp").to_numpy()
    band = table.column("band")[0].as_py()
    sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint16).reshape(-1, places)
    own = np.flatnonzero(~side)
    other = np.flatnonzero(side) if side.any() else own
    low, high = np.minimum(n[own][:, None], n[other][None, :]), np.maximum(n[own][:, None], n[other][None, :])
    i, j = np.nonzero((comp[own][:, None] != comp[other][None, :]) & (low >= np.floor(high * threshold)))
    i, j = own[i], other[j]
    if other is own:
        i, j = i[i < j], j[i < j]
    matches, done = np.zeros(len(i), np.int64), 0
    for upto, need in steps:
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            matches[part] += (sign[i[part], done:upto] == sign[j[part], done:upto]).sum(axis=1)
        alive = matches >= need
        i, j, matches, done = i[alive], j[alive], matches[alive], upto
    before = np.zeros(len(i), bool)
    for b in range(band):
        part = slice(b * ROWS_A_BAND, (b + 1) * ROWS_A_BAND)
        before |= (sign[i, part] == sign[j, part]).all(axis=1)
    return i[~before], j[~before], matches[~before]


def _across(rows: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, miss: float, places: int) -> DataFrame:
    """Confirmed links (a, b) between different components of a block (rows: block, band, side, comp, node, n, sign).

    First the rows with any surviving pair are found; only they get their full
    sets, and then each block confirms its pairs, the likeliest first, leaving
    out pairs that it has connected already.  So neither step puts out more
    than the rows it is given.
    """
    threshold = percent / 100
    steps = least_matches(threshold, miss, places)
    columns = "block long, band int, side string, comp long, node long, n long, sign binary"

    def sift(table: pa.Table) -> pa.Table:
        i, j, _ = _survivors(table, threshold, steps, places)
        return table.take(pa.array(np.union1d(i, j)))

    def confirm(table: pa.Table) -> pa.Table:
        i, j, matches = _survivors(table, threshold, steps, places)
        comp, node = table.column("comp").to_pylist(), table.column("node").to_pylist()
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("members")]
        root = {c: c for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for at in np.argsort(-matches, kind="stable"):
            x, y = int(i[at]), int(j[at])
            p, q = find(comp[x]), find(comp[y])
            if p != q and _linked(sets[x], sets[y], percent):
                root[p] = q
                out.append((node[x], node[y]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    likely = durable(rows.groupBy("block").applyInArrow(sift, columns), "likely")
    members = _members(likely, nodes, docs, k)
    links = durable(likely.join(members, "node").groupBy("block").applyInArrow(confirm, "a long, b long"), "links")
    release(likely, members)
    return links


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    threshold_percent: int = 80,
    miss: float = 1e-4,
) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, kept.

    Rows link when 100 * intersection >= threshold_percent * union of their
    distinct k-word shingles (words are runs of anything but ASCII white
    space, A-Z lower-cased; a text of 1 to k-1 words is one shingle).
    component_id is the smallest id that links reach, the row's own included;
    kept tells whether that is the row's id.

    Null and empty texts have no shingles and link with nothing.  A null id
    takes part in links but is never kept and never a component's id (if
    nothing else is reached, component_id is null).  Rows that repeat an id
    are rows of their own; the id's smallest reach is theirs too only if their
    texts link.  Only id_col and text_col of docs are read, whatever else it
    has.  An empty table gives an empty result.
    """
    threshold = threshold_percent / 100
    bands = bands_for(threshold, miss)
    places = bands * ROWS_A_BAND
    feats = durable(shingle_features(docs, id_col, text_col, k, places), "features")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    nodes = durable(
        feats.filter(F.col("d1").isNotNull())
        .groupBy("d1", "d2")
        .agg(F.min("id").alias("rep"), F.min("n_shingles").alias("n"), F.first("sign").alias("sign"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    slim = durable(feats.drop("sign"), "rows")
    release(feats)
    size = nodes.select("node", "n")

    # the buckets of two nodes or more: each member with its bucket's smallest node
    banded = _bands(nodes, bands)
    least = banded.groupBy("bucket").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("count")).filter("count > 1").select("bucket", "lead")
    shared = durable(banded.join(least, "bucket"), "buckets")
    star = shared.filter("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    star = durable(star.join(size.toDF("a", "n"), "a").join(size.toDF("b", "m"), "b").filter(_close("n", "m", threshold)).select("a", "b"), "star")
    signed = _possible(nodes.select("node", "sign"), "node", star.select(F.explode(F.array("a", "b")).alias("node")))
    tried = durable(
        _sequential(
            star.join(signed.toDF("a", "sign_a"), "a").join(signed.toDF("b", "sign_b"), "b"), threshold, miss, places
        ),
        "tried",
    )
    release(star)
    # the likeliest partner first, the others where that leaves the ends apart
    best = tried.groupBy("b").agg(F.max(F.struct("matches", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    links = _confirm(best, nodes, texts, k, threshold_percent)
    roots = durable(components(links, "a", "b"), "roots")
    rest = durable(_apart(tried.select("a", "b").join(best, ["a", "b"], "left_anti"), roots), "rest")
    if not rest.isEmpty():
        links = links.unionByName(_confirm(rest, nodes, texts, k, threshold_percent))
        roots = durable(components(links, "a", "b"), "roots")

    # buckets that hold several components still
    marked = (
        shared.join(roots.withColumnRenamed("vertex", "node"), "node", "left")
        .select("bucket", "node", F.coalesce("root", "node").alias("comp"))
    )
    shares = marked.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = (
        shares.groupBy("bucket")
        .agg(F.sum("c").alias("rows"), F.max(F.struct("c", "comp")).alias("top"))
        .filter((F.col("rows") > 2) & (F.col("rows") > F.col("top.c")))
        .select("bucket", F.col("top.comp").alias("main"), F.ceil(F.col("top.c") / BLOCK).alias("mains"), F.ceil((F.col("rows") - F.col("top.c")) / BLOCK).alias("others"))
    )
    rows = marked.join(mixed, "bucket").withColumn("is_main", F.col("comp") == F.col("main"))
    piece = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).alias("piece")
    rows = rows.select("*", piece)
    # blocks: every piece of the others with every piece of the main component and of the others
    steps = F.when(F.col("is_main"), F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: F.struct(o.alias("o"), F.col("piece").alias("p"), F.lit("m").alias("kind"), F.lit("r").alias("side")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda p: F.struct(F.col("piece").alias("o"), p.alias("p"), F.lit("m").alias("kind"), F.lit("l").alias("side"))),
            F.transform(F.sequence(F.lit(0), F.col("piece")), lambda p: F.struct(F.col("piece").alias("o"), p.alias("p"), F.lit("o").alias("kind"), F.lit("l").alias("side"))),
            F.transform(F.filter(F.sequence(F.lit(0), F.col("others") - 1), lambda o: o > F.col("piece")), lambda o: F.struct(o.alias("o"), F.col("piece").alias("p"), F.lit("o").alias("kind"), F.lit("r").alias("side"))),
        )
    )
    blocks = rows.select("bucket", "node", "comp", F.explode(steps).alias("at")).select(
        F.xxhash64("bucket", "at.o", "at.p", "at.kind").alias("block"), F.col("bucket").bitwiseAND(F.lit(255)).cast("int").alias("band"), "at.side", "comp", "node"
    )
    signed_blocks = blocks.join(nodes.select("node", "n", "sign"), "node").select("block", "band", "side", "comp", "node", "n", "sign")
    more = _across(signed_blocks, nodes, texts, k, threshold_percent, miss, places)
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = durable(components(links, "a", "b"), "roots")

    rooted = nodes.select("node", "rep", "d1", "d2").join(roots.withColumnRenamed("vertex", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    named = rooted.join(least_id, "root").select("d1", "d2", "component")
    return (
        slim
        .join(named, ["d1", "d2"], "left")
        .select(
            F.col("id").alias("doc_id"),
            "n_shingles",
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"),
        )
    )


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one component."""
    ra, rb = roots.toDF("a", "ra"), roots.toDF("b", "rb")
    return (
        pairs.join(ra, "a", "left").join(rb, "b", "left")
        .filter(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
        .select("a", "b")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row, that of the smallest id, of each group of near-duplicates; all columns stay.

    Options are those of near_duplicates.  Of rows that repeat an id and its
    text one stays (which of them is left open where other columns differ).
    Rows without an id, which nothing can refer to, all stay.
    """
    kept = near_duplicates(docs, id_col, text_col, **options).filter("kept").groupBy(F.col("doc_id").alias("openings_id")).agg(F.count(F.lit(1)).alias("openings_rows"))
    kept = durable(kept, "kept")
    rows = docs.join(kept, docs[id_col].cast("long") == kept["openings_id"])
    single = rows.filter("openings_rows = 1").select(*[docs[c] for c in docs.columns])
    without = docs.filter(F.col(id_col).isNull())
    if kept.filter("openings_rows > 1").isEmpty():
        return single.unionByName(without)
    repeated = rows.filter("openings_rows > 1").select(*[docs[c] for c in docs.columns]).dropDuplicates([id_col, text_col])
    return single.unionByName(repeated).unionByName(without)
