"""Compression of vectors to codes: one codebook a part of the vector, nearest entries by slices and bitmasks.

Finding a part's nearest entry, exactly:

1. Each dimension of a codebook is sorted once, and every prefix of that order
   has a mask with a bit for each of its entries (256 bits, four uint64).
2. A radius selects a range of each dimension, [x - r, x + r], whose entries
   are one prefix mask without another.  The ranges' masks, ANDed over all
   dimensions, leave the entries of a box around the part.
3. The nearest entry of the box is the nearest of all if it lies within r;
   otherwise its distance is the next radius, which then is enough; an empty
   box doubles the radius.  So no entry that could be nearest is ever left out,
   and ties go to the lower index.

The first radius is the median distance of some of a batch's parts to their
nearest entries; a bad one costs another pass, never a wrong result.  Boxes of
few entries are scored pair by pair, others as whole rows.

A round is one pass of Spark over all vectors: tasks give sums and counts by
part and entry (at most 4 x 256 rows each), which Spark adds up; the codebooks
(4 x 256 entries) are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable

PARTS, ENTRIES, ROUNDS = 4, 256, 4
ROWS = 4096
#: Rows of label sums up to which they are broadcast.
SMALL = 100_000


class Codebook:
    """Entries (at most 256, whole numbers) with the prefix masks of each sorted dimension."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, dims = entries.shape
        self.words = -(-n // 64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        bits = np.zeros((n + 1, dims, self.words), np.uint64)
        for rank in range(n):
            bits[rank + 1] = bits[rank]
            entry = order[rank]
            bits[rank + 1, np.arange(dims), entry >> 6] |= np.uint64(1) << (entry & 63).astype(np.uint64)
        self.prefix = bits
        self.norms = (entries * entries).sum(axis=1)

    def box(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks (rows x words) of the entries that differ from x by at most the radius in every dimension."""
        out = np.full((len(x), self.words), ~np.uint64(0))
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, side="left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, side="right")
            out &= self.prefix[high, d] ^ self.prefix[low, d]
        return out

    def members(self, masks: np.ndarray) -> np.ndarray:
        """The masks as booleans (rows x entries)."""
        return np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(len(masks), -1), axis=1, bitorder="little")[:, : len(self.entries)].view(bool)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of all x to all entries."""
        return (x * x).sum(axis=1)[:, None] - 2 * self.products(x) + self.norms

    def products(self, x: np.ndarray) -> np.ndarray:
        # doubles are exact below 2^53, and then much faster
        most = int(np.abs(x).max(initial=0)) * int(np.abs(self.entries).max(initial=0)) * x.shape[1]
        if most < 1 << 53:
            return (x.astype(np.float64) @ self.entries.T.astype(np.float64)).astype(np.int64)
        return x @ self.entries.T

    def _best(self, x: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest member of each row's box, none of them empty."""
        rows, entry = np.nonzero(inside)
        if len(rows) * 4 > inside.size:
            far = np.where(inside, self.distances(x), np.iinfo(np.int64).max)
            best = far.argmin(axis=1)
            return best, far[np.arange(len(x)), best]
        gap = x[rows] - self.entries[entry]
        far = np.einsum("ij,ij->i", gap, gap)
        starts = np.searchsorted(rows, np.arange(len(x)))
        least = np.minimum.reduceat(far, starts)
        at = np.minimum.reduceat(np.where(far == least[rows], entry, len(self.entries)), starts)
        return at, least

    def nearest(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each x, ties to the lower index, and its squared distance; the first radius may be any."""
        best, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        left, r = np.arange(len(x)), np.full(len(x), max(1, radius), np.int64)
        while len(left):
            inside = self.members(self.box(x[left], r[left]))
            full = inside.any(axis=1)
            r[left[~full]] *= 2
            some = left[full]
            entry, far = self._best(x[some], inside[full])
            sure = far <= r[some] ** 2
            best[some[sure]], least[some[sure]] = entry[sure], far[sure]
            r[some[~sure]] = _root(far[~sure])
            left = np.concatenate([left[~full], some[~sure]])
        return best, least

    def first_radius(self, x: np.ndarray) -> int:
        some = x[:: max(1, len(x) // 64)]
        return int(_root(np.median(self.distances(some).min(axis=1)).astype(np.int64)[None])[0])


def _root(squares: np.ndarray) -> np.ndarray:
    """The least whole numbers whose squares aren't below."""
    root = np.ceil(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    root += root * root < squares
    return np.where((root - 1) ** 2 >= squares, root - 1, root)


def _whole(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).astype(np.int64).reshape(-1, dims)


def _usable(vec: str, dims: int, scale: int) -> Column:
    """Vectors of that length without null or non-finite components, whose distances fit a long."""
    most = int((2**62 / dims) ** 0.5 / 2)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * F.lit(float(scale))) >= F.lit(float(most))))
    return F.col(vec).isNotNull() & (F.size(vec) == dims) & ~F.coalesce(bad, F.lit(True))


def _dims(vectors: DataFrame, parts: int) -> int:
    """The components of the vectors: those of the smallest id among vectors that can be cut into parts; 0 if there are none."""
    whole = F.size("vec") % parts == 0
    finite = ~F.coalesce(F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(True))
    first = vectors.filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & whole & finite).orderBy(F.col("vec_id").asc_nulls_last(), "vec").select(F.size("vec")).first()
    return first[0] if first else 0


def train_codebooks(vectors: DataFrame, dims: int, scale: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One array (entries x dims / parts) a part, after so many rounds over all usable vectors (vec_id, vec)."""
    width = dims // parts
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    seeds = np.floor(scale * np.array([r.vec for r in start], np.float64)).astype(np.int64)
    books = [np.ascontiguousarray(seeds[:, p * width : (p + 1) * width]) for p in range(parts)]
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    for _ in range(rounds):

        def assign(batches: Iterator[pa.RecordBatch], own=tuple(books)) -> Iterator[pa.RecordBatch]:
            made = [Codebook(b) for b in own]
            count, total = np.zeros((parts, len(own[0])), np.int64), np.zeros((parts, len(own[0]), width), np.int64)
            for batch in batches:
                for first in range(0, batch.num_rows, ROWS):
                    x = _whole(batch.column(0).slice(first, ROWS), dims, scale)
                    for p, book in enumerate(made):
                        part = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                        best, _ = book.nearest(part, book.first_radius(part))
                        count[p] += np.bincount(best, minlength=len(book.entries))
                        np.add.at(total[p], best, part)
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "count", "sums"])

        found = vectors.select("vec").mapInArrow(assign, "part int, entry int, count long, sums array<long>")
        books = [b.copy() for b in books]
        for r in found.groupBy("part", "entry").agg(F.sum("count").alias("count"), *sums).collect():  # at most parts * entries rows
            books[r.part][r.entry] = [int(r[f"s{i}"]) // r["count"] for i in range(width)]
    return books


def books_digest(books: list[np.ndarray]) -> str:
    """Lowercase hex sha256 of all components, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], scale: int) -> DataFrame:
    """vectors with code (two hex digits a part) and error (squared distance to the code's entries) in place of vec."""
    parts, width = len(books), books[0].shape[1]
    kept = [c for c in vectors.columns if c != "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(b) for b in books]
        digits = np.array([f"{e:02x}" for e in range(256)])
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                some = batch.slice(first, ROWS)
                x = _whole(some.column("vec"), parts * width, scale)
                code, error = np.full(len(x), "", "U2"), np.zeros(len(x), np.int64)
                for p, book in enumerate(made):
                    part = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                    best, far = book.nearest(part, book.first_radius(part))
                    code, error = np.char.add(code, digits[best]), error + far
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), pa.array(code.tolist(), pa.string()), pa.array(error)], [*kept, "code", "error"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema if f.name != "vec")
    return vectors.mapInArrow(run, f"{schema}, code string, error long")


def decode(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The whole components that a code stands for."""
    return np.concatenate([b[int(code[2 * p : 2 * p + 2], 16)] for p, b in enumerate(books)])


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 1024, rounds: int = ROUNDS) -> DataFrame:
    """One row a usable vector: vec_id, code, error, label_error, codebooks_sha256.

    Components become floor(scale * x).  Vectors are cut into four equal
    consecutive parts, and the codebooks start as the parts of the 256 smallest
    ids (ties by the vector, null ids last; fewer rows, fewer entries); see
    train_codebooks.  label_error is the error summed over rows with the label,
    null being a label.

    Vectors that are null, hold null or non-finite components, aren't as long
    as that of the smallest id (which a length that four divides must have), or
    hold components so large that an error wouldn't fit a long (2^17 at 64
    components and scale 1024), take no part.  Rows that repeat an id, or an id
    and its vector, are rows of their own.  Only the three columns are read.  An
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))
    dims = _dims(rows.select("vec_id", "vec"), PARTS)
    usable = rows.filter(_usable("vec", dims, scale)) if dims else None
    if usable is None or usable.isEmpty():
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = train_codebooks(usable.select("vec_id", "vec"), dims, scale, rounds=rounds)
    coded = durable(encode(usable, books, scale), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    few = sums.count() <= SMALL
    sums = sums.select(F.col("label").alias("other"), "label_error")
    out = coded.join(F.broadcast(sums) if few else sums, coded["label"].eqNullSafe(F.col("other")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
