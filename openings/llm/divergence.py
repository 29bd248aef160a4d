"""Audit of how the sources of a language differ in their terms.

1. Counting.  Each task cuts its texts into terms (runs of letters and
   non-ASCII characters, A-Z lower-cased) over the Arrow column's bytes.  Terms
   are bucketed by length: up to 8 bytes they are packed into one uint64, up
   to 16 into two (big-endian, zero-padded: no term holds a zero byte, so the
   packing is exact), and both kinds are radix-sorted, 16 bits a pass, and
   run-counted in numpy; longer ones are byte-sorted in a bucket of their own
   for each length.  What leaves a task is one row for each
   (group, term) of it, with its number of occurrences and of documents; what
   a task holds is merged whenever it grows beyond `HELD` runs.
2. Terms in at least `least_docs` documents of a language are kept.  Shares
   are whole billionths (integral division, exact at any count).
3. Divergences of pairs of sources are summed a block of terms and a pair of
   source tiles at a time: a dense matrix of at most 256 sources a side and
   some `BLOCK` cells, whatever the number of terms or sources.  Terms that
   neither tile holds all add the same number and are counted, not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable
from .words import cut_words

#: Terms are runs of letters (a-z after lower-casing) and non-ASCII bytes.
NOT_TERM = np.ones(256, bool)
NOT_TERM[0x61:0x7B] = False
NOT_TERM[0x80:] = False

#: Runs that a task holds before it merges them.
HELD = 1 << 19
#: Bytes of longer terms that a task holds before it gives them up.
LONG_BYTES = 1 << 24
TILE = 256
BLOCK = 1 << 18
BILLION = 10**9


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by unsigned columns, the first the most significant: counting passes of 16 bits, constant digits left out."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        column = column.astype(np.uint64)
        differ = int(np.bitwise_or.reduce(column ^ column[0])) if len(column) else 0
        for shift in range(0, 64, 16):
            if differ >> shift & 0xFFFF:
                digit = ((column >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16 bits by radix
    return order


def _first_of_runs(columns: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
    return new


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int) -> list[np.ndarray]:
    """Terms of at most 8 * words bytes as so many big-endian uint64 each."""
    lengths, out = ends - starts, []
    for first in range(0, 8 * words, 8):
        word = np.zeros(len(starts), np.uint64)
        for place in range(first, first + 8):
            byte = data[np.minimum(starts + place, len(data) - 1)]
            byte[lengths <= place] = 0
            word = (word << np.uint64(8)) | byte
        out.append(word)
    return out


class Runs:
    """Occurrences and documents by (group, term) of one length bucket, merged when they become many."""

    def __init__(self, words: int):
        self.words, self.parts, self.held = words, [], 0

    def add(self, group: np.ndarray, row: np.ndarray, terms: list[np.ndarray]) -> None:
        """Terms of rows in order; a row belongs to one group and is added once."""
        if not len(group):
            return
        keys = [group.astype(np.uint64), *terms]
        order = radix_order(keys)  # stable: rows stay in order within a run
        keys, row = [k[order] for k in keys], row[order]
        new = _first_of_runs(keys)
        starts = np.flatnonzero(new)
        fresh = new.copy()
        fresh[1:] |= row[1:] != row[:-1]
        self._put([k[starts] for k in keys], np.diff(np.append(starts, len(row))), np.add.reduceat(fresh.astype(np.int64), starts))

    def _put(self, keys: list[np.ndarray], count: np.ndarray, docs: np.ndarray) -> None:
        self.parts.append((keys, count, docs))
        self.held += len(count)

    def merge(self) -> None:
        if len(self.parts) < 2:
            return
        keys = [np.concatenate(k) for k in zip(*(p[0] for p in self.parts), strict=True)]
        count, docs = (np.concatenate([p[i] for p in self.parts]) for i in (1, 2))
        order = radix_order(keys)
        keys = [k[order] for k in keys]
        starts = np.flatnonzero(_first_of_runs(keys))
        self.parts, self.held = [], 0
        self._put([k[starts] for k in keys], np.add.reduceat(count[order], starts), np.add.reduceat(docs[order], starts))

    def take(self) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray] | None:
        """(group, term, count, docs) of all that is held, which is then let go."""
        self.merge()
        if not self.parts:
            return None
        (group, *words), count, docs = self.parts[0]
        raw = np.stack(words, axis=1).astype(">u8").view(np.uint8)
        raw = raw.reshape(len(count), -1)
        lengths = (raw != 0).sum(axis=1)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        body = raw[raw != 0]
        self.parts, self.held = [], 0
        return group.astype(np.int64), _strings(offsets, body), count, docs


class LongRuns(Runs):
    """The same for longer terms: byte-sorted, a bucket for each length."""

    def add(self, group: np.ndarray, row: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        lengths = ends - starts
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            cells = np.empty((len(at), length), np.uint8)
            for i, start in enumerate(starts[at]):
                cells[i] = data[start : start + length]
            term = cells.view(f"S{length}").ravel()
            order = np.lexsort((term, group[at]))  # stable: rows stay in order within a run
            g, t, r = group[at][order], term[order], row[at][order]
            new = _first_of_runs([g, t])
            fresh = new.copy()
            fresh[1:] |= r[1:] != r[:-1]
            begin = np.flatnonzero(new)
            self.parts.append((g[begin].astype(np.int64), t[begin], np.diff(np.append(begin, len(t))), np.add.reduceat(fresh.astype(np.int64), begin)))
            self.held += len(begin) * int(length)

    def take(self) -> list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
        """Parts as they are; the shuffle merges them."""
        out = []
        for group, term, count, docs in self.parts:
            width = term.dtype.itemsize
            out.append((group, _strings(np.arange(len(term) + 1, dtype=np.int64) * width, np.frombuffer(term.tobytes(), np.uint8)), count, docs))
        self.parts, self.held = [], 0
        return out


def _strings(offsets: np.ndarray, body: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))).cast(pa.string())


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, count, docs): occurrences and documents of every term in every group, summed over all rows.

    Null text, lang and source count as ''.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[str, str], int] = {}
        short, pair, long = Runs(1), Runs(2), LongRuns(0)

        def out(parts: list) -> Iterator[pa.RecordBatch]:
            names = list(codes)
            langs, sources = (pa.array([n[i] for n in names], pa.string()) for i in range(2))
            for group, term, count, seen in filter(None, parts):
                at = pa.array(group)
                yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), term, pa.array(count, pa.int64()), pa.array(seen, pa.int64())], ["lang", "source", "term", "count", "docs"])

        for batch in batches:
            names = [tuple(x) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            own = np.array([codes.setdefault(n, len(codes)) for n in names], np.int64)
            for words in cut_words(batch.column(0), NOT_TERM, hashed=False):
                row = words.row()
                group = own[words.first + row]
                length = words.ends - words.starts
                for runs, low, high in ((short, 0, 8), (pair, 8, 16)):
                    at = np.flatnonzero((length > low) & (length <= high))
                    runs.add(group[at], row[at], packed(words.data, words.starts[at], words.ends[at], runs.words))
                at = np.flatnonzero(length > 16)
                long.add(group[at], row[at], words.data, words.starts[at], words.ends[at])
                for runs in (short, pair):
                    if runs.held > HELD:
                        runs.merge()
                        if runs.held > HELD // 2:
                            yield from out([runs.take()])
                if long.held > LONG_BYTES:
                    yield from out(long.take())
        yield from out([short.take(), pair.take(), *long.take()])

    texts = docs.select(F.col(text_col).cast("string").alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))])
    made = texts.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return made.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """counts (of term_counts) of the terms that enough documents of their lang hold, with the term's occurrences in the lang (lang_count)."""
    term = Window.partitionBy("lang", "term")  # how term_counts leaves the rows partitioned
    both = counts.withColumn("lang_count", F.sum("count").over(term)).withColumn("lang_docs", F.sum("docs").over(term))
    return both.filter(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "count", "lang_count")


def _share(count: str, total: str, terms: str) -> F.Column:
    """1 + floor(BILLION * (count + 2) / (total + 2 * terms)), exact."""
    return F.expr(f"1 + (({BILLION}BD * CAST({count} + 2 AS DECIMAL(20, 0))) div CAST({total} + 2 * {terms} AS DECIMAL(20, 0)))")


def _groups(docs: DataFrame, kept: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """One row an occurring (lang, source): its total, its lang's number of terms and total, the share of a term it doesn't hold, and its number within the lang."""
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    langs = kept.groupBy("lang", "term").agg(F.first("lang_count").alias("c")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("c").alias("lang_total"))
    out = own.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    return out.withColumn("number", number).withColumn("absent", F.when(F.col("terms") > 0, _share("0", "total", "terms")))


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of whole shares up to BILLION + 1: within int64."""
    return (p - q) ** 2 // (p + q)


def _pair_sums(table: pa.Table) -> pa.Table:
    """Sums over one block of terms of the divergences between two tiles of sources (x and y; x == y: within it).

    Rows: a source's share of a term, or, without a term, its share of terms
    that it doesn't hold; size is the block's number of terms.
    """
    number, term, share = table["number"].to_numpy(), table["term"].combine_chunks().dictionary_encode(), table["share"].to_numpy()
    size, x, y = (table[c][0].as_py() for c in ("size", "x", "y"))
    code = pc.fill_null(term.indices, -1).to_numpy()
    sources = number[code < 0]
    absent = share[code < 0]
    place = {n: i for i, n in enumerate(sources.tolist())}
    at = np.array([place[n] for n in number.tolist()], np.int64)
    distinct = len(term.dictionary)
    left, right = np.flatnonzero(sources // TILE == x), np.flatnonzero(sources // TILE == y)
    total = (size - distinct) * divergence(absent[left][:, None], absent[right][None, :])
    named = code >= 0
    step = max(1, (1 << 21) // max(1, len(sources)))
    order = np.argsort(code[named], kind="stable")
    codes, rows, shares = code[named][order], at[named][order], share[named][order]
    for first in range(0, distinct, step):
        last = min(distinct, first + step)
        cells = np.repeat(absent[:, None], last - first, axis=1)
        own = slice(np.searchsorted(codes, first), np.searchsorted(codes, last))
        cells[rows[own], codes[own] - first] = shares[own]
        for i, s in enumerate(left):
            total[i] += divergence(cells[s][None, :], cells[right]).sum(axis=1)
    i, j = np.nonzero(sources[left][:, None] < sources[right][None, :]) if x == y else np.indices(total.shape).reshape(2, -1)
    lang = pa.array([table["lang"][0].as_py()] * len(i), pa.string())
    return pa.table({"lang": lang, "a": pa.array(sources[left][i], pa.int64()), "b": pa.array(sources[right][j], pa.int64()), "value": pa.array(total[i, j], pa.int64())})


def pair_divergences(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of the sources numbered a < b of each lang: divergences summed over all kept terms, shares of terms that a source doesn't hold included."""
    blocks = groups.filter("terms > 0").groupBy("lang").agg(F.first("terms").alias("terms"), F.count(F.lit(1)).alias("sources"))
    # a block's cells: terms by the sources of two tiles
    blocks = blocks.withColumn("blocks", F.ceil(F.col("terms") * F.least("sources", F.lit(2 * TILE)) / BLOCK)).withColumn("tiles", F.ceil(F.col("sources") / TILE))
    block = F.pmod(F.xxhash64("term"), "blocks")
    sizes = (
        kept.select("lang", "term").distinct().join(blocks.select("lang", "blocks"), "lang").groupBy("lang", block.alias("block")).agg(F.count(F.lit(1)).alias("size"))
    )
    numbered = groups.filter("terms > 0").select("lang", "source", "number", "total", "terms", "absent").join(blocks.select("lang", "blocks", "tiles"), "lang")
    shares = kept.join(numbered, ["lang", "source"]).select("lang", "number", "term", _share("count", "total", "terms").alias("share"), block.alias("block"), "tiles")
    fill = numbered.select("lang", "number", F.lit(None).cast("string").alias("term"), F.col("absent").alias("share"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "tiles")
    tile = F.floor(F.col("number") / TILE)
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    dealt = shares.unionByName(fill).withColumn("tile", tile).select("*", others).join(sizes, ["lang", "block"])
    parts = dealt.select("lang", "block", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "number", "term", "share", "size")
    sums = parts.groupBy("lang", "block", "x", "y").applyInArrow(_pair_sums, "lang string, a long, b long, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a lang differs from each other one, and by which terms from the lang.

    part `pair`: item is another source of the lang, value the divergence
    summed over the lang's kept terms (0 where it has none), all ranks.  part
    `term`: item is a kept term whose share in the source exceeds that in the
    lang, value its divergence, ranks to `top`.  Kept terms stand in at least
    `least_docs` documents of the lang; a share is 1 + floor(10^9 * (count + 2)
    / (N + 2 V)) with N all occurrences of the lang's V kept terms in the group.
    Ranks go by value, largest first, then by item's bytes.

    Null text, lang and source count as ''.  Every row of docs counts, repeated
    ones too.  A source alone in its lang has no pairs; a group without terms
    has pairs all the same.  Other columns of docs aren't read.  An empty table
    gives an empty result.
    """
    kept = durable(kept_terms(term_counts(docs, text_col, lang_col, source_col), least_docs), "terms")
    groups = durable(_groups(docs, kept, lang_col, source_col), "groups")
    pairs = durable(pair_divergences(kept, groups), "divergences")
    names = groups.select("lang", "source", "number")
    both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    # the result itself holds each source with each other one of its lang
    every = names.toDF("lang", "source", "a").join(names.toDF("lang", "item", "b"), "lang").filter("a <> b")
    paired = every.join(both, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    shown = kept.filter("count > 0").join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    shown = shown.select("lang", "source", F.col("term").alias("item"), _share("count", "total", "terms").alias("p"), _share("lang_count", "lang_total", "terms").alias("q")).filter("p > q")
    shown = shown.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shown.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return paired.withColumn("rank", F.row_number().over(ranked)).unionByName(terms)
