"""Probabilistic suffix tree over words: counts, divergence tests, smoothing, scores.

Tokens are the words of a whole text and one end.  The root holds every
token's add-0.1 estimate.  A context (the last one or two tokens) seen at
least 4 * `least` times is a candidate state, and is retained if the counts of
its next tokens diverge from its parent's distribution (G statistic,
2 * sum c ln(c / expected), above `divergence` per stored next token).  Its
next tokens seen behind it at least `least` times are stored.  These are
absolute counts: the tree grows with the corpus.

P(w | s) = (c(s, w) + (rest(s) + mu) * P(w | parent)) / (c(s) + mu), where
rest(s) is the count of next tokens that aren't stored; it sums to one.  The
longest retained suffix of the tokens before scores the next one.

A stored pair's suffix is stored, too, so the logarithm of a text's score is a
sum over its words, pairs and triples: each adds what it has beyond its own
suffix, and what it leaves for others where it is a context.  All of these
are rows of one table (gram -> values).  Grams with at least `p_hot` of all
tokens (at most 1 / p_hot of each length) are broadcast, and of rarer ones the
most frequent up to HOT in all; the rest, of which there is no bound, reach
the texts by a join.  Bitmaps of a fixed size keep
grams that are in no table out of the shuffles.

Counting covers every training text: tokens in one pass, grams behind
candidate contexts in one more for each depth, each summed within a task,
some half a million at a time, before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable, release
from .words import _STEP, SPACES, Words, cut_words, mix

END = 0x1D5EED0FEE1DEAD1
BITS = 27
#: Grams that a task sums at a time, some 100 bytes each.
HELD = 1 << 19
#: Grams that are broadcast, if so many are not rarer than others that aren't; 24 bytes each.
HOT = 1 << 20
#: Turns in which the rarer grams meet the texts: one turn's shuffles go before the next.
TURNS = 2


def held_out(id_: Column) -> Column:
    """Rows the model does not learn from: crc32 of the id's text mod 10 is 0."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, the end after each row's words, and their bounds."""
    bounds = words.bounds + np.arange(len(words.bounds))
    out = np.full(bounds[-1], END, np.uint64)
    is_word = np.ones(bounds[-1], bool)
    is_word[bounds[1:] - 1] = False
    out[is_word] = words.hashes
    return out, bounds


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.concatenate(keys)
    unique, at = np.unique(key, return_inverse=True)
    return unique, np.bincount(at, np.concatenate(counts), len(unique)).astype(np.int64)


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, n) over all of texts.text; token is the word's 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = [], []
            for words in cut_words(batch.column(0), SPACES):
                k, c = np.unique(_tokens(words)[0], return_counts=True)
                keys.append(k)
                counts.append(c)
            k, c = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], ["token", "n"])

    return texts.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, -1 if it isn't there."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _pair(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(context * _STEP[40] + token * _STEP[41])


def _keys(tokens: np.ndarray, length: int) -> np.ndarray:
    """Joint hash of the `length` tokens that end at each place (of no use where a row has fewer)."""
    key = tokens
    for _ in range(1, length):
        key = np.concatenate([key[:1], _pair(key[:-1], key[1:])])
    return key


def _places(bounds: np.ndarray, depth: int) -> np.ndarray:
    """Places that have `depth` tokens of their row before them."""
    inside = np.ones(bounds[-1], bool)
    for d in range(depth):
        starts = bounds[:-1] + d
        inside[starts[starts < bounds[1:]]] = False
    return np.flatnonzero(inside)


def _contexts(tokens: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that have `depth` tokens of their row before them, and those tokens' joint hash."""
    at = _places(bounds, depth)
    return at, _keys(tokens, depth)[at - 1]


def _bitmap(keys: DataFrame) -> np.ndarray:
    """2^BITS bits, two of them set for each key of the only column: a bounded number of words to the driver."""
    key = F.col(keys.columns[0])
    slot = keys.select(F.explode(F.array(F.shiftrightunsigned(key, 64 - BITS), key.bitwiseAND((1 << BITS) - 1))).alias("slot"))
    words = slot.select(F.shiftright("slot", 6).alias("w"), F.expr("shiftleft(1L, cast(slot & 63 AS int))").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).withColumn("part", F.shiftright("w", 14))

    def pack(part: pa.Table) -> pa.Table:
        out = np.zeros(1 << 14, np.uint64)
        out[part["w"].to_numpy() & ((1 << 14) - 1)] = part["b"].to_numpy().view(np.uint64)
        return pa.table({"part": part["part"][:1], "bits": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros((1 << (BITS - 20), 1 << 14), np.uint64)
    packed = durable(words.groupBy("part").applyInArrow(pack, "part long, bits binary"), "bitmap")
    for r in packed.toLocalIterator():
        out[r.part] = np.frombuffer(r.bits, np.uint64)
    release(packed)
    return out.ravel()


def _may_be(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False where a key is surely not among those of the bitmap."""
    set_ = lambda slot: (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    out = set_(keys >> np.uint64(64 - BITS))
    out[out] = set_(keys[out] & np.uint64((1 << BITS) - 1))
    return out


@dataclass(frozen=True)
class SuffixTree:
    """The table (length, key, n, left, gain) of grams.

    left: log10 of what a retained context leaves for the parent, (rest + mu) / (c + mu), null of others.
    gain: log10 P(last token | those before) - log10 P(last token | suffix of those before) - left of those before, null of single tokens.
    """

    table: DataFrame | None = None
    depth: int = 0

    @cached_property
    def depths(self) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]:
        """By depth, on the driver: contexts (sorted), their left, grams with a gain (sorted), their gain.  For small trees; no query reads it."""
        out = []
        for depth in range(1, self.depth + 1):
            arrays = []
            for length, name in ((depth, "left"), (depth + 1, "gain")):
                rows = self.table.filter((F.col("length") == length) & F.col(name).isNotNull()).select("key", name).toPandas()
                key = rows["key"].to_numpy(np.int64).view(np.uint64)
                by = np.argsort(key)
                arrays += [key[by], rows[name].to_numpy(np.float64)[by]]
            out.append(tuple(arrays))
        return tuple(out)

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for d in self.depths for x in d)

    def gain(self, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 P(token | longest state) - log10 P(token | root) of each token, by `depths`."""
        out = np.zeros(len(tokens))
        for depth, (contexts, left, grams, gain) in enumerate(self.depths, 1):
            at, key = _contexts(tokens, bounds, depth)
            for found, values in ((_find(contexts, key), left), (_find(grams, _keys(tokens, depth + 1)[at]), gain)):
                out[at[found >= 0]] += values[found[found >= 0]]
        return out


def _count_grams(texts: DataFrame, depth: int, contexts: DataFrame, parents: DataFrame) -> tuple[DataFrame, Broadcast]:
    """(context, parent, n) of tokens behind `depth` others, over all of texts.text; parent is the gram without its first token.

    Only those whose context and parent may be in the given tables (key).  The
    broadcast is to be destroyed once the rows are written: until then every
    machine keeps a file of it.
    """
    shipped = texts.sparkSession.sparkContext.broadcast((_bitmap(contexts), _bitmap(parents)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, common = shipped.value
        keys, counts, held = [], [], 0

        def summed() -> pa.RecordBatch:
            both, times = np.concatenate(keys), np.concatenate(counts)
            _, first, at = np.unique(_pair(both["context"], both["parent"]), return_index=True, return_inverse=True)
            n = np.bincount(at, times, len(first)).astype(np.int64)
            columns = [np.ascontiguousarray(both[c][first]).view(np.int64) for c in ("context", "parent")]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(n)], ["context", "parent", "n"])

        for batch in batches:
            for words in cut_words(batch.column(0), SPACES):
                tokens, bounds = _tokens(words)
                at, context = _contexts(tokens, bounds, depth)
                parent = _keys(tokens, depth)[at]
                wanted = _may_be(known, context) & _may_be(common, parent)
                both = np.empty(wanted.sum(), [("context", np.uint64), ("parent", np.uint64)])
                both["context"], both["parent"] = context[wanted], parent[wanted]
                _, first, c = np.unique(_pair(both["context"], both["parent"]), return_index=True, return_counts=True)
                keys.append(both[first])
                counts.append(c)
                held += len(first)
                if held >= HELD:
                    yield summed()
                    keys, counts, held = [], [], 0
        if held:
            yield summed()

    counted = texts.select("text").mapInArrow(run, "context long, parent long, n long").groupBy("context", "parent").agg(F.sum("n").alias("n"))
    return counted, shipped


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key of (context, parent) instead of the context."""
    for batch in batches:
        context, parent = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(_pair(context, parent).view(np.int64)), *batch.columns[1:]], ["key", *batch.schema.names[1:]])


@dataclass(frozen=True)
class Root:
    """The table (token, n) of all training tokens, their number, and that of distinct ones."""

    table: DataFrame
    total: int
    distinct: int

    @property
    def denominator(self) -> float:
        return self.total + 0.1 * (self.distinct + 1)

    def frequent(self, share: float, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (sorted) and counts of those with at least `share` of all tokens: at most 1 / share rows."""
        rows = self.table.filter(F.col("n") >= max(least, share * self.total)).toPandas()
        tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(tokens)
        return tokens[by], rows["n"].to_numpy(np.float64)[by]


def learn(texts: DataFrame, depth: int = 2, divergence: float = 4.0, mu: float = 20.0, least: int = 2) -> tuple[SuffixTree, Root]:
    """The tree and root counts of all rows of texts (text).

    `least`: pairs seen fewer times, and contexts seen fewer than 4 * least
    times, are never stored.
    """
    table = durable(count_tokens(texts), "tokens")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    root = Root(table, total["n"], total["v"])
    end, often = int(np.array(END, np.uint64).view(np.int64)), 4 * least
    # grams: (key, n, logp) whose last token has a stored estimate; contexts: candidate states one token shorter than what is counted
    grams = table.select(F.col("token").alias("key"), "n", F.log10((F.col("n") + 0.1) / F.lit(root.denominator)).alias("logp"))
    contexts = grams.filter((F.col("n") >= often) & (F.col("key") != end)).select(F.col("key").alias("context"), F.col("n").alias("seen"))
    null = F.lit(None).cast("double")
    made = []
    parts = [table.select(F.lit(1).alias("length"), F.col("token").alias("key"), "n", null.alias("left"), null.alias("gain"))]
    for level in range(1, depth + 1):
        contexts = durable(contexts, "contexts")
        counted, shipped = _count_grams(texts, level, contexts.select("context"), grams.filter(F.col("n") >= least).select("key"))
        tested = durable(counted.filter(F.col("n") >= least).join(grams.select(F.col("key").alias("parent"), F.col("logp").alias("parent_logp")), "parent"), "counted")
        shipped.destroy()
        n, q = F.col("n"), F.pow(F.lit(10.0), F.col("parent_logp"))
        sums = tested.groupBy("context").agg(F.sum(n).alias("stored"), F.count(F.lit(1)).alias("size"), F.sum(n * F.log(n / q)).alias("nlog"), F.sum(q).alias("q"))
        g = 2 * (F.col("nlog") - F.log("seen") * F.col("stored") - F.col("stored") + F.col("seen") * F.col("q"))
        rest = F.greatest(F.col("seen") - F.col("stored"), F.lit(0))
        states = durable(
            sums.join(contexts, "context").filter(g > divergence * F.col("size")).select("context", "seen", rest.alias("rest"), F.log10((rest + mu) / (F.col("seen") + mu)).alias("left")), "states"
        )
        logp = F.log10((n + (F.col("rest") + mu) * q) / (F.col("seen") + mu))
        stored = tested.join(states, "context").select("context", "parent", "n", logp.alias("logp"), (logp - F.col("left") - F.col("parent_logp")).alias("gain"))
        grams = durable(stored.mapInArrow(_joined, "key long, parent long, n long, logp double, gain double"), "grams")
        release(contexts, tested)
        made += [states, grams]
        parts.append(states.select(F.lit(level), "context", "seen", "left", null))
        parts.append(grams.select(F.lit(level + 1), "key", "n", null, "gain"))
        # one token longer: a frequent stored gram whose own suffix is retained
        contexts = grams.filter(F.col("n") >= often).join(states.select(F.col("context").alias("parent")), "parent").select(F.col("key").alias("context"), F.col("n").alias("seen"))
    merged = reduce(DataFrame.union, parts).groupBy("length", "key").agg(F.max("n").alias("n"), F.max("left").alias("left"), F.max("gain").alias("gain"))
    tree = SuffixTree(durable(merged, "tree"), depth)
    release(*made)
    return tree, root


def _hot_count(values: DataFrame, most: int) -> int:
    """The least count at which no more than HOT of the values (n) are as frequent; `most` where even there they are more."""
    by = values.groupBy(F.least("n", F.lit(most)).alias("n")).agg(F.count(F.lit(1)).alias("rows")).toPandas().sort_values("n", ascending=False)
    fits = by[by["rows"].cumsum() <= HOT]
    return int(fits["n"].min()) if len(fits) else most


def score_texts(docs: DataFrame, tree: SuffixTree, root: Root, id_col: str = "doc_id", text_col: str = "text", p_hot: float = 2e-7) -> DataFrame:
    """One row a row of docs: doc_id, n_tokens, n_known, base_score, score (log10, of all tokens and the end)."""
    known = F.col("length") == 1
    values = tree.table.select(
        "key", "n", known.cast("long").alias("known"),
        F.when(known, F.log10((F.col("n") + 0.1) / F.lit(root.denominator))).otherwise(0.0).alias("base"), (F.coalesce("left", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("more"),
    ).filter(known | (F.col("more") != 0))
    often = F.col("n") >= _hot_count(values, max(1, math.ceil(p_hot * root.total)))
    hot = values.filter(often).select("key", "base", "more").toArrow()
    hot_keys = hot["key"].to_numpy().view(np.uint64)
    by = np.argsort(hot_keys)
    shipped = docs.sparkSession.sparkContext.broadcast((_bitmap(values.select("key")), hot_keys[by], *(hot[c].to_numpy()[by] for c in ("base", "more"))))
    longest = tree.depth + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored, keys, base, more = shipped.value
        for batch in batches:
            for words in cut_words(batch.column(1), SPACES):
                tokens, bounds = _tokens(words)
                rows = len(bounds) - 1
                row = np.repeat(np.arange(rows), np.diff(bounds))
                n_known, sums, cold = np.zeros(rows, np.int64), np.zeros((2, rows)), []
                for length in range(1, longest + 1):
                    at = _places(bounds, length - 1)
                    key = _keys(tokens, length)[at]
                    wanted = _may_be(stored, key)
                    at, key = row[at[wanted]], key[wanted]
                    found = _find(keys, key)
                    cold.append((at[found < 0], key[found < 0]))
                    at, found = at[found >= 0], found[found >= 0]
                    if length == 1:
                        n_known += np.bincount(at, minlength=rows)
                        sums[0] += np.bincount(at, base[found], rows)
                    sums[1] += np.bincount(at, more[found], rows)
                at, key = (np.concatenate(c) for c in zip(*cold, strict=True))
                by = np.argsort(at, kind="stable")
                ends = np.searchsorted(at[by], np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.first, words.last - words.first),
                        pa.array(np.diff(bounds)),
                        pa.array(n_known),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(key[by].view(np.int64))),
                    ],
                    ["doc_id", "n_tokens", "known", "base", "more", "cold"],
                )

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, known long, base double, more double, cold array<long>"
    )
    scored = durable(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    shipped.destroy()
    cold, rare, parts = scored.select("row", F.explode("cold").alias("key")), values.filter(~often).drop("n"), []
    for turn in range(TURNS):
        own = F.pmod(F.xxhash64("key"), F.lit(TURNS)) == turn
        sums = cold.filter(own).join(rare.filter(own), "key").groupBy("row")
        parts.append(durable(sums.agg(*(F.sum(c).alias(c) for c in ("known", "base", "more"))), "rare"))
    added = reduce(DataFrame.union, parts).groupBy("row").agg(*(F.sum(c).alias(f"rare_{c}") for c in ("known", "base", "more")))
    n_known = F.col("known") + F.coalesce("rare_known", F.lit(0))
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + (F.col("n_tokens") - n_known) * F.log10(F.lit(0.1 / root.denominator))
    out = scored.join(added, "row", "left").select(
        "doc_id", "n_tokens", n_known.alias("n_known"), base.alias("base_score"), (base + F.col("more") + F.coalesce("rare_more", F.lit(0.0))).alias("score")
    )
    out = durable(out, "scored")
    release(scored, *parts)
    return out


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that aren't held out and scores all.  base_score: sum
    over tokens of log10((c + 0.1) / (N + 0.1 * (V + 1))), c being the token's
    count, N that of all and V that of distinct training tokens; score: the
    tree's log10 probability.  n_known counts tokens with c > 0.

    A null or empty text is the end alone.  A null id counts as an empty one
    (its checksum holds it out).  Repeated rows are learned from and scored
    each.  Only id_col and text_col are read; an empty table gives an empty
    result.  Options are those of learn().
    """
    texts = docs.filter(~held_out(F.col(id_col))).select(F.col(text_col).cast("string").alias("text"))
    tree, root = learn(texts, **options)
    return score_texts(docs, tree, root, id_col, text_col).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(root.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
