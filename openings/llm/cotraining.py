"""A quality classifier by co-training of two views.

View 1, text content: hashed byte trigrams of the whole text (log counts, unit
length), how much they repeat, and the presence of telling words.  View 2, page
metadata: source, language, length, number and length of lines.  The views
share no measure.  Each has its own logistic regression, fitted on labelled
rows.  Then, for some rounds, each view labels the unlabelled rows of either
class that it is surest of, a tenth of the class at least (or more, if the
other view gains more from that), and hands these to the other.  The views are last calibrated on
labelled rows that neither has seen, and combined by adding their calibrated
log-odds (the prior once).

A round is one Spark pass over all rows: each task sums, by view, class and
confidence of the other view (a few levels), the gradient of the loss on the
rows that the other view puts into the class; the surest levels that make up
the share count.  The driver
takes a Newton-like step from these sums alone: it minimises the labelled loss
plus the difference of the two gradients as a linear term (the labelled sample
stands for the curvature), so no unlabelled row ever reaches it.

Documented bounds: the labelled rows of the fit are at most `max_labelled`, the
ones whose ids' hashes are smallest (3 KB each on the driver), and the telling
words, chosen from these rows, at most `WORDS`.  All other rows count as
unlabelled, all of them take part, and every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable, small_batches
from .words import NOT_ALNUM, cut_words

DIMS, WORDS = 1024, 512
TEXT = DIMS + WORDS + 3
SOURCES, LANGS, LAYOUT = 64, 16, 6
META = SOURCES + LANGS + LAYOUT
ROWS = 1024
#: Share of its loss on the held rows that a step may cost a view: what labelled rows don't have, they can't reward.
SLACK = 0.02
#: Shares of a class's unlabelled rows, the surest ones, that a view hands on; and lengths of a step.
SHARES, LENGTHS = (0.1, 0.3, 0.6, 1.0), (1.0, 0.5, 0.2, 0.05)
#: Levels of confidence begin at these quantiles of the labelled rows that a view puts into the class.
LEVELS = (0.0, 0.5, 0.75, 0.9, 0.97)
#: Squared standard deviations that a telling word's good rows lie from their expected number.
TELLING = 20.0


def _name_bucket(names: list, size: int) -> np.ndarray:
    """A stable bucket of each name; null has the last."""
    out = np.empty(len(names), np.int64)
    for i, name in enumerate(names):
        h = 2166136261
        for b in (name or "").encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        out[i] = size - 1 if name is None else (h ^ (h >> 15)) % (size - 1)
    return out


def features(texts: pa.Array, sources: pa.Array, langs: pa.Array, vocabulary: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, text view, metadata view) of the rows, some rows at a time; null texts are empty.

    vocabulary: sorted word hashes, at most WORDS.
    """
    vocabulary = np.zeros(0, np.uint64) if vocabulary is None else vocabulary
    for start in range(0, len(texts), ROWS):
        part = texts.slice(start, ROWS)
        sizes = pc.binary_length(part.fill_null("").cast(pa.large_binary())).to_numpy(zero_copy_only=False).astype(np.int64)
        source, lang = _name_bucket(sources.slice(start, ROWS).to_pylist(), SOURCES), _name_bucket(langs.slice(start, ROWS).to_pylist(), LANGS)
        for words in cut_words(part, NOT_ALNUM):
            own = slice(words.first, words.last)
            text = _text_view(words, sizes[own], vocabulary)
            yield start + words.first, text, _meta_view(words.data, sizes[own], source[own], lang[own])


def _text_view(words, sizes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    rows, data = len(sizes), words.data
    out = np.zeros((rows, TEXT), np.float32)
    row = np.repeat(np.arange(rows), sizes)
    if len(data) > 2:
        b = data.astype(np.uint32)
        key = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
        key = (key * np.uint32(0x27D4EB2F)) >> np.uint32(32 - (DIMS - 1).bit_length())
        inside = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][inside] * DIMS + key[inside], minlength=rows * DIMS).reshape(rows, DIMS)
        total = np.maximum(counts.sum(axis=1), 1)
        out[:, -3] = (counts > 0).sum(axis=1) / np.minimum(total, DIMS)
        out[:, -2] = counts.max(axis=1) / total
        value = np.log1p(counts).astype(np.float32)
        out[:, :DIMS] = value / np.maximum(np.sqrt((value**2).sum(axis=1, keepdims=True)), 1e-9) * 4
    if len(vocabulary) and len(words.hashes):
        at = np.minimum(np.searchsorted(vocabulary, words.hashes), len(vocabulary) - 1)
        known = vocabulary[at] == words.hashes
        out[words.row()[known], DIMS + at[known]] = 1
    out[:, -1] = 1
    return out


def _meta_view(data: np.ndarray, sizes: np.ndarray, source: np.ndarray, lang: np.ndarray) -> np.ndarray:
    rows = len(sizes)
    lines = np.bincount(np.searchsorted(np.cumsum(sizes), np.flatnonzero(data == 10), side="right"), minlength=rows)[:rows] + 1
    out = np.zeros((rows, META), np.float32)
    at = np.arange(rows)
    out[at, source] = 0.5
    out[at, SOURCES + lang] = 0.5
    layout = out[:, SOURCES + LANGS :]
    layout[:, 0] = np.log1p(sizes) / 8
    layout[:, 1] = np.exp(-sizes / 30)
    layout[:, 2] = np.log(lines) / 6
    layout[:, 3] = np.log1p(sizes / lines) / 6
    layout[:, 4] = lines == 1
    layout[:, 5] = 1
    return out


def _mean_gradients(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of either class (0, 1) the mean gradient of the logistic loss at w."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return tuple((x[y == c].T @ (p[y == c] - c)).astype(np.float64) / max(1, (y == c).sum()) for c in (0, 1))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 250, decay: float = 1e-3, start: np.ndarray | None = None, pull: np.ndarray | None = None) -> np.ndarray:
    """Weights of a balanced logistic regression (full-batch Adam), from `start`, with the linear term <pull, w>."""
    w = np.zeros(x.shape[1], np.float64) if start is None else start.astype(np.float64)
    first, m, v = w.copy(), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = x.T @ (share * (p - y)).astype(np.float32) + decay * w
        if pull is not None:
            g = g + pull + 1e-3 * (w - first)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= (0.1 if start is None else 0.03) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w.astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Weights of both views, their calibrations (slope, offset), the score below which a row is rejected,
    the text view's words, and the log-odds of good among labelled rows (which both views' odds hold, and the sum but once).
    """

    text: np.ndarray
    meta: np.ndarray
    calibration: tuple[tuple[float, float], ...]
    threshold: float
    vocabulary: np.ndarray
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odds = [a * (x @ w) + b for x, w, (a, b) in zip((text, meta), (self.text, self.meta), self.calibration, strict=True)]
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*odds, odds[0] + odds[1] - self.prior))


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of log-odds (Platt), with targets drawn in by one count."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        s = p * (1 - p) + 1e-6
        g = np.array([((p - target) * z).sum(), (p - target).sum()]) + 1e-3 * np.array([a - 1, b])
        h = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(max(a, 1e-3)), float(b)


class CoTrainer:
    """The driver's part: labelled rows (label 1 or 0), both views' weights, and the step of a round.

    Every fifth labelled row is kept for calibration and for the threshold.
    """

    def __init__(self, text: np.ndarray, meta: np.ndarray, label: np.ndarray, vocabulary: np.ndarray | None = None) -> None:
        rows = np.arange(len(label))
        self.held = rows[::5] if len(rows) >= 20 else rows
        self.train = np.setdiff1d(rows, self.held) if len(rows) >= 20 else rows
        self.views, self.label = (text, meta), label
        self.vocabulary = np.zeros(0, np.uint64) if vocabulary is None else vocabulary
        self.weights = [fit(x[self.train], label[self.train]) for x in self.views]

    def calibration(self) -> tuple[tuple[float, float], ...]:
        return tuple(_calibrate(x[self.held] @ w, self.label[self.held]) for x, w in zip(self.views, self.weights, strict=True))

    def loss(self, view: int, w: np.ndarray) -> float:
        """Calibrated log loss of a view's weights on the held rows."""
        z, y = self.views[view][self.held] @ w, self.label[self.held]
        a, b = _calibrate(z, y)
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (a * z + b)).mean())

    def prior(self) -> float:
        """Log-odds of good among the labelled rows."""
        return float(np.log(((self.label > 0).sum() + 1) / ((self.label <= 0).sum() + 1)))

    def levels(self) -> list[list[np.ndarray]]:
        """By view and class, the confidences at which levels begin: distances of calibrated log-odds from the prior."""
        out = []
        for x, w, (a, b) in zip(self.views, self.weights, self.calibration(), strict=True):
            z = a * (x @ w) + b - self.prior()
            out.append([np.concatenate([[0.0], np.quantile(own, LEVELS[1:])]) if len(own) else np.zeros(len(LEVELS)) for own in (-z[z < 0], z[z > 0])])
        return out

    def step(self, sums: np.ndarray, counts: np.ndarray) -> list[bool]:
        """Refit each view; sums[view][class][level] is the gradient over the counts[view][class][level] rows that the other view puts there.

        The surest levels that make up a share of the class are taken as labels,
        each row for as much as a labelled one, all of them at most half of
        their class.  The longest step is taken that raises the loss on the held
        rows by at most SLACK, with the share that leaves the least; tells for
        which views one was.
        """
        taken = [False, False]
        y = self.label[self.train]
        for view, x in enumerate(self.views):
            if not counts[view].any():
                continue
            x, w = x[self.train], self.weights[view]
            own, most = _mean_gradients(x, y, w), self.loss(view, w) * (1 + SLACK)
            ways = []
            for share in SHARES:
                pull = np.zeros(len(w))
                for c in (0, 1):
                    from_top = np.cumsum(counts[view][c][::-1])[::-1]
                    if from_top[0]:
                        first = np.flatnonzero(from_top >= share * from_top[0])[-1]
                        n, total = from_top[first], sums[view][c][first:].sum(axis=0)
                        pull += 0.5 * min(0.5, n / (n + (y == c).sum())) * (total[: len(w)] / n - own[c])
                ways.append(fit(x, y, steps=80, start=w, pull=pull) - w)
            for length in LENGTHS:
                loss, new = min(((self.loss(view, v), i, v) for i, v in enumerate(w + np.float32(length) * way for way in ways)), key=lambda r: r[:2])[::2]
                if loss <= most:
                    self.weights[view], taken[view] = new, True
                    break
        return taken

    def model(self, lost: float = 0.003) -> Model:
        """The calibrated model; its threshold is the largest score up to 0.5 that rejects at most `lost` of the good held rows."""
        label = self.label[self.held]
        calibration = self.calibration()
        prior = self.prior()
        open_ = Model(*self.weights, calibration, 0.5, self.vocabulary, prior)
        good = open_.score(*(x[self.held] for x in self.views))[2][label > 0]
        threshold = min(0.5, float(np.quantile(good, lost, method="lower"))) if len(good) else 0.5
        return Model(*self.weights, calibration, threshold, self.vocabulary, prior)


def pseudo_gradients(text: np.ndarray, meta: np.ndarray, trainer: CoTrainer | Views) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) by view, class and level over these unlabelled rows; see CoTrainer.step."""
    views = (text, meta)
    sums, counts = np.zeros((2, 2, len(LEVELS), max(TEXT, text.shape[1]))), np.zeros((2, 2, len(LEVELS)))
    odds = [x @ w for x, w in zip(views, trainer.weights, strict=True)]
    levels, calibration, prior = trainer.levels(), trainer.calibration(), trainer.prior()
    for view, x in enumerate(views):
        p = 1 / (1 + np.exp(-np.clip(odds[view], -30, 30)))
        a, b = calibration[1 - view]
        other = a * odds[1 - view] + b - prior
        for c, own in enumerate((other < 0, other > 0)):
            level = np.searchsorted(levels[1 - view][c], np.abs(other), side="right") - 1
            for k in range(len(LEVELS)):
                rows = own & (level == k)
                counts[view, c, k] = rows.sum()
                sums[view, c, k, : x.shape[1]] = x[rows].T @ (p[rows] - c)
    return sums, counts


@dataclass(frozen=True)
class Views:
    """What tasks need of a CoTrainer: no labelled rows."""

    weights: list
    known_levels: list
    known_calibration: tuple
    known_prior: float

    def levels(self) -> list:
        return self.known_levels

    def calibration(self) -> tuple:
        return self.known_calibration

    def prior(self) -> float:
        return self.known_prior


def _telling(sample: DataFrame) -> np.ndarray:
    """Hashes of the words of sample (label, text) whose presence tells most about the label: at most WORDS, of those in 5 rows or more, beyond TELLING."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in cut_words(batch.column(1), NOT_ALNUM):
                pair = np.unique(np.rec.fromarrays([words.row(), words.hashes]))
                label = batch.column(0).slice(words.first, words.last - words.first).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(pair.f1.view(np.int64)), pa.array(label[pair.f0].astype(np.int64))], ["word", "label"])

    rows = sample.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).first()
    n, good = rows["n"], rows["good"] or 0
    seen = sample.select(F.col("label").cast("long").alias("label"), "text").mapInArrow(run, "word long, label long").groupBy("word").agg(F.count(F.lit(1)).alias("c"), F.sum("label").alias("g"))
    expected = F.col("c") * F.lit(good / max(1, n))
    chi = F.pow(F.col("g") - expected, F.lit(2)) / (expected * F.lit(1 - good / max(1, n)) + 1e-9)
    top = seen.filter("c >= 5").withColumn("chi", chi).filter(F.col("chi") > TELLING).orderBy(F.desc("chi"), "word").limit(WORDS).select("word").toPandas()
    return np.sort(top["word"].to_numpy(np.int64).view(np.uint64))


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    label_col: str = "quality",
    toxic_col: str | None = "toxic",
    max_labelled: int = 8000,
    rounds: int = 4,
) -> Model | None:
    """The co-trained model; None where labels don't hold both classes.

    A row is good if label_col is 1 and toxic_col (where labels have it) isn't
    1.  Rows of labels with a null id or label aren't read.  Of rows that repeat
    an id's label the best counts; of documents that repeat an id the one with
    the smallest (text, source, language).
    """
    good = F.col(label_col).cast("int") == 1
    if toxic_col and toxic_col in labels.columns:
        good = good & (F.coalesce(F.col(toxic_col).cast("int"), F.lit(0)) != 1)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("sample_id")).agg(F.max(good.cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(3), "sample_id"), "sample_id").limit(max_labelled)
    columns = [F.col(c).cast("string").alias(n) for c, n in ((text_col, "text"), (source_col, "source"), (lang_col, "lang"))]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *columns)
    # at most max_labelled ids: broadcast
    sample = durable(
        rows.join(F.broadcast(chosen), rows["id"] == chosen["sample_id"]).groupBy("id", "label").agg(F.min(F.struct("text", "source", "lang")).alias("row")).select("id", "label", "row.*"), "labelled"
    )
    vocabulary = _telling(sample)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, text, meta in features(*batch.columns[2:5], vocabulary):
                part = batch.slice(first, len(text))
                packed = [pa.array([v.tobytes() for v in view.astype(np.float16)], pa.binary()) for view in (text, meta)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *packed], ["id", "label", "text", "meta"])

    table = sample.mapInArrow(vectors, "id long, label int, text binary, meta binary").toArrow().sort_by("id")
    label = table["label"].to_numpy().astype(np.int64)
    if not (label == 1).any() or not (label == 0).any():
        return None
    views = [np.frombuffer(b"".join(v.as_py() for v in table[c]), np.float16).reshape(len(label), size).astype(np.float32) for c, size in (("text", TEXT), ("meta", META))]
    ids = np.sort(table["id"].to_numpy())
    trainer = CoTrainer(*views, label, vocabulary)
    for _ in range(rounds):
        sums, counts = _round(rows, ids, trainer)
        if not any(trainer.step(sums, counts)):
            break
    return trainer.model()


def _round(rows: DataFrame, ids: np.ndarray, trainer: CoTrainer) -> tuple[np.ndarray, np.ndarray]:
    """Sums of pseudo_gradients over all rows (id, text, source, lang) but those of the sorted ids."""
    shipped = rows.sparkSession.sparkContext.broadcast((ids, Views(trainer.weights, trainer.levels(), trainer.calibration(), trainer.prior()), trainer.vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labelled, own, words = shipped.value
        total, n = np.zeros((2, 2, len(LEVELS), TEXT)), np.zeros((2, 2, len(LEVELS)))
        for batch in batches:
            known = np.isin(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), labelled) & ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for first, text, meta in features(*batch.columns[1:4], words):
                open_ = ~known[first : first + len(text)]
                sums, counts = pseudo_gradients(text[open_], meta[open_], own)
                total, n = total + sums, n + counts
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["sums", "counts"])

    def add(part: pa.Table) -> pa.Table:
        parts = [np.sum([np.frombuffer(v.as_py(), np.float64) for v in part[c]], axis=0) for c in ("sums", "counts")]
        return pa.table({"sums": pa.array([parts[0].tobytes()], pa.binary()), "counts": pa.array([parts[1].tobytes()], pa.binary())})

    # one row a task, then at most 16
    summed = rows.mapInArrow(run, "sums binary, counts binary").withColumn("slot", F.spark_partition_id() % 16).groupBy("slot").applyInArrow(add, "sums binary, counts binary")
    with small_batches(rows.sparkSession):
        summed = summed.toArrow()
    sums = np.sum([np.frombuffer(v.as_py(), np.float64) for v in summed["sums"]], axis=0).reshape(2, 2, len(LEVELS), TEXT) if len(summed) else np.zeros((2, 2, len(LEVELS), TEXT))
    counts = np.sum([np.frombuffer(v.as_py(), np.float64) for v in summed["counts"]], axis=0).reshape(2, 2, len(LEVELS)) if len(summed) else np.zeros((2, 2, len(LEVELS)))
    return sums, counts


def score_quality(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row a row of docs: doc_id, text_score, meta_score, score (calibrated probabilities of quality 1), keep.

    Null and empty texts are scored as empty ones; null sources and languages
    have a bucket of their own; null ids stay; repeated rows are each scored;
    other columns aren't read; an empty table gives an empty result.  Without a
    model all scores are null and every row is kept.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(f"in_{i}") for i, c in enumerate((text_col, source_col, lang_col))])
    if model is None:
        return base.select("doc_id", *[F.lit(None).cast("double").alias(c) for c in ("text_score", "meta_score", "score")], F.lit(True).alias("keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, text, meta in features(*batch.columns[1:4], model.vocabulary):
                a, b, both = (s.astype(np.float64) for s in model.score(text, meta))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(text)), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= model.threshold)],
                    ["doc_id", "text_score", "meta_score", "score", "keep"],
                )

    return base.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns (see score_quality)."""
    if model is None:
        return docs
    places = [docs.columns.index(c) for c in (text_col, source_col, lang_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).cast(pa.string()) for i in places]
            marks = [model.score(text, meta)[2] >= model.threshold for _, text, meta in features(*columns, model.vocabulary)]
            if marks:
                yield batch.filter(pa.array(np.concatenate(marks)))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """Train on docs and labels, score all rows of docs (see train_quality and score_quality)."""
    return score_quality(docs, train_quality(docs, labels, **columns), **{k: v for k, v in columns.items() if k in ("id_col", "text_col", "source_col", "lang_col")})
