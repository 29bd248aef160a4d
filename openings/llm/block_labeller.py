"""Main text of HTML pages: a bidirectional LSTM labels every block.

A page's blocks, in order, are vectors of hashed tag paths and hashed words
with a few measures (length, share in links, place).  A numpy LSTM reads them
in both directions, so that each label rests on the whole document; blocks
labelled main are joined.

It is trained by `python -m openings.llm.block_labeller`, on made-up pages
(html_pages), which writes labeller_weights.npz beside this module.

Pages are independent: one pass, no shuffle; a task holds one batch of pages.
A page of more than WINDOW blocks is read a window at a time with the state
carried on, first backward, then forward.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, blocks
from .html_pages import made_page
from .words import NOT_ALNUM, cut_words

PATH, WORDS, MEASURES = 96, 48, 8
INPUT = PATH + WORDS + MEASURES
HIDDEN = 24
DEPTH = 6
WINDOW = 2048
WEIGHTS = Path(__file__).with_name("labeller_weights.npz")


@lru_cache(maxsize=100_000)
def _path_buckets(path: tuple[str, ...]) -> tuple[int, ...]:
    """Buckets of the nearest DEPTH steps: each tag, and each word of its names, apart from how deep it stands."""
    out = set()
    for step in path[-DEPTH:]:
        tag, *names = step.split(" ")
        tokens = [f"<{tag}", *(w for name in names for w in (name, *name.replace("_", "-").split("-")) if w)]
        for t in tokens:
            h = 2166136261
            for b in t.encode():
                h = ((h ^ b) * 16777619) & 0xFFFFFFFF
            out.add(((h ^ (h >> 13)) * 0x5BD1E995 & 0xFFFFFFFF) % (PATH - 8) + 8)
    last = path[-1].split(" ")[0] if path else ""
    out.add({"p": 0, "li": 1, "h1": 2, "h2": 3, "h3": 3, "td": 4, "div": 5, "a": 6}.get(last, 7))
    return tuple(out)


def places(size: int) -> np.ndarray:
    """Where the blocks of a page stand in it, from 0 to 1."""
    return np.arange(size) / max(1, size)


def vectors(flat: list[Block], place: np.ndarray) -> np.ndarray:
    """One row a block."""
    x = np.zeros((len(flat), INPUT), np.float32)
    if not flat:
        return x
    at = [(i, j) for i, b in enumerate(flat) for j in _path_buckets(b.path)]
    rows, columns = np.array(at).T
    x[rows, columns] = 1
    for words in cut_words(pa.array([b.text.lower() for b in flat], pa.large_string()), NOT_ALNUM):
        bucket = (words.hashes >> np.uint64(40)).astype(np.int64) % WORDS
        counts = np.bincount(words.row() * WORDS + bucket, minlength=(words.last - words.first) * WORDS).reshape(-1, WORDS)
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        x[words.first : words.last, PATH : PATH + WORDS] = np.sqrt(counts / total)
    length = np.array([len(b.text) for b in flat], np.float32)
    m = x[:, PATH + WORDS :]
    m[:, 0] = np.log1p(length) / 6
    m[:, 1] = np.array([b.linked for b in flat]) / length
    m[:, 2] = length < 25
    m[:, 3] = np.array([len(b.path) for b in flat]) / 10
    m[:, 4] = np.array([b.text[-1] in ".!?…:;" for b in flat])
    m[:, 5] = place
    m[:, 6] = np.array(["©" in b.text for b in flat])
    m[:, 7] = 1
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _padded(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, page, input) and its mask."""
    t = int(sizes.max())
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(t)[:, None]
    mask = place < sizes[None, :]
    at = np.where(mask, starts[None, :] + place, 0)
    return x[at] * mask[:, :, None], mask


def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
    """Hidden states of one direction over time, from `state`, and the last state; it stands still where the mask is off."""
    t, n, _ = x.shape
    z_in = (x.reshape(t * n, -1) @ w + b).reshape(t, n, -1)
    h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
    out, kept = np.zeros((t, n, HIDDEN), np.float32), []
    for s in range(t):
        z = z_in[s] + h @ u
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[s][:, None]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        h_new = o * tc
        if keep:
            kept.append((i, f, o, g, c, tc, h))
        h, c = np.where(m, h_new, h), np.where(m, c_new, c)
        out[s] = h
    return out, kept, (h, c)


def _back(x: np.ndarray, mask: np.ndarray, d_out: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, n, _ = x.shape
    dz_all = np.zeros((t, n, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    du = np.zeros_like(u)
    for s in range(t - 1, -1, -1):
        i, f, o, g, c, tc, h_before = kept[s]
        m = mask[s][:, None]
        dh = dh + d_out[s]
        dh_in = np.where(m, dh, 0)
        dct = np.where(m, dc, 0) + dh_in * o * (1 - tc**2)
        dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dh_in * tc * o * (1 - o), dct * i * (1 - g**2)], axis=1)
        dz_all[s] = dz
        du += h_before.T @ dz
        dh = np.where(m, dz @ u.T, dh)
        dc = np.where(m, dct * f, dc)
    flat = dz_all.reshape(t * n, -1)
    return x.reshape(t * n, -1).T @ flat, du, flat.sum(axis=0)


def _probabilities(weights: tuple[np.ndarray, ...], x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    wf, uf, bf, wb, ub, bb, v, v0 = weights
    ahead, *_ = _run(x, mask, wf, uf, bf, False)
    behind, *_ = _run(x[::-1], mask[::-1], wb, ub, bb, False)
    return _sigmoid(np.concatenate([ahead, behind[::-1]], axis=2) @ v + v0)


def _long_page(weights: tuple[np.ndarray, ...], page: list[Block]) -> np.ndarray:
    """The probabilities of one page's blocks, a window at a time."""
    wf, uf, bf, wb, ub, bb, v, v0 = weights
    place, behind, out = places(len(page)), np.zeros((len(page), HIDDEN), np.float32), np.zeros(len(page), np.float32)
    starts, state = range(0, len(page), WINDOW), None
    for at in reversed(starts):
        x = vectors(page[at : at + WINDOW], place[at : at + WINDOW])[:, None]
        states, _, state = _run(x[::-1], np.ones(x.shape[:2], bool), wb, ub, bb, False, state)
        behind[at : at + WINDOW] = states[::-1, 0]
    state = None
    for at in starts:
        x = vectors(page[at : at + WINDOW], place[at : at + WINDOW])[:, None]
        ahead, _, state = _run(x, np.ones(x.shape[:2], bool), wf, uf, bf, False, state)
        out[at : at + WINDOW] = _sigmoid(np.concatenate([ahead[:, 0], behind[at : at + WINDOW]], axis=1) @ v + v0)
    return out


@lru_cache
def trained() -> tuple[np.ndarray, ...]:
    """The stored weights."""
    with np.load(WEIGHTS) as stored:
        return tuple(stored[k].astype(np.float32) for k in stored.files)


def train(pages: int = 2400, epochs: int = 7, batch: int = 48, seed: int = 5) -> tuple[np.ndarray, ...]:
    """Weights, from `pages` made-up pages (fixed seeds)."""
    rng = np.random.default_rng(seed)
    seen, labels = [], []
    for s in range(pages):
        found = blocks(made_page(s))
        labels.append(np.array(["\x01" in b.text for b in found], np.float32))
        seen.append([Block(b.path, b.text.replace("\x01", "") or ".", b.linked) for b in found])
    x_all, sizes = vectors([b for page in seen for b in page], np.concatenate([places(len(p)) for p in seen])), np.array([len(p) for p in seen])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    bias = np.zeros(4 * HIDDEN, np.float32)
    bias[HIDDEN : 2 * HIDDEN] = 1
    weights = [init(INPUT, 4 * HIDDEN), init(HIDDEN, 4 * HIDDEN), bias, init(INPUT, 4 * HIDDEN), init(HIDDEN, 4 * HIDDEN), bias.copy(), init(2 * HIDDEN), np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        by_size = rng.permutation(pages)[np.argsort(sizes[rng.permutation(pages)] // 8, kind="stable")] if epoch % 2 else rng.permutation(pages)
        for at in range(0, pages, batch):
            chosen = by_size[at : at + batch]
            rows = np.concatenate([np.arange(starts[p], starts[p + 1]) for p in chosen])
            x, mask = _padded(x_all[rows], sizes[chosen])
            y = _padded(np.concatenate([labels[p] for p in chosen])[:, None], sizes[chosen])[0][:, :, 0]
            wf, uf, bf, wb, ub, bb, v, v0 = weights
            ahead, kept_a, _ = _run(x, mask, wf, uf, bf, True)
            behind, kept_b, _ = _run(x[::-1], mask[::-1], wb, ub, bb, True)
            h = np.concatenate([ahead, behind[::-1]], axis=2)
            d = np.where(mask, _sigmoid(h @ v + v0) - y, 0).astype(np.float32) / mask.sum()
            dv = np.tensordot(h, d, axes=([0, 1], [0, 1]))
            dh = d[:, :, None] * v
            gradients = [*_back(x, mask, dh[:, :, :HIDDEN], kept_a, uf), *_back(x[::-1], mask[::-1], dh[::-1, :, HIDDEN:], kept_b, ub), dv, np.array([d.sum()], np.float32)]
            norm = np.sqrt(sum(float((g**2).sum()) for g in gradients))
            step += 1
            rate = 0.02 * min(1.0, 3 * (1 - step / (epochs * pages / batch + 1)))
            for w, g, a, b in zip(weights, gradients, first, second, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return tuple(w.astype(np.float32) for w in weights)


def label(pages: list[list[Block]], weights: tuple[np.ndarray, ...], group: int = 128) -> list[np.ndarray]:
    """Per page the probability of each block to be main text; pages of like length are read together, long ones alone."""
    sizes = np.array([len(p) for p in pages])
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = [int(i) for i in np.argsort(sizes, kind="stable") if sizes[i]]
    at = 0
    while at < len(order):
        if sizes[order[at]] > WINDOW:
            out[order[at]] = _long_page(weights, pages[order[at]])
            at += 1
            continue
        n = group
        while n > 1 and at + n <= len(order) and sizes[order[at + n - 1]] * n > 1 << 14:
            n //= 2
        chosen = order[at : at + n]
        at += n
        x, mask = _padded(vectors([b for i in chosen for b in pages[i]], np.concatenate([places(len(pages[i])) for i in chosen])), sizes[chosen])
        p = _probabilities(weights, x, mask)
        for j, i in enumerate(chosen):
            out[i] = p[: sizes[i], j]
    return out


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", at_least: float = 0.3) -> DataFrame:
    """One row a row of pages: page_id, url, text, n_chars.

    text: the blocks labelled main, in page order, joined by one newline (empty
    if none); n_chars: its code points.  Null and empty pages give an empty text;
    null ids and urls stay; repeated rows are each answered; other columns
    aren't read; an empty table gives an empty result.
    """
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [blocks(h) for h in part.column(2).to_pylist()]
                texts = ["\n".join(b.text for b, p in zip(page, marks, strict=True) if p >= at_least) for page, marks in zip(found, label(found, weights), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )


if __name__ == "__main__":
    np.savez(WEIGHTS, *[w.astype(np.float16) for w in train()])
