"""Exact top-k by inner product: dual-tree search with cover trees.

Both sides are cover trees that Spark builds from the top: a cell of more than
`region` vectors is split around pivots of its own (every vector goes to its
nearest one), level by level, until all cells are small; then each cell's lower
part is built in its own task, once, and stored as one row.  Every node has a
centre, a covering radius over all its vectors, and so, for a query node and a
data node, one bound on all their inner products,

    <q, d> <= <cq, cd> + rq * |cd| + rd * |cq| + rq * rd.

The search goes down both trees together.  First every query cell meets the few
data cells whose centres score highest with its own, which gives each query a
k-th score to beat.  Then pairs of nodes are joined level by level, and a pair
goes whose bound is below the worst k-th score of the query node's queries.  The
pairs of cells that are left go to tasks of one data cell and a few query cells,
in which the lower parts are searched alike, down to leaves whose vectors are scored exactly in integers.
The k best of each query's lists are merged.  No task holds more than one data
cell and TOGETHER query cells, and the driver sees counts only.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

LEAF, QUERY_LEAF = 64, 16
#: Vectors of the first block that a query leaf scores.
BLOCK = 128
#: Below every score.
NONE = -(1 << 62)
#: Vectors of a data cell, of a query cell; pivots of a split, and sampled vectors for each.
REGION, QUERIES = 4096, 1024
FAN, SAMPLE = 64, 64
#: Query cells that share one copy of a data cell.
TOGETHER = 8


@dataclass
class Node:
    """A cover-tree node: its points are order[start:end]."""

    start: int
    end: int
    centre: np.ndarray
    radius: float
    norm: float
    children: list[Node]


def build_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[Node, np.ndarray]:
    """A cover tree of the rows of x: children of a node are points that lie more than half its radius apart,
    every point goes to its nearest one, down to `leaf` points or one place.  Returns the root and the order of rows.
    """
    order = np.arange(len(x))

    def make(start: int, end: int) -> Node:
        rows = order[start:end]
        pts = x[rows]
        centre = pts[0]
        far = np.sqrt(np.maximum(((pts - centre) ** 2).sum(axis=1), 0))
        radius = float(far.max())
        node = Node(start, end, centre, radius, float(np.sqrt((centre**2).sum())), [])
        if end - start <= leaf or radius == 0:
            return node
        centres, nearest, own = [0], far.copy(), np.zeros(len(rows), np.int64)
        while len(centres) < 16 and nearest.max() > radius / 2:
            c = int(nearest.argmax())
            d = np.sqrt(((pts - pts[c]) ** 2).sum(axis=1))
            closer = d < nearest
            own[closer], nearest = len(centres), np.minimum(nearest, d)
            centres.append(c)
        # each child's centre stands first
        by = np.lexsort((nearest, own))
        order[start:end] = rows[by]
        edges = np.searchsorted(own[by], np.arange(len(centres) + 1))
        if len(centres) > 1:
            node.children = [make(start + int(a), start + int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
        return node

    return make(0, len(x)), order


def _offer(best_s: np.ndarray, best_i: np.ndarray, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> None:
    """Merge scores (rows x ids, overwritten) into the rows' k best (score, then smaller id); a query's own id is left out."""
    scores[own[rows][:, None] == ids[None, :]] = NONE
    least = best_s[rows, k - 1]
    if scores.shape[1] > k:  # ties with the block's k-th stay in
        least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
    row, col = np.nonzero((scores >= least[:, None]) & (scores > NONE))
    if not len(row):
        return
    old = np.arange(len(rows))
    r = np.concatenate([np.repeat(old, k), row])
    s, i = np.concatenate([best_s[rows].ravel(), scores[row, col]]), np.concatenate([best_i[rows].ravel(), ids[col]])
    by = np.lexsort((i, -s, r))
    first = by[np.searchsorted(r[by], old)[:, None] + np.arange(k)]
    best_s[rows], best_i[rows] = s[first], i[first]


@dataclass
class Cell:
    """The lower part of a tree: vectors (integers, in doubles where these hold every score), ids, root and order."""

    x: np.ndarray
    ids: np.ndarray
    root: Node
    order: np.ndarray


def pack(cell: Cell) -> bytes:
    """A cell as bytes of plain arrays and tuples."""
    plain = lambda n: (n.start, n.end, n.centre, n.radius, n.norm, [plain(c) for c in n.children])
    return pickle.dumps((cell.x, cell.ids, plain(cell.root), cell.order))


def unpack(raw: bytes) -> Cell:
    x, ids, root, order = pickle.loads(raw)
    node = lambda t: Node(*t[:5], [node(c) for c in t[5]])
    return Cell(x, ids, node(root), order)


def make_cell(x: np.ndarray, ids: np.ndarray, leaf: int) -> Cell:
    root, order = build_tree(x.astype(np.float64), leaf)
    return Cell(x, ids, root, order)


class Frontier:
    """All nodes of a tree as arrays, breadth first: the children of node n are first[n] to first[n] + count[n]."""

    def __init__(self, root: Node) -> None:
        nodes, first = [root], []
        for n in nodes:  # grows on the way
            first.append(len(nodes))
            nodes += n.children
        self.first, self.count = np.array(first), np.array([len(n.children) for n in nodes])
        self.start, self.end = np.array([n.start for n in nodes]), np.array([n.end for n in nodes])
        self.centre, self.radius, self.norm = np.array([n.centre for n in nodes]), np.array([n.radius for n in nodes]), np.array([n.norm for n in nodes])

    def bounds(self, a: Node, at: np.ndarray) -> np.ndarray:
        """What no inner product of a vector of a with one of each node exceeds."""
        return self.centre[at] @ a.centre + a.radius * self.norm[at] + self.radius[at] * a.norm + a.radius * self.radius[at]

    def children(self, at: np.ndarray) -> np.ndarray:
        return _ranges(self.first[at], self.count[at])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _reaches(most: np.ndarray, worst: float) -> np.ndarray:
    return most + np.abs(most) * 1e-9 + 1e-6 >= worst - abs(worst) * 1e-12


def dual_search(q: Cell, d: Cell, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (scores, ids) of each query among d that reach kth (a known k-th score of each query), and the
    number of pairs scored.  Unused places have the score NONE.

    A query node goes down with all data nodes that may still hold an answer; a
    query leaf scores its data leaves in falling order of bounds, in blocks that
    double, so that one product serves many leaves.
    """
    best_s, best_i = np.full((len(q.ids), k), NONE, q.x.dtype), np.full((len(q.ids), k), np.iinfo(np.int64).max)
    if not len(q.ids) or not len(d.ids):
        return best_s, best_i, 0
    kth, scored, nodes = kth.astype(q.x.dtype), 0, Frontier(d.root)
    x, ids = d.x[d.order], d.ids[d.order]

    def visit(a: Node, front: np.ndarray) -> None:
        nonlocal scored
        rows = q.order[a.start : a.end]
        worst = lambda: float(np.maximum(best_s[rows, k - 1], kth[rows]).min())
        while True:
            most = nodes.bounds(a, front)
            kept = _reaches(most, worst())
            front, most = front[kept], most[kept]
            wide = (nodes.count[front] > 0) & ((nodes.radius[front] >= a.radius) | (not a.children))
            if not wide.any():
                break
            front = np.concatenate([front[~wide], nodes.children(front[wide])])
        if a.children:
            for c in a.children if len(front) else ():
                visit(c, front)
            return
        by, room = np.argsort(-most, kind="stable"), BLOCK
        front, most, mine = front[by], most[by], q.x[rows]
        while len(front):
            size = nodes.end[front] - nodes.start[front]
            n = max(1, int(np.searchsorted(np.cumsum(size), room, side="right")))
            cols = _ranges(nodes.start[front[:n]], size[:n])
            scored, room = scored + len(rows) * len(cols), 2 * room
            _offer(best_s, best_i, rows, mine @ x[cols].T, ids[cols], q.ids, k)
            kept = _reaches(most[n:], worst())
            front, most = front[n:][kept], most[n:][kept]

    visit(q.root, np.zeros(1, np.int64))
    return best_s, best_i, scored


def _vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every vector without null or non-finite components."""
    whole = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col(id_col).isNotNull() & F.coalesce(whole, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v")
    )


def _matrix(column: pd.Series, kind: type = np.int64) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(kind)


def _pivots(pool: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Up to n rows of pool, each drawn by its squared distance from those before."""
    rng, chosen = np.random.default_rng(seed), [0]
    nearest = ((pool - pool[0]) ** 2).sum(axis=1)
    while len(chosen) < n and nearest.sum() > 0:
        chosen.append(int(rng.choice(len(pool), p=nearest / nearest.sum())))
        nearest = np.minimum(nearest, ((pool - pool[chosen[-1]]) ** 2).sum(axis=1))
    return pool[chosen]


def _cells(points: DataFrame, region: int, seed: int) -> tuple[DataFrame, int]:
    """points with cell, the path of numbers that leads to it, and the depth of the deepest; no cell has much more than `region` vectors.

    A level splits all larger cells: pivots come from at most SAMPLE * FAN
    vectors of a cell (the result doesn't depend on them), and a cell is dealt
    to as many tasks as it has regions.  Vectors that are all one are dealt by hash.
    """
    placed, depth = points.withColumn("cell", F.array(F.lit(0).cast("long"))), 0
    while True:
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > region).withColumn("pieces", F.ceil(F.col("n") / region))
        sizes = durable(sizes, "sizes")
        if sizes.isEmpty():
            return placed, depth
        depth += 1
        large = placed.join(sizes, "cell")
        # a threshold from the cell's size leaves about twice the sample, and only these are ranked
        drawn = F.pmod(F.xxhash64(F.lit(seed + depth), "id", "v"), F.col("n")) < 2 * SAMPLE * FAN
        order = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed + depth), "id"), "id", "v")
        sample = large.filter(drawn).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE * FAN)

        def choose(group: pd.DataFrame) -> pd.DataFrame:
            made = _pivots(_matrix(group["v"], np.float64), int(min(FAN, max(2, group["pieces"].iloc[0]))), seed)
            return pd.DataFrame({"cell": [group["cell"].iloc[0]], "pieces": [group["pieces"].iloc[0]], "pivots": [made.tobytes()]})

        pivots = sample.select("cell", "pieces", "v").groupBy("cell").applyInPandas(choose, "cell array<long>, pieces long, pivots binary")
        pivots = pivots.select("cell", "pivots", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))

        def deal(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):  # pivots of a piece that no vector fell into
                return pd.DataFrame({"id": pd.Series(dtype=np.int64), "v": pd.Series(dtype=object), "cell": pd.Series(dtype=object)})
            x = _matrix(rows["v"], np.float64)
            centres = np.frombuffer(own["pivots"].iloc[0]).reshape(-1, x.shape[1])
            child = ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
            if len(centres) == 1:
                child = np.full(len(x), rows["piece"].iloc[0])
            return pd.DataFrame({"id": rows["id"], "v": rows["v"], "cell": [np.append(c, n) for c, n in zip(rows["cell"], child, strict=True)]})

        pieces = large.select("id", "v", "cell", F.pmod(F.xxhash64(F.lit(depth), "id"), "pieces").alias("piece")).groupBy("cell", "piece")
        split = pieces.cogroup(pivots.groupBy("cell", "piece")).applyInPandas(deal, "id long, v array<long>, cell array<long>")
        placed = durable(placed.join(sizes, "cell", "left_anti").select("id", "v", "cell").unionByName(split), "placed")


def _builder(leaf: int, kind: type):
    def build(group: pd.DataFrame) -> pd.DataFrame:
        cell = make_cell(_matrix(group["v"]).astype(kind), group["id"].to_numpy(np.int64), leaf)
        root = cell.root
        return pd.DataFrame({"cell": [group["cell"].iloc[0]], "centre": [root.centre], "radius": [root.radius], "norm": [root.norm], "ids": [cell.ids], "tree": [pack(cell)]})

    return build


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _nodes(cells: DataFrame, depth: int) -> list[DataFrame]:
    """By depth, from the root: node (path), centre, radius, norm of the nodes there; a cell that ends higher up stands for itself below."""

    def cover(group: pd.DataFrame) -> pd.DataFrame:
        centres = _matrix(group["centre"], np.float64)
        mean = centres.mean(axis=0)
        far = np.sqrt(((centres - mean) ** 2).sum(axis=1)) + group["radius"].to_numpy()
        return pd.DataFrame({"node": [group["up"].iloc[0]], "centre": [mean], "radius": [float(far.max())], "norm": [float(np.sqrt((mean**2).sum()))]})

    levels = [cells.select(F.col("cell").alias("node"), "centre", "radius", "norm")]
    for at in range(depth, 0, -1):  # a node's children are at most FAN
        up = levels[0].withColumn("up", F.slice("node", 1, at))
        levels.insert(0, durable(up.groupBy("up").applyInPandas(cover, "node array<long>, centre array<double>, radius double, norm double"), "nodes"))
    return levels


def top_k(
    data: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    scale: int = 256,
    region: int = REGION,
    seeds: int = 2,
    seed: int = 7,
) -> DataFrame:
    """One row a query and rank: query_id, rank (from 1), vec_id, score; exact.

    Vectors are turned into integers floor(scale * x); score is their inner
    product, exact as a 64-bit integer; a vector with a component (scaled) of
    sqrt(2^63 / dimensions) or more, whose scores needn't fit one, takes no part.
    Candidates are all rows of data but those with the query's id; ties go to
    the smaller id; fewer than k candidates give fewer rows.  Vectors that are
    null, empty, hold null or non-finite components, or have another length
    than most of data (of several the smallest), and rows with a null id, take
    no part.  Rows that repeat an id are one candidate, and one query, each
    with its best score.  Other columns aren't read; an empty side gives an
    empty result.
    """
    spark = data.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    points = durable(_vectors(data, id_col, vector_col, scale).distinct(), "points")
    usual = points.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return empty
    bound = int((2.0**63 / usual["size"]) ** 0.5)
    fits = (F.size("v") == usual["size"]) & ~F.exists("v", lambda x: (x >= bound) | (x <= -bound))
    points = points.filter(fits)
    asked = durable(_vectors(queries, id_col, vector_col, scale).filter(fits).distinct(), "asked")
    # the size of scores: at most dimensions * the largest component of either side
    largest = lambda df: df.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("m")).first()["m"]
    ours, theirs = largest(points), largest(asked)
    if ours is None or theirs is None:
        return empty
    most = usual["size"] * ours * theirs
    kind = np.float64 if most < 2.0**53 else np.int64
    sides = {}
    for side, df, size, leaf in (("d", points, region, LEAF), ("q", asked, min(region, QUERIES), QUERY_LEAF)):
        placed, depth = _cells(df, size, seed)

        cells = durable(placed.groupBy("cell").applyInPandas(_builder(leaf, kind), "cell array<long>, centre array<double>, radius double, norm double, ids array<long>, tree binary"), side)
        sides[side] = (cells, _nodes(cells, depth), depth)
    (d_cells, d_levels, d_depth), (q_cells, q_levels, q_depth) = sides["d"], sides["q"]

    def pairs(worst: list[DataFrame] | None, beam: int | None = None) -> DataFrame:
        """(q, d) pairs of cells, from the roots down: those whose bound reaches the query node's worst k-th score, or the `beam` most promising of each query node."""
        now = None
        for at in range(max(q_depth, d_depth) + 1):
            a, b = q_levels[min(at, q_depth)].toDF("q", "q_centre", "q_radius", "q_norm"), d_levels[min(at, d_depth)].toDF("d", "d_centre", "d_radius", "d_norm")
            if now is not None:  # children of both; a node that ends higher up is its own
                a, b = a.withColumn("q_up", F.slice("q", 1, at)), b.withColumn("d_up", F.slice("d", 1, at))
                a, b = now.join(a, "q_up"), b
                met = a.join(b, "d_up")
            else:
                met = a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one")  # the two roots
            dot = _dot("q_centre", "d_centre")
            met = met.select("q", "d", dot.alias("dot"), (dot + F.col("q_radius") * F.col("d_norm") + F.col("q_norm") * F.col("d_radius") + F.col("q_radius") * F.col("d_radius")).alias("bound"))
            if beam:
                met = met.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("dot"), "d"))).filter(F.col("place") <= beam)
            else:
                met = met.join(worst[min(at, q_depth)], "q", "left")
                met = met.filter(F.col("worst").isNull() | (F.col("bound") + F.abs("bound") * 1e-9 + 1e-6 >= F.col("worst") - F.abs("worst") * 1e-12))
            now = durable(met.select(F.col("q").alias("q_up"), F.col("d").alias("d_up")), "pairs")
        return now.toDF("q", "d")

    def search(plan: DataFrame, known: DataFrame | None) -> DataFrame:
        """The k best of the queries of every (q, d) pair of cells: a data cell's tree goes once to each TOGETHER query cells that it meets."""
        nth = F.row_number().over(Window.partitionBy("d").orderBy("q")) - 1
        plan = plan.select("q", "d", F.floor(nth / TOGETHER).alias("chunk"))
        kths = known.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("id", "kth"))).alias("kths")) if known is not None else None  # a cell's queries
        left = q_cells.select(F.col("cell").alias("q"), "tree")
        left = left.join(kths, "q", "left") if kths is not None else left.withColumn("kths", F.lit(None).cast("map<long,long>"))
        rows = plan.join(left, "q").select("d", "chunk", "tree", "kths", F.lit(True).alias("is_query"))
        others = plan.select("d", "chunk").distinct().join(d_cells.select(F.col("cell").alias("d"), "tree"), "d").select("d", "chunk", "tree", F.lit(None).cast("map<long,long>").alias("kths"), F.lit(False).alias("is_query"))

        def run(group: pd.DataFrame) -> pd.DataFrame:
            d, out = unpack(group["tree"][~group["is_query"]].iloc[0]), []
            for raw, kths in group.loc[group["is_query"], ["tree", "kths"]].itertuples(index=False):
                q, have = unpack(raw), dict(kths) if kths is not None else {}
                kth = np.array([have.get(int(i), NONE) for i in q.ids], np.int64)
                s, i, _ = dual_search(q, d, k, kth)
                row, col = np.nonzero((s > NONE) & (s >= kth.astype(s.dtype)[:, None]))
                out.append(pd.DataFrame({"query_id": q.ids[row], "vec_id": i[row, col], "score": s[row, col].astype(np.int64)}))
            return pd.concat(out)

        return rows.unionByName(others).groupBy("d", "chunk").applyInPandas(run, "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return one.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)

    started = durable(pairs(None, seeds), "started")
    first = durable(best(search(started, None)), "first")
    kth = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    known = durable(q_cells.select(F.col("cell").alias("q"), F.explode("ids").alias("id")).distinct().join(kth, "id", "left"), "known")
    # of each node the worst k-th score of its queries; unknown where one of them has none yet
    worst = [known.groupBy(F.slice("q", 1, at + 1).alias("q") if at < q_depth else F.col("q")).agg(F.when(F.count("kth") == F.count(F.lit(1)), F.min("kth")).alias("worst")) for at in range(q_depth + 1)]
    rest = pairs(worst).join(started, ["q", "d"], "left_anti")
    again = search(rest, known.filter("kth IS NOT NULL"))
    return best(first.select("query_id", "vec_id", "score").unionByName(again))
