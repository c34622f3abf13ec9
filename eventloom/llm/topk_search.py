"""Exact top-k inner-product search by dual cover trees.

Vectors are quantised to integers, so that scores are exact.  Data are cut into blocks
and queries into groups of bounded size: points go to the nearest of a few centres, and
what is still too large is split by a hash of the id, so that a vector that a third of
all rows share is spread.  Over each block and each group one cover tree is built, once,
and stored with its points in tree order.

A cover tree here is explicit: the centres of level l are points, further apart than
R / BASE**l; each point lies within that distance of one of them; the centres of a level
are centres of all finer ones.  Farthest-first insertion gives all levels at once.  A
node also keeps the distance of its furthest descendant as covering radius.  The inner
product of any query below node Q with any vector below node D is at most

    <q, d> + r(Q) |d| + r(D) |q| + r(Q) r(D)

(q, d the centres, r the covering radii).  A pair of nodes is pruned when that bound lies
strictly under the worst k-th score of the queries in Q.

The roots are compared first, in Spark: each group meets the block of the best centre,
which gives every query a floor under its k-th score; then only those pairs of a group
and a block are shipped whose root bound reaches the group's worst floor.  In a task the
two trees are walked together, starting from these floors; leaves are scored with matrix
products, the most promising pairs first.  A last window merges at most k rows a query
and block.

Edge cases: null vectors, vectors with a null or non-finite component (also after the
scaling), and rows with a null id take no part.  Only vectors of the same dimension are
compared.  Repeated rows are candidates each; a query's own id is never its candidate.  A
repeated query id counts once for each distinct vector.  Fewer than k candidates: all.
Ties go to the smaller id.  Where a double cannot hold a score, those that its error
cannot rule out are computed with Python's integers; scores beyond 64 bits saturate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

K = 20
SCALE = 64
BLOCK = 8_192
GROUP = 2_048
LEAF = 128
BASE = 1.3
CENTRES = 64  # the most top-level centres
SAMPLE = 4_096  # they are chosen from this many vectors of least hash
SALTS = 32
LOWEST = -(2**63)
_POINT = "dim int, part long, pos int, id long, v array<double>, radius double, nodes binary"


@dataclass
class Node:
    """A cover-tree node: the points ``lo`` to ``hi`` in tree order, the place of its
    centre among them, its level and covering radius."""

    lo: int
    hi: int
    centre: int
    level: int
    radius: float
    children: list["Node"] = field(default_factory=list)


def insertion(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Farthest-first order of at most ``most`` distinct rows, and the distance of each to
    the ones before it (infinite for the first); the next one's distance is appended."""
    picks, gaps = [0], [np.inf]
    near = np.linalg.norm(x - x[0], axis=1)
    while True:
        at = int(near.argmax())
        gaps.append(float(near[at]))
        if len(picks) == most or near[at] == 0:
            return np.array(picks), np.array(gaps)
        picks.append(at)
        near = np.minimum(near, np.linalg.norm(x - x[at], axis=1))


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Node]:
    """A permutation of the rows of ``x`` and the root of a cover tree over them, down to
    the finest level whose centres number at most the rows by ``leaf``."""
    picks, gaps = insertion(x, max(1, len(x) // leaf))
    reach = gaps[1]  # of the root
    if not 0 < reach < np.inf:
        return np.arange(len(x)), Node(0, len(x), 0, 0, 0.0 if reach == 0 else np.inf)
    sizes = [1]  # the number of centres of each complete level
    while sizes[-1] < len(picks):
        size = int((gaps[:-1] > reach / BASE ** len(sizes)).sum())
        if gaps[size] > reach / BASE ** len(sizes):  # the traversal ended inside this level
            break
        sizes.append(size)
    gram = np.linalg.norm(x[picks][:, None] - x[picks][None], axis=2)
    owner = np.full((len(sizes), len(x)), 0)
    near = np.full(len(x), np.inf)
    for c in range(sizes[-1]):
        d = np.linalg.norm(x - x[picks[c]], axis=1)
        owner[-1][d < near] = c
        near = np.minimum(near, d)
    for level in range(len(sizes) - 2, -1, -1):  # a centre's parent is the nearest centre of the coarser level
        parent = gram[: sizes[level + 1], : sizes[level]].argmin(axis=1)
        owner[level] = parent[owner[level + 1]]
    order = np.lexsort(owner[::-1])
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    owner = owner[:, order]

    def build(level: int, lo: int, hi: int) -> Node:
        centre = picks[owner[level][lo]]
        node = Node(lo, hi, int(place[centre]), level, float(np.linalg.norm(x[order[lo:hi]] - x[centre], axis=1).max()))
        while level + 1 < len(sizes) and hi - lo > leaf:
            level += 1
            cuts = np.flatnonzero(np.diff(owner[level][lo:hi])) + lo + 1
            if len(cuts):
                node.children = [build(level, a, b) for a, b in zip([lo, *cuts.tolist()], [*cuts.tolist(), hi], strict=True)]
                break
        return node

    return order, build(0, 0, len(x))


def stored(root: Node) -> bytes:
    """A tree as bytes: one row a node, parents first."""
    rows: list[tuple] = []
    stack = [(root, -1)]
    while stack:
        node, parent = stack.pop()
        rows.append((node.lo, node.hi, node.centre, node.level, node.radius, parent))
        stack.extend((c, len(rows) - 1) for c in reversed(node.children))
    return np.array(rows, np.float64).tobytes()


def restored(raw: bytes) -> Node:
    nodes: list[Node] = []
    for lo, hi, centre, level, radius, parent in np.frombuffer(raw, np.float64).reshape(-1, 6).tolist():
        nodes.append(Node(int(lo), int(hi), int(centre), int(level), radius))
        if parent >= 0:
            nodes[int(parent)].children.append(nodes[-1])
    return nodes[0]


class Best:
    """The k best (score, id) of each query of a group, by score, then smaller id; ``floor``
    holds scores that the k-th best reaches at least."""

    def __init__(self, k: int, floor: np.ndarray) -> None:
        self.k = k
        self.floor = floor.copy()
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * len(floor)
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * len(floor)

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.floor[q]
        s = np.concatenate([self.scores[q], scores[keep]])
        i = np.concatenate([self.ids[q], ids[keep]])
        top = np.lexsort((i, ~s))[: self.k]
        self.scores[q], self.ids[q] = s[top], i[top]
        if len(top) == self.k:
            self.floor[q] = max(self.floor[q], s[top[-1]])


def _scores(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products, saturated to 64 bits."""
    a = [int(t) for t in q]
    got = (sum(s * int(t) for s, t in zip(a, row, strict=True)) for row in rows)
    return np.array([min(max(g, LOWEST), 2**63 - 1) for g in got], np.int64)


def _leaves(best: Best, at: int, qx: np.ndarray, q_ids: np.ndarray, dx: np.ndarray, d_ids: np.ndarray, exact: bool) -> None:
    """Offer all products of the queries ``at`` and following with a leaf's points."""
    for lo in range(0, len(dx), 1024):
        d, ids = dx[lo : lo + 1024], d_ids[lo : lo + 1024]
        with np.errstate(over="ignore", invalid="ignore"):
            got = qx @ d.T
            slack = 0.0 if exact else len(d[0]) * 2.0**-50 * np.linalg.norm(qx, axis=1)[:, None] * np.linalg.norm(d, axis=1)
            low, high = (np.clip(g, -(2.0**63), 2.0**63) for g in (got - slack, got + slack))  # what saturates is tied
            own = ids[None, :] == q_ids[:, None]
            cut = best.floor[at : at + len(qx)].astype(np.float64)
            cut = cut - np.abs(cut) * (0.0 if exact else 2.0**-50)
            low[own | np.isnan(low)] = -np.inf
            if len(ids) > best.k:
                cut = np.maximum(cut, np.partition(low, len(ids) - best.k, axis=1)[:, len(ids) - best.k])
            may = ~(high < cut[:, None]) & ~own
        for r in np.flatnonzero(may.any(axis=1)):
            some = np.flatnonzero(may[r])
            best.offer(at + r, got[r, some].astype(np.int64) if exact else _scores(qx[r], d[some]), ids[some])


def dual_search(
    queries: np.ndarray, q_ids: np.ndarray, q_root: Node, data: np.ndarray, d_ids: np.ndarray, d_root: Node, k: int, floor: np.ndarray
) -> Best:
    """The best of ``data`` for every query that can still be in its top k; both in tree order."""
    best = Best(k, floor)
    with np.errstate(over="ignore", invalid="ignore"):
        exact = bool(np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * max(1, data.shape[1]) < 2.0**53)
        q_norm, d_norm = np.linalg.norm(queries, axis=1), np.linalg.norm(data, axis=1)

        def bound(a: Node, b: Node) -> float:
            product = float(queries[a.centre] @ data[b.centre])
            spread = a.radius * d_norm[b.centre] + b.radius * q_norm[a.centre] + a.radius * b.radius
            return product + spread + 1e-9 * (1 + spread + q_norm[a.centre] * d_norm[b.centre])

        stack = [(q_root, d_root)]
        while stack:
            a, b = stack.pop()
            worst = float(best.floor[a.lo : a.hi].min())
            if bound(a, b) < worst - 1e-9 * abs(worst):
                continue
            if not a.children and not b.children:
                _leaves(best, a.lo, queries[a.lo : a.hi], q_ids[a.lo : a.hi], data[b.lo : b.hi], d_ids[b.lo : b.hi], exact)
            elif not b.children or (a.children and a.radius > b.radius):
                stack.extend((c, b) for c in a.children)
            else:  # the most promising is looked at first
                stack.extend((a, c) for c in sorted(b.children, key=lambda c: bound(a, c)))
    return best


def quantised(vectors: DataFrame) -> DataFrame:
    """(id, dim, v): floor(64 x) of each usable vector, as doubles."""
    x = F.transform("embedding", lambda c: c.cast("double") * F.lit(float(SCALE)))
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # a double of 2**52 or more is an integer; adding 0.0 makes -0.0 to 0.0
    v = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c) + F.lit(0.0))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(
        F.coalesce(ok, F.lit(False))
    ).select(F.col("vec_id").cast("long").alias("id"), F.size("embedding").alias("dim"), v.alias("v"))


def centres(points: DataFrame) -> dict[int, np.ndarray]:
    """At most CENTRES farthest-first vectors of each dimension in a sample of SAMPLE rows."""
    sample = points.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("dim", "v").collect()
    by: dict[int, list] = {}
    for dim, v in sample:
        by.setdefault(dim, []).append(v)
    out = {}
    for dim, rows in by.items():
        x = np.array(rows, np.float64).reshape(len(rows), dim)
        with np.errstate(over="ignore", invalid="ignore"):
            out[dim] = x[insertion(x, CENTRES)[0]]
    return out


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def _runs(batches: Iterator[pa.RecordBatch], keys: int, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``fn`` on each run of rows that agree in the first ``keys`` columns; one run is held at a time."""
    key, held = None, []
    for batch in batches:
        values = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(values)], strict=True):
            if hi > lo:
                if held and key != tuple(values[lo]):
                    yield from fn(pa.Table.from_batches(held).combine_chunks())
                    held = []
                key = tuple(values[lo])
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield from fn(pa.Table.from_batches(held).combine_chunks())


def indexed(points: DataFrame, size: int, tops: dict[int, np.ndarray], label: str) -> DataFrame:
    """The points in parts of about ``size``, each in the order of its own cover tree, whose
    root's radius and nodes stand in the row of place 0 (``pos``), its centre in that row of
    place -1, a copy."""
    counts = points.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("int").alias("wanted"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            dims, wanted = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim in tops:
                    x = _matrix(batch.column(2).take(pa.array(at)), dim)
                    near = np.full(len(at), np.inf)
                    with np.errstate(over="ignore", invalid="ignore"):
                        for c, top in enumerate(tops[dim][: max(1, int(wanted[at[0]]))]):
                            d = np.linalg.norm(x - top, axis=1)
                            cell[at[d < near]] = c
                            near = np.fmin(near, d)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell)], names=["dim", "id", "v", "cell"])

    dealt = points.join(F.broadcast(counts) if small(counts) else counts, "dim").select("dim", "id", "v", "wanted")
    dealt = materialize(dealt.mapInArrow(deal, "dim int, id long, v array<double>, cell int"), f"{label}-cells")
    cells = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias("cuts"))
    part = F.col("cell").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("cuts"))
    parts = dealt.join(cells, ["dim", "cell"]).select("dim", part.alias("part"), "id", "v")
    parts = parts.repartition("dim", "part").sortWithinPartitions("dim", "part")

    def plant(table: pa.Table) -> Iterator[pa.RecordBatch]:
        dim = table.column("dim")[0].as_py()
        x = _matrix(table.column("v").combine_chunks(), dim)
        with np.errstate(over="ignore", invalid="ignore"):
            order, root = cover_tree(x)
        took = np.concatenate([order[root.centre : root.centre + 1], order])  # the centre's copy, then all
        n = len(took)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, dim, np.int32)), table.column("part").combine_chunks().take(pa.array(took)),
                pa.array(np.arange(-1, n - 1, dtype=np.int32)), table.column("id").combine_chunks().take(pa.array(took)),
                table.column("v").combine_chunks().take(pa.array(took)), pa.array([root.radius] + [None] * (n - 1), pa.float64()),
                pa.array([None, stored(root)] + [None] * (n - 2), pa.binary()),
            ],
            names=["dim", "part", "pos", "id", "v", "radius", "nodes"],
        )

    return materialize(parts.mapInArrow(lambda batches: _runs(batches, 2, plant), _POINT), label)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def root_pairs(queries: DataFrame, data: DataFrame) -> DataFrame:
    """(dim, grp, blk, near, bound) for all groups and blocks of one dimension: the product
    of the roots' centres, and what no product of their points exceeds."""
    root = lambda df, name: df.filter("pos = -1").select(
        "dim", F.col("part").alias(name), F.col("v").alias(f"{name}_v"), F.col("radius").alias(f"{name}_r"), F.sqrt(_dot(F.col("v"), F.col("v"))).alias(f"{name}_n")
    )
    groups = root(queries, "grp").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    blocks = root(data, "blk").withColumn("salt", F.pmod(F.xxhash64("blk"), F.lit(SALTS)).cast("int"))
    near = _dot(F.col("grp_v"), F.col("blk_v"))
    spread = F.col("grp_r") * F.col("blk_n") + F.col("blk_r") * F.col("grp_n") + F.col("grp_r") * F.col("blk_r")
    bound = near + spread + F.lit(1e-9) * (1 + spread + F.col("grp_n") * F.col("blk_n"))
    return groups.join(blocks, ["dim", "salt"]).select("dim", "grp", "blk", near.alias("near"), bound.alias("bound"))


def search_pairs(queries: DataFrame, data: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(dim, grp, pos, query_id, vec_id, score): at most k rows for each query of ``queries``
    (with its ``floor``) and each block that ``pairs(dim, grp, blk)`` gives its group."""
    cols = ["dim", "grp", "blk", "query", "pos", "id", "v", "nodes", "floor"]
    asked = queries.filter("pos >= 0").withColumnRenamed("part", "grp").join(pairs, ["dim", "grp"]).withColumn("query", F.lit(0))
    given = data.filter("pos >= 0").withColumnRenamed("part", "blk").join(pairs, ["dim", "blk"])
    given = given.withColumn("query", F.lit(1)).withColumn("floor", F.lit(None).cast("long"))
    rows = asked.select(cols).unionByName(given.select(cols))
    rows = rows.repartition("dim", "grp", "blk").sortWithinPartitions("dim", "grp", "blk", "query", "pos")

    def walk(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cut = int((table.column("query").to_numpy() == 0).sum())
        if not cut or cut == table.num_rows:
            return
        dim, grp = table.column("dim")[0].as_py(), table.column("grp")[0].as_py()
        ids = table.column("id").to_numpy()
        x = _matrix(table.column("v").combine_chunks(), dim)
        floor = table.column("floor").slice(0, cut).fill_null(LOWEST).to_numpy()
        q_root, d_root = (restored(table.column("nodes")[i].as_py()) for i in (0, cut))
        best = dual_search(x[:cut], ids[:cut], q_root, x[cut:], ids[cut:], d_root, k, floor)
        n = np.array([len(s) for s in best.scores])
        if n.sum():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n.sum(), dim, np.int32)), pa.array(np.full(n.sum(), grp, np.int64)), pa.array(np.repeat(np.arange(cut, dtype=np.int32), n)),
                    pa.array(np.repeat(ids[:cut], n)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores)),
                ],
                names=["dim", "grp", "pos", "query_id", "vec_id", "score"],
            )

    return rows.mapInArrow(lambda batches: _runs(batches, 3, walk), "dim int, grp long, pos int, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int = 20, k: int = K, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries ``vec_id % every = 0``."""
    points = materialize(quantised(vectors), "points")
    tops = centres(points)
    data = indexed(points, block, tops, "data")
    queries = indexed(points.filter(F.col("id") % every == 0).distinct(), group, tops, "queries")
    pairs = materialize(root_pairs(queries, data), "pairs")
    home = pairs.groupBy("dim", "grp").agg(F.max_by("blk", F.struct(F.coalesce("near", F.lit(0.0)), "blk")).alias("blk"))
    home = materialize(home, "home")
    none = F.lit(None).cast("long")
    found = materialize(search_pairs(queries.withColumn("floor", none), data, home, k), "home-found")
    floors = found.groupBy("dim", F.col("grp").alias("part"), "pos").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    floored = materialize(queries.join(floors, ["dim", "part", "pos"], "left"), "floored")
    worst = floored.filter("pos >= 0").groupBy("dim", F.col("part").alias("grp")).agg(F.min(F.coalesce("floor", F.lit(LOWEST))).alias("worst"))
    reached = ~(F.col("bound") < F.col("worst").cast("double") - F.abs(F.col("worst").cast("double")) * 1e-9)  # also if not a number
    others = pairs.join(worst, ["dim", "grp"]).filter(reached).join(home, ["dim", "grp", "blk"], "left_anti").select("dim", "grp", "blk")
    found = found.unionByName(search_pairs(floored, data, materialize(others, "others"), k))
    by = Window.partitionBy("dim", "grp", "pos").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 20, k: int = K) -> str:
    """The same result by brute force in DuckDB SQL."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
