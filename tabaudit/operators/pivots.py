"""Exact nearest neighbours by boxes, balls and the triangle inequality.

Equal vectors are one: the search runs over distinct vectors, so copies cost
nothing and a vector that a third of all rows share is one row. Every table of
references is cut into cells by a k-d tree that is fitted on a bounded sample
of it; all rows are put into its cells, and neighbouring cells into blocks of
bounded size. Two things bound the distance to a cell's members from below: the
box that holds them, and the ball around a point of the cell. Boxes are tight
where columns are bits, categories and few numbers, balls where all elements
vary together.

1. Every query is sent to the block of its own cell, which gives it an upper
   bound.
2. It is sent to exactly those other blocks of which some cell may hold a
   nearer vector; the tree finds these without looking at the others. In the
   worst case these are all blocks, as in a block join.

A task has one block of references and a bounded number of queries, and prunes
once more with a tree of its block. Several reference tables (``kind``) are
searched in the same two rounds. Bounds are widened by their rounding error, so
that results are those of the full comparison.

Euclidean distances are bounded directly, cosine distances as those of unit
vectors; city-block, Chebyshev and Hamming distances have bounds of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.session import cut_lineage

#: Bounds of what the driver holds and broadcasts: cells, and numbers in the samples they are fitted on.
MAX_CELLS, SAMPLE_VALUES = 4096, 4_000_000
#: Sampled vectors a cell, references of a block, queries that one task compares with a block.
CELL_SAMPLE, BLOCK_ROWS, QUERY_ROWS = 32, 16384, 8192
#: References of a cell inside a task, and the share of (query, cell) pairs from which on a task compares its whole block.
INNER_ROWS, WHOLE_SHARE = 128, 0.2
#: Rows that a task sends at a time.
ASK_ROWS = 1 << 14


def matrix(col) -> np.ndarray:
    """Rows of an Arrow list column as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def cleaned(df: DataFrame, metric: str) -> DataFrame:
    """``df`` with its column v NULL where a vector has no distances (an undefined
    element, and for the cosine all zeros), and -0.0 as 0.0. Made on Arrow
    batches: v may be a long expression, which is worked out once a row."""
    at = df.columns.index("v")
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == "v" else f.dataType) for f in df.schema.fields])

    def run(batches):
        for batch in batches:
            col, n = batch.column(at), len(batch)
            size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
            x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64) + 0.0  # a NULL is a NaN
            of = np.repeat(np.arange(n), size)
            bad = np.bincount(of, ~np.isfinite(x), n) > 0
            if metric == "cosine":
                bad |= np.bincount(of, x != 0, n) == 0
            bad |= col.is_null().to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            v = pa.ListArray.from_arrays(pa.array(ends), pa.array(x), mask=pa.array(bad))
            yield pa.RecordBatch.from_arrays([v if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, schema)


def space(x: np.ndarray, metric: str) -> np.ndarray:
    """The vectors between which distances obey the triangle inequality."""
    return x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x


def bound_of(dist: np.ndarray, metric: str) -> np.ndarray:
    """Distances of ``metric`` as distances in its space."""
    if metric == "sqeuclidean":
        return np.sqrt(dist)
    if metric == "cosine":
        return np.sqrt(np.maximum(2 * dist, 0.0))
    return dist


def to_pivots(x: np.ndarray, pivots: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(distances to all pivots, bound of their rounding error a row)."""
    if metric in ("cityblock", "chebyshev", "hamming"):
        s = np.zeros((len(x), len(pivots)))
        for j in range(x.shape[1]):
            d = x[:, j, None] - pivots[None, :, j]
            if metric == "hamming":
                s += d != 0
            elif metric == "cityblock":
                s += np.abs(d)
            else:
                np.maximum(s, np.abs(d), out=s)
        s = s / x.shape[1] if metric == "hamming" else s
        return s, 1e-12 * (1.0 + s.max(axis=1, initial=0.0))
    centre = pivots.mean(axis=0)
    a, b = x - centre, pivots - centre
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    s = a @ (-2.0 * b).T
    s += na[:, None]
    s += nb
    np.maximum(s, 0.0, out=s)
    np.sqrt(s, out=s)
    # rounding of the square, of the subtraction of large offsets, and the root of it near 0
    offset = np.abs(x).max(axis=1, initial=0.0) + np.abs(centre).max(initial=0.0)
    eps = np.finfo(float).eps
    return s, np.sqrt(8 * eps * (x.shape[1] + 2) * (na + nb.max())) + 8 * eps * offset * np.sqrt(x.shape[1])


def ball_metric(metric: str) -> str:
    """The metric between vectors of ``metric``'s space."""
    return "euclidean" if metric in ("cosine", "sqeuclidean") else metric


def gaps(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, metric: str) -> np.ndarray:
    """Least distance from each row to any vector inside the box."""
    g = np.maximum(lo - x, x - hi)
    np.maximum(g, 0.0, out=g)
    if metric == "hamming":
        return (g > 0).mean(axis=1)
    if metric == "cityblock":
        return g.sum(axis=1)
    if metric == "chebyshev":
        return g.max(axis=1, initial=0.0)
    return np.sqrt(np.einsum("ij,ij->i", g, g))


def limit_of(best: np.ndarray, metric: str, d: int) -> np.ndarray:
    """Bounds up to which a box may hold something nearer than ``best``; a
    cosine near 1 has few digits, all others have relative errors only."""
    slack = np.sqrt(16 * np.finfo(float).eps * (d + 2)) if metric == "cosine" else 0.0
    return bound_of(best, metric) * (1 + 1e-9) + slack


class Tree:
    """A k-d tree: nodes are cut at about the median of the element that
    varies most until they have at most ``leaf_rows`` vectors. Leaves are
    numbered so that neighbours are near."""

    def __init__(self, x: np.ndarray, leaf_rows: int):
        self.dim: list[int] = []          # -1: a leaf
        self.cut: list[float] = []
        self.kids: list[list[int]] = []
        self.leaf: list[int] = []
        self.of = np.zeros(len(x), np.int64)  # leaf of every vector of x
        self.leaves = 0
        stack = [(np.arange(len(x)), -1)]
        while stack:
            rows, parent = stack.pop()
            node = len(self.dim)
            if parent >= 0:
                self.kids[parent].append(node)
            at = self._cut_of(x[rows]) if len(rows) > leaf_rows else None
            self.dim.append(-1 if at is None else at[0])
            self.cut.append(0.0 if at is None else at[1])
            self.kids.append([])
            self.leaf.append(self.leaves if at is None else -1)
            if at is None:
                self.of[rows] = self.leaves
                self.leaves += 1
            else:
                low = x[rows, at[0]] <= at[1]
                stack += [(rows[~low], node), (rows[low], node)]  # the lower side is the first child

    @staticmethod
    def _cut_of(x: np.ndarray) -> tuple[int, float] | None:
        for j in np.argsort(-x.var(axis=0), kind="stable"):
            s = np.sort(x[:, j])
            if s[0] == s[-1]:
                continue
            low = s[(len(s) - 1) // 2]
            if low == s[-1]:
                low = s[np.searchsorted(s, low) - 1]
            high = s[np.searchsorted(s, low, side="right")]
            cut = low + (high - low) / 2
            return int(j), float(cut if cut < high else low)
        return None

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if self.dim[node] < 0:
                out[rows] = self.leaf[node]
                continue
            low = x[rows, self.dim[node]] <= self.cut[node]
            stack += [(self.kids[node][1], rows[~low]), (self.kids[node][0], rows[low])]
        return out

    def enclose(self, lo: np.ndarray, hi: np.ndarray) -> None:
        """Take the leaves' boxes and make those of all nodes."""
        self.lo, self.hi = np.empty((len(self.dim), lo.shape[1])), np.empty((len(self.dim), lo.shape[1]))
        for node in range(len(self.dim) - 1, -1, -1):  # children come after their parents
            kids, leaf = self.kids[node], self.leaf[node]
            self.lo[node] = lo[leaf] if leaf >= 0 else self.lo[kids].min(axis=0)
            self.hi[node] = hi[leaf] if leaf >= 0 else self.hi[kids].max(axis=0)

    def reached(self, x: np.ndarray, limit: np.ndarray, metric: str):
        """(leaf, rows) whose box is no farther than a row's limit."""
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            rows = rows[gaps(x[rows], self.lo[node], self.hi[node], metric) <= limit[rows]]
            if not len(rows):
                continue
            if self.dim[node] < 0:
                yield self.leaf[node], rows
            else:
                stack += [(k, rows) for k in self.kids[node]]


def boxes(x: np.ndarray, cell: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows by cell, least, greatest elements of each cell); every cell has rows."""
    order = np.argsort(cell, kind="stable")
    first = np.searchsorted(cell[order], np.arange(n))
    return order, np.minimum.reduceat(x[order], first, axis=0), np.maximum.reduceat(x[order], first, axis=0)


def pruned_min(qa: np.ndarray, rb: np.ndarray, ida, idb, best: np.ndarray, metric: str) -> np.ndarray:
    """Least distance from each row of ``qa`` to the rows of ``rb`` (rows with
    an equal id left out when ``idb`` is given), where it is below ``best``."""
    from tabaudit.operators.neighbors import _block_min, pair_distance
    a, b = space(qa, metric), space(rb, metric)
    tree = Tree(b, INNER_ROWS)
    n = tree.leaves
    order, lo, hi = boxes(b, tree.of, n)
    tree.enclose(lo, hi)
    ends = np.searchsorted(tree.of[order], np.arange(n), side="right")
    centre = np.add.reduceat(b[order], np.concatenate(([0], ends[:-1])), axis=0) / np.diff(ends, prepend=0)[:, None]
    radius = np.zeros(n)
    np.maximum.at(radius, tree.of, pair_distance(b, centre[tree.of], ball_metric(metric)) * (1 + 1e-9))
    home = tree.place(a)
    best = best.copy()

    def visit(c: int | None, rows: np.ndarray) -> None:
        members = order if c is None else order[ends[c - 1] if c else 0:ends[c]]
        if len(rows) and len(members):
            got = _block_min(qa[rows], rb[members], None if idb is None else ida[rows], None if idb is None else idb[members], metric)
            best[rows] = np.fmin(best[rows], got)

    by_home = np.argsort(home, kind="stable")
    upto = np.searchsorted(home[by_home], np.arange(n), side="right")
    for c in range(n):
        visit(c, by_home[upto[c - 1] if c else 0:upto[c]])
    limit = limit_of(best, metric, a.shape[1])
    found = [(c, rows[home[rows] != c]) for c, rows in tree.reached(a, limit, metric)]
    far, err = to_pivots(a, centre, metric)
    far -= radius
    found = [(c, rows[far[rows, c] - err[rows] <= limit[rows]]) for c, rows in found]
    left = np.zeros(len(a), np.int64)
    for _, rows in found:
        left[rows] += 1
    # queries for which bounds say little go over the block in one product
    wide = left > max(1, WHOLE_SHARE * n)
    visit(None, np.nonzero(wide)[0])
    for c, rows in found:
        rows = rows[~wide[rows]]
        now = limit_of(best[rows], metric, a.shape[1])  # it may have fallen since
        near = (far[rows, c] - err[rows] <= now) & (gaps(a[rows], lo[c], hi[c], metric) <= now)
        visit(c, rows[near])
    return best


class Router:
    """Trees, boxes, balls and blocks of all kinds of references; a few numbers a cell."""

    def __init__(self, trees: dict[int, Tree], centres: dict[int, np.ndarray], metric: str,
                 cells: dict[tuple[int, int], tuple[int, float, np.ndarray, np.ndarray]], block_rows: int):
        self.trees, self.centres, self.metric = trees, centres, metric
        self.kinds = sorted(trees)
        self.blocks = 0
        self.radius: dict[int, np.ndarray] = {}
        self.first: dict[int, np.ndarray] = {}
        self.parts: dict[int, np.ndarray] = {}
        self.table: list[tuple[int, int, int, int]] = []  # kind, cell, first block, blocks
        for k in self.kinds:
            mine = [cells[k, c] for c in range(trees[k].leaves)]
            trees[k].enclose(np.array([c[2] for c in mine]), np.array([c[3] for c in mine]))
            first, parts, held = [], [], 0
            for n, *_ in mine:
                if n > block_rows:  # a cell in several blocks
                    first.append(self.blocks + bool(held))
                    parts.append(-(-n // block_rows))
                    self.blocks, held = first[-1] + parts[-1], 0
                else:
                    if held + n > block_rows:
                        self.blocks, held = self.blocks + 1, 0
                    first.append(self.blocks)
                    parts.append(1)
                    held += n
            self.blocks += bool(held)
            self.radius[k], self.first[k], self.parts[k] = np.array([c[1] for c in mine]), np.array(first), np.array(parts)
            self.table += [(k, c, f, p) for c, (f, p) in enumerate(zip(first, parts))]

    def home(self, x: np.ndarray, kind: int, qid: np.ndarray) -> np.ndarray:
        """The block that a query asks first."""
        c = self.trees[kind].place(x)
        return self.first[kind][c] + qid % self.parts[kind][c]

    def others(self, x: np.ndarray, kind: int, qid: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of all other blocks that may hold something nearer."""
        limit = limit_of(best, self.metric, x.shape[1])
        first, parts = self.first[kind], self.parts[kind]
        pairs = [np.zeros(0, np.int64)]
        for a in range(0, len(x), 2048):
            part = slice(a, a + 2048)
            far = err = None
            for c, rows in self.trees[kind].reached(x[part], limit[part], self.metric):
                if far is None:
                    far, err = to_pivots(x[part], self.centres[kind], self.metric)
                rows = rows[far[rows, c] - self.radius[kind][c] - err[rows] <= limit[part][rows]]
                pairs += [(rows + a) * self.blocks + b for b in range(first[c], first[c] + parts[c])]
        row, block = np.divmod(np.unique(np.concatenate(pairs)), self.blocks)
        keep = block != self.home(x, kind, qid)[row]
        return row[keep], block[keep]


_STATS = pa.schema([("kind", pa.int32()), ("cell", pa.int32()), ("n", pa.int64()), ("r", pa.float64()), ("lo", pa.list_(pa.float64())),
                    ("hi", pa.list_(pa.float64()))])
_ASKS = "qid long, v array<double>, kind int, block int, best double"


def _ask_rows(qid, v, rows, kind, block, best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(qid[rows]), v.take(pa.array(rows)), pa.array(np.full(len(rows), kind, np.int32)), pa.array(block.astype(np.int32)),
         pa.array(best[rows])], names=["qid", "v", "kind", "block", "best"])


def ask_others(batches, r: Router, metric: str):
    """The second round's rows from batches (qid, v, bound of each kind)."""
    for batch in batches:
        qid, v = batch.column(0).to_numpy(), batch.column(1)
        x = space(matrix(v), metric)
        for i, k in enumerate(r.kinds):
            best = batch.column(2 + i).to_numpy(zero_copy_only=False)
            asked = np.nonzero(~np.isnan(best))[0]  # NULL: this kind was not asked
            # a query may ask all blocks: a bounded number of rows at a time
            step = max(256, (1 << 22) // r.blocks)
            for part in (asked[a:a + step] for a in range(0, len(asked), step)):
                row, block = r.others(x[part], k, qid[part], best[part])
                for a in range(0, len(row), ASK_ROWS):
                    rows = part[row[a:a + ASK_ROWS]]
                    yield _ask_rows(qid, v, rows, k, block[a:a + ASK_ROWS], best)


def search(queries: DataFrame, refs: DataFrame, metric: str, own: int | None = None, block_rows: int = BLOCK_ROWS,
           query_rows: int = QUERY_ROWS) -> DataFrame:
    """(qid, kind, dist): for each query the least distance to the references
    of every kind; none where a kind has no other vector. ``queries``: (qid, v,
    alone) and ``refs``: (kind, vid, v), written tables of distinct defined
    vectors; the references of kind ``own`` are the queries themselves, whose
    ids are qids, and only queries with ``alone`` ask them."""
    spark = queries.sparkSession
    kinds = {r["kind"]: r["n"] for r in refs.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = "qid long, kind int, dist double"
    if not kinds:
        return spark.createDataFrame([], schema)
    d = refs.select(F.size("v").alias("d")).first()["d"]
    room = max(1, min(MAX_CELLS, SAMPLE_VALUES // (CELL_SAMPLE * max(1, d))))
    total = sum(kinds.values())
    # cells of half a block; where that are too many, every kind has its share of them
    wanted = {k: min(max(1, -(-2 * n // block_rows)), max(1, room * n // total)) for k, n in kinds.items()}
    u = F.pmod(F.xxhash64("v", "kind"), F.lit(1 << 30))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in kinds.items() for x in (k, int(min(1.0, CELL_SAMPLE * wanted[k] / n) * (1 << 30)))]), F.col("kind"))
    drawn = refs.where(u < share).select("kind", "v").toArrow()
    of_kind, drawn = drawn.column("kind").to_numpy(), space(matrix(drawn.column("v")), metric).reshape(-1, d)
    trees, centres = {}, {}
    for k in kinds:
        x = drawn[of_kind == k]
        if not len(x):  # so few that none was drawn
            x = space(matrix(refs.where(F.col("kind") == k).select("v").limit(1).toArrow().column("v")), metric)
        x = x[np.lexsort(x.T)]
        trees[k] = Tree(x, max(1, len(x) // wanted[k]))
        centres[k] = np.array([x[trees[k].of == c].mean(axis=0) for c in range(trees[k].leaves)])
    shared = spark.sparkContext.broadcast((trees, centres))

    def place(batches):
        t, _ = shared.value
        for batch in batches:
            kind, x = batch.column(0).to_numpy(), space(matrix(batch.column(2)), metric)
            cell = np.zeros(len(x), np.int32)
            for k in np.unique(kind):
                cell[kind == k] = t[k].place(x[kind == k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["kind", "vid", "v", "cell"])

    placed = cut_lineage(refs.select("kind", "vid", "v").mapInArrow(place, "kind int, vid long, v array<double>, cell int"))
    stats = "kind int, cell int, n long, r double, lo array<double>, hi array<double>"

    def measure(batches):
        """A task's share of every cell."""
        from tabaudit.operators.neighbors import pair_distance
        held: dict[tuple[int, int], list] = {}
        _, c = shared.value
        for batch in batches:
            kind, x, cell = batch.column(0).to_numpy(), space(matrix(batch.column(2)), metric), batch.column(3).to_numpy()
            for k in np.unique(kind):
                mine, of = x[kind == k], cell[kind == k]
                present, of = np.unique(of, return_inverse=True)
                order, lo, hi = boxes(mine, of, len(present))
                r = np.zeros(len(present))
                np.maximum.at(r, of, pair_distance(mine, c[k][present[of]], ball_metric(metric)) * (1 + 1e-9))
                for i, (one, n) in enumerate(zip(present.tolist(), np.bincount(of).tolist())):
                    old = held.get((int(k), one))
                    held[int(k), one] = [n, r[i], lo[i], hi[i]] if old is None else [
                        old[0] + n, max(old[1], r[i]), np.minimum(old[2], lo[i]), np.maximum(old[3], hi[i])]
        for (k, one), (n, r, lo, hi) in held.items():
            yield pa.RecordBatch.from_pylist([{"kind": k, "cell": one, "n": n, "r": float(r), "lo": lo.tolist(), "hi": hi.tolist()}], _STATS)

    def together(t: pa.Table) -> pa.Table:
        """The tasks' shares of a cell as one row."""
        lo, hi = matrix(t.column("lo")).min(axis=0), matrix(t.column("hi")).max(axis=0)
        return pa.Table.from_pylist([{"kind": t.column("kind")[0].as_py(), "cell": t.column("cell")[0].as_py(), "n": int(t.column("n").to_numpy().sum()),
                                      "r": float(t.column("r").to_numpy().max()), "lo": lo.tolist(), "hi": hi.tolist()}], _STATS)

    cells = placed.mapInArrow(measure, stats).groupBy("kind", "cell").applyInArrow(together, stats).toArrow()  # MAX_CELLS rows, and one a kind
    lo, hi = matrix(cells.column("lo")), matrix(cells.column("hi"))
    found = {(k, c): (n, r, lo[i], hi[i]) for i, (k, c, n, r) in enumerate(zip(*[cells.column(x).to_pylist() for x in ("kind", "cell", "n", "r")]))}
    router = Router(trees, centres, metric, found, block_rows)
    routes = spark.createDataFrame(router.table, "kind int, cell int, first int, parts int")  # as many
    blocks = placed.join(F.broadcast(routes), ["kind", "cell"]).select(
        "vid", "v", (F.col("first") + F.pmod(F.col("vid"), F.col("parts"))).cast("int").alias("block"))
    everywhere = spark.sparkContext.broadcast(router)

    def compare(asks: DataFrame) -> DataFrame:
        load = cut_lineage(asks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("chunks")))
        tasks = load.agg(F.sum("chunks").alias("n")).first()["n"] or 0
        cores = spark.sparkContext.defaultParallelism
        n = max(cores, min(tasks, 8 * cores + tasks // 8, 100_000))  # many comparisons are short: several a task
        left = asks.join(load, "block").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int")).drop("chunks")
        right = blocks.join(load, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

        def run(asked: pa.Table, held: pa.Table) -> pa.Table:
            qid, kind = asked.column("qid").to_numpy(), asked.column("kind").to_numpy()
            best = asked.column("best").to_numpy()
            if len(qid) and len(held):
                mine = own is not None and kind[0] == own  # a block has one kind
                found = pruned_min(matrix(asked.column("v")), matrix(held.column("v")), qid, held.column("vid").to_numpy() if mine else None, best, metric)
            else:
                found = best
            return pa.table({"qid": pa.array(qid), "kind": pa.array(kind, pa.int32()), "dist": pa.array(found)})

        return left.repartition(n, "block", "chunk").groupBy("block", "chunk").cogroup(
            right.repartition(n, "block", "chunk").groupBy("block", "chunk")).applyInArrow(run, schema)

    def first(batches):
        r = everywhere.value
        for batch in batches:
            qid, alone, v = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(1)
            x = space(matrix(v), metric)
            for k in r.kinds:
                rows = np.nonzero(alone)[0] if k == own else np.arange(len(x))
                if len(rows):
                    yield _ask_rows(qid, v, rows, k, r.home(x[rows], k, qid[rows]), np.full(len(qid), np.inf))

    near = cut_lineage(compare(queries.select("qid", "v", "alone").mapInArrow(first, _ASKS)))
    bounds = near.groupBy("qid").agg(*[F.min(F.when(F.col("kind") == k, F.col("dist"))).alias(f"b{k}") for k in router.kinds])
    known = queries.select("qid", "v").join(bounds, "qid")

    # written once: the load of the blocks and the comparisons both read it
    more = compare(cut_lineage(known.mapInArrow(lambda batches: ask_others(batches, everywhere.value, metric), _ASKS)))
    out = near.unionByName(more).where(F.col("dist") != float("inf"))
    return out.groupBy("qid", "kind").agg(F.min("dist").alias("dist"))


def nearest_by_kind(rows: DataFrame, others: dict[str, DataFrame], own: str | None = None, metric: str = "euclidean",
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, kind, dist) for every row (id, v) of ``rows`` and every name of
    ``others``, frames (v), and ``own``, the other rows of ``rows``. dist is
    NULL when undefined: a vector without distances, or no other one. Repeated
    ids are an error."""
    rows = cut_lineage(cleaned(rows.select("id", "v"), metric))
    if not rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("row ids repeat")
    names = ([own] if own is not None else []) + list(others)
    distinct = cut_lineage(rows.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("qid", F.monotonically_increasing_id()))
    parts = [distinct.select(F.lit(0).alias("kind"), F.col("qid").alias("vid"), "v")] if own is not None else []
    for name, df in others.items():
        kept = cleaned(df.select("v"), metric).where("v IS NOT NULL").distinct()
        parts.append(kept.select(F.lit(names.index(name)).alias("kind"), F.monotonically_increasing_id().alias("vid"), "v"))
    refs = parts[0]
    for p in parts[1:]:
        refs = refs.unionByName(p)
    found = search(distinct.select("qid", "v", (F.col("n") == 1).alias("alone")), cut_lineage(refs), metric, 0 if own is not None else None, block_rows)
    wide = found.groupBy("qid").agg(*[F.min(F.when(F.col("kind") == k, F.col("dist"))).alias(f"d{k}") for k in range(len(names))])
    held = distinct.join(wide, "qid", "left")
    dists = [F.col(f"d{k}") for k in range(len(names))]
    if own is not None:  # a vector that several rows have
        dists[0] = F.when(F.col("n") > 1, F.lit(0.0)).otherwise(dists[0])
    # a hash before the vector: rows are sorted by it, and vectors are compared where it is equal
    per = held.select(F.xxhash64("v").alias("_h"), F.col("v").alias("_v"), F.array(*[F.struct(F.lit(name).alias("kind"), d.alias("dist")) for name, d in zip(names, dists)]).alias("_all"))
    none = F.array(*[F.struct(F.lit(name).alias("kind"), F.lit(None).cast("double").alias("dist")) for name in names])
    joined = rows.select("id", F.col("v").alias("_v"), F.xxhash64("v").alias("_h")).join(per, ["_h", "_v"], "left")
    return joined.select("id", F.explode(F.coalesce("_all", none)).alias("p")).select("id", "p.kind", "p.dist")
