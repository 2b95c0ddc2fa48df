"""Approximate nearest neighbours by largest inner product: vantage-point trees in shards.

Vectors are lifted by one component to equal length, after which the largest inner product is
the least Euclidean distance, a metric.  A top tree, whose vantage points and radii come from a
bounded sample, deals all vectors to shards by their distances; each shard holds one tree and
the exact range of its distances to the vantage points above it.  A query visits its shards from
the nearest on, twice as many in each round, with the bound that it has so far.  A shard or a
subtree is skipped when the triangle inequality puts it beyond `factor` times the distance of the
worst neighbour kept so far.  Factor 1 is exact; less prunes more and may lose some neighbours.
"""

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.llm.common import stored

#: Neighbours of a query, and which ids are queries.
NEIGHBOURS, QUERY_STEP = 20, 20
#: Share of the worst kept distance within which a shard or subtree is searched (1: exact).
FACTOR = 0.2
#: Distinct vectors in a shard, about, queries in a block, vectors in a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF = 8192, 1024, 128
#: Bounds of the top tree: its shards (larger ones are split by hash), and sampled vectors a shard.
MAX_SHARDS, SAMPLE_ROWS = 4096, 32
#: Blocks of queries that share one copy of a shard's tree.
SHARING = 16

# ---- the tree ------------------------------------------------------------------------------


class Tree:
    """Distinct vectors in tree order with their ids; nodes are ranges of that order."""

    def __init__(self, order: np.ndarray, nodes: np.ndarray, radii: np.ndarray):
        self.order, self.nodes, self.radii = order, nodes, radii

    @classmethod
    def build(cls, lifted: np.ndarray, leaf: int = LEAF, seed: int = 2) -> "Tree":
        """nodes: start, end, left, right (-1: a leaf); the first of a range is its vantage point.

        radii: farthest distance on the left side and nearest on the right side.
        """
        rng = np.random.default_rng(seed)
        order = np.arange(len(lifted))
        nodes, radii, todo = [[0, len(lifted), -1, -1]], [[0.0, 0.0]], [0]
        while todo:
            k = todo.pop()
            a, b = nodes[k][:2]
            if b - a <= leaf:
                continue
            pick = a + int(rng.integers(b - a))
            order[[a, pick]] = order[[pick, a]]
            rest = order[a + 1 : b]
            d = np.sqrt(np.maximum(((lifted[rest] - lifted[order[a]]) ** 2).sum(1), 0))
            by = np.argsort(d, kind="stable")
            order[a + 1 : b], d = rest[by], d[by]
            middle = len(by) // 2
            radii[k] = [float(d[middle - 1]), float(d[middle])]
            for side, (x, y) in enumerate(((a + 1, a + 1 + middle), (a + 1 + middle, b))):
                nodes[k][2 + side] = len(nodes)
                todo.append(len(nodes))
                nodes.append([x, y, -1, -1])
                radii.append([0.0, 0.0])
        return cls(order, np.array(nodes, np.int64), np.array(radii))

    def search(self, vectors: np.ndarray, longest: float, queries: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the k vectors of largest inner product found for each query (-1: none left).

        `vectors` are the unlifted rows in the tree's own order; only products above a query's
        `bound` are of use.
        """
        n = len(queries)
        k = min(k, len(vectors))
        best = np.full((n, k), -np.inf) if bound is None else np.repeat(bound[:, None], k, axis=1)
        who = np.full((n, k), -1, np.int64)
        square = (queries**2).sum(1) + longest**2

        def offer(q: np.ndarray, a: int, b: int) -> np.ndarray:
            scores = queries[q] @ vectors[a:b].T
            # Most leaves improve few queries: only those are merged.
            better = np.flatnonzero(scores.max(1) > best[q, -1])
            if len(better):
                rows = q[better]
                joined = np.concatenate([best[rows], scores[better]], axis=1)
                names = np.concatenate([who[rows], np.broadcast_to(np.arange(a, b), (len(rows), b - a))], axis=1)
                top = np.argpartition(-joined, k - 1, axis=1)[:, :k]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(joined, top, 1), axis=1, kind="stable"), 1)
                best[rows] = np.take_along_axis(joined, top, 1)
                who[rows] = np.take_along_axis(names, top, 1)
            return scores

        def near(q: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(square[q] - 2 * best[q, -1], 0))

        def visit(node: int, q: np.ndarray) -> None:
            a, b, left, right = self.nodes[node]
            if left < 0:
                offer(q, a, b)
                return
            score = offer(q, a, a + 1)[:, 0]
            d = np.sqrt(np.maximum(square[q] - 2 * score, 0))
            inner, outer = self.radii[node]
            inside = d - inner < outer - d
            for side, first in ((left, inside), (right, ~inside)):
                if first.any():
                    visit(side, q[first])
            far = np.where(inside, outer - d, d - inner)
            reach = far <= factor * near(q)
            for side, other in ((right, inside & reach), (left, ~inside & reach)):
                if other.any():
                    visit(side, q[other])

        if len(vectors) and n:
            visit(0, np.arange(n))
        return who


class Top:
    """A complete tree of vantage points over a sample; its leaves are the shards."""

    def __init__(self, lifted: np.ndarray, depth: int, longest: float, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.depth, self.longest = depth, longest
        self.points = np.zeros(((1 << depth) - 1, lifted.shape[1]))
        self.radii = np.zeros(len(self.points))
        members = [np.arange(len(lifted))]
        for node in range(len(self.points)):
            own = members[node]
            # A part that the sample does not fill any more is split by any point.
            pool = own if len(own) else np.arange(len(lifted))
            self.points[node] = lifted[pool[rng.integers(len(pool))]]
            d = self._from(lifted[own], self.points[node])
            self.radii[node] = np.median(d) if len(d) else 0.0
            members += [own[d <= self.radii[node]], own[d > self.radii[node]]]
        shards = np.arange(1 << depth)
        #: The vantage points above each shard, from the root down.
        self.above = ((shards[:, None] + (1 << depth)) >> (depth - np.arange(depth))) - 1

    @staticmethod
    def _from(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((rows - points) ** 2).sum(-1), 0))

    def shard(self, lifted: np.ndarray) -> np.ndarray:
        node = np.zeros(len(lifted), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (self._from(lifted, self.points[node]) > self.radii[node])
        return node - len(self.points)

    def ranges(self, shard: int, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of a shard's rows to each vantage point above it."""
        d = [self._from(lifted, self.points[v]) for v in self.above[shard]]
        return np.array([x.min() for x in d]), np.array([x.max() for x in d])

    def order(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the shards from the nearest on, and the least distance that each may hold.

        The shard that a query would be dealt to comes first; an empty shard, whose `low` is infinite, last.
        """
        d = np.sqrt(np.maximum((queries**2).sum(1)[:, None] + self.longest**2 - 2 * queries @ self.points[:, :-1].T, 0))
        least = np.zeros((len(queries), len(self.above)))
        for i in range(self.depth):
            to = d[:, self.above[:, i]]
            least = np.maximum(least, np.maximum(to - high[:, i], low[:, i] - to))
        node, every = np.zeros(len(queries), np.int64), np.arange(len(queries))
        for _ in range(self.depth):
            node = 2 * node + 1 + (d[every, node] > self.radii[node])
        first = least.copy()
        home = node - len(self.points)
        here = np.isfinite(least[every, home])
        first[every[here], home[here]] = -1.0
        return np.argsort(first, axis=1, kind="stable"), least


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products row by row in double precision, summed in the order of the components."""
    total = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        total += queries[:, d] * vectors[:, d]
    return total


# ---- distributed form ----------------------------------------------------------------------


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as got:
        return {k: got[k] for k in got.files}


def _matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, at least one not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0)


def _lifted(v: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(longest**2 - (v**2).sum(1), 0))[:, None]], axis=1)


def _per_shard(visits: DataFrame, trees: DataFrame, block_rows: int) -> DataFrame:
    """`asked, tree`: blocks of the queries that visit a shard, with each tree of the shard.

    Blocks are counted by shard, so a shard that very many queries visit is dealt to many tasks,
    each with a copy of its tree.
    """

    def block(table: pa.Table) -> pa.Table:
        blob = _pack(v=_matrix(table.column("v")), ids=np.asarray(table.column("id")), bound=np.asarray(table.column("bound")))
        return pa.table({"shard": table.column("shard").slice(0, 1), "copy": table.column("copy").slice(0, 1), "asked": pa.array([blob], pa.binary())})

    # One row a shard, of which there are at most MAX_SHARDS.
    blocks = F.broadcast(visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")))
    dealt = visits.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.select("shard", "block", (F.col("block") / SHARING).cast("int").alias("copy"), "id", "v", "bound")
    asked = dealt.groupBy("shard", "block").applyInArrow(block, "shard int, copy int, asked binary")
    copies = F.explode(F.sequence(F.lit(0), ((F.col("blocks") - 1) / SHARING).cast("int")))
    wanted = trees.join(blocks, "shard").select("shard", copies.alias("copy"), "tree")
    return asked.join(wanted, ["shard", "copy"]).select("asked", "tree")


def nearest(
    table: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = NEIGHBOURS,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
    leaf: int = LEAF,
) -> DataFrame:
    """`query_id, rank, vec_id, score` of the k nearest found of each query, all rows but its own as candidates.

    `is_query` is an expression over the table.  Rows with a null id or an unusable vector take no
    part; usable vectors of different lengths have no inner product and raise an error; repeated
    rows count once; ties go to the smaller id; an empty table gives no row.  Equal vectors form
    one class that keeps its k + 1 least ids, which is all that any query can return of it, so
    copies, however many, cost one place in a tree.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # -0.0 and 0.0 are one value.
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = stored(rows.distinct(), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = rows.agg(F.max(F.sqrt(square)).alias("longest"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    longest = facts["longest"]
    if longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if facts["least"] != facts["most"]:
        raise ValueError(f"vectors of {facts['least']} to {facts['most']} components have no common inner product")
    lowest = Window.partitionBy("v").orderBy("id")
    ranked = rows.select("v", "id", F.row_number().over(lowest).alias("r")).where(F.col("r") <= k + 1)
    classes = stored(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vector-classes")
    n = classes.count()
    depth = 0
    while (1 << depth) < min(MAX_SHARDS, n / shard_rows):
        depth += 1
    n_shards, n_parts = 1 << depth, max(1, -(-n // (shard_rows << depth)))
    sample = classes.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE_ROWS * n_shards).collect()
    top = Top(_lifted(np.array([r["v"] for r in sample]), longest), depth, longest)

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(top.shard(_lifted(v, longest)), pa.int32()), batch.column(0), batch.column(1)], names=["shard", "v", "ids"])

    def grow(table: pa.Table) -> pa.Table:
        v = _matrix(table.column("v"))
        lifted = _lifted(v, longest)
        shard = table.column("shard")[0].as_py()
        low, high = top.ranges(shard, lifted)
        tree = Tree.build(lifted, leaf)
        ids = table.column("ids").to_pylist()
        ids = [ids[i] for i in tree.order]
        ends = np.cumsum([len(x) for x in ids])
        blob = _pack(v=v[tree.order], nodes=tree.nodes, radii=tree.radii, ids=np.array([i for x in ids for i in x], np.int64), ends=ends)
        doubles = pa.list_(pa.float64())
        return pa.table({"shard": pa.array([shard], pa.int32()), "tree": pa.array([blob], pa.binary()), "low": pa.array([low], doubles), "high": pa.array([high], doubles)})

    part = F.pmod(F.xxhash64("v"), F.lit(n_parts)).cast("int")
    dealt = classes.select("v", "ids").mapInArrow(deal, "shard int, v array<double>, ids array<long>").withColumn("part", part)
    trees = stored(dealt.groupBy("shard", "part").applyInArrow(grow, "shard int, tree binary, low array<double>, high array<double>"), "vector-trees")
    low, high = np.full((n_shards, depth), np.inf), np.full((n_shards, depth), -np.inf)
    # Two numbers a level of each shard, of which there are at most MAX_SHARDS.
    extremes = [f(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(depth)]
    for r in trees.groupBy("shard").agg(F.count(F.lit(1)), *extremes).collect():
        low[r["shard"]], high[r["shard"]] = np.reshape(r[2:], (2, depth)) if depth else (0, 0)

    def route(begin: int, end: int):
        """Each query with those of its shards from number `begin` to `end` that its bound does not rule out."""

        def run(batches):
            for batch in batches:
                q = _matrix(batch.column(1))
                if not len(q):
                    continue
                bound = np.asarray(batch.column(2).fill_null(-np.inf), float)
                order, least = top.order(q, low, high)
                order = order[:, begin:end]
                reach = np.sqrt(np.maximum((q**2).sum(1) + longest**2 - 2 * bound, 0))
                near = np.take_along_axis(least, order, 1) <= np.where(np.isinf(reach), np.inf, factor * reach + 1e-9)[:, None]
                near &= np.isfinite(np.take_along_axis(least, order, 1))
                row, at = np.nonzero(near)
                take = pa.array(row)
                columns = [pa.array(order[row, at], pa.int32()), batch.column(0).take(take), batch.column(1).take(take), pa.array(bound[row])]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "id", "v", "bound"])

        return run

    def search(batches):
        for batch in batches:
            for asked_blob, tree_blob in zip(batch.column(0), batch.column(1)):
                q, t = _unpack(asked_blob.as_py()), _unpack(tree_blob.as_py())
                tree = Tree(np.arange(len(t["v"])), t["nodes"], t["radii"])
                # Some more classes than asked for and a little below the bound, since products of whole blocks round differently.
                who = tree.search(t["v"], longest, q["v"], k + 5, factor, q["bound"] - 1e-9 * (1 + longest * longest))
                yield _ranked(q, t, who, k)

    asks = rows.where("asks").select("id", "v")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, begin, end = None, 0, 1
    while begin < n_shards:
        if best is None:
            asking = asks.withColumn("bound", F.lit(None).cast("double"))
        else:
            worst = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
            asking = asks.join(worst, "id", "left")
        visits = stored(asking.mapInArrow(route(begin, end), "shard int, id long, v array<double>, bound double"), "vector-visits")
        found = _per_shard(visits, trees, block_rows).mapInArrow(search, "query_id long, vec_id long, score double")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "vector-best")
        begin, end = end, 2 * end
    return best.select("query_id", "rank", "vec_id", "score")


def _ranked(q: dict, t: dict, who: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best rows of one shard for each query, from its bound on: exact scores, ties to smaller ids, its own id left out."""
    n_ids = np.diff(t["ends"], prepend=0)
    row, column = np.nonzero(who >= 0)
    cls = who[row, column]
    exact = scores(q["v"][row], t["v"][cls])
    rep = n_ids[cls]
    row, exact = np.repeat(row, rep), np.repeat(exact, rep)
    starts = np.repeat((t["ends"] - n_ids)[cls], rep)
    ids = t["ids"][starts + np.arange(len(row)) - np.repeat(np.cumsum(rep) - rep, rep)]
    keep = (ids != q["ids"][row]) & (exact >= q["bound"][row])
    row, exact, ids = row[keep], exact[keep], ids[keep]
    by = np.lexsort((ids, -exact, row))
    row, exact, ids = row[by], exact[by], ids[by]
    first = np.searchsorted(row, row, "left")
    keep = np.arange(len(row)) - first < k
    return pa.RecordBatch.from_arrays([pa.array(q["ids"][row[keep]]), pa.array(ids[keep]), pa.array(exact[keep])], names=["query_id", "vec_id", "score"])


def op2_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, F.col("vec_id") % QUERY_STEP == 0)


QUERIES = {"op2_vp_tree": op2_vp_tree}
ORACLES: dict[str, str] = {}
