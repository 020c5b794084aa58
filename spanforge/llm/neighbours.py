"""Approximate nearest neighbours by inner product (operator 5): a vantage-point tree per shard.

Largest inner product becomes nearest in Euclidean distance by one more coordinate, sqrt(m^2 -
|x|^2) for a vector and 0 for a query, with m the largest norm. Vectors are dealt to shards of a
bounded size by a hash of their row. A task gets a shard's vectors first, builds its tree once, and
then all queries stream past it in batches: each batch goes down the tree together, first to each
query's nearest leaf, then to all parts that the triangle inequality, relaxed by ``factor``, can't
rule out. Factor 1 is exact; a smaller one prunes more. A query whose last places are tied among more
vectors than the search remembers is compared with all vectors of the shard, so that the least ids
come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import key_slices, materialize

K, FACTOR = 20, 0.2
#: Vectors of a shard; queries that pass one tree in one task; vectors of a leaf.
SHARD_ROWS, PASS_QUERIES, LEAF = 16_384, 1 << 20, 96


class VantageTree:
    """A tree over the rows of ``x``; ``extra`` is each row's additional coordinate, ``reach`` the largest norm."""

    def __init__(self, x: np.ndarray, reach: float, seed: int = 5):
        self.x, self.reach2 = x, reach * reach
        self.extra = np.sqrt(np.maximum(0, self.reach2 - (x * x).sum(axis=1)))
        self.random = np.random.default_rng(seed)
        self.nodes: list[tuple] = []  # (rows,) for a leaf, else (vantage row, radius, bounds, inner, outer)
        self._build()

    def _build(self) -> None:
        """Halve rows by rank of their distance to a random one, so that ties, even of all, are cut too; node 0 is the root."""
        self.nodes.append((np.arange(len(self.x)),))
        todo = [0]
        while todo:
            at = todo.pop()
            rows = self.nodes[at][0]
            if len(rows) <= LEAF:
                continue
            p = int(rows[self.random.integers(len(rows))])
            gap = self.extra[rows] - self.extra[p]
            d = np.sqrt(((self.x[rows] - self.x[p]) ** 2).sum(axis=1) + gap * gap)
            half = len(rows) // 2
            by = np.argpartition(d, half - 1)
            near, far = by[:half], by[half:]
            inner, outer = len(self.nodes), len(self.nodes) + 1
            self.nodes += [(rows[near],), (rows[far],)]
            self.nodes[at] = (p, float(d[near].max()), (d[near].min(), d[near].max(), d[far].min(), d[far].max()), inner, outer)
            todo += [inner, outer]

    def search(self, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the ``k`` or so largest inner products found for each of ``q``, -1 where there are fewer; the products; and how many were computed for each."""
        score = np.full((len(q), k), -np.inf)
        found = np.full((len(q), k), -1, np.int64)
        work = np.zeros(len(q), np.int64)
        base = (q * q).sum(axis=1) + self.reach2
        home = np.full(len(q), -1)

        def leaf(at: int, who: np.ndarray) -> None:
            rows = self.nodes[at][0]
            new = q[who] @ self.x[rows].T
            work[who] += len(rows)
            both = np.concatenate([score[who], new], axis=1)
            ids = np.concatenate([found[who], np.broadcast_to(rows, new.shape)], axis=1)
            best = np.argpartition(-both, k - 1, axis=1)[:, :k]
            score[who] = np.take_along_axis(both, best, axis=1)
            found[who] = np.take_along_axis(ids, best, axis=1)

        def distance(p: int, who: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0, base[who] - 2 * (q[who] @ self.x[p])))

        def down(at: int, who: np.ndarray) -> None:
            if not len(who):
                return
            if len(self.nodes[at]) == 1:
                home[who] = at
                return leaf(at, who)
            p, radius, _, inner, outer = self.nodes[at]
            near = distance(p, who) <= radius
            down(inner, who[near])
            down(outer, who[~near])

        def visit(at: int, who: np.ndarray, want: int) -> None:
            if not len(who):
                return
            if len(self.nodes[at]) == 1:
                rest = who[home[who] != at]
                return leaf(at, rest) if len(rest) else None
            p, _, (a, b, c, d), inner, outer = self.nodes[at]
            far = distance(p, who)
            for child, lo, hi in ((inner, a, b), (outer, c, d)):
                kth = -np.partition(-score[who], want - 1, axis=1)[:, want - 1]
                with np.errstate(invalid="ignore"):
                    reach = factor * np.where(np.isfinite(kth), np.sqrt(np.maximum(0, base[who] - 2 * np.where(np.isfinite(kth), kth, 0))), np.inf)
                slack = 1e-9 * (1 + far)
                may = (far >= lo - reach - slack) & (far <= hi + reach + slack)
                visit(child, who[may], want)

        down(0, np.arange(len(q)))
        visit(0, np.arange(len(q)), max(1, k // 2))
        return found, score, work


class Shard:
    """Vectors ``x`` with ``rows`` and ``ids`` (``no_id``: none, which comes last), and a tree over the distinct ones. Of equal vectors only the k + 1 least ids can count for a query, and all of those do."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, no_id: np.ndarray, x: np.ndarray, reach: float):
        order = np.lexsort((rows, ids, no_id))
        self.rows, self.ids, self.no_id, x = rows[order], ids[order], no_id[order], np.ascontiguousarray(x[order])
        _, first, inverse = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.by = np.argsort(inverse, kind="stable")
        self.offsets = np.searchsorted(inverse[self.by], np.arange(len(first) + 1))
        self.distinct, self.least, self.reach = x[first], first, reach  # least: by it vectors are in order of their least ids
        # squares and products of finite components may not be finite: then all are computed
        self.tree = VantageTree(self.distinct, reach) if np.isfinite(4 * reach * reach) else None

    def candidates(self, q: np.ndarray, k: int, factor: float) -> np.ndarray:
        """Distinct vectors for each of ``q``, -1 for none, the k + 1 best with the least ids among them."""
        want = min(2 * k + 2, len(self.distinct))
        if self.tree is None:
            found, open_ = np.full((len(q), want), -1, np.int64), np.arange(len(q))
        else:
            found, score, _ = self.tree.search(q, want, factor)
            best = -np.sort(-score, axis=1)
            slack = 1e-12 * (np.sqrt((q * q).sum(axis=1)) * self.reach)
            open_ = np.flatnonzero(best[:, -1] >= best[:, min(k, want - 1)] - slack) if want < len(self.distinct) else np.zeros(0, np.int64)
        for i in open_:
            with np.errstate(over="ignore", invalid="ignore"):
                own = (q[i] * self.distinct).sum(axis=1)
            found[i] = np.lexsort((self.least, -own))[:want]
        return found

    def search(self, query_rows: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float) -> pa.RecordBatch:
        """Each query's ``k`` best here, but itself: query_row, query_id, row, vec_id, score."""
        found = self.candidates(q, k, factor)
        row, place = np.nonzero(found >= 0)
        which = found[row, place]
        copies = np.minimum(np.diff(self.offsets), k + 1)[which]
        at = np.repeat(self.offsets[:-1][which], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        with np.errstate(over="ignore", invalid="ignore"):
            score = (q[row] * self.distinct[which]).sum(axis=1)  # in the same way for equal vectors, wherever they lie
        which, at = np.repeat(row, copies), self.by[at]
        out = pd.DataFrame({"query_row": query_rows[which], "query_id": query_ids[which], "row": self.rows[at], "vec_id": self.ids[at], "no_id": self.no_id[at], "score": np.repeat(score, copies)})
        out = out[out.query_row != out.row].sort_values(["query_row", "score", "no_id", "vec_id", "row"], ascending=[True, False, True, True, True])
        out = out[out.groupby("query_row").cumcount() < k]
        columns = [pa.array(out[c].to_numpy(), mask=out.no_id.to_numpy() if c == "vec_id" else None) for c in FOUND]
        return pa.RecordBatch.from_arrays(columns, FOUND)


FOUND = ["query_row", "query_id", "row", "vec_id", "score"]


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, embedding, dim) of the vectors that take part, as doubles; row numbers them in no order."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return rows.filter("embedding is not null").filter(sound).select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", F.size("embedding").alias("dim"))


def nearest(vectors: DataFrame, *, every: int = 20, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, pass_queries: int = PASS_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose vec_id is divisible by ``every``, the ``k`` nearest found of all other rows.

    Nearest first, ties to the smaller vec_id, null last; scores are inner products of the original
    vectors in double precision; where components are so large that a product isn't finite, infinity
    comes before all numbers, what is no number last. Vectors that are null, empty, zero or hold null or non-finite
    components take no part. Rows that repeat a vec_id are candidates of their own, for each other
    too, and each asks its own query under the same query_id; a row without a vec_id is a candidate
    but no query. Vectors meet those with the same number of components only. Other columns are
    ignored; an empty table gives no rows. Vectors are shuffled once for each ``pass_queries``
    queries, queries once for each shard.
    """
    rows = materialize(usable(vectors), "vectors")
    # a row for each number of components: the shape of the work, not the data
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v))
    shape = rows.groupBy("dim").agg(F.count("*").alias("total"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("queries"), F.max(norm).alias("reach")).collect()
    shards, passes = max([1, *(-(-r.total // shard_rows) for r in shape)]), max([1, *(-(-r.queries // pass_queries) for r in shape)])
    reach = {r.dim: float(r.reach) for r in shape}
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("row")), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    points = rows.select("dim", dealt(shards, 1).alias("shard"), every_one(passes).alias("pass"), F.lit(0).alias("asks"), "row", "vec_id", "embedding")
    asked = rows.filter(F.col("vec_id") % every == 0).select("dim", every_one(shards).alias("shard"), dealt(passes, 2).alias("pass"), F.lit(1).alias("asks"), "row", "vec_id", "embedding")
    cells = len(shape) * shards * passes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, now = [], None, None
        for (dim, at, turn, asks), part in key_slices(batches, ["dim", "shard", "pass", "asks"]):
            if now != (dim, at, turn):
                held, shard, now = [], None, (dim, at, turn)
            x = part.column("embedding").flatten().to_numpy().reshape(part.num_rows, dim)
            numbers, ids = part.column("row").to_numpy(), part.column("vec_id").fill_null(0).to_numpy()
            if not asks:
                held.append((numbers, ids, part.column("vec_id").is_null().to_numpy(zero_copy_only=False), x))
                continue
            if shard is None:
                if not held:
                    continue
                shard, held = Shard(*[np.concatenate(c) for c in zip(*held, strict=True)], reach[dim]), []
            yield shard.search(numbers, ids, x, k, factor)

    both = points.unionByName(asked).repartition(max(1, 4 * cells), "dim", "shard", "pass").sortWithinPartitions("dim", "shard", "pass", "asks")
    found = both.mapInArrow(run, "query_row long, query_id long, row long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.isnan("score"), F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
