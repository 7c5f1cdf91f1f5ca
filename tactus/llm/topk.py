"""Exact top-k inner products by a Voronoi kNN join.

Inner products become distances: with M the largest norm, a vector v gets the coordinate sqrt(M^2 - |v|^2) and a query
the coordinate 0; then |q - v|^2 = |q|^2 + M^2 - 2 q.v, so a query's nearest vectors are those of highest score.

Pivots, a sample of vectors that grows with the square root of their number up to MOST_PIVOTS, cut the space into cells.
Summaries: a cell of queries keeps its count and the largest distance U from its pivot; a cell of data keeps its smallest
distances from its pivot, as many as a query needs.  From these alone theta, an upper bound of the distance of the last
vector that any query of the cell needs, follows from U + |pivot, pivot'| + distance.  A vector is needed by a cell only
if its distance from the cell's pivot is at most theta + U.

Replication: neighbouring cells of queries form groups of at most BLOCK components (a larger cell is split into several),
and a vector goes once to each group that has a cell which needs it.  So a vector is stored as often as the queries are
many blocks, at most, even where bounds prune nothing; within a group vectors are dealt by hash over chunks of at most
CHUNK components, and each pair of a group's queries and a chunk is solved locally by one matrix product.  Vectors travel
as 16-bit integers where they fit.  `Join.placed()` and `Join.replicated()` show what is replicated.

Defined cases: vectors that are null, empty, or hold components that are null or not finite (64 * x included) take no
part; null ids take no part; rows of one vec_id with the same vector count once; rows of the query's own vec_id are not
its candidates; only vectors of the same number of components are compared; ties go to the smaller vec_id; with fewer
than k candidates, all of them; scores beyond a long are clipped to it and so are ties; extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.llm.common import written

K, SCALE, EVERY = 20, 64, 20
MOST_PIVOTS = 512
#: Components of the queries of a group and of the vectors of a chunk, which bound what a task holds; a small table has smaller ones, for parallelism.
BLOCK, CHUNK, LEAST = 1 << 22, 1 << 23, 1 << 18
#: Scores that a task holds at once.
SCORES = 1 << 22
#: Rows of one vec_id up to which bounds allow for them; beyond, bounds are left out.
MOST_OWN = 1_000
#: Relative slack of the bounds for rounding; it only lets more vectors through.
SLACK = 1e-6


def _vectors(df: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v, dim): scaled integer vectors of the rows that take part, distinct."""
    v = F.transform("embedding", lambda x: _floor(x.cast("double") * scale))
    ok = F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(ok).distinct().withColumn("dim", F.size("v"))


def _floor(x: Column) -> Column:
    """floor() of a double as a double, as floor() itself gives a long."""
    whole = F.rint(x)
    return F.when(whole > x, whole - 1.0).otherwise(whole)


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (m * m).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (m @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


@dataclass
class Space:
    """Of the vectors of one number of components: how they are stored, and their pivots."""

    kind: str  # numpy's name of the stored components
    unit: float  # distances are of vectors times this power of two, so that squares stay finite
    top: float  # largest squared norm, in that unit
    clips: bool  # scores may go beyond a long, where they are equal; bounds of distances don't hold for those
    pivots: np.ndarray

    def matrix(self, cells: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(cells), dtype=self.kind).reshape(len(cells), -1).astype(np.float64)

    def lift(self, m: np.ndarray) -> np.ndarray:
        """Vectors with their extra coordinate."""
        m = m * self.unit
        return np.hstack([m, np.sqrt(np.maximum(self.top - (m * m).sum(axis=1), 0.0))[:, None]])

    def data_distances(self, m: np.ndarray) -> np.ndarray:
        return _distances(self.lift(m), self.pivots)

    def query_distances(self, m: np.ndarray) -> np.ndarray:
        return _distances(np.hstack([m * self.unit, np.zeros((len(m), 1))]), self.pivots)


@dataclass
class Groups:
    """Of one number of components: which groups each cell of queries is dealt over, and how far its bound reaches."""

    first: np.ndarray  # cell -> its first group
    blocks: np.ndarray  # cell -> number of its groups, 0 without queries
    reach: np.ndarray  # cell -> theta + U, -inf without queries
    count: int
    chunks: int

    def member(self) -> np.ndarray:
        """(cells, groups)."""
        at = np.arange(self.count)[None, :]
        return (at >= self.first[:, None]) & (at < (self.first + self.blocks)[:, None])


class Join:
    def __init__(self, embeddings: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, block: int = BLOCK, chunk: int = CHUNK, least: int = LEAST):
        self.spark, self.k = embeddings.sparkSession, k
        self.block, self.chunk, self.least = block, chunk, least
        data = written(_vectors(embeddings, scale), "vectors")
        self.spaces = self._spaces(data)
        known = self.spark.sparkContext.broadcast(self.spaces)  # MOST_PIVOTS a number of components

        def assign(batches):
            """Cell and distance of each vector as data, and as a query."""
            for b in batches:
                for dim, part in b.groupby("dim"):
                    space = known.value[dim]
                    m = np.stack(part["v"].to_numpy()).astype(np.float64)
                    near, asked = space.data_distances(m), space.query_distances(m)
                    stored = [x.tobytes() for x in m.astype(space.kind)]
                    yield pd.DataFrame({"vec_id": part["vec_id"], "v": stored, "dim": dim, "query": part["query"], "cell": near.argmin(axis=1), "dist": near.min(axis=1), "asked": asked.argmin(axis=1), "q_dist": asked.min(axis=1)})

        placed = data.withColumn("query", F.coalesce(is_query, F.lit(False))).mapInPandas(assign, "vec_id long, v binary, dim int, query boolean, cell int, dist double, asked int, q_dist double")
        self._placed = written(placed, "voronoi")
        self.groups = self._groups()

    def placed(self) -> DataFrame:
        """(vec_id, v, dim, query, cell, dist, asked, q_dist) of every vector that takes part."""
        return self._placed

    def _spaces(self, data: DataFrame) -> dict[int, Space]:
        most = F.array_max(F.transform("v", F.abs))
        sizes = {r["dim"]: (r["n"], r["most"]) for r in data.groupBy("dim").agg(F.count("*").alias("n"), F.max(most).alias("most")).collect()}
        if not sizes:
            return {}
        unit = {d: 2.0 ** -max(0, int(np.ceil(np.log2(max(1.0, m))))) for d, (_, m) in sizes.items()}
        pivots = {d: int(min(MOST_PIVOTS, max(16, n**0.5))) for d, (n, _) in sizes.items()}
        by_dim = lambda x: F.coalesce(*[F.when(F.col("dim") == d, F.lit(y)) for d, y in x.items()])
        h = F.xxhash64("vec_id")
        norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * by_dim(unit) * x * by_dim(unit))
        picked = data.groupBy("dim", F.pmod(h, by_dim(pivots)).alias("class")).agg(F.min_by("v", F.struct(h, "vec_id", "v")).alias("v"), F.max(norm).alias("top"))
        found: dict[int, list] = {}
        for r in picked.collect():
            found.setdefault(r["dim"], []).append((r["class"], r["v"], r["top"]))
        out = {}
        for d, rows in found.items():
            kind = "<i2" if sizes[d][1] < 2**15 else "<f8"
            space = out[d] = Space(kind, unit[d], max(t for *_, t in rows), 2 * np.log2(max(1.0, sizes[d][1])) + np.log2(d) >= 62, np.zeros((0, d + 1)))
            space.pivots = space.lift(np.array([v for _, v, _ in sorted(rows)]))
        return out

    def _groups(self) -> dict[int, Groups]:
        placed, k = self._placed, self.k
        if not self.spaces:
            return {}
        own = placed.groupBy("vec_id").count().agg(F.max("count")).first()[0]
        need = k + own  # a query's own rows may be among the nearest

        def smallest(batches):
            """Each task's smallest distances of each cell."""
            best: dict[tuple, np.ndarray] = {}
            for b in batches:
                for key, part in b.groupby(["dim", "cell"]):
                    best[key] = np.sort(np.concatenate([best.get(key, np.zeros(0)), part["dist"].to_numpy()]))[:need]
            for (dim, cell), d in best.items():
                yield pd.DataFrame({"dim": dim, "cell": cell, "dist": d})

        cells: dict[int, list] = {}
        if own <= MOST_OWN:
            near = placed.select("dim", "cell", "dist").mapInPandas(smallest, "dim int, cell int, dist double")
            near = near.withColumn("n", F.row_number().over(Window.partitionBy("dim", "cell").orderBy("dist"))).where(F.col("n") <= need).drop("n")
            for r in near.collect():  # (k + MOST_OWN) * MOST_PIVOTS at most
                cells.setdefault(r["dim"], []).append((r["cell"], r["dist"]))
        asked = placed.where("query").groupBy("dim", "asked").agg(F.max("q_dist").alias("u"), F.count("*").alias("n")).collect()
        sizes = {r["dim"]: r["n"] for r in placed.groupBy("dim").agg(F.count("*").alias("n")).collect()}
        tasks = 2 * self.spark.sparkContext.defaultParallelism
        out = {}
        for dim, space in self.spaces.items():
            p = space.pivots
            u, n = np.full(len(p), -np.inf), np.zeros(len(p), dtype=np.int64)
            for r in asked:
                if r["dim"] == dim:
                    u[r["asked"]], n[r["asked"]] = r["u"], r["n"]
            at, dist = (np.array(x) for x in zip(*cells[dim], strict=True)) if dim in cells else (np.zeros(0, int), np.zeros(0))
            apart = _distances(p, p)
            reach = np.full(len(p), -np.inf)
            for c in np.flatnonzero(n):
                bounds = apart[c, at] + dist
                # with fewer rows, all are needed
                reach[c] = (np.partition(bounds, need - 1)[need - 1] + 2 * u[c]) * (1 + SLACK) + SLACK if len(bounds) >= need and not space.clips else np.inf
            whole = sizes[dim] * dim
            chunk = min(self.chunk, max(self.least, whole // tasks))
            block = min(self.block, max(self.least, int(n.sum()) * dim))
            first, blocks, count, held = np.zeros(len(p), dtype=np.int64), np.zeros(len(p), dtype=np.int64), 0, 0
            c = int(n.argmax())
            left = set(np.flatnonzero(n).tolist())
            while left:  # from a cell to the nearest that is left
                c = min(left, key=lambda x: (apart[c, x], x))
                left.remove(c)
                size = int(n[c]) * dim
                if held and held + size > block:
                    count, held = count + 1, 0
                first[c], blocks[c] = count, -(-size // block)
                count, held = count + blocks[c] - 1, held + size if blocks[c] == 1 else block
            out[dim] = Groups(first, blocks, reach, int(count + 1 if held else count), -(-whole // chunk))
        return out

    def replicated(self) -> DataFrame:
        """(dim, group, chunk, vec_id, v): each vector once for each group that needs it."""
        known = self.spark.sparkContext.broadcast((self.spaces, self.groups))

        def replicate(batches):
            spaces, groups = known.value
            for b in batches:
                for dim, part in b.groupby("dim"):
                    space, g = spaces[dim], groups[dim]
                    needed = space.data_distances(space.matrix(part["v"])) <= g.reach[None, :]
                    row, group = np.nonzero(needed.astype(np.int32) @ g.member().astype(np.int32))
                    got = part.iloc[row]
                    yield pd.DataFrame({"dim": dim, "group": group, "chunk": got["chunk"].to_numpy(), "vec_id": got["vec_id"].to_numpy(), "v": got["v"].to_numpy()})

        chunks = F.create_map(*[F.lit(x) for d, g in self.groups.items() for x in (d, g.chunks)])[F.col("dim")]
        salted = self._placed.select("dim", "vec_id", "v", F.pmod(F.xxhash64(F.lit(1), F.col("vec_id")), chunks).cast("int").alias("chunk"))
        return salted.mapInPandas(replicate, "dim int, group int, chunk int, vec_id long, v binary")

    def asked(self) -> DataFrame:
        """(dim, group, chunk, vec_id, v): each query in its group, once for each chunk."""
        known = self.spark.sparkContext.broadcast(self.groups)

        def group(batches):
            for b in batches:
                for dim, part in b.groupby("dim"):
                    g, cell = known.value[dim], part["asked"].to_numpy()
                    at = g.first[cell] + part["salt"].to_numpy() % g.blocks[cell]
                    yield pd.DataFrame({"dim": dim, "group": at, "chunks": g.chunks, "vec_id": part["vec_id"], "v": part["v"]})

        salt = F.pmod(F.xxhash64(F.lit(2), F.col("vec_id")), F.lit(1 << 31)).alias("salt")
        grouped = self._placed.where("query").select("dim", "asked", salt, "vec_id", "v").mapInPandas(group, "dim int, group int, chunks int, vec_id long, v binary")
        return grouped.select("dim", "group", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "vec_id", "v")

    def solved(self) -> DataFrame:
        """(query_id, rank, vec_id, score)."""
        k = self.k
        kinds = {d: s.kind for d, s in self.spaces.items()}

        def solve(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
            found = [np.zeros((3, 0), dtype=np.int64)]
            if len(queries) and len(vectors):
                kind = kinds[queries["dim"].iloc[0]]
                vectors = vectors.sort_values("vec_id", kind="stable")
                ids, q_ids = vectors["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
                m, q = (np.frombuffer(b"".join(x["v"]), dtype=kind).reshape(len(x), -1) for x in (vectors, queries))
                step = max(1, SCORES // len(ids))
                for i in range(0, len(q), step):
                    found.append(best(q[i : i + step], q_ids[i : i + step], m, ids, k))
            query_id, vec_id, score = np.concatenate(found, axis=1)
            return pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score})

        keys = ("dim", "group", "chunk")
        found = self.asked().groupBy(*keys).cogroup(self.replicated().groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
        # rows of one vec_id with different vectors may score twice; each row is a candidate
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(q: np.ndarray, q_ids: np.ndarray, m: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Query ids, vector ids and scores of the k highest scores of each query; ids ascend, and ties go to the first."""
    norm = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max())
    largest = norm(q) * norm(m)
    if largest < 2**53:  # every partial sum is a whole number below that, so products are exact
        real = np.float32 if largest < 2**24 else np.float64
        scores = (q.astype(real) @ m.astype(real).T).astype(real)
        none = -np.inf
    else:
        whole = np.array([[int(x) for x in r] for r in q], dtype=object) @ np.array([[int(x) for x in r] for r in m], dtype=object).T
        scores, none = np.vectorize(lambda x: min(max(x, -(2**63)), 2**63 - 1), otypes=[object])(whole), -(2**64)
    lo, hi = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
    for r in np.flatnonzero(hi > lo):
        scores[r, lo[r] : hi[r]] = none
    if len(ids) > k:
        least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
        above, same = scores > least, scores == least
        room = k - above.sum(axis=1)
        taken = above | same & (np.cumsum(same, axis=1, dtype=np.int32) <= room[:, None])
    else:
        taken = np.ones(scores.shape, dtype=bool)
    row, col = np.nonzero(taken & (scores != none))
    got = scores[row, col]
    return np.array([q_ids[row], ids[col], got.astype(np.int64)], dtype=np.int64)


def top_k(embeddings: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where is_query holds, against all rows."""
    join = Join(embeddings, is_query, k, scale)
    if not join.groups:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return join.solved()


def op3(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, F.col("vec_id") % EVERY == 0)


SQL = """
WITH v AS (SELECT DISTINCT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
