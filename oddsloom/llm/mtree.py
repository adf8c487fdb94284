"""Exact top-k search by inner product: best-first over M-trees.

Vectors are dealt to trees of bounded size. The largest inner product is a nearest neighbour once every
vector gets one more component, ``sqrt(R - |v|^2)`` with R the largest squared norm of its tree (and 0 for the
query); there Euclidean distance is a metric, and the score follows from it. A tree has pages of
``page`` entries. An inner entry holds a routing vector, the covering radius of its subtree and its distance
to the routing vector of its own page; a leaf entry holds a vector and that same distance.

A search keeps pages in a queue by the best score they can hold. Before an entry's distance is computed, the
stored ones bound it: ``|d(q, parent) - d(entry, parent)|`` less the radius. Entries that cannot reach the k-th
best score so far are passed over; the search ends when the queue's head cannot. Scores are integers and
exact: vectors with a squared norm of 2^52 or more stay out of the tree and are scored one by one in Python's
integers, as is everything for such a query. A score beyond 64 bits raises an error. Bounds are widened by a part in 10^9 against rounding.

Queries meet trees in blocks: a row is a tree and a block of queries. Each gives k candidates a query, merged
by a window.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor does
a vector of another length than the query; a component whose 256-fold does not fit a bigint raises an error; null ids take no part; ties go to the smaller id; repeated ids
are kept apart from the query of that id, which never finds itself; fewer than k others give all of them; an
empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.session import materialize

TREE_ROWS = 8192
BLOCK_ROWS = 1024
PAGE = 512
#: Doubles hold inner products of vectors with smaller squared norms exactly.
EXACT = 2**52


@dataclass
class Page:
    """Entries of a node; children are pages (inner) or None (leaf: ``ids`` and ``rows``).

    Rows are whole numbers kept as doubles: products and sums below 2 to the 53 are exact, and fast.
    """

    routes: np.ndarray  # entries x (dimension + 1)
    parent: np.ndarray  # distance of each entry to the page's own routing vector
    radius: np.ndarray  # covering radius of each entry; 0 in leaves
    children: list | None
    ids: np.ndarray | None = None
    rows: np.ndarray | None = None


class MTree:
    """Bulk-loaded tree over integer vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, page: int = PAGE):
        self.page = page
        order = np.argsort(ids, kind="stable")
        ids, exact = ids[order], rows[order]
        rows = exact.astype(np.float64)
        norms = np.einsum("ij,ij->i", rows, rows)
        # What doubles do not hold exactly is kept as it came; ``whole`` has all rows, for queries of that kind.
        self.whole = (ids, exact)
        wide = norms >= EXACT
        self.wide = (ids[wide], exact[wide])
        ids, rows, norms = ids[~wide], rows[~wide], norms[~wide]
        self.root = None
        if not len(ids):
            return
        self.limit = norms.max()
        points = np.concatenate([rows, np.sqrt(self.limit - norms)[:, None]], axis=1)
        self.root = self._load(ids, rows, points, points.mean(axis=0))

    @staticmethod
    def _distance(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
        apart = points - centre
        return np.sqrt(np.einsum("ij,ij->i", apart, apart))

    def _load(self, ids, rows, points, centre) -> Page:
        if len(ids) <= self.page:
            away = self._distance(points, centre)
            return Page(points, away, np.zeros(len(ids)), None, ids, rows)
        # Routing vectors at equal steps of the id order; each point goes to the nearest.
        want = min(self.page, 2 * -(-len(ids) // self.page))
        picked = np.unique(np.linspace(0, len(ids) - 1, want).astype(int))
        flat = points[picked]
        near = ((flat**2).sum(1)[None] - 2 * points @ flat.T).argmin(1)
        parts = [p for p in np.split(np.argsort(near, kind="stable"), np.cumsum(np.bincount(near))[:-1]) if len(p)]
        if max(len(p) for p in parts) > len(ids) // 2:  # many equal points: any split does
            parts = np.array_split(np.argsort(near, kind="stable"), want)
        routes = np.stack([points[p].mean(axis=0) for p in parts])
        radius = np.array([self._distance(points[p], r).max() for p, r in zip(parts, routes)])
        children = [self._load(ids[p], rows[p], points[p], r) for p, r in zip(parts, routes)]
        return Page(routes, self._distance(routes, centre), radius, children)

    def search(self, query: np.ndarray, own_id: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best, best first; ids equal to ``own_id`` are passed over."""
        asked = query.astype(np.float64)
        if asked @ asked >= EXACT:
            return self._one_by_one(*self.whole, query, own_id, k)
        found = self._one_by_one(*self.wide, query, own_id, k)
        if self.root is not None:
            found = sorted(found + self._best_first(asked, own_id, k), key=lambda f: (-f[0], f[1]))[:k]
        return found

    @staticmethod
    def _one_by_one(ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own_id: int, k: int) -> list[tuple[int, int]]:
        """The same by Python's integers."""
        parts = query.tolist()
        scored = (
            (sum(a * b for a, b in zip(row.tolist(), parts)), vec) for vec, row in zip(ids.tolist(), rows) if vec != own_id
        )
        return heapq.nsmallest(k, scored, key=lambda f: (-f[0], f[1]))

    def _best_first(self, query: np.ndarray, own_id: int, k: int) -> list[tuple[int, int]]:
        """The same over the tree, for a query that doubles hold."""
        point = np.append(query, 0.0)
        whole = float(query @ query) + self.limit
        slack = 1e-9 * whole + 1e-6

        def best_score(distance: np.ndarray) -> np.ndarray:
            """Most that a vector at this distance, or further away, can score."""
            near = np.maximum(distance - 1e-7 * (1 + np.abs(distance)), 0.0)
            return (whole - near * near) / 2 + slack

        found: list[tuple[float, int]] = []  # heap of (score, -id)
        queue: list[tuple[float, int, float, Page]] = [(-np.inf, 0, np.nan, self.root)]
        tick = 0
        while queue:
            bound, _, to_centre, page = heapq.heappop(queue)
            full = len(found) == k
            if full and -bound < found[0][0]:
                break
            keep = None
            if full and to_centre == to_centre:
                # Stored distances alone: no distance of the page's entries is computed yet.
                reach = best_score(np.abs(to_centre - page.parent) - page.radius)
                keep = np.flatnonzero(reach >= found[0][0])
                if not len(keep):
                    continue
            if page.children is None:
                rows, ids = (page.rows, page.ids) if keep is None else (page.rows[keep], page.ids[keep])
                scores = rows @ query
                good = ids != own_id
                if full:
                    good &= scores >= found[0][0]
                at = np.flatnonzero(good)
                if len(at) > k:
                    at = at[np.lexsort((ids[at], -scores[at]))[:k]]
                for score, vec in zip(scores[at].tolist(), ids[at].tolist()):
                    if len(found) < k:
                        heapq.heappush(found, (score, -vec))
                    elif (score, -vec) > found[0]:
                        heapq.heapreplace(found, (score, -vec))
            else:
                keep = np.arange(len(page.children)) if keep is None else keep
                away = self._distance(page.routes[keep], point)
                reach = best_score(away - page.radius[keep])
                least = found[0][0] if full else -np.inf
                for i, distance, score in zip(keep.tolist(), away.tolist(), reach.tolist()):
                    if score >= least:
                        tick += 1
                        heapq.heappush(queue, (-score, tick, distance, page.children[i]))
        return [(int(score), -vec) for score, vec in sorted(found, reverse=True)]


def quantized(embedding: Column) -> Column:
    """floor(256 * x) of each component; null for a vector that takes no part.

    A finite component whose result does not fit a bigint raises an error.
    """

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * 256
        fits = (scaled >= F.lit(-(2.0**63))) & (scaled < F.lit(2.0**63))
        return F.when(fits, F.floor(scaled)).otherwise(F.raise_error(F.lit("a component does not fit a bigint")))

    # A double that is not finite fails the comparison (NaN is the largest) or is null.
    good = (F.size(embedding) > 0) & F.forall(
        embedding,
        lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)),
    )
    return F.when(F.coalesce(good, F.lit(False)), F.transform(embedding, whole))


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "vector",
    tree_rows: int = TREE_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the largest inner product with each query.

    ``vector`` is an array of bigint in both frames.
    """
    usable = lambda df: df.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), F.size(vector).alias("dim")
    )
    points, asked = usable(vectors), usable(queries)
    trees = max(1, -(-points.count() // tree_rows))
    blocks = max(1, -(-asked.count() // block_rows))

    def packed(df: DataFrame, parts: int) -> DataFrame:
        """(dim, part, ids, rows): bounded parts as two blocks of bytes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], tuple[list, list]] = {}
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                part, dim = batch.column(0).to_numpy(), batch.column(3).to_numpy()
                for key in sorted(set(zip(dim.tolist(), part.tolist()))):
                    mine = batch.filter(pa.array((dim == key[0]) & (part == key[1])))
                    ids, rows = held.setdefault(key, ([], []))
                    ids.append(mine.column(1).to_numpy())
                    rows.append(mine.column(2).flatten().to_numpy())
            for (dim, part), (ids, rows) in sorted(held.items()):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([dim], pa.int32()),
                        pa.array([part], pa.int32()),
                        pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()),
                        pa.array([np.concatenate(rows).astype("<i8").tobytes()], pa.binary()),
                    ],
                    ["dim", "part", "ids", "rows"],
                )

        # By id, so that equal vectors spread over the parts.
        dealt = df.withColumns({"part": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")})
        return (
            dealt.select("part", "id", "v", "dim")
            .repartition(parts, "part")
            .mapInArrow(run, "dim int, part int, ids binary, rows binary")
        )

    # Trees and blocks are written, so that each is packed once for all its partners.
    forest = materialize(packed(points, trees), "forest").withColumnRenamed("part", "tree")
    query_blocks = materialize(packed(asked, blocks), "query-blocks").select(
        "dim", F.col("part").alias("block"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, ids, rows, q_ids, q_rows = (batch.column(c)[row].as_py() for c in range(5))
                read = lambda data: np.frombuffer(data, "<i8")
                tree = MTree(read(ids), read(rows).reshape(-1, dim))
                out: list[list] = [[], [], []]
                for own, query in zip(read(q_ids).tolist(), read(q_rows).reshape(-1, dim)):
                    for score, vec in tree.search(query, own, k):
                        out[0].append(own)
                        out[1].append(vec)
                        out[2].append(score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"]
                )

    # Each tree goes to each block of queries: the stated queries against all rows.
    met = forest.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))}).join(
        query_blocks, ["dim", "block"]
    )
    met = met.select("dim", "ids", "rows", "q_ids", "q_rows").repartition(max(1, min(trees * blocks, 10_000)))
    hits = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumns({"rank": F.row_number().over(order)})
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


QUERY_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
