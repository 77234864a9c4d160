"""Nearest neighbours by inner product on robust-pruned directed graphs, one a shard.

Shards hold vectors of nearly one norm. Within a shard a component is added that
makes all norms equal, which turns the order of inner products into that of
distances; with norms so close it is small and does not drown the differences.
Bands of norms also bound what they can give: |query| times the band's largest
norm. Every query searches the bands of largest norm first, then those whose bound
reaches its k-th score. Shards that are too small for a graph, or whose graph fails
a check of its recall, are scanned exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermagrid.session import cut_lineage

#: Vectors in a shard and queries in a block: both bound the memory of a task.
SHARD_ROWS, BLOCK_ROWS = 6000, 2048
#: Bands of norms for each doubling; vectors that the first search of a query meets at least.
BANDS_OF_OCTAVE, FIRST_ROWS = 8, 1024
#: Shards below this size have no graph; sample and least recall of the check of one that has.
GRAPH_ROWS, CHECKED, LEAST_RECALL = 256, 48, 0.97
#: Graph: most edges of a vector, width of the build search and of the query search, relaxation.
DEGREE, BUILD_WIDTH, QUERY_WIDTH, RELAX = 32, 64, 96, 1.2


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search for all ``queries`` at once: (ids, squared distances), ``width``
    each, nearest first; id -1 where fewer were reached. Edges are padded with -1.

    Each round every query opens its nearest unopened vector and keeps the best
    ``width`` of what it has seen; it ends when all that it keeps are opened.
    """
    n, count = len(points), len(queries)
    norms = (points ** 2).sum(axis=1)
    ids = np.full((count, width), -1)
    far = np.full((count, width), np.inf)
    opened = np.ones((count, width), bool)
    ids[:, 0] = entry
    far[:, 0] = ((queries - points[entry]) ** 2).sum(axis=1)
    opened[:, 0] = False
    seen = np.zeros((count, n), bool)
    seen[:, entry] = True
    active = np.arange(count)
    while len(active):
        waiting = np.where(opened[active], np.inf, far[active])
        pick = waiting.argmin(axis=1)
        alive = np.isfinite(waiting[np.arange(len(active)), pick])
        active, pick = active[alive], pick[alive]
        if not len(active):
            break
        opened[active, pick] = True
        near = edges[ids[active, pick]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        rows, cols = np.nonzero(fresh)
        found = near[rows, cols]
        seen[active[rows], found] = True
        dist = np.full(near.shape, np.inf)
        dist[rows, cols] = norms[found] - 2 * np.einsum("ij,ij->i", points[found], queries[active[rows]]) + (queries[active[rows]] ** 2).sum(axis=1)
        all_far = np.concatenate((far[active], dist), axis=1)
        order = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        far[active] = np.take_along_axis(all_far, order, axis=1)
        ids[active] = np.take_along_axis(np.concatenate((ids[active], near), axis=1), order, axis=1)
        opened[active] = np.take_along_axis(np.concatenate((opened[active], ~fresh), axis=1), order, axis=1) | ~np.isfinite(far[active])
    order = np.argsort(far, axis=1, kind="stable")
    far = np.take_along_axis(far, order, axis=1)
    return np.where(np.isfinite(far), np.take_along_axis(ids, order, axis=1), -1), far


def robust_prune(points: np.ndarray, centres: np.ndarray, pool: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For every centre, at most ``degree`` diverse ids of its ``pool`` row (-1 is none).

    The nearest remaining candidate is kept; others go when ``relax`` times their
    distance to it is no more than their distance to the centre.
    """
    pool = np.where(pool == centres[:, None], -1, pool)
    pool = np.sort(pool, axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    own = points[centres]
    dist = ((points[pool] - own[:, None, :]) ** 2).sum(axis=2)
    dist[pool < 0] = np.inf
    out = np.full((len(centres), degree), -1)
    row = np.arange(len(centres))
    for k in range(degree):
        best = dist.argmin(axis=1)
        good = np.isfinite(dist[row, best])
        if not good.any():
            break
        out[good, k] = pool[row, best][good]
        chosen = points[pool[row, best]]
        between = ((points[pool] - chosen[:, None, :]) ** 2).sum(axis=2)
        dist[(relax * relax) * between <= dist] = np.inf
        dist[row, best] = np.inf
    return out


def build_graph(points: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """(edges, entry): vectors join in growing batches; each searches the graph so far,
    keeps pruned edges and offers itself to its new neighbours."""
    n = len(points)
    edges = np.full((n, DEGREE), -1)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate(([entry], order[order != entry]))
    done = 1
    while done < n:
        batch = order[done:done + max(1, min(done, 512))]
        pool, _ = beam_search(points, edges, entry, points[batch], min(BUILD_WIDTH, max(2, done)))
        if len(batch) > 1:  # those that join together may be each other's neighbours
            gram = points[batch] @ points[batch].T
            norm = np.diag(gram)
            near = np.argpartition(norm[None, :] - 2 * gram, min(16, len(batch) - 1), axis=1)[:, :17]
            pool = np.concatenate((pool, batch[near]), axis=1)
        edges[batch] = robust_prune(points, batch, pool, DEGREE, RELAX)
        rows, cols = np.nonzero(edges[batch] >= 0)
        target, source = edges[batch][rows, cols], batch[rows]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        size = np.diff(np.append(first, len(target)))
        rank = np.arange(len(target)) - np.repeat(first, size)
        offered = np.full((len(first), int(size.max(initial=0))), -1)
        offered[np.repeat(np.arange(len(first)), size), rank] = source
        centres = target[first]
        whole = np.concatenate((edges[centres], offered), axis=1)
        full = (whole >= 0).sum(axis=1) > DEGREE
        for some in np.array_split(np.flatnonzero(full), max(1, full.sum() // 256 + 1)):
            if len(some):
                edges[centres[some]] = robust_prune(points, centres[some], whole[some], DEGREE, RELAX)
        rest = np.flatnonzero(~full)
        few = np.sort(whole[rest], axis=1)
        few[:, 1:][few[:, 1:] == few[:, :-1]] = -1  # an edge that was offered again
        edges[centres[rest]] = -np.sort(-few, axis=1)[:, :DEGREE]
        done += len(batch)
    return edges, entry


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) without vectors that are null, empty, zero or hold null or
    non-finite components; equal rows once."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return (vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite)
            .where(F.exists("embedding", lambda x: x != 0))
            .select(F.col("vec_id").cast("long"), v.alias("v")).distinct())


def _unpack(blob: bytes, kind, shape) -> np.ndarray:
    return np.frombuffer(blob, kind).reshape(shape)


def levelled(v: np.ndarray) -> np.ndarray:
    """Vectors over their largest norm, with the component that makes all norms 1, as 4-byte numbers."""
    top = np.sqrt((v ** 2).sum(axis=1).max())
    v = v / top
    return np.column_stack((v, np.sqrt(np.maximum(1.0 - (v ** 2).sum(axis=1), 0.0)))).astype(np.float32)


def flattened(query: np.ndarray) -> np.ndarray:
    """Queries of norm 1 with an empty last component: length does not change the order of a query's candidates."""
    norms = np.sqrt((query ** 2).sum(axis=1))
    return np.column_stack((query / norms[:, None], np.zeros(len(query)))).astype(np.float32)


def checked_graph(v: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """(edges, entry) of a shard; no edges where it is to be scanned: it is small, or its graph
    found less than LEAST_RECALL of the true neighbours of a sample."""
    none = np.empty((len(v), 0), np.int32), 0
    if len(v) < GRAPH_ROWS:
        return none
    points = levelled(v)
    edges, entry = build_graph(points)
    sample = np.random.default_rng(11).choice(len(v), min(CHECKED, len(v)), replace=False)
    many = min(k, len(v))
    found, _ = beam_search(points, edges, entry, flattened(v[sample]), max(QUERY_WIDTH, 2 * k))
    scores = flattened(v[sample])[:, :-1].astype(np.float64) @ v.T
    least = -np.sort(-scores, axis=1)[:, many - 1]
    rows = np.arange(len(sample))[:, None]
    good = (np.where(found >= 0, scores[rows, found], -np.inf) >= least[:, None] - 1e-12).sum(axis=1)
    return (edges.astype(np.int32), entry) if np.minimum(good, many).mean() >= LEAST_RECALL * many else none


def candidates(v: np.ndarray, edges: np.ndarray, entry: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of query, row of v): at least the k + 1 nearest found for each query, by the shard's graph or by a scan."""
    if edges.shape[1]:
        found, _ = beam_search(levelled(v), edges, entry, flattened(query), max(QUERY_WIDTH, 2 * k))
        rows, cols = np.nonzero(found >= 0)
        return rows, found[rows, cols]
    scores = query @ v.T
    many = min(k + 1, len(v))
    least = np.partition(scores, len(v) - many, axis=1)[:, len(v) - many]
    return np.nonzero(scores >= least[:, None])  # ties at the end included


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row
    whose vec_id is divisible by ``every``, by inner product in double precision.

    Equal vectors are one point of a graph that carries their k + 1 smallest ids,
    enough for every answer, so a third of all rows with one vector is one point.
    Points are dealt to bands by norm and to shards by hash; each shard's graph is
    built in one task, written once, and searched by blocks of queries. A band is
    left out for a query only if its largest norm cannot reach the query's k-th
    score. Unusable vectors (``usable``) take no part; vectors of different length do not
    meet; ties go to the smaller vec_id; an empty table gives no rows; extra
    columns are ignored.
    """
    good = cut_lineage(usable(vectors))
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    points = cut_lineage(good.withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
                         .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                         .withColumns({"dim": F.size("v"), "norm": norm})
                         .withColumn("band", F.floor(F.log2("norm") * BANDS_OF_OCTAVE + 0.5).cast("int")))
    # A band is a fixed range of norms of 8-byte numbers: some 17 000 for a dimension at most.
    largest_first = Window.partitionBy("dim").orderBy(F.desc("band"))
    bands = cut_lineage(points.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"))
                        .withColumn("met", F.sum("n").over(largest_first) - F.col("n"))
                        .select("dim", "band", "top", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("shards"),
                                (F.col("met") < FIRST_ROWS).alias("first")))
    dealt = points.join(F.broadcast(bands.select("dim", "band", "shards")), ["dim", "band"]).withColumn(
        "shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        v = np.asarray(table.column("v").combine_chunks().flatten()).reshape(-1, dim)
        ids = table.column("ids").combine_chunks()
        order = np.argsort(np.asarray(ids.flatten())[np.asarray(ids.offsets)[:-1] - ids.offsets[0].as_py()], kind="stable")
        v, ids = np.ascontiguousarray(v[order], np.float64), ids.take(pa.array(order))
        edges, entry = checked_graph(v, k)
        counts = np.asarray(ids.value_lengths())
        return pa.table({**{c: pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("dim", "band", "shard")},
                         "vectors": pa.array([v.tobytes()], pa.binary()), "edges": pa.array([edges.tobytes()], pa.binary()),
                         "entry": pa.array([entry], pa.int32()), "sizes": pa.array([counts.astype(np.int32).tobytes()], pa.binary()),
                         "ids": pa.array([np.asarray(ids.flatten()).astype(np.int64).tobytes()], pa.binary())})

    graphs = cut_lineage(dealt.select("dim", "band", "shard", "v", "ids").groupBy("dim", "band", "shard").applyInArrow(
        build, "dim int, band int, shard int, vectors binary, edges binary, entry int, sizes binary, ids binary"))
    asked = cut_lineage(good.where(F.col("vec_id") % every == 0).withColumns({"dim": F.size("v"), "norm": norm}))
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))

    def block(table: pa.Table) -> pa.Table:
        v = np.asarray(table.column("v").combine_chunks().flatten()).astype(np.float64)
        return pa.table({**{c: table.column(c).slice(0, 1).combine_chunks() for c in ("dim", "band", "shards")},
                         "query_ids": pa.array([table.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                         "queries": pa.array([v.tobytes()], pa.binary())})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                v, query = _unpack(row["vectors"], np.float64, (-1, dim)), _unpack(row["queries"], np.float64, (-1, dim))
                edges = _unpack(row["edges"], np.int32, (len(v), -1)) if row["edges"] else np.empty((len(v), 0), np.int32)
                sizes, ids = _unpack(row["sizes"], np.int32, -1), _unpack(row["ids"], np.int64, -1)
                begins, query_ids = np.cumsum(sizes) - sizes, _unpack(row["query_ids"], np.int64, -1)
                for at in range(0, len(query), 512):
                    rows, point = candidates(v, edges, row["entry"], query[at:at + 512], k)
                    exact = np.einsum("ij,ij->i", v[point], query[at + rows])
                    order = np.lexsort((ids[begins[point]], -exact, rows))
                    rows, point, exact = rows[order], point[order], exact[order]
                    start = np.searchsorted(rows, rows)
                    best = np.arange(len(rows)) - start <= k
                    rows, point, exact = rows[best], point[best], exact[best]
                    many = sizes[point]
                    which = np.repeat(np.arange(len(rows)), many)
                    inner = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                    hits = ids[begins[point][which] + inner]
                    asker = query_ids[at + rows[which]]
                    other = hits != asker
                    yield pa.RecordBatch.from_arrays([pa.array(asker[other]), pa.array(hits[other]), pa.array(exact[which][other])],
                                                     ["query_id", "vec_id", "score"])

    def found_in(queries: DataFrame) -> DataFrame:
        """The best of each query (dim, band, shards, vec_id, v) in the shards of its band."""
        asking = (queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
                  .select("dim", "band", "shards", "block", "vec_id", "v").groupBy("dim", "band", "block")
                  .applyInArrow(block, "dim int, band int, shards int, query_ids binary, queries binary")
                  .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))))
        hits = (asking.join(graphs, ["dim", "band", "shard"])
                .select("dim", "queries", "query_ids", "vectors", "edges", "entry", "sizes", "ids")
                .mapInArrow(search, "query_id long, vec_id long, score double"))
        ranked = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return ranked.withColumn("rank", rank).where(F.col("rank") <= k)

    top = F.broadcast(bands)
    one = cut_lineage(found_in(asked.join(top.where("first"), "dim")))
    # A band goes on for a query while its bound may reach the k-th score so far.
    reached = one.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).select(
        F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("least")).alias("least"))
    bound = F.col("top") * F.col("norm") * (1 + 1e-9)
    rest = (asked.join(reached, "vec_id", "left").join(top.where("NOT first"), "dim")
            .where(F.col("least").isNull() | (bound >= F.col("least"))))
    two = found_in(rest)
    best = one.drop("rank").unionByName(two.drop("rank"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
