"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing, exact reranking.

Equal vectors are one point. Points of similar length form a group; within it they are scaled to the
unit ball and lifted to the sphere, where the largest inner product is the smallest distance. Each of
TABLES tables cuts the sphere by p-stable hashes, floor((a x + b) / w), into buckets. A query visits the
buckets that are likeliest to hold its neighbours: its own, then those behind the nearest borders, in
the order of the squared distances to cross. How many are visited follows from an audit: neighbours of a
bounded sample of queries, found by brute force over all points, tell how many visits reach them.
Candidates meet queries by the region (first hashes) of their bucket, in blocks of bounded size, and are
reranked there by exact products.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.tables import keep_once
from fieldglass.llm.texthash import mix

NEIGHBOURS = 20
TABLES = 6
WIDTH = 3.0  # of a hash cell, in deviations of a projection
MOST_HASHES = 24
BUCKET = 256  # points that meet in a bucket, at most, as the sample tells
REGION = 16_384  # points of a region, about
SAMPLE = 1 << 20  # components of a group's points that fix its hashes and begin every answer
SAMPLE_SHARE = 8  # an eighth of the points at most
AUDIT = 256  # queries whose true neighbours fix the number of visits
RECALL = 0.95  # of the audit
MOST_VISITS = (64, 256, 1_024)  # of a table, tried in turn; where the last do not do, every point is compared
POINT_BLOCK, QUERY_BLOCK = 16_384, 8_192
_TOGETHER = 256  # queries of a block whose products are held at once
_SPARE = 4  # products in blocks may order near ties otherwise than exact ones


def perturbations(hashes: int, count: int) -> np.ndarray:
    """(2 * hashes, sets) of 0 and 1: sets of borders to cross, borders ranked by distance, in expected order of success.

    The border ranked j from the nearest and the one ranked j from the farthest belong to one hash, so no set has both.
    """
    k = hashes
    ranks = np.arange(1, 2 * k + 1)
    near = ranks * (ranks + 1) / (4 * (k + 1) * (k + 2))
    far = 1 - (2 * k + 1 - ranks) / (k + 1) + (2 * k + 1 - ranks) * (2 * k + 2 - ranks) / (4 * (k + 1) * (k + 2))
    cost = np.where(ranks <= k, near, far)
    sets: list[tuple[int, ...]] = [()]
    waiting = [(cost[0], (0,))] if k else []
    while waiting and len(sets) < count:
        total, chosen = heapq.heappop(waiting)
        if all(2 * k - 1 - c not in chosen for c in chosen):
            sets.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(waiting, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(waiting, (total + cost[last + 1], (*chosen, last + 1)))
    out = np.zeros((2 * k, len(sets)), np.float64)
    for j, chosen in enumerate(sets):
        out[list(chosen), j] = 1
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


@dataclass
class Hashes:
    """The hash functions of one group of points: of one dimension, with lengths within a factor of two."""

    group: int
    dim: int
    longest: float
    width: float
    hashes: int
    region: int  # how many of the hashes name the region
    regions: int

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors / self.longest
        return np.c_[x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))]

    @staticmethod
    def asked(vectors: np.ndarray) -> np.ndarray:
        return np.c_[vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), np.zeros(len(vectors))]

    def cells(self, lifted: np.ndarray, table: int) -> np.ndarray:
        """Places on the lines of the table's hashes, in cells of one."""
        rng = np.random.default_rng([self.dim, table])
        lines, shifts = rng.normal(size=(self.dim + 1, MOST_HASHES)), rng.random(MOST_HASHES)
        return lifted @ lines[:, : self.hashes] / self.width + shifts[: self.hashes]

    def multipliers(self, table: int) -> np.ndarray:
        return mix(np.arange(self.hashes, dtype=np.uint64) + np.uint64(1000 * table + 1)) | np.uint64(1)

    def buckets(self, vectors: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(region, bucket) of each point."""
        code = np.floor(self.cells(self.lifted(vectors), table)).astype(np.int64).astype(np.uint64) * self.multipliers(table)
        return self.named(code[:, : self.region].sum(axis=1, dtype=np.uint64)), code.sum(axis=1, dtype=np.uint64)

    def named(self, region: np.ndarray) -> np.ndarray:
        return mix(region) % np.uint64(self.regions)

    def visits(self, vectors: np.ndarray, table: int, count: int, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(region, bucket), each a row per query: the `count` buckets that are likeliest to hold its neighbours."""
        place = self.cells(self.asked(vectors), table)
        cell = np.floor(place)
        inside = place - cell
        border = np.concatenate([inside, 1 - inside], axis=1) ** 2
        nearest = np.argsort(border, axis=1, kind="stable")
        cost = np.take_along_axis(border, nearest, axis=1) @ sets
        taken = np.argsort(cost, axis=1, kind="stable")[:, :count]
        factor = self.multipliers(table)
        moved = np.concatenate([np.uint64(0) - factor, factor])
        in_region = np.tile(np.arange(self.hashes) < self.region, 2)
        code = cell.astype(np.int64).astype(np.uint64) * factor
        out = []
        for own, move in ((code[:, : self.region], np.where(in_region, moved, np.uint64(0))), (code, moved)):
            steps = move[nearest]
            every = np.zeros((len(vectors), sets.shape[1]), np.uint64) + own.sum(axis=1, dtype=np.uint64)[:, None]
            for j in range(2 * self.hashes):
                every[:, sets[j] > 0] += steps[:, j: j + 1]
            out.append(np.take_along_axis(every, taken, axis=1))
        return self.named(out[0]), out[1]


def fit(group: int, dim: int, n: int, longest: float, sample: np.ndarray) -> Hashes:
    """Cells as wide as the sample spreads; as many hashes as leave BUCKET of n points together, and REGION in a region."""
    fitted = Hashes(group, dim, longest, 1.0, MOST_HASHES, MOST_HASHES, -(-n // REGION))
    lifted = fitted.lifted(sample[:4096])
    spread = np.sqrt(((lifted - lifted.mean(axis=0)) ** 2).sum(axis=1).mean())
    fitted.width = WIDTH * spread if spread > 1e-9 else 1.0
    cell = np.floor(fitted.cells(lifted, 0)).astype(np.int64)

    def needed(limit: int) -> int:
        label = np.zeros(len(cell), np.int64)
        for k in range(MOST_HASHES + 1):
            if k:
                label = np.unique(np.c_[label, cell[:, k - 1]], axis=0, return_inverse=True)[1].ravel()
            met = np.bincount(label).astype(np.float64)
            if n * (met * (met - 1)).sum() <= limit * max(1, len(cell) * (len(cell) - 1)):
                return k
        return MOST_HASHES

    fitted.hashes = needed(BUCKET)
    fitted.region = min(fitted.hashes, needed(REGION))
    return fitted


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products row by row, the same for a pair wherever it is computed."""
    return (a * b).sum(axis=1)


def points_of(vectors: DataFrame, id_column: str, vector_column: str, k: int) -> DataFrame:
    """(point, vector, dim, length, band, ids): distinct vectors that take part, each with its k + 1 smallest ids.

    No answer of k rows holds more copies of a vector, so the other ids are not needed.
    """
    one = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit_ = F.coalesce(F.col("id").isNotNull() & (F.size("vector") > 0) & fine & (length > 0) & (length < float("inf")), F.lit(False))
    known = one.where(fit_).dropDuplicates(["vector", "id"])
    few = known.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("place") <= k + 1)
    points = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumns({
        "point": F.monotonically_increasing_id(), "dim": F.size("vector"), "length": length})
    return keep_once(points.withColumn("band", F.floor(F.log2("length") + 0.5).cast("int")), "points")


@dataclass
class Sample:
    """Some points of one dimension, the same in every run."""

    point: np.ndarray
    first_id: np.ndarray
    vectors: np.ndarray


def fitted_groups(points: DataFrame) -> tuple[list[Hashes], dict[int, Sample]]:
    """The hashes of every group, and a sample of every dimension; a group gives SAMPLE components and one point in SAMPLE_SHARE at most."""
    groups = points.groupBy("dim", "band").agg(F.count("*").alias("n"), F.max("length").alias("longest")).orderBy("dim", "band").collect()
    out, taken = [], {}
    for group, row in enumerate(groups):
        dim = row["dim"]
        own = points.where((F.col("dim") == dim) & (F.col("band") == row["band"])).select("point", F.col("ids")[0].alias("first_id"), "vector")
        rows = own.orderBy(F.xxhash64("vector"), "vector").limit(max(1, min(SAMPLE // dim, row["n"] // SAMPLE_SHARE))).collect()
        vectors = np.array([r["vector"] for r in rows], np.float64).reshape(-1, dim)
        out.append(fit(group, dim, row["n"], row["longest"], vectors))
        taken.setdefault(dim, []).append(Sample(np.array([r["point"] for r in rows]), np.array([r["first_id"] for r in rows]), vectors))
    join = lambda parts, name: np.concatenate([getattr(p, name) for p in parts])
    return out, {dim: Sample(*(join(parts, name) for name in ("point", "first_id", "vectors"))) for dim, parts in taken.items()}


def true_neighbours(points: DataFrame, queries: dict[int, np.ndarray], k: int) -> DataFrame:
    """(query, point, vector, band, score): the k points of largest product with each of a few queries, by a scan of all points."""
    names = np.array(list(queries), np.int64)
    by_dim = {dim: [i for i, q in enumerate(names) if len(queries[q]) == dim] for dim in {len(v) for v in queries.values()}}
    asked = {dim: np.array([queries[names[i]] for i in rows]) for dim, rows in by_dim.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.intersect1d(dims, list(asked)):
                own = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(own))
                scores = asked[dim] @ matrix(part["vector"], dim).T
                scores[names[by_dim[dim]][:, None] == part["point"].to_numpy()[None, :]] = -np.inf
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                query = np.repeat(np.arange(len(best)), best.shape[1])
                score = scores[query, best.ravel()]
                kept = np.isfinite(score)
                rows = part.take(pa.array(best.ravel()[kept]))
                yield pa.record_batch({
                    "query": pa.array(names[by_dim[dim]][query[kept]]), "point": rows["point"], "vector": rows["vector"], "band": rows["band"],
                    "score": pa.array(score[kept])})

    kind = points.schema["vector"].dataType.simpleString()
    found = points.select("point", "vector", "dim", "band").mapInArrow(scan, f"query bigint, point bigint, vector {kind}, band int, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def visits_needed(groups: list[Hashes], queries: dict[int, np.ndarray], truth: list, bands: dict[tuple[int, int], int]) -> int | None:
    """How many visits of each table reach RECALL of the true neighbours; None if the last of MOST_VISITS do not."""
    of_group = [[r for r in truth if bands[len(r["vector"]), r["band"]] == h.group] for h in groups]
    for most in MOST_VISITS:
        ranks = [np.ones(1, np.int64)] if not truth else []
        for hashes, pairs in zip(groups, of_group, strict=True):
            sets = perturbations(hashes.hashes, 4 * most)
            for lo in range(0, len(pairs), 256):
                part = pairs[lo: lo + 256]
                asks = np.array([queries[r["query"]] for r in part], np.float64)
                hits = np.array([r["vector"] for r in part], np.float64)
                rank = np.full(len(part), most + 1)
                for table in range(TABLES):
                    same = hashes.visits(asks, table, most, sets)[1] == hashes.buckets(hits, table)[1][:, None]
                    rank = np.minimum(rank, np.where(same.any(axis=1), same.argmax(axis=1) + 1, most + 1))
                ranks.append(rank)
        needed = int(np.quantile(np.concatenate(ranks), RECALL, method="higher"))
        if needed <= most:
            return needed
    return None


def indexed(points: DataFrame, groups: list[Hashes], bands: dict[tuple[int, int], int]) -> DataFrame:
    """(grp, tbl, region, bucket, point, first_id, vector): every point, once a table."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([bands[d, b] for d, b in zip(batch["dim"].to_pylist(), batch["band"].to_pylist(), strict=True)])
            for group in np.unique(own):
                part = batch.take(pa.array(np.flatnonzero(own == group)))
                vectors = matrix(part["vector"], groups[group].dim)
                for table in range(TABLES):
                    region, bucket = groups[group].buckets(vectors, table)
                    n = len(vectors)
                    yield pa.record_batch({
                        "grp": pa.array(np.full(n, group, np.int32)), "tbl": pa.array(np.full(n, table, np.int32)), "region": pa.array(signed(region)),
                        "bucket": pa.array(signed(bucket)), "point": part["point"], "first_id": part["first_id"], "vector": part["vector"]})

    kind = points.schema["vector"].dataType.simpleString()
    return points.select("point", "vector", "dim", "band", F.col("ids")[0].cast("long").alias("first_id")).mapInArrow(
        place, f"grp int, tbl int, region bigint, bucket bigint, point bigint, first_id bigint, vector {kind}")


def best_of_sample(queries: DataFrame, samples: dict[int, Sample], k: int) -> DataFrame:
    """(query, dim, vector, bound, point, first_id, score): queries with their k best points of the sample, as arrays.

    The search begins with these answers: only products of at least `bound`, the least of them, can change it.
    """
    shared = queries.sparkSession.sparkContext.broadcast(samples)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim, sample in shared.value.items():
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                many = min(k, len(sample.point))
                for lo in range(0, own.num_rows, 256):
                    part = own.slice(lo, 256)
                    asks = matrix(part["vector"], dim)
                    products = asks @ sample.vectors.T
                    best = np.argpartition(-products, many - 1, axis=1)[:, :many].ravel()
                    scores = exact(np.repeat(asks, many, axis=0), sample.vectors[best])
                    bound = scores.reshape(-1, many).min(axis=1) if many == k else np.full(len(asks), -np.inf)
                    ends = pa.array(np.arange(0, len(best) + 1, many, dtype=np.int32))
                    listed = lambda x: pa.ListArray.from_arrays(ends, pa.array(x))  # noqa: B023, E731
                    yield pa.record_batch({
                        "query": part["point"], "dim": part["dim"], "vector": part["vector"], "bound": pa.array(bound),
                        "point": listed(sample.point[best]), "first_id": listed(sample.first_id[best]), "score": listed(scores)})

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.select("point", "vector", "dim").mapInArrow(
        compare, f"query bigint, dim int, vector {kind}, bound double, point array<bigint>, first_id array<bigint>, score array<double>")


def visiting(queries: DataFrame, groups: list[Hashes], visits: int) -> DataFrame:
    """(grp, tbl, region, query, buckets, vector, bound): a row per region that a query visits, with its buckets there."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {h.hashes: perturbations(h.hashes, 4 * visits) for h in groups}
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for hashes in groups:
                part = batch.take(pa.array(np.flatnonzero(dims == hashes.dim)))
                for lo in range(0, part.num_rows, 256):
                    some = part.slice(lo, 256)
                    vectors = matrix(some["vector"], hashes.dim)
                    for table in range(TABLES):
                        region, bucket = hashes.visits(vectors, table, visits, sets[hashes.hashes])
                        who = np.repeat(np.arange(len(vectors)), region.shape[1])
                        region, bucket = region.ravel(), bucket.ravel()
                        order = np.lexsort((region, who))
                        who, region, bucket = who[order], region[order], bucket[order]
                        starts = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (region[1:] != region[:-1])])
                        n = len(starts)
                        rows = some.take(pa.array(who[starts]))
                        yield pa.record_batch({
                            "grp": pa.array(np.full(n, hashes.group, np.int32)), "tbl": pa.array(np.full(n, table, np.int32)),
                            "region": pa.array(signed(region[starts])), "query": rows["query"], "bound": rows["bound"],
                            "buckets": pa.ListArray.from_arrays(pa.array(np.r_[starts, len(who)].astype(np.int32)), pa.array(signed(bucket))), "vector": rows["vector"]})

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.select("query", "vector", "dim", "bound").mapInArrow(
        probe, f"grp int, tbl int, region bigint, query bigint, bound double, buckets array<bigint>, vector {kind}")


def best_of_block(points: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """(query, point, first_id, score): of each query, the k points of largest product, its bound at least, in the buckets that it visits."""
    empty = pa.table({"query": pa.array([], pa.int64()), "point": pa.array([], pa.int64()), "first_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not points.num_rows or not queries.num_rows:
        return empty
    order = np.argsort(points["bucket"].to_numpy(), kind="stable")
    points = points.take(pa.array(order)).combine_chunks()
    queries = queries.combine_chunks()
    bucket = points["bucket"].to_numpy()
    dim = len(points["vector"][0])
    have, asks = matrix(points["vector"].combine_chunks(), dim), matrix(queries["vector"].combine_chunks(), dim)
    lists = queries["buckets"].combine_chunks()
    who = np.repeat(np.arange(len(asks)), np.diff(lists.offsets.to_numpy()))
    visited = lists.flatten().to_numpy()
    lo, hi = np.searchsorted(bucket, visited), np.searchsorted(bucket, visited, "right")
    who, lo, hi = who[hi > lo], lo[hi > lo], hi[hi > lo]
    if not len(who):
        return empty
    order = np.argsort(lo, kind="stable")
    who, lo, hi = who[order], lo[order], hi[order]
    many = min(k + _SPARE, len(have))
    bounds = queries["bound"].to_numpy()
    least = np.where(np.isfinite(bounds), bounds - 1e-9 * np.abs(bounds), -1.7e308)
    found = []
    for first in range(0, len(asks), _TOGETHER):
        own = (who >= first) & (who < first + _TOGETHER)
        some, start, end = who[own] - first, lo[own], hi[own]
        if not len(some):
            continue
        scores = np.full((min(_TOGETHER, len(asks) - first), len(have)), -np.inf)
        cuts = np.flatnonzero(np.r_[True, start[1:] != start[:-1]])
        for a, b in zip(cuts, [*cuts[1:], len(start)], strict=True):
            rows, bucket_rows = some[a:b], slice(start[a], end[a])
            scores[rows, bucket_rows] = asks[first + rows] @ have[bucket_rows].T
        best = np.argpartition(-scores, many - 1, axis=1)[:, :many].ravel()
        row = np.repeat(np.arange(len(scores)), many)
        kept = scores[row, best] >= least[first + row]
        found.append((first + row[kept], best[kept]))
    query, point = (np.concatenate(parts) for parts in zip(*found, strict=True))
    return pa.table({
        "query": queries["query"].take(pa.array(query)), "point": points["point"].take(pa.array(point)), "first_id": points["first_id"].take(pa.array(point)),
        "score": pa.array(exact(asks[query], have[point]))})


def candidates(
    points: DataFrame, queries: DataFrame, groups: list[Hashes], samples: dict[int, Sample], bands: dict[tuple[int, int], int], visits: int, k: int,
) -> DataFrame:
    """(query, point, first_id, score): the k best points of each query among the sample and visited buckets, a point of the query's own included."""
    key = ["grp", "tbl", "region"]
    begun = keep_once(best_of_sample(queries, samples, k), "begun")
    members, asks = indexed(points, groups, bands), visiting(begun, groups, visits)
    # A crowded region is cut into blocks of points and of queries, and every block meets every other one.
    crowds = keep_once(
        members.groupBy(key).agg(F.ceil(F.count("*") / POINT_BLOCK).cast("long").alias("point_blocks"))
        .join(asks.groupBy(key).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("long").alias("query_blocks")), key), "regions")
    blocks = [*key, "point_block", "query_block"]
    left = members.join(crowds, key).select(
        *key, "bucket", "point", "first_id", "vector", F.pmod(F.xxhash64("point"), F.col("point_blocks")).alias("point_block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)).alias("query_block"))
    right = asks.join(crowds, key).select(
        *key, "query", "buckets", "vector", "bound", F.pmod(F.xxhash64("query"), F.col("query_blocks")).alias("query_block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("point_blocks") - 1)).alias("point_block"))
    found = left.groupBy(blocks).cogroup(right.groupBy(blocks)).applyInArrow(
        lambda a, b: best_of_block(a, b, k), "query bigint, point bigint, first_id bigint, score double")
    first = begun.select("query", F.explode(F.arrays_zip("point", "first_id", "score")).alias("s")).select("query", "s.point", "s.first_id", "s.score")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "first_id")
    every = found.union(first).dropDuplicates(["query", "point"])
    return every.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def nearest(
    vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = NEIGHBOURS,
) -> DataFrame:
    """The k rows of largest inner product found for every row that is a query: query_id, rank, vec_id, score.

    Every other row of the same dimension is a candidate. Ties go to the smaller id. Ids are whole
    numbers; rows whose id or vector is null, and vectors that are empty, zero or hold a null or
    non-finite component, take no part. Rows with the same id and vector are one row. The score is the
    sum of products in double precision. An empty table gives no rows.
    """
    own = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"), is_query.alias("asks"))
    points = points_of(own, "id", "vector", k)
    asks = keep_once(own.where("asks").select("id", "vector").dropDuplicates(["id", "vector"]).join(points.select("vector", "point"), "vector").select("id", "point"), "asks")
    queries = keep_once(points.join(asks.select("point").distinct(), "point", "left_semi"), "query-points")
    groups, samples = fitted_groups(points)
    bands = {(r["dim"], r["band"]): i for i, r in enumerate(points.select("dim", "band").distinct().orderBy("dim", "band").collect())}
    audited = {r["point"]: np.array(r["vector"], np.float64) for r in queries.orderBy(F.xxhash64("vector"), "vector").limit(AUDIT).select("point", "vector").collect()}
    truth = true_neighbours(points, audited, k).collect() if audited else []
    visits = visits_needed(groups, audited, truth, bands)
    if visits is None:
        for hashes in groups:
            hashes.hashes, hashes.region, hashes.regions = 0, 0, 1  # one bucket: every point is compared
        visits = 1
    met = keep_once(candidates(points, queries, groups, samples, bands, visits, k + 1), "neighbours")
    named = met.join(points.select("point", F.explode("ids").alias("id")), "point")
    answers = named.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "point"))).alias("found"))
    of_query = asks.join(answers, F.col("query") == asks["point"]).select(F.col("id").alias("query_id"), F.posexplode(F.slice(
        F.filter("found", lambda f: (f["id"] != F.col("id")) | (f["point"] != F.col("query"))), 1, k)).alias("place", "f"))
    return of_query.select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.minus")).alias("score"))
