"""Great-circle clustering: assignment in Spark, centroids (a few rows) in the control loop."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenmark.functions.scalars import haversine_km

Centroids = list[tuple[float, float]]


def _nearest(centroids: Centroids) -> F.Column:
    """(km, cluster) of the nearest centroid, the lowest of equally near ones."""
    each = [F.struct(haversine_km(F.col("lat"), F.col("lon"), F.lit(a), F.lit(b)).alias("km"), F.lit(i).alias("cluster")) for i, (a, b) in enumerate(centroids)]
    return F.array_min(F.array(*each))


def kmeans(points: DataFrame, k: int, max_iter: int = 200) -> tuple[DataFrame, Centroids, float]:
    """Clusters of points (sample_id, lat, lon, original_row_index from 0): the assigned points, centroids and inertia (sum of squared km).

    Starts from evenly spaced rows, keeps an empty cluster's centroid, and stops before
    centroids move if no point changes.  Each round is one aggregate over the points; only its
    k sums reach the driver.
    """
    found, inertia = _kmeans(points, [k], max_iter)
    assigned = points.withColumn("spatial_cluster_id", _nearest(found[k])["cluster"] if found[k] else F.lit(0))
    return assigned, found[k], inertia[k]


def _kmeans(points: DataFrame, ks: Sequence[int], max_iter: int) -> tuple[dict[int, Centroids], dict[int, float]]:
    """Centroids and inertia for each of several k.  A round is one job for all that haven't settled, and computes each distance once.

    A cluster's members are compared with those of the round before by their number and the exclusive or of their ids' hashes.
    """
    own = not points.is_cached
    points = points.cache()
    held = points.select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.xxhash64("sample_id").alias("h"))
    try:
        n = points.count()
        if not n:
            return {k: [] for k in ks}, {k: 0.0 for k in ks}
        first = {k: [(i * (n // min(k, n))) % n for i in range(min(k, n))] for k in ks}
        rows = {r.original_row_index: (r.lat, r.lon) for r in points.where(F.col("original_row_index").isin(*{i for x in first.values() for i in x})).collect()}
        centroids = {k: [rows[i] for i in x] for k, x in first.items()}
        start = {c: x[2:] for c, x in _members(points.withColumn("c", F.lit(0)), ["c"]).items()}  # all in cluster 0
        members, going = {k: start for k in ks}, list(ks)
        for _ in range(max_iter):
            found = _sums(held, {k: centroids[k] for k in going})
            for k in list(going):
                mine = {c: x for (at, c), x in found.items() if at == k}
                before, members[k] = members[k], {c: x[2:] for c, x in mine.items()}
                if before == members[k]:
                    going.remove(k)
                    continue
                centroids[k] = [mine[i][:2] if i in mine else c for i, c in enumerate(centroids[k])]
            if not going:
                break
        total = points.agg(*(F.sum(F.pow(_nearest(centroids[k])["km"], F.lit(2.0))).alias(f"k{k}") for k in ks)).first()
        return centroids, {k: total[f"k{k}"] or 0.0 for k in ks}
    finally:
        if own:
            points.unpersist()


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Points of the sphere, a column each."""
    a, o = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)])


def nearest_of(lat: np.ndarray, lon: np.ndarray, centroids: Centroids) -> np.ndarray:
    """The number of each point's nearest centroid: that of the least chord; where two are equal but for rounding, that of the least haversine, the lowest of equals."""
    v, c = _unit(lat, lon), _unit(*np.array(centroids).T)
    chords = np.stack([((v - c[:, i : i + 1]) ** 2).sum(0) for i in range(c.shape[1])])
    best = chords.argmin(0)
    if len(chords) > 1:
        two = np.partition(chords, 1, axis=0)[:2]
        close = np.flatnonzero(two[1] - two[0] <= 1e-9 * two[1] + 1e-14)
        a, o = np.radians(lat[close]), np.radians(lon[close])
        at = np.radians(np.array(centroids))
        best[close] = np.stack([np.sin((x - a) / 2) ** 2 + np.cos(a) * np.cos(x) * np.sin((y - o) / 2) ** 2 for x, y in at]).argmin(0)
    return best


def _sums(held: DataFrame, centroids: dict[int, Centroids]) -> dict:
    """_members() by (k, nearest of k's centroids) of points (lat, lon, h): each task gives a row for each of its clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((len(x), 5)) for k, x in centroids.items()}
        hashes = {k: np.zeros(len(x), np.int64) for k, x in centroids.items()}
        for batch in batches:
            lat, lon, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon", "h"))
            for k, x in centroids.items():
                at = nearest_of(lat, lon, x)
                for j, w in enumerate((np.nan_to_num(lat), np.nan_to_num(lon), ~np.isnan(lat), ~np.isnan(lon), np.ones(len(at)))):
                    total[k][:, j] += np.bincount(at, w, len(x))
                for c in range(len(x)):
                    hashes[k][c] ^= np.bitwise_xor.reduce(h[at == c])
        rows = [(k, c, *total[k][c].tolist(), int(hashes[k][c])) for k, x in centroids.items() for c in range(len(x)) if total[k][c, 4]]
        kinds = (pa.int32(), pa.int32(), *[pa.float64()] * 5, pa.int64())
        names = ["k", "c", "lat", "lon", "n_lat", "n_lon", "n", "h"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    parts = held.mapInArrow(run, "k int, c int, lat double, lon double, n_lat double, n_lon double, n double, h long")
    g = parts.groupBy("k", "c").agg(F.try_divide(F.sum("lat"), F.sum("n_lat")).alias("lat"), F.try_divide(F.sum("lon"), F.sum("n_lon")).alias("lon"), F.sum("n").cast("long").alias("n"), F.bit_xor("h").alias("h")).collect()  # a row a cluster
    return {(r.k, r.c): (r.lat, r.lon, r.n, r.h) for r in g}


def _members(placed: DataFrame, keys: Sequence[str]) -> dict:
    """Per key: mean lat and lon, number of points and exclusive or of their ids' hashes."""
    g = placed.groupBy(*keys).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("sample_id")).alias("h")).collect()
    return {(r[0] if len(keys) == 1 else tuple(r[: len(keys)])): (r.lat, r.lon, r.n, r.h) for r in g}


def choose_k(points: DataFrame, max_k: int = 8, max_iter: int = 100) -> int:
    """The elbow: the first k whose next cluster lowers inertia by under a tenth of the whole range."""
    n = points.count()
    if n <= 3:
        return min(2, n)
    max_k = max(2, min(max_k, n // 2))
    _, inertia = _kmeans(points, range(2, max_k + 1), max_iter)
    span = inertia[2] - inertia[max_k]
    if span < 1e-6:
        return 3
    return next((k for k in range(2, max_k) if (inertia[k] - inertia[k + 1]) / span < 0.1), max_k)


#: Least cosine to the middle: no two points of a cluster are then a quarter of a great circle apart.
NARROW = 0.75
#: Points that a piece of a cluster holds before its hull is taken, and pieces whose hulls become one.
PIECE, TOGETHER = 4096, 16


def _ring(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Which points can be an end of the farthest pair of a narrow cluster: the corners of their hull on the sphere.

    Seen from the sphere's middle great circles are straight lines, so the hull is that of a plane (central projection).  Along a great circle whose
    points are all within a quarter of it from some point, the distance from that point is greatest at an end; so of a hull's points a corner is farthest.
    """
    a, o = np.radians(lat), np.radians(lon)
    v = np.column_stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)])
    middle = v.mean(0)
    size = np.linalg.norm(middle)
    if len(v) < 4 or size < NARROW:
        return np.arange(len(v))
    middle = middle / size
    east = np.cross(middle, [0.0, 0.0, 1.0] if abs(middle[2]) < 0.9 else [1.0, 0.0, 0.0])
    east /= np.linalg.norm(east)
    flat = np.column_stack([v @ east, v @ np.cross(middle, east)]) / (v @ middle)[:, None]
    order = np.lexsort((flat[:, 1], flat[:, 0]))

    def half(rows: np.ndarray) -> list[int]:
        out: list[int] = []
        for i in rows.tolist():
            # Keep what turns left, and, as rounding may hide a corner, what is nearly straight.
            while len(out) > 1 and (flat[out[-1], 0] - flat[out[-2], 0]) * (flat[i, 1] - flat[out[-2], 1]) - (flat[out[-1], 1] - flat[out[-2], 1]) * (flat[i, 0] - flat[out[-2], 0]) < -1e-15:
                out.pop()
            out.append(i)
        return out

    return np.unique(half(order) + half(order[::-1]))


def hulls(points: DataFrame, pieces: int) -> DataFrame:
    """(spatial_cluster_id, lat, lon): of narrow clusters the points that can be an end of the farthest pair.

    Clusters are cut to so many pieces by a hash; each piece leaves the corners of its hull, and corners of ``TOGETHER`` pieces meet
    in the next round, until a cluster is one piece.  So no task holds a cluster, and a round's rows are its hulls' corners.
    """
    now = points.select("spatial_cluster_id", "lat", "lon").distinct()
    kind = now.schema["spatial_cluster_id"].dataType.simpleString()

    def corners(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[_ring(rows["lat"].to_numpy(), rows["lon"].to_numpy())][["spatial_cluster_id", "lat", "lon"]]

    while True:
        dealt = now.withColumn("_piece", F.pmod(F.xxhash64("lat", "lon"), F.lit(pieces)))
        now = dealt.groupBy("spatial_cluster_id", "_piece").applyInPandas(corners, f"spatial_cluster_id {kind}, lat double, lon double")
        if pieces == 1:
            return now
        pieces = -(-pieces // TOGETHER)


def diameters(assigned: DataFrame) -> DataFrame:
    """(spatial_cluster_id, max_km): exact greatest distance between two points of a cluster, 0 of a single one.

    Of clusters within 41 degrees of their middle, pairs of hull corners alone are compared; wider ones are cut to cells (``_by_cells``).
    """
    a, o = F.radians("lat"), F.radians("lon")
    axes = {"x": F.cos(a) * F.cos(o), "y": F.cos(a) * F.sin(o), "z": F.sin(a)}
    middle = assigned.groupBy("spatial_cluster_id").agg(*(F.avg(e).alias(f"_{n}") for n, e in axes.items()))
    length = F.sqrt(sum((F.col(f"_{n}") * F.col(f"_{n}") for n in axes), F.lit(0.0)))
    dot = sum((e * F.col(f"_{n}") for n, e in axes.items()), F.lit(0.0)) / length
    placed = assigned.join(middle, "spatial_cluster_id")
    narrow = placed.groupBy("spatial_cluster_id").agg(F.coalesce(F.min(F.when(length > 0, dot)) > NARROW, F.lit(False)).alias("narrow"), F.countDistinct("lat", "lon").alias("n"))
    told = {r.spatial_cluster_id: (r.narrow, r.n) for r in narrow.collect()}  # a row a cluster
    own = F.col("spatial_cluster_id").isin(*(c for c, (is_narrow, _) in told.items() if is_narrow))
    rim = hulls(assigned.where(own), -(-max([1, *(n for is_narrow, n in told.values() if is_narrow)]) // PIECE))
    far = rim.select("spatial_cluster_id", F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    found = rim.join(far, "spatial_cluster_id").groupBy("spatial_cluster_id").agg(F.max(haversine_km(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b"))).alias("max_km"))
    found = found.withColumn("max_km", F.coalesce("max_km", F.lit(0.0)))
    return found if all(is_narrow for is_narrow, _ in told.values()) else found.unionByName(_by_cells(assigned.where(~own)))


def _by_cells(assigned: DataFrame, cells: int = 24) -> DataFrame:
    """(spatial_cluster_id, max_km) of clusters of any width.

    A cluster's box is cut to cells; the distance of two cells' points is at most that of their
    middles plus both radii.  Only pairs of cells that could beat the best distance between two cells' sampled
    points are opened, so that far fewer than all pairs are compared.
    """
    box = assigned.groupBy("spatial_cluster_id").agg(F.min("lat").alias("a0"), F.max("lat").alias("a1"), F.min("lon").alias("o0"), F.max("lon").alias("o1"))
    part = lambda x, lo, hi: F.least(F.lit(cells - 1), F.floor((x - lo) / F.greatest(hi - lo, F.lit(1e-12)) * cells)).cast("int")
    placed = assigned.join(box, "spatial_cluster_id").select("spatial_cluster_id", "lat", "lon", part(F.col("lat"), F.col("a0"), F.col("a1")).alias("i"), part(F.col("lon"), F.col("o0"), F.col("o1")).alias("j"))
    place = ["spatial_cluster_id", "i", "j"]
    # At most cells * cells rows a cluster, each with the tight box of its points and one of them.
    cell = placed.groupBy(*place).agg(F.min("lat").alias("a0"), F.max("lat").alias("a1"), F.min("lon").alias("o0"), F.max("lon").alias("o1"), F.min(F.struct("lat", "lon")).alias("some"))
    mid_a, mid_o = (F.col("a0") + F.col("a1")) / 2, (F.col("o0") + F.col("o1")) / 2
    # Both legs along the box's half sides, an upper bound of the radius (a degree of longitude is longest at the equator).
    radius = haversine_km(F.col("a0"), F.lit(0.0), mid_a, F.lit(0.0)) + haversine_km(F.lit(0.0), F.col("o0"), F.lit(0.0), mid_o)
    cell = cell.select(*place, mid_a.alias("ma"), mid_o.alias("mo"), radius.alias("r"), "some")
    b = cell.select("spatial_cluster_id", *(F.col(c).alias(f"{c}_b") for c in ("i", "j", "ma", "mo", "r", "some")))
    pairs = cell.join(b, "spatial_cluster_id").where("i < i_b or (i = i_b and j <= j_b)")
    pairs = pairs.withColumn("least", haversine_km(F.col("some.lat"), F.col("some.lon"), F.col("some_b.lat"), F.col("some_b.lon"))).withColumn("most", haversine_km(F.col("ma"), F.col("mo"), F.col("ma_b"), F.col("mo_b")) + F.col("r") + F.col("r_b"))
    best = pairs.groupBy("spatial_cluster_id").agg(F.max("least").alias("bound"))
    open_ = pairs.join(best, "spatial_cluster_id").where("most >= bound").select("spatial_cluster_id", "i", "j", "i_b", "j_b")
    points = placed.select(*place, "lat", "lon").distinct()
    far = points.select("spatial_cluster_id", F.col("i").alias("i_b"), F.col("j").alias("j_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    met = open_.join(points, place).join(far, ["spatial_cluster_id", "i_b", "j_b"])
    found = met.groupBy("spatial_cluster_id").agg(F.max(haversine_km(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b"))).alias("max_km"))
    return box.select("spatial_cluster_id").join(found, "spatial_cluster_id", "left").withColumn("max_km", F.coalesce("max_km", F.lit(0.0)))


def metadata(assigned: DataFrame) -> DataFrame:
    """spatial_cluster_metadata: size, mean coordinates and greatest inner distance of each cluster."""
    g = assigned.groupBy("spatial_cluster_id").agg(F.count("*").alias("n_samples"), F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"))
    return g.join(diameters(assigned), "spatial_cluster_id").select("spatial_cluster_id", "n_samples", "centroid_lat", "centroid_lon", F.col("max_km").alias("max_intra_cluster_distance_km"))
