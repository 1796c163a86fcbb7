"""Vectors: nearest neighbours, centroids, cohesion, silhouettes and clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlane.session import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is null, empty or zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, 1 - dot(a, b) / n)


def nearest_to(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``k`` vectors nearest to one query vector by cosine, ties by key; each task keeps its own ``k``."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine_distance(F.col(column), q).alias("distance")).where("distance is not null").orderBy("distance", key).limit(k)


def nearest_neighbours(vectors: DataFrame, every: int = 50, k: int = 5, block: int = 2048, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query, neighbour, distance, rank``: for every vector whose key is divisible by ``every``, its ``k`` nearest others.

    The queries are cut into blocks of ``block`` rows. The data stays where it is read: each task goes through its batches once for every block,
    multiplies them as matrices and keeps ``k`` candidates a query, so a task sends ``k`` rows a query, whatever it reads. One block is
    broadcast at a time (``block`` vectors, a fixed size); no side is gathered and no pair is kept that can't be in the answer.
    Null, empty and zero vectors take no part. Ties go to the smaller key.
    """
    clean = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).select(F.col(key).alias("key"), F.col(column).alias("v"))
    asked = clean.where(F.pmod("key", F.lit(every)) == 0)
    n_blocks = max(1, -(-asked.count() // block))
    blocks = cut(asked.withColumn("b", F.pmod(F.xxhash64("key"), F.lit(n_blocks))))
    best = None
    for b in range(n_blocks):
        found = _nearest_in_batches(clean, blocks.where(F.col("b") == b), k)
        best = found if best is None else best.unionByName(found)
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest_in_batches(data: DataFrame, block: DataFrame, k: int) -> DataFrame:
    rows = block.select("key", "v").collect()  # one block of queries
    qk, q = np.array([r.key for r in rows], dtype=np.int64), np.array([r.v for r in rows], dtype=np.float64)
    qn = np.linalg.norm(q, axis=1) if len(rows) else np.zeros(0)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_d, best_k = np.full((len(qk), k), np.inf), np.full((len(qk), k), np.iinfo(np.int64).max)
        for frame in batches:
            if not len(frame) or not len(qk):
                continue
            d, dk = np.array(frame["v"].tolist(), dtype=np.float64), frame["key"].to_numpy(np.int64)
            with np.errstate(divide="ignore", invalid="ignore"):
                dist = 1 - (q @ d.T) / np.outer(qn, np.linalg.norm(d, axis=1))
            dist = np.where(np.isfinite(dist) & (dk[None, :] != qk[:, None]), dist, np.inf)
            both_d, both_k = np.concatenate([best_d, dist], axis=1), np.concatenate([best_k, np.broadcast_to(dk, dist.shape)], axis=1)
            order = np.lexsort((both_k, both_d), axis=1)[:, :k]
            best_d, best_k = np.take_along_axis(both_d, order, 1), np.take_along_axis(both_k, order, 1)
        at = np.isfinite(best_d)
        yield pd.DataFrame({"query": np.repeat(qk, at.sum(1)), "neighbour": best_k[at], "distance": best_d[at]})

    return data.mapInPandas(score, "query bigint, neighbour bigint, distance double")


def centroids(vectors: DataFrame, label: str = "label", column: str = "embedding") -> DataFrame:
    """``label, n, centroid``: mean vectors, summed by (label, place) so that no label's vectors meet in one task."""
    parts = vectors.where(F.col(column).isNotNull()).select(label, F.posexplode(column).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centroid"))


def cohesion(vectors: DataFrame, label: str = "label", column: str = "embedding") -> DataFrame:
    """``label, n, pct, cohesion``: size, share and mean cosine distance to the centroid of each cluster.

    Centroids number as many as clusters; their size is left to the broadcast threshold.
    """
    c = centroids(vectors, label, column).withColumnRenamed("n", "size")
    d = vectors.where(F.col(column).isNotNull()).join(c, label).select(label, cosine_distance(F.col(column), F.col("centroid")).alias("d"))
    total = vectors.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("total"))
    return d.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("cohesion")).crossJoin(F.broadcast(total)).select(label, "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"), "cohesion")


def representatives(vectors: DataFrame, k: int = 5, label: str = "label", key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``label, key, distance, rank``: the ``k`` members nearest to their centroid, pre-ranked by bucket."""
    c = centroids(vectors, label, column).drop("n")
    d = vectors.join(c, label).select(label, key, cosine_distance(F.col(column), F.col("centroid")).alias("distance")).where("distance is not null")
    local = Window.partitionBy(label, F.pmod(F.xxhash64(key), F.lit(64))).orderBy("distance", key)
    w = Window.partitionBy(label).orderBy("distance", key)
    return d.withColumn("r", F.row_number().over(local)).where(F.col("r") <= k).drop("r").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def assign_nearest(vectors: DataFrame, centres: DataFrame, label: str = "label", key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key, label, similarity``: the centre with the largest cosine, ties to the smaller label; one row of ``centres`` per label."""
    packed = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(label), F.col("centroid")))).alias("cs"))  # one row, as large as the centres
    sims = F.transform("cs", lambda c: F.struct((1 - cosine_distance(F.col(column), c["centroid"])).alias("similarity"), (-c[label]).alias("neg")))
    return vectors.crossJoin(F.broadcast(packed)).withColumn("best", F.array_max(sims)).select(key, (-F.col("best.neg")).alias("assigned"), F.col("best.similarity").alias("similarity"))


def silhouettes(vectors: DataFrame, label: str = "label", key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``label, n, silhouette``: squared-Euclidean silhouettes from cluster sums, in one pass and without pairs.

    The mean squared distance to a cluster follows from its size, its sum and its sum of squared norms; clusters
    number few, and one row with their sums is broadcast. A cluster of one has 0.
    """
    clean = vectors.where(F.col(column).isNotNull())
    c = centroids(clean, label, column)
    norms = clean.groupBy(label).agg(F.avg(dot(F.col(column), F.col(column))).alias("sq"))
    packed = c.join(norms, label).agg(F.collect_list(F.struct(F.col(label).alias("l"), "n", "centroid", "sq")).alias("cs"))
    x = F.col(column)
    d = F.transform("cs", lambda s: F.struct(s["l"].alias("l"), s["n"].alias("n"), F.greatest(F.lit(0.0), dot(x, x) - 2 * dot(x, s["centroid"]) + s["sq"]).alias("d")))
    rows = clean.crossJoin(F.broadcast(packed)).withColumn("ds", d)
    own = F.get(F.filter("ds", lambda s: s["l"] == F.col(label)), F.lit(0))
    rows = rows.withColumn("own", own).withColumn("a", F.when(F.col("own.n") > 1, F.col("own.d") * F.col("own.n") / (F.col("own.n") - 1)))
    rows = rows.withColumn("b", F.array_min(F.transform(F.filter("ds", lambda s: s["l"] != F.col(label)), lambda s: s["d"])))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("silhouette"))


def kmeans(vectors: DataFrame, k: int = 10, seed: int = 42, restarts: int = 10, pca: int = 0, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key, cluster``: the best of several K-means runs; with ``pca`` on that many principal components."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col(column).isNotNull()).select(key, array_to_vector(F.col(column)).alias("features"))
    if pca:
        rows = PCA(k=pca, inputCol="features", outputCol="f").fit(rows).transform(rows).select(key, F.col("f").alias("features"))
    models = [KMeans(k=k, seed=seed + i, maxIter=20).fit(rows) for i in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).select(key, F.col("prediction").alias("cluster"))


def _features(vectors: DataFrame, key: str, column: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return vectors.where(F.col(column).isNotNull()).select(key, array_to_vector(F.col(column)).alias("features"))


def inertia_curve(vectors: DataFrame, ks: list[int], seed: int = 42, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``k, cost, bend``: K-means costs and the distance of each from the line between the ends of the normalised curve."""
    from pyspark.ml.clustering import KMeans

    spark = vectors.sparkSession
    rows = _features(vectors, key, column)
    costs = [(k, float(KMeans(k=k, seed=seed, maxIter=10).fit(rows).summary.trainingCost)) for k in ks]
    lo, hi = min(c for _, c in costs), max(c for _, c in costs)
    span = (hi - lo) or 1.0
    width = (ks[-1] - ks[0]) or 1
    out = [(k, c, abs((k - ks[0]) / width + (c - lo) / span - 1) / 2**0.5) for k, c in costs]
    return spark.createDataFrame(out, "k int, cost double, bend double")


def elbow(curve: list[tuple[int, float]]) -> tuple[int, float]:
    """``(k, confidence)`` of the bend of a cost curve: the point farthest from the line between its ends.

    Two points or fewer give the first with 0.5. The confidence is how much steeper the curve is before the bend than after it, 0.3 if the
    bend is an end of the curve.
    """
    curve = sorted(curve)
    if len(curve) <= 2:
        return curve[0][0], 0.5
    ks, cs = np.array([k for k, _ in curve], float), np.array([c for _, c in curve], float)
    x, y = (ks - ks[0]) / (ks[-1] - ks[0]), (cs - cs.min()) / (np.ptp(cs) or 1.0)
    far = np.abs((x[-1] - x[0]) * (y[0] - y) - (x[0] - x) * (y[-1] - y[0])) / (np.hypot(x[-1] - x[0], y[-1] - y[0]) or 1.0)
    i = int(far.argmax())
    if i in (0, len(curve) - 1):
        return int(ks[i]), 0.3
    before, after = (y[i - 1] - y[i]) / (x[i] - x[i - 1]), (y[i] - y[i + 1]) / (x[i + 1] - x[i])
    return int(ks[i]), float(np.clip(1 - after / before, 0.0, 1.0)) if before > 0 else 0.3


def silhouette_by_k(vectors: DataFrame, ks: list[int], seed: int = 42, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``k, silhouette``: the mean silhouette of K-means for each ``k``, in one pass each (squared distances, as ``silhouettes``)."""
    from pyspark.ml.clustering import KMeans

    rows = _features(vectors, key, column)
    out = []
    for k in ks:
        labels = KMeans(k=k, seed=seed, maxIter=10).fit(rows).transform(rows).select(key, F.col("prediction").alias("label"))
        s = silhouettes(vectors.select(key, column).join(labels, key), "label", key, column).agg(F.sum(F.col("n") * F.col("silhouette")) / F.sum("n")).first()[0]
        out.append((k, float(s or 0.0)))
    return vectors.sparkSession.createDataFrame(out, "k int, silhouette double")


def cluster_report(vectors: DataFrame, ks: list[int], seed: int = 42, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``k, cost, silhouette, is_elbow, is_best, agree``: both ways to choose ``k`` side by side."""
    curve = inertia_curve(vectors, ks, seed, key, column)
    costs = {r.k: r.cost for r in curve.collect()}
    sil = {r.k: r.silhouette for r in silhouette_by_k(vectors, ks, seed, key, column).collect()}
    bend, best = elbow(list(costs.items()))[0], max(sorted(sil), key=sil.get)
    rows = [(k, costs[k], sil[k], k == bend, k == best, bend == best) for k in ks]
    return vectors.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double, is_elbow boolean, is_best boolean, agree boolean")


def exact_silhouettes(vectors: DataFrame, label: str = "label", key: str = "vec_id", column: str = "embedding", block: int = 1024) -> DataFrame:
    """``key, label, a, b, silhouette`` with Euclidean distances, for sets of vectors that all meet all (a review of some ten thousand).

    The mean distance to every cluster needs all pairs; they are made block by block as matrices inside the tasks and only sums by cluster leave
    them. For larger sets use ``silhouettes``. A cluster of one has 0.
    """
    clean = vectors.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("l"), F.col(column).alias("v"))
    n_blocks = max(1, -(-clean.count() // block))
    packed = clean.groupBy(F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("b")).agg(F.collect_list(F.struct("key", "l", "v")).alias("xs"))
    left = packed.select(F.col("b").alias("i"), "xs").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = left.join(packed.select(F.col("b").alias("j"), F.col("xs").alias("ys")), "j")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for xs, ys in zip(frame["xs"], frame["ys"]):
                x, y = np.array([r["v"] for r in xs], float), np.array([r["v"] for r in ys], float)
                d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0))
                d[np.array([r["key"] for r in xs])[:, None] == np.array([r["key"] for r in ys])[None, :]] = 0
                names, place = np.unique([r["l"] for r in ys], return_inverse=True)
                by = np.stack([d[:, place == k].sum(1) for k in range(len(names))], axis=1)
                yield pd.DataFrame({"key": np.repeat([r["key"] for r in xs], len(names)), "l": np.repeat([r["l"] for r in xs], len(names)), "other": np.tile(names, len(xs)), "s": by.ravel(), "c": np.tile(np.bincount(place), len(xs))})

    t = f"key {dict(vectors.dtypes)[key]}, l {dict(vectors.dtypes)[label]}, other {dict(vectors.dtypes)[label]}, s double, c bigint"
    per = pairs.select("xs", "ys").mapInPandas(sums, t).groupBy("key", "l", "other").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    a = F.max(F.when((F.col("l") == F.col("other")) & (F.col("c") > 1), F.col("s") / (F.col("c") - 1)))
    b = F.min(F.when(F.col("l") != F.col("other"), F.col("s") / F.col("c")))
    out = per.groupBy("key", "l").agg(a.alias("a"), b.alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return out.select(F.col("key").alias(key), F.col("l").alias(label), "a", "b", s.alias("silhouette"))


def hierarchy(vectors: DataFrame, top: int = 5, sub: int = 3, seed: int = 42, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key, top_cluster, sub_cluster``: leaves of bisecting K-means, and the ``top`` groups that Ward's rule joins the leaves to.

    The leaves' sizes and centres, ``top * sub`` rows, are joined on the driver, the pair whose union adds least to the squared distances first, so
    every leaf lies in one group.
    """
    from pyspark.ml.clustering import BisectingKMeans

    rows = _features(vectors, key, column)
    model = BisectingKMeans(k=top * sub, seed=seed, predictionCol="leaf").fit(rows)
    leaves = model.transform(rows).select(key, "leaf")
    sizes = {r.leaf: r.n for r in leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    centre = {k: np.array(c) for k, c in enumerate(model.clusterCenters()) if k in sizes}
    groups = {k: ([k], float(sizes[k]), c) for k, c in centre.items()}
    while len(groups) > top:
        pairs = [(g[1] * h[1] / (g[1] + h[1]) * float(((g[2] - h[2]) ** 2).sum()), i, j) for i, g in groups.items() for j, h in groups.items() if i < j]
        _, i, j = min(pairs)
        g, h = groups[i], groups.pop(j)
        groups[i] = (g[0] + h[0], g[1] + h[1], (g[1] * g[2] + h[1] * h[2]) / (g[1] + h[1]))
    of = [(leaf, n) for n, i in enumerate(sorted(groups)) for leaf in groups[i][0]]
    names = vectors.sparkSession.createDataFrame(of, "leaf int, top_cluster int") if of else None
    return leaves.join(F.broadcast(names), "leaf").select(key, "top_cluster", F.col("leaf").alias("sub_cluster")) if names is not None else leaves.select(key, F.col("leaf").alias("top_cluster"), F.col("leaf").alias("sub_cluster"))
