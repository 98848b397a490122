"""k-means by cosine distance with a reproducible start, and features found with it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MAX_ROUNDS, LEAST_MOVE = 50, 1e-6
#: Rows up to which the first centroids are drawn from all; above, from those of least hash.
START_ROWS = 20_000


def djb2(text: str) -> int:
    h = 5381
    for c in text:
        h = (h * 33 + ord(c)) & 0xFFFFFFFF
    return h


class Xorshift:
    """32-bit xorshift; numbers in [0, 1)."""

    def __init__(self, seed: int):
        self.s = seed & 0xFFFFFFFF or 1

    def __call__(self) -> float:
        s = self.s
        s ^= s << 13 & 0xFFFFFFFF
        s ^= s >> 17
        s ^= s << 5 & 0xFFFFFFFF
        self.s = s
        return s / 2**32


def cluster_count(n: int) -> int:
    return min(30, max(3, math.ceil(math.sqrt(n / 2))))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def first_centroids(ids: list[str], vectors: np.ndarray, k: int) -> np.ndarray:
    """k-means++ by cosine distance, seeded by the sorted ids."""
    order = np.argsort(np.array(ids, dtype=object), kind="stable")
    m, rng = vectors[order], Xorshift(djb2(",".join(sorted(ids))))
    unit = _unit(m)
    chosen = [int(rng() * len(m))]
    d = np.full(len(m), np.inf)
    while len(chosen) < k:
        d = np.minimum(d, (1 - unit @ unit[chosen[-1]]).clip(0) ** 2)
        total = d.sum()
        if total == 0:
            rest = [i for i in range(len(m)) if i not in set(chosen)]
            chosen.append(rest[0])
            continue
        chosen.append(int(min(np.searchsorted(np.cumsum(d), rng() * total, side="right"), len(m) - 1)))
    return m[chosen].astype(float)


def assign(vectors: DataFrame, centroids: np.ndarray, vec_id: str = "id") -> DataFrame:
    """(id, cluster, embedding): the nearest centroid by cosine distance, ties to the lowest."""
    c = _unit(centroids)
    kind = vectors.schema[vec_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            if len(b):
                x = _unit(np.stack(b["embedding"].to_numpy()).astype(float))
                yield pd.DataFrame({vec_id: b[vec_id], "cluster": np.argmax((x @ c.T).round(12), axis=1).astype("int32"), "embedding": b["embedding"]})

    return vectors.select(vec_id, "embedding").mapInPandas(run, f"{vec_id} {kind}, cluster int, embedding array<float>")


def centroid_means(assigned: DataFrame) -> DataFrame:
    """(cluster, mean): the mean of each part, pre-aggregated before the shuffle."""
    parts = assigned.select("cluster", F.posexplode("embedding").alias("pos", "x"))
    mean = parts.groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))


def _sums(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of vectors and number of rows of each cluster; a row per task and cluster is sent."""
    c = _unit(centroids)

    def run(batches):
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), int)
        for b in batches:
            if len(b):
                m = np.stack(b["embedding"].to_numpy()).astype(float)
                at = np.argmax((_unit(m) @ c.T).round(12), axis=1)
                np.add.at(total, at, m)
                n += np.bincount(at, minlength=len(centroids))
        yield pd.DataFrame({"cluster": np.repeat(np.arange(len(n)), total.shape[1]), "pos": np.tile(np.arange(total.shape[1]), len(n)), "s": total.ravel(), "n": np.repeat(n, total.shape[1])})

    part = vectors.select("embedding").mapInPandas(run, "cluster int, pos int, s double, n long")
    rows = part.groupBy("cluster", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas()
    total, n = np.zeros_like(centroids), np.zeros(len(centroids), int)
    total[rows["cluster"], rows["pos"]] = rows["s"]
    n[rows["cluster"]] = rows["n"]
    return total, n


def kmeans(vectors: DataFrame, k: int | None = None, vec_id: str = "id") -> DataFrame:
    """(id, cluster).  With no more rows than clusters, each row is its own cluster."""
    n = vectors.count()
    k = k or cluster_count(n)
    own = vectors.select(F.col(vec_id).alias("id"), "embedding")
    if n <= k:
        ids = sorted((r.id for r in own.select("id").collect()), key=str)
        return vectors.sparkSession.createDataFrame([(i, j) for j, i in enumerate(ids)], f"id {own.schema['id'].dataType.simpleString()}, cluster int")
    some = own.orderBy(F.xxhash64("id"), "id").limit(START_ROWS) if n > START_ROWS else own
    rows = some.collect()
    c = first_centroids([str(r.id) for r in rows], np.array([r.embedding for r in rows], float), k)
    for _ in range(MAX_ROUNDS):
        total, count = _sums(own, c)
        new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        moved = np.abs(new - c).max()
        c = new
        if moved <= LEAST_MOVE:
            break
    return assign(own, c).select("id", "cluster")


def features(clusters: DataFrame) -> DataFrame:
    """(id, name, description, files, digest) of clusters, with the names given without a model."""
    rows = clusters.groupBy("cluster").agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("files"))
    n = F.size("files")
    return rows.select(
        F.concat(F.lit("cluster-"), F.col("cluster").cast("string")).alias("id"),
        F.concat(F.lit("Feature "), (F.col("cluster") + 1).cast("string")).alias("name"),
        F.concat(F.lit("Cross-cutting feature involving "), n.cast("string"), F.lit(" files")).alias("description"),
        "files",
        T.set_digest(F.col("files")).alias("digest"),
    )


def overlaps(members: DataFrame) -> DataFrame:
    """(id, related): groups that share a member.  members: id, member.

    Pairs are made within a member's groups only; a member of very many groups makes many.
    """
    other = members.select(F.col("id").alias("related"), "member")
    return members.join(other, "member").where("id != related").select("id", "related").distinct()


def named(answer: Column, index: Column, n_files: Column) -> Column:
    """struct(name, description) from a model's answer, with fallbacks for what it lacks."""
    v = T.lenient_object(answer)
    said = lambda key: F.nullif(F.try_variant_get(v, f"$.{key}", "string"), F.lit(""))
    return F.struct(
        F.coalesce(said("name"), F.concat(F.lit("Feature "), (index + 1).cast("string"))).alias("name"),
        F.coalesce(said("description"), F.concat(F.lit("Cross-cutting feature involving "), n_files.cast("string"), F.lit(" files"))).alias("description"),
    )
