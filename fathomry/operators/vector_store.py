"""Vectors as Parquet tables by scope, with real upserts and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import Store
from ..schemas import VECTORS
from . import retrieval
from .incremental import merge

SCOPES = ("files", "symbols", "features")


class VectorStore:
    """Rows (id, scope, embedding, metadata); each write is a new generation.

    The store's other tables aren't touched, so give it a folder of its own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path)

    def all(self, scope: str | None = None) -> DataFrame:
        rows = self.store.table("vectors")
        return rows if scope is None else rows.where(F.col("scope") == scope)

    def upsert(self, rows: DataFrame) -> int:
        """Put rows in by (id, scope), in place of those that are there; the last of repeated ones wins by embedding."""
        new = rows.select(*VECTORS.fieldNames()).groupBy("id", "scope").agg(F.max(F.struct("embedding", F.map_entries("metadata").alias("m"))).alias("r"))
        new = new.select("id", "scope", "r.embedding", F.map_from_entries("r.m").alias("metadata"))
        return self.store.publish({"vectors": merge(self.all(), new, ["id", "scope"])})

    def remove(self, ids: DataFrame) -> int:
        return self.store.publish({"vectors": self.all().join(ids.select("id").distinct(), "id", "left_anti")})

    def search(self, scope: str, query: list[float], k: int) -> DataFrame:
        """(id, distance, score, metadata): nearest rows of a scope."""
        if scope not in SCOPES:
            raise ValueError(f"scope must be one of {', '.join(SCOPES)}")
        near = retrieval.knn(self.all(scope), query, k, vec_id="id")
        meta = self.all(scope).select("id", "metadata")
        return F.broadcast(near).join(meta, "id").orderBy("distance", "id")  # k rows

    def describe(self) -> DataFrame:
        """(scope, n, dimensions)."""
        return self.all().groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dimensions"))
