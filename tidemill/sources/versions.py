"""Immutable dataset versions: one Parquet folder per version and an append-only index."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

INDEX_SCHEMA = (
    "id string, dataset_name string, version_note string, owner string, row_count long, "
    "column_count int, columns array<string>, path string, created_at timestamp"
)
LISTED = 50


class VersionStore:
    """Versions below ``root``, a folder every executor can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.index = f"{self.root}/_index"

    def save(self, name: str, df: DataFrame, note: str = "", owner: str = "") -> str:
        """Write a snapshot and its index row; rows are counted by the write itself."""
        version = uuid.uuid4().hex
        path = f"{self.root}/data/v={version}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        created = datetime.now(timezone.utc).replace(tzinfo=None)
        row = (version, name, note, owner, seen.get["rows"], len(df.columns), df.columns, path, created)
        entry = self.spark.createDataFrame([row], INDEX_SCHEMA)
        entry.coalesce(1).write.mode("append").parquet(self.index)
        return version

    def _entries(self) -> DataFrame:
        return self.spark.read.schema(INDEX_SCHEMA).parquet(self.index)

    def versions(self, name: str | None = None, limit: int = LISTED) -> DataFrame:
        """Newest first, optionally of one dataset."""
        entries = self._entries()
        if name:
            entries = entries.where(F.col("dataset_name") == name)
        return entries.orderBy(F.desc("created_at"), "id").limit(limit)

    def datasets(self, owner: str | None = None, admin: bool = False) -> DataFrame:
        """All saved datasets newest first; other owners' are visible to an admin only."""
        entries = self._entries()
        if not admin:
            entries = entries.where(F.col("owner") == (owner or ""))
        return entries.orderBy(F.desc("created_at"), "id")

    def restore(self, version: str) -> DataFrame:
        """The snapshot with its types."""
        row = self._entries().where(F.col("id") == version).select("path").first()
        if row is None:
            raise KeyError("Version not found.")
        return self.spark.read.parquet(row["path"])
