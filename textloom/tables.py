"""Tables as versioned Parquet folders with a pointer to the current version.

A change writes a whole new version beside the old one and then moves the
pointer, so that readers see one version or the other and a failed job leaves
the old one.  One writer at a time for each table.
"""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str] | None = None):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys or ["id"]
        self._fs, self._at = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def version(self) -> str | None:
        """The current version, or None before the first write."""
        try:
            with self._fs.open_input_stream(f"{self._at}/_CURRENT") as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def read(self) -> DataFrame:
        """Rows of the current version; columns that an older version lacks are null."""
        v = self.version()
        if v is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{v}")

    def _commit(self, version: str) -> None:
        self._fs.create_dir(self._at, recursive=True)
        with self._fs.open_output_stream(f"{self._at}/_CURRENT.tmp") as f:
            f.write(version.encode())
        self._fs.move(f"{self._at}/_CURRENT.tmp", f"{self._at}/_CURRENT")

    def replace(self, rows: DataFrame) -> DataFrame:
        """All rows anew."""
        version = f"v-{uuid.uuid4().hex}"
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        have = set(rows.columns)
        types = dict(self.spark.createDataFrame([], self.schema).dtypes)
        rows.select(*[(F.col(n) if n in have else F.lit(None)).cast(types[n]).alias(n) for n in names]).write.parquet(f"{self.path}/{version}")
        self._commit(version)
        return self.read()

    def append(self, rows: DataFrame) -> DataFrame:
        return self.replace(self.read().unionByName(rows, allowMissingColumns=True))

    def upsert(self, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """Rows by key: those that are there are replaced."""
        keys = keys or self.keys
        return self.replace(self.read().join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True))

    def insert_absent(self, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """Only rows whose key isn't there."""
        keys = keys or self.keys
        return self.append(rows.join(self.read().select(*keys), keys, "left_anti"))

    def delete(self, where: Column) -> DataFrame:
        """Without the rows for which the condition is true (null keeps a row)."""
        return self.replace(self.read().where(~F.coalesce(where, F.lit(False))))

    def replace_of(self, owners: DataFrame, owner: str, rows: DataFrame) -> DataFrame:
        """All rows of some owners anew: what they had goes, also where nothing comes."""
        return self.replace(self.read().join(owners.select(owner).distinct(), owner, "left_anti").unionByName(rows, allowMissingColumns=True))

    def patch(self, rows: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
        """Values of ``rows`` that aren't null over those that are there."""
        keys = keys or self.keys
        new = rows.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
        joined = self.read().join(new, keys, "left")
        return self.replace(joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*(f"__{c}" for c in columns)))
