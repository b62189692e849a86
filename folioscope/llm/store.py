"""Tables that grow batch by batch and are never rewritten, in a folder that can be opened again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import drop_path, tidy


class BatchStore:
    """``path/table/batch=N`` holds a batch's part of a table; the batch counts from its mark in ``path/accepted`` on.

    Parts of a batch that was interrupted have no mark: they aren't read and are overwritten.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        marks = self._at("accepted")
        self.batches: list[int] = sorted(int(f.getPath().getName()) for f in self._fs.listStatus(marks)) if self._fs.exists(marks) else []

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    @property
    def open(self) -> int:
        """The number of the batch that is being written."""
        return self.batches[-1] + 1 if self.batches else 0

    def write(self, name: str, part: DataFrame) -> None:
        part.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={self.open:06d}")

    def _read(self, name: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}/batch={n:06d}" for n in batches))

    def batch(self, name: str, schema: str) -> DataFrame:
        """The open batch's part, once written."""
        return self._read(name, schema, [self.open])

    def before(self, name: str, schema: str) -> DataFrame:
        """What earlier batches hold."""
        return self._read(name, schema, self.batches)

    def all(self, name: str, schema: str) -> DataFrame:
        """Earlier batches and, if it is written, the open one."""
        mine = [self.open] if self._fs.exists(self._at(f"{name}/batch={self.open:06d}/_SUCCESS")) else []
        return self._read(name, schema, [*self.batches, *mine])

    def close(self) -> None:
        self._fs.create(self._at(f"accepted/{self.open:06d}")).close()
        self.batches.append(self.open)
        tidy(self.spark)

    def drop(self) -> None:
        drop_path(self.spark, self.path)
