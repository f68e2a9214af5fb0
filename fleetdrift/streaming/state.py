"""Versioned state tables of a stream, dealt to buckets of their key.

Every micro-batch reads the version the batch before it wrote and writes its own, but only of the buckets that its keys
lie in: the files of all others stay as they are. A version is a small manifest that names, per bucket, the batch whose
files hold it; it is put in place last, in one step. A batch that is run again after a failure reads the same manifest
and replaces its own half-written files, so its effect counts once. What the last version is lies in storage, so a
restart without new input finds it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256  # of a new table; one written with another number keeps it


class VersionedState:
    """``schemas``: columns per table. ``keys``: the column whose hash is the bucket; tables without one are logs."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], keys: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.root, self.schemas, self.keys = spark, root.rstrip("/"), schemas, keys
        written = [self._manifest(t, self.last(t)) for t in keys]
        self.buckets = next((m["buckets"] for m in written if m), buckets)

    # files

    def _hadoop(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        target, files = self._hadoop(path)
        return [entry.getPath().getName() for entry in files.listStatus(target)] if files.exists(target) else []

    def _delete(self, path: str) -> None:
        target, files = self._hadoop(path)
        files.delete(target, True)

    def _folder(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/v{version}"

    def _manifest(self, table: str, version: int) -> dict | None:
        if version < 0:
            return None
        target, files = self._hadoop(f"{self.root}/{table}/manifest/v{version}")
        stream = files.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, table: str, version: int, holds: dict[str, int]) -> None:
        target, files = self._hadoop(f"{self.root}/{table}/manifest/v{version}")
        draft, _ = self._hadoop(f"{self.root}/{table}/manifest/_v{version}")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "holds": holds}).encode()))
        out.close()
        files.delete(target, False)
        files.rename(draft, target)

    def _holds(self, table: str, version: int) -> dict[str, int]:
        manifest = self._manifest(table, version)
        return manifest["holds"] if manifest else {}

    def _versions(self, table: str) -> list[int]:
        """Completely written versions of a table."""
        return sorted(int(n[1:]) for n in self._names(f"{self.root}/{table}/manifest") if n[0] == "v" and n[1:].isdigit())

    def last(self, table: str) -> int:
        """The last version of a table, -1 before the first one."""
        return max(self._versions(table), default=-1)

    def expire(self, last: int, keep: int = 2) -> None:
        """Remove what neither a reader of the last version nor a batch that is run again can ask for."""
        for table in self.keys:
            versions = self._versions(table)
            needed = {(v, b) for kept in versions if kept > last - keep for b, v in self._holds(table, kept).items()}
            for version in versions:
                if version <= last - keep:
                    self._delete(f"{self.root}/{table}/manifest/v{version}")
            for name in self._names(f"{self.root}/{table}"):
                if name[0] != "v" or int(name[1:]) > last:
                    continue
                held = [n.removeprefix("bucket=") for n in self._names(f"{self.root}/{table}/{name}") if n.startswith("bucket=")]
                stale = [b for b in held if (int(name[1:]), b) not in needed]
                if len(stale) == len(held):
                    self._delete(f"{self.root}/{table}/{name}")
                    continue
                for bucket in stale:
                    self._delete(f"{self.root}/{table}/{name}/bucket={bucket}")

    # rows

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(self.keys[table]), F.lit(self.buckets)).cast("int")

    def touched(self, table: str, rows: DataFrame) -> list[int]:
        """The buckets that the keys of ``rows`` lie in: never more than there are buckets."""
        return sorted(r["bucket"] for r in rows.select(self._bucket(table).alias("bucket")).distinct().collect())

    def read(self, table: str, version: int, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some buckets of it, as of a version; empty before the first one."""
        holds = self._holds(table, version)
        wanted = holds if buckets is None else [str(b) for b in buckets if str(b) in holds]
        paths = [f"{self._folder(table, holds[b])}/bucket={b}" for b in wanted]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*paths)

    def write(self, table: str, version: int, rows: DataFrame, touched: list[int]) -> None:
        """Version ``version``: ``rows`` in the touched buckets, all others as in the version before.

        ``rows`` are all that the touched buckets hold from now on. A bucket with a hot key is written by several
        tasks.
        """
        folder = self._folder(table, version)
        names = [f.name for f in self.spark.createDataFrame([], self.schemas[table]).schema]
        holds = {b: v for b, v in self._holds(table, version - 1).items() if int(b) not in set(touched)}
        if touched:
            dealt = rows.select(*names, self._bucket(table).alias("bucket")).filter(F.col("bucket").isin(touched))
            dealt.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
            holds.update({n.removeprefix("bucket="): version for n in self._names(folder) if n.startswith("bucket=")})
        self._commit(table, version, holds)

    def append(self, table: str, version: int, rows: DataFrame) -> None:
        """Logs keep one folder per batch; reading them all gives the whole log."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={version}")

    def log(self, table: str) -> DataFrame:
        rows = self.spark.read.schema(self.schemas[table]).parquet(f"{self.root}/{table}")
        return rows.drop("batch")


def run_available(stream: DataFrame, handle, checkpoint: str) -> None:
    """Drive a stream over all available input."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
