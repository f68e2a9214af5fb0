"""Finding lifecycle over scans as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import lifecycle
from .state import BUCKETS, VersionedState, run_available

STATE = {
    "findings": "repo string, finding string, first_seen string, last_seen string, status string",
    "scans": "repo string, scan string",
    "deltas": "repo string, finding string, scan string, event string",
}


def read_scans(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """One row per finding of a scan; a scan that found nothing is one row without finding."""
    return spark.readStream.schema(schemas.SCAN_FEED).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def batch_deltas(stored: DataFrame, known: DataFrame, scans: DataFrame, found: DataFrame) -> DataFrame:
    """Events of the scans of one batch: the batch alone, preceded by what was open before it.

    The stored open findings stand for one earlier scan, so the first scan of the batch has something to differ
    from; findings fixed before count as returned, not as added. Dismissed findings are no news in either sense.
    """
    keys = ["repo", "finding"]
    earlier = known.select("repo").distinct().withColumn("scan", F.lit(""))
    was_open = stored.filter("status = 'open'").select(*keys).join(earlier, "repo")
    all_scans = scans.select("repo", "scan").unionByName(earlier.join(scans.select("repo").distinct(), "repo", "left_semi"))
    events = lifecycle.scan_deltas(found.select("repo", "scan", "finding").unionByName(was_open.select("repo", "scan", "finding")), all_scans)
    fixed = stored.filter("status = 'fixed'").select(*keys).withColumn("was_fixed", F.lit(True))
    event = F.when((F.col("event") == "added") & F.col("was_fixed"), "returned").otherwise(F.col("event"))
    events = events.join(stored.filter("status = 'dismissed'").select(*keys), keys, "left_anti")
    return events.join(fixed, keys, "left").select("repo", "finding", "scan", event.alias("event"))


class ScanStream:
    """Findings and scans by repository; a batch reads and rewrites the buckets of the repositories it scans."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.state = VersionedState(spark, f"{root}/state", STATE, {"findings": "repo", "scans": "repo"}, buckets)
        self.checkpoint = f"{root}/checkpoint"
        self.last = self.state.last("findings")

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            scans = rows.select("repo", "scan").distinct()
            found = rows.filter("finding IS NOT NULL")
            touched = self.state.touched("scans", scans)
            stored, known = (self.state.read(table, batch_id - 1, touched) for table in ("findings", "scans"))
            self.state.write("findings", batch_id, lifecycle.apply_scans(stored, scans, found), touched)
            self.state.write("scans", batch_id, known.unionByName(scans).distinct(), touched)
            self.state.append("deltas", batch_id, batch_deltas(stored, known, scans, found))
        finally:
            rows.unpersist()

    def run(self, stream: DataFrame) -> "ScanStream":
        run_available(stream, self.handle, self.checkpoint)
        self.last = self.state.last("findings")
        self.state.expire(self.last)
        return self
