"""A current-state table in hash buckets: a batch rewrites only the buckets it touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.operators.keyed import pick_latest
from tidelens.session import durable_checkpoint, list_paths

BUCKETS = 64  # default; a bucket should fit a task, so size it by the table (about 128 MB each)
KEPT = 2  # commits whose buckets stay readable, for readers that started before the newest one


class StateTable:
    """The latest row per key, kept under ``path`` in any file system that Spark can write.

    ``data/state_version=V/state_bucket=B`` holds the rows of bucket B as batch V left them, and
    ``commits/V`` names the version of every bucket. A commit is written last, by Spark's own job
    commit, so a batch that dies before it leaves the state of the batch before, and its leftovers
    go with the next commit. The number of buckets is fixed by the first batch. Rows with equal keys
    and order: a later batch wins. Null keys are keys like others.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), list(keys), list(order), buckets

    def apply(self, batch: DataFrame, version: int) -> None:
        """Merge a batch; a version that was committed before is passed over."""
        done = self._commits()
        if done and done[-1] >= version:
            return
        held = self._manifest(done[-1]) if done else {}
        buckets = held.pop(-1, self.buckets)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")
        fresh = durable_checkpoint(pick_latest(batch, self.keys, [F.col(c) for c in self.order]).withColumn("state_bucket", bucket))
        touched = [r[0] for r in fresh.select("state_bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        rows = fresh.withColumn("state_age", F.lit(1))
        if known := {b: held[b] for b in touched if b in held}:
            rows = rows.unionByName(self._rows(known).withColumn("state_bucket", bucket).withColumn("state_age", F.lit(0)), allowMissingColumns=True)
        merged = pick_latest(rows.repartition("state_bucket"), ["state_bucket", *self.keys], [F.col(c) for c in [*self.order, "state_age"]])
        merged.drop("state_age").write.mode("overwrite").partitionBy("state_bucket").parquet(f"{self.path}/data/state_version={version}")
        self._commit(version, buckets, held | dict.fromkeys(touched, version))
        self._clean()

    def read(self) -> DataFrame | None:
        """The rows of the newest commit, or nothing yet."""
        done = self._commits()
        if not done:
            return None
        held = self._manifest(done[-1])
        held.pop(-1)
        return self._rows(held)

    def _rows(self, held: dict[int, int]) -> DataFrame:
        paths = [self._folder(v, b) for b, v in held.items()]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def _folder(self, version: int, bucket: int) -> str:
        return f"{self.path}/data/state_version={version}/state_bucket={bucket}"

    def _commit(self, version: int, buckets: int, held: dict[int, int]) -> None:
        rows = self.spark.createDataFrame([(-1, buckets), *held.items()], "bucket int, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{version}")

    def _manifest(self, version: int) -> dict[int, int]:
        """Version by bucket; the number of buckets stands at -1."""
        return {r["bucket"]: r["version"] for r in self.spark.read.parquet(f"{self.path}/commits/{version}").collect()}

    def _commits(self) -> list[int]:
        return sorted(int(p.getParent().getName()) for p in list_paths(self.spark, f"{self.path}/commits/*/_SUCCESS"))

    def _clean(self) -> None:
        """Delete commits before the newest two, and bucket folders that neither of these names."""
        newest = self._commits()[-KEPT:]
        used = {(v, b) for c in newest for b, v in self._manifest(c).items() if b >= 0}
        numbers = {(int(p.getParent().getName().split("=")[1]), int(p.getName().split("=")[1])): p for p in list_paths(self.spark, f"{self.path}/data/*/state_bucket=*")}
        gone = [p for n, p in numbers.items() if n not in used]
        gone += [p for p in list_paths(self.spark, f"{self.path}/data/*") if int(p.getName().split("=")[1]) not in {v for v, _ in used}]
        gone += [p for p in list_paths(self.spark, f"{self.path}/commits/*") if int(p.getName()) not in newest]
        for p in gone:
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
