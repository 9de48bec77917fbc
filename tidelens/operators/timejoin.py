"""As-of joins, nearest picks and folds over run times."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions.dates import local_day, local_day_end
from tidelens.functions.risk import level_to_int
from tidelens.operators.keyed import dense_number
from tidelens.session import durable_checkpoint


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
              tolerance_h: float, how: str = "inner") -> DataFrame:
    """JON-06 / 08 / 09: rows of ``right`` at the time nearest to ``left_time``, within a tolerance;
    the earlier time on ties.

    The search runs on distinct times only. Times of both sides meet in buckets one tolerance wide
    (right times are repeated into the two neighbours), where a window finds the last time before
    and the first time after. A (key, bucket) holds at most the distinct times of three tolerances,
    whatever the number of rows. The result is then an equi-join on (key, time).
    """
    keys = list(keys)
    tol = int(tolerance_h * 3600 * 1_000_000)
    micros = lambda c: F.unix_micros(F.col(c))
    lt = left.select(*keys, micros(left_time).alias("_t")).distinct().withColumn("_side", F.lit(1))
    rt = right.select(*keys, micros(right_time).alias("_t")).distinct().withColumn("_side", F.lit(0))
    bucket = F.floor(F.col("_t") / tol)
    lt = lt.withColumn("_b", bucket)
    rt = rt.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    both = lt.unionByName(rt)
    w = W.partitionBy(*keys, "_b")
    seen = F.when(F.col("_side") == 0, F.col("_t"))
    # both run forward over their own order: a frame that reaches to the end is summed anew for every row
    before = F.last(seen, True).over(w.orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0))
    after = F.last(seen, True).over(w.orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("_p", before).withColumn("_q", after).where(F.col("_side") == 1)
    gap_p, gap_q = F.col("_t") - F.col("_p"), F.col("_q") - F.col("_t")
    pick = F.when(gap_q.isNull() | (gap_p <= gap_q), F.col("_p")).otherwise(F.col("_q"))
    found = (found.withColumn("_m", pick).where(F.abs(F.col("_t") - F.col("_m")) <= tol)
             .select(*keys, "_t", "_m"))
    l2 = left.withColumn("_t", micros(left_time))
    r2 = right.withColumn("_m", micros(right_time))
    matched = l2.join(found, [*keys, "_t"], how)
    return matched.join(r2, [*keys, "_m"], how).drop("_t", "_m")


def nearest_in_array(array: Column, value: Column, target: Column) -> Column:
    """JON-07: array element whose ``value`` field is closest to the target; first on ties."""
    scored = F.transform(array, lambda x, i: F.struct(F.abs(value(x) - target).alias("g"), i.alias("i"), x.alias("x")))
    return F.array_min(F.transform(scored, lambda s: F.struct(s["g"], s["i"])))["i"]


def element_nearest(array: Column, field: str, target: Column) -> Column:
    """JON-07: the element itself."""
    return F.get(array, nearest_in_array(array, lambda x: x[field], target))


def nearest_row(df: DataFrame, keys: Sequence[str], value: Column, order: Sequence[Column]) -> DataFrame:
    """JON-07 / JON-10 over rows: per key the row with the smallest |value|; ties by ``order``."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return (df.groupBy(*keys).agg(F.min_by(row, F.struct(F.abs(value), *order)).alias("_r")).select("_r.*"))


def issued_in_time(rows: DataFrame, ident: str, order: str) -> DataFrame:
    """JON-19: level per (ident, local day, horizon, version) of the latest run issued before that
    day ended; the first row read on equal run times.

    The horizons are exploded and reduced with a map-side maximum; there is no window.
    """
    version = F.coalesce(F.col("model_version"), F.lit(S.LEGACY_VERSION))
    h = (rows.select(ident, "run_at", order, version.alias("model_version"), F.explode("horizons").alias("h"))
         .where(F.col("h.valid_at").isNotNull())
         .withColumn("day", local_day(F.col("h.valid_at")))
         .where(F.col("run_at") <= local_day_end(F.col("day"))))
    rank = F.struct(F.col("run_at"), -F.col(order))
    return (h.groupBy(ident, "day", F.col("h.horizon_hours").alias("horizon_hours"), "model_version")
            .agg(F.max_by(level_to_int(F.col("h.risk_level")), rank).alias("pred")))


def next_times(times: DataFrame, keys: Sequence[str], wait: int) -> DataFrame:
    """(keys.., t, nxt): for each distinct integer time the first time of its key at least ``wait`` later, or null.

    Times and the times they look for (t + wait) are ranged together by (keys, time), and each partition is read once
    backwards. What a partition cannot answer is the first time of the next partition that holds
    any: one row per partition. So a key of any size is spread over all tasks, without buckets.
    """
    keys = list(keys)
    own = times.select(*keys, F.col("t").alias("at"), F.lit(1).alias("_is"), F.col("t"))
    sought = times.select(*keys, (F.col("t") + wait).alias("at"), F.lit(0).alias("_is"), F.col("t"))
    both = own.unionByName(sought).repartitionByRange(*keys, "at").withColumn("_pid", F.spark_partition_id())
    both = durable_checkpoint(both)  # the bounds come from a sample: read twice, they could differ
    found = F.struct(*keys, "t")
    back = W.partitionBy("_pid").orderBy(*[F.col(c).desc() for c in [*keys, "at", "_is"]])
    here = F.last(F.when(F.col("_is") == 1, found), True).over(back.rowsBetween(W.unboundedPreceding, 0))
    heads = both.groupBy("_pid").agg(F.min(F.when(F.col("_is") == 1, found)).alias("_head"))
    later = F.last("_head", True).over(W.orderBy(F.desc("_pid")).rowsBetween(W.unboundedPreceding, -1))
    heads = heads.select("_pid", later.alias("_later"))
    seen = both.withColumn("_here", here).where("_is = 0").join(heads, "_pid").withColumn("_f", F.coalesce("_here", "_later"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_f.{k}").eqNullSafe(F.col(k))
    return seen.select(*keys, "t", F.when(same, F.col("_f.t")).alias("nxt"))


def chain(times: DataFrame, keys: Sequence[str], wait: int) -> DataFrame:
    """(keys.., t) of the times kept when, after a kept time, the next one is the first at least ``wait`` later.

    Each key's first time is kept. Pointers to the next allowed time are doubled round by round: after n rounds the
    first 2^n kept times of every key are marked, so rounds grow with the logarithm of the longest
    chain. Each round is cut by a durable checkpoint.
    """
    keys = list(keys)
    times = durable_checkpoint(times.select(*keys, "t").distinct())
    jump = durable_checkpoint(next_times(times, keys, wait).where("nxt is not null"))
    kept = times.groupBy(*keys).agg(F.min("t").alias("t")).where("t is not null")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    while True:
        more = (kept.alias("a").join(jump.alias("b"), [*same("a", "b"), F.col("a.t") == F.col("b.t")])
                .select(*[F.col(f"a.{k}") for k in keys], F.col("b.nxt").alias("t"), F.lit(True).alias("_new")))
        kept = durable_checkpoint(kept.withColumn("_new", F.lit(False)).unionByName(more))
        if kept.where("_new").isEmpty():
            return kept.drop("_new")
        kept = kept.drop("_new")
        jump = durable_checkpoint(jump.alias("a").join(jump.alias("b"), [*same("a", "b"), F.col("a.nxt") == F.col("b.t")])
                                  .select(*[F.col(f"a.{k}") for k in keys], F.col("a.t"), F.col("b.nxt")))


def thin_runs(runs: DataFrame, ts: str, every_hours: float) -> DataFrame:
    """WIN-07: run times (whole seconds) kept when at least ``every_hours`` (1 s slack) after the last kept one."""
    times = runs.select(F.unix_seconds(F.col(ts)).alias("t")).where("t is not null")
    return chain(times, [], math.ceil(every_hours * 3600 - 1)).select(F.timestamp_seconds("t").alias(ts))


def chunk_runs(runs: DataFrame, ts: str, days: float = 10.0) -> DataFrame:
    """WIN-08: (run time in whole seconds, group number): a group spans at most ``days`` from its first run.

    A group starts at the first run more than ``days`` after the start of the one before. The runs of a group
    meet its start in buckets one span wide, of which a group touches at most two.
    """
    span = math.floor(days * 86400)
    times = runs.select(F.unix_seconds(F.col(ts)).alias("t")).where("t is not null").distinct()
    starts = dense_number(chain(times, [], span + 1).withColumnRenamed("t", "_s"), [F.col("_s")], "group_no")
    bucket = F.floor(F.col("_s") / (span + 1))
    starts = starts.withColumn("_b", F.explode(F.array(bucket, bucket + 1)))
    runs_of = times.withColumn("_b", F.floor(F.col("t") / (span + 1))).join(starts, "_b")
    runs_of = runs_of.where(F.col("t").between(F.col("_s"), F.col("_s") + span))
    return runs_of.select(F.timestamp_seconds("t").alias(ts), F.col("group_no").cast("int").alias("group_no"))


def time_blocks(rows: DataFrame, ts: str, n: int) -> DataFrame:
    """WIN-12: equal consecutive blocks of the distinct run times; (block, start, end, runs).

    Run times are numbered by ranges and their counts; earlier blocks take what does not divide evenly.
    """
    numbered = dense_number(rows.select(ts).where(F.col(ts).isNotNull()).distinct(), [F.col(ts)], "_no")
    total = numbered.agg(F.count("*")).scalar()
    size, extra = F.floor(total / n), total % n
    wide = extra * (size + 1)
    block = F.when(F.col("_no") <= wide, F.ceil(F.col("_no") / (size + 1))).otherwise(
        extra + F.ceil((F.col("_no") - wide) / F.greatest(size, F.lit(1))))
    return (numbered.groupBy(block.cast("int").alias("block"))
            .agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("runs")))


def purged_split(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """JON-26: rows tagged (block, part): train when the label time is before the block, test when
    the run is inside it. Blocks are a handful, so each row expands to the blocks it belongs to."""
    from tidelens.operators.spatial import carry

    b = blocks.where("block > 1").select("block", "start", "end")
    tagged = carry(rows, b, b.columns, "_blocks").withColumn("_b", F.explode("_blocks")).drop("_blocks")
    part = (F.when(F.col("run_ts").between(F.col("_b.start"), F.col("_b.end")), "test")
            .when(F.col("target_ts") < F.col("_b.start"), "train"))
    return (tagged.withColumn("part", part).where(F.col("part").isNotNull())
            .withColumn("block", F.col("_b.block")).drop("_b"))
