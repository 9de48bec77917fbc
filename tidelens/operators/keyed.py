"""Latest-per-key reads, upserts and other keyed table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelens.session import durable_checkpoint


def latest(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """WIN-01: every row whose time equals its key's maximum, ties kept.

    A map-side combined maximum is joined back instead of a window: a key that holds most of the
    rows is then one row per map task in the shuffle, and the join back is a broadcast (by
    Catalyst's own size check) or a skew-split sort-merge join.
    """
    if not keys:
        return df.where(F.col(ts) == df.agg(F.max(ts)).scalar())
    top = df.groupBy(*keys).agg(F.max(ts).alias(ts))
    return df.join(top, [*keys, ts])


def pick_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the smallest by ``order``; partial aggregation, no per-key sort."""
    value = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def pick_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the largest by ``order``."""
    value = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """WIN-09: first ``n`` rows per key.

    The filter on the rank lets Catalyst cut each map task to ``n`` rows per key before the shuffle
    (a window group limit), so a hot key does not reach one task whole.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """SNK-03: new rows replace old ones on the key; the last new row per key by ``order`` wins, without
    an order the largest by its other columns.

    Only the incoming side is reduced (partial aggregation); the current table loses its replaced
    keys through one anti join and is otherwise passed through untouched.
    """
    by = list(order) or [c for c in incoming.columns if c not in keys]
    fresh = pick_latest(incoming, keys, [F.col(c) for c in by]) if by else incoming.distinct()
    kept = current.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def insert_missing(current: DataFrame, incoming: DataFrame, name: str, id_col: str) -> DataFrame:
    """SNK-04: add rows whose name is absent, with ids after the highest one.

    Ids come from a sort by name whose per-partition counts are turned into offsets, so no row
    passes through a single task.
    """
    new = incoming.join(current.select(name), name, "left_anti").dropDuplicates([name])
    top = current.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint")).scalar()
    numbered = dense_number(new, [F.col(name)], "_n")
    return current.unionByName(
        numbered.withColumn(id_col, (top + F.col("_n")).cast(current.schema[id_col].dataType)).drop("_n"),
        allowMissingColumns=True)


def dense_number(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """1-based number in a global order without a single-task window.

    Rows are range-partitioned, numbered inside their partition, and shifted by the row counts of
    the earlier partitions (one small row per partition). The partition numbers are pinned by a
    durable checkpoint, because the range bounds come from a sample and would differ if read twice.
    """
    ranged = durable_checkpoint(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    local = ranged.withColumn("_rn", F.row_number().over(W.partitionBy("_pid").orderBy(*order)))
    sizes = ranged.groupBy("_pid").count()
    offsets = sizes.withColumn("_off", F.coalesce(
        F.sum("count").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return local.join(offsets, "_pid").withColumn(out, F.col("_rn") + F.col("_off")).drop("_pid", "_rn", "_off")


def update_column(current: DataFrame, changes: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """SNK-05: set one column where a change exists, keep the old value elsewhere."""
    new = changes.select(*keys, F.col(column).alias("_new"))
    return (current.join(new, list(keys), "left")
            .withColumn(column, F.coalesce("_new", column)).drop("_new"))


def apply_changes(current: DataFrame, log: DataFrame, keys: Sequence[str], delete_key: str,
                  seq: str = "seq", op: str = "op") -> DataFrame:
    """SNK-06: apply a change log of upserts (by key) and deletes (by one column of the key).

    The latest change per key wins; a delete removes every row of its ``delete_key`` written before
    it. One anti join and one reduction, no ordering of the log.
    """
    deletes = (log.where(F.col(op) == "delete").groupBy(delete_key).agg(F.max(seq).alias("_gone")))
    ups = log.where(F.col(op) == "upsert")
    fresh = pick_latest(ups, keys, [F.col(seq)]).drop(op)
    alive = fresh.join(deletes, delete_key, "left").where(F.col("_gone").isNull() | (F.col(seq) > F.col("_gone")))
    touched = fresh.select(*keys)
    kept = current.join(deletes.select(delete_key), delete_key, "left_anti").join(touched, list(keys), "left_anti")
    return kept.unionByName(alive.drop("_gone", seq), allowMissingColumns=True)


def overlay(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SET-06: entries of ``new`` win over entries of ``old``."""
    return upsert(old, new, keys)


def union_keys(*frames: DataFrame) -> DataFrame:
    """SET-02: distinct keys of several one-column frames."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def dangling(referenced: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """JON-25 / SET-04: keys referenced but not stored, and stored but not referenced."""
    a, b = referenced.select(key).distinct(), stored.select(key).distinct()
    left = a.join(b, key, "left_anti").withColumn("problem", F.lit("dangling reference"))
    right = b.join(a, key, "left_anti").withColumn("problem", F.lit("not referenced"))
    return left.unionByName(right)


def select_known(df: DataFrame, wanted: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """PRJ-28: (rows with a wanted name, wanted names that do not exist)."""
    return df.join(wanted, name, "left_semi"), wanted.join(df, name, "left_anti")
