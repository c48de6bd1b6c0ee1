"""Writes that check themselves: one pass gives the table, the rows that break a rule and the numbers of both."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from equilens.sinks.tables import _fs, _versions, remove

REASON = "_reason"
DUPLICATE = "duplicate"


def judged(
    df: DataFrame, pk: Sequence[str], rules: Mapping[str, Column], known: Mapping[str, tuple[str, DataFrame]] | None = None,
    order: Sequence[str | Column] = (),
) -> DataFrame:
    """``df`` with ``_reason``: the first rule that a row breaks, null for a good row.

    A rule is a condition that must be true, null breaks it. ``known`` gives rules of reference: a column whose values
    must be in the one column of another frame (no null). Of good rows with equal keys the first by ``order`` is
    good and the others are ``duplicate``. A key may not hold more rows than a task can sort.
    """
    reason = F.lit(None).cast("string")
    out = df
    for name, (column, frame) in reversed(list((known or {}).items())):
        target = frame.select(F.col(frame.columns[0]).alias(f"_k_{name}")).distinct()
        out = out.join(target, F.col(column) == F.col(f"_k_{name}"), "left")
        reason = F.when(F.col(f"_k_{name}").isNull(), name).otherwise(reason)
    for name, rule in reversed(list(rules.items())):
        reason = F.when(~F.coalesce(rule, F.lit(False)), name).otherwise(reason)
    out = out.withColumn(REASON, reason).select(*df.columns, REASON)
    place = F.row_number().over(Window.partitionBy(*pk, F.col(REASON).isNull()).orderBy(*(order or [F.xxhash64(*df.columns)])))
    return out.withColumn("_nth", place).withColumn(
        REASON, F.when(F.col(REASON).isNull() & (F.col("_nth") > 1), DUPLICATE).otherwise(F.col(REASON))).drop("_nth")


def checked_write(
    df: DataFrame, path: str, pk: Sequence[str], rules: Mapping[str, Column], known: Mapping[str, tuple[str, DataFrame]] | None = None,
    order: Sequence[str | Column] = (), fatal: Sequence[str] = (),
) -> dict[str, int]:
    """Write the good rows of ``df`` as the next version of the small table at ``path`` and the others beside it.

    Returns the numbers that were counted while writing: ``rows``, ``good``, one per rule, ``duplicate``, and
    ``version``, 0 if a ``fatal`` rule was broken. Then readers keep the version they had. Rows that break a rule are
    kept with it in ``quarantine(path)`` either way. ``df`` is read once.
    """
    spark = df.sparkSession
    names = [*rules, *(known or {}), DUPLICATE]
    seen = Observation()
    told = judged(df, pk, rules, known, order).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(REASON).isNull(), 1)).alias("good"),
        *[F.count(F.when(F.col(REASON) == n, 1)).alias(n) for n in names])
    number = max([*_versions(spark, path), *_versions(spark, f"{path}/_bad")], default=0) + 1
    staged = f"{path}/_staged/{number}"
    # One folder per reason; that of none holds the good rows as they came.
    told.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(REASON).parquet(staged)
    report = {k: int(v) for k, v in seen.get.items()}
    report["version"] = 0 if any(report[n] for n in fatal) else number
    good = f"{staged}/{REASON}=__HIVE_DEFAULT_PARTITION__"
    if report["version"]:
        _publish(spark, good, f"{path}/version={number}", df if not report["good"] else None)
    remove(spark, good)
    _publish(spark, staged, f"{path}/_bad/version={number}", told if report["good"] == report["rows"] else None)
    return report


def _publish(spark: SparkSession, staged: str, target: str, empty: DataFrame | None) -> None:
    """Move what was written to its place, or write a table of no rows like ``empty`` there; it counts once the marker is there."""
    remove(spark, target)
    if empty is not None:
        empty.limit(0).write.parquet(target)
        return
    fs, source = _fs(spark, staged)
    _, place = _fs(spark, target)
    fs.mkdirs(place.getParent())
    if not fs.rename(source, place):
        raise OSError(f"{staged} could not be moved to {target}")
    _, marker = _fs(spark, f"{target}/_SUCCESS")
    fs.create(marker, True).close()


def quarantine(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that the newest write kept out, with ``_reason``; None before the first one."""
    found = _versions(spark, f"{path}/_bad")
    return spark.read.parquet(f"{path}/_bad/version={found[-1]}") if found else None
