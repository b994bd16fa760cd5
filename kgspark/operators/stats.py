"""Statistics over time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.plans.lineage import ship_package

#: Least seconds between two samples that are kept, and how many are kept.
SPACING, KEPT = 60, 200


#: Seconds of a series that are folded together.
STRETCH = 86_400


def history(samples: DataFrame, spacing: int = SPACING, kept: int = KEPT, stretch: int = STRETCH) -> DataFrame:
    """Samples (series, at, value) that are at least ``spacing`` seconds after the last kept one; the last ``kept``.

    Of samples at the same second the least value counts; those without a time are left out.  Which samples are kept
    depends on those before, but only by the second from which a next one may be kept.  So each day (``stretch``) of a series is
    folded on its own for all ``spacing`` seconds it may begin with, the days' outcomes are strung together, and each
    day is folded once more from the second that is now known.  No group has more rows than a day has seconds, or a
    series has days.
    """
    if spacing < 1:
        raise ValueError("spacing must be a second or more")
    ship_package(samples.sparkSession)
    at = F.col("at").cast("bigint")
    seconds = samples.filter("at IS NOT NULL").groupBy("series", at.alias("at")).agg(F.min(F.struct(F.col("value").cast("double").alias("value")))["value"].alias("value"))
    day = F.floor(F.col("at") / stretch).cast("bigint")
    days = seconds.groupBy("series", day.alias("day")).agg(F.array_sort(F.collect_list("at")).alias("times"))
    kind = samples.schema["series"].dataType.simpleString()

    def outcomes(batches):
        for batch in batches:
            last = [_outcomes(np.array(t), d * stretch, spacing) for t, d in zip(batch.column("times").to_pylist(), batch.column("day").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("series"), batch.column("day"), pa.array(last, pa.list_(pa.int64()))], ["series", "day", "last"])

    def strung(batches):
        for batch in batches:
            out = [_strung(x, spacing, stretch) for x in batch.column("days").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("series"), pa.array(out, pa.list_(pa.struct([("day", pa.int64()), ("first", pa.int64())])))], ["series", "starts"])

    def folded(batches):
        for batch in batches:
            out = [_fold(np.array(t), first, spacing) for t, first in zip(batch.column("times").to_pylist(), batch.column("first").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("series"), pa.array(out, pa.list_(pa.int64()))], ["series", "at"])

    ends = days.mapInArrow(outcomes, f"series {kind}, day bigint, last array<bigint>")
    per_series = ends.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("day", "last"))).alias("days"))
    starts = per_series.mapInArrow(strung, f"series {kind}, starts array<struct<day:bigint,first:bigint>>")
    starts = starts.select("series", F.inline("starts"))
    same = days["series"].eqNullSafe(starts["series"]) & (days["day"] == starts["day"])
    times = days.join(starts, same).select(days["series"], "times", "first").mapInArrow(folded, f"series {kind}, at array<bigint>")
    times = times.select("series", F.explode("at").alias("at"))
    newest = Window.partitionBy("series").orderBy(F.desc("at"))
    last = times.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= kept)
    same = seconds["series"].eqNullSafe(last["series"]) & (seconds["at"] == last["at"])
    return seconds.join(F.broadcast(last), same, "left_semi").select("series", "at", "value")


def _fold(times: np.ndarray, first: int, spacing: int) -> list[int]:
    """The kept ones of sorted times if the first may be kept from ``first`` on."""
    out, k = [], int(np.searchsorted(times, first))
    while k < len(times):
        out.append(int(times[k]))
        k = int(np.searchsorted(times, out[-1] + spacing))
    return out


def _outcomes(times: np.ndarray, start: int, spacing: int) -> list[int | None]:
    """The last kept time if a first may be kept from ``start`` + k on, for each k below ``spacing``; None: none is."""
    after = np.append(np.searchsorted(times, times + spacing), len(times))
    at = np.searchsorted(times, start + np.arange(spacing))
    last = at.copy()
    while (at < len(times)).any():
        last = np.where(at < len(times), at, last)
        at = after[at]
    return [int(times[k]) if k < len(times) else None for k in last]


def _strung(days: list[dict], spacing: int, stretch: int) -> list[dict]:
    """The second from which a first sample may be kept, for each day in order."""
    out, free = [], None
    for d in days:
        start = d["day"] * stretch
        first = start if free is None else max(start, free)
        out.append({"day": d["day"], "first": first})
        end = d["last"][first - start]
        free = free if end is None else end + spacing
    return out


def delta(samples: DataFrame) -> DataFrame:
    """Change in percent of each series' newest value against its oldest; from 0 it is 0 or 100."""
    ends = samples.groupBy("series").agg(F.min_by("value", "at").alias("old"), F.max_by("value", "at").alias("new"))
    change = F.when(F.col("old") == 0, F.when(F.col("new") == 0, 0.0).otherwise(100.0)).otherwise((F.col("new") - F.col("old")) / F.col("old") * 100)
    return ends.select("series", "old", "new", change.alias("delta_percent"))


def total_by_party(relations: DataFrame, amounts: DataFrame, concepts: DataFrame) -> DataFrame:
    """party, total, largest of the amounts (source, amount) that a typed edge leads to each party."""
    sums = relations.join(amounts, "source").groupBy("target").agg(F.sum("amount").alias("total"), F.max("amount").alias("largest"))
    return sums.join(concepts.select(F.col("id").alias("target"), F.col("name").alias("party")), "target").select("party", "total", "largest")


def kinds(records: DataFrame) -> DataFrame:
    """Number of records by kind."""
    return records.groupBy("kind").agg(F.count("*").alias("n"))


def running(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(value).over(window))
