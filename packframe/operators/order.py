"""Running totals over a global order without a global window."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packframe.sources.shared import cut


def running(df: DataFrame, order: list[str], sums: dict[str, Column], number: str | None = None) -> DataFrame:
    """df with the exclusive running sum of each column in sums, and the row number from 1, in the order of the columns named (binary order).

    Rows are dealt to ranges of the order; each range is summed, the few range totals are accumulated, and a window runs inside
    each range. The ranges are written before they are used twice, as their bounds come from a sample."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = dict(sums) | ({number: F.lit(1)} if number else {})
    ranged = df.select("*", *[c.cast("long").alias(f"_v_{k}") for k, c in sums.items()]).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged, "ranges")
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_range").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    base = base.select("_range", *[F.coalesce(F.sum(f"_s_{k}").over(upto), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(base), "_range")  # a row for each shuffle partition
    made = [(F.col(f"_b_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) + (1 if k == number else 0)).alias(k) for k in sums]
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *made)


def greedy_blocks(x: DataFrame, limit: int) -> DataFrame:
    """x (dir, path, n) -> dir, path, block_id: in the order of paths, a block is closed when the next entry would take it over limit. Each
    directory is sorted in one partition and streamed through; what is held is a batch and the sum so far."""

    def run(batches):
        now, cur, block = None, 0, 0
        for batch in batches:
            out = []
            for d, n in zip(batch.column("dir").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if d != now:
                    now, cur, block = d, 0, 0
                if cur and cur + n > limit:
                    cur, block = 0, block + 1
                cur += n
                out.append(block)
            yield pa.RecordBatch.from_arrays([batch.column("dir"), batch.column("path"), pa.array(out, pa.int64())], ["dir", "path", "block_id"])

    return x.select("dir", "path", "n").repartition("dir").sortWithinPartitions("dir", "path").mapInArrow(run, "dir string, path string, block_id long")
