"""Running sums along an order over the whole table, in groups of any size.

Rows are dealt to ranges of the order, so that no group and no order needs a task of its own size. Each task walks its
sorted rows once, batch by batch, and adds up as far as it sees; what the group at a range's start had in the ranges
before is added when the written table is read. The driver gets one row a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

SUM, XOR = "sum", "xor"


def _locally(batches: Iterator[pa.RecordBatch], group: list[str], runs: dict[str, tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """The rows with `_part`, `_at`, `_opens` (the row belongs to the first group of its part) and the runs within the part."""
    from pyspark import TaskContext

    part, at, last, opens = TaskContext.get().partitionId(), 0, None, True
    carried = dict.fromkeys(runs, 0)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [batch.column(g).to_numpy(zero_copy_only=False) for g in group]
        changed = np.zeros(n, bool)
        for key in keys:
            changed[1:] |= key[1:] != key[:-1]
        own = tuple(key[0] for key in keys)
        changed[0] = last is not None and own != last
        last = tuple(key[-1] for key in keys)
        starts = np.flatnonzero(changed)
        segment = np.cumsum(changed)
        opening = (segment == 0) & opens
        opens = opens and not len(starts)
        columns = {"_part": np.full(n, part, np.int32), "_at": np.arange(at, at + n), "_opens": opening}
        at += n
        for name, (source, kind) in runs.items():
            values = batch.column(source).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(values) if kind == SUM else np.bitwise_xor.accumulate(values)
            # What stood before each segment; before the first, what came over from the batch before.
            before = np.where(starts > 0, total[starts - 1], 0)
            total = total - np.append(-carried[name], before)[segment] if kind == SUM else total ^ np.append(carried[name], before)[segment]
            columns[f"_{name}"], carried[name] = total, int(total[-1])
        arrays = [pa.array(values) for values in columns.values()]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *columns])


def running(frame: DataFrame, order: list[Column], group: list[str], runs: dict[str, tuple[str, str]], keep: list[str], name: str = "running") -> DataFrame:
    """The columns `keep` and for each entry of `runs`, name: (long column without nulls, SUM or XOR), the run of that
    column from the start of the row's group up to the row itself, along `order`. `group` are columns without nulls
    that the order begins with; without any, the whole table is one group. The result reads a written table."""
    spark = frame.sparkSession
    small_batches(spark)
    columns = list(dict.fromkeys([*keep, *group, *(source for source, _ in runs.values())]))
    sorted_ = frame.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)
    fields = [*sorted_.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_opens", T.BooleanType())]
    schema = T.StructType([*fields, *(T.StructField(f"_{n}", T.LongType()) for n in runs)])
    walked = written(sorted_.mapInArrow(lambda batches: _locally(batches, group, runs), schema), name)
    keys = F.struct(F.lit(0), *group)
    ends = walked.groupBy("_part").agg(F.min_by(keys, "_at").alias("first"), F.max_by(F.struct(keys.alias("key"), *(f"_{n}" for n in runs)), "_at").alias("last"))
    # One row a range.
    offsets, key, carried = [], None, dict.fromkeys(runs, 0)
    for row in sorted(ends.collect(), key=lambda r: r["_part"]):
        before = carried if key == tuple(row["first"]) else dict.fromkeys(runs, 0)
        offsets.append((row["_part"], *before.values()))
        alone = tuple(row["last"]["key"]) == tuple(row["first"])
        key = tuple(row["last"]["key"])
        carried = {n: row["last"][f"_{n}"] for n in runs}
        if alone:
            carried = {n: v + before[n] if runs[n][1] == SUM else v ^ before[n] for n, v in carried.items()}
    before = spark.createDataFrame(offsets, ", ".join(["_part int", *(f"_before_{n} long" for n in runs)]))
    met = walked.join(F.broadcast(before), "_part")
    out = []
    for n, (_, kind) in runs.items():
        here, earlier = F.col(f"_{n}"), F.when(F.col("_opens"), F.col(f"_before_{n}")).otherwise(F.lit(0).cast("long"))
        out.append((here + earlier if kind == SUM else here.bitwiseXOR(earlier)).alias(n))
    return met.select(*keep, *out)
