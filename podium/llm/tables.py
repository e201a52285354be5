"""Tables of a fixed size that tasks fill in part and that are added up slice by slice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import mix

#: Numbers in one row; the rows of a slice are added up in one place.
_SLICE = 4096
SHAPE = "slice long, part long, numbers binary"
FIELDS = [("slice", pa.int64()), ("part", pa.int64()), ("numbers", pa.binary())]


def partial(numbers: np.ndarray) -> pa.RecordBatch:
    """This task's share of a table, without the slices that are all 0. The size is a multiple of 4096."""
    part = TaskContext.get().partitionId()
    cut = [(k, part, c.tobytes()) for k, c in enumerate(numbers.reshape(-1, _SLICE)) if c.any()]
    return pa.RecordBatch.from_pydict(
        {name: pa.array([c[i] for c in cut], kind) for i, (name, kind) in enumerate(FIELDS)}, schema=pa.schema(FIELDS)
    )


def total(partials: DataFrame, size: int, kind: str, combine=np.add) -> np.ndarray:
    """The table that the partial ones (slice, part, numbers) add up to; its fixed size is what reaches the driver."""

    def add(key, rows):
        summed = np.zeros(_SLICE, kind)
        for c in rows.column("numbers").to_pylist():
            combine(summed, np.frombuffer(c, kind), out=summed)
        first = {name: [rows.column(name)[0].as_py()] for name in ("slice", "part")}
        return pa.table(first | {"numbers": pa.array([summed.tobytes()], pa.binary())})

    some = partials.withColumn("part", F.col("part") % 64).groupBy("slice", "part").applyInArrow(add, SHAPE)
    table = np.zeros(size, kind)
    for r in some.groupBy("slice").applyInArrow(add, SHAPE).select("slice", "numbers").collect():
        table[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] = np.frombuffer(r["numbers"], kind)
    return table


def marked(ids: DataFrame, bits: int) -> np.ndarray:
    """A table of ``2 ** bits`` places that tells where the one column of ``ids``, whole numbers, has a value.

    It answers whether a number may be among them: a yes can be wrong, the more so the more there are; a no cannot.
    """

    def mark(batches):
        found = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            found[place(batch.column(0), bits)] = 1
        yield partial(found)

    return total(ids.mapInArrow(mark, SHAPE), 1 << bits, "u1", np.maximum) > 0


def place(ids: pa.Array, bits: int) -> np.ndarray:
    return (mix(ids.fill_null(-1).to_numpy().astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
