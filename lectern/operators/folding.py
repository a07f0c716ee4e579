"""Order-bound folds: what happens to a row depends on what was decided before it.

Spark partitions and sorts the rows of each key; the fold then reads one Arrow
batch at a time, looks only at the columns it needs and appends its result
columns to the batch.  A large key therefore costs time in its task but never
memory, and no column passes through Python objects unless it is looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

_SEQ = "__seq"
_TYPES = {"bigint": (LongType(), pa.int64()), "boolean": (BooleanType(), pa.bool_())}


def fold_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Callable[[], Callable[..., tuple]],
    needs: Sequence[str],
    adds: dict[str, str],
) -> DataFrame:
    """Appends ``adds`` (name -> bigint or boolean) to the rows of ``df``.

    ``start()`` gives the state of a key, a callable that takes the ``needs``
    of the next row and returns its added values.  The row number makes Spark
    cluster and sort the rows, and reuses a partitioning that already fits.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ordered = df.withColumn(_SEQ, F.row_number().over(w))
    fields = [f for f in df.schema.fields] + [StructField(n, _TYPES[t][0]) for n, t in adds.items()]
    arrow_types = [_TYPES[t][1] for t in adds.values()]
    key_names, need_names, width = list(keys), list(needs), len(adds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            key_rows = zip(*[batch.column(at[k]).to_pylist() for k in key_names])
            need_rows = zip(*[batch.column(at[n]).to_pylist() for n in need_names])
            out: list[list] = [[] for _ in range(width)]
            for key, values in zip(key_rows, need_rows):
                if key != current:
                    current, state = key, start()
                for column, value in zip(out, state(*values)):
                    column.append(value)
            kept = [batch.column(i) for n, i in at.items() if n != _SEQ]
            names = [n for n in at if n != _SEQ] + list(adds)
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(o, type=t) for o, t in zip(out, arrow_types)], names=names)

    return ordered.mapInArrow(run, StructType(fields))
