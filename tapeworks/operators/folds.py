"""Sequential work by key: a fold over each key's rows in order, as a stream.

Rows are shuffled by key and sorted by Spark, which spills; a task then goes
through its sorted rows once and holds one key's state only, never its rows.
"""

from collections import namedtuple
from collections.abc import Callable, Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Fold = Callable[[tuple, Iterator], Iterator[tuple]]


def by_key(df: DataFrame, keys: list[str], order: list[str], fold: Fold, schema: str) -> DataFrame:
    """Rows that fold(key, rows) yields for each key; rows come as named tuples, in order."""
    Row = namedtuple("Row", df.columns)
    at = [df.columns.index(k) for k in keys]
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        rows = (Row(*r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = chain.from_iterable(fold(k, g) for k, g in groupby(rows, key=lambda r: tuple(r[i] for i in at)))
        while some := list(islice(out, 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), kinds, strict=True)], schema=kinds)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
