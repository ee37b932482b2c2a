"""Rows that the driver has, as DataFrames that are part of the plan: no job reads them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Kinds whose Python values mean the same to Arrow and to Spark, whatever the time zone.
_PLAIN = (T.IntegralType, T.FractionalType, T.StringType, T.BinaryType, T.BooleanType, T.DateType)


def _plain(kind: T.DataType) -> bool:
    return all(_plain(f.dataType) for f in kind) if isinstance(kind, T.StructType) else isinstance(kind, _PLAIN)


def _value(x, kind: T.DataType):
    return dict(zip(kind.names, (_value(v, f.dataType) for v, f in zip(x, kind)))) if isinstance(kind, T.StructType) and x is not None else x


def frame_of(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """The rows as a DataFrame; values must be of the columns' types."""
    names = [f.name for f in schema]
    if not _plain(schema) or len(set(names)) < len(names):
        return spark.createDataFrame(rows, schema)
    check = T._make_type_verifier(schema)
    for row in rows:
        check(tuple(row))
    columns = [pa.array([_value(r[i], f.dataType) for r in rows], type=a.type) for i, (f, a) in enumerate(zip(schema, to_arrow_schema(schema)))]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=names), schema)


def is_local(frame: DataFrame) -> bool:
    """Whether the rows are part of the plan."""
    return frame._jdf.queryExecution().optimizedPlan().nodeName() == "LocalRelation"
