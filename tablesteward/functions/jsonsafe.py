"""Conversion of result columns to types that plain JSON can carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteward.functions.text import interval_seconds, iso_timestamp

_UNCHANGED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.NullType)


def needs_conversion(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return needs_conversion(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return not isinstance(data_type.keyType, T.StringType) or needs_conversion(data_type.valueType)
    if isinstance(data_type, T.StructType):
        return any(needs_conversion(field.dataType) for field in data_type.fields)
    return not isinstance(data_type, _UNCHANGED)


def json_safe_value(value: Column, data_type: T.DataType) -> Column:
    """The expression for one column, following its schema down to the leaves."""
    if not needs_conversion(data_type):
        return value
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        double = value.cast("double")
        return F.when(~F.isnan(double) & (F.abs(double) != float("inf")), double)
    if isinstance(data_type, T.DecimalType):
        return value.cast("double")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return iso_timestamp(value, isinstance(data_type, T.TimestampType))
    if isinstance(data_type, T.DayTimeIntervalType):
        return interval_seconds(value)
    if isinstance(data_type, T.BinaryType):
        return F.base64(value)
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda item: json_safe_value(item, data_type.elementType))
    if isinstance(data_type, T.MapType):
        keyed = value
        if not isinstance(data_type.keyType, T.StringType):
            keyed = F.transform_keys(value, lambda key, _: key.cast("string"))
        return F.transform_values(keyed, lambda _, item: json_safe_value(item, data_type.valueType))
    if isinstance(data_type, T.StructType):
        fields = [json_safe_value(value[f.name], f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value.cast("string")


def json_safe(df: DataFrame) -> DataFrame:
    """Every column of ``df`` in JSON-safe form, names and order kept."""
    return df.select(
        *[json_safe_value(df[f"`{f.name}`"], f.dataType).alias(f.name) for f in df.schema.fields]
    )


def rows_as_json(df: DataFrame, output: str = "row") -> DataFrame:
    """Every row as the text of one positional JSON list, nulls included."""
    safe = json_safe(df)

    def element(name: str) -> Column:
        listed = F.to_json(F.array(F.col(f"`{name}`")), {"ignoreNullFields": "false"})
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    cells = F.concat_ws(",", *[element(name) for name in safe.columns])
    return safe.select(F.concat(F.lit("["), cells, F.lit("]")).alias(output))
