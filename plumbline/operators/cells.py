"""Typing of cells: retyping a column, and fitting a text value into a column."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import amount_cleaned

# Tried in this order when a text column becomes a timestamp.
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "M-d-yyyy", "yyyy/M/d")


# No text stands for these, so nothing but clearing writes to them.
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def nested_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NESTED)]


def to_timestamp(text: Column, formats: tuple[str, ...] = TIMESTAMP_FORMATS) -> Column:
    tries = [text.try_cast("timestamp")]
    tries += [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*tries)


def fit(value: Column, kind: T.DataType) -> Column:
    """A text value in the type of its column; null where it does not fit.

    Numbers lose currency signs, commas and white space first.
    """
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, NESTED):
        return F.lit(None).cast(kind)
    if isinstance(kind, T.IntegralType):
        number = amount_cleaned(value).try_cast("double")
        whole = F.coalesce(amount_cleaned(value).try_cast(kind), number.try_cast(kind))
        return F.when(number == F.floor(number), whole)
    if isinstance(kind, T.NumericType):
        return amount_cleaned(value).try_cast(kind)
    if isinstance(kind, T.TimestampType):
        return to_timestamp(value)
    return value.try_cast(kind)


def retype(df: DataFrame, column: str, dtype: str) -> Column:
    """The column in its new type, unreadable cells becoming null. ValueError if impossible.

    ``int`` gives bigint if all surviving values are whole, else double. ``str`` keeps nulls.
    """
    cell, name = F.col(f"`{column}`"), dtype.lower().strip()
    if "float" in name:
        return cell.try_cast("double")
    if "int" in name:
        number = cell.try_cast("double")
        broken = df.where(number != F.floor(number)).limit(1).count()
        if broken:
            return number
        return F.coalesce(cell.try_cast("bigint"), number.try_cast("bigint"))
    if "datetime" in name or name == "date":
        return to_timestamp(cell.cast("string"))
    if name in ("str", "string", "object"):
        return cell.cast("string")
    try:
        out = cell.try_cast({"bool": "boolean", "category": "string"}.get(name, name))
        df.select(out).schema  # noqa: B018 - analysis rejects unknown types
    except PySparkException as error:
        raise ValueError(f"cannot cast column '{column}' to '{dtype}'") from error
    return out
