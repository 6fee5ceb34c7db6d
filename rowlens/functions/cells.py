"""Expressions over single cells: the missing test, number coercion, rounding and text forms.

Everything here builds ordinary column expressions, so it stays inside Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_POLICIES = ("skip", "zero")

# What counts as a number when it is written as text.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Printable ASCII without the two characters that JSON escapes.
PLAIN_PATTERN = r"^[ !#-\[\]-~]*+\z"

_LARGEST_DOUBLE = 1.7976931348623157e308
_EXACT_INTEGERS = float(2**53)


def quoted(name: str) -> str:
    """The name as one identifier, also when it holds dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def data_type(df: DataFrame, name: str) -> T.DataType:
    for field in df.schema.fields:
        if field.name == name:
            return field.dataType
    raise ValueError(f"unknown column {name!r}; the table has {df.columns}")


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def check_null_policy(null_policy: str) -> None:
    if null_policy not in NULL_POLICIES:
        raise ValueError(f"null_policy must be one of {NULL_POLICIES}, not {null_policy!r}")


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or an empty string in a text column."""
    cell = column(name)
    if is_text(data_type(df, name)):
        return cell.isNull() | (cell == "")
    return cell.isNull()


def raw_number(df: DataFrame, name: str) -> Column:
    """The cell as a double: null where missing, NaN where present but not a number."""
    cell, dtype = column(name), data_type(df, name)
    if isinstance(dtype, T.DoubleType):
        return cell
    if isinstance(dtype, T.NumericType):
        return cell.cast("double")
    if isinstance(dtype, T.BooleanType):
        return cell.cast("int").cast("double")
    if is_text(dtype):
        return (
            F.when(is_missing(df, name), F.lit(None).cast("double"))
            .when(cell.rlike(NUMBER_PATTERN), cell.try_cast("double"))
            .otherwise(F.lit(float("nan")))
        )
    return F.when(cell.isNotNull(), F.lit(float("nan")))


def usable(raw: Column, null_policy: str = "skip") -> Column:
    """A raw number with NaN and infinities dropped; under ``zero`` a missing cell counts as 0."""
    check_null_policy(null_policy)
    if null_policy == "zero":
        raw = F.coalesce(raw, F.lit(0.0))
    return F.when(F.abs(raw) <= F.lit(_LARGEST_DOUBLE), raw)


def number(df: DataFrame, name: str, null_policy: str = "skip") -> Column:
    """The cell as a finite double, null where it has none."""
    return usable(raw_number(df, name), null_policy)


def round_half(x: Column, places: int) -> Column:
    """Round half away from zero. Doubles too large to hold such decimals pass through."""
    scale = float(10**places)
    scaled = F.abs(x) * F.lit(scale)
    size = F.when(
        scaled < F.lit(_EXACT_INTEGERS),
        F.floor(scaled + F.lit(0.5)).cast("double") / F.lit(scale),
    ).otherwise(F.abs(x))
    return F.when((x < 0) & (size > 0), -size).otherwise(size)


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    """Part of whole in percent, null when the whole is 0."""
    return round_half(F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0), places)


def fixed_text(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", round_half(x, places))


def number_text(x: Column) -> Column:
    """A double as short plain text: no trailing ``.0`` and no exponent between 1e-6 and 1e20."""
    size = F.abs(x)
    plain = F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return (
        F.when((size < F.lit(1e15)) & (x == F.floor(x)), F.floor(x).cast("string"))
        .when((size >= F.lit(1e-3)) & (size < F.lit(1e7)), x.cast("string"))
        .when((size >= F.lit(1e-6)) & (size < F.lit(1e20)), plain)
        .otherwise(x.cast("string"))
    )


def value_text(df: DataFrame, name: str) -> Column:
    """The cell as text, null where missing."""
    cell, dtype = column(name), data_type(df, name)
    if is_text(dtype):
        return F.when(cell != "", cell)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return number_text(cell.cast("double"))
    return cell.cast("string")


def json_length(df: DataFrame, name: str) -> Column:
    """Length of the cell written as JSON, in UTF-16 units."""
    cell, dtype = column(name), data_type(df, name)
    if is_text(dtype):
        # Text that JSON writes as it is, which is most of it, needs no writer.
        plain = cell.rlike(PLAIN_PATTERN)
        # Other text stands escaped in {"v":...}; letters beyond the basic plane take two units.
        escaped = F.length(F.to_json(F.struct(cell.alias("v")))) - 6
        wide = F.octet_length(F.encode(cell, "UTF-16BE")) / 2 - F.length(cell)
        size = F.when(plain, F.length(cell) + 2).when(cell.isNotNull(), (escaped + wide).cast("long"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        size = F.when(
            F.abs(cell) <= F.lit(_LARGEST_DOUBLE), F.length(number_text(cell.cast("double")))
        ).otherwise(F.lit(4))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        size = F.lit(26)
    elif isinstance(dtype, T.DateType):
        size = F.lit(12)
    else:
        size = F.length(cell.cast("string"))
    return F.coalesce(size, F.lit(4)).cast("long")
