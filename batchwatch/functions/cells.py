"""Cell-level rules: missing markers, number and boolean parsing, identifier names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens that must be read the same way everywhere.
MISSING_MARKERS = ("", "NA", "N/A", "NULL", "NONE", "NAN")
TRUE_TOKENS = ("true", "1", "yes", "y", "t")
FALSE_TOKENS = ("false", "0", "no", "n", "f")
IDENTIFIER_NAMES = ("id", "uuid", "key")
TARGET_NAMES = ("target", "label", "class", "outcome", "predictionlabel", "clusterlabel")

WHITESPACE = " \t\n\r\x0b\x0c"
NUMBER_PATTERN = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_missing_marker(c: Column) -> Column:
    """True for a non-null text cell that only stands for a missing value."""
    return F.coalesce(F.upper(strip(c)).isin(*MISSING_MARKERS), F.lit(False))


def without_markers(c: Column) -> Column:
    return F.when(~is_missing_marker(c), c)


def finite(c: Column) -> Column:
    """Null for NaN and the infinities; anything else unchanged."""
    return F.when(~(F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), c)


def to_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """Text (or any primitive) to double; unparsable cells become null.

    The pattern guard keeps suffix forms such as ``1d`` out, which a plain cast accepts.
    """
    if dtype is None or isinstance(dtype, T.StringType):
        return stripped_to_number(strip(c))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    return F.lit(None).cast("double")


def stripped_to_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def stripped_is_marker(text: Column) -> Column:
    return F.coalesce(F.upper(text).isin(*MISSING_MARKERS), F.lit(False))


def with_stripped(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trim text columns in a projection of their own: the rules that follow read a cell several times, and
    Spark keeps a projection whose results are used more than once, so each cell is trimmed once."""
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    return df.withColumns({c: strip(F.col(c)) for c in texts}) if texts else df


def to_boolean(c: Column) -> Column:
    token = F.lower(strip(c.cast("string")))
    return F.when(token.isin(*TRUE_TOKENS), True).when(token.isin(*FALSE_TOKENS), False)


def bare_name(name: str) -> str:
    return str(name).strip().lower().replace("_", "")


def is_identifier(name: str) -> bool:
    bare = bare_name(name)
    return bare in IDENTIFIER_NAMES or bare.endswith("id")


def is_identifier_col(name: Column) -> Column:
    bare = F.replace(F.lower(strip(name)), F.lit("_"), F.lit(""))
    return bare.isin(*IDENTIFIER_NAMES) | bare.endswith("id")


def is_target_col(name: Column) -> Column:
    return F.replace(F.lower(strip(name)), F.lit("_"), F.lit("")).isin(*TARGET_NAMES)
