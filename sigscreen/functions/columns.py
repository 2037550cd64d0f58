"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marker and city patterns, and the white space that
# separates tokens (every character Python's str.split() treats as space).
CITY_PATTERN = r"city[_ ]?(\d{2})"
MARKER_PATTERN = r"(?:land|team|slang)_city_(\d{2})"
MENTION_PATTERN = r"cityname_city_(\d{2})"
URL_PATTERN = r"http|www\."
EMOJI_PATTERN = r"[\x{1F300}-\x{1FAFF}]"
WHITESPACE = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)

# Formats tried, in order, after the ISO forms that a plain cast understands.
TIME_FORMATS = ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "yyyy/M/d", "yyyyMMdd")


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_category(
    c: str | Column, pattern: str = CITY_PATTERN, prefix: str = "city_", width: int = 2
) -> Column:
    """Rebuild a messy category (``' CITY_07'``, ``'City 07'``) as ``prefix`` + zero-padded number.

    Null when the pattern does not match. ``pattern`` has one group, the number.
    """
    digits = F.regexp_extract(F.trim(as_col(c)), "(?i)" + pattern, 1)
    number = digits.try_cast("bigint").cast("string")
    padded = F.lpad(number, F.greatest(F.length(number), F.lit(width)), F.lit("0"))
    return F.when(number.isNotNull(), F.concat(F.lit(prefix), padded))


def to_number(c: str | Column) -> Column:
    """Double, with unparseable values and NaN as null."""
    x = as_col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def to_time(c: str | Column, dtype: T.DataType) -> Column:
    """Timestamp, with unparseable values as null."""
    c = as_col(c)
    if isinstance(dtype, T.StringType):
        tries = [c.try_cast("timestamp")]
        tries += [F.try_to_timestamp(c, F.lit(f)) for f in TIME_FORMATS]
        return F.coalesce(*tries)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    return F.lit(None).cast("timestamp")


def clean_nan(df: DataFrame) -> DataFrame:
    """Map NaN to null in every floating column, so that missing means one thing."""
    fixed = {
        f.name: F.when(~F.isnan(F.col(f.name)), F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixed) if fixed else df


def tokens(text: str | Column) -> Column:
    """White-space tokens of a text; an empty text has none."""
    return F.filter(F.split(as_col(text), WHITESPACE), lambda t: t != "")


def region_of(city: str | Column, per_region: int = 5, prefix: str = "metro_") -> Column:
    """Region of a numbered city: equal runs of ``per_region`` numbers share a region."""
    number = F.regexp_extract(as_col(city), r"(\d+)", 1).try_cast("bigint")
    return F.when(
        number.isNotNull(),
        F.concat(F.lit(prefix), F.floor(number / per_region).cast("string")),
    )


def hash_text(seed: str | int, *cols: str | Column) -> Column:
    """32 hex digits that order rows the same way on every run and every engine."""
    parts = [as_col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def unit_interval(h: Column) -> Column:
    """Map hex digits from ``hash_text`` to a double in [0, 1)."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def digamma(n: str) -> Column:
    """Digamma of a positive number, given as an SQL expression.

    Recurrence up to n + 6, then the asymptotic series.
    """
    n = f"double({n})"
    z = f"({n} + 6.0D)"
    steps = " ".join(f"- 1 / ({n} + {i}D)" for i in range(6))
    return F.expr(
        f"ln({z}) - 1 / (2 * {z}) - 1 / (12 * pow({z}, 2)) + 1 / (120 * pow({z}, 4))"
        f" - 1 / (252 * pow({z}, 6)) + 1 / (240 * pow({z}, 8)) - 1 / (132 * pow({z}, 10)) {steps}")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole 24-hour blocks from ``earlier`` to ``later``, rounded down."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("bigint")


def xlogx(c: str | Column) -> Column:
    c = as_col(c)
    return F.when(c > 0, c * F.ln(c)).otherwise(F.lit(0.0))
