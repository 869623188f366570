"""Text cleaning, parsing and rendering rules as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They must equal the rules of the data files being read.
# Characters that count as white space (also valid in RE2 syntax).
SPACE = (
    r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}"
    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Strings a CSV reader takes for a missing value.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Label words of event traces; any other word counts as an anomaly.
LABEL_CODES = {"Success": 0, "Normal": 0, "Fail": 1, "Anomaly": 1}
# Smallest double that has all its digits.
LEAST_NORMAL = 2.0 ** -1022
# Columns joined into one log line, in this order.
LOG_LINE_COLUMNS = ["Date", "Time", "Level", "Component", "Content"]

# The same class for the JVM: printable ASCII is ruled out by one comparison before the ranges are tried.
BLANK = rf"[[^\x{{0021}}-\x{{007E}}]&&{SPACE}]"
COMMA_OR_BLANK = f"[,{BLANK}]"

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip_space(col: Column) -> Column:
    return F.regexp_replace(col, f"^{BLANK}++|{BLANK}++$", "")


def null_if_missing(col: Column) -> Column:
    """Missing-value words become null."""
    return F.when(~col.isin(NULL_TOKENS), col)


def event_line(col: Column) -> Column:
    """``[E5, E22,,E11]`` to ``E5 E22 E11``; the brackets go only as a pair.

    Runs of commas and the space around them separate events, so three replacements over the whole
    text do what splitting, trimming and joining would do per token.
    """
    body = F.regexp_replace(col, rf"(?s)^{BLANK}*+\[(.*)\]{BLANK}*+$", "$1")
    core = F.regexp_replace(body, f"^{COMMA_OR_BLANK}++|{COMMA_OR_BLANK}++$", "")
    return F.regexp_replace(core, f"{BLANK}*+,{COMMA_OR_BLANK}*+", " ")


def raw_line(col: Column) -> Column:
    """T4: outer brackets off, then every run of white space to one space."""
    body = F.regexp_replace(col, r"^[\[\]]++|[\[\]]++$", "")
    return F.regexp_replace(strip_space(body), f"{BLANK}++", " ")


def trace_label(col: Column) -> Column:
    """T5: known words to 0/1, unknown words to 1, null to 0."""
    code = F.when(col.isNull(), F.lit(0))
    for word, value in LABEL_CODES.items():
        code = code.when(col == word, F.lit(value))
    return code.otherwise(F.lit(1))


def clean_template(col: Column) -> Column:
    """Wildcard marks out, runs of white space to one space."""
    return strip_space(F.regexp_replace(F.regexp_replace(col, r"\[\*\]", ""), f"{BLANK}++", " "))


def to_number(col: Column, dtype: T.DataType) -> Column:
    """Anything that is not a number becomes 0."""
    if isinstance(dtype, T.StringType):
        text = strip_space(col)
        word = F.lower(text)
        value = (
            F.when(text.rlike(NUMBER), text.try_cast("double"))
            .when(word.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
            .when(word.isin("-inf", "-infinity"), F.lit(float("-inf")))
        )
        return F.coalesce(value, F.lit(0.0))
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(col.cast("int"), F.lit(0))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.nanvl(col.cast("double"), F.lit(0.0)), F.lit(0.0))
    if isinstance(dtype, T.DecimalType):
        return F.coalesce(col.cast("double"), F.lit(0.0))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(col, F.lit(0).cast(dtype))
    return F.lit(0.0)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def _lay_out(parts: Column) -> Column:
    """Decimal text from struct (sign, digits, exponent): plain from 1e-4 up to 1e16, else scientific."""
    digits, exponent = parts["digits"], parts["exponent"]
    n_digits = F.length(digits)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    whole = F.concat(F.rpad(digits, exponent + 1, "0"), F.lit(".0"))
    mixed = F.concat(
        F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, n_digits)
    )
    tail = F.when(n_digits > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n_digits))).otherwise(F.lit(""))
    mark = F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+"))
    scientific = F.concat(F.substring(digits, 1, 1), tail, mark, F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    body = (
        F.when((exponent < -4) | (exponent >= 16), scientific)
        .when(exponent < 0, small)
        .when(n_digits <= exponent + 1, whole)
        .otherwise(mixed)
    )
    return F.concat(parts["sign"], body)


def _dissect(sci: Column) -> Column:
    mantissa = F.regexp_replace(F.substring_index(sci, "e", 1), "[-.]", "")
    return F.struct(
        F.when(sci.startswith("-"), F.lit("-")).otherwise(F.lit("")).alias("sign"),
        F.regexp_replace(mantissa, "0+$", "").alias("digits"),
        F.substring_index(sci, "e", -1).try_cast("int").alias("exponent"),
    )


@F.pandas_udf(T.StringType())
def _shortest(values: pd.Series) -> pd.Series:
    return pd.Series([repr(x) if x == x else None for x in values.tolist()], dtype=object)


def float_text(col: Column) -> Column:
    """Shortest round-trip text of a double, the nearest to it of that length: ``0.5``, ``1e-05``, ``12345678.0``.

    Numbers of two decimals take the cast as it is.  The rest is laid out from 15 significant digits where these give the
    value back, since no two such texts give the same double.  Of 16 digits several may, and the JVM's formatter does not always
    take the nearest: only those numbers (and subnormal ones) go to Python, all others as null.
    """
    two_decimals = (F.rint(col * 100.0) / 100.0 == col) & (F.abs(col) < 1e7)
    short = F.format_string("%.14e", col)
    certain = (short.try_cast("double") == col) & (F.abs(col) >= LEAST_NORMAL)
    hard = ~F.isnan(col) & (F.abs(col) < float("inf")) & ~two_decimals & ~certain
    return (
        F.when(F.isnan(col), F.lit("nan"))
        .when(col == float("inf"), F.lit("inf"))
        .when(col == float("-inf"), F.lit("-inf"))
        .when(two_decimals, col.cast("string"))
        .when(certain, _bind(_dissect(short), _lay_out))
        .otherwise(_shortest(F.when(hard, col)))
    )


def render_row(df: DataFrame, columns: list[str], unify_numbers: bool) -> Column:
    """The values of ``columns`` as one space-joined line; null renders as ``nan``.

    ``unify_numbers`` renders every value as a float when any column is one (a numeric-only row
    has a single type); without it each value keeps its own type.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    floats = (T.DoubleType, T.FloatType)
    all_float = unify_numbers and any(isinstance(kinds[c], floats) for c in columns)
    parts = []
    for name in columns:
        col = F.col(name)
        if isinstance(kinds[name], floats):
            text = float_text(col.cast("double"))
        elif all_float and isinstance(kinds[name], T.IntegralType):
            exact = F.abs(col.cast("double")) < 1e15
            text = F.when(exact, F.concat(col.cast("string"), F.lit(".0"))).otherwise(float_text(col.cast("double")))
        elif all_float:
            text = float_text(col.cast("double"))
        else:
            text = col.cast("string")
        parts.append(F.coalesce(text, F.lit("nan")))
    return F.concat_ws(" ", *parts)
