"""Scalar column expressions. All are built-in Spark functions, so they stay in whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridcompare import schema as S


def in_values(column: str | Column, values: Iterable) -> Column:
    """Membership test for a filter: NULL passes only when ``values`` holds None."""
    column = F.col(column) if isinstance(column, str) else column
    values = list(values)
    present = [v for v in values if v is not None]
    if not values:
        return F.lit(False)
    if len(present) < len(values):
        return column.isNull() | F.coalesce(column.isin(present), F.lit(False))
    return column.isin(present)  # a filter drops the NULL result; this bare form can be pushed to parquet


def normalise_unit(unit: str | Column) -> Column:
    """Replace known spellings of a unit by its code, keep any other text, keep NULL."""
    unit = F.col(unit) if isinstance(unit, str) else unit
    result = unit
    for code in dict.fromkeys(S.UNIT_ALIASES.values()):
        spellings = [s for s, c in S.UNIT_ALIASES.items() if c == code]
        result = F.when(unit.isin(spellings), F.lit(code)).otherwise(result)
    return result


def lenient_double(text: str | Column) -> Column:
    """Number from text; text that is not a number becomes NULL."""
    text = F.col(text) if isinstance(text, str) else text
    return text.try_cast("double")


def lenient_int(value: str | Column) -> Column:
    """Integer part of a number; NULL beyond the 32-bit range."""
    value = F.col(value) if isinstance(value, str) else value
    return value.try_cast("int")


def year_of(text: str | Column) -> Column:
    """Year of a text date; NULL when the text is not a date."""
    text = F.col(text) if isinstance(text, str) else text
    return F.year(text.try_cast("date"))


def first_of_january(year: str | Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def recode_gridtype(gridtype: str | Column) -> Column:
    """Keep the two fine grids, call everything else (and NULL) 'others'."""
    gridtype = F.col(gridtype) if isinstance(gridtype, str) else gridtype
    return F.when(gridtype.isin(list(S.KEPT_GRIDTYPES)), gridtype).otherwise(F.lit(S.OTHER_GRIDTYPE))


def base_name(path: str | Column) -> Column:
    """Last component of a slash-separated path."""
    return F.element_at(F.split(path, "/"), -1)


def drop_dataset_extension(name: str | Column) -> Column:
    return F.regexp_replace(name, r"\.(" + "|".join(S.DATASET_EXTENSIONS) + r")$", "")


def drop_urn(text: str | Column) -> Column:
    return F.regexp_replace(text, "urn:", "")


def text_or_na(text: str | Column) -> Column:
    """Text used inside a label: a missing value is spelt out as NA."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text, F.lit("NA"))


def number_text(value: str | Column) -> Column:
    """Plain decimal text of a coordinate, without exponent or trailing zeros."""
    value = F.col(value) if isinstance(value, str) else value
    decimal = F.regexp_replace(value.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    return F.when(value == F.rint(value), value.try_cast("bigint").cast("string")).otherwise(decimal)


def share_of(value: str | Column, total: str | Column) -> Column:
    """Fraction of a total; NULL when the total is zero."""
    total = F.col(total) if isinstance(total, str) else total
    value = F.col(value) if isinstance(value, str) else value
    return value / F.when(total != 0, total)
