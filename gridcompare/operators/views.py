"""Views of a selection: map, time series, pies, bars, rankings.

Each view is a roll-up of the rows of one selection. Views that reuse another view start from it, so a
group key is never shuffled at a finer grain than needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcompare.functions import scalars as X
from gridcompare.functions.exact_sum import exact_sums
from gridcompare.functions.ordering import number_rows, quantile_breaks, top_rows_with_ties, top_values

# The text shown for a map cell.
MAP_LABEL = ("Captures pour cette espece: ", " tonnes(t)")
DECILES = tuple(i / 10 for i in range(11))


def _totals(rows: DataFrame, *keys: str, **others) -> DataFrame:
    return exact_sums(rows, keys, "measurement_value", **others)


def _rows():
    return F.count(F.lit(1)).alias("count")


# ---------------------------------------------------------------------------------------------
# Map


def map_cells(rows: DataFrame) -> DataFrame:
    return _totals(rows, "codesource_area", "dataset", "measurement_unit")


def map_view(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """Totals per area, dataset and unit with the area's columns; summed first, joined afterwards."""
    return map_cells(rows).join(areas, "codesource_area", "left")


def map_layer_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("dataset").agg(_rows())


def map_labels(cells: DataFrame) -> DataFrame:
    """Text of each cell; the value is rounded half to even."""
    before, after = MAP_LABEL
    rounded = X.number_text(F.bround("measurement_value", 0))
    return cells.select("codesource_area", "dataset", F.concat(F.lit(before), rounded, F.lit(after)).alias("label"))


def map_deciles(cells: DataFrame) -> DataFrame:
    """Class 1..10 of each cell among all cells: one more than the number of inner breaks not above it."""
    breaks = quantile_breaks(cells, "measurement_value", DECILES).select(
        F.slice("breaks", 2, len(DECILES) - 2).alias("_inner")
    )
    return (
        cells.withColumn("_inner", breaks.scalar())
        .withColumn("decile", F.size(F.filter("_inner", lambda b: b <= F.col("measurement_value"))) + 1)
        .select("codesource_area", "dataset", "measurement_unit", "measurement_value", "decile")
    )


# ---------------------------------------------------------------------------------------------
# Time series


def plot_view(rows: DataFrame) -> DataFrame:
    return _totals(rows, "dataset", "year", "gridtype", "measurement_unit")


def series_long(plot: DataFrame) -> DataFrame:
    return _totals(plot, "dataset", "year", "measurement_unit")


def _require_listed(rows: DataFrame, column: str, values: Sequence[str]) -> None:
    """A pivot has the columns of its list; a value that is not in the list would vanish."""
    missing = rows.where(F.col(column).isNull() | ~F.col(column).isin(list(values))).select(column).limit(1).collect()
    if missing:
        raise ValueError(f"{column} {missing[0][0]!r} is not in the list of columns")


def series_wide(series: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """One whole-number column per dataset; gaps and numbers beyond 32 bits are 0."""
    _require_listed(series, "dataset", datasets)
    cut = X.lenient_int("measurement_value")
    wide = series.groupBy("year", "measurement_unit").pivot("dataset", list(datasets)).agg(F.first(cut))
    return wide.fillna(0, list(datasets))


def series_dense(series: DataFrame) -> DataFrame:
    """Every series (dataset and unit) with a positive total, with a value for every year of the data; rows
    without a year are one more year.

    The years present are one short list (calendar years), attached to each series; the yearly values
    of a series are a map from year to value, so nothing is joined.
    """
    undated = F.col("year").isNull()
    years = series.agg(
        F.concat(
            F.array_sort(F.collect_set("year")),
            F.when(F.max(undated), F.array(F.lit(None).cast("int"))).otherwise(F.array().cast("array<int>")),
        )
    )
    cut = F.coalesce(X.lenient_int("measurement_value"), F.lit(0))
    by_series = series.groupBy("dataset", "measurement_unit").agg(
        F.sum(cut).alias("_total"),
        F.max(F.when(undated, cut)).alias("_undated"),
        F.map_from_entries(F.collect_list(F.when(~undated, F.struct("year", cut.alias("value"))))).alias("_values"),
    )
    spread = (
        by_series.where(F.col("_total") > 0)
        .withColumn("_years", years.scalar())
        .select("dataset", "measurement_unit", "_values", "_undated", F.explode("_years").alias("year"))
    )
    value = F.when(undated, F.col("_undated")).otherwise(F.try_element_at("_values", F.col("year")))
    return spread.select(
        F.concat_ws("_", "dataset", X.text_or_na("measurement_unit")).alias("series_name"),
        "measurement_unit",
        "dataset",
        "year",
        F.coalesce(value, F.lit(0)).alias("measurement_value"),
    )


def series_by_date(series: DataFrame, datasets: Sequence[str], units: Sequence[str] = ("t", "no")) -> DataFrame:
    """One column ``<dataset>_<unit>`` per series on the first day of each year.

    A year in which a unit has no row at all is NULL in the columns of that unit; a year in which only
    some datasets have rows is 0 in the others. A series without any positive total is NULL throughout.
    When the rows have a single unit, whichever it is, there is one column ``<dataset>`` per dataset and gaps are 0.
    """
    _require_listed(series, "dataset", datasets)
    if len(series.select("measurement_unit").distinct().limit(2).collect()) < 2:
        parts = [F.coalesce(F.sum(F.when(F.col("dataset") == d, F.col("measurement_value"))), F.lit(0.0)).alias(d) for d in datasets]
        return series.groupBy("year").agg(*parts).select(X.first_of_january("year").alias("date"), *datasets)
    kept = series.where(F.col("measurement_unit").isin(list(units)))
    names = [(f"{d}_{u}", d, u) for u in units for d in datasets]

    def cell(dataset: str, unit: str):
        return F.sum(F.when((F.col("dataset") == dataset) & (F.col("measurement_unit") == unit), F.col("measurement_value")))

    seen = [F.max(F.when(F.col("measurement_unit") == u, F.lit(1))).alias(f"_has_{u}") for u in units]
    yearly = kept.groupBy("year").agg(*[cell(d, u).alias(n) for n, d, u in names], *seen)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    columns = [
        F.when(
            (F.sum(n).over(everything) > 0) & F.col(f"_has_{u}").isNotNull(), F.coalesce(F.col(n), F.lit(0.0))
        ).alias(n)
        for n, _, u in names
    ]
    return yearly.select(X.first_of_january("year").alias("date"), *columns)  # one row per calendar year


# ---------------------------------------------------------------------------------------------
# Pies and bars


def gridtype_totals(plot: DataFrame) -> DataFrame:
    return _totals(plot, "dataset", "gridtype", "measurement_unit", count=_rows())


def dataset_unit_totals(plot: DataFrame) -> DataFrame:
    return _totals(plot, "dataset", "measurement_unit", count=_rows())


def dataset_totals(plot: DataFrame) -> DataFrame:
    """Total per dataset, units added together."""
    return _totals(plot, "dataset")


def one_unit(totals: DataFrame, show_numbers: bool = True) -> DataFrame:
    """When there are several units, keep numbers (``no``) or tons (``t``); a single unit is kept as it is."""
    unit = F.coalesce("measurement_unit", F.lit(""))
    several = totals.agg((F.min(unit) < F.max(unit)).alias("several")).scalar()
    wanted = F.lit("no" if show_numbers else "t")
    return totals.withColumn("_several", F.coalesce(several, F.lit(False))).where(
        ~F.col("_several") | (F.col("measurement_unit") == wanted)
    ).drop("_several")


def gridtype_share(totals: DataFrame, show_numbers: bool = True) -> DataFrame:
    """Share of each grid type in its dataset."""
    shown = one_unit(totals, show_numbers)
    whole = F.sum("measurement_value").over(Window.partitionBy("dataset"))
    return shown.select(
        "dataset",
        "gridtype",
        "measurement_unit",
        "measurement_value",
        F.round(X.share_of("measurement_value", whole), 6).alias("share"),
    )


def totals_wide(totals: DataFrame, units: Sequence[str]) -> DataFrame:
    """``measurement_value_<unit>`` and ``count_<unit>`` per dataset, gaps 0."""
    _require_listed(totals, "measurement_unit", units)
    wide = totals.groupBy("dataset").pivot("measurement_unit", list(units)).agg(
        F.sum("measurement_value").alias("measurement_value"), F.sum("count").alias("count")
    )
    measures = ["measurement_value", "count"]
    renamed = wide.withColumnsRenamed({f"{u}_{m}": f"{m}_{u}" for u in units for m in measures})
    return renamed.fillna(0).select("dataset", *[f"{m}_{u}" for m in measures for u in units])


def bar_tons_only(totals: DataFrame) -> DataFrame:
    return totals.where(F.col("measurement_unit") == "t").select("dataset", "measurement_unit", "measurement_value")


def ratio_to_baseline(totals: DataFrame, baseline: str) -> DataFrame:
    """Total of each other dataset over the baseline's; the divisor is 1 when the baseline is absent."""
    divisor = totals.where(F.col("dataset") == baseline).agg(F.max("measurement_value")).scalar()
    others = totals.where(F.col("dataset") != baseline).withColumn("_divisor", F.coalesce(divisor, F.lit(1.0)))
    return others.select("dataset", X.share_of("measurement_value", "_divisor").alias("ratio"))


def ratio_share(ratios: DataFrame) -> DataFrame:
    """Share of each dataset among the ratios."""
    whole = ratios.agg(F.sum("ratio")).scalar()
    return ratios.withColumn("_whole", whole).select("dataset", X.share_of("ratio", "_whole").alias("share"))


# ---------------------------------------------------------------------------------------------
# Gears and rankings


def gear_species_series(rows: DataFrame) -> DataFrame:
    return _totals(rows, "measurement_unit", "gear_type", "year", "species")


def gear_totals(series: DataFrame) -> DataFrame:
    return _totals(series, "measurement_unit", "gear_type")


def sorted_gear_totals(totals: DataFrame) -> DataFrame:
    """Totals in the order of their unit, ties by gear, with ``pos``, their place in it."""
    placed = number_rows(totals, ["measurement_unit", "gear_type"], "pos")
    return placed.select("pos", "measurement_unit", "gear_type", "measurement_value").orderBy("pos")


def top_gears_by_code(gears: DataFrame, n: int = 9) -> DataFrame:
    """The ``n`` last gear codes in text order (all of them when there are no more)."""
    known = gears.select("gear_type").where(F.col("gear_type").isNotNull())
    return known.distinct().orderBy(F.col("gear_type").desc()).limit(n)


def top_gears_by_total(totals: DataFrame, n: int = 9) -> DataFrame:
    """The ``n`` gears with the largest totals, units added together, ties kept."""
    by_gear = _totals(totals, "gear_type")
    return top_rows_with_ties(by_gear, "measurement_value", n).select("gear_type", "measurement_value")


def series_of_gears(series: DataFrame, gears: DataFrame) -> DataFrame:
    return series.join(gears.select("gear_type"), "gear_type", "left_semi")


def top_rows(rows: DataFrame, n: int = 10) -> DataFrame:
    """Rows among the ``n`` largest values, ties kept."""
    return top_rows_with_ties(rows, "measurement_value", n)
