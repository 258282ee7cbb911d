"""Selections: eight value lists and one polygon, applied to the grouped fact.

A ``Selection`` is a value. Applying one gives lazy frames; nothing here is shared between users.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import cached_property
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StructType

from gridcompare import schema as S
from gridcompare.functions.exact_sum import exact_sums
from gridcompare.functions.scalars import in_values
from gridcompare.operators.areas import footprint
from gridcompare.operators.spatial import areas_inside, facts_within

# The selection shown before a user chooses anything.
DEFAULT_SPECIES = ("YFT", "UNK")
DEFAULT_YEARS = tuple(range(2011, 2021))
DEFAULT_GEARS = ("01.1", "01.2")
DEFAULT_UNITS = ("t",)
DEFAULT_GRIDTYPES = ("1deg_x_1deg",)
DEFAULT_FLEETS = ("EUFRA", "EUESP")
DEFAULT_POLYGON = (
    "POLYGON ((-53.789063 21.616579,98.964844 21.616579,98.964844 -35.746512,"
    "-53.789063 -35.746512,-53.789063 21.616579))"
)

# Outcomes of applying a selection.
APPLIED = "applied"
SPATIAL_FALLBACK = "spatial_fallback"
DIMENSION_FALLBACK = "dimension_fallback"


class EmptySelection(ValueError):
    """No row is left, so there is nothing to show."""


@dataclass(frozen=True)
class Selection:
    """Values kept per dimension. None keeps every row of a dimension, missing values included;
    an empty tuple keeps nothing. ``polygon`` None means no spatial filter."""

    dataset: tuple | None = None
    gridtype: tuple | None = None
    species: tuple | None = None
    year: tuple | None = None
    gear_type: tuple | None = None
    measurement_unit: tuple | None = None
    source_authority: tuple | None = None
    fishing_fleet: tuple | None = None
    polygon: str | None = None

    @staticmethod
    def all(polygon: str | None = None) -> "Selection":
        """The full reset: no dimension is filtered."""
        return Selection(polygon=polygon)

    @staticmethod
    def default() -> "Selection":
        return Selection(
            species=DEFAULT_SPECIES,
            year=DEFAULT_YEARS,
            gear_type=DEFAULT_GEARS,
            measurement_unit=DEFAULT_UNITS,
            gridtype=DEFAULT_GRIDTYPES,
            fishing_fleet=DEFAULT_FLEETS,
            polygon=DEFAULT_POLYGON,
        )

    def with_values(self, **values) -> "Selection":
        return replace(self, **values)

    def without_polygon(self) -> "Selection":
        return replace(self, polygon=None)

    @property
    def dimensions(self) -> dict[str, frozenset | None]:
        """The value lists as sets, so that order and repetition do not matter."""
        return {
            f.name: None if getattr(self, f.name) is None else frozenset(getattr(self, f.name))
            for f in fields(self)
            if f.name != "polygon"
        }

    @property
    def is_reset(self) -> bool:
        return all(values is None for values in self.dimensions.values())

    def added_values(self, other: "Selection") -> dict[str, frozenset | None]:
        """Values kept here that ``other`` does not keep (None: every value, where ``other`` keeps a list)."""
        added = {}
        for name, mine in self.dimensions.items():
            theirs = other.dimensions[name]
            if theirs is None:
                continue
            if mine is None:
                added[name] = None
            elif mine - theirs:
                added[name] = mine - theirs
        return added

    def narrows(self, other: "Selection") -> bool:
        """True when every value list is a subset of the other's, so its rows hold all that is needed."""
        return not self.added_values(other)

    def canonical(self, schema: StructType) -> "Selection":
        """The same selection with each list once, sorted, in the type of its column, so that equal selections are
        equal values."""
        lists = {}
        for name in self.dimensions:
            values = getattr(self, name)
            if values is not None:
                lists[name] = tuple(sorted(typed_values(values, schema[name].dataType), key=lambda v: (v is not None, v)))
        return replace(self, **lists)


# ---------------------------------------------------------------------------------------------
# Filters


def filter_dimensions(facts: DataFrame, selection: Selection) -> DataFrame:
    """Rows with an area whose eight dimensions are all in the lists. Values may be given as text, as facets show
    them; Spark turns a long list into a set, and the test reaches the scan whatever the length."""
    kept = facts.where(F.col("codesource_area").isNotNull())
    for name in S.DIMENSIONS:
        values = getattr(selection, name)
        if values is not None:
            kept = kept.where(in_values(name, typed_values(values, facts.schema[name].dataType)))
    return kept


def typed_values(values: tuple, kind: DataType) -> list:
    """Distinct values in the type of their column. A text that is no number equals no number."""
    if not isinstance(kind, IntegralType):
        return list(dict.fromkeys(values))
    numbers: dict = {}
    for value in values:
        try:
            numbers[None if value is None else int(value)] = None
        except ValueError:
            continue
    return list(numbers)


def regroup(facts: DataFrame) -> DataFrame:
    """Sum to the grain of a selection."""
    return exact_sums(facts, S.SELECTION_KEYS, "measurement_value")


def kept_rows(facts: DataFrame, areas: DataFrame, selection: Selection) -> DataFrame:
    """Rows of the facts kept by the lists and the polygon, not summed.

    Views start from here: a sum of sums is the sum, so they need no shuffle at the grain of the facts.
    """
    listed = facts if selection.is_reset else filter_dimensions(facts, selection)
    if selection.polygon is None:
        return listed
    return facts_within(listed, areas_inside(areas, selection.polygon))


def at_grain(rows: DataFrame, selection: Selection, summed: bool = False) -> DataFrame:
    """Kept rows summed to the grain of a selection. After a full reset the facts stay as they are.

    ``summed`` says that the rows come from the grouped fact or from an earlier selection. Those hold each key once,
    with a number, so they are at the grain already and nothing is shuffled.
    """
    if summed or selection.is_reset:
        return rows.select(*S.SELECTION_KEYS, "measurement_value")
    return regroup(rows)


def non_spatial(facts: DataFrame, areas: DataFrame, selection: Selection, summed: bool = False) -> DataFrame:
    """Rows kept by the lists alone, polygon ignored, at the grain of a selection."""
    return selected(facts, areas, selection.without_polygon(), summed)


def selected(facts: DataFrame, areas: DataFrame, selection: Selection, summed: bool = False) -> DataFrame:
    """Rows kept by the lists and the polygon, at the grain of a selection. The area list is applied
    before the sum, which gives the same rows as applying it afterwards and shuffles only what is kept."""
    return at_grain(kept_rows(facts, areas, selection), selection, summed)


def refine_polygon(base: DataFrame, areas: DataFrame, polygon: str | None) -> DataFrame:
    """Same lists, other polygon: only the area test is applied to the rows kept by the lists."""
    return base if polygon is None else facts_within(base, areas_inside(areas, polygon))


# ---------------------------------------------------------------------------------------------
# Results and fallbacks


class KeptRows(Protocol):
    """Results of earlier selections that can answer later ones (see ``sources/kept.py``)."""

    def source(self, lists: Selection) -> DataFrame | None: ...

    def keep(self, lists: Selection) -> None: ...


@dataclass(frozen=True)
class SelectionResult:
    """What one selection gives, described by the selection that is in effect after the fallbacks.

    Every frame is built from the grouped fact, or from a kept result that holds its rows, and the area dimension.
    So its plan has the same size after one step of a session as after a hundred.
    """

    selection: Selection  # as asked for
    facts: DataFrame
    areas: DataFrame
    effective: Selection  # as shown
    listed: Selection  # the lists of ``base``
    status: str
    summed: bool = False  # the facts hold each key once
    kept: KeptRows | None = None
    last_polygon: str | None = None  # the polygon before this one

    def _from(self, lists: Selection) -> tuple[DataFrame, bool]:
        """The rows to read for some lists, and whether they are summed."""
        held = None if self.kept is None or lists.is_reset else self.kept.source(lists)
        return (self.facts, self.summed) if held is None else (held, True)

    def _rows(self, selection: Selection) -> DataFrame:
        facts, summed = self._from(selection.without_polygon())
        return selected(facts, self.areas, selection, summed)

    @cached_property
    def base(self) -> DataFrame:
        """Rows kept by the lists alone."""
        return self._rows(self.listed)

    @cached_property
    def footprint(self) -> DataFrame:
        """Areas of the rows that the lists in effect keep, with their bounding boxes."""
        lists = self.effective.without_polygon()
        return footprint(self.areas, None if lists.is_reset else kept_rows(self._from(lists)[0], self.areas, lists))

    @cached_property
    def filtered(self) -> DataFrame:
        """Rows to show, with ``status`` telling which fallback, if any, was used."""
        rows = self._rows(self.effective)
        return rows.select(*S.SELECTION_KEYS, "measurement_value").withColumn("status", F.lit(self.status))

    def with_last_polygon(self) -> Selection:
        """The selection asked for, with the polygon that was in use before this one (none, if there was none)."""
        return replace(self.selection, polygon=self.last_polygon)

    def read_from(self, rows: DataFrame) -> "SelectionResult":
        """The same result with its rows to show read from a stored table."""
        same = replace(self)
        same.__dict__["filtered"] = rows
        return same

    def keep(self) -> "SelectionResult":
        """Store the rows of the lists in effect, so that this result and narrower ones read them and not the fact."""
        if self.kept is None:
            raise ValueError("this result comes from frames alone; results of stored tables can be kept")
        lists = self.effective.without_polygon()
        if not lists.is_reset:
            self.kept.keep(lists)
        return replace(self)  # its frames are made anew


def _any(rows: DataFrame):
    """One true or false, read from rows that are not summed yet; stops at the first row found."""
    return rows.select(F.lit(1).alias("_one")).limit(1).agg((F.count("_one") > 0).alias("_any")).scalar()


def _unless(condition, frame: DataFrame) -> DataFrame:
    """All rows when the condition is false, none when it is true."""
    return frame.withColumn("_skip", condition).where(~F.col("_skip")).drop("_skip")


def with_fallback(
    facts: DataFrame, areas: DataFrame, selection: Selection, previous: DataFrame | None = None, summed: bool = False
) -> DataFrame:
    """Selected rows plus ``status``, decided inside the plan.

    When no row is inside the polygon, the rows kept by the lists alone are returned. When the lists
    alone keep nothing, the rows of ``previous`` are returned. A full reset has no fallback.
    """
    keys = [*S.SELECTION_KEYS, "measurement_value"]
    if selection.is_reset:
        return selected(facts, areas, selection, summed).select(*keys).withColumn("status", F.lit(APPLIED))
    listed = kept_rows(facts, areas, selection.without_polygon())
    rows, status = listed, F.lit(APPLIED)
    if selection.polygon is not None:
        # One scan marks the rows inside; the other only looks for the first of them.
        inside = areas_inside(areas, selection.polygon)
        some_inside = _any(facts_within(listed, inside))
        marks = inside.select("codesource_area", F.lit(True).alias("_inside")).distinct()
        marked = listed.join(marks, "codesource_area", "left").withColumn("_some", some_inside)
        rows = marked.where(F.col("_inside").isNotNull() | ~F.col("_some")).drop("_inside", "_some")
        status = F.when(some_inside, F.lit(APPLIED)).otherwise(F.lit(SPATIAL_FALLBACK))
    result = at_grain(rows, selection, summed).select(*keys).withColumn("status", status)
    if previous is not None:
        fallback = _unless(_any(listed), previous.select(*keys))
        result = result.unionByName(fallback.withColumn("status", F.lit(DIMENSION_FALLBACK)))
    return result


def apply_selection(
    facts: DataFrame,
    areas: DataFrame,
    selection: Selection,
    previous: SelectionResult | None = None,
    summed: bool = False,
    kept: KeptRows | None = None,
) -> SelectionResult:
    """The results of one selection. Looks for a first row of the lists, and for one inside the polygon, to know
    which fallback is in effect; a full reset has none.

    When the lists keep nothing, what the previous selection shows is shown again, and base is the whole fact.
    When no row is inside the polygon, the lists alone are in effect. With ``kept``, the smallest kept result that
    holds the lists is read and not the fact.
    """
    lists = selection.without_polygon()
    effective, listed, status = selection, lists, APPLIED
    if not selection.is_reset:
        held = None if kept is None else kept.source(lists)
        rows = facts if held is None else held
        inside = selection.polygon is not None and not kept_rows(rows, areas, selection).isEmpty()
        if not inside:  # a row inside is a row of the lists
            if previous is not None and kept_rows(rows, areas, lists).isEmpty():
                effective, listed, status = previous.effective, Selection.all(), DIMENSION_FALLBACK
            elif selection.polygon is not None:
                effective, status = lists, SPATIAL_FALLBACK
    last = None
    if previous is not None:
        last = previous.last_polygon if selection.polygon == previous.selection.polygon else previous.selection.polygon
    return SelectionResult(selection, facts, areas, effective, listed, status, summed, kept, last)


def next_selection(
    whole: DataFrame,
    areas: DataFrame,
    previous: SelectionResult,
    selection: Selection,
    summed: bool = False,
    kept: KeptRows | None = None,
) -> tuple[SelectionResult, str]:
    """Answer a changed selection.

    Returns the result and the way it was made: ``same`` (nothing changed), ``polygon`` (only the polygon
    changed: no fallback), ``refine`` (a kept result holds it, or the lists are narrower than before), ``reset`` (all
    lists open) or ``scratch``. Without ``kept`` every way reads the fact.
    """
    if selection.dimensions == previous.selection.dimensions:
        if selection.polygon == previous.selection.polygon:
            return previous, "same"
        effective = replace(previous.listed, polygon=selection.polygon)
        last = previous.selection.polygon
        return SelectionResult(selection, whole, areas, effective, previous.listed, APPLIED, summed, kept, last), "polygon"
    result = apply_selection(whole, areas, selection, previous, summed, kept)
    if selection.is_reset:
        return result, "reset"
    held = kept is not None and kept.source(selection.without_polygon()) is not None
    return result, "refine" if held or selection.narrows(previous.selection) else "scratch"


def recognise_reset(selection: Selection, values: DataFrame) -> Selection:
    """The full reset, when all eight lists hold every value of ``values`` (dimension, value); else the selection
    as it is. The polygon stays. Missing values need not be listed."""
    if selection.is_reset or any(getattr(selection, name) is None for name in S.DIMENSIONS):
        return selection
    left_out = F.lit(False)
    for name in S.DIMENSIONS:
        listed = [str(v) for v in dict.fromkeys(getattr(selection, name)) if v is not None]
        left_out |= (F.col("dimension") == name) & ~F.col("value").isin(listed)
    unlisted = values.where(F.col("value").isNotNull() & left_out)
    return Selection.all(selection.polygon) if unlisted.isEmpty() else selection


def require_rows(frame: DataFrame, message: str = "no data with the current filters") -> DataFrame:
    """Guard before a view is shown. Looks for one row only."""
    if frame.isEmpty():
        raise EmptySelection(message)
    return frame
