"""Facets that depend on the choices made in the other lists."""

from itertools import product

import pytest

from gridcompare import schema as S
from gridcompare.operators import facets as FA
from gridcompare.operators.selection import Selection

COLUMNS = ", ".join(f"{d} {'int' if d == 'year' else 'string'}" for d in S.DIMENSIONS)


@pytest.fixture(scope="module")
def combinations(spark):
    rows = []
    for i, (species, year, gear) in enumerate(product(("YFT", "SKJ", None), (2011, 2012, None), ("09", "10"))):
        if i % 4 != 1:
            rows.append((f"d{i % 2}", "others", species, year, gear, "t", "IOTC", f"F{i % 3}"))
    return spark.createDataFrame(rows, COLUMNS)


def plain(combinations, selection):
    rows = [r.asDict() for r in combinations.collect()]
    typed = {n: {None if v is None else int(v) if n == "year" and str(v).isdigit() else v for v in vs} for n, vs in selection.dimensions.items() if vs is not None}
    fits = lambda row, skip: all(row[n] in vs for n, vs in typed.items() if n != skip)
    return {(d, None if r[d] is None else str(r[d])) for d in S.DIMENSIONS for r in rows if fits(r, d)}


@pytest.mark.parametrize(
    "selection",
    [
        Selection(),
        Selection(species=("YFT",)),
        Selection(species=("YFT", None), year=("2011",)),
        Selection(year=("2012", "n/a"), gear_type=("09",), dataset=("d0",)),
        Selection(species=("none",)),
        Selection(species=("none",), year=(2011,)),
        Selection(species=(), fishing_fleet=("F1", "F2")),
    ],
)
def test_choosable_values_are_those_of_plain_python(combinations, selection):
    found = {(r.dimension, r.value) for r in FA.choosable_values(combinations, selection).collect()}
    assert found == plain(combinations, selection)


def test_a_list_can_be_widened_from(combinations):
    chosen = Selection(species=("YFT",))
    species = lambda frame: {r.value for r in frame.where("dimension = 'species'").collect()}
    assert species(FA.dependent_values(combinations, chosen)) == {"YFT"}
    assert species(FA.choosable_values(combinations, chosen)) == {"YFT", "SKJ", None}


def test_a_year_that_is_no_number_is_ignored(combinations):
    assert FA.dependent_values(combinations, Selection(year=("n/a",))).count() == 0
