"""Results of selections, kept as stored tables, that answer narrower selections."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gridcompare.operators.selection import Selection, selected
from gridcompare.sources.stored import materialise

MOST_KEPT = 64


@dataclass(frozen=True)
class Kept:
    rows: int
    frame: DataFrame


class KeptSelections:
    """An index from the lists of a selection to the stored rows they keep, polygon aside.

    A selection is answered from the kept result with the fewest rows whose lists hold all of its own. Rows are
    stored at the grain of a selection in the folder of all stored tables, under a name made of the lists and the
    state of the inputs: a lost executor costs nothing but reading them again, another session finds them, and
    changed inputs make other tables. The index itself holds the ``most`` results used last.
    """

    def __init__(self, facts: DataFrame, areas: DataFrame, inputs: Iterable[str], version: str = "", most: int = MOST_KEPT):
        self.facts, self.areas, self.inputs, self.version, self.most = facts, areas, tuple(inputs), version, most
        self._kept: OrderedDict[Selection, Kept] = OrderedDict()

    def _smallest(self, lists: Selection) -> Selection | None:
        holding = [k for k in self._kept if lists.narrows(k)]
        return min(holding, key=lambda k: self._kept[k].rows, default=None)

    def source(self, lists: Selection) -> DataFrame | None:
        """The rows of the smallest kept result that holds these lists; None if none does."""
        best = self._smallest(lists.without_polygon().canonical(self.facts.schema))
        if best is None:
            return None
        self._kept.move_to_end(best)
        return self._kept[best].frame

    def keep(self, lists: Selection) -> None:
        """Store the rows of these lists, read from a kept result if one holds them. A full reset is the fact itself
        and is not stored again."""
        lists = lists.without_polygon().canonical(self.facts.schema)
        if lists.is_reset or lists in self._kept:
            return
        held = self.source(lists)
        rows = selected(self.facts if held is None else held, self.areas, lists, summed=True)
        name = "kept-" + hashlib.sha256(repr(lists).encode()).hexdigest()[:24]
        frame = materialise(
            self.facts.sparkSession, name, self.inputs, lambda: rows, cluster_by=["measurement_unit", "species", "year"], version=self.version
        )
        self._kept[lists] = Kept(frame.count(), frame)  # counts are read from the files' footers
        while len(self._kept) > self.most:
            self._kept.popitem(last=False)
