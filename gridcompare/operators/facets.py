"""Facet lists: the values a user can choose, with labels.

The values of all dimensions are found in one pass over the combinations table and stored; the lists
below read that small table. Only dependent facets go back to the combinations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcompare import schema as S
from gridcompare.functions import scalars as X
from gridcompare.functions.ordering import number_rows
from gridcompare.operators.selection import Selection, filter_dimensions, typed_values

LABEL_COLLATION = "en"


def facet_values(combinations: DataFrame) -> DataFrame:
    """Distinct ``(dimension, value)`` of all eight dimensions in one pass (values as text)."""
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in S.DIMENSIONS]
    )
    return combinations.select(F.explode(pairs).alias("p")).select("p.dimension", "p.value").distinct()


def values_of(values: DataFrame, dimension: str) -> DataFrame:
    """Values of one dimension as column ``code``, from the table of all facet values."""
    return values.where(F.col("dimension") == dimension).select(F.col("value").alias("code"))


def dependent_values(combinations: DataFrame, selection: Selection) -> DataFrame:
    """Values that occur in every dimension once some lists are chosen; each list is narrowed by its own choice too."""
    kept = combinations
    for name in S.DIMENSIONS:
        values = getattr(selection, name)
        if values is not None:
            kept = kept.where(X.in_values(name, typed_values(values, combinations.schema[name].dataType)))
    return facet_values(kept)


def choosable_values(combinations: DataFrame, selection: Selection) -> DataFrame:
    """Values that could be chosen in every dimension without emptying the selection: those that occur with the
    choices made in the other lists, so a list shows what it can be widened by.

    One pass counts the lists that each combination misses. Its value stands in a list if no other list is missed:
    when none is, or only that one. Values may be given as text, as in ``filter_dimensions``.
    """
    missed = {}
    for name in S.DIMENSIONS:
        values = getattr(selection, name)
        if values is not None:
            inside = X.in_values(name, typed_values(values, combinations.schema[name].dataType))
            missed[name] = F.when(F.coalesce(inside, F.lit(False)), 0).otherwise(1)
    total = sum(missed.values(), F.lit(0))
    pairs = [
        F.struct(
            F.lit(name).alias("dimension"),
            F.col(name).cast("string").alias("value"),
            (F.col("_missed") == missed.get(name, F.lit(0))).alias("possible"),
        )
        for name in S.DIMENSIONS
    ]
    exploded = combinations.withColumn("_missed", total).where("_missed <= 1").select(F.explode(F.array(*pairs)).alias("p"))
    return exploded.where("p.possible").select("p.dimension", "p.value").distinct()


def added_values(new: DataFrame, old: DataFrame) -> DataFrame:
    """Facet values of one selection that another does not have; missing values compare as equal."""
    return new.select("dimension", "value").subtract(old.select("dimension", "value"))


def selection_values(grouped: DataFrame, selection: Selection) -> DataFrame:
    """Facet values found in the rows a selection keeps."""
    return facet_values(filter_dimensions(grouped, selection))


def ordered_values(values: DataFrame, dimensions: tuple[str, ...] = ("year", "gridtype")) -> DataFrame:
    """Sorted values of the dimensions that have no code list, missing values left out."""
    listed = values.where(F.col("dimension").isin(list(dimensions)) & F.col("value").isNotNull())
    number = F.when(F.col("dimension") == "year", F.col("value").try_cast("int"))
    placed = number_rows(listed, [number, "value"], "pos", ["value"], "dimension")
    return placed.select("dimension", "value", F.col("pos").cast("int").alias("pos"))


# ---------------------------------------------------------------------------------------------
# Code lists


def labelled(values: DataFrame, codelist: DataFrame) -> DataFrame:
    """Values joined with their code list; the code stands in for a missing label."""
    joined = values.join(codelist, values["code"].eqNullSafe(codelist["code"]), "left").drop(codelist["code"])
    return joined.withColumn("label", F.coalesce("label", "code"))


def dataset_facet(values: DataFrame, manifest: DataFrame) -> DataFrame:
    """Datasets of the data, shown by their code, with title, identifier and link from the manifest."""
    known = manifest.select("code", "title", "identifier", "url")
    return values.join(known, "code", "left").withColumn("label", F.col("code"))


def species_facet(values: DataFrame, codelist: DataFrame) -> DataFrame:
    """Species of the data, shown by scientific name."""
    joined = labelled(values, codelist)
    shown = F.coalesce("taxon_scientific_name", F.lit(S.UNKNOWN_TAXON))
    return joined.select("code", shown.alias("label"), F.col("label").alias("sort_label"))


def gear_facet(values: DataFrame, codelist: DataFrame) -> DataFrame:
    """Gears of the data. When the code list does not match them one to one, every label is the code."""
    joined = labelled(values, codelist).select("code", "label")
    rows = F.count(F.lit(1))
    one_to_one = joined.agg(rows).scalar() == values.agg(rows).scalar()
    shown = F.when(one_to_one, F.col("label")).otherwise(F.col("code"))
    return joined.select("code", shown.alias("label"), F.col("label").alias("sort_label"))


def authority_facet(values: DataFrame, codelist: DataFrame) -> DataFrame:
    """Source authorities as ``code - definition``."""
    joined = values.join(codelist, "code", "left")
    shown = F.concat_ws(" - ", X.text_or_na("code"), X.text_or_na("definition"))
    return joined.select("code", shown.alias("label"), F.coalesce("label", "code").alias("sort_label"))


def facet_labels(values: DataFrame, codelists: dict[str, DataFrame]) -> DataFrame:
    """``(dimension, code, label, sort_label)`` of all eight dimensions. ``codelists`` has one frame per dimension
    with a code list; a dimension without one shows its codes. Lists are ordered by the label of the code list
    (``sort_label``), whatever is shown."""
    builders = {"species": species_facet, "gear_type": gear_facet, "source_authority": authority_facet}
    parts = []
    for dimension in S.DIMENSIONS:
        mine = values_of(values, dimension)
        if dimension in codelists:
            shown = builders.get(dimension, labelled)(mine, codelists[dimension])
        else:
            shown = mine.withColumn("label", F.col("code"))
        if dimension in ("year", "gridtype"):
            shown = shown.where(F.col("code").isNotNull())
        order = "sort_label" if "sort_label" in shown.columns else "label"
        parts.append(shown.select(F.lit(dimension).alias("dimension"), "code", "label", F.col(order).alias("sort_label")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def english(label: str | Column) -> Column:
    return F.collate(label, LABEL_COLLATION)


def ordered_labels(codelist: DataFrame, group: str = "dimension") -> DataFrame:
    """Add ``pos``: the place within its list, years by number, all else in English order of the code list's
    label. A list holds the distinct codes of one dimension; a long one is ordered in many tasks."""
    number = F.when(F.col(group) == "year", F.col("code").try_cast("int"))
    placed = number_rows(codelist, [number, english("sort_label"), "code"], "pos", ["sort_label", "code"], group)
    return placed.withColumn("pos", F.col("pos").cast("int"))


def taxon_ids(species: DataFrame, matches: DataFrame) -> DataFrame:
    """Identifier of each scientific name: the last match wins; the unmatched name and NULL stay NULL."""
    last = matches.groupBy(F.col("name").alias("taxon_scientific_name")).agg(
        F.max_by("aphia_id", "pos").alias("_id")
    )
    joined = species.join(last, "taxon_scientific_name", "left")
    known = F.col("taxon_scientific_name") != S.UNMATCHED_TAXON
    return joined.withColumn("aphia_id", F.when(known, F.col("_id"))).drop("_id")
