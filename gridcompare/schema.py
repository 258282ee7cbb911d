"""Column names, types and fixed values shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# The eight filter dimensions, in the order the facet table uses.
DIMENSIONS = (
    "dataset",
    "gridtype",
    "species",
    "year",
    "gear_type",
    "measurement_unit",
    "source_authority",
    "fishing_fleet",
)

# Text columns every raw layout is brought to.
OBSERVATION_COLUMNS = (
    "source_authority",
    "fishing_fleet",
    "time_start",
    "time_end",
    "codesource_area",
    "gear_type",
    "species",
    "fishing_mode",
    "measurement_unit",
    "measurement_value",
)

# Grain of the grouped fact (gridtype is joined on afterwards).
GROUP_KEYS = (
    "codesource_area",
    "dataset",
    "source_authority",
    "species",
    "gear_type",
    "fishing_fleet",
    "year",
    "measurement_unit",
)

# Grain of a filtered selection.
SELECTION_KEYS = GROUP_KEYS + ("gridtype",)

GROUPED_COLUMNS = GROUP_KEYS + ("measurement_value", "gridtype")

# Spellings of a unit and the code they stand for (case-sensitive).
UNIT_ALIASES = {
    "Tons": "t",
    "MT": "t",
    "Number of fish": "no",
    "NO": "no",
}

# Grid types that keep their own name; all others become "others".
KEPT_GRIDTYPES = ("1deg_x_1deg", "5deg_x_5deg")
OTHER_GRIDTYPE = "others"
NOMINAL_GRIDTYPE = "nominal"

# Source column -> canonical column, for each published layout.
AREA_ALIAS = {"geographic_identifier": "codesource_area"}
LAYOUT_ALIASES = {
    "flag": {
        "flag": "fishing_fleet",
        "gear": "gear_type",
        "schooltype_label": "fishing_mode",
        "catchunit": "measurement_unit",
        "value": "measurement_value",
    },
    "fishingfleet": {
        "fishingfleet": "fishing_fleet",
        "gear": "gear_type",
        "schooltype": "fishing_mode",
        "unit": "measurement_unit",
        "value": "measurement_value",
    },
}

# File extensions of published datasets.
DATASET_EXTENSIONS = ("csv", "zip", "qs")

# Texts shown for values that have no label.
UNKNOWN_TAXON = "Unknown (required for effort)"
UNMATCHED_TAXON = "Thunnini"

CRS = 4326

MANIFEST_SCHEMA = T.StructType(
    [T.StructField("DOI", T.StringType()), T.StructField("Filename", T.StringType())]
)

FACT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in OBSERVATION_COLUMNS[:-1]]
    + [
        T.StructField("measurement_value", T.DoubleType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("year", T.IntegerType()),
    ]
)
