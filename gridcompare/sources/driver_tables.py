"""Binding of the test tables to the published file shapes (FIXTURES.md, section 2).

Every frame is derived row by row from the tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridcompare import schema as S
from gridcompare.functions.scalars import recode_gridtype
from gridcompare.operators import areas as A
from gridcompare.operators import grouped as GR
from gridcompare.operators import ingest as I
from gridcompare.operators import spatial as SP
from gridcompare.operators.selection import Selection
from gridcompare.sources.stored import StoredTables, materialise, materialise_parts

LEVEL0 = "global_nominal_catch_firms_level0"
LEVEL1 = "global_catch_level1"
LEVEL2 = "global_catch_level2"
DATASETS = (LEVEL0, LEVEL1, LEVEL2)

DEFAULT = Selection(
    species=("PROMO", "SMALL", "ECONOMY"),
    year=(1996, 1997, 1998, 1999),
    measurement_unit=("t",),
    gridtype=("1deg_x_1deg", "5deg_x_5deg", "others"),
    fishing_fleet=tuple(f"NATION_{i}" for i in range(15)),
    gear_type=tuple(f"Brand#{i}" for i in range(2, 26)),
    polygon=Selection.default().polygon,
)
SECOND_RECTANGLE = "POLYGON ((-160 60,20 60,20 -75,-160 -75,-160 60))"
EMPTY_RECTANGLE = "POLYGON ((170 89.5,179 89.5,179 85,170 85,170 89.5))"
NOTCHED_POLYGON = "POLYGON ((-160 -70,160 -70,160 70,40 70,40 -20,-60 -20,-60 70,-160 70,-160 -70))"
HOLED_POLYGONS = (
    "MULTIPOLYGON (((-160 -70,60 -70,60 70,-160 70,-160 -70),(-100 -30,-100 40,-20 40,-20 -30,-100 -30)),"
    "((80 -70,160 -70,160 70,80 70,80 -70)))"
)
NARROW = DEFAULT.with_values(species=("PROMO",), year=(1997, 1998))
IMPOSSIBLE = DEFAULT.with_values(species=("NONE",))

TASK_LINES = 1 << 19
FEW_TASKS = 8

_columns: dict[tuple[str, str], StructType] = {}


class DriverTables(StoredTables):
    """The published inputs seen through the test tables of one scale factor."""


    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        """One test table. Its columns are looked up in the file once per session."""
        key = (self.spark.sparkContext.applicationId, self.path(name))
        if key not in _columns:
            _columns[key] = self.spark.read.parquet(self.path(name)).schema
        return self.spark.read.schema(_columns[key]).parquet(self.path(name))

    # -- facts ------------------------------------------------------------------------------

    def raw_catch(self) -> DataFrame:
        """Observations as text in canonical names."""
        nation = self.table("nation")
        fleets = (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("o_orderkey", F.col("n_name").alias("fishing_fleet"))
        )
        authorities = (
            self.table("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", F.col("r_name").alias("source_authority"))
        )
        date = F.col("l_shipdate").cast("date").cast("string")
        unit = F.col("l_linenumber")
        return (
            self._lines()
            .join(fleets, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(authorities, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                "source_authority",
                "fishing_fleet",
                date.alias("time_start"),
                date.alias("time_end"),
                _area_code(),
                F.col("p_brand").alias("gear_type"),
                F.col("p_type").alias("species"),
                F.col("l_linestatus").alias("fishing_mode"),
                F.when(unit == 1, "MT")
                .when(unit == 2, "Tons")
                .when(unit == 3, "t")
                .when(unit == 4, "NO")
                .when(unit == 5, "Number of fish")
                .when(unit == 6, "no")
                .otherwise("HOOKS")
                .alias("measurement_unit"),
                F.when(F.col("l_orderkey") % 97 == 0, "n/a")
                .otherwise(F.col("l_quantity").cast("string"))
                .alias("measurement_value"),
                F.when(F.col("l_returnflag") == "N", LEVEL0)
                .when(F.col("l_returnflag") == "A", LEVEL1)
                .otherwise(LEVEL2)
                .alias("dataset"),
            )
        )

    def _lines(self) -> DataFrame:
        """Order lines. Many of them are dealt by order to as many tasks as their number asks for (read from the
        files' footers). By bytes adaptive execution would give a task millions of them, as they are short before they
        are joined, and the task's sums need memory for every one."""
        lines = self.table("lineitem")
        tasks = -(-lines.count() // TASK_LINES)
        if tasks <= FEW_TASKS:
            return lines
        # With fewer than Spark's own number the join would deal them again.
        return lines.repartition(max(tasks, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "l_orderkey")

    def layouts(self) -> dict[str, DataFrame]:
        """The three published layouts: level 0, level 1 and level 2 with their own column names."""
        raw = materialise(self.spark, "raw_catch", self.fact_inputs(), self.raw_catch, partition_by=["dataset"])

        def published(dataset: str, names: dict[str, str]) -> DataFrame:
            return raw.where(F.col("dataset") == dataset).drop("dataset").withColumnsRenamed(names)

        return {
            LEVEL0: published(LEVEL0, {"codesource_area": "geographic_identifier"}),
            LEVEL1: published(
                LEVEL1,
                {
                    "codesource_area": "geographic_identifier",
                    "fishing_fleet": "flag",
                    "gear_type": "gear",
                    "fishing_mode": "schooltype_label",
                    "measurement_unit": "catchunit",
                    "measurement_value": "value",
                },
            ),
            LEVEL2: published(
                LEVEL2,
                {
                    "fishing_fleet": "fishingfleet",
                    "gear_type": "gear",
                    "fishing_mode": "schooltype",
                    "measurement_unit": "unit",
                    "measurement_value": "value",
                },
            ),
        }

    def harmonised(self) -> DataFrame:
        return I.stack(I.harmonise(raw, dataset) for dataset, raw in self.layouts().items())

    def facts(self) -> DataFrame:
        """The typed fact, from one pass over the tables."""
        return I.typed_observations(self.raw_catch())

    def grouped_parts(self, datasets) -> DataFrame:
        """The grouped fact of some datasets, stored dataset by dataset."""
        inputs = self.fact_inputs() + self.area_inputs()

        def build(missing: list[str]) -> DataFrame:
            return GR.grouped_fact(self.facts().where(F.col("dataset").isin(missing)), self.areas())

        parts = {dataset: inputs for dataset in datasets}
        return materialise_parts(self.spark, "grouped_parts", parts, build, "dataset", ["measurement_unit", "species", "year"])

    # -- areas ------------------------------------------------------------------------------

    def _placed(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").where(k % 9 != 5).select(
            k.alias("k"),
            k.cast("string").alias("code"),
            (k * 37 % 320 - 160).cast("int").alias("x0"),
            (k * 17 % 140 - 70).cast("int").alias("y0"),
        )

    def area_grid_source(self) -> DataFrame:
        kind = F.col("k") % 4
        sized = self._placed().where(kind != 3).select(
            "*",
            F.when(kind == 0, "1deg_x_1deg").when(kind == 1, "5deg_x_5deg").otherwise("20deg_x_20deg").alias("GRIDTYPE"),
            F.when(kind == 0, 1).when(kind == 1, 5).otherwise(20).alias("sz"),
        )
        x0, y0 = F.col("x0"), F.col("y0")
        x1, y1 = x0 + F.col("sz"), y0 + F.col("sz")
        return sized.select("code", "GRIDTYPE", _closed_ring("POLYGON ((", [(x0, y0), (x1, y0), (x1, y1), (x0, y1)], "))").alias("geom_wkt"))

    def area_nominal_source(self) -> DataFrame:
        x0, y0 = F.col("x0"), F.col("y0")
        corners = [(x0, y0), (x0 + 6, y0), (x0, y0 + 6)]
        return self._placed().where(F.col("k") % 4 == 3).select(
            "code", _closed_ring("POLYGON ((", corners, "))").alias("geom_wkt")
        )

    def area_sources(self) -> DataFrame:
        """Both lists as published: code, grid type and geometry text."""
        grid = self.area_grid_source().select("code", recode_gridtype("GRIDTYPE").alias("gridtype"), "geom_wkt")
        nominal = self.area_nominal_source().withColumn("gridtype", F.lit(S.NOMINAL_GRIDTYPE))
        return grid.unionByName(nominal).withColumnRenamed("code", "codesource_area")

    def facts_with_geometry(self) -> DataFrame:
        """Facts that carry the geometry of their area, with the order number as row id."""
        facts = self.table("lineitem").select(_area_code(), F.col("l_orderkey").cast("int").alias("ogc_fid"))
        return facts.join(self.area_sources(), "codesource_area", "left")

    def area_multi(self) -> DataFrame:
        """Grid areas as multi-polygons of one to three unit squares, each two degrees further east."""
        x0, y0 = F.col("x0"), F.col("y0")

        def square(i):
            x = x0 + 2 * i
            return _closed_ring("((", [(x, y0), (x + 1, y0), (x + 1, y0 + 1), (x, y0 + 1)], "))")

        squares = F.transform(F.sequence(F.lit(0), (F.col("k") % 3).cast("int")), square)
        return self._placed().where(F.col("k") % 4 != 3).select(
            F.col("code").alias("codesource_area"),
            F.concat(F.lit("MULTIPOLYGON ("), F.array_join(squares, ","), F.lit(")")).alias("geom_wkt"),
        )

    def areas_unnumbered(self) -> DataFrame:
        return A.area_dimension(A.grid_areas(self.area_grid_source()), A.nominal_areas(self.area_nominal_source()))

    def build_areas(self) -> DataFrame:
        return A.numbered(self.areas_unnumbered())

    def area_inputs(self) -> list[str]:
        return [self.path("supplier")]

    def fact_inputs(self) -> list[str]:
        return [self.path(t) for t in ("lineitem", "orders", "customer", "nation", "region", "part", "supplier")]

    # -- manifest, code lists, drawn features -------------------------------------------------

    def manifest(self) -> DataFrame:
        doc = F.col("doc_id")
        extension = F.when(doc % 3 == 0, ".csv").when(doc % 3 == 1, ".zip").otherwise(".qs")
        return self.table("documents").select(
            F.concat(F.lit("10.5281/zenodo."), doc.cast("string")).alias("DOI"),
            F.concat(F.lit("global_catch_"), "source", F.lit("_"), "lang", extension).alias("Filename"),
        )

    def records(self) -> DataFrame:
        record = F.col("doc_id").cast("string")
        return self.table("labels").select(
            record.alias("record_id"),
            F.when(F.col("quality") == 1, F.concat(F.lit("urn:title-"), record)).alias("title"),
            F.concat(F.lit("urn:id-"), F.col("toxic").cast("string")).alias("identifier"),
        )

    def codelists(self) -> dict[str, DataFrame]:
        nation, region, part = self.table("nation"), self.table("region"), self.table("part")
        name, brand, kind = F.col("n_name"), F.col("p_brand"), F.col("p_type")
        units = [("t", "Tons of fish (catch unit)"), ("no", "Number of fish (catch unit)")]
        return {
            "fishing_fleet": nation.select(
                name.alias("code"),
                F.when(F.col("n_nationkey") % 6 != 0, F.concat(F.lit("Fleet "), name)).alias("label"),
            ),
            "source_authority": region.select(
                F.col("r_name").alias("code"),
                F.col("r_name").alias("label"),
                F.concat(F.lit("Commission "), F.col("r_name")).alias("definition"),
            ),
            "gear_type": part.where(brand != "Brand#3")
            .select(brand.alias("code"), F.concat(F.lit("Gear "), brand).alias("label"))
            .distinct(),
            "species": part.where(kind != "STANDARD")
            .select(
                kind.alias("code"),
                F.concat(F.lit("Label "), kind).alias("label"),
                F.when(kind != "LARGE", F.concat(F.lit("Taxon "), kind)).alias("taxon_scientific_name"),
            )
            .distinct(),
            "measurement_unit": self.spark.createDataFrame(units, "code string, label string"),
        }

    def taxon_matches(self) -> DataFrame:
        return self.table("part").select(
            F.concat(F.lit("Taxon "), F.col("p_type")).alias("name"),
            F.col("p_partkey").cast("int").alias("pos"),
            (F.col("p_partkey") + 1000).cast("int").alias("aphia_id"),
        )

    def drawn_features(self) -> DataFrame:
        e = F.col("event_id")
        placed = self.table("events").select(
            "event_id",
            (e * 7 % 300 - 150).cast("int").alias("x0"),
            (e * 11 % 120 - 60).cast("int").alias("y0"),
            (1 + e % 20).cast("int").alias("w"),
            (1 + e % 13).cast("int").alias("h"),
        )
        x0, y0 = F.col("x0"), F.col("y0")
        x1, y1 = x0 + F.col("w"), y0 + F.col("h")
        vertices = [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]
        pairs = [F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]")) for x, y in vertices]
        feature = F.concat(F.lit('{"geometry":{"coordinates":[['), F.concat_ws(",", *pairs), F.lit("]]}}"))
        return placed.select("event_id", feature.alias("feature"))

    def drawn_frames(self) -> DataFrame:
        """The drawn rectangles as holes of frames three degrees wide."""
        e = F.col("event_id")
        x0, y0 = (e * 7 % 300 - 150).cast("int"), (e * 11 % 120 - 60).cast("int")
        x1, y1 = x0 + (1 + e % 20).cast("int"), y0 + (1 + e % 13).cast("int")

        def ring(left, low, right, high):
            corners = [(left, low), (left, high), (right, high), (right, low), (left, low)]
            pairs = [F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]")) for x, y in corners]
            return F.concat(F.lit("["), F.concat_ws(",", *pairs), F.lit("]"))

        rings = F.concat_ws(",", ring(x0 - 3, y0 - 3, x1 + 3, y1 + 3), ring(x0, y0, x1, y1))
        feature = F.concat(F.lit('{"geometry":{"type":"Polygon","coordinates":['), rings, F.lit("]}}"))
        return SP.drawn_polygons(self.table("events").select("event_id", feature.alias("feature")))

    def drawn(self) -> DataFrame:
        """The drawn rectangles, read from their features once and stored."""
        return materialise(
            self.spark, "drawn", [self.path("events")], lambda: SP.drawn_rectangles(self.drawn_features())
        )


def _area_code():
    return F.when(F.col("l_suppkey") % 20 != 7, F.col("l_suppkey").cast("string")).alias("codesource_area")


def _closed_ring(before: str, corners, after: str):
    pairs = [F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in [*corners, corners[0]]]
    return F.concat(F.lit(before), F.concat_ws(",", *pairs), F.lit(after))
