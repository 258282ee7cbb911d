import pytest
from pyspark.sql import functions as F

from gridcompare import schema as S
from gridcompare.operators import areas as A
from gridcompare.operators import ingest as I
from gridcompare.sources import files, sinks, stored


@pytest.fixture
def root(monkeypatch, tmp_path):
    monkeypatch.setattr(stored, "storage_root", lambda spark: str(tmp_path / "store"))
    stored.forget_tables()
    yield tmp_path
    stored.forget_tables()


def source(spark, root, value):
    spark.range(5).withColumn("v", F.lit(value)).write.mode("append").parquet(str(root / "input"))
    return [str(root / "input")]


def test_stored_table_is_built_once(spark, root):
    inputs, built = source(spark, root, "a"), []

    def build():
        built.append(1)
        return spark.read.parquet(*inputs)

    for _ in range(3):
        assert stored.materialise(spark, "t", inputs, build).count() == 5
        stored.forget_tables()
    assert len(built) == 1


def test_changed_input_is_noticed(spark, root):
    inputs = source(spark, root, "a")
    build = lambda: spark.read.parquet(*inputs)
    assert stored.materialise(spark, "t", inputs, build).count() == 5
    source(spark, root, "b")
    stored.forget_tables()
    assert stored.materialise(spark, "t", inputs, build).count() == 10


def test_failed_build_leaves_nothing_to_read(spark, root):
    inputs = source(spark, root, "a")
    with pytest.raises(Exception):
        stored.materialise(spark, "t", inputs, lambda: spark.range(3).select(F.raise_error(F.lit("lost")).alias("x")))
    assert stored.materialise(spark, "t", inputs, lambda: spark.range(2)).count() == 2


def test_removed_table_is_built_again(spark, root):
    inputs = source(spark, root, "a")
    key = f"t-{stored.fingerprint(spark, inputs)}"
    gone = (key, str(root / "store" / "gone"), spark.range(2).schema.json())
    spark.createDataFrame([gone], "key string, path string, schema string").write.json(str(root / "store" / "registry"))
    assert stored.materialise(spark, "t", inputs, lambda: spark.range(4)).count() == 4
    stored.forget_tables()
    assert stored.materialise(spark, "t", inputs, lambda: spark.range(9)).count() == 4


def test_layout_of_a_stored_table(spark, root):
    inputs = source(spark, root, "a")
    build = lambda: spark.createDataFrame([("007", "", 2, None), ("d", "t", 1, 1.5)], "dataset string, unit string, n int, v double")
    table = stored.materialise(spark, "t", inputs, build, partition_by=["dataset"], cluster_by=["unit", "n"])
    assert {(r["dataset"], r["unit"], r["n"], r["v"]) for r in table.collect()} == {("007", "", 2, None), ("d", "t", 1, 1.5)}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=""):
            return {"spark.master": "yarn"}.get(name, default)

    class Cluster:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stored.storage_root(Cluster())


def test_inputs_are_told_apart_by_role(spark, root):
    one = source(spark, root, "a")[0]
    two = str(root / "other")
    spark.range(1).write.parquet(two)
    assert stored.materialise(spark, "t", [one, two], lambda: spark.range(4)).count() == 4
    assert stored.materialise(spark, "t", [two, one], lambda: spark.range(9)).count() == 9


def test_databases_and_tables_are_told_apart(spark, root, monkeypatch):
    from gridcompare.sources import jdbc

    monkeypatch.setattr(jdbc, "read_fact", lambda spark, env, table, partitions: spark.createDataFrame([(env["DB_HOST"], table)], "h string, t string"))
    env = lambda host: {"DB_HOST": host, "DB_NAME": "d", "DB_USER_READONLY": "u", "DB_PASSWORD": "p"}
    for host, table in (("one", "a"), ("two", "a"), ("two", "b")):
        assert tuple(jdbc.stored_fact(spark, env(host), "v1", table).first()) == (host, table)


def test_fact_round_trip(spark, tmp_path):
    columns = {c: F.lit("x") for c in S.OBSERVATION_COLUMNS}
    raw = spark.range(4).select(*[v.alias(c) for c, v in columns.items()])
    raw = raw.withColumns({"measurement_value": F.lit("1.5"), "time_start": F.lit("2012-05-01")})
    fact = I.typed_observations(I.stack([I.harmonise(raw, "d1"), I.harmonise(raw.limit(1), "d2")]))
    sinks.write_fact(fact, str(tmp_path / "fact"))
    back = files.read_parquet_fact(spark, str(tmp_path / "fact"))
    assert {r["dataset"]: r["count"] for r in I.rows_per_dataset(back).collect()} == {"d1": 4, "d2": 1}
    assert back.agg(F.sum("measurement_value"), F.max("year")).first()[:] == (7.5, 2012)
    assert (tmp_path / "fact" / "dataset=d1").is_dir()


def test_manifest_and_areas_are_written(spark, tmp_path):
    manifest = spark.createDataFrame([("1", "T, with comma")], "record_id string, title string")
    sinks.write_manifest(manifest, str(tmp_path / "manifest"))
    assert spark.read.csv(str(tmp_path / "manifest"), header=True).first()["title"] == "T, with comma"
    areas = A.with_geometry(spark.createDataFrame([("a", "POLYGON ((0 0,1 0,1 1,0 0))")], "codesource_area string, geom_wkt string"))
    sinks.write_areas(areas, str(tmp_path / "areas"))
    back = spark.read.parquet(str(tmp_path / "areas"))
    assert back.first()["geom"] == "SRID=4326;POLYGON ((0 0,1 0,1 1,0 0))"
    assert "polygons" not in back.columns
