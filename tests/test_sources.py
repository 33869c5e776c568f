import pytest
from pyspark.sql import types as T

from wildgrid import schemas
from wildgrid.sources import readers, registry, sinks

PLAIN = T.StructType([T.StructField("key", T.LongType()), T.StructField("a", T.StringType()),
                      T.StructField("b", T.DoubleType())])


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_in_order_with_line_breaks(spark, tmp_path):
    one = write(tmp_path / "z.csv", 'key,a,b\n1,"two\nlines, ""quoted""",0.5\n2,x,\n')
    two = write(tmp_path / "a.csv", "key,a,b\n3,y,1.5\n1,late,2\n")
    df = readers.read_csv(spark, [one, two], PLAIN, keep_order=True)
    rows = df.orderBy("input_order").collect()
    assert [r["key"] for r in rows] == [1, 2, 3, 1]
    assert rows[0]["a"] == 'two\nlines, "quoted"' and rows[1]["b"] is None


def test_broken_values_are_kept_aside(spark, tmp_path):
    path = write(tmp_path / "t.csv", "key,a,b\n1,x,0.5\n2,y,not a number\n")
    rows = readers.read_csv(spark, path, PLAIN, corrupt="_bad").orderBy("key").collect()
    assert [r["_bad"] for r in rows] == [None, "2,y,not a number"]
    assert rows[1]["b"] is None


def test_keyed_csv_and_files_of_two_schemas(spark, tmp_path):
    path = write(tmp_path / "t.csv", ",a,b\n7,x,0.5\n")
    assert readers.read_keyed_csv(spark, path, PLAIN).first()["id"] == 7
    other = T.StructType([T.StructField("key", T.LongType()), T.StructField("c", T.StringType())])
    second = write(tmp_path / "u.csv", "key,c\n8,extra\n")
    df = readers.read_many(spark, [([path], PLAIN), ([second], other)])
    assert sorted(map(tuple, df.select("key", "a", "c").collect())) == [(7, "x", None), (8, None, "extra")]


def test_landed_records(spark, tmp_path):
    path = write(tmp_path / "landed.txt", "1\t7,x,0.5\\n\n2\t8,y,None\n3\t9,z,1\nbroken\n")
    got = readers.read_landed(spark, path, PLAIN, 2, 3).orderBy("index").collect()
    assert [tuple(r) for r in got] == [(2, 8, "y", None), (3, 9, "z", 1.0)]
    assert readers.read_landed(spark, path, PLAIN).where("index = 1").first()["b"] == 0.5


def test_payload_json(spark, tmp_path):
    path = write(tmp_path / "p.json", '{"timezone":"UTC","elevation":5,"hourly":{"time":["2022-01-01T00:00"],'
                                      '"rain":[null]},"daily":{"sunrise":["x"]}}\n{broken\n')
    df = readers.read_json(spark, path, schemas.weather_payload())
    row = df.where("timezone = 'UTC'").first()
    assert row["hourly"]["rain"] == [None] and row["daily"]["sunrise"] == ["x"]
    assert len(schemas.weather_snapshot()) == 52 and len(schemas.HOURLY) == 29 and len(schemas.DAILY) == 16
    assert len(schemas.RAW_OBSERVATIONS) == 25 and len(schemas.INTERIM_COLUMNS) == 20


def test_image_listing(spark, tmp_path):
    for name in ("lynx/12_a.jpg", "lynx/12_b.jpg", "lynx/12_d.jpg", "puma/9_b.jpg", "puma/10_a.jpg", "puma/note.txt"):
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_bytes(b"x")
    files = readers.list_files(spark, str(tmp_path), "*.jpg")
    assert files.count() == 5
    labels = {r["label"]: r["class_index"] for r in readers.labelled_files(files).collect()}
    assert labels == {"lynx": 0, "puma": 1}
    assert sorted(r["id"] for r in readers.file_ids(files).collect()) == [9, 10, 12, 12, 12]
    parts = {(r["id"], r["suffix"]) for r in readers.sub_images(files).collect()}
    assert parts == {(12, "a"), (12, "b"), (10, "a")}
    assert readers.sub_images(files, consecutive=False).count() == 5


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, a string")
    assert sinks.read_or_empty(spark, path, df.schema).count() == 0
    sinks.append(df, path)
    sinks.append(df, path)
    assert spark.read.parquet(path).count() == 4
    sinks.overwrite(df, path + "2", "csv")
    assert readers.read_csv(spark, path + "2", df.schema).count() == 2
    sinks.append_new(df, path + "3", "id")
    sinks.append_new(df.union(spark.createDataFrame([(3, "z")], df.schema)), path + "3", "id")
    assert sorted(r[0] for r in spark.read.parquet(path + "3").select("id").collect()) == [1, 2, 3]
    sinks.append_report(df, path + "4", taxon_level="Genus", model_type="tree")
    assert spark.read.parquet(path + "4").first()["model_type"] == "tree"
    sinks.overwrite(df, path + "5", partition_by=["a"])
    assert spark.read.parquet(path + "5").where("a = 'x'").count() == 1


def test_artefact_names(spark, tmp_path):
    assert registry.artefact_name("Puma concolor", "tree").startswith("puma_concolor_tree_")
    assert registry.artefact_name("Puma", "tree", "genus") != registry.artefact_name("puma", "tree", "genus")
    assert registry.registered(spark, str(tmp_path)).count() == 0


def test_shared_folder_needs_a_setting_on_a_cluster(spark):
    from wildgrid.operators import storage

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        storage.shared_folder(Session())


def test_files_belong_to_the_longest_path_given(spark, tmp_path):
    """One path begins the name of another; a wildcard and a folder are paths too."""
    for name, key in (("a", 1), ("ab", 2), ("b", 3)):
        (tmp_path / name).mkdir()
        write(tmp_path / name / "f.csv", f"key,a,b\n{key},x,0\n9,{name},0\n")
    paths = [str(tmp_path / n) for n in ("ab", "b", "a")]
    rows = readers.read_csv(spark, paths, PLAIN, keep_order=True).orderBy("input_order").collect()
    assert [r["key"] for r in rows] == [2, 9, 3, 9, 1, 9]
    rows = readers.read_csv(spark, [str(tmp_path / "b*"), str(tmp_path / "a*")], PLAIN, keep_order=True)
    assert [r["key"] for r in rows.orderBy("input_order").collect()][0] == 3
    from wildgrid.operators.clean import dedupe_first
    first = dedupe_first(readers.read_csv(spark, paths, PLAIN, keep_order=True), "key")
    assert first.where("key = 9").first()["a"] == "ab"


def test_append_new_takes_one_row_per_key(spark, tmp_path):
    path = str(tmp_path / "t")
    for rows in ([(1, "a"), (1, "a"), (2, "b")], [(2, "c"), (3, "d"), (3, "d")]):
        sinks.append_new(spark.createDataFrame(rows, "id long, v string"), path, "id")
    got = sorted(map(tuple, spark.read.parquet(path).collect()))
    assert got == [(1, "a"), (2, "b"), (3, "d")]


def test_all_zones_of_spark_convert(spark):
    from pyspark.sql import functions as F

    from wildgrid.functions import times

    names = ["CET", "EET", "EST5EDT", "Japan", "NZ", "Israel", "GB", "Greenwich", "PST", "Asia/Tokyo", "No/Where", None]
    df = spark.createDataFrame([(n,) for n in names], "z string").withColumn("t", F.lit("2022-08-02 00:40:00").cast("timestamp"))
    got = {r["z"]: r["l"] for r in df.select("z", times.local_time_text("t", "z").alias("l")).collect()}
    assert [n for n in names if got[n] is None] == ["No/Where", None]
    assert got["CET"] == "2022-08-02 02:40:00+02:00"


def test_steps_are_removed_at_the_end_of_a_job(spark, tmp_path):
    import os

    from wildgrid.operators import storage

    made = []
    with storage.steps_removed(spark):
        for _ in range(2):
            df = storage.settle(spark.range(3), "scoped")
            made += [f.split(":", 1)[-1] for f in df.inputFiles()]
            assert df.count() == 3
    outside = storage.settle(spark.range(3), "kept")
    assert made and not any(os.path.exists(m.replace("///", "/")) for m in made) and outside.count() == 3


def test_ties_go_to_the_least_row(spark, tmp_path):
    """Equal orders, repeated keys of a batch: the same rows for any number of partitions."""
    from wildgrid.operators.clean import dedupe_first, least_rows
    from wildgrid.sources.sinks import append_new

    rows = [(i % 20, i % 2, 1000 - i) for i in range(400)] + [(None, 0, 7), (None, 0, 3), (99, None, 5)]
    df = spark.createDataFrame(rows, "key long, at long, v long")
    found = []
    for n in (1, 3, 16):
        dealt = df.repartition(n)
        first = sorted(dedupe_first(dealt, "key", "at").collect(), key=str)
        target = str(tmp_path / f"t{n}")
        append_new(dealt.where("key is not null"), target, "key")
        append_new(dealt.where("key is not null"), target, "key")
        found.append((first, sorted(spark.read.parquet(target).collect(), key=str)))
    assert found[0] == found[1] == found[2]
    kept = {r["key"]: (r["at"], r["v"]) for r in found[0][0]}
    assert len(found[0][0]) == 22 and kept[None] == (0, 3) and kept[99] == (None, 5)
    for key in range(20):
        assert kept[key] == min((a, v) for k, a, v in rows if k == key)
    maps = df.where("key < 3").selectExpr("key", "map('v', v) as m")
    assert least_rows(maps, "key").count() == 3
