"""Raw files, stores and gates."""

import pytest
from pyspark.sql import functions as F

from riskgraph.errors import IntegrityError
from riskgraph.session import new_scratch_path, scratch_root
from riskgraph.sources import raw, stores


@pytest.fixture()
def folder(spark, tmp_path):
    files = {
        "connected_components": "ccId,ccLabel\n1, suspicious\n2,licit\n3,unknown\n",
        "nodes": "clId,ccId\n10,1\n11,1\n20,2\n",
        "edges": "clId1,clId2,txId\n10,11,100\n",
        "background_nodes": "clId,feat#1,feat#2\n10,0.5,1\n99,1.5,2\n",
        "background_edges": "clId1,clId2,txId,feat#1\n10,11,100,3.25\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


def test_scan_types_and_manifest(spark, folder):
    tables = raw.scan_raw_tables(spark, folder)
    assert tables["background_nodes"].dtypes == [("clId", "bigint"), ("feat#1", "double"), ("feat#2", "double")]
    assert raw.typed_components(tables["connected_components"]).collect() == [(1, 1), (2, 0), (3, None)]
    manifest = raw.schema_manifest(tables).collect()
    assert len(manifest) == 2 + 2 + 3 + 3 + 4
    assert {(r.name, r.rows) for r in manifest} == {
        ("connected_components", 3), ("nodes", 3), ("edges", 1), ("background_nodes", 2), ("background_edges", 1)
    }


def test_missing_file_is_named(spark, folder, tmp_path):
    (tmp_path / "edges.csv").unlink()
    with pytest.raises(IntegrityError, match="edges.csv"):
        raw.scan_raw_tables(spark, folder)
    presence = {r.name: r.present for r in raw.source_presence(spark, folder, ["edges.csv", "nodes.csv"]).collect()}
    assert presence == {"edges.csv": False, "nodes.csv": True}


def test_missing_key_column_is_named(spark, folder, tmp_path):
    (tmp_path / "nodes.csv").write_text("clId,other\n1,2\n")
    with pytest.raises(IntegrityError, match="ccId"):
        raw.read_raw_csv(spark, f"{folder}/nodes.csv", "nodes")


def test_store_round_trips(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 0, None)], "component_id long, label int, v double")
    path = stores.write_store(df, new_scratch_path(spark, "s"))
    assert sorted(stores.read_store(spark, path).collect()) == sorted(df.collect())
    assert stores.read_store(spark, path, ["v"]).columns == ["v"]
    csv = stores.write_result_csv(df, new_scratch_path(spark, "r") + ".csv")
    assert sorted(stores.read_store(spark, csv, schema=df.schema).collect()) == sorted(df.collect())
    assert stores.read_store(spark, csv).count() == 2


def test_scratch_folder_follows_the_session_setting(spark):
    class Named:
        class sparkContext:
            applicationId, master = "app-1", "spark://cluster"

        class conf:
            @staticmethod
            def get(key, default=None):
                return "hdfs://shared/checkpoints" if key == "spark.checkpoint.dir" else default

    assert scratch_root(Named) == "hdfs://shared/checkpoints/riskgraph/app-1"

    class Unset(Named):
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        scratch_root(Unset)


def test_a_field_of_the_wrong_type_stops_the_run(spark, folder, tmp_path):
    (tmp_path / "nodes.csv").write_text("clId,ccId\nxx,1\n11,1\n")
    with pytest.raises(Exception, match="FAILFAST|Malformed"):
        raw.read_raw_csv(spark, str(tmp_path / "nodes.csv"), "nodes").collect()
    with pytest.raises(Exception, match="FAILFAST|Malformed"):
        stores.read_store(spark, str(tmp_path / "nodes.csv"), schema=raw.read_raw_csv(spark, str(tmp_path / "nodes.csv"), "nodes").schema).collect()


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    parts = []
    for i, name in enumerate(("left_part", "right_part", "third_part")):
        df = spark.range(i, 500).select(F.col("id").alias("component id"), (F.col("id") * i).alias(f"v{i}"))
        parts.append(stores.write_bucketed(df, name, str(tmp_path / name), "component id", 4))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = parts[0].join(parts[1], "component id", "left").join(parts[2], "component id", "left")
        folded = joined.groupBy("component id").agg(F.max("v2").alias("v2"))
        assert "Exchange" not in folded._jdf.queryExecution().executedPlan().toString()
        assert folded.count() == 500 and folded.filter("v2 IS NULL").count() == 2
        # Another session knows the files, not the name.
        again = stores.open_bucketed(spark, "reopened", str(tmp_path / "left_part"), parts[0].schema, "component id", 4)
        plan = again.join(parts[1], "component id")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and again.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("left_part", "right_part", "third_part", "reopened"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
