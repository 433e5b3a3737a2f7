"""Raw tables as CSV: the quick level of gzip, and the same rows back."""

from pathlib import Path

from pyspark.sql import functions as F

from riskgraph.sources import raw


def test_written_quickly_and_read_back(spark, tmp_path):
    wide = [F.rand(i).alias(f"feat#{i}") for i in range(1, 20)]
    rows = spark.range(2000).select(F.col("id").alias("clId"), *wide).persist()
    raw.write_raw_csv(rows, f"{tmp_path}/quick.csv")
    rows.write.option("header", True).option("compression", "gzip").csv(f"{tmp_path}/usual.csv")

    def size(name: str) -> int:
        files = list(Path(tmp_path, name).glob("*.csv.gz"))
        assert files
        return sum(f.stat().st_size for f in files)

    assert size("usual.csv") < size("quick.csv") < 1.3 * size("usual.csv")
    found = raw.read_raw_csv(spark, f"{tmp_path}/quick.csv", "background_nodes")
    assert sorted(found.collect()) == sorted(rows.collect())


def test_text_keeps_its_spaces(spark, tmp_path):
    rows = spark.createDataFrame([(1, " Suspicious"), (2, "a, \"b\" "), (3, None)], "ccId long, ccLabel string")
    raw.write_raw_csv(rows, f"{tmp_path}/labels.csv")
    assert sorted(raw.read_raw_csv(spark, f"{tmp_path}/labels.csv", "connected_components").collect())[0].ccLabel == " Suspicious"
