"""The landing source and the database catalog."""

import uuid

from pyspark.sql import functions as F

from loomframe.sources import readers
from loomframe.sources.landing import FILES, landing


def test_landing_reads_heads_only(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "empty.csv").write_bytes(b"")
    (tmp_path / "in" / "deep" / "q.csv").write_bytes('﻿"Report, 1",,\n"a\nb","x ""y""",é\n1,2,3\n'.encode() * 30)
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"")
    (tmp_path / "in" / ".hidden.csv").write_bytes(b"a")
    with open(tmp_path / "in" / "large.bin", "wb") as f:  # sparse: 3 GB, more than one value of a column could hold
        f.truncate(3 << 30)
    got = {r.path.rsplit("/", 1)[-1]: r for r in landing(spark, str(tmp_path / "in"), 2).collect()}
    assert set(got) == {"empty.csv", "q.csv", "large.bin"}
    assert got["empty.csv"].length == 0 and got["empty.csv"].records == [] and got["large.bin"].length == 3 << 30 and len(got["large.bin"].head) == 64
    assert got["q.csv"].records == [["Report, 1", "", ""], ["a\nb", 'x "y"', "é"]]
    audit = {r.path.rsplit("/", 1)[-1]: r.verdict for r in readers.file_audit(spark, "file://" + str(tmp_path / "in")).collect()}
    assert audit == {"empty.csv": "empty", "q.csv": "ok", "large.bin": "too large"}
    (tmp_path / "none").mkdir()
    assert landing(spark, str(tmp_path / "none")).count() == 0


def test_landing_deals_files_to_tasks(spark, tmp_path):
    for i in range(FILES + 1):
        (tmp_path / f"{i}.txt").write_bytes(b"x")
    assert landing(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() == 2


def test_catalog_of_a_database(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    spark.range(5).write.format("jdbc").options(url=url, dbtable='"od""d"').save()
    spark.range(3).write.format("jdbc").options(url=url, dbtable="b").save()
    con = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    for text in ('CREATE VIEW v AS SELECT * FROM "od""d" WHERE "id" > 1', "CREATE VIEW broken AS SELECT 1 / (\"id\" - \"id\") AS x FROM b WHERE 1 / (\"id\" - \"id\") > 0", "CREATE SCHEMA other", "CREATE TABLE other.t (a INT)"):
        con.createStatement().execute(text)
    con.close()
    got = [tuple(r) for r in readers.database_catalog(spark, url).collect()]
    assert got == [("B", "table", 3), ("OTHER.T", "table", 0), ('od"d', "table", 5), ("BROKEN", "view", None), ("V", "view", 3)]
    assert readers.largest_of(readers.database_catalog(spark, url)).collect() == [('od"d', "table", 5)]
    assert [r.name for r in readers.database_catalog(spark, url, "OTHER").collect()] == ["OTHER.T"]
