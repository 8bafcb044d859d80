"""Edge cases: empty tables, nulls, NaN, Arabic text, odd names, constant columns, guards."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomframe.functions.expr import denan, literal_of, number, spark_format
from loomframe.operators import clean, convert, dbscan, edit, features, filters, mapping, ml, nulls, outliers, profile, stats
from loomframe.sources import readers, sinks


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(" Ann\t", " N/A", "نعم", 1.0), ("Bob", "-", "yes", float("nan")), (None, "x", None, None)], "name string, note string, active string, v double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "a string, b int, t timestamp_ntz")


def test_number_texts(spark):
    df = spark.createDataFrame([("12d",), (" 3.5 ",), ("1e3",), ("inf",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(number(F.col("t"))).collect()] == [None, 3.5, 1000.0, None, None, None]


def test_denan_and_clean(people):
    assert denan(people).where("v is null").count() == 2
    got = rows(clean.fake_nulls(clean.strip_strings(people)).select("name", "note"))
    assert got == [("Ann", None), ("Bob", None), (None, "x")]


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["a ", "a", "nan", " "])
    assert clean.clean_names(df).columns == ["a", "a_2", "column_3", "column_4"]


def test_bool_share(people):
    got = [r[0] for r in clean.bool_standardise(people, ["active"]).select("active").collect()]
    assert got == ["Yes", "Yes", None]


def test_empty_tables(empty):
    assert clean.clean(empty).count() == 0
    assert nulls.null_summary(empty).count() == 0
    assert profile.overview(empty).first()["rows"] == 0
    assert profile.quality_report(empty).where("metric = 'score'").first()["value"] == 100.0
    assert outliers.outlier_flag(empty, "b").count() == 0
    assert features.bin_equal_width(empty, "b", 3).count() == 0
    assert stats.histogram(empty, "b").count() == 0
    assert stats.kpi_value(empty, "b").first()[0] == 0.0
    assert nulls.fill_forward(empty, "a", "t").count() == 0


def test_filters_and_nulls(spark):
    df = spark.createDataFrame([(1, "ban"), (2, None), (3, "Xan")], "k int, t string")
    assert rows(filters.filter_by(df, "k", "!=", 1).select("k")) == [(2,), (3,)]
    assert rows(filters.search_all(df, "AN").select("k")) == [(1,), (3,)]
    assert rows(filters.filter_by(df, "t", "not contains", "an").select("k")) == [(2,)]
    assert rows(filters.filter_by(df, "t", ">", 5).select("k")) == []
    with pytest.raises(ValueError):
        filters.filter_multi(df, [("k", "==", 1)] * 6)


def test_forward_fill_is_pandas(spark):
    v = [None if i % 3 else float(i) for i in range(200)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "o int, v double").repartition(5)
    want = pd.Series(v, dtype="float64")
    for got, exp in ((nulls.fill_forward(df, "v", "o", rows=25), want.ffill()), (nulls.fill_backward(df, "v", "o", rows=25), want.bfill())):
        have = [r["v"] for r in got.orderBy("o").collect()]
        assert have == [None if pd.isna(x) else x for x in exp]


def test_no_single_task_window_for_rows(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    plan = nulls.fill_forward(df, "v", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # the carries, one row a range


def test_fill_types(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "k int, t string")
    assert rows(nulls.fill_const(df, "x")) == [("1", "a"), ("x", "x")]
    assert rows(nulls.fill_mean(df, ["k"])) == [(1.0, "a"), (1.0, None)]
    assert rows(nulls.fill_mode(df, ["t"])) == [(1, "a"), (None, "a")]


def test_casts(spark):
    df = spark.createDataFrame([("3.7",), ("300",), ("x",), (None,)], "t string")
    assert [r[0] for r in convert.cast_int(df, "t", 8).collect()] == [3, 0, 0, 0]
    assert [r[0] for r in convert.text_title(spark.createDataFrame([("hello-world it's",)], "t string"), "t").collect()] == ["Hello-World It'S"]
    d = spark.createDataFrame([("03/04/2024",), ("no",)], "t string")
    assert [r[0] for r in convert.cast_date(d, "t").collect()] == [datetime.date(2024, 4, 3), None]
    assert spark_format("%d/%m/%Y") == "dd/MM/yyyy" and literal_of("1.5") == 1.5 and literal_of("x") == "x"
    assert [r[0] for r in convert.keep_arabic(spark.createDataFrame([("ab نعم 1",)], "t string"), "t").collect()] == ["نعم"]


def test_formula(spark):
    df = spark.createDataFrame([(7, 2, 0)], ["Cost", "odd name", "z"])
    got = edit.computed_col(df, "x", "`odd name` * Cost % 5 + Cost // `odd name` - Cost ** 2").first()["x"]
    assert got == 14 % 5 + 3 - 49
    assert edit.computed_col(df, "x", "Cost / z").first()["x"] is None
    two = df.selectExpr("2 AS b", "3 AS c")
    assert edit.computed_col(two, "x", "b ** c ** 2").first()["x"] == 512 and edit.computed_col(two, "x", "-b ** 2").first()["x"] == -4
    for bad in ("1 + 2", "Cost + nothing", "reflect('x')", "Cost; drop", "explode(Cost)", "x" * 501, "Cost.z", "Cost[0]", "[Cost]", "{Cost: 1}", "lambda: Cost", "Cost if z else 1", "Cost == 'a'", "(Cost := 1)", "abs(Cost, 2)", "Cost is z", "__q0__ + Cost"):
        with pytest.raises(ValueError):
            edit.computed_col(df, "x", bad)


def test_edit(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k int, t string")
    assert rows(edit.delete_row(df, 1, ["k"])) == [(1, "a"), (3, None)]
    assert edit.delete_row(df, 9, ["k"]).count() == 3
    assert rows(edit.dup_count(df.select("t"))) == [(3, 1, 33.33)]
    assert [r["k"] for r in edit.sort_col(df, "t", True, ["k"]).collect()] == [1, 2, 3]
    assert edit.renumber(df, "t").schema["t"].dataType.simpleString() == "string"
    assert rows(edit.replace_regex_all(df, "a", 5)) == [(1, "5"), (2, "5"), (3, None)]


def test_features(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,)], "x double")
    assert [r["x_bin"] for r in features.bin_equal_width(df, "x", 2).collect()] == [0, 0, 1, None]
    assert features.bin_edges(df, "x", 2) == [-0.01, 5.0, 10.0]
    one = spark.createDataFrame([(5.0,)], "x double")
    assert features.bin_edges(one, "x", 2)[0] == pytest.approx(4.995)
    assert [r["x"] for r in features.scale_minmax(one, ["x"]).collect()] == [0.0]
    t = spark.createDataFrame([("b",), (None,), ("ب",)], "t string")
    assert features.one_hot(t, "t").columns == ["t", "t_b", "t_ب"]
    assert [r["label"] for r in features.label_table(t, "t", "nan").collect()] == [0, 1, 2]
    assert [r[0] for r in features.clean_text(spark.createDataFrame([(" A  ب1! ",)], "t string"), "t", digits=True, specials=True).collect()] == ["a ب"]


def test_bins_hold_the_largest_value(spark):
    """0 + (500.03 - 0) * 5 / 5 is less than 500.03."""
    df = spark.createDataFrame([(0.0,), (500.03,), (250.0,), (None,)], "x double")
    assert [r["x_bin"] for r in features.bin_equal_width(df, "x", 5).collect()] == [0, 4, 2, None]
    assert [r["x_bin"] for r in features.bin_equal_width(df, "x", 5, labels=list("abcde")).collect()] == ["a", "e", "c", None]
    assert rows(features.bin_counts(df, "x", 5)) == [(0, 1), (2, 1), (4, 1)]


def test_correlation_of_a_constant_in_partitions(spark):
    """7 / 25 * 25 is not 7, so merged means of a constant differ."""
    df = spark.range(50, numPartitions=2).select(F.col("id").alias("v"), F.lit(7).alias("c"), (2 * F.col("id")).alias("w"))
    assert rows(stats.correlation(df, ["v", "c", "w"])) == [("v", "c", None), ("v", "w", 1.0), ("c", "w", None)]


def test_outliers_constant(spark):
    df = spark.createDataFrame([(1.0,)] * 5 + [(None,)], "x double")
    assert not any(r["outlier"] for r in outliers.outlier_flag(df, "x", "zscore").collect())
    assert outliers.outlier_summary(df).count() == 0
    assert stats.correlation(df.withColumn("y", F.lit(2)), ["x", "y"]).first()["r"] is None


def test_mapping(spark):
    cols = spark.createDataFrame([("t", c) for c in ("Customer_ID", "order-date", "width", "xyz")], "table_name string, column_name string")
    got = {r["column_name"]: (r["semantic_group"], r["score"]) for r in mapping.semantic_map(cols, mapping.lexicon(spark)).collect()}
    assert got["order-date"][1] == 0.85 and got["xyz"] == ("unknown", 0.0)
    df = spark.createDataFrame([(1, 2)], ["width", "user_id"])
    assert mapping.mask_pii(df).first()[0] == "***" and mapping.mask_pii(df, whole_word=True).first()[0] == 1


def test_sources(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("name,n\nأحمد,1\n".encode("utf-8"))
    df = readers.load(spark, str(p))
    assert rows(df) == [("أحمد", 1)] and readers.probe_encoding(spark, str(p)) == "utf-8"
    (tmp_path / "l.csv").write_bytes("name,n\ncafé,1\n".encode("latin-1"))
    assert readers.probe_encoding(spark, str(tmp_path / "l.csv")) != "utf-8"
    (tmp_path / "o.json").write_text('{"a":[{"x":1,"y":{"z":2}}],"b":[{"k":1},{"k":2}],"m":1}')
    assert rows(readers.read_json_doc(spark, str(tmp_path / "o.json"))) == [(1,), (2,)]
    assert readers.read_json_doc(spark, str(tmp_path / "o.json"), "a").columns == ["x", "y.z"]
    with pytest.raises(ValueError):
        readers.read_json_doc(spark, str(tmp_path / "o.json"), "nope")
    (tmp_path / "r.jsonl").write_text('{"a":1,"l":[1,2]}\n\n{"a":2,"l":[]}\n')
    assert readers.load(spark, str(tmp_path / "r.jsonl")).count() == 2
    (tmp_path / "g.csv").write_text("Report,,\n,,\nname,price,when\nx,1,2\ny,3,4\n")
    assert readers.header_row(readers.csv_cells(spark, str(tmp_path / "g.csv"))).first()["header_line"] == 2
    with pytest.raises(ValueError):
        readers.load(spark, "dump.sql")


def test_guard_and_audit(spark, tmp_path):
    assert readers.check_select(" select 1; ") == "select 1"
    for bad in ("", "drop table x", "select 1; select 2", "with a as (select 1) delete from b"):
        with pytest.raises(ValueError):
            readers.check_select(bad)
    assert readers.masked_url("postgresql://u:secret@h/d?password=x") == "postgresql://u:***@h/d?password=***"
    (tmp_path / "bad.xlsx").write_bytes(b"hello")
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "ok.csv").write_bytes(b"a,b\n")
    (tmp_path / "x.exe").write_bytes(b"MZ")
    got = {r["path"].rsplit("/", 1)[-1]: r["verdict"] for r in readers.file_audit(spark, str(tmp_path)).collect()}
    assert got == {"bad.xlsx": "wrong content", "ok.csv": "ok", "x.exe": "unknown suffix", "empty.csv": "empty"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é")], "k int, t string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 1
    assert rows(sinks.export_summary(df)) == [(1, 2, 0)]


def test_dbscan_is_brute_force(spark):
    import random

    random.seed(5)
    pts = [(i, random.gauss(0, 1) + 6 * (i % 3), random.gauss(0, 1)) for i in range(150)] + [(900, 50.0, 50.0), (901, 6.0, 50.0), (902, 7.0, 50.0)]
    eps, least = 1.0, 4
    near = {a: [b for b, u, v in pts if (x - u) ** 2 + (y - v) ** 2 <= eps * eps] for a, x, y in pts}
    core = {a for a in near if len(near[a]) >= least}
    label = {}
    for a in sorted(core):
        if a not in label:
            todo, n = [a], a
            while todo:
                b = todo.pop()
                if b not in label:
                    label[b] = n
                    todo += [c for c in near[b] if c in core]
    for a in near:
        if a not in core:
            of = [label[b] for b in near[a] if b in core]
            label[a] = min(of) if of else None
    ids = {v: i for i, v in enumerate(sorted({label[c] for c in core}))}
    want = {a: ids.get(label[a], -1) for a in near}
    df = spark.createDataFrame(pts, "k int, x double, y double")
    assert {r["k"]: r["cluster"] for r in dbscan.dbscan(df, "k", ["x", "y"], eps, least).collect()} == want


def test_knn_vote(spark):
    df = spark.createDataFrame([(i, [float(i)], i // 5) for i in range(10)], "k int, v array<double>, y int")
    got = {r["k"]: r["prediction"] for r in ml.knn_classify(df, df, "v", "k", "y", 3).collect()}
    assert got[0] == 0 and got[9] == 1


def test_fourier_features(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    assert len(ml.fourier_features(df, "v", 4).first()["features"]) == 4


def test_pushdown(spark, sf):
    df = filters.filter_multi(spark.read.parquet(f"{sf}/orders.parquet"), [("o_totalprice", ">", 1000), ("o_orderstatus", "==", "O")]).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000" in plan and "o_orderpriority" not in plan
