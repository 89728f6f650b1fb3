"""Sources, sinks and the registry."""

import os

import pytest

from sparkeda.sources import files as S
from sparkeda.sources import jdbc as J
from sparkeda.sources.registry import Registry, make_key


def test_csv_bom_nulls_and_load(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "est.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write("ID,Nombre,Edad,Promedio\n1,Ana,20,9.5\n2,,21,NaN\n3,NA,22,8.0\n")
    df = S.load(spark, p)
    assert df.columns == ["ID", "Nombre", "Edad", "Promedio"]
    rows = df.orderBy("ID").collect()
    assert rows[1].Nombre is None and rows[2].Nombre is None and rows[1].Promedio is None
    ds = S.load(spark, p, as_dataset=True)
    assert ds.name == "est" and ds.shape() == (3, 4)


def test_tsv_json_errors(spark, tmpdir_path):
    t = os.path.join(tmpdir_path, "g.txt")
    open(t, "w").write("a\tb\n1\tx\n")
    assert S.load(spark, t).collect()[0].b == "x"
    j = os.path.join(tmpdir_path, "r.json")
    open(j, "w").write('[{"a": 1}, {"a": 2}]')
    assert S.load(spark, j).count() == 2
    with pytest.raises(ValueError, match="valid formats"):
        S.load(spark, os.path.join(tmpdir_path, "x.xlsx"))
    with pytest.raises(FileNotFoundError):
        S.load(spark, os.path.join(tmpdir_path, "missing.csv"))


def test_save_roundtrip_and_metadata(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    for ext in ("csv", "tsv", "json", "parquet", "weird"):
        out = os.path.join(tmpdir_path, f"o.{ext}")
        S.save(df, out)
        fmt = {"tsv": "csv", "weird": "csv"}.get(ext, ext)
        r = spark.read.format(fmt).option("header", True).option("sep", "\t" if ext == "tsv" else ",").load(out)
        assert r.count() == 2
    meta = os.path.join(tmpdir_path, "meta")
    S.write_run_metadata(spark, meta, "https://x", 200, "simple", 0.5, 10, ["link"])
    S.write_run_metadata(spark, meta, "https://y", 404, "simple", 0.1, 0, [])
    assert spark.read.json(meta).count() == 2


def test_registry_keys(spark):
    assert make_key("My Data", {"my_data", "my_data_2"}) == "my_data_3"
    r = Registry(spark)
    df = spark.range(3)
    assert r.register(df, "Sales Q1") == "sales_q1"
    assert r.register(df, "Sales Q1") == "sales_q1_2"
    assert spark.sql("SELECT count(*) c FROM sales_q1_2").first().c == 3
    lst = {x.key: x.rows for x in r.list().collect()}
    assert lst == {"sales_q1": 3, "sales_q1_2": 3}


def test_jdbc_derby_roundtrip(spark, tmpdir_path):
    url = f"jdbc:derby:memory:sparkeda{abs(hash(tmpdir_path)) % 10**8};create=true"
    props = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.createDataFrame([(i, f"n{i}", i * 1.5) for i in range(100)], "ID int, NAME string, SCORE double")
    df.write.format("jdbc").option("url", url).option("dbtable", "STUDENTS").option("driver", props["driver"]).save()
    t = J.read_table(spark, url, "STUDENTS", partition_column="ID", num_partitions=3, properties=props)
    assert t.rdd.getNumPartitions() == 3 and t.count() == 100
    f = t.where("SCORE > 100").select("NAME")
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and f.count() == 33
    q = J.read_query(spark, url, "SELECT NAME FROM STUDENTS WHERE ID < 5;", properties=props)
    assert q.count() == 5
    assert "STUDENTS" in [r.table_name for r in J.list_tables(spark, url, props).collect()]
    sch = {r.column for r in J.table_schema(spark, url, "STUDENTS", props).collect()}
    assert sch == {"ID", "NAME", "SCORE"}
    reg = Registry(spark)
    keys = J.load_many(spark, reg, url, ["STUDENTS"], properties=props)
    assert keys == ["sql_students"]


def test_csv_round_trip_with_quotes_breaks_and_na(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "q.csv")
    with open(p, "w", newline="") as f:
        f.write('id,text,n,d,b\n1,"he said ""hi"", ok",1,2024-01-02,true\n2,"two\nlines",NA,2024-02-03,false\n3,NA,3,,true\n')
    df = S.load(spark, p)
    assert dict(df.dtypes) == {"id": "int", "text": "string", "n": "int", "d": "date", "b": "boolean"}
    rows = df.orderBy("id").collect()
    assert [r.text for r in rows] == ['he said "hi", ok', "two\nlines", None] and [r.n for r in rows] == [1, None, 3]
    out = os.path.join(tmpdir_path, "out.csv")
    S.save(df, out)
    assert sorted(map(str, S.load(spark, out).collect())) == sorted(map(str, rows))


def test_json_is_not_guessed_and_keeps_nulls(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "p.json")
    open(p, "w").write('{\n "a": 1\n}')
    assert S.read_json(spark, p, multi_line=True).first().a == 1
    with pytest.raises(Exception):
        S.read_json(spark, p).collect()
    out = os.path.join(tmpdir_path, "n.json")
    S.save(spark.createDataFrame([(1, None)], "x int, y string"), out)
    assert S.load(spark, out).columns == ["x", "y"]


def test_nan_is_missing_everywhere(spark, tmpdir_path):
    from sparkeda.operators import clean as C, profile as P
    nan, p = float("nan"), os.path.join(tmpdir_path, "n.parquet")
    raw = spark.createDataFrame([(1.0, "a"), (nan, "b"), (3.0, None)], "v double, s string")
    raw.write.parquet(p)
    assert S.load(spark, p).where("v IS NULL").count() == 1
    assert {r.column_name: r.nulls for r in P.null_profile(raw).collect()} == {"v": 1, "s": 1, "(total)": 2}
    assert {r.column_name: (r.nulls, r.distinct) for r in P.column_profile(raw).collect()} == {"v": (1, 2), "s": (1, 2)}
    assert P.shape_metrics(raw).first().nulls == 2
    assert sorted(r.v for r in C.Imputer("mean").fit_transform(raw).collect()) == [1.0, 2.0, 3.0]
    for method in ("zscore", "minmax"):
        got = [r.v for r in C.Scaler(method).fit_transform(raw).collect()]
        assert got[1] is None and got[0] == pytest.approx(-0.7071 if method == "zscore" else 0.0, abs=1e-4)


def test_registry_takes_any_file_name(spark):
    r = Registry(spark)
    assert r.register(spark.range(2), "ventas-2024.csv") == "ventas-2024.csv" and spark.table("ventas_2024_csv").count() == 2
    assert r.register(spark.range(4), "ventas 2024.csv") == "ventas_2024.csv_2"
    r.drop("ventas-2024.csv")


def test_catalogue_gives_keys_nullability_and_splits(spark, tmpdir_path):
    url = f"jdbc:derby:memory:sparkedakeys{abs(hash(tmpdir_path)) % 10**8};create=true"
    props = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(1).write.format("jdbc").option("url", url).option("dbtable", "X").option("driver", props["driver"]).save()
    con = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    st = con.createStatement()
    st.execute("CREATE TABLE TAKEN_N (ID INT NOT NULL PRIMARY KEY, NAME VARCHAR(20) DEFAULT 'x', SCORE DOUBLE NOT NULL)")
    st.execute("CREATE TABLE TAKENXN (A INT, B INT)")
    for k in range(40):
        st.execute(f"INSERT INTO TAKEN_N VALUES ({k}, 'n{k}', {k}.5)")
    con.close()
    got = [tuple(r) for r in J.table_schema(spark, url, "taken_n", props).collect()]
    assert got == [("ID", "INTEGER", False, "PRI", None), ("NAME", "VARCHAR", True, "", "'x'"), ("SCORE", "DOUBLE", False, "", None)]
    t = J.read_table(spark, url, "TAKEN_N", properties=props, num_partitions=4)
    assert t.rdd.getNumPartitions() == 4 and t.count() == 40
    assert J.read_table(spark, url, "TAKENXN", properties=props).rdd.getNumPartitions() == 1
    reg = Registry(spark)
    J.load_many(spark, reg, url, ["TAKEN_N"], properties=props)
    assert spark.table("sql_taken_n").rdd.getNumPartitions() > 1
    with pytest.raises(ValueError):
        J.table_schema(spark, url, "TAKEN_N'; DROP TABLE X; --", props)


def test_csv_reads_in_splits_unless_a_field_breaks(spark, tmpdir_path):
    plain, broken = os.path.join(tmpdir_path, "plain.csv"), os.path.join(tmpdir_path, "broken.csv")
    with open(plain, "w") as f:
        f.write("a,b\n" + "".join(f'{k},"x ""{k}"" y"\n' for k in range(3000)))
    with open(broken, "w") as f:
        f.write('a,b\n1,"x\ny"\n2,z\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        assert S.read_csv(spark, plain).rdd.getNumPartitions() > 1 and S.read_csv(spark, plain).count() == 3000
        assert S.read_csv(spark, broken).where("a = 1").first().b == "x\ny" and S.read_csv(spark, broken, multi_line=False).count() != 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_save_does_not_overwrite(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "o.parquet")
    S.save(spark.range(5).toDF("x"), out)
    with pytest.raises(Exception):
        S.save(spark.range(3).toDF("x"), out)
    with pytest.raises(ValueError):
        S.save(S.load(spark, out).where("x > 1"), out, mode="overwrite")
    S.save(spark.range(3).toDF("x"), out, mode="overwrite")
    assert S.load(spark, out).count() == 3
