from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import sinks, tables
from tessera.streaming import events


def test_found_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("note,,\nmore,,\n SeqId ,Target,Target\ns1,x,y\ns2,z,\n")
    df = tables.read_with_found_header(spark, str(tmp_path / "a.csv"), "SeqId")
    assert df.columns == ["SeqId", "Target", "Target.1"] and df.count() == 2
    with pytest.raises(ValueError):
        tables.read_with_found_header(spark, str(tmp_path / "a.csv"), "Absent")


def test_matrix_text(spark, tmp_path):
    (tmp_path / "m.adat").write_text("!Version\t1\n^TABLE_BEGIN\nSampleId\tseq.1\tseq.2\na\t1.5\tx\nb\t2\t3\n")
    rows = sorted(tuple(r) for r in tables.read_matrix_text(spark, str(tmp_path / "m.adat"), "SampleId").where("feature LIKE 'seq%'").collect())
    assert rows == sorted([("a", "seq.1", 1.5), ("a", "seq.2", None), ("b", "seq.1", 2.0), ("b", "seq.2", 3.0)], key=str)


def test_csv_schema_and_manifest(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.DoubleType())])
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], schema)
    sinks.write_csv(df, str(tmp_path / "out"), one_file=True)
    back = tables.read_csv(spark, str(tmp_path / "out"), schema)
    assert sorted(tuple(r) for r in back.collect()) == [("a", 1.0), ("b", 2.0)]
    m = tables.file_manifest(spark, str(tmp_path / "out"), "*.csv").collect()
    assert len(m) == 1 and len(m[0]["md5"]) == 32 and m[0]["bytes"] > 0
    with pytest.raises(ValueError):
        tables.require_schema(df.drop("v"), schema)


def test_replace_append_cache_and_design(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.replace(spark.range(3), p)
    sinks.replace(spark.range(5), p)
    assert spark.read.parquet(p).count() == 5 and [x.name for x in tmp_path.iterdir()] == ["t"]
    sinks.append(spark.range(2), p)
    assert spark.read.parquet(p).count() == 7
    made = []
    make = lambda: made.append(1) or spark.range(4)
    assert sinks.cached(spark, str(tmp_path / "c"), make).count() == sinks.cached(spark, str(tmp_path / "c"), make).count() == 4 and len(made) == 1
    q = str(tmp_path / "d")
    sinks.write_with_design(spark.range(2), q, {"seed": 1, "v": 5})
    assert sinks.read_if_same_design(spark, q, {"v": 5, "seed": 1}).count() == 2
    assert sinks.read_if_same_design(spark, q, {"v": 6, "seed": 1}) is None and sinks.read_if_same_design(spark, str(tmp_path / "no"), {}) is None


def test_nan_is_null(spark):
    df = tables.null_for_nan(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, k int"))
    assert [r.v for r in df.orderBy("k").collect()] == [None, 2.0]


def test_windows_as_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("SELECT timestamp_seconds(id * 600) AS ts, IF(id % 2 = 0, 'a', 'b') AS event_type, CAST(id AS DOUBLE) AS value FROM range(40)").repartition(3).write.parquet(str(src))
    stream = events.windowed_summary(events.read_events(spark, str(src)), lateness="30 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = events.windowed_summary(spark.read.parquet(str(src)))
    cols = ["window_start", "event_type", "n", F.round("mean_value", 6).alias("m")]
    assert sorted(map(tuple, spark.table("w").select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_replace_recovers_from_a_crash(spark, tmp_path):
    from tessera.sources import sinks

    path = f"file://{tmp_path}/t"
    sinks.replace(spark.range(3).toDF("a"), path)
    sinks.replace(spark.range(5).toDF("a"), path)
    assert spark.read.parquet(path).count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    (tmp_path / "t").rename(tmp_path / f"t{sinks.ASIDE}")  # a crash between the two moves
    assert sinks.cached(spark, path, lambda: spark.range(9).toDF("a")).count() == 5
    sinks.write_with_design(spark.range(0).toDF("a"), path, {"k": 1})
    assert sinks.read_if_same_design(spark, path, {"k": 2}) is None and sinks.read_if_same_design(spark, path, {"k": 1}).columns == ["a"]


def test_sheets(spark, tmp_path):
    from tessera.sources import sheets

    assert [sheets.column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and all(sheets.column_number(sheets.column_name(k)) == k for k in range(1500))
    path = str(tmp_path / "b.xlsx")
    a = spark.createDataFrame([(1, "x < y & z", 0.5), (2, None, None), (3, "  kept ", float("nan"))], "n int, t string, v double").coalesce(1)
    sheets.write_workbook({"one": a.limit(1), "two": a}, path)
    got = sheets.read_sheet(spark, path, 2)
    assert got.columns == ["n", "t", "v"] and [tuple(r) for r in got.collect()] == [("1", "x < y & z", "0.5"), ("2", None, None), ("3", "  kept ", "nan")]
    assert sheets.read_sheet(spark, path, 1).count() == 1
    with pytest.raises(Exception, match="no sheet 3"):
        sheets.read_sheet(spark, path, 3).count()
    import io
    import zipfile

    data, out = (tmp_path / "b.xlsx").read_bytes(), io.BytesIO()  # shared strings, as spreadsheet programs write them
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as w:
        for n in z.namelist():
            body = z.read(n)
            if n.endswith("sheet2.xml"):
                body = b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c t="s"><v>0</v></c></row><row r="4"><c r="A4" t="s"><v>1</v></c><c r="C4"><v>7</v></c></row><row r="5"><c r="A5" t="s"><v>0</v></c></row></sheetData></worksheet>'
            w.writestr(n, body)
        w.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><r><t>v</t></r><r><t>w</t></r></si><si><t>ID</t></si></sst>')
    assert list(sheets.sheet_rows(out.getvalue(), 2)) == [(1, {0: "vw"}), (4, {0: "ID", 2: "7"}), (5, {0: "vw"})]
    (tmp_path / "c.xlsx").write_bytes(out.getvalue())
    assert sheets.read_sheet(spark, str(tmp_path / "c.xlsx"), 2, key="ID").columns == ["ID", "col_2", "7"]


def test_settings(monkeypatch):
    from tessera.functions import settings

    for text, want in (("", 5), (" 7 ", 7)):
        monkeypatch.setenv("SOME_COUNT", text)
        assert settings.positive_int("SOME_COUNT", 5) == want
    for text in ("0", "-1", "2.5", "x"):
        monkeypatch.setenv("SOME_COUNT", text)
        with pytest.raises(ValueError, match="SOME_COUNT"):
            settings.positive_int("SOME_COUNT", 5)
    for text, want in (("", True), ("No", False), ("YES", True), ("0", False)):
        monkeypatch.setenv("SOME_SWITCH", text)
        assert settings.switch("SOME_SWITCH", True) is want
    monkeypatch.setenv("SOME_SWITCH", "maybe")
    with pytest.raises(ValueError):
        settings.switch("SOME_SWITCH")


def test_auc_in_label(spark):
    from tessera.functions import labels

    df = spark.createDataFrame([("Model 2 (AUC = 0.71)",), ("auc: .655 model 10",), ("nothing",), (None,)], "t string")
    n, a = labels.auc_in_label(F.col("t"))
    assert [tuple(r) for r in df.select(n, a).collect()] == [(2, 0.71), (10, 0.655), (None, None), (None, None)]
