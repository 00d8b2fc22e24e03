from pyspark.sql import functions as F

from lakeline.operators import files as fl
from lakeline.operators import folds


def test_delimited_files(spark):
    text = 'a;"b;""c""\n d";e\r\n;;\n1;2;3\n4;5;6\n'
    rows = fl.delimited_to_rows(spark.createDataFrame([("f", text), ("g", "x"), ("h", None)], "file_id string, text string")).orderBy("file_id", "row_idx").collect()
    assert [(r.file_id, r.row_idx, r.cells) for r in rows] == [("f", 0, ["a", 'b;"c"\n d', "e"]), ("f", 1, ["1", "2", "3"]), ("f", 2, ["4", "5", "6"]), ("g", 0, ["x"])]


def test_pictures_on_cells(spark):
    cells = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 1, "b")], "sheet int, row int, col int, text string")
    pics = spark.createDataFrame([(1, 1, 1, "p", 100), (1, 1, 1, "q", 100), (1, 9, 9, "z", 100), (1, 2, 1, "s", 10)], "sheet int, row int, col int, path string, size int")
    assert [tuple(r) for r in fl.anchor_images(cells, pics).orderBy("row").collect()] == [(1, 1, 1, "a [IMG_PATH:p] [IMG_PATH:q]"), (1, 2, 1, "b"), (1, 3, 1, "[IMG_PATH:z]")]


def test_scan_and_decode(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.7"), ("b.txt", "﻿é".encode()), ("c.txt", b"\xe9"), ("d.txt", "﻿é".encode("utf-16-le"))):
        (tmp_path / name).write_bytes(data)
    got = {r.name: (r.size, r.format) for r in fl.scan_files(spark, str(tmp_path)).collect()}
    assert got["a.pdf"] == (8, "Pdf") and len(got) == 4
    texts = spark.read.format("binaryFile").load(str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("n"), fl.decode_text(F.col("content")).alias("t"))
    assert {r.n: r.t for r in texts.collect()} == {"a.pdf": "%PDF-1.7", "b.txt": "é", "c.txt": "é", "d.txt": "é"}


def test_model_slot(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, prompt string")
    assert {r.id: r.answer for r in fl.generate(df, lambda ps: [p.upper() for p in ps]).collect()} == {1: "A", 2: "A", 3: None}
    assert {r.answer for r in fl.generate(df, lambda ps: 1 / 0, "none").collect()} == {"none", None}


def test_turkish_bytes_and_returns_in_cells(spark):
    raw = "İğne şöyle ‘ı’ €".encode("cp1254")
    got = spark.createDataFrame([(raw,), ("düz".encode(),)], "content binary").select(fl.decode_text(F.col("content")).alias("t")).collect()
    assert [r.t for r in got] == ["İğne şöyle ‘ı’ €", "düz"]
    df = spark.createDataFrame([(1, 'a;b;c\r\n"x\r\ny";2;3\r\n4;5;6\r\n')], "file_id long, text string")
    assert [r.cells for r in fl.delimited_to_rows(df).orderBy("row_idx").collect()] == [["a", "b", "c"], ["x\r\ny", "2", "3"], ["4", "5", "6"]]


def test_folds_take_any_key_name_and_long_documents(spark):
    df = spark.range(60_000).select(F.lit(1).alias("d"), F.col("id").alias("at"), F.lit(3).alias("done"))
    got = folds.pack_budget(df, "d", "at", "done", 10)
    assert got.columns == ["d", "at", "group_no"] and got.agg(F.max("group_no")).first()[0] == 19_999
    small = spark.createDataFrame([(1, 0, 100), (1, 1, 5), (1, 2, 5), (1, 3, None), (2, 0, 5), (2, 1, 500)], "d long, at int, s int")
    assert [r.group_no for r in folds.coalesce_small(small, "d", "at", "s").orderBy("d", "at").collect()] == [0, 1, 1, 1, 0, 1]


def test_delimited_tables_within_their_rows(spark):
    df = spark.createDataFrame([(1, "Title\n\na;b;c\n1;;3\n4;5;x|y\nend"), (2, "a|b"), (3, " \n"), (4, None), (5, "a,b;c\nd,e;f\n")], "file_id long, text string")
    tables = fl.delimited_tables(df)
    assert {r.file_id: r.markdown for r in tables.collect()} == {1: "Title\n| a | b | c |\n| --- | --- | --- |\n| 1 |  | 3 |\n| 4 | 5 | x\\|y |\nend", 2: "a b", 5: "| a,b | c |\n| --- | --- |\n| d,e | f |"}
    for plan in (tables, fl.delimited_to_rows(df)):  # a file is read within its row
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
