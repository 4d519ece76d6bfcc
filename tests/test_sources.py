"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from quillmend.sources import records as Q


def test_definition_and_lexicons(spark, tmp_path):
    (tmp_path / "form.json").write_text(json.dumps({"version": "1", "form_name": "f", "sections": [{"id": "a", "title": "A", "fields": [{"id": "x", "label": "X", "type": "choice", "options": ["p", "q"], "option_texts": {"q": "t"}}, {"id": "t"}]}]}))
    rows = Q.definition(spark, str(tmp_path / "form.json")).orderBy("ordinal").collect()
    assert [(r["field"], r["type"], r["options"], r["page"]) for r in rows] == [("x", "choice", ["p", "q"], 1), ("t", "text", [], 1)]
    folder = tmp_path / "dict"
    folder.mkdir()
    (folder / "one.json").write_text(json.dumps({"entries": ["a", {"name": "b", "icd10": "B1", "tokutei": True}, {"x": 1}]}))
    (folder / "two.json").write_text(json.dumps({"entries": {"wrong": "right"}}))
    got = [tuple(r) for r in Q.lexicons(spark, str(folder)).orderBy("lexicon", "ordinal").collect()]
    assert got == [("one", 0, "a", "", False), ("one", 1, "b", "B1", True)]


def test_templates_and_overrides(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"pages": [{"index": 1, "boxes": [{"field": "x", "opt": 0, "rect": [0.1, 0.2, 0.3, 0.4]}]}]}))
    (tmp_path / "n.json").write_text(json.dumps({"other": 1}))
    assert [tuple(r)[1:] for r in Q.templates(spark, str(tmp_path / "*.json")).collect()] == [(1, "x", 0, [0.1, 0.2, 0.3, 0.4])]
    (tmp_path / "o.txt").write_text(json.dumps({"a.0": " w ", "b.1": " "}))
    (tmp_path / "bad.txt").write_text("{")
    assert [tuple(r) for r in Q.overrides(spark, str(tmp_path / "*.txt")).collect()] == [("a.0", "w")]


def test_files_and_encodings(spark, tmp_path):
    for name, data in (("b.txt", "日本".encode("cp932")), ("a.txt", "日本".encode()), ("c.bin", b"x")):
        (tmp_path / name).write_bytes(data)
    rows = Q.files(spark, str(tmp_path), ["txt"]).select("path", Q.sniffed_text(F.col("content")).alias("t")).collect()
    assert [(r["path"][-5:], r["t"]) for r in rows] == [("a.txt", "日本"), ("b.txt", "日本")]
    with pytest.raises(Exception, match="unsupported file"):
        spark.createDataFrame([("x.doc",)], "p string").select(Q.kind_of(F.col("p"))).collect()


def test_csv_and_form_json(spark, tmp_path):
    e = spark.createDataFrame([(1, "x", "a,b", 0.5), (1, "y", None, 0.9), (2, "x", "c", 0.1)], "doc long, field string, value string, confidence double")
    table = Q.csv_table(e, ["x", "y"], {"x": "X欄"})
    Q.write_csv(table.coalesce(1).orderBy("row", "doc"), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_bytes().decode()
    assert text.startswith("﻿doc,x,x_confidence,y,y_confidence\r\n文書,X欄,") and '1,"a,b",0.5,' in text
    items = e.select("doc", F.lit("s").alias("section"), F.lit(1).alias("section_no"), F.lit("g").alias("group"), F.col("field").alias("label"), "field", "value", F.length("field").alias("ordinal"))
    form = json.loads(Q.form_json(items).filter("doc = 1").first()["json"])
    assert [i["field"] for i in form[0]["groups"][0]["items"]] == ["x", "y"]
    back = {tuple(r) for r in Q.from_records_json(Q.records_json(e)).collect()}
    assert back >= {(1, "x", "a,b"), (2, "x", "c")}


def test_crawl_is_bounded(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert [tuple(r) for r in Q.reachable(edges, seeds, 2, 10).collect()] == [("a", 0), ("b", 1), ("e", 1), ("c", 2)]
    assert Q.reachable(edges, seeds, 2, 2).count() == 2


def test_lexicons_round_trip(spark, tmp_path):
    terms = spark.createDataFrame([("d", 0, "a", "", False), ("d", 1, "b", "B1", True)], "lexicon string, ordinal int, term string, code string, flagged boolean")
    (tmp_path / "d.json").write_text(Q.lexicon_json(terms).first()["json"])
    assert [tuple(r) for r in Q.lexicons(spark, str(tmp_path)).orderBy("ordinal").collect()] == [tuple(r) for r in terms.collect()]
    e = spark.createDataFrame([(1, "x"), (2, "x")], "doc long, field string")
    assert tuple(Q.overview(e, terms).first()) == (2, 1, 1, 2)


def test_saving(spark, tmp_path):
    rows = spark.createDataFrame([(1, b"x", ["w"], False, "m")], "doc long, image binary, warnings array<string>, was_read boolean, markdown string")
    Q.persisted(rows, str(tmp_path / "p"), ["image"])
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["doc", "warnings", "was_read", "markdown"]
    Q.event_log(rows.select("doc", "markdown"), str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).first()["markdown"] == "m"
    assert "w" in Q.failure_markdown(rows).first()["markdown"]


def test_region_partition_is_pruned(spark, tmp_path):
    from quillmend.operators.forms import region_of, region_partition

    spark.createDataFrame([("A", 1), ("B", 2)], "pref string, n int").write.partitionBy("pref").parquet(str(tmp_path / "d"))
    got = region_partition(spark, str(tmp_path / "d"), "pref", ["B"])
    assert [r["n"] for r in got.collect()] == [2] and "PushedFilters: [], ReadSchema: struct<n" in got._jdf.queryExecution().toString()
    sheets = spark.createDataFrame([("一覧 [茨城県]", "s", "f"), ("", "東京都", "f"), ("", "s", "list_08_x"), ("", "s", "東京.xlsx"), ("", "s", "Tokyo.xlsx"), ("", "s", "f")], "h string, s string, f string")
    out = sheets.select(region_of(F.col("h"), F.col("s"), F.col("f"), ["茨城県", "東京都"], {"08": "茨城県"}, {"tokyo": "東京都"}, "sole")).collect()
    assert [r[0] for r in out] == ["茨城県", "東京都", "茨城県", "東京都", "東京都", "sole"]


def test_directory_rows(spark):
    from quillmend.operators.forms import directory_rows

    rows = spark.createDataFrame([("s", 1, "1", "c1", "甲病院", "〒300-0001 つくば", "029", ["x"]), ("s", 2, "", "", "", "", "", ["現存"]), ("s", 3, "2", "c2", "乙病院", "〒300-0002 土浦", "029", ["x"]), ("s", 4, "", "", "", "", "", ["廃止"])], "sheet string, i int, no string, code string, name string, address string, phone string, status_cells array<string>")
    assert [tuple(r)[2:] for r in directory_rows(rows, ["sheet"], "i").collect()] == [("c1", "甲病院", "300-0001", "つくば", "029", "現存")]
