"""Readers of definitions, lexicons, truth tables, logs and uploads, and writers of records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as Y

FIELD = Y.StructType([Y.StructField(n, Y.StringType()) for n in ("id", "label", "type")] + [Y.StructField("page", Y.IntegerType()), Y.StructField("options", Y.ArrayType(Y.StringType())), Y.StructField("option_texts", Y.MapType(Y.StringType(), Y.StringType()))] + [Y.StructField(n, Y.StringType()) for n in ("charset", "pii", "kind", "era_field", "default_era")] + [Y.StructField("always_pick", Y.BooleanType())] + [Y.StructField(n, Y.StringType()) for n in ("group", "group_label", "hint")])
DEFINITION = Y.StructType([Y.StructField("version", Y.StringType()), Y.StructField("form_name", Y.StringType()), Y.StructField("sections", Y.ArrayType(Y.StructType([Y.StructField("id", Y.StringType()), Y.StructField("title", Y.StringType()), Y.StructField("fields", Y.ArrayType(FIELD))])))])


def files(spark: SparkSession, folder: str, suffixes: list[str], recursive: bool = False) -> DataFrame:
    """Paths, sizes and contents of a folder's files of some kinds, numbered by path."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    fit = read.filter(F.lower("path").rlike(r"\.(?:" + "|".join(suffixes) + ")$"))
    return fit.select("path", "length", "content").orderBy("path")


def first_paths(paths: DataFrame, path: str, ordinal: str) -> DataFrame:
    """Each path once, where it came first."""
    return paths.withColumn("__r", F.row_number().over(W.partitionBy(path).orderBy(ordinal))).filter("__r = 1").drop("__r")


def kind_of(path: Column) -> Column:
    """pdf or image by a path's suffix; other files raise."""
    low = F.lower(path)
    return F.when(low.rlike(r"\.pdf$"), "pdf").when(low.rlike(r"\.(?:png|jpe?g|tiff?|bmp|webp)$"), "image").otherwise(F.raise_error(F.concat(F.lit("unsupported file: "), path)).cast("string"))


def definition(spark: SparkSession, path: str) -> DataFrame:
    """A form definition as one row per field in order, with section and defaults for missing keys."""
    d = spark.read.schema(DEFINITION).option("multiLine", "true").json(path)
    s = d.select("version", "form_name", F.posexplode("sections").alias("section_no", "s"))
    f = s.select("version", "form_name", "section_no", F.col("s.id").alias("section"), F.col("s.title").alias("section_title"), F.posexplode("s.fields").alias("field_no", "f"))
    text = lambda n: F.coalesce(F.col(f"f.{n}"), F.lit("")).alias(n)
    return f.select("version", "form_name", "section", "section_title", (F.col("section_no") * 10_000 + F.col("field_no")).alias("ordinal"), F.col("f.id").alias("field"), text("label"), F.coalesce("f.type", F.lit("text")).alias("type"), F.coalesce("f.page", F.lit(1)).alias("page"), F.coalesce("f.options", F.array().cast("array<string>")).alias("options"), F.coalesce("f.option_texts", F.create_map().cast("map<string,string>")).alias("option_texts"), *(text(n) for n in ("charset", "pii", "kind", "era_field", "default_era", "group", "group_label")), F.coalesce("f.always_pick", F.lit(False)).alias("always_pick"))


def lexicons(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of a folder of lexicon files, which list strings or objects: lexicon, ordinal, term, code, flagged. Maps are no lexicons."""
    raw = spark.read.text(folder + "/*.json", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("lexicon"), "value")
    listed = raw.select("lexicon", F.from_json(F.get_json_object("value", "$.entries"), "array<string>").alias("e"))
    e = listed.select("lexicon", F.posexplode("e").alias("ordinal", "x"))
    is_object = F.startswith(F.col("x"), F.lit("{"))
    part = lambda n: F.when(is_object, F.get_json_object("x", f"$.{n}"))
    out = e.select("lexicon", "ordinal", F.when(is_object, part("name")).otherwise(F.col("x")).alias("term"), F.coalesce(part("icd10"), F.lit("")).alias("code"), F.coalesce(part("tokutei") == "true", F.lit(False)).alias("flagged"))
    return out.filter("term is not null and term <> ''")


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of template files that have pages: file, page, field, opt, rect (four shares)."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.get_json_object("value", "$.pages").alias("pages")).filter("pages is not null")
    box = "array<struct<index:int,boxes:array<struct<field:string,opt:int,rect:array<double>>>>>"
    p = raw.select("file", F.explode(F.from_json("pages", box)).alias("p"))
    return p.select("file", F.col("p.index").alias("page"), F.explode("p.boxes").alias("b")).select("file", "page", "b.*")


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """Saved label overrides: strings only, trimmed, not empty: key, word. An unreadable file gives none."""
    raw = spark.read.text(path, wholetext=True)
    return cleaned_overrides(raw.select(F.from_json("value", "map<string,string>").alias("m")), "m")


def cleaned_overrides(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.explode(F.map_filter(column, lambda k, v: F.trim(v) != "")).alias("key", "w")).select("key", F.trim("w").alias("word"))


def long_truth(wide: DataFrame, key: str, value: str = "truth") -> DataFrame:
    """Wide truth with columns named id:label as rows: key, field, truth. Empty cells stay empty."""
    columns = [c for c in wide.columns if c != key]
    pairs = F.array(*(F.struct(F.lit(c.split(":")[0].lstrip("﻿")).alias("field"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(value)) for c in columns))
    return wide.select(key, F.explode(pairs).alias("p")).select(key, "p.*")


def numstat(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a log written as ``@sha|date|subject`` lines with numstat lines below: sha, date, subject, added, deleted, file."""
    return parse_numstat(spark.read.text(path, wholetext=True), "value")


def parse_numstat(rows: DataFrame, text: str) -> DataFrame:
    block = rows.select(F.explode(F.filter(F.split(text, "(?m)^@"), lambda b: F.trim(b) != "")).alias("b"))
    head = F.split(F.split("b", "\n")[0], r"\|", 3)
    lines = F.filter(F.slice(F.split("b", "\n"), F.lit(2), F.size(F.split("b", "\n"))), lambda l: l.rlike(r"^[0-9-]+\t[0-9-]+\t"))
    c = block.select(head[0].alias("sha"), head[1].alias("date"), head[2].alias("subject"), F.explode(lines).alias("l"))
    number = lambda i: F.coalesce(F.split("l", "\t")[i].try_cast("bigint"), F.lit(0))
    return c.select("sha", "date", "subject", number(0).alias("added"), number(1).alias("deleted"), F.split("l", "\t", 3)[2].alias("file"))


def links(pages: DataFrame, key: str, html: str, good: str, bad: str) -> DataFrame:
    """Links of pages with a score: good words in the link or its label count up, bad ones down, files of tables most: key, href, label, score."""
    found = F.explode(F.regexp_extract_all(html, F.lit(r'(?is)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1)))
    a = pages.select(key, found.alias("a"))
    l = a.select(key, F.regexp_extract("a", r'(?is)href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]+>", " "), r"\s+", " ")).alias("label"))
    both = F.lower(F.concat_ws(" ", "href", "label"))
    score = both.rlike(good).cast("int") * 2 - both.rlike(bad).cast("int") * 3 + F.lower("href").rlike(r"\.(?:xlsx?|csv|zip)$").cast("int") * 5
    return l.select(key, "href", "label", score.alias("score")).dropDuplicates([key, "href", "label"])


def reachable(edges: DataFrame, seeds: DataFrame, depth: int, most: int) -> DataFrame:
    """Nodes within so many steps of the seeds, nearest first, at most so many: node, depth. Edges src, dst."""
    found = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    front = found
    for step in range(1, depth + 1):
        front = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti").withColumn("depth", F.lit(step))
        found = found.unionByName(front)
    return found.orderBy("depth", "node").limit(most)


def sheet_rows(cells: DataFrame, key: list[str], row: str, col: str, value: str, names: dict[str, list[str]]) -> DataFrame:
    """Rows below a sheet's header, found as the first row that holds a known heading: key, row, and a column per name. ``names`` lists headings per column."""
    pairs = [(h, n) for n, hs in names.items() for h in hs]
    known = F.coalesce(*(F.when(F.col(value) == h, n) for h, n in pairs))
    heads = cells.withColumn("name", known).filter("name is not null")
    first = heads.groupBy(*key).agg(F.min(row).alias("__head"))
    head = heads.join(first, key).filter(F.col(row) == F.col("__head")).select(*key, col, "name", "__head")
    body = cells.join(head, [*key, col]).filter(F.col(row) > F.col("__head"))
    return body.groupBy(*key, row).pivot("name", list(names)).agg(F.first(value))


def sniffed_text(content: Column, others: tuple[str, ...] = ("windows-31j", "EUC-JP")) -> Column:
    """Text of bytes in the first encoding that fits: UTF-8, then the others, by an Arrow UDF."""
    @F.pandas_udf(Y.StringType())
    def decode(values: pd.Series) -> pd.Series:
        names = ("utf-8-sig", *({"windows-31j": "cp932"}.get(n, n) for n in others))

        def one(data: bytes) -> str:
            for name in names:
                try:
                    return data.decode(name)
                except UnicodeDecodeError:
                    continue
            return data.decode("utf-8", "replace")

        return values.map(one, na_action="ignore")

    return decode(content)


def uploads(rows: DataFrame, payload: str, most_files: int = 8, most_bytes: int = 20 << 20) -> DataFrame:
    """Files of JSON uploads in either shape, {file} or {files: []}: position, name with a suffix that fits its first bytes, size. Rows over the limits have a problem."""
    file = "struct<name:string,data:string>"
    j = rows.select("*", F.from_json(payload, f"struct<files:array<{file}>,file:{file}>").alias("__p"))
    listed = j.select("*", F.coalesce("__p.files", F.array("__p.file")).alias("__f"))
    f = listed.select(*rows.columns, F.size("__f").alias("n_files"), F.posexplode("__f").alias("position", "f"))
    data = F.try_to_binary(F.regexp_replace("f.data", r"^data:[^,]*,", ""), F.lit("base64"))
    f = f.withColumn("content", data)
    magic = F.hex(F.substring("content", 1, 4))
    suffix = F.when(magic == "25504446", ".pdf").when(magic == "89504E47", ".png").when(F.startswith(magic, F.lit("FFD8")), ".jpg").otherwise("")
    safe = F.regexp_replace(F.regexp_extract(F.coalesce("f.name", F.lit("file")), r"([^/\\]*)$", 1), r"[^\w.\-]", "_")
    named = F.when(safe.rlike(r"\.[A-Za-z0-9]{2,4}$"), safe).otherwise(F.concat(safe, suffix))
    problem = F.when(F.col("n_files") > most_files, "too many files").when(F.length("content") > most_bytes, "too large").when(F.col("content").isNull(), "not base64")
    return f.select(*rows.columns, "position", named.alias("name"), F.length("content").alias("size"), problem.alias("problem"))


def records_json(entries: DataFrame, doc: str = "doc", field: str = "field", value: str = "value") -> DataFrame:
    """One JSON object of values per document, fields in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(field), F.col(value))))
    return entries.groupBy(doc).agg(F.to_json(F.map_from_entries(ordered)).alias("json"))


def full_records(entries: DataFrame, sources: DataFrame, derived: DataFrame, drift: DataFrame, meta: list[str], doc: str = "doc", field: str = "field", value: str = "value", answer: str = "answer") -> DataFrame:
    """One JSON a document with values, answers, meta, sources, derived and form_drift, fields in order.

    ``meta`` names the entries' columns that go into meta; ``sources`` has rows of a document, ``derived`` one row and
    ``drift`` a row for each field that drifted. Documents without any of these have null or nothing there.
    """
    by_field = lambda rows: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(field).alias("k"), rows.alias("v")))))
    e = entries.groupBy(doc).agg(by_field(F.col(value)).alias("values"), by_field(F.col(answer)).alias("answers"), by_field(F.struct(*meta)).alias("meta"))
    s = sources.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(*(c for c in sources.columns if c != doc)))).alias("sources"))
    d = derived.select(doc, F.struct(*(c for c in derived.columns if c != doc)).alias("derived"))
    f = drift.groupBy(doc).agg(by_field(F.struct(*(c for c in drift.columns if c not in (doc, field)))).alias("form_drift"))
    joined = e.join(s, doc, "left").join(d, doc, "left").join(f, doc, "left")
    return joined.select(doc, F.to_json(F.struct("values", "answers", "meta", F.coalesce("sources", F.array().cast(dict(s.dtypes)["sources"])).alias("sources"), "derived", "form_drift")).alias("json"))


def from_records_json(rows: DataFrame, doc: str = "doc", json: str = "json") -> DataFrame:
    """Field values of saved records again."""
    return rows.select(doc, F.explode(F.from_json(json, "map<string,string>")).alias("field", "value"))


def csv_table(entries: DataFrame, fields: list[str], labels: dict[str, str], doc: str = "doc", field: str = "field", value: str = "value", confidence: str = "confidence") -> DataFrame:
    """A wide table of value and confidence columns with the labels as its first row; ``row`` orders it, and an explicit field list spares a pass."""
    wide = entries.groupBy(doc).pivot(field, fields).agg(F.first(value).alias("v"), F.first(confidence).cast("string").alias("c"))
    head = entries.sparkSession.range(1).select(F.lit(0).alias("row"), F.lit("文書").alias(doc), *(x for f in fields for x in (F.lit(labels.get(f, f)).alias(f), F.lit("確信度").alias(f"{f}_confidence"))))
    body = wide.select(F.lit(1).alias("row"), F.col(doc).cast("string").alias(doc), *(x for f in fields for x in (F.coalesce(F.col(f"`{f}_v`"), F.lit("")).alias(f), F.coalesce(F.col(f"`{f}_c`"), F.lit("")).alias(f"{f}_confidence"))))
    return head.unionByName(body)


def write_csv(table: DataFrame, path: str) -> None:
    """With a byte-order mark in the first heading, CRLF line ends and headings first in each file."""
    out = table.drop("row")
    out.toDF("﻿" + out.columns[0], *out.columns[1:]).write.mode("overwrite").option("header", "true").option("lineSep", "\r\n").csv(path)


def form_json(entries: DataFrame, doc: str = "doc") -> DataFrame:
    """Sections, groups and items in order as one JSON per document. Columns section, section_no, group, ordinal, field, label, value."""
    item = F.struct("ordinal", "field", "label", "value")
    groups = entries.groupBy(doc, "section", "section_no", "group").agg(F.array_sort(F.collect_list(item)).alias("items"))
    g = F.struct(F.col("items")[0]["ordinal"].alias("ordinal"), F.col("group"), F.col("items"))
    sections = groups.groupBy(doc, "section", "section_no").agg(F.array_sort(F.collect_list(g)).alias("groups"))
    s = F.struct("section_no", "section", "groups")
    return sections.groupBy(doc).agg(F.to_json(F.array_sort(F.collect_list(s))).alias("json"))


def markdown(entries: DataFrame, doc: str = "doc", section: str = "section", section_no: str = "section_no") -> DataFrame:
    """A document's sections as Markdown tables, and a list of what needs a check. Columns ordinal, label, value, level."""
    row = F.concat(F.lit("| "), "label", F.lit(" | "), F.replace("value", F.lit("|"), F.lit("\\|")), F.lit(" | "), "level", F.lit(" |"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("ordinal"), row.alias("r"))))
    low = F.array_sort(F.collect_list(F.when(F.col("level") == "low", F.struct(F.col("ordinal"), F.col("label").alias("r")))))
    s = entries.groupBy(doc, section, section_no).agg(F.array_join(F.transform(rows, lambda x: x["r"]), "\n").alias("t"), F.transform(low, lambda x: x["r"]).alias("low"))
    body = F.concat(F.lit("## "), F.col(section), F.lit("\n"), F.col("t"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(section_no).alias("n"), body.alias("b"), F.col("low"))))
    d = s.groupBy(doc).agg(ordered.alias("o"))
    checks = F.flatten(F.transform("o", lambda x: x["low"]))
    return d.select(doc, F.concat(F.array_join(F.transform("o", lambda x: x["b"]), "\n\n"), F.when(F.size(checks) > 0, F.concat(F.lit("\n\n## 要確認\n- "), F.array_join(checks, "\n- "))).otherwise("")).alias("markdown"))


def persisted(records: DataFrame, path: str, heavy: list[str]) -> None:
    """Save records without their heavy columns (pictures)."""
    records.drop(*heavy).write.mode("overwrite").parquet(path)


def event_log(events: DataFrame, path: str, kind: str = "csv") -> None:
    """Save an event log as CSV or JSON lines."""
    writer = events.write.mode("overwrite")
    writer.option("header", "true").csv(path) if kind == "csv" else writer.json(path)


def lexicon_json(terms: DataFrame) -> DataFrame:
    """One JSON per lexicon, entries in order, in the form that ``lexicons`` reads: lexicon, json."""
    entry = F.struct("ordinal", F.struct(F.col("term").alias("name"), F.col("code").alias("icd10"), F.col("flagged").alias("tokutei")).alias("e"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"])
    return terms.groupBy("lexicon").agg(F.to_json(F.struct(F.col("lexicon").alias("label"), listed.alias("entries"))).alias("json"))


def overview(entries: DataFrame, lexicon_terms: DataFrame) -> DataFrame:
    """How much there is: documents, fields, lexicons and terms, in one row."""
    a = entries.agg(F.count_distinct("doc").alias("documents"), F.count_distinct("field").alias("fields"))
    b = lexicon_terms.agg(F.count_distinct("lexicon").alias("lexicons"), F.count(F.lit(1)).alias("terms"))
    return a.join(F.broadcast(b))


def failure_markdown(records: DataFrame, doc: str = "doc", warnings: str = "warnings", read: str = "was_read") -> DataFrame:
    """A page for each record: what to tell where nothing was read, else its text."""
    told = F.concat(F.lit("# 読み取れませんでした\n\n- "), F.array_join(F.col(warnings), "\n- "))
    return records.select(doc, F.when(F.col(read), F.col("markdown")).otherwise(told).alias("markdown"))
