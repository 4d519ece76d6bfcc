"""Records made of field entries: joins to their definition, answers, privacy, lineage, export shapes.

An entry is a row of a long table (doc, field, …). A value is one of three
typed columns: v_text, v_bool, v_list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmend.functions import dates as D
from quillmend.functions import text as T
from quillmend.functions.text import confidence_level

ANONYMISED, MASKED = "（匿名化済み）", "（マスク済み）"
OTHER = "その他"


def complete(entries: DataFrame, docs: DataFrame, definition: DataFrame, doc: str = "doc", field: str = "field") -> DataFrame:
    """Every field of the definition for every document; missing entries have null values and confidence 0. Adds level."""
    grid = docs.select(doc).distinct().join(F.broadcast(definition))
    out = grid.join(entries, [doc, field], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return out.withColumn("level", confidence_level(F.col("confidence")))


def with_era(entries: DataFrame, definition: DataFrame, doc: str = "doc", field: str = "field") -> DataFrame:
    """Date entries with the value of their era field, or their default era. The definition has era_field and default_era."""
    dates = entries.join(F.broadcast(definition.select(field, "era_field", "default_era")), field)
    eras = entries.select(doc, F.col(field).alias("era_field"), F.nullif("v_text", F.lit("")).alias("__era"))
    return dates.join(eras, [doc, "era_field"], "left").withColumn("era", F.coalesce("__era", "default_era")).drop("__era")


def resolved_words(options: DataFrame, overrides: DataFrame, readings: DataFrame, on: list[str]) -> DataFrame:
    """The word of each option: an override before the definition; a reading never replaces it, but flags a change that two readings agree on."""
    j = options.join(F.broadcast(overrides), on, "left").join(readings, on, "left")
    word = F.coalesce(F.col("override"), F.col("expected"))
    source = F.when(F.col("override").isNotNull(), "override").otherwise("definition")
    changed = F.col("override").isNull() & F.coalesce(F.col("agreed"), F.lit(False)) & (F.coalesce(F.col("read"), F.lit("")) != "") & (F.col("read") != F.col("expected"))
    return j.select(*on, word.alias("word"), source.alias("source"), changed.alias("changed"))


def combined_readings(first: DataFrame, second: DataFrame, on: list[str], normal=lambda c: c) -> DataFrame:
    """Two sets of readings as one: agreed where both say the same, else the second before the first."""
    a, b = first.select(*on, F.col("read").alias("a")), second.select(*on, F.col("read").alias("b"))
    both = a.join(b, on, "full_outer")
    agreed = F.coalesce((normal(F.col("a")) == normal(F.col("b"))) & (normal(F.col("a")) != ""), F.lit(False))
    return both.select(*on, F.coalesce(F.nullif("b", F.lit("")), F.col("a"), F.lit("")).alias("read"), agreed.alias("agreed"))


def decorate(word: Column, text: Column, other: str = OTHER) -> Column:
    """A word with its companion text: in its place for "other", else in brackets."""
    t = F.coalesce(F.trim(text), F.lit(""))
    return F.when(t == "", word).when(F.startswith(word, F.lit(other)), t).otherwise(F.concat(word, F.lit("（"), t, F.lit("）")))


def companion_fields(definition: DataFrame, field: str = "field", links: str = "option_texts") -> DataFrame:
    """Text fields that stand beside an option: text_field, field, option."""
    return definition.select(F.col(field).alias("field"), F.explode(links).alias("option", "text_field")).select("text_field", "field", "option")


def answers(value: Column, options: Column, words: Column) -> Column:
    """Values as words: each known option by its word, unknown ones as they are."""
    table = F.map_from_arrays(options, words)
    return F.transform(value, lambda v: F.coalesce(F.try_element_at(table, v), v))


def looks_anonymised(entries: DataFrame, doc: str = "doc", pii: str = "pii", is_text: str = "is_text", value: str = "v_text") -> DataFrame:
    """Per document whether all name fields are blank while some other text was read."""
    blank = F.trim(F.coalesce(F.col(value), F.lit(""))) == ""
    name = F.coalesce(F.col(pii), F.lit("")) == "name"
    names, read = F.count_if(name), F.count_if(~name & F.col(is_text) & ~blank)
    return entries.groupBy(doc).agg(((names > 0) & (F.count_if(name & ~blank) == 0) & (read > 0)).alias("anonymised"))


def anonymise(entries: DataFrame, force: Column, pii: str = "pii", value: str = "v_text", wipe: tuple[str, ...] = ("raw", "candidates", "corrections", "trace")) -> DataFrame:
    """Mask personal fields: names where forced or blank, others only where forced.

    A masked entry is sure (confidence 1) and loses whatever may still hold the
    value: raw reading, candidates, corrections and trace.
    """
    blank = F.trim(F.coalesce(F.col(value), F.lit(""))) == ""
    name = (F.col(pii) == "name") & (force | blank)
    hit = F.coalesce(name | ((F.col(pii) == "mask") & force), F.lit(False))
    out = entries.withColumn("anonymised", hit)
    for c in wipe:
        if c in entries.columns:
            empty = F.lit("") if dict(entries.dtypes)[c] == "string" else F.lit(None).cast(dict(entries.dtypes)[c])
            out = out.withColumn(c, F.when(F.col("anonymised"), empty).otherwise(F.col(c)))
    out = out.withColumn(value, F.when(F.col("anonymised"), F.when(F.col(pii) == "name", ANONYMISED).otherwise(MASKED)).otherwise(F.col(value)))
    return out.withColumn("confidence", F.when(F.col("anonymised"), 1.0).otherwise(F.col("confidence")))


def clear_anonymised(entries: DataFrame, value: str = "v_text") -> DataFrame:
    """Masked values become blank; what they hid is gone."""
    return entries.withColumn(value, F.when(F.col(value).isin(ANONYMISED, MASKED), "").otherwise(F.col(value)))


def trace_summary(trace: Column) -> Column:
    """Steps of a trace in first-seen order."""
    return F.array_join(F.array_distinct(F.transform(trace, lambda s: s["step"])), " → ")


def trace_lines(trace: Column) -> Column:
    """Numbered lines of a trace."""
    def line(s: Column, i: Column) -> Column:
        head = F.concat((i + 1).cast("string"), F.lit(". "), s["step"])
        detail = F.when(F.coalesce(s["detail"], F.lit("")) != "", F.concat(F.lit("　"), s["detail"])).otherwise("")
        moved = F.when((F.coalesce(s["before"], F.lit("")) != "") | (F.coalesce(s["after"], F.lit("")) != ""), F.concat(F.lit("　「"), F.coalesce(s["before"], F.lit("")), F.lit("」→「"), F.coalesce(s["after"], F.lit("")), F.lit("」"))).otherwise("")
        return F.concat(head, detail, moved)

    return F.transform(trace, line)


def engine_of(trace: Column, readers: list[str]) -> Column:
    """The detail of the first step that read something."""
    return F.get(F.filter(trace, lambda s: s["step"].isin(readers)), F.lit(0))["detail"]


def flat_value(v_text: Column, v_bool: Column, v_list: Column, chosen: str = "該当") -> Column:
    """A value as one cell: lists joined, flags as a word or empty."""
    return F.coalesce(v_text, F.when(v_bool, chosen).when(~v_bool, ""), F.array_join(v_list, "；"), F.lit(""))


def option_index(label: Column, options: Column, aliases: dict[str, str], normal) -> Column:
    """Place of an option by alias, exact label or normal form; null if none."""
    known = F.coalesce(*(F.when(label == a, o) for a, o in aliases.items()), label) if aliases else label
    exact = F.array_position(options, known)
    loose = F.array_position(F.transform(options, normal), normal(known))
    return F.when(exact > 0, exact - 1).when(loose > 0, loose - 1)


def form_drift(row_text: Column, options: Column, words: Column, known: Column, normal) -> Column:
    """Options found in and missing from a row, and its words that are the wording of no known label. ``normal`` must be built in."""
    text = normal(row_text)
    found = F.filter(options, lambda o: (normal(o) != "") & F.contains(text, normal(o)))
    inside = lambda w: F.exists(known, lambda k: (normal(w) != "") & (normal(k) != "") & (F.contains(normal(w), normal(k)) | F.contains(normal(k), normal(w))))
    alike = T.best_ratios(F.transform(words, normal), F.transform(known, normal))
    extra = F.filter(F.zip_with(words, alike, lambda w, ratio: F.when(~inside(w) & (ratio < T.SAME_WORDING), w)), lambda w: w.isNotNull())
    return F.struct(found.alias("found"), F.array_except(options, found).alias("missing"), extra.alias("extra"))


def drift_reported(drift: Column) -> Column:
    """Whether a drift is worth reporting: at least half the options found, and something extra."""
    n = F.size(drift["found"]) + F.size(drift["missing"])
    return (F.size(drift["extra"]) > 0) & (F.size(drift["found"]) * 2 >= n) & (n > 0)


def adopt_suggestion(entries: DataFrame, value: str, suggestion: str, accepted: Column) -> DataFrame:
    """Take an accepted suggestion: the old value joins the candidates, confidence is at least 0.55."""
    takes = accepted & (F.coalesce(F.col(suggestion), F.lit("")) != "") & (F.col(suggestion) != F.col(value))
    e = entries.withColumn("applied", F.coalesce(takes, F.lit(False)))
    e = e.withColumn("candidates", F.when(F.col("applied"), F.array_union(F.array(F.col(value)), "candidates")).otherwise(F.col("candidates")))
    e = e.withColumn("confidence", F.when(F.col("applied"), F.greatest("confidence", F.lit(0.55))).otherwise(F.col("confidence")))
    return e.withColumn(value, F.when(F.col("applied"), F.col(suggestion)).otherwise(F.col(value)))


def confirm(entries: DataFrame, visible: Column) -> DataFrame:
    """Confirm visible entries; ``newly`` counts as the event's size."""
    newly = visible & ~F.coalesce(F.col("confirmed"), F.lit(False))
    return entries.withColumn("newly", newly).withColumn("confirmed", F.coalesce(F.col("confirmed"), F.lit(False)) | visible)


def for_field(fields: DataFrame, field_map: DataFrame, terms: DataFrame, field: str = "field", lexicon: str = "lexicon") -> DataFrame:
    """The terms of the lexicon that each field uses; fields without one have none."""
    return fields.join(field_map, field).join(terms, lexicon)


def known_texts(template: DataFrame, definition: DataFrame, field: str = "field") -> DataFrame:
    """Text places of a template whose field is still defined, with its definition."""
    return template.join(definition, field)


def anchors(left: DataFrame, right: DataFrame, label: str) -> DataFrame:
    """Rows of two templates that correspond by a label that each has just once."""
    once = [side.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).filter("__n = 1").select(label) for side in (left, right)]
    return left.join(once[0], label, "left_semi").join(right.join(once[1], label, "left_semi"), label)


def corresponding(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Boxes of two templates that stand for the same option."""
    return left.join(right, key)


def apply_row(entries: DataFrame, picked: DataFrame, doc: str = "doc", field: str = "field", value: str = "value", taken: str = "taken") -> tuple[DataFrame, DataFrame]:
    """Entries with a picked row's values taken over and marked as edited, and one event for each change: doc, field, before, after.

    ``picked`` has a row for each doc and field it fills; empty values fill nothing.
    """
    joined = entries.join(picked.select(doc, field, F.col(taken).alias("__t")), [doc, field], "left")
    takes = (F.coalesce(F.col("__t"), F.lit("")) != "") & ~F.col("__t").eqNullSafe(F.col(value))
    marked = joined.withColumn("edited", takes)
    events = marked.filter("edited").select(doc, field, F.col(value).alias("before"), F.col("__t").alias("after"))
    return marked.withColumn(value, F.when(F.col("edited"), F.col("__t")).otherwise(F.col(value))).drop("__t"), events


def filtered_terms(terms: DataFrame, name: str, code: str, query: str, most: int = 400) -> DataFrame:
    """Terms whose name or code holds the query, the first of them in order of name."""
    hit = F.contains(F.col(name), F.lit(query)) | F.contains(F.col(code), F.lit(query))
    return terms.filter(hit).orderBy(name, code).limit(most)


def derived(dates: DataFrame, codes: DataFrame, written: DataFrame, doc: str = "doc", birth: str = "birth_date", entry: tuple[str, str] = ("entry_date", "last_exam_date")) -> DataFrame:
    """What follows from a record: parts of each date, codes of each name, and the age, computed and as written.

    ``dates`` has doc, field, iso, era, year, month, day; ``codes`` doc, field, code, flagged; ``written`` doc, age.
    The age is taken at the first of the entry dates that is complete.
    """
    parts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("iso", "era", "year", "month", "day").alias("v")))))
    d = dates.groupBy(doc).agg(parts.alias("dates"))
    c = codes.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("code", "flagged").alias("v"))))).alias("codes"))
    at = F.coalesce(*(F.when(D.full_date(F.col("dates")[e]["iso"]).isNotNull(), F.col("dates")[e]["iso"]) for e in entry))
    both = d.join(c, doc, "full").join(written.select(doc, F.col("age").try_cast("int").alias("age_written")), doc, "left")
    out = both.withColumn("age_computed", D.age(F.col("dates")[birth]["iso"], at))
    return out.withColumn("age_matches", F.abs(F.col("age_computed") - F.col("age_written")) <= 1)


def junk_counts(readings: DataFrame, key: str, truth: str, read: str, least: int = 2) -> DataFrame:
    """For each key how many blanks were read as blank, and how many have so many characters of junk."""
    blank = F.coalesce(F.trim(truth), F.lit("")) == ""
    size = F.length(F.coalesce(F.trim(read), F.lit("")))
    return readings.groupBy(key).agg(F.count_if(blank & (size == 0)).alias("blank_right"), F.count_if(blank & (size >= least)).alias("junk"), F.count_if(blank).alias("blanks"))


def best_engine(readings: DataFrame, key: str, engine: str, parts: str, confidence: str) -> DataFrame:
    """The engine that read most parts, the surer one on ties, then the first by name: key, engine, n_parts."""
    n = F.size(F.filter(parts, lambda p: p.isNotNull()))
    better = F.struct((-n).alias("n"), (-F.col(confidence)).alias("c"), F.col(engine).alias("e"))
    return readings.groupBy(key).agg(F.min(better).alias("b")).select(key, F.col("b.e").alias(engine), (-F.col("b.n")).alias("n_parts"))
