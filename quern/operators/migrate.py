"""Schema migrations and updates in place, as one select each; every change can be logged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def given(*columns: Column, default=None) -> Column:
    """The first value that is neither null nor empty."""
    filled = [F.nullif(c.cast("string"), F.lit("")) for c in columns]
    return F.coalesce(*filled, F.lit(default)) if default is not None else F.coalesce(*filled)


def nest_question(flat: DataFrame) -> DataFrame:
    """Flat questions as nested ones: content, choices, provenance, classification and validation.

    ``flat``: id, question, answer, choices (map), letter, chunk_id, source, page, session, uv, number, rate, category,
    explanation; what is missing from the table is null in the result."""
    c = lambda name, kind="string": F.col(name) if name in flat.columns else F.lit(None).cast(kind)
    letters = F.upper(F.regexp_extract(c("letter"), r"([A-Fa-f])", 1))
    answer = F.coalesce(F.nullif(c("answer"), F.lit("")), F.nullif(T.answer_text(c("letter"), c("choices", "map<string,string>")), F.lit("")))
    return flat.select(
        "id",
        F.struct(c("question").alias("question"), answer.alias("expected_answer"), answer.isNull().alias("is_impossible")).alias("content"),
        F.struct(c("choices", "map<string,string>").alias("choices"), F.nullif(letters, F.lit("")).alias("correct_answer")).alias("mcq"),
        F.struct(c("chunk_id").alias("chunk_id"), F.filter(F.array(c("source")), lambda x: x.isNotNull()).alias("docs"), F.filter(F.array(c("page", "int")), lambda x: x.isNotNull()).alias("pages"), F.substring(c("explanation"), 1, 500).alias("answer_explanation"), F.struct(c("session").alias("session"), c("uv").alias("uv"), c("number", "int").alias("question_num"), c("rate", "double").alias("success_rate")).alias("exam")).alias("provenance"),
        F.struct(given(c("category"), default="general").alias("category"), difficulty(c("rate", "double")).alias("difficulty")).alias("classification"),
        F.struct(F.lit("PENDING").alias("status"), F.lit("").alias("history")).alias("validation"),
    )


def difficulty(rate: Column, default: float = 0.5) -> Column:
    """One less the success rate, to two places; ``default`` for an unknown or zero rate."""
    return F.when(F.coalesce(rate, F.lit(0.0)) == 0, default).otherwise(F.bround(1 - rate, 2))


def hoist(df: DataFrame, group: str, fields: Sequence[str]) -> DataFrame:
    """Top-level fields moved into a map of metadata, whose own values win."""
    pairs = F.map_filter(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f).cast("string")))), lambda _, v: v.isNotNull())
    own = F.coalesce(F.col(group), F.create_map().cast("map<string,string>"))
    fresh = F.map_filter(pairs, lambda k, _: ~F.map_contains_key(own, k))
    return df.withColumn(group, F.map_concat(own, fresh)).drop(*fields)


def filled(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Nulls and empty strings replaced; ``corrections`` lists (field, old, new) of what changed."""
    log = []
    for name, value in defaults.items():
        empty = F.col(name).isNull() | (F.col(name).cast("string") == "")
        log.append(F.when(empty & value.isNotNull(), F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("old"), value.cast("string").alias("new"))))
    noted = df.withColumn("corrections", F.filter(F.array(*log), lambda x: x.isNotNull()))
    return noted.withColumns({n: F.when(F.col(n).isNull() | (F.col(n).cast("string") == ""), v).otherwise(F.col(n)) for n, v in defaults.items()})


def ordered_class(c: Column, rules: Sequence[tuple[str, str]], default: Column) -> Column:
    """The class of the first pattern that matches, in lower case."""
    return F.coalesce(*(F.when(F.lower(c).rlike(p), name) for p, name in rules), default)


def note(history: Column, *tags: Column) -> Column:
    """An audit trail with new tags, joined by `` | ``; null tags are left out."""
    return F.concat_ws(" | ", F.nullif(history, F.lit("")), *tags)


def patched(base: DataFrame, patch: DataFrame, key: str, longer: Sequence[str] = (), present: Sequence[str] = (), more: Sequence[str] = ()) -> DataFrame:
    """``base`` with a patch's values: texts only if strictly longer, lists and maps only if they hold more, others if
    they are there; ``changed`` names the fields.  The patch must have distinct keys."""
    p = patch.select(key, *(F.col(c).alias(f"_{c}") for c in (*longer, *present, *more)))
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    better = {c: size(F.col(f"_{c}")) > size(F.col(c)) for c in longer} | {c: F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(F.col(c)) for c in present} | {c: count(F.col(f"_{c}")) > count(F.col(c)) for c in more}
    joined = base.join(p, key, "left").withColumn("changed", F.filter(F.array(*(F.when(b, c) for c, b in better.items())), lambda x: x.isNotNull()))
    return joined.withColumns({c: F.when(F.array_contains("changed", c), F.col(f"_{c}")).otherwise(F.col(c)) for c in better}).drop(*(f"_{c}" for c in better))


def replaced(base: DataFrame, new: DataFrame, key: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """``base`` with the valid replacements in place of the rows of their keys, and the replacements that found none."""
    good = new.where(valid).select(*base.columns)
    kept = base.join(good.select(key), key, "left_anti").unionByName(good.join(base.select(key), key, "left_semi"))
    return kept, new.join(base.select(key), key, "left_anti")


def mapped(df: DataFrame, column: str, names: Mapping[str, str]) -> DataFrame:
    """A column's values by a map, others untouched; ``old`` has what was changed."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    new = F.try_element_at(table, F.col(column))
    return df.withColumn("old", F.when(new.isNotNull(), F.col(column))).withColumn(column, F.coalesce(new, F.col(column)))


def id_parts(old: Column, category: Column, prefixes: Sequence[tuple[str, str, str]], categories: Mapping[str, str]) -> Column:
    """(source, category) of an old id: by the first prefix that fits, else by its category, else general."""
    table = F.create_map(*(F.lit(x) for kv in categories.items() for x in kv))
    by_prefix = [F.when(F.startswith(old, F.lit(p)), F.struct(F.lit(s).alias("source"), F.lit(c).alias("category"))) for p, s, c in prefixes]
    return F.coalesce(*by_prefix, F.struct(F.lit("scratch").alias("source"), F.coalesce(F.try_element_at(table, category), F.lit("general")).alias("category")))


def corrected(df: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """A column from a table of corrections (key, new), where it has one; the first by value if a key has several."""
    c = corrections.groupBy(key).agg(F.min("new").alias("_new"))
    return df.join(c, key, "left").withColumn(column, F.coalesce("_new", F.col(column))).drop("_new")


def fill_pages(tables: DataFrame, pages: DataFrame, suffix: str = "-summary") -> DataFrame:
    """Null pages by the table's id, and if that is unknown by the id without a suffix.  ``pages``: id, page."""
    a = pages.groupBy("id").agg(F.min("page").alias("_a"))
    b = a.select(F.col("id").alias("_short"), F.col("_a").alias("_b"))
    short = tables.withColumn("_short", F.regexp_replace("id", f"{suffix}$", ""))
    return short.join(a, "id", "left").join(b, "_short", "left").withColumn("page", F.coalesce("page", "_a", "_b")).drop("_short", "_a", "_b")


def capped(value: Column, overlap: Column, cap: float = 0.35, at: float = 0.55) -> Column:
    """A difficulty of at most ``cap`` where question and chunk share ``at`` of their words."""
    return F.when(overlap >= at, F.least(value, F.lit(cap))).otherwise(value)


def answer_type(overlap: Column, at: float = 0.45) -> Column:
    """Extractive where question and chunk share ``at`` of their words, else reasoning; null for null."""
    return F.when(overlap >= at, "extractive").when(overlap < at, "reasoning")


def upsert_value(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """A table of key and value with one value set; ``old`` holds what it was."""
    one = pairs.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("_v"))
    both = pairs.join(one, "key", "full")
    return both.select("key", F.coalesce("_v", "value").alias("value"), F.when(F.col("_v").isNotNull(), F.col("value")).alias("old"))
