"""Answer keys and grids of exams: from Markdown tables and texts to rows.

Tables come as the rows of ``tables.rows`` (header, row_idx, cells).  Columns are found by what their names contain, so the
layout of a key is data, not code; grids without names are read by what their cells hold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the names of the columns of an answer key contain, in lower case.
ROLES = {"number": ("question",), "answer": ("ponse", "answer", "corrig"), "reference": ("article", "document"), "rate": ("taux", "rate")}
LETTERS = "A-F"


def _first_named(header: Column, parts: Sequence[str]) -> Column:
    """The place (from 0) of the first name that contains one of the parts; -1 without one."""
    named = F.transform(header, lambda h: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(h), p)))
    return (F.coalesce(F.array_position(named, F.lit(True)), F.lit(0)) - 1).cast("int")


def answer_key(rows: DataFrame, key: str = "id", roles: Mapping[str, Sequence[str]] = ROLES, default_first: bool = False, last_wins: bool = False) -> DataFrame:
    """key, number, answer, reference, rate, difficulty of each row that begins with a number.

    The names may stand in the first row instead of the header.  A reference or rate in the first column isn't read.
    ``default_first``: without a name the first column holds the numbers, and rows without an answer are left out; tables
    without a column of answers have no rows.  ``last_wins``: of several rows with a number the last one stays.  Rates are
    whole per cents; difficulty is what is missing to 1."""
    below = F.concat_ws(" ", F.transform("cells", F.lower))
    is_names = (F.col("row_idx") == 0) & F.contains(below, F.lit(roles["number"][0])) & F.exists(F.array(*map(F.lit, roles["answer"])), lambda p: F.contains(below, p))
    whole = Window.partitionBy(key)
    named = rows.withColumn("_names", F.max(F.when(is_names, F.col("cells"))).over(whole)).withColumn("header", F.coalesce("_names", "header"))
    named = named.where(F.col("_names").isNull() | (F.col("row_idx") > 0))
    at = {role: _first_named(F.col("header"), parts) for role, parts in roles.items()}
    found = named.select(key, "row_idx", "cells", *(c.alias(f"_{role}") for role, c in at.items()))
    number = F.when(F.col("_number") >= 0, F.col("_number")).otherwise(0 if default_first else -1)
    cell = lambda i, least=0: F.when(i >= least, F.get("cells", i))
    read = found.select(
        key,
        "row_idx",
        F.regexp_extract(F.trim(cell(number)), r"^(\d{1,9})", 1).try_cast("int").alias("number"),
        F.upper(F.trim(cell(F.col("_answer")))).alias("answer"),
        F.coalesce(F.trim(cell(F.col("_reference"), 1)), F.lit("")).alias("reference"),
        (F.regexp_extract(cell(F.col("_rate"), 1), r"(\d{1,9})", 1).try_cast("int") / 100).alias("rate"),
    ).where("number is not null and answer is not null")
    if default_first:
        read = read.where("answer <> ''")
    if last_wins:
        w = Window.partitionBy(key, "number").orderBy(F.col("row_idx").desc())
        read = read.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return read.select(key, "number", "answer", "reference", "rate", F.bround(1 - F.col("rate"), 2).alias("difficulty"))


def answer_grid(rows: DataFrame, key: str = "id") -> DataFrame:
    """key, number, letter of a grid in any of its layouts: ``12 B`` in a cell, a letter beside its number, or below it.

    Of several letters of a number a valid one comes first, then the one that stands first."""
    head = rows.where("row_idx = 0").select(key, F.lit(-1).alias("row_idx"), F.col("header").alias("cells"))
    each = head.unionByName(rows.select(key, "row_idx", "cells"))
    below = F.lead("cells").over(Window.partitionBy(key).orderBy("row_idx"))
    each = each.withColumn("_below", F.coalesce(below, F.array().cast("array<string>")))
    number = lambda c: F.regexp_extract(c, r"^\s*[Qq]?\s*(\d{1,3})\s*$", 1)
    letter = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    pair = lambda n, x, way: F.struct(n.try_cast("int").alias("number"), x.alias("letter"), F.lit(way).alias("way"))
    joined = F.transform("cells", lambda c: pair(F.regexp_extract(c, rf"(?i)^\s*[Qq]?\s*(\d{{1,3}})\s*[-.):]?\s*[{LETTERS}]\s*$", 1), F.upper(F.regexp_extract(c, rf"(?i)([{LETTERS}])\s*$", 1)), 0))
    beside = F.transform(F.arrays_zip(F.col("cells").alias("a"), F.slice("cells", 2, 1 << 30).alias("b")), lambda p: pair(number(p["a"]), letter(p["b"]), 1))
    under = F.transform(F.arrays_zip(F.col("cells").alias("a"), F.col("_below").alias("b")), lambda p: pair(number(p["a"]), letter(p["b"]), 2))
    found = each.select(key, "row_idx", F.posexplode(F.concat(joined, beside, under)).alias("_pos", "x")).select(key, "row_idx", "_pos", "x.*")
    found = found.where(F.col("number").isNotNull() & F.col("letter").rlike(r"^\p{L}$"))
    valid = F.col("letter").rlike(f"^[{LETTERS}]$")
    w = Window.partitionBy(key, "number").orderBy(valid.desc(), "way", "row_idx", "_pos")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "number", "letter")


def explanation(c: Column, least: int = 20) -> Column:
    """What a corrected question says after its reference: the text below the first line with a reference that follows the
    last choice; null if there is none, if it is shorter than ``least``, or of digits only."""
    choice = rf"(?:^|\n)[ \t]*[-*]?[ \t]*[{LETTERS}][ \t]*[-.):][^\n]*\n"
    rest = F.regexp_extract(c, rf"(?s)^.*{choice}(.*)$", 1)
    rest = F.when(rest == "", c).otherwise(rest)
    said = F.trim(F.regexp_replace(F.regexp_extract(rest, r"(?is)^(?:.*?\n)??[^\n]*(?:\barticle|\bart\.|\bannexe|\bchapitre)[^\n]*\n(.*)$", 1), r"\s+", " "))
    return F.when((F.length(said) >= least) & ~said.rlike(r"^[\d\s]*$"), said)
