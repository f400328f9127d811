"""Checks over datasets.  Every gate is one row: gate_id, passed, blocking, value, threshold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateFailure(ValueError):
    """Raised by require() for the first blocking gate that failed."""


def gate(df: DataFrame, gate_id: str, value: Column, passed: Column, threshold: str, blocking: bool = True) -> DataFrame:
    """A gate from aggregates over ``df``: ``passed`` may use the column ``value``."""
    return df.agg(value.cast("double").alias("value")).select(F.lit(gate_id).alias("gate_id"), F.coalesce(passed, F.lit(False)).alias("passed"), F.lit(blocking).alias("blocking"), F.round("value", 6).alias("value"), F.lit(threshold).alias("threshold"))


V = F.col


def none_of(df: DataFrame, gate_id: str, bad: Column, blocking: bool = True) -> DataFrame:
    """No row may be bad."""
    return gate(df, gate_id, F.count_if(bad), F.col("value") == 0, "= 0", blocking)


def ratio(df: DataFrame, gate_id: str, good: Column, low: float | None = None, high: float | None = None, of: Column | None = None, empty: bool = False, blocking: bool = True, strict: bool = False) -> DataFrame:
    """The share of good rows (among those of ``of``) must lie between ``low`` and ``high``; ``empty``: what no rows
    give.  ``strict``: ``high`` itself fails."""
    of = F.lit(True) if of is None else of
    value = F.try_divide(F.count_if(of & good), F.count_if(of))
    inside = F.lit(True)
    if low is not None:
        inside &= F.col("value") >= low
    if high is not None:
        inside &= F.col("value") < high if strict else F.col("value") <= high
    text = " and ".join(([f">= {low}"] if low is not None else []) + ([f"{'<' if strict else '<='} {high}"] if high is not None else []))
    return gate(df, gate_id, value, F.when(F.col("value").isNull(), empty).otherwise(inside), text, blocking)


def diversity(df: DataFrame, gate_id: str, column: str, least: int, ignored: Sequence[str] = (), blocking: bool = True) -> DataFrame:
    """At least so many distinct values, nulls and ignored ones aside."""
    c = F.when(~F.col(column).isin(list(ignored)), F.col(column)) if ignored else F.col(column)
    return gate(df, gate_id, F.count_distinct(c), F.col("value") >= least, f">= {least}", blocking)


def required_values(df: DataFrame, gate_id: str, column: str, required: Sequence[str], blocking: bool = True) -> DataFrame:
    """Every required value occurs; the gate's value is how many don't."""
    missing = F.size(F.array_except(F.array(*map(F.lit, required)), F.collect_set(F.when(F.col(column).isin(list(required)), F.col(column)))))
    return gate(df, gate_id, missing, F.col("value") == 0, "= 0", blocking)


def missing_keys(df: DataFrame, gate_id: str, key: str, other: DataFrame, other_key: str, where: Column | None = None, blocking: bool = True) -> DataFrame:
    """Every key (of the rows of ``where``) is in the other table; null keys don't count."""
    rows = df if where is None else df.where(where)
    lost = rows.where(F.col(key).isNotNull()).join(other.select(F.col(other_key).alias(key)).distinct(), key, "left_anti")
    return gate(lost, gate_id, F.count("*"), F.col("value") == 0, "= 0", blocking)


def same_count(a: DataFrame, b: DataFrame, gate_id: str, blocking: bool = True) -> DataFrame:
    """Two tables have as many rows; the gate's value is the difference."""
    both = a.agg(F.count("*").alias("n")).unionByName(b.agg((-F.count("*")).alias("n")))
    return gate(both, gate_id, F.sum("n"), F.col("value") == 0, "= 0", blocking)


def all_gates(*gates: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)


def verdict(gates: DataFrame) -> DataFrame:
    """How many gates passed, and whether all blocking ones did."""
    return gates.agg(F.count("*").alias("gates"), F.count_if("passed").alias("passed"), F.coalesce(F.bool_and(F.col("passed") | ~F.col("blocking")), F.lit(True)).alias("passed_all"))


def require(gates: DataFrame) -> DataFrame:
    """Raises GateFailure for the first blocking gate that failed, in the order of their ids; else the gates."""
    failed = gates.where("blocking and not passed").orderBy("gate_id").limit(1).collect()
    if failed:
        raise GateFailure(f"{failed[0].gate_id}: {failed[0].value} isn't {failed[0].threshold}")
    return gates


def store_gates(parents: DataFrame, children: DataFrame, summaries: DataFrame, indexed: DataFrame | None = None, most_tokens: int = 2098, coverage: float = 0.9, placeholder: str = "<!-- TABLE_") -> DataFrame:
    """The nine checks of a built collection: parents without children, orphans, null pages, null vectors, index in
    step with the table, oversized parents, token coverage, unresolved placeholders, summaries without a place."""
    indexed = children if indexed is None else indexed
    both = children.agg(F.sum("tokens").alias("c")).join(F.broadcast(parents.agg(F.sum("tokens").alias("p"))))
    return all_gates(
        missing_keys(parents, "I1", "id", children, "parent_id", (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) & (F.col("tokens") > 0)),
        missing_keys(children, "I2", "parent_id", parents, "id"),
        none_of(children, "I3", F.col("page").isNull()),
        none_of(children, "I4", F.col("embedding").isNull()),
        same_count(children, indexed, "I5"),
        none_of(parents, "I6", F.col("tokens") > most_tokens),
        gate(both, "I7", F.max(F.try_divide(F.col("c").cast("double"), F.col("p"))), F.col("value") >= coverage, f">= {coverage}"),
        none_of(children, "I8", F.contains(F.coalesce("text", F.lit("")), F.lit(placeholder))),
        none_of(summaries, "I9", F.col("source").isNull() | F.col("page").isNull()),
    )


def row_errors(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``errors``: the names of the rules that a row breaks (a null counts as broken); only rows with some."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]
    return df.withColumn("errors", F.filter(F.array(*broken), lambda e: e.isNotNull())).where(F.size("errors") > 0)


def filled_fields(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """How many fields, those of structs included, are neither null nor empty."""
    from pyspark.sql.types import ArrayType, MapType, StringType, StructType

    def leaves(schema: StructType, prefix: str = "") -> list[Column]:
        out = []
        for f in schema.fields:
            name = f"{prefix}`{f.name}`"
            if isinstance(f.dataType, StructType):
                out += leaves(f.dataType, name + ".")
            elif isinstance(f.dataType, StringType):
                out.append(F.col(name).isNotNull() & (F.col(name) != ""))
            elif isinstance(f.dataType, (ArrayType, MapType)):
                out.append(F.col(name).isNotNull() & (F.size(name) > 0))
            else:
                out.append(F.col(name).isNotNull())
        return out

    schema = StructType([f for f in df.schema.fields if columns is None or f.name in columns])
    return reduce(lambda a, b: a + b, (c.cast("int") for c in leaves(schema)), F.lit(0))


def snapshot(df: DataFrame, key: str, groups: Sequence[str]) -> DataFrame:
    """The shape of a dataset in long form: (measure, value, n) for the total, the filled fields and each group."""
    filled = filled_fields(df)
    counted = df.withColumn("_f", filled)
    total = counted.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.min("_f").alias("least_fields"), F.max("_f").alias("most_fields"))
    long = total.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.lit("").alias("value"), F.col(c).cast("long").alias("n")) for c in total.columns))).alias("x")).select("x.*")
    cols = [F.col(g).cast("string") for g in groups]
    if not groups:
        return long
    sides = F.explode(F.array(*(F.struct(F.lit(g).alias("measure"), F.coalesce(c, F.lit("null")).alias("value")) for g, c in zip(groups, cols)))).alias("x")
    return long.unionByName(df.select(sides).groupBy("x.measure", "x.value").agg(F.count("*").alias("n")))


def compare(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """How many keys were lost, added and kept."""
    a, b = before.select(F.col(key).alias("k"), F.lit(1).alias("a")).distinct(), after.select(F.col(key).alias("k"), F.lit(1).alias("b")).distinct()
    both = a.join(b, "k", "full")
    state = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "added").otherwise("kept")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def grounding(answer: Column, text: Column, words: Column, similarity: Column | None = None, share: float = 0.8, close: float = 0.9) -> Column:
    """How an answer is grounded in a text: verbatim, keyword, semantic, else none; the first that holds.

    Without keywords the keyword check passes."""
    from ..functions.text import match_key, overlap

    verbatim = (F.length(F.trim(answer)) > 0) & F.contains(match_key(text), match_key(answer))
    keyword = F.coalesce(overlap(words, match_key(text)), F.lit(1.0)) >= share
    chain = F.when(F.coalesce(verbatim, F.lit(False)), "verbatim").when(F.coalesce(keyword, F.lit(False)), "keyword")
    if similarity is not None:
        chain = chain.when(similarity >= close, "semantic")
    return chain.otherwise("none")


def numbers_hold(answer: Column, text: Column) -> Column:
    """All numbers of the answer stand in the text; a decimal comma counts as a point."""
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")))
    return F.size(F.array_except(numbers(answer), numbers(text))) == 0
