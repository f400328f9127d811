"""Reading collections: explicit schemas, files in order, bad files as rows of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARENTS = "id string, text string, source string, section string, tokens int, page int"
CHILDREN = "id string, text string, embedding array<float>, parent_id string, source string, page int, article_num string, section string, tokens int"
SUMMARIES = "id string, summary_text string, raw_table_text string, embedding array<float>, source string, page int, tokens int"
CELLS = "table_id string, row_idx int, col_name string, cell_value string, source string, page int"
SYNTHETIC = "id string, question string, embedding array<float>, child_id string, source string, page int"
DOCUMENTS = "source string, markdown string, heading_pages map<string,int>, text_pages array<struct<text:string,page:int>>"
TRIPLETS = "anchor string, positive string, negative string, metadata map<string,string>"


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf", excluded: tuple[str, ...] = ()) -> DataFrame:
    """path, length, content of all files below a folder, without those in excluded folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    for name in excluded:
        found = found.where(~F.array_contains(F.split("path", "/"), name))
    return found.select("path", "length", "content")


def json_documents(spark: SparkSession, path: str, schema: str = DOCUMENTS) -> DataFrame:
    """One JSON document a file, with its file's name; unreadable ones keep their text in ``_error``."""
    return spark.read.schema(f"{schema}, _error string").option("columnNameOfCorruptRecord", "_error").option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def json_map(spark: SparkSession, path: str, field: str, value: str = "string") -> DataFrame:
    """key, value of an object within a JSON file.  A file without entries raises ValueError."""
    rows = spark.read.schema(f"`{field}` map<string,{value}>").option("multiLine", True).json(path).select(F.explode(field).alias("key", "value"))
    if rows.limit(1).count() == 0:
        raise ValueError(f"{path} has no {field}")
    return rows


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """id, text, source, page from {"chunks": [...]} or a list of chunks."""
    one = "id string, text string, source string, page int"
    wrapped = spark.read.schema(f"chunks array<struct<{one.replace(' ', ':').replace(',:', ',')}>>, {one}").option("multiLine", True).json(path)
    listed = wrapped.where("chunks is null and id is not null").select("id", "text", "source", "page")
    return wrapped.where("chunks is not null").select(F.explode("chunks").alias("c")).select("c.*").unionByName(listed)


def tab_separated(spark: SparkSession, path: str, schema: str, label: str | None = None, most: int | None = None) -> DataFrame:
    """A table with a header; only rows whose label is 0 or 1, and ``most`` rows where a sampling setting asks for that."""
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
    if label:
        rows = rows.where(F.col(label).isin(0, 1))
    return rows.limit(most) if most else rows


def with_summaries(tables: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables with a summary (key, value), and the summaries without a table."""
    s = summaries.select(F.col("key").alias("id"), F.col("value").alias("summary_text"))
    return tables.join(s, "id"), s.join(tables.select("id"), "id", "left_anti")


def expected_pages(questions: DataFrame) -> DataFrame:
    """Answerable questions as (query_id, source, page) with class and difficulty.

    ``questions``: id, is_impossible, docs, pages, reasoning_class, difficulty.  Lists of unequal length raise."""
    kept = questions.where(~F.coalesce("is_impossible", F.lit(False)))
    even = F.when(F.size("docs") != F.size("pages"), F.raise_error(F.concat(F.lit("docs and pages differ in length: "), "id"))).otherwise(F.arrays_zip("docs", "pages"))
    return kept.select(F.col("id").alias("query_id"), F.explode(even).alias("x"), F.coalesce("reasoning_class", F.lit("unknown")).alias("reasoning_class"), F.coalesce("difficulty", F.lit(0.5)).alias("difficulty")).select("query_id", F.col("x.docs").alias("source"), F.col("x.pages").alias("page"), "reasoning_class", "difficulty")


def paragraphs(docs: DataFrame, more_than: int = 20) -> DataFrame:
    """source, pos, paragraph: the paragraphs of Markdown documents."""
    from ..functions.text import paragraphs as split

    return docs.select("source", F.posexplode(split(F.col("markdown"), more_than)).alias("pos", "paragraph"))
