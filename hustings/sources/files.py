"""Readers of the input files and writers of the result tables."""

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hustings.functions.text import trim_spaces
from hustings.operators.ingest import RAW_COLUMNS
from hustings.sources.records import csv_records

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


def scan_votes(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The roll-call file as text columns and `row_no`, its order.

    Line breaks may stand inside quotes: records are found by the quotes of each byte range, so a
    large file is many tasks, at the price of counting quotes first. `multi_line=False` saves that
    pass where there are no such breaks. An empty cell is an empty text, never null.
    """
    if multi_line:
        records = csv_records(spark, path)
        # The header is the first record of each file.
        cells = F.from_csv("record", RAW_SCHEMA.toDDL(), {"escape": '"', "multiLine": "true"}).alias("c")
        rows = records.where("row_no.block <> 0 OR row_no.pos <> 0").select(cells, "row_no").select("c.*", "row_no")
        return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in RAW_COLUMNS], "row_no")
    rows = (
        spark.read.schema(RAW_SCHEMA)
        .option("header", True)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )
    return rows.select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in RAW_COLUMNS],
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
        ).alias("row_no"),
    )


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Forced links (slug, member_name, row_no); lines with a blank side are skipped."""
    lines = (
        spark.read.option("header", True)
        .schema("candidate_slug string, member_canonical_name string, note string")
        .option("multiLine", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )
    return lines.select(
        trim_spaces(F.col("candidate_slug")).alias("slug"),
        trim_spaces(F.col("member_canonical_name")).alias("member_name"),
        F.monotonically_increasing_id().alias("row_no"),
    ).where("slug <> '' AND member_name <> ''")


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


QUESTION_SET = (
    "election_year int, questions array<struct<id: string, topic: string, statement: string, explainer: string>>"
)


def read_questions(spark: SparkSession, path: str, default_year: int = 2026) -> DataFrame:
    """A question set: one JSON document (`election_year`, `questions`), in the order of its list."""
    document = spark.read.schema(QUESTION_SET).option("multiLine", True).json(path)
    year = F.coalesce("election_year", F.lit(default_year)).alias("election_year")
    rows = document.select(year, F.posexplode("questions").alias("sort_order", "q"))
    return rows.select(
        F.col("q.id").alias("question_id"), "q.topic", "q.statement", "q.explainer", "election_year", "sort_order"
    )


QUESTION_LINE = "id string, topic string, statement string, explainer string, election_year int, sort_order int"


def write_question_lines(questions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Questions (question_id, topic, statement[, explainer, election_year], sort_order) as JSON lines."""
    questions.withColumnRenamed("question_id", "id").write.mode(mode).json(path)


def read_question_lines(spark: SparkSession, path: str, default_year: int = 2026) -> DataFrame:
    """A question set as JSON lines, each a question with its place in the list; any number of files and tasks."""
    lines = spark.read.schema(QUESTION_LINE).json(path)
    year = F.coalesce("election_year", F.lit(default_year)).alias("election_year")
    return lines.select(F.col("id").alias("question_id"), "topic", "statement", "explainer", year, "sort_order")


def check_questions(questions: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, unknown): questions whose topic is in the vocabulary, and the others."""
    known = topics.select("topic").distinct()
    return (
        questions.join(known, "topic", "left_semi"),
        questions.join(known, "topic", "left_anti"),
    )


def require_known_topics(questions: DataFrame, topics: DataFrame) -> DataFrame:
    """The questions; an unknown topic is an error."""
    valid, unknown = check_questions(questions, topics)
    first = unknown.select("question_id", "topic").first()
    if first is not None:
        raise ValueError(f"unknown topic for {first['question_id']}: {first['topic']}")
    return valid


def write_tables(tables: Mapping[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """Write the normalised tables as Parquet, parents first; votes by year of the division.

    The rebalance hint gives each year files of even size, splitting a large year.
    """
    for name in ("members", "propositions", "divisions"):
        tables[name].write.mode(mode).parquet(f"{root}/{name}")
    spark = tables["votes"].sparkSession
    years = spark.read.parquet(f"{root}/divisions").select("division_id", F.year("date").alias("year"))
    tables["votes"].join(years, "division_id").hint("rebalance", "year").write.mode(mode).partitionBy(
        "year"
    ).parquet(f"{root}/votes")


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {
        name: spark.read.parquet(f"{root}/{name}")
        for name in ("members", "propositions", "divisions", "votes")
    }


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
