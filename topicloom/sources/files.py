"""File sources and sinks with explicit schemas."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from topicloom.functions import fixed_values as V
from topicloom.functions import text as T

CASE_SCHEMA = (
    "case_id string, case_name string, case_number string, date double, "
    "judgment_issue string, judgment_summary string, judgment_contents string"
)
PAPER_SCHEMA = "title string, abstract string, `journal-ref` string"


def read_csv(spark: SparkSession, path: str, schema: str, nulls: Sequence[str] = V.CSV_NULLS, mode: str = "fail", multi_line: bool = True) -> DataFrame:
    """CSV with header; columns are found by their header name, others are skipped.

    Files of one read have one header.  A column that the header lacks raises.
    ``mode="fail"`` also raises on a row with another number of fields and on a
    cell that is no value of its type; ``mode="null"`` makes such cells null.
    With ``multi_line`` quoted fields may hold line ends, and a file is one
    task; files without such fields are read in splits with it off.
    """
    if mode not in ("fail", "null"):
        raise ValueError(f"mode must be fail or null, not {mode!r}")
    wanted = spark.createDataFrame([], schema).schema

    def reader():
        return (
            spark.read.option("header", True)
            .option("multiLine", multi_line)
            .option("escape", '"')
            .option("mode", "FAILFAST" if mode == "fail" else "PERMISSIVE")
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )

    # only the header is read here; an unnamed first column is called _c0
    names = reader().csv(path).columns
    missing = [f.name for f in wanted if f.name not in names]
    if missing:
        raise ValueError(f"the CSV header has no column {', '.join(missing)}")
    texts = S.StructType([S.StructField(n, S.StringType()) for n in names])
    named = not any(n.startswith("_c") for n in names)
    raw = reader().option("enforceSchema", not named).option("columnPruning", mode == "null").schema(texts).csv(path)
    return raw.select(*[_typed(f, nulls, mode).alias(f.name) for f in wanted])


def csv_header(spark: SparkSession, path: str, wanted: S.StructType) -> list[str]:
    """Column names of the header, which must hold all wanted ones."""
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    missing = [f.name for f in wanted if f.name not in names]
    if missing:
        raise ValueError(f"the CSV header has no column {', '.join(missing)}")
    return names


def _typed(field: S.StructField, nulls: Sequence[str], mode: str) -> Column:
    cell = F.col(f"`{field.name}`")
    cell = F.when(~cell.isin(*nulls), cell)
    if isinstance(field.dataType, S.StringType):
        return cell
    value = cell.try_cast(field.dataType)
    if mode == "null":
        return value
    wrong = F.raise_error(F.concat(F.lit(f"column {field.name}: no {field.dataType.simpleString()}: "), cell))
    return F.when(cell.isNotNull() & value.isNull(), wrong.cast(field.dataType)).otherwise(value)


def null_tokens(df: DataFrame, nulls: Sequence[str] = V.CSV_NULLS) -> DataFrame:
    """String cells that stand for a missing value become null."""
    return df.select(
        *[
            F.when(~F.col(f.name).isin(*nulls), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, S.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, null: str = "NaN", mode: str = "errorifexists") -> None:
    """CSV with header; null cells are written as ``null``."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("nullValue", null)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_json_lines(spark: SparkSession, path: str, schema: str | S.StructType = PAPER_SCHEMA, mode: str = "fail") -> DataFrame:
    """One object per line; keys outside the schema are skipped, missing keys are null.

    A broken line raises; with ``mode="null"`` it is a row of nulls.
    """
    if mode not in ("fail", "null"):
        raise ValueError(f"mode must be fail or null, not {mode!r}")
    return spark.read.schema(schema).option("mode", "FAILFAST" if mode == "fail" else "PERMISSIVE").json(path)


def json_fields(text: Column, schema: str) -> Column:
    """Fields of a JSON column; a missing key is null."""
    return F.from_json(text, schema)


def read_xml_records(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Records of fetched XML payload files."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def xml_fields(payload: Column, schema: str) -> Column:
    """Elements of an XML payload column."""
    return F.from_xml(payload, schema)


def xml_listing(df: DataFrame, payload_col: str, record_tag: str, link_tag: str, total_tag: str) -> DataFrame:
    """Listing payloads as one row per record: the caller's columns, total, position and link."""
    schema = f"`{total_tag}` bigint, `{record_tag}` array<struct<`{link_tag}`: string>>"
    keep = [c for c in df.columns if c != payload_col]
    parsed = df.select(*keep, xml_fields(F.col(payload_col), schema).alias("_x"))
    links = F.col(f"_x.`{record_tag}`.`{link_tag}`").alias("_links")
    flat = parsed.select(*keep, F.col(f"_x.`{total_tag}`").alias("total"), links)
    return flat.select(*keep, "total", F.posexplode("_links").alias("pos", "link"))


def xml_detail(df: DataFrame, payload_col: str, tags: dict[str, str]) -> DataFrame:
    """Detail payloads as one row with a text column per tag; empty elements are null."""
    schema = ", ".join(f"`{tag}` string" for tag in tags)
    keep = [c for c in df.columns if c != payload_col]
    parsed = df.select(*keep, xml_fields(F.col(payload_col), schema).alias("_x"))
    return parsed.select(*keep, *[F.nullif(T.strip(F.col(f"_x.`{tag}`")), F.lit("")).alias(name) for tag, name in tags.items()])


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed lines of a word file; carriage returns go with the whitespace."""
    lines = spark.read.text(path).select(T.strip(F.col("value")).alias("word"))
    return lines.where(F.col("word") != "").distinct()


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One-column text sink."""
    df.write.mode(mode).text(path)


def write_line_files(df: DataFrame, folder: str, name_col: str, names: Sequence[str]) -> None:
    """One text sink per name in ``folder``, by one job over ``(line, name_col)`` sorted by name in each partition."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in names:
        if system.exists(path(f"{folder}/{name}")):
            raise FileExistsError(f"{folder}/{name}")
    written = f"{folder}/_written-{uuid.uuid4().hex}"
    df.write.partitionBy(name_col).text(written)
    for name in names:
        if system.exists(path(f"{written}/{name_col}={name}")):
            system.rename(path(f"{written}/{name_col}={name}"), path(f"{folder}/{name}"))
        else:
            write_lines(spark.createDataFrame([], "line string"), f"{folder}/{name}")
    system.delete(path(written), True)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines sink for nested records."""
    df.write.mode(mode).json(path)
