"""Readers and writers. Every reader has an explicit schema, so no pass is spent on inference and names stay strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varnika.functions.text import na_compat

#: The fields of an affidavit record in file order.
AFFIDAVIT = [
    "unique_id", "dropdown_value", "party_name", "name_english", "name_hindi", "assembly_constituency", "state", "application_uploaded", "current_status", "fathers_or_husbands_name_english",
    "name", "fathers_or_husbands_name_hindi", "address", "age", "url", "photo_url", "photo_filename_with_unique_id", "affidavit_filename_with_unique_id",
]
AFFIDAVIT_SCHEMA = ", ".join(f"{c} {'bigint' if c == 'unique_id' else 'string'}" for c in AFFIDAVIT)
PLAYER_SCHEMA = "id bigint, hindi_name string, hindi_long_name string, english_name string, gender string, date_of_birth string, country_id bigint, slug string"


def _compat(df: DataFrame, on: bool) -> DataFrame:
    return df.select(*[na_compat(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes]) if on else df


def read_csv(spark: SparkSession, path: str, schema: str, compat: bool = True) -> DataFrame:
    """CSV with a header and doubled quotes; with compat, the usual texts for a missing value are null."""
    return _compat(spark.read.schema(schema).option("header", True).option("escape", '"').csv(path), compat)


def read_tsv(spark: SparkSession, path: str, schema: str = "hindi string, english string, freq bigint", compat: bool = True) -> DataFrame:
    """TSV without header, columns by place. For swapped files give "english string, hindi string"."""
    return _compat(spark.read.schema(schema).option("sep", "\t").option("escape", '"').csv(path), compat)


def read_affidavits(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, AFFIDAVIT_SCHEMA)


def read_records(spark: SparkSession, path: str, schema: str = PLAYER_SCHEMA) -> DataFrame:
    """A JSON array of records, or several."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of integers as match_id rows."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<bigint>")).alias("match_id"))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def write_affidavits(df: DataFrame, path: str) -> None:
    """Affidavit records in file order; columns that df lacks are empty."""
    write_csv(df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in AFFIDAVIT]), path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def quarantined(df: DataFrame, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): df with the JSON of a column parsed, and the rows where that can't be, as they were, with a reason: malformed (no JSON) or schema (JSON of another kind).

    A null text is good, and null. Both frames read df, which should be cheap to read twice.
    """
    whole = f"struct<value:{schema},_corrupt:string>"
    wrapped = F.concat(F.lit('{"value":'), F.col(text), F.lit("}"))
    parsed = F.from_json(wrapped, whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    sound = F.try_parse_json(F.col(text)).isNotNull()
    marked = df.withColumns({"_parsed": F.when(sound, parsed), "_reason": F.when(F.col(text).isNotNull() & ~sound, "malformed")})
    marked = marked.withColumn("_reason", F.coalesce("_reason", F.when(F.col("_parsed._corrupt").isNotNull(), "schema")))
    good = marked.filter("_reason is null").withColumn(text, F.col("_parsed.value")).drop("_parsed", "_reason")
    return good, marked.filter("_reason is not null").withColumnRenamed("_reason", "reason").drop("_parsed")


def read_json_quarantined(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) records of a JSON-lines file: rows of the schema, and the lines that hold none, with the reason."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    good, bad = quarantined(lines.withColumnRenamed("value", "_record"), "_record", f"struct<{', '.join(':'.join(f.strip().split(None, 1)) for f in schema.split(','))}>")
    return good.select("_record.*"), bad.withColumnRenamed("_record", "record")
