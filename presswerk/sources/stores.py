"""Tables and files at rest: schemas, appended facts, batch results, files by age, configuration, JDBC."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that appended tables have. A new column is added at the end and may be null.
SCHEMAS = {
    "api_calls": "id bigint, run_id string, module string, model string, request_type string, batch_id string, input_tokens bigint, output_tokens bigint, total_tokens bigint, cost double, success boolean, error_message string, created_at timestamp, completed_at timestamp",
    "article_images": "article_id bigint, image_url string, local_path string, image_width int, image_height int, format string, file_size bigint, extraction_quality double, is_featured boolean, extraction_method string, created_at timestamp",
    "digests": "digest_date date, version int, json_output string, markdown_output string, german_output string, article_count int, run_id string, created_at timestamp",
    "cache_stats": "date date, cache_type string, requests bigint, hits bigint, misses bigint, api_calls_saved bigint, cost_saved double",
}


def aligned(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """df with exactly the columns of a schema: missing ones null, others dropped, types cast. Older rows become readable as the newest version."""
    fields = T.StructType.fromDDL(schema).fields if isinstance(schema, str) else schema.fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def read_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A Parquet table whose files were written by several versions, as the newest; an absent one is empty."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return aligned(spark.read.option("mergeSchema", "true").parquet(path), schema)


def append(df: DataFrame, path: str, schema: str | T.StructType) -> None:
    aligned(df, schema).write.mode("append").parquet(path)


def call_facts(calls: DataFrame) -> DataFrame:
    """Cost facts of calls: failed ones cost nothing and keep their message."""
    failed = ~F.coalesce("success", F.lit(False))
    return calls.withColumns({c: F.when(failed, 0).otherwise(F.col(c)) for c in ("input_tokens", "output_tokens", "cost")}).withColumns(
        {"total_tokens": F.col("input_tokens") + F.col("output_tokens"), "error_message": F.when(failed, F.coalesce("error_message", F.lit("failed")))}
    )


def batch_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(custom_id, ok, answer, error) of a model's batch results, a JSON object a line; answer is parsed by schema, and null if it isn't of it."""
    lines = spark.read.schema("custom_id string, response string, error string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    text = F.get_json_object("response", "$.body.choices[0].message.content")
    answer = F.from_json(text, schema)
    return lines.filter("custom_id IS NOT NULL").select("custom_id", (F.col("error").isNull() & answer.isNotNull()).alias("ok"), answer.alias("answer"), "error")


def file_table(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, bytes) of all files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def file_stats(files: DataFrame, warn_bytes: int = 1 << 30) -> DataFrame:
    """(files, bytes, oldest, newest, full)"""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("modified").alias("oldest"), F.max("modified").alias("newest"), (F.coalesce(F.sum("bytes"), F.lit(0)) > warn_bytes).alias("full"))


def outdated(files: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """The files that are older than so many days: what a clean-up deletes."""
    return files.filter(F.col("modified") < as_of - F.make_interval(days=F.lit(days)))


def read_master(spark: SparkSession, url: str, table: str, columns: list[str], **options: str) -> DataFrame:
    """A company master over JDBC: columns and filters of the plan are pushed down to the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(*columns)


def load_yaml(path: str) -> dict:
    """A configuration file; an empty one has no entries."""
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def save_yaml(path: str, config: dict) -> None:
    import yaml

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(config, allow_unicode=True, sort_keys=False))


FEED = "name string, type string, url string, priority int, max_age_hours int, rate_limit_seconds double, language string, enabled boolean, tz_name string, locale_code string"
# What a feed's entry need not say.
FEED_DEFAULTS = {"priority": 3, "max_age_hours": 48, "rate_limit_seconds": 1.0, "language": "de", "enabled": True, "tz_name": "UTC", "locale_code": "de-CH"}


def feed_table(spark: SparkSession, path: str) -> DataFrame:
    """The feeds of a YAML file (`feeds:` a list of entries with name, type and url) as a table."""
    entries = load_yaml(path).get("feeds") or []
    names = [f.split()[0] for f in FEED.split(", ")]
    rows = []
    for e in entries:
        missing = [k for k in ("name", "type", "url") if not e.get(k)]
        if missing:
            raise ValueError(f"a feed without {', '.join(missing)}: {e}")
        full = FEED_DEFAULTS | e
        rows.append(tuple(float(full[n]) if n == "rate_limit_seconds" else full.get(n) for n in names))
    return spark.createDataFrame(rows, FEED)


def topic_table(spark: SparkSession, path: str) -> DataFrame:
    """(topic, label, keywords) of a YAML file (`topics:` a mapping of names to entries)."""
    entries = load_yaml(path).get("topics") or {}
    rows = [(k, (e or {}).get("label", k), list((e or {}).get("keywords") or [])) for k, e in entries.items()]
    return spark.createDataFrame(rows, "topic string, label string, keywords array<string>")
