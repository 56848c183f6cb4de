"""All queries of the core, and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from presswerk.plans import reports, selection, texts
from presswerk.session import shared_path
from presswerk.sources.tables import tables

Query = Callable[[SparkSession, str], DataFrame]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from presswerk.operators.timestamps import published_instants

    # The dictionary that later batches would extend; here it starts empty.
    return published_instants(*tables(spark, folder, "articles", "feeds"), shared_path(spark, "dictionary"))


def queries() -> dict[str, Query]:
    return {"p5_found": p5_found, **texts.QUERIES, **reports.QUERIES, **selection.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**texts.SQL, **reports.SQL, **selection.SQL}
