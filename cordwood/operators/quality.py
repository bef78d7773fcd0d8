"""Data-quality queries over stored rows and summaries."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordwood.operators.summary import SUMMARY_FIELDS
from cordwood.schemas import LEVELS, SCHEMA_VERSION

_MAX_SAFE_INTEGER = (1 << 53) - 1


def contract_violations(logs: DataFrame) -> DataFrame:
    """Stored rows a reader would refuse."""
    is_object = F.try_variant_get("attributes", "$", "map<string,variant>").isNotNull()
    string_source = F.forall(F.map_values("source"), lambda v: v.isNotNull())
    well_formed = reduce(
        and_,
        [
            F.col("schema_version") == SCHEMA_VERSION,
            F.length("id") > 0,
            F.length("service") > 0,
            F.col("level").isin(*LEVELS),
            F.col("message").isNotNull(),
            F.col("timestamp").isNotNull(),
            is_object,
            string_source,
        ],
    )
    return logs.where(~F.coalesce(well_formed, F.lit(False)))


def summary_contract(counts: DataFrame) -> DataFrame:
    """Whether each count of a summary is a non-negative safe integer."""
    checks = [
        F.coalesce(F.col(name).between(0, _MAX_SAFE_INTEGER), F.lit(False)).alias(name)
        for name in SUMMARY_FIELDS
    ]
    checked = counts.select(*checks)
    return checked.withColumn("valid", reduce(and_, [F.col(name) for name in SUMMARY_FIELDS]))


def constraint_violations(logs: DataFrame) -> DataFrame:
    """``violated, id, row_count``: ids with a foreign version, and ids stored more than once."""
    per_id = logs.groupBy("id").agg(
        F.count_if(~F.equal_null(F.col("schema_version"), F.lit(SCHEMA_VERSION))).alias("foreign"),
        F.count(F.lit(1)).alias("stored"),
    )
    broken = F.array(
        F.struct(F.lit("schema_version").alias("violated"), F.col("foreign").alias("row_count")),
        F.struct(
            F.lit("unique_id").alias("violated"),
            F.when(F.col("stored") > 1, F.col("stored")).otherwise(F.lit(0)).alias("row_count"),
        ),
    )
    rows = per_id.select("id", F.inline(F.filter(broken, lambda b: b["row_count"] > 0)))
    return rows.select("violated", "id", "row_count")
