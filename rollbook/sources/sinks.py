"""Writing tables and exports.  Every sink is one distributed write."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators.reduction import reduced_semi_join


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Store as Parquet and return the stored table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_bucketed(df: DataFrame, path: str, id_column: str, buckets: int) -> DataFrame:
    """Store as Parquet in buckets by id, each sorted, so that tables with as many buckets are joined by id without a shuffle.

    Choose ``buckets`` so that one fits a task.  Rows go to their bucket before the write, one file each.
    """
    name = f"rollbook_{uuid.uuid4().hex}"
    (df.repartition(buckets, id_column).write.mode("overwrite").option("path", path)
     .bucketBy(buckets, id_column).sortBy(id_column).saveAsTable(name))
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, path: str, id_column: str, buckets: int) -> DataFrame:
    """A table that ``write_bucketed`` stored, in another session."""
    name = f"rollbook_{uuid.uuid4().hex}"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (`{id_column}`) SORTED BY (`{id_column}`) "
              f"INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; NULL is an empty field, the empty string is quoted."""
    flat = df.select(*[
        F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes
    ])
    (
        flat.write.mode("overwrite")
        .options(header=True, quote='"', escape='"', encoding="UTF-8",
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )


def export_filtered(normalised: DataFrame, ids: DataFrame, path: str, id_column: str = "record_id") -> None:
    """All columns of the candidate rows."""
    write_csv(reduced_semi_join(normalised, ids, id_column), path)


def export_evidence_raw(raw: DataFrame, evidence_ids: DataFrame, path: str, id_column: str = "record_id") -> None:
    """All raw columns of the cited rows."""
    write_csv(reduced_semi_join(raw, evidence_ids, id_column), path)


def export_statistics(distributions: DataFrame, path: str) -> None:
    """Dimension, category, count and percentage."""
    write_csv(distributions.select("dimension", "category", "count", "percentage"), path)


def export_judgments(judgments: DataFrame, path: str, id_column: str = "record_id") -> None:
    """Record id, judgment and reason."""
    write_csv(judgments.select(id_column, "judgment", "reason"), path)


def export_build(
    normalised: DataFrame, catalog: DataFrame, mappings: DataFrame, findings: DataFrame, folder: str,
    mapping_columns: Sequence[str] = (
        "column_id", "raw_value", "canonical_id", "canonical_label", "ordinal", "status", "confidence", "source", "reason",
    ),
) -> None:
    """The four tables a build publishes."""
    write_csv(normalised, f"{folder}/normalized-data")
    write_csv(catalog, f"{folder}/column-catalog")
    write_csv(mappings.select(*mapping_columns), f"{folder}/normalize-map")
    write_csv(findings, f"{folder}/validation-results")
