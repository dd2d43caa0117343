"""Feedback, the lessons drawn from it, and the stored ledger they are appended to.

A ledger is a folder: ``lessons`` holds what attempts to append wrote, each in a part of its own, and
``commits`` one small file per batch, numbered, saying which attempt counts, from which number on and how many
lessons.  The file is created only if its number is still free, so of two writers one commits and the other starts again;
an attempt without a commit is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.fixed import FEEDBACK_ID_FORMAT, LESSON_ID_FORMAT, LESSON_STATUSES
from rollbook.operators.numbering import number_rows


def coerce_status(status: Column) -> Column:
    """One of the four life-cycle states; anything else is a candidate."""
    return F.when(status.isin(LESSON_STATUSES), status).otherwise(F.lit("candidate"))


def record_feedback(feedback: DataFrame, arrival: Sequence[str], ledger_size: int = 0) -> DataFrame:
    """Turn feedback rows into candidate lessons, numbered on from the ledger.

    ``feedback`` holds run_id, lesson_type, user_feedback, derived_lesson and
    scope; ``arrival`` names the columns giving its total order.
    """
    numbered = number_rows(feedback, arrival, "_n", start=ledger_size + 1)
    return numbered.select(
        F.format_string(LESSON_ID_FORMAT, "_n").alias("lesson_id"),
        F.format_string(FEEDBACK_ID_FORMAT, "_n").alias("feedback_id"),
        "run_id", "lesson_type", "user_feedback", "derived_lesson", "scope",
        F.lit("candidate").alias("status"),
    )


_LESSONS = (
    "lesson_id string, feedback_id string, run_id string, lesson_type string, user_feedback string, derived_lesson string,"
    " scope map<string,string>, status string, attempt string"
)
_COMMITS = "batch_key string, attempt string, first long, n_lessons long"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _committed(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The commits, and how many numbers are taken."""
    files, place = _folder(spark, f"{path}/commits")
    taken = len(files.listStatus(place)) if files.exists(place) else 0
    return (spark.read.schema(_COMMITS).json(f"{path}/commits") if taken else spark.createDataFrame([], _COMMITS)), taken


def _commit(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Create the commit of this number; False if another writer has it."""
    files, place = _folder(spark, f"{path}/commits/{number:09d}.json")
    try:
        stream = files.create(place, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    return True


def append_feedback(feedback: DataFrame, arrival: Sequence[str], path: str, batch_key: str) -> DataFrame:
    """Append a batch of feedback to the ledger under ``path``, numbered on from what it holds, and return the ledger.

    A batch key that is committed already is ignored, so a repeated batch does no harm.
    """
    spark = feedback.sparkSession
    while True:
        commits, taken = _committed(spark, path)
        size, known = commits.agg(F.coalesce(F.sum("n_lessons"), F.lit(0)), F.count_if(F.col("batch_key") == batch_key)).first()
        if known:
            return read_ledger(spark, path)
        attempt = uuid.uuid4().hex
        place = f"{path}/lessons/attempt={attempt}"
        record_feedback(feedback, arrival, size).write.parquet(place)
        n = spark.read.parquet(place).count()
        if _commit(spark, path, taken, {"batch_key": batch_key, "attempt": attempt, "first": size + 1, "n_lessons": n}):
            return read_ledger(spark, path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The lessons of committed batches, with their batch key."""
    commits, taken = _committed(spark, path)
    if not taken:
        return spark.createDataFrame([], _LESSONS).drop("attempt").withColumn("batch_key", F.lit(None).cast("string"))
    stored = spark.read.schema(_LESSONS).parquet(f"{path}/lessons")
    return stored.join(commits.select("attempt", "batch_key"), "attempt").drop("attempt")


def applicable_lessons(lessons: DataFrame, analysis_type: str | None = None, only_accepted: bool = False) -> DataFrame:
    """Live lessons whose scope fits.

    A lesson without an analysis type fits any, and any fits when none is
    asked for.  Candidates come along unless ``only_accepted``, marked by
    ``is_accepted``.  Lessons inform; they never filter records.
    """
    status = coerce_status(F.col("status"))
    scoped = F.element_at(F.col("scope"), F.lit("analysis_type"))
    live = lessons.withColumn("status", status).filter(~F.col("status").isin("retired", "rejected"))
    if only_accepted:
        live = live.filter(F.col("status") == "accepted")
    if analysis_type is not None:
        live = live.filter(scoped.isNull() | (scoped == analysis_type))
    return live.withColumn("is_accepted", F.col("status") == "accepted")
