"""Programmes of paths kept as a table: a path is read once, and not once per run.

Catalogues repeat their paths from load to load. The table has one row per different path, under the digest of its nodes.
A run adds the paths that are new to it, and everything else joins by digest. Rows belong to the rules that made them: other
rules have a folder of their own, so nothing outdated is ever joined.

A run only adds files, each with whole rows, so one that stops half-way leaves valid rows and the next run adds the rest. There is
one writer at a time; readers may come at any time.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from syllabary.plans import degrees as D
from syllabary.session import checkpointed

#: Raise this when `degrees.extract` reads paths in another way than before, with the same fixed values.
REVISION = 1
FIXED = (
    "TERM", "FACULTY_NUMBER", "MODULE_CODE", "UNIT_KINDS", "NODE_KINDS", "LEVEL", "INSTITUTE", "GENERIC", "NOISE", "DEGREES",
    "CASE_SENSITIVE_DEGREES", "CATEGORY", "SCHOOLS", "VERSION", "POINTS", "POINTS_PHRASE", "SCHOOL_PHRASE", "EDGE", "RESULT",
)


def rules() -> str:
    """A digest of what decides about a path."""
    values = [REVISION, *(getattr(D, name) for name in FIXED)]
    return hashlib.md5(repr(values).encode()).hexdigest()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The rows (path_id, programme) that the present rules have made so far."""
    try:
        return spark.read.schema(D.DICTIONARY_DDL).parquet(f"{folder}/rules={rules()}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], D.DICTIONARY_DDL)


def refreshed(module_paths: DataFrame, folder: str) -> DataFrame:
    """The table in ``folder`` after the paths of ``module_paths`` that it lacks were read and added."""
    spark = module_paths.sparkSession
    fresh = checkpointed(D.unread_paths(module_paths, read(spark, folder)))
    if not fresh.isEmpty():
        D.read_paths(fresh).write.mode("append").parquet(f"{folder}/rules={rules()}")
    return read(spark, folder)
