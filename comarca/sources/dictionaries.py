"""Reading the small tables that describe the big ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from comarca.fixed_values import CATALOGUE_FIELDS, DOC_FIELDS


def read_dictionary(spark: SparkSession, path: str,
                    columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet dictionary, only the columns asked for."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_catalogue(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """The CSV catalogue of sheet indicators, of one table when given.

    Fields missing from an older file come out NULL: columns are matched by header.
    """
    df = _read_csv(spark, path, CATALOGUE_FIELDS)
    return df.filter(df.tabla == table) if table else df


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """The CSV of question documentation; rows without a numeric year are skipped."""
    df = _read_csv(spark, path, DOC_FIELDS)
    return (df.withColumn("anio", df.anio.try_cast("int"))
            .filter("anio IS NOT NULL").fillna(""))


def _read_csv(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    present = [f if f in df.columns else f"CAST(NULL AS STRING) AS {f}" for f in fields]
    return df.selectExpr(*present)
