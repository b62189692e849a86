"""CSV and Parquet scans with the missing-value rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import na_to_null


def nulls_for_na(df: DataFrame) -> DataFrame:
    """Every string cell that is exactly an NA token becomes null."""
    return df.select(*(na_to_null(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes))


def read_csv(spark: SparkSession, path: str, schema: StructType, na: bool = True) -> DataFrame:
    """CSV with header, doubled quotes and line feeds inside cells."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return nulls_for_na(df) if na else df


def read_metadata(spark: SparkSession, sf_dir: str, name: str = "enriched_metadata") -> DataFrame:
    return nulls_for_na(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
