"""An extension: auditing pairs of pages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import PIXELS, Box
from ..operators.regions import inside_any
from ..plans.verify import changed, diff_columns

PAIR = T.StructType([*PIXELS.fields[:3], *(T.StructField(f"{c}{i}", T.IntegerType()) for i in (0, 1) for c in ("r", "g", "b"))])


def page_pairs(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of pixels with their colours before and after, from new Parquet files."""
    return spark.readStream.schema(PAIR).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def audit_stream(pairs: DataFrame, allowed: list[Box]) -> DataFrame:
    """Running metrics of each page (update or complete mode)."""
    return pairs.groupBy("page_id").agg(*diff_columns(), F.count_if(changed() & ~inside_any(allowed)).alias("outside"))
