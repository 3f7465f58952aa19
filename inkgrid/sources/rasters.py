"""Rasters from tables and files, verification cases, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CASE_DEFAULTS, PIXELS, VERIFY_CASE

#: Characters of a row of a character raster; factors of the inks; characters that are paper.
COLUMNS, INKS, BLANKS, PAPER = 80, (37, 53, 71), (10, 32), 245


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """A pixel table; partition it by ``page_id`` and sort it by y, x when writing, and
    reads of a box skip row groups."""
    return spark.read.schema(PIXELS).parquet(path)


def character_raster(documents: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """A pixel for each character of a text, rows of ``columns``; blanks are paper and
    ``code`` keeps the character."""
    cells = documents.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "")).alias("i", "c")).where("c <> ''")
    cells = cells.select("page_id", F.expr(f"cast(i div {columns} as int)").alias("y"), F.expr(f"cast(i % {columns} as int)").alias("x"), F.ascii("c").alias("code"))
    ink = lambda k: F.when(F.col("code").isin(*BLANKS), PAPER).otherwise(40 + (F.col("code") * k) % 160).cast("int")
    return cells.select("page_id", "y", "x", *[ink(k).alias(c) for c, k in zip(("r", "g", "b"), INKS, strict=True)], "code")


def edited_raster(raster: DataFrame) -> DataFrame:
    """The same with digits painted white: what an edit would have changed."""
    return raster.select("page_id", "y", "x", *[v.alias(c) for c, v in edited_colours().items()])


def edited_colours() -> dict[str, Column]:
    """The edit's colours, as expressions over the raster."""
    digit = F.col("code").between(48, 57)
    return {c: F.when(digit, 255).otherwise(F.col(c)).cast("int") for c in ("r", "g", "b")}


def vector_raster(embeddings: DataFrame) -> DataFrame:
    """One page with a row for each vector and a gray for each component."""
    cells = embeddings.select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    gray = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("v").cast("double") + 1) * 127.5)))
    return cells.select(F.lit(0).cast("long").alias("page_id"), "y", "x", gray.cast("int").alias("gray"))


def verify_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from a JSON array of objects; fields that are left out get their defaults."""
    read = spark.read.schema(VERIFY_CASE).option("multiLine", True).json(path)
    return read.withColumns({c: F.coalesce(c, F.lit(v).cast(VERIFY_CASE[c].dataType)) for c, v in CASE_DEFAULTS.items()})


def content_hashes(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """SHA-256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def matching_files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Files below a path with one of the names, whatever their case."""
    wanted = [n.lower() for n in names]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.withColumn("file", F.element_at(F.split("path", "/"), -1)).where(F.lower("file").isin(wanted))


def decoded_images(spark: SparkSession, path: str, decoder) -> DataFrame:
    """Pixels of image files; ``decoder(bytes)`` gives a height x width x 3 array.  Codecs
    are left to the caller, since none is bundled."""
    import pandas as pd

    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("page_id"), "content")

    def run(batches):
        for pdf in batches:
            for page, content in zip(pdf["page_id"], pdf["content"], strict=True):
                image = decoder(content)
                for y, row in enumerate(image):
                    yield pd.DataFrame({"page_id": page, "y": y, "x": range(len(row)), "r": row[:, 0], "g": row[:, 1], "b": row[:, 2]})

    return files.mapInPandas(run, PIXELS)


def save(pixels_: DataFrame, path: str, preview: DataFrame | None = None) -> None:
    """A raster by page, and a crop of it beside."""
    pixels_.repartition("page_id").sortWithinPartitions("page_id", "y", "x").write.mode("overwrite").parquet(path)
    if preview is not None:
        preview.write.mode("overwrite").parquet(f"{path}_crop")
