"""Helpers that the corpus operators share: shared storage, batching, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..sources.shared import FREED, materialize, shared_dir  # noqa: F401

#: Bytes of text that a Python worker expands at a time.
SLICE_BYTES = 2 << 20
#: Takes the place of a null id.
NO_ID = -(2**63)
#: Different texts with one 64-bit hash, of which the driver may hear; two are expected
#: among six billion texts.
MOST_CLASHES = 100_000


def col(name: str) -> Column:
    """A column by its whole name, even if the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, text, t) of ``docs``, and rows (t, id, n) of its different texts with the
    smallest id and the number of rows that hold them.

    A null text is empty, a null id is ``NO_ID``.  t is a hash of the text; texts that
    share one, as a second hash tells, get others, so t names one text.
    """
    texts = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    two = {"t": F.xxhash64("text"), "u": F.xxhash64(F.lit(1), "text")}
    held = materialize(texts.withColumns(two).groupBy("t", "u").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    clashes = [r["t"] for r in held.groupBy("t").count().where("count > 1").limit(MOST_CLASHES + 1).collect()]
    if len(clashes) > MOST_CLASHES:
        raise RuntimeError("too many texts share a hash")
    own = F.col("t")
    if clashes:
        own = F.when(F.col("t").isin(clashes), F.xxhash64("t", "u", F.lit(2))).otherwise(F.col("t"))
    return texts.withColumns(two).select("id", "text", own.alias("t")), held.select(own.alias("t"), "id", "n")


def announced(v: np.ndarray, t: np.ndarray, p: np.ndarray, across: bool) -> dict:
    """Rows (key, v, t, p) of a chunk of places p where a text t has the value v.

    A value repeats if two places have it (``across``: places of two texts).  Rows of
    values that repeat within the chunk are sure of it and get keys of their own, and one
    row without t tells others; so a hot value sends a row or two for each chunk to where
    it is looked up.  The others have their value as key, and no v.
    """
    order = np.lexsort((p, t, v))
    v, t, p = v[order], t[order], p[order]
    if len(v):
        once = np.concatenate([[True], (v[1:] != v[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1])])
        v, t, p = v[once], t[once], p[once]
    cuts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, np.int64)
    sizes = np.diff(cuts, append=len(v))
    sure = (np.minimum.reduceat(t, cuts) != np.maximum.reduceat(t, cuts)) if across and len(v) else sizes > 1
    known, marks = np.repeat(sure, sizes), v[cuts][sure]
    with np.errstate(over="ignore"):
        own = (v ^ (t * np.int64(0x5851F42D4C957F2D)) ^ (p * np.int64(0x2545F4914F6CDD1D))) * np.int64(0x369DEA0F31A53F85)
    none, no_v = np.zeros(len(marks), np.int64), np.concatenate([~known, np.ones(len(marks), bool)])
    return {
        "key": np.concatenate([np.where(known, own, v), marks]),
        "v": pa.array(np.concatenate([v, none]), mask=no_v),
        "t": pa.array(np.concatenate([t, none]), mask=np.concatenate([np.zeros(len(v), bool), np.ones(len(marks), bool)])),
        "p": np.concatenate([p, none]),
    }


def repeated(found: DataFrame, across: bool) -> DataFrame:
    """Rows (v, t, p) whose value repeats, from what ``announced`` has told."""
    w = Window.partitionBy("key")
    differ = lambda c: F.min(c).over(w) != F.max(c).over(w)
    again = differ("t") if across else differ("t") | differ("p")
    seen = found.withColumn("again", F.col("v").isNotNull() | F.coalesce(again, F.lit(False)) | (F.count_if(F.col("t").isNull()).over(w) > 0))
    return seen.where("again and t is not null").select(F.coalesce("v", "key").alias("v"), "t", "p")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters each, one text at least."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def map_arrow(df: DataFrame, f: Callable[[Iterator[dict]], Iterator[dict]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` for functions that take and give dicts of columns.

    Incoming columns are pyarrow arrays; outgoing ones may be arrays or lists.
    """
    out = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (dict(zip(b.schema.names, b.columns, strict=True)) for b in batches)
        for made in f(named):
            yield pa.RecordBatch.from_arrays([made[x.name] if isinstance(made[x.name], pa.Array) else pa.array(made[x.name], x.type) for x in out], schema=out)

    return df.mapInArrow(run, schema)


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest (node, smallest node) with the components of the edges given."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _contract(batches: Iterator[dict]) -> Iterator[dict]:
    """Stars in place of whatever edges a batch and what came before it hold."""
    a = b = np.empty(0, np.int64)
    for batch in batches:
        a, b = local_forest(np.concatenate([a, batch["a"].to_numpy()]), np.concatenate([b, batch["b"].to_numpy()]))
    if len(a):
        yield {"a": a, "b": b}


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows (node, root), root the
    smallest node reachable.  Roots have no row of their own.

    Every partition first replaces its edges by stars, then large-star and small-star
    rounds run until the edges stay the same; each round is written to the shared folder.
    """
    spark = edges.sparkSession
    now = materialize(map_arrow(edges.select("a", "b"), _contract, "a long, b long"))
    seen = None
    for _ in range(limit):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s")).first()
        if state == seen or not state["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the minima are written first: a join of two tables is dealt anew for each, and a
        # node with many neighbours can be split
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = materialize(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = materialize(small)
    raise RuntimeError(f"components did not settle in {limit} rounds")
