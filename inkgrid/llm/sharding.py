"""Sharding by sampled splitters.

Records are ordered by (hash of the text, id).  A size-weighted priority sample of the
keys gives quantile boundaries of many ranges, about as many as the records need; the
exact bytes of each range are then counted, overfull ranges get boundaries of their own
from another sample, and keys are range-partitioned.  Inside a range running sums over
the keys alone, each with its size and how many rows have it, place every record at its
exact byte in the whole order, so that shards differ by about one record.  Texts are
never sorted; they get their places by a join.

Equal texts are neighbours in this order.  A hot text is cut by the id, so no group of
copies has to fit into one range; rows that repeat a text with its id count as one key.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, materialize

#: Bytes that a record takes besides its text.
OVERHEAD = 16
#: Keys of a range that are aimed at.
RANGE_KEYS = 1 << 18
_KEYS = ["__ink_k", "__ink_u", "__ink_i"]


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 32, samples_per_range: int = 12, seed: int = 7) -> DataFrame:
    """``docs`` with columns ``shard_size``, ``shard``, ``shard_slot`` (law: near equal bytes).

    All columns of ``docs`` are kept; if one of them has such a name, the new one
    replaces it.  A null text counts as no bytes, a null id sorts first, repeated rows
    get slots of their own, and an empty table gives no rows; texts of any length are
    measured whole.  The driver holds about ``ranges * samples_per_range`` sampled keys, of
    ``ranges`` the more of ``n_shards * ranges_per_shard`` and one for ``RANGE_KEYS`` rows.
    """
    text = col(text_col)
    keys = {"__ink_k": F.xxhash64(text), "__ink_u": F.xxhash64(F.lit(1), text), "__ink_i": F.coalesce(col(id_col).cast("long"), F.lit(-(2**63))), "__ink_size": text_bytes(text) + OVERHEAD}
    slim = docs.select(*[e.alias(n) for n, e in keys.items()])
    slim = materialize(slim.groupBy(*_KEYS).agg(F.count("*").alias("__ink_m"), F.max("__ink_size").alias("__ink_one")).withColumn("__ink_size", F.col("__ink_m") * F.col("__ink_one")))
    totals = slim.agg(F.sum("__ink_size").alias("s"), F.count("*").alias("n")).first()
    total = totals["s"] or 0
    n_ranges = max(n_shards * ranges_per_shard, -(-totals["n"] // RANGE_KEYS))
    cuts = _quantiles(_sample(slim, total, n_ranges * samples_per_range, seed), n_ranges)
    target = max(1, total // n_ranges)
    for turn in range(1, 4):
        sizes = _sizes(slim, cuts)
        over = {r: s for r, (s, _, n) in sizes.items() if s > 2 * target and n > 1}
        if not over:
            break
        inside = slim.where(_range_of(cuts)("__ink_k", "__ink_i").isin(list(over)))
        found = _sample(inside, sum(over.values()), n_ranges * samples_per_range, seed + turn)
        share: dict[int, list] = {}
        for row in found:
            share.setdefault(bisect_right(cuts, row[:2]), []).append(row)
        cuts = sorted({*cuts, *(x for r, rows in share.items() for x in _quantiles(rows, -(-over[r] // target) * 2))})
    else:
        sizes = _sizes(slim, cuts)
    starts, at, n = [], 0, 0
    for r in range(len(cuts) + 1):
        starts.append((r, at, n))
        at, n = at + sizes.get(r, (0, 0, 0))[0], n + sizes.get(r, (0, 0, 0))[1]
    spark = docs.sparkSession
    before = F.broadcast(spark.createDataFrame(starts, "__ink_r int, __ink_at long, __ink_n long"))  # a row for each range
    w = Window.partitionBy("__ink_r").orderBy(*_KEYS).rowsBetween(Window.unboundedPreceding, 0)
    placed = slim.withColumn("__ink_r", _range_of(cuts)("__ink_k", "__ink_i"))
    placed = placed.withColumns({"__ink_sum": F.sum("__ink_size").over(w) - F.col("__ink_size"), "__ink_row": F.sum("__ink_m").over(w) - F.col("__ink_m")}).join(before, "__ink_r")
    placed = materialize(placed.select(*_KEYS, "__ink_m", "__ink_one", (F.col("__ink_sum") + F.col("__ink_at")).alias("__ink_at"), (F.col("__ink_row") + F.col("__ink_n")).alias("__ink_row")))
    number = lambda at: F.least(F.lit(n_shards - 1), F.floor(at.cast("decimal(38,0)") * n_shards / F.lit(max(1, total)))).cast("int")
    # the first row of each shard: of a key with many rows a later one may be it
    edges = F.sequence(number(F.col("__ink_at")), number(F.col("__ink_at") + (F.col("__ink_m") - 1) * F.col("__ink_one")))
    edge = placed.select("*", F.explode(edges).alias("s"))
    skip = F.ceil((F.ceil(F.col("s").cast("decimal(38,0)") * F.lit(max(1, total)) / n_shards) - F.col("__ink_at")) / F.col("__ink_one"))
    first = {r["s"]: r["n"] for r in edge.groupBy("s").agg(F.min(F.col("__ink_row") + F.greatest(F.lit(0), skip)).cast("long").alias("n")).collect()}
    firsts, last = [], n
    for s in reversed(range(n_shards)):
        last = min(last, first.get(s, last))
        firsts.append(last)
    firsts.reverse()
    # rows that share a key take its places in turn
    rows = docs.withColumns({k: keys[k] for k in _KEYS}).join(placed, _KEYS)
    turn = F.row_number().over(Window.partitionBy(*_KEYS).orderBy("__ink_row")) - 1
    out = rows.withColumn("__ink_turn", turn).withColumn("__ink_shard", number(F.col("__ink_at") + F.col("__ink_turn") * F.col("__ink_one")))
    new = {"shard_size", "shard", "shard_slot"}
    return out.select(*[col(c) for c in docs.columns if c not in new], F.col("__ink_one").alias("shard_size"), F.col("__ink_shard").alias("shard"), (F.col("__ink_row") + F.col("__ink_turn") - _item(firsts, "__ink_shard")).alias("shard_slot"))


def _sample(slim: DataFrame, total: int, m: int, seed: int) -> list[tuple[int, int, float]]:
    """Keys with the bytes that they stand for: those whose priority, size / uniform,
    reaches the ``m``-th part of all bytes; about ``m`` of them, whatever the table's size."""
    u = (F.xxhash64(F.lit(seed), "__ink_i", "__ink_k").bitwiseAND(F.lit((1 << 52) - 1)) + 1) / float(1 << 52)
    least = total / m
    got = slim.where(F.col("__ink_size") / u >= least).collect()
    return sorted((r["__ink_k"], r["__ink_i"], max(float(r["__ink_size"]), least)) for r in got)


def _quantiles(rows: list[tuple[int, int, float]], n: int) -> list[tuple[int, int]]:
    """``n`` - 1 boundaries at equal weight; a key belongs to the range that begins with it."""
    if not rows:
        return []
    sums = np.cumsum([r[2] for r in rows])
    at = np.searchsorted(sums, sums[-1] * np.arange(1, n) / n)
    return sorted({rows[min(int(i), len(rows) - 1)][:2] for i in at})


def _range_of(cuts: list[tuple[int, int]]):
    ks = np.array([k for k, _ in cuts], np.int64)

    @F.pandas_udf("int")
    def number(k: pd.Series, i: pd.Series) -> pd.Series:
        k, i = k.to_numpy(), i.to_numpy()
        low, high = np.searchsorted(ks, k, "left"), np.searchsorted(ks, k, "right")
        for x in np.flatnonzero(low != high):  # a boundary inside one text's copies
            high[x] = bisect_right(cuts, (k[x], i[x]))
        return pd.Series(high.astype(np.int32))

    return number


def _sizes(slim: DataFrame, cuts: list) -> dict[int, tuple[int, int, int]]:
    """Bytes, rows and keys of each range."""
    rows = slim.groupBy(_range_of(cuts)("__ink_k", "__ink_i").alias("r")).agg(F.sum("__ink_size").alias("s"), F.sum("__ink_m").alias("n"), F.count("*").alias("k")).collect()
    return {r["r"]: (r["s"], r["n"], r["k"]) for r in rows}


def _item(xs: list[int], number: str) -> Column:
    """The element of a short list of numbers at a column's value."""
    return F.element_at(F.expr(f"array({', '.join(f'{int(x)}L' for x in xs)})"), F.col(number) + 1)


__all__ = ["shard", "text_bytes"]
