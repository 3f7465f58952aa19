"""Line deduplication over a suffix array of line ids.

Every document is a sequence of line ids.  Prefix doubling gives each suffix its rank by
its first 1, 2, 4, ... lines: the rank at depth h and the rank of the suffix h lines on
make the rank at depth 2h.  Suffixes of one rank at a depth are an interval of the suffix
array whose longest common prefix has at least this depth; the interval is named by its
first suffix in document order.  Suffixes alone in their interval leave the doubling, so
it works on repeated lines only, and it ends at the depth that the threshold needs.

A run of lines counts as repeated if it has ``min_words`` words and occurs before.  The
interval of a run of any length is known from two overlapping ranks, so the shortest
sufficient runs from and up to each line decide which lines are later copies; together
they cover every maximal repeated run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import NO_ID, col, map_arrow, materialize

MIN_WORDS = 5


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    rest = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(carry)]) if carry else F.lit(0)
    return docs.select(rest.alias("carry"), F.coalesce(col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(col(text_col)).alias("t"), col(text_col).alias("text"))


def _split(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        for a in range(0, len(batch["d"]), 256):
            texts = [(x or "").encode().split(b"\n") for x in batch["text"].slice(a, 256).to_pylist()]
            n = np.fromiter(map(len, texts), np.int64, len(texts))
            lines = [x for t in texts for x in t]
            hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.int64).reshape(-1, 2)
            yield {
                "d": np.repeat(batch["d"].slice(a, 256).to_numpy(), n),
                "t": np.repeat(batch["t"].slice(a, 256).to_numpy(), n),
                "i": np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n),
                "w": [len(x.split()) for x in lines],
                "h1": hashes[:, 0],
                "h2": hashes[:, 1],
            }


def _windows(min_words: int):
    """For every line the shortest sufficient runs from it and up to it, within
    neighbours that are all repeated lines; rows come sorted by (d, t, i)."""

    def of_run(d: int, t: int, i: list[int], w: list[int]) -> list[tuple[int, int, int, int]]:
        found, n = set(), len(i)
        sums = np.concatenate([[0], np.cumsum(w)])
        ends = np.searchsorted(sums, sums[:-1] + min_words)  # lines [k, ends[k]) suffice
        begins = np.searchsorted(sums, sums[1:] - min_words, "right") - 1  # as do [begins[k], k]
        for k in range(n):
            if ends[k] <= n:
                found.add((d, t, i[k], int(ends[k]) - k))
            if begins[k] >= 0:
                found.add((d, t, i[int(begins[k])], k + 1 - int(begins[k])))
        return list(found)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        key, i, w, out = None, [], [], []
        for batch in batches:
            for row in zip(*(batch[x].to_pylist() for x in ("d", "t", "i", "w")), strict=True):
                if i and key == row[:2] and row[2] == i[-1]:
                    continue  # the same document twice
                if i and (key != row[:2] or row[2] != i[-1] + 1):
                    out += of_run(*key, i, w)
                    i, w = [], []
                key = row[:2]
                i.append(row[2])
                w.append(row[3])
                if len(out) > 1 << 16:
                    yield dict(zip(("d", "t", "i", "n"), map(list, zip(*out, strict=True)), strict=True))
                    out = []
        if i:
            out += of_run(*key, i, w)
        if out:
            yield dict(zip(("d", "t", "i", "n"), map(list, zip(*out, strict=True)), strict=True))

    return run


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (d, t, i, n): runs of ``n`` lines from line ``i`` of document (d, t) that are
    later copies.  d is the id and t a hash of the text."""
    here = F.struct("d", "t", "i")
    lines = map_arrow(_keyed(docs, id_col, text_col).drop("carry"), _split, "d long, t long, i long, w long, h1 long, h2 long")
    lines = materialize(lines)
    # written first, as are the others below: a join of two tables is dealt anew for each,
    # and a line or run that many documents hold can be split
    firsts = materialize(lines.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min(here).alias("r")).where("c > 1").drop("c"))
    active = materialize(lines.join(firsts, ["h1", "h2"]).select("d", "t", "i", "w", "r"))
    order = active.repartition("d", "t").sortWithinPartitions("d", "t", "i").select("d", "t", "i", "w")
    runs = materialize(map_arrow(order, _windows(min_words), "d long, t long, i long, n long"))
    longest = runs.agg(F.max("n")).first()[0] or 0
    ranks, depth, found = active.select("d", "t", "i", "r").distinct(), 1, []
    while depth <= longest:
        own = runs.where((F.col("n") >= depth) & (F.col("n") < 2 * depth))
        if depth == 1:
            found.append(own.join(ranks, ["d", "t", "i"]).where(F.col("r") < here).select("d", "t", "i", "n"))
        else:
            tail = ranks.select("d", "t", F.col("i").alias("j"), F.col("r").alias("s"))
            named = materialize(own.join(ranks, ["d", "t", "i"]).withColumn("j", F.col("i") + F.col("n") - depth).join(tail, ["d", "t", "j"]).drop("j"))
            first = materialize(named.groupBy("n", "r", "s").agg(F.min(here).alias("first")))
            found.append(named.join(first, ["n", "r", "s"]).where(F.col("first") < here).select("d", "t", "i", "n"))
        if 2 * depth <= longest:  # the ranks at twice the depth
            later = ranks.select("d", "t", (F.col("i") - depth).alias("i"), F.col("r").alias("s"))
            pairs = materialize(ranks.join(later, ["d", "t", "i"]))
            first = materialize(pairs.groupBy("r", "s").agg(F.count("*").alias("c"), F.min(here).alias("q")).where("c > 1").drop("c"))
            ranks = materialize(pairs.join(first, ["r", "s"]).select("d", "t", "i", F.col("q").alias("r")))
        depth *= 2
    if not found:
        return runs.limit(0)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every


def _remove(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        for a in range(0, len(batch["d"]), 256):
            texts, runs = batch["text"].slice(a, 256).to_pylist(), batch["runs"].slice(a, 256).to_pylist()
            kept, removed, lines, spans = [], [], [], []
            for text, found in zip(texts, runs, strict=True):
                rows = (text or "").split("\n")
                gone = np.zeros(len(rows) + 1, np.int64)
                for r in found or ():
                    gone[r["i"] : r["i"] + r["n"]] = 1
                edges = np.flatnonzero(np.diff(gone, prepend=0))
                spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                removed.append(int(gone.sum()))
                lines.append(len(rows))
                kept.append("\n".join(r for r, g in zip(rows, gone.tolist(), strict=False) if not g) if removed[-1] else text)
            yield {"carry": batch["carry"].slice(a, 256), "d": batch["d"].slice(a, 256), "t": batch["t"].slice(a, 256), "text": pa.array(kept, pa.string()), "n_lines": lines, "n_removed": removed, "spans": spans}


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, carry: list[str] | None = None) -> DataFrame:
    """Rows (id, text, n_lines, n_removed, spans): texts without the lines of later copies.
    Columns named in ``carry`` come along in a struct.

    Documents are ordered by id, then by a hash of the text; of equal runs the first in
    this order stays.  Lines are what line feeds separate.  A null text has one empty
    line and stays null.  A null id sorts first.  Rows that repeat an id with the same
    text are one document and get the same result each.  Runs under ``min_words`` words
    stay wherever they occur.  An empty table gives no rows.
    """
    runs = repeated_lines(docs, id_col, text_col, min_words)
    held = runs.groupBy(F.col("d").alias("d2"), F.col("t").alias("t2")).agg(F.collect_list(F.struct("i", "n")).alias("runs"))
    keyed = _keyed(docs, id_col, text_col, carry)
    both = keyed.join(held, (keyed["d"] == held["d2"]) & (keyed["t"] == held["t2"]), "left").select("carry", "d", "t", "text", "runs")
    schema = StructType(both.select("carry").schema.fields + StructType.fromDDL("d long, t long, text string, n_lines long, n_removed long, spans array<struct<begin:long,end:long>>").fields)
    out = map_arrow(both, _remove, schema)
    return out.select("carry", F.when(F.col("d") != NO_ID, F.col("d")).alias("id"), "t", "text", "n_lines", "n_removed", "spans")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the lines of later copies taken out of the texts, all columns kept.

    A document goes if nothing but white space is left of it; one that had no more than
    that before stays.  A column that holds the text's length follows the text.
    """
    rest = [c for c in docs.columns if c != text_col]
    found = dedup(docs, id_col, text_col, min_words, carry=rest)
    gone = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"\S")
    back = []
    for c in docs.columns:
        old = F.col("text") if c == text_col else F.col(f"carry.c{rest.index(c)}")
        if c == length_col:
            old = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(old)
        back.append(old.alias(c))
    return found.where(~gone).select(*back)
