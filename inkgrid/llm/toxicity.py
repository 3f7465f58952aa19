"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has a letter model over words: a word is spelled along its
prefixes, and the probability of a prefix given the one before is the class's discounted
count plus the mass set free times a shared backoff, which counts both classes together:

    P_c(x | p) = (max(n_c(x) - D, 0) + k_c(p) * n(x) / n(p)) / n_c(p)
    k_c(p) = sum of min(n_c(y), D) over the continuations y of p

Counts are continuation counts: not how often a word occurs, but in how many contexts,
which are documents here, however often it is repeated in one.  Rare expressions have no
count left after discounting, so both classes give them a share of the same probability:
all rare or unknown continuations of p speak alike, by what discounting sets free there,
and below a rare prefix nothing speaks for either class.

The score compares the length-normalised log-likelihoods of both classes over the whole
text and over its most toxic stretches of words.  A logistic function maps these to 0..1.

Counts come from all labelled rows that may be learnt from.  The logistic function is
fitted on rows scored by counts that leave out their own fold.  Counts are exact and grow
with the corpus.  Of the tree of prefixes the texts need but the part whose counts exceed
the discount: for each such prefix the log-likelihood ratio of the step to it, and that of
any rare step from it.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, map_arrow, materialize, slices

#: Letters (bytes) of a word that are spelled one by one; the rest is one step.
DEPTH = 12
DISCOUNT = 2.0
#: Words of the stretches that are compared besides the whole text.
STRETCHES = (3, 10, 30)
#: Labelled rows that the logistic function is fitted on, if there are more; rows beyond
#: twice this number, as repeated ids can bring them, are left out in the order of a hash.
FIT_ROWS = 20_000
#: Most labels that are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Most prefixes with their ratios that are broadcast; most that go to the executors as a
#: file (40 bytes each) that workers map into memory; more are joined by a shuffle.
BROADCAST_NODES = 200_000
MAPPED_NODES = 64_000_000
#: Prefixes that the driver holds at a time while it writes that file.
PIECE = 250_000
COUNTS_HELD = 200_000
#: Folds that may be learnt from, of the remainders of a row's crc32 by four.
FOLDS = (0, 1, 3)
#: Counts of a word: of ordinary and toxic documents by fold.
COUNTS = [f"n{c}_{f}" for f in FOLDS for c in (0, 1)]
#: Folds that are counted: all, and all without each one.
USES = [FOLDS, *(tuple(g for g in FOLDS if g != f) for f in FOLDS)]
#: Ratios of the step to a prefix and of rare steps from it, by ``USES``; those of a word.
STEPS, RARE = [f"r{i}" for i in range(len(USES))], [f"b{i}" for i in range(len(USES))]
RATIOS = STEPS

_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def spell(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the prefixes of each word, from the empty one on, the last one standing
    for the whole word; a matrix, and how many of each row count."""
    raw = [w.encode() for w in found]
    size = np.minimum(np.fromiter(map(len, raw), np.int64, len(raw)), DEPTH)
    flat = np.frombuffer(b"".join(w[:DEPTH].ljust(DEPTH, b"\0") for w in raw), np.uint8).reshape(len(raw), DEPTH).astype(np.uint64)
    ends = np.fromiter((xxhash.xxh64_intdigest(w[DEPTH:]) if len(w) > DEPTH else 0 for w in raw), np.uint64, len(raw))
    out = np.zeros((len(raw), DEPTH + 2), np.uint64)
    for k in range(DEPTH):
        out[:, k + 1] = _mix((out[:, k] + flat[:, k] + np.uint64(1)) * _STEP)
    rows = np.arange(len(raw))
    out[rows, size + 1] = _mix((out[rows, size] + ends + np.uint64(300)) * _STEP)
    return out, size + 2


def _mix(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(29))


def _count(batches: Iterator[dict]) -> Iterator[dict]:
    """In how many documents of each class and fold each word occurs."""
    held: defaultdict = defaultdict(lambda: [0] * len(COUNTS))

    def rows() -> dict:
        counts = np.array(list(held.values()), np.int32).reshape(-1, len(COUNTS))
        return {"word": list(held)} | {c: counts[:, k] for k, c in enumerate(COUNTS)}

    for batch in batches:
        for text, toxic, fold in zip(batch["text"], batch["toxic"].to_pylist(), batch["fold"].to_pylist(), strict=True):
            k = 2 * FOLDS.index(fold) + toxic
            for w in set(words(text.as_py())):
                held[w][k] += 1
            if len(held) > COUNTS_HELD:
                yield rows()
                held.clear()
    yield rows()


def _expand(batches: Iterator[dict]) -> Iterator[dict]:
    """Counts of prefixes x, each with the one before (p), from counts of words."""
    for batch in batches:
        for a in range(0, len(batch["word"]), 20_000):
            found, n = spell(batch["word"].slice(a, 20_000).to_pylist())
            on = np.arange(1, DEPTH + 2) < n[:, None]
            pairs = np.stack([found[:, 1:][on], found[:, :-1][on]], 1)
            keys, at = np.unique(pairs, axis=0, return_inverse=True)
            out = {"x": keys[:, 0].copy().view(np.int64), "p": keys[:, 1].copy().view(np.int64)}
            for c in COUNTS:
                weights = np.broadcast_to(batch[c].slice(a, 20_000).to_numpy()[:, None], on.shape)[on]
                out[c] = np.bincount(at.ravel(), weights, len(keys)).astype(np.int32)
            yield out


def _log_ratio(n: list[np.ndarray], k: list[np.ndarray], total: list[np.ndarray]) -> np.ndarray:
    """Log of P_1 / P_0; a class that does not know p takes the shared probability.  n is
    what is left of the counts, over the shared probability."""
    p = [np.where(total[c] > 0, (n[c] + k[c]) / np.maximum(total[c], 1), 1.0) for c in (0, 1)]
    return np.log(p[1] / p[0])


def node_ratios(p: np.ndarray, x: np.ndarray, counts: np.ndarray) -> dict:
    """Rows (node, r, b) from counts of steps, sorted by (p, x): r of prefixes whose count in
    a class exceeds the discount, and b of the prefixes that those follow."""
    starts = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (x[1:] != x[:-1])]))
    counts, p, x = np.add.reduceat(counts.astype(np.int64), starts), p[starts], x[starts]
    cuts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    sizes = np.diff(cuts, append=len(p))
    of_class = lambda use: [sum(counts[:, 2 * FOLDS.index(f) + c] for f in use).astype(np.float64) for c in (0, 1)]
    often = np.maximum(*of_class(FOLDS)) > DISCOUNT
    above = np.logical_or.reduceat(often, cuts)
    made = {"node": np.concatenate([x[often], p[cuts][above]])}
    for i, use in enumerate(USES):
        n = of_class(use)
        k = [np.add.reduceat(np.minimum(v, DISCOUNT), cuts) for v in n]
        total = [np.add.reduceat(v, cuts) for v in n]
        each = lambda v: [np.repeat(u, sizes) for u in v]
        both = n[0] + n[1]
        shared = both / np.maximum(np.repeat(total[0] + total[1], sizes), 1)
        left = [np.where(both > 0, np.maximum(v - DISCOUNT, 0) / np.where(both > 0, shared, 1), 0) for v in n]
        none = [np.zeros(len(cuts))] * 2
        made[STEPS[i]] = np.concatenate([_log_ratio(left, each(k), each(total))[often], np.zeros(int(above.sum()))])
        made[RARE[i]] = np.concatenate([np.zeros(int(often.sum())), _log_ratio(none, k, total)[above]])
    return made


def _nodes(batches: Iterator[dict]) -> Iterator[dict]:
    """``node_ratios`` of rows that come sorted by (p, x)."""
    names = ["p", "x", *COUNTS]
    held = {n: np.empty(0, np.int64) for n in names}
    for batch in batches:
        held = {n: np.concatenate([held[n], batch[n].to_numpy()]) for n in names}
        last = int(np.searchsorted(held["p"], held["p"][-1])) if len(held["p"]) else 0  # its steps may go on
        if last > 1 << 16:
            yield node_ratios(held["p"][:last], held["x"][:last], np.stack([held[c][:last] for c in COUNTS], 1))
            held = {n: v[last:].copy() for n, v in held.items()}
    if len(held["p"]):
        yield node_ratios(held["p"], held["x"], np.stack([held[c] for c in COUNTS], 1))


def nodes(rows: DataFrame) -> DataFrame:
    """Rows (node, r, b) of the prefixes that speak, by hashes of their paths, from labelled
    ``rows(text, toxic, fold)``."""
    counts = ", ".join(f"{c} int" for c in COUNTS)
    # words that begin alike come together, so their prefixes are summed before the shuffle
    counted = map_arrow(rows.select("text", "toxic", "fold"), _count, f"word string, {counts}")
    counted = counted.repartition(F.substring("word", 1, 4)).sortWithinPartitions("word")
    steps = map_arrow(counted, _expand, f"x long, p long, {counts}").repartition("p").sortWithinPartitions("p", "x")
    told = map_arrow(steps, _nodes, ", ".join(["node long", *(f"{r} double" for r in STEPS + RARE)]))
    return materialize(told.groupBy("node").agg(*[F.sum(r).cast("float").alias(r) for r in STEPS + RARE]))


def word_hashes(found: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in found), np.uint64, len(found)).view(np.int64)


def _steps(batches: Iterator[dict]) -> Iterator[dict]:
    """The steps of each word, by its hash."""
    seen: set[str] = set()

    def rows() -> dict:
        part = list(seen)
        found, n = spell(part)
        on = np.arange(1, DEPTH + 2) < n[:, None]
        return {"w": np.repeat(word_hashes(part), n - 1), "x": found[:, 1:][on].view(np.int64), "p": found[:, :-1][on].view(np.int64)}

    for batch in batches:
        for text in batch["text"]:
            seen.update(words(text.as_py()))
            if len(seen) > 20_000:
                yield rows()
                seen.clear()
    if seen:
        yield rows()


def word_ratios(docs: DataFrame, held: DataFrame, text_col: str) -> DataFrame:
    """Rows (w, r, ...): the hash of each word of ``docs`` and its log-likelihood ratios, by
    joins of its steps with the prefixes that speak."""
    steps = map_arrow(docs.select(col(text_col).alias("text")), _steps, "w long, x long, p long").distinct()
    to = held.select(F.col("node").alias("x"), *STEPS)
    at = held.select(F.col("node").alias("p"), *RARE)
    told = materialize(steps.join(to, "x", "left")).join(at, "p", "left")
    return materialize(told.groupBy("w").agg(*[F.sum(F.coalesce(r, b, F.lit(0.0))).cast("float").alias(r) for r, b in zip(STEPS, RARE, strict=True)]))


class Model:
    """The prefixes that speak, sorted by their hashes, with r and b."""

    def __init__(self, node: np.ndarray, r: np.ndarray, b: np.ndarray):
        order = np.argsort(node)
        self.node, self.r, self.b = node[order], r[order].astype(np.float64), b[order].astype(np.float64)

    def loaded(self) -> Model:
        return self

    def ratio(self, found: list[str]) -> np.ndarray:
        """Log-likelihood of each word as toxic less that as ordinary."""
        out = np.zeros(len(found))
        if not found or not len(self.node):
            return out
        x, size = spell(found)
        x = x.view(np.int64)
        root = int(np.searchsorted(self.node, 0))
        on = np.arange(len(found)) if root < len(self.node) and self.node[root] == 0 else np.empty(0, np.int64)
        above = np.full(len(on), root)
        for k in range(1, DEPTH + 2):  # down the tree, with the words that are still in it
            inside = k < size[on]
            on, above = on[inside], above[inside]
            if not len(on):
                break
            at = np.minimum(np.searchsorted(self.node, x[on, k]), len(self.node) - 1)
            hit = self.node[at] == x[on, k]
            out[on] += np.where(hit, self.r[at], self.b[above])
            on, above = on[hit], at[hit]
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        number: defaultdict = defaultdict(count().__next__)
        rows = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in map(words, texts)]
        return features(rows, self.ratio(list(number)))


class MappedModel:
    """A model in a file that Spark has brought to every executor: the sorted hashes, then
    r and b of each use.  A worker maps it once."""

    _held: dict[tuple[str, int], Model] = {}

    def __init__(self, name: str, n: int, which: int):
        self.name, self.n, self.which = name, n, which

    def loaded(self) -> Model:
        key = (self.name, self.which)
        if key not in self._held:
            if any(name != self.name for name, _ in self._held):
                self._held.clear()
            flat = np.memmap(SparkFiles.get(self.name), np.uint8, "r").view(np.ndarray)
            column = lambda k: flat[8 * self.n + 4 * self.n * k :][: 4 * self.n].view(np.float32)
            self._held[key] = model = Model.__new__(Model)
            model.node, model.r, model.b = flat[: 8 * self.n].view(np.int64), column(2 * self.which), column(2 * self.which + 1)
        return self._held[key]


def mapped(held: DataFrame, n: int) -> list[MappedModel]:
    """The models of all uses, from one file that is written range by range of the hashes."""
    spark = held.sparkSession
    folder = tempfile.mkdtemp(prefix="inkgrid-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"inkgrid-{uuid.uuid4().hex}.model"
    path = os.path.join(folder, name)
    file = np.memmap(path, np.uint8, "w+", shape=(8 + 8 * len(USES)) * n)
    pieces = -(-n // PIECE)
    edges = [-(2**63) + (2**64 * k) // pieces for k in range(1, pieces)]
    ranged = materialize(held.repartitionByRange(pieces, "node").sortWithinPartitions("node"))
    begin = 0
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = ranged if low is None else ranged.where(F.col("node") >= low)
        part = part if high is None else part.where(F.col("node") < high)
        found = part.toArrow()
        order = np.argsort(found["node"].to_numpy())
        end = begin + len(order)
        file[: 8 * n].view(np.int64)[begin:end] = found["node"].to_numpy()[order]
        for k, c in enumerate(c for both in zip(STEPS, RARE, strict=True) for c in both):
            file[8 * n + 4 * n * k :][: 4 * n].view(np.float32)[begin:end] = found[c].to_numpy()[order]
        begin = end
    file.flush()
    del file
    spark.sparkContext.addFile(path)
    return [MappedModel(name, n, k) for k in range(len(USES))]


def features(rows: list[np.ndarray], ratio: np.ndarray) -> np.ndarray:
    """For each text, given as its words' numbers: mean ratio, best stretches' means, and
    the log of its length."""
    out = np.zeros((len(rows), len(STRETCHES) + 2))
    for row, at in zip(out, rows, strict=True):
        if len(at):
            sums = np.concatenate([[0], np.cumsum(ratio[at])])
            row[0] = sums[-1] / len(at)
            for i, n in enumerate(STRETCHES):
                row[i + 1] = (sums[n:] - sums[:-n]).max() / n if len(at) > n else row[0]
            row[-1] = np.log(1 + len(at))
    return out


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Rows (i, text, toxic, fold) of all documents; toxic is null where there is nothing to
    learn, for want of a label or because the row's remainder is 2."""
    fold = F.crc32(col(id_col).cast("string")) % 4
    rows = docs.select(col(id_col).cast("long").alias("i"), col(text_col).alias("text"), fold.alias("fold"))
    marks = labels.select(col(id_col).cast("long").alias("j"), col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1) and j is not null")
    marks = materialize(marks.groupBy("j").agg(F.max("toxic").alias("toxic")))
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    return rows.join(marks, (F.col("i") == F.col("j")) & (F.col("fold") != 2), "left").select("i", "text", "toxic", "fold")


def _texts_features(rows: DataFrame, ratios: DataFrame | Model | MappedModel, which: int) -> DataFrame:
    """Rows (i, toxic, t, x): features of texts by a shared model, or by words' ratios."""
    if isinstance(ratios, (Model, MappedModel)):
        shared = rows.sparkSession.sparkContext.broadcast(ratios)

        def run(batches: Iterator[dict]) -> Iterator[dict]:
            for batch in batches:
                for a in range(0, len(batch["i"]), 512):
                    texts = batch["text"].slice(a, 512).to_pylist()
                    for i, j in slices(texts):
                        yield {c: batch[c].slice(a + i, j - i) for c in ("i", "toxic", "t")} | {"x": shared.value.loaded().features(texts[i:j]).tolist()}

        return map_arrow(rows.select("i", "toxic", "t", "text"), run, "i long, toxic int, t long, x array<double>")

    def split(batches: Iterator[dict]) -> Iterator[dict]:
        """Words of each text with their places; a row without w holds the text's length."""
        for batch in batches:
            for t, text in zip(batch["t"].to_pylist(), batch["text"], strict=True):
                found = words(text.as_py())
                places: defaultdict = defaultdict(list)
                for k, w in enumerate(found):
                    places[w].append(k)
                hashes = [*word_hashes(list(places)).tolist(), None]
                yield {"t": [t] * len(hashes), "w": hashes, "places": [*places.values(), [len(found)]]}

    def join(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            x = []
            for found in batch["found"].to_pylist():
                ratio = np.zeros(max((f["places"][0] for f in found if f["r"] is None), default=0))
                for f in found:
                    if f["r"] is not None:
                        ratio[f["places"]] = f["r"]
                x.append(features([np.arange(len(ratio))], ratio)[0].tolist())
            yield {"t": batch["t"], "x": x}

    texts = rows.groupBy("t").agg(F.first("text").alias("text"))
    found = map_arrow(texts, split, "t long, w long, places array<int>")
    told = found.join(ratios.select("w", F.col(RATIOS[which]).alias("r")), "w").select("t", "places", "r")
    told = told.unionByName(found.where("w is null").select("t", "places", F.lit(None).cast("float").alias("r")))
    whole = map_arrow(told.groupBy("t").agg(F.collect_list(F.struct("places", "r")).alias("found")), join, "t long, x array<double>")
    return rows.select("i", "toxic", "t").join(materialize(whole), "t").select("i", "toxic", "t", "x")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", broadcast_nodes: int = BROADCAST_NODES, mapped_nodes: int = MAPPED_NODES) -> tuple[DataFrame | Model | MappedModel, np.ndarray]:
    """A model, or the ratios of all words if that is too large to be shared, and the
    weights of the logistic function."""
    rows = labelled(docs, labels, id_col, text_col, label_col).where("toxic is not null")
    held = nodes(rows)
    n = held.count()
    if n <= broadcast_nodes:
        table = held.toArrow()
        models = [Model(table["node"].to_numpy(), table[r].to_numpy(), table[b].to_numpy()) for r, b in zip(STEPS, RARE, strict=True)]
    elif n <= mapped_nodes:
        models = mapped(held, n)
    else:
        models = [word_ratios(docs, held, text_col)] * len(USES)
    rows = rows.withColumn("t", F.xxhash64("text"))
    # about as many rows as are wanted, drawn by a hash of the id before they are scored
    known = labels.where(F.crc32(col(id_col).cast("string")) % 4 != 2).count()
    share = int(min(1.0, FIT_ROWS / max(1, known)) * (1 << 30))
    drawn = rows.where(F.xxhash64("i").bitwiseAND(F.lit((1 << 30) - 1)) < share)
    x, y = [np.empty((0, len(STRETCHES) + 2))], [np.empty(0)]
    for which, fold in enumerate(FOLDS, 1):
        seen = _texts_features(drawn.where(F.col("fold") == fold), models[which], which)
        seen = seen.orderBy(F.xxhash64("i"), "i", "t").limit(2 * FIT_ROWS).select("toxic", "x").toArrow()
        x.append(np.array(seen["x"].to_pylist(), np.float64).reshape(-1, len(STRETCHES) + 2))
        y.append(seen["toxic"].to_numpy().astype(np.float64))
    return models[0], fit(np.concatenate(x), np.concatenate(y))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    """Logistic regression by Newton's steps: centre, scale and weights in three rows."""
    width = x.shape[1] + 1
    out = np.zeros((3, width))
    out[1] = 1
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        out[2, -1] = np.log((rate + 1e-6) / (1 - rate + 1e-6))
        return out
    out[0, :-1], out[1, :-1] = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - out[0, :-1]) / out[1, :-1], np.ones(len(y))])
    w = np.zeros(width)
    hold = np.array([ridge] * (width - 1) + [1e-6])  # few labels shall not make it sure
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold), z.T @ (y - p) - hold * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    out[2] = w
    return out


def apply(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = (x - weights[0, :-1]) / weights[1, :-1]
    return 1 / (1 + np.exp(-np.clip(z @ weights[2, :-1] + weights[2, -1], -30, 30)))


def with_score(docs: DataFrame, labels: DataFrame, name: str = "score", id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", broadcast_nodes: int = BROADCAST_NODES, mapped_nodes: int = MAPPED_NODES) -> DataFrame:
    """``docs`` with a column ``name``; one of that name is replaced, all others are kept.

    Null and empty texts have no words and get the score of that; texts of any length are
    read whole; rows that repeat get equal scores; a document that is labelled more than
    once counts as toxic if one label says so; labels other than 0 and 1 are left out, and
    so are rows without an id.  Without labels of both classes every score is the rate of
    toxic labels (zero without any).  An empty table gives no rows.  Only ids' remainders
    decide what is learnt; scores read texts alone.
    """
    model, weights = train(docs, labels, id_col, text_col, label_col, broadcast_nodes, mapped_nodes)
    if isinstance(model, (Model, MappedModel)):
        shared = docs.sparkSession.sparkContext.broadcast((model, weights))

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            model, weights = shared.value[0].loaded(), shared.value[1]
            found = texts.tolist()
            return pd.Series(np.concatenate([apply(model.features(found[i:j]), weights) for i, j in slices(found)]) if found else np.empty(0))

        return docs.withColumn(name, scored(col(text_col)))
    keyed = docs.withColumn("__ink_t", F.xxhash64(col(text_col)))
    texts = keyed.select(col("__ink_t").alias("t"), col(text_col).alias("text")).withColumns({"i": F.lit(0).cast("long"), "toxic": F.lit(0)})
    found = _texts_features(texts, model, 0).dropDuplicates(["t"])
    return keyed.join(found.select(F.col("t").alias("__ink_t"), _logistic("x", weights).alias("__ink_s")), "__ink_t").withColumn(name, F.col("__ink_s")).select(*[col(c) for c in docs.columns if c != name], col(name))


def _logistic(x: str, weights: np.ndarray) -> Column:
    z = F.lit(float(weights[2, -1]))
    for k in range(weights.shape[1] - 1):
        z = z + (F.col(x)[k] - float(weights[0, k])) / float(weights[1, k]) * float(weights[2, k])
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **named) -> DataFrame:
    """Rows (id, score) for every row of ``docs``; see ``with_score``."""
    slim = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    marks = labels.select(col(id_col).cast("long").alias("id"), col(label_col).alias("toxic"))
    return with_score(slim, marks, "score", "id", "text", "toxic", **named).select("id", "score")
