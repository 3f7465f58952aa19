"""Embedding near-duplicates on a robust-pruned flat graph.

Vectors go to their nearest two of a sample's k-means centres, so shards overlap.  In
each shard every vector gets edges to near vectors, robustly pruned: an edge goes if a
kept neighbour is closer to its end by the factor ``ALPHA``.  The adjacency lists of all
shards are united.  Every vector is then searched for in the graph of its nearest shard,
vectors at the far ends of edges included that can be in range: greedily from the shard's medoid and from its
own node, then expanding everything within a range around the threshold.  What is found
is verified by cosine in double precision.

Equal vectors are one node that counts as many; vectors of different widths are never in
one shard.  Only a spanning forest of the links leaves a shard; the number of links of each
vector is counted where it is searched.  The links found for some vectors are audited
against all; where the recall is too low, a wider search takes the place of the first.
"""

from __future__ import annotations

import heapq
import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, components, local_forest, map_arrow, materialize

THRESHOLD = 0.95
#: Vectors of a shard that are aimed at; a shard over four times as large is cut in its task.
SHARD = 1024
#: Shards that a vector is put into.
OVERLAP = 2
#: Most vectors that centres are fitted on (about), and most centres of a width.
SAMPLE, CENTRES = 20_000, 4096
#: Vectors whose links are audited against all (about), and the recall that is asked for.
AUDIT, RECALL = 1000, 0.9
#: Takes the widths and centres of a shard apart.
_WIDTH = 1 << 20
#: Candidates of a node, edges that pruning keeps, and how much closer it must be.
CANDIDATES, DEGREE, ALPHA = 48, 24, 1.2
#: Best nodes that the greedy search keeps open; cosine below the threshold that is
#: still expanded.
BEAM, SLACK = 8, 0.15


def _valid(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: finite(x)) & F.exists(vector, lambda x: x != 0)


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(1, keepdims=True)  # tiny and huge vectors keep their direction
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; deterministic, as it starts from evenly spaced rows."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(sample), 2048)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def _cut(x: np.ndarray, rows: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Overlapping parts of a shard: halves between two far vectors, a tenth in common."""
    if len(rows) <= limit:
        yield rows
        return
    a = x[rows[0]]
    b = x[rows[(x[rows] @ a).argmin()]]
    a = x[rows[(x[rows] @ b).argmin()]]
    side = x[rows] @ (a - b)
    order = rows[np.argsort(side, kind="stable")]
    n = len(rows)
    yield from _cut(x, order[: n * 11 // 20], limit)
    yield from _cut(x, order[n * 9 // 20 :], limit)


def pruned_edges(x: np.ndarray, candidates: int = CANDIDATES, degree: int = DEGREE, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the robust-pruned graph over the rows of ``x`` (unit vectors)."""
    n = len(x)
    k = min(candidates, n - 1)
    src, dst = [], []
    if k < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    for i in range(0, n, 256):
        rows = np.arange(i, min(i + 256, n))
        sim = x[rows] @ x.T
        sim[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-sim, k - 1, 1)[:, :k]
        s = np.take_along_axis(sim, near, 1)
        order = np.argsort(-s, 1, kind="stable")
        near, s = np.take_along_axis(near, order, 1), np.take_along_axis(s, order, 1)
        far = np.sqrt(np.maximum(0, 2 - 2 * s))
        v = x[near]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bid,bjd->bij", v, v)))
        alive, kept = np.ones(near.shape, bool), np.zeros(near.shape, bool)
        for j in range(k):
            take = alive[:, j] & (kept.sum(1) < degree)
            kept[:, j] = take
            alive &= ~(take[:, None] & (alpha * between[:, j] <= far))
        p, q = np.nonzero(kept)
        src.append(rows[p])
        dst.append(near[p, q])
    return np.concatenate(src), np.concatenate(dst)


def range_search(x: np.ndarray, edges: list[np.ndarray], query: int, start: int, threshold: float, beam: int = BEAM, slack: float = SLACK) -> np.ndarray:
    """Nodes within the threshold of node ``query``: greedy from ``start`` and from the
    query's own node, then everything in reach through nodes within the slack."""
    q = x[query]
    seen = {start, query}
    open_ = [(-float(x[n] @ q), n) for n in seen]
    heapq.heapify(open_)
    best = sorted(-s for s, _ in open_)  # similarities of the beam, worst first
    found = [query]
    while open_:
        s, node = heapq.heappop(open_)
        s = -s
        if s < threshold - slack and len(best) >= beam and s < best[0]:
            break
        new = [m for m in edges[node].tolist() if m not in seen]
        if not new:
            continue
        seen.update(new)
        for sim, m in zip((x[new] @ q).tolist(), new, strict=True):
            if sim >= threshold - 1e-9:
                found.append(m)
            if sim >= threshold - slack or len(best) < beam or sim > best[0]:
                heapq.heappush(open_, (-sim, m))
                best.append(sim)
                best.sort()
                del best[: max(0, len(best) - beam)]
    if start != query and float(x[start] @ q) >= threshold - 1e-9:
        found.append(start)
    return np.unique(found)


def _build(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _unit(pdf["vector"]), pdf["id"].to_numpy()
        src, dst, near = [], [], []
        for rows in _cut(x, np.arange(len(x)), 4 * SHARD):
            a, b = pruned_edges(x[rows])
            a, b = rows[a], rows[b]
            src += [ids[a], ids[b]]
            dst += [ids[b], ids[a]]
            near += [np.einsum("ij,ij->i", x[a], x[b]) >= least] * 2
        return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "near": np.concatenate(near)})

    return run


def _least_edge(threshold: float, slack: float) -> float:
    """The least cosine of an edge that leads from a node within the slack of a vector to
    one within the threshold of it: the angles add up."""
    angle = math.acos(max(-1.0, min(1.0, threshold - slack))) + math.acos(max(-1.0, min(1.0, threshold)))
    return math.cos(min(math.pi, angle)) - 1e-9


def _search(threshold: float, beam: int, slack: float):
    def run(members: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "n": np.empty(0, np.int64)})
        if not len(members):
            return none
        both = pd.concat([members, outside], ignore_index=True)
        x, ids = _unit(both["vector"]), both["id"].to_numpy()
        copies, home = both["n"].to_numpy(), both["home"].fillna(False).to_numpy(bool)
        at = {v: i for i, v in enumerate(ids.tolist())}
        edges = [np.array([at[d] for d in row if d in at] if row is not None else [], np.int64) for row in both["edges"]]
        medoid = int((x[: len(members)] @ x[: len(members)].mean(0)).argmax())
        counts, a, b = [], [], []
        for query in np.flatnonzero(home).tolist():
            near = range_search(x, edges, query, medoid, threshold, beam, slack)
            near = near[near != query]
            near = near[(x[near] * x[query]).sum(1) >= threshold]
            counts.append((ids[query], int(copies[near].sum() + copies[query] - 1)))
            a.append(np.full(len(near), ids[query]))
            b.append(ids[near])
            if len(a) > 2048:
                p, q = local_forest(np.concatenate(a), np.concatenate(b))
                a, b = [p], [q]
        p, q = local_forest(np.concatenate([*a, np.empty(0, np.int64)]), np.concatenate([*b, np.empty(0, np.int64)]))
        one = pd.DataFrame(counts, columns=["a", "n"]).assign(b=-1)
        return pd.concat([one[["a", "b", "n"]], pd.DataFrame({"a": p, "b": q, "n": -1})]).astype("int64")

    return run


def _fitted(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Centres of each width that has more vectors than a shard, on a sample of them."""
    sizes = {r["w"]: r["n"] for r in nodes.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > SHARD).collect()}
    if not sizes:
        return {}
    share = int(min(1.0, SAMPLE / sum(sizes.values())) * (1 << 30))
    drawn = nodes.where(F.size("vector").isin(list(sizes)) & (F.xxhash64("id").bitwiseAND(F.lit((1 << 30) - 1)) <= share))
    sample: dict[int, list] = {}
    for row in drawn.select("vector").toArrow()["vector"].to_pylist():
        sample.setdefault(len(row), []).append(row)
    return {w: centres(_unit(rows), min(len(rows), CENTRES, -(-sizes[w] // SHARD))) for w, rows in sample.items()}


def _assign(fitted: dict[int, np.ndarray], overlap: int):
    """The nearest centres of each vector, among those of its width."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for i in range(0, len(batch["id"]), 1024):
                part = batch["vector"].slice(i, 1024).to_pylist()
                width = np.fromiter(map(len, part), np.int64, len(part))
                out: list = [None] * len(part)
                for w in np.unique(width).tolist():
                    rows = np.flatnonzero(width == w)
                    c = fitted.get(w, np.zeros((1, w)))
                    near = np.argsort(-(_unit([part[k] for k in rows]) @ c.T), 1, kind="stable")[:, :overlap] + w * _WIDTH
                    for k, x in zip(rows.tolist(), near.tolist(), strict=True):
                        out[k] = x
                yield {"id": batch["id"].slice(i, 1024), "vector": batch["vector"].slice(i, 1024), "n": batch["n"].slice(i, 1024), "shards": out}

    return run


def _found(nodes: DataFrame, fitted: dict[int, np.ndarray], threshold: float, wider: int) -> DataFrame:
    """Rows (a, b, n): how many vectors are linked to node a (b < 0), and a forest of links
    (n < 0).  Each turn of ``wider`` doubles beam, overlap and slack."""
    schema = "id long, vector array<double>, n long, shards array<long>"
    shards = map_arrow(nodes.select("id", "vector", "n"), _assign(fitted, OVERLAP << wider), schema)
    placed = materialize(shards.select("id", "vector", "n", F.posexplode("shards").alias("turn", "shard")))
    slack = SLACK * (1 + wider)
    edges = placed.groupBy("shard").applyInPandas(_build(_least_edge(threshold, slack)), "src long, dst long, near boolean")
    lists = materialize(edges.groupBy("src").agg(F.collect_set("dst").alias("edges"), F.collect_set(F.when(F.col("near"), F.col("dst"))).alias("close")))
    members = placed.join(lists, placed["id"] == lists["src"], "left").select("shard", "id", "vector", "n", (F.col("turn") == 0).alias("home"), "edges")
    # ends elsewhere have no edges in a shard's search: only those that can be found there go
    tips = placed.select("shard", "id").join(lists.select(F.col("src").alias("id"), "close"), "id").select("shard", F.explode("close").alias("id")).distinct()
    tips = tips.join(placed.select("shard", "id"), ["shard", "id"], "left_anti")
    ends = tips.join(placed.where("turn = 0").select("id", "vector", "n"), "id")
    ends = ends.select(F.col("shard").alias("beside"), "id", "vector", "n", F.lit(False).alias("home"), F.lit(None).cast("array<long>").alias("edges"))
    searched = members.groupBy("shard").cogroup(ends.groupBy("beside")).applyInPandas(_search(threshold, BEAM << wider, slack), "a long, b long, n long")
    return materialize(searched)


def _against_all(rows: DataFrame, queries: list, threshold: float) -> DataFrame:
    """Rows (id, n): how many vectors of ``rows(id, vector, n)`` other than itself each of the
    ``queries`` (id, vector) links with, by comparing it with all of its width."""
    by_width: dict[int, tuple] = {}
    for r in queries:
        by_width.setdefault(len(r["vector"]), ([], []))[0].append(r["id"])
        by_width[len(r["vector"])][1].append(r["vector"])
    shared = rows.sparkSession.sparkContext.broadcast({w: (np.array(ids), _unit(v)) for w, (ids, v) in by_width.items()})

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        total = {w: np.zeros(len(ids), np.int64) for w, (ids, _) in shared.value.items()}
        for batch in batches:
            for i in range(0, len(batch["id"]), 1024):
                part = batch["vector"].slice(i, 1024).to_pylist()
                of, copies = batch["id"].slice(i, 1024).to_numpy(), batch["n"].slice(i, 1024).to_numpy()
                width = np.fromiter(map(len, part), np.int64, len(part))
                for w, (ids, q) in shared.value.items():
                    own = np.flatnonzero(width == w)
                    if len(own):
                        x = _unit([part[k] for k in own])
                        total[w] += (((q @ x.T >= threshold) & (ids[:, None] != of[own])) * copies[own]).sum(1)
        for w, (ids, _) in shared.value.items():
            yield {"id": ids, "n": total[w]}

    return map_arrow(rows.select("id", "vector", "n"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _recall(nodes: DataFrame, found: DataFrame, threshold: float, audit: int) -> float:
    """The share of the links of some nodes that the search has found."""
    share = int(min(1.0, audit / max(1, nodes.count())) * (1 << 30))
    queries = nodes.where(F.xxhash64(F.lit(3), "id").bitwiseAND(F.lit((1 << 30) - 1)) <= share).select("id", "vector", "n").collect()
    if not queries:
        return 1.0
    true = _against_all(nodes, queries, threshold)
    counted = found.where("n >= 0").select(F.col("a").alias("id"), F.col("n").alias("links"))
    own = nodes.select("id", (F.col("n") - 1).alias("own"))
    sums = true.join(counted, "id", "left").join(own, "id").agg(F.sum("n").alias("t"), F.sum(F.least(F.coalesce("links", F.lit(0)) - F.col("own"), F.col("n"))).alias("f")).first()
    return (sums["f"] or 0) / sums["t"] if sums["t"] else 1.0


def dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, audit: int = AUDIT) -> DataFrame:
    """Rows (id, n_links, component), one for every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing and are components of their own; so are vectors of different widths to each
    other.  Equal vectors link with each other.  Rows that repeat an id are vectors of
    their own.  A null id is named as component only where no other is reached.  An empty
    table gives no rows.  Other columns are not read, whatever their names.
    """
    rows = vectors.select(col(id_col).cast("long").alias("id"), col(vector_col).cast("array<double>").alias("vector"))
    nodes = rows.where(_valid(F.col("vector"))).groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("id"), "vector", "first", "n"))  # written, so names stay
    fitted = _fitted(nodes)
    for wider in range(3):
        found = _found(nodes, fitted, threshold, wider)
        recall = _recall(nodes, found, threshold, audit) if audit else 1.0
        if recall >= RECALL:
            break
    else:
        warnings.warn(f"only {recall:.2f} of the audited links were found", stacklevel=2)
    stars = components(found.where("b >= 0 or n < 0").select("a", "b"))
    roots = materialize(nodes.select("id", "first").join(stars, F.col("id") == F.col("node"), "left").select("id", "first", F.coalesce("root", "id").alias("root")))
    least = materialize(roots.groupBy("root").agg(F.min("first").alias("component")))
    counts = found.where("n >= 0").select(F.col("a").alias("id"), F.col("n").alias("links"))
    named = roots.join(least, "root").select("id", "component").join(counts, "id", "left")
    known = nodes.select("id", F.col("vector").alias("v")).join(named, "id").select("v", "links", "component")
    out = rows.join(known, F.col("vector") == F.col("v"), "left")
    return out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))


def true_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, modulus: int = 20, block: int = 4096) -> DataFrame:
    """Rows (id, n_true) for ids divisible by ``modulus``, by comparing them with all rows
    in blocks; the recall of ``dedup`` is measured against this."""
    rows = vectors.select(col(id_col).cast("long").alias("id"), col(vector_col).cast("array<double>").alias("vector")).where(_valid(F.col("vector"))).withColumn("n", F.lit(1).cast("long"))
    out, held = rows.select("id", "n").limit(0), []
    for row in rows.where(F.col("id") % modulus == 0).toLocalIterator():
        held.append(row)
        if len(held) == block:
            out, held = out.union(_against_all(rows, held, threshold)), []
    if held:
        out = out.union(_against_all(rows, held, threshold))
    return out.groupBy("id").agg(F.sum("n").alias("n_true"))
