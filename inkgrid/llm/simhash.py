"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints within two bits are found without comparing all: cut into two halves, one
half differs by at most one bit, so both share a variant of that half in which this bit
is a wildcard.  All one-wildcard variants of both halves are the index; equal variants
meet by a hash partitioning and are verified by counting bits.

Near copies by similarity need more bits: at a Jaccard similarity of 0.8 a seventh of
them differ.  There the fingerprint has 256 bits, cut into twelve segments of 21; texts
that share a segment are compared by their sets of shingles.  This finds nearly all that
belongs together.  The rest is looked for exactly: texts that are as similar share a
shingle of their prefixes in any one order of all shingles, and those that do and are not
yet in one group are compared as well, so no link is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MOST_CLASHES, NO_ID, col, components, local_forest, map_arrow, materialize, slices
from .substring_dedup import shingle_hashes

#: Most differing bits of a link; two halves and one wildcard fit this number only.
MAX_BITS = 2
#: Members of a bucket that are compared in full; larger ones are cut by the other half.
BLOCK = 1024


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of ``text``; without words it is zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate([[0], ends[: len(words) - shingle] + 1]).tolist()
        hashes = [digest(line[a:b], 42) for a, b in zip(begins, ends[shingle - 1 :].tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[i : i + (1 << 14)], np.uint64)
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * bits > len(hashes)).tolist())


def _fingerprints(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        n = len(batch["id"])
        for a in range(0, n, 256):
            part = batch["text"].slice(a, 256).to_pylist()
            yield {"id": batch["id"].slice(a, 256), "t": batch["t"].slice(a, 256), "fp": np.array([fingerprint(t) for t in part], np.uint64).view(np.int64)}


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, t, fp): a hash of the text, and the fingerprint's 64 bits as a signed long."""
    slim = docs.select(col(id_col).cast("long").alias("id"), F.xxhash64(col(text_col)).alias("t"), col(text_col).alias("text"))
    return map_arrow(slim, _fingerprints, "id long, t long, fp long")


def _variants(batches: Iterator[dict]) -> Iterator[dict]:
    """Key: bit 37 the half, bits 32-36 the wildcard's place, below it the half with that bit zero."""
    for batch in batches:
        fps = batch["fp"].to_numpy().view(np.uint64)
        for a in range(0, len(fps), 4096):
            fp = fps[a : a + 4096]
            for half in (0, 1):
                value = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                at = np.arange(32, dtype=np.uint64)
                keys = (value[:, None] & ~(np.uint64(1) << at)) | (at << np.uint64(32)) | np.uint64(half << 37)
                yield {"key": keys.ravel().view(np.int64), "fp": np.repeat(fp, 32).view(np.int64)}


def _pairs(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``fp`` (distinct), compared in blocks.

    Buckets over BLOCK are cut again: of four parts of 16 bits, two bits leave two
    unchanged, so equal parts bring every link together.
    """
    a, b = [], []
    if len(fp) <= BLOCK:
        for i in range(0, len(fp), 256):
            x, y = np.nonzero(np.bitwise_count(fp[i : i + 256, None] ^ fp[None, :]) <= bits)
            a.append(fp[i + x])
            b.append(fp[y])
    else:
        for part in range(4):
            key = (fp >> np.uint64(16 * part)) & np.uint64(0xFFFF)
            order = np.argsort(key, kind="stable")
            fp, key = fp[order], key[order]
            edges = np.flatnonzero(np.diff(key, prepend=key[0] ^ np.uint64(1), append=key[-1] ^ np.uint64(1)))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                for k in range(i, j, 256):
                    for m in range(k, j, 4096):
                        x, y = np.nonzero(np.bitwise_count(fp[k : min(k + 256, j), None] ^ fp[None, m : min(m + 4096, j)]) <= bits)
                        a.append(fp[k + x])
                        b.append(fp[m + y])
                    if sum(map(len, a)) > 1 << 20:
                        a, b = ([z] for z in local_forest(np.concatenate(a), np.concatenate(b)))
    return local_forest(np.concatenate(a), np.concatenate(b))


def _links(batches: Iterator[dict]) -> Iterator[dict]:
    """Verified links of each bucket; rows come sorted by (key, fp)."""
    rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)

    def buckets(k: np.ndarray, f: np.ndarray) -> Iterator[dict]:
        cut = np.flatnonzero(np.diff(k)) + 1
        begins, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(k)]])
        sizes = ends - begins
        fp = f.view(np.uint64)
        two = begins[sizes == 2]  # most buckets with company
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= MAX_BITS]
        a, b = [f[near]], [f[near + 1]]
        for i, j in zip(begins[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
            x, y = _pairs(fp[i:j], MAX_BITS)
            a.append(x.view(np.int64))
            b.append(y.view(np.int64))
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            a, b = local_forest(a, b)
            yield {"a": a, "b": b}

    for batch in batches:
        k, f = np.concatenate([rest_k, batch["key"].to_numpy()]), np.concatenate([rest_f, batch["fp"].to_numpy()])
        last = int(np.searchsorted(k, k[-1])) if len(k) else 0
        rest_k, rest_f = k[last:].copy(), f[last:].copy()
        if last:
            yield from buckets(k[:last], f[:last])
    if len(rest_k):
        yield from buckets(rest_k, rest_f)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, t, fp, root, component): a fingerprint that names the component, and the smallest id reachable by links of two bits or fewer.

    Null and empty texts have fingerprint zero and link like any other; rows of equal
    text share a fingerprint and so a component; a null id is kept and never chosen as
    the component unless all ids of it are null; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col))
    firsts = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = map_arrow(firsts.select("fp"), _variants, "key long, fp long").repartition(n, "key").sortWithinPartitions("key", "fp")
    pairs = map_arrow(index, _links, "a long, b long")
    # edges join fingerprints in signed order; the components' roots are looked up as ids
    # below, from written tables, so that what many rows share can be split in each join
    stars = components(pairs)
    whole = materialize(firsts.join(stars, firsts["fp"] == stars["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = materialize(whole.groupBy("root").agg(F.min("first").alias("component")))
    found = whole.join(least, "root").select(F.col("fp").alias("f"), "root", "component")
    return prints.join(found, prints["fp"] == F.col("f")).select("id", "t", "fp", "root", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one of the smallest id, then
    of the smallest hash of its text; ids come before a null id.  Of rows that repeat it,
    one stays.  All columns are kept."""
    found = dedup(docs, id_col, text_col)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("x"), "id", "t")).alias("k")).select(F.col("k.id").alias("__ink_i"), F.col("k.t").alias("__ink_t"))
    key = F.xxhash64(col(text_col))
    kept = docs.withColumn("__ink_k", key).join(first, col(id_col).cast("long").eqNullSafe(F.col("__ink_i")) & (F.col("__ink_k") == F.col("__ink_t")), "left_semi")
    return kept.dropDuplicates([id_col, "__ink_k"]).select(*[col(c) for c in docs.columns])


# --- near copies by similarity


#: Segments of each of the fingerprint's four longs, their bits, and the words of a shingle.
SEGMENTS, BITS, WORDS = 3, 21, 5
SIMILARITY = 0.8
#: Standard deviations that the first long may miss the bound by where texts share a segment.
MARGIN = 3.0
#: Texts from which frequent shingles are told, and the most of these.  They go last in the
#: order of shingles, which makes the search fast; its result is the same in any order.
TOLD_TEXTS, TOLD = 4096, 1 << 19
#: Texts to be compared whose numbers are broadcast; more meet the texts by a shuffle.
BROADCAST_TEXTS = 4_000_000
#: Bins that the elements of a set are counted in, to tell what two sets can't have in common.
BINS = 256
#: Members of a bucket that are held against all others at a time.
ROWS = 256
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)

#: Each bit of a byte in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def differing(similarity: float, bits: int) -> float:
    """Bits that are expected to differ at a Jaccard similarity of sets of one size: their
    overlap is the cosine of the angle that the bits measure."""
    return bits * float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def hashes(texts: list[str | None], shingle: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, and the number of each; a text of fewer words
    than a shingle has one, of all its words, and a text without words has none."""
    h, size, words = shingle_hashes(texts, shingle)
    short = np.flatnonzero((size == 0) & (words > 0)).tolist()
    if short:
        begins = np.cumsum(size) - size
        h = np.insert(h, begins[short], [xxhash.xxh64_intdigest(b" ".join((texts[i] or "").encode().lower().split())) for i in short])
        size[short] = 1
    return h, size


def shingle_sets(h: np.ndarray, size: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each text in order, and their numbers; those in ``last``
    (sorted) come after all others."""
    of = np.repeat(np.arange(len(size)), size)
    late = np.zeros(len(h), bool)
    if last is not None and len(last):
        late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
    order = np.lexsort((h, late, of))
    h, of = h[order], of[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[once], np.bincount(of[once], minlength=len(size))


def prefix(size: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles of a set that meet those of any set that is as similar: among the first of
    both, in one order, there is a common one."""
    return np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)


def enough(common: np.ndarray, one: np.ndarray, two: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes with so many elements in common are as similar."""
    return common * (1 + similarity) >= similarity * (one + two) - 1e-9


def wide_fingerprints(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of four longs for the shingles' hashes of each text; without any, zeros."""
    out = np.zeros((len(size), 4), np.uint64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    # eight bits of a hash are added at a time, each in a byte of its own; a byte holds the
    # count of a block, which has 255 shingles at most
    blocks = -(-size[full] // 255)
    first = np.cumsum(blocks) - blocks
    begins = np.repeat((np.cumsum(size) - size)[full], blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    for k, seed in enumerate(_SEEDS):
        g = (h ^ np.uint64(seed)) * np.uint64(_SEEDS[(k + 1) % 4] | 1)
        g = (g ^ (g >> np.uint64(31))) * np.uint64(seed | 1)
        g ^= g >> np.uint64(33)
        octets = g.view(np.uint8).reshape(-1, 8)
        held = [np.add.reduceat(_SPREAD[octets[:, i]], begins).view(np.uint8).reshape(-1, 8) for i in range(8)]
        ones = 2 * np.add.reduceat(np.concatenate(held, 1).astype(np.int64), first, axis=0) > size[full][:, None]
        out[full, k] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _sliced(batches: Iterator[dict], shingle: int) -> Iterator[tuple[dict, int, int, np.ndarray, np.ndarray]]:
    """Ranges of batches with the hashes of their texts."""
    for batch in batches:
        for a in range(0, len(batch["t"]), 512):
            texts = batch["text"].slice(a, 512).to_pylist()
            for i, j in slices(texts, 1 << 20):
                yield batch, a + i, j - i, *hashes(texts[i:j], shingle)


def _binary(h: np.ndarray, size: np.ndarray, width: int = 8) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(h))])


def _told(batches: Iterator[dict], shingle: int) -> Iterator[dict]:
    for _, _, _, h, size in _sliced(batches, shingle):
        yield {"h": shingle_sets(h, size)[0].view(np.int64)}


def frequent(texts: DataFrame, shingle: int, n: int) -> np.ndarray:
    """Sorted hashes of shingles that several of some ``TOLD_TEXTS`` or n / 64 texts hold."""
    share = max(1, n // max(TOLD_TEXTS, n // 64))
    some = texts.where(F.pmod("t", F.lit(share)) == 0).dropDuplicates(["t", "u"]).select("t", "text")
    counted = map_arrow(some, lambda b: _told(b, shingle), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    counted = materialize(counted)
    least, held = None, 0
    for r in counted.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("h")).orderBy(F.desc("n")).collect():
        held += r["h"]
        if held > TOLD:
            break
        least = r["n"]
    if least is None:
        return np.empty(0, np.uint64)
    return np.sort(counted.where(F.col("n") >= least).select("h").toArrow()["h"].to_numpy().view(np.uint64))


def _wide(shingle: int, similarity: float, last):
    """Fingerprint, size of the set, its elements by bins and its prefix for each text."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch, a, n, h, size in _sliced(batches, shingle):
            fp = wide_fingerprints(h, size).view(np.int64)
            h, size = shingle_sets(h, size, last.value)
            first = prefix(size, similarity)
            at = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            found = {c: batch[c].slice(a, n) for c in ("t", "u", "id")} | {f"f{k}": fp[:, k] for k in range(4)}
            of = np.repeat(np.arange(n), size)
            bins = np.bincount(BINS * of + (h >> np.uint64(56)).astype(np.int64), minlength=BINS * n)
            bins = _binary(np.minimum(bins, 255).astype(np.uint8), np.full(n, BINS), 1)
            yield found | {"size": size, "bins": bins, "first": _binary(h[at < np.repeat(first, size)], first)}

    return run


def _segments(batches: Iterator[dict]) -> Iterator[dict]:
    """Keys of all segments: their number and bits."""
    for batch in batches:
        for k in range(4):
            value = batch[f"f{k}"].to_numpy().view(np.uint64)
            for j in range(SEGMENTS):
                part = (value >> np.uint64(BITS * j)) & np.uint64((1 << BITS) - 1)
                yield {"key": (part | np.uint64((SEGMENTS * k + j) << BITS)).view(np.int64), "fp": batch["f0"], "t": batch["t"]}


def leaders(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, by their places, of close fingerprints that hold a bucket together: the first
    one not yet close to a leader leads all that are close to it; who is close to several
    joins their groups."""
    a, b = [], []
    root = np.arange(len(fp))
    led = np.zeros(len(fp), bool)
    while not led.all():
        k = int(led.argmin())
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[k]) <= bits)
        led[k] = True
        _, first = np.unique(root[near], return_index=True)  # one of each group; all that have none
        pick = near[np.union1d(first, np.flatnonzero(~led[near]))]
        pick = pick[pick != k]
        a.append(np.full(len(pick), k))
        b.append(pick)
        root[np.isin(root, root[near])] = root[k] = root[near].min()
        led[near] = True
    none = np.empty(0, np.int64)
    return np.concatenate([*a, none]), np.concatenate([*b, none])


def _buckets(batches: Iterator[dict], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole buckets of rows that come sorted by key; such as have one row only
    are left out."""

    def shared(held: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        same = held["key"][1:] == held["key"][:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        return {n: v[keep] for n, v in held.items()}

    parts: list[dict[str, np.ndarray]] = []
    rows = 0
    for batch in batches:
        parts.append({n: batch[n].to_numpy() for n in names})
        rows += len(batch["key"])
        if rows > 1 << 16 and parts[-1]["key"][-1] != parts[0]["key"][0]:
            held = {n: np.concatenate([p[n] for p in parts]) for n in names}
            last = int(np.searchsorted(held["key"], held["key"][-1]))
            yield shared({n: v[:last] for n, v in held.items()})
            parts = [{n: v[last:].copy() for n, v in held.items()}]
            rows = len(parts[0]["key"])
    if rows:
        yield shared({n: np.concatenate([p[n] for p in parts]) for n in names})


def _ordered(a: np.ndarray, b: np.ndarray) -> dict:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    both = both[both[:, 0] != both[:, 1]]
    return {"a": both[:, 0].copy(), "b": both[:, 1].copy()}


def _close(bits: int):
    """Pairs of texts of each bucket that hold it together if they are similar."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for held in _buckets(batches, ["key", "fp", "t"]):
            key, fp, t = held["key"], held["fp"].view(np.uint64), held["t"]
            cuts = np.flatnonzero(np.diff(key, prepend=key[:1] ^ 1))
            a, b = [t[:0]], [t[:0]]
            for i, n in zip(cuts.tolist(), np.diff(cuts, append=len(key)).tolist(), strict=True):
                x, y = leaders(fp[i : i + n], bits)
                a.append(t[i + x])
                b.append(t[i + y])
            yield _ordered(np.concatenate(a), np.concatenate(b))

    return run


def _entries(batches: Iterator[dict]) -> Iterator[dict]:
    """A row for each shingle of a prefix: its place, the text and its group, zero for a
    group of one, as zeros take little room in a shuffle."""
    for batch in batches:
        for a in range(0, len(batch["t"]), 1024):
            first = batch["first"].slice(a, 1024)
            ends = np.frombuffer(first.buffers()[1], np.int32)[first.offset : first.offset + len(first) + 1]
            n = np.diff(ends) // 8
            key = np.frombuffer(first.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].copy().view(np.int64)
            part = {c: np.repeat(batch[c].slice(a, 1024).to_numpy(), n) for c in ("t", "root", "size")}
            part["root"] = np.where(part["root"] == part["t"], 0, part["root"])
            yield {"key": key, "at": np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)} | part


def _candidates(similarity: float):
    """Pairs of texts of a bucket in different groups that may have enough in common: no
    more than what follows the first common shingle, this one included."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for held in _buckets(batches, ["key", "at", "t", "root", "size"]):
            key, t, size = held["key"], held["t"], held["size"]
            root = np.where(held["root"] == 0, t, held["root"])
            left = size - held["at"]
            cuts = np.flatnonzero(np.diff(key, prepend=key[:1] ^ 1))
            sizes = np.diff(cuts, append=len(key))
            two = cuts[sizes == 2]
            fit = two[(root[two] != root[two + 1]) & enough(np.minimum(left[two], left[two + 1]), size[two], size[two + 1], similarity)]
            a, b, n = [t[fit]], [t[fit + 1]], len(fit)
            for i, m in zip(cuts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                j = i + m
                if (root[i:j] == root[i]).all():
                    continue
                for k in range(i, j, ROWS):
                    of = slice(k, min(k + ROWS, j))
                    x, y = np.nonzero((root[of, None] != root[None, k:j]) & enough(np.minimum(left[of, None], left[None, k:j]), size[of, None], size[None, k:j], similarity))
                    a.append(t[k + x])
                    b.append(t[k + y])
                    n += len(x)
                    if n > 1 << 20:
                        yield _ordered(np.concatenate(a), np.concatenate(b))
                        a, b, n = [t[:0]], [t[:0]], 0
            yield _ordered(np.concatenate(a), np.concatenate(b))

    return run


def similar(pairs: DataFrame, named: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of ``texts(t, text)`` whose sets of shingles are as similar, by the
    sets themselves.  Before these are made, pairs go whose ``named(t, size, bins)`` tell
    that they have too little in common."""

    def possible(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for k in range(0, len(batch["a"]), 4096):
                part = {c: v.slice(k, 4096) for c, v in batch.items()}
                x, y = (np.frombuffer(b"".join(part[c].to_pylist()), np.uint8).reshape(-1, BINS) for c in ("bx", "by"))
                nx, ny = part["nx"].to_numpy(), part["ny"].to_numpy()
                # a full bin may hold more, so this is at most what one has alone
                alone = (np.maximum(x, y) - y).sum(1, dtype=np.int64)
                keep = enough(nx - alone, nx, ny, similarity)
                yield {c: part[c].to_numpy()[keep] for c in ("a", "b")}

    of = lambda p, n: named.select(F.col("t").alias(p), F.col("size").alias(f"n{n}"), F.col("bins").alias(f"b{n}"))
    binned = pairs.distinct().join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "nx", "ny", "bx", "by")
    pairs = materialize(map_arrow(binned, possible, "a long, b long"))
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct())
    if wanted.count() <= BROADCAST_TEXTS:
        wanted = F.broadcast(wanted)

    def sets(batches: Iterator[dict]) -> Iterator[dict]:
        for batch, a, n, h, size in _sliced(batches, shingle):
            yield {"t": batch["t"].slice(a, n), "s": _binary(*shingle_sets(h, size))}

    def compared(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            keep = np.zeros(len(batch["a"]), bool)
            for k, (x, y) in enumerate(zip(batch["x"], batch["y"], strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
                keep[k] = len(x) > 0 and bool(enough(common, len(x), len(y), similarity))
            yield {c: batch[c].to_numpy()[keep] for c in ("a", "b")}

    held = map_arrow(texts.select("t", "text").join(wanted, F.col("t") == F.col("w"), "left_semi"), sets, "t long, s binary")
    held = materialize(held.groupBy("t").agg(F.min("s").alias("s")))
    one = materialize(pairs.join(held.select(F.col("t").alias("a"), F.col("s").alias("x")), "a"))
    both = one.join(held.select(F.col("t").alias("b"), F.col("s").alias("y")), "b")
    return materialize(map_arrow(both.select("a", "b", "x", "y"), compared, "a long, b long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (t, u, id, root), one for each different text and its smallest id: texts of one
    root are near copies, by links whose Jaccard similarity of sets of shingles reaches
    ``similarity``.  No such link is left out, and there is no other.

    t and u are hashes of the text, a null text is empty, a null id is ``NO_ID`` and comes
    after others.  All texts without words are copies of each other; a text of fewer words
    than a shingle is a copy of those of the same words; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(col(text_col), F.lit(""))
    after = F.coalesce(col(id_col).cast("long"), F.lit(2**63 - 1))
    slim = docs.select(text.alias("text"), after.alias("id")).withColumns({"t": F.xxhash64("text"), "u": F.xxhash64(F.lit(1), "text")})
    last = spark.sparkContext.broadcast(frequent(slim, shingle, slim.count()))
    longs = ["f0", "f1", "f2", "f3"]
    found = map_arrow(slim.select("t", "u", "id", "text"), _wide(shingle, similarity, last), "t long, u long, id long, f0 long, f1 long, f2 long, f3 long, size int, bins binary, first binary")
    texts = materialize(found.groupBy("t", "u").agg(F.min("id").alias("id"), *[F.min(f).alias(f) for f in (*longs, "size", "bins", "first")]))
    clashes = [r["t"] for r in texts.groupBy("t").count().where("count > 1").limit(MOST_CLASHES + 1).collect()]
    if len(clashes) > MOST_CLASHES:
        raise RuntimeError("too many texts share a hash")
    own = F.when(F.col("t").isin(clashes), F.xxhash64("t", "u", F.lit(2))).otherwise(F.col("t")) if clashes else F.col("t")
    named, whole = texts.where("size > 0").withColumn("t", own), slim.withColumn("t", own)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.repartition(n, "key").sortWithinPartitions("key")
    index = dealt(map_arrow(named.select("t", *longs), _segments, "key long, fp long, t long"))
    loose = differing(similarity, 64)
    links = similar(map_arrow(index, _close(int(loose + MARGIN * np.sqrt(loose))), "a long, b long"), named, whole, shingle, similarity)
    grouped = lambda links: named.join(components(links), F.col("t") == F.col("node"), "left").withColumn("root", F.coalesce("root", "t"))
    entries = map_arrow(grouped(links).select("t", "root", "size", "first"), _entries, "key long, at int, t long, root long, size int")
    more = similar(map_arrow(dealt(entries), _candidates(similarity), "a long, b long"), named, whole, shingle, similarity)
    stars = components(links.union(more))
    both = texts.withColumn("own", own).join(stars, F.col("own") == F.col("node"), "left").withColumn("root", F.coalesce("root", "own"))
    root = F.struct(F.col("size").cast("boolean").alias("words"), F.when(F.col("size") > 0, F.col("root")).otherwise(0).alias("t"))
    return both.select("t", "u", F.when(F.col("id") != 2**63 - 1, F.col("id")).otherwise(F.lit(NO_ID)).alias("id"), root.alias("root"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies the one of the smallest
    id, then of the smallest hash of its text; ids come before a null id.  Of rows that
    repeat it, one stays.  All columns are kept, whatever their names; see ``near_copies``
    for nulls, empty and short texts and empty tables."""
    groups = materialize(near_copies(docs, id_col, text_col, shingle, similarity))
    first = groups.groupBy("root").agg(F.min(F.struct((F.col("id") == NO_ID).alias("x"), "id", "t", "u")).alias("k"))
    kept = materialize(first.select(F.col("k.id").alias("__ink_i"), F.col("k.t").alias("__ink_t"), F.col("k.u").alias("__ink_u")))
    text = F.coalesce(col(text_col), F.lit(""))
    keys = {"__ink_i": F.coalesce(col(id_col).cast("long"), F.lit(NO_ID)), "__ink_t": F.xxhash64(text), "__ink_u": F.xxhash64(F.lit(1), text)}
    rows = docs.withColumns(keys).join(kept, list(keys), "left_semi")
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("__ink_i"))
    return rows.withColumn("__ink_n", turn).where("__ink_n = 1").select(*[col(c) for c in docs.columns])
