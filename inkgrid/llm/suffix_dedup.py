"""Removal of repeated byte strings by deep-shallow suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else.
Not every suffix is sorted: each window of ``length`` bytes has an anchor in it, the
place where the hash of the next ``GRAM`` bytes is least, and equal windows have equal
anchors at equal places.  Anchors whose gram occurs once in the corpus settle all their
windows; periodic stretches keep their outer anchors only.  The others bring the bytes
around them to the partition of their gram, where suffixes to the right of the anchor and
reversed prefixes to its left are sorted:

* shallow: a multikey quicksort whose letters are words of eight bytes,
* deep: suffixes that still tie go through a blind trie (inner nodes hold only a depth
  and the next byte; a new suffix is compared with one leaf).

The longest common prefixes of neighbours in both orders tell for every window of an
anchor whether another one is equal, byte by byte; hashes of 64 bits only bring candidates
together.  Groups of more than ``hot`` anchors are made small before they are sorted; there
a SHA-256 digest stands for the bytes that it is made of.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, announced, keyed_texts, map_arrow, materialize, repeated, slices

LENGTH = 200
GRAM = 64
#: Bytes that the quicksort compares before tries take over.
SHALLOW = 16
#: Anchors of one gram that are sorted in one task; larger groups are made small first.
HOT = 20_000
#: Members that are sorted at a time.
CHUNK = 20_000
#: Anchors of a chunk that are told of at a time.
TOLD = 200_000

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not len(_powers) or len(_powers["up"]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, factor in (("up", _BASE), ("down", inverse)):
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of ``data[i:i + gram]`` for every i where it fits."""
    up, down = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h | np.uint64(1)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of ``x[i:i + width]`` for every i where it fits."""
    step = 1
    while 2 * step <= width:
        x = best(x[:-step], x[step:])
        step *= 2
    return best(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of the anchors of all windows within the texts."""
    texts = [t if len(t) >= length else b"" for t in texts]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none.view(np.uint64)
    width = length - gram + 1
    h = gram_hashes(data, gram)
    low = _slide(h, width, np.minimum)
    for b, n in zip(begin[size > 0].tolist(), size[size > 0].tolist(), strict=True):
        low[b + n - length + 1 : b + n] = 0  # windows that would run into the next text
    pad = np.zeros(width - 1, np.uint64)
    high = _slide(np.concatenate([pad, low, pad]), width, np.maximum)
    at = np.flatnonzero(high == h)
    which = np.searchsorted(begin, at, "right") - 1
    return which, at - begin[which], h[at]


def _stretch(text: bytes, begin: int, end: int, d: int) -> tuple[int, int] | None:
    """The whole stretch of period ``d`` around ``begin`` to ``end``, if that is one."""
    if text[begin : end - d] != text[begin + d : end]:
        return None
    for width in (4096, 64, 1):
        while begin >= width and text[begin - width : begin] == text[begin - width + d : begin + d]:
            begin -= width
        while end + width <= len(text) and text[end : end + width] == text[end - d : end - d + width]:
            end += width
    return begin, end


def thinned(texts: list[bytes], which: np.ndarray, at: np.ndarray, h: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which anchors are needed.

    A stretch of period d, at most the gram, has an anchor in each period.  Windows over
    its begin hold its first anchor, windows over its end the last one.  Windows inside
    repeat d bytes on if the stretch has ``length + d`` bytes: then it is settled as a
    whole (see ``_periodic``), and its first two anchors stand for them where others look
    for partners.  A stretch under ``length`` bytes has no windows inside.
    """
    keep = np.ones(len(at), bool)
    step = np.diff(at)
    link = (which[1:] == which[:-1]) & (h[1:] == h[:-1]) & (step <= gram)
    go_on = link[1:] & link[:-1] & (step[1:] == step[:-1])
    edges = np.flatnonzero(np.diff(go_on.astype(np.int8), prepend=0, append=0))
    for i, j in zip(edges[::2].tolist(), (edges[1::2] + 1).tolist(), strict=True):  # anchors i to j
        d, text = int(step[i]), texts[which[i]]
        found = _stretch(text, int(at[i]), int(at[j]) + gram, d)
        if found and found[1] - found[0] >= length + d:
            keep[i + 2 : j - 1] = False
        elif found and found[1] - found[0] < length:
            keep[i + 1 : j] = False
    return keep


def _periodic(text: bytes, found: list[tuple[int, int]], length: int, gram: int) -> list[tuple[int, int]]:
    """Stretches that hold each of their windows twice, from repeated anchors (p, h)."""
    out: list[tuple[int, int]] = []
    for (p, h), (q, g) in zip(found, found[1:], strict=False):
        if h == g and q - p <= gram and not (out and out[-1][0] <= p and q + gram <= out[-1][1]):
            got = _stretch(text, p, q + gram, q - p)
            if got and got[1] - got[0] >= length + q - p:
                out.append(got)
    return out


def _anchors(length: int, gram: int):
    """Rows of ``announced`` for the needed anchors."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[tuple[np.ndarray, ...]] = []

        def rows() -> dict:
            return announced(*(np.concatenate([*(x[k] for x in held), np.empty(0, np.int64)]) for k in range(3)), across=False)

        for batch in batches:
            for first in range(0, len(batch["t"]), 512):
                texts = batch["text"].slice(first, 512).to_pylist()
                t = batch["t"].slice(first, 512).to_numpy()
                for i, j in slices(texts, 1 << 20):
                    raw = [(x or "").encode() for x in texts[i:j]]
                    which, at, h = anchors(raw, length, gram)
                    keep = thinned(raw, which, at, h, length, gram)
                    held.append((h[keep].view(np.int64), t[i:j][which[keep]], at[keep]))
                    if sum(len(x[0]) for x in held) >= TOLD:
                        yield rows()
                        held = []
        yield rows()

    return run


def _contexts(length: int, gram: int):
    """The bytes around each repeated anchor; h is null for spans (a, b) that are settled.

    Anchors of a chunk that have equal bytes around them settle each other, and one of
    them goes on.
    """

    def settled(held: dict, spans: list) -> dict:
        out: dict[str, list] = {n: [] for n in ("key", "h", "t", "p", "left", "right", "a", "b")}
        for t, a, b in spans:
            for name, x in zip(out, (t ^ a, None, t, None, None, None, a, b), strict=True):
                out[name].append(x)
        for (h, left, right), places in held.items():
            rows = [(h, h, *places[0], left, right, None, None)]
            least, most = max(0, length - len(right)), min(length - gram, len(left))
            if len(places) > 1 and least <= most:
                rows += [(h ^ t ^ (p << 20), None, t, p, None, None, p - most, p - least + length) for t, p in places]
            for row in rows:
                for name, x in zip(out, row, strict=True):
                    out[name].append(x)
        return out

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held: dict[tuple[int, bytes, bytes], list[tuple[int, int]]] = {}
        n, spans = 0, []
        for batch in batches:
            for first in range(0, len(batch["t"]), 64):
                keys = batch["t"].slice(first, 64).to_pylist()
                for t, text, at in zip(keys, batch["text"].slice(first, 64).to_pylist(), batch["at"].slice(first, 64).to_pylist(), strict=True):
                    raw, found = text.encode(), sorted((x["p"], x["v"]) for x in at)
                    for p, v in found:
                        held.setdefault((v, raw[max(0, p - length + gram) : p], raw[p : p + length]), []).append((t, p))
                    spans += [(t, a, b) for a, b in _periodic(raw, found, length, gram)]
                    n += len(found)
                    if n >= CHUNK:
                        yield settled(held, spans)
                        held, n, spans = {}, 0, []
        yield settled(held, spans)

    return run


def common_prefix(s: bytes, t: bytes) -> int:
    n = min(len(s), len(t))
    x = int.from_bytes(s[:n]) ^ int.from_bytes(t[:n])
    return n - (x.bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Numbers of distinct ``strings`` in lexicographic order."""

    def letter(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    root: list | int = 0
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while isinstance(node, list):  # blind: bytes between branches are skipped
            node = node[1].get(letter(s, node[0]), node[2])
        t = strings[_leaf(node)]
        n = common_prefix(s, t)
        above, node = None, root
        while isinstance(node, list) and node[0] < n:
            above, node = node, node[1][letter(s, node[0])]
        if isinstance(node, list) and node[0] == n:
            node[1][letter(s, n)] = i
            continue
        new = [n, {letter(t, n): node, letter(s, n): i}, node]
        if above is None:
            root = new
        else:
            above[1][letter(s, above[0])] = new
            if above[2] is node:
                above[2] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        else:
            out.append(node)
    return out


def _leaf(node: list | int) -> int:
    while isinstance(node, list):
        node = node[2]
    return node


def multikey_quicksort(letters: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of ``letters`` within their groups, and for each place of the order the
    first place of those that tie with it.

    Each turn takes a pivot letter in every open segment and cuts the segment in three:
    rows with a lesser letter, with the same, which go on to the next letter, and with a
    greater one.  All segments take their turns together.
    """
    order = np.argsort(group, kind="stable")
    ranked = group[order]
    segment = np.searchsorted(ranked, ranked)
    depth = np.zeros(len(order), np.int64)
    open_ = np.flatnonzero(np.bincount(segment, minlength=len(order))[segment] > 1) if letters.shape[1] else np.empty(0, np.int64)
    while len(open_):
        rows, seg = order[open_], segment[open_]
        letter = letters[rows, depth[open_]]
        cuts = np.flatnonzero(np.diff(seg, prepend=-1))
        sizes = np.diff(cuts, append=len(seg))
        pivot = np.repeat(letter[cuts + sizes // 2], sizes)
        side = (letter > pivot).astype(np.int64) - (letter < pivot)
        key = seg * 3 + side + 1
        by = np.argsort(key, kind="stable")
        order[open_], key = rows[by], key[by]
        depth[open_] += side[by] == 0
        first = np.flatnonzero(np.diff(key, prepend=-1))
        sizes = np.diff(first, append=len(key))
        segment[open_] = np.repeat(open_[first], sizes)
        open_ = open_[(np.repeat(sizes, sizes) > 1) & (depth[open_] < letters.shape[1])]
    return order, segment


def deep_shallow(strings: list[bytes], matrix: np.ndarray, group: np.ndarray, skip: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``strings`` within their groups, and the longest common prefix of each
    with the one before it (-1 for a group's first).

    ``matrix`` holds the strings padded with zeros; the first ``skip`` bytes are likely
    to be equal within a group, so the quicksort also looks at what follows them.
    """
    width = matrix.shape[1]
    depth = min(width, skip + shallow) // 8 * 8
    letters = matrix[:, :depth].copy().view(">u8").astype(np.uint64) if depth else np.empty((len(strings), 0), np.uint64)
    order, segment = multikey_quicksort(letters, group)
    # segments that still tie: distinct strings through a blind trie, equal ones together
    cuts = np.flatnonzero(np.diff(segment, prepend=-1, append=-1)) if len(segment) else np.empty(0, np.int64)
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if j - i == 1:
            continue
        same: dict[bytes, list[int]] = {}
        for m in order[i:j].tolist():
            same.setdefault(strings[m], []).append(m)
        if len(same) > 1:
            distinct = list(same)
            order[i:j] = [m for k in blind_trie_order(distinct) for m in same[distinct[k]]]
    size = np.fromiter(map(len, strings), np.int64, len(strings))[order]
    lcp = np.full(len(order), -1)
    for a in range(1, len(order), 8192):
        rows = np.arange(a, min(a + 8192, len(order)))
        differ = matrix[order[rows]] != matrix[order[rows - 1]]
        first = np.where(differ.any(1), differ.argmax(1), width)
        lcp[rows] = np.where(group[order[rows]] == group[order[rows - 1]], np.minimum(first, np.minimum(size[rows], size[rows - 1])), -1)
    return order, lcp


def repeated_windows(group: np.ndarray, left: list[bytes], right: list[bytes], length: int, gram: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the least and most bytes before it (from ``lo`` to ``hi``) from which
    an equal window of another anchor of its group begins; -1 where none does."""
    n, most = len(left), length - gram
    back = [x[::-1] for x in left]
    r_matrix = np.frombuffer(b"".join(x.ljust(length, b"\0") for x in right), np.uint8).reshape(n, length)
    l_matrix = np.frombuffer(b"".join(x.ljust(most, b"\0") for x in back), np.uint8).reshape(n, most)
    r_order, r_lcp = deep_shallow(right, r_matrix, group, gram)
    l_order, l_lcp = deep_shallow(back, l_matrix, group, 0)
    r_size, l_size = np.fromiter(map(len, right), np.int64, n), np.fromiter(map(len, back), np.int64, n)
    least, longest = np.full(n, -1), np.full(n, -1)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for before in range(most + 1):
        # intervals of both orders whose common prefix reaches the window's ends
        r_class[r_order] = np.cumsum(r_lcp < length - before)
        l_class[l_order] = np.cumsum(l_lcp < before)
        key = r_class * (n + 1) + l_class
        key[(r_size < length - before) | (l_size < before) | (before < lo) | (before > hi)] = -1
        ranked = np.sort(key)
        double = ranked[1:][(ranked[1:] == ranked[:-1]) & (ranked[1:] >= 0)]
        if not len(double):
            continue
        at = np.minimum(np.searchsorted(double, key), len(double) - 1)
        hit = double[at] == key
        longest[hit] = before
        least[hit & (least < 0)] = before
    return least, longest


def _sorted_groups(length: int, gram: int):
    """Spans that repeat; rows come sorted by their key, the anchor's hash, and rows
    without it are spans already."""

    def spans(rows: dict[str, list]) -> dict:
        group = np.unique(np.array(rows["h"], np.int64), return_inverse=True)[1]
        least, longest = repeated_windows(group, rows["left"], rows["right"], length, gram, np.array(rows["lo"]), np.array(rows["hi"]))
        on = np.flatnonzero(least >= 0)
        p = np.array(rows["p"], np.int64)[on]
        return {"t": np.array(rows["t"], np.int64)[on], "a": (p - longest[on]).astype(np.int32), "b": (p - least[on] + length).astype(np.int32)}

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        names = ("h", "t", "p", "left", "right", "lo", "hi")
        held: dict[str, list] = {n: [] for n in names}
        for batch in batches:
            known = batch["h"].is_null()
            if known.true_count:
                yield {n: batch[n].filter(known) for n in ("t", "a", "b")}
                batch = {n: batch[n].filter(pc.invert(known)) for n in names}
            for a in range(0, len(batch["h"]), 4096):
                for n in names:
                    held[n] += batch[n].slice(a, 4096).to_pylist()
                if len(held["h"]) >= CHUNK:
                    cut = held["h"].index(held["h"][-1])  # the last group may go on
                    if cut:
                        yield spans({n: held[n][:cut] for n in names})
                        held = {n: held[n][cut:] for n in names}
        if held["h"]:
            yield spans(held)

    return run


def _part(left: Column, right: Column, before: Column, after: Column) -> Column:
    """The bytes from ``before`` in front of an anchor to ``after`` behind its place."""
    front = F.when(F.length(left) > before, F.substring(left, F.length(left) - before + 1, before)).otherwise(left)
    return F.concat(front, F.substring(right, F.lit(1), after))


def _digest(*values: Column) -> Column:
    """256 bits that stand for bytes: what has one digest is taken as equal."""
    return F.sha2(F.concat(*[v.cast("binary") for v in values]), 256)


def _refined(rows: DataFrame, length: int, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """Groups of hot anchors made small, and spans that are settled on the way.

    ``rows(h, lo, hi, t, p, left, right)``: windows that begin ``lo`` to ``hi`` bytes
    before the anchor are in question.  Members that are equal wherever these windows
    reach settle each other, by a pre-aggregated count of their digests, and one goes on
    for all.  A group that is still hot is halved: windows of each half of the range have
    more bytes in common than the gram, and the group is divided by a digest of those.
    """
    small, settled = None, []
    keys = ["h", "lo", "hi", "k"]
    while True:
        reach = _part(F.col("left"), F.col("right"), F.col("hi"), length - F.col("lo"))
        sizes = {"n_left": F.length("left"), "n_right": F.length("right")}
        rows = materialize(rows.withColumns({"k": _digest(F.least(F.length("left"), F.col("hi")).cast("string"), reach), **sizes}))
        # one member of each class brings the bytes; the others only their places
        best = F.min(F.struct("t", "p", "left", "right")).alias("m")
        classes = materialize(rows.groupBy(*keys).agg(F.count("*").alias("n"), best))
        known = rows.select(*keys, "t", "p", *sizes).join(classes.where("n > 1").select(*keys), keys)
        least, most = F.greatest(F.col("lo"), length - F.col("n_right")), F.least(F.col("hi"), F.col("n_left"))
        settled.append(known.where(least <= most).select("t", (F.col("p") - most).cast("int").alias("a"), (F.col("p") - least + length).cast("int").alias("b")))
        rest = classes.select("h", "lo", "hi", "m.*")
        big = materialize(rest.groupBy("h", "lo", "hi").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("h", "lo", "hi"))
        done = rest.join(big, ["h", "lo", "hi"], "left_anti")
        small = done if small is None else small.unionByName(done)
        large = materialize(rest.join(big, ["h", "lo", "hi"], "left_semi").where("lo < hi"))
        if not large.limit(1).count():
            return small, settled
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi"))))
        cut = large.withColumn("half", halves).select("h", "half.lo", "half.hi", "t", "p", "left", "right")
        cut = cut.where((F.length("left") >= F.col("lo")) & (F.length("right") >= length - F.col("hi")))
        shared = _part(F.col("left"), F.col("right"), F.col("lo"), length - F.col("hi"))
        rows = cut.withColumn("h", F.xxhash64("h", "lo", shared))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (t, spans) of different texts with spans (a, b) that repeat, rows (t) of texts
    that several rows hold, and the rows (id, text, t) themselves.

    Texts that repeat as a whole are sorted once and removed as a whole.
    """
    keyed, firsts = keyed_texts(docs, id_col, text_col)
    found = map_arrow(keyed.select("t", "text"), _anchors(length, gram), "key long, v long, t long, p long")
    again = materialize(repeated(found, across=False).select("v", "t", F.col("p").cast("int").alias("p")))
    places = again.groupBy("t").agg(F.collect_set(F.struct("v", "p")).alias("at"))
    # one row of each text brings the bytes
    texts = keyed.join(places.join(firsts.select("t", "id"), "t"), ["t", "id"]).select("t", "text", "at")
    around = map_arrow(texts, _contexts(length, gram), "key long, h long, t long, p int, left binary, right binary, a int, b int")
    around = around.withColumns({"lo": F.lit(0), "hi": F.lit(length - gram)})
    is_hot = materialize(again.groupBy(F.col("v").alias("h")).agg(F.count("*").alias("c")).where(F.col("c") > hot).select("h"))
    settled: list[DataFrame] = []
    if is_hot.limit(1).count():
        around = materialize(around)
        small, settled = _refined(around.drop("key", "a", "b").join(is_hot, "h", "left_semi"), length, hot)
        small = small.withColumns({"key": F.col("h"), **{n: F.lit(None).cast("int") for n in ("a", "b")}})
        around = around.join(is_hot, "h", "left_anti").unionByName(small)  # spans have no h and stay
    spans = map_arrow(around.repartition("key").sortWithinPartitions("key"), _sorted_groups(length, gram), "t long, a int, b int")
    for more in settled:
        spans = spans.union(more)
    spans = materialize(spans.groupBy("t").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    return spans, firsts.where("n > 1").select("t"), keyed


def _cut(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, len(batch["id"]), 256):
            texts, spans, whole = (batch[n].slice(i, 256).to_pylist() for n in ("text", "spans", "whole"))
            kept, size, gone, runs = [], [], [], []
            for text, found, full in zip(texts, spans, whole, strict=True):
                raw = text.encode()
                merged: list[list[int]] = [[0, len(raw)]] if full else []
                for a, b in [] if full else sorted((s["a"], s["b"]) for s in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *(x for s in merged for x in s), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                size.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
                runs.append([{"a": a, "b": b} for a, b in merged])
            yield {"id": batch["id"].slice(i, 256), "kept": pa.array(kept, pa.binary()), "n_bytes": size, "n_removed": gone, "spans": runs}


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Rows (id, kept, n_bytes, n_removed, spans): the bytes that stay, and what goes.

    Null texts count as empty; texts of any length are read whole.  Texts under ``length``
    bytes stay whole, also if they repeat.  Rows of equal texts are each other's copies and go whole; nothing is kept
    for the first, as strings are judged on the input.  A null id is kept; an empty
    table gives no rows; other columns are not read, whatever their names.
    """
    spans, copies, keyed = repeated_spans(docs, id_col, text_col, length, gram, hot)
    marks = spans.join(copies.withColumn("many", F.lit(True)), "t", "full_outer")
    whole = F.coalesce("many", F.lit(False)) & (F.octet_length("text") >= length)
    both = keyed.join(marks, "t", "left").select("id", "text", "spans", whole.alias("whole"))
    out = map_arrow(both, _cut, "id long, kept binary, n_bytes long, n_removed long, spans array<struct<a:int,b:int>>")
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")))

