"""Benchmark decontamination as a prefix-filtered set join.

Windows of ten consecutive words of the benchmark items are the sets to contain; their
tokens are word shingles, ordered by how rare they are in the documents.  Containment
must be full, so the necessary prefix of a window is its one rarest shingle: a document
that holds the window holds this shingle, and its place tells where the window would
begin (positional bound); a window that would not fit into the text is dropped (length
bound).  What remains is verified word by word.

A benchmark of up to ``BLOCK_CHARS`` characters is broadcast to the documents.  A larger one
meets them by an equality join on the tokens: two passes over the documents, one that
counts how rare the benchmark's tokens are and one that sends the chosen tokens with the
words around them, whatever the benchmark's size.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, col, keyed_texts, map_arrow, materialize, slices

WINDOW = 10
#: Words of a token.
SHINGLE = 3
#: Benchmark characters that are broadcast; a larger benchmark is joined.
BLOCK_CHARS = 4 << 20
#: Bits of the table that tells which tokens the benchmark may have, and of a row of it.
SLOTS, ROW = 1 << 26, 1 << 15

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[bytes]:
    """Words as UTF-8, A-Z in lower case.  All bytes of other letters are over 0x7F, so
    the pattern splits bytes as it splits code points."""
    return _WORD.findall(text.encode().lower()) if text else []


class Windows:
    """Distinct windows of items: words by number, tokens, and who holds each window."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, shingle: int):
        self.number: dict[bytes, int] = {}
        held: defaultdict = defaultdict(set)
        for item, text in items:
            found = [self.number.setdefault(w, len(self.number)) for w in words(text)]
            for i in range(max(1, len(found) - window + 1) if found else 0):
                held[tuple(found[i : i + window])].add(item)
        self.windows = list(held)
        self.items = [sorted(held[w]) for w in self.windows]
        self.shingle = shingle
        self.tokens: dict[tuple, int] = {}
        for w in self.windows:
            for i in range(max(1, len(w) - shingle + 1)):
                self.tokens.setdefault(w[i : i + shingle], len(self.tokens))

    def order(self, rarity: dict[int, int]) -> None:
        """Keep for each window its rarest token and the token's place in it."""
        self.by_token: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for k, w in enumerate(self.windows):
            _, at = min((rarity.get(self.tokens[w[i : i + self.shingle]], 0), i) for i in range(max(1, len(w) - self.shingle + 1)))
            self.by_token[w[at : at + self.shingle]].append((k, at))
        self.arrays = [np.array(w, np.int32) for w in self.windows]
        self.sizes = sorted({len(t) for t in self.by_token})

    def matches(self, found: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Spans of words that windows cover, and the items, in a text's word numbers."""
        spans, items = [], set()
        raw = found.astype(np.int32).tobytes()
        for size in self.sizes:
            ok = found[: len(found) - size + 1] >= 0 if len(found) >= size else np.empty(0, bool)
            for i in range(1, size):
                ok = ok & (found[i : len(found) - size + 1 + i] >= 0)
            for p in np.flatnonzero(ok).tolist():
                for k, at in self.by_token.get(tuple(found[p : p + size].tolist()), ()):
                    begin, n = p - at, len(self.arrays[k])
                    if begin >= 0 and begin + n <= len(found) and raw[4 * begin : 4 * (begin + n)] == self.arrays[k].tobytes():
                        spans.append((begin, begin + n))
                        items.update(self.items[k])
        return spans, items


def _numbered(batches: Iterator[dict], number: dict[bytes, int]) -> Iterator[tuple[pa.Array, pa.Array, list[np.ndarray]]]:
    get = number.get
    for batch in batches:
        for a in range(0, len(batch["id"]), 512):
            texts = batch["text"].slice(a, 512).to_pylist()
            for i, j in slices(texts):
                yield batch["id"].slice(a + i, j - i), batch["t"].slice(a + i, j - i), [np.array([get(w, -1) for w in words(t)], np.int64) for t in texts[i:j]]


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (id, t, n_words, spans array of (begin, end) in words, items): merged covered spans.

    Null and empty texts have no words, very long ones are read whole; an item without
    words has no window; documents that repeat are each reported; empty tables give no
    rows, or rows without hits.  Items are named by their ids as strings; a null item id
    is left out of ``items``.  Other columns are not read, whatever their names.
    """
    items = benchmark.select(col(item_col).cast("string").alias("item"), col(item_text_col).alias("text")).where("text is not null")
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > block_chars:
        return _joined(docs, items, id_col, text_col, window, shingle)
    slim = docs.select(col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(col(text_col), F.lit(""))).alias("t"), col(text_col).alias("text"))
    return _pass(slim, Windows([(r["item"], r["text"]) for r in items.collect()], window, shingle), SCHEMA)


SCHEMA = "id long, t long, n_words long, spans array<struct<begin:long,end:long>>, items array<string>"


def _table(hashes: DataFrame) -> np.ndarray:
    """Bits of the slots of the hashes h; at most ``SLOTS`` of them, by rows."""
    slot = F.pmod("h", F.lit(SLOTS))
    rows = hashes.groupBy(F.floor(slot / ROW).cast("int").alias("row")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position(pmod(h, {SLOTS}L) % {ROW} + 1))").alias("bits")).collect()
    out = np.zeros((SLOTS // ROW, ROW // 8), np.uint8)
    for r in rows:
        out[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _tokens(sizes: list[int], table: np.ndarray):
    """A function from words to (place, size, hash) of tokens that the table has."""

    def find(found: list[bytes]) -> Iterator[tuple[int, int, int]]:
        for size in sizes:
            if len(found) < size:
                continue
            h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(found[p : p + size]), 42) for p in range(len(found) - size + 1)), np.uint64, len(found) - size + 1).view(np.int64)
            slot = h % SLOTS
            on = np.flatnonzero(table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            yield from ((p, size, int(h[p])) for p in on.tolist())

    return find


def _joined(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    spark = docs.sparkSession
    keyed, _ = keyed_texts(docs, id_col, text_col)

    def cut(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for item, text in zip(batch["item"].to_pylist(), batch["text"], strict=True):
                found = [w.decode() for w in words(text.as_py())]
                held = {tuple(found[i : i + window]) for i in range(max(1, len(found) - window + 1) if found else 0)}
                yield {"item": [item] * len(held), "words": [list(w) for w in held]}

    held = materialize(map_arrow(items, cut, "item string, words array<string>").withColumn("window", F.array_join("words", " ")).select("item", "words", "window"))
    windows = materialize(held.select("words", "window").distinct())
    token = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - shingle, F.lit(0))), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("words", i + 1, F.lit(shingle)), " ").alias("token")))
    tokens = materialize(windows.select("window", F.size("words").alias("n"), F.explode(token).alias("x")).select("window", "n", "x.at", F.xxhash64("x.token").alias("h"), F.least("n", F.lit(shingle)).alias("size")))
    sizes = sorted(r["size"] for r in tokens.select("size").distinct().collect())

    def rare(batches: Iterator[dict]) -> Iterator[dict]:
        find, seen = _tokens(*shared.value), Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(h for _, _, h in find(words(text.as_py())))
                if len(seen) > 500_000:
                    yield {"h": list(seen), "c": list(seen.values())}
                    seen.clear()
        yield {"h": list(seen), "c": list(seen.values())}

    shared = spark.sparkContext.broadcast((sizes, _table(tokens)))
    often = materialize(map_arrow(keyed.select("text"), rare, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    # the rarest token of each window; a window with one that no document has can't occur
    ranked = tokens.join(often, "h", "left").groupBy("window", "n").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "at", "h")).alias("x"))
    chosen = materialize(ranked.where("x.c > 0").select("window", "n", "x.at", "x.h"))

    def around(batches: Iterator[dict]) -> Iterator[dict]:
        find = _tokens(*picked.value)
        for batch in batches:
            for t, text in zip(batch["t"].to_pylist(), batch["text"], strict=True):
                found = words(text.as_py())
                rows = [(p, h, max(0, p - window + 1), min(len(found), p + window)) for p, _, h in find(found)]
                yield {"t": [t] * len(rows), "p": [r[0] for r in rows], "h": [r[1] for r in rows], "first": [r[2] for r in rows], "near": [[w.decode() for w in found[a:b]] for _, _, a, b in rows]}

    picked = spark.sparkContext.broadcast((sizes, _table(chosen)))
    places = map_arrow(keyed.select("t", "text"), around, "t long, p int, h long, first int, near array<string>")
    begin = F.col("p") - F.col("at")
    fits = (begin >= F.col("first")) & (begin + F.col("n") <= F.col("first") + F.size("near"))
    same = F.when(fits, F.array_join(F.slice("near", F.greatest(begin - F.col("first"), F.lit(0)) + 1, F.col("n")), " ") == F.col("window"))
    met = materialize(places.join(chosen, "h").where(fits & same).select("t", "window", begin.cast("long").alias("begin"), (begin + F.col("n")).cast("long").alias("end")).distinct())
    named = met.select("t", "window").distinct().join(held.select("item", "window"), "window").where("item is not null").groupBy("t").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = met.groupBy("t").agg(F.collect_set(F.struct("begin", "end")).alias("s")).join(named, "t", "left").select(F.col("t").alias("t2"), "s", "items")
    both = keyed.join(materialize(found), keyed["t"] == F.col("t2"), "left").select("id", F.xxhash64("text").alias("t"), "text", "s", "items")

    def merge(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            n = [len(words(x.as_py())) for x in b["text"]]
            yield {"id": b["id"], "t": b["t"], "n_words": n, "spans": [_union([(x["begin"], x["end"]) for x in s or ()]) for s in b["s"].to_pylist()], "items": [x or [] for x in b["items"].to_pylist()]}

    out = map_arrow(both, merge, SCHEMA)
    return out.withColumns({"id": F.when(F.col("id") != NO_ID, F.col("id"))})


def _union(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"begin": a, "end": b})
    return out


def _rarity(slim: DataFrame, windows: Windows) -> dict[int, int]:
    """In how many places of all documents each token of the block occurs."""
    shared = slim.sparkSession.sparkContext.broadcast((windows.number, windows.tokens))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        number, tokens = shared.value
        held: Counter = Counter()
        sizes = sorted({len(t) for t in tokens})
        for _, _, texts in _numbered(batches, number):
            for found in texts:
                for size in sizes:
                    ok = found[: max(0, len(found) - size + 1)] >= 0
                    for i in range(1, size):
                        ok = ok & (found[i : len(found) - size + 1 + i] >= 0)
                    held.update(k for p in np.flatnonzero(ok).tolist() if (k := tokens.get(tuple(found[p : p + size].tolist()))) is not None)
        yield {"token": list(held), "n": list(held.values())}

    rows = map_arrow(slim, run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def _pass(slim: DataFrame, windows: Windows, schema: str) -> DataFrame:
    windows.order(_rarity(slim, windows) if windows.windows else {})
    shared = slim.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        w = shared.value
        for ids, keys, texts in _numbered(batches, w.number):
            found = [w.matches(t) for t in texts]
            yield {"id": ids, "t": keys, "n_words": [len(t) for t in texts], "spans": [_union(s) for s, _ in found], "items": [sorted(x for x in i if x is not None) for _, i in found]}

    return map_arrow(slim, run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with all columns, whatever their
    names.  Rows without words stay, and so does an empty table; see ``hits``."""
    bad = hits(docs, benchmark, id_col, text_col, **named).where(F.size("spans") > 0).select(F.col("id").alias("__ink_i"), F.col("t").alias("__ink_t")).distinct()
    text = F.coalesce(col(text_col), F.lit(""))
    return docs.join(bad, col(id_col).cast("long").eqNullSafe(F.col("__ink_i")) & (F.xxhash64(text) == F.col("__ink_t")), "left_anti")
