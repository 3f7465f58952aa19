"""Byte-level BPE over a minimal acyclic transducer of frequent words.

Words are counted over all documents; the frequent ones are compiled into an automaton
with shared prefixes and suffixes.  Every transition carries a number, and the sum along
a word's path is the word's index in a table of id sequences, so equal suffixes are
stored once though their outputs differ.  The automaton is one file of flat arrays that
workers memory-map.  Words that are not in it are merged exactly.  Decoding
goes from ids back to bytes by a table.

Vocabulary and merges come from a tokenizer file of the ``tokenizers`` library with
byte-level pre-tokenisation; its path is a parameter and is read on the driver alone.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import mmap
import re
import tempfile
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, map_arrow, materialize, slices

#: Splits a text into words: fixed by the vocabulary's training.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts of ASCII alone, for the standard library's faster matcher; its own
#: ``\s`` takes more characters, so white space is spelled out.
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Most words of the lexicon; others are merged when met, so it bounds memory, not results.
LEXICON_WORDS = 100_000
#: Longer words are merged with a heap in place of steps over all words at once.
LONG_WORD = 48
#: Partial counts that a worker holds before it passes them on.
COUNTS_HELD = 300_000


def split_words(text: str) -> list[str]:
    return (ASCII_WORD if text.isascii() else WORD).findall(text)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones for
    themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Vocabulary:
    """Tables of a byte-level BPE file: bytes of each id, merges by pair."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, ids = byte_letters(), file["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in file["added_tokens"] if x.get("special")}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        pieces = [b""] * self.size
        for token, i in ids.items():
            pieces[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.pieces = pieces
        self.of_byte = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        key = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)

    def lookup(self, pairs: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; a number past all ranks where no merge exists."""
        at = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
        return np.where(self.pair[at] == pairs, self.rank[at], len(self.pair))

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words by the merge rules, best rank first and leftmost among equals."""
        out: list = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self.merge_long(w)
        by_length = sorted(short, key=lambda i: len(words[i]))
        for a in range(0, len(by_length), 4096):
            rows = by_length[a : a + 4096]
            for i, ids in zip(rows, self._merge_rows([words[i] for i in rows]), strict=True):
                out[i] = ids
        return out

    def _merge_rows(self, words: list[bytes]) -> list[np.ndarray]:
        n, width, none = len(words), max(1, max(map(len, words))), len(self.pair)
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, words), np.int64, n)
        ids = np.where(np.arange(width) < size[:, None], self.of_byte[flat], -1)
        rank = np.full((n, width), none)
        if width > 1:
            rank[:, :-1] = np.where(ids[:, 1:] >= 0, self.lookup(ids[:, :-1] * self.size + ids[:, 1:]), none)
        live = np.arange(n)
        while len(live):
            r = rank[live]
            at = r.argmin(1)
            best = r[np.arange(len(live)), at]
            live, at, best = live[best < none], at[best < none], best[best < none]
            if not len(live):
                break
            ids[live, at] = self.made[best]
            moved = np.arange(width - 1)[None, :] > at[:, None]
            row_i, row_r = ids[live], rank[live]
            row_i[:, :-1] = np.where(moved, row_i[:, 1:], row_i[:, :-1])
            row_r[:, :-1] = np.where(moved, row_r[:, 1:], row_r[:, :-1])
            row_i[:, -1], row_r[:, -1] = -1, none
            pick = np.arange(len(live))
            for shift in (-1, 0):  # the pairs that the new id belongs to
                x = at + shift
                ok = (x >= 0) & (x + 1 < width)
                p, q = pick[ok], x[ok]
                left, right = row_i[p, q], row_i[p, q + 1]
                row_r[p, q] = np.where(right >= 0, self.lookup(left * self.size + right), none)
            last = at == width - 1
            row_r[pick[last], at[last]] = none
            ids[live], rank[live] = row_i, row_r
        return [row[row >= 0] for row in ids]

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same for one word of any length, in n log n steps."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n, none = len(ids), len(self.pair)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        ranks = self.lookup(np.array(ids[:-1], np.int64) * self.size + np.array(ids[1:], np.int64)).tolist() if n > 1 else []
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < none]
        heapq.heapify(heap)
        known: dict = {}

        def push(i: int, j: int) -> None:
            pair = ids[i] * self.size + ids[j]
            if (r := known.get(pair)) is None:
                r = known[pair] = int(self.lookup(np.array([pair]))[0])
            if r < none:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = int(self.made[r]), False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                push(i, k)
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x, on in zip(ids, alive, strict=True) if on], np.int64)


class Pool:
    """Byte strings by number in flat arrays; ``join`` concatenates many at once."""

    def __init__(self, items: Iterable[bytes]):
        items = list(items)
        self.size = np.fromiter(map(len, items), np.int64, len(items))
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(items), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The concatenated bytes, and where each id's bytes end."""
        return gather(self.data, self.begin, self.size, ids)


def gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``data[begin[i]:begin[i] + size[i]]`` for each i of ``which``."""
    n = size[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(begin[which] - (ends - n), n) + np.arange(total)], ends


def compile_lexicon(words: list[bytes], ids: list[np.ndarray]) -> bytes:
    """The minimal acyclic transducer of sorted distinct ``words`` as the bytes of a file.

    Words enter in order; when one leaves a branch, the branch's states are replaced by
    equal ones that exist.  Then the words below each state are counted, which gives the
    transitions their outputs.
    """
    edges: list[list[tuple[int, int]]] = [[]]
    final = [False]
    known: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # of the last word: state, byte, next state

    def settle(depth: int) -> None:
        while len(path) > depth:
            state, byte, child = path.pop()
            shape = (final[child], *edges[child])
            same = known.setdefault(shape, child)
            if same != child:
                edges[state][-1] = (byte, same)

    last = b""
    for word in words:
        same = next((i for i, (x, y) in enumerate(zip(word, last, strict=False)) if x != y), min(len(word), len(last)))
        settle(same)
        state = path[-1][2] if path else 0
        for byte in word[same:]:
            edges.append([])
            final.append(False)
            new = len(edges) - 1
            edges[state].append((byte, new))
            path.append((state, byte, new))
            state = new
        final[state] = True
        last = word
    settle(0)
    counts: dict[int, int] = {}
    stack = [0]
    while stack:
        s = stack[-1]
        todo = [c for _, c in edges[s] if c not in counts]
        if todo:
            stack.extend(todo)
        else:
            counts[s] = final[s] + sum(counts[c] for _, c in edges[s])
            stack.pop()
    number = {s: i for i, s in enumerate(sorted(counts))}
    key, to, out = [], [], []
    for s in sorted(counts):
        passed = int(final[s])
        for byte, child in edges[s]:
            key.append(number[s] * 256 + byte)
            to.append(number[child])
            out.append(passed)
            passed += counts[child]
    sizes = np.array([len(x) for x in ids], np.int64)
    arrays = [np.array(key), np.array(to), np.array(out), np.array([final[s] for s in sorted(counts)]), np.cumsum(sizes) - sizes, sizes, np.concatenate([*ids, np.empty(0, np.int64)])]
    return b"".join([np.array([len(x) for x in arrays], np.int64).tobytes(), *(x.astype(np.int64).tobytes() for x in arrays)])


class Lexicon:
    """A compiled lexicon, mapped into memory from a file of the worker's own."""

    def __init__(self, file: bytes):
        with tempfile.TemporaryFile() as f:  # has no name, so a lost worker leaves nothing
            f.write(file)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        flat = np.frombuffer(self.map, np.int64)
        cuts = 7 + np.concatenate([[0], np.cumsum(flat[:7])])
        self.key, self.to, self.out, self.final, self.begin, self.size, self.ids = (flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def index(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 if it isn't in the lexicon; all words step together."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        state, total, alive = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        found = np.full(n, -1, np.int64)
        step = 0
        while len(alive) and len(self.key):
            done = size[alive] == step
            ends = alive[done & (self.final[state[alive]] == 1)]
            found[ends] = total[ends]
            alive = alive[~done]
            key = state[alive] * 256 + data[begin[alive] + step]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            alive, at = alive[ok], at[ok]
            state[alive], total[alive] = self.to[at], total[alive] + self.out[at]
            step += 1
        return found


class Coder:
    """Encodes and decodes batches of texts."""

    def __init__(self, vocabulary: Vocabulary, lexicon: bytes):
        self.v, self.lexicon = vocabulary, Lexicon(lexicon)
        self.pieces = Pool(vocabulary.pieces)
        self.decimals = Pool(b"%d," % i for i in range(vocabulary.size))
        self.split = regex.compile("|".join(regex.escape(x) for x in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None

    def words(self, text: str) -> list[str]:
        """Words of a text; special tokens are words of their own."""
        if not self.split or not self.split.search(text):
            return split_words(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += split_words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + split_words(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's ids end."""
        number: defaultdict = defaultdict(itertools.count().__next__)
        flat, ends = [], []
        for text in texts:
            words = self.words(text)
            flat.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            ends.append(len(words))
        pool, begin, size = self._of_words(list(number))
        which = np.concatenate(flat) if flat else np.empty(0, np.int64)
        ids, at = gather(pool, begin, size, which)
        return ids, np.concatenate([[0], at])[np.cumsum(ends)] if ends else np.empty(0, np.int64)

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words: a pool of ids, and where those of each word begin and how many they are."""
        raw = [w.encode() for w in words]
        at = self.lexicon.index(raw)
        for i in [i for i, w in enumerate(words) if w in self.v.special]:
            at[i] = -1
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        seen, unseen = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        begin[seen], size[seen] = self.lexicon.begin[at[seen]], self.lexicon.size[at[seen]]
        rest = unseen.tolist()
        merged = self.v.merge([raw[i] for i in rest])
        for k, i in enumerate(rest):
            if words[i] in self.v.special:
                merged[k] = np.array([self.v.special[words[i]]])
        size[unseen] = np.fromiter(map(len, merged), np.int64, len(merged))
        begin[unseen] = len(self.lexicon.ids) + np.cumsum(size[unseen]) - size[unseen]
        return np.concatenate([self.lexicon.ids, *merged]), begin, size

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where each id's bytes end."""
        return self.pieces.join(ids)


_coders: dict[int, Coder] = {}


def _coder(shared: Broadcast) -> Coder:
    """One coder per worker process and lexicon, kept for later tasks."""
    if shared.value["key"] not in _coders:
        _coders.clear()
        _coders[shared.value["key"]] = Coder(shared.value["vocabulary"], shared.value["lexicon"])
    return _coders[shared.value["key"]]


def _texts(batch: dict) -> Iterator[tuple[pa.Array, list[str]]]:
    for a in range(0, len(batch["id"]), 512):
        texts = ["" if t is None else t for t in batch["text"].slice(a, 512).to_pylist()]
        for i, j in slices(texts):
            yield batch["id"].slice(a + i, j - i), texts[i:j]


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (word, n) over the whole texts."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held: defaultdict = defaultdict(int)
        for batch in batches:
            for text in batch["text"]:
                for w in split_words(text.as_py() or ""):
                    held[w] += 1
                if len(held) > COUNTS_HELD:
                    yield {"word": list(held), "n": list(held.values())}
                    held.clear()
        yield {"word": list(held), "n": list(held.values())}

    return map_arrow(docs.select(col(text_col).alias("text")), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def share_coder(docs: DataFrame, path: str, text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> Broadcast:
    """Count words, compile the frequent ones, and broadcast tables of bounded size."""
    vocabulary = Vocabulary(path)
    counts = materialize(count_words(docs, text_col).where((F.length("word") <= LONG_WORD) & (F.col("n") > 1)).withColumn("level", F.floor(F.log2("n") * 16).cast("int")))
    # whole levels of frequency from the top, as far as the lexicon goes: never more rows
    # than that are sent to the driver, from however many partitions
    least, room = None, lexicon_words
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("n")).collect(), reverse=True):
        room -= r["n"]
        if room < 0:
            break
        least = r["level"]
    top = counts.where(F.col("level") >= least).select("word").collect() if least is not None else []
    words = sorted({r["word"].encode() for r in top})
    lexicon = compile_lexicon(words, vocabulary.merge(words))
    return docs.sparkSession.sparkContext.broadcast({"key": hashlib.sha256(lexicon).hexdigest() + path, "vocabulary": vocabulary, "lexicon": lexicon})


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Rows (id, ids): the token ids of each whole text.  Null and empty texts give none."""
    shared = share_coder(docs, path, text_col, lexicon_words)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        coder = _coder(shared)
        for batch in batches:
            for keys, texts in _texts(batch):
                ids, ends = coder.encode(texts)
                yield {"id": keys, "ids": _lists(ids, ends)}

    return map_arrow(docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")), run, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows (id, text) from rows (id, ids); bytes that are no UTF-8 become U+FFFD."""
    pieces = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path).pieces)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {"id": batch["id"], "text": [b"".join(pieces.value[i] for i in ids.as_py() or ()).decode("utf-8", "replace") for ids in batch["ids"]]}

    return map_arrow(encoded.select("id", "ids"), run, "id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS, keep_ids: bool = False) -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256, and ids if asked): every text encoded and decoded
    again within a worker, so that no ids are shuffled.

    A null text counts as empty (no tokens, hashes of nothing); repeated rows repeat; an
    empty table gives no rows; other columns are not read.
    """
    shared = share_coder(docs, path, text_col, lexicon_words)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        coder = _coder(shared)
        for batch in batches:
            for keys, texts in _texts(batch):
                ids, ends = coder.encode(texts)
                begins = np.concatenate([[0], ends[:-1]])
                cuts = list(zip(begins.tolist(), ends.tolist(), strict=True))
                hashes = []
                for pool, tail in ((coder.decimals, 1), (coder.pieces, 0)):
                    data, at = pool.join(ids)
                    view, at = memoryview(data), np.concatenate([[0], at]).tolist()
                    hashes.append([_sha(view[at[a] : max(at[a], at[b] - tail)], tail) for a, b in cuts])
                out = {"id": keys, "n_tokens": ends - begins, "ids_sha256": hashes[0], "decoded_sha256": hashes[1]}
                yield out | ({"ids": _lists(ids, ends)} if keep_ids else {})

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_arrow(docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")), run, schema)


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int32)))


def _sha(data: memoryview, plain: int) -> str:
    """SHA-256 of decimals, or of the text that decoded bytes stand for."""
    if not plain:
        try:
            str(data, "utf-8")
        except UnicodeDecodeError:
            return hashlib.sha256(bytes(data).decode("utf-8", "replace").encode()).hexdigest()
    return hashlib.sha256(data).hexdigest()
