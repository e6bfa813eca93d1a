"""Cost-balanced packing of documents into sequences for training.

A piece of n tokens costs linear * n + quadratic * n * n (its attention). Scan partitions are packed on their
own, in groups of about `group_tokens`, so nothing is shuffled and memory is bounded: full windows of
documents longer than a sequence are cut off first, then pieces go, in descending order, to the cheapest
sequence with room left; a piece that finds no sequence with room for all of it is cut at the largest room.
A group's sequences are all full but for a tail, whose tokens fill sequences of powers of two, which need
no padding.

Defined cases: a null text is empty, an empty document is its end token alone; a document of any length is
cut; repeated rows are packed each; a key named like a result column gets an underscore; an empty table gives an empty result. Ids are unique (partition, then
count), and a retried task makes the same sequences of the same rows.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.plans.shared import bound_batches, free_name

#: Pieces whose ids are remembered by a worker; beyond, it forgets all and goes on.
MEMO_WORDS = 500_000

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds(dict):
    """Little-endian unsigned 32-bit ids of texts, remembered by piece.

    A tokenizer that lower-cases, drops white space and merges within the pieces of a regular expression gives a
    text the ids of its pieces in a row, so each piece is encoded once. Texts with characters in which Python and
    the tokenizer might part (beyond U+024F, odd spaces, special tokens) are encoded whole, as are all
    texts of any other tokenizer.
    """

    #: What marks a text as plain for the pieces' expression.
    PLAIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u024f]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.pieces = self._expression(json.loads(self.tokenizer.to_str()))
        self.words: dict[str, bytes] = {}  # ids by blank-separated word, which spare most words the expression

    @staticmethod
    def _expression(told: dict):
        import regex

        steps = [n.get("type") for n in (told["normalizer"] or {}).get("normalizers", [])]
        split = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and told["model"].get("end_of_word_suffix"):
            return regex.compile(split["pattern"]["Regex"])
        return None

    def _learn(self, missing: list[str]) -> None:
        """Encode pieces in one text, blank-separated; each is one word of it."""
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, words = np.array(found.ids, dtype="<u4"), np.array(found.word_ids)
            cut = np.searchsorted(words, np.arange(len(part) + 1)).tolist()
            raw = ids.tobytes()
            self.update((w, raw[4 * i : 4 * j]) for w, i, j in zip(part, cut, cut[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [bool(self.pieces) and "<|" not in t and self.PLAIN.fullmatch(t) is not None for t in texts]
        for memo in (self, self.words):
            if len(memo) > MEMO_WORDS:
                memo.clear()
        split = [t.replace("\n", " ").split(" ") if ok else [] for t, ok in zip(texts, plain, strict=True)]
        new = {w: self.pieces.findall(w.lower()) for w in {w for words in split for w in words if w not in self.words}}
        self._learn(list({p for pieces in new.values() for p in pieces if p not in self}))
        self.words.update((w, b"".join(map(self.__getitem__, pieces))) for w, pieces in new.items())
        out = [b"".join(map(self.words.__getitem__, words)) for words in split]
        rest = [i for i, ok in enumerate(plain) if not ok]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out


_kept: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """A worker's tokenizer, kept from task to task."""
    if path not in _kept:
        _kept[path] = WordIds(path)
    return _kept[path]


class _Rooms:
    """Open sequences by the room they have left: the cheapest with at least so much room, and the roomiest.

    A heap per room holds (cost, sequence); a tree over the rooms holds the least entry of each range of rooms, so
    the cheapest is found in a logarithm of the capacity, however many sequences there are. A sequence's room only
    shrinks, so an entry is stale once its sequence has another room.
    """

    NONE = (float("inf"), -1)

    def __init__(self, rooms: list[int], capacity: int):
        self.left, self.top = list(rooms), capacity
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        for s, room in enumerate(rooms):
            self.heaps[room].append((0.0, s))  # equal costs in ascending order are a heap
        self.tree = [self.NONE] * (2 * self.size)
        for room, heap in enumerate(self.heaps):
            self.tree[self.size + room] = heap[0] if heap else self.NONE
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def _refresh(self, room: int) -> None:
        heap, i = self.heaps[room], self.size + room
        while heap and self.left[heap[0][1]] != room:
            heapq.heappop(heap)
        self.tree[i] = heap[0] if heap else self.NONE
        while i > 1:
            i >>= 1
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def cheapest(self, room: int) -> int | None:
        """The sequence of least cost (then number) with at least that much room."""
        best, low, high = self.NONE, self.size + room, 2 * self.size
        while low < high:
            if low & 1:
                best = min(best, self.tree[low])
                low += 1
            if high & 1:
                high -= 1
                best = min(best, self.tree[high])
            low >>= 1
            high >>= 1
        return best[1] if best[1] >= 0 else None

    def roomiest(self) -> int:
        """The cheapest of the sequences with the most room."""
        while not self.heaps[self.top]:
            self.top -= 1
        return self.heaps[self.top][0][1]

    def fill(self, s: int, tokens: int, cost: float) -> None:
        before = self.left[s]
        self.left[s] = before - tokens
        self._refresh(before)
        if self.left[s]:
            heapq.heappush(self.heaps[self.left[s]], (cost, s))
            self._refresh(self.left[s])


def pack_group(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of these token counts; sequences count from 0."""
    out, pieces, total = [], [], 0
    full = 0
    for doc, n in enumerate(lengths):
        for at in range(0, n - n % capacity, capacity):
            out.append((doc, at, capacity, full, 0))
            full += 1
        if n % capacity:
            pieces.append((n % capacity, doc, n - n % capacity))
            total += n % capacity
    pieces.sort(key=lambda p: (-p[0], p[1]))
    rooms = [capacity] * (total // capacity)
    tail = total % capacity
    rooms += [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
    used, cost = [0] * len(rooms), [0.0] * len(rooms)
    open_ = _Rooms(rooms, capacity)
    for n, doc, start in pieces:
        while n:
            found = open_.cheapest(n)
            if found is None:
                found = open_.roomiest()  # no sequence takes all of it, so it is cut
            take = min(n, open_.left[found])
            out.append((doc, start, take, full + found, used[found]))
            used[found] += take
            cost[found] += linear * take + quadratic * take * take
            open_.fill(found, take, cost[found])
            n, start = n - take, start + take
    return out


def _packer(path: str, end_id: int, capacity: int, linear: float, quadratic: float, group_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        end = end_id.to_bytes(4, "little")
        base, count = TaskContext.get().partitionId() << 36, 0
        keys: list = []
        held: list[bytes] = []
        tokens, schema = 0, None

        def flush() -> pa.RecordBatch:
            nonlocal count
            rows = pack_group([len(b) // 4 for b in held], capacity, linear, quadratic)
            cols = [[] for _ in range(7)]
            last = -1
            for doc, start, n, s, offset in rows:
                last = max(last, s)
                for col, v in zip(cols, (keys[doc], start, n, zlib.crc32(memoryview(held[doc])[4 * start : 4 * (start + n)]), len(held[doc]) // 4, base + count + s, offset), strict=True):
                    col.append(v)
            count += last + 1
            arrays = [pa.array(cols[0], schema)] + [pa.array(c, pa.int64()) for c in cols[1:]]
            return pa.RecordBatch.from_arrays(arrays, names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            schema = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for key, b in zip(part.column(0).to_pylist(), ids_of.encode(texts), strict=True):
                    keys.append(key)
                    held.append(b + end)
                    tokens += len(held[-1]) // 4
                if tokens >= group_tokens:
                    yield flush()
                    keys, held, tokens = [], [], 0
        if held:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, linear: float = 1.0, quadratic: float = 1 / 4096, group_tokens: int = 4_000_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset; each id lies in exactly one piece."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    run = _packer(tokenizer, end_id, capacity, linear, quadratic, group_tokens)
    return rows.mapInArrow(run, f"key {kind}, {PIECE}").withColumnRenamed("key", free_name(key, [c.split()[0] for c in PIECE.split(", ")]))
