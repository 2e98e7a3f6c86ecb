"""Benchmark decontamination by q-gram lemma filtering.

Texts are folded to the bytes of their lower-cased letters and digits (and of
everything outside ASCII), so case, punctuation and white space do not hide a
passage.  An item of L folded bytes is sought with at most e = L / 10 edits (fewer
for short items, so that the lemma keeps a threshold of LEAST_SHARED).

* By the q-gram lemma an occurrence with at most e edits shares at least
  L - q + 1 - q e q-grams with the item, all on e + 1 neighbouring diagonals
  (text position - item position).
* Diagonals are cut into overlapping bands, 2 (e + 1) wide, one every e + 1,
  so that any e + 1 neighbouring ones lie in one band.  Shared q-grams are
  counted by (item, band); a band that reaches the threshold is retained.
* A retained band is verified by an alignment confined to its diagonals, with
  free ends in the text: it counts if its distance is at most e.

Items of fewer than q + LEAST_SHARED - 1 folded bytes (12 here) leave the lemma
no threshold; they have no budget of edits and match verbatim, as whole words.

The q-gram index of the benchmark is broadcast in pieces of about PIECE_BYTES
of benchmark text, one after another: a larger benchmark makes more passes, so
what the driver holds and broadcasts is bounded at any size and nothing is
left out.  Shared q-grams are counted POSTINGS at a time, so a repetitive text
that meets a repetitive item takes time but no memory.

Cases: a null or empty text matches nothing; null items and items without a
letter or digit match nothing.  Repeated items give their pairs once for each
id.  An item found at several places is listed once with its least
distance.  Empty tables give empty results.  Other columns are ignored by
``matches`` and kept by ``remove``.  Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, frugal, map_rows, small_batches

Q = 8
EDIT_SHARE = 10
LEAST_SHARED = 5
PIECE_BYTES = 16 << 20
POSTINGS = 1 << 21
_BITS = 24

_DROP = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))


_SPACED = bytes(32 if b in _DROP else b for b in range(256))


def words_of(text: str | None) -> str:
    """Folded words between blanks, a character a byte."""
    return f" {' '.join(w.decode('latin-1') for w in text.lower().encode('utf-8', 'replace').translate(_SPACED).split())} " if text else " "


def folded(text: str | None) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(None, _DROP) if text else b""


def edit_budget(length: int) -> int:
    return max(0, min(length // EDIT_SHARE, (length - Q + 1 - LEAST_SHARED) // Q))


def rolling(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every Q neighbouring bytes."""
    n = len(points) - Q + 1
    h = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k in range(Q):  # Q is 8: the bytes themselves, then mixed
            h = (h << np.uint64(8)) | points[k : k + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


class Index:
    """Sorted q-gram keys of items with their postings (item, position)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t) for i, t in ((i, folded(t)) for i, t in items) if len(t) >= Q + LEAST_SHARED - 1]
        self.short = self._short(items)
        self.budget = np.array([edit_budget(len(t)) for _, t in self.items], np.int64)
        self.least = np.array([len(t) - Q + 1 - Q * e for (_, t), e in zip(self.items, self.budget)], np.int64)
        grams = [rolling(np.frombuffer(t, np.uint8)) for _, t in self.items]
        keys = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.int64)
        position = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        self.item, self.position = item[order], position[order]
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.present = np.zeros(1 << _BITS, bool)
        self.present[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.gap = int(self.budget.max(initial=0)) + Q

    @staticmethod
    def _short(items):
        """An automaton of the short items' words, with their ids; None without any."""
        import ahocorasick

        by_words: dict[str, list[int]] = {}
        for i, text in items:
            if 0 < len(folded(text)) < Q + LEAST_SHARED - 1:
                by_words.setdefault(words_of(text), []).append(i)
        if not by_words:
            return None
        built = ahocorasick.Automaton()
        for words, ids in by_words.items():
            built.add_word(words, ids)
        built.make_automaton()
        return built

    def hits(self, points: np.ndarray):
        """(item, diagonal) of every shared q-gram, about POSTINGS at a time."""
        h = rolling(points)
        at = np.flatnonzero(self.present[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        where = np.searchsorted(self.keys, h[at])
        where[where == len(self.keys)] = 0
        same = self.keys[where] == h[at] if len(self.keys) else np.zeros(0, bool)
        at, where = at[same], where[same]
        ends = np.cumsum(self.count[where])
        cuts = np.searchsorted(ends, np.arange(POSTINGS, ends[-1] + POSTINGS, POSTINGS)) + 1 if len(ends) else []
        low = 0
        for high in cuts:
            n = self.count[where[low:high]]
            posting = np.repeat(self.first[where[low:high]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield self.item[posting], np.repeat(at[low:high], n) - self.position[posting]
            low = high

    def bands(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of the bands that reach their threshold."""
        span = np.int64(len(points) + 2 * (1 << 20))
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for item, diagonal in self.hits(points):
            band = np.floor_divide(diagonal, self.budget[item] + 1)
            more, m = np.unique(np.concatenate([item * span + band + (1 << 20), item * span + band - 1 + (1 << 20)]), return_counts=True)
            keys, index = np.unique(np.concatenate([keys, more]), return_inverse=True)
            n = np.bincount(index, np.concatenate([n, m]), len(keys)).astype(np.int64)
        item = keys // span
        keep = n >= self.least[item]
        item = item[keep]
        return item, (keys[keep] - item * span - (1 << 20)) * (self.budget[item] + 1)

    def find(self, raw: list[str | None]) -> list[dict[int, int]]:
        """For each text: item id -> least distance."""
        found: list[dict[int, int]] = [{} for _ in raw]
        if self.short:
            for text, one in zip(raw, found):
                for _, ids in self.short.iter(words_of(text)):
                    one.update(dict.fromkeys(ids, 0))
        if not self.items:
            return found
        texts = [folded(t) for t in raw]
        separator = b"\x00" * self.gap  # no alignment within a budget crosses it
        joined = separator.join([b"", *texts, b""])
        starts = np.cumsum([self.gap] + [len(t) + self.gap for t in texts])[:-1] if texts else np.zeros(0)
        points = np.frombuffer(joined, np.uint8)
        for k, first in zip(*(x.tolist() for x in self.bands(points))):
            item_id, item = self.items[k]
            e = int(self.budget[k])
            low, high = max(0, first), min(len(joined), first + 2 * (e + 1) + len(item))
            exact = joined.find(item, low, high)
            if exact >= 0:
                distance, end = 0, exact + len(item)
            else:
                distance, end = banded(item, points, first, 2 * (e + 1))
            if distance <= e:
                doc = int(np.searchsorted(starts, end - 1, "right")) - 1
                found[doc][item_id] = min(distance, found[doc].get(item_id, distance))
        return found


def banded(item: bytes, points: np.ndarray, first: int, width: int) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text on diagonals first .. first + width - 1, and the stretch's end."""
    text = np.zeros(len(item) + width, np.uint8)
    low, high = max(0, first), min(len(points), first + len(text))
    text[low - first : high - first] = points[low:high]
    ramp = np.arange(width)
    row = np.zeros(width, np.int64)
    for i, byte in enumerate(item):
        replaced = row + (text[i : i + width] != byte)
        skipped = np.append(row[1:] + 1, 1 << 30)  # the item's byte has no counterpart
        row = np.minimum.accumulate(np.minimum(replaced, skipped) - ramp) + ramp
    best = int(row.argmin())
    return int(row[best]), first + len(item) + best


def pieces(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[bool, list[tuple[int, str]]]]:
    """The benchmark in lists of about PIECE_BYTES of text, one at a time, with whether it is the only one."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).dropna()
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(1, math.ceil(total / PIECE_BYTES * 2)) if total > PIECE_BYTES else 1
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    for k in range(n):
        yield n == 1, [(r.id, r.text) for r in items.filter(part == k).collect()]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, distance): one row for each document and item that it holds."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    parts = []
    for only, piece in pieces(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(piece)

        def make(shared=shared):
            index = Index(shared.value)

            def handle(ids, texts):
                pairs = [(i, item, distance) for i, f in zip(ids, index.find(texts)) for item, distance in sorted(f.items())]
                return tuple(zip(*pairs)) or ((), (), ())

            return handle

        part = map_rows(rows, f"{id_col} long, item_id long, distance int", make, text_col)
        if not only:
            part = checkpointed(part)
            shared.destroy()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no item."""
    for only, piece in pieces(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(piece)

        def run(batches, shared=shared):
            index = Index(shared.value)
            for batch in small_batches(batches, text_col):
                found = index.find(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(frugal(run), docs.schema)
        if not only:
            docs = checkpointed(docs)
            shared.destroy()
    return docs
