"""Exact n-gram Jaccard join by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct SIZE-word shingles
(A-Z lower-cased; with fewer words, the whole sequence as one element; without
words, nothing).  Documents link when their sets' Jaccard similarity is at
least PERCENT / 100.

1. *Copies*: documents with equal sets are one class; only classes are joined.
2. *Order*: all n-grams have one global order, by hash, with the frequent ones
   last by their counts.  Counts are taken over all documents, chunk by chunk;
   at most ORDER_LIMIT frequent n-grams are held.  The order only decides how
   much work there is: any order gives the same links.
3. *Candidates*: two linked classes share an n-gram among the first
   |x| - ceil(t |x|) + 1 ones of each.  Those n-grams are dealt out by value.
   First each class is paired with a few others of its run (its neighbour by
   size and the run's heads), never with all.  Verified links are contracted
   to components.  ROUNDS times, classes of large runs outside the largest
   component are paired with PARTNERS others that may link; at last all pairs are
   made whose classes still lie in different components.  Each kind goes on only if the n-grams that its prefixes share
   and what the rest can add at most reach the threshold.
4. *Fragments*: the order is cut into FRAGMENTS hash ranges.  Partial overlaps
   are counted for each fragment apart and summed for each pair.
5. Links and copies make components; a component's id is its least document.

Every link between different components is found by 3, so components are
exact, while a group of m near copies costs about m pairs, not m squared.

Cases: a null or empty text has an empty set and links with nothing.  A null
id gives a null component.  Rows with a repeated id are separate documents
that share their id.  Empty tables give empty results.  Other columns are
ignored.  Texts are read whole.  Words, shingles and sets are told apart by
64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quire.llm.common import _arrow_schema, checkpointed, frugal, small_batches
from quire.llm.graph import components

SIZE = 4
PERCENT = 85
FRAGMENTS = 8
ORDER_LIMIT = 1 << 18
FREQUENT = 8
ROUNDS = 1
PARTNERS = 24
HOT_RUN = 32
BLOCK = 512
_CHUNK = 1 << 20
_BYTES = 1 << 20
_CUTS = 32
_CUT = (1 << 64) // 160  # the cuts cover the fifth of the order in which first fragments end
_BITMAP = 1 << 26

_M = 0x9E3779B97F4A7C15


class Shingler:
    """The sorted shingle sets of a batch of texts, from the batch's bytes; no object is made for a word."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.random = np.random.default_rng(4)
        self.codes = self.random.integers(0, 1 << 64, 256, dtype=np.uint64)
        for upper in range(65, 91):
            self.codes[upper] = self.codes[upper + 32]
        self.gap = np.zeros(256, bool)
        self.gap[[32, *range(9, 14)]] = True
        self.codes[self.gap] = 0
        self.places = np.zeros(0, np.uint64)

    def _grow(self, n: int):
        if len(self.places) < n:  # drawn one after another: the same at every length
            self.places = np.concatenate([self.places, self.random.integers(0, 1 << 64, max(64, n - len(self.places)), dtype=np.uint64) | np.uint64(1)])

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of all words, and the first word of each text.

        The hash is multilinear: each place in a word has a random factor of
        its own, so no structure of words makes them meet.
        """
        gap = self.gap[data]
        before = np.concatenate([[True], gap[:-1]]) if len(data) else gap
        before[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(~gap & before)
        firsts = np.searchsorted(starts, bounds)
        if not len(starts):
            return np.zeros(0, np.uint64), firsts
        sizes = np.diff(np.append(starts, len(data)))  # with the gap behind each word, whose codes are 0
        self._grow(int(sizes.max()))
        place = np.arange(starts[0], len(data)) - np.repeat(starts, sizes)
        h = np.add.reduceat(self.codes[data[starts[0] :]] * self.places[place], starts - starts[0])
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_M)
        return h ^ (h >> np.uint64(29)), firsts

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(elements, bounds): text i has elements[bounds[i]:bounds[i + 1]], as uint64."""
        column = column.cast(pa.large_string())
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        h, firsts = self.words(data, bounds - bounds[0])
        n_words = np.diff(firsts)
        sizes = np.where(n_words > 0, np.maximum(1, n_words - self.size + 1), 0)
        out = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(firsts[:-1] - out[:-1], sizes) + np.arange(out[-1])  # the first word of each shingle
        padded = np.append(h, np.zeros(self.size, np.uint64))
        x = np.full(len(at), self.size, np.uint64)
        for k in range(self.size):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(_M) + padded[at + k]
        for i in np.flatnonzero((n_words > 0) & (n_words < self.size)).tolist():  # the whole sequence, marked by its length
            one = np.array([n_words[i]], np.uint64)
            for w in h[firsts[i] : firsts[i + 1]]:
                one = (one ^ (one >> np.uint64(31))) * np.uint64(_M) + w
            x[out[i]] = one[0]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(_M)
        x ^= x >> np.uint64(29)
        new = np.ones(len(x), bool)
        for a, b in zip(out[:-1].tolist(), out[1:].tolist()):
            x[a:b].sort()
        new[1:] = x[1:] != x[:-1]
        new[out[:-1][sizes > 0]] = True
        return x[new], np.concatenate([[0], np.cumsum(new)])[out]


def class_of(elements: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(elements.tobytes())


def least_share(n, percent: int):
    """ceil(t n)"""
    return -(-percent * n // 100)


def least_overlap(both, percent: int):
    """The least overlap of two linked sets whose sizes sum to `both`."""
    return -(-percent * both // (100 + percent))


def frequent(docs: DataFrame, id_col: str, text_col: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent n-grams, sorted, and their counts: at most ORDER_LIMIT of them."""
    schema = "h long, n long"

    def run(batches):
        shingles, sets, held, seen = Shingler(size), [], 0, set()

        def counted():
            u, c = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = c > 1
            sets.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(u[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], names=["h", "n"])

        for batch in small_batches(batches, text_col, _BYTES):
            elements, bounds = shingles(batch.column(0))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if (copy := class_of(elements[a:b])) not in seen:
                    seen.add(copy)
                    sets.append(elements[a:b])
                    held += b - a
            if held > _CHUNK:
                yield counted()
                held = 0
        yield counted()

    counts = docs.select(F.col(text_col).cast("string").alias(text_col)).mapInArrow(frugal(run), schema).groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    counts = checkpointed(counts)
    powers = {r.p: r.k for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("k")).collect()}
    total, least = 0, 64
    for p in sorted(powers, reverse=True):
        if (total := total + powers[p]) > ORDER_LIMIT:
            break
        least = p
    got = counts.filter(F.log2("n") >= least).toArrow()
    h, n = got["h"].to_numpy().view(np.uint64), got["n"].to_numpy()
    by = np.argsort(h)
    return h[by], n[by]


RECORDS = "id long, n int, class long, prefix array<long>, below array<int>, end int"


def records(docs: DataFrame, order, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(id, n, class, prefix, below, end) of every row.

    prefix: the first n-grams, as signed numbers in hash order.  below: how
    many infrequent n-grams stand below each cut of the order, and in all.
    end: the last cut before which the prefix has them all.
    """
    types = _arrow_schema(docs.sparkSession, RECORDS)

    def run(batches):
        shingles, (keys, counts) = Shingler(size), order.value
        cuts = np.arange(1, _CUTS + 1, dtype=np.uint64) * np.uint64(_CUT)
        for batch in small_batches(batches, text_col, _BYTES):
            joined, bounds = shingles(batch.column(1))
            sizes = np.diff(bounds)
            rank = np.zeros(len(joined), np.int64)
            if len(keys):
                at = np.searchsorted(keys, joined)
                at[at == len(keys)] = 0
                rank = np.where(keys[at] == joined, counts[at], 0)
            some = np.concatenate([[0], np.cumsum(rank > 0)])[bounds]
            prefixes, classes, below, end = [], [], np.zeros((len(sizes), _CUTS + 2), np.int32), np.zeros(len(sizes), np.int32)
            for i, (a, b, n_frequent) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), np.diff(some).tolist())):
                s = joined[a:b]
                classes.append(class_of(s))
                p = b - a - least_share(b - a, percent) + 1 if b > a else 0
                rare = s if not n_frequent else s[rank[a:b] == 0]
                below[i, 1:-1] = np.searchsorted(rare, cuts, "right")
                below[i, -1] = len(rare)
                end[i] = _CUTS + 1 if p > len(rare) else np.searchsorted(cuts, rare[p - 1], "right") if p else 0
                if n_frequent:
                    s = s[np.argsort(rank[a:b], kind="stable")]
                prefixes.append(s[:p])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
            values = (np.concatenate([*prefixes, np.zeros(0, np.uint64)]) ^ np.uint64(1 << 63)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, below.size + 1, _CUTS + 2, dtype=np.int32)), pa.array(below.ravel()))
            columns = [batch.column(0).cast(pa.int64()), pa.array(sizes.astype(np.int32)), pa.array(np.array(classes, np.uint64).view(np.int64)), lists.cast(types[3].type), cells.cast(types[4].type), pa.array(end)]
            yield pa.RecordBatch.from_arrays(columns, schema=types)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias(text_col)).mapInArrow(frugal(run), RECORDS)


def _runs(batches, columns: int):
    """Arrays of the columns, cut so that no run of equal first values is split."""
    held: list[list[np.ndarray]] = []  # pieces of one run, joined once
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if held and now[0][0] != held[0][0][0]:
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
        if cut:
            yield [np.concatenate(x) for x in zip(*held, [x[:cut] for x in now])]
            held = []
        held.append([x[cut:] for x in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def first_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Postings (token, n, class) of tokens that several classes share, each with up to three partners of its run.

    Postings are dealt out by ranges of (token, n, class), so a long run is cut
    into stretches; partners stand in the same stretch.  A stretch of one
    posting at a task's end may go on in the next task, so it is kept.
    """
    schema = "token long, n int, class long, by_size long, by_head long, by_least long"
    types = _arrow_schema(postings.sparkSession, schema)

    def partners(token, n, cls, is_first, is_last):
        new = np.concatenate([[True], token[1:] != token[:-1]])
        index = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        several = np.diff(np.append(starts, len(token)))[index] > 1
        several[0] |= is_first
        several[-1] |= is_last
        span = int(n.max()) + 2
        key = index * span + n
        head = np.searchsorted(key, index * span + -(-percent * n // 100))  # the stretch's first that is large enough
        before = np.maximum(np.arange(len(token)) - 1, starts[index])
        order = np.lexsort((cls, index))
        least = order[starts][index]
        fits = percent * np.maximum(n, n[least]) <= 100 * np.minimum(n, n[least])
        least = np.where(fits, least, np.arange(len(token)))
        return pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (token, n, cls, cls[before], cls[head], cls[least])], schema=types)

    def run(batches):
        held, is_first = None, True
        for stretch in _runs(batches, 3):
            if held is not None:
                yield partners(*held, is_first, False)
                is_first = False
            held = stretch
        if held is not None:
            yield partners(*held, is_first, True)

    dealt = postings.repartitionByRange("token", "n", "class").sortWithinPartitions("token", "n", "class")
    return dealt.mapInArrow(frugal(run), schema)


def cross_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) for each shared token of classes in different components whose sizes fit; postings: token, n, class, component."""
    schema = "a long, b long, na int, nb int"
    types = _arrow_schema(postings.sparkSession, schema)

    def run(batches):
        out: list[list[np.ndarray]] = []

        def flush():
            made = [np.concatenate(x) for x in zip(*out)]
            out.clear()
            a, b, na, nb = made
            swap = a > b
            a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, na, nb)], schema=types)

        for token, n, cls, comp in _runs(batches, 4):
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            for s, e in zip(starts.tolist(), np.append(starts[1:], len(token)).tolist()):
                if e - s < 2 or (comp[s:e] == comp[s]).all():
                    continue
                rn, rc, rk = n[s:e], cls[s:e], comp[s:e]
                for low in range(0, e - s, 256):  # sorted by n: partners stand further on, up to a size
                    block = slice(low, low + 256)
                    reach = int(np.searchsorted(rn, 100 * rn[block][-1] // percent, "right"))
                    i, j = np.nonzero((rk[block, None] != rk[None, low:reach]) & (np.arange(len(rn[block]))[:, None] < np.arange(reach - low)[None, :]) & (100 * rn[block, None] >= percent * rn[None, low:reach]))
                    if len(i):
                        i, j = i + low, j + low
                        out.append([rc[i], rc[j], rn[i], rn[j]])
                        if sum(len(x[0]) for x in out) > 1 << 16:
                            yield flush()
            if out:
                yield flush()

    dealt = postings.repartition("token").sortWithinPartitions("token", "n", "class")
    return dealt.mapInArrow(frugal(run), schema)


def hot_pairs(postings: DataFrame, tokens: DataFrame, percent: int, partners: int = 0, salt: int = 0) -> DataFrame:
    """(a, b, na, nb) of the classes of large runs that can link; postings: token, n, class, component, m (the run's size).

    A run is dealt out by pairs of blocks of BLOCK classes, so no task gets
    it whole.  A block counts the n-grams that its pairs' prefixes share as a
    product of incidence matrices, a stretch of columns at a time, and gives
    only pairs that can reach the threshold, under their least common token.

    partners: only so many partners of each class outside the block's largest
    component, the same ones in all runs, chosen by a salted hash.
    """
    schema = "a long, b long, na int, nb int"
    types = _arrow_schema(postings.sparkSession, schema)
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    rows = postings.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "n", "class", "component")
    rows = rows.join(tokens.select("class", "tokens"), "class").select("token", "x", "y", "own", "n", "class", "component", "tokens")

    def pairs(token, x, y, own, n, cls, comp, lists, sizes):
        _, column, seen = np.unique(lists, return_inverse=True, return_counts=True)
        keep = seen[column] > 1
        row = np.repeat(np.arange(len(n)), sizes)[keep]
        column = np.unique(column[keep], return_inverse=True)[1]
        left, right = (np.flatnonzero(own == z) for z in (x, y))
        shared = np.zeros((len(left), len(right)), np.float32)
        place = np.zeros(len(n), np.int64)
        for low in range(0, int(column.max(initial=-1)) + 1, 2048):  # a vertical fragment of the incidence matrix
            some = (column >= low) & (column < low + 2048)
            parts = []
            for side in (left, right):
                place[:] = -1
                place[side] = np.arange(len(side))
                at = place[row[some]]
                dense = np.zeros((len(side), 2048), np.float32)
                dense[at[at >= 0], (column[some] - low)[at >= 0]] = 1
                parts.append(dense)
            shared += parts[0] @ parts[1].T
        na, nb = n[left][:, None].astype(np.int64), n[right][None, :].astype(np.int64)
        after = np.maximum(-(-percent * na // 100), -(-percent * nb // 100)) - 1
        able = (comp[left][:, None] != comp[right][None, :]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * (shared + after) >= percent * (na + nb))
        if x == y:
            able &= cls[left][:, None] < cls[right][None, :]
        ends = np.cumsum(sizes)
        if partners:
            kinds, many = np.unique(comp, return_counts=True)
            outside = comp != kinds[many.argmax()]
            mixed = (cls.view(np.uint64) ^ np.uint64(salt)) * np.uint64(_M)
            turn = (mixed ^ (mixed >> np.uint64(32))).argsort(kind="stable").argsort(kind="stable").astype(np.float32)
            both = able | able.T if x == y else able
            chosen = np.zeros(able.shape, bool)
            for axis, side, others in ((1, left, right), (0, right, left)):
                score = np.where(both, turn[others][None, :] if axis else turn[others][:, None], np.inf)
                top = np.argsort(score, axis=axis, kind="stable")
                mine = np.zeros(able.shape, bool)
                np.put_along_axis(mine, top[:, :partners] if axis else top[:partners], True, axis=axis)
                chosen |= mine & (outside[side][:, None] if axis else outside[side][None, :])
            able = chosen & both
        for i, j in zip(*np.nonzero(able)):
            i, j = int(left[i]), int(right[j])
            if np.intersect1d(lists[ends[i] - sizes[i] : ends[i]], lists[ends[j] - sizes[j] : ends[j]], assume_unique=True)[0] == token:
                yield (cls[i], cls[j], n[i], n[j]) if cls[i] < cls[j] else (cls[j], cls[i], n[j], n[i])

    def run(batches):
        group, held = None, []

        def close():
            columns = [np.concatenate([h[k] for h in held]) for k in range(6)]
            made = list(pairs(*group, *columns[:4], columns[4], columns[5])) if len(columns[0]) > 1 else []
            held.clear()
            return made

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            if not len(keys):
                continue
            own, n, cls, comp = (batch.column(i).to_numpy() for i in range(3, 7))
            lists = batch.column(7)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            values = lists.flatten().to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            out = []
            for s, e in zip(cuts, cuts[1:]):
                key = tuple(keys[s].tolist())
                if group is not None and key != group:
                    out += close()
                group = key
                held.append((own[s:e], n[s:e], cls[s:e], comp[s:e], values[offsets[s] : offsets[e]], np.diff(offsets[s : e + 1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out), types)], schema=types)
        if held and (out := close()):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out), types)], schema=types)

    return rows.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(frugal(run), schema)


def fragments(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame | None:
    """(class, parts array<array<long>>) of the needed classes' sets, a part for each fragment.

    needed: (id, class).  A bitmap of a fixed number of bits over hashed ids
    tells which texts to read again; what it lets through besides is dropped
    by the joins on class.  None if no class is needed.
    """
    slot = F.pmod(F.xxhash64(F.col("id")), F.lit(_BITMAP))
    words = needed.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).toArrow()
    if not words.num_rows:
        return None
    rows = {k: np.frombuffer(b, np.uint8) for k, b in zip(words["k"].to_pylist(), words["bits"].to_pylist())}
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    schema = "class long, parts array<array<long>>"
    types = _arrow_schema(docs.sparkSession, schema)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias(text_col)).dropna()
    texts = texts.select("id", text_col, F.bitmap_bucket_number(slot).alias("k"), F.bitmap_bit_position(slot).alias("p"))

    def run(batches):
        shingles, bits = Shingler(size), shared.value
        cuts = np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 64) // FRAGMENTS)
        for batch in small_batches(batches, text_col, _BYTES):
            at = [i for i, (k, p) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())) if k in bits and bits[k][p >> 3] >> (p & 7) & 1]
            elements, bounds = shingles(batch.column(1).take(pa.array(at, pa.int64())))
            classes, parts = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                s = elements[a:b]
                classes.append(class_of(s))
                parts.append(np.split(s.view(np.int64), np.searchsorted(s, cuts)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(classes, np.uint64).view(np.int64)), pa.array(parts, types[1].type)], schema=types)

    made = checkpointed(texts.mapInArrow(frugal(run), schema))
    shared.destroy()
    return made


def able(shared, percent: int, na: str = "na", nb: str = "nb"):
    """Whether a pair that shares so many n-grams of its prefixes can link.

    Common n-grams that are not in both prefixes stand behind the prefix that
    ends first, so they are at most the longer of what the prefixes leave.
    """
    after = F.greatest(*(F.ceil(percent * F.col(c) / F.lit(100)) - 1 for c in (na, nb)))
    return (100 + percent) * (shared + after) >= percent * (F.col(na) + F.col(nb))


def bounded(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can still link once their first fragments are compared, with na and nb.

    tokens: (class, n, tokens, below, end).  Up to the last cut that both
    prefixes reach, all common n-grams are among the shared ones; behind it
    there are at most as many as the class with fewer left has.  This is a
    partial overlap and a bound on the other fragments.
    """
    side = lambda c: tokens.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}"), F.col("below").alias(f"b{c}"), F.col("end").alias(f"e{c}"))
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").withColumn("cut", F.least("ea", "eb"))
    low = -(1 << 63)
    values = F.array(*(F.lit(v) for v in (low, *(k * _CUT + low for k in range(1, _CUTS + 1)), (1 << 63) - 1)))
    met = met.withColumn("upto", F.get(values, F.col("cut")))
    known = F.size(F.filter(F.array_intersect("ta", "tb"), lambda x: x <= F.col("upto")))
    rest = F.least(*(F.col(f"n{c}") - F.get(F.col(f"b{c}"), F.col("cut")) for c in "ab"))
    return met.filter((100 + percent) * (known + rest) >= percent * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")


def verified(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that link, by partial overlaps of each fragment, summed: (a, b)."""
    side = lambda c: parts.select(F.col("class").alias(c), F.col("parts").alias(f"p{c}"))
    overlaps = F.zip_with("pa", "pb", lambda x, y: F.size(F.array_intersect(x, y)))
    overlap = F.aggregate(overlaps, F.lit(0), lambda x, y: x + y)
    linked = pairs.join(side("a"), "a").join(side("b"), "b").filter((100 + percent) * overlap >= percent * (F.col("na") + F.col("nb")))
    return linked.select("a", "b")  # a text that stands twice under one id has its parts, and so its links, twice


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(id, n, class, component, least) of every row: component is a class of it, least its least id; null without an id or words."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(frequent(docs, id_col, text_col, size))
    rows = checkpointed(records(docs, order, id_col, text_col, size, percent))
    order.destroy()
    with_id = rows.filter("id IS NOT NULL AND n > 0")
    # Copies are one class from here on, so a group of them makes no run.
    classes = checkpointed(with_id.groupBy("class").agg(F.min(F.struct("id", "n", "below", "end", "prefix")).alias("r")).select("class", "r.*"))
    shared = checkpointed(first_pairs(classes.select(F.explode("prefix").alias("token"), "n", "class"), percent))
    tokens = shared.groupBy("class").agg(F.collect_list("token").alias("tokens"))  # at most a prefix each
    tokens = checkpointed(tokens.join(classes.select("class", "n", "below", "end"), "class"))
    have, compared = [], []

    def linked(pairs):
        """The pairs (a, b) that link; texts of classes not met before are read again."""
        pairs = checkpointed(bounded(pairs, tokens, percent))
        ends_of = lambda p: p.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        ends = ends_of(pairs)
        if compared:
            ends = ends.join(ends_of(reduce(DataFrame.unionByName, compared)), "class", "left_anti")
        compared.append(pairs.select("a", "b"))
        parts = fragments(docs, classes.select("class", "id").join(ends, "class", "left_semi"), id_col, text_col, size)
        if parts is not None:
            have.append(parts)
        if not have:
            return pairs.select("a", "b")
        return verified(pairs, reduce(DataFrame.unionByName, have), percent)

    partners = shared.select("class", F.explode(F.array("by_size", "by_head", "by_least")).alias("b")).filter("class != b")
    near = components(linked(partners.select(F.least("class", "b").alias("a"), F.greatest("class", "b").alias("b")).distinct()))

    for salt in (*range(1, ROUNDS + 1), 0):  # the last round makes every pair that is left
        left = shared.select("token", "n", "class").join(near.withColumnRenamed("node", "class"), "class", "left")
        left = left.select("token", "n", "class", F.coalesce("component", "class").alias("component"))
        runs = left.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 != c1").select("token", "m")
        left = checkpointed(left.join(runs, "token"))
        if salt:
            made = hot_pairs(left.filter(F.col("m") > HOT_RUN), tokens, percent, PARTNERS, salt).select("a", "b").distinct()
        else:
            small = checkpointed(cross_pairs(left.filter(F.col("m") <= HOT_RUN).drop("m"), percent).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared")))
            hot = left.filter(F.col("m") > HOT_RUN)
            # A pair may meet in small runs and in large ones: only of pairs that meet in small runs alone is the count whole.
            warm = hot.select("class").distinct().withColumn("warm", F.lit(True))
            flag = lambda c: warm.withColumnsRenamed({"class": c, "warm": f"w{c}"})
            flagged = small.join(flag("a"), "a", "left").join(flag("b"), "b", "left")
            whole = flagged.filter(able(F.col("shared"), percent) | (F.col("wa") & F.col("wb")))
            made = whole.select("a", "b").unionByName(hot_pairs(hot, tokens, percent).select("a", "b")).distinct()
        more = linked(made)
        stars = near.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        near = components(stars.unionByName(more))

    grouped = classes.select("class", "id").join(near.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = grouped.groupBy("component").agg(F.min("id").alias("least"))
    named = checkpointed(grouped.join(least, "component").select("class", "component", "least"))
    met = rows.join(named, "class", "left")
    linked_row = F.col("id").isNotNull() & (F.col("n") > 0)
    return met.select("id", "n", "class", *(F.when(linked_row, F.col(c)).alias(c) for c in ("component", "least")))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    found = clusters(docs, id_col, text_col, size, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _unused(columns: list[str], stem: str) -> str:
    """A name like stem that no column has."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that of the least id, with all columns; rows without words or id stay.

    Of several rows with that id and text the least stays, by all columns that
    can be ordered, in their order, nulls first.
    """
    found = clusters(docs, id_col, text_col, size, percent)
    tag, head_id, head_class = (_unused(docs.columns, x) for x in ("__tag", "__head_id", "__head_class"))
    heads = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("id", "class")).alias("h")).select(F.col("h.id").alias(head_id), F.col("h.class").alias(head_class))

    def run(batches):
        shingles = Shingler(size)
        for batch in small_batches(batches, text_col, _BYTES):
            elements, bounds = shingles(batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()))
            classes = [class_of(elements[a:b]) if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            tags = pa.array([None if c is None else c - (1 << 64) if c >> 63 else c for c in classes], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, tags], names=[*batch.schema.names, tag])

    quoted = lambda c: f"`{c.replace('`', '``')}`"
    tagged = docs.mapInArrow(frugal(run), StructType([*docs.schema.fields, StructField(tag, LongType())]))
    loose = F.col(tag).isNull() | F.col(quoted(id_col)).isNull()
    kept = tagged.filter(~loose).join(heads.hint("shuffle_hash"), (F.col(quoted(id_col)).cast("long") == F.col(head_id)) & (F.col(tag) == F.col(head_class)), "left_semi")
    columns = [F.col(quoted(c)) for c in docs.columns]
    ordered = [F.col(quoted(f.name)) for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    once = kept.groupBy(F.col(quoted(id_col)).alias(head_id), F.col(tag).alias(head_class)).agg(F.min_by(F.struct(*columns), F.struct(*ordered)).alias(tag)).select(f"{tag}.*")
    return once.unionByName(tagged.filter(loose).select(*columns))
