"""Byte-level BPE encoding and decoding by Spark higher-order functions.

Encoding runs in three steps, with one shuffle after the first:

1. texts are cut into the pieces of the tokenizer's pattern; each task numbers
   its distinct pieces (words) and hands new ones on with every batch of
   texts, which are then lists of word numbers.  A word is handed on as its
   byte array with one character a byte, that of the byte's id, followed by
   what its neighbouring bytes merge to; a word of the vocabulary (below) is
   handed on as READY and its token characters.  Batches go by a shuffle, each
   task's together and in order: so no Spark task keeps two Python workers, and
   the fold's garbage and the word lists aren't in memory together;
2. Spark folds the ranked merges over the bytes of each distinct word: the
   state is the string of token characters and the string of the characters
   that neighbouring pairs merge to.  Characters are in the order of ranks, so
   a step takes the least one, leftmost, puts it in the pair's place and looks
   up the two pairs that this changes.  The rank map is a literal, the value
   of a one-row scalar subquery, whose size is that of the rank file;
3. word numbers are replaced by the words' ids.

Decoding maps ids to their binary pieces by an array literal and joins them.

Most words of a task are words of other tasks, too.  Of a table of more than
SAMPLE_ROWS rows, about so many are therefore cut first (SAMPLE_CHARS of each at
most), their words counted by a shuffle, and the VOCABULARY commonest ones folded,
by the same fold, once and broadcast.  Which words these are changes the work
only: all others are folded in their tasks.  The given rows are read three times:
counted, sampled and encoded.

A task's word list holds at most MEMO words; then it starts anew.  Words of
more than LONG_WORD bytes (runs without any boundary) are merged by a heap in
step 3, in n log n time instead of n squared; the result is the same.

Cases: a null or empty text has no tokens and decodes to no bytes.  Repeated
rows are encoded each.  Empty tables give empty results; other columns are
ignored.  Texts are encoded whole; special tokens' strings are ordinary text.
Rank files of up to 55,000 tokens can be used.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import _arrow_schema, frugal, small_batches

BUCKETS = 1 << 17
LONG_WORD = 256
MEMO = 400_000
BATCH_BYTES = 1 << 20  # of text in a batch, which is a row with its new words
SAMPLE_ROWS, SAMPLE_CHARS = 24_000, 1 << 15
VOCABULARY, VOCABULARY_BYTES = 1 << 19, 32  # words, and bytes of the longest
DEALS = 64  # in which the vocabulary is folded
_FIRST = 32
_NONE = "\uffff"  # no token; behind all characters
READY = "\x01"  # before a word's token characters; before all characters
NEXT = "\x02"  # between words as they are handed on


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def character(rank: int) -> str:
    """A token's character; their order is that of ranks."""
    if rank > 55_000:
        raise ValueError("rank files of up to 55,000 tokens can be used")
    return chr(rank + _FIRST)


def pair_characters(ranks: dict[bytes, int]) -> dict[str, str]:
    """The character that each mergeable pair of token characters merges to."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):  # every pair of tokens that makes up this one
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[character(left) + character(right)] = character(rank)
    return pairs


class Handing:
    """Words as fold takes them: the characters of their bytes, then those that neighbouring bytes merge to."""

    def __init__(self, ranks: dict[bytes, int]):
        self.letters = np.array([ord(c) for c in letters(ranks)], np.uint16)
        self.pairs = np.full(1 << 16, ord(_NONE), np.uint16)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = ord(character(rank))

    def __call__(self, words: list[bytes]) -> list[str]:
        """For words of at least one byte each."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(2 * n - 1)
        own = np.repeat(ends - (2 * n - 1) - (np.cumsum(n) - n), n) + np.arange(len(raw))
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint16)
        out[own] = self.letters[raw]
        inner = np.ones(len(raw), bool)
        inner[np.cumsum(n) - 1] = False  # a word's last byte begins no pair
        first = np.flatnonzero(inner)
        out[own[first] + np.repeat(n, n)[first]] = self.pairs[raw[first].astype(np.int64) << 8 | raw[first + 1]]
        text = out.astype("<u2").tobytes().decode("utf-16-le")
        bounds = [0, *ends.tolist()]
        return [text[a:b] for a, b in zip(bounds, bounds[1:])]


def letters(ranks: dict[bytes, int]) -> list[str]:
    """The character of each byte's token."""
    return [character(ranks[bytes([b])]) for b in range(256)]


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal: array<string> of buckets by hash of the pair's two characters (Spark's xxhash64, seed 42).

    A bucket begins with _NONE and lists each of its pairs, what the pair
    merges to, and _NONE.
    """
    import xxhash

    buckets = [_NONE] * BUCKETS
    for pair, to in pair_characters(ranks).items():
        buckets[xxhash.xxh64_intdigest(pair.encode(), 42) & (BUCKETS - 1)] += f"{pair}{to}{_NONE}"
    types = _arrow_schema(spark, "ranks array<string>")
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([buckets], types[0].type)], schema=types)).scalar()


def piece_table(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """Pieces by id, in hex."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    types = _arrow_schema(spark, "pieces array<string>")
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([pieces], types[0].type)], schema=types)).scalar()


def _bind(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fold(word: Column, table: Column) -> Column:
    """Token characters of a word: ranked merges folded over its bytes.

    word: the characters of its bytes, followed by those that each pair of
    neighbouring bytes merges to.
    """

    def merged(pair):
        bucket = F.get(table, F.xxhash64(pair).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        behind = F.call_function("substring_index", bucket, F.concat(F.lit(_NONE), pair), F.lit(-1))
        return F.substring(behind, 1, 1)  # of a bucket without the pair, this is _NONE

    def state(tokens, pairs):
        return _bind(pairs, lambda r: F.struct(tokens.alias("tokens"), r.alias("pairs"), F.array_min(F.split(r, "")).alias("least")))

    n = F.floor((F.length(word) + 1) / 2).cast("int")

    def merge(acc, i):
        """i: the 1-based place of the pair with the least rank."""
        t, r, new = acc["tokens"], acc["pairs"], acc["least"]
        before = F.when(i > 1, merged(F.concat(F.substring(t, i - 1, F.lit(1)), new))).otherwise("")
        after = F.when(i < F.length(r), merged(F.concat(new, F.substring(t, i + 2, F.lit(1))))).otherwise("")
        return state(F.overlay(t, new, i, F.lit(2)), F.overlay(r, F.concat(before, after), i - 1, F.lit(3)))

    def step(acc, _):
        done = (acc["least"] == _NONE) | (acc["least"] == "")
        return F.when(done, acc).otherwise(_bind(F.instr(acc["pairs"], acc["least"]), lambda i: merge(acc, i)))

    start = state(F.substring(word, F.lit(1), n), F.substring(word, n + 1, n))
    return F.when(n < 2, word).otherwise(F.aggregate(F.sequence(F.lit(2), n), start, step, lambda acc: acc["tokens"]))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges by a heap of (rank, position) over a linked list."""
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    live = [True] * n

    def pair(i):
        j = ends[i]
        return ranks.get(word[i : ends[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not live[i] or ends[i] >= n or ends[ends[i]] != end:
            continue  # one of its tokens has changed
        j = ends[i]
        live[j] = False
        ends[i] = ends[j]
        if ends[i] < n:
            before[ends[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k, ends[ends[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


#: The tokenizers' pattern for texts of code points below U+0250, whose letters, numbers and white space are listed; it is faster to match.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def cutter() -> Callable[[str], list[str]]:
    """The tokenizers' pattern as a function from a text to its pieces."""
    import public_tokenizers
    import regex

    any_script = regex.compile(public_tokenizers.PATTERN).findall
    latin, beyond = re.compile(_LATIN).findall, re.compile("[^\x00-\u024f]").search
    return lambda text: any_script(text) if beyond(text) else latin(text)


class Numbers(dict):
    """Numbers of words, by first appearance; new: those that came since it was emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Pieces:
    """Binary pieces by id."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.by_id = pa.array(by_id, pa.large_binary())

    def joined(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """For each stretch of ids between bounds, its pieces concatenated."""
        _, ends, data = self.by_id.take(pa.array(ids)).buffers()  # laid end to end
        offsets = np.frombuffer(ends, np.int64)[: len(ids) + 1][bounds]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), data])


def packed(numbers: np.ndarray) -> bytes:
    """int32 numbers for the shuffle: their first bytes, second bytes and so on, compressed."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes, codec="zstd", asbytes=True) if len(numbers) else b""


def unpacked(data: pa.Buffer, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int32)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


_NUMBERED = "ids array<long>, counts array<int>, numbers binary, words string, fresh boolean, task int, place int"


class Vocabulary:
    """Words whose tokens are known, found by hash and compared."""

    def __init__(self, words: pa.Array, tokens: pa.Array):
        hashes = self.hashes_of(words.to_pylist())
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.words, self.tokens = hashes[order], words.take(order), tokens.take(order)

    @staticmethod
    def hashes_of(words: list[bytes]) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))

    def __call__(self, words: list[bytes]) -> list[str | None]:
        """READY and the tokens of each word that is here."""
        if not len(self.hashes):
            return [None] * len(words)
        at = pa.array(np.searchsorted(self.hashes, self.hashes_of(words)).clip(max=len(self.hashes) - 1))
        same = pc.equal(self.words.take(at), pa.array(words, self.words.type))
        return self.tokens.take(pc.if_else(same, at, None)).to_pylist()


def vocabulary(texts: DataFrame, path: str) -> Vocabulary | None:
    """The commonest words of about SAMPLE_ROWS of the texts (the frame's one column); None for a table of no more rows."""
    total = texts.count()
    if total <= SAMPLE_ROWS:
        return None
    spark, column = texts.sparkSession, texts.columns[0]
    schema = "word binary, handed string, times long"
    types = _arrow_schema(spark, schema)

    def count(batches):
        cut, own = cutter(), read_ranks(path)
        handing, times = Handing(own), Counter()

        def counted():
            found = [(b, n) for w, n in times.items() if len(b := w.encode("utf-8")) <= VOCABULARY_BYTES and b not in own]
            words = [b for b, _ in found]
            return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip((words, handing(words), [n for _, n in found]), types)], schema=types)

        for batch in small_batches(batches, column):
            for text in batch.column(0).to_pylist():
                times.update(cut(text) if text else [])
            if len(times) > MEMO:
                yield counted()
                times.clear()
        yield counted()

    sampled = texts.sample(SAMPLE_ROWS / total, seed=7).select(F.substring(column, 1, SAMPLE_CHARS).alias(column))
    counts = sampled.mapInArrow(frugal(count), schema).groupBy("word", "handed").agg(F.sum("times").alias("times"))
    common = counts.orderBy(F.desc("times"), "word").limit(VOCABULARY).withColumn("deal", F.pmod(F.xxhash64("word"), F.lit(DEALS)))
    dealt = common.repartition(DEALS, "deal").groupBy("deal").agg(F.collect_list(F.struct("word", "handed")).alias("words"))  # a row's copy of the ranks serves many words
    tokens = F.transform("words", lambda w: F.struct(w["word"].alias("word"), F.concat(F.lit(READY), fold(w["handed"], F.col("ranks"))).alias("tokens")))
    folded = dealt.withColumn("ranks", rank_table(spark, read_ranks(path))).select(F.inline(tokens)).toArrow()
    return Vocabulary(folded["word"].combine_chunks(), folded["tokens"].combine_chunks())


def numbered_words(rows: DataFrame, path: str) -> DataFrame:
    """Of rows (id, text) the texts as lists of word numbers, with the words that are new in each batch, as they are handed on.

    task and place: which task made the batch, and as its how many-th; fresh: its word list starts here.  A
    task's batches stand together and in order.
    """
    types, text_col = _arrow_schema(rows.sparkSession, _NUMBERED), rows.columns[1]
    common = vocabulary(rows.select(text_col), path)
    shared = None if common is None else rows.sparkSession.sparkContext.broadcast(common)

    def number(batches):
        cut, own = cutter(), read_ranks(path)
        handing = Handing(own)

        def shown(words: list[bytes]) -> list[str]:
            """Words as they are handed on; one that is a token itself is its one character."""
            found = [None if r is None else character(r) for r in map(own.get, words)]
            if shared:
                rest = [k for k, f in enumerate(found) if f is None]
                for k, ready in zip(rest, shared.value([words[k] for k in rest])):
                    found[k] = ready
            folded = iter(handing([w for w, f in zip(words, found) if f is None]))
            return [next(folded) if f is None else f for f in found]

        known, task = Numbers(), TaskContext.get().partitionId()
        for place, batch in enumerate(small_batches(batches, text_col, BATCH_BYTES)):
            fresh = not place or len(known) > MEMO
            if fresh:
                known.clear()
            counts, numbers = [], [np.zeros(0, np.int32)]
            for text in batch.column(1).to_pylist():
                words = cut(text) if text else []
                counts.append(len(words))
                numbers.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            words = shown([w.encode("utf-8") for w in known.new])
            known.new.clear()
            row = batch.column(0).to_pylist(), counts, packed(np.concatenate(numbers)), NEXT.join(words) or None, fresh, task, place
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, types)], schema=types)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a task's batches go to the partition of its number: evenly, where hashes would meet
    met = rows.mapInArrow(frugal(number), _NUMBERED).repartitionById(parts, "task").sortWithinPartitions("task", "place")
    return met.withColumn("words", F.coalesce(F.split("words", NEXT), F.array().cast("array<string>")))  # joined, a batch takes less of the shuffle


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) of every row; decoded adds what the ids decode to (binary), their pieces concatenated in the same pass."""
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    table = rank_table(spark, read_ranks(path))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias(text_col))

    def tokens_of(word):
        ready = F.substring(word, F.lit(len(READY) + 1), F.length(word))
        return F.when(F.startswith(word, F.lit(READY)), ready).when(F.length(word) < 2 * LONG_WORD, fold(word, F.col("ranks")))

    short = F.transform("words", tokens_of)
    long_words = F.filter("words", lambda w: F.length(w) >= 2 * LONG_WORD)
    folded = numbered_words(rows, path).withColumn("ranks", table).select("ids", "counts", "numbers", short.alias("tokens"), long_words.alias("long_words"), "fresh")
    out_schema = f"{id_col} long, ids array<int>" + (", decoded binary" if decoded else "")
    out_types = _arrow_schema(spark, out_schema)

    def resolve(batches):
        table_of, pieces = None, None
        flat, sizes = [], []  # ids of the words of the task that made the batch
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                if row.column(5)[0].as_py():
                    flat, sizes = [], []
                tokens = row.column(3).flatten()
                n = pc.fill_null(pc.utf8_length(tokens), 0).to_numpy().astype(np.int64)
                values = np.frombuffer("".join(pc.fill_null(tokens, "").to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int32) - _FIRST
                if tokens.null_count:
                    if table_of is None:
                        table_of = read_ranks(path)
                        byte_of = {c: b for b, c in enumerate(letters(table_of))}
                    words = (bytes(map(byte_of.__getitem__, w[: (len(w) + 1) // 2])) for w in row.column(4).flatten().to_pylist())
                    merged = iter([np.array(merge_long(w, table_of), np.int32) for w in words])
                    parts = np.split(values, np.cumsum(n)[:-1])
                    parts = [p if ok else next(merged) for p, ok in zip(parts, tokens.is_valid().to_pylist())]
                    n, values = np.array([len(p) for p in parts], np.int64), np.concatenate(parts)
                flat.append(values)
                sizes.append(n)
                if len(flat) > 1:
                    flat, sizes = [np.concatenate(flat)], [np.concatenate(sizes)]
                size, value = sizes[0], flat[0]
                start = np.cumsum(size) - size
                counts = row.column(1).flatten().to_numpy()
                numbers = unpacked(row.column(2)[0].as_buffer(), int(counts.sum(dtype=np.int64)))
                each = size[numbers]
                ends = np.cumsum(each)
                ids = value[np.arange(int(each.sum())) + np.repeat(start[numbers] - (ends - each), each)]
                bounds = np.cumsum(counts)
                offsets = np.concatenate([[0], np.concatenate([[0], ends])[bounds]]).astype(np.int32)
                columns = [row.column(0).flatten().cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)).cast(out_types[1].type)]
                if decoded:
                    pieces = pieces or Pieces(read_ranks(path))
                    columns.append(pieces.joined(ids, offsets).cast(out_types[2].type))
                yield pa.RecordBatch.from_arrays(columns, schema=out_types)

    return folded.mapInArrow(frugal(resolve), out_schema)


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The rows with a column decoded (binary): the binary pieces of their ids, joined."""
    pieces = piece_table(encoded.sparkSession, read_ranks(tokenizer or default_tokenizer()))
    joined = F.unhex(F.array_join(F.transform("ids", lambda i: F.get(F.col("__pieces"), i)), ""))
    return encoded.withColumn("__pieces", pieces).withColumn("decoded", joined).drop("__pieces")


def digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The query's columns of (id, ids, decoded)."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
