"""Toxicity by class-conditional Kneser-Ney models.

Two character models of order N over the words of labelled documents, one of
the toxic and one of the ordinary ones, are interpolated with absolute
discounting (modified Kneser-Ney: discounts for counts of one, two and more,
estimated from the counts of counts).  Both back off to the same lower-order
model, made of continuation counts of the two classes together, so that an
expression which is rare in either class gets nearly the same likelihood from
both.

A word's log-likelihood ratio is the sum over its characters.  For an n-gram
seen in neither class the shared backoff cancels out and only the contexts'
backoff weights remain, so a scorer needs two tables: ratio by n-gram and
ratio by context.  The smaller class backs off more, whatever it has seen, so
these weights count only where they speak against toxicity: unknown words are
not toxic for being unknown.  Counting, backoff and ratios are made by DataFrame
aggregations over all labelled training documents.  The ratios are kept by
exact n-gram, 36 bytes for each distinct one, and nothing is merged.  They are
counted first: up to PIECE of them go to the workers at once.  More are cut by
context into pieces of about PIECE, and one piece at a time goes over the
distinct words of the documents, whose ratios are sums over the pieces; the
ratios of the FREQUENT commonest words then go to the workers, those of the
others are joined to the documents that hold them.  Both ways give the same
scores (but for the order of sums).

A document's features are the difference of its two log-likelihoods a
character, and, for a few toxic words in a long text, the ratios in excess of
EXCESS nats a word over the number of words and its root, and the highest
ones.  A logistic calibration of these is fitted on at most CALIBRATION_ROWS
labelled documents (chosen by a hash of the id), each scored by tables counted
without its own half of the training documents.

Training rows are those whose crc32(id as text) mod 3 is not 1; nothing is
learned from another row's label.  Labels, lang, source and the id never enter
a score.

Cases: a null or empty text has no words and gets the score of zero features.
Labels without a document are ignored; of several labels of one document the
highest counts; null labels are ignored.  Where the training rows have words
of one class only, the score is the share of toxic ones among them (0 without
any).  Repeated documents count as often as they stand.  An empty table gives
an empty result.  Other columns are ignored.  Texts are read whole.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import _arrow_schema, checkpoint_dir, checkpointed, delete, frugal, map_rows, saved, small_batches

N = 5
TABLES = ("0", "1", "both")  # counted from the training documents of half 0, of half 1, of both
SHARED_DISCOUNT = 0.75
EXCESS = 3.0
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.7
MEMO = 100_000
PIECE = 1 << 21  # n-grams that go to a worker at once: 72 MB
FREQUENT = 1 << 17  # words whose ratios go to a worker at once
SHORT = 40  # characters of such a word

_WORD = re.compile(r"[^\W\d_]+")
_PAD, _END = "\x02", "\x03"
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def n_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with padding; the last position of each n-gram; the number of n-grams of each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    points = np.frombuffer("".join(f"{_PAD * (N - 1)}{w}{_END}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(sizes + N - 1) - sizes
    ends = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return points, ends, sizes


class Ratios:
    """Ratios by n-gram, a row for each of TABLES: sorted hashes, each with the code points it stands for, which every lookup compares."""

    def __init__(self, grams: pa.ChunkedArray, ratio: np.ndarray, n: int):
        self.n, self.seed = n, 0
        chunks = [np.frombuffer("".join(c.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32) for c in grams.chunks]
        points = np.concatenate([np.zeros(0, np.uint32), *chunks])
        high, low = self._packed(points, np.arange(n - 1, len(points), n))
        while True:  # a seed that tells all n-grams apart
            hashes = self._hashes(high, low)
            order = np.argsort(hashes)
            hashes = hashes[order]
            if not (hashes[1:] == hashes[:-1]).any():
                break
            self.seed += 1
        self.hashes, self.high, self.low, self.ratio = hashes, high[order], low[order], np.ascontiguousarray(np.asarray(ratio, np.float32)[:, order])

    def _packed(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n characters that end at each position, 21 bits each: three in one number, the rest in another."""
        packed = [np.zeros(len(ends), np.uint64), np.zeros(len(ends), np.uint64)]
        for k in range(self.n):
            packed[k > 2] = packed[k > 2] << np.uint64(21) | points[ends - (self.n - 1 - k)].astype(np.uint64)
        return packed[0], packed[1]

    def _hashes(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        h = (high + np.uint64(self.seed)) * np.uint64(_MIX[0])
        h = ((h ^ h >> np.uint64(29)) + low) * np.uint64(_MIX[1])
        return h ^ h >> np.uint64(32)

    def of(self, points: np.ndarray, ends: np.ndarray, table: int) -> np.ndarray:
        """The table's ratio of the n characters that end at each position, NaN for those it has never seen."""
        if not len(self.hashes):
            return np.full(len(ends), np.nan, np.float32)
        high, low = self._packed(points, ends)
        at = np.minimum(np.searchsorted(self.hashes, self._hashes(high, low)), len(self.hashes) - 1)
        return np.where((self.high[at] == high) & (self.low[at] == low), self.ratio[table][at], np.float32(np.nan))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic 0/1, half 0/1, id) of labelled training documents.  Few labels a partition are hashed; texts are not sorted."""
    named = labels.select(F.col(id_col).cast("long").alias("__label_id"), F.col("toxic").cast("int").alias("__toxic")).dropna().groupBy("__label_id").agg(F.max("__toxic").alias("__toxic"))
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), fold.alias("fold")).filter("fold != 1")
    return rows.join(named.hint("shuffle_hash"), rows.id == named["__label_id"]).select("text", F.col("__toxic").alias("toxic"), (F.col("fold") == 2).cast("int").alias("half"), "id")


def count_n_grams(rows: DataFrame) -> DataFrame:
    """gram, c_00, c_01, c_10, c_11: occurrences by class and half; for the empty gram, the numbers of documents."""
    schema = "gram string, c_00 long, c_01 long, c_10 long, c_11 long"
    types = _arrow_schema(rows.sparkSession, schema)

    def table(counts, documents):
        grams: list[dict[str, int]] = []
        for c in counts:
            one: dict[str, int] = {}
            for word, k in c.items():
                padded = f"{_PAD * (N - 1)}{word}{_END}"
                for i in range(len(padded) - N + 1):
                    g = padded[i : i + N]
                    one[g] = one.get(g, 0) + k
            grams.append(one)
        for one, n in zip(grams, documents):
            one[""] = n
        documents[:] = [0] * 4
        keys = list(set().union(*grams))
        return pa.RecordBatch.from_arrays([pa.array(keys, types[0].type), *(pa.array([g.get(k, 0) for k in keys], types[1].type) for g in grams)], schema=types)

    def run(batches):
        counts, documents = [Counter() for _ in range(4)], [0] * 4
        for batch in small_batches(batches, "text"):
            for text, toxic, half in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts[2 * (toxic > 0) + half].update(words_of(text))
                documents[2 * (toxic > 0) + half] += 1
            if sum(map(len, counts)) > 2 * MEMO:
                yield table(counts, documents)
                counts = [Counter() for _ in range(4)]
        yield table(counts, documents)

    parts = rows.select("text", "toxic", "half").mapInArrow(frugal(run), schema)
    return parts.groupBy("gram").agg(*(F.sum(f"c_{x}").alias(f"c_{x}") for x in ("00", "01", "10", "11")))


def shared_backoff(grams: DataFrame) -> DataFrame:
    """(low, p_low): Kneser-Ney probability of order N - 1 from the continuation counts of both classes together."""
    levels = []
    distinct = grams.select("gram")
    for n in range(N - 1, 0, -1):
        level = distinct.groupBy(F.substring("gram", 2, n).alias("low")).agg(F.count(F.lit(1)).alias("k"))
        levels.append(level)
        distinct = level.select(F.col("low").alias("gram"))
    levels = [checkpointed(x) if i == 0 else x for i, x in enumerate(levels)]
    below = None
    for n, level in zip(range(1, N), reversed(levels)):
        own = level.withColumn("ctx", F.substring("low", 1, n - 1))
        sums = own.groupBy("ctx").agg(F.sum("k").alias("den"), F.sum(F.least(F.col("k"), F.lit(SHARED_DISCOUNT))).alias("mass"), F.count(F.lit(1)).alias("kinds"))
        joined = own.join(sums, "ctx")
        if below is None:
            p_below = 1 / F.col("kinds")
        else:
            joined = joined.withColumn("next", F.substring("low", 2, n - 1)).join(below.withColumnsRenamed({"low": "next", "p_low": "p_next"}), "next")
            p_below = F.col("p_next")
        below = joined.select("low", ((F.greatest(F.col("k") - SHARED_DISCOUNT, F.lit(0.0)) + F.col("mass") * p_below) / F.col("den")).alias("p_low"))
    return below


def count_columns() -> dict[str, Column]:
    """Of each of TABLES and each class (1 toxic, 0 ordinary), the count of an n-gram."""
    by_half = {f"{x}_{h}": F.col(f"c_{x}{h}") for x in (1, 0) for h in (0, 1)}
    return by_half | {f"{x}_both": by_half[f"{x}_0"] + by_half[f"{x}_1"] for x in (1, 0)}


def discounts(grams: DataFrame) -> dict[str, tuple[float, float, float]]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, for each count column."""
    columns = count_columns()
    n = grams.agg(*(F.count_if(c == k).alias(f"{name}:{k}") for name, c in columns.items() for k in (1, 2, 3, 4))).head()
    found = {}
    for name in columns:
        n1, n2, n3, n4 = (n[f"{name}:{k}"] for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        found[name] = tuple(min(float(k), max(0.1, k - (k + 1) * y * more / few)) if few else 0.75 * k for k, few, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
    return found


def ratios(grams: DataFrame, low: DataFrame, discount: dict[str, tuple[float, float, float]]) -> tuple[DataFrame, DataFrame]:
    """(gram, r_0, r_1, r_both) of n-grams and of contexts, in one aggregation; null where a table lacks the n-gram."""
    columns = count_columns()
    own = grams.select("gram", F.substring("gram", 1, N - 1).alias("ctx"), F.substring("gram", 2, N - 1).alias("low"), *(c.alias(f"n{name}") for name, c in columns.items()))

    def off(name):
        c, (one, two, more) = F.col(f"n{name}"), discount[name]
        return F.when(c <= 0, 0.0).when(c == 1, one).when(c == 2, two).otherwise(more)

    sums = own.groupBy("ctx").agg(*(f for x in columns for f in (F.sum(f"n{x}").alias(f"den{x}"), F.sum(off(x)).alias(f"mass{x}"))))

    def weight(x):
        return F.when(F.col(f"den{x}") > 0, F.col(f"mass{x}") / F.col(f"den{x}")).otherwise(F.lit(1.0))

    def p(x):
        seen = F.when(F.col(f"den{x}") > 0, (F.col(f"n{x}") - off(x)) / F.col(f"den{x}")).otherwise(F.lit(0.0))
        return seen + weight(x) * F.col("p_low")

    by_gram = own.join(sums, "ctx").join(low, "low").select("gram", *(F.when(F.col(f"n1_{t}") + F.col(f"n0_{t}") > 0, F.ln(p(f"1_{t}") / p(f"0_{t}"))).alias(f"r_{t}") for t in TABLES))
    by_context = sums.select(F.col("ctx").alias("gram"), *(F.when(F.col(f"den1_{t}") + F.col(f"den0_{t}") > 0, F.ln(weight(f"1_{t}") / weight(f"0_{t}"))).alias(f"r_{t}") for t in TABLES))
    return by_gram, by_context


def ratio_table(rows: DataFrame, n: int) -> Ratios:
    """The ratios by exact n-gram; the caller sees to it that there are about PIECE at most."""
    got = rows.select("gram", *(F.col(f"r_{t}").cast("float").alias(t) for t in TABLES)).toArrow()
    return Ratios(got["gram"], np.stack([got[t].to_numpy() for t in TABLES]), n)


def word_ratios(words: list[str], by_gram: Ratios, by_context: Ratios, table: int = 2) -> np.ndarray:
    points, ends, sizes = n_grams(words)
    seen = by_gram.of(points, ends, table)
    context = by_context.of(points, ends - 1, table)
    each = np.where(np.isnan(seen), np.minimum(np.nan_to_num(context), 0), seen)
    return np.add.reduceat(each, np.cumsum(sizes) - sizes, dtype=np.float64)


def features(memo: dict[str, float], words: list[str]) -> list[float]:
    if not words:
        return [0.0] * 5
    v = np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
    excess = float(np.maximum(v - EXCESS, 0).sum())
    difference = float(v.sum()) / (len("".join(words)) + len(v))
    return [difference, excess / len(v), excess / len(v) ** 0.5, float(np.log1p(excess)), float(min(max(v.max(), 0.0), 20.0))]


def feature_maker(tables, table: int = 2):
    memo: dict[str, float] = {}

    def of(texts):
        lists = [words_of(t) for t in texts]
        new = list(set().union(*lists).difference(memo))
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(set().union(*lists))
        if new:
            memo.update(zip(new, word_ratios(new, *tables, table).tolist()))
        return [features(memo, w) for w in lists]

    return of


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps on standardised features: (mean, scale, weights with the intercept last)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.diag([*[1e-2] * x.shape[1], 1e-6])
        step = np.linalg.solve(hessian, z.T @ (y - p) - ridge * len(x) * np.array([*[1e-2] * x.shape[1], 1e-6]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


class Pieces:
    """Ratios cut by context: a piece holds the n-grams of its contexts and the contexts themselves."""

    def __init__(self, by_gram: DataFrame, by_context: DataFrame, number: int):
        self.number = number
        self.by_gram, self.by_context = (saved(t.withColumn("piece", F.pmod(F.xxhash64(F.substring("gram", 1, N - 1)), F.lit(number)))) for t in (by_gram, by_context))

    def tables(self, piece: int) -> tuple[Ratios, Ratios]:
        return ratio_table(self.by_gram.filter(F.col("piece") == piece), N), ratio_table(self.by_context.filter(F.col("piece") == piece), N - 1)


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n) over all texts."""
    types = _arrow_schema(rows.sparkSession, "word string, n long")

    def run(batches):
        counts: Counter = Counter()
        for batch in small_batches(batches, "text"):
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
            if len(counts) > MEMO:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), types[0].type), pa.array(list(counts.values()), types[1].type)], schema=types)
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), types[0].type), pa.array(list(counts.values()), types[1].type)], schema=types)

    return rows.select("text").mapInArrow(frugal(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, n, v_0, v_1, v_both): the ratio of each distinct word by each of TABLES, a piece after the other."""
    spark, folder = rows.sparkSession, f"{checkpoint_dir(rows.sparkSession)}/words-{uuid.uuid4()}"
    names = [f"v_{t}" for t in TABLES]
    words = count_words(rows).select("word", "n", *(F.lit(0.0).alias(v) for v in names))

    def add(shared):
        def run(batches):
            for batch in small_batches(batches, "word"):
                found = batch.column(0).to_pylist()
                values = [pa.array(np.asarray(batch.column(2 + k)) + word_ratios(found, *shared.value, k)) for k in range(len(TABLES))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *values], schema=batch.schema)

        return run

    for piece in range(pieces.number):
        shared = spark.sparkContext.broadcast(pieces.tables(piece))
        words.mapInArrow(frugal(add(shared)), words.schema).write.parquet(f"{folder}/{piece}")
        words = spark.read.schema(words.schema).parquet(f"{folder}/{piece}")
        if piece:
            delete(spark, f"{folder}/{piece - 1}")
        shared.destroy()
    return words


def spread_features(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """(tag, x) for each row (tag, text, pick): the features by the pick-th of TABLES, where the tables are no broadcast.

    A document's commonest words are summed where it stands; each other word
    goes with its count to the join, so no word of that join is a hot key.
    """
    spark = rows.sparkSession
    words = word_table(rows, pieces)
    names = [f"v_{t}" for t in TABLES]
    common = words.filter(F.length("word") <= SHORT).orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    shared = spark.sparkContext.broadcast((common["word"].to_pylist(), np.stack([common[v].to_numpy() for v in names])))
    schema = f"row long, tag {rows.schema['tag'].dataType.simpleString()}, pick int, word string, k long, n long, chars long, total double, excess double, top double"
    types = _arrow_schema(spark, schema)

    def run(batches):
        known, values = shared.value
        places = {w: i for i, w in enumerate(known)}
        for batch in small_batches(batches, "text"):
            out = []
            for row, tag, text, pick in zip(*(c.to_pylist() for c in batch.columns)):
                counts = Counter(words_of(text))
                here = [(places[w], k) for w, k in counts.items() if w in places]
                at, k = (np.array(x, np.int64) for x in (zip(*here) if here else ((), ())))
                v = values[pick][at]
                n = sum(counts.values())
                out.append((row, tag, pick, None, None, n, sum(len(w) * c for w, c in counts.items()) + n, float((v * k).sum()), float((np.maximum(v - EXCESS, 0) * k).sum()), float(v.max()) if here else None))
                out += [(row, None, pick, w, c, 0, 0, None, None, None) for w, c in counts.items() if w not in places]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], schema=types)

    parts = saved(rows.select(F.monotonically_increasing_id().alias("row"), "tag", "text", F.col("pick").cast("int")).mapInArrow(frugal(run), schema))
    shared.destroy()
    v = F.element_at(F.array(*names), F.col("pick") + 1)
    rest = parts.filter("word is not null").select("row", "tag", "pick", "word", "k").join(words.drop("n"), "word")
    rest = rest.select("row", "tag", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("chars"), (F.col("k") * v).alias("total"), (F.col("k") * F.greatest(v - EXCESS, F.lit(0.0))).alias("excess"), v.alias("top"))
    both = parts.filter("word is null").select(rest.columns).unionByName(rest)
    sums = both.groupBy("row").agg(F.max("tag").alias("tag"), *(F.sum(c).alias(c) for c in ("n", "chars", "total", "excess")), F.max("top").alias("top"))
    x = [F.col("total") / F.col("chars"), F.col("excess") / F.col("n"), F.col("excess") / F.sqrt("n"), F.log1p("excess"), F.least(F.greatest("top", F.lit(0.0)), F.lit(20.0))]
    return sums.select("tag", F.array(*(F.when(F.col("n") > 0, c).otherwise(0.0) for c in x)).alias("x"))


def probability(calibration) -> Column:
    """The calibrated score of the features x."""
    mean, scale, w = (list(map(float, c)) for c in calibration)
    z = sum((w[i] * (F.col("x")[i] - mean[i]) / scale[i] for i in range(len(mean))), F.lit(w[-1]))
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


class Model:
    """Tables, as a broadcast or in pieces, and calibration."""

    def __init__(self, tables: Broadcast | Pieces | None, calibration, constant: float | None = None):
        self.tables, self.calibration, self.constant = tables, calibration, constant


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> Model:
    spark = docs.sparkSession
    counted = checkpointed(count_n_grams(training_rows(docs, labels, id_col, text_col)))
    grams = counted.filter("gram != ''")
    ordinary, toxic = (F.col(f"c_{x}0") + F.col(f"c_{x}1") for x in (0, 1))
    found = counted.groupBy((F.col("gram") == "").alias("documents")).agg(F.sum(ordinary).alias("ordinary"), F.sum(toxic).alias("toxic"), F.count(F.lit(1)).alias("distinct")).collect()
    kinds = {(r.documents, c): r[c] for r in found for c in ("ordinary", "toxic", "distinct")}
    n_docs = sum(kinds.get((True, c), 0) for c in ("ordinary", "toxic"))
    share = kinds.get((True, "toxic"), 0) / max(1, n_docs)
    if not kinds.get((False, "ordinary")) or not kinds.get((False, "toxic")):
        return Model(None, None, share)
    low = checkpointed(shared_backoff(grams))
    by_gram, by_context = ratios(grams, low, discounts(grams))
    pieces = -(-kinds[(False, "distinct")] // piece)
    if pieces > 1:
        shared = Pieces(by_gram, by_context, pieces)
    else:
        shared = spark.sparkContext.broadcast((ratio_table(by_gram, N), ratio_table(by_context, N - 1)))
    rate = min(1.0, CALIBRATION_ROWS / max(1, n_docs))
    some = docs.filter(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << 20)) < int(rate * (1 << 20)))
    sample = training_rows(some, labels, id_col, text_col).select("id", "toxic", "half", "text")

    def make():
        makers = [feature_maker(shared.value, 1 - h) for h in (0, 1)]  # each half is scored by the other's counts

        def handle(ids, toxic, half, texts):
            out = [None] * len(texts)
            for h in (0, 1):
                at = [i for i, x in enumerate(half) if x == h]
                for i, f in zip(at, makers[h]([texts[i] for i in at])):
                    out[i] = f
            return toxic, out

        return handle

    if pieces > 1:
        got = spread_features(sample.select(F.col("toxic").alias("tag"), "text", (1 - F.col("half")).alias("pick")), shared).withColumnRenamed("tag", "toxic").toArrow()
    else:
        got = map_rows(sample, "toxic int, x array<double>", make, "text").toArrow()
    x, y = np.array(got["x"].to_pylist(), float).reshape(-1, 5), (got["toxic"].to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        if pieces == 1:
            shared.destroy()
        return Model(None, None, share)
    return Model(shared, calibrate(x, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    if model.constant is not None:
        return rows.select(id_col, F.lit(float(model.constant)).alias("score"))
    shared, calibration = model.tables, model.calibration
    if isinstance(shared, Pieces):
        found = spread_features(rows.select(F.col(id_col).alias("tag"), F.col(text_col).alias("text"), F.lit(len(TABLES) - 1).alias("pick")), shared)
        return found.select(F.col("tag").alias(id_col), probability(calibration).alias("score"))

    def make():
        score_of = scorer(shared.value, calibration)
        return lambda ids, texts: (ids, score_of(texts))

    return map_rows(rows, f"{id_col} long, score double", make, text_col)


def scorer(tables, calibration):
    features_of, (mean, scale, w) = feature_maker(tables), calibration

    def of(texts):
        if not len(texts):
            return []
        z = (np.array(features_of(texts)) - mean) / scale
        return (1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))).tolist()

    return of


def filter_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns."""
    if model.constant is not None:
        return docs.filter(F.lit(float(model.constant) < threshold))
    shared, calibration = model.tables, model.calibration
    if isinstance(shared, Pieces):  # equal texts score alike, so those that go are named by a digest
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        found = spread_features(docs.select(F.sha2(text, 256).alias("tag"), text.alias("text"), F.lit(len(TABLES) - 1).alias("pick")), shared)
        gone = saved(found.filter(probability(calibration) >= threshold).select(F.col("tag").alias("__rejected")).distinct())
        return docs.join(gone, F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256) == gone["__rejected"], "left_anti")

    def run(batches):
        score_of = scorer(shared.value, calibration)
        for batch in small_batches(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([s < threshold for s in score_of(texts)], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)


def digest(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    held_out = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1
    return scored.select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
