"""Quality classifier by co-training of two views.

The content view sees only the text: shares of hashed words and measures of
its style.  The metadata view sees only lang, source and n_chars.  Each is a
logistic regression.  Starting from the labelled rows, in each of ROUNDS
rounds each view scores all unlabelled documents that are still free and hands
its most confident ones, a CONFIDENT share of all unlabelled documents in the
labels' proportion, with the labels it gives them to the other view's training
set.  Both views are then calibrated (Platt) on labelled rows kept out of
training, combined by a logistic regression on the calibrated log-odds of the
same rows, and all documents are scored.

Features are made once for every document, from its whole text, and written to
the shared folder.  Each round is two passes over them: a histogram of the
free documents' log-odds, in BINS of fixed width, gives the thresholds beyond
which the share lies (documents in a threshold's bin are all taken, only below
0 or above it); then the documents beyond them are taken.  Whether a document
was taken before follows from the models and thresholds of earlier rounds, so
nothing is kept for a document.

Fitting uses bounded samples of labelled rows, chosen by a hash: at most about
LABELLED_ROWS labelled ones, and of each round's newly labelled ones at most
about PSEUDO_ROWS a view.  Which documents are confident, and all scores,
cover every document.

Cases: null or empty texts have zero content features; null metadata has
features of its own.  Of several labels of a document the highest counts;
null labels and labels without documents are ignored; documents without an id
have no label.  With labels of one kind only, the score is the share of good
ones among the labelled documents (1 without any).  Repeated rows count and are
scored each.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import _arrow_schema, checkpointed, frugal, small_batches

LABELLED_ROWS = 20_000
PSEUDO_ROWS = 2_000
ROUNDS = 3
BINS = 64  # a unit of log-odds
CONFIDENT = 0.02
WORD_BINS = 192
SOURCE_BINS = 64
LANG_BINS = 16
MEMO = 100_000
THRESHOLD = 0.5

_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_UPPER = re.compile(r"[A-Z]")


def _bin(text: str | bytes, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace") if isinstance(text, str) else text) % size


def content(text: str | None, memo: dict) -> np.ndarray:
    """Content features: style measures, then shares of hashed words."""
    out = np.zeros(12 + WORD_BINS, np.float32)
    words = text.split() if text else []
    if not words:
        return out
    n, chars = len(words), len(text)
    kinds = set(words)
    if len(memo) > MEMO:  # only before a document, whose words are then all there
        memo.clear()
    for w in kinds.difference(memo):
        memo[w] = _bin(w, WORD_BINS)
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode("utf-8", "replace")
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    plain = len(raw) - len(raw.translate(None, b".,;:'\"!?()-"))
    out[:12] = (
        1,
        np.log1p(n),
        (symbols - plain) / chars,
        plain / chars,
        len(_UPPER.findall(text)) / chars,
        sum(map(len, words)) / n / 10,
        len(kinds) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        sum(text.count(c) for c in set(text) if c.isdigit()) / chars,
        float(words[0][:1].isupper()),
        float(text.rstrip().endswith((".", "!", "?"))),
    )
    bins = np.bincount(np.fromiter(map(memo.__getitem__, words), np.int64, n), minlength=WORD_BINS)
    out[12:] = np.sqrt(bins / n)
    return out


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Metadata features: one-hot hashed language and source, the size's logarithm and its steps."""
    out = np.zeros(LANG_BINS + SOURCE_BINS + 20, np.float32)
    out[0 if lang is None else 1 + _bin(lang, LANG_BINS - 1)] = 1
    out[LANG_BINS + (0 if source is None else 1 + _bin(source, SOURCE_BINS - 1))] = 1
    at = LANG_BINS + SOURCE_BINS
    if n_chars is None or n_chars < 0:
        out[at] = 1
    else:
        out[at + 1] = np.log1p(n_chars) / 10
        out[at + 2 + min(16, int(np.log2(n_chars + 1)))] = 1
    return out


class Logistic:
    """Logistic regression with a ridge, by Newton steps on standardised features."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(0), x.std(0)
        self.scale[self.scale < 1e-9] = 1.0
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x.astype(np.float64) - self.mean) / self.scale @ self.w[:-1] + self.w[-1], -30, 30)


class Round:
    """The models of a round and, for each view, the log-odds up to which and from which on its documents are taken."""

    def __init__(self, models: list[Logistic], low: list[float], high: list[float]):
        self.models, self.low, self.high = models, low, high

    def taken(self, views: list[np.ndarray]) -> list[np.ndarray]:
        """For each view, its labels of the documents it takes: 0, 1, or -1 for the others."""
        out = []
        for m, x, low, high in zip(self.models, views, self.low, self.high):
            at = binned(m.logits(x))
            out.append(np.where(at <= low, 0, np.where(at >= high, 1, -1)))
        return out


def binned(logits: np.ndarray) -> np.ndarray:
    return np.floor(logits * BINS).astype(np.int64)


def free(views: list[np.ndarray], rounds: list[Round]) -> np.ndarray:
    """Whether no round has taken a document."""
    out = np.ones(len(views[0]), bool)
    for r in rounds:
        for labels in r.taken(views):
            out &= labels < 0
    return out


def thresholds(histogram: dict[int, int], n_low: int, n_high: int) -> tuple[float, float]:
    """The bins up to which n_low documents lie and from which on n_high do; only bins below 0 and above it."""
    low, high = -math.inf, math.inf
    total = 0
    for k in sorted(k for k in histogram if k < 0):
        if total >= n_low:
            break
        low, total = k, total + histogram[k]
    total = 0
    for k in sorted((k for k in histogram if k >= 0), reverse=True):
        if total >= n_high:
            break
        high, total = k, total + histogram[k]
    return low, high


class Model:
    """Two views, their calibrations and the combination."""

    def __init__(self, views=None, calibrations=None, combined=None, constant: float | None = None):
        self.views, self.calibrations, self.combined, self.constant = views, calibrations, combined, constant

    def scores(self, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.constant is not None:
            return (np.full(len(x[0]), self.constant),) * 3
        logits = [c.logits(m.logits(v)[:, None]) for m, c, v in zip(self.views, self.calibrations, x)]
        both = self.combined.logits(np.stack(logits, axis=1))
        return tuple(1 / (1 + np.exp(-z)) for z in (both, *logits))


FEATURES = "id long, lang string, source string, n_chars long, part long, x binary"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FEATURES of every row: the content view as half-precision numbers, the metadata, and a hash that samples rows."""
    has = lambda c, t: (F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), has("lang", "string"), has("source", "string"), has("n_chars", "long"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", "lang", "source", "n_chars", F.xxhash64("id", "text", F.lit(8)).alias("part"), "text")
    types = _arrow_schema(docs.sparkSession, FEATURES)

    def run(batches):
        memo: dict = {}
        for batch in small_batches(batches, "text"):
            x = [content(t, memo).astype(np.float16).tobytes() for t in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[:5], types)), pa.array(x, types[5].type)], schema=types)

    return rows.mapInArrow(frugal(run), FEATURES)


def views_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Both views of rows with the columns lang, source, n_chars and x."""
    langs, sources, sizes, x = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "source", "n_chars", "x"))
    text = np.frombuffer(b"".join(x), np.float16).reshape(len(x), 12 + WORD_BINS).astype(np.float32)
    return [text, np.array([metadata(*m) for m in zip(langs, sources, sizes)], np.float32).reshape(len(x), -1)]


def labelled(made: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Features with quality (null: unlabelled) and held (kept out of training), written once.  Rows without an id are dealt out evenly."""
    named = labels.select(F.col(id_col).cast("long").alias("__id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("__id").agg(F.max("quality").alias("quality"))
    salt = F.when(F.col("id").isNull(), F.pmod("part", F.lit(1024))).otherwise(0).cast("int")
    met = made.withColumn("__salt", salt).join(named.withColumn("__none", F.lit(0)), (F.col("id") == F.col("__id")) & (F.col("__salt") == F.col("__none")), "left")
    held = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(3)) == 0
    return checkpointed(met.select("id", "lang", "source", "n_chars", "part", "x", "quality", held.alias("held")))


def _sampled(rows: DataFrame, most: int, n: int) -> DataFrame:
    parts = 1 << 30
    return rows.filter(F.pmod("part", F.lit(parts)) < int(min(1.0, most / max(1, n)) * parts))


def _collected(rows: DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Views, answers y and marks of a bounded sample, in the order of its hash, so that a fit is repeatable."""
    got = rows.select("lang", "source", "n_chars", "x", "part", F.col("y").cast("int"), F.col("mark").cast("int")).toArrow()
    order = np.lexsort([got[c].to_numpy() for c in ("y", "mark", "part")])
    batches = got.take(pa.array(order)).combine_chunks().to_batches()
    views = [views_of(b) for b in batches] or [[np.zeros((0, 12 + WORD_BINS), np.float32), np.zeros((0, LANG_BINS + SOURCE_BINS + 20), np.float32)]]
    return [np.concatenate([v[k] for v in views]) for k in (0, 1)], got["y"].to_numpy()[order], got["mark"].to_numpy()[order]


def _histograms(pool: DataFrame, rounds: list[Round], models: list[Logistic]) -> list[dict[int, int]]:
    """For each view, the bins of the free documents' log-odds; as many rows as there are bins."""
    schema = "view int, bin long, n long"
    types = _arrow_schema(pool.sparkSession, schema)

    def run(batches):
        counts: dict[tuple[int, int], int] = {}
        for batch in small_batches(batches, "x"):
            views = views_of(batch)
            some = free(views, rounds)
            for v in (0, 1):
                for k, n in zip(*(a.tolist() for a in np.unique(binned(models[v].logits(views[v][some])), return_counts=True))):
                    counts[v, k] = counts.get((v, k), 0) + n
        rows = [(v, k, n) for (v, k), n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(types)], schema=types)

    out: list[dict[int, int]] = [{}, {}]
    for r in pool.select("lang", "source", "n_chars", "x").mapInArrow(frugal(run), schema).groupBy("view", "bin").agg(F.sum("n").alias("n")).collect():
        out[r.view][r.bin] = r.n
    return out


def _taken(pool: DataFrame, rounds: list[Round], now: Round) -> DataFrame:
    """The free documents that a round takes: a row for each view that does (the mark), with its label y."""
    schema = "lang string, source string, n_chars long, part long, x binary, mark int, y int"
    types = _arrow_schema(pool.sparkSession, schema)

    def run(batches):
        for batch in small_batches(batches, "x"):
            views = views_of(batch)
            some = free(views, rounds)
            for v, labels in enumerate(now.taken(views)):
                at = np.flatnonzero(some & (labels >= 0))
                few = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(few.columns, types)), pa.array(np.full(len(at), v, np.int32)), pa.array(labels[at].astype(np.int32))], schema=types)

    return pool.select("lang", "source", "n_chars", "part", "x").mapInArrow(frugal(run), schema)


def train_on(rows: DataFrame) -> Model:
    """The model of labelled()'s rows."""
    n = rows.agg(F.count("quality").alias("labelled"), F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality").isNull()).alias("pool")).head()
    known = rows.filter("quality IS NOT NULL").withColumn("y", (F.col("quality") > 0).cast("int")).withColumn("mark", F.col("held"))
    views, y, held = _collected(_sampled(known, LABELLED_ROWS, n.labelled))
    held = held > 0
    if any(len(np.unique(y[s])) < 2 for s in (held, ~held)):
        return Model(constant=n.good / n.labelled if n.labelled else 1.0)
    pool = rows.filter("quality IS NULL")
    sets = [([views[v][~held]], [y[~held]]) for v in (0, 1)]
    fit = lambda: [Logistic().fit(np.concatenate(x), np.concatenate(t)) for x, t in sets]
    models, share, rounds = fit(), y[~held].mean(), []
    k = int(CONFIDENT * n.pool)
    n_low = max(1, round(k * (1 - share)))
    for _ in range(ROUNDS if k else 0):
        found = [thresholds(h, n_low, max(1, k - n_low)) for h in _histograms(pool, rounds, models)]
        now = Round(models, *(list(x) for x in zip(*found)))
        more, given, by = _collected(_sampled(_taken(pool, rounds, now), PSEUDO_ROWS, k))
        for v in (0, 1):
            sets[1 - v][0].append(more[1 - v][by == v])
            sets[1 - v][1].append(given[by == v])
        rounds.append(now)
        models = fit()
    target = y[held].astype(float)
    own = [v[held] for v in views]
    calibrations = [Logistic().fit(m.logits(v)[:, None], target) for m, v in zip(models, own)]
    logits = np.stack([c.logits(m.logits(v)[:, None]) for m, c, v in zip(models, calibrations, own)], axis=1)
    return Model(models, calibrations, Logistic().fit(logits, target))


def score_of(made: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score, content_score, metadata_score) of rows of features."""
    shared = made.sparkSession.sparkContext.broadcast(model)
    schema = f"{id_col} long, score double, content_score double, metadata_score double"
    types = _arrow_schema(made.sparkSession, schema)

    def run(batches):
        for batch in small_batches(batches, "x"):
            scores = shared.value.scores(views_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(s) for s in scores)], schema=types)

    return made.select("id", "lang", "source", "n_chars", "x").mapInArrow(frugal(run), schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return train_on(labelled(features(docs, id_col, text_col), labels, id_col))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, content_score, metadata_score) of every row."""
    return score_of(features(docs, id_col, text_col), model, id_col)


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score() by train() on the same documents, whose features are made once."""
    rows = labelled(features(docs, id_col, text_col), labels, id_col)
    return score_of(rows, train_on(rows), id_col)


def digest(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return scored.select(id_col, "score", "content_score", "metadata_score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
