"""Quality rules with risk-controlled thresholds, as DataFrame expressions only.

Base measures of a document's words (runs of anything but space and
\\x09-\\x0D): see ``measures``.  Rules on them are ratios; the cutoff of each
rule in each stratum is chosen from labelled documents so that, with
probability at least 1 - delta over all strata and rules together, at most a
share alpha of the good documents is rejected:

* the labelled documents are a holdout; a candidate cutoff's false rejections
  are the good ones (quality 1) beyond it: k of n in the stratum;
* the cutoff is valid if the exact binomial tail P(Bin(n, alpha) <= k) is at
  most delta / (strata x rules x candidates) (Bonferroni), that is, if the
  Clopper-Pearson upper bound of the rejection rate is at most alpha;
* of the valid candidates, each rule takes the one that rejects most.

alpha is divided among the rules, so that the rules together stay within it.

Cases: a null or empty text has no words and fails the base rules.  A stratum
without enough good labels has no valid cutoff and rejects by the base rules
only; a null stratum is one of its own.  Repeated label rows of one document
count once, as good if any row says so; labels without a document are ignored.
Repeated documents are each judged, and counted, on their own.  Empty tables
give an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import checkpointed

WORD = r"[^\x20\x09-\x0D]"
GAPS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Share of good documents that may be rejected, the error probability of the whole choice, and the cutoffs tried.
ALPHA = 0.05
DELTA = 0.05
GRID = {
    "symbol_ratio": (0.02, 0.05, 0.1, 0.2, 0.3),
    "dup_line_ratio": (0.1, 0.2, 0.3, 0.5, 0.7),
    "repeat_ratio": (0.05, 0.1, 0.15, 0.2, 0.25),
    "long_words": (9.0, 11.0, 13.0, 16.0, 20.0),
    "short_words": (-4.0, -3.5, -3.0, -2.5, -2.0),
}


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (long)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, GAPS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return (
        docs.withColumn("__words", F.transform(words, lambda w: F.xxhash64(w)))
        .withColumn("__lines", lines)
        .withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(text, GAPS, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("__words")))
        .drop("__words", "__lines")
    )


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of so many words that stand twice or more in the text, the first included.

    words: 64-bit hashes.  The windows' hashes are made once; where two are
    equal, they are sorted with their positions, equal neighbours are marked,
    and the union of the marked windows is summed from position to position.
    """

    def marked(pairs):
        same = lambda x, k: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))  # noqa: E731  false beyond the ends
        return F.sort_array(F.transform(F.filter(pairs, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def covered(at):
        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    def counted(hashes):
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(once(pairs, lambda p: once(marked(p), covered)))

    return once(words, lambda w: F.when(F.size(w) <= window, F.lit(0)).otherwise(once(window_hashes(w, window), counted))).cast("long")


def window_hashes(words: Column, window: int) -> Column:
    """A hash of each window of so many words: of two shorter windows' hashes that cover it, so that a few passes do."""

    def widened(hashes, span):
        if span == window:
            return F.slice(hashes, 1, F.greatest(F.size(hashes) - window + 1, F.lit(0)))
        step = min(span, window - span)
        later = F.slice(hashes, step + 1, F.greatest(F.size(hashes) - step, F.lit(0)))
        return once(F.zip_with(hashes, later, lambda a, b: F.xxhash64(a, b)), lambda h: widened(h, span + step))

    return widened(words, 1)


def once(value: Column, use) -> Column:
    """use(value), with value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rules() -> dict[str, Column]:
    """Each rule's value: the higher, the worse."""
    per_word = lambda c: F.col(c) / F.col("n_words")
    return {
        "symbol_ratio": per_word("n_symbols"),
        "dup_line_ratio": F.col("n_dup_lines") / F.col("n_lines"),
        "repeat_ratio": per_word("n_repeat_words"),
        "long_words": per_word("word_chars"),
        "short_words": -per_word("word_chars"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0 by Stirling's series at x + 8."""
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return series - sum((F.ln(x + k) for k in range(1, 8)), F.ln(x))


def log_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k) for k <= n p, from the largest term downwards.

    Terms further than 50 sqrt(k + 1) + 200 below are less than 1e-300 of it.
    """
    top = lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    terms = F.least(k, F.ceil(50 * F.sqrt(k + 1.0)) + 200).cast("int")
    one = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc, d):
        i = k - d
        t = acc["t"] * i * (1 - p) / ((n - i + 1) * p)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    summed = F.when(terms < 1, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(terms - 1, F.lit(0))), one, step, lambda acc: acc["s"]))
    return top + F.log(summed)


def thresholds(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row a stratum: n_good, and each rule's cutoff (null: none is valid)."""
    share = alpha / len(GRID)
    good = labels.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max("quality").alias("__quality")).filter("__quality = 1")
    held = measured.filter(~base_failed()).join(good, F.col(id_col) == F.col("__id"), "left_semi")
    values = held.select(F.col(stratum).alias("stratum"), *(c.alias(k) for k, c in rules().items()))
    counts = [F.sum((F.col(rule) > cut).cast("long")).alias(f"{rule}_{j}") for rule, cuts in GRID.items() for j, cut in enumerate(cuts)]
    strata = values.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *counts)
    strata = strata.withColumn("__strata", F.count(F.lit(1)).over(Window.partitionBy()))
    chosen = []
    for rule, cuts in GRID.items():
        at = F.lit(None).cast("double")
        for j, cut in reversed(list(enumerate(cuts))):  # the first valid one rejects most
            k, n = F.col(f"{rule}_{j}").cast("double"), F.col("n_good").cast("double")
            tests = F.col("__strata") * sum(map(len, GRID.values()))
            valid = (k <= n * share) & (log_tail(k, n, share) <= F.log(F.lit(delta) / tests))
            at = F.when(valid, F.lit(float(cut))).otherwise(at)
        chosen.append(at.alias(f"cut_{rule}"))
    return strata.select("stratum", "n_good", *chosen)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """Every document's measures, base_failed, the rules it breaks and kept."""
    slim = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(stratum).cast("string").alias("stratum"), F.col(text_col).alias("__text"))
    measured = checkpointed(measures(slim, "__text").drop("__text"))
    cut = thresholds(measured, labels, id_col, "stratum").withColumnRenamed("stratum", "__stratum")
    joined = measured.join(cut, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    broken = F.filter(F.array(*(F.when(value > F.col(f"cut_{k}"), F.lit(k)) for k, value in rules().items())), lambda x: x.isNotNull())
    failed = base_failed()
    return joined.withColumn("base_failed", failed).withColumn("broken", F.when(failed, F.array().cast("array<string>")).otherwise(broken)).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def digest(judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
