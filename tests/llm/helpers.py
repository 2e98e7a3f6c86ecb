"""Small inputs shared by the tests of the text operators."""

import random

SF = "/root/testdata/sf0.001"

ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "é ü 漢字 \U0001f600 mixed",
    "same line here\nsame line here\n\nother\nsame line here ",
    "a b c d e f g h i j k l m n o p q r s t a b c d e f g h i j k l",
    "tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie",
    "x" * 70_000,
    "1" * 50_000,
    ("1.2.3.4.5.6.7.8 " * 500),
    "word " * 20_000,
]


def documents(spark, texts, extra=True):
    """doc_id, text, lang, source, n_chars and, if extra, a column whose name clashes with what operators make."""
    rows = [(i, t, ("en", "fr", None)[i % 3], "hot" if i % 3 else f"s{i}", len(t or ""), i) for i, t in enumerate(texts)]
    names = "doc_id long, text string, lang string, source string, n_chars long" + (", n_words long" if extra else "")
    return spark.createDataFrame([r[: 6 if extra else 5] for r in rows], names)


def babble(seed, n_words, words=("alpha", "beta", "gamma", "delta", "of", "the", "and", "river", "stone", "cloud")):
    pick = random.Random(seed)
    return " ".join(pick.choice(words) + (str(pick.randrange(60)) if pick.random() < 0.7 else "") for _ in range(n_words))


def real_texts(spark, n=120):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n).collect()]
