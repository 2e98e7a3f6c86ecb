import random
import re

from quire.llm import licenses

from .helpers import ODD_TEXTS, documents, real_texts

TEXTS = [
    "GNU General Public License, MIT license; mit-license gnu general public license gnu general public license version 3",
    "Licensed under CC BY-NC 4.0. cc cc by by",
    "Licensed under the Apache License, Version 2.0.",
    "ccby c c by mit licensed the license of mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mit licensé mit license",
]


def brute(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.encode().split()]
    return len(words), sorted(places)


def test_base_places_and_labels(spark):
    texts = ODD_TEXTS + TEXTS + real_texts(spark)
    rows = licenses.digest(licenses.scan(documents(spark, texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, places = brute(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(places))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_the_method_adds_labels(spark):
    rows = {r.doc_id: r.labels for r in licenses.digest(licenses.scan(documents(spark, TEXTS))).collect()}
    assert rows[1] == "cc-by,cc-by-nc-4.0" and rows[2] == "apache,apache-2.0" and rows[4] == "mit" and "gpl-3.0" in rows[0]


def test_empty(spark):
    assert licenses.scan(documents(spark, TEXTS).limit(0)).count() == 0


def test_notices_with_two_fifths_of_their_words_changed_are_found():
    pick, index = random.Random(5), licenses.Index({b"": 1000, **{w: 5 + len(w) for w in licenses.vocabulary()}})
    for label, words, keys, is_base in licenses.templates():
        if is_base:
            continue
        kept = {i + j for key in keys for i in range(len(words)) if words[i : i + len(key)] == key for j in range(len(key))}
        rarest = sorted(set(range(len(words))) - kept, key=lambda k: -index.idf[words[k]])
        most = int(len(words) * (1 - licenses.LEAST_COVERAGE))
        for turn in range(20):
            changed = rarest[:most] if not turn else pick.sample(rarest, min(most, len(rarest)))
            text = [b"w%d" % pick.randrange(10**6) if k in changed else w for k, w in enumerate(words)]
            before = [b"x%d" % i for i in range(pick.randrange(30))]
            assert label in index.scan([*before, *text, b"end"])[1], (label, changed)
        many = [b"w%d" % k if k not in kept and k % 10 else w for k, w in enumerate(words)]
        if sum(a == b for a, b in zip(many, words)) < 0.4 * len(words):
            assert index.scan(many)[1].get(label, 0) < licenses.LEAST_COVERAGE


def test_a_changed_rare_word_and_inserted_words():
    index = licenses.Index({b"": 100})
    grant = "permission is hereby granted free of charge to any person acquiring a copy of this software"
    assert index.scan(licenses.words_of(grant))[1] == {"mit": 15 / 16}
    spaced = "permission is hereby granted free of charge now to any other person obtaining a copy of this software"
    assert index.scan(licenses.words_of(spaced))[1] == {"mit": 1.0}
    whole = next(n[1] for n in licenses.NOTICES if n[0] == "mit" and len(n[1]) > 200)
    assert index.scan(licenses.words_of(f"intro {whole} outro"))[1]["mit"] == 1.0
