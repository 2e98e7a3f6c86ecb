import hashlib
import re

from quire.llm import pii

from .helpers import ODD_TEXTS, documents, real_texts

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    "a@b@c.d e.f@g.h@i.j ..@x.y @q.r s@t..u v@w.x.",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8.9 001.002.003.0004 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111",
    "+1 (017) 555-7713 +12 +1+2345678901 (+44) 20 7946 0958+ +123456789012345678",
    "iban DE89 3704 0044 0532 0130 00, IBAN: DE00370400440532013000; ssn 123-45-6789 ssn 000-12-3456",
    "account no. 12345678; routing 021000021. 12 Long Acre Street, ftp://me:secret@host.example/x",
    "é@é.com é.a@b.co 😀 x@y.zz",
    "İ@x a@b.cd İİ me@there.example token = \"0b96a8c8d79c4a5085c919698889f59b72ab7bb6\" PASSWORD: hunter2hunter2hunter2 token short",
    "0" * 5000 + ".1.2.3 " + "0" * 5000 + "256.1.2.3",
]


def brute(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.split(".")),
        "card": lambda m: 14 <= len(d := digits(m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
        "phone": lambda m: 10 <= len(digits(m)) <= 15,
    }
    found = [(m.start(), k, m.end(), kind) for k, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], text or "") if ok[kind](m[0])]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def test_addresses_and_secrets():
    a = pii.automaton()
    shown = lambda t: [(k, t[x:y]) for x, y, k in pii.spans(t, a)]
    assert shown("at 12 Long Acre STREET, 7b Elm Road. No Street, x12 Elm Lane") == [("address", "12 Long Acre STREET"), ("address", "7b Elm Road")]
    long = "Long" + "g" * 300
    assert shown(f"at 12345 {long} Drive") == [("address", f"12345 {long} Drive")]
    assert shown("123456 Elm Lane") == [] and shown("Elm Lane") == []
    assert shown(HARD[7]) == [("email", "a@b.cd"), ("email", "me@there.example"), ("secret", "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"), ("secret", "hunter2hunter2hunter2")]
    user = "u" * 400
    assert ("url_login", f"https://{user}:p@h.example") in shown(f"https://{user}:p@h.example")


def test_base_spans_match_the_expressions(spark):
    texts = [*ODD_TEXTS, *HARD, *real_texts(spark), "7" * 30_000 + " x" * 30_000 + " 10.0.0.1 me@there.example " + "." * 50_000]
    rows = pii.digest(pii.find(documents(spark, texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), texts[r.doc_id][:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in want) for k in PATTERNS]


def test_long_texts_are_linear_and_whole(spark):
    texts = ["1" * 300_000, "a." * 150_000 + "@", "@" * 300_000, "+1" * 150_000, "9" * 100_000 + " mail me@there.example"]
    rows = {r.doc_id: r for r in pii.digest(pii.find(documents(spark, texts))).collect()}
    assert [rows[i].n_email for i in range(5)] == [0, 0, 0, 0, 1]


def test_the_method_adds_spans():
    a = pii.automaton()
    kinds = lambda t: [k for _, _, k in pii.spans(t, a)]
    assert kinds(HARD[4]) == ["iban", "ssn"]
    assert {"account", "address", "url_login"} <= set(kinds(HARD[5]))


def test_redact_keeps_rows_and_columns(spark):
    docs = documents(spark, [None, "", "write to a.b@c.example now", "plain"])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == [None, "", "write to [EMAIL] now", "plain"]
    assert pii.find(docs.limit(0)).count() == 0
