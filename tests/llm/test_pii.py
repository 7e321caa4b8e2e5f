import hashlib
import random
import re
import time

from fundflow.llm import pii as P

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                    "card": lambda: 13 <= len(digits) <= 19 and plain_luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def base_of(text):
    return [tuple(s[:3]) for s in P.find(text) if s.kind in P.BASE]


def test_base_spans_against_plain_patterns():
    random.seed(6)
    for _ in range(30000):
        text = "".join(random.choices("ab@.@.-1 23+(4", k=random.randint(0, 40)))
        assert base_of(text) == plain(text), repr(text)
    for _ in range(3000):
        text = "".join(random.choices(["4", "1", "-", " ", "0", "4111 1111 1111 1111", "é", "+1", "(5)", "."], k=random.randint(0, 25)))
        assert base_of(text) == plain(text), repr(text)


def test_validators():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")
    assert P.mod97("GB82WEST12345698765432") and not P.mod97("GB82WEST12345698765433")


def test_added_kinds_and_context():
    found = {s.kind: s for s in P.find("Bank account GB82 WEST 1234 5698 7654 32 please")}
    assert found["iban"].score == 1.0
    assert not [s for s in P.find("GB82 WEST 1234 5698 7654 33") if s.kind == "iban"]
    assert [s.kind for s in P.find("my social security 123-45-6789")] == ["national_id"]
    assert P.find("part 123-45-6789 is here") == [] and P.find("ssn 000-45-6789") == []
    high, low = P.find("call me: +1 (555) 010-9999")[0].score, P.find("order: +1 (555) 010-9999")[0].score
    assert high > low


def test_redaction():
    text = "Write é.x@a.example or x.y@b.example now, 10.0.0.1"
    assert P.redacted(text, P.find(text)) == "Write é<EMAIL> or <EMAIL> now, <IP>"
    both = "a+378282246310005 b"
    assert P.redacted(both, P.find(both)).count("<") == 1  # phone and card overlap


def test_long_texts_take_linear_time():
    text = "4" * 100000 + "@" * 1000 + "a" * 200000 + "+1" + "(" * 100000 + "1." * 100000 + "AB12" * 50000 + "1 " * 100000
    start = time.time()
    P.find(text)
    assert time.time() - start < 20


def test_table(documents):
    rows = [(1, "mail a@b.example", "en"), (2, None, "en"), (3, "", "en"), (4, "é 10.1.2.3", None), (4, "é 10.1.2.3", None), (None, "+49 30 1234567", "de")]
    docs = documents(rows)
    got = sorted((tuple(r) for r in P.report(docs).collect()), key=str)
    expected = []
    for doc_id, text, _ in rows:
        spans = plain(text or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        expected.append((doc_id, *(sum(s[0] == k for s in spans) for k in BASE), hashlib.sha256(written.encode()).hexdigest(), written))
    assert got == sorted(expected, key=str)
    assert P.report(documents([])).collect() == []
    assert [r.r for r in docs.select("doc_id", P.redact()("text").alias("r")).where("doc_id <= 3").orderBy("doc_id").collect()] == ["mail <EMAIL>", None, ""]
    assert docs.select(P.spans()("text").alias("s")).where("size(s) > 0").count() == 4
