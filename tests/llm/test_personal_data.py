import hashlib
import random
import re
import time

import pytest

from hindcast.llm import personal_data
from tests.llm.tables import documents

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def brute(text):
    """The base spans by the patterns themselves."""
    text = text or ""
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    count = lambda m: sum(c.isdigit() for c in m[0])
    out += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(text) if 12 <= count(m) <= 19 and luhn(m[0])]
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 9 <= count(m) <= 15]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def noise(seed):
    rng = random.Random(seed)
    parts = [
        "a.b@c.de", "@", "x@y", "x@y.z@w.v", "me+you@a-b.c1.org.", "é@ü.de", "q%_@-.-", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1",
        "0001.02.3.255", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (555) 010-9999", "+49.30.123456",
        "++12345678901", "+1", "+12 ", "1 2 3 4 5 6 7 8 9 0 1 2 3", " ", "\n", "word", "ß", "(", ")", "-", ".", "7", "79927398713 0", "💳",
    ]
    return "".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 40)))


def test_base_spans_equal_the_patterns(spark):
    texts = [noise(i) for i in range(400)] + [None, "", "1" * 3000, "a" * 50_000, "a@" * 3000, "+1 " * 2000, "9." * 4000]
    rows = {r.doc_id: r for r in personal_data.find(documents(spark, texts, extra=True)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        want = brute(text)
        r = rows[i]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in personal_data.BASE] == want, text
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        kinds = [s.split(":")[0] for s in want]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds.count(k) for k in personal_data.BASE)


@pytest.mark.parametrize(
    "text, want",
    [
        ("write to jane.doe (at) mail.example (dot) org now", ["masked:jane.doe (at) mail.example (dot) org"]),
        ("jane[at]example.org", ["masked:jane[at]example.org"]),
        ("see https://user:pw@host.example.org:80/x and https://plain.example.org", ["email:pw@host.example.org", "address:https://user:pw@host.example.org:80"]),
        ("tel:030-123456 or sip:bob@example.org", ["address:tel:030-123456", "address:sip:bob@example.org", "email:bob@example.org"]),
        ("IBAN: DE89 3704 0044 0532 0130 00 thanks", ["account:DE89 3704 0044 0532 0130 00"]),
        ("IBAN: DE88 3704 0044 0532 0130 00", []),
        ("SSN 123-45-6789; Passport no. C01X00T47", ["account:123-45-6789", "account:C01X00T47"]),
        ("on account of the 4 winds, accountant 12345, an account in 2019 was", []),
        ("a clean line with 12 words and 3.5 percent", []),
    ],
)
def test_added_spans(text, want):
    got = [f"{kind}:{text[a:b]}" for a, b, kind in personal_data.spans_of(text)]
    assert sorted(got) == sorted(want)


ADDRESS = re.compile(r"[A-Za-z0-9._~%!$&'*+;=:-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?")


@pytest.mark.parametrize("seed", range(200))
def test_added_addresses_equal_trying_every_scheme(seed):
    """Every scheme is tried by itself with one pattern, and held against every base span."""
    rng = random.Random(seed)
    parts = [
        "mailto:", "sip:", "https://", "ftp://", "a@b.cc", "me", "@", ".org", ":80", "x@y.z", " ", "é", "1.2.3.4", "+1 555 0100 999", "user:pw", "MAILTO:", "/", "b.cc",
    ]
    text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
    spans = personal_data.spans_of(text)
    base = [(a, b) for a, b, kind in spans if kind in personal_data.BASE]
    want = set()
    for m in re.finditer("|".join(f"(?={s})" for s in ("http://", "https://", "ftp://", "ssh://", "mailto:", "sip:", "MAILTO:")), text):
        scheme = re.compile("[A-Za-z]+:(//)?").match(text, m.start())
        found = ADDRESS.match(text, scheme.end())
        if found and not any(a <= m.start() and found.end() <= b for a, b in base):
            want.add((m.start(), found.end()))
    assert sorted((a, b) for a, b, kind in spans if kind == "address") == sorted(want)


def test_long_chains_take_linear_time():
    start = time.time()
    assert personal_data.spans_of("mailto:" * 200_000) == []
    spans = personal_data.spans_of("mailto:" * 50_000 + "a@b.cc " + "c@d.ee " * 50_000)
    assert len(spans) == 100_001
    assert time.time() - start < 30


def test_redaction(spark):
    texts = ["mail a@b.cc or +1 (555) 010-9999 now", None, "", "clean é"]
    docs = documents(spark, texts, extra=True)
    out = personal_data.redact(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    want = "mail <EMAIL> or <PHONE> now"
    assert rows == {0: (want, len(want)), 1: (None, 0), 2: ("", 0), 3: ("clean é", 7)}
    for i in range(200):
        again = personal_data.redacted(noise(i))
        assert not EMAIL.search(again.replace("<EMAIL>", " "))
    assert personal_data.find(docs.limit(0)).collect() == []
