"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus signs, address schemes and identifier cues. From each
anchor a small deterministic parser reads left and right for the boundaries and validates what it finds:

* `email`: the local part left of an at-sign and the domain right of it;
* `ip` and `card`: anchored at digits; parts up to 255; 12 to 19 digits that pass the Luhn check;
* `phone`: right of a plus sign, 9 to 15 digits;
* `masked`: an email address whose at-sign is spelt `(at)` or `[at]`;
* `address`: right of a scheme, an address with a user part (`https://user@host`, `mailto:`, `sip:`) or a `tel:` number;
* `account`: right of a cue such as `iban`, `ssn`, `passport` or `account no`, an identifier with at least four digits; an
  IBAN must pass its check digits.

The first four are the base kinds. Spans of the others are added where they do not lie within a base span. Spans are code
points, the end exclusive. Every text is read whole, in one pass without a shuffle.

Null text is empty. Repeated rows are treated alike; empty tables give an empty result. `find` reads only the id and the
text; `redact` keeps all columns.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import batch_of, chunks, ship

Span = tuple[int, int, str]
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "masked", "address", "account")
RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), *((f"n_{kind}", pa.int64()) for kind in BASE), ("base_sha256", pa.string()),
        ("spans", pa.string()), *((f"n_{kind}", pa.int64()) for kind in KINDS[4:]),
    ]
)
SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "n_masked long, n_address long, n_account long"
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does; saying so keeps long runs from being tried at every digit.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MASKED = re.compile(
    r"\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]+)*\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2,}", re.I
)
_USER = re.compile(r"[A-Za-z0-9._~%!$&'*+;=:-]++")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?")
_TEL = re.compile(r"\+?[0-9](?:[().-]?[0-9]){5,14}")
_CUE_TAIL = re.compile(r"(?:[\x20_-]?(?:no|nr|num|number|id|code))?\.?\x20{0,2}[:#=]{0,2}\x20{0,2}(?:is\x20)?([A-Za-z0-9](?:[\x20-]?[A-Za-z0-9]){3,33})", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")

CUES = ("iban", "ssn", "social security", "passport", "account", "acct", "customer id", "user id", "tax id", "kontonummer")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:", "sip:", "tel:")


def _email(text: str, at: int, free: int) -> tuple[int, int] | None:
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phone(text: str, at: int) -> tuple[int, int] | None:
    m = _PHONE.match(text, at)
    return m.span() if m and 9 <= len(_DIGIT.findall(m[0])) <= 15 else None


def _masked(text: str, at: int, end: int) -> tuple[int, int] | None:
    left = at - 1 if at and text[at - 1] == " " else at
    start = left
    while start and text[start - 1] in _LOCAL:
        start -= 1
    domain = _MASKED.match(text, end) if start < left else None
    return (start, domain.end()) if domain else None


class _Addresses:
    """Reads addresses; a run of user characters that holds several schemes is read once."""

    def __init__(self) -> None:
        self.run = range(0)
        self.stop: int | None = None

    def __call__(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        if text[start:end].lower() == "tel:":
            found = _TEL.match(text, end)
            return (start, found.end()) if found else None
        if end not in self.run:
            user = _USER.match(text, end)
            if not user:
                return None
            host = _HOST.match(text, user.end())
            self.run, self.stop = range(*user.span()), host.end() if host else None
        return (start, self.stop) if self.stop else None


def _account(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The identifier behind a cue: up to the last word that still has a digit."""
    if start and text[start - 1].isalnum():
        return None
    found = _CUE_TAIL.match(text, end)
    if not found or found.start(1) == end:
        return None
    words = re.split(r"(\x20)", found[1])
    while words and not any(c.isdigit() for c in words[-1]):
        words.pop()
    own = "".join(words)
    first = own.split(" ")[0] if words else ""
    if sum(c.isdigit() for c in own) < 4 or not any(c.isdigit() for c in first):
        return None
    compact = own.replace(" ", "").replace("-", "")
    if text[start:end].lower() == "iban" and not (_IBAN.fullmatch(compact) and _iban(compact)):
        return None
    return found.start(1), found.start(1) + len(own)


def _iban(compact: str) -> bool:
    turned = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    """Anchors; words in lower, upper and title case."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for kind, words in (("masked", ("(at)", "[at]")), ("address", SCHEMES), ("account", CUES)):
        for word in words:
            for form in {word, word.upper(), word.capitalize(), word.title()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


_AUTOMATON: list[ahocorasick.Automaton] = []


def spans_of(text: str) -> list[Span]:
    """(start, end, kind) of all personal data in a text, by start, then by the order of the kinds."""
    if not _AUTOMATON:
        _AUTOMATON.append(automaton())
    base: list[Span] = []
    more: list[Span] = []
    mailed = 0
    parsers: dict[str, Callable] = {"masked": _masked, "address": _Addresses(), "account": _account}
    for last, (kind, size) in _AUTOMATON[0].iter(text):
        start, end = last + 1 - size, last + 1
        if kind == "email":
            found = _email(text, start, mailed) if start >= mailed else None
            mailed = found[1] if found else mailed
        elif kind == "phone":
            found = _phone(text, start)
        else:
            found = parsers[kind](text, start, end)
        if found:
            (base if kind in BASE else more).append((*found, kind))
    if _DIGIT.search(text):
        base += [(*s, "ip") for s in _ips(text)]
        base += [(*s, "card") for s in _cards(text)]
    if more:
        more = _outside(dict.fromkeys(more), sorted(base))
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _outside(spans: Iterable[Span], base: list[Span]) -> list[Span]:
    """The spans that no base span contains: of base spans up to a start, the farthest end decides."""
    starts = [b[0] for b in base]
    reach = list(accumulate((b[1] for b in base), max))
    found = []
    for span in spans:
        at = bisect_right(starts, span[0])
        if not at or reach[at - 1] < span[1]:
            found.append(span)
    return found


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = spans_of(text)
            kinds = [kind for _, _, kind in spans]
            base = hashlib.sha256(_listed([s for s in spans if s[2] in BASE]).encode()).hexdigest()
            n = [kinds.count(kind) for kind in KINDS]
            rows.append((doc, *n[:4], base, _listed(spans), *n[4:]))
        yield batch_of(RESULT, list(zip(*rows, strict=True)) if rows else [[]] * 10)


def find(docs: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans, one row per document."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_find, SCHEMA)


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in capitals; overlapping spans become one, named after the first."""
    out, done = [], 0
    merged: list[list] = []
    for start, end, kind in spans_of(text):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[done:start], f"<{kind.upper()}>"]
        done = end
    return "".join([*out, text[done:]])


def _redact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [None if t is None else redacted(t) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced; `n_chars`, where there is one, follows the text."""
    ship(docs.sparkSession)
    out = docs.mapInArrow(_redact, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out
