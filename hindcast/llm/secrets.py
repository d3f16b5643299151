"""Secret scans with character Markov models, in DataFrame functions only.

Base kinds: `assign`, a cue such as `password` or `api_key`, a colon or equals sign and a value of six or more characters;
`access`, AKIA and 16 or more capitals or digits; `hex`, 24 or more lower-case hexadecimal digits.

The method adds `random`: strings of `shortest` or more characters of [A-Za-z0-9+/_=-], one letter at least, outside base spans, whose
log-likelihood under a Markov chain of random strings exceeds that under a chain of ordinary identifiers by at least
`margin` per character. Both chains are first-order over the class; a character that rarely or never came before backs
off to the frequencies of single characters, and these are smoothed by one each. They are trained on labelled samples
from the table itself: the values that the base rules find and that hold both a letter and a digit, since others may be
words (random; at most `sample` distinct ones, the smallest hashes) and the words of at most `sample` distinct texts
without any (ordinary; only words too short to be judged, lest hidden secrets teach that chain). Copies of a text teach
as much as one. A corpus without either kind of sample trains that chain on nothing, which makes it uniform. Only the
two tables of character pairs reach the driver; their size is that of the alphabet squared.

Positions are code points, the end exclusive: matches and the gaps between them come from one pattern, and their lengths
add up. Every text is searched whole, by itself, without a shuffle and without Python on the executors.

Null text is empty. Repeated rows are treated alike; empty tables give an empty result; only the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:int,place:int,kind:string,end:int>>"
BLOCK = 256
#: How many observations the frequencies of single characters count for.
BACK_OFF = 4.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(x: Column) -> Column:
    """Sums of all earlier elements of a non-empty array, in blocks, so that long arrays take linear time."""
    n = F.size(x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, BLOCK))

    def before(values: Column) -> Column:
        start = F.array(F.lit(0))
        sums = F.aggregate(values, start, lambda out, v: F.concat(out, F.array(F.element_at(out, -1) + v)))
        return F.slice(sums, 1, F.size(values))

    def shifted(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda a, v: a + v))
        return F.flatten(F.zip_with(parts, before(totals), lambda part, shift: F.transform(before(part), lambda v: v + shift)))

    return _let(blocks, shifted)


def matches(text: Column, pattern: str, kind: str, good: Callable[[Column], Column] | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches of a pattern that are `good`."""

    def spans(found: Column) -> Column:
        def placed(sizes: Column) -> Column:
            starts = _running(F.transform(sizes, lambda s: s["gap"] + s["size"]))
            rows = F.zip_with(sizes, starts, lambda s, start: F.struct(
                (start + s["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("place"), F.lit(kind).alias("kind"),
                (start + s["gap"] + s["size"]).alias("end"), s["match"].alias("match"),
            ))
            rows = rows if good is None else F.filter(rows, lambda r: good(r["match"]))
            return F.transform(rows, lambda r: F.struct(*(r[c].alias(c) for c in ("start", "place", "kind", "end"))))

        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        sizes = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("match")))
        return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(_let(sizes, placed))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by start, then by the order of the kinds."""
    assign = matches(text, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6)
    return F.array_sort(F.concat(assign, matches(text, ACCESS, "access"), matches(text, HEX, "hex")))


def _pairs(strings: DataFrame, name: str) -> DataFrame:
    """How often one character of a string follows another: a (code), b (code) and the count."""
    at = F.explode(F.sequence(F.lit(1), F.length("s") - 1))
    pairs = strings.where(F.length("s") > 1).select("s", at.alias("i"))
    code = lambda shift: F.ascii(F.substring("s", F.col("i") + shift, 1))
    pairs = pairs.select(code(0).alias("a"), code(1).alias("b")).where("a < 128 AND b < 128")
    return pairs.groupBy("a", "b").agg(F.count("*").alias(name))


def train(docs: DataFrame, shortest: int = 16, sample: int = 2000) -> list[float]:
    """Log-likelihood ratio (random against ordinary) of each pair of ASCII codes a, b, at place 128 * a + b."""
    text = F.coalesce("text", F.lit(""))
    secret = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in ((ASSIGN, 2), (ACCESS, 0), (HEX, 0))))
    marked = docs.select(text.alias("text")).withColumn("secret", F.filter(secret, lambda s: F.length(s) >= 6))
    random = marked.select(F.explode("secret").alias("s")).where(F.col("s").rlike("[A-Za-z]") & F.col("s").rlike("[0-9]"))
    random = random.distinct().orderBy(F.xxhash64("s"), "s").limit(sample)
    clean = marked.where(F.size("secret") == 0).select(F.xxhash64("text").alias("h")).distinct()
    # The hashes of the sample are few; they choose its texts in a second read of the table.
    chosen = [r["h"] for r in clean.orderBy("h").limit(sample).collect()]
    hashed = docs.select(text.alias("text")).withColumn("h", F.xxhash64("text"))
    picked = hashed.where(F.col("h").isin(chosen)).dropDuplicates(["h"]) if chosen else hashed.limit(0)
    words = picked.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]+"), F.lit(0))).alias("s"))
    counts = []
    for strings in (random, words.where(F.length("s") < shortest)):
        counts.append({(r["a"], r["b"]): r["n"] for r in _pairs(strings, "n").collect()})
    random_chain, ordinary_chain = map(chain, counts)
    out = [0.0] * (128 * 128)
    for pair, p in random_chain.items():
        out[128 * pair[0] + pair[1]] = math.log(p / ordinary_chain[pair])
    return out


def chain(counts: dict[tuple[int, int], int]) -> dict[tuple[int, int], float]:
    """Probability of b after a, for all pairs of the alphabet, from the counts of pairs."""
    codes = list(map(ord, ALPHABET))
    single = {b: 1.0 for b in codes}
    for (_, b), n in counts.items():
        if b in single:
            single[b] += n
    whole = sum(single.values())
    out = {}
    for a in codes:
        row = [counts.get((a, b), 0) for b in codes]
        for b, n in zip(codes, row, strict=True):
            out[a, b] = (n + BACK_OFF * single[b] / whole) / (sum(row) + BACK_OFF)
    return out


def _ratio(token: Column, table: Column) -> Column:
    """Sum of the table's entries over the neighbouring characters of an ASCII string."""
    code = lambda i: F.ascii(F.substring(token, i, F.lit(1)))
    steps = F.sequence(F.lit(1), F.length(token) - 1)
    return F.aggregate(steps, F.lit(0.0), lambda sum_, i: sum_ + F.get(table, code(i) * 128 + code(i + 1)))


def find(docs: DataFrame, shortest: int = 16, margin: float = 0.5, sample: int = 2000) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans, one row per document."""
    ratios = train(docs, shortest, sample)
    # A folded constant: one literal instead of an expression per number.
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    token = rf"[A-Za-z0-9+/_=-]{{{shortest},}}"
    likely = lambda m: m.rlike("[A-Za-z]") & (_ratio(m, table) >= margin * F.length(m))
    random = matches(F.col("text"), token, "random", likely)
    found = docs.select("doc_id", base_spans(F.col("text")).alias("base"), random.alias("random"))
    apart = F.filter("random", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    found = found.select("doc_id", "base", F.array_sort(F.concat("base", apart)).alias("every"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("every", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, KINDS[:3]), F.sha2(listed("base"), 256).alias("base_sha256"), listed("every").alias("spans"), count("random")
    )
