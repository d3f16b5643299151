"""Quality rules by line labelling: a linear-chain conditional random field marks each line content or boilerplate.

Base counts of a text (words are runs without space and U+0009 to U+000D):
n_words; word_chars, code points in words; n_symbols, characters of [#*$%&|<>]; n_dup_lines, lines with a word that
equal an earlier line; n_repeat_words, words in windows of eight words found twice or more in the text.
base_failed: fewer than 20 words, or more than 30 % of the words in repeated windows.

Lines with a word are labelled by Viterbi decoding: a line's score for content is the sum of one weight per feature
group (length, upper case, symbols, digits, punctuation, word length, ending, repetition), and neighbouring labels have
transition scores. A text is kept if it does not fail the base rules and lines marked content hold at least
`min_share` of its words.

The field is fitted on at most `sample` labelled documents of either quality (those with the smallest hashes of their
ids): all lines of a good document count as content, all of a bad one as boilerplate. Fitting maximises the penalised
likelihood with exact marginals. Without labelled documents of both kinds every line is content. Everything else is
done for each text by itself, whole, in one pass without a shuffle.

Null text has no words and fails the base rules. Repeated rows are judged alike; empty tables give an empty result;
only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, batch_of, chunks, mix, ship

RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
        ("n_lines", pa.int64()), ("content_words", pa.int64()),
    ]
)
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, content_words long"
)
LINES = pa.schema([("quality", pa.int32()), ("features", pa.binary())])

SYMBOLS, UPPER, DIGITS, PUNCTUATION, LETTERS, ENDS = (np.zeros(256, bool) for _ in range(6))
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER[ord("A") : ord("Z") + 1] = True
DIGITS[ord("0") : ord("9") + 1] = True
PUNCTUATION[list(b"!?.,;:-_()[]{}\"'/\\")] = True
LETTERS[ord("a") : ord("z") + 1] = True
LETTERS |= UPPER
ENDS[list(b".!?")] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True

#: Upper edges of the classes of each feature group; a group has one class more than edges.
SHARES = (0.02, 0.1, 0.25, 0.5, 0.8)
EDGES = {
    "words": (1, 2, 5, 10, 20, 50),
    "upper": SHARES,
    "symbols": (0.0, *SHARES),
    "digits": (0.0, *SHARES),
    "punctuation": (0.0, 0.02, 0.05, 0.1, 0.2),
    "word_length": (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0),
    "end": (0,),
    "repeated": (0,),
}
WIDTH = max(len(e) for e in EDGES.values()) + 1


class Lines:
    """Base counts of the texts of a batch, and the features of all their lines."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        lines = Words(texts, NEWLINE)
        data, n = words.data, len(words.data)

        def running(flags: np.ndarray) -> np.ndarray:
            out = np.zeros(n + 1, np.int64)
            np.cumsum(flags, out=out[1:])
            return out

        points = (data & 0xC0) != 0x80
        chars = running(words.inside & points)
        symbols = running(SYMBOLS[data])
        at = words.offsets
        self.n_words = words.counts
        self.word_chars = np.diff(chars[at])
        self.n_symbols = np.diff(symbols[at])
        hashes = words.hashes(1)
        self.n_repeat_words = self._repeated(words, hashes)

        # Lines with a word, their texts, and how many words each has.
        first = np.searchsorted(words.starts, lines.starts)
        count = np.searchsorted(words.starts, lines.ends) - first
        full = np.flatnonzero(count > 0)
        begin, end, self.count = lines.starts[full], lines.ends[full], count[full]
        text = lines.texts[full]
        self.edges = np.searchsorted(text, np.arange(len(at)))
        repeated = _seen_before(lines.hashes(2)[full], text)
        self.n_dup_lines = np.diff(np.concatenate([[0], np.cumsum(repeated)])[self.edges])

        size = np.maximum(chars[end] - chars[begin], 1)
        share = lambda run: (run[end] - run[begin]) / size
        # Capital Latin letters beyond ASCII follow byte C3 in UTF-8.
        wide = np.zeros(n, bool)
        wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        values = {
            "words": self.count,
            "upper": share(running(UPPER[data] | wide)),
            "symbols": share(symbols),
            "digits": share(running(DIGITS[data])),
            "punctuation": share(running(PUNCTUATION[data])),
            "word_length": size / self.count,
            "end": ENDS[data[words.ends[first[full] + self.count - 1] - 1]] if n else np.zeros(0),
            "repeated": repeated,
        }
        self.features = np.stack(
            [i * WIDTH + np.searchsorted(EDGES[name], v, side="left") for i, (name, v) in enumerate(values.items())], axis=1
        ).astype(np.uint8)

    @staticmethod
    def _repeated(words: Words, hashes: np.ndarray, size: int = 8) -> np.ndarray:
        starts, windows = words.windows(hashes, size)
        n = len(hashes)
        keys = mix(windows + (words.texts[starts].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        found = starts[twice]
        cover = np.bincount(found, minlength=n + 1) - np.bincount(found + size, minlength=n + 1)
        return np.diff(np.concatenate([[0], np.cumsum(np.cumsum(cover)[:n] > 0)])[words.first])

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)


def _seen_before(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    order = np.lexsort((hashes, text))  # stable: equal lines stay in the order of the text
    out = np.zeros(len(order), bool)
    same = (hashes[order[1:]] == hashes[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    out[order[1:][same]] = True
    return out


class Field:
    """A chain over two labels: `weights` per feature (content against boilerplate) and a score per pair of labels."""

    def __init__(self, weights: np.ndarray | None = None, pairs: np.ndarray | None = None):
        self.weights = np.zeros(len(EDGES) * WIDTH) if weights is None else weights
        self.pairs = np.zeros((2, 2)) if pairs is None else pairs

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1)

    def decode(self, emissions: list[float]) -> list[bool]:
        """Viterbi: whether each line is content; ties are content."""
        (bb, bc), (cb, cc) = self.pairs.tolist()
        boiler, content, back = 0.0, 0.0, []
        for i, score in enumerate(emissions):
            if i:
                to_b, to_c = content + cb >= boiler + bb, content + cc >= boiler + bc
                back.append((to_b, to_c))
                boiler, content = (content + cb if to_b else boiler + bb), (content + cc if to_c else boiler + bc)
            content += score
        label = content >= boiler
        out = [label]
        for to_b, to_c in reversed(back):
            label = to_c if label else to_b
            out.append(label)
        return out[::-1] if emissions else []


def fit(texts: list[np.ndarray], labels: list[int], rounds: int = 150, rate: float = 0.1, penalty: float = 1.0) -> Field:
    """Fit a field to texts (features of their lines), all lines of a text having its label.

    Adam on the penalised log-likelihood; expected counts come from forward and backward sums, for all texts at once.
    """
    field = Field()
    texts, labels = zip(*[(t, y) for t, y in zip(texts, labels, strict=True) if len(t)], strict=True) if texts else ((), ())
    if len(set(labels)) < 2:
        return field
    order = np.argsort([-len(t) for t in texts], kind="stable")
    texts, y = [texts[i] for i in order], np.array([labels[i] for i in order])
    sizes = np.array([len(t) for t in texts])
    steps = int(sizes[0])
    alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(steps)]  # texts with more than t lines come first
    at = [np.stack([x[t] for x in texts[: alive[t]]]) for t in range(steps)]
    weigh = 1.0 / np.maximum(np.bincount(np.repeat(y, sizes), minlength=2), 1)  # both labels count the same in all
    scale = weigh[y] * sizes.sum() / 2
    flat = np.concatenate([a.ravel() for a in at])
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (scale * (sizes - 1))[y == label].sum()
    first, second, moments = np.zeros(len(field.weights) + 4), np.zeros(len(field.weights) + 4), (0.9, 0.999)
    for step in range(1, rounds + 1):
        e = [field.weights[a].sum(axis=1) for a in at]
        pairs = np.exp(field.pairs)
        forward, scales = [], []
        for t in range(steps):
            n = alive[t]
            now = np.stack([np.ones(n), np.exp(np.clip(e[t], -30, 30))], axis=1)
            if t:
                now = now * (forward[-1][:n] @ pairs)
            total = now.sum(axis=1, keepdims=True)
            forward.append(now / total)
            scales.append(total)
        backward = np.ones((alive[-1], 2))
        found, expected = [None] * steps, np.zeros((2, 2))
        for t in range(steps - 1, -1, -1):
            if len(backward) < alive[t]:
                backward = np.concatenate([backward, np.ones((alive[t] - len(backward), 2))])
            found[t] = (forward[t] * backward)[:, 1] / (forward[t] * backward).sum(axis=1)
            if t:
                n = alive[t]
                ahead = np.stack([np.ones(n), np.exp(np.clip(e[t], -30, 30))], axis=1) * backward / scales[t]
                joint = forward[t - 1][:n, :, None] * pairs * ahead[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                expected += (scale[:n, None, None] * joint).sum(axis=0)
                backward = np.concatenate([ahead @ pairs.T, np.ones((alive[t - 1] - n, 2))])
        over = np.concatenate([np.repeat(scale[: alive[t]] * (y[: alive[t]] - found[t]), at[t].shape[1]) for t in range(steps)])
        gradient = np.bincount(flat, weights=over, minlength=len(field.weights)) - penalty * field.weights
        gradient = np.concatenate([gradient, (seen - expected - penalty * field.pairs).ravel()]) / sizes.sum()
        first = moments[0] * first + (1 - moments[0]) * gradient
        second = moments[1] * second + (1 - moments[1]) * gradient**2
        move = rate * (first / (1 - moments[0] ** step)) / (np.sqrt(second / (1 - moments[1] ** step)) + 1e-8)
        field = Field(field.weights + move[:-4], field.pairs + move[-4:].reshape(2, 2))
    return field


def windows(features: np.ndarray, lines: int, most: int) -> list[bytes]:
    """A text's features as runs of at most `lines` lines; of more than `most` runs those with the smallest digests."""
    runs = [features[i : i + lines].tobytes() for i in range(0, len(features), lines)]
    return runs if len(runs) <= most else sorted(runs, key=lambda run: hashlib.md5(run).digest())[:most]


def _line_features(batches: Iterable[pa.RecordBatch], lines: int, most: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        found = Lines(batch.column(1))
        spans = zip(batch.column(0).to_pylist(), found.edges[:-1], found.edges[1:], strict=True)
        rows = [(quality, run) for quality, a, b in spans for run in windows(found.features[a:b], lines, most)]
        yield batch_of(LINES, list(zip(*rows, strict=True)) if rows else [[], []])


def train(docs: DataFrame, labels: DataFrame, sample: int = 1000, lines: int = 64, most: int = 4) -> Field:
    """The field fitted on at most `sample` labelled documents of either quality, `most` runs of `lines` lines of each.

    Of rows that share an id, the one with the smallest hash of its text is taken.
    """
    ship(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    rows = [r for part in chosen for r in part.collect()]
    if not rows:
        return Field()
    # At most 2 * sample ids, whatever the tables hold.
    picked = docs.sparkSession.createDataFrame(rows, "doc_id long, quality int").dropDuplicates(["doc_id"])
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality")
    texts = texts.agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("quality", "text")
    got = texts.mapInArrow(partial(_line_features, lines=lines, most=most), "quality int, features binary").collect()
    got.sort(key=lambda r: (r["quality"], bytes(r["features"])))
    features = [np.frombuffer(r["features"], np.uint8).reshape(-1, len(EDGES)) for r in got]
    return fit(features, [r["quality"] for r in got])


def _verdicts(texts: pa.Array, field: Field, min_share: float) -> tuple[Lines, np.ndarray, np.ndarray]:
    """Base counts, words in content lines, and the verdict, for each text."""
    lines = Lines(texts)
    scores = field.emissions(lines.features).tolist()
    edges = lines.edges.tolist()
    labels = [x for a, b in zip(edges[:-1], edges[1:], strict=True) for x in field.decode(scores[a:b])]
    content = np.concatenate([[0], np.cumsum(lines.count * np.array(labels, bool))])[lines.edges]
    content = np.diff(content).astype(np.int64)
    return lines, content, ~lines.base_failed & (content >= min_share * lines.n_words)


def _judge(batches: Iterable[pa.RecordBatch], field: Field, min_share: float) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        lines, content, kept = _verdicts(batch.column(1), field, min_share)
        counts = [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words]
        yield batch_of(RESULT, [batch.column(0), *counts, lines.base_failed, kept, np.diff(lines.edges), content])


def _keep(batches: Iterable[pa.RecordBatch], field: Field, min_share: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [_verdicts(part.column("text"), field, min_share)[2] for part in chunks([batch], "text")]
        yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))


def judge(docs: DataFrame, labels: DataFrame, min_share: float = 0.5, sample: int = 1000) -> DataFrame:
    """Counts and verdict for every document."""
    run = partial(_judge, field=train(docs, labels, sample), min_share=min_share)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, min_share: float = 0.5, sample: int = 1000) -> DataFrame:
    """The rows of `docs`, with all their columns, that the rules keep."""
    run = partial(_keep, field=train(docs, labels, sample), min_share=min_share)
    return docs.mapInArrow(run, docs.schema)
