"""Hard negatives for anchors by threshold joins over an inverted index with norm bounds.

Every anchor has positives, the best rows of its label, and for each of them a window of scores below the positive's; its
negatives are the best rows of other labels within the window. Both are threshold joins: all rows whose inner product
with an anchor reaches a threshold, for a threshold that is lowered until enough rows are found.

1. Dimensions are ordered by their energy over all rows. Rows and anchors are cut into blocks; every pair of a block of
   rows and a block of anchors is one task's work of bounded size. Positives are looked for per label.
2. Index. For a threshold t, a row is indexed in its first dimensions only: the last ones, whose norm times the largest
   norm of the anchors stays below t, are covered by that bound, and no row reaches t through them alone. Rows whose whole
   norm is too small are not indexed at all.
3. Scores are accumulated dimension by dimension (in strips) over the indexed rows. A pair whose partial score and
   remaining norms together stay below t is pruned; rows without a pair left leave the index.
4. What is left is scored exactly. Rows are taken by score; anchors whose windows are not full try the next threshold.
   Thresholds fall from the largest score that counts to the smallest, by a way that doubles.
5. Each block gives its best rows per window, so the best of them are the best of all. The windows follow from the
   positives, which are therefore merged before negatives are looked for.

Components become floor(scale * x). Scores are sums of products of integers, exact below 2^53 (products of 64-bit
floats). Rows with a null label, vector or component, with an infinite or undefined component, or without an id take no
part. Shorter vectors are filled with zeros. Of rows that share an id one takes part, the one with the smallest label, then
the smallest components; so a row is never its own partner. Equal scores go by the smaller id. A positive whose score is
not above zero has a window of one value (zero) or none. Empty tables, or tables without anchors, give an empty result.
Columns other than the id, the vector and the label are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import through_storage
from .text import batch_of, grouped, ship

#: Rows and anchors of a block, and dimensions of a strip.
ROWS, ANCHORS, STRIP = 16_384, 2_048, 8
#: Anchors scored at a time within a task.
TOGETHER = 128
#: How far thresholds are lowered, from one attempt to the next.
STEPS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0)
SCORED = "anchor_id long, partner_id long, score long"
FOUND = pa.schema([("anchor_id", pa.int64()), ("partner_id", pa.int64()), ("score", pa.int64())])
NEGATIVES = pa.schema(
    [("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("partner_id", pa.int64()), ("score", pa.int64())]
)


class Index:
    """The rows of a block, indexed for threshold joins with anchors of a norm up to `reach`."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        # after[:, s] is the norm of a row's dimensions from s on.
        squares = np.cumsum((vectors**2)[:, ::-1], axis=1)[:, ::-1]
        self.after = np.sqrt(np.concatenate([squares, np.zeros((len(vectors), 1))], axis=1))

    def reaching(self, anchors: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (place of the anchor, place of the row) with a score of at least the anchor's threshold, and the score."""
        own = Index(anchors)
        # Floating point bounds are taken a little too wide; scores themselves are exact.
        low = threshold - 1e-6 * (1 + np.abs(threshold))
        dims = self.vectors.shape[1]
        reach, lowest = own.after.max(axis=0), low.min()
        # Indexed are the dimensions up to the first from which on the norms stay below the threshold.
        indexed = (self.after * reach[0] >= lowest).sum(axis=1) if lowest > 0 else np.full(len(self.vectors), dims + 1)
        rows = np.flatnonzero(indexed > 0)
        partial_scores = np.zeros((len(anchors), len(rows)))
        for start in range(0, dims, STRIP):
            if not len(rows):
                break
            stop = min(start + STRIP, dims)
            strip = np.where(np.arange(start, stop) < indexed[rows, None], self.vectors[rows, start:stop], 0.0)
            partial_scores += anchors[:, start:stop] @ strip.T
            # What is not accumulated yet, or not indexed, counts with its norms.
            done = np.minimum(indexed[rows], stop)
            bound = partial_scores + self.after[rows, done] * own.after[:, done]
            alive = (bound >= low[:, None]).any(axis=0)
            if not alive.all():
                rows, partial_scores, bound = rows[alive], partial_scores[:, alive], bound[:, alive]
        if not len(rows):
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        i, j = np.nonzero(bound >= low[:, None]) if dims else np.nonzero(partial_scores >= low[:, None])
        scores = np.empty(len(i), np.int64)
        for first in range(0, len(i), 1 << 16):
            some = slice(first, first + (1 << 16))
            scores[some] = np.einsum("ij,ij->i", anchors[i[some]], self.vectors[rows[j[some]]]).astype(np.int64)
        ok = scores >= threshold[i]
        return i[ok], rows[j[ok]], scores[ok]


def lowered(top: np.ndarray, floor: np.ndarray, share: float) -> np.ndarray:
    """Thresholds that go `share` of the way from `top` down to `floor`."""
    return np.ceil(top - (top - floor) * share)


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dims)


def _best(anchor: np.ndarray, score: np.ndarray, partner: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` best partners of each anchor, by score, then by id."""
    order = np.lexsort((partner, -score, anchor))
    first = np.searchsorted(anchor[order], anchor[order], side="left")
    return order[np.arange(len(order)) - first < most]


def _sides(group: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The rows and the anchors of a pair of blocks."""
    return group.filter(pc.invert(group["is_anchor"])), group.filter(group["is_anchor"])


def _positives(batches: Iterable[pa.RecordBatch], dims: int, most: int) -> Iterator[pa.RecordBatch]:
    """Per block of one label's rows and anchors: the best rows of each anchor."""
    for group in grouped(batches, ["label", "rows", "anchors"]):
        rows, anchors = _sides(group)
        if not len(rows) or not len(anchors):
            continue
        ids, index = rows["vec_id"].to_numpy(), Index(_matrix(rows["vector"], dims))
        own_ids, own = anchors["vec_id"].to_numpy(), _matrix(anchors["vector"], dims)
        for start in range(0, len(own), TOGETHER):
            some = np.arange(start, min(start + TOGETHER, len(own)))
            # No score is beyond the product of the norms.
            widest = np.ceil(np.sqrt((own[some] ** 2).sum(axis=1)) * index.after[:, 0].max()) + 1
            for share in STEPS:
                t = lowered(widest, -widest, share)
                i, j, score = index.reaching(own[some], t)
                other = own_ids[some[i]] != ids[j]
                i, j, score = i[other], j[other], score[other]
                full = (np.bincount(i, minlength=len(some)) >= most) | (t <= -widest)
                best = _best(i, score, ids[j], most)
                best = best[full[i[best]]]
                yield batch_of(FOUND, [own_ids[some[i[best]]], ids[j[best]], score[best]])
                some, widest = some[~full], widest[~full]
                if not len(some):
                    break


def _negatives(batches: Iterable[pa.RecordBatch], dims: int, most: int) -> Iterator[pa.RecordBatch]:
    """Per block of rows and anchors with their windows: the best rows of other labels in each window."""
    for group in grouped(batches, ["rows", "anchors"]):
        rows, anchors = _sides(group)
        if not len(rows) or not len(anchors):
            continue
        ids, labels, index = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), Index(_matrix(rows["vector"], dims))
        own_ids, own_labels, own = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), _matrix(anchors["vector"], dims)
        windows = [x if x is not None else [] for x in anchors["windows"].to_pylist()]
        for start in range(0, len(own), TOGETHER):
            stop = min(start + TOGETHER, len(own))
            # A window belongs to one anchor; all windows of an anchor share its scores.
            flat = [(k, w["partner_id"], w["score"], w["low"], w["high"]) for k in range(start, stop) for w in windows[k]]
            if not flat:
                continue
            anchor, positive, positive_score, low, high = (np.array(x, np.int64) for x in zip(*flat, strict=True))
            top, floor = np.full(len(own), -np.inf), np.full(len(own), np.inf)
            np.maximum.at(top, anchor, high.astype(float))
            np.minimum.at(floor, anchor, low.astype(float))
            open_ = np.arange(len(flat))
            for share in STEPS:
                some = np.unique(anchor[open_])
                t = np.zeros(len(own))
                t[some] = lowered(top[some], floor[some], share)
                i, j, score = index.reaching(own[some], t[some])
                other = (own_ids[some[i]] != ids[j]) & (own_labels[some[i]] != labels[j])
                i, j, score = some[i[other]], j[other], score[other]
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                done = []
                for w in open_.tolist():
                    # An anchor's rows stand by score: those at or below the top of the window come first.
                    a, b = np.searchsorted(i, [anchor[w], anchor[w] + 1])
                    a += np.searchsorted(-score[a:b], -high[w])
                    b = a + np.searchsorted(-score[a:b], -low[w], side="right")
                    if b - a >= most or t[anchor[w]] <= low[w]:
                        done.append(w)
                        k = slice(a, min(b, a + most))
                        n = k.stop - k.start
                        if n:
                            fixed = [np.full(n, x) for x in (own_ids[anchor[w]], positive[w], positive_score[w])]
                            yield batch_of(NEGATIVES, [*fixed, ids[j[k]], score[k]])
                open_ = np.setdiff1d(open_, done)
                if not len(open_):
                    break


def vectors_of(rows: DataFrame, id_col: str, vector: str, label: str, scale: float) -> tuple[DataFrame, int]:
    """vec_id, label, vector (64-bit floats of the integer components, dimensions by falling energy), and their number."""
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    valid = F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite
    kept = rows.where(valid).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole.alias("parts")
    )
    one = kept.groupBy("vec_id").agg(F.min(F.struct("label", "parts")).alias("one"))
    kept = through_storage(one.select("vec_id", "one.label", "one.parts"), "vectors")
    energy = kept.select(F.posexplode("parts").alias("dim", "x")).groupBy("dim").agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    order = [r["dim"] for r in sorted(energy.collect(), key=lambda r: (-r["e"], r["dim"]))]
    run = partial(_ordered, order=order)
    return kept.mapInArrow(run, "vec_id long, label long, vector binary"), len(order)


def _ordered(batches: Iterable[pa.RecordBatch], order: list[int]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary())])
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            lists = part.column(2)
            size = np.diff(lists.offsets.to_numpy())
            matrix = np.zeros((len(part), max(len(order), int(size.max(initial=0)))))
            row = np.repeat(np.arange(len(part)), size)
            matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy(zero_copy_only=False)
            yield batch_of(kind, [part.column(0), part.column(1), [x.tobytes() for x in matrix[:, order].astype("<f8")]])


def _block(n: Column) -> Column:
    return F.pmod(F.xxhash64("vec_id"), n)


def _blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def _pairs_of_blocks(rows: DataFrame, anchors: DataFrame, extra: list[str]) -> DataFrame:
    """Each row once per block of anchors and each anchor once per block of rows; n_rows and n_anchors are the blocks."""
    columns = ["vec_id", "label", "vector", *extra]
    one = rows.withColumn("rows", _block(F.col("n_rows"))).withColumn("anchors", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_anchors") - 1)))
    other = anchors.withColumn("anchors", _block(F.col("n_anchors"))).withColumn("rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)))
    return one.select("rows", "anchors", F.lit(False).alias("is_anchor"), *columns).unionAll(
        other.select("rows", "anchors", F.lit(True).alias("is_anchor"), *columns)
    )


def _dealt(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.repartition(*keys).sortWithinPartitions(*keys)


def best_positives(vectors: DataFrame, anchor: Column, dims: int, most: int, rows: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, partner_id, score: the `most` best other rows of the label of each row for which `anchor` holds."""
    count = lambda c, size: F.ceil(F.sum(c.cast("long")) / size).cast("long")
    sizes = vectors.groupBy("label").agg(count(F.lit(1), rows).alias("n_rows"), count(anchor, anchors).alias("n_anchors"))
    sized = vectors.join(sizes.where("n_anchors > 0"), "label")
    pairs = _pairs_of_blocks(sized, sized.where(anchor), [])
    found = _dealt(pairs, ["label", "rows", "anchors"]).mapInArrow(partial(_positives, dims=dims, most=most), SCORED)
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "partner_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block_rows: int = ROWS, block_anchors: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchor` is a condition on vec_id. Per anchor and positive the `negatives` best rows of other labels whose score is
    `low` to `high` percent of the positive's.
    """
    ship(rows.sparkSession)
    vectors, dims = vectors_of(rows, id_col, vector, label, scale)
    vectors = through_storage(vectors, "ordered-vectors")
    best = through_storage(best_positives(vectors, anchor, dims, positives, block_rows, block_anchors), "positives")
    least = -F.floor(-F.col("score") * low / 100)
    window = F.struct("partner_id", "score", least.cast("long").alias("low"), F.floor(F.col("score") * high / 100).cast("long").alias("high"))
    windows = best.where("score >= 0").groupBy("anchor_id").agg(F.collect_list(window).alias("windows"))
    n, n_anchors = vectors.count(), windows.count()
    blocks = {"n_rows": F.lit(_blocks(n, block_rows)).cast("long"), "n_anchors": F.lit(_blocks(n_anchors, block_anchors)).cast("long")}
    asked = vectors.where(anchor).join(windows, F.col("vec_id") == F.col("anchor_id")).withColumns(blocks)
    pairs = _pairs_of_blocks(vectors.withColumns(blocks | {"windows": F.lit(None).cast(windows.schema["windows"].dataType)}), asked, ["windows"])
    kind = "anchor_id long, positive_id long, positive_score long, partner_id long, score long"
    found = _dealt(pairs, ["rows", "anchors"]).mapInArrow(partial(_negatives, dims=dims, most=negatives), kind)
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("score"), "partner_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select(
        "anchor_id", "positive_id", "rank", F.col("partner_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
