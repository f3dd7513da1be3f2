"""Hard-negative mining: exact integer scores by Strassen's multiplication, then heaps.

Vectors become integers ``floor(scale * x)``. Anchors go in blocks of bounded size to all
candidates; a task multiplies int64 tiles by Strassen's recursion (seven products of half
tiles, zero rows and columns where a side is odd) and keeps, for every anchor, a heap of
its best positives, then a heap of the best negatives in each positive's window. Heaps of
different tasks merge by rank, so only heap entries are shuffled. Sums and products wrap
around at 64 bits, which leaves every score exact that fits.

Rows with a null id or label, a null vector, or a null or non-finite component take no
part, nor does one whose squared integer length is 2^57 or more (its scores might not fit).
Of rows with one id the one with the smallest label and vector counts. Shorter vectors are
filled up with zeros; an empty one scores 0. Equal scores rank by the smaller id. An empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiergraph.llm.common import stored

#: Anchors of one broadcast block: 8 MB at 64 dimensions.
BLOCK_ANCHORS = 16_384
#: Blocks that are worked on, and broadcast, at the same time.
LIVE_BLOCKS = 4
#: Rows of one tile on the anchors' and on the candidates' side.
TILE = (256, 1024)
#: A side of this many rows is multiplied directly.
LEAF = 16
#: Candidates of a part: more parts mean more heap entries, fewer mean fewer tasks.
PART_ROWS, MOST_PARTS = 4_096, 64
MOST_LENGTH = float(1 << 57)
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b.T`` of int64 tiles; ``b`` has its rows in memory order, as vectors come."""
    (m, k), n = a.shape, len(b)
    if min(m, k, n) <= leaf:
        return a @ b.T
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if n % 2 or k % 2:
        b = np.pad(b, ((0, n % 2), (0, k % 2)))
    h, w, v = len(a) // 2, a.shape[1] // 2, len(b) // 2
    a11, a12, a21, a22 = a[:h, :w], a[:h, w:], a[h:, :w], a[h:, w:]
    b11, b21, b12, b22 = b[:v, :w], b[:v, w:], b[v:, :w], b[v:, w:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * v), np.int64)
    out[:h, :v] = p1 + p4 - p5 + p7
    out[:h, v:] = p3 + p5
    out[h:, :v] = p2 + p4
    out[h:, v:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """For each of ``n`` keys the best ``k`` (score, id): higher scores, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), NONE, np.int64)
        self.id = np.zeros((n, k), np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer ``scores[i, j]`` of candidate ``ids[j]``, ids ascending, to key ``rows[i]``.

        ``NONE`` marks cells that are no candidates.
        """
        k = self.score.shape[1]
        best = scores.max(axis=1, initial=NONE)
        some = (best > NONE) & (best >= self.score[rows, k - 1])
        rows, scores = rows[some], scores[some]
        if not len(rows):
            return
        at = np.arange(len(rows))
        new, who = [self.score[rows]], [self.id[rows]]
        for _ in range(k):
            top = scores.argmax(axis=1)  # the first of equal ones, so the smallest id
            new.append(scores[at, top][:, None])
            who.append(ids[top][:, None])
            scores[at, top] = NONE
        new, who = np.hstack(new), np.hstack(who)
        # The order of ~score is that of -score, without its overflow.
        order = np.lexsort((who, ~new), axis=1)[:, :k]
        self.score[rows] = np.take_along_axis(new, order, 1)
        self.id[rows] = np.take_along_axis(who, order, 1)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, score and id of every entry."""
        key, place = np.nonzero(self.score > NONE)
        return key, self.score[key, place], self.id[key, place]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), max(width, int(sizes.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _columns(batch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy() for n in names]


def _tiles(batches: Iterator[pa.RecordBatch], width: int):
    """Candidates by tiles, ids ascending inside each."""
    for batch in batches:
        ids, labels = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("id", "label"))
        q = _matrix(batch.column("q"), width)
        order = np.argsort(ids)
        for i in range(0, len(order), TILE[1]):
            part = order[i : i + TILE[1]]
            yield ids[part], labels[part], q[part]


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    pad = lambda x: np.pad(x, ((0, 0), (0, wide - x.shape[1]))) if x.shape[1] < wide else x
    return pad(a), pad(b)


def best_positives(ids, labels, q, k: int, tiles) -> Heaps:
    """The best rows of each anchor's own label; only tiles of one label are multiplied."""
    heaps = Heaps(len(ids), k)
    mine = {label: np.flatnonzero(labels == label) for label in np.unique(labels)}
    for other, their_labels, vectors in tiles:
        for label in np.unique(their_labels):
            anchors = mine.get(label, ())
            pick = np.flatnonzero(their_labels == label)
            for i in range(0, len(anchors), TILE[0]):
                rows = anchors[i : i + TILE[0]]
                scores = strassen(*_same_width(q[rows], vectors[pick]))
                scores[ids[rows][:, None] == other[pick][None, :]] = NONE
                heaps.add(rows, scores, other[pick])
    return heaps


def best_negatives(labels, q, positives: np.ndarray, known: np.ndarray, k: int, window: Callable, tiles) -> Heaps:
    """The best rows of other labels in the window of each (anchor, place of positive)."""
    n, places = positives.shape
    heaps = Heaps(n * places, k)
    low, high = window(positives)
    for other, their_labels, vectors in tiles:
        for i in range(0, n, TILE[0]):
            rows = np.arange(i, min(i + TILE[0], n))
            scores = strassen(*_same_width(q[rows], vectors))
            scores[labels[rows][:, None] == their_labels[None, :]] = NONE
            for j in range(places):
                least = np.maximum(low[rows, j], heaps.score[rows * places + j, k - 1])
                fits = (scores <= high[rows, j, None]) & (scores >= least[:, None]) & known[rows, j, None]
                hit = np.flatnonzero(fits.any(axis=1))
                inside = np.where(fits[hit], scores[hit], NONE)
                heaps.add(rows[hit] * places + j, inside, other)
    return heaps


def percent_window(low: int, high: int) -> Callable:
    """Bounds of scores s with ``low * p <= 100 * s <= high * p``, exact in integers."""

    def bounds(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole, rest = p // 100, p % 100
        return low * whole - (-(low * rest) // 100), high * whole + (high * rest) // 100

    return bounds


def integers(rows: DataFrame, vector: Column, scale: int) -> DataFrame:
    """Add ``q``, the integer vector, and leave out rows that take no part."""
    fine = F.forall(vector, lambda x: F.abs(x) < float("inf"))
    q = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    length = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("q", q).where(length < MOST_LENGTH)


def _ranked(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """Merge heaps: the best ``k`` entries of every key, ranked from 1."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "other_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _over_blocks(anchors: DataFrame, n_blocks: int, parts: DataFrame, task: Callable, schema: str) -> list[DataFrame]:
    """``task(block, batches)`` over all candidates for every block of anchors, a few at a time."""
    context, out = anchors.sparkSession.sparkContext, []
    for first in range(0, n_blocks, LIVE_BLOCKS):
        live, frames = [], []
        for b in range(first, min(first + LIVE_BLOCKS, n_blocks)):
            live.append(context.broadcast(anchors.where(F.col("block") == b).drop("block").toArrow()))
            frames.append(parts.mapInArrow(lambda batches, sent=live[-1]: task(sent.value, batches), schema))
        out.append(stored(reduce(DataFrame.unionByName, frames)))
        for sent in live:
            sent.destroy()
    return out


def mine(
    rows: DataFrame,
    is_anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: int = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """Hard negatives of every anchor (a condition over ``id``) and each of its positives.

    Positives are the ``n_positives`` best other rows of the anchor's label. Negatives of a
    positive with score p are the ``n_negatives`` best rows of other labels whose score s
    has ``low_percent * p <= 100 * s <= high_percent * p``. Returns ``anchor_id,
    positive_id, positive_score, rank, negative_id, negative_score``.
    """
    named = rows.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")
    ).where("id is not null and label is not null and v is not null")
    whole = integers(named, F.col("v"), scale).select("id", F.col("label").cast("long").alias("label"), "q")
    once = stored(whole.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.*"))
    n_rows = once.count()
    chosen = once.where(is_anchor)
    n_blocks = -(-chosen.count() // block_anchors)
    anchors = stored(chosen.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(n_blocks, 1)))))
    candidates = once.coalesce(min(MOST_PARTS, max(1, -(-n_rows // PART_ROWS))))
    none = "anchor_id long, place int, score long, other_id long"

    def positives_of(block, batches):
        ids, labels = _columns(block, "id", "label")
        q = _matrix(block.column("q"), 0)
        key, score, other = best_positives(ids, labels, q, n_positives, _tiles(batches, q.shape[1])).entries()
        yield _entries(ids[key], np.zeros(len(key), np.int32), score, other)

    def negatives_of(block, batches):
        ids, labels = _columns(block, "id", "label")
        q, p = _matrix(block.column("q"), 0), _matrix(block.column("scores"), n_positives)
        known = np.arange(p.shape[1]) < np.diff(block.column("scores").combine_chunks().offsets.to_numpy())[:, None]
        window = percent_window(low_percent, high_percent)
        heaps = best_negatives(labels, q, p, known, n_negatives, window, _tiles(batches, q.shape[1]))
        key, score, other = heaps.entries()
        yield _entries(ids[key // p.shape[1]], (key % p.shape[1]).astype(np.int32), score, other)

    empty = once.sparkSession.createDataFrame([], none)
    found = reduce(DataFrame.unionByName, _over_blocks(anchors, n_blocks, candidates, positives_of, none), empty)
    positives = stored(_ranked(found, ["anchor_id"], n_positives).select(
        "anchor_id", (F.col("rank") - 1).alias("place"),
        F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"),
    ))
    scores = positives.groupBy(F.col("anchor_id").alias("id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]
        ).alias("scores")
    )
    with_scores = stored(anchors.join(scores, "id"))
    found = reduce(DataFrame.unionByName, _over_blocks(with_scores, n_blocks, candidates, negatives_of, none), empty)
    negatives = _ranked(found, ["anchor_id", "place"], n_negatives)
    return positives.join(negatives, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "positive_score", "rank",
        F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"),
    )


def _entries(anchor: np.ndarray, place: np.ndarray, score: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(x) for x in (anchor, place, score, other)]
    return pa.RecordBatch.from_arrays(arrays, names=["anchor_id", "place", "score", "other_id"])
