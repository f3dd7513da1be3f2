"""Best-fit packing of documents into sequences under source and copy conflicts."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.llm.common import ascii_lower, stored


class Bins:
    """Bins in order of residual room, each with a bitmap of sources and one of clusters.

    The order is kept in short runs. A run knows the bits that all its bins have in
    common, so a search passes a run whose every bin conflicts in one step.
    """

    RUN = 64

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.runs: list[list[tuple[int, int]]] = []
        self.common: list[tuple[int, int]] = []
        self.tops: list[tuple[int, int]] = []

    def place(self, cost: int, source: int, cluster: int) -> tuple[int, int]:
        """Put a piece into the tightest compatible bin, or a new one: (bin, offset)."""
        found = self._successor(cost, source, cluster)
        if found is None:
            room, bin_no = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            at, i = found
            room, bin_no = self.runs[at].pop(i)
            self._refresh(at)
        self.sources[bin_no] |= source
        self.clusters[bin_no] |= cluster
        self._insert((room - cost, bin_no))
        return bin_no, self.capacity - room

    def _successor(self, cost: int, source: int, cluster: int) -> tuple[int, int] | None:
        first = bisect_left(self.tops, (cost, -1))
        for at in range(first, len(self.runs)):
            sources, clusters = self.common[at]
            if sources & source or clusters & cluster:
                continue
            run = self.runs[at]
            for i in range(bisect_left(run, (cost, -1)) if at == first else 0, len(run)):
                bin_no = run[i][1]
                if not (self.sources[bin_no] & source or self.clusters[bin_no] & cluster):
                    return at, i
        return None

    def _insert(self, entry: tuple[int, int]) -> None:
        at = min(bisect_left(self.tops, entry), len(self.runs) - 1)
        if at < 0:
            self.runs, self.common, self.tops, at = [[]], [(0, 0)], [entry], 0
        run = self.runs[at]
        run.insert(bisect_left(run, entry), entry)
        if len(run) > self.RUN:
            half = len(run) // 2
            self.runs[at : at + 1] = [run[:half], run[half:]]
            self.common[at : at + 1] = [(0, 0), (0, 0)]
            self.tops[at : at + 1] = [run[half - 1], run[-1]]
            self._refresh(at + 1)
        self._refresh(at)

    def _refresh(self, at: int) -> None:
        run = self.runs[at]
        if not run:
            del self.runs[at], self.common[at], self.tops[at]
            return
        sources = clusters = -1
        for _, bin_no in run:
            sources &= self.sources[bin_no]
            clusters &= self.clusters[bin_no]
        self.common[at], self.tops[at] = (sources, clusters), run[-1]


def best_fit(
    pieces: Iterable[tuple[int, Hashable, Hashable]], capacity: int
) -> list[tuple[int, int]]:
    """(bin, offset) of every (cost, source, cluster), placed in the given order.

    A null source or cluster conflicts with nothing.
    """
    pieces = list(pieces)
    often = Counter(c for _, _, c in pieces if c is not None)
    source_bits: dict[Hashable, int] = {}
    cluster_bits: dict[Hashable, int] = {}
    bins, placed = Bins(capacity), []
    for cost, source, cluster in pieces:
        s = 0 if source is None else source_bits.setdefault(source, 1 << len(source_bits))
        c = 0
        if cluster is not None and often[cluster] > 1:
            c = cluster_bits.setdefault(cluster, 1 << len(cluster_bits))
        placed.append(bins.place(cost, s, c))
    return placed


def pack(
    docs: DataFrame,
    capacity: int = 16_384,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster: Column | None = None,
    shard_rows: int = 4_096,
) -> DataFrame:
    """Pack texts into bins of ``capacity`` characters, each piece followed by a separator.

    A bin holds no two pieces of one source and no two of one cluster of duplicates (by
    default texts equal after lower-casing A-Z). Longer texts fill bins of their own,
    ``capacity - 1`` characters each; the rest of them and all others are dealt by hash
    to shards of about ``shard_rows`` pieces. A shard is placed longest first into the
    tightest compatible bin. A shard that repeated rows make larger is packed in runs of
    that many rows, so a task holds one run whatever the skew.

    Returns one row per piece: ``id``, ``piece``, ``start``, ``length`` (characters),
    ``bin``, ``offset`` in the bin. Every character of every text is in one piece.

    A null text counts as empty; an empty text is one piece of length 0. A null source
    conflicts with nothing. Ids may be null or repeated (each row is packed). Other
    columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    most = capacity - 1
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.length(text).cast("long").alias("n"),
            (F.xxhash64(ascii_lower(text)) if cluster is None else cluster).alias("cluster"),
        )
    ).withColumn("whole", F.expr(f"n div {most}"))
    filled = rows.where("whole > 0").select(
        "id",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("piece"),
    ).select(
        "id",
        "piece",
        (F.col("piece") * most).alias("start"),
        F.lit(most).cast("long").alias("length"),
        F.concat(F.lit("w"), F.monotonically_increasing_id()).alias("bin"),
        F.lit(0).cast("long").alias("offset"),
    )
    shards = max(1, -(-rows.count() // shard_rows))
    rest = rows.where((F.col("n") == 0) | (F.col("n") % most > 0)).select(
        F.pmod(F.xxhash64("id", "n", "cluster"), F.lit(shards)).cast("long").alias("shard"),
        "id",
        F.col("whole").alias("piece"),
        (F.col("whole") * most).alias("start"),
        (F.col("n") % most).alias("length"),
        "source",
        "cluster",
    )
    shape = filled.select("id", "piece", "start", "length", "bin", "offset").schema
    packed = (
        rest.repartition("shard")
        .sortWithinPartitions("shard", F.desc("length"), "id", "piece", "cluster")
        .mapInArrow(_packer(capacity, shard_rows), shape)
    )
    return packed.unionByName(filled)


def _packer(capacity: int, most_rows: int):
    def finish(shard: int, run: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        costs = [n + 1 for n in rows["length"].to_pylist()]
        placed = best_fit(
            zip(costs, rows["source"].to_pylist(), rows["cluster"].to_pylist()), capacity
        )
        out = rows.select(["id", "piece", "start", "length"])
        out = out.append_column("bin", pa.array([f"p{shard}.{run}.{b}" for b, _ in placed]))
        out = out.append_column("offset", pa.array([o for _, o in placed], pa.int64()))
        return out.combine_chunks().to_batches()[0]

    def run_lengths(shards: list[int]) -> Iterator[tuple[int, int]]:
        start = 0
        for i in range(1, len(shards) + 1):
            if i == len(shards) or shards[i] != shards[start]:
                yield start, i
                start = i

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, run, held, parts = None, 0, 0, []
        for batch in batches:
            shards = batch.column("shard").to_pylist()
            for start, end in run_lengths(shards):
                while start < end:
                    if parts and (shards[start] != shard or held >= 2 * most_rows):
                        yield finish(shard, run, parts)
                        run = run + 1 if shards[start] == shard else 0
                        held, parts = 0, []
                    if shards[start] != shard:
                        run = 0
                    shard = shards[start]
                    take = min(end - start, 2 * most_rows - held)
                    parts.append(batch.slice(start, take))
                    held += take
                    start += take
        if parts:
            yield finish(shard, run, parts)

    return scan
