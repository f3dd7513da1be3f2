"""Benchmark passages in documents by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergraph.llm.common import slices, stored, text_bytes

#: A word of a text whose A-Z are lower-cased, in UTF-8: digits, a-z and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Texts that are searched for one block of items after the other before more are read.
RUN_BYTES = 32 << 20

SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


class WindowTable:
    """Wu-Manber tables for patterns of one length: all windows of ``size`` words of some items.

    The block is the last two words of the position looked at (one word if the windows
    have but one). ``shift`` says how far the search may jump when it sees a block;
    blocks of no window allow the longest jump. Blocks that end a window have shift 0,
    and their bucket lists the windows to compare by a hash of all their words. Equal
    windows are one entry, whether an item repeats itself or items repeat each other.
    """

    def __init__(self, size: int) -> None:
        self.size = size
        self.block = min(2, size)
        self.shift: dict[tuple[bytes, ...], int] = {}
        #: Per block and hash: number of the window, the words that hold it and where it ends.
        self.bucket: dict[tuple[bytes, ...], dict[int, list[tuple[int, list[bytes], int]]]] = {}
        #: Items of every window, by its number.
        self.names: list[list[str]] = []

    def add(self, name: str, words: list[bytes]) -> None:
        size, block = self.size, self.block
        for end in range(block, len(words) + 1):
            key = tuple(words[end - block : end])
            jump = max(0, size - end)
            self.shift[key] = min(jump, self.shift.get(key, jump))
            if end < size:
                continue
            window = words[end - size : end]
            alike = self.bucket.setdefault(key, {}).setdefault(hash(tuple(window)), [])
            for number, own, stop in alike:
                if own[stop - size : stop] == window:
                    if self.names[number][-1] != name:
                        self.names[number].append(name)
                    break
            else:
                alike.append((len(self.names), words, end))
                self.names.append([name])

    def search(self, words: list[bytes], spans: list[tuple[int, int]], found: set[str]) -> None:
        """Append the word span of every occurrence, collect the names of its items."""
        size, block = self.size, self.block
        jump_of, longest = self.shift.get, self.size - self.block + 1
        end, n = size, len(words)
        seen: set[int] = set()
        while end <= n:
            key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            jump = jump_of(key, longest)
            if jump:
                end += jump
                continue
            window = words[end - size : end]
            for number, own, stop in self.bucket[key].get(hash(tuple(window)), ()):
                if own[stop - size : stop] == window:
                    if number not in seen:
                        seen.add(number)
                        found.update(self.names[number])
                    if spans and spans[-1][1] >= end - size and spans[-1][0] <= end - size:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], end))
                    else:
                        spans.append((end - size, end))
            end += 1


def tables_of(items: list[tuple[str, bytes | None]], window: int) -> list[WindowTable]:
    """One table for items of at least ``window`` words, one for each shorter length."""
    made: dict[int, WindowTable] = {}
    for name, text in items:
        words = words_of(text)
        if words:
            size = min(window, len(words))
            made.setdefault(size, WindowTable(size)).add(name, words)
    return list(made.values())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """The items in runs of at most ``most`` bytes of text (or one longer item)."""
    block, held = [], 0
    for name, text in benchmark.toLocalIterator():
        raw = (text or "").encode()
        if block and held + len(raw) > most:
            yield block
            block, held = [], 0
        block.append((name, raw))
        held += len(raw)
    yield block


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    block_bytes: int = 4 << 20,
    blocks_a_pass: int = 16,
    carry: bool = False,
) -> DataFrame:
    """Where windows of ``window`` consecutive item words occur in documents.

    The items are taken as broadcast blocks of at most ``block_bytes``. One pass takes up
    to ``blocks_a_pass`` of them and searches ``RUN_BYTES`` of texts for one block after
    the other, so a task holds the tables of one block. Each further pass writes and
    reads the documents once. What an executor holds does not grow with the benchmark,
    and the driver holds two blocks and one partition of it at a time. Documents are
    never shuffled, whatever their number or skew.

    Returns one row per input row: ``id``, ``n_words``, ``spans`` (disjoint word ranges
    that windows cover, end exclusive), ``n_hit`` (words in them), ``items`` (ids, as
    strings in order, of the items with an occurring window), ``n_items``; with ``carry``
    also ``doc``, the whole input row.

    An item shorter than the window is one window; items without words or id match
    nothing. Items that repeat an id count as one item. A null text has no words. Ids
    may be null or repeated, other columns are not read. An empty benchmark gives rows
    without hits, an empty table no rows.
    """
    spark = docs.sparkSession
    source = F.struct(*(docs.columns if carry else [text_col])).alias("doc")
    rows = docs.select(F.col(id_col).alias("id"), source)
    named = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string"), F.col(item_text_col)
    )
    kept = T.StructType([
        rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS),
        T.StructField("items", T.ArrayType(T.StringType())),
    ])
    blocks, last = _blocks(named, block_bytes), False
    following = next(blocks)
    while not last:
        held = []
        while following is not None and len(held) < blocks_a_pass:
            held.append(spark.sparkContext.broadcast(following))
            following = next(blocks, None)
        last = following is None
        keep = carry or not last
        shape = T.StructType([*kept.fields, rows.schema["doc"]]) if keep else kept
        rows = rows.mapInArrow(_search(held, text_col, window, keep), shape)
        if not last:
            rows = stored(rows)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long")})


def _runs(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in runs of at least ``most`` bytes, but for the last run."""
    run, held = [], 0
    for part in parts:
        run.append(part)
        held += part.nbytes
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run


def _search(held: list, text_col: str, window: int, keep: bool):
    """The scan of one pass; earlier passes' spans and items are taken over."""

    def texts_first(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column("text", batch.column("doc").field(text_col))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        only = tables_of(held[0].value, window) if len(held) == 1 else None
        parts = (p for batch in batches for p in slices(texts_first(batch), "text"))
        for run in _runs(parts, 1 if only is not None else RUN_BYTES):
            met = [_earlier(part) for part in run]
            for block in held:
                tables = only if only is not None else tables_of(block.value, window)
                for part, (n_words, where, found) in zip(run, met):
                    for i, text in enumerate(text_bytes(part.column("text"))):
                        words = words_of(text)
                        n_words[i] = len(words)
                        for t in tables:
                            t.search(words, where[i], found[i])
            for part, (n_words, where, found) in zip(run, met):
                spans = [[{"start": a, "end": b} for a, b in merged(w)] for w in where]
                out = {
                    "id": part.column("id"), "n_words": pa.array(n_words, pa.int64()),
                    "spans": pa.array(spans, span),
                    "items": pa.array([sorted(f) for f in found], pa.list_(pa.string())),
                }
                if keep:
                    out["doc"] = part.column("doc")
                yield pa.RecordBatch.from_pydict(out)

    return scan


def _earlier(part: pa.RecordBatch) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """Numbers of words (unknown yet), spans and items that earlier passes found."""
    n = part.num_rows
    if "spans" not in part.schema.names:
        return [0] * n, [[] for _ in range(n)], [set() for _ in range(n)]
    spans = [[(s["start"], s["end"]) for s in row] for row in part.column("spans").to_pylist()]
    return [0] * n, spans, [set(row) for row in part.column("items").to_pylist()]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """``docs`` without contaminated rows; all columns stay, no row is shuffled."""
    found = contamination(docs, benchmark, carry=True, **columns)
    return found.where(~contaminated()).select("doc.*")


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", share: int = 20):
    """At least one word in ``share`` lies in a benchmark window."""
    return (F.col(n_hit) > 0) & (share * F.col(n_hit) >= F.col(n_words))
