"""Line dedup: lines that many documents share go, found in a sharded minimal perfect hash.

A line's key is the line without white space at its ends and with A-Z lower-cased; keys
are compared by 64-bit hashes. One scan counts the documents of every distinct line hash
(each document once, summed before the shuffle). The hashes that reach the limit are dealt
to shards, and every shard builds its part of a minimal perfect hash by levels of
collision-free bits: the number of bits set before a key's bit is its slot in two compact
arrays, fingerprints and counts. Documents probe the arrays of all shards, so lines are
never joined to documents while the arrays stay within ``broadcast_lines``; beyond that the
hashes of each distinct text meet the shared ones in a join, with the same result.

A null or empty text is one empty line; a key that is shorter than ``min_chars`` code points
stays. Each row counts as a document, also when ids repeat or are null. An empty table gives
an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.llm.common import ascii_lower, stored

WHITE = " \t\n\x0b\x0c\r"
#: Keys of one shard, about; a shard is built in one task.
SHARD_KEYS = 1 << 16
#: Keys (13 bytes each) that may be broadcast: about 52 MB.
BROADCAST_LINES = 4_000_000
MOST_COUNT = (1 << 32) - 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(WHITE)))


def _hashes(text: Column, min_chars: int) -> Column:
    """One hash a line; null where the key is too short to count."""

    def hashed(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.length(key) >= min_chars, F.xxhash64(key))

    return F.transform(lines_of(text), hashed)


def shared_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, text_col: str = "text") -> DataFrame:
    """``(line, n_docs)``: hashes of the lines found in at least ``min_docs`` rows."""
    once = F.array_distinct(F.filter(_hashes(F.col(text_col), min_chars), lambda h: h.isNotNull()))
    return (
        docs.select(F.explode(once).alias("line"))
        .groupBy("line")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
    )


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A well mixed 64-bit number of every key, another one on each level."""
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_shard(keys: np.ndarray, n_docs: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Level sizes in words, bit words, fingerprints and counts of distinct keys.

    On a level every key left picks a bit of twice as many; keys alone on their bit stay
    there, the others go on to the next level.
    """
    left, order, sizes, words = np.arange(len(keys)), [], [], []
    while len(left):
        n_words = -(-2 * len(left) // 64)
        at = (_mix(keys[left], len(sizes)) % np.uint64(64 * n_words)).astype(np.int64)
        alone = np.bincount(at, minlength=64 * n_words)[at] == 1
        held = at[alone]
        bits = np.zeros(n_words, np.uint64)
        np.bitwise_or.at(bits, held >> 6, np.uint64(1) << (held & 63).astype(np.uint64))
        sizes.append(n_words)
        words.append(bits)
        order.append(left[alone][np.argsort(held)])
        left = left[~alone]
    slots = np.concatenate(order) if order else left
    return sizes, np.concatenate(words) if words else np.zeros(0, np.uint64), keys[slots], n_docs[slots]


class Index:
    """The arrays of all shards behind each other; answers for whole arrays of hashes."""

    def __init__(self, n_shards: int, shards: list[tuple[int, list[int], np.ndarray, np.ndarray, np.ndarray]]):
        self.n_shards = n_shards
        shards = sorted(shards, key=lambda s: s[0])
        deep = max((len(s[1]) for s in shards), default=0)
        self.size = np.zeros((deep, n_shards), np.int64)
        self.start = np.zeros((deep, n_shards), np.int64)
        at = 0
        for shard, sizes, *_ in shards:
            for level, n_words in enumerate(sizes):
                self.size[level, shard], self.start[level, shard] = 64 * n_words, 64 * at
                at += n_words
        join = lambda k, kind: np.concatenate([s[k] for s in shards] or [np.zeros(0, kind)])
        self.words, self.fingerprints, self.counts = join(2, np.uint64), join(3, np.uint64), join(4, np.uint32)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def counts_of(self, hashes: np.ndarray) -> np.ndarray:
        """How many documents hold each hash, 0 for hashes that are not in the index."""
        out = np.zeros(len(hashes), np.int64)
        keys = hashes.view(np.uint64)
        shard = np.mod(hashes, self.n_shards)
        left = np.arange(len(hashes))
        for level in range(len(self.size)):
            left = left[self.size[level, shard[left]] > 0]
            size, start = self.size[level, shard[left]], self.start[level, shard[left]]
            at = start + (_mix(keys[left], level) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            there = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            slot = (self.before[at >> 6] + np.bitwise_count(below))[there]
            mine = left[there]
            same = self.fingerprints[slot] == keys[mine]
            out[mine[same]] = self.counts[slot[same]]
            left = left[~there]
        return out


def build_index(shared: DataFrame, n_shards: int) -> DataFrame:
    """One row a shard: its number, level sizes, words, fingerprints and counts."""

    def build(groups):
        shard = int(groups["shard"].iloc[0])
        n_docs = np.minimum(groups["n_docs"].to_numpy(), MOST_COUNT).astype(np.uint32)
        sizes, *arrays = build_shard(groups["line"].to_numpy(np.int64).view(np.uint64), n_docs)
        import pandas as pd

        return pd.DataFrame([[shard, sizes, *(a.tobytes() for a in arrays)]], columns=names)

    names = ["shard", "sizes", "words", "fingerprints", "counts"]
    dealt = shared.withColumn("shard", F.pmod("line", F.lit(n_shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(
        build, "shard int, sizes array<int>, words binary, fingerprints binary, counts binary"
    )


def load_index(rows: DataFrame, n_shards: int) -> Index:
    return Index(n_shards, [
        (r["shard"], r["sizes"], np.frombuffer(r["words"], np.uint64),
         np.frombuffer(r["fingerprints"], np.uint64), np.frombuffer(r["counts"], np.uint32))
        for r in rows.collect()
    ])


def _lists_like(column: pa.Array, values: np.ndarray) -> pa.Array:
    at = column.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(values))


def _probed(rows: DataFrame, hashes: Column, shared: DataFrame, n_shared: int, min_docs: int) -> DataFrame:
    """Flag the shared lines of every row by probing the broadcast arrays."""
    n_shards = max(1, -(-n_shared // SHARD_KEYS))
    index = load_index(build_index(shared, n_shards), n_shards)
    sent = rows.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf("array<boolean>")
    def probe(column: pa.Array) -> pa.Array:
        values = column.flatten()
        keys = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        known = values.is_valid().to_numpy(zero_copy_only=False)
        return _lists_like(column, known & (sent.value.counts_of(keys) >= min_docs))

    return rows.withColumn("shared", probe(hashes))


def _joined(rows: DataFrame, hashes: Column, shared: DataFrame) -> DataFrame:
    """The same flags beyond the bound: hashes of each distinct text meet the shared ones.

    Texts are told apart by a hash; two that had the same one would only be shown more
    lines that are shared anyway.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    of_text = (
        rows.select(key.alias("key"), F.explode(F.array_distinct(hashes)).alias("line"))
        .distinct()
        .join(shared.select("line"), "line", "left_semi")
        .groupBy("key")
        .agg(F.collect_list("line").alias("those"))
    )

    @F.arrow_udf("array<boolean>")
    def among(column: pa.Array, those: pa.Array) -> pa.Array:
        found = [
            np.isin(values.fill_null(0).to_numpy(zero_copy_only=False), some.values.to_numpy())
            & values.is_valid().to_numpy(zero_copy_only=False)
            if some.is_valid else np.zeros(len(values), bool)
            for values, some in ((c.values, t) for c, t in zip(column, those))
        ]
        return _lists_like(column, np.concatenate(found or [np.zeros(0, bool)]))

    met = rows.withColumn("key", key).join(of_text, "key", "left")
    return met.withColumn("shared", among(hashes, F.col("those")))


def dedup(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """``(id, n_lines, n_dropped, kept)``: every row's text without its shared lines.

    ``n_lines`` counts the lines before, ``kept`` joins the lines that stay by line feeds.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = stored(shared_lines(rows, min_docs, min_chars))
    n_shared = shared.count()
    hashes = _hashes(F.col("text"), min_chars)
    if n_shared <= broadcast_lines:
        flagged = _probed(rows, hashes, shared, n_shared, min_docs)
    else:
        flagged = _joined(rows, hashes, shared)
    flag = F.col("shared")
    stay = F.filter(lines_of(F.col("text")), lambda line, i: ~flag[i])
    return flagged.select(
        "id",
        F.size("shared").cast("long").alias("n_lines"),
        F.size(F.filter("shared", lambda x: x)).cast("long").alias("n_dropped"),
        F.array_join(stay, "\n").alias("kept"),
    )
