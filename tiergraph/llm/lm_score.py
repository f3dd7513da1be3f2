"""Cross-entropy difference of documents under a target and a background bigram model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergraph.llm import lm_ranges
from tiergraph.llm.common import slices, stored, text_bytes
from tiergraph.llm.lm_words import BEGIN, DISCOUNT, SLICE, pair_key, sequences, word_key
from tiergraph.llm.shingles import U64

#: log2 of the bits of the filter of model keys: 8 MB at any input size.
KEY_BITS = 26
#: Counts are merged within a task up to this many, then handed on.
MERGE = 1_000_000
#: Pairs that are broadcast (16 bytes each): a whole model, or the most frequent of a larger one.
BROADCAST_ENTRIES = 1_000_000
#: Words of a vocabulary that is numbered and broadcast (32 bytes each); more are joined by key.
VOCABULARY = 2_000_000


def _count(rows: DataFrame, wanted=None) -> DataFrame:
    """``key``, ``before`` (0 for single words), ``word``, ``c``: n-grams of all texts.

    Without ``wanted`` single words alone; with it, a bit table of the keys of words, all
    n-grams whose words are (or may be) among them. The begin of a text always is.
    """

    def merged(parts: list[np.ndarray]) -> pa.RecordBatch:
        grams = np.concatenate(parts, axis=1)
        key, at, c = np.unique(grams[0], return_index=True, return_counts=True)
        before, word = grams[1][at], grams[2][at]
        return pa.RecordBatch.from_pydict({
            "key": pa.array(key.view(np.int64)),
            "before": pa.array(before.view(np.int64)), "word": pa.array(word.view(np.int64)),
            "c": pa.array(c, pa.int64()),
        })

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else wanted.value
        held, parts = 0, []
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                _, before, word = sequences(text_bytes(part["text"]))
                single = word_key(word)
                if bits is None:
                    grams = np.stack([single, np.zeros_like(word), word])
                else:
                    slot = (single >> U64(64 - KEY_BITS)).astype(np.int64)
                    known = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                    both = known & np.where(before == BEGIN, True, np.roll(known, 1))
                    grams = np.stack([
                        np.concatenate([single[known], pair_key(before[both], word[both])]),
                        np.concatenate([np.zeros_like(word[known]), before[both]]),
                        np.concatenate([word[known], word[both]]),
                    ])
                parts.append(grams)
                held += grams.shape[1]
                if held >= MERGE:
                    yield merged(parts)
                    held, parts = 0, []
        if held:
            yield merged(parts)

    shape = "key long, before long, word long, c long"
    return rows.select("text").mapInArrow(scan, shape).groupBy("key").agg(
        F.first("before").alias("before"), F.first("word").alias("word"), F.sum("c").alias("c")
    )


def _key_bits(model: DataFrame):
    """The keys of a model as a bit table of fixed size, combined before it is collected."""
    slot = F.shiftrightunsigned("key", 64 - KEY_BITS)
    rows = (
        model.select(slot.alias("s"))
        .groupBy(F.shiftright("s", 15).alias("row"))
        .agg(F.bitmap_construct_agg(F.col("s").bitwiseAND((1 << 15) - 1)).alias("bits"))
        .collect()
    )
    bits = np.zeros((1 << KEY_BITS) // 8, np.uint8).reshape(-1, 1 << 12)
    for row, packed in rows:
        bits[row] = np.frombuffer(packed, np.uint8)
    return model.sparkSession.sparkContext.broadcast(bits.ravel())


def fit(
    target: DataFrame,
    background: DataFrame,
    text_col: str = "text",
    least: int = 2,
    vocabulary: int = VOCABULARY,
) -> tuple[DataFrame, dict]:
    """The shared model: a table of n-grams, and the rates that ``score`` needs beside it.

    The vocabulary is the words that all target texts together have at least ``least``
    times; both models use it, and every other word is one unknown word to both. Each
    model counts every pair of such words (or of the begin of a text and one) that its
    own texts have, discounts over these pairs and interpolates with word counts.
    Log rates are kept as a sum over n-grams: a word brings the logarithm of its rate
    and of the weight it leaves to later words, a pair of either model corrects both. So
    a text's loss is the sum of the values of its n-grams, and the table may be joined in
    any parts. All texts are counted; the table grows with both corpora.

    A vocabulary of at most ``vocabulary`` words is numbered and the table holds ranges of
    pairs (``lm_ranges``); of a larger one, it holds a row for each n-gram. Both give the
    same losses.
    """
    sides = [f.select(F.col(text_col).alias("text")) for f in (target, background)]
    listed = stored(_count(sides[0]).where(f"c >= {least}").select("key"))
    if listed.count() <= vocabulary:
        keys = listed.toArrow()["key"].to_numpy().view(U64)
        return lm_ranges.fit(sides, np.sort(keys))
    return _fit_by_key(sides, listed, least)


def _fit_by_key(sides: list[DataFrame], listed: DataFrame, least: int) -> tuple[DataFrame, dict]:
    """``key``, ``ct``, ``cb`` of every n-gram of both models, and the rates of unknown words."""
    names = ("ct", "cb")
    bits = _key_bits(listed)
    counts = [
        _count(f, bits).select(
            "key", "before", "word", *((F.col("c") if c == own else F.lit(0).cast("long")).alias(c) for c in names)
        )
        for own, f in zip(names, sides)
    ]
    both = stored(
        counts[0].unionByName(counts[1]).groupBy("key").agg(
            F.first("before").alias("before"), F.first("word").alias("word"),
            *(F.sum(c).alias(c) for c in names),
        )
    )
    # The bit table lets some other words pass; their counts in the target tell them.
    words = both.where(f"before = 0 AND ct >= {least}")
    pairs = both.where("before <> 0").join(words.select("word"), "word", "left_semi")
    totals = [_tokens(f) for f in sides]
    known = words.agg(F.count(F.lit(1)), F.sum("ct"), F.sum("cb")).first()
    size = (known[0] or 0) + 1
    unknown = {
        c: float(np.log((n - (k or 0) + 1) / (n + size))) for c, n, k in zip(names, totals, known[1:])
    }
    rate = {c: F.log((F.col(c) + 1) / F.lit(float(n + size))) for c, n in zip(names, totals)}
    # What a model's pairs leave of a context to single words.
    used = pairs.groupBy("before").agg(
        *(F.sum(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))).alias(f"u{c}") for c in names)
    )
    contexts = words.select(F.col("word").alias("before"), *(F.col(c).alias(f"n{c}") for c in names))
    begins = [f.count() for f in sides]
    edge = pairs.sparkSession.range(1).select(
        F.lit(int(BEGIN.view(np.int64))).alias("before"),
        *(F.lit(n).alias(f"n{c}") for c, n in zip(names, begins)),
    )
    leave = {c: F.log(F.greatest(1 - F.col(f"u{c}") / F.greatest(f"n{c}", F.lit(1)), F.lit(1e-6))) for c in names}
    weights = stored(
        contexts.unionByName(edge).join(used, "before", "left").fillna(0.0, [f"u{c}" for c in names])
        .select("before", *(leave[c].alias(f"a{c}") for c in names), *(f"n{c}" for c in names))
    )
    single = words.select("key", "word", *(rate[c].alias(f"r{c}") for c in names))
    single = stored(single.join(weights.withColumnRenamed("before", "word"), "word", "left").fillna(0.0))
    value = lambda c: F.col(f"r{c}") + F.col(f"a{c}") - F.lit(unknown[c])
    of_words = single.select("key", *(value(c).cast("float").alias(c) for c in names))
    chance = {
        c: F.log(
            F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(f"n{c}", F.lit(1))
            + F.exp(F.col(f"a{c}") + F.col(f"r{c}"))
        ) - F.col(f"a{c}") - F.col(f"r{c}")
        for c in names
    }
    of_pairs = (
        pairs.join(single.select("word", *(f"r{c}" for c in names)), "word")
        .join(weights, "before")
        .select("key", *(chance[c].cast("float").alias(c) for c in names))
    )
    start = weights.where(F.col("before") == int(BEGIN.view(np.int64))).select(*(f"a{c}" for c in names)).first()
    return stored(of_words.unionByName(of_pairs)), {
        "unknown": [unknown[c] for c in names], "begin": [float(x) for x in start],
    }


def _tokens(rows: DataFrame) -> int:
    """Words and ends of all texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(len(t.split()) + 1 if t else 1 for b in batches for t in text_bytes(b["text"]))
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return rows.mapInArrow(scan, "n long").agg(F.sum("n")).first()[0] or 0


def score(
    docs: DataFrame,
    model: DataFrame,
    rates: dict,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_entries: int = BROADCAST_ENTRIES,
) -> DataFrame:
    """``id``, ``n_tokens``, ``target_loss``, ``background_loss``, ``difference`` of each row.

    Losses are nats a token (the end of a text counts as one); a lower difference means
    closer to the target. A model of at most ``broadcast_entries`` pairs is broadcast; of a
    larger one, its most frequent pairs, at most as many, are, and texts send their other
    pairs to the ranges of the model. All ways give the same sums.

    A null text counts as empty, which is scored by its end alone. Ids may be null or
    repeated: every row is scored. Other columns are not read. An empty target leaves
    only unknown words. An empty table gives an empty result.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
    )
    if "keys" in rates:
        sums = lm_ranges.sums(rows, model, rates, _shape(rows), broadcast_entries)
    else:
        sums = _by_join(rows, model)
    losses = [
        -(F.col(s) + F.col("n") * F.lit(u) + F.lit(b)) / F.col("n")
        for s, u, b in zip(("ct", "cb"), rates["unknown"], rates["begin"])
    ]
    return sums.select(
        "id", F.col("n").alias("n_tokens"), losses[0].alias("target_loss"),
        losses[1].alias("background_loss"), (losses[0] - losses[1]).alias("difference"),
    )


def _shape(rows: DataFrame) -> T.StructType:
    return T.StructType([
        rows.schema["id"], T.StructField("n", T.LongType()), T.StructField("ct", T.DoubleType()),
        T.StructField("cb", T.DoubleType()),
    ])


def _by_join(rows: DataFrame, model: DataFrame) -> DataFrame:
    """The n-grams of each row meet the table by key; the end mark carries each row's length."""
    wanted = _key_bits(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                doc, before, word = sequences(text_bytes(part["text"]))
                key = np.concatenate([word_key(word), pair_key(before, word)])
                both = np.concatenate([doc, doc])
                slot = (key >> U64(64 - KEY_BITS)).astype(np.int64)
                kept = (wanted.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                grams, c = np.unique(
                    np.stack([both[kept].astype(U64), key[kept]]), axis=1, return_counts=True
                )
                names = part["row"].to_numpy()
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(names[grams[0].astype(np.int64)]),
                    "key": pa.array(grams[1].view(np.int64)), "c": pa.array(c, pa.int64()),
                })

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(t.split()) + 1 if t else 1 for t in text_bytes(batch["text"])]
            yield pa.RecordBatch.from_pydict({"row": batch["row"], "id": batch["id"], "n": pa.array(n, pa.int64())})

    grams = rows.select("row", "text").mapInArrow(scan, "row long, key long, c long")
    sums = (
        grams.join(model, "key")
        .groupBy("row")
        .agg(*(F.sum(F.col("c") * F.col(c)).alias(c) for c in ("ct", "cb")))
    )
    held = rows.mapInArrow(sizes, T.StructType([
        T.StructField("row", T.LongType()), rows.schema["id"], T.StructField("n", T.LongType()),
    ]))
    return held.join(sums, "row", "left").fillna(0.0, ["ct", "cb"]).select("id", "n", "ct", "cb")
