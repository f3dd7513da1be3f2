"""Bigram models over a numbered vocabulary, counted and looked up by ranges of pairs.

A pair of words is one number, ``before * (words + 1) + word``. Tasks hand on sorted
arrays of such numbers, one for every range, as differences in byte planes: a pair takes
a few bytes in a shuffle instead of a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergraph.llm.common import slices, stored, text_bytes
from tiergraph.llm.lm_words import BEGIN, DISCOUNT, SLICE, sequences, word_key
from tiergraph.llm.shingles import U64

#: Words and ends that a task collects before it hands their pairs on.
FLUSH = 2_000_000
#: Occurrences of pairs in a range.
RANGE = 2_000_000
#: Most partitions of a shuffle by ranges.
PARTITIONS = 20_000


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=values.dtype.type(0)))


def _unpack_sorted(packed: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(packed, n), dtype=U64)


def numbered(texts: list[bytes | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, number of the word before, number of the word) of every word and end.

    Unknown words are -1, the begin of a text is ``len(keys)``.
    """
    doc, before, word = sequences(texts)
    key = word_key(word)
    at = np.searchsorted(keys, key)
    at[at == len(keys)] = 0
    w = np.where(keys[at] == key, at, -1) if len(keys) else np.full(len(key), -1)
    return doc, np.where(before == BEGIN, len(keys), np.roll(w, 1)), w


def _codes(b: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    return b.astype(U64) * U64(size + 1) + w.astype(U64)


def _word_counts(sides: list[DataFrame], keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each vocabulary word, texts, and words with ends; a row for each side."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(keys.value)
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                doc, _, w = numbered(text_bytes(part["text"]), keys.value)
                total[:size] += np.bincount(w[w >= 0], minlength=size)[:size]
                total[size:] += part.num_rows, len(doc)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"w": pa.array(at), "c": pa.array(total[at])})

    parts = [
        f.select("text").mapInArrow(scan, "w long, c long").withColumn("side", F.lit(k)) for k, f in enumerate(sides)
    ]
    rows = parts[0].unionByName(parts[1]).groupBy("side", "w").agg(F.sum("c").alias("c")).toArrow()
    total = np.zeros((2, len(keys.value) + 2), np.int64)
    total[rows["side"].to_numpy(), rows["w"].to_numpy()] = rows["c"].to_numpy()
    return total[:, :-2], total[:, -2], total[:, -1]


def _cuts(counts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """First pairs of ranges that would weigh the same if words were independent."""
    contexts = np.append(counts.sum(0), texts.sum()).astype(float)
    total = contexts.sum()
    parts = int(total // RANGE) + 1
    ends = np.cumsum(contexts)
    goal = np.arange(1, parts) * (total / parts)
    b = np.minimum(np.searchsorted(ends, goal), len(contexts) - 1)
    share = (goal - (ends[b] - contexts[b])) / np.maximum(contexts[b], 1)
    words = np.cumsum(contexts[:-1]) / max(contexts[:-1].sum(), 1)
    return np.unique(_codes(b, np.searchsorted(words, share), len(contexts) - 1))


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (pair, target count, background count) with equal pairs added up, in order."""
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.argsort(rows[0], kind="stable")]
    first = np.flatnonzero(np.diff(rows[0], prepend=~rows[0, :1]))
    return np.stack([rows[0, first], *(np.add.reduceat(rows[k], first) for k in (1, 2))])


def _pair_counts(sides: list[DataFrame], keys, cuts: np.ndarray) -> DataFrame:
    """All pairs of vocabulary words with their counts, in rows of about ``RANGE`` occurrences.

    ``start`` (first pair), ``n`` (pairs), ``seen`` (occurrences), packed ``codes``, ``ct``, ``cb``.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            code, c = np.unique(np.concatenate(held), return_counts=True)
            edges = np.concatenate([[0], np.searchsorted(code, cuts), [len(code)]])
            p = np.flatnonzero(np.diff(edges))
            spans = [slice(edges[i], edges[i + 1]) for i in p]
            return pa.RecordBatch.from_pydict({
                "p": pa.array(p), "n": pa.array([s.stop - s.start for s in spans], pa.int64()),
                "codes": pa.array([_pack_sorted(code[s]) for s in spans], pa.binary()),
                "c": pa.array([_pack(c[s]) for s in spans], pa.binary()),
            })

        held: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                _, b, w = numbered(text_bytes(part["text"]), keys.value)
                known = (b >= 0) & (w >= 0)
                held.append(_codes(b[known], w[known], len(keys.value)))
                if sum(map(len, held)) >= FLUSH:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish() -> pa.RecordBatch:
            code, ct, cb = _merged(parts)
            turn = np.cumsum(ct + cb) // U64(RANGE)
            edges = np.append(np.flatnonzero(np.diff(turn, prepend=~turn[:1])), len(code))
            spans = [slice(i, j) for i, j in zip(edges, edges[1:])]
            return pa.RecordBatch.from_pydict({
                "start": pa.array([int(code[s.start]) for s in spans], pa.int64()),
                "n": pa.array([s.stop - s.start for s in spans], pa.int64()),
                "seen": pa.array([int((ct[s] + cb[s]).sum()) for s in spans], pa.int64()),
                "codes": pa.array([_pack_sorted(code[s]) for s in spans], pa.binary()),
                "ct": pa.array([_pack(ct[s]) for s in spans], pa.binary()),
                "cb": pa.array([_pack(cb[s]) for s in spans], pa.binary()),
            })

        now, parts, more = None, [], 0
        for batch in batches:
            for p, side, n, codes, c in zip(*(batch[k].to_pylist() for k in ("p", "side", "n", "codes", "c"))):
                if p != now and parts:
                    yield finish()
                    parts, more = [], 0
                now = p
                new = np.zeros((3, n), U64)
                new[0], new[1 + side] = _unpack_sorted(codes, n), _unpack(c, n)
                parts.append(new)
                more += n
                if more > 2 * RANGE:
                    parts, more = [_merged(parts)], 0
        if parts:
            yield finish()

    found = [
        f.select("text").mapInArrow(scan, "p long, n long, codes binary, c binary").withColumn("side", F.lit(k))
        for k, f in enumerate(sides)
    ]
    return stored(
        found[0].unionByName(found[1])
        .repartition(min(len(cuts) + 1, PARTITIONS), "p")
        .sortWithinPartitions("p")
        .mapInArrow(merge, "start long, n long, seen long, codes binary, ct binary, cb binary")
    )


def _context_sums(pairs: DataFrame, size: int) -> np.ndarray:
    """What the pairs of each context take after the discount, a row for each side."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, codes, *counts in zip(*(batch[k].to_pylist() for k in ("n", "codes", "ct", "cb"))):
                before, back = np.unique(_unpack_sorted(codes, n) // U64(size + 1), return_inverse=True)
                used = [np.bincount(back, np.maximum(_unpack(c, n) - DISCOUNT, 0)) for c in counts]
                yield pa.RecordBatch.from_pydict({
                    "b": pa.array(before.astype(np.int64)), "ut": pa.array(used[0]), "ub": pa.array(used[1]),
                })

    rows = (
        pairs.select("n", "codes", "ct", "cb").mapInArrow(scan, "b long, ut double, ub double")
        .groupBy("b").agg(F.sum("ut").alias("ut"), F.sum("ub").alias("ub")).toArrow()
    )
    used = np.zeros((2, size + 1))
    used[:, rows["b"].to_numpy()] = rows["ut"].to_numpy(), rows["ub"].to_numpy()
    return used


def fit(sides: list[DataFrame], keys: np.ndarray) -> tuple[DataFrame, dict]:
    """The counts of all pairs and what turns them into rates; see ``lm_score.fit``."""
    held = sides[0].sparkSession.sparkContext.broadcast(keys)
    counts, texts, tokens = _word_counts(sides, held)
    pairs = _pair_counts(sides, held, _cuts(counts, texts))
    n = np.concatenate([counts, texts[:, None]], axis=1)
    leave = np.log(np.maximum(1 - _context_sums(pairs, len(keys)) / np.maximum(n, 1), 1e-6))
    size = (tokens + len(keys) + 1)[:, None]
    return pairs, {
        "unknown": [float(x) for x in np.log((tokens - counts.sum(1) + 1) / size[:, 0])],
        "begin": [float(x) for x in leave[:, -1]],
        "keys": keys, "n": n.astype(np.float32), "leave": leave.astype(np.float32),
        "rate": np.log((counts + 1) / size).astype(np.float32),
    }


def _worth(code: np.ndarray, counts: list[np.ndarray], held: dict) -> np.ndarray:
    """What pairs add to the logarithm of a text's rate, a row for each side."""
    size = U64(len(held["keys"]) + 1)
    b, w = (code // size).astype(np.int64), (code % size).astype(np.int64)
    single = held["leave"][:, b].astype(float) + held["rate"][:, w]
    taken = np.maximum(np.stack(counts).astype(float) - DISCOUNT, 0) / np.maximum(held["n"][:, b], 1)
    return np.log(taken + np.exp(single)) - single


def _lookup(code: np.ndarray, table: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Worth of each pair, and whether the table has it."""
    if not len(table):
        return np.zeros((2, len(code))), np.zeros(len(code), bool)
    at = np.searchsorted(table, code)
    at[at == len(table)] = 0
    found = table[at] == code
    return np.where(found, worth[:, at], 0.0), found


def _frequent(pairs: DataFrame, least: int, held) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that both sides together have ``least`` times, in order, with their worth."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, codes, *packed in zip(*(batch[k].to_pylist() for k in ("n", "codes", "ct", "cb"))):
                counts = np.stack([_unpack(c, n) for c in packed])
                many = counts.sum(0) >= U64(least)
                code = _unpack_sorted(codes, n)[many]
                worth = _worth(code, list(counts[:, many]), held.value).astype(np.float32)
                yield pa.RecordBatch.from_pydict({
                    "code": pa.array(code.view(np.int64)), "t": pa.array(worth[0]), "b": pa.array(worth[1]),
                })

    rows = pairs.select("n", "codes", "ct", "cb").mapInArrow(scan, "code long, t float, b float").toArrow()
    code = rows["code"].to_numpy().astype(U64)
    order = np.argsort(code)
    return code[order], np.stack([rows[c].to_numpy() for c in "tb"])[:, order]


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def sums(rows: DataFrame, pairs: DataFrame, model: dict, shape: T.StructType, broadcast_entries: int) -> DataFrame:
    """``id``, ``n``, ``ct``, ``cb`` of each row of ``id`` and ``text``, ``row`` being its number.

    Single words and the most frequent pairs (at most ``broadcast_entries``, as each has
    at least that part of all occurrences) are looked up at once. The other pairs of many texts
    go to the range of the model that holds them, and one sum a text and range returns.
    """
    spark = rows.sparkSession
    total = pairs.agg(F.sum("n"), F.sum("seen")).first()
    held = spark.sparkContext.broadcast({k: model[k] for k in ("keys", "n", "leave", "rate")})
    whole = (total[0] or 0) <= broadcast_entries
    if whole or broadcast_entries:
        head = _frequent(pairs, 0 if whole else total[1] // broadcast_entries + 1, held)
    else:
        head = np.zeros(0, U64), np.zeros((2, 0), np.float32)
    starts = np.array(sorted(r[0] for r in pairs.select("start").collect()), U64)
    frequent = spark.sparkContext.broadcast((head, starts))
    unknown = np.array(model["unknown"])[:, None]
    names = ("id", "n", "ct", "cb")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (table, worth), starts = held.value, *frequent.value
        of_words = known["rate"] + known["leave"][:, :-1].astype(float) - unknown

        def flush() -> pa.RecordBatch:
            ids = pa.concat_arrays([part["id"] for part, *_ in parts])
            first = np.cumsum([0, *(part.num_rows for part, *_ in parts)])
            doc = np.concatenate([d + k for k, (_, d, _, _) in zip(first, parts)])
            b, w = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
            size = len(ids)
            word = w >= 0
            both = word & (b >= 0)
            code = _codes(b[both], w[both], len(known["keys"]))
            order = np.argsort(code, kind="stable")
            code, at = code[order], doc[both][order]
            value, found = _lookup(code, table, worth)
            # Without any words, bincount gives whole numbers.
            local = [
                (np.bincount(doc[word], of_words[k, w[word]], size) + np.bincount(at, value[k], size)).astype(float)
                for k in (0, 1)
            ]
            header = pa.RecordBatch.from_pydict({
                "id": ids, "n": pa.array(np.bincount(doc, minlength=size)),
                "ct": pa.array(local[0]), "cb": pa.array(local[1]),
            })
            if whole:
                return header
            code, at = code[~found], at[~found]
            name = parts[0][0]["row"][0].as_py()
            edges = np.concatenate([[0], np.searchsorted(code, starts[1:]), [len(code)]])
            p = np.flatnonzero(np.diff(edges))
            spans = [slice(edges[i], edges[i + 1]) for i in p]
            turn = name % len(starts)
            return pa.RecordBatch.from_pydict({
                "flush": pa.array([name] * (1 + len(p)), pa.int64()),
                "kind": pa.array([1] + [2] * len(p), pa.int32()),
                "p": pa.array([int(starts[turn])] + [int(starts[i]) for i in p], pa.int64()),
                "n": pa.array([size] + [s.stop - s.start for s in spans], pa.int64()),
                "x": pa.array([_ipc(header)] + [_pack_sorted(code[s]) for s in spans], pa.binary()),
                "y": pa.array([None] + [_pack(at[s]) for s in spans], pa.binary()),
                "z": pa.array([None] * (1 + len(p)), pa.binary()),
            })

        parts, more = [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                doc, b, w = numbered(text_bytes(part["text"]), known["keys"])
                parts.append((part.select(["row", "id"]), doc, b, w))
                more += len(doc)
                if more >= FLUSH:
                    yield flush()
                    parts, more = [], 0
        if parts:
            yield flush()

    if whole:
        return rows.mapInArrow(scan, shape)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = worth = None
        for batch in batches:
            out = {k: [] for k in ("flush", "kind", "p", "n", "x", "y", "z")}
            for flush, kind, p, n, x, y, z in zip(*(batch[k].to_pylist() for k in out)):
                if kind == 0:
                    code = _unpack_sorted(x, n)
                    worth = _worth(code, [_unpack(y, n), _unpack(z, n)], held.value)
                    continue
                if kind == 2:
                    at = _unpack(y, n).astype(np.int64)
                    value, _ = _lookup(_unpack_sorted(x, n), code, worth)
                    doc = np.unique(at)
                    n, x = len(doc), _pack_sorted(doc.astype(U64))
                    y, z = (_pack(np.bincount(at, v)[doc].astype(np.float32).view(np.uint32)) for v in value)
                for k, v in zip(out, (flush, kind, p, n, x, y, z)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=batch.schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "id": header["id"], "n": header["n"], "ct": pa.array(local[0]), "cb": pa.array(local[1]),
            })

        header = local = None
        for batch in batches:
            for kind, n, x, *values in zip(*(batch[k].to_pylist() for k in ("kind", "n", "x", "y", "z"))):
                if kind == 1:
                    if header is not None:
                        yield texts()
                    header = pa.ipc.open_stream(x).read_all().combine_chunks().to_batches()
                    header = {k: header[0][k] for k in names}
                    local = np.stack([header[k].to_numpy() for k in ("ct", "cb")])
                else:
                    doc = _unpack_sorted(x, n).astype(np.int64)
                    for k, v in enumerate(values):
                        local[k, doc] += _unpack(v, n).astype(np.uint32).view(np.float32)
        if header is not None:
            yield texts()

    form = "flush long, kind int, p long, n long, x binary, y binary, z binary"
    chunks = pairs.select(
        F.lit(0).cast("long").alias("flush"), F.lit(0).alias("kind"), F.col("start").alias("p"), "n",
        F.col("codes").alias("x"), F.col("ct").alias("y"), F.col("cb").alias("z"),
    )
    return (
        chunks.unionByName(rows.mapInArrow(scan, form))
        .repartition(min(len(starts), PARTITIONS), "p")
        .sortWithinPartitions("p", "kind")
        .mapInArrow(look, form)
        .repartition("flush")
        .sortWithinPartitions("flush", "kind", "p")
        .mapInArrow(finish, shape)
    )
