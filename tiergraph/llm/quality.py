"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergraph.llm.common import slices, text_bytes
from tiergraph.llm.shingles import U64, mix, word_hashes

PASSAGE_WORDS = 64
HIDDEN, GATE = 32, 16
#: Features of a passage: bytes by kind, hashed byte pairs, and measures of its words.
KINDS, PAIRS, MEASURES = 129, 64, 6
WIDTH = KINDS + PAIRS + MEASURES
#: Score of documents from which a document counts as good.
GOOD = 0.3

_KIND = np.minimum(np.arange(256), KINDS - 1)


#: Bytes whose features are computed at once; a longer text takes several steps.
SEGMENT = 4 << 20


def blocks(texts: list[bytes | None]) -> tuple[Iterator[np.ndarray], np.ndarray]:
    """Passage features of whole texts in blocks of passages, and the first passage of every text.

    Passages are 64 words long, the last of a text may be shorter. A text without words
    is one passage. A block has about ``SEGMENT`` bytes of text or one longer passage,
    so besides the texts only places and hashes of their words are held whole.
    """
    texts = [t or b"" for t in texts]
    joined = np.frombuffer(b" ".join(texts), np.uint8)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, hashes = word_hashes(joined)
    bounds = np.searchsorted(starts, offsets)
    n_words = np.diff(bounds)
    n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(n_passages)])
    total = int(first[-1])
    doc = np.repeat(np.arange(len(texts)), n_passages)
    word = bounds[doc] + (np.arange(total) - first[doc]) * PASSAGE_WORDS
    # A text's first passage begins with the text, others with their first word.
    begins = offsets[doc].copy()
    later = np.arange(total) > first[doc]
    begins[later] = starts[word[later]]
    # The separators belong to no text, so a text's features don't depend on its neighbours.
    gaps = offsets[1:-1] - 1

    def letters(lo: int, hi: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, bytes by kind and byte pairs of passages ``lo`` to ``hi``."""
        sizes, kinds, pairs = np.zeros(n), np.zeros(n * KINDS), np.zeros(n * PAIRS)
        begin, end = int(begins[lo]), int(begins[hi]) if hi < total else len(joined)
        for at in range(begin, end, SEGMENT):
            stop = min(at + SEGMENT, end)
            # One byte more, for the pair that the last byte begins.
            chars = joined[at : stop + 1]
            real = np.ones(len(chars), bool)
            real[gaps[np.searchsorted(gaps, at) : np.searchsorted(gaps, at + len(chars))] - at] = False
            edge = np.searchsorted(begins[lo:hi], at, "right") - 1
            inner = np.searchsorted(begins[lo:hi], stop)
            cuts = np.concatenate([[at], begins[lo + edge + 1 : lo + inner], [stop]])
            of = np.repeat(np.arange(edge, edge + len(cuts) - 1), np.diff(cuts))
            own = real[: len(of)]
            sizes += np.bincount(of[own], minlength=n)
            kinds += np.bincount(of[own] * KINDS + _KIND[chars[: len(of)][own]], minlength=n * KINDS)
            both = real[:-1] & real[1:]
            pair = (chars[:-1].astype(np.int64) * 37 + chars[1:] * 101) % PAIRS
            pairs += np.bincount(of[: len(both)][both] * PAIRS + pair[both], minlength=n * PAIRS)
        return sizes, kinds.reshape(n, KINDS), pairs.reshape(n, PAIRS)

    def features(lo: int, hi: int) -> np.ndarray:
        n = hi - lo
        sizes, kinds, pairs = letters(lo, hi, n)
        begin, end = int(word[lo]), int(word[hi]) if hi < total else len(hashes)
        own = hashes[begin:end]
        of = np.searchsorted(word[lo:hi], np.arange(begin, end), "right") - 1
        words = np.bincount(of, minlength=n).astype(np.float64)
        tagged = mix(own + (of + lo).astype(U64) * U64(0x9E3779B97F4A7C15))
        _, kept = np.unique(tagged, return_index=True)
        distinct = np.bincount(of[kept], minlength=n)
        same = []
        for k in (1, 2):
            # Words that repeat the k-th word before them in their text, maybe of an earlier block.
            at = np.arange(max(begin, k), end)
            text = doc[lo + of[at - begin]]
            hit = (hashes[at] == hashes[at - k]) & (at - k >= bounds[text])
            same.append(np.bincount(of[at[hit] - begin], minlength=n))
        size, held = np.maximum(sizes, 1), np.maximum(words, 1)
        measures = np.stack(
            [distinct / held, same[0] / held, same[1] / held, np.log1p(words), size / held / 16,
             np.log1p(n_passages[doc[lo:hi]])],
            axis=1,
        )
        return np.concatenate(
            [np.sqrt(kinds / size[:, None]), np.sqrt(pairs / size[:, None]), measures], axis=1
        ).astype(np.float32)

    def each() -> Iterator[np.ndarray]:
        lo = 0
        while lo < total:
            hi = max(lo + 1, int(np.searchsorted(begins, begins[lo] + SEGMENT)))
            yield features(lo, hi)
            lo = hi

    return each(), first[:-1]


def encode(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All blocks of ``blocks`` as one array, and the first passage of every text."""
    each, first = blocks(texts)
    return np.concatenate([*each, np.zeros((0, WIDTH), np.float32)]), first


class Model:
    """h = relu(W x); attention = softmax(w . tanh(V h) sigmoid(U h)); score = sigmoid(c . sum a h)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale

        def drawn(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {
            "W": drawn(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": drawn(HIDDEN, GATE),
            "U": drawn(HIDDEN, GATE), "w": drawn(GATE), "c": drawn(HIDDEN),
            "d": np.zeros(1, np.float32),
        }

    def weights(self) -> dict[str, np.ndarray]:
        """Plain arrays, which executors read without this package."""
        return {"mean": self.mean, "scale": self.scale, **self.p}

    @classmethod
    def of(cls, weights: dict[str, np.ndarray] | None) -> Model | None:
        if weights is None:
            return None
        model = cls(weights["mean"], weights["scale"])
        model.p = {k: weights[k] for k in model.p}
        return model

    def hidden(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What a passage gives by itself: its representation and the terms of its attention."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.maximum(x @ p["W"] + p["b"], 0)
        return {"x": x, "h": h, "t": np.tanh(h @ p["V"]), "s": 1 / (1 + np.exp(-(h @ p["U"])))}

    def attend(self, h: np.ndarray, ts: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """Attention within every text, its weighted representation and score."""
        p = self.p
        seg = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        e = ts @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, first)[seg])
        a /= np.add.reduceat(a, first)[seg]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        score = 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))
        return {"seg": seg, "a": a, "z": z, "score": score}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        f = self.hidden(x)
        return {**f, **self.attend(f["h"], f["t"] * f["s"], first)}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, first)
        h, t, s, a, seg = f["h"], f["t"], f["s"], f["a"], f["seg"]
        out = ((f["score"] - y) / len(y)).astype(np.float32)
        dz = out[seg, None] * p["c"]
        da = (dz * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[seg])
        dts = de[:, None] * p["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (h > 0)
        return {
            "W": f["x"].T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds,
            "w": (t * s).T @ de, "c": f["z"].T @ out, "d": out.sum(keepdims=True),
        }


def train(
    x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 128
) -> Model:
    """Fit by Adam on mini-batches of whole documents."""
    model = Model(x.mean(0), x.std(0) + 1e-3)
    rng = np.random.default_rng(11)
    ends = np.append(first[1:], len(x))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(g) for k, g in model.p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for chosen in np.array_split(order, max(1, len(y) // batch)):
            step += 1
            sizes = ends[chosen] - first[chosen]
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            rows = np.repeat(first[chosen] - begin, sizes) + np.arange(sizes.sum())
            for k, g in model.gradients(x[rows], begin, y[chosen]).items():
                g = g + 1e-4 * model.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.p[k] -= 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_col: Column) -> Column:
    """One id in five, by its checksum; its label is never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most_labelled: int = 6_000,
    most_chars: int = 200_000,
) -> Model | None:
    """Learn from at most ``most_labelled`` labelled texts of at most ``most_chars`` characters.

    The sample is the labelled ids with the smallest hashes among those not held out.
    Its ids are broadcast, its passages are encoded where the texts lie, and one task
    fits the model, whose weights alone return to the driver. Ids labelled both ways
    are left out, as are null labels and ids. None where nothing is labelled.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .where(~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).alias("_lo"), F.max(label_col).alias("_hi"))
        .where("_lo = _hi")
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(most_labelled)
        .select("_id", F.col("_lo").cast("double").alias("_label"))
    )
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(
        F.broadcast(known), "_id"
    ).where(F.coalesce(F.length("text"), F.lit(0)) <= most_chars)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x, first = encode(text_bytes(part["text"]))
                yield pa.RecordBatch.from_pydict({
                    "name": part["_id"].cast(pa.string()), "label": part["_label"],
                    "x": pa.array([r.tobytes() for r in np.split(x, first[1:])], pa.binary()),
                })

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(
            (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("name", "label", "x")))),
            key=lambda r: (r[0], r[2]),
        )
        if rows:
            parts = [np.frombuffer(r[2], np.float32).reshape(-1, WIDTH) for r in rows]
            first = np.cumsum([0] + [len(p) for p in parts[:-1]])
            model = train(np.concatenate(parts), first, np.array([r[1] for r in rows], np.float32))
            packed = pickle.dumps(model.weights())
            yield pa.RecordBatch.from_pydict({"weights": pa.array([packed], pa.binary())})

    fitted = (
        sample.mapInArrow(featurize, "name string, label double, x binary")
        .repartition(1)
        .mapInArrow(learn, "weights binary")
        .collect()
    )
    return Model.of(pickle.loads(fitted[0]["weights"])) if fitted else None


def _scores(model, texts: list[bytes | None]) -> tuple[np.ndarray, list[int], list[float]]:
    """Score, most attended passage and its weight of every text."""
    if model is None:
        return np.full(len(texts), 0.5), [0] * len(texts), [1.0] * len(texts)
    each, first = blocks(texts)
    parts = [(f["h"], f["t"] * f["s"]) for f in map(model.hidden, each)]
    f = model.attend(*(np.concatenate(p) for p in zip(*parts)), first)
    weights = np.split(f["a"], first[1:])
    return f["score"].astype(np.float64), [int(w.argmax()) for w in weights], [float(w.max()) for w in weights]


def score(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``score`` (0 to 1), ``passage`` (the most attended one), ``attention`` of each row.

    The whole text is read and nothing else. A null text is scored as an empty one,
    which is a single passage without words. Without a model the score is 0.5. Ids may
    be null or repeated. An empty table gives an empty result. Rows stay where they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(model and model.weights())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(held.value)
        for batch in batches:
            for part in slices(batch, "text"):
                scores, passages, weights = _scores(model, text_bytes(part["text"]))
                yield pa.RecordBatch.from_pydict({
                    "id": part["id"], "score": pa.array(scores),
                    "passage": pa.array(passages, pa.int64()),
                    "attention": pa.array(weights, pa.float64()),
                })

    return rows.mapInArrow(scan, T.StructType([
        rows.schema["id"], T.StructField("score", T.DoubleType()),
        T.StructField("passage", T.LongType()), T.StructField("attention", T.DoubleType()),
    ]))


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text", least: float = GOOD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least``, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model and model.weights())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(held.value)
        for batch in batches:
            for part in slices(batch, text_col):
                scores, _, _ = _scores(model, text_bytes(part[text_col]))
                yield part.filter(pa.array(scores >= least))

    return docs.mapInArrow(scan, docs.schema)
