"""Cross-tokenizer alignment: where the tokens of a byte-level BPE and of pieces end together.

Character offsets of the first tokenizer and the spans of the second's pieces (the installed
library gives those of its former immutable proto as an offset mapping) are coarse cuts of a
text's bytes. A token inside a multibyte character, or of byte fallback, has no
cut of its own there, so its end comes from the decoded bytes of the tokens before it. The
ends that both tokenizers have cut the tokens into groups; each such end links one token of
either side.

Both tokenizers break a text before a space between two visible characters: the byte-level
pattern never runs past a visible character into a space, and no piece holds a space after
another character (looked up in the vocabulary). So a task tokenizes every different run of
text between such spaces once and puts texts together from runs; where the tokenizers don't
guarantee it, a run is the whole text. The tests compare with whole texts.

Texts that are null or empty, or whose tokens' joined bytes are not the text with a space
before it, have no tokens. Rows are told apart by position, so ids may be null or repeat. An
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiergraph.llm.common import slices, stored

TOKENIZERS = "/opt/tokenizers"
#: A space between two visible characters; what counts as visible is on the safe side.
CUT = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")
#: Different runs a task remembers (about 300 bytes each); longer runs are not kept.
MOST_RUNS, LONG_RUN = 700_000, 200
#: Runs that are tokenized at once.
LEARNED_AT_ONCE = 16_384
#: Entries of the count table (17 bytes each) that may be broadcast: 68 MB.
BROADCAST_PAIRS = 4_000_000
SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: visible Latin-1 bytes as themselves, the rest from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers with the bytes of all their tokens."""

    def __init__(self, a_json: bytes, b_model: bytes):
        # A task has one core; the library would start threads for all of the machine.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            plain = all(c in alphabet for c in piece)
            self.a_bytes[i] = bytes(alphabet[c] for c in piece) if plain else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        form = json.loads(a_json)
        splits = form["normalizer"] is None and form["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True,
        }
        self.runs_are_free = splits and not any(SPACE in p.lstrip(SPACE) for p in pieces)

        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def tokens(self, runs: list[str]) -> tuple[list[list[int]], list[list[tuple]], list[list[int]], list[list[tuple]]]:
        """Ids and character spans of both sides for texts that begin with a space."""
        encoded = self.a.encode_batch(runs, add_special_tokens=False)
        # The model puts a space before every text itself. Its proto's spans, in characters.
        spans = self.b.encode([r[1:] for r in runs], return_type="offset_mapping", num_threads=1)
        return (
            [e.ids for e in encoded], [e.offsets for e in encoded],
            [m["ids"] for m in spans], [m["offsets"] for m in spans],
        )


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``start .. start + size`` of all ranges behind each other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Side:
    """The tokens of one tokenizer over texts that lie behind each other."""

    def __init__(self, ids: list[list[int]], spans: list[list[tuple]], shift: int, size: np.ndarray, text: Layout):
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.n = n
        self.of = np.repeat(np.arange(len(ids)), n)
        self.ids = np.fromiter(chain.from_iterable(ids), np.int64, n.sum())
        last = np.fromiter((e for _, e in chain.from_iterable(spans)), np.int64, n.sum())
        coarse = text.byte_at[text.char_start[self.of] + last + shift]
        self.size = size[self.ids]
        total = np.cumsum(self.size)
        before = np.concatenate([[0], total])[np.cumsum(n) - n]
        decoded = total - before[self.of] + text.byte_start[self.of]
        # Inside a character, or a byte of one, the coarse cut is not the token's end.
        self.ends = np.where(coarse == decoded, coarse, decoded)
        self.whole = np.bincount(self.of, self.size, len(ids)) == text.bytes

    def differs(self, pool: np.ndarray, first: np.ndarray, text: Layout) -> np.ndarray:
        """Texts whose joined token bytes are not their own bytes."""
        bad = ~self.whole
        some = self.whole[self.of]
        size, ends, ids = self.size[some], self.ends[some], self.ids[some]
        wrong = pool[_ragged(first[ids], size)] != text.raw[_ragged(ends - size, size)]
        bad[np.repeat(self.of[some], size)[wrong]] = True
        return bad

    def keep(self, good: np.ndarray) -> None:
        some = good[self.of]
        self.of, self.ids, self.ends = self.of[some], self.ids[some], self.ends[some]


class Layout:
    """Where the characters and bytes of texts lie when they are put behind each other."""

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        self.raw = np.frombuffer(joined.encode(), np.uint8)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        self.byte_at = np.concatenate([[0], np.cumsum(width)])
        chars = np.fromiter(map(len, texts), np.int64, len(texts))
        self.char_start = np.cumsum(chars) - chars
        self.byte_start = self.byte_at[self.char_start]
        self.bytes = self.byte_at[self.char_start + chars] - self.byte_start


class Runs:
    """Every different run once: token numbers, groups, links as codes ``a * size_b + b``."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.size_b = len(pair.b_bytes)
        self.names = [np.array([str(i) for i in range(len(t))], object) for t in (pair.a_bytes, pair.b_bytes)]
        self.pools = [
            (np.frombuffer(b"".join(t), np.uint8), np.cumsum(size) - size)
            for t, size in ((pair.a_bytes, pair.a_size), (pair.b_bytes, pair.b_size))
        ]
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        none = np.zeros(0, np.int64)
        self.n_a, self.n_b, self.n_links, self.codes = none, none, none, none
        self.long: list[str] = []

    def number(self, texts: list[list[str]]) -> None:
        """Learn the runs of some texts; numbers given before may change."""
        if len(self.groups) > MOST_RUNS:
            self._clear()
        for run in self.long:
            # Its number stays taken until the next clearing, its text is let go.
            del self.at[run]
        new = [r for r in dict.fromkeys(chain.from_iterable(texts)) if r not in self.at]
        self.long = [r for r in new if len(r) > LONG_RUN]
        self.at.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
        for i in range(0, len(new), LEARNED_AT_ONCE):
            self._learn(new[i : i + LEARNED_AT_ONCE])

    def _learn(self, new: list[str]) -> None:
        text = Layout(new)
        a_ids, a_spans, b_ids, b_spans = self.pair.tokens(new)
        a = Side(a_ids, a_spans, 0, self.pair.a_size, text)
        b = Side(b_ids, b_spans, 1, self.pair.b_size, text)
        good = ~(a.differs(*self.pools[0], text) | b.differs(*self.pools[1], text))
        a.keep(good)
        b.keep(good)
        ends_here = np.zeros((2, len(text.raw) + 1), bool)
        ends_here[0, a.ends] = True
        ends_here[1, b.ends] = True
        common = ends_here[0] & ends_here[1]
        closes_a, closes_b = common[a.ends], common[b.ends]
        n_links = np.bincount(a.of[closes_a], minlength=len(new))
        codes = a.ids[closes_a] * self.size_b + b.ids[closes_b]
        # Links before a token number its group, the same way on both sides.
        place = np.concatenate([2 * (np.cumsum(c) - c) + side for side, c in enumerate((closes_a, closes_b))])
        order = np.argsort(place, kind="stable")
        place, of = place[order], np.concatenate([a.of, b.of])[order]
        names = np.concatenate([self.names[0][a.ids], self.names[1][b.ids]])[order]
        step = np.full(len(order), 3)
        step[:-1] = np.where(of[1:] != of[:-1], 3, np.where(
            place[1:] == place[:-1], 0, np.where(place[1:] // 2 == place[:-1] // 2, 1, 2)))
        pieces = np.empty(2 * len(order), object)
        pieces[0::2], pieces[1::2] = names, np.array([",", "|", ";", "\n"], object)[step]
        told = iter("".join(pieces.tolist()).split("\n"))
        self.groups += [next(told) if ok else "" for ok in good.tolist()]
        # -1 marks a run whose bytes differ: its whole text has no tokens.
        add = lambda known, x: np.concatenate([known, x])
        self.n_a, self.n_b = add(self.n_a, np.where(good, a.n, -1)), add(self.n_b, np.where(good, b.n, -1))
        self.n_links, self.codes = add(self.n_links, n_links), add(self.codes, codes)


def _aligned_batch(batch: pa.RecordBatch, runs: Runs) -> pa.RecordBatch:
    texts = batch.column("text").to_pylist()
    cut = CUT.split if runs.pair.runs_are_free else lambda t: [t]
    parts = [[" " + p for p in cut(t)] if t else [] for t in texts]
    runs.number(parts)
    n_runs = np.fromiter(map(len, parts), np.int64, len(parts))
    numbers = list(map(runs.at.__getitem__, chain.from_iterable(parts)))
    k = np.array(numbers, np.int64)
    of_text = np.repeat(np.arange(len(parts)), n_runs)
    whole = np.bincount(of_text, runs.n_a[k] < 0, len(parts)) == 0
    last = np.cumsum(n_runs)
    text_groups = [
        ";".join([runs.groups[i] for i in numbers[e - n : e]]) if ok else ""
        for ok, n, e in zip(whole.tolist(), n_runs.tolist(), last.tolist())
    ]
    good = whole[of_text]
    k, of_text = k[good], of_text[good]
    total = lambda x: np.bincount(of_text, x[k], len(parts)).astype(np.int64)
    sizes = runs.n_links
    first = np.cumsum(sizes) - sizes
    codes = runs.codes[_ragged(first[k], sizes[k])]
    owner = np.repeat(of_text, sizes[k])
    most = len(runs.pair.a_bytes) * runs.size_b
    both = np.sort(owner * most + codes)
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    times = np.diff(np.append(at, len(both)))
    owner, codes = np.divmod(both[at], most)
    offsets = pa.array(np.searchsorted(owner, np.arange(len(parts) + 1)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            batch.column("id"), pa.array(total(runs.n_a)), pa.array(total(runs.n_b)), pa.array(total(sizes)),
            pa.array(text_groups, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(codes)),
            pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
        ],
        names=["id", "n_a", "n_b", "n_groups", "groups", "links", "times"],
    )


def align(
    docs: DataFrame,
    a_file: str = f"{TOKENIZERS}/byte_bpe_50k.json",
    b_file: str = f"{TOKENIZERS}/piece_bpe_32k.model",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, n_a, n_b, n_groups, groups, links, times)`` of every row.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3`` in ids; ``links`` has the different linked pairs
    as codes (see ``link_size``) and ``times`` how often the text has each. The files are
    read by the driver and sent to the tasks: two vocabularies, whatever the corpus.
    """
    files = docs.sparkSession.sparkContext.broadcast((Path(a_file).read_bytes(), Path(b_file).read_bytes()))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(Pair(*files.value))
        for batch in batches:
            for part in slices(batch, "text"):
                yield _aligned_batch(part, runs)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(
        aligned,
        f"id {kind}, n_a long, n_b long, n_groups long, groups string, links array<long>, times array<int>",
    )


def link_size(b_file: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> int:
    """The factor of a link's code: ``code = a * link_size + b``."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size()


def link_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``(link, n, best)``: how often the corpus links a pair, and if no pair of its b id beats it."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, at = np.unique(batch.column("links").flatten().to_numpy(), return_inverse=True)
            times = batch.column("times").flatten().to_numpy()
            n = np.bincount(at, times, len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["link", "n"])

    found = aligned.select("links", "times").mapInArrow(summed, "link long, n long")
    counts = found.groupBy("link").agg(F.sum("n").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.pmod("link", F.lit(size_b))))
    return counts.withColumn("best", F.col("n") == top)


def scored(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Replace ``links`` and ``times`` by ``n_best`` and ``count_sum`` over the text's links.

    A pair that occurs once and is not its b id's best needs no entry. Up to
    ``broadcast_pairs`` others are broadcast; more are joined by pair, with equal sums.
    ``aligned`` should be a written table, as it is read twice in the second case.
    """
    entries = counts.where("n > 1 or best")
    if entries.limit(broadcast_pairs + 1).count() > broadcast_pairs:
        return _scored_by_join(aligned, entries)
    table = entries.toArrow()
    codes = table.column("link").to_numpy()
    order = np.argsort(codes)
    n, best = (table.column(c).to_numpy()[order] for c in ("n", "best"))
    sent = aligned.sparkSession.sparkContext.broadcast((codes[order], n, best))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            links, times = (batch.column(c) for c in ("links", "times"))
            code, t = links.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            there = known[at] == code if len(known) else np.zeros(len(code), bool)
            count = np.where(there, n[at], 1) if len(known) else np.ones(len(code), np.int64)
            is_best = there & best[at] if len(known) else there
            offsets = links.offsets.to_numpy()
            offsets = offsets - offsets[0]
            total = lambda x: pa.array(np.diff(np.append(0, np.cumsum(x))[offsets]).astype(np.int64))
            rest = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*rest, total(t * is_best), total(t * count)], names=[*kept, "n_best", "count_sum"]
            )

    kept = [c for c in aligned.columns if c not in ("links", "times")]
    schema = ", ".join(f"`{c}` {k}" for c, k in aligned.dtypes if c in kept)
    return aligned.mapInArrow(scores, f"{schema}, n_best long, count_sum long")


def _scored_by_join(aligned: DataFrame, entries: DataFrame) -> DataFrame:
    rows = stored(aligned.withColumn("row_key", F.monotonically_increasing_id()))
    each = rows.select("row_key", F.inline(F.arrays_zip("links", "times")))
    met = each.join(entries, each["links"] == entries["link"], "left")
    count: Column = F.coalesce("n", F.lit(1)) * F.col("times")
    sums = met.groupBy("row_key").agg(
        F.sum(F.when(F.coalesce("best", F.lit(False)), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(count).alias("count_sum"),
    )
    return rows.drop("links", "times").join(sums, "row_key", "left").drop("row_key").na.fill(0, ["n_best", "count_sum"])
