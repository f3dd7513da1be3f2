"""Task-side helpers of the company timeline: alike wordings of a group, greedy merge of a stream."""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

# Executors get this module with the job and need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Facts:
    """Facts kept so far of one component, found again by shared tokens."""

    def __init__(self, similarity: float):
        self.similarity = similarity
        self.kept: list[dict] = []
        self.tokens: list[frozenset] = []
        self.postings: dict[str, set[int]] = {}

    def _same(self, tokens: frozenset) -> int | None:
        shared = Counter(i for t in tokens for i in self.postings.get(t, ()))
        alike = (
            i for i, n in shared.items()
            if n / (len(tokens) + len(self.tokens[i]) - n) >= self.similarity
        )
        return min(alike, default=None)

    def add(self, item: dict, tokens: frozenset) -> None:
        at = self._same(tokens)
        if at is None:
            at = len(self.kept)
            self.kept.append(item)
            self.tokens.append(tokens)
        elif item["units"] > self.kept[at]["units"]:
            for t in self.tokens[at]:
                self.postings[t].discard(at)
            self.kept[at] = {**item, "place": self.kept[at]["place"]}
            self.tokens[at] = tokens
        else:
            return
        for t in tokens:
            self.postings.setdefault(t, set()).add(at)


def merge_facts(
    batches: Iterator[pd.DataFrame], similarity: float, columns: Sequence[str]
) -> Iterator[pd.DataFrame]:
    """Stream sorted sentences and emit the facts of each component when it ends."""
    group, facts = None, _Facts(similarity)

    def finished() -> list[dict]:
        return [{"company": group[0], "year": group[1], **item} for item in facts.kept]

    for batch in batches:
        done: list[dict] = []
        for row in batch.itertuples(index=False):
            key = (row.company, row.year, row.component)
            if key != group:
                if group is not None:
                    done += finished()
                group, facts = key, _Facts(similarity)
            item = {"when": row.when, "text": row.text, "units": row.units, "place": row.place}
            facts.add(item, frozenset(row.tokens.split()))
        yield pd.DataFrame(done, columns=list(columns))
    if group is not None:
        yield pd.DataFrame(finished(), columns=list(columns))


def linked_rows(wordings: Sequence[str], similarity: float) -> list[int | None]:
    """For every row the first row that a chain of alike wordings ties it to; null without any.

    ``wordings`` are the joined tokens of one group. Two alike sets share one of their rarest
    tokens: of n tokens in a common order the first ``n - ceil(similarity * n) + 1``.
    """
    sets = [frozenset(w.split()) for w in wordings]
    often = Counter(t for s in sets for t in s)
    rank = {t: i for i, t in enumerate(sorted(often, key=lambda t: (often[t], t)))}
    root, seen, postings = list(range(len(sets))), {}, {}

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, tokens in enumerate(sets):
        same = seen.setdefault(tokens, i)
        if same != i:
            root[i] = top(same)
            continue
        size = len(tokens)
        # A hair less than exact keeps rounding from shortening the prefix or the range of sizes.
        least, most = size * similarity - 1e-9, size / similarity + 1e-9
        tried = set()
        for t in sorted(tokens, key=rank.__getitem__)[: size - math.ceil(least) + 1]:
            others = postings.setdefault(t, [])
            for j in others:
                if j in tried:
                    continue
                tried.add(j)
                other = sets[j]
                if least <= len(other) <= most:
                    shared = len(tokens & other)
                    if shared / (size + len(other) - shared) >= similarity:
                        a, b = top(i), top(j)
                        root[max(a, b)] = min(a, b)
            others.append(i)
    tops = [top(i) for i in range(len(sets))]
    many = Counter(tops)
    return [t if many[t] > 1 else None for t in tops]


def link_groups(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Add ``component`` to rows that come sorted by company and year; one group is held at a time."""

    def linked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = list(zip(rows["company"].to_pylist(), rows["year"].to_pylist()))
        tokens, found, start = rows["tokens"].to_pylist(), [], 0
        for at in range(1, len(keys) + 1):
            if at == len(keys) or keys[at] != keys[start]:
                found += linked_rows(tokens[start:at], similarity)
                start = at
        return rows.append_column("component", pa.array(found, pa.int64())).to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch["company"].to_pylist(), batch["year"].to_pylist()))
        start = len(keys) - 1
        while start and keys[start - 1] == keys[-1]:
            start -= 1
        goes_on = not start and held and keys[-1] == (held[-1]["company"][-1].as_py(), held[-1]["year"][-1].as_py())
        if not goes_on:
            done = held + ([batch.slice(0, start)] if start else [])
            if done:
                yield from linked(pa.Table.from_batches(done))
            held = []
        held.append(batch.slice(start))
    if held:
        yield from linked(pa.Table.from_batches(held))
