"""Line dedup, hard negatives and token alignment against plain re-computations."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm.samples import docs, prose
from tiergraph.llm import hard_negatives, line_dedup, token_align

WHITE = " \t\n\x0b\x0c\r"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def without_lines(texts, min_docs, min_chars):
    keys = [[lower(x.strip(WHITE)) for x in (t or "").split("\n")] for t in texts]
    seen = Counter(k for ks in keys for k in set(ks) if len(k) >= min_chars)
    out = []
    for t, ks in zip(texts, keys):
        stay = [x for x, k in zip((t or "").split("\n"), ks) if seen[k] < min_docs]
        out.append((len(ks), len(ks) - len(stay), "\n".join(stay)))
    return out


TEXTS = [
    None, "", "\n", "Shared line\nown 1", " shared LINE\t\nown 2\n", "shared line", "a\nb\n\n\na", "\xa0a\nA",
    "É\nx", "é\nX", "x" * 200_000 + "\n" + "shared line\n" * 3_000, "shared line\n" + "b\n" * 50, "own 1", "É",
]


@pytest.mark.parametrize("most", [10**6, 0])
def test_lines_match_brute_force(spark, most):
    rows = [(i % 5 if i % 3 else None, t) for i, t in enumerate(TEXTS)]
    for min_docs, min_chars in ((2, 1), (3, 2), (1, 1), (99, 1)):
        got = line_dedup.dedup(docs(spark, rows), min_docs, min_chars, broadcast_lines=most).collect()
        want = without_lines(TEXTS, min_docs, min_chars)
        assert Counter(map(tuple, got)) == Counter((i, *w) for (i, _), w in zip(rows, want)), (min_docs, min_chars)
    assert line_dedup.dedup(docs(spark, []), broadcast_lines=most).count() == 0


def test_perfect_hash_numbers_every_key_once():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(-(2**63), 2**63 - 1, 50_000))
    for n_shards in (1, 7):
        shards = []
        for s in range(n_shards):
            mine = keys[np.mod(keys, n_shards) == s]
            n_docs = (mine % 1_000 + 10).astype(np.uint32)
            sizes, words, prints, counts = line_dedup.build_shard(mine.view(np.uint64), n_docs)
            assert len(prints) == len(mine) and sorted(prints) == sorted(mine.view(np.uint64))
            assert 64 * len(words) < 6 * len(mine)
            shards.append((s, sizes, words, prints, counts))
        index = line_dedup.Index(n_shards, shards[::-1])
        assert (index.counts_of(keys) == keys % 1_000 + 10).all()
        assert not index.counts_of(r.integers(-(2**63), 2**63 - 1, 50_000)).any()
    assert line_dedup.Index(1, []).counts_of(keys[:3]).tolist() == [0, 0, 0]


def test_strassen_is_exact_for_all_shapes():
    r = np.random.default_rng(2)
    for m, k, n in ((1, 1, 1), (17, 33, 65), (64, 64, 64), (50, 3, 90), (40, 0, 40), (0, 5, 3), (100, 37, 19)):
        a, b = r.integers(-(2**25), 2**25, (m, k)), r.integers(-(2**25), 2**25, (n, k))
        for leaf in (1, 4, 16):
            assert (hard_negatives.strassen(a, b, leaf) == a @ b.T).all()


def test_window_bounds_are_exact():
    p = np.arange(-500, 500)
    low, high = hard_negatives.percent_window(50, 95)(p)
    s = np.arange(-600, 600)[:, None]
    assert (((50 * p <= 100 * s) & (100 * s <= 95 * p)) == ((low <= s) & (s <= high))).all()


def mined(rows, anchor, n_pos, n_neg):
    whole = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * x)) for x in v]
        if sum(x * x for x in q) < 2**57:
            whole[i] = min(whole.get(i, (label, q)), (label, q))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, (label, q) in whole.items():
        if not anchor(i):
            continue
        scores = sorted((-dot(q, w), j, m) for j, (m, w) in whole.items() if j != i)
        for p, j, _ in [s for s in scores if s[2] == label][:n_pos]:
            fits = [s for s in scores if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:n_neg]
            out += [(i, j, -p, k + 1, n, -s) for k, (s, n, _) in enumerate(fits)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, id string, q string, place string, r string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, m, "x", "x", "x", "x") for i, m, v in rows], VECTORS)


def test_mining_matches_brute_force(spark):
    r = random.Random(3)
    vec = lambda n=7: [r.uniform(-1, 2) for _ in range(n)]
    rows = [(i, r.choice([0, 0, 0, 1, 2, -5]), vec()) for i in range(300)]
    rows += [(400 + i, r.choice([0, 1]), [0.5] * 7) for i in range(60)]  # equal vectors, equal scores
    rows += [(None, 0, vec()), (500, None, vec()), (501, 1, None), (502, 1, [0.1, None]), (503, 0, [float("nan")]),
             (504, 0, [float("inf")]), (505, 1, []), (506, 1, vec(3)), (507, 0, vec(9)), (508, 0, [1e30]),
             (-10, 1, vec()), (10, 2, vec()), (10, 0, vec()), (20, 0, rows[20][2])]
    rows = [(i, m, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, m, v in rows]
    source = vectors(spark, rows)
    for block in (10**6, 5):
        got = hard_negatives.mine(source, hard_negatives.F.col("id") % 10 == 0, 4, 3, block_anchors=block)
        assert got.columns == ["anchor_id", "positive_id", "positive_score", "rank", "negative_id", "negative_score"]
        assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 10 == 0, 4, 3)
    assert hard_negatives.mine(vectors(spark, []), hard_negatives.F.lit(True)).count() == 0
    assert hard_negatives.mine(source, hard_negatives.F.lit(False)).count() == 0


def plain_alignment(texts):
    """Whole texts, tokens by decoded bytes only."""
    with open(f"{token_align.TOKENIZERS}/byte_bpe_50k.json", "rb") as a:
        with open(f"{token_align.TOKENIZERS}/piece_bpe_32k.model", "rb") as b:
            pair = token_align.Pair(a.read(), b.read())
    rows, links = [], []
    for t in texts:
        if not t:
            rows.append((0, 0, "", []))
            continue
        a = pair.a.encode(" " + t, add_special_tokens=False).ids
        b = pair.b.encode(t)
        ends = []
        for ids, parts in ((a, pair.a_bytes), (b, pair.b_bytes)):
            raw = b"".join(parts[i] for i in ids)
            if raw != (" " + t).encode():
                ends = None
                break
            ends.append(np.cumsum([len(parts[i]) for i in ids]).tolist())
        if ends is None:
            rows.append((0, 0, "", []))
            continue
        common = sorted(set(ends[0]) & set(ends[1]))

        def cut(ids, own):
            parts = [[] for _ in common]
            for i, e in zip(ids, own):
                parts[bisect_left(common, e)].append(str(i))
            return [",".join(p) for p in parts]

        groups = ";".join(f"{x}|{y}" for x, y in zip(cut(a, ends[0]), cut(b, ends[1])))
        last = [dict(zip(own, ids)) for ids, own in ((a, ends[0]), (b, ends[1]))]
        linked = [(last[0][e], last[1][e]) for e in common]
        rows.append((len(a), len(b), groups, linked))
        links += linked
    counts = Counter(links)
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(n, top[b])
    return [
        (n_a, n_b, len(linked), hashlib.sha256(g.encode()).hexdigest() if g else "",
         sum(counts[x] == top[x[1]] for x in linked), sum(counts[x] for x in linked))
        for n_a, n_b, g, linked in rows
    ]


def odd_texts():
    r = random.Random(5)
    marks = ["a", "the", " ", "  ", "\n", "\t ", "é", "日本", "👩‍👩‍👧", "ß", ".", "'s", "<0x41>", "<|endoftext|>", "</s>",
             "12", "​", "\xa0", "ﬁ", "Straße", "\r\n", "...", "́", "Ω", "x" * 30, "\x1c", " ", "ı"]
    texts = ["".join(r.choice(marks) + r.choice(["", " "]) for _ in range(r.randrange(1, 40))) for _ in range(150)]
    return texts + [None, "", " ", "  ", "a ", " a", "▁", "a ▁b c", "<unk> <s>", "\x00 a", "é" * 3_000,
                    prose(1, 20_000), prose(1, 20_000), "word " * 500, "\n\n\n"]


def aligned_rows(spark, texts, most=10**6):
    rows = docs(spark, [(i, t) for i, t in enumerate(texts)])
    made = token_align.stored(token_align.align(rows))
    counts = token_align.link_counts(made, token_align.link_size())
    got = {r["id"]: r for r in token_align.scored(made, counts, most).collect()}
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    fields = [got[i] for i in range(len(texts))]
    return [(r["n_a"], r["n_b"], r["n_groups"], digest(r["groups"]), r["n_best"], r["count_sum"]) for r in fields]


@pytest.mark.parametrize("most", [10**6, 0])
def test_alignment_matches_whole_texts(spark, most):
    texts = odd_texts()
    assert aligned_rows(spark, texts, most) == plain_alignment(texts)


def test_alignment_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(token_align, "MOST_RUNS", 3)
    texts = odd_texts()[:30]
    assert aligned_rows(spark, texts) == plain_alignment(texts)
    twice = docs(spark, [(None, "a b"), (7, "a b"), (7, "a b"), (7, None)])
    made = token_align.stored(token_align.align(twice))
    for most in (10**6, 0):
        got = token_align.scored(made, token_align.link_counts(made, token_align.link_size()), most).collect()
        assert Counter((r["id"], r["n_a"], r["count_sum"]) for r in got) == {(None, 2, 6): 1, (7, 2, 6): 2, (7, 0, 0): 1}
    made = token_align.align(docs(spark, []))
    assert token_align.scored(made, token_align.link_counts(made, token_align.link_size())).count() == 0
