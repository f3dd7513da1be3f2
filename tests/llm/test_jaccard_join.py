import random
from collections import Counter

import numpy as np
import pytest

from llm.samples import docs, edited, prose
from tiergraph.llm import jaccard_join
from tiergraph.llm import shingles as shingles_module
from tiergraph.llm.components import components
from tiergraph.llm.shingles import U64, shingle_sets


def shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = [x for x in w.replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return Counter((i, len(s), root(i)) for i, s in sets)


def corpus():
    rows, r = [], random.Random(4)
    for g in range(12):
        base = prose(g, r.choice([6, 9, 40, 120, 400]))
        for k in range(r.randrange(1, 7)):
            rows.append((len(rows), edited(base, 100 * g + k, r.choice([0, 0.01, 0.02, 0.05]))))
    shared = prose(77, 60)
    rows += [(500 + i, shared + " " + prose(800 + i, r.choice([8, 14, 60]))) for i in range(20)]
    rows += [(700, None), (701, ""), (702, "one"), (703, "ONE"), (704, "a b c d"), (705, "a\tb  c\nd"),
             (706, "É b c d e"), (707, "é b c d e"), (708, "r " * 30), (709, "r " * 50), (710, " ")]
    return rows


@pytest.mark.parametrize("block", [1_000, 2])
def test_groups_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = jaccard_join.near_groups(docs(spark, corpus())).collect()
    assert Counter((r["id"], r["n_shingles"], r["component"]) for r in got) == expected(corpus())


def test_rows_without_id_and_repeated_ids(spark):
    a = prose(1, 30)
    got = jaccard_join.near_groups(docs(spark, [(None, a), (3, a), (2, a), (2, "x y"), (9, "x y"), (9, "x y")])).collect()
    assert Counter((r["id"], r["component"]) for r in got) == Counter(
        {(None, None): 1, (3, 2): 1, (2, 2): 2, (9, 2): 2}
    )
    assert jaccard_join.near_groups(docs(spark, [])).count() == 0


def test_prefix_tree_links_what_is_similar_and_nothing_else():
    r = np.random.default_rng(5)
    for _ in range(30):
        base = [np.unique(r.integers(1, 2**62, r.integers(2, 60)).astype(U64)) for _ in range(4)]
        sets = []
        for _ in range(40):
            s = base[r.integers(4)]
            s = s[r.random(len(s)) > r.choice([0, 0.05, 0.2])]
            s = np.union1d(s, r.integers(1, 2**62, r.integers(0, 4)).astype(U64))
            if len(s):
                sets.append(s)
        tree = jaccard_join.PrefixTree()
        for s in sets:
            tree.add(s)
        rows = [(i, set(s.tolist())) for i, s in enumerate(sets)]
        parent = list(range(len(rows)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, a in rows:
            for j, b in rows[:i]:
                if 100 * len(a & b) >= 80 * len(a | b):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
        assert [tree.root(i) for i in range(len(rows))] == [root(i) for i in range(len(rows))]
        assert tree.groups == len({root(i) for i in range(len(rows))})


def test_similar_sets_share_signature_tokens():
    r = np.random.default_rng(6)
    for trial in range(300):
        n = int(r.integers(1, 700))
        a = np.unique(r.integers(1, 2**63, n).astype(U64))
        late = r.random(len(a)) < r.choice([0, 0.3, 0.7, 1])
        a = np.sort(np.where(late, a | jaccard_join.FREQUENT, a))
        drop = int(len(a) * 0.2)
        at = r.permutation(len(a))[:drop] if trial % 2 or len(a) > 200 else np.arange(drop)
        b = np.delete(a, at)
        common = len(np.intersect1d(a, b))
        assert jaccard_join.similar(common, len(a), len(b))
        shared = np.intersect1d(jaccard_join.signature(a), jaccard_join.signature(b))
        assert len(shared) >= min(map(jaccard_join.least_shared, (len(a), len(b))))


def test_shingle_hashes_follow_the_words():
    a, b, c, d = shingle_sets([b"A b  c d e f", b"a b\nc\td e f", b"b a c d e f", b""])
    assert (a == b).all() and len(a) == 2 and not set(a) & set(c) and len(d) == 0
    long = prose(3, 5_000).encode()
    assert (next(shingle_sets([long])) == list(shingle_sets([b"x", long, None]))[1]).all()


def test_long_texts_are_hashed_in_segments(monkeypatch):
    text = (prose(3, 3_000) + " " + "z" * 9_000 + "  tail\n").encode()
    whole = list(shingle_sets([text, b"", text[:100]]))
    monkeypatch.setattr(shingles_module, "SEGMENT", 64)
    assert all((a == b).all() for a, b in zip(whole, shingle_sets([text, b"", text[:100]])))


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 299)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
