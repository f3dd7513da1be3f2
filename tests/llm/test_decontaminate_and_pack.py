import random
import re
import time
from collections import Counter, defaultdict

from llm.samples import docs, prose
from tiergraph.llm import decontaminate, pack

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def expected(text, items, window=13):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        own = words(item)
        size = min(window, len(own))
        if name is None or not own:
            continue
        wanted = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in wanted:
                hit.update(range(i, i + size))
                names.add(str(name))
    return len(w), len(hit), sorted(names)


ITEMS = [
    (1, prose(5, 40)), (2, prose(5, 40)), (10, prose(6, 13)), (3, "Short Item É"), (4, "unique9"),
    (5, None), (6, "... !!"), (None, prose(7, 20)), (1, prose(8, 15)), (7, "beta beta beta beta"),
]


def rows():
    r = random.Random(3)
    out = [(0, None), (1, ""), (2, "..."), (3, prose(5, 40)), (4, prose(6, 13).upper()), (5, prose(6, 12)),
           (6, "a short item é b"), (7, "unique9, unique9"), (8, prose(7, 20)), (None, prose(8, 15)),
           (9, "beta " * 9), (9, "short item E"), (10, prose(11, 20_000) + " " + prose(5, 20))]
    for i in range(40):
        own = words(r.choice(ITEMS)[1])
        cut = r.randrange(len(own) + 1)
        out.append((100 + i, " ".join([prose(i, r.randrange(9)), *own[cut : cut + r.randrange(30)], prose(i + 1, 5)])))
    return out


def test_hits_match_brute_force_in_one_block_and_in_many(spark, monkeypatch):
    source, bench = docs(spark, rows()), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = Counter((i, *(map(str, expected(t, ITEMS)))) for i, t in rows())
    for size, most, run in ((4 << 20, 16, 1), (200, 1, 1), (200, 16, 32 << 20), (90, 3, 2_000)):
        monkeypatch.setattr(decontaminate, "RUN_BYTES", run)
        got = decontaminate.contamination(source, bench, block_bytes=size, blocks_a_pass=most).collect()
        assert Counter((r["id"], str(r["n_words"]), str(r["n_hit"]), str(r["items"])) for r in got) == want
        assert all(r["n_hit"] == sum(b - a for a, b in r["spans"]) for r in got)


def test_short_and_overlapping_items_do_not_shorten_spans(spark):
    long = prose(21, 40).split()
    items = [(1, " ".join(long)), (2, " ".join(long[3:8])), (3, " ".join(long[5:30])), (4, " ".join(long[20:34]))]
    texts = [(1, " ".join([*long, *prose(22, 760).split()])), (2, " ".join(long)), (3, "x " + " ".join(long[2:20]) + " y")]
    source, bench = docs(spark, texts), spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    want = {i: expected(t, items) for i, t in texts}
    assert want[1][:2] == (800, 40)
    for size in (4 << 20, 1):
        got = decontaminate.contamination(source, bench, block_bytes=size)
        rows = got.withColumn("c", decontaminate.contaminated()).collect()
        assert {r["id"]: (r["n_words"], r["n_hit"], r["items"]) for r in rows} == want
        assert all(r["c"] for r in rows)


def test_blocks_are_read_as_they_are_searched(spark, monkeypatch):
    taken, at_passes, stored = [], [], decontaminate.stored

    def blocks(benchmark, most):
        for i in range(4):
            taken.append(i)
            yield [(str(i), f"word{i}".encode())]

    def noted(rows):
        at_passes.append(len(taken))
        return stored(rows)

    monkeypatch.setattr(decontaminate, "_blocks", blocks)
    monkeypatch.setattr(decontaminate, "stored", noted)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for most, passes in ((1, [2, 3, 4]), (2, [3]), (16, [])):
        taken.clear(), at_passes.clear()
        got = decontaminate.contamination(docs(spark, [(1, "word0 x word3 word2")]), bench, blocks_a_pass=most).first()
        assert at_passes == passes and got["items"] == ["0", "2", "3"] and got["n_hit"] == 3


def test_repeated_windows_are_compared_once():
    hot = ["same"] * 20_000
    items = [("a", " ".join(hot).encode()), *((f"b{i}", b"same " * 40) for i in range(500))]
    tables = decontaminate.tables_of(items, 13)
    assert len(tables) == 1 and len(tables[0].names) == 1
    start, spans, found = time.process_time(), [], set()
    tables[0].search([w.encode() for w in hot], spans, found)
    assert decontaminate.merged(spans) == [(0, 20_000)] and found == {name for name, _ in items}
    assert time.process_time() - start < 2


def test_windows_of_one_hash_are_told_apart():
    table = decontaminate.WindowTable(2)
    table.add("a", [b"x", b"y"])
    (alike,) = table.bucket[(b"x", b"y")].values()
    alike[0] = (0, [b"x", b"z"], 2)
    spans, found = [], set()
    table.search([b"x", b"y"], spans, found)
    assert not spans and not found


def test_drop_keeps_clean_rows_whole(spark):
    source, bench = docs(spark, rows()), spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.drop_contaminated(source, bench)
    assert kept.columns == source.columns
    want = Counter()
    for i, t in rows():
        n, hit, _ = expected(t, ITEMS)
        if not (hit and 20 * hit >= n):
            want[(i, t)] += 1
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want


def test_empty_sides(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(docs(spark, [(1, "a b")]), none).collect()
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in got] == [(2, 0, [])]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0


def naive(pieces, capacity):
    bins, out = [], []
    for cost, source, cluster in pieces:
        best = None
        for no, (room, sources, clusters) in enumerate(bins):
            if room >= cost and source not in sources and cluster not in clusters:
                if best is None or (room, no) < (bins[best][0], best):
                    best = no
        if best is None:
            bins.append([capacity, set(), set()])
            best = len(bins) - 1
        room, sources, clusters = bins[best]
        out.append((best, capacity - room))
        bins[best][0] -= cost
        sources |= {source} - {None}
        clusters |= {cluster} - {None}
    return out


def test_best_fit_matches_a_plain_search():
    r = random.Random(1)
    for trial in range(60):
        n = r.choice([0, 1, 5, 60, 400])
        pieces = [
            (r.randrange(1, 60), r.choice([None, *"aaabcdefg"]), r.choice([None, *range(1 + trial)]))
            for _ in range(n)
        ]
        if trial % 2:
            pieces.sort(key=lambda p: -p[0])
        assert pack.best_fit(pieces, 100) == naive(pieces, 100)


def test_pack_places_every_character_once(spark):
    r = random.Random(2)
    given = [(i, prose(i % 30, r.randrange(0, 60)), f"s{min(i % 9, 3)}") for i in range(300)]
    given += [(900, None, "s1"), (901, "", None), (902, "é" * 2_500, "s1"), (None, "no id", "s2"), (5, "again", "s1"),
              (903, "y" * 99, "s1"), (904, "y" * 198, "s2")]
    source = docs(spark, given)
    got = pack.pack(source, capacity=100, shard_rows=64).collect()
    text = defaultdict(list)
    for i, t, s in given:
        text[i].append((t or "", s))
    want, pieces = Counter(), Counter()
    for i, t, _ in given:
        n = len(t or "")
        for k in range(max(1, -(-n // 99))):
            want[(i, k, k * 99, min(99, n - k * 99))] += 1
    for row in got:
        pieces[(row["id"], row["piece"], row["start"], row["length"])] += 1
    assert pieces == want
    bins = defaultdict(list)
    for row in got:
        bins[row["bin"]].append(row)
    for inside in bins.values():
        inside.sort(key=lambda x: x["offset"])
        end = 0
        for row in inside:
            assert row["offset"] == end
            end += row["length"] + 1
        assert end <= 100
        ids = [x["id"] for x in inside if x["id"] not in (5, None, 901)]
        sources = [text[i][0][1] for i in ids]
        assert len(set(sources)) == len(sources)
        whole = [text[i][0][0].lower() for i in ids]
        assert len(set(whole)) == len(whole)
    assert pack.pack(docs(spark, []), capacity=100).count() == 0


def test_a_shard_of_repeated_rows_is_cut_into_runs(spark):
    got = pack.pack(docs(spark, [(1, "same words", "s")] * 500), capacity=100, shard_rows=32).collect()
    assert len(got) == 500 and len({r["bin"] for r in got}) == 500
