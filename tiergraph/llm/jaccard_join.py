"""Near copies: a set similarity join over word shingles with prefix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tiergraph.llm.common import maybe_in, slices, stored, text_bytes
from tiergraph.llm.components import components
from tiergraph.llm.shingles import U64, shingle_sets

#: Slots of the table of shingle counts; its sum over all documents orders the shingles.
SLOT_BITS = 22
CHUNK = 1 << 16
#: Shingles that a task collects before it counts them.
COLLECT = 2_000_000
#: A slot this far above the mean marks its shingles as frequent.
FREQUENT_FACTOR, FREQUENT_LEAST = 2, 64
#: Signature tokens of a class, and how many of them similar sets share. See ``signature``.
DEPTH, SHARED = 48, 7
#: Sets up to this size only meet sets for which the first rule of ``signature`` holds.
SHORT = 150
#: Rounds of dropping tokens and sets that cannot link; more rounds drop more, none a link.
REFINEMENTS = 2
#: Bits of a leaf's bitmap.
BITMAP = 2_048
#: Sets and tokens (8 bytes each) of one prefix tree; more are compared block by block.
BLOCK, BLOCK_TOKENS = 4_000, 4_000_000
#: Bytes of compressed texts that are made sets at once.
UNPACK = 1 << 20
FREQUENT = U64(1 << 63)


def similar(common: int, n: int, m: int) -> bool:
    """Jaccard similarity of at least 0.8, in whole numbers."""
    return 9 * common >= 4 * (n + m)


def ordered(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Sets in the global order: by hash, frequent shingles after all others."""
    late = frequent[(shingles >> U64(64 - SLOT_BITS)).astype(np.int64)]
    return np.sort((shingles >> U64(1)) | np.where(late, FREQUENT, U64(0)))


def least_shared(n: int) -> int:
    """Signature tokens that a set of this size shares with every similar one."""
    return min(SHARED, -(-8 * n // 10))


def signature(tokens: np.ndarray) -> np.ndarray:
    """The tokens of which a set shares at least ``least_shared`` with every similar one.

    Sets with similarity >= 0.8 share k of their first ``n - ceil(0.8 n) + k`` tokens in
    any common order. Up to ``DEPTH`` tokens that rule is used as it is. Beyond, the
    order within rare and within frequent tokens is random. Where frequent tokens are
    few, at least 0.64 of the rare ones are shared, else 0.8 of one class: fewer than
    ``SHARED`` among the first ``DEPTH`` of that class has a chance below 1e-12 a pair,
    less than the sets' own hashes leave.
    """
    n = len(tokens)
    first = n - -(-8 * n // 10) + least_shared(n)
    rare = int(np.searchsorted(tokens, FREQUENT))
    many = n > SHORT and 10 * (n - rare) >= 8 * rare
    late = tokens[rare : rare + DEPTH] if many else tokens[:0]
    early = tokens[: first if first <= DEPTH else min(rare, DEPTH)]
    return np.union1d(early, late)


class _Node:
    __slots__ = ("run", "below", "ends", "least", "most", "one", "mixed", "bits")

    def __init__(self, run: np.ndarray, size: int, one: int, bits: int) -> None:
        self.run, self.least, self.most, self.bits = run, size, size, bits
        #: A set below, and whether another below was of a different group when it came.
        self.one, self.mixed = one, False
        self.below: dict[int, _Node] = {}
        self.ends: list[int] = []


def _bitmap(tokens: np.ndarray) -> int:
    flags = np.zeros(BITMAP, bool)
    flags[(tokens % U64(BITMAP)).astype(np.int64)] = True
    return int.from_bytes(np.packbits(flags).tobytes(), "big")


class PrefixTree:
    """Ordered sets merged along common beginnings; joins each new set to those inside.

    A node holds a run of tokens, so a probe compares a shared beginning once for all
    sets below. The sizes below bound what can still be shared; branches that cannot
    reach the threshold are passed over, as are branches whose sets are all connected to
    the probe already; a search ends once one group is left. At a leaf, every bit that
    only one of two bitmaps has is a token that the other set lacks.
    """

    def __init__(self) -> None:
        self.top = _Node(np.zeros(0, U64), 0, 0, 0)
        self.top.least, self.top.most = 1 << 60, 0
        self.parent: list[int] = []
        self.groups = 0

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def unite(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.groups -= 1

    def add(self, tokens: np.ndarray, like: int | None = None) -> int:
        """Insert a set, linked to every group with a similar one; ``like`` is in its group."""
        me = len(self.parent)
        self.parent.append(me)
        self.groups += 1
        if like is not None:
            self.unite(me, like)
        if self.groups > 1:
            self._search(tokens, me)
        self._insert(tokens, me)
        return me

    def _search(self, x: np.ndarray, me: int) -> None:
        n, bits = len(x), _bitmap(x)
        stack = [(node, 0, 0, 0) for node in self.top.below.values()]
        while stack and self.groups > 1:
            node, common, depth, at = stack.pop()
            if not node.mixed and self.root(node.one) == self.root(me):
                continue
            if not node.below:
                m = node.most
                most = min(n - (bits & ~node.bits).bit_count(), m - (node.bits & ~bits).bit_count())
                if not similar(most, n, m):
                    continue
            run = node.run
            to = int(np.searchsorted(x, run[-1], "right"))
            if to > at:
                mine = x[at:to]
                spot = np.searchsorted(mine, run)
                spot[spot == len(mine)] = 0
                common += int(np.count_nonzero(mine[spot] == run))
            depth, at = depth + len(run), max(at, to)
            best = min(max(depth + n - at, node.least), node.most)
            if not similar(common + min(n - at, best - depth), n, best):
                continue
            if node.ends and similar(common, n, depth):
                for other in node.ends:
                    self.unite(me, other)
            stack.extend((b, common, depth, at) for b in node.below.values())

    def _insert(self, x: np.ndarray, me: int) -> None:
        n, node, at = len(x), self.top, 0
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            node.mixed = node.mixed or self.root(node.one) != self.root(me)
            if at == n:
                node.ends.append(me)
                return
            child = node.below.get(int(x[at]))
            if child is None:
                child = node.below[int(x[at])] = _Node(x[at:], n, me, _bitmap(x))
                child.ends.append(me)
                return
            run = child.run
            k = min(len(run), n - at)
            differ = np.flatnonzero(run[:k] != x[at : at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(run):
                upper = _Node(run[:same], n, child.one, 0)
                upper.least, upper.most, upper.mixed = child.least, child.most, child.mixed
                child.run = run[same:]
                upper.below[int(run[same])] = child
                node.below[int(x[at])] = upper
                child = upper
            node, at = child, at + same


def _counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents have a shingle of each slot, as one fixed-size table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SLOT_BITS, np.int32)
        held: list[np.ndarray] = []

        def tally() -> None:
            found = np.bincount(np.concatenate(held), minlength=len(slots))
            np.add(slots, found, out=slots, casting="unsafe")
            held.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                for s in shingle_sets(text_bytes(part.column("text")), size):
                    held.append((s >> U64(64 - SLOT_BITS)).astype(np.int32))
                if sum(map(len, held)) > COLLECT:
                    tally()
        if held:
            tally()
        chunks = slots.reshape(-1, CHUNK)
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array(range(len(chunks)), pa.int32()),
            "counts": pa.array([pa.compress(c.tobytes(), "zstd", asbytes=True) for c in chunks], pa.binary()),
        })

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist()):
                counts = pa.decompress(packed, 4 * CHUNK, "zstd", asbytes=True)
                sums.setdefault(chunk, np.zeros(CHUNK, np.int64))
                sums[chunk] += np.frombuffer(counts, np.int32)
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array(list(sums), pa.int32()),
            "counts": pa.array([c.tobytes() for c in sums.values()], pa.binary()),
        })

    shape = "chunk int, counts binary"
    total = np.zeros((1 << SLOT_BITS) // CHUNK * CHUNK, np.int64).reshape(-1, CHUNK)
    summed = docs.select("text").mapInArrow(count, shape).repartition("chunk").mapInArrow(add, shape)
    for chunk, counts in summed.collect():
        total[chunk] += np.frombuffer(counts, np.int64)
    return total.ravel()


def _sketches(frequent, size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for part in slices(batch, "text"):
                sets = [
                    ordered(s, frequent.value)
                    for s in shingle_sets(text_bytes(part.column("text")), size)
                ]
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("id"),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "mark": pa.array(
                        [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                        pa.binary(),
                    ),
                    "tokens": pa.array([signature(s).view(np.int64) for s in sets], pa.list_(pa.int64())),
                })

    return scan


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: a third of what their sets take."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [t or b"" for t in text_bytes(part.column("text"))]
            yield pa.RecordBatch.from_pydict({
                "rep": part.column("rep"), "size": pa.array([len(t) for t in texts], pa.int64()),
                "packed": pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary()),
            })


def _link(frequent, shingle_words: int):
    """Rows in order of ``cell``: a prefix tree for each cell, its groups as links."""

    def unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in slices(batch, "packed", UNPACK):
            texts = [
                pa.decompress(t, n, "zstd", asbytes=True) if n else b""
                for t, n in zip(part["packed"].to_pylist(), part["size"].to_pylist())
            ]
            for s in shingle_sets(texts, shingle_words):
                yield ordered(s, frequent.value)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish() -> pa.RecordBatch:
            least: dict[int, object] = {}
            for i, name in enumerate(reps):
                r = tree.root(i)
                least[r] = min(least.get(r, name), name)
            pairs = [(name, least[tree.root(i)]) for i, name in enumerate(reps)]
            pairs = list({p for p in pairs if p[0] != p[1]})
            return pa.RecordBatch.from_pydict({
                "a": pa.array([p[0] for p in pairs], kind), "b": pa.array([p[1] for p in pairs], kind),
            })

        cell, tree, reps, labels, kind = None, None, [], {}, None
        for batch in batches:
            kind = batch.schema.field("rep").type
            names = (batch[c].to_pylist() for c in ("cell", "rep", "label"))
            for key, rep, label, tokens in zip(*names, unpacked(batch)):
                if key != cell:
                    if cell is not None:
                        yield finish()
                    cell, tree, reps, labels = key, PrefixTree(), [], {}
                at = tree.add(tokens, labels.setdefault(label, len(reps)))
                if labels.setdefault(rep, at) != at:
                    tree.unite(labels[rep], at)
                reps.append(rep)
        if cell is not None:
            yield finish()

    return scan


def _links(cells: DataFrame, texts: DataFrame, frequent, size: int) -> DataFrame:
    """Links inside cells (``cell``, ``rep``, ``label``), a spanning tree of each group."""
    kind = texts.schema["rep"].dataType
    return (
        cells.join(texts, "rep")
        .repartition("cell")
        .sortWithinPartitions("cell", "label", "rep")
        .mapInArrow(_link(frequent, size), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
    )


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5
) -> DataFrame:
    """Groups of texts connected by shingle-set similarities of at least 0.8.

    Words are runs of other than ASCII white space after lower-casing A-Z. Two passes
    over the texts count all shingles into a fixed-size table, which orders them, and
    take the size, a mark of the whole set and its signature. Equal sets collapse to
    their smallest id. Signature tokens that occur once are gone after one shuffle of
    tokens, and sets with too few others. Sets that the rest connects meet in a cell,
    where a prefix tree over the whole ordered sets decides every link. Cells hold
    ``BLOCK`` sets; more connected sets than that are compared token by token, block by
    block, so nothing is left out.

    Returns one row per input row: ``id``, ``n_shingles``, ``component`` (smallest id
    reachable by links, itself included).

    A null or empty text has no shingles and links to nothing. Rows with equal ids are
    one node; a row without id links to nothing and has no component. Other columns are
    not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = _counts(rows, shingle_words)
    bound = max(FREQUENT_LEAST, FREQUENT_FACTOR * counts.mean())
    frequent = spark.sparkContext.broadcast(counts > bound)
    key = rows.schema["id"]
    sketches = stored(rows.mapInArrow(_sketches(frequent, shingle_words), T.StructType([
        key, T.StructField("n", T.LongType()), T.StructField("mark", T.BinaryType()),
        T.StructField("tokens", T.ArrayType(T.LongType())),
    ])))
    named = sketches.where("n > 0 AND id IS NOT NULL")
    # One row of each set goes on; signatures move once, with the choice of that row.
    kept = stored(
        named.groupBy("mark").agg(F.min(F.struct("id", "n", "tokens")).alias("k"))
        .select("mark", F.col("k.id").alias("rep"), "k.n", "k.tokens")
    )
    classes = kept.select("mark", "rep")
    tokens = kept.select(
        "rep", F.expr(f"least({SHARED}, ceil(0.8 * n))").alias("need"), F.explode("tokens").alias("token")
    )
    links = _join(rows, stored(tokens), kept.select("rep", "n"), frequent, shingle_words)
    roots = components(links)
    known = named.join(classes, "mark").select("id", "n", "rep")
    linked = (
        known.join(roots, F.col("rep") == F.col("node"), "left")
        .select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))
    )
    alone = sketches.where("n = 0 OR id IS NULL").select(
        "id", F.col("n").alias("n_shingles"), F.col("id").alias("component")
    )
    return linked.unionByName(alone)


def _join(rows: DataFrame, tokens: DataFrame, counts: DataFrame, frequent, size: int) -> DataFrame:
    met = tokens
    for _ in range(REFINEMENTS):
        # A token that one set has, and then a set with too few tokens left, cannot link.
        shared = stored(met.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
        met = stored(
            maybe_in(met, shared, {"token": F.col("token")}, "_maybe")
            .where("_maybe")
            .select("rep", "need", "token")
            .join(shared, "token")
        )
        able = stored(
            met.groupBy("rep").agg(F.count(F.lit(1)).alias("c"), F.min("need").alias("need"))
            .where("c >= need")
            .select("rep")
        )
        met = stored(met.join(able, "rep", "left_semi"))
    # Similar sets share more tokens than both may leave out, so they still meet once.
    turn = F.row_number().over(W.partitionBy("rep").orderBy(F.desc("df"), "token"))
    met = stored(
        met.withColumn("turn", turn).where("turn > (need - 1) div 2").select("rep", "token")
    )
    # Tokens with the same sets need one cell.
    cell_tokens = stored(
        met.groupBy("token")
        .agg(
            F.count(F.lit(1)).alias("df"),
            F.min("rep").alias("first"),
            F.bit_xor(F.xxhash64("rep")).alias("members"),
        )
        .where("df > 1")
        .groupBy("df", "first", "members")
        .agg(F.min("token").alias("token"))
        .drop("members")
    )
    met = stored(met.join(cell_tokens, "token"))
    needed = stored(met.select("rep").distinct())
    # Some other texts may pass; the join with the cells leaves them behind.
    kind = rows.schema["id"].dataType
    texts = stored(
        maybe_in(rows, needed, {"rep": F.col("id")}, "_maybe").where("_maybe")
        .select(F.col("id").alias("rep"), "text")
        .mapInArrow(_packed, T.StructType([
            T.StructField("rep", kind), T.StructField("size", T.LongType()), T.StructField("packed", T.BinaryType()),
        ]))
    )

    # Sets that tokens connect, directly or not, are compared in one cell if it is small.
    reach = components(met.select(F.col("rep").alias("a"), F.col("first").alias("b")))
    sizes = reach.join(counts, F.col("node") == F.col("rep")).groupBy("component").agg(
        F.count(F.lit(1)).alias("c"), F.sum("n").alias("tokens")
    )
    wide = stored(sizes.where(f"c > {BLOCK} OR tokens > {BLOCK_TOKENS}").select("component"))
    cells = reach.join(wide, "component", "left_anti").select(
        F.concat(F.lit("c"), "component").alias("cell"),
        F.col("node").alias("rep"),
        F.col("node").alias("label"),
    )
    near = stored(_links(cells, texts, frequent, size))
    if wide.isEmpty():
        return near
    members = reach.join(wide, "component", "left_semi").select(F.col("node").alias("rep"))
    met = stored(met.join(members, "rep", "left_semi"))
    return near.unionByName(_join_wide(met, texts, frequent, size))


def _join_wide(met: DataFrame, texts: DataFrame, frequent, size: int) -> DataFrame:
    """Links among sets that too many connected ones surround, token by token.

    The first round sends a set to one cell, the one of its commonest token, together
    with that token's smallest set. The second compares the sets of the tokens that are
    not yet one group and did not all meet, in all pairs of blocks.
    """
    home = met.groupBy("rep").agg(F.max(F.struct("df", "token", "first")).alias("h")).select(
        "rep", "h.*"
    )
    blocks = F.ceil(F.col("df") / BLOCK)
    block = F.pmod(F.xxhash64("rep"), blocks)
    place = F.concat(F.lit("t"), "token", F.lit("."), block)
    placed = home.select("rep", "first", place.alias("cell"))
    pivots = placed.select(F.col("first").alias("rep"), "first", "cell").distinct()
    cells = placed.unionByName(pivots).distinct().select("cell", "rep", F.col("rep").alias("label"))
    near = stored(_links(cells, texts, frequent, size))
    label = near.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("label"))
    labelled = stored(
        met.join(home.select("rep", place.alias("home")), "rep")
        .join(label, "rep", "left")
        .withColumn("label", F.coalesce("label", "rep"))
    )
    mixed = stored(
        labelled.groupBy("token")
        .agg(*(f(c).alias(f"{n}_{c}") for c in ("label", "home") for n, f in (("lo", F.min), ("hi", F.max))))
        .where("lo_label <> hi_label AND lo_home <> hi_home")
        .select("token")
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    cells = (
        labelled.join(mixed, "token")
        .withColumns({"own": block, "other": other})
        .select(
            F.concat_ws(
                ".", "token", F.least("own", "other"), F.greatest("own", "other")
            ).alias("cell"),
            "rep",
            "label",
        )
    )
    return near.unionByName(_links(cells, texts, frequent, size))
