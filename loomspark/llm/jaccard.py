"""N-gram Jaccard join with signature trees.

Two texts link when their shingle sets have a Jaccard similarity of 0.8 or more. No link
between different texts is lost:

1. Equal sets become one class, known by 128 bits and from then on by a number. What
   follows works on classes.
2. Sets that link share a shingle among the first n - ceil(0.8 n) + 1 of each, in any order
   common to all. The order here is rarest first: a sketch of fixed size counts all shingles
   of all documents, so passages and lines that many documents share come last. Classes that
   share such a shingle form a block; blocks of the same members are one.
3. In a block the sets' bitmaps are the leaves of a signature tree. An inner node holds the
   OR of its bitmaps, the range of their set sizes and the largest surplus of shingles over
   bits. A traversal of the tree against itself drops a pair of nodes when the bits they have
   in common, plus the surplus, are fewer than the overlap that their smallest sets would
   need, or when no two of their sizes fit.
4. Pairs that reach the leaves join sets to candidate groups. There each set gets its
   shingles once, and a finer tree; the pairs that it leaves are compared exactly, unless
   links already join them.
5. A block or group of very many shingles or sets is split into chunks, and each pair of chunks is
   one task's group; so none grows beyond two chunks.
6. Links are merged to components by alternating stars, each round a written table.

Hashes of 52 bits stand for shingles and of 128 bits for sets.

Defined results: null and empty texts and texts of blanks have the empty set and link with
nothing; their component is their own doc_id. Rows that repeat a doc_id are documents of
their own that share a name. A null doc_id links like any other and never names a component;
where a component has no other id, its component_id is null. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm import shingles
from loomspark.llm.shared import discard, materialise
from loomspark.llm.textops import mix64

SKETCH_BITS = 20
#: Bits of the filters that spare rows a shuffle; a full one spares none.
FILTER_BITS = 23
_SLICE = 1 << 14
#: Shingles that one chunk of a block should hold.
CHUNK_SHINGLES = 1_000_000
#: Sets that it should hold at most, however small they are.
CHUNK_SETS = 16_384
LEAF, FAN = 16, 8


def _count_table(rows: DataFrame, count, bits: int) -> np.ndarray:
    """Counts over all rows in a table of 2**bits places, summed slice by slice; its size does not depend on the rows."""
    slices = (1 << bits) // _SLICE

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            count(batch, table)
        for k in range(slices):
            part = table[k * _SLICE : (k + 1) * _SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["slice", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(packed), dtype=np.uint32).astype(np.uint64)
                sums[k] = sums[k] + part if k in sums else part
        for k, part in sums.items():
            level = np.floor(np.log2(np.maximum(part, 1))).astype(np.uint8) + (part > 0)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    out = np.zeros(1 << bits, dtype=np.uint8)
    for row in rows.mapInArrow(each, schema).repartition(min(slices, 16), "slice").mapInArrow(total, schema).toLocalIterator():
        out[row["slice"] * _SLICE : (row["slice"] + 1) * _SLICE] = np.frombuffer(zlib.decompress(bytes(row["counts"])), dtype=np.uint8)
    return out


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """For each place of the sketch, the rounded logarithm of how many of all documents' shingles fall there."""

    def count(batch: pa.RecordBatch, table: np.ndarray) -> None:
        for sets in shingles.shingle_sets(batch.column(0)):
            np.add(table, np.bincount((sets.hashes & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32), out=table)

    return _count_table(docs.select(F.col(text)), count, SKETCH_BITS)


def _seen(values: DataFrame) -> np.ndarray:
    """A one-hash filter of a column of 64-bit numbers."""

    def count(batch: pa.RecordBatch, table: np.ndarray) -> None:
        table[_place(batch.column(0).to_numpy(zero_copy_only=False))] = 1

    return np.packbits(_count_table(values, count, FILTER_BITS) > 0)


def _place(values: np.ndarray) -> np.ndarray:
    return (mix64(values.astype(np.int64).view(np.uint64)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _has(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = _place(values)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


#: The two halves of what identifies a set.
IDENTITY = ["set_a", "set_b"]


def _identities(sets: shingles.Sets) -> list[np.ndarray]:
    return [mix64(x.view(np.uint64)).view(np.int64) for x in shingles.identities(sets)]


def features(docs: DataFrame, levels: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, the set's identity, the prefix tokens, rarest first, and the signature of each document."""
    shipped = docs.sparkSession.sparkContext.broadcast(levels)
    id_type = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in shingles.shingle_sets(batch.column(1)):
                level = shipped.value[(sets.hashes & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.uint64)
                token = level << np.uint64(46) | mix64(sets.hashes) >> np.uint64(18)
                order = np.sort(sets.rows.astype(np.uint64) << np.uint64(shingles.HASH_BITS) | token)
                length = shingles.prefix_length(sets.size)
                keep = np.arange(len(order)) - np.repeat(sets.start, sets.size) < np.repeat(length, sets.size)
                tokens = (order[keep] & shingles.HASH_MASK).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(tokens))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(sets.first, len(sets.size)), pa.array(sets.size), *map(pa.array, _identities(sets)), lists, pa.array(shingles.signatures(sets), pa.binary())],
                    names=["doc_id", "n_shingles", *IDENTITY, "tokens", "signature"],
                )

    types = {"n_shingles": "long", "set_a": "long", "set_b": "long", "tokens": "array<long>", "signature": "binary"}
    shape = docs.select(F.col(doc_id).cast(id_type).alias("doc_id"), *[F.lit(None).cast(t).alias(n) for n, t in types.items()])
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, shape.schema)


def blocks(classes: DataFrame) -> DataFrame:
    """token, chunks: one row for each block of two or more classes; of blocks of the same members, one."""
    tokens = classes.select("set_id", "n_shingles", F.explode("tokens").alias("token"))
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("set_id")).alias("mark"), F.sum("n_shingles").alias("shingles")).where(F.col("members") >= 2)
    once = counted.groupBy("members", "mark", "shingles").agg(F.min("token").alias("token"))
    return once.select("token", _chunks(F.col("shingles"), F.col("members")).alias("chunks"))


def _chunks(n_shingles: Column, n_sets: Column) -> Column:
    return F.greatest(F.ceil(n_shingles / CHUNK_SHINGLES), F.ceil(n_sets / CHUNK_SETS))


def members(classes: DataFrame, found: DataFrame) -> DataFrame:
    """token, left, right, set_id: the classes of each block, dealt to its pairs of chunks."""
    seen = classes.sparkSession.sparkContext.broadcast(_seen(found.select("token")))

    def spare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            keep = _has(seen.value, flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[keep])), pa.array(flat[keep])], names=["set_id", "token"])

    rows = classes.select("set_id", "tokens").mapInArrow(spare, "set_id long, token long").join(found, "token")
    return _deal(rows)


def sets_of(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """set_id and sorted shingles (uint64 bytes) of the wanted sets (set_id and identity), once each."""
    seen = docs.sparkSession.sparkContext.broadcast(_seen(wanted.select("set_a")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in shingles.shingle_sets(batch.column(0)):
                a, b = _identities(sets)
                _, first = np.unique(np.stack([a, b]), axis=1, return_index=True)
                rows = first[_has(seen.value, a[first]) & (sets.size[first] > 0)]
                start = sets.start
                data = [sets.hashes[start[r] : start[r] + sets.size[r]].tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(a[rows]), pa.array(b[rows]), pa.array(data, pa.binary())], names=[*IDENTITY, "shingles"])

    made = docs.select(F.col(text)).mapInArrow(run, "set_a long, set_b long, shingles binary")
    return made.join(wanted, IDENTITY).groupBy("set_id").agg(F.first("shingles").alias("shingles"))


class SignatureTree:
    """Bitmaps of a block's sets in a tree: leaves of LEAF sets, nodes of FAN children."""

    def __init__(self, size: np.ndarray, bitmap: np.ndarray):
        surplus = size - np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)
        # like sizes and like sets beside each other keep the nodes' ranges short and bitmaps sparse
        self.order = np.lexsort((bitmap[:, 0], (np.log(np.maximum(size, 1)) * 8).astype(np.int64)))
        level = (bitmap[self.order], size[self.order], size[self.order], surplus[self.order])
        self.levels = [level]
        width = LEAF
        while len(level[0]) > 1:
            cut = np.arange(0, len(level[0]), width)
            level = (np.bitwise_or.reduceat(level[0], cut), np.minimum.reduceat(level[1], cut), np.maximum.reduceat(level[2], cut), np.maximum.reduceat(level[3], cut))
            self.levels.append(level)
            width = FAN

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of sets that the bounds leave, by place in the given list."""
        left = right = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 2, -1, -1):
            width, n = (LEAF if depth == 0 else FAN), len(self.levels[depth][0])
            span = np.arange(width)
            keep_left, keep_right = [], []
            for a in range(0, len(left), 512):
                x = (left[a : a + 512, None, None] * width + span[:, None] + 0 * span).ravel()
                y = (right[a : a + 512, None, None] * width + 0 * span[:, None] + span).ravel()
                ok = (x < n) & (y < n) & ((x < y) if depth == 0 else (x <= y))
                x, y = x[ok], y[ok]
                ok = self._may_link(depth, x, y)
                keep_left.append(x[ok])
                keep_right.append(y[ok])
            left, right = np.concatenate(keep_left), np.concatenate(keep_right)
        if len(self.levels) == 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self.order[left], self.order[right]

    def _may_link(self, depth: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bitmap, least, most, surplus = self.levels[depth]
        # sizes of at least 4 : 5 somewhere in the ranges
        out = (5 * most[x] >= 4 * least[y]) & (5 * most[y] >= 4 * least[x])
        at = np.flatnonzero(out)
        common = np.empty(len(at), dtype=np.int64)
        for a in range(0, len(at), 8192):
            k = at[a : a + 8192]
            common[a : a + 8192] = np.bitwise_count(bitmap[x[k]] & bitmap[y[k]]).sum(axis=1, dtype=np.int64)
        x, y = x[at], y[at]
        out[at] = 9 * (common + np.minimum(surplus[x], surplus[y])) >= 4 * (least[x] + least[y])
        return out


def candidate_pairs(size: np.ndarray, maps: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that the bounds leave. Sets that can link have signatures of one width or of two neighbouring ones,
    so each width has a tree of its own sets and, folded, of those of the next."""
    width = np.array([len(m) // 8 for m in maps])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w in np.unique(width):
        own, wider = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        rows = np.concatenate([own, wider])
        if len(rows) < 2:
            continue
        bitmap = np.frombuffer(b"".join(maps[i] for i in own), dtype=np.uint64).reshape(len(own), -1)
        if len(wider):
            bitmap = np.concatenate([bitmap, shingles.fold(np.frombuffer(b"".join(maps[i] for i in wider), dtype=np.uint64).reshape(len(wider), -1))])
        a, b = SignatureTree(size[rows], bitmap).pairs()
        keep = (a < len(own)) | (b < len(own))  # two wider ones meet in their own tree
        left.append(rows[a[keep]])
        right.append(rows[b[keep]])
    return np.concatenate(left), np.concatenate(right)


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of pairs of sets."""
    size = np.array([len(sets[i]) + len(sets[j]) for i, j in zip(left, right)])
    rows = np.repeat(np.arange(len(left), dtype=np.uint64), size)
    both = np.concatenate([s for i, j in zip(left, right) for s in (sets[i], sets[j])])
    keys = np.sort(rows << np.uint64(shingles.HASH_BITS) | both)
    twice = keys[1:][keys[1:] == keys[:-1]] >> np.uint64(shingles.HASH_BITS)
    return np.bincount(twice.astype(np.int64), minlength=len(left))


class Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.parent))])


def block_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all sets of a block which links join: a spanning forest of its graph."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    maps = shingles.bitmaps(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), 4 * shingles.signature_bits(size))
    left, right = candidate_pairs(size, maps)
    union, out = Union(len(sets)), []
    batch = 64
    while len(left):
        roots = union.roots()
        apart = roots[left] != roots[right]
        left, right = left[apart], right[apart]
        a, b = left[:batch], right[:batch]
        left, right = left[batch:], right[batch:]
        for start in range(0, len(a), 1024):
            i, j = a[start : start + 1024], b[start : start + 1024]
            shared = overlaps(sets, i, j)
            total = np.array([len(sets[p]) + len(sets[q]) for p, q in zip(i, j)])
            for p, q in zip(i[9 * shared >= 4 * total].tolist(), j[9 * shared >= 4 * total].tolist()):
                x, y = union.root(p), union.root(q)
                if x != y:
                    union.parent[y] = x
                    out.append((p, q))
        batch = min(4096, batch * 2)
    return out


GROUP = ["token", "left", "right"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[tuple]]]:
    """Consecutive rows of one group: its key and the rest of each row, a repeated set once."""
    key, rows = None, []
    for batch in batches:
        for *here, set_id, size, data in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
            if here != key:
                if len(rows) > 1:
                    yield key, rows
                key, rows = here, []
            if not rows or rows[-1][0] != set_id:
                rows.append((set_id, size, data))
    if len(rows) > 1:
        yield key, rows


def _grouped(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, *GROUP).sortWithinPartitions(*GROUP, "set_id")


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs enough to join all that the given pairs join."""
    union, out = Union(n), []
    for p, q in zip(left.tolist(), right.tolist()):
        x, y = union.root(p), union.root(q)
        if x != y:
            union.parent[y] = x
            out.append((p, q))
    return out


def _pair_batch(rows: list[tuple], pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i, _ in pairs], pa.int64()), pa.array([rows[j][0] for _, j in pairs], pa.int64())], names=["a", "b"])


def candidates(dealt: DataFrame, classes: DataFrame, parts: int) -> DataFrame:
    """set_id pairs (a, b) that join all sets of a block whose signatures allow links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            left, right = candidate_pairs(np.array([r[1] for r in rows], dtype=np.int64), [r[2] for r in rows])
            if len(left):
                yield _pair_batch(rows, _forest(len(rows), left, right))

    rows = dealt.join(classes.select("set_id", "n_shingles", "signature"), "set_id").select(*GROUP, "set_id", "n_shingles", "signature")
    return _grouped(rows, parts).mapInArrow(run, "a long, b long").distinct()


def candidate_groups(roots: DataFrame, classes: DataFrame) -> DataFrame:
    """token (the group's root), left, right, set_id, n_shingles: every set of a candidate group, dealt to its pairs of chunks."""
    named = roots.select(F.col("root").alias("token"), F.col("node").alias("set_id")).union(roots.select("root", "root").distinct())
    sized = named.join(classes.select("set_id", "n_shingles"), "set_id")
    chunks = sized.groupBy("token").agg(_chunks(F.sum("n_shingles"), F.count(F.lit(1))).alias("chunks"))
    return _deal(sized.join(chunks, "token"), "n_shingles")


def _deal(rows: DataFrame, *more: str) -> DataFrame:
    """Each row to all pairs of chunks of its group that hold its own chunk."""
    own = F.pmod(F.xxhash64("set_id"), F.col("chunks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda k: F.struct(F.least(own, k).alias("left"), F.greatest(own, k).alias("right")))
    return rows.select("token", "set_id", *more, F.explode(pairs).alias("p")).select("token", "p.left", "p.right", "set_id", *more)


def links(groups: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """set_id pairs (a, b) of spanning links of all groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            pairs = block_links([np.frombuffer(r[2], dtype=np.uint64) for r in rows])
            if pairs:
                yield _pair_batch(rows, pairs)

    rows = groups.join(sets, "set_id").select(*GROUP, "set_id", "n_shingles", "shingles")
    return _grouped(rows, parts).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """node, root: the smallest node that links reach. Alternating large and small stars; each round is a written table.

    spent: materialised tables that only the edges read; they go once the edges are written, as each round does after the next.
    """
    ordered = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    current, before = materialise(ordered(edges), "links"), None
    discard(*spent)
    while True:
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
            roots.materialised_at = current.materialised_at
            return roots
        before = state
        both = current.union(current.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        large = ordered(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        last, current = current, materialise(ordered(small), "links")
        discard(last)


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    return _described_groups(docs, doc_id, text).select("doc_id", "n_shingles", "component_id")


def _described_groups(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """duplicate_groups with each row's set_a and set_b, and kept_a and kept_b: the set of the row that stands for its component.

    Tables written on the way are deleted as soon as the next one no longer needs them.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    whole = materialise(features(docs, rarity(docs, text), doc_id, text), "shingle-features")
    described = materialise(whole.select("doc_id", "n_shingles", *IDENTITY), "shingle-rows")
    first = {c: F.first(c).alias(c) for c in ("n_shingles", "tokens", "signature")}
    classes = whole.where("n_shingles > 0").groupBy(*IDENTITY).agg(*first.values(), F.min("doc_id").alias("least_id"))
    classes = materialise(classes.withColumn("set_id", F.monotonically_increasing_id()), "shingle-classes")  # written once, so the numbers stay
    discard(whole)
    found = materialise(blocks(classes), "shingle-blocks")
    dealt = materialise(members(classes, found), "shingle-members")
    discard(found)
    maybe = components(candidates(dealt, classes, parts), (dealt,))
    groups = materialise(candidate_groups(maybe, classes), "shingle-groups")
    discard(maybe)
    wanted = classes.select("set_id", *IDENTITY).join(groups.select("set_id").distinct(), "set_id", "left_semi")
    sets = materialise(sets_of(docs, wanted, text), "shingle-sets")
    roots = components(links(groups, sets, parts), (groups, sets))
    labelled = classes.select("set_id", "least_id", *IDENTITY).join(roots, F.col("set_id") == F.col("node"), "left").select(*IDENTITY, "least_id", F.coalesce("root", "set_id").alias("root"))
    least = F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", *IDENTITY))
    names = labelled.groupBy("root").agg(least.alias("least")).select("root", F.col("least.least_id").alias("component_id"), F.col("least.set_a").alias("kept_a"), F.col("least.set_b").alias("kept_b"))
    named = materialise(labelled.join(names, "root").select(*IDENTITY, "component_id", "kept_a", "kept_b"), "shingle-names")
    discard(classes, roots)
    out = described.join(named.withColumn("_some", F.lit(True)), [*IDENTITY], "left")
    own = (F.col("n_shingles") > 0) & F.col("_some")
    return out.select("doc_id", "n_shingles", *IDENTITY, "kept_a", "kept_b", F.when(own, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group: of the rows of the component's own id, one of the least set.

    Rows without an id or without shingles stay. Rows are judged one by one: an id with different texts
    loses only those that belong to a group of which another row stays. Of equal sets under one id the
    least text stays. Ids may be of any type. Only rows that a filter of fixed size suspects are shuffled.
    """
    stem = "_"
    while any(c.lower().startswith(stem) for c in docs.columns):
        stem += "_"
    own_a, own_b, key, set_a, set_b, count, gone, first = (stem + n for n in ("own_a", "own_b", "key", "set_a", "set_b", "rows", "gone", "first"))
    groups = _described_groups(docs, doc_id, text).where("n_shingles > 0 AND doc_id IS NOT NULL")
    away = (F.col("doc_id") != F.col("component_id")) | (F.col("set_a") != F.col("kept_a")) | (F.col("set_b") != F.col("kept_b"))
    marks = groups.groupBy("doc_id", *IDENTITY).agg(F.count(F.lit(1)).alias(count), F.max(away).alias(gone))
    marks = materialise(marks.where(F.col(gone) | (F.col(count) > 1)).toDF(key, set_a, set_b, count, gone), "duplicate-marks")
    seen = docs.sparkSession.sparkContext.broadcast(_seen(marks.select(F.xxhash64(key))))

    def part(suspect: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mark = _has(seen.value, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
                kept = batch.filter(pa.array(mark == suspect)).select(range(batch.num_columns - 1))
                if not suspect:
                    yield kept
                elif len(kept):
                    for sets in shingles.shingle_sets(kept.column(kept.schema.get_field_index(text))):
                        rows = kept.slice(sets.first, len(sets.size))
                        yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, _identities(sets))], names=[*rows.schema.names, own_a, own_b])

        return run

    told = docs.select("*", F.lit(None).cast("long").alias(own_a), F.lit(None).cast("long").alias(own_b)).schema
    hashed = docs.withColumn(key, F.xxhash64(doc_id))
    clear = hashed.mapInArrow(part(False), docs.schema)
    same = (F.col(doc_id) == F.col(key)) & (F.col(own_a) == F.col(set_a)) & (F.col(own_b) == F.col(set_b))
    suspects = hashed.mapInArrow(part(True), told).join(marks, same, "left").where(F.col(gone).isNull() | ~F.col(gone))
    single = suspects.where(F.coalesce(F.col(count), F.lit(1)) == 1).select(*docs.columns)
    least = F.row_number().over(Window.partitionBy(doc_id, own_a, own_b).orderBy(text))
    repeated = suspects.where(F.col(count) > 1).withColumn(first, least).where(F.col(first) == 1).select(*docs.columns)
    return clear.union(single).union(repeated)
