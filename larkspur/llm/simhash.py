"""Near-duplicates by SimHash fingerprints and BK-trees.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Fingerprints
link when at most `radius` of their 64 bits differ; the classes are the connected components.

Finding the links: the 64 bits are cut into `blocks` pieces. Two fingerprints within the radius
agree on at least blocks - radius whole pieces, so every choice of that many pieces is a table, and
fingerprints with equal bits there share a shard. Each shard's members go into a BK-tree (children
keyed by their integer Hamming distance to the parent); a search follows only edges whose key lies
within the radius of the distance to the node. No link is lost and no pair outside a shard is looked
at. The number of pieces follows the number of fingerprints so that shards of unlike texts stay
small; such a shard's tree lives in one task.

A shard of more than `chunk` members is dealt to chunks by hash before it is gathered, and each chunk
becomes a tree of its own. These shard trees are written to a table and broadcast, at most `round_bytes` of
them at a time; the shard's members stay where they are and search the trees of the chunks after their
own. A tree whose classes are all joined to the member's already is not searched again, so one dense
group costs about a search for each pair of its chunks and not for each pair of members. A shard gives
the links of a spanning forest, not all pairs. Distinct fingerprints stand for all their copies throughout.

Components come from alternating large-star and small-star rounds over written tables; the hub of a large
class is joined through a broadcast of bounded size.

Defined results: a text without words (null, empty, white space) has fingerprint zero and links like
any other; a null doc_id belongs to its fingerprint's class and never names one (a class of null ids
only has a null name); rows with equal ids and different texts keep their fingerprints; extra columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, join_sized, map_batches, materialize, table

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Unsigned 64-bit majority fingerprint of the words (runs of other than space and tab to CR), A-Z lowered."""
    words = (text or b"").translate(LOWER).split()  # bytes.split() takes exactly space and \\t to \\r
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words)))
    n = len(words) - shingle + 1
    # word i ends at ends[i] + i in the joined line and starts after the word before and a space
    starts = [0, *(e + i for i, e in enumerate(ends[: n - 1], 1))]
    stops = [e + i for i, e in enumerate(ends[shingle - 1 :], shingle - 1)]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)])
    counts = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 8192):
        counts += np.unpackbits(rows[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def row_key(id_col: str, text_col: str) -> Column:
    """Equal for rows with equal id and text."""
    return F.xxhash64(id_col, text_col)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, key (a hash of id and text), fp (the fingerprint's bits as a signed long)."""

    def factory():
        def run(batch):
            fps = [_signed(fingerprint(x, shingle)) for x in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "key", "fp"])

        return run

    cols = [docs[id_col].cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), docs[text_col].cast("binary").alias("text")]
    return map_batches(docs, cols, factory, "doc_id long, key long, fp long")


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at = len(self.values) - 1
        if not at:
            return
        node = 0
        while True:
            d = (self.values[node] ^ value).bit_count()
            child = self.children[node].get(d)
            if child is None:
                self.children[node][d] = at
                return
            node = child

    def near(self, value: int, radius: int) -> list[int]:
        """Places of all values within the radius."""
        if not self.values:
            return []
        out, todo = [], [0]
        values, children = self.values, self.children
        while todo:
            node = todo.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                out.append(node)
            below = children[node]
            if below:
                if len(below) <= 2 * radius + 1:
                    todo += [c for key, c in below.items() if -radius <= key - d <= radius]
                else:
                    todo += [below[key] for key in range(d - radius, d + radius + 1) if key in below]
        return out


    def to_bytes(self, roots: list[int]) -> bytes:
        """Values, parents, edge keys, and a class root for each value."""
        parent, key = np.zeros(len(self.values), "<u4"), np.zeros(len(self.values), np.uint8)
        for i, below in enumerate(self.children):
            for d, child in below.items():
                parent[child], key[child] = i, d
        return b"".join((np.array(self.values, "<u8").tobytes(), np.array(roots, "<u8").tobytes(), parent.tobytes(), key.tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[BKTree, list[int]]:
        n = len(data) // 21
        out = cls()
        out.values = np.frombuffer(data, "<u8", n).tolist()
        out.children = [{} for _ in range(n)]
        parents, keys = np.frombuffer(data, "<u4", n, 16 * n).tolist(), np.frombuffer(data, np.uint8, n, 20 * n).tolist()
        for i in range(1, n):
            out.children[parents[i]][keys[i]] = i
        return out, np.frombuffer(data, "<u8", n, 8 * n).tolist()


class Sets:
    """Union-find over any values; a set is named by its least member that was joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def forest(members: list[int], radius: int) -> tuple[BKTree, list[int]]:
    """The tree of a chunk, and each member's class root within it."""
    tree, sets = BKTree(), Sets()
    for x in members:
        for j in tree.near(x, radius):
            sets.join(x, members[j])
        tree.add(x)
    return tree, [sets.find(x) for x in members]


class Searcher:
    """Members of dense shards against the broadcast trees of later chunks; keeps what it has joined."""

    def __init__(self, trees: dict[int, list[tuple[int, bytes]]], radius: int):
        self.images, self.radius = trees, radius
        self.opened: dict[int, list] = {}
        self.sets = Sets()

    def links(self, shard: int, chunk: int, value: int, root: int) -> list[tuple[int, int]]:
        """New links between class roots, of the member's and of what it finds."""
        if shard not in self.opened:
            made = []
            for c, image in self.images.get(shard, ()):
                tree, roots = BKTree.from_bytes(image)
                made.append((c, tree, roots, set(roots)))
            self.opened = {shard: made}  # rows of a shard stand together
        out = []
        for c, tree, roots, kinds in self.opened[shard]:
            if c <= chunk:
                continue
            mine = self.sets.find(root)
            if len(kinds) <= 16 and all(self.sets.find(k) == mine for k in kinds):
                continue
            for j in tree.near(value, self.radius):
                if self.sets.join(root, roots[j]):
                    out.append((root, roots[j]))
        return out


@functools.lru_cache
def masks(blocks: int, radius: int = 4) -> tuple[int, ...]:
    """The tables' bit masks: every choice of blocks - radius of the pieces."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    pieces = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return tuple(sum(c) for c in itertools.combinations(pieces, blocks - radius))


def blocks_for(n: int, radius: int = 4, most: int = 64) -> int:
    """The fewest pieces with which a shard of n unlike fingerprints has at most `most` members."""
    for blocks in range(radius + 1, radius + 7):
        if n >> (64 * (blocks - radius) // blocks) < most:
            return blocks
    return radius + 6


def links(fps: DataFrame, n: int, radius: int = 4, chunk: int = 1024, round_bytes: int = 32 << 20) -> DataFrame:
    """From a table of n distinct fingerprints (fp): the links of spanning forests, columns a and b."""
    wanted = masks(blocks_for(n, radius), radius)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in wanted])
    spread = fps.select("fp", F.posexplode(keys).alias("band", "key")).select("fp", F.xxhash64("band", "key").alias("shard"))
    sizes = spread.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    sizes = materialize(sizes, "sizes")
    # Shards of one member hold no link and are left out.
    dealt = join_sized(spread, sizes, "shard", n * len(wanted)).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = dealt.select("shard", "chunk", "chunks", "fp").repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "fp")

    def build(batches):
        """A small shard's links; a dense shard's members with their roots, and the trees of its chunks."""
        group, members = None, []
        out: list[tuple] = []

        def close():
            if group is None:
                return
            shard, c, chunks = group
            tree, roots = forest(members, radius)
            out.extend((shard, c, _signed(x), _signed(r), None) for x, r in zip(members, roots, strict=True) if chunks > 1 or x != r)
            if chunks > 1:
                out.append((shard, c, None, None, tree.to_bytes(roots)))

        def flush():
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["shard", "chunk", "fp", "root", "tree"])

        for batch in batches:
            for shard, c, chunks, fp in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (shard, c, chunks) != group:
                    close()
                    group, members = (shard, c, chunks), []
                    if len(out) > 50_000:
                        yield flush()
                        out.clear()
                members.append(fp & 0xFFFFFFFFFFFFFFFF)
        close()
        if out:
            yield flush()

    made = materialize(dealt.mapInArrow(build, "shard long, chunk int, fp long, root long, tree binary"), "shards")
    forget(sizes)
    edges = [made.where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b"))]
    trees = made.where("tree is not null").select("shard", "chunk", "tree")
    size = trees.agg(F.sum(F.octet_length("tree"))).first()[0] or 0
    rounds = -(-size // round_bytes)
    for i in range(rounds):
        own = trees.where(F.pmod(F.xxhash64("shard", "chunk"), F.lit(rounds)) == i)
        held: dict[int, list[tuple[int, bytes]]] = {}
        for row in own.collect():  # round_bytes of trees
            held.setdefault(row.shard, []).append((row.chunk, bytes(row.tree)))
        shared = fps.sparkSession.sparkContext.broadcast(held)
        asked = made.where("tree is null").join(F.broadcast(own.select("shard").distinct()), "shard", "left_semi")
        edges.append(materialize(asked.select("shard", "chunk", "fp", "root").mapInArrow(_search(shared, radius), "a long, b long"), "found"))
        shared.destroy()  # else the driver keeps the trees of all rounds
    return functools.reduce(DataFrame.union, edges).distinct()


def _search(shared, radius: int):
    def run(batches):
        searcher = Searcher(shared.value, radius)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for shard, c, fp, root in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                out += searcher.links(shard, c, fp & 0xFFFFFFFFFFFFFFFF, root & 0xFFFFFFFFFFFFFFFF)
            yield pa.RecordBatch.from_arrays([pa.array([_signed(x[i]) for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """From links (a, b): node, root (the smallest node of its class) for every node in a link.

    Alternates large-star (each node's larger neighbours to its smallest) and small-star (its smaller
    ones). Every round is written to the shared folder; they are few, as a class's paths halve. So are both
    halves and the smallest neighbours: `join_sized` reads its sides more than once, so one plan of a whole round would read
    dozens of tables, and the driver plans it anew after each of its stages.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen, n = None, now.count()
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u")), "low")
        large = join_sized(both, low, "u", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = join_sized(large, least, "u", n).select(F.explode(ends).alias("e")).select("e.*")
        before, now = now, materialize(small.where("u <> v").distinct(), "links")
        forget(before, low, large, least)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, n = state, state[0]
    raise RuntimeError("the classes did not settle")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, chunk: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, key, fp, class (a fingerprint that names the component), component_id (the smallest doc_id reachable by links, itself included)."""
    own = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    found = components(links(distinct.select("fp"), distinct.count(), radius, chunk))
    found = materialize(found.union(found.select(F.col("root").alias("node"), "root").distinct()), "classes")
    named = found.join(distinct.select(F.col("fp").alias("node"), "first"), "node")
    best = materialize(named.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("n")), "best")
    named = join_sized(found, best, "root", found.count()).select(F.col("node").alias("fp"), "root", "best")
    names = distinct.join(named, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("class"), F.coalesce("best", "first").alias("component_id"))
    names = materialize(names, "names")
    return join_sized(own, names, "fp", own.count()).select("doc_id", "key", "fp", "class", "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, radius: int = 4, chunk: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near-duplicates, with all its columns: that of the smallest id (nulls last), of equal ids any text, of equal rows one."""
    found = near_duplicates(docs, shingle, radius, chunk, id_col, text_col)
    first = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")).select(F.col("first.key").alias("__key"))
    rows = docs.withColumn("__key", row_key(id_col, text_col))
    return rows.join(first, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
