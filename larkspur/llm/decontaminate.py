"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of `window` consecutive words (a shorter item is one
window). A window's tokens are its word shingles of up to five words, ordered by their number of
occurrences in the corpus. A document contains a window only if it contains all its shingles, so the
necessary prefix for full containment is one token, the rarest. Documents are joined on those prefix
tokens; a candidate must fit by length and position (the token's offset in the window), and is then
verified word by word over the whole window.

Items are taken in blocks of `block_bytes` of text, whatever their number; an item of many words is cut into
pieces that overlap by a window less one word, so every window stands in one. A block is held as one array of
word ids with the places of its different windows, not as windows. Its words, its shingles (while they are counted)
and its prefix tokens are broadcast, each once, about ten times its text at most. `together` blocks are
counted in one reading of the documents and marked in another, with a table written after. More items mean more
readings, not larger broadcasts. Counts of shingles cover all documents.

Defined results: a null or empty text, on either side, has no words; repeated windows, items and rows
count once each where they stand; items with a null id mark words but are not listed; an empty
benchmark contaminates nothing; extra columns of documents are kept, except that a column with the name
of a new one is replaced; an empty
table gives an empty table.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, materialize, slices, table, without

SHINGLE = 5
MIX = np.uint64(0x9E3779B97F4A7C15)
#: words: digits, a-z and all beyond ASCII; A-Z is lowered; the rest separates
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def ids_of(vocabulary: dict[bytes, int], texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of texts one after another (-1: not in the vocabulary, and between texts), and where each text starts."""
    split = [words_of(t) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(s) + 1 for s in split]))).astype(np.int64)
    out = np.full(int(starts[-1]), -1, np.int32)
    get, none = vocabulary.get, itertools.repeat(-1)
    for at, s in zip(starts.tolist(), split, strict=False):
        out[at : at + len(s)] = np.fromiter(map(get, s, none), np.int32, len(s))
    return out, starts


@dataclass
class Block:
    """The different windows of a block of items, as places in one array of word ids (-1 between items and at the end)."""

    flat: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    names: list  # item ids
    first: np.ndarray  # of window i the owners first[i] to first[i + 1]
    owners: np.ndarray  # places among names
    width: int

    @classmethod
    def build(cls, rows: list[tuple], window: int) -> tuple[Block, dict[bytes, int]]:
        """Of (item id, text); the block and its vocabulary."""
        vocabulary: dict[bytes, int] = {}
        parts, sizes = [], []
        for _, text in rows:
            w = words_of(text)
            parts.append(np.fromiter((vocabulary.setdefault(x, len(vocabulary)) for x in w), np.int32, len(w)))
            sizes.append(len(w))
        gap = np.full(1, -1, np.int32)
        flat = np.concatenate([x for p in parts for x in (p, gap)] + [np.full(window, -1, np.int32)])
        n = np.array(sizes, np.int64)
        base = np.concatenate(([0], np.cumsum(n + 1)[:-1])).astype(np.int64) if len(n) else np.zeros(0, np.int64)
        many = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        owner = np.repeat(np.arange(len(n)), many)
        starts = np.repeat(base - np.concatenate(([0], np.cumsum(many)[:-1])) if len(n) else base, many) + np.arange(int(many.sum()))
        lengths = np.minimum(n, window)[owner]
        code = lengths.astype(np.uint64)
        for j in range(window):
            part = np.where(lengths > j, flat[starts + j], -1).astype(np.int64).astype(np.uint64)
            code = (code ^ (part + np.uint64(1))) * MIX
            code ^= code >> np.uint64(31)
        _, where, same = np.unique(code, return_index=True, return_inverse=True)
        for j in range(window):  # windows of one code are one window, if they are
            if not (np.where(lengths > j, flat[starts + j], -1) == np.where(lengths > j, flat[starts[where][same] + j], -1)).all():
                where, same = np.arange(len(starts)), np.arange(len(starts))
                break
        names = list(dict.fromkeys(x for x, _ in rows if x is not None))
        number = {x: i for i, x in enumerate(names)}
        named = np.array([number.get(x, -1) for x, _ in rows], np.int64)[owner] if rows else owner
        pair = np.unique((same * (len(names) + 1) + named)[named >= 0])
        holder = pair // (len(names) + 1)
        first = np.searchsorted(holder, np.arange(len(where) + 1)).astype(np.int32)
        return cls(flat, starts[where].astype(np.int32), lengths[where].astype(np.int16), names, first, (pair % (len(names) + 1)).astype(np.int32), window), vocabulary

    def tokens(self) -> dict[int, np.ndarray]:
        """Shingle length -> codes that occur in windows, sorted."""
        out = {}
        for k in sorted(set(np.minimum(self.lengths, SHINGLE).tolist())):
            codes, whole = shingles(self.flat, k)
            inside = np.zeros(len(codes) + 1, np.int32)  # places within a window of this kind
            own = np.minimum(self.lengths, SHINGLE) == k
            np.add.at(inside, self.starts[own], 1)
            np.add.at(inside, self.starts[own] + self.lengths[own] - k + 1, -1)
            out[k] = np.unique(codes[whole & (np.cumsum(inside)[:-1] > 0)])
        return out

    def owners_of(self, i: int) -> list:
        return [self.names[j] for j in self.owners[self.first[i] : self.first[i + 1]].tolist()]


def shingles(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A code for the k ids from each place on, and whether all k are words."""
    n = max(len(ids) - k + 1, 0)
    codes, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(k):
        part = ids[j : j + n]
        codes = (codes ^ (part.astype(np.uint64) + np.uint64(1))) * MIX
        codes ^= codes >> np.uint64(31)
        whole &= part >= 0
    return codes, whole


def _located(codes: np.ndarray, whole: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose code is known, and its number there."""
    at = np.flatnonzero(whole)
    if not len(known) or not len(at):
        return at[:0], at[:0]
    slot = np.minimum(np.searchsorted(known, codes[at]), len(known) - 1)
    hit = known[slot] == codes[at]
    return at[hit], slot[hit]


class Prefixes:
    """The rarest shingle of every window, sorted by code for joining."""

    def __init__(self, block: Block, tokens: dict[int, np.ndarray], counts: dict[int, np.ndarray]):
        self.block = block
        self.by_length = {}
        for k, known in tokens.items():
            rows = np.flatnonzero(np.minimum(block.lengths, SHINGLE) == k).astype(np.int32)
            codes, _ = shingles(block.flat, k)
            often = counts[k][np.minimum(np.searchsorted(known, codes), len(known) - 1)]
            start, length = block.starts[rows].astype(np.int64), block.lengths[rows]
            best, offset = often[start], np.zeros(len(rows), np.int16)
            for j in range(1, int(length.max()) - k + 1):
                here = np.where(length >= j + k, often[np.minimum(start + j, len(often) - 1)], np.iinfo(np.int64).max)
                less = here < best
                best, offset = np.where(less, here, best), np.where(less, j, offset).astype(np.int16)
            code = codes[start + offset]
            by = np.argsort(code, kind="stable")
            uniq, first = np.unique(code[by], return_index=True)
            self.by_length[k] = uniq, np.append(first, len(by)).astype(np.int32), rows[by], offset[by]

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Verified occurrences: where a window starts, and which."""
        starts, found = [], []
        for k, (uniq, first, rows, offset) in self.by_length.items():
            at, slot = _located(*shingles(ids, k), uniq)
            many = (first[slot + 1] - first[slot]) if len(slot) else slot
            for lo in _lots(many, 1 << 18):  # bounded arrays, however many windows share a token
                a, s, m = at[lo], slot[lo], many[lo]
                which = np.repeat(first[s] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
                start, row = np.repeat(a, m) - offset[which], rows[which]
                size = self.block.lengths[row].astype(np.int64)
                fits = (start >= 0) & (start + size <= len(ids))
                start, row, size = start[fits], row[fits], size[fits]
                same = np.ones(len(start), bool)
                for j in range(self.block.width):
                    live = np.flatnonzero(same & (size > j))
                    same[live] = ids[start[live] + j] == self.block.flat[self.block.starts[row[live]] + j]
                starts.append(start[same])
                found.append(row[same])
        none = np.zeros(0, np.int64)
        return np.concatenate(starts or [none]), np.concatenate(found or [none])


def _lots(sizes: np.ndarray, most: int):
    """Slices of consecutive entries of about `most` in sum, at least one entry each."""
    if not len(sizes):
        return
    part = np.cumsum(sizes) // most
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in itertools.pairwise([0, *edges.tolist(), len(sizes)]):
        yield slice(a, b)


def _counts(docs: DataFrame, blocks: list[tuple], text_col: str) -> list[dict[int, np.ndarray]]:
    """How often each of the blocks' shingles occurs in all documents. blocks: broadcast words and tokens."""

    def run(batches):
        sums = [{k: np.zeros(len(known), np.int64) for k, known in tokens.value.items()} for _, tokens in blocks]
        for batch in batches:
            for part in slices(batch, 256):
                texts = part.column(0).to_pylist()
                for (words, tokens), own in zip(blocks, sums, strict=True):
                    ids, _ = ids_of(words.value, texts)
                    for k, known in tokens.value.items():
                        own[k] += np.bincount(_located(*shingles(ids, k), known)[1], minlength=len(known))
        for b, own in enumerate(sums):
            for k, n in own.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"b": pa.array([b] * len(some), pa.int32()), "k": pa.array([k] * len(some), pa.int32()), "slot": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64())})

    out = [{k: np.zeros(len(known), np.int64) for k, known in tokens.value.items()} for _, tokens in blocks]
    counted = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "b int, k int, slot int, n long").groupBy("b", "k", "slot").agg(F.sum("n").alias("n"))
    for batch in counted.toArrow().to_batches():  # one row for each shingle of the blocks at most
        b, k, slot, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for i in set(b.tolist()):
            for j in set(k[b == i].tolist()):
                some = (b == i) & (k == j)
                out[i][j][slot[some]] = n[some]
    return out


PIECE_WORDS = 100_000


def _pieces(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Items as (id, words): of many words, in pieces that overlap by a window less one word."""

    def run(batches):
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                w = words_of(text)
                step = max(PIECE_WORDS, 2 * window) - window + 1
                for a in range(0, max(1, len(w) - window + 1) if w else 0, step):
                    at.append(i)
                    out.append(b" ".join(w[a : a + step + window - 1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.binary())], ["item", "words"])

    kind = dict(items.dtypes)[id_col]
    return items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).cast("binary")).mapInArrow(run, f"item {kind}, words binary")


def _blocks(pieces: DataFrame, window: int, block_bytes: int):
    """Blocks of pieces, each of bounded size in expectation."""
    total = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = -(-total // block_bytes)
    for i in range(n):
        part = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == i) if n > 1 else pieces
        yield Block.build([(r[0], bytes(r[1])) for r in part.collect()], window)


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", prefix: str = "", block_bytes: int = 8 << 20, together: int = 2) -> DataFrame:
    """All columns of docs and {prefix}n_words, {prefix}spans (disjoint word ranges hit, end exclusive), {prefix}items (ids, ascending)."""
    spark = docs.sparkSession
    names = [f"{prefix}{x}" for x in ("n_words", "spans", "items")]
    docs = without(docs, names)
    kind = dict(items.dtypes)[item_col]
    span = "array<struct<from:int,to:int>>"
    out = docs.withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.expr(f"cast(array() as {span})"), names[2]: F.expr(f"cast(array() as array<{kind}>)")})
    schema = T.StructType(list(out.schema.fields))
    pieces = materialize(_pieces(items, window, item_col, item_text_col), "items")
    empty, _ = Block.build([], window)
    made = iter(_blocks(pieces, window, block_bytes))
    first, send = True, spark.sparkContext.broadcast
    while group := list(itertools.islice(made, together)):
        if not first:
            out = materialize(out, "contamination")
        sent = [(send(words), send(block.tokens())) for block, words in group]  # block_bytes of item text
        group = [block for block, _ in group]
        for block, (words, tokens), counts in zip(group, sent, _counts(docs, sent, text_col), strict=True):
            out = map_batches(out, out.columns, _pass(words, send(Prefixes(block, tokens.value, counts)), text_col, names), schema)
            tokens.unpersist()
        first = False
    if first:
        out = map_batches(out, out.columns, _pass(send({}), send(Prefixes(empty, {}, {})), text_col, names), schema)
    return out


def _pass(words, shared, text_col: str, names: list[str]):
    def factory():
        prefixes: Prefixes = shared.value
        vocabulary, block = words.value, prefixes.block

        def run(batch):
            at = batch.schema.get_field_index(text_col)
            ids, bounds = ids_of(vocabulary, [None if x is None else x.encode() for x in batch.column(at).to_pylist()])
            start, row = prefixes.matches(ids)
            doc = np.searchsorted(bounds, start, side="right") - 1
            edge = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + block.lengths[row].astype(np.int64), -1)
            hit = np.diff(np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8), [0])))
            froms, tos = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
            owner = np.searchsorted(bounds, froms, side="right") - 1
            old_spans, old_items = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names[1:])
            spans = [[(s["from"], s["to"]) for s in x] for x in old_spans]
            for d, a, b in zip(owner.tolist(), froms.tolist(), tos.tolist(), strict=True):
                spans[d].append((a - int(bounds[d]), b - int(bounds[d])))
            listed = [set(x) for x in old_items]
            for d, r in {*zip(doc.tolist(), row.tolist(), strict=True)}:
                listed[d].update(block.owners_of(r))
            fields = {f.name: f.type for f in batch.schema}
            new = {
                names[0]: pa.array((np.diff(bounds) - 1).tolist(), pa.int64()),
                names[1]: pa.array([[{"from": a, "to": b} for a, b in _merged(s)] for s in spans], fields[names[1]]),
                names[2]: pa.array([sorted(x) for x in listed], fields[names[2]]),
            }
            return pa.RecordBatch.from_arrays([new.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)], schema=batch.schema)

        return run

    return factory


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def flagged(found: DataFrame, prefix: str = "") -> DataFrame:
    """With {prefix}n_hit and {prefix}contaminated: at least a twentieth of the words hit, and at least one."""
    n_hit = F.aggregate(f"{prefix}spans", F.lit(0).cast("long"), lambda a, s: a + (s["to"] - s["from"]))
    out = found.withColumn(f"{prefix}n_hit", n_hit)
    return out.withColumn(f"{prefix}contaminated", (F.col(f"{prefix}n_hit") > 0) & (20 * F.col(f"{prefix}n_hit") >= F.col(f"{prefix}n_words")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = flagged(contamination(docs, table(spark, sf_dir, "benchmark")))
    listed = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), "contaminated")
