"""Token counts by heap-and-linked-list byte-pair merging.

A count is the number of initial symbols minus the number of merges: no identifier is looked up or
emitted. The lowest-rank (highest-score) adjacent pair is popped from a heap again and again, the
leftmost of equals first, and the two cells of a doubly linked list become one.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; extra
columns are ignored; an empty table gives an empty table; a null doc_id stays null; a text that holds a
literal U+2581 is counted whole, as markers join across spaces. A text is counted whatever its length.
"""

from __future__ import annotations

import heapq
import functools

from pyspark.sql import DataFrame, SparkSession

from . import spm
from .common import batch_of, map_batches, table, texts_of

CACHE_WORDS = 1_000_000
CACHED_CHARS = 48


class HeapMerger:
    """Counts the pieces of one segment."""

    def __init__(self, data: bytes):
        model = spm.parse(data)
        if model.kind != spm.BPE:
            raise ValueError("heap merging is for byte-pair models")
        if any(kind in (spm.USER_DEFINED, spm.UNUSED) for _, _, kind in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.model = model
        self.rank = {p: -score for p, score, kind in model.pieces if kind == spm.NORMAL}

    def symbols(self, segment: str) -> list[str | None]:
        """Initial symbols: known characters, else one None a byte (or one for a run, without byte fallback)."""
        out: list[str | None] = []
        for c in segment:
            if c in self.rank:
                out.append(c)
            elif self.model.byte_fallback:
                out.extend([None] * len(c.encode()))
            elif not out or out[-1] is not None:
                out.append(None)
        return out

    def count(self, segment: str) -> int:
        cells = self.symbols(segment)
        n = len(cells)
        rank = self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            a, b = cells[i], cells[i + 1]
            if a is not None and b is not None and (r := rank.get(a + b)) is not None:
                heap.append((r, i, len(a) + len(b)))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, size = heapq.heappop(heap)
            a, j = cells[i], after[i]
            if a is None or j >= n or cells[j] is None or len(a) + len(cells[j]) != size:
                continue  # a cell of this pair has been merged since
            cells[i] = a = a + cells[j]
            cells[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            merges += 1
            if (h := before[i]) >= 0 and cells[h] is not None and (r := rank.get(cells[h] + a)) is not None:
                heapq.heappush(heap, (r, h, len(cells[h]) + len(a)))
            if k < n and cells[k] is not None and (r := rank.get(a + cells[k])) is not None:
                heapq.heappush(heap, (r, i, len(a) + len(cells[k])))
        return n - merges


class Counts(dict):
    """Word -> count, computed when first asked for; long words are not kept."""

    def __init__(self, data: bytes):
        super().__init__()
        self.merger, self.pattern = HeapMerger(data), spm.segmenter(data)

    def normalised(self, text: str) -> int:
        return sum(map(self.merger.count, self.pattern.findall(text)))

    def __missing__(self, word: str) -> int:
        n = self.normalised(spm.written(word))
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


@functools.lru_cache(maxsize=2)
def _counter(data: bytes):
    counts, model, plain = Counts(data), spm.parse(data), spm.plain(data)

    def count(text: str) -> int:
        words = spm.words(text) if plain else None
        return counts.normalised(model.normalise(text)) if words is None else sum(map(counts.__getitem__, words))

    return count


def count_tokens(text: str | None, data: bytes) -> int:
    return _counter(data)(text or "")


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def factory():
        count = _counter(shared.value)

        def run(batch):
            texts = texts_of(batch)
            tokens = [count(x) for x in texts]
            return batch_of(doc_id=batch.column(0), n_bytes=[len(x.encode()) for x in texts], n_tokens=tokens, over_limit=[x > limit for x in tokens])

        return run

    out = map_batches(docs, [docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")], factory, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("doc_id", id_col)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
