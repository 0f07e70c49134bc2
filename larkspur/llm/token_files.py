"""Token-id shards with Elias-Fano document boundaries.

A shard image is one byte string: a header, the ids of its documents as little-endian unsigned
integers of 2 or 4 bytes in one array, and two Elias-Fano sequences: the document boundaries and
the document ids. An Elias-Fano sequence of n ascending numbers below u keeps l = floor(log2(u / n))
low bits of each in a packed array and the high parts in unary in a bit vector, about 2 + l bits a
number; select(i) finds the i-th set bit from the stored place of every 64th, so no 64-bit offset table exists
and a reader gets one boundary without unpacking the others. Ids take 2 bytes where the vocabulary and the
end id allow it, else 4.

Images are written as binary rows of a Parquet table in the shared folder, because Spark's writers
reach any file system and a Python worker does not. Documents are range-partitioned by id and
sorted, so images in (part, block) order hold them in ascending id order.

Defined results: a null text is an empty document (its end id only); null ids come first and are
marked by a count in the header; rows with equal ids stand in the order of their texts; extra
columns are ignored; an empty table gives an empty table. A block holds up to `block_ids` ids, and a
longer document gets a block of its own.
"""

from __future__ import annotations

import functools
import itertools
import json
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, map_batches, materialize, slices, table

MAGIC = b"LKEF2\0\0\0"
SAMPLE = 64
CACHE_WORDS = 800_000
ENDINGS = b".,!?;:#$%&*|"


class EliasFano:
    """An ascending sequence of non-negative integers below 2**63."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.l = n, low_bits
        self.low, self.high = low, high
        self.samples = samples  # where every SAMPLE-th set bit of `high` is

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", np.zeros(0, "<u4"))
        u = int(v[-1]) + 1
        l = max(0, (u // n).bit_length() - 1)
        shifts = np.arange(l - 1, -1, -1, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)).tobytes() if l else b""
        at = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1, np.uint8)
        bits[at] = 1
        return cls(n, l, low, np.packbits(bits).tobytes(), at[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQB7x", self.n, len(self.low), len(self.high), self.l) + self.samples.tobytes() + self.low + self.high

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        n, low, high, l = struct.unpack_from("<QQQB", data)
        at = 32 + 4 * -(-n // SAMPLE)
        samples = np.frombuffer(data[32:at], "<u4")
        return cls(n, l, bytes(data[at : at + low]), bytes(data[at + low : at + low + high]), samples), at + low + high

    def select(self, i: int) -> int:
        """The i-th number, from the stored place of a set bit at most SAMPLE - 1 before and a scan from there."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        if left:
            byte, skip = at >> 3, (at & 7) + 1  # the sampled bit is behind us
            while True:
                part = int.from_bytes(self.high[byte : byte + 8].ljust(8, b"\0"), "big") & ((1 << (64 - skip)) - 1)
                ones = part.bit_count()
                if ones >= left:
                    break
                left, byte, skip = left - ones, byte + 8, 0
            for _ in range(left - 1):
                part ^= 1 << (part.bit_length() - 1)
            at = byte * 8 + 64 - part.bit_length()
        value, a = (at - i) << self.l, i * self.l
        if self.l:
            b = a + self.l
            bits = int.from_bytes(self.low[a >> 3 : (b + 7) >> 3], "big")
            value |= bits >> (-b & 7) & ((1 << self.l) - 1)
        return value

    def __iter__(self):
        return map(self.select, range(self.n))


def pack_shard(doc_ids: list, lengths: list[int], ids: bytes, width: int) -> bytes:
    """doc_ids ascending, None first; ids: the documents' ids in one array of `width` bytes each."""
    nulls = sum(x is None for x in doc_ids)
    known = doc_ids[nulls:]
    base = known[0] if known else 0
    ends = EliasFano.encode(np.cumsum(np.asarray(lengths, np.uint64)))
    names = EliasFano.encode([x - base for x in known])
    return MAGIC + struct.pack("<QQqQ", width, nulls, base, len(ids) // width) + ends.to_bytes() + names.to_bytes() + ids


class Shard:
    """Reader of a shard image; document(i) reads only that document's ids."""

    def __init__(self, image: bytes):
        view = memoryview(image)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token shard")
        self.width, self.nulls, self.base, self.n_ids = struct.unpack_from("<QQqQ", view, 8)
        at = 40
        self.ends, used = EliasFano.from_bytes(view[at:])
        at += used
        self.names, used = EliasFano.from_bytes(view[at:])
        at += used
        self.ids = np.frombuffer(view[at:], "<u2" if self.width == 2 else "<u4")
        if len(self.ids) != self.n_ids:
            raise ValueError("truncated token shard")

    def __len__(self) -> int:
        return self.ends.n

    def bounds(self, i: int) -> tuple[int, int]:
        """Where the ids of document i begin and end."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        begin, end = self.bounds(i)
        return self.ids[begin:end]

    def doc_ids(self) -> list:
        return [None] * self.nulls + [x + self.base for x in self.names]


def _ends_plain(core: str) -> bool:
    """Whether the normalised word ends in a letter or digit: U+0130 and U+0958 are letters that come to end in a mark."""
    last = core[-1] if core[-1].isascii() else unicodedata.normalize("NFC", core).lower()[-1]
    return last.isalpha() or last in "0123456789"


class WordIds:
    """White-space-separated word (UTF-8) -> its ids as bytes, by the tokenizers library."""

    def __init__(self, data: bytes, width: int):
        from tokenizers import Tokenizer

        self.known: dict[bytes, bytes] = {}  # a plain dict: sets subtract it by look-ups
        self.tokenizer, self.kind = Tokenizer.from_str(data.decode()), f"<u{width}"
        spec = json.loads(data)
        suffix = spec["model"].get("end_of_word_suffix")
        self.plain = None
        if suffix:
            # Words of letters that the normaliser leaves alone need no more than the model itself; the
            # ids that end a word tell them apart.
            spec |= {
                "normalizer": None,
                "pre_tokenizer": {
                    "type": "Sequence",
                    "pretokenizers": [
                        {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False},
                        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
                    ],
                },
            }
            self.plain = Tokenizer.from_str(json.dumps(spec))
            vocabulary = spec["model"]["vocab"]
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized]
        self.cut_id, self.cut = special[-1] if special else (None, None)

    def learn_letters(self, new: list[bytes]) -> list[bytes]:
        """Learns those of the words that are letters only and normal already; what is left."""
        if self.plain is None:
            return new
        letters, rest = [], []
        for w in new:
            t = w.decode()
            (letters if t.isalpha() and t == t.lower() and (t.isascii() or unicodedata.is_normalized("NFC", t)) else rest).append(w)
        lots = [letters[at : at + 1024] for at in range(0, len(letters), 1024)]
        found = self.plain.encode_batch_fast([b" ".join(lot).decode() for lot in lots], add_special_tokens=False)
        for lot, e in zip(lots, found, strict=True):
            ids = np.asarray(e.ids, self.kind)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * ids.itemsize
            if len(ends) != len(lot):
                rest += lot
                continue
            flat, ends = ids.tobytes(), ends.tolist()
            self.known.update(zip(lot, map(flat.__getitem__, map(slice, [0, *ends], ends)), strict=False))
        return rest

    def learn(self, new: list[bytes]) -> None:
        new = self.learn_letters(new)
        cut = self.cut and self.cut.encode()
        alone = new if cut is None else [w for w in new if b"<" in w]
        joined = [] if cut is None else [w for w in new if b"<" not in w]
        for word, e in zip(alone, self.tokenizer.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False), strict=True):
            self.known[word] = np.asarray(e.ids, self.kind).tobytes()
        # Many short calls cost more than their merging: words go in lots with a special token between, which always stands alone.
        lots = [joined[at : at + 512] for at in range(0, len(joined), 512)]
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast([cut.join(lot).decode() for lot in lots], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, self.kind)
            ends = np.append(np.flatnonzero(ids == self.cut_id), len(ids)).tolist()
            if len(ends) != len(lot):
                raise ValueError("the tokenizer did not keep words apart")
            at, flat, size = 0, ids.tobytes(), ids.itemsize
            for word, end in zip(lot, ends, strict=True):
                self.known[word] = flat[at * size : end * size]
                at = end + 1

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """ASCII white space is dropped by this tokenizer and nothing merges or composes across it, so words are independent.

        It also lower-cases and splits before a run of other signs. So fewer different words are asked
        for: A-Z is lowered first, unless a special token or a combining mark (lead byte CC, or U+0344,
        which stands for two of them) could make a difference, and ending signs are asked for apart after
        what the normaliser leaves as a letter or digit.
        """
        split = [(t if b"<" in t or b"\xcc" in t or b"\xcd\x84" in t else t.lower()).split() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, flat = self.known, list(itertools.chain.from_iterable(split))
        parts = list(map(known.get, flat))
        if None in parts:
            unknown = [i for i, x in enumerate(parts) if x is None]
            self.learn_words({flat[i] for i in unknown})
            for i in unknown:
                parts[i] = known[flat[i]]
        ends = list(itertools.accumulate(map(len, split)))
        return [b"".join(parts[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def learn_words(self, new: set[bytes]) -> None:
        ended, asked = {}, set()
        for w in new:
            core = w.rstrip(ENDINGS)
            if core and len(core) < len(w) and b"'" not in core and _ends_plain(core.decode()):
                ended[w] = core, w[len(core) :]
                asked.update(ended[w])
            else:
                asked.add(w)
        self.learn(list(asked.difference(self.known)))
        known = self.known
        known.update((w, known[core] + known[tail]) for w, (core, tail) in ended.items())


@functools.lru_cache(maxsize=2)
def _word_ids(data: bytes, width: int) -> WordIds:
    return WordIds(data, width)


def _separable(data: bytes) -> None:
    """Only tokenizers that drop white space and split there may be encoded word by word."""
    spec = json.loads(data)
    split = spec["pre_tokenizer"]["pretokenizers"][0] if spec["pre_tokenizer"] and spec["pre_tokenizer"]["type"] == "Sequence" else spec["pre_tokenizer"] or {}
    special = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])]
    if split.get("type") != "Split" or split.get("behavior") != "Removed" or not split.get("invert") or special:
        raise ValueError("this tokenizer does not drop white space; it can't be encoded word by word")


def _width(data: bytes, end_id: int) -> int:
    """Bytes of an id."""
    spec = json.loads(data)
    most = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    if not 0 <= end_id or most >= 1 << 32:
        raise ValueError("ids must lie between 0 and 2**32 - 1")
    return 2 if most < 1 << 16 else 4


def write_token_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 1, block_ids: int = 1 << 21, parts: int | None = None) -> DataFrame:
    """Write shard images of all documents and return them read back: part, block, first (ids of the part before the block), n_ids, image."""
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    _separable(data)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(data)  # one vocabulary file
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = _width(data, end_id)

    def run(batches):
        from pyspark import TaskContext

        encoder = _word_ids(shared.value, width)
        part = TaskContext.get().partitionId()
        end = np.asarray([end_id], encoder.kind).tobytes()
        names, lengths, held, size, before, block = [], [], [], 0, 0, 0

        def image():
            return batch_of(part=pa.array([part], pa.int32()), block=pa.array([block], pa.int32()), first=[before], n_ids=[size], image=pa.array([pack_shard(names, lengths, b"".join(held), width)], pa.binary()))

        for batch in batches:
            for piece in slices(batch, 128):
                texts = [x or b"" for x in piece.column(1).to_pylist()]
                for name, ids in zip(piece.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    n = len(ids) // width + 1
                    if names and size + n > block_ids:
                        yield image()
                        before, block = before + size, block + 1
                        names, lengths, held, size = [], [], [], 0
                    names.append(name)
                    lengths.append(n)
                    held += (ids, end)
                    size += n
        if names:
            yield image()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialize(dealt.mapInArrow(run, "part int, block int, first long, n_ids long, image binary"), "tokens")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """From the images alone, per document: doc_id, start (over all images), n_tokens, ids_crc32. Boundaries are read by select."""
    spark = shards.sparkSession
    # One small row for each range partition comes to the driver, whose number is set, not one for each document.
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, total = {}, 0
    for row in sizes:
        starts[row.part] = total
        total += row.n
    shared = spark.sparkContext.broadcast(starts)

    def factory():
        def run(batch):
            names, firsts, counts, sums = [], [], [], []
            for part, first, image in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(image)
                wide, begin, base = memoryview(shard.ids.astype("<u4").tobytes()), 0, shared.value[part] + first
                names += shard.doc_ids()
                for end in shard.ends:  # a document's end is the next one's beginning: one select each
                    firsts.append(base + begin)
                    counts.append(end - begin)
                    sums.append(zlib.crc32(wide[4 * begin : 4 * end]))
                    begin = end
            return batch_of(doc_id=pa.array(names, pa.int64()), start=firsts, n_tokens=counts, ids_crc32=sums)

        return run

    return map_batches(shards, ["part", "first", "image"], factory, "doc_id long, start long, n_tokens long, ids_crc32 long", rows=4)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_token_shards(write_token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
