"""SentencePiece encoding and decoding by the tokenizers library.

The model's protobuf is parsed and rebuilt as a tokenizers pipeline: normaliser (leading marker,
marker for space), metaspace pre-tokenizer cut where no piece can cross, unigram scores or byte-pair
merges, byte fallback, and the matching decoder. Batches are encoded by the library's threads.

The ids, and the texts decoded from them, are the rebuilt pipeline's. Texts are cut at single spaces, where no piece
crosses, and every different word a task meets is encoded once. Other texts are encoded whole. The
rebuilt decoder is applied to every piece once; a text is its pieces' bytes joined.

Parity: sentencepiece encodes every whole text by itself, without any of these cuts; the row's parity
flag says whether its ids are the same. It never changes the ids.

Defined results: a null or empty text has no ids; repeated rows are encoded each; extra columns are
ignored; an empty table gives an empty table; a null doc_id stays null; a literal U+2581 in a text is the
marker itself, as in the library, and comes back as a space (round_trip is false).
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import spm
from .common import batch_of, map_batches, table, texts_of

CACHE_WORDS = 300_000
CUT = "|cut|"


def rebuild(data: bytes, normalise: bool = True):
    """The tokenizers pipeline for a SentencePiece model. Without `normalise`, it takes normalised segments, CUT between them."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = spm.parse(data)
    if m.kind == spm.UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback)
    elif m.kind == spm.BPE:
        ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        own = {p for p, _, kind in m.pieces if kind == spm.NORMAL}
        merges = []
        for piece, score, kind in m.pieces:
            if kind == spm.NORMAL:
                cuts = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in own and piece[i:] in own]
                merges += [(-score, ids[piece], ids[a], ids[b], a, b) for a, b in cuts]
        merges.sort(key=lambda x: x[:4])
        model = models.BPE(ids, [x[4:] for x in merges], unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError("only unigram and byte-pair models can be rebuilt")
    out = Tokenizer(model)
    steps = []
    if normalise:
        if m.remove_extra_whitespaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if m.add_dummy_prefix:
            steps.append(normalizers.Prepend(spm.MARK if m.escape_whitespaces else " "))
        if m.escape_whitespaces:
            steps.append(normalizers.Replace(" ", spm.MARK))
        out.normalizer = normalizers.Sequence(steps)
    else:
        out.add_special_tokens([AddedToken(CUT, normalized=False, special=True)])
    out.pre_tokenizer = pre_tokenizers.Split(Regex(spm.segmenter(data).pattern), "removed", invert=True)
    tail = [decoders.Strip(" ", 1, 0)] if m.add_dummy_prefix and normalise else []
    out.decoder = decoders.Sequence([decoders.Replace(spm.MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return out


class Codec:
    """Word -> ids as bytes, kept up to a number of words; whole texts where words don't apply. Id -> bytes of text."""

    def __init__(self, data: bytes, threads: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.model, self.plain = spm.parse(data), spm.plain(data)
        self.whole, self.part = rebuild(data), rebuild(data, normalise=False)
        self.cut_id = self.part.token_to_id(CUT)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.threads = threads
        self.known: dict[str, bytes] = {}
        # the decoder's steps but the last, by the library, once for each piece; a byte piece is its byte
        texts = self.part.decode_batch([[i] for i in range(len(self.model.pieces))], skip_special_tokens=False)
        self.said = [bytes([int(p[3:5], 16)]) if kind == spm.BYTE else t.encode() for t, (p, _, kind) in zip(texts, self.model.pieces, strict=True)]

    def parity(self, texts: list[str], found: list[bytes]) -> list[bool]:
        """Whether sentencepiece gives the same ids for each whole text."""
        wanted = self.other.encode(texts, num_threads=self.threads)
        return [np.asarray(b, "<u4").tobytes() == a for a, b in zip(found, wanted, strict=True)]

    def whole_texts(self, texts: list[str]) -> list[bytes]:
        """By the whole pipeline, normaliser included."""
        found = self.whole.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids if t else [], "<u4").tobytes() for e, t in zip(found, texts, strict=True)]

    def learn(self, new: list[str]) -> None:
        joined = [w for w in new if CUT not in w]
        lots = [joined[at : at + 512] for at in range(0, len(joined), 512)]
        found = self.part.encode_batch_fast([CUT.join(map(spm.written, lot)) for lot in lots], add_special_tokens=False)
        for lot, e in zip(lots, found, strict=True):
            ids = np.asarray(e.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.cut_id), len(ids)).tolist()
            if len(ends) != len(lot):
                raise ValueError("the tokenizer did not keep words apart")
            at, flat = 0, ids.tobytes()
            for word, end in zip(lot, ends, strict=True):
                self.known[word] = flat[4 * at : 4 * end]
                at = end + 1
        for word in new:
            if CUT in word:  # the whole pipeline has no such token; it puts a marker first, which a word after a newline does not have
                got = self.whole.encode(word, add_special_tokens=False).ids[word[0] == "\n" :]
                self.known[word] = np.asarray(got, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        split = [spm.words(t) if self.plain else None for t in texts]
        flat = [w for s in split if s for w in s]
        parts = list(map(self.known.get, flat))
        if None in parts:
            unknown = [i for i, x in enumerate(parts) if x is None]
            self.learn(list({flat[i] for i in unknown}))
            for i in unknown:
                parts[i] = self.known[flat[i]]
        rest = iter(self.whole_texts([t for t, s in zip(texts, split, strict=True) if s is None]))
        out, end = [], 0
        for s in split:
            if s is None:
                out.append(next(rest))
            else:
                begin, end = end, end + len(s)
                out.append(b"".join(parts[begin:end]))
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        """The pieces' bytes joined, without the leading marker's space. Where bytes are no text, the whole decoder says what stands for them."""
        out = []
        for x in ids:
            own = np.frombuffer(x, "<u4").tolist()
            try:
                t = b"".join(map(self.said.__getitem__, own)).decode()
            except UnicodeDecodeError:
                t = self.whole.decode(own, skip_special_tokens=False)
            else:
                t = t[1:] if self.model.add_dummy_prefix and t[:1] == " " else t
            out.append(t)
        return out


@functools.lru_cache(maxsize=2)
def codec(data: bytes, threads: int = 2) -> Codec:
    return Codec(data, threads)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str, threads: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (binary, little-endian unsigned 32 bit), parity."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(model_path))  # one vocabulary file

    def factory():
        c = codec(shared.value, threads)

        def run(batch):
            texts = texts_of(batch)
            found = c.encode(texts)
            return batch_of(doc_id=batch.column(0), ids=pa.array(found, pa.binary()), parity=c.parity(texts, found))

        return run

    return map_batches(docs, [docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")], factory, "doc_id long, ids binary, parity boolean")


def decode_documents(encoded: DataFrame, model_path: str, threads: int = 2) -> DataFrame:
    """Per row of encode_documents: doc_id, text."""
    shared = encoded.sparkSession.sparkContext.broadcast(_read(model_path))

    def factory():
        c = codec(shared.value, threads)

        def run(batch):
            return batch_of(doc_id=batch.column(0), text=c.decode([x or b"" for x in batch.column(1).to_pylist()]))

        return run

    return map_batches(encoded, ["doc_id", "ids"], factory, "doc_id long, text string")


def codec_digest(docs: DataFrame, model_path: str, threads: int = 2) -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens, ids_crc32, parity, round_trip, decoded_crc32.

    round_trip: the decoded text equals the text. decoded_crc32: of the decoded text's UTF-8 bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_read(model_path))

    def factory():
        c = codec(shared.value, threads)

        def run(batch):
            texts = texts_of(batch)
            found = c.encode(texts)
            back = c.decode(found)
            return batch_of(
                doc_id=batch.column(0),
                n_tokens=[len(x) // 4 for x in found],
                ids_crc32=[zlib.crc32(x) for x in found],
                parity=c.parity(texts, found),
                round_trip=[a == b for a, b in zip(texts, back, strict=True)],
                decoded_crc32=[zlib.crc32(x.encode()) for x in back],
            )

        return run

    cols = [docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")]
    return map_batches(docs, cols, factory, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean, decoded_crc32 long")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return codec_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
