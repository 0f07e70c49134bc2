"""Token counts, token-id shards and the SentencePiece codec against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb
from tokenizers import Tokenizer

from larkspur.llm import spm, spm_codec, token_counts, token_files

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "   a", "a  b ", "a\x00b <s> </s> <unk> ﬁ é́ \n\t x", " " * 17, " " * 50 + "x", "x" + " " * 33 + "y", "aaaaaaaaaaaa", "日本語テキスト😀 ▁▁ x", "\n\n\n a\r\n", "\nab c", "a |cut| b", "▁", "a\n b", "\x1c\x85\xa0x it's 'S <|endoftext|>y <|ENDOFTEXT|>", "J̌ Ḱ.", "Σας ΣΑΣ İ ǅ", "¼½ 12a.b,c!? (d). e'.", "<" * 30]


@pytest.fixture(scope="module")
def texts(docs):
    return [r.text for r in docs.select("text").collect()] + ODD


def test_counts_match_library(texts):
    data = open(MODEL, "rb").read()
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert [token_counts.count_tokens(t, data) for t in texts] == [len(x) for x in own.encode(texts)]


def test_counts_of_long_random_strings():
    data, own, r = open(MODEL, "rb").read(), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(5)
    for _ in range(40):
        t = "".join(r.choice("abeinorst .\n▁é中") for _ in range(r.randint(1, 600)))
        assert token_counts.count_tokens(t, data) == len(own.encode(t)), repr(t)


def test_markers_in_texts():
    data, own, r = open(MODEL, "rb").read(), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(7)
    texts = ["▁ 12", "▁ 2024", "low ▁ 12 high", "# ▁ 中é", "a▁ b", "a ▁b", "▁", "▁ ▁\n▁ x", "x▁\ny"]
    texts += [" ".join("".join(r.choice("▁▁12ae中\n") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 6))) for _ in range(300)]
    want = own.encode(texts)
    assert [token_counts.count_tokens(t, data) for t in texts] == [len(x) for x in want]
    got = spm_codec.codec(data).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want and all(spm_codec.codec(data).parity(texts, got))


def fuzzed(seed: int, n: int) -> list[str]:
    """Texts rich in what may break a cut between words: markers, dotted capital I, combining marks, odd spaces, special strings."""
    r = random.Random(seed)
    signs = ["▁", "▁▁", "İ", "i̇", "ǅ", "é", "e\u0301", "\u0344", "\u0958", "中", "😀", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "\u200b", "<s>", "</s>", "<unk>", "<|endoftext|>", "|cut|", "12", "a", "Ab", "the", "'s", ".", ",!", "#%", "\x00", "ß", "ﬁ", "Σ"]
    return ["".join(r.choice(signs) + " " * (r.random() < 0.3) for _ in range(r.randint(0, 9))) for _ in range(n)]


def test_fuzzed_texts():
    """20,000 texts: counts, ids, parity and decoded texts are the libraries'."""
    data, own, texts = open(MODEL, "rb").read(), sentencepiece.SentencePieceProcessor(model_file=MODEL), ["▁▁ ǅ", "İ.", *fuzzed(11, 20_000)]
    want = own.encode(texts)
    assert [token_counts.count_tokens(t, data) for t in texts] == [len(x) for x in want]
    c = spm_codec.Codec(data, 2)
    got = c.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want and all(c.parity(texts, got))
    assert c.decode(got) == c.whole.decode_batch(want, skip_special_tokens=False)


def test_parity_is_of_whole_texts():
    data = open(MODEL, "rb").read()
    c = spm_codec.Codec(data, 1)
    got = c.encode(["a b", "c d"])
    assert c.parity(["a b", "c d"], [got[0], got[1] + got[0]]) == [True, False]
    c.known["b"] = c.known["a"]  # a wrong word changes the ids and is told, not mended
    assert c.parity(["a b"], c.encode(["a b"])) == [False]


def test_decoding_bytes_that_are_no_text():
    c = spm_codec.Codec(open(MODEL, "rb").read(), 1)
    odd = [[c.whole.token_to_id(x) for x in ids] for ids in (["<0xE4>", "<0xB8>"], ["▁a", "<0xFF>", "b"], ["<0xE4>", "▁a", "<0xB8>", "<0xAD>"])]
    assert c.decode([np.asarray(x, "<u4").tobytes() for x in odd]) == c.whole.decode_batch(odd, skip_special_tokens=False)


def test_count_table(odd_docs, no_docs):
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts.token_counts(odd_docs, MODEL, limit=100).collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := len(own.encode(r.text or "")), n > 100) for r in odd_docs.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_counts.token_counts(no_docs, MODEL).collect() == []


def test_elias_fano():
    r = random.Random(1)
    for n, u in ((0, 1), (1, 5), (5, 3), (300, 100_000), (1000, 1001), (2000, 10**12), (70, 2**62)):
        values = sorted(r.randrange(u) for _ in range(n))
        made = token_files.EliasFano.encode(values)
        back, used = token_files.EliasFano.from_bytes(memoryview(made.to_bytes()))
        assert used == len(made.to_bytes()) and list(back) == values and [back.select(i) for i in reversed(range(n))] == values[::-1]
        if n > 200:
            assert 8 * (len(made.low) + len(made.high)) <= n * (3 + max(0, (u // n).bit_length())) + 64
    with pytest.raises(IndexError):
        token_files.EliasFano.encode([1]).select(1)


def test_words_are_independent(texts):
    data = open(WORDS, "rb").read()
    whole = Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)
    own = token_files.WordIds(data, 2).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u2").tolist() for x in own] == [e.ids for e in whole]
    with pytest.raises(ValueError, match="word by word"):
        token_files._separable(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())


def test_fuzzed_words():
    texts = ["İ.", "aİ!!", "İ:", *fuzzed(12, 20_000)]
    whole = Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)
    own = token_files.WordIds(open(WORDS, "rb").read(), 4).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in own] == [e.ids for e in whole]


def test_width_follows_the_ids(docs):
    data = open(WORDS, "rb").read()
    assert token_files._width(data, 1) == 2 and token_files._width(data, 70_000) == 4
    some = docs.limit(3)
    two, four = (token_files.read_token_shards(token_files.write_token_shards(some, WORDS, end_id=e, parts=1)).collect() for e in (1, 70_000))
    assert [r.n_tokens for r in two] == [r.n_tokens for r in four] and two[0].ids_crc32 != four[0].ids_crc32
    with pytest.raises(ValueError, match="between"):
        token_files._width(data, -1)


def test_words_that_end_in_a_mark_once_normalised():
    letters = ["İ", "\u0958", "\u09df", "\u0a5e", "\ufb2a", "\ufb4e"]
    texts = [f"{a}{c}{sign}" for a in ("", "B", "7") for c in letters for sign in ".,!?;:#$%&*|"]
    texts += ["İKİ, BİRİNCİ.", "\u0958!?", "é. 中, 한; \u1100\u1161!", "T\u0344x"]
    whole = Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)
    own = token_files.WordIds(open(WORDS, "rb").read(), 2).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u2").tolist() for x in own] == [e.ids for e in whole]


@pytest.mark.parametrize("block", [1 << 21, 50])
def test_shards(odd_docs, no_docs, block):
    tok = Tokenizer.from_file(WORDS)
    shards = token_files.write_token_shards(odd_docs, WORDS, block_ids=block, parts=3)
    rows = sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()))
    want, at = [], 0
    for r in rows:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.read_token_shards(shards).collect()), key=lambda r: r[1]) == want
    one = token_files.Shard(bytes(shards.orderBy("part", "block").first().image))
    assert one.doc_ids() == [w[0] for w in want[: len(one)]] and [len(one.document(i)) for i in range(len(one))] == [w[2] for w in want[: len(one)]]
    assert token_files.read_token_shards(token_files.write_token_shards(no_docs, WORDS, parts=2)).collect() == []


def unigram_model(tmp_path) -> str:
    """A unigram model written by hand: no training."""
    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = m.normalizer_spec.escape_whitespaces = True
    m.normalizer_spec.remove_extra_whitespaces = False
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]]
    rows += [(p, s, 1) for p, s in [("▁", -3.0), ("a", -4.0), ("b", -4.1), ("c", -4.2), ("ab", -5.0), ("bc", -5.5), ("▁a", -4.5), ("▁abc", -6.0), ("abc", -6.5), ("ca", -7.0)]]
    for p, s, k in rows:
        x = m.pieces.add()
        x.piece, x.score, x.type = p, s, k
    path = tmp_path / "unigram.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_codec_matches_library(texts):
    data, own = open(MODEL, "rb").read(), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    c = spm_codec.codec(data)
    got = c.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == own.encode(texts) and all(c.parity(texts, got))
    plain = [t for t in texts if spm.MARK not in t]
    assert c.decode(c.encode(plain)) == plain


def test_words_with_the_cut_token():
    data, own = open(MODEL, "rb").read(), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    cut = spm_codec.CUT
    texts = [f"a {cut} b", cut, f"x\n{cut}y z", cut + cut, f"\n{cut}"]
    c = spm_codec.Codec(data, 1)
    got = c.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == own.encode(texts) and all(c.parity(texts, got))


def test_unigram_model(tmp_path):
    path = unigram_model(tmp_path)
    own, c = sentencepiece.SentencePieceProcessor(model_file=path), spm_codec.Codec(open(path, "rb").read(), 1)
    r = random.Random(2)
    texts = ["", "abc", "abcabc  ca", "é日", "a\nb"] + ["".join(r.choice("abc  \n") for _ in range(30)) for _ in range(60)]
    got = c.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == own.encode(texts) and all(c.parity(texts, got))
    assert c.decode(got) == texts


def test_codec_table(odd_docs, no_docs):
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = spm_codec.encode_documents(odd_docs, MODEL)
    want = sorted((repr(r.doc_id), own.encode(r.text or "")) for r in odd_docs.collect())
    assert sorted((repr(r.doc_id), np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in found.collect()) == want
    back = spm_codec.decode_documents(found, MODEL)
    sure = odd_docs.where("doc_id <> 10 or doc_id is null").select(F.coalesce("text", F.lit("")).alias("t"))
    assert sorted(r.text for r in back.where("doc_id <> 10 or doc_id is null").collect()) == sorted(r.t for r in sure.collect())
    assert spm_codec.codec_digest(no_docs, MODEL).collect() == []
