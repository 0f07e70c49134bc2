"""What both token operators need from a SentencePiece model file: pieces, kinds, normaliser flags, safe cut points."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    unk_id: int
    byte_fallback: bool
    add_dummy_prefix: bool
    remove_extra_whitespaces: bool
    escape_whitespaces: bool
    charsmap: bytes

    def normalise(self, text: str) -> str:
        """The model's text normalisation for identity character maps: marker for space, leading marker."""
        if self.remove_extra_whitespaces:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.add_dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.escape_whitespaces else text


@functools.lru_cache(maxsize=4)
def parse(data: bytes) -> Model:
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(data)
    n, t = m.normalizer_spec, m.trainer_spec
    if n.precompiled_charsmap:
        raise ValueError("only models with the identity character map are supported")
    if t.treat_whitespace_as_suffix:
        raise ValueError("whitespace as suffix is not supported")
    pieces = tuple((p.piece, p.score, p.type) for p in m.pieces)
    unk = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    return Model(pieces, t.model_type, unk, t.byte_fallback, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces, n.precompiled_charsmap)


@functools.lru_cache(maxsize=4)
def segmenter(data: bytes) -> re.Pattern:
    """A pattern whose matches cut normalised text where no piece can cross.

    A cut stands before a marker that follows another character (no piece has a marker inside after
    another character) and around a newline (no piece holds one). If the vocabulary breaks either
    rule, the pattern takes more together, at worst the whole text.
    """
    model = parse(data)
    own = [p for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in own):
        return re.compile(r"(?s).+")
    if any("\n" in p for p in own):
        return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
    return re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def words(text: str) -> list[str] | None:
    """Space-separated words of a text that has single spaces only and no marker of its own, else None.

    The normalised text is then the concatenation of `written(word)`: a word starting with a newline
    stands for itself, any other for the marker and itself. Splitting once at spaces is many times
    faster than matching segments; callers keep what a word yields and fall back to the segmenter.
    A marker in the text joins that of a space beside it, across the words.
    """
    if not text:
        return []
    if MARK in text:
        return None
    parts = text.replace("\n", " \n").split(" ")
    return None if "" in parts or "\n" in parts[0] else parts


def written(word: str) -> str:
    return word if word[0] == "\n" else MARK + word


@functools.lru_cache(maxsize=4)
def plain(data: bytes) -> bool:
    """Whether `words` may be used: marker for space, leading marker, newline in no piece, no piece over a word's start."""
    m = parse(data)
    return m.add_dummy_prefix and m.escape_whitespaces and not m.remove_extra_whitespaces and "\n" in segmenter(data).pattern
