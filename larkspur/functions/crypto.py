"""Hashes, AES in CBC mode with the paddings in use, byte masks and the enveloped cipher text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import hash_int

PKCS5, PKCS7, ZEROS, NONE = "PKCS5", "PKCS7", "ZEROS", "NONE"
HASHES = {
    "md5": F.md5,
    "sha1": F.sha1,
    "sha256": lambda c: F.sha2(c, 256),
    "sha512": lambda c: F.sha2(c, 512),
}


def register_hash(name: str, to_hex) -> None:
    """Adds a hash: a function from a column to its lower-case hexadecimal digest."""
    HASHES[name] = to_hex


def hash_hex(name: str, c: Column) -> Column:
    return HASHES[name](c)


def hash_bytes(name: str, c: Column) -> Column:
    return F.unhex(HASHES[name](c))


def hash_long(name: str, c: Column) -> Column:
    return hash_int(hash_bytes(name, c))




def _encrypt(p: Column, key: Column, iv: Column) -> Column:
    # the built-in function puts the vector first
    return F.substring(F.aes_encrypt(p, key, F.lit("CBC"), F.lit("DEFAULT"), iv), 17, 2**31 - 18)


def cbc_encrypt(p: Column, key: Column, iv: Column, padding: str = PKCS7) -> Column:
    """Cipher text without the vector. NONE takes whole blocks only; zero padding always adds."""
    if padding in (PKCS5, PKCS7):
        return _encrypt(p, key, iv)
    size = F.octet_length(p)
    if padding == ZEROS:
        p = F.concat(p, F.unhex(F.repeat(F.lit("00"), 16 - size % 16)))
        size = F.octet_length(p)
    else:
        p = F.when(size % 16 == 0, p)
    return F.substring(_encrypt(p, key, iv), F.lit(1), size)


def cbc_decrypt(c: Column, key: Column, iv: Column, padding: str = PKCS7) -> Column:
    if padding in (PKCS5, PKCS7):
        return F.aes_decrypt(F.concat(iv, c), key, F.lit("CBC"), F.lit("DEFAULT"))
    # a block of padding made for the last cipher block lets the built-in function take any text
    last = F.when(F.octet_length(c) == 0, iv).otherwise(F.substring(c, F.octet_length(c) - 15, F.lit(16)))
    tail = F.substring(F.aes_encrypt(F.unhex(F.lit("")), key, F.lit("CBC"), F.lit("DEFAULT"), last), 17, 16)
    plain = F.aes_decrypt(F.concat(iv, c, tail), key, F.lit("CBC"), F.lit("DEFAULT"))
    if padding == ZEROS:
        return _strip_zeros(plain)
    return plain


def _strip_zeros(b: Column) -> Column:
    """Without trailing zero bytes; pairs of digits are looked at from even places only."""
    return F.unhex(F.regexp_extract(F.hex(b), r"^((?:..)*?)(?:00)*\z", 1))


def _mask(table: bytes):
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else bytes(b).translate(table))

    return run


class DataMasker:
    """A substitution of the bytes 0 .. 254 by distinct bytes; 255 has no mask and gives an error."""

    def __init__(self, mask: bytes):
        if len(mask) != 255 or len(set(mask)) != 255:
            raise ValueError("a mask has 255 distinct bytes")
        self.forward = bytes(mask)
        missing = (set(range(256)) - set(mask)).pop()
        back = bytearray(256)
        for i, v in enumerate(mask):
            back[v] = i
        back[missing] = 0
        self.back = bytes(back)

    def mark(self, c: Column) -> Column:
        bad = F.hex(c).rlike("^(?:..)*FF")
        return F.when(bad, F.raise_error(F.lit("byte 255 can't be masked"))).otherwise(_mask(self.forward + b"\xff")(c))

    def unmark(self, c: Column) -> Column:
        return _mask(self.back)(c)


def data_encode(data: Column, key: Column, iv: Column, mask: DataMasker | None = None) -> Column:
    """Four zero bytes, then key and cipher text interleaved. Key and vector (16 bytes each) are the caller's, so that results repeat."""
    dist = F.concat(iv, cbc_encrypt(data, key, iv))
    half = (F.octet_length(dist) / 2).cast("int")
    k = mask.mark(key) if mask else key
    part = lambda b, a, n: F.substring(b, a, n)
    return F.concat(F.unhex(F.lit("00000000")), part(k, 1, 4), F.substring(dist, F.lit(1), half), part(k, 5, 8), F.substring(dist, half + 1, half), part(k, 13, 4))


def data_decode(source: Column, mask: DataMasker | None = None) -> Column:
    n = F.octet_length(source) - 20
    half = (n / 2).cast("int")
    sub = lambda a, k: F.substring(source, a if isinstance(a, Column) else F.lit(a), k if isinstance(k, Column) else F.lit(k))
    key = F.concat(sub(5, 4), sub(half + 9, 8), sub(half * 2 + 17, 4))
    dist = F.concat(sub(9, half), sub(half + 17, half))
    if mask:
        key = mask.unmark(key)
    return cbc_decrypt(F.substring(dist, F.lit(17), n - 16), key, F.substring(dist, 1, 16))


def random_int(low: int, high: int, seed: int | None = None) -> Column:
    """Uniform in low <= x < high; low where the range is empty."""
    return F.when(F.lit(high <= low), F.lit(low).cast("long")).otherwise((F.floor(F.rand(seed) * (high - low)) + low).cast("long"))


def random_string(n: int, seed: int | None = None) -> Column:
    return F.randstr(n, seed)


def random_bytes(n: int, seed: int | None = None) -> Column:
    """n bytes of the hash of random text, 32 at a time."""
    parts = [F.unhex(F.sha2(F.concat(F.rand(None if seed is None else seed + i).cast("string"), F.lit(str(i))), 256)) for i in range(-(-n // 32))]
    return F.substring(F.concat(*parts), 1, n)


def random_long(seed: int | None = None) -> Column:
    """Not negative."""
    return hash_int(random_bytes(8, seed)).bitwiseAND(F.lit(2**63 - 1))
