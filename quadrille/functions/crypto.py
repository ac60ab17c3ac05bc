"""crypto: digests natively, and RSA keys with textbook arithmetic in Arrow batches.

Keys are texts "e,n" (public) or "e,n,d" (private) of decimal numbers. A signature
is the digest of the text, as a number, raised to d modulo n.
"""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.functions.registry import register
from quadrille.plans.values import Num, Val

register("crypto:md5", forward=lambda s: Val.text(F.md5(s.lex())))
register("crypto:sha", forward=lambda s: Val.text(F.sha1(s.lex())))
for _bits in (224, 256, 384, 512):
    register(f"crypto:sha{_bits}", forward=lambda s, bits=_bits: Val.text(F.sha2(s.lex(), bits)))


def _prime(bits: int, rng: random.Random) -> int:
    while True:
        n = rng.getrandbits(bits) | (1 << (bits - 1)) | (1 << (bits - 2)) | 1
        if all(n % p for p in (3, 5, 7, 11, 13, 17, 19, 23, 29, 31)) and all(pow(a, n - 1, n) == 1 for a in (2, 3, 5, 7)):
            return n


def generate_key(bits: int, seed: object = None) -> str:
    rng, e = random.SystemRandom() if seed is None else random.Random(repr(seed)), 65537
    while True:
        p, q = _prime(bits // 2, rng), _prime(bits - bits // 2, rng)
        phi = (p - 1) * (q - 1)
        if p != q and phi % e:
            return f"{e},{p * q},{pow(e, -1, phi)}"


def _key(text: str) -> list[int]:
    return [int(x) for x in text.split(",")]


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), "big")


def sign_text(text: str, key: str) -> str:
    _, n, d = _key(key)
    return str(pow(_digest(text) % n, d, n))


def verify_text(text: str, signature: str, key: str) -> bool:
    e, n = _key(key)[:2]
    return pow(int(signature), e, n) == _digest(text) % n


def _rows(f, *series: pd.Series) -> list:
    def one(*args):
        if any(a is None for a in args):
            return None
        try:
            return f(*args)
        except (ValueError, TypeError):
            return None

    return [one(*args) for args in zip(*series, strict=True)]


@F.pandas_udf(T.StringType())
def _sign(text: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(_rows(sign_text, text, key), dtype="object")


@F.pandas_udf(T.BooleanType())
def _verify(text: pd.Series, signature: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(_rows(verify_text, text, signature, key), dtype="object")


@F.pandas_udf(T.LongType())
def _length(key: pd.Series) -> pd.Series:
    return pd.Series(_rows(lambda k: _key(k)[1].bit_length(), key), dtype="object")


@F.pandas_udf(T.StringType())
def _make(bits: pd.Series) -> pd.Series:
    return pd.Series(_rows(lambda b: generate_key(int(b)), bits), dtype="object")


_make = _make.asNondeterministic()  # drawn once for each row, however often it is used


def _keylength(s: Val) -> Val:
    i = _length(s.lex()).cast("decimal(38,0)")
    return Num(0, i.cast("double"), i.cast("decimal(38,18)"), i).val()


def _signed(s: Val) -> Val:
    text, key = s.exact(2)
    return Val.text(_sign(text.lex(), key.lex()))


def _checked(key: Val, o: Val):
    text, signature = o.exact(2)
    return _verify(text.lex(), signature.lex(), key.lex())


def _checked_text(s: Val) -> Val:
    text, signature, key = s.exact(3)
    ok = _verify(text.lex(), signature.lex(), key.lex())
    return Val.text(F.when(ok, "True").when(~ok, "False"))


def _public(s: Val) -> Val:
    return Val.text(F.when(F.size(F.split(s.lex(), ",")) >= 2, F.substring_index(s.lex(), ",", 2)))


register("crypto:keyLength", forward=_keylength, reverse=lambda o: Val.text(_make(o.num().i.cast("bigint"))))
register("crypto:sign", forward=_signed)
register("crypto:verify", test=_checked)
register("crypto:verifyBoolean", forward=_checked_text)
register("crypto:publicKey", forward=_public)
