"""Vector expressions over ``array<float>`` / ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from citesift.functions.text import bind, token_list

HASH_HEX_DIGITS = 8
# What a task remembers: so many tokens, none longer than this.
REMEMBERED_TOKENS, REMEMBERED_LENGTH = 250_000, 64


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector of ``v``; a zero vector stays zero."""
    return bind(
        l2_norm(v),
        lambda n: F.transform(v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n)),
    )


def bucket_labels(dim: int) -> list[str]:
    """Names of the hash buckets, in the form ``token_buckets`` writes them."""
    digits = _hex_digits(dim)
    return [format(i, f"0{digits}x") if digits else str(i) for i in range(dim)]


def token_buckets(text: Column, dim: int) -> Column:
    """One bucket name per token: the first 32 bits of its md5, modulo ``dim``.

    For a power of 16 the remainder is simply the last hex digits of those 32 bits, which saves
    the base conversion.
    """
    digits = _hex_digits(dim)

    def bucket(token: Column) -> Column:
        digest = F.md5(token.cast("binary"))
        if digits:
            return F.substring(digest, HASH_HEX_DIGITS - digits + 1, digits)
        number = F.conv(F.substring(digest, 1, HASH_HEX_DIGITS), 16, 10).cast("bigint")
        return (number % dim).cast("string")

    return F.transform(token_list(text), bucket)


def _hex_digits(dim: int) -> int:
    """j if ``dim`` is 16**j, else 0."""
    for j in range(1, HASH_HEX_DIGITS):
        if dim == 16**j:
            return j
    return 0


class TokenBuckets(dict):
    """The bucket of ``token_buckets`` as a number, by token in UTF-8."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: bytes) -> int:
        digest = md5(token, usedforsecurity=False).digest()
        bucket = int.from_bytes(digest[: HASH_HEX_DIGITS // 2], "big") % self.dim
        if len(token) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED_TOKENS:
                self.clear()
            self[token] = bucket
        return bucket

    def counts(self, texts: Iterable[list[bytes]]) -> np.ndarray:
        """Tokens in each bucket, one row per text."""
        rows = []
        for tokens in texts:
            found = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
            rows.append(np.bincount(found, minlength=self.dim))
        return np.array(rows, np.float64).reshape(len(rows), self.dim)
