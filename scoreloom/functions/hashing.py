"""Hashes that other systems can recompute."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_blake2b(seed: Column, value: Column) -> Column:
    """blake2b of seed, NUL, value as 16 hex digits: unsigned order is string order."""

    @F.pandas_udf("string")
    def digest(seed: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([blake2b_hex(s, v) for s, v in zip(seed, value, strict=True)])

    return digest(seed, value)


def blake2b_hex(seed: int, value: str) -> str:
    return hashlib.blake2b(f"{seed}\0{value}".encode(), digest_size=8).hexdigest()


def sha_parts(*parts: Column, sep: str = "\0") -> Column:
    """sha256 hex of parts joined by ``sep``."""
    return F.sha2(F.concat_ws(sep, *parts), 256)


def sha_int(hexed: Column, digits: int = 8) -> Column:
    """The first hex digits as an integer."""
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("long")


def attempt_seed(base: int, review_id: Column, attempt: Column, sep: str = "\0") -> Column:
    """31-bit seed of a review's attempt: both presentation orders share it."""
    return sha_int(sha_parts(F.lit(str(base)), review_id, attempt.cast("string"), sep=sep)).bitwiseAND(F.lit(0x7FFFFFFF))


def even_digit(hexed: Column) -> Column:
    """Coin: whether the last hex digit is even."""
    return F.conv(F.substring(hexed, -1, 1), 16, 10).cast("int") % 2 == 0


def unit_hash(*parts: Column) -> Column:
    """Uniform in [0, 1] from the 64-bit blake2b of parts joined by NUL, in Arrow batches."""

    @F.pandas_udf("double")
    def unit(text: pd.Series) -> pd.Series:
        return text.map(lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") / float(2**64 - 1))

    return unit(F.concat_ws("\0", *parts))


def inner_seed(base: int, outer_fold: int) -> int:
    """Seed of the inner folds of one outer fold."""
    return (base + int(sha_json({"outer_fold": outer_fold})[:8], 16)) % 0x7FFFFFFF


def matrix_digest(matrix: np.ndarray) -> str:
    """sha256 of a matrix as little-endian doubles in row order."""
    return hashlib.sha256(np.ascontiguousarray(matrix, "<f8").tobytes()).hexdigest()


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))


def sha_json(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def sha_file(path: str, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            h.update(part)
    return h.hexdigest()
