"""Stable buckets, row fingerprints and result ids."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("\u0000"))


def md5_number(text: Column) -> Column:
    """First 60 bits of md5 as a non-negative long; the same on any engine with md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def md5_bucket(key: Column, seed: int | str, buckets: int = 10_000) -> Column:
    return md5_number(F.concat(F.lit(f"{seed}:"), key.cast("string"))) % buckets


def blake_bucket(key: Column, seed: int, buckets: int = 10_000) -> Column:
    """The 8-byte blake2b bucket of ``seed:key``, batched through Arrow."""

    @F.pandas_udf("long")
    def bucket(values: pd.Series) -> pd.Series:
        return values.map(
            lambda v: None
            if v is None
            else int.from_bytes(hashlib.blake2b(f"{seed}:{v}".encode(), digest_size=8).digest(), "big") % buckets
        ).astype("Int64")

    return bucket(key.cast("string"))


def row_md5(columns: Sequence[str]) -> Column:
    """Order-sensitive fingerprint of a row's payload, comparable across engines."""
    return F.md5(F.concat_ws("\u0001", *[_text(F.col(c)) for c in columns]))


def row_hash16(columns: Sequence[str]) -> Column:
    """16 hex digits of xxhash64: the cheap fingerprint used inside one engine."""
    return F.lower(F.lpad(F.hex(F.xxhash64(*columns)), 16, "0"))


def result_id(columns: Sequence[str]) -> Column:
    """sha1 of the identifying columns joined by ``|``; NULL reads as empty."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def dataset_digest(columns: Sequence[str]) -> list[Column]:
    """Aggregates giving an order-free digest: row count and xor of row hashes."""
    return [F.count(F.lit(1)).alias("n_rows"), F.bit_xor(F.xxhash64(*columns)).alias("digest")]
