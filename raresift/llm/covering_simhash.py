"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r every bit position gets a vector of r + 1 bits, and each non-zero selector of r + 1 bits makes one mask: the
positions whose vector has an odd overlap with it. Whatever r positions differ, some selector is orthogonal to all their
vectors, so the two fingerprints agree under that mask: no pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from raresift.llm.components import connected_components
from raresift.session import cut_lineage

BITS = 64


def covering_masks(radius: int = 3, seed: int = 5) -> list[int]:
    """``2 ** (radius + 1) - 1`` masks. Vectors are non-zero and dealt evenly, so the masks are about equally selective."""
    kinds = (1 << (radius + 1)) - 1
    vectors = np.random.default_rng(seed).permutation(np.arange(BITS) % kinds) + 1
    return [
        sum(1 << bit for bit, v in enumerate(vectors.tolist()) if (v & selector).bit_count() & 1)
        for selector in range(1, kinds + 1)
    ]


def fingerprint(text: str | None, size: int = 3, chunk: int = 1 << 16) -> bytes:
    """Eight bytes, highest bit first. No words: zero. Fewer words than ``size``: one shingle of all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII white spaces only
    if not words:
        return bytes(8)
    count, ones, digest = max(1, len(words) - size + 1), np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for at in range(0, count, chunk):
        part = words[at:at + chunk + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
        hashes = np.frombuffer(b"".join([digest(s, 42) for s in shingles]), np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count).tobytes()


def fingerprints(docs: DataFrame, *, size: int = 3) -> DataFrame:
    """doc_id, text_hash and print (a signed 64-bit fingerprint) of every row; only the id and the text are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join(fingerprint(t.as_py(), size) for t in batch.column(1))
            prints = pa.array(np.frombuffer(found, ">i8").astype(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), prints], ["doc_id", "text_hash", "print"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, print long")


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask)


def close_pairs(prints: DataFrame, *, radius: int = 3) -> DataFrame:
    """(a, b): each pair of different fingerprints that differ in at most ``radius`` bits, once.

    ``prints`` holds distinct fingerprints. Both sides of the join are plain shuffles of the same rows, so Spark writes them
    once and splits a partition that holds a crowded bucket. A pair counts only in the first table where it meets.
    """
    masks = [_signed(m) for m in covering_masks(radius)]
    keys = prints.select("print", F.posexplode(F.array(*[F.col("print").bitwiseAND(m) for m in masks])).alias("table", "key"))
    one, two = keys.alias("one"), keys.alias("two")
    differ = F.col("one.print").bitwiseXOR(F.col("two.print"))
    first_met = F.coalesce(*[F.when(differ.bitwiseAND(m) == 0, F.lit(k)) for k, m in enumerate(masks)])
    return one.join(
        two,
        (F.col("one.table") == F.col("two.table")) & (F.col("one.key") == F.col("two.key"))
        & (F.col("one.print") < F.col("two.print")) & (F.bit_count(differ) <= radius) & (first_met == F.col("one.table")),
    ).select(F.col("one.print").alias("a"), F.col("two.print").alias("b"))


def near_duplicates(docs: DataFrame, *, size: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, text_hash, print, component_id for every row: the smallest doc_id reachable over links within ``radius`` bits.

    Rows with the same fingerprint, equal texts among them, are folded to one before anything is compared. Texts without
    words (NULL, empty, white space) share fingerprint zero and are linked like others. A NULL id is kept and never
    names a component unless all ids in it are NULL; ``text_hash`` tells rows apart that have no id or share one. Columns
    other than doc_id and text are not read.
    """
    found = cut_lineage(fingerprints(docs, size=size))
    distinct = cut_lineage(found.groupBy("print").agg(F.min("doc_id").alias("least")))
    linked = connected_components(close_pairs(distinct.select("print"), radius=radius))
    named = distinct.join(linked, distinct["print"] == linked["node"], "left").select(
        "print", "least", F.coalesce("component", "print").alias("component")
    )
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = cut_lineage(named.join(names, "component").select(F.col("print").alias("of"), "component_id"))
    return found.join(ids, F.col("print") == F.col("of")).select("doc_id", "text_hash", "print", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )
