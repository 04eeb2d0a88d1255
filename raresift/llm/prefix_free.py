"""Removal of repeated byte strings by a prefix-free parse of the corpus.

A rolling hash over short byte strings picks triggers: for every window of ``span`` bytes the trigger is the place of the
smallest hash in the window's middle. Equal windows so have equal triggers at equal offsets, whichever document they are in,
and the runs of windows that share a trigger (phrases) parse every text. Phrases form a dictionary by content:

* a phrase whose trigger context occurs once holds no repeated window;
* of equal phrases only the first in corpus order (doc_id, then position) can hold a first occurrence;
* only first phrases that share a trigger context with a different phrase are opened into their suffixes of ``span`` bytes,
  whose equal ones are brought together and put into corpus order.

So what is shuffled is one short row per phrase, about one for 33 bytes, and single windows only around the edges of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from raresift.session import cut_lineage

GRAM = 16  # bytes under the rolling hash
BEFORE = 10  # a trigger lies at least so many bytes behind the start of its window
_BLOCK = 1 << 20  # window starts that are parsed at a time


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the ``GRAM`` bytes at every position, by doubling the length."""
    base, value, length = 0x9E3779B97F4A7C15, data.astype(np.uint64) + np.uint64(1), 1
    while length < GRAM:
        value = value[:-length] * np.uint64(base) + value[length:]
        base, length = base * base % (1 << 64), 2 * length
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return value


def phrases(data: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigger, first and last window start of every run of windows (beginning at ``starts``, ascending) with one trigger."""
    bits = np.uint64(24)
    place = (rolling_hash(data) >> bits << bits) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    reach, width = span - GRAM - 2 * BEFORE + 1, 1
    while 2 * width <= reach:
        place = np.minimum(place[:-width], place[width:])
        width *= 2
    if reach > width:
        place = np.minimum(place[: width - reach], place[reach - width:])
    trigger = (place[starts + BEFORE] & np.uint64((1 << 24) - 1)).astype(np.int64)
    edge = np.flatnonzero((trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge, [len(starts)]]) - 1
    return trigger[first], starts[first], starts[last]


def _segments(texts: list[bytes], span: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to buffers of bounded size: buffer, window starts, and of each start its text's number and the shift to it."""
    parts, starts, owners, shifts, size = [], [], [], [], 0
    for number, data in enumerate(texts):
        for base in range(0, max(0, len(data) - span + 1), _BLOCK):
            part = data[base:base + _BLOCK + span - 1]
            count = len(part) - span + 1
            starts.append(size + np.arange(count))
            owners.append(np.full(count, number))
            shifts.append(np.full(count, base - size))
            parts.append(part)
            size += len(part)
            if size >= _BLOCK:
                yield b"".join(parts), *map(np.concatenate, (starts, owners, shifts))
                parts, starts, owners, shifts, size = [], [], [], [], 0
    if parts:
        yield b"".join(parts), *map(np.concatenate, (starts, owners, shifts))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _tag(data: bytes) -> int:
    """Tells texts apart whose rows share a doc_id; as a signed 64-bit number."""
    return (xxh3_64_intdigest(data) ^ 1 << 63) - (1 << 63)


def _bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _keys(docs: DataFrame, span: int) -> DataFrame:
    """The hash of the context that every window of a phrase holds, for all phrases of all texts."""
    after = BEFORE + GRAM  # as the trigger lies at least BEFORE bytes before the end of its window, too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                texts = [_bytes_of(t) for t in batch.column(0).slice(at, 512).to_pylist()]
                for data, starts, _, _ in _segments(texts, span):
                    triggers, _, _ = phrases(np.frombuffer(data, np.uint8), starts, span)
                    keys = [xxh3_64_intdigest(data[t - BEFORE:t + after]) for t in triggers.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(keys))], ["key"])

    return docs.select("text").mapInArrow(run, "key long")


def _phrase_rows(docs: DataFrame, span: int) -> DataFrame:
    """key, content, doc_id, tag, place of every phrase.

    ``content`` hashes all bytes of the phrase's windows, ``tag`` the whole text: doc_id and tag name a document. ``place``
    holds, from the high bits, the trigger's position, and how far before it the first and last window begin.
    """
    after = BEFORE + GRAM  # as the trigger lies at least BEFORE bytes before the end of its window, too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                ids = batch.column(0).slice(at, 512)
                texts = [_bytes_of(t) for t in batch.column(1).slice(at, 512).to_pylist()]
                tags = np.array([_tag(t) for t in texts], np.int64)
                for data, starts, owners, shifts in _segments(texts, span):
                    triggers, first, last = phrases(np.frombuffer(data, np.uint8), starts, span)
                    where = np.searchsorted(starts, first)
                    owner, position = owners[where], triggers + shifts[where]
                    far, near = triggers - first, triggers - last
                    place = position << 16 | far << 8 | near
                    keys = [xxh3_64_intdigest(data[t - BEFORE:t + after]) for t in triggers.tolist()]
                    contents = [
                        xxh3_64_intdigest(data[f:e + span], t - f << 8 | t - e)
                        for t, f, e in zip(triggers.tolist(), first.tolist(), last.tolist(), strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed(keys)), pa.array(_signed(contents)), ids.take(pa.array(owner)), pa.array(tags[owner]), pa.array(place)],
                        ["key", "content", "doc_id", "tag", "place"],
                    )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "key long, content long, doc_id long, tag long, place long"
    )


def _packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, tag and the compressed text: what a join with the texts has to move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, len(batch), 512):
                texts = [_bytes_of(t) for t in batch.column(1).slice(at, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 512), pa.array([_tag(t) for t in texts], pa.int64()),
                     pa.array([press.compress(t) for t in texts], pa.binary())],
                    ["doc_id", "tag", "packed"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, tag long, packed binary")


def _settle(df: DataFrame) -> DataFrame:
    """Write a step and drop what led to it: once the driver lets go of a plan, Spark deletes its shuffle files."""
    done = cut_lineage(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return done


def _contexts(texts: DataFrame, opened: DataFrame, span: int) -> DataFrame:
    """key, n, doc_id, tag, place, bytes: the opened phrases with all bytes of their windows."""
    wanted = opened.groupBy(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag")).agg(
        F.collect_list(F.struct("key", "n", "place")).alias("phrases")
    )
    joined = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("of_tag")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(len(batch)):
                data, own = unpack.decompress(batch.column(2)[row].as_py()), batch.column(3)[row].values
                places = own.field("place")
                cut = [
                    data[(p >> 16 & 0xFFFFFFFF) - (p >> 8 & 0xFF):(p >> 16 & 0xFFFFFFFF) - (p & 0xFF) + span]
                    for p in places.to_pylist()
                ]
                doc, tag = (pa.array([batch.column(k)[row].as_py()] * len(cut), pa.int64()) for k in range(2))
                yield pa.RecordBatch.from_arrays(
                    [own.field("key"), own.field("n"), doc, tag, places, pa.array(cut, pa.binary())],
                    ["key", "n", "doc_id", "tag", "place", "bytes"],
                )

    return joined.select("doc_id", "tag", "packed", "phrases").mapInArrow(
        run, "key long, n long, doc_id long, tag long, place long, bytes binary"
    )


def _seen_before(contexts: DataFrame, span: int) -> DataFrame:
    """doc_id, tag, place of window runs that repeat an earlier window; all phrases of a key are met in corpus order, key by key.

    Equal windows have equal keys, so nothing else need be compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        last = now = None
        for batch in batches:
            docs, tags, places = [], [], []
            for key, doc, tag, place, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if key != last:
                    seen.clear()
                    last, now = key, None
                if now == (doc, tag, place):
                    continue  # a row that repeats id and text
                now = (doc, tag, place)
                begun, far = None, place >> 8 & 0xFF
                for k in range(len(data) - span + 2):
                    window = data[k:k + span] if k <= len(data) - span else None
                    if window in seen:
                        begun = k if begun is None else begun
                        continue
                    seen.add(window)
                    seen.discard(None)
                    if begun is not None:
                        docs.append(doc)
                        tags.append(tag)
                        places.append(place >> 16 << 16 | far - begun << 8 | far - (k - 1))
                        begun = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(tags, pa.int64()), pa.array(places, pa.int64())], ["doc_id", "tag", "place"]
            )

    together = contexts.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("doc_id"), "tag", "place")
    return together.select("key", "doc_id", "tag", "place", "bytes").mapInArrow(run, "doc_id long, tag long, place long")


def _repeated_windows(contexts: DataFrame, span: int) -> DataFrame:
    """The same for keys of any size: every window is a row, and equal ones are combined before they are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags, places, found = [], [], [], []
            for doc, tag, place, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for k in range(len(data) - span + 1):
                    far = (place >> 8 & 0xFF) - k
                    docs.append(doc)
                    tags.append(tag)
                    places.append(place >> 16 << 16 | far << 8 | far)
                    found.append(xxh3_128_digest(data[k:k + span]))
            halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), *(pa.array(x, pa.int64()) for x in (docs, tags, places))],
                ["one", "two", "doc_id", "tag", "place"],
            )

    windows = cut_lineage(
        contexts.select("doc_id", "tag", "place", "bytes").mapInArrow(run, "one long, two long, doc_id long, tag long, place long")
    )
    earliest = windows.groupBy(F.col("one").alias("a"), F.col("two").alias("b")).agg(
        F.min(F.struct("doc_id", "tag", "place")).alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("a", "b", "first")
    later = windows.join(_settle(earliest), (F.col("one") == F.col("a")) & (F.col("two") == F.col("b")))
    return later.where(~F.struct("doc_id", "tag", "place").eqNullSafe(F.col("first"))).select("doc_id", "tag", "place")


def repeated_phrases(docs: DataFrame, texts: DataFrame, *, span: int = 100, together: int = 1024) -> DataFrame:
    """doc_id, tag, place: runs of windows of ``span`` bytes that also begin earlier. Runs may overlap or come twice.

    ``together`` is the number of phrases of one key that a task may hold; windows of larger keys are combined row by row.
    """
    counts = _keys(docs, span).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = _settle(counts.select(F.col("key").alias("of_key")))
    rows = _settle(_phrase_rows(docs, span).join(again, F.col("key") == F.col("of_key")).drop("of_key"))
    firsts = _settle(
        rows.groupBy("key", "content").agg(F.min(F.struct("doc_id", "tag", "place")).alias("first"), F.count(F.lit(1)).alias("copies"))
    )
    heads = firsts.where("copies > 1").select(F.col("key").alias("of_key"), F.col("content").alias("of_content"), "first")
    copies = rows.join(heads, (F.col("key") == F.col("of_key")) & (F.col("content") == F.col("of_content")))
    whole = _settle(copies.where(~F.struct("doc_id", "tag", "place").eqNullSafe(F.col("first"))).select("doc_id", "tag", "place"))
    shared = _settle(
        firsts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("of_key"), "n")
    )
    opened = firsts.join(shared, F.col("key") == F.col("of_key")).select("key", "n", "first.doc_id", "first.tag", "first.place")
    contexts = _settle(_contexts(texts, opened, span))
    few = _settle(_seen_before(contexts.where(F.col("n") <= together), span))
    many = _settle(_repeated_windows(contexts.where(F.col("n") > together), span))
    return whole.unionByName(few).unionByName(many)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges joined, ascending."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, *, span: int = 100) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end: maximal removed runs) and kept (the remaining bytes) of every row.

    A byte goes if a ``span``-byte string covering it also starts earlier: in a document with a smaller id, or in the same one
    at a smaller offset. Strings are judged on the input and never cross documents; NULL and empty texts have no bytes. Rows
    that share an id are ordered by a 64-bit hash of their text; rows that repeat id and text are one document, so neither loses
    bytes to the other. NULL ids come first. Other columns are not read; an empty table gives no rows.
    """
    texts = _packed_texts(docs)
    found = repeated_phrases(docs, texts, span=span)
    runs = found.groupBy(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag")).agg(
        F.collect_set("place").alias("places")
    )
    joined = texts.join(runs, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("of_tag")), "left")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, len(batch), 256):
                sizes, runs, left = [], [], []
                for packed, found in zip(batch.column(1).slice(at, 256), batch.column(2).slice(at, 256), strict=True):
                    data = unpack.decompress(packed.as_py())
                    own = merged([
                        ((p >> 16 & 0xFFFFFFFF) - (p >> 8 & 0xFF), (p >> 16 & 0xFFFFFFFF) - (p & 0xFF) + span) for p in found.as_py() or []
                    ])
                    edges = [0, *(x for pair in own for x in pair), len(data)]
                    sizes.append(len(data))
                    runs.append([{"start": a, "end": b} for a, b in own])
                    left.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(left, pa.binary())],
                    ["doc_id", "n_bytes", "spans", "kept"],
                )

    return joined.select("doc_id", "packed", "places").mapInArrow(
        run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    )


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
