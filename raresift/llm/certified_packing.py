"""Best-fit-decreasing packing with certified bin counts and exchange between partitions.

Each partition is packed on its own and its number of bins compared with lower bounds from dual-feasible functions. A
partition that meets its bound is certified. Bins with gaps of the others, and the emptiest bin of each certified one,
go to a common pool that is dealt anew and packed again, as long as this saves bins.
"""

from __future__ import annotations

import string
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from raresift.session import cut_lineage


def _byte_letters() -> dict[int, int]:
    """The visible character that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + k for k, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


class ChunkIds(dict):
    """Ids as little-endian 32-bit numbers by white-space-free chunk, up to ``remembered`` chunks at a time.

    The tokenizer drops white space and no token spans it, so the ids of a text are those of its chunks in order.
    """

    def __init__(self, definition: str, remembered: int = 400_000) -> None:
        super().__init__()
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are packed in the machine's own 32-bit order")
        self.tokenizer, self.remembered = Tokenizer.from_str(definition), remembered
        self.tokenizer.encode_special_tokens = True
        self.words: dict[str, bytes] = {}
        self[""] = b""

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.rstrip(string.punctuation)
        if word.isalpha() and (word.isascii() or max(word) <= "\xff"):
            # The tokenizer splits letters from what follows, so the same word is merged once for all its endings and cases.
            # For letters of Latin-1 its normal form is plain lower case.
            ids = self._word(word.lower()) + (self[chunk[len(word):]] if len(word) < len(chunk) else b"")
        else:
            ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= 64:
            if len(self) >= self.remembered:
                self.clear()
                self[""] = b""
            self[chunk] = ids
        return ids

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= self.remembered:
                self.words.clear()
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = self.words[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()
        return ids

    def __call__(self, text: str | None) -> bytes:
        chunks = (text or "").replace("\n", " ").split(" ")
        return b"".join(map(self.__getitem__, chunks))


def cut_pieces(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids followed by ``end_id``, cut only where longer than ``capacity``.

    A NULL or empty text is one piece with the end id alone. Only the id and the text are read; other columns and their
    names do not matter. Rows with equal ids, or NULL ids, are documents of their own.
    """
    with open(path, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = ChunkIds(definition.value)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(ids_of(text.as_py()) + end)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and what is left in each bin. The longest go first, into the fullest bin with room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, rooms = 0, []  # bit r of open_rooms: some bin has r left
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            place = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            room, place = capacity, len(rooms)
            rooms.append(capacity)
        bins[item], offsets[item] = place, capacity - room
        left = rooms[place] = room - size
        if left:
            by_room[left].append(place)
            open_rooms |= 1 << left
    return bins, offsets, np.array(rooms, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int, most: int = 24) -> int:
    """The largest of the bounds from two families of dual-feasible functions; no packing can use fewer bins.

    The first drops items under a threshold and rounds those over ``capacity - threshold`` up to a whole bin; the second
    rounds ``(k + 1) * x / capacity`` down, for k up to ``most``. The plain volume bound is the first at threshold 0.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)
    number, volume = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    low = np.arange(0, capacity // 2 + 1)
    under = np.where(low > 0, volume[low - 1], 0)
    rounded = (number[-1] - number[capacity - low]) * capacity + np.maximum(volume[capacity - low] - under, 0)
    best = -(-int(rounded.max()) // capacity)
    sizes = np.nonzero(counts)[0]
    for k in range(1, most + 1):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts[sizes]).sum()) // (k * capacity)))
    return best


_PACKED = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, slack long, certified boolean, worst boolean"


def _pack(pieces: DataFrame, capacity: int, per_part: int, rows: int, turn: int) -> DataFrame:
    parts = max(1, -(-rows // per_part))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid")  # the order of arrival is not the same in every run
        lengths = group["length"].to_numpy()
        bins, offsets, rooms = best_fit_decreasing(lengths, capacity)
        slack = rooms[bins]
        return group.assign(
            bin=bins, offset=offsets, slack=slack, certified=len(rooms) == lower_bound(lengths, capacity),
            worst=(slack > 0) & (bins == rooms.argmax()),
        )

    columns = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "part"]
    return dealt.select(*columns).groupBy("part").applyInPandas(pack, _PACKED)


def pack_sequences(
    docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 0, per_part: int = 4096, turns: int = 6
) -> DataFrame:
    """Pieces of all documents with sequence_id and offset: at most ``capacity`` ids a sequence, gapless from offset 0.

    ``per_part`` pieces on average are packed in one task, whatever the size of the input; ``turns`` bounds the rounds of
    exchange, which end earlier when one saves nothing. An empty table gives no rows. See ``cut_pieces`` for NULLs.
    """
    pieces = cut_lineage(cut_pieces(docs, path, capacity=capacity, end_id=end_id).withColumn("uid", F.monotonically_increasing_id()))
    packed = cut_lineage(_pack(pieces, capacity, per_part, pieces.count(), 0))
    settled, turn = [], 0
    pooled = (F.col("slack") > 0) & (~F.col("certified") | F.col("worst"))
    while True:
        named = packed.withColumn("sequence_id", F.lit(turn) * F.lit(1 << 52) + F.col("part") * F.lit(1 << 32) + F.col("bin"))
        pool = named.where(pooled)
        held, rows = pool.agg(F.sum((F.col("offset") == 0).cast("long")), F.count(F.lit(1))).first()
        if turn == turns or not held or held == 1:
            settled.append(named)
            break
        turn += 1
        again = cut_lineage(_pack(pool, capacity, per_part, rows, turn))
        if again.where("offset = 0").count() >= held:
            settled.append(named)
            break
        settled.append(named.where(~pooled))
        packed = again
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return result.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
