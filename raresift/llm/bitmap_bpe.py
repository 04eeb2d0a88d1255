"""Byte-level BPE with a hierarchical-bitmap rank queue.

Pending merges lie in one bucket per merge rank; three levels of 64-bit words tell which buckets hold anything, so the
lowest rank is found by three find-first-set steps. Entries whose pair has changed meanwhile are skipped when met. A
pre-token of n bytes costs O(n log n) at worst, so one very long pre-token is no harder than many short ones. The unseen
short pre-tokens of a batch share one queue, which spreads its cost over all of them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T


class RankQueue:
    """Positions by rank: lowest rank first, and within a rank the leftmost position.

    ``words[k]`` is level k of the bitmap: a set bit says that the word (or, at level 0, the bucket) below holds something.
    """

    def __init__(self, ranks: int) -> None:
        if ranks > 1 << 18:
            raise ValueError("three levels of 64-bit words hold 262,144 ranks")
        self.low, self.mid, self.top = [0] * (-(-ranks // 64)), [0] * 64, 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        filled = self.low[word]
        self.low[word] = filled | 1 << (rank & 63)
        if not filled:
            self.mid[word >> 6] |= 1 << (word & 63)
            self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        high = (top & -top).bit_length() - 1
        word = self.mid[high]
        word = high << 6 | (word & -word).bit_length() - 1
        bits = self.low[word]
        bit = bits & -bits
        rank = word << 6 | bit.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.low[word] = bits ^ bit
        if bits == bit:
            self.mid[high] ^= 1 << (word & 63)
            if not self.mid[high]:
                self.top ^= 1 << high
        return rank, bucket[0]

    def take(self) -> tuple[int, list[int]] | None:
        """The whole bucket of the lowest rank; its positions are in no particular order."""
        if not self.top:
            return None
        high = (self.top & -self.top).bit_length() - 1
        word = self.mid[high]
        word = high << 6 | (word & -word).bit_length() - 1
        bits = self.low[word]
        bit = bits & -bits
        rank = word << 6 | bit.bit_length() - 1
        self.low[word] = bits ^ bit
        if bits == bit:
            self.mid[high] ^= 1 << (word & 63)
            if not self.mid[high]:
                self.top ^= 1 << high
        return rank, self.buckets.pop(rank)


# The code points with the White_Space property.
_WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def plain_pattern(pattern: str) -> str:
    """The pattern with ``\\p{L}``, ``\\p{N}`` and ``\\s`` spelt out, for the standard library's faster matcher."""
    ranges: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        kind = ranges.get(unicodedata.category(chr(c))[0])
        if kind is not None:
            if kind and kind[-1][1] == c - 1:
                kind[-1][1] = c
            else:
                kind.append([c, c])
    members = {rf"\p{{{k}}}": "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in v) for k, v in ranges.items()} | {r"\s": _WHITE_SPACE}

    def spell(found: re.Match) -> str:
        inside = found[0].startswith("[")
        body = re.sub(r"\\p\{[LN]\}|\\s", lambda m: members[m[0]], found[0])
        return body if inside else f"[{body}]"

    return re.sub(r"\[[^]]*\]|\\p\{[LN]\}|\\s", spell, pattern.replace(r"\S", r"[^\s]"))


class Encoder:
    """Ids by pre-token and by chunk, each remembered for about ``remembered`` of them at a time. ``pattern`` is a plain one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = 400_000) -> None:
        self.ranks, self.split, self.remembered = ranks, re.compile(pattern).findall, remembered
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.vocabulary = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in ranks.values()}
        self.odd_space = re.compile(r" (?:\s|$)").search
        self.known: dict[str, tuple[int, ...]] = {}  # by pre-token
        self.words: dict[str, tuple[int, ...]] = {}  # by chunk behind a space

    def encode_batch(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text, in order.

        A space before a visible character always begins a pre-token. A text in which no other space occurs is therefore
        cut at its spaces, and only chunks not seen before are split by the pattern.
        """
        chunks = [[t] if self.odd_space(t) else t.split(" ") for t in (t or "" for t in texts)]
        for memory in (self.known, self.words):
            if len(memory) > self.remembered:
                memory.clear()
        heads = [self.split(c[0]) for c in chunks]
        new = list(set().union(*(islice(c, 1, None) for c in chunks)).difference(self.words))
        parts = [self.split(" " + w) for w in new]
        missing = list(set().union(*heads, *parts).difference(self.known))
        known = self.known
        known |= zip(missing, map(tuple, self.merge_all([p.encode("utf-8", "surrogatepass") for p in missing])), strict=True)
        self.words |= {
            w: known[p[0]] if len(p) == 1 else tuple(chain.from_iterable(map(known.__getitem__, p))) for w, p in zip(new, parts, strict=True)
        }
        for head, pieces in zip(heads, chunks, strict=True):
            rest = map(self.words.__getitem__, islice(pieces, 1, None))
            yield list(chain.from_iterable(chain(map(known.__getitem__, head), rest)))

    def merge_all(self, pieces: list[bytes], long: int = 256) -> list[list[int]]:
        """Ids of distinct pieces: tokens as they are, long pieces with the queue to themselves, the others sharing it."""
        ids: list[list[int]] = [[self.ranks[p]] if p in self.ranks else [] for p in pieces]
        shared = []
        for k, piece in enumerate(pieces):
            if not ids[k]:
                if len(piece) > long:
                    ids[k] = self.merge(piece)
                else:
                    shared.append(k)
        for at in range(0, len(shared), 20_000):
            for k, found in zip(shared[at:at + 20_000], self._merge_together([pieces[k] for k in shared[at:at + 20_000]]), strict=True):
                ids[k] = found
        return ids

    def _merge_together(self, pieces: list[bytes]) -> list[list[int]]:
        """All pieces in one linked list that is cut between them.

        A whole bucket is worked off at once. If a merge makes a pair of the same or a lower rank, the rest of that piece
        waits until the bucket comes up again, so each piece sees its merges in the order it would see them alone.
        """
        data, owner, ranks, queue = b"".join(pieces), [], self.ranks, self.queue
        rank_of, buckets = ranks.get, queue.buckets
        n = len(data)
        after, before, end, pair = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [-1] * n
        starts = []
        for k, piece in enumerate(pieces):
            start = len(owner)
            starts.append(start)
            owner += [k] * len(piece)
            before[start], after[len(owner) - 1] = -1, n
            for at in range(start, len(owner) - 1):
                rank = rank_of(data[at:at + 2])
                if rank is not None:
                    pair[at] = rank
                    if rank in buckets:
                        buckets[rank].append(at)
                    else:
                        queue.push(rank, at)
        while (entry := queue.take()) is not None:
            rank, bucket = entry
            bucket.sort()
            waiting = -1
            for at in bucket:
                if pair[at] != rank:
                    continue  # stale
                if owner[at] == waiting:
                    queue.push(rank, at)
                    continue
                gone = after[at]
                stop, follower, former = end[gone], after[gone], before[at]
                end[at], after[at], pair[gone], pair[at] = stop, follower, -1, -1
                if follower < n:
                    before[follower] = at
                    made = rank_of(data[at:end[follower]])
                    if made is not None:
                        pair[at] = made
                        if made <= rank:
                            waiting = owner[at]
                        if made in buckets:
                            buckets[made].append(at)
                        else:
                            queue.push(made, at)
                if former >= 0:
                    made = rank_of(data[former:stop])
                    if made is None:
                        pair[former] = -1
                    else:
                        pair[former] = made
                        if made <= rank:
                            waiting = owner[at]
                        if made in buckets:
                            buckets[made].append(former)
                        else:
                            queue.push(made, former)
        found = []
        for at in starts:
            ids = []
            while at < n:
                ids.append(ranks[data[at:end[at]]])
                at = after[at]
            found.append(ids)
        return found

    def merge(self, piece: bytes) -> list[int]:
        """The lowest-ranked, leftmost pair is merged until none is left."""
        ranks, queue = self.ranks, self.queue
        n, rank_of, push = len(piece), ranks.get, queue.push
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        pair = [-1] * n  # rank of the pair that starts here; -1 for none, or if this node is gone
        for at in range(n - 1):
            rank = rank_of(piece[at:at + 2])
            if rank is not None:
                pair[at] = rank
                push(rank, at)
        while (entry := queue.pop()) is not None:
            rank, at = entry
            if pair[at] != rank:
                continue  # stale
            gone = after[at]
            stop, follower, former = end[gone], after[gone], before[at]
            end[at], after[at], pair[gone], pair[at] = stop, follower, -1, -1
            if follower < n:
                before[follower] = at
                rank = rank_of(piece[at:end[follower]])
                if rank is not None:
                    pair[at] = rank
                    push(rank, at)
            if former >= 0:
                rank = rank_of(piece[former:stop])
                if rank is None:
                    pair[former] = -1
                else:
                    pair[former] = rank
                    push(rank, former)
        ids, at = [], 0
        while at < n:
            ids.append(ranks[piece[at:end[at]]])
            at = after[at]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


def _with_encoder(docs: DataFrame, path: str, pattern: str):
    """A function that builds the encoder inside a task; the vocabulary file is read once, on the driver."""
    with open(path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    plain = plain_pattern(pattern)
    return lambda: Encoder(read_ranks(content.value), plain)


def encode(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Every row with all columns and ``out``, the token ids of its whole text.

    NULL and empty texts have no ids. A column already named ``out`` is replaced; others pass through.
    """
    make = _with_encoder(docs, path, pattern)
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    place = [c.lower() for c in kept].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = pa.array(encoder.encode_batch(part.column(place).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, out])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Every row with all columns and ``out``, the bytes of its ids; NULL ids give no bytes."""
    make = _with_encoder(tokens, path, pattern)
    kept = [c for c in tokens.columns if c.lower() != out.lower()]
    schema = T.StructType([*tokens.select(*kept).schema.fields, T.StructField(out, T.BinaryType())])
    place = [c.lower() for c in kept].index(ids_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = pa.array([encoder.decode(i.as_py() or []) for i in part.column(place)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, out])

    return tokens.select(*kept).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the bytes they decode to.

    Encoding and decoding run in one pass, so ids of whole texts never leave the task that made them.
    """
    make = _with_encoder(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            rows = []
            for at in range(0, len(batch), 256):
                for ids in encoder.encode_batch(batch.column(1).slice(at, 256).to_pylist()):
                    listed = ",".join(map(encoder.decimal.__getitem__, ids)).encode()
                    rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()))
            counts, ids_sha, bytes_sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    id_field = docs.select("doc_id").schema.fields[0]
    schema = T.StructType([
        id_field, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ])
    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)
