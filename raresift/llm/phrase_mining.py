"""Collocations: frequent phrases by multikey three-way quicksort of suffix pointers, scored by how tightly their parts go together.

Every word starts a suffix, cut after ``longest`` words or at the end of its piece. Suffixes travel as compressed blocks of word
numbers with the words those stand for, equal ones folded to one with a weight where the text lies. They are routed globally
by their leading words, so that all suffixes that share a frequent phrase meet in one task:

* a prefix with more than its share of all suffixes is *heavy*; a first pass over all texts finds them. A suffix is routed by its
  leading words up to the first prefix that is not heavy, so no word or pair, however common, fills a task;
* a task sorts its pointers word by word: less, equal, greater than a pivot. The weight of an equal part is the count of a phrase
  and goes on to the next word; a part below the least count is abandoned with all it holds;
* counts of heavy prefixes come from several tasks and are summed up; all others are whole.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from raresift.operators.ranking import top_per_group
from raresift.session import cut_lineage

LEAST = 30  # occurrences of a phrase
LONGEST = 4  # words of a phrase
TOP = 2000
SCALE = 2_000_000
COVERED = (100, 80)  # a phrase goes if 100 times a longer one's count reaches 80 times its own
#: A heavy prefix holds more than one part in so many, for each task, of the suffixes.
FINE = 4
_UPPER, _END = bytes(range(65, 91)), b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(_UPPER + b"\t" + _END, _UPPER.lower() + b" " + b"\n" * len(_END))
_SLICE = 1 << 20  # bytes of a text that are split at a time
_CHUNK = 1 << 20  # words whose suffixes are folded at a time; with the words of one slice more they have 21 bits
_WORDS = 1 << 20  # a task's dictionary is begun anew beyond so many words

#: DuckDB text of ``collocations``.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM words, unnest(range(1, 5)) AS sizes(k), unnest(range(1, len(w) - k + 2)) AS places(i)),
f AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT f.lang, f.phrase, f.a, c AS cut, l.a AS l, r.a AS r, CAST(2000000 * f.a::HUGEINT // (l.a + r.a) AS BIGINT) AS score
  FROM f, unnest(range(1, f.k)) AS places(c)
  JOIN f l ON l.lang = f.lang AND l.phrase = array_to_string(f.w[1:c], ' ')
  JOIN f r ON r.lang = f.lang AND r.phrase = array_to_string(f.w[c + 1:f.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM f, unnest(range(2, f.k)) AS sizes(m), unnest(range(1, f.k - m + 2)) AS places(i) GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= 2000
"""


class Suffixes(NamedTuple):
    """Distinct suffixes of a chunk in the order of their word numbers; number 0 ends a suffix."""

    lang: str
    words: list[bytes]  # by number
    keys: np.ndarray  # one row a suffix, one column a word
    weights: np.ndarray


def _slices(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = at + _SLICE
        if end < len(data):
            blank = data.find(b" ", end)
            blank = len(data) if blank < 0 else blank
            line = data.find(b"\n", end, blank)
            end = blank if line < 0 else line
        yield data[at:end]
        at = end


def _folded(lang: str, ids: np.ndarray, words: list[bytes], longest: int) -> Suffixes:
    """The distinct suffixes that start in ``ids`` but for its last ``longest - 1`` places, with their weights."""
    used = np.zeros(len(words), bool)
    used[ids] = True
    used[0] = True
    own = np.flatnonzero(used)
    renumber = np.zeros(len(words), np.int64)
    renumber[own] = np.arange(len(own))
    ids = renumber[ids]
    count = len(ids) - longest + 1
    begun = np.flatnonzero(ids[:count])
    columns = [ids[begun]]
    for k in range(1, longest):
        columns.append(np.where(columns[-1] == 0, 0, ids[begun + k]))
    # Numbers have at most 21 bits, so three columns fill a key; before a fourth, the key is renumbered in its order.
    packed, filled = columns[0], 1
    for column in columns[1:]:
        if filled == 3:
            packed, filled = np.unique(packed, return_inverse=True)[1], 1
        packed, filled = packed << 21 | column, filled + 1
    first, weights = np.unique(packed, return_index=True, return_counts=True)[1:]
    keys = np.stack([c[first] for c in columns], axis=1).astype(np.int32)
    return Suffixes(lang, [words[k] for k in own.tolist()], keys, weights)


def suffix_chunks(rows: Iterator[tuple[str, bytes | None]], longest: int) -> Iterator[Suffixes]:
    """All suffixes of all texts, chunk by chunk and language by language. Texts are read in slices, so one may be of any length."""
    numbers: defaultdict[bytes, int] = defaultdict()

    def begin() -> None:
        numbers.clear()
        numbers.default_factory = numbers.__len__
        for word in (b"\n", b""):
            numbers[word]

    begin()
    held: defaultdict[str, list[np.ndarray]] = defaultdict(list)
    size, ahead = 0, np.zeros(longest - 1, np.int64)
    for lang, text in rows:
        for part in _slices((text or b"").translate(_FOLD)):
            tokens = part.replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
            held[lang].append(ids[ids != 1])
            size += len(held[lang][-1])
            if size >= _CHUNK:
                words = list(numbers)
                open_ = np.concatenate(held[lang])[1 - longest:]
                for of, parts in held.items():
                    joined = np.concatenate(parts)
                    if len(joined) >= longest:
                        yield _folded(of, joined, words, longest)
                held.clear()
                if len(numbers) > _WORDS:
                    begin()
                    open_ = np.fromiter((numbers[words[k]] for k in open_.tolist()), np.int64, len(open_))
                held[lang].append(open_)
                size = len(open_)
        held[lang].append(ahead)
        size += len(ahead)
    words = list(numbers)
    for of, parts in held.items():
        yield _folded(of, np.concatenate(parts), words, longest)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | None]]:
    for batch in batches:
        for row in range(len(batch)):
            yield batch.column(0)[row].as_py(), batch.column(1)[row].as_py()


def prefix_hashes(chunk: Suffixes) -> np.ndarray:
    """A 64-bit hash of the language and the first 1, 2, ... words of every suffix."""
    of = np.array([xxh3_64_intdigest(w) for w in chunk.words], np.uint64)
    of[0] = 0
    value = np.full(len(chunk.keys), xxh3_64_intdigest(chunk.lang.encode()), np.uint64)
    out = np.empty(chunk.keys.shape, np.uint64)
    for k in range(chunk.keys.shape[1]):
        value = (value ^ value >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + of[chunk.keys[:, k]]
        out[:, k] = value ^ value >> np.uint64(29)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def survey(docs: DataFrame, *, longest: int = LONGEST, parts: int) -> DataFrame:
    """lang, depth, prefix, value: the words of a language (depth 0) and the suffixes below prefixes that may be heavy.

    A prefix above one part in ``parts`` of all suffixes has, in the chunks where it holds a quarter of that or more, three quarters
    of its suffixes at least; only those counts are given. Depth -1 holds the number of all suffixes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in suffix_chunks(_rows(batches), longest):
            hashes, total = prefix_hashes(chunk), len(chunk.keys)
            depth, prefix, value = [0, -1], [0, 0], [int(chunk.weights.sum()), total]
            for k in range(longest - 1):
                found, counts = np.unique(hashes[:, k], return_counts=True)
                many = counts * 4 * parts >= total
                prefix += found[many].view(np.int64).tolist()
                value += counts[many].tolist()
                depth += [k + 1] * int(many.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk.lang] * len(depth)), pa.array(depth, pa.int32()), pa.array(prefix, pa.int64()), pa.array(value, pa.int64())],
                ["lang", "depth", "prefix", "value"],
            )

    return _texts(docs).mapInArrow(run, "lang string, depth int, prefix long, value long").groupBy("lang", "depth", "prefix").agg(
        F.sum("value").alias("value")
    )


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, which compresses better than number by number."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: bytes, count: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, count).T).view("<u4").ravel().astype(np.int64)


def _pack(press: zstandard.ZstdCompressor, chunk: Suffixes, rows: np.ndarray) -> bytes:
    keys = chunk.keys[rows]
    used = np.zeros(len(chunk.words), bool)
    used[keys] = True
    used[0] = True
    own = np.flatnonzero(used)
    renumber = np.zeros(len(chunk.words), np.int32)
    renumber[own] = np.arange(len(own), dtype=np.int32)
    words = b" ".join([chunk.words[k] for k in own[1:].tolist()])
    body = b"".join([_planes(renumber[keys[:, k]]) for k in range(keys.shape[1])] + [_planes(chunk.weights[rows])])
    return struct.pack("<III", len(rows), len(own) - 1, len(words)) + press.compress(words + body)


def _unpack(data: bytes, columns: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    count, _, size = struct.unpack("<III", data[:12])
    body = zstandard.ZstdDecompressor().decompress(data[12:])
    parts = [_numbers(body[size + 4 * count * k:size + 4 * count * (k + 1)], count) for k in range(columns + 1)]
    return body[:size].split(b" ") if size else [], np.stack(parts[:-1], axis=1), parts[-1]


def routed(docs: DataFrame, heavy: list[np.ndarray], *, longest: int = LONGEST, parts: int) -> DataFrame:
    """task, lang, depth, data: blocks of suffixes for ``parts`` tasks; ``depth`` is the number of leading words they are routed by.

    ``heavy`` holds, for each depth, the sorted hashes of the heavy prefixes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for chunk in suffix_chunks(_rows(batches), longest):
            if not len(chunk.keys):
                continue
            hashes = prefix_hashes(chunk)
            depth = np.ones(len(chunk.keys), np.int64)
            for k, hot in enumerate(heavy):
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, hashes[:, k]), len(hot) - 1)
                    depth[(depth == k + 1) & (hot[at] == hashes[:, k])] = k + 2
            task = (hashes[np.arange(len(depth)), depth - 1] >> np.uint64(17)) % np.uint64(parts)
            place = task.astype(np.int64) * (longest + 1) + depth
            order = np.argsort(place, kind="stable")
            edges = np.flatnonzero(np.diff(place[order], prepend=-1))
            groups = np.split(order, edges[1:])
            at = place[order[edges]]
            yield pa.RecordBatch.from_arrays([
                pa.array(at // (longest + 1), pa.int32()), pa.array([chunk.lang] * len(at)), pa.array(at % (longest + 1), pa.int32()),
                pa.array([_pack(press, chunk, rows) for rows in groups], pa.binary()),
            ], ["task", "lang", "depth", "data"])

    return _texts(docs).mapInArrow(run, "task int, lang string, depth int, data binary")


def frequent_prefixes(keys: np.ndarray, weights: np.ndarray, least: int, whole: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Multikey three-way quicksort of pointers to the rows of ``keys``: (pointers, depth, weights) of equal parts, round by round.

    Each round splits all open parts at once by a pivot of their own at the column their depth names. An equal part, given as one
    of its pointers, goes on with the next column. A part whose weight is below ``least`` is abandoned, unless it still is at one
    of the first ``whole - 1`` columns, whose counts are not whole here. Number 0 ends a row and equals nothing.
    """
    columns = keys.shape[1]
    pointers = np.arange(len(keys))
    starts, depths = np.zeros(min(1, len(keys)), np.int64), np.zeros(min(1, len(keys)), np.int64)
    while len(starts):
        sizes = np.diff(np.append(starts, len(pointers)))
        part = np.repeat(np.arange(len(starts)), sizes)
        probes = np.stack([starts, starts + sizes // 2, starts + sizes - 1])
        pivots = np.sort(keys[pointers[probes], depths], axis=0)[1]
        values = keys[pointers, depths[part]]
        side = (values > pivots[part]).astype(np.int64) - (values < pivots[part]) + 1
        # Every pointer moves to: its part's start, behind the lesser sides, at its turn within its own side.
        moved, bounds = np.empty_like(pointers), np.empty((len(starts), 3), np.int64)
        offset = starts.copy()
        for k in range(3):
            member = side == k
            upto = np.cumsum(member)
            before = np.where(starts > 0, upto[starts - 1], 0)
            count = upto[starts + sizes - 1] - before
            mine = np.flatnonzero(member)
            moved[offset[part[mine]] + upto[mine] - 1 - before[part[mine]]] = pointers[mine]
            bounds[:, k] = offset
            offset = offset + count
        new_starts = bounds.ravel()
        new_sizes = np.diff(np.append(new_starts, len(moved)))
        new_depths = np.repeat(depths, 3)
        equal = np.tile([False, True, False], len(starts))
        ended = equal & (np.repeat(pivots, 3) == 0)
        sums = np.concatenate([[0], np.cumsum(weights[moved])])
        weight = sums[new_starts + new_sizes] - sums[new_starts]
        kept = (new_sizes > 0) & ~ended & ((weight >= least) | (new_depths + 1 < whole))
        for depth in range(columns):
            found = np.flatnonzero(kept & equal & (new_depths == depth))
            if len(found):
                yield moved[new_starts[found]], depth + 1, weight[found]
        new_depths = new_depths + equal
        kept &= new_depths < columns
        lengths = new_sizes[kept]
        mask = np.repeat(kept, new_sizes)
        pointers, depths = moved[mask], new_depths[kept]
        starts = np.cumsum(lengths) - lengths


def _counted(least: int, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of one task, ordered by language and depth -> lang, phrase, words, count."""

    def count(lang: str, depth: int, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = lambda: len(numbers) + 1
        keys, weights = [], []
        for block in blocks:
            words, rows, weight = _unpack(block, longest)
            mine = np.fromiter((numbers[w] for w in words), np.int32, len(words))
            keys.append(np.concatenate([np.zeros(1, np.int32), mine])[rows])
            weights.append(weight)
        blocks.clear()
        keys, weights, words = np.concatenate(keys), np.concatenate(weights), [b"", *numbers]
        for found, size, counts in frequent_prefixes(keys, weights, least, depth):
            phrases = [b" ".join([words[k] for k in row]).decode() for row in keys[found, :size].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(phrases)), pa.array(phrases), pa.array([size] * len(phrases), pa.int32()), pa.array(counts, pa.int64())],
                ["lang", "phrase", "words", "a"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            for lang, depth, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (lang, depth) != now:
                    if blocks:
                        yield from count(*now, blocks)
                    now = (lang, depth)
                blocks.append(data)
        if blocks:
            yield from count(*now, blocks)

    return run


def frequent_phrases(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases of up to ``longest`` words that occur ``least`` times, and (lang, n): its words.

    The driver holds the hashes of the heavy prefixes: at most ``FINE / 0.75`` of a depth for each shuffle partition.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut_lineage(survey(docs, longest=longest, parts=FINE * tasks))
    total = found.where("depth = -1").agg(F.sum("value")).first()[0] or 0
    hot = found.where((F.col("depth") > 0) & (F.col("value") * 4 * FINE * tasks >= 3 * total)).select("depth", "prefix").collect()
    heavy = [np.sort(np.array([r.prefix for r in hot if r.depth == k], np.int64).view(np.uint64)) for k in range(1, longest)]
    blocks = routed(docs, heavy, longest=longest, parts=tasks).repartitionById(tasks, F.col("task"))
    counts = blocks.sortWithinPartitions("lang", "depth").select("lang", "depth", "data").mapInArrow(
        _counted(least, longest), "lang string, phrase string, words int, a long"
    )
    phrases = counts.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return cut_lineage(phrases), found.where("depth = 0").select("lang", F.col("value").alias("n"))


def _part(start: str, size: str) -> F.Column:
    return F.array_join(F.slice("w", F.expr(start), F.expr(size)), " ")


def collocations(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two words or more of every language, whole texts counted.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut, ``n`` all words of the language; the score is
    ``SCALE * a`` over ``l + r``, rounded down, in exact decimals. Phrases that mostly occur inside a longer one go. Only A-Z are
    lower-cased; punctuation and line ends break phrases, blanks and tabs part words. NULL texts are empty, a NULL lang counts as
    ``und`` together with that value; ties are settled by count, then by the bytes of the phrase. Repeated rows count again, and
    ids are not read, nor are other columns. Without frequent phrases (or rows) the result is empty.
    """
    known, totals = frequent_phrases(docs, least=least, longest=longest)
    candidates = known.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "cut", _part("1", "cut").alias("left"), _part("cut + 1", "words - cut").alias("right")
    )
    of = lambda side, count: known.select("lang", F.col("phrase").alias(side), F.col("a").alias(count))
    exact = f"CAST({SCALE} AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0)) DIV CAST(l + r AS DECIMAL(20, 0))"
    scored = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).withColumn("score", F.expr(exact))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    sizes = F.explode(F.sequence(F.lit(2), F.col("words") - 1))
    inner = candidates.where("words > 2").withColumn("size", sizes).withColumn(
        "at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1))
    ).select("lang", _part("at", "size").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    times, share = COVERED
    kept = best.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * times < F.col("a") * share)
    ).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    first = top_per_group(
        kept, by=["lang"], order=[F.desc("score"), F.desc("a"), F.asc("phrase")], limit=top, rank="rank", salt_on="phrase"
    )
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
