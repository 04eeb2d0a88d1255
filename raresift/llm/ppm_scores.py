"""Language-model scores by prediction by partial matching over bytes, trained on the corpus itself.

A symbol is predicted by the longest context of up to ``ORDER`` bytes that training has seen: with probability (c - E) / T, if it
came c times among the T there, E being ``ESCAPE``. If the context has not seen it, an escape of probability E * q / T (q distinct
symbols) leads to the context that is a byte shorter, where the symbols of the longer one are excluded. Below the empty context
all unseen bytes are equally likely. The longest contexts count occurrences; a shorter one counts, for each symbol, the contexts a
byte longer that have seen it, as only those would escape to it (update exclusion). The symbols of a context are among those of
each shorter one, so what is excluded at a context is known from its longer neighbour alone.

The trie of contexts grows with the corpus and is never in one place. Texts lie in blocks; a block asks for its distinct runs
of ``ORDER`` + 1 bytes (context and symbol), with how often training has them. Requests are routed by the last two bytes of the
context, the trie's branches, so that a task holds all longer contexts of its branches, merges what all blocks have counted,
and answers with probabilities. Only the two shortest orders, at most 65,536 counts, are sent to all. Word counts for the base score
are asked for in the same way.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from raresift.session import cut_lineage

ORDER = 5  # bytes of the longest context
ESCAPE = 0.3  # what each distinct symbol of a context gives to the escape
BLOCK_BYTES = 3 << 23  # folded text of a block, about
_PART = 1 << 20  # symbols that are handled at a time
_END = b"\n"  # begins and ends a text; folded texts hold no other white space than single blanks
_LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b" " * 5)
_RUNS, _WORDS, _LOW, _COUNTS, _DISTINCT = range(5)  # kinds of rows between tasks
SMOOTH = 0.1  # of the base score


def folded(text: bytes | None) -> bytes:
    """A-Z lower-cased, words parted by one blank."""
    data = (text or b"").translate(_LOWER)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data.strip(b" ")


def runs_of(texts: Iterable[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, context and symbol as one number) of every symbol, a bounded number of symbols at a time."""
    parts, numbers, lengths, size = [], [], [], 0

    def cut() -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(parts), np.uint8)
        owner = np.repeat(np.array(numbers), np.array(lengths))[ORDER:]
        run = np.zeros(len(data) - ORDER, np.int64)
        for k in range(ORDER + 1):
            run = run << 8 | data[k:len(data) - ORDER + k]
        return owner[owner >= 0], run[owner >= 0]

    for number, text in texts:
        before = _END * ORDER
        for at in range(0, len(text) + 1, _PART):
            part = text[at:at + _PART]
            if at + _PART > len(text):
                part += _END
            parts += [before, part]
            numbers += [-1, number]
            lengths += [ORDER, len(part)]
            size += len(part)
            before = (before + part)[-ORDER:]
            if size >= _PART:
                yield cut()
                parts, numbers, lengths, size = [], [], [], 0
    if size:
        yield cut()


def summed(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, with the sums of their weights."""
    if not len(values):
        return values, weights
    order = np.argsort(values)
    values = values[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[starts], np.add.reduceat(weights[order], starts)


def log_probabilities(runs: np.ndarray, counts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """log10 of the probability of every run's last byte after its other bytes.

    ``runs`` are distinct and ascending, whole branches of the trie; ``counts`` is how often training has them (0: only asked for);
    ``low[a, b]`` after how many different bytes training has byte a followed by byte b.
    """
    out, open_ = np.zeros(len(runs)), np.ones(len(runs), bool)
    gone_weight = gone_kinds = np.zeros(len(runs), np.int64)  # of the symbols excluded
    longer = None
    single = (low > 0).sum(axis=0)
    for order in range(ORDER, -1, -1):
        if order > 1:
            here = runs & ((1 << 8 * (order + 1)) - 1)
            kinds, where = np.unique(here, return_inverse=True)
            if longer is None:
                count = np.bincount(where, counts, len(kinds)).astype(np.int64)
            else:
                count = np.bincount(np.searchsorted(kinds, longer[0] & ((1 << 8 * (order + 1)) - 1)), longer[1] > 0, len(kinds)).astype(np.int64)
            begins = np.concatenate([[True], np.diff(kinds >> 8) != 0]) if len(kinds) else np.zeros(0, bool)
            context = np.cumsum(begins) - 1
            weight = np.bincount(context, count, int(begins.sum())).astype(np.int64)
            seen = np.bincount(context, count > 0, int(begins.sum())).astype(np.int64)
            mine, weight_of, seen_of = count[where], weight[context[where]], seen[context[where]]
            of = lambda run: count[np.searchsorted(kinds, run & ((1 << 8 * (order + 1)) - 1))]  # noqa: B023, E731
        elif order == 1:
            byte, after = runs >> 8 & 255, runs & 255
            mine, weight_of, seen_of = low[byte, after], low.sum(axis=1)[byte], (low > 0).sum(axis=1)[byte]
            of = lambda run: low[run >> 8 & 255, run & 255]
        else:
            mine = single[runs & 255]
            weight_of, seen_of = np.full(len(runs), single.sum()), np.full(len(runs), (single > 0).sum())
            of = lambda run: single[run & 255]
        if longer is not None:  # what the symbols of the longer context weigh here
            runs_there, counts_there, context_there, where_there, seen_there = longer
            inside = np.where(counts_there > 0, of(runs_there), 0)
            gone_weight = np.bincount(context_there, inside, len(seen_there)).astype(np.int64)[where_there]
            gone_kinds = seen_there[where_there]
        weight_left, kinds_left = weight_of - gone_weight, seen_of - gone_kinds
        total = np.maximum(weight_left, 1)
        found = open_ & (mine > 0)
        out[found] += np.log10((mine[found] - ESCAPE) / total[found])
        open_ &= ~found
        escapes = open_ & (kinds_left > 0)
        out[escapes] += np.log10(ESCAPE * kinds_left[escapes] / total[escapes])
        if order > 1:
            longer = kinds, count, context, context[where], seen
        elif order == 1:
            byte, after = np.divmod(np.arange(65536), 256)
            longer = np.arange(65536), low.ravel(), byte, runs >> 8 & 255, (low > 0).sum(axis=1)
    out[open_] -= np.log10(256 - np.count_nonzero(single))
    return out


def _packed(values: np.ndarray, width: int) -> bytes:
    """Whole numbers (or the bits of floats) of ``width`` bytes, byte plane by byte plane."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return wide.view(np.int64).ravel()


def _task(values: np.ndarray, tasks: int) -> np.ndarray:
    """The task of a run, by the last two bytes of its context."""
    branch = (values >> 8 & 0xFFFF).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((branch >> np.uint64(32)) % np.uint64(tasks)).astype(np.int64)


_ASKED = "block long, task long, kind int, value long, data binary"


def _rows_to_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "task", "kind", "value", "data"])


def _requests(block: int, units: list[tuple[int, bytes]], tasks: int) -> list[tuple]:
    """What a block asks for: runs and words with their counts in training, for each task; and its small counts."""
    press, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    learned = np.array([learn for learn, _ in units], np.int64)
    runs, counts = [], []
    for owner, run in runs_of((k, unpack.decompress(data)) for k, (_, data) in enumerate(units)):
        run, count = summed(run, learned[owner])
        runs.append(run)
        counts.append(count)
        if len(runs) == 8:  # what is held stays near the number of different runs
            run, count = summed(np.concatenate(runs), np.concatenate(counts))
            runs, counts = [run], [count]
    runs, counts = summed(np.concatenate(runs), np.concatenate(counts))
    words, asked = Counter(), set()
    for learn, data in units:
        own = unpack.decompress(data).split(b" ")
        if learn == 1:
            words.update(own)
        elif learn:
            for word, n in Counter(own).items():
                words[word] += n * learn
        else:
            asked.update(own)
    for word in asked:
        words[word] += 0
    words.pop(b"", None)  # of an empty text
    out = []
    task = _task(runs, tasks)
    order = np.argsort(task, kind="stable")
    edges = np.searchsorted(task[order], np.arange(tasks + 1))
    for k in range(tasks):
        if edges[k] < edges[k + 1]:
            mine = order[edges[k]:edges[k + 1]]
            steps = np.diff(runs[mine], prepend=0)
            out.append((block, k, _RUNS, len(mine), press.compress(_packed(steps, ORDER + 1) + _packed(counts[mine], 8))))
    dealt = defaultdict(list)
    for word in sorted(words):
        dealt[xxh3_64_intdigest(word) % tasks].append(word)
    for k, own in dealt.items():
        numbers = np.array([words[w] for w in own], np.int64)
        out.append((block, k, _WORDS, len(own), press.compress(_packed(numbers, 8) + b" ".join(own))))
    out += [(block, three, _LOW, 1, None) for three in np.unique(runs[counts > 0] & 0xFFFFFF).tolist()]
    ends = int(learned.sum())
    return [*out, (block, 0, _COUNTS, sum(words.values()), None), (block, 1, _COUNTS, ends, None)]


def _asked(units: DataFrame, tasks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for block, learn, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if block != now and held:
                    yield _rows_to_batch(_requests(now, held, tasks))
                    held = []
                now = block
                held.append((learn, data))
        if held:
            yield _rows_to_batch(_requests(now, held, tasks))

    dealt = units.repartitionById(tasks, (F.col("block") % tasks).cast("int")).sortWithinPartitions("block")
    return dealt.select("block", "learn", "packed").mapInArrow(run, _ASKED)


def _answered(asked: DataFrame, low: np.ndarray, tasks: int) -> DataFrame:
    """The requests with their answers: (runs, log10 probabilities) and (words, counts), and the number of distinct learned words."""

    def answers(kind: int, rows: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
        press, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        wanted = [unpack.decompress(data) for *_, data in rows]
        if kind == _RUNS:
            parts = [np.cumsum(_numbers(data[:n * (ORDER + 1)], ORDER + 1)) for (_, n, _), data in zip(rows, wanted, strict=True)]
            counts = [_numbers(data[n * (ORDER + 1):], 8) for (_, n, _), data in zip(rows, wanted, strict=True)]
            runs, sums = summed(np.concatenate(parts), np.concatenate(counts))
            found = log_probabilities(runs, sums, low)
            for (block, n, _), data, own in zip(rows, wanted, parts, strict=True):
                logs = found[np.searchsorted(runs, own)]
                yield block, 0, kind, n, press.compress(data[:n * (ORDER + 1)] + _packed(logs, 8))
            return
        total: Counter[bytes] = Counter()
        for (_, n, _), data in zip(rows, wanted, strict=True):
            for word, count in zip(data[8 * n:].split(b" "), _numbers(data[:8 * n], 8).tolist(), strict=True):
                total[word] += count
        for (block, n, _), data in zip(rows, wanted, strict=True):
            own = data[8 * n:]
            yield block, 0, kind, n, press.compress(_packed(np.array([total[w] for w in own.split(b" ")], np.int64), 8) + own)
        yield -1, 0, _DISTINCT, sum(n > 0 for n in total.values()), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for kind, block, n, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if kind != now and held:
                    for row in answers(now, held):
                        yield _rows_to_batch([row])
                    held = []
                now = kind
                held.append((block, n, data))
        if held:
            for row in answers(now, held):
                yield _rows_to_batch([row])

    dealt = asked.where(F.col("kind").isin(_RUNS, _WORDS)).repartitionById(tasks, F.col("task").cast("int"))
    return dealt.sortWithinPartitions("kind").select("kind", "block", "value", "data").mapInArrow(run, _ASKED)


_SCORED = [("one", pa.int64()), ("two", pa.int64()), ("n_words", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]


def _scored(units: pa.Table, answers: pa.Table) -> pa.Table:
    """The texts of a block: their words, how many are known, the sum of their log10 counts, and the model's log10 probability."""
    unpack = zstandard.ZstdDecompressor()
    runs, logs, words, counts = [], [], [], []
    for kind, n, data in zip(*(answers.column(c).to_pylist() for c in ("kind", "value", "data")), strict=True):
        data = unpack.decompress(data)
        if kind == _RUNS:
            runs.append(np.cumsum(_numbers(data[:n * (ORDER + 1)], ORDER + 1)))
            logs.append(_numbers(data[n * (ORDER + 1):], 8).view(np.float64))
        else:
            words += data[8 * n:].split(b" ")
            counts.append(_numbers(data[:8 * n], 8))
    packed = units.column("packed").to_pylist()
    if not packed:
        return pa.table({name: pa.array([], kind) for name, kind in _SCORED})
    runs, logs = np.concatenate(runs), np.concatenate(logs)
    order = np.argsort(runs)
    runs, logs = runs[order], logs[order]
    score = np.zeros(len(packed))
    for owner, run in runs_of((k, unpack.decompress(data)) for k, data in enumerate(packed)):
        order = np.argsort(run)
        run = run[order]
        starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        each = np.repeat(logs[np.searchsorted(runs, run[starts])], np.diff(np.append(starts, len(run))))
        score += np.bincount(owner[order], each, len(packed))
    number = {word: k for k, word in enumerate(words)}
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    values = np.log10(count + SMOOTH)
    size, known, base = np.zeros(len(packed), np.int64), np.zeros(len(packed), np.int64), np.zeros(len(packed))
    for k, data in enumerate(packed):
        if text := unpack.decompress(data):
            own = text.split(b" ")
            ids = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
            size[k], known[k], base[k] = len(ids), np.count_nonzero(count[ids]), values[ids].sum()
    columns = [units.column("one").combine_chunks(), units.column("two").combine_chunks(), *map(pa.array, (size, known, base, score))]
    return pa.table(dict(zip([name for name, _ in _SCORED], columns, strict=True)))


def folded_texts(docs: DataFrame) -> DataFrame:
    """one, two (a 128-bit hash of the text), learn, size, packed: every distinct text once, compressed, with its rows to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = [folded(t.as_py()) for t in part.column(3)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(3)), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([press.compress(t) for t in texts], pa.binary())],
                    ["one", "two", "learn", "size", "packed"],
                )

    rows = docs.select("one", "two", F.when(F.col("held_out"), 0).otherwise(1).cast("long").alias("learn"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "one long, two long, learn long, size long, packed binary").groupBy("one", "two").agg(
        F.sum("learn").alias("learn"), F.max("size").alias("size"), F.min("packed").alias("packed")
    )


def ppm_scores(docs: DataFrame, *, held_out: F.Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, learned from the rows not held out.

    A text is its words (A-Z lower-cased, whatever white space lies between) and an end. ``score`` is the model's log10 probability
    of the words with single blanks between and the end; ``base_score`` the one of smoothed word counts. NULL and empty texts are
    the end alone. Rows with one text are scored once, and counted as often as they are learned from. Rows where ``held_out`` is
    NULL are learned from. Without rows to learn from all bytes are equally likely. Columns other than doc_id and text (and those
    of ``held_out``) are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.xxhash64(text).alias("one"), F.xxhash64(F.lit(11), text).alias("two"), F.col("text"),
    )
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = cut_lineage(folded_texts(rows))
    blocks = -(-(texts.agg(F.sum("size")).first()[0] or 0) // block_bytes) or 1
    units = texts.withColumn("block", F.pmod(F.col("one"), F.lit(blocks)))
    asked = cut_lineage(_asked(units, tasks))
    low = np.zeros((256, 256), np.int64)
    threes = asked.where(F.col("kind") == _LOW).select("task").distinct()
    for r in threes.groupBy((F.col("task") % 65536).alias("pair")).agg(F.count(F.lit(1)).alias("n")).collect():
        low[r.pair >> 8, r.pair & 255] = r.n
    sums = {r.task: r.n for r in asked.where(F.col("kind") == _COUNTS).groupBy("task").agg(F.sum("value").alias("n")).collect()}
    ends, tokens = sums.get(1, 0), sums.get(0, 0) + sums.get(1, 0)
    answered = cut_lineage(_answered(asked, low, tasks))
    distinct = (answered.where(F.col("kind") == _DISTINCT).agg(F.sum("value")).first()[0] or 0) + (ends > 0)
    wanted = answered.where(F.col("kind") != _DISTINCT).select("block", "kind", "value", "data")
    schema = ", ".join(f"{name} {'double' if pa.types.is_floating(kind) else 'long'}" for name, kind in _SCORED)
    scored = units.select("block", "one", "two", "packed").groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_scored, schema)
    total = float(np.log10(tokens + SMOOTH * (distinct + 1)))
    out = rows.select("doc_id", "held_out", "one", "two").join(scored, ["one", "two"])
    return out.select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(ends + SMOOTH)) - (F.col("n_words") + 1) * total).alias("base_score"), "score",
    )


def score_report(docs: DataFrame) -> DataFrame:
    """Scores of all documents by those whose crc32(doc_id as text) mod 10 is not 0; a NULL id has no checksum and is learned from.

    Otherwise as ``ppm_scores``.
    """
    return ppm_scores(docs, held_out=F.crc32(F.encode(F.col("doc_id").cast("long").cast("string"), "UTF-8")) % 10 == 0)
