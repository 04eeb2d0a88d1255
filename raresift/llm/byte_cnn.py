"""Language identification by a byte convolutional network, trained in numpy and applied to windows of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from raresift.operators.ranking import top_per_group

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12  # per width
EMBED = 8
PAD = 256
UNDETERMINED = "und"
_REACH = max(WIDTHS)


@dataclass(frozen=True)
class ByteCnn:
    """Embedding, one filter bank of several widths (shorter filters are zero beyond their width), max pooling, softmax."""

    labels: list[str]
    embed: np.ndarray  # (257, EMBED); the row of PAD is zero
    filters: np.ndarray  # (_REACH * EMBED, filters)
    bias: np.ndarray
    dense: np.ndarray  # (filters, labels)
    offset: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(n, WINDOW, _REACH * EMBED): the embedded bytes that each filter position covers."""
        padded = np.pad(windows, ((0, 0), (0, _REACH - 1)), constant_values=PAD)
        flat = np.ascontiguousarray(self.embed[padded].reshape(len(windows), -1))
        step = flat.strides[1] * EMBED
        return np.lib.stride_tricks.as_strided(
            flat, (len(windows), windows.shape[1], _REACH * EMBED), (flat.strides[0], step, flat.strides[1])
        )

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        cols = self.columns(windows)
        maps = cols.reshape(-1, cols.shape[2]) @ self.filters
        maps = maps.reshape(len(windows), windows.shape[1], -1)
        pooled = np.maximum(maps.max(axis=1) + self.bias, 0)
        logits = pooled @ self.dense + self.offset
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return cols, maps, pooled, odds / odds.sum(axis=1, keepdims=True)

    def classify(self, texts: list[str | None], batch: int = 128) -> list[tuple[str, float]]:
        """Label and score of each whole text: probabilities of its windows, averaged by their bytes."""
        totals, sizes = np.zeros((len(texts), max(1, len(self.labels)))), np.zeros(len(texts))
        held, owners, lengths = [], [], []

        def flush() -> None:
            windows = np.stack(held)
            odds = self.forward(windows)[3]
            np.add.at(totals, owners, odds * np.array(lengths)[:, None])
            np.add.at(sizes, owners, lengths)
            held.clear(), owners.clear(), lengths.clear()

        for k, text in enumerate(texts):
            if not self.labels or not text or not any(map(str.isalpha, text)):
                continue
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            for at in range(0, len(data), WINDOW):
                held.append(fit(data[at:at + WINDOW]))
                owners.append(k)
                lengths.append(min(WINDOW, len(data) - at))
                if len(held) == batch:
                    flush()
        if held:
            flush()
        best = totals.argmax(axis=1)
        return [
            (self.labels[b], min(1.0, float(totals[k, b] / sizes[k]))) if sizes[k] else (UNDETERMINED, 0.0)
            for k, b in enumerate(best)
        ]


def fit(data: np.ndarray) -> np.ndarray:
    window = np.full(WINDOW, PAD, np.int64)
    window[: len(data)] = data
    return window


def train(texts: list[str], langs: list[str], *, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> ByteCnn:
    """Adam on windows and random crops of the texts; the same input gives the same model. No texts: a model without labels."""
    labels, rng = sorted(set(langs)), np.random.default_rng(seed)
    n = FILTERS * len(WIDTHS)
    mask = np.zeros((_REACH * EMBED, n), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * EMBED, k * FILTERS:(k + 1) * FILTERS] = 1
    embed = rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)
    embed[PAD] = 0
    net = {
        "embed": embed, "filters": (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), "bias": np.zeros(n, np.float32),
        "dense": rng.normal(0, 0.3, (n, max(1, len(labels)))).astype(np.float32), "offset": np.zeros(max(1, len(labels)), np.float32),
    }
    windows, truth = [], []
    for text, lang in zip(texts, langs, strict=True):
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        at = rng.integers(max(1, len(data) - WINDOW + 1))
        crop = rng.integers(max(1, len(data) - 16))
        windows += [fit(data[at:at + WINDOW]), fit(data[crop:crop + rng.integers(8, WINDOW)])]
        truth += [labels.index(lang)] * 2
    x, y = np.array(windows).reshape(-1, WINDOW), np.array(truth, int)
    share = np.bincount(y, minlength=max(1, len(labels)))
    weight = (len(y) / np.maximum(share, 1) / max(1, len(labels)))[y].astype(np.float32)
    first, second, step = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2)), None, 0
    first, second = first
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at:at + batch]
            step += 1
            model = ByteCnn(labels, **net)
            cols, maps, pooled, odds = model.forward(x[pick])
            error = odds.copy()
            error[np.arange(len(pick)), y[pick]] -= 1
            error *= weight[pick, None] / len(pick)
            through = (error @ net["dense"].T) * (pooled > 0)
            where = maps.argmax(axis=1)  # (batch, filters): only the pooled position of a filter gets a gradient
            seen = cols[np.arange(len(pick))[:, None], where]
            back = (through[:, :, None] * net["filters"].T[None]).reshape(len(pick), n, _REACH, EMBED)
            padded = np.pad(x[pick], ((0, 0), (0, _REACH - 1)), constant_values=PAD)
            bytes_at = padded[np.arange(len(pick))[:, None, None], where[:, :, None] + np.arange(_REACH)]
            grad_embed = np.zeros_like(net["embed"])
            np.add.at(grad_embed, bytes_at.reshape(-1), back.reshape(-1, EMBED))
            grad_embed[PAD] = 0
            grads = {
                "embed": grad_embed, "filters": np.einsum("nf,nfc->cf", through, seen) * mask, "bias": through.sum(axis=0),
                "dense": pooled.T @ error, "offset": error.sum(axis=0),
            }
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                net[k] = (net[k] - move).astype(np.float32)
    return ByteCnn(labels, **net)


def is_held_out(id_col: str = "doc_id") -> Column:
    """True for rows kept from training: crc32 of the id as text, mod 4, is 2. A NULL id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, *, per_language: int = 600, chars: int = 768, labels: int = 256) -> tuple[list[str], list[str]]:
    """Up to ``per_language`` labelled texts of each language outside the held-out rows, at most ``chars`` characters of each.

    This is the documented bound on what the classifier is fitted on, and all that reaches the driver; of more than ``labels``
    languages the most frequent are learned. Different rows of each language are counted over the whole table first, so that a
    hash of id and text lets half as many again through as are wanted, whatever the ids are; those with the lowest hashes are taken.
    Rows that repeat id and text count once.
    """
    usable = docs.where(~is_held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    totals = usable.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text"), 0.02).alias("n")).orderBy(F.desc("n"), F.asc("lang")).limit(labels)
    counts = {r.lang: r.n for r in totals.collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, 1.5 * per_language / max(n, 1)))])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(2)), F.lit(1 << 30))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    near = usable.where(draw < share[F.col("lang")] * (1 << 30)).select(
        "lang", draw.alias("draw"), F.col("text").substr(start, F.lit(chars)).alias("part")
    ).distinct()
    rows = top_per_group(near, by=["lang"], order=[F.asc("draw"), F.asc("part")], limit=per_language, rank="place", salt_on="draw").collect()
    rows.sort(key=lambda r: (r.draw, r.lang, r.part))
    return [r.part for r in rows], [r.lang for r in rows]


def identify(docs: DataFrame, model: ByteCnn, *, text_col: str = "text", label_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Every row with all columns, its predicted label and the probability of that label over the whole text.

    A text that is NULL, empty or without a letter gets ``und`` and 0. Columns already named as an output are replaced.
    Only the text is read, so equal texts get equal answers, whatever the other columns hold.
    """
    kept = [c for c in docs.columns if c.lower() not in (label_out.lower(), score_out.lower())]
    schema = T.StructType([
        *docs.select(*kept).schema.fields, T.StructField(label_out, T.StringType()), T.StructField(score_out, T.DoubleType()),
    ])
    place = [c.lower() for c in kept].index(text_col.lower())

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                answers = model.classify(part.column(place).to_pylist())
                added = [pa.array([a[0] for a in answers], pa.string()), pa.array([a[1] for a in answers], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, label_out, score_out])

    return docs.select(*kept).mapInArrow(predict, schema)


def languages(docs: DataFrame) -> DataFrame:
    """Train on the labelled rows that are not held out and predict every document."""
    model = train(*training_sample(docs))
    return identify(docs.select("doc_id", "text", is_held_out().alias("held_out")), model).drop("text")
