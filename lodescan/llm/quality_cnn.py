"""Byte-level convolutional quality classifier in numpy.

Filters of five bytes run over the whole document. A learned filter is a table of 256 rows per
byte of its width, so a convolution is five look-ups and a sum. Blocks of 256 bytes are
max-pooled; a chunk is two neighbouring blocks, so chunks overlap by half and cover every
byte. A hidden layer reads each chunk's pooled filters, is max-pooled over the chunks, and a
logistic unit combines that with the mean over the chunks into one probability.

The model is trained on a bounded sample of labelled rows (``SAMPLE_ROWS`` rows and
``SAMPLE_BYTES`` bytes, whole texts of at most ``LONGEST`` bytes, chosen by a hash of the id),
held-out rows excepted.
Label, language, source and id are never inputs of the score.

Rows: a null or empty text is scored as one block of zero bytes. Ids may be null (then not
held out, never trained on) or repeat. A table without labels gives the score 1 throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

WIDTH = 5
FILTERS = 16
HIDDEN = 12
BLOCK = 256
SAMPLE_ROWS = 3_000
SAMPLE_BYTES = 12 << 20
# longer texts are scored, not trained on
LONGEST = 256 << 10
EPOCHS = 16
# a rejected label weighs so many accepted ones in training: they are the rarer
REJECTED_WEIGHT = 2.0
SEED = 7
THRESHOLD = 0.3
HELD_OUT_OF = 5
# blocks convolved at a time: 1 MB of filter outputs
TILE = 64


@dataclass
class Model:
    tables: np.ndarray  # width, 256, filters
    inner: np.ndarray  # filters, hidden
    inner_bias: np.ndarray
    outer: np.ndarray  # two times hidden
    outer_bias: float


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, the first block of each text, and where the texts' blocks lie.

    A text is padded with zeros to whole blocks, one filter width at least, and an empty
    block follows it that is not its own, so that no window reaches the next text.
    """
    blocks = np.array([-(-(len(t) + WIDTH - 1) // BLOCK) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(blocks)])
    laid = starts + np.arange(len(starts))
    data = np.zeros(laid[-1] * BLOCK + WIDTH, np.uint8)
    for text, at in zip(texts, laid[:-1] * BLOCK, strict=True):
        data[at:at + len(text)] = np.frombuffer(text, np.uint8)
    own = np.arange(starts[-1]) + np.repeat(np.arange(len(texts)), blocks)
    return data, starts, own


def _convolved(tables: np.ndarray, data: np.ndarray, first: int, last: int) -> np.ndarray:
    """Filter outputs of the blocks from first to last: blocks, places, filters."""
    begin, size = first * BLOCK, (last - first) * BLOCK
    out = tables[0].take(data[begin:begin + size], axis=0)
    for k in range(1, WIDTH):
        out += tables[k].take(data[begin + k:begin + k + size], axis=0)
    return out.reshape(last - first, BLOCK, -1)


def _block_maxima(tables: np.ndarray, data: np.ndarray, n_blocks: int) -> np.ndarray:
    out = np.empty((n_blocks, tables.shape[2]), np.float32)
    for first in range(0, n_blocks, TILE):
        last = min(first + TILE, n_blocks)
        out[first:last] = _convolved(tables, data, first, last).max(axis=1)
    return out


def _chunk_pairs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of every chunk (left, right), and the first chunk of each text."""
    n = np.diff(starts)
    chunks = np.maximum(n - 1, 1)
    first = np.concatenate([[0], np.cumsum(chunks)])
    inside = np.arange(first[-1]) - np.repeat(first[:-1], chunks)
    left = np.repeat(starts[:-1], chunks) + inside
    right = np.minimum(left + 1, np.repeat(starts[1:], chunks) - 1)
    return left, right, first


def _head(model: Model, maxima: np.ndarray, starts: np.ndarray):
    left, right, first = _chunk_pairs(starts)
    pooled = np.maximum(maxima[left], maxima[right])
    hidden = np.maximum(pooled @ model.inner + model.inner_bias, 0)
    counts = np.diff(first)[:, None]
    top = np.maximum.reduceat(hidden, first[:-1], axis=0)
    mean = np.add.reduceat(hidden, first[:-1], axis=0) / counts
    logits = np.concatenate([top, mean], axis=1) @ model.outer + model.outer_bias
    return left, right, first, pooled, hidden, top, mean, logits


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    data, starts, own = _laid_out(texts)
    maxima = _block_maxima(model.tables, data, len(data) // BLOCK)[own]
    logits = _head(model, maxima, starts)[-1]
    return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30)))


class _Adam:
    def __init__(self, values: list[np.ndarray], rate: float) -> None:
        self.rate, self.step = rate, 0
        self.first = [np.zeros_like(v) for v in values]
        self.second = [np.zeros_like(v) for v in values]

    def update(self, values: list[np.ndarray], slopes: list[np.ndarray]) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for value, slope, m, v in zip(values, slopes, self.first, self.second, strict=True):
            m *= 0.9
            m += 0.1 * slope
            v *= 0.999
            v += 0.001 * slope * slope
            value -= (scale * m / (np.sqrt(v) + 1e-8)).astype(value.dtype)


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = SEED,
          batch: int = 32) -> Model:
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.4, (256, 6))
    model = Model(
        np.stack([embedding @ rng.normal(0, 0.4, (6, FILTERS)) for _ in range(WIDTH)])
        .astype(np.float32),
        rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32),
        np.zeros(HIDDEN, np.float32),
        rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32),
        0.0,
    )
    wanted = np.array(labels, np.float32)
    if not len(texts) or wanted.min() == wanted.max():
        share = 1.0 if not len(texts) else float(wanted[0])
        model.outer[:] = 0
        model.outer_bias = 30.0 if share else -30.0
        return model
    bias = np.array([np.log(wanted.mean() / (1 - wanted.mean()))], np.float32)
    values = [model.tables, model.inner, model.inner_bias, model.outer, bias]
    steps = epochs * -(-len(texts) // batch)
    adam = _Adam(values, 0.01)
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            model.outer_bias = float(bias[0])
            adam.rate = 0.01 * (1 - done / steps) + 0.0005
            done += 1
            adam.update(values, _slopes(model, [texts[i] for i in chosen], wanted[chosen]))
    model.outer_bias = float(bias[0])
    return model


def _slopes(model: Model, texts: list[bytes], wanted: np.ndarray) -> list[np.ndarray]:
    """Slopes of the mean log loss; of a pooled maximum only its place has one."""
    data, starts, own = _laid_out(texts)
    n_blocks = len(data) // BLOCK
    maxima = np.empty((n_blocks, FILTERS), np.float32)
    places = np.empty((n_blocks, FILTERS), np.int64)
    for begin in range(0, n_blocks, TILE):
        end = min(begin + TILE, n_blocks)
        out = _convolved(model.tables, data, begin, end)
        at = out.argmax(axis=1)
        maxima[begin:end] = np.take_along_axis(out, at[:, None, :], 1)[:, 0]
        places[begin:end] = at + np.arange(begin, end)[:, None] * BLOCK
    maxima, places = maxima[own], places[own]
    left, right, first, pooled, hidden, top, mean, logits = _head(model, maxima, starts)
    chunks = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), chunks)
    error = ((1 / (1 + np.exp(-np.clip(logits, -30, 30)))) - wanted) / len(texts)
    error *= np.where(wanted > 0, 1, np.float32(REJECTED_WEIGHT))
    outer = np.concatenate([top, mean], axis=1).T @ error
    to_top = error[:, None] * model.outer[:HIDDEN]
    to_mean = error[:, None] * model.outer[HIDDEN:] / chunks[:, None]
    is_top = hidden == top[owner]
    shared = np.add.reduceat(is_top, first[:-1], axis=0)
    to_hidden = (to_mean[owner] + is_top * (to_top / shared)[owner]) * (hidden > 0)
    inner = pooled.T @ to_hidden
    to_pooled = to_hidden @ model.inner.T
    from_left = maxima[left] >= maxima[right]
    to_maxima = np.zeros_like(maxima)
    np.add.at(to_maxima, left, np.where(from_left, to_pooled, 0))
    np.add.at(to_maxima, right, np.where(from_left, 0, to_pooled))
    tables = np.zeros((WIDTH, 256, FILTERS), np.float32)
    filters = np.broadcast_to(np.arange(FILTERS), places.shape)
    for k in range(WIDTH):
        np.add.at(tables[k], (data[places + k], filters), to_maxima)
    return [tables + 1e-6 * model.tables, inner, to_hidden.sum(0), outer,
            np.array([error.sum()], np.float32)]


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_OF


def training_sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES,
) -> tuple[list[bytes], list[int]]:
    """Labelled rows that are not held out, in the order of a hash of their ids.

    At most ``rows`` of them and ``size`` bytes come to the driver. A text over ``LONGEST``
    bytes, or one that no longer fits, is passed over and the next ones are taken. An id with
    several labels counts once, by the least. A sample of no or one label is an error
    if usable rows have another.
    """
    usable = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
        .filter(F.col("label").isNotNull() & (remainder("doc_id") != 0))
        .groupBy("doc_id").agg(F.min("label").alias("label"))
    )
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("content"),
    )
    # ids whose texts are all too long are no candidates
    sized = own.groupBy("doc_id").agg(F.min(F.length("content")).alias("least"))
    chosen = materialize(
        usable.join(sized, "doc_id").filter(F.col("least") <= min(size, LONGEST))
        .orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "label").limit(rows),
        "labelled-ids",
    )
    # at most ``rows`` short rows are sent out; their texts are looked for once
    found = materialize(
        own.filter(F.length("content") <= min(size, LONGEST))
        .join(F.broadcast(chosen), "doc_id"), "labelled-sample",
    )
    taken: list[tuple[bytes, int]] = []
    total = 0
    for row in found.orderBy(F.xxhash64("doc_id"), "doc_id", F.hash("content")).limit(
        rows
    ).toLocalIterator():
        if total + len(row["content"]) <= size:
            total += len(row["content"])
            taken.append((bytes(row["content"]), int(row["label"])))
    have = {label for _, label in taken}
    if len(have) < 2:
        known = {
            int(r["label"]) for r in usable.join(
                own.select("doc_id").distinct(), "doc_id").select("label").distinct().collect()
        }
        if known - have:
            raise ValueError(f"the training sample has no text of the labels {sorted(known - have)}")
    return [t for t, _ in taken], [label for _, label in taken]


def _scores(docs: DataFrame, model: Model, text_col: str, carried: list[str]) -> DataFrame:
    """The carried columns and ``_score``; the text goes to Python once, carried or not."""
    sent = [*carried, *([] if text_col in carried else [text_col])]
    place = sent.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column(place).cast(pa.binary()).fill_null(b"").to_pylist()
                kept = [part.column(n) for n in range(len(carried))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(score_texts(model, texts), pa.float64())],
                    [*carried, "_score"],
                )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, f"{kinds}, `_score` double")


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return _scores(docs, model, text_col, [id_col]).select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(remainder(id_col) == 0, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )


def classified_rows(docs: DataFrame, labels: DataFrame, text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are accepted, with their own columns."""
    model = train(*training_sample(docs, labels, text_col=text_col))
    return _scores(docs, model, text_col, docs.columns) \
        .filter(F.col("_score") >= threshold).drop("_score")


def classify(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """Train on the labelled sample and score every document."""
    return score(docs, train(*training_sample(docs, labels, **names)),
                 **{k: v for k, v in names.items() if k in ("id_col", "text_col")})
