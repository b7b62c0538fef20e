"""Language identification by a byte convolutional network.

Filters of several widths run over one-hot bytes, each filter's output is
max-pooled over a fixed-length window, and a softmax layer reads the pooled
values.  Training is plain numpy on a bounded sample of labelled texts;
inference runs over every window of every text in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shipcast.llm.common import ship_package

WINDOW = 256
WIDTHS = (2, 3, 4)
#: ASCII capitals are read as small letters
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: windows handled at once
CHUNK = 128
#: values of the hash that draws the sample
HASHES = 1 << 30
#: text bytes cut into windows at once, in whole windows
CHUNK_BYTES = 2048 * WINDOW


@dataclass
class ByteConvNet:
    labels: list[str]
    taps: list[np.ndarray]  # per width: (width, 256, filters)
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray

    def compiled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables over byte pairs: with one-hot input a convolution is a sum of
        table rows, and two neighbouring taps make one row."""
        w2, w3, w4 = self.taps
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        first = np.concatenate([pair(w2[0], w2[1]), pair(w3[0], w3[1]), pair(w4[0], w4[1])], 1)
        nothing = np.zeros_like(w3[2])
        second = np.concatenate([pair(w3[2], nothing), pair(w4[2], w4[3])], 1)
        return first.astype(np.float32), second.astype(np.float32), self.bias.astype(np.float32)

    def probabilities(self, windows: np.ndarray, tables: tuple | None = None) -> np.ndarray:
        """(n, WINDOW) folded bytes -> (n, labels)."""
        first, second, bias = tables or self.compiled()
        n2 = self.taps[0].shape[2]
        out = np.empty((len(windows), len(self.labels)), np.float64)
        for at in range(0, len(windows), CHUNK):
            x = windows[at : at + CHUNK].astype(np.int32)
            pairs = x[:, :-1] * 256 + x[:, 1:]
            conv = first[pairs[:, :-2]]
            conv[:, :, n2:] += second[pairs[:, 2:]]
            hidden = np.maximum(conv.max(axis=1) + bias, 0)
            z = hidden @ self.weight + self.offset
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + CHUNK] = z / z.sum(axis=1, keepdims=True)
        return out


def text_windows(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length windows that tile every text (zero padded), and the text of each.

    A last window that would be short is moved back to end with its text.
    """
    lengths = stops - starts
    counts = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(starts)), counts)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = starts[owner] + np.minimum(k * WINDOW, np.maximum(lengths[owner] - WINDOW, 0))
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < stops[owner][:, None]
    return np.where(inside, FOLD[data[np.minimum(at, max(len(data) - 1, 0))]], 0), owner


def window_chunks(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``text_windows`` of about ``CHUNK_BYTES`` at a time: several short texts,
    or a stretch of a long one (whose stretches end with a whole window)."""
    at = 0
    while at < len(starts):
        to = at + max(1, int(np.searchsorted(np.cumsum(stops[at:] - starts[at:]), CHUNK_BYTES, "right")))
        if to - at > 1 or stops[at] - starts[at] <= CHUNK_BYTES:
            windows, owner = text_windows(data, starts[at:to], stops[at:to])
            yield windows, owner + at
        else:
            cuts = np.append(np.arange(starts[at], stops[at], CHUNK_BYTES), stops[at])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a < WINDOW:  # the last window moves back, as in a text of its own
                    a = b - WINDOW
                windows, owner = text_windows(data, np.array([a]), np.array([b]))
                yield windows, owner + at
        at = to


def train(windows: np.ndarray, target: np.ndarray, labels: list[str], filters: int = 12, epochs: int = 12) -> ByteConvNet:
    """Adam on cross-entropy; a max-pooled filter passes its gradient to the
    one place it came from, so a step updates few table rows."""
    rng = np.random.default_rng(11)
    k, total = len(labels), filters * len(WIDTHS)
    params = [rng.normal(0, 0.1, (w, 256, filters)) for w in WIDTHS]
    params += [np.zeros(total), rng.normal(0, 0.1, (total, k)), np.zeros(k)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for at in range(0, len(order), 128):
            pick = order[at : at + 128]
            x, y = windows[pick].astype(np.int64), target[pick]
            length, rows = WINDOW - max(WIDTHS) + 1, np.arange(len(pick))
            pooled, place = [], []
            for w, table in zip(WIDTHS, params):
                conv = sum(table[t][x[:, t : t + length]] for t in range(w))
                arg = conv.argmax(axis=1)
                place.append(arg)
                pooled.append(np.take_along_axis(conv, arg[:, None, :], 1)[:, 0])
            pre = np.concatenate(pooled, 1) + params[3]
            hidden = np.maximum(pre, 0)
            z = hidden @ params[4] + params[5]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[rows, y] -= 1
            p /= len(pick)
            back = (p @ params[4].T) * (pre > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(params[i])
                part = back[:, i * filters : (i + 1) * filters]
                col = np.broadcast_to(np.arange(filters), part.shape)
                for t in range(w):
                    np.add.at(g[t], (np.take_along_axis(x, place[i] + t, 1), col), part)
                grads.append(g)
            grads += [back.sum(0), hidden.T @ p + 1e-4 * params[4], p.sum(0)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return ByteConvNet(labels, params[:3], params[3], params[4], params[5])


def fit_language_model(labelled: DataFrame, rows_per_label: int = 1000, max_bytes: int = 4096) -> ByteConvNet | None:
    """Train on ``doc_id, text, lang`` rows with a non-null label and text.

    The sample is bounded by ``rows_per_label`` documents of every label, by
    hash, and ``max_bytes`` of each (a fit bound only; predictions read whole
    texts), so a rare label is learned as soon as it occurs.  None without labels.
    """
    usable = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull())
    usable = usable.select("doc_id", "lang", "text", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(HASHES)).alias("h"))
    # of a frequent label only a share reaches the ranking: three times what is wanted, or its first hash
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).collect()  # one row a label
    if not counts:
        return None
    share = {r["lang"]: max(r["least"] + 1, int(min(1.0, 3 * rows_per_label / r["n"]) * HASHES)) for r in counts}
    below = F.create_map(*[F.lit(x) for pair in sorted(share.items()) for x in pair])
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "key")
    chosen = (
        usable.where(F.col("h") < F.element_at(below, F.col("lang")))
        .select("doc_id", "lang", "h", F.xxhash64("text").alias("key"))
        .withColumn("r", F.row_number().over(first))
        .where(F.col("r") <= rows_per_label)
    )
    rows = (
        usable.select("doc_id", "lang", F.xxhash64("text").alias("key"), F.substring("text", 1, max_bytes).alias("text"))
        .join(F.broadcast(chosen.select("doc_id", "lang", "key").distinct()), ["doc_id", "lang", "key"], "left_semi")  # rows_per_label a label
        .dropDuplicates(["doc_id", "lang", "key"])
        .select("doc_id", "lang", "text")
        .collect()
    )
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.lang, r.text))
    labels = sorted({r.lang for r in rows})
    raw = [r.text.encode("utf-8", "replace") for r in rows]
    stops = np.cumsum([len(b) for b in raw])
    starts = stops - [len(b) for b in raw]
    windows, owner = text_windows(np.frombuffer(b"".join(raw), np.uint8), starts, stops)
    rng = np.random.default_rng(5)
    keep = np.sort(rng.permutation(len(windows))[: 2 * max(4000, rows_per_label * len(labels))])
    target = np.array([labels.index(r.lang) for r in rows])[owner[keep]]
    windows = windows[keep]
    # short texts are as important as long ones: half of the rows are cut short
    cut = rng.integers(24, WINDOW, len(windows))
    cut[rng.random(len(windows)) < 0.5] = WINDOW
    windows = np.where(np.arange(WINDOW) < cut[:, None], windows, 0)
    return train(windows, target, labels)


def identify_language(docs: DataFrame, model: ByteConvNet | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``doc_id, text``.

    Every window of the whole text is read; the score is the mean probability
    of the predicted label.  Text that is null or has no letter is ``und``
    with score 0, as is everything if there is no model.  Equal probabilities
    go to the label that sorts first.  Repeated rows each get a row.
    """

    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.compiled() if model else None
        for whole in batches:
            at = 0
            while at < whole.num_rows:  # slices of bounded text volume
                batch = whole.slice(at, 256)
                at += 256
                texts = batch.column(1)
                raw = [(t or "").encode("utf-8", "replace") for t in texts.to_pylist()]
                plain = [any(map(str.isalpha, t or "")) for t in texts.to_pylist()]
                stops = np.cumsum([len(b) for b in raw])
                starts = stops - [len(b) for b in raw]
                label, score = np.array(["und"] * len(raw), object), np.zeros(len(raw))
                live = np.flatnonzero(plain)
                if model and len(live):
                    data = np.frombuffer(b"".join(raw), np.uint8)
                    mean, count = np.zeros((len(live), len(model.labels))), np.zeros(len(live))
                    for windows, owner in window_chunks(data, starts[live], stops[live]):
                        np.add.at(mean, owner, model.probabilities(windows, tables))
                        count += np.bincount(owner, minlength=len(live))
                    mean /= count[:, None]
                    best = mean.argmax(1)
                    label[live] = np.array(model.labels, object)[best]
                    score[live] = mean[np.arange(len(live)), best]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(label, pa.string()), pa.array(np.clip(score, 0, 1))],
                    ["doc_id", "lang_pred", "score"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )
