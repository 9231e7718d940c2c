"""Language identification by a small convolutional network over bytes.

A text is cut into windows of fixed length.  Filters of several widths slide over a window's bytes; each
filter keeps its maximum, and a softmax layer turns the maxima into class probabilities.  Bytes are
one-hot, so a filter is a table of one weight per offset and byte; for prediction the tables of two
neighbouring offsets are merged, and a convolution is a few table look-ups.  The window scores of a text,
weighted by length, give its language.

The network is trained with numpy on the driver, on windows of a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import bounded_batches, query, table
from .words import buffers

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 8, 128
UNKNOWN = "und"
#: Counts of so many labels at most are sent to all tasks.
SENT = 10_000
#: Scores of so many pairs of a text and a label are in a worker's memory at once.
SCORES = 400_000


@dataclass
class Network:
    """Weights; ``tables[w]`` has one row of filters per offset and byte (width x 256 x filters)."""

    labels: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pairs(self) -> list[list[np.ndarray]]:
        """Tables of two neighbouring bytes (65536 x filters), and of the last byte of odd widths."""
        merged = []
        for weights in self.tables:
            steps = []
            for k in range(0, len(weights) - 1, 2):
                steps.append((weights[k][:, None, :] + weights[k + 1][None, :, :]).reshape(65536, -1))
            if len(weights) % 2:
                steps.append(weights[-1])
            merged.append([np.ascontiguousarray(s, dtype=np.float32) for s in steps])
        return merged


def pooled(windows: np.ndarray, pairs: list[list[np.ndarray]]) -> np.ndarray:
    """Maxima of all filters over each window; windows are padded with zero bytes."""
    double = (windows[:, :-1].astype(np.uint16) << 8) | windows[:, 1:]
    found = []
    for width, steps in zip(WIDTHS, pairs, strict=True):
        places = windows.shape[1] - width + 1
        total = steps[0][double[:, :places]]
        for k, step in enumerate(steps[1:], 1):
            at = 2 * k
            total += step[double[:, at:at + places] if len(step) == 65536 else windows[:, at:at + places]]
        found.append(total.max(axis=1))
    return np.concatenate(found, axis=1)


def softmax(scores: np.ndarray) -> np.ndarray:
    shifted = np.exp(scores - scores.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, classes: np.ndarray, labels: list[str], rounds: int = 12, batch: int = 64,
          seed: int = 1) -> Network:
    """Fit by stochastic gradient steps (Adam); a maximum passes its gradient to the bytes it stood on."""
    random = np.random.RandomState(seed)
    tables = [random.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    net = Network(labels, tables, np.zeros(FILTERS * len(WIDTHS), np.float32),
                  random.normal(0, 0.3, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32),
                  np.zeros(len(labels), np.float32))
    weights = [*net.tables, net.bias, net.out, net.out_bias]
    means, squares, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(rounds):
        order = random.permutation(len(windows))
        for first in range(0, len(order), batch):
            chosen = order[first:first + batch]
            x, y = windows[chosen], classes[chosen]
            rows, peaks, best = np.arange(len(x))[:, None], [], []
            for w, width in zip(net.tables, WIDTHS, strict=True):
                places = x.shape[1] - width + 1
                total = sum(w[k][x[:, k:k + places]] for k in range(width))
                peaks.append(total.argmax(axis=1))
                best.append(total.max(axis=1))
            hidden = np.maximum(np.concatenate(best, axis=1) + net.bias, 0)
            error = softmax(hidden @ net.out + net.out_bias)
            error[np.arange(len(x)), y] -= 1
            error /= len(x)
            back = (error @ net.out.T) * (hidden > 0)
            slopes = []
            for i, (w, peak) in enumerate(zip(net.tables, peaks, strict=True)):
                slope, own = np.zeros_like(w), back[:, i * FILTERS:(i + 1) * FILTERS]
                for k in range(len(w)):
                    np.add.at(slope, (k, x[rows, peak + k], np.arange(FILTERS)[None, :]), own)
                slopes.append(slope)
            slopes += [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            step += 1
            for weight, slope, mean, square in zip(weights, slopes, means, squares, strict=True):
                mean += 0.1 * (slope - mean)
                square += 0.001 * (slope * slope - square)
                weight -= 0.01 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return net


def cut(offsets: np.ndarray, data: np.ndarray, portion: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All windows of all texts in portions: the windows, the text each belongs to, and its used length.

    Nothing is left out: the last window of a text is padded with zero bytes.
    """
    per_text = -(-np.diff(offsets) // WINDOW)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    start = offsets[:-1][owner] + number * WINDOW
    used = np.minimum(WINDOW, offsets[1:][owner] - start)
    for first in range(0, len(owner), portion):
        at, length = start[first:first + portion], used[first:first + portion]
        places = at[:, None] + np.arange(WINDOW)
        inside = np.arange(WINDOW) < length[:, None]
        windows = np.where(inside, data[np.minimum(places, len(data) - 1)], 0).astype(np.uint8)
        yield windows, owner[first:first + portion], length


def predictor(net: Network):
    """Arrow function from (id, text) to (id, label, probability); a null text is unknown, and so is every text
    to a network without labels."""
    rows = max(1, min(1000, SCORES // max(1, len(net.labels))))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs()
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                if not net.labels:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([UNKNOWN] * part.num_rows, pa.string()),
                                                      pa.array([0.0] * part.num_rows, pa.float64())], ["id", "label", "share"])
                    continue
                offsets, data = buffers(part.column(1))
                scores = np.zeros((part.num_rows, len(net.labels)))
                for windows, owner, length in cut(offsets, data, min(512, rows)):
                    hidden = np.maximum(pooled(windows, pairs) + net.bias, 0)
                    np.add.at(scores, owner, (hidden @ net.out + net.out_bias) * length[:, None])
                share = softmax(scores / np.maximum(np.diff(offsets), 1)[:, None])
                best, known = share.argmax(axis=1), part.column(1).is_valid().to_pylist()
                top = share[np.arange(len(best)), best].tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0),
                     pa.array([net.labels[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)], pa.string()),
                     pa.array([s if k else 0.0 for s, k in zip(top, known, strict=True)], pa.float64())],
                    ["id", "label", "share"])
    return predict


def label_counts(rows: DataFrame, text: Column, label: Column, order: Column) -> DataFrame:
    """``_label``, number of labelled rows with a letter, and their smallest ``order``."""
    useful = rows.where(label.isNotNull() & text.rlike(r"\p{L}"))
    return useful.groupBy(label.alias("_label")).agg(F.count(F.lit(1)).alias("_count"), F.min(order).alias("_least"))


def sample(rows: DataFrame, text: Column, label: Column, order: Column, per_label: int, counts: DataFrame | None = None) -> DataFrame:
    """``label`` and ``window`` of at most ``per_label`` labelled rows of each label.

    They are the rows with the smallest ``order`` (a 64-bit hash of the row, so that the sample is spread
    evenly), and of each row one window from a place in its text that ``order`` picks.  With ``counts``, the rows of
    :func:`label_counts` for at most :data:`SENT` labels, they go to all tasks, and rows are thinned to some 4 x ``per_label``
    of a label where they are read; rows of labels that are not in it are left out.  Without, each task sends
    on its first ``per_label`` rows of every label.
    """
    spread = F.pmod(order, F.greatest(F.octet_length(text) - WINDOW + 1, F.lit(1))).cast("int")
    useful = rows.where(label.isNotNull() & text.rlike(r"\p{L}"))
    windows = useful.select(
        label.alias("label"), order.alias("_order"), F.substring(F.encode(text, "UTF-8"), spread + 1, F.lit(WINDOW)).alias("window"))
    share = F.col("_order") / float(2 ** 64) + 0.5  # so that no more than some 4 x per_label rows of a label are ordered
    thin = windows if counts is None else windows.join(F.broadcast(counts), F.col("label") == F.col("_label")).where(
        (share * F.col("_count") <= 4.0 * per_label) | (F.col("_order") == F.col("_least")))
    first = F.row_number().over(Window.partitionBy("label").orderBy("_order"))
    return thin.withColumn("_n", first).where(F.col("_n") <= per_label).select("label", "window")


def learn(drawn: DataFrame, most_labels: int | None = None) -> Network:
    """Train on the rows of :func:`sample`; without rows the network has no labels and knows no language.

    With ``most_labels``, no label or more labels than that raise an error.
    """
    got = drawn.toPandas().sort_values(["label", "window"])
    labels = sorted(got["label"].unique())
    if most_labels is not None and not 0 < len(labels) <= most_labels:
        raise ValueError(f"{len(labels)} labels to learn; 1 to {most_labels} are allowed")
    if not labels:
        return Network([], [np.zeros((w, 256, FILTERS), np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32),
                       np.zeros((FILTERS * len(WIDTHS), 0), np.float32), np.zeros(0, np.float32))
    data = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in got["window"]), np.uint8).reshape(-1, WINDOW)
    return train(data, np.searchsorted(labels, got["label"].to_numpy(str)), labels)


def fit(rows: DataFrame, text: Column, label: Column, order: Column, per_label: int = 1500,
        most_labels: int = 400) -> Network:
    """Train on a :func:`sample` of the labelled ``rows`` with a fixed number of rows per label.

    At most ``most_labels`` * ``per_label`` windows reach the driver; no label or more labels raise an
    error.  :func:`fit_any` takes any number of them.
    """
    return learn(sample(rows, text, label, order, per_label).limit(most_labels * per_label + 1), most_labels)


def fit_any(rows: DataFrame, text: Column, label: Column, order: Column, per_label: int = 1500,
            windows: int = 600_000) -> Network:
    """Train on a :func:`sample` of the labelled ``rows``, whatever the number of labels.

    Labels share ``windows`` evenly where ``per_label`` rows of each are more than that; of more labels than
    ``windows`` the ``windows`` most frequent are learned, so no more rows than that reach the driver.  Without
    a labelled row every text is ``und`` with score 0.
    """
    counts = stage(label_counts(rows, text, label, order), "labels")
    labels = counts.count()
    share = max(1, min(per_label, windows // max(1, labels)))
    if labels <= SENT:
        return learn(sample(rows, text, label, order, share, counts))
    drawn = sample(rows, text, label, order, share)
    if labels > windows:
        most = counts.orderBy(F.desc("_count"), "_label").limit(windows).select(F.col("_label").alias("label"))
        drawn = drawn.join(most, "label", "left_semi")
    return learn(drawn)


def identify(rows: DataFrame, net: Network, key: Column, text: Column) -> DataFrame:
    """``id``, ``lang_pred``, ``score`` of every row; whole texts are read.

    A null text or one without a letter is ``und`` with score 0, and so is each text if the network has no labels.  Other columns are ignored.
    """
    named = rows.select(key.alias("id"), F.when(text.rlike(r"\p{L}"), text).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    return named.mapInArrow(predictor(net), f"id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, net: Network, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` (with ``text``) whose language is known with a score of ``least`` or more."""
    names = docs.columns
    at, marked = names.index("text"), docs.select("*", docs["text"].rlike(r"\p{L}"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = predictor(net)
        for batch in batches:
            letters = batch.column(batch.num_columns - 1)
            text = pc.if_else(letters, batch.column(at), pa.scalar(None, batch.column(at).type))
            seen = pa.RecordBatch.from_arrays([pa.nulls(len(text)), text], ["id", "text"])
            shares = np.concatenate([b.column(2).to_numpy() for b in score(iter([seen]))] or [np.empty(0)])
            kept = batch.filter(pa.array(shares >= least))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=names)

    return marked.mapInArrow(keep, docs.schema)


def held_out(key: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame) -> Network:
    """The production network: learned from the labelled documents that are not held out."""
    return fit_any(docs.where(~held_out(F.col("doc_id"))), F.col("text"), F.col("lang"), F.xxhash64("doc_id", "text"))


@query("op8_langid")
def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_documents(docs), F.col("doc_id"), F.col("text"))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
