"""Quality scores from a byte-level convolutional network in numpy.

A filter sees WIDTH bytes. Its weights are a table (place in the window, byte), so
a convolution is a sum of look-ups. Windows start at every byte (STRIDE 1) of
overlapping chunks that cover the whole document; each filter's responses are
max-pooled over all windows of all chunks, and a logistic layer combines the
maxima into one probability.

Learning: plain gradient descent with Adam on a bounded sample of labelled rows
(SAMPLE_ROWS of each class). A row gives a seeded part of PART_BYTES from anywhere
in its text, of which each epoch takes TRAIN_BYTES; one row in WHOLE_ROWS is learned
at full length (a seeded part of WHOLE_BYTES, if it is longer than that). The gradient
of a maximum reaches only its window. The model is a few hundred KB, whatever the corpus.

A null text counts as empty; an empty text is scored by the biases alone. With
no labelled row, or one class only, the score is the share of label 1 (0.5 with
no row). Rows are answered on their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, STRIDE, FILTERS = 8, 1, 24
#: Bytes of a chunk, of which WIDTH - STRIDE overlap the next one's.
CHUNK = 1 << 16
SAMPLE_ROWS, TRAIN_BYTES, EPOCHS, BATCH, RATE = 3000, 2048, 14, 64, 0.02
#: Bytes that a row sends to the driver; of every WHOLE_ROWS rows, one sends its whole text, or that many bytes of it.
PART_BYTES, WHOLE_ROWS, WHOLE_BYTES = 4 * TRAIN_BYTES, 8, 1 << 18
#: Few rows are gone over more often, until so many steps are made (at most MOST_EPOCHS times).
LEAST_STEPS, MOST_EPOCHS = 400, 80
THRESHOLD = 0.3
SEED = 7


def held_out(doc_id: Column) -> Column:
    """Rows whose labels never teach: crc32 of the id's text divides by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def windows(n: int) -> int:
    """Windows that cover n bytes (at least one; the last is padded)."""
    return max(1, -(-(n - WIDTH) // STRIDE) + 1)


def pooled(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(maximum, first window of it) of each filter over one document.

    ``table`` is (WIDTH, 257, filters); byte 256 is padding. The chunks are made
    of whole windows, so each window is met once, and memory is a chunk's.
    """
    best, at = np.full(table.shape[2], -np.inf, np.float32), np.zeros(table.shape[2], np.int64)
    step = (CHUNK - WIDTH) // STRIDE * STRIDE + STRIDE
    for start in range(0, max(1, len(data) - (WIDTH - STRIDE)), step):
        chunk = np.frombuffer(data[start : start + CHUNK], np.uint8)
        n = windows(len(chunk))
        x = np.full((n - 1) * STRIDE + WIDTH, 256, np.int64)
        x[: len(chunk)] = chunk[: len(x)]
        response = table[0].take(x[: (n - 1) * STRIDE + 1 : STRIDE], axis=0)
        for k in range(1, WIDTH):
            response += table[k].take(x[k : k + (n - 1) * STRIDE + 1 : STRIDE], axis=0)
        top = response.argmax(axis=0)
        value = response[top, np.arange(len(top))]
        better = value > best
        best[better], at[better] = value[better], start // STRIDE + top[better]
    return best, at


class Network:
    """Tables of filters, and the layer that combines their maxima."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: float):
        self.table, self.weights, self.bias = table, weights, bias

    def score(self, data: bytes) -> float:
        top, _ = pooled(data, self.table)
        z = float(np.tanh(top) @ self.weights + self.bias)
        return 1.0 / (1.0 + np.exp(-max(-50.0, min(50.0, z))))


def fit(texts: list[bytes], labels: list[int], whole: list[bool] | None = None, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Learns from texts (those of ``whole`` at full length) and labels 0 and 1; classes weigh alike, and the bias is set back to their shares at the end."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.15, (WIDTH, 257, FILTERS)).astype(np.float32)
    weights = rng.normal(0, 0.5, FILTERS)
    y = np.array(labels, np.float64)
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Network(table, np.zeros(FILTERS), float(np.log(p / (1 - p))))
    bias = 0.0
    importance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    m = [np.zeros_like(table), np.zeros(FILTERS), 0.0]
    v = [np.zeros_like(table), np.zeros(FILTERS), 0.0]
    step, column = 0, np.arange(FILTERS)
    epochs = max(epochs, min(MOST_EPOCHS, LEAST_STEPS * BATCH // len(y)))
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            g_table, g_weights, g_bias = np.zeros_like(table), np.zeros(FILTERS), 0.0
            for i in part:
                data = texts[i]
                if len(data) > TRAIN_BYTES and not (whole and whole[i]):
                    s = int(rng.integers(0, len(data) - TRAIN_BYTES + 1))
                    data = data[s : s + TRAIN_BYTES]
                top, at = pooled(data, table)
                h = np.tanh(top)
                p = 1.0 / (1.0 + np.exp(-(h @ weights + bias)))
                d = (p - y[i]) * importance[i] / len(part)
                g_weights += d * h
                g_bias += d
                back = (d * weights * (1 - h * h)).astype(np.float32)
                for k in range(WIDTH):
                    place = at * STRIDE + k
                    inside = place < len(data)
                    byte = np.full(FILTERS, 256)
                    byte[inside] = np.frombuffer(data, np.uint8)[place[inside]]
                    g_table[k, byte, column] += back
            step += 1
            new = []
            for k, (x, g) in enumerate(((table, g_table), (weights, g_weights), (bias, g_bias))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                new.append(x - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8))
            table, weights, bias = new[0].astype(np.float32), new[1], float(new[2])
    return Network(table, weights, bias + float(np.log(share / (1 - share))))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[bytes], list[int], list[bool]]:
    """At most ``rows`` labelled texts of each class, a seeded part of each; whether a row is to be learned at full length."""
    ids = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    h = F.xxhash64("doc_id", F.lit(SEED))
    cells = ids.groupBy("quality", F.pmod(h, F.lit(rows)).alias("cell")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "quality")
    chosen = sorted((r.doc_id, r.quality) for r in cells.collect())
    if not chosen:
        return [], [], []
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    schema = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType())])
    picked = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(docs.sparkSession.createDataFrame(chosen, schema)), "doc_id")
    data = F.coalesce("text", F.lit("")).cast("binary")
    whole = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(WHOLE_ROWS)) == 0
    most = F.when(whole, F.lit(WHOLE_BYTES)).otherwise(F.lit(PART_BYTES))
    start = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 2)), F.greatest(F.octet_length(data) - most, F.lit(0)) + 1).cast("int")
    texts = {}
    for r in picked.select("doc_id", "quality", whole.alias("whole"), F.substring(data, start + 1, most).alias("text")).toLocalIterator():
        texts.setdefault((r.doc_id, r.quality), (bytes(r.text), r.whole))
    keys = sorted(texts)
    return [texts[k][0] for k in keys], [k[1] for k in keys], [texts[k][1] for k in keys]


def score_documents(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, score for every row of docs, over its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((network.table, network.weights, network.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*shared.value)
        for b in batches:
            scores = [float(net.score(x or b"")) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, score double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = score_documents(docs, fit(*training_rows(docs, labels)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
SQL: dict[str, str] = {}
