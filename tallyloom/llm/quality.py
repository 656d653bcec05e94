"""Quality by a byte-level convolutional network, in numpy.

Bytes become short learned vectors, with one more input that tells whether
the last four bytes stood a little before, too (repeated words are beyond
what a short filter can see); learned filters slide over them; each filter's
response is max-pooled over overlapping chunks that together cover
the whole document. The chunks' responses are combined by their mean and
their maximum over the document, and a logistic unit gives one probability.
Training follows the gradient through the positions that won the pooling.

Defined cases: null and empty texts are one chunk of padding and get that
score; repeated rows score alike; rows whose label is null are left out, a
doc_id with several labels has the largest; with one label only, or none,
every text scores that label's share (0.5 without labels). Extra columns are
ignored (``score``) or kept (``keep_good``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.bytetext import utf8_buffers
from tallyloom.llm.labelled import bounded_sample, fold, training_rows
from tallyloom.session import bound_arrow_batches

#: Rows with crc32(doc_id) of this remainder are held out of training.
FOLDS, HELD_OUT = 5, 0
#: At most about so many labelled documents of each label are drawn (by a hash of doc_id) to train on.
SAMPLE_LOW, SAMPLE_HIGH = 1000, 1500
THRESHOLD = 0.3
#: Learned numbers for each byte, bytes that a filter sees, and filters; repeats are looked for so many bytes back.
EMBED, WIDTH, FILTERS, LAGS = 4, 6, 16, 40
#: Bytes of a block; a chunk is CHUNK blocks and the next begins HOP blocks later.
BLOCK, CHUNK, HOP = 64, 4, 3
EPOCHS, DOCS_A_STEP, RATE, SEED = 8, 32, 0.01, 7
#: Blocks whose filters are computed at once.
AT_ONCE = 512


@dataclass
class Network:
    table: np.ndarray
    filters: np.ndarray
    offset: np.ndarray
    top: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls) -> Network:
        rng = np.random.default_rng(SEED)
        f = np.float32
        return cls(rng.normal(0, 0.5, (256, EMBED)).astype(f), rng.normal(0, 0.3, (WIDTH * (EMBED + 1), FILTERS)).astype(f), np.zeros(FILTERS, f), rng.normal(0, 0.1, 2 * FILTERS).astype(f), np.zeros(1, f))

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.filters, self.offset, self.top, self.bias]

    def inputs(self, data: np.ndarray, repeat: np.ndarray) -> np.ndarray:
        x = np.empty((len(data), EMBED + 1), self.table.dtype)
        x[:, :EMBED], x[:, EMBED] = self.table[data], repeat
        return x

    def responses(self, padded: np.ndarray, first: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's largest response in each block and, if asked for, its place."""
        blocks = len(padded) // BLOCK
        best = np.empty((blocks, FILTERS), self.table.dtype)
        place = np.empty((blocks, FILTERS), np.int64) if where else None
        tail, repeat, last = np.concatenate((padded, np.zeros(WIDTH, np.uint8))), repeats(padded, first), first[1:] - 1
        for lo in range(0, blocks, AT_ONCE):
            hi = min(blocks, lo + AT_ONCE)
            part = slice(lo * BLOCK, hi * BLOCK + WIDTH - 1)
            x = self.inputs(tail[part], repeat[part])
            seen = np.lib.stride_tricks.as_strided(x, ((hi - lo) * BLOCK, WIDTH * (EMBED + 1)), (x.strides[0], x.strides[1]))
            out = (np.ascontiguousarray(seen) @ self.filters).reshape(hi - lo, BLOCK, FILTERS)
            # A text's last places, all padding, would look into the next text.
            out[last[(last >= lo) & (last < hi)] - lo, 1 - WIDTH :] = -1e9
            if where:
                place[lo:hi] = out.argmax(axis=1)
            best[lo:hi] = out.max(axis=1)
        return np.maximum(best + self.offset, 0), place


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with zeros to whole blocks, and the first block of each (and one past the last)."""
    size = np.diff(offsets)
    need = -(-(size + 2 * WIDTH) // BLOCK)
    first = np.concatenate(([0], np.cumsum(need)))
    padded = np.zeros(int(first[-1]) * BLOCK, np.uint8)
    for k in range(len(size)):
        at = int(first[k]) * BLOCK
        padded[at : at + int(size[k])] = data[offsets[k] : offsets[k + 1]]
    return padded, first


def repeats(padded: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 where the four bytes that end here stood up to LAGS bytes before, too; 0 in padding and in a text's first bytes."""
    n = len(padded)
    out = np.zeros(n + WIDTH, dtype=bool)
    if n > LAGS + 4:
        wide = padded.astype(np.uint32)
        gram = wide[3:] | (wide[2:-1] << 8) | (wide[1:-2] << 16) | (wide[:-3] << 24)
        for lag in range(2, LAGS + 1):
            out[3 + lag : n] |= gram[lag:] == gram[:-lag]
    out[:n] &= padded != 0
    heads = (first[:-1] * BLOCK)[:, None] + np.arange(min(LAGS + 4, BLOCK))
    out[heads.ravel()] = False
    return out


def chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each chunk (a row each, the last block repeated at a text's end) and the first chunk of each text."""
    blocks = np.diff(first)
    each = 1 + -(-np.maximum(blocks - CHUNK, 0) // HOP)
    start = np.concatenate(([0], np.cumsum(each)))
    text = np.repeat(np.arange(len(blocks)), each)
    begin = first[:-1][text] + (np.arange(int(start[-1])) - start[text]) * HOP
    return np.minimum(begin[:, None] + np.arange(CHUNK)[None, :], first[1:][text][:, None] - 1), start


def features(best: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean and maximum, over a text's chunks, of each filter's pooled response."""
    members, start = chunks(first)
    pooled = best[members].max(axis=1)
    mean = np.add.reduceat(pooled, start[:-1], axis=0) / np.diff(start)[:, None]
    return np.hstack([mean, np.maximum.reduceat(pooled, start[:-1], axis=0)])


def step_gradients(net: Network, data: np.ndarray, offsets: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted log loss of some texts."""
    padded, first = layout(data, offsets)
    best, place = net.responses(padded, first, where=True)
    members, start = chunks(first)
    stack = best[members]
    winner = stack.argmax(axis=1)
    pooled = np.take_along_axis(stack, winner[:, None, :], axis=1)[:, 0]
    each = np.diff(start)
    text = np.repeat(np.arange(len(each)), each)
    mean = np.add.reduceat(pooled, start[:-1], axis=0) / each[:, None]
    peak = np.maximum.reduceat(pooled, start[:-1], axis=0)
    x = np.hstack([mean, peak])
    p = 1 / (1 + np.exp(-np.clip(x @ net.top + net.bias, -30, 30)))
    error = weight * (p - y) / weight.sum()
    g_top, g_bias = x.T @ error, np.array([error.sum()])
    g_pooled = (error / each)[text, None] * net.top[None, :FILTERS]
    is_peak = pooled == peak[text]
    # Of equal peaks the first chunk alone gets the gradient.
    order = np.arange(len(text))[:, None]
    leader = np.minimum.reduceat(np.where(is_peak, order, len(text)), start[:-1], axis=0)
    g_pooled = g_pooled + (leader[text] == order) * error[text, None] * net.top[None, FILTERS:]
    g_pooled *= pooled > 0
    block = np.take_along_axis(members[:, :, None], winner[:, None, :], axis=1)[:, 0]
    at = block * BLOCK + np.take_along_axis(place, block, axis=0)
    tail, repeat = np.concatenate((padded, np.zeros(WIDTH, np.uint8))), repeats(padded, first)
    g_filters, g_table = np.zeros_like(net.filters), np.zeros_like(net.table)
    for f in range(FILTERS):
        spot = at[:, f][:, None] + np.arange(WIDTH)[None, :]
        seen = tail[spot]
        g = g_pooled[:, f]
        g_filters[:, f] = (net.inputs(seen.ravel(), repeat[spot].ravel()).reshape(len(g), -1) * g[:, None]).sum(axis=0)
        own = net.filters[:, f].reshape(WIDTH, EMBED + 1)[:, :EMBED]
        for k in range(WIDTH):
            share = np.bincount(seen[:, k], weights=g, minlength=256)
            g_table += share[:, None].astype(np.float32) * own[k][None, :]
    return [g_table, g_filters, g_pooled.sum(axis=0), g_top, g_bias]


def fit(texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> Network:
    """Adam over shuffled documents, whole texts."""
    net = Network.start()
    rng = np.random.default_rng(SEED)
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    t = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        order = rng.permutation(len(texts))
        for at in range(0, len(order), DOCS_A_STEP):
            own = order[at : at + DOCS_A_STEP]
            offsets = np.concatenate(([0], np.cumsum([len(texts[i]) for i in own])))
            data = np.frombuffer(b"".join(texts[i] for i in own), np.uint8)
            t += 1
            for p, g, m, v in zip(net.parameters(), step_gradients(net, data, offsets, y[own], weight[own]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(p.dtype)
    return net


def probabilities(net: Network | float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if isinstance(net, float):
        return np.full(len(offsets) - 1, net)
    padded, first = layout(data, offsets)
    best, _ = net.responses(padded, first)
    x = features(best, first)
    return 1 / (1 + np.exp(-np.clip((x @ net.top + net.bias).astype(float), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample_low: int = SAMPLE_LOW, sample_high: int = SAMPLE_HIGH) -> Network | float:
    """The network, fitted on a bounded sample of labelled rows; a share instead where one label alone is there."""
    rows, shares = bounded_sample(training_rows(docs, labels, "quality", FOLDS, HELD_OUT), {0: sample_low, 1: sample_high})
    got = sorted((r[0], r[1], r[2] or "") for r in rows.select("doc_id", "label", "text").collect())
    if len({r[1] for r in got}) < 2:
        return float(got[0][1]) if got else 0.5
    y = np.array([r[1] for r in got], dtype=np.float32)
    return fit([r[2].encode() for r in got], y, np.where(y == 1, 1 / shares[1], 1 / shares[0]).astype(np.float32))


def _scored(column: pa.Array, net: Network | float) -> np.ndarray:
    data, offsets = utf8_buffers(column)
    return probabilities(net, data, offsets)


def score(docs: DataFrame, net: Network | float) -> DataFrame:
    """doc_id and score of every document. No shuffle."""
    bound_arrow_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(net)

    def judge(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scored(batch.column(1), known.value).astype(float))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, "doc_id long, score double")


def keep_good(docs: DataFrame, net: Network | float, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score the threshold or more, with all their columns. No shuffle."""
    bound_arrow_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch.column(at), known.value) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
