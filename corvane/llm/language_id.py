"""Language identification by a byte convolutional network, trained here in numpy and applied to windows of whole texts.

Bytes (A-Z lower-cased) have learned vectors; filters of several widths slide over a window of fixed length, each keeps
the largest value it meets, and a softmax over these gives the window's probabilities. A text's are the mean over
its windows, weighed by their bytes, so every byte of every text counts. Filters of all widths are columns of one
matrix, the narrower ones zero where they don't reach, and a batch of windows is one matrix product.

The network is fitted on at most SAMPLE documents a language, the first by a hash of their ids, and SPREAD windows of each,
spread evenly over the text; its size doesn't follow from the input. Applying it is one scan; nothing is shuffled.

Defined results: null texts and those without a letter are `und` with score 0, as is every text if nothing could be learned.
A row without an id is judged but never learned from. Of several texts with an id in one language the least is
learned from. Repeated rows score alike; the last window of a text is padded with zeros, so very short ones are judged too.
An empty table gives no rows. Other columns, whatever their names, have no part in it. There is one class for each
language that the training rows name, so a language label should be one of few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import LOWER_BYTES, blobs

#: Labelled documents of each language that the network may be fitted on, and windows of each.
SAMPLE, SPREAD = 300, 4
WINDOW, WIDTHS, FILTERS, VECTOR = 160, (2, 3, 4), 16, 8
EPOCHS, BATCH, RATE = 5, 64, 0.01
UNKNOWN = "und"


def fold(id_col: str) -> Column:
    return F.expr(f"crc32(cast(cast(`{id_col}` AS string) AS binary)) % 4")


def held_out(id_col: str) -> Column:
    return F.coalesce(fold(id_col) == 2, F.lit(False))


def windows_of(text: bytes, length: int = WINDOW) -> np.ndarray:
    """All bytes of the text as rows of a fixed length."""
    data = np.frombuffer(text.translate(LOWER_BYTES), np.uint8)
    out = np.zeros(max(1, -(-len(data) // length)) * length, np.uint8)
    out[: len(data)] = data
    return out.reshape(-1, length)


def _patches(vectors: np.ndarray, x: np.ndarray, reach: int) -> np.ndarray:
    """The vectors under the widest filter at every place; places near the end see zeros beyond it."""
    n, length = x.shape
    flat = np.zeros((n, length + reach - 1, vectors.shape[1]), np.float32)
    flat[:, :length] = vectors[x]
    s = flat.strides
    seen = np.lib.stride_tricks.as_strided(flat, (n, length, reach * vectors.shape[1]), (s[0], s[1], s[2]))
    return np.ascontiguousarray(seen).reshape(n * length, -1)


@dataclass
class Network:
    langs: list[str]
    vectors: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @property
    def reach(self) -> int:
        return self.filters.shape[0] // self.vectors.shape[1]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        y = (_patches(self.vectors, x, self.reach) @ self.filters).reshape(*x.shape, -1)
        return np.maximum(y.max(1) + self.bias, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.pooled(x) @ self.out + self.out_bias)

    def judge(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its probability."""
        cut = [windows_of(t) for t in texts]
        ends = np.cumsum([len(c) for c in cut])
        weight = np.concatenate([np.minimum(WINDOW, np.maximum(1, len(t) - WINDOW * np.arange(len(c)))) for t, c in zip(texts, cut)])
        every = np.concatenate(cut)
        p = np.concatenate([self.probabilities(every[k : k + BATCH]) for k in range(0, len(every), BATCH)])
        mean = np.add.reduceat(p * weight[:, None], np.r_[0, ends[:-1]]) / np.add.reduceat(weight, np.r_[0, ends[:-1]])[:, None]
        best = mean.argmax(1)
        return [self.langs[k] for k in best], np.clip(mean[np.arange(len(best)), best], 0, 1).astype(float)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[bytes], langs: list[str], seed: int = 7) -> Network:
    """The network by stochastic steps (Adam) on the cross-entropy; the same for the same texts."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    rows, ys = [], []
    for text, lang in zip(texts, langs):
        cut = windows_of(text)
        some = cut[np.unique(np.linspace(0, len(cut) - 1, SPREAD).astype(int))]
        rows.append(some)
        ys += [names.index(lang)] * len(some)
    x, y = np.concatenate(rows), np.array(ys)
    reach = max(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(reach) < w).astype(np.float32), VECTOR)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1)
    spread = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    held = [spread(256, VECTOR, scale=0.5), spread(*mask.shape, scale=0.3) * mask, np.zeros(mask.shape[1], np.float32), spread(mask.shape[1], len(names), scale=0.1), np.zeros(len(names), np.float32)]
    first, second, step = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    share = 1 / np.bincount(y, minlength=len(names))
    for epoch in range(EPOCHS):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            at = order[k : k + BATCH]
            some = x[at].copy()
            # Some windows are shortened, as the last one of a text is.
            for i in np.flatnonzero(rng.random(len(at)) < 0.3):
                some[i, rng.integers(8, WINDOW) :] = 0
            weight = share[y[at]]
            gradients = _gradients(held, some, y[at], (weight / weight.sum()).astype(np.float32), reach, mask)
            step += 1
            for i, g in enumerate(gradients):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.01 * (g * g - second[i])
                held[i] -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Network(names, *held)


def _gradients(held: list[np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray, reach: int, mask: np.ndarray) -> list[np.ndarray]:
    vectors, filters, bias, out, out_bias = held
    n, length = x.shape
    patches = _patches(vectors, x, reach)
    z = (patches @ filters).reshape(n, length, -1)
    top = z.argmax(1)
    pooled = np.take_along_axis(z, top[:, None, :], 1)[:, 0] + bias
    active = np.maximum(pooled, 0)
    error = _softmax(active @ out + out_bias)
    error[np.arange(n), y] -= 1
    error *= weight[:, None]
    back = (error @ out.T) * (pooled > 0)
    seen = patches.reshape(n, length, -1)[np.arange(n)[:, None], top]  # what each filter kept: (n, filters, reach x vector)
    d_filters = np.einsum("nf,nfp->pf", back, seen) * mask
    moved = (back[:, :, None] * filters.T[None]).reshape(n, -1, reach, vectors.shape[1])
    place = top[:, :, None] + np.arange(reach)
    inside = place < length
    d_vectors = np.zeros_like(vectors)
    np.add.at(d_vectors, x[np.arange(n)[:, None, None], np.minimum(place, length - 1)][inside], moved[inside])
    return [d_vectors, d_filters, back.sum(0), active.T @ error, error.sum(0)]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(spark: SparkSession, docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Network | None:
    """Fitted on rows where learn holds (by default those that aren't held out); nothing without a labelled row."""
    learn = fold(id_col) != 2 if learn is None else learn
    rows = docs.where(learn).select(F.col(f"`{id_col}`").alias("row_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.where("row_id IS NOT NULL AND lang IS NOT NULL").withColumn("at", F.expr("pmod(xxhash64(row_id), 1000000007)"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("row_id").alias("ids")).select("lang", F.expr(f"2D * {sample} / ids * 1000000007").alias("below"))
    # A row a language; twice the sample on average, so that the hash decides and not which ids there happen to be.
    some = rows.join(F.broadcast(sizes), "lang").where((F.col("at") < F.col("below")) & has_letter(F.col("text")))
    some = some.groupBy("lang", "at", "row_id").agg(F.min("text").alias("text"))
    some = some.withColumn("k", F.expr("row_number() OVER (PARTITION BY lang ORDER BY at, row_id)")).where(F.col("k") <= sample)
    found = some.select("lang", "at", "text", "row_id").orderBy("lang", "at", "row_id").select("lang", "text").toArrow()
    if not found.num_rows:
        return None
    return fit([t for c in found.column("text").chunks for t in blobs(c)], found.column("lang").to_pylist())


def languages(spark: SparkSession, docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, lang_pred, score) of every row."""
    kind = dict(docs.dtypes)[id_col]
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("row_id"), F.when(has_letter(text), text).alias("text"))
    if network is None:
        return rows.select("row_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                known = np.asarray(batch.column(1).is_valid())
                texts = [t for t in blobs(batch.column(1)) if t]
                langs, scores = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
                if texts:
                    langs[known], scores[known] = shared.value.judge(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["row_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"row_id {kind}, lang_pred string, score double")
