"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct words, hashed into buckets and scaled to length 1, statistics of its
bytes, lines and words, and the row's metadata columns. The score is the logistic of
w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2): all pairs of features interact through
`rank` factors at a cost linear in the features. Training runs in numpy on the driver, on at most
`train_rows` labelled rows (the least by hash of their id); scoring reads every whole text, in batches.

Defined cases: null and empty texts have no words and a score like any other; null metadata count as 0 and
mark themselves missing; labels that are null are skipped, repeated ones each count; documents and labels
may repeat ids; only named columns are read, so others can't clash. Without labels of both kinds every score is the
share of label 1 (1/2 without labels). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.llm.sampling import is_held_out
from admitflow.llm.text_hash import many_word_hashes
from admitflow.plans.shared import bound_batches

BUCKETS = 1 << 15
_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
#: Statistics of a text, before its metadata.
STATISTICS = 15 + len(_PUNCTUATION)


def statistics(raw: bytes, words: np.ndarray, distinct: int) -> np.ndarray:
    """Shares of byte classes and of each ASCII punctuation mark, and shapes of words and lines."""
    n = max(len(raw), 1)
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    lines = raw.split(b"\n")
    full = [line for line in lines if line]
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    marks = count[_PUNCTUATION]
    w = max(len(words), 1)
    shape = [
        np.log1p(len(raw)), upper / n, lower / n, digit / n, (count[32] + count[9]) / n, count[10] / n, count[128:].sum() / n, count[:9].sum() / n,
        upper / max(upper + lower, 1), marks.sum() / w, len(raw) / w, distinct / w, len(set(full)) / max(len(full), 1), len(full) / w, np.log1p(len(words)),
    ]
    return np.concatenate([shape, marks / w])


def features(raws: list[bytes], meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, value, words per row, dense statistics and metadata) of a batch."""
    buckets, values, sizes, dense = [], [], [], []
    for raw, words in zip(raws, many_word_hashes(raws), strict=True):
        own = np.sort((words & np.uint64(BUCKETS - 1)).astype(np.int32))
        own = own[np.flatnonzero(np.diff(own, prepend=-1))]
        buckets.append(own)
        values.append(np.full(len(own), 1 / np.sqrt(max(len(own), 1)), dtype=np.float32))
        sizes.append(len(own))
        dense.append(statistics(raw, words, len(own)))
    missing = ~np.isfinite(meta)
    return np.concatenate(buckets), np.concatenate(values), np.array(sizes), np.concatenate([np.array(dense), np.where(missing, 0, np.sign(meta) * np.log1p(np.abs(meta))), missing], axis=1).astype(np.float32)


@dataclass
class Machine:
    """w0, weights and factors of the words (first BUCKETS rows) and of the dense features."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -4, 4).astype(np.float32) / 4

    def parts(self, bucket: np.ndarray, value: np.ndarray, sizes: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(raw score, factor sums) per row; `dense` is scaled already."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        linear = np.bincount(row, self.weights[bucket] * value, len(sizes)) + dense @ self.weights[BUCKETS:]
        v = self.factors[bucket] * value[:, None]
        sums = dense @ self.factors[BUCKETS:]
        squares = (dense**2) @ (self.factors[BUCKETS:] ** 2)
        for f in range(v.shape[1]):
            sums[:, f] += np.bincount(row, v[:, f], len(sizes))
            squares[:, f] += np.bincount(row, v[:, f] ** 2, len(sizes))
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1), sums

    def score(self, bucket: np.ndarray, value: np.ndarray, sizes: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(bucket, value, sizes, self.dense(dense))[0], -40, 40)))


def fit(bucket: np.ndarray, value: np.ndarray, sizes: np.ndarray, dense: np.ndarray, label: np.ndarray, rank: int = 8, epochs: int = 12, rate: float = 0.15, decay: float = 1e-5, batch: int = 128, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad, mini-batches in a seeded order."""
    rng = np.random.default_rng(seed)
    width = BUCKETS + dense.shape[1]
    share = float(label.mean()) if len(label) else 0.5
    mean, scale = (dense.mean(axis=0), dense.std(axis=0) + 1e-3) if len(dense) else (np.zeros(dense.shape[1]), np.ones(dense.shape[1]))
    m = Machine(float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(width, np.float32), rng.normal(0, 0.05, (width, rank)).astype(np.float32), mean.astype(np.float32), scale.astype(np.float32))
    if share in (0.0, 1.0) or not len(label):
        m.factors[:] = 0
        return m
    x, ends = m.dense(dense), np.cumsum(sizes)
    g0, gw, gv = 1.0, np.full(width, 1e-2, np.float32), np.full((width, rank), 1e-2, np.float32)
    for _ in range(epochs):
        for own in np.array_split(rng.permutation(len(label)), max(1, len(label) // batch)):
            at = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in own])
            b, v, s, d = bucket[at], value[at], sizes[own], x[own]
            raw, sums = m.parts(b, v, s, d)
            err = ((1 / (1 + np.exp(-raw))) - label[own]).astype(np.float32) / len(own) * 8
            row = np.repeat(np.arange(len(own)), s)
            used, slot = np.unique(b, return_inverse=True)
            e = err[row] * v
            step = np.zeros((len(used), rank + 1), np.float32)
            step[:, 0] = np.bincount(slot, e, len(used))
            squares = np.bincount(slot, e * v, len(used))
            for f in range(rank):
                step[:, f + 1] = np.bincount(slot, e * sums[row, f], len(used)) - m.factors[used, f] * squares
            idx = np.concatenate([used, np.arange(BUCKETS, width)])
            dw = np.concatenate([step[:, 0], err @ d]) + decay * m.weights[idx]
            dv = np.concatenate([step[:, 1:], d.T @ (err[:, None] * sums) - m.factors[BUCKETS:] * ((d**2).T @ err)[:, None]]) + decay * m.factors[idx]
            gw[idx] += dw**2
            gv[idx] += dv**2
            m.weights[idx] -= rate * dw / np.sqrt(gw[idx])
            m.factors[idx] -= rate * dv / np.sqrt(gv[idx])
            g0 += float(err.sum()) ** 2
            m.bias -= rate * float(err.sum()) / np.sqrt(g0)
    return m


def _rows(docs: DataFrame, key: str, text: str, metadata: Sequence[str], *more) -> DataFrame:
    return docs.select(*more, F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("raw"), *[F.col(f"`{c}`").cast("double").alias(f"m{i}") for i, c in enumerate(metadata)])


def _meta(part: pa.RecordBatch, first: int) -> np.ndarray:
    columns = [part.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(first, part.num_columns)]
    return np.stack(columns, axis=1) if columns else np.zeros((part.num_rows, 0))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            bucket, value, sizes, dense = features([r or b"" for r in part.column(2).to_pylist()], _meta(part, 3))
            cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket)), pa.array(list(dense), pa.list_(pa.float32()))], names=["label", "buckets", "dense"])


def train(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = ("n_chars",), train_rows: int = 6000, key: str = "doc_id", text: str = "text", label: str = "quality", holdout=is_held_out) -> Machine:
    """A machine fitted to at most `train_rows` labelled rows that aren't held out."""
    usable = labels.filter(~holdout(key) & F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("_id"), F.col(label).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id", "label").limit(train_rows)
    rows = _rows(docs, key, text, metadata).join(F.broadcast(chosen), F.col("key") == F.col("_id"))
    rows = rows.select("label", "key", "raw", *[f"m{i}" for i in range(len(metadata))])
    table = rows.mapInArrow(_extract, "label int, buckets array<int>, dense array<float>").toArrow()
    n = table.num_rows
    lists = table.column(1).combine_chunks()
    sizes = np.asarray(lists.value_lengths()) if n else np.zeros(0, int)
    bucket = lists.flatten().to_numpy() if n else np.zeros(0, np.int32)
    dense = np.stack(table.column(2).to_pylist()).astype(np.float32) if n else np.zeros((0, STATISTICS + 2 * len(metadata)), np.float32)
    value = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes).astype(np.float32)
    return fit(bucket, value, sizes, dense, table.column(0).to_numpy().astype(np.float32))


def scorer(spark: SparkSession, machine: Machine):
    """A function of (text bytes, metadata...) columns to scores: only those leave the JVM, the row's others stay."""
    model = spark.sparkContext.broadcast(machine)  # BUCKETS * (rank + 1) floats, whatever the input

    @F.pandas_udf("double")
    def run(raw: pd.Series, *meta: pd.Series) -> pd.Series:
        numbers = np.stack([m.to_numpy(dtype=float, na_value=np.nan) for m in meta], axis=1) if meta else np.zeros((len(raw), 0))
        out = [np.zeros(0)]
        for at in range(0, len(raw), 256):
            part = [bytes(r) if r is not None else b"" for r in raw.iloc[at : at + 256]]
            out.append(model.value.score(*features(part, numbers[at : at + 256])))
        return pd.Series(np.concatenate(out))

    return run


def score_column(docs: DataFrame, machine: Machine, metadata: Sequence[str] = ("n_chars",), text: str = "text") -> Column:
    """The score of each row of docs, as a column."""
    bound_batches(docs.sparkSession)
    run = scorer(docs.sparkSession, machine)
    return run(F.col(f"`{text}`").cast("binary"), *[F.col(f"`{c}`").cast("double") for c in metadata])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", **options) -> DataFrame:
    """key, held_out, score, predicted (1 from `threshold` up) for every row of docs."""
    machine = train(docs, labels, key=key, **options)
    shown = {k: options[k] for k in ("metadata", "text") if k in options}
    scored = docs.select(F.col(f"`{key}`").alias("key"), score_column(docs, machine, **shown).alias("score"))
    held = is_held_out("key").alias("held_out")
    return scored.select(F.col("key").alias(key), held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text", metadata: Sequence[str] = ("n_chars",)) -> DataFrame:
    """The whole rows of docs that score at least the threshold, with all their columns."""
    machine = train(docs, labels, metadata, key=key, text=text)
    return docs.filter(score_column(docs, machine, metadata, text) >= threshold)
