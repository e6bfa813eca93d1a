"""Language identification by a byte convolutional network, trained in numpy.

Texts are cut into windows of fixed length (with an overlap of the widest filter, so no position is lost);
bytes are embedded, filters of several widths run over them, each filter keeps its maximum in the window,
and a softmax gives the window's languages. A text's languages are the mean over all its windows.

Training takes about `per_language` rows of each language that are not held out (by hash of their ids) and
at most `windows_per_row` windows of each, of the `max_languages` most frequent languages, which the executors cut; the driver gets windows only.

Defined cases: a null text, or one without a letter, is `und` with score 0; a text shorter than a window
is padded; rows with a null language are scored but never learned from; with no labelled row at all every
text is `und`. Repeated rows count each; empty tables give empty results; only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.llm.sampling import is_held_out
from admitflow.plans.shared import bound_batches

WINDOW = 128
WIDTHS = (2, 3, 4, 5)
STRIDE = WINDOW - max(WIDTHS) + 1
#: Distinct languages that a model learns at most (a bound of its sample): the most frequent, ties by name.
MAX_LANGUAGES = 1000
UNKNOWN = "und"


def windows(raw: bytes) -> np.ndarray:
    """(count, WINDOW) bytes that cover the whole text; the last is filled up with zeros."""
    count = max(1, -(-(len(raw) - (WINDOW - STRIDE)) // STRIDE))
    data = np.zeros((count - 1) * STRIDE + WINDOW, dtype=np.uint8)
    data[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, WINDOW)[::STRIDE]


@dataclass
class Network:
    """embed (256, d); filters (widest * d, f); filter bias (f,); out (f, languages); out bias."""

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def patches(self, x: np.ndarray) -> np.ndarray:
        d, w = self.embed.shape[1], max(WIDTHS)
        e = self.embed[x].reshape(len(x), WINDOW * d)
        return np.lib.stride_tricks.sliding_window_view(e, w * d, axis=1)[:, ::d]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """max over positions of each filter, rectified: (windows, filters)."""
        p = self.patches(x)
        hit = np.ascontiguousarray(p).reshape(-1, p.shape[2]) @ self.filters
        return np.maximum(hit.reshape(len(x), p.shape[1], -1).max(axis=1) + self.bias, 0)

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], embed: int = 4, per_width: int = 8, epochs: int = 6, steps: int = 300, batch: int = 128, rate: float = 4e-3, seed: int = 11) -> Network:
    """Cross-entropy, Adam, at least `steps` batches; gradients pass a filter only where it had its maximum."""
    rng = np.random.default_rng(seed)
    f, w = per_width * len(WIDTHS), max(WIDTHS)
    live = np.zeros((w, embed, f), dtype=np.float32)
    for i, width in enumerate(WIDTHS):
        live[:width, :, i * per_width : (i + 1) * per_width] = 1
    live = live.reshape(w * embed, f)
    n = Network(languages, rng.normal(0, 0.5, (256, embed)).astype(np.float32), rng.normal(0, 0.3, live.shape).astype(np.float32) * live, np.zeros(f, np.float32), rng.normal(0, 0.2, (f, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    n.embed[0] = 0
    names = ("embed", "filters", "bias", "out", "out_bias")
    first, second = ({k: np.zeros_like(getattr(n, k)) for k in names} for _ in range(2))
    t = 0
    batches = max(1, len(x) // batch)
    for _ in range(max(epochs, -(-steps // batches)) if len(x) else 0):
        for own in np.array_split(rng.permutation(len(x)), batches):
            xb, yb, b = x[own], y[own], len(own)
            p = np.ascontiguousarray(n.patches(xb))
            hit = (p.reshape(-1, p.shape[2]) @ n.filters).reshape(b, p.shape[1], f)
            at = hit.argmax(axis=1)
            raw = np.take_along_axis(hit, at[:, None, :], 1)[:, 0] + n.bias
            pooled = np.maximum(raw, 0)
            z = pooled @ n.out + n.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(b), yb] -= 1
            z /= b
            back = (z @ n.out.T) * (raw > 0)
            taken = p[np.arange(b)[:, None], at]
            de = np.zeros_like(n.embed)
            pushed = back[:, :, None] * n.filters.T[None]
            spots = xb[np.arange(b)[:, None, None], at[:, :, None] + np.arange(w)]
            np.add.at(de, spots.reshape(-1), pushed.reshape(-1, embed))
            de[0] = 0
            slopes = {"embed": de, "filters": np.einsum("bfk,bf->kf", taken, back) * live, "bias": back.sum(axis=0), "out": pooled.T @ z, "out_bias": z.sum(axis=0)}
            t += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * slopes[k]
                second[k] = 0.999 * second[k] + 0.001 * slopes[k] ** 2
                setattr(n, k, (getattr(n, k) - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32))
    return n


def train(docs: DataFrame, per_language: int = 400, windows_per_row: int = 8, max_languages: int = MAX_LANGUAGES, key: str = "doc_id", text: str = "text", lang: str = "lang", holdout=is_held_out) -> Network:
    usable = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("raw"), F.col(f"`{lang}`").alias("lang"), holdout(key).alias("out")).filter("not out and lang is not null and key is not null")
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    found = counts.orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return fit(np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), [UNKNOWN])
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 20, (per_language << 20) // r["n"] + 1)) for r in found], "lang string, share long")
    chosen = usable.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("key", F.lit("language")), F.lit(1 << 20)) < F.col("share"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if raw:
                    all_of = windows(raw)
                    for i in sorted({int(j) for j in np.linspace(0, len(all_of) - 1, windows_per_row)}):
                        langs.append(name)
                        parts.append(all_of[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], names=["lang", "part"])

    table = chosen.select("lang", "raw").mapInArrow(cut, "lang string, part binary").toArrow()
    rows = sorted(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
    x = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint8).reshape(-1, WINDOW)
    return fit(x, np.array([languages.index(r[0]) for r in rows], dtype=int), languages)


def predict(docs: DataFrame, network: Network, key: str = "doc_id", text: str = "text", batch_windows: int = 256) -> DataFrame:
    """key, lang_pred, score for every row of docs."""
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(network)  # of fixed size
    body = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{key}`").alias("key"), body.cast("binary").alias("raw"), F.coalesce(body.rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def means(raws: list[bytes]) -> np.ndarray:
        net = model.value
        total = np.zeros((len(raws), len(net.languages)))
        held, owner, size = [], [], 0

        def flush() -> None:
            x = np.concatenate(held)
            rows_of = np.concatenate(owner)
            for at in range(0, len(x), batch_windows):
                np.add.at(total, rows_of[at : at + batch_windows], net.chances(x[at : at + batch_windows]))

        for i, raw in enumerate(raws):
            own = windows(raw)
            held.append(own)
            owner.append(np.full(len(own), i))
            size += len(own)
            if size >= 4096:
                flush()
                held, owner, size = [], [], 0
        if held:
            flush()
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                letters = part.column(2).to_numpy(zero_copy_only=False)
                share = means([r if ok else b"" for r, ok in zip(part.column(1).to_pylist(), letters, strict=True)])
                best = share.argmax(axis=1)
                known = letters & (model.value.languages[0] != UNKNOWN or len(model.value.languages) > 1)
                langs = [model.value.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(np.where(known, np.clip(share[np.arange(len(best)), best], 0, 1), 0.0))], names=["key", "lang_pred", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """key, held_out, lang_pred, score for every row of docs, by a network trained on docs itself."""
    network = train(docs, key=key, text=text, lang=lang, **options)
    return predict(docs, network, key, text).select(key, is_held_out(key).alias("held_out"), "lang_pred", "score")
