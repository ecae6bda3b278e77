"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its hashed words, with counts scaled to unit length, and a few standardised
dense numbers: what the text is built like, and numeric metadata columns. The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so pairwise interactions cost time linear in the features. Training runs on a bounded sample of
labelled rows whose features Spark makes; scoring covers every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .perplexity import text_statistics
from .textbytes import Texts, Words, blocks, count_in, span_hashes, sums_by

BITS = 16
#: Words, word length, symbols, repeated lines, repeated words, capitals, digits, marks, stops, lines, ends of lines, plain letters.
N_STRUCTURE = 12

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:")] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~(_UPPER | _DIGIT | _STOP | _LETTER)


def structure(texts: Texts) -> np.ndarray:
    """``N_STRUCTURE`` numbers per text, 0 for an empty one."""
    n_words, chars, symbols, dup, repeat = text_statistics(texts)
    some = np.maximum(n_words, 1)
    letters = np.maximum(chars, 1)
    share = lambda table: count_in(np.flatnonzero(table[texts.data]), texts) / letters
    lines = count_in(np.flatnonzero(texts.data == 10), texts)
    columns = [
        np.log1p(n_words), chars / some, np.sqrt(symbols / letters), np.sqrt(dup / np.maximum(lines, 1)), repeat / some,
        share(_UPPER), share(_DIGIT), np.sqrt(share(_MARK)), np.sqrt(share(_STOP)), np.log1p(lines), lines / some, share(_LETTER),
    ]
    return np.stack(columns, 1)


def hashed_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and unit-length weights of each text's distinct words, and where each text's begin."""
    words = Words(texts)
    h = span_hashes(texts.data, words.start, words.end) >> np.uint64(64 - BITS)
    owner = np.repeat(np.arange(texts.n, dtype=np.uint64), words.counts)
    keys, n = np.unique(owner << np.uint64(BITS) | h, return_counts=True)
    bounds = np.searchsorted(keys, np.arange(texts.n + 1, dtype=np.uint64) << np.uint64(BITS))
    norm = np.sqrt(sums_by(n.astype(float) ** 2, bounds))
    x = n / np.repeat(norm, np.diff(bounds))
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int64), x, bounds


@dataclass
class Machine:
    """Weights: ``w`` and ``v`` of the word buckets, ``wd`` and ``vd`` of the dense numbers."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    wd: np.ndarray
    vd: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.mean) / self.scale, -5, 5)

    def logits(self, bucket: np.ndarray, x: np.ndarray, bounds: np.ndarray, dense: np.ndarray) -> np.ndarray:
        vx = self.v[bucket] * x[:, None]
        first = sums_by(vx, bounds) + dense @ self.vd
        second = sums_by(vx**2, bounds) + dense**2 @ self.vd**2
        return self.w0 + sums_by(self.w[bucket] * x, bounds) + dense @ self.wd + 0.5 * (first**2 - second).sum(axis=1)


def fit(sparse: list[tuple[np.ndarray, np.ndarray]], raw: np.ndarray, y: np.ndarray, rank: int = 8, rounds: int = 12, seed: int = 3) -> Machine:
    """Minimise the log loss with Adam over batches of 128 rows."""
    rng = np.random.default_rng(seed)
    size, m = 1 << BITS, raw.shape[1]
    mean, scale = raw.mean(axis=0), raw.std(axis=0) + 1e-6
    rate = np.clip(y.mean(), 0.01, 0.99)
    model = Machine(float(np.log(rate / (1 - rate))), np.zeros(size), rng.normal(0, 0.01, (size, rank)), np.zeros(m), rng.normal(0, 0.05, (m, rank)), mean, scale)
    dense = model.dense(raw)
    names = ("w", "v", "wd", "vd")
    moment = {k: (np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))) for k in names}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            rows = order[at : at + 128]
            step += 1
            bucket = np.concatenate([sparse[r][0] for r in rows])
            x = np.concatenate([sparse[r][1] for r in rows])
            bounds = np.concatenate([[0], np.cumsum([len(sparse[r][0]) for r in rows])])
            owner = np.repeat(np.arange(len(rows)), np.diff(bounds))
            d = dense[rows]
            vx = model.v[bucket] * x[:, None]
            first = sums_by(vx, bounds) + d @ model.vd
            p = 1 / (1 + np.exp(-np.clip(model.logits(bucket, x, bounds, d), -30, 30)))
            g = (p - y[rows]) / len(rows)
            model.w0 -= 0.05 * g.sum()
            hit, inverse = np.unique(bucket, return_inverse=True)
            gx = g[owner] * x
            gv = gx[:, None] * (first[owner] - vx)
            grads = {
                "w": np.bincount(inverse, gx),
                "v": np.stack([np.bincount(inverse, gv[:, f]) for f in range(gv.shape[1])], 1),
                "wd": d.T @ g,
                "vd": d.T @ (g[:, None] * first) - (d**2).T @ g[:, None] * model.vd,
            }
            for k, grad in grads.items():
                at_k = hit if k in ("w", "v") else slice(None)
                value, (a, b) = getattr(model, k), moment[k]
                grad = grad + 1e-4 * value[at_k]
                a[at_k] = 0.9 * a[at_k] + 0.1 * grad
                b[at_k] = 0.99 * b[at_k] + 0.01 * grad**2
                value[at_k] -= 0.02 * (a[at_k] / (1 - 0.9**step)) / (np.sqrt(b[at_k] / (1 - 0.99**step)) + 1e-8)
    return model


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    """Dense features of a block: structure, then metadata columns ``m0, m1, ...`` as signed logs, null as 0."""
    raw = structure(Texts(batch.column("text")))
    extra = [c for c in batch.schema.names if c[0] == "m" and c[1:].isdigit()]
    more = [batch.column(c).fill_null(0.0).to_numpy(zero_copy_only=False) for c in extra]
    more = [np.nan_to_num(np.sign(v) * np.log1p(np.abs(v))) for v in more]
    return np.concatenate([raw, np.stack(more, 1)], 1) if more else raw


def _featurise(batches):
    for batch in blocks(batches, "text"):
        bucket, x, bounds = hashed_words(Texts(batch.column("text")))
        raw = _columns(batch)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("y"),
                pa.array([bucket[a:b].astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.list_(pa.int32())),
                pa.array([x[a:b].astype(np.float32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.list_(pa.float32())),
                pa.array(list(raw), pa.list_(pa.float64())),
            ],
            ["y", "bucket", "x", "dense"],
        )


def _inputs(docs: DataFrame, text: str, metadata: tuple[str, ...]):
    return [F.col(text).alias("text"), *(F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata))]


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "y", metadata: tuple[str, ...] = (), rank: int = 8, rounds: int = 12) -> Machine | None:
    """A machine from rows with a 0/1 label; None where no row has one.

    All of ``labelled`` reaches the driver as hashed features: give a bounded sample.
    """
    rows = labelled.filter(F.col(label_col).isNotNull()).select(F.col(label_col).cast("double").alias("y"), *_inputs(labelled, text_col, metadata))
    got = rows.mapInArrow(_featurise, "y double, bucket array<int>, x array<float>, dense array<double>").toArrow()
    if not got.num_rows:
        return None
    order = np.lexsort([got["dense"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)[:, 0], got["y"].to_numpy()])
    bucket, x = got["bucket"].combine_chunks(), got["x"].combine_chunks()
    sparse = [(bucket[int(i)].values.to_numpy(), x[int(i)].values.to_numpy().astype(float)) for i in order]
    raw = got["dense"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)[order]
    return fit(sparse, raw, got["y"].to_numpy()[order], rank, rounds)


def _score(shared, keep):
    def run(batches):
        model: Machine = shared.value
        for batch in blocks(batches, "text"):
            bucket, x, bounds = hashed_words(Texts(batch.column("text")))
            z = model.logits(bucket, x, bounds, model.dense(_columns(batch)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*keep, "score"])

    return run


def score(docs: DataFrame, model: Machine | None, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = (), threshold: float = 0.3) -> DataFrame:
    """``(id_col, score, predicted)``, one row per row of ``docs``.

    Null texts are empty; an empty text is scored by its statistics, which are 0, and its metadata; null
    metadata counts as 0. Without a model every score is 0.5. Ids may be null or repeat; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("__id"), *_inputs(docs, text_col, metadata))
    if model is None:
        out = rows.select("__id", F.lit(0.5).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        out = rows.mapInArrow(_score(shared, ["__id"]), f"__id {rows.schema['__id'].dataType.simpleString()}, score double")
    return out.select(F.col("__id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = 8_000, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``y`` for about ``rows`` labelled ids at most: those whose hash falls under ``rows`` of all labelled ids.

    The chosen ids are broadcast, ``rows`` bounds them. Null labels are left out; of an id with several labels the smallest counts,
    and of rows that repeat an id the one with the smallest hash, so ``rows`` bounds the sample too.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).alias("y"))
    share = rows / max(known.count(), 1)
    chosen = known.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 32)) / float(1 << 32) < share)
    met = docs.join(F.broadcast(chosen), id_col)
    row = F.struct(*[F.col(f"`{c}`") for c in met.columns])
    return met.groupBy(F.col(id_col).alias("id")).agg(F.min_by(row, F.xxhash64(row)).alias("row")).select("row.*")
