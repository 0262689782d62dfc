"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import docstats
from .store import cut
from .textops import blocks, column

FOLDS, HELD_OUT = 5, 0
#: Random features, the kernel's width, and the ridge: the model is FEATURES weights whatever the corpus' size.
FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 9
#: Scores are calibrated over so many bins of equal width.
BINS = 2000
PREDICT_AT = 0.3
#: A task sums the normal equations of about so many rows: its sums are a quarter of what it read.
SUM_ROWS = 100_000


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, 22): statistics of whole texts, on scales on which a Gaussian kernel makes sense."""
    w, hashes, m = docstats.measure(texts)
    kinds = m["classes"].astype(float)
    total = np.maximum(kinds.sum(1), 1)
    n = np.maximum(m["n_words"], 1)
    keys = np.unique((w.text_of.astype(np.uint64) << np.uint64(32)) | w.codes.astype(np.uint64))
    distinct = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(texts))
    length = pc.utf8_length(w.distinct).to_numpy().astype(float) if len(w.distinct) else np.zeros(0)
    short = w.sums(length[w.codes] <= 3)
    spread = w.sums((length[w.codes] - np.repeat(m["word_chars"] / n, w.counts)) ** 2)
    share = np.sqrt(kinds[:, 1:14] / total[:, None])
    return np.column_stack([
        share,
        np.log1p(m["n_words"]),
        m["word_chars"] / n,
        np.sqrt(spread / n),
        short / n,
        distinct / n,
        m["n_repeat_words"] / n,
        m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
        np.log1p(n / np.maximum(m["n_lines"], 1)),
        np.log1p(n / (kinds[:, docstats._STOP] + 1)),
    ])


def _statistics_batches(batches):
    for batch in batches:
        for part in blocks(batch):
            x = statistics(column(part)).astype(np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat], names=["doc_id", "x"])


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(fourier((x - self.centre) / self.scale) @ self.weights, self.knots, self.values), 0, 1)


def fourier(x: np.ndarray) -> np.ndarray:
    """A bias and FEATURES cosines whose inner products approach exp(-|x - y|^2 / (2 d WIDTH^2 / 9)), d statistics."""
    rng, d = np.random.default_rng(SEED), x.shape[1]
    directions = rng.normal(size=(d, FEATURES)) * (3 / (WIDTH * np.sqrt(d)))
    return np.column_stack([np.ones(len(x)), np.sqrt(2 / FEATURES) * np.cos(np.clip(x, -8, 8) @ directions + rng.uniform(0, 2 * np.pi, FEATURES))])


def _matrix(batch) -> np.ndarray:
    lists = batch.column("x")
    return lists.flatten().to_numpy().reshape(len(lists), -1).astype(float)


def _normal_batches(batches, centre, scale):
    """Per task and fold: the rows of Z'Z and Z'y."""
    sums, task = {}, 0
    for batch in batches:
        z, y, fold = fourier((_matrix(batch) - centre) / scale), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        if len(z):
            task = batch.column("task")[0].as_py()
        for f in np.unique(fold):
            zf = z[fold == f]
            sums[int(f)] = sums.get(int(f), 0) + zf.T @ np.column_stack([zf, y[fold == f]])
    for f, a in sums.items():
        yield _rows_of(np.full(len(a), f), np.arange(len(a)), a, task)


def _rows_of(fold, i, rows, task) -> pa.RecordBatch:
    lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(fold, np.int64)), pa.array(np.asarray(i, np.int64)), pa.array(np.full(len(rows), task, np.int32)), lists], names=["fold", "i", "task", "row"])


def _add_batches(batches):
    """Of rows sorted by fold, i and task: the sum of each (fold, i), of which one is held."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        fold, i, rows = batch.column("fold").to_numpy(), batch.column("i").to_numpy(), batch.column("row").flatten().to_numpy().reshape(batch.num_rows, -1)
        lead = np.flatnonzero(np.append(True, (fold[1:] != fold[:-1]) | (i[1:] != i[:-1])))
        sums, keys = np.add.reduceat(rows, lead, axis=0), [(int(fold[k]), int(i[k])) for k in lead]
        if held is not None and held[0] == keys[0]:
            sums[0] += held[1]
        elif held is not None:
            keys, sums = [held[0], *keys], np.concatenate([held[1][None], sums])
        held = keys[-1], sums[-1].copy()
        if len(keys) > 1:
            yield _rows_of([k[0] for k in keys[:-1]], [k[1] for k in keys[:-1]], sums[:-1], 0)
    if held is not None:
        yield _rows_of([held[0][0]], [held[0][1]], held[1][None], 0)


def _bin_batches(batches, centre, scale, weights):
    """Counts and labels by bin of each row's score under the weights fitted without its fold."""
    n, hits = np.zeros(BINS), np.zeros(BINS)
    for batch in batches:
        z, fold = fourier((_matrix(batch) - centre) / scale), batch.column("fold").to_numpy()
        raw = np.einsum("ij,ij->i", z, np.stack([weights[int(f)] for f in fold])) if len(fold) else np.zeros(0)
        at = _bin(raw)
        n += np.bincount(at, minlength=BINS)
        hits += np.bincount(at, batch.column("y").to_numpy(), minlength=BINS)
    there = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there]), pa.array(hits[there])], names=["bin", "n", "hits"])


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def _isotonic(n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the calibration: pooled adjacent violators over the bins, one knot at the middle of each pool."""
    pools: list[list[float]] = []
    for b in np.flatnonzero(n):
        middle = (b + 0.5) / BINS * 2 - 0.5
        pools.append([n[b], hits[b], middle * n[b]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + c for a, c in zip(pools[-1], last)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def fit(train: DataFrame) -> Model | None:
    """The model of rows (x, y, fold); None without rows. All sums cover all rows; the driver gets sums of fixed size."""
    size = train.select(F.max(F.size("x"))).first()[0]
    if not size:
        return None
    xs = [F.col("x")[k].cast("double") for k in range(size)]
    moments = train.agg(*(f(x) for x in xs for f in (F.avg, F.stddev_pop))).first()
    centre, scale = np.array(moments[0::2], float), np.array(moments[1::2], float)
    scale = np.where(scale > 1e-9, scale, 1.0)
    schema = "fold long, i long, task int, row array<double>"
    tasks = train.repartition(max(1, -(-train.count() // SUM_ROWS))).withColumn("task", F.spark_partition_id())
    rows = tasks.mapInArrow(partial(_normal_batches, centre=centre, scale=scale), schema)
    rows = rows.repartition("fold", "i").sortWithinPartitions("fold", "i", "task").mapInArrow(_add_batches, schema)
    sums: dict[int, np.ndarray] = {}
    for r in rows.collect():  # folds x features
        sums.setdefault(r.fold, np.zeros((FEATURES + 1, FEATURES + 2)))[r.i] = r.row
    ridge = lambda a: np.linalg.solve(a[:, :-1] + RIDGE * max(1.0, a[0, 0]) / FEATURES * np.eye(len(a)), a[:, -1])
    whole = sum(sums.values())
    weights = {f: ridge(whole - a if len(sums) > 1 else a) for f, a in sums.items()}
    binned = train.mapInArrow(partial(_bin_batches, centre=centre, scale=scale, weights=weights), "bin long, n double, hits double")
    n, hits = np.zeros(BINS), np.zeros(BINS)
    for r in binned.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect():  # at most BINS rows
        n[r.bin], hits[r.bin] = r.n, r.hits
    return Model(centre, scale, ridge(whole), *_isotonic(n, hits))


def _score_batches(batches, model):
    for batch in batches:
        score = model.score(_matrix(batch)) if model else np.full(batch.num_rows, 0.5)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])


def fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Statistics of whole texts are computed once and kept; labels come from rows whose crc32(doc_id) mod 5 isn't 0 and
    enter sums only. Null and empty texts have all counts 0 and are scored too. A document with several labels counts
    once, with their mean. Without labels every score is 0.5. Repeated rows and equal texts are scored alike, a score at
    the limit counts as 1, texts of any length are read whole, a null doc_id has the fold of the empty text. No rows give
    no rows; other columns aren't read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    stats = cut(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_statistics_batches, f"doc_id {kind}, x array<float>"))
    y = labels.where("quality IS NOT NULL").where(fold() != HELD_OUT).groupBy(F.col("doc_id").alias("__id")).agg(F.avg("quality").cast("double").alias("y"))
    train = cut(stats.join(y, F.col("doc_id") == F.col("__id")).select("x", "y", fold().alias("fold")))
    scored = stats.mapInArrow(partial(_score_batches, model=fit(train)), f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
