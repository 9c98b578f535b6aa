"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_arrow, raw, remainder, slices

FOLDS, FOLD = 5, 0


def held_out(key: Column) -> Column:
    return remainder(key, FOLDS) == FOLD


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, limit: int, extract: Callable[[], Callable[[bytes], dict]], fields: dict[str, pa.DataType], key: str = "doc_id", text: str = "text") -> pa.Table:
    """key, label (0 or 1) and the features of at most ``limit`` labelled keys that aren't held out, ascending by key.

    The keys with the smallest hash are taken, so the sample doesn't depend on
    the order of rows. Null keys and labels are left out; of several labels for
    a key the largest counts, of several texts the one with the smallest hash.
    Only the keys are broadcast. However often a key is repeated, a task passes
    on one row of it, and the driver gets ``limit`` rows at most. ``extract`` is
    called in each task and gives the function from a text to its features.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("k")).agg((F.max(label) > 0).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("k"), "k").limit(limit)
    rows = docs.select(F.col(key), F.col(text)).join(F.broadcast(known), F.col(key) == F.col("k")).select(F.col(key).alias("key"), F.col(text).alias("text"), "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, best, kind = extract(), {}, None
        for batch in batches:
            kind = batch.schema.field("key").type
            for part in slices(batch):
                for k, mark, data in zip(part.column("key").to_pylist(), part.column("label").to_pylist(), raw(part.column("text"))):
                    digest = xxhash.xxh3_64_intdigest(data) >> 1
                    if k not in best or digest < best[k][0]:
                        best[k] = (digest, mark, of(data))
        if best:
            columns = {"key": pa.array(list(best), kind), "mark": pa.array([b[0] for b in best.values()], pa.int64()), "label": pa.array([b[1] for b in best.values()], pa.int32())}
            yield pa.record_batch(columns | {f: pa.array([b[2][f] for b in best.values()], t) for f, t in fields.items()})

    def spark_type(t: pa.DataType) -> str:
        return f"array<{spark_type(t.value_type)}>" if pa.types.is_list(t) else {pa.int32(): "int", pa.int64(): "bigint"}[t]

    schema = ", ".join([f"key {rows.schema['key'].dataType.simpleString()}, mark bigint, label int", *(f"{f} {spark_type(t)}" for f, t in fields.items())])
    found = map_arrow(rows, run, schema).groupBy("key").agg(F.min(F.struct("mark", "label", *fields)).alias("x")).select("key", "x.label", *(f"x.{f}" for f in fields))
    return found.toArrow().sort_by("key").combine_chunks()


def ragged(table: pa.Table, column: str):
    """Offsets and values of a list column, as numpy arrays."""
    import numpy as np

    chunk = table.column(column).combine_chunks()
    chunk = chunk.chunk(0) if isinstance(chunk, pa.ChunkedArray) and chunk.num_chunks else chunk
    if not len(table):
        return np.zeros(1, np.int64), np.empty(0, np.int64)
    return chunk.offsets.to_numpy().astype(np.int64), chunk.values.to_numpy().astype(np.int64)


def fit_sigmoid(x, y, rounds: int = 100) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a x + b))), by Newton's method on smoothed targets."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        w, g = p * (1 - p), p - target
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * x).sum() + 1e-3 * a, g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)
