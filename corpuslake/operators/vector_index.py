"""Inverted-file index over vectors: cells around fitted centroids, searched in the cells nearest to a query.

The centroids are fitted on a bounded sample; every vector is then assigned to its cell, and a query to as many of its nearest cells
as the sample showed to hold the wanted share of true neighbours.  Query and corpus meet in an equi-join on the cell, in the grid of bounded
tasks of ``exact_topk``, so a hot cell is split like any hot key.  Work per query is the probed cells' share of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import exact_topk

_SLICE = 1024
#: Rows of a frame that repeats vectors, once per probed cell.
_FRAME_ROWS = 8192


@dataclass(frozen=True)
class CellIndex:
    """Unit centroids, one a row, and how many cells a query looks into."""

    centroids: np.ndarray
    probes: int


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _fit(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Spherical k-means from evenly spaced members of the sample; a cell that empties keeps its centroid."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(sample[i:i + _SLICE] @ centroids.T, axis=1) for i in range(0, len(sample), _SLICE)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        filled = np.bincount(own, minlength=cells) > 0
        centroids = np.where(filled[:, None], _unit(sums), centroids)
    return centroids


def _probes(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float, asks: int) -> int:
    """The least number of cells that holds ``recall`` of the true neighbours that sample rows have in the sample."""
    asking = sample[np.linspace(0, len(sample) - 1, min(asks, len(sample))).astype(int)]
    near = min(k + 1, len(sample))  # a row is its own nearest
    place = np.argsort(np.argsort(-(asking @ centroids.T), axis=1), axis=1)
    own = np.concatenate([np.argmax(sample[i:i + _SLICE] @ centroids.T, axis=1) for i in range(0, len(sample), _SLICE)])
    true = np.argpartition(-(asking @ sample.T), near - 1, axis=1)[:, :near]
    needed = np.sort(np.take_along_axis(place, own[true], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def fit_cells(vectors: DataFrame, k: int = 5, cells: int | None = None, sample_rows: int = 20000, recall: float = 0.97,
              rounds: int = 8, asks: int = 400) -> CellIndex:
    """An index fitted on the ``sample_rows`` rows whose ids have the smallest hashes (the only rows that reach the driver).

    ``cells`` defaults to the square root of the row count, within one cell for 16 sample rows.  ``recall`` is the share of true neighbours,
    as measured on the sample, that the probed cells shall hold.  An empty table gives one cell.
    """
    rows = vectors.filter(F.col("vec").isNotNull())
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vec").toPandas()
    if taken.empty:
        return CellIndex(np.zeros((1, 1)), 1)
    sample = _unit(np.stack(taken["vec"].to_numpy()).astype(np.float64))
    wanted = cells or int(np.ceil(np.sqrt(rows.count())))
    centroids = _fit(sample, max(1, min(wanted, len(sample) // 16 or 1)), rounds)
    return CellIndex(centroids, _probes(sample, centroids, k, recall, asks))


def _near(frame: pd.DataFrame, centroids: np.ndarray, count: int) -> Iterator[pd.DataFrame]:
    """The rows of a frame, each ``count`` times with its nearest cells; the more cells, the fewer rows at once."""
    step = max(1, min(_SLICE, _FRAME_ROWS // count))
    for i in range(0, len(frame), step):
        part = frame.iloc[i:i + step]
        near = -(np.stack(part["vec"].to_numpy()).astype(np.float64) @ centroids.T)
        cells = np.argpartition(near, count - 1, axis=1)[:, :count]
        again = np.repeat(np.arange(len(part)), count)
        yield pd.DataFrame({"cell": cells.ravel().astype(np.int32), "id": part["id"].to_numpy()[again], "vec": part["vec"].to_numpy()[again]})


def assign_cells(vectors: DataFrame, index: CellIndex, probes: int = 1) -> DataFrame:
    """``(cell, id, vec)``: every vector with its ``probes`` nearest cells.  Null vectors have no cell."""
    rows = vectors.filter(F.col("vec").isNotNull()).select("id", "vec")
    count = min(probes, len(index.centroids))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from _near(frame, index.centroids, count)

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(run, f"cell int, id {kind['id']}, vec {kind['vec']}")


def topk_by_cells(queries: DataFrame, corpus: DataFrame, index: CellIndex, k: int, exclude_same_id: bool = False) -> DataFrame:
    """``(query_id, id, score, rank)`` as ``exact_topk`` gives, among the corpus rows of each query's probed cells."""
    return exact_topk(assign_cells(queries, index, index.probes), assign_cells(corpus, index), k, match_on="cell", exclude_same_id=exclude_same_id)


def recall_at(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``(queries, wanted, found)``: how many of the exact neighbours the index found."""
    pairs = found.select("query_id", "id", F.lit(1).alias("hit"))
    return truth.join(pairs, ["query_id", "id"], "left").agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
