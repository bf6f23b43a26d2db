"""Embedding, vector top-k, query rewriting and resource lookup."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions.exprs import unnest

#: Rows of one side of a cell.  Every row is copied once per cell of the other side, so what is shuffled falls as cells grow.
CELL_ROWS = 16384
_SLICE_ROWS = 512
_WORD = re.compile(r"\w+")
_SCORE_DIGITS = 9


# ------------------------------------------------------------------- embedding
def _embedder(make_model: Callable[[], Callable[[list[str]], np.ndarray]]):
    holder: dict = {}

    @F.pandas_udf("array<float>")
    def embed(values: pd.Series) -> pd.Series:
        if "model" not in holder:
            holder["model"] = make_model()
        vectors = np.asarray(holder["model"](values.fillna("").tolist()), dtype=np.float64)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        unit = vectors / np.where(norms == 0, 1.0, norms)
        return pd.Series(list(unit.astype(np.float32)))

    return embed


def embed_texts(df: DataFrame, text: str, make_model: Callable[[], Callable[[list[str]], np.ndarray]],
                name: str = "embedding") -> DataFrame:
    """Add unit vectors from a pluggable model, one model per Python worker, one call per Arrow batch."""
    return df.withColumn(name, _embedder(make_model)(F.col(text)))


def hashing_model(dimensions: int = 256) -> Callable[[list[str]], np.ndarray]:
    """A model without weights: words are hashed to signed dimensions and counted, damped by the square root."""
    seen: dict[str, tuple[int, float]] = {}

    def place(word: str) -> tuple[int, float]:
        if word not in seen:
            if len(seen) > 1 << 18:
                seen.clear()
            code = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
            seen[word] = (code >> 1) % dimensions, 1.0 if code & 1 else -1.0
        return seen[word]

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for row, text in zip(out, texts):
            for word, n in Counter(_WORD.findall(text.lower())).items():
                at, sign = place(word)
                row[at] += sign * n ** 0.5
        return out

    return embed


def register_embedder(spark: SparkSession, make_model: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_model, name: str = "embed_text") -> None:
    """Make a model an SQL function from a text to its unit vector."""
    spark.udf.register(name, _embedder(make_model))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity of two vectors as a native expression, in double precision."""
    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    return dot(left, right) / F.sqrt(dot(left, left) * dot(right, right))


# ------------------------------------------------------------------------ top-k
def _units(vectors: pd.Series) -> np.ndarray:
    out = np.stack(vectors.to_numpy()).astype(np.float64)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)
    return out


def _cell_scorer(k: int, exclude_same_id: bool):
    def score(cell: pd.DataFrame) -> pd.DataFrame:
        asks = cell[cell["is_query"]]
        rows = cell[~cell["is_query"]]
        if not len(asks) or not len(rows):
            return pd.DataFrame({"query_id": asks["id"].iloc[:0], "id": rows["id"].iloc[:0], "score": pd.Series([], dtype="float64")})
        q, c = _units(asks["vec"]), _units(rows["vec"])
        ids, qids = rows["id"].to_numpy(), asks["id"].to_numpy()
        # Ids ascending inside equal scores: sort rows by id once, then stable sort by score.
        by_id = np.argsort(ids, kind="stable")
        c, ids = c[by_id], ids[by_id]
        own, hit, scores = [], [], []
        for start in range(0, len(q), _SLICE_ROWS):
            sims = np.round(q[start:start + _SLICE_ROWS] @ c.T, _SCORE_DIGITS)
            if exclude_same_id:
                sims[qids[start:start + _SLICE_ROWS, None] == ids[None, :]] = -np.inf
            if len(ids) > 4 * k:
                # Everything not below the k-th best score stays, so ties are decided by id.
                edge = np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k]
            else:
                edge = np.full(len(sims), -np.inf)
            for i, line in enumerate(sims):
                near = np.flatnonzero((line >= edge[i]) & np.isfinite(line))
                best = near[np.argsort(-line[near], kind="stable")][:k]
                own.append(np.full(len(best), start + i))
                hit.append(best)
                scores.append(line[best])
        return pd.DataFrame({"query_id": qids[np.concatenate(own)], "id": ids[np.concatenate(hit)], "score": np.concatenate(scores)})

    return score


def grid_cells(queries: DataFrame, corpus: DataFrame, match_on: str | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(key, id, vec, is_query, i, j): every query once per corpus cell of its key and every corpus row once per query cell."""
    key = F.lit(0) if match_on is None else F.col(match_on)
    asks = queries.select(key.alias("key"), "id", "vec")
    rows = corpus.select(key.alias("key"), "id", "vec")
    cells = F.ceil(F.col("n") / cell_rows).cast("int")
    ask_cells = asks.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", cells.alias("qcells"))
    row_cells = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", cells.alias("ccells"))
    # Without a key the grid is one row, and only that row is broadcast.
    grid = ask_cells.join(row_cells, "key") if match_on else ask_cells.drop("key").crossJoin(F.broadcast(row_cells.drop("key")))

    def spread(side: DataFrame, own: str, other: str, is_query: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        sized = side.join(grid, "key") if match_on else side.crossJoin(F.broadcast(grid))
        return sized.select(
            "key", "id", "vec", F.lit(is_query).alias("is_query"), mine.alias("own"), every.alias("other"))

    left = spread(asks, "qcells", "ccells", True).withColumnsRenamed({"own": "i", "other": "j"})
    right = spread(rows, "ccells", "qcells", False).withColumnsRenamed({"own": "j", "other": "i"})
    return left.unionByName(right)


def exact_topk(queries: DataFrame, corpus: DataFrame, k: int, match_on: str | None = None,
               exclude_same_id: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, id, score, rank): the k most similar corpus rows of every query, exactly.

    Both sides have ``id`` and ``vec``; with ``match_on`` only rows sharing that column are
    compared.  Queries and corpus are cut into cells of about ``cell_rows`` rows and every
    task scores one (query cell, corpus cell) pair with matrix products of bounded slices, keeping
    k rows per query before the shuffle.  Memory per task is two cells whatever the data size, a hot
    ``match_on`` value is spread over its own grid, and no pair is ever materialised.
    """
    id_type = corpus.schema["id"].dataType.simpleString()
    ask_type = queries.schema["id"].dataType.simpleString()
    partial = grid_cells(queries, corpus, match_on, cell_rows).groupBy("key", "i", "j").applyInPandas(
        _cell_scorer(k, exclude_same_id), f"query_id {ask_type}, id {id_type}, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


# -------------------------------------------------------------- query rewriting
def anchor_entity(query: Column, entity: str) -> Column:
    """Replace pronouns by the entity in short queries that do not name it."""
    names = "|".join(fv.POSSESSIVE_WORDS)
    subjects = "|".join(sorted(fv.SUBJECT_WORDS, key=len, reverse=True))
    safe = entity.replace("\\", "\\\\").replace("$", "\\$")
    possessive = F.regexp_replace(query, rf"{tx.I}\b(?:{names})\b", safe + "'s")
    both = F.regexp_replace(possessive, rf"{tx.I}\b(?:{subjects})\b", safe)
    untouched = F.lower(query).contains(entity.lower()) | (tx.word_count(query) > fv.MAX_CONVERSATIONAL_WORDS)
    return F.when(untouched, query).otherwise(both)


def is_followup(query: Column) -> Column:
    """Formatting request, referential word or continuation prefix."""
    text = F.lower(tx.strip(query))
    cues = [fv.FORMATTING_CUE, fv.REFERENTIAL_CUE, fv.CONTINUATION_CUE]
    hit = text.rlike(tx.I + cues[0])
    for cue in cues[1:]:
        hit = hit | text.rlike(tx.I + cue)
    return hit


def contextualize(query: Column, last_user_turn: Column, entity: str) -> Column:
    """Put the latest user turn in front of a follow-up, then anchor the entity."""
    before = tx.strip(F.coalesce(last_user_turn, F.lit("")))
    useful = (before != "") & (F.lower(before) != F.lower(query)) & is_followup(query)
    return anchor_entity(F.when(useful, F.concat_ws(" ", before, query)).otherwise(query), entity)


def expand_by_text(queries: DataFrame, chunks: DataFrame, word: str, limit: int | None = None) -> DataFrame:
    """Append the slugs of the pages that mention ``word``, in slug order, to each query text; with ``limit`` only the first ones.

    Equal slugs are reduced before they are gathered, so what is gathered grows with the names and not with the chunks.
    """
    slugs = (chunks.filter(F.col("text").contains(word) & F.col("slug").isNotNull())
             .select(F.replace(F.col("slug"), F.lit("_"), F.lit(" ")).alias("words")).distinct())
    if limit is not None:
        slugs = slugs.orderBy("words").limit(limit)
    extra = slugs.agg(F.array_join(F.sort_array(F.collect_list("words")), " ").alias("__extra"))
    return (queries.crossJoin(F.broadcast(extra))
            .withColumn("query", F.when(F.col("__extra") == "", F.col("query"))
                        .otherwise(F.concat_ws(" ", "query", "__extra"))).drop("__extra"))


def find_resources(hits: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """Document links in the hits of each query, first per url in rank order."""
    links = unnest(hits, [*keys, rank], tx.document_links(F.col("text")), "l", "n")
    flat = links.select(*keys, F.struct(F.col(rank), F.col("n")).alias("place"),
                        F.col("l.label").alias("label"), F.col("l.url").alias("url"))
    return flat.groupBy(*keys, "url").agg(F.min("place").alias("place"), F.min_by("label", "place").alias("label"))
