"""Exact cosine search over chunks with two rounds of deduplication, and the stages that make vectors."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Iterator, Sequence
from datetime import datetime
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import VERSION, chunk_postings
from ..functions.text import content_hash
from ..schemas import TABLES, model_width
from .ingest import first_of
from .reads import Filters
from .scoring import profile_queries
from .store import Store
from .vector_index import VectorIndex
from .writes import Writes

OVERFETCH, LEAST_CANDIDATES = 10, 100


class WrongWidth(ValueError):
    pass


def cosine(vectors: Column, query: Sequence[float]) -> Column:
    """Cosine similarity to a constant vector, in double precision: one matrix product for each Arrow batch. Null for a null, empty or zero vector, or one of another width."""
    q = np.asarray(query, np.float64)
    q = q / max(float(np.linalg.norm(q)), 1e-300)

    @F.arrow_udf("double")
    def similarity(column: pa.Array) -> pa.Array:
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        fits = np.flatnonzero(sizes == len(q))
        x = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
        out = np.full(len(column), np.nan)
        out[fits[length > 0]] = (x[length > 0] @ q) / length[length > 0]
        return pa.array(out, mask=np.isnan(out))

    return similarity(vectors)


def search(
    embeddings: DataFrame, postings: DataFrame, query: Sequence[float] | Sequence[Sequence[float]], as_of: datetime, top_k: int = 25,
    filters: Filters = Filters(), model: str | None = None, scores: DataFrame | None = None, index: VectorIndex | None = None,
) -> DataFrame:
    """The nearest jobs: filter, the nearest candidate chunks, the best chunk of each job, the best job of each cross-source key.

    The filter stands before the candidate limit, which Catalyst could not move it across. An `index` of the embeddings
    (`vector_index.VectorIndex`) opens part of them, all else being equal; without one the search is exact. `scores`
    (id, fit_score) are joined on top, and only vectors of `model` are compared where one is named. Of several queries, a
    chunk's nearest counts.
    """
    queries = [query] if np.ndim(query) == 1 else list(query)
    if model is not None and len(queries[0]) != model_width(model):
        raise WrongWidth(f"{model} has {model_width(model)} dimensions, the query {len(queries[0])}")
    similar = [cosine(F.col("embedding"), q) for q in queries]
    distance = 1 - (F.greatest(*similar) if len(similar) > 1 else similar[0])
    wanted = postings.where(filters.predicate(as_of))
    if scores is not None and filters.min_score is not None:
        # a job that scores too low must not take a candidate's place
        wanted = wanted.join(scores.where(F.col("fit_score") >= filters.min_score).select("id"), "id", "left_semi")
    wanted = wanted.select(F.col("id").alias("job_id"), "cross_source_key")
    if index is not None:
        embeddings = index.rows(queries, wanted, max(OVERFETCH * top_k, LEAST_CANDIDATES))
    rows = embeddings.where(F.col("model_name") == model) if model is not None else embeddings
    near = rows.join(wanted, "job_id").select("job_id", "cross_source_key", "chunk_index", "chunk_text", distance.alias("distance"))
    near = near.where("distance IS NOT NULL").orderBy("distance", "job_id", "chunk_index").limit(max(OVERFETCH * top_k, LEAST_CANDIDATES))
    best = first_of(near, ["job_id"], [F.asc("distance"), F.asc("chunk_index")])
    best = first_of(best, ["cross_source_key"], [F.asc("distance"), F.asc("job_id")])
    out = best.select(F.col("job_id").alias("id"), F.col("chunk_text").alias("matched_text"), "distance", (1 - F.col("distance")).alias("similarity")).join(postings, "id")
    if scores is not None:
        out = out.join(scores, "id", "left")
    return out.orderBy("distance", "id").limit(top_k)


class Encoder(Protocol):
    """Anything that turns texts into unit vectors. Made once in each worker from a picklable factory."""

    name: str
    width: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """A deterministic stand-in without weights: signed hashed words, normalised. Not a semantic model."""

    def __init__(self, width: int = 64):
        self.name, self.width = f"hashing-{width}", width

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                out[row, h % self.width] += 1.0 if h >> 31 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


_encoders: dict[str, Encoder] = {}


#: rows that leave the encoder at once
ENCODED_ROWS = 1024


def encoded(chunks: DataFrame, factory, name: str, width: int, batch: int = 64) -> DataFrame:
    """`chunks` with embedding and model_name; the encoder is made once in a worker, texts go in batches, widths are checked.

    Rows stay in Arrow and leave in slices, so a worker holds the vectors of one slice, whatever the batches it is given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(name, None) or factory()
        _encoders[name] = encoder
        for whole in batches:
            for at in range(0, whole.num_rows, ENCODED_ROWS):
                own = whole.slice(at, ENCODED_ROWS)
                texts = own.column("chunk_text").to_pylist()
                vectors = np.concatenate([encoder.encode(texts[k : k + batch]) for k in range(0, len(texts), batch)])
                if vectors.shape[1] != width:
                    raise WrongWidth(f"{name} gave vectors of {vectors.shape[1]}, not {width}")
                flat = pa.array(np.ascontiguousarray(vectors, np.float32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * width, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*own.columns, lists, pa.array([name] * len(texts))], [*own.schema.names, "embedding", "model_name"])

    names = [c for c in chunks.columns if c not in ("embedding", "model_name")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.select(*names).schema) + ", embedding array<float>, model_name string"
    return chunks.select(*names).mapInArrow(run, schema)


def pending(postings: DataFrame, embeddings: DataFrame, model: str, limit: int | None = 500, version: str = VERSION) -> DataFrame:
    """Postings with a description and no vectors of this text, model and chunker, oldest first."""
    done = embeddings.where((F.col("model_name") == model) & (F.col("chunker_version") == version)).select(F.col("job_id").alias("id"), "content_hash").distinct()
    hashed = postings if "content_hash" in postings.columns else postings.withColumn("content_hash", content_hash(F.col("description")))
    out = hashed.where(F.coalesce("description", F.lit("")) != "").join(done, ["id", "content_hash"], "left_anti")
    return out.orderBy("fetched_at", "id").limit(limit) if limit else out


def embed(postings: DataFrame, factory, name: str, width: int) -> DataFrame:
    """Rows of the vector table for postings: chunk, encode."""
    rows = encoded(chunk_postings(postings), factory, name, width).withColumn("chunker_version", F.lit(VERSION))
    return rows.select(*TABLES["job_embeddings"].names)


def match_profile(embeddings: DataFrame, postings: DataFrame, profile: dict, encoder: Encoder, as_of: datetime, top_k: int = 25, filters: Filters = Filters(), scores: DataFrame | None = None) -> DataFrame:
    """The jobs nearest to a profile: the resume in parts, each under the profile's head, or the profile as one query."""
    queries = encoder.encode(profile_queries(profile))
    own = embeddings.where(F.col("model_name") == encoder.name)
    return search(own, postings, [q.tolist() for q in queries], as_of, top_k, filters, scores=scores)


def embed_pending(store: Store, factory, name: str, width: int, limit: int = 500, rounds: int = 1, reset: bool = False) -> dict:
    """Embed what has no vectors of its present text, model and chunker, in rounds of `limit` postings; says what was done.

    What is pending is told from the data, so a run that dies is gone on with by the next. Each round is one write.
    """
    writes, began = Writes(store), time.monotonic()
    if reset:
        writes.reset_vectors()
    done = {"jobs_embedded": 0, "chunks_written": 0, "rounds": 0}
    for _ in range(rounds):
        rows = embed(pending(store.read("job_postings"), store.read("job_embeddings"), name, limit), factory, name, width).persist()
        try:
            jobs, chunks = rows.agg(F.countDistinct("job_id"), F.count("*")).first()
            if not jobs:
                break
            writes.replace_vectors(rows, width)
        finally:
            rows.unpersist()
        done = {"jobs_embedded": done["jobs_embedded"] + jobs, "chunks_written": done["chunks_written"] + chunks, "rounds": done["rounds"] + 1}
    left = pending(store.read("job_postings"), store.read("job_embeddings"), name, limit=None).count()
    return done | {"still_pending": left, "seconds": round(time.monotonic() - began, 1)}
