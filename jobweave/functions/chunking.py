"""Overlapping, word-aligned windows of a text, and the chunks of a posting."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import content_hash, context_header, embedding_id

SIZE, OVERLAP, LEAST_BODY = 800, 100, 200
VERSION = f"{SIZE}/{OVERLAP}/1"

_PARAGRAPH, _SENTENCE, _SPACE = re.compile(r"(?=\n\n)"), re.compile(r"[.!?](?=[ \n])"), re.compile(r"\s")


def chunk_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Windows of at most `size` code points that overlap by about `overlap`.

    A window ends at its last paragraph, else at its last sentence, if that leaves it more than half full; else at its
    last white space; else it is cut. All ends a text offers are found once and looked up by bisection.
    """
    if not isinstance(text, str):
        raise TypeError(f"text must be a string, not {type(text).__name__}")
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"need size > overlap >= 0, got size {size} and overlap {overlap}")
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    spaces = [k for k, c in enumerate(text) if c.isspace()]
    paragraphs = [m.start() for m in _PARAGRAPH.finditer(text)]
    sentences = [m.start() for m in _SENTENCE.finditer(text)]

    def last(places: list[int], below: int) -> int:
        k = bisect_left(places, below)
        return places[k - 1] if k else -1

    out, start = [], 0
    while True:
        end = min(start + size, len(text))
        if end < len(text):
            half = start + int((end - start) * 0.5)
            sentence = last(sentences, end - 1)
            options = (last(paragraphs, end - 1), sentence + 1 if sentence > start else -1)
            end = next((e for e in options if e > half), None) or max((s for s in (last(spaces, end),) if s > start), default=end)
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        if end >= len(text):
            return out
        floor = start + 1
        back = max(end - overlap, floor)
        before = bisect_right(spaces, back - 1)
        start = max(floor, spaces[before - 1] + 1 if before else 0)


def _pieces(size_of_header: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([chunk_text(t, max(SIZE - h, LEAST_BODY)) if t else [] for h, t in zip(size_of_header, text, strict=True)])


chunks_udf = F.pandas_udf(_pieces, T.ArrayType(T.StringType()))


def chunks(text: Column, header: Column | None = None) -> Column:
    """Array of windows; the header's length is taken off the window."""
    header = header if header is not None else F.lit("")
    return chunks_udf(F.char_length(header), F.coalesce(text, F.lit("")))


def chunk_postings(postings: DataFrame) -> DataFrame:
    """Rows (id, job_id, chunk_index, chunk_text, content_hash) of postings with a description."""
    header = context_header(F.col("title"), F.col("company"), F.col("location"))
    hashed = F.col("content_hash") if "content_hash" in postings.columns else content_hash(F.col("description"))
    rows = postings.where(F.coalesce("description", F.lit("")) != "").select(F.col("id").alias("job_id"), hashed.alias("content_hash"), header.alias("__header"), "description")
    rows = rows.withColumn("__pieces", chunks(F.col("description"), F.col("__header")))
    rows = rows.select("job_id", "content_hash", "__header", F.posexplode("__pieces").alias("chunk_index", "__piece"))
    return rows.select(embedding_id(F.col("job_id"), F.col("chunk_index")).alias("id"), "job_id", "chunk_index", F.concat("__header", "__piece").alias("chunk_text"), "content_hash")


class Chunks:
    """Table function: the windows of a text as rows (chunk_index, chunk_text), for SQL: `SELECT * FROM jobs, LATERAL chunks(description, 800, 100)`."""

    def eval(self, text: str, size: int, overlap: int):
        yield from enumerate(chunk_text(text, size, overlap) if text else [])


chunks_table = F.udtf(Chunks, returnType="chunk_index int, chunk_text string")
