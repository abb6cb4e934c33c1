"""Declared schemas of the normalised posting and of the eleven operational tables; closed sets; schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "timestamp": T.TimestampType(),
    "date": T.DateType(), "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()),
}


def _schema(ddl: str) -> T.StructType:
    """`name type [not null], ...`, without a session."""
    parts = (field.split() for field in ddl.split(", "))
    return T.StructType([T.StructField(p[0], _TYPES[p[1]], len(p) == 2) for p in parts])


POSTING = _schema(
    "id string not null, source string not null, source_id string not null, company string not null, title string not null, "
    "url string not null, location string, remote boolean not null, salary string, salary_is_estimated boolean not null, "
    "description string not null, posted_at timestamp, fetched_at timestamp not null, content_hash string not null, cross_source_key string not null"
)

TABLES: dict[str, T.StructType] = {
    "users": _schema("id bigint, email string, created_at timestamp"),
    "profiles": _schema("user_id bigint, headline string, summary string, resume_text string, target_titles array<string>, updated_at timestamp"),
    "skills": _schema("id bigint, user_id bigint, skill string, level string"),
    "job_postings": POSTING,
    "job_embeddings": _schema("id string, job_id string, chunk_index int, chunk_text string, embedding array<float>, model_name string, content_hash string, chunker_version string"),
    "job_scores": _schema("job_id string, user_id bigint, fit_score int, reason string, model_name string, scored_at timestamp"),
    "saved_jobs": _schema("user_id bigint, job_id string, note string, saved_at timestamp"),
    "applications": _schema("id bigint, user_id bigint, job_id string, status string, applied_at timestamp, updated_at timestamp, follow_up_on date"),
    "interview_notes": _schema("id bigint, application_id bigint, note string, created_at timestamp"),
    "contacts": _schema("id bigint, user_id bigint, company string, name string, role string, notes string, created_at timestamp"),
    "analytics_daily": _schema("day date, metric string, dimension string, value bigint, computed_at timestamp"),
}

# Application statuses, in their order; those that close an application.
STATUSES = ("interested", "applied", "screening", "interviewing", "offer", "rejected", "withdrawn")
CLOSED_STATUSES = ("offer", "rejected", "withdrawn")

# Which source wins a tie (lower first), and the priority of any other.
SOURCE_PRIORITY = {"greenhouse": 0, "ashby": 0, "lever": 0, "breezy": 0, "workday": 1, "usajobs": 2, "remotive": 3, "adzuna": 4}
DEFAULT_PRIORITY = 9

# Widths of known embedding models.
MODEL_WIDTHS = {
    "sentence-transformers/all-MiniLM-L6-v2": 384,
    "sentence-transformers/all-MiniLM-L12-v2": 384,
    "sentence-transformers/all-mpnet-base-v2": 768,
    "sentence-transformers/paraphrase-multilingual-mpnet-base-v2": 768,
    "BAAI/bge-small-en-v1.5": 384,
    "BAAI/bge-base-en-v1.5": 768,
    "BAAI/bge-large-en-v1.5": 1024,
}


class SchemaMismatch(ValueError):
    """A table does not have the declared columns or vector width."""


def model_width(model: str) -> int:
    if model not in MODEL_WIDTHS:
        raise ValueError(f"unknown embedding model {model!r}; known: {', '.join(sorted(MODEL_WIDTHS))}")
    return MODEL_WIDTHS[model]


def verify(df: DataFrame, schema: T.StructType, name: str = "table") -> DataFrame:
    """`df` with its columns in declared order; raises if a name or type differs."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name, None) and have[f.name].simpleString()} is not {f.dataType.simpleString()}" for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise SchemaMismatch(f"{name}: {'; '.join(wrong)}")
    return df.select(*schema.names)


def verify_vectors(df: DataFrame, width: int, column: str = "embedding") -> None:
    """Raise if any vector has another width; one aggregation."""
    bad = df.where(F.size(column) != width).limit(1).count()
    if bad:
        raise SchemaMismatch(f"{column}: a vector is not {width} wide")
