"""Resumable calls to outside reviewers, kept in a checkpoint table.

A run is named by what went into it (text, prompt, cut), not by the model. A chunk is done when the table has
a complete row for the run, the chunk and the chunk's hash; everything else is pending. Calls are at least
once: a lost executor repeats its calls, and a result that comes twice is the same row twice, of which the last
counts.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "run_key string, chunk_id long, chunk_sha256 string, status string, findings_json string, error string, provider string, attempts int, updated_at timestamp"

#: A provider takes a chunk's text and returns the answer as JSON text, or raises.
Provider = Callable[[str], str]


def run_key(*parts: str):
    """Column: the name of a run, from the hashes of what went into it."""
    return F.left(F.sha2(F.concat_ws("\x1f", *(F.lit(p) for p in parts)), 256), F.lit(20))


def latest(checkpoint: DataFrame) -> DataFrame:
    """The last row of each run and chunk."""
    rest = [c for c in checkpoint.columns if c not in ("run_key", "chunk_id")]
    top = checkpoint.groupBy("run_key", "chunk_id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", F.coalesce("status", F.lit("")))).alias("_row"))
    return top.select("run_key", "chunk_id", "_row.*")


def done(checkpoint: DataFrame) -> DataFrame:
    """Rows that count as finished: complete, with a list of findings that can be read."""
    ok = F.get_json_object("findings_json", "$.findings").isNotNull() | F.get_json_object("findings_json", "$.issues").isNotNull() | F.trim("findings_json").rlike(r"^\[[\s\S]*\]$")
    return checkpoint.where((F.col("status") == "complete") & ok)


def pending(chunks: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Chunks (chunk_id, chunk_sha256, ...) without a finished row of the same hash; with a run_key, of the same run."""
    keys = [*(["run_key"] if "run_key" in chunks.columns else []), "chunk_id", "chunk_sha256"]
    return chunks.join(done(checkpoint).select(*keys).distinct(), keys, "left_anti")


class Limiter:
    """At most ``rpm`` calls a minute, evenly spaced."""

    def __init__(self, rpm: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep, self.next = 60.0 / rpm, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def call(text: str, providers: list[tuple[str, Provider]], attempts: int = 3, delays: tuple[float, ...] = (15.0, 45.0), sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, str | None, int]:
    """``(answer, provider, error, calls)``: each provider in turn, with retries after growing, jittered delays."""
    calls, error = 0, None
    for name, provider in providers:
        for k in range(attempts):
            calls += 1
            try:
                return provider(text), name, None, calls
            except Exception as e:  # noqa: BLE001 - whatever a provider raises is a failed call
                error = f"{type(e).__name__}: {e}"[:500]
            if k + 1 < attempts:
                sleep(delays[min(k, len(delays) - 1)] * random.uniform(0.7, 1.3))
    return None, None, error, calls


def review(chunks: DataFrame, key: str, providers: list[tuple[str, Provider]], concurrent: int = 3, rpm: float = 15, sleep: Callable[[float], None] = time.sleep, attempts: int = 3) -> DataFrame:
    """Checkpoint rows of the calls for (chunk_id, chunk_sha256, target): one partition a concurrent caller, which share the rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limiter = Limiter(rpm / concurrent, sleep=sleep)
        for batch in batches:
            for chunk, sha, text in zip(*(c.to_pylist() for c in batch.columns)):
                limiter.wait()
                answer, name, error, calls = call(text or "", providers, attempts, sleep=sleep)
                now = int(time.time() * 1e6)
                row = [[key], [chunk], [sha], ["failed" if answer is None else "complete"], [answer], [error], [name], [calls], [now]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.timestamp("us", "UTC")))], ROWS_NAMES)

    return chunks.select(F.col("chunk_id").cast("long"), "chunk_sha256", "target").repartition(concurrent).mapInArrow(run, ROWS)


ROWS_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def run_until_done(chunks: DataFrame, path: str, key: str, providers: list[tuple[str, Provider]], rounds: int = 3, backoff: float = 60.0, sleep: Callable[[float], None] = time.sleep, **settings) -> DataFrame:
    """Calls for what is pending, appends to the table at ``path``, and repeats for what failed; the table's last rows.

    ``path`` is a folder that all executors share. Chunks that fail in every round stay failed; a later run resumes.
    """
    spark = chunks.sparkSession
    for k in range(rounds):
        try:
            have = spark.read.schema(ROWS).parquet(path).where(F.col("run_key") == key)
            left = pending(chunks, have)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            left = chunks
        if left.isEmpty():
            break
        if k:
            sleep(backoff * k)
        review(left, key, providers, sleep=sleep, **settings).write.mode("append").parquet(path)
    return latest(spark.read.schema(ROWS).parquet(path).where(F.col("run_key") == key))


def provider_for(model: str, config: dict[str, dict]) -> tuple[str, dict]:
    """``(provider, settings)`` of a model by a configuration ``{provider: {"models": [...], ...}}``; an unknown model is an error."""
    for provider, settings in config.items():
        models = settings.get("models", {})
        if model in models:
            own = models[model] if isinstance(models, dict) else {}
            return provider, {**{k: v for k, v in settings.items() if k != "models"}, **own}
    raise ValueError(f"unknown model: {model}")
