"""Work lists: every test with every model and run, less what is cached, and how outcomes become rows."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import supports_language

KEY = ("suite_id", "test_id", "provider_id", "model", "run")
# USD for a minute of audio.
PRICES = {("openai", "whisper-1"): 0.006, ("deepgram", "nova-3"): 0.0043, ("deepgram", "nova-2"): 0.0036}
PROVIDER_PRICES = {"openai": 0.01, "groq": 0.0028}
MODELS_AT_MOST = 10_000


def cache_key() -> Column:
    return F.substring(F.sha1(F.concat_ws(":", *[F.col(c).cast("string") for c in KEY])), 1, 16)


def price_per_minute(provider: Column, model: Column) -> Column:
    out = F.lit(0.0)
    for p, v in PROVIDER_PRICES.items():
        out = F.when(provider == p, v).otherwise(out)
    for (p, m), v in PRICES.items():
        out = F.when((provider == p) & (model == m), v).otherwise(out)
    return out


def select_models(models: DataFrame, provider: str | None = None, model: str | None = None) -> DataFrame:
    """A model needs its provider; an unknown choice is an error."""
    if model and not provider:
        raise ValueError("a model needs a provider")
    if provider:
        models = models.where(F.col("provider_id") == provider)
    if model:
        models = models.where(F.col("model") == model)
    if (provider or model) and models.isEmpty():
        raise ValueError(f"no such model: {provider}/{model or '*'}")
    return models


def available(models: DataFrame, providers: DataFrame) -> DataFrame:
    """Models of the providers that can run. ``providers``: provider_id, available; an unknown provider can't."""
    can = providers.where(F.col("available")).select("provider_id").distinct()
    return models.join(can, "provider_id", "left_semi")


def events(outcomes: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """What a run reports: a start for each row that is tried, then done, skip or error; with ``tests``, the plan first.

    ``outcomes``: provider_id, model, test_id, status, error, skip_reason, duration_ms, wer_normalized.
    """
    key, text, number = ["provider_id", "model", "test_id"], F.lit(None).cast("string"), F.lit(None).cast("double")
    done, failed, skipped = F.col("status") == "ok", F.col("status") == "error", F.col("status") == "skipped"
    kind = F.when(skipped, "skip").when(failed, "error").otherwise("done").alias("type")
    message = F.when(skipped, F.col("skip_reason")).when(failed, F.col("error")).alias("message")
    nothing = F.lit(None).cast("long").alias("total_tests")
    start = outcomes.where(~skipped).select(F.lit("start").alias("type"), *key, text.alias("message"), number.alias("duration_ms"), number.alias("wer_normalized"), nothing)
    end = outcomes.select(kind, *key, message, F.when(done, F.col("duration_ms")).alias("duration_ms"), F.when(done, F.col("wer_normalized")).alias("wer_normalized"), nothing)
    if tests is None:
        return start.union(end)
    plan = tests.agg(F.count("*").alias("total_tests")).select(F.lit("plan").alias("type"), *[text.alias(k) for k in key], text.alias("message"), number.alias("duration_ms"), number.alias("wer_normalized"), "total_tests")
    return plan.union(start).union(end)


def work_list(tests: DataFrame, models: DataFrame, runs: int = 3) -> DataFrame:
    """Tests x models x runs. The models ride along as one array per test, so nothing is shuffled, if their number allows."""
    entries = models.select(F.struct(*models.columns).alias("m"))
    runs_ = F.explode(F.sequence(F.lit(1), F.lit(runs)))
    # an array rides on every test only while it is short; beyond that Spark chooses how to join
    every = entries.agg(F.array_sort(F.collect_list("m")).alias("models"))
    few = entries.limit(MODELS_AT_MOST + 1).count() <= MODELS_AT_MOST
    out = (tests.join(F.broadcast(every)).withColumn("m", F.explode("models")) if few else tests.join(entries)).withColumn("run", runs_)
    return out.select(*tests.columns, "m.*", "run").withColumn("cache_key", cache_key())


def cache_hits(work: DataFrame, cache: DataFrame) -> DataFrame:
    """Work whose cached row has no error. ``cache``: cache_key, error."""
    good = cache.where(F.coalesce(F.col("error"), F.lit("")) == "").select("cache_key").distinct()
    return work.join(good, "cache_key", "left_semi")


def cache_misses(work: DataFrame, cache: DataFrame) -> DataFrame:
    good = cache.where(F.coalesce(F.col("error"), F.lit("")) == "").select("cache_key").distinct()
    return work.join(good, "cache_key", "left_anti")


def with_support(work: DataFrame) -> DataFrame:
    """``supported``: whether a model takes the test's language."""
    return work.withColumn("supported", supports_language(F.col("languages"), F.col("language"), F.col("supports_auto")))


def cost(duration_seconds: Column, per_minute: Column) -> Column:
    return duration_seconds / 60 * per_minute


def realtime_factor(duration_ms: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, duration_ms / (seconds * 1000)).otherwise(0.0)


def classify(outcomes: DataFrame) -> DataFrame:
    """status, error, and metrics: skipped rows have zeros, failed ones ones and zero durations."""
    skipped = ~F.col("supported")
    failed = F.col("supported") & (F.coalesce(F.col("failure"), F.lit("")) != "")

    def value(c: str, at_error: float) -> Column:
        return F.when(skipped, 0.0).when(failed, at_error).otherwise(F.col(c)).alias(c)

    status = F.when(skipped, "skipped").when(failed, "error").otherwise("ok").alias("status")
    metrics = ("wer_raw", "wer_normalized", "cer")
    rest = [c for c in outcomes.columns if c not in (*metrics, "duration_ms", "realtime_factor", "failure", "supported")]
    return outcomes.select(
        *rest, status, F.when(failed, F.col("failure")).alias("error"), F.when(skipped, "language not supported").alias("skip_reason"),
        *[value(m, 1.0) for m in metrics if m in outcomes.columns], *[value(c, 0.0) for c in ("duration_ms", "realtime_factor") if c in outcomes.columns],
    )


class Transcriber(Protocol):
    """What turns audio into text. Each is used by one call at a time."""

    def transcribe(self, audio_file: str, language: str, provider_id: str, model: str) -> tuple[str, float]: ...


class EchoTranscriber:
    """A deterministic stand-in: says the file's name, in as many milliseconds as that has letters."""

    def transcribe(self, audio_file: str, language: str, provider_id: str, model: str) -> tuple[str, float]:
        text = audio_file.rsplit("/", 1)[-1].rsplit(".", 1)[0].replace("-", " ")
        return text, float(len(text))


def within_deadline(make: Callable[[], Transcriber], calls: list[tuple], seconds: float, threads: int) -> list[tuple[str | None, float, str | None]]:
    """(text, duration_ms, failure) of each call. At most ``threads`` run at a time; one that takes longer than ``seconds`` fails and
    is left behind with its transcriber, and the next call gets a new one."""
    out: list[tuple[str | None, float, str | None]] = [(None, 0.0, None)] * len(calls)
    ended: queue.SimpleQueue = queue.SimpleQueue()
    idle: list[Transcriber] = []
    running: dict[int, float] = {}

    def call(i: int, t: Transcriber) -> None:
        try:
            ended.put((i, t, (*t.transcribe(*calls[i]), None)))
        except Exception as e:  # noqa: BLE001 - whatever a recognizer raises is that row's failure
            ended.put((i, t, (None, 0.0, str(e) or type(e).__name__)))

    at = 0
    while at < len(calls) or running:
        while at < len(calls) and len(running) < threads:
            running[at] = time.monotonic() + seconds
            threading.Thread(target=call, args=(at, idle.pop() if idle else make()), daemon=True).start()
            at += 1
        try:
            i, t, said = ended.get(timeout=max(0.0, min(running.values()) - time.monotonic()))
        except queue.Empty:
            for late in [k for k, end in running.items() if end <= time.monotonic()]:
                out[late] = (None, 0.0, f"timed out after {seconds:g} s")
                del running[late]
            continue
        if i in running:  # what comes later than its deadline doesn't count
            out[i] = said
            del running[i]
            idle.append(t)
    return out


def transcribe(work: DataFrame, make: type[Transcriber] = EchoTranscriber, parallel: int | None = None, seconds: float = 120.0, threads: int = 1) -> DataFrame:
    """``work`` with transcription, duration_ms and failure. An exception, or a call longer than ``seconds``, fails its row alone,
    which is tried again next time. Each task runs ``threads`` calls at a time."""
    cols = ("audio_file", "language", "provider_id", "model")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = within_deadline(make, list(zip(*[b[c] for c in cols], strict=True)), seconds, threads)
            yield b.assign(**dict(zip(("transcription", "duration_ms", "failure"), map(list, zip(*out, strict=True)) if out else ([], [], []), strict=True)))

    d = work.repartition(parallel) if parallel else work
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema) + ", transcription string, duration_ms double, failure string"
    return d.mapInPandas(run, schema)
