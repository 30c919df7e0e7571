"""Chat completions as a source: requests go out from the tasks, at most ``concurrency`` at a time in all of them."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import ApiConfig, SamplingConfig

Completer = Callable[[str, str], str]


def request_body(api: ApiConfig, sampling: SamplingConfig, system: str, user: str) -> dict:
    """Penalties only if set, stop only if any, extra fields last, so that they win."""
    body = {"model": api.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": sampling.temperature, "top_p": sampling.top_p, "max_tokens": sampling.max_tokens}
    for name in ("presence_penalty", "frequency_penalty"):
        if (value := getattr(sampling, name)) is not None:
            body[name] = value
    if sampling.stop:
        body["stop"] = list(sampling.stop)
    return body | dict(sampling.extra_body)


def reply_text(payload: dict) -> str:
    """The first choice's message content, or its text; ValueError if neither is a string."""
    choice = (payload.get("choices") or [{}])[0] or {}
    message = choice.get("message")
    for value in ((message or {}).get("content") if isinstance(message, dict) else None, choice.get("text")):
        if isinstance(value, str):
            return value
    raise ValueError("the reply holds no text")


def url(api: ApiConfig) -> str:
    return api.base_url.rstrip("/") + "/" + api.endpoint.lstrip("/")


def headers(api: ApiConfig) -> dict[str, str]:
    """Read where the call is made: keys are never part of a DataFrame."""
    key = api.api_key or (os.environ.get(api.api_key_env) if api.api_key_env else None)
    return {"Content-Type": "application/json", **api.headers, **({"Authorization": f"Bearer {key}"} if key else {})}


def http_completer(api: ApiConfig, sampling: SamplingConfig) -> Completer:
    """max_retries + 1 attempts on any exception, with a pause that grows by retry_sleep_sec; then RuntimeError."""

    def complete(system: str, user: str) -> str:
        last: Exception | None = None
        for attempt in range(api.max_retries + 1):
            try:
                data = json.dumps(request_body(api, sampling, system, user)).encode()
                with urllib.request.urlopen(urllib.request.Request(url(api), data, headers(api), method="POST"), timeout=api.timeout_sec) as reply:
                    return reply_text(json.loads(reply.read()))
            except Exception as e:  # noqa: BLE001
                last = e
                if attempt < api.max_retries:
                    time.sleep(api.retry_sleep_sec * (attempt + 1))
        raise RuntimeError(f"no reply after {api.max_retries + 1} attempts: {last}")

    return complete


def complete(prompts: DataFrame, completer: Completer, concurrency: int = 4) -> DataFrame:
    """(rule_id, request_index, raw_text, error) of (rule_id, request_index, system, user); the tasks share the concurrency."""
    tasks = max(1, min(concurrency, prompts.sparkSession.sparkContext.defaultParallelism))
    threads = max(1, concurrency // tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(row: tuple[str, str]) -> tuple[str | None, str | None]:
            try:
                return completer(*row), None
            except Exception as e:  # noqa: BLE001
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                got = list(pool.map(one, zip(b.column(2).to_pylist(), b.column(3).to_pylist())))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["rule_id", "request_index", "raw_text", "error"])

    return prompts.select("rule_id", F.col("request_index").cast("int"), "system", "user").repartition(tasks).mapInArrow(run, "rule_id string, request_index int, raw_text string, error string")


def replay(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """The recorded reply of each request by (rule_id, request_index); a request without one has an error."""
    one = replies.groupBy("rule_id", "request_index").agg(F.max("raw_text").alias("raw_text"))
    return prompts.join(one, ["rule_id", "request_index"], "left").select("rule_id", "request_index", "raw_text", F.when(F.col("raw_text").isNull(), "no recorded reply").alias("error"))
