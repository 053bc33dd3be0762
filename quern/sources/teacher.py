"""Calling a model once per row, in batches per partition."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def call_model(rows: DataFrame, key: str, prompt: str, call: Callable[[str], str]) -> DataFrame:
    """(key, reply, error): call is run once per row; what it raises is the row's error and stops nothing else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies, errors = [], []
            for p in pdf[prompt]:
                try:
                    replies.append(call(p))
                    errors.append(None)
                except Exception as e:
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: pdf[key], "reply": replies, "error": errors})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, reply string, error string")


def http_caller(url: str, body: Callable[[str], dict], reply: Callable[[dict], str], timeout: float = 600) -> Callable[[str], str]:
    """A callable for call_model that posts body(prompt) as JSON and reads reply of the answer; anything but an object is an error."""

    def call(prompt: str) -> str:
        request = urllib.request.Request(url, json.dumps(body(prompt)).encode("utf-8"), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            value = json.load(answer)
        if not isinstance(value, dict):
            raise ValueError("the answer is no JSON object")
        return reply(value)

    return call


def decoding_options(config: dict[str, object]) -> dict[str, object]:
    """The options of a call: the given ones, with num_predict from max_new_tokens where it is missing."""
    out = {k: v for k, v in config.items() if k != "max_new_tokens"}
    if out.get("num_predict") is None and config.get("max_new_tokens") is not None:
        out["num_predict"] = config["max_new_tokens"]
    return out
