"""External models as injected clients: scoring and comparing rows in Arrow batches, with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tallyloom.schemas import DIMENSIONS

#: Waits between attempts, in seconds, and the longest article part that a prompt takes.
WAITS = (1, 2, 4, 8)
ARTICLE_CHARS = 6000


class Blocked(Exception):
    """The model refused the prompt: no retry, an empty reply."""


def with_retry(call: Callable[[], str], waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> str:
    """The call's reply; after each failure a longer wait, and the last failure is raised."""
    for wait in (*waits, None):
        try:
            return call()
        except Blocked:
            return ""
        except Exception:
            if wait is None:
                raise
            sleep(wait)
    raise AssertionError


def ask(df: DataFrame, prompt: str, client: Callable[[], Callable[[str], str]], waits: tuple[float, ...] = WAITS) -> DataFrame:
    """``df`` with ``raw_reply``; ``client`` makes the model's function once per task."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", raw_reply string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for pdf in parts:
            pdf["raw_reply"] = [with_retry(lambda p=p: model(p), waits) for p in pdf[prompt]]
            yield pdf

    return df.mapInPandas(run, schema)


def fake_scorer() -> Callable[[str], str]:
    """A deterministic stand-in: scores from the prompt's length."""

    def model(prompt: str) -> str:
        parts = (f'"{d}": {{"score": {(len(prompt) + i) % 5 + 1}, "justification": ""}}' for i, d in enumerate(DIMENSIONS))
        return "reply: {" + ", ".join(parts) + "}"

    return model
