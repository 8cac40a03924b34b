"""Text recognition and language models as pluggable functions on partitions, with deterministic stand-ins.

A provider is a function from a list of prompts to a list of replies (text or None), an engine one from a list of
image bytes to a list of detections. Both run inside tasks; what they need (clients, keys) they make themselves.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from .products import repaired_json

Provider = Callable[[list[str]], list["str | None"]]
Engine = Callable[[list[bytes]], list[list[dict]]]
DETECTIONS = "array<struct<bbox:array<array<double>>,text:string,confidence:double>>"
FOUND = ("water", "sugar", "salt", "flour", "oil", "milk", "eggs", "wheat", "corn", "soy", "peanut", "butter", "cream")


def stand_in(prompts: list[str]) -> list[str | None]:
    """Spots well-known items in the prompt and replies with them as JSON; without any, with no items."""
    return [None if p is None else json.dumps({"ingredients": [w.capitalize() for w in FOUND if w in p.lower()]}) for p in prompts]


def recognised(images: list[bytes]) -> list[list[dict]]:
    """An engine for tests: images whose bytes are the JSON of their detections."""
    return [json.loads(b.decode("utf-8", "replace")) if b and b[:1] == b"[" else [] for b in images]


def provider_name(name: Column) -> Column:
    """A known provider's name in small letters, aliases resolved; others null."""
    n = F.lower(name)
    for alias, to in fixed.PROVIDER_ALIASES.items():
        n = F.when(n == alias, to).otherwise(n)
    return F.when(n.isin(*fixed.PROVIDERS), n)


def with_replies(rows: DataFrame, prompt: str, providers: Sequence[tuple[str, Provider]]) -> DataFrame:
    """Adds reply and provider: of the providers in order the first whose reply is JSON (repaired); null if none is.

    Null and blank prompts are not sent.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            reply, by = [None] * len(b), [None] * len(b)
            left = [k for k, p in enumerate(b[prompt]) if p is not None and p.strip()]
            for name, ask in providers:
                got = ask([b[prompt].iloc[k] for k in left]) if left else []
                for k, r in zip(left, got):
                    if (r := repaired_json(r)) is not None:
                        reply[k], by[k] = r, name
                left = [k for k in left if reply[k] is None]
            yield b.assign(reply=pd.Series(reply, index=b.index, dtype=object), provider=pd.Series(by, index=b.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("reply", "provider"))
    return rows.drop("reply", "provider").mapInPandas(work, f"{fields}, reply string, provider string")


def extraction_prompt(c: Column, instructions: str = "Extract all ingredients of the text.") -> Column:
    return F.concat(F.lit(instructions + "\n\nINPUT TEXT:\n"), c, F.lit('\n\nReply with JSON only: {"ingredients": ["item"]}'))


def extracted(rows: DataFrame, source: str, providers: Sequence[tuple[str, Provider]] = (("stand_in", stand_in),)) -> DataFrame:
    """Adds items, success and provider: the list of a model's reply, or no items (blank text, no or a bad reply)."""
    told = with_replies(rows.withColumn("_prompt", F.when(text.strip(F.coalesce(source, F.lit(""))) != "", extraction_prompt(F.col(source)))), "_prompt", providers)
    got = F.from_json("reply", "ingredients array<string>")["ingredients"]
    return told.withColumns({"success": got.isNotNull(), "items": F.coalesce(got, F.array().cast("array<string>"))}).drop("_prompt", "reply")


def with_detections(images: DataFrame, content: str = "content", engine: Engine = recognised) -> DataFrame:
    """Adds detections to images: an engine sees a batch of bytes at a time."""

    @F.pandas_udf(DETECTIONS)
    def read(batch: pd.Series) -> pd.Series:
        return pd.Series(engine([bytes(b) if b is not None else b"" for b in batch]))

    return images.withColumn("detections", read(F.col(content)))


def page_text(pages: Column) -> Column:
    """Text of recognised pages: those that are not empty, joined by line ends; three line ends or more become two."""
    full = F.filter(pages, lambda p: p.isNotNull() & (p != ""))
    return text.strip(F.regexp_replace(F.array_join(full, "\n"), r"\n{3,}", "\n\n"))


def retry_delay(status: Column, attempt: Column, attempts: int) -> Column:
    """Seconds to wait before the next attempt (from 0); null where none follows. Null status: no answer came."""
    again = (status.isNull() | status.isin(*fixed.RETRY_STATUS)) & (attempt < attempts - 1)
    return F.when(again, F.least(F.pow(F.lit(2), attempt), F.lit(fixed.LONGEST_DELAY)).cast("int"))


def retrying(ask: Callable[[bytes], tuple[int | None, str]], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> Callable[[bytes], str]:
    """A call that is tried again while its status (null: no answer) tells that it may work later."""

    def call(data: bytes) -> str:
        for attempt in range(attempts):
            status, body = ask(data)
            if status == 200:
                return body
            if (status is not None and status not in fixed.RETRY_STATUS) or attempt == attempts - 1:
                raise RuntimeError(f"status {status} after {attempt + 1} attempts")
            wait(min(2**attempt, fixed.LONGEST_DELAY))
        raise RuntimeError("no attempt was made")

    return call
