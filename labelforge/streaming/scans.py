"""Streams (an addition): the batch functions on unbounded scans, and token rotation with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import analysis


def verdicts(scans: DataFrame, profiles: DataFrame) -> DataFrame:
    """A stream of scans (scan_id, user_id, items) against the static profiles: stateless, append mode."""
    return analysis.analyze(scans, profiles)


def unsafe_counts(verdict_stream: DataFrame, ts: str = "created_at", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Unsafe verdicts per window; scans later than the watermark are dropped."""
    return verdict_stream.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(F.count_if(~F.col("is_safe")).alias("unsafe"), F.count(F.lit(1)).alias("n"))


def rotations(events: DataFrame) -> DataFrame:
    """Per user the live token after login, refresh and logout events (user_id, action, token, used).

    login and a refresh with the live token set a new one; logout and a refresh with another end it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = state.get[0] if state.exists else None
        out = []
        for pdf in frames:
            for action, token, used in zip(pdf["action"], pdf["token"], pdf["used"]):
                ok = action == "login" or (action == "refresh" and live is not None and used == live)
                live = token if ok else None
                out.append((key[0], action, live, ok))
        state.update((live,))
        yield pd.DataFrame(out, columns=["user_id", "action", "live", "ok"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, action string, live string, ok boolean", "live string", "append", GroupStateTimeout.NoTimeout)
