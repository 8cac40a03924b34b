"""Keyed state with timers: model calls that are tried again later, and tokens that expire."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.fixed import LONGEST_DELAY

Provider = Callable[[list[str]], list["str | None"]]


def answered(prompts: DataFrame, ask: Provider, attempts: int = 3, buckets: int = 64) -> DataFrame:
    """id, prompt, reply and tries of a stream of prompts (id long, prompt string), each once, in append mode.

    What the provider gives no reply to waits in state and is asked again after min(2^n, LONGEST_DELAY) seconds (n: tries
    before), so no task ever sleeps; after `attempts` tries the row comes out with a null reply. Ids are dealt to buckets, and
    a bucket's prompts that are due go to the provider together. Null prompts come out at once. Ids are taken to be unique.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        waiting = json.loads(state.get[0]) if state.exists else []
        due, out = [w[:3] for w in waiting if w[3] <= now], []
        waiting = [w for w in waiting if w[3] > now]
        for pdf in frames:
            for i, p in zip(pdf["id"].tolist(), pdf["prompt"].tolist()):
                if p is None:
                    out.append((i, None, None, 0))
                else:
                    due.append([i, p, 0])
        for (i, p, tries), reply in zip(due, ask([p for _, p, _ in due]) if due else []):
            if reply is not None or tries + 1 >= attempts:
                out.append((i, p, reply, tries + 1))
            else:
                # From now on: the batch's own time is that of its start.
                waiting.append([i, p, tries + 1, int(time.time() * 1000) + 1000 * min(2**tries, LONGEST_DELAY)])
        if waiting:
            state.update((json.dumps(waiting),))
            state.setTimeoutDuration(max(1, min(w[3] for w in waiting) - now))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["id", "prompt", "reply", "tries"]).astype({"id": "int64", "tries": "int32", "prompt": object, "reply": object})

    dealt = prompts.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"), "id", "prompt")
    return dealt.groupBy("bucket").applyInPandasWithState(step, "id long, prompt string, reply string, tries int", "waiting string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def ended_tokens(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """user_id, token, ended_at, reason (expired or revoked) of a stream of token events, in append mode.

    events: user_id, token, action (issue or revoke), ts, expires_at (of issue events). A token ends at its first revocation or
    when it expires, whichever is first (a revocation at that very time counts). Rows come out once the watermark has passed
    that time, so events out of order by up to `late` give the same rows as ended_tokens_of on the whole table.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        for pdf in frames:
            for token, action, ts, expires in zip(pdf["token"], pdf["action"], pdf["ts"], pdf["expires_at"]):
                one = held.setdefault(token, [None, None])
                at, k = (expires, 0) if action == "issue" else (ts, 1)
                one[k] = min(x for x in (one[k], int(pd.Timestamp(at).value // 1000)) if x is not None)
        mark = state.getCurrentWatermarkMs() * 1000
        ends = {t: min(x for x in (e, r) if x is not None) for t, (e, r) in held.items()}
        out = [(key[0], t, pd.Timestamp(end, unit="us"), "revoked" if held[t][1] == end else "expired") for t, end in ends.items() if end < mark and held[t][0] is not None]
        # A revocation without its token is kept until the watermark has passed it.
        held = {t: v for t, v in held.items() if ends[t] >= mark}
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(min(ends[t] for t in held) // 1000 + 1, mark // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "token", "ended_at", "reason"]).astype({"user_id": "int64", "token": object, "ended_at": "datetime64[ns]", "reason": object})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, token string, ended_at timestamp, reason string", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def ended_tokens_of(events: DataFrame) -> DataFrame:
    """The rows of ended_tokens for a whole table: of every issued token."""
    issued, revoked = F.col("action") == "issue", F.col("action") == "revoke"
    one = events.groupBy("user_id", "token").agg(F.min(F.when(issued, F.col("expires_at"))).alias("_e"), F.min(F.when(revoked, F.col("ts"))).alias("_r"))
    return one.filter(F.col("_e").isNotNull()).select("user_id", "token", F.least("_e", "_r").alias("ended_at"), F.when(F.col("_r") <= F.col("_e"), "revoked").otherwise("expired").alias("reason"))
