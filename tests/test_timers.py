"""Streams with timers: retries of a failing provider, and tokens that expire, on shuffled input."""

import datetime as dt
import random
import time
import uuid

from labelforge.streaming import timers


def run(stream, tmp_path, done, seconds=90):
    name = f"out_{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="200 milliseconds").start()
    spark, until = stream.sparkSession, time.time() + seconds
    try:
        while time.time() < until and q.isActive and not done(spark.table(name)):
            time.sleep(0.5)
        assert q.exception() is None
        return spark.table(name).collect()
    finally:
        q.stop()


def test_prompts_are_asked_again_and_answered_once(spark, tmp_path):
    asked, source = tmp_path / "asked", tmp_path / "prompts"
    asked.mkdir()
    rows = [(k, f"{k % 4}|prompt {k}") for k in range(24)] + [(99, None)]
    spark.createDataFrame(rows, "id long, prompt string").repartition(3).write.parquet(str(source))

    def failing(prompts):
        """Replies from the n-th time on that a prompt is asked, n before its mark; a file per time."""
        out = []
        for p in prompts:
            (asked / f"{p.replace('|', '-')}@{time.time():.3f}@{uuid.uuid4().hex}").touch()
            out.append(f"reply to {p}" if sum(f.name.startswith(p.replace("|", "-") + "@") for f in asked.iterdir()) > int(p[0]) else None)
        return out

    stream = timers.answered(spark.readStream.schema("id long, prompt string").parquet(str(source)), failing, attempts=3, buckets=4)
    got = run(stream, tmp_path, lambda t: t.count() == 25)
    assert sorted((r.id, r.reply, r.tries) for r in got if r.id != 99) == [(k, f"reply to {p}" if k % 4 < 3 else None, min(k % 4, 2) + 1) for k, p in rows[:24]]
    assert [(r.reply, r.tries) for r in got if r.id == 99] == [(None, 0)]
    times = sorted(float(f.name.split("@")[1]) for f in asked.iterdir() if f.name.startswith("3-prompt 3@"))
    assert len(times) == 3 and times[1] - times[0] >= 0.99 and times[2] - times[1] >= 1.99


def test_tokens_end_as_in_the_batch_query(spark, tmp_path):
    rng, start, events = random.Random(9), dt.datetime(2024, 5, 1), []
    for u in range(6):
        for t in range(8):
            issue = start + dt.timedelta(minutes=rng.randint(0, 300))
            expires = issue + dt.timedelta(minutes=rng.choice([5, 30, 60]))
            events.append((u, f"{u}-{t}", "issue", issue, expires))
            for _ in range(rng.choice([0, 0, 1, 2])):
                events.append((u, f"{u}-{t}", "revoke", issue + dt.timedelta(minutes=rng.choice([1, 30, 90])), None))
    schema = "user_id long, token string, action string, ts timestamp, expires_at timestamp"
    # Out of order by up to an hour, over several batches.
    events.sort(key=lambda e: e[3] + dt.timedelta(minutes=rng.randint(0, 50)))
    source = tmp_path / "events"
    for k in range(0, len(events), 25):
        spark.createDataFrame(events[k : k + 25], schema).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.01)
    far = start + dt.timedelta(days=3)
    spark.createDataFrame([(1000, "far", "issue", far, far + dt.timedelta(days=1))], schema).write.mode("append").parquet(str(source))
    stream = timers.ended_tokens(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), "1 hour")
    want = sorted((r.user_id, r.token, r.ended_at, r.reason) for r in timers.ended_tokens_of(spark.createDataFrame(events, schema)).collect())
    got = run(stream, tmp_path, lambda t: t.count() >= len(want))
    assert sorted((r.user_id, r.token, r.ended_at, r.reason) for r in got) == want and {r[3] for r in want} == {"expired", "revoked"}
