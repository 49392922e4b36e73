import datetime
import random
import time

import pytest

from gristmill.streaming import streams

AT = datetime.datetime(2024, 1, 1)
SCHEMA = "user string, ts timestamp, id long"


def by_fold(rows, limit, seconds):
    out = {}
    for user in {r[0] for r in rows if r[0] is not None}:
        mine = sorted((r[1], r[2]) for r in rows if r[0] == user and r[1] is not None)
        verdicts, _, _ = streams.fold_window([(t - AT).total_seconds() for t, _ in mine], None, 0, limit, seconds)
        out |= {i: v for (_, i), v in zip(mine, verdicts)}
    return out


@pytest.mark.parametrize("gaps", [[0, 1, 5], [0, 0.25, 59, 60, 61], [200, 1000], [0, 30, 3600]])
def test_windows_are_those_of_the_fold(spark, gaps):
    rng, rows, t = random.Random(len(gaps)), [], 0.0
    for i in range(400):
        t += rng.choice(gaps)
        rows.append((rng.choice("aab"), AT + datetime.timedelta(seconds=t), i))
    rows += [(None, AT, 1000), ("a", None, 1001)]
    got = {r.id: r.accepted for r in streams.rate_limit(spark.createDataFrame(rows, SCHEMA), "user", "ts", "id", 3, 60).collect()}
    assert got.pop(1000) is None and got.pop(1001) is None
    assert got == by_fold(rows, 3, 60)


def test_empty(spark):
    assert streams.rate_limit(spark.createDataFrame([], SCHEMA), "user", "ts", "id").count() == 0


def test_stream_agrees_with_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), AT + datetime.timedelta(seconds=40 * i + rng.randint(0, 30)), i) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    batch = {(r.user, r.ts): r.accepted for r in streams.rate_limit(df, "user", "ts", "id", 1, 60).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.rate_limit_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "user", "ts", 1, 60)
    running = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:  # time-outs are looked for for ever, so the query never ends of itself
        until = time.time() + 90
        while spark.table("limited").count() < len(rows) and time.time() < until:
            time.sleep(1)
    finally:
        running.stop()
    got = {(r.key, r.ts): r.accepted for r in spark.table("limited").collect()}
    assert got == batch
