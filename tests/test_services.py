import pytest

from gristmill import services


def test_retries():
    waits, calls = [], []

    def fails(times, error=OSError):
        def call():
            calls.append(1)
            if len(calls) <= times:
                raise error("no")
            return "yes"

        calls.clear()
        waits.clear()
        return call

    assert services.with_retries(fails(2), sleep=waits.append) == "yes" and len(waits) == 2 and 0.2 <= waits[0] < 0.23 and 0.4 <= waits[1] < 0.45
    with pytest.raises(OSError):
        services.with_retries(fails(9), sleep=waits.append)
    assert len(calls) == 3
    with pytest.raises(services.Final):
        services.with_retries(fails(1, services.Final), sleep=waits.append)
    assert len(calls) == 1
    with pytest.raises(OSError):  # the next wait would end after the budget
        services.with_retries(fails(9), budget=0.1, sleep=waits.append)
    assert len(calls) == 1
    assert [services.is_transient(s) for s in (None, 429, 500, 503, 400, 404, 200)] == [True, True, True, True, False, False, False]


def test_caches():
    cache = services.FifoCache(2)
    for k, v in ((1, "a"), (2, "b"), (1, "c"), (3, "d")):
        cache.put(k, v)
    assert cache.get(1) is None and cache.get(2) == "b" and cache.get(3) == "d"
    now, seen = [0.0], []
    plans = services.TtlCache(10, clock=lambda: now[0], hook=lambda e, k: seen.append(e))
    assert [plans.get_or(q, str.upper) for q in ("A b", " a  B ")] == ["A B".upper(), "A B"]
    now[0] = 11
    plans.get_or("a b", str.upper)
    assert seen == ["miss", "hit", "miss"]


def test_embedder(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.embedding for r in services.embedded(rows, "text", services.HashEmbedder).collect()}
    assert len(got[1]) == 64 and sum(x * x for x in got[1]) == pytest.approx(1) and got[2] == got[3]
    assert services.generate(lambda p: "x" + p, "y") == "xy"
    with pytest.raises(services.Final):
        services.generate(lambda p: " ", "y")
