"""Nothing large is sent to the driver unasked, whatever the session's threshold."""

import random

import pytest

neardup = pytest.importorskip("gristmill.llm.neardup")
simhash = pytest.importorskip("gristmill.llm.simhash")

KEY = "spark.sql.autoBroadcastJoinThreshold"


def largest_broadcast(spark, run):
    """Rows of the largest table that run() broadcasts."""
    store, lists = spark._jsparkSession.sharedState().statusStore(), spark._jvm.scala.jdk.javaapi.CollectionConverters
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    seen = {x.executionId() for x in lists.asJava(store.executionsList())}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    for number in {x.executionId() for x in lists.asJava(store.executionsList())} - seen:
        values = lists.asJava(store.executionMetrics(number))
        for node in lists.asJava(store.planGraph(number).allNodes()):
            if node.name() == "BroadcastExchange":
                for metric in lists.asJava(node.metrics()):
                    if metric.name() == "number of output rows":
                        most = max(most, int((values.get(metric.accumulatorId()) or "0").replace(",", "")))
    return most


@pytest.fixture
def default_session(spark):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, "10MB")
    yield spark
    assert spark.conf.get(KEY) == "10MB"  # the operators leave it as it was
    spark.conf.set(KEY, before)


def test_near_dedup_broadcasts_no_large_table(default_session):
    rng, spark = random.Random(3), default_session
    texts = [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(8))) for i in range(12000)]
    docs = spark.createDataFrame([*texts, *((i + 12000, t) for i, t in texts[:5])], "doc_id long, text string")
    got = []
    assert largest_broadcast(spark, lambda: got.extend(r.doc_id for r in neardup.keep_one_alike(docs).select("doc_id").collect())) <= 50_000
    assert len(got) == len(set(got)) and 11000 < len(got) <= 12000 and max(got) < 12000


def test_simhash_broadcasts_no_large_table(default_session):
    rng, spark = random.Random(4), default_session
    docs = spark.createDataFrame([(i, " ".join(str(rng.randint(0, 999)) for _ in range(6))) for i in range(12000)], "doc_id long, text string")
    got = []
    assert largest_broadcast(spark, lambda: got.extend(simhash.near_duplicates(docs).collect())) <= 50_000
    assert len(got) == 12000
