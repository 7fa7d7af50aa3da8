import random

from pyspark.sql import functions as F

from granary.functions.compare import cmp_key, lenient
from granary.operators import changes, log, relational


def test_merge_like_a_dictionary(spark):
    rng = random.Random(9)
    events = [(rng.choice("abcdef"), k, rng.randint(0, 99), rng.random() < 0.25) for k in range(400)]
    now, first, versions = {}, {}, {}
    for key, seq, value, dead in events:
        if dead:
            now.pop(key, None)
            versions[key] = 0
        else:
            first.setdefault(key, seq)
            now[key] = value
            versions[key] = versions.get(key, 0) + 1
    df = spark.createDataFrame(events, "key string, seq long, value long, gone boolean")
    got = {r.key: (r.value, r.versions, r.first_seq) for r in log.merge(df, "key", "seq", "gone").collect()}
    assert got == {k: (v, versions[k], first[k]) for k, v in now.items()}


def test_merge_of_nothing(spark):
    df = spark.createDataFrame([], "key string, seq long, value long, gone boolean")
    assert log.merge(df, "key", "seq", "gone").count() == 0


def test_merge_counts_null_keys_and_splits_hot_ones(spark):
    rows = [(None if k % 3 else "b", k, k, k == 4) for k in range(9)]
    df = spark.createDataFrame(rows, "key string, seq long, value long, gone boolean")
    got = log.merge(df, "key", "seq", "gone")
    assert {tuple(r) for r in got.select("key", "value", "versions", "first_seq").collect()} == {(None, 8, 3, 1), ("b", 6, 3, 0)}
    frame = spark.range(40_000).selectExpr("IF(id % 10 < 9, 'hot', string(id)) AS key", "id AS seq", "id AS value", "id = 5000 AS gone")
    held = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = log.merge(frame.repartition(8), "key", "seq", "gone")
        assert {r.key: r.versions for r in out.collect()}["hot"] == sum(k % 10 < 9 for k in range(5001, 40_000))
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_clear_and_epochs(spark):
    df = spark.createDataFrame([(1, "a", "x", False), (2, "b", "x", False), (3, "a", "y", False), (4, "c", "y", False)], "seq long, k string, j string, gone boolean")
    assert sorted(r.seq for r in log.after_clear(df, "seq", clear=F.col("seq") == 2).collect()) == [3, 4]
    assert sorted(r.seq for r in log.after_clear(df, "seq", clear=F.lit(False)).collect()) == [1, 2, 3, 4]
    # by k: a is 3, b is 2; then by j: x is 2, y is 4
    assert sorted(r.seq for r in log.replay(df, [(1, "k"), (4, "j")], "seq", "gone").collect()) == [2, 4]


def test_budget_stops_at_the_first_overrun(spark):
    df = spark.createDataFrame([(k, 10, k % 3 == 0) for k in range(30)], "seq long, size long, official boolean")
    kept = {r.seq for r in log.within_budget(df, "size", "seq", F.col("official"), pack_bytes=10, total_bytes=45).collect()}
    others = sorted((k for k in range(30) if k % 3), reverse=True)[:4]
    assert kept == {k for k in range(30) if k % 3 == 0} | set(others)


def test_reassembly_leaves_out_incomplete_rows(spark):
    df = spark.createDataFrame([("r", 1, "b", 2), ("r", 0, "a", 2), ("s", 1, "x", 2)], "row string, i int, t string, total int")
    assert [tuple(r) for r in log.reassemble(df, ["row"], "i", "t", "total").collect()] == [("r", "ab", 2)]


def test_reassembly_of_parts_sent_again_and_first_parts_lost(spark):
    df = spark.createDataFrame([("r", 0, "a", 2), ("r", 1, "b", 2), ("r", 1, "b", 2), ("s", 1, "x", 2), ("s", 2, "y", 2), ("t", 0, "z", 1)], "row string, i int, t string, total int")
    assert sorted(tuple(r) for r in log.reassemble(df, ["row"], "i", "t", "total").collect()) == [("r", "ab", 2), ("t", "z", 1)]
    assert sorted(r.t for r in log.reassemble(df, ["row"], "i", "t").collect()) == ["ab", "xy", "z"]


def test_pages_commits_and_own_writes(spark):
    pages = spark.createDataFrame([(1, False), (2, True), (3, False), (4, False)], "n long, mark boolean")
    assert sorted(r.n for r in log.newest_pages(pages, "n", F.col("mark")).collect()) == [2, 3, 4]
    assert sorted(r.n for r in log.newest_pages(pages, "n", F.lit(False), most=2).collect()) == [3, 4]
    held = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 3, 1), ("a", 4, 6)], "k string, seq long, v long")
    assert [(r.seq, r.change) for r in log.commits(held, "k", "seq", of="a").orderBy("seq").collect()] == [(1, "Added"), (2, "Repeated"), (4, "Changed")]
    own = spark.createDataFrame([("a", 4, 6), ("a", 9, 7)], "k string, seq long, v long")
    assert sorted(r.seq for r in log.with_own_writes(held, own, "k", "seq").collect()) == [1, 2, 3, 4, 9]


def test_commits_across_slices(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), n * n, rng.choice([1, 1, 2, None])) for n in range(1500)]
    held, want = {}, []
    for key, seq, value in rows:
        want.append((seq, "Added" if key not in held else "Repeated" if held[key] == value else "Changed"))
        held[key] = value
    df = spark.createDataFrame(rows, "key string, seq long, value int")
    got = log.commits(df, "key", "seq")
    assert got.columns == ["key", "seq", "value", "change"]
    assert sorted((r.seq, r.change) for r in got.collect()) == want
    assert log.commits(df.limit(0), "key", "seq").count() == 0


def test_overlay_states(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    pending = spark.createDataFrame([(1, "a", False), (2, "B", False), (3, None, True), (4, "d", False), (5, None, True)], "id long, v string, gone boolean")
    assert sorted(tuple(r) for r in log.overlay(base, pending, "id", "gone").collect()) == [(1, "a", "Saved"), (2, "B", "Changed"), (3, "c", "Deleted"), (4, "d", "New")]


def test_keys_and_numbers(spark):
    df = spark.createDataFrame([("010",), ("10",), ("1e1",), ("10d",), ("Ab ",), ("ab",), (None,), ("12x",)], "s string")
    got = [tuple(r) for r in df.select(cmp_key("s"), lenient("s")).collect()]
    assert [k for k, _ in got] == ["10", "10", "10", "10d", "ab", "ab", None, "12x"]
    assert [n for _, n in got] == [10.0, 10.0, 10.0, 10.0, 0.0, 0.0, None, 12.0]


def test_reports(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "A ", -1), (3, None, None)], "id long, s string, n int")
    assert [tuple(r) for r in changes.repeated(df, ["s"]).collect()] == [("a", 2)]
    assert [tuple(r) for r in changes.broken(df, "id", {"positive": F.col("n") > 0}).collect()] == [(2, "positive")]
    assert relational.by_example(df, {"s": "a*", "n": "> 0"}).count() == 1
