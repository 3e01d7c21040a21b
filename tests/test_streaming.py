"""A state that follows change files, bucket by bucket."""

import os

from quarry.streaming import refresh

SCHEMA = "path string, size long, version long, deleted boolean"


def test_follow_rewrites_what_it_touches(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "state", "mark"))
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run = lambda: refresh.follow(spark, source, SCHEMA, target, mark, buckets=8)
    state = lambda: {r.path: r.size for r in refresh.current(spark, target, "path string, size long").collect()}
    files = lambda: {os.path.join(d, x) for d, _, names in os.walk(f"{target}/state") for x in names if x.endswith(".parquet")}
    put([(f"f{i}", i, 1, False) for i in range(40)])
    run()
    assert state() == {f"f{i}": i for i in range(40)}
    first = files()
    put([("f3", 33, 2, False), ("f3", 30, 1, False), ("f4", 0, 2, True), ("new", 5, None, False), ("new", 6, 0, False), ("lost", 1, None, True)])
    run()
    want = {f"f{i}": i for i in range(40)} | {"f3": 33, "new": 6}
    del want["f4"]
    assert state() == want
    assert first <= files()  # what a reader of the first batch holds is still there
    _, versions = refresh._state(spark, target)
    assert sorted(set(versions.values())) == [0, 1] and 0 < sum(v == 1 for v in versions.values()) <= 4
    run()  # nothing has come
    assert state() == want
    # A batch that is run again begins from the manifest before it.
    assert refresh._state(spark, target, 1)[0] == 0 and refresh._state(spark, target, 0)[0] is None
    put([(f"f{i}", 0, 9, True) for i in range(40)] + [("new", 0, 9, True)])
    run()
    assert state() == {}
    put([("back", 1, 10, False)])
    run()
    assert state() == {"back": 1}
