import random

import pytest

from tierstone.functions import layout
from tierstone.operators import state
from tierstone.schema import RUN
from tierstone.store import Store

MIN = -(2**63)


def entries(df):
    return [(r["key"], r["value"]) for r in df.collect()]


def test_life_of_a_small_store(spark, tmp_path):
    """Inventory of a shop: article -> stock, three changes a run."""
    with Store.open(spark, f"{tmp_path}/shop", memtable_capacity=3) as s:
        for article, stock in ((71, 8), (-4, 15), (71, 6), (9, 44), (512, 2), (9, 43)):
            s.put(article, stock)
        assert [s.get(a) for a in (71, -4, 9, 512, 70, 0)] == [6, 15, 43, 2, None, None]
        assert s.run_count(0) == 1 and s.run_total() == 1
        s.delete(-4)
        s.delete(8)  # nothing is there
        assert s.get(-4) is None
        s.put(-4, 1)
        s.delete(512)
        assert entries(s.scan(-4, 71)) == [(-4, 1), (9, 43), (71, 6)]
        assert entries(s.scan(-3, 70)) == [(9, 43)]
        assert entries(s.scan(72, 10**6)) == [] and entries(s.scan(71, 9)) == []
    with Store.open(spark, f"{tmp_path}/shop") as s:
        assert s.config.memtable_capacity == 3 and s.name == f"{tmp_path}/shop"
        assert entries(s.scan(-(10**6), 10**6)) == [(-4, 1), (9, 43), (71, 6)]


def test_every_prefix_and_suffix(spark, tmp_path):
    """2,201 keys of a stride, then overwrites and deletes, against a dict."""
    want = {7 * i - 4321: i * i % 1009 for i in range(2201)}
    as_rows = lambda d: spark.createDataFrame(list(d.items()), "key long, value long")
    with Store.open(spark, f"{tmp_path}/s", memtable_capacity=500, compaction_policy="tiered", sst_size_ratio=3) as s:
        s.put_all(as_rows(want))
        changed = {k: -v for i, (k, v) in enumerate(want.items()) if i % 4 == 1}
        s.put_all(as_rows(changed))
        gone = [k for i, k in enumerate(want) if i % 5 == 2]
        s.delete_all(spark.createDataFrame([(k,) for k in gone], "key long"))
        want = {k: v for k, v in (want | changed).items() if k not in set(gone)}
        assert entries(s.scan(-(10**9), 10**9)) == sorted(want.items())
        edges = [k + d for k in sorted(want)[::9] for d in (-1, 0)]
        ranges = [(2 * i, -(2**63) + 1, e) for i, e in enumerate(edges)] + [(2 * i + 1, e, 2**63 - 1) for i, e in enumerate(edges)]
        got = {r[0]: (r[1], r[2]) for r in s.multi_scan(spark.createDataFrame(ranges, "range_id long, low long, high long")).groupBy("range_id").agg({"key": "count", "value": "sum"}).select("range_id", "count(key)", "sum(value)").collect()}
        for i, low, high in ranges:
            inside = [v for k, v in want.items() if low <= k <= high]
            assert got.get(i, (0, None)) == (len(inside), sum(inside) if inside else None)


def test_many_pages(spark, tmp_path):
    n = 300_000
    with Store.open(spark, f"{tmp_path}/s", compaction_policy="leveled", memtable_capacity=n, sst_implementation="btree") as s:
        s.put_all(spark.range(n).selectExpr("id * 3 AS key", "id AS value"))
        s.put_all(spark.range(0, n, 7).selectExpr("id * 3 AS key", "-id AS value"))
        s.delete_all(spark.range(0, n, 11).selectExpr("id * 3 AS key"))
        live = s.scan(0, 3 * n).selectExpr("count(*)", "sum(value)").first()
        want = [-i if i % 7 == 0 else i for i in range(n) if i % 11]
        assert tuple(live) == (len(want), sum(want))
        assert [s.get(3 * k) for k in (1, 7, 11, 299_998)] == [1, -7, None, 299_998]


def _row_groups(spark, path):
    from pathlib import Path

    jvm = spark.sparkContext._jvm
    for file in Path(path).glob("*.parquet"):
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(str(file)), spark.sparkContext._jsc.hadoopConfiguration())
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        yield from reader.getFooter().getBlocks()
        reader.close()


def test_runs_carry_bloom_filters_that_skip_absent_keys(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id * 2 AS key", "id AS value")
    seen = {}
    for bloom in (True, False):
        with Store.open(spark, f"{tmp_path}/{bloom}", enable_bloom_filter=bloom, bloom_filter_bits_per_entry=10) as s:
            s.put_all(rows)
            run = s.levels[0][0]
            assert all((g.getColumns()[0].getBloomFilterOffset() > 0) == bloom for g in _row_groups(spark, f"{tmp_path}/{bloom}/{run.path}"))
            seen[bloom] = 0
            for key in range(10_001, 10_041, 2):  # odd keys are absent, within the run's bounds
                found = s.log(key, key).filter(f"key = {key}")
                assert found._jdf.collectAsList().size() == 0
                leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
                seen[bloom] += leaf.metrics().apply("numOutputRows").value() > 0
    assert seen[False] == 20 and seen[True] <= 3


def test_a_lazy_scan_survives_merges_until_vacuum(spark, tmp_path):
    with Store.open(spark, f"{tmp_path}/s", compaction_policy="leveled", memtable_capacity=1) as s:
        s.put_all(spark.range(10).selectExpr("id AS key", "id AS value"))
        early = s.scan(0, 100)
        for i in range(4):
            s.put_all(spark.range(10).selectExpr("id AS key", f"id + {i} AS value"))
        assert entries(early) == [(k, k) for k in range(10)]
        assert s.vacuum() == [] and len(s.vacuum(0)) > 0
        assert entries(s.scan(0, 100)) == [(k, k + 3) for k in range(10)]


def test_bulk_input_is_evaluated_once(spark, tmp_path):
    from pyspark.sql import functions as F

    with Store.open(spark, f"{tmp_path}/s") as s:
        s.put_all(spark.range(2000).select(F.col("id").alias("key"), F.lit(1).alias("value")).filter(F.rand() < 0.5))
        assert s.levels[0][0].entries == s.scan(0, 2000).count()
        s.put_all(spark.createDataFrame([(1, 50, 1), (1, 20, 2), (2, 5, 1)], "key long, value long, at long"), order="at")
        assert entries(s.scan(1, 2)) == [(1, 20), (2, 5)]


@pytest.mark.parametrize("policy,ratio,bloom", [("none", 2, True), ("leveled", 2, False), ("tiered", 3, True), ("dostoevsky", 3, False)])
def test_random_writes_match_a_dict(spark, tmp_path, policy, ratio, bloom):
    rng, want = random.Random(policy), {}
    with Store.open(spark, f"{tmp_path}/s", memtable_capacity=12, compaction_policy=policy, sst_size_ratio=ratio, enable_bloom_filter=bloom, sst_implementation="btree") as s:
        for _ in range(90):
            k = rng.randrange(-15, 15)
            if rng.random() < 0.3:
                s.delete(k)
                want.pop(k, None)
            else:
                v = rng.randrange(10**6)
                s.put(k, v)
                want[k] = v
        assert entries(s.scan(-20, 20)) == sorted(want.items())
        for k in (-15, 0, 7):
            assert s.get(k) == want.get(k)


def test_bulk_writes_and_batched_reads(spark, tmp_path):
    with Store.open(spark, f"{tmp_path}/s", compaction_policy="leveled") as s:
        s.put_all(spark.range(-500, 500).selectExpr("id AS key", "id * 10 AS value"))
        s.delete_all(spark.range(-500, 500, 3).selectExpr("id AS key"))
        s.put_all(spark.createDataFrame([(1, 5), (1, 7)], "key long, value long"))
        want = {k: k * 10 for k in range(-500, 500) if (k + 500) % 3} | {1: 7}
        assert entries(s.scan(-9999, 9999)) == sorted(want.items())
        got = dict(entries(s.multi_get(spark.createDataFrame([(1,), (-500,), (2,), (777,)], "key long"))))
        assert got == {k: want.get(k) for k in (1, -500, 2, 777)}
        ranges = spark.createDataFrame([(0, -3, 3), (1, 5, 4)], "range_id long, low long, high long")
        assert sorted(tuple(r) for r in s.multi_scan(ranges).collect()) == [(0, k, v) for k, v in sorted(want.items()) if -3 <= k <= 3]


def test_rejections(spark, tmp_path):
    s = Store.open(spark, f"{tmp_path}/s")
    for call in (lambda: s.put(MIN, 1), lambda: s.put(1, MIN), lambda: s.delete(MIN), lambda: s.put("a", 1), lambda: s.configure(memtable_capacity=0), lambda: s.configure(sst_size_ratio=1), lambda: s.configure(bloom_filter_bits_per_entry=0), lambda: s.configure(compaction_policy="x"), lambda: s.configure(nothing=1), lambda: Store.open(spark, " ")):
        with pytest.raises(ValueError):
            call()
    assert s.configure(memtable_capacity_mb=1).config.memtable_capacity == 65536
    s.close()
    s.close()
    with pytest.raises(RuntimeError):
        s.get(1)
    with pytest.raises(Exception):
        with Store.open(spark, f"{tmp_path}/t") as t:
            t.put_all(spark.createDataFrame([(MIN, 1)], "key long, value long"))


def run(spark, rows, seq):
    return spark.createDataFrame([(k, v, seq, v is None) for k, v in rows], RUN)


@pytest.mark.parametrize("drop", [False, True])
def test_merge(spark, drop):
    """Four runs, oldest first; a key's last run decides."""
    rng, last, runs = random.Random(21), {}, []
    for seq in range(1, 5):
        rows = {k: None if rng.random() < 0.35 else rng.randrange(900) for k in rng.sample(range(-40, 40), 25)}
        last |= rows
        runs.append(run(spark, rows.items(), seq))
    assert sorted(entries(state.merge(runs, drop))) == sorted((k, v) for k, v in last.items() if v is not None or not drop)
    assert entries(state.merge([run(spark, [(3, None)], 1), run(spark, [(4, None)], 2)], True)) == []


def test_geometry():
    for n in (0, 1, 255, 256, 257, 5000, 131_072, 131_073, 40_000_000):
        pages = layout.pages(n)
        assert pages * layout.PER_PAGE >= n > (pages - 1) * layout.PER_PAGE or n == pages == 0
        top = layout.tree_depth(n)
        assert layout.FANOUT**top >= pages and (top == 0 or layout.FANOUT ** (top - 1) < pages)
        if n:
            assert layout.nodes_at(0, n) == 1 and layout.nodes_at(top, n) == pages and layout.leaves_below(top, n) == 1
            assert layout.subtree_height(0, n) == top and layout.subtree_height(top, n) == 0
            assert layout.node_byte(top, pages - 1, n) // layout.PAGE_BYTES == sum(layout.nodes_at(d, n) for d in range(top + 1)) - 1
            assert layout.seek(n - 1, n) == ((n - 1) // 256, (n - 1) % 256 * 16)
    with pytest.raises(ValueError):
        layout.seek(5, 5)


def test_fences_and_bounds(spark):
    keys = spark.range(0, 5 * 1000, 5).withColumnRenamed("id", "key")
    assert sorted(tuple(r) for r in layout.fences(keys, 300).collect()) == [(0, 1495, 300), (1, 2995, 300), (2, 4495, 300), (3, 4995, 100)]
    six = [-8, -2, 0, 13, 14, 90]
    df = spark.createDataFrame([(k,) for k in six], "key long")
    for p in (-9, -8, 0, 13, 50, 90, 91):
        assert tuple(layout.bounds(df, p).first()) == (sum(k < p for k in six), sum(k <= p for k in six) - 1)


def test_wide_and_skewed_keys(spark):
    keys = [-(2**63) + 1, 2**63 - 1, *range(5000), 2**40]
    ranked = layout.ranked(spark.createDataFrame([(k,) for k in keys], "key long").repartition(5))
    assert {r["key"]: r["index"] for r in ranked.collect()} == {k: i for i, k in enumerate(sorted(keys))}
    log = run(spark, [(k, k % 1000) for k in keys], 1).unionByName(run(spark, [(17, None)], 2))
    ranges = [(0, -(2**63) + 1, 2**63 - 1), (1, -(2**62), 2**62), (2, 17, 17), (3, 2**63 - 1, 2**63 - 1), (4, 9, 3), (5, 1000, 1999), (6, -(2**63) + 1, -1)]
    frame = spark.createDataFrame(ranges, "range_id long, low long, high long")
    assert sorted((r[0], r[1]) for r in state.multi_scan(log, frame).collect()) == sorted((i, k) for i, low, high in ranges for k in keys if low <= k <= high and k != 17)
    assert max(r["count"] for r in state.dyadic_cells(frame).groupBy("range_id").count().collect()) <= 126


def test_key_range_reaches_the_scan(spark, tmp_path):
    with Store.open(spark, f"{tmp_path}/s") as s:
        s.put_all(spark.range(100).selectExpr("id AS key", "id AS value"))
        plan = s.scan(3, 5)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(key,3)" in plan and "LessThanOrEqual(key,5)" in plan


def test_stream_ingest(spark, tmp_path):
    from tierstone.streaming.ingest import ingest

    run(spark, [(1, 1), (2, 2)], 5).unionByName(run(spark, [(1, None), (3, 3)], 6)).write.parquet(f"{tmp_path}/in")
    with Store.open(spark, f"{tmp_path}/s") as s:
        ingest(spark.readStream.schema(RUN).parquet(f"{tmp_path}/in"), s, f"{tmp_path}/c").awaitTermination()
        assert entries(s.scan(0, 9)) == [(2, 2), (3, 3)]
        # an older change that comes in a later batch hides nothing, and a later put of the store's own wins
        run(spark, [(2, 99), (1, 98), (4, 4)], 3).write.mode("append").parquet(f"{tmp_path}/in")
        ingest(spark.readStream.schema(RUN).parquet(f"{tmp_path}/in"), s, f"{tmp_path}/c").awaitTermination()
        assert entries(s.scan(0, 9)) == [(2, 2), (3, 3), (4, 4)]
        s.put(2, 7)
        assert s.get(2) == 7
