"""Queries of the versioned-table engine over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bloom, layout
from .operators import state
from .plans.policy import Policy, make_room
from .session import fresh_path, written
from .store import Store


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a history: users are keys, error events are deletes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("key"), F.round(F.col("value") * 100).cast("long").alias("value"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("is_delete"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as one old run."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("key"), F.round(F.col("o_totalprice") * 100).cast("long").alias("value"), F.lit(-1).cast("long").alias("seq"), F.lit(False).alias("is_delete"))


LOG = """log AS (SELECT user_id AS key, CAST(round(value * 100) AS BIGINT) AS value, event_id AS seq, event_type = 'error' AS is_delete FROM events)"""
ORDERS = """base AS (SELECT o_orderkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS value, -1::BIGINT AS seq, false AS is_delete FROM orders)"""


def _latest(source: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {source}) WHERE rn = 1)"


def _visible(source: str = "log") -> str:
    return f"(SELECT key, value FROM {_latest(source)} WHERE NOT is_delete)"


RUN_LENGTH, RANGES, PROBES = 1000, [(0, 10, 20), (1, 25, 25), (2, 90, 60), (3, -5, 3), (4, 140, 999), (5, -(2**62), 2**62)], [-5, 0, 77, 149, 10**6]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@_query(f"WITH {LOG} SELECT key, value FROM {_visible()}")
def latest_state(spark, sf_dir):
    return state.visible(op_log(spark, sf_dir))


@_query(f"WITH {LOG} SELECT key, CASE WHEN is_delete THEN NULL ELSE value END AS value, seq, is_delete FROM {_latest('log')}")
def latest_with_tombstones(spark, sf_dir):
    return state.latest(op_log(spark, sf_dir)).withColumn("value", F.when(~F.col("is_delete"), F.col("value")))


@_query(f"WITH {LOG} SELECT key, value FROM {_visible()} WHERE key = (SELECT min(key) FROM {_visible()})")
def point_get_hit(spark, sf_dir):
    log = op_log(spark, sf_dir)
    key = state.visible(log).agg(F.min("key")).first()[0]
    return state.get(log, key)


@_query(f"WITH {LOG} SELECT key, value FROM {_visible()} WHERE key = -1")
def point_get_missing(spark, sf_dir):
    return state.get(op_log(spark, sf_dir), -1)


@_query(f"WITH {LOG} SELECT key, value FROM {_visible()} WHERE key = (SELECT min(key) FROM {_latest('log')} WHERE is_delete)")
def point_get_deleted(spark, sf_dir):
    log = op_log(spark, sf_dir)
    return state.get(log, state.latest(log).filter("is_delete").agg(F.min("key")).first()[0])


@_query(f"WITH {LOG}, k AS (SELECT unnest(range(-10, 60))::BIGINT AS key) SELECT k.key, v.value FROM k LEFT JOIN {_visible()} v ON k.key = v.key")
def multi_get(spark, sf_dir):
    return state.multi_get(op_log(spark, sf_dir), spark.range(-10, 60).withColumnRenamed("id", "key"))


@_query(f"WITH {LOG} SELECT key, value FROM {_visible()} WHERE key BETWEEN 10 AND 110")
def range_scan(spark, sf_dir):
    return state.scan(op_log(spark, sf_dir), 10, 110)


@_query(f"WITH {LOG} SELECT key, value FROM {_visible()} WHERE key BETWEEN -9223372036854775807 AND 0 OR key BETWEEN 149 AND 149 OR key >= 9223372036854775807")
def range_scan_edges(spark, sf_dir):
    log = op_log(spark, sf_dir)
    return state.scan(log, -(2**63) + 1, 0).unionByName(state.scan(log, 149, 149)).unionByName(state.scan(log, 2**63 - 1, 2**63 - 1))


@_query(f"WITH {LOG} SELECT key, value FROM {_visible()} WHERE key BETWEEN 20 AND 10")
def range_scan_inverted(spark, sf_dir):
    return state.scan(op_log(spark, sf_dir), 20, 10)


@_query(f"WITH {LOG}, r(range_id, low, high) AS (VALUES {', '.join(f'({i}::BIGINT, {a}::BIGINT, {b}::BIGINT)' for i, a, b in RANGES)}) SELECT range_id, key, value FROM r JOIN {_visible()} v ON v.key BETWEEN low AND high")
def multi_range_scan(spark, sf_dir):
    return state.multi_scan(op_log(spark, sf_dir), spark.createDataFrame(RANGES, "range_id long, low long, high long"))


@_query(f"WITH {LOG}, {ORDERS}, u AS (SELECT * FROM base UNION ALL SELECT * FROM log) SELECT key, value FROM {_visible('u')}")
def base_then_overlay(spark, sf_dir):
    return state.visible(base(spark, sf_dir).unionByName(op_log(spark, sf_dir)))


@_query(f"WITH {LOG} SELECT seq // {RUN_LENGTH} AS run, count(DISTINCT key) AS entries FROM log GROUP BY 1")
def run_entry_counts(spark, sf_dir):
    return op_log(spark, sf_dir).groupBy(F.floor(F.col("seq") / RUN_LENGTH).alias("run")).agg(F.count_distinct("key").alias("entries"))


@_query(f"WITH {LOG} SELECT seq // {RUN_LENGTH} AS run, min(key) AS min_key, max(key) AS max_key, max(seq) AS max_seq, count(*) AS n_writes FROM log GROUP BY 1")
def run_min_max(spark, sf_dir):
    return op_log(spark, sf_dir).groupBy(F.floor(F.col("seq") / RUN_LENGTH).alias("run")).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max("seq").alias("max_seq"), F.count("*").alias("n_writes"))


def _whole_runs(spark, sf_dir, n: int = 3) -> list[DataFrame]:
    """The whole log as ``n`` runs of like seq ranges; the first and the last have no outer end, so nothing is left out."""
    log = op_log(spark, sf_dir)
    last = log.agg(F.max("seq")).first()[0] or 0
    cuts = [(last + 1) * i // n for i in range(1, n)]
    inside = [F.lit(True), *(F.col("seq") >= c for c in cuts)], [*(F.col("seq") < c for c in cuts), F.lit(True)]
    return [state.latest(log.filter(low & high)) for low, high in zip(*inside)]


@_query(f"WITH {LOG} SELECT key, value, seq, is_delete FROM {_latest('log')}")
def merge_keep_tombstones(spark, sf_dir):
    return state.merge(_whole_runs(spark, sf_dir), drop_deletes=False)


@_query(f"WITH {LOG} SELECT key, value, seq, is_delete FROM {_latest('log')} WHERE NOT is_delete")
def merge_drop_tombstones(spark, sf_dir):
    return state.merge(_whole_runs(spark, sf_dir), drop_deletes=True)


@_query(f"WITH i AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders) SELECT idx // {layout.PER_PAGE} AS page, max(key) AS fence, count(*) AS n FROM i GROUP BY 1")
def page_fences(spark, sf_dir):
    return layout.fences(base(spark, sf_dir).select("key"))


@_query(f"WITH i AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders) SELECT key, idx // {layout.PER_PAGE} AS page, idx % {layout.PER_PAGE} AS byte_slot FROM i")
def page_places(spark, sf_dir):
    at = layout.place(F.col("index"))
    return layout.ranked(base(spark, sf_dir).select("key")).select("key", at["page"].alias("page"), at["offset"].alias("byte_slot"))


@_query(" UNION ALL ".join(f"SELECT {p}::BIGINT AS probe, count(*) FILTER (o_orderkey < {p}) AS leftmost, count(*) FILTER (o_orderkey <= {p}) - 1 AS rightmost FROM orders" for p in PROBES))
def key_rank(spark, sf_dir):
    keys = base(spark, sf_dir).select("key")
    # one pass for all probes
    probes = F.explode(F.array(*(F.lit(p).cast("long") for p in PROBES)))
    sums = keys.select("key", probes.alias("probe")).groupBy("probe").agg(F.count_if(F.col("key") < F.col("probe")).alias("leftmost"), (F.count_if(F.col("key") <= F.col("probe")) - 1).alias("rightmost"))
    return sums


@_query(f"""WITH s AS (SELECT count(*) AS entries FROM orders UNION ALL SELECT count(*) FROM lineitem UNION ALL SELECT count(*) FROM events UNION ALL SELECT count(*) FROM region),
p AS (SELECT entries, CAST(ceil(entries / {layout.PER_PAGE}.0) AS BIGINT) AS n_pages FROM s)
SELECT entries, n_pages, CASE WHEN n_pages > {layout.FANOUT**2} THEN 3 WHEN n_pages > {layout.FANOUT} THEN 2 WHEN n_pages > 1 THEN 1 ELSE 0 END::BIGINT AS depth,
       (CASE WHEN n_pages > 1 THEN ceil(n_pages / {layout.FANOUT}.0) ELSE 0 END + CASE WHEN n_pages > {layout.FANOUT} THEN ceil(n_pages / {layout.FANOUT**2}.0) ELSE 0 END + CASE WHEN n_pages > {layout.FANOUT**2} THEN ceil(n_pages / {layout.FANOUT**3}.0) ELSE 0 END)::BIGINT AS inner_nodes FROM p""")
def tree_shape(spark, sf_dir):
    sizes = None
    for t in ("orders", "lineitem", "events", "region"):
        n = spark.read.parquet(f"{sf_dir}/{t}.parquet").agg(F.count("*").alias("entries"))
        sizes = n if sizes is None else sizes.unionByName(n)
    return layout.tree_shape(sizes)


@_query(f"WITH {LOG} SELECT DISTINCT key FROM log")
def bloom_no_false_negatives(spark, sf_dir):
    keys = op_log(spark, sf_dir).select("key").distinct()
    n = keys.count()
    return bloom.contains(keys, bloom.build(keys, n, 5), n, 5)


@_query(f"WITH {LOG} SELECT key, value FROM {_visible('(SELECT * FROM log WHERE seq <= (SELECT max(seq) // 2 FROM log))')}")
def as_of_state(spark, sf_dir):
    log = op_log(spark, sf_dir)
    return state.as_of(log, (log.agg(F.max("seq")).first()[0] or 0) // 2)


class _Units:
    def __init__(self, entries: int) -> None:
        self.entries = entries


def level_shape(policy: Policy, ratio: int, flushes: int) -> list[list[int]]:
    """Run sizes in memtable units after ``flushes`` flushes of distinct keys."""
    levels: list[list[_Units]] = [[]]
    for _ in range(flushes):
        make_room(levels, policy, ratio, 1, lambda runs, _: _Units(sum(r.entries for r in runs)))
        levels[0].append(_Units(1))
    return [[r.entries for r in level] for level in levels]


@_query(f"WITH {LOG} SELECT count(DISTINCT key) AS members, count(DISTINCT key) AS members_found, {1 << 15}::BIGINT AS absent, true AS few_false FROM log")
def bloom_false_positives(spark, sf_dir):
    """Members are all found; of 32,768 absent keys at most 14 % are (9.2 % expected at 5 bits an entry)."""
    keys = op_log(spark, sf_dir).select("key").distinct()
    n, top = keys.agg(F.count("*"), F.max("key")).first()
    built = bloom.build(keys, n, 5)
    absent = spark.range(top + 1, top + 1 + (1 << 15)).withColumnRenamed("id", "key")
    found = bloom.contains(keys.unionByName(absent), built, n, 5)
    sums = found.agg(F.count_if(F.col("key") <= top).alias("members_found"), F.count_if(F.col("key") > top).alias("hits"))
    return sums.select(F.lit(n).alias("members"), "members_found", F.lit(1 << 15).cast("long").alias("absent"), (F.col("hits") <= 0.14 * (1 << 15)).alias("few_false"))


#: Run sizes by level, in memtable units, for size ratio 3 after so many flushes of distinct keys.
SHAPES = {
    (Policy.NONE, 6): [[1] * 6], (Policy.NONE, 9): [[1] * 9],
    (Policy.LEVELED, 6): [[1], [2], [3]], (Policy.LEVELED, 9): [[1], [2], [6]],
    (Policy.TIERED, 6): [[1], [1, 1], [3]], (Policy.TIERED, 9): [[1], [1, 1], [3, 3]],
    (Policy.DOSTOEVSKY, 6): [[1], [1, 1], [3]], (Policy.DOSTOEVSKY, 9): [[1], [1, 1], [6]],
}


def _shape_query(policy: Policy, flushes: int):
    """Runs of a store into which all orders are put in ``flushes`` parts of like size, by rank of their keys."""

    def run(spark, sf_dir):
        at = layout.ranked(base(spark, sf_dir).select("key", "value"))
        n = at.count()
        part = F.least(F.floor(F.col("index") / max(1, n // flushes)), F.lit(flushes - 1))
        dealt = written(at.select("key", "value", part.alias("part")), "store-parts")
        # a unit is the largest part, so that a level's runs count as so many memtables
        with Store.open(spark, fresh_path(spark, "store"), compaction_policy=policy.value, sst_size_ratio=3, memtable_capacity=max(1, n // flushes + n % flushes)) as s:
            for i in range(flushes):
                s.put_all(dealt.filter(F.col("part") == i))
            rows = [(lv, i, r.entries) for lv, runs in enumerate(s.levels) for i, r in enumerate(runs)]
        return spark.createDataFrame(rows, "level long, run long, entries long")

    return run


def _shape_sql(levels: list[list[int]], flushes: int) -> str:
    """A run's entries are those of its parts, which are dealt to the runs from the oldest: the last level's first, each level in order."""
    runs, start = [], 0
    for lv in reversed(range(len(levels))):
        for i, n in enumerate(levels[lv]):
            runs.append((lv, i, start, start + n))
            start += n
    values = ", ".join(f"({lv}::BIGINT, {i}::BIGINT, {a}::BIGINT, {b}::BIGINT)" for lv, i, a, b in runs)
    return f"""WITH n AS (SELECT count(*) AS n FROM orders), s(level, run, a, b) AS (VALUES {values})
SELECT level, run, ((b - a) * (n // {flushes}) + CASE WHEN b = {flushes} THEN n % {flushes} ELSE 0 END)::BIGINT AS entries FROM s, n"""


for (_p, _n), _levels in SHAPES.items():
    QUERIES[f"level_shape_{_p.value}_{_n}"] = _shape_query(_p, _n)
    ORACLE_SQL[f"level_shape_{_p.value}_{_n}"] = _shape_sql(_levels, _n)


def _filled(spark, sf_dir, policy: Policy, parts: int = 4, **config) -> Store:
    """A store with the whole op log, in parts by seq; each part is one bulk delete and one bulk put."""
    store = Store.open(spark, fresh_path(spark, "store"), compaction_policy=policy.value, sst_size_ratio=3, memtable_capacity=64, **config)
    for run in _whole_runs(spark, sf_dir, parts):
        store.delete_all(run.filter("is_delete").select("key"))
        store.put_all(run.filter("NOT is_delete").select("key", "value"))
    return store


def _scan_query(policy: Policy):
    def run(spark, sf_dir):
        """Every key after merges, by a scan without ends."""
        return _filled(spark, sf_dir, policy, sst_implementation="btree" if policy is Policy.TIERED else "array").scan(-(2**63) + 1, 2**63 - 1)

    return run


for _p in Policy:
    QUERIES[f"store_scan_{_p.value}"] = _scan_query(_p)
    ORACLE_SQL[f"store_scan_{_p.value}"] = f"WITH {LOG} SELECT key, value FROM {_visible()}"


@_query(f"WITH {LOG}, k AS (SELECT unnest(range(-10, 60))::BIGINT AS key) SELECT k.key, v.value FROM k LEFT JOIN {_visible()} v ON k.key = v.key")
def store_reopen(spark, sf_dir):
    """A closed store opened again by its name, and a batched get."""
    store = _filled(spark, sf_dir, Policy.DOSTOEVSKY)
    store.close()
    return Store.open(spark, store.name).multi_get(spark.range(-10, 60).withColumnRenamed("id", "key"))


@_query(f"WITH {LOG}, u AS (SELECT key, value FROM {_visible()} WHERE key % 5 <> 0), o AS (SELECT key, value + 1 AS value FROM u WHERE key % 3 = 0 UNION ALL SELECT key, value FROM u WHERE key % 3 <> 0) SELECT key, value FROM o WHERE key BETWEEN 7 AND 120")
def store_overwrite_delete(spark, sf_dir):
    """Bulk overwrites of every third key and bulk deletes of every fifth, over the log in an earlier run; a scan with both ends."""
    log = op_log(spark, sf_dir)
    store = Store.open(spark, fresh_path(spark, "store"), compaction_policy="leveled", sst_size_ratio=2, memtable_capacity=16)
    store.write_log(log)
    now = written(state.visible(log), "store-now")
    store.put_all(now.filter("key % 3 = 0").selectExpr("key", "value + 1 AS value"))
    store.delete_all(now.filter("key % 5 = 0").select("key"))
    return store.scan(7, 120)


@_query(f"WITH {LOG}, k AS (SELECT (SELECT min(key) FROM {_visible()}) AS key UNION ALL SELECT (SELECT min(key) FROM {_latest('log')} WHERE is_delete) UNION ALL SELECT -1), g AS (SELECT key FROM k WHERE key IS NOT NULL) SELECT g.key, v.value FROM g LEFT JOIN {_visible()} v ON g.key = v.key")
def store_get(spark, sf_dir):
    """Single gets of a live, a deleted and an absent key; what a single put and a single delete changed is undone by later ones."""
    last = written(state.latest(op_log(spark, sf_dir)), "store-latest")
    live, gone = last.agg(F.min(F.when(~F.col("is_delete"), F.col("key"))), F.min(F.when(F.col("is_delete"), F.col("key")))).first()
    with _filled(spark, sf_dir, Policy.TIERED) as s:
        keys = [k for k in (live, gone, -1) if k is not None]
        before = {k: s.get(k) for k in keys}
        for k in keys:
            s.put(k, 12345)
            assert s.get(k) == 12345
            s.delete(k)
            assert s.get(k) is None
            if before[k] is not None:
                s.put(k, before[k])
        return spark.createDataFrame([(k, s.get(k)) for k in keys], "key long, value long")


@_query(f"""WITH d AS (SELECT unnest(range(0, 3)) AS depth), n AS (SELECT count(*) AS entries FROM lineitem), p AS (SELECT entries, CAST(ceil(entries / {layout.PER_PAGE}.0) AS BIGINT) AS pages FROM n),
t AS (SELECT *, CASE WHEN pages > {layout.FANOUT} THEN 2 WHEN pages > 1 THEN 1 ELSE 0 END AS top FROM p)
SELECT depth::BIGINT AS depth, (top - depth)::BIGINT AS height, CAST(ceil(pages / power({layout.FANOUT}, top - depth)) AS BIGINT) AS nodes, CAST(power({layout.FANOUT}, top - depth) AS BIGINT) AS leaves,
       (CASE WHEN depth = 0 THEN 0 WHEN depth = 1 THEN 1 ELSE 1 + CAST(ceil(pages / power({layout.FANOUT}, top - 1)) AS BIGINT) END * {layout.PAGE_BYTES})::BIGINT AS first_byte
FROM d, t WHERE depth <= top""")
def tree_levels(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    rows = [(d, layout.subtree_height(d, n), layout.nodes_at(d, n), layout.leaves_below(d, n), layout.node_byte(d, 0, n)) for d in range(layout.tree_depth(n) + 1)]
    return spark.createDataFrame(rows, "depth long, height long, nodes long, leaves long, first_byte long")
