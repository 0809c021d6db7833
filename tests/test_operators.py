"""Operators on small relations, and a case for each behaviour decided otherwise than it might be."""

import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from viewflow import operators as ops
from viewflow.functions import fields, floor_div, last_dropped, top_k, truthy, words
from viewflow.operators import JoinInput, ReduceTo, ReduceToCount, ReduceToList, ReduceToSum

LEFT = [("a1", "a1v"), ("a2", "a2v1"), ("a2", "a2v2"), ("w", "aw"), ("x", "ax"), ("y", "ay1"), ("y", "ay2"), ("z", "az1"), ("z", "az2")]
RIGHT = [("b1", "b1v"), ("b2", "b2v1"), ("b2", "b2v2"), ("w", "bw1"), ("w", "bw2"), ("x", "bx"), ("y", "by"), ("z", "bz1"), ("z", "bz2")]
few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(df):
    return sorted((r[0] for r in df.collect()), key=lambda x: (x is not None, x))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def ints(spark):
    return spark.createDataFrame([(k,) for k in range(10)], "value long")


@pytest.fixture
def sides(spark):
    return spark.createDataFrame(LEFT, "k string, v string"), spark.createDataFrame(RIGHT, "k string, v string")


def test_replace_each(ints):
    assert values(ops.replace_each(ints, F.col("value") * 2)) == list(range(0, 20, 2))
    assert values(ops.replace_each(ints, lambda x: 2 * x, "long")) == list(range(0, 20, 2))
    with pytest.raises(TypeError):
        ops.replace_each(ints, lambda x: x)


def test_filter(ints):
    assert values(ops.filter_rows(ints, "value % 2 = 1")) == [1, 3, 5, 7, 9]
    assert values(ops.filter_rows(ints, lambda x: x % 2)) == [1, 3, 5, 7, 9]
    assert values(ops.filter_rows(ints)) == list(range(1, 10))


def test_truthy(spark):
    df = spark.createDataFrame([("",), (None,), ("a",)], "s string")
    assert values(df.where(truthy(df))) == ["a"]
    df = spark.createDataFrame([([],), ([1],), (None,)], "s array<int>")
    assert values(df.where(truthy(df))) == [[1]]


def test_flatten_and_distinct(spark):
    arrays = spark.createDataFrame([([1, 2, 3],), ([4, 5, 6, 7],), ([6, 7, 8],)], "xs array<long>")
    flat = ops.flatten(arrays, last_dropped("xs"))
    assert values(flat) == [1, 2, 4, 5, 6, 6, 7]
    assert values(ops.flatten(arrays, lambda xs: xs[:-1], "long")) == [1, 2, 4, 5, 6, 6, 7]
    assert values(ops.distinct(flat)) == [1, 2, 4, 5, 6, 7]


def test_group(spark):
    pairs = spark.createDataFrame([(k // 3, k) for k in range(15)], "g long, i long")
    lists = ops.group(pairs, "g", ReduceToList(), retaining="i")
    assert rows(lists) == [(g, [3 * g, 3 * g + 1, 3 * g + 2]) for g in range(5)]
    assert rows(ops.group(pairs, "g", ReduceToSum(), retaining="i")) == [(0, 3), (1, 12), (2, 21), (3, 30), (4, 39)]
    assert rows(ops.group(pairs, "g"))[0][1][0].asDict() == {"g": 0, "i": 0}


def test_folds(spark):
    pairs = spark.createDataFrame([(k % 2, float(k)) for k in range(6)], "g long, x double")
    adding = ops.group(pairs, "g", ReduceTo.adding(0.15, lambda x: 0.85 * x), retaining="x")
    folded = ops.group(pairs, "g", ReduceTo(0.15, lambda a, x: a + 0.85 * x), retaining="x")
    python = ops.grouping.fold_rows(pairs, "g", lambda: 0.15, lambda a, r: a + 0.85 * r[1], "double", order="x")
    for g, want in ((0, 0.15 + 0.85 * 6), (1, 0.15 + 0.85 * 9)):
        for df in (adding, folded, python):
            assert math.isclose(dict(map(tuple, df.collect()))[g], want)


def test_a_zero_or_null_key_is_a_key(spark):
    zero = spark.createDataFrame([(0,), (0,)], "v long")
    assert rows(ops.group(zero, "v", ReduceToCount())) == [(0, 2)]
    nulls = spark.createDataFrame([(None,), (None,), ("a",)], "v string")
    assert rows(ops.group(nulls, "v", ReduceToCount())) == [("a", 1), (None, 2)]
    assert rows(ops.grouping.fold_rows(nulls, "v", lambda: 0, lambda a, r: a + 1, "long")) == [("a", 1), (None, 2)]
    assert values(ops.distinct(spark.createDataFrame([(None,), (None,), (1,)], "v long"))) == [None, 1]


def test_joins(sides):
    left, right = sides
    inner = ops.join(JoinInput(left, "k"), JoinInput(right, "k"))
    assert Counter(r[0].k for r in inner.collect()) == {"w": 2, "x": 1, "y": 2, "z": 4}
    for l, r, extra in ((True, False, {"a1": 1, "a2": 2}), (False, True, {"b1": 1, "b2": 2}), (True, True, {"a1": 1, "a2": 2, "b1": 1, "b2": 2})):
        got = ops.join(JoinInput(left, "k", l), JoinInput(right, "k", r)).where("_1 is null or _2 is null").collect()
        assert Counter((x[0] or x[1]).k for x in got) == extra
    with pytest.raises(ValueError):
        ops.join(JoinInput(left, "k", True), right, right)
    with pytest.raises(ValueError):
        ops.join(left)


def test_three_way_join_is_the_whole_product(spark, sides):
    third = spark.createDataFrame([("w", 1), ("x", 1), ("x", 2), ("z", 1)], "k string, n long")
    got = ops.join(JoinInput(sides[0], "k"), JoinInput(sides[1], "k"), JoinInput(third, "k")).collect()
    assert len(got) == 8 and all(x is not None for r in got for x in r)


def test_the_last_unmatched_row_stays(spark):
    z, a = spark.createDataFrame([("z", 1)], "k string, n long"), spark.createDataFrame([("a", 1)], "k string, n long")
    (row,) = ops.join(JoinInput(z, "k", outer=True), JoinInput(a, "k")).collect()
    assert row[0].k == "z" and row[1] is None
    zero = spark.createDataFrame([(0,)], "v long")
    assert ops.join(zero, zero).count() == 1


def test_join_on_key_and_halves(spark, sides):
    a = spark.createDataFrame([(r, 2 * r) for r in (3, 4, 6, 7, 8, 9)], "key long, value long")
    b = spark.createDataFrame([(r, 3 * r) for r in (0, 1, 2, 3, 4, 6, 7)], "key long, value long")
    assert rows(ops.join_on_key(a, b)) == [(3, 6, 9), (4, 8, 12), (6, 12, 18), (7, 14, 21)]
    assert {r.k for r in ops.semi_join(JoinInput(sides[0], "k"), JoinInput(sides[1], "k")).collect()} == {"w", "x", "y", "z"}
    assert {r.k for r in ops.anti_join(JoinInput(sides[0], "k"), JoinInput(sides[1], "k")).collect()} == {"a1", "a2"}
    assert ops.join_to(sides[0], JoinInput(sides[1], "k", outer=True), "k").count() == 12


def test_set_operations(spark):
    two, three = spark.createDataFrame([(1,), (1,)], "v long"), spark.createDataFrame([(1,), (1,), (1,)], "v long")
    assert ops.intersection_bag(two, three).count() == 6
    assert values(ops.intersection_set(two, three)) == [1]
    assert values(ops.union(two, spark.createDataFrame([(1,)], "v long"))) == [1]
    assert ops.union_all(two, three).count() == 5
    assert ops.subtract(three, two).count() == 0 and ops.subtract(three, two, keep_duplicates=True).count() == 1


def test_side_views(spark):
    xs, five = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4, 6, 7, 8, 9)], "value long"), spark.createDataFrame([(5,)], "value long")
    sign = ops.sideviews.augment_row(xs, five).select(F.when(F.col("value") > F.col("side.value"), 1).otherwise(-1).alias("s"))
    assert values(sign) == [-1] * 5 + [1] * 4
    with pytest.raises(PySparkException):
        ops.only_row(spark.createDataFrame([(0,), (1,)], "v long")).collect()
    assert ops.only_row(five.where("false")).first()[0] is None
    listed = ops.augment(five, xs, loaded_by=F.size("side"))
    assert rows(listed) == [(5, 9)]
    with pytest.raises(ValueError):
        ops.augment(five, xs, limit=3)


def test_lookups(spark):
    big = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "k long, v string")
    small = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (None, "nil", 1)], "k long, name string, t long")
    got = ops.mapside_join(big, small, "k", "k", ["t"])
    assert sorted((r.large.v, r.small.name) for r in got.collect()) == [("n", "nil"), ("x", "new")]
    assert rows(ops.mapside_join(big, small, "k", "k", ["t"], limit=1)) == rows(got)
    once = small.where("t = 2")
    assert {r.looked_up for r in ops.augment_lookup(big, once, "k", "k", "name").collect()} == {"new", None}
    with pytest.raises(PySparkException):
        ops.augment_lookup(big, once, "k", "k", "name", strict=True).collect()


def test_partitions_and_order(spark):
    xs = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4, 6, 7, 8, 9)], "value long")

    def running(values):
        total = 0
        for v in values:
            total += v
            yield total

    want = [0, 1, 3, 6, 10, 16, 23, 31, 40]
    assert values(ops.replace_each_partition(xs.coalesce(1), running, "long")) == want
    assert values(ops.running_sum(xs.repartition(4), "value", "value").select("running")) == want
    assert [r.row_id for r in ops.number_rows(xs.repartition(5), "value").orderBy("value").collect()] == list(range(9))
    grouped = ops.running_sum(xs.withColumn("g", F.col("value") % 2), "value", "value", within="g")
    assert grouped.where("value = 9").first().running == 1 + 3 + 7 + 9


def test_logging_passes_rows_through(ints, caplog):
    assert values(ops.log_progress(ops.log_echo_first(ints, 2), "seen", 3)) == list(range(10))
    seen = []
    list(iter(seen))
    assert values(ops.log_rows(ints, lambda r, i: None)) == list(range(10))


def test_commands(spark):
    rows = [(f"k{k % 3}", f"line {k}") for k in range(30)] + [(None, None)]
    df = spark.createDataFrame(rows, "k string, v string").repartition(4)
    assert sorted(r.value for r in ops.pipe(df, "cat", by="v").collect()) == sorted(["", *[f"line {k}" for k in range(30)]])
    assert ops.pipe(df.select("v"), "head -n 1").count() <= 4 and ops.pipe(df.where("false"), "cat", by="v").count() == 0
    counted = ops.map_reduce(df.where("k is not null"), "sed 's/$/\\t1/'", "cut -f 1 | uniq -c | sed 's/^ *//'", by="k", partitions=2)
    assert sorted(r.value for r in counted.collect()) == ["10 k0", "10 k1", "10 k2"]
    with pytest.raises(Exception, match="ended with 3"):
        ops.pipe(df, "cat > /dev/null; exit 3", by="v").collect()


def test_sample_is_repeatable(ints):
    a, b = (values(ops.sample(ints, 0.5, 3)) for _ in range(2))
    assert a == b and set(a) <= set(range(10))


def test_pairs(spark):
    a = spark.createDataFrame([(r, 2 * r) for r in (3, 4, 6, 7, 8, 9)], "key long, value long")
    b = spark.createDataFrame([(r, 3 * r) for r in (0, 1, 2, 3, 4, 6, 7)], "key long, value long")
    both = ops.union(a, b)
    assert both.count() == 13
    assert rows(ops.count_by_key(both)) == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (6, 2), (7, 2), (8, 1), (9, 1)]
    assert rows(ops.reduce_by_key(both)) == [(0, 0), (1, 3), (2, 6), (3, 15), (4, 20), (6, 30), (7, 35), (8, 16), (9, 18)]
    assert rows(ops.group_by_key(both))[3] == (3, [6, 9])
    assert ops.count_distinct_per_key(both, "key", "value").where("key = 3").first().value == 2
    assert rows(ops.top_k_per_group(both, "key", [F.desc("value")], 1))[3] == (3, 9)


def test_functions(spark):
    df = spark.createDataFrame([("  a B\tc ", -7, 2, [3, 1, 2])], "s string, a long, b long, l array<long>")
    got = df.select(words("s").alias("w"), fields(F.lit("x  y"), " ").alias("f"), floor_div(F.col("a"), F.col("b")).alias("d"), floor_div(F.col("a"), F.lit(0)).alias("z"), top_k(F.col("l"), 2).alias("t")).first()
    assert (got.w, got.f, got.d, got.z, got.t) == (["a", "b", "c"], ["x", "", "y"], -4, None, [3, 2])


@few
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3)), max_size=12), st.lists(st.one_of(st.none(), st.integers(-3, 3)), max_size=12))
def test_laws(spark, a, b):
    left, right = (spark.createDataFrame([(x,) for x in v], "v long") for v in (a, b))
    once = ops.union(left, right)
    assert values(once) == sorted(set(a) | set(b), key=lambda x: (x is not None, x))
    assert values(ops.union(once, once)) == values(once)
    m, n = Counter(a), Counter(b)
    assert ops.join(left, right).count() == sum(m[k] * n[k] for k in m)
    assert dict(map(tuple, ops.group(left, "v", ReduceToCount()).collect())) == dict(m)


def _rows_by_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]


def test_products_of_frequent_keys_are_dealt_out(spark):
    a, b = spark.range(1).selectExpr("cast(null as int) as k", "'x' as name"), spark.range(3000).selectExpr("cast(null as int) as k", "id as b")
    c = spark.range(2500).selectExpr("cast(null as int) as k", "if(id > 0, id, null) as c")
    got = ops.join(JoinInput(a, "k"), JoinInput(b, "k"), JoinInput(c, "k"))
    assert len(_rows_by_task(got)) > 1 and got.count() == 7_500_000
    assert got.agg(F.countDistinct("_2.b"), F.countDistinct("_3.c"), F.min("_1.name"), F.count("_3.c"), F.max("_3.k")).first()[:] == (3000, 2499, "x", 7_497_000, None)


def _made_by_explodes(plan):
    below = [n for k in range(plan.children().size()) for n in _made_by_explodes(plan.children().apply(k))]
    return below + ([plan.metrics().apply("numOutputRows").value()] if plan.nodeName() == "Generate" else [])


def test_a_product_is_handed_on_as_it_is_made(spark):
    a, b, c = (spark.range(n).selectExpr("cast(null as int) as k", f"id as {v}") for n, v in ((2, "a"), (3000, "b"), (2500, "c")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        first = ops.join(JoinInput(a, "k"), JoinInput(b, "k"), JoinInput(c, "k")).select("_1.a", "_2.b", "_3.c").limit(1)
        assert len(first.collect()) == 1
        made = _made_by_explodes(first._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(made) == 3 and 0 < max(made) < 2000  # a block's rows or two, not blocks multiplied


def test_copies_of_an_intersection_are_dealt_out(spark):
    a, b = spark.range(700).selectExpr("if(id < 699, null, 1L) as k", "'x' as v"), spark.range(500).selectExpr("if(id < 498, null, id - 497L) as k", "'x' as v")
    got = ops.intersection_bag(a, b)
    assert len(_rows_by_task(got)) > 1
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {None: 699 * 498, 1: 1}


def test_equal_lines_are_sorted_as_one(spark):
    df = spark.range(100_003).selectExpr("if(id < 100000, 'a', 'b') as value")
    got = ops.map_reduce(df, "cat", "uniq -c | sed 's/^ *//'", partitions=2)
    assert sorted(r.value for r in got.collect()) == ["100000 a", "3 b"]
    assert "HashAggregate" in got._jdf.queryExecution().executedPlan().toString()
