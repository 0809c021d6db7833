"""Sources, views, workflows, the fluent form, programs and streams."""

import csv
import io
import itertools
import math
import random
import re
import tempfile
from collections import Counter
from functools import partial
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from viewflow import operators as ops
from viewflow import queries, recipes, sources, streaming
from viewflow.functions import words
from viewflow.operators import ReduceTo, ReduceToCount, ReduceToSum
from viewflow.plans import (
    Augment, Context, Distinct, Filter, Flatten, Format, Group, Jin, Join, JoinTo, LogEchoFirst, LogProgress, MapsideJoin, ReadBlocks, ReadCSV, ReadLines, ReplaceEach, ReplaceEachPartition, ReuseView, Union, UnionTo, Workflow, Wrap, cli,
)

XA, D = [0, 1, 2, 3, 4, 6, 7, 8, 9], [5]


def values(df):
    return sorted(r[0] for r in df.collect())


def test_lines_csv_and_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a\n\n\nb\nc\n\nd\n")
    assert [r.value for r in sources.read_lines(spark, str(tmp_path / "a.txt")).collect()] == ["a", "", "", "b", "c", "", "d"]
    for end in (None, lambda line: line == ""):
        got = sources.read_blocks(spark, str(tmp_path / "a.txt"), is_end=end).orderBy("block").collect()
        assert [r.lines for r in got] == [["a"], [], ["b", "c"], ["d"]]
    (tmp_path / "b.txt").write_text("a\n\n\nb\n")
    assert [r.lines for r in sources.read_blocks(spark, str(tmp_path / "b.txt")).orderBy("block").collect()] == [["a"], [], ["b"]]
    (tmp_path / "c.csv").write_text("1;'x;y'\n2;z\n")
    assert [r.value for r in sources.read_csv(spark, str(tmp_path / "c.csv"), delimiter=";", quotechar="'").collect()] == [["1", "x;y"], ["2", "z"]]
    assert sources.whole_text_files(spark, str(tmp_path / "b.txt")).first().value == "a\n\n\nb\n"
    with pytest.raises(ValueError):
        sources.read_lines(spark, "../x")


FIELD = st.text(st.sampled_from('ab ;"\n\r,\''), max_size=5)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(FIELD, min_size=1, max_size=4), max_size=6), st.sampled_from([{}, {"delimiter": ";"}, {"quotechar": "'"}]))
def test_csv_is_the_csv_module(spark, rows, options):
    out = io.StringIO()
    csv.writer(out, **options).writerows(rows)
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "x.csv").write_bytes(out.getvalue().encode())
        got = sources.read_csv(spark, folder, **options).collect()
    assert [r.value for r in got] == list(csv.reader(io.StringIO(out.getvalue(), newline=""), **options))


def test_csv_widths(spark, tmp_path):
    (tmp_path / "c.csv").write_text('1,"x ""y"" z"\n"a\nb",,\n\n3\n')
    path = str(tmp_path / "c.csv")
    rows = lambda **o: [r.value for r in sources.read_csv(spark, path, **o).collect()]
    assert rows() == [["1", 'x "y" z'], ["a\nb", "", ""], [], ["3"]]
    assert rows(columns=3) == [["1", 'x "y" z', None], ["a\nb", "", ""], [None] * 3, ["3", None, None]]
    with pytest.raises(Exception, match="has 3 fields, over 2"):
        rows(columns=2)
    with pytest.raises(TypeError):
        rows(inferSchema=True)
    (tmp_path / "d.csv").write_text("1,2\n3\n" * 50)
    assert sources.read_csv(spark, str(tmp_path / "d.csv"), multiline=False).count() == 100


def plain_blocks(text, is_end):
    now, out = [], []
    for line in io.StringIO(text, newline="\n"):
        if is_end(line.removesuffix("\n")):
            out.append(now)
            now = []
        else:
            now.append(line.removesuffix("\n"))
    return out + [now] if now else out


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("ab\n", max_size=12), min_size=1, max_size=4), st.sampled_from(["", "a"]))
def test_blocks_are_the_generators(spark, texts, end):
    with tempfile.TemporaryDirectory() as folder:
        for k, text in enumerate(texts):
            Path(folder, f"f{k}").write_text(text)
        got = sources.read_blocks(spark, folder, is_end=None if end == "" else lambda line: line == end).collect()
        small = spark.newSession()
        small.conf.set("spark.sql.files.maxPartitionBytes", "3")
        split = sources.read_blocks(small, folder, is_end=None if end == "" else lambda line: line == end).collect()
    want = sorted((f"f{k}", n, lines) for k, text in enumerate(texts) for n, lines in enumerate(plain_blocks(text, lambda x: x == end)))
    for rows in (got, split):
        assert sorted((r.path.rsplit("/", 1)[1], r.block, r.lines) for r in rows) == want


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n long, s string")
    assert sources.save_text(df, str(tmp_path / "x"), F.format_string("%d-%s", "n", "s")) == 2
    assert sorted((tmp_path / "x").read_text().split()) == ["1-a", "2-b"]
    sources.single_text_file(df.select("s"), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    assert values(sources.store_rows(df, str(tmp_path / "p"))) == [1, 2] == values(sources.reuse(spark, str(tmp_path / "p")))


class Numbers(Workflow):
    xa = Wrap([(x,) for x in XA], "value long") | ReplaceEach(by="value")
    low, high = xa | Filter(by="value <= 7"), xa | Filter(by="value >= 3")
    both = Join(Jin(low), Jin(high)) | ReplaceEach(by={"value": "_1.value"})
    five = Wrap([(x,) for x in D], "value long")
    signs = xa | Augment(sideview=five, one_row=True) | ReplaceEach(by={"s": "if(value > side.value, 1, -1)"})
    everything = Union(xa, five)


class MoreNumbers(Numbers):
    doubled = Numbers.both | ReplaceEach(by={"value": "value * 2"})


def test_workflow(spark, tmp_path):
    flow = MoreNumbers(spark, viewdir=str(tmp_path / "views"))
    assert values(flow.view("both")) == [3, 4, 6, 7]
    assert values(flow.view("signs")) == [-1] * 5 + [1] * 4
    assert values(flow.view("everything")) == list(range(10))
    assert values(flow.store("doubled")) == [6, 8, 12, 14]
    assert any(x == "persist xa" for x in flow.steps("both")), flow.steps("both")
    assert "* " not in flow.pprint("both") and "...".join(["", ""]) in flow.pprint("both")
    assert "*five = Wrap" in flow.pprint("signs")
    assert any("doubled" in x for x in flow.list())
    assert "Physical Plan" in flow.plan("both") and flow.tasks("everything") and "jobs" in flow.report()
    with pytest.raises(KeyError):
        flow.view("nothing")


def test_reuse_checks_what_it_reads(spark, tmp_path):
    where = str(tmp_path / "views")
    Numbers(spark, viewdir=where).store("both")
    again = MoreNumbers(spark, viewdir=where, reuse=["some/where/both.gp"])
    assert values(again.view("doubled")) == [6, 8, 12, 14]
    assert any(x.startswith("reuse both") for x in again.steps("doubled"))

    class Other(Numbers):
        both = Numbers.xa | Filter(by="value <= 8")

    with pytest.raises(ValueError):
        Other(spark, viewdir=where, reuse=["both"]).view("both")
    with pytest.raises(Exception):
        Numbers(spark, viewdir=where, reuse=["low"]).view("both")


def test_stored_views_and_options(spark, tmp_path):
    class Stored(Workflow):
        xs = Wrap([(k,) for k in range(6)], "value long")
        even = (xs | Filter(by="value % 2 = 0")).opts(stored=True).opts(parallel=2)
        out = even | ReplaceEach(by={"value": "value + 1"})

    flow = Stored(spark, viewdir=str(tmp_path), params={"k": 1}, required=["k"])
    assert flow.definition("even").settings == {"stored": True, "parallel": 2}
    assert values(flow.view("out")) == [1, 3, 5] and (tmp_path / "even").exists()
    assert values(ReuseView(flow.path("even")).frame(spark)) == [0, 2, 4]
    with pytest.raises(ValueError):
        Stored(spark, required=["missing"])
    with pytest.raises(TypeError):
        Stored.xs.opts(colour=1)


def test_definitions_tell_what_they_do(spark, tmp_path):
    xs = Wrap([(k,) for k in range(6)], "value long")
    of = lambda reducer: Group(xs, by="value", reducing=reducer).lineage()
    times = lambda n: lambda v: v * n
    assert of(ReduceTo.adding(0.15, lambda v: v * v)) != of(ReduceTo.adding(0, lambda v: v))
    assert of(ReduceTo.adding(0, times(2))) == of(ReduceTo.adding(0, times(2))) != of(ReduceTo.adding(0, times(3)))
    assert of(ReduceToCount()) == of(ReduceToCount()) != of(ReduceToSum())
    mapped = lambda f: ReplaceEach(xs, by=f, schema="long").lineage()
    plus = lambda v, n=1: v + n
    assert mapped(plus) == mapped(plus) != mapped(lambda v, n=2: v + n)
    assert mapped(times(2)) != mapped(times(4)) and mapped(partial(plus, n=1)) != mapped(partial(plus, n=2))
    assert mapped(lambda v: [x + 1 for x in [v]][0]) != mapped(lambda v: [x + 2 for x in [v]][0])
    where = str(tmp_path)

    def flow(n, **given):
        class Scaled(Workflow):
            out = xs | ReplaceEach(by=times(n), schema="long")

        return Scaled(spark, viewdir=where, **given)

    flow(2).store("out")
    assert values(flow(2, reuse=["out"]).view("out")) == [0, 2, 4, 6, 8, 10]
    with pytest.raises(ValueError):
        flow(3, reuse=["out"]).view("out")


def test_options_from_outside(spark, tmp_path):
    flow, out = Numbers(spark, viewdir=str(tmp_path)), io.StringIO()
    assert cli.run(flow, ["--opts", "low.stored=true", "--opts", "low.parallel=3", "--opts", "compression=gzip", "--store", "both", "--steps", "both"], out) == 0
    assert f"store low at {tmp_path}/low" in out.getvalue() and len(list((tmp_path / "low").glob("part-*.gz.parquet"))) <= 3
    assert flow.view("low").rdd.getNumPartitions() == 3 and flow.settings(flow.definition("high")) == {"compression": "gzip"}
    with pytest.raises(TypeError):
        flow.set_options({"low.colour": 1})
    with pytest.raises(KeyError):
        flow.set_options({"nothing.stored": True})


def test_command_line(spark, tmp_path):
    flow, out = Numbers(spark, viewdir=str(tmp_path)), io.StringIO()
    assert cli.run(flow, ["--cat", "both", "--pprint", "both", "--list", "--params", "k=3"], out) == 0
    assert {"3", "4", "6", "7"} <= set(out.getvalue().split()) and flow.params["k"] == 3
    assert cli.run(flow, ["--store", "both", "--steps", "both", "--tasks", "both", "--plan", "both"], out) == 0
    assert cli.run(flow, [], out) == 2
    with pytest.raises(ValueError):
        cli.pairs(["nothing"])


def test_views_one_by_one(spark, tmp_path):
    (tmp_path / "t").write_text("b a\na\n")
    lines = ReadLines(str(tmp_path / "t"))
    counted = lines | Flatten(by=words("value"), name="word") | Group(by="word", reducing=ReduceToCount(), name="n")
    assert sorted(map(tuple, counted.frame(spark).collect())) == [("a", 2), ("b", 1)]
    python = lines | Flatten(by=str.split, schema="string") | LogEchoFirst(first=0) | LogProgress(message="m", interval=9) | Distinct()
    assert values(python.frame(spark)) == ["a", "b"]
    assert values((lines | ReplaceEachPartition(by=lambda it: iter([sum(1 for _ in it)]), schema="long")).frame(spark)) == [2]
    assert values((counted | Format(by=F.format_string("%s=%d", "word", "n"))).frame(spark)) == ["a=2", "b=1"]
    assert values((lines | UnionTo(lines)).frame(spark)) == ["a", "b a"]
    joined = counted | JoinTo(Jin(lines, "value", outer=True), by="word")
    assert joined.frame(spark).count() == 2
    assert MapsideJoin(Jin(lines, "value"), Jin(counted, "word"), ["n"]).frame(spark).count() == 1
    assert ReadCSV(str(tmp_path / "t"), delimiter=" ").frame(spark).count() == 2
    assert ReadBlocks(str(tmp_path / "t")).frame(spark).count() == 1
    with pytest.raises(TypeError):
        lines | lines
    with pytest.raises(ValueError):
        Flatten(by="x").frame(spark)
    with pytest.raises(ValueError):
        Augment(lines)


def test_fluent(spark, tmp_path):
    sc = Context(spark)
    xs = sc.parallelize([(x,) for x in XA], "value long")
    high, low = xs.filter("value >= 3"), xs.filter("value <= 7")
    assert sorted(high.intersection(low).collect()) == [3, 4, 6, 7]
    pair = lambda r, k: r.map({"key": "value", "value": f"value * {k}"})
    assert sorted(map(tuple, pair(high, 2).join(pair(low, 3)).collect())) == [(3, 6, 9), (4, 8, 12), (6, 12, 18), (7, 14, 21)]
    both = pair(high, 2).union(pair(low, 3))
    assert both.count() == 13 and both.map({"key": "key"}).distinct().count() == 9
    assert dict(map(tuple, both.reduce_by_key(ReduceToSum()).collect()))[3] == 15
    assert dict(map(tuple, both.reduce_by_key(ReduceTo.adding(0)).collect()))[9] == 18
    assert xs.reduce(lambda a, b: a + b) == 40 and xs.filter("false").reduce(max) is None
    assert sc.parallelize([(3,), (0,), (5,)], "value long").reduce(min) == 0
    assert xs.take(2) == [0, 1] and xs.first() == 0 and xs.filter("false").first() is None
    odd = xs.filter(lambda x: x % 2 == 1).map(lambda n: (n, n + 1, 2 * n), "a long, b long, c long")
    assert sorted(map(tuple, odd.collect())) == [(1, 2, 2), (3, 4, 6), (7, 8, 14), (9, 10, 18)]
    assert set(xs.sample(False, 0.5, 1).collect()) <= set(XA)
    seen = []
    xs.cache().foreach(seen.append)
    assert sorted(seen) == XA and xs.save(str(tmp_path / "f")) == 9
    assert xs.union_all(xs).count() == 18 and xs.subtract(low).count() == 2 and low.intersection_set(low).count() == 7
    assert sc.list()[0] == "parallelize__1" and both.tasks() and both.steps() and "Physical" in both.plan()


def test_word_programs(spark):
    docs = spark.createDataFrame([(1, "The the a"), (2, "b the"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(map(tuple, recipes.word_count(docs).collect())) == [("a", 1), ("b", 1), ("the", 3)]
    assert {r.n: r.words for r in recipes.common_words(docs, 1).collect()} == {3: ["the"], 1: ["a", "b"]}
    assert dict(map(tuple, recipes.prefix_count(docs).collect())) == {"t": 3, "a": 1, "b": 1}
    assert math.isclose(dict(map(tuple, recipes.word_probability(docs).collect()))["the"], 0.6)
    score = dict(map(tuple, recipes.word_compare(docs.where("doc_id = 1"), docs.where("doc_id = 2")).collect()))
    assert math.isclose(score["the"], math.log(3 / 5))
    lines = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "bad"), (None, "1")], "e string, n string")
    assert sorted(map(tuple, recipes.sum_events(lines, F.col("e"), F.col("n")).collect())) == [("x", 3)]


def test_vectors(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c c"), (3, "d")], "doc_id long, text string")
    for make in (recipes.tfidf, recipes.tfidf_lookup):
        got = make(docs).collect()
        for doc in (1, 2, 3):
            tf = {(1, "a"): 1, (1, "b"): 1, (2, "a"): 1, (2, "c"): 2, (3, "d"): 1}
            assert math.isclose(sum(tf[doc, r.term] * r.weight**2 for r in got if r.doc == doc), 1)
    assert recipes.tfidf(docs.where("doc_id = 1")).first().weight is None
    floor = {(r.doc, r.term): r.weight for r in recipes.tfidf(docs, floor_idf=True).collect()}
    assert floor[1, "a"] == 0
    same = recipes.soft_join(docs, docs, "doc_id", "doc_id", least=0.99)
    assert sorted((r.doc1, r.doc2) for r in same.collect()) == [(1, 1), (2, 2), (3, 3)]
    pruned = recipes.soft_join_pruned(docs, docs, "doc_id", "doc_id", least=0.01, most_df=5)
    assert {(1, 1), (2, 2), (3, 3)} <= {(r.doc1, r.doc2) for r in pruned.collect()}


def test_prefixes_lose_no_pair(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abcdefghijklmnop") * rng.choice([1, 1, 2]) for _ in range(rng.randint(1, 8)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    vectors = {}
    for r in recipes.vectors.relation_vectors(df, "doc_id", "text").collect():
        vectors.setdefault(r.doc, {})[r.term] = r.tf * r.weight
    for least in (0.2, 0.6):
        want = {(a, b) for a, x in vectors.items() for b, y in vectors.items() if sum(x[t] * y[t] for t in x.keys() & y.keys()) > least + 1e-9}
        got = {(r.doc1, r.doc2) for r in recipes.soft_join(df, df, "doc_id", "doc_id", least=least).collect() if r.sim > least + 1e-9}
        assert got == want


def test_lines_of_programs(spark):
    docs = spark.createDataFrame([(2, "B a", "x"), (1, None, "y"), (3, "c", None)], "doc_id long, text string, k string")
    assert sorted(r.value for r in recipes.normalised_lines(docs, "doc_id", "k").collect()) == ["rcv000001.txt\ty", "rcv000002.txt\tx\tb\ta", "rcv000003.txt\t\tc"]
    assert sorted(r.value for r in recipes.tfidf_lines(recipes.tfidf(docs)).collect()) == ["2\ta\t0.707", "2\tb\t0.707", "3\tc\t1.000"]


def test_pagerank(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    got = dict(map(tuple, recipes.pagerank(edges, rounds=1).collect()))
    assert set(got) == {"a", "b"} and math.isclose(got["a"], 0.15 + 0.85 / 2) and math.isclose(got["b"], 1.0)
    assert set(dict(map(tuple, recipes.pagerank(edges, rounds=7, every=2).collect()))) == {"a", "b"}


def test_streams(spark, tmp_path):
    rows = [(k, f"2024-01-01 0{k // 4}:{10 * (k % 4):02d}:00", "u" if k % 2 else "v") for k in range(12)]
    df = spark.createDataFrame(rows, "id long, t string, u string").select("id", F.col("t").cast("timestamp").alias("at"), "u")
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counted = streaming.by_window(stream(), "at", ["u"], "1 hour", "10 minutes")
    got = streaming.run_to_table(counted, str(tmp_path / "w"), str(tmp_path / "ws"), "complete")
    assert sorted((r.start.hour, r.u, r.n) for r in got.collect()) == [(h, u, 2) for h in range(3) for u in "uv"]
    sessions = streaming.by_session(stream(), "at", ["u"], "25 minutes", "10 minutes")
    got = streaming.run_to_table(sessions, str(tmp_path / "s"), str(tmp_path / "ss"), "complete").collect()
    assert sorted((r.start.hour, r.start.minute, r.end.hour, r.end.minute, r.u, r.n) for r in got) == [x for h in range(3) for x in ((h, 0, h, 45, "v", 2), (h, 10, h, 55, "u", 2))]
    first = streaming.run_to_table(streaming.first_of_each(stream(), "at", ["u"], "5 hours"), str(tmp_path / "d"), str(tmp_path / "ds"))
    assert first.count() == 2


def test_an_intersection_makes_only_pairs_that_are_there(spark, tmp_path):
    spark.range(6).selectExpr("id % 3 as l_partkey", "id % 2 as l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(300).selectExpr("id as p_partkey", "1 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(301).selectExpr("id % 300 as s_suppkey", "if(id = 1, 2, 1) as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = queries.pair_intersection(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 0), (2, 0)]
    assert not re.search(r"\[p_size#\d+\], \[s_nationkey#\d+\]", got._jdf.queryExecution().executedPlan().toString())


def test_vectors_are_made_where_their_documents_are(spark):
    rng = random.Random(5)
    rows = [(k % 37, " ".join(rng.choice("abcdefghijklmnop") * rng.choice([1, 2]) for _ in range(rng.randint(0, 9)))) for k in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(r.doc, r.term): r.weight for r in recipes.tfidf(df).collect()}
    for common in (1, 10):  # some terms' frequencies, or nearly all, are joined instead of looked up
        got = {(r.doc, r.term): r.weight for r in recipes.tfidf(df, common=common).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (recipes.tfidf(df), recipes.soft_join(df, df, "doc_id", "doc_id", least=0.3))]
    assert all("Exchange hashpartitioning" not in p.split("InMemoryRelation")[0] for p in plans)  # nothing is dealt again


@pytest.mark.parametrize("small", [True, False])
def test_soft_joins_broadcast_or_not(spark, monkeypatch, small):
    df = spark.createDataFrame([(k, " ".join("abcdefgh"[k % 5 : k % 7 + 2])) for k in range(30)], "doc_id long, text string")
    vectors = {}
    for r in recipes.vectors.relation_vectors(df, "doc_id", "text").collect():
        vectors.setdefault(r.doc, {})[r.term] = r.tf * r.weight
    if not small:
        monkeypatch.setattr(ops.sideviews, "measured", lambda side, *_: (side, False))
    want = {(a, b): s for a, x in vectors.items() for b, y in vectors.items() if (s := sum(x[t] * y[t] for t in x.keys() & y.keys())) > 0.3}
    got = {(r.doc1, r.doc2): r.sim for r in recipes.soft_join(df, df, "doc_id", "doc_id", least=0.3).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def plain_ranks(edges, rounds):
    nodes = {a for a, _ in edges}
    degree, ranks = Counter(a for a, _ in edges), dict.fromkeys(nodes, 1.0)
    for _ in range(rounds):
        sums = {}
        for a, b in edges:
            if a is not None and a in ranks and b in nodes and b is not None:
                sums[b] = sums.get(b, 0.0) + ranks[a] / degree[a]
        ranks = {b: 0.15 + 0.85 * x for b, x in sums.items()}
    return ranks


def test_pagerank_shuffles_its_links_once(spark, request):
    edges = [(f"n{k * k % 23}", f"n{k * 7 % 31}") for k in range(60)] + [("n1", "n4")] * 3 + [("n2", None), (None, "n2"), (None, None), ("n0", "n0")]
    df = spark.createDataFrame(edges, "src string, dst string")
    for rounds in range(5):
        got = dict(map(tuple, recipes.pagerank(df, rounds=rounds, every=2).collect()))
        want = plain_ranks(edges, rounds)
        assert got.keys() == want.keys() and all(math.isclose(got[k], x) for k, x in want.items()), rounds
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = recipes.pagerank(df, rounds=3)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    outside, at = [], 0
    while at < len(plan):
        outside.append(plan[at])
        inside = list(itertools.takewhile(lambda line: depth(line) > depth(outside[-1]), plan[at + 1 :])) if "InMemoryRelation" in plan[at] else []
        if inside:
            first = inside[next((k for k, line in enumerate(inside) if "Initial Plan" in line), 0) :]
            assert sum("Exchange" in line for line in first) == 1 and not any("Join" in line for line in first)
        at += 1 + len(inside)
    count = lambda name: sum(name in line for line in outside)
    assert count("InMemoryRelation") == 4 and count("Join") == count("Sort [") == 3  # links are sorted already
