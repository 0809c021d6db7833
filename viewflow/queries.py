"""The registered queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from . import recipes, sources, streaming
from .functions import last_dropped, words
from .operators import JoinInput, ReduceTo, ReduceToCount, ReduceToList, ReduceToSum
from .plans import Context, Group, Jin, Join, Table, Workflow
from .session import make_importable, new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TOKEN = r"regexp_split_to_array(lower(text), '[ \t\n\r\x0B\f]+')"
WORDS = f"(SELECT doc_id, lang, source, unnest(list_filter({TOKEN}, lambda x: x <> '')) AS word FROM documents)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return make_importable(spark).read.parquet(f"{d}/{name}.parquet")


# rows to rows


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def replace_each(s, d):
    return ops.replace_each(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net")])


@query("SELECT n_nationkey AS value, upper(n_name) AS name FROM nation")
def replace_each_python(s, d):
    return ops.replace_each(table(s, d, "nation"), lambda r: (r.n_nationkey, r.n_name.upper()), "value int, name string")


@query("SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def filter_rows(s, d):
    return ops.filter_rows(table(s, d, "orders"), "o_totalprice > 100000 AND o_orderstatus = 'F'")


@query("SELECT n_regionkey AS value FROM nation WHERE n_regionkey <> 0")
def filter_truthy(s, d):
    return ops.filter_rows(ops.replace_each(table(s, d, "nation"), {"value": "n_regionkey"}))


@query(f"SELECT doc_id, word FROM {WORDS}")
def flatten_tokens(s, d):
    return ops.flatten(table(s, d, "documents"), words("text"), name="word", keep=["doc_id"])


@query(f"SELECT doc_id, unnest(l[1:len(l)-1]) AS word FROM (SELECT doc_id, list_filter({TOKEN}, lambda x: x <> '') AS l FROM documents)")
def flatten_without_last(s, d):
    return ops.flatten(table(s, d, "documents"), last_dropped(words("text")), name="word", keep=["doc_id"])


@query("SELECT printf('%d|%s|%.2f', c_custkey, c_name, c_acctbal) AS value FROM customer")
def format_rows(s, d):
    return sources.sinks.formatted(table(s, d, "customer"), F.format_string("%d|%s|%.2f", "c_custkey", "c_name", "c_acctbal"))


@query("SELECT event_id, value, round(sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def partition_running_sum(s, d):
    out = ops.running_sum(table(s, d, "events").select("event_id", "value"), "value", "event_id")
    return out.withColumn("running", F.round("running", 4))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id FROM orders")
def row_ids(s, d):
    return ops.number_rows(table(s, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT count(*) AS n FROM orders")
def partition_count(s, d):
    counted = ops.replace_each_partition(table(s, d, "orders").select("o_orderkey"), lambda rows: iter([sum(1 for _ in rows)]), "n long")
    return counted.agg(F.sum("n").alias("n"))


@query("SELECT * FROM region")
def log_progress(s, d):
    return ops.log_progress(ops.log_echo_first(table(s, d, "region"), 0), "regions", 1_000_000)


@query()
def sample_rows(s, d):
    return ops.sample(table(s, d, "lineitem"), 0.1, seed=7)


@query("SELECT lower(n_name) AS value FROM nation")
def piped_rows(s, d):
    return ops.pipe(table(s, d, "nation").select("n_name"), "tr A-Z a-z")


@query("SELECT event_type || chr(9) || count(*) AS value FROM events GROUP BY event_type")
def piped_map_reduce(s, d):
    mapper, reducer = """awk '{print $1 "\\t1"}'""", """awk -F '\\t' '{n[$1] += $2} END {for (k in n) print k "\\t" n[k]}'"""
    return ops.map_reduce(table(s, d, "events").select("event_type"), mapper, reducer)


# groups


@query("SELECT n_regionkey, list_sort(list(n_name)) AS names FROM nation GROUP BY n_regionkey")
def group_list(s, d):
    return ops.group(table(s, d, "nation"), "n_regionkey", ReduceToList(), retaining="n_name", name="names")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def group_count(s, d):
    return ops.group(table(s, d, "lineitem"), "l_suppkey", ReduceToCount(), name="n")


@query("SELECT l_suppkey, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY l_suppkey")
def group_sum(s, d):
    return ops.group(table(s, d, "lineitem"), "l_suppkey", ReduceToSum(), retaining="l_quantity", name="quantity").withColumn("quantity", F.round("quantity", 4))


@query("SELECT l_partkey, round(sum(l_quantity * l_quantity), 4) AS squares FROM lineitem GROUP BY l_partkey")
def group_fold(s, d):
    out = ops.group(table(s, d, "lineitem"), "l_partkey", ReduceTo.adding(0.0, lambda q: q * q), retaining="l_quantity", name="squares")
    return out.withColumn("squares", F.round("squares", 4))


@query("SELECT l_suppkey, round(0.15 + 0.85 * sum(l_discount), 6) AS value FROM lineitem GROUP BY l_suppkey")
def group_fold_zero(s, d):
    out = ops.group(table(s, d, "lineitem"), "l_suppkey", ReduceTo.adding(0.15, lambda x: 0.85 * x), retaining="l_discount")
    return out.withColumn("value", F.round("value", 6))


@query("SELECT n_regionkey, string_agg(n_name, '+' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def group_fold_ordered(s, d):
    step = lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.lit("+"), x))
    return ops.group(table(s, d, "nation"), "n_regionkey", ReduceTo("", step), retaining="n_name", name="names")


@query("SELECT user_id, max(event_id) AS value FROM events GROUP BY user_id")
def group_fold_python(s, d):
    pairs = table(s, d, "events").select("user_id", "event_id")
    return ops.grouping.fold_rows(pairs, "user_id", lambda: -1, lambda a, r: max(a, r[1]), "long", order="event_id")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def group_composite_key(s, d):
    return ops.group(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], ReduceToCount(), name="n")


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem")
def global_aggregate(s, d):
    return table(s, d, "lineitem").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT o_custkey, list_sort(list(o_orderkey)) AS orders FROM orders GROUP BY o_custkey")
def group_retaining(s, d):
    return ops.group(table(s, d, "orders"), "o_custkey", ReduceToList(), retaining="o_orderkey", name="orders")


@query("SELECT o_orderpriority, CAST(sum(1) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority")
def group_combiner(s, d):
    return ops.group(table(s, d, "orders"), "o_orderpriority", ReduceToSum(), retaining=F.lit(1), combining=ReduceToSum(), name="n")


@query("SELECT CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS key, count(*) AS n FROM orders GROUP BY 1")
def group_null_key(s, d):
    return ops.group(table(s, d, "orders"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")), ReduceToCount(), name="n")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def distinct_rows(s, d):
    return ops.distinct(table(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey")
def count_distinct_per_key(s, d):
    return ops.count_distinct_per_key(table(s, d, "lineitem"), "l_suppkey", "l_partkey", "parts")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 2")
def top_k_per_group(s, d):
    return ops.top_k_per_group(table(s, d, "events").select("user_id", "event_id", "value"), "user_id", [F.desc("value"), F.asc("event_id")], 2)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(s, d):
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


# joins

_C, _O = "customer", "orders"


def _customer_events(s, d, left_outer, right_outer):
    c, e = table(s, d, _C).select("c_custkey", "c_name"), table(s, d, "events").select("event_id", "user_id")
    out = ops.join(JoinInput(c, "c_custkey", left_outer), JoinInput(e, "user_id", right_outer))
    return out.select("_1.c_name", F.col("_2.event_id").cast("string").alias("event"))


_JOIN = "SELECT c_name, CAST(event_id AS VARCHAR) AS event FROM customer {} JOIN events ON c_custkey = user_id"


@query(_JOIN.format("INNER"))
def join_inner(s, d):
    return _customer_events(s, d, False, False)


@query(_JOIN.format("LEFT"))
def join_left(s, d):
    return _customer_events(s, d, True, False)


@query(_JOIN.format("RIGHT"))
def join_right(s, d):
    return _customer_events(s, d, False, True)


@query(_JOIN.format("FULL"))
def join_full(s, d):
    return _customer_events(s, d, True, True)


@query("SELECT c_custkey, n_nationkey FROM (SELECT c_custkey, CASE WHEN c_nationkey > 3 THEN c_nationkey END AS k FROM customer) JOIN (SELECT n_nationkey, CASE WHEN n_nationkey > 3 THEN n_nationkey END AS k2 FROM nation) ON k IS NOT DISTINCT FROM k2")
def join_null_keys(s, d):
    c = table(s, d, _C).select("c_custkey", F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("k"))
    n = table(s, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") > 3, F.col("n_nationkey")).alias("k2"))
    return ops.join(JoinInput(c, "k"), JoinInput(n, "k2")).select("_1.c_custkey", "_2.n_nationkey")


@query("SELECT n_name, s_suppkey, c_custkey FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey")
def join_three_way(s, d):
    n, u, c = table(s, d, "nation").select("n_nationkey", "n_name"), table(s, d, "supplier").select("s_suppkey", "s_nationkey"), table(s, d, _C).select("c_custkey", "c_nationkey")
    return ops.join(JoinInput(n, "n_nationkey"), JoinInput(u, "s_nationkey"), JoinInput(c, "c_nationkey")).select("_1.n_name", "_2.s_suppkey", "_3.c_custkey")


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def join_to(s, d):
    out = table(s, d, "region").transform(ops.join_to, JoinInput(table(s, d, "nation"), "n_regionkey", outer=True), "r_regionkey")
    return out.select("_2.n_name", "_1.r_name")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def self_join(s, d):
    n = table(s, d, "nation")
    return ops.join(JoinInput(n, "n_regionkey"), JoinInput(n, "n_regionkey")).select(F.col("_1.n_name").alias("a"), F.col("_2.n_name").alias("b"))


@query("SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def semi_join(s, d):
    return ops.semi_join(JoinInput(table(s, d, _C), "c_custkey"), JoinInput(table(s, d, "events"), "user_id"))


@query("SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def anti_join(s, d):
    return ops.anti_join(JoinInput(table(s, d, _C), "c_custkey"), JoinInput(table(s, d, "events"), "user_id"))


@query("SELECT a.c_nationkey AS k FROM customer a JOIN supplier ON a.c_nationkey = s_nationkey")
def intersection_bag(s, d):
    a = table(s, d, _C).select(F.col("c_nationkey").alias("k"))
    return ops.intersection_bag(a, table(s, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersection_set(s, d):
    return ops.intersection_set(table(s, d, _C).select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(s, d):
    return ops.union(table(s, d, _C).select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(s, d):
    return ops.union_all(table(s, d, _C).select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT user_id FROM events")
def subtract(s, d):
    return ops.subtract(table(s, d, _C).select(F.col("c_custkey").alias("k")), table(s, d, "events").select("user_id"))


# side views


@query("SELECT o_orderkey, round(o_totalprice / (SELECT sum(o_totalprice) FROM orders), 12) AS share FROM orders")
def augment_only_row(s, d):
    o = table(s, d, _O).select("o_orderkey", "o_totalprice")
    total = o.agg(F.sum("o_totalprice").alias("total"))
    return ops.sideviews.augment_row(o, total).select("o_orderkey", F.round(F.col("o_totalprice") / F.col("side.total"), 12).alias("share"))


@query("SELECT n_name, (SELECT count(*) FROM region) AS regions FROM nation")
def augment_list(s, d):
    return ops.augment(table(s, d, "nation").select("n_name"), table(s, d, "region"), loaded_by=F.size("side").cast("long")).withColumnRenamed("side", "regions")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def augment_dict(s, d):
    return ops.augment_lookup(table(s, d, _C).select("c_custkey", "c_nationkey"), table(s, d, "nation"), "c_nationkey", "n_nationkey", "n_name", "n_name", strict=True).drop("c_nationkey")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN (SELECT s_nationkey, max(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def mapside_join(s, d):
    return ops.mapside_join(table(s, d, _C), table(s, d, "supplier"), "c_nationkey", "s_nationkey", ["s_suppkey"]).select("large.c_custkey", "small.s_suppkey")


# pairs, fluently


def _pairs(s, d, name="events", key="user_id", value="event_id"):
    return Context(s).wrap(table(s, d, name).select(F.col(key).alias("key"), F.col(value).alias("value")))


def _order_pairs(s, d):
    return _pairs(s, d, _O, "o_custkey", "o_orderkey")


@query("SELECT user_id AS key, list_sort(list(event_id)) AS value FROM events GROUP BY user_id")
def pair_group_by_key(s, d):
    return _pairs(s, d).group_by_key().df


@query("SELECT user_id AS key, CAST(sum(event_id) AS BIGINT) AS value FROM events GROUP BY user_id")
def pair_reduce_by_key(s, d):
    return _pairs(s, d).reduce_by_key(ReduceToSum()).df


@query("SELECT user_id AS key, count(*) AS value FROM events GROUP BY user_id")
def pair_count_by_key(s, d):
    return _pairs(s, d).count_by_key().df


@query("SELECT a.user_id AS key, a.event_id AS left_value, b.o_orderkey AS right_value FROM events a JOIN orders b ON a.user_id = b.o_custkey")
def pair_join(s, d):
    return _pairs(s, d).join(_order_pairs(s, d)).df


@query("SELECT user_id AS key, event_id AS value FROM events UNION SELECT o_custkey, o_orderkey FROM orders")
def pair_union(s, d):
    return _pairs(s, d).union(_order_pairs(s, d)).df


@query("SELECT l_partkey AS key, l_suppkey AS value FROM lineitem JOIN (SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size = s_nationkey) ON l_partkey = p_partkey AND l_suppkey = s_suppkey")
def pair_intersection(s, d):
    ordered = _pairs(s, d, "lineitem", "l_partkey", "l_suppkey")
    # of all parts and suppliers with equal numbers, those that are ordered together: the others are in no intersection
    parts, suppliers = table(s, d, "part").select("p_partkey", "p_size"), table(s, d, "supplier").select("s_suppkey", "s_nationkey")
    near = ordered.distinct().df.join(parts, F.col("key") == F.col("p_partkey")).join(suppliers, (F.col("value") == F.col("s_suppkey")) & (F.col("p_size") == F.col("s_nationkey")))
    return ordered.intersection(Context(s).wrap(near.select("key", "value"))).df


@query("SELECT DISTINCT user_id AS key FROM events")
def pair_distinct_keys(s, d):
    return _pairs(s, d).map({"key": "key"}).distinct().df


# order, and sources and sinks there and back


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def order_limit(s, d):
    return table(s, d, _O).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT c_name AS value FROM customer")
def read_lines(s, d):
    path = new_folder(s, "lines")
    sources.write_formatted(table(s, d, _C).select("c_name"), path)
    return sources.read_lines(s, path)


@query("""SELECT [CAST(n_nationkey AS VARCHAR), n_name] AS value FROM nation UNION ALL
SELECT CASE WHEN r_regionkey = 0 THEN [r_name] ELSE [CAST(r_regionkey AS VARCHAR), 'the "' || r_name || '"', '', 'two' || chr(10) || 'lines; ' || r_name] END FROM region""")
def read_csv(s, d):
    path = new_folder(s, "csv")
    n, r = table(s, d, "nation"), table(s, d, "region")
    wide = F.format_string('%d;"the ""%s""";;"two\nlines; %s"', "r_regionkey", "r_name", "r_name")
    records = n.select(F.concat_ws(";", "n_nationkey", "n_name")).union(r.select(F.when(F.col("r_regionkey") == 0, F.col("r_name")).otherwise(wide)))
    sources.write_formatted(records.toDF("value"), path)
    return sources.read_csv(s, path, delimiter=";")


@query("""SELECT r_name AS first, CAST(CASE WHEN r_regionkey = 0 THEN 0 ELSE n END AS BIGINT) AS n_lines, CASE WHEN r_regionkey = 0 THEN [] ELSE names END AS names FROM region
JOIN (SELECT n_regionkey, count(*) AS n, list_sort(list(n_name)) AS names FROM nation GROUP BY 1) ON n_regionkey = r_regionkey""")
def read_blocks(s, d):
    path = new_folder(s, "blocks")
    names = ops.group(table(s, d, "nation"), "n_regionkey", ReduceToList(), retaining="n_name", name="names")
    both = names.join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # a file for each region: its name, an empty line, and its nations or, for one, a block without lines
    text = F.concat_ws("\n", "r_name", F.lit(""), F.when(F.col("r_regionkey") == 0, F.lit("")).otherwise(F.array_join("names", "\n")))
    both.select("r_regionkey", text.alias("value")).write.partitionBy("r_regionkey").text(path)
    blocks = sources.read_blocks(s, f"{path}/*/")
    first, second = (blocks.where(F.col("block") == k).select("path", "lines") for k in (0, 1))
    return first.join(second.withColumnRenamed("lines", "names"), "path").select(F.col("lines")[0].alias("first"), F.size("names").cast("long").alias("n_lines"), "names")


@query("SELECT s_suppkey, s_name FROM supplier")
def store_and_reuse(s, d):
    path = new_folder(s, "stored")
    sources.store_rows(table(s, d, "supplier").select("s_suppkey", "s_name"), path)
    return sources.reuse(s, path)


@query("SELECT n_name, n FROM nation JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def workflow_views(s, d):
    class Nations(Workflow):
        customers = Table(f"{d}/customer.parquet")
        counts = customers | Group(by="c_nationkey", reducing=ReduceToCount(), name="n").opts(stored=True)
        nations = Join(Jin(Table(f"{d}/nation.parquet"), "n_nationkey"), Jin(counts, "c_nationkey"))

    return Nations(s, viewdir=new_folder(s, "views")).view("nations").select("_1.n_name", "_2.n")


# programs


@query(f"SELECT word, count(*) AS n FROM {WORDS} GROUP BY word")
def word_count(s, d):
    return recipes.word_count(table(s, d, "documents"))


@query(f"SELECT word, count(*) AS n FROM {WORDS} WHERE starts_with(word, 'th') GROUP BY word")
def word_count_prefix(s, d):
    return recipes.word_count(table(s, d, "documents"), prefix="th")


@query(f"SELECT substring(word, 1, 2) AS prefix, count(*) AS n FROM {WORDS} GROUP BY 1")
def prefix_count(s, d):
    return recipes.prefix_count(table(s, d, "documents"), 2)


@query(f"SELECT n, list_sort(list(word)) AS words FROM (SELECT word, count(*) AS n FROM {WORDS} GROUP BY word) WHERE n >= 200 GROUP BY n")
def common_words(s, d):
    return recipes.common_words(table(s, d, "documents"))


@query(f"WITH c AS (SELECT word, count(*) AS n FROM {WORDS} GROUP BY word) SELECT word, round(n / (SELECT sum(n) FROM c), 9) AS p FROM c")
def word_prob(s, d):
    return recipes.word_probability(table(s, d, "documents")).withColumn("p", F.round("p", 9))


@query(f"WITH a AS (SELECT word, count(*) AS n FROM {WORDS} WHERE lang = 'en' GROUP BY word), b AS (SELECT word, count(*) AS n FROM {WORDS} WHERE lang <> 'en' GROUP BY word) SELECT word, round(ln((a.n + 1.0::DOUBLE) / (a.n + b.n + 2.0::DOUBLE)), 6) AS score FROM a JOIN b USING (word)")
def word_compare(s, d):
    docs = table(s, d, "documents")
    return recipes.word_compare(docs.where("lang = 'en'"), docs.where("lang <> 'en'")).withColumn("score", F.round("score", 6))


@query("SELECT event_type AS event, CAST(sum(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS n FROM events WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL GROUP BY 1")
def sum_events(s, d):
    return recipes.sum_events(table(s, d, "events"), F.col("event_type"), F.get_json_object("props", "$.k"))


_TFIDF = f"""WITH t AS (SELECT doc_id AS doc, word AS term, count(*) AS tf FROM {WORDS} GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(DISTINCT doc) AS n FROM t),
u AS (SELECT doc, term, tf, ln(n / df) AS w FROM t JOIN df USING (term), n),
z AS (SELECT doc, sum(tf * w * w) AS z FROM u GROUP BY doc)
SELECT doc, term, round(w / nullif(sqrt(z), 0), 6) AS weight FROM u JOIN z USING (doc)"""


@query(_TFIDF)
def tfidf_join(s, d):
    return recipes.tfidf(table(s, d, "documents")).withColumn("weight", F.round("weight", 6))


@query(_TFIDF)
def tfidf_sideview(s, d):
    return recipes.tfidf_lookup(table(s, d, "documents")).withColumn("weight", F.round("weight", 6))


_WEIGHTS = _TFIDF.replace("round(w / nullif(sqrt(z), 0), 6)", "w / nullif(sqrt(z), 0)")


@query(f"SELECT printf('%d\t%s\t%.3f', doc, term, weight) AS value FROM ({_WEIGHTS}) WHERE weight IS NOT NULL")
def tfidf_export(s, d):
    path = new_folder(s, "tfidf")
    sources.write_formatted(recipes.tfidf_lines(recipes.tfidf(table(s, d, "documents"))), path, compression="gzip")
    return sources.read_lines(s, path)


@query(f"SELECT array_to_string(list_concat([printf('rcv%06d.txt', row_number() OVER (ORDER BY doc_id)), lang], list_filter({TOKEN}, lambda x: x <> '')), chr(9)) AS value FROM documents")
def normalised_lines(s, d):
    return recipes.normalised_lines(table(s, d, "documents"), "doc_id", "lang")


def _vectors(name: str, relation: str, doc: str) -> str:
    return f"""{name}t AS (SELECT {doc} AS doc, unnest(string_split(lower(text), ' ')) AS term FROM {relation}),
{name}c AS (SELECT doc, term, count(*) AS tf FROM {name}t GROUP BY ALL), {name}d AS (SELECT term, count(*) AS df FROM {name}t GROUP BY term),
{name}n AS (SELECT count(DISTINCT doc) AS n FROM {name}t),
{name}u AS (SELECT doc, term, tf, df, ln(2.0::DOUBLE) * ln(n / df) AS w FROM {name}c JOIN {name}d USING (term), {name}n),
{name} AS (SELECT doc, term, tf, df, w / nullif(sqrt(z), 0) AS weight FROM {name}u JOIN (SELECT doc, sum(tf * w * w) AS z FROM {name}u GROUP BY doc) USING (doc))"""


_SOFT = f"WITH {_vectors('va', 'benchmark', 'item_id')}, {_vectors('vb', 'documents', 'doc_id')}"
_SIM = "SELECT a.doc AS doc1, b.doc AS doc2, sum(a.tf * a.weight * b.tf * b.weight) AS sim FROM {} a JOIN vb b ON a.term = b.term GROUP BY ALL"


@query(f"{_SOFT} SELECT doc1, doc2, round(sim, 6) AS sim FROM ({_SIM.format('va')}) WHERE sim > 0.2")
def soft_join(s, d):
    out = recipes.soft_join(table(s, d, "benchmark"), table(s, d, "documents"), "item_id", "doc_id", least=0.2)
    return out.withColumn("sim", F.round("sim", 6))


@query(f"""{_SOFT}, top AS (SELECT term FROM va QUALIFY row_number() OVER (PARTITION BY doc ORDER BY weight DESC, term DESC) <= 5),
useful AS (SELECT term FROM top INTERSECT SELECT term FROM va WHERE weight >= 0.1 INTERSECT SELECT term FROM (SELECT term, df FROM va UNION SELECT term, df FROM vb) WHERE df <= 50),
k AS (SELECT * FROM va WHERE term IN (SELECT term FROM useful))
SELECT doc1, doc2, round(sim, 6) AS sim FROM ({_SIM.format('k')}) WHERE sim > 0.1""")
def soft_join_pruned(s, d):
    out = recipes.soft_join_pruned(table(s, d, "benchmark"), table(s, d, "documents"), "item_id", "doc_id", least=0.1, top_terms=5, least_weight=0.1)
    return out.withColumn("sim", F.round("sim", 6))


_EDGES = "e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem)"
_ROUND = "r{0} AS (SELECT dst AS node, 0.15::DOUBLE + 0.85::DOUBLE * sum(rank / deg) AS rank FROM l JOIN r{1} ON src = r{1}.node WHERE dst IN (SELECT node FROM r{1}) GROUP BY dst)"


@query(f"WITH {_EDGES}, l AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS deg FROM e), r0 AS (SELECT DISTINCT src AS node, 1.0::DOUBLE AS rank FROM e), {', '.join(_ROUND.format(k + 1, k) for k in range(3))} SELECT node, round(rank, 6) AS rank FROM r3")
def pagerank(s, d):
    keys = ops.distinct(table(s, d, "lineitem").select("l_partkey", "l_suppkey"))
    pairs = keys.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    edges = pairs.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))  # no pair is the reverse of another
    return recipes.pagerank(edges, rounds=3).withColumn("rank", F.round("rank", 6))


# streams


def _stream(s: SparkSession, d: str) -> DataFrame:
    schema = table(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("at", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(s, d):
    counted = streaming.by_window(_stream(s, d), "at", ["event_type"], "1 hour", "1 day")
    out = streaming.run_to_table(counted, new_folder(s, "windows"), new_folder(s, "windows-state"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT event_id, upper(event_type) AS kind FROM events WHERE value > 50")
def stream_rows(s, d):
    kept = ops.replace_each(ops.filter_rows(_stream(s, d), "value > 50"), ["event_id", F.upper("event_type").alias("kind")])
    return streaming.run_to_table(kept, new_folder(s, "rows"), new_folder(s, "rows-state"))


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY ALL")
def stream_sliding_windows(s, d):
    counted = streaming.by_window(_stream(s, d), "at", ["event_type"], "1 hour", "1 day", slide="30 minutes")
    out = streaming.run_to_table(counted, new_folder(s, "sliding"), new_folder(s, "sliding-state"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n FROM (
SELECT event_type, ts, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS session
FROM (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events)) GROUP BY event_type, session""")
def stream_sessions(s, d):
    counted = streaming.by_session(_stream(s, d), "at", ["event_type"], "1 hour", "1 day")
    out = streaming.run_to_table(counted, new_folder(s, "sessions"), new_folder(s, "sessions-state"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_of_each(s, d):
    kept = streaming.first_of_each(_stream(s, d), "at", ["user_id", "event_type"], "10000 days")
    return streaming.run_to_table(kept, new_folder(s, "first"), new_folder(s, "first-state")).select("user_id", "event_type")
