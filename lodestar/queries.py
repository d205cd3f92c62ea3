"""Registered profiling queries, each over its whole table, and DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import agree, partitions, validate
from lodestar.operators.discover import discover, non_dependencies
from lodestar.sources.tables import dependency_lines, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}


def _sets(n: int, size: int) -> list[int]:
    return [m for m in range(1 << n) if m.bit_count() <= size]


def _lattice(columns: Sequence[str], source: str, max_lhs: int | None) -> str:
    """Common tables: `n` has the number of groups of each column set, `r` the columns, `v` the dependencies."""
    k = len(columns)
    if max_lhs is None:
        grouping = f"CUBE ({', '.join(columns)})"
    else:
        grouping = "GROUPING SETS (" + ", ".join("(" + ", ".join(c for j, c in enumerate(columns) if m >> j & 1) + ")" for m in _sets(k, max_lhs + 1)) + ")"
    mask = " + ".join(f"(1 - GROUPING({c})) * {1 << j}" for j, c in enumerate(columns))
    rights = " UNION ALL ".join(f"SELECT {1 << j} AS b, '{c}' AS c" for j, c in enumerate(columns))
    return f"""g AS (SELECT CAST({mask} AS BIGINT) AS m FROM {source} GROUP BY {grouping}),
n AS (SELECT m, COUNT(*) AS n FROM g GROUP BY m),
r AS ({rights}),
v AS (SELECT x.m AS l, r.b AS b, r.c AS rhs FROM n x JOIN r ON (x.m & r.b) = 0 JOIN n y ON y.m = x.m + r.b AND y.n = x.n)"""


def _names(columns: Sequence[str], mask: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN ({mask} & {1 << j}) > 0 THEN '{c}' END" for j, c in enumerate(columns)) + ")"


def fd_sql(columns: Sequence[str], source: str, max_lhs: int | None = None, before: str = "") -> str:
    bound = "" if max_lhs is None else f" AND bit_count(v.l) <= {max_lhs}"
    return f"""WITH {before}{_lattice(columns, source, max_lhs)}
SELECT {_names(columns, 'v.l')} AS lhs, v.rhs AS rhs FROM v
WHERE NOT EXISTS (SELECT 1 FROM v w WHERE w.b = v.b AND w.l <> v.l AND (w.l & v.l) = w.l){bound}"""


def register(name: str, sql: str) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", columns=COLUMNS[name])


def flat(found: DataFrame) -> DataFrame:
    return found.select(F.array_join("lhs", ",").alias("lhs"), "rhs")


def _discovery(name: str, source: str, sql: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, **options) -> None:
    register(name, sql)(lambda spark, d: flat(discover(prepare(table(spark, d, source)), **options)))


for _t in COLUMNS:
    if _t != "lineitem":
        _discovery(f"fd_{_t}", _t, fd_sql(COLUMNS[_t], _t))
for _k in (2, 3):
    _discovery(f"fd_lineitem_lhs{_k}", "lineitem", fd_sql(COLUMNS["lineitem"], "lineitem", _k), max_lhs=_k)
_discovery("fd_customer_pairs", "customer", fd_sql(COLUMNS["customer"], "customer"), method="pairs")
_discovery("fd_supplier_pairs", "supplier", fd_sql(COLUMNS["supplier"], "supplier"), method="pairs")
_discovery("fd_part_lattice", "part", fd_sql(COLUMNS["part"], "part"), method="lattice")
_discovery("fd_orders_lhs1", "orders", fd_sql(COLUMNS["orders"], "orders", 1), max_lhs=1)
_discovery("fd_orders_lhs0", "orders", fd_sql(COLUMNS["orders"], "orders", 0), max_lhs=0)
_discovery("fd_events_first_500", "events", fd_sql(COLUMNS["events"], "t", None, "t AS (SELECT * FROM events ORDER BY event_id LIMIT 500), "), row_limit=500, order_by=("event_id",))


def _with_nulls(df: DataFrame) -> DataFrame:
    return df.withColumns({"o_orderstatus": F.nullif("o_orderstatus", F.lit("F")), "o_orderpriority": F.nullif("o_orderpriority", F.lit("1-URGENT"))})


_NULLS = "t AS (SELECT * REPLACE (NULLIF(o_orderstatus, 'F') AS o_orderstatus, NULLIF(o_orderpriority, '1-URGENT') AS o_orderpriority) FROM orders), "
_APART = _NULLS + "u AS (SELECT * REPLACE (COALESCE(o_orderstatus, '#' || o_orderkey) AS o_orderstatus, COALESCE(o_orderpriority, '#' || o_orderkey) AS o_orderpriority) FROM t), "
_discovery("fd_orders_nulls_equal", "orders", fd_sql(COLUMNS["orders"], "t", None, _NULLS), _with_nulls)
_discovery("fd_orders_nulls_apart", "orders", fd_sql(COLUMNS["orders"], "u", None, _APART), _with_nulls, null_equals_null=False)

_CHECKS = [(["o_orderkey"], "o_custkey"), (["o_custkey"], "o_orderstatus"), (["o_totalprice"], "o_orderstatus"), (["o_custkey", "o_orderdate"], "o_orderkey"), ([], "o_orderpriority")]


@register("fd_check_orders", " UNION ALL ".join(f"SELECT '{','.join(x)}' AS lhs, '{a}' AS rhs, NOT EXISTS (SELECT 1 FROM orders {'GROUP BY ' + ', '.join(x) if x else ''} HAVING COUNT(DISTINCT {a}) > 1) AS holds" for x, a in _CHECKS))
def _check_orders(spark: SparkSession, d: str) -> DataFrame:
    return validate.validate(table(spark, d, "orders"), _CHECKS).withColumn("lhs", F.array_join("lhs", ","))


@register("fd_violations_orders", "SELECT o_custkey, COUNT(*) AS n_rows, MIN(o_orderpriority) AS rhs_low, MAX(o_orderpriority) AS rhs_high FROM orders GROUP BY o_custkey HAVING MIN(o_orderpriority) <> MAX(o_orderpriority)")
def _violations_orders(spark: SparkSession, d: str) -> DataFrame:
    return validate.violations(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@register("fd_violations_lineitem_two", "SELECT l_returnflag, l_linenumber, COUNT(*) AS n_rows, MIN(l_linestatus) AS rhs_low, MAX(l_linestatus) AS rhs_high FROM lineitem GROUP BY l_returnflag, l_linenumber HAVING MIN(l_linestatus) <> MAX(l_linestatus)")
def _violations_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return validate.violations(table(spark, d, "lineitem"), ["l_returnflag", "l_linenumber"], "l_linestatus")


def _stat_sql(t: str) -> str:
    one = "SELECT '{c}' AS \"column\", CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*) FILTER (n > 1) AS n_clusters, CAST(COALESCE(SUM(n) FILTER (n > 1), 0) AS BIGINT) AS n_non_unique, COUNT(*) AS n_distinct, COUNT(*) FILTER (n > 1) = 0 AS is_unique, SUM(n) <= 1 OR COUNT(*) = 1 AS is_constant FROM (SELECT {c}, COUNT(*) AS n FROM {t} GROUP BY {c})"
    return " UNION ALL ".join(one.format(c=c, t=t) for c in COLUMNS[t])


for _t in ("lineitem", "orders", "documents"):
    register(f"column_statistics_{_t}", _stat_sql(_t))(lambda spark, d, t=_t: partitions.statistics(table(spark, d, t)))

register("ranked_columns_lineitem", f"SELECT \"column\", n_distinct, ROW_NUMBER() OVER (ORDER BY n_distinct DESC, place) AS rank FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS {chr(34)}column{chr(34)}, COUNT(DISTINCT {c}) AS n_distinct, {j} AS place FROM lineitem' for j, c in enumerate(COLUMNS['lineitem']))})")(
    lambda spark, d: partitions.ranked_columns(table(spark, d, "lineitem"))
)
register("clusters_orders", "SELECT o_custkey, COUNT(*) AS cluster_size FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1")(lambda spark, d: partitions.clusters(table(spark, d, "orders"), ["o_custkey"]))
register("product_clusters_lineitem", "SELECT l_suppkey, l_linenumber, l_returnflag, COUNT(*) AS cluster_size FROM lineitem GROUP BY l_suppkey, l_linenumber, l_returnflag HAVING COUNT(*) > 1")(
    lambda spark, d: partitions.clusters(table(spark, d, "lineitem"), ["l_suppkey", "l_linenumber", "l_returnflag"])
)
register("cluster_members_customer", "SELECT id, cluster, cluster_size FROM (SELECT c_custkey AS id, MIN(c_custkey) OVER w AS cluster, COUNT(*) OVER w AS cluster_size FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment)) WHERE cluster_size > 1")(
    lambda spark, d: partitions.members(table(spark, d, "customer"), "c_custkey", ["c_nationkey", "c_mktsegment"])
)
register("dictionary_part_type", "SELECT value, ROW_NUMBER() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT p_type AS value FROM part)")(lambda spark, d: partitions.dictionary(table(spark, d, "part"), "p_type"))


def _record_sql(t: str, key: str, columns: Sequence[str]) -> str:
    codes = ", ".join(f"CASE WHEN COUNT(*) OVER (PARTITION BY {c}) > 1 THEN DENSE_RANK() OVER (ORDER BY {c}) - 1 ELSE -1 END AS {c}" for c in columns)
    return f"SELECT {key}, {codes} FROM {t}"


register("records_supplier", _record_sql("supplier", "s_suppkey", ["s_name", "s_nationkey", "s_acctbal"]))(lambda spark, d: partitions.records(table(spark, d, "supplier"), "s_suppkey", ["s_name", "s_nationkey", "s_acctbal"]))


def _mask_sql(columns: Sequence[str], left: str = "l", right: str = "r") -> str:
    return " + ".join(f"CASE WHEN {left}.{c} = {right}.{c} THEN {1 << j} ELSE 0 END" for j, c in enumerate(columns))


def _mask(df: DataFrame) -> DataFrame:
    return df.select(F.element_at("mask", 1).alias("mask")).distinct()


for _t, _id in (("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("customer", "c_custkey")):
    register(f"agree_sets_{_t}", f"SELECT DISTINCT CAST({_mask_sql(COLUMNS[_t])} AS BIGINT) AS mask FROM {_t} l JOIN {_t} r ON l.{_id} < r.{_id}")(
        lambda spark, d, t=_t: _mask(agree.all_pairs(validate.encode(table(spark, d, t))))
    )

#: Whole numbers of a table serve as codes, so that SQL can follow the order in which rows are compared.
_CODED = "SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS c0, l_linenumber AS c1, CAST(l_quantity AS BIGINT) AS c2 FROM lineitem"
_C = ["c0", "c1", "c2"]


def coded(spark: SparkSession, d: str) -> DataFrame:
    long = lambda c: F.col(c).cast("long")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), long("l_suppkey").alias("c0"), long("l_linenumber").alias("c1"), long("l_quantity").alias("c2"))


def _ordered(j: int) -> str:
    return f"PARTITION BY c{j} ORDER BY c{(j - 1) % 3} DESC, c{(j + 1) % 3} DESC, id"


_WINDOW = " UNION ALL ".join(f"SELECT {j} AS k, {d} AS distance, c0, c1, c2, LEAD(c0, {d}) OVER w AS o0, LEAD(c1, {d}) OVER w AS o1, LEAD(c2, {d}) OVER w AS o2 FROM t WINDOW w AS ({_ordered(j)})" for j in range(3) for d in (1, 2))


@register("cluster_windows_lineitem", f"WITH t AS ({_CODED}) SELECT CAST(CASE WHEN c0 = o0 THEN 1 ELSE 0 END + CASE WHEN c1 = o1 THEN 2 ELSE 0 END + CASE WHEN c2 = o2 THEN 4 ELSE 0 END AS BIGINT) AS mask, k, distance, COUNT(*) AS n_pairs FROM ({_WINDOW}) WHERE o0 IS NOT NULL GROUP BY ALL")
def _cluster_windows(spark: SparkSession, d: str) -> DataFrame:
    """Fixed distances within the clusters of each column; large clusters are divided, which changes no pair."""
    found = agree.cluster_windows(coded(spark, d), (1, 2))
    return found.groupBy(F.element_at("mask", 1).alias("mask"), "k", "distance").agg(F.count(F.lit(1)).alias("n_pairs"))


_ROWS = "SELECT o_orderkey AS id, o_custkey AS c0, CAST(EXTRACT(year FROM o_orderdate) AS BIGINT) AS c1, LENGTH(o_orderpriority) AS c2 FROM orders"


def _orders_coded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c0"), F.year("o_orderdate").cast("long").alias("c1"), F.length("o_orderpriority").cast("long").alias("c2"))


register("record_windows_orders", f"WITH t AS ({_ROWS}) SELECT DISTINCT CAST({_mask_sql(_C)} AS BIGINT) AS mask FROM t l JOIN t r ON r.id > l.id AND r.id < l.id + 20")(lambda spark, d: _mask(agree.record_windows(_orders_coded(spark, d), 20)))
register("small_cluster_pairs_orders", f"WITH t AS ({_ROWS}), s AS ({' UNION ALL '.join(f'SELECT id, c{j} AS code, {j} AS k, COUNT(*) OVER (PARTITION BY c{j}) AS size FROM t' for j in range(3))}) SELECT DISTINCT CAST({_mask_sql(_C)} AS BIGINT) AS mask FROM s a JOIN s b ON a.k = b.k AND a.code = b.code AND a.id < b.id AND a.size <= 16 JOIN t l ON l.id = a.id JOIN t r ON r.id = b.id")(
    lambda spark, d: _mask(agree.small_clusters(_orders_coded(spark, d), 16))
)
_RANKED = " UNION ALL ".join(f"SELECT *, c{j} AS code, {j} AS k, ROW_NUMBER() OVER ({_ordered(j)}) AS top, COUNT(*) OVER (PARTITION BY c{j}) AS size FROM t" for j in range(3))
register("tops_and_bottoms_lineitem", f"WITH t AS ({_CODED}), s AS ({_RANKED}) SELECT DISTINCT CAST({_mask_sql(_C)} AS BIGINT) AS mask FROM s l JOIN s r ON l.k = r.k AND l.code = r.code AND l.id <> r.id AND l.top <= 3 AND r.top > r.size - 3")(
    lambda spark, d: _mask(agree.tops_and_bottoms(coded(spark, d), 3))
)
register("pivot_pairs_lineitem", f"WITH t AS ({_CODED}) SELECT DISTINCT CAST({_mask_sql(_C)} AS BIGINT) AS mask FROM t l JOIN t r ON r.id = (SELECT MIN(id) FROM t) AND l.id <> r.id AND ({' OR '.join(f'l.{c} = r.{c}' for c in _C)})")(
    lambda spark, d: _mask(agree.pivot_masks(c := coded(spark, d), c.agg(F.min("id")).first()[0]))
)


def _non_sql(t: str) -> str:
    columns = COLUMNS[t]
    return f"""WITH {_lattice(columns, t, None)},
x AS (SELECT n.m AS l, r.b AS b, r.c AS rhs FROM n JOIN r ON (n.m & r.b) = 0 WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.l = n.m AND v.b = r.b))
SELECT {_names(columns, 'x.l')} AS lhs, x.rhs AS rhs FROM x WHERE NOT EXISTS (SELECT 1 FROM x w WHERE w.b = x.b AND w.l <> x.l AND (w.l & x.l) = x.l)"""


for _t in ("customer", "orders"):
    register(f"maximal_non_fds_{_t}", _non_sql(_t))(lambda spark, d, t=_t: flat(non_dependencies(table(spark, d, t))))

register("dependency_lines_customer", f"WITH f AS ({fd_sql(COLUMNS['customer'], 'customer')}), p AS (SELECT list_sort(string_split(lhs, ',')) AS l, rhs FROM f) SELECT '[' || array_to_string(l, ', ') || '] --> ' || array_to_string(list_sort(list(rhs)), ', ') AS value FROM p GROUP BY l")(
    lambda spark, d: dependency_lines(discover(table(spark, d, "customer")))
)
register("same_partition_orders", "SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT o_orderkey FROM orders)) = (SELECT COUNT(*) FROM (SELECT DISTINCT o_custkey, o_totalprice FROM orders)) AND (SELECT COUNT(*) FROM (SELECT DISTINCT o_orderkey FROM orders)) = (SELECT COUNT(*) FROM (SELECT DISTINCT o_orderkey, o_custkey, o_totalprice FROM orders)) AS same")(
    lambda spark, d: spark.createDataFrame([(partitions.same_partition(table(spark, d, "orders"), ["o_orderkey"], ["o_custkey", "o_totalprice"]),)], "same boolean")
)
