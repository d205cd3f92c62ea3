from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators import agree, partitions, validate
from lodestar.operators.discover import Config, discover, non_dependencies
from lodestar.sources.tables import dependencies, dependency_lines, from_rows, read_csv, read_table, write_dependencies
from tests.brute import agree_sets, minimal_fds
from tests.conftest import SF_SMALL

FIXTURES = Path(__file__).parents[1] / "FIXTURES.md"


def golden():
    """The inline relations of FIXTURES.md with their dependencies."""
    for part in re.split(r"^### ", FIXTURES.read_text(), flags=re.M)[1:]:
        if "columns:" not in part:
            continue
        name = part.split()[0]
        names = re.findall(r"`([^`]+)`", re.search(r"^columns: (.*)$", part, re.M)[1])
        rows = re.search(r"^rows: (.*)$", part, re.M)
        values = [[v.replace('""', "") for v in r.split(", ")] for r in re.findall(r"\(([^)]*)\)", rows[1])] if rows else []
        fds = {(frozenset(filter(None, x.split(","))), a) for x, right in re.findall(r"\{([^}]*)\}→([^;\n]+)", re.search(r"^FDs: (.*)$", part, re.M)[1]) for a in right.split(",")}
        yield pytest.param(names, values, fds, id=name)


def found(df, **options):
    return {(frozenset(r["lhs"]), r["rhs"]) for r in discover(df, **options).collect()}


@pytest.mark.skipif(not FIXTURES.exists(), reason="the fixtures' file is absent")
@pytest.mark.parametrize("names,rows,fds", list(golden()) if FIXTURES.exists() else [])
def test_golden_relations(spark, names, rows, fds):
    df = from_rows(spark, names, rows)
    assert found(df) == fds
    assert found(df, method="pairs") == fds


NULLS = [("x", None), ("x", None), ("y", "1"), ("z", "2")]
AB, BA, NIL = ({"a"}, "b"), ({"b"}, "a"), (set(), "b")


@pytest.mark.parametrize("method", ["hybrid", "pairs", "lattice"])
@pytest.mark.parametrize(
    "rows,equal,expected",
    [(NULLS, True, [AB, BA]), (NULLS, False, [BA]), ([("x", None), ("y", None)], True, [NIL]), ([("x", None), ("y", None)], False, [AB, BA]), ([("x", None)], False, [(set(), "a"), NIL]), ([], True, [(set(), "a"), NIL]), ([], False, [(set(), "a"), NIL])],
)
def test_nulls_and_tiny_relations(spark, method, rows, equal, expected):
    df = from_rows(spark, ["a", "b"], rows)
    assert found(df, null_equals_null=equal, method=method) == {(frozenset(x), a) for x, a in expected}


def test_single_column(spark):
    assert found(from_rows(spark, ["a"], [("1",), ("1",)])) == {(frozenset(), "a")}
    assert found(from_rows(spark, ["a"], [("1",), ("2",)])) == set()


@pytest.mark.parametrize("seed", range(4))
def test_methods_agree_with_the_definition(spark, seed):
    """Skewed data, so that sampling misses pairs and levels refute candidates."""
    r = random.Random(seed)
    names = ["a b", "select", "c.d", "e", "f"]
    rows = [tuple(None if r.random() < 0.05 else str(int(r.paretovariate(0.7)) % (3 + 4 * k)) for k in range(5)) for _ in range(120)]
    df = from_rows(spark, names, rows)
    for equal in (True, False):
        expected = minimal_fds(names, rows, equal)
        for method in ("hybrid", "pairs", "lattice"):
            assert found(df, null_equals_null=equal, method=method) == expected, (method, equal)
        for k in (0, 1, 2):
            assert found(df, null_equals_null=equal, max_lhs=k) == minimal_fds(names, rows, equal, k)


def test_refuted_levels_resample(spark, monkeypatch):
    """Without a sample every candidate is checked against the rows, and clashes drive the search."""
    r = random.Random(9)
    names = list("abcdef")
    rows = [tuple(str(r.randrange(2 + k)) for k in range(6)) for _ in range(60)]
    monkeypatch.setattr(agree, "cluster_windows", lambda codes, *a: codes.select(F.array(F.lit(0).cast("long")).alias("mask")).limit(0))
    assert found(from_rows(spark, names, rows)) == minimal_fds(names, rows)


def test_row_limit_and_receiver(spark):
    rows = [(str(k), str(k % 3), "x" if k < 5 else "y") for k in range(9)]
    df = from_rows(spark, list("abc"), rows)
    assert found(df, row_limit=5, order_by=("a",)) == minimal_fds(list("abc"), rows[:5])
    assert found(df, row_limit=-1) == minimal_fds(list("abc"), rows)
    calls = []
    out = discover(df, table="t", receiver=lambda x, a: calls.append((x, a)))
    assert {r["table"] for r in out.collect()} == {"t"} and len(calls) == out.count()
    assert set(calls) == set(dependencies(out))


def test_bad_options(spark):
    df = from_rows(spark, ["a"], [("1",)])
    for options in ({"max_lsh": 2}, {"max_lhs": "2"}, {"method": "magic"}, {"null_equals_null": 1}):
        with pytest.raises(ValueError):
            discover(df, **options)
    assert set(Config.requirements()) >= {"null_equals_null", "max_lhs", "row_limit"}
    with pytest.raises(ValueError):
        validate.check_fd(df, ["b"], "a")
    with pytest.raises(ValueError):
        from_rows(spark, ["a", "b"], [("1",)])


def test_typed_and_nested_columns(spark):
    schema = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("l", T.ArrayType(T.IntegerType())), T.StructField("m", T.MapType(T.StringType(), T.IntegerType()))])
    df = spark.createDataFrame([(0.0, [1], {"a": 1}), (-0.0, [1], {"a": 1}), (1.0, [2], {"a": 2})], schema)
    with pytest.raises(ValueError):
        discover(df)
    assert (frozenset({"d"}), "l") in found(df.drop("m"))
    assert (frozenset({"m"}), "l") in found(df, compare_as_string=True)
    assert (frozenset({"l"}), "d") not in found(df, compare_as_string=True)


def test_checks_and_violations(spark):
    df = from_rows(spark, ["a", "b"], NULLS)
    assert validate.check_fd(df, ["a"], "b") and not validate.check_fd(df, ["a"], "b", null_equals_null=False)
    assert validate.check_fd(df, ["b"], "a", null_equals_null=False) and not validate.check_fd(df, [], "a")
    mixed = from_rows(spark, ["a", "b"], [("x", None), ("x", "1"), ("y", "2")])
    assert [tuple(r) for r in validate.violations(mixed, ["a"], "b").collect()] == [("x", 2, None, "1")]
    out = validate.validate(mixed, [(["a"], "b"), (["b"], "a"), ([], "b")])
    assert [r["holds"] for r in out.collect()] == [False, True, False]


def test_agree_sets_and_maximal_sets(spark):
    r = random.Random(3)
    rows = [tuple(r.choice([None, "1", "2"]) for _ in range(4)) for _ in range(12)]
    df = from_rows(spark, list("abcd"), rows)
    for equal in (True, False):
        codes = validate.encode(df, None, equal)
        exact = agree.masks(agree.all_pairs(codes))
        assert exact == agree_sets(rows, equal)
        rowed = agree.numbered(codes)
        first = rowed.agg(F.min("id")).first()[0]
        for some in (agree.cluster_windows(codes, (1, 2, 3)), agree.small_clusters(rowed), agree.tops_and_bottoms(rowed), agree.pivot_masks(rowed, first), agree.record_windows(rowed, 5)):
            assert agree.masks(some) <= exact
        assert set() < agree.progressive_windows(codes) <= exact
        assert agree.masks(agree.new_masks(agree.all_pairs(codes), exact, spark)) == set()
    with pytest.raises(ValueError):
        agree.all_pairs(validate.encode(df), max_rows=3)
    pairs = agree_sets(rows)
    expected = {(frozenset(c for k, c in enumerate("abcd") if m >> k & 1), "abcd"[a]) for a in range(4) for m in pairs if not m >> a & 1 and not any(m != o and m & ~o == 0 and not o >> a & 1 for o in pairs)}
    assert {(frozenset(x["lhs"]), x["rhs"]) for x in non_dependencies(df).collect()} == expected


def test_agree_sets_of_more_rows_than_pairs_can_be_spelled_out(spark):
    """60,000 rows: 1.8 billion pairs, which the former limit of 50,000 rows refused."""
    df = spark.range(60_000).selectExpr("id", "id % 25 AS a", "id % 1000 AS b", "7 AS c", "CASE WHEN id < 3 THEN id ELSE 3 END AS d")
    exact = {0b01000, 0b11000, 0b01010, 0b11010, 0b01110, 0b11110}
    assert agree.masks(agree.all_pairs(validate.encode(df))) == exact
    assert found(df, method="pairs") == {(frozenset(), "c"), *((frozenset({"id"}), x) for x in "abd"), (frozenset("b"), "a")}


@pytest.mark.parametrize("equal", [True, False])
def test_agree_sets_by_counts_and_by_joins(spark, monkeypatch, equal):
    r = random.Random(8)
    rows = [(str(k), "x", None if r.random() < 0.2 else r.choice("ab"), r.choice(["1", "2", None]), str(r.randrange(30)), str(r.randrange(4))) for k in range(70)]
    rows += [("70", "x", *rows[0][2:]), ("71", "x", None, None, "0", "0"), ("72", "x", None, None, "0", "0")]
    codes, exact = validate.encode(from_rows(spark, list("abcdef"), rows), None, equal), agree_sets(rows, equal)
    for columns, sets in ((12, 64), (12, 3), (0, 64)):
        monkeypatch.setattr(agree, "COUNTED_COLUMNS", columns)
        monkeypatch.setattr(agree, "COUNTED_SETS", sets)
        assert agree.masks(agree.all_pairs(codes)) == exact


def test_many_columns(spark):
    """More columns than a mask's number has bits."""
    names = [f"c{k}x" for k in range(70)]
    rows = [tuple("0" if k == 69 else str(j if k == 68 else 0) for k in range(70)) for j in range(3)]
    assert found(from_rows(spark, names, rows)) == {(frozenset(), c) for k, c in enumerate(names) if k != 68}


def test_partitions(spark):
    df = from_rows(spark, ["i", "a", "b"], [(str(k), a, b) for k, (a, b) in enumerate([("a", "1"), ("a", "1"), ("b", None), ("c", "2"), ("b", None), ("c", "3")])])
    assert {tuple(r) for r in partitions.clusters(df, ["a"]).collect()} == {("a", 2), ("b", 2), ("c", 2)}
    assert {tuple(r) for r in partitions.clusters(df, ["a", "b"]).collect()} == {("a", "1", 2), ("b", None, 2)}
    assert {tuple(r) for r in partitions.clusters(df, ["a", "b"], null_equals_null=False).collect()} == {("a", "1", 2)}
    assert {(r["id"], r["cluster"]) for r in partitions.members(df, "i", ["a"]).collect()} == {("0", "0"), ("1", "0"), ("2", "2"), ("4", "2"), ("3", "3"), ("5", "3")}
    stats = {r["column"]: r for r in partitions.statistics(df, null_equals_null=False).collect()}
    assert stats["i"]["is_unique"] and not stats["a"]["is_unique"] and stats["b"]["n_distinct"] == 5 and stats["b"]["n_clusters"] == 1
    assert all(r["is_constant"] and r["n_rows"] == 0 for r in partitions.statistics(df.limit(0)).collect())
    assert [r["column"] for r in partitions.ranked_columns(df).orderBy("rank").collect()] == ["i", "b", "a"]
    assert {tuple(r) for r in partitions.dictionary(df, "b").collect()} == {("1", 0), ("2", 1), ("3", 2)}
    assert {tuple(r) for r in partitions.records(df, "i", ["a", "b"]).collect()} == {("0", 0, 0), ("1", 0, 0), ("2", 1, -1), ("3", 2, -1), ("4", 1, -1), ("5", 2, -1)}
    assert not partitions.same_partition(df, ["a"], ["b"]) and partitions.same_partition(df, ["i"], ["i", "a"])


def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('1,"a,b",\n2,c,x\n')
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in df.collect()] == [("1", "a,b", None), ("2", "c", "x")] and df.columns == ["column1", "column2", "column3"]
    fds = discover(df)
    lines = {r["value"] for r in dependency_lines(fds).collect()}
    assert "[column1] --> column2, column3" in lines
    assert {r["value"] for r in dependency_lines(fds, "t").collect()} >= {"[t.column1] --> t.column2, t.column3"}
    assert write_dependencies(fds, str(tmp_path / "out")) == fds.count() == 6
    text = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert text.count(b"\r\n") == len(lines)
    assert read_table(spark, f"{SF_SMALL}/nation.parquet", row_limit=3, order_by=["n_nationkey"]).count() == 3


def test_scan_reads_only_the_columns_it_needs(spark):
    df = read_table(spark, f"{SF_SMALL}/lineitem.parquet")
    plan = validate.violations(df, ["l_suppkey"], "l_returnflag")._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 12
    assert {q for q in entry.queries() if not q.startswith("op") and q != "pipeline"} == {q for q in entry.oracle_sql() if not q.startswith("op")}


def test_divided_clusters_keep_all_pairs(spark, monkeypatch):
    """Clusters far over the limit give the pairs that SQL gives, across the bounds of their parts, too."""
    import duckdb

    from lodestar import queries

    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF_SMALL}/lineitem.parquet'")
    expected = sorted(db.execute(f"SELECT mask, k, distance, n_pairs FROM ({queries.ORACLE_SQL['cluster_windows_lineitem']})").fetchall())
    for limit in (400, 150):
        monkeypatch.setattr(agree, "CLUSTER_ROWS", limit)
        assert sorted(tuple(r) for r in queries.QUERIES["cluster_windows_lineitem"](spark, SF_SMALL).select("mask", "k", "distance", "n_pairs").collect()) == expected


def test_sampler_finds_masks_and_resumes(spark, monkeypatch):
    r = random.Random(5)
    rows = [tuple(str(int(r.paretovariate(0.6)) % (4 + 5 * k)) for k in range(6)) for _ in range(400)]
    codes = validate.encode(from_rows(spark, list("abcdef"), rows))
    exact = agree_sets(rows)
    sampler = agree.Sampler(codes, len(rows), threshold=0.05)
    first, rounds = set(sampler.run()), dict(sampler.round)
    assert first and first <= exact and any(v < len(agree.ROUNDS) for v in rounds.values())
    sampler.threshold = 0.002
    second = sampler.run()
    assert sampler.runs == 2 and first <= second <= exact and any(sampler.round[k] > rounds[k] for k in rounds)
    monkeypatch.setattr(agree, "SAMPLE_ROWS", 100)
    monkeypatch.setattr(agree, "SAMPLE_CLUSTERS", 2)
    some = agree.Sampler(codes, len(rows))
    assert 0 < some.long.count() < 6 * len(set(rows)) and some.run() <= exact


def test_discovery_resumes_its_sampler(spark, monkeypatch):
    """A poor first sample leaves wrong candidates; the level that refutes them resumes the sampler and looks at clashes."""
    from lodestar.operators import discover as module

    r = random.Random(11)
    names = list("abcdefg")
    rows = [tuple(str(r.randrange(3 + k)) for k in range(7)) for _ in range(150)]
    runs, found_masks = [], []

    class Poor(agree.Sampler):
        def run(self):
            runs.append(self.threshold)
            return super().run() if len(runs) > 1 else set()

    witness = module.witness_masks
    monkeypatch.setattr(agree, "Sampler", Poor)
    monkeypatch.setattr(module, "witness_masks", lambda *a: found_masks.append(witness(*a)) or found_masks[-1])
    assert found(from_rows(spark, names, rows)) == minimal_fds(names, rows)
    assert len(runs) > 1 and found_masks and found_masks[0] and set().union(*found_masks) <= agree_sets(rows)


@pytest.mark.parametrize("equal", [True, False])
def test_checks_on_stripped_partitions(spark, monkeypatch, equal):
    """Few groups or many, broadcast or not: the same answer as the definition's."""
    r = random.Random(2)
    rows = [tuple(None if r.random() < 0.03 else str(r.randrange(m)) for m in (40, 30, 4, 3, 2)) for _ in range(150)]
    codes, pairs = validate.encode(from_rows(spark, list("abcde"), rows), None, equal), agree_sets(rows, equal)
    candidates = {x: ((1 << 5) - 1) & ~x for x in range(31)}
    expected = {x: sum(1 << a for a in range(5) if not x >> a & 1 and any(x & ~m == 0 and not m >> a & 1 for m in pairs)) for x in candidates}
    for few in (0, 500_000):
        monkeypatch.setattr(validate, "FEW_GROUPS", few)
        checker = validate.Checker(codes, len(rows), not equal)
        assert checker.refuted(candidates) == expected and any(t is not None for t in checker.stripped.values())


def test_scratch_tables_can_be_released(spark):
    from lodestar.plans.scratch import materialize, release

    release(spark)
    df = materialize(spark.range(5), "some")
    assert df.count() == 5 and release(spark) == 1 and release(spark) == 0
    with pytest.raises(Exception, match="(?i)exist|not.found"):
        df.count()
