"""Transactions of the store: conflicts, savepoints, retries, and schemas that grow."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.store import Change, Conflict, Store, merged_schema, wider


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s", parts=4)


@pytest.fixture
def second(spark, store):
    return Store(spark, store.root, parts=4)


def rows(spark, values, schema="k long, v string"):
    return spark.createDataFrame(values, schema)


def change(spark, values, gone=(), schema="k long, v string"):
    df = rows(spark, values, schema)
    keys = df.select("k").union(spark.createDataFrame([(k,) for k in gone], "k long"))
    return Change(df, keys, "k")


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_writers_of_different_tables_both_survive(spark, store, second):
    store.commit({"t0": spark.range(1)})
    with store.transaction() as a:
        a.write("mine", spark.range(2))
        second.commit({"other": spark.range(3)})
    assert store.tables() == ["mine", "other", "t0"] and store.read("mine").count() == 2 and second.read("other").count() == 3


@pytest.mark.parametrize("first", [True, False])
def test_two_writers_of_one_whole_table(spark, store, second, first):
    """Whichever is second raises, in either order, and leaves nothing."""
    store.commit({"t": spark.range(1)})
    one, two = (store, second) if first else (second, store)
    with pytest.raises(Conflict), one.transaction() as t:
        t.write("t", spark.range(5))
        two.commit({"t": spark.range(7)})
    assert one.read("t").count() == 7 and len(one._numbers()) == 2


def test_changes_of_other_keys_are_both_kept_even_in_one_part(spark, store, second):
    store = Store(spark, store.root, parts=1)
    store.commit({}, {"t": change(spark, [(k, "old") for k in range(6)])})
    with store.transaction() as t:
        t.change("t", change(spark, [(1, "mine"), (9, "new")], gone=[2]))
        Store(spark, store.root, parts=1).commit({}, {"t": change(spark, [(3, "other")], gone=[4])})
    assert values(store.read("t")) == [(0, "old"), (1, "mine"), (3, "other"), (5, "old"), (9, "new")]


def test_changes_of_one_key_conflict_and_can_run_again(spark, store, second):
    store.commit({}, {"t": change(spark, [(1, "a"), (2, "b")])})
    with pytest.raises(Conflict), store.transaction() as t:
        t.change("t", change(spark, [(1, "mine")]))
        second.commit({}, {"t": change(spark, [(1, "other")])})
    assert values(store.read("t")) == [(1, "other"), (2, "b")]
    tries = []

    def append(t):
        """Reads and writes: right only if nobody came between."""
        new = t.read("t").where("k = 1").withColumn("v", F.concat("v", F.lit("+")))
        t.change("t", Change(new, new.select("k"), "k"))
        tries.append(1)
        if len(tries) == 1:
            second.commit({}, {"t": change(spark, [(1, "late")])})

    store.run(append)
    assert len(tries) == 2 and values(store.read("t")) == [(1, "late+"), (2, "b")]
    with pytest.raises(Conflict):
        store.run(lambda t: (append(t), second.commit({}, {"t": change(spark, [(1, "again")])})), attempts=2)


def test_a_table_that_was_read_may_not_change(spark, store, second):
    store.commit({"source": spark.range(3), "free": spark.range(1)})
    with pytest.raises(Conflict), store.transaction() as t:
        t.write("sum", t.read("source").agg(F.sum("id").alias("id")))
        second.commit({"source": spark.range(9)})
    assert store.tables() == ["free", "source"]
    with store.transaction() as t:
        n = t.read("source").count()
        t.write("sum", spark.range(n))
        second.commit({"free": spark.range(2)})
    assert store.read("sum").count() == 9


def test_nothing_of_a_failed_block_is_left_and_own_writes_are_seen(spark, store):
    with pytest.raises(ZeroDivisionError), store.transaction() as t:
        t.write("a", spark.range(1))
        1 / 0
    assert store.tables() == []
    with store.transaction() as t:
        t.write("a", spark.range(2))
        assert t.read("a").count() == 2 and store.read("a") is None
        t.change("b", change(spark, [(1, "x")]))
        t.change("b", change(spark, [(2, "y")]))
    assert store.read("a").count() == 2 and values(store.read("b")) == [(1, "x"), (2, "y")]
    assert store.vacuum() == 1 and values(store.read("b")) == [(1, "x"), (2, "y")]  # the first version of b was never current


def test_an_inner_block_is_a_savepoint(spark, store):
    with store.transaction() as t:
        t.write("before", spark.range(1))
        with pytest.raises(RuntimeError), store.transaction() as inner:
            inner.write("lost", spark.range(1))
            inner.write("before", spark.range(8))
            raise RuntimeError
        with store.transaction() as inner:
            inner.write("kept", spark.range(1))
        t.write("after", spark.range(1))
    assert store.tables() == ["after", "before", "kept"] and store.read("before").count() == 1
    assert len(store._numbers()) == 1


def test_past_states_can_be_read_until_they_are_vacuumed(spark, store):
    for n in (1, 2, 3):
        store.commit({"t": spark.range(n)})
    assert [store.read("t", k).count() for k in range(3)] == [1, 2, 3]


def test_a_column_that_one_part_adds_is_there_for_all(spark, store):
    store.commit({}, {"t": change(spark, [(k, "x") for k in range(8)])})
    store.commit({}, {"t": change(spark, [(1, "y", 2.5)], schema="k long, v string, extra double")})
    got = store.read("t")
    assert got.columns == ["k", "v", "extra"] and values(got.where("k < 3").na.fill(-1)) == [(0, "x", -1.0), (1, "y", 2.5), (2, "x", -1.0)]
    store.commit({}, {"t": change(spark, [(2,)], schema="k long")})
    assert values(store.read("t").where("k = 2").na.fill("none").na.fill(-1)) == [(2, "none", -1.0)]


def test_types_are_widened_by_rule(spark, store):
    first = "k long, n int, f float, d decimal(5,2), day date, s struct<a:int>, xs array<struct<a:int>>"
    then = "k long, n long, f double, d decimal(8,1), day date, s struct<a:bigint,b:string>, xs array<struct<b:string,a:bigint>>"
    day = datetime.date(2026, 1, 1)
    store.commit({}, {"t": change(spark, [(k, k, 0.5, Decimal(1), day, (k,), [(k,)]) for k in range(6)], schema=first)})
    store.commit({}, {"t": change(spark, [(9, 2**40, 0.1, Decimal(2), day, (2**40, "b"), [("x", 2**40)])], schema=then)})
    got = store.read("t")
    assert got.schema == store.schema("t")
    assert got.schema.simpleString() == "struct<k:bigint,n:bigint,f:double,d:decimal(9,2),day:date,s:struct<a:bigint,b:string>,xs:array<struct<a:bigint,b:string>>>"
    assert {r.k: (r.n, r.f, int(r.d), tuple(r.s), [tuple(x) for x in r.xs]) for r in got.where("k in (3, 9)").collect()} == {
        3: (3, 0.5, 1, (3, None), [(3, None)]), 9: (2**40, 0.1, 2, (2**40, "b"), [(2**40, "x")])}


def test_types_that_have_nothing_in_common_are_refused_and_nothing_is_committed(spark, store):
    store.commit({}, {"t": change(spark, [(1, "x")])})
    with pytest.raises(ValueError, match="column v"):
        store.commit({"other": spark.range(1)}, {"t": change(spark, [(2, 5)], schema="k long, v int")})
    assert store.tables() == ["t"] and values(store.read("t")) == [(1, "x")]


def test_a_table_without_rows_keeps_its_columns(spark, store):
    store.commit({}, {"t": change(spark, [(1, "x")])})
    store.commit({}, {"t": change(spark, [], gone=[1])})
    assert store.read("t").columns == ["k", "v"] and store.read("t").count() == 0
    store.commit({}, {"t": change(spark, [(2, "y")])})
    assert values(store.read("t")) == [(2, "y")]


def test_a_log_without_schemas_is_read_by_what_its_files_say(spark, store):
    """As earlier versions of the library wrote it."""
    rows(spark, [(1, "x")]).write.parquet(f"{store.root}/t/v/_part=0")
    rows(spark, [(2, "y", 3)], "k long, v string, n int").write.parquet(f"{store.root}/t/v/_part=1")
    spark.createDataFrame([("t", 0, "v"), ("t", 1, "v")], "name string, part int, version string").coalesce(1).write.json(f"{store.root}/_commits/00000000")
    assert store.read("t").columns == ["k", "v", "n"] and store.read("t").count() == 2
    store.commit({}, {"t": change(spark, [(3, "z")])})
    assert {r.k: r.n for r in store.read("t").collect()} == {1: None, 2: 3, 3: None}


def test_rules_of_types():
    assert wider(T.ShortType(), T.LongType()) == T.LongType() and wider(T.IntegerType(), T.DoubleType()) == T.DoubleType()
    for a, b in ((T.LongType(), T.DoubleType()), (T.StringType(), T.IntegerType()), (T.DecimalType(38, 0), T.DecimalType(38, 10)), (T.ArrayType(T.LongType()), T.LongType())):
        with pytest.raises(ValueError):
            wider(a, b)
    assert merged_schema(T.StructType.fromDDL("A int"), T.StructType.fromDDL("b string, a long")).simpleString() == "struct<A:bigint,b:string>"
