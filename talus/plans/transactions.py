"""Queries over the store: writers that meet, savepoints, and tables whose columns grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.plans.views import table
from talus.shared import new_path as shared
from talus.store import Change, Store


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))


def _change(rows, gone=None):
    keys = rows.select("o_orderkey")
    return Change(rows, keys if gone is None else keys.union(gone), "o_orderkey")


def interleaved_commits(spark, sf_dir):
    """Orders after writers that met: two changed other keys of the same parts, a third lost to a delete and ran again."""
    root = shared(spark)
    store, other = Store(spark, root), Store(spark, root)
    orders = _orders(spark, sf_dir)
    store.commit({}, {"orders": _change(orders)})
    with store.transaction() as t:
        t.change("orders", _change(orders.where("o_orderkey % 3 = 0").withColumn("price", F.col("price") + 1)))
        other.commit({}, {"orders": _change(orders.where("o_orderkey % 3 = 1").withColumn("price", F.col("price") * 2))})
    met = []

    def doubled(t):
        rows = t.read("orders").where("o_orderkey % 6 = 0").withColumn("price", F.col("price") * 2)
        t.change("orders", _change(rows))
        if not met:
            met.append(other.commit({}, {"orders": _change(orders.where("false"), orders.where("o_orderkey % 6 = 4").select("o_orderkey"))}))

    store.run(doubled)
    return store.read("orders")


def savepoint_rollback(spark, sf_dir):
    """Suppliers and a count of them: what an inner block wrote before it failed is undone, what came before and after stays."""
    store, s = Store(spark, shared(spark)), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    with store.transaction() as t:
        t.write("suppliers", s)
        try:
            with store.transaction() as inner:
                inner.change("suppliers", Change(s.where("false"), s.select("s_suppkey"), "s_suppkey"))
                inner.write("counts", s.where("false").groupBy("s_nationkey").count())
                raise LookupError("no such nation")
        except LookupError:
            pass
        with store.transaction() as inner:
            inner.change("suppliers", Change(s.where("false"), s.where("s_nationkey % 2 = 0").select("s_suppkey"), "s_suppkey"))
        t.write("counts", t.read("suppliers").groupBy("s_nationkey").agg(F.count("*").alias("suppliers")))
    return store.read("counts")


def schema_growth(spark, sf_dir):
    """Customers whose nation became a long and who got a segment and a structure with one field more in some parts only."""
    store, c = Store(spark, shared(spark)), table(spark, sf_dir, "customer")
    old = c.select("c_custkey", F.col("c_nationkey").cast("int").alias("nation"), F.struct(F.col("c_nationkey").cast("int").alias("a")).alias("about"))
    new = c.where("c_custkey % 4 = 0").select(
        "c_custkey", (F.col("c_nationkey") + F.lit(10_000_000_000)).alias("nation"), F.col("c_mktsegment").alias("segment"),
        F.struct(F.col("c_nationkey").cast("long").alias("a"), F.col("c_mktsegment").alias("b")).alias("about"))
    for rows in (old, new):
        store.commit({}, {"customers": Change(rows, rows.select("c_custkey"), "c_custkey")})
    return store.read("customers").select("c_custkey", "nation", "segment", F.col("about.a").alias("a"), F.col("about.b").alias("b"))


ORACLE = {
    "interleaved_commits": """
select o_orderkey, case when o_orderkey % 6 = 0 then (o_totalprice + 1) * 2 when o_orderkey % 3 = 0 then o_totalprice + 1 when o_orderkey % 3 = 1 then o_totalprice * 2 else o_totalprice end as price
from orders where o_orderkey % 6 <> 4""",
    "savepoint_rollback": "select s_nationkey, count(*) as suppliers from supplier where s_nationkey % 2 <> 0 group by s_nationkey",
    "schema_growth": """
select c_custkey, case when c_custkey % 4 = 0 then c_nationkey + 10000000000 else c_nationkey end::bigint as nation, case when c_custkey % 4 = 0 then c_mktsegment end as segment,
       c_nationkey::bigint as a, case when c_custkey % 4 = 0 then c_mktsegment end as b from customer""",
}

QUERIES = {f.__name__: f for f in (interleaved_commits, savepoint_rollback, schema_growth)}
