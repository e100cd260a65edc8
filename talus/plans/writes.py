"""Queries over events, keys and writes: repair of sequences, project keys, decisions, upserts, cascades."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus import store
from talus.functions.text import united
from talus.operators import memory
from talus.plans.views import table
from talus.sources.tool_b import marked_by_followers, told_twice
from talus.sources.tool_d import monotonic


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "value")


def monotonic_ts(spark, sf_dir):
    """Times within a user, made to go on by event id."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = _events(spark, sf_dir).withColumn("position", F.row_number().over(w) - 1).withColumnRenamed("user_id", "conversation_id")
    return rows.select("event_id", monotonic(F.col("ms"), F.lit(0).cast("long"), "position").alias("ms"))


def dup_suppress(spark, sf_dir):
    """Events whose type isn't that of the user's event before."""
    rows = _events(spark, sf_dir).withColumn("told", told_twice("user_id", "event_id", "event_type"))
    return rows.where("not told").select("event_id", "user_id", "event_type")


def tool_mark_forward(spark, sf_dir):
    """Each view, and whether a click follows before the user's next view."""
    rows = marked_by_followers(_events(spark, sf_dir), "user_id", "event_id", F.col("event_type") == "view", F.col("event_type") == "click", "marked")
    return rows.where("event_type = 'view'").select("event_id", "user_id", "marked")


def array_union_order(spark, sf_dir):
    """Each user's event types in order of first appearance, those of small values before those of large ones."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    rows = _events(spark, sf_dir)
    low = rows.where("value < 20").groupBy("user_id").agg(ordered.alias("low"))
    high = rows.where("value >= 20").groupBy("user_id").agg(ordered.alias("high"))
    return low.join(high, "user_id", "full").select("user_id", F.array_join(united(F.col("low"), F.col("high")), ",").alias("types"))


def alias_canonical(spark, sf_dir):
    """Nations by their region's name where an alias is known, else by their own."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("project_key"))
    return memory.canonical_keys(rows, _aliases(spark, sf_dir)).select("n_nationkey", "canonical_key")


def _aliases(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).where("n_regionkey <> 2").select(F.col("n_name").alias("alias_key"), F.col("r_name").alias("canonical_key"))


def alias_union(spark, sf_dir):
    return memory.key_set(_aliases(spark, sf_dir), "EUROPE")


def project_key_sha(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    remote = F.when(F.col("url").isNotNull(), F.array(F.struct(F.lit("origin").alias("name"), F.col("url").alias("url"))))
    return pages.select("page_id", memory.remote_path(F.col("url")).alias("remote"), memory.project_key(remote, F.lit(None).cast("string"), F.col("url")).alias("project_key"))


def merge_decision(spark, sf_dir):
    """Documents of even ids against those of odd ids: the start of a text is its cause, its language the fix."""
    d = table(spark, sf_dir, "documents")
    none = F.array().cast("array<string>")
    columns = [
        F.col("source").alias("project_key"), F.col("text").alias("summary"), F.left("text", F.lit(3)).alias("root_cause"), F.when(F.col("lang") != "en", F.col("lang")).alias("resolution"),
        F.array("lang", F.left("text", F.lit(2))).alias("error_signatures"), *(none.alias(a) for a in memory.ARRAYS if a != "error_signatures"),
    ]
    candidates = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("candidate_id"), *columns)
    existing = d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("note_id"), F.col("doc_id").alias("rank"), *columns)
    return memory.decide_writes(candidates, existing).select("candidate_id", "decision", "reason", "target_note_id")


def change_detect(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    stored = orders.where("o_orderkey % 5 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return store.changed(orders, stored, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


def _orders(spark, sf_dir):
    """Prices by order; an order without a key is none, to the SQL as well."""
    return table(spark, sf_dir, "orders").where("o_orderkey is not null").select("o_orderkey", F.col("o_totalprice").alias("price"))


def _lines(spark, sf_dir):
    """Prices by order, and each line's place in its table: lines of an order may share a number, of which SQL takes the first.

    A line without a price or a number gives way to the others of its order; where there is no other, the price is null.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    known = F.col("l_extendedprice").isNotNull() & F.col("l_linenumber").isNotNull()
    line = [F.when(known, F.col(c)).alias(name) for c, name in (("l_extendedprice", "price"), ("l_linenumber", "l_linenumber"))]
    return table(spark, sf_dir, "lineitem").where("l_orderkey is not null").select(F.col("l_orderkey").alias("o_orderkey"), *line, *place)


def upsert_last_wins(spark, sf_dir):
    return store.upsert(_orders(spark, sf_dir), _lines(spark, sf_dir).where("o_orderkey % 3 = 0"), ["o_orderkey"], "l_linenumber", ["file", "at"])


def insert_ignore(spark, sf_dir):
    return store.insert_ignore(_orders(spark, sf_dir).where("o_orderkey % 2 = 0"), _lines(spark, sf_dir), ["o_orderkey"], "l_linenumber", ["file", "at"])


def cascade_delete(spark, sf_dir):
    """How many rows each table keeps once the customers in debt are gone, orders being notes and lines their chunks."""
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    tables = {
        "conversations": c.select(F.col("c_custkey").alias("id")), "messages": o.select(F.col("o_custkey").alias("conversation_id")),
        "notes": o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("conversation_id")), "embeddings": li.select(F.col("l_orderkey").alias("note_id")),
        "note_relations": o.select(F.col("o_orderkey").alias("source_note_id"), (F.col("o_orderkey") + 1).alias("target_note_id")),
        "writeback_receipts": o.select(F.col("o_orderkey").alias("note_id"), F.lit(None).cast("long").alias("merged_into_note_id")),
    }
    left = store.cascade_delete(tables, c.where("c_acctbal < 0").select(F.col("c_custkey").alias("id")))
    out = None
    for name, df in left.items():
        known = F.count("note_id") if name == "writeback_receipts" else F.count("*")
        row = df.agg(F.lit(name).alias("name"), known.alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


_SQL_REMOTE = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) || '/' || lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'))"

ORACLE = {
    "monotonic_ts": """
with e as (select event_id, user_id, epoch_us(ts) // 1000 as ms, row_number() over (partition by user_id order by event_id) - 1 as i from events)
select event_id, cast(i + greatest(0, max(ms - i) over (partition by user_id order by i rows unbounded preceding)) as bigint) as ms from e""",
    "dup_suppress": """
select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as before from events) where before is null or before <> event_type""",
    "tool_mark_forward": """
with n as (select *, count(*) filter (event_type = 'view') over (partition by user_id order by event_id rows unbounded preceding) as nth from events),
m as (select *, bool_or(event_type = 'click') over (partition by user_id, nth) as marked from n)
select event_id, user_id, marked from m where event_type = 'view'""",
    "array_union_order": """
with f as (select user_id, event_type, min(case when value < 20 then event_id else event_id + 1000000000 end) as first from events group by user_id, event_type)
select user_id, string_agg(event_type, ',' order by first) as types from f group by user_id""",
    "alias_canonical": """
select n_nationkey, coalesce(case when n_regionkey <> 2 then r_name end, n_name) as canonical_key from nation left join region on n_regionkey = r_regionkey""",
    "alias_union": "select 'EUROPE' as project_key union select n_name from nation join region on n_regionkey = r_regionkey where r_name = 'EUROPE' and n_regionkey <> 2",
    "project_key_sha": f"select page_id, {_SQL_REMOTE} as remote, 'git:' || left(sha256({_SQL_REMOTE}), 24) as project_key from pages",
    "merge_decision": """
with d as (select doc_id, source, text, lower(left(text, 3)) as cause, case when lang <> 'en' then lang end as fix, [lang, left(text, 2)] as signs from documents),
m as (
  select a.doc_id, min(b.doc_id) as target from d a join d b on a.source = b.source and trim(a.cause) = trim(b.cause) and a.fix is not distinct from b.fix and list_has_any(a.signs, b.signs)
  where a.doc_id % 2 = 0 and b.doc_id % 2 = 1 and trim(a.cause) <> '' group by a.doc_id
), s as (select doc_id, length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) < 24 as short from d where doc_id % 2 = 0)
select s.doc_id as candidate_id, case when short then 'skipped' when target is not null then 'merged' else 'created' end as decision,
       case when short then 'low-signal' when target is not null then 'merged-into-existing-memory' else 'created-new-memory' end as reason,
       case when not short then target end as target_note_id
from s left join m using (doc_id)""",
    "change_detect": "select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderkey % 5 = 0 or o_orderkey % 7 = 0",
    "upsert_last_wins": """
with n as (select l_orderkey, arg_max(l_extendedprice, l_linenumber) as price from lineitem where l_orderkey % 3 = 0 group by l_orderkey)
select o_orderkey, o_totalprice as price from orders where o_orderkey not in (select l_orderkey from n) union all select l_orderkey, price from n""",
    "insert_ignore": """
with n as (select l_orderkey, arg_min(l_extendedprice, l_linenumber) as price from lineitem group by l_orderkey)
select o_orderkey, o_totalprice as price from orders where o_orderkey % 2 = 0
union all select l_orderkey, price from n where l_orderkey not in (select o_orderkey from orders where o_orderkey % 2 = 0)""",
    "cascade_delete": """
with gone as (select c_custkey from customer where c_acctbal < 0), dead as (select o_orderkey from orders where o_custkey in (select * from gone))
select 'conversations' as name, count(*) as rows from customer where c_custkey not in (select * from gone)
union all select 'messages', count(*) from orders where o_custkey not in (select * from gone)
union all select 'notes', count(*) from orders where o_custkey not in (select * from gone)
union all select 'embeddings', count(*) from lineitem where l_orderkey not in (select * from dead)
union all select 'note_relations', count(*) from orders where o_orderkey not in (select * from dead) and o_orderkey + 1 not in (select * from dead)
union all select 'writeback_receipts', count(*) from orders where o_orderkey not in (select * from dead)""",
}

QUERIES = {
    f.__name__: f
    for f in (
        monotonic_ts, dup_suppress, tool_mark_forward, array_union_order, alias_canonical, alias_union, project_key_sha, merge_decision, change_detect, upsert_last_wins,
        insert_ignore, cascade_delete,
    )
}
