"""Queries over vectors, relations, notes and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import graph, memory, notes, vectors
from talus.plans.views import chunks, relations, table, vector_notes
from talus.plans.views import notes as document_notes

#: A fixed query vector of the tables' width.
QUERY = [((i * 37 + 11) % 64 - 31.5) / 32 for i in range(64)]
K = 24


def knn_topk(spark, sf_dir):
    return vectors.top_chunks(chunks(spark, sf_dir), QUERY, K).select("note_id", "chunk_index", F.round("score", 6).alias("score"), "rank")


def _titles(spark, sf_dir):
    """The first chunk of every tenth note, as a stated set of queries: those of vectors whose id is divisible by 20."""
    return chunks(spark, sf_dir).where("chunk_index = 0 and note_id % 10 = 0").select(F.col("note_id").alias("query_id"), "vector")


def knn_of_many(spark, sf_dir):
    """The ten chunks nearest to each title, by one scan."""
    return vectors.top_chunks_of_many(chunks(spark, sf_dir), _titles(spark, sf_dir), 10).select("query_id", "note_id", "chunk_index", F.round("score", 6).alias("score"), "rank")


def knn_of_many_indexed(spark, sf_dir):
    """The same by an index that looks at all its lists, which is exact."""
    index = vectors.VectorIndex.build(chunks(spark, sf_dir))
    return index.search(_titles(spark, sf_dir), 10, probes=len(index.centres)).select("query_id", "note_id", "chunk_index", F.round("score", 6).alias("score"), "rank")


def knn_dedupe(spark, sf_dir):
    hits = vectors.direct_hits(vectors.top_chunks(chunks(spark, sf_dir), QUERY, K), vector_notes(spark, sf_dir))
    return hits.select("note_id", "chunk_index", F.round("score", 6).alias("score"), "rank")


def knn_expand(spark, sf_dir):
    known = vector_notes(spark, sf_dir)
    direct = vectors.direct_hits(vectors.top_chunks(chunks(spark, sf_dir), QUERY, K), known).withColumn("score", F.round("score", 6))
    return vectors.expand(direct, relations(spark, sf_dir), known).select("note_id", "score", "via_relation")


def recall_buckets(spark, sf_dir):
    known = vector_notes(spark, sf_dir)
    hits = vectors.direct_hits(vectors.top_chunks(chunks(spark, sf_dir), QUERY, memory.recall_size(5, 3)), known)
    hits = hits.withColumn("title", F.lit("")).withColumn("via_relation", F.lit(None).cast("string"))
    empty = F.lit(None).cast("array<string>")
    about = known.select(
        F.col("id").alias("note_id"), F.concat(F.lit("note "), F.col("id")).alias("title"), F.lit("").alias("summary"), F.concat(F.lit("key"), F.col("label") % 2).alias("project_key"),
        F.when(F.col("label") % 3 == 0, "global").when(F.col("label") % 3 == 1, "project").alias("scope"), F.lit("fix").alias("outcome_type"), empty.alias("pitfalls"), empty.alias("reusable_patterns"),
    )
    keys = spark.range(1).select(F.lit("key1").alias("project_key"))
    rows = memory.recall(hits, about, relations(spark, sf_dir), keys, 5, 3)
    return rows.select("bucket", "position", "note_id", "title", "summary", F.size("related_note_ids").cast("long").alias("related"))


def _memories(spark, sf_dir):
    empty = F.lit(None).cast("array<string>")
    scope = F.when(F.col("label") % 3 == 0, "global").when(F.col("label") % 3 == 1, "project")
    return vector_notes(spark, sf_dir).select(
        F.col("id").alias("note_id"), F.concat(F.lit("note "), F.col("id")).alias("title"), F.lit("").alias("summary"), F.concat(F.lit("key"), F.col("id") % 4).alias("project_key"),
        scope.alias("scope"), F.lit("fix").alias("outcome_type"), empty.alias("pitfalls"), empty.alias("reusable_patterns"),
    )


def _recalled(spark, sf_dir):
    """Every tenth note asks for its first chunk; one in seven of them has no project. key3 is another name of key1."""
    key = F.when(F.col("query_id") % 70 != 0, F.concat(F.lit("key"), (F.col("query_id") / 10).cast("long") % 4))
    tasks = _titles(spark, sf_dir).select("query_id", "vector", key.alias("project_key"))
    aliases = spark.range(1).select(F.lit("key3").alias("alias_key"), F.lit("key1").alias("canonical_key"))
    known = vector_notes(spark, sf_dir).withColumn("title", F.lit(""))
    return memory.recall_many(tasks, chunks(spark, sf_dir), known, _memories(spark, sf_dir), relations(spark, sf_dir), aliases)


def recall_of_many(spark, sf_dir):
    """What each task recalls, found for all tasks at once."""
    return _recalled(spark, sf_dir)[0].select(
        "query_id", "bucket", "position", "note_id", "title", "summary", F.size("related_note_ids").cast("long").alias("related"), F.round("score", 6).alias("score"), "why_relevant")


def recall_reasons(spark, sf_dir):
    """Why each task got what it got."""
    return _recalled(spark, sf_dir)[1]


def graph_degree(spark, sf_dir):
    return graph.degrees(relations(spark, sf_dir))


def graph_edges_filtered(spark, sf_dir):
    nodes = vector_notes(spark, sf_dir).where("embedding_status = 'done'").select("id")
    return graph.edges_within(relations(spark, sf_dir), nodes).select("id", "source_note_id", "target_note_id", "relation_type", F.round("confidence", 6).alias("confidence"))


def neighbours_bidir(spark, sf_dir):
    rows = graph.adjacency(relations(spark, sf_dir))
    return rows.select("note_id", F.array_join(F.transform("related_ids", lambda x: x.cast("string")), ",").alias("related"))


def no_outgoing_anti(spark, sf_dir):
    return graph.without_outgoing(vector_notes(spark, sf_dir).select("id"), relations(spark, sf_dir).where("confidence > 0.85"))


def project_colours(spark, sf_dir):
    return graph.project_colours(document_notes(spark, sf_dir))


def _note_tags(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    more = d.where(F.col("n_chars") > 2000).select(F.col("doc_id").alias("note_id"), F.lit("long").alias("tag"))
    return d.select(F.col("doc_id").alias("note_id"), F.col("lang").alias("tag")).unionByName(more)


def tag_counts(spark, sf_dir):
    pairs = _note_tags(spark, sf_dir)
    unused = spark.range(1).select(F.lit("unused").alias("tag"))
    return notes.tag_counts(pairs.select("tag").distinct().union(unused), pairs)


def tag_semi(spark, sf_dir):
    rows = notes.note_filter(document_notes(spark, sf_dir), _note_tags(spark, sf_dir), tag="long", search="THE%of")
    return rows.select("id", "project_name")


def note_tags_array(spark, sf_dir):
    rows = notes.tags_of_notes(_note_tags(spark, sf_dir))
    return rows.select("note_id", F.array_join("tags", " ").alias("tags"))


def paged_notes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("title"))
    return notes.page(orders, "created_at", "id", offset=40, limit=200)


def notes_page_behind(spark, sf_dir):
    """The second page, from the last row of the first."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("title"))
    first = notes.page_behind(orders, "created_at", "id", limit=100)
    last = first.orderBy(F.col("created_at").asc_nulls_first(), F.desc("id")).select("created_at", "id").first()
    return notes.page_behind(orders, "created_at", "id", last and tuple(last), limit=100)


def latest_n(spark, sf_dir):
    return notes.page(document_notes(spark, sf_dir), "n_chars", "id", limit=5).select("id", "n_chars")


def status_summary(spark, sf_dir):
    conversations = document_notes(spark, sf_dir).select(F.concat(F.when(F.col("id") % 9 == 0, "demo-").otherwise("real-"), F.col("id")).alias("id"))
    tags = table(spark, sf_dir, "documents").select("lang").distinct()
    return notes.status_summary(conversations, document_notes(spark, sf_dir), tags)


def embedding_texts(spark, sf_dir):
    rows = document_notes(spark, sf_dir).select(
        "id", "title", "project_name", F.array(F.concat(F.lit("about "), "project_name"), F.col("tag")).alias("key_conclusions"),
        F.array(F.struct(F.lit("sql").alias("language"), F.lit("x").alias("code"), F.concat(F.lit("how "), "tag").alias("description"))).alias("code_snippets"),
    ).withColumn("summary", F.col("project_name"))
    return notes.embedding_text(rows, _note_tags(spark, sf_dir))


def _literal(values: list[float]) -> str:
    return "[" + ", ".join(repr(x) for x in values) + "]::double[]"


VECTORS = f"""
with c as (
  select cast(floor(vec_id / 2) as bigint) as note_id, cast(vec_id % 2 as int) as chunk_index, list_cosine_similarity(embedding::double[], {_literal(QUERY)}) as score from embeddings
), hits as (
  select *, row_number() over (order by score desc, note_id, chunk_index) as rank from c qualify rank <= {K}
), known as (
  select cast(floor(vec_id / 2) as bigint) as id, min(label) as label, case when cast(floor(vec_id / 2) as bigint) % 7 = 3 then 'pending' else 'done' end as embedding_status
  from embeddings group by 1
), best as (
  select h.*, min(rank) over (partition by note_id) as first, row_number() over (partition by note_id order by score desc, rank) as nth
  from hits h where note_id in (select id from known where embedding_status = 'done')
), direct as (
  select note_id, chunk_index, score, row_number() over (order by first) as rank from best where nth = 1
), relations as (
  select id * 2 + k as id, id as source_note_id, (id * (case when k = 0 then 3 else 5 end) + 7 + k) % (select max(id) + 1 from known) as target_note_id,
         case when k = 0 then 'SIMILAR_TO' else 'LEADS_TO' end as relation_type, 0.4::double + (id % 6) / 10.0::double as confidence
  from known, (values (0), (1)) as v(k)
), ways as (
  select id as relation_id, source_note_id as note_id, target_note_id as linked_id, relation_type, confidence from relations
  union all select id, target_note_id, source_note_id, relation_type, confidence from relations
)
"""

TAGS = """
with bridge as (
  select doc_id as note_id, lang as tag from documents union all select doc_id, 'long' from documents where n_chars > 2000
)
"""

_MANY = """
with v as (select vec_id // 2 as note_id, (vec_id % 2)::int as chunk_index, embedding::double[] as x from embeddings),
q as (select note_id as query_id, x from v where chunk_index = 0 and note_id % 10 = 0),
s as (select query_id, note_id, chunk_index, coalesce(list_dot_product(q.x, v.x) / nullif(sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(v.x, v.x)), 0), 0) as score from q, v)
select query_id, note_id, chunk_index, round(score, 6) as score, (row_number() over (partition by query_id order by score desc, note_id, chunk_index))::int as rank from s qualify rank <= 10"""

# What tasks recall: the search of each with its expansion, then buckets of memories.
_RECALLED = """
with v as (select vec_id // 2 as note_id, (vec_id % 2)::int as chunk_index, embedding::double[] as x from embeddings),
known as (select vec_id // 2 as id, min(label) as label, case when vec_id // 2 % 7 = 3 then 'pending' else 'done' end as embedding_status from embeddings group by 1, 3),
tasks as (select note_id as query_id, x, case when note_id % 70 <> 0 then 'key' || (note_id // 10 % 4) end as project_key from v where chunk_index = 0 and note_id % 10 = 0),
scored as (
  select query_id, note_id, chunk_index, coalesce(list_dot_product(q.x, v.x) / nullif(sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(v.x, v.x)), 0), 0) as score
  from tasks q, v
), hits as (
  select *, row_number() over (partition by query_id order by score desc, note_id, chunk_index) as rank from scored qualify rank <= 24
), best as (
  select h.*, min(rank) over (partition by query_id, note_id) as first, row_number() over (partition by query_id, note_id order by score desc, rank) as nth
  from hits h where note_id in (select id from known where embedding_status = 'done')
), direct as (
  select query_id, note_id, chunk_index, score, row_number() over (partition by query_id order by first) as rank from best where nth = 1
), relations as (
  select id * 2 + k as id, id as source_note_id, (id * (case when k = 0 then 3 else 5 end) + 7 + k) % (select max(id) + 1 from known) as target_note_id,
         case when k = 0 then 'SIMILAR_TO' else 'LEADS_TO' end as relation_type, 0.4::double + (id % 6) / 10.0::double as confidence
  from known, (values (0), (1)) as v(k)
), ways as (
  select id as relation_id, source_note_id as note_id, target_note_id as linked_id, relation_type, confidence from relations
  union all select id, target_note_id, source_note_id, relation_type, confidence from relations
), near as (
  select query_id, linked_id, floor(score * 0.7::double * confidence * 1000 + 0.5) / 1000 as score, relation_type, row_number() over (partition by query_id, linked_id order by rank, relation_id) as nth
  from direct d join ways using (note_id) where confidence >= 0.5 and linked_id in (select id from known where embedding_status = 'done')
    and not exists (select 1 from direct e where e.query_id = d.query_id and e.note_id = linked_id)
), found as (
  select query_id, note_id, score, null as via, 'chunk ' || (note_id * 2 + chunk_index) as text from direct
  union all select query_id, linked_id, score, relation_type, '' from near where nth = 1
), b as (
  select found.*, case when label % 3 = 0 then 'global' when t.project_key = 'key' || (note_id % 4) or (t.project_key = 'key1' and note_id % 4 = 3) or (t.project_key = 'key3' and note_id % 4 = 1) then 'project' end as bucket
  from found join known on id = note_id join tasks t using (query_id)
), ranked as (select *, (row_number() over (partition by query_id, bucket order by score desc, note_id))::int as position from b where bucket is not null
), kept as (select * from ranked where position <= case when bucket = 'project' then 5 else 3 end)
"""

ORACLE = {
    "recall_of_many": _RECALLED + """
select query_id, bucket, position, note_id, 'note ' || note_id as title, text as summary, (select count(*) from ways w where w.note_id = kept.note_id) as related,
       round(score, 6) as score, coalesce('Matched via relation ' || via, 'Matched by semantic similarity') as why_relevant from kept""",
    "recall_reasons": _RECALLED + """
select query_id, case when project_key is null then 'no-project-key' when query_id in (select query_id from kept) then 'ok' else 'no-matches' end as reason from tasks""",
    "knn_topk": VECTORS + "select note_id, chunk_index, round(score, 6) as score, rank from hits",
    "knn_of_many": _MANY,
    "knn_of_many_indexed": _MANY,
    "knn_dedupe": VECTORS + "select note_id, chunk_index, round(score, 6) as score, rank from direct",
    "knn_expand": VECTORS + """
, near as (
  select linked_id, floor(round(d.score, 6) * 0.7::double * confidence * 1000 + 0.5) / 1000 as score, relation_type, row_number() over (partition by linked_id order by d.rank, relation_id) as nth
  from direct d join ways using (note_id) where confidence >= 0.5 and linked_id in (select id from known where embedding_status = 'done') and linked_id not in (select note_id from direct)
)
select note_id, round(score, 6) as score, null as via_relation from direct union all select linked_id, score, relation_type from near where nth = 1""",
    "recall_buckets": VECTORS + """
, b as (
  select d.note_id, d.chunk_index, rank, case when coalesce(case when label % 3 = 0 then 'global' when label % 3 = 1 then 'project' end, 'project') = 'global' then 'global'
         when label % 2 = 1 then 'project' end as bucket from direct d join known on id = d.note_id
), p as (select *, row_number() over (partition by bucket order by rank) as position from b where bucket is not null),
near as (select * from relations where source_note_id in (select note_id from direct) or target_note_id in (select note_id from direct))
select bucket, position, note_id, 'note ' || note_id as title, 'chunk ' || (note_id * 2 + chunk_index) as summary,
       (select count(*) from near where source_note_id = p.note_id) + (select count(*) from near where target_note_id = p.note_id) as related
from p where position <= case when bucket = 'project' then 5 else 3 end""",
    "graph_degree": VECTORS + "select note_id, count(*) as degree, count(*) + 2 as size from ways group by note_id",
    "graph_edges_filtered": VECTORS + """
select id, source_note_id, target_note_id, relation_type, round(confidence, 6) as confidence from relations
where source_note_id in (select id from known where embedding_status = 'done') and target_note_id in (select id from known where embedding_status = 'done')""",
    "neighbours_bidir": VECTORS + "select note_id, string_agg(cast(linked_id as varchar), ',' order by relation_id, linked_id) as related from ways group by note_id",
    "no_outgoing_anti": VECTORS + "select id from known where id not in (select source_note_id from relations where confidence > 0.85)",
    "project_colours": """
with f as (select source as project_name, min(doc_id) as first from documents group by source)
select project_name, cast((row_number() over (order by first) - 1) % 10 as int) as colour from f""",
    "tag_counts": TAGS + "select t.tag, count(b.note_id) as notes from (select distinct tag from bridge union select 'unused') t left join bridge b using (tag) group by t.tag",
    "tag_semi": TAGS + """
select doc_id as id, source as project_name from documents
where doc_id in (select note_id from bridge where tag = 'long') and (left(text, 40) ilike '%THE%of%' or text ilike '%THE%of%')""",
    "note_tags_array": TAGS + "select note_id, string_agg(tag, ' ' order by tag) as tags from bridge group by note_id",
    "paged_notes": "select o_orderkey as id, o_orderdate as created_at, o_orderpriority as title from orders order by o_orderdate desc nulls last, o_orderkey limit 100 offset 40",
    "notes_page_behind": "select o_orderkey as id, o_orderdate as created_at, o_orderpriority as title from orders order by o_orderdate desc nulls last, o_orderkey limit 100 offset 100",
    "latest_n": "select doc_id as id, n_chars from documents order by n_chars desc nulls last, doc_id limit 5",
    "status_summary": """
select count(*) as conversations, count(*) filter (doc_id % 9 <> 0) as real_conversations, count(*) as notes, (select count(distinct lang) from documents) as tags,
       count(*) > 0 and count(*) filter (doc_id % 9 <> 0) = 0 as is_seeded from documents""",
    "embedding_texts": TAGS + """
, t as (select note_id, string_agg(tag, ' ' order by tag) as tags from bridge group by note_id)
select doc_id as note_id, array_to_string([left(text, 40), source, 'about ' || source || chr(10) || lang, tags, 'how ' || lang], chr(10) || chr(10)) as text
from documents join t on note_id = doc_id""",
}

QUERIES = {
    f.__name__: f
    for f in (
        knn_topk, knn_of_many, knn_of_many_indexed, knn_dedupe, knn_expand, recall_buckets, recall_of_many, recall_reasons, graph_degree, graph_edges_filtered, neighbours_bidir, no_outgoing_anti, project_colours, tag_counts, tag_semi,
        note_tags_array, paged_notes, notes_page_behind, latest_n, status_summary, embedding_texts,
    )
}
