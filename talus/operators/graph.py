"""Relations between notes: listing, creation, discovery, degrees, and the graph export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions.text import round_up_ties
from talus.operators.notes import tags_of_notes
from talus.schemas import RELATIONS
from talus.store import insert_ignore

MOST_RELATIONS = 5
KEY = ["source_note_id", "target_note_id", "relation_type"]


def note_relations(relations: DataFrame, notes: DataFrame, note_id: int) -> DataFrame:
    """Relations of a note in either direction with both titles, most confident first."""
    ends = ("source_note_id", "target_note_id")
    own = relations.where(F.col(ends[0]) == note_id).unionByName(relations.where((F.col(ends[1]) == note_id) & ~F.col(ends[0]).eqNullSafe(F.lit(note_id))))
    for end in ("source", "target"):
        own = own.join(notes.select(F.col("id").alias(f"{end}_note_id"), F.col("title").alias(f"{end}_title")), f"{end}_note_id")
    return own.orderBy(F.desc("confidence"), "id")


def edges_within(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations whose both ends are nodes (id)."""
    for end in ("source_note_id", "target_note_id"):
        relations = relations.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return relations


def edges_of_types(relations: DataFrame, kinds: list[str]) -> DataFrame:
    """Relations of the named types; no type named means all."""
    return relations.where(F.col("relation_type").isin(kinds)) if kinds else relations


def degrees(relations: DataFrame) -> DataFrame:
    """(note_id, degree, size): ends at each note, and how large to draw it."""
    ends = relations.select(F.explode(F.array("source_note_id", "target_note_id")).alias("note_id"))
    return ends.groupBy("note_id").agg(F.count("*").alias("degree")).withColumn("size", F.col("degree") + 2)


def adjacency(relations: DataFrame) -> DataFrame:
    """(note_id, related_ids): neighbours in either direction, repeats kept, in order of the relation."""
    out = relations.select(F.col("source_note_id").alias("note_id"), F.struct("id", F.col("target_note_id").alias("to")).alias("x"))
    back = relations.select(F.col("target_note_id").alias("note_id"), F.struct("id", F.col("source_note_id").alias("to")).alias("x"))
    return out.unionByName(back).groupBy("note_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["to"]).alias("related_ids"))


def without_outgoing(notes: DataFrame, relations: DataFrame) -> DataFrame:
    """Notes that no discovery has started from."""
    return notes.join(relations.select(F.col("source_note_id").alias("id")), "id", "left_anti")


def export(notes: DataFrame, conversations: DataFrame, note_tags: DataFrame, relations: DataFrame, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph view, of one project if named."""
    about = conversations.select(F.col("id").alias("conversation_id"), "project_name")
    nodes = notes.join(about, "conversation_id").select("id", "title", "project_name")
    if project:
        nodes = nodes.where(F.col("project_name") == project)
    tagged = nodes.join(tags_of_notes(note_tags).withColumnRenamed("note_id", "id"), "id", "left")
    return tagged, edges_within(relations, nodes)


def project_colours(nodes: DataFrame, colours: int = 10) -> DataFrame:
    """(project_name, colour): numbered by first appearance in id order, modulo ``colours``."""
    first = nodes.groupBy("project_name").agg(F.min("id").alias("first"))
    return first.select("project_name", ((F.row_number().over(Window.orderBy("first")) - 1) % colours).alias("colour"))


def discovered(proposals: DataFrame, candidates: DataFrame) -> DataFrame:
    """Relations to insert from a model's proposals (source_note_id, target_note_id, relation_type, confidence, position).

    Kept: a known type, a target among the source's candidates, a confidence of 0.5 or more; the first five of a source.
    """
    good = proposals.where(F.col("relation_type").isin(*RELATIONS) & (F.col("confidence") >= 0.5) & (F.col("source_note_id") != F.col("target_note_id")))
    good = good.join(candidates.select("source_note_id", "target_note_id"), ["source_note_id", "target_note_id"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("source_note_id").orderBy("position"))
    return good.withColumn("_n", nth).where(F.col("_n") <= MOST_RELATIONS).drop("_n").withColumn("confidence", round_up_ties(F.col("confidence"), 2))


def add_relations(relations: DataFrame, new: DataFrame) -> DataFrame:
    """relations with those of ``new`` whose ends and type they lack."""
    return insert_ignore(relations, new, KEY)


def create_relation(relations: DataFrame, notes: DataFrame, source: int, target: int, kind: str, description: str | None = None) -> DataFrame:
    """A relation by hand, with confidence 1. Fails for an unknown type, a note with itself, or notes that aren't there."""
    if kind not in RELATIONS:
        raise ValueError(f"unknown relation type: {kind}")
    if source == target:
        raise ValueError("a note has no relation with itself")
    if notes.where(F.col("id").isin(source, target)).select("id").distinct().count() != 2:
        raise LookupError("both notes must exist")
    spark = relations.sparkSession
    new = spark.createDataFrame([(source, target, kind, 1.0, description)], "source_note_id long, target_note_id long, relation_type string, confidence double, description string")
    last = relations.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
    return add_relations(relations, new.withColumn("id", F.lit(last).cast("long")))


def delete_relation(relations: DataFrame, id_: int) -> DataFrame:
    return relations.where(F.col("id") != id_)
