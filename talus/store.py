"""Tables as folders of Parquet: upserts, cascades, change detection, and transactions over several tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def last_of(rows: DataFrame, keys: list[str], order: str, ties: Sequence[str] = ()) -> DataFrame:
    """One row for each key: the one with the largest ``order``, of equal ones that with the smallest ``ties``; null comes last.

    Where ``order`` isn't unique within a key and ``ties`` are not given, reruns may differ.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *ties))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def with_new_ids(rows: DataFrame, key: str, name: str, last: int, buckets: int = 1024) -> DataFrame:
    """rows with ``name``: last + 1, last + 2, ... without gaps, in an order that only the distinct ``key`` decides.

    Ids are counted in two levels, within hash buckets of the key and over the buckets' sizes, so no task sees all rows.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return rows.withColumn("_within", within).join(sizes, "_bucket").withColumn(name, F.lit(last) + F.col("_before") + F.col("_within")).drop("_bucket", "_within", "_before")


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """target with ``rows`` in place of those with the same keys; of several new rows of a key ``last_of`` wins."""
    new = last_of(rows, keys, order, ties).drop(order, *ties) if order else rows.dropDuplicates(keys)
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """target with those rows whose keys it lacks; of several new rows of a key the first by ``order`` (null last), then ``ties``, wins."""
    if order:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last(), *ties))
        rows = rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank", order, *ties)
    else:
        rows = rows.dropDuplicates(keys)
    return target.unionByName(rows.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def changed(found: DataFrame, stored: DataFrame, keys: list[str], marks: list[str]) -> DataFrame:
    """Rows of ``found`` that are new or differ from the stored row in one of ``marks``."""
    old = stored.select(*keys, *(F.col(m).alias(f"_old_{m}") for m in marks), F.lit(True).alias("_stored"))
    differs = F.col("_stored").isNull()
    for m in marks:
        differs = differs | ~F.col(m).eqNullSafe(F.col(f"_old_{m}"))
    return found.join(old, keys, "left").where(differs).select(*found.columns)


def cascade_delete(tables: Mapping[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """All tables without the conversations of ``doomed`` (id) and what hangs on them; receipts lose their note."""
    gone = doomed.select(F.col("id").alias("conversation_id")).distinct()
    notes = tables["notes"].join(gone, "conversation_id", "left_semi").select(F.col("id").alias("note_id"))
    out = dict(tables)
    out["conversations"] = tables["conversations"].join(gone.withColumnRenamed("conversation_id", "id"), "id", "left_anti")
    out["messages"] = tables["messages"].join(gone, "conversation_id", "left_anti")
    out["notes"] = tables["notes"].join(gone, "conversation_id", "left_anti")
    for name in ("note_tags", "embeddings"):
        if name in tables:
            out[name] = tables[name].join(notes, "note_id", "left_anti")
    if "note_relations" in tables:
        edges = tables["note_relations"]
        for end in ("source_note_id", "target_note_id"):
            edges = edges.join(notes.withColumnRenamed("note_id", end), end, "left_anti")
        out["note_relations"] = edges.select(*tables["note_relations"].columns)
    if "writeback_receipts" in tables:
        receipts = tables["writeback_receipts"]
        for column in ("note_id", "merged_into_note_id"):
            dead = notes.select(F.col("note_id").alias("_dead")).distinct()
            receipts = receipts.join(dead, receipts[column] == dead["_dead"], "left")
            receipts = receipts.withColumn(column, F.when(F.col("_dead").isNull(), F.col(column))).drop("_dead")
        out["writeback_receipts"] = receipts.select(*tables["writeback_receipts"].columns)
    return out


#: The folder name of a table's parts.
PART = "_part"
WHOLE = -1


@dataclass(frozen=True)
class Change:
    """New rows of a table, and the keys whose old rows go."""

    rows: DataFrame
    gone: DataFrame
    key: str


class Conflict(RuntimeError):
    """Another writer has committed first what this transaction has read or written; it can be run again."""


#: What a column's type may grow into: a wider type holds every value of the narrower one.
WIDER = {
    "byte": ("short", "integer", "long"), "short": ("integer", "long"), "integer": ("long", "double"), "float": ("double",), "date": ("timestamp_ntz",),
}


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrower of the two types that holds the values of both; raises ValueError where neither does."""
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType), True)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged_schema(a, b)
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale, whole = max(a.scale, b.scale), max(a.precision - a.scale, b.precision - b.scale)
        if scale + whole <= 38:
            return T.DecimalType(scale + whole, scale)
    for low, high in ((a, b), (b, a)):
        if high.typeName() in WIDER.get(low.typeName(), ()):
            return high
    raise ValueError(f"{a.simpleString()} and {b.simpleString()} have no common type")


def merged_schema(old: T.StructType, new: T.StructType) -> T.StructType:
    """Old columns first, then those that are new, by name without regard to case; types are widened by rule."""
    fresh = {f.name.lower(): f for f in new}
    fields = []
    for f in old:
        other = fresh.pop(f.name.lower(), None)
        try:
            fields.append(T.StructField(f.name, f.dataType if other is None else wider(f.dataType, other.dataType), True))
        except ValueError as error:
            raise ValueError(f"column {f.name}: {error}") from None
    return T.StructType(fields + [T.StructField(f.name, f.dataType, True) for f in new if f.name.lower() in fresh])


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns and types of ``schema``; what it lacks is null, in fields of structures too."""
    have = {c.lower(): c for c in df.columns}

    def one(column: Column, old: T.DataType, new: T.DataType) -> Column:
        if isinstance(new, T.StructType) and isinstance(old, T.StructType):
            known = {f.name.lower(): f for f in old}
            fields = [
                (one(column[known[f.name.lower()].name], known[f.name.lower()].dataType, f.dataType) if f.name.lower() in known else F.lit(None).cast(f.dataType)).alias(f.name) for f in new]
            return F.when(column.isNotNull(), F.struct(*fields))
        if isinstance(new, T.ArrayType) and isinstance(old, T.ArrayType) and old != new:
            return F.transform(column, lambda x: one(x, old.elementType, new.elementType))
        return column if old == new else column.cast(new)

    return df.select(*(
        (one(F.col(have[f.name.lower()]), df.schema[have[f.name.lower()]].dataType, f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


@dataclass
class Manifest:
    """What a commit makes current: of each table the version of its parts, the schema each version was written with, and the table's schema."""

    number: int = -1
    versions: dict[str, dict[int, str]] = field(default_factory=dict)
    schemas: dict[str, T.StructType] = field(default_factory=dict)
    written: dict[tuple[str, str], T.StructType] = field(default_factory=dict)

    def copy(self) -> Manifest:
        return Manifest(self.number, {n: dict(p) for n, p in self.versions.items()}, dict(self.schemas), dict(self.written))


class Store:
    """Named tables in a shared folder. A commit writes new versions of some, whole or in part, and then adds one entry to a log.

    An entry's number is the one after the last, and its name is made only where there is none, so of two writers that
    took the same number one fails to make it. That one reads the winner's entry: where they wrote different tables, parts
    or keys its own change goes on top of the winner's, else it raises ``Conflict``. Readers see the last entry as a whole.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = 64):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self._path(self.root)).toUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._never_onto_another = spark.sparkContext._gateway.new_array(rename, 1)
        self._never_onto_another[0] = rename.NONE
        self._open: Transaction | None = None

    def _numbers(self) -> list[int]:
        where = self._path(f"{self.root}/_commits")
        if not self._fs.exists(where):
            return []
        return sorted(int(n) for n in (f.getPath().getName() for f in self._fs.listStatus(where)) if n.isdigit())

    def _manifest(self, number: int | None = None) -> Manifest:
        """The entry of that number, or the last."""
        if number is None:
            number = max(self._numbers(), default=-1)
        out = Manifest(number)
        if number < 0:
            return out
        rows = self.spark.read.schema("name string, part int, version string, schema string").json(f"{self.root}/_commits/{number:08d}").collect()
        for r in rows:
            if r.part is not None:
                out.versions.setdefault(r.name, {})[r.part] = r.version
            elif r.version is not None:
                out.written[r.name, r.version] = T.StructType.fromJson(json.loads(r.schema))
            else:
                out.schemas[r.name] = T.StructType.fromJson(json.loads(r.schema))
                out.versions.setdefault(r.name, {})
        return out

    def _log(self, manifest: Manifest, number: int) -> bool:
        """Make the entry of that number; False where there is one already."""
        used = {(n, v) for n, parts in manifest.versions.items() for v in parts.values()}
        rows = [(n, p, v, None) for n, parts in sorted(manifest.versions.items()) for p, v in sorted(parts.items())]
        rows += [(n, None, None, s.json()) for n, s in sorted(manifest.schemas.items())]
        rows += [(n, None, v, s.json()) for (n, v), s in sorted(manifest.written.items()) if (n, v) in used]
        staged = f"{self.root}/_staged/{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, "name string, part int, version string, schema string").coalesce(1).write.json(staged)
        self._fs.mkdirs(self._path(f"{self.root}/_commits"))
        try:
            self._context.rename(self._path(staged), self._path(f"{self.root}/_commits/{number:08d}"), self._never_onto_another)
        except Py4JJavaError as error:
            self._fs.delete(self._path(staged), True)
            if self._fs.exists(self._path(f"{self.root}/_commits/{number:08d}")):
                return False
            raise error
        return True

    def tables(self) -> list[str]:
        return sorted(self._manifest().versions)

    def _place(self, name: str, part: int, version: str) -> str:
        return f"{self.root}/{name}/{version}" + (f"/{PART}={part}" if part >= 0 else "")

    def _read(self, manifest: Manifest, name: str, parts: set[int] | None = None) -> DataFrame | None:
        """A table, or some of its parts, by its schema; versions that were written with the same columns are one scan."""
        own = manifest.versions.get(name)
        if own is None:
            return None
        by: dict[str, tuple[T.StructType | None, list[str]]] = {}
        for p, v in sorted(own.items()):
            if parts is None or p in parts or p == WHOLE:
                schema = manifest.written.get((name, v))
                by.setdefault(schema.json() if schema else "", (schema, []))[1].append(self._place(name, p, v))
        whole = manifest.schemas.get(name)
        frames = [self.spark.read.schema(s).parquet(*places) if s is not None else self.spark.read.option("mergeSchema", "true").parquet(*places) for s, places in by.values()]
        if not frames:
            return self.spark.createDataFrame([], whole) if whole is not None else None
        if whole is None:
            whole = reduce(merged_schema, (f.schema for f in frames))
        return reduce(DataFrame.unionByName, (conformed(f, whole) for f in frames))

    def read(self, name: str, number: int | None = None) -> DataFrame | None:
        """A table as of the last commit or that of the given number, None where there is none; a table without rows keeps its columns."""
        return self._read(self._manifest(number), name)

    def schema(self, name: str) -> T.StructType | None:
        manifest = self._manifest()
        df = self._read(manifest, name) if name not in manifest.schemas else None
        return manifest.schemas.get(name) or (df.schema if df is not None else None)

    def _part(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.parts)).cast("int")

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """``with store.transaction() as t``: what t writes becomes current at its end, together, or not at all if the block raises.

        One inside another is a savepoint: if the inner block raises, only its writes are undone. Raises ``Conflict`` at
        the outer end if another writer changed a table that t has read, or the same keys, since the transaction began.
        """
        if self._open is not None:
            t = self._open
            kept = t.state()
            try:
                yield t
            except BaseException:
                t.restore(kept)
                raise
            return
        self._open = t = Transaction(self)
        try:
            yield t
            t.end()
        finally:
            self._open = None

    def run(self, work: Callable[[Transaction], Any], attempts: int = 5) -> Any:
        """``work`` in a transaction, once more on what is current now whenever another writer came first."""
        for attempt in range(attempts):
            try:
                with self.transaction() as t:
                    return work(t)
            except Conflict:
                if attempt == attempts - 1 or self._open is not None:
                    raise

    def commit(self, tables: Mapping[str, DataFrame], changes: Mapping[str, Change] | None = None) -> None:
        """Write the given tables and changes and make them current by one entry of the log.

        A table given as a change is kept in parts by a hash of its key, and only those parts are read and written anew
        that the new rows and keys fall in; the other parts are named again as they are. New columns are there for all
        rows of a table, and types are widened; a column whose type can't be is a ValueError, and nothing is committed.
        """
        with self.transaction() as t:
            for name, df in tables.items():
                t.write(name, df)
            for name, change in (changes or {}).items():
                t.change(name, change)

    def vacuum(self) -> int:
        """Remove versions that the newest commit doesn't name, once no reader or writer is at them; how many. The log stays."""
        used = {(n, v) for n, parts in self._manifest().versions.items() for v in parts.values()}
        gone = 0
        for table in self._fs.listStatus(self._path(self.root)):
            name = table.getPath().getName()
            if name.startswith("_"):
                continue
            for version in self._fs.listStatus(table.getPath()):
                if (name, version.getPath().getName()) not in used:
                    self._fs.delete(version.getPath(), True)
                    gone += 1
        return gone


class Transaction:
    """Reads of one state of a store, and writes on top of it that others see only once it ends."""

    def __init__(self, store: Store):
        self._store = store
        self._base = store._manifest()
        self._now = self._base.copy()
        self._seen: set[str] = set()
        self._steps: list[tuple[str, DataFrame | Change, set[int]]] = []

    def state(self) -> tuple:
        return self._now.copy(), len(self._steps)

    def restore(self, state: tuple) -> None:
        """Back to a savepoint. What was read since stays read."""
        self._now = state[0]
        del self._steps[state[1] :]

    def read(self, name: str) -> DataFrame | None:
        """A table as it was when the transaction began, with its own writes. Nobody else may change it until it ends."""
        self._seen.add(name)
        return self._store._read(self._now, name)

    def write(self, name: str, df: DataFrame) -> None:
        """A whole new table in place of the old one, with the old one's columns no longer."""
        version = uuid.uuid4().hex
        df.write.parquet(self._store._place(name, WHOLE, version))
        self._now.versions[name] = {WHOLE: version}
        self._now.schemas[name] = self._now.written[name, version] = _nullable(df.schema)
        self._steps.append((name, df, {WHOLE}))

    def change(self, name: str, change: Change) -> None:
        self._steps.append((name, change, self._apply(self._now, name, change)))

    def _apply(self, manifest: Manifest, name: str, change: Change) -> set[int]:
        """Work a change into a manifest; the parts it wrote."""
        store = self._store
        own, version = manifest.versions.get(name, {}), uuid.uuid4().hex
        rows = change.rows.withColumn(PART, store._part(change.key))
        gone = change.gone.select(change.key).distinct().withColumn(PART, store._part(change.key))
        touched = {r[PART] for r in rows.select(PART).union(gone.select(PART)).distinct().collect()}  # at most as many as there are parts
        schema = _nullable(change.rows.schema)
        if name in manifest.versions:
            old = manifest.schemas.get(name)
            schema = merged_schema(old if old is not None else store._read(manifest, name).schema, schema)
        if WHOLE in own:  # a whole table becomes one of parts
            touched = set(range(store.parts))
        new = conformed(change.rows, schema).withColumn(PART, store._part(change.key))
        if any(p in touched or p == WHOLE for p in own):
            stay = conformed(store._read(manifest, name, touched), schema).join(change.gone.select(change.key).distinct(), change.key, "left_anti").select(*schema.names)
            new = stay.withColumn(PART, store._part(change.key)).unionByName(new)
        place = f"{store.root}/{name}/{version}"
        new.repartition(store.parts, PART).write.partitionBy(PART).parquet(place)
        written = {int(n.split("=")[1]) for n in (f.getPath().getName() for f in store._fs.listStatus(store._path(place)) if f.isDirectory()) if n.startswith(f"{PART}=")}
        manifest.versions[name] = {p: v for p, v in own.items() if p not in touched and p != WHOLE} | dict.fromkeys(written, version)
        manifest.schemas[name] = manifest.written[name, version] = schema
        return touched

    def end(self) -> None:
        """Make the writes current. Without writes there is no entry; reads alone never conflict."""
        while self._steps:
            if self._store._log(self._now, self._base.number + 1):
                return
            self._rebase()

    def _rebase(self) -> None:
        """Put the writes on top of what others have committed meanwhile, or raise Conflict."""
        latest = self._store._manifest()
        for name in self._seen:
            if latest.versions.get(name) != self._base.versions.get(name):
                raise Conflict(f"{name} was read here and changed by another writer")
        now = latest.copy()
        for name, what, parts in self._steps:
            before, after = self._base.versions.get(name), latest.versions.get(name)
            if isinstance(what, DataFrame):
                if before != after:
                    raise Conflict(f"{name} was written whole here and changed by another writer")
                now.versions[name], now.schemas[name] = dict(self._now.versions[name]), self._now.schemas[name]
                now.written |= {k: s for k, s in self._now.written.items() if k[0] == name}
                continue
            if before != after:
                if WHOLE in (before or {}) or WHOLE in (after or {}):
                    raise Conflict(f"{name} was replaced as a whole")
                other = {p for p in parts if (before or {}).get(p) != (after or {}).get(p)}
                if other and self._same_keys_changed(name, what, other, latest):
                    raise Conflict(f"the same keys of {name} were changed by another writer")
            self._apply(now, name, what)
        self._base, self._now = latest, now

    def _same_keys_changed(self, name: str, change: Change, parts: set[int], latest: Manifest) -> bool:
        """Whether the rows of the change's own keys are others now than when the transaction began."""
        keys = change.gone.select(change.key).union(change.rows.select(change.key)).distinct()
        rows = []
        for manifest in (self._base, latest):
            df = self._store._read(manifest, name, parts)
            rows.append(df.join(keys, change.key, "left_semi") if df is not None else None)
        if rows[0] is None or rows[1] is None:
            return any(r is not None and not r.isEmpty() for r in rows)
        columns = [c for c in rows[1].columns if c in rows[0].columns]
        was, now = (r.select(*columns) for r in rows)
        return not now.exceptAll(was).isEmpty() or not was.exceptAll(now).isEmpty()


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
