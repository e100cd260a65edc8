"""Settings: which sources are read, which models are used; kept as one JSON file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.schemas import CONVERSATION, MESSAGE, NOTE, ensure_columns
from talus.sources.registry import readers
from talus.store import Store

SECRETS = ("api_key",)


@dataclass(frozen=True)
class Config:
    enabled_sources: tuple[str, ...] = field(default_factory=lambda: tuple(readers()))
    known_sources: tuple[str, ...] = field(default_factory=lambda: tuple(readers()))
    embedder: str = "hashing"
    embedder_options: dict = field(default_factory=dict)
    max_input_chars: int = 32_000

    @classmethod
    def load(cls, path: str) -> Config:
        """From a file, or defaults. Sources that are new since it was written are enabled; those switched off stay off."""
        file = Path(path)
        if not file.exists():
            return cls()
        kept = json.loads(file.read_text())
        old = cls(**{f.name: tuple(v) if isinstance(v := kept[f.name], list) else v for f in fields(cls) if f.name in kept})
        known = tuple(kept.get("known_sources", kept.get("enabled_sources", ())))
        fresh = tuple(s for s in readers() if s not in known)
        return replace(old, enabled_sources=(*old.enabled_sources, *(s for s in fresh if s not in old.enabled_sources)), known_sources=(*known, *fresh))

    def save(self, path: str) -> None:
        file = Path(path)
        staged = file.with_suffix(".new")
        staged.write_text(json.dumps(asdict(self), indent=1))
        staged.replace(file)

    def shown(self) -> dict:
        """For display: secrets only as whether they are set."""
        options = {k: v for k, v in self.embedder_options.items() if k not in SECRETS}
        return asdict(self) | {"embedder_options": options | {f"has_{s}": bool(self.embedder_options.get(s)) for s in SECRETS}}

    def enabled(self, metas: DataFrame) -> DataFrame:
        return metas.where(F.col("source").isin(*self.enabled_sources))


def seed(spark: SparkSession, store: Store, path: str) -> bool:
    """Load demo rows (conversations, messages, notes of one JSON file) into a store without conversations."""
    have = store.read("conversations")
    if have is not None and not have.isEmpty():
        return False
    rows = spark.read.option("multiLine", "true").json(path)
    tables = {}
    for name, schema in (("conversations", CONVERSATION), ("messages", MESSAGE), ("notes", NOTE)):
        if name in rows.columns:
            tables[name] = ensure_columns(rows.select(F.explode(name).alias("x")).select("x.*"), schema).select(*schema.names)
    store.commit(tables)
    return True
