"""Named tables: where a data set lies, how it is read and what is known about it. Nothing is fetched or cached."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import readers


@dataclass(frozen=True)
class Entry:
    path: str
    kind: str = "parquet"
    about: dict[str, str] = field(default_factory=dict)


class Catalogue:
    """Data sets by name. Kinds: parquet, csv (with header), tsv (with header), mtx, tenx (a folder), bnet, edges."""

    kinds = ("parquet", "csv", "tsv", "mtx", "tenx", "bnet", "edges")

    def __init__(self) -> None:
        self.entries: dict[str, Entry] = {}

    def register(self, name: str, path: str, kind: str = "parquet", **about: str) -> None:
        if kind not in self.kinds:
            raise ValueError(f"kind: one of {self.kinds}")
        self.entries[name] = Entry(path, kind, about)

    def available(self) -> list[str]:
        return sorted(self.entries)

    def info(self, name: str) -> dict[str, str]:
        e = self._entry(name)
        return {"name": name, "path": e.path, "kind": e.kind, **e.about}

    def clear(self, name: str | None = None) -> None:
        """Forgets one data set, or all; files stay."""
        if name is None:
            self.entries.clear()
        else:
            del self.entries[name]

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        e = self._entry(name)
        if e.kind == "parquet":
            return spark.read.parquet(e.path)
        if e.kind in ("csv", "tsv"):
            return spark.read.option("header", True).option("sep", {"csv": ",", "tsv": "\t"}[e.kind]).csv(e.path)
        return {"mtx": readers.read_mtx, "tenx": readers.read_10x, "bnet": readers.read_bnet, "edges": readers.read_influence_graph}[e.kind](spark, e.path)

    def _entry(self, name: str) -> Entry:
        if name not in self.entries:
            raise KeyError(f"{name}; available: {self.available()}")
        return self.entries[name]
