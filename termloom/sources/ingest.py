"""Configured ingest of any DataFrame into an index."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions.encoders import Encoder, LexicalEncoder
from termloom.plans.positions import with_positions
from termloom.schema import METADATA, metadata_string
from termloom.sources.store import DEFAULT_SHARD_MB, SparseIndex

READERS = ("parquet", "json", "csv", "text", "orc")


def _strings(df: DataFrame, names: list[str]) -> dict[str, Column]:
    types = {f.name: f.dataType for f in df.schema}
    return {n: metadata_string(F.col(n), types[n]) for n in names if n in types}


def doc_id(df: DataFrame, text_columns: list[str], id_column: str | None = None, position: str = "ordinal") -> Column:
    """The configured id column, else ``doc_<position>_<16 hex digits of SHA-256>`` of the text
    columns put together; a missing column counts as empty, a null as ``None``."""
    if id_column and id_column in df.columns:
        return F.coalesce(*_strings(df, [id_column]).values(), F.lit("None"))
    parts = [F.coalesce(c, F.lit("None")) for c in _strings(df, text_columns).values()]
    content = F.concat(*parts) if parts else F.lit("")
    return F.concat(F.lit("doc_"), F.col(position).cast("string"), F.lit("_"), F.substring(F.sha2(content, 256), 1, 16))


def text_of(df: DataFrame, text_columns: list[str], separator: str = " ") -> Column:
    """The text columns joined; null, empty, zero and false ones are skipped."""
    types, parts = {f.name: f.dataType for f in df.schema}, []
    for name, value in _strings(df, text_columns).items():
        kind = types[name]
        if isinstance(kind, T.NumericType):
            value = F.when(F.col(name) != 0, value)
        elif isinstance(kind, T.BooleanType):
            value = F.when(F.col(name), value)
        else:
            value = F.nullif(value, F.lit(""))
        parts.append(value)
    return F.concat_ws(separator, *parts) if parts else F.lit("")


def metadata_of(df: DataFrame, columns: list[str]) -> Column:
    """The chosen columns as strings, without nulls."""
    pairs = [x for n, c in _strings(df, columns).items() for x in (F.lit(n), c)]
    return F.map_filter(F.create_map(*pairs).cast(METADATA), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast(METADATA)


class DatasetIngest:
    """A job: ``dataset`` (format, path, options or split), ``text_columns``, ``metadata_columns``,
    ``id_column``, ``separator``, and ``index`` (path, shard_size_mb)."""

    def __init__(self, spark: SparkSession, config: dict | str, encoder: Encoder | None = None) -> None:
        self.spark = spark
        if isinstance(config, str):
            with open(config) as lines:
                text = lines.read()
            try:
                config = json.loads(text)
            except ValueError:
                config = parse_yaml(text)
        self.config, self.encoder = config, encoder or LexicalEncoder()
        index = config.get("index") or {}
        self.index_path = index.get("path", "./index")
        self.shard_size_mb = index.get("shard_size_mb", DEFAULT_SHARD_MB)

    def source(self) -> DataFrame:
        chosen = self.config["dataset"]
        kind = chosen.get("format", "parquet")
        if kind not in READERS:
            raise ValueError(f"unknown format {kind!r}")
        return self.spark.read.format(kind).options(**(chosen.get("options") or {})).load(chosen["path"])

    def rows(self, source: DataFrame, max_docs: int | None = None) -> DataFrame:
        """(doc_id, text, metadata): one projection, after the rows are numbered in order."""
        columns = self.config["text_columns"]
        if max_docs:
            source = source.limit(max_docs)
        numbered = with_positions(source, "__position")
        key = doc_id(numbered, columns, self.config.get("id_column"), "__position")
        text = text_of(numbered, columns, self.config.get("separator", " "))
        return numbered.select(key.alias("doc_id"), text.alias("text"), metadata_of(numbered, self.config.get("metadata_columns") or []).alias("metadata"))

    def ingest(self, batch_size: int = 100, max_docs: int | None = None, resume: bool = False, source: DataFrame | None = None) -> dict:
        """Add the source to the index in one job and return its stats.  ``resume`` leaves out ids
        that the index holds already; ``batch_size`` is Arrow's where the encoder uses it."""
        with SparseIndex(self.spark, self.index_path, self.shard_size_mb) as index:
            docs = self.rows(self.source() if source is None else source, max_docs)
            if resume:
                docs = docs.join(index.snapshot().live(with_text=False).select("doc_id"), "doc_id", "left_anti")
            index.add_encoded(docs, self.encoder)
            return index.stats()


def parse_yaml(text: str) -> dict:
    """The subset of YAML that job files use: nested maps, lists of scalars, plain scalars."""

    def scalar(value: str):
        value = value.strip()
        if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1:
            return value[1:-1]
        value = value.split(" #")[0].strip()
        known = {"null": None, "~": None, "": None, "true": True, "false": False}
        if value.lower() in known:
            return known[value.lower()]
        for cast in (int, float):
            try:
                return cast(value)
            except ValueError:
                pass
        return value

    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]

    def block(at: int, indent: int) -> tuple[object, int]:
        if lines[at][1].startswith("- "):
            items = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("- "):
                items.append(scalar(lines[at][1][2:]))
                at += 1
            return items, at
        found: dict = {}
        while at < len(lines) and lines[at][0] == indent:
            key, _, value = lines[at][1].partition(":")
            at += 1
            nested = at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- ")))
            if value.strip() or not nested:
                found[key.strip()] = scalar(value)
            else:
                found[key.strip()], at = block(at, lines[at][0])
        return found, at

    return block(0, lines[0][0])[0] if lines else {}


def tombstones_from_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id) of a text file with one id per line: stripped, blank lines dropped, each once."""
    ids = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("doc_id"))
    return ids.where("doc_id != ''").distinct()
