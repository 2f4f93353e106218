"""Pinned Parquet sources: a manifest of files, their schemas, and verified scans."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.errors import SourceError

#: Files up to this size are hashed by Spark, larger ones in blocks on the driver.
_SPARK_HASH_BYTES = 1 << 30


@dataclass(frozen=True)
class SourceFile:
    config: str
    split: str
    path: str
    rows: int
    columns: int
    size_bytes: int
    sha256: str


@dataclass(frozen=True)
class SourceManifest:
    dataset_id: str
    revision: str
    modified_at: str
    schema_snapshot: str
    resolve_base: str
    files: tuple[SourceFile, ...]

    @property
    def name(self) -> str:
        """Short name of the dataset, lower-case."""
        return self.dataset_id.rsplit("/", 1)[-1].lower()

    def file_for(self, config: str, split: str) -> SourceFile:
        for file in self.files:
            if (file.config, file.split) == (config, split):
                return file
        raise SourceError(f"manifest has no file for {config}/{split}")

    def smallest(self) -> SourceFile:
        return min(self.files, key=lambda f: (f.size_bytes, f.path))


def _read_json(path: Path) -> dict:
    try:
        value = json.loads(path.read_text("utf-8"))
    except (OSError, ValueError) as error:
        raise SourceError(f"could not read {path}: {error}") from error
    if not isinstance(value, dict):
        raise SourceError(f"{path} must hold an object")
    return value


def _take(value: dict, name: str, kind: type, where: str):
    found = value.get(name)
    if not isinstance(found, kind) or isinstance(found, bool) or (kind is str and not found) or (kind is int and found < 0):
        raise SourceError(f"{where}.{name} must be a valid {kind.__name__}")
    return found


def safe_relative(path: str) -> str:
    """A relative path that stays where it is put."""
    pure = PurePosixPath(path)
    if pure.is_absolute() or ".." in pure.parts or not pure.parts:
        raise SourceError(f"path must be relative and stay inside its root: {path}")
    return path


def load_manifest(path: Path) -> SourceManifest:
    raw = _read_json(path)
    files: list[SourceFile] = []
    seen: set[tuple[str, str]] = set()
    for i, item in enumerate(_take(raw, "files", list, "manifest")):
        where = f"manifest.files[{i}]"
        if not isinstance(item, dict):
            raise SourceError(f"{where} must be an object")
        file = SourceFile(*(_take(item, n, str, where) for n in ("config", "split", "path")), *(_take(item, n, int, where) for n in ("rows", "columns", "size_bytes")), _take(item, "sha256", str, where))
        safe_relative(file.path)
        if (file.config, file.split) in seen:
            raise SourceError(f"duplicate manifest config/split: {file.config}/{file.split}")
        seen.add((file.config, file.split))
        files.append(file)
    if not files:
        raise SourceError("manifest.files must not be empty")
    base = _take(_take(raw, "source_urls", dict, "manifest"), "resolve_base", str, "manifest.source_urls")
    modified = raw.get("revision_last_modified_utc", "")
    return SourceManifest(_take(raw, "dataset_id", str, "manifest"), _take(raw, "revision", str, "manifest"), modified, safe_relative(_take(raw, "schema_snapshot", str, "manifest")), base, tuple(files))


def load_schemas(path: Path) -> dict[str, tuple[tuple[str, str], ...]]:
    """Ordered ``(name, type)`` of every configuration's fields."""
    out: dict[str, tuple[tuple[str, str], ...]] = {}
    for config in _take(_read_json(path), "configs", list, "schema"):
        name = _take(config, "name", str, "schema.configs")
        if name in out:
            raise SourceError(f"duplicate schema config: {name}")
        fields = [(_take(f, "name", str, name), _take(f, "type", str, name)) for f in _take(config, "fields", list, name)]
        if len({n for n, _ in fields}) < len(fields):
            raise SourceError(f"duplicate field in schema {name}")
        out[name] = tuple(fields)
    return out


#: Arrow names of source types and what Spark calls them.
_SPARK_NAMES = {"string": "string", "large_string": "string", "int64": "bigint", "int32": "int", "int8": "tinyint", "float64": "double", "double": "double", "float": "float", "bool": "boolean"}


def spark_type(arrow: str) -> str:
    """Spark's name of a source type; lists of text in any spelling are arrays of text."""
    if arrow.startswith(("list", "large_list")) and "string" in arrow:
        return "array<string>"
    return _SPARK_NAMES.get(arrow, arrow)


class PinnedSource:
    """Verified scans of the files that a manifest pins."""

    def __init__(self, spark: SparkSession, data_root: Path, manifest: SourceManifest, schemas: dict[str, tuple[tuple[str, str], ...]]):
        self.spark, self.data_root, self.manifest, self.schemas = spark, data_root.resolve(), manifest, schemas
        self._verified: set[str] = set()

    @classmethod
    def from_manifest(cls, spark: SparkSession, data_root: Path, manifest_path: Path) -> PinnedSource:
        manifest = load_manifest(manifest_path)
        return cls(spark, data_root, manifest, load_schemas(manifest_path.parent / Path(manifest.schema_snapshot).name))

    def local_path(self, config: str, split: str) -> Path:
        path = (self.data_root / self.manifest.file_for(config, split).path).resolve()
        if not path.is_relative_to(self.data_root):
            raise SourceError(f"path escapes the data root: {path}")
        return path

    def verify_file(self, config: str, split: str) -> Path:
        """Check that a file exists with the pinned size and hash."""
        file, path = self.manifest.file_for(config, split), self.local_path(config, split)
        if not path.is_file():
            raise SourceError(f"missing source file: {path}")
        if path.stat().st_size != file.size_bytes:
            raise SourceError(f"size mismatch for {path}: {path.stat().st_size} instead of {file.size_bytes}")
        if file.size_bytes <= _SPARK_HASH_BYTES:
            digest = self.spark.read.format("binaryFile").load(str(path)).select(F.sha2("content", 256)).first()[0]
        else:
            with path.open("rb") as handle:
                digest = hashlib.file_digest(handle, "sha256").hexdigest()
        if digest != file.sha256:
            raise SourceError(f"SHA-256 mismatch for {path}")
        return path

    def scan(self, config: str, split: str, verify: bool = True) -> DataFrame:
        """The file's columns and ``_row_index``, each row's place in it.

        The hash is checked once a source, the schema and the row count from
        the footer always; only columns that are used later are read.
        """
        path = str(self.local_path(config, split))
        if verify and path not in self._verified:
            self.verify_file(config, split)
            self._verified.add(path)
        rows = self.spark.read.parquet(path)
        if config in self.schemas:
            expected = [(n, spark_type(t)) for n, t in self.schemas[config]]
            if [n for n, _ in rows.dtypes] != [n for n, _ in expected]:
                raise SourceError(f"column mismatch in {path}: {rows.columns}")
            if rows.dtypes != expected:
                raise SourceError(f"type mismatch in {path}: {rows.dtypes}")
        if rows.count() != self.manifest.file_for(config, split).rows:
            raise SourceError(f"row count mismatch in {path}")
        return rows.select("*", F.col("_metadata.row_index").alias("_row_index"))


def read_jsonl(spark: SparkSession, path: str, schema: str, allow_empty: bool = True) -> DataFrame:
    """Objects, one a line; a blank line or a line that is no object is an error, an empty file may be one."""
    lines = spark.read.text(path)
    counts = lines.agg(F.count("*").alias("n"), F.count_if(F.trim("value") == "").alias("blank"), F.count_if(~F.trim("value").startswith("{")).alias("other")).first()
    if counts["blank"]:
        raise SourceError(f"{path} holds blank lines")
    if counts["other"]:
        raise SourceError(f"{path} holds lines that are no JSON object")
    if not counts["n"] and not allow_empty:
        raise SourceError(f"{path} is empty")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
