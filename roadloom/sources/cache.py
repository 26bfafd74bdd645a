"""A prepared road graph on disk: Parquet tables beside the version and the digest of the file they were made of."""

from __future__ import annotations

import hashlib
import json
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

VERSION = 1
TABLES = ("nodes", "lines", "restrictions", "degrees")


def digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write(folder: str, source: str, tables: dict[str, DataFrame]) -> None:
    """Write all tables to a new folder, then put it in the old one's place, so that a cache is whole or not there."""
    draft, final = Path(f"{folder}.draft"), Path(folder)
    shutil.rmtree(draft, ignore_errors=True)
    for name in TABLES:
        tables[name].write.parquet(f"{draft}/{name}")
    (draft / "metadata.json").write_text(json.dumps({"version": VERSION, "sha256": digest(source)}))
    shutil.rmtree(final, ignore_errors=True)
    draft.rename(final)


def read(spark: SparkSession, folder: str, source: str) -> dict[str, DataFrame] | None:
    """The tables, if they are there, of this version and of this very file."""
    meta = Path(folder) / "metadata.json"
    if not meta.exists() or json.loads(meta.read_text()) != {"version": VERSION, "sha256": digest(source)}:
        return None
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}
