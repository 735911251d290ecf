"""Published versions of the index: one small JSON file a version, created once.

Publishing version n + 1 succeeds for exactly one of any number of concurrent publishers; the others get
ConflictError, and what they have written is never pointed at.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MANIFEST
from ..sources.store import ExistsError, Store, sequence_name

FOLDER = "manifest"


class NoManifestError(LookupError):
    """Nothing has been published yet."""


class ConflictError(RuntimeError):
    """Another publisher has taken the version."""


class CorruptManifestError(ValueError):
    """The file's name and content disagree."""


@dataclass(frozen=True)
class Manifest:
    version: int
    index: str
    index_seq: int
    dim: int
    k: int


def latest(store: Store) -> Manifest:
    names = [n for n in store.list(f"{FOLDER}/") if re.search(r"/\d{20}\.json$", n)]
    if not names:
        raise NoManifestError("no manifest")
    found = Manifest(**json.loads(store.read(names[-1])))
    if found.version != int(re.search(r"(\d{20})\.json$", names[-1])[1]):
        raise CorruptManifestError(f"{names[-1]} holds version {found.version}")
    return found


def publish(store: Store, manifest: Manifest) -> None:
    try:
        store.create(sequence_name(FOLDER, manifest.version, ".json"), json.dumps(asdict(manifest), indent=2).encode())
    except ExistsError:
        raise ConflictError(f"version {manifest.version} is taken") from None


def history(spark: SparkSession, store: Store) -> DataFrame:
    """All published versions as a table."""
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(store.path(FOLDER))


def winner(attempts: DataFrame) -> DataFrame:
    """Of attempts (version, attempt, ...), the first of each version: what create-once keeps."""
    return attempts.groupBy("version").agg(F.min("attempt").alias("attempt"))


def build_folder(seq: int) -> str:
    """A folder name of its own for each build: covered sequence and time."""
    return f"{seq:020d}-{time.time_ns()}"
