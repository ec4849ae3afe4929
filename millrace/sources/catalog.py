"""A filesystem catalog of layered datasets, each a directory of Parquet parts.

Derived datasets are written to a new version directory and then switched by
replacing one small pointer file, so readers see the old or the new dataset,
never a mixture, and a stage may rewrite the dataset it reads.  Bronze is
append-only.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = ("bronze", "silver", "gold", "quarantine")
_NAME = re.compile(r"[a-z][a-z0-9_]{0,62}")


class StorageError(ValueError):
    """A dataset is missing, misnamed or must not be rewritten."""


def check_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise StorageError(f"bad dataset name {name!r}: lower-case letters, digits and _, at most 63, a letter first")
    return name


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(part, sha256, bytes) of each file, hashed on the executors."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("part"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


class Catalog:
    """Datasets under ``root``; any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- small files

    def read_text(self, path: str) -> str | None:
        p = self._path(path)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Write beside the target, then rename over it."""
        tmp, p = self._path(f"{path}.{uuid.uuid4().hex}.tmp"), self._path(path)
        stream = self._fs.create(tmp, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        # One rename over the old file: readers and crashes see the old or the new text.
        fs = self.spark._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.Path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.OVERWRITE
        context.rename(tmp, p, options)

    def append_event(self, name: str, event: dict) -> dict:
        """One JSON file per event under ``_log/<name>``: appends never rewrite. The event gets a ``seq`` that rises with time, without reading the log."""
        event = {"seq": time.time_ns()} | event
        self.write_text(f"{self.root}/_log/{name}/{event['seq']:020d}-{uuid.uuid4().hex[:8]}.json", json.dumps(event, sort_keys=True, ensure_ascii=False))
        return event

    def events(self, name: str) -> list[dict]:
        base = self._path(f"{self.root}/_log/{name}")
        if not self._fs.exists(base):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(base))
        return [json.loads(self.read_text(f"{self.root}/_log/{name}/{n}")) for n in names if n.endswith(".json")]

    # --- datasets

    def _dir(self, layer: str, dataset: str) -> str:
        if layer not in LAYERS:
            raise StorageError(f"unknown layer {layer!r}; known: {', '.join(LAYERS)}")
        return f"{self.root}/{layer}/{check_name(dataset)}"

    def _current(self, layer: str, dataset: str) -> str | None:
        home = self._dir(layer, dataset)
        if layer == "bronze":
            return f"{home}/data" if self._fs.exists(self._path(f"{home}/data")) else None
        version = self.read_text(f"{home}/CURRENT")
        return f"{home}/{version}" if version else None

    def datasets(self, layer: str) -> list[str]:
        base = self._path(f"{self.root}/{layer}")
        if not self._fs.exists(base):
            return []
        return sorted(n for s in self._fs.listStatus(base) if s.isDirectory() and self._current(layer, n := s.getPath().getName()))

    def parts(self, layer: str, dataset: str) -> list[str]:
        """File names of the current parts, sorted."""
        path = self._current(layer, dataset)
        if not path:
            return []
        walk, found = self._fs.listFiles(self._path(path), True), []
        while walk.hasNext():
            name = walk.next().getPath().getName()
            if name.endswith(".parquet"):
                found.append(name)
        return sorted(found)

    def path(self, layer: str, dataset: str) -> str:
        path = self._current(layer, dataset)
        if not path or not self.parts(layer, dataset):
            raise StorageError(f"no parts of {layer}/{dataset}")
        return path

    def read(self, layer: str, dataset: str) -> DataFrame:
        path = self.path(layer, dataset)
        df = self.spark.read.parquet(path)
        return df.drop("_batch_hash")

    def row_count(self, layer: str, dataset: str) -> int:
        return self.read(layer, dataset).count()

    def append(self, df: DataFrame, dataset: str, batch: str) -> None:
        """Publish one bronze batch under its hash; publishing the same batch again replaces it by itself."""
        df.write.mode("overwrite").parquet(f"{self._dir('bronze', dataset)}/data/_batch_hash={batch}")

    def append_all(self, df: DataFrame, dataset: str) -> None:
        """Publish several bronze batches, named by the column ``_batch_hash``, in one write; each replaces itself only."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch_hash").parquet(f"{self._dir('bronze', dataset)}/data")

    def replace(self, df: DataFrame, layer: str, dataset: str, part_rows: int = 1_000_000) -> str:
        """Write a new version and switch to it; returns the version. Refuses bronze."""
        if layer == "bronze":
            raise StorageError("bronze is append-only")
        home, version = self._dir(layer, dataset), f"v-{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", part_rows).parquet(f"{home}/{version}")
        self.write_text(f"{home}/CURRENT", version)
        return version

    def vacuum(self, layer: str, dataset: str) -> int:
        """Delete the versions that are not current; returns how many."""
        home, current = self._dir(layer, dataset), self._current(layer, dataset)
        old = [s.getPath() for s in self._fs.listStatus(self._path(home)) if s.isDirectory() and not (current or "").endswith(s.getPath().getName())]
        for p in old if layer != "bronze" else []:
            self._fs.delete(p, True)
        return len(old)

    # --- SQL

    def register_views(self) -> list[str]:
        """A temporary view ``<layer>_<dataset>`` for each dataset that has parts."""
        names = []
        for layer in LAYERS:
            for dataset in self.datasets(layer):
                if self.parts(layer, dataset):
                    self.read(layer, dataset).createOrReplaceTempView(f"{layer}_{dataset}")
                    names.append(f"{layer}_{dataset}")
        return names

    def sql(self, statement: str) -> DataFrame:
        self.register_views()
        return self.spark.sql(statement)

    def query(self, statement: str) -> list[dict]:
        """Rows as dicts; for results that fit the driver."""
        return [r.asDict(recursive=True) for r in self.sql(statement).collect()]

    def summary(self) -> dict[str, dict[str, dict[str, int]]]:
        out: dict[str, dict[str, dict[str, int]]] = {}
        for layer in LAYERS:
            for dataset in self.datasets(layer):
                out.setdefault(layer, {})[dataset] = {"rows": self.row_count(layer, dataset), "parts": len(self.parts(layer, dataset))}
        return out
