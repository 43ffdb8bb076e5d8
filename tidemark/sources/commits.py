"""Numbered manifests: the commits of tables that are changed by writing new files beside the old ones."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Commits:
    """JSON files ``1, 2, ...`` in a folder of any file system that Spark knows. A number is given once only."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _system(self):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def newest(self) -> int:
        """The greatest number, 0 for none. A newest manifest that can't be read (its writer died) is put aside, named ``.corrupt``."""
        _, fs, at = self._system()
        numbers = sorted((int(n) for n in (f.getPath().getName() for f in fs.listStatus(at)) if n.isdigit()), reverse=True) if fs.exists(at) else []
        for n in numbers:
            try:
                self.read(n)
                return n
            except json.JSONDecodeError:
                self._put_aside(n)
        return 0

    def _put_aside(self, number: int) -> None:
        jvm, fs, at = self._system()
        fs.rename(jvm.org.apache.hadoop.fs.Path(at, str(number)), jvm.org.apache.hadoop.fs.Path(at, f"{number}.corrupt"))

    def read(self, number: int) -> dict:
        jvm, fs, at = self._system()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(at, str(number)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode() or "?")
        finally:
            stream.close()

    def add(self, number: int, manifest: dict) -> None:
        """Write a manifest; an error if the number is taken, so that of two changes at once one fails and can start anew."""
        jvm, fs, at = self._system()
        out = fs.create(jvm.org.apache.hadoop.fs.Path(at, str(number)), False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
