"""Tables as folders that numbered commits name: readers see a whole version, and of two writers one has to look again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Versioned:
    """A table at a path, of Parquet folders under data/. A version is a file that lists its folders, and is there once it is renamed."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    def version(self) -> int:
        """The number of the last commit; -1 for a table that is not there yet."""
        at = self._path("versions")
        if not self._fs.exists(at):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def folders(self, version: int) -> list[str]:
        if version < 0:
            return []
        text = self.spark.read.text(f"{self.path}/versions/{version:012d}", wholetext=True).first()["value"]
        return json.loads(text)["folders"]

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the last by default; no rows where there is none."""
        names = self.folders(self.version() if version is None else version)
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{n}" for n in names))

    def write(self, rows: DataFrame, name: str | None = None) -> str:
        """Rows as a folder that no version names yet; one of the same name is replaced."""
        name = name or uuid.uuid4().hex
        rows.write.mode("overwrite").parquet(f"{self.path}/data/{name}")
        return name

    def commit(self, after: int, folders: list[str]) -> bool:
        """Make these folders the version that follows `after`; false, with nothing changed, if another writer has made it."""
        made = self._path(f"versions/.{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps({"folders": folders}).encode()))
        out.close()
        to = self._path(f"versions/{after + 1:012d}")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(made, to, plain)  # never over a file that is there
        except Exception:
            self._fs.delete(made, False)
            if self._fs.exists(to):
                return False
            raise
        return True

    def change(self, to: Callable[[list[str]], list[str]]) -> int:
        """Commit what `to` makes of the last version's folders, looking again as often as others come first; the version's number."""
        while True:
            at = self.version()
            if self.commit(at, to(self.folders(at))):
                return at + 1

    def clean(self, keep: int = 2) -> list[str]:
        """Delete folders that none of the last `keep` versions names; only while nobody writes. The names deleted."""
        at, data = self.version(), self._path("data")
        used = {n for v in range(max(0, at - keep + 1), at + 1) for n in self.folders(v)}
        gone = [s.getPath().getName() for s in self._fs.listStatus(data) if s.getPath().getName() not in used] if self._fs.exists(data) else []
        for n in gone:
            self._fs.delete(self._path(f"data/{n}"), True)
        return sorted(gone)
