"""An append store: immutable part files, and a manifest for each version that one rename commits.

A commit may be of several tables, and is seen whole or not at all. It names the version that it builds on; if another writer has
committed since, the rename finds its name taken and the commit is refused. Readers keep to the parts of one manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another commit came first, or a key is there with other values."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _fs(self):
        return self._at("versions").getFileSystem(self.conf)

    def version(self) -> int:
        """The last version; 0 is the empty store."""
        fs, folder = self._fs(), self._at("versions")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {}
        return json.loads(self.spark.read.text(self._at("versions", f"{version:010d}.json").toString(), wholetext=True).first()[0])

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version. Rows of one commit are all there or none."""
        entry = self.manifest(version).get(table)
        if entry is None:
            raise KeyError(f"no table {table} in version {version}")
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(*[self._at("parts", p).toString() for p in entry["parts"]])

    def part(self, table: str, name: str) -> DataFrame:
        """One part of a table: what one commit appended."""
        return self.spark.read.schema(StructType.fromJson(self.manifest()[table]["schema"])).parquet(self._at("parts", name).toString())

    def commit(self, rows: dict[str, DataFrame], on: int | None = None) -> int:
        """Appends rows to tables in one step, and returns the version. ``on`` is the version that the writer has read; by default the
        last one before the parts are written. The first rows of a table set its columns."""
        on = self.version() if on is None else on
        tables = self.manifest(on)
        for name, df in rows.items():
            if name in tables:
                kind = StructType.fromJson(tables[name]["schema"])
                df = df.select(*[F.col(f.name).cast(f.dataType) for f in kind.fields])
            part = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(self._at("parts", part).toString())
            schema = tables[name]["schema"] if name in tables else StructType([f.__class__(f.name, f.dataType, True) for f in df.schema.fields]).jsonValue()
            tables[name] = {"schema": schema, "parts": [*tables.get(name, {"parts": []})["parts"], part]}
        return self._publish(tables, on + 1)

    def replace(self, table: str, rows: DataFrame, on: int) -> int:
        """A version in which the table has these rows alone, as after a compaction; refused if there is another since ``on``."""
        tables = self.manifest(on)
        part = f"{table}-{uuid.uuid4().hex}"
        rows.select(*[f["name"] for f in tables[table]["schema"]["fields"]]).write.parquet(self._at("parts", part).toString())
        tables[table]["parts"] = [part]
        return self._publish(tables, on + 1)

    def _publish(self, tables: dict, version: int) -> int:
        fs, target = self._fs(), self._at("versions", f"{version:010d}.json")
        ours = self._at("versions", f".{uuid.uuid4().hex}.tmp")
        fs.mkdirs(self._at("versions"))
        out = fs.create(ours, False)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(self.conf).getUri(), self.conf)
        try:
            context.rename(ours, target, none)  # never over another file
        except Exception as e:
            fs.delete(ours, False)
            if isinstance(e, CapturedException) or fs.exists(target):
                raise Conflict(f"version {version} is there already") from e
            raise
        return version

    def insert_or_compare(self, table: str, rows: DataFrame, keys: list[str]) -> int:
        """Appends rows whose keys are not there yet. Rows that are there already with the same values are left out, so an insert may
        be done again; one with other values, or two rows of one key, refuse the whole commit."""
        on = self.version()
        values = [c for c in rows.columns if c not in keys]
        mine = rows.distinct()
        if mine.groupBy(*keys).count().filter("count > 1").limit(1).count():
            raise Conflict("a key comes twice with different values")
        if table in self.manifest(on):
            old = self.read(table, on)
            same = F.lit(True)
            for c in values:
                same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
            on_keys = F.lit(True)
            for c in keys:
                on_keys = on_keys & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
            if mine.alias("n").join(old.alias("o"), on_keys).filter(~same).limit(1).count():
                raise Conflict("a key is there with other values")
            mine = mine.alias("n").join(old.alias("o"), on_keys, "left_anti")
        return self.commit({table: mine}, on)
