"""Versioned tables in a shared folder: segments of rows, and a log of numbered commits that says which of them count.

A commit is one small file whose number no other commit has: it is written beside and put in place only if nothing is there. Who loses the race
reads what was committed meanwhile and tries the next number, so writers of any session never undo each other. Rows lie in
folders of names of their own and count from their commit on; a crash leaves the state before or after a commit and at most a
folder that nothing names, which `vacuum` deletes.
"""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ready(spark: SparkSession, folder: str | None = None) -> str:
    """Let Python workers import the library, and name a checkpoint folder: the session's, else the one given, else for a local master a temporary one. A cluster's machines don't share that, so there it is an error."""
    import os
    import tempfile
    from pathlib import Path

    sc = spark.sparkContext
    root, have = str(Path(__file__).resolve().parents[2]), sc.environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (have, root) if x)
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or folder
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tarnwick-"))
    return sc.getCheckpointDir()


class Files:
    """Small files and folders through Spark's own file systems, so any store that Spark reads will do."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Whole or not at all, in place of what is there: written beside, then renamed over it in one step."""
        _, p = self._at(path)
        fs, beside = self._at(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = self.spark.sparkContext._gateway.new_array(rename, 1)
        overwrite[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(beside, p, overwrite)

    def create(self, path: str, text: str) -> bool:
        """Put a new file in place, whole; false if there is one. Local files are linked, which fails on an existing name; others are renamed, which
        Hadoop's file systems refuse onto an existing name. Stores whose rename overwrites don't suit."""
        fs, p = self._at(path)
        beside = f"{path}.{uuid.uuid4().hex}"
        if fs.getUri().getScheme() == "file":
            here, there = (self._at(x)[1].toUri().getPath() for x in (beside, path))
            os.makedirs(os.path.dirname(there), exist_ok=True)
            with open(here, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(here, there)
            except FileExistsError:
                return False
            finally:
                os.unlink(here)
            return True
        stream = fs.create(self._at(beside)[1], True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not fs.exists(p) and fs.rename(self._at(beside)[1], p):
            return True
        fs.delete(self._at(beside)[1], False)
        return False

    def names(self, path: str) -> list[tuple[str, float]]:
        """(name, seconds since 1970 of the last change) of what is in a folder; nothing if there is none."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        return [(f.getPath().getName(), f.getModificationTime() / 1000) for f in fs.listStatus(p)]

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


@dataclass
class State:
    """What counts after commit number `version`. Segments and ended keys carry the number they count from."""

    version: int = -1
    tables: dict[str, dict] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)

    def apply(self, version: int, operations: list[dict]) -> None:
        for o in operations:
            if o["kind"] == "note":
                self.notes |= o["facts"]
                continue
            if o["kind"] == "add":  # figures are sums, so that commits in any order agree
                for k, v in o.get("figures", {}).items():
                    self.notes[k] = self.notes.get(k, 0) + v
            t = self.tables.setdefault(o["table"], {"segments": [], "gone": [], "schema": None})
            if o["kind"] == "replace":
                t["segments"] = [s for s in t["segments"] if s[0] not in o["drop"]]
                t["gone"] = [g for g in t["gone"] if g[0] not in o["drop"]]
            # what replaces segments counts from the state it was read from: keys ended meanwhile still end its rows
            at = o.get("base", version)
            if o.get("segment"):
                t["segments"].append([o["segment"], at])
                t["schema"] = o["schema"]
            if o.get("gone"):
                t["gone"].append([o["gone"], version])
        self.version = version

    def folders(self, table: str) -> set[str]:
        t = self.tables.get(table, {"segments": [], "gone": []})
        return {f for f, _ in [*t["segments"], *t["gone"]]}


class Conflict(RuntimeError):
    """Another writer replaced what this one read."""


class Store:
    """Tables under root. `append` adds a segment of rows, `gone` keys end older rows, `replace` starts anew, `compact` merges what is left."""

    #: Commits after which the whole state is kept beside the log, so that readers don't read all of it.
    EVERY = 20

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str]):
        """keys: table -> the column whose values `append` can end in older segments."""
        self.spark, self.root, self.keys, self.files = spark, root.rstrip("/"), keys, Files(spark)

    # The log ------------------------------------------------------------------------------------------------------

    def state(self) -> State:
        """The state after the last commit: the last whole state, and the commits after it."""
        names = {n for n, _ in self.files.names(f"{self.root}/log")}
        commits = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())
        whole = [int(n[6:-5]) for n in names if n.startswith("state-") and n.endswith(".json") and n[6:-5].isdigit()]
        out = State()
        if whole:
            kept = json.loads(self.files.read(f"{self.root}/log/state-{max(whole):012d}.json"))
            out = State(kept["version"], kept["tables"], kept["notes"])
        for n in commits:
            if n > out.version:
                out.apply(n, json.loads(self.files.read(f"{self.root}/log/{n:012d}.json")))
        return out

    def commit(self, make: Callable[[State], list[dict]]) -> int:
        """Commit the operations that make finds for the state it gets; it is asked again for the next state whenever another commit came first. The commit's number."""
        while True:
            before = self.state()
            operations = make(before)
            n = before.version + 1
            if self.files.create(f"{self.root}/log/{n:012d}.json", json.dumps(operations)):
                break
        if n % self.EVERY == self.EVERY - 1:
            before.apply(n, operations)
            self.files.create(f"{self.root}/log/state-{n:012d}.json", json.dumps({"version": n, "tables": before.tables, "notes": before.notes}))
        return n

    @property
    def notes(self) -> dict:
        """Small facts kept with the tables, and sums of figures."""
        return self.state().notes

    def note(self, **facts) -> None:
        self.commit(lambda _: [{"kind": "note", "facts": facts}])

    def has(self, table: str) -> bool:
        return bool(self.state().tables.get(table, {}).get("segments"))

    # Rows ---------------------------------------------------------------------------------------------------------

    def written(self, table: str, rows: DataFrame | None, gone: DataFrame | None = None, partition_by: tuple[str, ...] = ()) -> dict:
        """Write rows and ended keys to folders of their own; the operation that makes them count once it is committed."""
        name, operation = uuid.uuid4().hex, {"kind": "add", "table": table}
        if rows is not None:
            rows.write.partitionBy(*partition_by).parquet(f"{self.root}/{table}/{name}")
            operation |= {"segment": name, "schema": rows.schema.json()}
        if gone is not None:
            gone.select(F.col(self.keys[table]).alias("key")).distinct().write.parquet(f"{self.root}/{table}/gone-{name}")
            operation |= {"gone": f"gone-{name}"}
        return operation

    def rows_of(self, operation: dict) -> DataFrame:
        """Rows that an operation wrote, whether it is committed or not."""
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(operation["schema"]))).parquet(f"{self.root}/{operation['table']}/{operation['segment']}")

    def append(self, table: str, rows: DataFrame, gone: DataFrame | None = None, partition_by: tuple[str, ...] = ()) -> int:
        """Add rows as a segment, and end the rows of older segments whose key is in gone."""
        operation = self.written(table, rows, gone, partition_by)
        return self.commit(lambda _: [operation])

    def end(self, table: str, gone: DataFrame) -> None:
        """End rows without adding any."""
        if self.has(table):
            operation = self.written(table, None, gone)
            self.commit(lambda _: [operation])

    def read(self, table: str, state: State | None = None, narrow: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """Rows that count. Without ended keys it is a plain scan, so filters and columns reach the files; segments after the last ended keys are one beside ended ones.

        narrow drops rows of a segment that are not wanted, before their keys are looked up among the ended ones: where few are left, few are shuffled."""
        from pyspark.sql.types import StructType

        t = (state or self.state()).tables.get(table)
        if not t or not t["segments"]:
            raise KeyError(table)
        schema = StructType.fromJson(json.loads(t["schema"]))
        one = lambda n: narrow(self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{n}"))
        oldest = min(n for _, n in t["segments"])
        ending = [g for g in t["gone"] if g[1] > oldest]
        if not ending:
            out = one(t["segments"][0][0])
            for f, _ in t["segments"][1:]:
                out = out.unionByName(one(f), allowMissingColumns=True)
            return out.select(*[c for c in schema.names if c in out.columns])
        seq, key, last = "__segment", "__key", "__last"
        rows, newest = None, max(n for _, n in ending)
        for f, n in t["segments"]:
            if n >= newest:
                continue
            part = one(f).withColumn(seq, F.lit(n))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        ended = None
        for f, n in ending:
            part = self.spark.read.parquet(f"{self.root}/{table}/{f}").select(F.col("key").alias(key), F.lit(n).alias(last))
            ended = part if ended is None else ended.unionByName(part)
        ended = ended.groupBy(key).agg(F.max(last).alias(last))
        k = self.keys[table]
        out = rows.join(ended, F.col(k) == F.col(key), "left").where(F.col(last).isNull() | (F.col(last) <= F.col(seq))).drop(seq, key, last)
        for f, n in t["segments"]:
            if n >= newest:
                out = out.unionByName(one(f), allowMissingColumns=True)
        return out.select(*schema.names)

    def replacing(self, table: str, rows: Callable[[DataFrame | None], DataFrame], partition_by: tuple[str, ...] = ()) -> Callable[[State], dict]:
        """Writes rows, made of the table's rows as they are now, and returns what finds the operation that puts them in place of those. Keys ended meanwhile stay ended, rows added meanwhile stay."""
        base = self.state()
        old = base.folders(table)
        operation = self.written(table, rows(self.read(table, base) if base.tables.get(table, {}).get("segments") else None), None, partition_by)
        operation |= {"kind": "replace", "drop": sorted(old), "base": base.version}

        def found(now: State) -> dict:
            if not old <= now.folders(table):
                raise Conflict(f"{table} was replaced by another writer")
            return operation

        return found

    def replace(self, table: str, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        """rows, which may be read from the table, are all it has; what others added before the commit goes too."""
        operation = self.written(table, rows, None, partition_by)
        self.commit(lambda now: [operation | {"kind": "replace", "drop": sorted(now.folders(table))}])

    def compact(self, table: str, partition_by: tuple[str, ...] = ()) -> None:
        """Merge the segments without the ended rows. Of two at once the second is a `Conflict`, and nothing is lost."""
        if self.has(table):
            make = self.replacing(table, lambda rows: rows, partition_by)
            self.commit(lambda now: [make(now)])

    def vacuum(self, older: float = 86_400.0) -> int:
        """Delete folders that no state names and that are older than so many seconds; how many. Readers of replaced segments have that long to end."""
        now, state, n = time.time(), self.state(), 0
        for table, _ in self.files.names(self.root):
            if table == "log":
                continue
            named = state.folders(table)
            for f, at in self.files.names(f"{self.root}/{table}"):
                if f not in named and now - at > older:
                    with contextlib.suppress(Exception):  # another session may have deleted it
                        self.files.delete(f"{self.root}/{table}/{f}")
                        n += 1
        return n
