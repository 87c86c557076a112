"""Versioned index snapshots.

A version is a folder of Parquet tables and a manifest. The file ``CURRENT`` names the version that
readers use; they resolve it once. A writer takes an exclusive lock file, writes the next version in
full and then replaces ``CURRENT``, so index and metadata change together or not at all, and searches
go on during an update. All files are reached through the Hadoop file system of the path.

The holder of the lock renews its time; a lock that wasn't renewed for ``STALE`` seconds belongs to a
writer that died, and one of those who wait removes it. A table of more than ``SEGMENTS`` folders has all
but its first merged when the next version is written.
"""

from __future__ import annotations

import contextlib
import json
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds after which a lock that nobody renews is taken over, and between renewals.
STALE, RENEWED = 300.0, 30.0
#: Folders of a table, one an append, from which on they are merged.
SEGMENTS = 8


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _read(self, name: str) -> str | None:
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool = True) -> None:
        stream = self._fs.create(self._at(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def current(self) -> int | None:
        """The version that readers use, or None if there is none."""
        text = self._read("CURRENT")
        return int(text) if text and text.strip() else None

    def manifest(self, version: int) -> dict:
        text = self._read(f"v{version}/manifest.json")
        if text is None:
            raise FileNotFoundError(f"no index in {self.path}")
        return json.loads(text)

    def table(self, manifest: dict, name: str) -> DataFrame:
        paths = [f"{self.path}/{p}" for p in manifest["tables"][name]]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    @contextlib.contextmanager
    def lock(self, timeout: float = 600.0):
        """Exclusive among writers; creating a file that exists fails on any Hadoop file system."""
        until, owner = time.time() + timeout, uuid.uuid4().hex
        while True:
            try:
                self._write("LOCK", owner, overwrite=False)
                break
            except Exception as error:
                if self._take_stale(owner):
                    continue
                if time.time() > until:
                    raise TimeoutError(f"{self.path}/LOCK is held by another writer") from error
                time.sleep(0.2)
        done = threading.Event()
        renewing = threading.Thread(target=self._renew, args=(owner, done), daemon=True)
        renewing.start()
        try:
            yield
        finally:
            done.set()
            renewing.join()
            if self._read("LOCK") == owner:
                self._fs.delete(self._at("LOCK"), False)

    def _renew(self, owner: str, done: threading.Event) -> None:
        while not done.wait(RENEWED):
            if self._read("LOCK") == owner:
                self._fs.setTimes(self._at("LOCK"), int(time.time() * 1000), -1)

    def _take_stale(self, owner: str) -> bool:
        """Remove a lock that nobody renews. A rename has one winner, so a new lock is never removed by a second one."""
        try:
            status = self._fs.getFileStatus(self._at("LOCK"))
            if time.time() * 1000 - status.getModificationTime() < STALE * 1000:
                return False
            aside = self._at(f"LOCK.{owner}")
            if not self._fs.rename(self._at("LOCK"), aside):
                return False
            if time.time() * 1000 - self._fs.getFileStatus(aside).getModificationTime() < STALE * 1000:
                self._fs.rename(aside, self._at("LOCK"))  # another one was quicker, and this is its lock
                return False
            self._fs.delete(aside, False)
            return True
        except Exception:  # noqa: BLE001  the lock went meanwhile
            return False

    def commit(self, write: dict[str, DataFrame], keep: dict[str, list[str]], manifest: dict, cluster_by: dict[str, str] | None = None, versions: int = 2) -> dict:
        """Write the next version and make it current; returns its manifest.

        A table is the files that are written now and those of earlier versions in ``keep``, so appending
        writes only what is new. Folders that none of the last ``versions`` manifests names are removed.
        """
        before = self.current() or 0
        version = before + 1
        self._fs.delete(self._at(f"v{version}"), True)
        tables = {name: list(paths) for name, paths in keep.items()}
        for name, df in write.items():
            key = (cluster_by or {}).get(name)
            if len(tables.get(name, [])) >= SEGMENTS:
                merged = tables[name][1:]
                tables[name] = tables[name][:1]
                df = self.table({"tables": {name: merged}}, name).unionByName(df, allowMissingColumns=True)
            if key:
                df = df.repartitionByRange(key).sortWithinPartitions(key)
            df.write.option("compression", "zstd").mode("overwrite").parquet(f"{self.path}/v{version}/{name}")
            tables.setdefault(name, []).append(f"v{version}/{name}")
        manifest = manifest | {"version": version, "tables": tables}
        self._write(f"v{version}/manifest.json", json.dumps(manifest))
        self._write("CURRENT.next", str(version))
        self._replace("CURRENT.next", "CURRENT")
        self._sweep(version, versions)
        return manifest

    def _replace(self, source: str, target: str) -> None:
        """An atomic rename over an existing file."""
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(self._at(source)), self._fs.makeQualified(self._at(target)), options)

    def _sweep(self, version: int, versions: int) -> None:
        kept = range(max(1, version - versions + 1), version + 1)
        used = {f"v{v}" for v in kept}
        for v in kept:
            if self._fs.exists(self._at(f"v{v}/manifest.json")):
                used |= {p.split("/")[0] for paths in self.manifest(v)["tables"].values() for p in paths}
        for status in self._fs.listStatus(self._at("")):
            name = status.getPath().getName()
            if name.startswith("v") and name[1:].isdigit() and name not in used and int(name[1:]) < version:
                self._fs.delete(status.getPath(), True)
