"""Tables that change together and are read at one moment.

A commit writes its rows of every table into folders of its own, ``<table>/run=<run>/seq=<number>``, and last an
entry into ``_commits``: one file, whose appearance is the commit. Folders of earlier commits are never touched.
A reader takes the entry with the highest number and sees the folders of its run up to that number, in all tables;
what a writer that failed or is still at work has left behind belongs to no entry and is not seen, and the next
attempt overwrites it. A new run starts from nothing and replaces the old one with its first commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .readers import read_if_any

ENTRY = ("seq long, run string, batch_id long, done boolean, last_date date, sim_days long, retrains long, model string")


class Snapshots:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def entry(self, seq: int | None = None) -> Row | None:
        """The last commit, or the one with this number."""
        log = read_if_any(self.spark, f"{self.base}/_commits", ENTRY)
        if log is None:
            return None
        return (log if seq is None else log.filter(F.col("seq") == seq)).orderBy(F.col("seq").desc()).first()

    def path(self, name: str, run: str, seq: int) -> str:
        return f"{self.base}/{name}/run={run}/seq={seq}"

    def write(self, name: str, df: DataFrame, run: str, seq: int) -> DataFrame:
        """Rows of the coming commit; returns them as written."""
        df.write.mode("overwrite").parquet(self.path(name, run, seq))
        return self.spark.read.schema(df.schema).parquet(self.path(name, run, seq))

    def commit(self, entry: Row) -> None:
        """Makes the rows written for ``entry`` visible. An entry of this number must not exist yet."""
        self.spark.createDataFrame([entry], ENTRY).coalesce(1).write.mode("errorifexists").parquet(f"{self.base}/_commits/{entry.seq:012d}")

    def table(self, name: str, entry: Row | None = None) -> DataFrame | None:
        """The table at the moment of ``entry`` (the last commit), None if it has no rows then."""
        entry = entry or self.entry()
        found = read_if_any(self.spark, f"{self.base}/{name}") if entry else None
        if found is None:
            return None
        return found.filter((F.col("run") == entry.run) & (F.col("seq") <= entry.seq)).drop("run", "seq")

    def written_by(self, name: str, entry: Row) -> DataFrame | None:
        """The rows that one commit wrote: a single folder is read."""
        return read_if_any(self.spark, self.path(name, entry.run, entry.seq))

    def expire(self, keep: int, carried: tuple[str, ...] = ()) -> None:
        """Removes entries before the last ``keep``, folders of other runs, and of the ``carried`` tables (each commit
        writes them whole) the folders of removed entries. Readers of an older moment fail after that."""
        last = self.entry()
        if last is None:
            return
        first = last.seq - keep + 1
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()

        def children(path: str):
            p = jvm.org.apache.hadoop.fs.Path(path)
            fs = p.getFileSystem(conf)
            return [(fs, s.getPath()) for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []

        for fs, p in children(f"{self.base}/_commits"):
            if p.getName().isdigit() and int(p.getName()) < first:
                fs.delete(p, True)
        for _, table in children(self.base):
            if table.getName().startswith("_") or table.getName() == "models":
                continue
            for fs, run in children(table.toString()):
                if run.getName() != f"run={last.run}":
                    if run.getName().startswith("run="):
                        fs.delete(run, True)
                elif table.getName() in carried:
                    for fs, p in children(run.toString()):
                        if int(p.getName().removeprefix("seq=")) < first:
                            fs.delete(p, True)
