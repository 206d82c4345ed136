"""Parquet tables in versions, for several writers at once.

Rows lie in buckets by a hash of their key. A version is a small file that names the folder of each
bucket; folders are never changed. A merge reads and writes only the buckets that its rows fall into,
then claims the next version number by creating its file, which at most one writer can do. A
writer that comes second merges again into the buckets that have changed under it; the others it keeps.
A reader sees the newest version, a writer that dies leaves only folders that no version names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presssignal.session import cut_lineage

BUCKETS = 16
#: What no version names is left alone for so long; a writer may be about to name it.
RETIRE_AFTER = 24 * 3600
_BUCKET = "_bucket"

ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("url", T.StringType()),
        T.StructField("search_range", T.StringType()),
        T.StructField("page_num", T.IntegerType()),
        T.StructField("html", T.StringType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("sentiment", T.IntegerType()),
    ]
)
TREND_SCHEMA = T.StructType(
    [
        T.StructField("input_filename", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("trend", T.IntegerType()),
    ]
)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _folder(spark: SparkSession, path: str):
    hadoop_path = _path(spark, path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def numbered_folders(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers N of the folders ``name=N`` that hold a success marker."""
    fs, folder = _folder(spark, root)
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        entry = status.getPath().getName()
        if entry.startswith(f"{name}=") and fs.exists(_path(spark, f"{root}/{entry}/_SUCCESS")):
            found.append(int(entry.split("=", 1)[1]))
    return sorted(found)


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)


# --- versions -----------------------------------------------------------------------


@dataclass(frozen=True)
class Version:
    """What one version names: a folder per bucket (those without rows are absent), relative to the table."""

    number: int = -1
    buckets: int = BUCKETS
    folders: dict[int, str] = field(default_factory=dict)
    note: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"buckets": self.buckets, "folders": self.folders, "note": self.note})


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions under ``root``."""
    fs, folder = _folder(spark, f"{root}/versions")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The version of that number, the newest by default; one without rows if there is none."""
    if number is None:
        known = versions(spark, root)
        if not known:
            return Version()
        number = known[-1]
    fs, file = _folder(spark, f"{root}/versions/{number}")
    stream = fs.open(file)
    try:
        read = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return Version(number, read["buckets"], {int(b): f for b, f in read["folders"].items()}, read["note"])


def _claim(spark: SparkSession, root: str, new: Version) -> bool:
    """Create the version's file with its whole text, or tell that another writer has created it.

    The text is written under another name first; the number is then taken in one step that fails if it exists: a
    link on a local disk, a rename that never overwrites elsewhere.
    """
    fs, target = _folder(spark, f"{root}/versions/{new.number}")
    draft = _path(spark, f"{root}/versions/.{new.number}-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(new.text().encode()))
    stream.close()
    jvm, local = spark._jvm, fs.getUri().getScheme() == "file"
    try:
        if local:
            source, name = (jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath() for p in (draft, target))
            jvm.java.nio.file.Files.createLink(name, source)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            context.rename(draft, target, options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(draft, False)
    return True


# --- reading ------------------------------------------------------------------------


def _read(spark: SparkSession, root: str, schema: T.StructType, of: Version, buckets: list[int] | None = None) -> DataFrame:
    chosen = sorted(of.folders) if buckets is None else [b for b in buckets if b in of.folders]
    if not chosen:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{of.folders[b]}" for b in chosen])


def read_latest(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The newest version, or an empty table."""
    return _read(spark, root, schema, version(spark, root))


# --- writing ------------------------------------------------------------------------


def _write(spark: SparkSession, root: str, rows: DataFrame, key: list[str], buckets: int) -> dict[int, str]:
    """Write rows into a folder per bucket; adaptive execution cuts large buckets into files and joins small ones."""
    name = f"data/{uuid.uuid4().hex}"
    dealt = rows.withColumn(_BUCKET, bucket_of(key, buckets))
    dealt.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{root}/{name}")
    fs, folder = _folder(spark, f"{root}/{name}")
    found = [status.getPath().getName() for status in fs.listStatus(folder)]
    return {int(f.split("=", 1)[1]): f"{name}/{f}" for f in found if f.startswith(f"{_BUCKET}=")}


def bucket_of(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _drop(spark: SparkSession, root: str, folders: dict[int, str]) -> None:
    for name in {f.rsplit("/", 1)[0] for f in folders.values()}:
        remove_folder(spark, f"{root}/{name}")


def merge(
    spark: SparkSession, root: str, schema: T.StructType, key: list[str], incoming: DataFrame,
    change: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS, number: int | None = None, note: dict | None = None,
) -> int:
    """Merge ``incoming`` into the table and return the number of the version that holds it.

    ``change(stored, incoming)`` gives the new rows of the buckets that incoming rows fall into, from their stored
    rows; it must keep rows apart that differ in ``key``. If another writer claims the version first, the buckets
    that its version changed are merged again on top of it, until a claim succeeds. The number of buckets is that of
    the first version. ``number`` asks for a version of that number; if the table is there already or beyond,
    nothing is merged.
    """
    base = version(spark, root)
    count = base.buckets if base.number >= 0 else buckets
    fresh = cut_lineage(incoming)
    touched = sorted(r[0] for r in fresh.select(bucket_of(key, count)).distinct().collect())  # at most ``count`` numbers
    written: dict[int, str] = {}
    todo = touched
    while number is None or base.number < number:
        if todo:
            mine = fresh.filter(bucket_of(key, count).isin(todo))
            rows = change(_read(spark, root, schema, base, todo), mine).select(*schema.names)
            again = _write(spark, root, rows, key, count)
            if not set(again) <= set(todo):
                raise ValueError("a change moved rows to other keys")
            # what lost the race is named by no version; ``retire`` removes it
            written = {b: f for b, f in written.items() if b not in todo} | again
        kept = {b: f for b, f in base.folders.items() if b not in touched}
        new = Version(base.number + 1 if number is None else number, count, kept | written, base.note | (note or {}))
        if _claim(spark, root, new):
            return new.number
        before, base = base, version(spark, root)
        if base.buckets != count:  # the other writer made the table, with buckets of its own
            count, touched, written = base.buckets, sorted(r[0] for r in fresh.select(bucket_of(key, base.buckets)).distinct().collect()), {}
            todo = touched
        else:
            todo = [b for b in touched if base.folders.get(b) != before.folders.get(b)]
    _drop(spark, root, written)
    return base.number


def retire(spark: SparkSession, root: str, keep: int = 2, older_than: float = RETIRE_AFTER) -> int:
    """Remove all but the newest ``keep`` versions and the folders that none of these names; returns how many folders.

    Folders and drafts younger than ``older_than`` seconds stay: their writer may not have claimed a version yet.
    """
    known = versions(spark, root)
    if not known:
        return 0
    named = {f.split("/")[1] for n in known[-keep:] for f in version(spark, root, n).folders.values()}
    for n in known[:-keep]:
        fs, file = _folder(spark, f"{root}/versions/{n}")
        fs.delete(file, False)
    gone, limit = 0, 1000 * (time.time() - older_than)
    for name in ("data", "versions"):
        fs, folder = _folder(spark, f"{root}/{name}")
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            entry, old = status.getPath().getName(), status.getModificationTime() <= limit
            if old and (entry not in named if name == "data" else entry.startswith(".")):
                fs.delete(status.getPath(), True)
                gone += name == "data"
    return gone
