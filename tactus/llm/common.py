"""What the operators of this subpackage share: the shared folder, lineage cuts, small helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, and tab to carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own checkpoint folder.

    Where both are unset and all tasks run in the driver's process (local mode), a temporary folder, deleted at exit; on
    a cluster that is an error, as its executors share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:  # the setting can't be changed while Spark runs, so ours is kept here
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tactus-shared-")
            atexit.register(shutil.rmtree, _own[app].removeprefix("file://"), ignore_errors=True)
        found = _own[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that written() made."""
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def map_text(docs: DataFrame, value: Column | str, keep: tuple[str, ...], fields: str, start: Callable[[], Callable[[list], dict[str, list]]], step: int = 1_000) -> DataFrame:
    """`keep` columns of docs and the new `fields`, which the function that start() returns in each task makes from `step` values at a time.

    value: a column, or the name of a kept one, which then travels once.  The kept columns pass through as Arrow arrays,
    so nulls and large integers stay as they are.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = (ddl(kept) + ", " if keep else "") + fields
    at = keep.index(value) if isinstance(value, str) else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                made = make(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *map(pa.array, made.values())], names=[*part.schema.names[: len(keep)], *made])
        give_back()

    sent = kept if isinstance(value, str) else docs.select(*[F.col(f"`{c}`") for c in keep], value.alias("__value"))
    return sent.mapInArrow(run, schema)


class Recent(dict):
    """key -> make(key), made when it is asked for.  Up to 2 * kept values stay, those that were asked for last, of keys of up to `longest` code points."""

    def __init__(self, kept: int, longest: int):
        super().__init__()
        self.kept, self.longest, self.old = kept, longest, {}

    def make(self, key: str):  # noqa: ANN201
        raise NotImplementedError

    def __missing__(self, key: str):  # noqa: ANN204
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def give_back() -> None:
    """Return memory that this worker no longer uses to the system; the worker lives on for tasks of other operators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def aside(df: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """df with all but the used columns under names that clash with none, and the map back to their own names."""
    others = [c for c in df.columns if c not in used]
    return df.withColumnsRenamed({c: f"__aside_{i}" for i, c in enumerate(others)}), {f"__aside_{i}": c for i, c in enumerate(others)}


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, other letters as they are.  lower() is much faster and the same on ASCII text."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
