"""Session, storage and Arrow plumbing shared by the corpus operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
NO_ID = -(2**63)


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers, once per session, and bound Arrow batches.

    Batches are bounded in bytes as well as rows: a few very long texts must not
    turn one batch into a gigabyte.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_lithos_shipped", False):
        folder = Path(tempfile.mkdtemp(prefix="lithos"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(folder / "lithos_src.zip", "w") as z:
            for p in sorted((ROOT / "lithos").rglob("*.py")):
                z.write(p, p.relative_to(ROOT))
        sc.addPyFile(str(folder / "lithos_src.zip"))
        sc._lithos_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a folder of our
    own on one machine (tests), an error on several."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = getattr(sc, "_lithos_dir", None)
        if base is None:
            base = sc._lithos_dir = tempfile.mkdtemp(prefix="lithos-shared")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later work no longer
    depends on executors that may be lost. The JVM is then asked to collect garbage, so
    that the shuffle files behind the written table are released before the next step."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lithos-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(shutil.rmtree, path.removeprefix("file:"), ignore_errors=True)  # what nothing discarded before
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._lithos_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for df in cuts:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._lithos_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, text): a row's identity is its id (null: the smallest long) and the hash
    of its text, so repeated ids with different texts never mix."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(t).alias("_th"), t.alias("text"))


def public_id(name: str = "doc_id") -> Column:
    return F.when(F.col("_id") != NO_ID, F.col("_id")).alias(name)


def scan(docs: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Map Arrow batches one to one; fn may return None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return docs.mapInArrow(run, schema)


_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """The one table a Python worker keeps between batches and tasks: that of the operator it last
    worked for. Workers serve one operator after another, and tables of all would add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def strings(col: pa.Array) -> pa.Array:
    return pc.fill_null(col, "") if col.null_count else col


def record(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()], names=list(cols))
