"""What the operators share: table access, the shared scratch folder, materialised steps."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as SQL character-class text and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE.encode()

_own: dict[str, str] = {}
_temporary: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("temporary", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Unset, a local session gets a temporary folder of its own that goes at exit. A session
    on a cluster has no folder that is known to be shared then, and is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="snapstore-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables that are materialised in this context go at its end, but for those that ``keep`` says to leave."""
    token = _temporary.set([])
    try:
        yield
    finally:
        for path in _temporary.get():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _temporary.reset(token)


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and reread it.

    Cuts the lineage: a lost executor costs only the reread of its files, and later
    passes start from these (narrow) rows instead of the texts.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    if not keep and _temporary.get() is not None:
        _temporary.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def own_columns(docs: DataFrame, made: Iterable[str]) -> list[str]:
    """The columns of ``docs`` that an operator keeps: those whose names it does not make itself (in any case)."""
    names = {m.lower() for m in made}
    return [c for c in docs.columns if c.lower() not in names]


def fresh(columns: Iterable[str], name: str) -> str:
    """``name`` behind as many underscores as keep it apart from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shrunk(memo: dict, words: Iterable, most: int) -> dict:
    """``memo``, or where it has grown over ``most`` entries only those of ``words``, which are in use."""
    return memo if len(memo) <= most else {w: memo[w] for w in words if w in memo}


def release_memory() -> None:
    """Give freed memory back to the system at the end of a task: Python workers outlive their tasks."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def shuffle_parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_columns(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The two columns that the operators work on, under their usual names; others stay out."""
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, limit: int, name: str) -> DataFrame:
    """(doc_id, text, y) of at most about ``limit`` labelled documents, written and reread.

    ``learn`` is the condition on doc_id that keeps held-out rows away. Rows are chosen by
    a hash of their id, so the choice does not depend on how the tables lie on disk.
    Rows of one id count once: the largest label, the least text.
    """
    y = labels.where(f"{label} IS NOT NULL AND doc_id IS NOT NULL").where(learn).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    n = y.count()
    kept = y.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, limit / max(n, 1))))
    texts = text_columns(docs).join(F.broadcast(kept), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most about ``limit`` ids of 16 bytes
    return materialise(texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y"), name)
