"""What the training-data operators share: table access, shared scratch tables, Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

_to_delete: set[str] = set()
#: A word, in the regular-expression dialects of Java, Python and RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests on a local master) a temporary folder is set for
    the session; on any other master that would be a machine-local folder, so
    the setting is asked for instead.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted with its application's folder when the application ends."""
    sc = spark.sparkContext
    folder = f"{scratch_root(spark)}/llm-{sc.applicationId}"
    if folder not in _to_delete:
        _to_delete.add(folder)
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)  # only what is there can be marked
        files.deleteOnExit(path)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def type_of(df: DataFrame, column: str) -> str:
    """Type of a column, as schemas spell it."""
    return df.select(column).schema[0].dataType.simpleString()


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of ``df`` has, whatever its case."""
    taken, found = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        found.append(stem)
    return found


def row_hash(df: DataFrame) -> F.Column:
    """Hash of all columns; types without a hash of their own go by their JSON form."""
    plain = lambda t: not any(kind in t for kind in ("map<", "variant"))
    return F.xxhash64(*(F.col(f"`{c}`") if plain(t) else F.to_json(F.struct(F.col(f"`{c}`"))) for c, t in df.dtypes))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation
    of Python stages, and later passes read only the columns they use.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` whose function yields dicts of equally long columns."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, fields)


def filter_batches(df: DataFrame, text_col: str, judge: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """Rows of ``df``, all columns, whose text is kept; ``judge()`` makes, in each task, texts -> kept."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = judge()
        for b in batches:
            kept = b.filter(pa.array(keep(b.column(at).to_pylist()), pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=names)

    names = df.columns
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, df.schema)  # names with dots can't go in


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))
