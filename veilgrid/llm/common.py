"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes an Arrow batch may hold: texts can be long, and a worker keeps one batch at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: For UTF-8 bytes: A-Z to a-z, digits, a-z and all beyond ASCII as they are, the rest to spaces.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, because one row here is a whole document."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, one process alone (a local master) gets a folder of its own; anywhere else
    executors would each write to their own disk, so that is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="veilgrid-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Lost executors then cost no recomputation of what lies before, and every later
    reader sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilgrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Who has left memories in this worker process, and how they go.
_left: list[tuple[str, Callable[[], None]]] = []


def working_for(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Called in tasks: workers outlive tasks, and what another operator remembers in this process goes before ``owner`` works.

    ``forget`` drops what ``owner`` itself will leave.
    """
    if _left and _left[0][0] != owner:
        _left.pop()[1]()
    if forget and not _left:
        _left.append((owner, forget))


def map_rows(df: DataFrame, columns: list[Column], batch_fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Run ``batch_fn`` on every Arrow batch of ``columns``; it returns the lists of the output columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for(batch_fn.__module__)
        for batch in batches:
            out = batch_fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def in_remainder(doc_id: Column, mod: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, is ``remainder``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % mod == remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, text and ``label__`` for at most ``rows`` label rows: those of smallest id hash.

    The sample is drawn from the label table alone, so that no text is moved for it; its
    bound is what makes the broadcast safe. An id that documents share gives one text, the
    one of smallest hash, so that no more than ``rows`` come out. Rows without an id or a label are left out.
    """
    usable = labels.select(F.col(id_col).alias("labelled_id"), F.col(label).cast("int").alias("label__")).where("labelled_id is not null and label__ is not null")
    drawn = usable.orderBy(F.xxhash64("labelled_id"), "labelled_id", "label__").limit(rows).distinct()
    texts = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).cast("string").alias("own_text"))
    found = texts.join(F.broadcast(drawn), F.col("own_id") == F.col("labelled_id"))
    one = found.groupBy("own_id", "label__").agg(F.min_by("own_text", F.xxhash64("own_text")).alias("own_text"))
    return one.select(F.col("own_id").alias(id_col), F.col("own_text").alias(text_col), "label__")
