"""What several operators of this subpackage need: the shared folder, written tables, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfworks.functions.numbering import shared_dir, written

__all__ = ["LOWER", "UPPER", "ascii_lower", "below", "drawn", "dropped", "fresh", "in_batches", "new_path", "shared_dir", "ship", "small", "table", "written"]

#: The ASCII capitals and their small forms; contracts lower-case only these.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of about 100 bytes up to which a side may be broadcast (about 20 MB in all).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by written() that no later step reads."""
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Ask for a broadcast only where the counted rows stay within ``limit``; else Spark shuffles both sides."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def drawn(number: Column, wanted: int, rows: int) -> Column:
    """Whether a row is in a sample of about ``wanted`` of ``rows``: the upper 63 bits of its 64-bit hash are below that share of them."""
    return F.lit(True) if wanted >= rows else F.shiftrightunsigned(number, 1) < F.lit(below(wanted, rows))


def below(wanted: int, rows: int) -> int:
    """The 63-bit number below which ``wanted`` of ``rows`` random ones lie."""
    return (wanted << 63) // max(1, rows)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column in ``taken`` is called so, in any case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code once a context: they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="shelfworks-code-"), "shelfworks_code.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def in_batches(frame: DataFrame, max_mb: int = 8) -> DataFrame:
    """Ship the code, and bound the batches that Parquet readers and Python workers hold, so that long texts do not pile up in one."""
    ship(frame.sparkSession)
    conf = frame.sparkSession.conf
    conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max_mb << 20))
    return frame
