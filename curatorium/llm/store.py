"""Tables written once to the shared folder and read again, so that later steps neither repeat nor lose the work; code for the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curatorium.session import ensure_checkpoint_dir


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the session's checkpoint folder and return the table that was written.

    Parquet in the shared folder outlives the executors that wrote it.  The folder belongs to the
    session: whoever sets spark.checkpoint.dir decides when it is emptied.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, as --py-files would; once per context."""
    context = spark.sparkContext
    if getattr(context, "_curatorium_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    target = os.path.join(tempfile.mkdtemp(prefix="curatorium-"), "curatorium.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(os.path.join(root, "curatorium")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, root))
    context.addPyFile(target)
    context._curatorium_shipped = True


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


class Carried:
    """Columns that pass through a Python step next to the one it reads.

    They travel under short names, so no name can clash on the way; a result column replaces an input column of its name.
    """

    def __init__(self, df: DataFrame, column: str, body: str, results: list[str]):
        taken = {r.lower() for r in results}
        self.others = [c for c in df.columns if c != column and c.lower() not in taken]
        self.names = [f"c{i}" for i in range(len(self.others))]
        self.plain = df.select(*[F.col(name(c)).alias(n) for c, n in zip(self.others, self.names)], F.col(name(column)).alias(body))

    def schema(self, results: str) -> StructType:
        return StructType([*self.plain.schema.fields[:-1], *StructType.fromDDL(results).fields])

    def back(self, df: DataFrame, *results) -> DataFrame:
        return df.select(*[F.col(n).alias(c) for c, n in zip(self.others, self.names)], *results)
