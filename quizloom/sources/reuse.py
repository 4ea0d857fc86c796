"""Tables that are made once and found again: named by what they are made from."""

from __future__ import annotations

import hashlib
import inspect
import json
import re
import uuid
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from quizloom.sources.mcq import shared_folder


def file_identity(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """Path, length and time of change of each file, by Spark's own access to its store."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for path in sorted(paths):
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
        status = at.getFileSystem(conf).getFileStatus(at)
        out.append((path, status.getLen(), status.getModificationTime()))
    return out


def identity(df: DataFrame) -> str | None:
    """A digest of a frame's plan, of the files it reads and of how it reads them; None where it can't be told: rows
    from elsewhere than files, expressions that may give others each time, or functions in Python."""
    plan = df._jdf.queryExecution().optimizedPlan()
    found = plan.collectLeaves()
    leaves = [found.apply(i) for i in range(found.size())]
    if not plan.deterministic() or any(leaf.getClass().getSimpleName() != "LogicalRelation" for leaf in leaves):
        return None
    relations = [leaf.relation() for leaf in leaves]
    if any(r.getClass().getSimpleName() != "HadoopFsRelation" for r in relations):
        return None
    # Whole, unlike a printed plan, but for what is another in each session.
    text = re.sub(r'"jvmId":"[^"]*"', "", plan.canonicalized().toJSON())
    if "PythonUDF" in text or "ScalaUDF" in text:
        return None
    read = [[r.fileFormat().toString(), r.dataSchema().json(), sorted(str(r.options().toSeq().apply(i)) for i in range(r.options().size()))] for r in relations]
    return hashlib.sha256(json.dumps([text, read, file_identity(df.sparkSession, df.inputFiles())]).encode()).hexdigest()


def reused(make: Callable[[], DataFrame], name: str, of: list[DataFrame], parameters: dict, code: list[ModuleType], folder: str | None = None) -> DataFrame:
    """What make returns, as a table in the shared folder, which later calls find and read instead.

    The table is named by the identity of the frames it is made from (their plans, and their files' paths, lengths and
    times), by parameters, and by the source of the modules whose code makes it: a change of any gives another table. Where a
    frame has no identity it is made anew. A table is moved to its name once it is whole, so a
    call that dies leaves none, and of two calls at once one's is kept. Old tables are the caller's to remove.
    """
    spark = of[0].sparkSession
    identities = [identity(df) for df in of]
    if any(i is None for i in identities):
        return make()
    key = hashlib.sha256(json.dumps([identities, parameters, [inspect.getsource(m) for m in code]], sort_keys=True, default=str).encode()).hexdigest()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = f"{folder or shared_folder(spark)}/reused"
    place, draft = (jvm.org.apache.hadoop.fs.Path(f"{root}/{p}") for p in (f"{name}-{key}", f"draft-{uuid.uuid4().hex}"))
    store = place.getFileSystem(conf)
    if not store.exists(place):
        make().write.parquet(draft.toString())
        if store.exists(place) or not store.rename(draft, place):
            store.delete(draft, True)
    return spark.read.parquet(place.toString())
