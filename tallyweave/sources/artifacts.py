"""Small files beside the data, written whole or not at all: JSON, digests, markers, provenance. Paths may be any that Spark can open."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _open(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _open(spark, path)
    return fs.exists(at)


def write_bytes(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> str:
    """Write a file under another name and move it into place; the hex sha256 of its bytes."""
    digest = hashlib.sha256()
    fs, at = _open(spark, path)
    beside = at.suffix(".tmp")
    out = fs.create(beside, True)
    try:
        for chunk in chunks:
            digest.update(chunk)
            out.write(bytearray(chunk))
    finally:
        out.close()
    _replace(spark, beside, at)
    return digest.hexdigest()


def _replace(spark: SparkSession, source, target) -> None:
    """Move a file over another in one step of the file system: readers see the old or the new one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(target.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration()).rename(source, target, options)


def read_json(spark: SparkSession, path: str) -> dict:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_json(spark: SparkSession, path: str, value: dict) -> str:
    """Indented JSON with sorted keys, no line end; its digest."""
    return write_bytes(spark, path, [json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False).encode()])


def write_jsonl_file(df: DataFrame, path: str) -> str:
    """One file of JSON lines in the order of ``df``, a partition at a time through the driver; its digest. For many rows ``write_jsonl`` is the sink."""
    lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))
    return write_bytes(df.sparkSession, path, (f"{r[0]}\n".encode() for r in lines.toLocalIterator()))


def write_parquet(df: DataFrame, path: str) -> None:
    """A table written beside its place, then moved there; the old one is moved aside first and deleted last.

    Nothing is lost if this stops in between, but for a moment a reader may find no table: file systems replace a file in one step, not a folder.
    """
    fs, at = _open(df.sparkSession, path)
    beside = at.suffix(".tmp")
    df.write.mode("overwrite").parquet(beside.toString())
    aside = at.suffix(".old")
    if fs.exists(at):
        fs.delete(aside, True)
        if not fs.rename(at, aside):
            raise OSError(f"could not move {path} aside")
    if not fs.rename(beside, at):
        raise OSError(f"could not move {beside} to {path}")
    fs.delete(aside, True)


def save_part(df: DataFrame, folder: str, rank: int, part: int) -> None:
    """A checkpoint's part; written again it replaces itself, and an empty one keeps its columns."""
    write_parquet(df, f"{folder}/rank_{rank:03d}/part_{part:06d}")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files of up to 2 GB each, hashed on the executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def mark_done(spark: SparkSession, folder: str, rank: int, **said) -> None:
    write_json(spark, f"{folder}/rank_{rank:03d}.done.json", {"rank": rank, **said})


def wait_for(spark: SparkSession, folder: str, ranks: int, seconds: float, pause: float = 0.5) -> None:
    """Return when all ranks have their marks; raise TimeoutError with the missing ones after so many seconds."""
    until = time.monotonic() + seconds
    while missing := [r for r in range(ranks) if not exists(spark, f"{folder}/rank_{r:03d}.done.json")]:
        if time.monotonic() >= until:
            raise TimeoutError(f"ranks without a mark: {missing}")
        time.sleep(pause)


def unless_done(spark: SparkSession, sentinel: str, run: Callable[[], None], force: bool = False) -> bool:
    """Run a stage unless its sentinel is there; whether it ran."""
    if exists(spark, sentinel) and not force:
        return False
    run()
    return True


def sibling_seed(spark: SparkSession, trace_path: str) -> int | None:
    """The hash seed in the ``metadata.json`` beside a trace file; None without."""
    path = f"{trace_path.rsplit('/', 1)[0]}/metadata.json"
    found = read_json(spark, path).get("hash_seed") if exists(spark, path) else None
    return None if found is None else int(found)


def gamma_of(spark: SparkSession, folder: str) -> float:
    """Gamma in an experiment's hash configuration; 0.5 where that is missing or cannot be read."""
    try:
        return float(read_json(spark, f"{folder}/hash_seed/hash_config.json").get("gamma", 0.5))
    except (FileNotFoundError, TypeError, ValueError, AttributeError, Py4JJavaError):
        return 0.5


def provenance(spark: SparkSession, settings: dict, **paths: str) -> dict:
    """Settings with the path and digest of each named file; one that is missing raises."""
    out = dict(settings)
    for name, path in paths.items():
        if not exists(spark, path):
            raise FileNotFoundError(path)
        out |= {f"{name}_path": path, f"{name}_sha256": file_digests(spark, path).first()["sha256"]}
    return out


def report(rows: DataFrame, row: str, column: str, value: str, title: str) -> str:
    """A Markdown table of ``value`` by two keys; cells without one are dashes."""
    wide = rows.groupBy(row).pivot(column).agg(F.first(value)).orderBy(row)
    heads = wide.columns
    lines = [f"# {title}", "", f"| {' | '.join(heads)} |", f"|{'---|' * len(heads)}"]
    lines += [f"| {' | '.join('-' if v is None else f'{v:.4g}' if isinstance(v, float) else str(v) for v in r)} |" for r in wide.collect()]
    return "\n".join(lines) + "\n"
