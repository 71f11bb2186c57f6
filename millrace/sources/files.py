"""Scans and sinks of record files."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StringType, StructType


def read_many(spark: SparkSession, *paths: str, most: int = 0, seed: int | None = None) -> DataFrame:
    """Parquet files as one relation with an explicit order: file_no (place in paths), file, position in the file.

    most: the first so many rows in that order, or with a seed so many drawn by a hash of their place; 0 takes all.
    """
    rows = None
    for k, path in enumerate(paths):
        some = spark.read.parquet(path)
        some = some.select("*", F.lit(k).alias("file_no"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("position"))
        rows = some if rows is None else rows.unionByName(some, allowMissingColumns=True)
    if not most:
        return rows
    place = ["file_no", "file", "position"]
    return rows.orderBy(*([F.xxhash64(F.lit(seed), *place)] if seed is not None else []), *place).limit(most)


def walked(rows: DataFrame, column: str, keys: tuple[str, ...] = ()) -> Column:
    """A field inside a column: structs are entered by key, maps by key, and arrays of one element by that element (others raise)."""
    x, kind = F.col(column), rows.schema[column].dataType
    for key in (*keys, None):
        while isinstance(kind, ArrayType):
            x = F.when(F.size(x) == 1, F.get(x, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit(f"{column} has not one element but "), F.size(x).cast("string"))))
            kind = kind.elementType
        if key is not None:
            x, kind = x[key], kind.valueType if isinstance(kind, MapType) else kind[key].dataType
    return x


def prompt_rows(rows: DataFrame, prompt: str = "prompt", longest: int | None = None, length: Column | None = None) -> DataFrame:
    """Rows for rollouts: those whose prompt is no longer than ``longest`` by the given length (default: characters of all messages)."""
    if longest is None:
        return rows
    chars = F.aggregate(F.col(prompt), F.lit(0), lambda a, m: a + F.char_length(m["content"]))
    return rows.where(F.coalesce(chars if length is None else length, F.lit(longest + 1)) <= longest)


def answer_rows(rows: DataFrame, prompt: str, response: str, prompt_keys: tuple[str, ...] = (), response_keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds the prompt and response of supervised rows, from inside nested columns."""
    return rows.withColumns({"prompt": walked(rows, prompt, prompt_keys), "response": walked(rows, response, response_keys)})


def preference_rows(rows: DataFrame, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """prompt, chosen and rejected of preference rows; a row without one of them raises."""
    need = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a row has no {c}")).cast("string"))
    return rows.select(need(prompt).alias("prompt"), need(chosen).alias("chosen"), need(rejected).alias("rejected"))


def verified(spark: SparkSession, root: str, name: str, digest: str, schema: StructType, records: int | None = None) -> DataFrame:
    """The records of a JSONL file that lies below root, has the digest, and as many lines as said; else an error."""
    if name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"{name} leaves the root")
    path = f"{root}/{name}"
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).collect()  # one file: one digest
    if [r[0] for r in found] != [digest.lower()]:
        raise ValueError(f"{name} does not have the digest")
    good, bad = scan_jsonl(spark, path, schema)
    if bad.limit(1).count() or (records is not None and good.count() != records):
        raise ValueError(f"{name} does not hold {records} intact records")
    return good


def canonical_json(value) -> str:
    """Sorted keys, no spaces, other than ASCII kept, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def record_hash(record: dict) -> str:
    return hashlib.sha256(canonical_json({k: v for k, v in record.items() if k != "record_hash"}).encode()).hexdigest()


def _strict(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate key")
    return out


def _no_constant(name):
    raise ValueError(name)


def _is_intact(line: str | None) -> bool:
    """A record that parses strictly and carries its own hash."""
    try:
        record = json.loads(line, object_pairs_hook=_strict, parse_constant=_no_constant)
        return isinstance(record, dict) and record.get("record_hash") == record_hash(record)
    except (TypeError, ValueError):
        return False


@F.pandas_udf(BooleanType())
def _intact(lines: pd.Series) -> pd.Series:
    return lines.map(_is_intact).astype(bool)


def scan_jsonl(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Records, and the lines that do not parse, repeat a key, hold NaN or do not match their record_hash."""
    lines = spark.read.text(path, lineSep="\n").where(F.length("value") > 0).withColumn("ok", _intact("value"))
    good = lines.where("ok").select(F.from_json("value", schema).alias("r")).select("r.*")
    return good, lines.where(~F.col("ok")).select(F.col("value").alias("line"))


def _seal(text: str) -> str:
    record = json.loads(text)
    return canonical_json(record | {"record_hash": record_hash(record)})


@F.pandas_udf(StringType())
def _sealed(texts: pd.Series) -> pd.Series:
    return texts.map(_seal)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Appends canonical lines with their hash; the commit protocol makes the append whole or not at all."""
    text = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    rows.select(_sealed(text).alias("value")).write.mode("append").text(path)


def evaluation_results(spark: SparkSession, path: str) -> DataFrame:
    """Result documents: a bare array, or an object with ``results``; one row per result with its file."""
    rows = spark.read.option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    if "results" not in rows.columns:
        return rows
    inner = rows.where(F.col("results").isNotNull()).select("file", F.explode("results").alias("r")).select("file", "r.*")
    return inner


def generation_dumps(spark: SparkSession, path: str, mask: str | None = None) -> DataFrame:
    """``<step>.jsonl`` dumps with their step; mask hides what a pattern matches in string columns."""
    rows = spark.read.json(path).withColumn("step", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json", 1).cast("long"))
    if mask:
        rows = rows.select(*[F.regexp_replace(c, mask, "***").alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
    return rows


def tree_manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, size and digest of each file, and in ``tree`` the digest of all of them in path order."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))
    tree = files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "size", "digest"))), "\n"), 256).alias("tree"))
    return files.crossJoin(F.broadcast(tree))  # one row: the digest of a listing, a line for each file


def write_trainer_parquet(rows: DataFrame, path: str, *order: str) -> str:
    """One sorted Parquet folder; returns the digest of its canonical rows (bytes of files differ by writer)."""
    rows.repartitionByRange(1, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    back = rows.sparkSession.read.parquet(path)
    return back.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(F.to_json(F.struct(*back.columns), {"ignoreNullFields": "false"}), 256))), "\n"), 256)).first()[0]


def manifest(stage: str, config: dict, counts: dict[str, int], upstream: list[str]) -> dict:
    """A small run record on the driver: identity is a hash of stage, config and upstream hashes."""
    body = {"schema_version": "run_v1", "stage": stage, "config_hash": hashlib.sha256(canonical_json(config).encode()).hexdigest(), "counts": counts, "upstream_manifest_hashes": sorted(upstream)}
    run = {k: body[k] for k in ("stage", "config_hash", "upstream_manifest_hashes")}
    body["run_id"] = f"{stage}_{hashlib.sha256(canonical_json(run).encode()).hexdigest()[:40]}"
    return body | {"output_manifest_hash": hashlib.sha256(canonical_json(body).encode()).hexdigest()}


def write_manifest(spark: SparkSession, path: str, payload: dict, created_at: str) -> str:
    """Writes a manifest whole or not at all (a temporary file beside it, then a rename) and returns the digest of its content.

    The digest leaves out itself and the time. A payload that is no canonical JSON changes nothing.
    """
    body = {k: v for k, v in payload.items() if k not in ("created_at_utc", "output_manifest_hash")}
    digest = hashlib.sha256(canonical_json(body).encode()).hexdigest()
    text = canonical_json(body | {"created_at_utc": created_at, "output_manifest_hash": digest})
    fs_of, options = spark._jvm.org.apache.hadoop.fs, spark._jvm.org.apache.hadoop.fs.Options.Rename
    target, late = fs_of.Path(path), fs_of.Path(f"{path}.{digest[:16]}.partial")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(late, True)
    out.write(bytearray(text.encode()))
    out.close()
    renames = spark.sparkContext._gateway.new_array(options, 1)
    renames[0] = options.OVERWRITE
    fs_of.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(late), fs.makeQualified(target), renames)
    return digest


def recover_tail(path: str) -> str | None:
    """Moves what stands behind the last line end of a local log to the next free ``<stem>.<k>.quarantine`` beside it; its name, or None if the log is whole."""
    log = Path(path)
    data = log.read_bytes()
    keep = data.rfind(b"\n") + 1
    if keep == len(data):
        return None
    for k in itertools.count():
        aside = log.with_name(f"{log.stem}.{k}.quarantine")
        try:
            with aside.open("xb") as f:
                f.write(data[keep:])
                f.flush()
                os.fsync(f.fileno())
        except FileExistsError:
            continue
        with log.open("r+b") as f:
            f.truncate(keep)
            os.fsync(f.fileno())
        return str(aside)


def check_lineage(manifests: dict[str, dict], head: str, deepest: int = 12) -> list[str]:
    """Hashes from a manifest up to its sources; raises on tampering, cycles and depth."""
    seen: list[str] = []

    def walk(h: str, path: tuple[str, ...]) -> None:
        if h in path or len(path) > deepest:
            raise ValueError("cycle in lineage" if h in path else "lineage too deep")
        body = {k: v for k, v in manifests[h].items() if k != "output_manifest_hash"}
        if hashlib.sha256(canonical_json(body).encode()).hexdigest() != h:
            raise ValueError(f"manifest {h} was changed")
        if h not in seen:
            seen.append(h)
        for u in body["upstream_manifest_hashes"]:
            walk(u, (*path, h))

    walk(head, ())
    return seen
