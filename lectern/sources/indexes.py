"""Retrieval indexes of many lectures: bucketed folders, and snapshots that tell which of them are an index's present state.

    <base>/data/<version>/<new or carried>/collection=<parents or children, with the mode's suffix>/bucket=<n>/...parquet
    <base>/snapshots/<number>.json

A write makes folders of its own version and then one snapshot file, which swaps the whole index at once: readers open the
newest snapshot and see its folders alone, whatever is written meanwhile.  Folders follow buckets and modes, not lectures.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.tables import keep, release

SUFFIX = {"combined": "_asr_ocr_mix", "ocr": "_ocr", "asr": "_asr"}
BUCKETS = 64
KEY = ["video_id", "store_mode"]


def index_name(base: str, mode: str) -> str:
    return base + SUFFIX[mode]


def sibling_mode(mode: str) -> str:
    if mode not in ("asr", "ocr"):
        raise ValueError(f"{mode} has no sibling")
    return {"asr": "ocr", "ocr": "asr"}[mode]


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, base: str):
    return _path(spark, base).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing if there is no such folder."""
    files, at = _files(spark, folder), _path(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def _snapshots(spark: SparkSession, base: str) -> list[int]:
    return [int(n[:-5]) for n in _names(spark, f"{base}/snapshots") if n.endswith(".json") and not n.startswith("_")]


def _snapshot(spark: SparkSession, base: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{base}/snapshots/{number:010d}.json", wholetext=True).first()[0])


def read_snapshot(spark: SparkSession, base: str) -> dict | None:
    """The newest snapshot: ``number``, ``buckets``, ``schemas`` by kind, and ``folders``: for each collection the list of folders of
    each bucket.  Its size follows buckets, not rows."""
    numbers = _snapshots(spark, base)
    return _snapshot(spark, base, max(numbers)) if numbers else None


def _publish(spark: SparkSession, base: str, state: dict) -> None:
    """Writes the snapshot under a name that no reader looks at, and renames it: a failed write leaves no snapshot, and of two
    writers at a time the second one fails."""
    files = _files(spark, base)
    final, draft = _path(spark, f"{base}/snapshots/{state['number']:010d}.json"), _path(spark, f"{base}/snapshots/_{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise RuntimeError(f"another write has published snapshot {state['number']} of {base}; write again")


def _write(df: DataFrame, kind: str, path: str, buckets: int) -> None:
    """One pass over the rows; a bucket's rows come to few files, and large buckets are still split."""
    names = F.create_map(*[F.lit(x) for mode in SUFFIX for x in (mode, index_name(kind, mode))])
    df = df.withColumn("collection", names[F.col("store_mode")]).withColumn("bucket", _bucket(buckets))
    df.hint("rebalance", "collection", "bucket").sortWithinPartitions("collection", "bucket", "video_id").write.partitionBy("collection", "bucket").parquet(path)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int")


def _found(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """The folders of a write, by collection and bucket."""
    return {c.removeprefix("collection="): {b.removeprefix("bucket="): f"{path}/{c}/{b}" for b in _names(spark, f"{path}/{c}") if b.startswith("bucket=")} for c in _names(spark, path) if c.startswith("collection=")}


def write_index(parents: DataFrame, children: DataFrame, base: str, embed: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS) -> int:
    """Replaces what the lectures and modes of the parents held, children too where there are none now; others are not
    touched.  Children of a lecture and mode without any parent are not written.  Returns the number of the snapshot.

    Parents and children are evaluated once each; ``embed`` is applied to the children that are written.  The rows of other lectures in
    the buckets concerned are carried over to the new version; all other buckets keep their folders.  The number of
    buckets is that of the index's first write."""
    spark = parents.sparkSession
    base = base.rstrip("/")
    now = read_snapshot(spark, base) or {"number": 0, "buckets": buckets, "schemas": {}, "folders": {}}
    buckets, version = now["buckets"], f"{base}/data/{uuid.uuid4().hex}"
    fresh = {"parents": f"{version}/new/parents", "children": f"{version}/new/children"}
    _write(parents, "parents", fresh["parents"], buckets)
    schemas = {"parents": parents.schema}
    given = _read(spark, [f for by in _found(spark, fresh["parents"]).values() for f in by.values()], parents.schema)
    keys = keep(given.select(*KEY).distinct())
    children = children.join(keys, KEY, "left_semi")
    children = embed(children) if embed else children
    _write(children, "children", fresh["children"], buckets)
    schemas["children"] = children.schema

    touched = {(r.store_mode, r.bucket) for r in keys.select("store_mode", _bucket(buckets).alias("bucket")).distinct().collect()}  # modes x buckets
    folders = {c: dict(by) for c, by in now["folders"].items()}
    for kind, path in fresh.items():
        old = []
        for mode, bucket in touched:
            old += folders.get(index_name(kind, mode), {}).pop(str(bucket), [])
        written = [path]
        if old:
            stay = _read(spark, old, StructType.fromJson(now["schemas"][kind])).join(keys, KEY, "left_anti")
            _write(stay, kind, f"{version}/carried/{kind}", buckets)
            written.append(f"{version}/carried/{kind}")
        for path in written:
            for collection, by in _found(spark, path).items():
                for bucket, folder in by.items():
                    folders.setdefault(collection, {}).setdefault(bucket, []).append(folder)
    known = {k: StructType.fromJson(s) for k, s in now["schemas"].items()}
    merged = {k: StructType([*s.fields, *[f for f in known.get(k, StructType([])).fields if f.name not in s.names]]).jsonValue() for k, s in schemas.items()}
    release(keys)
    _publish(spark, base, {"number": now["number"] + 1, "buckets": buckets, "schemas": merged, "folders": folders})
    return now["number"] + 1


def _read(spark: SparkSession, folders: list[str], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_index(spark: SparkSession, base: str, mode: str, number: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Parents and children of one mode, as the newest snapshot (or that of a number) has them; only this mode's folders are read.
    The tables stay as they are while others write.  A collection without rows is empty."""
    base = base.rstrip("/")
    state = read_snapshot(spark, base) if number is None else _snapshot(spark, base, number)
    if state is None:
        raise ValueError(f"no index at {base}")
    return tuple(_read(spark, sum(state["folders"].get(index_name(kind, mode), {}).values(), []), StructType.fromJson(state["schemas"][kind])) for kind in ("parents", "children"))


def read_sibling(spark: SparkSession, base: str, mode: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children of the other mode of speech and slide text; an error for the combined one."""
    return read_index(spark, base, sibling_mode(mode))


def expire_snapshots(spark: SparkSession, base: str, keep_last: int = 2) -> None:
    """Deletes older snapshots than the last ones, and versions that none of those left names (readers of older ones fail then, and so
    does a write that goes on meanwhile)."""
    base = base.rstrip("/")
    files, numbers = _files(spark, base), _snapshots(spark, base)
    for n in numbers[: max(0, len(numbers) - max(1, keep_last))]:
        files.delete(_path(spark, f"{base}/snapshots/{n:010d}.json"), False)
    used = {f.removeprefix(f"{base}/data/").split("/")[0] for n in _snapshots(spark, base) for by in _snapshot(spark, base, n)["folders"].values() for fs in by.values() for f in fs}
    for version in _names(spark, f"{base}/data"):
        if version not in used:
            files.delete(_path(spark, f"{base}/data/{version}"), True)
