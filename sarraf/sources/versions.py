"""Stored tables that are published by version.

A table is a folder with immutable data folders and small version files. A version lists for each partition key the data
folders that its rows are in. A writer adds data folders, which no reader looks at yet, and then creates the next version
file: only one writer can create a number, and a file is there with all of its content or not at all. So a reader has one
version throughout, a crash at any point leaves the old or the new one, and whoever comes second starts from the version
that won. Folder names are made of encoded keys, and the column itself stays in the files, so null, empty and odd values
are told apart.

The file is created by a hard link on a local disk, else by a rename that does not overwrite, which HDFS does at once;
object stores without either need a store of their own for version files.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from ..plans.runtime import cut

#: Key of a table without a partition column; values of so many bytes at most are spelled out in folder names.
WHOLE, SPELLED = "all", 96


class Lost(Exception):
    """Others published first, again and again."""


@dataclass(frozen=True)
class Version:
    number: int
    by: str | None
    schema: StructType
    parts: dict[str, list[str]] = field(default_factory=dict)
    marks: dict[str, float] = field(default_factory=dict)


def key(value: str | None) -> str:
    """Folder name of a partition value; key_of says the same of a column."""
    if value is None:
        return "null"
    data = str(value).encode()
    return "v" + data.hex() if len(data) <= SPELLED else "h" + hashlib.sha256(data).hexdigest()


def key_of(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "null").when(F.octet_length(text) <= SPELLED, F.concat(F.lit("v"), F.lower(F.hex(text)))).otherwise(F.concat(F.lit("h"), F.sha2(text, 256)))


def _part(by: str | None) -> Column:
    return F.lit(WHOLE) if by is None else key_of(F.col(by))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark._jsc.hadoopConfiguration()), p


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are there, ascending."""
    fs, p = _fs(spark, path)
    at = p(f"{path}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def load(spark: SparkSession, path: str, number: int) -> Version:
    fs, p = _fs(spark, path)
    stream = fs.open(p(f"{path}/versions/{number:012d}.json"))
    try:
        said = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return Version(number, said["by"], StructType.fromJson(said["schema"]), said["parts"], said["marks"])


def latest(spark: SparkSession, path: str) -> Version | None:
    there = numbers(spark, path)
    return load(spark, path, there[-1]) if there else None


def publish(spark: SparkSession, path: str, version: Version) -> bool:
    """Creates a version's file; False if another writer has."""
    fs, p = _fs(spark, path)
    aside, target = p(f"{path}/versions/.{uuid.uuid4().hex}"), p(f"{path}/versions/{version.number:012d}.json")
    out = fs.create(aside, False)
    try:
        out.write(json.dumps({"by": version.by, "schema": version.schema.jsonValue(), "parts": version.parts, "marks": version.marks}).encode())
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(aside.toUri().getPath(), target.toUri().getPath())
            return True
        jvm = spark._jvm
        none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        none[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(aside, target, none)
        return True
    except Exception:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(aside, False)


def write_parts(df: DataFrame, path: str, by: str | None) -> dict[str, str]:
    """Writes rows into a new data folder: {key: folder}. A large partition is dealt over several tasks."""
    folder = f"data/{uuid.uuid4().hex}"
    df.withColumn("_part", _part(by)).hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{path}/{folder}")
    fs, p = _fs(df.sparkSession, path)
    names = [f.getPath().getName() for f in fs.listStatus(p(f"{path}/{folder}"))]
    return {n[6:]: f"{folder}/{n}" for n in names if n.startswith("_part=")}


def read(spark: SparkSession, path: str, keys: Iterable[str] | None = None, version: Version | int | None = None) -> DataFrame:
    """Rows of a version, the latest if none is named; with keys, only the folders of those partitions are opened."""
    v = load(spark, path, version) if isinstance(version, int) else version or latest(spark, path)
    if v is None:
        raise FileNotFoundError(f"{path} has no version")
    picked = v.parts if keys is None else {k: v.parts[k] for k in keys if k in v.parts}
    folders = [f"{path}/{f}" for fs in picked.values() for f in fs]
    return spark.read.schema(v.schema).parquet(*folders) if folders else spark.createDataFrame([], v.schema)


@dataclass
class Edit:
    """What a writer has found out: keys that it has read, new folders in place of theirs or beside them, keys to drop, and
    figures that the version is to carry."""

    touched: set[str]
    replaced: dict[str, list[str]] = field(default_factory=dict)
    added: dict[str, list[str]] = field(default_factory=dict)
    dropped: set[str] = field(default_factory=set)
    marks: dict[str, float] = field(default_factory=dict)

    def of(self, held: Version) -> Version:
        parts = {k: v for k, v in held.parts.items() if k not in self.dropped} | {k: v for k, v in self.replaced.items() if v}
        parts = {k: v for k, v in parts.items() if k not in self.replaced or self.replaced[k]}
        return replace(held, number=held.number + 1, parts=parts | {k: [*parts.get(k, []), *v] for k, v in self.added.items()}, marks=held.marks | self.marks)


def commit(spark: SparkSession, path: str, by: str | None, schema: StructType, work: Callable[[Version], Edit | None], tries: int = 20) -> Version | None:
    """Publishes what work finds against the latest version. Where another writer comes first, work is done again only if
    that one changed a partition that it had read; else its folders go into the next version as they are."""
    edit, base = None, None
    for _ in range(tries):
        held = latest(spark, path) or Version(0, by, schema)
        if held.by != by:
            raise ValueError(f"{path} is partitioned by {held.by}")
        held = replace(held, schema=wider(held.schema, schema))
        if base is None or held.schema != base.schema or held.marks != base.marks or any(held.parts.get(k) != base.parts.get(k) for k in edit.touched):
            edit, base = work(held), held
        if edit is None:
            return held if held.number else None
        new = edit.of(held)
        if publish(spark, path, new):
            return new
    raise Lost(f"{path}: {tries} versions were published by others meanwhile")


def wider(held: StructType, more: StructType) -> StructType:
    """Fields of a table and those that a batch adds; a field keeps the type that it has, and all may be null."""
    known = {f.name for f in held.fields}
    fields = [*held.fields, *(f for f in more.fields if f.name not in known)]
    return StructType.fromJson({"type": "struct", "fields": [f.jsonValue() | {"nullable": True} for f in fields]})


def first_rows(df: DataFrame, by: list[str], order: str = "source_row_no") -> DataFrame:
    """One row a key: least in order (null last), then in the hash of its columns, so that a rerun keeps the same one."""
    hashed = F.xxhash64(*(F.to_json(f.name) if isinstance(f.dataType, MapType) else F.col(f.name) for f in df.schema.fields))
    rank = F.struct(*([F.col(order).isNull().alias("a"), F.col(order).alias("b")] if order in df.columns else []), hashed.alias("c"))
    return df.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.min_by(F.struct(*df.columns), rank).alias("_r")).select("_r.*")


def _same(left: str, right: str, cols: list[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def _keys(df: DataFrame, by: str | None) -> set[str]:
    return {r[0] for r in df.select(_part(by).alias("_part")).distinct().collect()}  # one row a partition of the batch


def _fitted(df: DataFrame, schema: StructType) -> DataFrame:
    """A batch's own columns in the table's types."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in df.columns))


def upsert(batch: DataFrame, path: str, by: str | None, on: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], renewed: list[str], order: str = "source_row_no") -> Version | None:
    """Adds new keys, and renews the given columns of known ones by merge(held, batch). Null is a key like others.

    Only partitions of the batch are read. One in which a known row changes is written anew, one that only gains rows
    gets a folder more, and a batch that changes nothing publishes nothing.
    """
    spark = batch.sparkSession
    first = cut(first_rows(batch, on, order))

    def work(held: Version) -> Edit | None:
        rows = _fitted(first, held.schema)
        touched = _keys(rows, by)
        fresh, changed = rows, set()
        if touched & set(held.parts):
            # Keys and renewed columns meet, not whole rows; keys that are known are stored, and are few or none where a batch adds.
            again, place = [c for c in renewed if c in rows.columns], [by] if by and by not in on else []
            known = read(spark, path, touched, held).select(*on, *place, *(c for c in again if c not in (*on, *place)))
            met = known.alias("o").join(rows.select(*on, *(c for c in again if c not in on)).alias("n"), _same("o", "n", on))
            met = cut(met.select(*(F.col(f"o.{c}").alias(c) for c in (*on, *place)), (~_same("o", "n", again)).alias("_changed")))
            fresh = rows.alias("n").join(met.alias("o"), _same("o", "n", on), "left_anti")
            changed = _keys(met.filter("_changed"), by)
        edit = Edit(touched)
        if changed:
            mine = _part(by).isin(sorted(changed))
            whole = write_parts(merge(read(spark, path, changed, held), rows.filter(mine)), path, by)
            edit.replaced = {k: [f] for k, f in whole.items()}
            fresh = fresh.filter(~mine)
        edit.added = {k: [f] for k, f in write_parts(_padded(fresh, held.schema), path, by).items()}
        return edit if edit.replaced or edit.added else None

    return commit(spark, path, by, first.schema, work)


def _padded(df: DataFrame, schema: StructType) -> DataFrame:
    return df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def append_new(batch: DataFrame, path: str, by: str | None, on: list[str], order: str = "source_row_no") -> Version | None:
    """Keep-first insert: known keys stay as they are."""
    return upsert(batch, path, by, on, lambda held, _: held, [], order)


def drop_keys(spark: SparkSession, path: str, keys: Iterable[str]) -> Version | None:
    """A version without the given partitions; no data is read or written."""

    def work(held: Version) -> Edit | None:
        there = set(keys) & set(held.parts)
        return Edit(there, dropped=there) if there else None

    held = latest(spark, path)
    return held and commit(spark, path, held.by, held.schema, work)


def delete_matching(spark: SparkSession, path: str, gone: DataFrame, on: list[str]) -> Version | None:
    """A version without the rows whose key is in `gone`; only data folders that hold such rows are written anew."""
    gone = cut(gone.select(*on).distinct())

    def work(held: Version) -> Edit | None:
        rows = read(spark, path, None, held).select("*", F.regexp_extract("_metadata.file_path", "(data/[^/]+/_part=[^/]+)/[^/]+$", 1).alias("_folder"))
        hit = {r[0] for r in rows.join(gone, on, "left_semi").select("_folder").distinct().collect()}
        if not hit:
            return None
        edit = Edit({k for k, folders in held.parts.items() if hit & set(folders)})
        left = read(spark, path, None, replace(held, parts={k: [f for f in held.parts[k] if f in hit] for k in edit.touched})).join(gone, on, "left_anti")
        kept = write_parts(left, path, held.by)
        edit.replaced = {k: [f for f in held.parts[k] if f not in hit] + ([kept[k]] if k in kept else []) for k in edit.touched}
        return edit

    held = latest(spark, path)
    return held and commit(spark, path, held.by, held.schema, work)


def compact(spark: SparkSession, path: str, most: int = 8) -> Version | None:
    """Partitions of more than so many folders become one folder each."""

    def work(held: Version) -> Edit | None:
        many = {k for k, folders in held.parts.items() if len(folders) > most}
        return Edit(many, replaced={k: [f] for k, f in write_parts(read(spark, path, many, held), path, held.by).items()}) if many else None

    held = latest(spark, path)
    return held and commit(spark, path, held.by, held.schema, work)


def vacuum(spark: SparkSession, path: str, keep: int = 10, grace: float = 86_400) -> int:
    """Removes all but the last versions, and data folders that none of these lists; how many folders went. Younger ones
    than the grace (seconds) stay, since a writer may be about to publish them."""
    fs, p = _fs(spark, path)
    there = numbers(spark, path)
    listed = {f for n in there[-keep:] for folders in load(spark, path, n).parts.values() for f in folders}
    for n in there[:-keep]:
        fs.delete(p(f"{path}/versions/{n:012d}.json"), False)
    gone, before = 0, (time.time() - grace) * 1000
    for batch in fs.listStatus(p(f"{path}/data")) if fs.exists(p(f"{path}/data")) else []:
        if batch.getModificationTime() > before:
            continue
        parts = [f.getPath().getName() for f in fs.listStatus(batch.getPath()) if f.isDirectory()]
        names = {n: f"data/{batch.getPath().getName()}/{n}" for n in parts}
        dead = [n for n, f in names.items() if f not in listed]
        for n in dead:
            fs.delete(p(f"{path}/{names[n]}"), True)
        gone += len(dead)
        if len(dead) == len(parts):
            fs.delete(batch.getPath(), True)
    return gone
