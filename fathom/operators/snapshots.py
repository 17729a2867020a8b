"""Snapshots of tables by content: parts under the names of their checksums, and a manifest for each snapshot.

A table is dealt into parts by a hash of its key. A part's name comes from its schema, its row count and two order-free
sums of row hashes, so equal parts have equal names: a snapshot writes only parts that no snapshot before it holds, and
versions share the rest. Parts are written before the manifest; a folder without one is no snapshot. Before a restore
all is checked against the manifest: format and application, names, schemas, row counts and row hashes, and
limits of entries and bytes; a value changed in place is found though the counts are equal.

Checksums are made by Spark (one row a part reaches the driver), and parts are written by dynamic overwrite, so a
snapshot that died is simply taken again.

Defined cases: an empty table has no parts and comes back empty with its schema; nulls are hashed like values; repeated
rows count as often as they occur; the order of columns and of rows in files does not matter for restoring.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT = 2
APP = "fathom"
PARTS = 64
MOST_ENTRIES, MOST_BYTES = 100_000, 100 * 1024**3  # fixed limits of what is restored


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, place = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def _sums(rows: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """``by``, n, a, b: rows and two order-free sums of row hashes. Columns are hashed with whether they are null."""
    values = [x for c in sorted(columns) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    first, second = F.xxhash64(*values), F.xxhash64(F.lit("second"), *values)
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(first.cast("decimal(20,0)")).cast("string").alias("a"), F.sum(second.cast("decimal(20,0)")).cast("string").alias("b"))


def _plain(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def store(tables: dict[str, DataFrame], folder: str, label: str = "", keys: dict[str, list[str]] | None = None, parts: int = PARTS, created_ms: int | None = None) -> dict[str, int]:
    """Take a snapshot and return the number of parts written by table. ``keys``: columns by whose hash a table is
    dealt (its first column by default)."""
    spark = next(iter(tables.values())).sparkSession
    if bad := [n for n in tables if not n.isidentifier()]:
        raise ValueError(f"unsafe names {bad}")
    listed, written = [], {}
    for name, df in tables.items():
        schema = _plain(df.schema)
        own = (keys or {}).get(name) or df.columns[:1]
        dealt = df.withColumn("_part", F.pmod(F.xxhash64(*own), F.lit(parts)).cast("int"))
        found = {}
        for r in _sums(dealt, "_part", df.columns).collect():
            digest = hashlib.sha256(f"{schema.json()}:{r.n}:{r.a}:{r.b}".encode()).hexdigest()[:40]
            found[r["_part"]] = {"object": digest, "rows": r.n, "a": r.a, "b": r.b}
        there = {n.split("=")[1] for n in _names(spark, f"{folder}/objects/{name}") if "=" in n}
        new = {p: f["object"] for p, f in found.items() if f["object"] not in there}
        if new:
            named = F.create_map(*(F.lit(x) for pair in new.items() for x in pair))
            out = dealt.where(F.col("_part").isin(list(new))).withColumn("_object", named[F.col("_part")]).drop("_part")
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_object").parquet(f"{folder}/objects/{name}")
        written[name] = len(new)
        listed.append({"name": name, "schema": json.loads(schema.json()), "rows": sum(f["rows"] for f in found.values()), "parts": sorted(found.values(), key=lambda f: f["object"])})
    at = created_ms if created_ms is not None else spark.sql("SELECT unix_millis(current_timestamp())").first()[0]
    number = len(_names(spark, f"{folder}/manifests"))
    manifest = {"format": FORMAT, "app": APP, "label": label, "created_ms": at, "number": number, "tables": listed}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{folder}/manifests/{number:09d}")
    return written


def manifests(spark: SparkSession, folder: str) -> list[dict]:
    """All whole manifests, the latest first (by time, then by number)."""
    held = [n for n in _names(spark, f"{folder}/manifests") if "_SUCCESS" in _names(spark, f"{folder}/manifests/{n}")]
    found = [json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/manifests/{n}").collect())) for n in held]
    return sorted(found, key=lambda m: (m.get("created_ms", 0), m.get("number", 0)), reverse=True)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """number, label, created_ms, tables, rows of the snapshots, the latest first."""
    rows = [(i, m["number"], m["label"], m["created_ms"], len(m["tables"]), sum(t["rows"] for t in m["tables"])) for i, m in enumerate(manifests(spark, folder))]
    return spark.createDataFrame(rows, "place int, number long, label string, created_ms long, tables long, rows long").orderBy("place").drop("place")


def _chosen(spark: SparkSession, folder: str, number: int | None) -> dict:
    held = manifests(spark, folder)
    found = next((m for m in held if number is None or m.get("number") == number), None)
    if found is None:
        raise ValueError("no such snapshot")
    return found


def _read(spark: SparkSession, folder: str, table: dict) -> DataFrame:
    schema = T.StructType.fromJson(table["schema"])
    if not table["parts"]:
        return spark.createDataFrame([], T.StructType([*schema, T.StructField("_object", T.StringType())]))
    base = f"{folder}/objects/{table['name']}"
    found = spark.read.option("basePath", base).parquet(*(f"{base}/_object={p['object']}" for p in table["parts"]))
    return found.withColumn("_object", F.col("_object").cast("string"))


def problems(spark: SparkSession, folder: str, number: int | None = None, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES) -> list[str]:
    """What speaks against restoring a snapshot, the latest by default."""
    manifest = _chosen(spark, folder, number)
    found = [] if (manifest.get("format"), manifest.get("app")) == (FORMAT, APP) else ["format"]
    entries = sum(len(t["parts"]) for t in manifest["tables"])
    if entries > most_entries:
        return [*found, f"{entries} entries"]
    size = 0
    for t in manifest["tables"]:
        name = t["name"]
        if not name.isidentifier() or not all(p["object"].isalnum() for p in t["parts"]):
            found.append(f"unsafe name {name}")
            continue
        there = set(_names(spark, f"{folder}/objects/{name}"))
        if gone := [p["object"] for p in t["parts"] if f"_object={p['object']}" not in there]:
            found.append(f"{len(gone)} parts of {name} are missing")
            continue
        for p in t["parts"]:
            fs, place = _fs(spark, f"{folder}/objects/{name}/_object={p['object']}")
            size += fs.getContentSummary(place).getLength()
        rows = _read(spark, folder, t)
        stored = {(f.name, f.dataType.simpleString()) for f in rows.drop("_object").schema}
        if stored != {(f.name, f.dataType.simpleString()) for f in T.StructType.fromJson(t["schema"])}:
            found.append(f"schema of {name}")
            continue
        sums = {r["_object"]: (r.n, r.a, r.b) for r in _sums(rows, "_object", rows.drop("_object").columns).collect()}
        if sum(n for n, _, _ in sums.values()) != t["rows"]:
            found.append(f"rows of {name}")
        elif any(sums.get(p["object"]) != (p["rows"], p["a"], p["b"]) for p in t["parts"]):
            found.append(f"values of {name}")
    return [*found, f"{size} bytes"] if size > most_bytes else found


def restore(spark: SparkSession, folder: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot, the latest by default; refused if anything speaks against it."""
    if wrong := problems(spark, folder, number):
        raise ValueError(f"snapshot refused: {', '.join(wrong)}")
    manifest = _chosen(spark, folder, number)
    return {t["name"]: _read(spark, folder, t).select(*(f["name"] for f in t["schema"]["fields"])) for t in manifest["tables"]}


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are null or occur more than once."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.greatest(*(F.col(k).isNull().cast("int") for k in key), F.lit(0)).cast("boolean"))
