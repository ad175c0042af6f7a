"""Sealed tables: columns under AES-GCM inside Spark, and key files."""

from __future__ import annotations

import contextlib
import json
import os
import secrets
import stat
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provenspark.sources.store import TABLES, Store

MARK = "provenspark-seal-1"


class SealError(ValueError):
    """A wrong key, a changed table, or a key file that others may read."""


def generate_key(path: str, overwrite: bool = False) -> str:
    """32 random bytes that only their owner may read."""
    if os.path.exists(path) and not overwrite:
        raise SealError(f"{path} exists")
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "wb") as f:
        f.write(secrets.token_bytes(32))
    return path


def load_key(path: str, strict: bool = True) -> bytes:
    if strict and stat.S_IMODE(os.stat(path).st_mode) & 0o077:
        raise SealError(f"{path} is readable by others")
    with open(path, "rb") as f:
        key = f.read()
    if len(key) != 32:
        raise SealError("a key has 32 bytes")
    return key


def seal(df: DataFrame, path: str, key: bytes) -> None:
    """Each row as one authenticated, encrypted value; the schema is kept beside it as a sealed row too."""
    spark = df.sparkSession
    enc = lambda c: F.aes_encrypt(c, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), F.lit(MARK))
    df.select(enc(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).cast("binary")).alias("sealed")).write.parquet(f"{path}/rows")
    spark.createDataFrame([(df.schema.json(),)], "s string").select(enc(F.col("s").cast("binary")).alias("sealed")).write.parquet(f"{path}/schema")


def unseal(spark, path: str, key: bytes) -> DataFrame:
    """The rows; a wrong key or a changed value gives SealError, here for the schema and on reading for rows."""
    dec = F.try_aes_decrypt("sealed", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(MARK)).cast("string")
    told = spark.read.parquet(f"{path}/schema").select(dec.alias("s")).first()["s"]
    if told is None:
        raise SealError("wrong key or changed table")
    checked = F.coalesce(dec, F.raise_error(F.lit("wrong key or changed row")))
    return spark.read.parquet(f"{path}/rows").select(F.from_json(checked, StructType.fromJson(json.loads(told))).alias("r")).select("r.*")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def seal_store(store: Store, path: str, key: bytes, shred: bool = False) -> list[str]:
    """Every table that holds something, sealed below path; with shred the plain store is deleted afterwards."""
    names = [name for name in TABLES if store.exists(name)]
    for name in names:
        seal(store.read(name), f"{path.rstrip('/')}/{name}", key)
    if shred:
        fs, at = _folder(store.spark, store.root)
        fs.delete(at, True)
    return names


@contextlib.contextmanager
def opened(spark: SparkSession, path: str, key: bytes, work: str) -> Iterator[Store]:
    """A sealed store as a plain one in a fresh folder below work; sealed again and the plain one deleted at the end.

    The new seal is written beside the old one and takes its place in one
    rename; after an error inside, the old one stays as it was.
    """
    root = path.rstrip("/")
    store = Store(spark, f"{work.rstrip('/')}/plain-{uuid.uuid4().hex}")
    fs, at = _folder(spark, root)
    held = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    plain_fs, plain = _folder(spark, store.root)
    try:
        if held:
            store.write({name: unseal(spark, f"{root}/{name}", key) for name in held}, "unsealed")
        yield store
        fresh = f"{root}-{uuid.uuid4().hex}"
        seal_store(store, fresh, key)
        if fs.exists(_folder(spark, fresh)[1]):
            fs.delete(at, True)
            fs.rename(_folder(spark, fresh)[1], at)
    finally:
        plain_fs.delete(plain, True)
