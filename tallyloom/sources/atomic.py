"""Small files that appear whole or not at all, in any store that Spark reaches.

What is written goes to a hidden sibling, is read back and compared by
SHA-256, and takes its name by a rename, which the file system makes atomic.
``create_text`` gives a file its first content only: of several that try, one
succeeds. Contents are held by the driver; tables have their own writers.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class WriteError(Exception):
    """What was read back isn't what was written; the file that was there is untouched."""


class _Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.path.getFileSystem(conf)
        self.path = self.files.makeQualified(self.path)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), conf)

    def read(self, path) -> bytes:
        stream = self.files.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put(self, data: bytes, replace: bool) -> bool:
        """Whether the file took its name; False if there is one already and it isn't to be replaced."""
        parent = self.path.getParent()
        self.files.mkdirs(parent)
        part = self.jvm.org.apache.hadoop.fs.Path(parent, f".{self.path.getName()}.{uuid.uuid4().hex}")
        try:
            stream = self.files.create(part, False)
            stream.write(bytearray(data))
            stream.hsync()
            stream.close()
            if hashlib.sha256(self.read(part)).digest() != hashlib.sha256(data).digest():
                raise WriteError(f"{self.path.toString()}: read back otherwise than written")
            kinds = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename")
            chosen = self.jvm.java.lang.reflect.Array.newInstance(kinds.NONE.getClass(), 1)
            chosen[0] = kinds.OVERWRITE if replace else kinds.NONE
            try:
                self.context.rename(part, self.path, chosen)
            except Py4JJavaError as e:
                if not replace and "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                    return False
                raise
            return True
        finally:
            if self.files.exists(part):
                self.files.delete(part, False)


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """Replace a file's content; its SHA-256."""
    data = text.encode()
    _Store(spark, path).put(data, True)
    return hashlib.sha256(data).hexdigest()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Give a file its content unless there is one; whether this call did."""
    store = _Store(spark, path)
    return not store.files.exists(store.path) and store.put(text.encode(), False)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A file's content, None where there is no file."""
    store = _Store(spark, path)
    return store.read(store.path).decode() if store.files.exists(store.path) else None


def write_json(spark: SparkSession, path: str, value: Any) -> str:
    """Replace a JSON file, keys sorted; its SHA-256."""
    return write_text(spark, path, json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n")


def read_json(spark: SparkSession, path: str) -> Any:
    text = read_text(spark, path)
    return None if text is None else json.loads(text)
