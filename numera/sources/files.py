"""Sources and sinks.  Everything goes through Spark's own readers, so any file system it knows will do."""

from __future__ import annotations

import ast
import io
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("csv", "parquet", "json", "orc")


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table of a built-in format; text formats need their schema, so no pass over the data is spent on guessing it."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.options(**({"header": "true"} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    writer = df.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def read_npy(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """Arrays of ``dims`` dimensions in .npy and .npz files, in long form: (path, member, i0.., value)."""
    names = [f"i{k}" for k in range(dims)]

    def load(batches):
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                got = np.load(io.BytesIO(content), allow_pickle=False)
                for member, a in got.items() if hasattr(got, "items") else [("", got)]:
                    if a.ndim != dims:
                        raise ValueError(f"{p} {member} has {a.ndim} dimensions, not {dims}")
                    out = pd.DataFrame({n: x.ravel() for n, x in zip(names, np.indices(a.shape))})
                    out.insert(0, "member", member)
                    out.insert(0, "path", p)
                    out["value"] = a.ravel().astype(float)
                    yield out

    schema = "path string, member string, " + "".join(f"{n} long, " for n in names) + "value double"
    return _files(spark, path, "*.np[yz]").select("path", "content").mapInPandas(load, schema)


def write_members(members: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """Several arrays under one name: a Parquet table per member."""
    for name, df in members.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


NODES = "path string, node_id int, parent_id int, arg_pos int, depth int, op string, name string, line int"


def python_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The syntax trees of Python files as rows; files that do not parse give one row of op SyntaxError.  Nothing is imported or run."""

    def parse(batches):
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"]):
                try:
                    todo, at = [(ast.parse(content.decode("utf-8", "replace")), None, 0, 0)], 0
                except (SyntaxError, ValueError) as e:
                    rows.append((p, 0, None, 0, 0, "SyntaxError", str(e)[:200], getattr(e, "lineno", None)))
                    continue
                while todo:
                    node, parent, pos, depth = todo.pop()
                    name = next((str(v) for k in ("id", "name", "attr", "module", "arg") if (v := getattr(node, k, None)) is not None), None)
                    rows.append((p, at, parent, pos, depth, type(node).__name__, name, getattr(node, "lineno", None)))
                    todo += [(c, at, i, depth + 1) for i, c in enumerate(ast.iter_child_nodes(node))]
                    at += 1
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])
            yield out.astype({c: "Int32" for c in ("node_id", "parent_id", "arg_pos", "depth", "line")})

    return _files(spark, path, "*.py").select("path", "content").mapInPandas(parse, NODES)


def imports(nodes: DataFrame) -> DataFrame:
    """(path, module): what each file imports."""
    own = nodes.where("op = 'ImportFrom' and name is not null").select("path", F.col("name").alias("module"))
    plain = nodes.where("op = 'Import'").select("path", F.col("node_id").alias("parent_id"))
    alias = nodes.where("op = 'alias'").join(plain, ["path", "parent_id"]).select("path", F.col("name").alias("module"))
    return own.union(alias).distinct()


#: Calls that write results, and the kind of output.
SINKS = {"to_csv": "TABLE", "to_parquet": "TABLE", "to_netcdf": "DATASET", "save": "ARRAY", "savez": "ARRAY", "savez_compressed": "ARRAY", "dump": "STREAM"}


def sinks(nodes: DataFrame) -> DataFrame:
    """(path, line, call, kind): the calls of a file that write results."""
    kind = F.create_map(*(F.lit(x) for kv in SINKS.items() for x in kv))
    calls = nodes.where("op = 'Call'").select("path", F.col("node_id").alias("parent_id"), F.col("line").alias("at"))
    called = nodes.where("op in ('Attribute', 'Name') and arg_pos = 0").join(calls, ["path", "parent_id"])
    return called.select("path", F.col("at").alias("line"), F.col("name").alias("call"), kind[F.col("name")].alias("kind")).where("kind is not null")


_SYMBOLS = {
    "*.rs": re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(fn|struct|enum|trait|mod|use)\s+([\w:]+)", re.M),
    "*.cpp": re.compile(r"^\s*(#include|class|struct|namespace)\s*[<\"]?([\w:./]+)", re.M),
}


def source_symbols(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, kind, name, line) of the definitions and imports in Rust (*.rs) or C++ (*.cpp, *.h, *.hpp) files."""
    pattern = _SYMBOLS["*.rs" if glob.endswith("rs") else "*.cpp"]

    def scan(batches):
        for b in batches:
            rows = [
                (p, m[1], m[2], text.count("\n", 0, m.start(1)) + 1)
                for p, text in zip(b["path"], (c.decode("utf-8", "replace") for c in b["content"]))
                for m in pattern.finditer(text)
            ]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "line"])

    return _files(spark, path, glob).select("path", "content").mapInPandas(scan, "path string, kind string, name string, line int")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, role, uri) of documentation inventories (objects.inv, version 2)."""
    line = re.compile(r"(.+?)\s+(\S+)\s+(-?\d+)\s+?(\S*)\s+(.*)")

    def load(batches):
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"]):
                head, body = content.split(b"\n", 4)[:4], content.split(b"\n", 4)[4]
                if b"version 2" not in head[0]:
                    raise ValueError(f"{p} is not a version 2 inventory")
                for m in map(line.match, zlib.decompress(body).decode("utf-8").splitlines()):
                    if m:
                        uri = m[4][:-1] + m[1] if m[4].endswith("$") else m[4]
                        rows.append((p, m[1], m[2], uri))
            yield pd.DataFrame(rows, columns=["path", "name", "role", "uri"])

    return _files(spark, path, "*.inv").select("path", "content").mapInPandas(load, "path string, name string, role string, uri string")


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, sha256) of the files under ``path``."""
    return _files(spark, path, glob).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status) of files that are MISSING, CHANGED or ADDED against a recorded manifest."""
    a, b = recorded.select("path", F.col("sha256").alias("was")), now.select("path", F.col("sha256").alias("is"))
    status = F.when(F.col("is").isNull(), "MISSING").when(F.col("was").isNull(), "ADDED").when(F.col("is") != F.col("was"), "CHANGED")
    return a.join(b, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def lookup(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """(key, payload, status): cached payloads by key, HIT only where the payload's digest holds."""
    j = requests.select("key").join(cache, "key", "left")
    good = F.sha2("payload", 256) == F.col("digest")
    return j.select("key", F.when(good, F.col("payload")).alias("payload"), F.when(F.col("payload").isNull(), "MISS").when(good, "HIT").otherwise("CORRUPT").alias("status"))
