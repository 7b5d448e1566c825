"""Source corpora as tables: (repo, path, ext, text, size, sha256), one row per file."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where mapper files lie, besides what a profile says.
MAPPER_XML = ["**/mapper/**/*.xml", "**/mappers/**/*.xml", "**/sqlmap/**/*.xml", "**/sqlmaps/**/*.xml", "**/*Mapper.xml", "**/*Mapper*.xml"]


def _unix_ends(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _file_columns(df: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return df.withColumn("ext", F.regexp_extract(name, r".(\.[^.]*)$", 1)).withColumn("sha256", F.sha2("text", 256))


def read_corpus(spark: SparkSession, root: str, exts: Sequence[str], skip_dirs: Sequence[str] = ()) -> DataFrame:
    """Text files under ``root``, whose first folder is the repo. Invalid UTF-8 becomes U+FFFD, binary files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:/*"
    base = re.sub(scheme, "", root).strip("/")
    rel = F.regexp_replace(F.regexp_replace("path", scheme, ""), f"^.*?\\Q{base}\\E/", "")
    files = raw.select(F.split(rel, "/")[0].alias("repo"), rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    files = exclude_dirs(drop_binary(files.filter(_has_ext(exts))), skip_dirs)
    return _file_columns(files.withColumn("text", _unix_ends(F.make_valid_utf8(F.col("content").cast("string"))))).drop("content")


def corpus_from_table(df: DataFrame, repo: Column, path: Column, text: Column) -> DataFrame:
    """A corpus of the rows of a table; null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # a generator of one row: filters on the text stay above it, so a text that is put together is made once, not once for each use
    once = F.explode_outer(F.array(_unix_ends(text)))
    return _file_columns(df.select(repo.alias("repo"), path.alias("path"), F.octet_length(text).cast("bigint").alias("size"), once.alias("text")).select("repo", "path", "text", "size"))


def _has_ext(exts: Sequence[str]) -> Column:
    return F.regexp_extract(F.element_at(F.split("path", "/"), -1), r".(\.[^.]*)$", 1).isin(*exts) if exts else F.lit(True)


def source_files(files: DataFrame, exts: Sequence[str]) -> DataFrame:
    """Files with one of the extensions."""
    return files.filter(F.col("ext").isin(*exts))


def exclude_dirs(files: DataFrame, dirs: Sequence[str], ignore_case: bool = False) -> DataFrame:
    """Without files below a folder of one of these names, as an exact path segment."""
    if not dirs:
        return files
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    if ignore_case:
        folders, dirs = F.transform(folders, F.lower), [d.lower().strip("/") for d in dirs]
    return files.filter(~F.arrays_overlap(folders, F.array(*map(F.lit, dirs))))


def drop_binary(files: DataFrame, content: str = "content") -> DataFrame:
    """Without files that have a NUL among their first 2048 bytes."""
    return files.filter(~F.contains(F.substring(content, 1, 2048), F.lit(b"\x00")))


def with_content_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", F.sha2(F.regexp_replace("text", "\r\n?", "\n"), 256))


def glob_pattern(glob: str) -> str:
    """Java pattern of a path glob: ``**/`` is any number of folders, ``*`` and ``?`` stay inside a name."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        else:
            out.append("[^/]" if glob[i] == "?" else glob[i] if glob[i].isalnum() or glob[i] in "_/" else "\\" + glob[i])
            i += 1
    return f"^{''.join(out)}$"


def _matches(globs: Sequence[str]) -> Column:
    return F.col("path").rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs)) if globs else F.lit(False)


def select_mapper_xml(files: DataFrame, globs: Sequence[str] = ()) -> DataFrame:
    """Mapper XML files: the usual places and the given globs."""
    return files.filter(_matches([*globs, *MAPPER_XML]))


def select_sql_files(files: DataFrame, globs: Sequence[str] = ("**/*.sql",), skip_dirs: Sequence[str] = ()) -> DataFrame:
    return exclude_dirs(files.filter(_matches(globs)), skip_dirs, ignore_case=True)


SYMBOL_TABLES = ("methods", "fields", "inheritance", "calls", "manifest")


def write_symbols(symbols: dict[str, DataFrame], path: str) -> None:
    """One Parquet table for each kind of symbol, by repo."""
    for name in SYMBOL_TABLES:
        symbols[name].write.mode("overwrite").partitionBy("repo").parquet(f"{path}/{name}")


def read_symbols(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in SYMBOL_TABLES}


SYMBOL_JSON = (
    "methods array<struct<qual:string,name:string,cls:string,start_line:int,end_line:int,params:map<string,string>>>, "
    "fields array<struct<cls:string,name:string,type:string>>, inheritance map<string,array<string>>, "
    "calls array<struct<caller_qual:string,callee_name:string,receiver:string,line:int>>"
)


def symbols_from_json(df: DataFrame, json: str = "json") -> dict[str, DataFrame]:
    """Symbol tables from a column of JSON records, one per file (repo, path)."""
    parsed = df.select("repo", "path", F.from_json(json, SYMBOL_JSON).alias("s"))
    tables = {k: parsed.select("repo", F.col("path").alias("file"), F.posexplode(f"s.{k}").alias("ord", "r")).select("repo", "file", "ord", "r.*") for k in ("methods", "fields", "calls")}
    supers = parsed.select("repo", F.col("path").alias("file"), F.explode("s.inheritance").alias("cls", "parents"))
    tables["inheritance"] = supers.select("repo", "file", "cls", F.posexplode("parents").alias("ord", "parent"))
    return tables


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, nodes_schema: str, edges_schema: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(nodes_schema).json(f"{path}/nodes"), spark.read.schema(edges_schema).json(f"{path}/edges")
