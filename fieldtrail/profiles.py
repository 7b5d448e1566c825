"""Project profiles: layers of files, where tables are named, folders to skip."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

try:
    import yaml
except ImportError:  # profiles can also be JSON
    yaml = None


@dataclass(frozen=True)
class Layer:
    """``path_hint``: pattern of a whole path segment, or of it without its ending; ``match``: pattern of the text, or ``|``-joined annotations."""

    name: str
    path_hint: str = ""
    match: str = ""


@dataclass(frozen=True)
class Profile:
    name: str
    source_exts: tuple[str, ...]
    layers: tuple[Layer, ...] = ()
    table_sources: tuple[str, ...] = ()
    mapper_globs: tuple[str, ...] = ("**/mapper/**/*.xml",)
    sql_globs: tuple[str, ...] = ("**/*.sql",)
    exclude_dirs: tuple[str, ...] = ()
    layer_order: tuple[str, ...] = field(default=("Controller", "Service", "Repository", "Table", "Other"))


# Layers and folders of the usual project kinds.
_JAVA_DIRS = ("target", "node_modules", ".git", "dist", "build", ".idea")
_PY_DIRS = ("__pycache__", ".venv", "venv", ".git", "dist", "build", ".tox", "node_modules", ".mypy_cache", ".pytest_cache")
_CS_DIRS = ("bin", "obj", ".git", "packages", "node_modules", ".vs")
_JAVA_LAYERS = (Layer("Controller", "controller", "@RestController|@Controller"), Layer("Service", "service", "@Service"), Layer("Repository", "(mapper|repository|dao)", "@Repository|@Mapper"))
_PY_LAYERS = (Layer("Controller", "(api|router|views|handlers|controller|controllers)"), Layer("Service", "(service|services|logic|domain|usecase)"), Layer("Repository", "(repository|repositories|repo|dao|models|persistence)"))
_CS_LAYERS = (
    Layer("Controller", "(controller|controllers|api|web)", "\\[ApiController\\]|ControllerBase"),
    Layer("Service", "(service|services|logic|domain|application)"),
    Layer("Repository", "(repository|repositories|dao|data|persistence|infra)", "DbContext|DbSet"),
)

PROFILES = {
    p.name: p
    for p in (
        Profile("java-spring", (".java",), _JAVA_LAYERS, ("mybatis", "jpa", "raw_sql", "java_sql_literals"), exclude_dirs=_JAVA_DIRS),
        Profile("java-generic", (".java",), _JAVA_LAYERS, ("mybatis", "jpa", "raw_sql", "java_sql_literals"), exclude_dirs=_JAVA_DIRS),
        Profile("python-sqlalchemy", (".py",), _PY_LAYERS, ("raw_sql", "python_sql_literals", "sqlalchemy"), exclude_dirs=_PY_DIRS),
        Profile("python-generic", (".py",), _PY_LAYERS, ("raw_sql", "python_sql_literals"), exclude_dirs=_PY_DIRS),
        Profile("csharp-ef", (".cs",), _CS_LAYERS, ("raw_sql", "csharp_sql_literals", "ef_core"), exclude_dirs=_CS_DIRS),
        Profile("csharp-generic", (".cs",), _CS_LAYERS, ("raw_sql", "csharp_sql_literals"), exclude_dirs=_CS_DIRS),
    )
}


def profile_from(settings: Mapping) -> Profile:
    """A profile from its settings: profile, source_exts, layers (name, path_hint, match), table_sources, exclude.dirs.

    A table source counts if it is there and not false or empty. ``raw_sql`` has the globs of SQL files, ``mybatis.mapper_xml_glob`` is that of mapper files. Layers come in
    their order, then tables and others. Other settings are ignored.
    """
    layers = tuple(Layer(x["name"], x.get("path_hint") or "", x.get("match") or "") for x in settings.get("layers") or [])
    sources = {k: v for k, v in (settings.get("table_sources") or {}).items() if v}
    mybatis, sql = sources.get("mybatis"), sources.get("raw_sql")
    more = {}
    if isinstance(mybatis, Mapping) and mybatis.get("mapper_xml_glob"):
        more["mapper_globs"] = (mybatis["mapper_xml_glob"],)
    if isinstance(sql, list | tuple):
        more["sql_globs"] = tuple(sql)
    if layers:
        more["layer_order"] = (*(x.name for x in layers), "Table", "Other")
    dirs = (settings.get("exclude") or {}).get("dirs") or ()
    return Profile(settings.get("profile") or "", tuple(settings.get("source_exts") or ()), layers, tuple(sources), exclude_dirs=tuple(dirs), **more)


def load_profile(spark: SparkSession, name: str, folder: str | None = None) -> Profile:
    """A known profile by its name, or one from a YAML or JSON file: a path, or a name in ``folder``. Files are read by Spark, so they may be in any store."""
    if folder is None and name in PROFILES:
        return PROFILES[name]
    paths = [name] if folder is None else [f"{folder}/{name}{end}" for end in (".yml", ".yaml", ".json")]
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    found = [p for p in paths if fs_path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path(p))]
    if not found:
        raise FileNotFoundError(f"no profile {name}")
    text = spark.read.text(found[0], wholetext=True).first()[0]
    if found[0].endswith(".json"):
        return profile_from(json.loads(text))
    if yaml is None:
        raise RuntimeError("PyYAML reads YAML profiles; without it, write them as JSON")
    return profile_from(yaml.safe_load(text))
