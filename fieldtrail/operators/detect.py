"""Which profile fits a repo: its main language by source counts, then a flavor by what the sources mention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Markers at a repo's root, folders that do not count, words that tell a flavor, and limits.
LANGUAGES = [
    ("java", ".java", "(?:pom\\.xml|build\\.gradle|settings\\.gradle)", r"org\.springframework|@RestController|@Service", "java-spring", "java-generic"),
    ("python", ".py", "(?:pyproject\\.toml|setup\\.py|requirements\\.txt|Pipfile)", "(?i)sqlalchemy", "python-sqlalchemy", "python-generic"),
    ("csharp", ".cs", "[^/]*\\.(?:csproj|sln)", r"Microsoft\.EntityFrameworkCore|DbContext|\[Table\(", "csharp-ef", "csharp-generic"),
]
JUNK = ["node_modules", ".git", "target", "build", "bin", "obj", ".venv", "venv", "__pycache__", "dist"]
COUNTED, SNIFFED = 500, 80


def detect_profiles(files: DataFrame, root_depth: int = 0, counted: int = COUNTED, sniffed: int = SNIFFED) -> DataFrame:
    """(repo, profile). ``root_depth``: folders before a repo's root in its paths. Counts stop at ``counted``, the first ``sniffed`` sources by path are looked
    into; on equal counts a root marker decides, then the order of languages. Repos without sources are java-generic."""
    lead = f"^(?:[^/]+/){{{root_depth}}}"
    junk = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, JUNK)))
    ext = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r".(\.[^.]*)$", 1)
    language = F.coalesce(*[F.when(ext == e, name) for name, e, *_ in LANGUAGES])
    first = F.row_number().over(Window.partitionBy("repo", "language").orderBy("path"))
    fits = F.coalesce(*[F.when(F.col("language") == name, F.col("text").rlike(words)) for name, _, _, words, *_ in LANGUAGES])
    # flags are ranked, not texts
    flags = files.withColumn("language", language).filter("language IS NOT NULL").select("repo", "language", "path", fits.alias("fits")).withColumn("r", first).filter(F.col("r") <= sniffed)
    flavor = flags.groupBy("repo", "language").agg(F.bool_or("fits").alias("rich")).groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("language", "rich"))).alias("rich"))
    counts = files.groupBy("repo").agg(
        *[F.least(F.count_if((ext == e) & ~junk), F.lit(counted)).alias(f"n_{name}") for name, e, *_ in LANGUAGES],
        *[F.bool_or(F.col("path").rlike(f"{lead}{marker}$")).alias(f"m_{name}") for name, _, marker, *_ in LANGUAGES],
    )
    df = counts.join(flavor, "repo", "left")
    options = []
    for i, (name, _, _, _, rich, plain) in enumerate(LANGUAGES):
        seen = F.col("rich")[name]
        profile = F.when(F.coalesce(seen, F.lit(False)), rich).otherwise(plain)
        there = F.col(f"m_{name}") | seen.isNotNull()
        options.append(F.when(there, F.struct(F.col(f"n_{name}").alias("n"), F.col(f"m_{name}").cast("int").alias("m"), F.lit(-i).alias("i"), profile.alias("p"))))
    best = F.array_max(F.array_compact(F.array(*options)))
    return df.select("repo", F.coalesce(best["p"], F.lit("java-generic")).alias("profile"))
