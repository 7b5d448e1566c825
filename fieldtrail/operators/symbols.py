"""Symbol tables of source files, their refresh, and the resolution of calls to methods."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrail.functions import text as T
from fieldtrail.functions.extractors import EXTRACTORS
from fieldtrail.sources.scratch import written

_RAW = "repo string, file string, kind string, ord int, cls string, name string, qual string, type string, receiver string, start_line int, end_line int, params map<string,string>"


#: Rows that a task holds before it hands them on: a batch of texts has many more symbols than texts.
MOST_ROWS = 20_000


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole, word = pa.int32(), pa.string()
    kinds = [word, word, word, whole, word, word, word, word, word, whole, whole, pa.map_(word, word)]
    names = [c.split()[0] for c in _RAW.split(", ")]
    rows: list[tuple] = []

    def table() -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        columns = [batch.column(c) for c in ("repo", "path", "ext", "text")]
        for at in range(batch.num_rows):
            repo, file, ext, text = (c[at].as_py() for c in columns)
            s = EXTRACTORS[ext](text)
            rows += [(repo, file, "method", i, cls, name, qual, None, None, a, b, list(params.items())) for i, (qual, name, cls, a, b, params) in enumerate(s.methods)]
            rows += [(repo, file, "field", i, cls, name, None, kind, None, None, None, None) for i, (cls, name, kind) in enumerate(s.fields)]
            rows += [(repo, file, "supertype", i, cls, None, None, parent, None, None, None, None) for i, (cls, parent) in enumerate(s.supertypes)]
            rows += [(repo, file, "call", i, None, name, caller, None, receiver, line, None, None) for i, (caller, name, receiver, line) in enumerate(s.calls)]
            if len(rows) >= MOST_ROWS:
                yield table()
                rows.clear()
    yield table()


def extract_symbols(files: DataFrame, checkpoint: bool = False) -> dict[str, DataFrame]:
    """methods, fields, inheritance, calls and manifest of the files whose language is known.

    ``ord`` numbers the rows of a file; (file, ord) stands for the order in which files are read. With ``checkpoint`` the texts
    are parsed once and written by kind of symbol; without it each table that is used parses them.
    """
    known = files.filter(F.col("ext").isin(*EXTRACTORS)).select("repo", "path", "ext", "text")
    raw = known.mapInArrow(_extract, _RAW)
    raw = written(raw, ["kind"]) if checkpoint else raw
    kind = lambda k: raw.filter(F.col("kind") == k)
    return {
        "methods": kind("method").select("repo", "file", "ord", "qual", "name", "cls", "start_line", "end_line", "params"),
        "fields": kind("field").select("repo", "file", "ord", "cls", "name", "type"),
        "inheritance": kind("supertype").filter("type IS NOT NULL").select("repo", "file", "ord", "cls", F.col("type").alias("parent")),
        "calls": kind("call").select("repo", "file", "ord", F.col("qual").alias("caller_qual"), F.col("name").alias("callee_name"), "receiver", F.col("start_line").alias("line")),
        "manifest": files.filter(F.col("ext").isin(*EXTRACTORS)).select("repo", F.col("path").alias("file"), "sha256"),
    }


def file_states(files: DataFrame, manifest: DataFrame, same_version: bool = True) -> DataFrame:
    """(repo, file, sha256, state) of the files of ``files`` (unchanged or changed, with their hash) and of those only ``manifest`` has (removed, with its hash).

    Each text is hashed once, and none leaves its task: hashes of both sides come together by (repo, file) in one shuffle. A path that is there
    more than once is unchanged only if all its hashes are the same on both sides; of several hashes the least is given. Another version changes all.
    """
    here = files.select("repo", F.col("path").alias("file"), F.col("sha256").alias("now"), F.lit(None).cast("string").alias("before"))
    then = manifest.select("repo", "file", F.lit(None).cast("string").alias("now"), F.col("sha256").alias("before"))
    hashes = [f(c).alias(f"{n}_{c}") for c in ("now", "before") for n, f in (("least", F.min), ("most", F.max))]
    met = here.unionByName(then).groupBy("repo", "file").agg(*hashes)
    same = (F.col("least_now") == F.col("most_now")) & (F.col("least_before") == F.col("most_before")) & (F.col("least_now") == F.col("least_before")) & F.lit(same_version)
    state = F.when(F.col("least_now").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return met.select("repo", "file", F.coalesce("least_now", "least_before").alias("sha256"), state.alias("state"))


def with_keys(files: DataFrame, keys: DataFrame, max_broadcast: int = 100_000) -> DataFrame:
    """The rows of ``files`` whose (repo, path) is in ``keys``, with the other columns of ``keys``; which should be cheap to read twice.

    Up to ``max_broadcast`` keys go to the texts, which stay where they are. Beyond that only texts whose path's bit is set in a bitmap
    of 2^25 bits are shuffled.
    """
    more = [c for c in keys.columns if c not in ("repo", "path")]
    keyed = keys.select(F.col("repo").alias("key_repo"), F.col("path").alias("key_path"), *more)
    fits = F.col("repo").eqNullSafe(F.col("key_repo")) & F.col("path").eqNullSafe(F.col("key_path"))
    if keys.limit(max_broadcast + 1).count() <= max_broadcast:
        return files.join(F.broadcast(keyed), fits).select(*files.columns, *more)
    slot, bit = F.pmod(F.xxhash64("repo", "path"), F.lit(1 << 25)), F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    near = files.withColumn("slot", slot).join(F.broadcast(words), F.shiftright("slot", 6) == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0)
    return near.select(files.columns).join(keyed, fits).select(*files.columns, *more)


def diff_manifest(files: DataFrame, manifest: DataFrame, same_version: bool = True) -> dict[str, DataFrame]:
    """unchanged and changed files (of ``files``) and removed ones (of ``manifest``), by path and hash. Another version changes all."""
    if not same_version:
        return {"unchanged": files.limit(0), "changed": files, "removed": manifest}
    states = file_states(files, manifest).checkpoint()
    of = lambda s: with_keys(files, states.where(F.col("state") == s).select("repo", F.col("file").alias("path")))
    gone = manifest.join(states.where("state = 'removed'").select("repo", "file"), ["repo", "file"], "left_semi")
    return {"unchanged": of("unchanged"), "changed": of("changed"), "removed": gone}


def refresh_symbols(files: DataFrame, symbols: dict[str, DataFrame], same_version: bool = True) -> dict[str, DataFrame]:
    """Symbol tables of ``files``: those of unchanged files are taken over, others extracted anew. Stored symbols: see sources/store.py."""
    states = file_states(files.filter(F.col("ext").isin(*EXTRACTORS)), symbols["manifest"], same_version).checkpoint()
    fresh = extract_symbols(with_keys(files, states.where("state = 'changed'").select("repo", F.col("file").alias("path"))), checkpoint=True)
    keep = states.where("state = 'unchanged'").select("repo", "file")
    kept = {k: symbols[k].join(keep, ["repo", "file"], "left_semi").unionByName(fresh[k]) for k in fresh if k != "manifest"}
    return {**kept, "manifest": states.where("state <> 'removed'").select("repo", "file", "sha256")}


def _last(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows with one key the last by (file, ord): a maximum, which combines before the shuffle."""
    rest = [c for c in df.columns if c not in {*keys, "file", "ord"}]
    top = F.max_by(F.struct(*rest, "file", "ord"), F.struct("file", "ord"))
    return df.groupBy(*keys).agg(top.alias("r")).select(*keys, "r.*")


def last_methods(methods: DataFrame) -> DataFrame:
    """One method for each qual: overloads share it, the last one counts."""
    return _last(methods, ["repo", "qual"])


def class_ancestors(inheritance: DataFrame) -> DataFrame:
    """(repo, cls, ancestor, distance) for every class in an inheritance row, itself at 0, by simple names; cycles end.

    Paths double: once all distances up to ``step`` are known, those up to twice as far are a known path and then one of exactly ``step``. A
    chain of n classes takes about log2(n) rounds, and there is no bound on its length. Needs a checkpoint folder.
    """
    parents = inheritance.select("repo", "cls", T.simple_name(F.col("parent")).alias("up")).filter("up <> ''").distinct().checkpoint()
    names = parents.select("repo", "cls").union(parents.select("repo", F.col("up").alias("cls"))).distinct()
    own = names.select("repo", "cls", F.col("cls").alias("ancestor"), F.lit(0).alias("distance"))
    paths = parents.filter("cls <> up").select("repo", "cls", F.col("up").alias("ancestor"), F.lit(1).alias("distance")).checkpoint()
    step = 1
    while not (jumps := paths.filter(F.col("distance") == step)).isEmpty():
        on = jumps.select("repo", F.col("cls").alias("ancestor"), F.col("ancestor").alias("further"))
        longer = paths.join(on, ["repo", "ancestor"]).filter("cls <> further").select("repo", "cls", F.col("further").alias("ancestor"), (F.col("distance") + step).alias("distance"))
        paths = paths.unionByName(longer).groupBy("repo", "cls", "ancestor").agg(F.min("distance").alias("distance")).checkpoint()
        step *= 2
    return own.unionByName(paths)


def symbol_types(methods: DataFrame, fields: DataFrame) -> DataFrame:
    """(repo, qual, name, type) as seen in a method: ``this``, then fields of its class, then parameters; the later hides the earlier."""
    m = last_methods(methods)
    this = m.filter("cls <> ''").select("repo", "qual", F.lit("this").alias("name"), F.col("cls").alias("type"), F.lit(0).alias("rank"))
    of_class = _last(fields, ["repo", "cls", "name"]).select("repo", "cls", "name", "type")
    own = m.select("repo", "qual", "cls").join(of_class, ["repo", "cls"]).select("repo", "qual", "name", "type", F.lit(1).alias("rank"))
    params = m.select("repo", "qual", F.explode("params").alias("name", "type"), F.lit(2).alias("rank"))
    return this.unionByName(own).unionByName(params).groupBy("repo", "qual", "name").agg(F.max_by("type", "rank").alias("type"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and sites sorted by (repo, file, line): each site with the shortest span that is open there, the first on a tie.

    Open spans are a heap by length. One that ended before a line is dropped when it comes to the top: lines only grow.
    """
    where, heap = None, []
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("_repo", "_file", "_line", "_site", "_end", "_ord", "_qual")), strict=True)
        picked, quals = [], []
        for i, (repo, file, line, site, end, order, qual) in enumerate(rows):
            if (repo, file) != where:
                where, heap = (repo, file), []
            if not site:
                heappush(heap, (end - line, order, qual, end))
                continue
            while heap and heap[0][3] < line:
                heappop(heap)
            if heap:
                picked.append(i)
                quals.append(heap[0][2])
        kept = batch.select([n for n in batch.schema.names if n[0] != "_" or n == "_row"]).take(pa.array(picked, pa.int32()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(quals, pa.string())], [*kept.schema.names, "qual"])


def enclosing_method(sites: DataFrame, methods: DataFrame) -> DataFrame:
    """``sites`` (repo, file, line, ...) with qual: the method with the smallest span that holds the line, the first (by ord) on a tie.

    Spans and sites are laid out by ranges of (repo, file, line), and each range is swept with the spans open at each line. A span is one row
    where it starts, and one for each further range that it reaches into: a file of any size is many ranges, and a long span is no
    more rows than ranges. Sites outside methods, and rows without a line, drop out; equal sites stay as often as they are there. Needs a checkpoint folder.
    """
    key = [F.col("repo").alias("_repo"), F.col("file").alias("_file")]
    spans = methods.filter("start_line <= end_line").select(
        *key, F.col("start_line").cast("bigint").alias("_line"), F.lit(False).alias("_site"), F.col("end_line").cast("bigint").alias("_end"), F.col("ord").cast("bigint").alias("_ord"), F.col("qual").alias("_qual"),
        F.lit(None).cast(sites.select(F.struct("*")).schema[0].dataType).alias("_row"),
    )
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("_end", "bigint"), ("_ord", "bigint"), ("_qual", "string"))]
    places = sites.filter("line IS NOT NULL").select(*key, F.col("line").cast("bigint").alias("_line"), F.lit(True).alias("_site"), *nothing, F.struct(*sites.columns).alias("_row"))
    order = ["_repo", "_file", "_line", "_site"]
    laid = spans.unionByName(places).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    parts = laid.groupBy("_repo", "_file", "_part").agg(F.min("_line").alias("_least"))
    # only files that go over a range have spans that may reach into the next
    wide = parts.groupBy("_repo", "_file").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    same = lambda a, b: F.col(f"{a}._repo").eqNullSafe(F.col(f"{b}._repo")) & F.col(f"{a}._file").eqNullSafe(F.col(f"{b}._file"))
    later = parts.alias("p").join(wide.alias("w"), same("p", "w"), "left_semi")
    into = laid.filter("NOT _site").alias("s").join(F.broadcast(later.alias("p")), same("s", "p") & F.expr("p._part > s._part AND p._least <= s._end"))
    carried = into.select(*[F.col("p._part") if c == "_part" else F.col(f"s.{c}") for c in laid.columns])
    swept = laid.unionByName(carried).repartition("_part").sortWithinPartitions("_part", *order).drop("_part")
    row = laid.schema["_row"].dataType.simpleString()
    return swept.mapInArrow(_sweep, f"_row {row}, qual string").select("_row.*", "qual")


def resolve_calls(symbols: dict[str, DataFrame], ancestors: DataFrame | None = None) -> DataFrame:
    """(repo, src, dst): which method may be meant by each call, distinct, without calls to oneself.

    No receiver or ``this``: the caller's class and its ancestors; ``super``: its ancestors. A receiver whose type is
    known: that class and its ancestors, and nothing else. Otherwise a receiver that is a class name: that class.
    Calls are first cut to names that are defined somewhere, then reduced to candidate classes, so that frequent names meet few rows.
    """
    methods, calls = symbols["methods"], symbols["calls"]
    ancestors = class_ancestors(symbols["inheritance"]) if ancestors is None else ancestors
    targets = methods.select("repo", F.col("name").alias("callee_name"), T.class_of(F.col("qual")).alias("target_cls"), F.col("qual").alias("dst")).distinct()
    named = targets.select("repo", "callee_name").distinct()
    caller = last_methods(methods).select("repo", F.col("qual").alias("caller_qual"), F.col("cls").alias("caller_cls"))
    types = symbol_types(methods, symbols["fields"]).select("repo", F.col("qual").alias("caller_qual"), F.col("name").alias("receiver"), "type")
    calls = calls.select("repo", "caller_qual", "callee_name", "receiver").distinct().join(named, ["repo", "callee_name"], "left_semi").join(caller, ["repo", "caller_qual"], "left")
    own = F.col("receiver").isNull() | F.col("receiver").isin("this", "super")
    typed = calls.filter(~own).join(types, ["repo", "caller_qual", "receiver"], "left")
    known = F.coalesce(F.col("type"), F.lit("")) != ""
    roots = [
        calls.filter(own & (F.col("caller_cls") != "")).select("repo", "caller_qual", "callee_name", F.col("caller_cls").alias("root"), F.when(F.col("receiver") == "super", 1).otherwise(0).alias("least")),
        typed.filter(known).select("repo", "caller_qual", "callee_name", T.simple_name(F.col("type")).alias("root"), F.lit(0).alias("least")),
    ]
    rooted = reduce(DataFrame.unionByName, roots).distinct()
    up = ancestors.filter("distance > 0").select("repo", F.col("cls").alias("root"), F.col("ancestor").alias("target_cls"), "distance")
    above = rooted.join(up, ["repo", "root"]).select("repo", "caller_qual", "callee_name", "target_cls")
    same = rooted.filter("least = 0").select("repo", "caller_qual", "callee_name", F.col("root").alias("target_cls"))
    static = typed.filter(~known).select("repo", "caller_qual", "callee_name", F.col("receiver").alias("target_cls"))
    candidates = above.unionByName(same).unionByName(static).distinct()
    met = candidates.join(targets, ["repo", "callee_name", "target_cls"])
    return met.filter("caller_qual <> dst").select("repo", F.col("caller_qual").alias("src"), "dst").distinct()
