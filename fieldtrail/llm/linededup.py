"""Operator 13: lines that many documents share are dropped, by native expressions alone.

Lines are exploded with their positions, normalised and hashed; documents are counted for each hash; positions over the threshold are
taken out, and the rest is put together by position. A cheap coarse hash (64 bits of the wholly lower-cased line) goes first: equal keys
have equal coarse hashes, so only lines of a coarse hash with enough rows can count, and only these get an exact hash (128 bits) and meet
again. What leaves the first pass are a hash and a count, combined before the shuffle, so a line that all documents have is one row for each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrail.llm.common import WORD_SPACE, stage, unstage, with_maybe

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    """The line without white space at its ends, A-Z lower-cased; other letters stay."""
    key = F.btrim(line, F.lit(WORD_SPACE))
    return F.when(F.length(key) == F.octet_length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``n_lines`` (before), ``n_dropped`` and ``kept_text``, the text without its common lines; such columns of ``docs`` are replaced.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents (different ids) stays in the document with the largest id
    only, in each line that has it. Null and empty texts are one empty line. Rows with a null id are one document, below all others. Rows
    that share an id are one document: each row keeps or loses by that id. Equal rows have equal results; an empty table gives no rows. Very
    long texts are one row among others; positions are taken out by a hash set, in time linear in the lines.
    """
    new = ["n_lines", "n_dropped", "kept_text"]
    carried = [c for c in docs.columns if c not in new]
    tag = "_" * (1 + max(map(len, docs.columns)))  # longer than any name of docs, so none clashes
    doc, body, key1, key2, gone = (name + tag for name in ("doc", "body", "key1", "key2", "gone"))

    body_of = F.coalesce(F.col(text_col), F.lit(""))
    # texts are hashed before they are exploded: beside an explode, that would be done for each line
    base = docs.select(F.col(id_col).alias("doc"), body_of.alias("body")).withColumns({"k1": F.xxhash64("body"), "k2": F.xxhash64(F.lit(1), "body")})
    base = base.select("doc", "k1", "k2", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    trimmed = F.btrim("line", F.lit(WORD_SPACE))
    long_ones = base.where(F.length(trimmed) >= min_chars).withColumn("coarse", F.xxhash64(F.lower(trimmed)))
    often = stage(long_ones.groupBy("coarse").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("coarse"))

    exact = line_key(F.col("line"))
    near = with_maybe(long_ones, "coarse", often, "maybe").where("maybe")
    near = stage(near.select("doc", "k1", "k2", "pos", F.xxhash64(exact).alias("h1"), F.xxhash64(F.lit(1), exact).alias("h2")))
    unstage(often)
    common = near.select("h1", "h2", "doc").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_docs)
    common = stage(common)  # read anew, so that the join with a very common line's rows can be split
    lost = near.join(common, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("last")))
    lost = stage(lost.groupBy(F.col("doc").alias(doc), F.col("k1").alias(key1), F.col("k2").alias(key2)).agg(F.collect_set("pos").alias(gone)))
    unstage(near, common)

    rows = docs.select(*carried, F.col(id_col).alias("my" + doc), body_of.alias(body), F.xxhash64(body_of).alias("my" + key1), F.xxhash64(F.lit(1), body_of).alias("my" + key2))
    rows = with_maybe(rows, "my" + key1, lost.select(F.col(key1).alias("my" + key1)), "maybe" + tag)
    hit = rows.where(F.col("maybe" + tag)).join(lost, F.col("my" + key1).eqNullSafe(F.col(key1)) & F.col("my" + key2).eqNullSafe(F.col(key2)) & F.col("my" + doc).eqNullSafe(F.col(doc)), "left")
    lines = F.split(F.col(body), "\n")
    kept = lambda cut: F.transform(F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(gone)), lambda i: F.get(cut, i))
    # the text is cut once, not once for each line that stays
    joined = F.transform(F.array(lines), lambda cut: F.array_join(kept(cut), "\n"))[0]
    texts = F.when(F.col(gone).isNull(), F.col(body)).otherwise(joined)
    hit = hit.select(*carried, F.size(lines).cast("long").alias("n_lines"), F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"), texts.alias("kept_text"))
    rest = rows.where(~F.col("maybe" + tag)).select(*carried, F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.col(body).alias("kept_text"))
    return hit.unionByName(rest)
