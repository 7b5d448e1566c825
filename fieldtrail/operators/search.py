"""Fuzzy search of nodes: query letters must stand in a text in order; runs, starts of words and short texts score more."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrail.functions.text import let


def fuzzy_score(query: Column, target: Column) -> Column:
    """Score of the leftmost match of the query's letters; null if they do not all occur in order, or either is empty."""
    q, t = F.lower(query), F.lower(target)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("score"), F.lit(True).alias("ok"))

    def step(s: Column, ch: Column) -> Column:
        p = F.call_function("locate", ch, t, s["at"] + 1)
        ok = s["ok"] & (p > 0)
        follows = (s["at"] > 0) & (p == s["at"] + 1)
        run = F.when(follows, s["run"] + 1).otherwise(0)
        place = F.when(p == 1, 30).when(F.substr(t, p - 1, F.lit(1)).rlike("[^0-9a-zA-Z_]"), 15).otherwise(0)
        gain = place + F.when(follows, 8 + run * 5).otherwise(1)
        return F.when(ok, F.struct(p.alias("at"), run.alias("run"), (s["score"] + gain).alias("score"), F.lit(True).alias("ok"))).otherwise(F.struct(s["at"].alias("at"), s["run"].alias("run"), s["score"].alias("score"), F.lit(False).alias("ok")))

    end = F.aggregate(F.filter(F.split(q, ""), lambda c: c != ""), start, step)
    score = end["score"] + F.when(q == t, 40).otherwise(0) + F.greatest(F.lit(0), 12 - (F.length(t) - F.length(q)))
    return F.when((q != "") & (t != "") & end["ok"], score)


def letter_pairs(text: Column) -> Column:
    """The distinct pairs of letters that stand in the text in this order, near or far, and its distinct letters; lower case."""

    def after(c: Column, t: Column) -> Column:
        rest = F.array_distinct(F.split(F.substr(t, F.call_function("locate", c, t) + 1), ""))
        return F.transform(F.filter(rest, lambda d: d != ""), lambda d: F.concat(c, d))

    def pairs(t: Column) -> Column:
        letters = F.filter(F.array_distinct(F.split(t, "")), lambda c: c != "")
        return F.concat(letters, F.flatten(F.transform(letters, lambda c: after(c, t))))

    return let(F.lower(text), pairs)


def pair_mask(pairs: Column) -> Column:
    """The pairs as 128 bits: an array of two longs. A text can only match if it has all bits of the query."""
    one = lambda seed: F.aggregate(pairs, F.lit(0).cast("long"), lambda m, p: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(p, F.lit(seed)), F.lit(64)).cast("int"))))
    return F.array(one(1), one(2))


def candidate_pairs(nodes: DataFrame, queries: DataFrame, k: int = 8, columns: Sequence[str] = ("label", "id", "layer", "table"), keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """((keys, query, text) that are worth scoring, (keys, text, id, ord) of the k first nodes of each text).

    Each different text is looked at once, whatever number of nodes has it. A query and a text meet in an equi-join on the query's rarest pair of letters,
    then their masks of all pairs are compared. No more than the first k nodes of a text can be among a query's k best, since a node's
    score is that of its best text. Needs a checkpoint folder.
    """
    keys, order = list(keys), F.col("ord") if "ord" in nodes.columns else F.lit(0)
    each = F.array(*[F.col(c) for c in columns if c in nodes.columns])
    of = nodes.select(*keys, "id", order.alias("ord"), F.explode(F.array_distinct(each)).alias("text")).filter("text <> ''")
    first = Window.partitionBy(*keys, "text").orderBy("ord", "id")
    holders = of.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k).drop("nth").checkpoint()
    texts = holders.select(*keys, "text").distinct().withColumn("pairs", letter_pairs(F.col("text"))).checkpoint()
    asked = queries.select(*keys, "query").distinct().withColumn("pairs", letter_pairs(F.trim("query"))).filter(F.size("pairs") > 0)
    # a query's own pairs are those of letters in a row, and its letters
    letters = F.split(F.lower(F.trim("query")), "")
    own = F.array_distinct(F.concat(F.filter(letters, lambda c: c != ""), F.filter(F.transform(letters, lambda c, i: F.concat(c, F.coalesce(F.get(letters, i + 1), F.lit("")))), lambda p: F.length(p) == 2)))
    asked = asked.withColumn("own", own).checkpoint()
    wanted = asked.select(F.explode("own").alias("pair")).distinct()
    counts = texts.select(F.explode("pairs").alias("pair")).join(wanted, "pair").groupBy("pair").agg(F.count("*").alias("n"))
    each_own = asked.select(*keys, "query", F.explode("own").alias("pair")).join(counts, "pair", "left")
    rarest = each_own.groupBy(*keys, "query").agg(F.min_by("pair", F.struct(F.coalesce("n", F.lit(0).cast("bigint")), "pair")).alias("pair"))
    asked = asked.join(rarest, [*keys, "query"]).select(*keys, "query", "pair", pair_mask(F.col("pairs")).alias("q_mask"))
    chosen = asked.select("pair").distinct()
    shown = texts.select(*keys, "text", pair_mask(F.col("pairs")).alias("mask"), F.explode("pairs").alias("pair")).join(chosen, "pair", "left_semi")
    met = shown.join(asked, [*keys, "pair"])
    for i in (0, 1):
        met = met.filter(F.col("mask")[i].bitwiseAND(F.col("q_mask")[i]) == F.col("q_mask")[i])
    return met.select(*keys, "query", "text"), holders


def fuzzy_search(nodes: DataFrame, queries: DataFrame, k: int = 8, columns: Sequence[str] = ("label", "id", "layer", "table"), keys: Sequence[str] = ()) -> DataFrame:
    """(query, rank, id, score): for each query (query, and ``keys`` if nodes have any) the k best nodes, ties by ord and id.

    A node's score is the best of its columns'. Only pairs of a query and a text that can match are scored (candidate_pairs). Empty queries,
    and nodes without text, find nothing.
    """
    keys = list(keys)
    pairs, holders = candidate_pairs(nodes, queries, k, columns, keys)
    scored = pairs.withColumn("score", fuzzy_score(F.trim("query"), F.col("text"))).filter("score IS NOT NULL")
    found = scored.join(holders, [*keys, "text"]).groupBy(*keys, "query", "id", "ord").agg(F.max("score").alias("score"))
    best = Window.partitionBy(*keys, "query").orderBy(F.desc("score"), "ord", "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(*keys, "query", "rank", "id", "score")
