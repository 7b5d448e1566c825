"""Near-duplicate texts by ProbMinHash, banding and verification.

A text is a weighted set of word shingles (weight: how often it stands there). Every shingle is a Poisson process
of arrivals at that rate, each of which falls on one register of the signature; a register keeps the earliest. Two
signatures agree in a register with the probability Jaccard similarity of the texts. Bands of registers give
candidates, whose similarity is then computed exactly; connected components of verified links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrail.llm.common import WordHashes, mix, rolling, stage, unstage, with_maybe
from fieldtrail.llm.components import components, merged

#: Of the words seen last, in each worker.
_HASHES = WordHashes()


def shingles(text: str | None, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their counts. A text of fewer words has one shingle, all its words."""
    words = (text or "").encode("utf-8", "replace").split()
    n = min(size, len(words))
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(rolling(_HASHES.of(words), n), return_counts=True)


def signature(codes: np.ndarray, weights: np.ndarray, registers: int = 100) -> np.ndarray:
    """ProbMinHash: for each register the element whose arrival is the earliest there.

    Elements' arrivals are made a few at a time; an element ends when its last arrival is later than every register's. Eleven bits
    of an arrival's hash choose its register, so there are at most 2048.
    """
    if not 0 < registers <= 2048:
        raise ValueError("a signature has 1 to 2048 registers")
    winner = np.zeros(registers, np.uint64)
    earliest = np.full(registers, np.inf)
    live, rate, clock = codes, weights.astype(np.float64), np.zeros(len(codes))
    step = 0
    while len(live):
        some = max(1, -(-8 * registers // len(live))) if step == 0 else 3
        with np.errstate(over="ignore"):
            h = mix(live[:, None] + (np.arange(step, step + some, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))[None, :])
        step += some
        times = clock[:, None] + np.cumsum(-np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1) / rate[:, None]
        clock = times[:, -1]
        t, reg, who = times.ravel(), (h & np.uint64(2047)).astype(np.int64).ravel() % registers, np.repeat(live, some)
        early = np.flatnonzero(t < earliest.max())
        early = early[np.argsort(-t[early], kind="stable")]  # the last one written to a register is the earliest
        t, reg, who = t[early], reg[early], who[early]
        better = t < earliest[reg]
        earliest[reg[better]], winner[reg[better]] = t[better], who[better]
        goes_on = clock < earliest.max()
        live, rate, clock = live[goes_on], rate[goes_on], clock[goes_on]
    return winner


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact: the sum over common elements of 1 / sum_j max(x_j / x_i, y_j / y_i), by ordering the ratios x_j / y_j."""
    if not len(x[0]) or not len(y[0]):
        return 0.0
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    a, b = x[1][i].astype(np.float64), y[1][j].astype(np.float64)
    ratio = a / b
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    only_x, only_y = x[1].sum() - a.sum(), y[1].sum() - b.sum()
    # for element i: x_j counts where the ratio of j is at least that of i, y_j where it is less
    first = np.searchsorted(ratio, ratio, "left")
    x_from = only_x + np.concatenate([np.cumsum(a[::-1])[::-1], [0.0]])[first]
    y_below = only_y + np.concatenate([[0.0], np.cumsum(b)])[first]
    return float((1.0 / (x_from / a + y_below / b)).sum())


def signatures(docs: DataFrame, bands: int = 20, rows: int = 5, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, bands): a 128-bit hash of the words, null without a word, and a 64-bit hash of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = [], []
            for text in batch[1].to_pylist():
                codes, counts = shingles(text, size)
                if not len(codes):
                    keys.append(None)
                    hashes.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(b" ".join(text.encode("utf-8", "replace").split())))
                band = signature(codes, counts, bands * rows).reshape(bands, rows)
                with np.errstate(over="ignore"):
                    code = np.arange(bands, dtype=np.uint64)
                    for k in range(rows):
                        code = mix(code * np.uint64(31) + band[:, k])
                hashes.append(code.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], [id_col, "key", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, key binary, bands array<long>")


def _similar(pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs (a, b) whose texts are as similar as ``threshold``, with the similarity."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def of(text: str) -> tuple[np.ndarray, np.ndarray]:
            if text not in known:
                if len(known) > 64:
                    known.clear()
                known[text] = shingles(text, size)
            return known[text]

        for batch in batches:
            sim = np.array([probability_jaccard(of(x), of(y)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)], np.float64)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim)], ["a", "b", "similarity"])
            yield out.filter(pa.array(sim >= threshold))

    y = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    x = y.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    return x.select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def _shingle_rows(texts: DataFrame, size: int) -> DataFrame:
    """(id, code, n) of each text: its different shingles and how often they stand there."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                codes, counts = shingles(text, size)
                at = pa.array(np.full(len(codes), i), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), pa.array(codes.view(np.int64)), pa.array(counts.astype(np.int64))], ["id", "code", "n"])

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, code long, n long")


def _may_reach(p: Column | np.ndarray, q: Column | np.ndarray, threshold: float) -> Column | np.ndarray:
    """Whether two texts can be as similar as ``threshold`` if a share p of the one's weight, and q of the other's, lies in shingles that they don't share.

    With shared parts s = 1 - p and t = 1 - q, the probability Jaccard similarity is at most 1 / (1/s + 1/t - 1): each of its terms is at
    most 1 / (1/x + (1 - t)/y) for normalised weights x and y, which is concave, so the sum is largest for equal parts.
    """
    s, t = 1 - p, 1 - q
    return (s > 0) & (t > 0) & (s + t <= (1 + 1 / threshold + 1e-9) * s * t)


def _prefixes(texts: DataFrame, threshold: float) -> DataFrame:
    """(cluster, id, weight, feature, a, d): the features of each text by which it must meet similar texts of its cluster.

    ``texts``: cluster, id, weight; kinds: its shingles (docs: texts of the cluster with it, code, n); core: shingles that more than half of the
    cluster's texts have (docs, code, least: the least count in a text with it); size and heaviest: number and greatest weight of the cluster's texts.
    A text's features are its shingles outside the core and the core's shingles that it lacks, the rarest first: where two
    texts differ in few shingles, so do their features. a and d are the weights of both kinds before the feature.
    Those between two texts' first common feature and its start are not shared, so beyond what _may_reach allows a feature need not be
    looked at. The row with a null feature has the weights of all features, for texts so near to the core that they may share none.
    """
    kind = texts.schema["id"].dataType.simpleString()

    def lists(column: pa.ListArray) -> list[np.ndarray]:
        ends = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False)
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            columns = [lists(batch.column(c)) for c in ("docs", "code", "n", "core_docs", "core_code", "core_least")]
            numbers = [batch.column(c).to_numpy() for c in ("weight", "size", "heaviest")]
            for i, (docs, code, n, core_docs, core_code, least, weight, size, heaviest) in enumerate(zip(*columns, *numbers, strict=True)):
                more, less = ~np.isin(code, core_code), ~np.isin(core_code, code)
                feature = np.concatenate([code[more], core_code[less]])
                holders = np.concatenate([docs[more], size - core_docs[less]])
                a = np.concatenate([n[more], np.zeros(less.sum(), np.int64)])
                d = np.concatenate([np.zeros(more.sum(), np.int64), least[less]])
                order = np.lexsort((feature, holders))
                feature, holders, a, d = feature[order], holders[order], a[order], d[order]
                before_a, before_d = np.concatenate([[0], np.cumsum(a)]), np.concatenate([[0], np.cumsum(d)])
                use = _may_reach(before_a / weight, before_d / heaviest, threshold)
                use[:-1] &= holders > 1
                at = np.flatnonzero(use)
                rows.append(np.full(len(at), i))
                parts.append((np.append(feature, 0)[at], at == len(feature), before_a[at], before_d[at]))
            at = pa.array(np.concatenate(rows), pa.int64())
            feature, whole, a, d = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("cluster", "id", "weight")), pa.array(feature.astype(np.int64), mask=whole), pa.array(a), pa.array(d)], ["cluster", "id", "weight", "feature", "a", "d"])

    return texts.mapInArrow(run, f"cluster {kind}, id {kind}, weight long, feature long, a long, d long")


def _meeting_places(texts: DataFrame, clusters: DataFrame, threshold: float, size: int, salts: int = 16) -> DataFrame:
    """_prefixes of the texts (id, text) that are in clusters (id, cluster), and heaviest: the greatest weight in the cluster. Of an id with several texts, the least one."""
    texts = texts.join(clusters, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    rows = stage(_shingle_rows(texts, size).join(clusters, "id"))
    weights = rows.groupBy("cluster", "id").agg(F.sum("n").alias("weight"))
    sizes = stage(weights.groupBy("cluster").agg(F.count("*").alias("size"), F.max("weight").alias("heaviest")))
    counts = stage(rows.groupBy("cluster", "code").agg(F.count("*").alias("docs"), F.min("n").alias("least")))
    # a core has at most twice as many shingles as a text of its cluster on average
    core = counts.join(sizes, "cluster").where("2 * docs > size").groupBy("cluster").agg(F.collect_list(F.struct("docs", "code", "least")).alias("core"))
    core = sizes.join(core, "cluster", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    held = rows.join(counts, ["cluster", "code"]).groupBy("cluster", "id").agg(F.collect_list(F.struct("docs", "code", "n")).alias("kinds"), F.sum("n").alias("weight"))
    held = held.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(core, ["cluster", "salt"])
    none = F.array().cast("array<struct<docs:long,code:long,least:long>>")
    held = held.withColumn("core", F.coalesce("core", none))
    held = held.select("cluster", "id", "weight", "size", "heaviest", *[F.col(f"kinds.{c}").alias(c) for c in ("docs", "code", "n")], *[F.col(f"core.{c}").alias(f"core_{c}") for c in ("docs", "code", "least")])
    out = stage(_prefixes(held, threshold).join(sizes.select("cluster", "heaviest"), "cluster"))
    unstage(rows, counts, sizes)
    return out


def _close(threshold: float) -> Column:
    """Whether two texts (u_, v_) that share no feature before these can be similar."""
    c = F.col
    return _may_reach((c("u_a") + c("v_d")) / c("u_weight"), (c("v_a") + c("u_d")) / c("v_weight"), threshold)


def _sketches(places: DataFrame, buckets: int, registers: int = 3) -> DataFrame:
    """(cluster, id, buckets) of each text with a feature: hashes of the least of its features under ``registers`` orders, for each bucket.

    Two texts share a bucket with a probability that grows with the share of their features that they have in common.
    """
    least = [F.min(F.xxhash64("feature", F.lit(k))).alias(f"least_{k}") for k in range(buckets * registers)]
    held = places.where("feature IS NOT NULL").groupBy("cluster", "id").agg(*least)
    hashes = [F.xxhash64(F.lit(k), *[f"least_{k * registers + r}" for r in range(registers)]) for k in range(buckets)]
    return held.select("cluster", "id", F.array(*hashes).alias("buckets"))


def _level(side: str, threshold: float, levels: int) -> Column:
    """Where a text stands, from 0 to ``levels``, by the share of its weight that lies before a feature.

    If two texts are similar and share nothing before their features, these shares are together at most 1 / threshold - 1: by _may_reach, as
    1 / (1 - p) is at least 1 + p. So the levels of such texts are together at most ``levels``.
    """
    share = F.col(f"{side}_a") / F.col(f"{side}_weight") + F.col(f"{side}_d") / F.col(f"{side}_heaviest")
    return F.least(F.greatest(F.floor(share / max(1 / threshold - 1, 1e-9) * levels - 1e-6), F.lit(0)), F.lit(levels)).cast("int")


def _across(places: DataFrame, texts: DataFrame, links: DataFrame, known: DataFrame, threshold: float, size: int, rounds: int = 2, buckets: int = 8, levels: int = 32, linked: DataFrame | None = None) -> DataFrame | None:
    """Links (a, b, similarity) that join components of ``links`` (``linked``, if they are known) within clusters; None if there are none.

    First the text nearest to a cluster's core is compared with all others near to it. Then texts are put into buckets by their features, and
    the least of each bucket is compared with those of other components there, in rounds: work is linear in texts, and most that belong
    together come together. Last, and exactly, texts outside a cluster's largest component meet those of other components
    at features, at levels that leave room for each other. Pairs in ``known`` were compared before.
    """
    columns = ("id", "component", "weight", "heaviest", "a", "d")
    side = lambda df, k: df.select("cluster", "feature", *[F.col(c).alias(f"{k}_{c}") for c in columns])
    apart = F.col("u_component") != F.col("v_component")
    found, tried = None, []
    labels = components(links) if linked is None else linked
    every = places.select(F.col("id").alias("node")).distinct()
    member = stage(every.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    if linked is None:
        unstage(labels)

    def compare(met: DataFrame) -> None:
        """Add the links among pairs (u_id, v_id), and bring components up to date."""
        nonlocal found, member
        pairs = met.select(F.least("u_id", "v_id").alias("a"), F.greatest("u_id", "v_id").alias("b")).distinct()
        for before in (known, *tried):
            pairs = pairs.join(before.select("a", "b"), ["a", "b"], "left_anti")
        pairs = stage(pairs)
        tried.append(pairs)
        new = stage(_similar(pairs, texts, threshold, size))
        if not new.isEmpty():
            found = new if found is None else found.unionByName(new)
            now = merged(member, new)
            unstage(member)
            member = now

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(member.withColumnRenamed("node", "id"), "id")

    near = placed(places.where("feature IS NULL"))
    nearest = F.min_by(F.struct(*columns), F.struct(F.col("a") / F.col("weight") + F.col("d") / F.col("heaviest"), "id"))
    centre = near.groupBy("cluster").agg(nearest.alias("u")).select("cluster", *[F.col(f"u.{c}").alias(f"u_{c}") for c in columns])
    compare(side(near, "v").join(centre, "cluster").where(apart & _close(threshold)))
    sketches = stage(_sketches(places, rounds * buckets))
    for r in range(rounds):
        held = placed(sketches.select("cluster", "id", F.explode(F.slice("buckets", r * buckets + 1, buckets)).alias("bucket")))
        least = F.min(F.struct(F.col("id").alias("u_id"), F.col("component").alias("u_component"))).alias("u")
        leads = held.groupBy("cluster", "bucket").agg(least, F.max("id").alias("last")).where("u.u_id < last").select("cluster", "bucket", "u.*")
        compare(held.select("cluster", "bucket", F.col("id").alias("v_id"), F.col("component").alias("v_component")).join(leads, ["cluster", "bucket"]).where(apart))
    here = stage(placed(places))
    parts = here.select("cluster", "component", "id").distinct().groupBy("cluster", "component").agg(F.count("*").alias("n"))
    main = stage(parts.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts"))
    inside = here.join(main, "cluster")
    outside = side(inside.where("component <> main"), "u").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels) - _level("u", threshold, levels))))
    other = side(inside, "v").withColumn("level", _level("v", threshold, levels))
    same = (outside["cluster"] == other["cluster"]) & outside["feature"].eqNullSafe(other["feature"]) & (outside["level"] == other["level"])
    compare(outside.join(other, same & apart & _close(threshold)))
    unstage(member, sketches, here, main, *tried)
    return found


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 20, rows: int = 5, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id) for every row of ``docs``; class_id is the least id of the class.

    Texts of equal words are one node, its least id; only nodes are compared. In each bucket of a band the least
    node is compared with the others. Where that leaves a bucket in several components, the texts of such buckets, in clusters joined by common
    buckets, are searched for the remaining links by features that similar texts must share (see _prefixes); there no pair as
    similar as ``threshold`` is left out, whether it shares a bucket or not, and pairs that cannot be similar are not made. A text
    without a word is a class of its own, also when null; a null id has a null class; repeated rows repeat. A very long text counts whole.

    Shuffled: ids, keys and bands; texts once, of those in some candidate pair again for the comparison; shingles of those in divided buckets.
    """
    sig = stage(signatures(docs, bands, rows, size, id_col, text_col).withColumnRenamed(id_col, "id"))
    keyed = sig.where("key IS NOT NULL AND id IS NOT NULL")
    first = stage(keyed.groupBy("key").agg(F.min("id").alias("first")))
    node = keyed.join(first, "key").where("id = first")
    flat = node.select("id", F.explode("bands").alias("bucket"))
    leaders = flat.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last").select("bucket", "leader")
    shared = stage(flat.join(leaders, "bucket"))
    pairs = stage(shared.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    wanted = stage(shared.select("id").distinct())
    texts = with_maybe(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL"), "id", wanted, "maybe").where("maybe")
    texts = stage(texts.select("id", "text").join(wanted, "id", "left_semi"))
    links = stage(_similar(pairs, texts, threshold, size))
    member = components(links)
    # buckets whose nodes are in several components
    placed = shared.join(member, shared["id"] == member["node"], "left").select("bucket", "leader", "id", F.coalesce("component", "id").alias("component"))
    divided = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    clusters = components(shared.join(divided, "bucket", "left_semi").select(F.col("leader").alias("a"), F.col("id").alias("b")))
    if not clusters.isEmpty():
        places = _meeting_places(texts, clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), threshold, size)
        found = _across(places, texts, links, pairs, threshold, size, linked=member)
        if found is not None:
            now = merged(member, found)
            unstage(member)
            member = now
        unstage(places)
    unstage(clusters, wanted, pairs, texts, shared, links)
    known = keyed.select("id", "key").join(first, "key").join(member.withColumnRenamed("node", "first"), "first", "left")
    known = known.select("id", F.coalesce("component", "first").alias("class_id"))
    rest = sig.where("key IS NULL OR id IS NULL").select("id", F.col("id").alias("class_id"))
    return known.unionByName(rest).withColumnRenamed("id", id_col)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its class; of repeated rows of an id one stays. Rows without an id stay."""
    classes = stage(near_duplicates(docs, id_col=id_col, **options).where(F.col(id_col).isNotNull()))
    counted = classes.groupBy(id_col).agg(F.min("class_id").alias("class_id"), F.count("*").alias("n"))
    out = stage(counted.where((F.col("class_id") != F.col(id_col)) | (F.col("n") > 1)))
    flag = "maybe"
    while flag in docs.columns:
        flag += "_"
    flagged = with_maybe(docs, id_col, out, flag)
    # only rows that may go are shuffled
    kept = flagged.where(~F.col(flag)).select(docs.columns).unionByName(flagged.where(F.col(flag)).join(out.select(id_col), id_col, "left_anti").select(docs.columns))
    repeated = out.where((F.col("class_id") == F.col(id_col)) & (F.col("n") > 1)).select(id_col)
    if repeated.isEmpty():
        return kept
    return kept.unionByName(docs.join(repeated, id_col, "left_semi").dropDuplicates([id_col]).select(docs.columns))
