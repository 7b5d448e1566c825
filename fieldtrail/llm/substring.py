"""Substring dedup by anchored block and window hashing, in place of Relative Lempel-Ziv parsing.

Every text is compared with all texts with smaller ids. They are indexed by anchors: the least hash of the
short word runs in a window (winnowing), so two equal windows have the same anchor. Blocks, the stretches of windows with one
anchor, are matched whole against the first text that holds the same block. What blocks leave
at their boundaries, and blocks seen for the first time, is matched window by window. Matches merge into duplicate spans.
No match is extended beyond its block as a greedy parse would do.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrail.llm.common import WordHashes, _power_tables, mix, rolling, runs, stage, unstage, with_maybe

WINDOW, GRAM = 50, 10
_WORD = re.compile("[^\x20\x09-\x0d]+")
#: Of the words seen last, in each worker.
_HASHES = WordHashes()
_NOTHING = hashlib.sha256(b"").hexdigest()


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _anchors(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor of each window: the least gram hash in it, by minima over doubled stretches."""
    least = rolling(hashes, gram)
    width, grams = 1, window - gram + 1
    while 2 * width <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = grams - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _blocks(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each stretch with one anchor."""
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    return first, np.diff(np.concatenate([first, [len(anchors)]]))


def _key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int64), kind))


def _index(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """(id, key, n_words, sha256, anchors) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, shas, anchors = [], [], [], []
            for text in batch[1].to_pylist():
                words = split(text)
                joined = b" ".join(words)
                keys.append(xxhash.xxh3_128_digest(joined))
                sizes.append(len(words))
                shas.append(hashlib.sha256(joined).hexdigest())
                if len(words) >= window:
                    all_ = _anchors(_HASHES.of(words), window, gram)
                    anchors.append(np.unique(all_[_blocks(all_)[0]]).view(np.int64))
                else:
                    anchors.append(np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), _list_array(anchors, pa.int64())], ["id", "key", "n_words", "sha256", "anchors"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, key binary, n_words long, sha256 string, anchors array<long>")


def _block_rows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, key, start, n, block): blocks whose anchor is among the row's shared ones; ``block`` hashes all their words."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, size, code = [], [], [], []
            for i, (text, key, shared) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "key", "anchors")), strict=True)):
                words = split(text)
                if len(words) < window or _key(words) != key:
                    continue
                hashes = _HASHES.of(words)
                anchors = _anchors(hashes, window, gram)
                first, n = _blocks(anchors)
                known = np.isin(anchors[first].view(np.int64), np.array(shared, np.int64))
                first, n = first[known], n[known]
                power, inverse = _power_tables(len(words) + 1)
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[: len(hashes)], dtype=np.uint64)])
                    whole = (total[first + n - 1 + window] - total[first]) * inverse[first]
                    code.append(mix(mix(whole) + n.astype(np.uint64)))
                row.append(np.full(len(first), i))
                start.append(first)
                size.append(n)
            if not row:
                continue
            at = pa.array(np.concatenate(row), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("key").take(at), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (start, size)), pa.array(np.concatenate(code).view(np.int64))], ["id", "key", "start", "n", "block"])

    return texts.select("id", "key", "text", "anchors").mapInArrow(run, f"id {kind}, key binary, start long, n long, block long")


def _window_rows(texts: DataFrame, window: int) -> DataFrame:
    """(id, key, place, code, code2): the windows of the row's open blocks, with 96 bits of hash."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, blocks) in enumerate(zip(batch.column("text").to_pylist(), batch.column("blocks").to_pylist(), strict=True)):
                todo = [np.arange(b["start"], b["start"] + b["n"]) for b in blocks if b["open"]]
                if not todo:
                    continue
                place = np.concatenate(todo)
                hashes = _HASHES.of(split(text))
                one, two = rolling(hashes, window)[place], rolling(mix(hashes, 7), window)[place]
                at = pa.array(np.full(len(place), i), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("key").take(at), pa.array(place), pa.array(one.view(np.int64)), pa.array((two >> np.uint64(33)).astype(np.int32))], ["id", "key", "place", "code", "code2"])

    return texts.select("id", "key", "text", "blocks").mapInArrow(run, f"id {kind}, key binary, place long, code long, code2 int")


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _cut_rows(texts: DataFrame, window: int) -> DataFrame:
    """(id, key, n_removed, sha256, spans): factors merged to spans, for rows with any."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, (text, blocks, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "blocks", "places")), strict=True)):
                factors = [(b["start"], b["start"] + b["n"] - 1 + window) for b in blocks if not b["open"]] + [(p, p + window) for p in places or ()]
                if not factors:
                    continue
                words = split(text)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [f[0] for f in factors], 1)
                np.add.at(edge, [f[1] for f in factors], -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                rows.append(i)
                out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"first": int(a), "last": int(b) - 1} for a, b in zip(*runs(gone), strict=True)]))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("key").take(at), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], _SPANS)], ["id", "key", "n_removed", "kept", "spans"])

    return texts.select("id", "key", "text", "blocks", "places").mapInArrow(run, f"id {kind}, key binary, n_removed long, kept string, spans array<struct<first:long,last:long>>")


def duplicate_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, key (hash of the words), n_words, n_removed, kept_sha256, spans (first and last word of each, from 0).

    A word is removed if a window of ``window`` words that covers it also starts in a row with a smaller id. Windows are judged
    on the input. Texts of equal words: all but the least id are removed whole, if long enough, and only the first
    is parsed. A null text has no words. Rows without an id are neither parsed nor a reference. Repeated rows repeat;
    one id with several texts has a result for each.

    Shuffled: anchors (about 2 of 42 words) twice, texts that share an anchor, and windows of what is new in those.
    """
    index = stage(_index(docs, id_col, text_col, window, gram))
    known = index.where("id IS NOT NULL")
    first = stage(known.groupBy("key").agg(F.min("id").alias("first")))
    anchors = known.where(F.size("anchors") > 0).join(first, "key").where("id = first").select("id", "key", F.explode("anchors").alias("anchor"))
    common = stage(anchors.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor"))
    sharing = stage(anchors.join(common, "anchor").groupBy("id", "key").agg(F.collect_list("anchor").alias("anchors")))
    texts = with_maybe(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", sharing, "maybe").where("maybe").select("id", "text")
    texts = stage(texts.join(sharing, "id"))
    unstage(common, sharing)
    # level 1: whole blocks; the first text with a block is its source
    blocks = stage(_block_rows(texts, window, gram).distinct())
    source = stage(blocks.groupBy("block").agg(F.min("id").alias("source")))
    parsed = blocks.join(source, "block").groupBy("id", "key").agg(F.collect_list(F.struct("start", "n", (F.col("source") >= F.col("id")).alias("open"))).alias("blocks"))
    texts2 = stage(texts.drop("anchors").join(stage(parsed), ["id", "key"]).dropDuplicates(["id", "key"]))
    unstage(texts, blocks, source)
    # level 2: windows of blocks that have no earlier source
    windows = _window_rows(texts2, window)
    origin = stage(windows.groupBy("code", "code2").agg(F.min("id").alias("source"), F.max("id").alias("last")).where("source < last").select("code", "code2", "source"))
    again = windows.join(origin, ["code", "code2"]).where("source < id").groupBy("id", "key").agg(F.collect_list("place").alias("places"))
    cut = stage(_cut_rows(texts2.join(stage(again), ["id", "key"], "left"), window))
    unstage(texts2, origin)
    # every row: a later copy, a text with spans, or untouched
    placed = index.select("id", "key", "n_words", "sha256").join(first, "key", "left")
    copy = (F.col("first") < F.col("id")) & (F.col("n_words") >= window)
    rows = placed.withColumn("copy", F.coalesce(copy, F.lit(False))).join(cut, ["id", "key"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("n_words") - 1).alias("last")))
    none = F.array().cast("array<struct<first:long,last:long>>")
    return rows.select(
        F.col("id").alias(id_col), "key", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(_NOTHING)).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", none)).alias("spans"),
    )


def without(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans, and without the white space after them."""
    words = list(_WORD.finditer(text))
    out, at = [], 0
    for s in spans:
        out.append(text[at : words[s["first"]].start()])
        at = words[s["last"] + 1].start() if s["last"] + 1 < len(words) else len(text)
    return "".join([*out, text[at:]]).rstrip() if spans else text


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with duplicate spans cut out of the text and its length set anew; rows of which nothing is left go.
    Rows without spans, also null and empty ones, stay as they are."""
    spans = stage(duplicate_spans(docs, id_col=id_col, text_col=text_col, **options).where("n_removed > 0").select(F.col(id_col), "key", "spans").dropDuplicates([id_col, "key"]))
    names, cuts_col = docs.columns, "cuts"
    while cuts_col in names:
        cuts_col += "_"
    spans = spans.groupBy(id_col).agg(F.collect_list(F.struct("key", "spans")).alias(cuts_col))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(text_col).to_pylist(), []
            for i, cuts in enumerate(batch.column(cuts_col).to_pylist()):
                if cuts:
                    key = _key(split(texts[i]))
                    mine = next((c["spans"] for c in cuts if c["key"] == key), [])
                    texts[i] = without(texts[i], mine)
                    keep.append(not mine or bool(split(texts[i])))
                else:
                    keep.append(True)
            columns = {n: batch.column(n) for n in names} | {text_col: pa.array(texts, pa.string())}
            if length_col in names:
                columns[length_col] = pa.array([n if c is None or t is None else len(t) for n, c, t in zip(batch.column(length_col).to_pylist(), batch.column(cuts_col).to_pylist(), texts, strict=True)], columns[length_col].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names).filter(pa.array(keep, pa.bool_()))

    spans, flag = stage(spans), cuts_col + "_maybe"
    while flag in names:
        flag += "_"
    flagged = with_maybe(docs, id_col, spans, flag)
    # only rows that may be cut are shuffled
    rest = flagged.where(~F.col(flag)).select(*names)
    return rest.unionByName(flagged.where(F.col(flag)).join(spans, id_col, "left").select(*names, cuts_col).mapInArrow(cut, docs.schema))
