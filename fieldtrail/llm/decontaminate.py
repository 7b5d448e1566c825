"""Benchmark decontamination by greedy string tiling.

A text and a test passage that share a seed (a run of ``min_tile`` words, by Karp-Rabin hash) are tiled:
the longest common run that is unmarked in both is marked, again and again. Tiles do not overlap and
may come in any order, so a passage with its parts moved about is still covered. The share of the passage's words
under tiles is tested against a threshold.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrail.llm.common import WordHashes, rolling, stage

_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))

#: Of the words seen last, in each worker.
_HASHES = WordHashes()


def words(text: str | None) -> list[bytes]:
    """Lower-case words: runs of letters, digits and non-ASCII characters."""
    return (text or "").lower().encode("utf-8", "replace").translate(_WORD_BYTES).split()


def tiles(item: list[bytes], text: list[bytes], seeds: list[tuple[int, int]], min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in text, words). ``seeds``: all pairs of places at which ``min_tile`` words are equal.

    Longest first, ties by place in the item, then in the text. What is left of a match between marks is taken up again as a shorter one.
    """
    waiting: list[tuple[int, int, int]] = []
    by_diagonal: dict[int, list[int]] = {}
    for i, j in seeds:
        by_diagonal.setdefault(j - i, []).append(i)
    for d, starts in by_diagonal.items():
        starts.sort()
        first = before = starts[0]
        for i in [*starts[1:], None]:
            if i != before + 1:
                waiting.append((-(before - first + min_tile), first, first + d))
                first = i
            before = i
    heapq.heapify(waiting)
    used_item, used_text = np.zeros(len(item), bool), set()
    out = []
    while waiting:
        size, i, j = heapq.heappop(waiting)
        free = [not used_item[i + k] and j + k not in used_text for k in range(-size)]
        if all(free):
            out.append((i, j, -size))
            used_item[i : i - size] = True
            used_text.update(range(j, j - size))
            continue
        first = None
        for k, f in enumerate([*free, False]):
            if f and first is None:
                first = k
            elif not f and first is not None:
                if k - first >= min_tile:
                    heapq.heappush(waiting, (first - k, i + first, j + first))
                first = None
    return out


class PassageIndex:
    """Seeds of a bounded block of test passages. A passage shorter than ``min_tile`` words has one seed, the whole of it."""

    def __init__(self, items: list[tuple[object, str | None]], min_tile: int = 5, threshold: float = 0.5):
        self.min_tile, self.threshold = min_tile, threshold
        hashes = WordHashes()
        self.items, self.sizes = [], sorted({min(min_tile, len(words(t))) for _, t in items} - {0})
        seeds: dict[int, tuple[list, list, list]] = {n: ([], [], []) for n in self.sizes}
        for item_id, text in items:
            ws = words(text)
            n = min(min_tile, len(ws))
            if n:
                codes = rolling(hashes.of(ws), n)
                seeds[n][0].append(codes)
                seeds[n][1].append(np.full(len(codes), len(self.items)))
                seeds[n][2].append(np.arange(len(codes)))
                self.items.append((item_id, ws))
        #: by seed size: sorted codes, their passage, their place there, and a table of the codes' top 20 bits
        self.seeds = {}
        for n, (codes, of, at) in seeds.items():
            codes, of, at = map(np.concatenate, (codes, of, at))
            order = np.argsort(codes, kind="stable")
            top = np.zeros(1 << 20, bool)
            top[(codes >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[n] = codes[order], of[order], at[order], top

    def found(self, text: list[bytes], hashes: np.ndarray) -> list[tuple[object, int, int, int, float]]:
        """Per passage that reaches the threshold: id, words, words covered, tiles, share covered."""
        out = []
        for n, (codes, of, at, top) in self.seeds.items():
            mine = rolling(hashes, n)
            maybe = np.flatnonzero(top[(mine >> np.uint64(44)).astype(np.int64)])
            if not len(maybe):
                continue
            left, right = np.searchsorted(codes, mine[maybe], "left"), np.searchsorted(codes, mine[maybe], "right")
            hit = right > left
            if not hit.any():
                continue
            pairs: dict[int, list[tuple[int, int]]] = {}
            for j, a, b in zip(maybe[hit].tolist(), left[hit].tolist(), right[hit].tolist(), strict=True):
                for k in range(a, b):
                    pairs.setdefault(int(of[k]), []).append((int(at[k]), j))
            for item, seeds in pairs.items():
                item_id, ws = self.items[item]
                under = np.zeros(len(ws) + 1, np.int64)
                for i in {i for i, _ in seeds}:
                    under[i] += 1
                    under[i + n] -= 1
                if (np.cumsum(under)[:-1] > 0).sum() < self.threshold * len(ws):
                    continue  # not even all seeds together cover enough
                seeds = [(i, j) for i, j in seeds if ws[i : i + n] == text[j : j + n]]
                got = tiles(ws, text, seeds, n) if seeds else []
                covered = sum(t[2] for t in got)
                if covered >= self.threshold * len(ws) and got:
                    out.append((item_id, len(ws), covered, len(got), covered / len(ws)))
        return out

    def scan(self, texts: list[str | None]) -> Iterator[list]:
        for text in texts:
            ws = words(text)
            yield self.found(ws, _HASHES.of(ws)) if ws else []


def passage_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_chars: int = 8_000_000, **options) -> Iterator[tuple[PassageIndex, bool]]:
    """Indexes over blocks of the passages, each of about ``block_chars`` characters, so that what is broadcast is bounded.
    Null passages are left out; repeated ones count once. With each, whether there are several."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL").dropDuplicates()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-size // block_chars))
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k).orderBy("item", "text").collect()
        yield PassageIndex([(r["item"], r["text"]) for r in rows], **options), n_blocks > 1


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **options) -> DataFrame:
    """(id, item_id, n_words, n_covered, n_tiles, coverage) for each text and passage whose coverage reaches the threshold.

    Null and empty texts have no row; a repeated row of ``docs`` repeats its rows. The texts are read once for each
    block of passages, and never shuffled; texts are read whole. Longest tiles come first, of equal ones the first in the passage, then in the text.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out = None
    for index, several in passage_blocks(benchmark, item_col, **options):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *x) for i, found in enumerate(shared.value.scan(batch[1].to_pylist())) for x in found]
                columns = [batch[0].take(pa.array([r[0] for r in rows], pa.int64()))]
                columns += [pa.array([r[k] for r in rows], t) for k, t in enumerate((None, pa.int64(), pa.int64(), pa.int64(), pa.float64()), 1)] if rows else []
                if rows:
                    yield pa.RecordBatch.from_arrays(columns, [id_col, "item_id", "n_words", "n_covered", "n_tiles", "coverage"])

        part = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, item_id {item_kind}, n_words long, n_covered long, n_tiles long, coverage double")
        if several:  # one block at a time
            part = stage(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no passage; null and empty texts stay."""
    for index, several in passage_blocks(benchmark, item_col, **options):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found for found in shared.value.scan(batch.column(text_col).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
        if several:  # one block at a time
            docs = stage(docs)
            shared.destroy()
    return docs
