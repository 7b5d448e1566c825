"""Best-two-fit packing of token sequences.

A bin is filled greedily with the largest documents that fit; then its smallest document is replaced with
two unpacked ones if these fill the expanded gap more tightly. Only lengths matter for that, and there are at most as
many lengths as a sequence has tokens: the plan is made on counts of lengths, where a bin's pattern is
repeated as long as the counts allow. Documents then find their places in the plan by their rank among
those of their length, which needs no global order.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtrail.llm.common import stage

#: Characters whose normal form and lower case are plain, so that a chunk of them can be cut with a simple pattern.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
_PRE_TOKEN = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
#: White space for Python's split(), but not for the tokenizer.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
END = np.uint32(1).tobytes()


def byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder(dict):
    """Chunk (no white space) to its ids as little-endian 32-bit bytes; forgets all at ``limit`` chunks.

    The tokenizer never joins what white space parts, so a text's ids are those of its chunks in order. ``word`` keeps the
    ids of pre-tokens, which many chunks share.
    """

    def __init__(self, path: str, limit: int = 700_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.limit = self.tokenizer.model, byte_letters(), limit
        self.word: dict[str, bytes] = {}

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if len(chunk) > 200 or "<|" in chunk or not _PLAIN.fullmatch(chunk):
            ids = self._direct(chunk)
        else:
            ids = b"".join([self.word.get(w) or self._word(w) for w in _PRE_TOKEN.findall(chunk.lower())])
        self[chunk] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if len(self.word) >= self.limit:
            self.word.clear()
        spelled = word.encode().decode("latin-1").translate(self.letters)
        ids = self.word[word] = np.array([t.id for t in self.model.tokenize(spelled)], np.uint32).tobytes()
        return ids

    def ids(self, text: str | None) -> bytes:
        """The ids of a text and the closing id."""
        if not text:
            return END
        if _ODD_SPACE.search(text):
            return self._direct(text) + END
        return b"".join(map(self.__getitem__, text.split())) + END


_encoders: dict[str, Encoder] = {}


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, rank): a row per piece of each text. part: the partition that made it; rank: its number
    among those of its length there. A null text counts as empty: one piece, the closing id."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = Encoder(tokenizer_path)
        encode, part = _encoders[tokenizer_path].ids, TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(batch[1].to_pylist()):
                ids = encode(text)
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[start : start + 4 * capacity]
                    n = len(cut) // 4
                    row.append(i)
                    out.append((piece, start // 4, n, zlib.crc32(cut), part, seen[n]))
                    seen[n] += 1
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(row, pa.int64())), *columns], [id_col, "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long")


class Plan:
    """Bins for counts of lengths. Per length and range of ranks: the first bin, how many of that length each bin takes, and their offset."""

    def __init__(self, counts: dict[int, int], capacity: int = 4096):
        left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            left[length] = n
        used = np.zeros(capacity + 1, np.int64)
        lengths = np.arange(capacity + 1)
        below = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # the largest length left up to each
        rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, first bin, uses, offset
        self.bins = self.patterns = 0
        while below[capacity]:
            pattern = self._pattern(left, below, lengths, capacity)
            times = min(int(left[x]) // n for x, n in pattern.items())
            offset = 0
            for x, n in sorted(pattern.items(), reverse=True):
                rows.append((x, int(used[x]), self.bins, n, offset))
                offset += x * n
                used[x] += n * times
                left[x] -= n * times
            self.bins += times
            self.patterns += 1
            if any(not left[x] for x in pattern):
                below = np.maximum.accumulate(np.where(left > 0, lengths, 0))
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.key, self.first_rank, self.first_bin, self.uses, self.offset = (table[:, 0] << 48) + table[:, 1], table[:, 1], table[:, 2], table[:, 3], table[:, 4]

    @staticmethod
    def _pattern(left: np.ndarray, below: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
        pattern: dict[int, int] = {}
        gap, top = capacity, capacity
        while gap and (x := int(below[min(gap, top)])):
            n = min(int(left[x]), gap // x)
            pattern[x] = n
            gap -= n * x
            top = x - 1
        if gap and pattern:
            # the smallest one against two that fill more of the gap that it would leave
            small = min(pattern)
            room = gap + small
            spare = left.copy()
            for x, n in pattern.items():
                spare[x] -= n
            free = lengths[1:room][spare[1:room] > 0]
            if len(free):
                under = np.maximum.accumulate(np.where(spare[: room + 1] > 0, lengths[: room + 1], 0))
                other = under[room - free]
                twin = (other == free) & (spare[free] < 2)
                other[twin] = under[np.maximum(other[twin] - 1, 0)]
                total = np.where(other > 0, free + other, 0)
                best = int(total.argmax())
                if total[best] > small:
                    pattern[small] -= 1
                    if not pattern[small]:
                        del pattern[small]
                    for x in (int(free[best]), int(other[best])):
                        pattern[x] = pattern.get(x, 0) + 1
        return pattern

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of the documents with these lengths and ranks among their length."""
        at = np.searchsorted(self.key, (length << 48) + rank, "right") - 1
        q = rank - self.first_rank[at]
        return self.first_bin[at] + q // self.uses[at], self.offset[at] + q % self.uses[at] * length


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row; repeated rows are packed each.

    The driver gets the counts of at most ``capacity`` lengths, and broadcasts a plan of a few rows for each.
    An empty table gives no row.
    """
    pieces = stage(tokenize(docs, tokenizer_path, capacity, id_col, text_col))
    counts = stage(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    base = stage(counts.select("length", "part", before.alias("base")))
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    kind = docs.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, offset = shared.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (id_col, "piece", "start", "length", "ids_crc32")), pa.array(where), pa.array(offset)], [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # lengths x partitions grow with the table, so they are not broadcast
    ranked = pieces.join(base.hint("merge"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.mapInArrow(place, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
