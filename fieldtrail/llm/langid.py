"""Language ID by prediction by partial matching (PPM).

Per language a variable-order byte context tree (orders 3 to 0, then a uniform order -1) with escape
probabilities of method C. The statistics are frozen after the fit, so the code length of a byte
depends on its last three bytes alone: a text's code length is a sum of table lookups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrail.llm.common import sampled

#: ASCII bytes that are no letters become blanks.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
ORDER = 3
UNKNOWN = "und"
#: Bits by which letter frequencies may beat a text's language before it is rejected: chance has that in 2^-10 of texts of the language.
SLACK_BITS = 10.0
_DIGIT = re.compile(r"\d")


def letters_only(text: str) -> bytes:
    """Lower-case text as bytes, with every run of ASCII non-letters turned into one blank."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def grams(data: bytes) -> np.ndarray:
    """The last four bytes up to each byte, as one number; blanks stand before the start."""
    b = np.frombuffer(b"   " + data, np.uint8).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


class _Lookup:
    """Index of each code in a sorted array, -1 where absent; a hash table with a binary search for collisions."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = np.uint32(32 - min(22, max(8, int(len(codes) * 8).bit_length())))
        slot = self._slot(codes)
        size = 1 << (32 - int(self.bits))
        self.index = np.full(size, -1, np.int32)
        self.index[slot[::-1]] = np.arange(len(codes), dtype=np.int32)[::-1]
        self.crowded = np.bincount(slot, minlength=size) > 1

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (codes * np.uint32(2654435761)) >> self.bits

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(codes), -1, np.int32)
        slot = self._slot(codes)
        found = self.index[slot]
        miss = (found < 0) | (self.codes[found] != codes)
        again = np.flatnonzero(miss & self.crowded[slot])
        found[miss] = -1
        if len(again):
            at = np.minimum(np.searchsorted(self.codes, codes[again]), len(self.codes) - 1)
            found[again] = np.where(self.codes[at] == codes[again], at, -1)
        return found


class PpmModel:
    """Code lengths in bits. ``counts``: per language, sorted distinct 4-byte codes and how often each was seen."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        n_langs = len(self.langs)
        #: [order]: the lookup of grams of order + 1 bytes, their costs, the lookup of contexts and their escape costs.
        self.levels: list[tuple[_Lookup, np.ndarray, _Lookup, np.ndarray]] = []
        self.uniform = 8.0
        for order in range(ORDER + 1):
            mask = np.uint32((1 << (8 * (order + 1))) - 1) if order < 3 else np.uint32(0xFFFFFFFF)
            per_lang = []
            for lang in self.langs:
                codes, inverse = np.unique(counts[lang][0] & mask, return_inverse=True)
                per_lang.append((codes, np.bincount(inverse, weights=counts[lang][1]) if len(codes) else np.empty(0)))
            union = np.unique(np.concatenate([c for c, _ in per_lang])) if n_langs else np.empty(0, np.uint32)
            contexts = np.unique(union >> np.uint32(8))
            context_of = _Lookup(contexts)
            escape = np.zeros((len(contexts), n_langs))
            lower = self._lower(union, order)
            cost = np.empty((len(union), n_langs))
            for k, (codes, seen) in enumerate(per_lang):
                at = np.searchsorted(contexts, codes >> np.uint32(8))
                total = np.bincount(at, weights=seen, minlength=len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                live = kinds > 0
                escape[live, k] = -np.log2(kinds[live] / (total[live] + kinds[live]))
                cost[:, k] = lower[:, k] + escape[np.searchsorted(contexts, union >> np.uint32(8)), k]
                here = np.searchsorted(union, codes)
                cost[here, k] = -np.log2(seen / (total[at] + kinds[at]))
            self.levels.append((_Lookup(union), cost.astype(np.float32), context_of, escape.astype(np.float32)))

    def _lower(self, codes: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.full((len(codes), len(self.langs)), self.uniform)
        return self.costs(codes & np.uint32((1 << (8 * order)) - 1), order - 1)

    def costs(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of the last byte of each code after the bytes before it, a column per language."""
        lookup, table, context_of, escape = self.levels[order]
        at = lookup(codes)
        lost = np.flatnonzero(at < 0)
        out = table[at] if len(table) else np.zeros((len(codes), len(self.langs)), np.float32)
        if len(lost):
            rest = self._lower(codes[lost], order)
            ctx = context_of(codes[lost] >> np.uint32(8))
            out[lost] = rest + np.where((ctx >= 0)[:, None], escape[ctx] if len(escape) else 0, 0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        some, data, size = [], [], 0

        def decide() -> None:
            ends = np.cumsum([len(x) for x in data])
            bits = self.costs(np.concatenate(data))
            sums = np.add.reduceat(bits, np.concatenate([[0], ends[:-1]]), axis=0, dtype=np.float64)
            for i, total, n in zip(some, sums, map(len, data), strict=True):
                best = int(total.argmin())
                langs[i] = self.langs[best]
                # the posterior of the best, evened out as if no text were longer than 32 bytes
                scores[i] = float(1 / np.exp2(-(total - total[best]) * min(1.0, 32 / n)).sum())

        for i, text in enumerate(texts):
            if text is None or not any(map(str.isalpha, text)):
                continue
            some.append(i)
            data.append(grams(letters_only(text) + b" "))
            size += len(data[-1])
            if size > 300_000:
                decide()
                some, data, size = [], [], 0
        if some:
            decide()
        return langs, scores

    def accepts(self, texts: list[str | None]) -> list[bool]:
        """Whether a learned language codes the text acceptably: no worse than its letters' frequencies alone do.

        Words with digits (numbers, keys) are no words of a language, and are looked at only in texts of nothing
        else. Null and texts without a letter are rejected; without a language all texts with a letter are accepted.
        """
        out = [text is not None and any(map(str.isalpha, text)) for text in texts]
        if not self.langs:
            return out
        some: list[int] = []
        data: list[np.ndarray] = []
        size = 0

        def decide() -> None:
            starts = np.cumsum([0, *map(len, data[:-1])])
            codes = np.concatenate(data)
            best, plain = (np.add.reduceat(bits, starts, axis=0, dtype=np.float64).min(axis=1) for bits in (self.costs(codes), self.costs(codes & np.uint32(255), 0)))
            for i, ok in zip(some, best <= plain + SLACK_BITS, strict=True):
                out[i] = bool(ok)

        for i, text in enumerate(texts):
            if out[i]:
                words = letters_only(" ".join(w for w in text.split() if not _DIGIT.search(w)))
                some.append(i)
                data.append(grams((words or letters_only(text)) + b" "))
                size += len(data[-1])
                if size > 300_000:
                    decide()
                    some, data, size = [], [], 0
        if some:
            decide()
        return out


def fit(train: DataFrame, id_col: str = "doc_id", docs_per_lang: int = 600) -> PpmModel:
    """Fit on about ``docs_per_lang`` whole texts of each language, chosen by a hash of the id.

    ``train`` needs ``id_col``, text and lang; rows without text or lang are left out; without any the model knows no language.
    The context trees hold all that the sample has, so the sample alone bounds the model's size on the driver and in the broadcast.
    """
    train = train.select(id_col, "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    shares = {r["lang"]: min(1.0, docs_per_lang / r["n"]) for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return PpmModel({})
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("lang")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if any(map(str.isalpha, text)):
                    seen.setdefault(lang, []).append(grams(letters_only(text) + b" "))
            for lang, parts in seen.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    counted = train.where(sampled(id_col, share)).select("lang", "text").mapInArrow(count, "lang string, code long, n long")
    nodes = counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for lang, part in nodes.groupby("lang"):
        part = part.sort_values("code")
        out[lang] = (part["code"].to_numpy().astype(np.uint32), part["n"].to_numpy().astype(np.float64))
    return PpmModel(out)


def identify(docs: DataFrame, model: PpmModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score; ``und`` and 0 where text is null or has no letter.

    Columns of ``docs`` with these names are replaced. Texts are read whole, repeated rows stay, and an empty table gives no row;
    of languages with equal code lengths the first by name wins.
    """
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch[text_col].to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "lang_score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(score, f"{ddl}, lang_pred string, lang_score double")


def keep_known(docs: DataFrame, model: PpmModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text a language of the model codes acceptably; texts that are null or without a letter go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.accepts(batch.column(text_col).to_pylist()), pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
