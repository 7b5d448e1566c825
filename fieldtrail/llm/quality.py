"""Quality rules by line sequence labelling.

A linear-chain conditional random field (CRF) labels each line of a text content or boilerplate; its
Viterbi path gives the share of content, which decides retention. Plain base counts stand beside it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrail.llm.common import labelled_sample

_SPACE = str.maketrans("", "", " \t\n\x0b\x0c\r")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_NOT_SYMBOL = bytes(b for b in range(256) if b not in b"#*$%&|<>")
FEATURES = ["symbols", "shouting", "bars", "exclaims", "repeats", "neighbours", "short", "digits", "copied", "links"]
N_FEATURES = len(FEATURES) + 1
CONTENT, BOILERPLATE = 1, 0


def base_counts(text: str | None) -> dict[str, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; all 0 for null."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n, repeats = len(words), 0
    if n >= 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, n)
        k = np.uint64(len(ids))
        if len(ids) < 2_000_000:  # three ids fit in 64 bits
            window = (w[:-2] * k + w[1:-1]) * k + w[2:]
            _, inverse, seen = np.unique(window, return_inverse=True, return_counts=True)
            often = seen[inverse] > 1
        else:
            often_of = Counter(zip(words, words[1:], words[2:], strict=False))
            often = np.fromiter((often_of[x] > 1 for x in zip(words, words[1:], words[2:], strict=False)), bool, n - 2)
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= often
        repeats = int(covered.sum())
    lines = [x for x in data.split(b"\n") if x.split()]
    return {"n_words": n, "word_chars": len(text.translate(_SPACE)), "n_symbols": len(data.translate(None, _NOT_SYMBOL)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeats}


def line_features(text: str) -> np.ndarray:
    """A row for each line that has a word: features between 0 and 1, and a constant."""
    rows, before = [], set()
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        n, chars = len(words), len(line)
        letters = sum(map(str.isalpha, line)) or 1
        data = line.encode("utf-8", "replace")
        seen = len(set(words))
        rows.append([
            min(1.0, 10 * (chars - letters - line.count(" ") - line.count(".") - line.count(",")) / chars) if len(data.translate(None, _NOT_SYMBOL)) > 2 else 0.0,
            1.0 if n > 2 and line.upper() == line and letters > 10 else 0.0,
            min(1.0, 4 * line.count("|") / n),
            min(1.0, 4 * line.count("!") / n),
            min(1.0, 3 * max(0.0, 1 - seen / n - 0.25)) if n > 5 else 0.0,
            min(1.0, 4 * sum(a == b for a, b in zip(words, words[1:], strict=False)) / n),
            1.0 if n < 4 else 0.0,
            min(1.0, 3 * sum(map(str.isdigit, line)) / chars),
            1.0 if line in before else 0.0,
            min(1.0, 5 * line.count("://") / n),
            1.0,
        ])
        before.add(line)
    return np.array(rows, np.float64).reshape(-1, N_FEATURES)


class LineCrf:
    """``emit``: weight of each feature for content (boilerplate has none). ``move``: weights of label after label. ``cut``: least content share kept."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, cut: float = 0.5):
        self.emit, self.move, self.cut = emit, move, cut

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The Viterbi path; on ties the label before is boilerplate's only if strictly better."""
        content = features @ self.emit
        (bb, bc), (cb, cc) = self.move.tolist()
        b, c = 0.0, 0.0
        back = []
        for i, e in enumerate(content.tolist()):
            if i == 0:
                b, c = 0.0, e
                continue
            to_b, to_c = b + bb > c + cb, b + bc > c + cc
            back.append((to_b, to_c))
            b, c = (b + bb if to_b else c + cb), (b + bc if to_c else c + cc) + e
        label = CONTENT if c >= b else BOILERPLATE
        path = [label]
        for to_b, to_c in reversed(back):
            label = BOILERPLATE if (to_c if label else to_b) else CONTENT
            path.append(label)
        return np.array(path[::-1] if len(features) else [], np.int8)

    def judge(self, text: str | None) -> tuple[float, int, int]:
        """Share of characters in content lines, content lines, lines. A text without a word has no line and share 0."""
        features = line_features(text or "")
        path = self.decode(features)
        size = np.array([len(x) for x in (text or "").split("\n") if x.split()], np.float64)
        return (float(size[path == CONTENT].sum() / size.sum()) if len(size) else 0.0), int((path == CONTENT).sum()), len(path)


def fit_crf(docs: list[np.ndarray], labels: list[int] | list[np.ndarray], rounds: int = 200, rate: float = 0.1, decay: float = 1e-3) -> LineCrf:
    """Maximum likelihood by gradient ascent (Adam), of a label for each text or for each of its lines. Forward-backward runs over all texts at once."""
    if not docs:
        return LineCrf(np.eye(1, N_FEATURES, N_FEATURES - 1)[0], np.zeros((2, 2)))
    longest = max(map(len, docs))
    x = np.zeros((len(docs), longest, N_FEATURES))
    live = np.zeros((len(docs), longest), bool)
    for i, d in enumerate(docs):
        x[i, : len(d)], live[i, : len(d)] = d, True
    y = np.zeros(live.shape, np.int64)
    for i, label in enumerate(labels):
        y[i, : len(docs[i])] = label
    theta, m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    pairs = live[:, 1:] & live[:, :-1]
    # texts that are mostly of the one label weigh as much as those of the other
    mostly = (2 * (y * live).sum(1) >= live.sum(1)).astype(int)
    share = np.array([0.5 / max(1, (mostly == k).sum()) for k in (0, 1)])[mostly]
    for step in range(1, rounds + 1):
        emit, move = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        score = np.stack([np.zeros(live.shape), x @ emit], -1)
        fwd, bwd = np.zeros(score.shape), np.zeros(score.shape)
        fwd[:, 0] = score[:, 0]
        for t in range(1, longest):
            fwd[:, t] = np.where(live[:, t, None], np.logaddexp(fwd[:, t - 1, 0, None] + move[0], fwd[:, t - 1, 1, None] + move[1]) + score[:, t], fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            after = score[:, t + 1] + bwd[:, t + 1]
            bwd[:, t] = np.where(live[:, t + 1, None], np.logaddexp(move[:, 0] + after[:, 0, None], move[:, 1] + after[:, 1, None]), 0.0)
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - total[:, None]) * live
        grad = np.zeros_like(theta)
        grad[:N_FEATURES] = np.einsum("nt,ntf->f", (y * live - p) * share[:, None], x)
        for a in (0, 1):
            for b in (0, 1):
                joint = np.exp(fwd[:, :-1, a] + move[a, b] + score[:, 1:, b] + bwd[:, 1:, b] - total[:, None, None].reshape(-1, 1)) * pairs
                grad[N_FEATURES + 2 * a + b] = (((y[:, :-1] == a) & (y[:, 1:] == b) & pairs) * share[:, None] - joint * share[:, None]).sum()
        grad -= decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LineCrf(theta[:N_FEATURES].copy(), theta[N_FEATURES:].reshape(2, 2).copy())


def line_labels(docs: list[np.ndarray], labels: list[int], crf: LineCrf, margin: float = 1.0) -> list[np.ndarray]:
    """A label for each line: its text's, or the other one where the line alone speaks for it by ``margin``. Fewer than half of a text's lines
    get the other one, those that speak for it most."""
    out = []
    for x, label in zip(docs, labels, strict=True):
        y = np.full(len(x), label)
        other = (x @ crf.emit) * (1 if label == BOILERPLATE else -1)
        order = np.argsort(-other, kind="stable")[: (len(x) - 1) // 2]
        y[order[other[order] > margin]] = 1 - label
        out.append(y)
    return out


def joined(docs: list[np.ndarray], labels: list[int], lines: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each boilerplate text with a content text before or after it, in turn: sequences in which the label is known to change."""
    bad, good = ([i for i, y in enumerate(labels) if y == k] for k in (BOILERPLATE, CONTENT))
    pairs = [(a, b) if k % 2 else (b, a) for k, (a, b) in enumerate(zip(bad, good, strict=False))]
    return [np.concatenate([docs[a], docs[b]]) for a, b in pairs], [np.concatenate([lines[a], lines[b]]) for a, b in pairs]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs_per_label: int = 1000, max_lines: int = 64) -> LineCrf:
    """Fit on about ``docs_per_label`` texts of quality 0 and of 1, chosen by a hash of the id. A text of more than ``max_lines`` lines is several sequences.

    Labels of lines are latent: they start as those of their texts, and are estimated again from a first fit on texts (see line_labels). The second
    fit also has texts joined in pairs (see joined), from which it learns how labels change within a text.
    ``labels`` needs ``id_col`` and quality (0 or 1). Without both labels, also on empty tables, all lines are content.
    """
    sample, sizes, _ = labelled_sample(docs, labels, "quality", {0: docs_per_label, 1: docs_per_label}, id_col, text_col)
    if len(sizes) < 2:
        return fit_crf([], [])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(i, k, x[k : k + max_lines].ravel().tolist()) for i, x in enumerate(map(line_features, batch["text"].to_pylist())) for k in range(0, len(x), max_lines)]
            at = pa.array([i for i, *_ in parts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"].take(at), batch["label"].take(at), pa.array([k for _, k, _ in parts], pa.int64()), pa.array([x for *_, x in parts], pa.list_(pa.float64()))], ["id", "label", "first", "x"])

    sample = sample.select(F.col(id_col).cast("string").alias("id"), "label", "text")
    rows = sorted(sample.mapInArrow(features, "id string, label int, first long, x array<double>").collect())
    texts, kinds = [np.array(r["x"]).reshape(-1, N_FEATURES) for r in rows], [r["label"] for r in rows]
    lines = line_labels(texts, kinds, fit_crf(texts, kinds, rounds=80))
    more, more_lines = joined(texts, kinds, lines)
    return fit_crf(texts + more, lines + more_lines)


_FIELDS = {**dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines"), pa.int64()), "content_share": pa.float64(), "base_failed": pa.bool_(), "kept": pa.bool_()}


def judge(docs: DataFrame, crf: LineCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, base counts, lines, content lines, content share, base_failed and kept. A null text has no words and fails; repeated rows stay; an empty table gives no row; texts are read whole. Of equally likely labellings Viterbi takes content."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            got = []
            for text in batch[1].to_pylist():
                g = base_counts(text)
                share, content, lines = crf.judge(text)
                failed = g["n_words"] < 50 or 100 * g["n_repeat_words"] > 50 * g["n_words"]
                got.append(g | {"n_lines": lines, "n_content_lines": content, "content_share": share, "base_failed": failed, "kept": not failed and share >= crf.cut})
            yield pa.RecordBatch.from_arrays([batch[0], *(pa.array([g[k] for g in got], kind) for k, kind in _FIELDS.items())], [id_col, *_FIELDS])

    kind = docs.schema[id_col].dataType.simpleString()
    ddl = ", ".join(f"{k} {'double' if v == pa.float64() else 'boolean' if v == pa.bool_() else 'long'}" for k, v in _FIELDS.items())
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {ddl}")
