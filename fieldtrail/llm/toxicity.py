"""Toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learned from labelled texts: words, and word stems, that stand in toxic texts and hardly
ever in others. A text's words run through the product of the trie and the Levenshtein automata of its
terms, whose states are made on demand and kept, so a word costs one step a character. A match counts
less the more letters differ, and far less inside quotation marks; matches combine as independent evidence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrail.llm.common import labelled_sample

EDGE = "\"'`“”„«»‘’‚‹›.,;:!?()[]{}<>*#$%&|~^=+-_/\\…·•"
OPENING, CLOSING = "\"“„«‘‹", "\"”“»’›"
STEM = range(4, 9)
_INNER = re.compile(f"[{re.escape(EDGE)}]+")


def edits_allowed(length: int, stem: bool) -> int:
    """A stem says less than a whole word, so it must be longer to be matched with edits. What edits of a term stand in clean texts too loses its weight."""
    return 0 if length < (7 if stem else 4) else 1 if length < 9 else 2


class LexiconAutomaton:
    """Deterministic product of a term trie and the terms' Levenshtein automata, built state by state on demand.

    A state is a set of (trie node, edits so far). ``terms``: (term, is_stem, probability that a text with it is toxic).
    """

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.budget = [0]  # most edits that a term below the node allows
        self.ends: list[list[int]] = [[]]
        for t, (term, stem, _) in enumerate(terms):
            node = 0
            allowed = edits_allowed(len(term), stem)
            self.budget[0] = max(self.budget[0], allowed)
            for ch in term:
                node = self.children[node].setdefault(ch, len(self.children))
                if node == len(self.budget):
                    self.children.append({})
                    self.budget.append(0)
                    self.ends.append([])
                self.budget[node] = max(self.budget[node], allowed)
            self.ends[node].append(t)
        self._reset()

    def _reset(self) -> None:
        start = self._close({(0, 0)}, {})
        self.states: dict[tuple, int] = {start: 0}
        self.sets = [start]
        self.steps: list[dict[str, int]] = [{}]

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "children": self.children, "budget": self.budget, "ends": self.ends}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def _close(self, nodes: set[tuple[int, int]], done: dict[int, int]) -> tuple:
        """With the nodes reached by leaving out letters of a term; done: stems matched so far and their edits."""
        todo, least = list(nodes), {}
        while todo:
            node, edits = todo.pop()
            if edits >= least.get(node, 99) or edits > self.budget[node]:
                continue
            least[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]
        done = dict(done)
        for node, edits in least.items():
            for t in self.ends[node]:
                term, stem, _ = self.terms[t]
                if stem and edits <= edits_allowed(len(term), True):
                    done[t] = min(edits, done.get(t, 99))
        return tuple(sorted(least.items())), tuple(sorted(done.items()))

    def _step(self, state: int, ch: str) -> int:
        live, done = self.sets[state]
        nodes: set[tuple[int, int]] = set()
        for node, edits in live:
            nodes.add((node, edits + 1))
            for c, child in self.children[node].items():
                nodes.add((child, edits + (c != ch)))
        key = self._close(nodes, dict(done))
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        to = self.steps[state][ch] = self.states[key]
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """The best term and its edits: fewest edits, then the likelier, then the first term; None without a match."""
        if len(self.sets) > 50_000:
            self._reset()
        state = 0
        for ch in word:
            to = self.steps[state].get(ch)
            state = self._step(state, ch) if to is None else to
            live, done = self.sets[state]
            if not live:
                if not done:
                    return None
                break
        live, done = self.sets[state]
        found = dict(done)
        for node, edits in live:
            for t in self.ends[node]:
                term, stem, _ = self.terms[t]
                if not stem and edits <= edits_allowed(len(term), False):
                    found[t] = min(edits, found.get(t, 99))
        if not found:
            return None
        t, edits = min(found.items(), key=lambda x: (x[1], -self.terms[x[0]][2], x[0]))
        return t, edits


class ToxicityModel:
    """``prior``: the score of a text without a match. ``edit_weight``: evidence kept at each edit; ``quoted_weight``: in quotation.

    ``found``: (term, edits, odd) -> texts of the sample with such a match and no exact one: toxic ones, as many as there would be if
    they had it as often as clean ones, and clean ones; odd: the word holds other characters than letters. Misspellings that clean texts have too lose their weight.
    """

    def __init__(self, terms: list[tuple[str, bool, float]], prior: float, edit_weight: float = 0.85, quoted_weight: float = 0.25, window: int = 12, found: dict[tuple[int, int, bool], tuple[float, float, float]] | None = None):
        self.automaton = LexiconAutomaton(terms)
        self.prior, self.edit_weight, self.quoted_weight, self.window = prior, edit_weight, quoted_weight, window
        self.weights: dict[tuple[int, int, bool], float] = {}
        for t, (_, _, likely) in enumerate(terms):
            for edits in range(3):
                for odd in (False, True):
                    toxic, expected, clean = (found or {}).get((t, edits, odd), (0.0, 0.0, 0.0))
                    more = max(0.0, toxic - expected)
                    self.weights[t, edits, odd] = likely if edits == 0 else (more + likely * edit_weight**edits) / (more + clean + 1.0)
        self._seen: dict[str, tuple[int, int, bool] | None] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}}

    def match(self, raw: str) -> tuple[int, int, bool] | None:
        """Term, edits, and whether the word holds other characters than letters."""
        try:
            return self._seen[raw]
        except KeyError:
            if len(self._seen) > 400_000:
                self._seen.clear()
            # the word; if it is none, those that marks inside it part
            for word in filter(None, dict.fromkeys([raw.strip(EDGE), *_INNER.split(raw)])):
                if found := self.automaton.match(word):
                    found = (*found, found[1] > 0 and not word.isalpha())
                    break
            else:
                found = None
            if len(raw) <= 100:
                self._seen[raw] = found
            return found

    def _quoted(self, words: list[str], at: int) -> bool:
        """An opening mark at a word up to ``window`` words before, none closed since, and a closing one as near after."""
        here = words[at]
        if here[0] not in OPENING:
            for k in range(at - 1, max(-1, at - 1 - self.window), -1):
                if words[k][-1] in CLOSING or words[k].rstrip(".,;:!?")[-1:] in (*CLOSING,):
                    return False
                if words[k][0] in OPENING:
                    break
            else:
                return False
        return any(words[k].rstrip(".,;:!?")[-1:] in (*CLOSING,) for k in range(at, min(len(words), at + self.window + 1)))

    def score(self, text: str | None) -> tuple[float, int]:
        """The score, and the number of matches."""
        words = (text or "").lower().split()
        hits, best = 0, {}
        seen, match = self._seen.get, self.match
        for i, raw in enumerate(words):
            found = seen(raw, 0)
            if found == 0:
                found = match(raw)
            if found is not None:
                hits += 1
                best[found] = max(best.get(found, 0.0), self.quoted_weight if self._quoted(words, i) else 1.0)
        clean = 1.0 - self.prior
        for found, weight in sorted(best.items()):
            clean *= 1.0 - self.weights[found] * weight
        return 1.0 - clean, hits


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text and term (word or stem): the label and a hash of the first neighbours it stands between."""
    for batch in batches:
        terms, stems, labels, contexts = [], [], [], []
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
            words = [w for raw in text.lower().split() if (w := raw.strip(EDGE))]
            mine: dict[tuple[str, bool], int] = {}
            for i, w in enumerate(words):
                if len(w) < 2 or not w.isalpha():
                    continue
                near = xxhash.xxh3_64_intdigest(f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}") >> 1
                mine.setdefault((w, False), near)
                for n in STEM:
                    if n < len(w):
                        mine.setdefault((w[:n], True), near)
            terms += [t for t, _ in mine]
            stems += [s for _, s in mine]
            labels += [label] * len(mine)
            contexts += mine.values()
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(stems, pa.bool_()), pa.array(labels, pa.int32()), pa.array(contexts, pa.int64())], ["term", "stem", "label", "context"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = 1000, max_clean: int = 3000, level: float = 1e-3) -> ToxicityModel:
    """Learn the lexicon from about ``max_toxic`` and ``max_clean`` whole labelled texts, chosen by a hash of the id.

    ``labels`` needs ``id_col`` and toxic (0 or 1). A term's support is the number of
    different neighbourhoods in which toxic texts have it, so that a copied text counts once; equal texts count once, as toxic if one of
    them is. A term must be too frequent there to be chance (``level``), and hardly occur in clean texts. The lexicon is bounded by the sample alone.
    Without toxic texts, also on empty tables, it is empty.
    """
    sample, sizes, shares = labelled_sample(docs, labels, "toxic", {1: max_toxic, 0: max_clean}, id_col, text_col)
    if not sizes.get(1):
        return ToxicityModel([], 0.01)
    sample = sample.groupBy("text").agg(F.max("label").alias("label"))
    rows = sample.mapInArrow(_term_rows, "term string, stem boolean, label int, context long")
    counted = rows.groupBy("term", "stem", "label", "context").agg(F.count("*").alias("n"))
    counted = counted.groupBy("term", "stem").agg(F.sum((F.col("label") == 1).cast("long")).alias("toxic"), F.sum((F.col("label") == 0).cast("long")).alias("clean"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean_texts"))
    toxic, clean = (max(1.0, sizes.get(k, 0) * shares[k]) for k in (1, 0))
    chance = math.log(level) / math.log(toxic / (toxic + clean))  # so much support of one kind alone is no chance
    good = counted.where((F.col("toxic") >= max(3.0, chance)) & (F.col("clean_texts") * toxic <= 0.02 * F.col("toxic") * clean))
    found = {(r["term"], r["stem"]): (r["toxic"], r["clean_texts"]) for r in good.orderBy(F.desc("toxic"), F.length("term"), "term", "stem").collect()}

    def longest(term: str) -> tuple[str, bool]:
        """The longest form of a stem that has nearly all of its support: it says more, and bears edits."""
        forms = [k for k, (n, _) in found.items() if k[0].startswith(term) and n >= 0.93 * found[term, True][0]]
        return max(forms, key=lambda k: (len(k[0]), not k[1], k[0]))

    kept: dict[tuple[str, bool], float] = {}
    starts: set[str] = set()
    for term, stem in found:
        # what is a form of a kept stem, or the start of a kept term, adds nothing
        if not any((term[:n], True) in kept for n in STEM if n <= len(term)) and not (stem and term in starts):
            key = longest(term) if stem else (term, False)
            n, n_clean = found[key]
            kept[key] = (n + 0.5) / (n + n_clean * toxic / clean + 1.0)
            starts.update(key[0][:n] for n in range(1, len(key[0]) + 1))
    terms = [(t, s, p) for (t, s), p in kept.items()]
    shared = docs.sparkSession.sparkContext.broadcast(ToxicityModel(terms, 0.01))

    def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                matches = {shared.value.match(w) for w in text.lower().split()} - {None}
                if all(edits for _, edits, _ in matches):
                    rows += [(*m, label) for m in sorted(matches)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.bool_(), pa.int32()))], ["t", "edits", "odd", "label"])

    found_in = sample.mapInArrow(misspelled, "t int, edits int, odd boolean, label int").groupBy("t", "edits", "odd").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    return ToxicityModel(terms, 0.01, found={(r["t"], r["edits"], r["odd"]): (r["toxic"], r["clean"] * toxic / clean, r["clean"]) for r in found_in.collect()})


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with toxicity (0 to 1) and n_toxic_matches; a null or empty text has the prior. Such columns of ``docs`` are replaced.

    Texts are read whole, words of any length too; repeated rows stay, and an empty table gives no row. Of equally near terms the likelier counts, then the first."""
    docs = docs.drop("toxicity", "n_toxic_matches")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.score(x) for x in batch[text_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64())], [*batch.schema.names, "toxicity", "n_toxic_matches"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{ddl}, toxicity double, n_toxic_matches long")
