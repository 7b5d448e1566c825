"""Operator 12: least-cost repair of conversations, by a DAG of edits cut to its tight arcs.

A conversation's rows, in order, are layers of a DAG over four states (nothing yet, after a system, a user, an assistant row). Minimum costs
from the front and from the back tell which arcs lie on some cheapest path; a set of states walks these arcs and takes the least letter that
leaves any of them. Equal rows are counted first and are one layer.

Layers are laid out by range, so a conversation of any size is spread over tasks. One that lies within a task is decided there. One that goes
across tasks is decided in blocks: each block's costs between all states are a 4 x 4 matrix, matrices give every block's costs from front and
back, and what a block makes of each set of states gives the set that enters the next. No more than a few numbers of a block meet in one
place. Texts stay out of all this. They are read once at the end, in order, and flow through a hash: SHA-256 takes one conversation's
texts one after another by definition, so that part is a stream in one task, of which nothing is held but the hash and the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrail.llm.common import WORD_SPACE, stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ENDS = (START, ASSISTANT)
FAR = 1 << 60


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone) after the fixed damage by crc32(`conv:turn`) % 20. Rows that it drops stay, marked ``gone``, so that their conversation is known.

    A null id or turn is one space in the key, a null role or text is one space.
    """
    space = F.lit(" ")
    code = F.crc32(F.concat_ws(":", F.coalesce(F.col(conv_col).cast("string"), space), F.coalesce(F.col(turn_col).cast("string"), space)).cast("binary")) % 20
    base = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, space).alias("role"), F.coalesce(text_col, space).alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("code") == 3, 2).otherwise(1)
    return base.select("conv", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(1), copies)).alias("one")).drop("one")


def layers(rows: DataFrame) -> DataFrame:
    """Equal rows as one: (conv, turn, role, digest, n, initial, fault). ``fault`` is that of the first of the n: blank, duplicate, truncated or empty.

    An earlier row with the role and text is known by the least turn of (conv, role, digest), which meets the rows in a join that can be split.
    """
    bare = F.rtrim("text", F.lit(WORD_SPACE))
    said = rows.where(~F.col("gone")).select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    counted = stage(said.groupBy("conv", "turn", "role", "digest").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")))
    least = counted.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("turn").alias("least"), F.bool_or(F.col("turn").isNull()).alias("without"))
    met = counted.join(least, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    earlier = F.when(F.col("without"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least"))
    fault = F.when(F.col("blank"), "blank").when(earlier, "duplicate").when(F.col("cut"), "truncated").otherwise("")
    return met.select("conv", "turn", "role", "digest", "n", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


# One layer is (initial, fault, n). Costs are lists over the four states.


def arcs(layer: tuple, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, next state, cost) of the edits that use up the layer's first row."""
    initial, fault, _ = layer
    yield "D", state, DELETE
    if fault in ("", "truncated"):
        extra = TRUNCATED if fault else 0
        if initial in AFTER[state]:
            yield "K", AFTER[state][initial], KEEP + extra
        for role in "ua":
            if role in AFTER[state]:
                yield "R", AFTER[state][role], REROLE + extra


def inserts(state: int) -> Iterator[int]:
    return (AFTER[state][role] for role in "ua" if role in AFTER[state])


def closed(costs: list[int], forward: bool = True) -> list[int]:
    """Costs when rows may be inserted as well; no more than two in a row can pay."""
    for _ in range(2):
        new = list(costs)
        for state in range(4):
            for then in inserts(state):
                a, b = (state, then) if forward else (then, state)
                new[b] = min(new[b], costs[a] + INSERT)
        costs = new
    return costs


def ahead(layer: tuple, costs: list[int]) -> list[int]:
    """Costs from the front after the layer, from those before it. Its other copies are deleted."""
    new = [FAR] * 4
    for state in range(4):
        for _, then, cost in arcs(layer, state):
            new[then] = min(new[then], costs[state] + cost + DELETE * (layer[2] - 1))
    return closed(new)


def back(layer: tuple, costs: list[int]) -> list[int]:
    """Costs to the end before the layer, from those after it."""
    return closed([min(cost + costs[then] for _, then, cost in arcs(layer, state)) + DELETE * (layer[2] - 1) for state in range(4)], forward=False)


FIRST = closed([0, FAR, FAR, FAR])
LAST = closed([0 if s in ENDS else FAR for s in range(4)], forward=False)


def walk(segment: list[tuple], states: frozenset[int], enter: list[int], leave: list[int], final: bool) -> tuple[list[str], frozenset[int]]:
    """Each layer's edits along tight arcs from the set ``states``, and the set that comes out.

    ``enter``: costs from the front before the segment; ``leave``: costs to the end after it. The last segment's last edits take in the rows
    inserted at the end. Of the arcs that leave any state of the set the least letter is taken: D before I before K before R.
    """
    fronts, backs = [enter], [leave]
    for layer in segment:
        fronts.append(ahead(layer, fronts[-1]))
    for layer in reversed(segment):
        backs.append(back(layer, backs[-1]))
    backs.reverse()
    best = min(f + b for f, b in zip(enter, backs[0], strict=True))
    edits = [""] * len(segment)
    at = 0
    while at < len(segment) or final:
        layer = segment[at] if at < len(segment) else None
        here = fronts[at]
        if layer is None and any(s in ENDS and here[s] == best for s in states):
            break
        options: dict[str, set[int]] = {}
        for state in states:
            if layer is not None:
                for letter, then, cost in arcs(layer, state):
                    if here[state] + cost + DELETE * (layer[2] - 1) + backs[at + 1][then] == best:
                        options.setdefault(letter, set()).add(then)
            for then in inserts(state):
                if here[state] + INSERT + backs[at][then] == best:
                    options.setdefault("I", set()).add(then)
        letter = min(options)
        states = frozenset(options[letter])
        if letter != "I":
            edits[at] += letter + "D" * (layer[2] - 1)
            at += 1
        elif layer is None:
            edits[-1] += letter
        else:
            edits[at] += letter
    return edits, states


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``edits`` to sorted rows; null for what may go on in the task before or after, which is passed on as it comes where nothing else can be in front of it."""
    names, schema, held, first = [], None, [], True

    def batch(rows: list[tuple], edits: list) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(edits, pa.string())], [*names, "edits"])

    for incoming in batches:
        if not incoming.num_rows:
            continue
        names, schema = incoming.schema.names, incoming.schema
        conv, layer_at = names.index("conv"), [names.index(c) for c in ("initial", "fault", "n")]
        out, edits = [], []
        for row in zip(*(c.to_pylist() for c in incoming.columns), strict=True):
            if held and held[-1][conv] != row[conv]:
                if first:
                    edits += [None] * len(held)
                else:
                    edits += walk([tuple(r[k] for k in layer_at) for r in held], frozenset([START]), FIRST, LAST, True)[0]
                out += held
                held, first = [], False
            held.append(row)
        if first and len(held) > 1:
            out, edits = out + held[:-1], edits + [None] * (len(held) - 1)
            held = held[-1:]
        if out:
            yield batch(out, edits)
    if held:
        yield batch(held, [None] * len(held))


def _segment(table: pa.Table) -> list[tuple]:
    table = table.sort_by("at")
    return list(zip(*(table.column(n).to_pylist() for n in ("initial", "fault", "n")), strict=True))


def _across(parts: DataFrame, kind: str) -> DataFrame:
    """(at, edits) of the rows of ``parts``, whose conversations may lie in several blocks. ``kind``: the type of the conversations' ids."""
    conv_block = f"conv {kind}, block int"

    def costs_between(table: pa.Table) -> pa.Table:
        matrix = []
        for state in range(4):
            costs = closed([0 if s == state else FAR for s in range(4)])
            for layer in _segment(table):
                costs = ahead(layer, costs)
            matrix += [min(c, FAR) for c in costs]
        return pa.table({"conv": table.column("conv")[:1], "block": table.column("block")[:1], "costs": pa.array([matrix], pa.list_(pa.int64()))})

    def from_both_ends(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        steps = table.column("costs").to_pylist()
        enter, leave = [FIRST], [LAST]
        for m in steps:
            enter.append([min(FAR, *(enter[-1][s] + m[4 * s + t] for s in range(4))) for t in range(4)])
        for m in reversed(steps):
            leave.append([min(FAR, *(leave[-1][t] + m[4 * s + t] for t in range(4))) for s in range(4)])
        leave.reverse()
        longs = pa.list_(pa.int64())
        final = [i == len(steps) - 1 for i in range(len(steps))]
        return pa.table({"conv": table.column("conv"), "block": table.column("block"), "enter": pa.array(enter[:-1], longs), "leave": pa.array(leave[1:], longs), "final": pa.array(final)})

    def sets_out(rows: pa.Table, costs: pa.Table) -> pa.Table:
        (cost,) = costs.to_pylist()
        segment, out = _segment(rows), [0] * 16
        ends = cost["leave"]
        for layer in reversed(segment):
            ends = back(layer, ends)
        best = min(f + b for f, b in zip(cost["enter"], ends, strict=True))
        tight = sum(1 << s for s in range(4) if cost["enter"][s] + ends[s] == best)
        for mask in range(1, 16):
            if mask & tight == mask and not cost["final"]:
                states = walk(segment, frozenset(s for s in range(4) if mask >> s & 1), cost["enter"], cost["leave"], False)[1]
                out[mask] = sum(1 << s for s in states)
        return costs.append_column("out", pa.array([out], pa.list_(pa.int64())))

    def sets_in(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        states = [1 << START]
        for out in table.column("out").to_pylist()[:-1]:
            states.append(out[states[-1]])
        return table.drop_columns(["out"]).append_column("states", pa.array(states, pa.int64()))

    def edits_of(rows: pa.Table, costs: pa.Table) -> pa.Table:
        (cost,) = costs.to_pylist()
        rows = rows.sort_by("at")
        edits, _ = walk(_segment(rows), frozenset(s for s in range(4) if cost["states"] >> s & 1), cost["enter"], cost["leave"], cost["final"])
        return pa.table({"conv": rows.column("conv"), "turn": rows.column("turn"), "role": rows.column("role"), "digest": rows.column("digest"), "edits": pa.array(edits, pa.string()), "fault": rows.column("fault"), "n": rows.column("n")})

    limits = f"{conv_block}, enter array<bigint>, leave array<bigint>, final boolean"
    blocks = parts.groupBy("conv", "block")
    costs = stage(blocks.applyInArrow(costs_between, f"{conv_block}, costs array<bigint>").groupBy("conv").applyInArrow(from_both_ends, limits))
    sets = blocks.cogroup(costs.groupBy("conv", "block")).applyInArrow(sets_out, f"{limits}, out array<bigint>")
    states = stage(sets.groupBy("conv").applyInArrow(sets_in, f"{limits}, states bigint"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select("conv", "turn", "role", "digest").schema)
    return blocks.cogroup(states.groupBy("conv", "block")).applyInArrow(edits_of, f"{schema}, edits string, fault string, n bigint")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of rows sorted by it: counts, cost, audit and hash, from each layer's edits followed by its text."""
    names = ["conv", "turn", "role", "digest", "kind", "fault", "n", "edits", "text"]
    done, conv, kind_of = [], None, None
    state: _Telling | None = None
    for incoming in batches:
        kind_of = incoming.schema.field("conv").type
        for row in _rows([incoming], names):
            if state is None or conv != row[0]:
                if state is not None:
                    done.append((conv, *state.end()))
                state, conv = _Telling(), row[0]
            state.take(row)
        if done:
            yield _told_batch(done, kind_of)
            done = []
    if state is not None:
        yield _told_batch([(conv, *state.end())], kind_of)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _told_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])], ["conv", *COUNTS, "audit", "repaired_sha256"])


class _Telling:
    """What is known of one conversation while its rows pass: numbers, the audit, the hash of what was repaired so far.

    Repaired roles follow from the number of rows that stay: (user, assistant) over and over, with a kept system row first where it is odd.
    Only a kept system row can be first, so roles are known as rows pass.
    """

    def __init__(self) -> None:
        self.counts = dict.fromkeys(COUNTS, 0)
        self.turns = 0
        self.least = self.most = self.before = self.edits = self.key = None
        self.audit: list[str] = []
        self.hash = hashlib.sha256()
        self.written = 0
        self.role = "user"
        self.last_initial: str | None = None

    def write(self, role: str, text: str) -> None:
        self.hash.update(("\n" * (self.written > 0) + role + ":" + text).encode())
        self.written += 1
        self.role = "assistant" if role[:1] == "u" else "user"

    def take(self, row: tuple) -> None:
        _, turn, role, digest, kind, fault, n, edits, text = row
        if kind == 2:
            return
        if kind == 1:  # a text: of each layer one is written, where the edits keep it
            if self.edits is not None and self.key == (turn, role, digest):
                self.play(self.edits, role, text)
                self.edits = None
            return
        c = self.counts
        if turn is not None:
            self.turns += self.most is None or turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        c["blank"] += n if fault == "blank" else 0
        c["duplicate"] += n if fault == "duplicate" else n - 1 if fault != "blank" else 0
        c["truncated"] += fault == "truncated"
        initial = role[:1]
        if self.last_initial is not None:
            c["illegal"] += self.last_initial + initial not in ("su", "ua", "au")
        c["illegal"] += n - 1
        self.last_initial = initial
        c["cost"] += sum(DELETE if x == "D" else INSERT if x == "I" else (REROLE if x == "R" else KEEP) + (TRUNCATED if fault == "truncated" else 0) for x in edits)
        self.audit.append(edits)
        self.edits, self.key = edits, (turn, role, digest)

    def play(self, edits: str, role: str, text: str) -> None:
        for letter in edits:
            if letter == "K":
                self.write(role, text)
            elif letter == "R":
                self.write(self.role, text)
            elif letter == "I":
                self.write(self.role, "")

    def end(self) -> tuple:
        c = self.counts
        c["gaps"] = self.most - self.least + 1 - self.turns if self.turns else 0
        return *c.values(), "".join(self.audit), self.hash.hexdigest()


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (conv, turn, role, text, gone): ``conv``, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Order is by turn (nulls first), then role, then the text's SHA-256; equal rows are copies of each other, and all but the first are
    duplicates (or blank). Two texts are equal where their SHA-256 is. A null ``conv`` is one conversation. A role that begins with
    none of s, u, a, an empty one too, can't be kept, and its neighbours are illegal. Conversations of which all rows are ``gone`` have zeros, an empty audit
    and the hash of nothing. Empty tables give no rows. A conversation's audit is one value, so its letters end up in one row, as its texts pass through one hash.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    spread = layers(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    spread = spread.withColumns({"at": F.monotonically_increasing_id(), "block": F.spark_partition_id()})
    known = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spread.schema)
    decided = stage(spread.mapInArrow(_decide, f"{known}, edits string"))
    keys = ["conv", "turn", "role", "digest"]
    whole = decided.where("edits IS NOT NULL").select(*keys, "edits", "fault", "n")
    parts = decided.where("edits IS NULL").drop("edits")
    across = _across(parts, dict(rows.dtypes)["conv"])
    told = whole.unionByName(across).select(*keys, F.lit(0).alias("kind"), "fault", "n", "edits", F.lit(None).cast("string").alias("text"))
    digest = F.when(~F.col("gone"), F.unhex(F.sha2("text", 256)))
    texts = rows.select("conv", "turn", "role", digest.alias("digest"), F.when(F.col("gone"), 2).otherwise(1).alias("kind"), F.lit(None).cast("string").alias("fault"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("edits"), F.when(~F.col("gone"), F.col("text")).alias("text"))
    stream = told.unionByName(texts).repartition("conv").sortWithinPartitions(*order, "kind")
    kind = dict(rows.dtypes)["conv"]
    return stream.mapInArrow(_told, f"conv {kind}, {', '.join(c + ' bigint' for c in COUNTS)}, audit string, repaired_sha256 string")
