"""Whitening, conversation repair and line dedup against brute force and SQL, with their edge cases."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

from fieldtrail.llm import dialogue, linededup, queries, whitening

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_line_dedup"])
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.fetchall())


# operator 11


def plain_whitening(vectors):
    x = np.floor(256 * np.asarray(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ vecs[:, ::-1], values[::-1]


def test_whitening_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, deviation, projected, values = plain_whitening([r["embedding"] for r in rows])
    got = {(r["vec_id"], r["component"]): r for r in queries.queries()["op11_whitening"](spark, SF).collect()}
    assert len(got) == 4 * len(rows) and {r["n"] for r in got.values()} == {n}
    assert all(got[r["vec_id"], 1]["deviation"] == d for r, d in zip(rows, deviation, strict=True))
    for k in range(4):
        mine = np.array([got[r["vec_id"], k + 1]["whitened"] for r in rows])
        want = projected[:, k] / values[k] ** 0.5
        assert min(abs(mine - want).max(), abs(mine + want).max()) < 1e-8
        assert abs(got[0, k + 1]["explained"] - values[k] / values.sum()) < 1e-9
    assert max(r["identity_error"] for r in got.values()) < 1e-9


def test_whitening_of_odd_rows(spark):
    rnd = random.Random(1)
    good = [[rnd.gauss(0, 1) for _ in range(3)] for _ in range(40)]
    odd = [None, [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], []]
    rows = [(i, v, "kept") for i, v in enumerate([*good, *odd])] + [(0, good[0], "again"), (None, good[1], "null id"), (7, good[2], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").withColumn("x", whitening.F.lit(5))
    got = whitening.whiten(frame)
    assert got.columns == ["vec_id", "embedding", "x", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    assert len(got) == 43 * 3 and {r["n"] for r in got} == {40}
    n, deviation, projected, values = plain_whitening(good)
    assert sorted(int(r["deviation"]) for r in got if r["component"] == 1 and r["vec_id"] == 0) == [deviation[0]] * 2
    assert sum(r["explained"] for r in got if r["vec_id"] == 1) == pytest.approx(1)
    # several aggregations give what one gives
    x = whitening.quantised(frame.drop("x"))
    one, several = whitening.fit(x), whitening.fit(x, pairs_at_once=2)
    assert np.allclose(one.values, several.values) and one.sums == several.sums


def test_deviations_beyond_a_long(spark):
    vectors = [[4.0e12 + i, float(i * i)] for i in range(7)] + [[-4.0e12, 0.5]]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).where("component = 1")
    x = [[int(np.floor(256 * c)) for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {r["vec_id"]: int(r["deviation"]) for r in got.collect()} == {i: sum((8 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [0.5, -0.5])] * 3, schema)).collect()
    assert len(got) == 6 and {(r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, None, 0.0, 0.0)}
    flat = whitening.whiten(spark.createDataFrame([(i, [i / 8, 1.0]) for i in range(9)], schema)).collect()
    assert {r["whitened"] is None for r in flat if r["component"] == 2} == {True} and {r["whitened"] is None for r in flat if r["component"] == 1} == {False}


# operator 12


def plain_repair(rows):
    """Costs and audits of all role patterns by a search over (row, roles so far) that keeps the least (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {("", ()): (0, "")}  # state: the last initial, and whether something came out
    best = {"": (0, "", ())}

    def legal(before, now):
        return before + now in ("su", "ua", "au") or (before == "" and now in ("s", "u"))

    def put(into, state, cost, audit, out):
        if state not in into or (cost, audit) < into[state][:2]:
            into[state] = (cost, audit, out)

    def inserted(states):
        for _ in range(3):
            new = dict(states)
            for before, (cost, audit, out) in states.items():
                for role in ("user", "assistant"):
                    if legal(before, role[0]):
                        put(new, role[0], cost + 3, audit + "I", (*out, f"{role}:"))
            states = new
        return states

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for before, (cost, audit, out) in inserted(best).items():
            put(new, before, cost + 4, audit + "D", out)
            if fault in ("", "truncated"):
                extra = 3 * (fault == "truncated")
                if legal(before, role[:1]) and role:
                    put(new, role[:1], cost + extra, audit + "K", (*out, f"{role}:{text}"))
                for other in ("user", "assistant"):
                    if legal(before, other[0]):
                        put(new, other[0], cost + 3 + extra, audit + "R", (*out, f"{other}:{text}"))
        best = new
    cost, audit, out = min(v for k, v in inserted(best).items() if k in ("", "a"))
    turns = {r[0] for r in rows if r[0] is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def repaired(spark, rows, **conf):
    frame = spark.createDataFrame(rows, "conv long, turn long, role string, text string, gone boolean")
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return {r[0]: tuple(r[1:]) for r in dialogue.repair(frame).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def talk(rnd, conv, n):
    texts = ["Yes.", "no", " ", "", "Why?", "é.", "a\nb!", "and so", "x. ", "\t"]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", "usher", "sys"]
    return [(conv, rnd.choice([None, *range(n), *range(n)]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"text {rnd.randrange(99)}.", False) for _ in range(n)]


def test_repair_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [r for c in range(150) for r in talk(rnd, c if c else None, rnd.randrange(1, 9))]
    rows += [r for r in rows if r[0] == 3] * 2 + [(999, 1, "user", "Gone.", True), (3, 50, "user", "Gone.", True)]
    got = repaired(spark, rows)
    want = {}
    for conv in {r[0] for r in rows}:
        mine = [r[1:4] for r in rows if r[0] == conv and not r[4]]
        want[conv] = plain_repair(mine) if mine else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == want
    assert got[999] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_of_conversations_across_tasks(spark):
    """One conversation has most of the rows and goes across many tasks, another is in one task's middle."""
    rnd = random.Random(6)
    rows = [(1, t, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(["Yes.", "no", f"t{t}.", f"u{t}", f"v{t}?"]), False) for t in range(900)]
    rows += [(None, t // 2, rnd.choice(["user", "assistant"]), f"n{t}.", False) for t in range(400)] + talk(rnd, 0, 30) + talk(rnd, 2, 3)
    got = repaired(spark, rows, **{"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    assert got == {c: plain_repair([r[1:4] for r in rows if r[0] == c]) for c in (None, 0, 1, 2)}


def test_repair_of_ties_and_equal_rows(spark):
    rows = [(1, 0, "user", "Hi.", False)] * 500 + [(1, 1, "assistant", "Yo.", False)]
    got = repaired(spark, rows)[1]
    assert got == plain_repair([r[1:4] for r in rows]) and got[6] == "K" + "D" * 499 + "K"
    assert repaired(spark, []) == {}


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2) for t in (None, *range(30)) for r, x in [("assistant", "A. b?! c"), (None, None)]]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, gone int, code string")
    want = []
    for c, t, r, x in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if code == 1 else x.translate(str.maketrans("", "", ".!?")) if code == 2 else x
        want += [(c, t, "user" if code == 4 else r, x, code == 0)] * (2 if code == 3 else 1)
    assert sorted(map(tuple, dialogue.damaged(frame).collect()), key=repr) == sorted(want, key=repr)


# operator 13


def plain_lines(rows, min_chars=20, min_docs=3):
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holds = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holds.setdefault(line.strip(space).translate(lower), set()).add(-1 if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if not (len(k := x.strip(space).translate(lower)) >= min_chars and len(holds[k]) >= min_docs and max(holds[k]) != (-1 if doc is None else doc))]
        out.append((doc, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def test_lines_against_brute_force(spark):
    rnd = random.Random(3)
    shared = ["The same line of footer text", "  tHE SAME line of footer text\t", "École: ÉTÉ à la plage, très tôt", "École: été à la plage, très tôt", "x" * 20, "X" * 20 + "\r", "y" * 19, "", " ", " nbsp at both ends of it ", "nbsp at both ends of it", "𝒳" * 20, "𝒳" * 19]
    texts = ["\n".join(rnd.choice([*shared, *shared, f"own line {rnd.randrange(10**9)} of this"]) for _ in range(rnd.randrange(1, 12))) for _ in range(120)]
    texts += ["", None, "\n", "\n\n", shared[0], shared[0] + "\n", "\n".join([shared[0]] * 20_000 + [f"line number {i} of a long text" for i in range(20_000)])]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[6]), (119, texts[0]), (10**6, "last")]
    frame = spark.createDataFrame([(*r, 1, "a", 2) for r in rows], "doc_id long, text string, n_lines int, pos string, doc int").repartition(5)
    got = linededup.drop_common_lines(frame)
    assert got.columns == ["doc_id", "text", "pos", "doc", "n_lines", "n_dropped", "kept_text"]
    assert sorted((tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_text")) for r in got.collect()), key=repr) == plain_lines(rows)


def test_lines_stay_below_the_thresholds(spark):
    line = "a line of more than twenty letters"
    docs = spark.createDataFrame([(1, line), (2, f"{line}\n{line}"), (2, line), (3, "short"), (4, "short"), (5, "short")], "doc_id long, text string")
    assert {r["n_dropped"] for r in linededup.drop_common_lines(docs).collect()} == {0}
    third = docs.union(spark.createDataFrame([(9, line)], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_dropped"]) for r in linededup.drop_common_lines(third).collect()) == [(1, 1), (2, 1), (2, 2), (3, 0), (4, 0), (5, 0), (9, 0)]
    assert linededup.drop_common_lines(docs.limit(0)).collect() == []


def test_line_dedup_stays_native(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = linededup.drop_common_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
