"""Substring dedup, packing, near duplicates and decontamination against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from fieldtrail.llm import decontaminate, neardup, packing, substring
from fieldtrail.llm.components import components
from fieldtrail.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, maybe string, cuts string, key int"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", 1) for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)


def plain_spans(docs, window):
    """doc -> (words, removed): windows are judged on the input."""
    words = {i: (t or "").encode().split() for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()
    return out


def copied_texts(seed, n, length, alphabet):
    rnd = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [rnd.choice(alphabet) for _ in range(rnd.randrange(length))]
        for _ in range(rnd.randrange(3)):
            if texts and (source := (rnd.choice(texts) or "").split()):
                a = rnd.randrange(len(source))
                at = rnd.randrange(len(words) + 1)
                words[at:at] = source[a : a + rnd.randrange(1, 90)]
        texts.append(rnd.choice([" ", "\n"]).join(words))
    return texts + [None, "", "  ", texts[0], texts[3], "a " * 120, "a " * 70]


@pytest.mark.parametrize("seed, alphabet", [(1, [f"w{i}" for i in range(400)]), (2, ["a", "b", "c"])])
def test_substring_dedup(spark, seed, alphabet):
    texts = copied_texts(seed, 40, 150, alphabet)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.duplicate_spans(frame(spark, texts)).collect()}
    assert got == plain_spans(list(enumerate(texts)), 50)


def test_substring_edge_rows(spark):
    long = " ".join(f"x{i}" for i in range(60))
    docs = frame(spark, [long, long, long, None], ids=[5, 5, None, 6])
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring.duplicate_spans(docs).collect())
    assert got == [(0, 0), (5, 0), (5, 0), (6, 0)]
    assert substring.duplicate_spans(docs.limit(0)).count() == 0


def test_remove_duplicates_cuts_text(spark):
    long, tail = " ".join(f"x{i}" for i in range(60)), "an  end\nhere"
    docs = frame(spark, [long, f"start {long} {tail}", long, None, "short"])
    got = {r["doc_id"]: r.asDict() for r in substring.remove_duplicates(docs).collect()}
    assert set(got) == {0, 1, 3, 4} and got[1]["text"] == f"start {tail}" and got[1]["n_chars"] == len(f"start {tail}") and got[0]["text"] == long and got[1]["cuts"] == "z"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_length_once(counts):
    plan = packing.Plan(counts, 64)
    fill = {}
    for length, n in counts.items():
        bins, offsets = plan.place(np.full(n, length, np.int64), np.arange(n))
        for b, o in zip(bins.tolist(), offsets.tolist(), strict=True):
            fill.setdefault(b, []).append((o, length))
    assert sum(map(len, fill.values())) == sum(counts.values()) and len(fill) == plan.bins
    for parts in fill.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= 64


def test_two_smaller_ones_replace_the_smallest():
    assert packing.Plan({6: 1, 3: 1, 2: 2}, 10).bins == 2
    plan = packing.Plan({6: 1, 3: 1, 2: 2}, 10)
    first = [length for length, n in ((6, 1), (3, 1), (2, 2)) for b in plan.place(np.full(n, length, np.int64), np.arange(n))[0].tolist() if b == 0]
    assert sorted(first) == [2, 2, 6]


def test_pack(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    rnd = random.Random(3)
    odd = ["<|endoftext|> a<|ENDOFTEXT|>b", "İstanbul ΣΑΣ ﬁ ²³ Ⅷ x　y\xa0z\x1cq", "it's They'RE a_b__ 12ab34 “q”—d 😀", "日本語 テキスト", None, ""]
    texts = odd + [" ".join(rnd.choice(["the", "stone's", "ÉTÉ,", "x1!"]) for _ in range(rnd.randrange(60))) for _ in range(30)]
    capacity = 64
    rows = packing.pack(frame(spark, [*texts, texts[8]], ids=[*range(len(texts)), 8]), path, capacity).collect()
    want = []
    for i, t in [*enumerate(texts), (8, texts[8])]:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(np.array(ids[k : k + capacity], np.uint32).tobytes())) for k in range(0, len(ids), capacity)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= capacity
    assert packing.pack(frame(spark, texts).limit(0), path).count() == 0


def plain_jaccard(x, y):
    a, b = dict(zip(*map(list, x), strict=True)), dict(zip(*map(list, y), strict=True))
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def test_probability_jaccard_and_its_estimate():
    rnd = random.Random(4)
    for n in (6, 40, 200):
        a = [f"w{rnd.randrange(30)}" for _ in range(n)]
        b = list(a)
        b[n // 2] = "new"
        x, y = neardup.shingles(" ".join(a)), neardup.shingles(" ".join(b))
        exact = neardup.probability_jaccard(x, y)
        assert exact == pytest.approx(plain_jaccard(x, y))
        same = (neardup.signature(*x, 2000) == neardup.signature(*y, 2000)).mean()
        assert abs(same - exact) < 5 * (exact * (1 - exact) / 2000) ** 0.5 + 1e-3


def plain_classes(texts, threshold=0.8):
    sh = {i: neardup.shingles(t) for i, t in texts}
    label = {i: i for i, _ in texts}
    find = lambda i: i if label[i] == i else find(label[i])
    for i in sh:
        for j in sh:
            if i < j and len(sh[i][0]) and neardup.probability_jaccard(sh[i], sh[j]) >= threshold:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i, _ in texts}


def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(40, 160))] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for _ in range(60):  # one group is much larger, and its copies are changed more and less
        words = list(base[0] if rnd.random() < 0.5 else rnd.choice(base))
        for _ in range(rnd.randrange(5)):
            words[rnd.randrange(len(words))] = f"n{rnd.randrange(9999)}"
        texts.append(" ".join(words))
    texts += [texts[3], texts[3] + "\n", None, "", "one two", "one two", "x"]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    assert got == plain_classes(list(enumerate(texts)))
    kept = neardup.deduplicate(frame(spark, [*texts, texts[1]], ids=[*range(len(texts)), 1]))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values())) and kept.columns == frame(spark, []).columns


def one_cluster(spark, texts, threshold, links=()):
    """The classes that the search across components finds if all texts are in one cluster, and the number of pairs that it compares."""
    frame_ = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    clusters = frame_.select("id", F.lit(0).cast("long").alias("cluster"))
    links = spark.createDataFrame([(a, b, 1.0) for a, b in links], "a long, b long, similarity double")
    places = neardup._meeting_places(frame_, clusters, threshold, 5)
    compared, plain = [], neardup._similar

    def similar(pairs, *rest):
        compared.append(pairs.count())
        return plain(pairs, *rest)

    neardup._similar = similar
    try:
        found = neardup._across(places, frame_, links, links.select("a", "b"), threshold, 5)
    finally:
        neardup._similar = plain
    found = links if found is None else links.unionByName(found)
    member = {r["node"]: r["component"] for r in components(found).collect()}
    return {i: member.get(i, i) for i in range(len(texts))}, sum(compared)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8])
def test_search_across_components_leaves_out_no_link(spark, threshold):
    """For random multisets, with words that stand in most texts, and repeats."""
    rnd = random.Random(8)
    texts = [" ".join(f"a{rnd.randrange(12)}" if rnd.random() < 0.05 * (i % 7) else f"a{k}" for k in range(rnd.randrange(10, 40))) + f" p{i % 9}" * rnd.randrange(6) for i in range(40)] + ["x y " * k + f"z{k}" for k in (3, 9, 20, 21, 40)]
    assert one_cluster(spark, texts, threshold)[0] == plain_classes(list(enumerate(texts)), threshold)


def test_a_large_group_of_changed_copies_is_not_compared_in_pairs(spark):
    """Copies of one text, each with changes that make nearly all pairs less similar than the threshold."""
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(150)]

    def changed():
        words = list(base)
        for k in rnd.sample(range(150), rnd.choice([0, 5, 6, 7, 8])):
            words[k] = f"n{rnd.randrange(10**6)}"
        return " ".join(words)

    texts = [changed() for _ in range(300)]
    got, compared = one_cluster(spark, texts, 0.8)
    assert got == plain_classes(list(enumerate(texts))) and compared < 3 * len(texts)


def changed_thrice(n):
    """Copies of one template, each with a word of its own in each of three stretches of 50 words."""
    rnd = random.Random(4)
    texts = []
    for _ in range(n):
        words = [f"w{k}" for k in range(200)]
        for stretch in (0, 50, 100):
            words[stretch + rnd.randrange(50)] = f"n{rnd.randrange(10**9)}"
        texts.append(" ".join(words))
    return texts


def test_pairs_compared_in_a_group_of_changed_copies_grow_with_its_size(spark):
    compared = {}
    for n in (300, 1200):
        texts = changed_thrice(n)
        got, compared[n] = one_cluster(spark, texts, 0.8)
        sh = [neardup.shingles(t) for t in texts]
        members = {}
        for i, c in got.items():
            members.setdefault(c, []).append(i)
        assert all(c == min(m) for c, m in members.items())
        # no link leads out of a class, and none falls apart
        for c, m in members.items():
            assert not any(neardup.probability_jaccard(sh[i], sh[j]) >= 0.8 for i in m for j in range(n) if got[j] > c)
            reached, front = {c}, [c]
            while front:
                i = front.pop()
                near = [j for j in m if j not in reached and neardup.probability_jaccard(sh[i], sh[j]) >= 0.8]
                reached.update(near)
                front += near
            assert len(reached) == len(m)
    assert compared[1200] < 4.5 * compared[300]


def test_levels_leave_room_for_all_pairs_that_can_be_similar(spark):
    rnd = random.Random(2)
    rows = [[rnd.randrange(20, 400), rnd.randrange(20, 400), *(rnd.randrange(25) for _ in range(4))] for _ in range(20000)]
    rows = [[u, v, max(u, v), *rest] for u, v, *rest in rows]
    pairs = spark.createDataFrame(rows, "u_weight long, v_weight long, u_heaviest long, u_a long, u_d long, v_a long, v_d long").withColumn("v_heaviest", F.col("u_heaviest"))
    for threshold in (0.3, 0.8, 0.95, 1.0):
        close = pairs.where(neardup._close(threshold)).select((neardup._level("u", threshold, 32) + neardup._level("v", threshold, 32)).alias("sum"))
        assert (threshold == 1.0 or close.count() > 20) and close.where("sum > 32").count() == 0


def plain_tiles(item, text, least):
    """Longest common unmarked runs first, by looking at all places."""
    used_i, used_t, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and i + k not in used_i and j + k not in used_t:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return total
        used_i.update(range(best[1], best[1] + best[0]))
        used_t.update(range(best[2], best[2] + best[0]))
        total += best[0]


def test_tiling_against_all_places():
    rnd = random.Random(6)
    for _ in range(60):
        item = [rnd.choice("abcd").encode() for _ in range(rnd.randrange(5, 25))]
        text = [rnd.choice("abcd").encode() for _ in range(rnd.randrange(5, 40))]
        seeds = [(i, j) for i in range(len(item) - 2) for j in range(len(text) - 2) if item[i : i + 3] == text[j : j + 3]]
        got = decontaminate.tiles(item, text, seeds, 3) if seeds else []
        assert all(item[i : i + n] == text[j : j + n] for i, j, n in got)
        assert len({p for i, _, n in got for p in range(i, i + n)}) == sum(n for *_, n in got) == len({p for _, j, n in got for p in range(j, j + n)})
        assert sum(n for *_, n in got) == plain_tiles(item, text, 3)


def test_decontamination(spark):
    item = [f"q{i}" for i in range(24)]
    clean = " ".join(f"z{i}" for i in range(80))
    moved = item[12:] + ["and"] + item[:12]
    texts = [clean, f"{clean} {' '.join(item)} {clean}", f"{clean} {' '.join(moved).upper()}!", f"{clean} {' '.join(item[:9])}", None, "", "Two words"]
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, None), (9, "two, words"), (10, "")], "item_id long, text string")
    for block in (8_000_000, 60):
        got = sorted((r["doc_id"], r["item_id"], r["n_tiles"], r["coverage"]) for r in decontaminate.contaminated(frame(spark, texts), bench, block_chars=block).collect())
        assert got == [(1, 7, 1, 1.0), (2, 7, 2, 1.0), (6, 9, 1, 1.0)]
        kept = decontaminate.decontaminate(frame(spark, texts), bench, block_chars=block)
        assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 5]
    assert decontaminate.contaminated(frame(spark, texts), bench.limit(0)).count() == 0
