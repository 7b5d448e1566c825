"""The pipeline against brute force, and what its language stage decides."""

import random
import zlib

import numpy as np
from test_spans import plain_classes
from tokenizers import Tokenizer

import corpus_pipeline
from fieldtrail.llm import langid
from fieldtrail.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"
NOISE = ["xqz wkjv vvbqx pzxw kjqh zztk qwxk hjkb bnvq cxzj", "\u042d\u0442\u043e \u0440\u0443\u0441\u0441\u043a\u0438\u0439 \u0442\u0435\u043a\u0441\u0442", "qQ" * 40]


def test_language_stage_decides_by_code_lengths(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = docs.where("doc_id % 5 <> 0")
    clean = [r["text"] for r in docs.where("doc_id % 5 = 0").collect() if r["text"] and any(map(str.isalpha, r["text"]))]
    model = langid.fit(train)
    assert model.accepts(clean) == [True] * len(clean) and model.accepts([*NOISE, None, "12", ""]) == [False] * 6
    assert model.accepts(["x1 y2 token = 2abc3ff2ca8fb1e4c565a0eb63815530a948bdde the thing of the ring"]) == [True]
    odd = spark.createDataFrame([(1, clean[0]), (2, NOISE[0]), (3, None), (4, clean[1])], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in langid.keep_known(odd, model).collect()) == [1, 4]


def test_texts_stay_when_no_language_was_learned(spark):
    docs = spark.createDataFrame([(1, "a text", None), (2, None, "en"), (3, "12", None), (4, NOISE[0], None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 4]


def cut(texts, window=50):
    """Texts without the words of windows that a text with a smaller id has too."""
    words = {i: t.split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        if len(gone) < len(w) or not w:
            out[i] = " ".join(x for p, x in enumerate(w) if p not in gone)
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    words = ["".join(rnd.choice(["the", "an", "ing", "ti", "on", "re", "er", "sh", "o", "le"]) for _ in range(rnd.randrange(1, 5))) for _ in range(600)]

    def prose(n):
        return [rnd.choice(words) for _ in range(n)]

    passage, shared = prose(24), prose(60)
    texts = {i: prose(80) for i in range(30)}
    texts |= {30: [*texts[3][:-1], "other"], 31: list(texts[4]), 32: prose(70) + shared + prose(70), 33: prose(90) + shared + prose(50), 34: list(shared), 35: prose(60) + passage + prose(40)}
    texts = {i: " ".join(t) for i, t in texts.items()}
    gone = {40: NOISE[0], 41: None, 42: "12 34!", 43: "", 44: NOISE[2]}
    rows = [(i, t, None if i >= 40 else "en", "s", len(t or "")) for i, t in [*texts.items(), *gone.items()]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    classes = plain_classes(list(texts.items()))
    left = cut({i: t for i, t in texts.items() if classes[i] == i})
    left = {i: t for i, t in left.items() if " ".join(passage) not in t}
    assert set(texts) - set(left) == {30, 31, 34, 35} and len(left[33].split()) == 140
    encode = Tokenizer.from_file(tokenizer_path()).encode
    want = {i: [*encode(t, add_special_tokens=False).ids, 1] for i, t in left.items()}

    packed = corpus_pipeline.run(spark, str(tmp_path))
    got = packed.collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted((i, 0, 0, len(v), zlib.crc32(np.array(v, np.uint32).tobytes())) for i, v in want.items())
    fills = {}
    for r in got:
        fills.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fills.values():
        assert sum(n for _, n in parts) <= 4096 and [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
    # the result is read from what was written
    assert packed.inputFiles() and all("/stage-" in f for f in packed.inputFiles()) and sorted(packed.collect()) == sorted(got)
