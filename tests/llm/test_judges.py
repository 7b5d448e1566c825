"""Language, toxicity, quality, licences, URLs and pages."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrail.llm import components, langid, licenses, maintext, quality, toxicity, urlfilter
from fieldtrail.llm import queries as Q

SF = "/root/testdata/sf0.01"


def plain_cost(counts, data):
    """PPM with escape method C by recursion over the contexts."""
    total = 0.0
    padded = b"   " + data

    def probability(context, byte):
        seen = {}
        for gram, n in counts.items():
            if gram[3 - len(context) : 3] == context:
                seen[gram[3]] = seen.get(gram[3], 0) + n
        if not seen:
            return probability(context[1:], byte) if context else 1 / 256
        all_, kinds = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (all_ + kinds)
        return kinds / (all_ + kinds) * (probability(context[1:], byte) if context else 1 / 256)

    for k in range(3, len(padded)):
        total -= np.log2(probability(padded[k - 3 : k], padded[k]))
    return total


def test_ppm_code_lengths_are_exact():
    texts = {"aa": b"banana band and ", "bb": "öl über äh öde ".encode()}
    counts = {k: np.unique(langid.grams(v), return_counts=True) for k, v in texts.items()}
    model = langid.PpmModel({k: (c, n.astype(float)) for k, (c, n) in counts.items()})
    for data in (b"banana xyz", "über und".encode(), b"q"):
        bits = model.costs(langid.grams(data)).sum(axis=0, dtype=np.float64)
        for k, lang in enumerate(model.langs):
            grams = {int(c).to_bytes(4, "big"): int(n) for c, n in zip(*counts[lang], strict=True)}
            assert bits[k] == pytest.approx(plain_cost(grams, data), rel=1e-4)


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Q.op8_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.where("lang = lang_pred").count() / got.count()
    assert right > 0.95
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 ²!", "x"), (4, "The thing of the ring", "x")], "doc_id long, text string, lang_pred string")
    found = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.identify(odd, model).collect()}
    assert [found[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and found[4][0] == "en"
    assert [r["doc_id"] for r in langid.keep_known(odd, model).collect()] == [4]
    assert langid.fit(docs.limit(0)).predict(["a", None]) == (["und", "und"], [0.0, 0.0])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b) if not (old := row) else [i, *([0] * len(b))]
        for j, y in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
    return row[-1]


def test_automaton_against_edit_distances():
    terms = [("moron", False, 0.9), ("worthless", False, 0.9), ("lostra", True, 0.9), ("scum", False, 0.8), ("vequiquer", True, 0.7)]
    automaton = toxicity.LexiconAutomaton(terms)
    rnd = random.Random(1)
    words = [t for t, *_ in terms] + ["m0ron", "mron", "morron", "wrthles", "lostraschaft", "lostr", "scumm", "vequiqueraux", "vequxquerno", "vekiqueraux"]
    for _ in range(400):
        w = list(rnd.choice(words))
        for _ in range(rnd.randrange(3)):
            k = rnd.randrange(len(w) + 1)
            w[k : k + rnd.randrange(2)] = rnd.choice(["", "x", "o"])
        words.append("".join(w))
    for w in filter(None, words):
        want = []
        for t, (term, stem, p) in enumerate(terms):
            d = min(distance(w[:k], term) for k in range(len(w) + 1)) if stem else distance(w, term)
            if d <= toxicity.edits_allowed(len(term), stem):
                want.append((d, -p, t))
        got = automaton.match(w)
        assert (got is None) == (not want), w
        if want:
            assert got == (min(want)[2], min(want)[0]), w


def test_quotation_weighs_less():
    m = toxicity.ToxicityModel([("moron", False, 0.99)], 0.01)
    said, quoted, none = (m.score(x)[0] for x in ("you are a m0ron!", 'they wrote "you moron" in a letter', "a quiet day"))
    assert said > 0.8 and quoted < 0.3 and none == pytest.approx(0.01) and m.score(None) == m.score("")


def test_toxic_texts_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    got = Q.op10_toxicity(spark, SF).join(labels, "doc_id").where("held_out")
    wrong = got.where("toxic <> predicted").count()
    assert wrong / got.count() < 0.06 and got.where("toxic = 0 AND predicted = 1").count() <= 1
    assert toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels.limit(0)).score("x")[1] == 0


@pytest.mark.parametrize(("sf", "recall", "false"), [("0.01", 0.6, 0.02), ("0.1", 0.9, 0.03)])
def test_toxic_texts_are_found(spark, sf, recall, false):
    folder = f"/root/testdata/sf{sf}"
    got = Q.op10_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out")
    share = {r["toxic"]: r["share"] for r in got.groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()}
    assert share[1] >= recall and share[0] <= false


def test_toxic_words_of_any_length_and_odd_rows(spark):
    m = toxicity.ToxicityModel([("moron", False, 0.99), ("scum", False, 0.99), ("quardo", True, 0.99), ("ab", False, 0.99)], 0.01)
    for word in ("moron/" + "x" * 60, "quardo" + "y" * 60, "skum", "scvm", "ab", "well-known-moron"):
        assert m.score(f"a {word} b")[0] > 0.3, word
    assert m.score("z" * 100_000) == m.score("abx") == (pytest.approx(0.01), 0)
    rows = [(i, f"n{i} badword m{i}" if i % 2 else f"n{i} fine m{i}", "x") for i in range(40)] + [(50, "same text", "x"), (51, "same text", "x"), (52, None, "x"), (53, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(50, 0), (51, 1), (50, 0)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs.unionByName(docs.where("doc_id = 1")), toxicity.fit(docs, labels)).collect()}
    assert all((v > 0.3) == (k % 2 == 1) for k, v in got.items() if k < 40) and got[52] == got[53] == pytest.approx(0.01)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_empty_tables_give_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert maintext.extract(pages).count() == urlfilter.judge(pages).count() == licenses.scan(docs).count() == 0
    assert quality.judge(docs, quality.fit(docs, labels)).count() == langid.identify(docs, langid.fit(docs)).count() == 0


def test_names_of_two_labels_are_no_aliases(spark):
    pages = spark.createDataFrame([(1, "http://m.org/a", ""), (2, "http://www.org/a", ""), (3, "http://m.x.org/a", ""), (4, "http://www.x.org/a", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r["alias"] for r in urlfilter.judge(pages).collect()}
    assert got == {1: "m.org/a", 2: "www.org/a", 3: "x.org/a", 4: "x.org/a"}


def plain_base(text):
    text = text or ""
    words = text.encode().split()
    seen = {}
    for w in zip(words, words[1:], words[2:]):
        seen[w] = seen.get(w, 0) + 1
    covered = {k + d for k, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    chars = sum(len(w.decode()) for w in words)
    return {"n_words": len(words), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_base_counts():
    rnd = random.Random(2)
    for t in [None, "", " \n", "a b", *("".join(rnd.choice("ab é|#\n\t\xa0\x0b") for _ in range(rnd.randrange(80))) for _ in range(300))]:
        assert quality.base_counts(t) == plain_base(t), repr(t)


def test_viterbi_against_all_paths():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        crf = quality.LineCrf(rnd.normal(size=quality.N_FEATURES), rnd.normal(size=(2, 2)))
        x = rnd.normal(size=(5, quality.N_FEATURES))
        def value(path):
            return sum(crf.emit @ x[i] for i in range(5) if path[i]) + sum(crf.move[a, b] for a, b in zip(path, path[1:]))
        best = max((tuple((k >> i) & 1 for i in range(5)) for k in range(32)), key=value)
        assert tuple(crf.decode(x)) == best


def test_quality_of_labelled_texts(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.op7_quality(spark, SF).join(labels.select("doc_id", "quality"), "doc_id").where("NOT base_failed")
    assert got.where("kept <> (quality = 1)").count() / got.count() < 0.03
    assert quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels.limit(0)).judge("some words here.")[0] == 1.0


def test_lines_of_joined_texts(spark):
    """Texts that the fit did not see, and such texts one after another: lines on both sides of the seam get their own labels."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    crf = quality.fit(docs, labels.where(half))
    rows = docs.join(labels.where(~half), "doc_id").where("text IS NOT NULL AND quality IS NOT NULL").orderBy("doc_id").select("text", "quality").collect()
    rows = [(r["text"], r["quality"]) for r in rows if len(r["text"].split()) >= 50]
    wrong = [(text, q) for text, q in rows if (crf.judge(text)[0] >= crf.cut) != (q == 1)]
    assert len(wrong) <= 0.005 * len(rows)
    bad, good = ([text for text, q in rows if q == k] for k in (0, 1))
    right, both = [], 0
    for k, (b, g) in enumerate(zip(bad, good)):
        parts = [(b, 0), (g, 1)] if k % 3 == 0 else [(g, 1), (b, 0)]
        want = np.concatenate([np.full(len(quality.line_features(t)), q) for t, q in parts])
        path = crf.decode(quality.line_features("\n".join(t for t, _ in parts)))
        right.append((path == want).mean())
        both += len(set(path.tolist())) == 2
    assert len(right) > 50 and np.mean(right) > 0.9 and both > 0.9 * len(right)


def test_labels_of_lines():
    crf = quality.LineCrf(np.eye(1, quality.N_FEATURES, 0)[0], np.zeros((2, 2)))
    x = np.zeros((5, quality.N_FEATURES))
    x[:, 0] = [-2, 3, -4, -5, 0.5]
    assert [y.tolist() for y in quality.line_labels([x, x, x[:1], x[:0]], [1, 0, 1, 0], crf)] == [[1, 1, 0, 0, 1], [0, 1, 0, 0, 0], [1], []]


def test_automaton_holds_all_runs_of_words():
    s = licenses.LicenseScanner()
    rnd = random.Random(4)
    vocabulary = [w for _, t in licenses.TEMPLATES for w in licenses.words(t)]
    for _ in range(60):
        text = []
        for _ in range(4):
            t = licenses.words(rnd.choice(licenses.TEMPLATES)[1])
            a = rnd.randrange(len(t))
            text += t[a : a + rnd.randrange(1, 9)] + [rnd.choice([b"zzz", rnd.choice(vocabulary)])]
        ends = {last: n for last, n, _ in s.matches(text)}
        known = [licenses.words(t) for _, t in licenses.TEMPLATES]
        for i in range(len(text)):
            n = max((k for k in range(1, i + 2) if any(text[i + 1 - k : i + 1] == t[a : a + k] for t in known for a in range(len(t)))), default=0)
            if i in ends:
                assert ends[i] == n
    for term in known:
        assert s.matches(term)[-1][1] == len(term)


def test_licenses():
    s = licenses.LicenseScanner()
    got = s.scan("X. Licensed under the Apache License, Version 2.0.\nReleased under the MIT LICENSE mit license")
    assert (got["n_base"], got["first_word"], got["last_word"], got["base_labels"], got["score"]) == (3, 4, 14, "apache,mit", 1.0)
    assert s.scan("Licensed under CC BY-NC 4.0.")["labels"] == "cc-by-nc" and s.scan("the license of the mit")["labels"] == ""
    assert s.scan(None) == s.scan("") and s.scan(None)["first_word"] is None


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(3, 3), (None, 4)]
    label = {x: x for e in edges for x in e if e[0] is not None and e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def rows_joined(spark, work):
    """The rows that joins make while ``work`` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    total, runs = 0, store.executionsList()
    for k in range(before, runs.size()):
        run = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size() if "Join" in node.name() else 0)):
                if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                    total += int(v.get().replace(",", ""))
    return total


def test_edges_inside_a_component_are_not_gone_through_again(spark):
    """Nodes each with an edge to several of a few leaders, as buckets of near duplicates make them, in groups that a chain connects."""
    rnd = random.Random(6)
    for n in (500, 2000):
        edges = {(1000 * g + rnd.randrange(12), 1000 * g + k) for g in range(n // 500) for k in range(12, 500) for _ in range(20)}
        edges |= {(1000 * g + 400, 1000 * g + 1400) for g in range(n // 500 - 1)} | {(10**6 + k, 10**6 + k + 1) for k in range(40)}
        frame = spark.createDataFrame([(a, b) for a, b in edges], "a long, b long")
        got = {}
        joined = rows_joined(spark, lambda: got.update({r["node"]: r["component"] for r in components.components(frame).collect()}))  # noqa: B023
        want = {x: min(x, 10**6) if x >= 10**6 else min(y for e in edges for y in e) for e in edges for x in e}
        assert got == want and joined < 4 * len(edges)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_more_edges_merge_components(spark, kind):
    rnd = random.Random(7)
    for many, more in ((40, 12), (0, 20), (25, 0)):
        edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(many)]
        added = [(rnd.randrange(100), rnd.randrange(100)) for _ in range(more)] + [(4, 4), (None, 3), (99, 0), (0, 99)]
        frames = [spark.createDataFrame(e, "a long, b long").selectExpr(f"cast(a as {kind}) a", f"cast(b as {kind}) b") for e in (edges, added)]
        as_dict = lambda df: {r["node"]: r["component"] for r in df.collect()}
        labels = components.components(frames[0])
        assert as_dict(components.merged(labels, frames[1])) == as_dict(components.components(frames[0].unionByName(frames[1])))


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="%s">'
    rows = [
        (1, "https://Sub.Example.com/en/x", None), (2, "http://www.example.com/en/y", None), (3, "http://a.net/fr/z", None), (4, "http://a.net/de/z?utm_source=f#t", None), (5, "https://www.a.net/de/z/", link % "http://a.net/fr/z"),
        (6, "http://b.org/1", link % "http://b.org/2"), (7, "http://b.org/2", "<meta http-equiv=refresh content='0;url=http://shop.example.com/en/q'>"), (8, "http://b.org/2", None), (9, None, "x"), (10, "no url", "x"),
        (11, "http://c.org/", link % "http://ok.com/"), (12, "http://ok.com/", link % "http://shop.example.com/en/q"), (13, "http://shop.example.com/en/q", None), (14, "http://notexample.com/en/", None), (15, "http://x.org:80/a.html?b=1&ref=2&a=0", None), (16, "https://m.x.org/a?a=0&b=1", None),
    ]
    got = {r["page_id"]: r.asDict() for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: (v["rule"], v["verdict"]) for k, v in got.items()} == {
        1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: ("net/fr/", "block"), 4: (None, "block"), 5: (None, "block"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"),
        11: (None, "allow"), 12: ("com/", "allow"), 13: ("example.com/en/", "block"), 14: ("com/", "allow"), 15: (None, "allow"), 16: (None, "allow"),
    }
    assert got[1]["host"] == "sub.example.com" and got[9]["host"] == got[10]["path"] == "" and got[15]["alias"] == got[16]["alias"] == "x.org/a?a=0&b=1"


def test_targets_are_resolved_as_by_urllib(spark):
    from urllib.parse import urljoin

    bases = ["https://a.org/x/y.html?q=1#f", "http://a.org", "http://a.org/x/"]
    targets = ["/en/x", "//host/x", "z", "../z?b=2", "./../../z/.", "?c=3", "http://h.com/a/b", "sub/../k#t", "..", ".", "/a/./b/..", "x/..?d=..", "mailto:me", "#t", "/a?u=http://b.com/.."]
    rows = [(b, t) for b in bases for t in targets]
    got = spark.createDataFrame(rows, "b string, t string").select("b", "t", urlfilter.resolve(F.col("b"), F.col("t")).alias("u")).collect()
    for r in got:
        want = urljoin(r["b"], r["t"]).split("#")[0] if r["t"] != "mailto:me" else None
        assert (r["u"].split("#")[0] if r["u"] else None) == want, r
    odd = spark.createDataFrame([(None, "/x"), ("no address", "/x"), ("http://a.org", None), (None, "http://h/x")], "b string, t string")
    assert [r[0] for r in odd.select(urlfilter.resolve(F.col("b"), F.col("t"))).collect()] == [None, None, None, "http://h/x"]


def test_all_forms_of_links_join_pages(spark):
    def refresh(u):
        return f'<meta http-equiv="refresh" content="0; url={u}">'

    def canonical(u):
        return f"<link rel='canonical' href='{u}'>"

    rules = [urlfilter.Rule("bad.org", "/", "block")]
    pages = [
        (1, "http://bad.org/home", ""),
        (2, "http://one.org/a", refresh("http://two.org/x") + canonical("http://bad.org/home")),  # both edges count
        (3, "http://two.org/x", ""),
        (4, "http://three.org/s/a", refresh("/en/x")), (5, "http://three.org/en/x", canonical("http://bad.org/home")),
        (6, "https://four.org/a", canonical("//bad.org/home?utm_x=1")),
        (7, "http://five.org/d/a", refresh("b?p=1") + canonical("http://bad.org/home")), (8, "http://five.org/d/b?p=1", None),
        (9, "http://six.org/d/a", refresh("../k")), (10, "http://six.org/k", refresh("//bad.org/home")),
        (11, "http://seven.org/a", '<base href="//bad.org/"><p>' + canonical("home")),
        (12, "http://free.org/a", refresh("/b") + canonical("mailto:x@bad.org")), (13, "http://free.org/b", ""), (14, None, canonical("/home")),
    ]
    got = {r["page_id"]: (r["verdict"], r["alias"]) for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert len(got) == 14 and {k for k, v in got.items() if v[0] == "block"} == set(range(1, 12))
    assert got[12][1] == got[13][1] == "free.org/a" and got[14] == ("allow", None)


def plain_cut(terminal, edges):
    """The least cost over all labellings."""
    n = len(terminal)
    return min(sum(abs(z) for z, s in zip(terminal, side, strict=True) if (z > 0) != s and z) + sum(w for a, b, w in edges if side[a] != side[b]) for side in ([bool(k >> i & 1) for i in range(n)] for k in range(1 << n)))


def test_minimum_cut_against_all_labellings():
    rnd = random.Random(6)
    for _ in range(60):
        n = rnd.randrange(1, 9)
        terminal = [rnd.uniform(-3, 3) for _ in range(n)]
        edges = [(i, i + 1, rnd.random()) for i in range(n - 1)] + [(a, b, rnd.random()) for a in range(n) for b in range(a + 2, n) if rnd.random() < 0.3]
        side = maintext.min_cut(terminal, edges)
        cost = sum(abs(z) for z, s in zip(terminal, side, strict=True) if (z > 0) != s) + sum(w for a, b, w in edges if side[a] != side[b])
        assert cost == pytest.approx(plain_cut(terminal, edges))


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav>Home <a href=/>x</a></nav><div id="cookie-notice">We use cookies here.</div>
<div class="layout"><div class="post-content"><h2>Story of a &lt;day&gt;</h2><p>It was a long day in the town, and
 nobody came.<p>Then&nbsp;it ended, as days do. <a href=x>More</a> of it.<br>So.</div><div class="sidebar"><p>Popular posts are here to read now.</p></div></div>
<section id="comments"><p>Great article, thanks a lot for writing it!</p></section><form><label>Mail</label><input></form><script>var p = "<p>no</p>";</script><footer>(c)</footer></body>"""


def test_main_text(spark):
    want = "Story of a <day>\n\nIt was a long day in the town, and nobody came.\n\nThen it ended, as days do. More of it. So."
    assert maintext.main_text(PAGE)[0] == want
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>x < y &amp;lt; z <b>b"), (1, "u", PAGE), (5, "u", "<div " * 500 + "<p>deep")], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in maintext.extract(pages).orderBy("page_id").collect()]
    assert got[:2] == [(1, want, len(want))] * 2 and got[2:4] == [(2, "", 0), (3, "", 0)] and got[4][1] == "x < y &lt; z b"


STORY = "<h1>A day</h1><p>It was a long day in the town, and nobody came to see it end.</p><p>Then it was night, and they all slept.</p>"
STORY_TEXT = "A day\n\nIt was a long day in the town, and nobody came to see it end.\n\nThen it was night, and they all slept."
COMMENTS = '<section id="comments"><article class="comment"><p>' + "What a story this is, I would read it again and again. " * 8 + "</p></article></section>"


@pytest.mark.parametrize(
    "html",
    [
        f'<div class="layout with-sidebar"><article>{STORY}</article><div class="sidebar"><p>Popular posts are here to read now.</p></div></div>',
        f'<div class="page has-comments"><main>{STORY}</main>{COMMENTS}</div>',
        f'<div id="no-ads"><div class="x with-sidebar"><div role="main">{STORY}<div class="ad">Buy this today, it is cheap.</div></div></div></div>',
        f'<form id="f"><nav>Home</nav><article>{STORY}</article><footer>(c) us</footer></form>',
        f'<h1>Site</h1><form><div id="content">{STORY}</div><label>Mail</label></form>'.replace("<h1>Site</h1>", "<header>Site</header>"),
        f'<main><nav>Home</nav><div class="layout with-sidebar"><article>{STORY}</article></div><div class="comment-area">{COMMENTS}</div></main>',
        f'<div class="with-sidebar" role="main">{STORY}</div>',
        f'<article>{STORY}{COMMENTS}</article><aside><article><p>Another story that is told elsewhere, at length.</p></article></aside>',
        f'<article>{STORY.replace("<h1>A day</h1>", '<header class="entry-header"><h1>A day</h1></header>')}</article>',
        f'<header class="site-header"><p>The town paper, each day anew.</p></header><article>{STORY.replace("<h1>A day</h1>", '<div class="post-header"><h1>A day</h1></div>')}</article>',
        f'<div class="hentry"><header class="entry-header"><h1>A day</h1></header>{STORY[len("<h1>A day</h1>"):]}</div>',
        f'<article><svg><path d="M0"/>{STORY}</article>',
        f'<article><object data="x">{STORY}<canvas></article>',
        f'<div class="no-ads" hidden><article><p>Not to be seen by anybody at all, ever.</p></article></div><article>{STORY}</article>',
    ],
)
def test_wrappers_do_not_hide_the_text(html):
    assert maintext.main_text(f"<body>{html}</body>")[0] == STORY_TEXT


def test_stray_tags_take_linear_time():
    """Tags that close nothing, and drawings that nothing closes, are not looked for again and again."""
    from time import process_time

    for stray in ("</i>", "<svg>", "</li>"):
        began = process_time()
        assert maintext.main_text("<article>" + "<b>" * 3000 + stray * 30_000 + STORY)[0] == STORY_TEXT
        assert process_time() - began < 5, stray


def test_neighbours_overturn_a_mark():
    note = "The notice that was read out in the town that day was as long as all the others were, and it said " + "that nobody would come, " * 20 + "ever."
    html = f'<article class="post-content"><p>{note}</p><p class="notice">{note}</p><p>{note}</p></article>'
    page = maintext.blocks(html)
    assert maintext.costs(page)[1] < 0 and maintext.label(page) == [True] * 3


def test_articles_of_all_pages(spark):
    """Every page's article, by cutting it out between its tags."""
    import html
    import re

    for r in Q.op3_main_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(filter(None, parts))


def test_folds(spark):
    rows = Q.op8_language(spark, SF).select("doc_id", "held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows) and F is not None


def test_license_base_places_against_all_places():
    rnd = random.Random(11)
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    scanner = licenses.LicenseScanner()
    for _ in range(200):
        text = " ".join(rnd.choice(["MIT", "license", "License", "apache", "general", "public", "x-license", "mit;license", "é"]) for _ in range(rnd.randrange(30)))
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
        places = [(k, label) for k in range(len(words)) for label, p in phrases.items() if words[k : k + len(p)] == p]
        got = scanner.scan(text)
        assert (got["n_words"], got["n_base"]) == (len(words), len(places))
        assert (got["first_word"], got["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert got["base_labels"] == ",".join(sorted({label for _, label in places}))


def test_very_long_texts(spark):
    """Whole texts are read, whatever their length; what stands at the end counts."""
    long = "the thing of the other day\n" * 20_000
    docs = spark.createDataFrame([(1, long + "mit license moron")], "doc_id long, text string")
    assert licenses.scan(docs).first()["base_labels"] == "mit"
    assert quality.judge(docs, quality.fit_crf([], [])).first()["n_words"] == 120_003
    assert toxicity.score(docs, toxicity.ToxicityModel([("moron", False, 0.99)], 0.01)).first()["toxicity"] > 0.9
    model = langid.fit(spark.createDataFrame([(1, "the thing of the day", "en"), (2, "der tag und die nacht", "de")], "doc_id long, text string, lang string"))
    assert langid.identify(docs, model).first()["lang_pred"] == "en"
    page = "<article>" + "<p>It was a long day in the town, and nobody came.</p>" * 5_000 + "<p>The end of it.</p></article>"
    got = maintext.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()["text"]
    assert got.count("\n\n") == 5_000 and got.endswith("The end of it.")


def test_bodies_of_licences():
    """A body with words changed, lines wrapped and a name put in still counts; half of one does not."""
    scanner = licenses.LicenseScanner()
    for label, body in licenses.TEMPLATES[-7:]:
        words = body.split()
        changed = words[:30] + ["by", "ACME,", "Inc."] + words[30:60] + words[61:]
        text = "Copyright (c) 2020 A. Author\n\n" + "\n".join(" * " + " ".join(changed[k : k + 9]) for k in range(0, len(changed), 9))
        got = scanner.scan(text)
        assert label in got["labels"].split(",") and got["score"] > 0.9, label
        assert any(x["label"] == label and x["last"] - x["first"] > 0.9 * len(words) for x in got["spans"])
    assert "isc" not in scanner.scan(" ".join(licenses.TEMPLATES[-5][1].split()[:40]))["labels"]


def plain_chains(scanner, text):
    """The greatest share of each template that a chain of matches covers, by trying all chains."""
    best = {}
    for k, template in enumerate(scanner.texts):
        known = [scanner.vocabulary.get(w) for w in text]
        at = []
        for last, length, _ in scanner.matches(text):
            run = known[last - length + 1 : last + 1]
            at += [(last, e, length) for e in range(length - 1, len(template)) if template[e - length + 1 : e + 1] == run]
        value = []
        for i, (last, end, n) in enumerate(at):
            longer = [v + min(n, end - e, last - x) for (x, e, _), v in zip(at[:i], value, strict=True) if x < last and e < end and last - n - x <= scanner.max_gap and end - n - e <= scanner.max_gap]
            value.append(max([n, *longer]))
        if value:
            best[scanner.labels[k]] = max(best.get(scanner.labels[k], 0), max(value) / len(template))
    return best


def test_chains_against_all_chains():
    rnd = random.Random(12)
    made = [(f"t{k}", " ".join(rnd.choice("abcd") * 2 for _ in range(30))) for k in range(3)]
    for scanner, rounds in ((licenses.LicenseScanner(made), 200), (licenses.LicenseScanner(), 30)):
        for _ in range(rounds):
            text = licenses.words(rnd.choice(made if rounds == 200 else licenses.TEMPLATES)[1])
            for _ in range(rnd.randrange(6)):
                k = rnd.randrange(len(text) + 1)
                text[k : k + rnd.randrange(2)] = rnd.choice([[b"zz"], [b"zz", b"yy"], [], text[:5]])
            found = scanner.spans(text)
            got = {label: max(x[3] for x in found if x[0] == label) for label in {x[0] for x in found}}
            assert got == pytest.approx(plain_chains(scanner, text))
            by_label = {}
            for label, first, last, _ in found if rounds == 200 else ():
                assert by_label.get(label, -1) < first <= last
                by_label[label] = last


def test_runs_that_repeat_in_a_licence():
    """Words changed on both sides of a run that stands twice in a body."""
    scanner = licenses.LicenseScanner()
    body = next(t for label, t in licenses.TEMPLATES if label == "bsd" and len(t) > 1000).split()
    second = [k for k in range(len(body)) if body[k : k + 4] == ["this", "list", "of", "conditions"]][1]
    body[second - 1], body[second + 4] = "xx", "yy"
    got = scanner.scan(" ".join(body))
    assert "bsd" in got["labels"].split(",") and got["score"] > 0.9
    assert [x["label"] for x in got["spans"]].count("bsd") >= 1
