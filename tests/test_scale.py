"""What the operators do with many keywords, large groups and changed files: work that is counted, plans, and brute force."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F
from test_lineage import FILES, files_of, frames, plain_paths

from fieldtrail.functions import text as T
from fieldtrail.functions.extractors import EXTRACTORS
from fieldtrail.functions.ranks import numbered
from fieldtrail.operators import discover, graph, search, sqlrefs, symbols
from fieldtrail.sources import store

# ---- Many keywords ----


def lines_of(spark, lines):
    return spark.createDataFrame([("r", "a.java", "\n".join(lines))], "repo string, path string, text string")


def test_keywords_with_a_word_in_common_meet_only_lines_that_have_them(spark):
    files = lines_of(spark, ["int user = user + users.field(1);"] * 2000 + ["userField7 + user_field8", "User.field9"])
    keywords = spark.createDataFrame([(f"userField{i}",) for i in range(300)], "keyword string")
    for most in (10_000, 0):
        met = discover.keyword_lines(files, keywords, max_broadcast=most)
        assert sorted((r["line"], r["keyword"]) for r in met.collect()) == [(2001, "userField7"), (2001, "userField8")]


def test_odd_keywords_are_found_as_one_by_one(spark):
    text = ["größe = Größe + xGröße;", "日本 + 日本語;", "a-b, a--b, a_b aB", "x__y + xY", "-lead- lead", "$f.g($f_g)", "store_no_list storeNoX theStoreNo", "a.b c"]
    files = lines_of(spark, text)
    words = ["größe", "日本", "a-b", "x__y", "-lead-", "$f", "storeNo", "a.b", "gro", "--"]
    keywords = spark.createDataFrame([(w, ["x.y", "c "] if w == "$f" else None) for w in words], "keyword string, extras array<string>")
    shown = lambda df: sorted(map(tuple, df.select("line", "col", "occurrence_type").collect()))
    one = {w: shown(discover.find_usages(files, w, ["x.y", "c "] if w == "$f" else [])) for w in words}
    assert all(one[w] for w in words if w not in ("gro", "--"))
    for most in (10_000, 0):
        many = discover.find_usages_many(files, keywords, max_broadcast=most).checkpoint()
        assert {w: shown(many.where(F.col("keyword") == w)) for w in words} == one


# ---- Stored symbols ----


def held(tables):
    return {k: sorted(map(repr, v.collect())) for k, v in tables.items()}


def same_as_fresh(spark, files, path):
    fresh, kept = symbols.extract_symbols(files), store.read_store(spark, path)
    return held({k: fresh[k] for k in kept}) == held({k: kept[k].select(fresh[k].columns) for k in kept})


def parts_of(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_store_is_refreshed_in_place(spark, tmp_path):
    files = [("r", f"r/A{i}.java", f"class A{i} {{ B b; int f{i}(int x) {{ return b.g{i}(x); }} }}") for i in range(40)]
    path = tmp_path / "store"
    states = store.refresh_store(files_of(spark, files), str(path), buckets=16)
    assert {r["state"] for r in states.collect()} == {"changed"} and same_as_fresh(spark, files_of(spark, files), str(path))
    before = parts_of(path)
    changed = [*files[:7], ("r", "r/A7.java", "class A7 extends C { }"), *files[8:]]
    states = store.refresh_store(files_of(spark, changed), str(path), buckets=16)
    assert [(r["file"], r["state"]) for r in states.collect() if r["state"] != "unchanged"] == [("r/A7.java", "changed")]
    assert same_as_fresh(spark, files_of(spark, changed), str(path))
    gone, new = before - parts_of(path), parts_of(path) - before
    assert len({p.split("/")[1] for p in new if p.startswith("methods")} | {p.split("/")[1] for p in new if p.startswith("inheritance")}) == 1
    assert len({p.split("/")[1] for p in new if p.startswith("manifest")}) == 1 and len(gone) <= 6

    # nothing changes, nothing is written; a moved file is not extracted again; all files may go and come back
    before = parts_of(path)
    store.refresh_store(files_of(spark, changed), str(path), buckets=16)
    assert parts_of(path) == before
    moved = [("s", p.replace("r/", "s/"), t) for _, p, t in changed]
    store.refresh_store(files_of(spark, moved), str(path), buckets=16)
    assert {p for p in parts_of(path) if not p.startswith("manifest")} == {p for p in before if not p.startswith("manifest")} and same_as_fresh(spark, files_of(spark, moved), str(path))
    store.refresh_store(files_of(spark, []), str(path), buckets=16)
    assert all(v.isEmpty() for v in store.read_store(spark, str(path)).values())
    store.refresh_store(files_of(spark, files), str(path), buckets=16)
    assert same_as_fresh(spark, files_of(spark, files), str(path))


def test_store_of_another_version_is_built_anew(spark, tmp_path):
    path, java = str(tmp_path / "s"), [f for f in FILES if f[1].endswith(".java")]
    store.refresh_store(files_of(spark, FILES), path, "1", 4)
    wrong = spark.read.parquet(f"{path}/methods").withColumn("qual", F.lit("Poisoned.poisoned")).checkpoint()
    wrong.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/methods")
    store.refresh_store(files_of(spark, FILES), path, "1", 4)
    assert {r["qual"] for r in store.read_store(spark, path)["methods"].collect()} == {"Poisoned.poisoned"}
    states = store.refresh_store(files_of(spark, FILES), path, "2", 4)
    assert [r["state"] for r in states.collect()] == ["changed"] * len(java) and same_as_fresh(spark, files_of(spark, FILES), path)
    # an equal file, a path that is there twice, and an unknown language
    more = [*FILES, ("z", "z/Copy.java", FILES[0][2]), ("z", "z/Copy.java", FILES[0][2]), ("z", "z/a.txt", "x")]
    store.refresh_store(files_of(spark, more), path, "2", 4)
    assert same_as_fresh(spark, files_of(spark, more[:-2]), path)


def exchanges(plan):
    """The plan's parts that are below a shuffle."""
    out, stack = [], [(plan, False)]
    while stack:
        node, below = stack.pop()
        name = node.nodeName()
        below = below or name == "Exchange"
        if below and name != "Exchange":
            out.append(node)
        children = node.children()
        inner = [node.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [children.apply(i) for i in range(children.size())]
        stack += [(c, below) for c in inner]
    return out


def test_texts_of_changed_files_stay_in_their_tasks(spark, tmp_path):
    files_of(spark, FILES).write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    manifest = files.select("repo", F.col("path").alias("file"), F.when(F.col("path").endswith("Service.java"), "old").otherwise(F.col("sha256")).alias("sha256"))
    for name, n in (("changed", 1), ("unchanged", len(FILES) - 1)):
        df = symbols.diff_manifest(files, manifest)[name]
        assert df.count() == n
        shuffled = [a for node in exchanges(df._jdf.queryExecution().executedPlan()) for a in re.findall(r"\btext#", node.output().mkString(","))]
        assert not shuffled


# ---- Numbers, spans, classes ----


def test_numbers_of_groups_of_any_size(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, *range(40)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(7)
    got = {r["id"]: r["place"] for r in numbered(df, ["g"], ["v", "id"]).collect()}
    for g in ("a", "b", None):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in want] == list(range(1, len(want) + 1))
    assert numbered(df.limit(0), ["g"], ["v", "id"]).collect() == []


def test_enclosing_methods_against_brute_force(spark):
    rnd = random.Random(3)
    spans = [("r", rnd.choice("ab"), f"m{i}", s := rnd.randrange(900), s + rnd.choice([0, 3, 40, 300, -2]), i) for i in range(300)] + [("r", "a", "all", 0, 1_000_000, 999)]
    sites = [("r", rnd.choice("abc"), rnd.choice([None, *range(1300)]), rnd.choice("xy"), rnd.random() < 0.5) for _ in range(900)]
    sites += sites[:50] + [("r", "a", 999_999, "x", True)] * 3
    want = []
    for s in sites:
        fit = [(m[4] - m[3], m[5], m[2]) for m in spans if m[:2] == s[:2] and s[2] is not None and m[3] <= s[2] <= m[4]]
        want += [(*s, min(fit)[2])] if fit else []
    m = spark.createDataFrame(spans, "repo string, file string, qual string, start_line int, end_line int, ord int")
    s = spark.createDataFrame(sites, "repo string, file string, line int, _row string, col boolean")
    for n in ("1", "9"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = symbols.enclosing_method(s, m)
        assert got.columns == [*s.columns, "qual"] and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert symbols.enclosing_method(s, m.limit(0)).collect() == [] and symbols.enclosing_method(s.limit(0), m).collect() == []


def test_ancestors_of_any_depth(spark):
    chain = [("r", f"C{i}", f"p.C{i + 1}<T>") for i in range(200)]
    rnd = random.Random(4)
    tangle = [("s", f"T{rnd.randrange(25)}", f"T{rnd.randrange(25)}") for _ in range(40)]
    got = symbols.class_ancestors(spark.createDataFrame([*chain, *tangle], "repo string, cls string, parent string")).collect()
    up = defaultdict(set)
    for repo, cls, parent in [*chain, *tangle]:
        up[repo, cls].add(parent.split(".")[-1].split("<")[0])
    want = set()
    for repo, cls in {*up, *((r, p) for (r, _), ps in up.items() for p in ps)}:
        level, seen, d = {cls}, {cls}, 0
        while level:
            want |= {(repo, cls, c, d) for c in level}
            level = {p for c in level for p in up.get((repo, c), ())} - seen
            seen |= level
            d += 1
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_calls_far_from_what_they_belong_to():
    gap = " " * 300 + "/* " + "x" * 300 + " */\n"
    code = f"class A {{ void f() {{ dao{gap}.{gap}load(1); new{gap}Thing(2); new{gap}a.b.Other(3); Type{gap}local(4); return{gap}done(5); this.{gap}<T>gen(6); x ? y{gap}(7) : z(8); }} }}"
    assert [c[1:3] for c in EXTRACTORS[".java"](code).calls] == [("load", "dao"), ("done", None), ("gen", "this"), ("y", None), ("z", None)]


# ---- Search ----


def plain_score(q, t):
    q, t = q.lower(), t.lower()
    at, run, score = 0, 0, 0
    for ch in q:
        p = t.find(ch, at) + 1
        if not p:
            return None
        follows = at > 0 and p == at + 1
        run = run + 1 if follows else 0
        score += (30 if p == 1 else 15 if not re.fullmatch("[0-9a-zA-Z_]", t[p - 2]) else 0) + (8 + run * 5 if follows else 1)
        at = p
    return score + (40 if q == t else 0) + max(0, 12 - (len(t) - len(q)))


def test_fuzzy_search_scores_few_pairs(spark):
    rnd = random.Random(5)
    syllables = ["or", "der", "line", "ship", "no", "ter", "qu", "Zip", "max", "é", ".", "_", "-"]
    word = lambda n: "".join(rnd.choice(syllables) for _ in range(n))
    nodes = [(f"n{i:03}", word(rnd.randrange(1, 7)), rnd.choice(["Service", "Table", None]), rnd.randrange(50)) for i in range(400)]
    queries = [word(rnd.randrange(1, 4))[: rnd.randrange(1, 9)] for _ in range(60)] + ["", " ", " order ", "zz", "é", "n001"]
    n = spark.createDataFrame(nodes, "id string, label string, layer string, ord int")
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    want = []
    for query in set(queries):
        scored = []
        for id_, label, layer, order in nodes:
            scores = [s for t in (label, id_, layer) if t and query.strip() and (s := plain_score(query.strip(), t)) is not None]
            scored += [(-max(scores), order, id_)] if scores else []
        want += [(query, rank, id_, -s) for rank, (s, _, id_) in enumerate(sorted(scored)[:8], 1)]
    assert sorted(map(tuple, search.fuzzy_search(n, q).collect())) == sorted(want)
    pairs, _ = search.candidate_pairs(n, q.where("length(query) > 3"))
    hits = [(x, t) for x in {x for x in queries if len(x) > 3} for t in {t for row in nodes for t in row[:3] if t} if x.strip() and plain_score(x.strip(), t) is not None]
    everything = len({x for x in queries if len(x) > 3}) * len({t for row in nodes for t in row[:3] if t})
    assert {tuple(r) for r in pairs.collect()} >= set(hits) and pairs.count() < everything / 10


def test_raw_sql_meets_terms_by_their_rarest_letters(spark):
    texts = [("r", f"q{i}.sql", f"select * from t_order_{i} where common_col = {i} " + ("and zebra_no = 1" if i % 50 == 0 else "")) for i in range(200)] + [("s", "a.sql", "select zebra from common")]
    files = files_of(spark, texts)
    sql = files.select("repo", F.col("path").alias("file"), F.lower("text").alias("low"))
    terms = spark.createDataFrame([("r", "common_zebra"), ("r", "zebra_no"), ("r", "comxyz"), ("s", "zebra")], "repo string, term string")
    got = sqlrefs.raw_sql_candidates(sql, terms).collect()
    assert sorted((r["repo"], r["term"], r["file"]) for r in got) == sorted([("r", "zebra_no", f"q{i}.sql") for i in range(0, 200, 50)] + [("s", "zebra", "a.sql")])
    assert {r["term"] for r in spark.range(1).select(F.explode(T.terms(F.lit("zebraNo"))).alias("term")).collect()} == {"zebra", "zebrano"}


# ---- Graphs ----


def test_paths_of_all_lengths(spark):
    nodes = [("r", "k", f"u{i}", "unit", f"u{i}", "Service", None, [], i) for i in range(20)] + [("r", "k", "table:t", "table", "t", "Table", "t", [], 99)]
    edges = [("r", "k", f"u{i}", f"u{i + 1}", "call", "confirmed", i) for i in range(19)] + [("r", "k", "u19", "table:t", "references", "confirmed", 50)]
    n, e = frames(spark, nodes, edges)
    for hops in (1, 2, 5, 12):
        got = {r["start"]: list(r["path"]) for r in graph.shortest_paths_to_tables(n, graph.normalize_edges(n, e), max_hops=hops).collect()}
        assert got == {k: v for k, v in plain_paths(nodes, edges).items() if len(v) <= hops + 1}


def test_long_forms_say_what_arrays_say(spark):
    nodes = [("r", "k", f"u{i}", "unit", f"u{i}", ["Controller", "Service", None][i % 3], None, [], (i * 7) % 30) for i in range(30)] + [("r", "k", "table:t", "table", "t", "Table", "t", [], 99)]
    edges = [("r", "k", "u0", "u1", "call", "confirmed", 1), ("r", "k", "u1", "table:t", "references", "confirmed", 2)]
    n, e = frames(spark, nodes, edges)
    paths, built = graph.main_paths(n, graph.normalize_edges(n, e)), graph.build_layers(n)
    members = defaultdict(list)
    for r in graph.layer_members(n).orderBy("place").collect():
        members[r["layer"]].append(r["id"])
    assert members == {r["layer"]: list(r["node_ids"]) for r in built.collect()}
    stops = defaultdict(list)
    for r in graph.tour_stops(paths, n).orderBy("place").collect():
        stops[r["step"], r["title"]].append(r["id"])
    assert stops == {(r["step"], r["title"]): list(r["node_ids"]) for r in graph.tour(paths, built).collect()}
