"""Small projects in three languages, from text to tables and paths."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldtrail.functions.extractors import EXTRACTORS
from fieldtrail.jobs.run import run
from fieldtrail.operators import detect, discover, graph, orm, sqlrefs, symbols, trace
from fieldtrail.sources import corpus

CONTROLLER = """package c;
@RestController
public class BookController {
    private final BookService service;
    public BookController(BookService service) { this.service = service; }
    @GetMapping("/b({x})")
    public Book byShelf(String shelfNo) {
        return service.load(shelfNo);
    }
}
"""
SERVICE = """package s;
// shelfNo in a comment
@Service
public class BookService extends Base<Book> {
    private BookMapper mapper, other;
    public Book load(String shelfNo) {
        String brace = "} {";
        helper();
        return this.mapper.selectByShelf(shelfNo);
    }
    void helper() { super.audit(); new Book(); x().y(); }
}
class Base<T> {
    protected void audit() { }
}
"""
MAPPER = """package m;
public interface BookMapper {
    @Select("select * from t_shelf " + "where shelf_no = #{shelfNo}")
    Shelf shelf(String shelfNo);
    Book selectByShelf(String shelfNo);
}
"""
XML = """<mapper namespace="m.BookMapper"><select id="selectByShelf">select * from t_book where shelf_no = #{shelfNo}</select>
<update id='lost'>update t_gone set a = 1</update></mapper>"""
FILES = [("j", "j/controller/BookController.java", CONTROLLER), ("j", "j/service/BookService.java", SERVICE), ("j", "j/mapper/BookMapper.java", MAPPER), ("j", "j/res/mapper/BookMapper.xml", XML), ("j", "j/pom.xml", "<p/>")]


def files_of(spark, rows):
    df = spark.createDataFrame(rows, "repo string, path string, text string")
    return corpus.corpus_from_table(df, F.col("repo"), F.col("path"), F.col("text"))


def test_java_symbols():
    s = EXTRACTORS[".java"](SERVICE)
    assert [(m[0], m[3], m[4], m[5]) for m in s.methods] == [("BookService.load", 6, 10, {"shelfNo": "String"}), ("BookService.helper", 11, 11, {}), ("Base.audit", 14, 14, {})]
    assert s.fields == [("BookService", "mapper", "BookMapper"), ("BookService", "other", "BookMapper")]
    assert [x for x in s.supertypes if x[1]] == [("BookService", "Base<Book>")]
    assert [c[:3] for c in s.calls] == [("BookService.load", "helper", None), ("BookService.load", "selectByShelf", "mapper"), ("BookService.helper", "audit", "super"), ("BookService.helper", "x", None), ("BookService.helper", "y", None)]


def test_java_constructor_annotations_and_interfaces():
    c = EXTRACTORS[".java"](CONTROLLER)
    assert [(m[0], m[3], m[4]) for m in c.methods] == [("BookController.BookController", 5, 5), ("BookController.byShelf", 6, 9)]
    m = EXTRACTORS[".java"](MAPPER)
    assert [x[0] for x in m.methods] == ["BookMapper.shelf", "BookMapper.selectByShelf"]


def test_python_symbols():
    s = EXTRACTORS[".py"]("class A(b.Base):\n    x = 1\n    _y = 2\n    def f(self, p: Repo, q=1, *, r: int = 2):\n        p.go()\n        self.repo.run(q)\n        def inner():\n            deep()\n\ndef g(a):\n    return A().z()\n")
    assert [(m[0], m[3], m[4], m[5]) for m in s.methods] == [("A.f", 4, 8, {"p": "Repo", "q": ""}), ("g", 10, 11, {"a": ""})]
    assert s.fields == [("A", "x", "")] and ("A", "Base") in s.supertypes
    assert set(s.calls) == {("A.f", "go", "p", 5), ("A.f", "run", "repo", 6), ("A.f", "deep", None, 8), ("g", "A", None, 11), ("g", "z", None, 11)}
    assert EXTRACTORS[".py"]("def (").methods == []


def test_csharp_symbols():
    s = EXTRACTORS[".cs"]('namespace N {\n[Table("t")]\npublic class A : B<int>, N.I {\n  private readonly Repo repo;\n  public string P { get; set; } = "x";\n  public A(Repo r) { repo = r; }\n  [HttpGet("{id}")]\n  public int Get(string id) => repo.Find(id).Count();\n}\n}\n')
    assert [(m[0], m[3], m[4], m[5]) for m in s.methods] == [("A.Get", 7, 8, {"id": "string"})]
    assert s.fields == [("A", "repo", "Repo")] and [x[1] for x in s.supertypes if x[1]] == ["B", "I"]
    assert [c[1:3] for c in s.calls] == [("Find", "repo"), ("Count", None)]


def test_whole_run(spark):
    r = run(files_of(spark, FILES), spark.createDataFrame([("shelfNo",), ("absent",)], "keyword string"), root_depth=1)
    edges = {(e["src"], e["dst"], e["kind"]) for e in r["edges"].collect()}
    assert edges == {
        ("BookController.byShelf", "BookService.load", "call"), ("BookService.load", "BookMapper.selectByShelf", "call"), ("BookService.load", "BookService.helper", "call"), ("BookService.helper", "Base.audit", "call"),
        ("BookMapper.selectByShelf", "table:t_book", "references"), ("BookMapper.shelf", "table:t_shelf", "references"),
    }
    paths = [p["nodes"] for p in r["main_paths"].orderBy("rank").collect()]
    assert paths[0] == ["BookController.byShelf", "BookService.load", "BookMapper.selectByShelf", "table:t_book"] and ["BookMapper.shelf", "table:t_shelf"] in paths
    lost = r["statements"].filter("NOT linked").collect()
    assert [(s["statement_id"], s["skip_reason"]) for s in lost] == [("BookMapper.lost", "not in traced call chain")]
    assert {(t["table"], t["status"]) for t in r["table_report"].collect()} == {("t_book", "linked"), ("t_shelf", "linked"), ("t_gone", "candidate")}
    counts = r["counts"].first()
    assert (counts["nodes"], counts["edges"], counts["tables"]) == (8, 6, 2)
    assert r["usages"].filter("keyword = 'absent'").count() == 0


def test_no_hit_gives_empty_tables(spark):
    r = run(files_of(spark, FILES), spark.createDataFrame([("absent",)], "keyword string"), profile="java-spring")
    assert all(r[k].count() == 0 for k in ("usages", "nodes", "edges", "main_paths", "tour", "counts"))


def test_profiles(spark):
    rows = [*FILES, ("p", "p/a.py", "import SQLAlchemy"), ("p", "p/b.py", ""), ("p", "p/A.java", ""), ("c", "c/A.cs", "x"), ("n", "n/readme", "")]
    got = {r["repo"]: r["profile"] for r in detect.detect_profiles(files_of(spark, rows), 1).collect()}
    assert got == {"j": "java-spring", "p": "python-sqlalchemy", "c": "csharp-generic", "n": "java-generic"}


def test_refresh_extracts_changed_files_only(spark):
    files = files_of(spark, FILES)
    old = symbols.extract_symbols(files)
    changed = files_of(spark, [*FILES[:2], ("j", FILES[2][1], "interface Other { void a(); }")])
    parts = symbols.diff_manifest(changed, old["manifest"])
    assert {k: v.count() for k, v in parts.items()} == {"unchanged": 2, "changed": 1, "removed": 0}
    fresh = symbols.refresh_symbols(changed, old)
    assert {r["qual"] for r in fresh["methods"].filter("file LIKE '%Mapper%'").collect()} == {"Other.a"}
    assert symbols.diff_manifest(changed, old["manifest"], same_version=False)["changed"].count() == 3


def test_symbols_and_graph_round_trip(spark, tmp_path):
    s = symbols.extract_symbols(files_of(spark, FILES))
    corpus.write_symbols(s, str(tmp_path / "s"))
    back = corpus.read_symbols(spark, str(tmp_path / "s"))
    assert {k: v.count() for k, v in back.items()} == {k: v.count() for k, v in s.items()}
    nodes, edges = spark.createDataFrame([("a", 1)], "id string, ord int"), spark.createDataFrame([("a", "b")], "src string, dst string")
    corpus.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = corpus.read_graph(spark, str(tmp_path / "g"), "id string, ord int", "src string, dst string")
    assert n.collect() == nodes.collect() and e.collect() == edges.collect()


def test_read_corpus(spark, tmp_path):
    (tmp_path / "r1/src").mkdir(parents=True)
    (tmp_path / "r1/target").mkdir()
    (tmp_path / "r1/src/A.java").write_bytes(b"a\r\nb\xff")
    (tmp_path / "r1/src/B.java").write_bytes(b"a\x00b")
    (tmp_path / "r1/target/C.java").write_bytes(b"c")
    got = corpus.read_corpus(spark, str(tmp_path), [".java"], ["target"]).collect()
    assert [(r["repo"], r["path"], r["text"], r["ext"]) for r in got] == [("r1", "r1/src/A.java", "a\nb�", ".java")]


@pytest.mark.parametrize("glob, path, fits", [("**/mapper/**/*.xml", "a/mapper/x.xml", True), ("**/mapper/**/*.xml", "mapper/b/c.xml", True), ("**/*Mapper*.xml", "XMapper2.xml", True), ("*.sql", "a/b.sql", False)])
def test_globs(spark, glob, path, fits):
    assert spark.range(1).select(F.lit(path).rlike(corpus.glob_pattern(glob))).first()[0] is fits


def test_orm_statements(spark):
    rows = [
        ("r", "m.py", "class Book(Base):\n    __tablename__ = 'books'\n\nclass Repo:\n    def find_all(self):\n        return query(Book)\n    def other(self):\n        pass\n"),
        ("r", "e.cs", '[Table("t_e")]\nclass Ent { }\nclass Ctx { DbSet<Row> Rows; void GetX(string a) { a.Rows.First(); db.FromSqlRaw("select * from raw_t"); } void SaveY() { } }'),
        ("r", "E.java", '@Entity\n@Table(name = "t_j")\nclass E {}'),
        ("r", "R.java", "interface R extends JpaRepository<E, Long> { E findById(long id); }"),
        ("r", "M.java", "interface M extends BaseMapper<E> { }\n"),
        ("r", "S.java", "class S { M m; void go() { m.selectById(1); } }"),
    ]
    files = files_of(spark, rows)
    s = symbols.extract_symbols(files)
    got = {r["qual"]: (r["op"], r["tables"]) for d in (orm.sqlalchemy_statements(files, s["methods"]), orm.ef_statements(files, s["methods"]), orm.jpa_statements(files)) for r in d.collect()}
    assert got["Repo.find_all"] == ("select", ["books"]) and got["Repo.other"] == ("unknown", ["books"])
    assert got["Ctx.GetX"] == ("select", ["t_e", "Rows", "raw_t"]) and got["R.findById"] == ("select", ["t_j"])
    nodes = spark.createDataFrame([("r", "k", "S.go", "unit", "S.java")], "repo string, keyword string, id string, kind string, file string")
    plus = orm.mybatis_plus_statements(nodes, s, files).collect()
    assert [(p["qual"], p["tables"], p["statement_id"]) for p in plus] == [("S.go", ["t_j"], "M.selectById")]


def test_raw_sql_goes_to_units_by_term(spark):
    files = files_of(spark, [("r", "a.sql", "select * from t_order where store_no = 1"), ("r", "ddl.sql", "create table t_store (a int)"), ("r", "target/x.sql", "select store from y")])
    usage = "array<struct<snippet:string>>"
    nodes = spark.createDataFrame([("r", "k", "A.findByStoreNo", "unit", []), ("r", "k", "A.findByCustomerId", "unit", [])], f"repo string, keyword string, id string, kind string, usages {usage}")
    got = sqlrefs.raw_sql_statements(corpus.select_sql_files(files, skip_dirs=["target"]), nodes).collect()
    assert [(r["qual"], r["tables"]) for r in got] == [("A.findByStoreNo", ["t_order"])]


# ---- Graphs against plain Python ----


def random_graph(seed, n=40, m=110):
    rnd = random.Random(seed)
    nodes = [("r", "k", f"u{i}", "unit", f"C{i % 5}.u{i}", rnd.choice(["Controller", "Service", "Other"]), None, ["x"] if rnd.random() < 0.2 else [], i) for i in range(n)]
    nodes += [("r", "k", f"table:t{i}", "table", f"t{i}", "Table", f"t{i}", [], n + i) for i in range(4)]
    edges = [("r", "k", f"u{rnd.randrange(n)}", f"u{rnd.randrange(n)}", "call", rnd.choice(["confirmed", "inferred"]), i) for i in range(m)]
    edges += [("r", "k", f"u{rnd.randrange(n)}", f"table:t{rnd.randrange(4)}", "references", "confirmed", m + i) for i in range(4)]
    return nodes, edges


def frames(spark, nodes, edges):
    n = spark.createDataFrame(nodes, "repo string, keyword string, id string, kind string, label string, layer string, table string, usages array<string>, ord int")
    return n, spark.createDataFrame(edges, "repo string, keyword string, src string, dst string, kind string, confidence string, ord bigint")


def plain_paths(nodes, edges):
    adjacent = defaultdict(list)
    for e in edges:
        if e[2] != e[3] and e[3] not in adjacent[e[2]]:
            adjacent[e[2]].append(e[3])
    out = {}
    for start in (x[2] for x in nodes):
        queue, seen = [(start, [start])], {start}
        while queue:
            at, path = queue.pop(0)
            if at.startswith("table:") and at != start:
                out[start] = path
                break
            for nxt in adjacent[at] if len(path) <= 12 else ():
                if nxt not in seen:
                    seen.add(nxt)
                    queue.append((nxt, [*path, nxt]))
    return out


def test_shortest_paths(spark):
    nodes, edges = random_graph(5)
    n, e = frames(spark, nodes, edges)
    got = {r["start"]: list(r["path"]) for r in graph.shortest_paths_to_tables(n, graph.normalize_edges(n, e)).collect()}
    assert got == plain_paths(nodes, edges)


def test_cap(spark):
    nodes, edges = random_graph(7)
    n, e = frames(spark, nodes, edges)
    kept, inside, pruned = graph.truncate_graph(n, e, 25)
    keep = []
    refs = {x for d in edges if d[4] == "references" for x in d[2:4]}
    keep += [x[2] for x in nodes if x[3] == "table" or x[2] in refs][:25]
    adjacent = defaultdict(list)
    for d in edges:
        adjacent[d[2]].append(d[3])
    queue, expanded = [x[2] for x in nodes if x[7]], set()
    while queue and len(keep) < 25:
        at = queue.pop(0)
        if at not in expanded:
            expanded.add(at)
            keep += [at] if at not in keep else []
            queue += [x for x in adjacent[at] if x not in expanded]
    keep += [x[2] for x in nodes if x[2] not in keep][: max(0, 25 - len(keep))]
    assert {r["id"] for r in kept.collect()} == set(keep) and pruned.first()["n"] == len(nodes) - 25
    assert all(r["src"] in keep and r["dst"] in keep for r in inside.collect())


def test_reach_is_breadth_first(spark):
    nodes, edges = random_graph(9)
    seeds = spark.createDataFrame([("r", "k", "u1"), ("r", "k", "u2")], "repo string, keyword string, id string")
    calls = frames(spark, nodes, edges)[1].filter("kind = 'call'")
    for direction, step in (("down", lambda d: (d[2], d[3])), ("up", lambda d: (d[3], d[2]))):
        dist, level = {"u1": 0, "u2": 0}, 0
        while level < 3:
            level += 1
            for d in edges:
                a, b = step(d)
                if d[4] == "call" and dist.get(a) == level - 1 and b not in dist:
                    dist[b] = level
        got = {r["id"]: r["dist"] for r in trace.reach(seeds, calls, 3, direction).collect()}
        assert got == dist


def test_main_paths_leave_out_parts_of_taken_ones(spark):
    nodes = [("r", "k", x, "unit", x, "Controller" if x == "a" else "Service", None, [], i) for i, x in enumerate("abc")] + [("r", "k", "table:t", "table", "t", "Table", "t", [], 9)]
    edges = [("r", "k", "a", "b", "call", "confirmed", 0), ("r", "k", "b", "table:t", "references", "confirmed", 1), ("r", "k", "c", "b", "call", "confirmed", 2)]
    got = graph.main_paths(*frames(spark, nodes, edges)).orderBy("rank").collect()
    assert [list(r["nodes"]) for r in got] == [["a", "b", "table:t"], ["c", "b", "table:t"]] and got[0]["table"] == "t"


def test_usages_of_many_are_the_same_on_all_paths(spark):
    """Repeated files repeat their sites, however the words meet the lines."""
    text = "int shelfNo = shelf_no + getShelfNo();\nx // shelfNo\n"
    files = spark.createDataFrame([("r", "a.java", text), ("r", "a.java", text), ("r", "b.java", "shelfNos.add(boxNo);"), ("s", "c.java", None)], "repo string, path string, text string")
    words = spark.createDataFrame([("shelfNo",), ("boxNo",), ("none",)], "keyword string")
    shown = lambda df: sorted(map(tuple, df.select("repo", "file", "line", "col", "occurrence_type", "snippet").collect()))
    one = shown(discover.find_usages(files, "shelfNo"))
    assert len(one) == 2 * 3 + 1
    for most in (10_000, 0):
        many = discover.find_usages_many(files, words, max_broadcast=most)
        assert shown(many.filter("keyword = 'shelfNo'")) == one and many.filter("keyword = 'boxNo'").count() == 1


def test_mapper_forms_of_the_frameworks(spark):
    """Attributes in any order, annotated parameters, qualified names, both quotes; windows without a limit."""
    far = "    # filler\n" * 200
    files = files_of(spark, [
        ("r", "A.java", '@Entity\n@Table(schema = "x", indexes = @Index(columnList = "no"), name = "t_a")\npublic class A {}'),
        ("r", "B.java", 'interface B extends Base, JpaRepository<a.b.A, Long> {\n A findByNo(@Param("no") String no);\n}'),
        ("r", "m.py", f"class M(Base):\n{far}    __tablename__: str = 't_m'\nclass N(Base):\n    __tablename__ = \"t_n\"\n"),
        ("r", "c.cs", '[Table("t_c", Schema = "' + "s" * 400 + '")]\npublic class C { }\nclass D { DbSet<global::App.Models.E>? Es; }'),
        ("r", "x.xml", '<mapper namespace="m.X"><select data-id="no" id=\'over\' note="a > b">select * from t_x</select></mapper>'),
    ])
    assert {(r["cls"], r["table"]) for r in orm.entity_tables(files).collect()} == {("A", "t_a")}
    assert [(r["qual"], r["tables"]) for r in orm.jpa_statements(files).collect()] == [("B.findByNo", ["t_a"])]
    assert {(r["cls"], r["table"]) for r in orm.sqlalchemy_models(files, near=None).collect()} == {("M", "t_m"), ("N", "t_n")}
    assert {r["cls"] for r in orm.sqlalchemy_models(files).collect()} == {"N"}
    assert {(r["cls"], r["table"]) for r in orm.ef_entities(files, near=None).collect()} == {("C", "t_c"), ("E", "Es")}
    assert [(r["qual"], r["tables"]) for r in sqlrefs.mybatis_xml_statements(files).collect()] == [("X.over", ["t_x"])]
