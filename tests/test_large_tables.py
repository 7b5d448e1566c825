"""What plans and operators do with tables much larger than the given ones: work that is done once, rows that do not grow with a group."""

import hashlib
import io
import re
import time
from contextlib import redirect_stdout

import pyarrow as pa
from pyspark.sql import functions as F

from fieldtrail.functions import extractors
from fieldtrail.functions.ranks import joined_md5, numbered, ranked
from fieldtrail.jobs import adapters, queries
from fieldtrail.operators import discover, graph, orm, sqlrefs, symbols

SF = "/root/testdata/sf0.001"


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def statements(spark, rows):
    """Linked statements (qual, file, pos, tables)."""
    df = spark.createDataFrame(rows, "qual string, file string, pos bigint, tables array<string>")
    return df.selectExpr("'r' repo", "'k' keyword", "*", "'select' op", "qual statement_id", "'mybatis_xml' source", "concat('SQL ', qual) sql", "0 source_rank", "true linked")


# ---- Mappers ----


def test_f12_a_mapper_text_is_made_once_and_not_carried_by_its_statements(spark):
    plan = plan_of(sqlrefs.mybatis_xml_statements(adapters.mapper_files(spark, SF)))
    assert plan.count("resultType") == 1
    cut = next(x for x in plan.split("\n\n") if re.search(r"Generate\b.*\n", x) and "posexplode" in x)
    assert not re.search(r"Arguments: .*\[[^\]]*\btext#\d+[^\]]*\], true", cut)


def test_f12_attributes_and_tables_are_as_written(spark):
    xml = """<Mapper namespace='a.b"c'><select id = "x>1">a from `s` . "t" join 'u' on 1 into v.w</select><delete id=''>from no</delete>
      <UPDATE lang="q" id='up'> update\n d.e set a = (select 1 from dual) from f.'g</update></mapper>"""
    files = spark.createDataFrame([("r", "m.xml", xml)], "repo string, path string, text string")
    got = [(r["namespace"], r["method"], r["op"], r["tables"], r["pos"]) for r in sqlrefs.mybatis_xml_statements(files).collect()]
    assert got == [('a.b"c', "x>1", "select", ["t", "u", "w"], 0), ('a.b"c', "up", "update", ["e", "f"], 2)]


# ---- Facts of tables ----


def test_f17_statements_are_sorted_once_and_numbers_order_the_facts(spark):
    rows = [(f"q{i % 7}", f"f{i % 3}", i, ["a", "b"] if i % 2 else ["a"]) for i in range(40)]
    facts = sqlrefs.table_facts(statements(spark, rows))
    assert "struct" not in next(x for x in plan_of(facts).split("\n\n") if "Aggregate" in x)
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    want = {(t, i + 1, q) for t in "ab" for i, q in enumerate(dict.fromkeys(r[0] for r in order if t in r[3]))}
    assert {(r["table"], r["place"], r["value"]) for r in facts.filter("list = 'source_units'").collect()} == want
    only = sqlrefs.table_facts(statements(spark, rows), lists=["source_files", "ops"])
    assert {r["list"] for r in only.collect()} == {"source_files", "ops"}


def test_f17_equal_rows_have_one_number(spark):
    df = spark.createDataFrame([(x, i) for i, x in enumerate([3, None, 1, 3, 1, 2] * 5)], "x int, i int").repartition(7)
    got = ranked(df, ["x"]).groupBy("x").agg(F.min("at").alias("least"), F.max("at").alias("most")).orderBy("least").collect()
    assert [r["x"] for r in got] == [None, 1, 2, 3] and all(r["least"] == r["most"] for r in got)


def test_f1_texts_of_a_group_stream_through_one_hash(spark):
    df = spark.createDataFrame([(g, f"{g}ü{i}") for g, n in (("a", 2500), (None, 3), ("c", 1)) for i in range(n)], "g string, v string").repartition(5)
    got = {r["g"]: r["md5"] for r in joined_md5(numbered(df, ["g"], ["v"]), ["g"], "place", "v", chunk=100).collect()}
    joined = {g: ",".join(sorted(f"{g}ü{i}" for i in range(n))) for g, n in (("a", 2500), ("c", 1))}
    joined[None] = ",".join(f"Noneü{i}" for i in range(3))
    assert got == {g: hashlib.md5(x.encode()).hexdigest() for g, x in joined.items()}


def test_f1_no_array_holds_the_units_of_a_table(spark):
    plan = plan_of(queries.queries()["linked_tables"](spark, SF))
    arrays = [x for x in plan.split("\n\n") if "collect_list" in x]
    assert arrays and not any("source_units" in x and "_chunk" not in x for x in arrays)


def test_f5_only_the_lists_that_are_asked_for_are_worked_out(spark):
    rows = [("q1", "f1", 0, ["a"]), ("q2", "f1", 1, ["a", "b"]), ("q2", "f2", 0, ["b"])]
    nodes = sqlrefs.table_nodes(statements(spark, rows), ["ops", "source_files"])
    assert {r["table"]: (r["op"], r["source_files"]) for r in nodes.collect()} == {"a": ("select", ["f1"]), "b": ("select", ["f1", "f2"])}
    assert "source_units" not in nodes.columns and "sql_snippet" not in nodes.columns


def test_f6_candidates_need_no_facts_of_tables(spark):
    assert "collect_list" not in plan_of(queries.queries()["unlinked_tables"](spark, SF))


def test_f13_linked_statements_have_only_the_columns_asked_for(spark):
    assert set(queries._linked(spark, SF, "op").columns) == {"repo", "keyword", "qual", "tables", "op", "linked", "skip_reason"}


# ---- Symbols ----


def service(methods):
    body = "".join(f"  public Order find{i}(String no, List<Map<String, Item>> rows) {{\n    return dao.load{i}(no);\n  }}\n" for i in range(methods))
    return f"class Svc {{\n  private final Dao dao = make();\n{body}}}\n"


def test_f11_f18_symbols_leave_a_task_in_small_batches(spark):
    text = service(500)
    batch = pa.RecordBatch.from_pylist([{"repo": "r", "path": f"a{i}.java", "ext": ".java", "text": text} for i in range(100)])
    sizes = [b.num_rows for b in symbols._extract(iter([batch]))]
    assert sum(sizes) == 100 * 1002 and max(sizes) < symbols.MOST_ROWS + 1002


def test_f3_parameters_that_come_again_are_read_once():
    before = extractors._typed.cache_info().misses
    found = extractors.EXTRACTORS[".java"](service(400))
    assert [m[5] for m in found.methods] == [{"no": "String", "rows": "List<Map<String,Item>>"}] * 400
    assert extractors._typed.cache_info().misses - before < 10


# ---- Joins ----


def test_f16_annotated_statements_leave_a_task_in_small_batches_and_lines_are_read_on(spark):
    one = '@Select("SELECT * FROM t")\r\n\n // no( \x0b @X  Order find%d(String no);\n'
    text = "interface A {" + "".join(one % i for i in range(3000)) + "}"
    began = time.process_time()
    assert [m for _, _, m in sqlrefs._annotated(text)] == [f"find{i}" for i in range(3000)]
    assert time.process_time() - began < 1
    files = spark.createDataFrame([("r", f"{i}.java", ".java", text) for i in range(20)], "repo string, path string, ext string, text string").coalesce(1)
    assert sqlrefs.mybatis_annotation_statements(files).count() == 60_000


def broadcast_by_guess(df):
    """Joins that send a side to all tasks though nobody asked for it."""
    return len(re.findall(r"Broadcast\w*Join", plan_of(df)))


def test_f10_sql_files_are_not_sent_to_all_tasks(spark):
    files = spark.createDataFrame([("r", "a.sql", "select * from shop_item")], "repo string, path string, text string")
    units = spark.createDataFrame([("r", "k", "A.shopItem", "unit", [])], "repo string, keyword string, id string, kind string, usages array<struct<snippet:string>>")
    found = sqlrefs.raw_sql_statements(files, units)
    joins = [x for x in plan_of(found).split("\n\n") if re.search(r"^\(\d+\) Broadcast\w*Join", x.strip())]
    assert not any("file" in x for x in joins) and [r["file"] for r in found.collect()] == ["a.sql"]


def test_f2_models_and_bodies_are_not_sent_to_all_tasks(spark):
    files = adapters.model_files(spark, SF)
    methods = symbols.extract_symbols(files)["methods"]
    for found in (orm.sqlalchemy_statements(files, methods), orm.ef_statements(files, methods), orm.jpa_statements(files)):
        joins = [x for x in plan_of(found).split("\n\n") if re.search(r"^\(\d+\) Broadcast\w*Join", x.strip())]
        assert not any(re.search(r"cls|file|entity|prop", x) for x in joins)


def test_f7_many_keywords_are_not_sent_to_all_tasks(spark):
    files = adapters.java_files(spark, SF)
    keywords = spark.createDataFrame([(f"findPart{i}",) for i in range(50)], "keyword string")
    assert broadcast_by_guess(discover.keyword_lines(files, keywords, max_broadcast=0)) == 2 * broadcast_by_guess(files)  # lines are read twice


# ---- Paths ----


def test_f19_f20_edges_are_worked_out_once_for_all_steps_of_a_search(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def order(i):
        seen.add(1)
        return i

    nodes = spark.createDataFrame([(f"n{i}", "unit", f"n{i}", "Service", None, i) for i in range(8)] + [("t", "table", "t", "Table", "t", 99)], "id string, kind string, label string, layer string, table string, ord bigint")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}" if i < 7 else "t", i) for i in range(8)], "src string, dst string, i bigint").select("src", "dst", order("i").alias("ord"))
    one = lambda df: df.selectExpr("'r' repo", "'k' keyword", "*")
    paths = graph.main_paths(one(nodes), one(edges)).collect()
    assert [r["nodes"] for r in paths] == [[f"n{i}" for i in range(8)] + ["t"]] and seen.value == 8
