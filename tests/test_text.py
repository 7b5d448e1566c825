import random
import re

import pytest
from pyspark.sql import functions as F

from fieldtrail.functions import text as T
from fieldtrail.operators import discover, search
from fieldtrail.profiles import Layer


def values(spark, rows, expr):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").orderBy("i").select(expr(F.col("t"))).collect()]


def test_lines_are_those_of_splitlines(spark):
    rnd = random.Random(0)
    rows = ["".join(rnd.choice("ab\n\r\x0b\x0c\x1c\x85  x ") for _ in range(rnd.randrange(12))) for _ in range(500)]
    assert values(spark, rows, T.lines) == [x.splitlines() for x in rows]


def test_positions_are_those_of_finditer(spark):
    rnd = random.Random(1)
    rows = ["".join(rnd.choice("aab xé") for _ in range(rnd.randrange(20))) for _ in range(500)]
    got = values(spark, rows, lambda t: T.match_positions(t, "a+b?"))
    assert [[(x["col"], x["match"]) for x in r] for r in got] == [[(m.start() + 1, m.group()) for m in re.finditer("a+b?", x)] for x in rows]


def test_code_portion_stops_at_comments_only(spark):
    rows = ['a = "x // y"; // z', "  * doc", "/* c */", "a / b", "'\\'' // q", "x //", "a \\"]
    assert values(spark, rows, T.code_portion) == ['a = "x // y"; ', "", "", "a / b", "'\\'' ", "x ", "a \\"]


def test_keyword_variants(spark):
    got = values(spark, ["storeNo", "id", "status"], T.keyword_variants)
    assert got[0][:2] == ["store_no_list", "store_nos"] and {"storeNo", "store_no", "STORE_NO", "storeno", "store-no", "StoreNo", "storeNos", "StoreNos"} < set(got[0])
    assert "ids" in got[1] and "Statuss" not in got[2]


@pytest.mark.parametrize("text, n", [("IdentityService voidMethod validId identity id", 1), ("int id; Id(id)", 3)])
def test_whole_identifiers_only(spark, text, n):
    files = spark.createDataFrame([("r", "a/X.java", text)], "repo string, path string, text string")
    assert discover.find_usages(files, "id").count() == n


def test_compound_keywords_match_inside_camel_case(spark):
    files = spark.createDataFrame([("r", "x", "getStoreNo queryByNameAndStoreNo storeNos xstoreNo StoreNot")], "repo string, path string, text string")
    sites = discover.find_usages(files, "storeNo")
    assert [r["col"] for r in sites.orderBy("col").collect()] == [4, 26, 34]
    many = discover.find_usages_many(files, spark.createDataFrame([("storeNo",), ("other",)], "keyword string"))
    assert sorted(r["col"] for r in many.collect()) == [4, 26, 34]


def test_occurrence_types(spark):
    rows = ['@storeNo', 'x = "storeNo"', "public void storeNo()", "storeNo = 1"]
    files = spark.createDataFrame([("r", "x", "\n".join(rows))], "repo string, path string, text string")
    assert [r["occurrence_type"] for r in discover.find_usages(files, "storeNo").orderBy("line").collect()] == ["annotation", "string", "definition", "identifier"]


def test_layers_go_by_path_segment_then_text(spark):
    layers = [Layer("Controller", "controller", "@RestController|@Controller"), Layer("Service", "service", "@Service"), Layer("Repository", "(dao|repository)")]
    files = spark.createDataFrame([("common-entry-service/x/dao/A.java", ""), ("x/B.java", "@org.x.RestController class B"), ("service.java", ""), ("x/C.java", "none")], "p string, t string")
    assert [r[0] for r in files.select(discover.classify_layer(F.col("p"), F.col("t"), layers)).collect()] == ["Repository", "Controller", "Service", "Other"]


def test_sql_names_and_operations(spark):
    rows = ["select * from `store` s join a.t_order o on 1 = 1", "UPDATE x SET at = now() on update CURRENT_TIMESTAMP", "delete from dual", "insert into \"T\" values (1)"]
    assert values(spark, rows, T.tables_in_sql) == [["store", "t_order"], ["x"], [], ["T"]]
    assert values(spark, rows, T.op_from_sql) == ["select", "update", "delete", "insert"]
    assert values(spark, ["create  table x", "recreate table"], T.is_ddl) == [True, False]
    assert values(spark, ["findX", "saveX", "patchX", "removeX", "doX"], T.op_from_method) == ["select", "insert", "update", "delete", "unknown"]


def test_literals(spark):
    assert values(spark, ["a\\nb", "a\\\\nb", "\\x", "a\\"], T.unescape_literal) == ["a\nb", "a\\nb", "\\x", "a\\"]
    assert values(spark, ['f("a\\"b", "c")'], T.string_literals) == [['a"b', "c"]]
    assert values(spark, ['"a" + "b"', '"a" + b', "x"], T.concat_literals) == ["ab", None, None]


def test_slug_terms_and_class(spark):
    assert values(spark, ["A b!", "--", "x"], T.slug) == ["a-b", "unknown", "x"]
    assert values(spark, ["findByStoreNo XMLParser"], T.terms) == [["findbystoreno", "parser", "store", "xml", "xmlparser"]]
    assert values(spark, ["a.b.C", "m"], T.class_of) == ["a.b", "m"]


def fuzzy(query, target):
    q, t = query.lower(), target.lower()
    at, run, score = 0, 0, 0
    for ch in q:
        p = t.find(ch, at) + 1
        if not p:
            return None
        follows = at > 0 and p == at + 1
        run = run + 1 if follows else 0
        score += 30 if p == 1 else 15 if not re.match("[0-9a-z_]", t[p - 2]) else 0
        score += 8 + run * 5 if follows else 1
        at = p
    return score + 40 * (q == t) + max(0, 12 - len(t) + len(q)) if q and t else None


def test_fuzzy_score_against_a_plain_loop(spark):
    rnd = random.Random(2)
    rows = [("".join(rnd.choice("abC") for _ in range(rnd.randrange(4))), "".join(rnd.choice("aBc._") for _ in range(rnd.randrange(9)))) for _ in range(300)]
    got = spark.createDataFrame(rows, "q string, t string").select(search.fuzzy_score(F.col("q"), F.col("t"))).collect()
    assert [r[0] for r in got] == [fuzzy(*r) for r in rows]
