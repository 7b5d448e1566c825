"""Profiles from files, and whole runs over small Python and C# projects."""

import json

import pytest
from test_lineage import FILES, files_of

from fieldtrail.jobs.run import run
from fieldtrail.profiles import PROFILES, Layer, load_profile, profile_from

YAML = """
profile: shop
source_exts: ['.java']
layers:
  - {name: Edge, match: "@RestController", path_hint: "controller"}
  - {name: Core, path_hint: "service"}
table_sources:
  jpa: {entity_annotation: "@Entity"}
  mybatis: {mapper_xml_glob: "**/xml/*.xml"}
  raw_sql: ["db/*.sql", "**/more/*.sql"]
  java_sql_literals: false
exclude:
  dirs: [target, gen]
"""


def test_profiles_from_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "shop.yml").write_text(YAML)
    p = load_profile(spark, "shop", str(tmp_path))
    assert p == load_profile(spark, str(tmp_path / "shop.yml"))
    assert (p.name, p.source_exts, p.exclude_dirs, p.table_sources) == ("shop", (".java",), ("target", "gen"), ("jpa", "mybatis", "raw_sql"))
    assert p.layers == (Layer("Edge", "controller", "@RestController"), Layer("Core", "service")) and p.layer_order == ("Edge", "Core", "Table", "Other")
    assert p.mapper_globs == ("**/xml/*.xml",) and p.sql_globs == ("db/*.sql", "**/more/*.sql")
    assert load_profile(spark, "java-spring") is PROFILES["java-spring"]
    (tmp_path / "small.json").write_text(json.dumps({"profile": "small", "source_exts": [".py"], "table_sources": None}))
    assert load_profile(spark, "small", str(tmp_path)) == profile_from({"profile": "small", "source_exts": [".py"]})
    with pytest.raises(FileNotFoundError):
        load_profile(spark, "absent", str(tmp_path))


def test_run_by_a_profile_of_ones_own(spark):
    p = profile_from({"profile": "mine", "source_exts": [".java"], "layers": [{"name": "Edge", "path_hint": "controller"}, {"name": "Core", "path_hint": "service"}], "table_sources": {"mybatis": True}})
    r = run(files_of(spark, FILES), spark.createDataFrame([("shelfNo",)], "keyword string"), profile=p)
    layers = {x["id"]: x["layer"] for x in r["nodes"].collect()}
    assert layers["BookController.byShelf"] == "Edge" and layers["BookService.load"] == "Core" and layers["table:t_book"] == "Table"
    sources = {x["id"]: x["source"] for x in r["method_sources"].collect()}
    assert set(sources) == {k for k in layers if not k.startswith("table:")}
    assert sources["BookService.load"] == FILES[1][2].split("\n", 5)[5].split("    void helper")[0].rstrip("\n")


SHELF_PY = {
    "shop/pyproject.toml": "[project]\n",
    "shop/api/shelf_api.py": "class ShelfApi:\n    def __init__(self, service):\n        self.service = service\n\n    def read(self, shelf_no: str):\n        return self.service.load(shelf_no)\n",
    "shop/models/shelf.py": "from sqlalchemy import Column\n\n\nclass Shelf(Base):\n    __tablename__ = 'shelves'\n    shelf_no = Column(String)\n",
    "shop/services/shelf_service.py": (
        "from models.shelf import Shelf\n\n\nclass ShelfRepository:\n    def find_shelf(self, session, shelf_no):\n        return session.query(Shelf).filter_by(shelf_no=shelf_no).all()\n\n"
        '    def count_shelf(self, session, shelf_no):\n        return session.execute("select count(*) from shelf_log where shelf_no = :shelf_no")\n\n\n'
        "class ShelfService:\n    def load(self, shelf_no):\n        repo: ShelfRepository = self.repo\n        return self.repo.find_shelf(None, shelf_no)\n"
    ),
}
SHELF_CS = {
    "store/Store.csproj": "<Project/>",
    "store/Controllers/ShelfController.cs": "[ApiController]\npublic class ShelfController : ControllerBase {\n  private readonly ShelfService service;\n  [HttpGet]\n  public View Get(string shelfNo) {\n    return service.Load(shelfNo);\n  }\n}\n",
    "store/Services/ShelfService.cs": "public class ShelfService {\n  private readonly ShelfStore store;\n  public View Load(string shelfNo) => store.FindShelf(shelfNo);\n}\n",
    "store/Data/Shelf.cs": 'using Microsoft.EntityFrameworkCore;\n[Table("shelves")]\npublic class Shelf { public string ShelfNo { get; set; } }\n',
    "store/Data/ShelfStore.cs": (
        "public class ShelfStore {\n  private readonly ShopContext db;\n  public Shelf FindShelf(string shelfNo) {\n    return db.Set<Shelf>().First(x => x.ShelfNo == shelfNo);\n  }\n"
        '  public void DeleteShelf(string shelfNo) {\n    db.Run("delete from shelf_log where shelf_no = " + shelfNo);\n  }\n}\n'
    ),
    "store/obj/Junk.cs": "class Junk { void Use(string shelfNo) { } }",
}


def test_python_and_csharp_projects(spark):
    rows = [(p.split("/")[0], p, t) for p, t in {**SHELF_PY, **SHELF_CS}.items()]
    words = spark.createDataFrame([("shelfNo",), ("shelf_no",)], "keyword string")
    r = run(files_of(spark, rows), words, root_depth=1)
    units = {(x["repo"], x["id"]): x["layer"] for x in r["nodes"].filter("kind = 'unit'").collect()}
    assert {k[1]: v for k, v in units.items() if k[0] == "shop"} == {
        "ShelfApi.read": "Controller", "ShelfRepository.find_shelf": "Service", "ShelfRepository.count_shelf": "Service", "ShelfService.load": "Service"
    }
    assert {k[1]: v for k, v in units.items() if k[0] == "store"} == {"ShelfController.Get": "Controller", "ShelfService.Load": "Service", "ShelfStore.FindShelf": "Repository", "ShelfStore.DeleteShelf": "Repository"}
    # a receiver without a known type calls nothing in Python; typed fields do in C#
    calls = {(x["repo"], x["src"], x["dst"]) for x in r["edges"].filter("kind = 'call'").collect()}
    assert calls == {("store", "ShelfController.Get", "ShelfService.Load"), ("store", "ShelfService.Load", "ShelfStore.FindShelf")}
    tables = {(x["repo"], x["keyword"], x["table"], tuple(sorted(x["statement_sources"]))) for x in r["nodes"].filter("kind = 'table'").collect()}
    assert {t for t in tables if t[0] == "shop" and t[1] == "shelf_no"} == {("shop", "shelf_no", "shelves", ("sqlalchemy",)), ("shop", "shelf_no", "shelf_log", ("python_sql_literal",))}
    assert {t for t in tables if t[0] == "store" and t[1] == "shelfNo"} == {("store", "shelfNo", "shelves", ("ef_core",)), ("store", "shelfNo", "shelf_log", ("csharp_sql_literal",))}
    paths = [x["nodes"] for x in r["main_paths"].filter("repo = 'store' AND keyword = 'shelfNo'").orderBy("rank").collect()]
    assert paths[0] == ["ShelfController.Get", "ShelfService.Load", "ShelfStore.FindShelf", "table:shelves"]
    # a place outside a method is a usage, and no unit
    outside = r["usages"].filter("repo = 'shop' AND keyword = 'shelf_no' AND file LIKE '%models%'").collect()
    assert [(x["line"], x["col"]) for x in outside] == [(6, 5)]
    assert r["usages"].filter("file LIKE '%obj%'").count() == 0
