"""The given tables seen as source corpora, graphs, spans, classes and generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrail.sources.corpus import corpus_from_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores. A small file has one row group, which is one task; tables of more parts than twice the cores stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > 2 * cores else df.repartition(4 * cores)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: repo = lang, path = source/doc<id>.txt."""
    path = F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return corpus_from_table(spread(table(spark, sf_dir, "documents")), F.col("lang"), path, F.col("text"))


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as units, layered by size; each brand is a table."""
    part = table(spark, sf_dir, "part")
    layer = F.when(F.col("p_size") <= 10, "Controller").when(F.col("p_size") <= 25, "Service").when(F.col("p_size") <= 40, "Repository").otherwise("Other")
    key = F.col("p_partkey").cast("string")
    units = part.select(
        F.lit("parts").alias("repo"), F.lit("part").alias("keyword"), F.concat(F.lit("P"), key).alias("id"), F.lit("unit").alias("kind"), F.concat("p_brand", F.lit("."), key).alias("label"),
        layer.alias("layer"), F.lit(None).cast("string").alias("table"), F.lit(None).cast("string").alias("op"),
        F.when(F.col("p_size") % 7 == 0, F.array(key)).otherwise(F.array().cast("array<string>")).alias("usages"), F.col("p_partkey").alias("ord"),
    )
    brands = part.select("p_brand").distinct()
    tables = brands.select(
        F.lit("parts").alias("repo"), F.lit("part").alias("keyword"), F.concat(F.lit("table:"), "p_brand").alias("id"), F.lit("table").alias("kind"), F.col("p_brand").alias("label"), F.lit("Table").alias("layer"),
        F.col("p_brand").alias("table"), F.lit("select").alias("op"), F.array().cast("array<string>").alias("usages"), (F.lit(10_000_000_000) + F.crc32("p_brand")).alias("ord"),
    )
    return units.unionByName(tables)


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls from each line of an order to the next line's part, and references from the parts of the repository layer to their brand."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("next", F.lead("l_partkey").over(line)).filter("next IS NOT NULL")
    part_id = lambda c: F.concat(F.lit("P"), F.col(c).cast("string"))
    common = [F.lit("parts").alias("repo"), F.lit("part").alias("keyword")]
    calls = rows.select(*common, part_id("l_partkey").alias("src"), part_id("next").alias("dst"), F.lit("call").alias("kind"), F.when(F.col("l_linenumber") % 5 == 0, "inferred").otherwise("confirmed").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    refs = table(spark, sf_dir, "part").filter("p_size > 25 AND p_size <= 40").select(*common, part_id("p_partkey").alias("src"), F.concat(F.lit("table:"), "p_brand").alias("dst"), F.lit("references").alias("kind"), F.lit("confirmed").alias("confidence"), (F.lit(100_000_000_000) + F.col("p_partkey")).alias("ord"))
    return calls.unionByName(refs)


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls alone, distinct: (repo, src, dst)."""
    return part_edges(spark, sf_dir).filter("kind = 'call' AND src <> dst").select("repo", "src", "dst").distinct()


def span_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as methods of a file per brand, spanning lines from the part's key on."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.lit("parts").alias("repo"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("ord"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("qual"),
        F.col("p_partkey").alias("start_line"), (F.col("p_partkey") + 10 * F.col("p_size")).alias("end_line"),
    )


def span_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as usage sites: the part's brand is the file, its key the line, the line number the column."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("l_returnflag") == "R", "definition").otherwise("identifier")
    return rows.select(F.lit("parts").alias("repo"), F.lit("part").alias("keyword"), F.col("p_brand").alias("file"), F.col("l_partkey").alias("line"), F.col("l_linenumber").alias("col"), kind.alias("occurrence_type"), F.col("l_linestatus").alias("snippet")).distinct()


def class_symbols(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Suppliers as classes below the one with half their number; each has methods named by numbers modulo 7 and 3, a typed field, and order lines as calls."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    name = lambda c: F.concat(F.lit("C"), c.cast("string"))
    k = F.col("s_suppkey")
    base = [F.lit("r").alias("repo"), name(k).alias("file")]
    sizes = [(0, F.concat(F.lit("m"), (k % 7).cast("string"))), (1, F.concat(F.lit("n"), (k % 3).cast("string")))]
    methods = None
    for ord_, m in sizes:
        part = s.select(*base, F.lit(ord_).alias("ord"), F.concat(name(k), F.lit("."), m).alias("qual"), m.alias("name"), name(k).alias("cls"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.create_map(F.lit("p"), name(F.greatest(k - 1, F.lit(1)))).alias("params"))
        methods = part if methods is None else methods.unionByName(part)
    fields = s.select(*base, F.lit(0).alias("ord"), name(k).alias("cls"), F.lit("f").alias("name"), F.concat(F.lit("x.y."), name(k + 1), F.lit("<T>")).alias("type"))
    inheritance = s.filter("s_suppkey >= 1").select(*base, F.lit(0).alias("ord"), name(k).alias("cls"), F.concat(F.lit("pkg."), name(F.floor(k / 2))).alias("parent"))
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber")
    sup = F.col("l_suppkey")
    receiver = F.when(F.col("l_linenumber") == 1, F.lit(None)).when(F.col("l_linenumber") == 2, "this").when(F.col("l_linenumber") == 3, "super").when(F.col("l_linenumber") == 4, "f").when(F.col("l_linenumber") == 5, "p").otherwise(name(F.col("l_partkey") % 50 + 1))
    callee = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string"))).otherwise(F.concat(F.lit("n"), (F.col("l_partkey") % 3).cast("string")))
    calls = line.select(F.lit("r").alias("repo"), name(sup).alias("file"), F.lit(0).alias("ord"), F.concat(name(sup), F.lit(".m"), (sup % 7).cast("string")).alias("caller_qual"), callee.alias("callee_name"), receiver.alias("receiver"), F.col("l_linenumber").alias("line"))
    return {"methods": methods, "fields": fields, "inheritance": inheritance, "calls": calls}


def _parts_of_suppliers(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """(l_suppkey, parts) with the keys of each supplier's parts in order, and the columns of ``only`` (l_suppkey, ...), dealt out before texts are made of them."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    parts = parts if only is None else parts.join(only, "l_suppkey")
    return parts.repartition(4 * spark.sparkContext.defaultParallelism, "l_suppkey")


def _each_part(text: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform("parts", text), "")


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Java service per supplier: a field per class it calls, and a method per part with a call and a SQL literal. repo = the supplier's nation."""
    nations = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("l_suppkey")).distinct()

    def method(key: Column) -> Column:
        p, t = key.cast("string"), (key % 10).cast("string")
        return F.concat(
            F.lit("  @Transactional(timeout = 5)\n  public Order findPart"), p, F.lit("(String partNo, List<Map<String, Item>> rows) {\n    // callPart"), p, F.lit("() is gone\n    String sql = \"SELECT * FROM t_part"), t,
            F.lit(" WHERE no = 'a(b'\" + \" AND 1 = 1\";\n    return dao.loadPart"), t, F.lit("(partNo);\n  }\n"),
        )

    key = F.col("l_suppkey").cast("string")
    text = F.concat(F.lit("package a.b;\n@Service\npublic class Svc"), key, F.lit(" extends BaseMapper<Entity"), key, F.lit("> {\n  private final Dao dao = make();\n"), _each_part(method), F.lit("}\n"))
    return corpus_from_table(_parts_of_suppliers(spark, sf_dir, nations), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.concat(F.lit("src/service/Svc"), key, F.lit(".java")), text)


def mapper_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapper XML per supplier: a select of each part's table, and one delete."""
    one = lambda p: F.concat(F.lit('  <select id="find'), p.cast("string"), F.lit('" resultType="x">\n    SELECT * FROM t_part'), (p % 10).cast("string"), F.lit(" p JOIN s.t_supplier s ON 1 = 1\n  </select>\n"))
    key = F.col("l_suppkey").cast("string")
    text = F.concat(F.lit('<mapper namespace="a.b.Map'), key, F.lit("\">\n"), _each_part(one), F.lit("  <delete id='gone'>DELETE FROM dual</delete>\n</mapper>\n"))
    return corpus_from_table(_parts_of_suppliers(spark, sf_dir), F.lit("r"), F.concat(F.lit("res/mapper/Map"), key, F.lit(".xml")), text)


def annotated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Java mapper per supplier, with an annotated select for each part."""
    one = lambda p: F.concat(F.lit('  @Select("SELECT * FROM t_part'), (p % 10).cast("string"), F.lit(' " + "WHERE no = #{no}")\n  Order find'), p.cast("string"), F.lit("(String no);\n"))
    key = F.col("l_suppkey").cast("string")
    return corpus_from_table(_parts_of_suppliers(spark, sf_dir), F.lit("r"), F.concat(F.lit("src/Ann"), key, F.lit(".java")), F.concat(F.lit("public interface Ann"), key, F.lit(" {\n"), _each_part(one), F.lit("}\n")))


def crud_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity, its mapper without methods of its own, and a service that uses it, in one file per part, repo = brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    k, t = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 9).cast("string")
    text = F.concat(
        F.lit('@TableName("t_x'), t, F.lit('")\nclass Ent'), k, F.lit(" {}\ninterface Map"), k, F.lit(" extends BaseMapper<Ent"), k, F.lit("> {}\npublic class Use"), k, F.lit(" {\n  private final Map"), k,
        F.lit(" dao;\n  public void saveIt(String no) {\n    dao.insert(no);\n  }\n}\n"),
    )
    return corpus_from_table(part, F.col("p_brand"), F.concat(F.lit("src/Use"), k, F.lit(".java")), text)


def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python and C# models and their users: one file of each per part, repo = brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    k, t = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 9).cast("string")
    python = F.concat(F.lit("class Model"), k, F.lit("(Base):\n    __tablename__ = 't_model"), t, F.lit("'\n    no = Column(String)\n\n\nclass Repo"), k, F.lit(":\n    def find_it(self, no):\n        return self.session.query(Model"), k, F.lit(").all()\n"))
    csharp = F.concat(F.lit("namespace A {\n[Table(\"t_ent"), t, F.lit("\")]\npublic class Ent"), k, F.lit(" { public string No { get; set; } }\npublic class Use"), k, F.lit(" {\n  private readonly Db db;\n  public Ent"), k, F.lit(" DeleteIt(string no) {\n    return db.Set<Ent"), k, F.lit(">().First(no);\n  }\n}\n}\n"))
    entity = F.concat(F.lit("@Entity\n@Table(name = \"t_row"), t, F.lit("\")\npublic class Row"), k, F.lit(" {}\n"))
    repo = F.concat(F.lit("public interface Rows"), k, F.lit(" extends JpaRepository<Row"), k, F.lit(", Long> {\n  Row"), k, F.lit(" countByNo(String no);\n}\n"))
    rows = [(python, "app/m", ".py"), (csharp, "cs/U", ".cs"), (entity, "java/Row", ".java"), (repo, "java/Rows", ".java")]
    each = part.select("p_brand", F.explode(F.array(*[F.struct(text.alias("text"), F.concat(F.lit(lead), k, F.lit(end)).alias("path")) for text, lead, end in rows])).alias("f"))
    return corpus_from_table(each, F.col("p_brand"), F.col("f.path"), F.col("f.text"))
