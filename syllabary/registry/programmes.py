"""Degree derivation on paths that Spark derives from orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabary.plans import degrees as D
from syllabary.plans import path_dictionary
from syllabary.registry.base import ORACLE, add
from syllabary.registry.star import table
from syllabary.session import fresh_folder
from syllabary.sources.writers import degree_counts
from syllabary.store import Store

# One row per order with the parts its path is made of, in SQL that Spark and DuckDB read alike. Every
# fortieth customer's segment is misspelt by a trailing S.
BASE = """
    SELECT o_orderkey AS module_id, c_custkey, concat('0', n_regionkey) AS fac, concat('Faculty ', n_regionkey) AS faculty,
           o_orderpriority AS pri, o_orderstatus AS st, year(o_orderdate) AS y,
           concat(c_mktsegment, CASE WHEN c_custkey % 40 = 0 THEN 'S' ELSE '' END) AS seg, c_mktsegment AS subject0
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"""


def module_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from syllabary.registry.star import _bind

    base = spark.sql(_bind(BASE), **{n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation")})
    seg = F.col("seg")

    def nodes(*parts):
        return F.array(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    def text(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    tail = (
        F.when(F.col("pri") == "1-URGENT", nodes("Institut X", text("B.A. ", seg), "2. Fachsemester", "Pflichtmodule"))
        .when(F.col("pri") == "2-HIGH", nodes("Seminar Y", text(seg, ", Lehramt"), "Staatsexamen Lehramt an Gymnasien"))
        .when(F.col("pri") == "3-MEDIUM", nodes("Bachelor", seg, "1. Semester"))
        .when(F.col("pri") == "4-NOT SPECIFIED", nodes("Wahlfächer 60 LP", text("Wahlfach ", seg, " 60 LP"), "Module"))
        .when(F.col("st") == "F", nodes("Institut X"))
        .when(F.col("st") == "O", nodes("Erasmus Programm", "Module"))
        .otherwise(nodes(seg, "3. Semester"))
    )
    head = nodes("Root", text("WiSe ", F.col("y").cast("string")), text(F.col("fac"), " - ", F.col("faculty")))
    return base.select("module_id", "faculty", F.concat(head, tail).alias("path"))


PARTS = f"""WITH b AS (SELECT *, CASE WHEN pri = '1-URGENT' THEN concat(seg, ' (B.A.)') WHEN pri = '2-HIGH' THEN concat(seg, ' (Lehramt, Gymnasium)')
        WHEN pri = '3-MEDIUM' THEN concat(seg, ' (Bachelor)') WHEN pri = '4-NOT SPECIFIED' THEN concat(seg, ' (Wahlfach, 60 LP)')
        WHEN st = 'F' THEN '' WHEN st = 'O' THEN 'Erasmus Programm' ELSE seg END AS name,
    CASE WHEN pri <> '5-LOW' THEN 'studiengang' WHEN st = 'F' THEN 'unklar' WHEN st = 'O' THEN 'austausch' ELSE 'studiengang' END AS kind,
    CASE WHEN pri IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED') THEN 'high' WHEN pri = '3-MEDIUM' THEN 'medium'
         WHEN st = 'F' THEN 'none' WHEN st = 'O' THEN 'high' ELSE 'low' END AS confidence,
    CASE WHEN pri IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED') THEN 4 WHEN pri = '3-MEDIUM' THEN 4 WHEN st = 'F' THEN -1 ELSE 3 END AS raw_index,
    CASE WHEN pri = '1-URGENT' THEN 'B.A.' WHEN pri = '2-HIGH' THEN 'Lehramt' WHEN pri = '3-MEDIUM' THEN 'Bachelor'
         WHEN pri = '4-NOT SPECIFIED' THEN 'Wahlfach' END AS degree,
    CASE WHEN pri IN ('1-URGENT', '3-MEDIUM') THEN 'Bachelor' WHEN pri = '2-HIGH' THEN 'Lehramt' WHEN pri = '4-NOT SPECIFIED' THEN 'Wahlfach' END AS category
    FROM ({BASE})) """


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.programmes(module_paths(spark, sf_dir).select("module_id", "path"))


add(
    "deg_extract",
    lambda spark, d: found(spark, d).select("module_id", "kind", "name", "faculty", "confidence", F.coalesce("raw_index", F.lit(-1)).alias("raw_index"), "degree"),
    PARTS + "SELECT module_id, kind, name, faculty, confidence, raw_index, degree FROM b",
)
add(
    "deg_clean_path",
    lambda spark, d: module_paths(spark, d).select("module_id", F.array_join(F.transform(D.clean_path(F.col("path")), lambda x: x["pos"].cast("string")), ",").alias("kept")),
    PARTS + """SELECT module_id, CASE WHEN pri = '1-URGENT' THEN '2,3,4,5,6' WHEN pri IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') THEN '2,3,4,5'
               WHEN st = 'F' THEN '2,3' ELSE '2,3,4' END AS kept FROM b""",
)
add(
    "deg_detect",
    lambda spark, d: module_paths(spark, d).select("module_id", F.explode("path").alias("node")).groupBy(D.detect_degree(F.col("node")).alias("degree"), D.detect_school(F.col("node")).alias("school")).agg(F.count(F.lit(1)).alias("n")).where("degree is not null or school is not null"),
    PARTS + """SELECT 'B.A.' AS degree, CAST(NULL AS VARCHAR) AS school, count(*) AS n FROM b WHERE pri = '1-URGENT'
               UNION ALL SELECT 'Lehramt', NULL, count(*) FROM b WHERE pri = '2-HIGH' UNION ALL SELECT 'Lehramt', 'Gymnasium', count(*) FROM b WHERE pri = '2-HIGH'
               UNION ALL SELECT 'Bachelor', NULL, count(*) FROM b WHERE pri = '3-MEDIUM'
               UNION ALL SELECT 'Wahlfach', NULL, 2 * count(*) FROM b WHERE pri = '4-NOT SPECIFIED'""",
)
add(
    "deg_subject", lambda spark, d: found(spark, d).where("kind = 'studiengang'").select("module_id", "subject"),
    PARTS + "SELECT module_id, seg AS subject FROM b WHERE kind = 'studiengang'",
)
add(
    "deg_name",
    lambda spark, d: found(spark, d).where("kind = 'studiengang'").select("module_id", D.display_name(F.col("subject"), F.col("degree"), F.col("school_type"), F.col("ects"), F.col("version")).alias("name")),
    PARTS + "SELECT module_id, name FROM b WHERE kind = 'studiengang'",
)
add(
    "deg_dedup", lambda spark, d: found(spark, d).groupBy("kind", "faculty", "name").agg(F.count(F.lit(1)).alias("n")),
    PARTS + "SELECT kind, faculty, name, count(*) AS n FROM b GROUP BY 1, 2, 3",
)
HARMONISED = """, h AS (SELECT *, CASE WHEN category = 'Bachelor' AND max(CASE WHEN degree = 'B.A.' THEN 1 ELSE 0 END) OVER (PARTITION BY faculty, seg, category) = 1
    THEN 'B.A.' ELSE degree END AS best FROM b WHERE kind = 'studiengang') """
add(
    "deg_harmonise_degree",
    lambda spark, d: D.best_degrees(found(spark, d).where("kind = 'studiengang'")).select("k_faculty", "k_subject", "k_category", "best_degree"),
    PARTS + HARMONISED + "SELECT DISTINCT faculty AS k_faculty, lower(seg) AS k_subject, category AS k_category, best AS best_degree FROM h",
)
add("agg_best_degree", lambda spark, d: D.best_degrees(found(spark, d).where("kind = 'studiengang'")).groupBy("best_degree").agg(F.count(F.lit(1)).alias("n")),
    PARTS + HARMONISED + "SELECT best AS best_degree, count(*) AS n FROM (SELECT DISTINCT faculty, seg, category, best FROM h) GROUP BY 1")
add(
    "agg_subject_freq", lambda spark, d: D.subject_counts(found(spark, d).where("kind = 'studiengang'")),
    PARTS + "SELECT faculty, category, seg AS subject, count(*) AS n FROM b WHERE kind = 'studiengang' GROUP BY 1, 2, 3",
)
# A misspelt segment is less frequent than the right one and 0.94 similar to it.
add(
    "deg_canonical_subject", lambda spark, d: D.canonical_subjects(D.subject_counts(found(spark, d).where("kind = 'studiengang'"))),
    PARTS + """, c AS (SELECT faculty, category, subject0, seg, count(*) AS n FROM b WHERE kind = 'studiengang' GROUP BY 1, 2, 3, 4)
        SELECT faculty, category, seg AS subject, first_value(seg) OVER (PARTITION BY faculty, category, subject0 ORDER BY n DESC, seg) AS canonical FROM c""",
)
add(
    "s_fuzzy_ratio",
    lambda spark, d: D.similar_spellings(D.subject_counts(found(spark, d).where("kind = 'studiengang'"))).select(
        "faculty", "category", "later", "earlier", F.round(D.spelling_ratio("later", "earlier"), 6).alias("ratio")),
    PARTS + """, c AS (SELECT faculty, category, subject0, seg, count(*) AS n FROM b WHERE kind = 'studiengang' GROUP BY 1, 2, 3, 4)
        SELECT x.faculty, x.category, lower(x.seg) AS later, lower(y.seg) AS earlier,
               round(2.0 * least(length(x.seg), length(y.seg)) / (length(x.seg) + length(y.seg)), 6)::DOUBLE AS ratio
        FROM c x JOIN c y ON x.faculty = y.faculty AND x.category IS NOT DISTINCT FROM y.category AND x.subject0 = y.subject0 AND x.seg <> y.seg
             AND (y.n > x.n OR y.n = x.n AND y.seg < x.seg)""",
)


def _store(spark: SparkSession, sf_dir: str) -> Store:
    paths = module_paths(spark, sf_dir)
    module = paths.select(F.col("module_id").alias("id"), F.lit("").alias("number"))
    faculty = paths.select(F.element_at("path", 3).alias("name")).distinct().select(
        F.substring("name", 1, 2).cast("int").alias("id"), "name", F.substring("name", 1, 2).cast("int").alias("prefix")
    )
    return Store({"module": module, "faculty": faculty, "module_path": paths.select("module_id", "path")})


LINKED = HARMONISED + """, k AS (SELECT h.*, first_value(seg) OVER (PARTITION BY faculty, CASE WHEN best = 'B.A.' THEN 'Bachelor' ELSE best END, subject0
        ORDER BY n DESC, seg) AS canon FROM (SELECT h.*, count(*) OVER (PARTITION BY faculty, category, seg) AS n FROM h) h),
    named AS (SELECT *, CASE WHEN best IN ('B.A.', 'Bachelor') THEN concat(canon, ' (', best, ')') WHEN best = 'Lehramt' THEN concat(canon, ' (Lehramt, Gymnasium)')
        WHEN best = 'Wahlfach' THEN concat(canon, ' (Wahlfach, 60 LP)') ELSE canon END AS final FROM k) """


def _links(spark: SparkSession, sf_dir: str, dictionary: DataFrame | None = None) -> DataFrame:
    degree, links = D.derive_degrees(_store(spark, sf_dir), dictionary)
    return links.join(degree.select(F.col("id").alias("degree_id"), "name", "faculty_id"), "degree_id").select("module_id", "name", "faculty_id")


add("deg_link", _links, PARTS + LINKED + "SELECT module_id, final AS name, CAST(fac AS INT) AS faculty_id FROM named")


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of read paths after a load of the years before 1995 and one of all years."""
    paths, folder = module_paths(spark, sf_dir), fresh_folder(spark)
    path_dictionary.refreshed(paths.where("path[1] < 'WiSe 1995'"), folder)
    return path_dictionary.refreshed(paths, folder)


add("deg_link_known", lambda spark, d: _links(spark, d, _dictionary(spark, d)), ORACLE["deg_link"])
add("deg_dictionary", lambda spark, d: _dictionary(spark, d).select("programme.kind", "programme.name", "programme.faculty").groupBy("kind", "name", "faculty").agg(F.count(F.lit(1)).alias("n_paths")),
    PARTS + "SELECT kind, name, faculty, count(DISTINCT (y, pri, CASE WHEN pri = '5-LOW' THEN st END)) AS n_paths FROM b GROUP BY 1, 2, 3")
add("deg_faculty", lambda spark, d: D.derive_degrees(_store(spark, d))[0].groupBy("faculty_id").agg(F.count(F.lit(1)).alias("n")),
    PARTS + LINKED + "SELECT CAST(fac AS INT) AS faculty_id, count(DISTINCT final) AS n FROM named GROUP BY 1")


def _faculty_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that resolve by prefix and name, by prefix, by name and by caseless name."""
    store = _store(spark, sf_dir)
    rows = store["module_path"].select(
        "module_id", F.when(F.col("module_id") % 4 < 2, F.substring(F.element_at("path", 3), 1, 2).cast("int")).alias("prefix"),
        F.when(F.col("module_id") % 4 == 1, "Else").when(F.col("module_id") % 4 == 3, F.upper(D.strip_faculty(F.element_at("path", 3)))).otherwise(D.strip_faculty(F.element_at("path", 3))).alias("faculty"),
    )
    return D.resolve_faculty(rows, store["faculty"]).select("module_id", "faculty_id")


add("join_faculty_resolve", _faculty_resolve, PARTS + "SELECT module_id, CAST(fac AS INT) AS faculty_id FROM b")


def _prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived degrees next to outdated ones that no module is linked to any more."""
    degree, links = D.derive_degrees(_store(spark, sf_dir))
    outdated = degree.withColumns({"id": F.concat("id", F.lit("-old")), "name": F.concat(F.lit("old "), "name")})
    return D.prune_degrees(degree.unionByName(outdated), links).select("name", "faculty_id")


add("deg_prune", _prune, PARTS + LINKED + "SELECT DISTINCT final AS name, CAST(fac AS INT) AS faculty_id FROM named")
for _name, _column in (("kinds", "kind"), ("confidence", "confidence")):
    add(
        f"deg_report_{_name}", lambda spark, d, n=_name: D.degree_report(found(spark, d))[n],
        PARTS + f"SELECT {_column}, count(*) AS n FROM b GROUP BY 1",
    )
add(
    "deg_report", lambda spark, d: D.degree_report(found(spark, d))["low"],
    PARTS + "SELECT faculty, seg AS raw_label, name, 'fallback-erster-knoten' AS rule, count(*) AS n FROM b WHERE confidence = 'low' GROUP BY 1, 2, 3, 4",
)
add(
    "agg_distinct_programs", lambda spark, d: D.degree_report(found(spark, d))["programmes_per_faculty"],
    PARTS + "SELECT faculty, count(DISTINCT name) AS n FROM b WHERE kind = 'studiengang' GROUP BY 1",
)


def _loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as modules: all their orders' paths against the paths of the first order only."""
    paths = module_paths(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("module_id"), "o_custkey"), "module_id")
    kept = paths.groupBy("o_custkey").agg(F.min_by("path", "module_id").alias("path"))
    return D.lost_degrees(paths.select(F.col("o_custkey").alias("m"), "path"), kept.select(F.col("o_custkey").alias("m"), "path"), key="m")


add(
    "deg_loss", _loss,
    PARTS + """, k AS (SELECT c_custkey AS m, count(DISTINCT name) FILTER (WHERE kind = 'studiengang') AS found,
        CASE WHEN arg_min(kind, module_id) = 'studiengang' THEN 1 ELSE 0 END AS stored FROM b GROUP BY 1)
        SELECT m, found, CAST(stored AS BIGINT) AS stored FROM k WHERE found > stored""",
)
add(
    "export_degree_csv", lambda spark, d: degree_counts(found(spark, d)).select("kind", "faculty", "name", "degree", "confidence", F.col("n_modules")),
    PARTS + "SELECT kind, faculty, name, coalesce(degree, '') AS degree, confidence, count(*) AS n_modules FROM b GROUP BY ALL",
)
