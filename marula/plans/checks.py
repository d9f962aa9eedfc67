"""Queries that validate and describe the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marula.plans.registry import query
from marula.session import table

REQUIRED = ("authors", "title", "pub_year", "source_title", "doi", "affiliations", "author_keywords", "index_keywords", "abstract", "document_type", "cited_by")


@query("WITH r(column_name) AS (VALUES " + ", ".join(f"('{c}')" for c in (*REQUIRED, "funding")) + ") SELECT column_name, column_name IN (SELECT name FROM (DESCRIBE raw_publications) d(name)) AS present FROM r".replace("(DESCRIBE raw_publications) d(name)", "(SELECT column_name AS name FROM (DESCRIBE raw_publications))"))
def required_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Which required columns the raw table has."""
    have = set(table(spark, folder, "raw_publications").columns)
    return spark.createDataFrame([(c, c in have) for c in (*REQUIRED, "funding")], "column_name string, present boolean")


_CHECKS = {
    "rows without identifier": "eid IS NULL",
    "rows without title": "title IS NULL OR trim(title) = ''",
    "years outside the period": "try_cast(pub_year AS DOUBLE) < 2015 OR try_cast(pub_year AS DOUBLE) > 2025",
    "years that are no number": "pub_year IS NOT NULL AND try_cast(pub_year AS DOUBLE) IS NULL",
    "goals that are no number": "try_cast(sdg_number AS INT) IS NULL",
    "files with an unknown name": "NOT regexp_like(source_file, '^SDG[0-9]{2}_')",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) AS n, CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END AS status FROM raw_publications WHERE {v}" for k, v in _CHECKS.items()).replace("regexp_like", "regexp_matches"))
def table_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of rows that break a rule, in one scan."""
    p = table(spark, folder, "raw_publications")
    one = p.agg(*(F.count_if(F.expr(v)).alias(f"c{i}") for i, v in enumerate(_CHECKS.values())))
    pairs = F.array(*(F.struct(F.lit(k).alias("check_name"), F.col(f"c{i}").alias("n")) for i, k in enumerate(_CHECKS)))
    x = one.select(F.explode(pairs).alias("x")).select("x.*")
    return x.withColumn("status", F.when(F.col("n") == 0, "ok").otherwise("warn"))


_NAME = r"^SDG(\d{2})_AF\d+_(\d{4}-\d{2}-\d{2})_(\d{4})-(\d{4})\.csv$"
_RANGES = rf"""f AS (SELECT source_file, try_cast(regexp_extract(source_file, '{_NAME}', 1) AS INT) AS goal, try_cast(regexp_extract(source_file, '{_NAME}', 3) AS INT) AS y1, try_cast(regexp_extract(source_file, '{_NAME}', 4) AS INT) AS y2 FROM (SELECT DISTINCT source_file FROM raw_publications)),
  l AS (SELECT *, lag(y2) OVER (PARTITION BY goal ORDER BY y1, y2, source_file) AS b FROM f)"""


@query(f"""WITH {_RANGES} SELECT 'files' AS check_name, count(*) AS n, '' AS detail, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'warn' END AS status FROM f
  UNION ALL SELECT 'files with an unknown name', count(*), coalesce(string_agg(source_file, ',' ORDER BY source_file), ''), CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END FROM f WHERE goal IS NULL
  UNION ALL SELECT 'goals without a file', count(*), coalesce(string_agg(g::VARCHAR, ',' ORDER BY g), ''), CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END FROM generate_series(1, 17) AS s(g) WHERE g NOT IN (SELECT goal FROM f WHERE goal IS NOT NULL)
  UNION ALL SELECT 'gaps between years', count(*), coalesce(string_agg(source_file, ',' ORDER BY source_file), ''), CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END FROM l WHERE goal IS NOT NULL AND y1 > b + 1
  UNION ALL SELECT 'overlapping years', count(*), coalesce(string_agg(source_file, ',' ORDER BY source_file), ''), CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END FROM l WHERE goal IS NOT NULL AND y1 <= b""")
def export_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with the set of export files: names, goals without any, gaps and overlaps of years. Files are few beside rows."""
    part = lambda k: F.regexp_extract("source_file", _NAME, k).try_cast("int")
    f = table(spark, folder, "raw_publications").select("source_file").distinct().select("source_file", part(1).alias("goal"), part(3).alias("y1"), part(4).alias("y2"))
    before = F.lag("y2").over(Window.partitionBy("goal").orderBy("y1", "y2", "source_file"))
    f = f.withColumn("b", before).withColumn("known", F.col("goal").isNotNull())
    listed = lambda when: F.array_join(F.array_sort(F.collect_list(F.when(when, F.col("source_file")))), ",")
    gap, lap = F.col("known") & (F.col("y1") > F.col("b") + 1), F.col("known") & (F.col("y1") <= F.col("b"))
    missing = F.array_except(F.sequence(F.lit(1), F.lit(17)), F.collect_set("goal"))
    one = f.agg(
        F.count("*").alias("n0"), F.lit("").alias("d0"), F.count_if(~F.col("known")).alias("n1"), listed(~F.col("known")).alias("d1"), F.size(missing).cast("bigint").alias("n2"), F.array_join(missing, ",").alias("d2"),
        F.count_if(gap).alias("n3"), listed(gap).alias("d3"), F.count_if(lap).alias("n4"), listed(lap).alias("d4"),
    )
    names = ("files", "files with an unknown name", "goals without a file", "gaps between years", "overlapping years")
    rows = F.array(*(F.struct(F.lit(k).alias("check_name"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("detail")) for i, k in enumerate(names)))
    out = one.select(F.explode(rows).alias("x")).select("x.*")
    good = F.when(F.col("check_name") == "files", F.col("n") > 0).otherwise(F.col("n") == 0)
    return out.withColumn("status", F.when(good, "ok").otherwise("warn"))


@query("""SELECT 'records' AS stage, 'rows' AS metric, count(*) AS value FROM raw_publications UNION ALL SELECT 'records', 'files', count(DISTINCT source_file) FROM raw_publications
  UNION ALL SELECT 'deduplication', coalesce(match_reason, '(none)'), count(*) FROM dedup_log GROUP BY match_reason UNION ALL SELECT 'overrides', CASE WHEN ror_id IS NULL THEN 'without organisation' ELSE 'with organisation' END, count(*) FROM manual_overrides GROUP BY 2
  UNION ALL SELECT 'thesaurus', rule_type, count(*) FROM thesaurus GROUP BY rule_type""")
def stage_report(spark: SparkSession, folder: str) -> DataFrame:
    """What each stage left, one figure a row; sources.provenance.report makes a text of it."""
    t = lambda name: table(spark, folder, name)
    p = t("raw_publications").agg(F.count("*").alias("rows"), F.countDistinct("source_file").alias("files")).unpivot([], ["rows", "files"], "metric", "value")
    parts = [("records", p)]
    for stage, name, metric in (("deduplication", "dedup_log", F.coalesce("match_reason", F.lit("(none)"))), ("overrides", "manual_overrides", F.when(F.col("ror_id").isNull(), "without organisation").otherwise("with organisation")), ("thesaurus", "thesaurus", F.col("rule_type"))):
        parts.append((stage, t(name).groupBy(metric.alias("metric")).agg(F.count("*").alias("value"))))
    out = None
    for stage, df in parts:
        df = df.select(F.lit(stage).alias("stage"), "metric", "value")
        out = df if out is None else out.unionByName(df)
    return out


@query("SELECT r.row_id, o.override_id FROM raw_publications r JOIN manual_overrides o ON r.affiliations = o.raw_string")
def exact_affiliation_join(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose whole cell is a reviewed string; null never matches null."""
    r = table(spark, folder, "raw_publications").select("row_id", F.col("affiliations").alias("a"))
    return r.join(table(spark, folder, "manual_overrides").select("override_id", F.col("raw_string").alias("a")), "a").select("row_id", "override_id")


@query("SELECT d.doc_id, r.n FROM documents d LEFT JOIN (SELECT eid, count(*) AS n FROM raw_publications GROUP BY 1) r ON r.eid = d.eid")
def left_join_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the number of records of its identifier, null where there is none."""
    n = table(spark, folder, "raw_publications").groupBy("eid").agg(F.count("*").alias("n"))
    return table(spark, folder, "documents").select("doc_id", "eid").join(n, "eid", "left").select("doc_id", "n")


@query("SELECT row_id, 'with document' AS kind FROM raw_publications r WHERE EXISTS (SELECT 1 FROM documents d WHERE d.eid = r.eid) UNION ALL SELECT row_id, 'without' FROM raw_publications r WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.eid = r.eid)")
def semi_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Records with and without a document, by a semi-join and an anti-join."""
    r, d = table(spark, folder, "raw_publications").select("row_id", "eid"), table(spark, folder, "documents").select("eid")
    return r.join(d, "eid", "left_semi").select("row_id", F.lit("with document").alias("kind")).union(r.join(d, "eid", "left_anti").select("row_id", F.lit("without")))


@query("SELECT user_id, event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_events(spark: SparkSession, folder: str) -> DataFrame:
    """The batch twin of the streaming aggregate: events of each user, type and day."""
    return table(spark, folder, "events").groupBy("user_id", "event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
