"""Queries over raw records: clean views, exports, deduplication and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marula.functions import text as T
from marula.operators import graph, measures, records
from marula.plans.dims import SQL_GOALS, goals
from marula.plans.registry import query
from marula.session import checkpoint, table

FILLED = ("eid", "doi", "title", "authors", "pub_year", "affiliations", "author_keywords", "index_keywords", "abstract", "cited_by")


def publications(spark: SparkSession, folder: str) -> DataFrame:
    """raw_publications with cleaned identifiers and typed numbers beside the raw columns."""
    p = table(spark, folder, "raw_publications")
    return p.withColumns(
        {
            "doi_clean": T.normal_doi(F.col("doi")),
            "eid_clean": T.clean_eid(F.col("eid")),
            "title_clean": T.normal_title(F.col("title")),
            "year": T.whole_number(F.col("pub_year")),
            "cites": F.coalesce(F.col("cited_by").try_cast("double"), F.lit(0.0)),
            "n_filled": records.completeness(FILLED),
        }
    )


_FILLED = " + ".join(f"({c} IS NOT NULL)::INT" for c in FILLED)
#: The same view in SQL.
PUBS = rf"""pubs AS (SELECT *,
  CASE WHEN d IN ('', '-', 'none', 'nan', 'n/a', '#name?') THEN NULL ELSE d END AS doi_clean,
  CASE WHEN e IN ('', '-', 'none', 'nan', 'n/a') THEN NULL ELSE e END AS eid_clean,
  trim(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS title_clean,
  try_cast(try_cast(pub_year AS DOUBLE) AS INT) AS year, coalesce(try_cast(cited_by AS DOUBLE), 0) AS cites, {_FILLED} AS n_filled
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(doi), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '^https?://doi\.[a-z]+/', ''), '^doi:\s*', '') AS d,
    regexp_replace(eid, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS e FROM raw_publications))"""


def sql_tags(key: str, rows: str) -> str:
    """A subquery (key, tags): the distinct whole numbers in sdg_number for each key, ascending."""
    return f"""(SELECT {key}, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS tags FROM (SELECT DISTINCT {key}, try_cast(x AS INT) AS t
      FROM {rows}, unnest(string_split(sdg_number, ',')) AS u(x)) WHERE t IS NOT NULL GROUP BY {key})"""


@query(f"WITH {PUBS} SELECT row_id, doi_clean, eid_clean, title_clean, year, cites, n_filled::INT AS n_filled FROM pubs")
def clean_records(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised identifiers and titles, tolerant casts, completeness."""
    return publications(spark, folder).select("row_id", "doi_clean", "eid_clean", "title_clean", "year", "cites", "n_filled")


_FILE = r"^SDG(\d{2})_AF\d+_(\d{4}-\d{2}-\d{2})_(\d{4})-(\d{4})\.csv$"


@query(rf"""SELECT source_file, try_cast(regexp_extract(source_file, '{_FILE}', 1) AS INT) AS goal, try_cast(regexp_extract(source_file, '{_FILE}', 2) AS DATE) AS export_date,
  try_cast(regexp_extract(source_file, '{_FILE}', 3) AS INT) AS first_year, try_cast(regexp_extract(source_file, '{_FILE}', 4) AS INT) AS last_year, count(*) AS n_rows,
  row_number() OVER (PARTITION BY regexp_extract(source_file, '{_FILE}', 1) ORDER BY source_file) AS part,
  count(*) OVER (PARTITION BY regexp_extract(source_file, '{_FILE}', 1)) AS n_parts FROM raw_publications GROUP BY source_file""")
def export_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each export file: values from its name, its rows, and which part of the goal's parts it is."""
    files = table(spark, folder, "raw_publications").groupBy("source_file").agg(F.count("*").alias("n_rows"))
    part = lambda k, kind: F.regexp_extract("source_file", _FILE, k).try_cast(kind)
    w = Window.partitionBy(F.regexp_extract("source_file", _FILE, 1))
    return files.select(
        "source_file", part(1, "int").alias("goal"), part(2, "date").alias("export_date"), part(3, "int").alias("first_year"), part(4, "int").alias("last_year"),
        "n_rows", F.row_number().over(w.orderBy("source_file")).cast("bigint").alias("part"), F.count("*").over(w).alias("n_parts"),
    )


@query(rf"""WITH f AS (SELECT DISTINCT try_cast(regexp_extract(source_file, '{_FILE}', 1) AS INT) AS goal, try_cast(regexp_extract(source_file, '{_FILE}', 3) AS INT) AS y1,
  try_cast(regexp_extract(source_file, '{_FILE}', 4) AS INT) AS y2 FROM raw_publications), r AS (SELECT *, lag(y2) OVER (PARTITION BY goal ORDER BY y1, y2) AS before,
  max(y2) OVER (PARTITION BY goal) AS last FROM f) SELECT goal, y1, y2, CASE WHEN before IS NULL THEN 'first' WHEN y1 > before + 1 THEN 'gap' WHEN y1 <= before THEN 'overlap' ELSE 'ok' END AS link,
  last < 2025 AS short_tail FROM r""")
def range_gap_check(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps and overlaps between the year ranges of one goal's exports, and ranges that end too early."""
    part = lambda k: F.regexp_extract("source_file", _FILE, k).try_cast("int")
    f = table(spark, folder, "raw_publications").select(part(1).alias("goal"), part(3).alias("y1"), part(4).alias("y2")).distinct()
    w = Window.partitionBy("goal")
    before = F.lag("y2").over(w.orderBy("y1", "y2"))
    f = f.withColumn("before", before).withColumn("last", F.max("y2").over(w))
    link = F.when(F.col("before").isNull(), "first").when(F.col("y1") > F.col("before") + 1, "gap").when(F.col("y1") <= F.col("before"), "overlap").otherwise("ok")
    return f.select("goal", "y1", "y2", link.alias("link"), (F.col("last") < 2025).alias("short_tail"))


@query(f"""WITH {SQL_GOALS}, have AS (SELECT DISTINCT try_cast(x AS INT) AS goal, pub_year, document_type FROM raw_publications, unnest(string_split(sdg_number, ',')) AS u(x)), t AS (SELECT DISTINCT document_type FROM raw_publications)
  SELECT g.goal, goal_name, y::INT AS year, t.document_type FROM goals g CROSS JOIN generate_series(2015, 2025) AS s(y) CROSS JOIN t WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.goal = g.goal AND h.pub_year = y::VARCHAR AND h.document_type = t.document_type)""")
def missing_goals(spark: SparkSession, folder: str) -> DataFrame:
    """Goals, years and document types without any record."""
    p = table(spark, folder, "raw_publications")
    have = p.select("document_type", F.col("pub_year").alias("y"), F.explode(F.split("sdg_number", ",")).alias("g")).select("document_type", "y", F.col("g").try_cast("int").alias("goal")).distinct()
    frame = goals(spark).crossJoin(F.broadcast(p.select("document_type").distinct())).withColumn("year", F.explode(F.sequence(F.lit(2015), F.lit(2025))))
    return frame.withColumn("y", F.col("year").cast("string")).join(have, ["goal", "y", "document_type"], "left_anti").select("goal", "goal_name", "year", "document_type")


@query("SELECT row_id, source_file, row_number() OVER (PARTITION BY source_file ORDER BY row_id) AS line, row_number() OVER (PARTITION BY source_file ORDER BY row_id) + coalesce((SELECT sum(n) FROM (SELECT source_file AS s, count(*) AS n FROM raw_publications GROUP BY source_file) WHERE s < p.source_file), 0)::BIGINT AS global_id FROM raw_publications p")
def file_order_ids(spark: SparkSession, folder: str) -> DataFrame:
    """A number for each row in the order of files and of lines within: numbers within files plus the files' offsets."""
    p = table(spark, folder, "raw_publications").select("row_id", "source_file")
    sizes = p.groupBy("source_file").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("source_file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    return measures.numbered(p, ["source_file"], "row_id", "line").join(offsets, "source_file").select("row_id", "source_file", "line", (F.col("line") + F.col("offset")).alias("global_id"))


def _by(spark: SparkSession, folder: str, key: str) -> DataFrame:
    p = publications(spark, folder).select("row_id", F.col(key).alias("k"), "n_filled", F.col("sdg_number").alias("tags"))
    return records.keep_fullest(p, "k", "n_filled", "row_id", "tags")


def _sql_by(key: str) -> str:
    return f"""WITH {PUBS}, p AS (SELECT *, {key} AS k FROM pubs WHERE {key} IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n_filled DESC, row_id) AS rn,
      count(*) OVER (PARTITION BY k) AS n_rows FROM p) SELECT r.k, r.row_id, r.n_filled::INT AS n_filled, t.tags, r.n_rows FROM r JOIN {sql_tags("k", "p")} t ON t.k = r.k WHERE rn = 1"""


@query(_sql_by("eid_clean"))
def eid_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The fullest record of each identifier with the tags of all its records."""
    return _by(spark, folder, "eid_clean")


@query(_sql_by("doi_clean"))
def doi_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The same by normalised DOI."""
    return _by(spark, folder, "doi_clean")


def _narrow(spark: SparkSession, folder: str) -> DataFrame:
    """What deduplication decides on; the other columns are joined to the survivors afterwards."""
    return publications(spark, folder).select("row_id", "eid_clean", "doi_clean", "title_clean", "year", "n_filled", F.col("sdg_number").alias("tags"))


def _pass(pool: DataFrame, key: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows kept and rows removed by one key, with the keeper's keys."""
    done = checkpoint(records.settle(pool, key, "n_filled", "row_id", "tags"))
    kept = done.where("keeper = row_id").drop("keeper", "n_rows")
    gone = done.where("keeper <> row_id").select(F.col("row_id").alias("removed_row_id"), F.col("keeper").alias("kept_row_id"), F.lit(reason).alias("match_reason"))
    return kept, gone


def deduplicated(spark: SparkSession, folder: str, eid_bonus: int = 0) -> tuple[DataFrame, DataFrame]:
    """Survivors of the identifier pass and the DOI pass, in order, and the audit of what was removed.

    Decided on narrow rows. eid_bonus is added to the completeness of rows with an
    identifier in the DOI pass; 2 gives the keepers of programs whose own helper
    columns, which only such rows have filled, are counted too.
    """
    first, gone = _pass(_narrow(spark, folder), "eid_clean", "eid_exact_match")
    if eid_bonus:
        first = first.withColumn("n_filled", F.col("n_filled") + F.when(F.col("eid_clean").isNotNull(), eid_bonus).otherwise(0))
    second, more = _pass(first, "doi_clean", "doi_exact_match")
    return second, gone.unionByName(more)


def titles_settled(left: DataFrame) -> DataFrame:
    """Survivors of the exact passes with their class of similar titles: columns of left, class_id, n_links.

    Only records without a DOI, with a year and a title take part; each other one is its
    own class. Equal word sets of one year are compared once.
    """
    asked = F.col("doi_clean").isNull() & F.col("year").isNotNull() & (F.col("title_clean") != "")
    rows = checkpoint(left.where(asked).select("row_id", "year", F.array_sort(F.array_distinct(F.split("title_clean", " "))).alias("words")))
    titles = rows.groupBy("year", "words").agg(F.min("row_id").alias("id"))
    pairs = checkpoint(records.similar_titles(titles.select("id", "year", "words")))
    links = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("n_links"))
    labels = graph.min_label_components(pairs)
    of = rows.join(titles, ["year", "words"]).join(labels, "id", "left").join(links, "id", "left")
    of = of.select("row_id", F.coalesce("label", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return left.join(of, "row_id", "left")


def fully_deduplicated(spark: SparkSession, folder: str, eid_bonus: int = 0) -> tuple[DataFrame, DataFrame]:
    """Survivors of all three passes with merged tags, and the audit of what each removed."""
    left, audit = deduplicated(spark, folder, eid_bonus)
    kept, gone = _pass(titles_settled(left).drop("n_links"), "class_id", "fuzzy_title_match")
    return kept.drop("class_id"), audit.unionByName(gone)


_TWO_PASSES = f"""{PUBS}, a AS (SELECT *, row_number() OVER (PARTITION BY eid_clean ORDER BY n_filled DESC, row_id) AS r1, first_value(row_id) OVER (PARTITION BY eid_clean ORDER BY n_filled DESC, row_id) AS k1 FROM pubs),
  pool AS (SELECT *, row_number() OVER (PARTITION BY doi_clean ORDER BY n_filled DESC, row_id) AS r2, first_value(row_id) OVER (PARTITION BY doi_clean ORDER BY n_filled DESC, row_id) AS k2 FROM a WHERE eid_clean IS NULL OR r1 = 1)"""


@query(f"WITH {_TWO_PASSES} SELECT row_id, eid_clean, doi_clean, title_clean FROM pool WHERE doi_clean IS NULL OR r2 = 1")
def dedup_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """Records left after both exact passes."""
    return deduplicated(spark, folder)[0].select("row_id", "eid_clean", "doi_clean", "title_clean")


@query(f"""WITH {_TWO_PASSES} SELECT row_id AS removed_row_id, k1 AS kept_row_id, 'eid_exact_match' AS match_reason FROM a WHERE eid_clean IS NOT NULL AND r1 > 1
  UNION ALL SELECT row_id, k2, 'doi_exact_match' FROM pool WHERE doi_clean IS NOT NULL AND r2 > 1""")
def dedup_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Each removed record, the one kept in its place, and why."""
    return deduplicated(spark, folder)[1]


@query(f"""WITH {_TWO_PASSES} SELECT (SELECT count(*) FROM pubs) AS n_in, (SELECT count(*) FROM pool) AS n_after_eid, (SELECT count(*) FROM pool WHERE doi_clean IS NULL OR r2 = 1) AS n_after_doi,
  (SELECT count(*) FROM pubs) = (SELECT count(*) FROM a WHERE eid_clean IS NOT NULL AND r1 > 1) + (SELECT count(*) FROM pool WHERE doi_clean IS NOT NULL AND r2 > 1) + (SELECT count(*) FROM pool WHERE doi_clean IS NULL OR r2 = 1) AS adds_up""")
def reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts between stages, and whether rows in equal rows kept plus rows removed."""
    left, audit = deduplicated(spark, folder)
    n_in = table(spark, folder, "raw_publications").agg(F.count("*").alias("n_in"))
    gone = audit.agg(F.count_if(F.col("match_reason") == "eid_exact_match").alias("e"), F.count_if(F.col("match_reason") == "doi_exact_match").alias("d"))
    out = n_in.crossJoin(gone).crossJoin(left.agg(F.count("*").alias("kept")))
    return out.select("n_in", (F.col("n_in") - F.col("e")).alias("n_after_eid"), F.col("kept").alias("n_after_doi"), (F.col("n_in") == F.col("e") + F.col("d") + F.col("kept")).alias("adds_up"))


@query(f"WITH {PUBS}, g AS (SELECT eid_clean, count(*) AS n FROM pubs WHERE eid_clean IS NOT NULL GROUP BY 1) SELECT n AS copies, count(*) AS n_groups, sum(n)::BIGINT AS n_rows FROM g WHERE n > 1 GROUP BY n")
def duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    """How many identifiers have how many records."""
    g = publications(spark, folder).where("eid_clean is not null").groupBy("eid_clean").agg(F.count("*").alias("n")).where("n > 1")
    return g.groupBy(F.col("n").alias("copies")).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"))


@query(f"""WITH {PUBS}, p AS (SELECT *, eid_clean AS k FROM pubs WHERE eid_clean IS NOT NULL), t AS {sql_tags("k", "p")} SELECT CASE WHEN len(string_split(tags, ',')) >= 4 THEN '4+' ELSE len(string_split(tags, ','))::VARCHAR END AS n_tags, count(*) AS n FROM t GROUP BY 1""")
def tag_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """How many identifiers carry one, two, three, or more tags."""
    n = F.size(F.split("tags", ","))
    return _by(spark, folder, "eid_clean").groupBy(F.when(n >= 4, "4+").otherwise(n.cast("string")).alias("n_tags")).agg(F.count("*").alias("n"))


@query()
def fuzzy_title_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Survivors without a DOI whose titles are alike (token-set ratio of at least 95, years at most one apart).

    One row for each record: its class, named by the class's smallest row, the
    class's size, and the number of distinct titles its own is directly linked with.
    """
    of = checkpoint(titles_settled(deduplicated(spark, folder)[0]).where("class_id is not null").select("row_id", "class_id", "n_links"))
    sizes = of.groupBy("class_id").agg(F.count("*").alias("class_size"))
    return of.join(sizes, "class_id").select("row_id", "class_id", "class_size", "n_links")


@query()
def full_dedup_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """Records left after all three passes, with the tags of all records that they stand for."""
    kept = fully_deduplicated(spark, folder)[0]
    return kept.select("row_id", "eid_clean", "doi_clean", "title_clean", "tags", F.size(F.split("tags", ",")).alias("tag_count"))


@query()
def full_dedup_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The removal log of all three passes: what was removed, its title's first 80 characters, what is kept and why, and the merged tags."""
    kept, gone = fully_deduplicated(spark, folder)
    p = publications(spark, folder).select("row_id", F.substring(F.coalesce("title", F.lit("")), 1, 80).alias("title"), "eid_clean", "doi_clean")
    lost = p.withColumnsRenamed({"row_id": "removed_row_id", "title": "removed_title", "eid_clean": "removed_eid", "doi_clean": "removed_doi"})
    held = p.select(F.col("row_id").alias("kept_row_id"), F.col("eid_clean").alias("kept_eid"), F.col("doi_clean").alias("kept_doi"))
    number = F.when(F.col("match_reason") == "eid_exact_match", 1).when(F.col("match_reason") == "doi_exact_match", 2).otherwise(3)
    out = gone.join(lost, "removed_row_id").join(held, "kept_row_id").withColumn("pass_number", number)
    return out.select("pass_number", "removed_row_id", "removed_title", "removed_eid", "removed_doi", "kept_row_id", "kept_eid", "kept_doi", "match_reason")


@query()
def full_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    """Rows removed by each of the three passes, and whether they and the rows kept are all rows."""
    kept, gone = fully_deduplicated(spark, folder)
    by = gone.agg(*(F.count_if(F.col("match_reason") == r).alias(n) for n, r in (("by_eid", "eid_exact_match"), ("by_doi", "doi_exact_match"), ("by_title", "fuzzy_title_match"))))
    out = table(spark, folder, "raw_publications").agg(F.count("*").alias("n_in")).crossJoin(by).crossJoin(kept.agg(F.count("*").alias("n_kept")))
    return out.withColumn("adds_up", F.col("n_in") == F.col("by_eid") + F.col("by_doi") + F.col("by_title") + F.col("n_kept"))


@query("SELECT pass_number, match_reason, count(*) AS n, count(DISTINCT removed_row_id) AS n_removed FROM dedup_log GROUP BY ALL")
def reason_tally(spark: SparkSession, folder: str) -> DataFrame:
    """The removal log by pass and reason."""
    return table(spark, folder, "dedup_log").groupBy("pass_number", "match_reason").agg(F.count("*").alias("n"), F.countDistinct("removed_row_id").alias("n_removed"))


@query(f"""WITH {PUBS}, e AS (SELECT DISTINCT source_file, eid_clean FROM pubs WHERE eid_clean IS NOT NULL), n AS (SELECT source_file, count(*) AS n FROM e GROUP BY 1),
  b AS (SELECT a.source_file AS file_a, b.source_file AS file_b, count(*) AS n_both FROM e a JOIN e b ON a.eid_clean = b.eid_clean AND a.source_file < b.source_file GROUP BY 1, 2)
  SELECT file_a, file_b, n_both, round(n_both / least(x.n, y.n), 6) AS overlap FROM b JOIN n x ON x.source_file = file_a JOIN n y ON y.source_file = file_b""")
def export_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """For each two exports: identifiers in both, and their share of the smaller one.

    An identifier is in at most as many exports as there are files, so its pairs are bounded.
    """
    e = publications(spark, folder).where("eid_clean is not null").select("source_file", "eid_clean").distinct()
    files = e.groupBy("eid_clean").agg(F.array_sort(F.collect_set("source_file")).alias("f")).where(F.size("f") > 1)
    firsts = files.select(F.posexplode("f").alias("i", "file_a"), "f")
    pairs = firsts.select("file_a", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("file_b"))
    both = pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("n_both"))
    n = e.groupBy("source_file").agg(F.count("*").alias("n"))
    out = both.join(F.broadcast(n.withColumnsRenamed({"source_file": "file_a", "n": "x"})), "file_a").join(F.broadcast(n.withColumnsRenamed({"source_file": "file_b", "n": "y"})), "file_b")
    return out.select("file_a", "file_b", "n_both", F.round(F.col("n_both") / F.least("x", "y"), 6).alias("overlap"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def text_digests(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 of each document's text."""
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"WITH {PUBS}, s AS (SELECT title_clean, row_id, row_number() OVER (PARTITION BY title_clean ORDER BY row_id) AS k FROM pubs WHERE title_clean <> '') SELECT row_id, CASE WHEN k = 1 THEN title_clean ELSE title_clean || '_' || (k - 1)::VARCHAR END AS unique_title FROM s")
def make_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Titles made unique by numbering their repetitions."""
    p = publications(spark, folder).where("title_clean <> ''").select("row_id", "title_clean")
    p = measures.numbered(p, ["title_clean"], "row_id", "k")
    return p.select("row_id", F.when(F.col("k") == 1, F.col("title_clean")).otherwise(F.concat_ws("_", "title_clean", (F.col("k") - 1).cast("string"))).alias("unique_title"))
