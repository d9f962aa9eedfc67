"""Queries of publication and citation indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marula.functions import text as T
from marula.operators import measures as M
from marula.plans.dims import SQL_COUNTRIES, SQL_GOALS, countries, country_rows, goals
from marula.plans.records import PUBS, publications
from marula.plans.registry import query
from marula.session import table


def record_countries(affiliations) -> tuple:
    """The countries of a packed cell, each once and in order: all names, and those of the list. Stays in the row."""
    parts = F.transform(F.split(affiliations, "[;|\n]"), lambda a: T.strip(F.element_at(F.split(F.regexp_replace(a, '"', ""), ","), -1)))
    names = F.array_distinct(parts)
    return names, F.array_intersect(names, F.array(*(F.lit(r[2]) for r in country_rows())))


def by_country(spark: SparkSession, folder: str) -> DataFrame:
    """One row (row_id, country, year, cites, n_countries) for each listed country of a record; nothing is shuffled."""
    p = publications(spark, folder).select("row_id", "year", "cites", "source_title", "sdg_number", record_countries(F.col("affiliations"))[1].alias("c"))
    each = p.select("row_id", "year", "cites", "source_title", "sdg_number", F.size("c").cast("bigint").alias("n_countries"), F.explode("c").alias("country"))
    return each.join(F.broadcast(countries(spark)), "country")


BY_COUNTRY = rf"""{PUBS}, {SQL_COUNTRIES}, pc AS (SELECT DISTINCT row_id, year, cites, source_title, sdg_number,
    regexp_replace(list_extract(string_split(replace(a, '"', ''), ','), -1), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS country
    FROM pubs, unnest(string_split_regex(affiliations, '[;|\n]')) AS u(a)),
  bc AS (SELECT pc.*, c.iso2, c.iso3, c.official, c.subregion, count(*) OVER (PARTITION BY row_id) AS n_countries FROM pc JOIN countries c USING (country))"""


def by_goal(spark: SparkSession, folder: str) -> DataFrame:
    """One row (row_id, goal, year, cites, n_tags) for each tag of a record."""
    p = publications(spark, folder).select("row_id", "year", "cites", F.split("sdg_number", ",").alias("t"))
    return p.select("row_id", "year", "cites", F.greatest(F.size("t"), F.lit(1)).alias("n_tags"), F.explode("t").alias("g")).select(
        "row_id", "year", "cites", "n_tags", F.col("g").try_cast("int").alias("goal")
    )


BY_GOAL = f"""{PUBS}, bg AS (SELECT row_id, year, cites, greatest(len(string_split(sdg_number, ',')), 1) AS n_tags, try_cast(g AS INT) AS goal FROM pubs, unnest(string_split(sdg_number, ',')) AS u(g))"""


@query(f"WITH {PUBS} SELECT count(*) AS n_records, round(sum(cites), 3) AS citations, round(sum(cites) / count(*), 6) AS per_record, count(DISTINCT source_title) AS n_sources, min(year) AS first_year, max(year) AS last_year FROM pubs")
def overview(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of the corpus."""
    p = publications(spark, folder)
    return p.agg(
        F.count("*").alias("n_records"), F.round(F.sum("cites"), 3).alias("citations"), F.round(F.sum("cites") / F.count("*"), 6).alias("per_record"),
        F.countDistinct("source_title").alias("n_sources"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )


@query(f"WITH {PUBS} SELECT year, source_title, count(*) AS n, round(sum(cites), 3) AS citations FROM pubs GROUP BY ALL")
def counts_by_year_source(spark: SparkSession, folder: str) -> DataFrame:
    """Records and citations by year and source."""
    return publications(spark, folder).groupBy("year", "source_title").agg(F.count("*").alias("n"), F.round(F.sum("cites"), 3).alias("citations"))


@query(f"WITH {PUBS}, y AS (SELECT unnest(generate_series(2015, 2025))::INT AS year), s AS (SELECT DISTINCT document_type FROM pubs), c AS (SELECT document_type, year, count(*) AS n FROM pubs GROUP BY ALL) SELECT s.document_type, y.year, coalesce(n, 0) AS n FROM s CROSS JOIN y LEFT JOIN c ON c.document_type = s.document_type AND c.year = y.year")
def annual_densified(spark: SparkSession, folder: str) -> DataFrame:
    """Records of each type in every year of the period, none counted as 0."""
    p = publications(spark, folder)
    counts = p.groupBy("document_type", "year").agg(F.count("*").alias("n"))
    frame = p.select("document_type").distinct().select("document_type", F.explode(F.sequence(F.lit(2015), F.lit(2025))).alias("year"))
    return frame.join(counts, ["document_type", "year"], "left").select("document_type", "year", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {BY_GOAL}, {SQL_GOALS}, s AS (SELECT goal, sum(1.0 / n_tags) AS f, sum(cites / n_tags) AS c FROM bg GROUP BY goal)
  SELECT goal, goal_name, round(f, 6) AS records, round(100 * f / sum(f) OVER (), 6) AS share, round(c, 6) AS citations, round(c / f, 6) AS per_record FROM s JOIN goals USING (goal)""")
def fractional_by_goal(spark: SparkSession, folder: str) -> DataFrame:
    """Records and citations of each goal, those of several goals split evenly, and each goal's share."""
    s = by_goal(spark, folder).groupBy("goal").agg(F.sum(1.0 / F.col("n_tags")).alias("f"), F.sum(F.col("cites") / F.col("n_tags")).alias("c"))
    s = s.join(F.broadcast(goals(spark)), "goal")
    share = 100 * F.col("f") / F.sum("f").over(Window.partitionBy())
    return s.select("goal", "goal_name", F.round("f", 6).alias("records"), F.round(share, 6).alias("share"), F.round("c", 6).alias("citations"), F.round(F.col("c") / F.col("f"), 6).alias("per_record"))


@query(f"WITH {BY_COUNTRY} SELECT country, subregion, count(*) AS full_count, round(sum(1.0 / n_countries), 6) AS fractional, round(sum(cites), 3) AS citations, round(log10(count(*) + 1), 6) AS log_count FROM bc GROUP BY country, subregion")
def full_and_fractional_by_country(spark: SparkSession, folder: str) -> DataFrame:
    """Full and fractional counts of each country."""
    return by_country(spark, folder).groupBy("country", "subregion").agg(
        F.count("*").alias("full_count"), F.round(F.sum(1.0 / F.col("n_countries")), 6).alias("fractional"), F.round(F.sum("cites"), 3).alias("citations"), F.round(F.log10(F.count("*") + 1), 6).alias("log_count")
    )


@query(f"WITH {BY_COUNTRY} SELECT try_cast(g AS INT) AS goal, country, count(*) AS n, round(sum(1.0 / n_countries / len(string_split(sdg_number, ','))), 6) AS fractional FROM bc, unnest(string_split(sdg_number, ',')) AS u(g) GROUP BY ALL")
def goal_by_country(spark: SparkSession, folder: str) -> DataFrame:
    """Full and fractional counts of each goal in each country."""
    c = by_country(spark, folder).withColumn("t", F.split("sdg_number", ","))
    c = c.select("country", (1.0 / F.col("n_countries") / F.size("t")).alias("w"), F.explode("t").alias("g"))
    return c.groupBy(F.col("g").try_cast("int").alias("goal"), "country").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("fractional"))


@query(f"WITH {BY_COUNTRY}, r AS (SELECT country, floor(cites) AS c, row_number() OVER (PARTITION BY country ORDER BY cites DESC, row_id) AS k FROM bc) SELECT country, coalesce(max(CASE WHEN c >= k THEN k END), 0)::BIGINT AS h_index FROM r GROUP BY country")
def h_index_by_country(spark: SparkSession, folder: str) -> DataFrame:
    """h-index of each country."""
    return M.h_index(by_country(spark, folder), ["country"], "cites")


@query(f"WITH {PUBS} SELECT source_title, arg_max(row_id, (cites, -row_id)) AS row_id, round(max(cites), 3) AS cites FROM pubs GROUP BY source_title")
def top_record_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """The most cited record of each source, the first of equals."""
    top = F.max_by("row_id", F.struct("cites", -F.col("row_id")))
    return publications(spark, folder).groupBy("source_title").agg(top.alias("row_id"), F.round(F.max("cites"), 3).alias("cites"))


@query(f"WITH {PUBS}, s AS (SELECT source_title, count(*) AS n, sum(cites) AS c FROM pubs GROUP BY 1) SELECT source_title, n, round(c, 3) AS citations, round(c / n, 6) AS per_record FROM s ORDER BY n DESC, source_title LIMIT 10")
def top_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The ten sources with most records, ties by name."""
    s = publications(spark, folder).groupBy("source_title").agg(F.count("*").alias("n"), F.sum("cites").alias("c"))
    return s.select("source_title", "n", F.round("c", 3).alias("citations"), F.round(F.col("c") / F.col("n"), 6).alias("per_record")).orderBy(F.desc("n"), "source_title").limit(10)


@query(f"""WITH {BY_COUNTRY}, c AS (SELECT subregion, country, count(*) AS n, sum(cites) AS c FROM bc GROUP BY ALL), g AS (SELECT subregion, count(*) FILTER (year = 2015) AS a, count(*) FILTER (year = 2024) AS b FROM bc GROUP BY 1),
  s AS (SELECT subregion, sum(n) AS n, sum(c) AS c, arg_max(country, (n, country)) AS top FROM c GROUP BY 1) SELECT s.subregion, n::BIGINT AS records, round(100 * n / sum(n) OVER (), 6) AS share, round(CASE WHEN a > 0 AND b > 0 THEN (pow(b / a, 1.0 / 9) - 1) * 100 END, 6) AS growth, top AS top_country,
  round(c / n, 6) AS per_record FROM s JOIN g USING (subregion)""")
def subregion_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Records, share, growth from 2015 to 2024 and leading country of each subregion."""
    c = by_country(spark, folder)
    n = c.groupBy("subregion", "country").agg(F.count("*").alias("n"), F.sum("cites").alias("c"), F.count_if(F.col("year") == 2015).alias("a"), F.count_if(F.col("year") == 2024).alias("b"))
    s = n.groupBy("subregion").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.max_by("country", F.struct("n", "country")).alias("top_country"))
    return s.select(
        "subregion", F.col("n").alias("records"), F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"), F.round(M.growth(F.col("a"), F.col("b"), 9), 6).alias("growth"),
        "top_country", F.round(F.col("c") / F.col("n"), 6).alias("per_record"),
    )


@query(f"WITH {BY_COUNTRY}, r AS (SELECT subregion, country, count(*) AS n FROM bc GROUP BY ROLLUP (subregion, country)) SELECT coalesce(subregion, '(all)') AS subregion, coalesce(country, '(all)') AS country, n FROM r")
def country_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of countries with totals of subregions and of all."""
    r = by_country(spark, folder).rollup("subregion", "country").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("subregion", F.lit("(all)")).alias("subregion"), F.coalesce("country", F.lit("(all)")).alias("country"), "n")


@query(f"WITH {BY_GOAL} SELECT goal, median(cites) AS med, quantile_cont(cites, 0.667) AS tertile, quantile_cont(cites, 0.975) AS high, avg(cites) AS mean, count(*) AS n FROM bg GROUP BY goal".replace("avg(cites) AS mean", "round(avg(cites), 6) AS mean").replace("quantile_cont(cites, 0.667) AS", "round(quantile_cont(cites, 0.667), 6) AS").replace("quantile_cont(cites, 0.975) AS", "round(quantile_cont(cites, 0.975), 6) AS"))
def citation_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact quantiles of citations by goal."""
    return by_goal(spark, folder).groupBy("goal").agg(
        F.median("cites").alias("med"), F.round(F.percentile("cites", 0.667), 6).alias("tertile"), F.round(F.percentile("cites", 0.975), 6).alias("high"), F.round(F.avg("cites"), 6).alias("mean"), F.count("*").alias("n")
    )


@query(f"WITH {PUBS}, f AS (SELECT title_clean, min(row_id) AS row_id FROM pubs WHERE title_clean <> '' GROUP BY 1) SELECT f.title_clean, p.title FROM f JOIN pubs p USING (row_id)")
def first_seen_form(spark: SparkSession, folder: str) -> DataFrame:
    """The first written form of each normalised title."""
    return publications(spark, folder).where("title_clean <> ''").groupBy("title_clean").agg(F.min_by("title", "row_id").alias("title"))


@query(f"WITH {BY_GOAL} SELECT goal, greatest(h, a, o) AS most, CASE WHEN h >= a AND h >= o THEN 'high' WHEN a >= o THEN 'mid' ELSE 'low' END AS leading, h, a AS m, o AS l FROM (SELECT goal, count(*) FILTER (cites >= 5) AS h, count(*) FILTER (cites >= 1 AND cites < 5) AS a, count(*) FILTER (cites < 1) AS o FROM bg GROUP BY goal)")
def band_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Records of each goal by citation band as columns, and the leading band, the first of equals."""
    band = F.when(F.col("cites") >= 5, "h").when(F.col("cites") >= 1, "m").otherwise("l")
    p = by_goal(spark, folder).withColumn("band", band).groupBy("goal").pivot("band", ["h", "m", "l"]).agg(F.count(F.lit(1))).na.fill(0)
    lead = F.when((F.col("h") >= F.col("m")) & (F.col("h") >= F.col("l")), "high").when(F.col("m") >= F.col("l"), "mid").otherwise("low")
    return p.select("goal", F.greatest("h", "m", "l").alias("most"), lead.alias("leading"), "h", "m", "l")


@query(f"WITH {PUBS}, u AS (UNPIVOT (SELECT row_id, length(title)::BIGINT AS title, length(abstract)::BIGINT AS abstract, length(affiliations)::BIGINT AS affiliations FROM pubs) ON title, abstract, affiliations INTO NAME field VALUE n) SELECT field, min(n) AS shortest, max(n) AS longest, count(n) AS n_filled FROM u GROUP BY field")
def field_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Shortest and longest value of each text column, by unpivoting."""
    lengths = publications(spark, folder).select("row_id", *(F.length(c).cast("bigint").alias(c) for c in ("title", "abstract", "affiliations")))
    u = lengths.unpivot("row_id", ["title", "abstract", "affiliations"], "field", "n")
    return u.groupBy("field").agg(F.min("n").alias("shortest"), F.max("n").alias("longest"), F.count("n").alias("n_filled"))


@query(rf"""WITH {PUBS}, f AS (SELECT row_id, regexp_replace(split_part(authors, ';', 1), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS a FROM pubs WHERE authors IS NOT NULL) SELECT a AS first_author, count(*) AS n FROM f GROUP BY a""")
def first_authors(spark: SparkSession, folder: str) -> DataFrame:
    """Records by the author named first."""
    p = table(spark, folder, "raw_publications").where("authors is not null")
    return p.groupBy(T.strip(F.substring_index("authors", ";", 1)).alias("first_author")).agg(F.count("*").alias("n"))


_EXPORT = {"AU": "authors", "TI": "title", "SO": "source_title", "AB": "abstract", "DE": "author_keywords", "ID": "index_keywords", "C1": "affiliations", "TC": "cited_by", "PY": "pub_year", "DI": "doi", "DT": "document_type", "UT": "eid"}


@query("SELECT " + ", ".join(f"{v} AS {k}" for k, v in _EXPORT.items()) + ", 'SCOPUS' AS DB FROM raw_publications")
def bibliographic_export(spark: SparkSession, folder: str) -> DataFrame:
    """Records under the field tags of bibliographic programs."""
    return table(spark, folder, "raw_publications").select(*(F.col(v).alias(k) for k, v in _EXPORT.items()), F.lit("SCOPUS").alias("DB"))


@query("SELECT document_type, row_id FROM (SELECT document_type, row_id, row_number() OVER (PARTITION BY document_type ORDER BY md5('42:' || row_id::VARCHAR), row_id) AS k FROM raw_publications) WHERE k <= 5")
def sampled_records(spark: SparkSession, folder: str) -> DataFrame:
    """Five records of each document type in a seeded random order; the sampling operator."""
    p = table(spark, folder, "raw_publications").select("document_type", "row_id", F.md5(F.concat(F.lit("42:"), F.col("row_id").cast("string"))).alias("h"))
    k = F.row_number().over(Window.partitionBy("document_type").orderBy("h", "row_id"))
    return p.withColumn("k", k).where("k <= 5").select("document_type", "row_id")


@query(f"""WITH {BY_COUNTRY}, {SQL_GOALS}, t AS (SELECT country FROM bc GROUP BY 1 ORDER BY count(*) DESC, country LIMIT 30), n AS (SELECT country, try_cast(g AS INT) AS goal, count(*) AS n FROM bc, unnest(string_split(sdg_number, ',')) AS u(g) GROUP BY ALL)
  SELECT t.country, g.goal::INT AS goal, coalesce(n, 0) AS n, round(log10(coalesce(n, 0) + 1), 6) AS log_n FROM t CROSS JOIN goals g LEFT JOIN n ON n.country = t.country AND n.goal = g.goal""")
def goal_country_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Figure data: the thirty leading countries by all goals, with counts and their logarithm, none as 0."""
    c = by_country(spark, folder)
    top = c.groupBy("country").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "country").limit(30).select("country")
    n = c.select("country", F.explode(F.split("sdg_number", ",")).alias("g")).groupBy("country", F.col("g").try_cast("int").alias("goal")).agg(F.count("*").alias("n"))
    frame = top.crossJoin(F.broadcast(goals(spark).select("goal"))).join(n, ["country", "goal"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return frame.select("country", "goal", "n", F.round(F.log10(F.col("n") + 1), 6).alias("log_n"))


@query(f"""WITH {PUBS}, o AS (SELECT count(*) AS n, sum(cites)::BIGINT AS c, count(DISTINCT source_title) AS s, round(100.0 * count(doi_clean) / count(*), 1) AS d FROM pubs)
  SELECT 'records' AS metric, format('{{:,}}', n) AS value FROM o UNION ALL SELECT 'citations', format('{{:,}}', c) FROM o UNION ALL SELECT 'sources', format('{{:,}}', s) FROM o UNION ALL SELECT 'with DOI', format('{{:.1f}} %', d) FROM o""")
def formatted_overview(spark: SparkSession, folder: str) -> DataFrame:
    """The totals as text for a report, one metric a row."""
    p = publications(spark, folder)
    o = p.agg(F.count("*").alias("n"), F.sum("cites").cast("bigint").alias("c"), F.countDistinct("source_title").alias("s"), F.round(100.0 * F.count("doi_clean") / F.count("*"), 1).alias("d"))
    rows = [("records", F.format_number("n", 0)), ("citations", F.format_number("c", 0)), ("sources", F.format_number("s", 0)), ("with DOI", F.format_string("%.1f %%", "d"))]
    return o.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in rows))).alias("x")).select("x.*")
