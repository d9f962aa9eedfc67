"""Queries of keywords: vocabulary, thesaurus rules and their use, set operations, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marula.functions import text as T
from marula.operators import keywords as K
from marula.plans.dims import ACRONYMS, AMERICAN, SYNONYMS
from marula.plans.querytext import _TERMS, vocabulary_terms
from marula.plans.registry import query
from marula.session import table

_STRIP = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def author_keywords(spark: SparkSession, folder: str, delimiter: str = ";") -> DataFrame:
    """Rows (row_id, keyword, year) of lower-cased keywords between semicolons."""
    p = table(spark, folder, "raw_publications")
    return p.select("row_id", T.whole_number(F.col("pub_year")).alias("year"), "source_title", "sdg_number", F.explode(T.split_values(F.col("author_keywords"), delimiter)).alias("raw")).withColumn("keyword", F.lower("raw"))


KEYWORDS = rf"""kw AS (SELECT row_id, try_cast(try_cast(pub_year AS DOUBLE) AS INT) AS year, source_title, sdg_number, raw, lower(raw) AS keyword FROM (SELECT *, regexp_replace(x, '{_STRIP}', '', 'g') AS raw FROM raw_publications, unnest(string_split(author_keywords, ';')) AS u(x)) WHERE raw <> '')"""
_TOP = "top AS (SELECT keyword, n FROM (SELECT keyword, count(*) AS n FROM kw GROUP BY 1) ORDER BY n DESC, keyword LIMIT 500)"


def top_keywords(spark: SparkSession, folder: str, k: int = 500) -> DataFrame:
    return author_keywords(spark, folder).groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(k)


@query(f"WITH {KEYWORDS}, {_TOP} SELECT keyword, n FROM top")
def keyword_top500(spark: SparkSession, folder: str) -> DataFrame:
    """The 500 most frequent keywords, ties by name."""
    return top_keywords(spark, folder)


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of the query lines and the most frequent author keywords, each once."""
    return top_keywords(spark, folder).select(F.col("keyword").alias("term")).union(vocabulary_terms(spark, folder)).distinct()


_VOCABULARY = rf"""{KEYWORDS}, {_TOP}, {_TERMS}, vocab AS (SELECT keyword AS term FROM top UNION SELECT term FROM query_terms)"""
_PAIRS = lambda d: ", ".join("('" + a.replace("'", "''") + "', '" + b.replace("'", "''") + "')" for a, b in d.items())
_RULES = rf"""{_VOCABULARY}, am(term, p) AS (VALUES {_PAIRS(AMERICAN)}), ac(term, p) AS (VALUES {_PAIRS(ACRONYMS)}), sy(term, p) AS (VALUES {_PAIRS(SYNONYMS)}),
  f AS (SELECT term, CASE WHEN term LIKE '%ies' THEN regexp_replace(term, 'ies$', 'y') WHEN term LIKE '%s' AND length(term) > 5 THEN regexp_replace(term, 's$', '') END AS sg, CASE WHEN contains(term, '-') THEN replace(term, '-', '') END AS so FROM vocab),
  found AS (SELECT f.term AS source_term, CASE WHEN am.p IS NOT NULL THEN am.p WHEN s.term IS NOT NULL THEN sg WHEN o.term IS NOT NULL THEN so WHEN ac.p IS NOT NULL THEN ac.p ELSE sy.p END AS preferred_term,
    CASE WHEN am.p IS NOT NULL THEN 'british_american' WHEN s.term IS NOT NULL THEN 'plural_singular' WHEN o.term IS NOT NULL THEN 'hyphen' WHEN ac.p IS NOT NULL THEN 'acronym_expansion' WHEN sy.p IS NOT NULL THEN 'synonym_map' END AS rule_type
    FROM f LEFT JOIN vocab s ON s.term = sg LEFT JOIN vocab o ON o.term = so LEFT JOIN am ON am.term = f.term LEFT JOIN ac ON ac.term = f.term LEFT JOIN sy ON sy.term = f.term),
  rules AS (SELECT * FROM found WHERE rule_type IS NOT NULL UNION ALL SELECT term, p, 'acronym_expansion' FROM ac WHERE term NOT IN (SELECT source_term FROM found WHERE rule_type IS NOT NULL)
    UNION ALL SELECT term, p, 'synonym_map' FROM sy WHERE term NOT IN (SELECT source_term FROM found WHERE rule_type IS NOT NULL))"""


def rules(spark: SparkSession, folder: str) -> DataFrame:
    return K.rewrite_rules(vocabulary(spark, folder), AMERICAN, ACRONYMS, SYNONYMS)


@query(f"WITH {_RULES} SELECT source_term, preferred_term, rule_type FROM rules")
def thesaurus_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rewriting of each term of the vocabulary."""
    return rules(spark, folder)


@query(f"WITH {_RULES} SELECT rule_type, count(*) AS n FROM rules GROUP BY rule_type")
def rule_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many terms each rule rewrites."""
    return rules(spark, folder).groupBy("rule_type").agg(F.count("*").alias("n"))


@query(rf"""WITH t AS (SELECT lower(source_term) AS source_term, max(preferred_term) AS preferred_term FROM thesaurus GROUP BY 1), e AS (SELECT row_id, pos, lower(l[pos]) AS term FROM (SELECT row_id, list_filter(list_transform(string_split(author_keywords, '; '), lambda x: regexp_replace(x, '{_STRIP}', '', 'g')), lambda x: x <> '') AS l FROM raw_publications WHERE author_keywords IS NOT NULL), unnest(generate_series(1, len(l))) AS u(pos))
  SELECT row_id, string_agg(coalesce(preferred_term, term), '; ' ORDER BY pos) AS keywords, sum((coalesce(preferred_term, term) <> term)::INT)::BIGINT AS n_changed FROM e LEFT JOIN t ON t.source_term = e.term GROUP BY row_id""")
def keyword_harmonise(spark: SparkSession, folder: str) -> DataFrame:
    """Each record's keywords with the reviewed thesaurus applied once, and how many changed."""
    listed = table(spark, folder, "thesaurus").groupBy(F.lower("source_term").alias("source_term")).agg(F.max("preferred_term").alias("preferred_term"))
    cells = table(spark, folder, "raw_publications").select("row_id", F.col("author_keywords").alias("cell"))
    return K.harmonise(cells, listed)


@query(f"WITH {KEYWORDS}, k AS (SELECT keyword, arg_min(raw, (row_id, raw)) AS raw FROM kw GROUP BY 1) SELECT raw AS source_term, keyword AS preferred_term FROM k WHERE raw <> keyword")
def case_fold_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The first written form of each keyword where it isn't in lower case."""
    k = author_keywords(spark, folder).groupBy("keyword").agg(F.min_by("raw", F.struct("row_id", "raw")).alias("raw"))
    return k.where("raw <> keyword").select(F.col("raw").alias("source_term"), F.col("keyword").alias("preferred_term"))


@query(f"WITH {KEYWORDS}, g AS (SELECT DISTINCT keyword, try_cast(x AS INT) AS goal FROM kw, unnest(string_split(sdg_number, ',')) AS u(x)) SELECT keyword, count(goal) AS n_goals, count(goal) >= 2 AS several FROM g GROUP BY keyword")
def goals_per_keyword(spark: SparkSession, folder: str) -> DataFrame:
    """In how many goals a keyword is used."""
    g = author_keywords(spark, folder).select("keyword", F.explode(F.split("sdg_number", ",")).alias("g"))
    return g.groupBy("keyword").agg(F.countDistinct(F.col("g").try_cast("int")).alias("n_goals")).select("keyword", "n_goals", (F.col("n_goals") >= 2).alias("several"))


_SLICE = "CASE WHEN year <= 2018 THEN '2015-2018' WHEN year <= 2022 THEN '2019-2022' ELSE '2023-' END"


def _slices(spark: SparkSession, folder: str) -> DataFrame:
    k = author_keywords(spark, folder).where("year is not null")
    label = F.when(F.col("year") <= 2018, "2015-2018").when(F.col("year") <= 2022, "2019-2022").otherwise("2023-")
    return k.withColumn("slice", label)


@query(f"WITH {KEYWORDS}, s AS (SELECT DISTINCT keyword, {_SLICE} AS slice FROM kw WHERE year IS NOT NULL), f AS (SELECT keyword, string_agg(slice, ' ' ORDER BY slice) AS s FROM s GROUP BY 1) SELECT keyword, CASE WHEN s LIKE '%2015-2018%2019-2022%2023-%' THEN 'lasting' WHEN s NOT LIKE '%2015-2018%' AND s LIKE '%2023-%' THEN 'emerging' WHEN s LIKE '%2015-2018%' AND s NOT LIKE '%2023-%' THEN 'disappearing' ELSE 'other' END AS course FROM f")
def keyword_course(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords of all time slices, of later ones only, or of earlier ones only: sets met and parted in one aggregate of bits."""
    bit = F.when(F.col("year") <= 2018, 1).when(F.col("year") <= 2022, 2).otherwise(4)
    s = author_keywords(spark, folder).where("year is not null").groupBy("keyword").agg(F.bit_or(bit).alias("s"))
    has = lambda b: F.col("s").bitwiseAND(b) != 0
    course = F.when(F.col("s") == 7, "lasting").when(~has(1) & has(4), "emerging").when(has(1) & ~has(4), "disappearing").otherwise("other")
    return s.select("keyword", course.alias("course"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s-]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM documents")
def normalise_text(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in lower case with letters, digits and hyphens only."""
    return table(spark, folder, "documents").select("doc_id", T.normal_name(F.col("text")).alias("plain"))


@query(r"WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents) SELECT token, count(*) AS n FROM w GROUP BY token")
def token_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of each word of the documents."""
    d = table(spark, folder, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("token"))
    return d.groupBy("token").agg(F.count("*").alias("n"))
