"""Queries over boolean search texts, made from the thesaurus of each goal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marula.operators import boolquery as Q
from marula.plans.dims import SQL_COUNTRIES, country_rows
from marula.plans.registry import query
from marula.session import table


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """One query line for each preferred term: its forms as wildcard words and phrases. The thesaurus doesn't grow."""
    t = table(spark, folder, "thesaurus").select("preferred_term", F.lower("source_term").alias("form"), "multi_sdg_query_count").distinct()
    forms = t.groupBy("preferred_term").agg(F.array_sort(F.collect_set("form")).alias("f"), F.max("multi_sdg_query_count").alias("k"))
    text = F.array_join(F.transform("f", lambda x: F.concat(F.lit('"'), x, F.lit('*"'))), " OR ")
    return forms.select("preferred_term", "k", F.concat(F.lit('("'), "preferred_term", F.lit('" OR '), text, F.lit(") W/3 (polic* OR programme)")).alias("line"))


_LINES = """lines AS (SELECT preferred_term, max(multi_sdg_query_count) AS k, '("' || preferred_term || '" OR ' || string_agg(DISTINCT '"' || lower(source_term) || '*"', ' OR ' ORDER BY '"' || lower(source_term) || '*"') || ') W/3 (polic* OR programme)' AS line FROM thesaurus GROUP BY preferred_term)"""


@query(f"WITH {_LINES} SELECT preferred_term, k, line, length(line)::BIGINT AS n_chars, length(line) > 25000 AS too_long FROM lines")
def query_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The search line of each preferred term, its length, and whether it must be split."""
    n = F.length("line").cast("bigint")
    return _lines(spark, folder).select("preferred_term", "k", "line", n.alias("n_chars"), (n > 25_000).alias("too_long"))


_ENDING = "AND PUBYEAR > 2014 AND PUBYEAR < 2026" + chr(10) + "AND ( DOCTYPE ( ar ) OR DOCTYPE ( re ) )"
#: Longest query that a search service takes.
LIMIT = 25_000


def composed(spark: SparkSession, folder: str, limit: int = LIMIT) -> DataFrame:
    """Rows (preferred_term, part, text): each line with countries, years and types, one for each subregion where the whole is too long."""
    by: dict[str, list[str]] = {}
    for r in country_rows():
        by.setdefault(r[4], []).append(r[2])
    text = lambda places: F.concat(F.lit("( TITLE-ABS-KEY( "), "line", F.lit(" ) )\nAND ( " + " OR ".join(f'AFFILCOUNTRY ( "{c}" )' for c in sorted(places)) + " )\n" + _ENDING))
    lines = _lines(spark, folder).withColumn("text", text([r[2] for r in country_rows()]))
    parts = F.array(*(F.struct(F.lit(k).alias("part"), text(v).alias("text")) for k, v in sorted(by.items())))
    whole = F.array(F.struct(F.lit("all").alias("part"), "text"))
    return lines.select("preferred_term", F.explode(F.when(F.length("text") > limit, parts).otherwise(whole)).alias("x")).select("preferred_term", "x.*")


_AFFIL = "(SELECT string_agg('AFFILCOUNTRY ( \"' || country || '\" )', ' OR ' ORDER BY country) FROM countries c WHERE {})"
_TEXT = lambda where: f"""'( TITLE-ABS-KEY( ' || line || ' ) )' || chr(10) || 'AND ( ' || {_AFFIL.format(where)} || ' )' || chr(10) || '{_ENDING.replace(chr(10), "' || chr(10) || '")}'"""


def _composed_sql(limit: int) -> str:
    return f"""WITH {_LINES}, {SQL_COUNTRIES}, w AS (SELECT preferred_term, line, {_TEXT('TRUE')} AS text FROM lines), r AS (SELECT DISTINCT subregion FROM countries)
      SELECT preferred_term, 'all' AS part, text, length(text)::BIGINT AS n_chars FROM w WHERE length(text) <= {limit}
      UNION ALL SELECT preferred_term, part, text, length(text)::BIGINT FROM (SELECT preferred_term, r.subregion AS part, {_TEXT('c.subregion = r.subregion')} AS text FROM w, r WHERE length(w.text) > {limit})"""


@query(_composed_sql(LIMIT))
def composed_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Each line composed with countries, years and types, by subregions where it's longer than the service takes."""
    return composed(spark, folder).withColumn("n_chars", F.length("text").cast("bigint"))


@query(_composed_sql(2000))
def composed_queries_split(spark: SparkSession, folder: str) -> DataFrame:
    """The same for a service that takes 2,000 characters, so that long ones are split."""
    return composed(spark, folder, 2000).withColumn("n_chars", F.length("text").cast("bigint"))


_CLEANED = T.StructType([T.StructField("cleaned", T.StringType()), T.StructField("rules", T.MapType(T.StringType(), T.LongType()))])


@F.udf(_CLEANED)
def _clean(text: str):
    cleaned, counts = Q.clean(text)
    return cleaned, dict(counts)


def _cleaned(spark: SparkSession, folder: str) -> DataFrame:
    # a query is one short text, and there are as many as terms
    return composed(spark, folder).where("part = 'all'").select("preferred_term", "text", _clean("text").alias("c"))


@query()
def cleaned_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Each composed query as a stricter parser takes it."""
    return _cleaned(spark, folder).select("preferred_term", F.col("c.cleaned").alias("cleaned"))


@query()
def cleaning_log(spark: SparkSession, folder: str) -> DataFrame:
    """For each composed query: its length before and after, and how often each cleaning rule was applied."""
    c = _cleaned(spark, folder)
    n = {r: F.coalesce(F.try_element_at("c.rules", F.lit(r)), F.lit(0)) for r in "ABCDEFG"}
    before, after = F.length("text").cast("bigint"), F.length("c.cleaned").cast("bigint")
    return c.select("preferred_term", before.alias("original_length"), after.alias("cleaned_length"), (after - before).alias("length_delta"), *(v.alias(f"rule_{r}") for r, v in n.items()), sum(n.values(), F.lit(0)).alias("total"))


@query()
def cleaning_rule_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each cleaning rule was applied over all lines."""
    c = _lines(spark, folder).select(F.explode(_clean("line")["rules"]).alias("rule", "n"))
    return c.groupBy("rule").agg(F.sum("n").alias("n"))


@query(r"""WITH y(first, last) AS (VALUES (2015, 2018), (2019, 2021), (2022, 2025)), t AS (SELECT DISTINCT preferred_term FROM thesaurus)
  SELECT preferred_term, first, last, regexp_replace('TITLE-ABS-KEY( "' || preferred_term || '" ) AND PUBYEAR > 2014 AND PUBYEAR < 2026', 'AND PUBYEAR > \d{4} AND PUBYEAR < \d{4}', 'AND PUBYEAR > ' || (first - 1)::VARCHAR || ' AND PUBYEAR < ' || (last + 1)::VARCHAR) AS text FROM t CROSS JOIN y""")
def year_split_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Each term's query for each part of the period."""
    t = table(spark, folder, "thesaurus").select("preferred_term").distinct()
    parts = spark.createDataFrame([(2015, 2018), (2019, 2021), (2022, 2025)], "first int, last int")
    base = F.concat(F.lit('TITLE-ABS-KEY( "'), "preferred_term", F.lit('" ) AND PUBYEAR > 2014 AND PUBYEAR < 2026'))
    years = F.concat(F.lit("AND PUBYEAR > "), (F.col("first") - 1).cast("string"), F.lit(" AND PUBYEAR < "), (F.col("last") + 1).cast("string"))
    return t.crossJoin(F.broadcast(parts)).select("preferred_term", "first", "last", F.regexp_replace(base, F.lit(Q.YEARS.pattern), years).alias("text"))


_TERMS = rf"""{_LINES}, ph AS (SELECT unnest(regexp_extract_all(line, '"([^"]+)"', 1)) AS v FROM lines), bw AS (SELECT unnest(string_split_regex(regexp_replace(line, '"[^"]*"', ' ', 'g'), '[\s()/,\[\]]+')) AS v FROM lines),
  query_terms AS (SELECT term FROM (SELECT trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(v), '\*+$', '')), '[^\p{{L}}\p{{N}}_-]', ' ', 'g'), ' +', ' ', 'g')) AS term FROM ph) WHERE length(term) >= 3
    UNION ALL SELECT lower(v) FROM bw WHERE regexp_matches(v, '^\p{{L}}{{3,}}$') AND lower(v) NOT IN {tuple(sorted(Q.OPERATORS))})"""


def query_terms(line):
    """boolquery.vocabulary of a line inside the JVM, for lines without braces."""
    phrase = lambda v: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(F.trim(v), r"\*+$", "")), r"[^\p{L}\p{N}_-]", " "), " +", " "))
    phrases = F.filter(F.transform(F.regexp_extract_all(line, F.lit('"([^"]+)"'), F.lit(1)), phrase), lambda t: F.length(t) >= 3)
    bare = F.split(F.regexp_replace(line, '"[^"]*"', " "), r"[\s()/,\[\]]+")
    words = F.filter(F.transform(F.filter(bare, lambda v: v.rlike(r"^\p{L}{3,}$")), F.lower), lambda w: ~w.isin(*sorted(Q.OPERATORS)))
    return F.concat(phrases, words)


@query(f"WITH {_TERMS} SELECT term, count(*) AS n FROM query_terms GROUP BY term")
def query_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases and bare words of all lines, normalised, without wildcards at their end."""
    return vocabulary_terms(spark, folder).groupBy("term").agg(F.count("*").alias("n"))


def vocabulary_terms(spark: SparkSession, folder: str) -> DataFrame:
    """One row (term) for each term of each line."""
    return _lines(spark, folder).select(F.explode(query_terms(F.col("line"))).alias("term"))
