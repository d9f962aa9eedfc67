"""Queries of links between fields, networks, themes and their evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marula.functions import text as T
from marula.operators import graph
from marula.operators import keywords as K
from marula.plans.dims import CONTINENTS, GEO_COMMON, GEO_LINKS, GEO_THEMES, SQL_COUNTRIES
from marula.plans.indicators import BY_COUNTRY, record_countries
from marula.plans.keywords import KEYWORDS, author_keywords
from marula.plans.registry import query
from marula.session import table


def _field_sql(n: int, first_only: bool, geo: tuple[str, ...]) -> str:
    quoted = ", ".join("'" + g.replace("'", "''") + "'" for g in geo)
    return rf"""WITH {SQL_COUNTRIES}, r AS (SELECT row_id, list_transform(string_split_regex(affiliations, '[;|\n]'), lambda a: regexp_replace(list_extract(string_split(replace(a, '"', ''), ','), -1), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS l,
    author_keywords AS kws, array_to_string(list_transform(regexp_extract_all(lower(regexp_replace(source_title, '[.,;]+$', '')), '\p{{L}}+|[^\p{{L}}]+'), lambda w: upper(w[1]) || w[2:]), '') AS source FROM raw_publications),
  c AS (SELECT DISTINCT row_id, x AS country FROM r, unnest({"l[1:1]" if first_only else "l"}) AS u(x) WHERE x IN (SELECT country FROM countries)), k AS (SELECT row_id, lower(regexp_replace(x, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS keyword FROM r, unnest(string_split(kws, ';')) AS u(x)),
  kk AS (SELECT * FROM k WHERE keyword <> '' AND keyword NOT IN ({quoted})), j AS (SELECT row_id, source FROM r WHERE source <> ''),
  tc AS (SELECT country FROM c GROUP BY 1 ORDER BY count(*) DESC, country LIMIT {n}), tk AS (SELECT keyword FROM kk GROUP BY 1 ORDER BY count(*) DESC, keyword LIMIT {n}), tj AS (SELECT source FROM j GROUP BY 1 ORDER BY count(*) DESC, source LIMIT {n})
  SELECT 'country-keyword' AS field_pair, country AS src, keyword AS dst, count(*) AS n FROM c JOIN kk USING (row_id) JOIN j USING (row_id) WHERE country IN (FROM tc) AND keyword IN (FROM tk) GROUP BY ALL
  UNION ALL SELECT 'keyword-source', keyword, source, count(*) FROM kk JOIN j USING (row_id) WHERE row_id IN (SELECT row_id FROM c) AND keyword IN (FROM tk) AND source IN (FROM tj) GROUP BY ALL"""


def field_links(spark: SparkSession, folder: str, n: int, first_only: bool, geo: tuple[str, ...]) -> DataFrame:
    """Links country to keyword to source among the n most frequent of each, of records with all three; ties by name.

    first_only: only the country of the first affiliation, if it's listed, else all
    listed ones. geo: keywords that are left out. A source is written with capitals and
    without marks at its end. All stays in the row up to the counts.
    """
    names, listed = record_countries(F.col("affiliations"))
    first = F.get(names, F.lit(0))
    country = F.when(F.array_contains(listed, first), F.array(first)) if first_only else listed
    words = F.transform(T.split_values(F.col("author_keywords"), ";"), F.lower)
    source = T.title_case(F.regexp_replace("source_title", "[.,;]+$", ""))
    r = table(spark, folder, "raw_publications").select(country.alias("c"), K.without_terms(words, geo).alias("k"), F.when(source != "", source).alias("source"))

    def top(df: DataFrame, c: str) -> DataFrame:
        return F.broadcast(df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(n).select(c))

    tops = {"country": top(r.select(F.explode("c").alias("country")), "country"), "keyword": top(r.select(F.explode("k").alias("keyword")), "keyword"), "source": top(r, "source")}
    whole = r.where("size(c) > 0 and k is not null and source is not null")
    k = whole.select("c", "source", F.explode("k").alias("keyword")).join(tops["keyword"], "keyword", "left_semi")
    one = k.select("keyword", F.explode("c").alias("country")).join(tops["country"], "country", "left_semi")
    one = one.groupBy(F.lit("country-keyword").alias("field_pair"), F.col("country").alias("src"), F.col("keyword").alias("dst")).agg(F.count("*").alias("n"))
    two = k.join(tops["source"], "source", "left_semi").groupBy(F.lit("keyword-source"), "keyword", "source").agg(F.count("*"))
    return one.union(two)


@query(_field_sql(15, True, GEO_COMMON))
def three_field_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of the first country, keywords and sources among the fifteen most frequent of each."""
    return field_links(spark, folder, 15, True, GEO_COMMON)


@query(_field_sql(20, False, GEO_LINKS))
def three_field_links_all(spark: SparkSession, folder: str) -> DataFrame:
    """The same of all countries of a record and the twenty most frequent, with the longer list of geographic terms."""
    return field_links(spark, folder, 20, False, GEO_LINKS)


def country_links(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (src, dst, weight): records that two countries share. A record's countries are a bounded list."""
    listed = record_countries(F.col("affiliations"))[1]
    sets = table(spark, folder, "raw_publications").select(F.array_sort(listed).alias("c")).where(F.size("c") > 1)
    left = sets.select(F.posexplode("c").alias("i", "src"), "c")
    pairs = left.select("src", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"))


_LINKS = f"{BY_COUNTRY}, links AS (SELECT a.country AS src, b.country AS dst, count(*) AS weight FROM bc a JOIN bc b ON a.row_id = b.row_id AND a.country < b.country GROUP BY ALL)"


@query(f"WITH {_LINKS} SELECT src, dst, weight FROM links")
def cooccurrence_links(spark: SparkSession, folder: str) -> DataFrame:
    """The network of countries that share records."""
    return country_links(spark, folder)


@query(f"WITH {_LINKS}, m AS (SELECT least(x, y) AS s, greatest(x, y) AS d, weight FROM (SELECT CASE src WHEN 'Guinea-Bissau' THEN 'Guinea' WHEN 'Lesotho' THEN 'South Africa' WHEN 'Eswatini' THEN 'South Africa' ELSE src END AS x, CASE dst WHEN 'Guinea-Bissau' THEN 'Guinea' WHEN 'Lesotho' THEN 'South Africa' WHEN 'Eswatini' THEN 'South Africa' ELSE dst END AS y, weight FROM links) WHERE x <> y) SELECT s AS src, d AS dst, sum(weight)::BIGINT AS weight FROM m GROUP BY ALL")
def edge_contraction(spark: SparkSession, folder: str) -> DataFrame:
    """The same network after some nodes are merged into others."""
    merged = spark.createDataFrame([("Guinea-Bissau", "Guinea"), ("Lesotho", "South Africa"), ("Eswatini", "South Africa")], "from_id string, to_id string")
    return graph.contract(country_links(spark, folder), merged)


@query(f"WITH {_LINKS}, r AS (SELECT DISTINCT country, subregion FROM countries) SELECT a.subregion, sum(CASE WHEN a.subregion = b.subregion THEN weight END)::BIGINT AS inside, sum(weight)::BIGINT AS every, round(coalesce(sum(CASE WHEN a.subregion = b.subregion THEN weight END), 0) / sum(weight), 6) AS share FROM links JOIN r a ON a.country = src JOIN r b ON b.country = dst GROUP BY a.subregion")
def regional_link_share(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each subregion's links that stay inside it."""
    from marula.plans.dims import countries

    r = countries(spark).select("country", "subregion")
    e = country_links(spark, folder).join(F.broadcast(r.withColumnsRenamed({"country": "src", "subregion": "a"})), "src").join(F.broadcast(r.withColumnsRenamed({"country": "dst", "subregion": "b"})), "dst")
    inside = F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")))
    return e.groupBy(F.col("a").alias("subregion")).agg(inside.alias("inside"), F.sum("weight").alias("every"), F.round(F.coalesce(inside, F.lit(0)) / F.sum("weight"), 6).alias("share"))


@query(rf"""WITH g(name, continent) AS (VALUES {", ".join("('" + n.replace("'", "''") + "', '" + g + "')" for g, names in CONTINENTS.items() for n in names)}), r AS (SELECT row_id, list_distinct(list_transform(string_split_regex(affiliations, '[;|\n]'), lambda a: lower(regexp_replace(list_extract(string_split(replace(a, '"', ''), ','), -1), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')))) AS l FROM raw_publications WHERE affiliations IS NOT NULL),
  c AS (SELECT row_id, name, continent FROM r, unnest(l) AS u(x) JOIN g ON g.name = x), e AS (SELECT a.continent AS a, b.continent AS b, count(*) AS n FROM c a JOIN c b ON a.row_id = b.row_id AND a.name < b.name GROUP BY ALL), s AS (SELECT a AS continent, b AS other, n FROM e UNION ALL SELECT b, a, n FROM e WHERE a <> b)
  SELECT continent, coalesce(sum(n) FILTER (other = continent), 0)::BIGINT AS inside, sum(n)::BIGINT AS every, round(coalesce(sum(n) FILTER (other = continent), 0) / sum(n), 6) AS share FROM s GROUP BY continent""")
def continent_link_share(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each continent's links between countries that stay inside it, by the thesaurus of countries and continents."""
    codes = F.create_map(*(F.lit(v) for g, names in CONTINENTS.items() for n in names for v in (n, g)))
    names = F.array_distinct(F.transform(record_countries(F.col("affiliations"))[0], F.lower))
    known = F.array_sort(F.filter(F.transform(names, lambda x: F.struct(x.alias("name"), F.try_element_at(codes, x).alias("g"))), lambda x: x["g"].isNotNull()))
    rows = table(spark, folder, "raw_publications").select(known.alias("c")).where(F.size("c") > 1)
    pairs = rows.select(F.posexplode("c").alias("i", "x"), "c").select(F.col("x.g").alias("a"), F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("y")).select("a", F.col("y.g").alias("b"))
    e = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    ends = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    e = e.select(F.explode(ends).alias("continent"), (F.col("a") == F.col("b")).alias("own"), "n")
    inside = F.coalesce(F.sum(F.when(F.col("own"), F.col("n"))), F.lit(0))
    return e.groupBy("continent").agg(inside.alias("inside"), F.sum("n").alias("every"), F.round(inside / F.sum("n"), 6).alias("share"))


@query(f"WITH {_LINKS}, n AS (SELECT v, sum(weight)::DOUBLE AS w FROM (SELECT src AS v, weight FROM links UNION ALL SELECT dst, weight FROM links) GROUP BY 1), x AS (SELECT v, w, c.subregion FROM n JOIN countries c ON c.country = v) SELECT v AS label, subregion, round(avg(w) OVER (PARTITION BY subregion) + 1.5 * (w - avg(w) OVER (PARTITION BY subregion)), 6) AS spread, count(*) OVER (PARTITION BY v) > 1 AS repeated FROM x")
def layout_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Node weights spread from the mean of their cluster, and whether a label is repeated."""
    from marula.plans.dims import countries

    e = country_links(spark, folder)
    n = e.select(F.col("src").alias("label"), "weight").union(e.select("dst", "weight")).groupBy("label").agg(F.sum("weight").cast("double").alias("w"))
    n = n.join(F.broadcast(countries(spark).select(F.col("country").alias("label"), "subregion")), "label")
    mid = F.avg("w").over(Window.partitionBy("subregion"))
    return n.select("label", "subregion", F.round(mid + 1.5 * (F.col("w") - mid), 6).alias("spread"), (F.count("*").over(Window.partitionBy("label")) > 1).alias("repeated"))


def keyword_links(k: DataFrame, top: int = 250, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """The most frequent keywords (keyword, n) and the links between them (a, b, n_ab)."""
    k = k.select("row_id", "keyword").distinct()
    nodes = k.groupBy("keyword").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "keyword").limit(top)
    rows = k.join(F.broadcast(nodes.select("keyword")), "keyword", "left_semi").groupBy("row_id").agg(F.array_sort(F.collect_set("keyword")).alias("s"))
    left = rows.where(F.size("s") > 1).select(F.posexplode("s").alias("i", "a"), "s")
    pairs = left.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return nodes, pairs.groupBy("a", "b").agg(F.count("*").alias("n_ab"))


def themes(k: DataFrame, top: int = 250, least: int = 3) -> list[tuple[str, str, int, float, float]]:
    """Rows (cluster, keyword, n, centrality, density); the network of at most top nodes is clustered on the driver."""
    nodes, links = keyword_links(k, top, least)
    n = {r.keyword: r.n for r in nodes.collect()}
    e = sorted((r.a, r.b, r.n_ab**2 / (n[r.a] * n[r.b])) for r in links.collect())
    home = graph.communities(e)
    members: dict[str, list[str]] = {}
    for v in sorted(n):
        members.setdefault(home.get(v, v), []).append(v)
    inside, outside = dict.fromkeys(members, 0.0), dict.fromkeys(members, 0.0)
    for a, b, w in e:
        if home[a] == home[b]:
            inside[home[a]] += w
        else:
            outside[home[a]] += w
            outside[home[b]] += w
    return [(c, v, n[v], 10 * outside[c], 100 * inside[c] / len(vs)) for c, vs in members.items() for v in vs]


def theme_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Author keywords without geographic terms."""
    return author_keywords(spark, folder).where(~F.col("keyword").isin(*GEO_THEMES))


_GEO_SQL = ", ".join("'" + g.replace("'", "''") + "'" for g in GEO_THEMES)


@query(f"""WITH {KEYWORDS}, k AS (SELECT DISTINCT row_id, keyword FROM kw WHERE keyword NOT IN ({_GEO_SQL})), t AS (SELECT keyword, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, keyword LIMIT 250), u AS (SELECT k.row_id, t.keyword, t.n FROM k JOIN t USING (keyword))
  SELECT a.keyword AS a, b.keyword AS b, count(*) AS n_ab, round(count(*) * count(*) / (a.n * b.n), 6) AS equivalence FROM u a JOIN u b ON a.row_id = b.row_id AND a.keyword < b.keyword GROUP BY a.keyword, b.keyword, a.n, b.n""")
def keyword_network(spark: SparkSession, folder: str) -> DataFrame:
    """Links between the 250 most frequent themes with at least five records, and how close they are: the network of the maps."""
    nodes, links = keyword_links(theme_keywords(spark, folder), 250, 5)
    n = nodes.withColumnRenamed("n", "w")
    e = links.join(F.broadcast(n.withColumnsRenamed({"keyword": "a", "w": "na"})), "a").join(F.broadcast(n.withColumnsRenamed({"keyword": "b", "w": "nb"})), "b")
    return e.select("a", "b", "n_ab", F.round(F.col("n_ab") * F.col("n_ab") / (F.col("na") * F.col("nb")), 6).alias("equivalence"))


def themes_with_fallback(k: DataFrame, top: int = 250, least: tuple[int, ...] = (5, 3)) -> list[tuple[str, str, int, float, float]]:
    """themes() at the first minimum frequency that leaves any two keywords linked, or else at the last."""
    found: list = []
    for m in least:
        found = themes(k, top, m)
        if len({c for c, *_ in found}) < len(found):
            break
    return found


@query()
def thematic_map(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of the 250 most frequent keywords with centrality, density, their ranks and quadrants by the medians."""
    rows = themes_with_fallback(theme_keywords(spark, folder))
    t = spark.createDataFrame(rows, "cluster string, keyword string, n bigint, centrality double, density double")
    c = t.groupBy("cluster", "centrality", "density").agg(F.sum("n").alias("freq"), F.count("*").alias("n_words"))
    every = Window.partitionBy()
    hi = lambda x: F.col(x) >= F.median(x).over(every)
    name = F.when(hi("centrality") & hi("density"), "motor").when(hi("density"), "niche").when(hi("centrality"), "basic").otherwise("emerging or declining")
    rank = lambda x: F.rank().over(Window.orderBy(x))
    return c.select("cluster", "freq", "n_words", F.round("centrality", 6).alias("centrality"), F.round("density", 6).alias("density"), rank("centrality").alias("rcentrality"), rank("density").alias("rdensity"), name.alias("quadrant"))


@query()
def thematic_evolution(spark: SparkSession, folder: str) -> DataFrame:
    """Links between the themes of successive time slices: inclusion, stability, and inclusion weighted by occurrence."""
    from marula.plans.keywords import _slices

    k = _slices(spark, folder).where(~F.col("keyword").isin(*GEO_THEMES))
    names = ("2015-2018", "2019-2022", "2023-")
    found = {}
    for s in names:
        clusters: dict[str, dict[str, int]] = {}
        for c, v, n, *_ in themes_with_fallback(k.where(F.col("slice") == s)):
            clusters.setdefault(c, {})[v] = n
        found[s] = clusters
    rows = []
    for one, two in zip(names, names[1:]):
        for a, x in found[one].items():
            for b, y in found[two].items():
                if both := x.keys() & y.keys():
                    weight = sum(x[v] for v in both) / min(sum(x.values()), sum(y.values()))
                    rows.append((f"{a}--{one}", f"{b}--{two}", len(both) / min(len(x), len(y)), len(both) / len(x.keys() | y.keys()), min(weight, 1.0)))
    e = spark.createDataFrame(rows, "src string, dst string, inclusion double, stability double, inc_weighted double")
    return e.select("src", "dst", *(F.round(c, 6).alias(c) for c in ("inclusion", "stability", "inc_weighted")))


@query()
def evolution_flows(spark: SparkSession, folder: str) -> DataFrame:
    """The evolution's links in long form for flow charts: two rows for each, one at either end, period suffixes taken off."""
    e = thematic_evolution(spark, folder).where("inclusion > 0").withColumn("flow", F.concat_ws(">", "src", "dst"))
    ends = F.array(*(F.struct(F.lit(side).alias("side"), F.col(c).alias("node")) for side, c in (("from", "src"), ("to", "dst"))))
    x = e.select("flow", F.col("inclusion").alias("weight"), F.explode(ends).alias("x")).select("flow", "weight", "x.*")
    return x.select("flow", "side", F.regexp_replace("node", r"--\d{4}-(\d{4})?$", "").alias("theme"), F.regexp_extract("node", r"--(\d{4}-(?:\d{4})?)$", 1).alias("period"), "weight")
