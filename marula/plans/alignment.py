"""Queries that hold a portfolio of goals against an outcome: correlation, intervals, quadrants.

The outcome index of a country and goal isn't among the tables, so it's taken from
the records themselves: the mean citations of the country's records of the goal,
scaled to 0..100 over all countries. Any other index table can stand in its place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marula.operators import measures as M
from marula.plans.dims import SQL_GOALS, countries, goals
from marula.plans.indicators import BY_COUNTRY, by_country
from marula.plans.registry import query


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """One row (country, goal, n, share, score, deficit) for each country and goal, with nulls where there is nothing."""
    c = by_country(spark, folder).select("country", "cites", F.explode(F.split("sdg_number", ",")).alias("g")).select("country", "cites", F.col("g").try_cast("int").alias("goal"))
    s = c.groupBy("country", "goal").agg(F.count("*").alias("n"), F.avg("cites").alias("mean"))
    s = s.select("country", "goal", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("country"))).alias("share"), (100 * F.col("mean") / F.max("mean").over(Window.partitionBy())).alias("score"))
    frame = countries(spark).select("country").crossJoin(goals(spark).select("goal"))
    return frame.join(s, ["country", "goal"], "left").select("country", "goal", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("share", F.lit(0.0)).alias("share"), "score", (100 - F.col("score")).alias("deficit"))


PANEL = f"""{BY_COUNTRY}, g0 AS (SELECT country, cites, try_cast(g AS INT) AS goal FROM bc, unnest(string_split(sdg_number, ',')) AS u(g)), s0 AS (SELECT country, goal, count(*) AS n, avg(cites) AS mean FROM g0 GROUP BY ALL),
  s1 AS (SELECT country, goal, n, n / sum(n) OVER (PARTITION BY country) AS share, 100 * mean / max(mean) OVER () AS score FROM s0),
  panel AS (SELECT c.country, g.goal::INT AS goal, coalesce(n, 0) AS n, coalesce(share, 0.0)::DOUBLE AS share, score, 100 - score AS deficit FROM countries c CROSS JOIN generate_series(1, 17) AS g(goal) LEFT JOIN s1 ON s1.country = c.country AND s1.goal = g.goal)"""


@query(f"WITH {PANEL} SELECT country, goal, n, round(share, 6) AS share, round(score, 6) AS score, round(deficit, 6) AS deficit FROM panel")
def goal_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Every country and goal, with share of the country's records, score and deficit."""
    return panel(spark, folder).select("country", "goal", "n", *(F.round(c, 6).alias(c) for c in ("share", "score", "deficit")))


@query(f"WITH {PANEL}, i AS (SELECT country, sum(n) AS records, count(*) FILTER (n > 0) AS with_records, count(score) AS with_score FROM panel GROUP BY 1) SELECT country, records::BIGINT AS records, with_records, with_score, with_records >= 10 AND with_score >= 14 AS qualifies, CASE WHEN with_records < 10 THEN 'too few goals' WHEN with_score < 14 THEN 'too few scores' ELSE '' END AS reason FROM i")
def inclusion(spark: SparkSession, folder: str) -> DataFrame:
    """Which countries have records for ten goals and scores for fourteen, and why others don't qualify."""
    i = panel(spark, folder).groupBy("country").agg(F.sum("n").alias("records"), F.count_if(F.col("n") > 0).alias("with_records"), F.count("score").alias("with_score"))
    few, scores = F.col("with_records") < 10, F.col("with_score") < 14
    return i.select("country", "records", "with_records", "with_score", (~few & ~scores).alias("qualifies"), F.when(few, "too few goals").when(scores, "too few scores").otherwise("").alias("reason"))


@query(f"""WITH {PANEL}, p AS (SELECT * FROM panel WHERE score IS NOT NULL AND share > 0), r AS (SELECT country, rank() OVER (PARTITION BY country ORDER BY share) + (count(*) OVER (PARTITION BY country, share) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY country ORDER BY score) + (count(*) OVER (PARTITION BY country, score) - 1) / 2.0 AS y FROM p) SELECT country, round(corr(x, y), 6) AS rho, count(*) AS n FROM r GROUP BY country HAVING count(*) >= 10""")
def spearman_by_country(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation of share and score of each country with at least ten pairs."""
    return correlations(spark, folder).select("country", F.round("rho", 6).alias("rho"), "n")


def bootstrap(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Correlation, p-value and 95 % interval of one country from 1000 seeded resamples of its at most 17 pairs."""
    rows = rows.sort_values("goal")
    x, y = rows["share"].to_numpy(), rows["score"].to_numpy()

    def ranks(v: np.ndarray) -> np.ndarray:
        # of each row, ties sharing the mean of their ranks
        return (v[:, :, None] > v[:, None, :]).sum(axis=2) + ((v[:, :, None] == v[:, None, :]).sum(axis=2) + 1) / 2

    def rho(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ra, rb = ranks(a), ranks(b)
        da, db = ra - ra.mean(axis=1, keepdims=True), rb - rb.mean(axis=1, keepdims=True)
        norm = np.sqrt((da * da).sum(axis=1) * (db * db).sum(axis=1))
        return np.divide((da * db).sum(axis=1), norm, out=np.full(len(a), np.nan), where=norm > 0)

    seed = sum(ord(c) * 31**i for i, c in enumerate(str(key[0]))) % (1 << 32)
    n = len(x)
    at = np.random.default_rng([42, seed]).integers(0, n, (1000, n))
    at = at[(np.diff(np.sort(at, axis=1), axis=1) > 0).sum(axis=1) >= 2]
    drawn = rho(x[at], y[at]) if len(at) else np.array([])
    drawn = drawn[~np.isnan(drawn)]
    own = float(rho(x[None], y[None])[0])
    low, high = np.percentile(drawn, [2.5, 97.5]) if len(drawn) else (None, None)
    p = M.correlation_p(None if np.isnan(own) else own, n)
    return pd.DataFrame({"country": [key[0]], "rho": [own], "p_value": [p], "ci_lower": [low], "ci_upper": [high], "n": [n]})


@query()
def bootstrap_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation with p-value, interval and reading of each country; a seed of its own makes each country independent of the others."""
    pairs = panel(spark, folder).where("share > 0 and score is not null")
    enough = pairs.groupBy("country").agg(F.count("*").alias("k")).where("k >= 10").select("country")
    b = pairs.join(enough, "country", "left_semi").select("country", "goal", "share", "score").groupBy("country")
    b = b.applyInPandas(bootstrap, "country string, rho double, p_value double, ci_lower double, ci_upper double, n bigint")
    reading = F.when((F.col("rho") >= 0.3) & (F.col("ci_lower") > 0), "Aligned").when((F.col("rho") <= -0.3) & (F.col("ci_upper") < 0), "Misaligned").otherwise("Neutral")
    return b.withColumn("interpretation", reading)


_QUADRANT = "CASE WHEN share >= ms AND deficit >= md THEN 'HH' WHEN share >= ms THEN 'HL' WHEN deficit >= md THEN 'LH' ELSE 'LL' END"


def quadrants(spark: SparkSession, folder: str, share_cut, deficit_cut) -> DataFrame:
    """Panel rows with both values and their quadrant by two cuts; a value at its cut is high."""
    q = panel(spark, folder).where("score is not null and share > 0").withColumn("ms", share_cut).withColumn("md", deficit_cut)
    hs, hd = F.col("share") >= F.col("ms"), F.col("deficit") >= F.col("md")
    return q.withColumn("quadrant", F.when(hs & hd, "HH").when(hs, "HL").when(hd, "LH").otherwise("LL"))


def _median(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("goal")
    return quadrants(spark, folder, F.median("share").over(w), F.median("deficit").over(w))


_MED = f"{PANEL}, m AS (SELECT *, median(share) OVER (PARTITION BY goal) AS ms, median(deficit) OVER (PARTITION BY goal) AS md FROM panel WHERE score IS NOT NULL AND share > 0), q AS (SELECT *, {_QUADRANT} AS quadrant FROM m)"


@query(f"WITH {_MED} SELECT country, goal, round(share, 6) AS share, round(deficit, 6) AS deficit, quadrant FROM q")
def median_quadrants(spark: SparkSession, folder: str) -> DataFrame:
    """Quadrant of each country and goal by the goal's medians."""
    return _median(spark, folder).select("country", "goal", F.round("share", 6).alias("share"), F.round("deficit", 6).alias("deficit"), "quadrant")


@query(f"WITH {PANEL}, m AS (SELECT *, quantile_cont(share, 0.667) OVER (PARTITION BY goal) AS ms, quantile_cont(deficit, 0.667) OVER (PARTITION BY goal) AS md FROM panel WHERE score IS NOT NULL AND share > 0) SELECT country, goal, {_QUADRANT} AS tertile, CASE WHEN share >= 0.08 AND deficit >= 50 THEN 'HH' WHEN share >= 0.08 THEN 'HL' WHEN deficit >= 50 THEN 'LH' ELSE 'LL' END AS fixed FROM m")
def sensitivity_quadrants(spark: SparkSession, folder: str) -> DataFrame:
    """The same by the upper third and by fixed cuts."""
    w = Window.partitionBy("goal")
    q = quadrants(spark, folder, F.percentile("share", 0.667).over(w), F.percentile("deficit", 0.667).over(w))
    hs, hd = F.col("share") >= 0.08, F.col("deficit") >= 50
    return q.select("country", "goal", F.col("quadrant").alias("tertile"), F.when(hs & hd, "HH").when(hs, "HL").when(hd, "LH").otherwise("LL").alias("fixed"))


@query(f"""WITH {_MED}, p AS (SELECT country, count(*) FILTER (quadrant = 'HH') AS "HH", count(*) FILTER (quadrant = 'HL') AS "HL", count(*) FILTER (quadrant = 'LH') AS "LH", count(*) FILTER (quadrant = 'LL') AS "LL" FROM q GROUP BY 1)
  SELECT *, CASE WHEN "HH" >= greatest("HL", "LH", "LL") THEN 'HH' WHEN "HL" >= greatest("LH", "LL") THEN 'HL' WHEN "LH" >= "LL" THEN 'LH' ELSE 'LL' END AS dominant FROM p""")
def quadrant_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """How many goals of each country lie in each quadrant, and the leading one, the first of equals."""
    names = ["HH", "HL", "LH", "LL"]
    p = _median(spark, folder).groupBy("country").pivot("quadrant", names).agg(F.count(F.lit(1))).na.fill(0)
    lead = F.when(F.col("HH") >= F.greatest("HL", "LH", "LL"), "HH").when(F.col("HL") >= F.greatest("LH", "LL"), "HL").when(F.col("LH") >= F.col("LL"), "LH").otherwise("LL")
    return p.select("country", *names, lead.alias("dominant"))


@query(f"WITH {_MED}, e AS (SELECT country, goal, deficit / max(deficit) OVER () - share / (max(share) OVER () + 1e-9) AS extremity FROM q WHERE quadrant = 'LH') SELECT country, goal, round(extremity, 6) AS extremity FROM e ORDER BY round(extremity, 6) DESC, country, goal LIMIT 5")
def most_neglected(spark: SparkSession, folder: str) -> DataFrame:
    """The five countries and goals with most deficit for least share."""
    every = Window.partitionBy()
    e = _median(spark, folder).where("quadrant = 'LH'")
    x = F.round(F.col("deficit") / F.max("deficit").over(every) - F.col("share") / (F.max("share").over(every) + 1e-9), 6)
    return e.select("country", "goal", x.alias("extremity")).orderBy(F.desc("extremity"), "country", "goal").limit(5)


@query(f"WITH {_MED} SELECT goal, round(median(deficit), 6) AS med_deficit, round(median(share), 6) AS med_share, round(median(deficit) - 1000 * median(share), 4) AS neglect, count(*) FILTER (quadrant = 'HL') AS over_researched, count(*) AS n FROM q GROUP BY goal")
def goal_neglect(spark: SparkSession, folder: str) -> DataFrame:
    """Medians of each goal, its neglect, and how many countries over-research it."""
    d, s = F.median("deficit"), F.median("share")
    return _median(spark, folder).groupBy("goal").agg(F.round(d, 6).alias("med_deficit"), F.round(s, 6).alias("med_share"), F.round(d - 1000 * s, 4).alias("neglect"), F.count_if(F.col("quadrant") == "HL").alias("over_researched"), F.count("*").alias("n"))


_RHO = """rp AS (SELECT * FROM panel WHERE score IS NOT NULL AND share > 0), rr AS (SELECT country, rank() OVER (PARTITION BY country ORDER BY share) + (count(*) OVER (PARTITION BY country, share) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY country ORDER BY score) + (count(*) OVER (PARTITION BY country, score) - 1) / 2.0 AS y FROM rp), rho AS (SELECT country, corr(x, y) AS rho, count(*) AS n FROM rr GROUP BY country HAVING count(*) >= 10)"""


def correlations(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (country, rho, n) of the countries with at least ten pairs, which are the qualifying ones."""
    return M.spearman(panel(spark, folder).where("share > 0"), ["country"], "share", "score").where("n >= 10")


@query(f"WITH {_MED}, {_RHO}, r AS (SELECT c.subregion, rho FROM rho JOIN countries c USING (country)), a AS (SELECT median(rho) AS every FROM r), g AS (SELECT subregion, median(rho) AS m, avg(rho) AS v, count(*) AS n FROM r GROUP BY 1) SELECT subregion, round(m, 6) AS median_rho, round(v, 6) AS mean_rho, n, CASE WHEN m > every + 0.05 THEN 'more positive' WHEN m < every - 0.05 THEN 'more negative' ELSE '' END AS flag FROM g CROSS JOIN a")
def subregion_medians(spark: SparkSession, folder: str) -> DataFrame:
    """Median and mean correlation of each subregion's countries, and whether it's apart from that of all."""
    r = correlations(spark, folder).join(F.broadcast(countries(spark).select("country", "subregion")), "country")
    g = r.groupBy("subregion").agg(F.median("rho").alias("m"), F.avg("rho").alias("v"), F.count("*").alias("n")).crossJoin(F.broadcast(r.agg(F.median("rho").alias("every"))))
    flag = F.when(F.col("m") > F.col("every") + 0.05, "more positive").when(F.col("m") < F.col("every") - 0.05, "more negative").otherwise("")
    return g.select("subregion", F.round("m", 6).alias("median_rho"), F.round("v", 6).alias("mean_rho"), "n", flag.alias("flag"))


@query(f"""WITH {_MED}, {_RHO}, {SQL_GOALS}, t AS (SELECT q.* FROM q JOIN rho USING (country)) SELECT goal, goal_name, count(*) FILTER (quadrant = 'LH') AS "LH", count(*) FILTER (quadrant = 'HH') AS "HH", count(*) FILTER (quadrant = 'HL') AS "HL", count(*) FILTER (quadrant = 'LL') AS "LL",
  round(median(deficit), 6) AS med_deficit, round(median(share), 6) AS med_research FROM t JOIN goals USING (goal) GROUP BY goal, goal_name""")
def goal_table(spark: SparkSession, folder: str) -> DataFrame:
    """Qualifying countries of each goal by quadrant, with the goal's median deficit and share among them."""
    q = _median(spark, folder).join(correlations(spark, folder).select("country"), "country", "left_semi")
    g = q.groupBy("goal").agg(*(F.count_if(F.col("quadrant") == n).alias(n) for n in ("LH", "HH", "HL", "LL")), F.round(F.median("deficit"), 6).alias("med_deficit"), F.round(F.median("share"), 6).alias("med_research"))
    return g.join(F.broadcast(goals(spark)), "goal").select("goal", "goal_name", "LH", "HH", "HL", "LL", "med_deficit", "med_research")


@query(f"""WITH {_MED}, l AS (SELECT goal, median(deficit) - 1000 * median(share) AS v, count(*) AS n FROM q WHERE quadrant = 'LH' GROUP BY goal), h AS (SELECT goal, count(*) AS n FROM q WHERE quadrant = 'HL' GROUP BY goal)
  SELECT * FROM (SELECT 'most neglected' AS finding, goal, round(v, 4) AS value, n AS n_countries FROM l ORDER BY round(v, 4) DESC, goal LIMIT 1) UNION ALL SELECT * FROM (SELECT 'most over-researched', goal, n::DOUBLE, n FROM h ORDER BY n DESC, goal LIMIT 1)""")
def extreme_goals(spark: SparkSession, folder: str) -> DataFrame:
    """The goal that is most neglected where it's in deficit, and the one that most countries over-research; ties to the smaller goal."""
    q = _median(spark, folder)
    low = q.where("quadrant = 'LH'").groupBy("goal").agg(F.round(F.median("deficit") - 1000 * F.median("share"), 4).alias("value"), F.count("*").alias("n_countries"))
    low = low.orderBy(F.desc("value"), "goal").limit(1).select(F.lit("most neglected").alias("finding"), "goal", "value", "n_countries")
    high = q.where("quadrant = 'HL'").groupBy("goal").agg(F.count("*").alias("n_countries")).orderBy(F.desc("n_countries"), "goal").limit(1)
    return low.union(high.select(F.lit("most over-researched"), "goal", F.col("n_countries").cast("double"), "n_countries"))


@query()
def publication_table(spark: SparkSession, folder: str) -> DataFrame:
    """The table of countries for print: subregion by name or official name, correlation and interval to three digits, whether it excludes zero, leading quadrant."""
    b = bootstrap_intervals(spark, folder)
    c = countries(spark)
    b = b.join(F.broadcast(c.select("country", F.col("subregion").alias("x"))), "country", "left").join(F.broadcast(c.select(F.col("official").alias("country"), F.col("subregion").alias("y")).dropDuplicates(["country"])), "country", "left")
    b = b.join(quadrant_pivot(spark, folder).select("country", "dominant"), "country", "left")
    apart = F.when((F.col("ci_lower") > 0) | (F.col("ci_upper") < 0), "yes").otherwise("no")
    return b.select("country", F.coalesce("x", "y").alias("subregion"), *(F.round(n, 3).alias(n) for n in ("rho", "ci_lower", "ci_upper")), apart.alias("ci_excludes_zero"), F.col("dominant").alias("dominant_quadrant")).orderBy(F.desc("rho"), "country")
