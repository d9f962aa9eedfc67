"""Queries that resolve affiliations to institutions: the cascade of look-ups, its roll-up and its review."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marula.functions import text as T
from marula.operators.partial import nearest
from marula.plans.dims import INSTITUTION_WORDS, LABEL_ENDS, OTHER_NAMES, ROLES, SHORT_NAMES, SQL_COUNTRIES, UNIT_PREFIXES, countries, country_rows
from marula.plans.records import PUBS, publications
from marula.plans.registry import query
from marula.session import checkpoint, partitions, table

_STRIP = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (row_id, pos, segment) of the affiliations between semicolons."""
    p = table(spark, folder, "raw_publications").select("row_id", F.posexplode(T.split_values(F.col("affiliations"), ";")).alias("pos", "segment"))
    return p.select("row_id", F.col("pos").cast("bigint").alias("pos"), "segment")


_NORM = lambda c: rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g'), '\s+', ' ', 'g'))"
SEGMENTS = rf"""seg0 AS (SELECT row_id, list_filter(list_transform(string_split(affiliations, ';'), lambda x: regexp_replace(x, '{_STRIP}', '', 'g')), lambda x: x <> '') AS l FROM raw_publications WHERE affiliations IS NOT NULL),
  seg AS (SELECT row_id, pos - 1 AS pos, l[pos] AS segment FROM seg0, unnest(generate_series(1, len(l))) AS u(pos))"""


@query(rf"WITH {SEGMENTS} SELECT segment, {_NORM('segment')} AS plain, count(*) AS n, count(DISTINCT row_id) AS n_records FROM seg GROUP BY segment")
def affiliation_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct affiliations with their normalised form and frequency."""
    return segments(spark, folder).groupBy("segment").agg(T.normal_name(F.first("segment")).alias("plain"), F.count("*").alias("n"), F.countDistinct("row_id").alias("n_records"))


def hints(segment):
    """The listed countries named in the last three comma parts, from the end, each once, as their codes."""
    parts = F.transform(F.split(segment, ","), lambda x: F.lower(T.strip(x)))
    tail = F.reverse(F.slice(parts, -F.least(F.size(parts), F.lit(3)), 3))
    codes = F.create_map(*(F.lit(v) for r in country_rows() for v in (r[2].lower(), r[0])))
    return F.array_distinct(F.filter(F.transform(tail, lambda x: F.try_element_at(codes, x)), lambda x: x.isNotNull()))


#: hinted(segment, iso2, k): the same for the segments d.
HINTS = rf"""tails AS (SELECT segment, list_reverse(list_transform(string_split(segment, ','), lambda x: lower(regexp_replace(x, '{_STRIP}', '', 'g'))))[1:3] AS tail FROM d),
  hinted AS (SELECT segment, iso2, min(k) AS k FROM tails, unnest(generate_series(1, len(tail))) AS u(k) JOIN countries c ON lower(c.country) = tail[k] GROUP BY ALL)"""


@query(rf"""WITH {SEGMENTS}, {SQL_COUNTRIES}, d AS (SELECT DISTINCT segment FROM seg), {HINTS}
  SELECT d.segment, coalesce(string_agg(iso2, ',' ORDER BY k), '') AS hints FROM d LEFT JOIN hinted USING (segment) GROUP BY d.segment""")
def country_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Countries named in the last three parts of each affiliation, from the end, each once."""
    return segments(spark, folder).select("segment").distinct().select("segment", F.array_join(hints(F.col("segment")), ",").alias("hints"))


def _known(spark: SparkSession, folder: str) -> DataFrame:
    """The reviewed strings by their normalised form; the last decision on a form holds."""
    o = table(spark, folder, "manual_overrides").select(T.normal_name(F.col("raw_string")).alias("form"), "override_id", "ror_id")
    return o.where("form <> ''").groupBy("form").agg(F.max_by("ror_id", "override_id").alias("ror_id"), F.max("override_id").alias("override_id"))


def institutions(spark: SparkSession, folder: str) -> DataFrame:
    """The register of known organisations: override_id, name, acronym in brackets and country of each reviewed string."""
    last = F.lower(T.strip(F.element_at(F.split("raw_string", ","), -1)))
    o = table(spark, folder, "manual_overrides").where("raw_string is not null")
    return o.select("override_id", F.regexp_replace("raw_string", ",.*", " ").alias("name"), F.regexp_extract("raw_string", r"\(([A-Z]{2,10})\)", 1).alias("acronym"), F.get(hints(last), F.lit(0)).alias("iso2"))


_UNIT = "^(" + "|".join(UNIT_PREFIXES) + ")"


def _exact(c: str) -> str:
    """exact_name in SQL; the rule for hyphens runs twice, as it takes the letters beside them."""
    v = f"(' ' || {_NORM(c)} || ' ')"
    for article in T.ARTICLES:
        v = f"replace({v}, '{article}', ' ')"
    for _ in range(2):
        v = rf"regexp_replace({v}, '([\p{{L}}\p{{N}}_])-([\p{{L}}\p{{N}}_])', '\1 \2', 'g')"
    return rf"trim(regexp_replace({v}, '\s+', ' ', 'g'))"


KNOWN = rf"""known AS (SELECT form, override_id, ror_id FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY override_id DESC) AS r FROM (SELECT override_id, ror_id, {_NORM('raw_string')} AS form FROM manual_overrides)) WHERE form <> '' AND r = 1),
  inst AS (SELECT override_id, regexp_replace(raw_string, ',.*', ' ') AS name, regexp_extract(raw_string, '\(([A-Z]{{2,10}})\)', 1) AS acronym, iso2 FROM manual_overrides LEFT JOIN countries c ON lower(c.country) = lower(regexp_replace(list_extract(string_split(raw_string, ','), -1), '{_STRIP}', '', 'g'))),
  org AS (SELECT form, min(override_id) AS override_id FROM (SELECT override_id, {_exact('name')} AS form FROM inst) WHERE length(form) > 10 GROUP BY form),
  acr AS (SELECT iso2, acronym, max(override_id) AS override_id FROM inst WHERE acronym <> '' AND iso2 IS NOT NULL GROUP BY ALL),
  turn AS (SELECT iso2, min(override_id) AS k FROM inst WHERE acronym <> '' AND iso2 IS NOT NULL GROUP BY 1)"""


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """The parts before the first comma of the reviewed strings, as names to look up; the first string of a name holds."""
    o = institutions(spark, folder).select(T.exact_name(F.col("name")).alias("form"), "override_id")
    return o.where("length(form) > 10").groupBy("form").agg(F.min("override_id").alias("override_id"))


def prefixes(segment):
    """The leading runs of comma parts, longest first, in the form of exact look-ups.

    A run's normal form is that of its parts side by side, so each part is brought into it
    once; the array around them keeps them from being worked out anew for each run. An
    article in a run is one in the whole, so most segments are looked through once.
    """
    parts = F.array(F.transform(F.split(segment, ","), T.marked_name))
    joined = lambda p, n: F.array_join(F.filter(F.slice(p, 1, n), lambda x: x != ""), " ")
    runs = lambda p, form: F.transform(F.sequence(F.size(p), F.lit(1), F.lit(-1)), lambda n: form(joined(p, n)))
    return F.get(F.transform(parts, lambda p: F.when(T.has_article(joined(p, F.size(p))), runs(p, T.exact_of)).otherwise(runs(p, T.unmarked))), F.lit(0))


def _within(forms: DataFrame, names: DataFrame) -> DataFrame:
    """Without the forms that are longer than any name."""
    return forms.join(F.broadcast(names.agg(F.max(F.length("form")).alias("longest"))), F.length("form") <= F.col("longest")).drop("longest")


def _acronyms(spark: SparkSession, folder: str, d: DataFrame) -> DataFrame:
    """Hits of segments whose first part is an acronym: in the countries they hint at, in that order, else in any country, the earliest first."""
    o = institutions(spark, folder).where("acronym <> '' and iso2 is not null")
    listed = o.groupBy("iso2", "acronym").agg(F.max("override_id").alias("override_id"))
    turn = o.groupBy("iso2").agg(F.min("override_id").alias("turn"))
    a = d.select("segment", T.strip(F.substring_index("segment", ",", 1)).alias("acronym"), hints(F.col("segment")).alias("h")).where(F.col("acronym").rlike("^[A-Z]{2,10}$"))
    hinted = a.select("segment", "acronym", F.posexplode("h").alias("k", "iso2")).join(listed, ["iso2", "acronym"]).select("segment", "k", "override_id")
    free = a.where(F.size("h") == 0).join(listed, "acronym").join(turn, "iso2").select("segment", F.col("turn").alias("k"), "override_id")
    return hinted.union(free)


def cascade(spark: SparkSession, folder: str) -> DataFrame:
    """One row (segment, n, method, override_id, score) for each distinct affiliation; the first step that finds one wins.

    Steps: the reviewed string itself (with or without an organisation), the longest
    leading run of parts that is a known name, the same after a unit's label is taken
    off, an acronym as first part. All are equi-joins on forms. What is left is scored
    by resolved(). n is how often the affiliation occurs.
    """
    d = segments(spark, folder).groupBy("segment").agg(F.count("*").alias("n"))
    d = checkpoint(d)
    hit = lambda df, step, k="k": df.select("segment", F.lit(step).alias("step"), F.col(k).cast("bigint").alias("k"), "override_id")
    whole = d.select("segment", T.normal_name(F.col("segment")).alias("form")).join(_known(spark, folder), "form")
    whole = whole.select("segment", F.when(F.col("ror_id").isNull(), 0).otherwise(1).alias("step"), F.lit(0).cast("bigint").alias("k"), "override_id")
    names = _names(spark, folder)
    walk = hit(_within(d.select("segment", F.posexplode(prefixes(F.col("segment"))).alias("k", "form")), names).join(names, "form"), 2)
    rest = F.trim(F.regexp_extract("segment", r"^[^,]+,(.*)$", 1))
    cut = d.where(F.lower("segment").rlike(_UNIT) & F.col("segment").contains(",")).select("segment", rest.alias("rest")).where("length(rest) > 10")
    cut = hit(_within(cut.select("segment", F.posexplode(prefixes(F.col("rest"))).alias("k", "form")), names).join(names, "form"), 3)
    every = whole.unionByName(walk).unionByName(cut).unionByName(hit(_acronyms(spark, folder, d), 4))
    best = every.groupBy("segment").agg(F.min(F.struct("step", "k", "override_id")).alias("m"))
    step = F.col("m.step")
    method = F.element_at(F.array(*map(F.lit, METHODS)), F.coalesce(step, F.lit(5)) + 1)
    score = F.when(step == 1, 1.0).when(step >= 2, 100.0).otherwise(0.0)
    return d.join(best, "segment", "left").select("segment", "n", method.alias("method"), F.when(step > 0, F.col("m.override_id")).alias("override_id"), score.alias("score"))


#: The exact steps in the order in which they are tried, and what they leave.
METHODS = ("manual_unresolvable", "manual_override", "exact", "exact_stripped", "acronym", "unresolved")


_WALK = lambda c: f"unnest(generate_series(1, len(string_split({c}, ',')))) AS u(i) JOIN org o ON o.form = {_exact(f'array_to_string(string_split({c}, chr(44))[1:i], chr(44) || chr(32))')}"
_FIRST = f"regexp_replace(string_split(segment, ',')[1], '{_STRIP}', '', 'g')"
CASCADE = rf"""{SEGMENTS}, {SQL_COUNTRIES}, {KNOWN}, d AS (SELECT segment, count(*) AS n FROM seg GROUP BY segment), {HINTS}, cut AS (SELECT segment, trim(regexp_extract(segment, '^[^,]+,(.*)$', 1)) AS rest FROM d WHERE regexp_matches(lower(segment), '{_UNIT}') AND contains(segment, ',')),
  hit AS (SELECT segment, CASE WHEN ror_id IS NULL THEN 0 ELSE 1 END AS step, 0 AS k, override_id FROM d JOIN known ON form = {_NORM('segment')} UNION ALL SELECT segment, 2, len(string_split(segment, ',')) - i, o.override_id FROM d, {_WALK('segment')}
    UNION ALL SELECT segment, 3, len(string_split(rest, ',')) - i, o.override_id FROM (SELECT * FROM cut WHERE length(rest) > 10) q, {_WALK('rest')}
    UNION ALL SELECT d.segment, 4, h.k, acr.override_id FROM d JOIN hinted h USING (segment) JOIN acr ON acr.iso2 = h.iso2 AND acr.acronym = {_FIRST}
    UNION ALL SELECT d.segment, 4, turn.k, acr.override_id FROM d JOIN acr ON acr.acronym = {_FIRST} JOIN turn USING (iso2) WHERE d.segment NOT IN (SELECT segment FROM hinted)),
  best AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY step, k, override_id) AS r FROM hit),
  resolved AS (SELECT d.segment, d.n, {METHODS}[coalesce(step, 5) + 1] AS method, CASE WHEN step > 0 THEN override_id END AS override_id, CASE WHEN step = 1 THEN 1.0 WHEN step >= 2 THEN 100.0 ELSE 0.0 END::DOUBLE AS score FROM d LEFT JOIN (SELECT * FROM best WHERE r = 1) b USING (segment))""".replace(str(METHODS), str(list(METHODS)))


@query(f"WITH {CASCADE} SELECT segment, method, override_id, score FROM resolved")
def override_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct affiliation with the known organisation it resolves to by the exact steps, and by which."""
    return cascade(spark, folder).drop("n")


@query(f"WITH {CASCADE} SELECT method, count(*) AS n_segments, sum(n)::BIGINT AS n_uses FROM resolved GROUP BY method")
def method_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many affiliations each exact step resolves, distinct and in all."""
    return cascade(spark, folder).groupBy("method").agg(F.count("*").alias("n_segments"), F.sum("n").alias("n_uses"))


def roll_up(found: DataFrame, places: DataFrame) -> DataFrame:
    """For each record its affiliations, how many are resolved, and the organisations, methods and countries in order, each organisation at its first sight.

    found: row_id, pos, method, override_id. places: override_id, iso2. What is gathered
    for a record comes from its one cell.
    """
    one = F.struct("pos", "override_id", "method", "iso2")
    g = found.join(places, "override_id", "left").groupBy("row_id").agg(F.count("*").alias("n_segments"), F.count("override_id").alias("n_matched"), F.array_sort(F.collect_list(F.when(F.col("override_id").isNotNull(), one))).alias("l"))
    g = g.withColumn("ids", F.col("l.override_id"))
    first = F.filter("l", lambda x, i: F.array_position(F.col("ids"), x["override_id"]) == i + 1)
    g = g.withColumn("l", first)
    joined = lambda c: F.array_join(c, ";")
    countries_ = F.array_distinct(F.filter("l.iso2", lambda x: x.isNotNull()))
    return g.select("row_id", "n_segments", "n_matched", joined(F.transform("l.override_id", lambda x: x.cast("string"))).alias("ids"), joined("l.method").alias("methods"), joined(countries_).alias("countries"))


@query(f"""WITH {CASCADE}, j AS (SELECT seg.row_id, seg.pos, r.method, r.override_id, i.iso2 FROM seg JOIN resolved r USING (segment) LEFT JOIN inst i USING (override_id)),
  o AS (SELECT row_id, override_id, min(pos) AS pos, arg_min(method, pos) AS method, any_value(iso2) AS iso2 FROM j WHERE override_id IS NOT NULL GROUP BY ALL),
  c AS (SELECT row_id, iso2, min((pos, override_id)) AS pos FROM o WHERE iso2 IS NOT NULL GROUP BY ALL)
  SELECT j.row_id, count(*) AS n_segments, count(j.override_id) AS n_matched, coalesce(any_value(x.ids), '') AS ids, coalesce(any_value(x.methods), '') AS methods, coalesce(any_value(y.countries), '') AS countries
  FROM j LEFT JOIN (SELECT row_id, string_agg(override_id::VARCHAR, ';' ORDER BY pos, override_id) AS ids, string_agg(method, ';' ORDER BY pos, override_id) AS methods FROM o GROUP BY row_id) x USING (row_id)
  LEFT JOIN (SELECT row_id, string_agg(iso2, ';' ORDER BY pos) AS countries FROM c GROUP BY row_id) y USING (row_id) GROUP BY j.row_id""")
def record_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """For each record: its affiliations, how many are resolved, and to which organisations, by which steps and in which countries, in order."""
    found = segments(spark, folder).join(cascade(spark, folder).select("segment", "method", "override_id"), "segment")
    return roll_up(found, institutions(spark, folder).select("override_id", "iso2"))


_STUB_WORDS = lambda c: rf"string_split_regex({c}, '[^\p{{L}}\p{{N}}_]+')"
_INST = lambda c: f"list_has_any({_STUB_WORDS(c)}, {list(INSTITUTION_WORDS)})"
_PLACES = f"(SELECT lower(country) FROM countries UNION ALL SELECT lower(official) FROM countries UNION ALL SELECT unnest({[n.replace(chr(39), chr(39) * 2) for n in OTHER_NAMES]}))".replace('"', "'")
_POSTAL = f"(len(list_filter({_STUB_WORDS('v')}, lambda x: regexp_matches(x, '^[0-9]{{4,6}}$'))) > 0 OR contains(' ' || array_to_string({_STUB_WORDS('v')}, ' ') || ' ', ' po box ') OR contains(' ' || array_to_string({_STUB_WORDS('v')}, ' ') || ' ', ' p o box '))"


@query(rf"""WITH {SQL_COUNTRIES}, s AS (SELECT override_id, lower(trim(raw_string)) AS v, list_transform(string_split(lower(trim(raw_string)), ','), lambda x: trim(x)) AS p FROM manual_overrides)
  SELECT override_id, CASE WHEN v IN {_PLACES} THEN 'country' WHEN len(p) = 2 AND p[2] IN {_PLACES} AND NOT {_INST('p[1]')} THEN 'city and country'
    WHEN {_POSTAL} AND NOT {_INST('v')} THEN 'address' WHEN p[1] IN {ROLES} THEN 'role' END AS stub FROM s""")
def stub_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Reviewed strings that name no institution: a country, a place, an address, or a role; the first that fits.

    A string names an institution if one of its words is on the list of such words. An
    address holds a number of four to six digits or a post box.
    """
    known = sorted({n.lower() for r in country_rows() for n in (r[2], r[3])} | set(OTHER_NAMES))
    v = F.lower(F.trim("raw_string"))
    p = F.transform(F.split(v, ","), lambda x: F.trim(x))
    words = lambda c: F.split(c, r"[^\p{L}\p{N}_]+")
    inst = lambda c: F.arrays_overlap(words(c), F.array(*map(F.lit, INSTITUTION_WORDS)))
    line = F.concat(F.lit(" "), F.array_join(words(v), " "), F.lit(" "))
    postal = F.exists(words(v), lambda w: w.rlike("^[0-9]{4,6}$")) | line.contains(" po box ") | line.contains(" p o box ")
    stub = (
        F.when(v.isin(known), "country")
        .when((F.size(p) == 2) & F.get(p, F.lit(1)).isin(known) & ~inst(F.get(p, F.lit(0))), "city and country")
        .when(postal & ~inst(v), "address")
        .when(F.get(p, F.lit(0)).isin(*ROLES), "role")
    )
    return table(spark, folder, "manual_overrides").select("override_id", stub.alias("stub"))


#: Texts, and names, of one block; the texts' likeliest names are sought among all of the block.
BLOCK, NAMES = 4000, 20_000


def _best(k: int, **limits: float):
    """For each two blocks the k best names of each text, of equals those listed first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("x", pa.string()), ("place", pa.string()), ("override_id", pa.int64()), ("score", pa.float64())])
        for b in batches:
            for row in b.to_pylist():
                texts, names = row["texts"], row["names"]
                ranked = (sorted((-v, names[j]["override_id"]) for v, j in best)[:k] for best in nearest(texts, [n["y"] for n in names], k, **limits))
                found = [(x, row["place"], o, -v) for x, best in zip(texts, ranked) for v, o in best]
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t.type) for c, t in enumerate(schema)], schema=schema)

    return run


@query()
def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Unresolved affiliations of at least five records with the three most similar known names of their country.

    Names are scored by the best-window ratio. One whose country has no known name comes once, without a name.
    """
    open_ = checkpoint(cascade(spark, folder).where("method = 'unresolved' and n >= 5").select("segment", F.col("n").alias("freq"), T.normal_name(F.col("segment")).alias("x")))
    scored = _scored(spark, folder, open_, 3)
    best = Window.partitionBy("segment").orderBy(F.desc("score"), "override_id")
    return scored.withColumn("rank", F.row_number().over(best)).where("rank <= 3").select("segment", "freq", "rank", "override_id", F.round("score", 6).alias("score"))


@query(rf"""WITH {SQL_COUNTRIES}, s AS (SELECT row_id, lower(affiliations) AS a FROM raw_publications), m AS (SELECT row_id, country, length(country) AS n FROM s JOIN countries c ON contains(s.a, lower(c.country)))
  SELECT country, count(*) AS n FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.row_id = a.row_id AND b.n > a.n AND contains(b.country, a.country)) GROUP BY country""")
def like_join(spark: SparkSession, folder: str) -> DataFrame:
    """Records by country whose name their affiliations contain, a longer name hiding those inside it.

    The list of names is fixed and small, so each record is tested against all of it in one expression.
    """
    names = sorted((r.country for r in countries(spark).collect()), key=lambda n: (-len(n), n))
    # by first letter, longest first within each, so that few branches are tried at a place
    heads: dict[str, list[str]] = {}
    for n in names:
        heads.setdefault(n[0].lower(), []).append(n[1:].lower())
    pattern = "|".join(f"{h}(?:{'|'.join(rest)})" for h, rest in sorted(heads.items()))
    s = table(spark, folder, "raw_publications").select(F.array_distinct(F.regexp_extract_all(F.lower("affiliations"), F.lit(pattern), F.lit(0))).alias("f"))
    longer = spark.createDataFrame([(a, a.lower(), [b.lower() for b in names if a != b and a in b]) for a in names], "country string, name string, longer array<string>")
    found = s.select(F.explode("f").alias("name"), "f").join(F.broadcast(longer), "name")
    return found.where(~F.arrays_overlap("f", "longer")).groupBy("country").agg(F.count("*").alias("n"))


#: Listed ends of a label, of which later ones may stand before earlier ones.
_ENDS = "(?i)" + "".join(rf"(?:\s*{end})?" for end in reversed(LABEL_ENDS)) + "$"


@query(rf"""WITH {SEGMENTS}, s AS (SELECT DISTINCT segment FROM seg), m(long, short) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in SHORT_NAMES.items())}), p AS (SELECT segment, regexp_replace(regexp_replace(trim(regexp_replace(segment, '\s*\([^)]*\)', '', 'g')), '(?i)\buniversity\b', 'Univ.', 'g'), '(?i)\buniversities\b', 'Univs.', 'g') AS t FROM s),
  e AS (SELECT segment, trim(regexp_replace(t, '{_ENDS}', '')) AS t FROM p), c AS (SELECT segment, CASE WHEN short IS NOT NULL THEN short WHEN regexp_matches(t, '^\p{{Ll}}') THEN upper(t[1]) || t[2:] ELSE t END AS t FROM e LEFT JOIN m ON long = lower(t)), k AS (SELECT segment, t, regexp_extract(t || ' ', '^(.{{1,30}})\s', 1) AS x FROM c)
  SELECT segment, CASE WHEN length(t) <= 30 THEN t WHEN x = '' THEN substring(t, 1, 30) ELSE trim(x) END AS label FROM k""")
def short_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels for charts: no brackets, short forms, listed places off the end, listed short names, a capital first, at most 30 characters of whole words."""
    s = segments(spark, folder).select("segment").distinct()
    t = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace("segment", r"\s*\([^)]*\)", "")), r"(?i)\buniversity\b", "Univ."), r"(?i)\buniversities\b", "Univs.")
    s = s.select("segment", F.trim(F.regexp_replace(t, _ENDS, "")).alias("t"))
    short = F.try_element_at(F.create_map(*(F.lit(v) for pair in SHORT_NAMES.items() for v in pair)), F.lower("t"))
    capital = F.when(F.col("t").rlike(r"^\p{Ll}"), F.concat(F.upper(F.substring("t", 1, 1)), F.substring("t", 2, 1 << 30))).otherwise(F.col("t"))
    return s.select("segment", F.coalesce(short, capital).alias("t")).select("segment", T.cut_words(F.col("t"), 30).alias("label"))


def _scored(spark: SparkSession, folder: str, open_: DataFrame, k: int, **limits: float) -> DataFrame:
    """Rows (segment, override_id, freq, score): affiliations with at least the k most similar of all known names of the countries they hint at.

    Distinct spellings meet a country's distinct names block by block; names are left
    out only where an upper bound of their ratio is below the k-th best, or what limits
    ask for. An affiliation without a hint, or without any name, has one row without
    override_id and score.
    """
    names = institutions(spark, folder).select(T.normal_name(F.col("name")).alias("y"), "iso2", "override_id").where("iso2 is not null and length(y) > 10")
    names = names.groupBy("iso2", "y").agg(F.min("override_id").alias("override_id"))
    open_ = open_.withColumn("h", hints(F.col("segment")))
    texts = open_.select(F.explode("h").alias("iso2"), "x").distinct()
    # texts with the same last words share most of their work; of too many of them each has a block by chance
    words = F.substring_index(F.trim(F.regexp_replace("x", "[0-9 ]+", " ")), " ", -3)
    n = texts.groupBy("iso2").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    texts = texts.join(n, "iso2").select("iso2", "x", F.pmod(F.xxhash64(words), F.col("n")).alias("part"))
    n = texts.groupBy("iso2", "part").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("n"))
    texts = texts.join(n, ["iso2", "part"]).groupBy("iso2", "part", F.pmod(F.xxhash64("x"), F.col("n")).alias("texts_block")).agg(F.collect_list("x").alias("texts"))
    n = names.groupBy("iso2").agg(F.ceil(F.count("*") / NAMES).alias("n"))
    names = names.join(n, "iso2").groupBy("iso2", F.pmod(F.xxhash64("y"), F.col("n")).alias("names_block")).agg(F.collect_list(F.struct("y", "override_id")).alias("names"))
    pairs = texts.join(names, "iso2").repartition(4 * partitions(spark), "iso2", "part", "texts_block", "names_block").select(F.col("iso2").alias("place"), "texts", "names")
    best = pairs.mapInArrow(_best(k, **limits), "x string, place string, override_id bigint, score double")
    each = open_.select("segment", "freq", "x", F.explode_outer("h").alias("place"))
    out = each.join(best, ["x", "place"], "left").select("segment", "override_id", "freq", "score")
    # where one of several countries has no name the others' rows are enough
    some = F.max(F.col("override_id").isNotNull()).over(Window.partitionBy("segment"))
    return out.withColumn("some", some).where("override_id is not null or not some").drop("some").distinct()


#: A best score of that much is accepted if it leads the next by the gap.
ACCEPT, GAP = 92.0, 5.0


def _judged(spark: SparkSession, folder: str, open_: DataFrame, **limits: float) -> DataFrame:
    """Rows (segment, freq, best, next, method, first_id) of scored affiliations."""
    order = Window.partitionBy("segment").orderBy(F.desc("score"), "override_id")
    top = _scored(spark, folder, open_, 2, **limits).withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy("segment", "freq").agg(
        F.max(F.when(F.col("r") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("next"), F.max(F.when(F.col("r") == 1, F.col("override_id"))).alias("first_id")
    )
    gap = F.col("best") - F.coalesce("next", F.lit(0.0))
    method = F.when((F.col("best") >= ACCEPT) & (gap >= GAP), "fuzzy").when((F.col("best") == 100) & (F.col("next") == 100), "fuzzy_tiebreak_first").when(F.col("best") == 100, "fuzzy_tiebreak").otherwise("unresolved")
    return top.withColumn("method", method)


@query()
def fuzzy_match_top2(spark: SparkSession, folder: str) -> DataFrame:
    """Unresolved affiliations with their best known name of their countries by the best-window ratio, and how it's judged.

    Accepted at 92 or more if it leads the next name by 5; of several perfect ones the
    first is taken and marked so; all else stays unresolved. All candidates are of a
    country that is hinted at, so none can be preferred for its country.
    """
    open_ = checkpoint(cascade(spark, folder).where("method = 'unresolved'").select("segment", F.col("n").alias("freq"), T.normal_name(F.col("segment")).alias("x")))
    top = _judged(spark, folder, open_)
    return top.select("segment", "freq", F.round("best", 6).alias("best"), F.round("next", 6).alias("next"), "method", F.when(F.col("method") != "unresolved", F.col("first_id")).alias("override_id"))


def resolved(spark: SparkSession, folder: str, floor: float = 0.0) -> DataFrame:
    """All steps of the cascade, the scored ones last: segment, n, method, override_id, score.

    The next best name is sought only where it can decide. Scores below floor may be
    missing; up to ACCEPT - GAP it changes nothing else.
    """
    done = checkpoint(cascade(spark, folder))
    open_ = done.where("method = 'unresolved'").select("segment", F.col("n").alias("freq"), T.normal_name(F.col("segment")).alias("x"))
    top = _judged(spark, folder, open_, gap=GAP, accept=ACCEPT, floor=floor)
    found = top.select("segment", F.col("freq").alias("n"), "method", F.when(F.col("method") != "unresolved", F.col("first_id")).alias("override_id"), F.coalesce("best", F.lit(0.0)).alias("score"))
    return done.where("method <> 'unresolved'").unionByName(found)


@query()
def affiliation_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct affiliation with the known organisation it resolves to by all steps, by which, and the score to two digits."""
    return resolved(spark, folder).select("segment", "n", "method", "override_id", F.format_string("%.2f", "score").alias("score"))


@query()
def standardised_records(spark: SparkSession, folder: str) -> DataFrame:
    """The roll-up of each record by all steps."""
    found = segments(spark, folder).join(resolved(spark, folder, ACCEPT - GAP).select("segment", "method", "override_id"), "segment")
    return roll_up(found, institutions(spark, folder).select("override_id", "iso2"))


@query(rf"""WITH {SEGMENTS}, {SQL_COUNTRIES}, {KNOWN}, d AS (SELECT DISTINCT segment FROM seg), {HINTS}, a AS (SELECT segment, {_FIRST} AS acronym FROM d WHERE regexp_matches({_FIRST}, '^[A-Z]{{2,10}}$')),
  hit AS (SELECT segment, h.k, acr.override_id FROM a JOIN hinted h USING (segment) JOIN acr USING (iso2, acronym) UNION ALL SELECT segment, turn.k, acr.override_id FROM a JOIN acr USING (acronym) JOIN turn USING (iso2) WHERE segment NOT IN (SELECT segment FROM hinted))
  SELECT a.segment, acronym, arg_min(override_id, (k, override_id)) AS override_id FROM a LEFT JOIN hit USING (segment) GROUP BY ALL""")
def acronym_match(spark: SparkSession, folder: str) -> DataFrame:
    """Affiliations whose first part is an acronym of two to ten capitals, and the known organisation that gives it in brackets."""
    d = segments(spark, folder).select("segment").distinct()
    a = d.select("segment", T.strip(F.substring_index("segment", ",", 1)).alias("acronym")).where(F.col("acronym").rlike("^[A-Z]{2,10}$"))
    hit = _acronyms(spark, folder, d).groupBy("segment").agg(F.min(F.struct("k", "override_id"))["override_id"].alias("override_id"))
    return a.join(hit, "segment", "left").select("segment", "acronym", "override_id")


@query(f"""WITH {CASCADE}, b AS (SELECT segment, n, method AS new_method, CASE WHEN method = 'exact_stripped' THEN 'unresolved' ELSE method END AS old_method FROM resolved)
  SELECT old_method, new_method, count(*) AS n_segments, sum(n)::BIGINT AS n_uses FROM b GROUP BY ALL""")
def rule_impact(spark: SparkSession, folder: str) -> DataFrame:
    """What taking off unit labels changes: each affiliation's method without that step and with it, weighted by use."""
    new = cascade(spark, folder)
    old = F.when(F.col("method") == "exact_stripped", "unresolved").otherwise(F.col("method"))
    return new.groupBy(old.alias("old_method"), F.col("method").alias("new_method")).agg(F.count("*").alias("n_segments"), F.sum("n").alias("n_uses"))


@query(rf"""WITH {CASCADE}, c AS (SELECT segment, n, lower(regexp_replace(list_extract(string_split(segment, ','), -1), '{_STRIP}', '', 'g')) IN (SELECT lower(country) FROM countries) AS listed FROM resolved WHERE method = 'unresolved')
  SELECT listed, count(*) AS n_segments, sum(n)::BIGINT AS n_uses, round(100 * sum(n) / sum(sum(n)) OVER (), 6) AS share FROM c GROUP BY listed""")
def review_split(spark: SparkSession, folder: str) -> DataFrame:
    """Unresolved affiliations of the listed countries and of others, with their share of uses."""
    last = F.lower(T.strip(F.element_at(F.split("segment", ","), -1)))
    u = cascade(spark, folder).where("method = 'unresolved'").withColumn("listed", last.isin([r[2].lower() for r in country_rows()]))
    g = u.groupBy("listed").agg(F.count("*").alias("n_segments"), F.sum("n").alias("n_uses"))
    return g.withColumn("share", F.round(100 * F.col("n_uses") / F.sum("n_uses").over(Window.partitionBy()), 6))


@query(rf"""WITH {SQL_COUNTRIES}, t AS (SELECT override_id, regexp_replace(list_extract(string_split(raw_string, ','), -1), '{_STRIP}', '', 'g') AS name FROM manual_overrides)
  SELECT t.override_id, t.name, coalesce(a.subregion, b.subregion) AS subregion FROM t LEFT JOIN countries a ON a.country = t.name LEFT JOIN countries b ON b.official = t.name""")
def two_key_country_join(spark: SparkSession, folder: str) -> DataFrame:
    """The subregion of each reviewed string's last part, by the country's name or else its official name."""
    c = countries(spark)
    t = table(spark, folder, "manual_overrides").select("override_id", T.strip(F.element_at(F.split("raw_string", ","), -1)).alias("name"))
    t = t.join(F.broadcast(c.select(F.col("country").alias("name"), F.col("subregion").alias("x"))), "name", "left")
    t = t.join(F.broadcast(c.select(F.col("official").alias("name"), F.col("subregion").alias("y"))), "name", "left")
    return t.select("override_id", "name", F.coalesce("x", "y").alias("subregion"))


@query(f"""WITH {CASCADE}, {PUBS}, x AS (SELECT DISTINCT seg.row_id, r.override_id FROM seg JOIN resolved r USING (segment) WHERE override_id IS NOT NULL), t AS (SELECT override_id, count(*) AS n, sum(cites) AS c FROM x JOIN pubs USING (row_id) GROUP BY 1)
  SELECT t.override_id, trim(i.name) AS name, i.iso2 AS country, n, round(c, 3) AS citations, round(c / n, 6) AS per_record FROM t JOIN inst i USING (override_id) ORDER BY n DESC, override_id LIMIT 30""")
def top_institutions(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty known organisations with most records by the exact steps; unknown ones drop out before the limit, ties go to the smaller id."""
    found = segments(spark, folder).join(cascade(spark, folder).where("override_id is not null").select("segment", "override_id"), "segment")
    x = found.select("row_id", "override_id").distinct().join(publications(spark, folder).select("row_id", "cites"), "row_id")
    t = x.groupBy("override_id").agg(F.count("*").alias("n"), F.sum("cites").alias("c")).join(institutions(spark, folder), "override_id")
    t = t.orderBy(F.desc("n"), "override_id").limit(30)
    return t.select("override_id", F.trim("name").alias("name"), F.col("iso2").alias("country"), "n", F.round("c", 3).alias("citations"), F.round(F.col("c") / F.col("n"), 6).alias("per_record"))
