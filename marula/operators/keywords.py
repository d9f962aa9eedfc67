"""A rule-based thesaurus: which keyword forms are rewritten to which, and its use on packed cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marula.functions import text as T


def _dim(spark, table: dict[str, str], name: str) -> DataFrame:
    return spark.createDataFrame(list(table.items()), f"term string, {name} string")


def rewrite_rules(vocabulary: DataFrame, american: dict[str, str], acronyms: dict[str, str], synonyms: dict[str, str]) -> DataFrame:
    """Rows (source_term, preferred_term, rule_type): the first rule that rewrites each term of the vocabulary.

    vocabulary: term (distinct). Order: American spelling, plural (of "ies" only the
    "y" form is tried), hyphen left out, acronym, synonym. A plural or hyphen counts
    only if the other form is in the vocabulary too. Acronyms and synonyms hold even
    for terms outside the vocabulary.
    """
    spark = vocabulary.sparkSession
    v = vocabulary.select("term")
    ies, one = F.col("term").endswith("ies"), F.col("term").endswith("s") & (F.length("term") > 5)
    singular = F.when(ies, F.regexp_replace("term", "ies$", "y")).when(one, F.regexp_replace("term", "s$", ""))
    solid = F.when(F.col("term").contains("-"), F.replace("term", F.lit("-"), F.lit("")))
    forms = v.select("term", singular.alias("singular"), solid.alias("solid"))
    forms = forms.join(v.select(F.col("term").alias("singular"), F.lit(True).alias("has_singular")), "singular", "left")
    forms = forms.join(v.select(F.col("term").alias("solid"), F.lit(True).alias("has_solid")), "solid", "left")
    for table, name in ((american, "american"), (acronyms, "acronym"), (synonyms, "synonym")):
        forms = forms.join(F.broadcast(_dim(spark, table, name)), "term", "left")
    rules = [("british_american", F.col("american"), F.col("american").isNotNull()), ("plural_singular", F.col("singular"), F.col("has_singular")), ("hyphen", F.col("solid"), F.col("has_solid")),
             ("acronym_expansion", F.col("acronym"), F.col("acronym").isNotNull()), ("synonym_map", F.col("synonym"), F.col("synonym").isNotNull())]
    rule, to = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, form, when in reversed(rules):
        rule, to = F.when(when, name).otherwise(rule), F.when(when, form).otherwise(to)
    found = forms.select(F.col("term").alias("source_term"), to.alias("preferred_term"), rule.alias("rule_type")).where("rule_type is not null")
    always = [(a, b, "acronym_expansion") for a, b in acronyms.items()] + [(a, b, "synonym_map") for a, b in synonyms.items()]
    extra = spark.createDataFrame(always, "source_term string, preferred_term string, rule_type string")
    return found.unionByName(extra.join(found.select("source_term"), "source_term", "left_anti"))


#: Most rules that go into every row's expression.
IN_ROW = 2_000


def harmonise(cells: DataFrame, rules: DataFrame, delimiter: str = "; ") -> DataFrame:
    """cells (row_id, cell) with keywords (lower-cased, rewritten once) and n_changed, of cells with a keyword.

    A counted list of rules is looked up in the row, so nothing is shuffled; a longer
    one is joined keyword by keyword and the cells are put together again in order.
    """
    listed = rules.select(F.col("source_term").alias("term"), "preferred_term").where("term is not null and preferred_term is not null")
    found = listed.limit(IN_ROW + 1).collect()
    if len(found) > IN_ROW:
        return _harmonise_joined(cells, listed, delimiter)
    pairs = [F.lit(v) for r in found for v in (r.term, r.preferred_term)]
    terms = cells.select("row_id", F.transform(T.split_values(F.col("cell"), delimiter), F.lower).alias("t")).where(F.size("t") > 0)
    to = F.transform("t", lambda x: F.coalesce(F.try_element_at(F.create_map(*pairs), x), x)) if pairs else F.col("t")
    both = terms.select("row_id", "t", to.alias("to"))
    changed = F.aggregate(F.zip_with("t", "to", lambda a, b: (a != b).cast("bigint")), F.lit(0).cast("bigint"), lambda n, x: n + x)
    return both.select("row_id", F.array_join("to", "; ").alias("keywords"), changed.alias("n_changed"))


def _harmonise_joined(cells: DataFrame, listed: DataFrame, delimiter: str) -> DataFrame:
    each = cells.select("row_id", F.posexplode(T.split_values(F.col("cell"), delimiter)).alias("pos", "k"))
    mapped = each.select("row_id", "pos", F.lower("k").alias("term")).join(listed, "term", "left")
    to = F.coalesce("preferred_term", "term")
    groups = mapped.select("row_id", "pos", to.alias("to"), (to != F.col("term")).cast("bigint").alias("c")).groupBy("row_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "to"))), lambda x: x["to"])
    return groups.agg(F.array_join(ordered, "; ").alias("keywords"), F.sum("c").alias("n_changed"))


def without_terms(words: Column, terms: Sequence[str]) -> Column:
    """An array of keywords without the listed ones, in whatever case; order and repetitions stay, null if none is left."""
    kept = F.filter(words, lambda x: ~F.lower(x).isin(*terms))
    return F.when(F.size(kept) > 0, kept)
