"""The queries of the problems tagged llm, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marula.llm import canonical_terms, components, cooccurrence, format_copies, leaks, lookalikes, mixing, names, reading_level
from marula.operators import segmentation as S
from marula.plans import packed
from marula.session import table, written


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return format_copies.collapse_copies(table(spark, folder, "raw_publications"), "row_id", ["title"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = components.connected_components(table(spark, folder, "dedup_log"), "removed_row_id", "kept_row_id")
    return found.select(F.col("vertex").alias("row_id"), F.col("seed").alias("group_id"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.link_records(table(spark, folder, "raw_publications"), table(spark, folder, "manual_overrides"))


def _baskets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_publications")
    packings = {"author_keywords": S.KEYWORDS, "affiliations": S.AFFILIATIONS}
    cells = S.field_cells(rows, "row_id", packings).where(F.col("cell").isNotNull())
    split = S.split_cells(cells, packings)
    country = F.filter(
        F.transform("items", lambda x: F.lower(F.trim(F.element_at(F.split(x, ","), -1)))), lambda x: x != ""
    )
    items = F.when(F.col("field_name") == "affiliations", country).otherwise(F.transform("items", lambda x: F.lower(x)))
    return written(split.select("field_name", F.array_distinct(items).alias("items")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cooccurrence.frequent_pairs(_baskets(spark, folder), min_rows=8, min_share=0.002, min_lift=4)
    return pairs.select("field_name", "item_a", "item_b")


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs with their counts and how much more often than by chance they occur."""
    return cooccurrence.frequent_pairs(_baskets(spark, folder), min_rows=8, min_share=0.002, min_lift=4)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    cases = F.array(*map(F.lit, lookalikes.KINDS[:6]))
    return _disguised(spark, folder).where(F.arrays_overlap("kinds", cases)).select("row_id", "field_name")


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The affected values beside their consistent form, and what was found in them."""
    return _disguised(spark, folder).withColumn("kinds", F.array_join("kinds", ","))


def _disguised(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.disguised_values(table(spark, folder, "raw_publications"), "row_id", ["title", "affiliations"])


def _mapped(spark: SparkSession, folder: str) -> DataFrame:
    rows, listed = table(spark, folder, "keyword_entries"), table(spark, folder, "thesaurus")
    return canonical_terms.map_terms(rows, "entry_id", "typed_term", listed, "source_term", "preferred_term")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mapped(spark, folder).select("entry_id", "preferred_term")


def p7_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The typed values that no entry of the list fits, and how often each was typed."""
    found = _mapped(spark, folder).where(F.col("preferred_term") == canonical_terms.UNMATCHED)
    return found.groupBy("typed_term").agg(F.count("*").alias("n_rows"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "eval_items")
    return leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "passage", min_words=12)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Each affected document without its leaked spans; null where they cover more than half of it."""
    found = _leaks(spark, folder)
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.max("longest").alias("longest"), F.max("n_words").alias("n_words"), F.max("clean_text").alias("clean_text")
    )


#: The public tokenizer whose tokens are counted; lies outside the repository.
RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p9_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The selected documents with their source, uses and tokens, and the share that their source reaches."""
    selection, shares = mixing.select_mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), RANKS_FILE)
    return selection.join(F.broadcast(shares.select("source", "target_share", "reached_share")), "source")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.select_mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), RANKS_FILE)[1]


LEVELS = ("plain", "general", "advanced", "specialist")


def _levels(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    model = reading_level.fit(table(spark, folder, "graded_samples"), "sample_text", "reading_level", LEVELS)
    return reading_level.estimate(docs, "doc_id", "text", model)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where(F.col("lang") == "en")
    return _levels(spark, folder, docs).select("doc_id", "reading_level")


def p10_profile(spark: SparkSession, folder: str) -> DataFrame:
    """How many English documents of each source have which level, and their mean grade."""
    docs = table(spark, folder, "documents").where(F.col("lang") == "en")
    found = _levels(spark, folder, docs).join(docs.select("doc_id", "source"), "doc_id")
    return found.groupBy("source", "reading_level").agg(F.count("*").alias("n_docs"), F.avg("mean_grade").alias("mean_grade"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p5_found": p5_found,
    "p5_forms": p5_forms,
    "p7_found": p7_found,
    "p7_unmatched": p7_unmatched,
    "p8_found": p8_found,
    "p8_clean": p8_clean,
    "p9_selection": p9_selection,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_profile": p10_profile,
}
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_GRAMS = "(SELECT DISTINCT {id}, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT {id}, {words} AS w FROM {table}) t, unnest(generate_series(1, len(w) - 11)) AS u(i))"
_LOOKS = "".join(lookalikes.LOOKS)
_PAIRS = f"""{packed.items_sql()}, it AS (SELECT DISTINCT row_id, field_name, CASE WHEN field_name = 'affiliations' THEN lower(trim(list_extract(string_split(item, ','), -1))) ELSE lower(item) END AS item FROM v WHERE field_name <> 'authors'),
  ok AS (SELECT * FROM it WHERE item <> ''), n AS (SELECT field_name, count(DISTINCT row_id) AS n_rows FROM ok GROUP BY 1), s AS (SELECT field_name, item, count(*) AS n FROM ok GROUP BY ALL HAVING count(*) >= 8), f AS (SELECT ok.*, s.n FROM ok JOIN s USING (field_name, item)),
  ab AS (SELECT a.field_name, a.item AS item_a, b.item AS item_b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS n_ab FROM f a JOIN f b ON a.field_name = b.field_name AND a.row_id = b.row_id AND a.item < b.item GROUP BY ALL),
  pairs AS (SELECT * FROM ab JOIN n USING (field_name) WHERE n_ab >= 8 AND n_ab >= 0.002 * n_rows AND n_ab * n_rows >= 4 * n_a * n_b)"""

SQL = {
    "p1_found": r"""WITH t AS (SELECT row_id, array_to_string(list_sort(list_filter(string_split(regexp_replace(regexp_replace(lower(nfc_normalize(title)), '[\p{Pd}−''‘’ʼʹ＇`´]|[\s\p{Z}\x{85}]', ' ', 'g'), '[^\p{L}\p{N}\p{M} ]', '', 'g'), ' '), lambda x: x <> '')), ' ') AS k
      FROM raw_publications WHERE title IS NOT NULL) SELECT min(row_id) AS first_row_id, count(*) AS n_copies FROM t WHERE k <> '' GROUP BY k HAVING count(*) >= 2""",
    "p2_found": """WITH RECURSIVE e AS (SELECT removed_row_id AS a, kept_row_id AS b FROM dedup_log WHERE removed_row_id IS NOT NULL AND kept_row_id IS NOT NULL), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
      r(v, seed) AS (SELECT a, a FROM l UNION SELECT l.b, r.seed FROM r JOIN l ON l.a = r.v) SELECT v AS row_id, min(seed) AS group_id FROM r GROUP BY v""",
    "p4_found": f"WITH {_PAIRS} SELECT field_name, item_a, item_b FROM pairs",
    "p4_pairs": f"WITH {_PAIRS} SELECT field_name, item_a, item_b, n_a, n_b, n_ab, n_rows, n_ab::DOUBLE * n_rows / (n_a * n_b) AS lift FROM pairs",
    "p5_found": "SELECT row_id, field_name FROM (SELECT row_id, 'title' AS field_name, title AS v FROM raw_publications UNION ALL SELECT row_id, 'affiliations', affiliations FROM raw_publications) WHERE regexp_matches(v, '"
    + "|".join(
        (
            rf"[{lookalikes.WIDE}{lookalikes.JOINED}{lookalikes.BLANK_MARKS}]",
            r"\p{L}[\x{300}-\x{36F}]",
            r"\p{Cf}",
            r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]",
            rf"\p{{Latin}}[{_LOOKS}]|[{_LOOKS}]\p{{Latin}}|(^|[^\p{{L}}])[{_LOOKS}]+([^\p{{L}}]|$)",
        )
    )
    + "')",
    "p8_found": f"""SELECT DISTINCT doc_id, item_id FROM {_GRAMS.format(id="doc_id", words=_WORDS.format("text"), table="documents")} d
      JOIN {_GRAMS.format(id="item_id", words=_WORDS.format("passage"), table="eval_items")} i USING (g)""",
}
