"""Queries of problem 6: several values packed in one field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marula.operators import segmentation as S
from marula.session import table

FIELDS = {"author_keywords": S.KEYWORDS, "affiliations": S.AFFILIATIONS, "authors": S.AUTHORS}


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Single values of the rows that the statement of problem 6 asks for; all rows teach the dictionary."""
    rows = table(spark, folder, "raw_publications")
    cells = S.field_cells(rows, "row_id", FIELDS)
    known = S.learn_entries(cells, FIELDS)
    asked = S.field_cells(rows.where(F.col("row_id") % 10 == 0), "row_id", FIELDS).where(F.col("cell").isNotNull())
    return S.explode_items(S.split_cells(asked, FIELDS, dictionary=known), "row_id")


def p6_values(spark: SparkSession, folder: str) -> DataFrame:
    """For each field and value of all rows: in how many cells it stands, and its lowest and highest position."""
    rows = table(spark, folder, "raw_publications")
    cells = S.field_cells(rows, "row_id", FIELDS).where(F.col("cell").isNotNull())
    items = S.explode_items(S.split_cells(cells, FIELDS), "row_id")
    return items.groupBy("field_name", "item").agg(
        F.count("*").alias("n_values"), F.min("item_pos").alias("first_pos"), F.max("item_pos").alias("last_pos")
    )


def items_sql(where: str = "TRUE") -> str:
    """CTEs up to v(row_id, field_name, item_pos, item): the same split by patterns, for cells without delimiters inside bare values."""
    cells = " UNION ALL ".join(f"SELECT row_id, '{f}' AS field_name, {f} AS cell FROM raw_publications" for f in FIELDS)
    return rf"""c AS (SELECT row_id, field_name, cell FROM ({cells}) WHERE cell IS NOT NULL AND {where}),
      b AS (SELECT *, regexp_replace(cell, '(^|[;|\n•,])[ \t]*"(?:[^"]|"")*"', '\1', 'g') AS bare FROM c),
      k AS (SELECT *, regexp_matches(bare, '[;|\n•]') AS strong FROM b),
      p AS (SELECT row_id, field_name, CASE
        WHEN strong OR (field_name = 'affiliations' AND NOT regexp_matches(cell, '^\s*"(?:[^"]|"")*"\s*,\s*"')) THEN regexp_extract_all(cell, '[ \t]*"(?:[^"]|"")*"[ \t]*(?:[;|\n•]|$)|[^;|\n•]+|[;|\n•]')
        WHEN field_name = 'authors' THEN regexp_extract_all(regexp_replace(cell, ',[ ]*((?:\w\.[ -]?)+)($|"|,| and | & )', '§ \1\2', 'g'), '[ \t]*"(?:[^"]|"")*"[ \t]*(?:,|$)|[^,]+|,')
        ELSE regexp_extract_all(cell, '[ \t]*"(?:[^"]|"")*"[ \t]*(?:,|$)|[^,]+|,') END AS parts FROM k),
      q AS (SELECT row_id, field_name, list_filter(list_transform(CASE WHEN field_name = 'authors' THEN flatten(list_transform(parts, lambda x: string_split_regex(replace(x, '§', ','), '\s+(?:and|&)\s+'))) ELSE parts END,
        lambda x: regexp_replace(regexp_replace(x, '^[\s\p{{Z}}]*(.*?)[\s\p{{Z}};|•,]*$', '\1', 's'), '^"((?:[^"]|"")*)"$', '\1', 's')), lambda x: trim(x) <> '') AS items FROM p),
      v AS (SELECT row_id, field_name, i AS item_pos, trim(CASE WHEN contains(items[i], '""') THEN replace(items[i], '""', '"') ELSE items[i] END) AS item FROM q, unnest(generate_series(1, len(items))) AS u(i))"""


SQL = {
    "p6_found": f"WITH {items_sql('row_id % 10 = 0')} SELECT row_id, field_name, item_pos, item FROM v",
    "p6_values": f"WITH {items_sql()} SELECT field_name, item, count(*) AS n_values, min(item_pos) AS first_pos, max(item_pos) AS last_pos FROM v GROUP BY ALL",
}
QUERIES = {"p6_found": p6_found, "p6_values": p6_values}
