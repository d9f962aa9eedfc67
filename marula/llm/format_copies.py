"""Problem 1: records that differ only in formatting.

Method: canonical records are range-partitioned and sorted by their whole key
(Spark's external sort), then each partition is scanned once and adjacent rows
with equal keys make a run. A run is one representative and its exact number of
copies. A key with a third of all rows is cut by the range partitioner at row ids
and so gives one short run for each partition it spans; these are added up.

Defined results: a record whose fields are all null, blank or mere punctuation has
no words and belongs to no set. Repeated rows count each time. A table without
rows gives none. Other columns of the input, of whatever name, are ignored. Keys
may be as long as the texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marula.session import written

#: Marks that part words like a blank: dashes and apostrophes in their written forms. Fixed values.
PARTING = r"[\p{Pd}−'‘’ʼʹ＇`´]"


def word_bag(*columns: Column) -> Column:
    """The sorted words of all columns, joined by blanks, without case and punctuation.

    Letters, digits and accents count; invisible characters and symbols don't.
    """
    text = F.lower(F.concat_ws(" ", *columns))
    text = F.regexp_replace(text, PARTING + r"|[\s\p{Z}\x{85}]", " ")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\p{M} ]", "")
    return F.array_join(F.array_sort(F.filter(F.split(text, " +"), lambda w: w != "")), " ")


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # composed words sort elsewhere: e with a separate accent before f, é after z
        keys = [" ".join(sorted(unicodedata.normalize("NFC", k).split(" "))) for k in b.column("_key").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(keys, pa.string())], ["_id", "_key"])


def canonical(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Rows (_id, _key) of all records with at least one word.

    Only keys with separate accents leave the JVM, to be composed there.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("_id"), F.concat_ws(" ", *(F.col(c) for c in columns)).alias("_text"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_text").rlike(r"[\p{L}\p{N}\p{M}]"))
    marked = F.col("_text").rlike(r"\p{M}")
    one = rows.where(~marked).select("_id", word_bag(F.col("_text")).alias("_key"))
    two = rows.where(marked).select("_id", word_bag(F.col("_text")).alias("_key"))
    return one.unionByName(two.mapInArrow(_composed, two.schema))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in sorted rows: their first id, length, and whether they touch the partition's edge."""
    names = ["_key", "first_row_id", "n_copies"]
    key, first, n, edge = None, None, 0, True
    for b in batches:
        if not b.num_rows:
            continue
        keys, ids = b.column("_key"), b.column("_id")
        new = pc.not_equal(keys.slice(1), keys.slice(0, b.num_rows - 1)) if b.num_rows > 1 else pa.array([], pa.bool_())
        starts = [0, *(i + 1 for i in pc.indices_nonzero(new).to_pylist())]
        out_k, out_f, out_n = [], [], []
        if key is not None and keys[0].as_py() == key:
            n += (starts[1] if len(starts) > 1 else b.num_rows)
            starts = starts[1:]
        if starts:
            if key is not None and (n > 1 or edge):
                out_k.append(key), out_f.append(first), out_n.append(n)
            edge = key is None
            lengths = [e - s for s, e in zip(starts, [*starts[1:], b.num_rows])]
            for s, m in zip(starts[:-1], lengths[:-1]):
                if m > 1 or edge:
                    out_k.append(keys[s].as_py()), out_f.append(ids[s].as_py()), out_n.append(m)
                edge = False
            key, first, n = keys[starts[-1]].as_py(), ids[starts[-1]].as_py(), lengths[-1]
        if out_k:
            yield pa.RecordBatch.from_arrays([pa.array(out_k, pa.string()), pa.array(out_f, pa.int64()), pa.array(out_n, pa.int64())], names)
    if key is not None:
        # the last run may go on in the next partition
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([first], pa.int64()), pa.array([n], pa.int64())], names)


def collapse_copies(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """One row (first_row_id, n_copies) for each set of two or more records with the same words."""
    # written once, as the partitioner reads its input twice: for the bounds and for the shuffle
    rows = written(canonical(df, id_col, columns)).repartitionByRange("_key", "_id").sortWithinPartitions("_key", "_id")
    runs = rows.mapInArrow(_runs, "_key string, first_row_id bigint, n_copies bigint")
    whole = runs.groupBy("_key").agg(F.min("first_row_id").alias("first_row_id"), F.sum("n_copies").alias("n_copies"))
    return whole.where(F.col("n_copies") >= 2).select("first_row_id", "n_copies")
