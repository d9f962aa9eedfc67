"""Problem 4: items that appear together.

Method: blocked Gram matrix. Items are counted, those too rare for any pair that
is asked for drop out (a pair is never more frequent than its items), and the
rest are numbered. Record blocks become sparse binary matrices, item block by item
block, and the sparse transpose-products of the blocks are summed, first within a task
and then over all tasks. Counts are then held against the product of the marginals.

With a support of share s of n records and records of k items on average there
can't be more than k / s such items, so their list has a bound, whatever the number
of records. It's counted all the same: more than ``LISTED`` items (as with no share
asked) raise an error before any is sent out. No pairs of a record are ever written out.

Defined results: repeated items of a record count once; null and empty records
don't count; ties don't matter, as every pair over the limits comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records of one block, items of one block, and most items over the support limit, which all tasks hold.
RECORDS, ITEMS, LISTED = 4096, 256, 2_000_000
#: Products that are expanded at once, and counts of one pair of item blocks that are held before they are summed up.
STEP, HELD = 2_000_000, 4_000_000


class _Counts:
    """Sums of sparse counts by key."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > HELD:
            self.parts = [self.total()]
            self.held = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([c for _, c in self.parts])).astype(np.int64)


def _product(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], n_rows: int, into: _Counts) -> None:
    """Add the transpose-product of two sparse binary blocks, each given by the rows (ascending) and columns of its ones."""
    rows, left = x
    ends = np.searchsorted(y[0], np.arange(n_rows + 1))
    width = (ends[1:] - ends[:-1])[rows]
    upto = np.cumsum(width)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
        w = width[at:to]
        first = np.repeat(ends[rows[at:to]] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
        keys, counts = np.unique(np.repeat(left[at:to], w) * ITEMS + y[1][first], return_counts=True)
        into.add(keys, counts)
        at = to


def _gram(ids: dict[tuple[str, str], int], sizes: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], _Counts] = {}
        held: dict[str, list[list[int]]] = {f: [] for f in sizes}

        def flush(f: str) -> None:
            lists = held[f]
            if not lists:
                return
            rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            cols = np.fromiter((i for x in lists for i in x), np.int64, len(rows))
            own = cols // ITEMS
            blocks = {int(k): (rows[own == k], cols[own == k] - k * ITEMS) for k in np.unique(own)}
            for a, x in blocks.items():
                for b, y in blocks.items():
                    if a <= b:
                        _product(x, y, len(lists), sums.setdefault((f, a, b), _Counts()))
            held[f] = []

        for batch in batches:
            for f, items in zip(batch.column("field_name").to_pylist(), batch.column("items").to_pylist()):
                own = {i for x in items if (i := ids.get((f, x))) is not None}
                if len(own) > 1:
                    held[f].append(sorted(own))
                    if len(held[f]) >= RECORDS:
                        flush(f)
        for f in sizes:
            flush(f)
        for (f, a, b), counts in sums.items():
            if not counts.parts:
                continue
            keys, n = counts.total()
            left, right = keys // ITEMS + a * ITEMS, keys % ITEMS + b * ITEMS
            up = left < right
            if up.any():
                yield pa.RecordBatch.from_arrays([pa.array([f] * int(up.sum())), pa.array(left[up]), pa.array(right[up]), pa.array(n[up])], ["field_name", "a", "b", "n"])

    return run


def frequent_pairs(baskets: DataFrame, min_rows: int, min_share: float, min_lift: float) -> DataFrame:
    """Rows (field_name, item_a, item_b, n_a, n_b, n_ab, n_rows, lift) of the pairs over all three limits.

    baskets: columns field_name and items (an array of strings without nulls).
    item_a is before item_b by code point. A pair is in if it stands in at least
    min_rows records and min_share of the field's records with an item, and at least
    min_lift times as often as by chance.
    """
    full = baskets.where(F.size("items") > 0).select("field_name", F.array_distinct("items").alias("items"))
    totals = {r.field_name: r.n for r in full.groupBy("field_name").agg(F.count("*").alias("n")).collect()}
    least = {f: max(min_rows, int(np.ceil(min_share * n - 1e-9))) for f, n in totals.items()}
    counts = full.select("field_name", F.explode("items").alias("item")).groupBy("field_name", "item").agg(F.count("*").alias("n"))
    bound = F.lit(None).cast("bigint")
    for f, n in least.items():
        bound = F.when(F.col("field_name") == f, F.lit(n)).otherwise(bound)
    found = counts.where(F.col("n") >= bound).limit(LISTED + 1).collect()
    if len(found) > LISTED:
        raise ValueError(f"more than {LISTED} items are over the support limit; ask for a higher share")
    rows = sorted((r.field_name, r.item, r.n) for r in found)
    ids, sizes, names = {}, {}, {}
    for f, item, n in rows:
        i = sizes.get(f, 0)
        ids[f, item], names[f, i] = i, (item, n)
        sizes[f] = i + 1
    spark = baskets.sparkSession
    listed = spark.createDataFrame(
        [(f, i, item, n) for (f, i), (item, n) in names.items()], "field_name string, id bigint, item string, n bigint"
    )
    total = spark.createDataFrame(list(totals.items()), "field_name string, n_rows bigint")
    grams = full.mapInArrow(_gram(ids, sizes), "field_name string, a bigint, b bigint, n bigint")
    pairs = grams.groupBy("field_name", "a", "b").agg(F.sum("n").alias("n_ab"))
    out = (
        pairs.join(listed.select("field_name", F.col("id").alias("a"), F.col("item").alias("item_a"), F.col("n").alias("n_a")), ["field_name", "a"])
        .join(listed.select("field_name", F.col("id").alias("b"), F.col("item").alias("item_b"), F.col("n").alias("n_b")), ["field_name", "b"])
        .join(total, "field_name")
    )
    out = out.where((F.col("n_ab") >= min_rows) & (F.col("n_ab") >= min_share * F.col("n_rows") - 1e-9))
    out = out.where(F.col("n_ab").cast("double") * F.col("n_rows") >= min_lift * F.col("n_a") * F.col("n_b"))
    lift = F.col("n_ab").cast("double") * F.col("n_rows") / (F.col("n_a") * F.col("n_b"))
    return out.select("field_name", "item_a", "item_b", "n_a", "n_b", "n_ab", "n_rows", lift.alias("lift"))
