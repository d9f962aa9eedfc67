"""Several values packed in one cell: dictionary-guided segmentation (problem 6).

A cell holds values between delimiters that differ from cell to cell, some of
them quoted, and a delimiter may also belong to a value. The values of the whole
column teach which ones: every value that stands in quotes, or between strong
delimiters where a weak one is part of it, is counted, and those seen at least
``min_rows`` times make a dictionary. A multi-pattern automaton finds its entries
in each cell, and dynamic programming picks the cover of non-overlapping entries
that protects most delimiters; every delimiter left outside the cover splits.

Only entries that hold a delimiter are kept, as only they can change a split, so
the dictionary follows the language and not the number of rows. It's still
counted before it is sent out, and one of more than ``BLOCK`` entries is applied
in several passes, each with one block of it.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marula.session import checkpoint

#: Most dictionary entries that one pass over the cells takes.
BLOCK = 50_000
#: Delimiters that part values wherever they occur outside quotes.
STRONG = ";|\n\u2022"


@dataclass(frozen=True)
class Packing:
    """How one column packs its values.

    weak: delimiters that part values only in cells without a strong one.
    joins: words that stand before the last value. tail: what can't be a value of
    its own and so belongs to the value before it. inner: the delimiter between
    the parts of one value, if values have parts.
    """

    strong: str = STRONG
    weak: str = ""
    joins: tuple[str, ...] = ()
    tail: str = ""
    inner: str = ""


KEYWORDS = Packing(weak=",")
AFFILIATIONS = Packing(inner=",")
#: Initials, as in "Okri, B.J.", never are an author of their own.
AUTHORS = Packing(weak=",", joins=("and", "&"), tail=r"(?:\w\.[\s-]?)+\w?\.?")


def _class(chars: str) -> str:
    return "[" + re.escape(chars) + "]"


def learn_entries(cells: DataFrame, packings: dict[str, Packing], min_rows: int = 2) -> DataFrame:
    """Rows (field_name, entry, n_cells): values that hold a delimiter themselves.

    cells has the columns field_name and cell. Runs inside the JVM; each entry is
    pre-aggregated before it is shuffled. Null cells teach nothing.
    """
    found = []
    for name, p in packings.items():
        own = cells.where(F.col("field_name") == name)
        every = _class(p.strong + p.weak)
        quoted = own.where(F.col("cell").contains('"')).select(
            F.explode(F.regexp_extract_all("cell", F.lit('"([^"\\s;|,\u2022](?:[^"]|"")*)"'), F.lit(1))).alias("entry")
        )
        quoted = quoted.select(F.replace("entry", F.lit('""'), F.lit('"')).alias("entry"))
        if p.inner:
            quoted = quoted.select(F.explode(F.split("entry", _class(p.inner))).alias("entry"))
        parts = quoted.where(F.col("entry").rlike(every))
        if p.weak:
            plain = own.where(F.col("cell").rlike(_class(p.strong)) & ~F.col("cell").contains('"')).select(
                F.explode(F.split("cell", _class(p.strong))).alias("entry")
            )
            parts = parts.unionByName(plain.where(F.col("entry").rlike(_class(p.weak))))
        parts = parts.select(F.lit(name).alias("field_name"), F.regexp_replace(F.lower("entry"), r"^[\s,;|]+|[\s,;|]+$", "").alias("entry"))
        parts = parts.where(F.col("entry").rlike(every))
        if p.tail:
            parts = parts.where(~F.col("entry").rlike("(?i)^[^,]+,\\s*" + p.tail + "$"))
        found.append(parts)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.groupBy("field_name", "entry").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= min_rows)


def best_cover(spans: Iterable[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Non-overlapping spans (start, end, weight) of the greatest total weight.

    Weighted interval scheduling; of equal covers, the one that ends first.
    """
    order = sorted(spans, key=lambda s: (s[1], s[0]))
    ends = [s[1] for s in order]
    best = [0]
    for i, (start, _, weight) in enumerate(order):
        best.append(max(best[i], weight + best[bisect.bisect_right(ends, start, 0, i)]))
    cover, i = [], len(order)
    while i:
        if best[i] == best[i - 1]:
            i -= 1
        else:
            start, end, _ = order[i - 1]
            cover.append((start, end))
            i = bisect.bisect_right(ends, start, 0, i - 1)
    return cover[::-1]


def splitter(p: Packing, entries: Iterable[str] = ()) -> Callable[..., list[str]]:
    """A function that splits one cell of this packing, guided by dictionary entries.

    It takes the cell and, where the entries were looked up elsewhere, their places in it.
    """
    import ahocorasick

    strong, weak = _class(p.strong), _class(p.weak) if p.weak else None
    strong_re, weak_re = re.compile(strong), re.compile(weak) if weak else None
    joins_re = re.compile(r"\s+(?:" + "|".join(map(re.escape, p.joins)) + r")\s+") if p.joins else None
    tail_re = re.compile(p.tail) if p.tail else None
    every = set(p.strong + p.weak + p.inner + ",")
    edge = _class("".join(sorted(every)))
    quoted_re = re.compile(rf'(?:(?<={edge})|^)[^\S\n]*("(?:[^"]|"")*")[^\S\n]*(?={edge}|$)')

    automata = {}
    for key, chars in (("strong", p.strong), ("weak", p.strong + p.weak)):
        hold = [e for e in entries if any(c in chars for c in e)]
        if hold:
            automata[key] = a = ahocorasick.Automaton()
            for e in hold:
                a.add_word(e, len(e))
            a.make_automaton()

    def covered(cell: str, cuts: list[tuple[int, int]], found: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
        bounds = every
        spans = []
        for start, end in found:
            inside = sum(1 for a, b in cuts if start <= a and b <= end)
            if inside:
                left, right = cell[:start].rstrip(" \t\""), cell[end:].lstrip(" \t\"")
                if (not left or left[-1] in bounds) and (not right or right[0] in bounds):
                    spans.append((start, end, inside))
        if not spans:
            return cuts
        cover = best_cover(spans)
        return [c for c in cuts if not any(s <= c[0] and c[1] <= e for s, e in cover)]

    def split(cell: str, found: list[tuple[int, int]] | None = None) -> list[str]:
        masked = []
        if '"' in cell:
            masked = [m.span(1) for m in quoted_re.finditer(cell)]
        free = (lambda i: masked[max(bisect.bisect_right(masked, (i, len(cell))) - 1, 0)][1] <= i or i < masked[0][0]) if masked else (lambda i: True)
        cuts = [m.span() for m in strong_re.finditer(cell) if free(m.start())]
        kind = "strong"
        if not cuts:
            kind = "weak"
            if weak_re is not None:
                cuts = [m.span() for m in weak_re.finditer(cell) if free(m.start())]
        if masked and len(masked) > 1 and (kind == "strong" or weak_re is None):
            # a comma between two quoted values parts them whatever else does
            have = set(cuts)
            for (_, a), (b, _) in zip(masked, masked[1:]):
                if cell[a:b].strip() == "," and (c := (cell.index(",", a), cell.index(",", a) + 1)) not in have:
                    cuts.append(c)
            cuts.sort()
        if cuts and found is None and kind in automata:
            found = places(automata[kind], cell)
        if cuts and found:
            cuts = covered(cell, cuts, found)
        pieces, at = [], 0
        for a, b in cuts:
            pieces.append(cell[at:a])
            at = b
        pieces.append(cell[at:])
        if tail_re is not None and kind == "weak" and len(pieces) > 1:
            joined: list[str] = []
            for piece in pieces:
                core, *after = joins_re.split(piece.strip(), maxsplit=1) if joins_re else [piece.strip()]
                if joined and tail_re.fullmatch(core.strip()):
                    joined[-1] = f"{joined[-1]},{piece}"
                else:
                    joined.append(piece)
            pieces = joined
        if joins_re is not None:
            pieces = [x for piece in pieces for x in (joins_re.split(piece) if '"' not in piece else [piece])]
        out = []
        for piece in pieces:
            v = piece.strip()
            if len(v) > 1 and v[0] == v[-1] == '"' and '"' not in v[1:-1].replace('""', ""):
                v = v[1:-1].replace('""', '"').strip()
            if v:
                out.append(v)
        return out

    return split


def places(automaton, cell: str) -> list[tuple[int, int]]:
    """Where the automaton's entries stand in a cell; nowhere if the cell's lower case is of another length."""
    lower = cell.lower()
    return [(last - size + 1, last + 1) for last, size in automaton.iter(lower)] if len(lower) == len(cell) else []


def split_cells(cells: DataFrame, packings: dict[str, Packing], min_rows: int = 2, dictionary: DataFrame | None = None) -> DataFrame:
    """cells with the column items, an array of the single values of each cell in order.

    cells: columns field_name and cell, and any others, which are kept (cell is
    replaced by items, and columns of the names items or spans give way). A null or blank cell has no items. Items lose outer blanks
    and enclosing quotes; doubled quotes inside become single.
    """
    cells = cells.drop("items", "spans")
    learned = checkpoint(learn_entries(cells, packings, min_rows) if dictionary is None else dictionary)
    n = learned.count()
    blocks = max(1, -(-n // BLOCK))
    keep = [f for f in cells.schema.fields if f.name not in ("cell", "items", "spans")]
    schema = T.StructType([*keep, T.StructField("items", T.ArrayType(T.StringType()))])
    if blocks == 1:
        entries: dict[str, list[str]] = {}
        for r in learned.collect():
            entries.setdefault(r.field_name, []).append(r.entry)
        return cells.mapInArrow(_splitting(packings, entries, schema), schema)
    # A dictionary beyond the bound goes in blocks, an automaton for each; a cell keeps the places that any of them finds.
    spotted = cells.withColumn("spans", F.array().cast("array<int>"))
    for k in range(blocks):
        part: dict[str, list[str]] = {}
        for r in learned.where(F.pmod(F.xxhash64("entry"), F.lit(blocks)) == k).collect():
            part.setdefault(r.field_name, []).append(r.entry)
        spotted = spotted.mapInArrow(_spotting(part, spotted.schema), spotted.schema)
    return spotted.mapInArrow(_splitting(packings, {}, schema), schema)


def _splitting(packings: dict[str, Packing], entries: dict[str, list[str]], schema: T.StructType):
    names = [f.name for f in schema.fields if f.name != "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = {k: splitter(p, entries.get(k, ())) for k, p in packings.items()}
        for b in batches:
            fields, cells = b.column("field_name").to_pylist(), b.column("cell").to_pylist()
            if "spans" in b.schema.names:
                spans = b.column("spans").to_pylist()
                items = [[] if c is None else split[f](c, list(zip(s[::2], s[1::2]))) for f, c, s in zip(fields, cells, spans)]
            else:
                items = [[] if c is None else split[f](c) for f, c in zip(fields, cells)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(items, pa.list_(pa.string()))], [*names, "items"])

    return run


def _spotting(entries: dict[str, list[str]], schema: T.StructType):
    names = [f.name for f in schema.fields if f.name != "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = {}
        for k, words in entries.items():
            found[k] = a = ahocorasick.Automaton()
            for e in words:
                a.add_word(e, len(e))
            a.make_automaton()
        for b in batches:
            rows = zip(b.column("field_name").to_pylist(), b.column("cell").to_pylist(), b.column("spans").to_pylist())
            spans = [s if c is None or f not in found else s + [x for place in places(found[f], c) for x in place] for f, c, s in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(spans, pa.list_(pa.int32()))], [*names, "spans"])

    return run


def field_cells(df: DataFrame, id_col: str, fields: Iterable[str]) -> DataFrame:
    """One row (id_col, field_name, cell) for each named column of each row."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("cell")) for f in fields))
    return df.select(F.col(id_col), F.explode(pairs).alias("x")).select(id_col, "x.field_name", "x.cell")


def explode_items(split: DataFrame, id_col: str) -> DataFrame:
    """One row (id_col, field_name, item_pos, item) for each single value, positions from 1."""
    return split.select(id_col, "field_name", F.posexplode("items").alias("pos", "item")).select(
        id_col, "field_name", (F.col("pos") + 1).cast("bigint").alias("item_pos"), "item"
    )
