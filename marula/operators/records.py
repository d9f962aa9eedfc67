"""Exact and near-exact deduplication of records, with an audit of what was removed."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def completeness(columns: Sequence[str]):
    """How many of the columns are filled."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)).cast("int")


def merged_tags(tags: str):
    """Aggregate: the distinct whole numbers in lists such as "3,1", ascending, as one list."""
    each = F.flatten(F.collect_set(F.split(F.col(tags), ",")))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(each, lambda x: x.try_cast("int")), lambda x: x.isNotNull()))), ",")


#: Row numbers below this fit beside a score in one number.
ROWS = 1 << 56


def _rank(score: str, order: str):
    """A number that is larger for a fuller row, and of equals for the earlier one."""
    return F.col(score).cast("bigint") * ROWS + (ROWS - 1 - F.col(order))


def _row_of(rank):
    """The row that a rank stands for."""
    return F.lit(ROWS - 1) - rank.bitwiseAND(ROWS - 1)


def settle(df: DataFrame, key: str, score: str, order: str, tags: str) -> DataFrame:
    """df with keeper, the row that is kept for each row's key, n_rows, the key's rows, and tags merged over the key's rows.

    Kept is the fullest row, then the first. A row without a key is its own keeper. The
    keeper is the maximum of one number for each key, so a key with a third of all rows
    is combined before the shuffle. order holds whole numbers from 0 to below 2 ** 56,
    score from 0 to 127.
    """
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(_rank(score, order)).alias("_rank"), merged_tags(tags).alias("_tags"), F.count("*").alias("n_rows"))
    best = best.select(key, _row_of(F.col("_rank")).alias("keeper"), "_tags", "n_rows")
    alone = df.where(F.col(key).isNull()).withColumns({"keeper": F.col(order).cast("bigint"), "n_rows": F.lit(1).cast("bigint")})
    found = df.join(best, key).withColumn(tags, F.col("_tags")).select(*df.columns, "keeper", "n_rows")
    return found.unionByName(alone.select(found.columns))


def keep_fullest(df: DataFrame, key: str, score: str, order: str, tags: str) -> DataFrame:
    """One row for each key: the fullest, then the first; tags merged over the key's rows. Rows without a key are left out."""
    return settle(df.where(F.col(key).isNotNull()), key, score, order, tags).where(F.col(order) == F.col("keeper")).drop("keeper")


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over the lengths' sum, by bit-parallel rows."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - bin(row).count("1")) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of two texts as sets of words: 100 if one holds all words of the other, else the best of three indel ratios."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(indel_ratio(one, two), *((indel_ratio(both, one), indel_ratio(both, two)) if both else (0.0,)))


def partial_ratio(a: str, b: str) -> float:
    """The best indel ratio of the shorter text over all windows of the longer one, clipped at its ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, best = len(a), 0.0
    for i in range(1 - n, len(b)):
        part = b[max(i, 0) : i + n]
        if part[0] in a or part[-1] in a:
            best = max(best, indel_ratio(a, part))
            if best == 100:
                break
    return best


def _masks(texts: Sequence[str], codes: dict[str, int]):
    """For each text of up to 64 characters and each code, the bits of the places where it stands."""
    import numpy as np

    out = np.zeros((len(texts), len(codes) + 1), np.uint64)
    for i, t in enumerate(texts):
        for j, c in enumerate(t[:64]):
            out[i, codes[c]] |= np.uint64(1 << j)
    return out


def _coded(texts: Sequence[str], codes: dict[str, int], before: int, after: int):
    """The texts as rows of codes, 0 before and behind them."""
    import numpy as np

    out = np.zeros((len(texts), before + max(map(len, texts)) + after), np.int32)
    for i, t in enumerate(texts):
        out[i, before : before + len(t)] = [codes[c] for c in t]
    return out


def partial_ratios(pairs: Sequence[tuple[str, str]]) -> list[float]:
    """partial_ratio of each pair, the windows of many pairs side by side."""
    import numpy as np

    out = [0.0] * len(pairs)
    sized: dict[int, list[tuple[int, str, str]]] = {}
    for i, (a, b) in enumerate(pairs):
        a, b = (b, a) if len(a) > len(b) else (a, b)
        if not a or len(a) > 64:
            out[i] = partial_ratio(a, b)
        else:
            sized.setdefault(len(a), []).append((i, a, b))
    for n, same in sized.items():
        same.sort(key=lambda x: len(x[2]))
        full = np.uint64((1 << n) - 1)
        for k in range(0, len(same), 1000):
            part = same[k : k + 1000]
            codes = {c: i for i, c in enumerate(sorted(set("".join(x[1] + x[2] for x in part))), 1)}
            table, text = _masks([x[1] for x in part], codes), _coded([x[2] for x in part], codes, n - 1, n)
            sizes = np.array([len(x[2]) for x in part])[:, None]
            starts = np.arange(1 - n, int(sizes.max()))[None, :]
            own = np.arange(len(part))[:, None]
            row = np.full((len(part), starts.shape[1]), full)
            for t in range(n):
                hit = row & table[own, text[:, t : t + starts.shape[1]]]
                row = (row + hit) | (row - hit)
            common = n - np.bitwise_count(row & full).astype(np.int64)
            length = np.minimum(starts + n, sizes) - np.maximum(starts, 0)
            best = (200.0 * common / (n + np.maximum(length, 0))).max(axis=1)
            for (i, _, _), v in zip(part, best.tolist()):
                out[i] = v
    return out


def _window_bounds(texts: Sequence[str], names: Sequence[str], stride: int = 8):
    """A lower and an upper bound of the partial ratio of each text and name; all names have one length, and no text is shorter.

    Windows at the texts' ends are all scored, those within at every stride-th place.
    From one place to the next the common subsequence grows by one at most, which
    bounds the windows between.
    """
    import numpy as np

    n = len(names[0])
    full = np.uint64((1 << n) - 1)
    codes = {c: i for i, c in enumerate(sorted(set("".join((*texts, *names)))), 1)}
    text = _coded(texts, codes, 0, n + 2 * stride)
    clipped = np.zeros((len(texts), len(names)))
    for turn in (1, -1):
        table = np.ascontiguousarray(_masks([x[::turn] for x in names], codes).T)
        ends = text if turn == 1 else _coded([x[::-1] for x in texts], codes, 0, 0)
        row = np.full(clipped.shape, full)
        for m in range(1, n):
            hit = row & table[ends[:, m - 1]]
            row = (row + hit) | (row - hit)
            np.maximum(clipped, 200.0 * (n - np.bitwise_count(row & full).astype(np.int64)) / (n + m), out=clipped)
    table = np.ascontiguousarray(_masks(names, codes).T)
    last = np.array([len(x) for x in texts]) - n
    starts = np.arange(0, int(last.max()) + stride, stride)
    starts = np.append(starts, starts[-1] + stride) if len(starts) == 1 else starts
    row = np.full((len(texts), len(starts), len(names)), full)
    for t in range(n):
        hit = row & table[text[:, starts + t]]
        row = (row + hit) | (row - hit)
    common = n - np.bitwise_count(row & full).astype(np.int64)
    whole = (starts[None, :] <= last[:, None])[:, :, None]
    low = np.maximum(clipped, 200.0 * np.where(whole, common, 0).max(axis=1) / (2 * n))
    between = np.minimum((common[:, :-1] + common[:, 1:] + stride) // 2, n).max(axis=1)
    return low, np.maximum(low, 200.0 * between / (2 * n))


def best_partial(texts: Sequence[str], names: Sequence[str], k: int) -> list[list[tuple[float, int]]]:
    """For each text the names (score, index) by partial ratio: the k best, and all that are level with the last of them."""
    import numpy as np

    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    sized: dict[int, list[int]] = {}
    for j, y in enumerate(names):
        sized.setdefault(len(y), []).append(j)
    out: list[list[tuple[float, int]]] = [[] for _ in texts]
    for at in range(0, len(order), 128):
        part = order[at : at + 128]
        low, high = np.zeros((len(part), len(names))), np.full((len(part), len(names)), 100.0)
        for n, js in sized.items():
            first = next((i for i, x in enumerate(part) if len(texts[x]) >= n), len(part))
            if 0 < n <= 64 and first < len(part):
                low[first:, js], high[first:, js] = _window_bounds([texts[x] for x in part[first:]], [names[j] for j in js])
        kth = min(k, len(names))
        # the likeliest first, so that what they reach rules out the others
        ahead = np.argpartition(-(low + high), kth - 1, axis=1)[:, :kth]
        todo = np.zeros(low.shape, bool)
        todo[np.arange(len(part))[:, None], ahead] = True
        for _ in range(2):
            i, j = np.nonzero(todo)
            low[i, j] = high[i, j] = partial_ratios([(texts[part[x]], names[y]) for x, y in zip(i.tolist(), j.tolist())])
            done = low == high
            least = np.partition(low, -kth, axis=1)[:, -kth][:, None]
            todo = (high >= least) & ~done
        for x, y in zip(*(v.tolist() for v in np.nonzero(low == high))):
            if low[x, y] >= least[x, 0]:
                out[part[x]].append((float(low[x, y]), y))
    return out


#: Titles of one block of a year; two blocks are compared at a time.
BLOCK = 1000


def _letter_counts(texts: Sequence[str]):
    """A row of 32 counts of characters, by the last five bits of their codes, for each text."""
    import numpy as np

    bags = np.zeros((len(texts), 32), np.int16)
    for i, t in enumerate(texts):
        np.add.at(bags[i], np.frombuffer(t.encode("utf-32-le"), np.uint32) & 31, 1)
    return bags


def _near_in_blocks(least: float):
    """Pairs of two blocks whose remaining words are spelled alike.

    The words of a title in any order are the same characters, so two titles' indel
    distance is at least the difference of their counts of characters; only pairs that
    pass by that bound are scored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        share = 1 - least / 100
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                left, right = (sorted((len(x["t"]), x["id"], x["t"]) for x in row[side]) for side in ("l", "r"))
                bags, sizes = _letter_counts([x[2] for x in right]), np.array([x[0] for x in right])
                own = bags if row["same"] else _letter_counts([x[2] for x in left])
                found = []
                for i, (n, a, t) in enumerate(left):
                    first = i + 1 if row["same"] else int(np.searchsorted(sizes, n * (1 - share) / (1 + share) - 1e-6))
                    last = int(np.searchsorted(sizes, n * (1 + share) / (1 - share) + 1e-6, "right"))
                    apart = np.abs(bags[first:last] - own[i]).sum(axis=1, dtype=np.int32)
                    for j in np.flatnonzero(apart <= share * (sizes[first:last] + n) + 1e-6) + first:
                        if token_set_ratio(t, right[j][2]) >= least:
                            found.append((min(a, right[j][1]), max(a, right[j][1])))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    return run


def _scored(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [token_set_ratio(x, y) >= least for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _nearly_contained(titles: DataFrame, least: float) -> DataFrame:
    """Pairs of which one title's own words are too few to bring the ratio of the common words and that title below least.

    Own words, each with a blank, are at most a fixed share of the title. So of its
    rarest words that together are more than that share, the other title has one.
    """
    share = (200 - 2 * least) / (200 - least)
    near = F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1))
    words = titles.select("id", "year", F.explode("words").alias("word"), (share * F.length(F.array_join("words", " ")) + 1e-6).alias("bound"))
    rare = words.groupBy("word").agg(F.count("*").alias("df"))
    ahead = Window.partitionBy("id").orderBy("df", "word").rowsBetween(Window.unboundedPreceding, -1)
    first = words.join(rare, "word").withColumn("ahead", F.coalesce(F.sum(F.length("word") + 1).over(ahead), F.lit(0))).where("ahead <= bound")
    first = first.select(F.col("id").alias("a"), near.alias("year"), "word", "bound")
    held = first.join(words.select(F.col("id").alias("b"), "year", "word"), ["year", "word"]).where("a <> b").select("a", "b", "bound").distinct()
    side = titles.select("id", "words")
    held = held.join(side.withColumnsRenamed({"id": "a", "words": "wa"}), "a").join(side.withColumnsRenamed({"id": "b", "words": "wb"}), "b")
    own = F.aggregate(F.array_except("wa", "wb"), F.lit(0), lambda n, w: n + F.length(w) + 1)
    held = held.where(own <= F.col("bound")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.array_join("wa", " ").alias("x"), F.array_join("wb", " ").alias("y"))
    return held.mapInArrow(_scored(least), "a bigint, b bigint")


def _nearly_spelled(titles: DataFrame, least: float) -> DataFrame:
    """Pairs whose whole word sets are spelled alike, however many words differ.

    Their lengths differ by a fixed factor at most, so they stand in the same or in
    neighbouring classes of length. Classes of a year are cut into blocks, and block
    meets block by an equi-join.
    """
    factor = (200 - least) / least
    text = titles.select("id", "year", F.array_join("words", " ").alias("t"))
    text = text.withColumn("k", F.floor(F.log(F.length("t").cast("double")) / math.log(factor * (1 + 1e-9))))
    n = text.groupBy("year", "k").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    text = text.join(n, ["year", "k"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("n")))
    blocks = text.groupBy("year", "k", "part").agg(F.collect_list(F.struct("id", "t")).alias("l"))
    # each two classes once: itself, the next length, and the next year with the same or a neighbouring length
    steps = F.explode(F.array(*(F.struct(F.lit(y).alias("y"), F.lit(k).alias("k")) for y, k in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)))))
    left = blocks.withColumn("s", steps).select("l", F.col("part").alias("p"), F.col("s.y").alias("dy"), F.col("s.k").alias("dk"), (F.col("year") + F.col("s.y")).alias("year"), (F.col("k") + F.col("s.k")).alias("k"))
    own = (F.col("dy") == 0) & (F.col("dk") == 0)
    pairs = left.join(blocks.withColumnRenamed("l", "r"), ["year", "k"]).where(~own | (F.col("p") <= F.col("part")))
    return pairs.select("l", "r", (own & (F.col("p") == F.col("part"))).alias("same")).repartition(F.xxhash64("l"), F.xxhash64("r")).mapInArrow(_near_in_blocks(least), "a bigint, b bigint")


def similar_titles(titles: DataFrame, least: float = 95.0) -> DataFrame:
    """Pairs (a, b) of title ids, years at most one apart, whose token-set ratio is at least that.

    titles: id, year, words (sorted distinct words). The ratio is the best of three, and
    each has candidates of its own bound: a title's words nearly all in the other, either
    way, or both titles spelled nearly alike. So no pair is lost before it's scored.
    """
    return _nearly_contained(titles, least).union(_nearly_spelled(titles, least)).distinct()
