"""Problem 9: mixing sources to target weights.

Method: equal texts are one text that belongs to every source it was crawled for.
Texts are aggregated by their set of sources (the membership pattern), which leaves
a small flow network: tokens run from a pattern, once for free and again at a cost
that rises with every repetition, to the sources it belongs to, and on to their
quotas. The largest total at which every reachable source meets its target share is
that of the source whose capacity is used up first, and the cheapest routing of it is
found by minimum-cost flow, level of repetition by level. Then the texts
of each pattern, in a seeded random order, are laid on a line as often as the flow
asks, and each source takes its stretch of that line.

Only patterns and their token sums reach the driver (at most two to the number of
sources, which is checked). Positions on the line are prefix sums over buckets of
bounded size, so a source with a third of all texts makes no large task.

Defined results: null or empty texts, and sources without a target, aren't used; a
source with a target but no text is reported with share 0, and the others share its
part in proportion; a text crawled again for the same source counts once. A source
repeats a text at most its max_repeats times, and of a text shared by sources each
counts its own uses.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marula.session import checkpoint

#: Most membership patterns, and texts of one bucket on average.
PATTERNS, BUCKET = 5_000, 5_000
#: How that public vocabulary parts text before its merges. Fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Sizes(dict):
    """Tokens of each piece of text, counted once."""

    def __init__(self, encoding):
        self.encoding = encoding

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) < 500_000:
            self[piece] = n
        return n


def token_counter(ranks: bytes):
    """A function that counts a text's tokens; texts of plain characters take a faster equal split."""
    import regex
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    size = _Sizes(tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})).__getitem__
    slow = regex.compile(SPLIT).findall
    fast = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
    # numerals that aren't digits, and separators: the two splits differ on these only
    even = {c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) in ("No", "Nl")}.isdisjoint
    separators = re.compile(r"[\x1c-\x1f]").search

    def count(text: str) -> int:
        plain = (text.isascii() or even(text)) and not separators(text)
        return sum(map(size, (fast if plain else slow)(text)))

    return count


def _counting(ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(ranks)
        for b in batches:
            n = pa.array([count(t) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("key"), n], ["doc_id", "source", "key", "n_tokens"])

    return run


class Flow:
    """Maximum flow on a small network with integer capacities, by Dinic's layers; capacity may be added to a flow."""

    def __init__(self):
        self.head: list[int] = []
        self.left: list[int] = []
        self.out: list[list[int]] = []
        self.name: dict[object, int] = {}

    def node(self, key: object) -> int:
        if key not in self.name:
            self.name[key] = len(self.out)
            self.out.append([])
        return self.name[key]

    def add(self, a: object, b: object, capacity: int) -> int:
        u, v = self.node(a), self.node(b)
        self.out[u].append(len(self.head))
        self.out[v].append(len(self.head) + 1)
        self.head += [v, u]
        self.left += [capacity, 0]
        return len(self.head) - 2

    def used(self, edge: int) -> int:
        return self.left[edge ^ 1]

    def run(self, start: object, end: object) -> int:
        """Send as much more as possible; the amount."""
        s, t, total = self.node(start), self.node(end), 0
        head, left, out = self.head, self.left, self.out
        while True:
            layer = [-1] * len(out)
            layer[s], queue = 0, deque([s])
            while queue and layer[t] < 0:
                u = queue.popleft()
                for e in out[u]:
                    if left[e] and layer[head[e]] < 0:
                        layer[head[e]] = layer[u] + 1
                        queue.append(head[e])
            if layer[t] < 0:
                return total
            at, path, u = [0] * len(out), [], s
            while True:
                if u == t:
                    push = min(left[e] for e in path)
                    for k in range(len(path) - 1, -1, -1):
                        left[path[k]] -= push
                        left[path[k] ^ 1] += push
                    total += push
                    first = next(k for k, e in enumerate(path) if not left[e])
                    u = head[path[first] ^ 1]
                    del path[first:]
                    continue
                while at[u] < len(out[u]):
                    e = out[u][at[u]]
                    if left[e] and layer[head[e]] == layer[u] + 1:
                        path.append(e)
                        u = head[e]
                        break
                    at[u] += 1
                else:
                    if u == s:
                        break
                    u = head[path.pop() ^ 1]
                    at[u] += 1


def largest_total(capacity: dict[str, int], shares: dict[str, float]) -> int:
    """The largest total of which every source has its whole share in whole tokens.

    A source's uses of a text don't take any from another source, so each source has a
    capacity of its own and the one that is first used up decides.
    """
    whole = sum(shares.values())
    size = min(int((capacity[s] + 1) * whole / t) for s, t in shares.items())
    while any(int(size * t / whole) > capacity[s] for s, t in shares.items()):
        size -= 1
    return size


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, float], repeats: dict[str, int], total: int | None = None) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """The total and the tokens that each source takes of each pattern, at least cost of repetition.

    Without a total, the largest one at which all sources with any text meet their
    share; with one, sources that can't meet it give what they have.

    The k-th use of a pattern's tokens costs k * k, the same for all patterns, and only
    the arcs from the start cost anything. A cheapest augmenting path never returns to
    the start, so it costs what its first arc does: the cheapest flow is found level by
    level, by adding each level's capacity and sending as much as goes.
    """
    reach = sorted({s for p in patterns for s in p if targets.get(s, 0) > 0 and repeats.get(s, 0) > 0})
    if not reach:
        return 0, {}
    whole = sum(targets[s] for s in reach)
    if total is None:
        total = largest_total({s: sum(n for p, n in patterns.items() if s in p) * repeats[s] for s in reach}, {s: targets[s] for s in reach})
    flow, arcs, levels = Flow(), {}, {}
    for p, n in patterns.items():
        own = [s for s in p if s in reach]
        if own:
            levels[p] = flow.add("start", ("p", p), 0), n, sum(repeats[s] for s in own)
            for s in own:
                arcs[p, s] = flow.add(("p", p), ("s", s), n * repeats[s])
    quotas = {s: int(total * targets[s] / whole) for s in reach}
    for s, q in quotas.items():
        flow.add(("s", s), "end", q)
    open_ = sum(quotas.values())
    for k in range(max(most for _, _, most in levels.values())):
        for edge, n, most in levels.values():
            if k < most:
                flow.left[edge] += n
        open_ -= flow.run("start", "end")
        if not open_:
            break
    return total, {k: flow.used(e) for k, e in arcs.items() if flow.used(e)}


def select_mix(docs: DataFrame, targets: DataFrame, ranks_file: str, seed: int = 42, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection (doc_id, source, n_uses, n_tokens) and the shares it reaches.

    docs: doc_id, source, text. targets: source, target_share, max_repeats. ranks_file: the
    merge ranks of a public byte-pair tokenizer, one base64 token and its rank a line. The shares
    have one row (source, target_share, max_repeats, n_docs, n_tokens, reached_share,
    n_repeats) for each source with a target; n_repeats is the most uses of one text.
    """
    spark = docs.sparkSession
    asked = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.where("source is not null").collect()}
    with open(ranks_file, "rb") as f:
        ranks = f.read()
    own = docs.where(F.col("source").isin(list(asked)) & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.sha2("text", 256).alias("key"), "text"
    )
    counted = own.mapInArrow(_counting(ranks), "doc_id bigint, source string, key string, n_tokens bigint").where("n_tokens > 0")
    copies = counted.groupBy("key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    texts = copies.groupBy("key").agg(F.max("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("of"))
    texts = checkpoint(texts.withColumn("pattern", F.array_join("of.source", "\n")))
    sums = texts.groupBy("pattern").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    found = sums.limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"the sources overlap in more than {PATTERNS} ways")
    patterns = {tuple(r.pattern.split("\n")): r.n for r in found}
    _, flows = route(patterns, {s: t for s, (t, _) in asked.items()}, {s: m for s, (_, m) in asked.items()}, total)
    stretches = []
    for p, n in sorted(patterns.items()):
        at = 0
        for s in p:
            if take := flows.get((p, s)):
                stretches.append(("\n".join(p), s, at, at + take, n))
                at += take
    lines = spark.createDataFrame(stretches, "pattern string, source string, first bigint, last bigint, length bigint")

    n_buckets = max(1, sum(r.k for r in found) // BUCKET)
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key"), 33)
    laid = texts.withColumn("h", order).withColumn("bucket", F.floor(F.col("h") * F.lit(n_buckets) / F.lit(float(1 << 31))))
    offsets = laid.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("own"))
    ahead = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("pattern", "bucket", F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("offset"))
    within = Window.partitionBy("pattern", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.join(offsets, ["pattern", "bucket"]).withColumn("x", F.col("offset") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    taken = placed.select("pattern", "x", "n_tokens", F.explode("of").alias("o")).select("pattern", "x", "n_tokens", "o.source", "o.doc_id").join(lines, ["pattern", "source"])

    def turns(end: str):
        # copies of the text that begin before this point of the line
        return F.greatest(F.ceil((F.col(end) - F.col("x")) / F.col("length")), F.lit(0))

    taken = taken.withColumn("n_uses", (turns("last") - turns("first")).cast("bigint"))
    selection = checkpoint(taken.where("n_uses > 0").select("doc_id", "source", "n_uses", "n_tokens"))
    by_source = selection.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("n_uses") * F.col("n_tokens")).alias("n_tokens"), F.max("n_uses").alias("n_repeats")
    )
    wanted = spark.createDataFrame([(s, t, m) for s, (t, m) in sorted(asked.items())], "source string, target_share double, max_repeats int")
    shares = wanted.join(by_source, "source", "left").fillna(0, ["n_docs", "n_tokens", "n_repeats"])
    every = shares.agg(F.sum("n_tokens").alias("every"))
    shares = shares.crossJoin(every).withColumn("reached_share", F.coalesce(F.try_divide(F.col("n_tokens").cast("double"), "every"), F.lit(0.0)))
    return selection, shares.select("source", "target_share", "max_repeats", "n_docs", "n_tokens", "reached_share", "n_repeats")
