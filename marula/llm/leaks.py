"""Problem 8: evaluation texts leaking into training text.

Method: the words of all test passages make one generalised suffix automaton. The
words of each document are streamed through it, which tracks the length of the
longest match that ends at every word, in a time that depends on the document only.
Where it reaches ``min_words``, the state says which items share that passage. A
document's spans of at least that length can be removed, and the whole document if
they cover more than a given share of it.

The automaton is sent to all tasks, so its size is checked: test items of more than
``WORDS`` words are handled in blocks, each against all documents.

Words are compared without case, punctuation and line layout; a word parted by a
hyphen at a line's end is joined where the passages know it joined. Defined results:
null and empty texts and passages match nothing; an item whose passage is shared
comes out beside the others; repeated documents come out each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most words of test items for one automaton (it has at most twice as many states).
WORDS = 500_000
_word = re.compile(r"[^\W_]+")
_parted = re.compile(r"([^\W_]+)[-‐]\s*\n[\s>]*([^\W_]+)")
_unseen = re.compile("[­​-‍⁠﻿]")


def words(text: str) -> list[str]:
    """The words of a passage, lower-cased."""
    return _word.findall(_unseen.sub("", text).lower())


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the items of its long substrings."""

    def __init__(self, passages: Iterable[tuple[int, list[str]]], min_words: int):
        self.number: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.min_words = [-1], [0], min_words
        texts = [(i, [self.number.setdefault(w, len(self.number)) for w in ws]) for i, ws in passages]
        for text in {tuple(t) for _, t in texts}:
            last = 0
            for c in text:
                last = self._extend(last, c)
        # the state that stands for the shortest substrings of at least min_words words
        self.top = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            self.top[s] = self.top[up] if self.length[up] >= min_words else s
        #: pieces of half the least match that stand anywhere in the passages
        self.half = max(1, min_words // 2)
        self.pieces = {tuple(text[k : k + self.half]) for _, text in texts for k in range(len(text) - self.half + 1)}
        self.items: dict[int, set[int]] = {}
        for i, text in texts:
            s = 0
            for n, c in enumerate(text, 1):
                s = self.next[s][c]
                if n >= min_words:
                    self.items.setdefault(self.top[s], set()).add(i)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = self._state({}, length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, edges: dict[int, int], length: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def may_match(self, numbers: list[int]) -> bool:
        """Whether any match is possible: one of min_words holds a whole piece that begins at a multiple of its length."""
        h = self.half
        return not self.pieces.isdisjoint(zip(*(numbers[k::h] for k in range(h))))

    def matches(self, numbers: list[int]) -> list[tuple[int, int, int]]:
        """(position, matching length, state) of every word that ends a match of at least min_words."""
        if not self.may_match(numbers):
            return []
        nxt, link, length, least = self.next, self.link, self.length, self.min_words
        out, s, n = [], 0, 0
        for at, c in enumerate(numbers):
            if c < 0:
                s = n = 0
                continue
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s = nxt[s][c]
                n += 1
                if n >= least:
                    out.append((at, n, self.top[s]))
            else:
                n = 0
        return out


#: A document on its way through the blocks: items and longest matches by turns, starts and ends of spans of words by turns.
_PASSED = "_id bigint, text string, hits array<bigint>, spans array<bigint>"


def _joining(passages: list[tuple[int, str]]):
    """Joins words parted at a line's end where the passages know them joined."""

    def ready():
        known = {w for _, p in passages for w in words(p)}

        def joined(m: re.Match) -> str:
            return m[1] + m[2] + "\n" if (m[1] + m[2]).lower() in known else m[0]

        def step(doc: list) -> None:
            if "\n" in doc[1] and _parted.search(doc[1]):
                doc[1] = _parted.sub(joined, doc[1])

        return step

    return ready


def _matching(passages: list[tuple[int, str]], min_words: int):
    """Adds the items and spans of words that the passages share with a document."""

    def ready():
        sam = SuffixAutomaton(((i, words(p)) for i, p in passages), min_words)
        known = sam.number.get

        def step(doc: list) -> None:
            if not doc[1].isascii():
                doc[1] = _unseen.sub("", doc[1])
            items: dict[int, int] = {}
            covered: list[list[int]] = []
            for at, n, top in sam.matches([known(w, -1) for w in _word.findall(doc[1].lower())]):
                for i in sam.items[top]:
                    items[i] = max(items.get(i, 0), n)
                start = at - n + 1
                if covered and start <= covered[-1][1]:
                    covered[-1][1] = at + 1
                else:
                    covered.append([start, at + 1])
            doc[2] += [x for item in items.items() for x in item]
            doc[3] += [x for span in covered for x in span]

        return step

    return ready


def _spots(text: str) -> list[tuple[int, int]]:
    """Where the words of the lower-cased text stand in the text, also if lower case is longer."""
    low = text.lower()
    spots = [m.span() for m in _word.finditer(low)]
    if len(low) != len(text):
        origin = [i for i, c in enumerate(text) for _ in c.lower()]
        spots = [(origin[s], origin[e - 1] + 1) for s, e in spots]
    return spots


def _steps(steps: list):
    """Documents through one or more steps."""

    def run(docs: Iterator[list[list]]) -> Iterator[list[list]]:
        own = [ready() for ready in steps]
        for batch in docs:
            for doc in batch:
                for step in own:
                    step(doc)
            yield batch

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    for b in batches:
        yield [list(x) for x in zip(*(b.column(c).to_pylist() for c in ("_id", "text", "hits", "spans")))]


def _passing(steps: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for docs in _steps(steps)(_read(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in docs], t) for k, t in enumerate(kinds)], ["_id", "text", "hits", "spans"])

    return run


def _cutting(steps: list, max_cover: float):
    """The last steps, then a row for each item with what all blocks' spans together leave of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _steps(steps)(_read(batches)):
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text, hits, spans in docs:
                if not hits:
                    continue
                covered: list[list[int]] = []
                for s, e in sorted(zip(spans[::2], spans[1::2])):
                    if covered and s <= covered[-1][1]:
                        covered[-1][1] = max(covered[-1][1], e)
                    else:
                        covered.append([s, e])
                spots = _spots(text)
                n_words = sum(e - s for s, e in covered)
                share = n_words / len(spots)
                clean, end = [], 0
                for s, e in covered if share <= max_cover else []:
                    clean.append(text[end : spots[s][0]])
                    end = spots[e - 1][1]
                rest = "".join(clean) + text[end:] if share <= max_cover else None
                for i, n in sorted(zip(hits[::2], hits[1::2])):
                    for col, v in zip(cols, (doc, i, n, n_words, share, rest)):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "longest", "n_words", "share", "clean_text"])

    return run


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, min_words: int = 12, max_cover: float = 0.5) -> DataFrame:
    """Rows (doc_id, item_id, longest, n_words, share, clean_text), one for each leaked item of a document.

    longest: words of the longest match. n_words and share: the document's words
    inside matches of any item. clean_text: the document without them,
    null if they cover more than max_cover of it.
    """
    usable = items.where(F.col(passage).isNotNull() & F.col(item_id).isNotNull())
    usable = usable.select(F.col(item_id).cast("bigint").alias("i"), F.col(passage).alias("p"))
    size = usable.agg(F.sum(F.size(F.split("p", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-int(size) // WORDS))
    empty = F.array().cast("array<bigint>")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("text"), empty.alias("hits"), empty.alias("spans"))
    part = lambda k: [(r.i, r.p) for r in (usable if blocks == 1 else usable.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)).collect()]
    # words are joined by all blocks first, so that all number the same words
    steps = [*((_joining, (k,)) for k in range(blocks)), *((_matching, (k, min_words)) for k in range(blocks))]
    last = [make(part(k), *more) for make, (k, *more) in (steps if blocks == 1 else steps[-1:])]
    for make, (k, *more) in [] if blocks == 1 else steps[:-1]:
        rows = rows.mapInArrow(_passing([make(part(k), *more)]), _PASSED)
    return rows.mapInArrow(_cutting(last, max_cover), "doc_id bigint, item_id bigint, longest bigint, n_words bigint, share double, clean_text string")
