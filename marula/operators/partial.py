"""The most similar of many names for each of many texts by the best-window ratio, without scoring them all with all."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Sequence

from marula.operators.records import _coded, _masks, partial_ratio

#: How many characters of a window may match nothing, for the bounds of a word. Fixed values.
SPARE = (10,)
#: Names are at most that long, for the bounds at a text's ends. Fixed values.
SIZES = (24, 40, 64)
#: Cells of a table of words and places, of one step of scoring, and of texts and names of one turn.
CELLS, STEP, TURN = 24_000_000, 120_000, 4_000_000
#: So few names are scored without bounds, beside that many times more texts.
FEW, MANY = 200, 20
#: How many names are scored in each turn.
WIDTHS = (12, 48, 192, None)
#: Windows that are looked at as one first.
STRIDE = 8


def _common(words: Sequence[str], runs: Sequence[tuple[str, str]], spare: int):
    """Rows of runs, columns of words: the most characters of a word in order within a stretch of its length and spare more that begins in the run's first part.

    Stretches start at every stride-th place and are longer by that, so it's never too few.
    """
    import numpy as np

    stride = _stride(spare)
    longest = min(max(map(len, words)), 64) + spare + stride
    codes = {c: i for i, c in enumerate(sorted(set("".join(words))), 1)}
    order = sorted(range(len(runs)), key=lambda i: len(runs[i][0]))
    out = np.zeros((len(runs), len(words)), np.uint8)
    sized: dict[int, list[int]] = {}
    for j, w in enumerate(words):
        sized.setdefault(len(w), []).append(j)
    width = max(len(runs[i][0]) for i in order) + longest
    text = _rows([(head + tail)[:width] for head, tail in runs], codes, width)
    heads = np.array([len(runs[i][0]) for i in order])
    order = np.array(order)
    for n, js in sized.items():
        if n == 0 or n > 64:
            out[:, js] = min(n, 255)
            continue
        kind = np.uint8 if n <= 8 else np.uint16 if n <= 16 else np.uint32 if n <= 32 else np.uint64
        table = np.ascontiguousarray(_masks([words[j] for j in js], codes).T).astype(kind)
        full = kind((1 << n) - 1)
        size = max(1, STEP // len(js))
        for at in range(0, len(order), size):
            best = np.zeros((len(order[at : at + size]), len(js)), np.uint8)
            part, head = order[at : at + size], heads[at : at + size]
            for start in range(0, int(head[-1]), stride):
                first = int(np.searchsorted(head, start, "right"))
                own = part[first:]
                row = np.full((len(own), len(js)), full)
                hit, less = np.empty_like(row), np.empty_like(row)
                for p in range(start, start + n + spare + stride - 1):
                    table.take(text[own, p], 0, hit, "clip")
                    hit &= row
                    np.subtract(row, hit, less)
                    row += hit
                    row |= less
                row &= full
                np.maximum(best[first:], np.uint8(n) - np.bitwise_count(row), out=best[first:])
            out[part[:, None], np.array(js)] = best
    return out


def _rows(texts: Sequence[str], codes: dict[str, int], width: int):
    """The texts' characters by their codes, 0 for others, a row each; codes count the sorted characters from 1."""
    import numpy as np

    out = np.zeros((len(texts), width), np.int32)
    sizes = np.array([len(x) for x in texts])
    known = np.frombuffer("".join(codes).encode("utf-32-le", "surrogatepass"), np.uint32)
    every = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.minimum(np.searchsorted(known, every), max(0, len(known) - 1))
    own = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if len(known):
        out[own, place] = np.where(known[at] == every, at + 1, 0)
    return out


class _Bounds:
    """Upper bounds of how many characters of each name stand in order in a window of each text; names are sorted by length.

    They add up over a name's words. A word's characters stand in the text within a
    stretch that's longer than the word by the window's unmatched characters at most.
    """

    def __init__(self, texts: Sequence[str], names: Sequence[str], spares: Sequence[int]) -> None:
        import numpy as np

        self.spares = spares
        parts = [y.split(" ") for y in names]
        words = sorted({w for p in parts for w in p})
        at = {w: i for i, w in enumerate(words)}
        uses = [[at[w] for w in p] for p in parts]
        lengths = np.array([len(y) for y in names])
        sizes = np.array([len(x) for x in texts])
        cuts = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(names)]
        self.groups = [(i, j, int(lengths[i])) for i, j in zip(cuts, cuts[1:])]
        self.sizes = sizes
        longest = max(map(len, words))
        self.kind = np.uint8 if lengths[-1] <= 250 else np.int32
        # for each number of unmatched characters: in the whole text, and at its ends
        self.whole, self.ends = (np.zeros((len(spares), len(names), len(texts)), self.kind) for _ in range(2))
        for level, spare in enumerate(spares):
            tail = min(longest, 64) + spare + _stride(spare)
            runs: dict[tuple[str, str], int] = {}
            held = []
            for x in texts:
                places = [m.span() for m in re.finditer("[^ ]* ?", x) if m.end() > m.start()]
                held.append([(runs.setdefault((x[i:j], x[j : j + tail]), len(runs)), i, j) for i, j in places])
            kinds = [[[r for r, _, _ in h] for h in held]]
            for size in SIZES:
                kinds.append([[r for r, i, _ in h if i < size] for h in held])
                kinds.append([[r for r, _, j in h if j + tail > len(x) - size] for x, h in zip(texts, held)])
            step = max(1, CELLS // max(1, len(runs)))
            for low in range(0, len(words), step):
                some = words[low : low + step]
                common = _common(some, list(runs), spare)

                def sums(kind: int, which: range, out) -> None:
                    best = np.zeros((len(texts), len(some)), np.uint8)
                    for i, r in enumerate(kinds[kind]):
                        if r:
                            common.take(r, 0).max(axis=0, out=best[i])
                    best = np.ascontiguousarray(best.T)
                    for j in which:
                        for w in uses[j]:
                            if low <= w < low + len(some):
                                out[j] += best[w - low]

                sums(0, range(len(names)), self.whole[level])
                first = 0
                for k, size in enumerate(SIZES):
                    last = int(np.searchsorted(lengths, size, "right"))
                    if last > first:
                        other = np.zeros_like(self.whole[level])
                        sums(1 + 2 * k, range(first, last), self.ends[level])
                        sums(2 + 2 * k, range(first, last), other)
                        np.maximum(self.ends[level], other, out=self.ends[level])
                    first = last
        blanks = np.array([len(p) - 1 + sum(len(w) - 255 for w in p if len(w) > 255) for p in parts], self.kind)[:, None]
        self.whole += blanks
        self.ends += blanks
        for i, j, n in self.groups:
            # a text no longer than the name has windows at its ends all over
            some = slice(None) if n > SIZES[-1] else sizes <= n
            self.ends[:, i:j, some] = self.whole[:, i:j, some]

    def part(self, some) -> _Bounds:
        """The bounds of some of the texts."""
        out = object.__new__(_Bounds)
        out.spares, out.kind, out.groups, out.sizes = self.spares, self.kind, self.groups, self.sizes[some]
        out.whole, out.ends = self.whole[:, :, some], self.ends[:, :, some]
        return out

    def open(self, least):
        """Whether a name's score may be at least that of each text in a whole window, and in one that's clipped."""
        import numpy as np

        share = np.maximum(least / 100 - 1e-9, 0)
        whole, ends = (np.ones(self.whole.shape[1:], bool) for _ in range(2))
        for i, j, n in self.groups:
            size = np.minimum(self.sizes, n)
            # a text's unmatched characters: of a window of it, or of all of it if it's the shorter side
            loose = np.where(self.sizes <= n, 2 * (1 - share) / (2 - share) * size, (1 - share) * n)
            for bound, out, need in ((self.whole, whole, share * size), (self.ends, ends, share / (2 - share) * size)):
                for level, spare in enumerate(self.spares):
                    # with more unmatched characters the bound doesn't hold
                    out[i:j] &= bound[level, i:j] >= np.where(loose < spare + 1, np.ceil(need), 0).astype(self.kind)
        return whole, ends

    def guess(self):
        """A number from 1 to 101 that grows with the likely score."""
        import numpy as np

        out = np.zeros(self.whole.shape[1:], np.uint8)
        for i, j, n in self.groups:
            size = np.maximum(np.minimum(self.sizes, n), 1)
            out[i:j] = np.minimum(self.whole[-1, i:j] * np.float32(100) / size.astype(np.float32), 100) + 1
        return out


def _stride(spare: int) -> int:
    return 4 if spare <= 8 else 8


class _Scorer:
    """Exact scores of pairs of a text and a name, those whose shorter sides have one length side by side."""

    def __init__(self, texts: Sequence[str], names: Sequence[str]) -> None:
        import numpy as np

        self.both = texts, names
        codes = {c: i for i, c in enumerate(sorted(set("".join(names))), 1)}
        self.sizes = tuple(np.array([len(x) for x in side]) for side in self.both)
        self.coded, self.tables, self.more, self.turned, self.halves = [], [], [], {}, {}
        for side in self.both:
            coded = _rows(side, codes, max(map(len, side)))
            self.coded.append(coded)
            # no character of a name has the code 0
            for first, tables in ((0, self.tables), (64, self.more)):
                table = np.zeros((len(side), len(codes) + 1), np.uint64)
                for place in range(first, min(first + 64, coded.shape[1])):
                    table[np.arange(len(side)), coded[:, place]] |= np.uint64(1 << (place - first))
                table[:, 0] = 0
                tables.append(table)

    def scores(self, i, j, least, whole):
        """Scores of texts i and names j, exact where they are at least that; whole: whether more than the clipped windows can reach it."""
        import numpy as np

        out = np.zeros(len(i))
        size, n = self.sizes[0][i], self.sizes[1][j]
        less = np.minimum(n, size)
        for p in np.flatnonzero((less > 128) | (less == 0)).tolist():
            out[p] = partial_ratio(self.both[0][i[p]], self.both[1][j[p]])
        whole = whole | (less > 64)
        for (short, long, own, other, usable), all_ in itertools.product(((1, 0, j, i, n < size), (0, 1, i, j, n >= size)), (True, False)):
            places = np.flatnonzero(usable & (less <= 128) & (less > 0) & (whole == all_))
            lengths, sizes = self.sizes[short][own], self.sizes[long][other]
            places = places[np.lexsort((sizes[places], lengths[places]))]
            for same in np.split(places, np.flatnonzero(np.diff(lengths[places])) + 1):
                if len(same):
                    span = int(sizes[same[-1]] + lengths[same[0]])
                    score = self._clipped if not all_ else self._near if lengths[same[0]] <= 64 else self._windows
                    step = max(1, STEP // 4 // (span if score == self._windows else 1 + span // STRIDE)) if all_ else STEP // 12
                    for at in range(0, len(same), step):
                        part = same[at : at + step]
                        out[part] = score(short, long, own[part], other[part], least[part] / 100)
        return out

    def _near(self, short: int, long: int, own, other, least):
        """The same as _windows, for up to 64 characters: single windows only where what STRIDE of them cover together is enough."""
        import numpy as np

        n, size = int(self.sizes[short][own[0]]), self.sizes[long][other]
        low = _shortest(n, float(least.min()))
        top, before = int(size.max()), n - low
        groups = -(-(top + before - low + 1) // STRIDE)
        kind = np.uint32 if n <= 32 else np.uint64
        full = kind((1 << n) - 1)
        masks = np.zeros((max(before + top, groups * STRIDE + n), len(own)), kind)
        masks[before : before + top] = self._table(short, n)[own[None, :], self.coded[long][other, :top].T]
        row = np.full((groups, len(own)), full)
        hit, less = np.empty_like(row), np.empty_like(row)
        for t in range(n + STRIDE - 1):
            np.bitwise_and(row, masks[t : t + (groups - 1) * STRIDE + 1 : STRIDE], hit)
            np.subtract(row, hit, less)
            row += hit
            row |= less
        row &= full
        first = np.arange(0, groups * STRIDE, STRIDE)[:, None] - before
        length = lambda s: np.minimum(s + n, size) - np.maximum(s, 0)
        # the shortest of the group's windows that can reach the least score
        shortest = np.maximum(np.minimum(length(first), length(first + STRIDE - 1)), least * n / (2 - least))
        group, pair = np.nonzero(n - np.bitwise_count(row) >= least * (n + shortest) / 2 - 1e-6)
        out = np.zeros(len(own))
        for at in range(0, len(pair), STEP // 12):
            g, p = group[at : at + STEP // 12] * STRIDE, pair[at : at + STEP // 12]
            np.maximum.at(out, p, self._single(masks[g + np.arange(n + STRIDE - 1)[:, None], p], n, g - before, size[p]))
        return out

    def _single(self, masks, n: int, first, size):
        """The best of the windows at STRIDE places from the first on, for each column of masks of their characters."""
        import numpy as np

        full = masks.dtype.type((1 << n) - 1)
        row = np.full((STRIDE, masks.shape[1]), full)
        hit, less = np.empty_like(row), np.empty_like(row)
        for t in range(n):
            np.bitwise_and(row, masks[t : t + STRIDE], hit)
            np.subtract(row, hit, less)
            row += hit
            row |= less
        start = first + np.arange(STRIDE)[:, None]
        length = np.minimum(start + n, size) - np.maximum(start, 0)
        return (200.0 * (n - np.bitwise_count(row & full).astype(np.int64)) / (n + np.maximum(length, 0))).max(axis=0)

    def _windows(self, short: int, long: int, own, other, least):
        import numpy as np

        n, size = int(self.sizes[short][own[0]]), self.sizes[long][other]
        low = _shortest(n, float(least.min()))
        top, before = int(size.max()), n - low
        starts = np.arange(-before, top - low + 1)[:, None]
        kind = np.uint32 if n <= 32 else np.uint64
        words = []
        for table, bits in ((self.tables[short], min(n, 64)), (self.more[short], n - 64)):
            if bits > 0:
                masks = np.zeros((before + top + n, len(own)), kind)
                masks[before : before + top] = table[own[None, :], self.coded[long][other, :top].T]
                full = kind((1 << bits) - 1)
                words.append((masks, full, np.full((len(starts), len(own)), full)))
        hit, less, was = (np.empty_like(words[0][2]) for _ in range(3))
        for t in range(n):
            carry = None
            for masks, _, row in words:
                np.bitwise_and(row, masks[t : t + len(starts)], hit)
                np.subtract(row, hit, less)
                if len(words) > 1:
                    was[:] = row
                row += hit
                if carry is None and len(words) > 1:
                    carry = (row < was).astype(kind)
                elif carry is not None:
                    row += carry
                row |= less
        common = n - sum(np.bitwise_count(row & full).astype(np.int64) for _, full, row in words)
        length = np.minimum(starts + n, size) - np.maximum(starts, 0)
        return (200.0 * common / (n + np.maximum(length, 0))).max(axis=0)

    def _clipped(self, short: int, long: int, own, other, least):
        """The best of the windows at the ends that are shorter than the shorter side."""
        import numpy as np

        n, size = int(self.sizes[short][own[0]]), self.sizes[long][other]
        kind = np.uint32 if n <= 32 else np.uint64
        best, full = np.zeros(len(own)), kind((1 << n) - 1)
        for turned, place in ((False, lambda m, of: m + 0 * of), (True, lambda m, of: of - 1 - m)):
            if n < 2:
                break
            chars = self.coded[long][other, place(np.arange(n - 1)[:, None], size)]
            masks = self._table(short, n, turned)[own, chars]
            row = np.full(len(own), full)
            for m in range(n - 1):
                hit = row & masks[m]
                row = (row + hit) | (row - hit)
            common = n - np.bitwise_count(row & full).astype(np.int64)
            # a window is no shorter than what it has in common
            some = np.flatnonzero(200.0 * common / (n + common) >= 100 * least - 1e-9)
            if len(some):
                low = _shortest(n, float(least[some].min()))
                masks, row, top = masks[:, some], np.full(len(some), full), np.zeros(len(some))
                for m in range(n - 1):
                    hit = row & masks[m]
                    row = (row + hit) | (row - hit)
                    if m + 1 >= low:
                        np.maximum(top, 200.0 * (n - np.bitwise_count(row & full).astype(np.int64)) / (n + m + 1), out=top)
                best[some] = np.maximum(best[some], top)
        return best

    def _table(self, side: int, n: int, turned: bool = False):
        """The table of a side, in half the bytes for texts of up to 32 characters."""
        import numpy as np

        table = self._reversed(side) if turned else self.tables[side]
        if n > 32:
            return table
        if (side, turned) not in self.halves:
            self.halves[side, turned] = table.astype(np.uint32)
        return self.halves[side, turned]

    def _reversed(self, side: int):
        """The table of the texts of up to 64 characters, read from their ends."""
        import numpy as np

        if side not in self.turned:
            table = np.zeros_like(self.tables[side])
            sizes = self.sizes[side]
            for place in range(64):
                rows = np.flatnonzero((sizes > place) & (sizes <= 64))
                table[rows, self.coded[side][rows, sizes[rows] - 1 - place]] |= np.uint64(1 << place)
            table[:, 0] = 0
            self.turned[side] = table
        return self.turned[side]


def _shortest(n: int, least: float) -> int:
    """Clipped windows below this length can't reach the least score."""
    return max(1, math.ceil(max(0.0, least - 1e-9) * n / (2 - least) - 1e-9))


def best_names(texts: Sequence[str], names: Sequence[str], k: int, gap: float | None = None, accept: float = 0.0, floor: float = 0.0, reached=None) -> list[list[tuple[float, int]]]:
    """For each text names (score, index) by partial ratio, all of at least a score: that of the k-th best.

    With a gap that score is higher: only those that come within the gap of the best one,
    if the best one can be accepted, else only those level with it. floor is the least
    score of interest. reached: for each text scores of other names, k at most. No name of
    at least that score is lost; others may be among them.
    """
    import numpy as np

    out: list[list[tuple[float, int]]] = [[] for _ in texts]
    if not texts or not names:
        return out
    low = np.full((len(texts), k), -1.0)
    for i, r in enumerate(reached or ()):
        low[i, : len(r[:k])] = sorted(r, reverse=True)[:k]

    def least():
        v = np.maximum(low[:, -1], floor)
        if gap is not None:
            v = np.maximum(v, np.maximum(np.minimum(low[:, 0], accept - gap), low[:, 0] - gap))
        return v

    order = sorted(range(len(names)), key=lambda j: len(names[j]))
    names = [names[j] for j in order]
    scorer = _Scorer(texts, names)
    every = np.arange(len(texts))
    size = max(1, TURN // len(names))

    def turn(some, guess, bounds: _Bounds | None, width: int | None) -> None:
        """Scores the likeliest names, or all, that the bounds leave open for some texts, and strikes them out."""
        limit = least()[some]
        whole, ends = bounds.open(limit) if bounds else (np.ones(guess.shape, bool),) * 2
        guess[~(whole | ends)] = 0
        rank = np.ascontiguousarray(guess.T)
        if width is not None and width < len(names):
            ahead = np.argpartition(rank, len(names) - width, axis=1)[:, len(names) - width :]
            i, c = np.nonzero(np.take_along_axis(rank, ahead, 1))
            j = ahead[i, c]
        else:
            i, j = np.nonzero(rank)
        guess[j, i] = 0
        got = scorer.scores(some[i], j, np.maximum(limit[i], 0), whole[j, i])
        good = np.flatnonzero(got >= limit[i] - 1e-9)
        i, j, got = i[good], j[good], got[good]
        for x, y, v in zip(some[i].tolist(), j.tolist(), got.tolist()):
            out[x].append((v, order[y]))
        cuts = np.searchsorted(i, np.arange(len(some) + 1))
        for x in np.flatnonzero(np.diff(cuts)).tolist():
            low[some[x]] = np.sort(np.concatenate((low[some[x]], got[cuts[x] : cuts[x + 1]])))[::-1][:k]

    if len(names) <= min(FEW, len(texts) // MANY):
        for at in range(0, len(texts), size):
            some = every[at : at + size]
            own = np.ones((len(names), len(some)), np.uint8)
            for width in (max(4, k), None):
                turn(some, own, None, width)
        limit = least()
        return [[(v, y) for v, y in found if v >= limit[x] - 1e-9] for x, found in enumerate(out)]
    bounds = _Bounds(texts, names, SPARE)
    guess = bounds.guess()
    turn(every, guess, bounds, max(4, k))
    for at in range(0, len(texts), size):
        some = every[at : at + size]
        own, part = guess[:, some], bounds.part(some)
        for width in WIDTHS:
            turn(some, own, part, width)
    limit = least()
    return [[(v, y) for v, y in found if v >= limit[x] - 1e-9] for x, found in enumerate(out)]


_DIGIT = re.compile(r"\d")


def nearest(texts: Sequence[str], names: Sequence[str], k: int, **limits) -> list[list[tuple[float, int]]]:
    """best_names, for any number of texts and names.

    For a name without digits all digits of a text are alike, so texts that differ by
    numbers only meet such names once. Texts with the same end stand side by side.
    """
    out: list[list[tuple[float, int]]] = [[] for _ in texts]
    for numbered in (False, True):
        some = [j for j, y in enumerate(names) if bool(_DIGIT.search(y)) == numbered]
        if not some:
            continue
        same: dict[str, list[int]] = {}
        for i, x in enumerate(texts):
            same.setdefault(x if numbered else _DIGIT.sub("0", x), []).append(i)
        kinds = sorted(same, key=lambda x: x[::-1])
        size = min(4000, max(500, CELLS // len(some)))
        for at in range(0, len(kinds), size):
            part = kinds[at : at + size]
            reached = [[v for v, _ in out[same[x][0]]] for x in part]
            for x, found in zip(part, best_names(part, [names[j] for j in some], k, reached=[sorted(r, reverse=True) for r in reached], **limits)):
                for i in same[x]:
                    out[i].extend((v, some[j]) for v, j in found)
    return out
