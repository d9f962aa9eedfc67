"""Problem 7: mapping free-entered values to a canonical list.

Method: token-level repair. Typed values and list entries are cut to words without
case, marks, hyphens and plural endings. Each distinct typed word, and each pair of
adjacent words written as one, is joined to the vocabulary of the list by edit
distance (insertions, deletions, substitutions and swaps of neighbours), through
the words' forms with up to two letters deleted. The repaired words of a value are
then combined by soft TF-IDF to rank whole entries: every entry that shares a repaired
word is scored by the best one-to-one assignment of typed words to its words, typed
words that fit none and entry words that nothing fits weighing against it. The best
entry is taken if its score is at least ``least``. Words that only link others
("of", "for") have little weight, so a value may have one more or one less of them.

A typed word near a word of the list may be a word of its own. It's taken for a typing
error unless it's typed too often for one, both in rows and in distinct written forms,
held by a test of counts against a share ``ERROR`` of the list word's (Poisson,
probability under ``UNLIKELY``). Being of shares, the test says the same at every size; one error copied into
many rows has few written forms, and one made by many people has few rows.

All joins are on distinct words and distinct values. The list is counted before it is
sent to tasks, and one of more than ``BLOCK`` forms goes in blocks of entries, of which
the best is taken. Values with more words than any entry could outweigh are unmatched
without further work.

Defined results: null and blank values are unmatched; repeated values come out for
each row; ties go to the smaller name.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marula.session import checkpoint

UNMATCHED = "(unmatched)"
#: Most written forms of the list that tasks hold at once.
BLOCK = 20_000
#: The share of a list word's uses that one typing error of it may have, uses that any error may have besides, and how unlikely more must be to speak against an error.
ERROR, BESIDES, UNLIKELY = 0.02, 0.1, 1e-4
#: Similarity of an abbreviation, what a word loses for edits in all of its letters, least score of an accepted entry, weight of linking words.
SHORTENED, LOSS, LEAST, LINK = 0.95, 0.2, 0.9, 0.1
#: Words that link others. Fixed values.
LINKS = {"of", "for", "the", "and", "in", "on", "to", "a", "an", "de", "des", "du", "la", "le", "les", "et", "en"}
#: Abbreviations that aren't the beginning of their word. Fixed values.
SHORT = {"hh": "household", "hhs": "household", "intl": "international", "govt": "government", "dept": "department", "mgmt": "management"}
_words = re.compile(r"[^\W_]+")


def singular(w: str) -> str:
    """A word without its plural ending."""
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if len(w) > 3 and w.endswith("s") and not w.endswith("ss"):
        return w[:-1]
    return w


def plain_words(text: Column) -> Column:
    """The words of a typed value, with a full stop kept at the end of those that have one."""
    marked = F.regexp_replace(F.lower(text), r"(\p{L}{2,})\.", "$1\u0001")
    return F.filter(F.split(marked, r"[^\p{L}\p{N}\p{M}\x{1}]+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or most + 1 if it's larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before = last
    return row[-1]


def allowed(n: int) -> int:
    """Edits taken for a typing error in a word of n letters."""
    return 0 if n < 4 else 1 if n < 6 else 2


def deletions(w: str, depth: int) -> set[str]:
    """The word with up to depth letters left out."""
    out = layer = {w}
    for _ in range(depth):
        layer = {x[:i] + x[i + 1 :] for x in layer for i in range(len(x))}
        out = out | layer
    return out


def too_often(n: int, of: int) -> bool:
    """Whether n uses are more than a typing error of a word with so many uses would have."""
    mean = ERROR * of + BESIDES
    if n <= mean:
        return False
    if mean > 200:
        # by the normal distribution that so large a mean comes near
        return math.erfc((n - 0.5 - mean) / math.sqrt(2 * mean)) / 2 < UNLIKELY
    term = below = math.exp(-mean)
    for k in range(1, n):
        term *= mean / k
        below += term
    return 1 - below < UNLIKELY


def words_of(text: str) -> tuple[str, ...]:
    """The words of a list entry, without plural endings."""
    return tuple(singular(w) for w in _words.findall(unicodedata.normalize("NFKC", text).lower()))


def bags_of(forms: Iterable[tuple[str, str]]) -> dict[tuple[str, ...], str]:
    """The sorted words of each written form, also with a hyphened compound as one word, and the smallest entry it stands for."""
    bags: dict[tuple[str, ...], str] = {}
    for form, to in sorted(forms, key=lambda x: (x[1], x[0])):
        text = unicodedata.normalize("NFKC", form).lower()
        bags.setdefault(tuple(sorted(words_of(text))), to)
        for m in re.finditer(r"[^\W_]+(?:[-‐–][^\W_]+)+", text):
            whole = singular("".join(_words.findall(m.group())))
            bags.setdefault(tuple(sorted([whole, *words_of(text[: m.start()] + " " + text[m.end() :])])), to)
    bags.pop((), None)
    return bags


class Entries:
    """Forms of the canonical list as bags of words, with the weights of soft TF-IDF.

    forms: (written form, entry). idf: the weights of the words over the whole list.
    """

    def __init__(self, forms: list[tuple[str, str]], idf: dict[str, float], most: float):
        self.bags = sorted(bags_of(forms).items())
        #: every written form of the list's words and the form that bags hold
        self.forms = {w: singular(w) for f, _ in forms for w in _words.findall(unicodedata.normalize("NFKC", f).lower())}
        self.forms.update((w, w) for bag, _ in self.bags for w in bag if w not in self.forms)
        self.idf, self.most = idf, most
        self.norms = [math.sqrt(sum(self.weight(w) ** 2 for w in bag)) for bag, _ in self.bags]
        self.by_word: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (bag, _) in enumerate(self.bags):
            for w in set(bag):
                self.by_word[w].append((k, bag.count(w)))

    def weight(self, w: str) -> float:
        return LINK if w in LINKS else self.idf.get(w, self.most)

    def best(self, tokens: list[str], matches: Iterable[tuple[int, int, str, float]], least: float) -> tuple[str, float] | None:
        """The best entry of at least that score for typed words, given (position, words, list word, similarity) of each repair."""
        at: dict[int, list[tuple[int, str, float]]] = defaultdict(list)
        shared: dict[int, float] = defaultdict(float)
        for pos, size, word, sim in matches:
            at[pos].append((size, word, sim))
        for word in {w for ws in at.values() for _, w, _ in ws}:
            for k, copies in self.by_word[word]:
                shared[k] += copies * self.weight(word) ** 2
        # the score is at most what the shared words are of the entry's norm
        near = [k for k, w2 in shared.items() if math.sqrt(w2) >= least * self.norms[k]]
        alone = [LINK if w in LINKS else self.most for w in tokens]
        found = None
        for k in near:
            bag, to = self.bags[k]
            score = self._score(bag, self.norms[k], at, alone)
            if score >= least and (found is None or (-score, to) < (-found[1], found[0])):
                found = to, score
        return found

    def _score(self, bag: tuple[str, ...], norm: float, at: dict[int, list[tuple[int, str, float]]], alone: list[float]) -> float:
        """Soft TF-IDF of typed words and a bag: common weight over the product of both norms, for the best assignment.

        Goes from left to right over the typed words; a state is which words of the bag are
        taken and holds the common weight and the squared norm of the typed side that
        none other of the same state beats. A typed word that fits has the weight of the word it
        fits; one that doesn't has that of an unknown word.
        """
        slot = {w: i for i, w in enumerate(dict.fromkeys(bag))}
        copies = [bag.count(w) for w in slot]
        paired = {slot[w] for ws in at.values() for size, w, _ in ws if size == 2 and w in slot}
        states: list[dict[tuple[int, ...], set[tuple[float, float]]]] = [defaultdict(set) for _ in range(len(alone) + 1)]
        states[0][(0,) * len(slot)].add((0.0, 0.0))
        for pos, extra in enumerate(alone):
            fits = [(size, slot[w], sim, self.weight(w) ** 2) for size, w, sim in at.get(pos, ()) if w in slot and pos + size <= len(alone)]
            for taken, values in states[pos].items():
                values = _front(values)
                # a word that fits just one of the bag, and that as it stands, is best used so, unless two words written as one want the same
                sure = extra == self.most and len(fits) == 1 and fits[0][1] not in paired and fits[0][0] == 1 and fits[0][2] == 1 and taken[fits[0][1]] < copies[fits[0][1]]
                for common, own in values if not sure else ():
                    states[pos + 1][taken].add((common, own + extra * extra))
                for size, i, sim, w2 in fits:
                    if taken[i] < copies[i]:
                        after = (*taken[:i], taken[i] + 1, *taken[i + 1 :])
                        for common, own in values:
                            states[pos + size][after].add((common + w2 * sim, own + w2))
            states[pos] = {}
        return max((common / (norm * math.sqrt(own)) for values in states[-1].values() for common, own in values if own), default=0.0)


def _front(values: set[tuple[float, float]]) -> list[tuple[float, float]]:
    """Of (common, norm) those that no other beats in both."""
    out, least = [], math.inf
    for common, own in sorted(values, key=lambda v: (-v[0], v[1])):
        if own < least:
            out.append((common, own))
            least = own
    return out


def _repairing(forms: dict[str, str], uses: dict[str, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = defaultdict(list)
        for form in forms:
            for d in deletions(form, allowed(len(form))):
                index[d].append(form)
        known = set(forms.values())
        longest = max(map(len, forms), default=0) + 2
        starts = defaultdict(list)
        for w in known:
            for i in range(2, len(w)):
                starts[w[:i]].append(w)
        for b in batches:
            cols: tuple[list, list, list] = ([], [], [])
            for token, n, n_forms in zip(*(b.column(c).to_pylist() for c in ("token", "n", "n_forms"))):
                stop, word = token.endswith("\x01"), unicodedata.normalize("NFKC", token.rstrip("\x01"))
                one = singular(word)
                found: dict[str, float] = {}
                if one in known:
                    found[one] = 1.0
                elif word in known:
                    found[word] = 1.0
                else:
                    if word in SHORT and SHORT[word] in known:
                        found[SHORT[word]] = SHORTENED
                    if stop:
                        for w in starts.get(word, ()):
                            found[w] = max(found.get(w, 0), SHORTENED)
                    # a word longer than any form and its edits is near none
                    near = {w for f in {word, one} if len(f) <= longest for d in deletions(f, 2) for w in index.get(d, ())}
                    for form in near:
                        w, most = forms[form], allowed(len(form))
                        e = min(edits(word, form, most), edits(one, form, most))
                        rows, written = uses.get(w, (0, 0))
                        if e <= most and not (too_often(n, rows) and too_often(n_forms, written)):
                            found[w] = max(found.get(w, 0), 1 - LOSS * e / max(len(form), len(one)))
                for w, s in found.items():
                    for col, v in zip(cols, (token, w, s)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["token", "word", "sim"])

    return run


def _ranking(entries: Entries, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, names, scores = [], [], []
            for term, w, m in zip(b.column("term").to_pylist(), b.column("w").to_pylist(), b.column("m").to_pylist()):
                tokens = [singular(x.rstrip("\x01")) for x in w]
                if (hit := entries.best(tokens, [(x["pos"], x["size"], x["word"], x["sim"]) for x in m], least)) is not None:
                    terms.append(term), names.append(hit[0]), scores.append(hit[1])
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["term", "preferred_term", "score"])

    return run


def _listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [[w for bag in bags_of([(f, f)]) for w in set(bag)] for f in b.column("f").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))], ["words"])


def map_terms(df: DataFrame, id_col: str, typed: str, listed: DataFrame, form: str, preferred: str, least: float = LEAST) -> DataFrame:
    """One row (id_col, typed, preferred_term, score) for each row of df; '(unmatched)' and null where no entry fits."""
    entries = listed.where(F.col(preferred).isNotNull()).select(F.col(form).alias("f"), F.col(preferred).alias("t"))
    forms = entries.where("f is not null").union(entries.select(F.col("t").alias("f"), "t")).distinct()
    n_forms = forms.count()
    blocks = max(1, -(-n_forms // BLOCK))
    # weights over the whole list: in how many forms a word stands
    in_forms = forms.select("f").mapInArrow(_listing, "words array<string>").select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    most = 1 + math.log(max(n_forms, 1))

    rows = df.select(F.col(id_col).alias("_id"), F.col(typed).alias("_typed"), F.lower(F.col(typed)).alias("term"))
    terms = rows.where("term is not null").groupBy("term").agg(F.count("*").alias("n_rows")).withColumn("w", plain_words(F.col("term")))
    # with more unknown words than this the norms alone keep any score below the least
    longest = forms.select(F.max(F.size(F.split("f", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    extra = longest * most**2 * (1 / least**2 - 1)
    room, links = int(2 * longest + extra) + 1, int(extra / LINK**2) + 1
    terms = terms.where((F.size("w") > 0) & (F.size(F.filter("w", lambda x: ~x.isin(*LINKS))) <= room) & (F.size("w") <= room + links))
    single = F.transform("w", lambda x, i: F.struct(i.alias("pos"), F.lit(1).alias("size"), x.alias("token")))
    double = F.transform(
        F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))),
        lambda x, i: F.struct(i.alias("pos"), F.lit(2).alias("size"), F.concat(F.rtrim(x, F.lit("\u0001")), F.get("w", i + 1)).alias("token")),
    )
    spots = terms.select("term", "n_rows", "w", F.explode(F.concat(single, double)).alias("x")).select("term", "n_rows", "w", "x.*")
    tokens = spots.groupBy("token").agg(F.sum("n_rows").alias("n"), F.countDistinct("term").alias("n_forms"))
    # how often the words of the list themselves are typed, to tell errors from words
    stripped = F.rtrim(F.col("token"), F.lit("\u0001"))
    plain = F.explode(F.array_distinct(F.array(stripped, F.regexp_replace(stripped, "ies$", "y"), F.regexp_replace(stripped, "s$", ""))))
    used = tokens.select(plain.alias("word"), "n", "n_forms").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_forms").alias("n_forms"))
    known = checkpoint(in_forms.join(used, "word", "left"))
    best = None
    for k in range(blocks):
        own = forms if blocks == 1 else forms.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k)
        pairs = sorted((r.f, r.t) for r in own.collect())
        wanted = {w for bag in bags_of(pairs) for w in bag}
        words = known.collect() if blocks == 1 else known.join(df.sparkSession.createDataFrame([(w,) for w in sorted(wanted)] or [("",)], "word string"), "word").collect()
        part = Entries(pairs, {r.word: 1 + math.log(n_forms / r.df) for r in words}, most)
        repaired = tokens.mapInArrow(_repairing(part.forms, {r.word: (r.n or 0, r.n_forms or 0) for r in words}), "token string, word string, sim double")
        bags = spots.join(repaired, "token").groupBy("term", "w").agg(F.collect_list(F.struct("pos", "size", "word", "sim")).alias("m"))
        ranked = bags.mapInArrow(_ranking(part, least), "term string, preferred_term string, score double")
        best = ranked if best is None else best.unionByName(ranked)
    if blocks > 1:
        best = best.groupBy("term").agg(F.min(F.struct((-F.col("score")).alias("s"), "preferred_term")).alias("x")).select("term", "x.preferred_term", (-F.col("x.s")).alias("score"))
    out = rows.join(best, "term", "left")
    return out.select(F.col("_id").alias(id_col), F.col("_typed").alias(typed), F.coalesce("preferred_term", F.lit(UNMATCHED)).alias("preferred_term"), "score")
