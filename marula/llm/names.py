"""Problem 3: variant spellings of the names of organisations.

Method: a typed affiliation is cut to words, which are read through a table of
nicknames (kinds of organisation and common field words in their full, short and
French forms), abbreviations and typing errors in such words being mended by
Jaro-Winkler. What remains is the proper name, the kind, the fields and the place,
whatever their order. Distinct names are blocked by the phonetic code of their sorted
proper words (each code also with a sign or two left out, so that a wrong consonant
doesn't part them), names of one block are compared by Jaro-Winkler, and accepted
pairs are clustered by connected components. Kind, fields and country must agree, and
the town must not speak against it where both names mostly have one.

A near name is a misspelling of another one unless it's seen too often for that, in
more different readings (words and town, without departments, addresses, case, marks
and disguises) than a test of counts against a share of the other's allows. As the test is of
shares it says the same at every size, and copies of a record don't count.

A name with some of another's fields ("X Tropical Centre" beside "X Centre for Tropical
Agriculture") is short for it if no third name could be meant. Initials alone are joined to the most frequent name
of the country that states them in brackets or has them.

Counts are of distinct readings, found by pre-aggregated sums; pairs are made between
distinct names only and only within narrow blocks. Nothing but the fixed tables is
sent to tasks.

Defined results: null and empty strings, and those that name no organisation (a
place, a box number, a role), belong to no group. Repeated strings come out each.
Names of more than 40 consonants meet in a block if either end agrees; of names over 1,000
letters only equal ones are linked.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marula.llm.canonical_terms import deletions, edits, too_often
from marula.llm.components import connected_components
from marula.llm.lookalikes import consistent
from marula.operators import segmentation as S
from marula.plans.dims import country_rows
from marula.session import checkpoint, written

#: Nicknames: the written forms of kinds of organisation. Fixed values.
KINDS = {
    "university": "univ", "universite": "univ", "universidade": "univ", "univ": "univ", "u": "univ", "uni": "univ", "varsity": "univ",
    "institute": "inst", "institut": "inst", "instituto": "inst", "institution": "inst", "inst": "inst",
    "centre": "centre", "center": "centre", "centro": "centre", "ctr": "centre", "cent": "centre", "cntr": "centre",
    "polytechnic": "poly", "polytechnique": "poly", "polytech": "poly", "poly": "poly",
    "hospital": "hosp", "hopital": "hosp", "hosp": "hosp", "hop": "hosp", "chu": "hosp",
    "ecole": "school", "escola": "school", "higher": "school",
    "college": "college", "academy": "academy", "academie": "academy", "laboratories": "labs",
    "ministry": "ministry", "ministere": "ministry", "ministerio": "ministry",
    "council": "council", "conseil": "council", "conselho": "council",
    "bank": "bank", "banque": "bank", "banco": "bank",
    "bureau": "bureau", "office": "bureau",
    "agency": "agency", "agence": "agency", "agencia": "agency",
    "authority": "authority", "autorite": "authority", "commission": "commission", "comissao": "commission",
    "foundation": "foundation", "fondation": "foundation", "fundacao": "foundation",
    "association": "association", "associacao": "association", "society": "society", "societe": "society",
    "organisation": "organisation", "organization": "organisation", "company": "company", "compagnie": "company", "corporation": "company",
    "observatory": "observatory", "observatoire": "observatory", "museum": "museum", "musee": "museum", "museu": "museum",
}
#: Words of fields and reach in their English form. Fixed values.
FIELDS = {
    "public": "public", "publique": "public", "health": "health", "sante": "health", "saude": "health",
    "statistics": "statistics", "statistique": "statistics", "statistiques": "statistics", "planning": "planning", "planification": "planning",
    "mining": "mining", "metallurgy": "metallurgy", "metallurgie": "mining metallurgy",
    "education": "education", "pedagogie": "education", "energy": "energy", "energetique": "energy", "energie": "energy",
    "technology": "technology", "technologie": "technology", "social": "social", "sociales": "social", "policy": "policy",
    "tropical": "tropical", "tropicale": "tropical", "agriculture": "agriculture", "agricultural": "agriculture", "agronomie": "agriculture",
    "veterinary": "veterinary", "veterinaire": "veterinary", "medicine": "medicine", "medecine": "medicine", "medical": "medicine",
    "water": "water", "resources": "resources", "hydraulique": "water resources",
    "marine": "marine", "oceanographie": "marine", "oceanography": "marine", "land": "land", "survey": "survey", "geodesie": "land survey",
    "national": "national", "nationale": "national", "international": "international", "regional": "regional", "federal": "federal",
    "scientific": "scientific", "industrial": "industrial", "environment": "environment", "environmental": "environment", "development": "development",
    "economics": "economics", "economic": "economics", "economie": "economics",
}
#: Words that say nothing about which organisation it is. Fixed values.
IDLE = {"of", "for", "de", "des", "du", "la", "le", "l", "d", "en", "et", "and", "the", "research", "recherche", "rech", "rsch", "res",
        "studies", "etudes", "science", "sciences", "superieure", "school", "teaching", "teach", "universitaire"}
#: First words of parts that name a department, an address or a person's role. Fixed values.
DEPARTMENTS = {"department", "dept", "departement", "faculty", "faculte", "fac", "division", "div", "laboratory", "laboratoire", "lab", "graduate", "joint", "section", "unit"}
ADDRESSES = {"po", "p", "bp", "box", "private", "bag", "b"}
LINKS = {"of", "for", "de", "des", "du", "la", "le", "l", "d", "en", "et", "and", "the"}
#: Initials that stand for one word more often than for a name have fewer letters than this.
INITIALS = 3
_letters = re.compile(r"[^\W\d_]+\.?")
_generic = {**{w: ("kind", k) for w, k in KINDS.items()}, **{w: ("field", f) for w, f in FIELDS.items()}, **{w: ("idle", "") for w in IDLE}, **{w: ("department", "") for w in DEPARTMENTS}}


def plain(text: str) -> str:
    """Text without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity of two words, from 0 to 1."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    taken = [False] * m
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    k = len(left)
    if not k:
        return 0.0
    right = [b[j] for j in range(m) if taken[j]]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    head = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        head += 1
    return jaro + head * 0.1 * (1 - jaro)


def phonetic(word: str) -> str:
    """Consonant classes of a word in order, vowels left out."""
    return "".join(_SOUNDS.get(c, "") for c in word)


#: Consonants that sound alike. Fixed values.
_SOUNDS = {c: k for k, cs in {"B": "bp", "F": "fvw", "K": "cgkqx", "S": "sz", "D": "dt", "L": "l", "M": "m", "N": "n", "R": "r", "J": "j", "H": "h"}.items() for c in cs}


def one_edit_of(word: str, known: Iterable[str]) -> str | None:
    """The one known form that is a single edit away from the word."""
    near = [k for k in known if abs(len(k) - len(word)) <= 1 and edits(word, k, 1) == 1]
    return near[0] if len(near) == 1 else None


class Name(NamedTuple):
    """What an affiliation says of an organisation; kind is "?" where there are only initials.

    short is the name without a proper word that was taken from a part of its own, which may
    be a town; reading is what was read, for counting.
    """

    country: str
    proper: str
    kind: str
    field: str
    initials: list[str]
    town: str | None
    short: bool
    reading: str


class NameReader:
    """Reads affiliations; keeps what it learned of words and parts, up to a bound."""

    def __init__(self, countries: Iterable[str] = ()):
        self.countries = {c.lower(): c.lower() for c in countries}
        self.listed = list(self.countries)
        self.words: dict[str, tuple[str, str] | None] = {}
        self.parts: dict[str, tuple] = {}
        self.near: dict[str, list[str]] = {}
        for w in _generic:
            if len(w) >= 5:
                for d in deletions(w, 1 + (len(w) > 5)):
                    self.near.setdefault(d, []).append(w)

    def word(self, token: str) -> tuple[str, str] | None:
        """What the nickname table says of a word: its class and code, also for abbreviations and near spellings."""
        if token not in self.words:
            if len(self.words) > 200_000:
                self.words.clear()
            self.words[token] = self._word(token)
        return self.words[token]

    def _word(self, token: str) -> tuple[str, str] | None:
        stop, w = token.endswith("."), token.rstrip(".")
        if w in _generic and not (stop and w in LINKS):
            return _generic[w]
        if stop and len(w) >= 2:
            # the shortest word that begins so, fields before kinds
            full = min((f for f in _generic if f.startswith(w) and f != w), key=lambda f: (_generic[f][0] != "field", len(f), f), default=None)
            if full:
                return _generic[full]
        if w in _generic:
            return _generic[w]
        if len(w) < 4 or len(w) > 20:
            return None
        near = {f for d in deletions(w, 1 + (len(w) > 4)) for f in self.near.get(d, ())}
        near = {f for f in near if edits(w, f, 1 + (len(f) > 5)) <= 1 + (len(f) > 5)}
        return _generic[max(near, key=lambda f: (jaro_winkler(w, f), f))] if near else None

    def part(self, part: str) -> tuple:
        """What one part between commas is: ("skip",), ("lone", word), or ("name", kind, fields, proper, initials)."""
        if part not in self.parts:
            if len(self.parts) > 200_000:
                self.parts.clear()
            self.parts[part] = self._part(part)
        return self.parts[part]

    def _part(self, part: str) -> tuple:
        words = _letters.findall(part if part.isupper() else re.sub(r"(?<=[a-z])(?=[A-Z])", " ", part))
        low = [w.lower() for w in words]
        if not words or (low[0].rstrip(".") in ADDRESSES and (len(low) > 1 or low[0] == "bp")):
            return ("skip",)
        codes = [self.word(w) for w in low]
        if codes[0] and (codes[0][0] == "department" or (codes[0] == ("idle", "") and low[0][:3] == "sch")):
            return ("skip",)
        kinds = [c[1] for c in codes if c and c[0] == "kind"]
        rest = [w.rstrip(".") for w, c in zip(words, codes) if c is None]
        if not kinds:
            return ("lone", words[0]) if len(rest) == len(words) == 1 else ("skip",)
        # a hospital of a university is a hospital, a higher school a school
        kind = next((k for k in ("hosp", "school", "centre", "inst") if k in kinds), kinds[0])
        fields = {f for c in codes if c and c[0] == "field" for f in c[1].split()}
        initials = []
        for short in re.findall(r"\(([^()]+)\)", part):
            if short.isupper() and len(short) >= INITIALS and " " not in short and not part.isupper() and len(rest) > (not fields):
                initials = [short.replace(".", "").lower()]
                rest = [w for w in rest if w != short]
        proper = [w.lower() for w in rest if len(w) > 1]
        whole = [(w, c) for w, c in zip(low, codes) if w.rstrip(".") not in LINKS and w.strip(".") not in initials]
        first = "".join(w[0] for w, _ in whole)
        if len(first) >= INITIALS:
            initials.append(first)
        # of one proper word also its consonants
        heads = "".join(w[0] for w, c in whole if c is not None)
        return ("name", kind, " ".join(sorted(fields)), proper, initials, heads)

    def country(self, last: str) -> str:
        """The last part in lower case, a listed country's name where it's one edit away from just that."""
        low = last.lower()
        if low not in self.countries:
            if len(self.countries) > 200_000:
                self.countries = {c: c for c in self.listed}
            self.countries[low] = (one_edit_of(low, self.listed) if 5 <= len(low) <= 60 else None) or low
        return self.countries[low]

    def __call__(self, text: str) -> Name | None:
        """The organisation that an affiliation names, or None."""
        if not text.isascii():
            text = plain(consistent(text)[0])
        parts = [p for p in map(str.strip, text.split(",")) if p]
        if not parts:
            return None
        country = self.country(parts.pop()) if len(parts) > 1 else ""
        name, lone, said = None, [], []
        for part in parts:
            if any(c.isdigit() for c in part):
                continue
            read = self.part(part)
            if read[0] == "name" and name is None:
                name = read
                said.append(" ".join(part.lower().split()))
            elif read[0] == "lone":
                lone.append(read[1])
                said.append(read[1].lower())
        reading = ",".join(said)
        if name is None:
            bare = [w for w in lone if w.isupper() and len(w) >= INITIALS]
            return Name(country, "", "?", "", [bare[0].lower()], None, False, reading) if bare and not text.isupper() else None
        _, kind, fields, proper, initials, heads = name
        short = not proper and bool(lone)
        if short:
            # "Institute of X, Name, City": the name stands in a part of its own
            proper = [lone.pop(0).lower()]
        if not proper and not fields:
            return None
        consonants = heads + "".join(c for w in proper for c in w if c not in "aeiou")
        initials = [*initials, *([consonants] if len(consonants) > 4 else [])]
        return Name(country, " ".join(sorted(proper)), kind, fields, list(dict.fromkeys(initials)), lone[-1].lower() if lone else None, short and bool(fields), reading)


def sound_keys(proper: str) -> set[str]:
    """Phonetic codes of the sorted words of a proper name, whole and with one or two signs left out as far as enough remain."""
    code = " ".join(phonetic(w) for w in proper.split())
    if not code.strip():
        return {proper}
    if len(code) > 40:
        return {f"^{k}" for k in deletions(code[:20], 1)} | {f"${k}" for k in deletions(code[-20:], 1)}
    return deletions(code, 2 if len(code) > 4 else 1 if len(code) > 2 else 0)


def near_names(a: str, n_a: int, town_a: str | None, b: str, n_b: int, town_b: str | None) -> float | None:
    """The Jaro-Winkler similarity if proper name a, read in n_a ways, is a misspelling of b, read in n_b; else None."""
    if max(len(a), len(b)) > 1000:
        return 1.0 if a == b else None
    near = jaro_winkler(a, b)
    if near < NEAR or too_often(n_a, n_b):
        return None
    if town_a and town_b and town_a != town_b and jaro_winkler(town_a, town_b) < NEAR:
        return None
    return near


#: Names and towns of this similarity may be misspellings of one another.
NEAR = 0.85


def _reading(listed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = NameReader(listed)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.string()]
        for b in batches:
            rows = []
            for i, items in zip(b.column("record_id").to_pylist(), b.column("items").to_pylist()):
                rows += [(i, *name) for text in dict.fromkeys(items) if (name := read(text))]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["record_id", *Name._fields])

    return run


_MENTION = "record_id bigint, country string, proper string, kind string, field string, initials array<string>, town string, short boolean, reading string"


def _comparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [near_names(*x) for x in zip(*(b.column(c).to_pylist() for c in ("a", "n_a", "town_a", "b", "n_b", "town_b")))]
        keep, near = b.select(["left", "right", "n_b"]), pa.array(found, pa.float64())
        yield pa.RecordBatch.from_arrays([*keep.columns, near], ["left", "right", "n_b", "near"]).filter(near.is_valid())


def _keying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = pa.array([sorted(sound_keys(p)) for p in b.column("proper").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*b.columns, keys], [*b.schema.names, "keys"])


def _key(proper: Column) -> Column:
    return F.concat_ws("|", "country", F.when(F.col("kind") == "?", F.get("initials", F.lit(0))).otherwise(proper), "kind", "field")


def mentions(df: DataFrame, id_col: str, column: str, origin: str, packed: bool) -> DataFrame:
    """Rows (origin, record_id, name, ...), one for each organisation that a record names, with what was read."""
    rows = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(column).alias("cell")).where("record_id is not null and cell is not null")
    if packed:
        cells = rows.select("record_id", F.lit("affiliations").alias("field_name"), "cell")
        rows = S.split_cells(cells, {"affiliations": S.AFFILIATIONS}).select("record_id", "items")
    else:
        rows = rows.select("record_id", F.array(F.regexp_replace("cell", '^[\\s"]+|[\\s"]+$', "")).alias("items"))
    read = rows.mapInArrow(_reading([r[2] for r in country_rows()]), _MENTION)
    return read.select(F.lit(origin).alias("origin"), "record_id", _key(F.col("proper")).alias("name"), *_MENTION_ONLY, F.xxhash64("reading").alias("reading"))


_MENTION_ONLY = ("country", "proper", "kind", "field", "initials", "town", "short")


def whole_names(found: DataFrame) -> DataFrame:
    """Mentions in which a word in a part of its own is the proper name only where it's known as one.

    In "Ministry of Health, Accra, Ghana" no other name of that kind and country has the
    word, so it's a town and the name has no proper word.
    """
    own = found.where(~F.col("short") & (F.col("proper") != "")).select("country", "kind", "proper").distinct().withColumn("known", F.lit(True))
    lone = found.where("short").select("country", "kind", "proper").distinct().join(own, ["country", "kind", "proper"], "left")
    lone = lone.select("country", "kind", "proper", F.lit(True).alias("short"), F.col("known").isNull().alias("town_only"))
    out = found.join(lone, ["country", "kind", "proper", "short"], "left")
    drop = F.coalesce("town_only", F.lit(False))
    out = out.withColumns({"town": F.when(drop, F.coalesce("town", "proper")).otherwise(F.col("town")), "proper": F.when(drop, "").otherwise(F.col("proper"))})
    return out.withColumn("name", _key(F.col("proper"))).drop("town_only", "short")


def link_names(found: DataFrame) -> DataFrame:
    """One row (name, entity) for each distinct name of the mentions; entity is the smallest name of its cluster."""
    parts = ["name", "country", "proper", "kind", "field"]
    each = checkpoint(found.groupBy(*parts, "reading").agg(F.max("town").alias("town"), F.flatten(F.collect_set("initials")).alias("initials")))
    towns = each.where("town is not null").groupBy("name", "town").agg(F.count("*").alias("k")).groupBy("name").agg(F.max_by("town", F.struct("k", "town")).alias("town"))
    names = checkpoint(each.groupBy(*parts).agg(F.count("*").alias("n")).join(towns, "name", "left"))
    full = names.where("kind <> '?'")
    keyed = full.where("proper <> ''").mapInArrow(_keying, "name string, country string, proper string, kind string, field string, n bigint, town string, keys array<string>")
    keyed = keyed.select("name", "country", "kind", "field", "proper", "n", "town", F.explode("keys").alias("key"))
    other = keyed.select(F.col("name").alias("right"), "country", "kind", "field", F.col("proper").alias("b"), F.col("n").alias("n_b"), F.col("town").alias("town_b"), "key")
    near = keyed.withColumnsRenamed({"name": "left", "proper": "a", "n": "n_a", "town": "town_a"}).join(other, ["country", "kind", "field", "key"])
    near = near.where("n_a < n_b or (n_a = n_b and left > right)").select("left", "right", "a", "n_a", "town_a", "b", "n_b", "town_b").distinct()
    near = near.mapInArrow(_comparing, "left string, right string, n_b bigint, near double")
    # a misspelling goes to the one nearest name, so that it can't bridge two organisations
    best = near.groupBy("left").agg(F.max(F.struct("near", "n_b", "right")).alias("x"))
    edges = best.select("left", F.col("x.right").alias("right"))
    # a name with some of another's fields is short for it, if all that it may be short for lie in one another
    same = full.where("field <> ''").select("country", "kind", "proper", F.col("name").alias("right"), F.split("field", " ").alias("more"))
    some = same.withColumnsRenamed({"right": "left", "more": "fields"}).join(same, ["country", "kind", "proper"])
    some = some.where((F.size("fields") < F.size("more")) & (F.size(F.array_except("fields", "more")) == 0)).groupBy("left").agg(
        F.max(F.struct(F.size("more").alias("k"), "more", "right")).alias("x"), F.flatten(F.collect_set("more")).alias("every")
    )
    edges = edges.unionByName(some.where(F.size(F.array_except("every", "x.more")) == 0).select("left", F.col("x.right").alias("right")))
    # a short form "Name Field Inst" stands for a higher school where there is one
    school = full.where("kind = 'school'").select(F.col("name").alias("right"), "country", "proper", F.split("field", " ").alias("more"), F.col("n").alias("n_s"))
    inst = full.where("kind = 'inst' and field <> ''").select(F.col("name").alias("left"), "country", "proper", F.split("field", " ").alias("fields"), "n")
    inst = inst.join(school, ["country", "proper"]).where((F.col("n") <= F.col("n_s")) & (F.size(F.array_except("fields", "more")) == 0))
    edges = edges.unionByName(inst.select("left", "right"))
    # bare initials stand for the most frequent name that has them
    held = each.where("kind <> '?'").select("name", "country", F.explode("initials").alias("i")).groupBy("country", "i", "name").agg(F.count("*").alias("k"))
    owner = held.groupBy("country", "i").agg(F.max_by("name", F.struct("k", "name")).alias("right"))
    bare = each.where("kind = '?'").select(F.col("name").alias("left"), "country", F.get("initials", F.lit(0)).alias("i")).distinct()
    edges = edges.unionByName(bare.join(owner, ["country", "i"]).select("left", "right"))
    linked = connected_components(edges, "left", "right")
    out = names.select("name").join(linked.select(F.col("vertex").alias("name"), "seed"), "name", "left")
    return out.select("name", F.coalesce("seed", "name").alias("entity"))


def link_records(publications: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rows (origin, record_id, group_id) of all records whose organisation an override and one more record name.

    publications: row_id, affiliations. overrides: override_id, raw_string.
    """
    typed = mentions(overrides, "override_id", "raw_string", "override", packed=False)
    found = written(typed.unionByName(mentions(publications, "row_id", "affiliations", "publication", packed=True)))
    found = whole_names(found)
    entities = link_names(found)
    named = found.select("origin", "record_id", "name").join(entities, "name").select("origin", "record_id", "entity").distinct()
    named = checkpoint(named)
    groups = named.groupBy("entity").agg(F.min(F.when(F.col("origin") == "override", F.col("record_id"))).alias("group_id"), F.count("*").alias("n"))
    groups = groups.where("group_id is not null and n >= 2").select("entity", "group_id")
    return named.join(groups, "entity").select("origin", "record_id", "group_id").distinct()
