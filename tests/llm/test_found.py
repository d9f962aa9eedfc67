"""The problems' operators against brute force and small hand-made cases."""

import random
import time
import unicodedata
from itertools import combinations

import pytest

from marula.llm import canonical_terms, components, cooccurrence, format_copies, leaks, lookalikes, mixing, names, queries, reading_level
from marula.operators import segmentation as S


# problem 1


def key(t):
    t = unicodedata.normalize("NFC", t.lower())
    t = "".join(" " if unicodedata.category(c) == "Pd" or c in "'’‘" or c.isspace() else c for c in t)
    return tuple(sorted("".join(c for c in w if unicodedata.category(c)[0] in "LNM") for w in t.split()))


def test_copies_with_separate_accents_are_sorted_as_composed(spark):
    rows = [(1, "Zebra \u00e9tude field"), (2, "zebra e\u0301tude field"), (3, "field: e\u0301tude ZEBRA"), (4, "zebra etude field")]
    df = spark.createDataFrame(rows, "row_id bigint, title string")
    assert [tuple(r) for r in format_copies.collapse_copies(df, "row_id", ["title"]).collect()] == [(1, 3)]


def test_copies_against_brute_force(spark):
    rng = random.Random(1)
    words = ["Été", "water", "co-op", "L'eau", "x2", "soil", "Été", "a—b"]
    rows = []
    for i in range(400):
        w = rng.choices(words, k=rng.randint(1, 3))
        rng.shuffle(w)
        rows.append((i, rng.choice([" ", "  ", ": ", ". ", "\t", " "]).join(rng.choice([x, x.upper()]) for x in w) + rng.choice(["", ".", " !", "…"])))
    rows += [(1000 + i, "One hot title") for i in range(300)] + [(5000, None), (5001, ""), (5002, " -. "), (None, "One hot title"), (5003, "x" * 100_000), (5004, "X" * 100_000)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "row_id bigint, title string, _key string, first_row_id int")
    got = {tuple(r) for r in format_copies.collapse_copies(df, "row_id", ["title"]).collect()}
    sets = {}
    for i, t in rows:
        if i is not None and t and any(k := key(t)) and k != ("",):
            sets.setdefault(tuple(x for x in k if x), []).append(i)
    assert got == {(min(v), len(v)) for v in sets.values() if len(v) > 1}
    assert format_copies.collapse_copies(df.limit(0), "row_id", ["title"]).count() == 0


def test_copies_over_several_fields(spark):
    df = spark.createDataFrame([(1, "a b", "c"), (2, "C", "B, A"), (3, None, "a"), (4, "A", None)], "id bigint, x string, y string")
    assert {tuple(r) for r in format_copies.collapse_copies(df, "id", ["x", "y"]).collect()} == {(1, 2), (3, 2)}


# problem 2


@pytest.mark.parametrize("shape", ["path", "star", "random", "tree", "reversed path", "clique"])
def test_components(spark, shape):
    rng = random.Random(7)
    ids = rng.sample(range(10_000), 200)
    pairs = {
        "path": list(zip(ids, ids[1:])), "star": [(ids[0], x) for x in ids[1:]], "random": [(rng.choice(ids), rng.choice(ids)) for _ in range(150)],
        "tree": [(ids[i], ids[(i - 1) // 2]) for i in range(1, 200)], "reversed path": [(b, a) for a, b in zip(sorted(ids), sorted(ids)[1:])], "clique": list(combinations(ids[:40], 2)),
    }[shape]
    pairs = pairs + pairs[:5] + [(b, a) for a, b in pairs[:5]] + [(20_000, 20_000), (None, 3), (4, None), (30_001, 30_000)]
    df = spark.createDataFrame([(a, b, 0) for a, b in pairs], "l bigint, r bigint, u int")
    got = {x.vertex: x.seed for x in components.connected_components(df, "l", "r").collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up}


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "l bigint, r bigint"), "l", "r").count() == 0


# problem 3


def test_name_reader():
    read = names.NameReader()
    same = ["Univ. of Talnusi, BP 12, Goral, Kenya", "Department of Law, University of Talnusi, Kenya", "UNIVERSITY OF TALNUSI, Goral, Kenya", "Univresity (Talnusi), Goral, Kenya", "University, Talnusi, Goral, Kenya", "UniTalnusi, Kenya", "University of Tаlnusi, 00123, Kenya"]
    assert {read(x)[:4] for x in same} == {("kenya", "talnusi", "univ", "")}
    field = ["Bosreme Centre for Tropical Agriculture Research, Togo", "Centre Bosreme de Recherche en Agronomie Tropicale, Togo", "Bosreme Cent. for Trop. Agric. Rsch, Togo"]
    assert {read(x)[:4] for x in field} == {("togo", "bosreme", "centre", "agriculture tropical")}
    assert read("Bosreme Tropical Ctr, P.O. Box 17, Togo")[:4] == ("togo", "bosreme", "centre", "tropical")
    for x in ["Goral, Kenya", "P.O. Box 12, Goral, Kenya", "Independent researcher, Kenya", "", "Kenya", ",,"]:
        assert read(x) is None
    assert read("THSRRGHN, Goral, Kenya")[:5] == ("kenya", "", "?", "", ["thsrrghn"])
    assert "thsrrghn" in read("Serroguhani Teaching Hospital, Kenya").initials
    assert read("World Bank, Nairobi, Kenya")[:4] == ("kenya", "world", "bank", "")
    assert read("Ministry of Health, Ghana")[:4] == ("ghana", "", "ministry", "health")
    assert read("Council for Scientific and Industrial Research (CSIR), Pretoria, South Africa")[2:5][:2] == ("council", "industrial scientific")
    assert read("National Bureau of Statistics, Abuja, Nigeria")[2:4] == ("bureau", "national statistics")
    assert read("Institute of Oceanography, Kenya")[:4] == ("kenya", "", "inst", "marine")


def test_a_country_one_edit_away_is_the_listed_one():
    read = names.NameReader(["Kenya", "Niger", "Nigeria", "Mali", "Malawi"])
    assert [read.country(x) for x in ("Kenia", "Keyna", "NIGER", "Niger", "Nigerai", "Narnia", "Mal")] == ["kenya", "kenya", "niger", "niger", "nigeria", "narnia", "mal"]


def test_jaro_winkler():
    # published examples
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert names.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert names.jaro_winkler("", "a") == 0 and names.jaro_winkler("a", "a") == 1


def test_organisations_of_any_kind_link(spark):
    o = ["World Bank, Nairobi, Kenya", "Ministry of Health, Accra, Ghana", "Council for Scientific and Industrial Research (CSIR), Pretoria, South Africa", "National Bureau of Statistics, Abuja, Nigeria", "Institute of Oceanography, Kenya", "University of Cape Town (UCT), Cape Town, South Africa"]
    p = [("Wold Bank, Kenya", 0), ("Ministry of Health, Ghana", 1), ("Ministère de la Santé, Accra, Ghana", 1), ("CSIR, Pretoria, South Africa", 2), ("Nat. Bureau of Statistics, Nigeria", 3), ("Institute of Oceanografy, Kenia", 4), ("UCT, South Africa", 5), ("Ministry of Health, Accra, Togo", None), ("Ministry of Energy, Accra, Ghana", None)]
    po = spark.createDataFrame([(100 + i, x) for i, (x, _) in enumerate(p)], "row_id bigint, affiliations string")
    oo = spark.createDataFrame(list(enumerate(o)), "override_id bigint, raw_string string")
    got = {(r.record_id, r.group_id) for r in names.link_records(po, oo).collect() if r.origin == "publication"}
    assert got == {(100 + i, g) for i, (_, g) in enumerate(p) if g is not None}


def test_long_names_do_not_explode():
    assert len(names.sound_keys("bdg" * 30_000)) < 100 and names.sound_keys("aeiou") == {"aeiou"}
    assert names.near_names("b" * 2000, 1, None, "b" * 2001, 9, None) is None


def test_sound_keys_meet_after_one_error():
    rng = random.Random(2)
    for _ in range(300):
        w = "".join(rng.choice("bdgklmnrst") + rng.choice("aeiou") for _ in range(5))
        i = rng.randrange(len(w))
        typo = rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + rng.choice("abcdefgz") + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :]])
        assert names.sound_keys(w) & names.sound_keys(typo)


def test_link_records(spark):
    o = [(1, "University of Talnusi, Goral, Kenya"), (2, "Talnusi Teaching Hospital, Goral, Kenya"), (3, "Goral, Kenya"), (4, None), (5, "Bemdo Institute of Social Policy, Egypt"), (6, "UTLNS, Goral, Kenya"), (7, "Univ of Talnusi, Kenya"), (8, "")]
    p = [(10, "Dept of Law, University of Talnusi, Kenya; Polytechnic of Rosaki, Togo"), (11, "Univ. of Talnsui, Kenya"), (12, None), (13, "Polytechnic of Rosaki, Togo"), (14, '"University of Talnusi, 00120, Kenya"'), (15, "University of Talnusi, Box 4, Kenya"), (16, "Talnusi Teaching Hosp., Kenya | University of Talnusi, Kenya"), (16, "University of Talnusi, Kenya")]
    po = spark.createDataFrame([(*x, "x") for x in p], "row_id bigint, affiliations string, name string")
    oo = spark.createDataFrame([(*x, "x") for x in o], "override_id bigint, raw_string string, proper string")
    got = {tuple(r) for r in names.link_records(po, oo).collect()}
    assert got == {("override", 1, 1), ("override", 6, 1), ("override", 7, 1), ("override", 2, 2), ("publication", 10, 1), ("publication", 11, 1), ("publication", 14, 1), ("publication", 15, 1), ("publication", 16, 1), ("publication", 16, 2)}
    assert names.link_records(po, oo.limit(0)).count() == 0 == names.link_records(po.limit(0), oo.limit(0)).count()


def test_a_misspelling_joins_one_name_only():
    near = lambda a, n, b, m, x=None, y=None: names.near_names(a, n, x, b, m, y)
    assert near("mnogeshu", 1, "menogeshu", 80) and near("mnogeshu", 1, "monogeshu", 80)
    assert near("menogeshu", 80, "monogeshu", 83) is None and near("menogeshu", 8000, "monogeshu", 8300) is None
    assert near("mnogeshu", 1, "menogeshu", 80, "goral", "goral") and near("mnogeshu", 1, "menogeshu", 80, "goral", "tulerar") is None
    assert near("abcdefgh", 1, "hgfedcba", 50) is None


# problem 4


def test_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "ITEMS", 4)
    monkeypatch.setattr(cooccurrence, "RECORDS", 16)
    monkeypatch.setattr(cooccurrence, "STEP", 7)
    monkeypatch.setattr(cooccurrence, "HELD", 20)
    rng = random.Random(3)
    rows = []
    for f in ("f", "g"):
        for _ in range(300):
            row = [f"i{min(int(rng.expovariate(0.2)), 20):02d}" for _ in range(rng.randint(0, 5))]
            rows.append((f, row + (["pair", "twin"] if rng.random() < 0.1 else [])))
    rows += [("f", None), ("h", [])]
    df = spark.createDataFrame([(f, x, 1) for f, x in rows], "field_name string, items array<string>, n int")
    got = {tuple(r)[:7] for r in cooccurrence.frequent_pairs(df, 8, 0.002, 1.5).collect()}
    want = set()
    for f in ("f", "g"):
        sets = [set(x) for g, x in rows if g == f and x]
        n = len(sets)
        items = sorted(set().union(*sets))
        for a, b in combinations(items, 2):
            na, nb, nab = (sum(s <= x for x in sets) for s in ({a}, {b}, {a, b}))
            if nab >= 8 and nab >= 0.002 * n and nab * n >= 1.5 * na * nb:
                want.add((f, a, b, na, nb, nab, n))
    assert got == want and any(x[1:3] == ("pair", "twin") for x in got)
    assert cooccurrence.frequent_pairs(df.limit(0), 8, 0.002, 4).count() == 0
    monkeypatch.setattr(cooccurrence, "LISTED", 3)
    with pytest.raises(ValueError):
        cooccurrence.frequent_pairs(df, 1, 0, 1)


def test_p4_against_brute_force(spark, data):
    pubs = spark.read.parquet(f"{data}/raw_publications.parquet").select("author_keywords", "affiliations").collect()
    want = set()
    for f, p in (("author_keywords", S.KEYWORDS), ("affiliations", S.AFFILIATIONS)):
        split = S.splitter(p)
        sets = [s for r in pubs if r[f] and (s := {(x if f == "author_keywords" else x.split(",")[-1].strip(" ")).lower() for x in split(r[f])} - {""})]
        n, count = len(sets), {}
        for s in sets:
            for x in s:
                count[x] = count.get(x, 0) + 1
        for a, b in combinations(sorted(x for x, c in count.items() if c >= 8), 2):
            nab = sum(a in s and b in s for s in sets)
            if nab >= 8 and nab >= 0.002 * n and nab * n >= 4 * count[a] * count[b]:
                want.add((f, a, b))
    assert {tuple(r) for r in queries.p4_found(spark, data).collect()} == want


# problem 5


@pytest.mark.parametrize(
    "text, plain, kinds",
    [
        ("Ｆｕｌｌ width", "Full width", ["full_width"]),
        ("eﬃcient ﬁsh", "efficient fish", ["joined_letters"]),
        ("café", "café", ["separate_accent"]),
        ("zero​width \xadsoft", "zerowidth soft", ["invisible"]),
        ("no break　wide", "no break wide", ["space"]),
        ("bоrehole Εffects", "borehole Effects", ["other_script"]),
        ("trial: а ten-year study", "trial: a ten-year study", ["other_script"]),
        ("[полевое исследование с людьми]", None, []),
        ("с людьми", None, []),
        ("[полевое исследование]: а panel", "[полевое исследование]: a panel", ["other_script"]),
        ("β-carotene, α = 5 %, TNFα, CO₂, km², °C, “x” – ’ …", None, []),
        ("Été à l’École", None, []),
        ("دراسة ميدانية የመስክ ጥናት 中文", None, []),
        ("tab\tline\nbreak", None, []),
        ("", None, []),
        ("мoсква", "москва", ["latin_in_other"]),
        ("щyка", "щука", ["latin_in_other"]),
        ("Ꭺ𝐁 Ⅳ ɡrowth", "AB IV growth", ["other_script", "styled_letter"]),
        ("[ɡɑ] and Ⓦater ①", "[ɡɑ] and Water ①", ["styled_letter"]),
        ("ꓡand ⲟf Տea", "Land of Sea", ["other_script"]),
        ("ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", None, []),
        ("ｂоth ‍kinds", "both kinds", ["full_width", "invisible", "other_script"]),
    ],
)
def test_consistent(text, plain, kinds):
    assert lookalikes.consistent(text) == (text if plain is None else plain, kinds)


def test_whatever_is_suspicious_is_unusual():
    regex = pytest.importorskip("regex")
    unusual = regex.compile(regex.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), lookalikes.UNUSUAL))
    for c in map(chr, range(0x110000)):
        if not 0xD800 <= ord(c) < 0xE000 and lookalikes.consistent("a" + c + "a")[1]:
            assert unusual.match(c), hex(ord(c))


def test_disguised_values(spark):
    rows = [(1, "bоre", None), (2, None, "plain"), (3, "ok", "a​" * 50_000), (4, "", ""), (1, "bоre", None), (None, "bоre", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "row_id bigint, title string, affiliations string, cell string").withColumnRenamed("cell", "_id")
    got = sorted((r.row_id or 0, r.field_name, r.consistent_value[:4]) for r in lookalikes.disguised_values(df, "row_id", ["title", "affiliations"]).collect())
    assert got == [(0, "title", "bore"), (1, "title", "bore"), (1, "title", "bore"), (3, "affiliations", "aaaa")]
    assert lookalikes.disguised_values(df.limit(0), "row_id", ["title"]).count() == 0


# problem 7


LISTED = [("small loans", "microcredit"), ("GBV", "gender-based violence"), ("gender based violence", "gender-based violence"), ("x", "household credit access"), ("x", "invasive species"), ("peri urban mobility", "peri-urban mobility"), ("x", "maternal mortality"), ("x", "coastal water governance"), ("x", "wastewater reuse"), ("x", "solid waste management"), ("x", "food sovereignty"), ("x", "road safety")]


def test_map_terms(spark):
    typed = {
        "Small  loans ": "microcredit", "gbv": "gender-based violence", "gender–based violence": "gender-based violence", "violence (gender-based)": "gender-based violence", "credit access, household": "household credit access",
        "hh credit access": "household credit access", "invasive speceis": "invasive species", "periurban mobilities": "peri-urban mobility", "mobility, peri-urban": "peri-urban mobility", "coastal watr gov.": "coastal water governance",
        "waste water reuse": "wastewater reuse", "maternal morbidity": None, "food safety": None, "refugee credit access": None, "household access": None, "": None, "...": None, "credit access household road safety": None, "tea auction": None,
        "microcredits.": "microcredit", "raod safety": "road safety", "management of solid waste": "solid waste management", "the road safety": "road safety", "of": None, "road road safety": None,
    }
    rows = [(i, t, "clash") for i, t in enumerate(typed)] + [(900, None, "c"), (901, "road " * 50_000, "c"), (902, "gbv", "c")]
    df = spark.createDataFrame(rows, "entry_id bigint, typed_term string, term string")
    listed = spark.createDataFrame(LISTED + LISTED[:2] + [(None, None)], "source_term string, preferred_term string")
    got = {r.entry_id: r.preferred_term for r in canonical_terms.map_terms(df, "entry_id", "typed_term", listed, "source_term", "preferred_term").collect()}
    for i, (t, to) in enumerate(typed.items()):
        assert got[i] == (to or "(unmatched)"), t
    assert got[900] == got[901] == "(unmatched)" and got[902] == "gender-based violence" and len(got) == len(rows)
    none = canonical_terms.map_terms(df, "entry_id", "typed_term", listed.limit(0), "source_term", "preferred_term")
    assert {r.preferred_term for r in none.collect()} == {"(unmatched)"}
    assert canonical_terms.map_terms(df.limit(0), "entry_id", "typed_term", listed, "source_term", "preferred_term").count() == 0


def test_map_terms_in_blocks_equals_one_pass(spark, data, monkeypatch):
    one = {tuple(r) for r in queries.p7_found(spark, data).collect()}
    monkeypatch.setattr(canonical_terms, "BLOCK", 60)
    assert {tuple(r) for r in queries.p7_found(spark, data).collect()} == one


def test_score_against_all_assignments():
    rng = random.Random(12)
    words = "ab cd ef gh ij".split()
    for _ in range(300):
        bag = tuple(sorted(rng.choice(words) for _ in range(rng.randint(1, 4))))
        entries = canonical_terms.Entries([(" ".join(bag), "x")], {w: 1 + i / 3 for i, w in enumerate(words)}, 3.0)
        tokens = [rng.choice([*words, "zz", "of"]) for _ in range(rng.randint(1, 5))]
        matches = [(i, size, rng.choice(words), rng.choice([1.0, 0.95, 0.9])) for i in range(len(tokens)) for size in (1, 1, 2) if i + size <= len(tokens) and rng.random() < 0.6]
        best = 0.0

        def walk(pos, left, common, own):
            nonlocal best
            if pos == len(tokens):
                best = max(best, common / entries.norms[0] / own**0.5)
                return
            walk(pos + 1, left, common, own + (0.1 if tokens[pos] == "of" else 3.0) ** 2)
            for p, size, w, sim in matches:
                if p == pos and w in left:
                    rest = list(left)
                    rest.remove(w)
                    walk(pos + size, rest, common + entries.weight(w) ** 2 * sim, own + entries.weight(w) ** 2)

        walk(0, list(bag), 0.0, 0.0)
        hit = entries.best(tokens, matches, 0.3)
        assert (hit[1] if hit else None) == (pytest.approx(best) if best >= 0.3 else None)


def test_a_word_typed_too_often_is_no_error():
    assert not canonical_terms.too_often(3, 24) and not canonical_terms.too_often(4, 82) and not canonical_terms.too_often(1, 0)
    assert canonical_terms.too_often(40, 60) and not canonical_terms.too_often(20, 1000) and canonical_terms.too_often(60, 1000)
    assert not canonical_terms.too_often(20_000, 1_000_000) and canonical_terms.too_often(21_000, 1_000_000)


def test_edits_and_deletions():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        rows = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if not i or not j:
                    rows[i, j] = i + j
                    continue
                v = min(rows[i - 1, j] + 1, rows[i, j - 1] + 1, rows[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    v = min(v, rows[i - 2, j - 2] + 1)
                rows[i, j] = v
        want = rows[len(a), len(b)]
        assert canonical_terms.edits(a, b, 9) == want
        if want <= 2:
            assert canonical_terms.deletions(a, 2) & canonical_terms.deletions(b, 2)


# problem 8


def test_automaton_against_brute_force():
    rng = random.Random(11)
    for _ in range(60):
        texts = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 15))]) for i in range(5)]
        sam = leaks.SuffixAutomaton(texts, 4)
        doc = [rng.choice("abcd") for _ in range(40)]
        found = sam.matches([sam.number.get(w, -1) for w in doc])
        longest = {}
        for at in range(len(doc)):
            for n in range(1, at + 2):
                s = doc[at - n + 1 : at + 1]
                if any(s == t[k : k + n] for _, t in texts for k in range(len(t) - n + 1)):
                    longest[at] = n
        assert {a: n for a, n, _ in found} == {a: n for a, n in longest.items() if n >= 4}
        for at, _, top in found:
            s = doc[at - 3 : at + 1]
            assert sam.items[top] == {i for i, t in texts if any(s == t[k : k + 4] for k in range(len(t) - 3))}


def test_find_leaks(spark, monkeypatch):
    w = [f"word{i}" for i in range(60)]
    items = [(1, " ".join(w[:20])), (2, " ".join(w[10:30])), (3, " ".join(w[:20])), (4, None), (5, ""), (6, "too short")]
    rest = " ".join(f"other{i}" for i in range(40))
    docs = {
        1: f"{rest} {' '.join(w[:12])} end", 2: f"{rest} {' '.join(w[:11])} end", 3: f"{rest} {', '.join(w[8:24]).upper()}!", 4: None, 5: "", 6: " ".join(w[:6]) + "\n> wo-\nrd6 " + " ".join(w[7:13]) + " " + rest,
        7: " ".join(w[:20]), 8: (rest + " ") * 2000 + " ".join(w[12:26]), 9: f"{rest} {' '.join(w[:12])} end",
    }
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in docs.items()], "doc_id bigint, text string, _id string, item_id string")
    it = spark.createDataFrame([(i, p, "c") for i, p in items], "item_id bigint, passage string, doc_id string")
    want = {(1, 1), (1, 3), (3, 2), (3, 1), (3, 3), (6, 1), (6, 3), (7, 1), (7, 3), (8, 2), (9, 1), (9, 3)}
    found = leaks.find_leaks(df, "doc_id", "text", it, "item_id", "passage")
    rows = found.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    clean = {r.doc_id: r.clean_text for r in rows}
    assert clean[7] is None and clean[1] == f"{rest}  end" and next(r for r in rows if r.doc_id == 7).share == 1
    monkeypatch.setattr(leaks, "WORDS", 25)
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(df, "doc_id", "text", it, "item_id", "passage").collect()} == want
    assert leaks.find_leaks(df, "doc_id", "text", it.limit(0), "item_id", "passage").count() == 0


def test_all_leaks_are_cut_in_any_text_and_number_of_blocks(spark, monkeypatch):
    one, two = ([f"{c}{chr(97 + i)}word" for i in range(14)] for c in "xy")
    items = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "item_id bigint, passage string")
    rest = " ".join(f"free{chr(97 + i)}" for i in range(20))
    texts = [(1, f"\u0130zmir {rest} {' '.join(one)} end"), (2, f"{rest} {' '.join(one)} mid {' '.join(two)} {rest}"), (3, f"{' '.join(one)} mid {' '.join(two)}"), (4, rest)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = {(1, 1, f"\u0130zmir {rest}  end"), *((2, i, f"{rest}  mid  {rest}") for i in (1, 2)), (3, 1, None), (3, 2, None)}
    for size in (leaks.WORDS, 7, 5):
        monkeypatch.setattr(leaks, "WORDS", size)
        found = leaks.find_leaks(df, "doc_id", "text", items, "item_id", "passage").collect()
        assert {(r.doc_id, r.item_id, r.clean_text) for r in found} == want and len(found) == 5


# problem 9


def test_token_counts_equal_the_tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(queries.RANKS_FILE, "rb") as f:
        raw = f.read()
    enc = tiktoken.Encoding("t", pat_str=mixing.SPLIT, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})
    count = mixing.token_counter(raw)
    rng = random.Random(1)
    letters = "ab cD1٣²½\x1c \n\t_-'’éé中β'll 's\U00010107"
    for _ in range(500):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert count(t) == len(enc.encode_ordinary(t)), repr(t)


def test_route_is_cheapest():
    rng = random.Random(6)
    found = 0
    for _ in range(80):
        p = {("a",): rng.randint(1, 3), ("b",): rng.randint(1, 3), ("a", "b"): rng.randint(1, 3)}
        repeats = {"a": rng.randint(1, 3), "b": rng.randint(1, 2)}
        total = rng.randint(0, 12)
        _, flows = mixing.route(p, {"a": 0.5, "b": 0.5}, repeats, total)
        quota = total // 2

        def price(n, used):
            return sum((i // n) ** 2 for i in range(used))

        def cost(xa, xb):
            return price(p["a",], quota - xa) + price(p["b",], quota - xb) + price(p["a", "b"], xa + xb)

        fits = [cost(xa, xb) for xa in range(quota + 1) for xb in range(quota + 1) if max(xa - p["a", "b"] * repeats["a"], xb - p["a", "b"] * repeats["b"], quota - xa - p["a",] * repeats["a"], quota - xb - p["b",] * repeats["b"]) <= 0]
        if fits:
            found += 1
            assert [sum(n for (_, s), n in flows.items() if s == x) for x in "ab"] == [quota, quota]
            assert cost(flows.get((("a", "b"), "a"), 0), flows.get((("a", "b"), "b"), 0)) == min(fits)
    assert found > 40


def test_largest_total_against_search():
    rng = random.Random(3)
    for _ in range(200):
        capacity = {s: rng.randint(0, 60) for s in "abc"}
        shares = {s: rng.choice([0.1, 0.3, 0.25, 1 / 3]) for s in "abc"}
        fits = [n for n in range(2000) if all(int(n * t / sum(shares.values())) <= capacity[s] for s, t in shares.items())]
        assert mixing.largest_total(capacity, shares) == max(fits)


def test_many_patterns_are_routed_in_time():
    rng = random.Random(1)
    names = [f"s{i:02d}" for i in range(13)]
    patterns = {}
    while len(patterns) < mixing.PATTERNS:
        patterns[tuple(sorted(rng.sample(names, rng.randint(1, 13))))] = rng.randint(1, 10**6)
    began = time.perf_counter()
    total, flows = mixing.route(patterns, {s: rng.random() for s in names}, {s: rng.randint(1, 5) for s in names})
    assert total > 0 and flows and time.perf_counter() - began < 120


def test_mix_keeps_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 20)
    rng = random.Random(8)
    docs, texts = [], [" ".join(rng.choice(["river", "stone", "field", "the"]) for _ in range(rng.randint(3, 30))) + f" {i}" for i in range(400)]
    for i, t in enumerate(texts):
        for s in rng.sample(["big", "mid", "small"], k=rng.choices([1, 2], [9, 1])[0]) if i >= 40 else ["small"]:
            docs.append((len(docs), s if s != "small" or rng.random() < 0.3 else "big", t))
    docs += [(9000, None, "x"), (9001, "big", None), (9002, "big", ""), (9003, "unlisted", "y"), (9004, docs[0][1], docs[0][2])]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id bigint, source string, text string, key string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.2, 1), ("small", 0.2, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    selection, shares = mixing.select_mix(df, targets, queries.RANKS_FILE)
    rows = {r.source: r for r in shares.collect()}
    assert rows["absent"].n_docs == 0 and rows["absent"].reached_share == 0
    for s, t in (("big", 0.5), ("mid", 0.2), ("small", 0.2)):
        assert rows[s].reached_share == pytest.approx(t / 0.9, abs=0.03) and rows[s].n_repeats <= rows[s].max_repeats
    picked = selection.collect()
    assert len({(r.doc_id, r.source) for r in picked}) == len(picked)
    of = {d[0]: d for d in docs}
    assert all(of[r.doc_id][1] == r.source for r in picked)
    again = {tuple(r) for r in mixing.select_mix(df, targets, queries.RANKS_FILE)[0].collect()}
    assert again == {tuple(r) for r in picked}
    asked, total = mixing.select_mix(df, targets, queries.RANKS_FILE, total=500)
    assert sum(r.n_tokens for r in total.collect()) == pytest.approx(500, rel=0.2)
    none, empty = mixing.select_mix(df.limit(0), targets, queries.RANKS_FILE)
    assert none.count() == 0 and {r.n_docs for r in empty.collect()} == {0}


# problem 10


def graded(data, spark):
    return [(r.sample_text, r.reading_level) for r in spark.read.parquet(f"{data}/graded_samples.parquet").orderBy("sample_id").collect()]


def test_held_out_accuracy(spark, data):
    rows = graded(data, spark)
    random.Random(0).shuffle(rows)
    right = 0
    for k in range(5):
        model = reading_level.LevelModel([r for i, r in enumerate(rows) if i % 5 != k], queries.LEVELS)
        right += sum(model.score(t)[0] == v for t, v in rows[k::5])
    assert right >= 0.95 * len(rows)


def test_levels_of_odd_documents(spark, data):
    model = reading_level.LevelModel(graded(data, spark), queries.LEVELS)
    text, level = graded(data, spark)[0]
    df = spark.createDataFrame([(1, text, "c"), (2, None, "c"), (3, "", "c"), (4, "zzzq qqqz", "c"), (5, text * 200, "c"), (1, text, "c")], "doc_id bigint, text string, reading_level string")
    got = [(r.doc_id, r.reading_level) for r in reading_level.estimate(df, "doc_id", "text", model).orderBy("doc_id").collect()]
    assert got == [(1, level), (1, level), (2, None), (3, None), (4, None), (5, level)]
    empty = reading_level.fit(spark.createDataFrame([], "t string, v string"), "t", "v", queries.LEVELS)
    assert reading_level.estimate(df, "doc_id", "text", empty).where("reading_level is not null").count() == 0


# all queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    n = df.count()
    assert n == df.distinct().count() and (n > 0 or name in ("p4_found", "p4_pairs"))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    db = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, data)
    found = db.sql(queries.SQL[name])
    names = list(found.columns)
    columns = sorted(df.columns)
    assert sorted(names) == columns
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
