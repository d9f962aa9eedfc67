"""Problem 5: text that looks the same but differs in its characters.

Method: every letter of a token resolves to a set of scripts, its own and that of
the Latin letter it looks like. The intersection over the token says which scripts
the whole token could be written in. A token that mixes scripts but could be all
Latin is a mixed-script confusable; one wholly in another script that could be all
Latin is a whole-script confusable, unless a neighbouring token is truly in that
script. Both are spelled in Latin. A mixed token that can't be Latin but could be all
in another script is spelled in that one. Full-width forms, joined letters, separate
accents, invisible characters, odd blanks and styled letters (mathematical, circled,
numerals, phonetic letters among plain ones) are brought to their ordinary form.

Letters are compared for Latin against Cyrillic, Greek, Armenian, Cherokee, Coptic and
Lisu. Greek small letters in use as symbols (as in TNF-alpha) are left as they are.

A filter inside the JVM lets only values with a suspicious character reach Python.

Defined results: null and empty values are never affected; a value with several
kinds comes out once with all of them; equal values of several rows come out for each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marula.operators.segmentation import field_cells

#: Letters of other scripts and the Latin letters they can't be told from. Fixed values.
CYRILLIC = dict(zip("аеорсухѕіјһԁԛԝӏѵүАВЕКМНОРСТХУЅІЈԌԚԜѴҮ", "aeopcyxsijhdqwlvyABEKMHOPCTXYSIJGQWVY"))
GREEK = dict(zip("ονϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ovcjABEZHIKMNOPTYXC"))
ARMENIAN = dict(zip("օոսհցզՕՍՏ", "onuhgqOUS"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎥᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃᎩᏧᏏᏂ", "ABCDEGHiJKLMPRSTVWZydbh"))
COPTIC = dict(zip("ⲟⲣⲥⲞⲢⲤⲔⲘⲚⲎⲦⲬⲂ", "opcOPCKMNHTXB"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
TABLES = {"Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN, "Cherokee": CHEROKEE, "Coptic": COPTIC, "Lisu": LISU}
LOOKS = {c: lat for t in TABLES.values() for c, lat in t.items()}
#: Latin letters of other use (phonetic, small capitals) that look like plain ones. Fixed values.
PHONETIC = dict(zip("ɡɑᴄᴏᴠᴡᴢꜱ", "gacovwzs"))


def _styled() -> dict[str, str]:
    """Letters of mathematical, circled and numeral forms and the plain ones they stand for, by their decomposition."""
    out = {}
    for first, last in ((0x2100, 0x2188), (0x24B6, 0x24E9), (0x1D400, 0x1D7FF), (0x1F130, 0x1F189)):
        for c in map(chr, range(first, last + 1)):
            tag, to = unicodedata.decomposition(c).split(" ", 1)[0], unicodedata.normalize("NFKD", c)
            if to != c and to.isascii() and (to.isalpha() if tag != "<font>" else to.isalnum()) and tag not in ("<super>", "<sub>"):
                out[c] = to
    return out


STYLED = _styled()


def ranges(chars: Iterable[str]) -> str:
    """Characters as the ranges of a pattern's class."""
    out: list[list[int]] = []
    for n in sorted(map(ord, chars)):
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return "".join(chr(x) if x == y else f"{chr(x)}-{chr(y)}" for x, y in out)


WIDE = "！-｠￠-￦"
JOINED = "ﬀ-ﬆĲĳǄ-ǌǱ-ǳ"
#: Invisible though not of the format class, and of the format class though visible.
BLANK_MARKS = "͏ᅟᅠ឴឵᠋-᠎ㅤﾠ︀-️"
SEEN_MARKS = "؀-؅۝܏࢐࢑࣢"
SUSPICIOUS = (
    rf"[{WIDE}{JOINED}{BLANK_MARKS}\p{{Mn}}]|[\p{{Cf}}&&[^{SEEN_MARKS}]]|[\p{{Zs}}&&[^ ]]"
    r"|[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsCherokee}\p{IsCoptic}\p{IsLisu}]" + f"|[{ranges((*STYLED, *PHONETIC))}]"
)

#: One class of all characters but Latin letters up to U+024F and the signs among them; whatever is suspicious is in it.
UNUSUAL = r"[^\x00-\x9F\xA1-\xAC\xAE-\x{131}\x{134}-\x{1C3}\x{1CD}-\x{1F0}\x{1F4}-\x{24F}]"

_wide, _joined, _marks = re.compile(f"[{WIDE}]"), re.compile(f"[{JOINED}]"), re.compile(f"[{BLANK_MARKS}]")
_words = re.compile(r"[^\W\d_]+")
#: What is found in a value; the last two are other uses of letters than the ones that stand for Latin letters.
KINDS = ("full_width", "joined_letters", "separate_accent", "invisible", "space", "other_script", "styled_letter", "latin_in_other")


def script(c: str) -> str:
    """The script that the letter's name begins with, Latin for full-width Latin letters."""
    name = unicodedata.name(c, "?").removeprefix("FULLWIDTH ").removeprefix("MODIFIER LETTER ")
    return name.split(" ", 1)[0].capitalize()


def scripts(c: str) -> set[str]:
    """The scripts in which a letter of this look is written."""
    own = {script(c)}
    if c in LOOKS:
        own.add("Latin")
    own.update(name for name, table in TABLES.items() if LOOKS.get(c, c) in _FORMS[name])
    return own


#: For each script its letters by the Latin letter they look like.
_FORMS = {name: {lat: c for c, lat in reversed(table.items())} for name, table in TABLES.items()}


def _odd_space(c: str) -> bool:
    return c != " " and unicodedata.category(c) == "Zs"


def _invisible(c: str) -> bool:
    return (unicodedata.category(c) == "Cf" and not re.match(f"[{SEEN_MARKS}]", c)) or bool(_marks.match(c))


def consistent(text: str) -> tuple[str, list[str]]:
    """The consistent form of a text and the kinds of disguise found in it."""
    found = set()
    shown = []
    for c in text:
        if c < "\x80":
            shown.append(c)
        elif _invisible(c):
            found.add("invisible")
        elif _odd_space(c):
            found.add("space")
            shown.append(" ")
        elif _wide.match(c):
            found.add("full_width")
            shown.append(unicodedata.normalize("NFKC", c))
        elif c in STYLED:
            found.add("styled_letter")
            shown.append(STYLED[c])
        elif _joined.match(c):
            found.add("joined_letters")
            shown.append(unicodedata.normalize("NFKC", c))
        else:
            if shown and unicodedata.combining(c) and shown[-1][-1].isalpha() and c <= "ͯ":
                found.add("separate_accent")
            shown.append(c)
    out = unicodedata.normalize("NFC", "".join(shown))
    if any(c in LOOKS or c in PHONETIC for c in out):
        tokens = list(_words.finditer(out))
        own = [{script(c) for c in m.group()} for m in tokens]
        could = [set.intersection(*(scripts(c) for c in m.group())) for m in tokens]
        parts, at = [], 0
        for i, m in enumerate(tokens):
            word = spelled = m.group()
            if any(c in LOOKS for c in word):
                if "Latin" in could[i]:
                    if "Latin" not in own[i]:
                        # wholly in another script: true if a neighbour, parted by blanks only, can be nothing but that script
                        near = [i - 1] if i and out[tokens[i - 1].end() : m.start()].isspace() else []
                        near += [i + 1] if i + 1 < len(tokens) and out[m.end() : tokens[i + 1].start()].isspace() else []
                        if any("Latin" not in could[j] and own[i] & own[j] for j in near):
                            continue
                    found.add("other_script")
                    spelled = "".join(LOOKS.get(c, c) for c in word)
                elif len(own[i]) > 1 and could[i]:
                    # the rest of the word can be nothing but this script, so its Latin letters stand for that script's
                    forms = _FORMS[min(could[i])]
                    found.add("latin_in_other")
                    spelled = "".join(c if script(c) in could[i] else forms.get(LOOKS.get(c, c), c) for c in word)
            elif len(own[i]) > 1 and len(could[i]) == 1 and (only := min(could[i])) in _FORMS:
                found.add("latin_in_other")
                spelled = "".join(_FORMS[only].get(c, c) for c in word)
            elif any(c in PHONETIC for c in word) and any(c.isascii() for c in word):
                found.add("styled_letter")
                spelled = "".join(PHONETIC.get(c, c) for c in word)
            if spelled != word:
                parts += [out[at : m.start()], spelled]
                at = m.end()
        out = "".join(parts) + out[at:]
    return out, [k for k in KINDS if k in found]


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [consistent(v) for v in b.column("cell").to_pylist()]
        hit = pa.array([bool(k) for _, k in done])
        yield pa.RecordBatch.from_arrays(
            [
                *(b.column(n) for n in ("_id", "field_name", "cell")),
                pa.array([v for v, _ in done], pa.string()),
                pa.array([k for _, k in done], pa.list_(pa.string())),
            ],
            ["_id", "field_name", "value", "consistent_value", "kinds"],
        ).filter(hit)


def disguised_values(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """Rows (id_col, field_name, value, consistent_value, kinds) of all values that hold a disguise."""
    cells = field_cells(df.select(F.col(id_col).alias("_id"), *fields), "_id", fields)
    # the second pattern is costly, and most values don't pass the first
    cells = cells.where(F.col("cell").rlike(UNUSUAL) & F.col("cell").rlike(SUSPICIOUS))
    out = cells.mapInArrow(_check, f"_id {dict(df.dtypes)[id_col]}, field_name string, value string, consistent_value string, kinds array<string>")
    return out.withColumnRenamed("_id", id_col)
