"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Written forms of a missing identifier. Fixed values.
MISSING_DOI = ("", "-", "none", "nan", "n/a", "#name?")
MISSING_EID = ("", "-", "none", "nan", "n/a")


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def normal_doi(c: Column) -> Column:
    """A DOI in lower case without resolver or label; null for the forms of a missing one."""
    v = strip(F.lower(c))
    v = F.regexp_replace(F.regexp_replace(v, r"^https?://doi\.[a-z]+/", ""), r"^doi:\s*", "")
    return F.when(v.isin(*MISSING_DOI), None).otherwise(v)


def clean_eid(c: Column) -> Column:
    """An identifier without outer blanks; null for the forms of a missing one, which are case-sensitive."""
    v = strip(c)
    return F.when(v.isin(*MISSING_EID), None).otherwise(v)


def normal_title(c: Column) -> Column:
    """Letters, digits and underscores in lower case, all else a single blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def normal_name(c: Column) -> Column:
    """As normal_title, but hyphens stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s-]", " "), r"\s+", " "))


#: Articles that don't count in exact look-ups, taken out in this order. Fixed values.
ARTICLES = (" of the ", " of a ", " de la ", " de las ", " du ", " des ", " der ", " van de ", " van den ")
_MARK = "\x01"


def exact_name(c: Column) -> Column:
    """A name for exact look-ups: normal_name without articles, hyphens inside words as blanks."""
    return exact_of(marked_name(c))


def marked_name(c: Column) -> Column:
    """normal_name with a mark, which no such name holds, in place of each hyphen inside a word."""
    return F.regexp_replace(normal_name(c), r"(?<=[\p{L}\p{N}_])-(?=[\p{L}\p{N}_])", _MARK)


def exact_of(marked: Column) -> Column:
    """The form for exact look-ups of what marked_name gave, or of several such names with a blank between any two."""
    v = F.concat(F.lit(" "), marked, F.lit(" "))
    for article in ARTICLES:
        v = F.replace(v, F.lit(article), F.lit(" "))
    return F.trim(unmarked(v))


def has_article(marked: Column) -> Column:
    """Whether exact_of has an article to take out."""
    return F.concat(F.lit(" "), marked, F.lit(" ")).rlike(" (?:" + "|".join(a.strip() for a in ARTICLES) + ") ")


def unmarked(marked: Column) -> Column:
    """Blanks in place of the marks."""
    return F.replace(marked, F.lit(_MARK), F.lit(" "))


def title_case(c: Column) -> Column:
    """Every letter that doesn't follow a letter in upper case, all others in lower case."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def whole_number(c: Column) -> Column:
    """An integer from text such as 2015 or 2015.0, null from anything else."""
    return c.try_cast("double").try_cast("int")


def cut_words(c: Column, most: int) -> Column:
    """The longest run of leading words with at most that many characters; a longer first word is cut."""
    kept = F.regexp_extract(F.concat(c, F.lit(" ")), rf"^(.{{1,{most}}})\s", 1)
    return F.when(F.length(c) <= most, c).when(kept == "", F.substring(c, 1, most)).otherwise(F.trim(kept))


def split_values(c: Column, delimiter: str) -> Column:
    """The non-empty values between delimiters, without outer white space."""
    return F.filter(F.transform(F.split(c, delimiter), strip), lambda x: x != "")
