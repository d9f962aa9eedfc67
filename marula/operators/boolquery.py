"""Boolean search queries: composing, cleaning for a stricter parser, year ranges, vocabulary.

A query is cleaned on its token list, not on its text: words, phrases in quotes or
braces, brackets, and proximity marks. Each rule changes tokens and reports what it
did; the balance of brackets is known from the start.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

#: Words of a query that aren't terms. Fixed values.
OPERATORS = {"and", "or", "not", "near", "with", "the", "of", "by", "in", "to", "a", "an", "is", "are", "as", "at", "be", "do", "if", "it", "no", "so", "up", "us"}
_token = re.compile(r'"[^"]*"|\{[^}]*\}|[()]|\s+|W/\d+|[^\s()"{}]+')
_phrase = re.compile(r"[A-Za-z][\w'\-]*(?: +[A-Za-z0-9][\w'\-]*)*")
YEARS = re.compile(r"AND PUBYEAR > \d{4} AND PUBYEAR < \d{4}")


def compose(lines: Iterable[str], countries: Iterable[str], first: int = 2015, last: int = 2025) -> str:
    """One query of all lines, limited to countries, years and document types."""
    content = " OR ".join(f"TITLE-ABS-KEY( {' '.join(x.split())} )" for x in lines if x and x.strip())
    places = " OR ".join(f'AFFILCOUNTRY ( "{c}" )' for c in sorted(countries))
    return f"( {content} )\nAND ( {places} )\nAND PUBYEAR > {first - 1} AND PUBYEAR < {last + 1}\nAND ( DOCTYPE ( ar ) OR DOCTYPE ( re ) )"


def with_years(query: str, first: int, last: int) -> str:
    """The query with its year range replaced by first to last, both included."""
    return YEARS.sub(f"AND PUBYEAR > {first - 1} AND PUBYEAR < {last + 1}", query)


#: What parts bare words of one token.
_PARTING = str.maketrans("/,[]", "    ")


def vocabulary(line: str) -> list[str]:
    """Terms of a query line with at least three letters: phrases in quotes without their last wildcards, then bare words."""
    phrases, words = [], []
    for token in _token.findall(line):
        if token[0] == '"':
            kept = "".join(c if c.isalnum() or c in "_-" else " " for c in token.strip('"').strip().rstrip("*").lower())
            phrases.append(" ".join(kept.split()))
        elif token[0] == "{":
            # the braces stick to the outer words, which so are no plain ones
            words += token.split()[1:-1]
        else:
            words += token.translate(_PARTING).split()
    words = [w.lower() for w in words if w.isalpha()]
    return [t for t in phrases if len(t) > 2] + [w for w in words if len(w) > 2 and w not in OPERATORS]


def _unhyphened(token: str) -> str | None:
    """A word in two parts with a wildcard at its end, written as one; None for any other token."""
    left, mark, right = token.partition("-")
    parts = (left, right.removesuffix("*"))
    if not mark or right == parts[1] or len(left) < 2:
        return None
    return left + right if all(x.isascii() and x.isalnum() and x[0].isalpha() for x in parts) else None


def _clean_phrase(token: str) -> tuple[str, str | None]:
    """A quoted phrase or braces without wildcards where they aren't allowed, and the rule that did it."""
    body = token[1:-1]
    if token[0] == "{":
        return ("{" + body[:-1] + "}", "C") if body.endswith("*") and len(body) > 1 else (token, None)
    if "*" not in body:
        return token, None
    stars, plain = body.count("*"), body.replace("*", "")
    if not _phrase.fullmatch(plain.strip()) or body[:1] == "*":
        return token, None
    if stars == 1:
        if body.endswith("*") and " " not in body:
            return body, "A"
        return f'"{plain}"', "B"
    return "(" + " W/1 ".join(body.split()) + ")", "E"


def _partner(tokens: list[str], at: int, step: int) -> int | None:
    """The index of the bracket that closes (or, backwards, opens) the one at this place."""
    depth = 0
    while 0 <= at < len(tokens):
        depth += (tokens[at] == "(") - (tokens[at] == ")")
        if depth == 0:
            return at
        at += step
    return None


def _next(tokens: list[str], at: int, step: int) -> int:
    """The nearest token in a direction that isn't blank."""
    at += step
    while 0 <= at < len(tokens) and tokens[at].isspace():
        at += step
    return at


def _wild_group(tokens: list[str], at: int, step: int) -> bool:
    """Whether a bracketed group with a wildcard begins (or ends) at this place."""
    if not 0 <= at < len(tokens) or tokens[at] != ("(" if step > 0 else ")"):
        return False
    other = _partner(tokens, at, step)
    return other is not None and any("*" in t for t in tokens[min(at, other) : max(at, other) + 1])


def clean(query: str) -> tuple[str, Counter]:
    """The query as a stricter parser takes it, and how often each rule was applied.

    A: a quoted word with a wildcard loses its quotes. B: a phrase with one wildcard
    loses it. C: so do braces. D: a leading wildcard goes. E: a phrase with several
    becomes a proximity group. F: a hyphened word with a wildcard is written as one.
    G: a proximity mark beside a group with a wildcard becomes AND.
    """
    counts: Counter = Counter()
    tokens: list[str] = []
    for token in _token.findall(query):
        if token[0] in '"{' and len(token) > 1:
            token, rule = _clean_phrase(token)
            if rule:
                counts[rule] += 1
            if rule != "A":
                tokens += _token.findall(token) if rule == "E" else [token]
                continue
        if token[0] == "*" and len(token) > 1 and token[1].isalpha():
            token = token.lstrip("*")
            counts["D"] += 1
        if (solid := _unhyphened(token)) is not None:
            token = solid
            counts["F"] += 1
        tokens.append(token)
    changed = True
    while changed:
        changed = False
        for i, token in enumerate(tokens):
            if re.fullmatch(r"W/\d+", token) and (_wild_group(tokens, _next(tokens, i, 1), 1) or _wild_group(tokens, _next(tokens, i, -1), -1)):
                tokens[i] = "AND"
                counts["G"] += 1
                changed = True
    return re.sub(r" {2,}", " ", "".join(tokens)), counts
