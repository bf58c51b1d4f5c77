"""The query language: typed filters, phrases and exclusions, then what plain words say about intent, source and time."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from loregrid.functions.dates import PHRASES, parse_date
from loregrid.plans.filters import SOURCES, FilterSet

SEARCH, ANSWER, SUMMARIZE = "search", "answer", "summarize"
#: Filter names, and the beginnings and phrases that are looked for, in order.
NAMES = ["source", "type", "tag", "collection", "after", "before", "path", "domain", "kind"]
SUMMARY_STARTS = ["summarize ", "summary of "]
ANSWER_STARTS = ["what ", "how ", "why ", "when ", "who ", "tell me "]
SOURCE_PHRASES = {
    "from clipboard": "clipboard",
    "from browser": "browser",
    "in my emails": "email",
    "in my notes": "markdown",
    "in browser": "browser",
    "in emails": "email",
    "in pdfs": "pdf",
    "in pdf": "pdf",
    "in html": "html",
    "in web archives": "html",
    "in docx": "docx",
    "in ebooks": "epub",
    "in epubs": "epub",
    "in org files": "org",
    "in code": "code",
}


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    text: str
    quoted: bool = False
    colon: int = -1


@dataclass(frozen=True)
class ParsedQuery:
    original: str
    intent: str = SEARCH
    text: str = ""
    search_terms: str = ""
    filters: FilterSet = field(default_factory=FilterSet)


def lex(raw: str) -> list[Token]:
    """Blank-parted tokens; double quotes hold blanks, a backslash keeps the next character, the first bare colon is noted."""
    out: list[Token] = []
    text, quoted, colon, inside, begun = "", False, -1, False, False
    chars = iter(raw)
    for c in chars:
        if c == "\\":
            following = next(chars, None)
            if following is None:
                raise QueryError("trailing escape at the end of the query")
            quoted |= following.isspace()
            text, begun = text + following, True
        elif c == '"':
            inside, quoted, begun = not inside, True, True
        elif c.isspace() and not inside:
            if begun:
                out.append(Token(text, quoted, colon))
            text, quoted, colon, begun = "", False, -1, False
        else:
            if c == ":" and not inside and colon < 0:
                colon = len(text)
            text, begun = text + c, True
    if inside:
        raise QueryError("unterminated quote in the query")
    if begun:
        out.append(Token(text, quoted, colon))
    return out


def rendered(token: Token) -> str:
    """A token as query text that lexes to itself."""
    body = re.sub(r'(["\\])', r"\\\1", token.text)
    if not token.quoted:
        return body
    return f'-"{body[1:]}"' if body.startswith("-") and len(body) > 1 else f'"{body}"'


def without(text: str, phrase: str) -> tuple[str, bool]:
    """The text without the first occurrence of the phrase, whatever its case, and whether there was one."""
    at = text.lower().find(phrase)
    return (text, False) if at < 0 else (f"{text[:at].strip()} {text[at + len(phrase) :].strip()}".strip(), True)


def _added(values: tuple[str, ...], value: str) -> tuple[str, ...]:
    return values if value.lower() in (v.lower() for v in values) else (*values, value)


def apply_filter(filters: FilterSet, name: str, value: str, negated: bool, sources: list[str]) -> FilterSet:
    if not value.strip():
        raise QueryError(f"filter {name}: needs a value")
    if negated and name != "tag":
        raise QueryError(f"filter {name}: cannot be negated")
    value = value.strip()
    if name in ("source", "type"):
        if value.lower() not in sources:
            raise QueryError(f"unknown source {value!r}: expected one of {', '.join(sources)}")
        return replace(filters, sources=_added(filters.sources, value.lower()))
    if name == "tag":
        return replace(filters, excluded_tags=_added(filters.excluded_tags, value.lower())) if negated else replace(filters, tags=_added(filters.tags, value.lower()))
    if name in ("after", "before"):
        if getattr(filters, name):
            raise QueryError(f"filter {name}: is given twice")
        try:
            return replace(filters, **{name: parse_date(value)})
        except ValueError as e:
            raise QueryError(f"filter {name}: {e}") from e
    if name == "domain":
        value = value.lower().removeprefix("*.").strip(".")
    if name == "kind":
        value = value.lower()
    key = {"collection": "collections", "path": "paths", "domain": "domains", "kind": "kinds"}[name]
    return replace(filters, **{key: _added(getattr(filters, key), value)})


def parse_strict(raw: str, sources: list[str] = SOURCES) -> ParsedQuery:
    """The parsed query; malformed syntax, unknown filters and invalid dates are QueryErrors."""
    filters, free = FilterSet(), []
    for token in lex(raw):
        head, value = (token.text[: token.colon], token.text[token.colon + 1 :]) if token.colon >= 0 else ("", "")
        negated = head.startswith("-")
        name = head.removeprefix("-").lower()
        if token.colon < 0 or not re.fullmatch(r"[a-z][a-z0-9_-]*", name):
            free.append(token)
        elif name in NAMES:
            filters = apply_filter(filters, name, value, negated, sources)
        elif value.startswith("//") or len(name) == 1:
            free.append(token)
        else:
            raise QueryError(f"unknown filter {name!r}: expected one of {', '.join(NAMES)}")
    if filters.after and filters.before and filters.after >= filters.before:
        raise QueryError("filter after: must lie before filter before:")

    text = " ".join(map(rendered, free)).strip()
    intent = SEARCH
    if start := next((s for s in SUMMARY_STARTS if text.lower().startswith(s)), None):
        intent, text = SUMMARIZE, text[len(start) :].strip()
    elif text.lower().startswith(tuple(ANSWER_STARTS)):
        intent = ANSWER
    for phrase, source in SOURCE_PHRASES.items():
        text, found = without(text, phrase)
        if found:
            filters = filters if filters.sources else replace(filters, sources=(source,))
            break
    for phrase in PHRASES:
        text, found = without(text, phrase)
        if found:
            filters = filters if filters.after or filters.before else replace(filters, relative_time=phrase)
            break

    words, terms = [], []
    for token in lex(text):
        if not token.text:
            raise QueryError("empty term in the query")
        terms.append(rendered(token))
        if token.text.startswith("-") and len(token.text) > 1:
            filters = replace(filters, excluded=_added(filters.excluded, token.text[1:]))
        elif token.quoted:
            filters = replace(filters, phrases=_added(filters.phrases, token.text))
        else:
            words.append(token.text)
    return ParsedQuery(raw, intent, " ".join(words), " ".join(terms), filters)


def parse(raw: str, sources: list[str] = SOURCES) -> ParsedQuery:
    """The strict parse, or the whole text as a search if that fails."""
    try:
        return parse_strict(raw, sources)
    except QueryError:
        return ParsedQuery(raw, SEARCH, raw.strip(), raw.strip())
