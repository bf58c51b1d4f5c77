"""String, list and map functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a question or its context.
STOPWORDS = ["what", "when", "where", "which", "who", "why", "how", "the", "and", "for", "with", "did", "about", "write", "from", "into", "this", "that", "your", "were", "have"]
#: The patterns that mask mail addresses, long numbers, bearer tokens and keys, in this order.
MASKS = [
    (r"(?i)([a-z0-9._%+\-])([a-z0-9._%+\-]{0,64})@([a-z0-9.\-]+\.[a-z]{2,})", "$1***@$3"),
    (r"\b\d{13,19}\b", "[redacted-number]"),
    (r"(?i)bearer\s+[a-z0-9._\-]{16,}", "Bearer [redacted-token]"),
    (r"(?i)\b(api[_-]?key|token|secret)\s*[:=]\s*([^\s,;]+)", "$1=[redacted]"),
]
TERM = r"[\p{L}\p{N}]+"


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[ \t\n\r\f\v]+", " "))


def terms(x: Column) -> Column:
    """The search terms of a text, in order: lower-cased runs of letters and figures."""
    return F.regexp_extract_all(F.lower(x), F.lit(TERM), F.lit(0))


#: Runs of a text: words and what stands between them, in turn.
RUNS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"


def highlight(x: Column, wanted: Sequence[str], before: int = 10, runs: int = 40) -> Column:
    """The fragment of ``runs`` words and gaps, from ``before`` of them ahead of a wanted term, that has most of them (the first of equals), each in <mark>; null without any.

    An ellipsis stands where the text goes on. Linear in the text: only the runs behind each term are looked through.
    """

    def best(parts: Column) -> Column:
        hit = lambda w: F.lower(w).isin(*wanted)
        begins = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: hit(F.get(parts, i))), lambda i: F.greatest(i - before, F.lit(0)))
        scored = F.transform(begins, lambda i: F.struct(F.size(F.filter(F.slice(parts, i + 1, runs), hit)).alias("n"), (-i).alias("at")))
        return F.when(F.size(begins) > 0, F.concat(_marked(parts, -F.array_max(scored)["at"], hit, runs)))

    # The runs are a variable: as an expression they would be made for each use.
    text = F.coalesce(x, F.lit(""))
    return F.get(F.transform(F.array(F.regexp_extract_all(F.when(text == "", " ").otherwise(text), F.lit(RUNS), F.lit(0))), best), F.lit(0))


def _marked(parts: Column, at: Column, hit, runs: int) -> Column:
    shown = F.transform(F.slice(parts, at + 1, runs), lambda w: F.when(hit(w), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w))
    return F.concat(F.when(at > 0, "…").otherwise(""), F.array_join(shown, ""), F.when(at + runs < F.size(parts), "…").otherwise(""))


def keywords(x: Column) -> Column:
    """The set of telling words: lower-cased ASCII runs of three characters or more, without stopwords."""
    words = F.split(F.lower(x), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS)))


def overlap(a: Column, b: Column) -> Column:
    """The share of a's distinct words that b has; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def preview(x: Column, size: int = 500, back_over: float = 0.5) -> Column:
    """White space collapsed; a longer text is cut at ``size``, back to the last space if that is past the given share, and marked."""
    flat = collapse(x)
    head = F.substring(flat, 1, size)
    space = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    cut = F.when(space > int(size * back_over), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(cut, F.lit("...")))


def preview_markdown(x: Column, size: int = 500) -> Column:
    """A preview without Markdown's code, links, images, heading marks and emphasis."""
    for pattern, to in (
        (r"(?s)```.*?```", ""),
        (r"`[^`]+`", ""),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"\[\[([^\]]+)\]\]", "$1"),
        (r"!\[[^\]]*\]\([^)]+\)", ""),
        (r"(?m)^(?:#{1,6})\s+(.+)$", "$1"),
        (r"\*\*([^*]+)\*\*", "$1"),
        (r"\*([^*]+)\*", "$1"),
        (r"__([^_]+)__", "$1"),
        (r"_([^_]+)_", "$1"),
    ):
        x = F.regexp_replace(x, pattern, to)
    return preview(x, size, 0.75)


def display(x: Column, size: int) -> Column:
    """One line of at most ``size`` characters, the last three dots if it was longer."""
    flat = collapse(x)
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.substring(flat, 1, max(0, size - 3)), F.lit("...")))


def slug(x: Column, size: int = 64) -> Column:
    """Lower-case letters and figures; blanks and ``-_.:/`` part them with one hyphen, other characters go; of at most ``size`` characters."""
    s = F.regexp_replace(F.lower(F.trim(x)), r"[^a-z0-9\s_.:/-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s_.:/-]+", "-"), "^-+", "")
    return F.regexp_replace(F.substring(s, 1, size), "-+$", "")


def first_line(x: Column) -> Column:
    return F.substring_index(x, "\n", 1)


def derived_title(x: Column, size: int = 80) -> Column:
    """The first line with text, without heading marks, of at most ``size`` characters."""
    lines = F.filter(F.transform(F.split(x, "\n"), lambda v: F.trim(F.regexp_replace(F.trim(v), "^#+", ""))), lambda v: v != "")
    return F.substring(F.coalesce(F.get(lines, 0), F.lit("")), 1, size)


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, "<[^>]*>?", "")


def masked(x: Column) -> Column:
    for pattern, to in MASKS:
        x = F.regexp_replace(x, pattern, to)
    return x


def redacted(x: Column, patterns: Sequence[str]) -> Column:
    """Every match of the patterns, in order, replaced by a mark; see ``usable_patterns``."""
    for p in patterns:
        x = F.regexp_replace(x, p, "[REDACTED]")
    return x


def usable_patterns(patterns: Sequence[str]) -> tuple[list[str], list[str]]:
    """(the patterns that compile, the others); look-around and back references count as bad."""
    import re

    good, bad = [], []
    for p in patterns:
        try:
            re.compile(p)
            (bad if not p or re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", p) else good).append(p)
        except re.error:
            bad.append(p)
    return good, bad


def listed(x: Column, parting: str = ",") -> Column:
    """A parted list: trimmed, folded, empty entries dropped, repeated ones kept once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), parting), lambda v: F.lower(F.trim(v))), lambda v: v != ""))


def union_folded(a: Column, b: Column) -> Column:
    """Both lists, each entry once whatever its case; the first casing stays."""
    both = F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
    fold = lambda v: F.lower(F.trim(v))
    step = lambda acc, v: F.when((F.trim(v) == "") | F.exists(acc, lambda o: F.lower(o) == fold(v)), acc).otherwise(F.concat(acc, F.array(F.trim(v))))
    return F.aggregate(both, F.array().cast("array<string>"), step)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 0.0).otherwise(both / union)


def headings(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(r"(?m)^#{1,6}\s+(.+)$"), F.lit(1)), lambda h: F.trim(h))


def hash_tags(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?:^|\s)#([a-zA-Z][a-zA-Z0-9_-]*)"), F.lit(1)))


def wiki_links(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)))


def markdown_links(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"\[[^\]]+\]\(([^)]+)\)"), F.lit(1)))


def frontmatter(x: Column) -> Column:
    """map<string,string> of the flat ``key: value`` lines between the first two --- lines; quotes and list brackets go, empty values too; the last of equal keys stays."""
    lines = F.split(F.regexp_extract(x, r"(?s)\A---\n(.+?)\n---\n?", 1), r"\r?\n")
    bare = lambda v: F.regexp_replace(F.trim(F.regexp_replace(v, r"^[^:]+:", "")), "^[\"']+|[\"']+$", "")
    pairs = F.transform(F.filter(lines, lambda v: v.rlike("^[^:]+:")), lambda v: F.struct(F.trim(F.substring_index(v, ":", 1)).alias("k"), F.regexp_replace(bare(v), r"^\[(.*)\]$", "$1").alias("v")))
    pairs = F.filter(pairs, lambda p: (p["v"] != "") & (p["k"] != ""))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def stable_id(*parts: Column, width: int = 32) -> Column:
    """The first hexadecimal digits of the SHA-256 of the parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, width)


def document_of_chunk(key: Column) -> Column:
    return F.regexp_replace(key, ":[^:]*$", "")


def password_like(x: Column) -> Column:
    """One unspaced line of 8 to 128 bytes with three of upper-case, lower-case, figures and other marks."""
    kinds = sum(x.rlike(p).cast("int") for p in ("[A-Z]", "[a-z]", "[0-9]", "[^A-Za-z0-9]"))
    return F.octet_length(x).between(8, 128) & ~x.rlike("[ \\n]") & (kinds >= 3)


def visible_characters(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[\s\p{P}]", ""))


def human_size(n: Column, units: str = "KMGTPE") -> Column:
    """Bytes in the largest of ``units`` that is reached, with one decimal, halves to the even one; null stays null."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(units, 1):
        # The part behind the point is exact, and so is ten times it below 2**53 bytes: no decimal text of a double is rounded again.
        x = n.cast("double") / F.lit(float(1024**power))
        tenths = F.floor(x) * 10 + F.rint((x - F.floor(x)) * 10).cast("long")
        shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}B"))
        out = F.when(n >= 1024**power, shown).otherwise(out)
    return out


def cut_bytes(x: Column, size: int) -> Column:
    """The longest prefix of at most ``size`` bytes that ends between characters."""
    raw = F.encode(x, "UTF-8")
    heads = [F.substring(raw, 1, size - back).cast("string") for back in range(4) if size > back]
    return F.when(F.octet_length(x) <= size, x).otherwise(F.coalesce(*(F.when(F.is_valid_utf8(h), h) for h in heads), F.lit("")))


def bounded_map(m: Column, keys: int = 50, size: int = 1024) -> Column:
    """The first ``keys`` entries by key, values cut to ``size`` characters."""
    return F.map_from_entries(F.transform(F.slice(F.array_sort(F.map_entries(m)), 1, keys), lambda e: F.struct(e["key"], F.substring(e["value"], 1, size))))
