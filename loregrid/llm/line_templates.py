"""Line deduplication by a log-template tree, with DataFrame functions alone.

A line is parsed to a fixed depth: by its number of tokens, then by its leading tokens, where a token with
a figure stands for any. In a leaf the line forms pass by rank (the number of texts, then the digest), and
each joins the first representative that has ``alike`` percent of its tokens at the same places, or becomes
one: a representative and its forms are a template, the places where they differ its variable fields, and a
leaf has as many templates as it needs. A line of under DEPTH + 2 tokens is a template of its own, since
nothing but the variable field stands behind the leading tokens.

A template recurs when its lines stand in at least ``min_docs`` different texts, in ``min_docs_short`` for
lines of under ``short`` tokens and in ``min_docs_long`` for those of ``long`` tokens or more.

The text with the smallest document id keeps the lines of a recurring template; they are dropped
elsewhere. Exact copies of a text are one text here, so copies alone make nothing recur.

Lines travel as hashes and ids; texts are shuffled twice, to the lines whose tokens are compared and to their dropped positions. Joins hash the side
whose keys are unique, so that nothing wide is sorted; keys with over a thousandth of all lines are
broadcast, so that a frequent line never gathers in one task. A leaf gives its BLOCK best forms to a fold at
a time; what fits none of their representatives is compared with the next ones, so no leaf is gathered.

Defined results: lines end at line feeds; tokens are runs of other characters than blanks (U+0020, U+0009
to U+000D), compared with their case; a line without tokens is never dropped; null texts stay null, empty
texts and texts that lose every line are empty; repeated rows give repeated rows; all columns of the input
stay, whatever their names, but n_lines and n_dropped, which are replaced; n_chars, if there, follows the
new text; an empty table gives no rows. Ids are integers; rows with a null id keep their lines only where
no other text has them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregrid.llm.io import cut, free, named

DEPTH, ALIKE = 3, 75
MIN_DOCS, SHORT, MIN_DOCS_SHORT, LONG, MIN_DOCS_LONG = 3, 8, 10, 50, 2
#: Forms of a leaf that meet in one row.
BLOCK = 256
#: A key with more than this share of all lines is heavy: so there are at most so many heavy keys, which are broadcast.
HEAVY = 1000
_BLANK = r"[\x20\x09-\x0D]+"
_TOKEN = r"[^\x20\x09-\x0D]"
#: What a line of even spaces does not hold (a line feed ends a line).
_UNEVEN = ["  ", "\t", "\x0b", "\x0c", "\r"]
#: Starts at the beginning of a token only, and never goes back: linear in the line.
_FIGURED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def _digest(x: Column) -> Column:
    """60 bits of the MD5 digest of a string, as a long."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 15), 16, 10).cast("long")


def _whole(text_col: str) -> Column:
    """60 bits that name a text."""
    return F.shiftrightunsigned(F.xxhash64(named(text_col)), 4)


def _pair(high: str, low: str) -> Column:
    """A long and 60 bits as one decimal number, which sorts like the pair; unlike a struct it can be aggregated by hashing."""
    return F.col(high).cast("decimal(38,0)") * F.lit(2**60).cast("decimal(19,0)") + F.col(low).cast("decimal(19,0)")


def _low(pair: str) -> Column:
    return F.pmod(F.col(pair), F.lit(2**60).cast("decimal(38,0)")).cast("long")


def _normal(lines: DataFrame) -> DataFrame:
    """``lines`` with single spaces between the tokens of ``line``, and those with a figure as one sign."""
    # Blanks become single spaces first, where they are not yet: parting at one plain character is much cheaper than by a pattern.
    uneven = F.col("line").startswith(" ") | F.col("line").endswith(" ")
    for blank in _UNEVEN:
        uneven = uneven | F.col("line").contains(blank)
    lines = lines.withColumn("line", F.when(uneven, F.trim(F.regexp_replace("line", _BLANK, " "))).otherwise(F.col("line")))
    return lines.withColumn("line", F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", _FIGURED, "<*>")).otherwise(F.col("line")))


def parsed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, whole, pos, n, leaf, form) of every line with a token; whole names the text."""
    lines = docs.filter(named(text_col).isNotNull()).select(
        named(id_col).alias("id"), _whole(text_col).alias("whole"), F.posexplode(F.split(named(text_col).cast("string"), "\n", -1)).alias("pos", "line")
    )
    # Lines without tokens go by the line as it is: a filter on what is made of it would make it twice.
    lines = _normal(lines.filter(F.col("line").rlike(_TOKEN)))
    lines = lines.withColumn("tokens", F.split("line", " "))
    n = F.size("tokens")
    leaf = F.xxhash64(n, F.slice("tokens", 1, DEPTH))
    return lines.select("id", "whole", "pos", n.alias("n"), leaf.alias("leaf"), _digest(F.col("line")).alias("form"))


def _tokens(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(leaf, form, rank, hashes) of the ``wanted`` lines (id, whole, pos, leaf, form, rank), with the hashes of their tokens; texts without one aren't parted."""
    at = wanted.groupBy("id", "whole").agg(F.collect_list(F.struct("leaf", "form", "rank", "pos")).alias("at")).hint("shuffle_hash")
    texts = docs.filter(named(text_col).isNotNull()).select(named(id_col).alias("id"), _whole(text_col).alias("whole"), named(text_col).cast("string").alias("text"))
    # The lines are a variable: as an expression they would be made for each that is wanted.
    found = F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.transform("at", lambda x: F.struct(x["leaf"].alias("leaf"), x["form"].alias("form"), x["rank"].alias("rank"), F.get(lines, x["pos"]).alias("line"))))
    lines = _normal(texts.join(at, ["id", "whole"]).select(F.inline(F.get(found, F.lit(0)))))
    return lines.select("leaf", "form", "rank", F.transform(F.split("line", " "), lambda x: F.hash(x)).alias("hashes"))


def _meet(rows: DataFrame, keys: DataFrame, on: list[str], bar: int, how: str) -> DataFrame:
    """``rows`` joined to ``keys`` (on, lines, ...), of which those with ``bar`` lines or more, HEAVY at most, are broadcast.

    So the rows of a line that a third of all documents share stay where they are instead of meeting in a task.
    """
    heavy = F.broadcast(keys.filter(F.col("lines") >= bar).drop("lines"))
    usual = keys.filter(F.col("lines") < bar).drop("lines").hint("shuffle_hash")
    return rows.join(heavy, on, how).unionByName(rows.join(heavy.select(*on), on, "left_anti").join(usual, on, how))


def _bar(min_docs: int = MIN_DOCS, short: int = SHORT, min_docs_short: int = MIN_DOCS_SHORT, long: int = LONG, min_docs_long: int = MIN_DOCS_LONG) -> Column:
    """How many texts a template of n tokens needs."""
    return F.when(F.col("n") < short, min_docs_short).when(F.col("n") >= long, min_docs_long).otherwise(min_docs)


def _fit(known: Column, hashes: Column, alike: int) -> Column:
    """The first of the representatives that has ``alike`` percent of the tokens, or null."""

    def fits(y: Column) -> Column:
        equal = F.filter(F.zip_with(hashes, y["hashes"], lambda a, b: a == b), lambda e: e)
        return F.size(equal) * 100 >= F.size(hashes) * alike

    return F.get(F.filter(known, fits), F.lit(0))["form"]


def _folded(open_: DataFrame, alike: int, block: int) -> DataFrame:
    """(leaf, low, known, out): the representatives among the ``block`` best forms of each leaf, where these forms go, and the last one's rank."""
    best = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("rank")))
    met = open_.withColumn("nth", best).filter(F.col("nth") <= block).groupBy("leaf").agg(F.min("rank").alias("low"), F.collect_list(F.struct("rank", "form", "hashes")).alias("met"))
    start = F.struct(F.array().cast("array<struct<form:bigint,hashes:array<int>>>").alias("known"), F.array().cast("array<struct<form:bigint,template:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        def placed(fit: Column) -> Column:
            one = F.struct(x["form"].alias("form"), x["hashes"].alias("hashes"))
            known = F.when(fit.isNull(), F.concat(acc["known"], F.array(one))).otherwise(acc["known"])
            return F.struct(known.alias("known"), F.concat(acc["out"], F.array(F.struct(x["form"].alias("form"), F.coalesce(fit, x["form"]).alias("template")))).alias("out"))

        # The fit is a variable: as an expression it would be evaluated for each of its uses.
        return F.get(F.transform(F.array(_fit(acc["known"], x["hashes"], alike)), placed), F.lit(0))

    folded = F.aggregate(F.reverse(F.array_sort("met")), start, step)
    return met.select("leaf", "low", folded.alias("f")).select("leaf", "low", "f.known", "f.out")


def _first_fits(forms: DataFrame, lines: DataFrame, tokens: Callable[[DataFrame], DataFrame], alike: int, block: int = BLOCK) -> DataFrame:
    """(leaf, form, template) of the forms in leaves of more than one; their tokens come from the text that owns the form.

    Only the first line of each such form in its text is parsed for them, so what travels with tokens is what meets in a fold. Each round
    takes a block of every leaf. The forms behind it are split among the tasks like any rows, and a
    join to the few representatives of a hot leaf is split by Spark.
    """
    numbers = forms.filter(F.col("n") >= DEPTH + 2).groupBy("leaf").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1")
    open_ = forms.join(numbers.select("leaf").hint("shuffle_hash"), "leaf", "left_semi").select("leaf", "form", "owner", _pair("docs", "form").alias("rank"))
    own = lines.filter(F.col("n") >= DEPTH + 2).groupBy("leaf", "form", "id", "whole").agg(F.min("pos").alias("pos")).withColumn("owner", _pair("id", "whole"))
    # Repeated rows give their lines twice.
    open_ = cut(tokens(own.join(open_.hint("shuffle_hash"), ["leaf", "form", "owner"])).distinct(), small=True)
    more = (numbers.agg(F.max("forms")).first()[0] or 0) > block
    out = []
    while True:
        folded = cut(_folded(open_, alike, block), small=True)
        out.append(folded.select("leaf", F.explode("out").alias("x")).select("leaf", "x.form", "x.template"))
        if not more:
            break
        behind = open_.join(folded.select("leaf", "low", "known"), "leaf").filter("rank < low")
        behind = cut(behind.select("leaf", "form", "rank", "hashes", _fit(F.col("known"), F.col("hashes"), alike).alias("template")), small=True)
        out.append(behind.filter("template is not null").select("leaf", "form", "template"))
        open_ = behind.filter("template is null").drop("template")
        if open_.isEmpty():
            break
    placed = out[0]
    for rows in out[1:]:
        placed = placed.unionByName(rows)
    return placed


def templates(lines: DataFrame, tokens: Callable[[DataFrame], DataFrame], alike: int = ALIKE, block: int = BLOCK, **limits: int) -> DataFrame:
    """(leaf, form, template, lines, docs, owner) of the line forms whose template recurs; ``tokens`` gives wanted lines the hashes of their tokens."""
    once = lines.groupBy("leaf", "form", "whole").agg(F.count(F.lit(1)).alias("lines"), F.min("id").alias("id"), F.max("n").alias("n"))
    forms = once.groupBy("leaf", "form").agg(F.count(F.lit(1)).alias("docs"), F.sum("lines").alias("lines"), F.min(_pair("id", "whole")).alias("owner"), F.max("n").alias("n"))
    forms = cut(forms)
    placed = _first_fits(forms, lines, tokens, alike, block).hint("shuffle_hash")
    forms = forms.join(placed, ["leaf", "form"], "left").withColumn("template", F.coalesce("template", "form"))
    total = forms.groupBy("leaf", "template").agg(F.sum("docs").alias("total"), F.min("owner").alias("first"), F.max("n").alias("n"))
    total = total.filter(F.col("total") >= _bar(**limits)).drop("n")
    out = forms.join(total.hint("shuffle_hash"), ["leaf", "template"])
    return out.select("leaf", "form", "template", "lines", F.col("total").alias("docs"), _low("first").alias("owner"))


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the sorted positions ``gone``: the stretches between them, linear in its lines."""

    def joined(lines: Column, bounds: Column) -> Column:
        stretch = F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), lambda i: F.slice(lines, F.get(bounds, i) + 2, F.get(bounds, i + 1) - F.get(bounds, i) - 1))
        return F.array_join(F.flatten(stretch), "\n")

    # Lines and bounds are variables: as expressions they would be evaluated for each stretch.
    whole = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.get(F.transform(F.array(F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))), lambda bounds: joined(lines, bounds)), F.lit(0)))
    return F.get(whole, F.lit(0))


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, **limits: int) -> DataFrame:
    """``docs`` without the lines of recurring templates, and two more columns: n_lines and n_dropped (long)."""
    docs = docs.drop(*(c for c in ("n_lines", "n_dropped") if c in docs.columns))
    lines = cut(parsed(docs, id_col, text_col))
    # A template has no more lines than its leaf: most leaves hold too few and go before anything wide is shuffled.
    bar = lines.count() // HEAVY + 1
    full = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines"), F.max("n").alias("n")).filter(F.col("lines") >= _bar(**limits)).drop("n")
    # What is met is read three times; written first, it also keeps the plans, and with them the driver's memory, small.
    lines = cut(_meet(lines, cut(full, small=True), ["leaf"], bar, "left_semi"))
    known = templates(lines, lambda wanted: _tokens(docs, id_col, text_col, wanted), block=block, **limits)
    known = cut(known.select("leaf", "form", "lines", "owner"), small=True)
    dropped = _meet(lines.select("id", "whole", "pos", "leaf", "form"), known, ["leaf", "form"], bar, "inner").filter("whole <> owner")
    gone, key, own, whole = free(docs, "gone", "key", "id", "whole")
    dropped = dropped.groupBy(F.col("id").alias(own), F.col("whole").alias(whole)).agg(F.array_sort(F.collect_set("pos")).alias(gone)).hint("shuffle_hash")
    out = docs.withColumn(key, _whole(text_col)).join(dropped, named(id_col).eqNullSafe(F.col(own)) & (F.col(key) == F.col(whole)), "left")
    text, given = F.when(F.col(gone).isNull(), named(text_col)).otherwise(_without(named(text_col), F.col(gone))), named(text_col)
    lines_of = F.coalesce(F.length(given) - F.length(F.replace(given, F.lit("\n"))) + 1, F.lit(0)).cast("long")
    out = out.select(*(text.alias(c) if c == text_col else named(c) for c in docs.columns), lines_of.alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))
    return out.withColumn("n_chars", F.length(named(text_col)).cast("long")) if "n_chars" in docs.columns else out
