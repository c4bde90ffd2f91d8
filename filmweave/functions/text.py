"""Column builders for text; all of them stay in the JVM but the template fold of ``clean_text``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from filmweave.functions import wikitext

LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without Unicode blanks at either end (SQL's trim takes spaces only)."""
    return F.regexp_replace(col(c), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def squeeze(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)[\s\x1c-\x1f]+", " ")


def any_of(c: Column | str, words: list[str]) -> Column:
    """Whether ``c`` contains one of ``words``."""
    out = F.lit(False)
    for w in words:
        out = out | col(c).contains(w)
    return out


def let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def begins(c: Column | str, words: list[str]) -> Column:
    """Whether ``c`` starts with one of ``words``."""
    out = F.lit(False)
    for w in words:
        out = out | col(c).startswith(w)
    return out


def lower_has(c: Column | str, words: list[str]) -> Column:
    """Whether ``c`` contains one of ``words`` in lower case, which is made once."""
    return let(F.lower(col(c)), lambda t: any_of(t, words))


def heading(line: Column | str) -> Column:
    """struct(level, title) of a heading line, else null: equal runs of ``=`` around a title."""
    pattern = r"(?s)\A(=+)(.*?)(=+)\z"

    def told(left: Column, title: Column, right: Column) -> Column:
        return F.when((left > 0) & (left == right) & (title != ""), F.struct(left.alias("level"), title.alias("title")))

    def read(s: Column) -> Column:
        parts = F.struct(F.length(F.regexp_extract(s, pattern, 1)).alias("l"), strip(F.regexp_extract(s, pattern, 2)).alias("t"), F.length(F.regexp_extract(s, pattern, 3)).alias("r"))
        return F.when(s.startswith("="), let(parts, lambda p: told(p["l"], p["t"], p["r"])))

    return let(strip(line), read)


def span(token: Column | str) -> Column:
    """struct(rowspan, colspan, data) of a cell: digits left of the first pipe count together for either attribute."""
    return let(strip(token), span_of)


def span_of(t: Column) -> Column:
    """``span`` of a cell that is stripped; one without either word isn't cut."""
    either = lambda c: c.contains("rowspan") | c.contains("colspan")
    plain = F.struct(F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), t.alias("data"))

    def read(left: Column) -> Column:
        number = F.coalesce(F.regexp_replace(left, r"[^0-9]", "").try_cast("int"), F.lit(1))
        value = lambda word: F.when(left.contains(word), number).otherwise(1)
        data = strip(F.substring(t, F.length(left) + 2, F.length(t)))
        spanned = F.struct(value("rowspan").alias("rowspan"), value("colspan").alias("colspan"), data.alias("data"))
        return F.when(either(left), spanned).otherwise(plain)

    return F.when(either(t), let(F.substring_index(t, "|", 1), read)).otherwise(plain)


def wikilinks(c: Column | str) -> Column:
    """All ``[[...]]`` in order."""
    return F.regexp_extract_all(col(c), F.lit(r"(\[\[.*?\]\])"), F.lit(1))


def link_target(link: Column) -> Column:
    """Target of a ``[[target|label]]``."""
    return strip(F.regexp_extract(link, r"(?s)\A\[\[([^|\]]*)", 1))


def table_rows(c: Column | str) -> Column:
    """Row texts of a wikitable: what follows each ``|-``, without blank ones."""
    parts = F.split(col(c), r"\|-")
    return F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), strip), lambda r: r != "")


def plausible_name(c: Column | str) -> Column:
    """Whether a string may be a person's name: length, first words, and at least one Latin letter."""
    n = col(c)
    good = (
        F.length(n).between(2, 80)
        & ~n.rlike(r"(?iu)\A(png|nhỏ|dan|phim|gom|co |có )")
        & ~n.rlike(r"(?U)\A[\W_]+\z")
        & n.rlike(r"[A-Za-zÀ-ſ]")
    )
    return F.coalesce(good, F.lit(False))


def without_marks(c: Column | str) -> Column:
    """No apostrophes, stripped."""
    return strip(F.replace(col(c), F.lit("'"), F.lit("")))


def birth_date(params: Column) -> Column:
    """ISO date of the first three numbers of template parameters, else the first number, else ''."""
    n = F.flatten(F.transform(params, lambda p: F.regexp_extract_all(p, F.lit(r"(\d+)"), F.lit(1))))
    pad = lambda c: F.lpad(c, F.greatest(F.length(c), F.lit(2)), F.lit("0"))
    full = F.concat_ws("-", F.get(n, 0), pad(F.get(n, 1)), pad(F.get(n, 2)))
    return F.when(F.size(n) >= 3, full).when(F.size(n) >= 1, F.get(n, 0)).otherwise("")


def convert(params: Column) -> Column:
    """A measure's number, in ``m`` if its unit has an m."""
    value = F.regexp_replace(F.coalesce(F.get(params, 0), F.lit("")), r"[^0-9.,]", "")
    return F.when(F.lower(F.coalesce(F.get(params, 1), F.lit(""))).contains("m"), F.concat(value, F.lit("m"))).otherwise(value)


def height(params: Column) -> Column:
    """The first ``...m=value`` parameter in metres."""
    first = F.get(F.filter(params, lambda p: p.contains("m=")), 0)
    return F.coalesce(F.concat(F.get(F.split(first, "="), 1), F.lit("m")), F.lit(""))


def _unmarked(c: Column) -> Column:
    """Without tags and links; every one of them has one of two marks."""
    out = c
    for pattern, to in wikitext.MARKUP:
        out = F.regexp_replace(out, pattern, to)
    return F.when(c.contains("<") | c.contains("["), out).otherwise(c)


def clean_text(c: Column | str) -> Column:
    """Readable text of marked-up text. Only texts with templates reach Python."""
    marked = _unmarked(F.coalesce(col(c), F.lit("")))
    folded = F.when(marked.contains("{{"), wikitext.fold_templates(F.when(marked.contains("{{"), marked))).otherwise(marked)
    out = F.regexp_replace(squeeze(folded), r"(?U)\s*,\s*,\s*", ", ")
    return F.regexp_replace(out, r"\A[ ,]+|[ ,]+\z", "")
