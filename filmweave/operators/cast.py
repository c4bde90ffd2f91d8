"""Casts of films: from tables, cast lists and bullet prose; all in column expressions over parsed templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as Y

from filmweave.functions import text as T, wikitext

# List templates; the cast list's own opening; words before a name; words that join names; a closing phrase.
LIST_NAMES = ["ubl", "unbulleted list", "plainlist"]
CAST_LIST = "{{cast list|"
LEAD_WORDS = ["gồm", "co", "có", "voi", "với", "trong", "png", "nhỏ", "dan", "dàn", "phim"]
JOIN_WORDS = ["gồm", "gom", "cung", "cùng", "voi", "với"]
AND_WORDS = ["va", "và"]
IN_WORDS = ["trong", "vào"]
ROLE_WORD = "vai"
ROLE_ENDS = ",.:"
PARENTHESES = "()"
MARKS = ".,;:!?\"“”‘’[]{}<>|\\/"
OTHERS = "Cùng một số diễn viên khác"

CAST = Y.ArrayType(Y.StructType([Y.StructField("actor_name", Y.StringType()), Y.StructField("character", Y.StringType())]))


def is_wikitable(text: Column) -> Column:
    return text.rlike(r"(?im)(^\{\||<table\b)")


def is_list(text: Column, templates: Column) -> Column:
    """A list template anywhere; plain bullets aren't one."""
    return F.exists(templates, lambda t: F.lower(t["name"]).contains("list") | F.lower(t["name"]).isin(LIST_NAMES))


def row_cast(row: Column) -> Column:
    """Cast of one table row: names are link targets after the first cell, the role is the first cell in italics."""
    bare = F.regexp_replace(row, r"\A\|+|\|+\z", "")
    cells = F.split(bare, r"\|(?![^\[]*\]\])")
    role = F.get(F.filter(cells, lambda c: c.contains("''")), 0)
    character = F.coalesce(T.strip(F.replace(role, F.lit("''"), F.lit(""))), F.lit(""))
    rest = F.array_join(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), "")
    names = F.filter(F.transform(T.wikilinks(rest), T.link_target), T.plausible_name)
    return F.transform(names, lambda n: F.struct(n.alias("actor_name"), character.alias("character")))


def table_cast(text: Column) -> Column:
    """All rows' casts, flattened; the flag ``nested`` of ``film_casts`` keeps that they came row by row."""
    return F.flatten(F.transform(T.table_rows(text), row_cast))


def _credit(name: Column, role: Column) -> Column:
    return F.struct(name.alias("actor_name"), role.alias("character"))


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def _from(c: Column, at: Column) -> Column:
    """What stands at place ``at`` (from 1) and after."""
    return F.substring(c, F.greatest(at, F.lit(1)), F.length(c))


def without_refs(text: Column) -> Column:
    """Neither references with their content nor empty ones: what an opening tag begins, up to where it ends."""

    def after(piece: Column) -> Column:
        """What remains of a piece that follows ``<ref``."""
        opening = F.substring_index(piece, ">", 1)
        empty = opening.endswith("/")
        closed, ended = piece.contains("</ref>"), piece.contains(">")
        tail = F.when(empty, _from(piece, F.length(opening) + 2)).when(closed, _from(piece, F.instr(piece, "</ref>") + len("</ref>")))
        return F.when(ended, F.coalesce(tail, F.concat(F.lit("<ref"), piece))).otherwise(F.concat(F.lit("<ref"), piece))

    joined = lambda pieces: F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), after), ""))
    return T.let(F.split(text, "<ref"), joined)


def _without_lead(item: Column) -> Column:
    """An item without the lead word that its first letters spell, and the marks around it."""
    letter = F.lit(r"[A-Za-zÀ-ỵ]")

    def cut(letters: Column) -> Column:
        spelled = F.lower(F.substring(letters, 1, max(map(len, LEAD_WORDS))))
        size = T.let(spelled, lambda s: F.coalesce(*(F.when(s.startswith(w), F.lit(len(w))) for w in LEAD_WORDS)))
        rest = T.let(size, lambda n: F.when(n.isNotNull(), _from(letters, n + 1)))
        next_letter = lambda r: T.let(F.regexp_instr(r, letter), lambda at: F.when(at > 0, _from(r, at)).otherwise(""))
        return T.let(rest, lambda r: F.when(r.isNotNull(), next_letter(r)))

    return F.coalesce(T.let(_from(item, F.regexp_instr(item, letter)), cut), item)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _clean_name(name: Column, marks: str) -> Column:
    """A name after the first word that joins it to others, without the "and" it begins with and without marks."""

    def own(words: Column) -> Column:
        joins = F.transform(words, lambda w: F.translate(F.lower(w), MARKS + PARENTHESES, "").isin(JOIN_WORDS))
        return F.array_join(F.slice(words, F.array_position(joins, True).cast("int") + 1, F.greatest(F.size(words), F.lit(1))), " ")

    def plain(kept: Column) -> Column:
        begins = F.lower(F.substring(kept, 1, max(map(len, AND_WORDS)))).isin(AND_WORDS)
        return F.array_join(_words(F.translate(F.when(begins, _from(kept, F.lit(3))).otherwise(kept), marks, "")), " ")

    return T.let(T.let(F.split(name, " "), own), plain)


def _role_place(text: Column) -> Column:
    """Where the first role word stands that something follows, in either case; 0 if none does."""
    return F.instr(F.translate(text, ROLE_WORD.upper(), ROLE_WORD), ROLE_WORD + " ")


def _role(tail: Column) -> Column:
    """What follows the role word, up to the mark that ends it; '' without one."""

    def said(rest: Column) -> Column:
        end = F.instr(F.substring(F.translate(rest, ROLE_ENDS, ROLE_ENDS[0] * len(ROLE_ENDS)), F.lit(2), F.length(rest)), ROLE_ENDS[0])
        kept = T.let(end, lambda e: F.when(e > 0, F.substring(rest, F.lit(1), e)).otherwise(rest))
        return F.trim(F.replace(F.array_join(_words(F.translate(kept, "'\"", "")), " "), F.lit(OTHERS), F.lit("")))

    rest = T.let(_role_place(tail), lambda at: F.when(at > 0, F.ltrim(_from(tail, at + len(ROLE_WORD) + 1))))
    return F.coalesce(T.let(rest, said), F.lit(""))


def prose_credit(item: Column, marks: str) -> Column:
    """(name, role) of a bullet item, read by position: the name is the first link's target, else what precedes the
    role word and its preposition; the role is looked for behind the name."""

    def unlinked(place: Column) -> Column:
        def named(before: Column) -> Column:
            preposition = F.lower(before).endswith(IN_WORDS[0]) & (F.length(before) < place - 1)
            return F.rtrim(F.when(preposition, F.substring(before, F.lit(1), F.length(before) - len(IN_WORDS[0]))).otherwise(before))

        name = T.let(F.rtrim(F.substring(item, F.lit(1), F.greatest(place - 1, F.lit(0)))), named)
        return T.let(name, lambda n: F.struct(n.alias("name"), _from(item, F.length(n) + 1).alias("tail")))

    def linked(link: Column) -> Column:
        inside = F.substring_index(F.substring(link, F.lit(3), F.length(link)), "]]", 1)
        told = T.let(inside, lambda i: F.struct(F.substring_index(i, "|", 1).alias("name"), _from(link, F.length(i) + 5).alias("tail")))
        return F.when(link.contains("]]") & ~link.startswith("[[]]"), told)

    link = T.let(F.instr(item, "[["), lambda at: F.when(at > 0, _from(item, at)))
    seen = F.coalesce(T.let(link, linked), T.let(_role_place(item), unlinked))
    return T.let(seen, lambda x: _credit(_clean_name(x["name"], marks), _role(x["tail"])))


def prose_cast(text: Column, keep_parentheses: bool = False) -> Column:
    """(name, role) of bullet items like ``* [[Name]] vai Role: ...``; both must be there.

    Marks go from names, parentheses with them unless ``keep_parentheses`` (so that a title that tells namesakes apart
    still leads to its page).
    """
    marks = MARKS + ("" if keep_parentheses else PARENTHESES)
    items = F.filter(F.split(T.squeeze(without_refs(text)), r"\*"), lambda i: i.contains(ROLE_WORD[0]) | i.contains(ROLE_WORD[0].upper()))
    led = F.transform(F.transform(items, lambda i: F.trim(i)), _without_lead)
    credits = F.transform(led, lambda i: prose_credit(i, marks))
    return F.filter(credits, lambda c: (c["actor_name"] != "") & (c["character"] != ""))


def _linked(item: Column) -> Column:
    """Target of the first closed link whose target isn't empty, else null."""
    insides = F.transform(F.filter(F.slice(F.split(item, r"\[\["), 2, F.length(item) + 1), lambda p: p.contains("]]")), lambda p: F.substring_index(p, "]]", 1))
    return F.substring_index(F.get(F.filter(insides, lambda i: (i != "") & ~i.startswith("|") & ~i.contains("]")), 0), "|", 1)


def _unlinked(item: Column) -> Column:
    """What precedes the role word and its preposition in an item, on one line; null if too little does."""
    starts = [p + ROLE_WORD for p in ("", *IN_WORDS)]

    def before(words: Column) -> Column:
        place = F.get(F.filter(F.transform(words, lambda w, i: F.when((i > 0) & T.begins(w, starts), i)), lambda i: i.isNotNull()), 0)
        size = T.let(place, lambda p: p - F.when(F.get(words, p - 1).isin(IN_WORDS), 1).otherwise(0))
        return F.array_join(F.slice(words, F.lit(1), size), " ")

    return T.let(T.let(F.split(T.squeeze(item), " "), before), lambda n: F.when((F.length(n) >= 3) & ~n.startswith("[") & T.squeeze(F.substring_index(item, "\n", 1)).startswith(n), n))


def _italic_role(item: Column) -> Column:
    """What stands in italics right behind a role word, else null."""

    def of(pieces: Column) -> Column:
        said = lambda p, i: F.when((i > 0) & (i < F.size(pieces) - 1) & T.strip(F.get(pieces, i - 1)).endswith(ROLE_WORD) & (p != "") & ~p.contains("'"), p)
        return F.get(F.filter(F.transform(pieces, said), lambda p: p.isNotNull()), 0)

    return T.let(F.split(item, "''"), of)


def list_cast(templates: Column) -> Column:
    """(name, role) of the items of top-level ``{{cast list|``; a role only in italics, else null; one of both must be there."""

    def credit(item: Column) -> Column:
        bare = F.regexp_replace(without_refs(item), r"\{\{[^}]+\}\}", "")
        return T.let(bare, lambda b: _credit(T.let(T.strip(F.coalesce(_linked(b), _unlinked(b))), _or_null), T.let(T.strip(_italic_role(b)), _or_null)))

    lists = F.filter(templates, lambda t: t["top"] & t["raw"].startswith(CAST_LIST))
    items = F.flatten(F.transform(lists, lambda t: F.filter(F.transform(F.split(t["raw"], r"\*"), T.strip), lambda i: i != "")))
    return F.filter(F.transform(items, credit), lambda c: c["actor_name"].isNotNull() | c["character"].isNotNull())


def film_casts(parts: DataFrame, part: str = "cast_part", keep_parentheses: bool = False) -> DataFrame:
    """Add ``actors`` and ``nested`` (table casts) to rows with a cast section.

    Only a section that opens a template, and is no table, is parsed; the rest is said in column expressions.
    """
    text = F.col(part)
    table = is_wikitable(text)
    told = parts.withColumn("_t", wikitext.templates(F.when(~table & text.contains("{{"), text)))
    listed = F.coalesce(is_list(text, F.col("_t")), F.lit(False))
    told = told.withColumn("_form", F.when(table, "table").when(listed, "list").otherwise("prose"))
    named = lambda c: F.filter(c, lambda x: T.plausible_name(x["actor_name"])).cast(CAST)
    actors = F.when(F.col("_form") == "table", table_cast(text).cast(CAST)).when(F.col("_form") == "list", named(list_cast(F.col("_t")))).otherwise(named(prose_cast(text, keep_parentheses)))
    return told.withColumns({"actors": actors, "nested": F.col("_form") == "table"}).drop("_t", "_form")
