"""Sections of a page: the film section of persons, the cast section of films."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from filmweave.functions import text as T
from filmweave.operators import infobox as I
from filmweave.staging import stage

# Words of section titles, and what stands for a page that has no such section.
FILM_TITLES = ["phim", "film", "điện ảnh"]
CAREER_TITLES = ["sự nghiệp"]
CAST_TITLES = ["diễn viên", "actor", "nhân vật", "character"]
FROM_FILM = "==> ko extract films từ wiki film"
NO_FILM_PERSON = "person ko là actor cũng ko là director"
MAIN = r"(?iu)\{\{\s*(?:chính|main)\s*\|\s*([^}|]+)"
#: Pages that a section may hop through.
MAX_DEPTH = 2


def lines_of(text: Column) -> Column:
    return F.split(text, T.LINE)


def headings(text: Column) -> Column:
    """array(struct(line, level, title)) of a text's headings, lines from 0."""
    return headings_of(lines_of(text))


def headings_of(lines: Column) -> Column:
    """The same from a text's lines; only lines with an equals sign are looked at closely."""
    told = F.transform(lines, lambda line, i: F.struct(i.alias("line"), F.when(line.contains("="), T.heading(line)).alias("h")))
    return F.transform(F.filter(told, lambda x: x["h"].isNotNull()), lambda x: F.struct(x["line"].alias("line"), x["h"]["level"].alias("level"), x["h"]["title"].alias("title")))


def _cut(lines: Column, start: Column, end: Column) -> Column:
    """Lines after ``start`` and before ``end``, joined and stripped."""
    return T.strip(F.array_join(F.slice(lines, start + 2, F.greatest(end - start - 1, F.lit(0))), "\n"))


def section(lines: Column, heads: Column, first: list[str], last: list[str] = ()) -> Column:
    """The level-2 section whose title has one of ``first`` (the first such), else one of ``last`` (the last such); else ''.

    ``lines`` and ``heads`` are ``lines_of`` and ``headings`` of the text, worked out once.
    """

    def cut(second: Column, start: Column) -> Column:
        end = F.get(F.filter(second, lambda h: h["line"] > start), 0)["line"]
        return F.when(start.isNull(), "").otherwise(T.let(F.coalesce(end, F.size(lines)), lambda e: _cut(lines, start, e)))

    def read(second: Column) -> Column:
        chosen = F.get(F.filter(second, lambda h: T.lower_has(h["title"], first)), 0)
        if last:
            chosen = F.coalesce(chosen, F.try_element_at(F.filter(second, lambda h: T.lower_has(h["title"], last)), F.lit(-1)))
        return T.let(chosen["line"], lambda start: cut(second, start))

    return T.let(F.filter(heads, lambda h: h["level"] == 2), read)


def main_link(section_text: Column) -> Column:
    """The page that a section hands over to, or null."""
    target = T.strip(F.regexp_extract(section_text, MAIN, 1))
    return F.when(target != "", target)


def page_sections(facts: DataFrame) -> DataFrame:
    """Page facts with film_part, film_hop, cast_part, cast_hop: what each page alone says."""
    read = facts.withColumn("_lines", lines_of(F.coalesce("text", F.lit(""))))
    read = read.withColumn("_heads", headings_of(F.col("_lines")))
    lines, heads = F.col("_lines"), F.col("_heads")
    told = read.withColumns({"film_part": section(lines, heads, FILM_TITLES, CAREER_TITLES), "cast_part": section(lines, heads, CAST_TITLES)})
    return told.withColumns({"film_hop": main_link(F.col("film_part")), "cast_hop": main_link(F.col("cast_part"))}).drop("_lines", "_heads")


def _follow(told: DataFrame, part: str, hop: str, at_once: Column, first_only: Column, more: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(title, part): a part that hands over to an existing page is what that page says, up to MAX_DEPTH hops.

    ``at_once``: result that ends the walk on any page, ``first_only``: on the first page; null if neither. Only rows
    that have a hop are staged and joined at each depth, and ``more`` reads the facts of the pages they hop to (all are in ``told``
    without it).
    """
    full = F.col("full") if "full" in told.columns else F.coalesce("text", F.lit("")) != ""
    as_page = lambda facts: facts.select("title", F.col(part).alias("says"), F.col(hop).alias("to"), at_once.alias("stop"), first_only.alias("start_stop"), full.alias("full"))
    page = as_page(told)
    now = page.select("title", F.coalesce("stop", "start_stop", "says").alias("says"), F.when(F.coalesce("stop", "start_stop").isNull(), F.col("to")).alias("to"))
    done, open_ = now.where("to is null"), now.where("to is not null")
    for depth in range(1, MAX_DEPTH + 2):
        if open_.isEmpty():
            break
        open_ = stage(open_, f"{part}-open") if depth == 1 else open_
        pages = as_page(more(open_.select(F.col("to").alias("title")))) if more else page
        next_ = pages.where("full").select(F.col("title").alias("_t"), F.col("says").alias("_says"), F.col("to").alias("_to"), F.col("stop").alias("_stop"))
        joined = open_.join(next_, F.col("to") == F.col("_t"), "left")
        hopped = F.col("_t").isNotNull()
        says = F.coalesce("_stop", F.col("_says") if depth <= MAX_DEPTH else F.lit(""))
        to = F.when(hopped & F.col("_stop").isNull(), F.col("_to")) if depth <= MAX_DEPTH else F.lit(None).cast("string")
        stepped = stage(joined.select("title", F.when(hopped, says).otherwise(F.col("says")).alias("says"), to.alias("to")), f"{part}-hops")
        done, open_ = done.unionByName(stepped.where("to is null")), stepped.where("to is not null")
    return done.select("title", F.col("says").alias(part))


def film_sections(told: DataFrame, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(title, film_part) of persons, hand-overs followed (on pages that ``more`` reads, if given)."""
    box = F.col("infobox")
    film = F.when(F.col("kind") == "film", FROM_FILM)
    other = F.when(~I.is_actor(box) & ~I.is_director(box), NO_FILM_PERSON)
    return _follow(told, "film_part", "film_hop", film, other, more)


def cast_sections(told: DataFrame, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(title, cast_part) of films, hand-overs followed; a page that isn't about a film says ''."""
    return _follow(told, "cast_part", "cast_hop", F.lit(None).cast("string"), F.when(~I.is_film_box(F.col("infobox")), ""), more)


def subsections(section_text: Column) -> Column:
    """array(struct(title, subsection_wikitext)): the level-3 parts; leading text only if it is a table."""
    entry = lambda title, body: F.struct(title.alias("title"), body.alias("subsection_wikitext"))
    none = F.expr("cast(array() as array<struct<title: string, subsection_wikitext: string>>)")
    whole = F.when(section_text.contains("{|"), F.array(entry(F.lit("Phim"), T.strip(section_text)))).otherwise(none)

    def read(lines: Column, third: Column) -> Column:
        before = _cut(lines, F.lit(-1), F.get(third, 0)["line"])
        lead = T.let(before, lambda b: F.when(b.startswith("{|"), F.array(entry(F.lit("Phim"), b))).otherwise(none))
        ends = lambda i: F.coalesce(F.get(third, i + 1)["line"], F.size(lines))
        parts = F.transform(third, lambda h, i: entry(h["title"], _cut(lines, h["line"], ends(i))))
        return F.when(F.size(third) == 0, whole).otherwise(F.concat(lead, parts))

    # lines and headings are found once, not once more per part
    return T.let(lines_of(section_text), lambda lines: T.let(F.filter(headings_of(lines), lambda h: h["level"] == 3), lambda third: read(lines, third)))


def ordered_distinct(items: Column) -> Column:
    """Distinct items in order of first occurrence."""
    return F.array_distinct(items)
