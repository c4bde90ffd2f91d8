"""Infoboxes: extraction from a page's templates, classification, directors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filmweave.functions import text as T, wikitext
from filmweave.staging import spread

# Words that mark a template as an infobox of either kind, and keys looked up in it.
PERSON_WORDS = ["nhân vật", "diễn viên", "nghệ sĩ", "person"]
FILM_WORDS = ["phim", "film", "truyền hình", "điện ảnh", "television"]
OCCUPATION_KEYS = ["công việc", "nghề nghiệp", "occupation"]
DIRECTOR_KEYS = ["đạo diễn", "director", "directors"]
NO_LINK = "đạo diễn không có wikilink"


def with_templates(pages: DataFrame, text: str = "text") -> DataFrame:
    """Add ``templates``; every page is parsed once, later steps read this column."""
    return pages.withColumn("templates", wikitext.templates(text))


def infobox(templates: Column) -> Column:
    """Non-empty parameters of all templates whose name has an infobox word; later values replace earlier ones."""
    chosen = F.filter(templates, lambda t: T.lower_has(t["name"], PERSON_WORDS + FILM_WORDS))
    pairs = F.flatten(F.transform(chosen, lambda t: F.filter(t["params"], lambda p: p["v"] != "")))
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>"))


def page_kind(text: Column, templates: Column) -> Column:
    """``film`` or ``person`` by the first template with an infobox word (film words first), '' if none, null without text."""
    first = F.get(F.filter(templates, lambda t: T.lower_has(t["name"], PERSON_WORDS + FILM_WORDS)), 0)
    kind = T.let(first, lambda f: F.when(f.isNull(), "").when(T.lower_has(f["name"], FILM_WORDS), "film").otherwise("person"))
    return F.when(F.coalesce(text, F.lit("")) != "", kind)


def lower_keys(box: Column) -> Column:
    return F.transform_keys(box, lambda k, v: F.lower(k))


def first_key(box: Column, keys: list[str]) -> Column:
    """Value of the first of ``keys`` that is present."""
    return F.coalesce(*(F.try_element_at(box, F.lit(k)) for k in keys))


def _occupation(box: Column) -> Column:
    return F.lower(F.concat(*(F.coalesce(F.try_element_at(box, F.lit(k)), F.lit("")) for k in OCCUPATION_KEYS)))


def is_actor(box: Column) -> Column:
    return _occupation(box).contains("diễn viên")


def is_director(box: Column) -> Column:
    return _occupation(box).contains("nhà làm phim")


def is_film_box(box: Column) -> Column:
    """Not an actor's or director's box, and any key or value speaks of films."""
    speaks = F.exists(F.map_entries(box), lambda e: F.lower(e["key"]).contains("phim") | F.lower(e["value"]).contains("phim"))
    return ~is_actor(box) & ~is_director(box) & speaks


def directors(box: Column) -> Column:
    """struct(director, director_status): link targets of the first director field; null without a field."""
    field = T.let(lower_keys(box), lambda b: first_key(b, DIRECTOR_KEYS))
    return T.let(field, _directors_of)


def _directors_of(field: Column) -> Column:
    names = F.transform(T.wikilinks(field), T.link_target)
    status = F.when(field.isNull(), "no field").when(F.size(names) == 0, NO_LINK).otherwise("linked")
    return F.struct(F.when(field.isNotNull() & (F.size(names) > 0), names).alias("director"), status.alias("director_status"))


def clean_infoboxes(pages: DataFrame, key: str = "title", column: str = "infobox") -> DataFrame:
    """(key, column) with every value read for display."""
    entries = spread(pages.select(key, column), key).select(key, F.explode(F.map_entries(column)).alias("e")).select(key, F.col("e.key").alias("k"), wikitext.display(F.col("e.value")).alias("v"))
    return entries.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(column))


def page_facts(pages: DataFrame) -> DataFrame:
    """``pages`` (title, text) with templates, infobox, kind and directors."""
    told = with_templates(pages)
    return (
        told.withColumn("infobox", infobox(F.col("templates")))
        .withColumn("kind", page_kind(F.col("text"), F.col("templates")))
        .withColumn("d", directors(F.col("infobox")))
        .select("*", "d.director", "d.director_status")
        .drop("d")
    )
