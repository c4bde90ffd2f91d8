"""The crawl: from seeds to people and works, level by level.

A level asks what its people made and who took part in that; how titles are read
is the caller's. A level's frontier is an anti-join, and every level is staged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from filmweave.staging import stage


def _new(titles: DataFrame, known: DataFrame) -> DataFrame:
    return titles.distinct().join(known, titles.columns, "left_anti")


def walk(
    seeds: DataFrame,
    films_of: Callable[[DataFrame, int], DataFrame],
    casts_of: Callable[[DataFrame], DataFrame],
    max_depth: int = 3,
    full_frontier: bool = False,
    led_by: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(persons(name, level), films(film, level)) reached from ``seeds`` (name).

    ``films_of`` gives the films (film) of a level's new people (name), ``casts_of`` the casts (film, pos, actor, nested)
    of new films (film); both are asked once per name and film. Only actors read outside tables lead on, unless
    ``led_by`` gives directors (film, actor). A level's frontier is empty when the first usable actor of every known
    film is already known, even if later ones aren't, unless ``full_frontier``.
    """
    persons = stage(seeds.select("name").distinct().withColumn("level", F.lit(0)), "persons")
    films = stage(films_of(persons.select("name"), 0).distinct().withColumn("level", F.lit(0)), "films")
    usable = lambda new: casts_of(new).where("not nested and actor <> ''").select("film", "pos", "actor")
    met, led = usable(films.select("film")), led_by(films.select("film")).select("actor") if led_by else None
    for level in range(1, max_depth + 1):
        names = met.select("actor").unionByName(led) if led_by else met.select("actor")
        known = persons.select("name")
        if not full_frontier:
            leads = met.groupBy("film").agg(F.min_by("actor", "pos").alias("name")).select("name")
            if _new(leads, known).isEmpty():
                break
        frontier = stage(_new(names.withColumnRenamed("actor", "name"), known).withColumn("level", F.lit(level)), "frontier")
        if frontier.isEmpty():
            break
        persons = persons.unionByName(frontier)
        new = stage(_new(films_of(frontier.select("name"), level).select("film"), films.select("film")).withColumn("level", F.lit(level)), "new-films")
        films = films.unionByName(new)
        met = met.unionByName(usable(new.select("film")))
        if led_by:
            led = led.unionByName(led_by(new.select("film")).select("actor"))
    return persons, films


def crawl(
    seeds: DataFrame,
    person_films: DataFrame,
    casts: DataFrame,
    growth_films: DataFrame | None = None,
    max_depth: int = 3,
    full_frontier: bool = False,
    directors: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The walk over tables: ``person_films`` (name, film) as read for seeds, ``growth_films`` as read while growing,
    ``casts`` (film, pos, actor, nested), and ``directors`` (film, actor) if they lead on."""
    growth_films = person_films if growth_films is None else growth_films
    made = lambda names, level: (growth_films if level else person_films).join(names, "name", "left_semi").select("film")
    of = lambda table: lambda films: table.join(films, "film", "left_semi")
    return walk(seeds, made, of(casts), max_depth, full_frontier, of(directors) if directors is not None else None)
