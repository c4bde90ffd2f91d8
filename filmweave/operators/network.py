"""The whole run: pages and seeds to people, works, and the credits graph.

Pages lie in a store by title, and only what the crawl reaches is parsed: each
level asks for the pages of its people, of the films their tables name, and of
those films' casts. A page is parsed once, whatever titles lead to it; redirects are
followed on titles alone, so an alias costs a row, not a parse.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from filmweave.operators import cast, crawl, graph, infobox, lookup, predicates, records, sections, tables
from filmweave.sources.store import PageStore
from filmweave.staging import spread, stage


@dataclass
class Network:
    """Crawled people and works with their levels, their records, the graph, and what tables couldn't be read."""

    persons: DataFrame
    films: DataFrame
    nodes: DataFrame
    credits: DataFrame
    edges: DataFrame
    errors: DataFrame
    reader: Reader


class Reader:
    """What pages say, parsed when a title asks for it."""

    def __init__(self, store: PageStore, keep_parentheses: bool = False):
        self.store, self.keep_parentheses = store, keep_parentheses
        ends = lookup.resolve_redirects(store.redirects()).select(F.col("title").alias("_t"), F.col("final_title").alias("_end"))
        self.ends = stage(ends, "redirect-ends")
        self.parsed: list[DataFrame] = []

    def page_of(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """Add the page a title ends at: itself unless it redirects, null if it runs into a cycle."""
        return df.join(self.ends, F.col(column) == F.col("_t"), "left").withColumn(name, F.when(F.col("_t").isNull(), F.col(column)).otherwise(F.col("_end"))).drop("_t", "_end")

    def told(self) -> DataFrame:
        """What all pages parsed so far say, by title."""
        return reduce(DataFrame.unionByName, self.parsed)

    def facts(self, titles: DataFrame, read: bool = True) -> DataFrame:
        """(title, page, kind, infobox, director, vn_status, sections and hops) of those ``titles`` (title) that are pages.

        ``titles`` should be staged: what leads to them is asked twice. Without ``read`` only parsed pages are told.
        """
        asked = self.page_of(titles.select("title").where("title is not null").distinct(), "title", "page")
        if read:
            new = asked.select(F.col("page").alias("title"))
            texts = self.store.read(new.join(self.told().select("title"), "title", "left_anti") if self.parsed else new)
            if texts is not None or not self.parsed:
                said = sections.page_sections(infobox.page_facts(texts if texts is not None else self.store.table.where("false").select("title", "text")))
                status = predicates.vn_film_status(F.col("title"), F.col("kind"), F.col("infobox"))
                said = said.withColumns({"vn_status": status, "full": F.coalesce("text", F.lit("")) != ""}).drop("templates", "text", "director_status")
                self.parsed.append(stage(said, "page-facts"))
        return asked.join(self.told().withColumnRenamed("title", "page"), "page")

    def pages_parsed(self) -> int:
        return self.told().count() if self.parsed else 0

    def films(self, names: DataFrame, words: list[str], again: bool) -> tuple[DataFrame, DataFrame]:
        """((name, film): titles in the film tables of ``names`` (name) of rows whose film counts, table rows with an error).

        ``again``: the title itself must count too.
        """
        told = self.facts(names.select(F.col("name").alias("title")))
        rows = stage(tables.film_rows(sections.film_sections(told, self.facts)), "film-rows")
        judged = self.facts(rows.select(F.col("second").alias("title"))).select("title", "vn_status")
        kept = tables.vn_film_rows(rows, judged).withColumn("film", tables.row_title(words)).where(F.trim("film") != "")
        found = stage(kept.select(F.col("title").alias("name"), "film").distinct(), "found-films")
        if again:
            status = self.facts(found.select(F.col("film").alias("title"))).select(F.col("title").alias("film"), "vn_status")
            found = found.join(status.where(predicates.keeps_film(F.col("vn_status"))).select("film"), "film", "left_semi").select("name", "film")
        return found, rows.where("error is not null").select(F.col("title").alias("name"), "section", "error")

    def casts(self, films: DataFrame) -> DataFrame:
        """(film, actors, nested) of ``films`` (film) that are pages."""
        told = self.facts(films.select(F.col("film").alias("title")))
        parts = spread(sections.cast_sections(told, self.facts), "title")
        return stage(cast.film_casts(parts, keep_parentheses=self.keep_parentheses).select(F.col("title").alias("film"), "actors", "nested"), "casts")


def build(
    pages: DataFrame | PageStore,
    seeds: DataFrame,
    max_depth: int = 3,
    any_case: bool = False,
    keep_parentheses: bool = False,
    flatten_table_cast: bool = False,
    full_frontier: bool = False,
    canonicalize: bool = False,
    directors_lead: bool = False,
) -> Network:
    """From ``pages`` (title, text; or a store of them, whose redirects then stand) and ``seeds`` (name) to the network.

    Seeds' titles come from any column that sounds like a title; while the network grows fewer columns do, and a title
    is judged once more. ``canonicalize``: aliases of one page are one node, under the title at the redirects' end.
    """
    store = pages if isinstance(pages, PageStore) else PageStore.write(pages, any_case=any_case)
    reader = Reader(store, keep_parentheses)
    at_end = lambda df, c: reader.page_of(df, c, "_page").withColumn(c, F.coalesce("_page", c)).drop("_page") if canonicalize else df
    met, errors, casts = [], [], []

    def films_of(names: DataFrame, level: int) -> DataFrame:
        found, wrong = reader.films(names, tables.GROWTH_WORDS if level else tables.SEED_WORDS, level > 0)
        met.append(stage(at_end(found, "film"), "met-films") if level or canonicalize else found)
        errors.append(wrong)
        return met[-1].select("film")

    def casts_of(films: DataFrame) -> DataFrame:
        casts.append(reader.casts(films))
        listed = casts[-1].select("film", F.posexplode_outer("actors").alias("pos", "a"), (F.col("nested") & F.lit(not flatten_table_cast)).alias("nested")).where("a is not null")
        return at_end(listed.select("film", "pos", F.col("a.actor_name").alias("actor"), "nested"), "actor")

    def led_by(films: DataFrame) -> DataFrame:
        told = reader.facts(films.select(F.col("film").alias("title")))
        return at_end(told.select(F.col("title").alias("film"), F.explode("director").alias("actor")), "actor")

    persons, films = crawl.walk(at_end(seeds, "name"), films_of, casts_of, max_depth, full_frontier, led_by if directors_lead else None)
    known = reduce(DataFrame.unionByName, casts)
    box = reader.facts(persons.select(F.col("name").alias("title")).unionByName(films.select(F.col("film").alias("title"))), read=False).select(F.col("title").alias("_t"), "infobox", "director")
    none = F.create_map().cast("map<string,string>")
    of = reduce(DataFrame.unionByName, met).groupBy("name").agg(F.array_sort(F.collect_set("film")).alias("films"))
    people = persons.join(box.select("_t", F.col("infobox").alias("info")), F.col("name") == F.col("_t"), "left").drop("_t").join(of, "name", "left")
    people = people.withColumns({"info": F.coalesce("info", none), "films": F.coalesce("films", F.expr("cast(array() as array<string>)"))})
    works = films.join(box, F.col("film") == F.col("_t"), "left").drop("_t").join(known, "film", "left").withColumn("infobox", F.coalesce("infobox", none))
    people = stage(records.person_records(people), "person-records")
    works = stage(records.film_records(stage(spread(works, "film"), "works"), flatten_table_cast).join(films, "film"), "film-records")
    credits = stage(graph.attempts(graph.credits_of(works), graph.names_of(people, works)), "credits")
    return Network(people, works, graph.nodes(people, works), credits, graph.edges(credits), reduce(DataFrame.unionByName, errors), reader)
