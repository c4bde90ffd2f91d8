"""What grows faster than its input: rows that are shuffled, tasks that hold everything, columns read twice."""

import itertools
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from conftest import SMALL
from filmweave.functions import wikitext
from filmweave.operators import cast, graph, infobox, lookup, sections, tables
from filmweave.plans import queries

film_casts = cast.film_casts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def crowd(spark):
    rng = random.Random(5)
    people = [(f"p{i:02}", {"education": rng.choice(["S", "T", ""]), "birth_place": rng.choice(["x", "y", ""])}) for i in range(40)]
    films = {f"f{i}": rng.sample([p for p, _ in people], 15 if i == 0 else rng.randint(1, 4)) for i in range(25)}
    edges = [(p, f, rng.choice(["actor", "director"]), None) for f, who in films.items() for p in who]
    nodes = spark.createDataFrame([(p, "person", info, None) for p, info in people], "id string, type string, info map<string,string>, infobox map<string,string>")
    return dict(people), nodes, edges, spark.createDataFrame(edges, "person string, film string, role string, character string")


def test_collaborations_shuffle_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "MEETINGS", 20)
    info, nodes, edges, df = crowd(spark)
    want = {}
    for a, b in itertools.combinations(sorted(info), 2):
        roles = lambda p: {f: r for q, f, r, _ in edges if q == p}
        films = sorted(roles(a).keys() & roles(b).keys())
        same = [info[a][k] if info[a][k] and info[a][k] == info[b][k] else None for k in ("education", "birth_place")]
        if films or any(same):
            want[a, b] = (films, sorted({f"{roles(a)[f]}-{roles(b)[f]}" for f in films}), *same)
    made = graph.collaborations(nodes, df)
    got = {(r["p1"], r["p2"]): (r["films"], r["collaboration_types"], r["school"], r["location"]) for r in made.collect()}
    assert got == want and made.count() == len(want)
    assert "hashpartitioning(p1" not in plan(made)
    assert graph.collaboration_count(nodes, df).first()["n"] == len(want)
    # however a film's cast and a class are cut
    monkeypatch.setattr(graph, "STRIDE_BITS", 2)
    monkeypatch.setattr(graph, "STRIDE", 4)
    blocks = graph.seat_blocks(graph.people_of(nodes), 100)
    casts = graph.seated_casts(df, blocks, 4)
    assert casts.where("chunk > 0").count() and blocks.agg(F.max(F.size("names"))).first()[0] <= 4
    met = graph.meetings(casts)
    assert met.where("a >= b").isEmpty()
    assert met.count() == sum(len(v[0]) for v in want.values()) == met.select("a", "b", "film").distinct().count()
    alone = {tuple(sorted((r["n1"], r["n2"]))): (r["school"], r["location"]) for r in graph.alike_only(casts, blocks).collect()}
    assert alone == {k: v[2:] for k, v in want.items() if not v[0]}


def test_pairs_are_named_where_they_lie(spark, monkeypatch):
    """Whatever the optimizer may broadcast: no join shuffles pairs, neither to tell what they share nor to name them."""
    info, nodes, edges, df = crowd(spark)
    told = lambda made: sorted(map(tuple, made.collect()))
    want = told(graph.collaborations(nodes, df))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = graph.collaborations(nodes, df)
        dealt = set(re.findall(r"hashpartitioning\((\w+?)#", plan(made)))
        assert not dealt & {"_a", "_b", "b"} and told(made) == want
        monkeypatch.setattr(graph, "BLOCKS_AT_HAND", 1)  # more people than executors may hold: names come one by one
        assert told(graph.collaborations(nodes, df)) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_weights_need_neither_films_nor_characters(spark):
    """Weighted pairs shuffle no pair either, no film's name with their people, and no character of an edge."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = queries.QUERIES["collab_weight"](spark, SMALL)
        assert not set(re.findall(r"hashpartitioning\((\w+?)#", plan(made))) & {"_a", "_b", "b"} and "film#" not in plan(made)
        assert "character" not in queries.credits_graph(spark, SMALL)[3].columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_later_people_by_what_they_share(spark):
    """Runs of a place, and schools that lie in several places or in none, however a cast is cut."""
    info, nodes, edges, df = crowd(spark)
    blocks = graph.seat_blocks(graph.people_of(nodes), 3)
    seat = {(r["block"] * graph.STRIDE + i): n for r in blocks.collect() for i, n in enumerate(r["names"])}
    alike = lambda a, b: any(info[a][k] and info[a][k] == info[b][k] for k in info[a])
    for size in (100, 4):
        casts = graph.seated_casts(df, blocks, size)
        met = {w: sorted(tuple(sorted((seat[r["a"]], seat[r["b"]]))) + (r["film"],) for r in graph.meetings(casts, alike=w).collect()) for w in (None, True, False)}
        assert [p for p in met[None] if alike(*p[:2])] == met[True] and [p for p in met[None] if not alike(*p[:2])] == met[False]
        assert met[True] and met[False]


def test_shared_pairs_lie_in_many_tasks(spark):
    people = spark.range(300).select(F.concat(F.lit("p"), "id").alias("name"), F.lit("x").alias("place"))
    made = graph.shared_pairs(people, "place", block=30)
    assert made.count() == 300 * 299 // 2
    assert made.select(F.spark_partition_id()).distinct().count() > 2


def test_few_texts_are_objects_at_once(monkeypatch):
    """What a batch holds beside Arrow's buffers is bounded by texts, not by the batch's rows."""
    at_once, seen = [], []

    class Part:
        def __init__(self, texts):
            self.texts = texts

        def __len__(self):
            return len(self.texts)

        def slice(self, i, n):
            return Part(self.texts[i : i + n])

        def to_pylist(self):
            at_once.append(len(self.texts))
            return self.texts

    texts = [None if i % 7 == 0 else f"{{{{a|{i}|x=[[y|z]]}}}}" for i in range(1000)]
    told = wikitext.by_slices(Part(texts), lambda t: seen.append(t) or wikitext.templates_of(t), to_arrow_type(wikitext.TEMPLATES))
    assert max(at_once) <= wikitext.AT_ONCE and len(seen) == sum(t is not None for t in texts)
    assert told.to_pylist() == [wikitext.templates_of(t) for t in texts]
    assert wikitext.by_slices(Part([]), wikitext.fold, pa.string()).to_pylist() == []


def test_pages_of_casts_are_parsed_once(spark, monkeypatch):
    """Rows with and without a hop are two reads of one staged table; neither holds the parser."""
    held = []
    monkeypatch.setattr(cast, "film_casts", lambda told: held.append(told) or film_casts(told))
    queries.QUERIES["cast_table_roundtrip"](spark, SMALL)
    assert "ArrowEvalPython" not in plan(held[0])


def test_boxes_are_read_in_all_tasks(spark):
    boxes = spark.range(400).coalesce(1).select(F.col("id").cast("string").alias("title"), F.create_map(F.lit("k"), F.lit("[[a|b]]")).alias("infobox"))
    shown = plan(infobox.clean_infoboxes(boxes))
    assert shown.index("ArrowEvalPython") < shown.index("xxhash64")  # dealt below the parser


def test_grids_hold_places_not_texts(spark):
    """The fold over a table's rows copies its state at every step; texts stay outside of it."""
    n = 300
    lines = [f"|-\n| rowspan=\"{n - i}\" | a{i}\n| b{i}" if i == 0 else f"|-\n| b{i} || c{i}" for i in range(n)]
    text = "{|\n!x!!y!!z\n" + "\n".join(lines) + "\n|}"
    parts = spark.createDataFrame([("t", 0, "s", text, [1, 2])], "title string, section_no int, section string, wikitext string, numbers array<int>")
    made = tables.table_rows(parts)
    assert "array<array<string>>" not in made._jdf.queryExecution().analyzed().toString()
    got = {r["row_no"]: (r["cells"], r["numbers"]) for r in made.collect()}
    assert got == {i: ({"x": "a0", "y": f"b{i}", "z": f"c{i}" if i else None}, [1, 2]) for i in range(n)}


def test_wide_tables_are_rendered_once(spark):
    assert "Join" not in plan(queries.QUERIES["wide_table_roundtrip"](spark, SMALL))


def test_redirect_cycles_step_on_numbers(spark, monkeypatch):
    """Titles are shuffled to be numbered, not at every step, and no table is made twice per doubling."""
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(120)]
    hops = {t: f"n{min(i + 1, 59)}" if i < 60 else rng.choice([*nodes[60:], "end"]) for i, t in enumerate(nodes)}  # a tail of 59 into a ring of one, and a random map
    want = {}
    for t in nodes:
        path = [t]
        while path[-1] in hops and hops[path[-1]] not in path:
            path.append(hops[path[-1]])
        if path[-1] in hops:
            ring = path[path.index(hops[path[-1]]) :]
            want[t] = (min(ring), t in ring)
    staged, stage = [], lookup.stage
    monkeypatch.setattr(lookup, "stage", lambda df, name: staged.append([f.dataType.simpleString() for f in df.schema]) or stage(df, name))
    told = lookup.redirect_cycles(spark.createDataFrame([*hops.items(), ("x", None)], "title string, target string"))
    assert {r["title"]: (r["cycle"], r["member"]) for r in told.collect()} == want and want
    assert sum("string" in types for types in staged) == 1 and len(staged) <= 11


def test_headings_are_found_once(spark):
    """What a section asks of its headings, and a cut of its lines, is worked out once, not once more per heading."""
    text = "\n".join(["{| x", "|}", *(f"=== {i} ===\nbody {i}" for i in range(200))])
    df = spark.createDataFrame([(text,)], "s string")
    made = df.select(sections.subsections(F.col("s")).alias("p"))
    assert [(p["title"], p["subsection_wikitext"]) for p in made.first()["p"]] == [("Phim", "{| x\n|}"), *((str(i), f"body {i}") for i in range(200))]
    said = lambda df, word: df._jdf.queryExecution().analyzed().toString().count(word)
    assert said(made, "split(") == 1
    lines = F.split("s", "\n")
    told = df.select(sections.section(lines, sections.headings_of(lines), ["a"], ["b"]).alias("x"))
    assert said(told, "lower(") == 2
