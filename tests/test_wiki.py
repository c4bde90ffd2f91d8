"""Pages, redirects, sections, crawl, records, graph: one small case per rule."""

from conftest import SMALL
from pyspark.sql import functions as F

from filmweave.operators import cast, crawl, graph, infobox, lookup, network, predicates, records, sections, tables
from filmweave.plans import queries
from filmweave.sources import sinks, store as store_module, wiki
from filmweave.sources.store import PageStore
from filmweave.streaming.pages import fact_stream

DUMP = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/"><page><title>A</title><revision><text> x </text></revision></page>
<page><title>B</title><revision><text/></revision></page><page><title>C</title><revision></revision></page>
<page><title></title><revision><text>none</text></revision></page><page><title>A</title><revision><text>{{Infobox film|a=b}}</text></revision></page></mediawiki>"""


def facts(spark, **pages):
    return infobox.page_facts(spark.createDataFrame([(k.replace("_", " "), v) for k, v in pages.items()], "title string, text string"))


def test_sources(spark, tmp_path):
    (tmp_path / "dump.xml").write_text(DUMP)
    (tmp_path / "seeds.txt").write_text(" A \n\n B", encoding="utf-8")
    pages = wiki.read_pages(spark, str(tmp_path / "dump.xml"))
    assert [r["text"] for r in pages.collect()] == [" x ", None, "", "none", "{{Infobox film|a=b}}"]
    assert {r["title"]: r["text"] for r in wiki.page_index(pages).collect()} == {"A": "{{Infobox film|a=b}}", "B": None, "C": ""}
    assert [r[0] for r in wiki.read_seeds(spark, str(tmp_path / "seeds.txt")).collect()] == ["A", "B"]
    assert wiki.first_lines(spark, str(tmp_path / "dump.xml"), 2).count() == 2
    assert [r["text"] for r in wiki.preview(pages, 1, 2).collect()] == [" x"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("é", 1)], ["a", "b"])
    assert sinks.records(df) == ([{"a": "é", "b": 1}], ["a", "b"])
    assert "é" in spark.read.text(sinks.save_json(df, str(tmp_path), "j")).first()[0]
    assert spark.read.text(sinks.save_text(df.select("a"), str(tmp_path), auto=True)).first()[0] == "é"
    assert "\n" in sinks.pretty_json(df).first()[0]
    assert len(sinks.stamp_name(spark)) == 19


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "dump.xml").write_text(DUMP)
    q = fact_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("facts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["kind"] for r in spark.table("facts").where("title = 'A'").collect()} == {"", "film"}


def test_redirects(spark):
    rows = [("a", "#redirect [[ b ]]"), ("b", "#đổi [[c]]"), ("c", "end"), ("d", "#REDIRECT [[c]]"), ("e", "#redirect nothing"), ("f", "#redirect [[gone]]"), ("g", "#redirect [[h]]"), ("h", "#redirect [[g]]"), ("i", None)]
    pages = spark.createDataFrame(rows, "title string, text string")
    got = {r["title"]: (r["text"], r["redirect_status"]) for r in lookup.resolved_pages(pages).collect()}
    assert got["a"] == ("end", "resolved") and got["b"] == ("end", "resolved") and got["c"] == ("end", "direct")
    assert got["d"] == ("#REDIRECT [[c]]", "direct") and got["e"] == ("#redirect nothing", "direct")
    assert got["f"] == ("", "dangling") and got["g"][1] == got["h"][1] == "too_deep" and got["i"] == (None, "direct")
    assert {r["title"]: r["text"] for r in lookup.resolved_pages(pages, any_case=True).collect()}["d"] == "end"
    assert lookup.lookup(spark.createDataFrame([("zz",)], ["title"]), pages).first()["text"] == ""


def test_infobox_merges_and_kinds(spark):
    got = {r["title"]: r for r in facts(spark, a="{{Infobox person|k=1|e=}}{{Phim x|k={{vie}}|2}}", b="{{Infobox film|x=1}}{{Infobox person|y=2}}", c="text", d="", e="{{a|<!--|z=1-->b=[[c|d]]}}").collect()}
    assert got["a"]["infobox"] == {"k": "{{vie}}", "1": "2"} and got["a"]["kind"] == "person"
    assert got["b"]["kind"] == "film" and got["c"]["kind"] == "" and got["d"]["kind"] is None
    assert got["e"]["templates"][0]["params"][0]["v"] == "[[c|d]]"


def test_director_field(spark):
    got = {r["title"]: (r["director"], r["director_status"]) for r in facts(spark, a="{{phim|Director=[[X|y]], [[Z]]}}", b="{{phim|đạo diễn=plain|director=[[X]]}}", c="{{phim|a=b}}").collect()}
    assert got == {"a": (["X", "Z"], "linked"), "b": (None, infobox.NO_LINK), "c": (None, "no field")}


def test_persons_and_films(spark):
    told = facts(spark, a="{{nghệ sĩ|Quốc tịch=Mỹ|x=việt nam}}", b="{{nghệ sĩ|x=Việt Nam}}", c="{{nghệ sĩ|x=y}} là người Việt", d="{{nghệ sĩ|x=y}}", e="{{phim|country=VNM}}", f="{{phim|a=b}}", g="{{phim|quốc gia={{VIE}}}}")
    strict = predicates.vn_person(F.col("title"), F.col("kind"), F.col("infobox"), F.col("templates"), F.col("text"))
    status = predicates.vn_film_status(F.col("title"), F.col("kind"), F.col("infobox"))
    got = {r["title"]: (r["p"], r["f"], r["k"]) for r in told.select("title", strict.alias("p"), status.alias("f"), predicates.keeps_film(status).alias("k")).collect()}
    assert [got[x][0] for x in "abcd"] == [False, True, True, False]
    assert [got[x][1] for x in "aefg"] == [None, "not_vn", "unknown", "vn"] and [got[x][2] for x in "aefg"] == [False, False, True, True]


def test_sections_follow_main_pages(spark):
    star = "{{nghệ sĩ|nghề nghiệp=diễn viên}}\n"
    chain = {f"n{i}": f"== Phim ==\n{{{{Main|n{i + 1}}}}}" for i in range(5)}
    told = sections.page_sections(facts(spark, a=star + "== Phim ==\n{{chính|b}}", b="== Film ==\nfound\n== z ==", c=star + "== Phim ==\n{{chính|zz}} own", d=star + "== Phim ==\n{{main|n0}}", e="{{phim|a=b}}", **chain))
    got = {r["title"]: r["film_part"] for r in sections.film_sections(told).collect()}
    assert got["a"] == "found" and got["c"] == "{{chính|zz}} own" and got["d"] == "" and got["e"] == sections.FROM_FILM and got["b"] == sections.NO_FILM_PERSON
    parts = spark.createDataFrame([("{|x\n|}\n=== A ===\n{|\n==== B ====\n=== C ===\nz",), ("no {| table",), ("none",)], ["s"]).select(sections.subsections(F.col("s")).alias("x")).collect()
    assert [[tuple(y) for y in r["x"]] for r in parts] == [[("Phim", "{|x\n|}"), ("A", "{|\n==== B ===="), ("C", "z")], [("Phim", "no {| table")], []]


def test_film_rows(spark):
    body = "{|\n!Năm!!Tựa đề\n|-\n|2001||[[f]]\n|-\n|2002||[[g]]\n|}"
    parts = spark.createDataFrame([("p", f"=== T ===\nold\n=== U ===\n{body}\n=== T ===\n{body}"), ("q", "=== T ===\n{|\n!x\n|}")], "title string, film_part string")
    rows = tables.film_rows(parts)
    assert rows.where("error is not null").select("title").collect()[0][0] == "q"
    kept = tables.vn_film_rows(rows, facts(spark, f="{{phim|quốc gia=Việt Nam}}", g="{{phim|quốc gia=Mỹ}}")).withColumn("film", tables.row_title(tables.SEED_WORDS))
    assert sorted((r["title"], r["type_film"], r["film"]) for r in kept.collect()) == [("p", "T", "f"), ("p", "U", "f")]


def test_casts_by_form(spark):
    parts = spark.createDataFrame([("t", "{|\n|-\n|''R''\n|[[Aa]]\n|}"), ("l", "{{cast list|\n* [[Bb]] vai ''S''}}"), ("p", "* [[Cc]] vai T:"), ("n", None)], "film string, cast_part string")
    got = {r["film"]: ([tuple(a) for a in r["actors"] or []], r["nested"]) for r in cast.film_casts(parts).collect()}
    assert got["t"] == ([("Aa", "R")], True) and got["l"] == ([("Bb", "S")], False) and got["p"] == ([("Cc", "T")], False) and got["n"][0] == []


def test_crawl(spark):
    films = spark.createDataFrame([("s", "f1"), ("x", "f2"), ("y", "f3")], "name string, film string")
    casts = spark.createDataFrame([("f1", 0, "s", False), ("f1", 1, "x", False), ("f1", 2, "t", True), ("f2", 0, "y", False)], "film string, pos int, actor string, nested boolean")
    seeds = spark.createDataFrame([("s",)], ["name"])
    level = lambda df: {r[0]: r["level"] for r in df.collect()}
    people, works = crawl.crawl(seeds, films, casts)
    assert level(people) == {"s": 0} and level(works) == {"f1": 0}  # every film's first actor is known
    people, works = crawl.crawl(seeds, films, casts, full_frontier=True)
    assert level(people) == {"s": 0, "x": 1, "y": 2} and level(works) == {"f1": 0, "f2": 1, "f3": 2}
    lead = spark.createDataFrame([("f1", "z")], "film string, actor string")
    assert level(crawl.crawl(seeds, films, casts, full_frontier=True, directors=lead)[0])["z"] == 1


def test_records(spark):
    films = spark.createDataFrame([("f", {"Tên phim": "T"}, [("A", None)], True, None), ("g", {}, [("A", "[[B]]")], False, ["{{x|D}}"])], "film string, infobox map<string,string>, actors array<struct<actor_name string, character string>>, nested boolean, director array<string>")
    got = {r["film"]: r for r in records.film_records(films).collect()}
    assert got["f"]["actors"] == [] and got["f"]["infobox"] == {"title": "T"} and got["f"]["director"] == [] and got["f"]["title"] == "f"
    assert [tuple(a) for a in got["g"]["actors"]] == [("A", "B")] and got["g"]["director"] == ["D"] and got["g"]["infobox"] == {}
    assert [tuple(a) for a in {r["film"]: r for r in records.film_records(films, flatten_table_cast=True).collect()}["f"]["actors"]] == [("A", "")]
    assert records.key_map(spark).count() == 39


def test_graph(spark):
    people = spark.createDataFrame([("a", {"education": "", "học vấn": "S"}), ("b", {"education": " S "}), ("c", {}), ("f", {})], "name string, info map<string,string>")
    films = spark.createDataFrame([("f", {}, [(" a ", "x"), ("a", "y"), ("b", "z"), ("no", "q")], ["b", "no"]), ("g", {}, [("a", "w"), ("f", "v")], [])], "film string, infobox map<string,string>, actors array<struct<actor_name string, character string>>, director array<string>")
    nodes = graph.nodes(people, films)
    assert {r["id"]: r["type"] for r in nodes.collect()} == {"a": "person", "b": "person", "c": "person", "f": "film", "g": "film"}
    made = graph.attempts(graph.credits_of(films), graph.names_of(people, films))
    edges = graph.edges(made)
    assert {(r["person"], r["film"]): (r["role"], r["character"]) for r in edges.collect()} == {("a", "f"): ("actor", "y"), ("b", "f"): ("director", "z"), ("a", "g"): ("actor", "w"), ("f", "g"): ("actor", "v")}
    pairs = graph.collaborations(nodes, edges).collect()
    assert [(r["p1"], r["p2"], r["film_count"], r["films"], r["collaboration_types"], r["school"], r["weight"]) for r in pairs] == [("a", "b", 1, ["f"], ["actor-director"], "S", 1.5)]
    assert [r[0] for r in graph.isolated(nodes, graph.collaborations(nodes, edges)).collect()] == ["c"]
    assert {r["measure"]: r["n"] for r in graph.counts(nodes, made, edges, graph.collaborations(nodes, edges)).collect()} == {"nodes": 5, "edges": 4, "actor_credits": 5, "director_credits": 1, "collaboration_nodes": 3, "collaboration_edges": 1}


def test_crawl_of_all_credits(spark):
    rows = [r[:3] for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber").collect()]
    of, cast_of = {}, {}
    for p, f, pos in rows:
        of.setdefault(p, set()).add(f)
        cast_of.setdefault(f, []).append((pos, p))
    for full in (True, False):
        persons = {p: 0 for p in (1, 2)}
        films = {f: 0 for p in persons for f in of.get(p, ())}
        for level in (1, 2, 3):
            if full or any(min(cast_of[f])[1] not in persons for f in films):
                new = {p for f in films for _, p in cast_of[f]} - set(persons)
                persons |= dict.fromkeys(new, level)
                films |= dict.fromkeys({f for p in new for f in of[p]} - set(films), level)
        got = queries.crawl_credits(spark, SMALL, "p_partkey IN (1, 2)", full)
        assert {int(r["name"]): r["level"] for r in got[0].collect()} == persons
        assert {int(r["film"]): r["level"] for r in got[1].collect()} == films and len(films) > 1000


PAGES = {
    "seed": "{{nghệ sĩ|tên=S|nghề nghiệp=Diễn viên}}\n== Phim ==\n{|\n!Năm!!Phim\n|-\n|1||[[f]]\n|-\n|2||[[f alias]]\n|-\n|3||[[foreign]]\n|-\n|4||\n|}",
    "f": "{{Infobox film|tên phim=F|đạo diễn=[[boss]]}}\n== Diễn viên ==\n* [[seed]] vai A.\n* [[new (ca sĩ)]] vai B.",
    "f alias": "#đổi [[f]]",
    "foreign": "{{Infobox film|tên phim=X|quốc gia=Mỹ}}",
    "new (ca sĩ)": "{{nghệ sĩ|nghề nghiệp=Diễn viên}}\n== Phim ==\n{|\n!Năm!!Tên phim!!x\n|-\n|1||[[g]]||y\n|}",
    "g": "{{Infobox film|tên phim=G}}\n== Diễn viên ==\n{|\n|-\n|''R''\n|[[last]]\n|}",
    "boss": "{{nghệ sĩ|nghề nghiệp=nhà làm phim}}",
}


def test_network_options(spark):
    """Each option of the whole run against what it changes on a handful of pages."""
    pages = spark.createDataFrame([*PAGES.items()], "title string, text string")
    seeds = spark.createDataFrame([("seed",)], ["name"])

    def run(**options):
        made = network.build(pages, seeds, **options)
        level = lambda df, c: {r[c]: r["level"] for r in df.collect()}
        return level(made.persons, "name"), level(made.films, "film"), {(r["person"], r["film"]) for r in made.edges.collect()}

    # every film's first actor is the seed: nothing grows; an alias is a film of its own; a foreign film isn't kept
    assert run() == ({"seed": 0}, {"f": 0, "f alias": 0}, {("seed", "f"), ("seed", "f alias")})
    # the cast's name lost its parentheses, so its page isn't found
    people, films, _ = run(full_frontier=True)
    assert people == {"seed": 0, "new ca sĩ": 1} and set(films) == {"f", "f alias"}
    people, films, edges = run(full_frontier=True, keep_parentheses=True, canonicalize=True)
    assert people == {"seed": 0, "new (ca sĩ)": 1} and films == {"f": 0, "g": 1} and ("new (ca sĩ)", "f") in edges
    # casts from tables lead on only if they are flattened, directors only if asked for
    assert "last" in run(full_frontier=True, keep_parentheses=True, flatten_table_cast=True)[0]
    people, _, edges = run(full_frontier=True, directors_lead=True)
    assert people["boss"] == 1 and ("boss", "f") in edges


def test_alone_makes_no_pairs(spark):
    people = spark.createDataFrame([(x, "person", {}) for x in "abcd"] + [("f", "film", {})], "id string, type string, info map<string,string>")
    edges = spark.createDataFrame([("a", "f"), ("b", "f"), ("b", "f"), ("c", "g"), ("c", "g"), ("a", "h"), ("other", "g")], "person string, film string")
    assert sorted(r[0] for r in graph.alone(people, edges).collect()) == ["c", "d"]
    hot = spark.range(100_000).selectExpr("cast(id as string) as person", "'one' as film")
    crowd = hot.selectExpr("person as id", "'person' as type", "cast(map() as map<string,string>) as info").unionByName(people)
    assert graph.alone(crowd, hot).where("name not in ('a', 'b', 'c', 'd')").count() == 0


def test_redirects_of_any_length(spark):
    chain = [(f"c{i}", f"#redirect [[c{i + 1}]]") for i in range(40)] + [("c40", "end")]
    ring = [(f"r{i}", f"#redirect [[r{(i + 1) % 3}]]") for i in range(3)] + [("t1", "#redirect [[t2]]"), ("t2", "#redirect [[r0]]"), ("s", "#redirect [[s]]")]
    got = {r["title"]: tuple(r)[1:] for r in lookup.resolved_pages(spark.createDataFrame(chain + ring, "title string, text string")).collect()}
    assert all(got[f"c{i}"] == ("c40", "end", "resolved") for i in range(40))
    assert all(got[t] == (None, "", "too_deep") for t, _ in ring) and len(got) == 47


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_crawl_parses_only_what_it_reaches(spark):
    """Pages parsed are those that the crawl meets, however many the store holds; a page is parsed once."""
    strangers = [(f"stranger {i}", PAGES["seed"].replace("[[f]]", f"[[odd {i}]]")) for i in range(300)] + [(f"odd {i}", PAGES["f"]) for i in range(300)]
    store = PageStore.write(spark.createDataFrame([*PAGES.items(), *strangers], "title string, text string"))
    made = network.build(store, spark.createDataFrame([("seed",), ("no page",)], ["name"]), full_frontier=True, keep_parentheses=True)
    parsed = [r["title"] for r in made.reader.told().select("title").collect()]
    assert sorted(parsed) == ["f", "foreign", "g", "new (ca sĩ)", "seed"] and made.reader.pages_parsed() == 5
    assert {r["name"] for r in made.persons.collect()} == {"seed", "no page", "new (ca sĩ)"}


def files_of(df):
    """Files that a plan of one scan opens."""
    return {str(f.filePath()) for part in df._jdf.queryExecution().toRdd().partitions() for f in part.files()}


def test_one_title_reads_one_bucket(spark, tmp_path):
    pages = spark.createDataFrame([(f"t{i}", f"text {i}") for i in range(100)] + [(None, "none")], "title string, text string")
    kept = PageStore.write(pages, f"file://{tmp_path}/pages", buckets=8)
    assert len(files_of(kept.one("t7"))) == 1 and len(files_of(kept.table)) == 8 and kept.one("t7").first()["text"] == "text 7"
    few, many = pages.where("title like 't1_'").select("title"), pages.select("title")
    assert kept.read(few).count() == 10 and kept.read(many).count() == 100 and kept.read(many.where("false")) is None
    assert len(files_of(kept.read(few.limit(1)))) == 1
    again = store_module.open_buckets(spark, "title", f"file://{tmp_path}/pages", "title string, text string, target string", 8)
    assert len(files_of(again.where("title = 't9'"))) == 1 and again.count() == 100


def test_many_titles_join_without_moving_pages(spark, monkeypatch):
    monkeypatch.setattr(store_module, "FEW", 3)
    kept = PageStore.write(spark.createDataFrame([(f"t{i}", "x") for i in range(50)], "title string, text string"), buckets=4)
    asked = spark.createDataFrame([(f"t{i}",) for i in range(0, 80, 2)], ["title"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = kept.read(asked)
        assert found.count() == 25
        scan = plan_of(found).split("FileScan parquet")[0].splitlines()
        assert "Exchange" not in scan[-2] + scan[-1], "pages aren't shuffled"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_redirect_cycles(spark):
    ring = [(f"r{i:02}", f"r{(i + 1) % 37:02}") for i in range(37)] + [(f"t{i}", f"t{i + 1}") for i in range(20)] + [("t20", "r05"), ("s", "s"), ("u", "s"), ("a", "b"), ("b", "c")]
    got = {r["title"]: (r["cycle"], r["member"]) for r in lookup.redirect_cycles(spark.createDataFrame(ring, "title string, target string")).collect()}
    want = {f"r{i:02}": ("r00", True) for i in range(37)} | {f"t{i}": ("r00", False) for i in range(21)} | {"s": ("s", True), "u": ("s", False)}
    assert got == want
    assert lookup.redirect_cycles(spark.createDataFrame([("a", "b")], "title string, target string")).count() == 0


def test_pairs_dealt_in_blocks(spark):
    """However small the blocks, every two of a group meet once, in order."""
    rows = [("hot", f"p{i:03}", "xy"[i % 2]) for i in range(60)] + [("cold", "p001", "x"), ("cold", "q", "y"), ("alone", "z", "x")]
    edges = spark.createDataFrame(rows, "film string, person string, role string")
    want = sorted((a[1], b[1], a[0], f"{a[2]}-{b[2]}") for a in rows for b in rows if a[0] == b[0] and a[1] < b[1])
    for block in (5, 7, 1000):
        assert sorted(map(tuple, graph.film_pairs(edges, block).collect())) == want
    placed = graph.film_pairs(edges, 5)
    assert placed.count() == 60 * 59 // 2 + 1


def test_classes_stand_for_pairs(spark):
    people = spark.createDataFrame([(f"a{i}", "S") for i in range(30)] + [("b", "T"), ("c", "T"), ("d", "U"), ("e", None)], "name string, school string")
    classes = {r["school"]: (r["members"], r["pairs"]) for r in graph.shared_classes(people, "school").collect()}
    assert classes == {"S": (30, 435), "T": (2, 1)}
    links = {r["name"]: r["links"] for r in graph.class_membership(people, "school").collect()}
    pairs = [tuple(r) for r in graph.shared_pairs(people, "school", block=4).collect()]
    assert len(pairs) == len(set(pairs)) == 436
    assert links == {n: sum(n in p[:2] for p in pairs) for p in pairs for n in p[:2]}


def test_kept_graph_needs_no_shuffle(spark, tmp_path):
    edges = spark.createDataFrame([(p, f, "actor", None) for p, f in ["af", "bf", "ag", "cg", "bh"]], "person string, film string, role string, character string")
    kept = graph.Adjacency.save(edges, f"file://{tmp_path}/graph", buckets=4)
    films, people = kept.people_of_films(), kept.films_of_people()
    assert "Exchange" not in plan_of(films) and "Exchange" not in plan_of(people)
    assert {r["film"]: r["people"] for r in films.collect()} == {"f": ["a", "b"], "g": ["a", "c"], "h": ["b"]}
    assert {r["person"]: r["films"] for r in people.collect()} == {"a": ["f", "g"], "b": ["f", "h"], "c": ["g"]}
    some = spark.createDataFrame([("f",), ("none",)], ["film"])
    assert sorted(r["person"] for r in kept.credits_in(some).collect()) == ["a", "b"]
    assert kept.credits_by(spark.createDataFrame([], "person string")).count() == 0


def test_errors_are_told_by_person(spark):
    pages = spark.createDataFrame([("a", PAGES["seed"].replace("!Năm!!Phim", "!Phim")), ("b", PAGES["seed"]), ("f", PAGES["f"])], "title string, text string")
    made = network.build(pages, spark.createDataFrame([("a",), ("b",)], ["name"]))
    assert [tuple(r) for r in made.errors.collect()] == [("a", "Phim", "fewer than two columns")]
    assert {r["film"] for r in made.films.collect()} == {"f"}
