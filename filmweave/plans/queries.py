"""Named queries over relational tables, each with the SQL that gives the same rows.

The tables hold no wikitext, so pages are rendered from rows and read back; the
SQL states what was rendered, never how it is read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from filmweave.functions import text as T
from filmweave.operators import cast, crawl, graph, infobox, lookup, network, predicates, records, sections, tables
from filmweave.session import prepare
from filmweave.sources import sinks, store, wiki
from filmweave.staging import shared_dir, spread, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


# -- the credits graph: suppliers are people, parts are films ------------------

PEOPLE = "SELECT s_name AS name, n_name AS school, r_name AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
EDGES = """SELECT s_name AS person, p_name || '#' || p_partkey AS film,
  CASE WHEN bool_or(l_linenumber = 1) THEN 'director' ELSE 'actor' END AS role,
  arg_max('role ' || l_linenumber, l_orderkey * 10 + l_linenumber) FILTER (WHERE l_linenumber <> 1) AS character
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""
PAIRS = f"""WITH person AS ({PEOPLE}), edge AS ({EDGES}),
  shared AS (SELECT a.person AS p1, b.person AS p2, a.film, a.role || '-' || b.role AS kind FROM edge a JOIN edge b ON a.film = b.film AND a.person < b.person),
  work AS (SELECT p1, p2, count(*) AS film_count, string_agg(film, '|' ORDER BY film) AS films, string_agg(DISTINCT kind, '|' ORDER BY kind) AS collaboration_types FROM shared GROUP BY 1, 2),
  alike AS (SELECT a.name AS p1, b.name AS p2, CASE WHEN a.school = b.school THEN a.school END AS school, CASE WHEN a.place = b.place THEN a.place END AS location
    FROM person a JOIN person b ON a.name < b.name AND (a.school = b.school OR a.place = b.place)),
  pair AS (SELECT coalesce(w.p1, s.p1) AS p1, coalesce(w.p2, s.p2) AS p2, coalesce(film_count, 0) AS film_count, coalesce(films, '') AS films,
    coalesce(collaboration_types, '') AS collaboration_types, school IS NOT NULL AS same_school, school, location IS NOT NULL AS same_location, location,
    coalesce(film_count, 0)::DOUBLE + CASE WHEN school IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN location IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END AS weight
    FROM work w FULL JOIN alike s ON w.p1 = s.p1 AND w.p2 = s.p2) """


def persons(spark, d) -> DataFrame:
    home = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    info = F.create_map(F.lit("education"), F.col("n_name"), F.lit("birth_place"), F.col("r_name"))
    return read(spark, d, "supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), info.alias("info"))


FILM = "concat(p_name, '#', p_partkey)"


def works(spark, d) -> DataFrame:
    return read(spark, d, "part").select(F.expr(FILM).alias("film"), F.create_map(F.lit("tên phim"), F.col("p_name")).alias("infobox"))


def credits(spark, d) -> DataFrame:
    """Every line of an order is a credit: first lines direct, later orders come later."""
    line = read(spark, d, "lineitem").join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    role = F.when(F.col("l_linenumber") != 1, F.concat(F.lit("role "), "l_linenumber"))
    return line.select(F.col("s_name").alias("person"), F.expr(FILM).alias("film"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_linenumber") == 1).alias("is_director"), role.alias("character"))


def credits_graph(spark, d):
    """(people, works, credits, edges without characters); the edges are staged, since everything else reads them."""
    people, films = persons(spark, d), works(spark, d)
    made = graph.attempts(credits(spark, d), graph.names_of(people, films))
    return people, films, made, stage(graph.edges(made).drop("character"), "edges")


def pairs_of(spark, d) -> DataFrame:
    people, films, _, all_edges = credits_graph(spark, d)
    return graph.collaborations(graph.nodes(people, films), all_edges)


@query(EDGES)
def bipartite_edges(spark, d):
    people, films = persons(spark, d), works(spark, d)
    return graph.edges(graph.attempts(credits(spark, d), graph.names_of(people, films)))


@query(PAIRS + "SELECT * FROM pair")
def collab_edges(spark, d):
    return pairs_of(spark, d).withColumns({"films": F.array_join("films", "|"), "collaboration_types": F.array_join("collaboration_types", "|")})


@query(PAIRS + "SELECT p1, p2, film_count, weight FROM pair")
def collab_weight(spark, d):
    return pairs_of(spark, d).select("p1", "p2", "film_count", "weight")


@query(f"WITH person AS ({PEOPLE}) SELECT a.name AS p1, b.name AS p2, a.school FROM person a JOIN person b ON a.school = b.school AND a.name < b.name")
def same_school_pairs(spark, d):
    return graph.shared_pairs(graph.people_of(graph.nodes(persons(spark, d), works(spark, d))), "school").select("p1", "p2", "school")


@query(f"WITH person AS ({PEOPLE}) SELECT a.name AS p1, b.name AS p2, a.place FROM person a JOIN person b ON a.place = b.place AND a.name < b.name")
def same_location_pairs(spark, d):
    return graph.shared_pairs(graph.people_of(graph.nodes(persons(spark, d), works(spark, d))), "place").select("p1", "p2", "place")


@query(
    PAIRS
    + """SELECT 'nodes' AS measure, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS n UNION ALL SELECT 'edges', count(*) FROM edge
  UNION ALL SELECT 'actor_credits', count(*) FROM lineitem WHERE l_linenumber <> 1 UNION ALL SELECT 'director_credits', count(*) FROM lineitem WHERE l_linenumber = 1
  UNION ALL SELECT 'collaboration_nodes', count(*) FROM supplier UNION ALL SELECT 'collaboration_edges', count(*) FROM pair"""
)
def node_counts(spark, d):
    people, films, made, all_edges = credits_graph(spark, d)
    all_nodes = graph.nodes(people, films)
    return graph.counts(all_nodes, made, all_edges)


def _alone(spark, d, orders: DataFrame) -> DataFrame:
    edge = read(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_name").alias("person"), F.col("o_orderpriority").alias("film"))
    people = read(spark, d, "customer").select(F.col("c_name").alias("id"), F.lit("person").alias("type"), F.create_map().cast("map<string,string>").alias("info"))
    return graph.alone(people, edge)


@query(
    """WITH e AS (SELECT DISTINCT c_name AS person, o_orderpriority AS film FROM customer JOIN orders ON c_custkey = o_custkey),
  shared AS (SELECT film FROM e GROUP BY film HAVING count(*) > 1)
  SELECT c_name AS name FROM customer WHERE c_name NOT IN (SELECT person FROM e JOIN shared USING (film))"""
)
def isolated_persons(spark, d):
    """Customers without any order's priority in common with anyone."""
    return _alone(spark, d, read(spark, d, "orders"))


# -- crawl, redirects, pages ----------------------------------------------------


#: The crawl's seed list.
SEEDS = "p_partkey < 5"
BFS = f"""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS p, l_orderkey AS f FROM lineitem),
  b AS (SELECT p_partkey AS p, 0 AS level FROM part WHERE {SEEDS} UNION
        SELECT y.p, b.level + 1 FROM b JOIN e x ON b.p = x.p JOIN e y ON x.f = y.f WHERE b.level < 3),
  person AS (SELECT p, min(level) AS level FROM b GROUP BY p) """
#: The default frontier: a level opens only if some known film's first actor isn't known.
BFS_LEADS = (
    f"""WITH e AS (SELECT DISTINCT l_partkey AS p, l_orderkey AS f FROM lineitem), lead AS (SELECT l_orderkey AS f, arg_min(l_partkey, l_linenumber) AS p FROM lineitem GROUP BY 1),
  p0 AS (SELECT p_partkey AS p, 0 AS level FROM part WHERE {SEEDS})"""
    + "".join(
        f""", f{k} AS (SELECT DISTINCT f FROM e JOIN p{k} USING (p)),
  p{k + 1} AS (SELECT * FROM p{k} UNION ALL SELECT DISTINCT p, {k + 1} FROM e JOIN f{k} USING (f) WHERE p NOT IN (SELECT p FROM p{k})
    AND EXISTS (SELECT 1 FROM lead JOIN f{k} USING (f) WHERE lead.p NOT IN (SELECT p FROM p{k})))"""
        for k in range(3)
    )
    + " "
)


def crawl_credits(spark, d, seeds: str = SEEDS, full_frontier: bool = True):
    """The crawl over all credits from the parts that ``seeds`` selects."""
    credit = read(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("name"), F.col("l_orderkey").cast("string").alias("film"), F.col("l_linenumber").alias("pos"))
    start = read(spark, d, "part").where(seeds).select(F.col("p_partkey").cast("string").alias("name"))
    casts = credit.select("film", "pos", F.col("name").alias("actor"), F.lit(False).alias("nested"))
    return crawl.crawl(start, credit.select("name", "film"), casts, full_frontier=full_frontier)


@query(BFS + "SELECT p::VARCHAR AS name, level FROM person")
def bfs_levels(spark, d):
    return crawl_credits(spark, d)[0].select("name", "level")


@query(BFS + "SELECT f::VARCHAR AS film, min(level) AS level FROM person JOIN e ON person.p = e.p GROUP BY 1")
def crawl_films(spark, d):
    return crawl_credits(spark, d)[1].select("film", "level")


@query(BFS_LEADS + "SELECT p::VARCHAR AS name, level FROM p3")
def bfs_levels_leads(spark, d):
    return crawl_credits(spark, d, full_frontier=False)[0].select("name", "level")


@query(
    """WITH RECURSIVE r AS (SELECT o_orderkey AS k, o_orderkey + 1 AS goal, 1 AS hops FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL
    SELECT r.k, r.goal + 1, r.hops + 1 FROM r JOIN orders o ON r.goal = o.o_orderkey WHERE r.goal % 4 <> 3),
  final AS (SELECT k, max(goal) AS goal FROM r GROUP BY k)
  SELECT 'order ' || o_orderkey AS title, 'order ' || o_orderkey AS final_title, 'text of ' || o_orderkey AS text, 'direct' AS redirect_status FROM orders WHERE o_orderkey % 4 = 3
  UNION ALL SELECT 'order ' || k, 'order ' || goal, CASE WHEN o.o_orderkey IS NULL THEN '' ELSE 'text of ' || goal END, CASE WHEN o.o_orderkey IS NULL THEN 'dangling' ELSE 'resolved' END
  FROM final LEFT JOIN orders o ON final.goal = o.o_orderkey"""
)
def redirect_resolve(spark, d):
    text = "case when o_orderkey % 4 = 3 then concat('text of ', o_orderkey) else concat('#redirect [[order ', o_orderkey + 1, ']] {{R}}') end"
    return lookup.resolved_pages(read(spark, d, "orders").select(F.expr("concat('order ', o_orderkey)").alias("title"), F.expr(text).alias("text")))


@query("SELECT user_id::VARCHAR AS title, arg_max(event_type, event_id) AS text FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def page_index(spark, d):
    return wiki.page_index(read(spark, d, "events").select(F.col("user_id").cast("string").alias("title"), F.col("event_type").alias("text"), F.col("event_id").alias("pos")))


HREF = 'href="([^"]*)"'


@query(f"SELECT page_id, generate_subscripts(regexp_extract_all(html, '{HREF}', 1), 1) - 1 AS pos, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href FROM pages")
def page_hrefs(spark, d):
    found = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    return read(spark, d, "pages").select("page_id", F.posexplode(found).alias("pos", "href")).withColumn("pos", F.col("pos").cast("long"))


# -- infoboxes and predicates -----------------------------------------------------


def _customers(spark, d) -> DataFrame:
    text = """concat('{{Thông tin nhân vật\n| tên = ', c_name, '\n| quốc tịch = ', if(n_regionkey = 2, '{{VIE}}', n_name), ' [[', n_name, '|x]]\n| nghề nghiệp = ', c_mktsegment,
      '\n| trống = \n}}\n{{Bảng phim|x}} Bài viết {{nowrap|a}}')"""
    return read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("title"), F.expr(text).alias("text"))


@query(
    """SELECT c_name AS title, c_name AS name, CASE WHEN n_regionkey = 2 THEN '{{VIE}}' ELSE n_name END || ' [[' || n_name || '|x]]' AS nationality,
  c_mktsegment AS occupation, 'x' AS positional, 4 AS fields FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def infobox_roundtrip(spark, d):
    box = infobox.page_facts(_customers(spark, d))
    get = lambda k: F.try_element_at("infobox", F.lit(k))
    return box.select("title", get("tên").alias("name"), get("quốc tịch").alias("nationality"), get("nghề nghiệp").alias("occupation"), get("1").alias("positional"), F.size("infobox").alias("fields"))


@query("SELECT c_name AS title, n_regionkey = 2 OR n_name = 'VIETNAM' AS vn_person FROM customer JOIN nation ON c_nationkey = n_nationkey")
def vn_person_status(spark, d):
    told = infobox.page_facts(_customers(spark, d))
    return told.select("title", predicates.vn_person(F.col("title"), F.col("kind"), F.col("infobox"), F.col("templates"), F.col("text")).alias("vn_person"))


def _parts(spark, d) -> DataFrame:
    text = f"""case p_size % 5 when 0 then concat('{{{{Thông tin phim|tên phim=', p_name, '|Quốc gia=Việt Nam}}}}')
      when 1 then concat('{{{{Infobox film|country=', p_brand, '|ngôn ngữ=Tiếng Việt}}}}') when 2 then '{{{{Infobox television|Ngôn ngữ=[[Tiếng Việt]]}}}}'
      when 3 then concat('{{{{Infobox person|name=', p_name, '}}}}{{{{Infobox film|a=b}}}}') else p_name end"""
    return read(spark, d, "part").select(F.expr(FILM).alias("title"), F.expr(text.replace("{{{{", "{{").replace("}}}}", "}}")).alias("text"))


@query("SELECT p_name || '#' || p_partkey AS title, CASE p_size % 5 WHEN 3 THEN 'person' WHEN 4 THEN '' ELSE 'film' END AS kind FROM part")
def page_kind(spark, d):
    return infobox.page_facts(_parts(spark, d)).select("title", "kind")


@query("SELECT p_name || '#' || p_partkey AS title, CASE p_size % 5 WHEN 0 THEN 'vn' WHEN 1 THEN 'not_vn' WHEN 2 THEN 'vn' END AS vn_status FROM part")
def vn_film_status(spark, d):
    told = infobox.page_facts(_parts(spark, d))
    return told.select("title", predicates.vn_film_status(F.col("title"), F.col("kind"), F.col("infobox")).alias("vn_status"))


_OK = "length({0}) BETWEEN 2 AND 80 AND NOT regexp_matches({0}, '(?i)^(png|nhỏ|dan|phim|gom|co |có )') AND regexp_matches({0}, '[A-Za-zÀ-ſ]')"


@query(f"SELECT p_partkey, {_OK.format('p_name')} AS by_name, {_OK.format("('PHIM ' || p_name)")} AS by_phrase, {_OK.format('p_size::VARCHAR')} AS by_size FROM part")
def name_validity(spark, d):
    return read(spark, d, "part").select(
        "p_partkey", T.plausible_name("p_name").alias("by_name"), T.plausible_name(F.concat(F.lit("PHIM "), "p_name")).alias("by_phrase"), T.plausible_name(F.col("p_size").cast("string")).alias("by_size")
    )


@query(
    """WITH lead AS (SELECT l_partkey, string_agg(s_name, '|' ORDER BY s_name) AS names FROM (SELECT DISTINCT l_partkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1) GROUP BY 1)
  SELECT p_name || '#' || p_partkey AS film, names AS director, CASE WHEN l_partkey IS NULL THEN 'no field' ELSE 'linked' END AS director_status FROM part LEFT JOIN lead ON p_partkey = l_partkey"""
)
def directors_roundtrip(spark, d):
    lead = read(spark, d, "lineitem").where("l_linenumber = 1").join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    lead = lead.groupBy("l_partkey").agg(F.array_sort(F.collect_set("s_name")).alias("names"))
    text = "concat('{{Infobox film|tên phim=', p_name, coalesce(concat('|Đạo diễn=', array_join(transform(names, n -> concat('[[', n, '|', lower(n), ']]')), ', ')), ''), '}}')"
    pages = read(spark, d, "part").join(lead, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.expr(FILM).alias("film"), F.expr(text).alias("text"))
    return infobox.page_facts(pages).select("film", F.array_join("director", "|").alias("director"), "director_status")


# -- sections, tables, casts --------------------------------------------------------


@query(
    """SELECT p_partkey, 0 AS line, 2 AS level, p_brand AS title FROM part UNION ALL SELECT p_partkey, 2, 3, p_name FROM part UNION ALL SELECT p_partkey, 5, 4, p_type FROM part"""
)
def headings(spark, d):
    text = r"concat('==', p_brand, '==\nabc\n  === ', p_name, ' ===  \n== a =\n====\n==== ', p_type, ' ====\r\nend')"
    found = F.explode(sections.headings(F.expr(text)))
    return read(spark, d, "part").select("p_partkey", found.alias("h")).select("p_partkey", "h.line", "h.level", "h.title")


@query(
    """SELECT s_name AS title, CASE s_suppkey % 4 WHEN 3 THEN 'person ko là actor cũng ko là director' ELSE 'film of ' || s_suppkey || chr(10) || '=== 1990 ===' || chr(10) || 'more' END AS film_part FROM supplier
  UNION ALL SELECT 'list of ' || s_suppkey, 'person ko là actor cũng ko là director' FROM supplier"""
)
def film_section(spark, d):
    body = r"concat('film of ', s_suppkey, '\n=== 1990 ===\nmore')"
    box = "{{Thông tin nghệ sĩ|nghề nghiệp=Diễn viên}}"
    text = rf"""case s_suppkey % 4 when 0 then concat('{box}\n== Sự nghiệp ==\nx\n== Phim ==\n', {body}, '\n\n== Khác ==\ny')
      when 1 then concat('{box}\n== Danh sách phim ==\n{{{{Chính|list of ', s_suppkey, '}}}}\n== Khác ==')
      when 2 then concat('{box}\n== Sự nghiệp ==\nold\n== Sự nghiệp sau ==\n', {body}) else 'no box' end"""
    own = read(spark, d, "supplier").select(F.col("s_name").alias("title"), F.expr(text).alias("text"))
    lists = read(spark, d, "supplier").select(F.expr("concat('list of ', s_suppkey)").alias("title"), F.expr(rf"concat('== Điện ảnh ==\n', {body}, '\n')").alias("text"))
    return sections.film_sections(sections.page_sections(infobox.page_facts(own.unionByName(lists))))


@query("SELECT r_name AS region, n_name AS title, 'nation ' || n_nationkey AS subsection_wikitext FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'Phim', '{| x' || chr(10) || '|}' FROM region")
def film_subsections(spark, d):
    nations = read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.expr(r"concat('=== ', n_name, ' ===\n', 'nation ', n_nationkey, '\n')"))).alias("parts"))
    section = F.concat(F.lit("{| x\n|}\n"), F.array_join("parts", ""))
    rows = read(spark, d, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select(F.col("r_name").alias("region"), F.explode(sections.subsections(section)).alias("s")).select("region", "s.title", "s.subsection_wikitext")


@query(
    """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey || '|p', l_returnflag, l_linestatus) - 1 AS row_no, l_orderkey::VARCHAR AS key, 'part ' || l_partkey AS part, l_returnflag AS flag, l_linestatus AS status FROM lineitem"""
)
def wikitable_roundtrip(spark, d):
    """Orders as tables whose first cell spans all rows; the part is a link, flag and status share a line."""
    line = F.expr(r"concat('| [[part ', l_partkey, '|p]]\n| ', l_returnflag, ' || ''''', l_linestatus, '''''\n')")
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("s")))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: r["s"]), "|-\n")
    start = F.expr(r"concat('{| class=\"wikitable\"\n! key !! part !! flag !! status\n|-\n| rowspan=\"', size(x), '\" | ', l_orderkey, '\n')".replace(" !! ", "!!").replace("! key", "!key"))
    parts = rows.select(F.col("l_orderkey").cast("string").alias("title"), F.lit(0).alias("section_no"), F.lit("Phim").alias("section"), F.concat(start, body, F.lit("|}\n| after")).alias("wikitext"))
    cell = lambda k: F.element_at("cells", k)
    return tables.table_rows(parts).select(F.col("title").cast("long").alias("l_orderkey"), F.col("row_no").cast("long").alias("row_no"), cell("key").alias("key"), cell("part").alias("part"), cell("flag").alias("flag"), cell("status").alias("status"))


@query("SELECT p_partkey, CASE WHEN p_size > 1 THEN p_size ELSE 1 END AS rowspan, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1 END AS colspan, p_name AS data FROM part")
def cell_spans(spark, d):
    token = "concat('rowspan=\"', p_size, '\" ', if(p_size % 2 = 0, 'colspan=\"\" ', ''), '| ', p_name)"
    return read(spark, d, "part").select("p_partkey", T.span(F.expr(token)).alias("s")).select("p_partkey", "s.rowspan", "s.colspan", "s.data")


CREDITS = "SELECT DISTINCT p_name || '#' || p_partkey AS film, s_name AS actor_name, 'role ' || l_linenumber AS character FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"


def _casts(spark, d, item: str, before: str, after: str) -> DataFrame:
    """Cast sections rendered from credits and read back as (film, actor_name, character)."""
    credit = read(spark, d, "lineitem").join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    items = credit.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set(F.expr(item))), "").alias("items"))
    body = F.concat(F.lit(f"{{{{Infobox film|tên phim=x}}}}\n== Diễn viên ==\n{before}"), "items", F.lit(f"{after}\n== Khác ==\n* [[Ai]] vai Khác:"))
    pages = items.join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.expr(FILM).alias("title"), body.alias("text"))
    said = sections.page_sections(infobox.page_facts(spread(pages, "title"))).select("title", "infobox", "cast_part", "cast_hop", (F.col("text") != "").alias("full"))
    # staged, since pages with and without a hop are two reads, and a box is asked often
    told = sections.cast_sections(stage(said, "cast-pages"))
    # an inner explode would have its array worked out once more, to filter by its size
    return cast.film_casts(told).select(F.col("title").alias("film"), F.explode_outer("actors").alias("a")).where("a is not null").select("film", "a.actor_name", "a.character")


@query(CREDITS)
def cast_list_roundtrip(spark, d):
    return _casts(spark, d, r"concat('* [[', s_name, '|x]] vai ''''role ', l_linenumber, '''''<ref>a</ref>\n')", "{{cast list|\\n".replace("\\n", "\n"), "}}")


@query(CREDITS)
def cast_text_roundtrip(spark, d):
    return _casts(spark, d, r"concat('* [[', s_name, '|x]] <ref name=\"a\">vai b</ref> vai role ', l_linenumber, ': text\n')", "", "")


@query(CREDITS)
def cast_table_roundtrip(spark, d):
    return _casts(spark, d, r"concat('|-\n|''''role ', l_linenumber, '''''\n| [[', s_name, '|x]]\n')", "{|\n! a !! b\n", "|}")


# -- records ---------------------------------------------------------------------------


@query("SELECT p_partkey, p_name || ', ' || p_type || ' ' || p_brand || ', ' || p_size || 'm, a, b, Việt Nam (c)' AS cleaned FROM part")
def clean_text(spark, d):
    marked = r"""concat('[[', p_name, ']]<br/>[[x|', p_type, ']]  <b>', p_brand, '</b><ref>no</ref>, , {{convert|', p_size, '|cm}}, {{hlist|a|[[y|b]]}}<br />{{VIE}} {{small|c}}<!-- z -->{{cite|q}}, ')"""
    return read(spark, d, "part").select("p_partkey", T.clean_text(F.expr(marked)).alias("cleaned"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS birth_date, strftime(o_orderdate, '%Y-%m-%d') AS from_params FROM orders")
def birth_date(spark, d):
    parts = "year(o_orderdate), '|', month(o_orderdate), '|', day(o_orderdate)"
    marked = F.expr(f"concat('{{{{Ngày sinh và tuổi|', {parts}, '}}}}')")
    return read(spark, d, "orders").select("o_orderkey", T.clean_text(marked).alias("birth_date"), T.birth_date(F.split(F.expr(f"concat({parts})"), r"\|")).alias("from_params"))


@query("SELECT s_name AS name, 'born ' || n_name AS birth_place, 'acts' AS occupation, s_name AS real_name, 3 AS fields FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def person_fields(spark, d):
    box = """map('nơi sinh', concat('[[a|born]] ', n_name), 'công việc', 'sings', 'occupation', '''acts''', 'nghề nghiệp', '<br>', 'signature', 'x', 'name', concat('[[', s_name, ']]'))"""
    people = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), F.expr(box.replace("'''acts'''", "'acts'")).alias("info"))
    get = lambda k: F.try_element_at("info", F.lit(k))
    return records.person_records(people).select("name", get("birth_place").alias("birth_place"), get("occupation").alias("occupation"), get("name").alias("real_name"), F.size("info").alias("fields"))


@query(
    """SELECT p_name || '#' || p_partkey AS film, p_name AS title, p_type AS genre, p_brand AS other, 3 AS fields, 'A' AS actor, p_brand AS character, 'B, C' AS director FROM part"""
)
def film_fields(spark, d):
    box = "map('TÊN PHIM', p_name, 'Thể loại', concat('{{hlist|', p_type, '}}'), 'Hãng', p_brand, 'hình', 'x', 'năm', '{{cite|1}}')"
    actors = F.array(F.struct(F.lit("A").alias("actor_name"), F.expr("concat('[[', p_brand, ']]')").alias("character")))
    works = read(spark, d, "part").select(F.expr(FILM).alias("film"), F.expr(box).alias("infobox"), actors.alias("actors"), F.array(F.lit("[[B]]"), F.lit(""), F.lit("C")).alias("director"))
    get = lambda k: F.try_element_at("infobox", F.lit(k))
    return records.film_records(works).select(
        "film", get("title").alias("title"), get("genre").alias("genre"), get("Hãng").alias("other"), F.size("infobox").alias("fields"),
        F.get("actors", 0)["actor_name"].alias("actor"), F.get("actors", 0)["character"].alias("character"), F.array_join("director", ", ").alias("director"),
    )


@query("SELECT l_orderkey, string_agg(f, ',' ORDER BY place, f) AS flags FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS f, min(l_linenumber) AS place FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def unique_ordered(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("f")))).alias("x"))
    return rows.select("l_orderkey", F.array_join(sections.ordered_distinct(F.transform("x", lambda r: r["f"])), ",").alias("flags"))


# -- reading and writing ----------------------------------------------------------------


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/queries/{uuid.uuid4().hex}"


@query("SELECT s_name AS seed FROM supplier")
def seeds_read(spark, d):
    """A seed list with blank lines and blanks around the names."""
    path = _folder(spark)
    read(spark, d, "supplier").select(F.explode(F.array(F.concat(F.lit("  "), "s_name", F.lit("\t")), F.lit(" "))).alias("value")).write.text(path)
    return wiki.read_seeds(spark, path)


@query("SELECT p_name || '#' || p_partkey AS title, CASE p_size % 3 WHEN 0 THEN ' ' || p_type || chr(10) || p_brand WHEN 2 THEN '' END AS text FROM part")
def dump_pages(spark, d):
    """A dump with full, empty (null) and missing ('') texts."""
    path = _folder(spark)
    body = r"case p_size % 3 when 0 then concat('<text> ', p_type, '\n', p_brand, '</text>') when 1 then '<text/>' else '' end"
    line = F.expr(f"concat('<page><title>', {FILM}, '</title><revision>', {body}, '</revision></page>')")
    pages = read(spark, d, "part").select(line.alias("value"), F.lit(1).alias("at"))
    root = spark.createDataFrame([("<mediawiki>", 0), ("</mediawiki>", 2)], "value string, at int")
    pages.unionByName(root).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)  # a dump is one file with one root
    return wiki.read_pages(spark, path).select("title", "text")


@query("SELECT 'line' AS what, n_name AS said FROM nation WHERE n_nationkey < 4 UNION ALL SELECT 'preview', substring(repeat(n_name, 90), 1, 300) FROM nation WHERE n_nationkey < 3")
def first_looks(spark, d):
    """The first raw lines of a file, and the start of the first pages."""
    path, nations = _folder(spark), read(spark, d, "nation").orderBy("n_nationkey")
    nations.select("n_name").coalesce(1).write.text(path)
    pages = nations.select(F.col("n_name").alias("title"), F.repeat("n_name", F.lit(90)).alias("text"))
    lines = wiki.first_lines(spark, path, 4).select(F.lit("line").alias("what"), F.col("value").alias("said"))
    return lines.unionByName(wiki.preview(pages, 3).select(F.lit("preview").alias("what"), F.col("text").alias("said")))


@query("SELECT sink, n_name AS name FROM nation, (VALUES ('json'), ('pretty'), ('records'), ('text')) AS t(sink) UNION ALL SELECT 'stamp', 'dd-MM-yyyy_HH-mm-ss'")
def sinks_roundtrip(spark, d):
    """Names written by every sink and read back, and the form of an automatic file name."""
    names = read(spark, d, "nation").select(F.col("n_name").alias("name"))
    folder = _folder(spark)
    told = lambda df, sink: df.select(F.lit(sink).alias("sink"), F.col("name"))
    text = told(spark.read.text(sinks.save_text(names, folder, "text")).withColumnRenamed("value", "name"), "text")
    json = told(spark.read.schema("name string").json(sinks.save_json(names, folder, auto=True)), "json")
    pretty = told(sinks.pretty_json(names).select(F.get_json_object("json", "$.name").alias("name")), "pretty")
    rows, columns = sinks.records(names)
    kept = told(spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], "name string"), "records")
    stamp = spark.createDataFrame([("stamp", sinks.STAMP if re.fullmatch(r"\d\d-\d\d-\d{4}_\d\d-\d\d-\d\d", sinks.stamp_name(spark)) else "")], "sink string, name string")
    return text.unionByName(json).unionByName(pretty).unionByName(kept).unionByName(stamp)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS text FROM lineitem JOIN part ON l_partkey = p_partkey")
def title_lookup(spark, d):
    """Texts by title; titles without a page read ''."""
    pages = read(spark, d, "part").where("p_size % 2 = 0").select(F.col("p_partkey").cast("string").alias("title"), F.col("p_name").alias("text"))
    asked = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("title"))
    return lookup.lookup(asked, pages).drop("title")


# -- more of boxes, tables and scalars --------------------------------------------------


@query("SELECT p_partkey, p_name || ', Việt Nam' AS made, '1990-0' || (p_size % 9 + 1) || '-07' AS born, p_type || ', x' AS said FROM part")
def infobox_display(spark, d):
    """Infobox values as they are shown: labels, countries, dates, no markup."""
    entry = """map('made', concat('[[x|', p_name, ']], {{VIE}}{{z}}'), 'born', concat('{{birth date|1990|', p_size % 9 + 1, '|7}}'), 'said', concat("'''", p_type, "'''<br/>x<ref>q</ref>"))"""
    boxes = infobox.clean_infoboxes(read(spark, d, "part").select(F.col("p_partkey").alias("title"), F.expr(entry).alias("infobox")))
    get = lambda k: F.try_element_at("infobox", F.lit(k)).alias(k)
    return boxes.select(F.col("title").alias("p_partkey"), get("made"), get("born"), get("said"))


@query(
    """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'vn' WHEN 1 THEN 'not_vn' ELSE 'unknown' END AS status, p_size % 3 <> 1 AS kept, 'đạo diễn không có wikilink' AS director_status FROM part"""
)
def film_without_country(spark, d):
    """Films by country, else by language; without either they may count; a director without a link."""
    told = "case p_size % 3 when 0 then '|language=Tiếng Việt' when 1 then '|country=Mỹ|language=tiếng Việt' else '|language=Pháp' end"
    pages = read(spark, d, "part").select("p_partkey", F.expr(FILM).alias("title"), F.expr(f"concat('{{{{Infobox film|director=', p_brand, {told}, '}}}}')").alias("text"))
    status = predicates.vn_film_status(F.col("title"), F.col("kind"), F.col("infobox"))
    return infobox.page_facts(pages).select("p_partkey", status.alias("status"), predicates.keeps_film(status).alias("kept"), "director_status")


@query("SELECT p_partkey, (length(p_name) + 14)::INTEGER AS pipe, -1 AS none, p_name || ' (' || (1950 + p_size) || ')' AS spouse, p_size || 'm' AS height, p_brand AS bare FROM part")
def scalar_readings(spark, d):
    """The first pipe outside links and templates, marriages, heights, names without apostrophes."""
    text = "concat('[[a|b]]{{c|d}}', p_name, '|rest')"
    marriage = "concat('{{marriage|[[', p_name, ']]|cưới ', 1950 + p_size, '}}')"
    return read(spark, d, "part").select(
        "p_partkey", tables.first_pipe(F.expr(text)).alias("pipe"), tables.first_pipe(F.expr("concat('[[', p_name, '|x]]')")).alias("none"), T.clean_text(F.expr(marriage)).alias("spouse"),
        T.height(F.expr("array('ft=5', concat('cm=', p_size))")).alias("height"), T.without_marks(F.expr("concat(' \\'', p_brand, '\\' ')")).alias("bare"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, 'o' || l_orderkey AS a, l_returnflag AS b, 'p' || l_partkey AS c, 'p' || l_partkey AS d FROM lineitem WHERE l_linenumber % 2 = 1
  UNION ALL SELECT l_orderkey, l_linenumber, 'o' || l_orderkey, l_returnflag, l_linestatus, 'q' || l_partkey FROM lineitem WHERE l_linenumber % 2 = 0"""
)
def wide_table_roundtrip(spark, d):
    """A table of two header rows: one cell spans all rows, another header spans two columns, and so do cells of every other row."""
    cells = "if(l_linenumber % 2 = 1, concat('| colspan=\"2\" | p', l_partkey), concat('| ', l_linestatus, ' || q', l_partkey))"
    line = F.expr(rf"concat('| ', l_returnflag, '\n', {cells}, '\n')")
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("s"), "l_partkey"))).alias("x"))
    head = r"""concat('{| class="wikitable"\n! rowspan="2" | a\n! rowspan="2" | b\n! colspan="2" | z\n|-\n! c\n! d\n|-\n| rowspan="', size(x), '" | o', l_orderkey, '\n')"""
    body = F.array_join(F.transform("x", lambda r: r["s"]), "|-\n")
    text = lines.select(F.col("l_orderkey").cast("string").alias("title"), F.transform("x", lambda r: r["l_linenumber"]).alias("numbers"), F.concat(F.expr(head), body, F.lit("|}")).alias("wikitext"))
    rows = tables.table_rows(text.select("title", F.lit(0).alias("section_no"), F.lit("Phim").alias("section"), "wikitext", "numbers"))
    get = lambda k: F.element_at("cells", k).alias(k)
    return rows.select(F.col("title").cast("long").alias("l_orderkey"), F.get("numbers", F.col("row_no")).alias("l_linenumber"), get("a"), get("b"), get("c"), get("d"))


# -- the whole run: pages rendered from credits, crawled from a seed list -----------------

SEED_PEOPLE = "s_nationkey < 3"


def network_pages(spark, d) -> DataFrame:
    """Parts as film pages with a cast, suppliers as people with a table of the parts of their first lines, aliases of people."""
    credit = read(spark, d, "lineitem").join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    roles = credit.groupBy("l_partkey", "s_name").agg(F.min("l_linenumber").alias("n")).groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("s_name", "n"))).alias("x"))
    country = "case p_size % 3 when 0 then '|quốc gia=Việt Nam' when 1 then '|quốc gia=Mỹ' else '' end"
    cast_items = r"array_join(transform(x, c -> concat('* [[', c.s_name, '|z]] vai role ', c.n, '.\n')), '')"
    film_text = rf"concat('{{{{Infobox film|tên phim=', p_name, {country}, '}}}}\n== Diễn viên ==\n', coalesce({cast_items}, ''), '== Khác ==\n')"
    film_pages = read(spark, d, "part").join(roles, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.expr(FILM).alias("title"), F.expr(film_text).alias("text"))
    listed = credit.where("l_linenumber = 1").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("s_suppkey").agg(F.sort_array(F.collect_set(F.expr(FILM))).alias("y"))
    home = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = read(spark, d, "supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey")).join(listed, "s_suppkey", "left")
    column = "case s_suppkey % 3 when 0 then 'Tựa đề' when 1 then 'Tên phim' else 'Phim' end"
    rows = r"array_join(transform(y, f -> concat('|-\n|1990||[[', f, ']]\n')), '')"
    person_text = rf"concat('{{{{Thông tin nghệ sĩ|tên=', s_name, '|nghề nghiệp=Diễn viên|học vấn=[[', n_name, ']]|nơi sinh=', r_name, '}}}}\n== Phim ==\n{{|\n!Năm!!', {column}, '\n', coalesce({rows}, ''), '|}}\n')"
    person_pages = people.select(F.col("s_name").alias("title"), F.expr(person_text).alias("text"))
    aliases = read(spark, d, "supplier").select(F.expr("concat('alias ', s_suppkey)").alias("title"), F.expr("concat('#đổi [[', s_name, ']]')").alias("text"))
    return film_pages.unionByName(person_pages).unionByName(aliases)


NETWORK = (
    f"""WITH kept AS (SELECT p_partkey AS p, p_name || '#' || p_partkey AS film, p_size FROM part WHERE p_size % 3 <> 1),
  listed AS (SELECT DISTINCT s_name AS name, s_suppkey % 3 AS kind, film FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN kept ON l_partkey = p WHERE l_linenumber = 1),
  played AS (SELECT DISTINCT film, s_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN kept ON l_partkey = p),
  lead AS (SELECT film, min(name) AS name FROM played GROUP BY 1),
  p0 AS (SELECT s_name AS name, 0 AS level FROM supplier WHERE {SEED_PEOPLE}),
  f0 AS (SELECT DISTINCT film, 0 AS level FROM listed JOIN p0 USING (name))"""
    + "".join(
        f""", p{k + 1} AS (SELECT * FROM p{k} UNION ALL SELECT DISTINCT name, {k + 1} FROM played JOIN f{k} USING (film) WHERE name NOT IN (SELECT name FROM p{k})
    AND EXISTS (SELECT 1 FROM lead JOIN f{k} USING (film) WHERE lead.name NOT IN (SELECT name FROM p{k}))),
  f{k + 1} AS (SELECT * FROM f{k} UNION ALL SELECT DISTINCT film, {k + 1} FROM listed JOIN p{k + 1} USING (name) WHERE p{k + 1}.level = {k + 1} AND kind < 2 AND film NOT IN (SELECT film FROM f{k}))"""
        for k in range(3)
    )
    + """, edge AS (SELECT film, name FROM played WHERE film IN (SELECT film FROM f3) AND name IN (SELECT name FROM p3)) """
)


def _network(spark, d):
    seeds = read(spark, d, "supplier").where(SEED_PEOPLE).select(F.col("s_name").alias("name"))
    return network.build(network_pages(spark, d), seeds)


@query(
    NETWORK
    + """SELECT p3.name AS id, 'person' AS type, level, n_name AS school, r_name AS place, NULL AS country, (SELECT count(*) FROM edge WHERE edge.name = p3.name) AS degree,
    (SELECT count(*) FROM listed WHERE listed.name = p3.name AND (p3.level = 0 OR kind < 2)) AS listed
  FROM p3 JOIN supplier ON p3.name = s_name JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT f3.film, 'film', level, NULL, NULL, CASE WHEN p_size % 3 = 0 THEN 'Việt Nam' END, (SELECT count(*) FROM edge WHERE edge.film = f3.film), 0 FROM f3 JOIN kept USING (film)"""
)
def network_nodes(spark, d):
    """Every node of the whole run, from wikitext to records: level, fields, and number of edges."""
    made = _network(spark, d)
    edges = stage(made.edges, "network-edges")
    degree = edges.groupBy(F.col("person").alias("id")).count().unionByName(edges.groupBy(F.col("film").alias("id")).count())
    levels = made.persons.select(F.col("name").alias("id"), "level", F.size("films").cast("long").alias("listed")).unionByName(made.films.select(F.col("film").alias("id"), "level", F.lit(0).cast("long").alias("listed")))
    nodes = made.nodes.join(levels, "id").join(degree, "id", "left")
    get = lambda c, k: F.try_element_at(c, F.lit(k))
    return nodes.select("id", "type", "level", get("info", "education").alias("school"), get("info", "birth_place").alias("place"), get("infobox", "country").alias("country"), F.coalesce("count", F.lit(0)).alias("degree"), "listed")


@query(NETWORK + "SELECT edge.film, string_agg(edge.name, '|' ORDER BY edge.name) AS people, count(*) AS n FROM edge GROUP BY 1")
def film_neighbours(spark, d):
    """Who is credited in each film of the whole run; the graph is kept from both ends and read again."""
    kept = graph.Adjacency.save(_network(spark, d).edges, _folder(spark))
    return kept.people_of_films().select("film", F.array_join("people", "|").alias("people"), F.size("people").cast("long").alias("n"))


@query(f"WITH edge AS ({EDGES}) SELECT person, count(*) AS n, min(film) AS first_film, max(film) AS last_film FROM edge GROUP BY 1")
def person_neighbours(spark, d):
    """Each person's films, from the graph kept by person."""
    kept = graph.Adjacency.save(bipartite_edges(spark, d), _folder(spark))
    return kept.films_of_people().select("person", F.size("films").cast("long").alias("n"), F.get("films", 0).alias("first_film"), F.element_at("films", -1).alias("last_film"))


@query(
    """WITH line AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN 'fewer than two columns' END AS error FROM supplier)
  SELECT s_name AS name, 'Phim ' || s_suppkey AS section, error FROM line WHERE error IS NOT NULL"""
)
def table_errors(spark, d):
    """What the whole run couldn't read: people whose film table has one column, told beside the network that was built without them."""
    head = "if(s_suppkey % 4 = 0, '!Phim', '!Năm!!Phim')"
    text = rf"concat('{{{{Thông tin nghệ sĩ|nghề nghiệp=Diễn viên}}}}\n== Phim ==\n=== Phim ', s_suppkey, ' ===\n{{|\n', {head}, '\n|-\n|1||[[film ', s_suppkey, ']]\n|}}')"
    people = read(spark, d, "supplier").select(F.col("s_name").alias("title"), F.expr(text).alias("text"))
    return network.build(people, people.select(F.col("title").alias("name"))).errors


@query(
    """WITH RECURSIVE o AS (SELECT o_orderkey AS k, CASE o_orderkey % 10 WHEN 6 THEN o_orderkey - 4 WHEN 9 THEN NULL ELSE o_orderkey + 1 END AS next FROM orders),
  w AS (SELECT k AS s, next AS here, 1 AS n FROM o WHERE next IS NOT NULL UNION ALL SELECT w.s, o.next, w.n + 1 FROM w JOIN o ON w.here = o.k WHERE o.next IS NOT NULL AND w.n < 16),
  member AS (SELECT s FROM w WHERE s = here GROUP BY 1), ring AS (SELECT w.s, min('order ' || w.here) AS cycle FROM w JOIN member ON w.s = member.s GROUP BY 1)
  SELECT DISTINCT 'order ' || w.s AS title, ring.cycle, w.s IN (SELECT s FROM member) AS member FROM w JOIN ring ON w.here = ring.s"""
)
def redirect_cycles(spark, d):
    """Redirects that never end: in every ten orders, five that go in a ring and two that run into it."""
    text = "case o_orderkey % 10 when 6 then concat('#redirect [[order ', o_orderkey - 4, ']]') when 9 then 'end' else concat('#redirect [[order ', o_orderkey + 1, ']]') end"
    pages = read(spark, d, "orders").select(F.expr("concat('order ', o_orderkey)").alias("title"), F.expr(text).alias("text"))
    return lookup.redirect_cycles(pages.select("title", lookup.redirect_target(F.col("text")).alias("target")))


@query("SELECT c_custkey, coalesce('total ' || o_totalprice::VARCHAR, '') AS text FROM customer LEFT JOIN orders ON o_orderkey = c_custkey")
def store_lookup(spark, d):
    """Texts by title from pages kept in buckets by title; titles without a page read ''."""
    pages = read(spark, d, "orders").select(F.expr("concat('order ', o_orderkey)").alias("title"), F.expr("concat('total ', cast(o_totalprice as string))").alias("text"))
    kept = store.PageStore.write(pages, f"{_folder(spark)}/pages")
    asked = read(spark, d, "customer").select("c_custkey", F.expr("concat('order ', c_custkey)").alias("title"))
    return lookup.lookup(asked, kept.read(asked)).drop("title")


@query(f"WITH person AS ({PEOPLE}) SELECT name, place, (count(*) OVER (PARTITION BY place) - 1)::BIGINT AS links FROM person QUALIFY links > 0")
def location_classes(spark, d):
    """Who shares a place with how many: the compact form of ``same_location_pairs``."""
    return graph.class_membership(graph.people_of(graph.nodes(persons(spark, d), works(spark, d))), "place")


@query(f"WITH person AS ({PEOPLE}), c AS (SELECT school, count(*) AS members FROM person GROUP BY 1) SELECT school, members, members * (members - 1) // 2 AS pairs FROM c WHERE members > 1")
def school_classes(spark, d):
    """How many people share a school, and how many pairs that stands for."""
    return graph.shared_classes(graph.people_of(graph.nodes(persons(spark, d), works(spark, d))), "school")


# -- directors, section names of tables, people alone, and the options ---------------------


@query(
    """SELECT s_name AS title, CASE s_suppkey % 3 WHEN 0 THEN 'directed ' || s_suppkey WHEN 1 THEN 'acted ' || s_suppkey ELSE 'person ko là actor cũng ko là director' END AS film_part FROM supplier"""
)
def director_sections(spark, d):
    """Film sections of directors and of actors; of people who are neither, none."""
    job = "case s_suppkey % 3 when 0 then '|công việc=Nhà làm phim' when 1 then '|occupation=diễn viên' else '|nghề nghiệp=ca sĩ' end"
    said = "if(s_suppkey % 3 = 0, 'directed ', 'acted ')"
    text = rf"concat('{{{{Thông tin nghệ sĩ|tên=', s_name, {job}, '}}}}\n== Phim ==\n', {said}, s_suppkey, '\n== Khác ==')"
    people = read(spark, d, "supplier").select(F.col("s_name").alias("title"), F.expr(text).alias("text"))
    return sections.film_sections(sections.page_sections(infobox.page_facts(people)))


@query(
    """SELECT n_name AS title, 'Loại ' || k AS type_film, 'film ' || k || ' of ' || n_nationkey AS film FROM nation, (VALUES (0), (1), (2)) AS v(k) WHERE (n_nationkey + k) % 3 <> 1"""
)
def table_types(spark, d):
    """Rows of several film tables a person, by the section they stand in; foreign films go."""
    kinds = spark.range(3).select(F.col("id").alias("k"))
    both = read(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("int").alias("n")).join(kinds.hint("broadcast"), F.lit(True))
    film = both.select("n_name", "k", F.expr("concat('film ', k, ' of ', n)").alias("film"), F.expr("if((n + k) % 3 = 1, '|quốc gia=Mỹ', '|quốc gia=Việt Nam')").alias("country"))
    facts = infobox.page_facts(film.select(F.col("film").alias("title"), F.expr("concat('{{Infobox film|tên phim=x', country, '}}')").alias("text")))
    one = F.expr(r"concat('=== Loại ', k, ' ===\n{|\n!Năm!!Tựa đề\n|-\n|1990||[[', film, ']]\n|}\n')")
    parts = film.groupBy(F.col("n_name").alias("title")).agg(F.array_join(F.array_sort(F.collect_list(one)), "").alias("film_part"))
    return tables.vn_film_rows(tables.film_rows(parts), facts).select("title", "type_film", tables.row_title(tables.SEED_WORDS).alias("film"))


@query(
    """WITH e AS (SELECT DISTINCT c_name AS person, floor(o_totalprice)::BIGINT AS film FROM customer JOIN orders ON c_custkey = o_custkey),
  shared AS (SELECT film FROM e GROUP BY film HAVING count(*) > 1)
  SELECT c_name AS name FROM customer WHERE c_name NOT IN (SELECT person FROM e JOIN shared USING (film))"""
)
def lone_persons(spark, d):
    """Customers none of whose orders costs, in whole units, what another customer's does."""
    return _alone(spark, d, read(spark, d, "orders").select("o_custkey", F.floor("o_totalprice").cast("string").alias("o_orderpriority")))


@query("SELECT 'order ' || o_orderkey AS title, 'order ' || CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE o_orderkey - o_orderkey % 3 END AS final_title FROM orders WHERE o_orderkey >= 3")
def redirects_any_case(spark, d):
    """The option that follows redirects however their word is written."""
    text = "case o_orderkey % 3 when 0 then 'end' when 1 then concat('#REDIRECT [[order ', o_orderkey - 1, ']]') else concat('#Đổi [[order ', o_orderkey - 2, ']]') end"
    pages = read(spark, d, "orders").where("o_orderkey >= 3").select(F.expr("concat('order ', o_orderkey)").alias("title"), F.expr(text).alias("text"))
    return lookup.resolved_pages(pages, any_case=True).select("title", "final_title")


@query("SELECT p_partkey, 'Ai ' || p_name || ' (' || p_size || ')' AS kept, 'Ai ' || p_name || ' ' || p_size AS bare FROM part")
def names_with_parentheses(spark, d):
    """The option that keeps parentheses in names of prose casts, beside the default."""
    text = F.expr("concat('* [[Ai ', p_name, ' (', p_size, ')|x]] vai A.')")
    name = lambda keep: F.get(cast.prose_cast(text, keep), 0)["actor_name"]
    return read(spark, d, "part").select("p_partkey", name(True).alias("kept"), name(False).alias("bare"))


@query("SELECT p_name || '#' || p_partkey AS film, 0 AS dropped, 2 AS flattened, p_brand AS first FROM part")
def flattened_casts(spark, d):
    """The option that keeps casts read from tables, beside the default, which drops them."""
    actors = F.array(F.struct(F.col("p_brand").alias("actor_name"), F.lit("A").alias("character")), F.struct(F.lit("B").alias("actor_name"), F.lit("C").alias("character")))
    made = read(spark, d, "part").select(F.expr(FILM).alias("film"), F.create_map(F.lit("tên phim"), F.col("p_name")).alias("infobox"), actors.alias("actors"), F.lit(True).alias("nested"), F.lit(None).cast("array<string>").alias("director"))
    default, flat = records.film_records(made), records.film_records(made, flatten_table_cast=True)
    told = flat.select("film", F.size("actors").alias("flattened"), F.get("actors", 0)["actor_name"].alias("first"))
    return default.select("film", F.size("actors").alias("dropped")).join(told, "film")


@query(BFS + "SELECT p::VARCHAR AS name, level FROM person")
def directors_lead(spark, d):
    """The option that lets directors lead on: casts without first lines, whose people direct, reach what all credits reach."""
    credit = read(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("name"), F.col("l_orderkey").cast("string").alias("film"), F.col("l_linenumber").alias("pos"))
    start = read(spark, d, "part").where(SEEDS).select(F.col("p_partkey").cast("string").alias("name"))
    casts = credit.where("pos <> 1").select("film", "pos", F.col("name").alias("actor"), F.lit(False).alias("nested"))
    led = credit.where("pos = 1").select("film", F.col("name").alias("actor"))
    return crawl.crawl(start, credit.select("name", "film"), casts, full_frontier=True, directors=led)[0].select("name", "level")


@query("SELECT s_name AS name, 'film ' || (s_suppkey - s_suppkey % 2) AS film FROM supplier")
def canonical_films(spark, d):
    """The option that takes aliases of one page for one node: every other person's table names an alias."""
    text = r"concat('{{Thông tin nghệ sĩ|nghề nghiệp=Diễn viên}}\n== Phim ==\n{|\n!Năm!!Phim\n|-\n|1||[[film ', s_suppkey, ']]\n|}')"
    people = read(spark, d, "supplier").select(F.col("s_name").alias("title"), F.expr(text).alias("text"))
    film = "if(s_suppkey % 2 = 0, '{{Infobox film|quốc gia=Việt Nam}}', concat('#đổi [[film ', s_suppkey - 1, ']]'))"
    films = read(spark, d, "supplier").select(F.expr("concat('film ', s_suppkey)").alias("title"), F.expr(film).alias("text"))
    zero = spark.createDataFrame([("film 0", "{{Infobox film|quốc gia=Việt Nam}}")], "title string, text string")
    pages = people.unionByName(films.where("title <> 'film 0'")).unionByName(zero)
    made = network.build(pages, people.select(F.col("title").alias("name")), canonicalize=True)
    return made.persons.select("name", F.explode_outer("films").alias("film"))
