"""Normalised person and film records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filmweave.functions import text as T

# Infobox keys and the fields they become, and keys that are dropped.
PERSON_FIELDS = {
    "tên": "name",
    "name": "name",
    "tên khai sinh": "birth_name",
    "tên khác": "other_names",
    "alias": "alias",
    "ngày sinh": "birth_date",
    "birth_date": "birth_date",
    "nơi sinh": "birth_place",
    "birth_place": "birth_place",
    "quốc tịch": "nationality",
    "dân tộc": "ethnicity",
    "nghề nghiệp": "occupation",
    "công việc": "occupation",
    "occupation": "occupation",
    "năm hoạt động": "active_years",
    "năm hoạt động điện ảnh": "active_years",
    "chiều cao": "height",
    "học vấn": "education",
    "education": "education",
    "người hôn phối": "spouse",
    "spouse": "spouse",
    "con cái": "children",
    "người thân": "relatives",
    "tác phẩm nổi bật": "notable_works",
    "hình": "image",
    "image": "image",
}
FILM_FIELDS = {
    "tên phim": "title",
    "tựa đề": "title",
    "năm phát hành": "year",
    "năm": "year",
    "thể loại": "genre",
    "đạo diễn": "director",
    "diễn viên": "cast",
    "nhà sản xuất": "producer",
    "thời lượng": "duration",
    "quốc gia": "country",
    "ngôn ngữ": "language",
    "kinh phí": "budget",
    "doanh thu": "box_office",
}
PERSON_DROPPED = ["ghi chú hình", "signature", "giải thưởng"]
FILM_DROPPED = ["hình", "ghi chú hình"]


def key_map(spark) -> DataFrame:
    """(kind, source_key, field): the renames as a small dimension table."""
    rows = [(kind, k, v) for kind, fields in (("person", PERSON_FIELDS), ("film", FILM_FIELDS)) for k, v in fields.items()]
    return spark.createDataFrame(rows, "kind string, source_key string, field string")


def parse_fields(boxes: DataFrame, key: str, column: str, fields: dict[str, str], dropped: list[str], any_case: bool) -> DataFrame:
    """(key, column) with renamed keys and clean values; blank values go, of equal fields the last one stays.

    Entries are exploded once, so values are cleaned as a flat column; a record without fields keeps an empty map.
    """
    names = F.create_map(*(F.lit(x) for kv in fields.items() for x in kv))
    flat = boxes.select(key, F.posexplode_outer(F.map_entries(column)).alias("pos", "e")).select(key, "pos", F.col("e.key").alias("k"), F.col("e.value").alias("v"))
    kept = F.col("k").isNotNull() & ~F.col("k").isin(dropped)
    looked = F.lower("k") if any_case else F.col("k")
    told = flat.withColumn("field", F.coalesce(F.try_element_at(names, looked), F.col("k"))).withColumn("clean", T.clean_text(F.col("v")))
    entry = F.when(kept & (F.col("clean") != ""), F.struct("pos", F.struct(F.col("field").alias("key"), F.col("clean").alias("value")).alias("kv")))
    grouped = told.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("es"))
    return grouped.select(key, F.map_from_entries(F.transform("es", lambda x: x["kv"])).alias(column))


def person_records(persons: DataFrame) -> DataFrame:
    """(name, info, films): info normalised, films as they were."""
    info = parse_fields(persons, "name", "info", PERSON_FIELDS, PERSON_DROPPED, any_case=False)
    return persons.drop("info").join(info, "name")


def film_records(films: DataFrame, flatten_table_cast: bool = False) -> DataFrame:
    """(film, title, infobox, actors, director): fields normalised, names of roles and directors cleaned.

    Casts read from tables are dropped unless ``flatten_table_cast``. Directors without a link keep their status as name,
    which never matches a person.
    """
    box = parse_fields(films, "film", "infobox", FILM_FIELDS, FILM_DROPPED, any_case=True)
    usable = F.lit(True) if flatten_table_cast or "nested" not in films.columns else ~F.coalesce("nested", F.lit(False))
    cast = films.select("film", F.posexplode(F.when(usable, F.col("actors"))).alias("pos", "a")).select(
        "film", "pos", F.struct(F.coalesce("a.actor_name", F.lit("")).alias("actor_name"), T.clean_text(F.col("a.character")).alias("character")).alias("a")
    )
    cast = cast.groupBy("film").agg(F.array_sort(F.collect_list(F.struct("pos", "a"))).alias("x")).select("film", F.transform("x", lambda p: p["a"]).alias("actors"))
    lead = films.select("film", F.posexplode("director").alias("pos", "d")).select("film", "pos", T.clean_text(F.col("d")).alias("d")).where("d <> ''")
    lead = lead.groupBy("film").agg(F.array_sort(F.collect_list(F.struct("pos", "d"))).alias("x")).select("film", F.transform("x", lambda p: p["d"]).alias("director"))
    title = F.coalesce("title", "film") if "title" in films.columns else F.col("film")
    none = F.expr("cast(array() as array<struct<actor_name: string, character: string>>)")
    return (
        films.select("film", title.alias("title"))
        .join(box, "film")
        .join(cast, "film", "left")
        .join(lead, "film", "left")
        .select("film", "title", "infobox", F.coalesce("actors", none).alias("actors"), F.coalesce("director", F.expr("cast(array() as array<string>)")).alias("director"))
    )
