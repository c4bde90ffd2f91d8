"""Which films and persons count as Vietnamese."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from filmweave.functions import text as T
from filmweave.operators.infobox import first_key, lower_keys

# What names the country in a field.
FILM_COUNTRY = ["{{vie}}", "{{vn}}", "{{vnm}}", "việt nam"]
PERSON_COUNTRY = ["việt nam", "{{vie}}", "vietnam", "{{vnm}}"]


def vn_film_status(title: Column, kind: Column, box: Column) -> Column:
    """``vn``, ``not_vn``, ``unknown`` (kept like ``vn``), or null for what isn't a film; a blank title is ``not_vn``."""
    lower = lower_keys(box)
    country = F.lower(first_key(lower, ["country", "quốc gia"]))
    language = F.lower(first_key(lower, ["language", "ngôn ngữ"]))
    by_country = F.when(T.any_of(country, FILM_COUNTRY), "vn").otherwise("not_vn")
    by_language = F.when(F.coalesce(language, F.lit("")).contains("tiếng việt"), "vn").otherwise("unknown")
    judged = F.when(F.coalesce(country, F.lit("")) != "", by_country).otherwise(by_language)
    return F.when(T.strip(F.coalesce(title, F.lit(""))) == "", "not_vn").when(kind == "film", judged)


def keeps_film(status: Column) -> Column:
    return F.coalesce(status.isin("vn", "unknown"), F.lit(False))


def vn_person(title: Column, kind: Column, box: Column, templates: Column, text: Column) -> Column:
    """Strict test: nationality decides if given; else any value, template name, or the page's own words."""
    lower = lower_keys(box)
    nationality = F.lower(first_key(lower, ["quốc tịch", "nationality"]))
    values = F.lower(F.array_join(F.map_values(box), " "))
    names = F.lower(F.array_join(F.transform(templates, lambda t: t["name"]), " "))
    elsewhere = T.any_of(values, PERSON_COUNTRY) | T.any_of(names, PERSON_COUNTRY) | F.lower(text).contains("người việt")
    judged = F.when(nationality.isNotNull(), T.any_of(nationality, PERSON_COUNTRY)).otherwise(elsewhere)
    asked = (T.strip(F.coalesce(title, F.lit(""))) != "") & (F.coalesce(kind, F.lit("")) == "person")
    return F.when(asked, F.coalesce(judged, F.lit(False))).otherwise(F.lit(False))
