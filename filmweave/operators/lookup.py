"""Titles to texts: point lookup and redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filmweave.functions.text import strip
from filmweave.staging import stage


def redirect_target(text: Column, any_case: bool = False) -> Column:
    """Where a redirect page points, null if it doesn't redirect or names no page."""
    t = F.lower(text) if any_case else text
    redirects = t.startswith("#đổi") | t.startswith("#redirect")
    after = F.substring_index(F.substring(text, F.instr(text, "[["), F.length(text)), "]]", 1)
    return F.when(redirects & (F.instr(text, "[[") > 0) & (F.instr(text, "]]") > 0), strip(F.substring(after, F.lit(3), F.length(after))))


def lookup(titles: DataFrame, pages: DataFrame, title: str = "title") -> DataFrame:
    """``titles`` with the page's ``text``, '' for a missing page."""
    found = pages.select(F.col("title").alias("_t"), F.col("text"))
    return titles.join(found, F.col(title) == F.col("_t"), "left").drop("_t").withColumn("text", F.coalesce("text", F.lit("")))


def resolve_redirects(hops: DataFrame) -> DataFrame:
    """(title, final_title, hops, redirect_status) for redirects (title, target).

    Titles are unique. Chains double at every step, on the redirects alone, so a chain of any length ends after the
    logarithm of its hops. Once a doubling ends no further title, what is still open runs into a cycle (the tail of a
    longer chain would have ended) and is ``too_deep``.
    """
    step = hops.select("title", "target").where("target is not null")
    heads = step.select(F.col("title").alias("_t")).distinct()
    now = stage(step.join(heads, F.col("target") == F.col("_t"), "left").select("title", F.col("target").alias("at"), F.lit(1).cast("long").alias("hops"), F.col("_t").isNotNull().alias("open")), "redirects")
    left, before = now.where("open").count(), -1
    while left and left != before:
        onward = now.select(F.col("title").alias("_t"), F.col("at").alias("_at"), F.col("hops").alias("_h"), F.col("open").alias("_o"))
        now = stage(
            now.join(onward, F.col("at") == F.col("_t"), "left").select(
                "title", F.coalesce("_at", "at").alias("at"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"), F.coalesce("_o", F.lit(False)).alias("open")
            ),
            "redirects",
        )
        before, left = left, now.where("open").count()
    return now.select("title", F.when(~F.col("open"), F.col("at")).alias("final_title"), "hops", F.when(F.col("open"), "too_deep").otherwise("resolved").alias("redirect_status"))


def redirect_cycles(hops: DataFrame) -> DataFrame:
    """(title, cycle, member): redirects (title, target) that never end, by the least title of the cycle they run into.

    ``member`` tells a cycle's own titles from tails that run into it. Titles are numbered in their order, and steps
    double on the numbers; what ends meanwhile falls out. When a doubling ends nothing, lowers no least number on the
    way and reaches as many titles as the one before, steps permute what they reach: these are the members, and the
    least number from there on is the cycle's.
    """
    step = hops.select("title", "target").where("target is not null")
    # a sort gives partitions in order, so the numbers rise with the titles
    known = stage(step.orderBy("title").withColumn("id", F.monotonically_increasing_id()), "redirect-numbers")
    now = stage(known.join(known.select(F.col("title").alias("target"), F.col("id").alias("at")), "target").select("id", "at", F.col("id").alias("least")), "redirect-steps")
    size = now.count()
    while True:
        onward = now.select(F.col("id").alias("_i"), F.col("at").alias("_at"), F.col("least").alias("_l"))
        met = now.join(onward, F.col("at") == F.col("_i"))
        after = stage(met.select("id", F.col("_at").alias("at"), F.least("least", "_l").alias("least"), F.col("_l").alias("cycle"), (F.col("_l") < F.col("least")).alias("lower")), "redirect-steps")
        left, lower = after.agg(F.count("*"), F.count_if("lower")).first()
        members = after.select(F.col("at").alias("id")).distinct()
        if left == size and not lower and members.count() == now.select("at").distinct().count():
            break
        now, size = after.select("id", "at", "least"), left
    told = after.select("id", "cycle").join(members.withColumn("member", F.lit(True)), "id", "left").join(known.select("id", "title"), "id")
    names = known.select(F.col("id").alias("cycle"), F.col("title").alias("_name"))
    return told.join(names, "cycle").select("title", F.col("_name").alias("cycle"), F.coalesce("member", F.lit(False)).alias("member"))


def resolved_pages(pages: DataFrame, any_case: bool = False) -> DataFrame:
    """(title, final_title, text, redirect_status) for every page title; a dangling redirect reads ''.

    A redirect that names no page reads as its own text.
    """
    marked = pages.withColumn("target", redirect_target(F.col("text"), any_case))
    ends = resolve_redirects(marked)
    texts = pages.select(F.col("title").alias("final_title"), F.col("text").alias("_text"))
    followed = ends.join(texts, "final_title", "left").select(
        "title", "final_title", F.coalesce("_text", F.lit("")).alias("text"),
        F.when((F.col("redirect_status") == "resolved") & F.col("_text").isNull(), "dangling").otherwise(F.col("redirect_status")).alias("redirect_status"),
    )
    direct = marked.where("target is null").select("title", F.col("title").alias("final_title"), "text", F.lit("direct").alias("redirect_status"))
    return direct.unionByName(followed)
