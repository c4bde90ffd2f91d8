"""A training-data pipeline over ``documents``: rules, language, near duplicates, mix, packing.

Each stage takes what its predecessor kept. All but the last return the columns
of ``documents``; the last returns where every piece of every document goes.
Decisions belong to rows, not to ids. Judgements lie beside the row they are about,
so rules and language filter without a join; components and the mix are decided on
narrow rows that go by a hash of their contents, which meets the texts in one join.

Defined results: null and repeated ids are rows like others, and only a row's own
decision touches it; among near duplicates (equal rows too) the row with the
least id stays, a null id yields to any other, and ties go by the hash; null, empty
and blank texts fail the rules; very long texts count whole; extra columns, whatever
their names, travel along; an empty table stays empty at every stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from filmweave.llm import jaccard_join, language_id, mixing, packing, weak_rules
from filmweave.llm.common import forget, fresh_path, known_rows, stage, staged_since, staged_so_far
from filmweave.llm.tokens import place
from filmweave.session import prepare

#: Tables that earlier stages staged and that may be read no more.
_left: list[str] = []


def _step(work: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage: when it begins its predecessor is written, so what that staged goes, unless ``docs`` still reads it.

    What the last stage staged is read by its result, and stays.
    """

    @functools.wraps(work)
    def step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _left[:] = forget(prepare(spark), _left, docs)
        mark = staged_so_far()
        out = work(docs)
        if step is not STAGES[-1][1]:
            _left.extend(staged_since(mark))
        return out

    return step


@_step
def quality_rules(docs: DataFrame) -> DataFrame:
    judged = weak_rules.judge(docs.select(F.struct("*").alias("doc"), "text"), carry=["doc"])
    return judged.where("kept").select("doc.*")


@_step
def language(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.struct("*").alias("doc"), "text", "lang", "source")
    judged = language_id.identify(language_id.evidence_of_documents(rows, carry=["doc"]), language_id.train(docs), carry=["doc"])
    return judged.where("kept").select("doc.*")


@_step
def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of every component (five-word shingles, similarity 0.8).

    Rows go by one hash while they are joined. Unequal rows that share it are told by the other one: they are few, can't
    be judged apart, and stay.
    """
    known = known_rows(docs)
    told = jaccard_join.join(known.select(F.col("row").alias("doc_id"), "doc.text"), words=5, percent=80)
    told = stage(told.select(F.col("doc_id").alias("row"), "component_id"), "near-duplicates")
    ids = known.select("row", "check", F.col("doc.doc_id").alias("id")).distinct()
    met = stage(told.distinct().join(ids, "row"), "components-by-id")
    first = met.groupBy("component_id").agg(F.min_by("row", F.struct(F.isnull("id"), "id", "row")).alias("row")).select("row")
    shared = met.groupBy("row").agg((F.min("check") < F.max("check")).alias("shared")).where("shared").select("row")
    stay = first.unionByName(shared).distinct()
    chosen = stage(told.join(stay, "row", "left_semi").groupBy("row").agg(F.count("*").alias("same")), "kept-rows")
    kept = known.join(chosen.hint("merge"), "row")  # it grows with the documents: one plan at every size
    if chosen.where("same > 1").limit(1).count():
        kept = kept.where("same = 1").unionByName(kept.where("same > 1").dropDuplicates(["row", "check"]))
    return kept.select("doc.*")


@_step
def mix_sources(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs)


@_step
def pack_sequences(docs: DataFrame) -> DataFrame:
    return packing.pack(packing.pieces(docs, place("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Expectation-maximisation, random rounding and tokenizers are not SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        out = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"stage-{k}")
            out.write.parquet(path)
            out = spark.read.schema(out.schema).parquet(path)
        docs = out
    return docs
