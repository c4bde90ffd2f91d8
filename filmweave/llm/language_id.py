"""Language identification by Bayesian fusion of evidence.

A text's likelihood under each language comes from character trigrams, learned
from a bounded sample of texts per declared language. It is fused with what the
document says of itself and where it comes from:

- the declared (markup) language, through how often texts of each language
  declare it;
- the address suffix, likewise;
- the host's prior, smoothed towards its suffix's prior, which is smoothed
  towards the corpus prior.

All counts come from grouped aggregation over the whole corpus, with the texts'
own most likely language as the truth; they are joined to the rows, and only one
number per language reaches the driver. Trigrams overlap and depend on each
other, so a text counts as at most ``evidence`` independent ones (a parameter;
None: all of them).

Every language that at least ``least_texts`` documents declare gets a model,
whatever their share (a model takes 128 KB). A text that no model explains better than evenly spread
trigrams is in the language that it declares if that one has too few texts for a
model, and then kept; else it is in the language ``other`` and not kept.

A document is kept if its best language's posterior reaches ``threshold`` and
its words look like that language more than like evenly spread trigrams.

Defined results: a null, empty or blank text has no likelihoods, is not kept and
gets the language of its other evidence; null declared languages, suffixes and
hosts carry no evidence of their own (a null host has its suffix's prior); ties go
to the language first in code point order; null and repeated ids, and repeated
rows, are judged each alike by their own columns; very long texts count whole;
other columns, whatever their names, are not read; without a model of any
language nothing is kept; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from filmweave.llm.common import BROADCAST_ROWS, documents, maybe_broadcast, stage, text_rows
from filmweave.llm.words import gram_hashes, in_parts, spell, words_of
from filmweave.session import prepare

#: Texts of a declared language in the sample; texts that a language needs for a model; trigram buckets; independent trigrams of a text at most.
PER_LANGUAGE, LEAST_TEXTS, BUCKETS, EVIDENCE = 400, 2, 1 << 15, 200
#: Weight, in documents, of the wider prior in a host's (and of the corpus prior in a suffix's).
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 20.0
OTHER = "other"

#: What is no part of a word's spelling.
EDGES = np.array([ord(c) for c in ".,;:!?\"'()[]{}<>|#*$%&0123456789"], np.uint32)


def trigrams(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the trigrams of words between two blanks."""
    h, owner = gram_hashes(*spell(distinct, " ", " ", EDGES), 3)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), owner


class TrigramModel:
    """``table[bucket, language]``: log probability against even spread."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.05
        self.table = (np.log(smooth / smooth.sum(0)) + np.log(BUCKETS) if languages else np.zeros((BUCKETS, 0))).astype(np.float32)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(summed log likelihoods [text, language], trigrams) of texts."""
        parts = [self._part(part) for part in in_parts(texts)]
        none = (np.zeros((0, len(self.languages))), np.zeros(0, np.int64))
        return tuple(np.concatenate(x) for x in zip(none, *parts, strict=True))

    def _part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = words_of(texts, ascii_only=False)
        bucket, owner = trigrams(words.distinct)
        size = len(words.distinct)
        n = np.bincount(owner, minlength=size)
        rows = np.zeros((size, len(self.languages)))
        some = np.flatnonzero(n > 0)
        ends = np.cumsum(n)
        step = max(1, (1 << 24) // max(1, len(self.languages)))
        first = 0
        while first < len(some):  # bounded numbers of table rows at a time
            last = max(first + 1, int(np.searchsorted(ends[some], ends[some[first]] - n[some[first]] + step, side="right")))
            these = some[first:last]
            a = int(ends[these[0]] - n[these[0]])
            rows[these] = np.add.reduceat(self.table[bucket[a : int(ends[these[-1]])]], ends[these] - n[these] - a, axis=0)
            first = last
        return words.sums(rows), words.sums(n)


def train(docs: DataFrame, declared: str = "lang", least_texts: int = LEAST_TEXTS) -> TrigramModel:
    """From at most PER_LANGUAGE texts (least hashes) of each language that ``least_texts`` documents declare, whatever their share.

    Trigrams are counted on the executors; one number per language and bucket reaches the driver.
    """
    told = docs.where(F.col(declared).isNotNull()).groupBy(F.col(declared).alias("said")).count()
    languages = sorted(r["said"] for r in told.where(F.col("count") >= least_texts).collect())
    if not languages:
        return TrigramModel([], np.zeros((BUCKETS, 0)))
    number = {v: k for k, v in enumerate(languages)}
    keyed = docs.where(F.col(declared).isin(languages)).select(F.col(declared).alias("said"), "text", F.xxhash64("doc_id", "text").alias("row"))
    ranked = keyed.select("said", "row").distinct().withColumn("r", F.row_number().over(Window.partitionBy("said").orderBy(F.xxhash64("row"), "row")))
    picked = F.broadcast(ranked.where(F.col("r") <= PER_LANGUAGE).select("said", "row"))  # PER_LANGUAGE times languages at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            words = words_of(b.column(1), ascii_only=False)
            bucket, owner = trigrams(words.distinct)
            for k, said in enumerate(b.column(0).to_pylist()):
                often = np.bincount(words.at[words.starts[k] : words.ends[k]], minlength=len(words.distinct))
                at = seen.setdefault(number[said], np.zeros(BUCKETS, np.int64))
                at += np.bincount(bucket, weights=often[owner], minlength=BUCKETS).astype(np.int64)
        for k, c in seen.items():
            found = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"k": np.full(len(found), k), "bucket": found, "n": c[found]})

    sample = keyed.join(picked, ["said", "row"]).dropDuplicates(["said", "row"]).select("said", "text")
    found = text_rows(sample).mapInArrow(count, "k long, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(languages)))
    counts[found.column("bucket").to_numpy(), found.column("k").to_numpy()] = found.column("n").to_numpy()
    return TrigramModel(languages, counts)


def likelihoods(docs: DataFrame, model: TrigramModel, carry: Sequence[str]) -> DataFrame:
    """(carried columns, declared, suffix, host, n, ll, top): summed log likelihoods by language, trigrams, best language; staged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<n: bigint, ll: array<double>, top: int>")
    def read(texts: pa.Array) -> pa.Array:
        ll, n = sent.value(texts)
        size = ll.shape[1]
        top = pa.array(ll.argmax(1) if size else np.zeros(len(n), np.int64), pa.int32(), mask=(n == 0) | (size == 0))
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * size, pa.int32()), pa.array(ll.ravel()))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), listed, top], names=["n", "ll", "top"])

    told = text_rows(docs).select(*carry, F.struct("declared", "suffix", "host").alias("_said"), read("text").alias("_read"))
    return stage(told, "language-evidence").select(*carry, "_said.*", "_read.*")


def by_value(seen: DataFrame, column: str) -> DataFrame:
    """(value, by_<column>): texts of each language (map from its number) by the values of a column."""
    counted = seen.where(F.col("top").isNotNull() & F.col(column).isNotNull()).groupBy(F.col(column).alias(f"_{column}"), "top").count()
    return counted.groupBy(f"_{column}").agg(F.map_from_entries(F.collect_list(F.struct("top", "count"))).alias(f"by_{column}"))


def _dense(column: pa.MapArray, size: int) -> np.ndarray:
    out, ends = np.zeros((len(column), size)), column.offsets.to_numpy()
    sizes = np.diff(ends)
    out[np.repeat(np.arange(len(column)), sizes), column.keys.to_numpy()[ends[0] : ends[-1]]] = column.items.to_numpy()[ends[0] : ends[-1]]
    return out


def identify(docs: DataFrame, model: TrigramModel, threshold: float = 0.5, evidence: int | None = EVIDENCE, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """For ``docs`` (text, declared, suffix, host): language, posterior, text_language, kept, beside the columns to ``carry``.

    What is carried lies beside the likelihoods, so a verdict needs no join to meet its row.
    """
    languages = model.languages
    size = len(languages)
    seen = likelihoods(docs, model, carry)
    if not size:
        return seen.select(*carry, "declared", "host", F.lit(None).cast("string").alias("text_language"), F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
    corpus = np.ones(size)
    for r in seen.where("top is not null").groupBy("top").count().collect():
        corpus[r["top"]] += r["count"]
    prior = corpus / corpus.sum()
    # a key that meets nothing where there is no value, and isn't one key for all such rows
    nobody = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    columns = ("declared", "suffix", "host")
    joined, values = seen.withColumns({f"_key_{c}": F.coalesce(c, nobody) for c in columns}), 0
    for column in columns:
        table = stage(by_value(seen, column), f"by-{column}")
        values = table.count() if column == "declared" else values
        joined = joined.join(maybe_broadcast(table, BROADCAST_ROWS * 8 // max(8, size)), F.col(f"_key_{column}") == F.col(f"_{column}"), "left").drop(f"_{column}", f"_key_{column}")

    @F.arrow_udf("struct<best: int, posterior: double, kept: boolean>")
    def fuse(n: pa.Array, ll: pa.Array, says: pa.Array, ends: pa.Array, at_host: pa.Array) -> pa.Array:
        n, says, ends, at_host = n.to_numpy(), _dense(says, size), _dense(ends, size), _dense(at_host, size)
        mean = ll.flatten().to_numpy().reshape(-1, size) / np.maximum(n, 1)[:, None]
        wide = (ends + SUFFIX_WEIGHT * prior) / (ends.sum(1, keepdims=True) + SUFFIX_WEIGHT)
        z = np.log((at_host + HOST_WEIGHT * wide) / (at_host.sum(1, keepdims=True) + HOST_WEIGHT))
        # P(declared | language), smoothed over the values there are
        z += np.where(says.sum(1, keepdims=True) > 0, np.log((says + 1.0) / (corpus + values + 1)), 0.0)
        z += mean * (n if evidence is None else np.minimum(n, evidence))[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        sure, own = p[np.arange(len(n)), best], mean[np.arange(len(n)), best]
        said = np.where((n > 0) & (mean.max(1) <= 0), size, best)
        return pa.StructArray.from_arrays([pa.array(said, pa.int32()), pa.array(sure), pa.array((n > 0) & (sure >= threshold) & (own > 0))], names=["best", "posterior", "kept"])

    empty, names = F.expr("cast(map() as map<int, bigint>)"), F.array(*map(F.lit, [*languages, OTHER]))
    fused = joined.withColumn("_fused", fuse("n", "ll", *(F.coalesce(f"by_{c}", empty) for c in columns)))
    # what no model explains is in the language it declares, if that is one without a model
    alone = F.col("declared").isNotNull() & ~F.col("declared").isin(languages) & (F.col("_fused.best") == size) & (F.col("n") > 0)
    language = F.when(alone, F.col("declared")).otherwise(F.get(names, F.col("_fused.best")))
    return fused.select(*carry, "declared", "host", F.get(names, F.col("top")).alias("text_language"), language.alias("language"), "_fused.posterior", (F.col("_fused.kept") | alone).alias("kept"))


def evidence_of_documents(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Documents declare ``lang``; their source is the host, and what follows its last dot the suffix."""
    suffix = F.when(F.col("source").contains("."), F.substring_index("source", ".", -1))
    return docs.select(*carry, "text", F.col("lang").alias("declared"), suffix.alias("suffix"), F.col("source").alias("host"))


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """Pages declare ``<html lang>``; host and suffix come from the address, the text from the markup without tags."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>|&[#a-zA-Z0-9]+;", " ")
    empty_to_null = lambda c: F.when(c != "", c)
    return pages.select(
        F.col("page_id").alias("doc_id"),
        bare.alias("text"),
        empty_to_null(declared).alias("declared"),
        F.substring_index(empty_to_null(host), ".", -1).alias("suffix"),
        empty_to_null(host).alias("host"),
        F.col("html").isNotNull().alias("_has"),
    ).drop("_has")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, and whether it is kept."""
    docs = documents(spark, sf_dir)
    return identify(evidence_of_documents(docs), train(docs))


def page_language(spark, sf_dir: str) -> DataFrame:
    """The language of every raw page, with markup and address as evidence."""
    pages = evidence_of_pages(prepare(spark).read.parquet(f"{sf_dir}/pages.parquet"))
    return identify(pages, train(pages, "declared")).withColumnRenamed("doc_id", "page_id")
