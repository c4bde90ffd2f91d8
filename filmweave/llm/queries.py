"""The registered queries of the corpus operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filmweave.llm.chat_format import op12_chat_format
from filmweave.llm.divergence import op11_divergence
from filmweave.llm.jaccard_join import op10_jaccard_join
from filmweave.llm.language_id import op9_language_id, page_language
from filmweave.llm.mixing import op2_mixing
from filmweave.llm.neighbours import op7_nn_descent
from filmweave.llm.packing import op8_packing
from filmweave.llm.quality_model import op4_quality
from filmweave.llm.resharding import op1_resharding
from filmweave.llm.toxicity import op3_toxicity
from filmweave.llm.vector_codes import ROUNDS, op13_vector_codes
from filmweave.llm.wavelet import op6_wavelet
from filmweave.llm.weak_rules import op5_weak_rules

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that op5 judges by, and its base rules: what of its contract SQL can say."""
    return op5_weak_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mix_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of documents and of their sources as op2 mixes them."""
    return op2_mixing(spark, sf_dir).select("doc_id", "size", "source", "source_size")


def _vector_codes_sql() -> str:
    """op13 in SQL: its rounds one after another, each counting afresh."""
    rounds = []
    for k in range(ROUNDS + 1):
        rounds.append(f"""far{k} AS (SELECT vec_id, part, entry, sum((x - y) * (x - y))::BIGINT AS d FROM piece JOIN book{k} USING (part, place) GROUP BY ALL),
  at{k} AS (SELECT vec_id, part, min(d * 16 + entry) % 16 AS entry, min(d) AS d FROM far{k} GROUP BY ALL)""")
        if k < ROUNDS:
            rounds.append(f"""mean{k} AS (SELECT part, entry, place, sum(x)::BIGINT AS s, count(*) AS n FROM at{k} JOIN piece USING (vec_id, part) GROUP BY ALL),
  book{k + 1} AS (SELECT part, entry, place, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM book{k} LEFT JOIN mean{k} USING (part, entry, place))""")
    return f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  flat AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS c, len(v) // 8 AS w FROM kept),
  piece AS (SELECT vec_id, x, c // w AS part, c % w AS place FROM flat),
  first16 AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 16),
  book0 AS (SELECT part, entry, place, x AS y FROM piece JOIN first16 USING (vec_id)),
  {", ".join(rounds)},
  told AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM at{ROUNDS} GROUP BY 1)
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, place)) FROM book{ROUNDS}) AS codebooks_sha256
  FROM told JOIN kept USING (vec_id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_resharding,
        op2_mixing,
        op3_toxicity,
        op4_quality,
        op5_weak_rules,
        op6_wavelet,
        op7_nn_descent,
        op8_packing,
        op9_language_id,
        op10_jaccard_join,
        op11_divergence,
        op12_chat_format,
        op13_vector_codes,
        page_language,
        rule_counts,
        mix_sizes,
    )
}
#: The operators learn, draw, encode or iterate, which isn't plain SQL; tests/llm holds them against brute force. Their counts are.
ORACLE_SQL: dict[str, str] = {
    "rule_counts": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
  place AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM d),
  three AS (SELECT doc_id, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM place WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
  often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM three WHERE c IS NOT NULL),
  covered AS (SELECT DISTINCT doc_id, i + k AS i FROM often, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1),
  repeated AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY 1),
  line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
  same AS (SELECT doc_id, sum(n - 1)::BIGINT AS n FROM (SELECT doc_id, l, count(*) AS n FROM line WHERE regexp_matches(l, '{WORD}') GROUP BY 1, 2) GROUP BY 1),
  told AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{BLANK}', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(same.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
    FROM d LEFT JOIN same USING (doc_id) LEFT JOIN repeated USING (doc_id))
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM told""",
    "op11_divergence": r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  word AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  kept AS (SELECT lang, term, count(*) AS n_lang FROM word GROUP BY 1, 2 HAVING count(DISTINCT k) >= 30),
  total AS (SELECT lang, count(*) AS v, sum(n_lang)::BIGINT AS n FROM kept GROUP BY 1),
  grp AS (SELECT DISTINCT lang, source FROM d),
  seen AS (SELECT lang, source, term, count(*) AS n FROM word JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
  size AS (SELECT lang, source, sum(n)::BIGINT AS n FROM seen GROUP BY 1, 2),
  p AS (SELECT g.lang, g.source, k.term, coalesce(seen.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(seen.n, 0) + 5) // (coalesce(size.n, 0) + 5 * total.v))::BIGINT AS p,
      1 + (1000000000::HUGEINT * (k.n_lang + 5) // (total.n + 5 * total.v))::BIGINT AS q
    FROM grp g JOIN kept k USING (lang) JOIN total USING (lang) LEFT JOIN seen ON seen.lang = g.lang AND seen.source = g.source AND seen.term = k.term LEFT JOIN size ON size.lang = g.lang AND size.source = g.source),
  far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY 1, 2, 3),
  pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source != b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
  term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE c > 0 AND p > q),
  told AS (SELECT * FROM pair UNION ALL SELECT * FROM term)
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank FROM told QUALIFY part = 'pair' OR rank <= 50""",
    "op12_chat_format": r"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
  mark AS (SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:s>|/s>|INST\]|/INST\]|\|(?:text|nl|image|audio|document|other)\|>)')) AS long,
    CASE WHEN role = 'assistant' THEN 4 ELSE length('[INST]') + length(role) + 1 + length('[/INST]') END AS around FROM c)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
    (length('<s>') + sum(long + around))::BIGINT AS formatted_chars
  FROM mark GROUP BY conv_id""",
    "op13_vector_codes": _vector_codes_sql(),
    "mix_sizes": rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents)
  SELECT doc_id, size, source, (sum(size) OVER (PARTITION BY source))::BIGINT AS source_size FROM d""",
}
