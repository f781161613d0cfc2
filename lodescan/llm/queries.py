"""Registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import exact_dedup
from .kd_shards import kd_shards
from .line_rules import line_rules
from .merkle import ARITY, merkle_manifest
from .mixing import mix
from .packing import pack
from .quality_cnn import classify
from .simhash import simhash_components
from .token_counts import token_counts
from .token_store import stored_tokens
from .warc import archived
from .whitening import whitened
from .wrappers import main_texts


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(table(spark, sf, "documents"))


def op2_quality_cnn(spark: SparkSession, sf: str) -> DataFrame:
    return classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op3_kd_shards(spark: SparkSession, sf: str) -> DataFrame:
    return kd_shards(table(spark, sf, "documents"))


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_components(table(spark, sf, "documents"))


def op5_wrappers(spark: SparkSession, sf: str) -> DataFrame:
    return main_texts(table(spark, sf, "pages"))


def op6_line_rules(spark: SparkSession, sf: str) -> DataFrame:
    return line_rules(table(spark, sf, "documents")).drop("clean_text")


def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    return archived(table(spark, sf, "pages")).drop("url")


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"))


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"))


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents"))


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitened(table(spark, sf, "embeddings"))


def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle_manifest(table(spark, sf, "documents"))


def op13_token_store(spark: SparkSession, sf: str) -> DataFrame:
    return stored_tokens(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_exact_dedup, op2_quality_cnn, op3_kd_shards, op4_simhash, op5_wrappers,
        op6_line_rules, op7_warc, op8_packing, op9_mixing, op10_token_counts,
        op11_whitening, op12_merkle, op13_token_store,
    )
}

ORACLE: dict[str, str] = {}

ORACLE["op1_exact_dedup"] = r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM normal
"""

ORACLE["op6_line_rules"] = r"""
WITH read AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                     lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM read WHERE len(words) >= 8)),
marked AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows)
  WHERE n > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM marked, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
judged AS (
  SELECT doc_id,
    list_filter(lines, lambda l: NOT (
      2 * len(regexp_extract_all(l, '[#*$%&<>]+|!!+|\?\?+')) > length(l) - length(replace(l, ' ', '')) + 1
      OR (len(regexp_extract_all(l, '[|»›•·]')) >= 3
          AND 4 * len(regexp_extract_all(l, '[|»›•·]')) > length(l) - length(replace(l, ' ', '')) + 1)
      OR (length(l) - length(replace(l, ' ', '')) + 1 >= 20 AND NOT regexp_matches(l, '[.!?…:;。！？：；؟؛۔।॥։።፧၊။។\x{0E00}-\x{0EFF}]'))
      OR (length(l) <= 200 AND 100 * (length(l) - length(regexp_replace(l, '(?i)\b(?:all rights reserved|cookie policy|privacy policy|terms of use|terms of service|use of cookies|uses cookies|click here|read more|sign up|log in|subscribe|javascript|lorem ipsum|licensed under|share this|powered by)\b', '', 'g'))) >= greatest(1, 20 * length(l)))
    )) AS clean
  FROM read),
counts AS (
  SELECT r.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, len(clean) AS n_clean_lines,
         length(regexp_replace(array_to_string(clean, chr(10)), '[\x20\x09-\x0D]+', '', 'g')) AS clean_chars
  FROM read r JOIN judged USING (doc_id) LEFT JOIN repeated USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND NOT word_chars - clean_chars > 0.5 * word_chars AS kept
FROM counts
"""

ORACLE["op7_warc"] = r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
coded AS (
  SELECT page_id, strlen(html) AS payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(d, CAST(1 + 10 * (i // 8) AS BIGINT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS INT)) & 31), 1)), '') AS payload_digest
  FROM payloads),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM coded)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM ranked
"""

ORACLE["op9_mixing"] = r"""
WITH corpus AS (
  SELECT doc_id, coalesce('d' || ((strpos('0123456789abcdef', substr(md5(source), 1, 1)) - 1) // 4), '') AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS available FROM corpus GROUP BY ALL),
root AS (SELECT (sum(available) // 2)::BIGINT AS budget FROM leaves),
d0 AS (
  SELECT domain, (2 * sum(available))::BIGINT AS c,
         CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w
  FROM leaves GROUP BY domain),
d1 AS (
  SELECT *, c * sum(w) OVER r <= w * (budget - coalesce(sum(c) OVER e, 0)) AS full_up
  FROM d0, root
  WINDOW r AS (ORDER BY c / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
         e AS (ORDER BY c / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d2 AS (
  SELECT domain, CASE WHEN full_up THEN c ELSE
           (w * (budget - sum(CASE WHEN full_up THEN c ELSE 0 END) OVER ()))
             // sum(CASE WHEN full_up THEN 0 ELSE w END) OVER () END AS budget
  FROM d1),
l0 AS (
  SELECT domain, lang, (2 * sum(available))::BIGINT AS c,
         CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w
  FROM leaves GROUP BY domain, lang),
l1 AS (
  SELECT *, c * sum(w) OVER r <= w * (budget - coalesce(sum(c) OVER e, 0)) AS full_up
  FROM l0 JOIN d2 USING (domain)
  WINDOW r AS (PARTITION BY domain ORDER BY c / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
         e AS (PARTITION BY domain ORDER BY c / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l2 AS (
  SELECT domain, lang, CASE WHEN full_up THEN c ELSE
           (w * (budget - sum(CASE WHEN full_up THEN c ELSE 0 END) OVER p))
             // sum(CASE WHEN full_up THEN 0 ELSE w END) OVER p END AS budget
  FROM l1 WINDOW p AS (PARTITION BY domain)),
s0 AS (SELECT domain, lang, source, available, 2 * available AS c, 1 AS w FROM leaves),
s1 AS (
  SELECT *, c * sum(w) OVER r <= w * (budget - coalesce(sum(c) OVER e, 0)) AS full_up
  FROM s0 JOIN l2 USING (domain, lang)
  WINDOW r AS (PARTITION BY domain, lang ORDER BY c / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
         e AS (PARTITION BY domain, lang ORDER BY c / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (
  SELECT domain, lang, source, available, CASE WHEN full_up THEN c ELSE
           (w * (budget - sum(CASE WHEN full_up THEN c ELSE 0 END) OVER p))
             // sum(CASE WHEN full_up THEN 0 ELSE w END) OVER p END AS budget
  FROM s1 WINDOW p AS (PARTITION BY domain, lang)),
plan AS (
  SELECT *, CASE WHEN available = 0 THEN 0 ELSE budget // available END AS epochs FROM s2),
taken AS (
  SELECT c.*, budget, epochs, budget - epochs * available AS rest,
         sum(n_tokens) OVER (PARTITION BY c.domain, c.lang, c.source
                             ORDER BY md5(concat_ws(':', '20', epochs::BIGINT, doc_id))
                             RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached
  FROM corpus c JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, budget::BIGINT AS leaf_budget,
       (epochs + CASE WHEN reached <= rest THEN 1 ELSE 0 END)::INT AS copies
FROM taken
"""


def merkle_sql(leaf_levels: int = 12, tree_levels: int = 6, arity: int = ARITY) -> str:
    """Manifest, proofs and folded roots level by level, for 3^12 leaves a source at most."""

    def climbed(kind: str, first: str, keys: str, levels: int) -> list[str]:
        """Nodes of each level and, of each run of three, their list."""
        ctes = []
        for i in range(levels):
            nodes = first if i == 0 else f"{kind}{i}"
            ctes += [
                f"{kind}r{i} AS (SELECT {keys}, p // {arity} AS run, any_value(c) AS c, list(node ORDER BY p) AS nodes FROM {nodes} GROUP BY ALL)",
                f"{kind}{i + 1} AS (SELECT {keys}, run AS p, (c + {arity - 1}) // {arity} AS c, CASE WHEN c = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node FROM {kind}r{i})",
            ]
        return ctes

    def walked(kind: str, rows: str, same: str, levels: int) -> list[str]:
        """Proof and folded node of every document, one level further each time."""
        ctes = []
        for i in range(levels):
            before = rows if i == 0 else f"{kind}w{i - 1}"
            ctes.append(f"""{kind}w{i} AS (
  SELECT w.* REPLACE (w.p // {arity} AS p,
    proof || array_to_string(list_filter(nodes, lambda x, k: k <> w.p % {arity} + 1), '') AS proof,
    CASE WHEN r.c = 1 THEN folded ELSE sha256(array_to_string(list_transform(nodes, lambda x, k: CASE WHEN k = w.p % {arity} + 1 THEN folded ELSE x END), '')) END AS folded)
  FROM {before} w JOIN {kind}r{i} r ON {same} AND w.p // {arity} = r.run)""")
        return ctes

    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    head = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    edited = field.format("replace(text, chr(10), '')")
    ctes = [
        f"read AS (SELECT doc_id, source, sha256({head} || {field.format('text')}) AS leaf, sha256({head} || {edited}) AS edited, CAST(doc_id AS VARCHAR) AS name FROM documents)",
        # crc32 bit by bit over the decimal digits
        """codes AS (
  SELECT name, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda d: ascii(d)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]),
      lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))) AS code
  FROM (SELECT DISTINCT name FROM read WHERE name IS NOT NULL))""",
        "placed AS (SELECT doc_id, source, leaf, CASE WHEN xor(code, 4294967295::BIGINT) % 2 = 0 THEN edited ELSE leaf END AS folded, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS c FROM read LEFT JOIN codes USING (name))",
        "leaves AS (SELECT source, p, c, leaf AS node FROM placed)",
        *climbed("a", "leaves", "source", leaf_levels),
        *walked("a", "placed", "w.source IS NOT DISTINCT FROM r.source", leaf_levels),
        f"trees AS (SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS c FROM a{leaf_levels})",
        "tops AS (SELECT p, c, node FROM trees)",
        *climbed("b", "tops", "0 AS one", tree_levels),
        f"rooted AS (SELECT d.* EXCLUDE (p, c), t.p, t.node AS subroot FROM aw{leaf_levels - 1} d JOIN trees t ON d.source IS NOT DISTINCT FROM t.source)",
        *walked("b", "rooted", "true", tree_levels),
    ]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified
FROM bw{tree_levels - 1}, b{tree_levels}
"""


ORACLE["op12_merkle"] = merkle_sql()
