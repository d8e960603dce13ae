"""One registered query per operator, with production parameters over whole tables; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (boosted_quality, divergence, license_scan, mixing, near_lines, ngram_groups, orc_tokens, outliers, pieces, suffix_dedup,
               toxic_spans, vector_graphs, whitening)
from .common import table

#: the smallest node that each node of the edges e (x, y) and nodes v (node) reaches
_REACHED = """e2 AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(node, other) AS (SELECT node, node FROM v UNION SELECT r.node, e2.y FROM r JOIN e2 ON r.other = e2.x),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)"""

_NEAR_DOCUMENTS = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
v AS (SELECT doc_id AS node FROM documents), """ + _REACHED + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON d.doc_id = c.node"""

_NEAR_VECTORS = """WITH RECURSIVE w AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM w a JOIN w b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
v AS (SELECT vec_id AS node FROM w), """ + _REACHED + """,
k AS (SELECT x, count(*) AS n FROM e2 GROUP BY x)
SELECT node AS vec_id, coalesce(n, 0) AS n_links, component_id, node = component_id AS kept FROM c LEFT JOIN k ON node = x"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def wrap(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return wrap


@registered("op1_robust_outliers")
def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@registered("op10_ngram_groups", _NEAR_DOCUMENTS)
def op10_ngram_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups.near_documents(table(spark, sf_dir, "documents"))


@registered("op4_near_lines")
def op4_near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_lines.line_counts(table(spark, sf_dir, "documents"))


@registered("op2_pivotal_mix")
def op2_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@registered("op8_pieces")
def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"))


@registered("op7_orc_tokens")
def op7_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.digests(table(spark, sf_dir, "documents"))


@registered("op5_boosted_quality")
def op5_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosted_quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered("op6_toxic_spans")
def op6_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_spans.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered("op9_license_scan", license_scan.sql())
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


@registered("op3_vector_graphs", _NEAR_VECTORS)
def op3_vector_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graphs.near_vectors(table(spark, sf_dir, "embeddings"))


@registered("op11_divergence", divergence.sql())
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


@registered("op12_suffix_dedup")
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


@registered("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))
