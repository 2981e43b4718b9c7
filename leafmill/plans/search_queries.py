"""Key lookup: exact, forward, backward, merged, many terms, normalized keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators import search
from leafmill.plans.registry import query


def _phase_sql(tbl: str, key: str, ident: str, phases: list[str], term: str, norm: str, limit: int) -> str:
    tests = {"exact": f"k = '{term}'", "forward": f"starts_with(k, '{term}')", "backward": f"ends_with(k, '{term}')"}
    case = " ".join(f"WHEN {tests[p]} THEN {search.PHASES.index(p)}" for p in phases)
    return f"""
WITH keyed AS (SELECT {ident}, {key} AS matched_key, {norm} AS k FROM {tbl}),
hits AS (SELECT *, CASE {case} END AS phase FROM keyed),
top AS (SELECT *, ROW_NUMBER() OVER (ORDER BY phase, k, {ident}) AS hit_id FROM hits WHERE phase IS NOT NULL)
SELECT CAST(hit_id AS INTEGER) AS hit_id, CASE phase WHEN 0 THEN 'exact' WHEN 1 THEN 'forward' ELSE 'backward' END AS profile, matched_key, {ident}
FROM top WHERE hit_id <= {limit}
"""


NORM_SQL = "translate(regexp_replace(trim({0}), '[\\s\\-]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query(_phase_sql("part", "p_name", "p_partkey", ["exact"], "red plate", "p_name", 100))
def search_exact(t):
    return search.search(t("part"), "p_name", "red plate", ["exact"], ["p_partkey"], 100)


@query(_phase_sql("part", "p_name", "p_partkey", ["forward"], "small", "p_name", 100))
def search_forward(t):
    return search.search(t("part"), "p_name", "small", ["forward"], ["p_partkey"], 100)


@query(_phase_sql("customer", "c_name", "c_custkey", ["backward"], "77", "c_name", 100))
def search_backward(t):
    return search.search(t("customer"), "c_name", "77", ["backward"], ["c_custkey"], 100)


@query(_phase_sql("part", "p_name", "p_partkey", search.PHASES, "RING", NORM_SQL.format("p_name"), 200))
def search_native_merged(t):
    """Exact, then forward, then backward on normalized keys; each part once; one limit."""
    return search.search(t("part"), "p_name", "ring", search.PHASES, ["p_partkey"], 200, text.ascii_key(F.col("p_name")), "RING")


@query("""
WITH terms AS (SELECT DISTINCT substr(p_name, 1, 5) AS term FROM part WHERE p_size <= 3 AND length(p_name) >= 5),
hits AS (
  SELECT term, p_name AS matched_key, p_partkey, ROW_NUMBER() OVER (PARTITION BY term ORDER BY p_name, p_partkey) AS hit_id
  FROM part JOIN terms ON starts_with(p_name, term))
SELECT term, CAST(hit_id AS INTEGER) AS hit_id, matched_key, p_partkey FROM hits WHERE hit_id <= 20
""")
def search_batch(t):
    """Prefixes of small parts' names looked up in all names."""
    terms = t("part").filter("p_size <= 3").select(F.substring("p_name", 1, 5).alias("term"))
    return search.search_many(t("part"), "p_name", terms, "term", ["p_partkey"], 20, 5)


@query("""
WITH terms AS (SELECT DISTINCT substr(p_name, 1, 1 + p_size % 7) AS term FROM part WHERE p_size <= 14),
hits AS (
  SELECT term, p_name AS matched_key, p_partkey, ROW_NUMBER() OVER (PARTITION BY term ORDER BY p_name, p_partkey) AS hit_id
  FROM part JOIN terms ON starts_with(p_name, term))
SELECT term, CAST(hit_id AS INTEGER) AS hit_id, matched_key, p_partkey FROM hits WHERE hit_id <= 20
""")
def search_short_terms(t):
    """Prefixes of one to seven characters looked up in all names."""
    terms = t("part").filter("p_size <= 14").select(F.expr("substring(p_name, 1, 1 + p_size % 7)").alias("term"))
    return search.search_many(t("part"), "p_name", terms, "term", ["p_partkey"], 20, 5)


@query(f"""
SELECT doc_id, {NORM_SQL.format("split_part(text, chr(10), 1)")} AS line_key FROM documents WHERE text IS NOT NULL
""")
def search_normalized_key(t):
    """ASCII lookup key of every document's first line."""
    docs = t("documents").filter("text is not null")
    return docs.select("doc_id", text.ascii_key(F.element_at(F.split("text", "\n"), 1)).alias("line_key"))


@query(r"""
WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, translate(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '[\p{Z}\p{Pd}・･−]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS reader_key,
  regexp_replace(line, '[\p{Z}\p{P}\p{Cf}]', '', 'g') AS author_key FROM d
""")
def search_unicode_key(t):
    """Reader and author lookup keys of every document's first line, with NFKC and Unicode categories."""
    line = F.element_at(F.split("text", "\n"), 1)
    return t("documents").filter("text is not null").select("doc_id", text.normalized_reader(line).alias("reader_key"), text.normalized_author(line).alias("author_key"))
