"""Registered queries over judged cases and claims; importing this adds them to the catalog."""

from __future__ import annotations

from quarry.catalog import query
from quarry.operators import scoring as S
from quarry.plans.derived import VIEWS, view

VIEWS.update({
    "s_cases": """SELECT o_orderkey AS case_id, concat(CASE o_orderstatus WHEN 'F' THEN 'REFERENCE' WHEN 'O' THEN 'CANDIDATES' ELSE 'PARSER' END, '/', substr(o_orderpriority, 1, 1)) AS cell,
 CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'P' WHEN o_orderpriority LIKE '1%' THEN 'S' ELSE 'C' END AS capability, CASE o_orderstatus WHEN 'F' THEN 'REFERENCE' WHEN 'O' THEN 'CANDIDATES' ELSE 'PARSER' END AS kind,
 o_orderkey % 4 <> 0 AS positive, CASE o_orderkey % 7 WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'INFERRED' ELSE 'STATIC_RESOLVED' END AS resolution,
 CASE WHEN o_orderkey % 7 = 0 THEN array() ELSE targets END AS targets, CASE WHEN o_orderkey % 7 = 0 THEN 'DYNAMIC' END AS reason, o_custkey % 3 <> 0 AS valid, CASE WHEN o_custkey % 3 = 0 THEN array('E1') END AS diagnostics, o_orderkey % 11 = 0 AS must_not_resolve
 FROM (SELECT * FROM orders) o LEFT JOIN (SELECT l_orderkey, array_agg(DISTINCT concat('s', l_suppkey % 9)) AS targets FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey) t ON l_orderkey = o_orderkey""",
    "s_records": """SELECT CASE WHEN l_orderkey % 50 = 0 THEN -l_orderkey ELSE l_orderkey END AS case_id, 'REFERENCE/1' AS cell, seq, CASE WHEN l_orderkey % 7 = 0 AND seq % 2 = 0 THEN 'UNRESOLVED' WHEN l_orderkey % 7 = 1 THEN 'INFERRED' ELSE 'STATIC_RESOLVED' END AS resolution,
 CASE WHEN l_orderkey % 7 = 0 AND seq % 2 = 0 THEN array() WHEN seq % 5 = 0 THEN NULL ELSE targets END AS targets, CASE WHEN seq % 2 = 0 THEN 'DYNAMIC' END AS reason, l_orderkey % 3 <> 0 AS valid, CASE WHEN seq % 3 <> 0 THEN array('E2', 'E1') END AS diagnostics
 FROM (SELECT l_orderkey, seq, array_agg(DISTINCT concat('s', l_suppkey % 9)) AS targets FROM (SELECT l_orderkey, l_suppkey, l_returnflag, CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber ELSE 1 END AS seq FROM lineitem) x WHERE l_returnflag <> 'R' OR l_orderkey % 4 = 0 GROUP BY l_orderkey, seq) r
 UNION ALL SELECT l_orderkey, 'REFERENCE/1', l_linenumber + 100, 'STATIC_RESOLVED', array('s1'), NULL, TRUE, NULL FROM lineitem WHERE l_quantity > 45""",
})

CASES = """s AS (SELECT case_id, cell, capability, kind, positive, resolution, list_sort(coalesce(targets, [])) AS want, reason, valid, coalesce(diagnostics, []) AS errors, must_not_resolve FROM s_cases),
q AS (SELECT case_id, cell, seq, resolution, list_sort(coalesce(targets, [])) AS got, reason, valid, list_sort(coalesce(diagnostics, [])) AS errors FROM s_records),
k AS (SELECT s.*, (SELECT count(*) FROM q WHERE q.case_id = s.case_id) AS n FROM s),
f AS (SELECT case_id, arg_min(got, seq) AS got1, arg_min(valid, seq) AS valid1, arg_min(resolution, seq) AS resolution1, arg_min(errors, seq) AS errors1 FROM q GROUP BY case_id),
c AS (SELECT s.case_id, count(*) - count(DISTINCT (q.resolution, q.got, q.reason, q.valid, q.errors)) AS duplicates, count(*) FILTER (q.resolution = 'STATIC_RESOLVED') AS resolved,
 count(*) FILTER (len(q.got) = 0) AS blank, count(DISTINCT (q.resolution, q.reason)) FILTER (len(q.got) = 0) AS blanks, count(*) FILTER (len(q.got) = 0 AND q.resolution = s.resolution AND q.reason IS NOT DISTINCT FROM s.reason) AS kept,
 bool_or(len(q.got) > 0 AND q.resolution = s.resolution AND q.got = s.want) AS hit, sum(len(q.got)) AS named FROM s JOIN q ON q.case_id = s.case_id GROUP BY s.case_id),
m AS (SELECT k.*, f.*, coalesce(duplicates, 0) AS dup, coalesce(resolved, 0) AS resolved, coalesce(blank, 0) AS blank, coalesce(blanks, 0) AS blanks, coalesce(kept, 0) AS kept, coalesce(hit, false) AS hit, coalesce(named, 0) AS named, len(list_intersect(want, coalesce(got1, []))) AS same,
 len(coalesce(got1, [])) AS told, coalesce(valid1, false) AS good, coalesce(NOT valid1 AND list_has_all(errors1, errors), false) AS diagnosed FROM k LEFT JOIN f ON f.case_id = k.case_id LEFT JOIN c ON c.case_id = k.case_id),
g AS (SELECT cell, any_value(capability) AS capability, count(*) FILTER (positive) AS positive_cases, count(*) FILTER (NOT positive) AS negative_cases,
 sum(CASE kind WHEN 'PARSER' THEN CAST(valid AND good AS INT) WHEN 'REFERENCE' THEN CAST(hit AS INT) ELSE 0 END) AS tp,
 sum(CASE kind WHEN 'PARSER' THEN greatest(n - 1, 0) WHEN 'REFERENCE' THEN named - CASE WHEN hit THEN len(want) ELSE 0 END + blank - CASE WHEN resolution = 'UNRESOLVED' THEN least(kept, 1) ELSE blanks END ELSE 0 END) AS fp,
 sum(CASE WHEN kind = 'PARSER' THEN CAST(valid AND NOT good AS INT) WHEN kind = 'REFERENCE' AND NOT hit THEN len(want) ELSE 0 END) AS fn, sum(dup) AS duplicates,
 sum(CASE WHEN must_not_resolve OR resolution <> 'STATIC_RESOLVED' THEN resolved ELSE 0 END) AS false_resolved, count(*) FILTER (kind = 'PARSER' AND valid) AS valid_files, count(*) FILTER (kind = 'PARSER' AND valid AND good) AS valid_succeeded,
 count(*) FILTER (kind = 'PARSER' AND NOT valid) AS invalid_files, count(*) FILTER (kind = 'PARSER' AND NOT valid AND diagnosed) AS invalid_diagnosed,
 coalesce(sum(same) FILTER (kind = 'CANDIDATES'), 0) AS candidate_tp, coalesce(sum(named - same) FILTER (kind = 'CANDIDATES'), 0) AS candidate_fp, coalesce(sum(len(want) - same) FILTER (kind = 'CANDIDATES'), 0) AS candidate_fn,
 count(*) FILTER (kind = 'CANDIDATES') AS candidate_cases, count(*) FILTER (kind = 'CANDIDATES' AND coalesce(got1 = want AND resolution1 = resolution, false)) AS exact_candidate_cases,
 avg(same / nullif(told, 0)) FILTER (kind = 'CANDIDATES') AS candidate_macro_precision, avg(same / nullif(len(want), 0)) FILTER (kind = 'CANDIDATES') AS candidate_macro_recall,
 bool_or(kind = 'PARSER' AND n > 1) AS e1, bool_or(kind = 'PARSER' AND NOT valid AND NOT diagnosed) AS e2, bool_or(kind <> 'PARSER' AND resolution = 'UNRESOLVED' AND kept = 0) AS e3, bool_or(kind = 'CANDIDATES' AND n > 1) AS e4 FROM m GROUP BY cell),
u AS (SELECT cell, count(*) AS unmatched FROM q WHERE case_id NOT IN (SELECT case_id FROM s) GROUP BY cell),
r AS (SELECT g.*, coalesce(unmatched, 0) AS unmatched, tp / nullif(tp + fp, 0) AS "precision", tp / nullif(tp + fn, 0) AS recall, valid_succeeded / nullif(valid_files, 0) AS valid_file_success, invalid_diagnosed / nullif(invalid_files, 0) AS invalid_diagnostic_recall,
 candidate_tp / nullif(candidate_tp + candidate_fp, 0) AS candidate_precision, candidate_tp / nullif(candidate_tp + candidate_fn, 0) AS candidate_recall, exact_candidate_cases / nullif(candidate_cases, 0) AS candidate_exact FROM g LEFT JOIN u USING (cell)),
w AS (SELECT *, CASE WHEN tp + fp > 0 THEN ("precision" + 3.8416 / (2 * (tp + fp)) - 1.96 * sqrt("precision" * (1 - "precision") / (tp + fp) + 3.8416 / (4 * (tp + fp) * (tp + fp)))) / (1 + 3.8416 / (tp + fp)) END AS precision_lower FROM r),
z AS (SELECT * EXCLUDE (e1, e2, e3, e4), array_to_string(list_sort(list_filter([CASE WHEN e1 THEN 'DUPLICATE_PARSER_RESULT' END, CASE WHEN e2 OR capability = 'P' AND invalid_diagnostic_recall < 1 THEN 'INVALID_DIAGNOSTIC_MISSING' END, CASE WHEN e3 THEN 'ABSTENTION_MISSING' END, CASE WHEN e4 THEN 'DUPLICATE_CANDIDATE_SET' END,
 CASE WHEN capability = 'P' AND valid_file_success < 0.99 THEN 'PARSE_SUCCESS_BELOW_THRESHOLD' END, CASE WHEN capability <> 'P' AND "precision" < 0.99 THEN 'PRECISION_BELOW_THRESHOLD' END, CASE WHEN capability = 'S' AND recall < 0.95 OR capability = 'C' AND recall < 0.9 THEN 'RECALL_BELOW_THRESHOLD' END,
 CASE WHEN capability = 'C' AND tp + fp >= 200 AND precision_lower < 0.95 THEN 'WILSON_BELOW_THRESHOLD' END, CASE WHEN capability <> 'P' AND candidate_precision < 0.9 THEN 'CANDIDATE_PRECISION_BELOW_THRESHOLD' END, CASE WHEN capability <> 'P' AND candidate_recall < 0.9 THEN 'CANDIDATE_RECALL_BELOW_THRESHOLD' END,
 CASE WHEN capability <> 'P' AND candidate_exact < 0.85 THEN 'CANDIDATE_EXACT_SET_BELOW_THRESHOLD' END, CASE WHEN false_resolved > 0 THEN 'FALSE_RESOLVED' END, CASE WHEN unmatched > 0 THEN 'ANNOTATION_REVIEW_REQUIRED' END], lambda x: x IS NOT NULL)), ',') AS failure_codes FROM w)"""


def scored(spark, d):
    return S.score_accuracy(*(view(spark, d, v).withColumnRenamed("case_id", "case") for v in ("s_cases", "s_records")))


@query(f"+ {CASES} SELECT * FROM z")
def accuracy_scores(spark, d):
    """Orders as judged cases, line items as claims about them: references, candidate sets, parser results and abstentions."""
    return scored(spark, d)


@query(f'+ {CASES} SELECT count(*) AS cells, count(*) FILTER (failure_codes <> \'\') AS failed, avg("precision") AS "precision", avg(recall) AS recall FROM z')
def accuracy_macro(spark, d):
    return S.macro_means(scored(spark, d))
