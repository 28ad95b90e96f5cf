"""DuckDB SQL for the registered queries. Expected classes follow from the key alone, not from the parsers."""

from __future__ import annotations

from .documents import TODAY

_D = f"""
WITH d0 AS (
  SELECT o_orderkey AS k, c_name, o_orderpriority, o_orderstatus, o_orderdate::DATE AS day,
    ((o_totalprice::DECIMAL(18,2) * 100)::BIGINT % 1000000) AS cents,
    o_orderkey % 8 AS p, (o_orderkey // 8) % 5 AS f, (o_orderkey // 40) % 7 AS w, (o_orderkey // 280) % 6 AS g
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
), d1 AS (
  SELECT *, cents // 100 AS dollars, cents % 100 AS cc, day(day) AS dd, month(day) AS mm, year(day) % 100 AS yy FROM d0
), d2 AS (
  SELECT *,
    list_distinct(list_filter([day, CASE WHEN dd <= 12 THEN make_date(year(day), dd, mm) END,
      CASE WHEN yy BETWEEN 1 AND day(last_day(make_date(2000 + dd, mm, 1))) THEN make_date(2000 + dd, mm, yy) END], lambda x: x IS NOT NULL)) AS six
  FROM d1
), d AS (
  SELECT *,
    CASE WHEN g = 5 THEN 'ABSENT' WHEN g = 0 OR (g = 4 AND dd >= 10) THEN CASE WHEN dd <= 12 AND dd <> mm THEN 'AMBIGUOUS' ELSE 'OK' END
      WHEN g = 4 THEN 'UNPARSEABLE' WHEN g = 3 THEN CASE WHEN len(six) = 1 THEN 'OK' ELSE 'UNPARSEABLE' END ELSE 'OK' END AS date_status,
    CASE WHEN f = 3 THEN 'UNPARSEABLE' WHEN f = 4 THEN 'ABSENT' ELSE 'OK' END AS figures_status,
    CASE WHEN f IN (0, 2) THEN cents WHEN f = 1 THEN dollars * 100 END AS figure,
    CASE WHEN w = 5 THEN 'UNPARSEABLE' WHEN w = 6 THEN 'ABSENT' ELSE 'OK' END AS words_status,
    CASE p WHEN 4 THEN lower(replace(c_name, '#', ' ')) WHEN 5 THEN 'city of oshawa' WHEN 6 THEN NULL WHEN 0 THEN 'town of whitby' WHEN 1 THEN 'town of whitby'
      WHEN 2 THEN 'town of whitty' WHEN 3 THEN 'whitby taxes' ELSE 'town of witby' END AS payee,
    CASE p WHEN 4 THEN c_name WHEN 5 THEN 'City of Oshawa' WHEN 6 THEN NULL WHEN 0 THEN 'The Town of Whitby' WHEN 1 THEN 'TOWN OF WHITBY.'
      WHEN 2 THEN 'Town of Whitty' WHEN 3 THEN 'Whitby Taxes' ELSE 'Town of Witby' END AS payee_raw
  FROM d2
), r AS (
  SELECT *,
    CASE WHEN p = 6 THEN 'UNABLE' WHEN p IN (4, 5) THEN 'FAIL' ELSE 'PASS' END AS r_payee,
    CASE WHEN f >= 3 OR w >= 5 THEN 'UNABLE' WHEN w = 4 AND (dollars * 10 % 10000) * 100 <> figure THEN 'FAIL' ELSE 'PASS' END AS r_amount,
    CASE o_orderstatus WHEN 'O' THEN 'PASS' WHEN 'P' THEN 'FAIL' ELSE 'UNABLE' END AS r_signature,
    CASE WHEN date_status IN ('ABSENT', 'UNPARSEABLE') THEN 'UNABLE' WHEN day < DATE '{TODAY}' - INTERVAL 6 MONTH THEN 'FAIL' ELSE 'PASS' END AS r_date,
    CASE WHEN k % 11 = 0 THEN 'UNABLE' ELSE 'PASS' END AS r_memo
  FROM d
), v AS (
  SELECT *, CASE WHEN 'FAIL' IN (r_payee, r_amount, r_signature, r_date, r_memo) THEN 'INVALID'
    WHEN 'UNABLE' IN (r_payee, r_amount, r_signature, r_date, r_memo) THEN 'REVIEW' ELSE 'VALID' END AS verdict FROM r
), m AS (
  SELECT k, verdict, unnest(['payee', 'amount_match', 'signature', 'date', 'memo']) AS rule, unnest([r_payee, r_amount, r_signature, r_date, r_memo]) AS status FROM v
)
"""

DOCUMENTS = _D

_C = """
WITH c AS (
  SELECT o_orderkey AS k, c_name, CASE WHEN k % 7 <> 0 THEN c_name END AS a,
    CASE WHEN k % 13 = 0 THEN 'failed' WHEN k % 13 = 1 THEN 'not_run' WHEN k % 13 = 2 THEN 'skipped' ELSE 'completed' END AS run,
    CASE WHEN k % 17 = 0 THEN 'rejected' WHEN k % 13 = 1 THEN 'not_run' ELSE 'adjusted' END AS crop,
    CASE k % 5 WHEN 0 THEN upper(c_name) WHEN 1 THEN c_name || 'x' WHEN 2 THEN ' ' ELSE c_name END AS b
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
), s AS (
  SELECT *, CASE WHEN crop = 'rejected' THEN 'CROP_REJECTED' WHEN run = 'not_run' THEN 'TROCR_NOT_RUN' WHEN run = 'failed' THEN 'TROCR_FAILED'
    WHEN run = 'skipped' OR trim(b) = '' THEN CASE WHEN a IS NULL THEN 'BOTH_UNDETERMINED' ELSE 'DI_ONLY' END
    WHEN a IS NULL THEN 'TROCR_ONLY' WHEN a = b THEN 'AGREE_EXACT' WHEN lower(a) = lower(b) THEN 'AGREE_NORMALIZED' ELSE 'DISAGREE' END AS status
  FROM c
), cmp AS (
  SELECT *, CASE WHEN status IN ('CROP_REJECTED', 'TROCR_NOT_RUN', 'TROCR_FAILED') THEN a IS NULL ELSE status IN ('BOTH_UNDETERMINED', 'TROCR_ONLY', 'DISAGREE') END AS manual_review,
    CASE k % 3 WHEN 0 THEN 'payee' WHEN 1 THEN 'memo' ELSE 'amount_words' END AS field FROM s
)
"""

_BOX = """
WITH b AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 200 AS x, l_suppkey % 90 AS y, l_quantity::INT % 60 AS w,
    CASE WHEN l_orderkey % 19 = 0 THEN 'NO_POLYGON' WHEN l_linenumber = 7 THEN 'WRONG_PAGE' WHEN l_orderkey % 29 = 0 THEN 'MISSING_PAGE_INFO'
      WHEN l_orderkey % 23 = 0 THEN 'UNSUPPORTED_UNIT' WHEN l_quantity::INT % 60 = 0 THEN 'ZERO_AREA' ELSE 'OK' END AS status
  FROM lineitem
), q AS (
  SELECT *, least(599, 2 * x)::INT AS ax, least(299, 2 * y)::INT AS ay, least(599, 2 * (x + w))::INT AS bx, least(299, 2 * (y + 40))::INT AS by_ FROM b
), box AS (
  SELECT l_orderkey, l_linenumber, l_partkey, status, CASE WHEN status = 'OK' THEN ax END AS x0, CASE WHEN status = 'OK' THEN ay END AS y0, CASE WHEN status = 'OK' THEN bx END AS x1, CASE WHEN status = 'OK' THEN by_ END AS y1 FROM q
)
"""

_WORDS = """, below AS (
  SELECT i, nullif(concat_ws(' ', CASE WHEN i >= 100 THEN ones[i // 100] || ' hundred' END, CASE WHEN i % 100 < 20 THEN ones[i % 100] ELSE tens[i % 100 // 10] END, CASE WHEN i % 100 >= 20 THEN ones[i % 10] END), '') AS name
  FROM range(1000) t(i), (SELECT string_split('one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen', ' ') AS ones,
    string_split('ten twenty thirty forty fifty sixty seventy eighty ninety', ' ') AS tens)
), written AS (
  SELECT v, coalesce(nullif(concat_ws(' ', t.name || ' thousand', r.name), ''), 'zero') AS standard, CASE WHEN v >= 1000 THEN concat_ws(' ', h.name || ' hundred', e.name) END AS compact
  FROM range(10000) x(v) JOIN below t ON t.i = v // 1000 JOIN below r ON r.i = v % 1000 JOIN below h ON h.i = v // 100 JOIN below e ON e.i = v % 100
), forms AS (
  SELECT v, unnest([standard, compact]) AS form FROM written
)
"""

ORACLES = {
    "token_form_words": _D + _WORDS + "SELECT DISTINCT dollars, form FROM d JOIN forms ON v = dollars WHERE form IS NOT NULL",
    # only the class of tenfold amounts needs a comparison: each word of a form as often in the text, then the multiples of scales
    "token_match": _D + _WORDS + """, tenfold AS (
  SELECT k, dollars, dollars * 10 % 10000 AS ten, string_split(standard, ' ') AS words FROM d JOIN written ON v = dollars * 10 % 10000 WHERE w = 4
), complete AS (
  SELECT k, bool_or(list_bool_and(list_transform(string_split(form, ' '), lambda x: len(list_filter(string_split(form, ' '), lambda y: y = x)) <= len(list_filter(words, lambda y: y = x))))) AS complete
  FROM tenfold JOIN forms ON v = dollars AND form IS NOT NULL GROUP BY k
), claimed AS (
  SELECT k, complete, ten // 1000 IN (0, dollars // 1000) AS thousands,
    ten % 1000 // 100 IN (0, dollars % 1000 // 100, CASE WHEN dollars >= 1000 THEN CASE WHEN dollars // 100 < 20 OR dollars // 100 % 10 = 0 THEN dollars // 100 ELSE dollars // 100 % 10 END END) AS hundreds
  FROM tenfold JOIN complete USING (k)
) SELECT k, CASE WHEN w < 4 THEN 'matched' WHEN w = 5 OR NOT complete THEN 'tokens_missing' WHEN thousands AND coalesce(hundreds, false) THEN 'matched' ELSE 'contradiction' END AS outcome
FROM d LEFT JOIN claimed USING (k) WHERE w < 6""",
    "verdict_counts": _D + "SELECT count(*) AS total, count(*) FILTER (verdict = 'VALID') AS valid, count(*) FILTER (verdict = 'REVIEW') AS review, count(*) FILTER (verdict = 'INVALID') AS invalid FROM v",
    "rule_status_counts": _D + "SELECT status, count(*) AS n FROM m GROUP BY status",
    "rule_matrix": _D + "SELECT rule, status, count(*) AS n FROM m GROUP BY ALL",
    "verdicts": _D + "SELECT k, verdict, r_payee AS payee, r_amount AS amount_match, r_signature AS signature, r_date AS date, r_memo AS memo FROM v",
    "payee_check": _D + "SELECT k, payee, r_payee AS status FROM r",
    "payee_canonical": _D + "SELECT coalesce(payee, '') AS payee, count(*) AS n FROM d GROUP BY 1",
    "levenshtein_tokens": "SELECT p_partkey, list_min(list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> ''), lambda x: levenshtein(x, 'azure')))::INT AS distance FROM part",
    "amount_numeric_parse": _D + "SELECT k, figures_status AS status, figure::BIGINT AS cents FROM d",
    "amount_words_parse": _D + "SELECT k, words_status AS status, (CASE WHEN w < 4 THEN cents WHEN w = 4 THEN (dollars * 10 % 10000) * 100 END)::BIGINT AS cents, w IN (0, 2, 3) AS degraded FROM d",
    "date_parse": _D + "SELECT k, date_status AS status, CASE WHEN date_status IN ('OK', 'AMBIGUOUS') THEN day END AS date FROM d",
    "date_rule": _D + "SELECT k, r_date AS status FROM r",
    "age_months": f"SELECT o_orderkey AS k, datesub('month', o_orderdate::DATE, DATE '{TODAY}')::INT AS months FROM orders WHERE o_orderdate::DATE <= DATE '{TODAY}'",
    "signature_rule": _D + "SELECT r_signature AS status, count(*) AS n FROM r GROUP BY 1",
    "memo_rule": _D + "SELECT r_memo AS status, count(*) AS n FROM r GROUP BY 1",
    "reconcile_runs": "SELECT l_orderkey AS source_id, count(*)::INT AS n_runs, CASE WHEN count(DISTINCT l_quantity::BIGINT) = 1 THEN 'OK' ELSE 'AMBIGUOUS' END AS status, CASE WHEN count(DISTINCT l_quantity::BIGINT) = 1 THEN min(l_quantity::BIGINT) END AS value FROM lineitem GROUP BY 1",
    "dedup_by_hash": "SELECT min(event_id) AS event_id, sha256(user_id::VARCHAR || '|' || event_type) AS source_hash FROM events GROUP BY user_id, event_type",
    "next_record_id": """
WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day FROM orders),
old AS (SELECT day, count(*) AS n FROM o WHERE o_orderkey % 10 = 0 GROUP BY day)
SELECT o_orderkey, 'CHQ-' || o.day || '-' || lpad((coalesce(n, 0) + row_number() OVER (PARTITION BY o.day ORDER BY o_orderkey))::VARCHAR, 4, '0') AS record_id
FROM o LEFT JOIN old USING (day) WHERE o_orderkey % 10 <> 0""",
    "new_only_antijoin": "SELECT c_custkey AS id FROM customer WHERE c_name NOT IN (SELECT c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P')",
    "search_filter": "SELECT 'R' || c_custkey AS record_id FROM customer WHERE contains(lower('R' || c_custkey || ' ' || coalesce(c_name, '') || ' ' || coalesce(c_mktsegment, '') || ' ' || coalesce(c_name, '')), 'mach')",
    "year_filter": "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1997",
    "years_distinct": "SELECT DISTINCT year(o_orderdate)::VARCHAR AS year FROM orders",
    "sort_view": "SELECT c_custkey, floor(c_acctbal)::BIGINT::VARCHAR AS amount, row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal)::BIGINT::VARCHAR, c_custkey)::INT AS place FROM customer",
    "date_range": "SELECT strftime(min(o_orderdate), '%Y-%m-%d') || ' – ' || strftime(max(o_orderdate), '%Y-%m-%d') AS label FROM orders",
    "field_accuracy": _D + """, a AS (
  SELECT 'payee' AS field, p <> 6 AS scored, p IN (0, 1) AS matched FROM d
  UNION ALL SELECT 'signature', true, o_orderstatus = 'O' FROM d
  UNION ALL SELECT 'memo', true, k % 11 <> 0 FROM d)
SELECT coalesce(field, 'OVERALL') AS field, count(*) FILTER (scored) AS scored, count(*) FILTER (matched) AS matched FROM a GROUP BY ROLLUP (field)""",
    "accuracy_grid": _D + "SELECT k, CASE WHEN p = 6 THEN '-' WHEN p IN (0, 1) THEN 'Y' ELSE 'N' END AS payee, CASE WHEN o_orderstatus = 'O' THEN 'Y' ELSE 'N' END AS signature, CASE WHEN k % 11 = 0 THEN 'N' ELSE 'Y' END AS memo FROM d",
    "compare_field": _C + "SELECT k, status, manual_review FROM cmp",
    "agreement_eval": _C + """, e AS (SELECT unnest(['payee', 'memo', 'amount_words', 'signature']) AS field)
SELECT e.field, count(k) AS n, count(a) AS primary_read, count(*) FILTER (status = 'DISAGREE') AS disagree, count(*) FILTER (status = 'CROP_REJECTED') AS crop_rejected, count(*) FILTER (status = 'TROCR_FAILED') AS failed,
  count(*) FILTER (status = 'TROCR_NOT_RUN') AS not_run, count(*) FILTER (manual_review) AS manual_review, count(*) FILTER (status IN ('AGREE_EXACT', 'AGREE_NORMALIZED', 'AGREE_ALLOWLIST', 'DISAGREE')) AS compared
FROM e LEFT JOIN cmp ON e.field = cmp.field GROUP BY e.field""",
    "regression_flags": """
WITH y AS (SELECT l_returnflag AS field, year(l_shipdate) AS y, count(*)::DOUBLE AS lines, sum(l_linenumber)::DOUBLE AS numbers FROM lineitem GROUP BY 1, 2),
u AS (SELECT field, y, 'lines' AS metric, lines AS value FROM y UNION ALL SELECT field, y, 'numbers', numbers FROM y)
SELECT n.field, n.metric, n.value - b.value AS delta, n.value - b.value < -0.001 AS regressed FROM u n JOIN u b ON n.field = b.field AND n.metric = b.metric AND n.y = 1996 AND b.y = 1995""",
    "transition_counts": _D + """SELECT count(*) FILTER (w < 5 AND k % 5 = 0 AND k % 3 <> 0) AS improved, count(*) FILTER (w >= 5 OR (k % 5 = 0) = (k % 3 = 0)) AS unchanged, count(*) FILTER (w < 5 AND k % 5 <> 0 AND k % 3 = 0) AS regressed, count(*) FILTER (k % 4 = 3) AS confidence_up, count(*) FILTER (k % 4 = 1) AS confidence_down,
  count(*) FILTER (k % 4 = 2) AS confidence_flat, count(*) FILTER (k % 4 = 0) AS confidence_skipped FROM d""",
    "verdict_transitions": _D + f""", o AS (
  SELECT *, CASE WHEN date_status IN ('OK', 'AMBIGUOUS') AND day > DATE '{TODAY}' THEN 'INVALID' ELSE verdict END AS old_verdict FROM v)
SELECT old_verdict, verdict AS new_verdict, count(*) AS n FROM o WHERE old_verdict <> verdict GROUP BY ALL""",
    "override_overlay": _D + "SELECT rule, CASE WHEN k % 9 = 0 AND rule IN ('payee', 'signature') THEN 'PASS' ELSE status END AS status, count(*) AS n FROM m GROUP BY ALL",
    "override_integrity": _D + "SELECT k::VARCHAR AS record_id FROM r WHERE k % 9 = 0 AND r_signature <> 'PASS'",
    "geometry_convert": _BOX + "SELECT * FROM box",
    "crop_validate": _BOX + """, c AS (
  SELECT CASE WHEN status <> 'OK' THEN 'not_run' END AS s, x1 - x0 AS w, y1 - y0 AS h FROM box
), n AS (
  SELECT s, CASE WHEN s IS NULL THEN (w * h < 2000)::INT + (w * h / 180000.0 > 0.35)::INT + (NOT (w::DOUBLE / h BETWEEN 0.15 AND 25))::INT ELSE 0 END AS n_reasons FROM c
) SELECT coalesce(s, CASE WHEN n_reasons > 0 THEN 'rejected' ELSE 'adjusted' END) AS status, n_reasons, count(*) AS n FROM n GROUP BY ALL""",
    "similarity": "SELECT p_partkey, round(1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)), 6) AS similarity FROM part",
    "trigger_policy": "SELECT event_type, count(*) FILTER (event_id % 5 = 0 OR (event_id % 100) / 100.0 < CASE WHEN event_type = 'click' THEN 0.5 ELSE 0.7 END) AS triggered, count(*) AS n FROM events GROUP BY 1",
    "calibration_stats": """
WITH c AS (SELECT floor(c_acctbal)::BIGINT AS v, c_mktsegment = 'BUILDING' AS p FROM customer)
SELECT count(*) FILTER (p) AS n_real, min(v) FILTER (p) AS least_real, count(*) FILTER (NOT p) AS n_negative, max(v) FILTER (NOT p) AS most_negative, count(*) FILTER (v > 5000) AS n_present,
  min(v) FILTER (p) - max(v) FILTER (NOT p) AS separation, 5000 > max(v) FILTER (NOT p) AND 5000 < min(v) FILTER (p) AS inside FROM c""",
    "template_refusals": _D + "SELECT o_orderpriority AS template, count(*) AS n, min(k) AS first, max(k) AS last FROM v WHERE verdict <> 'VALID' GROUP BY 1",
    "batch_summary": _D + "SELECT count(*) AS found, count(*) FILTER (k % 3 = 0) AS skipped, count(*) FILTER (k % 3 <> 0 AND f <> 4 AND g <> 5) AS processed, count(*) FILTER (k % 3 <> 0 AND (f = 4 OR g = 5)) AS errors FROM d",
    "record_projection": _D + """SELECT k::VARCHAR AS record_id, '2' AS ruleset_version, verdict, payee AS payee_normalized, figure::BIGINT AS cents, CASE WHEN date_status IN ('OK', 'AMBIGUOUS') THEN day::VARCHAR END AS cheque_date,
  CASE o_orderstatus WHEN 'O' THEN true WHEN 'P' THEN false END AS signature_detected, CASE WHEN k % 11 <> 0 THEN o_orderpriority END AS memo, r_amount AS amount_match, NULL::DOUBLE AS date_confidence FROM v""",
    "revalidate": _D + f""", o AS (
  SELECT *, CASE WHEN date_status IN ('OK', 'AMBIGUOUS') AND day > DATE '{TODAY}' THEN 'INVALID' ELSE verdict END AS old_verdict,
    CASE WHEN k % 4 = 1 THEN [r_amount, r_date, r_memo] ELSE [r_payee, r_amount, r_signature, r_date, r_memo] END AS now FROM v WHERE k % 3 <> 0)
SELECT k::VARCHAR AS record_id, old_verdict, CASE WHEN list_contains(now, 'FAIL') THEN 'INVALID' WHEN list_contains(now, 'UNABLE') THEN 'REVIEW' ELSE 'VALID' END AS new_verdict,
  CASE WHEN k % 4 = 1 OR o_orderstatus = 'O' THEN true WHEN o_orderstatus = 'P' THEN false END AS signature_detected, k % 4 = 1 AS overlaid FROM o""",
    "stream_ingest": """WITH e AS (SELECT event_id, CASE WHEN event_id % 50 <> 0 AND user_id IS NOT NULL THEN sha256(user_id::VARCHAR || '|' || event_type) END AS source_hash FROM events)
SELECT min(event_id) AS event_id, source_hash FROM e WHERE source_hash IS NOT NULL GROUP BY source_hash UNION ALL SELECT event_id, source_hash FROM e WHERE source_hash IS NULL""",
    "payee_unicode": "SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS payee FROM customer",
    "distinctive_near": _D + "SELECT count(*) FILTER (p IN (0, 1, 3)) AS within_0, count(*) FILTER (p IN (0, 1, 2, 3, 7)) AS within_1, count(*) FILTER (p IN (0, 1, 2, 3, 7)) AS within_2 FROM d",
}
