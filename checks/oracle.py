"""SQL that a plain SQL engine runs on the driver's tables to check each query."""

from __future__ import annotations

from checks import fixture_rules as rules

# --- shared relations ---------------------------------------------------------------------

REPORTS = """reports AS (
  SELECT concat('US-CASE-', cast(l_orderkey AS varchar)) AS case_id,
    concat('PAT-', cast(o_custkey AS varchar)) AS patient_id,
    cast(18 + o_custkey % 72 AS integer) AS patient_age,
    CASE WHEN o_custkey % 20 < 11 THEN 'Female' ELSE 'Male' END AS patient_sex,
    cast(date '1940-01-01' + cast(o_custkey % 20000 AS integer) AS date) AS patient_dob,
    c_acctbal AS patient_weight,
    p_brand AS drug_name,
    concat(cast(p_size AS varchar), 'mg') AS drug_dose,
    p_type AS drug_route,
    cast(o_orderdate AS date) AS drug_start_date,
    split_part(p_name, ' ', 1) AS indication,
    p_name AS ae_term,
    CASE l_returnflag WHEN 'R' THEN 'Severe' WHEN 'A' THEN 'moderate' ELSE 'Mild' END AS ae_severity,
    CASE o_orderpriority WHEN '5-LOW' THEN 'Non-serious' WHEN '4-NOT SPECIFIED' THEN NULL
      WHEN '3-MEDIUM' THEN 'Hospitalization' WHEN '2-HIGH' THEN 'Life-threatening'
      ELSE 'Death' END AS ae_seriousness,
    CASE o_orderstatus WHEN 'F' THEN 'Fatal' WHEN 'O' THEN 'Recovered' ELSE 'Unknown' END AS ae_outcome,
    CASE WHEN l_shipdate >= o_orderdate THEN cast(l_shipdate AS date) END AS ae_onset_date,
    CASE l_linenumber % 5 WHEN 0 THEN 'Physician' WHEN 1 THEN 'Pharmacist'
      WHEN 2 THEN 'Consumer/Patient' WHEN 3 THEN 'Nurse' ELSE 'Other HCP' END AS reporter_type,
    cast(l_shipdate AS date) AS report_date,
    cn.n_name AS country,
    r_name AS manufacturer,
    l_shipdate AS created_at
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN region ON sn.n_regionkey = r_regionkey
)"""

FACT = (
    REPORTS
    + """, fact AS (
  SELECT case_id, patient_id, drug_name, drug_dose, drug_route, drug_start_date, ae_term,
    split_part(ae_term, ' ', 2) AS ae_soc_class, cast(1.0 AS double) AS ae_classification_score,
    ae_severity, ae_seriousness, ae_outcome, ae_onset_date,
    cast(date_diff('day', drug_start_date, ae_onset_date) AS integer) AS onset_days,
    reporter_type, report_date, country, manufacturer
  FROM reports
), dim_patient AS (
  SELECT DISTINCT patient_id, patient_age, patient_sex, patient_dob, patient_weight, country
  FROM reports
), dim_drug AS (
  SELECT DISTINCT drug_name, drug_dose, drug_route, indication, manufacturer FROM reports
)"""
)

RENDERED = (
    REPORTS
    + """, narratives AS (
  SELECT case_id, report_date, created_at AS generated_at,
    'Patient: ' || patient_sex || ', aged ' || cast(patient_age AS varchar) || ', weight '
    || coalesce(cast(patient_weight AS varchar), 'unknown') || ' kg, received ' || drug_name || ' '
    || drug_dose || ' (' || drug_route || ') for ' || indication || ' and developed ' || ae_term
    || ' (severity: ' || ae_severity || ', seriousness: ' || ae_seriousness || ') after '
    || cast(date_diff('day', drug_start_date, ae_onset_date) AS varchar)
    || ' days. The outcome was ' || ae_outcome || '.' AS narrative_text
  FROM reports
)"""
)


def _values(words) -> str:
    return ", ".join("'" + w + "'" for w in sorted(set(words)))


def _tokens(text: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), "
        "lambda t: t <> '')"
    )


def _count(words_column: str, words) -> str:
    return f"len(list_filter({words_column}, lambda t: t IN ({_values(words)})))"


def _tone(words_column: str) -> str:
    total = " + ".join(
        f"({w!r}) * {_count(words_column, [t for t, x in rules.TONE.items() if x == w])}"
        for w in sorted(set(rules.TONE.values()))
    )
    hits = _count(words_column, rules.TONE)
    return f"round(coalesce(cast({total} AS double) / nullif({hits}, 0), 0.0), 6)"


FIELDS = {
    "primary_drug": r"received ([A-Za-z0-9#-]+)",
    "adverse_event": r"developed ([A-Za-z -]+) \(severity",
    "severity_assessment": r"\(severity: ([A-Za-z]+)",
    "patient_outcome": r"outcome was ([A-Za-z ]+)\.",
    "onset_days": r"after (\d+) days",
    "causality": r"causality (?:was )?(?:assessed as )?(certain|probable|possible|unlikely)",
    "dechallenge_result": r"dechallenge (?:was )?(positive|negative|not done)",
}
_FIELD_SQL = ", ".join(
    f"nullif(regexp_extract(narrative_text, '{p}', 1), '') AS {n}" for n, p in FIELDS.items()
)
_CONCOMITANT = (
    "nullif(array_to_string(regexp_extract_all(narrative_text, 'together with ([A-Za-z0-9#-]+)',"
    " 1), ', '), '') AS concomitant_drugs"
)

ENRICHED = (
    RENDERED
    + f""", worded AS (
  SELECT *, {_tokens("narrative_text")} AS w, {_FIELD_SQL}, {_CONCOMITANT} FROM narratives
), fact_narrative AS (
  SELECT case_id, narrative_text, 'INITIAL' AS narrative_type, primary_drug AS extracted_drug,
    adverse_event AS extracted_ae, severity_assessment AS extracted_severity,
    patient_outcome AS extracted_outcome, try_cast(onset_days AS bigint) AS extracted_onset_days,
    causality AS extracted_causality, dechallenge_result, concomitant_drugs,
    CASE WHEN narrative_text IS NOT NULL THEN {_tone("w")} END AS narrative_sentiment,
    generated_at
  FROM worded
)"""
)

DOC_NARRATIVES = """narratives AS (
  SELECT concat('US-CASE-', cast(doc_id AS varchar)) AS case_id, text AS narrative_text,
    'INITIAL' AS narrative_type, timestamp '2024-01-01 00:00:00' AS generated_at
  FROM documents WHERE text IS NOT NULL
)"""

EXTRACTIONS = """lines AS (
  SELECT *, concat('call_', cast(l_orderkey AS varchar), '.mp3') AS file_name,
    NOT (l_linenumber = 5 AND l_orderkey % 11 = 0) AS has_record,
    o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_serious,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '15_day_expedited'
      WHEN o_orderpriority = '3-MEDIUM' THEN '90_day_periodic'
      ELSE 'no_report_required' END AS deadline,
    CASE WHEN l_linenumber = 7 THEN 0 WHEN l_linenumber = 6 THEN 2 ELSE 1 END AS n_events
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), event_lines AS (
  SELECT *, p_name AS term FROM lines WHERE has_record AND n_events >= 1
  UNION ALL
  SELECT *, concat('second ', p_name) AS term FROM lines WHERE has_record AND n_events = 2
), fact_calls AS (
  SELECT file_name AS source_call_id, 'CALL_CENTER' AS data_source, p_brand AS drug_name,
    concat(cast(p_size AS varchar), 'mg') AS drug_dose, p_type AS drug_route,
    term AS ae_preferred_term, split_part(p_name, ' ', 2) AS ae_soc_class,
    CASE WHEN is_serious THEN 'hospitalization, medically_significant' ELSE 'none' END
      AS ae_seriousness,
    CASE o_orderstatus WHEN 'F' THEN 'fatal' ELSE 'recovered' END AS ae_outcome,
    CASE WHEN l_linenumber % 2 = 0 THEN 'probable' ELSE 'possible' END AS causality,
    cast(18 + o_custkey % 72 AS varchar) AS patient_age,
    CASE WHEN o_custkey % 20 < 11 THEN 'Female' ELSE 'Male' END AS patient_sex,
    deadline AS reporting_deadline, concat('Report on ', p_brand) AS case_narrative,
    o_orderdate AS report_date
  FROM event_lines WHERE o_orderstatus <> 'P'
)"""

COMPLIANCE = """fact_compliance AS (
  SELECT concat('call_', cast(o_orderkey AS varchar), '.mp3') AS call_id,
    cast(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 101 END AS double)
      AS compliance_score,
    o_totalprice > 250000 AS tone_professional,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'distressed' WHEN '2-HIGH' THEN 'concerned'
      WHEN '3-MEDIUM' THEN 'confused' ELSE 'calm' END AS caller_state,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'elevated'
      ELSE 'routine' END AS urgency_level,
    CASE o_orderstatus WHEN 'P' THEN 'standard_drug_info' ELSE 'adverse_event_report' END
      AS call_type,
    o_orderstatus = 'P' AS escalation_needed,
    CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS escalation_reason,
    o_orderdate AS analyzed_at
  FROM orders WHERE o_orderkey % 97 <> 0
)"""

_DAY = f"date '{rules.TRIAGE_DAY.isoformat()}'"
QUEUE = (
    EXTRACTIONS
    + ", "
    + COMPLIANCE
    + f""", queue AS (
  SELECT source_call_id, drug_name, ae_preferred_term, ae_soc_class, ae_seriousness, ae_outcome,
    reporting_deadline, case_narrative, patient_age, patient_sex, compliance_score, caller_state,
    urgency_level,
    CASE reporting_deadline
      WHEN '15_day_expedited' THEN cast(report_date AS date) + 15
      WHEN '90_day_periodic' THEN cast(report_date AS date) + 90 END AS submission_deadline,
    CASE WHEN reporting_deadline = '15_day_expedited'
        AND cast(report_date AS date) + 15 <= {_DAY} + 3 THEN 'URGENT'
      WHEN reporting_deadline = '15_day_expedited' THEN 'ACTION_REQUIRED'
      ELSE 'STANDARD' END AS priority_flag,
    report_date
  FROM fact_calls LEFT JOIN fact_compliance ON source_call_id = call_id
)"""
)

EVENTS = """calls_log AS (
  SELECT ts AS "timestamp", event_type AS function_name,
    concat('model-', cast(user_id % 3 AS varchar)) AS model_used,
    cast(event_id AS varchar) AS input_file, cast(round(value) AS bigint) AS latency_ms,
    cast(json_extract(props, '$.k') AS bigint) AS token_count,
    CASE WHEN cast(json_extract(props, '$.k') AS bigint) < 15 THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN cast(json_extract(props, '$.k') AS bigint) < 15 THEN 'timeout' END AS error_message
  FROM events
), health AS (
  SELECT date_trunc('hour', "timestamp") AS hour, function_name, model_used,
    count(*) AS total_calls, count(*) FILTER (status = 'error') AS error_count,
    round(avg(latency_ms), 0) AS avg_latency_ms, cast(sum(token_count) AS bigint) AS total_tokens
  FROM calls_log GROUP BY 1, 2, 3
)"""


def _transcripts(line: str, ending: str) -> str:
    said = "text" if line == "text" else "concat(role, '|', text)"
    return f"""SELECT concat('calls/call_', cast(conv_id AS varchar), '.{ending}') AS file_path,
      concat('call_', cast(conv_id AS varchar), '.{ending}') AS file_name,
      cast(date '2024-01-01' + cast(conv_id % 365 AS integer) AS timestamp) AS received_at,
      string_agg({line}, chr(10) ORDER BY turn) AS text, cast(count(*) AS integer) AS n_segments,
      string_agg(concat(turn, '|', {said}), chr(10) ORDER BY turn) AS segments
    FROM conversations GROUP BY conv_id"""


def _intelligence(ending: str, agent: str) -> str:
    r = rules.CALL_RULES

    def sums(prefix: str, groups, only: str = "true") -> str:
        return ", ".join(
            f"sum(CASE WHEN {only} THEN {_count('w', words)} ELSE 0 END) AS {prefix}{name}"
            for name, words in groups.items()
        )

    def first(prefix: str, groups, default: str) -> str:
        whens = " ".join(f"WHEN {prefix}{n} > 0 THEN '{n}'" for n in groups)
        return f"CASE {whens} ELSE '{default}' END"

    score = " + ".join(f"CASE WHEN said_{n} > 0 THEN 1 ELSE 0 END" for n in r.compliance)
    best = "greatest(" + ", ".join(f"type_{n}" for n in r.call_types) + ")"
    kinds = " ".join(f"WHEN {best} > 0 AND type_{n} = {best} THEN '{n}'" for n in r.call_types)
    m = r.words_per_minute
    return f"""WITH turns AS (
      SELECT conv_id, role, {_tokens("text")} AS w FROM conversations
    ), sums AS (
      SELECT conv_id, sum(len(w)) AS n_words, {sums("emotion_", r.emotions)},
        {sums("urgency_", r.urgency)}, {sums("type_", r.call_types)},
        {sums("said_", r.compliance, agent)},
        sum(CASE WHEN {agent} THEN {_count("w", r.rude)} ELSE 0 END) AS rude
      FROM turns GROUP BY conv_id
    ), named AS (
      SELECT conv_id, {first("emotion_", r.emotions, "calm")} AS state,
        {first("urgency_", r.urgency, "routine")} AS urgency,
        cast({score} AS double) * 100.0 / {len(r.compliance)} AS score, rude = 0 AS professional,
        CASE WHEN n_words < {2 * m} THEN 'brief_under_2min'
          WHEN n_words <= {8 * m} THEN 'standard_2_to_8min' ELSE 'extended_over_8min' END
          AS duration,
        CASE {kinds} ELSE 'unknown' END AS call_type
      FROM sums
    ), reasoned AS (
      SELECT *, nullif(concat_ws(', ',
        CASE WHEN urgency IN ('urgent', 'emergency') THEN 'urgency ' || urgency END,
        CASE WHEN state IN ('distressed', 'angry') AND call_type = 'adverse_event_report'
          THEN 'caller ' || state END,
        CASE WHEN NOT professional THEN 'agent tone' END), '') AS reason
      FROM named
    )
    SELECT concat('call_', cast(conv_id AS varchar), '.{ending}') AS file_name,
      state AS caller_emotional_state, urgency AS caller_urgency_level,
      cast(0 AS integer) AS ae_acoustic_signals, score AS agent_compliance_score,
      professional AS agent_tone_professional, duration AS call_duration_category,
      call_type AS call_type_inferred, reason IS NOT NULL AS escalation_recommended,
      reason AS escalation_reason
    FROM reasoned"""


def _extraction_relations() -> str:
    r = rules.EXTRACTION_RULES
    total = lambda words: f"sum({_count('w', words)})"
    sums = ", ".join(
        f"{total(words)} AS {prefix}{name}"
        for prefix, groups in (
            ("serious_", r.seriousness),
            ("outcome_", r.outcomes),
            ("causal_", r.causality),
        )
        for name, words in groups.items()
    )

    def early(value: str, name: str) -> str:
        return f"arg_min({value}, turn) FILTER ({value} IS NOT NULL) AS {name}"

    def found(pattern: str) -> str:
        return f"nullif(regexp_extract(text, '{pattern}', 1), '')"

    route = f"list_filter(w, lambda t: t IN ({_values(r.routes)}))[1]"
    criteria = ", ".join(
        f"CASE WHEN serious_{n} > 0 THEN '{n}' END" for n in r.seriousness
    )
    outcomes = " ".join(f"WHEN outcome_{n} > 0 THEN '{n}'" for n in r.outcomes)
    causes = " ".join(f"WHEN causal_{n} > 0 THEN '{n}'" for n in r.causality)
    terms = ", ".join(f"('{p}', 'event', '{n}', '{c}')" for p, n, c in rules.TERM_PHRASES)
    drugs = ", ".join(f"('{p}', 'drug', '{n}', NULL)" for p, n in rules.DRUG_PHRASES)
    return f"""turns AS (
      SELECT conv_id, turn, text, {_tokens("text")} AS w FROM conversations
    ), features AS (
      SELECT conv_id, {sums}, {total(r.female)} AS female, {total(r.male)} AS male,
        {total(r.quality)} AS quality, {total(r.off_label)} AS off_label,
        {early(found(r.age_pattern), "age")}, {early(found(r.id_pattern), "identifier")},
        {early(found(r.dose_pattern), "dose")}, {early(route, "route")}
      FROM turns GROUP BY conv_id
    ), grams AS (
      SELECT DISTINCT conv_id, turn, text, unnest(list_concat(w, list_transform(
        range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(
        range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')), list_transform(
        range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS phrase
      FROM turns
    ), lexicon(phrase, kind, name, soc) AS (VALUES {terms}, {drugs}),
    mentions AS (
      SELECT conv_id, kind, name, min(soc) AS soc, min(turn) AS turn,
        arg_min(text, turn) AS text
      FROM grams JOIN lexicon USING (phrase) GROUP BY conv_id, kind, name
    ), event_names AS (
      SELECT conv_id, list(name ORDER BY name) AS names, arg_min(text, name) AS verbatim,
        string_agg(text, '|' ORDER BY name) AS verbatims, string_agg(soc, ',' ORDER BY name) AS classes,
        arg_min(soc, name) AS soc
      FROM mentions WHERE kind = 'event' GROUP BY conv_id
    ), drug_names AS (
      SELECT conv_id, arg_min(name, struct_pack(turn := turn, name := name)) AS drug_name
      FROM mentions WHERE kind = 'drug' GROUP BY conv_id
    ), joined AS (
      SELECT f.*, n.names, n.verbatim, n.verbatims, n.classes, n.soc, d.drug_name,
        list_filter([{criteria}], lambda x: x IS NOT NULL) AS criteria,
        CASE {outcomes} ELSE 'unknown' END AS outcome,
        CASE WHEN d.drug_name IS NULL THEN 'unassessable' {causes} ELSE 'possible' END AS causality,
        CASE WHEN female > male THEN 'Female' WHEN male > female THEN 'Male' END AS sex
      FROM features f LEFT JOIN event_names n ON f.conv_id = n.conv_id
        LEFT JOIN drug_names d ON f.conv_id = d.conv_id
    ), extracted AS (
      SELECT conv_id, names IS NOT NULL AS ae_detected,
        CASE WHEN names IS NULL THEN 'no_ae'
          WHEN drug_name IS NULL OR coalesce(age, sex, identifier) IS NULL THEN 'incomplete'
          WHEN dose IS NOT NULL AND route IS NOT NULL THEN 'complete'
          ELSE 'minimum_criteria_met' END AS icsr_completeness,
        coalesce(array_to_string(names, ','), '') AS terms,
        coalesce(verbatims, '') AS verbatims, coalesce(classes, '') AS classes,
        verbatim AS first_verbatim,
        soc AS first_class,
        CASE WHEN names IS NULL THEN NULL WHEN len(criteria) = 0 THEN 'none'
          ELSE array_to_string(criteria, ',') END AS seriousness,
        CASE WHEN names IS NOT NULL THEN outcome END AS outcome,
        CASE WHEN names IS NOT NULL THEN causality END AS causality,
        drug_name, dose AS drug_dose, route AS drug_route, age, sex, identifier,
        quality > 0 AS product_quality_complaint, off_label > 0 AS off_label_use_mentioned,
        CASE WHEN names IS NULL THEN 'no_report_required'
          WHEN len(criteria) > 0 THEN '15_day_expedited' ELSE '90_day_periodic' END
          AS reporting_deadline,
        CASE WHEN names IS NOT NULL THEN coalesce(drug_name, 'unknown drug') || ': '
          || array_to_string(names, ', ') || '; outcome ' || outcome END AS narrative_summary
      FROM joined
    )"""


def _extraction(ending: str) -> str:
    return f"""WITH {_extraction_relations()}
    SELECT concat('call_', cast(conv_id AS varchar), '.{ending}') AS file_name,
      extracted.* EXCLUDE (conv_id) FROM extracted"""


def _fact(sql: str) -> str:
    return f"WITH {FACT} {sql}"


_VIEW_SUMMARY = """SELECT drug_name, patient_sex, indication, count(*) AS n,
  cast(sum(onset_days) AS bigint) AS onset_total, cast(sum(patient_age) AS bigint) AS age_total
  FROM view GROUP BY ALL"""

_MEASURES = {
    "total_cases": "count(DISTINCT case_id)",
    "total_patients": "count(DISTINCT patient_id)",
    "fatal_cases": "count(CASE WHEN ae_outcome = 'Fatal' THEN 1 END)",
    "severe_cases": "count(CASE WHEN lower(ae_severity) = 'severe' THEN 1 END)",
    "serious_cases": "count(CASE WHEN ae_seriousness <> 'Non-serious' THEN 1 END)",
    "fatal_rate": "round(cast(count(CASE WHEN ae_outcome = 'Fatal' THEN 1 END) AS double) * 100 "
    "/ count(*), 6)",
    "avg_onset_days": "round(avg(onset_days), 6)",
    "median_onset_days": "round(median(onset_days), 6)",
}
_PATIENT_MEASURES = {
    "avg_patient_age": "round(avg(patient_age), 6)",
    "patient_count": "count(DISTINCT patient_id)",
}


def _patient_measure(name: str, expr: str) -> str:
    return _fact(
        f"SELECT drug_name, {expr} AS {name} FROM (SELECT DISTINCT drug_name, patient_id FROM fact) "
        "JOIN dim_patient USING (patient_id) GROUP BY drug_name"
    )


def _prr(pairs: str, event: str, threshold: float, operator: str, extra: str = "") -> str:
    """The four counts by self-joined totals."""
    return f""", pairs AS ({pairs}),
    counted AS (
      SELECT p.*, p.n AS a,
        (SELECT cast(sum(n) AS bigint) FROM pairs q WHERE q.drug_name = p.drug_name) AS dt,
        (SELECT cast(sum(n) AS bigint) FROM pairs q WHERE q.{event} = p.{event}) AS et,
        (SELECT cast(sum(n) AS bigint) FROM pairs) AS g
      FROM pairs p WHERE drug_name IS NOT NULL AND {event} IS NOT NULL
    ), boxes AS (
      SELECT *, dt - a AS b, et - a AS c, g - dt - et + a AS d FROM counted
    ), ratios AS (
      SELECT *, (cast(a AS double) / (a + b))
        / nullif(cast(c AS double) / nullif(cast(c + d AS double), 0), 0) AS r FROM boxes
    )
    SELECT drug_name, {event}, a, b, c, d, round(r, 4) AS prr,
      coalesce(r {operator} {threshold}, false) AND a >= 3 AS is_signal{extra} FROM ratios"""


_RATES = """, rates AS (
  WITH cube AS (
    SELECT drug_name, ae_soc_class, count(*) AS n,
      GROUPING(drug_name, ae_soc_class) AS level
    FROM fact GROUP BY CUBE (drug_name, ae_soc_class)
  ), tagged AS (
    SELECT pair.drug_name, pair.ae_soc_class, pair.n AS de_count, list(other.level ORDER BY
      other.level) AS levels, list(other.n ORDER BY other.level) AS margins
    FROM cube pair JOIN cube other ON (other.level = 3
      OR other.level = 1 AND other.drug_name = pair.drug_name
      OR other.level = 2 AND other.ae_soc_class = pair.ae_soc_class)
    WHERE pair.level = 0 AND pair.drug_name IS NOT NULL AND pair.ae_soc_class IS NOT NULL
    GROUP BY ALL
  )
  SELECT drug_name, ae_soc_class, de_count,
    round((cast(de_count AS double) / margins[1])
      / (cast(margins[2] AS double) / margins[3]), 2) AS prr
  FROM tagged
)"""

_UNIFIED = (
    FACT
    + ", "
    + EXTRACTIONS
    + """, records AS (
  SELECT drug_name, ae_soc_class, 'FAERS' AS data_source FROM fact
  UNION ALL SELECT drug_name, ae_soc_class, data_source FROM fact_calls
), mapped AS (
  SELECT drug_name, CASE WHEN ae_soc_class IN ('bolt', 'rod') THEN 'fastener'
    ELSE ae_soc_class END AS ae_soc_class, data_source FROM records
), unified AS (
  SELECT drug_name, ae_soc_class, data_source, count(*) AS case_count FROM records GROUP BY ALL
)"""
)


def _unified_pairs(relation: str) -> str:
    return (
        "SELECT drug_name, ae_soc_class, count(*) AS n, array_to_string(list_sort("
        f"list_distinct(list(data_source))), ', ') AS sources FROM {relation} GROUP BY ALL"
    )


def _bm25(relation: str, key: str, queries: str) -> str:
    """Scores of (query_id, query) rows over a relation of documents with ``key``."""
    return f"""docs AS (SELECT *, {_tokens("narrative_text")} AS w FROM {relation}),
    stats AS (SELECT cast(count(*) AS double) AS n, avg(cast(len(w) AS double)) AS avgdl FROM docs),
    asked AS (
      SELECT DISTINCT query_id, unnest({_tokens("query")}) AS term
      FROM (VALUES {queries}) q(query_id, query)
    ), postings AS (
      SELECT doc_no, term, count(*) AS tf, any_value(dl) AS dl
      FROM (SELECT row_number() OVER () AS doc_no, len(w) AS dl, unnest(w) AS term FROM docs)
      WHERE term IN (SELECT term FROM asked) GROUP BY doc_no, term
    ), numbered AS (SELECT row_number() OVER () AS doc_no, {key} FROM docs),
    dfs AS (SELECT term, cast(count(*) AS double) AS df FROM postings GROUP BY term),
    scored AS (
      SELECT *, round(raw, 6) AS score FROM (
        SELECT query_id, doc_no, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
          / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 10) AS raw
        FROM asked JOIN postings USING (term) JOIN dfs USING (term) CROSS JOIN stats
        GROUP BY query_id, doc_no)
    )"""


_KEYWORD_HITS = (
    DOC_NARRATIVES
    + ", "
    + _bm25("narratives", "case_id", f"(1, '{rules.KEYWORDS}')")
    + """, kw AS (
  SELECT case_id, score, raw FROM scored JOIN numbered USING (doc_no)
  ORDER BY raw DESC, case_id LIMIT 200
)"""
)
_VECTOR_HITS = """vecs AS (
  SELECT concat('US-CASE-', cast(vec_id AS varchar)) AS case_id,
    cast(embedding AS double[]) AS v,
    (SELECT cast(embedding AS double[]) FROM embeddings WHERE vec_id = 0) AS q
  FROM embeddings
), nearest AS (
  SELECT case_id, round(list_cosine_similarity(v, q), 12) AS raw,
    round(list_cosine_similarity(v, q), 6) AS similarity FROM vecs
  ORDER BY raw DESC, case_id LIMIT 200
)"""

_SEARCH_CORPUS = (
    FACT.replace("narratives", "x_narratives")
    + ", "
    + DOC_NARRATIVES
    + """, corpus AS (
  SELECT n.case_id, n.narrative_text, f.drug_name, f.ae_soc_class
  FROM narratives n LEFT JOIN fact f ON n.case_id = f.case_id
)"""
)

_DIMS = "patient_id, patient_age, patient_sex, patient_dob, patient_weight, country"
_HASHED = "sha256(patient_id) AS patient_id"
_YEAR = "make_date(year(patient_dob), 1, 1) AS patient_dob"
_REST = "patient_age, patient_sex, country"


def _masked(columns: str) -> str:
    return _fact(f"SELECT {columns} FROM dim_patient")


_SENSITIVE = [
    ("identifier", "^[A-Z]{2,4}-[A-Za-z0-9]+$", "id", "PII"),
    ("date_of_birth", "^19[0-9]{2}-[0-9]{2}-[0-9]{2}$", "dob", "PHI"),
    ("email", "[A-Za-z0-9.]+@[A-Za-z0-9.]+", "email", "PII"),
    ("phone", "[0-9]{3}-[0-9]{4}", "phone", "PII"),
    ("weight", "a^", "weight", "PHI"),
    ("age", "a^", "age", "SENSITIVE"),
    ("sex", "^(Male|Female)$", "sex", "SENSITIVE"),
]
_CLASSIFY = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{cat}' AS category, round(count(*) FILTER "
    f"(regexp_matches(cast({c} AS varchar), '{pattern}')) / cast(greatest(count({c}), 1) AS double)"
    f", 4) AS hit_rate, {'true' if part in c.split('_') else 'false'} AS name_match, "
    f"'{tag}' AS proposed_tag "
    "FROM (SELECT *, 'en' AS language, CASE WHEN patient_age % 10 = 0 THEN '' END AS note "
    "FROM dim_patient)"
    for c in [*_DIMS.split(", "), "language", "note"]
    for cat, pattern, part, tag in _SENSITIVE
)
_NOW = f"timestamp '{rules.QUALITY_TIME}'"
_FRESH = f"cast(epoch({_NOW}) - epoch(cast(max(report_date) AS timestamp)) AS bigint)"
_CLOCK = f"timestamp '{rules.HEALTH_TIME}'"

_VIOLATIONS_INTELLIGENCE = """
  SELECT concat('call_', cast(o_orderkey AS varchar), '.mp3') AS file_name,
    CASE WHEN o_orderkey % 97 = 0 THEN 'no record'
      ELSE 'missing agent_compliance_score' END AS violations
  FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 13 = 0"""

ORACLE: dict[str, str] = {
    # sources
    "load_ae_reports": f"WITH {REPORTS} SELECT * FROM reports",
    "load_narratives": f"WITH {DOC_NARRATIVES} SELECT * FROM narratives",
    "ingest_json_batches": f"WITH {REPORTS} SELECT * EXCLUDE (created_at) FROM reports "
    "WHERE cast(substr(case_id, 9) AS bigint) % 17 <> 0",
    "rejected_batches": f"WITH {REPORTS} SELECT case_id, 'invalid json' AS reason FROM reports "
    "WHERE cast(substr(case_id, 9) AS bigint) % 17 = 0",
    "catalog_increment": """SELECT url AS file_path, split_part(url, '/', -1) AS file_name,
        cast(length(html) AS bigint) AS file_size_bytes,
        timestamp '2024-01-01 00:00:00' + to_minutes(page_id) AS received_at
      FROM pages WHERE url NOT LIKE '%/en/%' ORDER BY received_at, url LIMIT 10""",
    "load_function_events": f"WITH {EVENTS} SELECT * FROM calls_log",
    # bronze
    "classify_terms": "SELECT DISTINCT p_name AS ae_term, split_part(p_name, ' ', 2) AS labels "
    "FROM part",
    "class_distribution": _fact(
        "SELECT ae_soc_class AS soc_class, count(*) AS cnt FROM fact GROUP BY ALL"
    ),
    "classify_events": f"WITH {REPORTS} SELECT *, split_part(ae_term, ' ', 2) AS label FROM reports",
    "extract_fields": f"WITH {RENDERED} SELECT case_id, report_date, {_FIELD_SQL}, {_CONCOMITANT} "
    "FROM narratives",
    "sentiment": f"WITH {DOC_NARRATIVES}, worded AS (SELECT case_id, "
    f"{_tokens('narrative_text')} AS w FROM narratives) "
    f"SELECT case_id, {_tone('w')} AS narrative_sentiment FROM worded",
    "enrich_narratives": f"WITH {ENRICHED} SELECT case_id, narrative_type, generated_at, "
    "extracted_drug AS drug, extracted_ae AS ae, narrative_sentiment FROM fact_narrative",
    "assemble_transcripts": _transcripts("role || ': ' || text", "mp3"),
    "assemble_video_transcripts": _transcripts("text", "mp4"),
    "transcribe_increment": "SELECT * FROM ("
    + _transcripts("role || ': ' || text", "mp3")
    + " HAVING count(*) FILTER (role = 'system') = 0) ORDER BY received_at, file_path LIMIT 10",
    "call_intelligence": _intelligence("mp3", "role = 'assistant'"),
    "video_intelligence": _intelligence("mp4", "true"),
    "extract_adverse_events": _extraction("mp3"),
    "extract_adverse_events_video": _extraction("mp4"),
    "icsr_completeness": f"WITH {EXTRACTIONS} SELECT file_name, CASE WHEN n_events = 0 "
    "THEN 'no_ae' ELSE 'complete' END AS icsr_completeness, count(*) AS records "
    "FROM lines WHERE has_record GROUP BY ALL",
    "reporting_deadline": f"WITH {EXTRACTIONS} SELECT file_name, CASE WHEN n_events = 0 "
    "THEN 'no_report_required' WHEN is_serious THEN '15_day_expedited' ELSE '90_day_periodic' END "
    "AS reporting_deadline, count(*) AS records FROM lines WHERE has_record GROUP BY ALL",
    "validate_records": _VIOLATIONS_INTELLIGENCE,
    "validate_extractions": f"WITH {EXTRACTIONS} SELECT file_name, 'no record' AS violations "
    "FROM lines WHERE NOT has_record",
    "apply_model": """SELECT concat('call_', cast(conv_id AS varchar), '.mp3') AS file_name, turn,
        cast(length(text) - length(replace(text, 'e', '')) AS bigint) AS response,
        'ok' AS status, cast(NULL AS varchar) AS error_message FROM conversations""",
    "render_narrative": f"WITH {RENDERED} SELECT case_id, report_date, narrative_text "
    "FROM narratives",
    "pending_narratives": f"""WITH {REPORTS} SELECT * FROM reports
      WHERE case_id NOT IN (SELECT concat('US-CASE-', cast(doc_id AS varchar)) FROM documents)
      ORDER BY case_id, drug_name, ae_term, report_date, patient_id, patient_age, patient_sex,
        patient_dob, patient_weight, drug_dose, drug_route, drug_start_date, indication,
        ae_severity, ae_seriousness, ae_outcome, ae_onset_date, reporter_type, country,
        manufacturer, created_at LIMIT 10""",
    # silver
    "dim_patient": _fact("SELECT * FROM dim_patient"),
    "dim_drug": _fact("SELECT * FROM dim_drug"),
    "fact_adverse_event": _fact("SELECT * FROM fact"),
    "fact_narrative": f"WITH {ENRICHED} SELECT * FROM fact_narrative",
    "fact_ae_calls": f"WITH {EXTRACTIONS} SELECT * FROM fact_calls",
    "fact_agent_compliance": f"WITH {COMPLIANCE} SELECT * FROM fact_compliance",
    # gold
    "analytics_view": _fact(
        ", view AS (SELECT f.*, p.patient_sex, p.patient_age, d.indication FROM fact f "
        "LEFT JOIN dim_patient p ON f.patient_id = p.patient_id LEFT JOIN dim_drug d "
        "ON f.drug_name = d.drug_name AND f.drug_dose = d.drug_dose "
        f"AND f.drug_route = d.drug_route) {_VIEW_SUMMARY}"
    ),
    "analytics_view_dedup": _fact(
        ", one_drug AS (SELECT drug_name, drug_dose, drug_route, min(indication) AS indication "
        "FROM dim_drug GROUP BY ALL), view AS (SELECT f.*, p.patient_sex, p.patient_age, "
        "d.indication FROM fact f LEFT JOIN dim_patient p USING (patient_id) "
        f"LEFT JOIN one_drug d USING (drug_name, drug_dose, drug_route)) {_VIEW_SUMMARY}"
    ),
    "cases_by_drug": _fact(
        ", view AS (SELECT f.drug_name FROM fact f LEFT JOIN dim_patient p USING (patient_id) "
        "LEFT JOIN dim_drug d USING (drug_name, drug_dose, drug_route)) "
        "SELECT drug_name, count(*) AS cases FROM view GROUP BY drug_name"
    ),
    "metric_query": _fact(
        ", one_drug AS (SELECT drug_name, drug_dose, drug_route, min(indication) AS indication "
        "FROM dim_drug GROUP BY ALL), rows_ AS (SELECT f.case_id, f.patient_id, f.ae_outcome, "
        "p.patient_sex, d.indication FROM fact f LEFT JOIN dim_patient p USING (patient_id) "
        "LEFT JOIN one_drug d USING (drug_name, drug_dose, drug_route) "
        "WHERE drug_route <> 'SMALL'), f AS (SELECT patient_sex, indication, "
        "count(DISTINCT case_id) AS total_cases, "
        "count(*) FILTER (ae_outcome = 'Fatal') AS fatal_cases FROM rows_ GROUP BY ALL), "
        "p AS (SELECT r.patient_sex, r.indication, count(DISTINCT patient_id) AS patient_count, "
        "round(avg(patient_age), 6) AS avg_patient_age FROM (SELECT DISTINCT patient_id, "
        "patient_sex, indication FROM rows_) r JOIN (SELECT patient_id, patient_age "
        "FROM dim_patient) USING (patient_id) GROUP BY ALL) "
        "SELECT * FROM f JOIN p USING (patient_sex, indication)"
    ),
    "metric_query_total": _fact(
        "SELECT (SELECT count(DISTINCT case_id) FROM fact) AS total_cases, (SELECT count(*) "
        "FROM fact WHERE ae_seriousness <> 'Non-serious') AS serious_cases, (SELECT "
        "round(avg(patient_age), 6) FROM dim_patient) AS avg_patient_age"
    ),
    "metric_query_top": _fact(
        "SELECT cast(date_trunc('month', report_date) AS date) AS report_month, "
        "count(*) FILTER (lower(ae_severity) = 'severe') AS severe_cases, "
        "count(DISTINCT case_id) AS total_cases FROM fact "
        "WHERE country IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY 1 "
        "ORDER BY severe_cases DESC, report_month LIMIT 12"
    ),
    **{
        f"metric_{n}": _fact(f"SELECT drug_name, {e} AS {n} FROM fact GROUP BY drug_name")
        for n, e in _MEASURES.items()
    },
    **{f"metric_{n}": _patient_measure(n, e) for n, e in _PATIENT_MEASURES.items()},
    "check_relationship": _fact(
        "SELECT 'drug_events' AS relationship, count(*) AS duplicate_keys, "
        "cast(coalesce(sum(n), 0) AS bigint) AS duplicate_rows FROM (SELECT count(*) AS n "
        "FROM dim_drug GROUP BY drug_name, drug_dose, drug_route) WHERE n > 1 UNION ALL "
        "SELECT 'patient_events', count(*), cast(coalesce(sum(n), 0) AS bigint) FROM (SELECT "
        "count(*) AS n FROM dim_patient GROUP BY patient_id) WHERE n > 1"
    ),
    "top_drugs": _fact(
        "SELECT drug_name, count(DISTINCT case_id) AS total_cases FROM fact GROUP BY drug_name "
        "ORDER BY total_cases DESC, drug_name LIMIT 5"
    ),
    "monthly_severe_trend": _fact(
        "SELECT cast(date_trunc('month', report_date) AS date) AS month, count(*) FILTER "
        "(lower(ae_severity) = 'severe') AS severe_cases, count(*) AS total_cases FROM fact "
        "GROUP BY 1"
    ),
    "fatal_rate_by_drug": _fact(
        "SELECT drug_name, count(*) AS total_cases, count(*) FILTER (ae_outcome = 'Fatal') "
        "AS fatal_cases, round(count(*) FILTER (ae_outcome = 'Fatal') * 100.0::double / count(*), "
        "2) AS fatal_rate_pct FROM fact GROUP BY drug_name HAVING count(*) >= 5"
    ),
    "soc_distribution": _fact(
        "SELECT ae_soc_class, count(*) AS case_count, round(cast(count(*) AS double) * 100.0 "
        "/ sum(count(*)) OVER (), 1) AS pct FROM fact GROUP BY ae_soc_class"
    ),
    "onset_by_drug": _fact(
        "SELECT drug_name, round(avg(onset_days), 1) AS avg_onset_days, "
        "round(median(onset_days), 1) AS median_onset_days, count(*) AS cases FROM fact "
        "WHERE onset_days IS NOT NULL GROUP BY drug_name"
    ),
    "signal_relative_rate": f"WITH {FACT}{_RATES} SELECT * FROM rates WHERE de_count >= 3 "
    "ORDER BY prr DESC, drug_name, ae_soc_class LIMIT 15",
    "signal_prr": f"WITH {FACT}"
    + _prr(
        "SELECT drug_name, ae_soc_class, count(*) AS n FROM fact GROUP BY ALL",
        "ae_soc_class", 2.0, ">=",
    ),
    "signal_prr_terms": f"WITH {FACT}"
    + _prr(
        "SELECT drug_name, ae_term, count(*) AS n FROM fact GROUP BY ALL", "ae_term", 1.2, ">"
    ),
    "flag_baseline": f"WITH {FACT}{_RATES} SELECT *, prr > 1.1 AS exceeds_baseline FROM rates",
    "unified_signal_counts": f"WITH {_UNIFIED} SELECT * FROM unified",
    "unified_prr": f"WITH {_UNIFIED}"
    + _prr(_unified_pairs("records"), "ae_soc_class", 2.0, ">=", ", sources"),
    "unified_prr_mapped": f"WITH {_UNIFIED}"
    + _prr(_unified_pairs("mapped"), "ae_soc_class", 1.05, ">=", ", sources"),
    "unified_sources": f"WITH {_UNIFIED} SELECT data_source, count(*) AS total_rows, "
    "count(DISTINCT drug_name) AS unique_drugs FROM unified GROUP BY data_source",
    "triage_queue": f"WITH {QUEUE} SELECT * FROM queue",
    "triage_sorted": f"WITH {QUEUE} SELECT * FROM queue",
    # search
    "search_corpus": f"WITH {_SEARCH_CORPUS} SELECT case_id, drug_name, ae_soc_class, "
    "count(*) AS n, cast(max(length(narrative_text)) AS integer) AS text_length FROM corpus "
    "GROUP BY ALL",
    "keyword_search": f"WITH {_KEYWORD_HITS} SELECT case_id, score FROM kw "
    "ORDER BY raw DESC, case_id LIMIT 20",
    "keyword_search_filtered": f"WITH {_SEARCH_CORPUS}, "
    + _bm25("corpus", "case_id, drug_name, ae_soc_class", f"(1, '{rules.KEYWORDS}')")
    + " SELECT case_id, drug_name, score FROM scored JOIN numbered USING (doc_no) "
    "WHERE ae_soc_class = 'gear' ORDER BY raw DESC, case_id, drug_name LIMIT 20",
    "vector_search": f"WITH {_VECTOR_HITS} SELECT case_id, similarity FROM nearest "
    "ORDER BY raw DESC, case_id LIMIT 20",
    "hybrid_search": f"""WITH {_KEYWORD_HITS}, {_VECTOR_HITS}, k AS (
        SELECT case_id, row_number() OVER (ORDER BY score DESC, case_id) AS keyword_rank FROM kw
      ), v AS (
        SELECT case_id, row_number() OVER (ORDER BY similarity DESC, case_id) AS vector_rank
        FROM nearest
      ) SELECT case_id, cast(keyword_rank AS integer) AS keyword_rank,
        cast(vector_rank AS integer) AS vector_rank,
        round(coalesce(cast(1 AS double) / (60 + keyword_rank), 0)
          + coalesce(cast(1 AS double) / (60 + vector_rank), 0), 6) AS score
      FROM k FULL JOIN v USING (case_id) ORDER BY score DESC, case_id LIMIT 20""",
    "search_batch": f"WITH {DOC_NARRATIVES}, "
    + _bm25("narratives", "case_id", ", ".join(f"({i}, '{q}')" for i, q in rules.QUERIES))
    + " SELECT query_id, case_id, score, cast(row_number() OVER (PARTITION BY query_id "
    "ORDER BY raw DESC, case_id) AS integer) AS rank FROM scored JOIN numbered USING (doc_no) "
    "QUALIFY rank <= 10",
    "search_batch_filtered": f"WITH {_SEARCH_CORPUS}, "
    + _bm25(
        "corpus", "case_id, drug_name, ae_soc_class",
        ", ".join(f"({i}, '{q}')" for i, q in rules.QUERIES),
    )
    + " SELECT query_id, case_id, drug_name, score, cast(row_number() OVER (PARTITION BY query_id "
    "ORDER BY raw DESC, case_id, drug_name) AS integer) AS rank FROM scored "
    "JOIN numbered USING (doc_no) WHERE ae_soc_class = 'gear' QUALIFY rank <= 10",
    "search_narratives": f"""WITH {ENRICHED} SELECT case_id, narrative_text, extracted_drug,
        extracted_ae, extracted_causality, narrative_sentiment FROM fact_narrative
      WHERE contains(lower(narrative_text), 'gizmo') OR contains(lower(extracted_ae), 'gizmo')
        OR contains(lower(extracted_drug), 'gizmo') ORDER BY case_id, narrative_text LIMIT 20""",
    "narrative_overview": f"""WITH {ENRICHED} SELECT case_id, extracted_drug, extracted_ae,
        extracted_severity, extracted_causality, narrative_sentiment AS sentiment_score
      FROM fact_narrative""",
    "search_transcripts": "SELECT file_name, received_at, text AS transcript_text FROM ("
    + _transcripts("role || ': ' || text", "mp3")
    + ") WHERE contains(lower(text), 'tion') ORDER BY received_at, file_name LIMIT 20",
    "linked_events": f"WITH {EXTRACTIONS}, hits AS (SELECT file_name FROM ("
    + _transcripts("role || ': ' || text", "mp3")
    + ") WHERE contains(lower(text), 'tion') ORDER BY received_at, file_name LIMIT 20) "
    "SELECT file_name, drug_name, ae_preferred_term, ae_soc_class, ae_seriousness, ae_outcome, "
    "causality, reporting_deadline FROM hits LEFT JOIN fact_calls ON file_name = source_call_id",
    "transcript_preview": "SELECT doc_id, CASE WHEN length(text) > 2000 THEN "
    "substr(text, 1, 2000) || '...' ELSE coalesce(text, '') END AS preview FROM documents",
    # dashboards
    "safety_headline": _fact(
        "SELECT count(DISTINCT case_id) AS total_cases, count(*) FILTER "
        "(lower(ae_severity) = 'severe') AS severe_cases, count(*) FILTER (ae_outcome = 'Fatal') "
        "AS fatal_cases, count(DISTINCT drug_name) AS unique_drugs, count(*) FILTER "
        "(lower(ae_severity) = 'severe') * 100 // greatest(count(DISTINCT case_id), 1) "
        "AS severe_pct FROM fact"
    ),
    "top_drugs_by_reports": _fact(
        "SELECT drug_name, count(*) AS case_count FROM fact GROUP BY drug_name "
        "ORDER BY case_count DESC, drug_name LIMIT 10"
    ),
    "cases_by_soc": _fact(
        "SELECT ae_soc_class, count(*) AS case_count FROM fact WHERE ae_soc_class IS NOT NULL "
        "GROUP BY ae_soc_class"
    ),
    "drug_severity": _fact(
        "SELECT drug_name, ae_severity, count(*) AS cnt FROM fact WHERE drug_name IN (SELECT "
        "drug_name FROM fact GROUP BY drug_name ORDER BY count(*) DESC, drug_name LIMIT 10) "
        "GROUP BY drug_name, ae_severity"
    ),
    "drug_severity_matrix": _fact(
        'SELECT drug_name, count(*) FILTER (lower(ae_severity) = \'mild\') AS "Mild", '
        "count(*) FILTER (lower(ae_severity) = 'moderate') AS \"Moderate\", "
        "count(*) FILTER (lower(ae_severity) = 'unseen') AS \"Unseen\", "
        "count(*) FILTER (lower(ae_severity) NOT IN ('mild', 'moderate', 'unseen') "
        'OR ae_severity IS NULL) AS "other" FROM fact WHERE drug_name IN (SELECT drug_name FROM fact '
        "GROUP BY drug_name ORDER BY count(*) DESC, drug_name LIMIT 10) GROUP BY drug_name"
    ),
    "monthly_trend": _fact(
        "SELECT cast(date_trunc('month', report_date) AS date) AS month, count(*) AS total_cases, "
        "count(*) FILTER (lower(ae_severity) = 'severe') AS severe_cases FROM fact GROUP BY 1"
    ),
    "outcome_distribution": _fact(
        "SELECT ae_outcome, count(*) AS cnt FROM fact GROUP BY ae_outcome"
    ),
    "fatal_percent_by_drug": _fact(
        "SELECT drug_name, count(*) AS total, count(*) FILTER (ae_outcome = 'Fatal') AS fatal, "
        "round(count(*) FILTER (ae_outcome = 'Fatal') * 100.0::double / count(*), 1) AS fatal_pct "
        "FROM fact GROUP BY drug_name HAVING count(*) >= 5"
    ),
    "onset_by_soc": _fact(
        "SELECT ae_soc_class, round(avg(onset_days), 1) AS avg_onset_days, "
        "round(median(onset_days), 1) AS median_onset_days, count(*) AS cases FROM fact "
        "WHERE onset_days IS NOT NULL GROUP BY ae_soc_class"
    ),
    "severe_by_country": _fact(
        "SELECT country, count(*) AS severe_cases FROM fact WHERE lower(ae_severity) = 'severe' "
        "GROUP BY country"
    ),
    "monthly_volume": _fact(
        "SELECT cast(date_trunc('month', report_date) AS date) AS month, count(*) AS cases "
        "FROM fact GROUP BY 1"
    ),
    "quick_top_drugs": _fact(
        "SELECT drug_name, count(DISTINCT case_id) AS total_cases FROM fact GROUP BY drug_name "
        "ORDER BY total_cases DESC, drug_name LIMIT 5"
    ),
    "calls_headline": f"WITH {QUEUE} SELECT (SELECT count(*) FROM fact_compliance) AS total_calls, "
    "(SELECT count(*) FROM fact_calls) AS ae_cases, (SELECT count(*) FROM queue "
    "WHERE reporting_deadline = '15_day_expedited') AS pending_15_day, (SELECT "
    "round(avg(compliance_score), 1) FROM fact_compliance) AS avg_compliance",
    "score_buckets": f"WITH {COMPLIANCE} SELECT CASE WHEN compliance_score <= 50 THEN '0-50' "
    "WHEN compliance_score <= 70 THEN '51-70' WHEN compliance_score <= 90 THEN '71-90' "
    "ELSE '91-100' END AS score_bucket, count(*) AS call_count FROM fact_compliance GROUP BY 1",
    "flagged_calls": f"WITH {COMPLIANCE} SELECT call_id, compliance_score, tone_professional, "
    "caller_state, urgency_level, call_type, analyzed_at FROM fact_compliance "
    "WHERE compliance_score < 70",
    "escalations": f"WITH {COMPLIANCE} SELECT call_id, compliance_score, urgency_level, "
    "escalation_reason, analyzed_at FROM fact_compliance WHERE escalation_needed",
    "urgent_count": f"WITH {QUEUE} SELECT count(*) AS urgent_cases FROM queue "
    "WHERE priority_flag = 'URGENT'",
    # governance and quality
    "mask_patient_id": _masked(f"{_HASHED}, patient_dob, patient_weight, {_REST}"),
    "mask_dob": _masked(f"patient_id, {_YEAR}, patient_weight, {_REST}"),
    "mask_null": _masked(
        f"patient_id, patient_dob, cast(NULL AS double) AS patient_weight, {_REST}"
    ),
    "apply_policies_officer": _masked(_DIMS),
    "apply_policies_engineer": _masked(
        f"{_HASHED}, {_YEAR}, cast(NULL AS double) AS patient_weight, {_REST}"
    ),
    "apply_policies_analyst": _masked(
        f"'***REDACTED***' AS patient_id, {_YEAR}, cast(NULL AS double) AS patient_weight, {_REST}"
    ),
    "classify_columns": _fact(
        f"SELECT * FROM ({_CLASSIFY}) WHERE hit_rate >= 0.8 OR name_match"
    ),
    "dq_null_count": _fact(
        "SELECT count(*) FILTER (ae_onset_date IS NULL) AS null_count FROM fact"
    ),
    "dq_row_count": _fact("SELECT count(*) AS row_count FROM fact"),
    "dq_freshness": _fact(f"SELECT {_FRESH} AS freshness_seconds FROM fact"),
    "dq_report": _fact(
        "SELECT 'NULL_COUNT' AS metric, 'ae_term' AS column_name, count(*) FILTER "
        "(ae_term IS NULL) AS value FROM fact UNION ALL SELECT 'NULL_COUNT', 'ae_onset_date', "
        "count(*) FILTER (ae_onset_date IS NULL) FROM fact UNION ALL SELECT 'ROW_COUNT', '', "
        f"count(*) FROM fact UNION ALL SELECT 'FRESHNESS', 'report_date', {_FRESH} FROM fact"
    ),
    "row_counts": f"WITH {FACT}, {EXTRACTIONS}, {COMPLIANCE} "
    + " UNION ALL ".join(
        f"SELECT '{label}' AS table_name, count(*) AS row_count FROM {relation}"
        for label, relation in (
            ("DIM_PATIENT", "dim_patient"),
            ("DIM_DRUG", "dim_drug"),
            ("FACT_ADVERSE_EVENT", "fact"),
            ("FACT_AE_CALLS", "fact_calls"),
            ("FACT_AGENT_COMPLIANCE", "fact_compliance"),
        )
    ),
    "completeness": f"WITH {ENRICHED} SELECT count(*) AS total, count(extracted_drug) "
    "AS has_extraction, count(narrative_sentiment) AS has_sentiment, count(*) "
    "- count(extracted_drug) AS missing_extraction, count(*) - count(narrative_sentiment) "
    "AS missing_sentiment FROM fact_narrative",
    "null_outputs": f"WITH {EXTRACTIONS} SELECT 'CALL_AE_EXTRACTIONS' AS table_name, "
    "count(*) FILTER (NOT has_record) AS null_count FROM lines UNION ALL "
    "SELECT 'CALL_AUDIO_INTELLIGENCE', count(*) FILTER (o_orderkey % 97 = 0) FROM orders",
    "distribution": _fact(
        "SELECT country, count(*) AS cnt, round(cast(count(*) AS double) * 100.0 "
        "/ sum(count(*)) OVER (), 1) AS pct FROM reports GROUP BY country"
    ),
    "detection_summary": f"""WITH {EXTRACTIONS}, {_extraction_relations()}
      SELECT 'CALL_CENTER' AS source, count(*) AS total,
        count(*) FILTER (has_record AND o_orderstatus <> 'P') AS ae_detected_count,
        count(*) FILTER (has_record AND deadline = '15_day_expedited') AS expedited_reports
      FROM lines UNION ALL
      SELECT 'HCP_VIDEO', count(*), count(*) FILTER (ae_detected),
        count(*) FILTER (reporting_deadline = '15_day_expedited') FROM extracted""",
    "preview": f"""WITH {EXTRACTIONS} SELECT file_name,
        CASE WHEN has_record THEN o_orderstatus <> 'P' END AS ae_detected,
        CASE WHEN has_record THEN CASE WHEN l_linenumber = 7 THEN 'incomplete' ELSE 'complete' END
          END AS icsr_status,
        CASE WHEN has_record THEN p_brand END AS drug_name,
        CASE WHEN has_record THEN deadline END AS deadline,
        CASE WHEN has_record THEN left(concat('Report on ', p_brand), 150) END
          AS narrative_preview
      FROM lines""",
    "preview_texts": f"WITH {DOC_NARRATIVES} SELECT case_id, left(narrative_text, 200) AS preview "
    "FROM narratives ORDER BY case_id LIMIT 5",
    # health
    "function_health": f"WITH {EVENTS} SELECT * FROM health",
    "error_alerts": f"WITH {EVENTS} SELECT model_used, error_count, total_calls, "
    "round(cast(error_count AS double) / total_calls * 100, 1) AS error_rate_pct FROM health "
    f"WHERE hour >= {_CLOCK} - INTERVAL 1 HOUR AND hour <= {_CLOCK} "
    "AND cast(error_count AS double) / total_calls > 0.10",
    "rolling_error_alerts": f"WITH {EVENTS} SELECT model_used, "
    "count(*) FILTER (status = 'error') AS error_count, count(*) AS total_calls, "
    "round(cast(count(*) FILTER (status = 'error') AS double) / count(*) * 100, 1) "
    f'AS error_rate_pct FROM calls_log WHERE "timestamp" >= {_CLOCK} - INTERVAL 1 HOUR '
    f'AND "timestamp" <= {_CLOCK} GROUP BY function_name, model_used '
    "HAVING cast(count(*) FILTER (status = 'error') AS double) / count(*) > 0.10",
}

# A stored index gives what a search of the corpus gives, also after its rows were replaced.
ORACLE["search_index"] = ORACLE["search_batch"]
ORACLE["search_index_fresh"] = ORACLE["search_batch_filtered"]

_NEIGHBOURS = """WITH near AS (
  SELECT q.vec_id AS query_id, concat('US-CASE-', e.vec_id) AS case_id,
    list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS raw
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, case_id, round(raw, 6) AS similarity,
    cast(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, case_id) AS integer) AS rank
  FROM near
)"""
ORACLE["vector_index_exact"] = f"{_NEIGHBOURS} SELECT * FROM ranked WHERE rank <= 10"
ORACLE["vector_index_recall"] = (
    f"{_NEIGHBOURS} SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS reached "
    "FROM ranked WHERE rank <= 10"
)

# A model read from a file gives what the operators give.
for _name in ("top_drugs", "monthly_severe_trend", "fatal_rate_by_drug", "soc_distribution", "onset_by_drug"):
    ORACLE[f"verified_{_name}"] = ORACLE[_name]
_FATAL_CASES = "count(*) FILTER (ae_outcome = 'Fatal') AS fatal_cases"
ORACLE["metric_query_of_file"] = ORACLE["metric_query"].replace(
    _FATAL_CASES,
    f"{_FATAL_CASES}, round(cast(count(*) FILTER (ae_outcome = 'Fatal') AS DOUBLE) * 100 / count(*), 6) AS fatal_rate",
)
