"""Reference-shaped frames derived from the driver's generic tables (see FIXTURES.md).

Each report column names the tables it comes from, and only those tables are joined. All keys
are foreign keys, so leaving out a join never changes the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ONSET = "case when l_shipdate >= o_orderdate then cast(l_shipdate as date) end"
_SERIOUSNESS = (
    "case o_orderpriority when '5-LOW' then 'Non-serious' when '4-NOT SPECIFIED' then null "
    "when '3-MEDIUM' then 'Hospitalization' when '2-HIGH' then 'Life-threatening' "
    "else 'Death' end"
)
_REPORTER = (
    "case l_linenumber % 5 when 0 then 'Physician' when 1 then 'Pharmacist' "
    "when 2 then 'Consumer/Patient' when 3 then 'Nurse' else 'Other HCP' end"
)

# column -> (expression, tables needed besides lineitem)
REPORT_COLUMNS: dict[str, tuple[str, tuple[str, ...]]] = {
    "case_id": ("concat('US-CASE-', cast(l_orderkey as string))", ()),
    "patient_id": ("concat('PAT-', cast(o_custkey as string))", ("orders",)),
    "patient_age": ("cast(18 + o_custkey % 72 as int)", ("orders",)),
    "patient_sex": ("case when o_custkey % 20 < 11 then 'Female' else 'Male' end", ("orders",)),
    "patient_dob": ("date_add(date'1940-01-01', cast(o_custkey % 20000 as int))", ("orders",)),
    "patient_weight": ("c_acctbal", ("orders", "customer")),
    "drug_name": ("p_brand", ("part",)),
    "drug_dose": ("concat(cast(p_size as string), 'mg')", ("part",)),
    "drug_route": ("p_type", ("part",)),
    "drug_start_date": ("cast(o_orderdate as date)", ("orders",)),
    "indication": ("split_part(p_name, ' ', 1)", ("part",)),
    "ae_term": ("p_name", ("part",)),
    "ae_severity": (
        "case l_returnflag when 'R' then 'Severe' when 'A' then 'moderate' else 'Mild' end",
        (),
    ),
    "ae_seriousness": (_SERIOUSNESS, ("orders",)),
    "ae_outcome": (
        "case o_orderstatus when 'F' then 'Fatal' when 'O' then 'Recovered' else 'Unknown' end",
        ("orders",),
    ),
    "ae_onset_date": (_ONSET, ("orders",)),
    "reporter_type": (_REPORTER, ()),
    "report_date": ("cast(l_shipdate as date)", ()),
    "country": ("cn.n_name", ("orders", "customer", "customer_nation")),
    "manufacturer": ("r_name", ("supplier", "supplier_nation", "region")),
    "created_at": ("l_shipdate", ()),
}


def ae_reports(
    spark: SparkSession, sf_dir: str, columns: list[str] | None = None
) -> DataFrame:
    """One report per lineitem row, with all or the named report columns."""
    wanted = columns or list(REPORT_COLUMNS)
    needed = {t for c in wanted for t in REPORT_COLUMNS[c][1]}

    def load(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    # Chains of name -> (table, alias, join condition). Those of a chain are joined with each other
    # first, so that the reports are moved once a chain; the widest values come last.
    chains: list[dict[str, tuple[str, str, str]]] = [
        {
            "supplier": ("supplier", "s", "l_suppkey = s_suppkey"),
            "supplier_nation": ("nation", "sn", "s_nationkey = sn.n_nationkey"),
            "region": ("region", "r", "sn.n_regionkey = r_regionkey"),
        },
        {
            "orders": ("orders", "o", "l_orderkey = o_orderkey"),
            "customer": ("customer", "c", "o_custkey = c_custkey"),
            "customer_nation": ("nation", "cn", "c_nationkey = cn.n_nationkey"),
        },
        {"part": ("part", "pt", "l_partkey = p_partkey")},
    ]
    rows = load("lineitem")
    for chain in chains:
        used = [join for name, join in chain.items() if name in needed]
        if not used:
            continue
        (source, alias, onto), *more = used
        side = load(source).alias(alias)
        for source, alias, condition in more:
            side = side.join(load(source).alias(alias), F.expr(condition))
        rows = rows.join(side, F.expr(onto))
    return rows.select(*[F.expr(REPORT_COLUMNS[c][0]).alias(c) for c in wanted])


# One label per noun of a part name; fixed values of the generated parts.
FIXTURE_LABELS = {
    noun: [noun]
    for noun in ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
}

FACT_INPUT = [
    "case_id", "patient_id", "drug_name", "drug_dose", "drug_route", "drug_start_date",
    "ae_term", "ae_severity", "ae_seriousness", "ae_outcome", "ae_onset_date",
    "reporter_type", "report_date", "country", "manufacturer",
]


def ae_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.expr("concat('US-CASE-', cast(doc_id as string))").alias("case_id"),
        F.col("text").alias("narrative_text"),
        F.expr("case when doc_id % 4 = 0 then null else 'INITIAL' end").alias("narrative_type"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("generated_at"),
    )


def call_turns(spark: SparkSession, sf_dir: str, videos: bool = False) -> DataFrame:
    """Speaker turns per recording; each conversation also stands for a video visit."""
    rows = table(spark, sf_dir, "conversations")
    ending = "mp4" if videos else "mp3"
    return rows.select(
        F.expr(f"concat('calls/call_', cast(conv_id as string), '.{ending}')").alias("file_path"),
        F.expr(f"concat('call_', cast(conv_id as string), '.{ending}')").alias("file_name"),
        F.expr("date_add(date'2024-01-01', cast(conv_id % 365 as int))")
        .cast("timestamp_ntz")
        .alias("received_at"),
        F.col("turn"),
        F.col("role").alias("speaker_label"),
        F.col("text"),
    )


_NO_STRING = "cast(null as string)"


def call_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested extraction record per lineitem row: 0, 1 or 2 events, some not detected."""
    rows = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    )
    event = (
        "named_struct('ae_description_verbatim', p_name, 'meddra_preferred_term', {term}, "
        "'meddra_soc_class', split_part(p_name, ' ', 2), 'seriousness_criteria', "
        "case when o_orderpriority in ('1-URGENT', '2-HIGH') "
        "then array('hospitalization', 'medically_significant') else array('none') end, "
        "'outcome', case o_orderstatus when 'F' then 'fatal' else 'recovered' end, "
        "'causality_who_umc', case when l_linenumber % 2 = 0 then 'probable' "
        "else 'possible' end)"
    )
    first = event.format(term="p_name")
    second = event.format(term="concat('second ', p_name)")
    deadline = (
        "case when o_orderpriority in ('1-URGENT', '2-HIGH') then '15_day_expedited' "
        "when o_orderpriority = '3-MEDIUM' then '90_day_periodic' "
        "else 'no_report_required' end"
    )
    record = (
        "named_struct('ae_detected', o_orderstatus <> 'P', 'icsr_completeness', "
        "case when l_linenumber = 7 then 'incomplete' else 'complete' end, 'adverse_events', "
        f"case when l_linenumber = 7 then slice(array({first}), 1, 0) "
        f"when l_linenumber = 6 then array({first}, {second}) else array({first}) end, "
        "'suspect_drug', named_struct('drug_name', p_brand, 'drug_dose', "
        f"concat(cast(p_size as string), 'mg'), 'drug_route', p_type, 'indication', {_NO_STRING}), "
        "'patient', named_struct('age', cast(18 + o_custkey % 72 as string), 'sex', "
        "case when o_custkey % 20 < 11 then 'Female' else 'Male' end, "
        f"'identifier', {_NO_STRING}), "
        "'product_quality_complaint', false, 'off_label_use_mentioned', false, "
        f"'reporting_deadline', {deadline}, 'narrative_summary', concat('Report on ', p_brand))"
    )
    file_name = "concat('call_', cast(l_orderkey as string), '.mp3')"
    return rows.select(
        F.expr(f"concat('calls/', {file_name})").alias("file_path"),
        F.expr(file_name).alias("file_name"),
        F.expr(f"case when l_linenumber = 5 and l_orderkey % 11 = 0 then null else {record} end")
        .alias("ae_extraction_json"),
        F.col("o_orderdate").alias("extracted_at"),
    )


def call_intelligence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested analysis record per order; a few failed ones are NULL."""
    record = (
        "named_struct('caller_emotional_state', case o_orderpriority "
        "when '1-URGENT' then 'distressed' when '2-HIGH' then 'concerned' "
        "when '3-MEDIUM' then 'confused' else 'calm' end, "
        "'caller_urgency_level', case o_orderpriority when '1-URGENT' then 'urgent' "
        "when '2-HIGH' then 'elevated' else 'routine' end, "
        "'ae_acoustic_signals', cast(array() as array<string>), "
        "'agent_compliance_score', cast(case when o_orderkey % 13 = 0 then null "
        "else o_orderkey % 101 end as double), "
        "'agent_tone_professional', o_totalprice > 250000, "
        f"'call_duration_category', {_NO_STRING}, "
        "'call_type_inferred', case o_orderstatus when 'P' then 'standard_drug_info' "
        "else 'adverse_event_report' end, "
        "'escalation_recommended', o_orderstatus = 'P', "
        "'escalation_reason', case when o_orderstatus = 'P' then o_orderpriority end)"
    )
    file_name = "concat('call_', cast(o_orderkey as string), '.mp3')"
    return table(spark, sf_dir, "orders").select(
        F.expr(f"concat('calls/', {file_name})").alias("file_path"),
        F.expr(file_name).alias("file_name"),
        F.expr(f"case when o_orderkey % 97 = 0 then null else {record} end").alias(
            "audio_intelligence_json"
        ),
        F.col("o_orderdate").alias("analyzed_at"),
    )


def function_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = "cast(get_json_object(props, '$.k') as bigint)"
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("function_name"),
        F.expr("concat('model-', cast(user_id % 3 as string))").alias("model_used"),
        F.expr("cast(event_id as string)").alias("input_file"),
        F.expr("cast(round(value) as bigint)").alias("latency_ms"),
        F.expr(tokens).alias("token_count"),
        F.expr(f"case when {tokens} < 15 then 'error' else 'ok' end").alias("status"),
        F.expr(f"case when {tokens} < 15 then 'timeout' end").alias("error_message"),
    )


def json_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array per report; the payloads of every 17th case are cut in half."""
    fields = [c for c in REPORT_COLUMNS if c != "created_at"]
    reports = ae_reports(spark, sf_dir, fields)
    text = F.to_json(F.array(F.struct(*fields)), {"ignoreNullFields": "false"})
    broken = F.expr("cast(substring(case_id, 9) as bigint) % 17 = 0")
    cut = F.expr("substring(payload, 1, cast(length(payload) / 2 as int))")
    return (
        reports.select("case_id", text.alias("payload"))
        .withColumn("payload", F.when(broken, cut).otherwise(F.col("payload")))
    )


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id"),
        F.col("url").alias("file_path"),
        F.expr("cast(length(html) as bigint)").alias("file_size_bytes"),
        F.expr("timestampadd(MINUTE, cast(page_id as int), timestamp_ntz'2024-01-01 00:00:00')")
        .alias("received_at"),
    )


def narrative_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.expr("concat('US-CASE-', cast(vec_id as string))").alias("case_id"), "embedding"
    )
