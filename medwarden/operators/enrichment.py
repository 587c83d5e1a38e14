"""Bronze enrichment of reports and narratives.

The word lists are rules, not a medical model: they give the records the shape downstream tables
need. Pass ``model`` to use a real one; it is called batch-wise on executors.
"""

from __future__ import annotations

import string
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medwarden import schemas
from medwarden.functions.text import count_words, keep_words, tokens
from medwarden.sources.files import not_yet_in

Model = Callable[[pd.DataFrame], Sequence]

# Words that point to each label of schemas.TOXICITY_LABELS.
TOXICITY_WORDS: dict[str, list[str]] = {
    "Hepatotoxicity": ["hepatic", "hepatitis", "hepatocellular", "liver", "jaundice",
                       "transaminases", "cholestasis"],
    "Cardiotoxicity": ["cardiac", "heart", "myocardial", "infarction", "qt", "torsade",
                       "cardiomyopathy", "arrhythmia"],
    "Nephrotoxicity": ["kidney", "renal", "nephritis", "proteinuria", "creatinine"],
    "Dermatologic": ["skin", "stevens", "johnson", "epidermal", "rash", "urticaria",
                     "angioedema", "eosinophilia"],
    "Neurologic": ["seizure", "neuropathy", "guillain", "leukoencephalopathy", "headache",
                   "dizziness"],
    "Gastrointestinal": ["pancreatitis", "gastrointestinal", "intestinal", "colitis", "nausea",
                         "vomiting", "diarrhoea"],
    "Hematologic": ["pancytopenia", "thrombocytopenia", "neutropenia", "coagulation", "anaemia"],
    "Immunologic": ["anaphylaxis", "cytokine", "immune", "hypersensitivity"],
    "Musculoskeletal": ["myalgia", "arthralgia", "rhabdomyolysis", "muscle", "bone"],
    "Respiratory": ["pneumonitis", "dyspnoea", "bronchospasm", "cough", "lung"],
}

TONE_WORDS: dict[str, float] = {
    **dict.fromkeys(["death", "died", "fatal", "failure", "arrest"], -1.0),
    **dict.fromkeys(["severe", "worsened", "hospitalised", "hospitalized", "acute"], -0.5),
    **dict.fromkeys(["stable", "improved", "mild", "improving"], 0.5),
    **dict.fromkeys(["recovered", "resolved", "uneventful"], 1.0),
}


# --- caller-supplied models ---------------------------------------------------------------


def apply_model(
    df: DataFrame,
    fn: Model,
    in_cols: Sequence[str],
    out_type: T.DataType,
    batch: int = 64,
    out_col: str = "response",
) -> DataFrame:
    """Run ``fn`` over batches of rows on executors.

    ``fn`` gets a pandas frame of ``in_cols`` and returns one value per row. If a batch raises,
    its rows are tried singly; rows that still fail get a NULL value, status ``error`` and the
    message. Adds ``out_col``, ``latency_ms`` (share of the batch), ``status``, ``error_message``.
    """
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField(out_col, out_type),
            T.StructField("latency_ms", T.LongType()),
            T.StructField("status", T.StringType()),
            T.StructField("error_message", T.StringType()),
        ]
    )
    columns = list(in_cols)

    def call(rows: pd.DataFrame) -> list[tuple]:
        start = time.perf_counter()
        try:
            values = list(fn(rows[columns]))
            if len(values) != len(rows):
                raise ValueError(f"model returned {len(values)} values for {len(rows)} rows")
        except Exception as error:  # noqa: BLE001 - a model may raise anything
            if len(rows) > 1:
                return [r for i in range(len(rows)) for r in call(rows.iloc[i : i + 1])]
            spent = round((time.perf_counter() - start) * 1000)
            return [(None, spent, "error", str(error))]
        spent = round((time.perf_counter() - start) * 1000 / max(len(rows), 1))
        return [(v, spent, "ok", None) for v in values]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                result = call(part)
                yield part.assign(
                    **{
                        out_col: [r[0] for r in result],
                        "latency_ms": [r[1] for r in result],
                        "status": [r[2] for r in result],
                        "error_message": [r[3] for r in result],
                    }
                )

    return df.mapInPandas(run, schema)


def model_events(
    applied: DataFrame, function_name: str, model_used: str, input_col: str
) -> DataFrame:
    """The rows of ``apply_model`` as entries of the model-call log."""
    return applied.select(
        F.current_timestamp().cast("timestamp_ntz").alias("timestamp"),
        F.lit(function_name).alias("function_name"),
        F.lit(model_used).alias("model_used"),
        F.col(input_col).cast("string").alias("input_file"),
        F.col("latency_ms"),
        F.lit(None).cast("bigint").alias("token_count"),
        F.col("status"),
        F.col("error_message"),
    )


def _model_column(
    df: DataFrame, model: Model, in_col: str, out_type: T.DataType, out_col: str
) -> DataFrame:
    applied = apply_model(df, model, [in_col], out_type, out_col=out_col)
    return applied.select(*df.columns, out_col)


# --- reports ------------------------------------------------------------------------------


def classify_terms(
    df: DataFrame,
    term_col: str = "ae_term",
    label_lexicon: Mapping[str, Sequence[str]] = TOXICITY_WORDS,
    model: Model | None = None,
    out_col: str = "ae_classification",
) -> DataFrame:
    """Adds ``{labels: [...]}``: labels with a word in the term, most words first.

    Ties keep the order of the lexicon. The lexicon is a small literal of the plan, so every row
    is scored where it is: no join and no shuffle, however often a term repeats.
    """
    if model is not None:
        return _model_column(df, model, term_col, schemas.CLASSIFICATION, out_col)
    all_words = [w for keywords in label_lexicon.values() for w in keywords]
    scored = [
        F.struct(
            count_words(F.col("_hits"), keywords).alias("hits"),
            F.lit(-position).alias("order"),
            F.lit(label).alias("label"),
        )
        for position, (label, keywords) in enumerate(label_lexicon.items())
    ]
    hit = F.filter(F.array(*scored), lambda s: s["hits"] > 0)
    ranked = F.transform(F.sort_array(hit, asc=False), lambda s: s["label"])
    # Most texts have no or few words of the lexicon; labels are only ranked where there are some.
    labels = F.when(F.size("_hits") > 0, ranked).otherwise(F.array().cast("array<string>"))
    return (
        df.withColumn("_hits", keep_words(tokens(F.col(term_col)), all_words))
        .withColumn(out_col, F.struct(labels.alias("labels")))
        .drop("_hits")
    )


def classify_events(
    reports: DataFrame,
    label_lexicon: Mapping[str, Sequence[str]] = TOXICITY_WORDS,
    model: Model | None = None,
) -> DataFrame:
    """All report columns plus the classification of the event term.

    A model is costly per call, so it sees each distinct term once, NULL included, and the answers
    are joined back; adaptive execution splits the partition of a term of very many reports.
    """
    if model is None:
        return classify_terms(reports, "ae_term", label_lexicon)
    terms = classify_terms(reports.select("ae_term").distinct(), "ae_term", model=model)
    terms = terms.withColumnRenamed("ae_term", "_term")
    joined = reports.join(terms, F.col("ae_term").eqNullSafe(F.col("_term")), "left")
    return joined.select(*reports.columns, "ae_classification")


def class_distribution(classified: DataFrame) -> DataFrame:
    first = F.get(F.col("ae_classification.labels"), F.lit(0))
    return classified.groupBy(first.alias("soc_class")).agg(F.count(F.lit(1)).alias("cnt"))


# --- narratives ---------------------------------------------------------------------------

# Group 1 of each pattern is the value: everything up to what follows it in the template.
# ``concomitant_drugs`` lists every match.
FIELD_PATTERNS: dict[str, str] = {
    "primary_drug": r"received (.+?) [0-9][0-9.,]* ?[A-Za-zµμ%]+ \(",
    "adverse_event": r"developed (.+?) \(severity",
    "severity_assessment": r"\(severity: ([^,;)]+)",
    "patient_outcome": r"outcome was ([^.]+)\.",
    "onset_days": r"after (\d+) days",
    "causality": r"causality (?:was )?(?:assessed as )?(certain|probable|possible|unlikely)",
    "dechallenge_result": r"dechallenge (?:was )?(positive|negative|not done)",
    "concomitant_drugs": r"together with ([^.,;]+?)(?: and |[.,;]|$)",
}
LIST_FIELDS = {"concomitant_drugs"}


def extract_fields(
    df: DataFrame,
    text_col: str = "narrative_text",
    field_patterns: Mapping[str, str] = FIELD_PATTERNS,
    model: Model | None = None,
    out_col: str = "extracted",
) -> DataFrame:
    """Adds ``{response: {field: string, ...}}``; a field without a match is NULL."""
    if model is not None:
        out_type = T.StructType(
            [
                T.StructField(
                    "response",
                    T.StructType([T.StructField(f, T.StringType()) for f in field_patterns]),
                )
            ]
        )
        return _model_column(df, model, text_col, out_type, out_col)
    text = F.col(text_col)

    def value(name: str, pattern: str) -> Column:
        if name in LIST_FIELDS:
            found = F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), ", ")
        else:
            found = F.regexp_extract(text, pattern, 1)
        return F.nullif(found, F.lit("")).alias(name)

    response = F.struct(*[value(n, p) for n, p in field_patterns.items()])
    record = F.struct(response.alias("response"))
    return df.withColumn(out_col, F.when(text.isNotNull(), record))


def sentiment(
    df: DataFrame,
    text_col: str = "narrative_text",
    lexicon: Mapping[str, float] = TONE_WORDS,
    model: Model | None = None,
    out_col: str = "narrative_sentiment",
) -> DataFrame:
    """Adds the mean weight of the tone words of a text, in [-1, 1]; 0 where it has none.

    Words are counted per weight, so the cost grows with the number of different weights and not
    with the size of the lexicon.
    """
    if model is not None:
        return _model_column(df, model, text_col, T.DoubleType(), out_col)
    by_weight: dict[float, list[str]] = {}
    for word, weight in lexicon.items():
        by_weight.setdefault(float(weight), []).append(word)
    total = F.lit(0.0)
    for weight in sorted(by_weight):
        total = total + F.lit(weight) * count_words(F.col("_tone"), by_weight[weight])
    hits = F.nullif(F.size("_tone").cast("double"), F.lit(0.0))
    return (
        df.withColumn("_tone", keep_words(tokens(F.col(text_col)), lexicon))
        .withColumn(
            out_col, F.when(F.col(text_col).isNotNull(), F.coalesce(total / hits, F.lit(0.0)))
        )
        .drop("_tone")
    )


def enrich_narratives(
    narratives: DataFrame,
    field_patterns: Mapping[str, str] = FIELD_PATTERNS,
    lexicon: Mapping[str, float] = TONE_WORDS,
    extract_model: Model | None = None,
    tone_model: Model | None = None,
) -> DataFrame:
    """Narrative columns plus extracted fields and tone, in one pass over the text."""
    rows = extract_fields(
        narratives, "narrative_text", field_patterns, extract_model, "extracted"
    )
    return sentiment(rows, "narrative_text", lexicon, tone_model, "narrative_sentiment")


# Text of a case; {onset_days} is computed, every other name is a report column.
NARRATIVE_TEMPLATE = (
    "Patient: {patient_sex}, aged {patient_age}, weight {patient_weight} kg, "
    "received {drug_name} {drug_dose} ({drug_route}) for {indication} and developed "
    "{ae_term} (severity: {ae_severity}, seriousness: {ae_seriousness}) after {onset_days} days. "
    "The outcome was {ae_outcome}."
)


def render_narrative(
    reports: DataFrame, template: str = NARRATIVE_TEMPLATE, out_col: str = "narrative_text"
) -> DataFrame:
    """Adds the filled template. Any missing part but the weight makes the whole text NULL."""
    computed = {
        "onset_days": F.datediff("ae_onset_date", "drug_start_date").cast("string"),
        "patient_weight": F.coalesce(F.col("patient_weight").cast("string"), F.lit("unknown")),
    }
    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(computed.get(name, F.col(name).cast("string")))
    return reports.withColumn(out_col, F.concat(*parts))


def pending_narratives(
    reports: DataFrame, narratives: DataFrame, limit: int = 10, cases: DataFrame | None = None
) -> DataFrame:
    """Reports whose case has no narrative yet: the next batch in a fixed order.

    Only reports up to the last case of the batch are made and sorted with all their columns.
    ``cases`` has the ``case_id`` of each report, where that is cheaper to read than the reports.
    """
    order = ["case_id", "drug_name", "ae_term", "report_date"]
    rest = [c for c in reports.columns if c not in order]
    ids = not_yet_in((reports if cases is None else cases).select("case_id"), narratives, "case_id")
    batch = ids.orderBy(F.col("case_id").asc_nulls_last()).limit(limit)
    # NULL where the batch has room for cases without an id, which come last: then all are looked at.
    last = batch.agg(F.when(F.count("case_id") == limit, F.max("case_id"))).scalar()
    near = reports.filter(F.coalesce(F.col("case_id") <= last, last.isNull()))
    return (
        not_yet_in(near, narratives, "case_id")
        .orderBy(*[F.col(c).asc_nulls_last() for c in order + rest])
        .limit(limit)
    )
