"""Call recordings: transcripts, call analysis and adverse-event extraction.

Analysis and extraction read speaker turns (one row per turn), so a very long call is spread over
tasks and only small partial results meet per call. The rules are word lists; acoustic cues cannot
be read from text, so that field stays an empty list.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medwarden import schemas
from medwarden.functions.phrases import phrases_in
from medwarden.functions.text import count_words, keep_words, tokens
from medwarden.operators.enrichment import Model, apply_model
from medwarden.sources.files import not_yet_in

CALL_KEY = ["file_path", "file_name"]


# --- transcripts --------------------------------------------------------------------------


def assemble_transcripts(
    turns: DataFrame,
    key: Sequence[str] = ("file_path", "file_name", "received_at"),
    turn: str = "turn",
    speaker: str | None = "speaker_label",
    text: str = "text",
) -> DataFrame:
    """One row per recording with ``{text, segments}``, turns in order.

    With a speaker, lines read ``speaker: text`` and segments name the speaker. A transcript is a
    single value of the result, so the turns of one recording have to fit a row; work that only
    needs the turns should use them directly (see ``call_intelligence``).
    """
    fields = [F.col(turn).alias("turn")]
    if speaker:
        fields.append(F.col(speaker).alias("speaker_label"))
    fields.append(F.col(text).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct(*fields)))

    def line(s: Column) -> Column:
        return F.concat(s["speaker_label"], F.lit(": "), s["text"]) if speaker else s["text"]

    def segment(s: Column) -> Column:
        parts = [s["speaker_label"]] if speaker else []
        names = ["speaker_label"] if speaker else []
        return F.struct(
            s["turn"].alias("turn"),
            *[p.alias(n) for p, n in zip(parts, names, strict=True)],
            s["text"].alias("text"),
        )

    return (
        turns.groupBy(*key)
        .agg(ordered.alias("_turns"))
        .select(
            *key,
            F.struct(
                F.array_join(F.transform("_turns", line), "\n").alias("text"),
                F.transform("_turns", segment).alias("segments"),
            ).alias("transcription_result"),
            F.current_timestamp().alias("transcribed_at"),
        )
    )


def explode_segments(transcripts: DataFrame) -> DataFrame:
    """Transcript rows back to turns."""
    rows = transcripts.select(
        *CALL_KEY, F.explode("transcription_result.segments").alias("s")
    )
    names = rows.schema["s"].dataType.fieldNames()
    speaker = F.col("s.speaker_label") if "speaker_label" in names else F.lit(None).cast("string")
    return rows.select(
        *CALL_KEY,
        F.col("s.turn").alias("turn"),
        speaker.alias("speaker_label"),
        F.col("s.text").alias("text"),
    )


def transcribe_increment(
    catalog: DataFrame, done: DataFrame, turns: DataFrame, limit: int = 10
) -> DataFrame:
    """Transcripts of catalogued files that have none yet: oldest first, ``limit`` per run."""
    batch = (
        not_yet_in(catalog.select("file_path", "received_at"), done, "file_path")
        .orderBy(F.col("received_at").asc_nulls_last(), F.col("file_path").asc_nulls_last())
        .limit(limit)
        .select("file_path")
    )
    # ``limit`` rows.
    return assemble_transcripts(turns.join(F.broadcast(batch), "file_path", "left_semi"))


# --- call analysis ------------------------------------------------------------------------


@dataclass(frozen=True)
class CallRules:
    """Word lists of the call analysis. Earlier entries of a mapping win over later ones."""

    emotions: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {
            "distressed": ["scared", "terrified", "crying", "panic", "desperate"],
            "angry": ["angry", "furious", "unacceptable", "complaint"],
            "confused": ["confused", "unsure", "understand"],
            "concerned": ["worried", "concerned", "anxious"],
        }
    )
    urgency: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {
            "emergency": ["emergency", "ambulance", "unconscious", "breathing"],
            "urgent": ["urgent", "immediately", "hospital"],
            "elevated": ["soon", "worse", "worsening"],
        }
    )
    call_types: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {
            "adverse_event_report": ["reaction", "rash", "pain", "nausea", "dizziness", "swelling"],
            "product_quality_complaint": ["broken", "damaged", "discoloured", "expired", "leaking"],
            "off_label_inquiry": ["off", "unapproved", "unlicensed"],
            "standard_drug_info": ["dose", "dosage", "storage", "interaction", "information"],
        }
    )
    # Each group the agent covers adds an equal part to a score of 100.
    compliance: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {
            "greeting": ["hello", "welcome", "morning", "afternoon"],
            "identity": ["name", "speaking", "calling"],
            "event_check": ["symptoms", "experience", "experienced", "happened"],
            "closing": ["thank", "thanks", "else"],
        }
    )
    rude: Sequence[str] = ("stupid", "ridiculous", "shut", "whatever")
    agent_roles: Sequence[str] = ("agent", "assistant")
    words_per_minute: int = 150

    def all_words(self) -> list[str]:
        groups = [self.emotions, self.urgency, self.call_types, self.compliance]
        return [w for g in groups for words in g.values() for w in words] + list(self.rude)


def _first_named(groups: Mapping[str, Sequence[str]], prefix: str, default: str) -> Column:
    """The first group with a hit."""
    result = F.lit(default)
    for name in reversed(list(groups)):
        result = F.when(F.col(prefix + name) > 0, name).otherwise(result)
    return result


def call_intelligence(
    turns: DataFrame,
    rules: CallRules | None = None,
    model: Model | None = None,
    key: Sequence[str] = tuple(CALL_KEY),
) -> DataFrame:
    """One nine-field record per call, with the time of analysis.

    Without turns marked as the agent's (videos), the compliance rules look at every turn.
    """
    rules = rules or CallRules()
    if model is not None:
        return _model_record(
            turns, model, key, schemas.CALL_INTELLIGENCE, "audio_intelligence_json", "analyzed_at"
        )
    words = tokens(F.col("text"))
    is_agent = F.col("speaker_label").isNull() | F.col("speaker_label").isin(
        list(rules.agent_roles)
    )
    counters: dict[str, Column] = {}
    for prefix, groups in (
        ("emotion_", rules.emotions),
        ("urgency_", rules.urgency),
        ("type_", rules.call_types),
    ):
        for name, group in groups.items():
            counters[prefix + name] = count_words(F.col("_hits"), group)
    for name, group in rules.compliance.items():
        counters["said_" + name] = F.when(is_agent, count_words(F.col("_hits"), group))
    counters["rude"] = F.when(is_agent, count_words(F.col("_hits"), rules.rude))
    per_call = (
        turns.select(*key, "speaker_label", words.alias("_words"))
        .withColumn("_hits", keep_words(F.col("_words"), rules.all_words()))
        .groupBy(*key)
        .agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in counters.items()],
            F.coalesce(F.sum(F.size("_words")), F.lit(0)).alias("n_words"),
        )
    )
    covered = reduce(
        lambda a, b: a + b,
        [F.when(F.col("said_" + n) > 0, 1).otherwise(0) for n in rules.compliance],
    )
    call_type = F.lit("unknown")
    best = F.greatest(*[F.col("type_" + n) for n in rules.call_types])
    for name in reversed(list(rules.call_types)):
        call_type = F.when((F.col("type_" + name) == best) & (best > 0), name).otherwise(call_type)
    minutes = F.lit(rules.words_per_minute)
    duration = (
        F.when(F.col("n_words") < minutes * 2, schemas.DURATION_CATEGORIES[0])
        .when(F.col("n_words") <= minutes * 8, schemas.DURATION_CATEGORIES[1])
        .otherwise(schemas.DURATION_CATEGORIES[2])
    )
    staged = per_call.select(
        *key,
        _first_named(rules.emotions, "emotion_", "calm").alias("state"),
        _first_named(rules.urgency, "urgency_", "routine").alias("urgency"),
        (covered.cast("double") * 100.0 / len(rules.compliance)).alias("score"),
        (F.col("rude") == 0).alias("professional"),
        duration.alias("duration"),
        call_type.alias("call_type"),
    )
    pressing = F.col("urgency").isin("urgent", "emergency")
    upset = F.col("state").isin("distressed", "angry") & (
        F.col("call_type") == "adverse_event_report"
    )
    reason = F.nullif(
        F.concat_ws(
            ", ",
            F.when(pressing, F.concat(F.lit("urgency "), F.col("urgency"))),
            F.when(upset, F.concat(F.lit("caller "), F.col("state"))),
            F.when(~F.col("professional"), F.lit("agent tone")),
        ),
        F.lit(""),
    )
    record = F.struct(
        F.col("state").alias("caller_emotional_state"),
        F.col("urgency").alias("caller_urgency_level"),
        F.array().cast("array<string>").alias("ae_acoustic_signals"),
        F.col("score").alias("agent_compliance_score"),
        F.col("professional").alias("agent_tone_professional"),
        F.col("duration").alias("call_duration_category"),
        F.col("call_type").alias("call_type_inferred"),
        reason.isNotNull().alias("escalation_recommended"),
        reason.alias("escalation_reason"),
    )
    return staged.select(
        *key,
        record.alias("audio_intelligence_json"),
        F.current_timestamp().alias("analyzed_at"),
    )


def _model_record(
    turns: DataFrame, model: Model, key: Sequence[str], out_type, out_col: str, time_col: str
) -> DataFrame:
    transcripts = assemble_transcripts(turns, key=key).select(
        *key, F.col("transcription_result.text").alias("text")
    )
    applied = apply_model(transcripts, model, ["text"], out_type, out_col=out_col)
    return applied.select(*key, out_col, F.current_timestamp().alias(time_col))


# --- adverse-event extraction -------------------------------------------------------------

# Phrases of a lexicon that travel with the plan as a trie.
TRIE_PHRASES = 100_000

EXPEDITED = [c for c in schemas.SERIOUSNESS_CRITERIA if c != "none"]

SERIOUS_WORDS: dict[str, list[str]] = {
    "death": ["died", "death", "fatal"],
    "life_threatening": ["icu", "resuscitation", "lifethreatening"],
    "hospitalization": ["hospital", "hospitalised", "hospitalized", "admitted"],
    "disability": ["disabled", "disability", "paralysed"],
    "congenital_anomaly": ["congenital", "malformation"],
    "medically_significant": ["serious", "significant"],
}
OUTCOME_WORDS: dict[str, list[str]] = {
    "fatal": ["died", "fatal"],
    "not_recovered": ["ongoing", "persisting", "unresolved"],
    "sequelae": ["sequelae", "permanent"],
    "recovering": ["recovering", "improving"],
    "recovered": ["recovered", "resolved"],
}
CAUSALITY_WORDS: dict[str, list[str]] = {
    "certain": ["rechallenge"],
    "probable": ["stopped", "dechallenge"],
    "unlikely": ["unrelated", "unlikely"],
}


@dataclass(frozen=True)
class ExtractionRules:
    """Word lists of the extraction. Earlier entries of a mapping win over later ones."""

    seriousness: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(SERIOUS_WORDS))
    outcomes: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(OUTCOME_WORDS))
    causality: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(CAUSALITY_WORDS))
    female: Sequence[str] = ("female", "woman", "she", "her")
    male: Sequence[str] = ("male", "man", "he", "his")
    quality: Sequence[str] = ("broken", "damaged", "discoloured", "leaking")
    off_label: Sequence[str] = ("unapproved", "unlicensed", "offlabel")
    age_pattern: str = r"([0-9]{1,3}) years? old"
    id_pattern: str = r"(PAT-[A-Za-z0-9]+)"
    dose_pattern: str = (
        r"(?:^|[^A-Za-z0-9.,])([0-9]+(?:[.,][0-9]+)? ?(?:mcg|µg|μg|ug|mg|ml|IU|iu|g))(?:[^A-Za-z]|$)"
    )
    routes: Sequence[str] = ("oral", "intravenous", "subcutaneous", "intramuscular")

    def all_words(self) -> list[str]:
        groups = [self.seriousness, self.outcomes, self.causality]
        flat = [w for g in groups for words in g.values() for w in words]
        return [*flat, *self.female, *self.male, *self.quality, *self.off_label, *self.routes]


def reporting_deadline(
    seriousness: Column, has_event: Column, expedited: Sequence[str] = tuple(EXPEDITED)
) -> Column:
    """15 days for any serious criterion, 90 days for other events, none without an event."""
    serious = F.arrays_overlap(seriousness, F.array(*[F.lit(c) for c in expedited]))
    return (
        F.when(~F.coalesce(has_event, F.lit(False)), schemas.DEADLINE_CLASSES[2])
        .when(F.coalesce(serious, F.lit(False)), schemas.DEADLINE_CLASSES[0])
        .otherwise(schemas.DEADLINE_CLASSES[1])
    )


def icsr_completeness(events: Column, drug: Column, patient: Column) -> Column:
    """A valid case needs a patient, a drug and an event; complete ones also name dose and route.

    ``events`` is the event array, ``drug`` and ``patient`` are the record's structs.
    """
    has_event = F.coalesce(F.size(events), F.lit(0)) > 0
    has_drug = drug["drug_name"].isNotNull()
    has_patient = F.coalesce(patient["age"], patient["sex"], patient["identifier"]).isNotNull()
    has_more = drug["drug_dose"].isNotNull() & drug["drug_route"].isNotNull()
    return (
        F.when(~has_event, "no_ae")
        .when(~(has_drug & has_patient), "incomplete")
        .when(has_more, "complete")
        .otherwise("minimum_criteria_met")
    )


def _first_found(value: Column, name: str) -> Column:
    """The value of the earliest turn that has one."""
    return F.min(F.when(value.isNotNull(), F.struct(F.col("turn"), value.alias("v")))).alias(name)


def _matched(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _lexicon_hits(worded: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    """(*key, turn, text, kind, name, soc) of each phrase that a turn has.

    A lexicon of up to ``TRIE_PHRASES`` phrases is a trie that is walked along each turn, so nothing
    but hits leaves the rows. A larger one is joined on first words.
    """
    rows = wanted.limit(TRIE_PHRASES + 1).collect()
    if len(rows) > TRIE_PHRASES:
        return _joined_hits(worded, wanted, key)
    firsts = {r["_phrase"][0] for r in rows}
    starts = worded.filter(F.exists("_words", lambda w: w.isin(sorted(firsts)))) if firsts else worded.limit(0)
    spark = worded.sparkSession
    entries = [(i, r.kind, r["name"], r.soc) for i, r in enumerate(rows)]
    names = spark.createDataFrame(entries, "_hit int, kind string, name string, soc string")
    hits = starts.select(*key, "turn", "text", phrases_in(F.col("_words"), [r["_phrase"] for r in rows]).alias("_found"))
    # explode_outer: explode would add a filter that walks each turn again. The names are at most
    # TRIE_PHRASES rows.
    return hits.withColumn("_hit", F.explode_outer("_found")).join(F.broadcast(names), "_hit").drop("_hit", "_found")


def _joined_hits(worded: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    """``_lexicon_hits`` for lexicons of any size: each word is joined with the phrases it begins."""
    longest = wanted.agg(F.max(F.size("_phrase"))).scalar()
    # explode_outer, because for explode the optimizer adds a filter that would split each text again.
    spots = worded.select(*key, "turn", "text", "_words", F.posexplode_outer("_words").alias("_at", "_first"))
    spots = spots.select(
        *key, "turn", "text", "_first", F.slice("_words", F.col("_at") + 1, longest).alias("_behind")
    )
    found = spots.join(wanted, F.col("_first") == F.col("_phrase")[0]).filter(
        F.slice("_behind", F.lit(1), F.size("_phrase")) == F.col("_phrase")
    )
    return found.select(*key, "turn", "text", "kind", "name", "soc")


def extract_adverse_events(
    turns: DataFrame,
    term_lexicon: DataFrame | None = None,
    drug_lexicon: DataFrame | None = None,
    rules: ExtractionRules | None = None,
    model: Model | None = None,
    key: Sequence[str] = tuple(CALL_KEY),
) -> DataFrame:
    """One nested extraction record per call, with the time of extraction.

    ``term_lexicon`` has columns phrase, preferred_term, soc_class; ``drug_lexicon`` has phrase,
    drug_name. A phrase has any number of words and is split like the text, so case and signs
    between its words do not matter. A call lists each preferred term once, with the text of the
    turn that first mentions it.
    """
    if model is not None:
        return _model_record(
            turns, model, key, schemas.AE_EXTRACTION, "ae_extraction_json", "extracted_at"
        )
    rules = rules or ExtractionRules()
    if term_lexicon is None or drug_lexicon is None:
        raise ValueError("term_lexicon and drug_lexicon are needed unless a model is given")
    worded = turns.select(*key, "turn", "text", tokens(F.col("text")).alias("_words"))

    # Everything but the lexicon hits: small per-turn values, combined per call.
    count = lambda group: count_words(F.col("_hits"), group)
    groups = {
        "serious_": rules.seriousness,
        "outcome_": rules.outcomes,
        "causal_": rules.causality,
    }
    sums = {p + n: count(w) for p, g in groups.items() for n, w in g.items()}
    sums |= {
        "female": count(rules.female),
        "male": count(rules.male),
        "quality": count(rules.quality),
        "off_label": count(rules.off_label),
    }
    route = F.get(keep_words(F.col("_hits"), rules.routes), F.lit(0))
    features = (
        worded.withColumn("_hits", keep_words(F.col("_words"), rules.all_words()))
        .groupBy(*key)
        .agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()],
            _first_found(_matched(F.col("text"), rules.age_pattern), "age"),
            _first_found(_matched(F.col("text"), rules.id_pattern), "identifier"),
            _first_found(_matched(F.col("text"), rules.dose_pattern), "dose"),
            _first_found(route, "route"),
        )
    )

    lexicon = term_lexicon.select(
        "phrase",
        F.lit("event").alias("kind"),
        F.col("preferred_term").alias("name"),
        F.col("soc_class").alias("soc"),
    ).unionByName(
        drug_lexicon.select(
            "phrase",
            F.lit("drug").alias("kind"),
            F.col("drug_name").alias("name"),
            F.lit(None).cast("string").alias("soc"),
        )
    )
    wanted = lexicon.select(tokens(F.col("phrase")).alias("_phrase"), "kind", "name", "soc").filter(
        F.size("_phrase") > 0
    )
    # With its first mention, each name of a call brings the text of that turn.
    mentions = (
        _lexicon_hits(worded, wanted, key)
        .groupBy(*key, "kind", "name")
        .agg(F.min(F.struct("turn", "text")).alias("first"), F.min("soc").alias("soc"))
    )
    # At most one element per lexicon term and call.
    event_list = F.sort_array(
        F.collect_list(F.when(F.col("kind") == "event", F.struct("name", "soc", "first")))
    )
    first_drug = F.min(F.when(F.col("kind") == "drug", F.struct(F.col("first.turn"), "name")))
    named = mentions.groupBy(*key).agg(
        event_list.alias("events"), first_drug["name"].alias("drug_name")
    )

    criteria = F.array_compact(
        F.array(*[F.when(F.col("serious_" + n) > 0, F.lit(n)) for n in rules.seriousness])
    )
    seriousness = F.when(F.size(criteria) > 0, criteria).otherwise(F.array(F.lit("none")))
    outcome = _first_named(rules.outcomes, "outcome_", "unknown")
    has_drug = F.col("drug_name").isNotNull()
    causality = F.when(~has_drug, "unassessable").otherwise(
        _first_named(rules.causality, "causal_", "possible")
    )
    sex = F.when((F.col("female") > F.col("male")), "Female").when(
        F.col("male") > F.col("female"), "Male"
    )
    text_null = F.lit(None).cast("string")
    staged = features.join(named, list(key), "left").select(
        *key,
        F.coalesce("events", F.array().cast(named.schema["events"].dataType)).alias("events"),
        seriousness.alias("seriousness"),
        outcome.alias("outcome"),
        causality.alias("causality"),
        F.struct(
            F.col("drug_name"),
            F.col("dose.v").alias("drug_dose"),
            F.col("route.v").alias("drug_route"),
            text_null.alias("indication"),
        ).alias("drug"),
        F.struct(
            F.col("age.v").alias("age"),
            sex.alias("sex"),
            F.col("identifier.v").alias("identifier"),
        ).alias("patient"),
        (F.col("quality") > 0).alias("quality"),
        (F.col("off_label") > 0).alias("off_label"),
    )
    has_event = F.size("events") > 0
    events = F.transform(
        "events",
        lambda e: F.struct(
            e["first"]["text"].alias("ae_description_verbatim"),
            e["name"].alias("meddra_preferred_term"),
            e["soc"].alias("meddra_soc_class"),
            F.col("seriousness").alias("seriousness_criteria"),
            F.col("outcome").alias("outcome"),
            F.col("causality").alias("causality_who_umc"),
        ),
    )
    summary = F.when(
        has_event,
        F.concat(
            F.coalesce(F.col("drug.drug_name"), F.lit("unknown drug")),
            F.lit(": "),
            F.array_join(F.transform("events", lambda e: e["name"]), ", "),
            F.lit("; outcome "),
            F.col("outcome"),
        ),
    )
    record = F.struct(
        has_event.alias("ae_detected"),
        icsr_completeness(F.col("events"), F.col("drug"), F.col("patient")).alias(
            "icsr_completeness"
        ),
        events.alias("adverse_events"),
        F.col("drug").alias("suspect_drug"),
        F.col("patient").alias("patient"),
        F.col("quality").alias("product_quality_complaint"),
        F.col("off_label").alias("off_label_use_mentioned"),
        reporting_deadline(F.col("seriousness"), has_event).alias("reporting_deadline"),
        summary.alias("narrative_summary"),
    )
    return staged.select(
        *key, record.alias("ae_extraction_json"), F.current_timestamp().alias("extracted_at")
    )


# --- record checks ------------------------------------------------------------------------


@dataclass(frozen=True)
class RecordSpec:
    """Required fields and allowed values of a record; ``list[].field`` looks into arrays."""

    column: str
    required: Sequence[str] = ()
    allowed: Mapping[str, Sequence[str]] = field(default_factory=dict)


INTELLIGENCE_SPEC = RecordSpec(
    "audio_intelligence_json",
    required=(
        "caller_emotional_state",
        "caller_urgency_level",
        "agent_compliance_score",
        "call_type_inferred",
        "escalation_recommended",
    ),
    allowed={
        "caller_emotional_state": schemas.EMOTIONAL_STATES,
        "caller_urgency_level": schemas.URGENCY_LEVELS,
        "call_duration_category": schemas.DURATION_CATEGORIES,
        "call_type_inferred": schemas.CALL_TYPES,
    },
)
EXTRACTION_SPEC = RecordSpec(
    "ae_extraction_json",
    required=(
        "ae_detected",
        "icsr_completeness",
        "adverse_events",
        "suspect_drug",
        "reporting_deadline",
        "adverse_events[].ae_description_verbatim",
        "adverse_events[].meddra_preferred_term",
        "adverse_events[].seriousness_criteria",
        "adverse_events[].outcome",
    ),
    allowed={
        "icsr_completeness": schemas.COMPLETENESS_LEVELS,
        "reporting_deadline": schemas.DEADLINE_CLASSES,
        "adverse_events[].seriousness_criteria[]": schemas.SERIOUSNESS_CRITERIA,
        "adverse_events[].outcome": schemas.EVENT_OUTCOMES,
        "adverse_events[].causality_who_umc": schemas.CAUSALITY_LEVELS,
    },
)


def _fails(value: Column, path: str, test) -> Column:
    """Whether ``test`` holds for the value at ``path``, or for any element along ``[]``."""
    head, _, rest = path.partition("[]")
    for name in [p for p in head.split(".") if p]:
        value = value[name]
    if "[]" not in path:
        return test(value)
    return F.exists(F.coalesce(value, F.array()), lambda e: _fails(e, rest, test))


def validate_records(df: DataFrame, spec: RecordSpec) -> DataFrame:
    """Adds ``violations``: the broken rules of each record. A NULL record breaks one rule."""
    # explode_outer: otherwise the optimizer makes the record anew for each rule that reads it.
    df = df.withColumn("_record", F.explode_outer(F.array(spec.column)))
    record = F.col("_record")
    checks = [
        F.when(_fails(record, path, lambda v: v.isNull()), F.lit(f"missing {path}"))
        for path in spec.required
    ]
    checks += [
        F.when(
            _fails(
                record,
                path,
                lambda v, values=values: F.coalesce(~v.isin(list(values)), F.lit(False)),
            ),
            F.lit(f"not allowed {path}"),
        )
        for path, values in spec.allowed.items()
    ]
    found = F.array_compact(F.array(*checks))
    return df.withColumn(
        "violations",
        F.when(record.isNull(), F.array(F.lit("no record"))).otherwise(found),
    ).drop("_record")
