"""Parameters of the registered queries: word lists that occur in the generated texts."""

from __future__ import annotations

import datetime as dt

from medwarden.operators.calls import CallRules, ExtractionRules

TONE = {
    "the": 0.5, "la": 0.5, "die": 0.5, "thin": 1.0, "les": 1.0,
    "of": -0.5, "und": -0.5, "was": -0.5, "re": -1.0, "nicht": -1.0,
}

CALL_RULES = CallRules(
    emotions={
        "distressed": ["pas", "nicht", "thth"],
        "angry": ["von", "sh"],
        "confused": ["thre", "ther"],
        "concerned": ["un", "ou", "ea"],
    },
    urgency={
        "emergency": ["thnd"],
        "urgent": ["thea", "thor"],
        "elevated": ["thon", "than", "thin"],
    },
    call_types={
        "adverse_event_report": ["tion", "ing"],
        "product_quality_complaint": ["les", "das"],
        "off_label_inquiry": ["erth", "thha"],
        "standard_drug_info": ["ble", "nt"],
    },
    compliance={
        "greeting": ["the", "die", "la"],
        "identity": ["is", "der", "le"],
        "event_check": ["was", "und"],
        "closing": ["for", "en"],
    },
    rude=["nd"],
    agent_roles=["assistant"],
    words_per_minute=40,
)

EXTRACTION_RULES = ExtractionRules(
    seriousness={
        "death": ["erth"],
        "life_threatening": ["thor"],
        "hospitalization": ["thnd", "von"],
        "disability": ["das"],
        "congenital_anomaly": ["et"],
        "medically_significant": ["ly", "les"],
    },
    outcomes={
        "fatal": ["thth"],
        "not_recovered": ["ther"],
        "sequelae": ["sh"],
        "recovering": ["zu"],
        "recovered": ["ble"],
    },
    causality={"certain": ["thre"], "probable": ["than", "un"], "unlikely": ["wh"]},
    female=["she", "la", "die"],
    male=["he", "le", "der"],
    quality=["ou"],
    off_label=["nt"],
    age_pattern="([0-9]{1,3})",
    id_pattern="([a-z0-9.]+@[a-z0-9.]+)",
    dose_pattern="([0-9]+ [a-z])",
    routes=["ing", "ti"],
)

TERM_PHRASES = [
    ("tion", "Term A", "Class 1"),
    ("of the", "Term B", "Class 2"),
    ("in the", "Term B", "Class 2"),
    ("de la", "Term C", "Class 3"),
    ("thin", "Term D", "Class 1"),
    ("in this ouing", "Term E", "Class 4"),
    ("erti anthhees isontilyed hewh oned", "Term F", "Class 4"),
    ("threedin thonsttion anshtionsh a thanst", "Term G", "Class 2"),
]
DRUG_PHRASES = [("ea", "Drug X"), ("es", "Drug Y"), ("nd", "Drug X"), ("on the", "Drug Z")]

# Share of the vector index's lists that a query probes: the vectors hardly fall into clusters.
PROBES = 0.75
QUERIES = [(1, "the thin nicht"), (2, "ble und les"), (3, "token src"), (4, "absentword")]
KEYWORDS = "ble thin nicht"
SUBSTRING = "GIZMO"
TRANSCRIPT_SUBSTRING = "TION"

TRIAGE_DAY = dt.date(1998, 6, 1)
QUALITY_TIME = dt.datetime(2002, 1, 1, 0, 0, 0)
HEALTH_TIME = dt.datetime(2024, 1, 15, 12, 30, 0)
