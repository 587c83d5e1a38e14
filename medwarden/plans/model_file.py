"""Metric models from files: what a YAML or JSON file says about tables becomes a ``MetricModel``.

A file has tables (``base_table``, dimensions, time_dimensions, measures), relationships and verified
queries. Expressions and queries are SQL that Spark parses; names are found in any case, as there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame

from medwarden.plans.metrics import Dimension, Measure, MetricModel, Relationship, VerifiedQuery

JOIN_TYPES = {"left": "left", "left_outer": "left", "inner": "inner"}
TO_ONE = {"many_to_one", "one_to_one"}

# Text in quotes, or a number with a point that is not part of a name.
_DECIMAL = re.compile(r"('(?:[^']|'')*')|(?<![\w.])(\d+\.\d+)(?![\w.])")


def double_literals(sql: str) -> str:
    """``sql`` with numbers like 100.0 as doubles: Spark reads them as decimals, which makes ratios
    decimals of few digits."""
    return _DECIMAL.sub(lambda m: m[1] or f"{m[2]}D", sql)


def _parsed(text: str) -> Mapping:
    if text.lstrip().startswith("{"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise ImportError("a YAML model needs the yaml package; JSON does not") from error
    return yaml.safe_load(text)


def load_model(path: str, fact: str | None = None) -> MetricModel:
    """The model of a YAML or JSON file (see ``model_of``)."""
    with open(path, encoding="utf-8") as file:
        return model_of(_parsed(file.read()), fact)


def _column_pairs(relationship: Mapping) -> tuple[tuple[str, str], ...]:
    # YAML 1.1 reads the key ``on`` as true.
    pairs = relationship.get("on", relationship.get(True)) or relationship.get("relationship_columns")
    if not pairs:
        raise ValueError(f"relationship {relationship['name']!r} names no columns")
    return tuple((p["left_column"].lower(), p["right_column"].lower()) for p in pairs)


def _relationship(r: Mapping) -> Relationship:
    kind = r.get("relationship_type", "many_to_one")
    if kind not in TO_ONE:
        raise ValueError(f"relationship {r['name']!r} is {kind}; its right side must be one row a key")
    how = r.get("join_type", "left")
    if how not in JOIN_TYPES:
        raise ValueError(f"relationship {r['name']!r} has join type {how!r}")
    return Relationship(
        r["name"], r["left_table"].lower(), r["right_table"].lower(), _column_pairs(r), JOIN_TYPES[how]
    )


def _full_name(table: Mapping) -> str:
    base = table.get("base_table") or {}
    parts = [base.get(k) for k in ("database", "schema", "table")]
    return ".".join(p for p in parts if p) or table["name"]


def model_of(config: Mapping, fact: str | None = None) -> MetricModel:
    """A model of a parsed file. Names of tables become lower case; ``fact`` defaults to the left
    table of the first relationship."""
    tables = config["tables"]
    dims, measures = [], []
    for t in tables:
        name = t["name"].lower()
        for d in [*t.get("dimensions", []), *t.get("time_dimensions", [])]:
            dims.append(Dimension(d["name"], name, double_literals(d["expr"]), bool(d.get("unique"))))
        measures += [Measure(m["name"], name, double_literals(m["expr"])) for m in t.get("measures", [])]
    links = tuple(map(_relationship, config.get("relationships", [])))
    known = {t["name"].lower() for t in tables}
    for link in links:
        if not {link.left, link.right} <= known:
            raise ValueError(f"relationship {link.name!r} joins an unknown table")
    first = links[0].left if links else tables[0]["name"].lower()
    return MetricModel(
        (fact or first).lower(),
        tuple(dims),
        tuple(measures),
        links,
        tuple((_full_name(t), t["name"].lower()) for t in tables),
        tuple(
            VerifiedQuery(q["name"], q.get("question", ""), double_literals(q["sql"].strip()))
            for q in config.get("verified_queries", [])
        ),
    )


def run_verified(model: MetricModel, frames: Mapping[str, DataFrame], name: str) -> DataFrame:
    """A verified query of the model over ``frames``, which stand for the tables it names.

    Spark runs the query as it is written. Tables are found by their full name or by their own.
    """
    query = next((q for q in model.verified if q.name == name), None)
    if query is None:
        raise KeyError(f"unknown verified query {name!r}")
    sql = query.sql.replace("{", "{{").replace("}", "}}")
    used = {}
    # Full names first, as they hold the short ones.
    for full, table in sorted({*model.base_tables, *((t, t) for _, t in model.base_tables)}, key=lambda x: -len(x[0])):
        marked, n = re.subn(rf"(?<![\w.{{]){re.escape(full)}(?![\w.}}])", f"{{{table}}}", sql, flags=re.IGNORECASE)
        if n:
            sql, used[table] = marked, frames[table]
    spark = next(iter(frames.values())).sparkSession
    return spark.sql(sql, **used)
