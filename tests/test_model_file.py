import json

import pytest

from medwarden.plans.model_file import double_literals, load_model, model_of, run_verified

MODEL = """
tables:
  - name: EVENTS
    base_table: {database: DB, schema: S, table: EVENTS}
    dimensions:
      - {name: event_id, expr: EVENT_ID, unique: true}
    time_dimensions:
      - {name: day, expr: DAY}
    measures:
      - {name: events, expr: COUNT(*)}
      - {name: bad_rate, expr: "COUNT(CASE WHEN KIND = '100.0' THEN 1 END) * 100.0 / NULLIF(COUNT(*), 0)"}
  - name: PEOPLE
    base_table: {database: DB, schema: S, table: PEOPLE}
    dimensions:
      - {name: sex, expr: SEX}
    measures:
      - {name: people, expr: COUNT(DISTINCT ID)}
relationships:
  - name: who
    left_table: EVENTS
    right_table: PEOPLE
    join_type: %s
    relationship_type: %s
    on:
      - {left_column: PERSON, right_column: ID}
verified_queries:
  - name: by_sex
    question: How many events are there by sex?
    sql: >
      SELECT p.SEX, COUNT(*) * 1.0 / 4 AS share, '{braces}' AS b, 'db.s.other' AS t
      FROM DB.S.EVENTS e JOIN People p ON e.PERSON = p.ID GROUP BY p.SEX
"""


@pytest.fixture
def frames(spark):
    events = [(1, "a", "100.0", "2024-01-01"), (2, "a", "x", "2024-01-01"), (3, "b", "x", "2024-01-02"), (4, None, "x", None)]
    people = [("a", "F"), ("b", "M"), ("b", "M"), ("c", "F")]
    return {
        "events": spark.createDataFrame(events, "event_id int, person string, kind string, day string"),
        "people": spark.createDataFrame(people, "id string, sex string"),
    }


def model(tmp_path, how="left", kind="many_to_one"):
    path = tmp_path / "model.yaml"
    path.write_text(MODEL % (how, kind))
    return load_model(str(path))


def test_file_gives_a_model(tmp_path, frames, rows):
    m = model(tmp_path)
    assert m.fact == "events" and m.relationships[0].keys == (("person", "id"),)
    assert [d.name for d in m.dimensions if d.unique] == ["event_id"]
    got = m.query(frames, ["events", "bad_rate", "people"], ["sex"])
    assert dict(got.dtypes)["bad_rate"] == "double"
    # A person without an event counts where only the table of people is asked.
    assert rows(got) == [("F", 2, 50.0, 2), ("M", 1, 0.0, 1), (None, 1, 0.0, None)]


def test_inner_relationships_leave_rows_out(tmp_path, frames, rows):
    got = model(tmp_path, "inner").query(frames, ["events"], ["sex"])
    assert rows(got) == [("F", 2), ("M", 1)]


def test_verified_queries_run_over_the_frames(tmp_path, frames, rows):
    got = run_verified(model(tmp_path), frames, "by_sex")
    # Both rows of b count: the query joins as it is written.
    assert rows(got) == [("F", 0.5, "{braces}", "db.s.other"), ("M", 0.5, "{braces}", "db.s.other")]
    with pytest.raises(KeyError):
        run_verified(model(tmp_path), frames, "absent")


def test_what_cannot_be_kept_is_refused(tmp_path):
    with pytest.raises(ValueError, match="one row a key"):
        model(tmp_path, kind="many_to_many")
    with pytest.raises(ValueError, match="join type"):
        model(tmp_path, how="cross")
    table = {"name": "t", "dimensions": []}
    link = {"name": "r", "left_table": "t", "right_table": "u", "on": [{"left_column": "a", "right_column": "a"}]}
    with pytest.raises(ValueError, match="unknown table"):
        model_of({"tables": [table], "relationships": [link]})
    with pytest.raises(ValueError, match="names no columns"):
        model_of({"tables": [table], "relationships": [{**link, "right_table": "t", "on": []}]})


def test_json_needs_no_yaml(tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"tables": [{"name": "T", "measures": [{"name": "n", "expr": "COUNT(*)"}]}]}))
    assert load_model(str(path)).fact == "t"


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("a * 100.0 / b", "a * 100.0D / b"),
        ("'it''s 1.5' || 2.5", "'it''s 1.5' || 2.5D"),
        ("t1.c2 + x1.5y + 3", "t1.c2 + x1.5y + 3"),
        ("1.2.3", "1.2.3"),
    ],
)
def test_decimals_become_doubles(sql, want):
    assert double_literals(sql) == want
