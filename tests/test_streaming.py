import datetime as dt
import uuid
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from medwarden.operators import calls, enrichment, health, search, silver
from medwarden.schemas import AE_REPORTS
from medwarden.session import checkpoint_root
from medwarden.sources import fixtures
from medwarden.sources.tables import read_table, write_table
from medwarden.streaming import chain, refresh, state

EVENTS = (
    "timestamp timestamp_ntz, function_name string, model_used string, latency_ms bigint, "
    "token_count bigint, status string"
)


@pytest.fixture
def place(tmp_path):
    return lambda name: str(tmp_path / name)


@pytest.fixture
def job():
    """A job name no earlier run has used: the shared checkpoint folder outlives a test."""
    return f"test-{uuid.uuid4()}"


def finish(query):
    assert query.awaitTermination(300)
    assert query.exception() is None


def test_checkpoint_folder_comes_from_the_session():
    def session(folder):
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf))

    assert checkpoint_root(session("/shared/"), "/mine") == "/shared"
    assert checkpoint_root(session(None), "/mine/") == "/mine"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(session(None))


def test_catalog_stream_takes_files_once(spark, place, rows, tmp_path, job):
    (tmp_path / "in").mkdir()

    def arrive(*names):
        for name in names:
            (tmp_path / "in" / name).write_bytes(b"abc")

    def run():
        listing = refresh.catalog_stream(spark, place("in"), "*.mp3", max_files=2)
        finish(
            refresh.refresh_stream(
                listing, lambda df: df, place("out"), job, None, place("chk")
            )
        )
        return rows(read_table(spark, place("out")), "file_name", "file_size_bytes")

    arrive("a.mp3", "b.mp3", "c.mp3", "d.mp4")
    assert [r[0] for r in run()] == ["a.mp3", "b.mp3", "c.mp3"]
    arrive("e.mp3")
    assert run() == [("a.mp3", 3), ("b.mp3", 3), ("c.mp3", 3), ("e.mp3", 3)]


def test_distinct_stream_equals_batch(spark, place, rows, job):
    source, columns = place("events"), silver.DRUG_COLUMNS
    schema = ", ".join(f"{c} string" for c in columns) + ", x int"
    first = [("a", "1", "o", None, "m", 1)] * 50 + [("b", None, "o", "i", "m", 2)]
    second = [("a", "1", "o", None, "m", 3), ("c", "1", "o", None, "m", 4)]

    def run():
        stream = refresh.table_stream(spark, source, spark.read.parquet(source).schema)
        finish(
            refresh.refresh_distinct_stream(
                stream, columns, place("dim"), job, None, place("chk")
            )
        )

    for batch in (first, first, second):
        write_table(spark.createDataFrame(batch, schema), source, "append")
        run()
    got = read_table(spark, place("dim")).select(*columns)
    want = rows(silver.dim_drug(spark.read.parquet(source)))
    assert rows(got) == want and got.count() == 3

    # A batch that wrote its rows but was not committed runs again.
    commits = Path(checkpoint_root(spark, place("chk"))) / job / "commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink()
    run()
    assert (commits / str(last)).exists()
    assert rows(read_table(spark, place("dim")).select(*columns)) == want


def test_fact_stream_equals_batch(spark, place, rows, job):
    reports = fixtures.ae_reports(spark, "/root/testdata/sf0.001")
    write_table(reports, place("reports"))

    def fact(df):
        events = enrichment.classify_events(df, fixtures.FIXTURE_LABELS)
        return silver.fact_adverse_event(events)

    stream = refresh.table_stream(spark, place("reports"), AE_REPORTS, max_files=2)
    finish(refresh.refresh_stream(stream, fact, place("fact"), job, None, place("chk")))
    assert rows(read_table(spark, place("fact"))) == rows(fact(reports))


def test_health_stream_matches_batch_for_closed_hours(spark, place, rows, job):
    start = dt.datetime(2024, 1, 1)
    data = [
        (start + dt.timedelta(minutes=7 * i), f"f{i % 2}", "m", i, i, "error" if i % 5 == 0 else "ok")
        for i in range(200)
    ]
    write_table(spark.createDataFrame(data, EVENTS), place("log"))
    events = spark.read.parquet(place("log"))
    stream = refresh.table_stream(spark, place("log"), events.schema)
    live = refresh.function_health_stream(stream)
    finish(refresh.refresh_stream(live, lambda df: df, place("out"), job, None, place("chk")))
    got = rows(read_table(spark, place("out")))
    last = start + dt.timedelta(minutes=7 * 199)
    closed = health.function_health(events).filter(
        F.col("hour") + F.expr("INTERVAL 1 HOUR") <= F.lit(last - dt.timedelta(minutes=10))
    )
    assert got == rows(closed) and len(got) > 30


def test_search_corpus_stays_fresh_on_both_sides(spark, place, rows, job):
    fact_schema = "case_id string, drug_name string, ae_soc_class string, ae_term string, report_date date"
    text_schema = "case_id string, narrative_text string"

    def run(narratives=(), facts=()):
        for data, schema, table in ((narratives, text_schema, "narr"), (facts, fact_schema, "fact")):
            write_table(spark.createDataFrame(list(data), schema), place(table), "append")
        streams = [
            refresh.table_stream(spark, place(table), spark.createDataFrame([], schema).schema)
            for table, schema in (("narr", text_schema), ("fact", fact_schema))
        ]
        finish(chain.refresh_search_corpus(*streams, place("out"), job, None, place("chk")))
        return rows(chain.current_corpus(spark, place("out")), "case_id", "drug_name")

    day = dt.date(2024, 1, 1)
    assert run([("c1", "a"), ("c2", "b")], [("c1", "d", "s", "t", day)]) == [("c1", "d"), ("c2", None)]
    assert run(facts=[("c2", "late", "s", "t", day)]) == [("c1", "d"), ("c2", "late")]
    assert run([("c3", "c")]) == [("c1", "d"), ("c2", "late"), ("c3", None)]


def test_split_recordings_are_rebuilt(spark, place, rows, job):
    terms = spark.createDataFrame(
        [("rash", "Rash", "Skin")], "phrase string, preferred_term string, soc_class string"
    )
    drugs = spark.createDataFrame([("zolina", "Zolina")], "phrase string, drug_name string")
    schema = (
        "file_path string, file_name string, received_at timestamp_ntz, turn bigint, "
        "speaker_label string, text string"
    )
    day, said = dt.datetime(2024, 1, 1), []

    def arrive(*turns, again=False):
        said.extend(turns)
        frame = spark.createDataFrame([(f"in/{c}", c, day, n, "caller", t) for c, n, t in turns], schema)
        write_table(frame.coalesce(1), place("turns"), "append")
        stream = refresh.table_stream(spark, place("turns"), frame.schema)
        finish(chain.refresh_calls(stream, terms, drugs, place("out"), job, lag=None, checkpoint=place("chk")))

    arrive(("c1", 0, "I took zolina"), ("c2", 0, "rash"))
    arrive(("c1", 1, "then a rash"), ("c3", 0, "hello"))
    whole = spark.createDataFrame([(f"in/{c}", c, day, n, "caller", t) for c, n, t in said], schema)
    want = {
        "transcriptions": calls.assemble_transcripts(whole),
        "intelligence": (analyses := calls.call_intelligence(whole)),
        "ae_extractions": (records := calls.extract_adverse_events(whole, terms, drugs)),
        "fact_ae_calls": silver.fact_ae_calls(records),
        "fact_agent_compliance": silver.fact_agent_compliance(analyses),
    }
    for table, expected in want.items():
        got = chain.current_calls(spark, place("out"), table)
        same = [c for c in expected.columns if not c.endswith(("_at", "_date"))]
        assert rows(got, *same) == rows(expected, *same)


def test_call_chain_equals_batch(spark, place, rows, job):
    terms = spark.createDataFrame(
        [("rash", "Rash", "Skin")], "phrase string, preferred_term string, soc_class string"
    )
    drugs = spark.createDataFrame([("zolina", "Zolina")], "phrase string, drug_name string")
    schema = (
        "file_path string, file_name string, received_at timestamp_ntz, turn bigint, "
        "speaker_label string, text string"
    )
    day = dt.datetime(2024, 1, 1)
    for call, text in (("c1", "zolina gave me a rash"), ("c2", "hello"), ("c3", "rash")):
        turn = spark.createDataFrame(
            [(f"in/{call}", call, day, 0, "caller", text), (f"in/{call}", call, day, 1, "agent", "bye")],
            schema,
        )
        write_table(turn.coalesce(1), place("turns"), "append")
        stream = refresh.table_stream(spark, place("turns"), turn.schema, max_files=1)
        finish(
            chain.refresh_calls(
                stream, terms, drugs, place("out"), job, lag=None, checkpoint=place("chk")
            )
        )
    got = rows(
        chain.current_calls(spark, place("out"), "fact_ae_calls"), "source_call_id", "drug_name", "data_source"
    )
    assert got == [("c1", "Zolina", "CALL_CENTER"), ("c3", None, "CALL_CENTER")]
    assert read_table(spark, place("out/transcriptions")).count() == 3
    assert read_table(spark, place("out/fact_agent_compliance")).count() == 3


class TestState:
    """What keyed state gives: no history is read, retries count once, closed keys stay as they are."""

    SCHEMA = "file_path string, file_name string, received_at timestamp_ntz, turn bigint, speaker_label string, text string"
    DAY = dt.datetime(2024, 1, 1)

    def start(self, spark, place, job, turns, **how):
        rows = [(f"in/{c}", c, self.DAY, n, "caller", t) for c, n, t in turns]
        frame = spark.createDataFrame(rows, self.SCHEMA)
        write_table(frame.coalesce(1), place("turns"), "append")
        terms = spark.createDataFrame([("rash", "Rash", "Skin")], "phrase string, preferred_term string, soc_class string")
        drugs = spark.createDataFrame([("zolina", "Zolina")], "phrase string, drug_name string")
        stream = refresh.table_stream(spark, place("turns"), frame.schema)
        finish(chain.refresh_calls(stream, terms, drugs, place("out"), job, lag=None, checkpoint=place("chk"), **how))
        found = chain.current_calls(spark, place("out"), "transcriptions")
        return {r.file_name: r.transcription_result.text for r in found.collect()}

    def test_a_retried_batch_counts_once_and_reads_no_history(self, spark, place, job):
        self.start(spark, place, job, [("c1", 0, "one"), ("c2", 0, "x"), (None, 0, "no recording")])
        want = {"c1": "caller: one\ncaller: two", "c2": "caller: x"}
        assert self.start(spark, place, job, [("c1", 1, "two")]) == want
        # No table of turns is kept: the second batch had the first turn from its state.
        assert not (Path(place("out")) / "turns").exists()
        touched = read_table(spark, place("out/transcriptions")).filter("batch_id = 1")
        assert [r.file_name for r in touched.collect()] == ["c1"]
        commits = Path(checkpoint_root(spark, place("chk"))) / job / "commits"
        for name in ("1", ".1.crc"):
            (commits / name).unlink()
        assert self.start(spark, place, job, [("c3", 0, "new")]) == {**want, "c3": "caller: new"}


def test_rows_of_a_closed_key_come_alone(spark, place, job):
    schema = "k string, n bigint"

    def run(*rows):
        write_table(spark.createDataFrame(list(rows), schema).coalesce(1), place("in"), "append")
        stream = refresh.table_stream(spark, place("in"), spark.createDataFrame([], schema).schema)
        got = []
        keep = lambda batch, _: got.extend(tuple(r) for r in batch.collect())
        writer = state.touched_rows(stream, "k", keep_ms=1).writeStream.foreachBatch(keep)
        with state.state_settings(spark, timers=True):
            query = refresh.start_stream(writer, spark, job, None, place("chk"))
        assert query.awaitTermination(60)
        assert query.exception() is None
        return sorted(got)

    assert run(("a", 1), ("a", 2), (None, 9)) == [("a", 1, False), ("a", 2, False)]
    # Timers that are due fire in a batch after its rows were handled, or in the next one.
    assert run(("b", 3)) == [("b", 3, False)]
    run(("c", 4))
    assert run(("a", 5)) == [("a", 5, True)]


def test_search_index_follows_the_corpus(spark, place, rows, job):
    fact_schema = "case_id string, drug_name string, ae_soc_class string, ae_term string, report_date date"
    text_schema = "case_id string, narrative_text string"
    asked = spark.createDataFrame([(1, "rash pain"), (2, "fever")], "query_id int, query string")
    day = dt.date(2024, 1, 1)

    def run(narratives=(), facts=()):
        for data, schema, table in ((narratives, text_schema, "narr"), (facts, fact_schema, "fact")):
            write_table(spark.createDataFrame(list(data), schema), place(table), "append")
        streams = [
            refresh.table_stream(spark, place(table), spark.createDataFrame([], schema).schema)
            for table, schema in (("narr", text_schema), ("fact", fact_schema))
        ]
        finish(chain.refresh_search_corpus(*streams, place("out"), job, None, place("chk"), compact_every=2))
        want = search.search_batch(chain.current_corpus(spark, place("out")), asked, 9, cols=["drug_name"])
        found = rows(chain.search_current(spark, place("out"), asked, 9, cols=["drug_name"]))
        assert found == rows(want)
        return found

    run([("c1", "rash and fever"), ("c2", "pain")], [("c1", "d", "s", "t", day)])
    hits = run([("c3", "rash")], [("c2", "late", "s", "t", day), ("c2", "other", "s", "t", day)])
    assert {(h[1], h[2]) for h in hits} >= {("c2", "late"), ("c2", "other"), ("c1", "d"), ("c3", None)}
    hits = run(facts=[("c1", "more", "s", "t", day)])
    assert {h[2] for h in hits if h[1] == "c1"} == {"d", "more"}


def test_late_calls_correct_their_hour(spark, place, rows, job):
    start = dt.datetime(2024, 1, 1)

    def call(minute, status="ok", latency=10):
        return (start + dt.timedelta(minutes=minute), "f", "m", latency, 5, status)

    def run(*calls):
        write_table(spark.createDataFrame(list(calls), EVENTS).coalesce(1), place("log"), "append")
        stream = refresh.table_stream(spark, place("log"), spark.read.parquet(place("log")).schema)
        finish(refresh.refresh_health(stream, place("out"), job, None, place("chk")))
        got = refresh.current_health(spark, place("out"))
        want = health.function_health(spark.read.parquet(place("log")))
        assert rows(got.drop("late_calls")) == rows(want)
        return [r.late_calls for r in got.collect()]

    assert run(call(5), call(70, "error"), call(130, latency=None)) == [0, 0, 0]
    # The last hour goes on; the first one gets two calls after it was over.
    assert run(call(140), call(7, "error", 31), call(8)) == [0, 0, 2]
    commits = Path(checkpoint_root(spark, place("chk"))) / job / "commits"
    for name in ("1", ".1.crc"):
        (commits / name).unlink()
    assert run(call(400)) == [0, 0, 0, 2]
