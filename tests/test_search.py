from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import alerts as al
from sparkwarden.operators import search
from sparkwarden.operators.search import TextQuery
from sparkwarden.sources import tables

START = datetime(2026, 4, 9, 12)


@pytest.fixture(scope="module")
def events(make_events):
    severities = ["info", "low", "medium", "high", "critical"]
    return make_events(
        [
            {
                "timestamp": START + timedelta(minutes=i // 2),
                "severity": severities[i % 5],
                "source": ["auth", "dns"][i % 2],
                "source_ip": f"10.0.0.{i % 3}",
                "raw_message": f"Connexion réussie for user{i % 4} from 10.0.0.{i % 3}",
                "anomaly_score": (i % 4) / 4,
            }
            for i in range(40)
        ]
    )


def ids(df):
    return [r.event_id for r in df.collect()]


def test_filters_combine(events):
    page, total = search.search_events(events, severity="high", source="dns", limit=2)
    assert total.first().total == 4
    assert ids(page) == [33, 23]


def test_empty_filter_is_no_filter(events):
    _, total = search.search_events(events, severity="", source_ip=None, start="")
    assert total.first().total == 40


def test_bounds_are_inclusive(events):
    found = search.event_filter(
        events, start="2026-04-09T12:01:00", end=START + timedelta(minutes=2)
    )
    assert sorted(ids(found)) == [2, 3, 4, 5]


def test_bound_with_offset_is_read_as_utc(events):
    found = search.event_filter(events, start="2026-04-09T14:19:00+02:00")
    assert sorted(ids(found)) == [38, 39]


@pytest.mark.parametrize(
    "bad",
    [
        {"severity": "extreme"},
        {"source": "web"},
        {"start": "yesterday"},
        {"event_type": "x" * 101},
        {"source_ip": "1" * 46},
        {"sort": "id"},
        {"order": "up"},
        {"limit": 0},
        {"limit": 501},
        {"offset": -1},
        {"query": TextQuery(phrase="x" * 201)},
    ],
)
def test_bad_arguments(events, bad):
    with pytest.raises(ValueError):
        search.search_events(events, **bad)


def test_sort_orders(events):
    assert ids(search.page_events(events, "timestamp", "asc", 3)) == [0, 1, 2]
    lexical = search.page_events(events, "severity", "asc", 1).first().severity
    ranked = search.page_events(events, "severity", "asc", 1, severity_order="rank").first()
    assert (lexical, ranked.severity) == ("critical", "info")


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_by_offset_and_by_key_agree(events, order):
    seen, after = [], None
    for n in range(0, 40, 7):
        by_offset = search.page_events(events, "timestamp", order, 7, n).collect()
        by_key = search.page_events(events, "timestamp", order, 7, after=after).collect()
        assert by_offset == by_key
        seen += [r.event_id for r in by_key]
        after = (by_key[-1].timestamp, by_key[-1].event_id)
    assert sorted(seen) == list(range(40))


def test_lookup(events):
    assert ids(search.get_event(events, "7")) == [7]
    for missing in (99999, "9" * 20):
        with pytest.raises(LookupError):
            search.get_event(events, missing)
    for bad in ("abc", "1" * 21, "-1"):
        with pytest.raises(ValueError):
            search.get_event(events, bad)


def test_anomalies_highest_first(events):
    page, total = search.list_anomalies(events, 0.5, limit=3)
    assert total.first().total == 20
    assert [(r.anomaly_score, r.event_id) for r in page.collect()] == [
        (0.75, 3), (0.75, 7), (0.75, 11),
    ]


TEXT_QUERIES = [
    TextQuery(all_of=["REUSSIE", "user1"]),
    TextQuery(all_of=["user"]),
    TextQuery(any_of=["user2", "10.0.0.1"]),
    TextQuery(none_of=["user0"], all_of=["connexion"]),
    TextQuery(phrase="user3 from 10.0.0.2"),
    TextQuery(prefix="réus"),
    TextQuery(all_of=["10.0.0.0"], prefix="us"),
]
TEXT_ANSWERS = [
    lambda i: i % 4 == 1,
    lambda i: False,
    lambda i: i % 4 == 2 or i % 3 == 1,
    lambda i: i % 4 != 0,
    lambda i: i % 4 == 3 and i % 3 == 2,
    lambda i: True,
    lambda i: i % 3 == 0,
]


@pytest.mark.parametrize("n", range(len(TEXT_QUERIES)))
def test_text_search(events, n):
    want = [i for i in range(40) if TEXT_ANSWERS[n](i)]
    assert sorted(ids(search.text_search(events, TEXT_QUERIES[n]))) == want


def test_word_index_gives_the_same_answers(spark, events, tmp_path):
    path = str(tmp_path / "index")
    search.write_word_index(events, path)
    for query, answer in zip(TEXT_QUERIES, TEXT_ANSWERS, strict=True):
        found = search.index_search(spark, path, events, query)
        assert sorted(ids(found)) == [i for i in range(40) if answer(i)]


def test_time_bounds_prune_days(spark, events, tmp_path):
    tables.write_events(events, str(tmp_path / "t"))
    stored = tables.read_events(spark, str(tmp_path / "t"))
    found = search.event_filter(stored, start="2026-04-09T12:05:00", severity="high")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "PushedFilters: [IsNotNull(severity)" in plan
    assert found.count() == 6


def alert_rows(spark):
    rows = [
        (i, ["t"], "high" if i % 2 else "medium", None if i == 0 else "x" * i, 0, START)
        for i in range(5)
    ] + [(200, ["t"], "high", "", 0, START + timedelta(hours=1))]
    return spark.createDataFrame(
        rows,
        "alert_id bigint, event_cluster array<string>, severity string, narrative string, "
        "acknowledged int, created_at timestamp",
    )


def test_alert_list_and_acknowledgement(spark):
    acks = spark.createDataFrame([(1,), (1,), (77,)], "alert_id bigint")
    state, unknown = al.acknowledge(alert_rows(spark), acks)
    assert [r.alert_id for r in unknown.collect()] == [77]
    again, _ = al.acknowledge(state, acks)
    assert sorted(again.collect()) == sorted(state.collect())
    page, total = al.list_alerts(state, acknowledged=False, severity="high")
    assert ([r.alert_id for r in page.collect()], total.first().total) == ([200, 3], 2)


def test_narrative_and_preview(spark):
    told = {r.alert_id: r.narrative for r in al.alert_narrative(alert_rows(spark)).collect()}
    assert told[0] == told[200] == "No narrative available."
    shown = {r.alert_id: r.preview for r in al.alert_preview(alert_rows(spark), 3).collect()}
    assert (shown[0], shown[200], shown[3], shown[4]) == ("No narrative", "", "xxx", "xxx...")
    with pytest.raises(ValueError):
        al.alert_narrative(alert_rows(spark), "x1")
    with pytest.raises(LookupError):
        al.alert_narrative(alert_rows(spark), 999)


def test_alerts_and_anomalies_by_key(spark, events):
    first, _ = search.list_anomalies(events, 0.0, limit=1000)
    rows = first.collect()
    assert len(rows) == 40
    rest, _ = search.list_anomalies(events, 0.0, limit=1000, after=(rows[9].anomaly_score, rows[9].event_id))
    assert rest.collect() == rows[10:]
    page, _ = al.list_alerts(alert_rows(spark), limit=1000)
    listed = page.collect()
    after, _ = al.list_alerts(alert_rows(spark), limit=1000, after=(listed[0].created_at, listed[0].alert_id))
    assert after.collect() == listed[1:]


def test_terms_without_words_are_ignored(make_events):
    events = make_events([{"raw_message": "alpha beta"}, {"raw_message": "gamma"}])
    found = lambda **q: ids(search.text_search(events, search.TextQuery(**q)))
    assert found(none_of=["--"]) == found(all_of=["--"]) == found(any_of=["--"]) == [0, 1]
    assert found(any_of=["alpha", "--"]) == [0]


def test_index_reads_texts_of_hits_only(spark, make_events, tmp_path):
    events = make_events([{"raw_message": f"word{i % 7} common text number{i}"} for i in range(100)])
    path, index = str(tmp_path / "events"), str(tmp_path / "index")
    events.write.parquet(path)
    search.write_word_index(events, index)
    stored = spark.read.parquet(path)
    for query in (
        search.TextQuery(all_of=["common", "word3"]),
        search.TextQuery(phrase="common text", none_of=["word1"]),
        search.TextQuery(any_of=["number5", "--", "number17"], prefix="comm"),
    ):
        got = search.index_search(spark, index, stored, query)
        assert sorted(ids(got)) == sorted(ids(search.text_search(stored, query)))
    plan = search.index_search(spark, index, stored, search.TextQuery(all_of=["word3"]))._jdf.queryExecution().optimizedPlan().toString()
    # The text's test is above the join: it stands before it in the plan.
    assert plan.index("exists") < plan.index("Join LeftSemi")


def test_index_is_searched_through_pushed_filters(spark, events, tmp_path):
    path = str(tmp_path / "index")
    search.write_word_index(events, path)
    found = search.index_search(spark, path, events, TextQuery(all_of=["user1"]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(word,user1)" in plan and "LeftSemi" in plan
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert found.select(F.count("*")).first()[0] == 10
