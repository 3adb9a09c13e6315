"""Every registered health-record query against its SQL in DuckDB."""

import itertools
import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paceledger.operators import games
from paceledger.plans import jobs, round_trips
from paceledger.plans.registry import QUERIES, SQL

TABLES = ("customer", "events", "orders")


def normal(df: pd.DataFrame) -> list[str]:
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "NULL"
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return repr(round(float(x), 6))
        return str(x)

    return sorted("|".join(map(cell, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def oracle(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, tiny, oracle, name):
    got = QUERIES[name](spark, tiny).toPandas()
    want = oracle.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_gameplays_are_read_once(spark, tiny):
    """the log and each gameplay in it are parsed once a row, not again in each filter and series."""
    plan = QUERIES["engagement_sessions"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2


def test_gameplays_without_text_or_turns(spark):
    play = lambda *texts: {"Values": list(texts)}
    turn = '{"Turns": [{"Score": 3, "IsHospitalised": true, "GlucoseValueStart": 1, "GlucoseValueEnd": 2, "MinutesStart": 0, "MinutesEnd": 7}], "Aborted": %s}'
    logs = [json.dumps({"GameplayData": [None, play(), play(None), play("bad"), play(turn % "true"), play('{"Turns": []}'), play(turn % "null", "more"), {}, play(turn % "false")]}), "bad", None, '{"GameplayData": null}']
    kind = "user_id bigint, id bigint, propertyInstances array<struct<property:struct<translationKey:string,baseUnit:string>,value:string>>"
    rows = spark.createDataFrame([(1, n, [(("ENGAGEMENT_DATA", None), log)]) for n, log in enumerate(logs)], kind)
    got = [tuple(r) for r in games.engagement_sessions(rows).orderBy("play").collect()]
    assert got == [(1, 0, k, [3.0], 1, [1.0, 2.0], [0.0, 7.0]) for k in (6, 8)]


def test_assessment_reads_each_log_once(spark, tmp_path):
    """one parse of the playthrough, one of the engagement log and one of its gameplays."""
    kind = "user_id bigint, id bigint, propertyInstances array<struct<property:struct<translationKey:string,baseUnit:string>,value:string>>"
    spark.createDataFrame([], kind).write.parquet(str(tmp_path / "raw"))
    rows = spark.read.schema(kind).parquet(str(tmp_path / "raw"))
    plan = jobs.literacy_assessment(rows, rows, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 3


def test_assessment_seeks_each_colour_once(spark, tmp_path):
    """the first red and the first green value are sought once a session, not again for each later value."""
    kind = "user_id bigint, id bigint, propertyInstances array<struct<property:struct<translationKey:string,baseUnit:string>,value:string>>"
    spark.createDataFrame([], kind).write.parquet(str(tmp_path / "raw"))
    rows = spark.read.schema(kind).parquet(str(tmp_path / "raw"))
    plan = jobs.literacy_assessment(rows, rows, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position(") == 2


def test_assessment_deals_rows_before_texts(spark, tiny, monkeypatch):
    """texts are written and parsed in as many tasks as the session's shuffles have, whatever row groups the file has."""
    plans, append = [], round_trips.writers.append_assessments
    monkeypatch.setattr(round_trips.writers, "append_assessments", lambda scores, *rest: (plans.append(scores._jdf.queryExecution().optimizedPlan().toString()), append(scores, *rest)))
    QUERIES["literacy_assessment"](spark, tiny)
    assert plans[0].count("RepartitionByExpression [id#") == 2


def test_turn_series_and_response_by_hand(spark):
    values, turns = (None, 0.0, 1.0, 5.0), []
    for n in range(4):
        turns += itertools.product(itertools.product(values, values), repeat=n) if n < 3 else [((1.0, e), (1.0, f), (1.0, g)) for e in values for f in values for g in values]
    turns += [None, ((1.0, 2.0), None, (1.0, 5.0))]

    def series(t):
        if not t:
            return None
        out = [t[0][0], *[x[1] if x else None for x in t]]
        out = out[:1] + out[2:] if not t[0][1] else out
        return out[:-1] if out[-1] == 0 else out

    def response(s):
        red = next((i for i, x in enumerate(s or []) if x is not None and (0 <= x <= 2.6 or 15 <= x <= 20)), None)
        green = next((i for i, x in enumerate(s or []) if red is not None and i > red and x is not None and 4.5 <= x <= 8), None)
        return None if green is None or s[green] - s[red] == 0 else float(green**2 - red**2)

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(turns)], "i int, t array<struct<s:double,e:double>>").withColumn("g", games.turn_series(F.col("t"), "s", "e"))
    minutes = F.transform("g", lambda g, i: (i * i).cast("double"))
    got = rows.select("i", "g", games.critical_response(F.col("g"), minutes).alias("r")).orderBy("i").collect()
    assert [(r.g, r.r) for r in got] == [(series(t), response(series(t))) for t in turns]
