import datetime as dt
import json
import os
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceledger import schemas
from paceledger.functions import redact as R
from paceledger.operators import audit, connectors, games, policy
from paceledger.plans import jobs
from paceledger.sources import readers, writers
from paceledger.streaming import streams

POLICY = {
    "defaults": {"analytics": {"allow": True, "redact": ["records.kcal"]}},
    "clients": {"COACH": {"analytics": {"allow": False}}},
    "tools": {"fetch": {"analytics": {"allow": True, "redact": []}, "modeling": {"allow": False}}},
}


def rules(spark, tmp_path):
    path = tmp_path / "policy.json"
    path.write_text(json.dumps(POLICY, indent=1))
    return readers.scan_policy(spark, str(path))


def test_tool_layer_overrides_client_layer(spark, tmp_path):
    req = spark.createDataFrame([("COACH", "analytics", "fetch"), ("COACH", "analytics", "other"), ("X", "analytics", "other"), ("X", "modeling", "fetch"), ("X", "coaching", "x")], "client string, purpose string, tool string")
    got = {tuple(r)[:3]: (r.allow, r.redact) for r in policy.resolve_policy(req, rules(spark, tmp_path)).select("client", "purpose", "tool", "allow", "redact").collect()}
    assert got[("COACH", "analytics", "fetch")] == (True, [])
    assert got[("COACH", "analytics", "other")] == (False, ["records.kcal"])
    assert got[("X", "analytics", "other")] == (True, ["records.kcal"])
    assert got[("X", "modeling", "fetch")] == (False, [])
    assert got[("X", "coaching", "x")] == (True, [])


def test_purposes_meet_in_any_case_and_with_blanks(spark, tmp_path):
    """A denied purpose stays denied however it is written, and keeps its redact list; the request's text stays."""
    written = ["modeling", "MODELING", " Modeling ", "\tmodeling\n"]
    req = spark.createDataFrame([("X", p, "fetch") for p in written] + [("X", " ANALYTICS", "other"), ("X", None, "fetch"), ("X", "nothing", "fetch")], "client string, purpose string, tool string")
    got = {r.purpose: r for r in policy.deny(policy.resolve_policy(req, rules(spark, tmp_path))).collect()}
    assert all(not got[p].allow and got[p].error.code == "denied_by_policy" for p in written)
    assert got[" ANALYTICS"].redact == ["records.kcal"] and got[" ANALYTICS"].error is None
    assert got[None].error.code == got["nothing"].error.code == "bad_request"
    # rules may be written in any case too; of two that then agree the denial holds
    twice = spark.createDataFrame([("default", None, "Modeling", True, ["a"]), ("default", None, "modeling ", False, None), ("tool", "t", " ANALYTICS", None, ["x", "y"])], "layer string, key string, purpose string, allow boolean, redact array<string>")
    one = {r.purpose: (r.allow, r.redact) for r in policy.resolve_policy(spark.createDataFrame([("c", "modeling", "t"), ("c", "analytics", "t")], "client string, purpose string, tool string"), twice).collect()}
    assert one == {"modeling": (False, []), "analytics": (True, ["x", "y"])}
    payloads = req.withColumn("records", F.array(F.struct(F.lit(5).alias("kcal"))))
    masked = {r.purpose: (r.error and r.error.code, r.records[0].kcal) for r in policy.enforce_policy(payloads, rules(spark, tmp_path), ["records.kcal"]).collect()}
    assert masked[" ANALYTICS"] == (None, R.TOKEN) and all(masked[p][0] == "denied_by_policy" for p in written)


def test_rules_valid_in_time(spark):
    at = lambda s: s and dt.datetime.fromisoformat(s)
    kind = "layer string, key string, purpose string, allow boolean, redact array<string>, valid_from timestamp, valid_to timestamp"
    rows = [("default", None, "analytics", True, ["a"], None, at("2024-01-10")), ("default", None, "analytics", False, None, at("2024-01-10"), None), ("tool", "t", "ANALYTICS", True, ["b"], at("2024-01-20"), at("2024-01-25")), ("tool", "t", "analytics", False, None, at("2024-01-22"), at("2024-01-23"))]
    req = spark.createDataFrame([(i, "c", "Analytics", "t", at(s)) for i, s in enumerate(("2024-01-01", "2024-01-10", "2024-01-20", "2024-01-22 12:00:00", "2024-01-23", "2024-01-25", None))], "id int, client string, purpose string, tool string, ts timestamp")
    got = {r.id: (r.allow, r.redact) for r in policy.explain_policy_at(req, spark.createDataFrame(rows, kind)).collect()}
    assert got == {0: (True, ["a"]), 1: (False, []), 2: (True, ["b"]), 3: (False, []), 4: (True, ["b"]), 5: (False, []), 6: (True, [])}


def test_missing_policy(spark, tmp_path):
    assert readers.scan_policy(spark, str(tmp_path / "none.json"), on_missing="allow").count() == 0


def test_redaction(spark):
    df = spark.sql("SELECT array(named_struct('token', 'Bearer x', 'email', 'e', 'keep', 1)) AS records, named_struct('a', 'x', 'b', named_struct('c', 'y')) AS d")
    paths = ["records.token", "records.email", "", None, "records.none", "d.b.c"]
    got = R.redact_paths(df, paths).withColumn("n", R.redaction_count(df, paths)).first()
    assert (got.records[0].token, got.records[0].email, got.records[0].keep, got.d.b.c, got.n) == (R.TOKEN, R.TOKEN, 1, R.TOKEN, 3)
    assert R.redact_secrets(df).first().records[0].token == f"Bearer {R.TOKEN}"
    text = '{"token": "a\\"b", "x": {"API_KEY": 5, "keep": "token"}}'
    masked = spark.createDataFrame([(text,)], "t string").select(R.redact_json_keys(F.col("t")).alias("t")).first().t
    assert json.loads(masked) == {"token": R.TOKEN, "x": {"API_KEY": R.TOKEN, "keep": "token"}}
    cases = {
        '{"token": ["abc"], "api_key": {"v": "secret"}, "token ": "x"}': {"token": R.TOKEN, "api_key": R.TOKEN, "token ": R.TOKEN},
        '[{"a": [[{"\\u0074oken": null, "b": "]}"}]]}]': [{"a": [[{"token": R.TOKEN, "b": "]}"}]]}],
        '{"Authorization": " BEARER q", "n": 1.50}': {"Authorization": f"Bearer {R.TOKEN}", "n": 1.5},
        "{}": {}, "5": 5, '"token"': "token",
    }
    rows = spark.createDataFrame([(t,) for t in [*cases, '{"token": "cut', "", "[" * 50_000, None]], "t string")
    found = {r.t: r.m for r in rows.select("t", R.redact_json_keys(F.col("t")).alias("m")).collect()}
    assert {t: json.loads(found[t]) for t in cases} == cases
    assert [found['{"token": "cut'], found[""], found["[" * 50_000], found[None]] == [R.TOKEN] * 3 + [None]


def test_subject_hash(spark):
    got = spark.range(1).select(R.subject_hash(F.lit(1), "demo-salt").alias("h"), R.subject_hash(F.lit(R.TOKEN), "s").alias("m"), R.subject_hash(F.lit(1), " ").alias("n")).first()
    assert tuple(got) == ("0b58c157f99a7995", None, None)


def events(spark, tmp_path):
    log = tmp_path / "gateway"
    log.mkdir(exist_ok=True)
    one = lambda i, client, uid: {"ts": f"2025-01-01T00:00:0{i}Z", "kind": "tool", "name": "health.walk.fetch.v1", "client_id": client, "corr_id": f"c{i}", "args": {"user_id": uid, "purpose": "modeling", "error": {"code": "denied_by_policy"}, "args": {"email": "e", "token": "t"}}, "ok": False, "ms": 3}
    lines = [json.dumps(one(1, "COACH", "1")), "not json", json.dumps(one(2, "OTHER", "2"))]
    (log / "a.jsonl").write_text("\n".join(lines))
    return str(tmp_path)


def test_audit_log(spark, tmp_path):
    path = events(spark, tmp_path)
    raw = readers.scan_audit_layers(spark, path)
    assert {r.layer for r in raw.collect()} == {"gateway"}
    flat = audit.flatten_audit(readers.scan_audit(spark, f"{path}/gateway"))
    assert [r.corr_id for r in audit.filter_audit(flat, client_id="COACH", purpose="modeling", ok=False, error_code="denied_by_policy").collect()] == ["c1"]
    out = str(tmp_path / "sealed")
    writers.append_audit(readers.scan_audit(spark, f"{path}/gateway"), out, "demo-salt")
    sealed = {r.corr_id: r for r in readers.scan_audit(spark, out).collect()}
    assert sealed["c1"].subject_hash == "0b58c157f99a7995" and sealed["c1"].args.user_id == R.TOKEN and sealed["c1"].args.args.token == R.TOKEN
    alerts, evidence = jobs.guardian(flat, client_id="COACH", purpose="modeling", as_of="2025-01-01 00:10:00", min_denies=1)
    assert alerts.first().n == 1 and evidence.first().corr_id == "c1"
    assert jobs.guardian(flat, client_id="COACH", purpose="modeling", as_of="2025-01-02 00:10:00", min_denies=1)[0].count() == 0


def test_stream_equals_batch(spark, tmp_path):
    path = events(spark, tmp_path)
    stream = streams.stream_audit(spark, f"{path}/gateway")
    got = streams.run_to_end(streams.stream_access_counts(stream), "complete").collect()
    assert sorted((r.client_id, r.calls) for r in got) == [("COACH", 1), ("OTHER", 1)]


def test_complete_results_are_files(spark, tmp_path):
    """Complete mode leaves its table in the shared folder, not in the driver; a source without rows gives none."""
    path = events(spark, tmp_path)
    stream = streams.stream_audit(spark, f"{path}/gateway")
    got = streams.run_to_end(streams.stream_access_counts(stream), "complete")
    assert got.inputFiles() and got.count() == 2
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("paceledger_")]
    (tmp_path / "none").mkdir()
    empty = streams.run_to_end(streams.stream_access_counts(streams.stream_audit(spark, str(tmp_path / "none"))), "complete")
    assert empty.columns == streams.stream_access_counts(stream).columns and empty.count() == 0


def test_late_rows_are_dropped(spark, tmp_path):
    """A window closes once the watermark has passed it, which acts a batch later; a row that comes after that is not counted."""
    log = tmp_path / "log"
    log.mkdir()
    one = lambda hour, minute: json.dumps({"ts": f"2025-01-01T{hour:02d}:{minute:02d}:00Z", "name": "n", "client_id": "c", "ok": True})
    for i, times in enumerate(([(8, 0), (8, 30)], [(12, 0)], [(12, 1)], [(8, 45), (12, 5)], [(16, 0)], [(16, 1)])):
        path = log / f"{i}.json"
        path.write_text("\n".join(one(*t) for t in times))
        os.utime(path, (1_700_000_000 + i * 60,) * 2)
    out = streams.run_to_end(streams.stream_access_counts(streams.stream_audit(spark, str(log), 1)), "append")
    assert sorted((r.window_start // 3_600_000_000 % 24, r.calls) for r in out.collect()) == [(8, 2), (12, 3)]


def test_keys_inside_maps(spark):
    """Maps of structs, of numbers and nested ones hide no named key, and a path goes through them."""
    df = spark.sql(
        "SELECT map('s', named_struct('token', 'abc', 'n', 1)) AS m, map('user_id', 7L, 'n', 8L) AS c, map('Email', array('x'), 'list', array('y')) AS a,"
        " map('x', map(' API_KEY ', 'k', 'n', 'v')) AS mm, array(map('player_id', 1)) AS am"
    )
    s = R.redact_secrets(df).first()
    assert s.m["s"].token == R.TOKEN and s.m["s"].n == 1 and s.mm["x"] == {" API_KEY ": R.TOKEN, "n": "v"}
    p = R.redact_pii(df).first()
    assert p.c == {"user_id": R.TOKEN, "n": "8"} and p.a == {"Email": None, "list": ["y"]} and p.am == [{"player_id": R.TOKEN}]
    paths = ["m.s.token", "m.none.token", "mm.x.n", "c.user_id", "c.none"]
    got = R.redact_paths(df, paths).withColumn("k", R.redaction_count(df, paths)).first()
    assert (got.m["s"].token, got.m["s"].n, got.mm["x"], got.c, got.k) == (R.TOKEN, 1, {" API_KEY ": "k", "n": R.TOKEN}, {"user_id": R.TOKEN, "n": "8"}, 3)


def test_subject_is_found_depth_first(spark):
    df = spark.sql("SELECT named_struct('a', array(named_struct('user_id', CAST(NULL AS STRING)), named_struct('user_id', 'deep')), 'm', map('user_id', 'in map')) AS args")
    assert df.select(audit.find_user(df)).first()[0] == "deep"
    own = spark.sql("SELECT named_struct('a', named_struct('user_id', 'deep'), 'user_id', 5) AS args")
    assert own.select(audit.find_user(own)).first()[0] == "5"
    loose = spark.sql("SELECT named_struct('a', 1, ' User_ID', 6) AS args, named_struct('m', map('x', 'y', ' USER_ID ', '8')) AS deep")
    assert loose.select(audit.find_user(loose)).first()[0] == "6"
    within = loose.select(F.col("deep").alias("args"))
    assert within.select(audit.find_user(within)).first()[0] == "8"
    assert spark.sql("SELECT named_struct('a', 1) AS args").select(audit.find_user(spark.sql("SELECT named_struct('a', 1) AS args"))).first()[0] is None


def test_fetch_and_features_of_windows(spark, tmp_path):
    """Open windows take the last year, pages are cut by date, failures and wrong purposes give errors, features see the window only."""
    day = lambda s: __import__("datetime").date.fromisoformat(s)
    rows = [("r1", 1, "coaching", "auto", day("2025-01-02"), None, None, None), ("r2", 1, "coaching", "auto", None, None, 1, 1), ("r3", 1, "modeling", "auto", None, day("2025-01-02"), None, None), ("r4", 2, "modeling", "vault", None, None, None, None), ("r5", 1, "analytics", "auto", None, None, None, None), ("r6", 3, "modeling", "live", None, None, None, None)]
    req = spark.createDataFrame([(i, u, "X", p, "t", None, d, s, e, n, o) for i, u, p, d, s, e, n, o in rows], "request_id string, user_id bigint, client string, purpose string, tool string, prefer string, prefer_data string, start date, end date, limit int, offset int")
    cand = spark.createDataFrame([(r[0], s, ok, 1 if r[1] == 1 else 0, None) for r in rows for s, ok in (("vault", True), ("arena", r[1] == 1))], "request_id string, source string, ok boolean, n_records bigint, error_code string")
    rec = spark.createDataFrame([("vault", 1, day(d), n, 1.0, "p") for d, n in (("2023-12-31", 1), ("2025-01-01", 10), ("2025-01-02", 20), ("2025-01-03", None))], "source string, user_id bigint, date date, steps bigint, kcalories double, player_id string")
    none = readers.scan_policy(spark, str(tmp_path / "none.json"), on_missing="allow")
    got = {r.request_id: r for r in jobs.fetch_walk_batch(req, none, cand, rec, live=("arena", "stepcloud"), as_of="2025-01-05").collect()}
    assert [x.steps for x in got["r1"].records] == [20, None] and [x.steps for x in got["r2"].records] == [20]
    assert got["r3"].error.code == "not_supported" and got["r4"].error.code == "vault_empty" and got["r6"].error.code == "all_sources_failed"
    out = {r.request_id: r for r in jobs.walk_features_batch(req, none, cand, rec, live=("arena", "stepcloud"), as_of="2025-01-05").collect()}
    r = out["r3"]
    assert (r.error, r.days, r.total_steps, r.avg_steps, r.min_steps, r.max_steps, r.provenance) == (None, 2, 30, 15, 10, 20, {"source": "vault"})
    assert out["r5"].error.code == "bad_request" and out["r4"].error.code == "vault_empty" and out["r4"].days is None and out["r6"].error.code == "all_sources_failed"
    ever = {r.request_id: r for r in jobs.walk_features_batch(req, none, cand, rec, live=("arena", "stepcloud")).collect()}
    assert (ever["r3"].days, ever["r3"].min_steps) == (3, 1)


def test_events_without_correlation(spark):
    events = spark.createDataFrame([(2, "c1", "sources", "b", True), (1, "c1", "gateway", "a", True), (3, None, "gateway", "x", True), (4, None, "sources", "y", False)], "ts int, corr_id string, layer string, name string, ok boolean")
    got = audit.correlate_layers(events).collect()
    assert [(r.corr_id, r.n_events, r.layers, [s.name for s in r.steps]) for r in got] == [("c1", 2, ["gateway", "sources"], ["a", "b"])]


def test_payload_stats(spark):
    df = spark.sql("SELECT array(1, 2) AS records, array('a') AS attempts, map('s', named_struct('records', array(1, 2, 3))) AS streams, CAST(NULL AS struct<code:string>) AS error")
    got = audit.payload_stats(df).first()
    assert (got.n_records, got.n_attempts, got.stream_counts, got.n_stream_records, got.error_code) == (2, 1, {"s": 3}, 3, None)


def test_sources(spark):
    c = spark.createDataFrame([("r1", None, None, "arena", False, 0, "down"), ("r1", None, None, "stepcloud", True, 1, None), ("r1", None, None, "vault", True, 0, None), ("r2", None, "vault", "vault", True, 0, None), ("r3", None, "live", "arena", True, 0, None)], "request_id string, prefer string, prefer_data string, source string, ok boolean, n_records bigint, error_code string")
    got = {r.request_id: r for r in connectors.select_source(c, ("arena", "stepcloud")).collect()}
    assert (got["r1"].selected_source, [a.ok for a in got["r1"].attempts]) == ("stepcloud", [False, False, True])
    assert (got["r2"].selected_source, got["r2"].error_code) == (None, "vault_empty")
    assert got["r3"].selected_source == "arena"


def test_diabetes_connector_falls_back(spark):
    r = spark.createDataFrame([(1, "diabetes", "arena", "A", "d1", "td", 0), (2, "walk", "arena", "A", "w2", "tw", 0), (2, "diabetes", "other", "O", "o2", "to", 0), (3, "walk", "arena", "A", "w3", "tw3", 0)], "user_id bigint, domain string, source string, connected_application string, player_id string, token string, pos int")
    got = {x.user_id: (x.player_id, x.token) for x in connectors.resolve_diabetes_connector(r, "arena").collect()}
    assert got == {1: ("d1", "td"), 2: ("w2", "to"), 3: ("w3", "tw3")}


def test_scores_match_a_known_entry(spark):
    m = spark.sql("SELECT 0.06557377049180328D avg_hint, 0.7192982456140351D avg_correct, 0.2807017543859649D avg_incorrect, 68D avg_accuracy, 0D trips_per_game, 0D avg_response, 116.89189189189189D avg_score, 55.259315198802135D sd_score, 199.83783783783784D avg_playtime, 328.5996644386584D sd_playtime, 1.0714285714285714D avg_days, 0.25753937681885636D sd_days, 141 total_home_path, 101 total_outdoors_path, 66 total_work_path")
    got = games.player_types(games.literacy_scores(m)).first()
    for name, want in (("trivia_score", 0.7202815662), ("game_score", 0.85), ("final_score", 0.7721689397), ("socializer", 0.3677336881), ("competitive", 0.1149422863), ("explorer", 0.1827245679)):
        assert abs(got[name] - want) < 1e-9


def test_engagement(spark):
    turn = lambda s, a, b, m, n, h=False: {"Score": s, "IsHospitalised": h, "GlucoseValueStart": a, "GlucoseValueEnd": b, "MinutesStart": m, "MinutesEnd": n}
    play = {"Aborted": False, "Turns": [turn(5, 1.0, 0.0, 0, 10), turn(0, 1.0, 5.0, 10, 30, True), turn(7, 5.0, 0.0, 30, 0)]}
    log = json.dumps({"GameplayData": [{"Values": [json.dumps(play)]}, {"Values": [json.dumps(play | {"Aborted": True})]}]})
    raw = spark.createDataFrame([(1, 1, [(("ENGAGEMENT_DATA", None), log)])], "user_id bigint, id bigint, propertyInstances array<struct<property:struct<translationKey:string,baseUnit:string>,value:string>>")
    got = games.engagement_sessions(raw).collect()
    assert len(got) == 1
    s = got[0]
    assert (s.scores, s.hospital_turns, s.glucose, s.minutes) == ([5.0, 7.0], 1, [1.0, 5.0], [0.0, 10.0, 30.0])


def test_no_python_and_no_single_partition_window(spark, tiny):
    from paceledger.plans.queries import QUERIES

    for name in ("walk_features", "resolve_policy", "access_summary", "fetch_walk_batch", "literacy_scores"):
        plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
        assert not ("Window" in plan and "SinglePartition" in plan)


def folder_filters(df):
    """The conditions by which a scan leaves folders out before it opens a file."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = df._jdf.queryExecution().executedPlan().toString()
    found = re.search(r"PartitionFilters: \[(.*?)\](?:, |$)", text)
    assert found, text
    return found[1]


def batches(spark, folder, rows_of_batch, kind):
    """Land each batch as a file of its own, to be read one a micro-batch."""
    for rows in rows_of_batch:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_alert_comes_with_the_batch_that_reaches_the_threshold(spark, tmp_path):
    kind = "ts timestamp, client_id string, name string, error_code string"
    row = lambda minute: (dt.datetime(2025, 1, 1, 8, minute), "c", "n", "denied_by_policy")
    stream = streams.stream_denials(batches(spark, tmp_path / "in", [[row(1)], [row(2), row(3)], [row(4)]], kind), slide="1 hour")
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    streams.write_changes(stream, path, state).start().awaitTermination()
    changes = streams.read_changes(spark, path, stream.schema)
    assert sorted((r.batch, r.n) for r in changes.collect() if r.n) == [(1, 3), (2, 4)]
    # a batch that is repeated replaces its own rows
    again = changes.where("batch = 2").drop("batch").collect()
    spark.createDataFrame(again, stream.schema).write.mode("overwrite").parquet(f"{path}/batch=2")
    assert [r.n for r in streams.merged(streams.read_changes(spark, path, stream.schema), "window_start", "client_id", "name").collect()] == [4]
    streams.write_changes(stream, path, state).start().awaitTermination()
    assert streams.read_changes(spark, path, stream.schema).count() == 2


def test_late_rows_are_kept_apart(spark, tmp_path):
    kind = "id int, ts timestamp"
    at = lambda i, hour, minute=0: (i, dt.datetime(2025, 1, 1, hour, minute))
    parts = [[at(1, 8), at(2, 12)], [at(3, 11, 55), at(4, 11, 40), (5, None)], [at(6, 9), at(7, 12, 30)], [at(8, 12, 20), at(9, 12, 19)]]
    stream = batches(spark, tmp_path / "in", parts, kind)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    streams.route_late(stream, out, state).start().awaitTermination()
    on_time, late = streams.read_routed(spark, out, stream.schema)
    # the first batch has no watermark before it; then 11:50 for two batches, then 12:20
    assert sorted(r.id for r in on_time.collect()) == [1, 2, 3, 7, 8] and sorted(r.id for r in late.collect()) == [4, 5, 6, 9]
    assert sorted(tuple(r) for r in streams.late_counts(on_time, late).collect()) == [(0, 2, 0), (1, 1, 2), (2, 1, 1), (3, 1, 1)]
    streams.route_late(stream, out, state).start().awaitTermination()
    assert streams.read_routed(spark, out, stream.schema)[0].count() == 5


def test_newest_value_with_a_row_per_change(spark, tmp_path):
    """Rows that are older than what is known change nothing; a restart goes on from the checkpoint; a key ends a while after its last change."""
    kind = "k string, ts timestamp, v string"
    at = lambda k, minute, v: (k, minute if minute is None else dt.datetime(2025, 1, 1) + dt.timedelta(minutes=minute), v)
    stream = batches(spark, tmp_path / "in", [[at("a", 1, "x"), at("a", 3, "y"), at("b", 2, None)], [at("a", 2, "old"), at("b", 2, "z"), at(None, 1, "q"), at("c", None, "q")]], kind)
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    latest = streams.stream_latest(stream, "k", "ts", "v", ttl=3600, late="10 minutes")
    run = lambda: streams.write_changes(latest, path, state).start().awaitTermination(120)
    rows = lambda: sorted((r.batch, r.k, r.latest_v, r.changes, r.event) for r in streams.read_changes(spark, path, latest.schema).collect())
    assert run()
    first = [(0, "a", "y", 1, "changed"), (0, "b", None, 1, "changed"), (1, "b", "z", 2, "changed")]
    assert rows() == first
    batches(spark, tmp_path / "in", [[at("a", 50, "new")]], kind)
    assert run() and rows()[3:] == [(2, "a", "new", 2, "changed")]
    last = {r.k: r.latest_v for r in streams.merged(streams.read_changes(spark, path, latest.schema), "k").collect()}
    batch = spark.read.schema(kind).parquet(str(tmp_path / "in")).where("k IS NOT NULL AND ts IS NOT NULL")
    assert last == {r.k: r.v for r in batch.groupBy("k").agg(F.max_by("v", F.struct("ts", "v")).alias("v")).collect()}
    # the watermark passes b's last change by more than an hour, and b comes again and starts anew; the others end after it
    batches(spark, tmp_path / "in", [[at("d", 90, "d")], [at("e", 95, "e")], [at("b", 200, "back")]], kind)
    assert run()
    got = [r[1:] for r in rows()[4:]]
    ended = [("a", "new", 2, "expired"), ("b", "z", 2, "expired"), ("d", "d", 1, "expired"), ("e", "e", 1, "expired")]
    assert sorted(got) == sorted([*ended, ("b", "back", 1, "changed"), ("d", "d", 1, "changed"), ("e", "e", 1, "changed")])


def test_newest_of_many_keys_costs_one_frame_and_timer():
    """what Python and the timers cost is paid by a group of keys, not by each key."""
    held, timers = {}, set()

    class Held:
        getValue, removeKey = staticmethod(held.get), staticmethod(held.pop)  # noqa: N815
        updateValue, iterator = staticmethod(held.__setitem__), staticmethod(lambda: iter(list(held.items())))  # noqa: N815

    class Handle:
        getMapState = staticmethod(lambda *_: Held)  # noqa: N815
        listTimers, registerTimer, deleteTimer = staticmethod(lambda: iter(sorted(timers))), staticmethod(timers.add), staticmethod(timers.remove)  # noqa: N815

    class Clock:
        getCurrentWatermarkInMs = staticmethod(lambda: 150)  # noqa: N815

    newest = streams.Newest(T.StructType.fromDDL("k string, v bigint"), 100)
    newest.init(Handle)
    frame = lambda at: pd.DataFrame({"k": [f"k{i}" for i in range(500)] * 2, "event_us": [at + 1000 * i for i in range(500)] * 2, "v": [1] * 500 + [2] * 500})
    (first,) = newest.handleInputRows((0,), iter([frame(0), frame(-10)]), None)
    assert len(first) == 500 and set(first["latest_v"]) == {2} and set(first["changes"]) == {1} and timers == {100}
    assert list(newest.handleInputRows((0,), iter([frame(-5)]), None)) == [] and timers == {100}
    (ended,) = newest.handleExpiredTimer((0,), Clock, None)
    assert list(ended["k"]) == [f"k{i}" for i in range(51)] and set(ended["event"]) == {"expired"} and len(held) == 449 and timers == {100, 151}


def test_landed_parts_have_equally_many_files(spark, tmp_path, monkeypatch):
    """F1: tasks land in parallel, and each part still is one micro-batch."""
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    rows = spark.range(0, 100, 1, 4).select("id", F.lit(0).alias("ts"))
    path = str(tmp_path / "in")
    files = streams.land(rows, [F.col("id") < 10, (F.col("id") >= 10) & (F.col("id") % 2 == 0), F.col("id") == 99, (F.col("id") >= 10) & (F.col("id") % 2 == 1) & (F.col("id") < 99)], path)
    assert files == 4
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    got = streams.run_to_end(stream, "update").groupBy("batch").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    want = {0: list(range(10)), 1: list(range(10, 100, 2)), 2: [99], 3: list(range(11, 99, 2))}
    assert {r.batch: r.ids for r in got} == want


def test_two_layers_of_streams(spark, tmp_path):
    kind = "ts timestamp, corr_id string, name string"
    at = lambda c, hour, minute: (dt.datetime(2025, 1, 1, hour, minute), c, f"{c}{hour}")
    gateway = batches(spark, tmp_path / "g", [[at("both", 8, 0), at("lone", 8, 1), at("far", 8, 2), (dt.datetime(2025, 1, 1, 8), None, "none")], [at("end", 20, 0)]], kind)
    sources = batches(spark, tmp_path / "s", [[at("both", 8, 5), at("both", 8, 7), at("far", 9, 30), at("only", 8, 3)], [at("end", 20, 1)]], kind)
    out = streams.run_to_end(streams.stream_correlate(gateway, sources, within="30 MINUTES"), "append")
    got = [(r.corr_id, r.gateway and r.gateway.name, r.sources and r.sources.name) for r in out.collect() if r.corr_id != "end"]
    want = [("both", "both8", "both8")] * 2 + [("lone", "lone8", None), ("far", "far8", None), ("far", None, "far9"), ("only", None, "only8")]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_newest_events_read_the_newest_days_only(spark, tmp_path):
    path = str(tmp_path / "log")
    one = lambda day, i, client: (f"2025-01-{day:02d}T0{i}:00:00Z", "tool", "n", client, False)
    rows = [one(day, i, "a" if day % 2 else "b") for day in range(1, 21) for i in range(5)] + [(None, "tool", "n", "a", False)]
    raw = spark.createDataFrame(rows, "ts string, kind string, name string, client_id string, ok boolean")
    empty = spark.createDataFrame([], schemas.AUDIT)
    writers.append_audit(raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast(empty.schema[c].dataType).alias(c) for c in empty.columns]), path, "salt")
    assert readers.scan_audit(spark, path).count() == 101 and "day" not in readers.scan_audit(spark, path).columns
    whole = audit.query_events(audit.flatten_audit(readers.scan_audit(spark, path)), 12, client_id="a")
    got = readers.newest_events(spark, path, 12, client_id="a")
    assert [r.ts for r in got.collect()] == [r.ts for r in whole.collect()]
    assert readers.first_day_needed(spark, path, 12, client_id="a") == "2025-01-13" and readers.first_day_needed(spark, path, 5) == "2025-01-20"
    assert readers.newest_events(spark, path, 500).count() == 101
    window = readers.scan_log(spark, path, "2025-01-03", "2025-01-04")
    assert folder_filters(window).count("day") >= 2 and window.count() == 10


def test_fetch_gathers_only_what_is_asked(spark):
    rec = spark.range(1000).select(F.lit("arena").alias("source"), F.col("id").alias("user_id"), F.lit("2025-01-01").cast("date").alias("date"), F.col("id").alias("steps"), F.lit(1.0).alias("kcalories"), F.lit("p").alias("player_id"))
    chosen = spark.createDataFrame([(1, "arena", None), (2, "arena", "denied"), (3, "stepcloud", None), (4, None, None)], "user_id bigint, selected_source string, error string")
    got = jobs.gathered(rec, chosen)
    assert [(r._user, len(r._rows)) for r in got.collect()] == [(1, 1)]


def test_whole_fetch_chain(spark, tmp_path):
    """Store first, then the preferred live source, each with the reason it failed; one preferred row a day; what came live is stored."""
    day = dt.date.fromisoformat
    none = readers.scan_policy(spark, str(tmp_path / "none.json"), on_missing="allow")
    req = [("r1", 1, "auto", "arena"), ("r2", 1, "auto", "stepcloud"), ("r3", 2, "auto", "arena"), ("r4", 3, "live", "arena"), ("r5", 9, "live", "arena"), ("r6", 2, "vault", "arena")]
    requests = spark.createDataFrame([(i, u, "X", " Coaching", "t", p, m, None, None) for i, u, m, p in req], "request_id string, user_id bigint, client string, purpose string, tool string, prefer string, prefer_data string, start date, end date")
    stored = spark.createDataFrame([(1, day("2025-01-01"), "arena", 10, 1.0, 5), (1, day("2025-01-01"), "stepcloud", 20, 1.0, 6), (1, day("2025-01-02"), "manual", 30, 1.0, 1), (2, day("2020-01-01"), "arena", 1, 1.0, 1)], "user_id bigint, date date, source string, steps bigint, kcalories double, inserted_at bigint")
    live = spark.createDataFrame([("arena", 2, day("2025-01-03"), 7, 1.0, "p2"), ("stepcloud", 3, day("2025-01-03"), 8, 1.0, "p3")], "source string, user_id bigint, date date, steps bigint, kcalories double, player_id string")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id bigint")
    resolved = spark.createDataFrame([(2, "walk", "arena", "A", "p", "tok"), (3, "walk", "arena", "A", "p", ""), (3, "walk", "stepcloud", "S", "p", "tok")], "user_id bigint, domain string, source string, connected_application string, player_id string, token string")
    out = jobs.fetch_walk(requests, none, users, resolved, live, stored, live=("arena", "stepcloud"), as_of="2025-01-05", paths=[])
    got = {r.request_id: r for r in out.collect()}
    assert [r.steps for r in got["r1"].records] == [10, 30] and [r.steps for r in got["r2"].records] == [20, 30]
    assert got["r3"].selected_source == "arena" and [r.steps for r in got["r3"].records] == [7]
    assert got["r4"].selected_source == "stepcloud" and [(a.source, a.ok, a.error_code) for a in got["r4"].attempts] == [("arena", False, "missing_token"), ("stepcloud", True, None)]
    assert got["r5"].error.code == "all_sources_failed" and {a.error_code for a in got["r5"].attempts} == {"unknown_user"} and got["r6"].error.code == "vault_empty"
    path = str(tmp_path / "daily")
    jobs.write_through(out, path, 9, ("arena", "stepcloud"))
    assert sorted((r.user_id, r.source, r.steps) for r in readers.scan_daily(spark, path).collect()) == [(2, "arena", 7), (3, "stepcloud", 8)]
