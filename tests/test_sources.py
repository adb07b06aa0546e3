import gzip
import http.server
import json
import threading
import urllib.parse
import zipfile

import pytest

from tramline.plans import stream
from tramline.sources import files, paged, sinks
from tramline.streaming.sessions import OrphanStream, run_to_table, sessions

ALIASES = {"card_id": ["카드_ID", "card_id"], "ride": ["승차일시", "RIDE_DTM"], "extra": ["none"]}


def test_delimited_files_of_all_kinds(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "20260301.csv").write_text('﻿"카드ID",RIDE_DTM\n1,"x, y"\n2\n', encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("card_id;승차_일시\n3;아침\n".encode("cp949"))
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("RIDE_DTM\tcard_id\nr\t4\n")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("202603.csv", "card_id|RIDE_DTM\n5|s\n")
        z.writestr("notes.md", "card_id")
    (tmp_path / "bad.zip").write_bytes(b"PK broken")
    (tmp_path / "other.csv").write_text("no,such\n1,2\n")
    got = files.read_delimited(spark, str(tmp_path), ALIASES, ["card_id", "ride"]).select("card_id", "ride", "extra", "member")
    assert {tuple(r) for r in got.collect()} == {("1", "x, y", None, "20260301.csv"), ("2", None, None, "20260301.csv"), ("3", "아침", None, "b.txt"), ("4", "r", None, "c.csv"), ("5", "s", None, "202603.csv")}


def test_damage_and_lost_letters_are_told(spark, tmp_path):
    whole = gzip.compress(b"card_id,RIDE_DTM\n" + b"1,x\n" * 5000)
    (tmp_path / "cut.csv.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "bad.zip").write_bytes(b"PK broken")
    (tmp_path / "no.csv").write_text("no,such\n1,2\n")
    (tmp_path / "ok.csv").write_text("card_id,RIDE_DTM\n1,x\n2,y\n")
    (tmp_path / "torn.csv").write_bytes("card_id,RIDE_DTM\n1,아침\n".encode() + b"2,\xff\xfe\n")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("good.csv", "card_id,RIDE_DTM\n5," + "w" * 200_000 + "\n")
    told = {r.source_file.rsplit("/", 1)[-1]: r for r in files.deliveries(spark, str(tmp_path), ALIASES, ["card_id", "ride"]).collect()}
    assert told["cut.csv.gz"].problem == "damaged: EOFError" and told["bad.zip"].problem == "damaged: BadZipFile" and told["no.csv"].problem == "no header for card_id, ride"
    assert told["ok.csv"].n_rows == 2 and not told["ok.csv"].replaced and told["z.zip"].n_rows == 1 and told["z.zip"].member == "good.csv"
    assert told["torn.csv"].problem is None and (told["torn.csv"].replaced or told["torn.csv"].encoding == "latin-1")
    got = files.read_delimited(spark, str(tmp_path), ALIASES, ["card_id", "ride"])
    assert sorted({r.source_file.rsplit("/", 1)[-1] for r in got.select("source_file").collect()}) == ["ok.csv", "torn.csv", "z.zip"]


def test_daily_files_beat_monthly_by_day(spark):
    rows = [("d20260301.csv", "20260301", 1), ("m202603.csv", "20260301", 2), ("m202603.csv", "20260302", 3), ("m202602.csv", "20260228", 4)]
    df = spark.createDataFrame(rows, "member string, date string, v int").withColumn("file_date", files.file_date())
    assert {r.v for r in files.prefer_daily(df).collect()} == {1, 3, 4}
    days = spark.createDataFrame([("20260301",), ("20260302",), ("20260228",), ("20260101",)], "date string")
    got = files.files_for_days(df.select("member", "file_date").distinct(), days)
    assert {tuple(r) for r in got.collect()} == {("20260301", "d20260301.csv"), ("20260302", "m202603.csv"), ("20260228", "m202602.csv"), ("20260101", None)}


class Service(http.server.BaseHTTPRequestHandler):
    asked: list[str] = []
    fails = 1

    def do_GET(self):
        q = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
        start, end, date = int(q["s"][0]), int(q["e"][0]), q.get("d", [""])[0]
        Service.asked.append(self.path)
        if Service.fails:
            Service.fails -= 1
            self.send_error(503)
            return
        total = {"20260301": 5, "20260302": 3, "20260303": 0}[date]
        rows = [{"date": date, "n": i} for i in range(start, min(end, total) + 1)]
        body = {"RESULT": {"CODE": "INFO-000"}, "total": total, "rows": rows} if total else {"RESULT": {"CODE": "INFO-200"}}
        if date == "20260309":
            body = {"RESULT": {"CODE": "ERROR-300"}}
        data = json.dumps(body).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *a):
        pass


@pytest.fixture
def service():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/?s={{start}}&e={{end}}&d={{date}}"
    s.shutdown()


def test_paged_source(spark, service):
    paged.register(spark)
    df = spark.read.format("paged_json").option("url", service).option("page", 2).option("pause", 0.01).option("dates", "20260301,20260302,20260303").load()
    assert sorted((r.date, int(r.n)) for r in df.collect()) == [("20260301", i) for i in range(1, 6)] + [("20260302", i) for i in range(1, 4)]
    Service.asked.clear()
    assert df.filter("date = '20260302'").count() == 3
    assert not any("d=20260301" in a and "e=1&" not in a for a in Service.asked)


class Plain(http.server.BaseHTTPRequestHandler):
    """47 rows by date, without a count if the address says so; every row but the first has one more field."""

    asked: list[str] = []
    rows = [{"date": f"202603{1 + i // 5:02d}", "n": i} | ({"late": "x"} if i else {}) for i in range(47)]

    def do_GET(self):
        q = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
        Plain.asked.append((int(q["s"][0]), int(q["e"][0])))
        rows = Plain.rows if q["k"][0] != "mixed" else Plain.rows[20:] + Plain.rows[:20]
        body = {"rows": rows[int(q["s"][0]) - 1 : int(q["e"][0])]} | ({} if q["k"][0] == "bare" else {"total": len(rows)})
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *a):
        pass


def test_service_without_count_and_sorted_service(spark):
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Plain)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    paged.register(spark)
    read = lambda kind, **o: spark.read.format("paged_json").options(url=f"http://127.0.0.1:{s.server_port}/?s={{start}}&e={{end}}&k={kind}", page=4, pause=0.01, **o).load()
    bare = read("bare")
    assert bare.columns == ["date", "n", "late"] and sorted(int(r.n) for r in bare.collect()) == list(range(47))
    for kind in ("sorted", "mixed"):
        df = read(kind, sorted="true").filter("date >= '20260304' and date <= '20260305'")
        Plain.asked.clear()
        assert sorted(int(r.n) for r in df.collect()) == list(range(15, 25))
        whole = {a for a in Plain.asked if a[1] > a[0]}
        assert len(whole) <= 5 if kind == "sorted" else len(whole) == 12
    with pytest.raises(Exception, match="not sorted"):
        read("mixed", sorted="true", strict="true").filter("date = '20260304'").count()
    s.shutdown()


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    new = spark.createDataFrame([("b", 3.0), ("c", 4.0)], "k string, v double")
    assert {tuple(r) for r in sinks.upsert_add(old, new, ["k"], ["v"]).collect()} == {("a", 1.0), ("b", 5.0), ("c", 4.0)}
    assert {tuple(r) for r in sinks.upsert_replace(old, new, ["k"]).collect()} == {("a", 1.0), ("b", 3.0), ("c", 4.0)}
    sinks.write_csv(old, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv")).count() == 2
    sinks.write_csv(old.limit(0), str(tmp_path / "none"), one_file=True)
    sinks.write_table(old, str(tmp_path / "t"), ["k"])
    back = spark.read.parquet(str(tmp_path / "t")).select("k", "v")
    assert sinks.content_signature(back, ["k", "v"]) == sinks.content_signature(old.repartition(3), ["k", "v"]) != sinks.content_signature(new, ["k", "v"])
    sinks.write_manifest(str(tmp_path / "m.json"), rows=2, name="é")
    assert json.loads((tmp_path / "m.json").read_text()) == {"rows": 2, "name": "é"}
    ledger = lambda *r: spark.createDataFrame(list(r), "source_file string, signature string")
    assert {r.source_file for r in sinks.new_sources(ledger(("a", "1"), ("b", "2")), ledger(("a", "1"), ("b", "1"))).collect()} == {"b"}


def test_streams(spark, tmp_path):
    ev = spark.sql("select 1L as user_id, timestamp'2026-03-02 10:00:00' + make_dt_interval(0, 0, x) as ts, 1.0D as value from (select explode(array(0, 10, 100, 1000, 2000)) x)")
    ev.write.parquet(str(tmp_path / "ev"))
    want = {(r.n_events, r.total) for r in sessions(ev, "user_id", "ts").collect()}
    assert want == {(2, 2.0), (1, 1.0)}
    run_to_table(sessions(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")), "user_id", "ts"), str(tmp_path / "out"), str(tmp_path / "st"))
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 3
    refs = spark.createDataFrame([("a", "20260301"), ("b", "20260301"), ("a", "20260301")], "key string, day string")
    refs.write.parquet(str(tmp_path / "refs"))
    s = OrphanStream(spark)
    s.parents(spark.createDataFrame([("a", "", 1)], "key string, from_day string, change long"))
    s.run(spark.readStream.schema(refs.schema).parquet(str(tmp_path / "refs")), str(tmp_path / "w"))
    assert [(r.key, r.n_refs) for r in s.state.pending().collect()] == [("b", 1)]


def test_stream_gives_all_sessions(spark, sf, tmp_path):
    """The stream ends with the sessions of the table, in one file or in many that are not in the order of time."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(60, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    for at in (sf, str(tmp_path)):
        want, got = (sorted(map(str, f(spark, at).collect())) for f in (stream.user_sessions, stream.user_sessions_stream))
        assert got == want


def test_encoding_is_that_of_the_whole_file(spark, tmp_path):
    """The first letter beyond ASCII stands after the bytes by which the delimiter is found."""
    rows = "".join(f"{i};morning\n" for i in range(30_000))
    for name, encoding in (("a.csv", "cp949"), ("b.csv", "utf-8"), ("c.csv", "latin-1")):
        (tmp_path / name).write_bytes(f"card_id;RIDE_DTM\n{rows}9;{'é' if encoding == 'latin-1' else '아침'}\n".encode(encoding))
    df = files.read_delimited(spark, str(tmp_path), ALIASES, ["card_id", "ride"])
    assert {r.member: r.ride for r in df.filter("ride <> 'morning'").collect()} == {"a.csv": "아침", "b.csv": "아침", "c.csv": "é"}
