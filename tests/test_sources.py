import json
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from veilspark.operators.engine import Redactor
from veilspark.sources.lines import assemble_lines, explode_lines, over_long, read_lines, redact_files
from veilspark.sources.requests import redact_batch_requests, redact_events, redact_requests
from veilspark.streaming.streams import findings_per_window, redact_stream, ship_events

ROOT = str(Path(__file__).resolve().parent.parent)


def test_lines_keep_blanks_and_returns(spark, tmp_path):
    (tmp_path / "in.txt").write_bytes(b"a\r\n\nlast a@b.cc")
    assert [x.value for x in read_lines(spark, str(tmp_path / "in.txt")).collect()] == ["a\r", "", "last a@b.cc"]
    redact_files(Redactor(spark), str(tmp_path / "in.txt"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) .splitlines(keepends=True)[-1] == "last [REDACTED:email]\n"


def test_explode_and_assemble(spark):
    texts = ["a\nb", "", "x\n", "\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    back = {x.i: x.text for x in assemble_lines(explode_lines(df, "text", ["i"]), ["i"]).collect()}
    assert back == dict(enumerate(texts))


def test_over_long(spark):
    df = spark.createDataFrame([("é" * 10,)], "t string").select(over_long("t", 19), over_long("t", 20))
    assert list(df.first()) == [True, False]


def test_requests(spark):
    bodies = [(1, json.dumps({"text": "password=abcd\nclean\na@b.cc"})), (2, "no json"), (3, json.dumps({"text": "é a@b.cc"}))]
    got = {x.i: x.response for x in redact_requests(Redactor(spark), spark.createDataFrame(bodies, "i int, body string"), "body").collect()}
    first = json.loads(got[1])
    assert first == {"redacted": "[REDACTED:password]\nclean\n[REDACTED:email]", "stats": {"lines_processed": 3, "lines_modified": 2, "patterns_matched": 2}}
    assert got[2] is None and json.loads(got[3])["redacted"] == "é [REDACTED:email]"


def test_odd_bodies_let_nothing_through(spark):
    bodies = [
        r'{"text": "\ud800 a@b.cc"}', '{"text": "x", "text": "a@b.cc"}', '{"text": 5}', "[]", '{"text": null}', '{"text": ["a@b.cc"]}', '{"text": {"a": "a@b.cc"}}', '{"text": "a@b.cc', '"a@b.cc"', "", "\x00",
        '{"other": "a@b.cc"}', '{"text": "a\\u0040b.cc"}', '{"text": "' + "[" * 3000 + '"}', "[" * 2000, None,
    ]
    got = [r.response for r in redact_requests(Redactor(spark), spark.createDataFrame([(x,) for x in bodies], "body string"), "body").collect()]
    assert len(got) == len(bodies) and not any("a@b.cc" in x for x in got if x)
    assert json.loads(got[12])["redacted"] == "[REDACTED:email]"
    batches = [x and x.replace('"text"', '"texts"') for x in bodies] + ['{"texts": ["a@b.cc", null, 5, "x"]}', '{"texts": []}']
    got = [r.response for r in redact_batch_requests(Redactor(spark), spark.createDataFrame([(x,) for x in batches], "body string"), "body").collect()]
    assert len(got) == len(batches) and not any("a@b.cc" in x for x in got if x) and json.loads(got[-1])["results"] == []


def test_batch_requests(spark):
    body = json.dumps({"texts": ["normal line", "x a@b.cc", "another"]})
    got = json.loads(redact_batch_requests(Redactor(spark), spark.createDataFrame([(body,)], "body string"), "body").first().response)
    assert [x["redacted"] for x in got["results"]] == ["normal line", "x [REDACTED:email]", "another"]
    assert got["stats"] == {"items_processed": 3, "total_lines": 3, "total_modified": 1, "total_patterns_matched": 1}


def test_stream_is_batch_and_resumes(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    Path(source).mkdir()
    Path(source, "1.txt").write_text("a@b.cc\nclean\n")
    redact_stream(Redactor(spark), source, target, mark).awaitTermination()
    Path(source, "2.txt").write_text("10.0.0.1\n")
    Redactor(spark).stream(source, target, mark).awaitTermination()
    got = sorted(x.value for x in spark.read.text(target).collect())
    assert got == ["[REDACTED:email]", "[REDACTED:ipv4]", "clean"]


def test_windowed_findings(spark):
    rows = [("2024-01-01 00:01:00", "a@b.cc"), ("2024-01-01 00:02:00", "c@d.ee"), ("2024-01-01 00:15:00", "a@b.cc 10.0.0.1")]
    df = spark.createDataFrame(rows, "ts string, t string").withColumn("ts", F.to_timestamp("ts"))
    got = {(x.w, x.name): x.n for x in findings_per_window(Redactor(spark), df, "ts", "t").select(F.date_format("window.start", "HH:mm").alias("w"), "name", "n").collect()}
    assert got == {("00:00", "email"): 2, ("00:10", "email"): 1, ("00:10", "ipv4"): 1}


EVENTS = [
    '{"level": "warn", "message": "login a@b.cc", "code": 7, "tags": ["x"]}', '{"level": "info", "message": "clean", "code": 1}', '{"level": "a@b.cc", "message": null}', "no json a@b.cc", '{"message": "cut 10.0.0.1', '{"code": "a@b.cc"}', '{"message": "\\ud800 10.0.0.1"}',
    '{"message": "first", "message": "a@b.cc"}',
]


def test_events(spark):
    df = spark.createDataFrame([(x,) for x in [*EVENTS, None]], "body string")
    got = [r.body for r in redact_events(Redactor(spark), df, "body", "level string, message string, code int", ["message", "level"]).collect()]
    assert json.loads(got[0]) == {"level": "warn", "message": "login [REDACTED:email]", "code": 7} and json.loads(got[1]) == {"level": "info", "message": "clean", "code": 1}
    assert json.loads(got[2])["level"] == "[REDACTED:email]" and got[3] == "no json [REDACTED:email]" and got[-1] is None
    assert not any("a@b.cc" in x or "10.0.0.1" in x for x in got[:-1])


def test_shipped_events_arrive_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    Path(source).mkdir()
    for k in range(2):
        Path(source, f"{k}.txt").write_text("\n".join(EVENTS[:3]) + "\n")
        ship_events(Redactor(spark), spark.readStream.text(source), "value", "level string, message string, code int", ["message", "level"], target, mark).awaitTermination()
    got = [x.value for x in spark.read.text(target).select("value").collect()]
    assert len(got) == 6 and not any("a@b.cc" in x for x in got)


def test_large_batches_are_halved(spark, monkeypatch):
    import pyarrow as pa

    from veilspark.operators import arrow

    monkeypatch.setattr(arrow, "MOST_BYTES", 200)
    lines = [f"line {i} a{i}@b.cc" if i % 3 else f"clean {i}" for i in range(100)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string").coalesce(1)
    assert [x.t for x in df.select(Redactor(spark).redact_text("t").alias("t")).collect()] == [x if i % 3 == 0 else f"line {i} [REDACTED:email]" for i, x in enumerate(lines)]
    assert pa.array(lines).nbytes > arrow.MOST_BYTES


def test_command_line(tmp_path):
    (tmp_path / "own.txt").write_text("own|zzz|zzz[0-9]+|\n")
    run = lambda *a, text: subprocess.run([sys.executable, "-m", "veilspark.cli", *a], input=text, capture_output=True, text=True, cwd=ROOT, check=True)
    done = run("-p", str(tmp_path / "own.txt"), text="zzz12 a@b.cc\nlast")
    assert done.stdout == "[REDACTED:own] [REDACTED:email]\nlast" and "lines 2, modified 1" in done.stderr
    assert run("-D", "-q", "-c", "soc2", text="request_id=ab a@b.cc\n").stdout == "[REDACTED:request_id] a@b.cc\n"
