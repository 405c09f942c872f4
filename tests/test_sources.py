"""Round trips through files."""

import json

from lurelens.sources import folders as D
from lurelens.sources import mail as M
from lurelens.sources import tables as T

EML = """From: "Jo" <jo@example.com>
To: you@example.com
Subject: =?utf-8?Q?Caf=C3=A9_news?=
Message-ID: <1@example.com>
Date: Mon, 12 Mar 2024 10:00:00 +0000
X-Twice: first
X-Twice: second

Look: https://bit.ly/a https://bit.ly/a https://b.org/x) end
"""


def test_eml_folder(spark, tmp_path):
    (tmp_path / "a.eml").write_text(EML)
    (tmp_path / "b.txt").write_text(EML)
    mails, bad = M.read_messages(spark, str(tmp_path))
    row = mails.collect()
    assert len(row) == 1 and bad.count() == 0
    r = row[0]
    assert (r.id, r.subject, r.source) == ("<1@example.com>", "Café news", "eml")
    assert r.urls == ["https://bit.ly/a", "https://b.org/x"]
    assert r.headers["x-twice"] == "first" and "12 Mar 2024" in r.timestamp


def test_bad_bytes_and_reply_to(spark, tmp_path):
    (tmp_path / "latin.eml").write_bytes(b"From: a@b.c\nReply-To: r@s.t\nSubject: caf\xe9 news\n\ncaf\xe9 body\n")
    (tmp_path / "good.eml").write_text(EML)
    mails, bad = M.read_messages(spark, str(tmp_path))
    rows = {r.from_email: r for r in mails.collect()}
    assert bad.count() == 0 and len(rows) == 2
    assert rows["a@b.c"].body == "caf body\n" and rows["a@b.c"].reply_to == "r@s.t"
    (tmp_path / "m.jsonl").write_text(json.dumps({"id": "1", "sender_email": "a@b.c", "reply_to": "d@e.f"}) + "\n")
    good, _ = M.read_json_lines(spark, str(tmp_path / "m.jsonl"))
    assert [(r.from_email, r.reply_to) for r in good.collect()] == [("a@b.c", "d@e.f")]


def test_multipart_and_html_only(spark):
    multi = 'From: a@b.c\nContent-Type: multipart/mixed; boundary="x"\n\n--x\nContent-Type: text/plain\n\nhello\n--x\nContent-Type: application/pdf\nContent-Disposition: attachment; filename="f.pdf"\n\nabcd\n--x--\n'
    html = 'From: a@b.c\nContent-Type: multipart/alternative; boundary="x"\n\n--x\nContent-Type: text/html\n\n<p>hi</p>\n--x--\n'
    df = spark.createDataFrame([(1, multi), (2, html)], "k int, content string")
    rows = {r.k: r for r in M.parse_mime(df, "content", "k").collect()}
    assert rows[1].body.strip() == "hello" and rows[1].attachments[0].filename == "f.pdf" and rows[1].attachments[0].size == 4
    assert rows[2].body == "" and rows[2].id == "unknown"


def test_nested_parts_yield_their_text(spark):
    inner = 'Content-Type: multipart/alternative; boundary="y"\n\n--y\nContent-Type: text/plain\n\nnested text\n--y\nContent-Type: text/html\n\n<p>x</p>\n--y--\n'
    mail = f'From: a@b.c\nContent-Type: multipart/mixed; boundary="x"\n\n--x\n{inner}\n--x\nContent-Type: application/pdf\nContent-Disposition: attachment; filename="f.pdf"\n\nabcd\n--x--\n'
    row = M.parse_mime(spark.createDataFrame([(mail,)], "content string"), "content").first()
    assert row.body.strip() == "nested text" and [a.filename for a in row.attachments] == ["f.pdf"]


def test_mail_folder_round_trip(spark, tmp_path):
    odd = "é — ünï\n\nline with trailing blank \n.\nFrom the start\n" + "x" * 2000
    rows = [("<1@x>", "Café — naïve " * 20, "a@b.c", "d@e.f", None, odd, []), ("<2@x>", "", "a@b.c", "d@e.f", "r@s.t", "", [("Ünvoice.ZIP", "application/zip", 3)]), ("<3@x>", None, None, None, None, None, [])]
    df = spark.createDataFrame(rows, f"id string, subject string, from_email string, to_email string, reply_to string, body string, attachments array<{M.ATTACHMENT}>")
    path = str(tmp_path / "m")
    D.write_folder(df.repartition(2), path)
    good, bad = D.read_folder(spark, path)
    got = {r.id: r for r in good.collect()}
    assert bad.count() == 0 and set(got) == {"<1@x>", "<2@x>", "<3@x>"}
    assert got["<1@x>"].body == odd and got["<1@x>"].subject.strip() == ("Café — naïve " * 20).strip()
    assert got["<2@x>"].reply_to == "r@s.t" and [(a.filename, a.size) for a in got["<2@x>"].attachments] == [("Ünvoice.ZIP", 3)]
    assert got["<3@x>"].body == "" and got["<3@x>"].from_email == ""
    D.write_folder(df.limit(1), path)  # replaces what was there
    assert D.read_folder(spark, path)[0].count() == 1
    D.write_folder(df.limit(1), path, "txt", "append")
    assert D.read_folder(spark, path)[0].count() == 1 and D.read_folder(spark, path, "txt")[0].count() == 1
    (tmp_path / "empty").mkdir()
    assert D.read_folder(spark, str(tmp_path / "empty"))[0].count() == 0


def test_folder_partitions_are_bounded():
    files = [(f"f{i}", size) for i, size in enumerate((10, 20, 500_000, 5, 5, 2_000_000, 1))]
    groups = D.packed(files, 600_000)
    assert [f for g in groups for f in g] == [f for f, _ in files]
    assert all(len(g) == 1 or sum(dict(files)[f] + D.OPEN_BYTES for f in g) <= 600_000 for g in groups)
    assert D.packed([], 1) == []


def test_labelled_csv_readers(spark, tmp_path):
    T.write_csv(spark.createDataFrame([("  two  blanks ", 1), ('quo"te, comma\nline', None)], "text string, target int"), str(tmp_path / "l"))
    assert {(r.body, r.label) for r in T.read_raw_labelled(spark, str(tmp_path / "l")).collect()} == {("  two  blanks ", 1), ('quo"te, comma\nline', 0)}
    T.write_csv(spark.createDataFrame([("https://a.b/c", 1, "bank")], "url string, label int, category string"), str(tmp_path / "u"))
    assert [tuple(r) for r in T.read_labelled_urls(spark, str(tmp_path / "u")).collect()] == [("https://a.b/c", 1, "bank")]
    T.write_predictions(spark.createDataFrame([("1", 0.25, "LOW")], "id string, probability double, risk_level string"), str(tmp_path / "p"))
    assert [tuple(r) for r in spark.read.schema("id string, probability double, risk_level string").json(str(tmp_path / "p")).collect()] == [("1", 0.25, "LOW")]


def test_json_lines_and_files(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps({"id": "1", "from": "a@b.c", "label": 1}) + "\n{broken\n")
    good, bad = M.read_json_lines(spark, str(tmp_path / "m.jsonl"))
    assert [(r.id, r.from_email, r.source, r.label) for r in good.collect()] == [("1", "a@b.c", "json", 1)]
    assert bad.count() == 1
    (tmp_path / "one.json").write_text(json.dumps({"id": "2", "from": "x@y.z", "to": "q@r.s", "urls": ["https://a.b"]}, indent=1))
    good, _ = M.read_json_files(spark, str(tmp_path))
    assert [(r.id, r.to_email, r.urls) for r in good.collect()] == [("2", "q@r.s", ["https://a.b"])]


def test_mail_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "s", "a@b.c", "d@e.f", "body\nline", 0)], "id string, subject string, from_email string, to_email string, body string, label int")
    T.write_mails(df, str(tmp_path / "out"))
    back, bad = M.read_json_lines(spark, str(tmp_path / "out"))
    assert bad.count() == 0
    assert [tuple(r) for r in back.select(*df.columns).collect()] == [tuple(r) for r in df.collect()]
    T.write_mails(df, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_csv_round_trip(spark, tmp_path):
    rows = [('say "hi", now', "a@b.c", "two\nlines", "https://a.b,https://c.d", 1)]
    df = spark.createDataFrame(rows, T.UNIFIED)
    T.write_csv(df, str(tmp_path / "u"))
    assert [tuple(r) for r in T.read_unified(spark, str(tmp_path / "u")).collect()] == rows


def test_raw_message_csv(spark, tmp_path):
    raw = "Subject: first\nFrom: a@b.c\nSubject: last\n\nBody https://x.y/z here"
    T.write_csv(spark.createDataFrame([("f", raw), ("g", "no headers at all")], "file string, message string"), str(tmp_path / "raw"))
    got = {r.subject: r for r in T.read_raw_messages(spark, str(tmp_path / "raw")).collect()}
    assert got["last"].from_email == "a@b.c" and got["last"].body == "Body https://x.y/z here" and got["last"].urls == "https://x.y/z"
    plain = got["no headers at all"]
    assert plain.from_email == "unknown@email.com" and plain.body == "no headers at all" and plain.label == 0


def test_class_counts(spark):
    a = spark.createDataFrame([("x", 1)], "subject string, label int")
    b = spark.createDataFrame([("y", "z", 0)], "subject string, body string, label int")
    assert {(r.label, r.rows) for r in T.class_counts(T.combine(a, b)).collect()} == {(0, 1), (1, 1)}
