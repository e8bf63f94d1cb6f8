"""Sources over hand-made files: readers, shapes, links and detection."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from caseloom.functions import dates as D
from caseloom.functions import text as X
from caseloom.sources import answers, changelog, detect, eventlog, git, issues, mail, tracker, xes

INVOICES = """inv;client;status;raised_date;raised_by;approved_date;approved_by;paid_date
I-1;Acme;paid;02/01/2024;ann;2024-01-05;bob;2024-01-20
I-2;Bolt;paid;2-Jan-2024;ann;;;2024-02-01
I-3;Core;new;;;soon;;
;Lost;new;2024-01-01;;;;
I-1;Acme again;paid;2024-03-01;ann;;;
;;;;;;;
"""


def spec():
    return tracker.TableSpec("table:inv", "invoice", "inv", [tracker.StepColumn("raised_date", "raised", "raised_by"), tracker.StepColumn("approved_date", "approved", "approved_by"), tracker.StepColumn("paid_date", "paid")], {"client": "client"}, ["client"], ["client"])


@pytest.fixture
def invoices(spark, tmp_path):
    (tmp_path / "inv.csv").write_text("﻿" + INVOICES, encoding="utf-8")
    return tracker.read_rows(spark, str(tmp_path / "inv.csv"))


def test_tracker(invoices):
    s = tracker.shape(invoices, spec())
    entities = {r.entity_id: r for r in s.entities.collect()}
    assert entities["invoice:I-1"].attrs == {"client": "Acme", "n_rows": "2", "duplicate_id": "true"}
    assert [e for e in entities if e.startswith("orphan_row")]
    events = {r.event_id: r for r in s.events.collect()}
    assert str(events["ev:invoice:I-1:raised"].ts.date()) == "2024-01-02" and events["ev:invoice:I-1:raised"].actor == "person:ann"
    assert str(events["ev:invoice:I-2:raised"].ts.date()) == "2024-01-02" and events["ev:invoice:I-2:paid"].actor is None
    assert "ev:invoice:I-1:raised:2" in events and not any("I-3" in e for e in events)
    assert {r.entity_id.split(":")[0] for r in s.observations.collect()} == {"invoice", "orphan_row"}
    methods = {(r.src, r.method) for r in s.links.collect()}
    assert ("invoice:I-1", "row-identity") in methods and ("invoice:I-2", "foreign-key") in methods


@pytest.mark.parametrize("odd", [None, '"two\nlines";9', '5" , "";x', "   "])
def test_rows_of_large_files_are_read_in_pieces(spark, tmp_path, odd):
    lines = [f'k{i};"a;b ""{i}"""' for i in range(3000)]
    for name, part in (("a.csv", lines[:2000]), ("b.csv", lines[2000:])):
        (tmp_path / name).write_text("\n".join(["key;note", *part, *([odd] if odd and name == "b.csv" else [])]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = tracker.read_rows(spark, str(tmp_path))
        parts, rows = got.rdd.getNumPartitions(), sorted(got.collect(), key=lambda r: r.row)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.key, r.note) for r in rows[:3000]] == [(f"k{i}", f'a;b "{i}"') for i in range(3000)]
    assert [r.row for r in rows] == list(range(len(rows))) and parts > (1 if odd else 8)


def test_profile_counts_only_what_is_asked(spark):
    rows = spark.createDataFrame([("a", "2024-01-02", None), ("a", " ", "1,5"), (" a ", "soon", "7"), (None, "2024-01-02", "")], "x string, `y.z` string, n string")
    assert detect.profile(rows, rows.columns) == {"x": {"filled": 3, "distinct": 1, "dates": 0, "numbers": 0}, "y.z": {"filled": 3, "distinct": 2, "dates": 2, "numbers": 0}, "n": {"filled": 2, "distinct": 2, "dates": 0, "numbers": 2}}
    assert detect.profile(rows, ["x"], ("filled", "distinct")) == {"x": {"filled": 3, "distinct": 1}}
    assert detect.profile(rows.limit(0), ["x"], ("filled",)) == {"x": {"filled": 0}}


def test_detect(spark, invoices):
    assert detect.detect(invoices).mode == "wide"
    log = spark.createDataFrame([(f"C{i % 6}", a, f"{1 + k:02d}/02/2024 10:0{i}", "u") for i in range(6) for k, a in enumerate(["Enter", "Verify", "Pay"])], "case string, act string, at string, username string").coalesce(1).withColumn("row", F.monotonically_increasing_id())
    d = detect.detect(log)
    assert d.mode == "long" and (d.spec.case, d.spec.activity, d.spec.timestamp, d.spec.actor) == ("case", "act", "at", "username")
    s = eventlog.shape(log, d.spec, max_cases=2)
    assert s.entities.count() == 2 and s.events.count() == 6 and s.events.filter("ts is null").count() == 0
    assert detect.detect(log.select("username", "row")).mode is None
    assert detect.detect(log.limit(0)).mode is None


def test_dates(spark):
    rows = [("02/01/2024", "2024-01-02"), ("2-Jan-2024", "2024-01-02"), ("2024-01-02", "2024-01-02"), ("13/12/2024", "2024-12-13"), ("12/13/2024", "2024-12-13"), ("", None), ("soon", None), (None, None)]
    got = spark.createDataFrame(rows, "s string, want string").select("want", D.parse_date(F.col("s")).cast("string").alias("d")).collect()
    assert [r.want for r in got] == [r.d for r in got]
    t = spark.createDataFrame([("2024-01-05T09:30:00Z",), ("2024-01-05",), ("5/1/2024 9:30",)], "s string").select(D.parse_timestamp(F.col("s")).cast("string").alias("t"), D.has_time(F.col("s")).alias("h")).collect()
    assert [(r.t, r.h) for r in t] == [("2024-01-05 09:30:00", True), ("2024-01-05 00:00:00", False), ("2024-01-05 09:30:00", True)]


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert sorted(one(X.strong_tokens(F.lit("INV-2024-0312 for 4,250.00 on 2024-01-05 by a.b@c.org, ref 12345 in 2024")))) == ["12345", "2024-01-05", "4250", "a.b@c.org", "inv-2024-0312"]
    assert one(X.content_tokens(F.lit("The Acme retainer, the handover"))) == ["acme", "retainer", "handover"]
    assert one(X.subject_key(F.lit("Re: FW:  Big   Deal"))) == "big deal"
    refs = [(r.kind, r.number, r.tier) for r in one(X.references(F.lit("Merge pull request #12 from a/b\nFixes #7, see #7 and #9")))]
    assert ("pr", 12, 4) in refs and ("issue", 7, 3) in refs and ("issue", 9, 2) in refs and ("issue", 7, 2) not in refs
    assert [(r.name, r.email) for r in one(X.co_authors(F.lit("x\n\nCo-authored-by: Ann B <A@b.c>\n")))] == [("Ann B", "a@b.c")]
    assert one(X.address(F.lit("Ann <Ann@X.org>"))) == "ann@x.org" and one(X.message_id(F.lit(" <a@b> "))) == "a@b"


MAIL = ["From: Ann <ann@x.org>\nTo: bob@x.org\nDate: Mon, 5 Feb 2024 10:00:00 +0100\nSubject: Contract\nMessage-ID: <m1>\n\nPlease sign.", "From: bob@x.org\nTo: ann@x.org\nDate: Tue, 6 Feb 2024 10:00:00 +0100\nSubject: Re: Contract\nMessage-ID: <m2>\nIn-Reply-To: <m1>\n\nSigned.", "From: bob@x.org\nDate: nonsense\nSubject: Re: Contract\n\nLost header.", "From: noreply@x.org\nDate: Tue, 6 Feb 2024 10:00:00 +0100\nSubject: Daily\nMessage-ID: <m3>\n\nBeep."]


def test_mail(spark, tmp_path):
    for i, m in enumerate(MAIL):
        (tmp_path / f"{i}.eml").write_text(m)
    s = mail.shape(mail.read_maildir(spark, str(tmp_path)), "box")
    ev = {r.entity_id: r for r in s.events.collect()}
    assert ev["email:box:m1"].action == "sent" and str(ev["email:box:m1"].ts) == "2024-02-05 09:00:00" and ev["email:box:m2"].action == "replied"
    assert sum(r.ts is None for r in ev.values()) == 1
    links = {(r.src, r.method, r.target) for r in s.links.collect()}
    assert ("email:box:m2", "in-reply-to", "email:box:m1") in links and ("email:box:m3", "standalone", "email:box:m3") in links
    assert ("email:box:m1", "thread-root", "email:box:m1") in links and any(m == "subject-thread" and t == "thread:box:contract" for _, m, t in links)
    assert s.entities.filter("type = 'person'").count() == 3
    (tmp_path / "x.mbox").write_text("".join(f"From x@y Mon Feb  5 10:00:00 2024\n{m}\n\n" for m in MAIL))
    assert mail.shape(mail.read_mbox(spark, str(tmp_path / "x.mbox")), "b").events.count() == 4


def commit(sha, parents=(), subject="work", body="", who="ann", when="2024-01-01T10:00:00+00:00", committer=None, later=None):
    p = {"name": who, "email": f"{who}@x.org"}
    c = {"name": committer, "email": f"{committer}@x.org"} if committer else p
    return {"sha": sha, "short_sha": sha[:8], "parents": list(parents), "is_merge": len(parents) > 1, "author": p, "committer": c, "author_date": when, "committer_date": later or when, "refs": [], "subject": subject, "body": body, "files": []}


def test_git(spark, tmp_path):
    rows = [commit("t1"), commit("t2", ["t1"], "tweak (#4)"), commit("b1", ["t1"], "part one", "Co-authored-by: Cy <cy@x.org>"), commit("b2", ["b1"], "part two, fixes #9", committer="bob"), commit("m1", ["t2", "b2"], "Merge pull request #3 from ann/topic", when="2024-01-05T10:00:00+00:00"), commit("r1", ["m1"], 'Revert "part one"', when="2024-01-06T10:00:00+00:00", later="2024-01-09T10:00:00+00:00")]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "t.json").write_text(json.dumps([{"name": "1.0", "commit": "m1", "date": "2024-01-07T10:00:00+00:00"}]))
    c, t = git.read(spark, str(tmp_path / "c.jsonl"), str(tmp_path / "t.json"))
    assert {r.sha for r in git.trunk(c).collect()} == {"r1", "m1", "t2", "t1"}
    s = git.shape(c, t, "acme/w")
    acts = {(r.entity_id, r.action, r.actor) for r in s.events.collect()}
    assert ("commit:m1", "merged", "person:ann@x.org") in acts and ("commit:r1", "reverted", "person:ann@x.org") in acts and ("commit:b1", "authored", "person:cy@x.org") in acts
    assert ("commit:b2", "committed", "person:bob@x.org") in acts and ("release:1.0", "released", None) in acts
    links = {(r.src, r.target, r.method) for r in s.links.collect()}
    assert {("commit:m1", "pr:3", "merge-commit"), ("commit:b1", "pr:3", "merge-topology"), ("commit:b2", "pr:3", "merge-topology"), ("commit:t2", "pr:4", "squash-subject"), ("commit:b2", "issue:acme/w:9", "issue-reference"), ("release:1.0", "commit:m1", "tag-target")} <= links


def test_issues(spark, tmp_path):
    u = {"login": "Ann"}
    item = {"number": 5, "title": "Broken", "body": "see #6", "user": u, "state": "closed", "created_at": "2024-01-01T00:00:00Z", "closed_at": "2024-01-03T00:00:00Z", "labels": [{"name": "bug"}], "timeline": [{"event": "commented", "actor": {"login": "ci[bot]"}, "created_at": "2024-01-02T00:00:00Z"}, {"event": "cross-referenced", "actor": u, "created_at": "2024-01-02T01:00:00Z", "source": {"issue": {"number": 8, "pull_request": {"url": "x"}}}}]}
    pull = {"number": 8, "title": "Fix", "body": "Fixes #5", "user": u, "created_at": "2024-01-02T00:00:00Z", "merged_at": "2024-01-03T00:00:00Z", "merge_commit_sha": "m1", "merged_by": u, "timeline": [{"event": "merged", "actor": u, "created_at": "2024-01-03T00:00:00Z"}]}
    (tmp_path / "p.json").write_text(json.dumps({"slug": "a/w", "issues": [item], "pulls": [pull]}))
    s = issues.shape(issues.read(spark, str(tmp_path / "p.json")))
    acts = [(r.entity_id, r.action) for r in s.events.orderBy("seq").collect()]
    assert acts == [("issue:a/w:5", "opened"), ("issue:a/w:5", "commented"), ("issue:a/w:5", "cross_referenced"), ("issue:a/w:5", "closed"), ("pr:8", "opened"), ("pr:8", "merged")]
    links = {(r.src, r.target, r.method) for r in s.links.collect()}
    assert {("issue:a/w:5", "pr:8", "timeline-cross-referenced"), ("pr:8", "issue:a/w:5", "reference"), ("pr:8", "commit:m1", "merge-commit-sha")} <= links
    assert s.entities.filter("type = 'person' and attrs['is_bot'] = 'true'").count() == 1


def test_changelog(spark, tmp_path):
    (tmp_path / "CHANGES.rst").write_text("Version 2.0\n-----------\n\nReleased 2024-01-01\n\n-   Fix it. :pr:`12` :issue:`7`\n-   Long one\n    goes on. #9\n\nVersion 1.0\n-----------\n\nUnreleased\n\n-   First.\n")
    lines = changelog.read(spark, str(tmp_path / "CHANGES.rst"))
    got = [(r.version, r.status, r.idx, r.text) for r in changelog.bullets(lines).orderBy("no").collect()]
    assert got == [("2.0", "Released", 0, "Fix it. :pr:`12` :issue:`7`"), ("2.0", "Released", 1, "Long one goes on. #9"), ("1.0", "Unreleased", 0, "First.")]
    links = {(r.src, r.target) for r in changelog.shape(lines, "w").links.filter("method = 'changelog-citation'").collect()}
    assert links == {("changelog_entry:w:2.0:0", "pr:12"), ("changelog_entry:w:2.0:0", "issue:w:7"), ("changelog_entry:w:2.0:1", "issue:w:9")}


def test_xes(spark, tmp_path):
    ev = lambda a, l: f'<event><string key="concept:name" value="{a}"/><string key="org:resource" value="r"/><string key="lifecycle:transition" value="{l}"/><date key="time:timestamp" value="2024-01-01T00:00:00Z"/></event>'
    body = f'<log><trace><string key="concept:name" value="c1"/>{ev("A", "complete")}{ev("B", "start")}</trace><trace><string key="concept:name" value="c2"/>{ev("A", "COMPLETE")}</trace></log>'
    with gzip.open(tmp_path / "log.xes.gz", "wt") as f:
        f.write(body)
    assert [(r.case_id, r.activity) for r in xes.read(spark, str(tmp_path / "log.xes.gz")).orderBy("case_id").collect()] == [("c1", "A"), ("c2", "A")]
    assert xes.read(spark, str(tmp_path / "log.xes.gz"), None).count() == 3


def test_answers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"answers": [{"claim": "c-1", "answer": "confirmed"}, {"claim": "c-1", "answer": "disputed"}, {"claim": "c-2", "answer": "eh"}, {"answer": "confirmed"}]}))
    assert [tuple(r) for r in answers.read(spark, str(tmp_path / "a.json")).collect()] == [("c-1", "disputed")]
    (tmp_path / "b.json").write_text("{nonsense")
    with pytest.raises(Exception):
        answers.read(spark, str(tmp_path / "b.json")).collect()
