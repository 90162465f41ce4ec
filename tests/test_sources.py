from __future__ import annotations

import json

import pytest

from orgweft.operators import canonicalize as C
from orgweft.operators import normalize as N
from orgweft.sources import chat, commits, mail, records, tickets, workspace


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_chat_export_keeps_missing_parents(spark, tmp_path):
    folder = tmp_path / "general"
    folder.mkdir()
    (folder / "2025-01-01.json").write_text(
        json.dumps(
            [
                {"user": "U1", "ts": "1700000000.000100", "text": "hi <@U2> <@U3|bob> <@U2>"},
                {"user": "U2", "ts": "1700000010.000200", "thread_ts": "1700000000.000100", "text": "re"},
                {"user": "U2", "ts": "1700000020.000300", "thread_ts": "1600000000.000100"},
                {"subtype": "bot", "ts": "1700000030.000300", "text": "no user"},
            ]
        )
    )
    modules = spark.createDataFrame([("general", "api")], "channel STRING, module STRING")
    found = chat.slack_export_rows(spark, str(tmp_path), modules)
    got = {r["id"]: r for r in found.collect()}
    assert len(got) == 3
    first = got["general-1700000000.000100"]
    assert first["mentions"] == ["U2", "U3"] and first["module_keys"] == ["api"]
    assert first["occurred_at_epoch"] == 1700000000 and first["thread_parent_id"] is None
    reply = got["general-1700000010.000200"]
    assert reply["thread_parent_id"] == "general-1700000000.000100"
    assert reply["parent_author_id"] == "U1"
    lost = got["general-1700000020.000300"]
    assert lost["thread_parent_id"] == "general-1600000000.000100" and lost["parent_author_id"] is None


MBOX = """From a@x Mon Jan  1 00:00:00 2024
Message-ID: <m1@x>
Date: Mon, 01 Jan 2024 10:00:00 +0200
From: Zed <z@x.org>, Ann <Ann@x.org>
To: dev@list.org, Bob <bob@x.org>
Subject: hello

body one
From b@x Mon Jan  1 00:00:00 2024
Message-ID: <m2@x>
Date: Mon, 01 Jan 2024 10:00:00
From: bob@x.org
In-Reply-To: <m1@x>
To: dev@list.org

answer
From c@x Mon Jan  1 00:00:00 2024
Date: Mon, 01 Jan 2024 11:00:00 +0000
From: bot@x.org
To: bob@x.org

skipped
From d@x Mon Jan  1 00:00:00 2024
Date: Mon, 01 Jan 2024 12:00:00 +0000
From: cy@x.org
Cc: bob@x.org

no id
From e@x Mon Jan  1 00:00:00 2024
Message-ID: <m5@x>
From: cy@x.org
To: bob@x.org

no date
"""


def test_mailbox(spark, tmp_path):
    path = tmp_path / "dev.mbox"
    path.write_text(MBOX)
    listed = spark.createDataFrame([("DEV@list.org",)], "address STRING")
    bots = spark.createDataFrame([("bot@x.org",)], "address STRING")
    found = mail.mbox_rows(spark, str(path), ignore_addresses=listed, skip_senders=bots)
    got = {r["id"]: r for r in found.collect()}
    assert set(got) == {"m1@x", "m2@x", "dev.mbox:3"}
    one = got["m1@x"]
    assert one["from_id"] == "ann@x.org" and one["to_ids"] == ["bob@x.org"]
    assert one["occurred_at_epoch"] == 1704096000 and one["body"] == "body one"
    two = got["m2@x"]
    assert two["in_reply_to_id"] == "m1@x" and two["parent_author_id"] == "ann@x.org"
    assert two["to_ids"] == [] and two["occurred_at_epoch"] == 1704103200


def test_mailboxes_of_one_name(spark, tmp_path):
    mail_of = "From x\nFrom: {}@x.org\nTo: {}@y.org, list@z.org\nDate: Mon, 01 Jan 2024 08:00:00 +0000\n\nhi\n"
    for folder, one, two in (("a", "ann", "bob"), ("b", "cid", "dan")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "2025-01.mbox").write_text(mail_of.format(one, two))
    listed = spark.createDataFrame([("list@z.org",)], "address STRING")
    paths = [str(tmp_path / folder / "2025-01.mbox") for folder in "ab"]
    found = mail.mbox_rows(spark, paths, ignore_addresses=listed).collect()
    assert sorted((r["from_id"], r["to_ids"]) for r in found) == [
        ("ann@x.org", ["bob@y.org"]),
        ("cid@x.org", ["dan@y.org"]),
    ]


def test_dependencies_of_several_modules_keep_apart(spark):
    commit = spark.createDataFrame(
        [("s", 5, "ann", "m", ["a", "b"], ["z"])],
        "sha STRING, occurred_at_epoch BIGINT, author_id STRING, message STRING, module_keys ARRAY<STRING>, dependency_keys ARRAY<STRING>",
    )
    kept = C.deduplicate(N.dependency_records(commit)).collect()
    assert sorted(r["subjects"] for r in kept) == [["module:a", "module:z"], ["module:b", "module:z"]]


def test_jira_csv(spark, tmp_path):
    path = tmp_path / "j.csv"
    path.write_text(
        "Issue key,Created,Reporter,Summary,Component/s,Component/s\n"
        'A-1,30/Jun/25 11:47 PM,ann,"two\nlines",api,core;web\n'
        ",,,,,\n"
        "A-2,2025-06-30T23:47:00Z,bob,,,api\n"
    )
    got = rows(tickets.jira_csv_rows(spark, str(path)), "id")
    assert got[0][:4] == ("A-1", 1751327220, "ann", "two\nlines")
    assert got[0][5] == ["api", "core", "web"]
    assert got[1][:3] == ("A-2", 1751327220, "bob") and got[1][5] == ["api"]
    bad = tmp_path / "bad.csv"
    bad.write_text("key,created,reporter\nA-1,,x\n")
    with pytest.raises(Exception, match="required"):
        tickets.jira_csv_rows(spark, str(bad)).collect()


def test_issue_csv(spark, tmp_path):
    path = tmp_path / "i.csv"
    path.write_text(
        "number,title,body,created_at,user,labels\n"
        "7,T,B,2025-01-10T09:15:00Z,ann,pay; other\n"
        "8,T,B,not a date,ann,\n"
        "9,T,B,2025-01-10,,\n"
    )
    labels = spark.createDataFrame([("pay", "payments")], "label STRING, module STRING")
    got = rows(tickets.github_csv_rows(spark, str(path), repo_module="repo", label_modules=labels), "id")
    assert got == [("github-issue-7", 1736500500, "ann", "T", "B", ["payments", "repo"])]


def test_wiki_xml(spark, tmp_path):
    path = tmp_path / "entities.xml"
    path.write_text(
        """<hibernate-generic>
<object class="Page"><id name="id">1</id><property name="title">Plan</property>
<property name="creatorName">ann</property><property name="creationDate">2025-01-10 09:15:00.0</property>
<property name="space">ENG</property></object>
<object class="Comment"><id name="id">2</id><property name="title">nice</property>
<property name="creatorName">bob</property><property name="creationDate">2025-01-10 09:16:00.0</property></object>
<object class="Page"><id name="id">3</id><property name="title">lost</property></object>
<object class="Other"><id name="id">4</id></object>
</hibernate-generic>"""
    )
    spaces = spark.createDataFrame([("ENG", "web"), ("ENG", "api")], "space STRING, module STRING")
    got = rows(tickets.confluence_xml_rows(spark, str(path), spaces), "id")
    assert got == [
        ("1", 1736500500, "ann", "Plan", None, ["api", "web"]),
        ("2", 1736500560, "bob", None, "nice", []),
    ]


def test_commit_log(spark, tmp_path):
    path = tmp_path / "log"
    path.write_text(
        "\x1eabc\x1f1700000000\x1fAnn@X.org\x1fsubject\x1fbody\n\nDepends-On: module:core, web\n"
        "src/api/a.py\nREADME.md\n\x1edef\x1f1700000001\x1fbob@x.org\x1fother\x1f\nsrc/apix/b.py\n"
    )
    prefixes = spark.createDataFrame([("src/api/", "api"), ("src", "all")], "prefix STRING, module STRING")
    got = rows(commits.git_log_rows(spark, str(path), prefixes), "sha")
    assert got[0] == ("abc", 1700000000, "ann@x.org", "subject", ["all", "api"], ["core", "web"])
    assert got[1][4] == ["all"] and got[1][5] == []
    legacy = tmp_path / "legacy"
    legacy.write_text("s1\x1f1\x1fa@x\x1fm\nsrc/api/x\n\ns2\x1f2\x1fb@x\x1fm\ndocs/x\n")
    got = rows(commits.git_log_rows(spark, str(legacy), prefixes), "sha")
    assert [(r[0], r[4]) for r in got] == [("s1", ["all", "api"]), ("s2", [])]


def test_workspace_dump(spark, tmp_path):
    (tmp_path / "employee.json").write_text(
        json.dumps(
            {
                "eid_00000001": {"name": "Ann", "role": "VP of Engineering", "location": "X", "org": "o"},
                "eid_00000002": {"name": "Bob", "role": "Senior Software Engineer", "org": "o"},
                "eid_00000003": {"name": "Cy", "role": "Clerk", "org": "o"},
            }
        )
    )
    (tmp_path / "team.json").write_text(
        json.dumps(
            [
                {
                    "employee_id": "eid_00000001",
                    "engineering_leads": [{"employee_id": "eid_00000009", "engineers": [{"employee_id": "eid_00000002"}]}],
                    "product_managers": [{"employee_id": "eid_00000002"}, {"employee_id": "eid_00000003"}],
                }
            ]
        )
    )
    (tmp_path / "Pay_Core.json").write_text(
        json.dumps(
            {
                "slack": [
                    {"id": "1", "Message": {"User": {"userId": "eid_00000001", "text": "@eid_00000002 @eid_00000001", "timestamp": "2025-01-10T09:15:00"}}},
                    {"id": "2", "Message": {"User": {"userId": "bot", "text": "x", "timestamp": "2025-01-10"}}},
                ],
                "prs": [
                    {"id": "p1", "title": "T", "created_at": "2025-01-10", "user": {"login": "EMP_1"},
                     "reviews": [{"user": {"login": "EMP_2"}, "comment": "ok", "submitted_at": ""}]}
                ],
                "documents": [{"id": "d", "author": "eid_00000003", "date": "2025-01-10 09:15:00", "type": "PRD"}],
            }
        )
    )
    products = workspace.read_products(spark, str(tmp_path / "Pay_Core.json"))
    got = products.select("product").collect()
    assert [r[0] for r in got] == ["Pay_Core"]
    people = workspace.directory_records(
        spark, str(tmp_path / "employee.json"), str(tmp_path / "team.json"), products
    )
    meta = {r["external_id"]: r["meta"] for r in people.collect()}
    assert meta["eid_00000001"]["role_rank"] == 6 and meta["eid_00000001"]["team_key"] == "team:eid_00000001"
    assert meta["eid_00000002"]["role_rank"] == 1 and meta["eid_00000002"]["team_key"] == "team:eid_00000009"
    assert meta["eid_00000003"]["role_rank"] == 0 and meta["eid_00000003"]["team_key"] == "team:eid_00000001"
    assert meta["pay-core"]["canonical_key"] == "module:pay-core"
    talk = workspace.product_chat_rows(products).collect()
    assert len(talk) == 1 and talk[0]["mentions"] == ["eid_00000002"]
    assert workspace.product_commit_rows(products).first()["sha"] == "herb:Pay_Core:pr:p1"
    review = workspace.product_review_rows(products).first()
    assert review["thread_parent_id"] == "artifact:git:herb:Pay_Core:pr:p1"
    assert review["occurred_at_epoch"] == 1736467200 and review["parent_author_id"] == "EMP_1"
    assert workspace.product_document_rows(products).first()["title"] == "PRD"


def test_record_files_are_strict(spark, tmp_path):
    record = {
        "source": "s", "external_id": "e", "kind": "communication_aggregate", "occurred_at_epoch": 1,
        "author_external_id": None, "parent_external_id": None, "subjects": ["person:a", "person:b"],
        "content_sha256": "0" * 64, "content": None,
        "metadata": {"weight": 3, "interaction_count": "5", "authority": "x"},
    }
    (tmp_path / "r.json").write_text(json.dumps([record]))
    row = records.read_records(spark, str(tmp_path / "r.json")).first()
    assert row["meta"]["weight"] == 3 and row["meta"]["interaction_count"] is None
    assert row["metadata_json"] == '{"authority":"x","interaction_count":"5","weight":3}'
    (tmp_path / "m.json").write_text(json.dumps({"A@x": "ann"}))
    got = records.read_mapping(spark, str(tmp_path / "m.json"), "source_id", "handle").collect()
    assert [tuple(r) for r in got] == [("A@x", "ann")]


def test_roster(spark):
    person = "struct<github:string,name:string>"
    groups = spark.createDataFrame(
        [
            ("sig", 0, "sig-net", "Net", ([("Ann", "Ann A"), ("bob", "")], [("Cy", "Cy C")])),
            ("committee", 1, "committee-steer", "Steering", ([("bob", "Bob B")], [])),
        ],
        f"kind STRING, place BIGINT, dir STRING, name STRING, leadership STRUCT<chairs: ARRAY<{person}>, tech_leads: ARRAY<{person}>>",
    )
    got = {r["handle"]: r for r in records.roster_people(groups).collect()}
    assert got["bob"]["role_rank"] == 5 and got["bob"]["title"] == "Steering chair"
    assert got["bob"]["team_key"] == "team:net" and got["bob"]["manager"] is None
    assert got["cy"]["role_rank"] == 3 and got["cy"]["manager"] == "ann"


def test_commit_records_pairs(spark):
    commit = spark.createDataFrame(
        [("s", 5, "ann", "m", ["b", "a", "c", "a"], ["z"])],
        "sha STRING, occurred_at_epoch BIGINT, author_id STRING, message STRING, module_keys ARRAY<STRING>, dependency_keys ARRAY<STRING>",
    )
    got = N.code_records(commit).collect()
    pairs = sorted(tuple(r["subjects"]) for r in got if r["kind"] == "cochange")
    assert pairs == [("module:a", "module:b"), ("module:a", "module:c"), ("module:b", "module:c")]
    assert sum(r["kind"] == "dependency" for r in got) == 3
