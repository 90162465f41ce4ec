"""Queries over export files: tables written in each export format, then scanned.

Every query writes whole tables to the shared folder in the format of one source and reads them
through that source's scan, so the scan's splitting, decoding and lookups work on many files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweft.catalog.registry import query
from orgweft.catalog.views import BASE, Views
from orgweft.session import shared_folder
from orgweft.sources import chat, commits, mail, tickets


def _written(v: Views, lines: DataFrame, name: str, *, separator: str = "\n") -> str:
    """One text record per row; each record is followed by the separator."""
    path = shared_folder(v.spark, name)
    lines.write.option("lineSep", separator).text(path)
    return path


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])


# --- chat -------------------------------------------------------------------


@query(
    "chat_export",
    r"""SELECT 'channel=' || id AS id, t AS occurred_at_epoch, author AS author_id, 'channel=' || parent AS thread_parent_id,
               (SELECT p.author FROM chat p WHERE p.id = c.parent) AS parent_author_id, m AS module,
               (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '<@([^>|]+)', 1)) AS x)) AS mentions, text
        FROM chat c""",
)
def chat_export(v: Views) -> DataFrame:
    """One folder per channel, one JSON array a day; messages without a user are left out."""
    message = F.struct("user", "ts", "thread_ts", "text")
    robot = F.struct(
        F.lit(None).cast("string").alias("user"), "ts", F.lit(None).cast("string").alias("thread_ts"), F.lit("x").alias("text")
    )
    days = v.messages.groupBy("channel").agg(
        F.to_json(F.concat(F.collect_list(message), F.array(F.min(robot)))).alias("value")
    )
    folder = shared_folder(v.spark, "chat_export")
    named = _text("channel=", F.coalesce("channel", F.lit("__HIVE_DEFAULT_PARTITION__")))
    chat.write_chat_days(days.select(named.alias("channel"), "value"), folder)
    modules = v.channel_modules.withColumn("channel", F.concat(F.lit("channel="), "channel"))
    found = chat.slack_export_rows(v.spark, folder, modules)
    return found.select(
        "id",
        "occurred_at_epoch",
        "author_id",
        "thread_parent_id",
        "parent_author_id",
        F.get("module_keys", F.lit(0)).alias("module"),
        F.array_join(F.array_sort("mentions"), ",").alias("mentions"),
        "text",
    )


# --- mail -------------------------------------------------------------------

_TURN = """turns AS (
    SELECT conv_id, turn, text, 'm' || conv_id || '-' || turn || '@x.org' AS id, '9' || ((conv_id * 7 + turn) % n) || '@x.org' AS author,
           '9' || (conv_id % n) || '@x.org' AS other, CASE WHEN turn > 0 THEN 'm' || conv_id || '-' || (turn - 1) || '@x.org' END AS parent
    FROM conversations, n)"""


@query(
    "mail_export",
    f"""WITH {_TURN}
        SELECT id, {BASE} + conv_id * 86400 + turn * 3600 AS occurred_at_epoch, author AS from_id,
               CASE WHEN other = author THEN author ELSE least(other, author) || ',' || greatest(other, author) END AS to_ids,
               parent AS in_reply_to_id, (SELECT CASE WHEN p.turn % 5 = 4 THEN 'robot@x.org' ELSE p.author END FROM turns p WHERE p.id = t.parent) AS parent_author_id,
               '=?utf-8?q?turn_' || turn || '_=C3=A9?=' AS subject, 'brand-' || (1 + conv_id % 25) AS module,
               sha256(regexp_replace(replace(chr(10) || text, chr(10) || 'From ', chr(10) || '>From '), '^\\s+|\\s+$', '', 'g')) AS body
        FROM turns t WHERE turn % 5 <> 4""",
)
def mail_export(v: Views) -> DataFrame:
    """Conversations as mailboxes: an ignored list, skipped robots, undated mail.

    Subjects and escaped lines stay as sent.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    address = lambda number: _text("9", (number % v.supplier_count).cast("string"), "@x.org")
    name = lambda place: _text("m", conv.cast("string"), "-", place.cast("string"), "@x.org")
    sent = F.date_format(
        F.timestamp_seconds(F.lit(BASE) + conv * 86400 + turn * 3600), "EEE, dd MMM yyyy HH:mm:ss"
    )
    robot = turn % 5 == 4
    mails = v.table("conversations").select(
        _text(
            "robot Mon Jan  1 00:00:00 2024\nMessage-ID: <",
            name(turn),
            "> \nFrom: Zed ",
            F.when(robot, F.lit("<Robot@x.org>")).otherwise(_text("<", address(conv * 7 + turn), ">")),
            "\nTo: List <LIST@x.org>, ",
            address(conv),
            "\nCc: ",
            F.when(robot, F.lit("list@x.org")).otherwise(address(conv * 7 + turn)),
            "\nDate: ",
            sent,
            F.when(turn % 2 == 0, F.lit(" +0000")).otherwise(F.lit("")),
            F.when(turn > 0, _text("\nIn-Reply-To: <", name(turn - 1), ">")).otherwise(F.lit("")),
            "\nSubject: =?utf-8?q?turn_",
            turn.cast("string"),
            "_=C3=A9?=\nContent-Type: text/plain; charset=utf-8\n\n",
            F.regexp_replace("text", "(?m)^From ", ">From "),
            "\n",
        ).alias("value")
    )
    undated = v.table("conversations").where("turn = 0").select(
        _text("x\nMessage-ID: <undated", conv.cast("string"), "@x.org>\nFrom: a@x.org\nTo: b@x.org\n\nno date").alias("value")
    )
    path = _written(v, mails.unionByName(undated), "mail_export", separator="\nFrom ")
    one = lambda text: v.spark.createDataFrame([(text,)], "address STRING")
    found = mail.mbox_rows(
        v.spark,
        path,
        message_modules=v.table("conversations").select(
            name(turn).alias("message_id"), _text("brand-", (1 + conv % 25).cast("string")).alias("module")
        ),
        ignore_addresses=one("list@x.org"),
        skip_senders=one("robot@x.org"),
    )
    return found.select(
        "id",
        "occurred_at_epoch",
        "from_id",
        F.array_join("to_ids", ",").alias("to_ids"),
        "in_reply_to_id",
        "parent_author_id",
        "subject",
        F.get("module_keys", F.lit(0)).alias("module"),
        F.sha2(F.col("body").cast("binary"), 256).alias("body"),
    )


# --- tickets, issues, wiki pages --------------------------------------------


def _csv(v: Views, table: DataFrame, name: str) -> str:
    path = shared_folder(v.spark, name)
    table.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return path


@query(
    "ticket_export",
    f"""SELECT 'P-' || page_id AS id, {BASE} + page_id * 60 AS occurred_at_epoch, 'u' || (page_id % 7) AS reporter_id,
               trim(url) AS title, sha256(html) AS body,
               CASE WHEN page_id % 25 = page_id % 10 THEN 'brand-' || (1 + page_id % 25)
                    ELSE least('brand-' || (1 + page_id % 25), 'brand-' || (1 + page_id % 10)) || ',' || greatest('brand-' || (1 + page_id % 25), 'brand-' || (1 + page_id % 10)) END AS modules
        FROM pages""",
)
def ticket_export(v: Views) -> DataFrame:
    """Pages as a ticket table: two date formats, whole pages as descriptions, repeated components."""
    page = F.col("page_id")
    moment = F.timestamp_seconds(F.lit(BASE) + page * 60)
    brand = lambda count: _text("brand-", (1 + page % count).cast("string"))
    table = v.table("pages").select(
        _text("P-", page.cast("string")).alias("Issue key"),
        F.when(page % 2 == 0, F.date_format(moment, "dd/MMM/yy hh:mm a"))
        .otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("Created"),
        _text("u", (page % 7).cast("string")).alias("Reporter"),
        F.col("url").alias("Summary"),
        F.col("html").alias("Description"),
        _text(brand(25), "; ", brand(10)).alias("Component/s"),
    )
    found = tickets.jira_csv_rows(v.spark, _csv(v, table, "ticket_export"))
    return found.select(
        "id",
        "occurred_at_epoch",
        "reporter_id",
        "title",
        F.sha2(F.col("body").cast("binary"), 256).alias("body"),
        F.array_join("module_keys", ",").alias("modules"),
    )


@query(
    "issue_export",
    f"""SELECT 'github-issue-' || page_id AS id, {BASE} + page_id * 60 AS occurred_at_epoch, 'u' || (page_id % 7) AS reporter_id,
               trim(url) AS title, CASE WHEN page_id % 3 = 0 THEN 'brand-1,repo' ELSE 'repo' END AS modules
        FROM pages WHERE page_id % 10 < 8""",
)
def issue_export(v: Views) -> DataFrame:
    """Pages as an issue table; some lack a user or have no readable date."""
    page = F.col("page_id")
    moment = F.timestamp_seconds(F.lit(BASE) + page * 60)
    table = v.table("pages").select(
        page.cast("string").alias("number"),
        F.col("url").alias("title"),
        F.col("html").alias("body"),
        F.when(page % 10 == 8, F.lit("soon")).otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("created_at"),
        F.when(page % 10 != 9, _text("u", (page % 7).cast("string"))).alias("user"),
        F.when(page % 3 == 0, F.lit("one; other")).otherwise(F.lit("other")).alias("labels"),
    )
    labels = v.spark.createDataFrame([("one", "brand-1")], "label STRING, module STRING")
    path = _csv(v, table, "issue_export")
    found = tickets.github_csv_rows(v.spark, path, repo_module="repo", label_modules=labels)
    return found.select(
        "id", "occurred_at_epoch", "reporter_id", "title", F.array_join("module_keys", ",").alias("modules")
    )


@query(
    "wiki_export",
    f"""SELECT CAST(page_id AS VARCHAR) AS id, {BASE} + page_id * 60 AS occurred_at_epoch, 'u' || (page_id % 7) AS reporter_id,
               CASE WHEN page_id % 4 < 2 THEN trim(url) END AS title, CASE WHEN page_id % 4 = 2 THEN trim(url) END AS body,
               CASE WHEN page_id % 4 = 0 THEN 'web' ELSE '' END AS modules
        FROM pages WHERE page_id % 4 < 3""",
)
def wiki_export(v: Views) -> DataFrame:
    """Pages as wiki objects: pages with and without a known space, comments, other objects."""
    page = F.col("page_id")
    moment = F.date_format(F.timestamp_seconds(F.lit(BASE) + page * 60), "yyyy-MM-dd HH:mm:ss.0")
    prop = lambda name, value: F.struct(value.alias("_VALUE"), F.lit(name).alias("_name"))
    objects = v.table("pages").select(
        F.element_at(F.array(*map(F.lit, ("Page", "Page", "Comment", "Attachment"))), (page % 4 + 1).cast("int")).alias("_class"),
        page.cast("string").alias("id"),
        F.array(
            prop("title", F.col("url")),
            prop("creatorName", _text("u", (page % 7).cast("string"))),
            prop("creationDate", moment),
            prop("space", F.when(page % 4 == 0, F.lit("ENG")).otherwise(F.lit("OTHER"))),
        ).alias("property"),
    )
    path = shared_folder(v.spark, "wiki_export")
    objects.write.format("xml").option("rowTag", "object").option("rootTag", "hibernate-generic").save(path)
    spaces = v.spark.createDataFrame([("ENG", "web")], "space STRING, module STRING")
    found = tickets.confluence_xml_rows(v.spark, path, spaces)
    return found.select(
        "id", "occurred_at_epoch", "reporter_id", "title", "body", F.array_join("module_keys", ",").alias("modules")
    )


# --- commits ----------------------------------------------------------------


@query(
    "commit_export",
    f"""WITH touched AS (SELECT DISTINCT l_orderkey, 'brand-' || substr(p_brand, 7) AS m FROM lineitem JOIN part ON p_partkey = l_partkey)
        SELECT 'o' || o_orderkey AS sha, {BASE} + o_orderkey AS occurred_at_epoch, 'c' || o_custkey || '@x.org' AS author_id,
               o_orderpriority AS message, (SELECT string_agg(m, ',' ORDER BY m) FROM touched WHERE l_orderkey = o_orderkey) AS modules,
               CASE WHEN o_orderkey % 3 = 0 THEN 'core,web' END AS dependencies
        FROM orders""",
)
def commit_export(v: Views) -> DataFrame:
    """Orders as a commit log: their parts are the paths, some have a trailer."""
    part = v.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    paths = (
        v.table("lineitem")
        .join(part, "l_partkey")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.array_join(
                F.collect_list(_text("src/", F.lower("p_brand"), "/part", F.col("l_partkey").cast("string"), ".py")), "\n"
            ).alias("paths")
        )
    )
    key = F.col("o_orderkey")
    blocks = v.table("orders").join(paths, "o_orderkey", "left").select(
        _text(
            "o",
            key.cast("string"),
            commits.FIELD_SEPARATOR,
            (F.lit(BASE) + key).cast("string"),
            commits.FIELD_SEPARATOR,
            "C",
            F.col("o_custkey").cast("string"),
            "@X.org",
            commits.FIELD_SEPARATOR,
            F.col("o_orderpriority"),
            commits.FIELD_SEPARATOR,
            "a longer body\n",
            F.when(key % 3 == 0, F.lit("\nDepends-On: module:core, web\n")).otherwise(F.lit("")),
            "\n",
            F.coalesce("paths", F.lit("")),
            "\n",
        ).alias("value")
    )
    path = _written(v, blocks, "commit_export", separator=commits.RECORD_SEPARATOR)
    prefixes = v.table("part").select(
        _text("src/", F.lower("p_brand"), "/").alias("prefix"),
        _text("brand-", F.substring("p_brand", 7, 9)).alias("module"),
    ).distinct()
    found = commits.git_log_rows(v.spark, path, prefixes)
    listed = lambda name: F.nullif(F.array_join(F.array_sort(name), ","), F.lit(""))
    return found.select(
        "sha",
        "occurred_at_epoch",
        "author_id",
        "message",
        listed("module_keys").alias("modules"),
        listed("dependency_keys").alias("dependencies"),
    )
