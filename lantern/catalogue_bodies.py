"""Queries on bodies: each composes messages whose parts are known by construction, and the SQL counts what was put in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lantern.adapters import messages, table
from lantern.functions import body
from lantern.registry import query

FORWARD, FIELDS = "---------- Forwarded message ----------\n", "From: Ann <ann@x.example>\nSubject: old\n"
ATTRIBUTION = "On Tue, 25 August 2026 at 10:14, Ann Lee <ann@x.example> wrote:"
#: What follows the own text of a message, by turn modulo 4.
TAIL_SQL = (
    "b as (select *, turn % 4 as kind, coalesce(lag(text) over (partition by conv_id order by turn), '') as prev, regexp_matches(text, '\\S') as said from conversations), "
    "m as (select conv_id || '-' || turn as message_id, kind, said, text, prev, length(text) as own, len(string_split(text, chr(10))) as own_lines, length(prev) as old, len(string_split(prev, chr(10))) as old_lines from b)"
)


def bodies(spark, d) -> DataFrame:
    """message_id, text: signed, replying below a mark, forwarding, or with a sign-off."""
    m = messages(spark, d)
    prev = F.coalesce(F.lag("text").over(W.partitionBy("thread_id").orderBy("position")), F.lit(""))
    tail = (
        F.when(F.col("position") % 4 == 0, "\n-- \nAnn Lee\n+1 555 0100")
        .when(F.col("position") % 4 == 1, F.concat(F.lit(f"\n\n{ATTRIBUTION}\n> "), F.replace(prev, F.lit("\n"), F.lit("\n> "))))
        .when(F.col("position") % 4 == 2, F.concat(F.lit(f"\n\n{FORWARD}{FIELDS}\n"), prev))
        .otherwise("\n\nThanks,\nAnn")
    )
    return m.select("message_id", F.concat("text", tail).alias("text"))


@query(
    f"with {TAIL_SQL}, c as ("
    "select 'original' as class, case kind when 0 then own_lines + if(said, 0, 3) when 3 then own_lines + if(said, 1, 3) else own_lines + 1 end as l, case kind when 0 then own + 1 + if(said, 0, 23) when 3 then own + 2 + if(said, 0, 11) else own + 2 end as c from m "
    "union all select 'signature', if(kind = 0, 3, 2), if(kind = 0, 23, 11) from m where kind in (0, 3) and said "
    f"union all select 'quoted', 1 + old_lines, {len(ATTRIBUTION) + 1} + old + 2 * old_lines from m where kind = 1 "
    f"union all select 'quoted', 2, {len(FIELDS)} from m where kind = 2 union all select 'forwarded', 1, {len(FORWARD)} from m where kind = 2 "
    "union all select 'uncertain', 1 + old_lines, 1 + old from m where kind = 2) "
    "select class, sum(l)::bigint as n_lines, sum(c)::bigint as chars from c group by class"
)
def body_line_classes(spark, d):
    return body.class_chars(body.lines(bodies(spark, d)))


@query(
    f"with {TAIL_SQL} select message_id, md5(text || chr(10) || case kind when 0 then if(said, '', '-- ' || chr(10) || 'Ann Lee' || chr(10) || '+1 555 0100') when 3 then chr(10) || if(said, '', 'Thanks,' || chr(10) || 'Ann') else chr(10) end) as view, "
    f"(case kind when 0 then if(said, 23, 0) when 1 then {len(ATTRIBUTION) + 1} + old + 2 * old_lines when 2 then {len(FORWARD) + len(FIELDS) + 1} + old else if(said, 11, 0) end)::bigint as hidden from m"
)
def body_default_view(spark, d):
    return body.views(body.lines(bodies(spark, d))).select("message_id", F.md5("view").alias("view"), F.col("hidden").cast("bigint"))


@query(
    f"with {TAIL_SQL} select message_id, (case kind when 0 then if(said, 2, 1) when 1 then 3 when 2 then 4 else if(said, 2, 1) end)::bigint as n, "
    f"(own + case kind when 0 then 24 when 1 then {len(ATTRIBUTION) + 3} + old + 2 * old_lines when 2 then {len(FORWARD) + len(FIELDS) + 3} + old else 13 end)::bigint as chars from m"
)
def body_spans(spark, d):
    s = body.spans(body.lines(bodies(spark, d)))
    return s.groupBy("message_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).cast("bigint").alias("chars"))


@query(
    "select conv_id, turn, case turn % 4 when 0 then 'lead_in_date_address_verb' when 1 then 'lead_in_date_verb_sender_address' when 2 then 'display_name_address_verb' end as format, turn % 4 = 3 or turn % 4 < 3 as shaped from conversations"
)
def attribution_formats(spark, d):
    line = (
        F.when(F.col("position") % 4 == 0, F.concat(F.lit("Le mar. 3 mars 2026, "), "sender", F.lit(" <a@x.example> a écrit :")))
        .when(F.col("position") % 4 == 1, "Am Mo., 02.03.2026 schrieb Eva Kurz <eva@x.example>:")
        .when(F.col("position") % 4 == 2, "Ann Lee <ann@x.example> wrote:")
        .otherwise("On 25 August 2026 I told ann@x.example what Bob wrote:")
    )
    m = messages(spark, d)
    return m.select(F.col("thread_id").alias("conv_id"), F.col("position").alias("turn"), body.attribution(line).alias("format"), (body.looks_quoted(line) | line.endswith(":")).alias("shaped"))


@query(
    "select doc_id, case when text is null then null when doc_id % 3 = 1 and strlen(text) = length(text) then 'ascii' else 'utf-8' end as charset, "
    "case when text is not null then doc_id % 3 <> 2 end as known, case when text is not null then doc_id % 3 = 1 and strlen(text) <> length(text) end as fell_back, md5(text) as text from documents"
)
def charset_ladder(spark, d):
    docs = table(spark, d, "documents")
    declared = F.when(F.col("doc_id") % 3 == 0, "UTF-8").when(F.col("doc_id") % 3 == 1, '"ascii"').otherwise("no-such-charset")
    return docs.select("doc_id", body.decode_text(F.encode("text", "UTF-8"), declared).alias("t")).select("doc_id", "t.charset", "t.known", "t.fell_back", F.md5("t.text").alias("text"))


@query(
    "select doc_id, case when text is null then null when doc_id % 4 <> 0 and regexp_matches(text, '\\S') then 'text/plain' else 'text/html' end as mime, "
    "(case when text is not null and doc_id % 4 <> 0 and regexp_matches(text, '\\S') then 1 else 0 end)::bigint as unused, (doc_id % 3 = 0)::bigint as attachments from documents"
)
def mime_bodies(spark, d):
    docs = table(spark, d, "documents")

    def part(pid, parent, place, kind, data, filename=None):
        fields = {"part_id": F.lit(pid), "parent_id": F.lit(parent).cast("string"), "place": F.lit(place), "mime_type": F.lit(kind), "filename": F.lit(filename).cast("string"), "attachment_id": F.lit(filename).cast("string"), "size": F.lit(0).cast("long"), "data": data}
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    nothing = F.lit(None).cast("string")
    tree = F.array(
        part("r", None, 0, "multipart/mixed", nothing), part("0", "r", 1, "multipart/alternative; boundary=x", nothing), part("0.0", "0", 2, "text/plain; charset=utf-8", F.when(F.col("doc_id") % 4 == 0, " \n").otherwise(F.col("text"))),
        part("0.1", "0", 3, "TEXT/HTML", F.concat(F.lit("<p>"), "text")), part("1", "r", 4, "application/pdf", nothing, "a.pdf"),
    )
    parts = docs.select(F.col("doc_id").alias("message_id"), F.explode(tree).alias("p")).select("message_id", "p.*").filter("part_id <> '1' or message_id % 3 = 0")
    b = body.select_body(body.trees(parts))
    return b.select(F.col("message_id").alias("doc_id"), F.col("body.mime_type").alias("mime"), F.size("unused").cast("bigint").alias("unused"), F.size("attachments").cast("bigint").alias("attachments"))


@query("select doc_id, 'from,subject,x-id' as names, source as subject, 1::bigint as duplicates, lang as charset from documents")
def header_tables(spark, d):
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    headers = F.array(pair("From", F.col("lang")), pair("Subject", F.col("source")), pair("SUBJECT", F.lit("again")), pair("X-Id", F.col("doc_id")))
    t = table(spark, d, "documents").select("doc_id", body.header_table(headers).alias("h"), body.content_charset(F.concat(F.lit('text/plain; format=flowed; Charset="'), "lang", F.lit('"'))).alias("charset"))
    subject = F.filter("h", lambda x: x["name"] == "subject")[0]
    return t.select("doc_id", F.array_join(F.transform("h", lambda x: x["name"]), ",").alias("names"), subject["first"].alias("subject"), subject["duplicates"].cast("bigint").alias("duplicates"), "charset")
