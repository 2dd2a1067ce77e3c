"""Queries on searches over whole tables: many queries at once, paging, recency, sources and what they may show."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lantern.adapters import cut, feed, messages, shared_folder, table
from lantern.catalogue_rules import answers as answers_of_documents
from lantern.operators import answers, disclosure, equivalence, expansion, identity, paging, release, rerank
from lantern.plans import batch
from lantern.registry import NOW, query
from lantern.sources import archive, connector
from lantern.streaming import cache, recency

# --- Many queries at once --------------------------------------------------------

ASKED_SQL = r"""m as (select conv_id || '-' || turn as message_id, conv_id as thread_id, turn, text, trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g')) as flat, list_distinct(regexp_extract_all(lower(text || ' ' || role), '[\p{L}\p{M}\p{N}_]+')) as words from conversations),
opening as (select thread_id, arg_min(text, turn) as text, arg_min(text, turn) filter (where turn > 0) as later from m group by thread_id),
parts as (select thread_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'), lambda x: regexp_matches(x, '^\p{L}{6,}$')) as w, regexp_extract(text, '^[^\s"]+ [^\s"]+ [^\s"]+') as three, regexp_extract(later, '^([^\s"]+) ([^\s"]+)', ['a', 'b']) as two from opening),
asked as (select *, w[1] as w1, w[2] as w2 from parts where len(w) >= 2 and w[1] <> w[2] and three <> '' and two.a <> ''),
q as (select thread_id * 5 as query_id, 0 as form, [w1, w2] as terms, null as phrase from asked union all select thread_id * 5 + 1, 1, [], three from asked union all select thread_id * 5 + 2, 2, [w1], two.a || ' ' || two.b from asked
    union all select thread_id * 5 + 3, 3, [w1, w2], null from asked union all select thread_id * 5 + 4, 4, [w1], two.b || ' ' || two.a || ' never' from asked),
unit as (select query_id, form, unnest(terms) as term, null as phrase, generate_subscripts(terms, 1) - 1 as u from q union all select query_id, form, null, lower(phrase), len(terms) from q where phrase is not null),
word as (select message_id, thread_id, unnest(words) as term from m),
met as (select query_id, form, u, message_id, thread_id from unit join word using (term) union all select query_id, form, u, message_id, thread_id from unit join m on contains(m.flat, unit.phrase)),
units as (select query_id, count(*) as n from unit group by all),
whole as (select query_id, form, message_id, thread_id from met join units using (query_id) group by query_id, form, message_id, thread_id, n having count(distinct u) = n),
n1 as (select query_id, count(*) as n1 from whole group by all),
split as (select query_id, thread_id from met join units using (query_id) where form <> 1 group by query_id, thread_id, n having count(distinct u) = n),
n1b as (select query_id, count(*) as n1b from split group by all),
n2 as (select query_id, count(*) as n2 from met where form in (2, 4) group by all),
run as (select query_id, form, coalesce(n1, 0) as n1, coalesce(n1b, 0) as n1b, coalesce(n2, 0) as n2, form = 1 and n1 between 1 and 3 as exact, form in (2, 4) and coalesce(n1, 0) + coalesce(n1b, 0) = 0 as relaxed from q left join n1 using (query_id) left join n1b using (query_id) left join n2 using (query_id))"""


def asked(spark, d) -> DataFrame:
    """Five queries from each conversation: two of its words, its first three as a phrase, a word and a phrase of a later turn, a question,
    and a word with a phrase that nobody wrote (a phrase of three words asks for an exact answer first)."""
    m = messages(spark, d)
    t = m.groupBy("thread_id").agg(F.min_by("text", "position").alias("text"), F.min_by("text", F.when(F.col("position") > 0, F.col("position"))).alias("later"))
    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(f"({batch.WORD})"), F.lit(1)), lambda x: x.rlike(r"^\p{L}{6,}$"))
    t = t.withColumn("w", w).withColumn("three", F.regexp_extract("text", r'^[^\s"]+ [^\s"]+ [^\s"]+', 0)).withColumn("two", F.regexp_extract("later", r'^[^\s"]+ [^\s"]+', 0))
    t = t.filter((F.size("w") >= 2) & (F.col("w")[0] != F.col("w")[1]) & (F.col("three") != "") & (F.col("two") != ""))
    quoted, w1, w2 = lambda c: F.concat(F.lit('"'), c, F.lit('"')), F.col("w")[0], F.col("w")[1]
    back = F.concat(F.substring_index("two", " ", -1), F.lit(" "), F.substring_index("two", " ", 1), F.lit(" never"))
    forms = [F.concat_ws(" ", w1, w2), quoted("three"), F.concat_ws(" ", w1, quoted("two")), F.concat_ws(" ", F.lit("when did"), w1, w2), F.concat_ws(" ", w1, quoted(back))]
    each = t.select("thread_id", F.posexplode(F.array(*forms)).alias("k", "query"))
    return each.select((F.col("thread_id") * len(forms) + F.col("k")).alias("query_id"), "query")


@query(
    f"with {ASKED_SQL} select query_id, case when form = 3 then 'date_like' end as kind, case when exact then '1b' end as stopped, case when exact then 'L0' end as stopped_after, "
    "case when form = 1 then n1 + case when exact then 0 else n1 end else n1 + n1b + case when relaxed then n2 else 0 end end::bigint as evidence, "
    "case when form in (1, 4) then 'ran' else 'not_applicable' end as L0, case when exact then 'stopped_on_evidence' else 'ran' end as L1, case when form = 1 then 'not_applicable' else 'ran' end as L1b, "
    "case when form not in (2, 4) then 'not_applicable' when relaxed then 'ran' else 'stopped_on_evidence' end as L2, 'not_applicable' as L3 from run"
)
def batched_ladder(spark, d):
    return batch.run(messages(spark, d), asked(spark, d), NOW).queries


@query(
    f"with {ASKED_SQL}, terms_or_phrase as (select m.*, case when u = 0 then 'without phrase' else 'without terms' end as probe from met m join run using (query_id) where relaxed) "
    "select query_id, message_id, 'L0' as rung from whole where form = 1 union all select query_id, message_id, 'L1' from whole join run using (query_id) where not exact "
    "union all select distinct query_id, message_id, 'L1b' from met semi join split using (query_id, thread_id) anti join whole using (query_id, message_id) union all select distinct query_id, message_id, 'L2' from terms_or_phrase"
)
def batched_evidence(spark, d):
    r = batch.run(messages(spark, d), asked(spark, d), NOW).evidence
    # A message counts for the first rung that gave it, L0 and L1 by themselves, as both answer the whole query.
    first = batch.best_rung(r.filter("rung <> 'L0'"))
    return r.filter("rung = 'L0'").select("query_id", "message_id", "rung").unionByName(first)


# --- Recency ---------------------------------------------------------------------


def additions(spark, d) -> tuple[DataFrame, DataFrame]:
    """events as additions to users' mailboxes, a walk a day, and one standing query for each mailbox: what its first event was labelled,
    until a date, from whoever its last event names."""
    e = feed(spark, d)
    day = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd")
    rows = e.select(
        F.col("thread_id").alias("mailbox"), day.alias("walk"), F.lpad(F.col("history_id").cast("string"), 12, "0").alias("message_id"), "history_id", F.lit(None).cast("long").alias("oldest"),
        F.array(F.concat("event_type", F.lit("@x.example"))).alias("addresses"), "ts_us", (F.col("value") > 5).alias("has_attachment"), F.when(F.col("value") < 60, F.array(F.upper("event_type"))).alias("labels"),
    )
    first = e.groupBy("thread_id").agg(F.min_by("event_type", "history_id").alias("a"), F.max_by("event_type", "history_id").alias("b"), F.max_by("value", "history_id").alias("v"))
    asks = F.when(F.col("a") == "view", F.lit("receipt has:attachment")).when(F.col("b") == "click", F.lit("")).when(F.col("v") > 20, F.concat(F.lit("label:"), "a", F.lit(" before:2024/01/20"))).otherwise(F.concat(F.lit("from:"), "b", F.lit("@x.example total")))
    labels = {x: x.upper() for x in ("click", "error", "purchase")}  # signups have no label id that is known
    return rows, recency.facts(first.select(F.col("thread_id").alias("query_id"), asks.alias("query")), NOW, labels)


RECENT_SQL = """e as (select user_id as mailbox, strftime(ts, '%Y-%m-%d') as walk, lpad(event_id::varchar, 12, '0') as message_id, event_id as history_id, ts, event_type, value from events),
asks as (select mailbox, arg_min(event_type, history_id) as a, arg_max(event_type, history_id) as b, arg_max(value, history_id) as v from e group by mailbox),
kinds as (select *, case when a = 'view' then 'attachment' when b = 'click' then 'none' when v > 20 then 'label' else 'people' end as kind from asks),
judged as (select e.*, kind, case kind when 'attachment' then value > 5 when 'people' then event_type = b else ts < timestamp '2024-01-20' and (a = 'signup' or value >= 60 or event_type = a) end as passed,
    case kind when 'attachment' then 'has_attachment' when 'people' then 'participant' else case when ts >= timestamp '2024-01-20' or a = 'signup' or value >= 60 then 'date' else 'date, label' end end as checked,
    case kind when 'attachment' then 'has_attachment' when 'people' then 'participant' when 'label' then case when ts >= timestamp '2024-01-20' then 'date' else 'label' end end as could_fail from e join kinds using (mailbox) where kind <> 'none'),
marks as (select mailbox, walk, max(max(history_id)) over (partition by mailbox order by walk rows between unbounded preceding and 1 preceding) as since from judged group by mailbox, walk),
placed as (select *, row_number() over (partition by mailbox, walk order by message_id) as n from judged join marks using (mailbox, walk)),
told as (select *, case when since is null then 'no_watermark' when n > 8 then 'beyond_cap' when passed then 'surfaced' else 'contradicted' end as status from placed)"""


@query(
    f"with {RECENT_SQL} select mailbox, walk, message_id, status, since, case when status in ('surfaced', 'contradicted') then checked end as checked, case when status = 'contradicted' then could_fail end as failed_on, "
    "case when status = 'surfaced' then 'history.list messageAdded since ' || since || '; constraints re-checked locally: [' || checked || ']; free-text terms NOT re-checked - Gmail q did not match this message' end as reason from told"
)
def recency_rows(spark, d):
    r = recency.reconcile(*additions(spark, d))
    return r.select("mailbox", "walk", "message_id", "status", "since", F.array_join("checked", ", ").alias("checked"), "failed_on", "reason")


@query(
    f"with {RECENT_SQL} select mailbox, walk, case when bool_or(status = 'no_watermark') then 'no_watermark' else 'ran' end as state, max(since) as since, max(history_id) as latest, count(*) filter (where status <> 'no_watermark') as candidates, "
    "count(*) filter (where status in ('surfaced', 'contradicted')) as fetched, count(*) filter (where status = 'surfaced') as surfaced, case when bool_or(status = 'no_watermark') then 0 else 2 + 20 * count(*) filter (where status in ('surfaced', 'contradicted')) end as quota_units from told group by mailbox, walk"
)
def recency_accounts(spark, d):
    return recency.accounts(recency.reconcile(*additions(spark, d)))


# --- Pages -----------------------------------------------------------------------


def _pages_sql(rows: str, limit: int) -> str:
    """The fold itself, row by row: what a page holds, whether the next row starts another."""
    return (
        f"with recursive r as (select *, row_number() over (partition by view order by position) - 1 as i, count(*) over (partition by view) as total from ({rows})), "
        f"p as (select view, position, i, total, chars, chars as used, 0::bigint as page from r where i = 0 union all "
        f"select r.view, r.position, r.i, r.total, r.chars, case when p.chars > {limit} or p.used + r.chars > {limit} then r.chars else p.used + r.chars end, case when p.chars > {limit} or p.used + r.chars > {limit} then page + 1 else page end from p join r on r.view = p.view and r.i = p.i + 1)"
    )


@query(_pages_sql("select conv_id as view, turn as position, length(text) as chars from conversations", 2000) + " select view, position, chars::int as chars, page from p")
def greedy_pages(spark, d):
    m = messages(spark, d).select(F.col("thread_id").alias("view"), "position", F.length("text").alias("chars"))
    return paging.pages(m, limit=2_000).select("view", "position", "chars", "page")


@query(
    _pages_sql("select source as view, doc_id as position, greatest(length(text), 1) as chars from documents", 16000)
    + " select view, page, case when max(chars) > 16000 then 'oversized' else 'ok' end as state, min(i) as returned_from, case when max(i) + 1 < any_value(total) then max(i) + 1 end as next_cursor, case when max(chars) > 16000 then 0 else count(*) end as items from p group by view, page"
)
def page_cursors(spark, d):
    """The pages of each source's documents: where each starts, what continues it, and the rows too large for any."""
    docs = table(spark, d, "documents").select(F.col("source").alias("view"), F.col("doc_id").alias("position"), F.char_length("text").alias("chars"))
    return paging.page_table(paging.pages(docs))


# --- Sources ---------------------------------------------------------------------


@query("select event_type, user_id as thread_id, count(*)::bigint as n, sum(event_id)::bigint as ids from events where event_id >= 100 and event_type in ('click', 'error') and value < 50 and event_type <> 'error' group by all")
def source_filters(spark, d):
    """The connector carries the filters on ids and types and leaves the others to Spark."""
    archive.register(spark)
    e = spark.read.format("evidence_table").option("path", f"{d}/events.parquet").option("searchable", "event_id,event_type").load()
    e = e.filter("event_id >= 100 and event_type in ('click', 'error') and value < 50 and event_type <> 'error'")
    return e.groupBy("event_type", F.col("user_id").alias("thread_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "with last as (select max(event_id) as m from events), kept as (select * from events, last where event_id > 2 * (m // 5)) select 'change' as kind, user_id::varchar as thread_id, event_type, count(*)::bigint as n, null::bigint as lost_from, null::bigint as lost_to from kept "
    "where event_id > m // 10 group by all union all select 'resync', null, null, 1, m // 10 + 1, 2 * (m // 5) from last"
)
def expired_feed(spark, d):
    """events as a feed of segments, the older two fifths of which are gone, read from a marker that is older still."""
    archive.register(spark)
    f = feed(spark, d)
    m = f.agg(F.max("history_id")).first()[0]
    path = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    archive.write_segments(f.filter(F.col("history_id") > 2 * (m // 5)), path, m // 5).collect()
    return archive.since(spark, path, m // 10).groupBy("kind", "thread_id", "event_type", "lost_from", "lost_to").agg(F.count(F.lit(1)).alias("n"))


@query(
    "with c as (select conv_id as thread_id, conv_id || '-' || turn as message_id, turn as position, text, count(*) over (partition by conv_id) as n from conversations where conv_id in (select conv_id from conversations where turn = 5)) "
    "select thread_id, message_id, position, n, substr(text, 1, 200) as content, length(text)::bigint as chars from c"
)
def container_items(spark, d):
    """The threads that reached a fifth answer, whole, with the source's own count and each message's snippet."""
    m = messages(spark, d)
    c = connector.containers(m, m.filter("position = 5").select("thread_id"))
    return c.join(connector.items(m, c, "snippet").drop("thread_id"), "message_id").select("thread_id", "message_id", "position", "n", "content", "chars")


# --- Cache -----------------------------------------------------------------------


def cache_ops(spark, d) -> DataFrame:
    """events as operations on a cached structure of each user: a signup writes it, a view reads it, a purchase is told by the feed, and a
    click is a change that only a live check sees; the walk of a cheap view does not come to its end."""
    f = feed(spark, d)
    seen = F.max(F.when(F.col("event_type") == "click", F.col("history_id"))).over(W.partitionBy("thread_id").orderBy("history_id"))
    op = F.when(F.col("event_type") == "signup", "put").when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "change")
    x = f.select(F.col("thread_id").alias("native_id"), F.col("history_id").alias("seq"), op.alias("op"), F.lit("structure").alias("kind"), "ts_us", F.col("history_id").alias("revision"), seen.alias("seen"), F.lit(None).cast("long").alias("oldest"), (F.col("value") >= 5).alias("complete"))
    return x.filter("op is not null").withColumnRenamed("ts_us", "at_us")


CACHE_SQL = """o as (select user_id as native_id, event_id as seq, event_type, ts, value, max(event_id) filter (where event_type = 'click') over (partition by user_id order by event_id) as seen from events),
r as (select o.*, (select max(p.seq) from o p where p.native_id = o.native_id and p.seq < o.seq and p.event_type = 'signup') as put, (select max(p.seq) from o p where p.native_id = o.native_id and p.seq < o.seq and p.event_type = 'purchase') as dropped,
    (select max(p.seq) from o p where p.native_id = o.native_id and p.seq < o.seq and p.event_type in ('signup', 'view')) as swept from o),
t as (select r.*, p.ts as put_ts, s.ts as swept_ts from r left join o p on p.native_id = r.native_id and p.seq = r.put left join o s on s.native_id = r.native_id and s.seq = r.swept),
held as (select *, put is not null and not coalesce(dropped > put, false) and not (swept > put and swept_ts - put_ts >= interval 24 hour) as there from t)"""


@query(
    f"with {CACHE_SQL}, x as (select native_id, seq, put, case when not there then 'miss' when ts - put_ts >= interval 24 hour then 'expired' when coalesce(seen > put, false) or value < 5 then 'unverified' else 'hit' end as outcome, "
    "case when not there or ts - put_ts >= interval 24 hour then 'unstated' when coalesce(seen > put, false) then 'changed' when value < 5 then 'inconclusive' else 'unchanged' end as reason from held where event_type = 'view') "
    "select native_id, seq, 'structure' as kind, outcome, reason, false as rebaseline, case when outcome = 'hit' then put end as revision from x"
)
def cache_reads(spark, d):
    return cache.replay(cache_ops(spark, d))


@query(f"with {CACHE_SQL} select native_id, seq, there::bigint as entries from held where event_type = 'purchase'")
def cache_invalidations(spark, d):
    return cache.invalidated(cache_ops(spark, d))


# --- Release, identity, second tier ------------------------------------------------


def _rests_on(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as edges: each rests on its customer, read for a market segment, and on its lines' suppliers, read for their nation."""
    c, o, li, s, n = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "supplier", "nation"))
    arr = lambda *x: F.array(*[F.col(y) for y in x])
    none = F.array().cast("array<string>")
    edges = o.select(F.col("o_orderkey").alias("edge_id"), "o_orderstatus")
    by_customer = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("edge_id"), F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.lit("crm").alias("connector"), F.col("c_mktsegment").alias("principal"), arr("o_orderpriority").alias("scopes"), none.alias("capability"))
    lines = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    by_line = lines.select(F.col("l_orderkey").alias("edge_id"), F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.lit("erp").alias("connector"), F.col("n_name").alias("principal"), arr("l_returnflag").alias("scopes"), arr("l_linestatus").alias("capability"))
    crm = c.join(o, o["o_custkey"] == c["c_custkey"]).filter("c_mktsegment <> 'BUILDING' and not (c_mktsegment = 'MACHINERY' and o_orderpriority = '1-URGENT')").select(F.lit("crm").alias("connector"), F.col("c_mktsegment").alias("principal"), arr("o_orderpriority").alias("scopes"), none.alias("capability"))
    erp = lines.filter("n_regionkey < 4 and not (n_regionkey = 0 and l_linestatus = 'O')").select(F.lit("erp").alias("connector"), F.col("n_name").alias("principal"), arr("l_returnflag").alias("scopes"), arr("l_linestatus").alias("capability"))
    reach = c.filter("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("node_id")).union(s.filter("s_acctbal > -500").select(F.concat(F.lit("s"), "s_suppkey")))
    return edges, by_customer.unionByName(by_line), crm.unionByName(erp).distinct(), reach


RELEASE_SQL = """refs as (select o_orderkey as edge_id, 'c' || c_custkey as node_id, 'crm' as connector, c_mktsegment as principal, c_mktsegment <> 'BUILDING' and not (c_mktsegment = 'MACHINERY' and o_orderpriority = '1-URGENT') as may, c_acctbal > 0 as reach from orders join customer on o_custkey = c_custkey
    union all select l_orderkey, 's' || s_suppkey, 'erp', n_name, n_regionkey < 4 and not (n_regionkey = 0 and l_linestatus = 'O'), s_acctbal > -500 from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
judged as (select o_orderkey as edge_id, o_orderstatus, coalesce(min(connector || '/' || principal) filter (where not may), min(node_id) filter (where not reach), case when count(node_id) = 0 then 'none' end) as refused_by from orders left join refs on edge_id = o_orderkey group by all)"""


@query(f"with {RELEASE_SQL} select edge_id, o_orderstatus, refused_by is null as granted, refused_by from judged")
def released_edges(spark, d):
    return release.release(*_rests_on(spark, d))


@query(f"with {RELEASE_SQL} select connector, count(distinct edge_id)::bigint as n from refs where edge_id in (select edge_id from judged where refused_by is not null) group by connector")
def withheld_by_connector(spark, d):
    edges, refs, grants, reach = _rests_on(spark, d)
    return release.omissions(release.release(edges, refs, grants, reach), refs)


KEYS_SQL = """node as (select 'c' || c_custkey as node_id, c_custkey as number, c_acctbal as balance from customer union all select 's' || s_suppkey, s_suppkey, s_acctbal from supplier),
keyed as (select node_id, 'bank' || chr(31) || 'account' || chr(31) || printf('%.2f', balance) as k from node union all select node_id, 'registry' || chr(31) || 'number' || chr(31) || number from node),
digest as (select node_id, substr(sha256(k), 1, 12) as key from keyed),
linked as (select distinct a.node_id as a, b.node_id as b from digest a join digest b using (key)),
reached as (select node_id as a, node_id as b from node union select r.a, l.b from reached r join linked l on r.b = l.a),
least as (select a as node_id, min(b) as label from reached group by a),
ids as (select label, 'entity/' || substr(sha256(string_agg(key, chr(30) order by key)), 1, 16) as entity_id from (select distinct label, key from least join digest using (node_id)) group by label)"""


@query(f"with recursive {KEYS_SQL} select entity_id, node_id from least join ids using (label)")
def entity_ids(spark, d):
    """Customers and suppliers as nodes with two keys each: an account, by its balance, and a number in a register that both share."""
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.col("c_custkey").alias("number"), F.col("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), "s_suppkey", "s_acctbal")
    n = c.union(s)
    key = lambda connector, kind, value: n.select("node_id", F.lit(connector).alias("connector"), F.lit(kind).alias("kind"), value.alias("value"))
    return identity.entities(key("bank", "account", F.format_string("%.2f", "balance")).union(key("registry", "number", F.col("number").cast("string"))))


@query(
    "with p as (select p_partkey as id, trim(regexp_replace(lower(p_brand || ' - ' || p_size), '[\\s\\p{P}]+', ' ', 'g')) as name from part), n as (select name, count(*) as n from p group by name having count(*) between 2 and 20) "
    """select a.id::varchar as "left", b.id::varchar as "right", 'display_name' as basis, round(1.0 / max(n), 4)::double as confidence, 'candidate' as status from p a join p b on a.name = b.name and a.id::varchar < b.id::varchar join n on n.name = a.name group by a.id, b.id"""
)
def likeness_pairs(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("entity_id"), F.concat_ws("/", "p_brand", "p_size").alias("name"))
    return identity.candidates(p)[0]


RERANK_SQL = """w as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}'))) as word from documents), i as (select item_id, text as query, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}'))) as word from benchmark),
shared as (select item_id as query_id, doc_id, count(*) as n from i join w using (word) group by all), placed as (select *, row_number() over (partition by query_id order by n desc, doc_id) as rank from shared), short as (select * from placed where rank <= 25),
pairs as (select query_id, doc_id, rank, length(d.text) as chars, list_distinct(string_split_regex(trim(lower(b.text), chr(32) || chr(9) || chr(10)), '\\s+')) as q, string_split_regex(lower(d.text), '\\s+') as t from short join documents d using (doc_id) join benchmark b on b.item_id = query_id),
scores as (select query_id, doc_id, rank, case when chars <= 9000 then len(list_intersect(q, t))::double / len(q) end as best from pairs)"""


@query(
    f"with {RERANK_SQL} select query_id, doc_id::varchar as thread_id, rank::int as rank, count(best) over w = count(*) over w as ordering_applied, "
    "(case when count(best) over w = count(*) over w then row_number() over (partition by query_id order by best desc, doc_id::varchar) else rank end)::int as final_rank from scores window w as (partition by query_id)"
)
def reranked_orders(spark, d):
    """Each benchmark passage as a query over all documents: the 25 that share most of its long words, reranked by a backend without a
    model; documents above 9,000 characters have no text to score, and leave their query's order as it was."""
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{7,})"), F.lit(1)))).alias("word")
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    shared = docs.select("doc_id", words("text")).join(items.select(F.col("item_id").alias("query_id"), words("text")), "word").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    short = shared.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("n"), "doc_id"))).filter("rank <= 25")
    short = cut(short.select("query_id", F.col("doc_id").cast("string").alias("thread_id"), "rank"))
    texts = docs.select(F.col("doc_id").cast("string").alias("thread_id"), F.when(F.char_length("text") <= 9000, F.col("text")).alias("text"))
    pairs = short.join(texts, "thread_id").join(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id").withColumn("message_id", F.col("thread_id"))
    return rerank.reordered(short, rerank.scored(pairs, "overlap", rerank.overlap_backend)).select("query_id", "thread_id", "rank", "ordering_applied", "final_rank")


# --- Answers that continue -----------------------------------------------------------


@query(
    "select source || '/' || (doc_id // 40) as answer, count(*) filter (where doc_id % 6 = 0) as hits, count(*) filter (where doc_id % 6 = 0) as reachable, 0::bigint as floor_lost, 0::bigint as rises, 0::bigint as vanished, 0::bigint as chars_lost from documents group by all"
)
def answers_reversed(spark, d):
    """For each answer of disclosure_steps: what it shows and what its continuation expands are all its hits, to the character."""
    rows = cut(answers_of_documents(spark, d))
    made, out = disclosure.degrade_rows(rows)
    made = cut(made)
    state = cut(answers.shown(rows, made))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("message_id"), F.ceil(F.col("n_chars") / 4).alias("tokens"), F.col("n_chars").alias("chars"))
    pages = answers.expand(answers.records(state)[0], texts)
    return answers.broken(state, made, out, pages, texts)


# --- Expansion and structural difference ---------------------------------------------


@query(
    "with m as (select conv_id, turn, role, '<' || conv_id || '.' || turn || '@x>' as header, case when turn > 0 then '<' || conv_id || '.' || (turn - 1) || '@x>' end as parent from conversations), "
    "u as (select conv_id // 10 as query_id, conv_id || '-' || turn as child, parent as header, conv_id * 100 + turn as place from m c where role = 'assistant' and parent is not null), "
    "p as (select *, row_number() over (partition by query_id order by place) as n from u) "
    "select query_id, header, child as for_child_id, case when n > 4 then 'over_cap' else 'recovered' end as state, case when n <= 4 then replace(trim(header, '<>'), '.', '-').replace('@x', '') end as message_id from p"
)
def parent_lookups(spark, d):
    """Ten conversations a query, of which the answers were shown: what they reply to is looked up by id, four lookups a query."""
    m = messages(spark, d)
    head = lambda turn: F.concat(F.lit("<"), F.col("thread_id").cast("string"), F.lit("."), turn.cast("string"), F.lit("@x>"))
    m = m.withColumn("rfc822_message_id", head(F.col("position"))).withColumn("parent_header", F.when(F.col("position") > 0, head(F.col("position") - 1)))
    named = m.filter("sender = 'assistant' and parent_header is not null")
    u = named.select(F.floor(F.col("thread_id") / 10).alias("query_id"), F.col("message_id").alias("child_id"), F.col("parent_header").alias("header"), (F.col("thread_id") * 100 + F.col("position")).alias("place"))
    return expansion.expanded(u, m).select("query_id", "header", "for_child_id", "state", "message_id")


@query(
    "with e as (select user_id as thread_id, event_type, ts, value from events), q as (select event_type as query_id, max(ts) - interval 36 hour as a, max(ts) as b from e group by event_type), "
    "s as (select event_type as query_id, thread_id, 0 as priority from e where value > 60 union all select event_type, thread_id, 1 from (select thread_id, arg_min(event_type, ts) as event_type from e group by thread_id) union all select q.query_id, e.thread_id, 2 from e join q on e.ts >= q.a and e.ts < q.b) "
    "select query_id, thread_id, min(priority)::int as priority, case min(priority) when 0 then 'touched' when 1 then 'participant' else 'recency' end as basis from s group by query_id, thread_id"
)
def pool_threads(spark, d):
    """A query for each type of event: users whom a large one touched, whose first event was of the type, or who did anything in its last 36 hours."""
    f = feed(spark, d)
    touched = f.filter("value > 60").select(F.col("event_type").alias("query_id"), "thread_id").distinct()
    people = f.groupBy("thread_id").agg(F.min_by("event_type", "ts_us").alias("query_id"))
    last = f.groupBy(F.col("event_type").alias("query_id")).agg(F.max("ts_us").alias("now_us"))
    windows = last.select("query_id", (F.col("now_us") - 36 * 3_600_000_000).alias("start_us"), F.lit(None).cast("long").alias("end_us"), "now_us")
    return expansion.pool_scope(touched, people, f, windows)


@query(
    "with e as (select event_id as id, event_type as t, value as v, (props->>'k')::int as k, lead(event_type) over w as t2, lead(value) over w as v2, lead((props->>'k')::int) over w as k2, lead(event_id) over w is not null as more from events window w as (partition by user_id order by event_id)), "
    "p as (select id, '$.type' as path, t as l, t2 as r from e where more union all select id, '$.props.k', k::varchar, k2::varchar from e where more union all select id, '$.seen[0]', (k > 50)::varchar, (k2 > 50)::varchar from e where more "
    "union all select id, '$.seen[1]', case when v > 40 then t end, case when v2 > 40 then t2 end from e where more) select id, path, l as left_value, r as right_value from p where l is distinct from r"
)
def answer_differences(spark, d):
    """Each event as a nested answer against the user's next: the paths on which they differ, with both values."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    seen = F.concat(F.array((F.col("k") > 50).cast("string")), F.when(F.col("value") > 40, F.array("event_type")).otherwise(F.array().cast("array<string>")))
    e = e.withColumn("payload", F.to_json(F.struct(F.col("event_type").alias("type"), F.struct("k").alias("props"), seen.alias("seen"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("map_id"))))
    two = cut(e.select(F.col("event_id").alias("id"), "payload", F.lead("payload").over(W.partitionBy("user_id").orderBy("event_id")).alias("next")).filter("next is not null"))
    side = lambda c: two.select("id", equivalence.normalised(F.col(c)).alias("payload"))
    return equivalence.compare(side("payload"), side("next"))
