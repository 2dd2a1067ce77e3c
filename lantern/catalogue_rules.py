"""Queries on rules, handles, stated assertions, evaluation and the disclosure ladder, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lantern.adapters import feed, messages, table
from lantern.functions import text as T
from lantern.operators import disclosure, evaluation, handles, stated
from lantern.plans import rules
from lantern.registry import MSG, query, word

# --- Rules of a search ---------------------------------------------------------

RUNS_SQL = (
    "r as (select doc_id as run, (doc_id % 7)::bigint as hits, case when doc_id % 5 = 0 then 1.0 else 0.5 end::double as coverage, (doc_id % 2)::bigint as dropped, lang = 'de' as sufficient, n_chars > 5000 as capped, "
    "doc_id % 3 = 0 as names_id, n_chars % 5 as phrase_tokens, n_chars % 2 = 0 as phrase_seen, doc_id % 4 = 0 as names_identifier, case doc_id % 11 when 0 then null when 1 then true when 2 then true else n_chars % 3 = 0 end as present, source, n_chars from documents), "
    "b as (select *, case when names_id and hits = 1 then 'E-a' when phrase_tokens >= 3 and hits between 1 and 3 then case when phrase_seen then 'E-b' end when names_identifier and hits between 1 and 3 then 'E-c' end as branch from r), "
    "s as (select *, case when branch = 'E-a' then '1' when branch is not null and present is distinct from false then '1b' when hits between 1 and 5 and coverage = 1 and dropped = 0 and present is true then '2' when sufficient then '3' when capped then '5' end as stopped from b)"
)


def runs(spark, d) -> DataFrame:
    """A run of a search for each document, its facts from the document's columns."""
    i, n = F.col("doc_id"), F.col("n_chars")
    present = F.when(i % 11 == 0, F.lit(None)).when(i % 11 <= 2, F.lit(True)).otherwise(n % 3 == 0)
    r = table(spark, d, "documents").select(
        i.alias("run"), (i % 7).cast("long").alias("hits"), F.when(i % 5 == 0, 1.0).otherwise(0.5).alias("coverage"), (i % 2).cast("long").alias("dropped"), (F.col("lang") == "de").alias("sufficient"), (n > 5000).alias("capped"),
        (i % 3 == 0).alias("names_id"), (n % 5).alias("phrase_tokens"), (n % 2 == 0).alias("phrase_seen"), (i % 4 == 0).alias("names_identifier"), present.alias("present"), "source", n,
    )
    r = r.withColumn("branch", rules.exact_branch())
    return r.withColumn("stopped", rules.stop_rule())


@query(f"with {RUNS_SQL} select run, branch, stopped from s")
def stop_rules(spark, d):
    return runs(spark, d).select("run", "branch", "stopped")


@query(
    f"with {RUNS_SQL} select run, case when stopped is not distinct from '1' or branch is not null or names_identifier or source like '%1%' or n_chars <= 20 then 'not_applicable' when hits = 0 or present is false or n_chars % 10 = 0 then 'ran' else 'stopped_on_evidence' end as state from s"
)
def semantic_gates(spark, d):
    r = runs(spark, d).withColumn("structural_only", F.col("source").contains("1")).withColumn("free_text", F.col("n_chars") > 20).withColumn("evidence", F.col("hits"))
    r = r.withColumn("paraphrased", F.when(F.col("n_chars") % 10 == 0, True)).withColumn("non_lexical", F.lit(None).cast("boolean"))
    return r.select("run", rules.semantic_gate().alias("state"))


@query(
    f"with {RUNS_SQL} select run, case when names_id then 'rfc822msgid_route' when branch is not null then 'exact_signal_match' when hits = 1 then 'hit_count_is_one' end as forbidden_by, "
    "case when names_id or branch is not null or hits = 1 then '' else concat_ws(',', case when hits between 2 and 50 then 'hit_count_band' end, case when coverage < 1 then 'term_coverage_below_one' end, case when dropped + 1 >= 2 then 'thread_concentration' end, case when n_chars % 20 <= 4 then 'scored_retriever_margin' end) end as signals from s"
)
def rerank_gates(spark, d):
    r = runs(spark, d).withColumn("threads", F.col("dropped") + 1).withColumn("best", F.lit(0.5)).withColumn("second", 0.5 - (F.col("n_chars") % 20) / 100.0 - 0.001)
    g = r.select("run", rules.rerank_gate().alias("g"))
    return g.select("run", "g.forbidden_by", F.array_join("g.signals", ",").alias("signals"))


@query(
    f"with {RUNS_SQL} select run, case when capped then 'inconclusive' when hits > 2 and hits % 2 = 0 and n_chars % 4 <> 0 then 'answered' when hits > 2 or n_chars % 3 = 0 or hits > 0 or n_chars % 4 = 0 or names_id then 'inconclusive' else 'not_found' end as outcome from s"
)
def search_outcomes(spark, d):
    n = F.col("n_chars")
    r = runs(spark, d).withColumn("disclosed", F.when(F.col("hits") > 2, F.col("hits")).otherwise(0)).withColumn("evidence", F.when(F.col("hits") % 2 == 0, F.col("hits")).otherwise(0))
    r = r.withColumn("unread_pages", n % 4 == 0).withColumn("blocked", n % 3 == 0).withColumn("accounted", ~F.col("names_id"))
    return r.select("run", rules.outcome().alias("outcome"))


DATES_SQL = rules.DATES.replace("'", "''")
AMOUNTS_SQL = rules.AMOUNTS.replace("'", "''")


@query(
    f"with k as (select source, text, case lang when 'en' then 'date_like' when 'fr' then 'numeric_currency' when 'de' then 'decision_verb' end as kind from documents) "
    f"select source, kind, case when kind is not null then bool_or(coalesce(case kind when 'date_like' then regexp_matches(text, '(?i){DATES_SQL}') when 'numeric_currency' then regexp_matches(text, '(?i){AMOUNTS_SQL}') "
    "else regexp_matches(lower(text), '(^|[^a-z])(agreed|approved|canceled|cancelled|chose|chosen|confirmed|decided|declined|rejected|resolved|settled|signed)([^a-z]|$)') end, false)) end as present, count(text)::bigint as examined from k group by source, kind"
)
def answer_presence(spark, d):
    question = F.when(F.col("lang") == "en", "when").when(F.col("lang") == "fr", "how_much").when(F.col("lang") == "de", "did_we_decide").otherwise("who")
    return rules.presence(table(spark, d, "documents").withColumn("kind", rules.answer_type(question)), "source", "kind", "text")


@query(
    "with c as (select user_id, row_number() over w as seq, sum(case event_type when 'click' then 10 when 'view' then 40 else 5 end) over (w rows unbounded preceding) as units, 100 * row_number() over w as ms from events window w as (partition by user_id order by ts, event_id)), "
    "b as (select user_id, seq, case when ms >= 1500 then 'max_server_ms' when units > 300 then 'max_quota_units' when seq > 12 then 'max_api_calls' when seq > 24 then 'max_http_requests' end as cap, case when ms >= 1500 then ms when units > 300 then units else seq end as spent from c) "
    "select user_id, arg_min(seq, seq)::bigint as seq, arg_min(cap, seq) as cap, arg_min(spent, seq)::bigint as spent from b where cap is not null group by user_id"
)
def budget_breaches(spark, d):
    w = W.partitionBy("thread_id").orderBy("ts_us", "history_id")
    units = F.when(F.col("event_type") == "click", 10).when(F.col("event_type") == "view", 40).otherwise(5)
    calls = feed(spark, d).select("thread_id", "ts_us", "history_id", units.alias("units"), (100 * F.row_number().over(w)).alias("elapsed_ms"))
    b = rules.breaches(calls, "thread_id", ["ts_us", "history_id"], {"max_quota_units": 300, "max_api_calls": 12, "max_server_ms": 1500})
    return b.select(F.col("thread_id").alias("user_id"), F.col("seq").cast("long"), "cap", "spent")


@query(
    "with t as (select event_id, 1 + event_id % 4 as tries, (event_id % 10) / 10.0 as draw, (event_id % 13) * 100.0 as slept from events), x as (select *, 250 * pow(2, tries - 1) * (0.75 + 0.5 * draw) as delay from t) "
    "select event_id, round(case when tries <= 3 and delay <= 1500 - slept then delay end, 6) as delay from x"
)
def retry_delays(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.round(rules.next_delay(1 + i % 4, (i % 10) / 10.0, (i % 13) * 100.0), 6).alias("delay"))


@query("with r as (select distinct user_id as id, user_id * 37 % 2000 as asked from events) select id, greatest(asked, 845)::bigint as units, asked < 845 as clamped from r")
def clamped_budgets(spark, d):
    r = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    r = r.select("id", rules.applied_units(F.col("id") * 37 % 2000, F.lit(False)).alias("b"))
    return r.select("id", F.col("b.units").cast("long").alias("units"), "b.clamped")


@query(
    "select conv_id, turn, case turn % 4 when 0 then 'spam' when 1 then 'trash' when 2 then 'spam,trash' else '' end as regions from conversations"
)
def label_regions(spark, d):
    labels = F.when(F.col("turn") % 4 == 0, F.array(F.lit("SPAM"), F.lit("INBOX"))).when(F.col("turn") % 4 == 1, F.array(F.lit("TRASH"))).when(F.col("turn") % 4 == 2, F.array(F.lit("TRASH"), F.lit("SPAM"))).otherwise(F.array(F.lit("INBOX")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(rules.regions(labels), ",").alias("regions"))


# --- Handles -------------------------------------------------------------------

SECRET, EPOCH = b"a key for tests", 3
PADS = ["".join(f"{b ^ x:02x}" for b in SECRET.ljust(64, b"\0")) for x in (0x36, 0x5C)]
URL64 = "rtrim(replace(replace(to_base64({}), '+', '-'), '/', '_'), '=')"
MINTED = (
    "t as (select conv_id, 'c' || conv_id as id, max(turn) as history, count(*) as width, substr(sha256(conv_id || chr(31) || sha256(string_agg(conv_id || '-' || turn || chr(31) || turn || chr(31) || chr(31), chr(10) order by turn))), 1, 32) as digest from conversations group by conv_id), "
    "j as (select *, '{\"account_hash\":\"' || sha256('ann@x.example') || '\",\"fetched_at\":' || (1000 * (conv_id % 3)) || ',\"key_epoch\":3,\"mapping_digest\":\"' || digest || '\",\"threads\":[{\"id\":\"' || id || '\",\"history\":' || history || ',\"width\":' || width || '}],\"ttl\":900,\"v\":2}' as body from t), "
    f"e as (select *, {URL64.format('encode(body)')} as enc from j), h as (select *, enc || '.' || {URL64.format(f"unhex(sha256(unhex('{PADS[1]}') || unhex(sha256(unhex('{PADS[0]}') || encode(enc)))))")} as handle from e)"
)


def minted(spark, d) -> DataFrame:
    """conv_id, handle: one for each conversation, fetched at second 0, 1000 or 2000."""
    m = messages(spark, d).withColumn("parent_id", F.lit(None).cast("string")).withColumn("linkage", F.lit(None).cast("string"))
    digest = handles.map_digest(m.withColumn("handle_id", F.col("thread_id")), "handle_id")
    t = m.groupBy("thread_id").agg(F.max("position").cast("long").alias("history"), F.count(F.lit(1)).cast("int").alias("width")).join(digest.withColumnRenamed("handle_id", "thread_id"), "thread_id")
    thread = F.array(F.struct(F.concat(F.lit("c"), "thread_id").alias("id"), "history", "width"))
    made = handles.mint(SECRET, EPOCH, handles.account_hash(F.lit(" Ann@x.example")), F.col("digest"), thread, F.col("thread_id") % 3 * 1000)
    return t.select(F.col("thread_id").alias("conv_id"), made.alias("handle"), "digest")


@query(f"with {MINTED} select conv_id, handle from h")
def minted_handles(spark, d):
    return minted(spark, d).select("conv_id", "handle")


@query(
    f"with {MINTED} select conv_id, case conv_id % 5 when 0 then 'handle_invalid' when 1 then 'handle_invalid' when 2 then 'handle_key_rotated' else case when conv_id % 3 = 0 then 'handle_expired' else 'good' end end as state from h"
)
def verified_handles(spark, d):
    i, account, now = F.col("conv_id"), handles.account_hash(F.lit("ann@x.example")), F.lit(1500)
    h = F.when(i % 5 == 0, F.concat("handle", F.lit("A"))).otherwise(F.col("handle"))
    who = F.when(i % 5 == 1, "other").otherwise(account)
    old, new = handles.verify(h, SECRET, EPOCH + 1, who, now), handles.verify(h, SECRET, EPOCH, who, now)
    return minted(spark, d).select("conv_id", F.coalesce(F.when(i % 5 == 2, old).otherwise(new), F.lit("good")).alias("state"))


@query(
    f"with {MINTED} select conv_id, case when conv_id % 3 = 0 then 'handle_expired' when conv_id % 4 = 1 or conv_id % 7 = 2 then 'handle_stale' when history < 2 then 'handle_stale_unverifiable' else 'verified' end as state from h"
)
def redeemed_handles(spark, d):
    m = minted(spark, d).select(F.col("conv_id").alias("handle_id"), "handle", "digest")
    changes = messages(spark, d).filter("thread_id % 4 = 1").select(F.concat(F.lit("c"), "thread_id").alias("thread_id"), (F.col("position") + 1).cast("long").alias("history_id"))
    again = m.select("handle_id", F.when(F.col("handle_id") % 7 == 2, F.reverse("digest")).otherwise(F.col("digest")).alias("digest"))
    r = handles.redeem(m, changes, 3, again, SECRET, EPOCH, handles.account_hash(F.lit("ann@x.example")), F.lit(1500))
    return r.select(F.col("handle_id").alias("conv_id"), "state")


@query(
    "select doc_id, sha256(lower(trim(source))) as account, substr(sha256('salt' || lang), 1, 16) as salted, substr(sha256(lang || chr(31) || source), 1, 16) as digest, "
    "sha256('{\"connector\": \"' || lang || '\", \"content_version\": \"1\", \"extraction_schema_version\": \"1\", \"kind\": \"structure\", \"model_id\": null, \"native_id\": \"' || doc_id || '\", \"permission_hash\": \"p\", \"principal\": \"' || source || '\", \"redaction_policy\": \"none\"}') as key from documents"
)
def cache_keys(spark, d):
    one = F.lit("1")
    key = handles.cache_key(connector=F.col("lang"), content_version=one, extraction_schema_version=one, kind=F.lit("structure"), model_id=F.lit(None).cast("string"), native_id=F.col("doc_id"), permission_hash=F.lit("p"), principal=F.col("source"), redaction_policy=F.lit("none"))
    return table(spark, d, "documents").select("doc_id", handles.account_hash(F.col("source")).alias("account"), handles.salted(F.col("lang"), b"salt").alias("salted"), handles.joined_digest(F.col("lang"), F.col("source")).alias("digest"), key.alias("key"))


@query("select doc_id, md5('<<<mw-0123456789abcdef ' || text || ' mw-0123456789abcdef>>>') as fenced, md5(text) as text from documents")
def fenced_texts(spark, d):
    f = table(spark, d, "documents").select("doc_id", handles.fence(F.lit("mw-0123456789abcdef"), F.col("text")).alias("f"))
    return f.select("doc_id", F.md5("f").alias("fenced"), F.md5(handles.unfenced(F.col("f"))).alias("text"))


@query("select doc_id, (length(text) + length(regexp_replace(text, '[^\"\\\\\\n\\r\\t]', '', 'g')) + 5 * length(regexp_replace(text, '[\\x00-\\x7E]', '', 'g')) + 6 * length(regexp_replace(text, '[\\x00-\\x{FFFF}]', '', 'g')))::bigint as chars from documents")
def json_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", handles.json_chars(F.col("text")).alias("chars"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as stamp, strftime(ts, '%Y/%m/%d') as day from events")
def instant_formats(spark, d):
    return table(spark, d, "events").select("event_id", handles.rfc3339(F.col("ts")).alias("stamp"), handles.slash_date(F.col("ts")).alias("day"))


# --- Stated assertions -----------------------------------------------------------

SAID = "case when turn % 4 = 1 then text || ' This replaces the plan P' || conv_id || 'x' || (turn - 1) || '.' when turn % 4 = 2 then text || ' It may supersede nothing; perhaps this replaces the plan P' || conv_id || 'x0.' when turn % 4 = 3 then text || ' It withdraws the previous version.' else text || ' Plan P' || conv_id || 'x' || turn || ' is here.' end"


def said(spark, d) -> DataFrame:
    m = messages(spark, d)
    name = lambda k: F.concat(F.lit("P"), "thread_id", F.lit("x"), k.cast("string"))
    tail = (
        F.when(F.col("position") % 4 == 1, F.concat(F.lit(" This replaces the plan "), name(F.col("position") - 1), F.lit(".")))
        .when(F.col("position") % 4 == 2, F.concat(F.lit(" It may supersede nothing; perhaps this replaces the plan "), name(F.lit(0)), F.lit(".")))
        .when(F.col("position") % 4 == 3, " It withdraws the previous version.")
        .otherwise(F.concat(F.lit(" Plan "), name(F.col("position")), F.lit(" is here.")))
    )
    return m.select("message_id", F.col("thread_id").alias("scope"), "position", F.concat("text", tail).alias("text"))


@query(
    "with c as (select conv_id, turn, length(text) as n, conv_id || '-' || turn as message_id, lag(turn) over (partition by conv_id order by turn) is not null and exists (select 1 from conversations p where p.conv_id = c.conv_id and p.turn = c.turn - 1) as has_parent, (select count(*) from conversations o where o.conv_id = c.conv_id and o.turn <> c.turn and (o.turn = c.turn - 1 or (c.turn = 1 and o.turn % 4 = 2))) as named from conversations c) "
    "select message_id, (n + case turn % 4 when 1 then 6 when 2 then 40 else 4 end)::bigint as start, case when turn % 4 = 3 then 'withdraws' else 'replaces' end as verb, case turn % 4 when 1 then 'plan P' || conv_id || 'x' || (turn - 1) when 2 then 'plan P' || conv_id || 'x0' else 'previous version' end as reference, "
    "case when turn % 4 = 2 then 'clause' when turn % 4 = 3 or named <> 1 then 'target' end as refused, case when turn % 4 = 1 and named = 1 then conv_id || '-' || (turn - 1) end as target from c where turn % 4 <> 0"
)
def stated_assertions(spark, d):
    c = stated.check(said(spark, d))
    return c.select("message_id", F.col("start").cast("long"), "verb", "reference", "refused", "target")


# --- Evaluation ------------------------------------------------------------------


@query("select round((select avg((n_chars > 9000)::int) from documents join labels using (doc_id) where quality = 1), 6) as false_not_found, round((select avg((n_chars <= 9000)::int) from documents join labels using (doc_id) where quality = 0), 6) as hallucinated_found, round((select avg((n_chars <= 500)::int) from documents join labels using (doc_id)), 6) as inconclusive")
def outcome_rates(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    n = F.col("n_chars")
    r = evaluation.outcome_rates(j.select((F.col("quality") == 1).alias("answerable"), F.when(n <= 500, "inconclusive").when(n > 9000, "not_found").otherwise("answered").alias("outcome")))
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


@query("select event_type as stratum, count(*)::bigint as n, sum((value > 400 and event_type = 'error')::int)::bigint as censored, case when sum((value > 400 and event_type = 'error')::int) = 0 then quantile_disc(value, 0.9) end as p90, case when sum((value > 400 and event_type = 'error')::int) = 0 then quantile_disc(value, 0.9) <= 60 end as meets from events group by event_type")
def freshness_verdicts(spark, d):
    e = table(spark, d, "events")
    return evaluation.freshness(e.select(F.col("event_type").alias("stratum"), F.when(~((F.col("value") > 400) & (F.col("event_type") == "error")), F.col("value")).alias("seconds")))


RUN_SQL = "x as (select lang as arm, doc_id % 4 as position, (n_chars % 100) / 100.0 as recall, (n_chars % 100 + doc_id % 9 - if(lang = 'de' and doc_id % 2 = 0, 9, 0)) / 100.0 as pool_recall, case when doc_id % 6 = 0 then 'control' else 'plain' end as family, doc_id % 10 = 0 as failed, doc_id % 12 = 0 as declined, n_chars % 5 as k, doc_id % 3 as l from documents)"


def _runs(spark, d) -> DataFrame:
    i, n = F.col("doc_id"), F.col("n_chars")
    pool = (n % 100 + i % 9 - F.when((F.col("lang") == "de") & (i % 2 == 0), 9).otherwise(0)) / 100.0
    return table(spark, d, "documents").select(
        F.col("lang").alias("arm"), (i % 4).alias("position"), ((n % 100) / 100.0).alias("recall"), pool.alias("pool_recall"), F.when(i % 6 == 0, "control").otherwise("plain").alias("family"), (i % 10 == 0).alias("failed"), (i % 12 == 0).alias("declined"),
        (n % 5).alias("first"), (i % 3).alias("gained"), (n % 5).alias("stuck"), (i % 3).alias("unseen"), (i % 3).alias("levels"), (n % 5).alias("carried"),
    )


@query(f"with {RUN_SQL}, p as (select arm, position, avg(recall) as r from x group by all) select arm, round(case when count(*) >= 2 then max(r) - min(r) end, 6) as spread from p group by arm")
def position_spread(spark, d):
    return evaluation.position_spread(_runs(spark, d)).select("arm", F.round("spread", 6).alias("spread"))


@query(f"with {RUN_SQL}, g as (select arm, count(*) as n, min(pool_recall - recall) as least, avg(pool_recall - recall) as mean from x group by arm) select arm, case when least < 0 then 'inconclusive' else 'measured' end as state, round(case when least >= 0 then mean end, 6) as loss, n::bigint as n from g")
def cut_loss(spark, d):
    r = _runs(spark, d)
    # Exact hundredths, so that no rounding error counts as a loss below zero.
    return evaluation.cut_loss(r.withColumn("recall", F.round(F.col("recall") * 100)).withColumn("pool_recall", F.round(F.col("pool_recall") * 100))).select("arm", "state", F.round(F.col("loss") / 100, 6).alias("loss"), "n")


@query(
    f"with {RUN_SQL}, y as (select *, family <> 'control' as real, family <> 'control' and not failed as ran from x) select arm, sum(ran::int)::bigint as cases, sum(if(ran, k, 0))::bigint as first, sum(if(ran, l, 0))::bigint as gained, sum(if(ran, k, 0))::bigint as stuck, sum(if(ran, l, 0))::bigint as unseen, round(avg(case when ran then l end), 2) as levels, "
    "sum((real and failed)::int)::bigint as failed, sum((not real)::int)::bigint as controls, sum((not real and declined)::int)::bigint as controls_declined, sum((not real and k > 0)::int)::bigint as controls_answered from y group by arm"
)
def recoverability(spark, d):
    return evaluation.recoverability(_runs(spark, d))


@query("select o_orderkey, (count(*) over (partition by o_custkey order by o_orderpriority desc range unbounded preceding))::bigint as rank from orders")
def pessimistic_rank(spark, d):
    return evaluation.rank_of(table(spark, d, "orders"), "o_custkey", "o_orderpriority").select("o_orderkey", "rank")


@query("select event_id, case (event_id + user_id) % 3 when 0 then 'a,b,c' when 1 then 'b,c,a' else 'c,a,b' end as arms from events")
def latin_order(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(evaluation.running_order(["a", "b", "c"], F.col("event_id"), F.col("user_id")), ",").alias("arms"))


@query("with a as (select conv_id, count(*) filter (turn < 6) as f, count(*) filter (turn % 2 = 0 or turn < 3) as l from conversations group by 1) select count(*)::bigint as compared, sum((f < l)::int)::bigint as short, sum((f > l)::int)::bigint as over, case when sum((f < l)::int) > 0 then 'fail' else 'pass' end as verdict from a")
def thread_completeness(spark, d):
    m = messages(spark, d)
    count = lambda c: m.groupBy("thread_id").agg(F.count_if(c).alias("n"))
    return evaluation.completeness(count(F.col("position") < 6), count((F.col("position") % 2 == 0) | (F.col("position") < 3)))


VALUE_SQL = evaluation.VALUE.replace("'", "''")


@query(
    "with m as (select conv_id, turn, conv_id || '-' || turn as id, text || case turn % 3 when 0 then ' As agreed, K1234.' when 1 then ' Somebody said 1500.' else '' end as text from conversations), v as (select * from m where turn % 3 < 2 or regexp_matches(text, '" + VALUE_SQL + "')), "
    "s as (select *, 2 * (contains(lower(text), 'as agreed'))::int - 3 * (contains(lower(text), 'said'))::int as s from v) select conv_id as thread_id, arg_max(id, (s, turn, id)) as best, arg_max(id, (turn, id)) as latest from s group by conv_id"
)
def value_bearing(spark, d):
    m = messages(spark, d)
    tail = F.when(F.col("position") % 3 == 0, " As agreed, K1234.").when(F.col("position") % 3 == 1, " Somebody said 1500.").otherwise("")
    return evaluation.select_messages(m.select("thread_id", "message_id", "position", F.col("position").cast("long").alias("epoch_ms"), F.lit("Re: budget").alias("subject"), F.concat("text", tail).alias("text")))


@query("select doc_id, case doc_id % 3 when 0 then 'alpha beta' when 1 then 'price contract' end as q from documents")
def question_queries(spark, d):
    q = F.when(F.col("doc_id") % 3 == 0, "What did Alpha tell Beta about Alpha?").when(F.col("doc_id") % 3 == 1, "What is the price of the contract, in it?").otherwise("Who is it?")
    return table(spark, d, "documents").select("doc_id", rules.to_query(q, T.STOPWORDS + ["tell"]).alias("q"))


# --- Disclosure ------------------------------------------------------------------


def answers(spark, d) -> DataFrame:
    """An answer for each source of documents: its documents are messages of a few threads."""
    i = F.col("doc_id")
    band = F.when(i % 6 == 0, "EVIDENCE").when(i % 6 == 1, "FLOOR").when(i % 6 <= 3, "FILL").otherwise("MAP")
    tokens = F.least(F.col("n_chars"), F.lit(4000))
    deep = F.array((F.lit(151) + tokens).cast("long"), (F.lit(151) + F.floor(tokens / 4)).cast("long"), F.lit(151).cast("long"))
    costs = F.when(band == "MAP", F.array(F.lit(151).cast("long"))).otherwise(deep)
    docs = table(spark, d, "documents")
    return docs.select("source", F.col("lang").alias("thread_id"), F.length("lang").alias("rank"), i.alias("message_id"), i.alias("position"), band.alias("band"), (i % 10).cast("long").alias("score"), costs.alias("costs")).withColumn("answer", F.concat_ws("/", "source", F.floor(F.col("message_id") / 40).cast("string"))).drop("source")


@query(None)
def disclosure_steps(spark, d):
    return disclosure.degrade_rows(answers(spark, d))[1]


@query(
    "with r as (select source || '/' || (doc_id // 40) as answer, doc_id % 6 as b, least(n_chars, 4000) as t from documents), c as (select answer, b, 151 + case when b > 3 then 0 else t end as c from r) "
    "select answer, sum(c)::bigint as disclosed, (sum(c) + 540)::bigint as full_dump, sum(if(b < 2, c, 0))::bigint as relevant, round(sum(c) / (sum(c) + 540), 4) as share from c group by answer"
)
def disclosure_efficiency(spark, d):
    rows = answers(spark, d).select("answer", "band", F.element_at("costs", 1).alias("tokens"))
    return disclosure.efficiency(rows, rows)


@query(f"with {MSG}, h as (select *, {word('ing')} as hit, position % 3 = 0 as floor, position % 2 = 0 as filled from m) select message_id, case when hit then 'EVIDENCE' when floor then 'FLOOR' when filled then 'FILL' else 'MAP' end as band, case when hit or (floor and position = 0) then 'BODY_CLEAN' when floor or filled then 'SNIPPET' else 'STUB' end as depth from h")
def planned_depths(spark, d):
    p = F.col("position")
    m = messages(spark, d).select("message_id", T.has_word(F.col("text"), "ing").alias("hit"), (p % 3 == 0).alias("floor"), (p == 0).alias("promoted"), (p % 2 == 0).alias("filled"), F.lit(True).alias("has_body"), F.lit(True).alias("has_text"))
    return disclosure.bands(m).select("message_id", "band", "depth")
