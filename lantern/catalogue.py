"""The engine's queries on the plain tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lantern import catalogue_bodies, catalogue_rules, catalogue_search  # noqa: F401  (they register their queries)
from lantern.adapters import feed, messages, shared_folder, table
from lantern.functions import text as T
from lantern.operators import disclosure, evaluation, graph, ledger, ranking, structure
from lantern.plans import ladder
from lantern.plans.predicates import Compiler
from lantern.plans.query import analyse
from lantern.registry import MSG, NOW, ORACLE, QUERIES, query, word

SEARCH = "tion ing"


# --- Retrieval ---------------------------------------------------------------


@query(f"with {MSG} select message_id, thread_id, position, row_number() over (partition by thread_id order by position desc) as newest from m where {word('tion')} and {word('ing')}")
def l1_filtered_search(spark, d):
    m = messages(spark, d)
    p = analyse(SEARCH, NOW)
    found = m.filter(Compiler(m, NOW).all(ladder.filtered(p)[0].constraints))
    return found.select("message_id", "thread_id", "position", F.row_number().over(W.partitionBy("thread_id").orderBy(F.desc("position"))).alias("newest"))


@query(f"with {MSG} select thread_id from m group by thread_id having bool_or({word('tion')}) and bool_or({word('ing')})")
def l1b_thread_intersection(spark, d):
    return ladder.threads_meeting_all(messages(spark, d), analyse(SEARCH, NOW))


@query(f"with {MSG} select message_id, 'L2' as rung, 'without participant' as probe from m where {word('tion')} and {word('ing')} union all select message_id, 'L2', 'without terms' from m where sender = 'user'")
def l2_leave_one_out(spark, d):
    m, p = messages(spark, d), analyse("from:user " + SEARCH, NOW)
    a, b = (ladder.hits(m, p, x) for x in ladder.relaxed(p))
    return a.unionByName(b).select("message_id", "rung", "probe")


@query("select event_id as history_id from events where ts >= timestamp '2024-01-10' - interval 36 hour and ts < timestamp '2024-01-11' + interval 36 hour")
def l3_window_x4(spark, d):
    f = feed(spark, d).withColumn("ts", F.timestamp_micros("ts_us"))
    w = analyse("after:2024/01/10 before:2024/01/11", NOW).window.widened(ladder.WIDEN)
    return f.filter(Compiler(f, NOW).within(w)).select("history_id")


@query(f"with {MSG} select message_id from m where contains(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), 'and the')")
def exact_phrase_hits(spark, d):
    m, p = messages(spark, d), analyse('"and the"', NOW)
    return m.filter(Compiler(m, NOW).all(p.constraints)).select("message_id")


@query(f"with {MSG} select message_id from m where {word('tion')} and not {word('ing')}")
def negated_term_search(spark, d):
    m, p = messages(spark, d), analyse("tion -ing", NOW)
    return m.filter(Compiler(m, NOW).all(p.constraints)).select("message_id")


@query(f"with {MSG} select message_id from m where {word('thth')} or {word('ing')}")
def or_group_search(spark, d):
    m, p = messages(spark, d), analyse("{thth ing}", NOW)
    return m.filter(Compiler(m, NOW).all(p.constraints)).select("message_id")


@query("select event_id as history_id from events where ts >= timestamp '2024-01-31' - interval 7 day")
def relative_window_newer_than_7d(spark, d):
    f = feed(spark, d).withColumn("ts", F.timestamp_micros("ts_us"))
    return f.filter(Compiler(f, NOW).all(analyse("newer_than:7d", NOW).constraints)).select("history_id")


@query("select event_id as history_id from events where ts >= timestamp '2024-01-23' and ts < timestamp '2024-02-02'")
def relative_window_last_7_days(spark, d):
    f = feed(spark, d).withColumn("ts", F.timestamp_micros("ts_us"))
    return f.filter(Compiler(f, NOW).within(analyse("last 7 days", NOW).window)).select("history_id")


@query(f"with {MSG}, h as (select message_id, thread_id, 'L1' as rung from m where {word('tion')} and {word('ing')}) select rung, count(*)::bigint as n, count(distinct thread_id)::bigint as threads from h group by rung")
def ladder_hits_per_rung(spark, d):
    m = messages(spark, d)
    r = ladder.run(m, analyse(SEARCH, NOW), force=False)
    return r.evidence.filter("rung = 'L1'").groupBy("rung").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("thread_id").alias("threads"))


# --- Text --------------------------------------------------------------------


@query("select doc_id, len(regexp_extract_all(text, '[0-9]{6,}'))::bigint as n from documents where regexp_matches(text, '[0-9]{6,}')")
def identifier_reference_codes(spark, d):
    return table(spark, d, "documents").filter(F.col("text").rlike("[0-9]{6,}")).select("doc_id", F.regexp_count("text", F.lit("[0-9]{6,}")).cast("bigint").alias("n"))


@query("select doc_id, case when trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), ' ')) end::bigint as n_tokens from documents")
def content_token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"))


@query(f"with w as (select doc_id, unnest(list_transform(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_''/@.-]+'), lambda x: regexp_replace(x, '[.-]+$', ''))) as term from documents) select term, count(*)::bigint as n from w where regexp_matches(term, '[\\p{{L}}\\p{{N}}]') and term not in ({', '.join(repr(s) for s in T.STOPWORDS)}) group by term having count(*) >= 20")
def stopword_filtered_terms(spark, d):
    w = table(spark, d, "documents").select(F.explode(T.content_tokens(F.col("text"))).alias("term"))
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20")


@query(
    "with t as (select conv_id, turn, trim(regexp_replace(lower(case turn % 5 when 0 then 'So, ' || text || ' what date' when 1 then text || ' was it agreed' when 2 then text || ' at what total' when 3 then 'Which ' || text else text end), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) as t from conversations), "
    "w as (select conv_id, turn, t, ' ' || regexp_replace(t, '[^\\p{L}\\p{M}\\p{N}_]+', ' ', 'g') || ' ' as s from t) "
    "select conv_id, turn, case when s like '% when %' or s like '% what date %' or s like '% what time %' or s like '% what day %' then 'when' when s like '% how much %' or s like '% how many %' or s like '% what total %' then 'how_much' "
    "when s like '% was it agreed %' or s like '% did we decide %' then 'did_we_decide' when s like '% who %' or s like '% whom %' then 'who' when s like '% where %' then 'where' when s like '% why %' then 'why' when s like '% which %' then 'which' when s like '% how %' then 'how' when s like '% what %' then 'what' end as kind from w"
)
def interrogative_class(spark, d):
    t, k = F.col("text"), F.col("turn") % 5
    asked = F.when(k == 0, F.concat(F.lit("So, "), t, F.lit(" what date"))).when(k == 1, F.concat(t, F.lit(" was it agreed"))).when(k == 2, F.concat(t, F.lit(" at what total"))).when(k == 3, F.concat(F.lit("Which "), t)).otherwise(t)
    return table(spark, d, "conversations").select("conv_id", "turn", T.interrogative(asked).alias("kind"))


@query("select doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+''-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+'), lambda x: lower(x)))) as address from documents")
def email_mentions(spark, d):
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(f"({T.ADDRESS})"), F.lit(1)), F.lower))
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("address"))


@query("select doc_id, array_to_string(list_slice(string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), ' '), 1, 250), ' ') as head from documents")
def head_truncate_250(spark, d):
    return table(spark, d, "documents").select("doc_id", T.head_truncate(F.col("text")).alias("head"))


@query(None)
def html_visible_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_visible("html").alias("text"))


@query(None)
def folded_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fold("text").alias("folded"), T.normalise(T.strip_invisible("text")).alias("normal"))


@query("select page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) as url from pages")
def page_links(spark, d):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return table(spark, d, "pages").select("page_id", F.explode(found).alias("url"))


# --- Structure ---------------------------------------------------------------


@query("select conv_id as thread_id, turn, (row_number() over (partition by conv_id order by turn) - 1)::bigint as position from conversations")
def thread_positions(spark, d):
    m = messages(spark, d).withColumn("internal_date_ms", F.col("position") * 1000)
    p = structure.positions(m.withColumn("turn", F.col("position")).drop("position"))
    return p.select("thread_id", F.split("message_id", "-")[1].cast("bigint").alias("turn"), F.col("position").cast("bigint"))


@query("select user_id as thread_id, event_id as history_id, count(*) over (partition by user_id, (epoch_us(ts) // 3600000000)) > 1 as tied from events")
def position_ties(spark, d):
    f = feed(spark, d).select("thread_id", F.col("history_id").alias("message_id"), F.expr("ts_us div 3600000000").alias("internal_date_ms"))
    return structure.positions(f).select("thread_id", F.col("message_id").alias("history_id"), "tied")


@query("select c.conv_id || '-' || c.turn as message_id, p.conv_id || '-' || p.turn as parent_id from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1")
def reply_parent_join(spark, d):
    return _links(spark, d).select("message_id", "parent_id")


def _links(spark, d) -> DataFrame:
    """Each message as a reply to the turn before it, by headers."""
    m = messages(spark, d)
    ident = lambda p: F.concat(F.lit("<"), F.col("thread_id").cast("string"), F.lit("."), p.cast("string"), F.lit("@x.example>"))
    m = m.withColumn("rfc822_message_id", ident(F.col("position"))).withColumn("in_reply_to", F.when(F.col("position") > 0, ident(F.col("position") - 1)))
    m = m.withColumn("references", F.lit(None).cast("string")).withColumn("headers_observed", F.lit(True))
    return structure.reply_links(m)


@query("with l as (select case when turn = 0 then 'NO_REPLY_HEADERS' when exists (select 1 from conversations p where p.conv_id = c.conv_id and p.turn = c.turn - 1) then 'IN_REPLY_TO' else 'UNRESOLVED_PARENT' end as linkage from conversations c) select linkage, count(*)::bigint as n from l group by linkage")
def reply_linkage_counts(spark, d):
    return _links(spark, d).groupBy("linkage").agg(F.count(F.lit(1)).alias("n"))


@query("select p.conv_id || '-' || p.turn as parent_id, string_agg(c.conv_id || '-' || c.turn, ',' order by c.turn) as children from conversations c join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1 group by 1")
def reply_children_list(spark, d):
    return structure.children(_links(spark, d), messages(spark, d)).select("parent_id", F.array_join("children", ",").alias("children"))


@query("with recursive t(conv_id, turn, depth) as (select conv_id, turn, 0 from conversations c where not exists (select 1 from conversations p where p.conv_id = c.conv_id and p.turn = c.turn - 1) union all select c.conv_id, c.turn, depth + 1 from t join conversations c on c.conv_id = t.conv_id and c.turn = t.turn + 1) select conv_id, turn, depth::bigint as depth from t")
def ancestor_depth_recursive(spark, d):
    # A chain of turns without gaps: the depth is the place in its island.
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("_i", F.col("turn") - F.row_number().over(w))
    return c.select("conv_id", "turn", (F.row_number().over(W.partitionBy("conv_id", "_i").orderBy("turn")) - 1).cast("bigint").alias("depth"))


@query("with g as (select *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) >= 86400000000, false)::int as b from events) select event_id as history_id, (sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding))::bigint as segment from g")
def thread_segments_24h(spark, d):
    f = feed(spark, d)
    f = f.withColumn("position", F.row_number().over(W.partitionBy("thread_id").orderBy("ts_us", "history_id"))).withColumn("internal_date_ms", F.col("ts_us"))
    return structure.segments(f, structure.DAY_MS * 1000).select("history_id", "segment")


@query("with g as (select *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) > 1800000000, true)::int as b from events), s as (select user_id, value, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from g) select user_id, s::bigint as session, count(*)::bigint as n, round(sum(value), 4) as value from s group by all")
def user_sessions_gap(spark, d):
    w = W.partitionBy("thread_id").orderBy("ts_us", "history_id")
    f = feed(spark, d).withColumn("b", F.coalesce((F.col("ts_us") - F.lag("ts_us").over(w) > 1_800_000_000).cast("int"), F.lit(1)))
    f = f.withColumn("session", F.sum("b").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return f.groupBy(F.col("thread_id").alias("user_id"), "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query(f"with {MSG}, h as (select *, {word('ing')} as hit from m) select message_id, bool_or(hit) over (partition by thread_id order by position rows between 2 preceding and 2 following) as near from h")
def fixed_window_pm2(spark, d):
    m = messages(spark, d).withColumn("hit", T.has_word(F.col("text"), "ing"))
    return m.select("message_id", F.max("hit").over(W.partitionBy("thread_id").orderBy("position").rowsBetween(-2, 2)).alias("near"))


@query(f"with {MSG}, h as (select *, {word('ing')} as hit from m) select a.message_id, min(abs(a.position - b.position))::bigint as distance from h a left join h b on a.thread_id = b.thread_id and b.hit group by a.message_id")
def nearest_hit_distance(spark, d):
    m = messages(spark, d).withColumn("hit", T.has_word(F.col("text"), "ing"))
    return disclosure.nearest_hit(m).select("message_id", "distance")


@query("select conv_id as thread_id, role as sender, count(*)::bigint as n, min(turn)::bigint as first_turn from conversations group by 1, 2")
def participants_index(spark, d):
    return messages(spark, d).groupBy("thread_id", "sender").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first_turn"))


# --- Disclosure, ranking and accounting --------------------------------------


@query(f"with {MSG}, e as (select * from m where {word('ing')} and {word('tion')}) select distinct x.message_id from m x join e on x.thread_id = e.thread_id and abs(x.position - e.position) = 1 where x.message_id not in (select message_id from e)")
def floor_members(spark, d):
    m = messages(spark, d)
    e = m.filter(T.has_word(F.col("text"), "ing") & T.has_word(F.col("text"), "tion")).select("message_id", "position")
    return disclosure.floor_members(_links(spark, d), e).select("message_id")


def _components(spark, d) -> DataFrame:
    m = disclosure.nearest_hit(messages(spark, d).withColumn("hit", T.has_word(F.col("text"), "ing"))).filter("not hit")
    near = F.coalesce(F.col("distance") <= disclosure.NEAR_POSITIONS, F.lit(False))
    return m.select("message_id", "thread_id", "position", (F.col("sender") == "user").alias("participant"), T.has_word(F.col("text"), "tion").alias("term"), F.lit(False).alias("temporal"), F.lit(False).alias("temporal_by_query"), near.alias("adjacency"), T.has_word(F.col("text"), "decided").alias("decision"))


@query(f"with {MSG}, h as (select *, {word('ing')} as hit from m), x as (select a.message_id, any_value(a.thread_id) as thread_id, any_value(a.sender = 'user') as participant, any_value({word('tion', 'a.text')}) as term, coalesce(min(abs(a.position - b.position)) <= 2, false) as adjacency, any_value({word('decided', 'a.text')}) as decision from h a left join h b on a.thread_id = b.thread_id and b.hit where not a.hit group by a.message_id), n as (select *, count(*) over w as n, sum(participant::int) over w as p, sum(term::int) over w as t, sum(adjacency::int) over w as a, sum(decision::int) over w as dd from x window w as (partition by thread_id)), s as (select message_id, (participant and p < n)::int * 5 as p5, (term and t < n)::int * 4 as t4, (adjacency and a < n)::int * 2 as a2, (decision and dd < n)::int as d1 from n where true) select message_id, (p5 + t4 + a2 + d1)::bigint as value, (p5 + t4)::bigint as anchored, (p5 + t4 + a2 + d1 > 0 and p5 + t4 > 0) as admitted from s")
def e4_component_scores(spark, d):
    return disclosure.fill_scores(_components(spark, d)).select("message_id", F.col("value").cast("bigint"), F.col("anchored").cast("bigint"), "admitted")


@query(f"with {MSG}, t as (select thread_id, count(*) filter ({word('tion')} and {word('ing')}) as hits, bool_or(sender = 'system') as part from m group by thread_id), v as (select thread_id, ((hits > 0)::int * 5 + part::int * 3 + (hits >= 2)::int)::bigint as value from t) select thread_id, value, row_number() over (order by value desc, thread_id)::bigint as rank from v")
def mechanical_rank(spark, d):
    m = messages(spark, d)
    hit = T.has_word(F.col("text"), "tion") & T.has_word(F.col("text"), "ing")
    t = m.groupBy("thread_id").agg(F.sum(hit.cast("int")).alias("hits"), F.max((F.col("sender") == "system")).alias("participant"))
    t = t.select("thread_id", (F.col("hits") > 0).alias("query_hit"), F.lit(False).alias("unrelaxed"), "participant", F.lit(False).alias("window"), (F.col("hits") >= 2).alias("concentration"))
    return ranking.mechanical_rank(t).select("thread_id", F.col("value").cast("bigint"), F.col("rank").cast("bigint"))


COSINE = "list_cosine_similarity(a.embedding::double[], q.embedding::double[])"


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("message_id"), F.col("embedding").alias("vector"), "label")
    query_vector = e.filter("message_id = 0").first()["vector"]
    return e.filter("message_id <> 0"), query_vector


@query(f"select a.vec_id as message_id, round({COSINE}, 6) as cosine from embeddings a, (select embedding from embeddings where vec_id = 0) q where a.vec_id <> 0 order by {COSINE} desc, a.vec_id limit 25")
def cosine_shortlist_25(spark, d):
    e, q = _vectors(spark, d)
    return ranking.shortlist(e, q).select("message_id", F.round("cosine", 6).alias("cosine"))


@query(f"with s as (select {COSINE} as c from embeddings a, (select embedding from embeddings where vec_id = 0) q where a.vec_id <> 0 order by 1 desc limit 2) select round(max(c) - min(c), 6) as margin, max(c) - min(c) <= 0.05 as ambiguous from s")
def cosine_margin_gate(spark, d):
    e, q = _vectors(spark, d)
    top = ranking.shortlist(e, q, 2)
    gap = F.max("cosine") - F.min("cosine")
    return top.agg(F.round(gap, 6).alias("margin"), (gap <= ranking.MARGIN).alias("ambiguous"))


@query(f"with {MSG}, b as (select thread_id, min(case when {word('ing')} then 0 when sender = 'system' then 1 else 2 end) as priority from m group by 1 order by 2, 1 limit 25) select m.message_id from m join b using (thread_id) order by b.priority, m.thread_id, m.message_id limit 300")
def pool_cap_by_priority(spark, d):
    m = messages(spark, d).withColumn("priority", F.when(T.has_word(F.col("text"), "ing"), 0).when(F.col("sender") == "system", 1).otherwise(2))
    return ranking.pool(m).select("message_id")


@query(f"with {MSG} select message_id from m where {word('ing')} except select message_id from m where {word('tion')}")
def withheld_except_disclosed(spark, d):
    m = messages(spark, d)
    return ledger.withheld(m.filter(T.has_word(F.col("text"), "ing")), m.filter(T.has_word(F.col("text"), "tion")))


def _routes(spark, d):
    m = messages(spark, d)
    a = m.filter(T.has_word(F.col("text"), "ing")).select("message_id", F.lit("L1").alias("rung"), F.lit(1).alias("seq"))
    return a.unionByName(m.filter("position < 3").select("message_id", F.lit("L5").alias("rung"), F.lit(2).alias("seq")))


@query(f"with {MSG}, r as (select message_id, 'L1' as rung from m where {word('ing')} union all select message_id, 'L5' from m where position < 3) select message_id from r group by 1 having bool_and(rung = 'L5') except select message_id from m where sender = 'system'")
def pool_listed_only_forall(spark, d):
    return ledger.pool_only(_routes(spark, d), messages(spark, d).filter("sender = 'system'"))


@query(f"with {MSG}, r as (select message_id, 'L1' as rung, 1 as seq from m where {word('ing')} union all select message_id, 'L5', 2 from m where position < 3), f as (select message_id, arg_min(rung, seq) as rung from r group by 1) select rung, count(*)::bigint as n from f group by rung")
def coverage_by_probe(spark, d):
    return ledger.admit(_routes(spark, d)).groupBy("rung").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {MSG}, w as (select thread_id, case when sender = 'user' then 'a' else 'b' end as cap from m where not {word('ing')}), g as (select thread_id, cap, count(*) as n from w group by all), k as (select *, row_number() over (order by n desc, thread_id, cap) as r from g) select thread_id, cap, n::bigint as n, 1::bigint as groups from k where r <= 24 union all select null, cap, sum(n)::bigint, count(*)::bigint from k where r > 24 group by cap")
def withheld_groups_top24_tail(spark, d):
    m = messages(spark, d).filter(~T.has_word(F.col("text"), "ing")).withColumn("cap", F.when(F.col("sender") == "user", "a").otherwise("b"))
    return ledger.groups(m)


@query(f"with {MSG}, b as (select substr(md5(message_id), 1, 3) as block, sha256(string_agg(message_id, chr(10) order by message_id)) as h from (select distinct message_id from m) group by 1) select sha256(string_agg(h, chr(10) order by block)) as digest from b")
def disposition_digest(spark, d):
    return ledger.digest(messages(spark, d))


@query(f"with {MSG}, s as (select *, not {word('ing')} as stub from m), i as (select thread_id, position, position - row_number() over (partition by thread_id order by position) as g from s where stub) select thread_id, min(position)::bigint as first, max(position)::bigint as last, count(*)::bigint as n from i group by thread_id, g having count(*) >= 2")
def collapsed_runs_islands(spark, d):
    return disclosure.collapsed_runs(messages(spark, d).withColumn("stub", ~T.has_word(F.col("text"), "ing")))


@query(f"with {MSG}, t as (select *, 151 + 2 * len(string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), ' ')) as tokens from m), r as (select message_id, (sum(tokens) over (partition by thread_id order by position rows unbounded preceding))::bigint as running from t) select * from r where running <= 900")
def cumulative_token_budget(spark, d):
    m = messages(spark, d).withColumn("tokens", disclosure.row_tokens(T.count_tokens(F.col("text"))))
    return disclosure.within_budget(m, 900).select("message_id", F.col("running").cast("bigint"))


@query(f"with {MSG}, t as (select thread_id, count(*) as n, count(*) filter ({word('ing')}) as hits, max(position) >= 7 as capped from m group by 1) select thread_id, case when capped then 'inconclusive' when hits > 0 then 'answered' else 'not_found' end as outcome from t")
def outcome_case(spark, d):
    t = messages(spark, d).groupBy("thread_id").agg(F.sum(T.has_word(F.col("text"), "ing").cast("int")).alias("hits"), (F.max("position") >= 7).alias("capped"))
    return t.select("thread_id", F.when(F.col("capped"), "inconclusive").when(F.col("hits") > 0, "answered").otherwise("not_found").alias("outcome"))


@query("select conv_id as view, turn as position, ((row_number() over (partition by conv_id order by turn) - 1) // 3)::bigint as page from conversations")
def fixed_page_numbers(spark, d):
    m = messages(spark, d)
    return m.select(F.col("thread_id").alias("view"), "position", F.expr("(row_number() over (partition by thread_id order by position) - 1) div 3").alias("page"))


# --- Graph -------------------------------------------------------------------


@query("with e as (select 'reply_to' as relation from conversations c join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1 union all select 'thread_member' from conversations union all select 'authored_by' from conversations) select relation, count(*)::bigint as n from e group by relation")
def edge_counts_by_relation(spark, d):
    people = messages(spark, d).select("message_id", F.col("sender").alias("address"), F.lit("author").alias("role"))
    return graph.observed_edges(_links(spark, d), people).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("with c as (select conv_id as source, turn as target from conversations), n as (select *, count(*) over (partition by source) as n from c) select source, target, round(1.0::double / n, 4) as confidence from n where n between 2 and 4")
def inferred_one_over_n(spark, d):
    m = messages(spark, d).select(F.col("thread_id").alias("source"), F.col("position").alias("candidate"))
    return graph.inferred_edges(m).select("source", "target", "confidence")


@query("select a.doc_id as node_id from documents a join documents b on a.doc_id = b.doc_id where md5(a.text) is distinct from md5(case when b.doc_id % 10 = 0 then b.text || 'x' else b.text end)")
def version_conflicts(spark, d):
    docs = table(spark, d, "documents")
    a = docs.select(F.col("doc_id").alias("node_id"), F.md5(F.col("text").cast("binary")).alias("revision"))
    later = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return graph.conflicts(a, docs.select(F.col("doc_id").alias("node_id"), F.md5(later.cast("binary")).alias("revision")))


@query("select 'node' as part, o_custkey as a, 0::bigint as b from orders union select 'node', c_custkey, 0 from customer union select 'edge', o_custkey, o_orderkey from orders union select 'edge', c_custkey, c_nationkey from customer")
def merge_union_distinct(spark, d):
    """Customers by their orders and customers by their nation, both tables whole: the cap is one that neither can reach."""
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    node = lambda c: (F.col(c).alias("node_id"), F.lit(1).alias("revision"))
    edge = lambda a, b: (F.concat_ws("/", F.lit(b), a, b).alias("edge_id"), F.col(a).alias("source"), F.col(a).alias("target"), F.col(b).cast("long").alias("what"))
    first, then = orders.select(*node("o_custkey")).distinct(), customers.select(*node("c_custkey")).distinct()
    nodes, edges = graph.merge(first, orders.select(*edge("o_custkey", "o_orderkey")), then, customers.select(*edge("c_custkey", "c_nationkey")), 1 << 62)
    return nodes.select(F.lit("node").alias("part"), F.col("node_id").alias("a"), F.lit(0).cast("long").alias("b")).union(edges.select(F.lit("edge"), "source", "what").distinct())


@query("select user_id as node_id, case when user_id % 7 = 0 then 'unverifiable' when user_id % 5 = 0 then 'gone' when user_id % 3 = 0 then 'stale' else 'fresh' end as freshness from (select distinct user_id from events)")
def graph_freshness(spark, d):
    n = feed(spark, d).select(F.col("thread_id").alias("node_id")).distinct().withColumn("revision", F.lit(1))
    now = n.filter("node_id % 7 <> 0").select("node_id", F.when(F.col("node_id") % 3 == 0, 2).otherwise(1).alias("revision"), (F.col("node_id") % 5 == 0).alias("deleted"))
    return graph.freshness(n, now)


@query("select doc_id, substr(sha256(lang || chr(31) || source), 1, 16) as token from documents")
def view_token_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.concat_ws("\x1f", "lang", "source"), 256), 1, 16).alias("token"))


# --- Change feed -------------------------------------------------------------


@query("select user_id as thread_id, event_type, count(*)::bigint as n from events where event_id > user_id * 10 group by all")
def liveness_since_floor(spark, d):
    from lantern.streaming.feed import liveness

    f = feed(spark, d)
    return liveness(f, f.select("thread_id").distinct().withColumn("floor", F.col("thread_id") * 10))


@query("select user_id as thread_id, count(*) filter (event_type = 'click')::bigint as click, count(*) filter (event_type = 'view')::bigint as view, count(*) filter (event_type = 'error')::bigint as error from events group by 1")
def change_counts_by_type(spark, d):
    return feed(spark, d).groupBy("thread_id").pivot("event_type", ["click", "view", "error"]).agg(F.count(F.lit(1))).na.fill(0)


@query("select event_id as key from events where timestamp '2024-01-31' - ts >= interval 1 day")
def ttl_expired_entries(spark, d):
    from lantern.streaming.feed import expired

    f = feed(spark, d).select(F.col("history_id").alias("key"), F.col("ts_us").alias("written_us"))
    return expired(f, int(NOW.timestamp() * 1e6), 86_400_000_000).select("key")


@query("select event_id as key from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as r from events) where r <= 32")
def lru_keep_n(spark, d):
    w = W.partitionBy("event_type").orderBy(F.desc("ts_us"), F.desc("history_id"))
    return feed(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 32").select(F.col("history_id").alias("key"))


@query("select event_type, json_extract(props, '$.k')::bigint as k, count(*)::bigint as n from events group by all")
def json_props_extract(spark, d):
    return feed(spark, d).groupBy("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_type, time_bucket(interval 1 hour, ts) as hour, count(*)::bigint as n, round(sum(value), 4) as value from events group by all")
def tumbling_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour")["start"].alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query(None)
def streamed_windows(spark, d):
    """The same windows through Structured Streaming, run to the end of what is there."""
    import uuid

    from lantern.streaming import feed as stream

    # The reader takes folders; the glob holds the one table.
    e = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet(d)
    e = e.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    name = f"w{uuid.uuid4().hex}"
    out = stream.run_to_end(stream.windows(e), name, f"{shared_folder(spark)}/{name}", "complete")
    return out.select("event_type", F.col("w.start").alias("hour"), "n", "value")


# --- Evaluation --------------------------------------------------------------


@query("select event_type, quantile_disc(value, 0.9) as p90 from events group by 1")
def p90_nearest_rank_by_stratum(spark, d):
    return evaluation.p90(feed(spark, d), "event_type", "value")


@query("with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as w from documents), t as (select doc_id, len(w) as l, len(list_filter(w, lambda x: x = 'that')) as a, len(list_filter(w, lambda x: x = 'license')) as b from w), s as (select count(*) as n, avg(l) as avgl, sum((a > 0)::int) as da, sum((b > 0)::int) as db from t) select doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * l / avgl)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * l / avgl)), 6) as score from t, s where a + b > 0")
def bm25_scores(spark, d):
    return evaluation.bm25(table(spark, d, "documents"), ["that", "license"]).select("doc_id", F.round("score", 6).alias("score"))


@query("with r as (select source as case_id, d.doc_id as ref, (predicted) as got from (select *, n_chars > 1000 as predicted from documents) d join labels l using (doc_id) where l.quality = 1) select case_id, round(avg(got::int), 6) as recall, bool_and(got) as strict from r group by 1")
def evidence_recall(spark, d):
    docs = table(spark, d, "documents")
    need = docs.join(table(spark, d, "labels").filter("quality = 1"), "doc_id").select(F.col("source").alias("case_id"), F.col("doc_id").alias("ref"))
    got = docs.filter("n_chars > 1000").select(F.col("source").alias("case_id"), F.col("doc_id").alias("ref"))
    return evaluation.recall(need, got).select("case_id", F.round("recall", 6).alias("recall"), "strict")


@query("with c as (select source, count(*) as n, sum(quality) as k from documents join labels using (doc_id) group by 1), p as (select *, k::double / n as p from c) select source, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as lo, round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as hi from p")
def wilson_interval(spark, d):
    c = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("k"))
    lo, hi = evaluation.wilson(F.col("k"), F.col("n"))
    return c.select("source", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("select quality, toxic, count(*)::bigint as n from labels group by all")
def label_confusion(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("select min(doc_id)::bigint as doc_id, count(*)::bigint as n from documents group by md5(text) having count(*) > 1")
def duplicates_exact(spark, d):
    return table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("h")


@query("select round(avg(case when l.quality = 1 then (d.n_chars <= 1000)::int end), 6) as false_not_found from documents d join labels l using (doc_id)")
def false_not_found_rate(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return j.agg(F.round(F.avg(F.when(F.col("quality") == 1, (F.col("n_chars") <= 1000).cast("int"))), 6).alias("false_not_found"))


@query("select coalesce(a.source, b.source) as source, a.n as before, b.n as after from (select source, count(*)::bigint as n from documents where n_chars <= 1500 group by 1) a full join (select source, count(*)::bigint as n from documents where n_chars > 1500 group by 1) b on a.source = b.source where a.n is distinct from b.n")
def arm_full_outer_diff(spark, d):
    """Short and long documents by source: between them the arms hold every row."""
    docs = table(spark, d, "documents")
    count = lambda rows, name: rows.groupBy("source").agg(F.count(F.lit(1)).alias(name))
    return evaluation.differences(count(docs.filter("n_chars <= 1500"), "before"), count(docs.filter("n_chars > 1500"), "after"), "source")


# --- General relational operators --------------------------------------------


def _sql(name: str, sql: str, spark_sql: str | None = None) -> None:
    """A query in SQL that Spark and the oracle both take, over views of the tables it names."""
    import re

    names = set(re.findall(r"\b(region|nation|customer|supplier|part|orders|lineitem|events|documents|labels)\b", sql))

    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(re.sub(r"\b(" + "|".join(names) + r")\b(?!\.)", lambda m: f"{{{m[1]}}}", spark_sql or sql), **{n: table(spark, d, n) for n in names})

    run.__name__ = name
    QUERIES[name], ORACLE[name] = run, sql


_sql("q1_pricing_summary", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus")
_sql("q3_top_orders", "select o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' group by o_orderkey order by revenue desc, o_orderkey limit 10")
_sql("q5_nation_revenue", "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name")
_sql("left_join_counts", "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by c_custkey")
_sql("semi_join", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
_sql("anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
_sql("cube_counts", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
_sql("rollup_counts", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
_sql("grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
_sql("distinct_aggregate", "select l_returnflag, count(distinct l_suppkey) as suppliers, count(distinct l_partkey) as parts from lineitem group by l_returnflag")
_sql("ranked_windows", "select o_orderkey, cast(rank() over (partition by o_custkey order by o_totalprice desc) as bigint) as r, cast(dense_rank() over (partition by o_custkey order by o_orderpriority) as bigint) as dr, cast(ntile(4) over (partition by o_custkey order by o_orderkey) as bigint) as q from orders")
_sql("lag_lead", "select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as prev, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as nxt from orders")
_sql("moving_frame", "select o_orderkey, round(avg(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row), 4) as ma from orders")
_sql("top_k_per_group", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) x where r <= 3")
_sql("set_operations", "select c_nationkey as k from customer where c_acctbal > 9000 intersect select s_nationkey from supplier union select n_nationkey from nation where n_regionkey = 1 except select n_nationkey from nation where n_nationkey > 22")
_sql("scalar_subquery", "select c_custkey from customer where c_acctbal > (select avg(c_acctbal) from customer)")
_sql("pivot_status", "select o_orderpriority, count(case when o_orderstatus = 'F' then 1 end) as f, count(case when o_orderstatus = 'O' then 1 end) as o from orders group by o_orderpriority")
