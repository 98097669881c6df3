"""Queries on metrics, evaluation, personas, sources and change streams in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import evaluate, metrics, search
from evigraph.plans.common import literal_rows, query, values_sql
from evigraph.plans.retrieval import DOCS, WEIGHTS, bm25_sql, chunk_rows
from evigraph.sources import personas
from evigraph.sources.tables import EDGES_SQL, FILES_SQL, METRICS_SQL, NODES_SQL, edges, files, nodes, table
from evigraph.sources.tables import metrics as metric_log
from evigraph.streaming import changes


@query(f"with {NODES_SQL}, {EDGES_SQL}, {FILES_SQL}, {METRICS_SQL} select 'files' as name, count(*) as n from files union all select 'nodes', count(*) from nodes union all select 'edges', count(*) from edges union all select 'metrics', count(*) from metrics")
def index_stats(spark, d):
    return metrics.counts({"files": files(spark, d), "nodes": nodes(spark, d), "edges": edges(spark, d), "metrics": metric_log(spark, d)})


@query(f"with {NODES_SQL} select kind, count(*) as n from nodes group by kind")
def kind_histogram(spark, d):
    return metrics.histogram(nodes(spark, d), "kind")


@query(f"with {FILES_SQL} select ceil(sum(size_bytes) / 3.6::double)::bigint as tokens from files")
def token_estimate(spark, d):
    return metrics.token_estimate(files(spark, d))


LOG = f"{METRICS_SQL}, log as (select *, k * 13 as estimated_tokens, k % 9 as result_count from metrics)"


def log(spark, d):
    return metric_log(spark, d).withColumns({"estimated_tokens": F.col("k") * 13, "result_count": F.col("k") % 9})


@query(f"with {LOG} select operation, count(*) as n, round(avg(duration_ms), 6) as avg_duration_ms, round(avg(estimated_tokens), 6) as avg_tokens, round(avg(result_count), 6) as avg_results from log group by operation")
def metrics_summary(spark, d):
    return metrics.summary(log(spark, d))


@query(f"with {LOG} select operation, round(avg(duration_ms), 6) as mean, min(duration_ms) as min, round(quantile_cont(duration_ms, 0.5), 6) as p50, round(quantile_cont(duration_ms, 0.95), 6) as p95, round(quantile_cont(duration_ms, 0.99), 6) as p99, max(duration_ms) as max from log group by operation")
def latency_percentiles(spark, d):
    return metrics.latencies(log(spark, d))


SAVINGS = """s as (select {by} count(*) as context_requests, sum(case when coalesce(k % 5, 0) = 0 then 500 else k * 11 end)::bigint as baseline_tokens, sum(k * 13 % 400)::bigint as tokens_delivered, sum((k % 4 = 0)::int)::bigint as cache_hits,
  round(coalesce(avg(case when k % 3 = 0 then null else k / 100.0::double end), 0), 3) as average_confidence from metrics where operation = 'context' {group}),
t as (select *, greatest(0, baseline_tokens - tokens_delivered) as tokens_avoided from s)
select *, case when baseline_tokens > 0 then round(tokens_avoided / baseline_tokens::double, 4) else 0 end as savings_rate, case when context_requests > 0 then round(cache_hits / context_requests::double, 4) else 0 end as cache_hit_rate from t"""


def contexts(spark, d):
    k = F.col("k")
    return metric_log(spark, d).filter("operation = 'context'").select("repository", (k * 13 % 400).alias("delivered"), F.when(k % 5 != 0, k * 11).alias("baseline"), (k % 4 == 0).alias("cache_hit"), F.when(k % 3 != 0, k / 100.0).alias("confidence"))


@query(f"with {METRICS_SQL}, " + SAVINGS.format(by="repository,", group="group by repository"))
def savings_rollup(spark, d):
    return metrics.savings(contexts(spark, d), ["repository"], F.lit(500))


@query(f"with {METRICS_SQL}, " + SAVINGS.format(by="", group=""))
def fleet_overview(spark, d):
    return metrics.savings(contexts(spark, d), [], F.lit(500))


@query("select sum((event_type = 'error')::int)::bigint as error, sum((event_type = 'click')::int)::bigint as warning, sum((event_type not in ('error', 'click'))::int)::bigint as info from events")
def severity_counts(spark, d):
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning").otherwise("info")
    return metrics.severity_counts(table(spark, d, "events").select(kind.alias("severity")))


EVAL = [("c1", "erthat onthese src3"), ("c2", "nicht heit"), ("c3", "zzzz"), ("c4", "le et pour")]
EVAL_SQL = bm25_sql(DOCS, WEIGHTS, EVAL).replace("select query, doc, score, rank::int", ", got as (select query, doc, score, rank::int", 1) + """),
want as (select query, doc_id as doc from queries, documents where (query = 'c1' and source = 'src3') or (query = 'c2' and lang = 'de' and doc_id < 200) or (query = 'c4' and lang = 'fr' and doc_id < 100)),
both_sides as (select query, doc, rank, want.doc is not null as wanted from got full join want using (query, doc)),
cs as (select query as "case", count(rank) as n_got, sum(wanted::int) as n_want, sum((wanted and rank is not null)::int) as n_hit, min(case when wanted then rank end) as first from both_sides group by query),
bad as (select query as "case", count(*) as forbidden_hits from got where doc % 50 = 0 group by query),
r as (select cs."case", case when n_got > 0 then round(n_hit / n_got::double, 3) end as precision, case when n_want > 0 then round(n_hit / n_want::double, 3) end as recall, case when n_want > 0 then round(coalesce(1.0::double / first, 0), 3) end as rr, coalesce(forbidden_hits, 0) as forbidden_hits from cs left join bad on bad."case" = cs."case")"""


def eval_cases(spark, d):
    got = search.search(chunk_rows(spark, d), "doc", WEIGHTS, literal_rows(spark, EVAL, "query string, text string"))
    docs = table(spark, d, "documents")
    c = lambda name, cond: docs.filter(cond).select(F.lit(name).alias("case"), F.col("doc_id").alias("item"))
    want = c("c1", "source = 'src3'").union(c("c2", "lang = 'de' and doc_id < 200")).union(c("c4", "lang = 'fr' and doc_id < 100"))
    got = got.select(F.col("query").alias("case"), F.col("doc").alias("item"), "rank")
    return evaluate.cases(got, want, got.filter("item % 50 = 0"))


@query(EVAL_SQL + " select * from r")
def eval_precision_recall_mrr(spark, d):
    return eval_cases(spark, d)


@query(EVAL_SQL + """, m as (select count(*) as cases, round(avg(precision), 3) as file_precision, round(avg(recall), 3) as file_recall, round(avg(rr), 3) as mrr, sum(forbidden_hits) as forbidden_hits from r)
select 'file_precision' as metric, 'min' as bound, 0.4::double as limit_value, file_precision as value, coalesce(file_precision >= 0.4, false) as passed from m union all select 'file_recall', 'min', 0.9, file_recall, coalesce(file_recall >= 0.9, false) from m
union all select 'mrr', 'min', 0.8, mrr, coalesce(mrr >= 0.8, false) from m union all select 'forbidden_hits', 'max', 0, forbidden_hits::double, coalesce(forbidden_hits <= 0, false) from m""")
def eval_gates(spark, d):
    return evaluate.gates(evaluate.totals(eval_cases(spark, d)))


ROUTED = [("t1", "Review this pull request diff"), ("t2", "Add unit tests for OrderService"), ("t3", "Fix the exception in checkout"), ("t4", "Document the README and docs"), ("t5", "Create a FastAPI endpoint in python"), ("t6", "hello"), ("t7", "Build an android screen"), ("t8", "Explain the architecture and workflow"), ("t9", "Prepare the release changelog"), ("t10", "Implement the feature")]
PATTERNS = [(p, t.casefold()) for p, ts in personas.TRIGGERS.items() for t in ts]
SIGNAL_ROWS = [(p, rf"(^|[^A-Za-z0-9_])({x})($|[^A-Za-z0-9_])", 0.8 + 1.5 * (p in personas.INTENTS)) for p, x in personas.SIGNALS]
SPECIAL = ", ".join(f"'{p}'" for p in personas.SPECIALISTS)


@query("with " + values_sql(ROUTED, "tasks", "query, text") + ", " + values_sql(PATTERNS, "trig", "persona, word") + ", " + values_sql(SIGNAL_ROWS, "sig", "persona, pattern, bonus") + f""", low as (select query, replace(lower(text), 'ß', 'ss') as low, text from tasks), p as (select distinct persona from trig),
called as (select query, persona, count(*)::double as score from low, trig where regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_])' || replace(word, '.', '\\.') || '($|[^\\p{{L}}\\p{{N}}_])') group by query, persona),
bonus as (select query, persona, sum(bonus)::double as bonus from low, sig where regexp_matches(low, pattern) group by query, persona),
g as (select low.query, p.persona, low, coalesce(score, 0) as score, coalesce(bonus, 0) as bonus, score is not null and p.persona in ({SPECIAL}) as special from low cross join p left join called on called.query = low.query and called.persona = p.persona left join bonus on bonus.query = low.query and bonus.persona = p.persona),
h as (select *, bool_or(special) over (partition by query) as any_special from g),
t as (select query, persona, score + case when special then 1.25 else 0 end + bonus + case when persona = 'developer' and regexp_matches(low, '\\b(?:implement|add|create|build|refactor|change)\\b') and not regexp_matches(low, '\\b(?:add|write|create|implement)\\s+(?:unit\\s+|integration\\s+)?tests?\\b') and not any_special then 0.65 else 0 end as total from h),
r as (select *, row_number() over w as n, coalesce(lead(total) over w, 0) as second from t window w as (partition by query order by round(total::double, 6) desc, persona))
select query, case when total <= 0 then 'developer' else persona end as persona, round(case when total <= 0 then 0 else least(1.0, 0.55 + (total - second) / greatest(1.0, total + second)) end::double, 3) as confidence from r where n = 1""")
def persona_route(spark, d):
    return personas.route(literal_rows(spark, ROUTED, "query string, text string"))


@query("""with t as (select conv_id, turn, text, replace(lower(text), 'ß', 'ss') as low from conversations), p as (select *, case when contains(low, 'architecture') or contains(low, 'workflow') or contains(low, 'cross-module') or contains(low, 'cross module') or contains(low, 'migration') or contains(low, 'system-wide') then 'deep'
  when regexp_matches(text, '\\b[A-Z][A-Za-z0-9_]{2,}\\b') and len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 12 then 'eco' else 'balanced' end as profile from t)
select conv_id, turn, profile, case profile when 'eco' then 1800 when 'deep' then 6000 else 2400 end as tokens, case profile when 'eco' then 2 when 'deep' then 4 else 3 end as per_file, case profile when 'eco' then 1 when 'deep' then 3 else 2 end as depth from p""")
def profile_apply(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", personas.resolve_profile(F.col("text"), ascii_words=True).alias("profile"))
    tokens, per_file, depth = personas.profile_columns(F.col("profile"), F.lit(2400), F.lit(3), F.lit(2))
    return t.select("conv_id", "turn", "profile", tokens.alias("tokens"), per_file.alias("per_file"), depth.alias("depth"))


@query("select time_bucket(interval 1 hour, ts)::varchar as bucket, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def event_tumbling(spark, d):
    rows = changes.windowed(changes.timed(table(spark, d, "events"), "ts"), "1 hour")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start_at, count(*) as n from s group by user_id, session""")
def event_sessions(spark, d):
    rows = changes.sessions(changes.timed(table(spark, d, "events"), "ts"), "30 minutes")
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start_at"), "n")


@query()
def debounced_changes(spark, d):
    """Each user's events as changes of paths, in batch: flushes of the coalescer, which debounces by user."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("repository"), F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string")).alias("path"), F.element_at(F.array(*[F.lit(x) for x in ("added", "modified", "deleted")]), (F.col("event_id") % 3 + 1).cast("int")).alias("change"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return changes.coalesced(e.withColumn("at", F.col("at") / 1e6), 3600.0, 4 * 3600.0)
