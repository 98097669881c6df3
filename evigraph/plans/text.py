"""Queries on text functions, routes and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.functions import classify, routes, scores, text
from evigraph.plans.common import literal_rows, query, values_sql
from evigraph.sources.tables import table

STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
CASEFOLD = "replace(lower({}), 'ß', 'ss')"
FOLD = f"translate(lower({{}}), '{text.MARKED}', '{text.PLAIN}')"


def conversations(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "text")


@query(rf"""with w as (select conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_.$/-]+'), lambda x: regexp_replace(x, '^[.$/-]+|[.$/-]+$', '', 'g')), lambda x: x <> '') as words from conversations),
c as (select conv_id, turn, list_filter(flatten(list_transform(words, lambda x: list_concat([x], string_split(regexp_replace(x, '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' '), case when contains(x, '.') then list_filter(string_split(x, '.'), lambda p: p <> '') else [] end))),
  lambda x: length({CASEFOLD.format('x')}) >= 2 and {CASEFOLD.format('x')} not in ({STOP})) as k from w)
select conv_id, turn, array_to_string(list_filter(k, lambda x, i: list_position(list_transform(k, lambda y: {CASEFOLD.format('y')}), {CASEFOLD.format('x')}) = i), ' ') as terms from c""")
def search_terms(spark, d):
    return conversations(spark, d).select("conv_id", "turn", F.array_join(text.search_terms(F.col("text")), " ").alias("terms"))


@query(rf"""with w as (select conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_.$/-]+'), lambda x: regexp_replace(x, '^[.$/-]+|[.$/-]+$', '', 'g')), lambda x: length({CASEFOLD.format('x')}) >= 3 and {CASEFOLD.format('x')} not in ({STOP})) as k from conversations)
select conv_id, turn, array_to_string(list_filter(k, lambda x, i: list_position(list_transform(k, lambda y: {CASEFOLD.format('y')}), {CASEFOLD.format('x')}) = i), ' ') as terms from w""")
def exact_terms(spark, d):
    return conversations(spark, d).select("conv_id", "turn", F.array_join(text.exact_terms(F.col("text")), " ").alias("terms"))


@query(rf"""select conv_id, turn, array_to_string(list_slice(list_filter(regexp_extract_all({CASEFOLD.format('text')}, '[\p{{L}}\p{{N}}_.\-]+'), lambda x: length(x) > 1), 1, 20), ' ') as tokens from conversations""")
def fts_tokens(spark, d):
    return conversations(spark, d).select("conv_id", "turn", F.array_join(text.query_tokens(F.col("text")), " ").alias("tokens"))


@query(rf"""with t as (select doc_id, unnest(regexp_extract_all({FOLD.format("coalesce(text, '')")}, '[\p{{L}}\p{{N}}]+')) as tok from documents)
select tok, count(*) as tf, count(distinct doc_id) as df from t group by tok""")
def index_vocabulary(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(text.index_tokens(F.coalesce("text", F.lit("")))).alias("tok"))
    per_doc = t.groupBy("tok", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("tok").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


@query("select doc_id, md5(trim(replace(replace(lower(text), 'ß', 'ss'), '\\', '/'))) as normalized from documents")
def normalize_search(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_search(F.col("text"))).alias("normalized"))


@query("""select doc_id, case when coalesce(text, '') = '' then 0 else greatest(1, ceil(strlen(text) / 3.6::double))::bigint end as tokens from documents""")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


PATHS = [(f"src/main/{n}{s}",) for n, s in zip(("App", "util.test", ".hidden", "Makefile", "a.b/c", "X"), (".JAVA", ".py", ".md", "", "", ".properties"), strict=True)] + [(f"f{i}{s}",) for i, s in enumerate(text.LANGUAGES)]


@query("with " + values_sql(PATHS, "p", "path") + ", m(suffix, language) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in text.LANGUAGES.items()) + r""")
select path, coalesce(language, 'text') as language from p left join m on suffix = lower(regexp_extract(path, '[^/.][^/]*?(\.[^./]+)$', 1))""")
def language_map(spark, d):
    return literal_rows(spark, PATHS, "path string").select("path", text.language_of(F.col("path")).alias("language"))


NAMES = [("com.acme.Pay#run/2", "method"), ("com.acme", "package"), ("Alone", "class"), ("a.b.C", "class"), ("x#y.z", "method")]


@query("with " + values_sql(NAMES, "n", "qn, kind") + r""", o as (select qn, kind, lower(split_part(qn, '#', 1)) as owner from n)
select qn, kind, case when kind = 'package' then owner when contains(owner, '.') then regexp_replace(owner, '\.[^.]*$', '') else '' end as package from o""")
def package_name(spark, d):
    return literal_rows(spark, NAMES, "qn string, kind string").select("qn", "kind", text.package_name(F.col("qn"), F.col("kind")).alias("package"))


ROUTE = r"""regexp_replace(regexp_replace(split_part(split_part(case when contains({0}, '://') then regexp_replace({0}, '^[^:/?#]*://[^/?#]*', '') else {0} end, '?', 1), '#', 1), '\{{[^}}/]+\}}|:[A-Za-z_]\w*|\$\{{[^}}]+\}}|<[^>/]+>|\[[A-Za-z_]\w*\]', '{{}}', 'g'), '/+', '/', 'g')"""
CANONICAL = "case when length(case when starts_with({0}, '/') then {0} else '/' || {0} end) > 1 then regexp_replace(case when starts_with({0}, '/') then {0} else '/' || {0} end, '/+$', '') else '/' end"


@query(r"with t as (select page_id, regexp_replace(trim(url), '^[""'']+|[""'']+$', '', 'g') as u from pages), r as (select page_id, ".replace('""', '"') + ROUTE.format("u") + " as x from t) select page_id, " + CANONICAL.format("x") + " as route from r")
def canonical_route(spark, d):
    return table(spark, d, "pages").select("page_id", routes.canonical_route(F.col("url")).alias("route"))


ROUTES = [("", "users/:id"), ("/api/", "/orders/{orderId}/"), ("api", ""), ("/api", "/"), ("/v1//x", "<int:pk>/y?q=1"), ("http://h:8080/base", "[slug]")]


@query("with " + values_sql(ROUTES, "r", "prefix, route") + r""", j as (select prefix, route, case when prefix = '' then route when route in ('', '/') then prefix else regexp_replace(prefix, '/+$', '') || '/' || regexp_replace(route, '^/+', '') end as u from r),
x as (select prefix, route, """ + ROUTE.format("u") + " as x from j) select prefix, route, 'GET ' || " + CANONICAL.format("x") + " as contract from x")
def route_join(spark, d):
    return literal_rows(spark, ROUTES, "prefix string, route string").select("prefix", "route", routes.http_contract(F.lit("get"), routes.join_routes(F.col("prefix"), F.col("route"))).alias("contract"))


TESTS = [("OrderServiceTest",), ("OrderIT",), ("PayTests",), ("PayIntegrationTest",), ("Plain",), ("Test",)]


@query("with " + values_sql(TESTS, "n", "name") + """ select name, case when ends_with(name, 'IntegrationTest') then left(name, length(name) - 15) when ends_with(name, 'IT') then left(name, length(name) - 2)
  when ends_with(name, 'Tests') then left(name, length(name) - 5) when ends_with(name, 'Test') then left(name, length(name) - 4) else name end as production from n""")
def production_name(spark, d):
    return literal_rows(spark, TESTS, "name string").select("name", classify.production_name(F.col("name")).alias("production"))


LAYER = "case " + " ".join(f"when {' or '.join(f'contains(x, {w!r})' for w in words)} then '{layer}'" for layer, words in classify.GENERIC_LAYERS) + " else 'domain' end"


@query(f"with n as (select page_id, url, replace(lower('p' || page_id || ' ' || url), 'ß', 'ss') as x from pages) select page_id, {LAYER} as layer from n")
def layer_classify(spark, d):
    return table(spark, d, "pages").select("page_id", classify.generic_layer(F.concat(F.lit("p"), F.col("page_id").cast("string")), F.col("url")).alias("layer"))


TAGS = "list_sort(list_distinct(flatten([" + ", ".join(f"case when {' or '.join(f'contains(x, {w!r})' for w in words)} then {list(tags)} else [] end" for words, tags in classify.TAG_TRIGGERS) + "])))"


@query(f"with c as (select conv_id, turn, replace(lower(text), 'ß', 'ss') as x from conversations) select conv_id, turn, array_to_string({TAGS}, ',') as tags from c")
def requested_tags(spark, d):
    return conversations(spark, d).select("conv_id", "turn", F.array_join(classify.requested_tags(F.col("text")), ",").alias("tags"))


@query("""select doc_id, case when contains(lower(source || '/' || doc_id), '/test/') or doc_id % 11 = 0 then 'test' when doc_id % 5 = 0 then 'configuration' when doc_id % 5 = 1 then 'database' when doc_id % 5 = 2 then 'documentation' else 'source' end as kind from documents""")
def context_type(spark, d):
    docs = table(spark, d, "documents")
    language = F.element_at(F.array(*[F.lit(x) for x in ("yaml", "sql", "markdown", "java", "python")]), (F.col("doc_id") % 5 + 1).cast("int"))
    tags = F.when(F.col("doc_id") % 11 == 0, F.array(F.lit("Test"))).otherwise(F.array(F.lit("service")))
    return docs.select("doc_id", classify.context_type(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), language, tags).alias("kind"))


SECRET = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----[\\s\\S]*?-----END [A-Z ]*PRIVATE KEY-----', '<REDACTED:private_key>', 'g'), '\\b(?:AKIA|ASIA)[0-9A-Z]{16}\\b', '<REDACTED:aws_access_key>', 'g'), '\\bgh[pousr]_[A-Za-z0-9]{36,}\\b', '<REDACTED:github_token>', 'g'), '(?i)\\b(api[_-]?key|secret|token|password|passwd)(\\s*[:=]\\s*)(["''])([^"''\\s]{8,})(["''])', '\\1\\2\\3<REDACTED:generic_secret>\\5', 'g')"""


@query(f"select doc_id, md5({SECRET}) as redacted, {SECRET} <> text as changed from documents")
def secret_redaction(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(text.redact_secrets(F.col("text"))).alias("redacted"), (text.redact_secrets(F.col("text")) != F.col("text")).alias("changed"))


@query("""with m as (select event_type, count(*) as n, avg(value) as v from events group by event_type), h as (select event_type, n = 0 as empty, v > 60 as degraded, n % 2 = 0 as stale, event_type <> 'error' as fresh from m),
s as (select *, greatest(0, 100 - case when empty then 40 else 0 end - case when degraded then 45 else 0 end - case when stale then 25 else 0 end - case when fresh then 0 else 20 end) as score from h)
select event_type, case when degraded or score < 45 then 'critical' when stale or not fresh then 'attention' else 'healthy' end as state, score::int as score from s""")
def health_score(spark, d):
    m = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    state, score = scores.health(F.col("n"), F.col("v") > 60, F.col("n") % 2 == 0, F.col("event_type") != "error")
    return m.select("event_type", state.alias("state"), score.cast("int").alias("score"))
