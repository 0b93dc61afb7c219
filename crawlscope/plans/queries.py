"""The library's queries on the driver's tables, each beside its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlscope.functions import text as T
from crawlscope.functions import urls as U
from crawlscope.functions.html import page_content, page_metadata, page_title
from crawlscope.operators import classify as C
from crawlscope.operators import domains as D
from crawlscope.operators import fetching as E
from crawlscope.operators import topics as P
from crawlscope.sources.providers import ask_labels, fetch_pages, hashed_embedding, load_models
from crawlscope.streaming.ingest import windowed_counts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


# SQL of the URL expressions.
_LOC = r"regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"
_DOMAIN = rf"nullif(regexp_replace({_LOC}, '^www\.', ''), '')"
_PATH = r"regexp_replace(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_FRAGMENT = r"regexp_extract(url, '#(.*)$', 1)"
_LANDING = "('" + "','".join("/" + x for x in U.LANDING_FILES + U.LANDING_WORDS) + "')"
_COUNTS = f"SELECT {_DOMAIN} AS domain, count(*) AS count FROM pages WHERE {_DOMAIN} IS NOT NULL GROUP BY 1"


@query(_COUNTS)
def domain_counts(spark, sf_dir):
    return D.ranked(D.domain_counts(table(spark, sf_dir, "pages", "url"), "url"))


@query(f"SELECT count(*) AS distinct_domains, CAST(sum(count) AS BIGINT) AS total_occurrences FROM ({_COUNTS})")
def domain_count_totals(spark, sf_dir):
    return D.count_totals(D.domain_counts(table(spark, sf_dir, "pages", "url"), "url"))


@query(_COUNTS)
def partial_final_merge(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return D.merge_counts(*[D.domain_counts(pages.where(F.pmod("page_id", F.lit(5)) == k), "url") for k in range(5)])


@query(f"SELECT page_id, {_DOMAIN} AS domain, {_PATH} AS path, {_QUERY} AS query, {_FRAGMENT} AS fragment FROM pages")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages", "page_id", "url").select(
        "page_id", U.domain_of(u).alias("domain"), U.url_path(u).alias("path"), U.url_query(u).alias("query"), U.url_fragment(u).alias("fragment")
    )


_FLAGS = f"""SELECT url, {_QUERY} = '' AND {_FRAGMENT} = '' AND
  CASE WHEN starts_with(rtrim({_PATH}, '/'), '/') THEN rtrim({_PATH}, '/') ELSE '/' || rtrim({_PATH}, '/') END IN {_LANDING} AS landing,
  {_PATH} IN ('', '/') AS root FROM """


@query(f"SELECT landing, root, count(*) AS n FROM ({_FLAGS} pages) GROUP BY 1, 2")
def landing_flag_counts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages", "url").groupBy(U.is_landing_page(u).alias("landing"), U.is_domain_root(u).alias("root")).agg(F.count(F.lit(1)).alias("n"))


_SUFFIXES = ["/home", "/index.html/", "/", "", "/Home", "/en/home", "/home?x=1", "/welcome.php#a", "/home;p=1", "/start//"]


@query(
    f"SELECT page_id, url FROM (SELECT page_id, f.* FROM (SELECT page_id, 'http://' || {_DOMAIN} || list_extract({_SUFFIXES}, CAST(page_id % 10 AS INTEGER) + 1) AS url FROM pages) s, LATERAL ({_FLAGS} (SELECT s.url AS url) q) f) WHERE landing OR root"
)
def landing_filter_synth(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.pmod("page_id", F.lit(10)) + 1).cast("int"))
    made = table(spark, sf_dir, "pages", "page_id", "url").select("page_id", F.concat(F.lit("http://"), U.domain_of(F.col("url")), suffix).alias("url"))
    return D.landing_pages(made, "url")


_TOPIC_CLEAN = "regexp_extract(replace(replace(replace(replace(lower(trim(url)), 'https://', ''), 'http://', ''), 'www.', ''), 'm.', ''), '^[^/:?#]*', 0)"
_KEPT = "('" + "','".join(U.KEPT_LABELS) + "')"


@query(
    f"""SELECT page_id, CASE WHEN length(d) > 3 THEN d END AS clean FROM (
  SELECT page_id, CASE WHEN len(l) > 2 AND l[1] NOT IN {_KEPT} THEN array_to_string(l[2:], '.') ELSE x END AS d
  FROM (SELECT page_id, x, string_split(x, '.') AS l FROM (SELECT page_id, {_TOPIC_CLEAN} AS x FROM pages)))"""
)
def clean_domain_topics(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", U.clean_domain_for_topics(F.col("url")).alias("clean"))


_FETCH_CLEAN = r"split_part(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '/', 1)"


@query(f"SELECT page_id, CASE WHEN contains(x, '.') THEN x END AS clean FROM (SELECT page_id, {_FETCH_CLEAN} AS x FROM pages)")
def clean_domain_fetch(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", U.clean_domain_for_fetch(F.col("url")).alias("clean"))


@query(
    rf"""SELECT page_id, x AS domain, CASE WHEN len(l) > 1 THEN array_to_string(l[1:len(l)-1], ' ') ELSE x END AS name,
  CASE WHEN len(l) > 1 THEN l[len(l)] ELSE '' END AS tld
FROM (SELECT page_id, x, string_split(x, '.') AS l FROM (SELECT page_id, lower({_DOMAIN}) AS x FROM pages))"""
)
def domain_features(spark, sf_dir):
    f = U.domain_features(U.domain_of(F.col("url")))
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", f.alias("f")).select("page_id", "f.*")


@query("SELECT page_id, unnest(['https://', 'http://', 'https://www.', 'http://www.']) || d AS url, unnest(range(4))::INTEGER AS step FROM (SELECT page_id, " + _DOMAIN + " AS d FROM pages)")
def candidate_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", F.posexplode(U.candidate_urls(U.domain_of(F.col("url")))).alias("step", "url"))


@query("SELECT doc_id, length(text) AS text_char_count FROM documents")
def text_char_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", T.char_count(docs).alias("text_char_count"))


@query(
    """SELECT round(avg(n_chars), 6) AS mean_chars, quantile_cont(n_chars, 0.5) AS median_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars,
  count(*) FILTER (WHERE n_chars > 0) AS with_text, count(*) FILTER (WHERE n_chars = 0) AS without_text FROM documents"""
)
def char_stats(spark, sf_dir):
    return D.size_stats(table(spark, sf_dir, "documents", "n_chars"), "n_chars")


@query("SELECT lang, text, source, doc_id, length(text) AS text_char_count FROM documents")
def canonical_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text", "lang")
    return D.in_canonical_order(docs.withColumn("text_char_count", T.char_count(docs)))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc, text, lang, NULL AS item FROM documents UNION ALL SELECT NULL, text, NULL, CAST(item_id AS VARCHAR) FROM benchmark")
def schema_evolution_union(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return D.evolve(docs.select(F.col("doc_id").cast("string").alias("doc"), "text", "lang"), items.select(F.col("item_id").cast("string").alias("item"), "text"))


_TITLE = "substr(trim(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')), 1, 500)"


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", page_title(F.col("html")).alias("title"))


# Tags put into every other page: with entities, over the cuts, and an og:description where the description is empty.
_TAGS = [
    ("name", "description", lambda i: F.when(F.pmod(i, F.lit(4)) == 0, F.concat(F.lit("d"), i.cast("string"))).otherwise("")),
    ("name", "keywords", lambda i: F.concat(F.lit("a &amp; b, "), F.repeat(F.lit("k"), 1200))),
    ("property", "og:title", lambda i: F.concat(F.lit("T&lt;"), i.cast("string"), F.repeat(F.lit("t"), 600))),
    ("property", "og:description", lambda i: F.concat(F.lit("og &#39;"), i.cast("string"), F.repeat(F.lit("o"), 1200))),
    ("property", "og:type", lambda i: F.concat(F.lit("article"), F.repeat(F.lit("y"), 200))),
]


@query(
    f"""SELECT page_id, CASE WHEN contains(html, '<title') THEN {_TITLE} END AS title,
  CASE WHEN page_id % 4 = 0 THEN 'd' || page_id WHEN page_id % 2 = 0 THEN substr('og ' || chr(39) || page_id || repeat('o', 1200), 1, 1000) END AS meta_description,
  CASE WHEN page_id % 2 = 0 THEN substr('a & b, ' || repeat('k', 1200), 1, 1000) END AS keywords,
  CASE WHEN page_id % 2 = 0 THEN substr('T<' || page_id || repeat('t', 600), 1, 500) END AS og_title,
  CASE WHEN page_id % 2 = 0 THEN substr('og ' || chr(39) || page_id || repeat('o', 1200), 1, 1000) END AS og_description,
  CASE WHEN page_id % 2 = 0 THEN substr('article' || repeat('y', 200), 1, 100) END AS og_type FROM pages"""
)
def metadata_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    tags = F.concat(*[x for kind, name, made in _TAGS for x in (F.lit(f'<meta {kind}="{name}" content="'), made(F.col("page_id")), F.lit('">'))], F.lit("</head>"))
    html = F.when(F.pmod("page_id", F.lit(2)) == 0, F.replace("html", F.lit("</head>"), tags)).otherwise(F.col("html"))
    return pages.select("page_id", page_metadata(html).alias("m")).select("page_id", "m.*")


@query()
def page_contents(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", page_content(F.col("html")).alias("content"))


@query(
    """SELECT round(100.0 * count(*) FILTER (WHERE coalesce(CAST(quality AS VARCHAR), '') = '') / count(*), 6) AS missing_quality,
  round(100.0 * count(*) FILTER (WHERE coalesce(CAST(toxic AS VARCHAR), '') = '') / count(*), 6) AS missing_toxic,
  round(100.0 * count(*) FILTER (WHERE coalesce(lang, '') = '') / count(*), 6) AS missing_lang FROM documents LEFT JOIN labels USING (doc_id)"""
)
def metadata_completeness(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return D.completeness(docs, ["quality", "toxic", "lang"])


@query(
    """SELECT round(100.0 * count(*) FILTER (WHERE quality = toxic) / count(*) FILTER (WHERE quality IS NOT NULL AND toxic IS NOT NULL), 6) AS same_quality,
  round(100.0 * count(*) FILTER (WHERE quality IS NULL AND toxic IS NOT NULL) / count(*), 6) AS only_toxic
FROM (SELECT CASE WHEN l.doc_id % 3 <> 0 THEN quality END AS quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
)
def metadata_match_rate(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("quality", F.when(F.pmod("doc_id", F.lit(3)) != 0, F.col("quality")))
    return D.agreement(table(spark, sf_dir, "documents", "doc_id").join(labels, "doc_id", "left"), [("quality", "toxic")])


def _answers(spark, sf_dir) -> DataFrame:
    """Events as answers of a crawl: a signup is a 429, an error has no status, what is viewed or bought is found."""
    kind = F.col("event_type")
    status = F.when(kind == "signup", 429).when(kind == "error", F.lit(None).cast("int")).when(kind == "click", 404).otherwise(200)
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value").withColumn("status", status)


_ANSWERS = "(SELECT *, CASE event_type WHEN 'signup' THEN 429 WHEN 'error' THEN NULL WHEN 'click' THEN 404 ELSE 200 END AS status FROM events)"
_CLASS = "CASE WHEN status = 429 THEN 'throttled' WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status IS NULL THEN 'failed' ELSE 'other' END"


@query(f"SELECT {_CLASS} AS outcome, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM {_ANSWERS} GROUP BY 1")
def fetch_outcomes(spark, sf_dir):
    return E.histogram(_answers(spark, sf_dir).select(E.status_class(F.col("status")).alias("outcome")), "outcome")


@query(f"SELECT coalesce(status, 0) AS status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM {_ANSWERS} GROUP BY 1")
def status_histogram(spark, sf_dir):
    return E.histogram(_answers(spark, sf_dir).select(F.coalesce("status", F.lit(0)).alias("status")), "status")


# Of requests without a status, each other one timed out. A look-up of every third is cached.
_REQUESTS = f"(SELECT *, CASE WHEN status IS NULL THEN CASE WHEN event_id % 2 = 0 THEN 'Timeout' ELSE 'Request' END END AS error, event_id % 3 = 0 AS hit FROM {_ANSWERS})"
_STATS = f"""SELECT user_id, count(status) AS answered, count(*) - count(status) AS failed, count(*) FILTER (WHERE status = 429) AS throttled,
  count(*) FILTER (WHERE error = 'Request') AS request_errors, count(*) FILTER (WHERE error = 'Timeout') AS timeouts,
  round(avg(value) FILTER (WHERE status IS NOT NULL), 6) AS mean_seconds, round(100.0 * count(*) FILTER (WHERE hit) / count(*), 6) AS cache_hit_pct FROM {_REQUESTS} GROUP BY user_id"""


def _request_stats(spark, sf_dir) -> DataFrame:
    a = _answers(spark, sf_dir)
    error = F.when(F.col("status").isNull(), F.when(F.pmod("event_id", F.lit(2)) == 0, "Timeout").otherwise("Request"))
    return E.request_stats(a.withColumn("error", error), "user_id", "value", "status", "error", F.pmod("event_id", F.lit(3)) == 0)


@query(_STATS)
def request_stats(spark, sf_dir):
    return _request_stats(spark, sf_dir)


@query(
    f"""SELECT user_id, CASE WHEN answered > 0 THEN array_to_string(list_filter([CASE WHEN mean_seconds > 10 THEN 'slow responses' END,
  CASE WHEN 100.0 * answered / (answered + failed) < 70 THEN 'low success rate' END, CASE WHEN throttled > answered * 0.1 THEN 'throttled' END,
  CASE WHEN request_errors > answered * 0.1 THEN 'request errors' END, CASE WHEN timeouts > answered * 0.2 THEN 'timeouts' END], lambda x: x IS NOT NULL), ', ') END AS found
FROM ({_STATS})"""
)
def error_diagnosis(spark, sf_dir):
    names = ("mean_seconds", "answered", "failed", "throttled", "request_errors", "timeouts")
    return _request_stats(spark, sf_dir).select("user_id", F.array_join(E.diagnosis(*map(F.col, names)), ", ").alias("found"))


@query("SELECT event_id, round(avg(value) OVER w, 8) AS rolling_mean, max(value) OVER w AS rolling_max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def rolling_mean_50(spark, sf_dir):
    return E.rolling(table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value"), "user_id", ["ts", "event_id"], "value", 50).select("event_id", "rolling_mean", "rolling_max")


@query("SELECT event_id, round(coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 6) AS delta FROM events")
def counter_delta(spark, sf_dir):
    return E.deltas(table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value"), "user_id", ["ts", "event_id"], "value").select("event_id", "delta")


@query("SELECT doc_id, CAST(floor((k - 1) / 500) AS BIGINT) AS batch, round(100.0 * k / n, 6) AS done_pct FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents)")
def batch_numbers(spark, sf_dir):
    return D.batches(table(spark, sf_dir, "documents", "doc_id"), "doc_id", 500)


def _centroids(vectors: DataFrame) -> DataFrame:
    each = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("c"))


_CENTROIDS = """cent AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (
  SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"""


@query(f"WITH {_CENTROIDS} SELECT vec_id, arg_max(cent.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c)) AS best FROM embeddings, cent GROUP BY vec_id")
def cosine_top1(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return C.nearest(v.select("vec_id", "embedding"), "embedding", _centroids(v), "label", "c").select("vec_id", "best")


def _votes(spark, sf_dir) -> DataFrame:
    """Three votes for each document, by its id: what three models would say."""
    docs = table(spark, sf_dir, "documents", "doc_id")
    names = F.array(*[F.lit(c.name) for c in C.CATALOGUE])
    one = lambda m, k: F.struct(F.lit(m).alias("model"), F.element_at(names, (F.pmod(F.floor(F.col("doc_id") / k), F.lit(12)) + 1).cast("int")).alias("category"), (F.lit(0.1) * (1 + F.pmod(F.col("doc_id") + m, F.lit(7)))).alias("confidence"))
    return docs.select("doc_id", F.explode(F.array(one(0, 1), one(1, 2), one(2, 3))).alias("v")).select("doc_id", "v.*")


_NAMES = "[" + ",".join(f"'{c.name}'" for c in C.CATALOGUE) + "]"
_VOTES = "(" + " UNION ALL ".join(f"SELECT doc_id, {m} AS model, list_extract({_NAMES}, CAST(doc_id // {k} % 12 AS INTEGER) + 1) AS category, 0.1::DOUBLE * (1 + (doc_id + {m}) % 7) AS confidence FROM documents" for m, k in ((0, 1), (1, 2), (2, 3))) + ")"


@query(
    f"""WITH e AS (SELECT doc_id, category, count(*) AS n, sum(confidence) AS c FROM {_VOTES} GROUP BY 1, 2), t AS (SELECT doc_id, max(n) AS top FROM e GROUP BY 1)
SELECT e.doc_id, CAST(sum(n) AS BIGINT) AS n_votes, count(*) AS n_distinct, max(n) AS top, count(*) FILTER (WHERE n = top) AS n_tied, round(sum(c) / sum(n), 6) AS mean_confidence FROM e JOIN t ON e.doc_id = t.doc_id GROUP BY e.doc_id"""
)
def vote_counts(spark, sf_dir):
    return C.vote_counts(_votes(spark, sf_dir), "doc_id")


def _boosts(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    f = U.domain_features(U.domain_of(F.col("url")))
    rows = pages.select("page_id", f.alias("f"), F.lower(F.col("html")).alias("t"))
    return rows.select("page_id", F.explode(C.rule_boosts(F.col("t"), F.col("f.name"), F.col("f.tld"))).alias("b")).select("page_id", "b.*")


def _boost_sql() -> str:
    def n(col, words):
        return " + ".join([f"contains({col}, '{w}')::INTEGER" for w in words]) or "0"

    rows = [
        f"SELECT page_id, '{c.name}' AS category, {r} AS rank, round(0.3::DOUBLE * ({n('name', c.domains)}) + CASE WHEN tld IN ({','.join(repr(t.lstrip('.')) for t in c.tlds)}) THEN 0.2::DOUBLE ELSE 0 END + least(0.2::DOUBLE, 0.05::DOUBLE * ({n('t', c.keywords)})), 6) AS boost FROM f"
        for r, c in enumerate(C.CATALOGUE)
        if c.name != C.OTHER
    ]
    head = f"WITH g AS (SELECT page_id, lower(html) AS t, string_split(lower({_DOMAIN}), '.') AS l FROM pages), f AS (SELECT page_id, t, array_to_string(l[1:len(l)-1], ' ') AS name, l[len(l)] AS tld FROM g)"
    return f"{head} SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE boost > 0"


@query(_boost_sql())
def rule_boosts(spark, sf_dir):
    return _boosts(spark, sf_dir)


@query(
    f"""WITH b AS (SELECT page_id AS doc_id, category, boost AS points, 1 AS k, rank AS at_, CAST(NULL AS DOUBLE) AS confidence FROM ({_boost_sql()})),
v AS (SELECT doc_id, category, confidence AS points, 0 AS k, model AS at_, confidence FROM {_VOTES} WHERE category <> 'Other'),
s AS (SELECT doc_id, category, round(sum(points), 6) AS score, min(k * 1000 + at_) AS named, avg(confidence) AS c FROM (SELECT * FROM b UNION ALL SELECT * FROM v) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, named) AS k FROM s)
SELECT doc_id, category AS winner, score, round(least(1.0, coalesce(c, 0.5)), 6) AS confidence FROM r WHERE k = 1"""
)
def category_scores(spark, sf_dir):
    return C.category_scores(_votes(spark, sf_dir), _boosts(spark, sf_dir).withColumnRenamed("page_id", "doc_id"), "doc_id")


@query(
    f"""SELECT category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct, round(avg(confidence), 6) AS mean_confidence,
  count(*) FILTER (WHERE confidence > 0.7) AS n_high, starts_with(category, '*') AS conflict, category = 'Other' AS vague FROM {_VOTES} GROUP BY category"""
)
def category_summary(spark, sf_dir):
    return C.summary(_votes(spark, sf_dir))


@query()
def ensemble_decisions(spark, sf_dir):
    """Embeds page titles, votes against the catalogue with three embedders, adds rules, decides; ties are retried up to three times."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    f = U.domain_features(U.domain_of(F.col("url")))
    rows = pages.select("page_id", f.alias("f"), page_title(F.col("html")).alias("title"))
    none = F.lit(None).cast("string")
    rows = rows.withColumn("x", T.classifier_text(F.col("title"), none, none, F.col("f.name")))
    embedders = list(load_models({f"hashed-{k}": [lambda k=k: hashed_embedding(64, k)] for k in range(3)}).values())
    cats = spark.createDataFrame([(c.name, C.category_text(c)) for c in C.CATALOGUE if c.name != C.OTHER], "name string, about string").coalesce(1)
    vectors = [{r["name"]: r["v"] for r in cats.select("name", e("about").alias("v")).collect()} for e in embedders]
    boosts = rows.select("page_id", F.explode(C.rule_boosts(F.lower("x.text"), F.col("f.name"), F.col("f.tld"))).alias("b")).select("page_id", "b.*")
    left = rows.select("page_id", F.col("x.text").alias("text"), F.col("x.has_metadata").alias("has_metadata"))
    found = None
    for attempt in range(4):
        near = [C.nearest_in_catalogue(e(F.substring("text", 1, 3000)), v) for e, v in zip(embedders, vectors, strict=True)]
        votes = left.select("page_id", F.posexplode(F.array(*near)).alias("model", "v")).where(F.col("v.confidence").isNotNull()).select("page_id", "model", "v.*")
        both = left.join(C.vote_counts(votes, "page_id"), "page_id", "left").join(C.category_scores(votes, boosts.join(left.select("page_id"), "page_id", "left_semi"), "page_id"), "page_id", "left")
        d = C.decide(*[F.col(c) for c in ("text", "has_metadata", "n_votes", "n_distinct", "n_tied", "mean_confidence", "winner", "confidence")], F.lit(3 - attempt))
        decided = both.select("page_id", "text", "has_metadata", d.alias("d")).persist()
        done = decided.where(~F.coalesce(F.col("d.retry"), F.lit(False))).select("page_id", "d.category", "d.confidence")
        found = done if found is None else found.unionByName(done)
        left = decided.where(F.col("d.retry")).select("page_id", C.retry_text(F.col("text"), F.col("page_id"), attempt).alias("text"), "has_metadata")
        if left.isEmpty():
            break
    return found


_RESPONSES = ["News & Media", '"travel"', "the best is Sports & Recreation.", "", "nothing", None]


@query(
    f"""WITH r AS (SELECT conv_id, turn, list_extract([{",".join("NULL" if x is None else repr(x) for x in _RESPONSES)}], CAST((conv_id + turn) % 6 AS INTEGER) + 1) AS response FROM conversations),
c AS (SELECT conv_id, turn, response, lower(trim(trim(trim(response), '"'), '''')) AS k FROM r),
m AS (SELECT conv_id, turn, response, k, list_extract(list_filter({_NAMES[:-9]}], lambda x: contains(lower(x), k) OR contains(k, lower(x))), 1) AS hit FROM c)
SELECT conv_id, turn, CASE WHEN k <> '' AND hit IS NOT NULL THEN hit ELSE 'Other' END AS category,
  CAST(CASE WHEN response IS NULL THEN 1.0 WHEN k <> '' AND hit IS NOT NULL THEN 0.8 ELSE 0.5 END AS DOUBLE) AS confidence FROM m"""
)
def llm_label_parse(spark, sf_dir):
    names = [c.name for c in C.CATALOGUE if c.name != C.OTHER]
    said = F.element_at(F.array(*[F.lit(x) for x in _RESPONSES]), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)) + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn").select("conv_id", "turn", T.match_category(said, names).alias("m"))
    return rows.select("conv_id", "turn", "m.*")


_PROMPT_SIZE = sum(map(len, T.prompt_parts([c.name for c in C.CATALOGUE if c.name != C.OTHER])))


@query(
    f"""SELECT page_id, CASE WHEN t IS NULL THEN 'Other' ELSE list_extract({_NAMES}, CAST((length(t) + {_PROMPT_SIZE}) % {len(C.CATALOGUE) - 1} AS INTEGER) + 1) END AS category,
  CAST(CASE WHEN t IS NULL THEN 1.0 ELSE 0.8 END AS DOUBLE) AS confidence
FROM (SELECT page_id, CASE WHEN lower(x) NOT IN ('none', 'null', 'nan', '') THEN x END AS t FROM (SELECT page_id, {_TITLE} AS x FROM pages))"""
)
def llm_labels(spark, sf_dir):
    """Asks a scripted client about every page's title."""
    pages = table(spark, sf_dir, "pages", "page_id", "html").select("page_id", page_title(F.col("html")).alias("title"))
    names = [c.name for c in C.CATALOGUE if c.name != C.OTHER]
    asked = ask_labels(pages, T.label_prompt(T.label_text(pages), names), lambda prompt: names[len(prompt) % len(names)])
    return asked.select("page_id", T.match_category(F.col("response"), names).alias("m")).select("page_id", "m.*")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti_join(spark, sf_dir):
    return D.remaining(table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels", "doc_id"), "doc_id")


@query(f"SELECT page_id, p.domain, count AS domain_times FROM (SELECT page_id, {_DOMAIN} AS domain FROM pages) p JOIN ({_COUNTS}) c ON p.domain = c.domain")
def count_lookup_join(spark, sf_dir):
    pages = D.with_domain(table(spark, sf_dir, "pages", "page_id", "url"), "url")
    return D.look_up_counts(pages.select("page_id", "domain"), D.domain_counts(pages, "url"))


_STOP = "('" + "','".join(P.STOP_WORDS) + "')"
_TERMS = rf"""w AS (SELECT source, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: length(x) > 1 AND x NOT IN {_STOP}) AS w FROM documents),
b AS (SELECT source, doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM w),
e AS (SELECT source AS topic, doc_id, term, count(*) AS n FROM (SELECT source, doc_id, unnest(t) AS term FROM b) GROUP BY ALL)"""


@query(f"WITH {_TERMS} SELECT topic, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS df FROM e GROUP BY topic, term")
def topic_terms(spark, sf_dir):
    return P.terms(table(spark, sf_dir, "documents", "text", "source"), "text", "source")


@query("SELECT source AS topic, count(*) AS document_count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM documents GROUP BY source")
def topic_sizes(spark, sf_dir):
    return E.histogram(table(spark, sf_dir, "documents", F.col("source").alias("topic")), "topic", "document_count")


@query(
    f"""WITH {_TERMS}, c AS (SELECT topic, term, sum(n) AS n FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS k FROM c WHERE NOT contains(term, ' ')),
u AS (SELECT topic, list(upper(term[1]) || substr(term, 2) ORDER BY k) FILTER (WHERE length(term) > 2) AS w FROM r WHERE k <= 4 GROUP BY topic)
SELECT topic, CASE coalesce(len(w), 0) WHEN 0 THEN 'Mixed Content' WHEN 1 THEN w[1] || ' Related' WHEN 2 THEN w[1] || ' & ' || w[2] ELSE w[1] || ', ' || w[2] || ' & Others' END AS name FROM u"""
)
def topic_names(spark, sf_dir):
    counts = P.terms(table(spark, sf_dir, "documents", "text", "source"), "text", "source").where(~F.contains("term", F.lit(" ")))
    w = Window.partitionBy("topic").orderBy(F.desc("n"), "term")
    top = counts.withColumn("k", F.row_number().over(w)).where(F.col("k") <= 4)
    words = top.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda r: r["term"]).alias("ks"))
    return words.select("topic", T.topic_name(F.col("ks")).alias("name"))


@query()
def topic_discovery(spark, sf_dir):
    """Clusters embeddings, takes each member's document by id, and names the topics."""
    v = P.assign_topics(table(spark, sf_dir, "embeddings", F.col("vec_id").alias("doc_id"), "embedding"), "embedding")
    rows = v.select("doc_id", "topic").join(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    n = P.require_population(rows.count())
    # Documents that have a vector may stand together in their file: dealt anew, by so many that a task's terms stay few at any size.
    dealt = rows.repartition(n // 4096 + 8, "doc_id")
    words = P.keywords(P.weighted_terms(P.terms(dealt, "text", "topic"), n), hashed_embedding(64, 9))
    return P.topic_table(rows.groupBy("topic").agg(F.count(F.lit(1)).alias("document_count")), words)


@query(
    f"""SELECT page_id, CASE WHEN length(trim(x)) > 5 THEN x END AS features FROM (SELECT page_id, concat_ws(' ', lower({_DOMAIN}), CASE WHEN length(t) > 3 AND t NOT IN ('nan', 'None') THEN t END) AS x
FROM (SELECT page_id, url, {_TITLE} AS t FROM pages))"""
)
def text_features(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return pages.select("page_id", T.topic_text(F.lower(U.domain_of(F.col("url"))), page_title(F.col("html")), F.lit(None).cast("string")).alias("features"))


@query(
    f"""SELECT domain, asked, CASE WHEN answered THEN asked || '/' END AS redirect_url, CAST(CASE WHEN answered THEN CASE WHEN length(asked) % 11 = 0 THEN 429 ELSE 200 END END AS INTEGER) AS status_code,
  CASE WHEN NOT answered THEN 'Timeout' END AS error, CASE WHEN answered THEN asked END AS title
FROM (SELECT domain, CASE WHEN first THEN 'https://' || domain ELSE 'http://' || domain END AS asked, first OR length(domain) % 7 <> 0 AS answered
  FROM (SELECT DISTINCT {_DOMAIN} AS domain, (length({_DOMAIN}) + 8) % 7 <> 0 AND (length({_DOMAIN}) + 8) % 3 <> 0 AS first FROM pages WHERE {_DOMAIN} IS NOT NULL))"""
)
def offline_fetch(spark, sf_dir):
    """Fetches every domain from a scripted fetcher: plain http answers alone for some, others never do."""

    def fetcher(url: str) -> tuple[int, str, int, str]:
        if len(url) % 7 == 0:
            raise TimeoutError
        if url.startswith("https://") and len(url) % 3 == 0:
            raise OSError
        return (429 if len(url) % 11 == 0 else 200), url + "/", 1, f"<title>{url}</title>"

    got = fetch_pages(D.with_domain(table(spark, sf_dir, "pages", "url"), "url").select("domain"), fetcher, delay=None)
    return got.select("domain", "asked", "redirect_url", "status_code", "error", page_metadata(F.col("html")).alias("m")).select("domain", "asked", "redirect_url", "status_code", "error", "m.title")


@query(
    f"""SELECT page_id, 'https://' || d AS asked, 'http://' || d AS plain, CASE WHEN page_id % 3 > 0 AND final <> 'https://' || d THEN final END AS redirect_url
FROM (SELECT page_id, d, CASE WHEN page_id % 2 = 0 THEN 'https://' || d ELSE 'https://' || d || '/home' END AS final FROM (SELECT page_id, {_DOMAIN} AS d FROM pages))"""
)
def fetch_urls(spark, sf_dir):
    d = U.domain_of(F.col("url"))
    pages = table(spark, sf_dir, "pages", "page_id", "url").select("page_id", F.when(F.pmod("page_id", F.lit(5)) == 0, F.concat(F.lit(" @"), d)).otherwise(d).alias("d"))
    asked = U.fetch_url(F.col("d"))
    final = F.when(F.pmod("page_id", F.lit(2)) == 0, asked).otherwise(F.concat(asked, F.lit("/home")))
    return pages.select("page_id", asked.alias("asked"), U.plain_http(asked).alias("plain"), U.redirect_url(asked, final, F.pmod("page_id", F.lit(3))).alias("redirect_url"))


_LEVEL = "CASE WHEN {x} < {lo} THEN 'low' WHEN {x} > {hi} THEN 'high' ELSE 'normal' END AS {name}"


@query(
    f"""SELECT event_id, {_LEVEL.format(x="c", lo=40, hi=85, name="cpu")}, {_LEVEL.format(x="m", lo=70, hi=90, name="memory")}, {_LEVEL.format(x="n", lo=300, hi=800, name="connections")},
  {_LEVEL.format(x="b", lo=5, hi=50, name="throughput")},
  CASE WHEN c < 50 AND m < 70 AND b < 20 THEN 'external' WHEN c > 80 THEN 'cpu' WHEN b > 30 THEN 'network' ELSE 'external, resources available' END AS found,
  CASE WHEN st = 429 THEN least(d * 1.5, 2.0) WHEN st = 200 THEN greatest(d * 0.95, 0.05) ELSE d END AS delay
FROM (SELECT event_id, event_id % 97 AS c, event_id % 101 AS m, event_id % 1009 AS n, event_id % 61 AS b, CASE event_id % 3 WHEN 0 THEN 429 WHEN 1 THEN 200 ELSE 500 END AS st, CAST(event_id % 8 AS DOUBLE) / 4 AS d FROM events)"""
)
def machine_bottlenecks(spark, sf_dir):
    i = F.col("event_id")
    m = lambda k: F.pmod(i, F.lit(k))
    status = F.when(m(3) == 0, 429).when(m(3) == 1, 200).otherwise(500)
    rows = table(spark, sf_dir, "events", "event_id").select(
        "event_id", E.resource_levels(m(97), m(101), m(1009), m(61)).alias("l"), E.bottleneck(m(97), m(101), m(61)).alias("found"), E.adapted_delay(m(8).cast("double") / 4, status).alias("delay")
    )
    return rows.select("event_id", "l.*", "found", "delay")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events", "ts", "event_type"))


@query(f"SELECT page_id, {_DOMAIN} || ' ' || url || coalesce(' ' || nullif({_TITLE}, ''), '') AS label_text FROM pages")
def label_texts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    rows = pages.select("page_id", U.domain_of(F.col("url")).alias("domain"), "url", page_title(F.col("html")).alias("title"), F.lit("None").alias("keywords"))
    return rows.select("page_id", T.label_text(rows).alias("label_text"))


@query(f"SELECT domain, count, rank FROM (SELECT *, CAST(row_number() OVER (ORDER BY count DESC, domain) AS INTEGER) AS rank FROM ({_COUNTS})) WHERE rank <= 10")
def top_domains(spark, sf_dir):
    """A top-k report: the limit is the feature, and leaves ten rows to number."""
    top = D.ranked(D.domain_counts(table(spark, sf_dir, "pages", "url"), "url")).limit(10)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), "domain")))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '*' ELSE '' END || CASE doc_id % 3 WHEN 0 THEN 'Travel' WHEN 1 THEN 'Other' ELSE 'Unknown' END AS label FROM documents")
def category_names(spark, sf_dir):
    names = F.when(F.pmod("doc_id", F.lit(3)) == 0, "Ταξίδια").when(F.pmod("doc_id", F.lit(3)) == 1, "Άλλο").otherwise("Unknown")
    marked = F.concat(F.when(F.pmod("doc_id", F.lit(2)) == 0, "*").otherwise(""), names)
    return table(spark, sf_dir, "documents", "doc_id").select("doc_id", C.to_english(marked, {"Ταξίδια": "Travel", "Άλλο": "Other"}).alias("label"))


@query(
    f"""SELECT vec_id, conflict, n_tied FROM (SELECT doc_id AS vec_id, count(*) FILTER (WHERE n = top) AS n_tied, count(*) FILTER (WHERE n = top) > 1 AS conflict
FROM (SELECT doc_id, category, count(*) AS n, max(count(*)) OVER (PARTITION BY doc_id) AS top FROM {_VOTES} GROUP BY 1, 2) GROUP BY doc_id)"""
)
def vote_ties(spark, sf_dir):
    return C.vote_counts(_votes(spark, sf_dir), "doc_id").select(F.col("doc_id").alias("vec_id"), (F.col("n_tied") > 1).alias("conflict"), "n_tied")


_KINDS = [c.name for c in C.CATALOGUE if c.name != C.OTHER]


@query(
    f"""WITH c AS (SELECT page_id, CASE WHEN page_id % 5 > 0 THEN 'x' END AS content, CASE WHEN page_id % 10 = 0 THEN 'Invalid domain' END AS error,
  list_extract([{",".join("NULL" if x is None else repr(x) for x in _RESPONSES)}], CAST(page_id % 6 AS INTEGER) + 1) AS said FROM pages),
k AS (SELECT *, trim(trim(trim(coalesce(said, '')), '"'), chr(39)) AS r FROM c),
m AS (SELECT *, list_extract(list_filter({_NAMES[:-9]}], lambda x: contains(x, r) OR contains(r, x)), 1) AS hit FROM k)
SELECT page_id, CASE WHEN content IS NOT NULL AND r <> '' AND hit IS NOT NULL THEN hit ELSE 'Other' END AS category,
  CAST(CASE WHEN content IS NULL THEN 0.1 WHEN r <> '' AND hit IS NOT NULL THEN 0.8 ELSE 0.5 END AS DOUBLE) AS confidence,
  CASE WHEN content IS NULL THEN coalesce(error, 'Failed to fetch content') ELSE 'Success' END AS status FROM m"""
)
def landing_labels(spark, sf_dir):
    i = F.col("page_id")
    said = F.element_at(F.array(*[F.lit(x) for x in _RESPONSES]), (F.pmod(i, F.lit(6)) + 1).cast("int"))
    content, error = F.when(F.pmod(i, F.lit(5)) > 0, "x"), F.when(F.pmod(i, F.lit(10)) == 0, "Invalid domain")
    return table(spark, sf_dir, "pages", "page_id").select("page_id", T.landing_label(content, error, said, _KINDS, C.OTHER).alias("m")).select("page_id", "m.*")


@query(f"SELECT round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (WHERE confidence > 0.7) AS n_high, round(100.0 * count(*) FILTER (WHERE confidence > 0.7) / count(*), 6) AS high_pct FROM {_VOTES}")
def overall_confidence(spark, sf_dir):
    c = F.col("confidence")
    return _votes(spark, sf_dir).agg(F.round(F.avg(c), 6).alias("mean_confidence"), F.count_if(c > 0.7).alias("n_high"), D.share(c > 0.7).alias("high_pct"))


@query("SELECT count(DISTINCT t) FILTER (WHERE t <> -1) AS n_topics, count(*) FILTER (WHERE t = -1) AS n_outliers, round(100.0 * count(*) FILTER (WHERE t = -1) / count(*), 6) AS outlier_pct FROM (SELECT doc_id % 7 - 1 AS t FROM documents)")
def topic_outliers(spark, sf_dir):
    return P.outliers(table(spark, sf_dir, "documents", (F.pmod("doc_id", F.lit(7)) - 1).alias("topic")))


@query(f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE {_TITLE} <> '') AS n_valid, round(100.0 * count(*) FILTER (WHERE {_TITLE} <> '') / count(*), 6) AS pct FROM pages")
def valid_titles(spark, sf_dir):
    return D.valid_share(table(spark, sf_dir, "pages", "html"), page_title(F.col("html")))


@query(f"SELECT domain, count FROM ({_COUNTS}) ORDER BY count, domain DESC LIMIT 3")
def rarest_domains(spark, sf_dir):
    """The tail of the ranked counts: three rows are the feature."""
    counts = D.domain_counts(table(spark, sf_dir, "pages", "url"), "url")
    return D.tail(counts.withColumn("order", -F.col("count")), 3, "order", "domain").drop("order")


@query(f"SELECT domain, page_id, row_number() OVER (ORDER BY page_id) AS place FROM (SELECT {_DOMAIN} AS domain, min(page_id) AS page_id FROM pages WHERE {_DOMAIN} IS NOT NULL GROUP BY 1) QUALIFY place <= 20")
def fetched_in_order(spark, sf_dir):
    """Fetched domains in the order of their first page, numbered; the first twenty, a report."""
    asked = D.with_domain(table(spark, sf_dir, "pages", "page_id", "url"), "url").select("domain", "page_id")
    got = fetch_pages(asked, lambda url: (200, url, 0, ""), delay=None).select("domain")
    first = D.restore_order(got, asked, "domain", "page_id").limit(20)
    return first.select("domain", "page_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("page_id")).cast("long").alias("place"))


@query("SELECT event_id, round(avg(value) OVER w, 8) AS rolling_mean, max(value) OVER w AS rolling_max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def rolling_mean_10(spark, sf_dir):
    return E.rolling(table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value"), "user_id", ["ts", "event_id"], "value", 10).select("event_id", "rolling_mean", "rolling_max")
