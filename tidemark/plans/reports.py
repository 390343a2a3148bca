"""Registered queries over reports, sources, enrichment, scoring and the engine, and the same queries as DuckDB SQL."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import digest, enrich, entities, insights, runs, scoring, terms
from tidemark.plans import catalog as c
from tidemark.plans.engine import Engine
from tidemark.plans.registry import query
from tidemark.sources import articles as src
from tidemark.sources import landed
from tidemark.streaming.cycle import Cycle
from tidemark.streaming.feed import _folder, ranges

STEMS = "^over|ble$"


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The engine over `documents` with the test tables' lexicons."""
    return Engine(src.articles(spark, sf_dir), src.AS_OF, c.STOP, c.CONCEPTS, c.COMPOUNDS, c.ANCHORS, STEMS, c.LEXICON, c.TAXONOMY, c.TAGS, "none")


# Reports -----------------------------------------------------------------------------------------------------------

_TAGGED = c._tags_sql("title || ' ' || " + '"desc"')
_ALL = "event_date >= DATE '2024-01-01'"


def _ranked(section: str, label: str, value: str, rows: str, order: str | None = None) -> str:
    return f"SELECT '{section}' AS section, CAST(row_number() OVER (ORDER BY {order or f'{value} DESC, {label}'}) AS INTEGER) AS rank, CAST({label} AS VARCHAR) AS label, CAST({value} AS DOUBLE) AS value FROM {rows}"


def _types_sql(where: str) -> str:
    return _ranked("type", "type", "n", f"(SELECT type, count(*) AS n FROM articles WHERE {where} GROUP BY 1)")


def _dates_sql(where: str) -> str:
    return f"SELECT 'date', CAST(1 AS INTEGER), CAST(min(event_date) AS VARCHAR), CAST(NULL AS DOUBLE) FROM articles WHERE {where} UNION ALL SELECT 'date', 2, CAST(max(event_date) AS VARCHAR), NULL FROM articles WHERE {where}"


def _degree_sql(where: str) -> str:
    return f"(SELECT tag, CAST(sum(others) AS BIGINT) AS degree FROM (SELECT unnest(tags) AS tag, len(tags) - 1 AS others FROM (SELECT {_TAGGED} AS tags FROM articles WHERE {where}) WHERE len(tags) >= 2) GROUP BY tag ORDER BY degree DESC, tag LIMIT 20)"


def _bundle_sql(where: str, k: int) -> str:
    return " UNION ALL ".join([
        _types_sql(where), _dates_sql(where), _ranked("word", "term", "score", c._tfidf_sql(where, k)),
        _ranked("phrase", "a || ' ' || b", "score", c._npmi_sql(where, k // 2), "score DESC, a, b"), _ranked("tag", "tag", "degree", _degree_sql(where)),
    ])


@query(f"WITH {c._TOK} {_bundle_sql(_ALL + ' AND type = ' + repr('paper'), 30)}")
def engine_word_freq(spark, sf_dir):
    return engine(spark, sf_dir).word_freq(30, 30, "paper")


_INSIGHTS = " UNION ALL ".join([
    _ranked("keyword", "term", "floor(score)", c._tfidf_sql("true", 16), "score DESC, term").replace("CAST(floor(score) AS DOUBLE)", "floor(score)"),
    _ranked("phrase", "a || ' ' || b", "floor(score)", c._npmi_sql("true", 8), "score DESC, a, b"), _types_sql("true"), _dates_sql("true"),
    _ranked("venue", "venue", "n", "(SELECT venue, count(*) AS n FROM articles WHERE length(venue) > 0 GROUP BY 1 ORDER BY n DESC, venue LIMIT 8)"),
    _ranked("tag", "tag", "n", f"(SELECT tag, count(*) AS n FROM (SELECT unnest({_TAGGED}) AS tag FROM articles) GROUP BY 1 ORDER BY n DESC, tag LIMIT 10)"),
])


@query(f"WITH {c._TOK} {_INSIGHTS}")
def feed_insights(spark, sf_dir):
    return engine(spark, sf_dir).insights()


def _line_sql(n: int, section: str, most: int, shown: str) -> str:
    return f"SELECT CAST({n} AS INTEGER) AS line, '{dict(keyword='keywords', phrase='phrases', tag='tags', venue='venues')[section]}: ' || string_agg({shown}, ' · ' ORDER BY rank) AS text FROM found WHERE section = '{section}' AND rank <= {most}"


_NAMED = "label || ' ×' || CAST(CAST(value AS BIGINT) AS VARCHAR)"


@query(f"WITH {c._TOK}, found(section, rank, label, value) AS ({_INSIGHTS}) SELECT * FROM ({_line_sql(1, 'keyword', 6, 'label')} UNION ALL {_line_sql(2, 'phrase', 5, 'label')} UNION ALL {_line_sql(3, 'tag', 6, _NAMED)} UNION ALL {_line_sql(4, 'venue', 5, _NAMED)}) WHERE text IS NOT NULL")
def insight_lines(spark, sf_dir):
    return insights.headline(engine(spark, sf_dir).insights())


@query(f"WITH {c._TOK} SELECT * FROM {c._g2_sql(_ALL + ' AND type = ' + repr('news') + ' AND ' + c._RECENT, 'type = ' + repr('news') + ' AND ' + c._PAST, 20)}")
def engine_trending(spark, sf_dir):
    return engine(spark, sf_dir).trending(type="news")


@query(f"""WITH {c._TOK}, {c._nominated_sql(STEMS)}, {c._ranked_sql(24)}, {c._HELD},
placed AS (SELECT term, key, kind, score, CAST(row_number() OVER (ORDER BY round(raw, 9) DESC, term) AS INTEGER) AS place FROM ranked SEMI JOIN ev USING (key))
SELECT place, p.term, p.kind, score, ev.type, coalesce({c._half("strength", 2)}, 0) AS g2, coalesce({c._half("trend", 2)}, 1) AS trend, coalesce({c._half("recent", 2)}, 0) AS recent, coalesce({c._half("hist", 2)}, 0) AS hist, id
FROM placed p JOIN ev USING (key) LEFT JOIN nominated n ON n.term = p.term AND n.type = ev.type WHERE place <= 8""")
def topic_cards(spark, sf_dir):
    return engine(spark, sf_dir).topics(top_k=8)


@query(f"""WITH {c._RULES}, w AS (SELECT * FROM scored WHERE score >= 3 AND type = 'repo')
SELECT 'bucket' AS section, CASE WHEN score >= 9 THEN '9+' WHEN score >= 7 THEN '7-9' WHEN score >= 5 THEN '5-7' ELSE '3-5' END AS name, count(*) AS n, CAST(NULL AS DOUBLE) AS avg_score FROM w GROUP BY 2
UNION ALL SELECT 'domain', domain, count(*), {c._half('avg(score)', 1)} FROM (SELECT unnest(string_split(top_domains, ',')) AS domain, score FROM w) GROUP BY 2 UNION ALL SELECT 'type', type, count(*), {c._half('avg(score)', 1)} FROM w GROUP BY 2""")
def engine_industry(spark, sf_dir):
    return engine(spark, sf_dir).industry(type="repo")


_MOMENTUM = c.SQL["entity_momentum"].split("SELECT entity_id, category, mentions, heat_sum", 1)
_RARE = "category = 'rare'"


@query(_MOMENTUM[0] + "SELECT entity_id, category, mentions, heat_sum" + _MOMENTUM[1].replace("FROM v ORDER BY", f"FROM v WHERE {_RARE} ORDER BY"))
def engine_entities(spark, sf_dir):
    return engine(spark, sf_dir).entities(category="rare")


def _titles(sql: str) -> str:
    return sql.replace("FROM counts", "FROM tcounts").replace("FROM seq", "FROM tseq")


_EMERGE = c.SQL["entity_emergence"].split(", now AS (", 1)[1]
_CONVERGE = c._CARDS.replace("LIMIT 50", "LIMIT 20").replace("arxiv_id IS NOT NULL", "arxiv_id IS NOT NULL AND " + _ALL)


@query(f"""WITH {c._TOK}, {c._ENT[len(c._ART) + 2:]}, {_CONVERGE},
tseq AS (SELECT id, type, event_date, weight, list_concat(list_concat(tt, tt), tt) AS s FROM tok), tcounts AS (SELECT id, type, event_date, weight, term, count(*) AS n FROM (SELECT id, type, event_date, weight, unnest(s) AS term FROM tseq) GROUP BY ALL),
now AS ({c._GROUP}), v AS (SELECT now.*, {c._half("CASE WHEN coalesce(before, 0) > 0 THEN mentions / before ELSE least(5.0, 1.5 * mentions) END", 2)} AS velocity FROM now LEFT JOIN (SELECT entity_id, count(*)::DOUBLE AS before FROM ents WHERE {c._PAST} GROUP BY 1) USING (entity_id)),
mo AS (SELECT entity_id, {c._half("ln(1 + heat_sum::DOUBLE) + 2 * ln(1 + mentions::DOUBLE) + 1.5 * velocity + 1.2 * CASE types WHEN 2 THEN 2.5 WHEN 3 THEN 5.0 ELSE 1.0 END", 2)} AS composite FROM v ORDER BY composite DESC, entity_id LIMIT 20),
em AS (SELECT entity_id, {c._half("mentions * ln(1 + heat_sum::DOUBLE) * CASE WHEN entity_id NOT IN (SELECT entity_id FROM ents WHERE " + c._PAST + ") THEN 2 ELSE 1 END", 2)} AS score FROM now WHERE mentions >= 1 ORDER BY score DESC, entity_id LIMIT 20)
SELECT section, rank, label AS name, value FROM ({" UNION ALL ".join([
    _ranked("word", "term", "score", c._tfidf_sql(_ALL, 20)), _ranked("trend", "term", "g2", _titles(c._g2_sql(c._RECENT, c._PAST, 20))),
    _ranked("entity", "entity_id", "composite", "mo"), _ranked("emergence", "entity_id", "score", "em"), _ranked("convergence", "arxiv_id", "score", "cards")])})""")
def engine_aggregate(spark, sf_dir):
    return engine(spark, sf_dir).aggregate()


_META = [(e, e.upper(), k) for e, k, _ in dict.fromkeys((e, k, 0) for e, k, _ in c.LEXICON) if e != "er"]


@query(f"WITH {c._ENT}, meta(entity_id, display, category) AS (VALUES {', '.join(f'{m!r}' for m in _META)}) SELECT ents.id AS id, entity_id, display, meta.category AS category FROM ents JOIN meta USING (entity_id)")
def entity_described(spark, sf_dir):
    known = spark.createDataFrame(_META, "entity_id string, display string, category string")
    return entities.described(c._ents(spark, sf_dir), known).select("id", "entity_id", "display", "category")


@query(f"WITH {c._ART} SELECT id, array_to_string({c._tok('title')}[1:2], ' ') AS tokens, len(list_filter({c._tok('title')}[1:2], lambda x: list_contains({c._list(c.ANCHORS)}, x) OR regexp_matches(x, '{STEMS}'))) > 0 AS valued FROM articles")
def term_tokens(spark, sf_dir):
    found = terms.term_tokens(F.col("title"), c.STOP, c.CONCEPTS, c.COMPOUNDS)
    return src.articles(spark, sf_dir).select("id", F.array_join(found, " ").alias("tokens"), terms.high_value(found, c.ANCHORS, STEMS).alias("valued"))


# Digest ------------------------------------------------------------------------------------------------------------

_LINKED = c._ART + ", l AS (SELECT *, ' https://x.example/' || id // 2 || ' ' AS link FROM articles)"


def _linked(spark, sf_dir) -> DataFrame:
    return src.articles(spark, sf_dir).withColumn("link", F.concat(F.lit(" https://x.example/"), F.floor(F.col("id") / 2).cast("string"), F.lit(" ")))


_KEY = "(SELECT '2024-W05:' || substr(md5(string_agg(link, chr(10) ORDER BY link)), 1, 24) FROM (SELECT DISTINCT trim(link) AS link FROM l ORDER BY 1 LIMIT 56))"


@query(f"WITH {_LINKED} SELECT {_KEY} AS fingerprint, 'Items: ' || count(*) || '. No writer is configured.' AS text, false AS written, false AS cached FROM articles")
def weekly_digest(spark, sf_dir):
    items = _linked(spark, sf_dir)
    return digest.digest(items, spark.createDataFrame([], "fingerprint string, text string, written boolean"), src.AS_OF)


@query(f"WITH {_LINKED} SELECT {_KEY} AS fingerprint, 'Kept.' AS text, true AS written, true AS cached")
def weekly_digest_again(spark, sf_dir):
    items = _linked(spark, sf_dir)
    kept = digest.fingerprint(items, src.AS_OF).select("fingerprint", F.lit("Kept.").alias("text"), F.lit(True).alias("written"))
    return digest.digest(items, kept, src.AS_OF)


_FLAT = lambda x, n: f"substr(replace(coalesce({x}, ''), chr(10), ' '), 1, {n})"


@query(f"""WITH {c._ART}, n AS (SELECT *, CAST(row_number() OVER (ORDER BY heat DESC, event_date DESC, id) AS INTEGER) AS number FROM articles)
SELECT number, number || '. [' || type || '] ' || {_FLAT('title', 220)} || chr(10) || '   source: ' || {_FLAT('venue', 80)} || ' | date: ' || event_date || chr(10) || '   text: ' || {_FLAT('"desc"', 180)} AS line FROM n WHERE number <= 32""")
def digest_material(spark, sf_dir):
    return digest.material(src.articles(spark, sf_dir))


# Enrichment --------------------------------------------------------------------------------------------------------

_HOSTS = "CASE page_id % 6 WHEN 0 THEN 'https://gist.github.com/x' WHEN 1 THEN 'https://arxiv.org/abs/1' WHEN 2 THEN 'https://a.medium.com/b' WHEN 3 THEN 'https://b.substack.com/p' WHEN 4 THEN 'no host' ELSE url END"


@query(f"""WITH u AS (SELECT page_id, lower(regexp_extract({_HOSTS}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h FROM pages) SELECT page_id,
CASE WHEN contains(h, 'github.com') THEN 'article.markdown-body' WHEN contains(h, 'arxiv.org') THEN 'blockquote.abstract' WHEN contains(h, 'medium.com') THEN 'article' WHEN contains(h, 'substack.com') THEN '.post-content' ELSE 'main article' END AS selector,
CAST(CASE WHEN contains(h, 'github.com') THEN 6 WHEN contains(h, 'arxiv.org') THEN 4 WHEN contains(h, 'medium.com') THEN 3 WHEN contains(h, 'substack.com') THEN 3 ELSE 9 END AS INTEGER) AS selectors,
CASE WHEN contains(h, 'github.com') THEN '.markdown-body, article.markdown-body, #readme' WHEN contains(h, 'arxiv.org') THEN 'blockquote.abstract, .abstract, main' WHEN contains(h, 'medium.com') THEN 'article' WHEN contains(h, 'substack.com') THEN '.post-content, article' END AS wait_for,
CASE WHEN contains(h, 'github.com') THEN 0.5::DOUBLE WHEN contains(h, 'arxiv.org') THEN 0.2::DOUBLE WHEN contains(h, 'medium.com') THEN 0.8::DOUBLE WHEN contains(h, 'substack.com') THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS delay FROM u""")
def crawl_hints(spark, sf_dir):
    hint = enrich.crawl_hints(F.expr(_HOSTS))
    return c._table(spark, sf_dir, "pages").select("page_id", hint.alias("h")).select("page_id", F.element_at("h.selectors", 1).alias("selector"), F.size("h.selectors").alias("selectors"), "h.wait_for", "h.delay")


_BODIES = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<script[^>]*>[^<]*</script>', '', 'g'), '(?i)<style[^>]*>[^<]*</style>', '', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"


@query(f"WITH t AS (SELECT page_id, trim(CASE page_id % 3 WHEN 0 THEN '# ' || url WHEN 1 THEN 'text of ' || url ELSE {_BODIES} END, ' ' || chr(10) || chr(9) || chr(13)) AS t FROM pages) SELECT page_id, CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '…' ELSE t END AS content FROM t")
def extract_content(spark, sf_dir):
    kind = F.col("page_id") % 3
    markdown, plain = F.when(kind == 0, F.concat(F.lit("# "), "url")), F.when(kind == 1, F.concat(F.lit("text of "), "url")).otherwise("")
    return c._table(spark, sf_dir, "pages").select("page_id", enrich.content(markdown, plain, F.col("html")).alias("content"))


def _quality_sql(t: str) -> str:
    n, a = f"length({t})", f"length(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
    lines = f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0)"
    return f"(CASE WHEN {n} < 80 THEN {n} * 0.2::DOUBLE ELSE {n} * 0.35::DOUBLE + {a} / {n} * 400.0::DOUBLE + len(list_filter({lines}, lambda x: length(x) >= 60)) / greatest(len({lines}), 1) * 500.0::DOUBLE - len(list_filter({lines}, lambda x: length(x) < 20)) / greatest(len({lines}), 1) * 300.0::DOUBLE END)"


@query(f"""WITH k AS (SELECT page_id AS id, 'bodies' AS label, {_BODIES} AS t FROM pages UNION ALL SELECT page_id, 'url', url FROM pages UNION ALL SELECT page_id, 'blank', '  ' FROM pages UNION ALL SELECT page_id, 'same', {_BODIES} FROM pages WHERE page_id % 2 = 0),
r AS (SELECT id, label, t, {_quality_sql('t')} AS q FROM k WHERE length(trim(t)) > 0) SELECT id, label, md5(t) AS text_md5, {c._half('q', 2)} AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY q DESC, length(t) DESC, label) AS n FROM r) WHERE n = 1""")
def best_candidate(spark, sf_dir):
    pages = c._table(spark, sf_dir, "pages")
    part = lambda rows, label, value: rows.select(F.col("page_id").alias("id"), F.lit(label).alias("label"), value.alias("text"))
    bodies = text.strip_html_bodies(F.col("html"))
    every = part(pages, "bodies", bodies).unionByName(part(pages, "url", F.col("url"))).unionByName(part(pages, "blank", F.lit("  "))).unionByName(part(pages.where("page_id % 2 = 0"), "same", bodies))
    return enrich.best_candidate(every).select("id", "label", F.md5("text").alias("text_md5"), (F.floor(F.col("score") * 100 + 0.5) / 100.0).alias("score"))


@query(f"""WITH {c._ART} SELECT 'enhance' AS step, id FROM (SELECT id FROM articles WHERE length("desc") < 100 OR heat > 50 ORDER BY heat DESC, event_date DESC, id LIMIT 10) UNION ALL SELECT 'summarise', id FROM (SELECT id FROM articles WHERE type = 'paper' OR heat > 40 OR length("desc") < 150 ORDER BY heat DESC, event_date DESC, id LIMIT 5)""")
def enrich_candidates(spark, sf_dir):
    items = src.articles(spark, sf_dir)
    return enrich.to_enhance(items).select(F.lit("enhance").alias("step"), "id").unionByName(enrich.to_summarise(items).select(F.lit("summarise").alias("step"), "id"))


@query(f"""WITH {c._ART}, t AS (SELECT id, {_TAGGED} AS tags, CASE WHEN id % 3 = 0 THEN "desc" || ' and more' WHEN id % 3 = 1 THEN 'x' ELSE "desc" END AS d FROM articles)
SELECT id, md5(CASE WHEN id % 3 = 1 THEN "desc" ELSE d END) AS desc_md5, array_to_string(list_sort(list_distinct(CASE WHEN id % 3 < 2 THEN list_concat(tags, ['sch', 'found']) ELSE tags END)), ',') AS tags FROM t JOIN articles USING (id)""")
def enhanced_items(spark, sf_dir):
    items = src.articles(spark, sf_dir).withColumn("tags", text.infer_tags(F.concat_ws(" ", "title", "desc"), c.TAGS, "none"))
    found = items.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, F.concat("desc", F.lit(" and more"))).otherwise("x").alias("text"), F.array(F.lit("sch"), F.lit("found")).alias("more_tags"))
    return enrich.enhanced(items, found).select("id", F.md5("desc").alias("desc_md5"), F.array_join("tags", ",").alias("tags"))


# Scores that are kept ----------------------------------------------------------------------------------------------


@query(f"""WITH {c._RULES}, kept AS (SELECT id, 1.5::DOUBLE AS score, 'rule' AS method FROM articles WHERE id % 4 = 1), fresh AS (SELECT id, CASE WHEN id % 5 = 0 THEN least(10.0, (id % 13)::DOUBLE) ELSE score END AS score, CASE WHEN id % 5 = 0 THEN 'model' ELSE 'rule' END AS method FROM scored ANTI JOIN kept USING (id))
SELECT * FROM kept UNION ALL SELECT * FROM fresh""")
def scoring_checkpoint(spark, sf_dir):
    """Kept scores stay; the rest are scored, by the answers of a model where there are readable ones."""
    items = src.articles(spark, sf_dir)
    kept = items.where("id % 4 = 1").select("id", F.lit(1.5).alias("score"), F.lit("rule").alias("method"))
    answer = F.when(F.col("id") % 5 == 0, F.concat(F.lit('```json\n{"score": '), (F.col("id") % 13).cast("string"), F.lit("}\n```"))).otherwise("no answer")
    return scoring.merged_scores(kept, scoring.score_missing(items, kept, c.TAXONOMY, items.select("id", answer.alias("answer"))))


@query(f"""WITH {c._ART} SELECT id, 'problem ' || id AS problem, '' AS method, CASE WHEN id % 2 = 0 THEN '+' || id % 7 || '%' ELSE '' END AS key_metric, '' AS impl_url, 'line' AS one_liner, CAST(CASE WHEN id % 5 = 0 THEN 3 ELSE greatest(1, least(5, id % 9 - 1)) END AS INTEGER) AS novelty
 FROM (SELECT *, id % 9 - 1 AS raw FROM articles) WHERE type = 'paper' AND length(trim(title)) > 0 AND id % 4 <> 1 AND id % 11 <> 0 AND (raw <> 0 OR id % 5 = 0)
 UNION ALL SELECT id, 'problem ' || id, '', CASE WHEN id % 2 = 0 THEN '+' || id % 7 || '%' ELSE '' END, '', 'line', 3 FROM articles WHERE type = 'paper' AND length(trim(title)) > 0 AND id % 4 <> 1 AND id % 11 <> 0 AND id % 9 = 1 AND id % 5 <> 0""")
def paper_structs(spark, sf_dir):
    """Fields of papers read from answers with and without a fence; unreadable ones and papers with kept fields are left out."""
    items = src.articles(spark, sf_dir)
    i = F.col("id")
    number = lambda x: x.cast("string")
    body = F.concat(F.lit('{"problem": "problem '), number(i), F.lit('"'), F.when(i % 2 == 0, F.concat(F.lit(', "key_metric": "+'), number(i % 7), F.lit('%"'))).otherwise(""), F.when(i % 5 == 0, "").otherwise(F.concat(F.lit(', "novelty": '), number(i % 9 - 1))), F.lit(', "one_liner": "line", "impl_url": null}'))
    answer = F.when(i % 11 == 0, "sorry").when(i % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```\n"))).otherwise(body)
    return scoring.extract_missing(items, items.where("id % 4 = 1").select("id"), items.select("id", answer.alias("answer")))


# Collection --------------------------------------------------------------------------------------------------------

_RUNS = "SELECT user_id AS run, event_type AS source, event_id AS seq, value / 10 AS seconds, CAST(event_id % 40 AS BIGINT) AS items, CASE WHEN event_id % 7 = 0 THEN 'failed ' || event_id % 3 END AS error FROM events"


def _run_log(spark, sf_dir) -> DataFrame:
    number = F.col("event_id")
    error = F.when(number % 7 == 0, F.concat(F.lit("failed "), (number % 3).cast("string")))
    return c._table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("source"), number.alias("seq"), (F.col("value") / 10).alias("seconds"), (number % 40).cast("long").alias("items"), error.alias("error"))


@query(f"WITH r AS ({_RUNS}) SELECT run, CAST(sum(items) AS BIGINT) AS total_items, CAST(sum(items) AS BIGINT) AS new_items, CAST(sum(floor(seconds * 1000 + 0.5)) AS BIGINT) AS duration_ms, '[' || coalesce(string_agg('\"' || source || ': ' || error || '\"', ',' ORDER BY source, error) FILTER (error IS NOT NULL), '') || ']' AS errors FROM r GROUP BY run")
def run_log(spark, sf_dir):
    return runs.run_rows(_run_log(spark, sf_dir))


@query(f"WITH r AS ({_RUNS}) SELECT run, CAST(sum(items) AS BIGINT) AS total_items FROM r WHERE run = (SELECT max(run) FROM r) GROUP BY run")
def latest_run(spark, sf_dir):
    """The log appended to a table and read again."""
    at = _folder(spark, "runs")
    runs.run_rows(_run_log(spark, sf_dir)).write.mode("append").parquet(at)
    return runs.latest_run(spark.read.parquet(at)).select("run", "total_items")


@query(f"WITH r AS ({_RUNS}) SELECT source, max(seq) AS cursor, count(*) FILTER (error IS NULL) AS fetches, count(*) FILTER (error IS NOT NULL) AS errors, arg_max(items, seq) FILTER (error IS NULL) AS last_count, arg_max(error, seq) FILTER (error IS NOT NULL) AS last_error, {c._half('avg(floor(seconds * 1000)) FILTER (error IS NULL)', 1)} AS mean_ms FROM r GROUP BY source")
def source_state(spark, sf_dir):
    return runs.source_state(_run_log(spark, sf_dir))


@query("WITH f AS (SELECT event_type AS source, event_id AS seq, event_id % 3 = 0 AS changed, CAST(event_id % 40 AS BIGINT) AS items FROM events), g AS (SELECT *, count(*) FILTER (changed) OVER (PARTITION BY source ORDER BY seq) AS k FROM f) SELECT source, seq, coalesce(max(items) FILTER (changed) OVER (PARTITION BY source, k), 0) * CASE WHEN k > 0 THEN 1 ELSE 0 END AS items, NOT changed AND k > 0 AS used_cache FROM g")
def reused_items(spark, sf_dir):
    number = F.col("event_id")
    rows = c._table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), number.alias("seq"), (number % 3 == 0).alias("changed"), (number % 40).cast("long").alias("items"))
    return runs.reused(rows)


_NOW = 1706443200.0
_METRICS = f"""m AS (SELECT user_id AS source, event_id AS seq, epoch(ts) AS sec, value / 10 AS seconds, event_id % 5 > 1 AS ok, event_id % 3 = 0 AS limited, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, sum(CASE WHEN event_id % 5 > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS good_after FROM events WHERE floor(epoch(ts)) <= {_NOW}),
p AS (SELECT source, avg(seconds) FILTER (n <= 5) AS mean, count(*) FILTER (ok) / least(count(*), 10) AS rate, count(*) FILTER (good_after = 0) AS failures, count(*) FILTER (limited) AS limits, {_NOW} - floor(max(sec) FILTER (limited)) AS since FROM m GROUP BY source)"""


def _requests(spark, sf_dir) -> DataFrame:
    number = F.col("event_id")
    return c._table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), number.alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), (F.col("value") / 10).alias("seconds"), (number % 5 > 1).alias("ok"), (number % 3 == 0).alias("limited"))


@query(f"WITH {_METRICS} SELECT source, {c._half('0.3::DOUBLE + least(0.5::DOUBLE * failures, 3.0::DOUBLE) + CASE WHEN since < 60 THEN greatest(0.0::DOUBLE, 2 - since / 30) ELSE 0 END + CASE WHEN mean > 5 THEN 0.5::DOUBLE ELSE 0 END', 4)} AS delay FROM p")
def request_delays(spark, sf_dir):
    return runs.delays(_requests(spark, sf_dir), _NOW)


@query(f"WITH {_METRICS} SELECT source, 'often fails' AS advice, {c._half('rate', 3)} AS value FROM p WHERE rate < 0.5 UNION ALL SELECT source, 'often limited', CAST(limits AS DOUBLE) FROM p WHERE limits > 3 UNION ALL SELECT source, 'slow', {c._half('mean', 1)} FROM p WHERE mean > 8")
def request_advice(spark, sf_dir):
    return runs.advice(_requests(spark, sf_dir), _NOW)


# Sources: files are landed from `documents` and `pages`, then read as a service's files would be -------------------------

_PLAIN = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,]', ' ', 'g'), '\\s+', ' ', 'g'))"
_CUT = lambda x, n=320: f"(CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '…' ELSE {x} END)"
_DAY = "strftime(DATE '2024-01-01' + CAST(doc_id % 31 AS INTEGER), '%Y-%m-%d')"
_PADDED = c._padded("doc_id")
_DOCS = f"d AS (SELECT doc_id, {_PLAIN} AS body, 'Title ' || doc_id AS title, {_DAY} AS day FROM documents)"


#: All but letters, digits, space, dot and comma. Named one by one they are a table that is looked up; as ranges they are compared one after another, five times as slow.
_OTHER = f"[^{ascii_letters}{digits} .,]"


def _docs(spark, sf_dir) -> DataFrame:
    number = F.col("doc_id")
    body = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), _OTHER, " "), " {2,}", " "))
    return c._table(spark, sf_dir, "documents").select("doc_id", body.alias("body"), F.concat(F.lit("Title "), number.cast("string")).alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), (number % 31).cast("int")).cast("string").alias("day"), F.floor(number / 500).alias("file"))


def _landed_xml(rows: DataFrame, name: str, root: str, tag: str) -> str:
    at = _folder(rows.sparkSession, name)
    rows.write.format("xml").option("rootTag", root).option("rowTag", tag).option("declaration", "").save(at)
    return at


def _landed_files(rows: DataFrame, name: str, item, wrap) -> str:
    """One file for each number, which holds at most 500 rows: what `wrap` makes of their items."""
    at = _folder(rows.sparkSession, name)
    whole = rows.select("file", item.alias("item")).groupBy("file").agg(F.collect_list("item").alias("items"))
    whole.select(wrap(F.col("items")).alias("value"), "file").write.partitionBy("file").text(at)
    return at


def _landed_json(rows: DataFrame, name: str, item, wrap) -> str:
    return _landed_files(rows, name, item, lambda items: F.to_json(wrap(items)))


def _shown(items: DataFrame, *more: str) -> DataFrame:
    return items.select("link", "title", F.md5("desc").alias("desc_md5"), F.col("event_date").cast("string").alias("day"), "venue", "type", *more)


@query(f"WITH {_DOCS} SELECT 'https://arxiv.org/abs/2401.' || {_PADDED} AS link, title, md5({_CUT('body')}) AS desc_md5, day, CASE WHEN doc_id % 2 = 0 THEN 'cs.CL' ELSE 'arXiv' END AS venue, 'paper' AS type FROM d")
def source_arxiv(spark, sf_dir):
    number = F.col("doc_id")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    parts = [
        tag("id", F.concat(F.lit("http://arxiv.org/abs/2401."), src.padded(number), F.lit("v2"))), tag("title", F.concat(F.lit(" "), "title")), tag("summary", F.col("body")),
        tag("published", F.concat("day", F.lit("T01:02:03Z"))), F.when(number % 2 == 0, '<arxiv:primary_category xmlns:arxiv="http://arxiv.org/schemas/atom" term="cs.CL"/>').otherwise(""),
    ]
    at = _landed_files(_docs(spark, sf_dir), "arxiv", tag("entry", F.concat(*parts)), lambda items: tag("feed", F.array_join(items, "")))
    return _shown(src.read_arxiv(spark, at, most=None))


@query(f"WITH {_DOCS} SELECT 'https://x.example/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '?b=+c&d=' ELSE '' END AS link, title, md5({_CUT('body')}) AS desc_md5, day, 'news' AS type FROM d")
def source_rss(spark, sf_dir):
    """Half of the items as RSS 2.0 with RFC 822 dates, half as Atom with several links."""
    number = F.col("doc_id")
    link = F.concat(F.lit("HTTPS://x.example/"), number.cast("string"), F.when(number % 3 == 0, "?b=%20c&ref=r&d").otherwise("/"))
    rows = _docs(spark, sf_dir)
    rss = rows.where("doc_id % 2 = 0").select("title", link.alias("link"), F.col("body").alias("description"), F.date_format(F.col("day").cast("date"), "'Mon, 'dd MMM yyyy' 10:00:00 GMT'").alias("pubDate"))
    one = lambda href, rel: F.struct(href.alias("_href"), F.lit(rel).cast("string").alias("_rel"))
    atom = rows.where("doc_id % 2 = 1").select("title", F.array(one(F.lit("https://x.example/self"), "self"), one(link, "alternate")).alias("link"), F.col("body").alias("content"), F.concat("day", F.lit("T00:00:00Z")).alias("updated"))
    read = lambda at: src.read_rss(spark, at, each=None)
    both = read(_landed_xml(rss, "rss", "channel", "item")).unionByName(read(_landed_xml(atom, "atom", "feed", "entry")))
    return _shown(both).drop("venue")


@query(f"WITH {_DOCS} SELECT 'https://github.com/own/repo' || doc_id AS link, 'Own/Repo' || doc_id AS title, md5({_CUT('body')}) AS desc_md5, day, 'GitHub' AS venue, 'repo' AS type, CAST(doc_id % 900 AS INTEGER) AS gh_stars, CAST(doc_id % 90 AS INTEGER) AS gh_forks, CAST(doc_id % 9 AS INTEGER) AS gh_open_issues FROM d")
def source_github(spark, sf_dir):
    number = F.col("doc_id")
    name = F.concat(F.lit("Own/Repo"), number.cast("string"))
    item = F.struct(name.alias("full_name"), F.concat(F.lit("https://github.com/"), name).alias("html_url"), F.col("body").alias("description"), F.concat("day", F.lit("T00:00:00Z")).alias("pushed_at"), (number % 900).alias("stargazers_count"), (number % 90).alias("forks_count"), (number % 9).alias("open_issues_count"))
    at = _landed_json(_docs(spark, sf_dir), "github", item, lambda items: F.struct(items.alias("items")))
    return _shown(src.read_github(spark, at, most=None), "gh_stars", "gh_forks", "gh_open_issues")


@query(f"WITH {_DOCS} SELECT CASE WHEN doc_id % 4 = 0 THEN 'https://news.ycombinator.com/item?id=' || doc_id ELSE 'https://y.example/' || doc_id END AS link, title, md5({_CUT('body')}) AS desc_md5, day, 'Hacker News' AS venue, 'news' AS type, CAST(doc_id % 9 AS INTEGER) AS hn_points, CAST(doc_id % 11 AS INTEGER) AS hn_comments FROM d WHERE doc_id % 9 >= 4 OR doc_id % 11 >= 6")
def source_hacker_news(spark, sf_dir):
    number = F.col("doc_id")
    item = F.struct(number.cast("string").alias("objectID"), F.col("title"), F.when(number % 4 == 0, "").otherwise(F.concat(F.lit("https://y.example/"), number.cast("string"))).alias("url"), F.col("body").alias("story_text"), F.concat("day", F.lit("T00:00:00Z")).alias("created_at"), (number % 9).alias("points"), (number % 11).alias("num_comments"))
    at = _landed_json(_docs(spark, sf_dir), "hn", item, lambda items: F.struct(items.alias("hits")))
    return _shown(src.read_hacker_news(spark, at, most=None), "hn_points", "hn_comments")


@query(f"WITH {_DOCS} SELECT CASE WHEN doc_id % 4 = 0 THEN 'https://www.reddit.com/r/a/' || doc_id ELSE 'https://z.example/' || doc_id END AS link, title, md5({_CUT('body')}) AS desc_md5, day, 'Reddit r/s' || doc_id % 3 AS venue, 'news' AS type, CAST(doc_id % 9 AS INTEGER) AS reddit_score, CAST(doc_id % 7 AS INTEGER) AS reddit_comments FROM d WHERE doc_id % 9 >= 4 OR doc_id % 7 >= 4")
def source_reddit(spark, sf_dir):
    number = F.col("doc_id")
    url = F.when(number % 4 == 0, F.concat(F.lit("/r/a/"), number.cast("string"), F.lit("/"))).otherwise(F.concat(F.lit("https://z.example/"), number.cast("string")))
    item = F.struct(F.struct(F.col("title"), url.alias("url"), F.lit("/r/p/").alias("permalink"), F.col("body").alias("selftext"), F.unix_timestamp(F.col("day").cast("timestamp")).cast("double").alias("created_utc"), (number % 9).alias("score"), (number % 7).alias("num_comments"), F.concat(F.lit("s"), (number % 3).cast("string")).alias("subreddit")).alias("data"))
    at = _landed_json(_docs(spark, sf_dir), "reddit", item, lambda items: F.struct(F.struct(items.alias("children")).alias("data")))
    return _shown(src.read_reddit(spark, at, most=None), "reddit_score", "reddit_comments")


@query(f"WITH {_DOCS} SELECT 'https://w.example/' || doc_id AS link, title, md5({_CUT('body')}) AS desc_md5, day, 'Lobsters' AS venue, 'news' AS type, CAST(doc_id % 30 AS INTEGER) AS lob_score, CAST(doc_id % 6 AS INTEGER) AS lob_comments FROM d WHERE doc_id % 3 = 0 OR title LIKE '%7%'")
def source_lobsters(spark, sf_dir):
    number = F.col("doc_id")
    item = F.struct(F.col("title"), F.concat(F.lit("https://w.example/"), number.cast("string")).alias("url"), F.col("body").alias("description"), F.concat("day", F.lit("T00:00:00Z")).alias("created_at"), (number % 30).alias("score"), (number % 6).alias("comment_count"), F.when(number % 3 == 0, F.array(F.lit("AI"))).otherwise(F.array(F.lit("other"))).alias("tags"))
    at = _landed_json(_docs(spark, sf_dir), "lobsters", item, lambda items: items)
    return _shown(src.read_lobsters(spark, at, r"\bai\b|7", most=None, first=None), "lob_score", "lob_comments")


@query(f"WITH {_DOCS} SELECT 'https://arxiv.org/abs/2402.' || {_PADDED} AS link, title, md5({_CUT('CASE WHEN doc_id % 2 = 0 THEN ' + repr('AI ') + ' || body ELSE body END', 800)}) AS desc_md5, day, CASE WHEN doc_id % 3 = 0 THEN 'huggingface:org' ELSE 'huggingface:papers' END AS venue, 'paper' AS type, CAST(doc_id % 50 AS INTEGER) AS upvotes FROM d")
def source_daily_papers(spark, sf_dir):
    number = F.col("doc_id")
    paper = F.struct(F.concat(F.lit("2402."), src.padded(number)).alias("id"), F.col("title"), F.col("body").alias("summary"), F.when(number % 2 == 0, F.concat(F.lit("AI "), "body")).alias("ai_summary"), F.concat("day", F.lit("T00:00:00Z")).alias("publishedAt"), (number % 50).alias("upvotes"), F.when(number % 3 == 0, F.struct(F.lit("org").alias("name"))).alias("organization"))
    at = _landed_json(_docs(spark, sf_dir), "papers", F.struct(paper.alias("paper")), lambda items: items)
    return _shown(src.read_daily_papers(spark, at, most=None), "upvotes")


@query(f"WITH {_DOCS} SELECT CASE doc_id % 3 WHEN 0 THEN 'https://github.com/o/r' || doc_id WHEN 1 THEN 'https://arxiv.org/abs/2403.' || doc_id ELSE 'https://v.example/' || doc_id END AS link, CASE WHEN doc_id % 7 = 0 THEN CASE doc_id % 3 WHEN 0 THEN 'https://github.com/o/r' || doc_id WHEN 1 THEN 'https://arxiv.org/abs/2403.' || doc_id ELSE 'https://v.example/' || doc_id END ELSE title END AS title, md5({_CUT('body')}) AS desc_md5, CASE doc_id % 3 WHEN 0 THEN 'repo' WHEN 1 THEN 'paper' ELSE 'news' END AS type FROM d")
def source_search(spark, sf_dir):
    number = F.col("doc_id")
    url = F.concat(F.when(number % 3 == 0, "https://github.com/o/r").when(number % 3 == 1, "https://arxiv.org/abs/2403.").otherwise("https://v.example/"), number.cast("string"))
    item = F.struct(F.when(number % 2 == 0, url).alias("url"), url.alias("sourceURL"), F.when(number % 7 == 0, " ").otherwise(F.col("title")).alias("title"), F.lit("").alias("description"), F.col("body").alias("markdown"))
    at = _landed_json(_docs(spark, sf_dir), "search", item, lambda items: F.struct(items.alias("data")))
    return _shown(src.read_search(spark, at)).drop("day", "venue")


@query("WITH k AS (SELECT page_id, url, 'e' || page_id % 5 AS etag, page_id % 2 = 0 AS fresh FROM pages), l AS (SELECT url, max(page_id) AS page_id FROM pages GROUP BY url) SELECT page_id, url FROM l WHERE NOT (page_id % 2 = 0 AND page_id % 3 <> 0)")
def changed_pages(spark, sf_dir):
    """Validators kept as JSON lines and read again; those older than a week do not count, and every third page has a new one."""
    number = F.col("page_id")
    pages = c._table(spark, sf_dir, "pages").groupBy("url").agg(F.max("page_id").alias("page_id")).withColumn("etag", F.concat(F.lit("e"), (number % 5).cast("string")))
    at = _folder(spark, "etags")
    src.to_json_rows(pages.select("url", "etag", F.when(number % 2 == 0, "2024-01-30T00:00:00").otherwise("2024-01-02T00:00:00").alias("cached_at"))).write.text(at)
    fetched = pages.withColumns({"etag": F.when(number % 3 == 0, "new").otherwise(F.col("etag")), "last_modified": F.lit(None).cast("string")})
    return src.changed(fetched, src.read_etags(spark, at, "2024-01-31 00:00:00")).select("page_id", "url")


_STORIES = f"WITH {_DOCS} SELECT doc_id, title, md5(body) AS body_md5, CAST(doc_id % 9 AS INTEGER) AS points FROM d"


def _stories(spark, sf_dir, goes: int) -> tuple[str, list[DataFrame]]:
    """A folder for files of stories, and the files' texts in so many goes; names rise with the goes."""
    number = F.col("doc_id")
    item = F.struct(number.cast("string").alias("objectID"), F.col("title"), F.col("body").alias("story_text"), (number % 9).alias("points"))
    made = lambda rows: rows.select("file", item.alias("item")).groupBy("file").agg(F.to_json(F.struct(F.collect_list("item").alias("hits"))).alias("value")).select("value", F.lpad(F.col("file").cast("string"), 12, "0").alias("file"))
    return _folder(spark, "stories"), [made(r) for r in ranges(_docs(spark, sf_dir), "file", goes)]


def _read_stories(rows: DataFrame) -> DataFrame:
    s = F.from_json("record", "objectID string, title string, story_text string, points int")
    return rows.where("error is null").select(s.alias("s")).select(F.col("s.objectID").cast("long").alias("doc_id"), "s.title", F.md5("s.story_text").alias("body_md5"), "s.points")


@query(_STORIES)
def source_landed(spark, sf_dir):
    """Files of stories by the data source that reads a partition a file."""
    landed.register(spark)
    at, goes = _stories(spark, sf_dir, 1)
    goes[0].write.partitionBy("file").text(at)
    return _read_stories(spark.read.format("landed_json").option("records", "hits").load(at))


@query(_STORIES)
def stream_landed(spark, sf_dir):
    """The same files in two goes, read as a stream that runs on from its checkpoint."""
    landed.register(spark)
    at, goes = _stories(spark, sf_dir, 2)
    for files in goes:
        files.write.mode("append").partitionBy("file").text(f"{at}/in")
        rows = _read_stories(spark.readStream.format("landed_json").option("records", "hits").load(f"{at}/in"))
        rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


# The collection cycle: four sources land in two goes; papers only come with the first ------------------------------------

_ENDS = "(SELECT min(doc_id) AS a, CAST(ceil((max(doc_id) - min(doc_id) + 1) / 2.0) AS BIGINT) AS w FROM documents)"
_HEADS = "CASE WHEN doc_id % 20 BETWEEN 1 AND 3 THEN 'Shared subject ' || repeat(chr(CAST(97 + (doc_id // 20) % 26 AS INTEGER)), 3) WHEN doc_id % 12 = 2 THEN 'On arXiv 2401.' || " + c._padded("doc_id - 2") + " ELSE 'Title ' || doc_id END"
_LANDED = f"""{_DOCS}, g AS (SELECT *, (doc_id - a) // w AS go, {_HEADS} AS head FROM d, {_ENDS}),
r AS (SELECT go, doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://arxiv.org/abs/2401.' || {_PADDED} WHEN 1 THEN 'https://github.com/own/repo' || doc_id WHEN 2 THEN 'https://y.example/' || doc_id // 9 ELSE 'https://z.example/' || doc_id END AS link,
 CASE WHEN doc_id % 4 = 0 THEN title ELSE head END AS title, {_CUT('body')} AS "desc", CAST(day AS DATE) AS event_date, CASE doc_id % 4 WHEN 0 THEN 'arXiv' WHEN 1 THEN 'GitHub' WHEN 2 THEN 'Hacker News' ELSE 'Reddit r/s' END AS venue, CASE doc_id % 4 WHEN 0 THEN 'paper' WHEN 1 THEN 'repo' ELSE 'news' END AS type
 FROM g WHERE doc_id % 4 = 1 OR (doc_id % 4 = 0 AND go = 0) OR (doc_id % 4 = 2 AND (doc_id % 9 >= 4 OR doc_id % 11 >= 6)) OR (doc_id % 4 = 3 AND (doc_id % 9 >= 4 OR doc_id % 7 >= 4)) QUALIFY row_number() OVER (PARTITION BY go, link ORDER BY event_date DESC, title) = 1)"""


def _heat_sql(x: str) -> str:
    """What heat makes of these four sources."""
    rec, topic = "greatest(0.1, exp(-date_diff('day', event_date, DATE '2024-01-31')::DOUBLE / 28.0))", c._topic_sql("lower(title || ' ' || \"desc\")")
    return f"""CAST(greatest(1, least(999, trunc(CASE WHEN type = 'paper' THEN 138 + topic + trunc(185 * rec) WHEN venue = 'Hacker News' THEN 265 + least(240.0, 46 * ln(1 + (doc_id % 9)::DOUBLE) + 30 * ln(1 + (doc_id % 11)::DOUBLE)) + trunc(138 * rec) + least(24, topic // 4)
 WHEN venue = 'Reddit r/s' THEN 228 + least(236.0, 44 * ln(1 + (doc_id % 9)::DOUBLE) + 27 * ln(1 + (doc_id % 7)::DOUBLE)) + trunc(128 * rec) + least(22, topic // 4) ELSE 198 + least(188.0, 86 * log10(greatest((doc_id % 900)::DOUBLE, 1.0) + 1)) + least(112.0, 42 * ln(1 + (doc_id % 90)::DOUBLE)) + least(58.0, 20 * ln(1 + (doc_id % 9)::DOUBLE)) + trunc(100 * rec) + least(24, topic // 4) END))) AS INTEGER) AS heat
 FROM (SELECT *, {rec} AS rec, {topic} AS topic FROM {x})"""


_CYCLE = rf"""{_LANDED}, n AS (SELECT *, coalesce(nullif(regexp_extract(link, 'arxiv\.org/(?:abs|pdf)/(\d{{4}}\.\d{{4,5}})', 1), ''), nullif(regexp_extract(title || ' ' || "desc", '(?i)arxiv:?\s*(\d{{4}}\.\d{{4,5}})', 1), '')) AS arxiv_id FROM r),
h AS (SELECT *, {_heat_sql("n")}),
w AS (SELECT *, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z]{{3,}}'), lambda x: NOT list_contains({c._list(text.TITLE_STOP)}, x)))) AS words FROM h),
p AS (SELECT go, arxiv_id FROM w WHERE arxiv_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT venue) >= 2),
k AS (SELECT go, words FROM w WHERE arxiv_id IS NULL AND len(words) >= 2 GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT venue) >= 3),
b AS (SELECT w.* REPLACE (CAST(least(999, heat + CASE WHEN p.arxiv_id IS NOT NULL THEN 60 WHEN w.arxiv_id IS NULL AND k.words IS NOT NULL THEN 30 ELSE 0 END) AS INTEGER) AS heat) FROM w LEFT JOIN p ON w.go = p.go AND w.arxiv_id = p.arxiv_id LEFT JOIN k ON w.go = k.go AND w.words = k.words),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY go, link ORDER BY heat DESC, event_date DESC) AS z FROM b) WHERE z = 1)"""


def _floor_sql(rows: str) -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY turn, heat DESC, event_date DESC, link) AS place FROM (SELECT *, CASE WHEN type <> 'paper' THEN CASE WHEN m <= 67 THEN 0 ELSE 2 END WHEN m <= 95 - (SELECT least(count(*), 67) FROM {rows} WHERE type <> 'paper') THEN 1 ELSE 2 END AS turn
 FROM (SELECT *, row_number() OVER (PARTITION BY type = 'paper' ORDER BY heat DESC, event_date DESC, link) AS m FROM {rows}))) WHERE place <= 95)"""


_ENTITY_LIST = "list_distinct(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(t), '(^|{c._NW}){f}({c._NW}|$)') THEN '{e}' END" for e, _, f in c.LEXICON) + "], lambda x: x IS NOT NULL))"


@query(f"""WITH {_CYCLE}, f1 AS {_floor_sql("(SELECT * FROM u WHERE go = 0)")},
old AS (SELECT * FROM (SELECT * FROM f1 WHERE type = 'paper' ORDER BY event_date DESC, link DESC LIMIT 112) WHERE link NOT IN (SELECT link FROM u WHERE go = 1) AND (SELECT count(*) FROM u WHERE go = 1 AND type = 'paper') < 28),
f2in AS (SELECT link, type, title, "desc", event_date, venue, heat, arxiv_id FROM u WHERE go = 1 UNION ALL SELECT h.link, h.type, h.title, h."desc", h.event_date, h.venue, h.heat, h.arxiv_id FROM old JOIN h USING (doc_id)),
f2 AS {_floor_sql("f2in")}
SELECT link, type, heat, venue, event_date, arxiv_id, array_to_string(list_sort({_ENTITY_LIST}), ',') AS entities FROM (SELECT *, title || ' ' || title || ' ' || title || ' ' || "desc" AS t FROM f2)""")
def collection_cycle(spark, sf_dir):
    """The feed after the second of two goes, which brought no papers: those of the first fill it up."""
    return _cycled(spark, sf_dir).feed().select("link", "type", "heat", "venue", "event_date", "arxiv_id", F.array_join("entities", ",").alias("entities"))


def _cycled(spark, sf_dir) -> Cycle:
    number, at = F.col("doc_id"), _folder(spark, "cycle")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    letter = F.repeat(F.char(97 + F.floor(number / 20) % 26), F.lit(3))
    head = F.when((number % 20).between(1, 3), F.concat(F.lit("Shared subject "), letter)).when(number % 12 == 2, F.concat(F.lit("On arXiv 2401."), src.padded(number - 2))).otherwise(F.col("title"))
    at_day = F.concat("day", F.lit("T00:00:00Z"))
    paper = tag("entry", F.concat(tag("id", F.concat(F.lit("http://arxiv.org/abs/2401."), src.padded(number), F.lit("v1"))), tag("title", F.col("title")), tag("summary", F.col("body")), tag("published", at_day)))
    repo = F.struct(head.alias("full_name"), F.concat(F.lit("https://github.com/Own/Repo"), number.cast("string")).alias("html_url"), F.col("body").alias("description"), at_day.alias("pushed_at"), (number % 900).alias("stargazers_count"), (number % 90).alias("forks_count"), (number % 9).alias("open_issues_count"))
    story = F.struct(number.cast("string").alias("objectID"), head.alias("title"), F.concat(F.lit("https://y.example/"), F.floor(number / 9).cast("string"), F.lit("?ref=a")).alias("url"), F.col("body").alias("story_text"), at_day.alias("created_at"), (number % 9).alias("points"), (number % 11).alias("num_comments"))
    post = F.struct(F.struct(head.alias("title"), F.concat(F.lit("https://z.example/"), number.cast("string"), F.lit("/")).alias("url"), F.lit("/r/p/").alias("permalink"), F.col("body").alias("selftext"), F.unix_timestamp(F.col("day").cast("timestamp")).cast("double").alias("created_utc"), (number % 9).alias("score"), (number % 7).alias("num_comments"), F.lit("s").alias("subreddit")).alias("data"))
    made = {
        "arxiv": (paper, lambda items: tag("feed", F.array_join(items, ""))), "github": (repo, lambda items: F.to_json(F.struct(items.alias("items")))),
        "hacker_news": (story, lambda items: F.to_json(F.struct(items.alias("hits")))), "reddit": (post, lambda items: F.to_json(F.struct(F.struct(items.alias("children")).alias("data")))),
    }
    loaders = {"arxiv": src.read_arxiv, "github": src.read_github, "hacker_news": src.read_hacker_news, "reddit": src.read_reddit}
    every = {name: (lambda s, paths, read=read: read(s, paths, most=None)) for name, read in loaders.items()}
    # A go is one batch, however many files it lands.
    made_of = Cycle(spark, f"{at}/landed", f"{at}/kept", every, src.AS_OF, c.LEXICON, c.TOPICS, most_files=None)
    for go, rows in enumerate(ranges(_docs(spark, sf_dir), "doc_id", 2)):
        for n, (name, (item, wrap)) in enumerate(made.items()):
            some = rows.where((number % 4 == n) if go == 0 or n else F.lit(False))
            whole = some.select("file", item.alias("item")).groupBy("file").agg(F.collect_list("item").alias("items"))
            # A file for each row, in one folder, which is listed at once.
            whole.select(wrap(F.col("items")).alias("value"), F.lit(go).alias("go")).write.mode("append").option("maxRecordsPerFile", 1).partitionBy("go").text(f"{at}/landed/{name}")
        made_of.run()
    return made_of
