"""Aggregates of articles, filings and embeddings, and the panels built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import text
from tidewright.operators import asof, dedup, news, ordering
from tidewright.plans import stand_ins as s

#: As in the reference's caches.
MAX_TOKENS = 64
VECTOR = "mean_positive neutral_proportion mean_negative mean_score max_positive max_negative score_deviation decayed_score weighted_score holding_score hashed_share trusted_score disagreement sector_share coverage freshness_hours"
VECTOR_SQL = """count(*) AS article_count, avg(positive) AS mean_positive, greatest(0, 1 - avg(positive) - avg(negative)) AS neutral_proportion, avg(negative) AS mean_negative, avg(score) AS mean_score, max(positive) AS max_positive, max(negative) AS max_negative,
    stddev_pop(score) AS score_deviation, avg(score * exp(-age_hours / 12)) AS decayed_score, avg(score * weight) AS weighted_score, avg(score * weight) * count(*) FILTER (WHERE weight > 0) / count(*) AS holding_score, count(*) AS abnormal_volume,
    avg(CASE WHEN content_hash <> '' THEN 1.0 ELSE 0 END) AS hashed_share, avg(score * CASE WHEN fixture THEN 0.5 ELSE 1 END) AS trusted_score, stddev_pop(score) AS disagreement, avg(sector_share) AS sector_share, count(*) FILTER (WHERE macro) AS macro_count, 1.0::DOUBLE AS coverage, min(age_hours) AS freshness_hours"""

VECTOR_SQL_NAMES = "article_count mean_positive neutral_proportion mean_negative mean_score max_positive max_negative score_deviation decayed_score weighted_score holding_score abnormal_volume hashed_share trusted_score disagreement sector_share macro_count coverage freshness_hours".split()


def embedded(x, d):
    """Embeddings as articles: two to a content, by label and a session of a hundred ids."""
    e = s.table(x, d, "embeddings")
    return e.select(F.col("label").alias("sector"), F.floor(F.col("vec_id") / 100).alias("session"), F.floor(F.col("vec_id") / 2).cast("string").alias("content_hash"), (F.col("vec_id") % 7).alias("symbol"), F.col("vec_id").alias("seq"), "embedding", ((F.col("vec_id") % 21) / 10 - 1).alias("sentiment"))


EMBEDDED = "e AS (SELECT label AS sector, vec_id // 100 AS session, vec_id // 2 AS content_hash, vec_id % 7 AS symbol, vec_id AS seq, embedding, (vec_id % 21) / 10 - 1 AS sentiment FROM embeddings)"


def facts(x, d):
    li = s.table(x, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("accn"), (F.col("l_suppkey") % 3).alias("priority"), F.when(F.col("l_partkey") % 2 == 0, "f").alias("frame"), F.to_date("l_shipdate").alias("end"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("seq"), F.col("l_extendedprice").alias("val"))


def fill(add) -> None:
    q = s.sql
    a = lambda x, d: s.articles(x, d).withColumn("embedding", F.array((F.col("doc_id") % 11).cast("double"), (F.col("doc_id") % 13).cast("double")))
    add("A1", lambda x, d: news.daily_vector(a(x, d), ["sector", "day"], 2), q("articles", f"SELECT sector, day, {VECTOR_SQL}, avg(doc_id % 11) AS embedding_0, avg(doc_id % 13) AS embedding_1 FROM articles GROUP BY 1, 2"), VECTOR + " embedding_0 embedding_1", "day")
    calendar = lambda x, d: s.sessions(x, d).select(F.col("session").alias("day")).crossJoin(s.table(x, d, "documents").select(F.col("lang").alias("sector")).distinct())
    add("A2", lambda x, d: news.zero_filled(calendar(x, d), news.eligible(a(x, d), "published_ms", F.lit(788_918_400_000 + 86_400_000 * 3), F.lit(788_918_400_000 + 86_400_000 * 90)).groupBy("day", "sector").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")), ["day", "sector"]), q("articles sessions", """SELECT c.day, c.sector, coalesce(n, 0) AS n, coalesce(mean_score, 0) AS mean_score, CASE WHEN n IS NULL THEN 'empty' ELSE 'ok' END AS coverage_status
        FROM (SELECT session AS day, lang AS sector FROM sessions, (SELECT DISTINCT lang FROM documents)) c LEFT JOIN (SELECT day, sector, count(*) AS n, avg(score) AS mean_score FROM articles WHERE published_ms BETWEEN 788918400000 + 259200000 AND 788918400000 + 7776000000 GROUP BY 1, 2) f ON f.day = c.day AND f.sector = c.sector"""), "mean_score", "day")
    add("A3", lambda x, d: news.control_counts(s.articles(x, d), ["day", "sector"]), q("articles", "SELECT day, sector, count(*) AS news_rows, 1::BIGINT AS has_news, count(DISTINCT content_hash) / count(*) AS distinct_share, count(DISTINCT CASE WHEN trim(publisher) <> '' THEN publisher END) AS publishers FROM articles GROUP BY 1, 2"), "distinct_share", "day")
    counts = "count(*) AS filings, count(DISTINCT issuer) AS issuers, count(*) FILTER (WHERE form LIKE '8-K%') AS n_8k, count(*) FILTER (WHERE form LIKE '10-Q%') AS n_10q, count(*) FILTER (WHERE form LIKE '10-K%') AS n_10k, count(*) FILTER (WHERE NOT (form LIKE '8-K%' OR form LIKE '10-Q%' OR form LIKE '10-K%')) AS n_other"
    add("A4", lambda x, d: news.filing_counts(s.filings(x, d), ["accepted", "sector"]), q("filings", f"SELECT accepted, sector, {counts} FROM filings GROUP BY 1, 2"), "", "accepted")
    add("A5", lambda x, d: news.filing_counts(s.filings(x, d), ["accepted", "sector"], "sentiment"), q("filings", f"SELECT accepted, sector, {counts}, avg(sentiment) AS mean_sentiment FROM filings GROUP BY 1, 2"), "mean_sentiment", "accepted")
    add("A6", lambda x, d: fundamentals(x, d), q("filings", """SELECT day, sector, count(*) AS issuers, coalesce(avg(CASE WHEN sentiment > 0 THEN sentiment END), 0) AS mean_positive FROM (SELECT m.day, f.sector, f.issuer, f.sentiment FROM (SELECT DISTINCT CAST(date_trunc('month', accepted) AS DATE) AS day FROM filings) m,
        filings f WHERE f.accepted <= m.day QUALIFY row_number() OVER (PARTITION BY m.day, f.issuer ORDER BY accepted DESC, filing DESC) = 1) GROUP BY 1, 2"""), "mean_positive", "day")
    add("A7", lambda x, d: news.choose_facts(facts(x, d), ["accn"]).select("accn", "priority", "end", "val"), 'SELECT l_orderkey AS accn, l_suppkey % 3 AS priority, CAST(l_shipdate AS DATE) AS "end", l_extendedprice AS val FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 3, l_partkey % 2, CAST(l_shipdate AS DATE) DESC, l_linenumber, l_partkey) = 1', "val", '"end"')
    add("A8", lambda x, d: insiders(x, d), q("filings sessions", "SELECT session, sector, count(*) FILTER (WHERE form = '4') AS form4, count(*) FILTER (WHERE form IN ('3', '5')) AS form3_5, count(*) FILTER (WHERE form LIKE 'SC 13%' OR form LIKE 'SCHEDULE 13%') AS schedule13, count(DISTINCT issuer) AS issuers FROM filings f ASOF JOIN sessions ON accepted < session GROUP BY 1, 2"), "", "session")
    dims = ", ".join(f"avg(embedding[{i + 1}]::DOUBLE) AS mean_{i}" for i in range(8))
    add("A9", lambda x, d: news.embedding_means(embedded(x, d), ["session", "sector"], 8), f"WITH {EMBEDDED}, o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY session, sector, content_hash ORDER BY seq) = 1) SELECT session, sector, symbols, contents, {', '.join(f'mean_{i}' for i in range(8))}, sentiment_mean, sentiment_deviation, sentiment_min, sentiment_max FROM (SELECT session, sector, count(DISTINCT symbol) AS symbols FROM e GROUP BY 1, 2) JOIN (SELECT session, sector, count(*) AS contents, {dims}, avg(sentiment) AS sentiment_mean, stddev_pop(sentiment) AS sentiment_deviation, min(sentiment) AS sentiment_min, max(sentiment) AS sentiment_max FROM o GROUP BY 1, 2) USING (session, sector)", " ".join(f"mean_{i}" for i in range(8)) + " sentiment_mean sentiment_deviation sentiment_min sentiment_max", "", "sector")
    add("A10", lambda x, d: news.coverage_audit(s.articles(x, d).select(F.col("doc_id").alias("id"), F.col("day").alias("date"), "sector", "content_hash")), q("articles", "SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, (SELECT count(*) FROM (SELECT day FROM articles GROUP BY day HAVING count(DISTINCT sector) >= 3)) AS dates_3, (SELECT count(*) FROM (SELECT day FROM articles GROUP BY day HAVING count(DISTINCT sector) >= 8)) AS dates_8, (SELECT max(k) FROM (SELECT count(DISTINCT sector) AS k FROM articles GROUP BY day)) AS most_sectors, (SELECT count(*) FROM (SELECT content_hash FROM articles GROUP BY 1 HAVING count(DISTINCT day) > 1)) AS hashes_in_many_sessions FROM articles"))
    add("A13", lambda x, d: ordering.quantiles(s.table(x, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1", "p50 p95 p99")
    add("A16", lambda x, d: dedup.sample_strata(s.articles(x, d), ["publisher", F.trunc("day", "month")], "doc_id", 2).select("doc_id"), q("articles", "SELECT doc_id FROM articles QUALIFY row_number() OVER (PARTITION BY publisher, date_trunc('month', day) ORDER BY doc_id) <= 2"))
    add("A19", lambda x, d: news.sector_map(s.snapshots(x, d).groupBy("snapshot", (F.col("symbol") % 3).cast("string").alias("sector")).agg((F.sum("weight") / 1e9).alias("w")), ["snapshot"], "sector", "w"), q("snapshots", "SELECT snapshot, string_agg(sector || '=' || CAST(CAST(round(w, 6) AS DECIMAL(20, 6)) AS VARCHAR), ';' ORDER BY round(w, 6) DESC, sector DESC) AS exposures FROM (SELECT snapshot, CAST(symbol % 3 AS VARCHAR) AS sector, sum(weight) / 1e9 AS w FROM snapshots GROUP BY 1, 2) GROUP BY 1"), "", "snapshot")
    # text: the given pages nest nothing hidden, so that SQL can tell what they show
    add("F18", lambda x, d: s.table(x, d, "pages").select("page_id", text.visible_text(F.col("html")).alias("text")), f"SELECT page_id, {visible_sql('html')} AS text FROM pages")
    add("F19", lambda x, d: s.table(x, d, "pages").select("page_id", text.sections(text.visible_text(F.col("html"))).alias("sections")), f"SELECT page_id, {sections_sql('t')} AS sections FROM (SELECT page_id, {visible_sql('html')} AS t FROM pages)")
    add("F19_items", lambda x, d: itemised(x, d).select("doc_id", text.sections(F.col("text")).alias("sections")), f"SELECT doc_id, {sections_sql('t')} AS sections FROM ({ITEMISED})")
    add("F20", lambda x, d: text.links(s.table(x, d, "pages"), "page_id", "html").withColumn("exhibit", text.is_exhibit(F.col("href"))), "SELECT page_id, CAST(i - 1 AS BIGINT) AS position, href[i] AS href, regexp_matches(lower(href[i]), 'ex(hibit)?[-_ ]?99') AS exhibit FROM (SELECT page_id, regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']*)', 1) AS href FROM pages), LATERAL (SELECT unnest(generate_series(1, len(href))) AS i)")
    # a vocabulary's pieces: no SQL twin
    add("F22", lambda x, d: pieces(x, d).select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), "input_hash", "text_hash"))
    # panels
    add("D5", lambda x, d: news.zero_filled(s.daily(x, d).select("symbol", "date"), news.filing_counts(s.filings(x, d).withColumnsRenamed({"sector": "symbol", "accepted": "date"}), ["symbol", "date"], "sentiment"), ["symbol", "date"]), q("daily filings", f"SELECT symbol, date, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('filings', 'issuers', 'n_8k', 'n_10q', 'n_10k', 'n_other', 'mean_sentiment'))}, CASE WHEN filings IS NULL THEN 'empty' ELSE 'ok' END AS coverage_status FROM daily LEFT JOIN (SELECT accepted AS date, sector AS symbol, {counts}, avg(sentiment) AS mean_sentiment FROM filings GROUP BY 1, 2) USING (symbol, date)"), "mean_sentiment", "date")
    add("D9", lambda x, d: asof.next_session(s.filings(x, d).where(F.col("form").isin("8-K", "10-Q", "10-K", "10-K/A")), s.sessions(x, d), F.col("accepted"), False).groupBy("session", "form").agg(F.count("*").alias("n")), q("filings sessions", "SELECT session, form, count(*) AS n FROM (SELECT * FROM filings WHERE form IN ('8-K', '10-Q', '10-K', '10-K/A')) f ASOF LEFT JOIN sessions ON accepted < session GROUP BY 1, 2"), "", "session")
    add("D11", lambda x, d: inputs(x, d))
    add("D12", lambda x, d: shifted(x, d), q("articles", "SELECT sector, day, n, lead(n, 1, 0) OVER (PARTITION BY sector ORDER BY day) AS next_n FROM (SELECT sector, day, count(*) AS n FROM articles GROUP BY 1, 2)"), "", "day")
    add("D6", lambda x, d: imported(x, d), q("articles sessions snapshots", f"""SELECT doc_id, session, content_hash FROM (SELECT * FROM articles QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1) ASOF JOIN sessions ON day < session"""), "", "session")


def visible_sql(html: str) -> str:
    """What a page shows, where hidden elements aren't nested: tags as spaces, cut, white space collapsed after that."""
    return rf"trim(regexp_replace(substr(regexp_replace({html}, '(?is)<!--.*?-->|<(?:script|style)\b[^>]*>.*?</(?:script|style)>|<[^>]*>', ' ', 'g'), 1, {text.CAP}), '\s+', ' ', 'g'))"


def sections_sql(t: str) -> str:
    parts = rf"string_split(regexp_replace({t}, '(^|[^A-Za-z0-9])((?i:item) [0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))[2:]"
    trimmed = rf"list_transform({parts}, lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g'))"
    return f"substr(coalesce(nullif(array_to_string(list_filter({trimmed}, lambda p: lower(p) NOT LIKE 'item 9.01%'), ' '), ''), {t}), 1, {text.CAP})"


def itemised(x, d):
    """Documents as filings: sentences begin items, some of them lists of exhibits; the word itself stands inside others."""
    spelt = F.regexp_replace(F.regexp_replace("text", r"\. ([A-F])", ". Item 9.01 $1"), r"\. ([G-Z])", ".\nITEM 2 subitem 3 $1")
    return s.table(x, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.regexp_replace("text", r"\. ", ". item 9.01 ")).otherwise(spelt).alias("text"))


ITEMISED = r"""SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN regexp_replace(text, '\. ', '. item 9.01 ', 'g') ELSE regexp_replace(regexp_replace(text, '\. ([A-F])', '. Item 9.01 \1', 'g'), '\. ([G-Z])', '.' || chr(10) || 'ITEM 2 subitem 3 \1', 'g') END, '') AS t FROM documents"""


def pieces(x, d):
    """Documents as model inputs of MAX_TOKENS ids, beside the hash of their whole text."""
    import public_tokenizers

    docs = s.table(x, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("text_hash"))
    return text.word_pieces(docs, "text", text.public_pieces(public_tokenizers.path("piece_bpe_32k.model")), MAX_TOKENS)


def inputs(x, d):
    """One row for each model input and whole text: texts counts the different texts that are one input."""
    each = pieces(x, d).groupBy("input_hash", "text_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("occurrences"))
    texts = each.groupBy("input_hash").agg(F.count("*").alias("texts"))
    return each.join(texts, "input_hash").select("input_hash", "text_hash", "doc_id", "occurrences", "texts")


def fundamentals(x, d):
    """Per month and sector: issuers with a filing by then, and means over their newest one.

    A filing is the newest from its day to the issuer's next one, so each is spelt out over the months between; the
    months that have filings are one row each, of a calendar.
    """
    from pyspark.sql import Window

    from tidewright.session import keep_first

    f = s.filings(x, d)
    months = f.select(F.trunc("accepted", "month").alias("day")).distinct()
    last = months.agg(F.max("day")).first()[0]
    one = keep_first(f, ["issuer", "accepted"], [F.desc("filing")])
    after = F.coalesce(F.lead("accepted").over(Window.partitionBy("issuer").orderBy("accepted")), F.date_add(F.lit(last), 1))
    spells = one.select("issuer", "sector", "sentiment", "accepted", after.alias("after"))
    first = F.trunc(F.add_months(F.date_add("accepted", -1), 1), "month")  # of the months that start on the day or later
    spelt = spells.where(first < F.col("after")).select("issuer", "sector", "sentiment", F.explode(F.sequence(first, F.date_add("after", -1), F.expr("interval 1 month"))).alias("day"))
    found = spelt.join(F.broadcast(months), "day")
    return found.groupBy("day", "sector").agg(F.count("*").alias("issuers"), F.coalesce(F.avg(F.when(F.col("sentiment") > 0, F.col("sentiment"))), F.lit(0.0)).alias("mean_positive"))


def insiders(x, d):
    found = asof.next_session(s.filings(x, d), s.sessions(x, d), F.col("accepted"), False).where("session is not null")
    return news.insider_counts(found, ["session", "sector"])


def shifted(x, d):
    from tidewright.operators.rolling import shifted_forward

    n = s.articles(x, d).groupBy("sector", "day").agg(F.count("*").alias("n"))
    return n.select("sector", "day", "n", shifted_forward("n", ["sector"], "day").alias("next_n"))


def imported(x, d):
    """Articles, one for each content, with the session after their day."""
    from tidewright.session import keep_first

    once = keep_first(s.articles(x, d), ["content_hash"], ["doc_id"])
    return asof.next_session(once, s.sessions(x, d), F.col("day"), False).where("session is not null").select("doc_id", "session", "content_hash")
