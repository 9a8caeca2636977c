"""The registered queries of this subpackage and their DuckDB twins, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewright.llm.token_store import token_store

    return token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewright.llm.unigram_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewright.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.mixing_lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op6_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.merkle import manifest, root_from, siblings, tampered

    docs = table(spark, sf_dir, "documents")
    m = manifest(docs, tampered(docs))
    m = m.withColumn("folded_root", root_from(F.col("path"), F.coalesce("other", "leaf")))
    return m.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.decontaminate import decontaminate, words_hit

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = words_hit(F.col("occurrences"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("occurrences") > 0).alias("contaminated"))


OPERATORS = (
    op1_learned_partitions,
    op2_token_store,
    op3_unigram_counts,
    op4_pack_documents,
    op5_context_mixing,
    op6_scan_licenses,
    op7_language_id,
    op8_exact_dedup,
    op9_jaccard_join,
    op10_mix_sources,
    op11_ranked_search,
    op12_merkle_manifest,
    op13_decontaminate,
)
QUERIES = {f.__name__: f for f in OPERATORS}

SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"


SQL = {
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op11_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
        i AS (SELECT row_number() OVER () AS qid, item_id, {WORDS} AS w FROM benchmark),
        tf AS (SELECT rid, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT rid, doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
        c AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
        q AS (SELECT qid, item_id, term, count(*) AS times FROM (SELECT qid, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
        weighted AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
        scored AS (
            SELECT qid, item_id, rid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
            FROM q JOIN weighted USING (term) JOIN tf USING (term), c GROUP BY ALL
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 10
    """,
    "op12_merkle_manifest": f"""
        WITH RECURSIVE crc_of AS (
            SELECT list(v ORDER BY i) AS tab
            FROM (SELECT i, list_reduce([i] || range(8), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
        ),
        d AS (
            SELECT row_number() OVER () AS rid, *,
                   xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) AS crc
            FROM documents, crc_of
        ),
        hashed AS (
            SELECT rid, doc_id, source, sha256(concat({", ".join(map(field, ("doc_id", "source", "lang", "n_chars")))}, {field("text")})) AS leaf,
                   CASE WHEN crc % 5 = 0 THEN sha256(concat({", ".join(map(field, ("doc_id", "source", "lang", "n_chars")))}, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || {SMALL} END)) END AS other
            FROM d
        ),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, other NULLS FIRST) - 1 AS idx FROM hashed),
        nodes AS (
            SELECT source, 0 AS lvl, idx, leaf AS h FROM leaves
            UNION ALL
            SELECT source, lvl + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx))
            FROM (SELECT *, count(*) OVER (PARTITION BY source) AS k FROM nodes) WHERE k > 1 GROUP BY source, lvl, idx // 16
        ),
        subroots AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx FROM (SELECT * FROM nodes QUALIFY lvl = max(lvl) OVER (PARTITION BY source))),
        tops AS (
            SELECT 0 AS lvl, idx, h FROM subroots
            UNION ALL
            SELECT lvl + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS k FROM tops) WHERE k > 1 GROUP BY lvl, idx // 16
        ),
        runs AS (
            SELECT source, lvl, idx // 16 AS run, list(h ORDER BY idx) AS hs
            FROM (SELECT *, count(*) OVER (PARTITION BY source, lvl) AS k FROM nodes) WHERE k > 1 GROUP BY source, lvl, idx // 16
        ),
        top_runs AS (SELECT lvl, idx // 16 AS run, list(h ORDER BY idx) AS hs FROM (SELECT *, count(*) OVER (PARTITION BY lvl) AS k FROM tops) WHERE k > 1 GROUP BY lvl, idx // 16),
        steps AS (
            SELECT rid, lvl AS nth, (idx // CAST(pow(16, lvl) AS BIGINT)) % 16 + 1 AS place, hs
            FROM leaves l JOIN runs r ON l.source IS NOT DISTINCT FROM r.source AND r.run = l.idx // CAST(pow(16, lvl + 1) AS BIGINT)
            UNION ALL
            SELECT rid, 1000 + lvl, (s.idx // CAST(pow(16, lvl) AS BIGINT)) % 16 + 1, hs
            FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN top_runs r ON r.run = s.idx // CAST(pow(16, lvl + 1) AS BIGINT)
        ),
        paths AS (
            SELECT rid, list([array_to_string(list_slice(hs, 1, place - 1), ''), array_to_string(list_slice(hs, place + 1, 16), '')] ORDER BY nth) AS path FROM steps GROUP BY rid
        ),
        whole AS (SELECT h AS root FROM tops QUALIFY lvl = max(lvl) OVER ())
        SELECT *, folded_root = root AS verified FROM (
            SELECT l.doc_id, leaf, s.h AS subroot, root, sha256(array_to_string(list_transform(coalesce(path, []), lambda x: x[1] || x[2]), '')) AS proof_sha256,
                   list_reduce([[coalesce(other, leaf)]] || coalesce(path, []), lambda acc, x: [sha256(x[1] || acc[1] || x[2])])[1] AS folded_root
            FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source LEFT JOIN paths USING (rid), whole
        )
    """,
    "op13_decontaminate": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
        i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS} AS w FROM benchmark),
        windows AS (SELECT DISTINCT item, list_slice(w, pos, pos + 9) AS win FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS pos FROM i WHERE len(w) > 0)),
        keyed AS (SELECT item, len(win) AS n, array_to_string(win, ' ') AS k FROM windows),
        places AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM keyed)),
        hits AS (SELECT rid, pos, n, item FROM (SELECT rid, pos, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS k FROM places) JOIN keyed USING (k, n)),
        hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY rid),
        met AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit USING (rid) LEFT JOIN met USING (rid)
    """,
}
