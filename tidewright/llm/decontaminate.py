"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is `WINDOW` consecutive words of an item (all its words, if it has fewer); as a set it holds the shingles of
`SHINGLE` words in it. A text contains a window only if it contains every shingle, so one shingle, the window's prefix,
is enough to find candidates: the one that is rarest in the documents, as a first pass over them counts. A window with
a shingle that no document holds is dropped. The second pass joins the documents' shingles to the prefixes, keeps
candidates where the whole window fits into the text at that place (length and position), and compares word by word.

Both joins are broadcasts of dictionaries that are dealt into blocks of a bounded size, one pass for each block, so
that no benchmark is too large. Texts are never shuffled; a document's occurrences meet in one group, which is no
longer than its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import text_column, written

WINDOW = 10
SHINGLE = 5
#: Windows (with the ids of their items) and shingles that one broadcast holds: tens of MB.
MOST_WINDOWS = 1 << 17
MOST_SHINGLES = 1 << 20
#: Rows that repeat id and text are told apart by number only, so many at a time.
REPEATS = 4096
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Outside ASCII, what lower() might change: all but small letters and letters without case.
MAY_HAVE_CASE = r"[^\x00-\x7F\p{Ll}\p{Lo}]"


def words(text: Column) -> Column:
    """The words of a text, A-Z as a-z and nothing else changed."""
    plain = (F.octet_length(text) == F.length(text)) | ~F.rlike(text, F.lit(MAY_HAVE_CASE))
    small = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(small, BETWEEN_WORDS), lambda w: w != "")


def shingle(w: Column, at: Column, size: int) -> Column:
    """A hash of `size` words from the place `at` (from 0); never null."""
    return F.xxhash64(*(F.get(w, at + k) for k in range(size)))


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """items (id, text) -> window (array of words), ids (sorted, distinct): each window once, with all its items."""
    w = items.select("id", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = w.select("id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))).alias("at"))
    return starts.select("id", F.slice("w", F.col("at"), F.lit(window)).alias("window")).groupBy("window").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def shingles_of(windows: DataFrame) -> DataFrame:
    """A row for each shingle of each window: window, ids, at (its place in the window, from 0), size, h."""
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("window") - SHINGLE))
    each = windows.select("window", "ids", F.least(F.lit(SHINGLE), F.size("window")).alias("size"), F.explode(places).alias("at"))
    h = F.coalesce(*(F.when(F.col("size") == n, shingle(F.col("window"), F.col("at"), n)) for n in range(1, SHINGLE + 1)))
    return each.withColumn("h", h)


def spelt(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each word and size of shingle: doc_id, text_key, w (an empty word, then the words), n, pos (0 for the empty word), h."""
    text = text_column(docs)
    whole = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.concat(F.array(F.lit("")), words(text)).alias("w"))
    each = whole.select("doc_id", "text_key", "w", F.posexplode("w").alias("pos", "_")).drop("_")
    n, pos, w = F.size("w") - 1, F.col("pos"), F.col("w")
    # 0 stands for the text as a whole, 1 for no shingle; neither is ever taken for one, as places and words are compared
    keys = [F.when(pos == 0, F.lit(0 if k == 0 else 1)).when(pos + (size - 1) <= n, shingle(w, pos, size)).otherwise(F.lit(1)) for k, size in enumerate(sizes)]
    return each.select("doc_id", "text_key", "w", n.alias("n"), "pos", (keys[0] if len(keys) == 1 else F.explode(F.array(*keys))).alias("h"))


def in_blocks(rows: DataFrame, key: str, most: int) -> list[DataFrame]:
    """rows in blocks of about `most`, each to be broadcast; `key` is a hash."""
    n = -(-rows.count() // most)
    return [F.broadcast(rows.where(F.pmod(F.xxhash64(F.lit(7), key), F.lit(n)) == b) if n > 1 else rows) for b in range(n)]


def every(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def prefixes(docs: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, list[int]]:
    """(window, ids, at, h of the shingle of each window that is rarest in docs; the sizes of shingles).

    Windows with a shingle that docs lack are left out: they can't occur.
    """
    each = written(shingles_of(windows_of(items, window)), "shingles")
    sizes = sorted((r[0] for r in each.select("size").distinct().collect()), reverse=True)  # 5 at most
    if not sizes:
        return each.drop("size"), sizes
    counts = [spelt(docs, sizes).join(b, "h").groupBy("h").agg(F.count("*").alias("k")) for b in in_blocks(each.select("h").distinct(), "h", MOST_SHINGLES)]
    found = each.join(every(counts), "h", "left")
    rarest = found.groupBy("window").agg(F.first("ids").alias("ids"), F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "h", "at")).alias("rarest"))
    return written(rarest.where("rarest.k > 0").select("window", "ids", "rarest.at", "rarest.h"), "prefixes"), sizes


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, occurrences, items.

    occurrences are the places where a window of an item (item_id, text) stands, in order, each once: start (words
    from 0) and length. items are the ids of the items with such windows, as strings, sorted, each once; a null id is
    an empty string. Null texts have no words; texts and items without words have no occurrences. Rows that repeat an
    id, or id and text, get a row each; items that repeat an id count as one. Without items nothing occurs; without
    documents there are no rows. Other columns are not read.
    """
    items = items.select(F.coalesce(items["item_id"].cast("string"), F.lit("")).alias("id"), text_column(items).alias("text"))
    found, sizes = prefixes(docs, items, window)
    blocks = in_blocks(found, "h", MOST_WINDOWS)
    whole = found.sparkSession.range(1).select(F.lit(0).cast("long").alias("h"), F.lit(0).alias("at"), F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast("array<string>").alias("ids"))
    blocks = [F.broadcast(whole.unionByName(blocks[0]) if blocks else whole), *blocks[1:]]
    n, length, start = F.col("n"), F.size("window"), F.col("pos") - F.col("at")
    text = (F.col("pos") == 0) & F.col("window").isNull()
    fits = (start >= 1) & (start + length - 1 <= n)
    same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.greatest(length, F.lit(0))) == F.col("window")
    hits = []
    for block in blocks:
        met = spelt(docs, sizes or [SHINGLE]).join(block, "h").where(text | (F.col("window").isNotNull() & fits & same))
        span = F.when(F.col("window").isNotNull(), F.struct((start - 1).alias("start"), length.alias("length")))
        hits.append(met.select("doc_id", "text_key", F.when(F.col("window").isNull(), n).alias("n"), span.alias("span"), "ids"))
    by_text = every(hits).groupBy("doc_id", "text_key").agg(F.max("n").cast("long").alias("n_words"), F.count("n").alias("rows"), F.collect_set("span").alias("spans"), F.collect_set("ids").alias("ids"))
    out = by_text.select("doc_id", "n_words", "rows", F.sort_array("spans").alias("occurrences"), F.array_sort(F.array_distinct(F.flatten("ids"))).alias("items"))
    out = out.select("*", F.explode(F.expr(f"sequence(0, (rows - 1) div {REPEATS})")).alias("lot"))
    repeated = F.explode(F.expr(f"sequence(1, least({REPEATS}, rows - lot * {REPEATS}))"))
    return out.select("doc_id", "n_words", "occurrences", "items", repeated.alias("_")).drop("_")


def words_hit(occurrences: Column) -> Column:
    """The number of words inside any occurrence (sorted by start)."""
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("to"))

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        return F.struct((acc["hit"] + F.greatest(F.lit(0), end - F.greatest(x["start"], acc["to"]))).alias("hit"), F.greatest(end, acc["to"]).alias("to"))

    return F.aggregate(occurrences, zero, step, lambda acc: acc["hit"]).cast("long")
