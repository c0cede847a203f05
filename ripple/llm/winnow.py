"""Benchmark decontamination by winnowing (operator 8); DataFrame functions only.

A window is WINDOW consecutive words of an item (a shorter item is one window).
Its fingerprint is the smallest hash of its K-word runs, so a document that holds
the window has that fingerprint too, as the smallest hash among the same runs:
every shared span of WINDOW words is found, whatever surrounds it.  Documents are
read in blocks of BLOCK words, each with the words that windows begun in it need;
of a block's sliding windows, each stretch that keeps one smallest hash is a row.
These rows are joined with the items' fingerprints, and the hits, with their
block's words, are extended to whole windows, which are compared word by word with
the items' windows.  Texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripple.llm.common import quote, quoted, written

WINDOW, K = 8, 5
BLOCK = 96
#: A join side of so many bytes at most is sent to all executors; a larger one is shuffled.
BROADCAST_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, no other letter changed; null as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The runs of a-z, 0-9 and characters beyond ASCII, after lower-casing A-Z."""
    return F.array_remove(F.split(lowered(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _upto(n: Column) -> Column:
    """0 .. n-1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def run_hashes(w: Column, length: int) -> Column:
    """Hashes of the K-word runs that count for windows of ``length`` words."""
    k = min(K, length)
    return F.transform(_upto(F.size(w) - (k - 1)), lambda i: F.xxhash64(F.lit(length), *[F.get(w, i + j) for j in range(k)]))


def smallest(h: Column, length: int) -> Column:
    """The smallest of the runs' hashes for each window start, in order."""
    width = length - min(K, length) + 1
    if width == 1:
        return h
    return F.transform(_upto(F.size(h) - (width - 1)), lambda i: F.least(*[F.get(h, i + j) for j in range(width)]))


def fits(side: DataFrame, size: Column) -> bool:
    """Whether rows of ``size`` bytes each may be broadcast."""
    return (side.agg(F.sum(size + 48)).first()[0] or 0) <= BROADCAST_BYTES


def _fitting(side: DataFrame, size: Column) -> DataFrame:
    return F.broadcast(side) if fits(side, size) else side


def item_windows(items: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """The windows of all items: (length, print, window, item).  Items without key or words have none."""
    # Written, as the optimizer would copy the splitting into every filter on its result.
    w = items.select(F.col(quote(key)).cast("string").alias("item"), words(F.col(quote(text))).alias("w"))
    w = written(w, "items").where(F.col("item").isNotNull() & (F.size("w") > 0))
    parts = []
    for length in range(1, window + 1):
        of = w.where(F.size("w") >= window if length == window else F.size("w") == length)
        at = of.withColumn("h", run_hashes(F.col("w"), length)).select("item", "w", F.posexplode(smallest(F.col("h"), length)).alias("s", "print"))
        parts.append(at.select("item", F.lit(length).alias("length"), "print", F.array_join(F.slice("w", F.col("s") + 1, length), " ").alias("window")))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.distinct()


def blocks(docs: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """(id, text_hash, block, words): BLOCK words each, and those after them that windows begun in the block need."""
    w = docs.select(F.col(quote(key)).alias("id"), F.xxhash64(quote(text)).alias("text_hash"), words(F.col(quote(text))).alias("w"))
    starts = _upto(F.ceil(F.size("w") / BLOCK).cast("int"))
    cut = F.transform(starts, lambda i: F.slice("w", i * BLOCK + 1, BLOCK + window - 1))
    return w.select("id", "text_hash", F.posexplode(cut).alias("block", "words"))


def _changes(x: Column) -> Column:
    """Where the array's values differ from those before."""
    return F.filter(_upto(F.size(x)), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1)))


def runs(block: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for each stretch of a block's windows with one smallest hash: (id, text_hash, block, words, length, print, start, n)."""
    for n in lengths:
        block = block.withColumn(f"h{n}", run_hashes(F.col("words"), n))
    for n in lengths:
        block = block.withColumn(f"m{n}", F.slice(smallest(F.col(f"h{n}"), n), 1, BLOCK))
    for n in lengths:
        block = block.withColumn(f"s{n}", _changes(F.col(f"m{n}")))

    def stretch(n: int) -> Column:
        m, s = F.col(f"m{n}"), F.col(f"s{n}")
        return F.transform(s, lambda at, i: F.struct(F.lit(n).alias("length"), F.get(m, at).alias("print"), at.alias("start"), (F.coalesce(F.get(s, i + 1), F.size(m)) - at).alias("n")))

    return block.select("id", "text_hash", "block", "words", F.inline(F.concat(*[stretch(n) for n in lengths])))


def matches(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, window: int = WINDOW) -> DataFrame:
    """Items' windows in documents: (id, text_hash, start, length, item), a row for each occurrence and item."""
    known = written(item_windows(items, item_key, item_text, window), "windows")
    lengths = sorted(x[0] for x in known.select("length").distinct().collect())
    cut = blocks(docs, key, text, window)
    if not lengths:
        return cut.select("id", "text_hash", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("item")).where(F.lit(False))
    every, prints = runs(cut, lengths), known.select("print").distinct()
    if fits(prints, F.lit(8)):
        met = every.join(F.broadcast(prints), "print")
    else:  # the words would be shuffled with each row: they are joined to the hits alone
        hit = written(every.drop("words").join(prints, "print"), "hits").withColumnsRenamed({"id": "id_", "text_hash": "hash_", "block": "block_"})
        at = hit.select("id_", "hash_", "block_").distinct()
        same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")) & (F.col("block") == F.col("block_"))
        once = cut.join(at, same, "left_semi").dropDuplicates(["id", "text_hash", "block"])  # equal rows have equal hits
        met = hit.join(once, same)
    window_at = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct((F.col("start") + i).alias("s"), F.array_join(F.slice("words", F.col("start") + i + 1, F.col("length")), " ").alias("window")))
    found = met.select("id", "text_hash", "block", "length", F.inline(window_at))
    found = found.select("id", "text_hash", (F.col("block") * BLOCK + F.col("s")).alias("start"), "length", "window")
    return found.join(_fitting(known.select("length", "window", "item"), F.octet_length("window") + F.octet_length("item")), ["length", "window"]).select("id", "text_hash", "start", "length", "item")


def _per_document(found: DataFrame) -> DataFrame:
    """(at, of, n_hit, items) for each document with a window, by its id and text hash; equal rows are one."""
    covered = F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("length") - 1))))
    return found.groupBy(F.col("id").alias("at"), F.col("text_hash").alias("of")).agg(F.size(covered).cast("long").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, min_items: int = 2
) -> DataFrame:
    """How much of each document is benchmark text.

    Returns one row for each input row: key, n_words, n_hit (words inside any
    window), n_items (items with a window in the document), items_sha256 (their
    ids as text, sorted and joined by commas) and contaminated (``min_items``
    items at least).  Null and empty texts have no words and no hits; repeated
    rows, or rows with a null key, each have their row.  Repeated items count
    once, items without id or words never.  Other columns are not read; empty
    tables on either side give no hits.
    """
    found = matches(docs, items, key, text, item_key, item_text, window)
    every = docs.select(F.col(quote(key)).alias("id"), F.xxhash64(quote(text)).alias("text_hash"), F.size(words(F.col(quote(text)))).cast("long").alias("n_words"))
    per = _per_document(found)
    joined = every.join(per, F.col("id").eqNullSafe(F.col("at")) & (F.col("text_hash") == F.col("of")), "left")
    n_items = F.coalesce(F.size("items"), F.lit(0)).cast("long")
    n_items = F.when(F.col("items").isNull(), F.lit(0).cast("long")).otherwise(n_items)
    return joined.select(
        F.col("id").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_items >= min_items).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, min_items: int = 1
) -> DataFrame:
    """The rows of ``docs`` without those whose text holds windows of ``min_items`` items, with all columns.

    Rows are told apart by key and text: a row goes for its own text only.
    """
    found = _per_document(matches(docs, items, key, text, item_key, item_text, window)).where(F.size("items") >= min_items)
    gone = written(found.select(F.col("at").alias("gone_id"), F.col("of").alias("gone_hash")), "gone")
    row = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.col(quote(key)).alias("id"), F.xxhash64(quote(text)).alias("text_hash"))
    size = F.octet_length(F.coalesce(F.col("gone_id").cast("string"), F.lit(""))) + 8
    left = row.join(_fitting(gone, size), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left_anti")
    return left.select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(8, len(w)) AS n, array_to_string(w[s : s + least(8, len(w)) - 1], ' ') AS t
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(8, len(w)) + 1)) AS s FROM b WHERE len(w) > 0 AND item IS NOT NULL)
), dw AS (
  SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT dw.r, dw.s, dw.n, bw.item FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT r, s, n FROM hit)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
