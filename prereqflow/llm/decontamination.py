"""Benchmark decontamination by SimHash of item-sized windows (native DataFrame functions only).

1. Windows: as many shingles as an item has (all of a shorter document). Only those are taken that begin at a shingle of some item of
   that size and hold enough shingles of such items for one of them to be similar; which item it is stays open.
2. SimHash: 64-bit fingerprints of these windows and of the items.
3. Multi-index Hamming blocks: 8 blocks of 8 bits, with up to two flipped bits a block enumerated on the items' side. Two
   fingerprints within 23 bits have, by pigeonhole, a block with two differences at most, so the lookup by size and block
   finds every item within the radius of a window.
4. Exact weighted-shingle similarity, sum of least over sum of greatest counts, verifies the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, durable, table

K, PERCENT = 5, 80
BLOCKS, WIDTH, ERRORS = 8, 8, 2
#: What the blocks guarantee. A window at the bound of similarity is about 10 bits away from its item, give or take 3.
RADIUS = BLOCKS * (ERRORS + 1) - 1
#: Rows of a side, or hashes in them, that may be broadcast (a few MB); larger sides are shuffled.
BROADCAST_ROWS = 250_000
#: Tasks that the rows of one shingle are dealt to where that side is shuffled.
SALT = 16
#: Bits, 64 in a row, that say which ids may be asked for, where these are too many to be broadcast. A text whose bit isn't set stays where it is.
MARKS = 1 << 24


def _words(text: str) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE_CLASS, " ")), " ")


def _shingle(words: str, i: Column, k: int) -> Column:
    return F.xxhash64(F.slice(words, i, k))


def positions(df: DataFrame, text: str, k: int) -> DataFrame:
    """A row for each k-word shingle: the other columns, _m shingles in all, _p its place from 0, _x its hash."""
    rest = [c for c in df.columns if c != text]
    m = F.size("_w") - (k - 1)
    each = df.select(*rest, _words(text).alias("_w")).select("*", F.explode(F.sequence(F.lit(1), F.greatest(m, F.lit(1)))).alias("_i"))
    return each.select(*rest, m.alias("_m"), (F.col("_i") - 1).alias("_p"), _shingle("_w", F.col("_i"), k).alias("_x")).where("_p < _m")


def _fingerprint(column: str) -> Column:
    """SimHash: bit b is set if more of the shingles' hashes have it than not."""
    votes = f"aggregate({column}, 0, (a, x) -> a + CAST(shiftrightunsigned(x, b) & 1L AS INT) * 2 - 1)"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> IF({votes} > 0, f | shiftleft(1L, b), f))")


def _weighted(a: str, b: str) -> Column:
    """Sum over shared shingles of the lesser count."""
    return F.expr(f"aggregate(array_intersect({a}, {b}), 0, (n, x) -> n + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))")


def _joined(rows: DataFrame, small: DataFrame, on: list[str], n: int, spread: list[str] | None = None) -> DataFrame:
    """spread: columns that tell apart the rows of one key, so that a hot one is dealt to SALT tasks."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), on)
    if not spread:
        return rows.join(small, on)
    rows, small = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALT)).cast("int")), small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.join(small, [*on, "_salt"]).drop("_salt")


def _marked(rows: DataFrame, ids: DataFrame, key: str, kind: str = "inner") -> DataFrame:
    """Rows with _bits, not 0 for each whose key is a doc_id of ids and for few others; kind: inner leaves out most others, left has 0 or null for them."""
    h = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS).cast("long"))
    word, bit = lambda c: F.shiftright(h(c), 6), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), h(c).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    marks = ids.groupBy(word("doc_id").alias("_mark")).agg(F.bit_or(bit("doc_id")).alias("_bits"))
    return rows.join(F.broadcast(marks), word(F.col(key)) == F.col("_mark"), kind).withColumn("_bits", F.col("_bits").bitwiseAND(bit(F.col(key)))).drop("_mark")


def _asked(docs: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """Rows of docs with the rows of asked that have their doc_id. Of many, only texts that may be asked for are shuffled, not the corpus."""
    if n <= BROADCAST_ROWS:
        return docs.join(F.broadcast(asked), "doc_id")
    return _marked(docs, asked, "doc_id").where("_bits <> 0").drop("_bits").join(asked, "doc_id")


def contaminated(docs: DataFrame, items: DataFrame, k: int = K, percent: int = PERCENT, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity: for every document and item the best window with as many shingles as the item (all of
    a shorter document) whose similarity reaches percent / 100.

    Null or empty texts, and those of fewer than k words, have no shingle and match nothing. Null ids of documents or items: left out.
    Repeated rows: as one; texts that share an id, of documents or of items: each is searched, and the best counts. Empty tables: no row. Columns that aren't named are ignored.
    """
    if radius > RADIUS:
        raise ValueError(f"the blocks guarantee a radius of {RADIUS}")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).where("doc_id IS NOT NULL")
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("_text")).where("item_id IS NOT NULL")
    # a number for each text of an item, written once
    items = durable(items.dropDuplicates(["item_id", "_text"]).withColumn("_item", F.monotonically_increasing_id()))
    items = positions(items, "_text", k).groupBy("item_id", "_item").agg(F.array_sort(F.collect_list("_x")).alias("_ih"))
    items = durable(items.select("item_id", "_item", "_ih", F.size("_ih").alias("_n")))
    n_items, n_known = items.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()

    known = items.select("_n", F.explode("_ih").alias("_x")).distinct()
    hits = _joined(positions(docs, "_text", k), known, ["_x"], n_known, ["doc_id", "_p"]).groupBy("doc_id", "_m", "_n").agg(F.array_sort(F.collect_set("_p")).alias("_p"))
    hits = hits.withColumn("_l", F.least("_n", "_m"))
    hits = hits.withColumn("_need", F.ceil(F.lit(percent) * (F.col("_n") + F.col("_l")) / F.lit(100 + percent)).cast("int")).where(F.size("_p") >= F.col("_need"))
    start = "least(p, _m - _l)"
    starts = F.expr(f"array_distinct(transform(filter(_p, (p, i) -> coalesce(get(_p, i + _need - 1) < {start} + _l, false)), p -> {start}))")
    windows = durable(hits.select("doc_id", "_m", "_n", "_l", F.explode(starts).alias("_s")))
    n_windows = windows.count()

    # whole texts again, but only those of documents with a window, each split once for all its windows
    asked = durable(windows.groupBy("doc_id", "_m").agg(F.collect_list(F.struct("_n", "_s", "_l")).alias("_each")))
    split = _asked(docs.select("doc_id", "_text"), asked, n_windows).select("doc_id", "_m", "_each", F.explode(F.array(_words("_text"))).alias("_w"))
    split = split.where(F.size("_w") - (k - 1) == F.col("_m")).select("doc_id", "_w", F.explode("_each").alias("_a")).select("doc_id", "_a.*", "_w")
    hashed = split.select("doc_id", "_n", F.transform(F.sequence(F.col("_s") + 1, F.col("_s") + F.col("_l")), lambda i: _shingle("_w", i, k)).alias("_wh"))
    # written out, or each of a fingerprint's 64 bits would be taken from the text anew
    prints = durable(hashed).withColumn("_wf", _fingerprint("_wh"))
    found = lookup(prints, items.select(F.col("_item").alias("item_id"), "_n", _fingerprint("_ih").alias("_if")), n_items, radius).withColumnRenamed("item_id", "_item")
    near = _joined(found, items.select("_item", "item_id", "_ih"), ["_item"], n_known).withColumn("_c", _weighted("_wh", "_ih"))
    total = F.size("_wh") + F.size("_ih") - F.col("_c")
    similar = near.where(100 * F.col("_c") >= percent * total).withColumn("similarity", F.col("_c") / total)
    return similar.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def lookup(prints: DataFrame, items: DataFrame, n_items: int, radius: int = RADIUS) -> DataFrame:
    """Rows of prints (_n, _wf and others) with the item_id of every item (item_id, _n, _if) of that size whose fingerprint is within the radius, once each."""
    block = lambda f: f"shiftrightunsigned({f}, _k * {WIDTH}) & {(1 << WIDTH) - 1}L"
    errors = [sum(1 << b for b in bits) for bits in _subsets(WIDTH, ERRORS)]
    each = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    index = items.withColumn("_k", each).withColumn("_v", F.explode(F.transform(F.array(*[F.lit(e).cast("long") for e in errors]), lambda e: F.expr(block("_if")).bitwiseXOR(e))))
    found = _joined(prints.withColumn("_k", each).withColumn("_v", F.expr(block("_wf"))), index, ["_n", "_k", "_v"], n_items * BLOCKS * len(errors))
    # a pair within the radius shares several blocks; it counts in the first of them
    first = F.expr(f"array_min(filter(sequence(0, {BLOCKS - 1}), q -> bit_count(shiftrightunsigned(_wf ^ _if, q * {WIDTH}) & {(1 << WIDTH) - 1}L) <= {ERRORS}))")
    return found.where((F.bit_count(F.col("_wf").bitwiseXOR(F.col("_if"))) <= radius) & (F.col("_k") == first)).drop("_k", "_v", "_if")


def _subsets(n: int, most: int) -> list[tuple[int, ...]]:
    from itertools import combinations

    return [c for size in range(most + 1) for c in combinations(range(n), size)]


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document; kept is false if it holds an item of the benchmark."""
    docs = table(spark, sf_dir, "documents")
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("_i"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    items = F.coalesce(F.col("_i"), F.array().cast("array<long>"))
    return out.select("doc_id", F.size(items).cast("long").alias("n_items"), F.array_join(items.cast("array<string>"), ",").alias("item_ids"), F.col("_i").isNull().alias("kept"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows, all columns, that hold no item. Null ids and texts stay; of rows that share an id all go if one holds an item. Empty tables: as they are."""
    names, found = docs.columns, durable(contaminated(docs, items).select(F.col("doc_id").alias("_found_id")).distinct())
    if found.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(found), F.col("doc_id") == F.col("_found_id"), "left_anti").select(*names)
    # of many ids, only rows that may have one are shuffled; an anti join would be moved below the marks
    marked = _marked(docs, found.withColumnRenamed("_found_id", "doc_id"), "doc_id", "left")
    rest = marked.where("_bits <> 0").join(found, F.col("doc_id") == F.col("_found_id"), "left").where("_found_id IS NULL")
    return marked.where("coalesce(_bits, 0L) = 0").select(*names).unionByName(rest.select(*names))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS w FROM documents),
b AS (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS w FROM benchmark),
s AS MATERIALIZED (SELECT doc_id, len(w) - 4 AS m, i, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
q AS MATERIALIZED (SELECT item_id, n, x, count(*) AS c FROM (SELECT item_id, len(w) - 4 AS n, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)) GROUP BY 1, 2, 3),
h AS MATERIALIZED (SELECT doc_id, item_id, m, n, least(m, n) AS l, i, x, c FROM s JOIN q USING (x)),
v AS (SELECT DISTINCT doc_id, item_id, n, l, least(i, m - l + 1) AS a FROM h),
k AS (SELECT v.doc_id, v.item_id, v.n, v.l, v.a, h.x, least(count(*), any_value(h.c)) AS c
  FROM v JOIN h ON v.doc_id = h.doc_id AND v.item_id = h.item_id AND h.i >= v.a AND h.i < v.a + v.l GROUP BY 1, 2, 3, 4, 5, 6),
f AS (SELECT doc_id, item_id FROM (SELECT doc_id, item_id, a, n, l, sum(c) AS c FROM k GROUP BY 1, 2, 3, 4, 5) WHERE 100 * c >= 80 * (n + l - c) GROUP BY 1, 2),
g AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS ids FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(g.n, 0) AS n_items, coalesce(g.ids, '') AS item_ids, g.n IS NULL AS kept FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""
