"""A manifest of a dataset as Merkle trees: one a source, and one over their roots; a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

#: Children of a node; levels of a block, which a task climbs at once; levels of a stacked subtree in it.
ARITY, BLOCK_LEVELS, SUBTREE_LEVELS = 3, 6, 2
BLOCK = ARITY**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "grp string, idx long, digest string"
STEP = "struct<before: string, after: string>"


def leaf_digest(fields: list[Column]) -> Column:
    """Lowercase hex sha256 of the fields one after another: `-` for null, else the count of UTF-8 bytes, `:` and the value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in text]), 256)


def fold(path: Column, digest: Column) -> Column:
    """The root to which a node's digest leads by the siblings (before, after) of each level."""
    return F.aggregate(path, digest, lambda d, x: F.sha2(F.concat(x.before, d, x.after), 256))


def _hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


Leaf = Callable[[int], str]


def _grow(leaf: Leaf, first: int, last: int, low: int, high: int) -> Iterator[list[list[str]] | None]:
    """Builds the nodes of levels low to high above the leaves first to last, a leaf a step: None after each step but the last, then the nodes of each level,
    the one of level high (the subtree's root) too. Below `low` a stack of open runs is all that is kept."""
    open_runs: list[list[str]] = [[] for _ in range(low)]
    kept: list[list[str]] = [[] for _ in range(high - low + 1)]

    def put(level: int, digest: str, at_end: bool) -> None:
        while level < low:
            open_runs[level].append(digest)
            if len(open_runs[level]) < ARITY and not at_end:
                return
            digest, open_runs[level] = _hash(open_runs[level]), []
            level += 1
        kept[level - low].append(digest)

    for i in range(first, last):
        put(0, leaf(i), False)
        if i < last - 1:
            yield None
    for level in range(low):  # runs that the end of the leaves leaves short
        if open_runs[level]:
            run, open_runs[level] = open_runs[level], []
            put(level + 1, _hash(run), False)
    for a, b in zip(kept, kept[1:], strict=False):
        b += [_hash(a[i : i + ARITY]) for i in range(0, len(a), ARITY)]
    yield kept


def block_root(digests: list[str], levels: int) -> str:
    """The node `levels` above a block's leaves."""
    *_, kept = _grow(digests.__getitem__, 0, len(digests), levels, levels)
    return kept[0][0]


def authentication_paths(digests: list[str], levels: int, step: int = SUBTREE_LEVELS) -> Iterator[list[tuple[str, str]]]:
    """The path of each leaf of a block in order: for each level the digests before and after its own in its run.

    Fractal traversal: the levels are cut into layers of `step`. A layer keeps the nodes of the existing subtree, below which the leaf stands, and builds
    those of the desired one, its right neighbour, a leaf a step; it is done when the traversal reaches it. So beside the leaves
    (a block has BLOCK at most) two subtrees a layer are held, and each leaf costs a step in each layer.
    """
    n, lows = len(digests), list(range(0, levels, step))
    highs = [min(low + step, levels) for low in lows]
    spans = [ARITY**high for high in highs]
    grown = lambda k, j: _grow(digests.__getitem__, j * spans[k], min((j + 1) * spans[k], n), lows[k], highs[k])
    existing = [list(grown(k, 0))[-1] for k in range(len(lows))]
    desired = [grown(k, 1) if spans[k] < n else iter(()) for k in range(len(lows))]
    ready: list[list[list[str]] | None] = [None] * len(lows)
    for i in range(n):
        path = []
        for k, low in enumerate(lows):
            base = i // spans[k]
            for level in range(low, highs[k]):
                at = i // ARITY**level - base * ARITY ** (highs[k] - level)
                row, start = existing[k][level - low], at - at % ARITY
                path.append(("".join(row[start:at]), "".join(row[at + 1 : start + ARITY])))
        yield path
        for k, span in enumerate(spans):
            ready[k] = next(desired[k], ready[k])
            if (i + 1) % span == 0 and i + 1 < n:
                existing[k], ready[k] = ready[k], None
                after = (i + 1) // span + 1
                desired[k] = grown(k, after) if after * span < n else iter(())


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """idx, each row's place from 0 in its grp by `order`, and n, how many rows the grp has. Rows are dealt to ranges of (grp, order), so that a large
    grp fills many tasks; a place is the count of the ranges before plus the place inside. Equal rows are spread by their first place."""
    ranged = rows.withColumn("_t", F.monotonically_increasing_id())
    keys = ["grp", *order, "_t"]
    ranged = durable(ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()).drop("_t").withColumn("_m", F.monotonically_increasing_id()))
    parts = ranged.groupBy("grp", "_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_m0"))
    by = Window.partitionBy("grp").orderBy("_p")
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("grp", "_p", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_m0")).alias("_shift"), F.sum("_c").over(whole).alias("n"))
    # a row's number in its partition runs on over the grps of the partition, and each is one stretch of it
    return ranged.join(parts, ["grp", "_p"]).withColumn("idx", F.col("_m") + F.col("_shift")).drop("_p", "_m", "_shift")


def _in_blocks(nodes: DataFrame) -> DataFrame:
    """Rows (grp, idx, n, digest, ...) with their block, whole blocks in a partition, in order; levels: how far a block is climbed."""
    levels = sum((F.col("n") > ARITY**k).cast("int") for k in range(BLOCK_LEVELS))
    out = nodes.withColumn("block", F.expr(f"idx div {BLOCK}")).withColumn("levels", levels)
    return out.repartition("grp", "block").sortWithinPartitions("grp", "block", "idx")


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One table a block, of rows that come sorted by (grp, block)."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        names = batch.schema.names
        g, b = batch.column(names.index("grp")).to_pylist(), batch.column(names.index("block")).to_pylist()
        cuts = [0, *[i for i in range(1, len(g)) if (g[i], b[i]) != (g[i - 1], b[i - 1])], len(g)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if held and (g[i], b[i]) != key:
                yield pa.Table.from_batches(held)
                held = []
            key = (g[i], b[i])
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _block_roots(blocks: DataFrame) -> DataFrame:
    """grp, idx (the block), n (the grp's blocks), digest of each block's root."""
    schema = pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _each_block(batches):
            n = -(-t.column("n")[0].as_py() // BLOCK)
            root = block_root(t.column("digest").to_pylist(), t.column("levels")[0].as_py())
            yield pa.RecordBatch.from_pylist([{"grp": t.column("grp")[0].as_py(), "idx": t.column("block")[0].as_py(), "n": n, "digest": root}], schema=schema)

    return blocks.select("grp", "block", "n", "levels", "digest").mapInArrow(run, f"{NODES.replace('idx long,', 'idx long, n long,')}")


def _block_paths(blocks: DataFrame, keep: str) -> DataFrame:
    """grp, block, the kept columns (a DDL list), and path, that of each row inside its block."""
    names = [x.split()[0] for x in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = pa.struct([("before", pa.string()), ("after", pa.string())])
        for t in _each_block(batches):
            paths = authentication_paths(t.column("digest").to_pylist(), t.column("levels")[0].as_py())
            path = pa.array([[{"before": a, "after": b} for a, b in p] for p in paths], pa.list_(step))
            yield from t.select(["grp", "block", *names]).append_column("path", path).combine_chunks().to_batches()

    return blocks.select("grp", "block", "levels", *dict.fromkeys(["digest", *names])).mapInArrow(run, f"grp string, block long, {keep}, path array<{STEP}>")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Of nodes (grp, idx, n, digest, other columns): the blocks of each round, and grp, root. A round climbs BLOCK_LEVELS levels in tasks of whole blocks;
    their roots are the nodes of the next one, a BLOCK-th of them, until each grp has one block."""
    rounds = []
    while True:
        rounds.append(durable(_in_blocks(nodes)))
        nodes = durable(_block_roots(rounds[-1]))
        if not nodes.where("n > 1").take(1):
            # a grp that was done in an earlier round climbs no further: one node stays one node
            return rounds, nodes.select("grp", F.col("digest").alias("root"))


def _descend(rounds: list[DataFrame], keep: str, top: DataFrame) -> DataFrame:
    """grp, the kept columns and the whole path of each node, and what top(grp, path, other columns) has for its grp. Paths are put together from the top:
    each row takes on the path of its block's root, by a join in which a key has BLOCK rows at most."""
    above = top.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(rounds) - 1, -1, -1):
        own = _block_paths(rounds[k], keep if k == 0 else "idx long")
        own = own.join(above.withColumnRenamed("path", "_above"), ["grp", "block"]).withColumn("path", F.concat("path", "_above")).drop("_above", "block")
        above = durable(own.withColumnRenamed("idx", "block")) if k else own
    return above


def manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row a row: doc_id, source, leaf, path, subroot, root, and what `keep` names.

    leaf is the digest of the fields. The leaves of a source, in the order of ids, are a tree with ARITY children a node: consecutive digests are hashed together, level by
    level, until one is left, the subroot; a short last run is hashed too. The subroots in the order of sources make a tree in the same way, up to the root.
    path holds for each level from the leaf to the root the siblings before and after (digests one after another, "" for none), so that
    fold(path, leaf) is the root.

    Texts are read once, for their digests; after that only ids, sources and digests move. Leaves are numbered by ranges and climbed in blocks of BLOCK, so
    no task holds a source; rounds follow the logarithm of the rows. Paths aren't stored: each row's is made from its block, and those of the blocks are joined.

    Null id: before all others. Null source: a source of its own, before all others; "" is another. Null field: `-`. Repeated or tied ids: in the order of their leaves, equal ones interchangeable.
    Empty input: no row. Columns that aren't named are ignored.
    """
    keep = keep or {}
    grp = F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    leaves = df.select(F.col(id_col).cast("long").alias("doc_id"), grp.alias("grp"), leaf_digest([F.col(c) for c in fields]).alias("digest"), *[c.alias(k) for k, c in keep.items()])
    columns = ", ".join(["doc_id long", "digest string", *[f"{k} {t}" for k, t in leaves.dtypes if k in keep]])
    rounds, subroots = _climb(_numbered(durable(leaves), ["doc_id", "digest"]))
    sources = durable(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), F.col("root").alias("digest")))
    over, root = _climb(_numbered(sources, ["source"]))
    end = root.withColumn("path", F.array().cast(f"array<{STEP}>"))
    top = _descend(over, "source string, digest string", end).select(F.col("source").alias("grp"), F.col("digest").alias("subroot"), "path", "root")
    out = _descend(rounds, columns, durable(top))
    source = F.when(F.col("grp") == "", F.lit(None).cast("string")).otherwise(F.substring("grp", 2, 1 << 30))
    return out.select("doc_id", source.alias("source"), F.col("digest").alias("leaf"), "path", "subroot", "root", *keep)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """manifest() over all documents, and what each proof says of its row, after the texts of every other id, by checksum, have lost their line ends."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = manifest(table(spark, sf_dir, "documents"), keep={"now": leaf_digest([text if c == "text" else F.col(c) for c in FIELDS])})
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x.before, x.after)), ""), 256)
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.col("path"), F.col("now")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels of a tree are rows of a recursive table; the CRC of an id's digits is taken bit by bit.
OP11_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))) % 2 = 1 AS even FROM documents),
e AS (SELECT *, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS text2, concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
  CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head FROM d),
f AS MATERIALIZED (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf, sha256(head || CASE WHEN text2 IS NULL THEN '-' ELSE strlen(text2) || ':' || text2 END) AS now FROM e),
g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM f),
t AS (SELECT source, 0 AS l, i, leaf AS h, max(i) OVER (PARTITION BY source) + 1 AS n FROM g
  UNION ALL SELECT source, l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM t WHERE n > 1 GROUP BY source, l, i // 3),
tm AS MATERIALIZED (SELECT * FROM t),
s AS MATERIALIZED (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM tm WHERE n = 1),
u AS (SELECT 0 AS l, i, h, (SELECT count(*) FROM s) AS n FROM s UNION ALL SELECT l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM u WHERE n > 1 GROUP BY l, i // 3),
um AS MATERIALIZED (SELECT * FROM u),
ts AS MATERIALIZED (SELECT a.source, a.l, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS pre, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS post FROM tm a JOIN tm b ON a.source IS NOT DISTINCT FROM b.source AND a.l = b.l AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
us AS MATERIALIZED (SELECT a.l, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS pre, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS post FROM um a JOIN um b ON a.l = b.l AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
p AS (SELECT g.doc_id, g.leaf, g.now, g.source, g.i, ts.l, ts.pre, ts.post FROM g JOIN ts ON g.source IS NOT DISTINCT FROM ts.source AND ts.i = g.i // CAST(pow(3, ts.l) AS BIGINT)
  UNION ALL SELECT g.doc_id, g.leaf, g.now, g.source, g.i, 1000 + us.l, us.pre, us.post FROM g JOIN s ON g.source IS NOT DISTINCT FROM s.source JOIN us ON us.i = s.i // CAST(pow(3, us.l) AS BIGINT)
  UNION ALL SELECT doc_id, leaf, now, source, i, -1, '', '' FROM g),
q AS (SELECT source, i, any_value(doc_id) AS doc_id, any_value(leaf) AS leaf, any_value(now) AS now, string_agg(pre || post, '' ORDER BY l) AS proof, list({'pre': pre, 'post': post} ORDER BY l) FILTER (l >= 0) AS path FROM p GROUP BY source, i),
r AS (SELECT *, CASE WHEN path IS NULL THEN now ELSE list_reduce(list_prepend({'pre': now, 'post': ''}, path), lambda x, y: {'pre': sha256(y.pre || x.pre || y.post), 'post': ''}).pre END AS folded_root FROM q)
SELECT r.doc_id, r.leaf, s.h AS subroot, (SELECT h FROM um WHERE n = 1) AS root, sha256(r.proof) AS proof_sha256, r.folded_root, r.folded_root = (SELECT h FROM um WHERE n = 1) AS verified FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source"""
