"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A signature of CHUNKS * WIDTH b-bit minima is split into chunks; two signatures that differ in at most
GUARANTEED = 2 * CHUNKS - 1 places have, by pigeonhole, a chunk with one difference at most. So each chunk enumerates its
allowed errors, one key for each place left out, and such pairs share a key for certain. No threshold in use is above
that distance, so the index finds every pair that the threshold accepts.

1. Documents with one shingle set are one class, a node of the graph, whatever their number.
2. Keys that two or more classes share are groups; of keys with the same members one is kept. Inside a
   group, signatures are compared in blocks, and the pairs near enough join classes to families. A block
   gives fewer links than it has members, never its pairs, and follows a large component in waves without comparing all of them.
3. Families meet with their whole texts, in blocks of the same kind; shared shingles are counted exactly
   by a product of incidence matrices, and pairs that reach the similarity are links.
4. Components of the links, then of all documents of a class.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, partitions, table
from .components import components
from .hashing import mix, rolling, words

U = np.uint64
CHUNKS, WIDTH, BITS = 16, 4, 16
VALUES = CHUNKS * WIDTH
GUARANTEED = 2 * CHUNKS - 1
_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * U(2) + U(1)
#: Members compared with each other at once; those of them that go to every block of a larger group; tasks for such a group.
BLOCK, PIVOTS, SALT = 1024, 64, 16
#: Keys that are joined by broadcast at most, and the least rows of such a key.
HOT = 1024


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z lower-cased; fewer words are one shingle; without words, none."""
    h = words(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8), lower=True)[2]
    if len(h) >= k:
        return np.unique(rolling(h, k))
    return mix(rolling(h, len(h)) ^ U(len(h))) if len(h) else h


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of VALUES minima, BITS bits each, of every non-empty set."""
    sizes = np.array([len(s) for s in sets])
    at, whole = np.cumsum(sizes) - sizes, np.concatenate(sets)
    out = np.empty((len(sets), VALUES), np.uint16)
    for j in range(VALUES):
        least = np.minimum.reduceat((whole ^ _XOR[j]) * _ODD[j], at)
        out[:, j] = (mix(least) >> U(64 - BITS)).astype(np.uint16)
    return out


def keys(sig: np.ndarray) -> np.ndarray:
    """For each signature and chunk, a key for each place that may differ."""
    chunks = sig.reshape(len(sig), CHUNKS, WIDTH).astype(U)
    out = np.empty((len(sig), CHUNKS, WIDTH), U)
    for leave in range(WIDTH):
        h = np.broadcast_to((np.arange(CHUNKS) * WIDTH + leave + 1).astype(U), (len(sig), CHUNKS))
        for j in range(WIDTH):
            if j != leave:
                h = mix(h * U(0x100000001B3) ^ chunks[:, :, j])
        out[:, :, leave] = h
    return out.reshape(len(sig), -1).astype(np.int64)


def signature_distance(similarity: float, missed: float = 1e-6) -> int:
    """The signature-distance threshold: more places than that differ in a share of under `missed` of pairs of this similarity
    (25 of 64 at 0.85, 30 at 0.8). A similarity whose threshold the chunks don't guarantee is refused."""
    most, tail = VALUES, (1 - similarity) ** VALUES
    while tail < missed and most:
        most -= 1
        tail += math.comb(VALUES, most) * (1 - similarity) ** most * similarity ** (VALUES - most)
    if most > GUARANTEED:
        raise ValueError(f"similarity {similarity} needs a signature distance of {most}; the chunks guarantee {GUARANTEED}")
    return most


def _features(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = [shingle_set(t, k) for t in part.column(2).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = signatures([sets[i] for i in full]) if full else None
            digest, rows = [None] * len(sets), [None] * len(sets)
            for j, i in enumerate(full):
                digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                rows[i] = sig[j].tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(rows, pa.binary())], names=["doc_id", "check", "n_shingles", "set", "sig"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            k = keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, VALUES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, k.size + 1, k.shape[1], dtype=np.int32), pa.array(k.ravel()))], names=["node", "keys"])


def _forest(n: int, pairs: np.ndarray) -> list[int]:
    """Places of the pairs that join two parts of n members not yet joined."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, (a, b) in enumerate(pairs.tolist()):
        if (x := root(a)) != (y := root(b)):
            parent[x] = y
            out.append(i)
    return out


def _met(rows: DataFrame, n: int, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Links a, b that run finds among the rows (grp, node, i, j, label, load) of each block (grp, i, j)."""
    rows = rows.select("grp", "node", "i", "j", "label", "load")
    return rows.repartition(n, "grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(run, "a long, b long")


def _connected(members: DataFrame, load: Callable[[DataFrame], DataFrame], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """node, root of what the links inside groups (grp, node, size) connect; load adds what nodes are compared by.

    1. A group is cut into blocks of BLOCK members by a hash, and about PIVOTS of its members go to every block, so that blocks have
       links in common. Rows are as many as members and one in BLOCK / PIVOTS more.
    2. Where that leaves a group of several blocks in several components, every member outside its largest one meets all others
       of the group, again in blocks. No link is lost, and members of the largest component aren't compared with each other again.
    """
    n, long = partitions(members.sparkSession), lambda c: c.cast("long")
    members = durable(members.select("grp", "node", "size"))
    blocks = F.ceil(F.col("size") / F.lit(BLOCK))
    spread = F.when((F.col("size") > BLOCK) & (F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("size")) < PIVOTS), F.sequence(F.lit(0).cast("long"), long(blocks) - 1))
    rows = members.withColumn("i", F.explode(F.coalesce(spread, F.array(F.pmod(F.xxhash64("node"), long(blocks))))))
    roots = durable(components(_met(load(rows.withColumns({"j": F.lit(0).cast("long"), "label": F.lit(None).cast("long")})), n, run)))

    named = durable(members.where(F.col("size") > BLOCK).join(roots, "node", "left").select("grp", "node", F.coalesce("root", "node").alias("label")))
    parts = named.groupBy("grp", "label").agg(F.count("*").alias("c")).groupBy("grp").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("c"))
    apart = durable(parts.where("c > main.c").selectExpr("grp", "main.label AS main", f"CAST(ceil(c / {BLOCK}) AS long) AS n_i", f"CAST(ceil((c - main.c) / {BLOCK}) AS long) AS n_j"))
    if not apart.take(1):
        return roots
    # a group may be large, so it is dealt to SALT tasks here
    salted = apart.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rest = named.withColumn("_s", F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(SALT)).cast("int")).join(salted, ["grp", "_s"])
    h, every = F.xxhash64("node"), lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    others = rest.where("label <> main").withColumn("j", F.pmod(h, F.col("n_j"))).withColumn("i", every("n_i"))
    all_ = rest.withColumn("i", F.pmod(h, F.col("n_i"))).withColumn("j", every("n_j")).where((F.col("label") == F.col("main")) | (F.col("j") != F.pmod(h, F.col("n_j"))))
    more = _met(load(others.select("grp", "node", "i", "j", "label").union(all_.select("grp", "node", "i", "j", "label"))), n, run)
    return components(more.union(roots.select("node", "root")))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """Ids, labels and payloads of each group of rows (grp, node, i, j, label, load) that are sorted by group and block."""
    key, ids, labels, load = None, [], [], []
    for batch in batches:
        for g, d, i, j, label, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (g, i, j) != key:
                if ids:
                    yield ids, labels, load
                key, ids, labels, load = (g, i, j), [], [], []
            ids.append(d)
            labels.append(label)
            load.append(x)
    if ids:
        yield ids, labels, load


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Members of a block from which a component is followed to its end, before the rest is compared in all pairs.
LEADERS = 8


def _spanning(n: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Pairs of n members that join all that are near over any steps. near gives the matrix of hits of two lists of members.

    A component is followed from a member in waves, each compared only with what no wave has reached; so a large
    component costs its members and not their pairs. What isn't in the components of the first LEADERS meets in all its pairs.
    """
    out, left = [np.zeros((0, 2), np.int64)], np.arange(n)
    for _ in range(LEADERS):
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            hit = near(wave, left)
            reached = hit.any(axis=0)
            out.append(np.stack([wave[hit.argmax(axis=0)[reached]], left[reached]], axis=1))
            wave, left = left[reached], left[~reached]
    if len(left) > 1:
        pairs = left[np.argwhere(np.triu(near(left, left), 1))]
        out.append(pairs[_forest(n, pairs)])
    return np.concatenate(out)


def _linked(ids: list, labels: list, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """Links of a block; nodes of one label are joined already."""
    pairs, of = _spanning(len(ids), near), np.array(ids, np.int64)
    if labels[0] is not None:
        label = np.array(labels, np.int64)
        pairs = pairs[label[pairs[:, 0]] != label[pairs[:, 1]]]
    return pa.RecordBatch.from_arrays([pa.array(of[pairs[:, 0]]), pa.array(of[pairs[:, 1]])], schema=_PAIR)


def _near(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links between signatures of a group that differ in `most` places or fewer."""
    for ids, labels, load in _groups(batches):
        s = np.frombuffer(b"".join(load), np.uint16).reshape(len(ids), -1)

        def near(x: np.ndarray, y: np.ndarray, s: np.ndarray = s) -> np.ndarray:
            if len(x) * len(y) <= 4096:
                return (s[x][:, None, :] != s[y][None, :, :]).sum(axis=2) <= most
            away, differ = np.zeros((len(x), len(y)), np.uint8), np.empty((len(x), len(y)), bool)
            for a, b in zip(s[x].T.copy(), s[y].T.copy(), strict=True):
                np.not_equal(a[:, None], b[None, :], out=differ)
                away += differ.view(np.uint8)
            return away <= most

        yield _linked(ids, labels, near)


def _similar(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between the texts of a family with 100 * intersection >= percent * union."""
    for ids, labels, load in _groups(batches):
        if len(ids) < 2:
            continue
        sets = [shingle_set(t, k) for t in load]
        size = np.array([len(s) for s in sets])
        whole = np.concatenate(sets)
        row = np.repeat(np.arange(len(ids)), size)
        order = np.argsort(whole, kind="stable")
        new = np.concatenate([[True], whole[order][1:] != whole[order][:-1]])
        column = np.cumsum(new) - 1
        shared = np.bincount(column) > 1  # a shingle of one document alone is in no intersection
        place = np.cumsum(shared) - 1
        mine = shared[column]
        yield _linked(ids, labels, _meeting(row[order][mine], place[column[mine]], int(shared.sum()), size, percent))


def _meeting(row: np.ndarray, column: np.ndarray, columns: int, size: np.ndarray, percent: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The test of two lists of documents, whose shingles are rows and (ascending) columns of an incidence matrix."""

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        both, at = np.zeros((len(x), len(y)), np.float32), np.full((2, len(size)), -1)
        at[0, x], at[1, y] = np.arange(len(x)), np.arange(len(y))
        for a in range(0, columns, 4096):
            part = slice(*np.searchsorted(column, [a, a + 4096]))
            r, c = row[part], column[part] - a
            if len(x) == 1:  # only the columns that the one document has
                has = np.zeros(4096, bool)
                has[c[r == x[0]]] = True
                both[0] += np.bincount(r[has[c]], minlength=len(size))[y]
                continue
            m = [np.zeros((len(z), min(4096, columns - a)), np.float32) for z in (x, y)]
            for i in range(2):
                here = at[i, r] >= 0
                m[i][at[i, r[here]], c[here]] = 1
            both += m[0] @ m[1].T
        both = both.astype(np.int64)
        return 100 * both >= percent * (size[x][:, None] + size[y][None, :] - both)

    return near


def _with(rows: DataFrame, small: DataFrame, key: str, count: str) -> DataFrame:
    """Rows with the row of small that has their key. count: how many rows have it. Keys that have a HOT-th of all rows, or more, are HOT at
    most; they are broadcast and their rows stay where they are, so no key fills a task."""
    limit = max(HOT, (small.agg(F.sum(count)).first()[0] or 0) // HOT)
    hot, rest = small.where(F.col(count) >= limit), small.where(F.col(count) < limit)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def _checked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, check, text: rows of one id are told apart by a checksum of their text."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("check"), F.col(text_col).alias("text"))


def _components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, check, n_shingles, first: the least struct(doc_id, check) of the component; null where no set or id is."""
    n = partitions(docs.sparkSession)
    feats = durable(docs.mapInArrow(lambda b: _features(b, k), "doc_id long, check long, n_shingles long, set binary, sig binary"))
    classes = feats.where("doc_id IS NOT NULL AND set IS NOT NULL").groupBy("set", "sig").agg(F.min(F.struct("doc_id", "check")).alias("own"), F.count("*").alias("copies"))
    # written once, so the numbers of nodes stay
    nodes = durable(classes.select(F.monotonically_increasing_id().alias("node"), "own", "set", "sig", "copies"))
    keyed = nodes.select("node", "sig").mapInArrow(_keyed, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    h = F.xxhash64("node")
    shared = keyed.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 30)).alias("y")).where("size > 1")
    groups = shared.groupBy("size", "x", "y").agg(F.min("key").alias("key"))
    members = keyed.join(groups.select("key", "size"), "key").select(F.col("key").alias("grp"), "node", "size")
    most = signature_distance(percent / 100)
    families = _connected(members, lambda x: x.join(nodes.select("node", F.col("sig").alias("load")), "node"), lambda b: _near(b, most))
    families = durable(families.select("node", F.col("root").alias("grp")))
    sizes = families.groupBy("grp").agg(F.count("*").alias("size"))

    def texts(rows: DataFrame) -> DataFrame:
        """A row that is repeated counts once."""
        wanted = rows.select("node").distinct().join(nodes.select("node", "own.*"), "node")
        return rows.join(wanted.join(docs, ["doc_id", "check"]).dropDuplicates(["doc_id", "check"]).select("node", F.col("text").alias("load")), "node")

    roots = _connected(_with(families, durable(sizes), "grp", "size"), texts, lambda b: _similar(b, k, percent))
    roots = durable(roots.join(nodes.select("node", "own"), "node"))
    firsts = durable(roots.groupBy("root").agg(F.min("own").alias("first"), F.count("*").alias("n")))
    linked = _with(roots, firsts, "root", "n").select("node", "first")
    known = durable(nodes.join(linked, "node", "left").select("set", "copies", F.coalesce("first", "own").alias("first")))
    feats, named = feats.drop("sig"), F.col("doc_id").isNotNull() & F.col("set").isNotNull()
    out = _with(feats.where(named), known, "set", "copies").select("doc_id", "check", "n_shingles", "first")
    return out.unionByName(feats.where(~named).select("doc_id", "check", "n_shingles"), allowMissingColumns=True)


def near_duplicates(df: DataFrame, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of k-word shingles. Documents
    without words or text have an empty set and are linked with nothing. Null id: in no component (null), kept.
    Repeated rows: each returned. Rows of one id with different texts are nodes of their own, linked by their texts alone.
    Empty input: no row. Columns that aren't named are ignored. Checkpoints hold ids, checksums, counts and signatures, never texts.
    """
    out = _components(_checked(df, id_col, text_col), k, percent)
    component = F.coalesce("first.doc_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() over all documents: three words, 85 percent."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, of which one of each component stays: that of the least id and, among rows of that id, of the
    least checksum of the text. A row that is repeated stays once; rows without words are told apart by id and text. Null ids: all stay. Empty input: no row.
    """
    names = docs.columns
    fate = _components(_checked(docs, id_col, text_col), k, percent).where("doc_id IS NOT NULL")
    own = F.struct("doc_id", "check")
    fate = durable(fate.groupBy("doc_id", "check").agg(F.first(F.coalesce("first", own) == own).alias("stays"), F.count("*").alias("rows")).where("NOT stays OR rows > 1"))
    row = docs.withColumns({"_dedup_id": F.col(id_col).cast("long"), "_dedup_check": F.xxhash64(text_col)})
    match = lambda f: (F.col("_dedup_id") == f.doc_id) & (F.col("_dedup_check") == f.check)
    once = row.join(fate, match(fate), "left_anti")
    twice = fate.where("stays")
    if not twice.take(1):
        return once.select(*names)
    return once.select(*names).union(row.join(twice, match(twice), "left_semi").dropDuplicates(["_dedup_id", "_dedup_check"]).select(*names))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
