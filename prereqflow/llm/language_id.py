"""Language ID by words first, then by ever shorter character n-grams of unseen words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

LETTERS = re.compile(r"[^\W\d_]+")
#: The same words by Spark: runs of letters.
NOT_LETTERS = r"[^\p{L}\p{Nl}\p{No}]+"
UND = "und"


def fit(df: DataFrame, per_language: int = 5000, most_languages: int = 200, longest: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Log frequencies of words and of character n-grams (1 to `longest`, with the word's ends marked) in each language.

    The fit reads a bounded sample: about `per_language` rows of each language, chosen by a hash of the id; so the sample bounds what
    reaches the driver and the executors, and every word and n-gram of it is kept. Rows without text or language don't
    count; an empty table gives a model without languages. More than `most_languages` values of lang raise ValueError.
    """
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(n) > most_languages:
        raise ValueError(f"more than {most_languages} languages in {lang_col}")
    langs = sorted(n)
    if not langs:
        return {"langs": [], "longest": longest, "words": {}, "grams": {}}
    draw = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / n[k]))])
    said = rows.where(draw < F.element_at(rate, F.col("lang"))).select("lang", F.explode(F.split(F.lower("text"), NOT_LETTERS)).alias("w")).where("w <> ''")
    counts = durable(said.groupBy("lang", "w").agg(F.count("*").alias("c")))
    marked = F.concat(F.lit("^"), "w", F.lit("$"))
    each = F.concat(*[_grams(marked, k) for k in range(1, longest + 1)])
    gram = counts.select("lang", "c", F.explode(each).alias("w")).groupBy("lang", "w").agg(F.sum("c").alias("c"))
    return {"langs": langs, "longest": longest, "words": _logs(counts, langs, 1), "grams": _logs(gram, langs, longest, True)}


def _logs(counts: DataFrame, langs: list[str], kinds: int, by_length: bool = False) -> dict[str, tuple[float, ...]]:
    """For each word or n-gram its log frequency in each language, of all words or of all n-grams of its length."""
    place, seen, total = {x: i for i, x in enumerate(langs)}, {}, np.zeros((kinds, len(langs)))
    rows = counts.select("lang", "w", "c").toArrow()
    for lang, w, c in zip(*(rows.column(x).to_pylist() for x in ("lang", "w", "c")), strict=True):
        total[len(w) - 1 if by_length else 0, place[lang]] += c
        seen.setdefault(w, {})[place[lang]] = c
    none = np.log(0.5) - np.log(total + 0.5)
    out = {}
    for w, by in seen.items():
        k = len(w) - 1 if by_length else 0
        out[w] = tuple(math.log((by[i] + 0.5) / (total[k, i] + 0.5)) if i in by else none[k, i] for i in range(len(langs)))
    return out


def _grams(word: Column, k: int) -> Column:
    at = F.sequence(F.lit(1), F.length(word) - k + 1)
    return F.when(F.length(word) >= k, F.transform(at, lambda i: F.substring(word, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def word_scores(word: str, model: dict) -> tuple[float, ...] | None:
    """A known word's log frequencies; else the mean of those of its longest known n-grams; None if not even a character is known."""
    if (known := model["words"].get(word)) is not None:
        return known
    marked = f"^{word}$"
    for k in range(min(model["longest"], len(marked)), 0, -1):
        rows = [g for i in range(len(marked) - k + 1) if marked[i : i + k] not in "^$" and (g := model["grams"].get(marked[i : i + k])) is not None]
        if rows:
            return tuple(sum(x) / len(rows) for x in zip(*rows, strict=True))
    return None


def predict(texts: list[str | None], model: dict, cache: dict) -> Iterator[tuple[str, float]]:
    """Language and posterior of each text; und and 0 without a letter or a learned language."""
    langs = model["langs"]
    for text in texts:
        words = Counter(LETTERS.findall(text.lower())) if text else {}
        if not words or not langs or not any(c.isalpha() for w in words for c in w):
            yield UND, 0.0
            continue
        total, n = np.zeros(len(langs)), 0
        rows, times = [], []
        for w, c in words.items():
            if (row := cache.get(w, 0)) == 0:
                if len(cache) > 200_000:
                    cache.clear()
                row = cache[w] = word_scores(w, model)
            if row is not None:
                rows.append(row)
                times.append(c)
        if rows:
            n = sum(times)
            total = np.array(times) @ np.array(rows)
        # neighbouring words depend on each other, so n words count as sqrt(n) independent ones
        odds = total / math.sqrt(max(1, n))
        p = np.exp(odds - odds.max())
        best = int(np.argmax(p))  # a tie goes to the first language by name
        yield langs[best], float(p[best] / p.sum())


class Table:
    """Words or n-grams and their log frequencies as two arrays, in the order of the words' 64-bit hashes: 8 bytes and 4 a language for each entry."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray):
        self.hashes, self.rows = hashes, rows

    @staticmethod
    def of(table_: dict[str, tuple[float, ...]], n: int) -> Table:
        hashes = np.fromiter(map(_hash, table_), np.uint64, len(table_))
        order = np.argsort(hashes)
        return Table(hashes[order], np.array(list(table_.values()), np.float32).reshape(len(table_), n)[order])

    def get(self, word: str) -> tuple[float, ...] | None:
        h = np.uint64(_hash(word))
        i = int(self.hashes.searchsorted(h))
        return tuple(self.rows[i].tolist()) if i < len(self.hashes) and self.hashes[i] == h else None


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def identify(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), named: tuple[str, str] = ("lang_pred", "score"), with_text: bool = False) -> DataFrame:
    """doc_id, the columns of keep, _text if with_text, lang_pred, score (or the names of named). Only the text decides; whole texts are read.

    Null text or no letter: und, score 0. Null id: kept. Repeated rows: each predicted. Words of a script that no
    language has shown say nothing; if there are no others, the first language by name gets an even score. Ties: the first language
    by name. Empty table: no row. Columns that aren't named are ignored; one of keep that has a name of the result raises ValueError.
    """
    if set(keep) & {"doc_id", "_text", *named}:
        raise ValueError(f"columns to keep clash with {('doc_id', '_text', *named)}")
    source = df.select(F.col(id_col).alias("doc_id"), *[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("_text"))
    n = len(model["langs"])
    tables = {"langs": model["langs"], "longest": model["longest"], "words": Table.of(model["words"], n), "grams": Table.of(model["grams"], n)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            got = list(predict(batch.column(batch.num_columns - 1).to_pylist(), tables, cache))
            rest = batch.num_columns - (not with_text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:rest], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*batch.schema.names[:rest], *named])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (source if with_text else source.drop("_text")).schema)
    return source.mapInArrow(run, f"{ddl}, `{named[0]}` string, `{named[1]}` double")


def held_out(id_col: str = "doc_id"):
    """Column: the fourth of the ids that nothing is learned from; a null id is neither learned from nor held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame) -> dict:
    return fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() over all documents, by a model that the rows held out had no part in."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs.withColumn("held_out", held_out()), fit_documents(docs), keep=("held_out",))


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows, all columns whatever their names, whose text is in a learned language with at least this posterior.

    Null texts, texts without a letter: go. Null ids: judged by the text. Repeated rows: each judged. Empty table: no row.
    """
    model, names = fit_documents(docs), docs.columns
    inner = [f"_c{i}" for i in range(len(names))]  # no name of a column can clash
    text = inner[names.index("text")]
    tagged = identify(docs.toDF(*inner).withColumn("_id", F.lit(None).cast("long")), model, "_id", text, tuple(c for c in inner if c != text), ("_lang", "_score"), True)
    return tagged.where((F.col("_lang") != UND) & (F.col("_score") >= least)).select(*[F.col("_text" if c == text else c).alias(n) for c, n in zip(inner, names, strict=True)])
