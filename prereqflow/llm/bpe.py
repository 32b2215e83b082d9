"""Byte-level BPE over Arrow batches: ids with offsets, and back to bytes and text."""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Characters of text that are cut, encoded and emitted together, about.
STRETCH = 1 << 20
#: Words, and characters of them, that a worker remembers; beyond either it starts anew.
KNOWN_WORDS, KNOWN_CHARS = 250_000, 4_000_000
_WORD_END = regex.compile(r"(?<=\S)\s")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes are themselves, the others follow from code point 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Codec:
    """A rank file as a model of the tokenizers library, and its inverse.

    The file lists byte strings by rank, which is their id. Each is the merge of the two parts to which the lower ranks take it; with these merges the
    library gives what merging the adjacent pair of least rank gives. Every match of the pattern is a word of its own; a worker encodes each different word once.
    """

    def __init__(self, name: str):
        import public_tokenizers as P
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(P.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        of = byte_characters()
        spell = lambda token: "".join([of[b] for b in token])
        merges = [tuple(map(spell, _parts(token, ranks))) for token in sorted(ranks, key=ranks.get) if len(token) > 1]
        self.model = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(P.PATTERN)
        byte = {c: b for b, c in enumerate(of)}
        self.tokens = {i: bytes([byte[c] for c in t]) for t, i in self.model.get_vocab().items()}
        self.n_bytes = np.zeros(max(self.tokens) + 1, np.int64)
        self.n_bytes[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        # of each known word: where its ids begin in the pool, and how many they are
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.model.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
        # the ids of a word are those that end within its bytes
        upto = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum([len(w.encode()) for w in words])) + 1
        count = np.diff(upto, prepend=0)
        self.first, self.count = np.concatenate([self.first, len(self.ids) + upto - count]), np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids])
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.chars += sum(map(len, words))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How many ids each text has, then all ids in order, and of each the first character of its text that it touches and the one after the last."""
        if len(self.place) > KNOWN_WORDS or self.chars > KNOWN_CHARS:
            self._forget()
        words = [self.pattern.findall(t) for t in texts]
        flat = list(chain.from_iterable(words))
        if new := [w for w in dict.fromkeys(flat) if w not in self.place]:
            self._learn(new)
        w = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        count = self.count[w]
        ids = self.ids[np.repeat(self.first[w] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        ends = np.cumsum([0, *map(len, words)])
        upto = np.concatenate([[0], np.cumsum(count)])[ends]
        per_text = np.diff(upto)
        # ids cover all bytes in order; a byte that doesn't continue a character begins one
        size = self.n_bytes[ids]
        last = np.cumsum(size)
        char = np.cumsum((np.frombuffer("".join(texts).encode(), np.uint8) & 0xC0) != 0x80, dtype=np.int32)
        before = np.repeat(np.cumsum([0, *map(len, texts)])[:-1].astype(np.int32), per_text)
        return per_text, ids, char[last - size] - 1 - before, char[last - 1] - before

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts, ends of one text of any length, in stretches."""
        parts, at = [(np.zeros(0, np.int32),) * 3], 0
        for piece in _stretches(text):
            _, ids, starts, ends = self.encode_all([piece])
            parts.append((ids, starts + np.int32(at), ends + np.int32(at)))
            at += len(piece)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def decode(self, ids: list[int]) -> bytes | None:
        """The bytes; None if an id isn't in the vocabulary."""
        try:
            return b"".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return None

    def pieces(self, ids: list[int]) -> list[str]:
        """What each id adds to the text: a character whose bytes several ids share is added by the one that completes it; bytes that aren't
        UTF-8 give U+FFFD as soon as that is certain, an unknown id gives it at once, and what is open at the end by the last id."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(self.tokens.get(i, b"\xff"), k == len(ids) - 1) for k, i in enumerate(ids)]


def _parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The two parts that the last merge of a token joins: its bytes, merged by all lower ranks."""
    parts, never = [token[i : i + 1] for i in range(len(token))], len(ranks)
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], never))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _stretches(text: str) -> Iterator[str]:
    """The text in parts of about STRETCH characters, cut before white space behind other characters, where every match of the pattern ends."""
    at = 0
    while at < len(text):
        end = m.start() if len(text) - at > STRETCH and (m := _WORD_END.search(text, at + STRETCH)) else len(text)
        yield text[at:end]
        at = end


@lru_cache(2)
def codec(name: str) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Codec(name)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of rows that have about STRETCH characters together; a longer text stands alone."""
    docs, texts, size = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        text = text.as_py() or ""
        if docs and size + len(text) > STRETCH:
            yield docs, texts
            docs, texts, size = [], [], 0
        docs.append(doc)
        texts.append(text)
        size += len(text)
    if docs:
        yield docs, texts


ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


def encode(df: DataFrame, ranks: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, starts, ends of every row: the ids of its whole text, and the characters (code points, end exclusive) that each id touches; ids that share
    a character, each with some of its bytes, have it both. Strings of special tokens are ordinary text. ranks: a rank file of public_tokenizers.

    A map without shuffle: rows are encoded in groups of about a million characters, whatever the batch, and a longer text in stretches of that size.
    Null or empty text: empty lists. Null id: kept. Repeated rows: each encoded. Empty input: no row. Columns that aren't named are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.list_(pa.int32())) for c in ("ids", "starts", "ends")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(ranks)
        for batch in batches:
            for docs, texts in _groups(batch):
                if len(texts) == 1:
                    ids, *spans = of.encode(texts[0])
                    count = np.array([len(ids)])
                else:
                    count, ids, *spans = of.encode_all(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, *spans)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *lists], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED)


def decode(df: DataFrame, ranks: str = "byte_bpe_50k", id_col: str = "doc_id", ids_col: str = "ids", pieces: bool = False) -> DataFrame:
    """doc_id, bytes, text, and with `pieces` what each id adds to the text, so that a reader of a stream never sees a part of a character.

    bytes are exact. text replaces what isn't UTF-8, as where ids were cut inside a character. An id that isn't in the vocabulary makes bytes and text null.
    Null or empty ids: empty. Null id: kept. Repeated rows: each decoded. Empty input: no row. Columns that aren't named are ignored.
    """
    fields = [("doc_id", pa.int64()), ("bytes", pa.binary()), ("text", pa.string())] + [("pieces", pa.list_(pa.string()))] * pieces
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(ranks)
        for batch in batches:
            for part in _parted(batch):
                rows = [x or [] for x in part.column(1).to_pylist()]
                got = [of.decode(x) for x in rows]
                columns = [part.column(0), pa.array(got, pa.binary()), pa.array([None if b is None else b.decode("utf-8", "replace") for b in got], pa.string())]
                if pieces:
                    columns.append(pa.array([of.pieces(x) for x in rows], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    given = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return given.mapInArrow(run, "doc_id long, bytes binary, text string" + ", pieces array<string>" * pieces)


def _parted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in groups of about STRETCH ids, so that lists of Python objects stay small; the ids are the second column."""
    ends = np.cumsum(np.array(batch.column(1).value_lengths().fill_null(0), np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + STRETCH, "right")))
        yield batch.slice(at, to - at)
        at = to


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode() over all documents, and the ids decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256, n_shared_chars (places where two ids that follow each other share a character)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_shared_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec("byte_bpe_50k")
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                ids, starts, ends = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                shared = int((starts[1:] < ends[:-1]).sum())
                out.append((batch.column(0)[k].as_py(), len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(of.decode(ids.tolist())).hexdigest(), shared))
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    encoded = encode(table(spark, sf_dir, "documents"))
    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_shared_chars long")
