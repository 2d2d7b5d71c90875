"""Operator 7: token counts by a map-side two-tier lookup.

Tier 1 is a compact table of the corpus's frequent pieces (a word with its punctuation, see chunks.pieces) and their
token counts; its size is bounded by `table_size` entries of `max_chars` characters and checked before it is broadcast.
Tier 2 is a bounded cache in each worker that keeps what the library said about pieces that tier 1 lacks.

The frequent pieces are those of all documents: each task sums up its own in one row of bounded size (a Counter that is
cut back to its most frequent entries when it grows too long), and the rows are merged in two levels of tasks. Pieces
themselves are never shuffled, and the counts don't depend on either tier.

Defined results: null text counts as empty (0 tokens, 0 bytes); empty tables give no rows; repeated rows and rows
without doc_id are counted each; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rodada.llm.chunks import PieceCache, WordTokens, can_cut, lines, load_tokenizer, pieces, special_strings
from rodada.llm.common import kept, texts

MAX_TABLE_BYTES = 8 << 20


class LibraryCounter:
    """Tokens of a string by the library of the file: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        self.cut = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.special: list[str] = []
            self.count = lambda s: len(model.encode(s, add_bos=False, add_eos=False, num_threads=1))
        else:
            tok = load_tokenizer(path)
            self.special, self.cut = special_strings(tok), can_cut(path)
            words = WordTokens(tok) if self.cut else lambda s: None

            def count(s: str) -> int:
                found = words(s)
                return len(tok.encode(s, add_special_tokens=False)) if found is None else len(found)

            self.count = count


class Summary:
    """The most frequent pieces of what it was given, in bounded memory."""

    def __init__(self, size: int, max_chars: int):
        self.size, self.max_chars, self.seen = size, max_chars, Counter()

    def _bounded(self) -> None:
        if len(self.seen) > 8 * self.size:
            self.seen = Counter(dict(self.seen.most_common(4 * self.size)))

    def add(self, text: str) -> None:
        for line in lines(text):
            self.seen.update(pieces(line)[1:])
        self._bounded()

    def merge(self, joined: str, counts: bytes) -> None:
        self.seen.update(dict(zip(joined.split(" "), np.frombuffer(counts, "<i8").tolist(), strict=False)))
        self._bounded()

    def top(self) -> list[tuple[str, int]]:
        """The pieces of 1 to max_chars characters, none of them blank, the most frequent first, ties by piece."""
        fits = [(-n, p) for p, n in self.seen.items() if 0 < len(p) <= self.max_chars and not any(map(str.isspace, p))]
        return [(p, -n) for n, p in sorted(fits)[: self.size]]

    def row(self) -> pa.RecordBatch:
        top = self.top()
        return pa.RecordBatch.from_arrays([pa.array([" ".join(p for p, _ in top)]), pa.array([np.array([n for _, n in top], "<i8").tobytes()])], names=["pieces", "counts"])


def frequent_pieces(docs: DataFrame, text_col: str, tokenizer_path: str, table_size: int = 1 << 16, max_chars: int = 24) -> tuple[bytes, bytes]:
    """The compact table: the frequent pieces of all documents joined by spaces, and a count byte for each."""
    if not kept(LibraryCounter, tokenizer_path).cut:
        return b"", b""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Summary(table_size // 4, max_chars)
        for batch in batches:
            for _, strings in texts(batch, "text"):
                for s in strings:
                    mine.add(s)
        if mine.seen:
            yield mine.row()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Summary(table_size, max_chars)
        for batch in batches:
            for row in batch.to_pylist():
                both.merge(row["pieces"], row["counts"])
        if both.seen:
            yield both.row()

    schema, parts = "pieces string, counts binary", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(text_col).alias("text")).filter("text is not null").mapInArrow(count, schema)
    for n in dict.fromkeys((parts, math.isqrt(parts), 1)):
        rows = rows.repartition(n).mapInArrow(merge, schema)
    found = rows.collect()  # one row of table_size pieces at most
    library = kept(LibraryCounter, tokenizer_path)
    top = [(p, n) for r in found for p in r["pieces"].split(" ") if p and (n := library.count(" " + p)) < 256]
    return " ".join(p for p, _ in top).encode(), bytes(n for _, n in top)


class CachedCounter:
    """The library's counts with the worker's caches of pieces in front."""

    def __init__(self, path: str, cache_size: int):
        self.library = LibraryCounter(path)
        self.head, self.tail = PieceCache(self.library.count, cache_size // 4, ""), PieceCache(self.library.count, cache_size)
        self.line_end = self.library.count("\n") if self.library.cut else 0

    def tokens(self, text: str, first: dict) -> int:
        """Tokens of a whole text; first is the broadcast table, which turns to the caches for what it lacks."""
        if not self.library.cut or any(s in text for s in self.library.special):
            return self.library.count(text)
        n = -self.line_end
        for line in lines(text):
            start, *rest = pieces(line)
            n += self.line_end + self.head[start] + sum(map(first.__getitem__, rest))
        return n


class FirstTier(dict):
    """The broadcast table in front of a cache; what it lacks isn't added."""

    def __init__(self, table: tuple[bytes, bytes], second: PieceCache):
        joined, counts = table
        super().__init__(zip(joined.decode().split(" "), counts, strict=False))
        self.second = second

    def __missing__(self, piece: str) -> int:
        return self.second[piece]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", table_size: int = 1 << 16, cache_size: int = 300_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each document."""
    table = frequent_pieces(docs, text_col, tokenizer_path, table_size)
    if (size := sum(map(len, table))) > MAX_TABLE_BYTES:
        raise ValueError(f"the frequent-piece table has {size} bytes; its bound is {MAX_TABLE_BYTES}")
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(CachedCounter, tokenizer_path, cache_size)
        first = FirstTier(shared.value, counter.tail)
        for batch in batches:
            for rows, strings in texts(batch, "text"):
                n = np.array([counter.tokens(s or "", first) for s in strings], np.int64)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_bytes"), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return plain.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
