"""Operator 13: ranked lexical search by Fagin's threshold algorithm over segments of the corpus.

One pass over the texts writes a forward index (a row per document: its length, and the query terms it holds with their
frequencies) to the shared folder. Its counts give the statistics of the whole corpus, and so each posting's impact.
Each task then cuts its part of the index into segments of at most `segment_postings` postings. In a segment every term
has a list sorted by impact. A query reads its lists round-robin, `step` postings a list at a time, looks each new
document's whole score up in the forward index, and stops when the threshold (the sum of the impacts last read) is
strictly below its k-th score, so that documents of equal score are all seen. The best of earlier segments of the task
raise that bar. A segment gives k rows a query at most, and the k best of them are the answer. Nothing is shuffled but
those rows.

Query terms go to the workers in blocks of at most `max_terms` terms (or one query), a checked bound; the corpus is
indexed once for each block.

Weights and normalisation: w = floor(1000 ln((2N+2)/(2df+1))), m = 25 + (75 n N) div L, and a posting's impact is
w * ((10^9 tf) div (1000 tf + 8 m)); a query term that is repeated counts as often.

Defined results: null texts and texts without a term have no terms and count nowhere; queries without terms or without
an id give no rows; documents without an id count in the statistics and are not ranked; repeated rows of documents are
documents of their own; queries that repeat id and text count once, and those that share an id alone are answered each;
equal scores go by ascending id; empty tables give no rows; other columns are ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rodada.llm.common import texts
from rodada.llm.decontaminate import words_of
from rodada.operators.work import cut

#: Places of the corpus's own counts among the counts by term.
_DOCUMENTS, _WORDS = -1, -2


def term_weight(n_docs: int, df: int) -> int:
    """Weight of a term that df of n_docs documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Segment:
    """Some documents' postings, by term in descending impact and by document."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, held: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_words: int):
        """held: postings of each document, in the order of terms and tf."""
        self.ids, self.end = ids, np.cumsum(held)
        self.held, self.terms = held, terms
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), held)
        m = 25 + (75 * lengths * n_docs) // max(n_words, 1)
        self.impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.lexsort((-self.impact, terms))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.first = np.searchsorted(terms[order], np.arange(len(weights) + 1))

    def scores(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Whole scores of docs (places), by the forward index; times: how often the query has each term."""
        n = self.held[docs]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.end[docs] - ends, n)
        return np.add.reduceat(times[self.terms[at]] * self.impact[at], ends - n)

    def search(self, query: list[tuple[int, int]], best: list[tuple[int, int]], k: int, step: int, times: np.ndarray) -> tuple[list[tuple[int, int]], int]:
        """(best of this segment and of `best`, postings read per list): (-score, id) ascending, k at most."""
        lists = [(self.first[t], self.first[t + 1], c) for t, c in query]
        longest = max((b - a for a, b, _ in lists), default=0)
        seen, depth = np.zeros(len(self.ids), bool), 0
        while depth < longest:
            new = np.concatenate([self.list_doc[a + depth : min(a + depth + step, b)] for a, b, _ in lists])
            new = np.unique(new[~seen[new]])
            depth += step
            if len(new):
                seen[new] = True
                scores = self.scores(new, times)
                if len(best) == k:
                    hit = scores >= -best[-1][0]
                    new, scores = new[hit], scores[hit]
                if len(new) > k:
                    top = np.lexsort((self.ids[new], -scores))[:k]
                    new, scores = new[top], scores[top]
                best = sorted(best + [(-s, i) for s, i in zip(scores.tolist(), self.ids[new].tolist(), strict=True) if s > 0])[:k]
            threshold = sum(c * int(self.list_impact[a + depth - 1]) for a, b, c in lists if a + depth <= b)
            if threshold <= 0 or len(best) == k and threshold < -best[-1][0]:
                break
        return best, depth


def _blocks(queries: DataFrame, id_col: str, text_col: str, max_terms: int) -> Iterator[list[tuple]]:
    """Queries (id, terms with counts), streamed to the driver in blocks of at most max_terms different terms (or one query)."""
    block, known = [], set()
    rows = queries.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null").distinct()
    for r in rows.toLocalIterator():
        terms = Counter(words_of(r["t"]))
        if block and len(known) + len(terms.keys() - known) > max_terms:
            yield block
            block, known = [], set()
        if terms:
            block.append((r["i"], terms))
            known |= terms.keys()
    if block:
        yield block


def forward_index(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs (int32 arrays as bytes) of documents with a term at all."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = vocabulary.value
        for batch in batches:
            for rows, strings in texts(batch, "text"):
                n, terms, tfs = [], [], []
                for s in strings:
                    words = words_of(s)
                    found = sorted((place[w], c) for w, c in Counter(words).items() if w in place)
                    n.append(len(words))
                    terms.append(np.array([t for t, _ in found], np.int32).tobytes())
                    tfs.append(np.array([c for _, c in found], np.int32).tobytes())
                out = pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array([x > 0 for x in n]))

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return found.mapInArrow(index, "doc_id long, n long, terms binary, tfs binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of a column of int32 arrays as bytes, how many each row has)."""
    parts = [np.frombuffer(x, np.int32) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array([len(x) for x in parts], np.int64)


def corpus_counts(index: DataFrame) -> dict[int, int]:
    """Documents that hold each term, documents and their terms with repeats: one row a term and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_words = np.zeros(0, np.int64), 0, 0
        for b in batches:
            here = np.bincount(_flat(b.column("terms"))[0]).astype(np.int64)
            low, high = sorted((df, here), key=len)
            df = high + np.pad(low, (0, len(high) - len(low)))
            n_docs, n_words = n_docs + b.num_rows, n_words + int(b.column("n").to_numpy().sum())
        held = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array([*held.tolist(), _DOCUMENTS, _WORDS], pa.int32()), pa.array([*df[held].tolist(), n_docs, n_words], pa.int64())], names=["term", "n"])

    rows = index.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in rows.toLocalIterator()}


def _search(index: DataFrame, plan, k: int, segment_postings: int, step: int) -> DataFrame:
    """(query, doc_id, score): each task's k best of each query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, n_docs, n_words = plan.value
        times, best = np.zeros(len(weights), np.int64), [[] for _ in queries]

        def meet(parts: list[tuple]) -> None:
            segment = Segment(*(np.concatenate(x) for x in zip(*parts, strict=True)), weights, n_docs, n_words)
            for q, query in enumerate(queries):
                for t, c in query:
                    times[t] = c
                best[q] = segment.search(query, best[q], k, step, times)[0]
                for t, _ in query:
                    times[t] = 0

        parts, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = batch.slice(at, 2048)
                rows = rows.filter(rows.column("doc_id").is_valid())
                terms, held = _flat(rows.column("terms"))
                tfs, _ = _flat(rows.column("tfs"))
                some = held > 0
                parts.append((rows.column("doc_id").to_numpy()[some], rows.column("n").to_numpy()[some], held[some], terms, tfs.astype(np.int64)))
                size += len(terms)
                if size >= segment_postings:
                    meet(parts)
                    parts, size = [], 0
        if size:
            meet(parts)
        found = [(q, i, -s) for q, b in enumerate(best) for s, i in b]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["query", "doc_id", "score"])

    return index.mapInArrow(search, "query int, doc_id long, score long")


def threshold_search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", max_terms: int = 200_000, segment_postings: int = 1_000_000, step: int = 64) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of each query."""
    spark, kind, out = docs.sparkSession, queries.schema[query_id].dataType, None
    for block in _blocks(queries, query_id, query_text, max_terms):
        place: dict[bytes, int] = {}
        for _, terms in block:
            for t in terms:
                place.setdefault(t, len(place))
        index = cut(forward_index(docs, spark.sparkContext.broadcast(place), id_col, text_col))
        counts = corpus_counts(index)
        n_docs, n_words = counts.get(_DOCUMENTS, 0), counts.get(_WORDS, 0)
        weights = np.array([term_weight(n_docs, counts[t]) if t in counts else 0 for t in range(len(place))], np.int64)
        asked = [[(place[t], c) for t, c in terms.items() if weights[place[t]] > 0] for _, terms in block]
        found = _search(index, spark.sparkContext.broadcast((asked, weights, n_docs, n_words)), k, segment_postings, step)
        best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(i for i, _ in block)), f"query int, item_id {kind.simpleString()}")
        named = best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long") if out is None else out


def threshold_sql(k: int = 10) -> str:
    """DuckDB SQL for the rows over documents and benchmark."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"coalesce(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), [])"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents), s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM d WHERE len(w) > 0),
 b AS (SELECT row_number() OVER () AS q, item_id, {words} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL) x), qt AS (SELECT q, t, count(*) AS c FROM (SELECT q, unnest(w) AS t FROM b) x GROUP BY q, t),
 p AS (SELECT r, n, t, count(*) AS tf FROM (SELECT r, len(w) AS n, unnest(w) AS t FROM d) x GROUP BY r, n, t), df AS (SELECT t, count(*) AS df FROM p GROUP BY t),
 i AS (SELECT p.r, p.t, CAST(floor(1000*ln((2*n_docs+2)/CAST(2*df+1 AS DOUBLE))) AS BIGINT) * ((1000000000*tf) // (1000*tf + 8*(25 + (75*n*n_docs) // n_words))) AS impact FROM p JOIN df USING (t) CROSS JOIN s),
 f AS (SELECT q, r, CAST(sum(c*impact) AS BIGINT) AS score FROM qt JOIN i USING (t) GROUP BY q, r), o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM f JOIN b USING (q) JOIN d USING (r) WHERE score > 0 AND doc_id IS NOT NULL)
 SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= {k}"""
