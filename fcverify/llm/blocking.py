"""Exact ranked lexical search with geometric blocks in every posting list.

Queries are taken in blocks whose terms fit in memory. One pass over the documents gives every
document's vector over those terms, and the counts that the scores need. The vectors of a task
are indexed in shards: each shard has a posting list for every term; a list that a query opens is
clustered into blocks of similar documents, and each block keeps a summary, the coordinatewise
maximum of its documents' impacts. No document of a block can score more than the summary does.

A query visits its terms by falling largest impact and stops when those left cannot lift a new
document to its k-th best score; in an open list it skips exactly the blocks whose summary scores less
than that, and scores all other documents in full. The k-th best score first comes from a drawn part
of the documents, whose k-th best is never above that of all, and then rises in the task.

Scores and bounds are whole numbers; sums in doubles are exact below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fcverify.llm.store import ready, stored, texts
from fcverify.llm.words import term_blocks

K = 50
# Queries of a block, and characters of them, about.
QUERIES, CHARS = 256, 1 << 20
# Entries and documents of a shard, documents of a block about, dimensions that similarity is taken in.
ENTRIES, DOCS, BLOCK, DIMS = 1 << 19, 8192, 32, 64
# Documents that the first bounds come from, about.
DRAWN = 8192
# Kinds of rows: a document's vector, a term's document frequency, counts of all documents.
VECTOR, TERM, ALL = 0, 1, 2

_ROW = "kind int, doc_id long, n long, terms binary, tf binary"
_ROW_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
_HIT = "query int, doc_id long, score long"


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Vectors over the vocabulary of the documents that have one, ``n`` their terms; at a task's end its counts.

    ``kind`` TERM: ``n`` documents of the task hold term ``doc_id``. ALL: ``doc_id`` documents have ``n`` terms in all.
    """
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, length = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, found = 0, []
                for words in term_blocks(text):
                    n += len(words)
                    code = np.fromiter(map(vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
                    found.append(code[code >= 0])
                if not n:
                    continue
                documents, length = documents + 1, length + n
                term, tf = np.unique(np.concatenate(found), return_counts=True)
                if len(term):
                    df[term] += 1
                    rows.append((VECTOR, doc, n, term.astype("<u4").tobytes(), tf.astype("<u4").tobytes()))
            yield _rows(rows)
        at = np.flatnonzero(df)
        yield _rows([(TERM, int(t), int(n), None, None) for t, n in zip(at, df[at])] + [(ALL, documents, length, None, None)])

    return texts(docs).mapInArrow(work, _ROW)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_ROW_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ROW_TYPES)], names=[f.split()[0] for f in _ROW.split(", ")])


def term_weight(documents: int, df: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term adds to a document's score; all arguments are whole numbers, one an entry."""
    m = 50 + 50 * n * documents // length
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of spans one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Shard:
    """Documents' vectors and the posting lists over them."""

    def __init__(self, size: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        """``size[i]`` entries (``term``, ``impact``) belong to document i."""
        self.size, self.term, self.impact = size, term, impact
        self.start = np.cumsum(size) - size
        doc = np.repeat(np.arange(len(size)), size)
        order = np.argsort(term, kind="stable")
        self.posting = doc[order]
        self.bounds = np.searchsorted(term[order], np.arange(terms + 1))
        self.largest = np.zeros(terms, dtype=np.int64)
        held = np.flatnonzero(np.diff(self.bounds))
        if len(held):
            self.largest[held] = np.maximum.reduceat(impact[order], self.bounds[held])
        # similarity of documents is taken on folded vectors: it only decides who shares a block
        h = term.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        sign = np.where(h & np.uint64(1), 1.0, -1.0)
        folded = np.bincount(doc * DIMS + (h >> np.uint64(1)).astype(np.int64) % DIMS, weights=sign * impact, minlength=len(size) * DIMS)
        self.folded = folded.reshape(-1, DIMS).astype(np.float32)
        self.folded /= np.maximum(np.linalg.norm(self.folded, axis=1, keepdims=True), 1e-9)
        self.blocks: dict[int, tuple] = {}
        self.scored = 0

    def list_blocks(self, t: int) -> tuple:
        """Of term t's list: documents by block, the blocks' sizes, and the summaries' block, term and value."""
        if t not in self.blocks:
            docs = self.posting[self.bounds[t]:self.bounds[t + 1]]
            pivots = docs[::BLOCK]
            near = (self.folded[docs] @ self.folded[pivots].T).argmax(axis=1)
            order = np.argsort(near, kind="stable")
            docs, near = docs[order], near[order]
            at = _spans(self.start[docs], self.size[docs])
            block, term, value = np.repeat(near, self.size[docs]), self.term[at], self.impact[at]
            key = block * (len(self.bounds) - 1) + term
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            self.blocks[t] = (docs, near, len(pivots), block[order][first], term[order][first],
                              np.maximum.reduceat(value[order], first).astype(np.float64))
        return self.blocks[t]

    def search(self, terms: np.ndarray, asked: np.ndarray, bound: int, best) -> None:
        """Offer ``best`` all documents that may score at least ``bound`` for ``terms``; ``asked`` is a mask of them."""
        terms = terms[self.largest[terms] > 0]
        terms = terms[np.argsort(-self.largest[terms], kind="stable")]
        rest = np.cumsum(self.largest[terms][::-1])[::-1]
        seen = np.zeros(len(self.size), dtype=bool)
        for t, most in zip(terms.tolist(), rest.tolist()):
            if most < bound:
                break
            docs, near, n, block, term, value = self.list_blocks(t)
            own = asked[term]
            may = np.bincount(block[own], weights=value[own], minlength=n) >= bound
            docs = docs[may[near] & ~seen[docs]]
            if len(docs):
                seen[docs] = True
                bound = best(docs, self.scores(docs, asked))

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        self.scored += len(docs)
        size = self.size[docs]
        at = _spans(self.start[docs], size)
        value = np.where(asked[self.term[at]], self.impact[at], 0)
        return np.add.reduceat(value, np.cumsum(size) - size)


class Best:
    """The k best documents of every query: score falling, then id rising, null last."""

    def __init__(self, bounds: list[int], k: int):
        self.k, self.bounds = k, list(bounds)
        self.rows = [(np.zeros(0, np.int64),) * 3 for _ in bounds]

    def offer(self, query: int, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> int:
        """The least score that still matters for the query."""
        at = score >= self.bounds[query]
        rows = [np.r_[a, b[at]] for a, b in zip(self.rows[query], (score, null, doc))]
        if len(rows[0]) > self.k:
            pick = np.lexsort((rows[2], rows[1], -rows[0]))[:self.k]
            rows = [a[pick] for a in rows]
        self.rows[query] = rows
        if len(rows[0]) == self.k:
            self.bounds[query] = max(self.bounds[query], int(rows[0].min()))
        return self.bounds[query]


def search_vectors(rows: DataFrame, queries: list[np.ndarray], weight: np.ndarray, documents: int, length: int, bounds: list[int],
                   k: int) -> DataFrame:
    """The k best documents of each task's vectors for every query, those that score less than its bound left out."""
    terms = len(weight)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(bounds, k)
        held: list[tuple] = []  # (id, is null, terms of the document, vector)
        entries = 0

        def index() -> None:
            ids = np.array([x[0] for x in held], dtype=np.int64)
            null = np.array([x[1] for x in held], dtype=np.int64)
            size = np.array([len(x[3]) for x in held])
            term = np.concatenate([x[3] for x in held]).astype(np.int64)
            tf = np.concatenate([x[4] for x in held]).astype(np.int64)
            n = np.repeat(np.array([x[2] for x in held], dtype=np.int64), size)
            shard = Shard(size, term, impacts(weight[term], tf, n, documents, length), terms)
            asked = np.zeros(terms, dtype=bool)
            for q, own in enumerate(queries):
                asked[own] = True
                shard.search(own, asked, best.bounds[q], lambda docs, score: best.offer(q, score, null[docs], ids[docs]))
                asked[own] = False

        for batch in batches:
            for doc, n, term, tf in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "tf")]):
                held.append((doc or 0, doc is None, n, np.frombuffer(term, "<u4"), np.frombuffer(tf, "<u4")))
                entries += len(held[-1][3])
                if entries >= ENTRIES or len(held) >= DOCS:
                    index()
                    held, entries = [], 0
        if held:
            index()
        for q, (score, null, doc) in enumerate(best.rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(score), q, dtype=np.int32)), pa.array(doc, mask=null.astype(bool)), pa.array(score)],
                names=["query", "doc_id", "score"])

    return rows.select("doc_id", "n", "terms", "tf").mapInArrow(work, _HIT)


def _kth(hits: DataFrame, k: int) -> DataFrame:
    """The k best of every query, ``rank`` from 1."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: the k best documents of every item with a score above 0.

    Several rows with one ``item_id`` are one item with the terms of all. Items without an id, text or term, and those that no
    document shares a term with, return nothing; so does an empty table. Repeated documents count and rank each for itself;
    documents without id come last among equal scores.
    """
    spark = ready(docs.sparkSession)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null")
    size = asked.agg(F.count_distinct("item_id"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-size[0] // QUERIES), -(-size[1] // CHARS))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for number in range(blocks):
        # about QUERIES items and CHARS characters
        block = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()
        found = _search_block(docs, block, k)
        out = found if number == 0 else out.unionByName(found)
    return out


def _search_block(docs: DataFrame, block: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    words: dict[int, set[bytes]] = {}
    for r in block:
        words.setdefault(r["item_id"], set()).update(w for part in term_blocks(r["text"]) for w in part)
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*words.values())))}
    names = sorted(words)
    rows = stored(vectors(docs, vocabulary), "vectors")
    # one row a term, and one more
    counts = (rows.filter(F.col("kind") != VECTOR).groupBy("kind", F.when(F.col("kind") == TERM, F.col("doc_id")).alias("term"))
              .agg(F.sum("n").alias("n"), F.sum("doc_id").alias("documents")).collect())
    df = {r["term"]: r["n"] for r in counts if r["kind"] == TERM}
    documents, length = next(((r["documents"], r["n"]) for r in counts if r["kind"] == ALL), (0, 0))
    weight = np.array([term_weight(documents, df[t]) if t in df else 0 for t in range(len(vocabulary))], dtype=np.int64)
    queries = [np.array(sorted(vocabulary[w] for w in words[i]), dtype=np.int64) for i in names]
    vector = rows.filter(F.col("kind") == VECTOR)
    bounds = [1] * len(names)

    def ask(part: DataFrame) -> DataFrame:
        return _kth(search_vectors(part, queries, weight, documents, length, bounds, k), k)

    if documents > 2 * DRAWN:
        drawn = F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(documents // DRAWN)) == 0
        for r in ask(vector.filter(drawn)).filter(F.col("rank") == k).select("query", "score").collect():  # one row a query
            bounds[r["query"]] = r["score"]
    item = spark.createDataFrame(list(enumerate(names)), "query int, item_id long")
    return ask(vector).join(F.broadcast(item), "query").select("item_id", "rank", "doc_id", "score")
