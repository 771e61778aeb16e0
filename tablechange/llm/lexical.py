"""Ranked lexical search by an Aho-Corasick scan of whole texts, without an index of documents.

The terms of all items go into one automaton. Each term is guarded by a boundary on both sides, and
texts are brought to the same form (separators become boundaries, A-Z are lowered), so an output of
the automaton is an occurrence of a whole term and of nothing else. One scan counts the documents
and terms of the corpus and the documents of each term; a second one counts occurrences, maps the
outputs to the items that hold the term and adds up their scores.

Items come in blocks: the driver reads them in order and closes a block at ``BLOCK_COST`` (the
characters of its item terms plus 8 for each, at least one item). Only a block's terms are broadcast,
and the table is scanned anew for each block. Within a task only the ``top`` best documents of each
item are held, and these are merged in two steps, so no task meets all rows of an item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import floor, log
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablechange.session import discard, materialize

BLOCK_COST = 2 << 20
CELLS = 1 << 22  # scores, and occurrences spread over items, looked at together
SALTS = 64
# Characters of terms: digits, A-Z, a-z and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FORM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_number = itemgetter(1)


def bounded(text: str) -> tuple[str, int]:
    """A text as the automaton reads it, one character for each byte, and its number of terms."""
    raw = text.encode("utf-8", "replace").translate(_FORM)
    return f" {raw.decode('latin-1')} ", len(raw.split())


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Finds ``terms`` as whole terms; its outputs are their places in the list."""
    out = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        out.add_word(f" {t.encode().decode('latin-1')} ", i)
    out.make_automaton()
    return out


@dataclass
class Block:
    """Some items: their ids, the distinct terms, and for each term the items that hold it."""

    items: list
    terms: list[str]
    starts: np.ndarray
    holders: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[object, list[str]]]) -> Block:
        number: dict[str, int] = {}
        pairs = sorted((number.setdefault(t, len(number)), i) for i, (_, terms) in enumerate(items) for t in terms)
        at = np.array([t for t, _ in pairs], np.int64)
        return cls([i for i, _ in items], list(number), np.searchsorted(at, np.arange(len(number) + 1)), np.array([i for _, i in pairs], np.int64))


def blocks(terms: DataFrame, cost: int = BLOCK_COST) -> Iterator[Block]:
    """Items of ``(item, terms)`` by blocks; the driver holds one block and one partition of items at a time."""
    held, size = [], 0
    for item, found in terms.toLocalIterator():
        held.append((item, found))
        size += sum(len(t) + 8 for t in found)
        if size >= cost:
            yield Block.of(held)
            held, size = [], 0
    if held:
        yield Block.of(held)


def _terms(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))


class _Best:
    """The ``top`` best documents of each item among those seen."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.empty = [np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64)]
        self.parts, self.size, self.room = [self.empty], 0, 4 * top * items + 65_536

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.least)
        self.parts.append([item, scores[doc, item], known[doc], ids[doc]])
        self.size += len(doc)
        if self.size > self.room:
            self.parts, self.size = [self.best()], 0

    def best(self) -> list[np.ndarray]:
        item, score, known, ids = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((ids, known, -score, item))
        item, score, known, ids = item[order], score[order], known[order], ids[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.top - 1
        self.least[item[last]] = score[last]
        keep = place < self.top
        return [item[keep], score[keep], known[keep], ids[keep]]


def _statistics(texts: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents with terms, their terms, and the documents of each term of the block."""
    given = texts.sparkSession.sparkContext.broadcast(block.terms)

    def run(batches):
        find, docs, terms, held = automaton(given.value), 0, 0, np.zeros(len(given.value), np.int64)
        for b in batches:
            for t in b.column(0):
                text, n = bounded(t.as_py())
                if n:
                    docs, terms = docs + 1, terms + n
                    held[list(set(map(_number, find.iter(text))))] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(held[at], [docs, terms]))], names=["term", "n"])

    counted = texts.select("__text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    given.destroy()
    found = dict(map(tuple, counted))
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(i, 0) for i in range(len(block.terms))], np.int64)


def _ranked(texts: DataFrame, block: Block, item_type: T.DataType, top: int) -> DataFrame:
    """``(__item, rank, __doc, score)`` for the items of a block."""
    docs, terms, held = _statistics(texts, block)
    weight = np.array([floor(1000 * log((2 * docs + 2) / (2 * int(h) + 1))) for h in held], np.int64)
    given = texts.sparkSession.sparkContext.broadcast((block, weight))
    spread = np.diff(block.starts)
    step = int(np.clip(CELLS // max(len(block.items), len(block.holders), 1), 1, 256))

    def run(batches):
        block, weight = given.value
        find, best = automaton(block.terms), _Best(len(block.items), top)
        for b in batches:
            for start in range(0, b.num_rows, step):
                part = b.slice(start, step)
                row, term, times, size = [], [], [], []
                for d, t in enumerate(part.column(1)):
                    text, n = bounded(t.as_py())
                    found = Counter(map(_number, find.iter(text)))
                    row += [d] * len(found)
                    term += found.keys()
                    times += found.values()
                    size.append(n)
                if not row:
                    continue
                row, term, times, size = (np.array(x, np.int64) for x in (row, term, times, size))
                length = 100 - 50 + (50 * size * docs) // terms
                part_score = weight[term] * ((1_000_000_000 * times) // (1000 * times + 20 * length[row]))
                count = spread[term]
                ends = np.cumsum(count)
                holder = block.holders[np.arange(int(ends[-1])) + np.repeat(block.starts[term] - (ends - count), count)]
                scores = np.zeros((part.num_rows, len(block.items)), np.int64)
                np.add.at(scores, (np.repeat(row, count), holder), np.repeat(part_score, count))
                ids = part.column(0)
                best.add(scores, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False))
        item, score, known, ids = best.best()
        for at in range(0, len(item), 100_000):
            cut = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(item[cut]), pa.array(score[cut]), pa.array(ids[cut], mask=~known[cut])], names=["n", "score", "__doc"])

    found = texts.mapInArrow(run, "n long, score long, __doc long")
    order = [F.desc("score"), F.asc_nulls_first("__doc")]
    salted = Window.partitionBy("n", F.pmod(F.xxhash64("__doc", "score"), F.lit(SALTS))).orderBy(*order)
    few = found.withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= top)
    ranks = few.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(*order))).filter(F.col("rank") <= top)
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("__item", item_type)])
    names = texts.sparkSession.createDataFrame(list(enumerate(block.items)), schema)
    out = materialize(ranks.join(names, "n").select("__item", "rank", "__doc", "score"), "ranked")
    given.destroy()
    return out


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_cost: int = BLOCK_COST,
) -> DataFrame:
    """``(item, rank, id, score)``: the ``top`` documents with a score above 0 for each item, best first,
    equal scores by ascending id.

    Scores are a length-normalised sum over the item's distinct terms, in whole numbers; see the module
    for the two scans. Null and empty texts have no terms and don't count as documents. Each row is
    a document, also one that repeats another; null ids take part and come first among equals. Rows of
    ``items`` with one id, null included, are one item. Items without terms, tables without rows
    and scores of 0 give no rows; other columns are ignored.
    """
    terms = items.select(F.col(item_col).alias("__item"), F.explode(_terms(F.col(item_text_col))).alias("term")).groupBy("__item")
    terms = materialize(terms.agg(F.sort_array(F.collect_set("term")).alias("terms")).orderBy("__item"), "items")
    texts = docs.select(F.col(id_col).cast("long").alias("__doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    kind = items.schema[item_col].dataType
    found = [_ranked(texts, b, kind, top) for b in blocks(terms, block_cost)]
    discard(terms)
    if not found:
        schema = T.StructType([T.StructField("__item", kind), T.StructField("rank", T.IntegerType()), T.StructField("__doc", T.LongType()), T.StructField("score", T.LongType())])
        found = [docs.sparkSession.createDataFrame([], schema)]
    return reduce(DataFrame.unionByName, found).withColumnsRenamed({"__item": item_col, "__doc": id_col})
