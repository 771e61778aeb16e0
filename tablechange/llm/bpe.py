"""BPE encoding and decoding with a pair occurrence index.

A vocabulary file of the ``tokenizers`` library (BPE over bytes, with an end-of-word suffix) gives
the merges. Within a partition, the words not seen before are laid out as one chain of symbols. An
index maps each mergeable pair to all its positions in that chain; the active ranks are applied in
ascending order, each at all its positions at once, and only the lists of the neighbouring pairs
change. Encoded words are kept, so a word of the partition is merged once, however often it occurs.

Memory: texts are taken in slices of about ``slice_bytes`` characters, and the kept words are
dropped once they pass ``_KEEP_WORDS`` or ``_KEEP_CHARS``; the result does not depend on that. Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablechange.llm.memory import tidy

_KEEP_WORDS, _KEEP_CHARS = 400_000, 32 << 20
SLICE_CHARS = 1 << 20
# Fixed values of the vocabulary's pre-tokenizer.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACES = regex.compile(r"\s+")
# Python's split() takes these for white space, the pre-tokenizer does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: Latin-1 letters and signs stand
    for themselves, the others take the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def lower_each(text: str) -> str:
    """Lower case letter by letter: a capital sigma does not depend on its place in the word."""
    return text.replace("Σ", "σ").lower()


class _Assigned(dict):
    """Each code point that was asked for and what stands for it."""

    def __missing__(self, c: int) -> int:
        out = self[c] = 0xE000 if unicodedata.category(chr(c)) == "Cn" else c
        return out


_ASSIGNED = _Assigned()


def assigned(text: str) -> str:
    """Code points without a meaning in Python's Unicode tables stand as private ones, so that a
    newer table of the ``regex`` library does not take them for letters."""
    return text.translate(_ASSIGNED)


class PairIndexBPE:
    """Encodes words and decodes ids by the content of a vocabulary file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.token = {i: t for t, i in [*vocab.items(), *self.added.items()]}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        # one number object per id: the kept words share them
        self.numbers = np.arange(max(self.token) + 1).astype(object)
        self.merges = []
        self.rank = {}
        for a, b in model["merges"]:
            pair = (vocab[a], vocab[b])
            self.rank[pair] = len(self.merges)
            self.merges.append((*pair, vocab[a + b]))
        pairs = np.array([(a << 32) | b for a, b, _ in self.merges] or [-2], np.int64)
        self.pair_ranks = np.argsort(pairs)
        self.pair_keys = pairs[self.pair_ranks]
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None

    def pieces(self, chunk: str) -> list[str | int]:
        """The words of a chunk without white space, in order; ids for added tokens."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        out: list[str | int] = []
        for part in self.split_added.split(chunk) if self.split_added and "<" in chunk else (chunk,):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                part = lower_each(unicodedata.normalize("NFC", part))
                out += [part[m.start() : m.end()] for m in WORDS.finditer(assigned(part))] if not part.isascii() else WORDS.findall(part)
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, merged over one index of all pair occurrences."""
        if not words:
            return []
        rank, raw = self.rank, [w.encode("utf-8", "replace") for w in words]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        starts = np.concatenate([[0], ends[:-1]])
        joined = np.frombuffer(b"".join(raw), np.uint8)
        codes, n = self.inner[joined], len(joined)
        codes[ends - 1] = self.last[joined[ends - 1]]
        where = self._occurrences(codes, starts)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = before[starts] = -1
        symbols, after, before = codes.tolist(), after.tolist(), before.tolist()
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            left, right, merged = self.merges[r]
            positions = where.pop(r)
            positions.sort()
            for i in positions:
                j = after[i]
                if symbols[i] != left or j < 0 or symbols[j] != right:
                    continue
                symbols[i], symbols[j] = merged, -1
                k, h = after[j], before[i]
                after[i] = k
                if k >= 0:
                    before[k] = i
                    q = rank.get((merged, symbols[k]))
                    if q is not None:
                        if q in where:
                            where[q].append(i)
                        else:
                            where[q] = [i]
                            heapq.heappush(active, q)
                if h >= 0:
                    q = rank.get((symbols[h], merged))
                    if q is not None:
                        if q in where:
                            where[q].append(h)
                        else:
                            where[q] = [h]
                            heapq.heappush(active, q)
        codes = np.array(symbols, np.int64)
        left = np.concatenate([[0], np.cumsum(codes >= 0)])
        bounds, kept = left[ends].tolist(), self.numbers[codes[codes >= 0]].tolist()
        return [kept[a:b] for a, b in zip([0, *bounds], bounds)]

    def _occurrences(self, symbols: np.ndarray, starts: np.ndarray) -> dict[int, list[int]]:
        """The positions of each mergeable pair of the chain, in order, by the pair's rank."""
        if len(symbols) < 2:
            return {}
        keys = (symbols[:-1] << 32) | symbols[1:]
        keys[starts[1:] - 1] = -1  # the last symbol of a word has no partner
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = np.flatnonzero(self.pair_keys[at] == keys)
        ranks = self.pair_ranks[at[found]]
        order = np.argsort(ranks, kind="stable")
        found, ranks = found[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        heads = ranks[np.concatenate([[0], cuts])].tolist() if len(ranks) else []
        return {r: part.tolist() for r, part in zip(heads, np.split(found, cuts))}

    def decode(self, ids) -> str:
        """The tokens joined by single spaces, as vocabularies without a decoder are read."""
        return " ".join([self.token[i] for i in ids if i in self.token])


class _Numbers(dict):
    """Numbers its keys in the order of their first use."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


class _Encoder:
    """What a partition keeps between slices: a number per chunk, and ids and tokens per number."""

    def __init__(self, bpe: PairIndexBPE):
        self.bpe = bpe
        self.clear()

    def clear(self) -> None:
        self.number, self.known, self.chars = _Numbers(), {}, 0
        self.ids, self.start, self.length, self.text = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), []

    def learn(self) -> None:
        fresh, self.number.fresh = self.number.fresh, []
        pieces = [(c.lower(),) if c.isascii() and c.isalpha() else self.bpe.pieces(c) for c in fresh]
        known = self.known
        words = list({p for ps in pieces for p in ps if p not in known and isinstance(p, str)})
        known.update(zip(words, self.bpe.encode_words(words)))
        lists = [known[ps[0]] if len(ps) == 1 and isinstance(ps[0], str) else [i for p in ps for i in (known[p] if isinstance(p, str) else (p,))] for ps in pieces]
        self.chars += sum(map(len, fresh))
        self.text += [self.bpe.decode(x) for x in lists]
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.int32)])

    def slice(self, texts: list[str | None], decoded: bool) -> tuple[pa.Array, pa.Array | None]:
        rows = []
        for t in texts:
            t = t or ""
            chunks = SPACES.split(t) if any(c in t for c in SEPARATORS) else t.split()
            rows.append([self.number[c] for c in chunks if c] if chunks and not (chunks[0] and chunks[-1]) else list(map(self.number.__getitem__, chunks)))
        if self.number.fresh:
            self.learn()
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        every = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
        counts = self.length[every]
        ends = np.cumsum(counts)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[every] - (ends - counts), counts)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(self.ids[take]))
        text = pa.array([" ".join(map(self.text.__getitem__, r)) for r in rows], pa.string()) if decoded else None
        if len(self.number) > _KEEP_WORDS or self.chars > _KEEP_CHARS:
            self.clear()
        return ids, text


def read_vocabulary(spark: SparkSession, path: str):
    """A broadcast variable with the content of the vocabulary file (a few MB, whatever the corpus)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``most`` bytes of the column each."""
    texts = batch.column(column)
    sizes = np.array([0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()], np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        held += int(n)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def bpe_encode(
    docs: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with the token ids of each whole text (``array<int>``), and on demand their decoding.
    Of the columns of ``docs`` only those named in ``keep`` stay, if it is given; a text that does
    not stay goes to the encoder once and does not come back.

    ``vocabulary`` is the path of the file; its content is broadcast. Null and empty texts have no
    ids and decode to the empty text. Columns of ``docs`` stay as they are; one that has the name
    of a result is replaced. An empty table gives no rows. Strings of added tokens in a text become
    those tokens, as in the library the file is made for.
    """
    content = read_vocabulary(docs.sparkSession, vocabulary)
    new = [out_col] + ([decoded_col] if decoded_col else [])
    kept = [f for f in docs.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    result = T.StructType([*kept, T.StructField(out_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded_col, T.StringType())] if decoded_col else []))

    def encode(batches):
        state = _Encoder(PairIndexBPE(content.value))
        for b in batches:
            for start, stop in _slices(b, b.num_columns - 1, SLICE_CHARS):
                part = b.slice(start, stop - start)
                ids, text = state.slice(part.column(part.num_columns - 1).to_pylist(), decoded_col is not None)
                columns = [*part.columns[:-1], ids] + ([text] if decoded_col else [])
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in result.fields])

    return source.mapInArrow(tidy(encode), result)


def bpe_decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text of each id list; unknown ids are left out, null lists are empty."""
    content = read_vocabulary(tokens.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def decoded(lists):
        bpe = PairIndexBPE(content.value)
        return lists.map(lambda ids: bpe.decode([] if ids is None else ids))

    return tokens.withColumn(out_col, decoded(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))
