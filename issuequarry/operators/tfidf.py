"""Bounded TF-IDF in long form: (key, block, term, weight), L2-normed by row and block.

weight = tf' * (ln((1 + N) / (1 + df)) + 1), with tf' = 1 + ln tf, or tf itself without sublinear_tf; terms with df in [min_df, max_df] (a whole number is a count, a
fraction a share of N), of these the max_features most frequent (ties by term). Texts are shuffled by key, which is less than their terms. Two passes cut them into terms: the first
sends each term once a task, with its numbers of rows and uses; the second gets the vocabulary (max_features terms a block at most) and counts, weights and norms in place.
In both, terms are numbers, and a row's uses of a term are found by sorting (row, term) as one number. Words are cut once a task.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping
from dataclasses import asdict, dataclass, fields
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuequarry.functions.text import SPACE
from issuequarry.session import Scratch

TOKEN = r"[\p{L}\p{N}_]{2,}"
# Bytes of words that are counted at once, terms (or grams of known words) that a task holds, and rows handed to the JVM at once.
CHUNK, HELD, OUT = 1 << 20, 1_000_000, 1 << 16


# Names and defaults of the settings in model files.
@dataclass(frozen=True)
class TfidfConfig:
    """Settings by their names in model files. Keys of other parts of a file are left to those; as_dict gives every setting."""

    feature_mode: str = "word_char"
    word_ngram_range: tuple[int, int] = (1, 2)
    word_max_features: int = 200_000
    word_min_df: int | float = 3
    word_max_df: int | float = 0.98
    char_ngram_range: tuple[int, int] = (3, 5)
    char_max_features: int = 150_000
    char_min_df: int | float = 5
    char_max_df: int | float = 0.98
    sublinear_tf: bool = True

    def __post_init__(self) -> None:
        if self.feature_mode not in ("word", "word_char"):
            raise ValueError("feature_mode must be word or word_char")
        if min(self.word_max_features, self.char_max_features) <= 0:
            raise ValueError("max_features must be positive")
        for low, high in (self.word_ngram_range, self.char_ngram_range):
            if not 1 <= low <= high:
                raise ValueError("an n-gram range needs 1 <= low <= high")

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any] | None) -> TfidfConfig:
        own = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if k.endswith("_range") else v for k, v in (values or {}).items() if k in own})

    def as_dict(self) -> dict:
        return asdict(self)


def tokens(text: Column) -> Column:
    """Words of two or more characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def pieces(text: Column) -> Column:
    """What lies between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{SPACE}+"), lambda x: x != "")


def word_terms(text: Column, low: int = 1, high: int = 2) -> Column:
    """Words of two or more characters and their n-grams."""
    w = tokens(text)
    grams, shifted = [], w
    for n in range(1, high + 1):
        if n > 1:  # no computed array inside a lambda: it would be computed for every element
            shifted = F.zip_with(F.slice(shifted, 1, F.greatest(F.size(shifted) - 1, F.lit(0))), F.slice(w, n, F.greatest(F.size(w) - n + 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= low:
            grams.append(shifted)
    return F.concat(*grams)


def term_counts(df: DataFrame, key: str, terms: Column) -> DataFrame:
    return df.repartition(key).select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def char_counts(df: DataFrame, key: str, text: str, low: int = 3, high: int = 5) -> DataFrame:
    """n-grams inside words with a space at either end; they are cut once for each distinct word of a row. A word shorter than n is one n-gram as it is, once."""
    w = df.repartition(key).select(key, F.explode(pieces(F.col(text))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("m")).withColumn("w", F.concat(F.lit(" "), "w", F.lit(" ")))
    lens = F.array(*[F.lit(n) for n in range(low, high + 1)])
    cut = w.select(key, "m", "w", F.explode(lens).alias("n")).filter(f"n = {low} OR n <= length(w)")
    grams = cut.select(key, "m", F.explode(F.expr("transform(sequence(1, greatest(length(w) - n, 0) + 1), i -> substring(w, i, n))")).alias("term"))
    return grams.groupBy(key, "term").agg(F.sum("m").alias("tf"))


def vocabulary(counts: DataFrame, rows: int, min_df: int | float, max_df: int | float, max_features: int) -> DataFrame:
    """(term, df, tf) of the kept terms."""
    return _most_used(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")), rows, min_df, max_df, max_features)


def _most_used(v: DataFrame, rows: int, min_df: int | float, max_df: int | float, max_features: int) -> DataFrame:
    bound = lambda x: x * rows if isinstance(x, float) else x
    return v.filter((F.col("df") >= bound(min_df)) & (F.col("df") <= bound(max_df))).orderBy(F.desc("tf"), "term").limit(max_features)


class _WordTerms:
    """Word n-grams as numbers. `number` maps a list of terms to their numbers, -1 for a term to be left out."""

    def __init__(self, low: int, high: int, number: Callable[[list[str]], list[int]]):
        self.low, self.high, self.number = low, high, number

    def __call__(self, words: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each use of a term the word it begins with, and the number. row: the text of each word."""
        d = words.dictionary_encode()
        w, names = d.indices.to_numpy().astype(np.int64), d.dictionary.to_pylist()
        first, code, terms, at, which = np.arange(len(w)), w, names, [], []
        for n in range(1, self.high + 1):
            if n > 1:  # a term of n - 1 words, and the word behind it
                ok = first + n - 1 < len(w)
                ok[ok] = row[first[ok]] == row[first[ok] + n - 1]
                first, code = first[ok], code[ok]
                pairs, code = np.unique(code * len(names) + w[first + n - 1], return_inverse=True)
                left, right = np.divmod(pairs, max(len(names), 1))
                terms = [f"{terms[a]} {names[b]}" for a, b in zip(left.tolist(), right.tolist(), strict=True)]
            if n >= self.low:
                known = np.array(self.number(terms), np.int64)[code]
                at.append(first[known >= 0])
                which.append(known[known >= 0])
        return np.concatenate(at), np.concatenate(which)


class _CharTerms:
    """n-grams inside words with a space at either end, as numbers; a word's are kept for its next use."""

    def __init__(self, low: int, high: int, number: Callable[[list[str]], list[int]]):
        self.low, self.high, self.number = low, high, number
        self.clear()

    def clear(self) -> None:
        self.known, self.grams, self.ends = {}, array("i"), array("q", [0])

    def cut(self, word: str) -> list[str]:
        w = f" {word} "
        return [w[i : i + n] for n in range(self.low, self.high + 1) if n == self.low or n <= len(w) for i in range(max(len(w) - n, 0) + 1)]

    def __call__(self, words: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.grams) > 4 * HELD:
            self.clear()
        d = words.dictionary_encode()
        places = []
        for w in d.dictionary.to_pylist():
            if (k := self.known.get(w)) is None:
                k = self.known[w] = len(self.known)
                self.grams.extend([x for x in self.number(self.cut(w)) if x >= 0])
                self.ends.append(len(self.grams))
            places.append(k)
        ends, grams = np.array(self.ends), np.array(self.grams, np.int32)
        k = np.array(places, np.int64)[d.indices.to_numpy()]
        n = ends[k + 1] - ends[k]
        shift = ends[k] - (np.cumsum(n) - n)
        return np.repeat(np.arange(len(k)), n), grams[np.arange(n.sum()) + np.repeat(shift, n)]


def _chunks(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[pa.Array, np.ndarray, np.ndarray]]]]:
    """Keys (with further columns), and for each of the last `blocks` columns, which are word lists: its words, the text of each, and the key's place of each.

    A chunk has some CHUNK bytes of words and ends where a key does; a key's rows lie together."""
    held = None
    for b in _ended(batches):
        if b is not None:
            held = b if held is None else pa.concat_batches([held, b])
        if held is None or not held.num_rows:
            continue
        first = np.flatnonzero(np.diff(held.column(0).dictionary_encode("encode").indices.to_numpy(), prepend=-1))
        size = np.zeros(held.num_rows + 1, np.int64)
        for c in held.columns[-blocks:]:
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(c.flatten()).to_numpy(zero_copy_only=False).astype(np.int64))])
            size[1:] += ends[np.cumsum(pc.list_value_length(c).to_numpy(zero_copy_only=False))]
        i, bounds = 0, np.append(first, held.num_rows)
        last = len(first) - (b is not None)  # the last key may go on in the next batch
        while i < last:
            j = min(max(int(np.searchsorted(size[bounds], size[bounds[i]] + CHUNK)), i + 1), last)
            if j == last and b is not None and size[bounds[j]] < size[bounds[i]] + CHUNK:
                break
            part = held.slice(bounds[i], bounds[j] - bounds[i])
            key = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
            out = []
            for c in part.columns[-blocks:]:
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(c).to_numpy(zero_copy_only=False))
                out.append((c.flatten(), row, key[row]))
            yield part.select(range(part.num_columns - blocks)).take(pa.array(bounds[i:j] - bounds[i])), out
            i = j
        held = held.slice(bounds[i])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _uses(key: np.ndarray, term: np.ndarray, keys: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, term, uses), sorted, of all uses."""
    kind = np.uint32 if keys * terms < 1 << 32 else np.uint64
    x = key.astype(kind) * kind(terms) + term.astype(kind)
    x.sort()
    at = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))
    k, t = np.divmod(x[at], kind(max(terms, 1)))
    return k.astype(np.int64), t.astype(np.int64), np.diff(np.append(at, len(x)))


def block_names(config: TfidfConfig) -> list[str]:
    return ["word", "char"][: 1 + (config.feature_mode == "word_char")]


def _cutter(config: TfidfConfig, block: str, number: Callable[[list[str]], list[int]]) -> _WordTerms | _CharTerms:
    return _WordTerms(*config.word_ngram_range, number) if block == "word" else _CharTerms(*config.char_ngram_range, number)


def _words(df: DataFrame, key: str, text: str, blocks: list[str], *more: str) -> DataFrame:
    """(key, more, words of each block); the rows of a key lie together."""
    cut = {"word": tokens, "char": pieces}
    return df.select(key, *more, text).repartition(key).sortWithinPartitions(key).select(key, *more, *[cut[b](F.col(text)).alias(b) for b in blocks])


def vocabularies(df: DataFrame, key: str, text: str, rows: int, config: TfidfConfig, blocks: list[str] | None = None) -> dict[str, pa.Table]:
    """(term, df, tf) of the kept terms of each block, on the driver: max_features rows a block at most."""
    blocks = blocks or block_names(config)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: list[dict[str, int]] = [defaultdict() for _ in blocks]
        for x in index:
            x.default_factory = x.__len__
        cutters = [_cutter(config, b, lambda terms, x=x: [x[t] for t in terms]) for b, x in zip(blocks, index, strict=True)]
        found = [np.zeros((2, 0), np.int64) for _ in blocks]

        def told(i: int) -> Iterator[pa.RecordBatch]:
            terms = pa.array(list(index[i]), pa.string())
            b = pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), i, np.int8)), terms, *map(pa.array, found[i])], ["block", "term", "df", "tf"])
            for j in range(0, len(terms), OUT):
                yield b.slice(j, OUT)

        for keys, columns in _chunks(batches, len(blocks)):
            for i, (words, row, key_of) in enumerate(columns):
                at, term = cutters[i](words, row)
                n = len(index[i])
                _, once, _ = _uses(key_of[at], term, keys.num_rows, n)
                now = np.array([np.bincount(once, minlength=n), np.bincount(term, minlength=n)])
                now[:, : found[i].shape[1]] += found[i]
                found[i] = now
                if n > HELD:
                    yield from told(i)
                    index[i].clear()
                    found[i] = np.zeros((2, 0), np.int64)
                    if blocks[i] == "char":
                        cutters[i].clear()
        for i in range(len(blocks)):
            yield from told(i)

    c, scratch = config.as_dict(), Scratch(df.sparkSession, "tfidf-terms")
    v = _words(df, key, text, blocks).mapInArrow(work, "block byte, term string, df long, tf long").groupBy("block", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    least = min([x * rows if isinstance(x, float) else x for x in (c[f"{b}_min_df"] for b in blocks)])
    kept = scratch.keep(v.filter(F.col("df") >= least))
    try:
        return {b: _most_used(kept.filter(F.col("block") == i).select("term", "df", "tf"), rows, *[c[f"{b}_{x}"] for x in ("min_df", "max_df", "max_features")]).toArrow() for i, b in enumerate(blocks)}
    finally:
        scratch.drop(kept)


def idf(df: np.ndarray, rows: int) -> np.ndarray:
    return np.log((1.0 + rows) / (1 + df)) + 1


def weighed(df: DataFrame, key: str, text: str, config: TfidfConfig, terms: Mapping[str, tuple[pa.Array, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    """What a task runs over _words: for each chunk its keys, and (key's place, term's place, weight, uses, norms of the keys) of each block of terms (block: terms and their idf)."""
    sent = df.sparkSession.sparkContext.broadcast({b: (t.to_pylist(), x) for b, (t, x) in terms.items()})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        cutters = []
        for b, (names, x) in sent.value.items():
            place = {t: i for i, t in enumerate(names)}
            cutters.append((_cutter(config, b, lambda t, p=place: [p.get(x, -1) for x in t]), x))
        for keys, columns in _chunks(batches, len(cutters)):
            out = []
            for (cutter, x), (words, row, key_of) in zip(cutters, columns, strict=True):
                at, term = cutter(words, row)
                k, term, n = _uses(key_of[at], term, keys.num_rows, len(x))
                w = (1 + np.log(n) if config.sublinear_tf else n) * x[term]
                norm = np.sqrt(np.bincount(k, w * w, keys.num_rows))
                out.append((k, term, w / norm[k], n, norm))
            yield keys, out

    return work


def vectors(df: DataFrame, key: str, text: str, config: TfidfConfig, terms: Mapping[str, tuple[pa.Array, np.ndarray]], *more: str) -> DataFrame:
    """(key, more, features): of each key the weights of all blocks as one sparse row, numbered in the order of `terms`. The stored layout is that of Spark's vectors."""
    size, weigh = sum(len(x) for _, x in terms.values()), weighed(df, key, text, config, terms)
    starts = np.cumsum([0] + [len(x) for _, x in terms.values()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, found in weigh(batches):
            k, i, w = (np.concatenate(x) for x in zip(*[(k, (t + s).astype(np.int32), w) for (k, t, w, *_), s in zip(found, starts, strict=False)], strict=True))
            order, ends = np.argsort(k, kind="stable"), pa.array(np.concatenate([[0], np.cumsum(np.bincount(k, minlength=keys.num_rows))]).astype(np.int32))
            parts = [pa.array(np.zeros(keys.num_rows, np.int8)), pa.array(np.full(keys.num_rows, size, np.int32)), *[pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (i, w)]]
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])], [key, *more, "features"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *more))
    return _words(df, key, text, list(terms), *more).mapInArrow(work, f"{kinds}, features struct<type: byte, size: int, indices: array<int>, values: array<double>>")


def tfidf(df: DataFrame, key: str, text: str, config: TfidfConfig, blocks: list[str] | None = None) -> DataFrame:
    """(key, block, term, weight) of the word block and, in mode word_char, the character block; or of `blocks` only. The rows of df are counted and the vocabulary is found at once (some jobs)."""
    blocks, rows = blocks or block_names(config), df.count()
    vocab = vocabularies(df, key, text, rows, config, blocks)
    names = df.sparkSession.sparkContext.broadcast([vocab[b]["term"].combine_chunks() for b in blocks])
    weigh = weighed(df, key, text, config, {b: (vocab[b]["term"].combine_chunks(), idf(vocab[b]["df"].to_numpy(), rows)) for b in blocks})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, found in weigh(batches):
            for i, (k, term, w, *_) in enumerate(found):
                for j in range(0, len(k), OUT):
                    n = len(k[j : j + OUT])
                    yield pa.RecordBatch.from_arrays([keys.column(0).take(pa.array(k[j : j + OUT])), pa.array(np.full(n, i, np.int8)), names.value[i].take(pa.array(term[j : j + OUT])), pa.array(w[j : j + OUT])], [key, "block", "term", "weight"])

    kind = df.schema[key].dataType.simpleString()
    out = _words(df, key, text, blocks).mapInArrow(work, f"`{key}` {kind}, block byte, term string, weight double")
    name = F.lit(blocks[0]) if len(blocks) == 1 else F.when(F.col("block") == 0, blocks[0]).otherwise(blocks[1])
    return out.select(key, name.alias("block"), "term", "weight")


def matrix_bytes(weighted: DataFrame, key: str) -> DataFrame:
    """(rows, nnz, bytes) of the compressed sparse row matrix in float32 with int32 indices. A table that isn't in long form (a row a weight) is refused."""
    if "weight" not in weighted.columns or dict(weighted.dtypes)["weight"] not in ("double", "float"):
        raise TypeError("a sparse table of weights is needed, not a dense one")
    per = weighted.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("nnz")).select("rows", "nnz", (F.col("nnz") * 8 + (F.col("rows") + 1) * 4).alias("bytes"))
