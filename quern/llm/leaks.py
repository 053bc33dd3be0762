"""Problem 8: texts of evaluation items inside documents.

A window's SimHash is the sign of the sum of its words' hashes, 64 bits. Two kinds of windows count:

* Passages: windows of WORDS words, the shortest that is a case. A case is equality, so the radius
  is 0: a window whose fingerprint is no item's is no case, and the others are compared by words.
* Whole items: every item is cut into windows of its own size (the largest of SIZES that it fills,
  overlapping by half). Documents' windows of that size within RADIUS bits are candidates: the bits
  are split into RADIUS + 2 blocks, of which two fingerprints within the radius agree in two, so the
  indexes over pairs of blocks find them all; the exact weighted similarity of their shingles decides.

Documents are read and tokenised once, whatever the number of items. Tasks hold a bitmap of the
passages' fingerprints (BITS bits, whatever their number) and the fingerprints of the items' own
windows, 16 bytes each; words meet in joins, the documents' side salted.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialize

WORDS, RADIUS, SHINGLE, SIMILAR = 13, 7, 5, 0.8
#: Sizes of the items' own windows.
SIZES = (13, 24, 48, 96, 192)
#: The bitmap has 1 << BITS bits; words hashed at once; parts into which documents with one passage are salted.
BITS, CHUNK, SALTS = 24, 1 << 16, 8

WORD = re.compile(r"[^\W_]+")
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
ODD = np.uint64(0x9E3779B97F4A7C15)


def masks(radius: int) -> list[np.uint64]:
    """Pairs of radius + 2 blocks of bits: two fingerprints within the radius agree in one of the pairs at least."""
    edges = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    block = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(radius + 2)]
    return [np.uint64(block[i] | block[j]) for i in range(len(block)) for j in range(i + 1, len(block))]


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case; invisible characters are removed, letters and their marks composed."""
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return WORD.findall(text.lower())


class WordBits(dict):
    """Numbers of rows of +1 and -1, 64 for each word seen; starts again when there are very many."""

    def __init__(self) -> None:
        self.rows = np.empty((4096, 64), np.int8)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        bits = np.unpackbits(np.array([xxhash.xxh64_intdigest(word)], np.uint64).view(np.uint8))
        self.rows[i] = bits.astype(np.int8) * 2 - 1
        return i

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def fingerprints(self, words: list[str], sizes: tuple[int, ...] = (WORDS,)) -> list[np.ndarray]:
        """Per size the SimHash of every window, as an array of len(words) - size + 1."""
        out = [np.empty(max(0, len(words) - w + 1), np.uint64) for w in sizes]
        kind = np.int8 if max(sizes) < 128 else np.int16  # sums wrap around, differences of a window don't
        for start in range(0, len(words), CHUNK):
            part = words[start : start + CHUNK + max(sizes) - 1]
            sums = np.zeros((len(part) + 1, 64), kind)
            ids = self.of(part)
            np.cumsum(self.rows[ids], axis=0, dtype=kind, out=sums[1:])
            for w, prints in zip(sizes, out, strict=True):
                n = min(len(prints) - start, CHUNK)
                if n > 0:
                    bits = (sums[w : w + n] - sums[:n]) > 0
                    prints[start : start + n] = np.packbits(bits, axis=1).view(np.uint64)[:, 0]
        return out


def slots(prints: np.ndarray) -> np.ndarray:
    return ((prints * ODD) >> np.uint64(64 - BITS)).astype(np.int64)


class NearIndex:
    """Fingerprints in one index per pair of blocks."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS) -> None:
        self.prints, self.radius, self.shift = prints, radius, np.uint64(44)
        self.parts = []
        for m in masks(radius):
            keys = prints & m
            table = np.zeros(1 << 20, bool)
            table[(keys * ODD) >> self.shift] = True
            order = np.argsort(keys)
            self.parts.append((m, table, keys[order], order))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in prints, number of an own fingerprint) within the radius, all of them."""
        if not len(self.prints) or not len(prints):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        left, right = [], []
        for m, table, keys, order in self.parts:
            own = prints & m
            hit = np.flatnonzero(table[(own * ODD) >> self.shift])
            lo, hi = np.searchsorted(keys, own[hit], "left"), np.searchsorted(keys, own[hit], "right")
            hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            a = np.repeat(hit, n)
            b = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            close = np.bitwise_count(prints[a] ^ self.prints[b]) <= self.radius
            left.append(a[close])
            right.append(b[close])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        return pairs[0], pairs[1]


def similarity(a: list[str], b: list[str]) -> float:
    """Weighted Jaccard similarity of the shingles of five words; a shingle weighs its letters."""
    if a == b:
        return 1.0
    one = {tuple(a[i : i + SHINGLE]) for i in range(len(a) - SHINGLE + 1)}
    two = {tuple(b[i : i + SHINGLE]) for i in range(len(b) - SHINGLE + 1)}
    weigh = lambda s: sum(len(w) for x in s for w in x)
    return weigh(one & two) / max(1, weigh(one | two))


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _texts(pdf: pd.DataFrame, at: int, step: int) -> tuple[list[str], np.ndarray]:
    """The words of some rows' texts one after the other, and where each text ends."""
    words: list[str] = []
    ends = []
    for t in pdf["text"].iloc[at : at + step]:
        words += words_of(t) if t else []
        ends.append(len(words))
    return words, np.array(ends, np.int64)


def item_passages(items: DataFrame) -> DataFrame:
    """(item_id, slot, passage): every passage of WORDS words of every item, once each."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = WordBits()
        for pdf in batches:
            for item, text in zip(pdf["item_id"], pdf["text"], strict=True):
                w = words_of(text)
                (prints,) = bits.fingerprints(w)
                if len(prints):
                    yield pd.DataFrame({"item_id": item, "slot": slots(prints), "passage": [" ".join(w[k : k + WORDS]) for k in range(len(prints))]})

    slim = items.select("item_id", "text").where("item_id is not null and text is not null")
    return slim.mapInPandas(cut, f"item_id {_kind(items, 'item_id')}, slot bigint, passage string").distinct()


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, passages) of documents that hold passages of items: how many different ones.

    Null, empty and short texts match nothing; rows with a repeated doc_id or item_id are taken
    together. A document's passage is compared with all items' passages whose fingerprint it has.
    """
    known = materialize(item_passages(items), "passages")
    bits = known.groupBy(F.shiftright("slot", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("b")).toPandas()  # at most 1 << (BITS - 5) rows
    bitmap = np.zeros(1 << (BITS - 5), np.uint32)
    bitmap[bits["w"].to_numpy(np.int64)] = bits["b"].to_numpy(np.int64).astype(np.uint32)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = WordBits()
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                words, ends = _texts(pdf, at, 500)
                (prints,) = own.fingerprints(words)
                slot = slots(prints)
                hit = np.flatnonzero((bitmap[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1))
                doc = np.searchsorted(ends, hit, "right")
                inside = hit + WORDS <= ends[doc] if len(hit) else np.empty(0, bool)
                if inside.any():
                    ids = pdf["doc_id"].iloc[at : at + 500].to_numpy()
                    yield pd.DataFrame({"doc_id": ids[doc[inside]], "passage": [" ".join(words[k : k + WORDS]) for k in hit[inside].tolist()]}).drop_duplicates()

    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    found = documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(search, f"doc_id {_kind(documents, 'doc_id')}, passage string").withColumn("_salt", salt)
    salted = known.select("item_id", "passage", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return found.join(salted, ["passage", "_salt"]).groupBy("doc_id", "item_id").agg(F.count_distinct("passage").alias("passages"))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, size, print, words): the windows of an item's own size, each starting half a window after the other, and the last."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = WordBits()
        for pdf in batches:
            for item, text in zip(pdf["item_id"], pdf["text"], strict=True):
                w = words_of(text)
                size = max((s for s in SIZES if s <= len(w)), default=0)
                if size:
                    last = len(w) - size
                    at = sorted({*range(0, last + 1, max(1, size // 2)), last})
                    (prints,) = bits.fingerprints(w, (size,))
                    yield pd.DataFrame({"item_id": item, "size": size, "print": prints[at].view(np.int64), "words": [" ".join(w[k : k + size]) for k in at]})

    slim = items.select("item_id", "text").where("item_id is not null and text is not null")
    return slim.mapInPandas(cut, f"item_id {_kind(items, 'item_id')}, size int, print bigint, words string").distinct()


def near_copies(documents: DataFrame, items: DataFrame, least: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity): documents that nearly hold a window of the item's own size, and the best similarity.

    Recall against comparing all windows: at least 0.9 (tests and README). The items' fingerprints
    go to every task, 16 bytes a window: a gigabyte of item texts is about 100 MB.
    """
    known = materialize(item_windows(items), "windows")
    prints = known.select("size", "print").distinct().toPandas()
    sizes = tuple(sorted(int(s) for s in prints["size"].unique()))
    of = {s: np.sort(prints["print"][prints["size"] == s].to_numpy(np.int64).view(np.uint64)) for s in sizes}

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, index = WordBits(), {s: NearIndex(p, radius) for s, p in of.items()}
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                words, ends = _texts(pdf, at, 500)
                ids = pdf["doc_id"].iloc[at : at + 500].to_numpy()
                for size, windows in zip(sizes, own.fingerprints(words, sizes), strict=True):
                    hit, which = index[size].near(windows)
                    doc = np.searchsorted(ends, hit, "right")
                    inside = hit + size <= ends[doc] if len(hit) else np.empty(0, bool)
                    if inside.any():
                        rows = pd.DataFrame({"doc_id": ids[doc[inside]], "size": size, "print": of[size][which[inside]].view(np.int64), "own": [" ".join(words[k : k + size]) for k in hit[inside].tolist()]})
                        yield rows.drop_duplicates()

    if not sizes:
        return documents.sparkSession.createDataFrame([], f"doc_id {_kind(documents, 'doc_id')}, item_id {_kind(items, 'item_id')}, similarity double")

    @F.pandas_udf("double")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x.split(" "), y.split(" ")) for x, y in zip(a, b, strict=True)], dtype="float64")

    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    found = documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(search, f"doc_id {_kind(documents, 'doc_id')}, size int, print bigint, own string").withColumn("_salt", salt)
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    scored = found.join(salted, ["size", "print", "_salt"]).select("doc_id", "item_id", similar("own", "words").alias("similarity"))
    return scored.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity")).where(F.col("similarity") >= least)


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id")


def report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, source, documents, passages, near, similarity): where items leaked.

    documents: those that hold passages or nearly the item; passages: the sum over documents; near:
    documents with a window similar to the item's own; similarity: the best (null without any).
    """
    both = leaks(documents, items).join(near_copies(documents, items), ["doc_id", "item_id"], "full")
    docs = documents.groupBy("doc_id").agg(F.min(F.lower(F.trim("source"))).alias("source"))
    zero = F.lit(0).cast("bigint")
    return both.join(docs, "doc_id").groupBy("item_id", "source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce("passages", zero)).alias("passages"), F.count("similarity").alias("near"), F.max("similarity").alias("similarity"))
