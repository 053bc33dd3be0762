"""Problem 10: keyword-stuffed and link-list pages, by word association from corpus counts.

1. Documents are spread over blocks of bounded size by hash. Every block counts its words and pairs
   of neighbouring words; all blocks' counts are added up over the whole corpus. Every distinct text
   counts once, in the first block that has it: copies of a page don't make its phrases common.
2. Each block gets back the totals of its own words and pairs where they differ from its counts.
3. Per document, pointwise mutual information of neighbours is averaged over a sliding window: a
   window far below coherent text is word salad. A pair that comes two or three times within a span,
   and much more often than the corpus leads one to expect there, is a collocation repeated to
   excess. Both marks come from corpus counts alone; words inside links, markup tags and hash tags
   are marked as well. Documents less than half of whose letters are marked are through.
4. An exact check follows on the others. It only takes marks away: lines of logs, diffs and code are
   no stuffing however much they repeat, and sentences written to be read need denser repetition.
   A document is found if the marks left make up more than half of its letters.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialize

#: Letters per block; words in the window of mean association; its threshold in nats.
BLOCK, WINDOW, SALAD = 5_000_000, 24, 1.2
#: A collocation is excessive if TIMES of it lie within SPAN words and are EXCESS times as many as expected.
TIMES, SPAN, EXCESS = 3, 50, 8.0
#: The same outside written sentences, in lists.
TIMES_LISTED, SPAN_LISTED = 2, 120
#: A sentence counts as written up to so many repetitions of its pairs in the document.
REPEATED = 2 * TIMES
SHARE = 0.5

WORD = re.compile(r"[^\W_]+")
# every branch begins with its own sign, so that the search skips to one; what may stand before it is looked up behind it
LINK = re.compile(r"(<[^<>\n]+>|h(?<!\wh)ttps?://[^\s<>\"')\]]+|f(?<!\wf)tp://[^\s<>\"')\]]+|w(?<!\ww)ww\.[^\s<>\"')\]]+|#(?<!\S#)[^\W\d_][\w-]*|\[(?<!\S\[)\[?[^\[\]\n]+\]\]?\([^()\s]*\))")
#: Lines that are log or diff output: a time stamp, a level, a diff marker.
OUTPUT = re.compile(r"\s*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\s*\[?\d\d:\d\d:\d\d\b|\s*\[?(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)\b|diff --git |index [0-9a-f]{7,}|@@ |(?:\+\+\+|---) ")
#: Indented or added and removed statements, and what one must still have when its line had links, tags or entities:
#: a brace, an assignment, a call, a semicolon at the end, a quoted or plain key, a comment sign. A bullet is no minus sign.
CODE = re.compile(r"(?:[+-](?: {2,}|\t)|(?: {4,}|\t))\S.*[;:{}()=]|[+-](?: {2,}|\t)\s*(?:#|//)\s")
CODE_LEFT = re.compile(r"[+-]?\s+(?:#\s|//|/\*|[-\s]*[a-z_][\w.-]*:(?:\s|$)|.*(?:[{}=]|\w\(|;\s*$|[\"']:))")
ENTITY = re.compile(r"&#?\w+;")
SENTENCE = re.compile(r"(?<=[.!?…])\s+")
SEPARATOR = re.compile(r"[,;:>|/()•·*#=–—]|(?<=\s)-(?=\s)")
#: A written sentence has at least so many words, so varied, and so few separators a word.
LEAST, VARIED, LISTED = 5, 0.7, 0.25
EXEMPT, PLAIN, LINKED, WRITTEN = 0, 1, 2, 3
#: Letters read at once.
CHUNK = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def may_link(text: str) -> bool:
    return "://" in text or "#" in text or "<" in text or "www." in text or "](" in text


def is_code(line: str, linked: bool) -> bool:
    """If the line is an indented or changed statement; links, tags and entities in it don't count."""
    if not CODE.match(line):
        return False
    if not linked and "&" not in line:
        return True
    rest = ENTITY.sub("", LINK.sub("", line) if linked else line)
    return rest == line or bool(CODE_LEFT.match(rest))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well spread bits for each number."""
    x = x.astype(np.uint64) * MIX
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Letters:
    """Tables over code points below 1 << 16 (others are asked for one by one), and powers of an odd base and of its inverse."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        points = [chr(i) for i in range(1 << 16)]
        self.word = np.array([c.isalnum() for c in points])
        self.digit = np.array([c.isdecimal() for c in points])
        self.value = _mixed(np.array([ord(c.lower()[0]) for c in points]))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(self.BASE, -1, 1 << 64)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, f, np.uint64)])) for f in (self.BASE, inverse))
        return self.up, self.down

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of the runs of letters and digits; letter case doesn't matter, numbers are one class.

        A word's hash is a polynomial over its letters' values, taken from running sums modulo 1 << 64.
        """
        point = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        low = np.minimum(point, np.uint32(0xFFFF))
        word, digit, value = self.word[low], self.digit[low], self.value[low]
        high = np.flatnonzero(point > 0xFFFF)
        if len(high):
            own = [chr(i) for i in point[high].tolist()]
            word[high], digit[high] = [c.isalnum() for c in own], [c.isdecimal() for c in own]
            value[high] = _mixed(np.array([ord(c.lower()[0]) for c in own]))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        up, down = self.powers(len(point))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[: len(point)])])
        digits = np.concatenate([np.zeros(1, np.int32), np.cumsum(digit, dtype=np.int32)])
        number = digits[end] - digits[start] == end - start
        return start, end, np.where(number, np.uint64(0x30), _mixed((sums[end] - sums[start]) * down[start]))


_LETTERS: list[Letters] = []


def letters() -> Letters:
    if not _LETTERS:
        _LETTERS.append(Letters())
    return _LETTERS[0]


def marked_words(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words in order; the number of words and the mark of each segment (sentence, line or link)."""
    words: list[str] = []
    counts: list[int] = []
    marks: list[int] = []
    diff = False
    for line in text.split("\n"):
        if not line:
            diff = False
            continue
        diff = line.startswith(("diff --git ", "@@ ")) or (diff and line.startswith((" ", "+", "-", "@")))
        linked = may_link(line)
        if diff or OUTPUT.match(line) or is_code(line, linked):
            own = WORD.findall(line.lower())
            words += own
            counts.append(len(own))
            marks.append(EXEMPT)
            continue
        for k, part in enumerate(LINK.split(line) if linked else (line,)):
            if k % 2:
                own = WORD.findall(part.lower())
                words += own
                counts.append(len(own))
                marks.append(LINKED)
                continue
            for sentence in SENTENCE.split(part):
                own = WORD.findall(sentence.lower())
                n = len(own)
                if n:
                    words += own
                    counts.append(n)
                    marks.append(WRITTEN if n >= LEAST and len(set(own)) >= VARIED * n and len(SEPARATOR.findall(sentence)) <= LISTED * n else PLAIN)
    return words, counts, marks


class Block:
    """The words of some documents as arrays: hash, document, length, mark and segment, and their pairs.

    marked: segments and marks as marked_words tells them; otherwise links are the only words told
    apart. Texts are read together until they have CHUNK letters, a longer one by itself.
    """

    def __init__(self, texts: list[str | None], marked: bool = True) -> None:
        read, parts, marks, links = [], [], [], []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size < CHUNK or end == at):
                size += len(texts[end] or "") + 1
                end += 1
            some = [t or "" for t in texts[at:end]]
            joined = "\n".join(some)
            start, stop, h = letters().words(joined)
            bounds = np.cumsum([0] + [len(t) + 1 for t in some])
            read.append((np.searchsorted(bounds, start, "right") - 1 + at, stop - start, h))
            if marked:
                for t in some:
                    _, sizes, own = marked_words(t)
                    parts += sizes
                    marks += own
            else:
                link = np.zeros(len(start), bool)
                spans = [m.span() for m in LINK.finditer(joined)] if may_link(joined) else []
                if spans:
                    lo, hi = (np.searchsorted(start, x) for x in np.array(spans).T)
                    step = np.bincount(lo, minlength=len(start) + 1) - np.bincount(hi, minlength=len(start) + 1)
                    link = np.cumsum(step)[:-1] > 0
                links.append(link)
            at = end
        join = lambda k, kind: np.concatenate([x[k] for x in read]) if read else np.empty(0, kind)
        self.doc, self.length, self.hash = join(0, np.int64), join(1, np.int64), join(2, np.uint64)
        if marked:
            self.mark, self.segment = np.repeat(np.array(marks, np.int8), parts), np.repeat(np.arange(len(parts)), parts)
        else:
            self.mark, self.segment = np.where(np.concatenate(links) if links else np.empty(0, bool), LINKED, PLAIN).astype(np.int8), np.zeros(len(self.hash), np.int64)
        self.docs, self.counts = len(texts), np.bincount(self.doc, minlength=len(texts))
        self.first = np.flatnonzero(self.doc[1:] == self.doc[:-1])  # the position of each pair's first word
        self.pair = (self.hash[self.first] * MIX + self.hash[self.first + 1]) * MIX | np.uint64(1)
        self.word = self.hash & ~np.uint64(1)  # words are even, pairs are odd


def count_block(block: Block, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words and pairs, and how often they come; only: the documents to count, by number."""
    word, pair = block.word, block.pair
    if only is not None:
        word, pair = word[only[block.doc]], pair[only[block.doc[block.first]]]
    return np.unique(np.concatenate([word, pair]), return_counts=True)


def distinct_texts(pdf: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
    """For each row the number of its text, and the rows that have each text first."""
    at, texts = pd.factorize(pdf["_text"].fillna(""))
    first = np.full(len(texts), len(at))
    np.minimum.at(first, at, np.arange(len(at)))
    return at, pdf.iloc[first]


def _window_mean(values: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """The mean of the values around each one, within its group and size places."""
    if not len(values):
        return values
    total = np.concatenate([[0.0], np.cumsum(values)])
    at = np.arange(len(values))
    edge = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(values)]])
    size_of = np.diff(edge)
    start, end = np.repeat(edge[:-1], size_of), np.repeat(edge[1:], size_of)
    lo = np.maximum(start, np.minimum(at - size // 2, end - size))
    hi = np.minimum(end, lo + size)
    return (total[hi] - total[lo]) / (hi - lo)


class Evidence:
    """What the corpus counts say of a block. word, pair: corpus counts of the block's words and pairs; words, pairs: the sums over all."""

    def __init__(self, block: Block, word: np.ndarray, pair: np.ndarray, words: float, pairs: float) -> None:
        self.block, self.pairs = block, pairs
        self.pmi = np.log(pair / pairs) - np.log(word[block.first] / words) - np.log(word[block.first + 1] / words)
        self.group = block.doc[block.first]
        # word salad: both words of a pair whose surroundings are incoherent
        low = _window_mean(self.pmi, self.group, WINDOW) < SALAD
        self.salad = np.zeros(len(block.hash), bool)
        self.salad[block.first[low]] = self.salad[block.first[low] + 1] = True
        # all pairs that the corpus has twice, in the order of pair, document and position
        twice = np.flatnonzero(pair > 1)
        order = twice[np.argsort(block.pair[twice] ^ (self.group[twice].astype(np.uint64) * MIX), kind="stable")]
        self.k, self.p, self.d, self.often = block.pair[order], block.first[order], self.group[order], pair[order]

    def dense(self, times: int, span: int) -> np.ndarray:
        """Where in this order a pair comes the first of `times` times within `span` words, far more often than expected."""
        n = max(0, len(self.k) - times + 1)
        close = (self.k[:n] == self.k[times - 1 :]) & (self.d[:n] == self.d[times - 1 :]) & (self.p[times - 1 :] - self.p[:n] <= span)
        return np.flatnonzero(close & (EXCESS * span * self.often[:n] / self.pairs < times))

    def excessive(self, times: int, span: int) -> np.ndarray:
        """The words of collocations repeated to excess: `times` of one pair in a document within `span` words."""
        out, here = np.zeros(len(self.block.hash), bool), self.dense(times, span)
        for j in range(times):
            at = self.p[here + j]
            out[at] = out[at + 1] = True
        return out

    def share(self, stuffed: np.ndarray, never: np.ndarray) -> np.ndarray:
        """Per document the letters' part of stuffed words; what lies between them belongs to it, a stray one in other text doesn't count."""
        b = self.block
        stuffed = (_window_mean((stuffed & ~never).astype(float), b.doc, WINDOW // 2) > 0.5) & ~never
        letters = np.bincount(b.doc, b.length, b.docs)
        return np.divide(np.bincount(b.doc, b.length * stuffed, b.docs), letters, out=np.zeros(b.docs), where=letters > 0)

    def suspected(self) -> np.ndarray:
        """The share by association, repetition and links alone; no document's checked share is above it."""
        all_marks = self.salad | self.excessive(TIMES, SPAN) | self.excessive(TIMES_LISTED, SPAN_LISTED) | (self.block.mark == LINKED)
        return self.share(all_marks, np.zeros(len(all_marks), bool))

    def checked(self) -> np.ndarray:
        """The share when lines of logs, diffs and code are exempt, and written sentences by what repeats in them."""
        block, stuffed = self.block, self.salad.copy()
        # a sentence most of whose own pairs repeat to excess, and REPEATED times in the document, is no written one
        k, d, p = self.k, self.d, self.p
        edge = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]), [True]])) if len(k) else np.zeros(1, np.int64)
        count = np.repeat(np.diff(edge), np.diff(edge))
        often_here = np.zeros(len(block.hash), bool)
        here = self.dense(TIMES, SPAN)
        here = here[count[here] >= REPEATED]
        for j in range(TIMES):
            often_here[p[here + j]] = True
        own = block.first[block.segment[block.first] == block.segment[block.first + 1]]
        parts = int(block.segment[-1]) + 1 if len(block.segment) else 0
        repeats = 2 * np.bincount(block.segment[own], often_here[own], parts) > np.bincount(block.segment[own], minlength=parts)
        mark = np.where((block.mark == WRITTEN) & repeats[block.segment], PLAIN, block.mark)
        written = (mark == WRITTEN) & ~stuffed
        # all repetitions count, none is marked in written sentences
        stuffed |= self.excessive(TIMES, SPAN) & ~written
        stuffed |= self.excessive(TIMES_LISTED, SPAN_LISTED) & (mark == PLAIN)
        stuffed |= block.mark == LINKED
        return self.share(stuffed, (block.mark == EXEMPT) | written)

    def association(self) -> np.ndarray:
        """The mean PMI of each document's neighbours."""
        n = np.bincount(self.group, minlength=self.block.docs)
        return np.divide(np.bincount(self.group, self.pmi, self.block.docs), n, out=np.zeros(self.block.docs), where=n > 0)


def looked_up(block: Block, key: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The totals of a block's words and pairs; key, total: sorted by key, with all of them."""
    if not len(block.word):
        return np.empty(0), np.empty(0)
    return total[np.searchsorted(key, block.word)].astype(float), total[np.searchsorted(key, block.pair)].astype(float)


def score_block(texts: list[str | None], own: Block, at_key: np.ndarray, key: np.ndarray, total: np.ndarray, words: float, pairs: float) -> pd.DataFrame:
    """Per text: suspected and stuffed (shares of letters), association (mean PMI), and n words.

    own: the texts, not marked; key, total: corpus counts of what it holds; at_key: the place
    of its words and then its pairs in key.
    """
    each, n = total[at_key].astype(float), len(own.word)
    first = Evidence(own, each[:n], each[n:], words, pairs)
    suspected = first.suspected()
    stuffed, at = suspected.copy(), np.flatnonzero(suspected > SHARE)
    if len(at):
        block = Block([texts[i] for i in at])
        stuffed[at] = Evidence(block, *looked_up(block, key, total), words, pairs).checked()
    return pd.DataFrame({"suspected": suspected, "stuffed": stuffed, "association": first.association(), "words": own.counts.astype("int64")})


def scores(documents: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, suspected, stuffed, association, words) of every document.

    suspected: the part of its letters marked by association, repetition and links; stuffed: the part
    the check leaves where suspected is above SHARE, else suspected itself, which bounds it. Null,
    empty and blank texts have no words and are not stuffed. Repeated keys are documents of their
    own. No document is cut; a block holds about `block` letters. Corpus counts are exact over all
    distinct texts, and a pair of words that only one block holds never travels twice.
    """
    docs = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    letters = docs.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks = max(1, -(-letters // block))
    docs = docs.withColumn("_block", F.pmod(F.xxhash64("_key", F.length("_text")), F.lit(blocks)).cast("int")).withColumn("_hash", F.xxhash64("_text"))
    kind = docs.schema["_key"].dataType.simpleString()
    # texts that an earlier block counts: a text has at most one row per block here, however many copies there are
    places = docs.select("_hash", "_block").distinct()
    places = places.join(places.groupBy("_hash").agg(F.min("_block").alias("_least")), "_hash").where("_block > _least").select(F.col("_block").alias("_at"), F.col("_hash").alias("_h"))

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"_block": [], "h": [], "n": [], "seen": []})
        _, texts = distinct_texts(left)
        own = Block(texts["_text"].tolist(), False)
        keys, seen = count_block(own)
        n = seen.copy()
        elsewhere = texts["_hash"].isin(right["_h"]).to_numpy()
        if elsewhere.any():
            less, m = count_block(own, elsewhere)
            n[np.searchsorted(keys, less)] -= m
        return pd.DataFrame({"_block": left["_block"].iloc[0], "h": keys.view(np.int64), "n": n.astype(np.int64), "seen": seen.astype(np.int64)})

    counted = docs.groupBy("_block").cogroup(places.groupBy("_at")).applyInPandas(count, "_block int, h bigint, n bigint, seen bigint")
    counts = materialize(counted, "counts")
    odd = F.col("h").bitwiseAND(1)
    size = counts.groupBy(odd.alias("odd")).agg(F.sum("n").alias("n")).collect()  # two rows
    sizes = {r["odd"]: float(r["n"]) for r in size}
    totals = counts.groupBy("h").agg(F.sum("n").alias("total"))
    back = counts.join(totals, "h").where("total <> seen").select("_block", "h", "total")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at, texts = distinct_texts(left)
        own = Block(texts["_text"].tolist(), False)
        keys, at_key, n = np.unique(np.concatenate([own.word, own.pair]), return_inverse=True, return_counts=True)
        total = n.astype(np.int64)
        total[np.searchsorted(keys, right["h"].to_numpy(np.int64).view(np.uint64))] = right["total"].to_numpy(np.int64)
        out = score_block(texts["_text"].tolist(), own, at_key, keys, total, sizes.get(0, 1.0), sizes.get(1, 1.0)).iloc[at].reset_index(drop=True)
        out.insert(0, "_key", left["_key"].to_numpy())
        return out

    paired = docs.drop("_hash").groupBy("_block").cogroup(back.groupBy("_block"))
    out = paired.applyInPandas(score, f"_key {kind}, suspected double, stuffed double, association double, words bigint")
    return out.withColumnRenamed("_key", key)


def found(documents: DataFrame) -> DataFrame:
    return scores(documents).where(F.col("stuffed") > SHARE).select("doc_id").distinct()
