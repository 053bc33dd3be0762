"""Problem 5: tokens per source and language.

A vocabulary becomes a double-array trie over bytes; the best path through a segment (a word with
the mark of the space before it) is found by Viterbi search that keeps a count of pieces instead of
the path. Texts are normalised by the model's own rules first. For unigram vocabularies the pieces' own
scores decide, and the count is exact. A vocabulary of merges has ranks instead of scores; there a
piece's logarithmic probability is taken from its rank by Zipf's law, the best path's count is an
estimate (figures in the README), and the number of pieces the merges leave stands beside it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import folded, repo_key, valid_rows

#: A byte that no piece covers costs so much more than the rarest piece.
BYTE_PENALTY = 10.0
SEGMENT = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")


def default_model() -> str:
    """The path of the sentencepiece model that is used where none is named."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def processor(model: str):  # noqa: ANN201
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def has_merges(sp) -> bool:  # noqa: ANN001
    """Whether the scores are ranks of merges and not logarithms of probabilities."""
    scores = [sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return all(float(s).is_integer() for s in scores) and len(set(scores)) > len(scores) // 2


def vocabulary(model: str) -> dict[bytes, float]:
    """Piece -> cost (negative logarithm of its probability) of a sentencepiece model."""
    sp = processor(model)
    kept = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in kept}
    if not has_merges(sp):
        return {p.encode(): -s for p, s in scores.items()}
    whole = math.log(sum(1 / (r + 1) for r in range(len(scores))))
    return {p.encode(): math.log(-s + 1) + whole for p, s in scores.items()}


class DoubleArray:
    """A trie in two arrays: a node's child for a byte lies at base[node] + byte, if check there names the node."""

    def __init__(self, costs: dict[bytes, float]) -> None:
        tree: dict = {}
        for piece, cost in costs.items():
            node = tree
            for byte in piece:
                node = node.setdefault(byte, {})
            node[-1] = cost
        self.base, self.check, self.cost = [0] * 2048, [-1] * 2048, [None] * 2048
        self.check[0] = 0
        free, dense, work = 257, 257, [(tree, 0)]
        while work:
            branch, node = work.pop()
            self.cost[node] = branch.get(-1)
            children = sorted(b for b in branch if b >= 0)
            if not children:
                continue
            while free < len(self.check) and self.check[free] >= 0:
                free += 1
            # single children fill the gaps; wider nodes look beyond what earlier ones found crowded
            start = max(1, (free if len(children) == 1 else max(free, dense)) - children[0])
            tried = 0
            while True:
                if start + 256 > len(self.check):
                    more = len(self.check)
                    self.base += [0] * more
                    self.check += [-1] * more
                    self.cost += [None] * more
                if all(self.check[start + c] < 0 for c in children):
                    break
                start += 1
                tried += 1
            if tried > 16:
                dense = start
            self.base[node] = start
            for c in children:
                self.check[start + c] = node
                work.append((branch[c], start + c))
        self.penalty = max(costs.values(), default=0.0) + BYTE_PENALTY

    def count(self, segment: bytes) -> int:
        """Pieces on the cheapest path; a byte that no piece covers is a token of its own."""
        n, base, check, cost = len(segment), self.base, self.check, self.cost
        best, pieces = [math.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, so_far, node = best[i], pieces[i] + 1, 0
            if here + self.penalty < best[i + 1]:
                best[i + 1], pieces[i + 1] = here + self.penalty, so_far
            for j in range(i, n):
                child = base[node] + segment[j]
                if check[child] != node or child == 0:
                    break
                node = child
                c = cost[node]
                if c is not None and here + c < best[j + 1]:
                    best[j + 1], pieces[j + 1] = here + c, so_far
        return pieces[n]


class Counter(dict):
    """Segment -> tokens, remembered; forgets itself when it has grown large."""

    def __init__(self, trie: DoubleArray, normalize=None) -> None:  # noqa: ANN001
        self.trie = trie
        self.normalize = normalize or (lambda text: "▁" + text.replace(" ", "▁"))

    def __missing__(self, segment: str) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[segment] = self.trie.count(segment.encode("utf-8", "replace"))
        return n

    def tokens(self, text: str | None) -> int:
        """Null and empty texts have 0 tokens."""
        if not text:
            return 0
        return sum(map(self.__getitem__, SEGMENT.findall(self.normalize(text))))


def token_counter(model: str | None = None):  # noqa: ANN201
    """A column function: text -> struct(tokens, exact), bigint. The trie, bounded by the vocabulary, goes to the tasks.

    tokens: pieces on the best path; exact: the model's own count. They are the same for unigram models.
    """
    path = model or default_model()
    trie, merges = DoubleArray(vocabulary(path)), has_merges(processor(path))
    with open(path, "rb") as f:
        proto = f.read()  # the file goes along, so that tasks need no path

    @F.pandas_udf("tokens bigint, exact bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        counter = Counter(trie, sp.normalize)
        for part in texts:
            best = part.map(counter.tokens).astype("int64")
            exact = pd.Series([len(sp.encode(t)) if t else 0 for t in part], dtype="int64") if merges else best
            yield pd.DataFrame({"tokens": best.to_numpy(), "exact": exact.to_numpy()})

    return count


def document_tokens(documents: DataFrame, model: str | None = None) -> DataFrame:
    """(source, lang, repo, documents, tokens, exact): null where a document doesn't name them."""
    blank_null = lambda c: F.when(F.length(c) > 0, c)
    rows = documents.select(blank_null(folded("source")).alias("source"), blank_null(folded("lang")).alias("lang"), repo_key("repo_url").alias("repo"), token_counter(model)("text").alias("c"))
    return rows.groupBy("source", "lang", "repo").agg(F.count(F.lit(1)).alias("documents"), F.sum("c.tokens").alias("tokens"), F.sum("c.exact").alias("exact"))


def loss_tokens(meta: DataFrame, labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """(repo, ecosystem, records, invalid, tokens): loss tokens of valid rows.

    Loss tokens that are missing, not positive or above the row's positive length count as invalid
    and add nothing. Rows without a label have no repository, repositories outside the manifest no
    ecosystem. Rows are added up per label before the label's repository is looked up, and a
    repository's ecosystem is looked up once.
    """
    rows = valid_rows(meta, "record_id", "source_diff_id", "loss_tokens", "input_length")
    fits = (F.col("loss_tokens") > 0) & ~F.coalesce((F.col("input_length") > 0) & (F.col("loss_tokens") > F.col("input_length")), F.lit(False))
    good = F.coalesce(fits, F.lit(False))
    per = rows.groupBy("source_diff_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~good).alias("bad"), F.sum(F.when(good, F.col("loss_tokens")).otherwise(0)).alias("t"))
    repo = valid_rows(labels.select("id", "_ord", repo_key("source_repo_url").alias("repo")), "id", "repo")
    repo = repo.where(F.col("id").startswith("generated-")).select(F.expr("substr(id, 11)").alias("source_diff_id"), "repo")
    eco = valid_rows(manifest.select(repo_key("repo_url").alias("repo"), F.nullif(folded("ecosystem"), F.lit("")).alias("ecosystem"), "_ord"), "repo", "ecosystem")
    sums = per.join(repo, "source_diff_id", "left").groupBy("repo").agg(F.sum("n").alias("records"), F.sum("bad").alias("invalid"), F.sum("t").alias("tokens"))
    return sums.join(eco, "repo", "left").select("repo", "ecosystem", "records", "invalid", "tokens")


def budget(documents: DataFrame, meta: DataFrame, labels: DataFrame, manifest: DataFrame, model: str | None = None) -> DataFrame:
    """(part, source, lang, repo, ecosystem, records, tokens, exact): both totals in one table; part is text or loss, whose tokens are exact."""
    none = F.lit(None).cast("string")
    text = document_tokens(documents, model).select(F.lit("text").alias("part"), "source", "lang", "repo", none.alias("ecosystem"), F.col("documents").alias("records"), "tokens", "exact")
    loss = loss_tokens(meta, labels, manifest).select(F.lit("loss").alias("part"), none.alias("source"), none.alias("lang"), "repo", "ecosystem", "records", "tokens", F.col("tokens").alias("exact"))
    return text.unionByName(loss)
