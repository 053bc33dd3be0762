"""Tokens of chat records: the token stream, its crop to a context, loss masks and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The special tokens in the order of their ids, and the token grammar (newline,
# identifier, hexadecimal name, number, two-character operators, any other visible character).
SPECIAL = ["<pad>", "<unk>", "<bos>", "<eos>", "<sep>", "<system>", "<user>", "<assistant>", "<nl>"]
TOKEN = r"\n|[A-Za-z_][A-Za-z0-9_]*|[0-9a-f]{7,64}|\d+(?:\.\d+)?|==|!=|<=|>=|->|=>|::|\+\+|--|&&|\|\||[^\s]"
ROLES = ["system", "user", "assistant"]


def tokenize(text: Column) -> Column:
    """array<string>; null and empty texts have none."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x1C-\x1F]", " ")
    return F.transform(F.regexp_extract_all(clean, F.lit("(?U)" + TOKEN), 0), lambda t: F.when(t == "\n", "<nl>").otherwise(t))


def record_stream(messages: Column) -> Column:
    """<bos>, then per message <role>, its tokens and <sep>, then <eos>; unknown roles have no marker."""
    part = lambda m: F.concat(F.when(m["role"].isin(ROLES), F.array(F.concat(F.lit("<"), m["role"], F.lit(">")))).otherwise(F.array().cast("array<string>")), tokenize(m["content"]), F.array(F.lit("<sep>")))
    return F.concat(F.array(F.lit("<bos>")), F.flatten(F.transform(messages, part)), F.array(F.lit("<eos>")))


def decision(count: Column, context: int, most: int) -> Column:
    return F.when(count > most, "exclude_oversize").when(count > context, "use_truncated").otherwise("use_full")


def crop(words: Column, budget: Column) -> Column:
    """The first (budget + 1) // 2 and the last of words; all of them if they fit; none for a budget below 1."""
    b = F.greatest(budget, F.lit(0)).cast("int")
    head = F.floor((b + 1) / 2).cast("int")
    tail = b - head
    cut = F.concat(F.slice(words, F.lit(1), head), F.when(tail > 0, F.slice(words, -F.greatest(tail, F.lit(1)), tail)).otherwise(F.array().cast("array<string>")))
    return F.when(F.size(words) <= b, words).otherwise(cut)


def render(system: Column, user: Column, assistant: Column) -> Column:
    """struct(tokens, loss_mask) of a three-message record of token arrays; the loss covers the assistant's part."""
    one = lambda role, words: F.concat(F.array(F.lit(f"<{role}>")), words, F.array(F.lit("<sep>")))
    stream = F.concat(F.array(F.lit("<bos>")), one("system", system), one("user", user), one("assistant", assistant), F.array(F.lit("<eos>")))
    before = F.size(system) + F.size(user) + 6
    mask = F.concat(F.array_repeat(F.lit(0), before), F.array_repeat(F.lit(1), F.size(assistant) + 2))
    return F.struct(stream.alias("tokens"), mask.alias("loss_mask"))


def _little_endian(v: Column, size: int) -> Column:
    digits = F.lpad(F.right(F.hex(v.cast("bigint")), F.lit(2 * size)), 2 * size, F.lit("0"))
    return F.concat(*[F.substring(digits, 2 * (size - i) - 1, 2) for i in range(size)])


def ints_sha256(ids: Column) -> Column:
    """sha256 over 4-byte little-endian signed integers."""
    return F.sha2(F.unhex(F.array_join(F.transform(ids, lambda i: _little_endian(i, 4)), "")), 256)


def hashed_bucket(previous: Column, target: Column, position: Column, buckets: int) -> Column:
    """The first 8 bytes of sha256('previous:target:position') as a little-endian unsigned number, modulo buckets."""
    digest = F.sha2(F.concat_ws(":", previous.cast("string"), target.cast("string"), position.cast("string")).cast("binary"), 256)
    turned = F.concat(*[F.substring(digest, 2 * (8 - i) - 1, 2) for i in range(8)])
    return (F.conv(turned, 16, 10).cast("decimal(20,0)") % F.lit(buckets)).cast("int")
