"""Tokens of a text and their channels, in built-in expressions only.

The tokeniser works on bytes, each read as a Latin-1 character: runs of white space bytes, runs of letter or digit bytes,
and every other byte alone. The tag of a token follows from its UTF-8 characters; an invalid byte is one character
that is neither letter nor space. With ``chunk_bytes`` set (default 4096) no token crosses a multiple of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind

CHANNELS = ["w1", "w2", "w3", "w4", "w5", "punct", "space", "origin"]
CHUNK_BYTES = 4096
# Byte classes of the tokeniser and the valid UTF-8 sequences that can occur within a word run.
_TOKEN = r"[0-9A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\xFF]+|[\x09-\x0D\x20\x85\xA0]+|[\s\S]"
_SEQUENCE = r"[\xC2-\xD6\xD8-\xDF][\xAA\xB5\xBA]|[\xE0-\xEC\xEE\xEF][\xAA\xB5\xBA]{2}|[\xF0-\xF3][\xAA\xB5\xBA]{3}"


def byte_view(text: Column) -> Column:
    """One character for each UTF-8 byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def tokens(text: Column, chunk_bytes: int | None = CHUNK_BYTES, most: int | None = None) -> Column:
    """Array of tokens in the byte view; at most the first ``most``. A null text has none.

    For a window only the bytes that can hold it are read, four chunks at first and all of them if those have too few tokens.
    """
    def cut(view: Column, chunks: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), chunks)), lambda i: F.regexp_extract_all(F.substring(view, i * chunk_bytes + 1, F.lit(chunk_bytes)), F.lit(_TOKEN), F.lit(0)))
        return F.flatten(pieces)

    view = byte_view(F.coalesce(text, F.lit("")))
    if chunk_bytes is None:
        found = F.regexp_extract_all(view, F.lit(_TOKEN), F.lit(0))
        return F.slice(found, 1, most) if most else found

    def whole(v: Column) -> Column:
        return cut(v, ((F.length(v) - 1) / chunk_bytes).cast("int"))

    if not most:
        return bind(view, whole)
    few = 4

    def window(v: Column) -> Column:
        short = F.when(F.length(v) > few * chunk_bytes, cut(v, F.lit(few - 1))).otherwise(F.lit(None))
        return bind(short, lambda s: F.slice(F.when(F.size(s) >= most, s).otherwise(whole(v)), 1, most))

    return bind(view, window)


def channel(token: Column) -> Column:
    """The channel of a token of the byte view, 0 to 6 for w1 to space."""
    first = F.ascii(token)
    space = ((first >= 9) & (first <= 13)) | (first == 32)
    plain = ((first >= 48) & (first <= 57)) | ((first >= 65) & (first <= 90)) | ((first >= 97) & (first <= 122))
    # Only a token of the letter class can begin with a letter of several bytes.
    head = F.regexp_extract(token, f"^(?:{_SEQUENCE})", 0)
    foreign = (first >= 0xC2) & (head != "") & F.decode(F.encode(F.when(head != "", head), "ISO-8859-1"), "UTF-8").rlike(r"^[\p{L}\p{Nd}]")
    n = F.when(F.octet_length(token) == F.length(token), F.length(token)).otherwise(F.length(F.regexp_replace(token, _SEQUENCE, "x")))
    size = F.when(n <= 1, 0).when(n <= 3, 1).when(n <= 5, 2).when(n <= 8, 3).otherwise(4)
    return F.when(space, 6).when(plain | foreign, size).otherwise(5)


def channels(text: Column, chunk_bytes: int | None = CHUNK_BYTES, most: int | None = None) -> Column:
    """Array of channel numbers."""
    return F.transform(tokens(text, chunk_bytes, most), channel)


def elements(text: Column, chunk_bytes: int | None = CHUNK_BYTES) -> Column:
    """Array of (tag, value); values are kept in the byte view, so that they can be split anywhere."""
    names = F.array(*[F.lit(c) for c in CHANNELS])
    return F.transform(tokens(text, chunk_bytes), lambda t: F.struct(F.get(names, channel(t)).alias("tag"), t.alias("value")))


def channel_index(tag: Column) -> Column:
    """0 to 7 for the eight tags, -1 for any other and null."""
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), tag) - 1, F.lit(-1)).cast("int")


def lines(text: Column, tag: str = "line") -> Column:
    """Array of (tag, value) of the lines; without a last empty one, nor line ends."""
    parts = F.split(text, "\n")
    kept = F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda x: F.struct(F.lit(tag).alias("tag"), F.regexp_replace(x, r"\r\z", "").alias("value")))


def hex_encode(text: Column) -> Column:
    """The 6-bit groups of the UTF-8 bytes, the last three bytes filled up with zeros."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    digits = F.split(F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", ""), "")
    kept = F.filter(digits, lambda x: x != "")
    return F.transform(kept, lambda x: F.greatest(F.position(x, F.lit(alphabet)) - 1, F.lit(0)))


def hex_decode(groups: Column, length: Column) -> Column:
    """Inverse of :func:`hex_encode`: the first ``length`` bytes; an incomplete last group of four is left out."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    whole = F.slice(groups, F.lit(1), (F.size(groups) / 4).cast("int") * 4)
    text = F.array_join(F.transform(whole, lambda x: F.substring(F.lit(alphabet), x + 1, F.lit(1))), "")
    return F.substring(F.unbase64(text), F.lit(1), length)


def element(tag: Column, value: Column, is_ref: bool = False) -> Column:
    """struct(tag, value, groups, n_bytes, is_ref): an element with its value's 6-bit groups; references shape a structure but are not emitted."""
    return F.struct(tag.alias("tag"), value.alias("value"), hex_encode(value).alias("groups"), F.octet_length(value).alias("n_bytes"), F.lit(is_ref).alias("is_ref"))


def origin(author: Column) -> Column:
    """The element that says who wrote a text."""
    return element(F.lit("origin"), author)
