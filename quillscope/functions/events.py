"""Signed events: canonical form, identity, signatures, filters, elements and addresses."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import norm_key
from .text import fixed

# Fixed values of the secp256k1 curve (public standard).
_P = 2**256 - 2**32 - 977
_N = 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEBAAEDCE6AF48A03BBFD25E8CD0364141
_G = (0x79BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798, 0x483ADA7726A3C4655DA4FBFC0E1108A8FD17B448A68554199C47D08FFB10D4B8)
#: JSON type of an event.
SCHEMA = "id string, pubkey string, created_at bigint, kind int, tags array<array<string>>, content string, sig string"


def canonical(event: dict[str, Column] | None = None, escape_html: bool = True) -> Column:
    """``[0,"pubkey",created_at,kind,tags,"content"]`` without spaces; with ``escape_html`` <, >, & and two line separators as escapes."""
    e = event or {c: F.col(c) for c in ("pubkey", "created_at", "kind", "tags", "content")}
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    rows = F.to_json(F.coalesce(e["tags"], F.array().cast("array<array<string>>")))
    text = F.concat(F.lit("[0,"), quoted(e["pubkey"]), F.lit(","), e["created_at"].cast("string"), F.lit(","), e["kind"].cast("string"), F.lit(","), rows, F.lit(","), quoted(e["content"]), F.lit("]"))
    if escape_html:
        for sign, code in (("<", "003c"), (">", "003e"), ("&", "0026"), (" ", "2028"), (" ", "2029")):
            text = F.replace(text, F.lit(sign), F.lit(f"\\u{code}"))
    return text


def compute_id(event: dict[str, Column] | None = None, escape_html: bool = True) -> Column:
    return F.sha2(canonical(event, escape_html), 256)


def valid_id(escape_html: bool = True) -> Column:
    return F.coalesce(norm_key(F.col("id")) == compute_id(None, escape_html), F.lit(False))


def matches(ids=None, authors=None, kinds=None, since=None, until=None, tags=None) -> Column:
    """A predicate: all given fields must hold, each by any of its values; ``tags``: {"e": [...]}; no field is true."""
    test = F.lit(True)
    for column, values in (("id", ids), ("pubkey", authors), ("kind", kinds)):
        if values:
            test = test & F.col(column).isin(*values)
    if since is not None:
        test = test & (F.col("created_at") >= since)
    if until is not None:
        test = test & (F.col("created_at") <= until)
    for name, values in (tags or {}).items():
        test = test & F.coalesce(_has_tag(name, list(values)), F.lit(False))
    return test


def _has_tag(name: str, values: list[str]) -> Column:
    return F.exists("tags", lambda t: F.coalesce((F.get(t, F.lit(0)) == F.lit(name)) & F.get(t, F.lit(1)).isin(*values), F.lit(False)))


# The signs that have an escape of their own in a quoted literal.
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}


def quoted(text: Column) -> Column:
    """A text as a literal in double quotes: signs that do not show as escapes, by name or by number."""
    table = F.create_map(*[F.lit(x) for pair in _ESCAPES.items() for x in pair])

    def sign(x: Column) -> Column:
        code = F.ascii(x)
        number = F.when(code < 128, F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(code)), 2, "0"))).when(code < 65536, F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0")))
        number = number.otherwise(F.concat(F.lit("\\U"), F.lpad(F.lower(F.hex(code)), 8, "0")))
        return F.coalesce(F.try_element_at(table, x), F.when(x.rlike(r"[\p{C}\p{Z}]") & (x != " "), number).otherwise(x))

    body = F.when(text.rlike(r'[\\"\p{C}\x{A0}-\x{10FFFF}]'), F.array_join(F.transform(F.split(text, ""), sign), "")).otherwise(text)
    return F.concat(F.lit('"'), body, F.lit('"'))


def elements() -> Column:
    """Array of (tag, value) of an event: id, author, kind, words, a short content, tags, time."""
    def pair(tag: str, value: Column) -> Column:
        return F.struct(F.lit(tag).alias("tag"), value.alias("value"))

    content = F.coalesce(F.col("content"), F.lit(""))
    words = F.filter(F.split(F.trim(content), r"\s+"), lambda w: F.octet_length(w) > 2)
    literal = F.when((F.octet_length(content) > 10) & (F.octet_length(content) < 200), F.array(pair("literal", quoted(content)))).otherwise(F.array().cast("array<struct<tag:string,value:string>>"))
    named = F.filter(F.coalesce(F.col("tags"), F.array().cast("array<array<string>>")), lambda t: F.size(t) >= 2)

    def tagged(t: Column) -> Column:
        k, v = F.get(t, F.lit(0)), F.get(t, F.lit(1))
        name = F.when(k == "e", "e-tag").when(k == "p", "p-tag").when(k == "t", "hashtag").otherwise("tag")
        return F.struct(name.alias("tag"), F.when(k.isin("e", "p", "t"), v).otherwise(F.concat_ws(":", k, v)).alias("value"))

    head = F.array(pair("event", F.substring("id", 1, 16)), pair("pubkey", F.col("pubkey")), pair("kind", F.col("kind").cast("string")))
    return F.concat(head, F.transform(words, lambda w: pair("word", w)), literal, F.transform(named, tagged), F.array(pair("timestamp", F.col("created_at").cast("string"))))


def metadata_note(app: str, instance: Column, generation: Column, snapshot: Column) -> Column:
    """struct(kind, tags, content): the profile of a running instance, unsigned; of the snapshot's hash the first 16 signs are shown."""
    text = lambda c: c.cast("string")
    about = F.concat(F.lit(f"{app} lattice organism, generation "), text(generation), F.lit(", spore "), F.substring(snapshot, 1, 16))
    content = F.to_json(F.struct(F.concat(F.lit(f"{app}-inst"), text(instance)).alias("name"), about.alias("about")))
    return F.struct(F.lit(0).alias("kind"), F.array().cast("array<array<string>>").alias("tags"), content.alias("content"))


def status_note(app: str, instance: Column, generation: Column, nodes: Column, occupied: Column, occupancy: Column, fitness: Column, peers: Column) -> Column:
    """struct(kind, tags, content): the state of a running instance, unsigned."""
    text = lambda c: c.cast("string")
    tag = lambda c: F.array(F.lit("t"), c)
    content = F.concat(
        F.lit(f"{app} inst"), text(instance), F.lit(" gen"), text(generation), F.lit(": "), text(nodes), F.lit(" nodes, "), text(occupied), F.lit(" occupied ("), fixed(occupancy * 100, 0),
        F.lit("%), fitness="), fixed(fitness, 3), F.lit(", "), text(peers), F.lit(" peers"),
    )
    tags = F.array(tag(F.lit(app)), tag(F.lit("lattice")), tag(F.concat(F.lit("gen"), text(generation))))
    return F.struct(F.lit(1).alias("kind"), tags.alias("tags"), content.alias("content"))


def normal_url(url: Column) -> Column:
    """A relay's address without spaces around and slashes at its end; null if it is none or local."""
    trimmed = F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), "/+$", "")
    return F.when(trimmed.rlike("^wss?://") & ~F.lower(trimmed).rlike(r"localhost|127\.0\.0\.1"), trimmed)


def long_enough(least: int = 50, own_sign: str | None = None) -> Column:
    """Contents of at least ``least`` bytes that do not hold our own sign."""
    test = F.coalesce(F.octet_length("content") >= least, F.lit(False))
    return test & ~F.contains(F.col("content"), F.lit(own_sign)) if own_sign else test


# Points are (X, Y, Z) with x = X / Z^2 and y = Y / Z^3, so that sums need no division; None is the point at infinity.


def _double(p):
    if p is None or not p[1]:
        return None
    x, y, z = p
    yy = y * y % _P
    s, m = 4 * x * yy % _P, 3 * x * x % _P
    nx = (m * m - 2 * s) % _P
    return nx, (m * (s - nx) - 8 * yy * yy) % _P, 2 * y * z % _P


def _plus(p, q):
    if p is None or q is None:
        return p or q
    (x1, y1, z1), (x2, y2, z2) = p, q
    za, zb = z1 * z1 % _P, z2 * z2 % _P
    u1, u2, s1, s2 = x1 * zb % _P, x2 * za % _P, y1 * zb * z2 % _P, y2 * za * z1 % _P
    if u1 == u2:
        return _double(p) if s1 == s2 else None
    h, r = u2 - u1, s2 - s1
    hh = h * h % _P
    hhh, v = h * hh % _P, u1 * hh % _P
    nx = (r * r - hhh - 2 * v) % _P
    return nx, (r * (v - nx) - s1 * hhh) % _P, h * z1 * z2 % _P


def _combine(a: int, p, b: int = 0, q=None):
    """The affine point a p + b q, or None: both sums in one run over the bits."""
    p, q = (*p, 1), None if q is None else (*q, 1)
    table, out = (None, p, q, _plus(p, q)), None
    for i in range(max(a.bit_length(), b.bit_length()) - 1, -1, -1):
        out = _plus(_double(out), table[(a >> i & 1) | (b >> i & 1) << 1])
    if out is None:
        return None
    back = pow(out[2], -1, _P)
    return out[0] * back * back % _P, out[1] * back * back * back % _P


def _lift(x: int):
    if x >= _P:
        return None
    square = (pow(x, 3, _P) + 7) % _P
    y = pow(square, (_P + 1) // 4, _P)
    return None if y * y % _P != square else (x, y if y % 2 == 0 else _P - y)


def _tagged(tag: str, data: bytes) -> bytes:
    t = hashlib.sha256(tag.encode()).digest()
    return hashlib.sha256(t + t + data).digest()


def verify(pubkey: str, message: str, signature: str) -> bool:
    """BIP-340 verification of a signature over a 32-byte message, all in hexadecimal."""
    try:
        key, m, s = bytes.fromhex(pubkey), bytes.fromhex(message), bytes.fromhex(signature)
    except (TypeError, ValueError):
        return False
    if len(key) != 32 or len(m) != 32 or len(s) != 64:
        return False
    point, r, k = _lift(int.from_bytes(key)), int.from_bytes(s[:32]), int.from_bytes(s[32:])
    if point is None or r >= _P or k >= _N:
        return False
    e = int.from_bytes(_tagged("BIP0340/challenge", s[:32] + key + m)) % _N
    found = _combine(k, _G, _N - e, point)
    return found is not None and found[1] % 2 == 0 and found[0] == r


def sign(secret: int, message: str) -> tuple[str, str]:
    """(pubkey, signature) of a 32-byte message in hexadecimal; for fixtures."""
    point = _combine(secret, _G)
    d = secret if point[1] % 2 == 0 else _N - secret
    key, m = point[0].to_bytes(32), bytes.fromhex(message)
    t = (d ^ int.from_bytes(_tagged("BIP0340/aux", bytes(32)))).to_bytes(32)
    k0 = int.from_bytes(_tagged("BIP0340/nonce", t + key + m)) % _N
    spot = _combine(k0, _G)
    k = k0 if spot[1] % 2 == 0 else _N - k0
    e = int.from_bytes(_tagged("BIP0340/challenge", spot[0].to_bytes(32) + key + m)) % _N
    return key.hex(), (spot[0].to_bytes(32) + ((k + e * d) % _N).to_bytes(32)).hex()


@F.pandas_udf(T.BooleanType())
def valid_sig(pubkey: pd.Series, message: pd.Series, signature: pd.Series) -> pd.Series:
    """Whether each signature holds; in Arrow batches."""
    return pd.Series([verify(p, m, s) for p, m, s in zip(pubkey, message, signature, strict=True)])


_BECH = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def bech32(name: str, data: bytes) -> str:
    """Bech32 text (BIP-173) of any length."""
    bits, size, words = 0, 0, []
    for byte in data:
        bits, size = bits << 8 | byte, size + 8
        while size >= 5:
            size -= 5
            words.append(bits >> size & 31)
    if size:
        words.append(bits << (5 - size) & 31)
    spread = [ord(c) >> 5 for c in name] + [0] + [ord(c) & 31 for c in name]
    check = 1
    for v in [*spread, *words, 0, 0, 0, 0, 0, 0]:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    check ^= 1
    return name + "1" + "".join(_BECH[w] for w in [*words, *[check >> 5 * (5 - i) & 31 for i in range(6)]])


def nevent_text(event_id: str, relays: list[str], author: str | None, kind: int | None) -> str | None:
    """Address of an event: type-length-value records 0 id, 1 relays, 2 author, 3 kind."""
    try:
        records = [(0, bytes.fromhex(event_id)), *[(1, r.encode()) for r in relays if r]]
        if author:
            records.append((2, bytes.fromhex(author)))
    except (TypeError, ValueError):
        return None
    if len(records[0][1]) != 32:
        return None
    if kind is not None:
        records.append((3, int(kind).to_bytes(4)))
    return bech32("nevent", b"".join(bytes([t, len(v)]) + v for t, v in records if len(v) < 256))


@F.pandas_udf(T.StringType())
def nevent(event_id: pd.Series, relay: pd.Series, author: pd.Series, kind: pd.Series) -> pd.Series:
    """Addresses of events, each with one relay at most; in Arrow batches."""
    rows = zip(event_id, relay, author, kind, strict=True)
    return pd.Series([nevent_text(i, [r] if r else [], a, None if pd.isna(k) else k) for i, r, a, k in rows])
