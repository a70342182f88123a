"""Typed keys: text, numbers and bytes, cursors and prefixes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_TYPES = ("uuid", "u64", "u128")
WIDTH = {"uuid": 16, "u64": 8, "u128": 16}


def key_bytes(kind: str, value: str | int) -> bytes:
    """Big-endian bytes of a document id given as text or number."""
    if kind == "uuid":
        return uuid.UUID(str(value).replace("-", "")).bytes
    n = int(value)
    if isinstance(value, bool) or not 0 <= n < 1 << 8 * WIDTH[kind]:
        raise ValueError(f"{value!r} is no {kind}")
    return n.to_bytes(WIDTH[kind], "big")


def key_text(kind: str, raw: bytes) -> str:
    """A uuid with hyphens, a number in decimal."""
    if len(raw) != WIDTH[kind]:
        raise ValueError(f"a {kind} has {WIDTH[kind]} bytes")
    return str(uuid.UUID(bytes=bytes(raw))) if kind == "uuid" else str(int.from_bytes(raw, "big"))


def key_json(kind: str, raw: bytes) -> str | int:
    """u64 ids are JSON numbers, the others strings."""
    return int(key_text(kind, raw)) if kind == "u64" else key_text(kind, raw)


def uuid_column(c: Column) -> Column:
    """16 bytes of a uuid's text, with or without hyphens; null if it isn't one."""
    h = F.replace(c, F.lit("-"), F.lit(""))
    return F.when(h.rlike("^[0-9A-Fa-f]{32}$"), F.unhex(h))


def uuid_text_column(c: Column) -> Column:
    h = F.lower(F.hex(c))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def u64_column(c: Column) -> Column:
    """8 big-endian bytes of a decimal(20,0) or bigint; null outside the range."""
    n = c.cast("decimal(20,0)")
    ok = (n >= F.lit(0)) & (n <= F.lit("18446744073709551615").cast("decimal(20,0)"))
    return F.when(ok, F.unhex(F.lpad(F.conv(n.cast("string"), 10, 16), 16, "0")))


def u64_number_column(c: Column) -> Column:
    return F.conv(F.hex(c), 16, 10).cast("decimal(20,0)")


def u128_column(c: Column) -> Column:
    """16 big-endian bytes of decimal text; numbers beyond 38 digits don't fit a Spark decimal, so the text is cut in two.

    Null for anything but digits and for numbers of 2**128 and more.
    """
    digits = F.regexp_extract(F.trim(c), r"^0*(\d{1,39})$", 1)

    # Long division by 2**32 over groups of nine digits keeps every step inside 64 bits.
    groups = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.substring(F.lpad(digits, 45, "0"), i * 9 + 1, F.lit(9)).cast("bigint"))

    def divide(state: Column, _: Column) -> Column:
        step = F.aggregate(
            state["g"],
            F.struct(F.lit(0).cast("bigint").alias("r"), F.array().cast("array<bigint>").alias("q")),
            lambda s, x: F.struct(
                ((s["r"] * 1_000_000_000 + x) % (1 << 32)).alias("r"),
                F.concat(s["q"], F.array(F.floor((s["r"] * 1_000_000_000 + x - (s["r"] * 1_000_000_000 + x) % (1 << 32)) / (1 << 32)).cast("bigint"))).alias("q"),
            ),
        )
        return F.struct(step["q"].alias("g"), F.concat(F.array(step["r"]), state["w"]).alias("w"))

    start = F.struct(groups.alias("g"), F.array().cast("array<bigint>").alias("w"))
    words = F.aggregate(F.sequence(F.lit(1), F.lit(5)), start, divide)["w"]
    text = F.array_join(F.transform(F.slice(words, 2, 4), lambda w: F.lpad(F.hex(w), 8, "0")), "")
    return F.when((digits != "") & (words[0] == 0), F.unhex(text))


def prefix_end(prefix: bytes) -> bytes | None:
    """The least byte string above all that begin with ``prefix``; None if there is none."""
    head = prefix.rstrip(b"\xff")
    return head[:-1] + bytes([head[-1] + 1]) if head else None


def from_cursor(text: str) -> bytes:
    """Bytes of a hex cursor or id prefix; hyphens don't count, the number of digits must be even."""
    h = text.replace("-", "")
    if len(h) % 2 or any(ch not in "0123456789abcdefABCDEF" for ch in h):
        raise ValueError("a cursor has an even number of hex digits")
    return bytes.fromhex(h)


def to_cursor(raw: bytes) -> str:
    return bytes(raw).hex()


def int_key_order(c: Column, compat: bool = False) -> list[Column]:
    """Sort columns of a signed key: numeric, or with ``compat`` by two's-complement bytes (negatives last)."""
    return [(c < 0), c] if compat else [c]
