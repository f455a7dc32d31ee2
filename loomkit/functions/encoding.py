"""Encodings and identifiers: base 32 and 58, tokens, time-sorted ids, file signatures."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
B32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


@pandas_udf(T.StringType())
def base32_encode(c: pd.Series) -> pd.Series:
    """Runs in Python over Arrow batches, as the next three do."""
    return c.map(lambda b: None if b is None else base64.b32encode(b).decode())


@pandas_udf(T.BinaryType())
def base32_decode(c: pd.Series) -> pd.Series:
    def one(t: str | None) -> bytes | None:
        try:
            return None if t is None else base64.b32decode(t)
        except ValueError:
            return None

    return c.map(one)


@pandas_udf(T.StringType())
def base58_encode(c: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        n, out = int.from_bytes(b, "big"), ""
        while n:
            n, k = divmod(n, 58)
            out = B58[k] + out
        return "1" * (len(b) - len(b.lstrip(b"\0"))) + out

    return c.map(one)


@pandas_udf(T.BinaryType())
def base58_decode(c: pd.Series) -> pd.Series:
    """Null where a letter isn't of the alphabet."""

    def one(t: str | None) -> bytes | None:
        if t is None or set(t) - set(B58):
            return None
        n = 0
        for x in t:
            n = n * 58 + B58.index(x)
        return b"\0" * (len(t) - len(t.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")

    return c.map(one)


def _jwt_part(c: Column, i: int) -> Column:
    part = F.try_element_at(F.split(c, r"\."), F.lit(i))
    padded = F.rpad(F.translate(part, "-_", "+/"), (F.ceil(F.length(part) / 4) * 4).cast("int"), F.lit("="))
    return F.when(F.size(F.split(c, r"\.")) == 3, F.decode(F.unbase64(padded), "UTF-8"))


def jwt_header(c: Column) -> Column:
    """The JSON of a token's first part; null unless the token has three parts. The signature isn't checked."""
    return _jwt_part(c, 1)


def jwt_payload(c: Column) -> Column:
    return _jwt_part(c, 2)


#: Milliseconds from 1970 to 2020, from which time-sorted ids count (fixed value).
TSID_EPOCH = 1577836800000


def tsid_from_timestamp(c: Column, tail: Column) -> Column:
    """A 64-bit id: milliseconds since 2020 in the upper bits, 22 bits of tail."""
    ms = F.unix_millis(c.cast("timestamp")) - F.lit(TSID_EPOCH)
    return F.shiftleft(ms, 22).bitwiseOR(tail.cast("long").bitwiseAND(F.lit((1 << 22) - 1).cast("long")))


def tsid_timestamp(c: Column) -> Column:
    return F.timestamp_millis(F.shiftrightunsigned(c, 22) + F.lit(TSID_EPOCH))


def tsid_encode(c: Column) -> Column:
    """13 letters of 5 bits, highest first."""
    letters = F.split(F.lit(B32), "")
    return F.array_join(F.transform(F.sequence(F.lit(60), F.lit(0), F.lit(-5)), lambda k: F.get(letters, F.call_function("shiftrightunsigned", c, k).bitwiseAND(F.lit(31).cast("long")).cast("int"))), "")


def tsid_decode(c: Column) -> Column:
    """Null unless the text has 13 letters of the alphabet."""
    value = F.aggregate(F.split(F.upper(c), ""), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 5).bitwiseOR((F.instr(F.lit(B32), x) - 1).cast("long")))
    return F.when(F.upper(c).rlike(f"^[{B32}]{{13}}$"), value)


#: Signatures of files by their first bytes in hex (fixed values): mime type and extension.
SIGNATURES = [
    ("89504E470D0A1A0A", "image/png", "png"), ("FFD8FF", "image/jpeg", "jpg"), ("474946383761", "image/gif", "gif"), ("474946383961", "image/gif", "gif"),
    ("424D", "image/bmp", "bmp"), ("25504446", "application/pdf", "pdf"), ("504B0304", "application/zip", "zip"), ("1F8B", "application/gzip", "gz"),
    ("7F454C46", "application/x-elf", "elf"), ("0061736D", "application/wasm", "wasm"), ("50415231", "application/vnd.apache.parquet", "parquet"),
]


def _signature(c: Column, k: int) -> Column:
    head, out = F.hex(F.substring(c, 1, 8)), F.lit(None).cast("string")
    for row in reversed(SIGNATURES):
        out = F.when(F.startswith(head, F.lit(row[0])), F.lit(row[k])).otherwise(out)
    return out


def magic_mime(c: Column) -> Column:
    return _signature(c, 1)


def magic_extension(c: Column) -> Column:
    return _signature(c, 2)


def magic_matcher_type(c: Column) -> Column:
    """The kind of thing that the signature stands for: image, archive, document, application."""
    mime = magic_mime(c)
    archive, document = mime.isin("application/zip", "application/gzip"), mime == "application/pdf"
    return F.when(archive, "archive").when(document, "document").otherwise(F.substring_index(mime, "/", 1))


def is_image(c: Column) -> Column:
    return F.coalesce(F.startswith(magic_mime(c), F.lit("image/")), F.when(c.isNotNull(), F.lit(False)))
