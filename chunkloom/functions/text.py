"""Text, hash and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name spaces of version-5 identifiers.
NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
NAMESPACE_OID = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"


# White space in Unicode's sense.
BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def utrim(text: Column) -> Column:
    """Without the white space, in Unicode's sense, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def uwords(text: Column) -> Column:
    """The words between Unicode white space; none for a blank text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def uuid5(namespace: Column | str, name: Column) -> Column:
    """Version-5 UUID: SHA-1 of name space and name with the version and variant bits set."""
    space = F.lit(namespace) if isinstance(namespace, str) else namespace
    h = F.sha1(F.concat(F.unhex(F.replace(space, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


def byte_offset(text: Column, part: Column) -> Column:
    """Bytes of UTF-8 before the first occurrence of ``part``; 0 where it doesn't occur."""
    at = F.position(part, text)
    return F.when(at > 0, F.octet_length(F.substring(text, F.lit(1), at - 1))).otherwise(0)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def table_likely(text: Column) -> Column:
    """Text that looks like a table: over three lines of over three cells, or the word and over five lines of four words."""
    lines = F.split(text, "\n")
    cells = F.size(F.filter(lines, lambda x: F.size(F.split(x, r"\|")) > 3)) > 3
    named = text.contains("TABLE ") | text.contains("Table ") | text.contains("table:")
    return cells | (named & (F.size(F.filter(lines, lambda x: F.size(uwords(x)) >= 4)) > 5))


def secret_findings(text: Column) -> Column:
    """Names of the secret patterns found: access key id, private key with a type word."""
    return F.array_compact(
        F.array(
            F.when(text.rlike(r"(?i)AKIA[0-9A-Z]{16}"), "aws_access_key"),
            F.when(text.rlike(r"-----BEGIN [A-Z ]+ PRIVATE KEY-----"), "private_key"),
        )
    )
