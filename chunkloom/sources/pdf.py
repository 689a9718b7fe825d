"""Text of simple PDF files without software of their own."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import UNREADABLE

_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]+>)|(T\*|Td|TD|Tm|ET|'|\")(?![\w*])", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
# Escapes of the format.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _unescaped(m: re.Match[bytes]) -> bytes:
    c = m[1]
    return bytes([int(c, 8) & 255]) if c[:1].isdigit() and c[:1] < b"8" else b"" if c.strip() == b"" else _ESCAPES.get(c, c)


def pdf_text(data: bytes | None) -> str | None:
    """The strings that the page contents show, a line per text line; none for a file without such strings.

    Reads literal and hexadecimal strings of plain and Flate streams. Encrypted files,
    fonts with codes of their own and scanned pages need a reader of their own.
    """
    if not data or not data.startswith(b"%PDF") or b"/Encrypt" in data:
        return None
    lines: list[str] = []
    for stream in _STREAM.finditer(data):
        body = stream["body"]
        if b"/FlateDecode" in stream["head"]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        for block in re.findall(rb"\bBT\b(.*?\bET\b)", body, re.S):
            line = b""
            for text, move in _SHOWN.findall(block):
                if text:
                    line += _ESCAPE.sub(_unescaped, text[1:-1]) if text[:1] == b"(" else bytes.fromhex(re.sub(rb"\s|.(?=$)" if len(re.sub(rb"\s", b"", text[1:-1])) % 2 else rb"\s", b"", text[1:-1]).decode())
                elif line:
                    lines.append(line.decode("utf-16-be" if line.startswith(b"\xfe\xff") else "latin-1", "replace"))
                    line = b""
    return "\n".join(lines) or None


class PdfReader:
    """A reader of PDF files (filename, data) as documents of one section; what can't be read is a placeholder."""

    def read(self, files: DataFrame) -> DataFrame:
        from ..functions.names import stem

        @F.pandas_udf("string")
        def text(data: pd.Series) -> pd.Series:
            return data.map(lambda d: pdf_text(None if d is None else bytes(d)))

        body = F.coalesce(text(F.col("data")), F.lit(UNREADABLE))
        section = F.struct(F.lit("Content").alias("heading"), F.lit(1).alias("level"), body.alias("content"))
        return files.select("filename", stem(F.col("filename")).alias("title"), F.array(section).alias("sections"), F.array().cast("array<struct<caption:string,markdown:string>>").alias("tables"))
