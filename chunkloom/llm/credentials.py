"""Credentials in source and configuration text: found by unnatural strings in context, redacted in place."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import flat_rows
from .vocab import TOKENIZERS, encoding

#: Characters per subword from which a value under a credential's name is natural text; free-standing keys and header values must stay under the second one.
NATURAL, UNNATURAL = 2.9, 2.6
#: Characters a secret has at least.
LEAST = 6

#: A string that may be a secret: no blanks, quotes or brackets.
_RUN = re.compile(r"""[^\s"'`<>()\[\]{},;]{6,}+""")
_ACCESS_ID = re.compile(r"(?<![A-Za-z0-9+/])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9+/])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_JWT = re.compile(r"(?<![\w/+])ey[AJ][A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_URL = re.compile(r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{0,30}://[^\s:/@\"'<>]*:([^\s@\"'/]+)@(?=[\w\[])", re.I)
_HEADER = re.compile(r"(?i)\b(?:bearer|basic)\s+([A-Za-z0-9+/=._~-]{8,})")
_NAME = re.compile(
    r"""(?<![\w.-])(?P<name>[^\W\d][\w.-]*+)\\?["']?(?P<sep>\]?\s*(?::\s*[&\w' ]{1,24}?\s*=(?!=)|:=|=>|=(?!=)|:(?!:))\s*|\s+value=|\s+is\s+|>|\s+(?=["']))"""
)
_FLAG = re.compile(r"(?<!\S)--?(?P<name>[^\W\d_][\w-]*+)(?P<sep>[ =]+)")
_USER = re.compile(r"(?:(?<=\s)-u|--user)[\s=]+['\"]?[\w.@-]+:([^\s'\"<>]+)")
_WORDED = re.compile(r"(?i)\b(?:log ?in|sign in|authenticate|connect)\w* as \S+ (?:with|using) (\S+)|\b(?:pw|pwd|pass|passwd|password|passphrase|secret|token)\b (?:for|of|to)\b[^:=\n]{0,60}[:=]\s*(\S+)")
_MORE = re.compile(r"""["'`][ \t]*[+.\\]?[ \t]*(?:\r?\n[ \t]*)?[+.]?[ \t]*(?=["'`])(["'`])([^"'`\n]*)(?=\1)""")
_BODY = re.compile(r"[_-]([A-Za-z0-9+/]{20,}+={0,2})(?![A-Za-z0-9+/_-])")
_PREFIX = re.compile(r"(?<![\w/+.-])([a-z]{2,5})(?:_(?:live|prod|production|staging|secret|key))?$")
_QUOTED = re.compile(r"""(?:[rbuf]|\w{0,20}\([ \t]*)?\\?(["'`])(?P<value>(?:\\.|(?!\1)[^\\\n])*)\1?""")
_BARE = re.compile(r"""[^\s"'`,;&<>(){}\[\]|\\]+""")
_ANY_WORDS = re.compile(r"[^\W\d_]+|\d+")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# Last words of names that hold a credential, in several languages, and what may stand before "key".
_CREDENTIAL = {"password", "passwd", "pwd", "pw", "pass", "passphrase", "passwort", "kennwort", "losungswort", "contraseña", "contrasena", "senha", "mdp", "motdepasse", "wachtwoord", "lösenord", "hasło", "haslo", "parola", "salasana", "пароль", "密码", "密碼", "パスワード", "비밀번호", "secret", "token", "apikey", "auth", "authorization", "bearer", "credential", "credentials", "secretkey", "accesskey", "privatekey", "authtoken"}
_KEYS = {"api", "access", "secret", "private", "storage", "signing", "encryption", "auth", "account", "shared", "master", "client", "service", "license", "webhook", "session", "app", "application", "hmac", "jwt", "ssh", "deploy", "tls", "aws", "admin", "function", "subscription"}
_PLACEHOLDER = re.compile(
    r"""(?ix) ^(?: | change[_-]?(?:me|it|this) .* | (.)\1{3,} | your[_-]?.* | my[_-](?:secret|password|token|key).* | <.* | \$.* | \{\{.* | %.*%? \b(?<=%) | \#\{.* | \*+ | x{3,} | \.{2,}
      | env[:.(].* | process\.env.* | os\.environ.* | vault[:/].* | secrets?[:.]//?.* | file[:/].* | (?:arn|ssm|op|sops|kms|gcp|azure|secretsmanager|keyvault|keychain)[:/].* | enc\[.*
      | @.* | \[.* | .*\bexample\b.* | .*(?:placeholder|redacted|replace[_-]?me|to[_-]?be[_-]?set|insert[_-].*here|-here>?$).* | n/?a | none | null | nil | undefined | true | false | todo.* | dummy.* | test | fake.* | sample.* )$"""
)
_REFERENCE = re.compile(r"^(?:[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[~.]{0,2}/[\w.-]+(?:/[\w.-]+)+|[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)+\(?|[a-z]+://[^@]*|[\w./-]+\.(?:pem|key|txt|json|ya?ml|env|crt|cer|conf))$")


@lru_cache(1 << 16)
def is_credential_name(name: str) -> bool:
    """Whether a name, in any case style, is that of a credential itself (not of its file, field, length or id)."""
    words = [w.lower() for w in (_WORDS if name.isascii() else _ANY_WORDS).findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words:
        return False
    if words[-1] in _CREDENTIAL:
        return words[:-1][-1:] not in (["max"], ["csrf"], ["next"], ["page"])
    if words[-1] == "key":
        return len(words) > 1 and words[-2] in _KEYS
    return words[-1] == "ref" and len(words) > 1 and words[-2] in ("credential", "credentials")


def subword_length(text: str, folder: str = TOKENIZERS) -> float:
    """Characters per subword of the public vocabulary; about 4 to 6 for words, under 2.6 for random strings."""
    own = encoding(folder=folder)
    return len(text) / max(1, sum(len(own.encode_ordinary(text[at : at + 128])) for at in range(0, len(text), 128)))


@lru_cache(1 << 17)
def is_unnatural(value: str, folder: str = TOKENIZERS) -> bool:
    """Whether a string has fewer than ``NATURAL`` characters per subword, so that it may be a secret."""
    return subword_length(value, folder) < NATURAL


def is_literal(value: str, folder: str = TOKENIZERS) -> bool:
    """Whether a value under a credential's name is a literal one: unnatural, and no placeholder or reference.

    A reference, to a variable or file say, has at most one digit; of two and more the
    measure alone decides. Letters of one case alone are a word, however rare.
    """
    bare = value.rstrip(".")
    if len(value) < LEAST or " " in value.strip() or not is_unnatural(value, folder) or _PLACEHOLDER.match(value):
        return False
    if bare.isalpha() and (bare.islower() or bare.isupper()):
        return False
    return not _REFERENCE.match(value) or sum(c.isdigit() for c in value) > 1


@lru_cache(1 << 12)
def _is_word(text: str, folder: str) -> bool:
    return len(text) > 2 and len(encoding(folder=folder).encode_ordinary(" " + text)) == 1


def prefixed_keys(text: str, folder: str = TOKENIZERS) -> list[tuple[int, int]]:
    """Offsets of issued keys: a short prefix that is no word, perhaps its environment, and a long random body."""
    found = []
    for m in _BODY.finditer(text):
        prefix = _PREFIX.search(text, max(0, m.start() - 20), m.start())
        if prefix and not _is_word(prefix[1], folder):
            body = m[1]
            if any(c.isdigit() for c in body) and any(c.isalpha() for c in body) and subword_length(body, folder) < UNNATURAL and text[m.end() : m.end() + 1] not in (":", "."):
                found.append((prefix.start(), m.end()))
    return found


def _lines(text: str, folder: str) -> list[tuple[int, int]]:
    """Bounds of the lines that hold an unnatural string or the head of a private key, in order."""
    found: list[tuple[int, int]] = []
    at = 0
    while m := _RUN.search(text, at):
        at = m.end()
        if m[0].isdigit() or not (is_unnatural(m[0], folder) or m[0].startswith("-----BEGIN")):
            continue
        at = text.find("\n", at)
        at = len(text) if at < 0 else at
        found.append((text.rfind("\n", 0, m.start()) + 1, at))
    return found


def spans(text: str, folder: str = TOKENIZERS, continued: bool = False) -> list[tuple[int, int]]:
    """Offsets (start, end) of the literal credentials of a text, in order, not overlapping.

    Candidates are the unnatural strings; only their lines are looked at. The context
    then tells which of them are credentials: the name they are given to, a header, a
    URL, a flag, the shape of an issued key.
    With ``continued`` the further literals that a credential is joined of come along.
    """
    found: list[tuple[int, int]] = []
    done = -1
    issued = prefixed_keys(text, folder)
    for begin, end in _lines(text, folder):
        if begin < done:
            continue
        line = text[begin:end]
        own: list[tuple[int, int]] = []
        if "PRIVATE KEY" in line and (m := _PEM.search(line)):
            stop = _PEM_END.search(text, begin + m.end())
            until = stop.start() if stop and "BEGIN" not in text[begin + m.end() : stop.start()] else end
            found.append((begin + m.start(), until))
            done = until
            continue
        own += [(a - begin, b - begin) for a, b in issued if begin <= a < end]
        own += [m.span() for m in _ACCESS_ID.finditer(line) if "EXAMPLE" not in m[0]]
        if "eyJ" in line or "eyA" in line:
            own += [m.span() for m in _JWT.finditer(line)]
        if "://" in line and "@" in line:
            own += [m.span(1) for m in _URL.finditer(line) if not _PLACEHOLDER.match(m[1]) and m[1].lower() not in ("password", "pass", "pwd", "secret", "token")]
        own += [m.span(1) for m in _HEADER.finditer(line) if not _PLACEHOLDER.match(m[1]) and any(c.isdigit() for c in m[1]) and subword_length(m[1], folder) < UNNATURAL]
        if " -u" in line or "--user" in line:
            own += [m.span(1) for m in _USER.finditer(line) if is_literal(m[1], folder)]
        for m in _WORDED.finditer(line):
            k = 1 if m[1] else 2
            value = m[k].rstrip("\"',;.*/")
            if sum(c.isdigit() for c in value) > 1 and is_literal(value, folder):
                own.append((m.start(k), m.start(k) + len(value)))
        for pattern in (_NAME, _FLAG):
            at = 0
            while m := pattern.search(line, at):
                at = m.end("name") + 1
                name = m["name"]
                if not is_credential_name(name):
                    continue
                value = _QUOTED.match(line, m.end())
                if value and value.start("value") > m.end() + 24:
                    value = None
                if value:
                    span = value.span("value")
                else:
                    bare = _BARE.match(line, m.end())
                    if not bare or line[bare.end() : bare.end() + 1] in ("(", "["):
                        continue
                    span = bare.span()
                raw = line[slice(*span)].rstrip("\\")
                if m["sep"].strip() == "is" and not any(c.isdigit() for c in raw):
                    continue  # a sentence about credentials
                if re.match(r"(?i)(?:bearer|basic)\s", raw):
                    continue  # the header rule has it
                if is_literal(raw, folder):
                    own.append((span[0], span[0] + len(raw)))
        last = -1
        for a, b in sorted(own):
            if a >= last:
                found.append((begin + a, begin + b))
                last = b
                at = begin + b
                while continued and (m := _MORE.match(text, at)):
                    found.append(m.span(2))
                    at = m.end()
                    last = max(last, at - begin)
    return found


def redacted(text: str, folder: str = TOKENIZERS) -> str:
    """The text with every secret value blanked by as many asterisks; line breaks, and with them all offsets, stay."""
    out, at = [], 0
    for a, b in spans(text, folder, True):
        out += [text[at:a], re.sub(r"[^\s]", "*", text[a:b])]
        at = b
    return "".join(out) + text[at:]


def credential_lines(chunks: DataFrame, chunk_id: str = "chunk_id", content: str = "content", folder: str = TOKENIZERS) -> DataFrame:
    """(chunk_id, line_no) of every line on which a literal credential begins, without repeats.

    Lines are counted from 1 and split at line feeds. Null and blank contents give
    nothing, rows repeated are reported once, a null chunk_id is reported as null;
    other columns aren't read. A long content is scanned once, line by line.
    """

    def one(key: str, text: str) -> Iterator[tuple]:
        at, line = 0, 1
        last = 0
        for a, _ in spans(text, folder):
            line += text.count("\n", at, a)
            at = a
            if line != last:
                yield key, line
            last = line

    rows = chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(content).alias("content")).where("content IS NOT NULL")
    return flat_rows(rows, ["chunk_id", "content"], "chunk_id string, line_no int", one).distinct()


def redact_chunks(chunks: DataFrame, content: str = "content", folder: str = TOKENIZERS) -> DataFrame:
    """The same rows with ``content`` redacted, of the same length; nulls stay null."""

    @F.pandas_udf("string")
    def blank(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: redacted(t, folder) if t else t, na_action="ignore")

    return chunks.withColumn(content, blank(F.col(content)))
