"""Files nobody wrote by hand: generated, minified, vendored, or data saved as code."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import cut
from .scans import plain_words
from .vocab import TOKENIZERS

#: Tokens of a shingle, rows of a band and bands of a signature; a pair of similarity 0.8 shares a band with probability 0.9998.
SHINGLE, ROWS, BANDS = 5, 4, 16
#: Least Jaccard similarity of a link, as a fraction.
SIMILARITY = (4, 5)
#: Members of a bucket above which it is compared block by block, so that a task holds no more at a time.
HOT = 8_192
#: Shingles a chunk must have to be compared, members and share of evidence that make a family's word count.
LEAST_SHINGLES, LEAST_MEMBERS, SHARE = 12, 3, 0.6
#: Lines at the top of a file in which a banner counts.
HEAD = 12

#: Share and number of files with a telling path from which a line of heads is a banner, the share expected of any line, and how many
#: standard deviations lie between: a corpus has very many lines, so a few files alike by chance must not be enough.
BANNER_SHARE, BANNER_FILES, ANY_SHARE, DEVIATIONS = 0.15, 5, 0.1, 6.0

# Phrases of banners that tell on a file without a family, in several languages.
_GENERATED = re.compile(
    r"(?i)@generated\b|<auto-?generated|\bcode generated\b|\bauto(?:matically)?[ -]?generated\b|\bgenerated (?:by|from|with|on|using|file)\b|\bdo not (?:edit|modify)\b|\b(?:edits?|(?:manual )?changes?) (?:are|will be) (?:overwritten|lost)\b"
    r"|maschinell erzeugt|automatisch (?:generiert|erzeugt|erstellt)|nicht (?:bearbeiten|ändern)|généré (?:automatiquement|par)|ne pas (?:modifier|éditer)|generado (?:automáticamente|por)|no (?:editar|modificar)"
    r"|сгенерирован|не редактировать|自動生成|编辑しない|自动生成|请勿(?:编辑|修改)"
)
_BY_HAND = re.compile(r"(?i)by hand|hand-?written|do not regenerate|not generated")
_VENDORED = re.compile(r"(?i)\bbundled copy\b|\bcopied (?:unchanged|verbatim|as is|without changes)|\bvendored\b|\bthird[- ]party (?:copy|code|source)|\bupstream (?:tree|project|at|repo\w*|source)\b|\breleased under the \S+ [\w ]*licen[cs]e|\blicensed under the\b.*\blicen[cs]e\b|\(c\) the \S+ authors|\bredistributions? (?:permitted|of source|and use)|\bcopyright (?:\(c\) )?\d{4}(?:-\d{4})?,? (?:the )?\S+ (?:contributors|authors|project)\b")
_FOREIGN_FOLDER = re.compile(r"(?i)(?:^|/)(?:vendors?|vendored|third[_-]?party|3rd[_-]?party|externals?|extern|deps|node_modules|bower_components|jspm_packages|pods|carthage|site-packages|godeps|bundled|contrib)/|/[a-z][\w.]*-\d+\.\d+(?:\.\d+)?/")
_TOOL_NAME = re.compile(
    r"(?i)(?:^|/)(?:generated|autogen|__generated__|gen-src)/|[._-](?:pb|pb2|pb2_grpc|g|gen|generated|designer|autogen)\.[a-z]+$|[._](?:pb|grpc)\.[a-z]+\.[a-z]+$|(?:^|/)zz_generated|_pb2?\.[a-z]+$"
    r"|(?:^|/)(?:[\w-]+[.-])?lock\.(?:json|ya?ml)$|\.lock$|(?:^|/)(?:package-lock\.json|pnpm-lock\.yaml|npm-shrinkwrap\.json|go\.sum)$|[.-](?:min|bundle|chunk|packed)\.[a-z]+$|\.[0-9a-f]{7,20}\.(?:js|css|mjs)$|\.(?:js|css)\.map$"
)
_NO_BANNER = re.compile(r"^\s*#(?:!|\s*(?:include|define|if|end|pragma)\b)")
_HEAD_TOKEN = re.compile(r"[^\W_](?:[\w./:-]*\w)?|[^\w\s]")
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|--|<!--|;|\"\"\"|%|')")
_QUOTED = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_STRIP = re.compile(r"(?m)^[ \t]*(?://|#(?!\s*(?:include|define|if|end))|--|/\*|\*|<!--).*$")
# Words of programming languages that aren't masked.
_KEYWORDS = frozenset(
    "and as async await begin bool break case catch char class const continue create def default del do double elif else end enum except export extends false final finally float fn for from func function go group if impl "
    "implements import in include insert int interface into is let long loop match mod namespace new nil none not null or order package pass private protected pub public raise return select self set size_t static str string struct "
    "super switch table then this throw true try type typedef union update use using var void when where while with yield".split()
)
_SALTS = np.array([(2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for k in range(1, ROWS * BANDS + 1)], np.uint64)


#: What stands for a string literal and between two texts while they are masked; both are control characters, which no form holds otherwise.
_LITERAL, _END = "\x01", "\x02"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Weights of the letters of a word by their place, so that words are told by one number.
_PLACES = np.array([pow(0x100000001B3, k + 1, 1 << 64) for k in range(16)], np.uint64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Numbers of the words that aren't masked, in order, and the letters that stand for them.
_KNOWN = {int((_points(w) * _PLACES[: len(w)]).sum(dtype=np.uint64)): chr(0x100 + k) for k, w in enumerate(sorted(_KEYWORDS))}
_KNOWN_CODES = np.array(sorted(_KNOWN), np.uint64)
_KNOWN_LETTERS = np.array([ord(_KNOWN[k]) for k in sorted(_KNOWN)], np.uint32)


def _word_points(points: np.ndarray) -> np.ndarray:
    """Which code points are letters, digits, underscores or dollar signs."""
    low = np.minimum(points, 0x7F)
    out = _ASCII_WORD[low]
    far = np.flatnonzero(points > 0x7F)
    if len(far):
        kinds, at = np.unique(points[far], return_inverse=True)
        out[far] = np.array([chr(k).isalnum() for k in kinds])[at]
    return out


_ASCII_WORD = np.array([chr(k).isalnum() or chr(k) in "_$" for k in range(128)])
_ASCII_BLANK = np.array([chr(k).isspace() or chr(k) == "\0" for k in range(128)])
_ASCII_LOWER = np.array([ord(chr(k).lower()) for k in range(128)], np.uint64)


def masked(texts: list[str]) -> list[tuple[str, float]]:
    """Form and share of literal characters of each text.

    The form has one letter per token: S for a string, N for a number, I for an
    identifier, one letter for each word of ``_KEYWORDS`` in any case; signs stand for
    themselves and blanks are left out. All texts are masked in one go: runs of word
    characters are found by comparing neighbours, their words by one sum each.
    """
    bare = [_QUOTED.sub(_LITERAL, t.replace(_LITERAL, " ").replace(_END, " ")) for t in texts]
    strings = [t.count(_LITERAL) for t in bare]
    in_strings = [len(t) - len(b) + n for t, b, n in zip(texts, bare, strings, strict=True)]
    points = _points(_END.join([*bare, ""]))
    if not len(points):
        return []
    word = _word_points(points)
    digit = (points >= 48) & (points <= 57)
    dots = np.flatnonzero(points == 46)
    dots = dots[(dots > 0) & (dots < len(points) - 1)]
    word[dots[digit[dots - 1] & digit[dots + 1]]] = True  # a decimal point belongs to its number
    before = np.concatenate([[False], word[:-1]])
    blank = _ASCII_BLANK[np.minimum(points, 0x7F)] & (points <= 0x7F) | (points == 0xA0) | (points == 0x3000)
    starts = np.flatnonzero(word & ~before)
    inside = np.flatnonzero(word)
    run = np.cumsum((word & ~before)[inside]) - 1
    place = inside - starts[run]
    letter = np.where(points[inside] <= 0x7F, _ASCII_LOWER[np.minimum(points[inside], 0x7F)], points[inside].astype(np.uint64))
    first = np.searchsorted(run, np.arange(len(starts)))
    sizes = np.diff(np.concatenate([first, [len(inside)]]))
    codes = np.add.reduceat(letter * _PLACES[np.minimum(place, 15)], first) if len(starts) else np.empty(0, np.uint64)
    at = np.minimum(np.searchsorted(_KNOWN_CODES, codes), len(_KNOWN_CODES) - 1)
    letters = np.where(digit[starts], ord("N"), ord("I")).astype(np.uint32)
    letters = np.where((_KNOWN_CODES[at] == codes) & (sizes <= 16), _KNOWN_LETTERS[at], letters)
    out = points.copy()
    out[starts] = letters
    size = np.ones(len(points), np.int64)
    size[starts] = sizes
    size[points == 1] = 0
    kept = ~blank & (~word | (word & ~before))
    out, size = out[kept], size[kept]
    ends = np.flatnonzero(out == 2)
    out[out == 1] = ord("S")
    literal = size * np.isin(out, _LITERAL_LETTERS)
    size[ends] = 0
    all_of, literal_of = (np.concatenate([[0], np.cumsum(x)]) for x in (size, literal))
    form = out.tobytes().decode("utf-32-le", "surrogatepass")
    result, begin = [], 0
    for k, end in enumerate(ends.tolist()):
        total = int(all_of[end] - all_of[begin]) + in_strings[k]
        result.append((form[begin:end], (int(literal_of[end] - literal_of[begin]) + in_strings[k]) / max(1, total)))
        begin = end + 1
    return result


_LITERAL_LETTERS = np.array([ord(c) for c in "N,[]"], np.uint32)


def _shingle_codes(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, owner): the 64-bit codes of all shingles of all forms, repeats included, in the order of the forms."""
    sizes = np.array([len(f) for f in forms])
    codes = _points("".join(forms)).astype(np.uint64) * _MULTIPLIER
    codes ^= codes >> np.uint64(29)
    n = len(codes) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    mixed = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        mixed = mixed * np.uint64(0x100000001B3) ^ codes[k : k + n]
    owner = np.repeat(np.arange(len(forms)), sizes)
    whole = owner[:n] == owner[SHINGLE - 1 :]
    return mixed[whole], owner[:n][whole]


def shingle_sets(forms: list[str]) -> list[np.ndarray | None]:
    """The set of shingles of each form as sorted codes; none for a form with too few."""
    codes, owner = _shingle_codes(forms)
    until = np.searchsorted(owner, np.arange(len(forms) + 1)).tolist()
    found = [np.unique(codes[a:b]) if b - a >= LEAST_SHINGLES else codes[:0] for a, b in itertools.pairwise(until)]
    return [f if len(f) >= LEAST_SHINGLES else None for f in found]


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of a set of shingles."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        mixed = found[at : at + 4096, None] * _SALTS
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, mixed.min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def head_lines(text: str, known: frozenset[str]) -> list[str]:
    """Forms of the comment lines at the top of a text: numbers and names masked, other words in lower case.

    A word with a digit is a number, one with a dot, slash or other sign within it is a
    name. Of a line mostly of vocabulary words there is a second form in which all
    other words are names, too. Lines of fewer than three words have none.
    """
    found = []
    for line in text.split("\n", HEAD)[:HEAD]:
        if not _COMMENT.match(line) or _NO_BANNER.match(line):
            continue
        tokens = [t if not t[0].isalnum() else "N" if any(c.isdigit() for c in t) else "I" if not t.isalpha() else t.lower() for t in _HEAD_TOKEN.findall(line.strip().strip("/*#-<>! \t\r;%\"'"))]
        words = [t for t in tokens if t.isalpha() and t not in "IN"]
        if len([t for t in tokens if t[0].isalnum()]) < 3 or not words:
            continue
        found.append(" ".join(tokens))
        strange = {w for w in words if len(w) > 2 and w not in known}
        if strange and 2 * len(strange) <= len(words):
            found.append(" ".join("I" if t in strange else t for t in tokens))
    return found


def shape(text: str, share: float) -> str | None:
    """'blob' or 'minified' where the form of the text says so."""
    lines = text.split("\n")
    longest = max(lines, key=len)
    visible = sum(map(len, text.split()))
    if share > 0.85 and visible > 600 or share > 0.7 and visible > 1500:
        return "blob"
    if len(longest) > 400 and len(longest) > 0.4 * len(text):
        if max(map(len, _STRING.findall(longest)), default=0) > len(longest) // 2:
            return None  # one long literal, a key say, among hand-written lines
        blanks = longest.count(" ") + longest.count("\t")
        return "minified" if blanks < 0.09 * len(longest) else None
    return None


def evidence(text: str, head: bool, share: float) -> str | None:
    """What the text of a chunk itself tells: generated, vendored, minified, blob or nothing."""
    if head:
        for line in text.split("\n", HEAD)[:HEAD]:
            if _COMMENT.match(line):
                if _BY_HAND.search(line):
                    return None
                if _GENERATED.search(line):
                    return "generated"
                if _VENDORED.search(line.strip().strip("/*#-<>! ")):
                    return "vendored"
    return shape(text, share)


def chunk_features(chunks: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row per chunk: own evidence, whether it is literals, digest of the bare text, form and 64-bit id of its set of shingles (null for too few), ids of its head lines."""
    schema = "source_id string, filename string, own string, literal boolean, bare binary, shape bigint, form string, lines array<bigint>"
    kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary(), pa.int64(), pa.string(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = plain_words(folder=folder)
        for batch in batches:
            given = list(zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True))
            for some in _portions(given, 1 << 20):
                plain = [_STRIP.sub("", text) for _, _, text, _, _ in some]
                forms = masked(plain)
                rows = []
                sets = shingle_sets([form for form, _ in forms])
                for (source, name, text, start, index), bare, (form, share), found in zip(some, plain, forms, sets, strict=True):
                    of = None if found is None else int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)
                    bare = " ".join(bare.split())
                    digest = hashlib.blake2b(bare.encode("utf-8", "replace"), digest_size=16).digest() if text.count("\n") >= 15 and len(bare) > 300 else None
                    head = index == "0" or not start or start == 1
                    lines = [int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for x in head_lines(text, known)] if head else []
                    rows.append((source, name, evidence(text, head, share), share > 0.8, digest, of, None if of is None else form, lines))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["source_id", "filename", "own", "literal", "bare", "shape", "form", "lines"])

    index = F.coalesce(F.get(F.map_values(F.map_filter("metadata", lambda k, _: k == "chunk_index")), F.lit(0)), F.lit(""))
    rows = chunks.where("content IS NOT NULL AND filename IS NOT NULL").select("source_id", "filename", "content", F.col("start_line").cast("int").alias("start_line"), index.alias("chunk_index"))
    return rows.mapInArrow(run, schema)


def _portions(rows: list[tuple], characters: int) -> Iterator[list[tuple]]:
    """The rows in runs of about so many characters of text, at least one row each."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[2])
        if size >= characters:
            yield some
            some, size = [], 0
    if some:
        yield some


def bucket_links(forms: list[str]) -> list[tuple[int, int]]:
    """Links whose components are those of all pairs of ``forms`` whose sets of shingles have Jaccard >= 0.8.

    Each set is a row of bits over the shingles of the bucket, so an intersection is
    the count of common bits. Components are grown from their first member: what is
    reached is compared with all that isn't reached yet, so each member is linked once.
    """
    codes, owner = _shingle_codes(forms)
    values, at = np.unique(codes, return_inverse=True)
    words = -(-max(1, len(values)) // 64)
    bits = np.empty((len(forms), words), np.uint64)
    until = np.searchsorted(owner, np.arange(len(forms) + 1))
    for low in range(0, len(forms), 256):
        high = min(low + 256, len(forms))
        flags = np.zeros((high - low, words * 64), np.uint8)
        own = slice(until[low], until[high])
        flags[owner[own] - low, at[own]] = 1
        bits[low:high] = np.packbits(flags, axis=1).view(np.uint64)
    sizes = np.bitwise_count(bits).sum(1, dtype=np.int64)
    links: list[tuple[int, int]] = []
    left = np.arange(len(forms))
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            one = reached.pop()
            common = np.bitwise_count(bits[left] & bits[one]).sum(1, dtype=np.int64)
            into = common * SIMILARITY[1] >= SIMILARITY[0] * (sizes[left] + sizes[one] - common)
            links += [(one, m) for m in left[into].tolist()]
            reached += left[into].tolist()
            left = left[~into]
    return links


def _buckets(reps: DataFrame) -> DataFrame:
    """(shape, bucket) of all bands of the signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for found in shingle_sets(batch.column(1).to_pylist()):
                bands = signature(found).reshape(BANDS, ROWS)
                keys += [int.from_bytes(hashlib.blake2b(bytes([b]) + bands[b].tobytes(), digest_size=8).digest(), "little", signed=True) for b in range(BANDS)]
            of = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([of, pa.array(keys, pa.int64())], names=["shape", "bucket"])

    return reps.select("shape", "form").mapInArrow(run, "shape bigint, bucket bigint")


def _links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (group, shape, form) that come sorted by group."""
    group, names, forms, out = None, [], [], []
    for batch in batches:
        for key, name, form in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if key != group:
                out += [(names[a], names[b]) for a, b in bucket_links(forms)] if len(forms) > 1 else []
                group, names, forms = key, [], []
            names.append(name)
            forms.append(form)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
            out = []
    out = [(names[a], names[b]) for a, b in bucket_links(forms)] if len(forms) > 1 else []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])


def families(features: DataFrame, hot: int = HOT) -> DataFrame:
    """(shape, family) of all shapes: components of the pairs that share a band and have Jaccard >= 0.8.

    Chunks of one set of shingles are one representative, so copies are never paired.
    Buckets of the same members are one. Every bucket gives the components of all its
    pairs, verified on the shingles; a bucket of more than ``hot`` members is spread
    over blocks, each pair of which is a group of its own.
    """
    reps = cut(features.where("shape IS NOT NULL").groupBy("shape").agg(F.min("form").alias("form")))
    bands = cut(_buckets(reps))
    same = [F.bit_xor(F.xxhash64("shape", F.lit(k))).alias(f"x{k}") for k in range(2)]
    kept = bands.groupBy("bucket").agg(F.count("*").alias("n"), *same).where("n > 1").groupBy("n", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    blocks = F.when(F.col("n") > hot, F.ceil(2 * F.col("n") / hot)).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64("shape"), F.col("blocks")).cast("int")
    members = bands.join(kept, "bucket").select("shape", "bucket", blocks.alias("blocks")).withColumn("own", own)
    pairs = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.least(k, F.col("own")) * F.col("blocks") + F.greatest(k, F.col("own")))
    )
    groups = members.select("shape", F.explode(F.transform(pairs, lambda p: F.xxhash64("bucket", p))).alias("group"))
    rows = groups.join(reps, "shape").select("group", "shape", "form").repartition("group").sortWithinPartitions("group", "shape")
    found = components(rows.mapInArrow(_links_of, "a bigint, b bigint"), "a", "b").withColumnRenamed("node", "shape")
    return reps.join(found, "shape", "left").select("shape", F.coalesce("root", "shape").alias("family"))


def path_kind(filename: Column) -> Column:
    """vendored or generated where the path of a file says so."""
    return F.when(filename.rlike(_FOREIGN_FOLDER.pattern), "vendored").when(filename.rlike(_TOOL_NAME.pattern), "generated")


def banner_families(lines: DataFrame) -> DataFrame:
    """(line, kind) of the head lines that are banners, from (source_id, filename, line), one row per file and line.

    A line is a family of files, whatever language it is in. Paths are the labels: if
    far more of its files have a telling path than of any line, the line is a
    banner, of the kind that most of those paths have; a vendored one must stand in
    several repositories. All files are counted; families and labels are one aggregate.
    """
    kind = path_kind(F.col("filename"))
    stats = lines.groupBy("line").agg(
        F.count("*").alias("n"), F.count_if(kind == "generated").alias("generated"), F.count_if(kind == "vendored").alias("vendored"), (F.min("source_id") != F.max("source_id")).alias("several")
    )
    told = F.col("generated") + F.col("vendored")
    sure = (told >= BANNER_FILES) & (told >= BANNER_SHARE * F.col("n")) & (told - ANY_SHARE * F.col("n") >= DEVIATIONS * F.sqrt(ANY_SHARE * (1 - ANY_SHARE) * F.col("n")))
    of = F.when(F.col("generated") >= F.col("vendored"), "generated").when(F.col("several"), "vendored")
    return stats.where(sure).select("line", of.alias("kind")).where("kind IS NOT NULL")


def not_handwritten(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, filename, kind) of code and configuration files that were generated, minified, vendored or are blobs.

    Evidence of a file: its path, its bytes per line, the banner or the shape of its
    chunks. Evidence of the files with the same head line: ``banner_families``. Evidence of its family, the chunks of similar masked shingles: literals
    only means blob; where most members are known to be generated inside one
    repository, or vendored across several, the rest is too; the same bare text in
    several repositories is a copy. A family of mixed or no evidence tells nothing,
    as hand-written code in one idiom looks alike once its names are masked.

    The newest report of a file holds (ties: the greatest type). Null names, sizes
    and contents give no evidence; repeated rows count once in the result.
    """
    key = ["source_id", "filename"]
    newest = (
        files.where("filename IS NOT NULL")
        .groupBy(*key).agg(F.max(F.struct("processed_at", F.lower("file_type").alias("file_type"), F.when(F.col("line_count") > 0, F.col("size_bytes") / F.col("line_count")).alias("width"))).alias("last"))
        .select(*key, F.col("last.file_type").alias("file_type"), F.col("last.width").alias("width")).where("file_type IN ('code', 'config')")
    )
    wanted = newest.select(F.col("source_id").alias("of"), F.col("filename").alias("name"))
    features = chunk_features(chunks)
    features = cut(features.join(wanted, F.col("source_id").eqNullSafe(F.col("of")) & (F.col("filename") == F.col("name")), "left_semi"))
    family = families(features)
    known = features.where("shape IS NOT NULL").drop("form", "lines").join(family, "shape")
    stats = known.groupBy("family").agg(
        F.count("*").alias("n"), (F.min("source_id") != F.max("source_id")).alias("several"), F.min(F.col("literal").cast("int")).alias("literal"),
        *[F.count_if(F.col("own") == k).alias(k) for k in ("generated", "vendored", "minified", "blob")],
    )
    known_share = lambda k: F.col(k) >= SHARE * F.col("n")
    verdict = (
        F.when(F.col("n") < LEAST_MEMBERS, None).when(F.col("literal") == 1, "blob").when(known_share("blob"), "blob").when(known_share("minified"), "minified")
        .when(known_share("generated"), "generated").when(known_share("vendored") & F.col("several"), "vendored")
    )
    by_family = known.join(stats.select("family", verdict.alias("kind")).where("kind IS NOT NULL"), "family").select(*key, "kind")
    copies = features.where("bare IS NOT NULL").groupBy("bare").agg(F.min("source_id").alias("a"), F.max("source_id").alias("b")).where("a <> b").select("bare")
    by_copy = features.join(copies, "bare").select(*key, F.lit("vendored").alias("kind"))
    by_text = features.where("own IS NOT NULL").select(*key, F.col("own").alias("kind"))
    lines = features.where(F.size("lines") > 0).select(*key, F.explode("lines").alias("line")).distinct()
    by_line = lines.join(banner_families(lines), "line").select(*key, "kind")
    told = by_text.unionByName(by_family).unionByName(by_line).unionByName(by_copy).groupBy(*key).agg(F.max("kind").alias("told"))
    path = path_kind(F.col("filename"))
    wide = F.when(F.col("width") > 250, "minified")
    told = told.select(F.col("source_id").alias("of"), F.col("filename").alias("name"), "told")
    same = F.col("source_id").eqNullSafe(F.col("of")) & (F.col("filename") == F.col("name"))
    joined = newest.join(told, same, "left").select(*key, F.coalesce(path, "told", wide).alias("kind"))
    return joined.where("kind IS NOT NULL")
