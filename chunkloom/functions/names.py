"""Classifiers of file names and identifiers, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language of an extension.
LANGUAGES = {
    "rs": "rust", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "py": "python", "go": "go", "java": "java", "c": "c", "h": "cpp", "hpp": "cpp", "hxx": "cpp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "cs": "c_sharp", "rb": "ruby", "php": "php", "swift": "swift",
    "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sc": "scala", "sh": "bash", "bash": "bash", "zsh": "bash", "html": "html", "htm": "html", "css": "css", "scss": "css", "less": "css", "md": "markdown", "markdown": "markdown",
}
# Display name of an extension.
DISPLAY = {
    "rs": "Rust", "py": "Python", "js": "JavaScript", "ts": "TypeScript", "go": "Go", "java": "Java", "cpp": "C++", "c": "C", "h": "C", "hpp": "C++", "rb": "Ruby", "php": "PHP", "swift": "Swift", "kt": "Kotlin", "scala": "Scala",
}
# Document type of an extension.
DOCUMENTS = {"pdf": "pdf", "docx": "docx", "doc": "doc", "html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "txt": "text", "rtf": "rtf"}
# MIME type of an extension.
MIME = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tiff": "image/tiff", "tif": "image/tiff", "webp": "image/webp", "bmp": "image/bmp", "gif": "image/gif"}
# Extensions that take the document route.
DOCUMENT_ROUTE = ("pdf", "docx", "pptx", "doc", "ppt", "rtf", "epub", "md", "markdown")
# Folders that a scan doesn't enter, besides hidden ones.
PRUNED = ("node_modules", "__pycache__", "target", "dist", "build")
# Relation types as (type, label, category).
RELATIONS = (
    ("FunctionCalls", "CALLS", "code"), ("ApiCalls", "API_CALLS", "code"), ("ClassInherits", "INHERITS", "code"), ("FileImports", "IMPORTS", "code"), ("ClassContainsMethod", "CONTAINS_METHOD", "code"),
    ("FunctionReferencesVariable", "REFERENCES", "code"), ("DefinedIn", "DEFINED_IN", "code"), ("Implements", "IMPLEMENTS", "code"), ("Tests", "TESTS", "code"), ("Instantiates", "INSTANTIATES", "code"),
    ("TypeReference", "TYPE_REF", "code"), ("Decorates", "DECORATES", "code"), ("ReferencedIn", "REFERENCED_IN", "document"), ("DocumentReferencesDoc", "LINKS_TO", "document"), ("HyperlinkReference", "HYPERLINKS_TO", "web"),
    ("CanonicalUrl", "CANONICAL_OF", "web"), ("ThreadReply", "REPLIES_TO", "conversation"), ("MentionReference", "MENTIONS", "conversation"), ("TopicContinuation", "CONTINUES_TOPIC", "conversation"),
    ("ForeignKeyRelation", "FOREIGN_KEY", "schema"), ("ApiEndpointUsesModel", "USES_MODEL", "schema"), ("ActionItemFromDecision", "ACTION_FROM_DECISION", "transcript"), ("QaPair", "ANSWERS", "transcript"),
    ("SpeakerTurnSequence", "FOLLOWED_BY", "transcript"), ("NextChunk", "NEXT_CHUNK", "hierarchy"), ("ParentChild", "PARENT_OF", "hierarchy"), ("Sibling", "SIBLING_OF", "hierarchy"), ("Configures", "CONFIGURES", "structural"),
    ("DependsOn", "DEPENDS_ON", "structural"), ("SameSource", "SAME_SOURCE", "structural"),
)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def extension(path: Column) -> Column:
    """Lower-case part behind the last dot of the file name; a leading dot alone doesn't make one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def language(path: Column) -> Column:
    return _lookup(LANGUAGES, extension(path))


def display_language(path: Column) -> Column:
    """By the last dot segment, so a bare name is its own extension; null if unknown."""
    return _lookup(DISPLAY, F.lower(F.element_at(F.split(path, r"\."), -1)))


def document_type(path: Column) -> Column:
    return F.coalesce(_lookup(DOCUMENTS, extension(path)), F.lit("unknown"))


def mime_type(path: Column) -> Column:
    return F.coalesce(_lookup(MIME, extension(path)), F.lit("application/octet-stream"))


def content_kind(path: Column) -> Column:
    """code, web or document of a file name."""
    return F.when(language(path).isNotNull(), "code").when(path.startswith("http"), "web").otherwise("document")


def chunk_type(path: Column) -> Column:
    """kind:semantic label of a fresh chunk."""
    kind = content_kind(path)
    return F.when(kind == "code", "code:File").when(kind == "web", "web:PageOverview").otherwise("doc:DocumentOverview")


def route(path: Column) -> Column:
    return F.when(extension(path).isin(*DOCUMENT_ROUTE), "document").otherwise("hybrid")


def kept_path(path: Column) -> Column:
    """Whether a recursive scan reaches a file: no segment is hidden or one of the pruned folders."""
    return ~F.exists(F.split(path, "/"), lambda s: s.startswith(".") | s.isin(*PRUNED))


def composite_id(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def composite_path(identifier: Column) -> Column:
    """File path of a composite id, 'unknown' where there is none."""
    return F.coalesce(F.nullif(F.split_part(identifier, F.lit("|"), F.lit(2)), F.lit("")), F.lit("unknown"))


def relation_label(text: Column) -> Column:
    """A free relation name as a label: letters, digits and underscores in upper case."""
    return F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}_]", ""))
