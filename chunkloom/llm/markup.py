"""Markup residue in extracted text: found as tags among words, converted to clean text."""

from __future__ import annotations

import bisect
import html
import itertools
import math
import re
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import flat_rows
from .pages import labelled_pages

# Element names of HTML and of its wiki extensions.
_ELEMENTS = (
    "a abbr address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup dd del details dfn div dl dt em "
    "embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark math meta "
    "nav nobr noscript nowiki object ol optgroup option p param picture pre q ref references s samp script section select small source span strike strong style sub "
    "summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr gallery syntaxhighlight includeonly noinclude onlyinclude"
)
# LaTeX commands that stand without an argument.
_BARE_COMMANDS = (
    "item hline toprule midrule bottomrule centering noindent newline newpage clearpage maketitle tableofcontents par quad qquad ldots dots cdots leq geq neq le ge ne "
    "approx equiv times cdot div pm infty sum prod int partial nabla rightarrow leftarrow Rightarrow to in subset cup cap forall exists alpha beta gamma delta epsilon "
    "theta lambda mu pi rho sigma tau phi omega Delta Sigma Omega bfseries itshape small large Large LaTeX TeX appendix label"
)

_TAG = rf"</?(?:{'|'.join(_ELEMENTS.split())})(?:\s[^<>]*|\s*)/?>"
#: (kind, a text without one of these holds none, pattern). The kinds are tried in this order at every place.
_KINDS: tuple[tuple[str, tuple[str, ...], re.Pattern[str]], ...] = (
    ("hidden", ("<",), re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?</\1\s*>|<!doctype[^>]*>")),
    ("fence", ("```", "~~~"), re.compile(r"(?m)^[ \t]{0,3}(?:`{3,}|~{3,})[^\n`]*$")),
    ("html", ("<",), re.compile(_TAG, re.I)),
    ("entity", ("&",), re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});")),
    ("autolink", ("<",), re.compile(r"<(?:https?|ftp|mailto):[^<>\s]+>")),
    ("environment", ("\\begin", "\\end"), re.compile(r"\\(?:begin|end)\s*\{[A-Za-z]+\*?\}(?:\{[^{}\n]*\}|\[[^\[\]\n]*\])*")),
    ("command", ("\\",), re.compile(rf"\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?(?=\{{)|\\(?:{'|'.join(_BARE_COMMANDS.split())})(?![A-Za-z\\])(?<!\w\w\\to)")),
    ("display", ("\\[", "\\]", "\\(", "\\)"), re.compile(r"\\[\[\]()](?=\s|[A-Za-z0-9\\^_{}=.,;]|$)")),
    ("escape", ("\\",), re.compile(r"(?<![\\\w:])(?<=[\w.}])?\\[%&_#$](?=\W|\w)|(?<=\w)\\[%&_#$]|(?<=\.)\\(?= )|\\\\(?=\s*(?:\n|$|\\hline))")),
    ("math", ("$",), re.compile(r"\$\$[^$]+\$\$|(?<![\w$\\])\$(?=[^\s$])(?:[A-Za-z]|[^$\n]{0,200}?[\\^_{}=+<>*/|-][^$\n]{0,200}?)(?<=\S)\$(?![\w$])")),
    ("image", ("![",), re.compile(r"!\[[^\]\n]*\](?:\([^)\n]*\)|\[[^\]\n]*\])")),
    ("link", ("](", "][", "]:"), re.compile(r"\[[^\[\]\n]+\]\([^()\s]+(?:\s+[\"'(][^\n]*?[\"')])?\)|(?<![\w\]])\[[^\[\]\n]+\]\[[^\[\]\n]*\]|(?m:^[ ]{0,3}\[[^\[\]\n]+\]:[ \t]*\S.*$)")),
    ("footnote", ("[^",), re.compile(r"\[\^[^\]\s]+\]")),
    ("wikilink", ("[[",), re.compile(r"\[\[(?![\s-])[^\[\]\n]+\]\]")),
    ("weblink", ("[http", "[ftp"), re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t][^\]\n]*)?\]")),
    ("template", ("{{",), re.compile(r"\{\{(?=[\w#:])(?:[^{}]|\{[^{}]*\})*\}\}")),
    ("magic", ("__",), re.compile(r"(?<!\w)__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION|NOINDEX|INDEX)__|(?<!\w)__(?=\S)[^_\n]*\s[^_\n]*(?<=\S)__(?!\w)")),
    ("quotes", ("''",), re.compile(r"'{2,5}(?=[^'\n]+'{2,5})|(?<=[^'\n\s=(,\[{])'{2,5}(?!')")),
    ("tablemark", ("{|", "|}", "|-", "!", "|+"), re.compile(r"(?m)^\{\|.*$|^\|\}|^\|-+[ \t]*$|^\|\+.*$|^!(?=.*!!|[ \t]+\S)")),
    ("heading", ("#", "=", "---"), re.compile(r"(?m)^[ ]{0,3}#{1,6}[ \t]+(?=\S)|^(={1,6})[ \t]*[^=\n][^\n]*?[ \t]*\1[ \t]*$|(?<=[^\n\r-])(?:\r?\n)(?:={3,}|-{3,})[ \t]*$")),
    ("rule", ("* *", "---", "___", "***"), re.compile(r"(?m)^[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")),
    ("task", ("[ ]", "[x]", "[X]"), re.compile(r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+\[[ xX]\](?=\s)")),
    ("quote", (">",), re.compile(r"(?m)^[ ]{0,3}>(?:[ \t]*>)*[ \t]+(?=[^\W\d_]|[\"'`*\[#(«“„¿¡-])")),
    ("strong", ("**",), re.compile(r"\*\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*\*")),
    ("strike", ("~~",), re.compile(r"~~(?=[^\s~])[^~\n]+(?<=[^\s~])~~")),
    ("code", ("`",), re.compile(r"`[^`\n]+`")),
    ("emphasis", ("*", "_"), re.compile(r"(?<![\w*\\])\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])[^_\n]*(?<=[^\s_])_(?![\w_])")),
    ("list", ("*", ";", ":"), re.compile(r"(?m)^\*{1,6}[ \t]+(?=[^\W\d_]|[\[`*'<\"«¿])|^;[^\s:;][^:\n]*:|^:{1,6}[ \t]*(?=[^\W\d_])|^[*#:]{2,6}[ \t]*(?=[^\W\d_])")),
)

_WORD = re.compile(r"\w+")
#: Marks whose lines are content wherever they stand: headings, lists, code and formulas.
_STRUCTURE = ("heading", "list", "task", "fence", "code", "math", "display", "environment", "command")
_STRUCTURE_TAG = re.compile(r"(?i)</?(?:h[1-6]|li|dt|dd|pre|code|math)\b")
_ITEM_LINE = re.compile(r"(?m)^[ \t]*(?:[-+*]|\d+[.)])[ \t]+\w")
#: Elements of HTML that are scored apart from the others: frames around the content, and inline marks of words.
_FRAME_TAG = re.compile(r"(?i)<(/?)(nav|footer|aside|form|button|select|menu|iframe)\b")
_INLINE_TAG = re.compile(r"(?i)</?(?:abbr|b|bdi|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|nobr|q|ref|s|samp|small|span|strike|strong|sub|sup|t[dhr]|tt|u|var|wbr)\b")
_ANCHOR_TAG = re.compile(r"(?i)</?a\b")

def marks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the markup of a text in order; where marks overlap, the one that starts first, then the earlier kind."""
    found = []
    for order, (kind, hints, pattern) in enumerate(_KINDS):
        if any(h in text for h in hints):
            for m in pattern.finditer(text):
                if m.end() > m.start() and (kind != "entity" or m[0][1] == "#" or m[0][1:] in html.entities.html5):
                    found.append((m.start(), order, m.end(), kind))
    out, at = [], 0
    for start, _, end, kind in sorted(found):
        if start >= at:
            out.append((start, end, kind))
            at = end
    return out


def items(text: str, tagged: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the words and tags of a text in order.

    Tags of HTML are told apart as frame, anchor, inline and other; a word inside of
    an open frame (navigation, footer, form and the like) is a framed one.
    """
    out: list[tuple[int, int, str]] = []
    frames: list[str] = []
    at = 0
    for a, b, kind in [*tagged, (len(text), len(text), "")]:
        word = "framed" if frames else "word"
        out += [(m.start(), m.end(), word) for m in _WORD.finditer(text, at, a)]
        if kind == "html":
            if frame := _FRAME_TAG.match(text, a):
                kind, name = "frame", frame[2].lower()
                if not frame[1]:
                    frames.append(name)
                elif name in frames:
                    del frames[frames.index(name) :]
            else:
                kind = "anchor" if _ANCHOR_TAG.match(text, a) else "inline" if _INLINE_TAG.match(text, a) else "html"
        if kind:
            out.append((a, b, kind))
        at = b
    return out


def fit_weights(pages: Iterable[tuple[str, int, int]]) -> dict[str, float]:
    """Scores by kind from labelled pages (text, start and end of the content): log odds of standing inside, against those of words.

    A plain word scores 0.5 and every other kind below zero, as the method asks; a
    kind that no page has scores ``OTHER``.
    """
    inside: dict[str, int] = {}
    outside: dict[str, int] = {}
    for text, start, end in pages:
        for at, _, kind in items(text, marks(text)):
            into = inside if start <= at < end else outside
            into[kind] = into.get(kind, 0) + 1
    odds = {k: math.log((inside.get(k, 0) + 0.5) / (outside.get(k, 0) + 0.5)) for k in inside | outside}
    level = odds.get("word", 0.0)
    unseen = dict.fromkeys([k for k, *_ in _KINDS] + ["frame", "anchor", "inline", "framed"], OTHER)
    return unseen | {k: (0.5 if k == "word" else round(min(-0.1, 0.5 * (v - level)), 2)) for k, v in odds.items()}


#: Score of a kind of tag that no labelled page has.
OTHER = -0.5
WEIGHTS: dict[str, float] = fit_weights(labelled_pages())
#: A gap of this score parts what stands on its sides. So many parts in a row that score less than this are a list of links, fewer are words of the text.
GAP, LEAST_PART, LIST = -4.0, 1.5, 3


def regions(scores: Sequence[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring subsequences (first, behind the last, score), in order, by one linear scan.

    Every positive score lies in exactly one; the first of those with the greatest
    score is the best contiguous region of all.
    """
    found: list[tuple[int, int, float, float]] = []  # first, behind the last, sum before, sum up to the end
    total = 0.0
    for k, v in enumerate(scores):
        total += v
        if v <= 0:
            continue
        left, low, high = k, total - v, total
        first = k
        while True:
            at = len(found) - 1
            while at >= 0 and found[at][2] >= low:
                at -= 1
            if at < 0 or found[at][3] >= high:
                break
            first, low = found[at][0], found[at][2]
            del found[at:]
        found.append((min(first, left), k + 1, low, high))
    return [(a, b, high - low) for a, b, low, high in found]


def content_region(text: str, tagged: list[tuple[int, int, str]], weights: dict[str, float] = WEIGHTS) -> tuple[int, int]:
    """The contiguous region of greatest score; of equal ones the first. The whole text if nothing is marked."""
    if not tagged:
        return 0, len(text)
    sequence = items(text, tagged)
    found = regions([weights.get(kind, OTHER) for *_, kind in sequence])
    if not found:
        return 0, 0
    a, b, _ = max(found, key=lambda r: (round(r[2], 9), -r[0]))
    return sequence[a][0], sequence[b - 1][1]


def left_out(text: str, tagged: list[tuple[int, int, str]], weights: dict[str, float] = WEIGHTS) -> list[tuple[int, int]]:
    """The spans of a text that are no content, in order.

    The best region is content. So are the other maximal regions, but for rows of
    ``LIST`` and more that are short and that heavy gaps part from one another, as in
    lists of links. The words of those and framed words go, but no line with a
    heading, list item, code or formula.
    """
    sequence = items(text, tagged)
    scores = [weights.get(kind, OTHER) for *_, kind in sequence]
    found = regions(scores)
    parts: list[list] = []  # first, behind the last, score of its words
    sums = [0.0]
    for v in scores:
        sums.append(sums[-1] + v)
    for a, b, score in found:
        if parts and sums[a] - sums[parts[-1][1]] > GAP:
            parts[-1][1:] = [b, parts[-1][2] + score]
        else:
            parts.append([a, b, score])
    best = max((p[2] for p in parts), default=0.0)
    content = []
    for weak, row in itertools.groupby(parts, lambda p: p[2] < min(best, LEAST_PART)):
        row = list(row)
        content += [] if weak and len(row) >= LIST else row
    inside = [False] * len(sequence)
    for a, b, _ in content:
        inside[a:b] = [True] * (b - a)
    dropped = {k for k in ("word", "framed") if weights.get(k, OTHER) <= 0}
    gone = [(a, b) for (a, b, kind), kept in zip(sequence, inside, strict=True) if kind in dropped or kind in ("word", "framed") and not kept]
    if not gone:
        return []
    starts = [s for s, _, k in tagged if k in _STRUCTURE or k == "html" and _STRUCTURE_TAG.match(text, s)] + [m.start() for m in _ITEM_LINE.finditer(text)]
    lines = {text.rfind("\n", 0, s) + 1 for s in starts}
    out: list[tuple[int, int]] = []
    kept = [a for (a, _, kind), own in zip(sequence, inside, strict=True) if own and kind == "word"]
    for a, b in gone:
        if text.rfind("\n", 0, a) + 1 in lines:
            continue
        if out and not any(out[-1][1] <= k < a for k in kept[bisect.bisect_left(kept, out[-1][1]) :][:1]) and not any(out[-1][1] <= s < a for s in starts):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


_ITEM = {"li", "dt", "dd"}
_BLOCK = {"p", "div", "br", "tr", "table", "ul", "ol", "dl", "blockquote", "section", "article", "hr", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "caption", "figure", "li", "dt", "dd", "pre", "body", "main"}


def _plain(kind: str, m: str) -> str:
    """What stays of one mark."""
    if kind in ("hidden", "template", "magic", "rule", "display") or kind == "footnote":
        return "\n" if kind == "rule" else ""
    if kind == "entity":
        return html.unescape(m)
    if kind == "html":
        name = re.match(r"</?\s*([A-Za-z0-9]+)", m)[1].lower()
        if name in _ITEM and m[1] != "/":
            return "\n- "
        if name in ("td", "th"):
            return " | " if m[1] == "/" else ""
        if re.fullmatch(r"h[1-6]", name):
            return "\n" + "#" * int(name[1]) + " " if m[1] != "/" else "\n"
        return "\n" if name in _BLOCK else ""
    if kind in ("fence", "math"):
        return m
    if kind == "autolink":
        return m[1:-1]
    if kind == "environment":
        return "\n```\n" if "verbatim" in m or "lstlisting" in m else "\n$$\n" if re.search(r"equation|align|math", m) else "\n"
    if kind == "command":
        name = m.lstrip("\\").split("[")[0].rstrip("*")
        return {"item": "- ", "section": "\n# ", "subsection": "\n## ", "subsubsection": "\n### ", "hline": "", "cite": "", "label": "", "footnote": " "}.get(name, m if name in _BARE_COMMANDS.split() or name in ("frac", "sqrt") else "")
    if kind == "escape":
        return "\n" if m == "\\\\" else m[1:]
    if kind in ("image", "link"):
        inner = re.match(r"!?\[([^\]\n]*)\]", m)
        return "" if re.match(r"[ ]{0,3}\[[^\]\n]+\]:", m) else inner[1] if inner else ""
    if kind == "wikilink":
        inner = m[2:-2]
        return "" if re.match(r"(?i)(?:category|file|image):", inner) else inner.rpartition("|")[2]
    if kind == "weblink":
        return m[1:-1].partition(" ")[2]
    if kind == "tablemark":
        return "|" if m.startswith("!") else ""
    if kind == "heading":
        if "=" in m and not m.lstrip().startswith("#"):
            inner = m.strip()
            text = inner.strip("= \t")
            return f"{'#' * (len(inner) - len(inner.lstrip('=')))} {text}" if text else ""
        return m if m.lstrip(" ").startswith("#") else ""
    if kind == "task":
        return re.sub(r"\[[ xX]\]$", "", m).rstrip()
    if kind == "quote":
        return ""
    if kind == "list":
        return f"{m[1:-1]}: " if m.startswith(";") else "  " * (len(m.strip()) - 1) + "- "
    if kind in ("strong", "strike", "emphasis"):
        return clean(m[1:-1] if kind == "emphasis" else m[2:-2])[0]
    return m[1:-1] if kind == "code" else ""


_FORMULAS = re.compile(r"\\begin\s*\{((?:equation|align|math|displaymath|gather|multline|eqnarray|alignat|flalign)\*?)\}")
_LISTINGS = re.compile(r"\\begin\s*\{((?:verbatim|lstlisting|minted|Verbatim)\*?)\}")
_ANY_TAG = re.compile(r"<[^<>]*>")


def _verbatim(text: str, a: int, b: int, kind: str) -> tuple[int, str] | None:
    """Where the code or formula that the mark opens ends, and what stands for it; none if it opens none."""
    mark = text[a:b]
    if kind == "fence":
        sign = mark.strip()[:3]
        close = re.compile(rf"(?m)^[ \t]{{0,3}}{re.escape(sign)}[`~]*[ \t]*$").search(text, b)
        end = close.end() if close else len(text)
        return end, text[a:end]
    if kind == "display" and mark in ("\\[", "\\("):
        end = text.find("\\]" if mark == "\\[" else "\\)", b)
        return (end + 2, text[a : end + 2]) if end >= 0 else None
    if kind == "environment" and (m := _FORMULAS.match(mark) or _LISTINGS.match(mark)):
        close = f"\\end{{{m[1]}}}"
        end = text.find(close, b)
        if end < 0:
            return None
        inner = text[b:end]
        return end + len(close), text[a : end + len(close)] if _FORMULAS.match(mark) else f"```\n{inner.strip(chr(10))}\n```"
    if kind == "html" and (m := re.match(r"(?i)<(pre|code|math)\b", mark)):
        close = re.compile(rf"(?i)</{m[1]}\s*>").search(text, b)
        if not close:
            return None
        inner = text[b : close.start()]
        if m[1].lower() == "math":
            return close.end(), text[a : close.end()]
        inner = html.unescape(_ANY_TAG.sub("", inner) if marks(inner) else inner)
        return close.end(), f"\n```\n{inner.strip(chr(10))}\n```\n" if m[1].lower() == "pre" else inner
    return None


def _closing(text: str, at: int) -> int:
    """Place of the brace that closes the one at ``at``, or -1."""
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.S).finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth and m[0] == "}":
            return m.start()
    return -1


def clean(text: str, weights: dict[str, float] = WEIGHTS) -> tuple[str, int]:
    """(clean text, number of marks). Headings stay as # lines, list items as - lines, code fenced, formulas as they are.

    Code (fences, pre, verbatim) and formulas ($, \\[, equation and the like) stay
    byte for byte, nothing in them counts as markup. Line ends become line feeds; a
    text without marks is returned unchanged.
    """
    given, text = text, text.replace("\r\n", "\n")
    tagged = marks(text)
    if not tagged:
        return given, 0
    spans: list[tuple[int, int, str]] = []  # what is replaced, by what
    exact: set[int] = set()  # where code and formulas begin
    until = 0
    for a, b, kind in tagged:
        if a < until:
            continue
        if whole := _verbatim(text, a, b, kind):
            until = whole[0]
            spans.append((a, *whole))
            exact.add(a)
            continue
        until = b
        spans.append((a, b, _plain(kind, text[a:b])))
        if kind == "command" and text[b : b + 1] == "{" and not text.startswith(("\\frac", "\\sqrt"), a) and (close := _closing(text, b)) > 0:
            spans += [(b, b + 1, ""), (close, close + 1, "")]
    gone = [(a, b, "") for a, b in left_out(text, tagged, weights)]
    out, run, at = [], [], 0
    for a, b, stands in sorted([*gone, *spans], key=lambda x: (x[0], x[2] != "")):
        if b <= at:
            continue
        run.append(text[at : max(at, a)])
        if a >= at and a in exact:
            out += [_no_gaps(run), stands]
            run = []
        elif a >= at:
            run.append(stands)
        at = b
    out.append(_no_gaps([*run, text[at:]]))
    return "".join(out).strip("\n"), len(tagged)


def _no_gaps(run: list[str]) -> str:
    return re.sub(r"\n{3,}", "\n\n", "".join(run))


def parts(outputs: DataFrame, output_id: str = "output_id") -> DataFrame:
    """(output_id, part_kind, part_pos, content) of every section content and table markdown that isn't null or empty."""
    sections = outputs.select(F.col(output_id).alias("output_id"), F.lit("section").alias("part_kind"), F.posexplode(F.col("sections.content")).alias("part_pos", "content"))
    tables = outputs.select(F.col(output_id).alias("output_id"), F.lit("table").alias("part_kind"), F.posexplode(F.col("tables.markdown")).alias("part_pos", "content"))
    return sections.unionByName(tables).where("content <> ''")


def cleaned_parts(outputs: DataFrame, output_id: str = "output_id", weights: dict[str, float] = WEIGHTS, only_marked: bool = False) -> DataFrame:
    """(output_id, part_kind, part_pos, marks, clean) of every part; with ``only_marked`` of those that hold markup.

    A map over rows: no shuffle, contents whole. Null arrays, null parts and empty
    contents give no row; a repeated row gives its parts again.
    """
    rows = parts(outputs, output_id)
    kind = rows.schema["output_id"].dataType.simpleString()

    def one(key: object, part: str, pos: int, content: str) -> Iterator[tuple]:
        text, n = clean(content, weights)
        if n or not only_marked:
            yield key, part, pos, n, text

    return flat_rows(rows, ["output_id", "part_kind", "part_pos", "content"], f"output_id {kind}, part_kind string, part_pos int, marks int, clean string", one)


def marked_parts(outputs: DataFrame, output_id: str = "output_id") -> DataFrame:
    """(output_id, part_kind, part_pos) of the parts that hold markup, without repeats."""
    return cleaned_parts(outputs, output_id, only_marked=True).select("output_id", "part_kind", "part_pos").distinct()
