"""Labelled pages: what of them is content stands between double angle quotes. The weights of markup are fitted on these."""

from __future__ import annotations

_PAGES = (
    """<nav><a href="/">Home</a> <a href="/docs">Docs</a> <a href="/blog">Blog</a></nav>
«<h1>Moving the archive</h1>
<p>The archive was moved in two steps so that readers never saw an <b>empty</b> shelf. First all volumes were copied, then the <a href="/index">index</a> was switched.</p>
<ul><li>copy the volumes</li><li>switch the index</li></ul>»
<footer>About us <a href="/imprint">Imprint</a> <a href="/jobs">Jobs</a></footer>""",
    """<!-- skin: plain --><form action="/search"><input name="q"> <button>Search</button></form>
«<h2>Limits</h2><p>A request may hold up to one hundred rows. Larger ones are cut, and the <code>next</code> field names where to go on.</p>
<table><tr><th>field</th><th>meaning</th></tr><tr><td>rows</td><td>the rows found</td></tr></table>»
<aside>Related: <a href="/a">Quotas</a> <a href="/b">Billing</a></aside>""",
    """{{Infobox software|name=Kiln|licence=open}} __NOTOC__
«'''Kiln''' is a [[scheduler]] for long jobs. It keeps a list of what is left and hands out one part at a time.

== Use ==
Start one keeper and as many workers as there are cores. A worker that dies gives its part back.
* write the plan
* start the keeper»
[[Category:Schedulers]] {{stub}}""",
    """[![build](b.svg)](ci) [![docs](d.svg)](docs)
«# lantern

A small reader for **very** long logs. It keeps an index of line ends, so that any line is found at once.

## Use

```sh
lantern app.log --line 90000
```

- works on files over any size
- never reads a line twice»

<!-- generated by the site --> [^1]: see the wiki""",
    """\\documentclass{article} \\usepackage{tables} \\begin{document}
«\\section{Results}
The gain is largest for short runs, where \\emph{setup} counts most. With $n$ workers the time falls as $t = a + b/n$ until the disk is full.
\\begin{itemize}
\\item setup is paid once
\\item the rest is shared
\\end{itemize}»
\\newpage \\appendix""",
    """<script>track("x")</script><menu><a href="/1">1</a> <a href="/2">2</a></menu>
«<p>Keep the lid closed while the kiln is warm &amp; wait for the <em>second</em> signal. Only then may the door be opened by hand.</p>
<pre>lid = read(sensor)</pre>»
<nav><a href="/prev">Previous</a> | <a href="/next">Next</a></nav><footer>All rights reserved &copy; Kiln</footer>""",
)


def labelled_pages() -> list[tuple[str, int, int]]:
    """(text, start and end of its content) of every page."""
    out = []
    for page in _PAGES:
        first, last = page.index("«"), page.index("»")
        out.append((page.replace("«", "").replace("»", ""), first, last - 1))
    return out
