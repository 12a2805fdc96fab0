"""Markup residue: contents with HTML, Markdown, wiki or LaTeX syntax become clean text, all others stay as they are.

A block parser walks the lines (fences, HTML, wiki and LaTeX blocks, headings, lists, quotations, tables), an inline parser the
rest. Both note which constructs they met; a content that has none is returned unchanged. What looks like markup but is code,
arithmetic, generics, paths or identifiers is told apart by what stands around it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.session import strip_clash

#: Element names of HTML and of wiki extensions.
TAGS = frozenset(
    "a abbr address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta meter nav noscript object ol optgroup option output p picture pre progress q rp rt ruby s samp script section select small "
    "source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr "
    "ref references nowiki syntaxhighlight math gallery includeonly noinclude onlyinclude poem".split()
)
#: Elements that start and end lines of their own.
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: LaTeX commands that format text, with an argument; and those without.
LATEX_ARG = frozenset(
    "part chapter section subsection subsubsection paragraph subparagraph emph textbf textit texttt textsc textsf textrm underline title author date label ref eqref cite citep citet footnote caption includegraphics url href "
    "begin end documentclass usepackage bibliography bibliographystyle input include newcommand verb mbox text mathrm mathbf".split()
)
LATEX_BARE = frozenset("item maketitle tableofcontents newpage noindent centering hline bfseries itshape".split())
HEADING_COMMANDS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5, "title": 1}

_ATTR = r"(?:\s+[A-Za-z_:@][\w:.\-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*"
TAG = re.compile(rf"(?<![\w<])<(/?)([A-Za-z][A-Za-z0-9]*)({_ATTR})\s*(/?)>|(?<=[\w])<(/)([A-Za-z][A-Za-z0-9]*)()\s*()>|(?<=\w)<()([A-Za-z][A-Za-z0-9]*)({_ATTR})\s*(/?)>")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")
AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
FENCE = re.compile(r"^( {0,3}|[ \t]*(?:>[ \t]?)+)(`{3,}|~{3,})[ \t]*([^`\n]*)$")
ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.+?)(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-{2,})[ \t]*$")
RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
BULLET = re.compile(r"^([ \t]*)([-*+•])[ \t]+(?:\[([ xX])\][ \t]+)?(\S.*)$")
NUMBER = re.compile(r"^([ \t]*)(\d{1,9})[.)][ \t]+(\S.*)$")
QUOTE = re.compile(r"^ {0,3}>(?:[ \t](.*)|()$|(\S.*))$")
TABLE_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
WIKI_HEADING = re.compile(r"^(={1,6})[ \t]*([^=\n].*?[^=\n]|[^=\n])[ \t]*\1[ \t]*$")
REFERENCE = re.compile(r"^ {0,3}\[([^\]\n]+)\]:[ \t]+(\S+)(?:[ \t]+[\"'(].*)?$")
BEGIN = re.compile(r"^[ \t]*\\begin\{(\w+\*?)\}(?:\[[^\]]*\]|\{[^}]*\})*(.*)$")
CODE_ENVIRONMENTS = ("verbatim", "verbatim*", "lstlisting", "minted", "Verbatim")
FORMULA_ENVIRONMENTS = ("equation", "equation*", "align", "align*", "gather", "gather*", "displaymath", "math", "eqnarray")

TICK = re.compile(r"(?<!`)(`+)(?!`)([^\n]*?[^`\n]|[^`\n])\1(?!`)")
IMAGE = re.compile(r"!\[([^\]\n]*)\]\(([^()\s]+(?:\([^()\s]*\)[^()\s]*)*)(?:[ \t]+[\"'][^\"'\n]*[\"'])?\)")
LINK = re.compile(r"(?<![\w\])])\[([^\[\]\n]+)\]\(([^()\s]+(?:\([^()\s]*\)[^()\s]*)*)(?:[ \t]+[\"'][^\"'\n]*[\"'])?\)")
FOOTNOTE = re.compile(r"\[\^[\w-]+\]:?")
BOLD = re.compile(r"(?<![\w*\\/])\*\*(?=[^\s*])([^\n]*?[^\s*])\*\*(?![*])|(?<![\w\\])__(?=[^\s_])([^\n]*?[^\s_])__(?!\w)")
ITALIC = re.compile(r"(?<![\w*\\/.(\[])\*(?=[^\s*/)])([^*\n]*?[^\s*/(])\*(?![\w*/])|(?<![\w\\./$])_(?=[^\s_,)])([^_\n]*?[^\s_(])_(?![\w./(=])")
STRIKE = re.compile(r"(?<![~\w])~~(?=[^\s~])([^\n]*?[^\s~])~~(?!~)")
WIKI_LINK = re.compile(r"(?<![\w=(\[,])\[\[(?![\s\d-])([^\[\]\n\"'$=<>|]+)(?:\|([^\[\]\n]*))?\]\](?!\])")
WIKI_EXTERNAL = re.compile(r"(?<![\w\])])\[((?:https?|ftp):[^\s\]]+)[ \t]+([^\]\n]+)\]")
WIKI_QUOTE = re.compile(rf"(?<![\w'=(,\[])('{{2,5}})(?=[^\s'])([^\n]*?[^\s'])\1(?!')")
WIKI_TEMPLATE = re.compile(r"\{\{([A-Za-z][^{}|\n]*)\|([^{}\n]*)\}\}")
DISPLAY = re.compile(r"\$\$(.+?)\$\$|\\\[(?=\s|[A-Za-z\\])(.+?)\\\]", re.S)
INLINE_MATH = re.compile(r"(?<![\w$\\\"'{])\$(?=[^\s$\d(])([^$\n\"'`]+?)(?<=[^\s\\])\$(?![\w$({])|\\\((?=\s?[A-Za-z\\\d])([^\n]+?)\\\)")
LATEX = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}(?:\{([^{}\n]*)\})?")
MATHY = re.compile(r"[\\^=<>+]|_\{|_\w\b|^\s*[A-Za-z]\w?\s*$|^[A-Za-z]\([^()]*\)$")
CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:def|class|import|from|return|if|for|while|with|try|except|func|var|let|const|export|public|private|SELECT|INSERT|UPDATE|DELETE|CREATE|fn|package)\b.*[:;({=]|\w+\s*[:+\-*/]?=\s*\S|\w\(.*\)")


#: What may close a construct of each pattern that could look for it to the end of a line or text.
_CLOSERS = {
    TICK: re.compile(r"[^`\n]`+"), BOLD: re.compile(r"[^\s*]\*\*(?!\*)|[^\s_]__(?!\w)"), STRIKE: re.compile(r"[^\s~]~~(?!~)"),
    WIKI_QUOTE: re.compile(r"[^\s']''+"), DISPLAY: re.compile(r"\$\$|\\\]"), INLINE_MATH: re.compile(r"\$|\\\)"),
}
_LONG_LINE = 2_000


def _closed(rx: re.Pattern, use, text: str) -> str:
    """rx.sub(use, text) for patterns of an opening and a closing sign, without looking for the closing sign where none is left: behind the last one of a text or of a long line nothing is tried, so that many opening signs without any cost no more than their text is long."""
    if rx is not DISPLAY and len(text) > _LONG_LINE and "\n" in text:
        return "\n".join(_closed(rx, use, x) for x in text.split("\n"))
    end = -1
    for m in _CLOSERS[rx].finditer(text):
        end = m.end()
    return text if end < 0 else rx.sub(use, text[:end]) + text[end:]


class Cleaner:
    """One content's pass: clean() gives the text, found the kinds of constructs met."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.found: set[str] = set()
        self.kept: list[str] = []
        self.numbers: set[int] | None = None
        self.table_end: int | None = None

    def hold(self, text: str) -> str:
        """Puts finished text out of reach of the patterns to come."""
        self.kept.append(text)
        return f"\ue000{len(self.kept) - 1}\ue001"

    def release(self, text: str) -> str:
        while True:
            out = re.sub("\ue000(\\d+)\ue001", lambda m: self.kept[int(m[1])], text)
            if out == text:
                return out
            text = out

    def note(self, kind: str) -> None:
        self.found.add(kind)

    def code(self, lines: list[str], language: str = "") -> str:
        head = f"Code ({language}):" if language else "Code:"
        return self.hold("\n".join([head, *("    " + x for x in lines)]))

    # inline

    def inline(self, text: str) -> str:
        def tick(m: re.Match) -> str:
            self.note("code span")
            return self.hold(m[2].strip())

        def display(m: re.Match) -> str:
            body = m[1] or m[2]
            if not MATHY.search(body):
                return m[0]
            self.note("formula")
            return self.hold(f"Formula: {' '.join(body.split())}")

        def math(m: re.Match) -> str:
            body = m[1] or m[2]
            if not MATHY.search(body):
                return m[0]
            self.note("formula")
            return self.hold(f"⟨{body.strip()}⟩")

        def latex(m: re.Match) -> str:
            name, body = m[1], m[2]
            if name not in LATEX_ARG:
                return m[0]
            self.note("latex")
            if name in HEADING_COMMANDS:
                return f"\n{self.hold('Heading ' + str(HEADING_COMMANDS[name]) + ': ')}{self.inline(body)}\n"
            if name == "href":
                return f"{m[3] or ''} ({body})"
            if name in ("begin", "end", "label", "documentclass", "usepackage", "bibliographystyle"):
                return ""
            return self.inline(body) + (f"{{{m[3]}}}" if m[3] else "")

        def link(m: re.Match) -> str:
            if not re.search(r"[/.#:]|^\w+$", m[2]):
                return m[0]
            self.note("link")
            return f"{m[1]} ({self.hold(m[2])})" if m[1] else self.hold(m[2])

        def bold(m: re.Match) -> str:
            body = m[1] or m[2]
            if m[2] and re.fullmatch(r"\w+", body):
                return m[0]
            self.note("emphasis")
            return self.inline(body)

        def plain(kind: str, group: int = 1):
            def use(m: re.Match) -> str:
                self.note(kind)
                return next(g for g in m.groups()[group - 1 :] if g is not None)

            return use

        def wiki(m: re.Match) -> str:
            self.note("wiki link")
            return (m[2].rsplit("|", 1)[-1] if m[2] else m[1]).strip()

        def template(m: re.Match) -> str:
            self.note("wiki template")
            return f"{m[1].strip()}: {m[2].rsplit('|', 1)[-1].strip()}"

        def tag(m: re.Match) -> str:
            g = m.groups()
            close, name, attributes, _ = next(g[i : i + 4] for i in (0, 4, 8) if g[i + 1])
            name = name.lower()
            glued = m.start() > 0 and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_:")
            if name not in TAGS or glued and not close and not attributes and name not in ("br", "ref", "sup", "sub", "hr"):
                return m[0] if name not in TAGS or f"</{name}" not in text.lower() else self._tag(close, name, attributes)
            return self._tag(close, name, attributes)

        def entity(m: re.Match) -> str:
            if m[1] and m[1] + ";" not in html5:
                return m[0]
            self.note("entity")
            c = html.unescape(m[0])
            return self.hold(" " if c == "\xa0" else c)

        def comment(m: re.Match) -> str:
            self.note("html comment")
            return ""

        def auto(m: re.Match) -> str:
            self.note("link")
            return self.hold(m[1])

        def foot(m: re.Match) -> str:
            self.note("footnote")
            return ""

        out = COMMENT.sub(comment, text)
        out = _closed(TICK, tick, out)
        out = AUTOLINK.sub(auto, out)
        out = IMAGE.sub(link, out)
        out = LINK.sub(link, out)
        out = _closed(DISPLAY, display, out)
        out = _closed(INLINE_MATH, math, out)
        out = LATEX.sub(latex, out)
        out = WIKI_LINK.sub(wiki, out)
        out = WIKI_EXTERNAL.sub(lambda m: (self.note("wiki link"), f"{m[2]} ({self.hold(m[1])})")[1], out)
        out = WIKI_TEMPLATE.sub(template, out)
        out = TAG.sub(tag, out)
        out = ENTITY.sub(entity, out)
        out = FOOTNOTE.sub(foot, out)
        out = _closed(BOLD, bold, out)
        out = _closed(STRIKE, plain("emphasis"), out)
        out = _closed(WIKI_QUOTE, plain("emphasis", 2), out)
        return ITALIC.sub(plain("emphasis"), out)

    def _tag(self, close: str, name: str, attributes: str) -> str:
        self.note("html")
        if name == "li" and not close:
            return "\n• "
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return "\n" if close else f"\n{self.hold('Heading ' + name[1] + ': ')}"
        if name in ("td", "th"):
            return "\t" if close else ""
        if name == "img":
            alt = re.search(r"alt\s*=\s*[\"']?([^\"'>]*)", attributes or "")
            return alt[1] if alt else ""
        if name == "ref":
            return ")" if close else " ("
        return "\n" if name in BLOCK_TAGS else ""

    # blocks

    def _lift_elements(self, text: str) -> str:
        """Takes out elements whose content is code or a formula, over any number of lines."""

        def code(m: re.Match) -> str:
            self.note("html")
            code_tag = re.match(r"(?i)\s*<code[^>]*>", m[3])
            inner_tag = code_tag[0] if code_tag else ""
            inner = re.sub(r"(?i)</code>\s*$", "", m[3][len(inner_tag) :])
            opening = m[0][: len(m[0]) - len(m[3])] + inner_tag
            language = re.search(r"language-([A-Za-z+#]+)", opening) or re.search(r"(?:lang|class)=[\"']?([A-Za-z+#]+)", opening)
            return "\n" + self.code(html.unescape(re.sub(r"<[^<>\n]+>", "", inner)).strip("\n").split("\n"), language[1] if language else "") + "\n"

        def formula(m: re.Match) -> str:
            self.note("formula")
            return self.hold(f"Formula: {' '.join(m[1].split())}")

        text = re.sub(r"(?is)<(pre|syntaxhighlight|source)(\s[^<>]*)?>(.*?)</\1\s*>", code, text)
        return re.sub(r"(?is)<math(?:\s[^<>]*)?>(.*?)</math\s*>", formula, text)

    def clean(self) -> str:
        lines = self._lift_elements(self.text.replace("\ue000", "?").replace("\ue001", "?")).split("\n")
        out: list[str] = []
        i, n = 0, len(lines)
        while i < n:
            line = lines[i]
            body = line.rstrip("\r")
            if m := FENCE.match(body):
                self.note("fence")
                mark, inner, j = m[2], [], i + 1
                while j < n and not re.match(rf"^[ \t>]*{re.escape(mark[0])}{{{len(mark)},}}[ \t]*\r?$", lines[j]):
                    inner.append(lines[j].rstrip("\r"))
                    j += 1
                out.append(self.code(inner, m[3].split()[0] if m[3].split() else ""))
                i = j + 1
                continue
            if m := BEGIN.match(body):
                name, inner, j = m[1], [], i
                rest = m[2]
                end = f"\\end{{{name}}}"
                while end not in rest and j + 1 < n:
                    inner.append(rest)
                    j += 1
                    rest = lines[j]
                if end in rest:
                    inner.append(rest[: rest.find(end)])
                    after = rest[rest.find(end) + len(end) :]
                else:
                    inner.append(rest)
                    after = ""
                self.note("latex")
                if name in CODE_ENVIRONMENTS:
                    out.append(self.code([x for k, x in enumerate(inner) if x.strip() or 0 < k < len(inner) - 1]))
                elif name in FORMULA_ENVIRONMENTS:
                    out.append(self.hold(f"Formula: {' '.join(' '.join(inner).split())}"))
                else:
                    sub = Cleaner("\n".join(inner))
                    out.append(self.hold(sub.clean().strip("\n")))
                if after.strip():
                    lines[j] = after
                    i = j
                else:
                    i = j + 1
                continue
            if body.startswith("{|") and i < self._last(lines):
                self.note("wiki table")
                j = i + 1
                row: list[str] = []
                while j < n and not lines[j].startswith("|}"):
                    x = lines[j].rstrip("\r")
                    if x.startswith("|-"):
                        if row:
                            out.append("\t".join(row))
                        row = []
                    elif x[:1] in "|!":
                        row += [self.inline(c.strip()) for c in re.split(r"\|\||!!", x[1:])]
                    j += 1
                if row:
                    out.append("\t".join(row))
                i = j + 1
                continue
            if m := WIKI_HEADING.match(body):
                self.note("heading")
                out.append(self.hold(f"Heading {len(m[1])}: ") + self.inline(m[2].strip()))
                i += 1
                continue
            if (m := ATX.match(body)) and self._is_heading(lines, i, m):
                self.note("heading")
                out.append(self.hold(f"Heading {len(m[1])}: ") + self.inline(m[2]))
                i += 1
                continue
            if body.strip() and i + 1 < n and (m := SETEXT.match(lines[i + 1].rstrip("\r"))) and len(m[1]) >= 3 and (i == 0 or not lines[i - 1].strip()) and not QUOTE.match(body) and not BULLET.match(body) and "|" not in body:
                self.note("heading")
                out.append(self.hold(f"Heading {1 if m[1][0] == '=' else 2}: ") + self.inline(body.strip()))
                i += 2
                continue
            if "|" in body and i + 1 < n and "|" in lines[i + 1] and TABLE_RULE.match(lines[i + 1].rstrip("\r")):
                self.note("table")
                j = i
                while j < n and "|" in lines[j]:
                    if j != i + 1:
                        cells = lines[j].strip().strip("|").split("|")
                        out.append("\t".join(self.inline(c.strip()) for c in cells))
                    j += 1
                i = j
                continue
            if RULE.match(body) and (i == 0 or not lines[i - 1].strip()) and (i + 1 >= n or not lines[i + 1].strip()):
                self.note("rule")
                out.append("")
                i += 1
                continue
            if m := REFERENCE.match(body):
                self.note("link")
                out.append(f"{m[1]}: {self.hold(m[2])}")
                i += 1
                continue
            if (m := BULLET.match(body)) and self._is_item(lines, i, m):
                self.note("list")
                box = {"x": "(done) ", "X": "(done) ", " ": "(open) "}.get(m[3], "")
                out.append(f"{m[1]}• {box}{self.inline(m[4])}")
                i += 1
                continue
            if (m := NUMBER.match(body)) and self._is_numbered(lines, i, m):
                self.note("list")
                out.append(f"{m[1]}{m[2]}) {self.inline(m[3])}")
                i += 1
                continue
            if (m := QUOTE.match(body)) and self._is_quote(lines, i, m):
                self.note("quotation")
                j, inner = i, []
                while j < n and (q := QUOTE.match(lines[j].rstrip("\r"))):
                    inner.append(q[1] or q[3] or "")
                    j += 1
                sub = Cleaner("\n".join(inner))
                out.append(self.hold("\n".join("│ " + x for x in sub.clean().split("\n"))))
                i = j
                continue
            bare = re.match(r"^\s*\\(item|maketitle|tableofcontents|newpage|noindent|centering|hline)\b\s*(.*)$", body)
            if bare and bare[1] in LATEX_BARE:
                self.note("latex")
                out.append(("• " if bare[1] == "item" else "") + self.inline(bare[2]))
                i += 1
                continue
            # a run of plain lines is one inline text, since tags and formulas may span lines
            j = i + 1
            while j < n and not self._starts_block(lines, j):
                j += 1
            out.append(self.inline("\n".join(lines[i:j])))
            i = j
        return self.release("\n".join(out))

    def _starts_block(self, lines: list[str], i: int) -> bool:
        x = lines[i].rstrip("\r")
        return bool(
            not x.strip()
            or not lines[i - 1].strip()
            or FENCE.match(x)
            or BEGIN.match(x)
            or x.startswith("{|")
            or WIKI_HEADING.match(x)
            or ATX.match(x)
            or REFERENCE.match(x)
            or BULLET.match(x)
            or NUMBER.match(x)
            or QUOTE.match(x)
            or re.match(r"^\s*\\item\b", x)
            or "|" in x
            and i + 1 < len(lines)
            and TABLE_RULE.match(lines[i + 1].rstrip("\r"))
        )

    @staticmethod
    def _alone(lines: list[str], i: int) -> bool:
        return (i == 0 or not lines[i - 1].strip()) and (i + 1 >= len(lines) or not lines[i + 1].strip())

    def _is_heading(self, lines: list[str], i: int, m: re.Match) -> bool:
        """# is a heading, unless it is the comment sign of code without a fence."""
        title = m[2]
        if len(m[1]) > 1:
            return not (title.endswith((";", "{")) or re.match(r"\w+_\w+", title))
        before = lines[i - 1].strip() if i else ""
        after = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if before and CODE_LINE.search(before) or after and CODE_LINE.search(after):
            return False
        return (title[0].isupper() or not title[0].isascii()) and not title.rstrip().endswith((".", ";", ",")) and len(title.split()) <= 12 and not before

    def _is_item(self, lines: list[str], i: int, m: re.Match) -> bool:
        """A list item, not a line of a diff, of YAML or of arithmetic: no code around, and text behind the sign."""
        before = lines[i - 1] if i else ""
        if before.strip() and not BULLET.match(before) and (CODE_LINE.search(before) or re.match(r"^\s*[\w.-]+:\s*$", before)):
            return False
        return not (m[2] != "•" and re.match(r"^[\d(]", m[4]) and re.search(r"[-+*/]\s*$|^\d+\s*[-+*/]", m[4]))

    def _is_numbered(self, lines: list[str], i: int, m: re.Match) -> bool:
        """Numbered lines are a list if there are two of them in a row (by number) or one under a list."""
        k = int(m[2])
        if self.numbers is None:
            self.numbers = {int(o[2]) for x in lines if (o := NUMBER.match(x.rstrip("\r")))}
        return k - 1 in self.numbers or k + 1 in self.numbers

    def _last(self, lines: list[str]) -> int:
        """The last line that ends a wiki table."""
        if self.table_end is None:
            self.table_end = max((k for k, x in enumerate(lines) if x.startswith("|}")), default=-1)
        return self.table_end

    def _is_quote(self, lines: list[str], i: int, m: re.Match) -> bool:
        return m[3] is None or not re.match(r"[=>&]", m[3])


def clean_text(text: str | None) -> tuple[str | None, frozenset[str]]:
    """The clean text and the kinds of markup met; the text itself if there is none. Headings come out as 'Heading n: ', list items as '• ' or 'n) ', code blocks indented under 'Code:', formulas as 'Formula: ' or in ⟨⟩, table cells between tabs, quotations behind '│ '."""
    if not text:
        return text, frozenset()
    c = Cleaner(text)
    out = c.clean()
    found = frozenset(c.found)
    if not found:
        return text, found
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in out.split("\n"))).strip("\n"), found


#: Every construct has one of these characters; contents without any aren't sent to Python.
SIGNS = r"[<&*_`~#|\[{$\\>=•'-]|(?m)^\s*(\+|\d+[.)])\s"


def _clean_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, kinds = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out, found = clean_text(text)
            if found:
                ids.append(i)
                texts.append(out)
                kinds.append(sorted(found))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["message_id", "clean", "kinds"])


def marked_up(messages: DataFrame) -> DataFrame:
    """message_id, clean, kinds of the messages whose content carries markup.

    Repeated rows count once. Null and blank contents carry none; a null id stays null. An empty table gives an empty result,
    other columns are ignored. One narrow pass after one exchange that removes repeated rows.
    """
    rows = strip_clash(messages, {"message_id": "id", "content": "content"}).filter(F.col("content").rlike(SIGNS))
    return rows.distinct().mapInArrow(_clean_batches, "message_id string, clean string, kinds array<string>")


def clean_messages(messages: DataFrame) -> DataFrame:
    """message_id, clean of every message, as it is where there is no markup."""
    rows = strip_clash(messages, {"message_id": "id", "content": "content"}).distinct()
    marked = rows.filter(F.coalesce(F.col("content").rlike(SIGNS), F.lit(False)))
    rest = rows.filter(~F.coalesce(F.col("content").rlike(SIGNS), F.lit(False)))

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([clean_text(t)[0] for t in batch.column(1).to_pylist()], pa.string())], names=["message_id", "clean"])

    return marked.mapInArrow(every, "message_id string, clean string").unionByName(rest.withColumnRenamed("content", "clean"))
