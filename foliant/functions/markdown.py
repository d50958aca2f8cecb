"""Markdown with citations and a TeX subset to HTML, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# TeX commands that are Greek letters, operators with their entities, functions set upright, and styles.
GREEK = frozenset("alpha beta gamma delta eta epsilon zeta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega".split())
OPERATORS = {
    "cdot": "&#x22C5;", "cdots": "&#x22EF;", "ldots": "&#x2026;", "times": "&#x00D7;", "pm": "&#x00B1;",
    "leq": "&#x2264;", "le": "&#x2264;", "geq": "&#x2265;", "ge": "&#x2265;", "neq": "&#x2260;", "ne": "&#x2260;", "approx": "&#x2248;",
    "to": "&#x2192;", "rightarrow": "&#x2192;", "leftarrow": "&#x2190;", "mapsto": "&#x21A6;",
    "lceil": "&#x2308;", "rceil": "&#x2309;", "lfloor": "&#x230A;", "rfloor": "&#x230B;", "langle": "&#x27E8;", "rangle": "&#x27E9;",
    "infty": "&#x221E;", "sum": "&#x2211;", "prod": "&#x220F;", "int": "&#x222B;", "partial": "&#x2202;", "mid": "|",
    "forall": "&#x2200;", "exists": "&#x2203;", "in": "&#x2208;", "notin": "&#x2209;", "subseteq": "&#x2286;", "supseteq": "&#x2287;",
    "cup": "&#x222A;", "cap": "&#x2229;", "land": "&#x2227;", "lor": "&#x2228;",
}
FUNCTIONS = frozenset("log ln sin cos tan max min exp BP".split())
STYLES = {"mathrm": "normal", "operatorname": "normal", "mathit": "italic", "mathbf": "bold", "mathbb": "double-struck", "mathcal": "script"}
TOKEN = re.compile(r"\s+|\\(?P<command>[A-Za-z]+|.?)|(?P<number>[0-9][0-9.]*)|(?P<identifier>[A-Za-z]+)|(?P<symbol>.)", re.S)


def escape(text: str) -> str:
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = text.replace(raw, code)
    return text


def safe_url(url: str) -> str | None:
    m = re.match(r"\s*([A-Za-z][A-Za-z0-9+.-]*):", url)
    return url.strip() if not m or m[1].lower() in ("http", "https", "mailto") else None


EMPTY = "<mrow></mrow>"
#: Commands that take arguments: how many, what is made of them, and whether a brace as the argument is a group.
SHAPES: dict[str, tuple[int, str, bool]] = {"frac": (2, "<mfrac>{0}{1}</mfrac>", True), "sqrt": (1, "<msqrt>{0}</msqrt>", True), "left": (1, "{0}", False), "right": (1, "{0}", False)}
SCRIPTS = {"_": "msub", "^": "msup", "_^": "msubsup"}


class Row:
    """Open until its brace: nodes, each with the scripts that have been set on it."""

    def __init__(self) -> None:
        self.nodes: list[tuple[str, dict[str, str]]] = []

    def add(self, node: str) -> None:
        self.nodes.append((node, {}))

    def html(self) -> str:
        out = []
        for base, scripts in self.nodes:
            marks = "".join(m for m in "_^" if m in scripts)
            tag = SCRIPTS.get(marks)
            out.append(f"<{tag}>{base}{''.join(scripts[m] for m in marks)}</{tag}>" if tag else base)
        return f"<mrow>{''.join(out)}</mrow>"


class Slot:
    """Waits for the arguments of a command, or for a script of a row's last node."""

    def __init__(self, need: int, form: str = "{0}", grouped: bool = True, script: str = ""):
        self.need, self.form, self.grouped, self.script, self.got = need, form, grouped, script, []


def leaf(kind: str, v: str) -> str:
    """One token by itself."""
    if kind == "number":
        return f"<mn>{v}</mn>"
    if kind == "symbol":
        return "<mo>&#x2032;</mo>" if v == "'" else f"<mo>{escape(v)}</mo>"
    if kind == "command" and v in GREEK:
        return f"<mi>&{v};</mi>"
    if kind == "command" and v in OPERATORS:
        return f"<mo>{OPERATORS[v]}</mo>"
    return f'<mi mathvariant="normal">{escape(v)}</mi>' if v in FUNCTIONS else f"<mi>{escape(v)}</mi>"


def closings(tokens: list[tuple[str, str]]) -> dict[int, int]:
    """The place of each opening brace's partner; the end for those that are never closed."""
    out, waiting = {}, []
    for k, (_, v) in enumerate(tokens):
        if v == "{":
            waiting.append(k)
        elif v == "}" and waiting:
            out[waiting.pop()] = k
    return out | dict.fromkeys(waiting, len(tokens))


def plain_words(tokens: list[tuple[str, str]]) -> str:
    return re.sub(r"\s+([.,;:!?])", r"\1", " ".join(v for _, v in tokens))


def mathml(source: str) -> str:
    """A TeX expression as one row, read token by token with a stack of rows and waiting slots."""
    tokens = [(m.lastgroup, m[m.lastgroup]) for m in TOKEN.finditer(source) if m.lastgroup]
    partner = closings(tokens)
    stack: list[Row | Slot] = [Row()]

    def give(node: str) -> None:
        """Hand a finished node to what waits for it; a slot that is full is a finished node itself."""
        while isinstance(top := stack[-1], Slot):
            top.got.append(node)
            if len(top.got) < top.need:
                return
            stack.pop()
            if top.script:
                stack[-1].nodes[-1][1][top.script] = node
                return
            node = top.form.format(*top.got)
        stack[-1].add(node)

    k = 0
    while k < len(tokens):
        kind, v = tokens[k]
        top = stack[-1]
        k += 1
        if isinstance(top, Row) and v == "}" and len(stack) > 1:
            stack.pop()
            give(top.html())
        elif isinstance(top, Row) and v in ("_", "^") and top.nodes:
            stack.append(Slot(1, script=v))
        elif v == "{" and (kind == "symbol" or isinstance(top, Slot) and top.grouped):
            stack.append(Row())
        elif kind == "command" and v in SHAPES:
            stack.append(Slot(*SHAPES[v]))
        elif kind == "command" and (v == "text" or v in STYLES):
            words = ""
            if k in partner:
                words, k = plain_words(tokens[k + 1 : partner[k]]), partner[k] + 1
            content = escape(words if v == "text" else words.strip())
            give(f"<mtext>{content}</mtext>" if v == "text" else f'<mi mathvariant="{STYLES[v]}">{content}</mi>' if content else EMPTY)
        else:
            give(leaf(kind, v))
    while len(stack) > 1:  # what the source leaves open
        top = stack[-1]
        if isinstance(top, Row):
            stack.pop()
            give(top.html())
        else:
            give(EMPTY)
    return stack[0].html()


def math(source: str, display: bool = False) -> str:
    return f'<math xmlns="http://www.w3.org/1998/Math/MathML"{" display=\"block\"" if display else ""}>{mathml(source)}</math>'


def element(tag: str, content: str, **attributes: object) -> str:
    """An element with those attributes that have a value; an underscore in a name is a hyphen."""
    shown = "".join(f' {k.rstrip("_").replace("_", "-")}="{escape(str(v))}"' for k, v in attributes.items() if v is not None)
    return f"<{tag}{shown}>{content}</{tag}>"


def page_button(label: str, **attributes: object) -> str:
    kinds = "page-chip doc-ref-chip" if "data_ref_id" in attributes else "page-chip"
    return element("button", label, class_=kinds, type="button", **attributes)


#: What a scan of a line stops at. An atom is finished where it stands; a mark opens or closes a span.
STOPS = re.compile(
    r"""\\\[(?P<display>.+?)\\\] | \$\$(?P<dollars>.+?)\$\$ | \\\((?P<formula>[^)\n]+)\\\) | (?<!\\)\$(?P<dollar>[^$\n]+)\$ |
    `(?P<code>[^`]+)` | \[[rR][eE][fF]:(?P<ref>[A-Za-z0-9_-]+)\] | \[(?P<page>[pP]\.[0-9]+)\] | \[(?P<label>[^\]]+)\]\((?P<url>[^)\s]+)\) |
    (?P<mark>\*\*|\*|~~)""",
    re.X | re.S,
)
SPANS = {"**": "strong", "*": "em", "~~": "del"}


class Line:
    """Inline text read once from left to right. ``parts`` is the HTML so far; ``open`` the marks that may still be closed, by their place in it."""

    def __init__(self, refs: dict[str, dict]):
        self.refs, self.parts, self.open = refs, [], []

    def atom(self, kind: str, m: re.Match) -> str:
        value = m[kind]
        if kind in ("display", "dollars"):
            return element("span", math(value, True), class_="math-block")
        if kind in ("formula", "dollar"):
            return math(value)
        if kind == "code":
            return element("code", escape(escape(value)))  # as it has always been shown
        if kind == "page":
            return page_button(value, data_page_number=value[2:])
        if kind == "url":
            url = safe_url(value)
            inner = inline(m["label"], self.refs)
            return element("a", inner, href=url, target="_blank", rel="noreferrer") if url else escape(m["label"])
        return self.citation(value) or escape(m[0])

    def citation(self, name: str) -> str | None:
        ref = self.refs.get(name.lower())
        if ref is None:
            return None
        box = ref.get("bbox")
        corners = {f"data_bbox_{k}": box[k] for k in ("x", "y", "width", "height")} if box else {}
        return page_button(escape(str(ref.get("label") or ref["id"])), data_ref_id=ref["id"], data_page_number=ref.get("page_number"), **corners, title=ref.get("snippet") or None)

    def mark(self, sign: str) -> None:
        """Close the nearest span of this sign if anything stands in it; else this may open one."""
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == sign), None)
        if at is not None and len(self.parts) > self.open[at][1] + 1:
            first = self.open[at][1]
            self.parts[first:] = [element(SPANS[sign], "".join(self.parts[first + 1 :]))]
            del self.open[at:]  # marks inside it that were not closed are text
        else:
            self.open.append((sign, len(self.parts)))
            self.parts.append(sign)

    def read(self, text: str) -> str:
        at = 0
        for m in STOPS.finditer(text):
            if m.start() > at:
                self.parts.append(escape(text[at : m.start()]))
            at = m.end()
            if m.lastgroup == "mark":
                self.mark(m["mark"])
            else:
                self.parts.append(self.atom(m.lastgroup, m))
        return "".join(self.parts) + escape(text[at:])


def inline(text: str, refs: dict[str, dict]) -> str:
    return Line(refs).read(text)


#: Kinds of lines, in the order they are tried; the rest are paragraphs.
BLOCKS = [("blank", r"\s*$"), ("fence", "```"), ("heading", r"(#{1,6})\s+(.*)"), ("quote", r"\s*>\s?"), ("ul", r"\s*[-*+]\s+"), ("ol", r"\s*[0-9]+\.\s+"), ("rule", r"\s*---+\s*$")]


def kind_of(line: str) -> str:
    return next((k for k, p in BLOCKS if re.match(p, line)), "paragraph")


def render(markdown: str | None, refs: dict[str, dict] | None = None) -> str:
    refs, pattern = refs or {}, dict(BLOCKS)
    lines = (markdown or "").replace("\r\n", "\n").replace("\r", "\n").strip().split("\n")
    out, at = [], 0

    def take(kind: str) -> list[str]:
        nonlocal at
        first = at
        while at < len(lines) and kind_of(lines[at]) == kind:
            at += 1
        return lines[first:at]

    while at < len(lines):
        kind = kind_of(lines[at])
        if kind == "fence":
            language, first = lines[at][3:].strip(), at + 1
            at = next((k for k in range(first, len(lines)) if lines[k].startswith("```")), len(lines))
            cls = f' class="language-{escape(language)}"' if language else ""
            out.append(f"<pre><code{cls}>{escape(chr(10).join(lines[first:at]))}</code></pre>")
            at += 1
        elif kind == "heading":
            m = re.match(pattern[kind], lines[at])
            out.append(f"<h{len(m[1])}>{inline(m[2], refs)}</h{len(m[1])}>")
            at += 1
        elif kind == "quote":
            out.append(f"<blockquote>{render(chr(10).join(re.sub(pattern[kind], '', x, count=1) for x in take(kind)), refs)}</blockquote>")
        elif kind in ("ul", "ol"):
            out.append(f"<{kind}>{''.join(f'<li>{inline(re.sub(pattern[kind], "", x, count=1), refs)}</li>' for x in take(kind))}</{kind}>")
        elif kind == "paragraph":
            out.append(f"<p>{inline(' '.join(x.strip() for x in take(kind)), refs)}</p>")
        else:
            out += ["<hr>"] * (kind == "rule")
            at += 1
    return "".join(out)


def to_html(markdown: Column, references: Column | None = None) -> Column:
    """``references``: an array of structs with id, label, snippet, page_number and bbox."""
    if references is None:

        @F.pandas_udf("string")
        def plain(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for p in parts:
                yield p.map(lambda t: render(t))

        return plain(markdown)

    @F.pandas_udf("string")
    def run(texts: pd.Series, refs: pd.Series) -> pd.Series:
        return pd.Series([render(t, {str(x["id"]).lower(): x for x in (r if r is not None else ()) if x["id"]}) for t, r in zip(texts, refs, strict=True)])

    return run(markdown, references)
