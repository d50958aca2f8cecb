"""Text helpers as column builders. White space is the wide class below; lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, with the no-break space, the byte-order mark and all Unicode separators.
WS = r"[\s\x{a0}\p{Z}\x{feff}]"
#: Word boundaries that look at ASCII word characters only.
START, STOP = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+$", "")


def strip_start(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+", "")


def cut(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def words_re(*words: str) -> str:
    """A case-blind pattern for whole ASCII words."""
    return rf"(?i){START}(?:{'|'.join(words)}){STOP}"


def words_of(compact: Column) -> Column:
    """The parts between single spaces; an empty text has one empty word."""
    return F.split(compact, " ")


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with a set number of digits, ties away from zero by the decimal reading of the double."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


def snippet(text: Column, n: int = 180) -> Column:
    return cut(collapse(text), n)


def snippet_for(text: Column, query: Column) -> Column:
    """The text around the first case-blind hit of the query, else its beginning."""
    compact, q = collapse(text), F.coalesce(query, F.lit(""))
    at = F.instr(F.lower(compact), F.lower(q)) - 1
    start, size = F.greatest(F.lit(0), at - 60), F.length(compact)
    end = F.least(size, at + F.length(F.lower(q)) + 90)
    around = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(compact, start + 1, end - start), F.when(end < size, "...").otherwise(""))
    return F.when((q == "") | (at < 0), cut(compact, 180)).otherwise(around)


def encode_key(value: Column) -> Column:
    """A file name for any string: ``blob-`` and the lower hexadecimal of its UTF-8 bytes."""
    return F.concat(F.lit("blob-"), F.lower(F.hex(F.encode(value, "UTF-8"))))


def relative_path(base: Column, relative: Column) -> Column:
    return F.concat(F.regexp_replace(base, "[^/]*$", ""), relative)


def url_path(path: Column) -> Column:
    """Each segment percent-encoded; a space is %20 and ! ' ( ) * ~ stay."""
    def one(s: Column) -> Column:
        out = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
        for raw, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
            out = F.replace(out, F.lit(code), F.lit(raw))
        return out

    return F.array_join(F.transform(F.split(path, "/"), one), "/")


def format_bytes(n: Column) -> Column:
    """1024-based units up to TB; whole numbers from 100 on and for bytes, else one digit."""
    n = n.cast("double")
    out = F.when(n.isNull() | F.isnan(n) | (n <= 0) | (n == float("inf")), "0 B")
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        v = n / float(1024**k)
        shown = F.format_string("%.0f " + unit, v) if k == 0 else F.when(v >= 100, F.format_string("%.0f " + unit, v)).otherwise(F.format_string("%.1f " + unit, v))
        out = out.when((v < 1024) | F.lit(k == 4), shown)
    return out


def escape_html(text: Column) -> Column:
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def safe_url(url: Column) -> Column:
    """The URL if its scheme is http, https or mailto, or if it has none (then it is relative); else null."""
    scheme = F.lower(F.regexp_extract(strip(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(scheme.isin("", "http", "https", "mailto"), strip(url))


def line_class(line: Column) -> Column:
    """The Markdown block a line begins."""
    return (
        F.when(has(line, rf"^{WS}*$"), "blank").when(has(line, "^```"), "fence").when(has(line, rf"^#{{1,6}}{WS}+"), "heading").when(has(line, rf"^{WS}*>{WS}?"), "quote")
        .when(has(line, rf"^{WS}*[-*+]{WS}+"), "unordered").when(has(line, rf"^{WS}*[0-9]+\.{WS}+"), "ordered").when(has(strip(line), "^---+$"), "rule").otherwise("paragraph")
    )


def sanitize_generated(text: Column) -> Column:
    return collapse(F.regexp_replace(text, r"<\|[^|>]+?\|>", " "))


def title_of(title: Column, file_name: Column, default: str) -> Column:
    return F.coalesce(F.nullif(strip(title), F.lit("")), F.nullif(file_name, F.lit("")), F.lit(default))
