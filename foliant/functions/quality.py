"""Predicates and scores for the prose quality of a passage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import WS, collapse, count_of, cut, has, strip, strip_end, strip_start, words_of, words_re
from foliant.functions.vectors import let

# The verbs and phrases that make a passage or a chunk prose, and every threshold and weight below.
VERBS = ("is", "are", "was", "were", "has", "have", "can", "will", "define", "describe", "explain", "show", "mean", "refer", "state", "present", "propose", "use")
CHUNK_VERBS = ("is", "are", "was", "were", "has", "have", "can", "will", "define", "present", "describe")
DEFINES = words_re("is defined as", "refers to", "we define", "means that", "can be described")
DEFINES_CHUNK = words_re("is defined as", "refers to", "we define")
#: "is a " and "is an " end in a space, so what follows must begin a word.
IS_A = r"(?i)(?<![A-Za-z0-9_])is an? (?=[A-Za-z0-9_])"


def is_noisy(text: Column) -> Column:
    """Short, full of dots, or with few ASCII letters."""
    s = collapse(text)
    n = F.length(s)
    return (n < 40) | (count_of(s, r"\.") / n > 0.1) | (count_of(s, "[a-zA-Z]") / n < 0.35)


def is_formula_heavy(text: Column) -> Column:
    """Many single letters or digits, or many mathematical signs."""
    s = collapse(text)
    ws = words_of(s)
    single = F.size(F.filter(ws, lambda w: F.regexp_like(w, F.lit("^[a-zA-Z0-9]$"))))
    return (single / F.size(ws) > 0.28) | (count_of(s, "[=+\\-×÷<>≤≥≈∑∏∫√]") / F.greatest(F.length(s), F.lit(1)) > 0.04)


def clean_snippet(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, f"{WS}+", " "), r" \. [0-9]+ ?$", ""))


def _score(s: Column, verbs: tuple[str, ...], defines: str) -> Column:
    return (
        F.least(F.size(words_of(s)) / 20, F.lit(1.0)) + F.when(has(s, words_re(*verbs)), 0.3).otherwise(0.0)
        + F.when(has(s, "[.!?]"), 0.2).otherwise(0.0) + F.when(has(s, defines) | has(s, IS_A), 0.5).otherwise(0.0)
    )


def readability(text: Column) -> Column:
    return F.when(is_formula_heavy(text), 0.0).otherwise(_score(clean_snippet(text), VERBS, DEFINES))


def chunk_readability(text: Column) -> Column:
    s = collapse(F.coalesce(text, F.lit("")))
    return F.when((F.length(s) < 40) | is_formula_heavy(s), 0.0).otherwise(_score(s, CHUNK_VERBS, DEFINES_CHUNK))


def truncate_for_prompt(text: Column, n: int = 220) -> Column:
    clean = clean_snippet(F.coalesce(text, F.lit("")))
    return F.when(F.length(clean) <= n, clean).otherwise(F.concat(strip_end(cut(clean, n)), F.lit("…")))


#: Characters of an answer's end that tell whether it breaks off, if they are not all white space and closing signs.
END = 200
CLOSERS = "\"'”’\\])}"
NOT_WS = rf"[^{WS[1:-1]}]"


def looks_truncated(text: Column) -> Column:
    """Whether a generated answer breaks off: no sentence end, and a dangling sign or letter."""
    told = lambda e: has(e, rf"[^{WS[1:-1]}\x{{85}}{CLOSERS}]")  # noqa: E731  then the rest of the text does not matter
    dangles = lambda s: F.when(s == "", False).when(has(s, rf"[.!?][{CLOSERS}]*$"), False).when(has(s, r"[:;,(\[{/-]$"), True).otherwise(has(s, r"[A-Za-z0-9\])}]$"))
    return let(F.coalesce(text, F.lit("")), lambda t: let(let(F.right(t, F.lit(END)), lambda e: strip(F.when(told(e), e).otherwise(t))), dangles))


def merge_continuation(left: Column, right: Column) -> Column:
    """Append a continuation without the words it repeats (an overlap of 12 to 80 characters, case-blind).

    Each value is bound once, and white space is looked for at the ends only.
    """
    blank = lambda t: ~has(t, NOT_WS)
    most = lambda e: F.least(F.length(e["a"]), F.length(e["b"]))
    sizes = lambda e: F.when(most(e) >= 12, F.sequence(most(e), F.lit(12), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    # Only the ends that may overlap are compared.
    ends = lambda p: F.struct(F.right(p["left"], F.lit(80)).alias("a"), F.left(p["tail"], F.lit(80)).alias("b"))
    overlap = lambda p: let(ends(p), lambda e: F.coalesce(F.get(F.filter(sizes(e), lambda n: F.lower(F.right(e["a"], n)) == F.lower(F.left(e["b"], n))), F.lit(0)), F.lit(0)))
    rest = lambda p: let(overlap(p), lambda n: F.when(n > 0, strip_start(F.substring(p["tail"], n + 1, F.length(p["tail"])))).otherwise(p["tail"]))

    def joined(p: Column, r: Column) -> Column:
        no_space = has(r, r"^[,.;:!?)/\]}]") | has(F.right(p["left"], F.lit(3)), f"{WS}$") | has(p["right"], f"^{WS}")
        return F.when(blank(p["left"]), p["tail"]).when(blank(p["right"]), p["left"]).when(r == "", p["left"]).when(no_space, F.concat(p["left"], r)).otherwise(F.concat(p["left"], F.lit(" "), r))

    both = let(F.struct(F.coalesce(left, F.lit("")).alias("left"), F.coalesce(right, F.lit("")).alias("right")), lambda p: F.struct(p["left"].alias("left"), p["right"].alias("right"), strip_start(p["right"]).alias("tail")))
    return let(both, lambda p: let(rest(p), lambda r: joined(p, r)))
