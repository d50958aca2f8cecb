"""Query rewriting and intents.

The alternatives in each pattern are fixed values: they decide what is found, and so must stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import START, STOP, WS, collapse, has, strip, words_re

#: Words that say nothing about what a profile entry is about.
PROFILE_STOPWORDS = (
    "about after before between could describe does explain from have into just main more over paper section should show "
    "some than that their there these this those what when where which with would"
).split()


def clean_query(prompt: Column) -> Column:
    """The words to search for: without navigation, question lead-ins, page numbers and final signs."""
    s = F.regexp_replace(prompt, words_re("open", "show", "find", "search", "jump", "go to", "take me to", "please", "the", "an?"), " ")
    s = F.regexp_replace(s, words_re("what is", "what are", "how does", "how do", "explain", "tell me", "describe", "define", "give me"), " ")
    s = F.regexp_replace(s, rf"(?i){START}page{WS}+[0-9]+{STOP}", " ")
    return collapse(F.regexp_replace(s, "[?!]+$", ""))


def is_correction(prompt: Column) -> Column:
    return has(prompt, words_re("that’?s? (?:not|wrong|incorrect|bad)", "no[,.]? (?:that’?s?|it’?s?)", "not what", "again", "retry", "redo", "try again", "more detail", "expand", "elaborate")) | has(prompt, rf"(?i){START}not (?:a|the) (?=[A-Za-z0-9_])")


def is_pointing(prompt: Column) -> Column:
    return has(prompt, words_re("point (?:it|that)? out", "point me to", "show me where", "where is that", "where is it", "open that", "open it", "take me there", "jump there"))


def is_summary_like(q: Column) -> Column:
    return has(q, words_re("summar", "overview", "main point", "main idea", "what is this about", "what is the paper about", "whole document", "entire document", "big picture"))


def is_broad(q: Column) -> Column:
    return has(q, words_re("summar", "overview", "explain", "describe", "compare", "why", "how", "walk me through", "tell me about", "what does .* mean"))


def wants_summary(q: Column) -> Column:
    return has(F.lower(q), words_re("summar", "overview", "what is this", "what(?:‘s| is) (?:this|the (?:paper|doc|article))", "about", "main (?:point|topic|idea|finding|contribution|argument)", "tl;?dr", "in a nutshell"))


def wants_list(q: Column) -> Column:
    return has(F.lower(q), words_re("list", "enumerate", "what are (?:the|all)", "all the", "every", "each", "bullet"))


def wants_definition(q: Column) -> Column:
    # Alternatives that end in a space need a word after it; "what is " may be followed by an article.
    q = F.lower(q)
    return has(q, rf"{START}(?:what is (?:a |an |the )?|define |meaning of )(?=[a-z0-9_])") | has(q, words_re("explain (?:what|how)", "how does"))


def is_navigation(prompt: Column) -> Column:
    return has(prompt, words_re("open", "show", "jump", "take me", "go to", "navigate"))


def topic(q: Column) -> Column:
    """What "what is ..." asks about, or null."""
    found = F.regexp_extract(q, r"(?i)what is (?:a |an |the )?([^\n\r\x{2028}\x{2029}]+?)[?.]*$", 1)
    return F.nullif(strip(found), F.lit(""))


def explicit_page(prompt: Column) -> Column:
    return F.regexp_extract(prompt, rf"(?i){START}page{WS}+([0-9]+){STOP}", 1).try_cast("int")


def profile_terms(q: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(q, F.lit(""))), F.lit("([a-z0-9]{3,})"), 1)
    return F.array_except(found, F.array(*map(F.lit, PROFILE_STOPWORDS)))


def is_substantive(text: Column) -> Column:
    return F.size(F.split(strip(text), f"{WS}+")) > 3


def prompt_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{WS}+"), lambda w: w != ""))
