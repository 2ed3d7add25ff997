"""Column functions on replies, prompts and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import strength

FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def sliced_json(raw: Column) -> Column:
    """From the first { to the last }, fence marks removed; null without both."""
    text = F.trim(F.regexp_replace(raw, r"```(?:json)?", ""))
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & F.contains(text, F.lit("}")) & (last >= first), F.substr(text, first, last - first + 1))


def fenced_json(raw: Column) -> Column:
    """The first fenced object anywhere, else the slice."""
    return F.coalesce(F.nullif(F.regexp_extract(raw, FENCED, 1), F.lit("")), sliced_json(raw))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for an empty text."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " ")))


def xml_escaped(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def wrapped(text: Column, width: int = 18, lines: int = 2) -> Column:
    """Lines of whole words, greedily filled to `width` characters; the first `lines` of them."""

    def step(acc, word):
        last = F.element_at(acc, -1)
        joins = F.coalesce(F.length(last) + 1 + F.length(word) <= width, F.lit(False))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), word)))
        return F.when(F.size(acc) == 0, F.array(word)).when(joins, grown).otherwise(F.array_append(acc, word))

    empty = F.array().cast("array<string>")
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.slice(F.aggregate(words, empty, lambda acc, w: F.when(F.size(acc) == 0, F.array(w)).otherwise(step(acc, w))), 1, lines)


def missing_from(text: Column, nodes: Column) -> Column:
    """Names that a text doesn't contain, any case: NODE: n, then STATE: n=s for each node in order.

    nodes is an array of structs (node, states). A substring counts, so 'none' is found inside other words.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    out = lambda n: F.concat(
        F.when(~F.contains(low, F.lower(n["node"])), F.array(F.concat(F.lit("NODE: "), n["node"]))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(n["states"], lambda s: ~F.contains(low, F.lower(s))), lambda s: F.concat(F.lit("STATE: "), n["node"], F.lit("="), s)),
    )
    return F.flatten(F.transform(nodes, out))


def prior_line(node: Column, state: Column, p: Column) -> Column:
    return F.format_string("  P(%s=%s) = %.4f  [%s]", node, state, p, strength(p))


def cpd_line(node: Column, state: Column, parent: Column, parent_state: Column, p: Column) -> Column:
    return F.format_string("  P(%s=%s | %s=%s) = %.4f  [%s]", node, state, parent, parent_state, p, strength(p))


def with_none(states: Column) -> Column:
    """The states, and None at the end unless some state is none in any case."""
    return F.when(F.exists(states, lambda s: F.lower(s) == "none"), states).otherwise(F.array_append(states, F.lit("None")))
