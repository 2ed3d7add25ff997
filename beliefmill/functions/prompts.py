"""Prompts of the extraction, verbalization and evaluation passes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (version, pass) to what the model is told to be. The wording is a parameter: pass another table to change it.
SYSTEM = {
    ("extract", "nodes"): "You read an article and name the variables of a causal model. Reply with JSON only.",
    ("extract", "edges"): "You read an article and name direct causes among given variables. Reply with JSON only.",
    ("extract", "marginals"): "You estimate the probability of each state of given variables from an article. Reply with JSON only.",
    ("extract", "joints"): "You estimate joint probabilities of pairs of variables from an article. Reply with JSON only.",
    ("extract", "multi_joints"): "You estimate joint probabilities of a variable and several causes from an article. Reply with JSON only.",
    ("verbalize", "text"): "You write prose that states every variable, state, cause and probability of a network.",
    ("evaluate", "nodes"): "You recover the variables of a causal model from a text. Reply with JSON only.",
    ("evaluate", "states"): "You recover the states of given variables from a text. Reply with JSON only.",
    ("evaluate", "edges"): "You recover direct causes among given variables from a text. Reply with JSON only.",
    ("evaluate", "cpd"): "You recover one table of conditional probabilities from a text. Reply with JSON only.",
    ("judge", "meaning"): "You match two lists of names. Names match if they mean the same or one clearly paraphrases the other. Reply with JSON only.",
    ("judge", "exact"): "You match two lists of names. Names match if they are equal but for very minor differences. Reply with JSON only.",
}
#: Characters of an article that the first prompt shows, and the later ones.
FIRST_SLICE, LATER_SLICE = 4000, 2000


def system(version: str, step: str) -> Column:
    return F.lit(SYSTEM[version, step])


def _with(text: Column, size: int, *lines) -> Column:
    parts = [x if isinstance(x, Column) else F.lit(x) for x in lines]
    return F.concat_ws("\n", *parts, F.lit("ARTICLE:"), F.substring(F.coalesce(text, F.lit("")), 1, size))


def nodes_prompt(text: Column) -> Column:
    return _with(text, FIRST_SLICE, "Name 1 to 20 variables, each with 2 to 6 states and the state none last.", 'Reply: {"nodes": [{"name": "...", "states": ["...", "none"]}]}')


def edges_prompt(text: Column, nodes: Column) -> Column:
    return _with(text, LATER_SLICE, F.concat(F.lit("VARIABLES: "), F.to_json(nodes)), "Name direct causes among them; there must be no cycle.", 'Reply: {"edges": [{"parent": "...", "child": "..."}]}')


def marginals_prompt(text: Column, nodes: Column) -> Column:
    return _with(text, LATER_SLICE, F.concat(F.lit("VARIABLES: "), F.to_json(nodes)), "Give each state a probability; those of a variable sum to 1.", 'Reply: {"marginals": {"variable": {"state": 0.5}}}')


def joints_prompt(text: Column, grids: Column) -> Column:
    """grids: an array of structs (parent, child, parent_states, child_states)."""
    return _with(text, LATER_SLICE, F.concat(F.lit("PAIRS: "), F.to_json(grids)), "Give each pair of states a probability; those of a pair of variables sum to 1.",
                 'Reply: {"joints": [{"parent": "...", "child": "...", "table": {"parent state": {"child state": 0.1}}}]}')


def multi_joints_prompt(text: Column, families: Column, n_combos: Column) -> Column:
    """families: an array of structs (child, parents, lists of states)."""
    return _with(text, LATER_SLICE, F.concat(F.lit("FAMILIES: "), F.to_json(families)), F.format_string("There are %d combinations of causes in all.", n_combos),
                 'Reply: {"multi_joints": [{"child": "...", "parents": ["..."], "table": {"A=a": {"B=b": {"child state": 0.1}}}}]}')


def recover_prompt(text: Column, step: str, given: Column) -> Column:
    """The evaluation passes: what to recover, given what the earlier passes found (JSON)."""
    asked = {"nodes": '{"nodes": ["..."]}', "states": '{"node_states": [{"node": "...", "states": ["..."]}]}', "edges": '{"edges": [{"parent": "...", "child": "..."}]}', "cpd": '{"matrix": [[0.5]]}'}
    return F.concat_ws("\n", F.lit(f"Recover the {step} of the network."), F.concat(F.lit("KNOWN: "), given), F.lit(f"Reply: {asked[step]}"), F.lit("TEXT:"), text)


def judge_prompt(predicted: Column, truth: Column, field: str = "matches") -> Column:
    reply = f'Reply: {{"{field}": [{{"predicted": "...", "ground_truth": "...", "score": 1}}], "unmatched_predicted": [], "unmatched_ground_truth": []}}'
    return F.concat_ws("\n", F.concat(F.lit("PREDICTED: "), F.to_json(predicted)), F.concat(F.lit("TRUE: "), F.to_json(truth)), F.lit(reply))
