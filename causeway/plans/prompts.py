"""Request texts for an outside advisor (an expert or a language model)."""

from __future__ import annotations

ROLE = (
    "You judge cause and effect between variables of one domain. Separate direct causes "
    "from mediated effects, shared causes and coincidence. Figures from the data are hints, "
    "not proof."
)
LIST_ONLY = "Answer with one list of quoted names and nothing else."

SYSTEM = {
    "column_grouping": f"{ROLE} Name the variables tied to the target by a direct causal link, "
                       f"as its causes or its effects. {LIST_ONLY}",
    "adaptive_sampling": f"{ROLE} Some causes of the target are uncertain. Name other variables "
                         f"to observe together with it: shared causes, mediators, or variables "
                         f"tied to one candidate only. {LIST_ONLY}",
    "parent_ordering": f"{ROLE} Choose the direct causes of the target among the candidates, "
                       f"strongest first. {LIST_ONLY}",
    "cycle_arbitration": f"{ROLE} A new edge would close a cycle. Choose the fewest numbered edges "
                         "whose removal breaks every path shown. Answer with a list of numbers, "
                         "or an empty list to refuse the new edge.",
    "refinement": f"{ROLE} Improve the graph by one step. Answer with exactly one of "
                  "add_edge(parent, child), delete_edge(parent, child) or terminate().",
    "confounder_review": f"{ROLE} Flag edges that a third variable of the list explains better. "
                         'Answer with a list of tuples [("parent", "confounder")], usually empty.',
    "orphan_repair": f"{ROLE} The target has no causes in the graph yet. Name its likely direct "
                     f"causes, most likely first, or none. {LIST_ONLY}",
    "ci_borderline": f"{ROLE} Give the probability that the independence holds, as one number "
                     "between 0.1 and 1.0.",
    "edge_check": f"{ROLE} Answer with a JSON object of percentages under the keys KEEP, FLIP and "
                  "REMOVE.",
    "edge_orient": f"{ROLE} Answer 1 if the first variable causes the second, 0 for the reverse.",
    "cycle_resolve": f"{ROLE} Break the cycle with one line: 'Remove: a and b' or 'Reverse: a and b'.",
    "structure_generation": f"{ROLE} Answer with a JSON object whose 'nodes' list gives each "
                            "node_name and its parents.",
    "root_search": f"{ROLE} Answer with names between <Answer> and </Answer>, separated by commas.",
}


def system_text(op: str) -> str:
    return SYSTEM.get(op, ROLE)
