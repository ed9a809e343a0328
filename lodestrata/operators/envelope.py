"""Answers of bounded size: an envelope fitted to a token budget, text lines, a self-contained HTML page.

Everything here works on at most ``limit`` rows that a plan has already cut down.
"""

from __future__ import annotations

import html
import json
import os
import re
import unicodedata
import uuid

from ..codes import CJK_RANGES, FLAGS, NODE_KINDS

SCHEMA_VERSION = 1
OK, NOTHING, USAGE, CORRUPT, PARTIAL, IO, INTERNAL = 0, 1, 2, 3, 4, 5, 70
LIMIT, MOST, BUDGET, LEAST_BUDGET, MOST_BUDGET = 50, 10_000, 8000, 256, 1_000_000
_CJK = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES) + "]")
_UNSAFE = re.compile("[\x00-\x1f\x7f-\x9f\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]")


def estimate(text: str) -> int:
    ascii_ = sum(c < "\x80" for c in text)
    cjk = len(_CJK.findall(text))
    return -(-ascii_ // 4) + cjk + -(-(len(text) - ascii_ - cjk) // 2)


def bounded(value: int, default: int, least: int, most: int, name: str) -> int:
    """0 asks for the default; a value out of range is an error, never clamped."""
    if value == 0:
        return default
    if not least <= value <= most:
        raise ValueError(f"{name} must lie between {least} and {most}")
    return value


def _whole(command: str, generation: str, query: dict, summary: dict, nodes: list[dict], edges: list[dict], omitted: tuple[int, int, int], diagnostics: list[dict], truncated: bool) -> str:
    """truncated: a safety limit cut the search itself, so what is counted as omitted is a lower bound."""
    cut = truncated or any(omitted)
    code = PARTIAL if cut else OK if summary["found"] else NOTHING
    body = {
        "schemaVersion": SCHEMA_VERSION, "command": command, "generation": generation, "query": query, "summary": summary, "nodes": nodes, "edges": edges, "diagnostics": diagnostics,
        "truncated": cut, "omittedCount": sum(omitted), "omittedNodeCount": omitted[0], "omittedEdgeCount": omitted[1], "omittedDiagnosticCount": omitted[2], "omittedCountIsLowerBound": truncated, "exitCode": code,
    }
    # the estimate counts its own digits: a fixed point
    guess = 0
    while True:
        text = json.dumps(body | {"tokenEstimate": guess, "tokenEstimateMethod": "ascii/4+cjk+other/2"}, ensure_ascii=False, separators=(",", ":"))
        if (real := estimate(text)) == guess:
            return text
        guess = max(real, guess + (real < guess))


def fit(
    command: str, generation: str, query: dict, nodes: list[dict], edges: list[dict] | None = None, total: int | None = None, budget: int = 0, truncated: bool = False,
    diagnostics: list[dict] | None = None, summary: dict | None = None, total_edges: int | None = None,
) -> str:
    """The longest prefix of ranked nodes whose exact serialization fits the budget; edges need both ends kept.

    total and total_edges count what there is, if more than what was handed over; diagnostics that don't fit beside
    no node at all are left out from the end and counted.
    """
    budget = bounded(budget, BUDGET, LEAST_BUDGET, MOST_BUDGET, "budget")
    edges, total, diagnostics = edges or [], len(nodes) if total is None else total, diagnostics or []
    total_edges = len(edges) if total_edges is None else total_edges
    summary = {"found": total} | (summary or {})

    def made(n: int, told: int) -> str:
        kept = nodes[:n]
        ids = {x.get("node_id") for x in kept}
        mine = [e for e in edges if e["src"] in ids and e["dst"] in ids]
        return _whole(command, generation, query, summary, kept, mine, (total - n, total_edges - len(mine), len(diagnostics) - told), diagnostics[:told], truncated)

    told = len(diagnostics)
    while told and estimate(made(0, told)) > budget:
        told //= 2
    low, high = 0, len(nodes)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if estimate(made(middle, told)) <= budget else (low, middle - 1)
    return made(low, told)


def error(command: str, message: str, code: int, budget: int = 0) -> str:
    """An error as an envelope; a message too long for the budget loses its middle."""
    budget = bounded(budget, BUDGET, LEAST_BUDGET, MOST_BUDGET, "budget")
    keep = len(message)
    while True:
        said = message if keep >= len(message) else message[: keep // 2] + " ... " + message[len(message) - keep // 2 :]
        text = json.dumps({"schemaVersion": SCHEMA_VERSION, "command": command, "diagnostics": [{"kind": "Error", "detail": said}], "exitCode": code}, ensure_ascii=False)
        if estimate(text) <= budget or keep < 8:
            return text
        keep //= 2


def line(node: dict) -> str:
    """One node as a line for a terminal; characters that could steer it are replaced."""
    where = f" {node['file_path']}:{node.get('start_line') or 1}" if node.get("file_path") else ""
    kind = node.get("kind")
    kind = NODE_KINDS[kind - 1] if isinstance(kind, int) and 1 <= kind <= len(NODE_KINDS) else kind
    flags = [name for i, name in enumerate(FLAGS) if (node.get("flags") or 0) >> i & 1]
    match = f" <{('exact', 'prefix', 'substring')[node['strength']]}>" if node.get("strength") in (0, 1, 2) else ""
    far = f" ({node['distance']})" if node.get("distance") is not None else ""
    return _UNSAFE.sub("\ufffd", f"{kind} {node.get('qualified_name')}{where}{' [' + ' '.join(flags) + ']' if flags else ''}{match}{far}")


def lines(envelope: str) -> str:
    """An envelope's nodes for a terminal, and what was left out."""
    whole = json.loads(envelope)
    out = [line(n) for n in whole["nodes"]]
    if whole["omittedCount"]:
        out.append(f"... {'at least ' if whole['omittedCountIsLowerBound'] else ''}{whole['omittedCount']} more")
    return "\n".join(out)


_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:1em}}input{{margin:.5em 0}}li{{cursor:pointer}}.on{{font-weight:bold}}#n,#e{{columns:2}}</style>
<h1>{title}</h1><input id="q" placeholder="filter"><p id="c"></p><ul id="n"></ul><h2>Links</h2><ul id="e"></ul>
<script type="application/json" id="data">{data}</script>
<script>
const d=JSON.parse(document.getElementById("data").textContent),by=new Map(d.nodes.map(x=>[x.node_id,x]));let at=null;
const el=(id)=>document.getElementById(id),name=(i)=>(by.get(i)||{{}}).qualified_name||i;
function show(){{const q=el("q").value.toLowerCase(),s=d.nodes.filter(x=>x.qualified_name.toLowerCase().includes(q));el("c").textContent=s.length+" of "+d.nodes.length;
el("n").replaceChildren(...s.map(x=>{{const li=document.createElement("li");li.textContent=x.qualified_name;li.className=x.node_id===at?"on":"";li.onclick=()=>{{at=x.node_id;show()}};return li}}));
el("e").replaceChildren(...d.edges.filter(x=>x.src===at||x.dst===at).map(x=>{{const li=document.createElement("li");li.textContent=name(x.src)+" -"+x.kind+"-> "+name(x.dst);return li}}))}}
el("q").oninput=show;show();
</script>"""


def page(title: str, nodes: list[dict], edges: list[dict], most_nodes: int = 20_000, most_edges: int = 50_000) -> str:
    """Data stand in a JSON block in which no character can end the block; names never become markup."""
    nodes = nodes[:most_nodes]
    ids = {x["node_id"] for x in nodes}
    edges = [e for e in edges if e["src"] in ids and e["dst"] in ids][:most_edges]
    data = json.dumps({"nodes": nodes, "edges": edges}, ensure_ascii=True).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    return _PAGE.format(title=html.escape(unicodedata.normalize("NFC", title)), data=data)


def write_page(path: str, text: str) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temporary, path)
