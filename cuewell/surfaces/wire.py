"""Requests as lines: tab-parted verbs, and tools over JSON lines."""

from __future__ import annotations

import json

from .cli import shown
from .session import VERBS, Session

#: Tools by the verb that they run, with what they are for.
TOOLS = {
    "route": ("route", "Whether a question can be answered from memory"),
    "recall": ("recallmany", "Facts that match a query, best first"),
    "recall_associative": ("assoc", "Facts reached from a query by what they share"),
    "recall_context": ("context", "Passages around the best facts"),
    "read_doc": ("read", "A page of a scope"),
    "recall_value": ("recallvalue", "The value that answers a query"),
    "recall_chain": ("chain", "A start followed along relations, parted by bars"),
    "remember": ("observe", "Writes a text as facts"),
    "note": ("stance", "Writes a feeling about a topic, parted by a colon"),
    "recall_var": ("getvar", "A variable's value"),
    "forget": ("forget", "Deletes facts that hold some words, or a whole scope"),
    "stats": ("stats", "How much a scope holds"),
    "caps": ("caps", "What is served, and by whom"),
    "feel": ("mood", "Sets or tells the mood"),
    "humanize": ("affect", "The mood and view that colour an answer"),
}


def mem(session: Session, line: str) -> str:
    """The text answer of one 'verb TAB scope TAB words' line; empty for a verb that doesn't exist."""
    verb, scope, words = (line.split("\t", 2) + ["", ""])[:3]
    if verb not in VERBS:
        return ""
    answer = session.run(verb, scope, words.replace("\t", " "))
    return "" if answer is None else shown(answer)


def serve_lines(session: Session, lines, out) -> None:
    """An answer line for each request line, its line breaks escaped."""
    for line in lines:
        print(mem(session, line.rstrip("\n")).replace("\\", "\\\\").replace("\n", "\\n"), file=out, flush=True)


def call(session: Session, request: dict) -> dict | None:
    """The reply to one tool request; None for a notice."""
    method, number = request.get("method"), request.get("id")
    reply = lambda **x: {"jsonrpc": "2.0", "id": number, **x}
    if number is None:
        return None
    if method == "initialize":
        return reply(result={"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "cuewell", "version": "1"}})
    if method == "ping":
        return reply(result={})
    if method == "tools/list":
        fields = {"type": "object", "properties": {"scope": {"type": "string"}, "text": {"type": "string"}}, "required": ["scope"]}
        return reply(result={"tools": [{"name": n, "description": d, "inputSchema": fields} for n, (_, d) in TOOLS.items()]})
    if method == "tools/call":
        given = request.get("params") or {}
        name, args = given.get("name"), dict(given.get("arguments") or {})
        if name not in TOOLS:
            return reply(error={"code": -32602, "message": f"no such tool: {name}"})
        try:
            answer = session.run(TOOLS[name][0], args.pop("scope", ""), args.pop("text", ""), **args)
        except (ValueError, TypeError) as e:
            return reply(result={"content": [{"type": "text", "text": str(e)}], "isError": True})
        return reply(result={"content": [{"type": "text", "text": shown(answer)}]})
    return reply(error={"code": -32601, "message": f"no such method: {method}"})


def serve_tools(session: Session, lines, out) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            answer = call(session, json.loads(line))
        except ValueError:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if answer is not None:
            print(json.dumps(answer, ensure_ascii=False), file=out, flush=True)
