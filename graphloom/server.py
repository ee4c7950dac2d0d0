"""Answers over standard input and output: JSON-RPC 2.0, a message a line, as tool servers speak it."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import TextIO

from graphloom.engine import Engine

_TEXT, _NUMBER, _YES = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
# name -> (what it does, arguments, those that must be there)
TOOLS = {
    "explore": ("Files that answer a question, with their source", {"query": _TEXT, "maxFiles": _NUMBER}, ["query"]),
    "context": ("Entry points, related symbols and code for a question", {"query": _TEXT}, ["query"]),
    "search": ("Symbols by name and text", {"query": _TEXT, "kind": _TEXT, "limit": _NUMBER}, ["query"]),
    "callers": ("What calls a symbol", {"symbol": _TEXT, "file": _TEXT, "limit": _NUMBER}, ["symbol"]),
    "callees": ("What a symbol calls", {"symbol": _TEXT, "file": _TEXT, "limit": _NUMBER}, ["symbol"]),
    "node": ("A symbol's definitions, or a file's lines", {"symbol": _TEXT, "file": _TEXT, "includeCode": _YES, "offset": _NUMBER, "limit": _NUMBER, "symbolsOnly": _YES}, []),
}
MISSING = "Nothing is indexed in this folder yet. Index a repository first: python -m graphloom FOLDER index ROOT."


def answer(engine: Engine, tool: str, a: dict) -> str:
    """The text of one tool's answer; guidance where there is nothing to tell."""
    if not engine.ready:
        return MISSING
    if tool == "explore":
        return engine.explore(a["query"], a.get("maxFiles"))
    if tool == "context":
        return engine.context(a["query"])
    if tool == "node":
        return engine.node(a.get("symbol"), a.get("file"), bool(a.get("includeCode")), a.get("offset") or 1, a.get("limit") or 2000, bool(a.get("symbolsOnly")))
    if tool == "search":
        rows = engine.search(a["query"], a.get("kind"), a.get("limit") or 10).collect()
        return "\n".join(f"{r['name']} ({r['kind']}) - {r['file_path']}:{r['start_line']}" for r in rows) or f'Nothing matches "{a["query"]}". Try another word, or explore.'
    rows = getattr(engine, tool)(a["symbol"], 2, a.get("file"), a.get("limit") or 20).collect()
    return "\n".join(f"{'  ' * (r['depth'] - 1)}{r['name']} ({r['kind']}) - {r['file_path']}:{r['start_line']}" for r in rows) or f'No {tool} of "{a["symbol"]}" are indexed.'


def handle(engine: Engine, message: dict) -> dict | None:
    """The reply to one message; notifications have none."""
    method, params = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    reply: dict = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        note = f"{engine.n_files} files are indexed." if engine.ready else MISSING
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "0.2"}, "instructions": note}}
    if method == "tools/list":
        tools = [{"name": k, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for k, (d, p, r) in TOOLS.items()]
        return reply | {"result": {"tools": tools if engine.ready else []}}
    if method == "tools/call" and params.get("name") in TOOLS:
        given = params.get("arguments") or {}
        lacking = [x for x in TOOLS[params["name"]][2] if not given.get(x)]
        text = f"Say also: {', '.join(lacking)}." if lacking else answer(engine, params["name"], given)
        return reply | {"result": {"content": [{"type": "text", "text": text}]}}
    if method == "ping":
        return reply | {"result": {}}
    return reply | {"error": {"code": -32601, "message": f"unknown method or tool: {method} {params.get('name', '')}".strip()}}


def serve(engine: Engine, lines: TextIO = sys.stdin, write: Callable[[str], object] = print) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = handle(engine, json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            write(json.dumps(reply, ensure_ascii=False))
