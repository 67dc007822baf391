"""JSON-RPC 2.0 over standard input and output: the commands as tools.  A tool's error is data; the loop goes on."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterable
from dataclasses import fields

from .. import __version__
from ..operators.prepare import RAW_COLUMNS
from .analysis import Params
from .commands import Workbench, parse_time
from .report import reply

_TEXT, _LIST, _NUMBER = {"type": "string"}, {"type": "array"}, {"type": "number"}
TOOLS = {
    "submit_builds": ("Add build records to the store.", {"builds": _LIST, "source": _TEXT}, ["builds"]),
    "define_metric": ("Define a metric, or a new version of one.", {"name": _TEXT, "role": _TEXT, "direction": _TEXT, "expression": _TEXT, "notes": _TEXT}, ["name", "role", "direction", "expression"]),
    "list_metrics": ("Latest metric definitions.", {}, []),
    "list_groups": ("Groups that have builds.", {}, []),
    "list_windows": ("Retained windows and the gate.", {"as_of": _TEXT}, []),
    "compute": ("Run the analysis and store it.", {"objectives": _LIST, "groups": _LIST, "min_builds": _NUMBER, "bootstrap": _NUMBER, "permutations": _NUMBER, "as_of": _TEXT, "out": _TEXT}, []),
    "render": ("Write a run's page.", {"run_id": _TEXT, "out": _TEXT}, ["out"]),
    "explain": ("Why a cell is where it is.", {"cell": _TEXT, "run_id": _TEXT}, ["cell"]),
    "diff": ("What differs between two runs.", {"a": _TEXT, "b": _TEXT}, ["a", "b"]),
}


class Server:
    def __init__(self, bench: Workbench, root: str) -> None:
        self.bench, self.root = bench, os.path.realpath(root)

    def confined(self, path: str) -> str:
        """The path under the server's root; anything that leads out of it is refused."""
        full = os.path.realpath(os.path.join(self.root, path))
        if full != self.root and not full.startswith(self.root + os.sep):
            raise ValueError(f"path leads out of {self.root}")
        return full

    def _params(self, args: dict) -> Params:
        known = {f.name for f in fields(Params)}
        given = {k: v for k, v in args.items() if k in known and v is not None}
        given["as_of"] = parse_time(given.get("as_of"))
        return Params(**given)

    def call(self, name: str, args: dict) -> object:
        missing = [k for k in TOOLS[name][2] if args.get(k) is None]
        if missing:
            raise ValueError(f"missing: {', '.join(missing)}")
        b = self.bench
        match name:
            case "submit_builds":
                rows = [tuple(None if r.get(c) is None else str(r[c]) for c in RAW_COLUMNS) for r in args["builds"]]
                return b.ingest(b.spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in RAW_COLUMNS)), args.get("source") or "tool")
            case "define_metric":
                return b.define(args["name"], args["role"], args["direction"], args["expression"], args.get("notes") or "")
            case "list_metrics":
                return [m.as_dict() for m in b.metrics()]
            case "list_groups":
                return b._need_store().groups()
            case "list_windows":
                return b.windows(self._params(args))
            case "compute":
                got = b.compute(self._params(args), groups=args.get("groups"))
                if args.get("out"):
                    with open(self.confined(args["out"]), "w", encoding="utf-8") as f:
                        json.dump(got, f, default=str)
                return reply(got)
            case "render":
                path = self.confined(args["out"])
                with open(path, "w", encoding="utf-8") as f:
                    f.write(b.render(args.get("run_id")))
                return {"written": path}
            case "explain":
                return b.explain(args["cell"], args.get("run_id"))
            case _:
                return b.diff(args["a"], args["b"])

    def handle(self, message: object) -> dict | None:
        """The answer to one message; none to a notification."""
        if not isinstance(message, dict) or "method" not in message:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
        ident, method, args = message.get("id"), message["method"], message.get("params") or {}
        if "id" not in message:
            return None
        ok = lambda result: {"jsonrpc": "2.0", "id": ident, "result": result}
        if method == "initialize":
            return ok({"protocolVersion": args.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "millrace", "version": __version__}})
        if method == "ping":
            return ok({})
        if method == "tools/list":
            return ok({"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]})
        if method == "tools/call":
            name = args.get("name")
            try:
                if name not in TOOLS:
                    raise ValueError(f"no such tool: {name}")
                text, bad = json.dumps(self.call(name, args.get("arguments") or {}), default=str), False
            except Exception as e:  # a tool's error is its answer
                text, bad = f"{type(e).__name__}: {e}", True
            return ok({"content": [{"type": "text", "text": text}], "isError": bad})
        return {"jsonrpc": "2.0", "id": ident, "error": {"code": -32601, "message": f"no such method: {method}"}}


def serve(server: Server, lines: Iterable[str], out=sys.stdout) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            answer = server.handle(json.loads(line))
        except json.JSONDecodeError as e:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"cannot parse: {e}"}}
        if answer is not None:
            print(json.dumps(answer), file=out, flush=True)
