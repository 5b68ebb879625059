"""The tool server: JSON-RPC over lines of standard input and output."""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from .engine import Engine, SearchOptions
from .errors import SearchError
from .functions.filetypes import LANGUAGES
from .operators import formats
from .plans import regex
from .sources import index as indexes

VERSION = "0.1.0"
#: Codes of the protocol.
PARSE_ERROR, NO_METHOD, BAD_PARAMS = -32700, -32601, -32602
#: Keywords before the name of what is defined.
DEFINITION = r"(?:pub\s+)?(?:fn|struct|enum|trait|type|impl|class|def|function|func|fun|const|let|var|val|interface)\s+{}\b"
DEFINITIONS = 20


def _schema(required: list[str], **properties) -> dict:
    kinds = {k: {"type": t, "description": d} for k, (t, d) in properties.items()}
    return {"type": "object", "properties": kinds} | ({"required": required} if required else {})


TOOLS = {
    "search": (
        "Search the files for a pattern and show matching lines with context.",
        _schema(["pattern"], pattern=("string", "Literal text, or a regular expression if regex is true"), regex=("boolean", "Whether pattern is a regular expression (default: false)"), case_insensitive=("boolean", "Ignore case (default: false)"), file_type=("string", "Only files of a type, such as rs, py, js"), path_pattern=("string", "Only paths with this substring"), max_results=("integer", "Most results (default: 20)"), context_lines=("integer", "Lines around each match (default: 3)"), max_tokens=("integer", "Most tokens of output (default: 4000)")),
    ),
    "find_definitions": (
        "Find likely definitions of a symbol by keywords; there may be false positives.",
        _schema(["symbol"], symbol=("string", "Name to find definitions of"), file_type=("string", "Only files of a type, such as rs, py, js"), path_pattern=("string", "Only paths with this substring")),
    ),
    "index_status": ("Show the index's state and number of files.", _schema([])),
    "build_index": ("Build the index, or bring it up to date.", _schema([])),
    "read_file": (
        "Show a file, or some of its lines, with line numbers.",
        _schema(["path"], path=("string", "Path relative to the root"), start_line=("integer", "First line, from 1"), end_line=("integer", "Last line")),
    ),
}


class BadParameter(ValueError):
    pass


def text_param(params: dict, key: str) -> str | None:
    value = params.get(key)
    return value if isinstance(value, str) else None


def int_param(params: dict, key: str, default: int) -> int:
    if key not in params:
        return default
    value = params[key]
    if not isinstance(value, int) or isinstance(value, bool):
        raise BadParameter(f"'{key}' takes a whole number, not {json.dumps(value)}")
    if value < 0:
        raise BadParameter(f"'{key}' takes a number from 0 on, not {value}")
    return value


def bool_param(params: dict, key: str) -> bool:
    value = params.get(key, False)
    if not isinstance(value, bool):
        raise BadParameter(f"'{key}' takes true or false, not {json.dumps(value)}")
    return value


def required(params: dict, key: str) -> str:
    value = text_param(params, key)
    if value is None:
        raise BadParameter(f"'{key}' has to be given")
    return value


def definition_pattern(symbol: str) -> str:
    """A pattern for likely definitions of a symbol."""
    return DEFINITION.format(regex.escape(symbol))


def markdown(engine: Engine, results, context: int, max_tokens: int | None, root: str | None = None) -> str:
    """The blocks of results, which are few, as one text."""
    names = [r[0] for r in results.select("file").distinct().collect()]
    files = engine.corpus(names)
    blocks = formats.markdown_blocks(results, files, context, root)
    if max_tokens is None:
        return "\n".join(r["text"] for r in blocks.orderBy("file", "island").collect())
    shown = formats.within_budget(blocks, results, max_tokens).orderBy("file").collect()
    out = "\n".join(r["text"] for r in shown)
    if shown and (shown[-1]["more_files"] or shown[-1]["more_matches"]):
        out += f"\n... (truncated, {shown[-1]['more_matches']} more matches in {shown[-1]['more_files']} more files)\n"
    return out


def search(engine: Engine, params: dict) -> str:
    pattern = required(params, "pattern")
    most, context, tokens = int_param(params, "max_results", 20), int_param(params, "context_lines", 3), int_param(params, "max_tokens", 4000)
    options = SearchOptions(bool_param(params, "case_insensitive"), bool_param(params, "regex"), text_param(params, "file_type"), most, path_pattern=text_param(params, "path_pattern"))
    results = engine.search(pattern, options).cache()
    head = formats.summary(results, most).first()["header"]
    return f"{head}\n\n{markdown(engine, results, context, tokens)}"


def find_definitions(engine: Engine, params: dict) -> str:
    symbol = required(params, "symbol")
    options = SearchOptions(regex=True, file_type=text_param(params, "file_type"), max_count=DEFINITIONS, path_pattern=text_param(params, "path_pattern"))
    results = engine.search(definition_pattern(symbol), options).cache()
    n = formats.summary(results).first()
    return f"Found {n['matches']} definitions of '{symbol}' in {n['files']} files\n\n{markdown(engine, results, 3, None)}"


def build_index(engine: Engine, params: dict) -> str:
    began = time.time()
    engine.build_index()
    return f"The index is up to date after {time.time() - began:.2f} s ({indexes.size_on_disk(engine.spark, engine.index_path)} bytes)"


def index_status(engine: Engine, params: dict) -> str:
    return engine.index_status()


def read_file(engine: Engine, params: dict) -> str:
    path = required(params, "path")
    if engine.root is not None:
        root, full = Path(engine.root).resolve(), Path(engine.root, path).resolve()
        if not full.exists():
            raise BadParameter(f"there is no file '{path}'")
        if not full.is_relative_to(root):
            raise BadParameter(f"'{path}' is not below the folder that is served")
        try:
            lines = full.read_bytes().decode().replace("\r\n", "\n").split("\n")
        except (OSError, UnicodeDecodeError) as e:
            raise BadParameter(f"'{path}' cannot be read: {e}") from e
    else:
        found = engine.corpus([path]).select("content").first()
        if found is None:
            raise BadParameter(f"there is no file '{path}'")
        lines = found["content"].replace("\r\n", "\n").split("\n")
    if lines[-1] == "":
        lines.pop()
    if not lines:
        return f"## {path}\n\n(no lines)\n"
    start = min(max(int_param(params, "start_line", 1), 1), len(lines))
    end = min(max(int_param(params, "end_line", len(lines)), start), len(lines))
    body = "".join(f"{n:4} | {lines[n - 1]}\n" for n in range(start, end + 1))
    return f"## {path}:{start}-{end}\n\n```{LANGUAGES.get(Path(path).suffix[1:], '')}\n{body}```\n"


HANDLERS = {"search": search, "find_definitions": find_definitions, "index_status": index_status, "build_index": build_index, "read_file": read_file}


def call(engine: Engine, name: str, params: dict) -> dict:
    """The result of a tool: its text, and whether it is an error."""
    try:
        text, failed = HANDLERS[name](engine, params), False
    except BadParameter as e:
        text, failed = str(e), True
    except SearchError as e:
        text, failed = f"{name} failed: {e}", True
    return {"content": [{"type": "text", "text": text}]} | ({"isError": True} if failed else {})


def handle(engine: Engine, message: dict) -> dict | None:
    """The response to a message, None to a notification."""
    if message.get("id") is None:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method", ""), message.get("params") or {}
    if method == "initialize":
        names = ", ".join(HANDLERS)
        return reply | {"result": {"protocolVersion": "2025-03-26", "capabilities": {"tools": {}}, "serverInfo": {"name": "trisearch", "version": VERSION}, "instructions": f"An indexed text and code search engine. Tools: {names}."}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s) in TOOLS.items()]}}
    if method == "tools/call":
        name = params.get("name", "")
        if name not in HANDLERS:
            return reply | {"error": {"code": BAD_PARAMS, "message": f"Unknown tool: {name}"}}
        return reply | {"result": call(engine, name, params.get("arguments") or {})}
    return reply | {"error": {"code": NO_METHOD, "message": "Method not found"}}


def serve(engine: Engine, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            if not isinstance(message, dict) or not isinstance(message.get("method"), str):
                raise ValueError("missing method")
            response = handle(engine, message)
        except ValueError as e:
            response = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": f"Parse error: {e}"}}
        if response is not None:
            out.write(json.dumps(response) + "\n")
            out.flush()
