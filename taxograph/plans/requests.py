"""One request: its parameters as text, and the lines of its answer."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import astuple, dataclass
from enum import Enum

ROWS_PER_LINE = 50


class Action(Enum):
    AND = "and"
    NOT = "not"
    LIST = "list"
    FQV = "fqv"
    PATH = "path"


class Transport(Enum):
    XHR = "xhr"
    JS = "js"
    SOCKET = "socket"


class Status(Enum):
    WAITING = "waiting"
    PREPROCESS = "preprocess"
    COMPUTING = "computing"
    STREAMING = "streaming"
    DONE = "done"


class RequestError(ValueError):
    """A request that is not answered."""


def leading_int(text: str | None, default: int) -> int:
    """The number at the beginning of a text, 0 without one; the default if the parameter is absent."""
    if text is None:
        return default
    m = re.match(r"\s*([+-]?\d+)", text)
    return int(m.group(1)) if m else 0


@dataclass
class QueryRequest:
    req_id: int
    a: str
    c1: int
    c2: int
    d1: int = -1
    d2: int = -1
    o: int = 0
    s: int = 100
    transport: Transport = Transport.XHR
    status: Status = Status.WAITING
    sizes: tuple[int, int] = (0, 0)

    @classmethod
    def from_params(cls, params: Mapping[str, str], req_id: int = 0, socket: bool = False) -> QueryRequest:
        """A request from its parameters; ``c1`` is needed, the others have defaults."""
        if "c1" not in params:
            raise RequestError("no c1")
        word = params.get("a", Action.AND.value)
        if word not in {a.value for a in Action}:
            raise RequestError("unknown action")
        c1 = leading_int(params["c1"], 0)
        c2 = leading_int(params.get("c2"), c1)
        if word == Action.PATH.value and c1 == c2:
            raise RequestError("path to itself")
        transport = Transport.SOCKET if socket else Transport.JS if params.get("t") == "js" else Transport.XHR
        return cls(req_id, word, c1, c2, leading_int(params.get("d1"), -1), leading_int(params.get("d2"), -1), leading_int(params.get("o"), 0), leading_int(params.get("s"), 100), transport)

    def row(self) -> tuple:
        """As a row of the request table."""
        return astuple(self)[:8]


def result_lines(rows: Iterable[tuple[int, int, int]]) -> list[str]:
    """``RESULT id,depth,tag|...`` lines of at most 50 rows."""
    items = [",".join(map(str, r)) for r in rows]
    return ["RESULT " + "|".join(items[i : i + ROWS_PER_LINE]) for i in range(0, len(items), ROWS_PER_LINE)]


def body_lines(action: str, rows: list[tuple[int, int, int]], outof: int | None, found: bool, age: float) -> list[str]:
    """All lines between the opening and ``DONE``."""
    lines = result_lines(rows)
    if action == Action.PATH.value:
        if not found:
            lines.append("NOPATH")
    elif outof is not None:
        lines.append(f"OUTOF {outof}")
    return [*lines, f"DBAGE {age:.0f}"]


def rendered(transport: Transport, lines: list[str], callback: str = "callback") -> list[str]:
    """The messages of a transport: plain lines, one script that calls ``callback``, or socket messages."""
    if transport is Transport.XHR:
        return [f"{x}\n" for x in [*lines, "DONE"]]
    if transport is Transport.JS:
        return [f"{callback}( [" + "".join(f" '{x}'," for x in lines) + " 'DONE'] );"]
    return ["COMPUTE_START", *lines, "DONE"]
