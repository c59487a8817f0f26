"""Tools over stored and rendered pages, with sessions, as a caller of tools sees them: names, argument
schemas, and calls that give rows. Fetching is done by what the caller plugs in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import browser, recipes
from pagewright.sources.rendered import Engine, Pool

#: Kinds of sessions (fixed values).
SESSIONS = ("dynamic", "stealthy")
_TEXT, _TEXTS, _YES = {"type": "string"}, {"type": "array", "items": {"type": "string"}}, {"type": "boolean"}
_READ = {"extraction_type": {"type": "string", "enum": ["text", "html", "markdown"]}, "css_selector": _TEXT, "main_content_only": _YES}
_SESSION = {"session_id": _TEXT}


def _spec(required: list[str], **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": required}


#: Names and argument schemas of the tools.
TOOLS: dict[str, dict] = {
    "get": _spec(["url"], url=_TEXT, **_READ),
    "bulk_get": _spec(["urls"], urls=_TEXTS, **_READ),
    "fetch": _spec(["url"], url=_TEXT, **_READ, **_SESSION),
    "bulk_fetch": _spec(["urls"], urls=_TEXTS, **_READ, **_SESSION),
    "stealthy_fetch": _spec(["url"], url=_TEXT, **_READ, **_SESSION),
    "bulk_stealthy_fetch": _spec(["urls"], urls=_TEXTS, **_READ, **_SESSION),
    "screenshot": _spec(["url", "session_id"], url=_TEXT, quality={"type": "integer"}, full_page=_YES, selector=_TEXT, **_SESSION),
    "open_session": _spec([], session_type={"type": "string", "enum": list(SESSIONS)}, max_pages={"type": "integer"}, **_SESSION),
    "close_session": _spec(["session_id"], **_SESSION),
    "list_sessions": _spec([]),
}


def checked(tool: str, arguments: dict[str, Any]) -> None:
    """An unknown tool, an unknown, missing or wrongly typed argument, and an empty list are errors."""
    if tool not in TOOLS:
        raise ValueError(f"unknown tool {tool}")
    spec, kinds = TOOLS[tool], {"string": str, "array": list, "boolean": bool, "integer": int}
    if unknown := sorted(set(arguments) - set(spec["properties"])):
        raise ValueError(f"{tool}: unknown arguments {', '.join(unknown)}")
    for name in spec["required"]:
        value = arguments.get(name)
        if not (value.strip() if isinstance(value, str) else value):
            raise ValueError(f"{tool}: {name} is required")
    for name, value in arguments.items():
        own = spec["properties"][name]
        if not isinstance(value, kinds[own["type"]]) or "enum" in own and value not in own["enum"]:
            raise ValueError(f"{tool}: {name} isn't valid")


@dataclass
class OpenSession:
    """A session with its pages."""

    session_id: str
    kind: str
    pool: Pool
    options: browser.Options
    created_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    alive: bool = True


class Sessions:
    """Open sessions by id. An id is given once; a closed session's may be used again."""

    def __init__(self, engine: Callable[[], Engine]) -> None:
        self.engine = engine
        self.open_: dict[str, OpenSession] = {}
        self.made = 0

    def open(self, session_id: str = "", kind: str = "dynamic", max_pages: int = 5, options: browser.Options | None = None) -> OpenSession:
        """A new session; stealthy ones have stealth switched on. Wrong options and a used id are errors."""
        kind = kind or "dynamic"
        if kind not in SESSIONS:
            raise ValueError(f"unsupported session type {kind}")
        options = options or browser.Options()
        if kind == "stealthy":
            options = replace(options, stealth=options.stealth.merged(browser.Stealth(enabled=True)))
        if wrong := browser.problems(options):
            raise ValueError("; ".join(wrong))
        name = session_id.strip()
        while not name or not session_id.strip() and name in self.open_:
            self.made += 1
            name = f"session-{self.made}"
        if name in self.open_:
            raise ValueError(f"session {name} exists")
        self.open_[name] = OpenSession(name, kind, Pool(self.engine(), max_pages if max_pages > 0 else 5), options)
        return self.open_[name]

    def get(self, session_id: str, kind: str) -> OpenSession:
        """An open session of a kind; an unknown, ended or otherwise typed one is an error."""
        own = self.open_.get(session_id.strip())
        if own is None:
            raise ValueError(f"unknown session {session_id}")
        if own.kind != kind:
            raise ValueError(f"session {session_id} is {own.kind}")
        if not own.alive:
            raise ValueError(f"session {session_id} has ended")
        return own

    def close(self, session_id: str) -> None:
        own = self.open_.pop(session_id.strip(), None)
        if own is None:
            raise ValueError(f"unknown session {session_id}")
        own.alive = False
        own.pool.close()

    def listed(self) -> list[dict[str, Any]]:
        """Open sessions by id, with the counts of their pages."""
        return [{"session_id": s.session_id, "session_type": s.kind, "created_at": s.created_at, "is_alive": s.alive, **s.pool.counts} for _, s in sorted(self.open_.items())]


def bulk_get(pages: DataFrame, arguments: dict[str, Any]) -> DataFrame:
    """(page_id, status, url, content) of the stored pages (page_id, url, html, status) that a call of ``get``
    or ``bulk_get`` asks for, in the form of its arguments."""
    one = "url" in arguments
    checked("get" if one else "bulk_get", arguments)
    urls = [arguments["url"]] if one else arguments["urls"]
    if any(not u.strip() for u in urls):
        raise ValueError("url is required")
    asked = pages.where(F.trim("url").isin([u.strip() for u in urls]))
    return recipes.projected(asked, arguments.get("css_selector", ""), arguments.get("main_content_only", False), arguments.get("extraction_type", "text"))
