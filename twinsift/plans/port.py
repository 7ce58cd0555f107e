"""Commands as JSON lines over an engine."""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Callable

from pyspark.sql import functions as F

from ..operators import report
from ..settings import PROFILES
from ..sources import session
from .engine import DedupEngine


class CommandPort:
    """``handle(line)`` answers one JSON command ``{"cmd": ..., "args": {...}}`` with a dictionary; nothing raises."""

    def __init__(self, engine: DedupEngine, load: Callable | None = None):
        self.engine, self.load = engine, load
        self.status, self.listeners = "idle", []

    def register(self, listener: Callable[[str, dict], None]) -> None:
        self.listeners.append(listener)

    def _tell(self, signal: str, **data) -> None:
        for f in self.listeners:
            f(signal, data)

    def handle(self, line: str) -> dict:
        try:
            c = json.loads(line)
            name, args = c["cmd"], c.get("args") or {}
        except (ValueError, KeyError, TypeError, AttributeError):
            return {"ok": False, "error": "not a command"}
        return self.process(name, args)

    def process(self, name: str, args: dict | None = None) -> dict:
        f = getattr(self, f"_{name}", None) if name in COMMANDS else None
        if f is None:
            return {"ok": False, "error": f"unknown command: {name}"}
        try:
            return {"ok": True} | (f(**(args or {})) or {})
        except Exception as e:  # noqa: BLE001 - the answer is the error
            return {"ok": False, "error": str(e)[:300]}

    def _ping(self):
        return {"pong": True}

    def _get_status(self):
        return {"status": self.status}

    def _get_settings(self):
        return {"settings": {k: getattr(self.engine.settings, k) for k in self.engine.settings.__dataclass_fields__}}

    def _set_settings(self, profile: str | None = None, **changes):
        base = PROFILES[profile] if profile else self.engine.settings
        self.engine.settings = base.with_changes(**changes)
        self.engine.members = self.engine.selection = None
        return self._get_settings()

    def _scan(self, **args):
        if self.load:
            self.engine.catalog(self.load(**args))
        self.status = "scanning"
        n = self.engine.groups().select("group_id").distinct().count()
        self.status = "done"
        self._tell("scan_done", groups=n)
        return {"groups": n}

    def _get_groups(self, limit: int | None = None, after: str = ""):
        """All groups by group_id, or a page: at most ``limit`` of those that come after the group ``after``."""
        g = self.engine.totals().where(F.col("group_id") > after).orderBy("group_id")
        g = g if limit is None else g.limit(limit)
        return {"groups": [r.asDict() for r in g.collect()]}

    def _get_group(self, group_id: str):
        rows = self.engine.groups().where(F.col("group_id") == group_id).join(self.engine.select(), ["group_id", "path"]).select("path", "size", "suggestion").orderBy("path").collect()
        if not rows:
            raise ValueError(f"no such group: {group_id}")
        return {"files": [r.asDict() for r in rows]}

    def _select_files(self, group_id: str, paths: list[str], action: str):
        if action.upper() not in ("KEEP", "DELETE", "REVIEW", "TOGGLE"):
            raise ValueError(f"no such action: {action}")
        self.engine.mark(self.engine.spark.createDataFrame([(group_id, p, action) for p in paths], "group_id string, path string, action string"))

    def _delete_selected(self):
        """A plan, never a deletion."""
        return {"plan": [r.asDict() for r in report.plan_summary(self.engine.plan()).collect()]}

    def _get_stats(self):
        return {"stats": report.scan_stats(self.engine.files, self.engine.groups()).first().asDict()}

    def _get_capabilities(self):
        have = lambda m: importlib.util.find_spec(m) is not None
        return {"capabilities": {m: have(m) for m in ("numpy", "pandas", "pyarrow", "PIL", "imagehash", "mutagen")}}

    def _export(self, folder: str, format: str = "csv"):
        rows = report.export_rows(self.engine.groups().withColumn("idx", F.lit(0)), self.engine.select())
        {"csv": lambda: session.write_csv(rows, folder), "json": lambda: session.write_json(report.export_nested(rows), folder), "html": lambda: session.write_lines(session.html_rows(rows), folder), "txt": lambda: session.write_lines(session.text_rows(rows), folder)}[format]()

    def _save_session(self, folder: str):
        session.save_session(self.engine.groups(), self.engine.select(), folder, profile=self.engine.settings.profile)

    def _load_session(self, folder: str):
        found = session.load_session(self.engine.spark, folder)
        if found is None:
            raise ValueError("no session there")
        members, about = found
        self.engine.members, self.engine.selection = members.drop("suggestion"), members.select("group_id", "path", "suggestion")
        return {"about": about}

    def _cancel(self):
        self.engine.spark.interruptAll() if hasattr(self.engine.spark, "interruptAll") else self.engine.spark.sparkContext.cancelAllJobs()
        self.status = "cancelled"

    _stop = _cancel

    def _pause(self):
        self.status = "paused"

    def _resume(self):
        self.status = "idle"


COMMANDS = ("ping", "get_status", "get_groups", "get_group", "select_files", "get_settings", "set_settings", "scan", "cancel", "get_capabilities", "get_stats", "stop", "pause", "resume", "delete_selected", "export", "save_session", "load_session")
