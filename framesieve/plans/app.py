"""The application around a session: its states, and answers to the eight requests.

States: unconfigured (no usable profile), idle (a profile, no capture), capturing,
faulted (a capture could not be started), stopping, and poisoned (an operation
broke an invariant: only status and stop are answered).
"""

from __future__ import annotations

import json
import tempfile
import threading
from collections.abc import Callable
from concurrent.futures import TimeoutError as Late

from framesieve.errors import CaptureError, ConfigError, ControlError, EngineError, ValidationError
from framesieve.plans.session import Session
from framesieve.sources import profiles
from framesieve.sources.profiles import Resolved

COMMANDS = ("recall", "clear", "status", "stop", "start-capture", "stop-capture", "reload", "dump")
TIMEOUT = 60.0


class App:
    """``open_session`` makes a session of a resolved profile; the default stores its blocks under ``folder``."""

    def __init__(self, spark, config_path: str, folder: str | None = None, open_session: Callable[[Resolved], Session] | None = None, timeout: float = TIMEOUT):
        self.spark, self.config_path, self.folder, self.timeout = spark, config_path, folder, timeout
        self.open_session = open_session or self._session
        self.lock = threading.RLock()
        self.state, self.last_error = "unconfigured", None
        self.document: dict = {}
        self.profile: Resolved | None = None
        self.session: Session | None = None
        self.reload()

    def _session(self, r: Resolved) -> Session:
        if not r.ports:
            raise CaptureError(f"profile {r.name}: channels unknown")
        master = self.spark.sparkContext.master
        if not self.folder and not (master == "local" or master.startswith("local[")):
            raise ConfigError("blocks need a folder that driver and executors share (--folder)")
        folder = self.folder or tempfile.mkdtemp(prefix="framesieve-blocks-")
        return Session.for_seconds(self.spark, folder, r.output_dir, len(r.ports), r.sample_rate, r.seconds, names=[n for _, n in r.ports])

    # --- states -----------------------------------------------------------------------------------

    def _close(self) -> None:
        old, self.session = self.session, None
        if old:
            old.stop()

    def _fault(self, error: BaseException) -> None:
        self.state, self.last_error = "faulted", str(error)
        self._close()

    def _capture(self, resolved: Resolved) -> None:
        """Stop what runs, then start the profile; a failure leaves the application faulted."""
        self._close()
        self.profile = resolved
        try:
            self.session = self.open_session(resolved)
        except Exception as e:
            self._fault(e)
            raise
        self.state, self.last_error = "capturing", None

    def start_capture(self, profile: str | None = None, activate: bool = False) -> str:
        with self.lock:
            document = profiles.load_for_change(self.config_path)
            name = profiles.active(document, profile)
            if not name:
                raise ValidationError("no active profile configured")
            resolved = profiles.resolve(document, name)
            if activate:
                document.setdefault("daemon", {})["activeProfile"] = name
                profiles.save(self.config_path, document)
            self.document = document
            self._capture(resolved)
            return f"capturing {name}"

    def stop_capture(self) -> str:
        with self.lock:
            self._close()
            self.state, self.last_error = "idle" if self.profile else "unconfigured", None
            return "capture stopped"

    def reload(self) -> str:
        """Read the file again: auto mode restarts the capture, manual mode ends it; without a usable profile nothing runs."""
        with self.lock:
            kind, self.document, error = profiles.load_app(self.config_path)
            name = profiles.active(self.document)
            if kind != "loaded" or not name:
                self._close()
                self.state, self.profile, self.last_error = "unconfigured", None, error or "no active profile configured"
                return self.state
            resolved = profiles.resolve(self.document, name)
            if self.document.get("daemon", {}).get("startMode", "manual") == "auto":
                try:
                    self._capture(resolved)
                except Exception:  # noqa: BLE001 - the state and last_error tell it
                    return self.state
            else:
                self._close()
                self.state, self.profile, self.last_error = "idle", resolved, None
            return self.state

    def stop(self) -> str:
        with self.lock:
            self.state = "stopping"
            self._close()
            return "stopping"

    def status(self) -> dict:
        with self.lock:
            own = self.session.status() if self.session else {}
            return own | {"state": self.state, "last_error": self.last_error, "active_profile": self.profile.name if self.profile else None, "target": self.profile.target if self.profile else None, "profiles": sorted(self.document.get("profiles", {}))}

    # --- requests ---------------------------------------------------------------------------------

    def _operate(self, command: str, request: dict) -> dict:
        with self.lock:
            session = self.session
            if session is None:
                raise CaptureError("capture is not running")
        if request.get("runtime") not in (None, session.runtime):
            raise ControlError("the coordinator is bound to another capture runtime")
        if command == "clear":
            return session.clear(request.get("id"), timeout=self.timeout)
        label = request.get("label") or command
        return (session.dump if command == "dump" else session.recall)(label, timeout=self.timeout)

    def handle(self, request: dict) -> dict:
        """{"command": one of ``COMMANDS``, ...} to {"ok", "message", "status", "persistence_outcome"}."""
        command, outcome = request.get("command"), None
        try:
            if command not in COMMANDS:
                raise ControlError(f"unknown command {command}")
            if self.state == "poisoned" and command not in ("status", "stop"):
                raise ControlError("runtime state lock poisoned")
            if self.state == "stopping" and command not in ("status", "stop"):
                raise ControlError("shutting down")
            if command == "start-capture":
                message = self.start_capture(request.get("profile"), bool(request.get("activate", False)))
            elif command in ("recall", "dump", "clear"):
                outcome = self._operate(command, request)
                message = outcome["kind"]
            else:
                message = {"status": lambda: "status", "stop": self.stop, "stop-capture": self.stop_capture, "reload": self.reload}[command]()
        except (EngineError, OSError, ValueError, Late) as e:
            return {"ok": False, "message": str(e) or "control error: timed out", "status": self.status()}
        except Exception as e:  # noqa: BLE001 - errors are answers here
            if type(e).__module__.split(".")[0] not in ("pyspark", "py4j"):
                self.state, self.last_error = "poisoned", repr(e)
            return {"ok": False, "message": str(e), "status": self.status()}
        told = outcome if outcome and outcome["kind"] != "cleared" else None
        return {"ok": True, "message": message, "status": self.status()} | ({"persistence_outcome": told} if told else {})

    def respond(self, line: str) -> str:
        """One JSON request line to one response line."""
        try:
            request = json.loads(line)
            if not isinstance(request, dict):
                raise ValueError("a request is an object")
        except ValueError as e:
            return json.dumps({"ok": False, "message": f"control error: {e}"})
        return json.dumps(self.handle(request))
