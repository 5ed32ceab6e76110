"""Requests as JSON lines over a Unix socket that only its owner can open."""

from __future__ import annotations

import contextlib
import json
import os
import socket
import stat
import threading
from collections.abc import Callable

from framesieve.errors import ControlError

#: Bytes of a request line.
LIMIT = 1 << 20
TIMEOUT = 60.0


def _line(connection: socket.socket) -> str:
    data = b""
    while not data.endswith(b"\n") and len(data) <= LIMIT:
        part = connection.recv(65536)
        if not part:
            break
        data += part
    if len(data) > LIMIT:
        raise ControlError("a request is too long")
    return data.decode()


class Server:
    """Answers each connection's line; one thread a connection, so that status answers while a persist runs."""

    def __init__(self, path: str, respond: Callable[[str], str]):
        with contextlib.suppress(FileNotFoundError):
            if not stat.S_ISSOCK(os.lstat(path).st_mode):
                raise ControlError(f"{path} is not a socket")
            os.unlink(path)
        self.path, self.respond, self.closed = path, respond, False
        self.socket = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
        before = os.umask(0o177)
        try:
            self.socket.bind(path)
        finally:
            os.umask(before)
        self.socket.listen(16)
        self.socket.settimeout(0.1)
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def _run(self) -> None:
        while not self.closed:
            try:
                connection, _ = self.socket.accept()
            except TimeoutError:
                continue
            except OSError:
                return
            threading.Thread(target=self._answer, args=(connection,), daemon=True).start()

    def _answer(self, connection: socket.socket) -> None:
        with connection, contextlib.suppress(OSError):
            connection.settimeout(TIMEOUT)
            try:
                answer = self.respond(_line(connection))
            except (ControlError, UnicodeDecodeError) as e:
                answer = json.dumps({"ok": False, "message": str(e)})
            connection.sendall(answer.encode() + b"\n")

    def close(self) -> None:
        self.closed = True
        self.thread.join()
        self.socket.close()
        with contextlib.suppress(FileNotFoundError):
            os.unlink(self.path)


def request(path: str, command: str, timeout: float | None = None, **more) -> dict:
    """One request to a server, and its answer."""
    with socket.socket(socket.AF_UNIX, socket.SOCK_STREAM) as s:
        s.settimeout(timeout)
        try:
            s.connect(path)
        except OSError as e:
            raise ControlError(f"nothing answers at {path}: {e}") from e
        s.sendall(json.dumps({"command": command} | more).encode() + b"\n")
        return json.loads(_line(s))
