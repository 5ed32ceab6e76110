"""The application's TOML file: profiles, how they are changed, and what a capture takes from one."""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass
from pathlib import Path

from framesieve.errors import ConfigError, ValidationError
from framesieve.sources.scans import load_toml

BACKENDS = ("jack", "pipewire")
# Fixed value: the sample rate of a profile that names none.
DEFAULT_RATE = 44_100
FIELDS = ("backend", "clientName", "buffer.seconds", "export.outputDir", "export.mode", "export.format")
_BARE = re.compile(r"[A-Za-z0-9_-]+")


@dataclass(frozen=True)
class Resolved:
    """What a capture needs of a profile."""

    name: str
    backend: str
    client_name: str
    ports: tuple[tuple[str, str], ...]  # (source, name)
    seconds: int
    output_dir: str
    sample_rate: int = DEFAULT_RATE
    target: str | None = None


def load_for_change(path: str | Path) -> dict:
    """The document, empty if there is no file; a broken file is an error."""
    document, error = load_toml(str(path))
    if error:
        raise ConfigError(error)
    return document


def _dump(table: dict, path: tuple[str, ...] = ()) -> list[str]:
    key = lambda k: k if _BARE.fullmatch(k) else json.dumps(k, ensure_ascii=False)

    def value(v) -> str:
        if isinstance(v, dict):
            return "{ " + ", ".join(f"{key(k)} = {value(x)}" for k, x in v.items()) + " }"
        if isinstance(v, list):
            return "[" + ", ".join(map(value, v)) + "]"
        # A TOML basic string is a JSON string but for DEL; numbers and booleans are written alike.
        return json.dumps(v, ensure_ascii=False).replace("\x7f", "\\u007f") if isinstance(v, (str, bool, int, float)) else json.dumps(str(v))

    lines = [f"{key(k)} = {value(v)}" for k, v in table.items() if not isinstance(v, dict) and v is not None]
    if path and (lines or not table):
        lines = [f"[{'.'.join(map(key, path))}]", *lines, ""]
    elif lines:
        lines.append("")
    for k, v in table.items():
        if isinstance(v, dict):
            lines += _dump(v, (*path, k))
    return lines


def save(path: str | Path, document: dict) -> None:
    """Whole, by rename in the same folder."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    new.write_text("\n".join(_dump(document)).rstrip("\n") + "\n")
    os.replace(new, path)


def _filled(what: str, value) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValidationError(f"{what} is required")
    return value


def _profile(document: dict, name: str) -> dict:
    try:
        return document["profiles"][name]
    except KeyError:
        raise ConfigError(f"profile {name} does not exist") from None


def create(document: dict, name: str, backend: str) -> None:
    _filled("profile name", name)
    if backend not in BACKENDS:
        raise ValidationError(f"profile {name}: backend must be jack or pipewire, got {backend}")
    own = document.setdefault("profiles", {})
    if name in own:
        raise ConfigError(f"profile {name} already exists")
    own[name] = {"backend": backend}


def set_field(document: dict, name: str, field: str, value: str) -> None:
    if field not in FIELDS:
        raise ValidationError(f"unknown profile field {field}")
    profile = _profile(document, name)
    if field == "backend" and value not in BACKENDS:
        raise ValidationError(f"profile {name}: backend must be jack or pipewire, got {value}")
    if field == "buffer.seconds":
        if not re.fullmatch(r"\+?[0-9]+", value) or int(value) >= 1 << 32:
            raise ValidationError(f"profile {name}: buffer.seconds must be an integer")
        profile.setdefault("buffer", {})["seconds"] = int(value)
        return
    *above, last = field.split(".")
    for k in above:
        profile = profile.setdefault(k, {})
    profile[last] = value if field in ("backend", "export.outputDir") else _filled(field, value)


def add_port(document: dict, name: str, source: str, label: str) -> None:
    capture = _profile(document, name).setdefault("capture", {})
    if capture.get("sources"):
        raise ValidationError(f"profile {name}: capture.ports can't be added while capture.sources is set")
    capture.setdefault("ports", []).append({"source": _filled("source", source), "name": _filled("name", label)})


def active(document: dict, requested: str | None = None) -> str | None:
    """The requested profile's name, else the configured one's; blank is none."""
    for name in (requested, document.get("daemon", {}).get("activeProfile")):
        if name and name.strip():
            return name.strip()
    return None


def resolve(document: dict, name: str) -> Resolved:
    """A profile whose rules hold: ports before the buffer, then folder and export."""
    p = _profile(document, name)
    backend = _filled("backend", p.get("backend"))
    if backend not in BACKENDS:
        raise ValidationError(f"profile {name}: backend must be jack or pipewire, got {backend}")
    capture, wire = p.get("capture", {}), p.get("pipewire", {})
    if backend == "jack":
        client = _filled("clientName", p.get("clientName"))
        ports, sources = capture.get("ports", []), capture.get("sources", [])
        if ports and sources:
            raise ValidationError(f"profile {name}: capture.ports and capture.sources are exclusive")
        if not ports and not sources:
            raise ValidationError(f"profile {name}: capture.ports or capture.sources is required")
        found = [(_filled(f"capture.ports[{i}].source", x.get("source")), _filled(f"capture.ports[{i}].name", x.get("name"))) for i, x in enumerate(ports)]
        found += [(_filled(f"capture.sources[{i}]", x), f"ch{i + 1:02d}") for i, x in enumerate(sources)]
    else:
        client = "framesieve"
        found = [(f"pipewire-input-ch{i + 1}", x) for i, x in enumerate(wire.get("channelMap", []))]
    seconds, export = p.get("buffer", {}).get("seconds"), p.get("export", {})
    if seconds is None:
        raise ValidationError(f"profile {name}: buffer.seconds is required")
    if seconds <= 0:
        raise ValidationError(f"profile {name}: buffer.seconds must be > 0")
    folder = _filled(f"profile {name}: export.outputDir", export.get("outputDir"))
    if not folder.startswith("/"):
        raise ValidationError(f"profile {name}: export.outputDir must be absolute")
    for field, wanted in (("mode", "per-channel"), ("format", "wav")):
        if _filled(f"export.{field}", export.get(field)) != wanted:
            raise ValidationError(f"profile {name}: export.{field} must be {wanted}, got {export[field]}")
    return Resolved(name, backend, client, tuple(found), seconds, folder, wire.get("sampleRate") or DEFAULT_RATE, wire.get("target"))


def load_app(path: str | Path) -> tuple[str, dict, str | None]:
    """(missing, loaded or invalid; document; error) of the application's file."""
    document, error = load_toml(str(path))
    if error:
        return "invalid", {}, error
    if not Path(path).exists():
        return "missing", {}, f"config file not found: {path}"
    mode = document.get("daemon", {}).get("startMode", "manual")
    if mode not in ("manual", "auto"):
        return "invalid", {}, f"startMode must be manual or auto, not {mode}"
    return "loaded", document, None
