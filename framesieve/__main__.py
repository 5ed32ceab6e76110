"""Command line: catalogue queries, recovery, the configuration file and its profiles, a daemon and requests to it."""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys
import threading

from framesieve.errors import EngineError
from framesieve.functions.messages import outcome_text
from framesieve.sources import profiles, publish, scans

DEFAULT = 'startMode = "manual"\n'


def socket_path() -> str:
    return os.path.join(os.environ.get("XDG_RUNTIME_DIR") or "/tmp", "framesieve.sock")


def _serve(a) -> int:
    from pyspark.sql import SparkSession

    from framesieve.plans.app import App
    from framesieve.plans.control import Server

    spark = SparkSession.builder.appName("framesieve").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    app, ended = App(spark, a.config or str(scans.config_path("framesieve")), a.folder), threading.Event()

    def respond(line: str) -> str:
        answer = app.respond(line)
        if app.state == "stopping":
            ended.set()
        return answer

    server = Server(a.socket, respond)
    for number in (signal.SIGINT, signal.SIGTERM):
        signal.signal(number, lambda *_: ended.set())
    ended.wait()
    app.stop()
    server.close()
    return 0


def _ask(a) -> int:
    from framesieve.plans.control import request

    more = {k: v for k, v in (("profile", getattr(a, "profile", None)), ("activate", getattr(a, "activate", None)), ("id", getattr(a, "id", None)), ("label", getattr(a, "label", None))) if v}
    answer = request(a.socket, a.command, **more)
    if getattr(a, "json", False):
        print(json.dumps(answer))
    elif outcome := answer.get("persistence_outcome"):
        print(outcome_text(outcome))
        print(*outcome.get("files", []), sep="\n", end="\n" if outcome.get("files") else "")
    elif a.command == "status" and answer["ok"]:
        print(*(f"{k}: {v}" for k, v in answer["status"].items()), sep="\n")
    else:
        print(answer["message"], file=sys.stdout if answer["ok"] else sys.stderr)
    return 0 if answer["ok"] else 1


def _config(a) -> int:
    path = scans.config_path("framesieve")
    if a.action == "path":
        print(path)
    elif a.action == "init":
        scans.write_default_config(str(path), DEFAULT, a.force)
    elif a.action == "show":
        document, error = scans.load_toml(str(path))
        print(json.dumps({"config": document, "error": error}))
    else:
        document = profiles.load_for_change(path)
        {"create-profile": profiles.create, "set": profiles.set_field, "add-port": profiles.add_port}[a.action](document, *a.values)
        profiles.save(path, document)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="framesieve")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("query", help="print a query's rows as JSON lines")
    run.add_argument("name")
    run.add_argument("folder")
    sub.add_parser("queries", help="list the catalogue")
    rec = sub.add_parser("recover", help="settle every transaction under a staging folder")
    rec.add_argument("staging")
    conf = sub.add_parser("config").add_subparsers(dest="action", required=True)
    init = conf.add_parser("init")
    init.add_argument("--force", action="store_true")
    conf.add_parser("path")
    conf.add_parser("show")
    for action, names in (("create-profile", ("PROFILE", "BACKEND")), ("set", ("PROFILE", "FIELD", "VALUE")), ("add-port", ("PROFILE", "SOURCE", "NAME"))):
        conf.add_parser(action).add_argument("values", nargs=len(names), metavar=names)
    daemon = sub.add_parser("daemon", help="answer requests until stopped")
    daemon.add_argument("--config")
    daemon.add_argument("--folder", help="where blocks are kept, shared by all executors")
    asked = [daemon]
    for command, text in (("recall", "write what is new as files of the output folder"), ("dump", "write what is new as a folder of its own"), ("clear", "forget what is new"), ("status", ""), ("stop", "end the daemon"), ("start-capture", ""), ("stop-capture", ""), ("reload", "read the configuration again")):
        one = sub.add_parser(command, help=text)
        one.add_argument("--json", action="store_true")
        if command in ("recall", "dump"):
            one.add_argument("--label")
        if command == "clear":
            one.add_argument("--id")
        if command == "start-capture":
            one.add_argument("profile", nargs="?")
            one.add_argument("--activate", action="store_true")
        asked.append(one)
    for one in asked:
        one.add_argument("--socket", default=socket_path())
    a = p.parse_args(argv)
    try:
        if a.command == "config":
            return _config(a)
        if a.command == "daemon":
            return _serve(a)
        if a.command not in ("recover", "query", "queries"):
            return _ask(a)
    except EngineError as e:
        print(e, file=sys.stderr)
        return 1
    if a.command == "recover":
        print(json.dumps(publish.recover(a.staging)))
    else:
        from framesieve.plans import catalog

        if a.command == "queries":
            print("\n".join(catalog.queries()))
            return 0
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("framesieve").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        for row in catalog.queries()[a.name](spark, a.folder).toJSON().toLocalIterator():
            print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
