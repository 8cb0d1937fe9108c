"""Command line and shell: ``python -m cuewell --db FOLDER VERB [SCOPE] [WORDS...] [--json] [--k N] ...``."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys

from .session import VERBS, Session

NUMBERS = ["k", "hops", "before", "after", "start", "limit"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cuewell")
    p.add_argument("--db", help="folder of the stored memory")
    p.add_argument("--json", action="store_true")
    p.add_argument("--across", action="store_true", default=None)
    p.add_argument("--replace", action="store_true", default=None)
    p.add_argument("--key")
    p.add_argument("--bump", type=float)
    for n in NUMBERS:
        p.add_argument(f"--{n}", type=int)
    p.add_argument("--only")
    p.add_argument("--skip")
    p.add_argument("verb", choices=[*VERBS, "shell", "serve", "tools", "lines", "capture", "run", "follow"])
    p.add_argument("scope", nargs="?", default="")
    p.add_argument("words", nargs="*")
    return p


def shown(answer) -> str:
    """An answer as text: a line for each row, cells parted by tabs."""
    if answer is None:
        return "(no match)"
    if isinstance(answer, dict):
        return "\n".join(f"{k}\t{v}" for k, v in answer.items())
    if isinstance(answer, list):
        return "\n".join("\t".join(str(v) for v in x.values()) if isinstance(x, dict) else str(x) for x in answer)
    return str(answer)


def shell(session: Session, lines, out) -> None:
    """Reads 'verb scope words' lines until one says quit; ``scope NAME`` sets the scope of lines without one."""
    scope = "default"
    for line in lines:
        verb, _, rest = line.strip().partition(" ")
        if verb in ("quit", "exit"):
            return
        if verb == "scope":
            scope = rest.strip() or scope
        elif verb in VERBS:
            try:
                print(shown(session.run(verb, scope, rest.strip())), file=out)
            except (ValueError, TypeError) as e:
                print(f"{verb}: {e}", file=out)
        elif verb:
            print(f"no such verb: {verb}", file=out)


def session_of(args) -> Session:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("cuewell").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return Session(spark, args.db)


def main(argv: list[str] | None = None, session: Session | None = None, out=sys.stdout, lines=sys.stdin) -> int:
    """0: an answer; 3: nothing found."""
    args = parser().parse_args(argv)
    session = session or session_of(args)
    if args.verb == "shell":
        shell(session, lines, out)
        return 0
    if args.verb in ("tools", "lines"):
        from . import wire

        (wire.serve_tools if args.verb == "tools" else wire.serve_lines)(session, lines, out)
        return 0
    if args.verb in ("capture", "run"):
        # Lines of the standard input, or of what a command prints.
        if args.verb == "run":
            with subprocess.Popen(args.words, stdout=subprocess.PIPE, text=True) as child:
                answer = session.capture(args.scope, child.stdout, args.only, args.skip)
        else:
            answer = session.capture(args.scope, lines, args.only, args.skip)
        print(json.dumps(answer) if args.json else shown(answer), file=out)
        return 0
    if args.verb == "follow":
        # Text files that arrive in a folder, until the command is stopped; facts go to a table beside.
        from ..streaming import capture

        folder = args.words[0]
        arriving = capture.keep(capture.line_stream(session.spark, folder), args.only, args.skip)
        capture.capture(arriving, args.scope, f"{args.db}/followed", f"{args.db}/follow-state", poll="300 milliseconds").awaitTermination()
        return 0
    if args.verb == "serve":
        from .http import serve

        serve(session, args.scope or "127.0.0.1:8080", args.key)
        return 0
    options = {n: getattr(args, n) for n in (*NUMBERS, "across", "replace", "key", "bump") if getattr(args, n) is not None}
    answer = session.run(args.verb, args.scope, " ".join(args.words), **options)
    print(json.dumps(answer, ensure_ascii=False) if args.json else shown(answer), file=out)
    return 3 if answer is None or answer == [] else 0
