"""A shell for query text, and running of script files.

python -m graphloom.cli shell [--sf-dir DIR]            statements end with a semicolon; lines with a colon are commands
python -m graphloom.cli execute FILE [--sf-dir DIR]     one statement after another; a leading :time times one
"""

from __future__ import annotations

import argparse
import csv
import io
import json
import os
import sys
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .session import Session

MODES = ("sharp", "modern", "psql", "markdown", "csv", "json")
#: Corners and lines of the table modes: left, cross, right of the rules, the line, and the column mark.
_LINES = {"sharp": ("┌┬┐", "├┼┤", "└┴┘", "─", "│"), "modern": ("╭┬╮", "├┼┤", "╰┴╯", "─", "│"), "psql": (None, " + ", None, "-", "|"), "markdown": (None, "|||", None, "-", "|")}
HELP = ":help  :quit  :history  :mode MODE  :timing on|off  :metrics  :cd DIR"


def shown(df: DataFrame, mode: str, rows: int = 1000) -> str:
    """A result as text: csv and json whole, row by row; tables the first `rows`, and a line that says so where there are more."""
    names = df.columns
    if mode == "json":
        return "\n".join(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False) for r in df.toLocalIterator())
    data = list(df.toLocalIterator()) if mode == "csv" else df.limit(rows + 1).collect()
    more, data = mode != "csv" and len(data) > rows, data if mode == "csv" else data[:rows]
    cells = [["" if v is None and mode == "csv" else "null" if v is None else str(v) for v in r] for r in data]
    if mode == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([names, *cells])
        return out.getvalue().rstrip("\n")
    top, middle, bottom, line, mark = _LINES[mode]
    width = [max(len(n), *(len(r[i]) for r in cells)) if cells else len(n) for i, n in enumerate(names)]
    edge = "" if mode == "psql" else mark
    row = lambda r: (edge + mark.join(f" {v.ljust(w)} " for v, w in zip(r, width, strict=True)) + edge).rstrip() if edge == "" else edge + mark.join(f" {v.ljust(w)} " for v, w in zip(r, width, strict=True)) + edge
    rule = lambda c: c[0] + c[1].join(line * (w + 2) for w in width) + c[2] if mode != "psql" else "+".join(line * (w + 2) for w in width)
    lines = [row(names), rule(middle), *map(row, cells)]
    return "\n".join([*([rule(top)] if top else []), *lines, *([rule(bottom)] if bottom else []), *([f"(the first {rows} rows)"] if more else [])])


def statements(text: str) -> Iterator[str]:
    """The statements of a script: semicolons within quotes and comments don't end one."""
    now, quote, i = "", "", 0
    while i < len(text):
        c = text[i]
        if quote:
            now += c
            if c == "\\":
                now += text[i + 1 : i + 2]
                i += 1
            elif c == quote:
                quote = ""
        elif text.startswith(("--", "//"), i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
            continue
        elif c == ";":
            if now.strip():
                yield now.strip()
            now = ""
        else:
            quote = c if c in "'\"`" else ""
            now += c
        i += 1
    if now.strip():
        yield now.strip()


class Shell:
    def __init__(self, session: Session, write=print) -> None:  # noqa: ANN001
        self.session, self.write, self.mode, self.timing, self.metrics, self.history = session, write, "sharp", False, False, []

    def command(self, line: str) -> bool:
        """Runs a line with a colon; False ends the shell."""
        name, _, rest = line[1:].strip().partition(" ")
        if name in ("quit", "exit"):
            return False
        if name == "help":
            self.write(HELP)
        elif name == "history":
            self.write("\n".join(self.history))
        elif name == "mode":
            if rest not in MODES:
                self.write(f"modes: {', '.join(MODES)}")
            else:
                self.mode = rest
        elif name == "timing":
            self.timing = rest != "off"
        elif name == "metrics":
            self.metrics = not self.metrics
        elif name == "cd":
            os.chdir(rest)
        elif name == "time":
            self.run(rest, timed=True)
        else:
            self.write(f"unknown command :{name}")
        return True

    def run(self, text: str, timed: bool = False) -> None:
        self.history.append(text)
        began = time.perf_counter()
        try:
            df = self.session.gql(text)
            planned = time.perf_counter()
            if df is not None and df.columns:
                self.write(shown(df, self.mode))
            else:
                self.write("OK")
            if self.timing or timed:
                self.write(f"{(time.perf_counter() - began) * 1000:.0f} ms")
            if self.metrics:
                self.write(f"parse and plan {(planned - began) * 1000:.0f} ms, run {(time.perf_counter() - planned) * 1000:.0f} ms")
        except Exception as e:  # a shell goes on after a failed statement
            self.write(f"Error: {str(e).splitlines()[0]}")

    def script(self, text: str) -> None:
        for s in statements(text):
            if s.startswith(":"):
                self.command(s)
            else:
                self.run(s)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("action", choices=["shell", "execute"])
    p.add_argument("file", nargs="?")
    p.add_argument("--sf-dir", help="a folder of tables to open as the current graph")
    p.add_argument("--threads", default="*")
    a = p.parse_args(argv)
    spark = SparkSession.builder.master(f"local[{a.threads}]").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    session = Session(spark)
    if a.sf_dir:
        from .sources.tables import tables_graph

        session.use_graph(tables_graph(spark, a.sf_dir))
    shell = Shell(session)
    if a.action == "execute":
        from .sources.files import read_text

        shell.script(read_text(spark, a.file))
        return
    text = ""
    for line in sys.stdin:
        if not text and line.startswith(":"):
            if not shell.command(line):
                return
            continue
        text += line
        if text.rstrip().endswith(";"):
            shell.run(text)
            text = ""


if __name__ == "__main__":
    main()
