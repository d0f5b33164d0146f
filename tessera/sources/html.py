"""HTML to text and to rows. Pages come as a table; parsing is Python's own parser over Arrow batches.

Broken markup is taken as the parser takes it. A page that ends before </body> gives an empty text, as does null.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import LEGAL

VOID = {"script", "style"}


class _Text(HTMLParser):
    """Text from the first tag of `start` (or the first attribute value of `marker`) up to </body>."""

    def __init__(self, start: str | None, marker: str | None, full: bool):
        super().__init__(convert_charrefs=True)
        self.start, self.marker, self.full = start, marker, full
        self.on, self.ended, self.skip, self.out, self.issues, self.scripts = False, False, 0, [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == self.start or self.marker and any(v == self.marker for _, v in attrs):
            self.on = True
        if tag in VOID:
            self.skip += 1
            self.scripts += tag == "script"

    def handle_endtag(self, tag):
        if tag in VOID and self.skip:
            self.skip -= 1
        if self.full and tag == "p" and not self.ended:
            self.out.append("#")
        if tag == "body":
            self.ended = True

    def handle_data(self, data):
        if not self.on or self.ended or self.skip:
            return
        text = data.strip()
        if not text:
            return
        if self.full:
            text = re.sub(r"\?(?= )", "?#", text)
            text = re.sub(r"→|←|'|\{\{|\}\}|[()]", "", text).replace("|", " ").replace("\n", " ").strip()
            if not text or _bracketed(text) or _code(text) or any(x in text for x in LEGAL) or text == "edit":
                return
            if text == "References":
                self.ended = self.finished = True
                return
            if text == "citation needed":
                self.issues += 1
                return
            self.issues += "vandalism" in text
        else:
            text = re.sub(r"[?!.]+", lambda m: m[0] + "#", text.replace("\n", " "))
        self.out.append(text + " ")

    def text(self) -> str:
        return "".join(self.out).strip() if self.ended else ""


def _bracketed(s: str) -> bool:
    return s.startswith("[") or s.endswith("]")


def _code(s: str) -> bool:
    return any(x in s for x in ("{", "=", "http", "/", "Categories :", "Hidden categories :")) or s.endswith(("}", "^", ":"))


def page_text(pages: DataFrame, start: str | None = "p", marker: str | None = None, full: bool = False, key: str = "page_id") -> DataFrame:
    """key, text, issues, scripts. full: with the filters of an encyclopedia's article; marker: the class its body has."""

    def run(batches):
        for batch in batches:
            found = []
            for html in batch.column(1).to_pylist():
                parser = _Text(start, marker, full)
                parser.feed(html or "")
                found.append((parser.text(), parser.issues, parser.scripts))
            yield pa.record_batch([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32())], [key, "text", "issues", "scripts"])

    return pages.select(F.col(key).cast("long").alias(key), "html").mapInArrow(run, f"{key} long, text string, issues int, scripts int")


class _History(HTMLParser):
    """Rows of an edit history: each starts at a link to the difference with the version before."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.row, self.arm, self.after = [], None, None, False

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        href, kind = values.get("href") or "", values.get("class") or ""
        if tag == "a" and "diff=prev" in href:
            self.row, self.arm, self.after = {"date": None, "user": None, "size": 0, "delta": 0, "message": "", "revert": 0, "diff_url": href}, None, False
        elif kind == "mw-changeslist-date":
            self.arm = "date"
        elif kind in ("mw-userlink", "new mw-userlink", "mw-userlink mw-anonuserlink"):
            self.arm = "user"

    def handle_data(self, data):
        text = data.strip()
        if not text or self.row is None:
            return
        row = self.row
        if self.arm:
            row[self.arm] = text.replace("#", "") if self.arm == "user" else text
            self.arm = None
        elif text.endswith("bytes"):
            row["size"] = int(re.sub(r"\D", "", text) or 0)
        elif not self.after and (m := re.fullmatch(r"\(?([+\-−]?[\d,]+)\)?", text)):
            row["delta"], self.after = int(m[1].replace(",", "").replace("−", "-")), True
        elif text.startswith(("undo", "cur", "<img")):
            self.rows.append(row | {"message": row["message"].strip() + ". "})
            self.row = None
        elif self.after and not text.startswith(("Tag", "bot", "New page:", "Category:")):
            row["revert"] += "Revert" in text
            row["message"] += text + " "


HISTORY = "page_id long, at int, date timestamp_ntz, user string, edit_size int, edit_delta int, message string, revert int, diff_url string"


def history_rows(pages: DataFrame) -> DataFrame:
    """A row for each edit of the history pages (page_id, html), in order of the page."""

    def run(batches):
        import datetime

        for batch in batches:
            out = []
            for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = _History()
                parser.feed(html or "")
                for at, r in enumerate(parser.rows):
                    try:
                        date = datetime.datetime.strptime(r["date"] or "", "%H:%M, %d %B %Y")
                    except ValueError:
                        date = None
                    out.append((key, at, date, r["user"], r["size"], r["delta"], r["message"], r["revert"], r["diff_url"]))
            kinds = [pa.int64(), pa.int32(), pa.timestamp("us"), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
            names = [x.split()[0] for x in HISTORY.split(", ")]
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, HISTORY)


class _Diff(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.attend, self.inside, self.ended, self.kept, self.added, self.removed = False, None, False, [], [], []

    def handle_starttag(self, tag, attrs):
        kind = dict(attrs).get("class") or ""
        if "diff-context diff-side-added" in kind:
            self.attend = True
        elif "diff-context diff-side-deleted" in kind:
            self.attend = False
        if tag in ("ins", "del"):
            self.inside = tag

    def handle_endtag(self, tag):
        self.ended |= tag == "body"

    def handle_data(self, data):
        text = data.strip()
        if not text:
            return
        if self.inside:
            (self.added if self.inside == "ins" else self.removed).append(text)
            self.inside = None
        elif self.attend and not _code(text):
            self.kept.append(text)


def diff_text(pages: DataFrame) -> DataFrame:
    """page_id, context, added, removed, of pages that show a difference; empty if the page ends before </body>."""

    def run(batches):
        for batch in batches:
            out = []
            for html in batch.column(1).to_pylist():
                parser = _Diff()
                parser.feed(html or "")
                out.append([" ".join(x) if parser.ended else "" for x in (parser.kept, parser.added, parser.removed)])
            yield pa.record_batch([batch.column(0), *[pa.array([r[i] for r in out], pa.string()) for i in range(3)]], ["page_id", "context", "added", "removed"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, context string, added string, removed string")
