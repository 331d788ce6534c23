"""Sinks: run-partitioned Parquet, sealed corpora, journals with commit markers, published JSON, HTML reports."""

from __future__ import annotations

import hashlib
import html
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import DataFrame

from ..guards import require
from ..operators import corpus as corpus_ops
from ..operators.journals import MAX_ROW_BYTES
from . import sealed_corpus
from .files import MARKER_FILE, METRICS_FILE

MAX_MESSAGE = 16_384


def write_by_run(df: DataFrame, path: str) -> None:
    """Parquet partitioned by run; never over an existing output."""
    df.write.mode("errorifexists").partitionBy("run").parquet(path)


@contextmanager
def published(path: str | Path) -> Iterator[BinaryIO]:
    """A file beside `path` to write to; it takes the name when the block ends well, and is gone otherwise."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        with draft.open("xb") as out:
            yield out
            out.flush()
            os.fsync(out.fileno())
        draft.rename(path)
        folder = os.open(path.parent, os.O_RDONLY)
        try:
            os.fsync(folder)  # the name is durable too
        finally:
            os.close(folder)
    finally:
        draft.unlink(missing_ok=True)


def write_json(path: str | Path, value: object) -> None:
    """A JSON document that is there whole or not at all; NaN is refused."""
    with published(path) as out:
        out.write(json.dumps(value, indent=2, sort_keys=True, allow_nan=False).encode() + b"\n")


def write_corpus(docs: DataFrame, path: str, max_length: int = 128, min_length: int = 2) -> dict:
    """Windows in ranges of ids, accounts and hashes of files, then the sealed manifest: a corpus without one doesn't count."""
    spark = docs.sparkSession
    accounts = corpus_ops.accounting(docs, max_length, min_length, "doc")
    require(accounts.filter("samples > 0").limit(1).count() > 0, "no windows in the documents")
    windows = corpus_ops.windows(docs, max_length, min_length, "doc")
    first = corpus_ops.offsets(accounts.select("doc", "samples", "bytes"), "doc", "samples").withColumnRenamed("offset", "first_sample")
    windows = windows.join(first.select("doc", "first_sample"), "doc")
    rows = windows.selectExpr("first_sample + piece AS sample_id", "doc", "length", "tokens")
    sealed_corpus.lay_out(rows, path)
    accounts.write.mode("errorifexists").parquet(f"{path}/documents")
    stored = spark.read.parquet(f"{path}/documents")
    totals = corpus_ops.totals(stored).first().asDict()
    manifest = {"schema_version": 1, "max_length": max_length, "min_length": min_length, **totals, "corpus_sha256": corpus_ops.identity(stored).first()[0], "files_sha256": sealed_corpus.seal(spark, path)}
    manifest["sha256"] = sealed_corpus.content_sha256(manifest)
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    return manifest


def journal_lines(rows: Iterable[dict], rank: int, first_step: int) -> bytes:
    """A batch of a rank's rows as they stand in a journal; a batch with a bad row is refused whole."""
    rows = list(rows)
    lines = [json.dumps(row, sort_keys=True, allow_nan=False).encode() + b"\n" for row in rows]
    for step, (row, line) in enumerate(zip(rows, lines, strict=True), first_step):
        require((row.get("rank"), row.get("step")) == (rank, step) and type(row["step"]) is int, "rows must follow without gaps")
        require(isinstance(row.get("step_ms"), (int, float)) and not isinstance(row["step_ms"], bool) and row["step_ms"] > 0, "step times must be positive")
        require(len(line) <= MAX_ROW_BYTES, "a row is too long")
    return b"".join(lines)


#: What a marker says of a journal (fixed names); a sink may add more.
MARKER_FIELDS = ("schema_version", "rank", "start_step", "last_step", "rows", "bytes", "sha256", "flushes", "complete")


def marker_fields(marker: dict) -> dict:
    return {k: marker.get(k) for k in MARKER_FIELDS}


class Journal:
    """A rank's journal, open for appending by one process: what is there is checked once, then only new bytes are hashed.

    The marker on disk is all the state there is: what lies behind it is cut off, a complete journal takes nothing more, and a
    journal without a marker must not exist yet.
    """

    def __init__(self, root: str | Path, rank: int, start_step: int = 0):
        self.rank, self.start_step = rank, start_step
        self.data, self.mark = (Path(root) / name.replace("*", str(rank)) for name in (METRICS_FILE, MARKER_FILE))
        known = json.loads(self.mark.read_text()) if self.mark.exists() else None
        require(known is not None or not self.data.exists(), "a journal without a marker is in the way")
        require(known is None or (not known["complete"] and known["start_step"] == start_step), "the journal is complete, or starts at another step")
        self.rows, self.bytes, self.flushes = (known[k] if known else 0 for k in ("rows", "bytes", "flushes"))
        self.digest = hashlib.sha256()
        self.out: BinaryIO | None = None
        self.closed = False
        if known:
            self.out, left = self.data.open("r+b"), self.bytes
            while left and (block := self.out.read(min(left, 1 << 20))):
                self.digest.update(block)
                left -= len(block)
            if left or self.digest.hexdigest() != known["sha256"]:
                self.close()
                raise ValueError("the journal isn't what its marker says")

    def write(self, rows: Iterable[dict], complete: bool = False) -> dict:
        """Append a batch and mark it durable; returns the marker. A batch with a bad row is refused whole."""
        require(not self.closed, "the journal is closed")
        rows = list(rows)
        lines = journal_lines(rows, self.rank, self.start_step + self.rows)
        self.out = self.out or self.data.open("xb")
        self.out.seek(self.bytes)
        self.out.write(lines)
        self.out.truncate()
        self.out.flush()
        os.fsync(self.out.fileno())
        self.digest.update(lines)
        self.rows, self.bytes, self.flushes = self.rows + len(rows), self.bytes + len(lines), self.flushes + 1
        marker = self.marker(complete)
        write_json(self.mark, marker)
        if complete:
            self.close()
        return marker

    def marker(self, complete: bool = False) -> dict:
        values = (1, self.rank, self.start_step, self.start_step + self.rows - 1, self.rows, self.bytes, self.digest.hexdigest(), self.flushes, complete)
        return dict(zip(MARKER_FIELDS, values, strict=True))

    def close(self) -> None:
        self.closed = True
        if self.out:
            self.out.close()


def append_journal(root: str | Path, rank: int, rows: Iterable[dict], start_step: int = 0, complete: bool = False) -> dict:
    """Append one batch to a rank's journal and mark it durable; returns the marker. For many batches hold a `Journal` open."""
    journal = Journal(root, rank, start_step)
    try:
        return journal.write(rows, complete)
    finally:
        journal.close()


def failure_record(rank: int, error: BaseException) -> dict:
    return {"rank": rank, "type": type(error).__name__, "message": str(error)[:MAX_MESSAGE]}


def write_html(title: str, sections: dict[str, list[dict]], path: str | Path) -> None:
    """An offline page of tables; every value is escaped."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, rows in sections.items():
        columns = list(dict.fromkeys(c for r in rows for c in r))
        head = "".join(f"<th>{html.escape(str(c))}</th>" for c in columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r.get(c, '')))}</td>" for c in columns) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    Path(path).write_text("\n".join(parts), encoding="utf-8")


def write_interactive_html(title: str, data: object, path: str | Path) -> None:
    """A page that filters the rows of its embedded JSON; `<` and `&` of the data are escaped, so it can't end the script."""
    payload = json.dumps(data, allow_nan=False).replace("&", "\\u0026").replace("<", "\\u003c")
    page = f"""<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>
<input id=q placeholder=filter><table id=t></table><script type="application/json" id=d>{payload}</script>
<script>const rows=JSON.parse(document.getElementById('d').textContent),t=document.getElementById('t'),q=document.getElementById('q');
const show=()=>{{t.replaceChildren(...rows.filter(r=>JSON.stringify(r).includes(q.value)).map(r=>{{const e=document.createElement('tr');for(const v of Object.values(r)){{const c=document.createElement('td');c.textContent=JSON.stringify(v);e.append(c)}}return e}}))}};q.oninput=show;show()</script>"""
    Path(path).write_text(page, encoding="utf-8")
