"""Sinks: frozen single files, their digests, durable appends, documents and pages."""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import tempfile
from collections.abc import Iterable, Mapping, Sequence
from contextlib import contextmanager
from html import escape
from pathlib import Path
from string import Template
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import file_digest


@contextmanager
def replaced(path: str | Path):
    """A text file to write that takes its place only when whole: temporary sibling, flush, sync, rename."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(prefix=f".{path.name}.", dir=path.parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as file:
            yield file
            file.flush()
            os.fsync(file.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_frozen(df: DataFrame, path: str | Path, order: Sequence[str], columns: Sequence[str] | None = None, sep: str = "\t") -> str:
    """One delimited file in a total order, LF line ends, written by the driver row by row; returns its digest.

    For small frozen splits whose digest must be that of one file. Rows stream to
    the driver a partition at a time.
    """
    rows = df.orderBy(*order).select(*(columns or df.columns))
    with replaced(path) as file:
        out = csv.writer(file, delimiter=sep, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
        out.writerow(rows.columns)
        for row in rows.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
    return file_digest(path)


def write_delimited(df: DataFrame, path: str | Path, sep: str = "\t") -> None:
    """A folder of delimited files, one a task, each with a header; all fields quoted, quotes inside doubled, nulls written as empty fields."""
    texts = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    options = {"sep": sep, "quote": '"', "escape": '"', "quoteAll": True, "header": True, "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    texts.write.options(**options).csv(str(path))


def write_sidecar(path: str | Path, sidecar: str | Path) -> str:
    """The file's digest and name, as digest tools read them."""
    digest = file_digest(path)
    with replaced(sidecar) as file:
        file.write(f"{digest}  {Path(path).name}\n")
    return digest


def append_store(path: str | Path, rows: Iterable[Mapping[str, Any]]) -> None:
    """Appends JSON lines and syncs. A last line that was cut off is ended first, so it alone is lost."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "ab+") as file:
        if file.tell():
            file.seek(-1, os.SEEK_END)
            if file.read(1) != b"\n":
                file.write(b"\n")
        for row in rows:
            file.write((json.dumps(row, ensure_ascii=False) + "\n").encode())
        file.flush()
        os.fsync(file.fileno())


def append_parts(df: DataFrame, folder: str | Path) -> None:
    """Appends a table to a store of immutable part files, which have no tail to cut off."""
    df.write.mode("append").json(str(folder))


def write_json(value: Mapping[str, Any], path: str | Path) -> None:
    with replaced(path) as file:
        json.dump(value, file, ensure_ascii=False, indent=2, default=str)
        file.write("\n")


def write_table(df: DataFrame, folder: str | Path, partition_by: Sequence[str] = (), format: str = "parquet") -> None:
    """A table at any size: part files under a job commit."""
    df.write.mode("overwrite").partitionBy(*partition_by).format(format).options(header=True).save(str(folder))


def markdown_table(rows: Sequence[Mapping[str, Any]], columns: Sequence[str]) -> str:
    out = io.StringIO()
    out.write("| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n")
    for row in rows:
        out.write("| " + " | ".join(str(row.get(c, "")) for c in columns) + " |\n")
    return out.getvalue()


#: Columns of the predictions of a short trial run, before and after training.
TRIAL = ("record_id", "group_id", "source", "target", "base_prediction", "tuned_prediction")


def write_trial(df: DataFrame, path: str | Path, order: Sequence[str] = ("record_id",)) -> str:
    """The predictions of a trial run as one comma-separated file, six columns of ``df`` and no others; returns its digest."""
    return write_frozen(df, path, order, TRIAL, sep=",")


def model_card(report: Mapping[str, Any], title: str, source: str, target: str, facts: Mapping[str, Any] | None = None) -> str:
    """A Markdown page of the report's systems, intervals and sample, how the model was made and decoded (``facts``), its use and limits."""
    training = report.get("training") or {}
    systems = [{"system": name, "chrF++": f"{m['chrfpp']:.2f}", "BLEU": f"{m['bleu']:.2f}", "copies": f"{m['exact_copy_rate']:.1%}"} for name, m in report["systems"].items()]
    lines = [f"# {title}", "", f"Translation from {source} to {target}.", "", f"Scored on {report['sentences']} sentences.", "", markdown_table(systems, ["system", "chrF++", "BLEU", "copies"])]
    for name, r in report.get("significance", {}).items():
        if r:
            lines.append(f"{name}: {r['observed_delta']:+.2f} chrF++ (95 % interval {r['ci95_low']:+.2f} to {r['ci95_high']:+.2f}, p = {r['p_value']}).")
    made = {**(facts or {}), "optimizer steps": training.get("global_step"), "best dev loss": training.get("best_dev_loss"), "decoding": f"greedy, at most {report.get('max_new_tokens')} new tokens", "test split SHA-256": report.get("test_sha256")}
    lines += ["", "## How it was made", "", *(f"* {k}: {v}" for k, v in made.items())]
    lines += ["", "## Use", "", f"Load the base model, put the weights in `adapter` on it, and ask for a translation of one text from {source} into {target} in a single user message."]
    lines += ["", "## Limits", "", f"All scores are automatic and come from one sample of {report['sentences']} sentences; nobody judged the translations. What training did to other pairs of languages wasn't measured. `copy_source` gives the input back unchanged and shows what copying alone earns."]
    return "\n".join(lines) + "\n"


_PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>$title</title><style>
body { font: 15px sans-serif; max-width: 60em; margin: 2em auto } td, th { padding: 2px 8px; text-align: left }
.bar { background: #4a7ab5; height: 12px } section.row { border-top: 1px solid #ccc; padding: 6px 0 } svg { width: 100%; height: 160px }
</style></head><body><h1>$title</h1>
<h2>Systems</h2><table id="systems"></table><h2>Differences</h2><ul id="tests"></ul>
<h2>Loss</h2><svg id="loss" viewBox="0 0 600 160" preserveAspectRatio="none"></svg>
<h2>Adapter</h2><table id="norms"></table>
<h2>Sentences</h2><input id="search" placeholder="search"><select id="mode"><option value="gain">largest gain</option><option value="high">highest score</option><option value="low">lowest score</option></select>
<p id="shown"></p><div id="rows"></div>
<script id="data" type="application/json">$payload</script>
<script>
const data = JSON.parse(document.getElementById("data").textContent), at = id => document.getElementById(id);
function node(parent, tag, text) { const n = document.createElement(tag); if (text !== undefined) n.textContent = text; parent.appendChild(n); return n; }
function line(table, cells, share) {
  const row = node(table, "tr"); cells.forEach(c => node(row, "td", c));
  const bar = node(node(row, "td"), "div"); bar.className = "bar"; bar.style.width = Math.max(0, 300 * (share || 0)) + "px";
}
const digits = x => typeof x === "number" ? x.toFixed(2) : "";
for (const [name, s] of Object.entries(data.systems || {})) line(at("systems"), [name, "chrF++ " + digits(s.chrfpp), "BLEU " + digits(s.bleu), "copies " + digits(s.exact_copy_rate)], s.chrfpp / 100);
for (const [name, t] of Object.entries(data.significance || {})) if (t) node(at("tests"), "li", name + ": " + digits(t.observed_delta) + " (" + digits(t.ci95_low) + " to " + digits(t.ci95_high) + "), p = " + t.p_value);
const curves = [[data.train_loss || [], "#4a7ab5"], [data.dev_loss || [], "#c0562f"]], points = curves.flatMap(c => c[0]);
const far = Math.max(1, ...points.map(p => p[0])), top = Math.max(1e-9, ...points.map(p => p[1]));
for (const [curve, color] of curves) {
  const path = document.createElementNS("http://www.w3.org/2000/svg", "polyline");
  path.setAttribute("points", curve.map(p => 600 * p[0] / far + "," + (155 - 150 * p[1] / top)).join(" "));
  path.setAttribute("fill", "none"); path.setAttribute("stroke", color); at("loss").appendChild(path);
}
const modules = (data.lora || {}).by_module || [], largest = Math.max(1e-12, ...modules.map(m => m.norm));
for (const m of modules) line(at("norms"), [m.module, digits(m.norm)], m.norm / largest);
const score = (r, s) => r["chrfpp_" + s], known = x => typeof x === "number" && !Number.isNaN(x);
const keys = {gain: r => score(r, "tuned") - score(r, "base"), high: r => score(r, "tuned"), low: r => -score(r, "tuned")};
function show() {
  const wanted = at("search").value.trim().toLowerCase(), key = keys[at("mode").value], value = r => known(key(r)) ? key(r) : -Infinity;
  const found = (data.explorer || []).filter(r => Object.values(r).some(v => typeof v === "string" && v.toLowerCase().includes(wanted)));
  found.sort((x, y) => value(x) < value(y) ? 1 : value(x) > value(y) ? -1 : 0);
  at("shown").textContent = found.length + " of " + data.explorer_total + " sentences; up to 50 are shown.";
  at("rows").replaceChildren();
  for (const r of found.slice(0, 50)) {
    const box = node(at("rows"), "section"); box.className = "row";
    for (const [name, v] of Object.entries(r)) node(box, "div", name + ": " + (known(v) ? digits(v) : v));
  }
}
at("search").addEventListener("input", show); at("mode").addEventListener("change", show); show();
</script></body></html>
"""


def html_page(data: Mapping[str, Any], title: str) -> str:
    """A page without outside parts: bars of the systems, tests, losses, adapter norms, and sentences to search and sort in three ways.

    Its data can't end the script element they stand in, the title can't hold
    markup, and texts are put in as text.
    """
    payload = json.dumps(data, ensure_ascii=False, default=str).replace("</", "<\\/")
    return Template(_PAGE).substitute(title=escape(title), payload=payload)


def package(folder: str | Path, adapter: str | Path, report: Mapping[str, Any], card: str) -> Path:
    """Adapter, report and card in one folder."""
    folder = Path(folder)
    shutil.copytree(adapter, folder / "adapter", dirs_exist_ok=True)
    write_json(report, folder / "evaluation_report.json")
    with replaced(folder / "README.md") as file:
        file.write(card)
    return folder
