"""Workflows: an XML file or a list of steps, applied to a corpus of DataFrames."""

from __future__ import annotations

import os
import subprocess
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from .. import operators as _operators  # noqa: F401
from ..checkpoint import ResultStore, fingerprint
from ..corpus import Corpus
from ..operators import annotations, classify, cluster, domain, features, filters, labels, lexicon, normalise, phrases, results, tokens  # noqa: F401
from ..registry import OPERATORS, Spec
from ..sources import corpora, sinks  # noqa: F401


@dataclass
class Workflow:
    name: str = ""
    description: str = ""
    sources: list[Spec] = field(default_factory=list)
    tasks: list[Spec] = field(default_factory=list)
    tables: list[Spec] = field(default_factory=list)
    retain: str | None = None
    debug_counts: str | None = None
    text: str = ""


def _spec(e: ET.Element) -> Spec:
    attributes = dict(e.attrib)
    if e.text and e.text.strip():
        attributes.setdefault("text", e.text.strip())
    return Spec(e.tag, attributes, [_spec(c) for c in e if isinstance(c.tag, str)])


def parse(text: str) -> Workflow:
    """A workflow from XML; missing sections are empty, comments are skipped."""
    root = ET.fromstring(text)

    def section(name):
        found = root.find(name)
        return [] if found is None else [_spec(c) for c in found if isinstance(c.tag, str)]

    options = {o.name: o for o in section("WorkflowOptions")}
    of = lambda n: options[n].get("text", options[n].get("value")) if n in options else ""
    retain = options["RetainOutputFile"].get("path") if "RetainOutputFile" in options else None
    if "RetainOutputFile" in options and not retain:
        raise ValueError("RetainOutputFile needs a path")
    counts = options["DebugDocumentCount"].get("path") if "DebugDocumentCount" in options else None
    return Workflow(of("WorkflowName"), of("WorkflowDescription"), section("InputSources"), section("WorkflowTasks"), section("Tables"), retain, counts, text)


def validate(w: Workflow) -> None:
    """Every tag must be known, and have its required attributes and no unknown ones, before anything runs."""
    for s in [*w.sources, *w.tasks]:
        if s.name == "PreviousWorkflow":
            if s.get("path") is None and s.get("db") is None:
                raise ValueError("PreviousWorkflow lacks path or db")
            continue
        if s.name not in OPERATORS:
            raise ValueError(f"no operator {s.name}")
        OPERATORS[s.name].check(s)


def version() -> str:
    """The commit of this package's source; unknown outside a repository."""
    found = subprocess.run(["git", "rev-parse", "HEAD"], cwd=os.path.dirname(__file__), capture_output=True, text=True, check=False)
    return found.stdout.strip() or "unknown"


def read_text(spark: SparkSession, path: str) -> str:
    """A file's text, by Spark's readers, so from any store."""
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def previous(spark: SparkSession, s: Spec, store: ResultStore | None, load, rerun: bool, own: dict) -> Corpus:
    """Another workflow's output: what its RetainOutputFile, or the attribute db, holds.

    It is made again if it is missing, if the workflow's text is another one than it was made by, with rerun, and
    with strictHashCheck if this package's commit is another one.  A workflow (path) that retains
    nothing is kept in the store, by its text.
    """
    path, at = s.get("path"), s.get("db")
    if path is None:
        found = sinks.retained(spark, at)
        if found is None:
            raise ValueError(f"nothing is retained at {at}")
        return found
    text = load(path)
    w = parse(text)
    at = at or w.retain
    if at is None and store is None:
        raise ValueError(f"{path} retains no output")
    found = None if rerun else sinks.retained(spark, at) if at else store.find(fingerprint(text))
    if found is not None and found.metadata.get("WORKFLOW") == text and not (s.get("strictHashCheck", False, bool) and found.metadata.get("GIT_HASH") != version()):
        return found
    made = run(spark, replace(w, retain=at), Corpus(spark, own), store, load, rerun, path, own)
    return sinks.retained(spark, at) if at else store.keep(fingerprint(text), made)


def run(spark: SparkSession, w: Workflow, start: Corpus | None = None, store: ResultStore | None = None, load=None, rerun: bool = False, path: str = "", own: dict | None = None) -> Corpus:
    """Apply sources, then tasks; an error ends the run and nothing is retained.

    load(path) gives the text of another workflow's file, by default read by Spark; rerun makes such workflows
    anew.  own: tables (a lexicon, say) that those start with as well.
    """
    validate(w)
    load = load or (lambda p: read_text(spark, p))
    corpus = start or Corpus(spark, dict(own or {}))
    counts: list[tuple[int, str]] = []
    for k, s in enumerate([*w.sources, *w.tasks]):
        if w.debug_counts and k >= len(w.sources):
            counts.append((corpus.input.count(), s.name))
        if s.name == "PreviousWorkflow":
            found = previous(spark, s, store, load, rerun, dict(own or {}))
            corpus = replace(found, tables={**corpus.tables, **found.tables})
        else:
            corpus = OPERATORS[s.name].run(corpus, s)
    corpus = corpus.with_metadata(WORKFLOW=w.text, WORKFLOW_NAME=w.name, WORKFLOW_PATH=path, GIT_HASH=version())
    if w.debug_counts:
        counts.append((corpus.input.count(), "FINISH"))
        sinks.write_csv(spark.createDataFrame(counts, "count long, activity string").coalesce(1), w.debug_counts)
    if w.retain:
        sinks.retain(corpus, w.retain)
    return corpus


def steps(*parts: tuple | str) -> list[Spec]:
    """Steps from names or (name, attributes) or (name, attributes, children)."""
    out = []
    for p in parts:
        name, attributes, children = (p, {}, []) if isinstance(p, str) else (*p, [])[:3] if len(p) > 1 else (p[0], {}, [])
        out.append(Spec(name, {k: str(v) for k, v in attributes.items()}, steps(*children)))
    return out
