"""Hierarchical domain tagging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..functions.text import words
from ..registry import Spec, operator
from .labels import number

Tree = dict  # name -> Tree of subdomains, or list of terms under the key "terms"


def closure(tree: dict) -> list[tuple[str, str]]:
    """(token, label): a lower-cased term labels itself, its domain and all ancestors; a
    top-level name that is itself a token labels as well."""
    out: set[tuple[str, str]] = set()

    def walk(name: str, node: dict, above: tuple[str, ...]):
        names = (*above, name)
        for term in node.get("terms", []):
            out.update((term.lower(), x) for x in (term.lower(), *names))
        for sub, child in node.items():
            if sub != "terms":
                walk(sub, child, names)

    for name, node in tree.items():
        walk(name, node, ())
        out.add((name, name))
    return sorted(out)


def domain_labels(df: DataFrame, tree: dict) -> DataFrame:
    """(document_identifier, label): distinct labels of a document's tokens.

    Tokens are lower-case words without one leading # or @; terms of several words match none.
    """
    table = df.sparkSession.createDataFrame(closure(tree), "token string, label string")  # as large as the workflow's tree
    tokens = df.select(F.col("identifier").alias("document_identifier"), F.explode(F.array_distinct(F.transform(words(F.lower("document")), lambda w: F.regexp_replace(w, "^[#@]", "")))).alias("token"))
    return tokens.join(F.broadcast(table), "token").select("document_identifier", "label").distinct()


def _tree(s: Spec) -> dict:
    out: dict = {"terms": [x.get("term", x.get("text")) for x in s.all("DomainTerm") if not x.children]}
    for sub in [*s.all("Domain"), *(x for x in s.all("DomainTerm") if x.children)]:
        out[sub.get("name", sub.get("term"))] = _tree(sub)
    return out


@operator("DomainLabeller", (), ("table",))
def _domain(c: Corpus, s: Spec) -> Corpus:
    """Documents without any domain go."""
    tree = {k: v for k, v in _tree(s).items() if k != "terms"}
    found = domain_labels(c.input, tree)
    names = number(found.select("label").distinct(), "label", 1, "label_identifier").select("label_identifier", "label")
    bridge = found.join(names, "label").select("document_identifier", F.col("label_identifier").alias("label"))
    table = s.get("table", "domains")
    kept = c.input.join(found.select(F.col("document_identifier").alias("identifier")).distinct(), "identifier", "left_semi")
    return c.with_input(kept).with_table(f"label_names_{table}", names).with_table(f"label_{table}", bridge)
