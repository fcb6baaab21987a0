"""Path similarity over a hypernym graph, against a plain search."""

from collections import deque

import numpy as np

from larkspur.corpus import Corpus
from larkspur.operators import hypernyms, lexicon  # noqa: F401
from larkspur.registry import OPERATORS, Spec


def ancestors(edges, node):
    found, queue = {node: 0}, deque([node])
    while queue:
        at = queue.popleft()
        for child, parent in edges:
            if child == at and parent not in found:
                found[parent] = found[at] + 1
                queue.append(parent)
    return found


def plain(edges, a, b, rooted=False):
    x, y = ancestors(edges, a), ancestors(edges, b)
    if rooted:
        x["root"], y["root"] = max(x.values()) + 1, max(y.values()) + 1
    both = [x[k] + y[k] for k in x.keys() & y.keys()]
    return min(both) if both and a != b else (0 if a == b else None)


def graph(seed, kind, n=14):
    rng = np.random.default_rng(seed)
    return [(f"s{i}.{kind}.01", f"s{int(rng.integers(0, i))}.{kind}.01") for i in range(2, n) for _ in range(int(rng.integers(0, 3)))]


def test_distances_equal_a_plain_search(spark):
    edges = graph(1, "n") + graph(2, "v") + [("c1.n.01", "c2.n.01"), ("c2.n.01", "c1.n.01")]  # a cycle, too
    rows = spark.createDataFrame(edges + edges[:3] + [(None, "s1.n.01"), ("s1.n.01", None)], "synset string, hypernym string")
    targets = ["s5.n.01", "s9.v.01", "c1.n.01", "alone.n.01"]
    got = hypernyms.distances(rows, spark.createDataFrame([(t,) for t in targets + targets[:1] + [None]], "target string")).collect()
    nodes = sorted({x for e in edges for x in e} | {"alone.n.01"})
    want = {(t, s): d for t in targets for s in nodes if (d := plain(edges, t, s)) is not None}
    assert len(got) == len(want)
    assert {(r["target"], r["synset"]): r["distance"] for r in got} == want
    # a shared hyponym doesn't join two synsets
    split = spark.createDataFrame([("low.n.01", "a.n.01"), ("low.n.01", "b.n.01")], "synset string, hypernym string")
    near = hypernyms.distances(split, spark.createDataFrame([("a.n.01",)], "target string")).collect()
    assert {r["synset"]: r["distance"] for r in near} == {"a.n.01": 0, "low.n.01": 1}


def test_similarities_of_words_with_several_senses_and_verbs(spark):
    edges = graph(3, "n") + graph(4, "v")
    rng = np.random.default_rng(5)
    senses = sorted({(f"w{int(rng.integers(0, 12))}", f"s{int(rng.integers(0, 14))}.{'nv'[int(rng.integers(0, 2))]}.01") for _ in range(40)})
    targets = ["s7.n.01", "s3.n.01", "s6.v.01", "s11.v.01"]
    got = hypernyms.similarities(
        spark.createDataFrame(senses + senses[:2] + [(None, "s7.n.01"), ("w0", None)], "word string, synset string"),
        spark.createDataFrame(edges, "synset string, hypernym string"),
        spark.createDataFrame([(t,) for t in targets], "target string"),
    ).collect()
    want = {}
    for word, synset in senses:
        for t in targets:
            if t.split(".")[1] == synset.split(".")[1]:
                d = plain(edges, synset, t, rooted=".v." in t)
                if d is not None:
                    want[word, t] = max(want.get((word, t), 0), 1 / (1 + d))
    assert {(r["word"], r["target"]): r["similarity"] for r in got} == want and len(got) == len(want)


def test_no_rows(spark):
    no = spark.createDataFrame([], "synset string, hypernym string")
    none = spark.createDataFrame([], "target string")
    words = spark.createDataFrame([("w", "a.v.01")], "word string, synset string")
    assert hypernyms.distances(no, none).count() == 0
    assert hypernyms.similarities(words, no, none).count() == 0
    alone = hypernyms.similarities(words, no, spark.createDataFrame([("a.v.01",), ("b.v.01",)], "target string")).collect()
    assert {r["target"]: r["similarity"] for r in alone} == {"a.v.01": 1.0, "b.v.01": 1 / 3}


def test_annotator_reads_a_graph(spark):
    c = Corpus(spark, {"input": spark.createDataFrame([(1, "bank runs"), (2, "pay $ now"), (3, "none"), (4, "tree")], "identifier long, document string")})
    c = c.with_table("pos_tokens_t", spark.createDataFrame([(1, "Bank/NN"), (2, "runs/VBZ"), (3, "pay/VB"), (4, "tree/NN")], "identifier long, token string"))
    c = c.with_table("pos_t", spark.createDataFrame([(1, 1, [1, 2]), (2, 2, [3]), (3, 3, []), (4, 4, [4])], "identifier long, document_identifier long, tokens array<long>"))
    c = c.with_table("senses", spark.createDataFrame([("bank", "bank.n.01"), ("bank", "bank.n.02"), ("runs", "run.v.01"), ("tree", "tree.n.01")], "word string, synset string"))
    c = c.with_table("graph", spark.createDataFrame([("bank.n.01", "firm.n.01"), ("firm.n.01", "group.n.01"), ("money.n.01", "firm.n.01"), ("run.v.01", "go.v.01")], "synset string, hypernym string"))
    step = Spec("FinancialDistanceAnnotator", {"pos": "t", "hypernyms": "graph"}, [Spec("Synset", {"text": "money.n.01"}), Spec("Synset", {"text": "go.v.01"})])
    got = {r["identifier"]: r["distance"] for r in OPERATORS["FinancialDistanceAnnotator"].run(c, step).input.collect()}
    # a noun that nothing joins with a target counts 0 for it; a verb that isn't in the graph too
    assert got == {1: (1 / 3 + 1 / 2) / 2, 2: 0.0, 3: None, 4: 0.0}
