"""Token tables, lexicons, domains, clusters."""

from pyspark.sql import functions as F

from larkspur.functions.text import words
from larkspur.operators import cluster, domain, lexicon, tokens
from larkspur.sources import corpora


def test_token_tables(spark):
    d = spark.createDataFrame([(1, "b a b"), (2, ""), (3, "c")], "identifier long, document string")
    names, seq = tokens.tokenised(d, F.filter(words(F.col("document")), lambda w: w != ""))
    ids = {r["token"]: r["identifier"] for r in names.collect()}
    assert ids == {"a": 1, "b": 2, "c": 3}
    assert {r["document_identifier"]: r["tokens"] for r in seq.collect()} == {1: [2, 1, 2], 2: [], 3: [3]}
    assert {r["identifier"] for r in tokens.unpopular(seq, 1, 2).collect()} == {2}
    left = tokens.without_tokens(seq, tokens.matching(names, "a"))
    assert {r["document_identifier"]: r["tokens"] for r in left.collect()} == {1: [2, 2], 2: [], 3: [3]}


def test_greedy_phrases(spark):
    d = spark.createDataFrame([("New York city is new",), ("new york new york",)], "document string")
    got = [r[0] for r in d.select(tokens.greedy_phrases(F.col("document"), ["new york", "new york city"])).collect()]
    assert got == [["new_york_city", "is", "new"], ["new_york", "new_york"]]


def lex(spark):
    rows = [("fine", "a", "1", 0.5, 0.0), ("fine", "n", "1", 0.25, 0.5), ("bad", "a", "2", 0.0, 0.75)]
    return spark.createDataFrame(rows, "word string, pos string, id string, positive double, negative double")


def test_lexicon_keys_synsets_by_part_of_speech(spark):
    assert {r["word"]: r["score"] for r in lexicon.objectivity(lex(spark)).collect()} == {"fine": (0.5 + 0.25) / 2, "bad": 0.25}
    assert {r["word"]: (r["max_positive"], r["max_negative"]) for r in lexicon.strengths(lex(spark)).collect()} == {"fine": (0.5, 0.5), "bad": (0.0, 0.75)}


def test_strength_and_subjectivity(spark):
    d = spark.createDataFrame([(1, "Fine day"), (2, "bad"), (3, "none"), (4, "fine bad")], "identifier long, document string")
    assert sorted((r[0], r[1]) for r in lexicon.strength_labels(d, lex(spark), 0.5).collect()) == [(1, 1), (2, 0), (3, 0), (4, 1)]
    assert sorted((r[0], r[1]) for r in lexicon.strength_labels(d, lex(spark), 0.5, True).collect()) == [(1, 1), (2, 1), (3, 0), (4, 1)]
    got = {r["identifier"]: r["subjectivity"] for r in lexicon.subjectivity(d, lexicon.objectivity(lex(spark))).collect()}
    assert got == {1: 0.375, 2: 0.25, 3: 0.0, 4: (0.375 + 0.25) / 2}


def test_domain_closure(spark):
    tree = {"tech": {"Apple": {"terms": ["apple", "ipad mini"]}, "terms": []}}
    assert domain.closure(tree) == sorted({("apple", "apple"), ("apple", "Apple"), ("apple", "tech"), ("ipad mini", "ipad mini"), ("ipad mini", "Apple"), ("ipad mini", "tech"), ("tech", "tech")})
    d = spark.createDataFrame([(1, "#Apple pie"), (2, "ipad mini"), (3, "tech")], "identifier long, document string")
    assert sorted(tuple(r) for r in domain.domain_labels(d, tree).collect()) == [(1, "Apple"), (1, "apple"), (1, "tech"), (3, "tech")]


def test_dbscan_on_six_sets(spark):
    sets = {1: "apples bananas oranges", 2: "apples bananas grapes", 3: "car bus train", 4: "car bus plane", 5: "bus train car boat", 6: "moon"}
    items = spark.createDataFrame([(i, w) for i, s in sets.items() for w in s.split()], "document_identifier long, label string")
    got = {r["document_identifier"]: r["cluster"] for r in cluster.dbscan(items, 0.6, 2).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: -1}


def test_jaccard_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(2)
    sets = {i: {rng.randrange(25) for _ in range(rng.randrange(1, 9))} for i in range(120)}
    items = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "document_identifier long, label long")
    want = {(a, b) for a in sets for b in sets if a < b and 1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.6}
    rep = {r["d"]: r["rep"] for r in cluster.members(items).collect()}
    assert rep == {a: min(b for b in sets if sets[b] == sets[a]) for a in sets} and len(set(rep.values())) < len(sets)
    found = {(r["a"], r["b"]) for r in cluster.jaccard_pairs(items).collect()}
    assert all(rep[a] == a and rep[b] == b for a, b in found)
    assert {(a, b) for a in sets for b in sets if a < b and (rep[a] == rep[b] or (min(rep[a], rep[b]), max(rep[a], rep[b])) in found)} == want


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# comment\na\t1\t0.5\t0\tgood#1 fine#2\tgloss\nn\t1\t0\t0.25\tgood#3\tgloss\n\t\t\t\t\t\n")
    got = sorted(tuple(r) for r in corpora.senti_word_net(spark, str(tmp_path / "l.txt")).collect())
    assert got == [("fine", "a", "1", 0.5, 0.0), ("good", "a", "1", 0.5, 0.0), ("good", "n", "1", 0.0, 0.25)]


def test_disambiguation_needs_overlap(spark):
    t = spark.createDataFrame([(1, 0, "bank"), (1, 1, "river"), (2, 0, "bank"), (2, 1, "sky"), (3, 0, "only")], "document_identifier long, at int, token string")
    g = spark.createDataFrame([("bank", "b1", "money house"), ("bank", "b2", "side of a river"), ("only", "o1", "nothing")], "word string, synset string, gloss string")
    assert sorted(tuple(r) for r in lexicon.disambiguate(t, g).collect()) == [(1, 0, "b2"), (3, 0, "o1")]


def test_tags_are_matched_to_words(spark):
    rows = [(1, "don't  stop it!", ["V/do", "R/n't", "V/stop", "O/it", ",/!"]), (2, "no match", ["N/other"]), (3, None, ["N/x"]), (4, "skip noise here", ["N/skip", "X/zzz", "N/noise", "R/here"])]
    df = spark.createDataFrame(rows, "identifier long, document string, tokens array<string>")
    got = sorted(tuple(r) for r in tokens.match_tags(df).collect())
    assert got == [(1, 0, 0, "V", "do"), (1, 0, 1, "R", "n't"), (1, 1, 2, "V", "stop"), (1, 2, 3, "O", "it"), (1, 2, 4, ",", "!"), (4, 0, 0, "N", "skip"), (4, 1, 2, "N", "noise"), (4, 2, 3, "R", "here")]


def test_nearest_offsets(spark):
    from larkspur.operators import annotations

    t = spark.createDataFrame([(1, 0, "a"), (1, 5, "b"), (1, 7, "c"), (1, 50, "d"), (2, 3, "e")], "identifier long, start long, token string")
    o = spark.createDataFrame([(1, 2, "x"), (1, 8, "y")], "identifier long, start long, word string")
    # 5 is as far from 2 as from 8: the earlier one
    assert sorted((r["token"], r["word"]) for r in annotations.nearest(t, o).collect()) == [("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")]


def test_domain_values(spark):
    from larkspur.corpus import Corpus
    from larkspur.registry import OPERATORS, Spec

    c = Corpus(spark, {"input": spark.createDataFrame([(1, 0.5), (2, 0.25)], "identifier long, v double")})
    c = corpora.associate(c, "domains", spark.createDataFrame([(1, "tech"), (2, "sport")], "identifier long, label string"))
    c = OPERATORS["DomainSpecificAnnotator"].run(c, Spec("DomainSpecificAnnotator", {"column": "v", "domain": "tech"}))
    assert {r["identifier"]: r["v"] for r in c.input.collect()} == {1: 0.5, 2: None}


def test_synset_distance_by_part_of_speech(spark):
    from larkspur.corpus import Corpus
    from larkspur.registry import OPERATORS, Spec

    c = Corpus(spark, {"input": spark.createDataFrame([(1, "bank runs"), (2, "pay $ now"), (3, "none")], "identifier long, document string")})
    c = c.with_table("pos_tokens_t", spark.createDataFrame([(1, "Bank/NN"), (2, "runs/VBZ"), (3, "pay/VB")], "identifier long, token string"))
    c = c.with_table("pos_t", spark.createDataFrame([(1, 1, [1, 2]), (2, 2, [3]), (3, 3, [])], "identifier long, document_identifier long, tokens array<long>"))
    c = c.with_table("similarity", spark.createDataFrame([("bank", "money.n.01", 0.5), ("runs", "money.n.01", 0.9), ("runs", "go.v.01", 0.25), ("bank", "other.n.01", 1.0)], "word string, target string, similarity double"))
    step = Spec("FinancialDistanceAnnotator", {"pos": "t", "annotateStockTweets": "true"}, [Spec("Synset", {"text": "money.n.01"}), Spec("Synset", {"text": "go.v.01"})])
    got = {r["identifier"]: r["distance"] for r in OPERATORS["FinancialDistanceAnnotator"].run(c, step).input.collect()}
    # a verb doesn't count for a noun
    assert got == {1: (0.5 + 0.25) / 2, 2: 1.0, 3: None}


def brute_pairs(sets, eps):
    out = {}
    for a, x in sets.items():
        for b, y in sets.items():
            distance = 1 - len(x & y) / len(x | y)
            if a < b and x != y and distance < eps:
                out[a, b] = round(distance, 9)
    return out


def test_set_pairs_with_hot_and_wide_items(spark):
    """Items that nearly all sets have, sets of one item to forty, and thresholds at which one shared item is enough."""
    import random

    rng = random.Random(8)
    sets = {}
    for d in range(160):
        kind = rng.randrange(4)
        items = {f"h{k}" for k in range(3) if rng.random() < 0.6} | {f"m{rng.randrange(12)}" for _ in range(rng.randrange(4))}
        items |= {f"w{rng.randrange(60)}" for _ in range(rng.randrange(36))} if kind == 0 else {f"r{rng.randrange(500)}"} if kind == 1 else set()
        sets[d] = frozenset(items or {f"h{rng.randrange(3)}"})
    sets |= {1000 + k: sets[k] for k in range(20)}
    df = spark.createDataFrame([(d, i) for d, s in sets.items() for i in s], "document_identifier long, label string")
    least = {}
    for d in sorted(sets):
        least.setdefault(sets[d], d)
    distinct = {d: s for s, d in least.items()}
    for eps in (0.2, 0.6, 0.8, 0.95):
        for heavy in (5, 1000):
            got = {(r["a"], r["b"]): round(r["distance"], 9) for r in cluster.set_pairs(cluster.item_sets(df), eps, heavy).collect()}
            assert got == brute_pairs(distinct, eps), (eps, heavy)


def test_six_thousand_sets_that_share_an_item(spark):
    import time

    items = spark.range(6000).selectExpr("id AS document_identifier", "explode(array('all', concat('own', id))) AS label")
    began = time.time()
    assert cluster.jaccard_pairs(items).count() == 0
    assert time.time() - began < 40


def test_phrases_of_a_large_lexicon(spark):
    """100,000 phrases, by a trie and by joins, against a scan of all runs of words."""
    import random

    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    phrases = {"_".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 2, 3, 4]))) for _ in range(100_000)} | {"w1_w2", "w1_w2_w3", "w2_w3_w4_w5", "single"}
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30))) for _ in range(60)] + ["W1 w2\tw3  w4 w5", "w1 w2 w9", None, " ", "w1"]

    def scan(text):
        w, out = (text or "").lower().split(), []
        while w:
            n = max([k for k in range(2, min(4, len(w)) + 1) if "_".join(w[:k]) in phrases], default=1)
            out.append("_".join(w[:n]))
            w = w[n:]
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "identifier long, document string")
    known = spark.createDataFrame([(p.replace("_", " ") if k % 2 else p.upper(),) for k, p in enumerate(sorted(phrases))], "phrase string")
    want = {i: scan(t) for i, t in enumerate(texts)}
    assert want[60] == ["w1_w2_w3", "w4", "w5"]
    for most in (tokens.PHRASES, 10):
        assert {r["identifier"]: r["tokens"] for r in tokens.phrase_tokens(df, known, most).collect()} == want
    assert sum("_" in t for w in want.values() for t in w) > 100


def test_a_tagger_is_trained_and_loaded(spark, tmp_path):
    """Tags follow from endings, and after "the" from the word before; a workflow's tagger uses the model."""
    import random

    from larkspur.corpus import Corpus
    from larkspur.operators import crf
    from larkspur.plans import workflow

    rng = random.Random(2)

    def sentence():
        out = []
        while len(out) < 12:
            stem = "".join(rng.choice("bdfgkmp") + rng.choice("aeiou") for _ in range(2))
            kind = rng.randrange(3)
            out += [("the", "D"), (stem + "ing", "N")] if kind == 0 else [(stem + "ing", "V")] if kind == 1 else [(stem + "ly", "R")]
        return out

    train, test = [sentence() for _ in range(80)], [sentence() for _ in range(20)]
    (tmp_path / "train").write_text("\n\n".join("\n".join(f"{w} {t}" for w, t in s) for s in train) + "\n")
    model = tokens.train_tagger(corpora.sequences(spark, str(tmp_path / "train"), ("w", "pos")), iterations=15)
    assert model.classes == ["D", "N", "R", "V"]
    df = spark.createDataFrame([(i, " ".join(w for w, _ in s)) for i, s in enumerate(test)] + [(99, None), (100, "")], "identifier long, document string")
    got = {r["identifier"]: r["tokens"] for r in tokens.tagged(df, model).collect()}
    want = [f"{t}/{w}" for s in test for w, t in s]
    right = sum(a == b for a, b in zip([t for i in range(20) for t in got[i]], want, strict=True))
    assert right > 0.97 * len(want) and got[99] == got[100] == []
    crf.save_model(spark, model, f"{tmp_path}/m")
    try:
        tokens.load_tagger(spark, f"{tmp_path}/m", "GimpelPOSTagger")
        done = workflow.run(spark, workflow.Workflow(tasks=workflow.steps(("GimpelPOSTagger", {"dest": "g"}))), Corpus(spark, {"input": df}))
        names = {r["identifier"]: r["token"] for r in done.table("pos_tokens_g").collect()}
        assert {r["document_identifier"]: [names[t] for t in r["tokens"]] for r in done.table("pos_g").collect()} == got
    finally:
        tokens.TAGGERS.pop("GimpelPOSTagger", None)
