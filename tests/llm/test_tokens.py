"""Counts, ids, decoding and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larkspur.llm import bpe
from larkspur.llm.lexicon import Lexicon, build_lexicon, compile_lexicon, decode, encode
from larkspur.llm.packing import pack_documents, sum_of_squares
from larkspur.llm.token_counts import count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    "The quick brown fox, isn't it? 123 été İstanbul ﬁ é <|endoftext|>x<|startoftext|> 日本語　text a\u0301",
    None,
    "",
    " \n\t",
    "a" * 5000 + " " + "=" * 3000 + " " + "ab" * 4000,
    "I'VE we'll 's 'S don't <|ENDOFTEXT|> <| endoftext|>",
    "words " * 9000,
    "\x1c\x1d a\x85b\xa0c ǅ Σς ΑΣ",
]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aeinst'<|>!-_ \n12éÉİß\u0301")), st.characters(codec="utf-8")), max_size=60))
def test_chunks_equal_the_library(text):
    got = np.frombuffer(bpe.id_chunks(PATH).of([text])[0], "<u4").tolist()
    assert got == ids(text)
    assert bpe.count_chunks(PATH).of([text]) == [len(got)]


def test_counts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in count_tokens(docs.withColumn("n_tokens", docs["doc_id"]), PATH).collect():
        t = TEXTS[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), len(ids(t)), len(ids(t)) > 2048)
    assert count_tokens(docs.limit(0), PATH).count() == 0


def test_lexicon_finds_entries_only():
    rng = random.Random(1)
    words = {bytes(rng.choice(b"abc\xc3") for _ in range(rng.randrange(1, 7))) for _ in range(400)}
    entries = {w: rng.randbytes(4 * rng.randrange(1, 4)) for w in sorted(words)[::2]}
    lexicon = Lexicon(compile_lexicon(entries))
    asked = [*words, b"", b"zz", b"a" * 100]
    assert lexicon.find(asked) == [entries.get(w) for w in asked]
    assert Lexicon(compile_lexicon({})).find([b"a"]) == [None]


def test_shared_suffixes():
    entries = {a + b"tion": b"\1\0\0\0" for a in (b"na", b"sta", b"ra")}
    lexicon = Lexicon(compile_lexicon(entries))
    assert len(lexicon.final) < sum(map(len, entries)) - 6


@pytest.mark.parametrize("entries", [0, 3, 1000])
def test_encode_and_decode(spark, entries):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    block = build_lexicon(docs, PATH, entries)
    for r in decode(encode(docs, PATH, block), PATH).collect():
        want = ids(TEXTS[r["doc_id"]])
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        assert r["text"] == LIBRARY.decode(want, skip_special_tokens=False)
        assert len(hashlib.sha256(r["text"].encode()).hexdigest()) == 64


def brute_pack(lengths, most):
    open_, out, made = [], [], 0
    for s in lengths:
        def total(bins):
            n = {}
            for g, _ in bins:
                if g:
                    n[g] = n.get(g, 0) + 1
            return sum(v * v for v in n.values())

        best = None
        for k, (g, b) in enumerate(open_):
            if g >= s and g:
                t = (total([*open_[:k], (g - s, b), *open_[k + 1 :]]), 0, g)
                best = min(best, (t, k)) if best else (t, k)
        new = (total([*open_, (most - s, made)]), 1, most)
        if best is None or new[:2] < best[0][:2]:
            open_.append((most - s, made))
            out.append(made)
            made += 1
        else:
            g, b = open_[best[1]]
            open_[best[1]] = (g - s, b)
            out.append(b)
    return out, made


def test_sum_of_squares_against_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        most = rng.randrange(4, 30)
        lengths = [rng.randrange(1, most + 1) for _ in range(rng.randrange(1, 60))]
        seq, off, made = sum_of_squares(np.array(lengths), most)
        assert made == brute_pack(lengths, most)[1]
        for b in range(made):
            inside = [(o, n) for o, n, s in zip(off.tolist(), lengths, seq.tolist(), strict=True) if s == b]
            at = 0
            for o, n in sorted(inside):
                assert o == at
                at += n
            assert at <= most


def test_packing(spark):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice(["red", "green", "blue!", "éa"]) for _ in range(rng.randrange(1, 900))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = pack_documents(docs, PATH).collect()
    whole = {i: [*ids(t), 1] for i, t in enumerate(texts)}
    pieces, used = {}, {}
    for r in got:
        part = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 4096 * r["piece"] and len(part) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces.setdefault(r["doc_id"], []).append(r["length"])
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {i: sum(p) for i, p in pieces.items()} == {i: len(w) for i, w in whole.items()}
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert len(used) <= -(-sum(map(len, whole.values())) // 4096) + 2
    assert pack_documents(docs.limit(0), PATH).count() == 0


def odd(spark, texts):
    """Null ids, repeated rows, and columns with the names of results."""
    rows = [(i, t, "x", 7, 9) for i, t in enumerate(texts)] + [(0, texts[0], "x", 7, 9)] * 3 + [(None, texts[0], "y", 7, 9), (None, None, "z", 7, 9)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int, length int").repartition(3)


def test_counts_of_odd_rows(spark):
    rows, docs = odd(spark, TEXTS)
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in count_tokens(docs, PATH).collect()), key=str)
    assert got == sorted(((r[0], len(ids(r[1]))) for r in rows), key=str)


def test_encoding_of_odd_rows(spark):
    rows, docs = odd(spark, TEXTS)
    block = build_lexicon(docs, PATH)
    got = [(r["doc_id"], bytes(r["ids"]), r["text"]) for r in decode(encode(docs, PATH, block), PATH).collect()]
    want = [(r[0], np.array(ids(r[1]), "<u4").tobytes(), LIBRARY.decode(ids(r[1]), skip_special_tokens=False)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    none = docs.limit(0)
    empty = build_lexicon(none, PATH)
    assert decode(encode(none, PATH, empty), PATH).count() == 0
    assert Lexicon(empty).find([b"the"]) == [None]


def test_packing_of_odd_rows(spark):
    rows, docs = odd(spark, TEXTS)
    got = pack_documents(docs, PATH).collect()
    want = sorted(((i, len(ids(t)) + 1) for i, t, *_ in rows), key=str)
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {i: sum(n for j, n in want if j == i) for i, _ in want}
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
