"""Divergence of sources against plain counting with Python's integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from larkspur.llm import divergence
from larkspur.llm.divergence import far, group_slices, share, slices, source_divergence, xxh64

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, top=200):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = [w.translate(LOWER) for w in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for lang in {lang for lang, _ in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for la, s in counts if la == lang)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 1) // (sum(total.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, o, -v, i + 1) for i, (v, _, o) in enumerate(found)}
    return out


def corpus(n=160):
    rng = random.Random(5)
    words = ["the", "The", "öl", "ÖL", "straße", "x", "日本語", "a" * 31, "b" * 32, "c" * 45, "naïve", "no-one", "KK", "é"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(6)]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "en", "de", None, "zz"]), rng.choice(["s1", "s1", "s2", "s3", None, "é"])
        rows.append(("".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "1", "\x00", "@[`{\x7f"]) for _ in range(rng.randrange(40))), lang, source))
    return [*rows, (None, "en", "none"), ("", "only", "a"), ("!!", "only", "b"), ("once", "only", "c"), *[rows[0]] * 60]


def test_xxh64_is_the_library_s():
    rng = np.random.default_rng(0)
    raw = np.concatenate([rng.integers(0, 256, 3000).astype(np.uint8), np.zeros(8, np.uint8)])
    start, size = rng.integers(0, 2900, 2000), rng.integers(0, 80, 2000)
    assert xxh64(raw, start, size).tolist() == [xxhash.xxh64_intdigest(raw[a : a + n].tobytes()) for a, n in zip(start, size, strict=True)]


def test_slices_that_collide_are_told_apart():
    """With a hash of four values, groups are still those of equal bytes, and counts are of texts."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ab", "abc", "b", "abcdefghij", "abcdefghik", "日"]) for _ in range(20)).encode() for _ in range(30)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    data = divergence.TABLE[raw]
    start, size = slices(data, np.cumsum([0, *map(len, texts[:-1])]))
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    of = np.searchsorted(np.cumsum([*map(len, texts)]), start, side="right") % 3
    for hashes in (xxh64, lambda d, s, n: (n % 4).astype(np.uint64), lambda d, s, n: np.zeros(len(s), np.uint64)):
        order, at = group_slices(data, start, size, of, hashes)
        ends = [*at[1:], len(order)]
        name = lambda i: (int(of[i]), data[start[i] : start[i] + size[i]].tobytes())
        groups = [[name(i) for i in order[a:z]] for a, z in zip(at, ends, strict=True)]
        assert all(len(set(g)) == 1 for g in groups) and len({g[0] for g in groups}) == len(groups) and sorted(order) == list(range(len(start)))
        for a, z in zip(at, ends, strict=True):
            assert list(order[a:z]) == sorted(order[a:z])


def test_shares_beyond_64_bits():
    rng = random.Random(1)
    for _ in range(300):
        total = rng.randrange(1, 9 * 10**15)
        count = rng.randrange(1, total + 1)
        assert int(share(np.array([count]), total)[0]) == 1 + 10**9 * count // total
    assert far(np.array([10**9 + 1]), np.array([1])).tolist() == [10**18]


def test_equal_to_plain_counting(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n long, term string")
    for sizes in ({}, {"chunk": 50, "entries": 7}, {"top": 3}):
        got = [tuple(r) for r in source_divergence(df, **sizes).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows, top=sizes.get("top", 200))
    assert {r[4] for r in got if r[0] == "only"} == {0}
    assert source_divergence(df.limit(0)).collect() == []
