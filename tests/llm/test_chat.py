"""Rendering, spans and exact round trips."""

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from larkspur.llm.chat import CONTROLS, digest_conversations, escape, format_conversation, format_conversations, marked_template, parse_marked, spans, unescape

PIECES = st.lists(st.one_of(st.sampled_from([*CONTROLS, "\\", "<", "[", "s>", " ", "\n", "probe"]), st.text(max_size=4)), max_size=8).map("".join)


@given(PIECES)
def test_escaping_is_reversible(text):
    out = escape(text)
    assert unescape(out) == text
    assert not any(c in out for c in CONTROLS)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "</s>"]), PIECES), max_size=5))
def test_round_trip(turns):
    r = format_conversation(turns)
    assert [parse_marked(r["formatted"][a:b]) for a, b in r["spans"]] == turns
    assert "".join(unescape(r["formatted"][a:b]) for a, b in r["mask"]) == "".join(t for role, t in turns if role == "assistant")
    assert r["rewrites"] == []


def test_templates_that_rewrite_history():
    def forgetful(turns):
        return "".join(f"{r}: {t if k == len(turns) - 1 else '...'}\n" for k, (r, t) in enumerate(turns))

    out, found, rewrites = spans(forgetful, [("u", "one"), ("a", "two"), ("u", "three")])
    assert rewrites == [1, 2]
    assert out == "u: ...\na: ...\nu: three\n"
    assert found[-1][1] == len(out)
    assert format_conversation([("user", "x"), ("assistant", "y"), ("user", "z")], forgetful)["mask"] == []


def test_conversations(spark):
    x = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", x), (-7, 1, "assistant", x), (1, 1, "assistant", None), (1, 0, "user", "hi"), (2, 0, None, ""), (3, None, "assistant", "a"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (4, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in digest_conversations(format_conversations(df)).collect()}
    assert set(got) == {-7, 1, 2, 3, 4}
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{x}\nassistant\n{x}\n".encode()).hexdigest()
    assert got[-7]["loss_sha256"] == hashlib.sha256(x.encode()).hexdigest() and got[-7]["loss_chars"] == len(x)
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\n\n").hexdigest()
    assert got[3]["loss_chars"] == 3 and got[3]["n_turns"] == 3
    assert got[4]["loss_chars"] == 250_000
    assert format_conversations(df.limit(0)).count() == 0
    assert marked_template([]) == ""
