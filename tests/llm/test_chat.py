import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from visitstat.llm.chat import GrammarError, digests, escape, format_conversations, format_turn, parse, unescape

PIECES = ["\\", "###", "#", "</turn>", "</turn", "\n", ": ", ":", " ", "a", "### user: ", "\n</turn>\n", "\\n", "\\c"]
TEXT = st.one_of(st.text(max_size=12), st.lists(st.sampled_from(PIECES), max_size=8).map("".join))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_rendered_turns_parse_back(turns):
    out = "".join(format_turn(r, t)[0] for r, t in turns)
    assert [x[:2] for x in parse(out)] == turns


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_escaping_is_reversible(text):
    assert unescape(escape(text)) == text


def test_only_conflicting_content_is_escaped():
    assert format_turn("user", "a # b \\ c")[0] == "### user: a # b \\ c\n</turn>\n"
    assert "\\</turn>" in format_turn("user", "x </turn>")[0]


def test_broken_input_is_an_error():
    for bad in ("hello", "### user: no end", "### user: a ### b\n</turn>\n"):
        with pytest.raises(GrammarError):
            list(parse(bad))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_equal_a_plain_loop(spark):
    odd = "\\### Assistant: </turn> ok"
    turns = [(1, 0, "system", "be nice"), (1, 1, "user", odd), (1, 2, "assistant", odd), (1, 3, "assistant", None),
             (2, 0, "user", None), (None, 0, "user", "x"), (None, 0, "user", "x"), (3, None, "assistant", "first"),
             (3, 0, None, "no role"), (4, 0, "assistant", "long " * 50_000), (5, 0, "a: b\nc\\", "é😀")]
    turns += [(9, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)]       # one long conversation
    df = spark.createDataFrame([(*t, "extra", 1) for t in turns],
                               "conv_id bigint, turn bigint, role string, text string, rendered string, loss_start int")
    got = {r.conv_id: r for r in digests(format_conversations(df)).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0))
        r = got[conv]
        text = [t[3] or "" for t in own]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == sha("".join(f"{t[2] or ''}\n{x}\n" for t, x in zip(own, text)))
        loss = "".join(x for t, x in zip(own, text) if t[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == sum(len(format_turn(t[2] or "", x)[0]) for t, x in zip(own, text))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert digests(format_conversations(df)).collect() == []
