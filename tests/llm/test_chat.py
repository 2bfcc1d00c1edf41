import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barline.llm import chat

TEXT = st.lists(st.sampled_from([*"ab\\#:< /turn>\n", "</turn>\n", "### ", ": "]), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), TEXT), TEXT), max_size=6))
def test_template_is_reversible_and_mask_exact(turns):
    x = chat.format_turns(turns)
    assert not x["rewritten"] and chat.parse(x["formatted"]) == turns
    assert [chat.unescape(x["formatted"][a:b]) for a, b in x["loss_spans"]] == [t for r, t in turns if r == "assistant"]
    assert [chat.parse(x["formatted"][a:b]) for a, b in x["turn_spans"]] == [[t] for t in turns]


def test_rewriting_template_is_detected():
    def drops_old(turns, prompt=False):
        return "".join(f"<{r}>{t if k >= len(turns) - 2 else '...'}" for k, (r, t) in enumerate(turns)) + "<assistant>" * prompt

    assert chat.format_turns([("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")], drops_old)["rewritten"]


def late_rewriter(turns, prompt=False):
    """Rewrites its first turn while it renders 65 to 70 turns, and no longer after that."""
    return "".join(f"<{r}>{'...' if k == 0 and 65 <= len(turns) <= 70 else t}" for k, (r, t) in enumerate(turns)) + "<assistant>" * prompt


def test_rewrite_in_some_long_prefix_only_is_detected():
    turns = [("user" if k % 2 == 0 else "assistant", f"text {k}") for k in range(100)]
    assert late_rewriter(turns) == "".join(f"<{r}>{t}" for r, t in turns)
    assert chat.format_turns(turns, late_rewriter)["rewritten"] and not chat.format_turns(turns[:64], late_rewriter)["rewritten"]


@pytest.mark.parametrize("n", [63, 64, 65, 129, 1500])
def test_any_length(n):
    turns = [("user" if k % 2 else "assistant", f"text {k} \\#" * (k % 5)) for k in range(n)]
    x = chat.format_turns(turns)
    assert chat.parse(x["formatted"]) == turns and len(x["turn_spans"]) == n
    assert [chat.unescape(x["formatted"][a:b]) for a, b in x["loss_spans"]] == [t for r, t in turns if r == "assistant"]


def test_cache_forgets(monkeypatch):
    monkeypatch.setattr(chat, "KEPT_CHARS", 500)
    turns = [("assistant", f"{k}: <") for k in range(200)]
    assert chat.parse(chat.format_turns(turns)["formatted"]) == turns and len(chat._lines) < 20


def test_empty_table_and_probe_id(spark, tmp_path):
    """An empty table gives conversation -7 alone; turns that a table already holds under -7 join it."""
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/e/conversations.parquet")
    assert [(r.conv_id, r.n_turns) for r in chat.op5_chat(spark, f"{tmp_path}/e").collect()] == [(-7, 2)]
    spark.createDataFrame([(-7, 2, "user", "more")], schema).write.parquet(f"{tmp_path}/p/conversations.parquet")
    assert [(r.conv_id, r.n_turns) for r in chat.op5_chat(spark, f"{tmp_path}/p").collect()] == [(-7, 3)]


def test_query(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 1, "assistant", "é\\n"), (2, 0, "system", "x"), (None, 0, "user", "q"), (3, None, None, "first"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, n_turns string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in chat.op5_chat(spark, str(tmp_path)).collect()}
    want = {}
    for c in (1, 2, 3, None, -7):
        own = sorted([(-1 if t is None else t, r or "", x or "") for d, t, r, x in [*rows, *chat.PROBE] if d == c])
        learned = "".join(x for _, r, x in own if r == "assistant")
        want[c] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(chat.render([(r, x) for _, r, x in own])))
    assert got == want
