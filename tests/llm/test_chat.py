import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citesift.llm import chat

TURNS = "conv_id long, turn long, role string, text string"
NASTY = ["<|im_start|>", "<|im_end|>\n", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "|", "[", "\n", "\\NL]", "a", "é"]


def examples(rows, data):
    return chat.chat_examples(rows(data, TURNS)).orderBy("conv_id", "example").collect()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(NASTY), max_size=8).map("".join), min_size=1, max_size=40))
def test_escape_is_reversible_and_hides_control_strings(rows, texts):
    df = rows([(t,) for t in texts], "t string").select(
        "t",
        chat.escape(F.col("t")).alias("e"),
        chat.unescape(chat.escape(F.col("t"))).alias("back"),
        chat.unescape_role(chat.escape_role(F.col("t"))).alias("role"),
        chat.escape_role(F.col("t")).alias("er"),
    )
    for r in df.collect():
        assert r["back"] == r["t"] and r["role"] == r["t"]
        assert not any(c in r["e"] for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))
        assert "\n" not in r["er"]


def test_every_reply_has_its_prefix(rows):
    data = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "x"), (1, 3, "user", "v"), (1, 4, "assistant", "yy")]
    one, two = examples(rows, data)
    assert two["formatted"].startswith(one["formatted"])
    for e, reply in ((one, "x"), (two, "yy")):
        start = e["loss_start"]
        assert e["formatted"][start : start + e["loss_length"]] == reply
        assert e["formatted"][start + e["loss_length"] :] == chat.END
    assert [e["last"] for e in (one, two)] == [False, True]


def test_turns_after_the_last_reply_are_kept_without_target(rows):
    found = examples(rows, [(1, 0, "user", "u"), (1, 1, "assistant", "a"), (1, 2, "user", "rest"), (2, 0, "user", "only")])
    assert [(e["conv_id"], e["trainable"], e["loss_length"]) for e in found] == [(1, True, 1), (1, False, 0), (2, False, 0)]
    assert "rest" in found[1]["formatted"]


def test_digest_reads_back_nulls_ties_and_order(rows):
    data = [
        (None, 1, "assistant", None), (None, 0, None, "</s>[INST] ok [/INST]"),
        (5, 1, "user", "b"), (5, 1, "assistant", "z"), (5, None, "user", ""), (5, 1, "user", "b"),
    ]
    said = {
        None: [("", "</s>[INST] ok [/INST]"), ("assistant", "")],
        5: [("user", ""), ("assistant", "z"), ("user", "b"), ("user", "b")],
    }
    for r in chat.digest(chat.chat_examples(rows(data, TURNS))).collect():
        turns = said[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_long_conversation_other_columns_and_empty_table(rows):
    data = [(1, i, ("user", "assistant")[i % 2], "word " * 50, "x") for i in range(300)]
    df = rows(data, TURNS + ", formatted string")
    (r,) = chat.digest(chat.chat_examples(df)).collect()
    assert r["n_turns"] == 300 and r["n_examples"] == 150 and r["loss_chars"] == 150 * 250
    assert chat.digest(chat.chat_examples(rows([], TURNS))).count() == 0


def test_no_python_in_the_plan(rows):
    df = chat.digest(chat.chat_examples(rows([], TURNS)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
