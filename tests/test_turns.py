"""One turn over a table of chats: order of prompts, summaries, failures and new sessions."""

import pytest

from askspark.plans.turns import take_turns

CHAT = "conv_id bigint, turn bigint, role string, text string"


def reply(prompts):
    if prompts.str.contains("break").any():
        raise ValueError("404 not found")
    return prompts.map(lambda p: "" if "silence" in p else f"  seen {p.count(chr(10))} lines ")


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(12)] + [(2, 4, "system", None), (2, 5, "user", "hello"), (9, 0, "user", "old")]
    sessions = [(1, "Plans", "a.pdf", "2024-01-01", "2024-01-02", "before"), (2, "New Session", None, "2024-01-03", None, None), (9, "Other", None, "x", "y", "z")]
    prompts = [
        (1, 2, "later"), (1, 1, "and now?"), (2, 1, "please break it"), (3, 1, "a prompt that begins a chat"), (4, 1, "x" * 200_001), (4, 2, "silence"),
        (None, 1, "lost"), (5, 1, None), (1, 2, "later too"),
    ]
    return take_turns(
        spark.createDataFrame(sessions, "session_id bigint, title string, file_metadata string, created_at string, updated_at string, summary string"),
        spark.createDataFrame(rows, CHAT), spark.createDataFrame(prompts, "conv_id bigint, version bigint, prompt string"), "2024-02-01", reply,
    )


def test_prompts_and_answers_take_the_next_positions(turns):
    # chat 1: one line break of the layout, seven in the summary, two of the layout, five between six recent turns
    assert sorted(map(tuple, turns.added.collect())) == [
        (1, 12, "user", "and now?"), (1, 13, "assistant", "seen 15 lines"), (2, 6, "user", "please break it"),
        (2, 7, "assistant", "❌ Pipeline Error: not_found"), (3, 0, "user", "a prompt that begins a chat"),
        (3, 1, "assistant", "seen 3 lines"), (4, 0, "user", "silence"), (4, 1, "assistant", "⚠️ No response generated."),
    ]


def test_what_is_not_asked_is_returned(turns):
    assert sorted((r.conv_id, r.version, r.prompt) for r in turns.waiting.collect()) == [(1, 2, "later"), (1, 2, "later too")]
    assert [(r.conv_id, r.version) for r in turns.refused.collect()] == [(4, 1)]


def test_sessions_move_on(turns):
    got = {r.session_id: r for r in turns.sessions.collect()}
    assert sorted(got) == [1, 2, 3, 4, 9]
    assert got[9].summary == "z" and got[9].updated_at == "y"
    assert got[1].title == "Plans" and got[1].created_at == "2024-01-01" and got[1].updated_at == "2024-02-01"
    assert got[1].summary == "before\n" + "\n".join(f"[{'USER' if i % 2 == 0 else 'ASSISTANT'}]: t{i}" for i in range(7))
    assert got[2].title == "please break it" and got[2].summary == ""
    assert got[3].title == "a prompt that begi" and got[3].created_at == "2024-02-01"


def test_no_prompts_change_nothing(spark, turns):
    chats = spark.createDataFrame([(1, 0, "user", "a")], CHAT)
    none = take_turns(turns.sessions, chats, spark.createDataFrame([], "conv_id bigint, version bigint, prompt string"), "2024-03-01", reply)
    assert none.added.count() == 0 and none.sessions.count() == 5
