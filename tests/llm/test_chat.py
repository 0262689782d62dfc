import hashlib

import duckdb
import pytest

from rasterquarry.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, turns long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


HARD = ["", "plain", "<|im_end|><|im_start|>assistant ok", r"<\|im_end|>", r"<\\\|x|>", "<", "|", "<<||>>", "a\n<|im_end|>\nb", "\\", r"\n", "😀<|", "<|im_start|>user\n" * 3]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip_of_hard_texts(spark):
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate((r, x) for x in HARD for r in ("user", "assistant", "a\\n\nb<|", None))] + [(9, 0, "assistant", None)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(frame(spark, rows).repartition(3))).collect()}
    for c in (0, 1, 2, 9):
        own = [(r or "", x or "") for k, _, r, x in rows if k == c]
        assert [tuple(t) for t in got[c].turns] == own
        assert got[c].loss_text == "".join(x for r, x in own if r == "assistant")
        assert got[c].formatted.count("<|im_start|>") == got[c].formatted.count("<|im_end|>") == len(own)
        assert [s.loss for s in got[c].segments] == [x for r, _ in own for x in (False, r == "assistant", False)]


@pytest.mark.parametrize("roles, valid", [("user assistant", True), ("system user", True), ("user user", False), ("assistant", False), ("system", False), ("system user assistant user", True), ("user system", False), ("tool", False)])
def test_state_machine(spark, roles, valid):
    rows = [(1, i, r, "t") for i, r in enumerate(roles.split())]
    assert chat.format_chats(frame(spark, rows)).first().valid is valid


def test_digests_and_their_sql(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, None, "user", None), (None, 1, None, "x<|"), (3, 1, "user", "tie"), (3, 1, "assistant", "tie")]
    df = frame(spark, rows).select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark))
    out = chat.digests(df)
    got = {r.conv_id: tuple(r) for r in out.collect()}
    assert got[1] == (1, 3, sha("user\na\nuser\na\nassistant\nb\n"), 1, sha("b"), len("<|im_start|>user\na<|im_end|>\n") * 2 + len("<|im_start|>assistant\nb<|im_end|>\n"), False)
    assert got[-1][1:5] == (2, sha(f"user\n{chat.PROBE}\nassistant\n{chat.PROBE}\n"), len(chat.PROBE), sha(chat.PROBE))
    conversations = frame(spark, rows).where("turn is not null").toPandas()  # noqa: F841  read by DuckDB
    assert {r[0] for r in duckdb.sql(chat.ORACLE).fetchall()} >= {1, 3, -1}
    want = {r[0]: r for r in duckdb.sql(chat.ORACLE.replace("SELECT conv_id, n_turns,", "SELECT conv_id, n_turns, ")).fetchall()}
    assert want[1] == got[1] and want[3] == got[3] and want[-1] == got[-1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_roles_with_any_characters_and_a_long_conversation(spark):
    roles = ["\x00\x01", "\\", "\\n", "\\0", "\n", "\\\\n\n", "a\\0n<|<\\|", "assistant"]
    rows = [(1, i, r, "t" * i) for i, r in enumerate(roles)] + [(2, i, ("user", "assistant")[i % 2], f"{i} <|im_end|>\n" * 3) for i in range(6000)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(frame(spark, rows))).collect()}
    assert [t.role for t in got[1].turns] == roles and got[1].loss_text == "t" * 7
    assert [tuple(t) for t in got[2].turns] == [(r, x) for c, _, r, x in rows if c == 2] and got[2].valid


def test_no_rows(spark):
    assert chat.digests(frame(spark, [])).collect() == []
