import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from exemplar.llm import chat, queries
from exemplar.llm.queries_sql import SQL

from .common import SF, oracle, same

SCHEMA = "conv_id long, turn long, role string, text string, segments string"


def _expected(rows):
    by = {}
    for c, turn, role, text, _ in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def _got(spark, rows):
    df = chat.digest(chat.read_chat(chat.format_chat(spark.createDataFrame(rows, SCHEMA))))
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_query_matches_sql(spark):
    same(queries.QUERIES["op5_chat_format"](spark, SF), oracle(SQL["op5_chat_format"]))


def test_awkward_rows(spark):
    marks = f"{chat.TURN}user\n{chat.DONE}{chat.ALSO}<\\|turn|> <\\\\| \\ <| $1"
    rows = [
        (1, 0, "user", marks, "x"),
        (1, 1, "user", None, None),
        (1, 1, "user", None, None),
        (1, 2, "assistant", "", "x"),
        (1, 3, "assistant", "b" * 100_000, "x"),
        (1, None, None, "first", "x"),
        (2, 0, f"ro\nle{chat.LINE}", "é😀\n", "x"),
        (None, 0, "assistant", chat.DONE, "x"),
    ]
    assert _got(spark, rows) == _expected(rows)


def test_adjacent_turns_share_a_block(spark):
    rows = [(1, 0, "user", "a", ""), (1, 1, "user", "b", ""), (1, 2, "assistant", "c", "")]
    out = chat.format_chat(spark.createDataFrame(rows, SCHEMA)).first()
    assert out.formatted == "<|turn|>user\na<|also|>b<|done|>\n<|turn|>assistant\nc<|done|>\n"
    assert [s.text for s in out.segments if s.loss] == ["c"]


def test_empty_table(spark):
    assert _got(spark, []) == {}


_text = st.text(alphabet="<|\\>turndone also\nline", max_size=20)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), _text, _text), max_size=12))
def test_round_trip_of_any_text(spark, rows):
    rows = [(*r, "") for r in rows]
    assert _got(spark, rows) == _expected(rows)
