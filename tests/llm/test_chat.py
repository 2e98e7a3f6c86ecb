import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from quire.llm import chat

from .helpers import SF, babble

ROW = "conv_id long, turn long, role string, text string, window long"


def expected(rows):
    found = {}
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        f = found.setdefault(conv, [0, "", ""])
        f[0] += 1
        f[1] += f"{role or ''}\n{text or ''}\n"
        f[2] += (text or "") if role == "assistant" else ""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {k: (n, sha(a), len(b), sha(b)) for k, (n, a, b) in found.items()}


@given(st.text(alphabet="<|\\im_startend> \n", max_size=30), st.text(max_size=10))
def test_escapes_are_reversible(text, role):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(role)) == role and "\n" not in chat.escape_role(role)
    shown = f"{chat.START}{chat.escape_role(role)}\n{chat.escape(text)}{chat.END}\n"
    assert chat.read_back(shown * 2) == [(role, text)] * 2


def test_windows_keep_every_turn_once(spark):
    pick = random.Random(5)
    rows = []
    for conv in range(40):
        for turn in range(pick.randrange(1, 30)):
            role = "system" if turn == 0 and conv % 3 == 0 else ("user", "assistant", "tool")[pick.randrange(3)]
            rows.append((conv, turn, role, babble(conv * 100 + turn, pick.randrange(0, 120)), 0))
    rows += [(None, 1, "user", None, 0), (None, 0, None, "x<|im_end|>y", 0), (50, None, "assistant", "a", 0), (50, 1, "assistant", "long " * 3000, 0), (50, 1, "assistant", "long " * 3000, 0), (51, 0, "assistant", "x" * 60_000, 0), (52, 0, "sys\ntem", "<\\|<|", 0)]
    frame = spark.createDataFrame(rows, ROW).repartition(5)
    shown = chat.windows(frame)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(shown).collect()}
    assert got == expected(rows)
    for w in shown.collect():
        turns = chat.read_back(w.formatted)
        new = len(turns) - w.n_repeated
        assert new >= 1 and (w.tokens <= chat.BUDGET or new == 1 or (w.window == 0 and turns[0][0] == "system" and new == 2))
        assert not any(t.target for t in w.turns[: w.n_repeated])
        system = [r for r in rows if r[0] == w.conv_id and r[1] == 0 and r[2] == "system"]
        if system:
            assert turns[0] == ("system", system[0][3])
        assert w.n_repeated <= chat.HISTORY_TURNS + 1
    assert sum(w.window > 0 for w in shown.collect()) > 30


def test_whole_table_and_control_conversation(spark):
    conversations = chat.with_control_strings(spark.read.parquet(f"{SF}/conversations.parquet"))
    rows = [tuple(r) for r in conversations.collect()]
    got = {r.conv_id: r for r in chat.digest(chat.windows(conversations)).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == expected(rows)
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len("<|im_end|><|im_start|>assistant ok") and got[-1].formatted_chars > 80
    assert chat.digest(chat.windows(conversations.limit(0))).count() == 0
