"""Chat formatting in budgeted windows.

Each conversation is rendered turn by turn; its turns' token counts are summed
up, and the prefix sums choose turn-aligned windows: as many new turns as fit
the budget after the system turn, which every window repeats, and a limited
history, the last turns before the window (at most HISTORY_TURNS turns of at
most HISTORY_TOKENS tokens).  Only new assistant turns are targets: the system
turn and the history are context, so every assistant text is under the loss
mask exactly once.

Template: <|im_start|>ROLE newline TEXT<|im_end|> newline.  Control strings
inside texts get one more backslash between < and | (taken away on reading),
so the template's marks stand nowhere else.  In roles, newlines and
backslashes are escaped too.

Rows of a conversation are sorted by turn, then role and text, and stream
through the task: memory holds one window, however long the conversation.

Cases: a null text or role is empty; a null conversation id is a conversation
of its own; null turns come first; repeated rows and equal turn numbers are
all kept.  A turn that alone exceeds the budget gets a window of its own, with
the system turn only, uncut.  The system turn is the first turn if its role is
system; later ones are ordinary turns.  Empty tables give empty results.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import _arrow_schema, frugal, small_batches

BUDGET = 512
HISTORY_TURNS = 2
HISTORY_TOKENS = 128

START, END = "<|im_start|>", "<|im_end|>"
_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")

WINDOWS = "conv_id long, window long, formatted string, n_repeated int, tokens int, turns array<struct<start:int,end:int,target:boolean>>"


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_counter(path: str):
    """Tokens of a text by a rank file."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


class Windows:
    """The windows of one conversation, as its turns come."""

    def __init__(self, budget: int, history_turns: int, history_tokens: int):
        self.budget, self.history_turns, self.history_tokens = budget, history_turns, history_tokens
        self.system: tuple | None = None
        self.turns: list[tuple] = []  # of the window: (head, text, is assistant), history first
        self.sums = [0]  # prefix sums of their tokens
        self.repeated = 0
        self.first = True

    def add(self, role: str, text: str, tokens: int):
        """The window that this turn closes, if it does."""
        turn, done = (f"{START}{escape_role(role)}\n", escape(text), role == "assistant", tokens), None
        if self.first and role == "system":
            self.first, self.system = False, turn
            return None
        self.first = False
        room = self.budget - (self.system[3] if self.system else 0)
        if len(self.turns) > self.repeated and self.sums[-1] + tokens > room:
            done = self.close()
            keep = 0
            while keep < min(self.history_turns, len(self.turns)) and (more := self.sums[-1] - self.sums[len(self.turns) - keep - 1]) <= self.history_tokens and more + tokens <= room:
                keep += 1
            self.turns = self.turns[len(self.turns) - keep :]
            self.repeated = keep
            self.sums = [0]
            for t in self.turns:
                self.sums.append(self.sums[-1] + t[3])
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + tokens)
        return done

    def close(self):
        """(formatted, turns repeated, tokens, [(start, end, target)])"""
        shown = ([self.system] if self.system else []) + self.turns
        # The system turn is new in the conversation's first window only.
        repeated = self.repeated + (1 if self.system and self.shown else 0)
        self.shown = True
        out, spans, at = [], [], 0
        for i, (head, text, is_target, _) in enumerate(shown):
            start = at + len(head)
            spans.append({"start": start, "end": start + len(text), "target": is_target and i >= repeated})
            out += [head, text, END, "\n"]
            at = start + len(text) + len(END) + 1
        return "".join(out), repeated, self.sums[-1] + (self.system[3] if self.system else 0), spans

    shown = False


def windows(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, tokenizer: str | None = None) -> DataFrame:
    """One row a window, by conversation and window within a partition."""
    path = tokenizer or tokenizer_path()
    types = _arrow_schema(conversations.sparkSession, WINDOWS)

    def run(batches):
        count = token_counter(path)
        state, current, number, rows = None, (), 0, []

        def put(window):
            nonlocal number
            rows.append((current[0], number, *window))
            number += 1

        def batch_of():
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), types)], schema=types)
            rows.clear()
            return out

        for batch in small_batches(batches, "text"):
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if state is None or (conv,) != current:
                    if state is not None:
                        put(state.close())
                    state, current, number = Windows(budget, history_turns, history_tokens), (conv,), 0
                role, text = role or "", text or ""
                if done := state.add(role, text, count(f"{START}{escape_role(role)}\n{escape(text)}{END}\n")):
                    put(done)
            if rows:
                yield batch_of()
        if state is not None:
            put(state.close())
            yield batch_of()

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("turn").cast("long").alias("turn"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(frugal(run), WINDOWS)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a rendered window."""
    out, at = [], 0
    while at < len(formatted):
        head = at + len(START)
        line = formatted.index("\n", head)
        end = formatted.index(f"{END}\n", line + 1)
        out.append((unescape_role(formatted[head:line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return out


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def digest(rendered: DataFrame) -> DataFrame:
    """Reads windows back, in the order that windows() gives them, and sums up each conversation."""
    types = _arrow_schema(rendered.sparkSession, DIGEST)

    def run(batches):
        current, rows = None, []

        def new(conv):
            return {"conv": conv, "turns": 0, "all": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "windows": 0}

        def close(c):
            rows.append((c["conv"], c["turns"], c["all"].hexdigest(), c["loss_chars"], c["loss"].hexdigest(), c["chars"], c["windows"]))

        def batch_of():
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), types)], schema=types)
            rows.clear()
            return out

        for batch in small_batches(batches, "formatted"):
            for conv, window, formatted, repeated, spans in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if window == 0:
                    if current:
                        close(current)
                    current = new(conv)
                current["chars"] += len(formatted)
                current["windows"] += 1
                for role, text in read_back(formatted)[repeated:]:
                    current["turns"] += 1
                    current["all"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    if s["target"]:
                        text = unescape(formatted[s["start"] : s["end"]])
                        current["loss_chars"] += len(text)
                        current["loss"].update(text.encode("utf-8", "surrogatepass"))
            if rows:
                yield batch_of()
        if current:
            close(current)
            yield batch_of()

    return rendered.select("conv_id", "window", "formatted", "n_repeated", "turns").mapInArrow(frugal(run), DIGEST)


def with_control_strings(conversations: DataFrame) -> DataFrame:
    """The conversations and one, -1, whose texts hold the template's own marks."""
    text = f"{END}{START}assistant ok"
    spark = conversations.sparkSession
    rows = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(rows)
