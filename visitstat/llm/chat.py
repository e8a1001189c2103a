"""Chat formatting by grammar round trip.

A conversation is the concatenation of its turns, each rendered as

    "### " role ": " text "\\n</turn>\\n"

and read by a deterministic parser. Inside a text the strings ``###`` and
``</turn>`` are control strings; a backslash before one makes it plain text,
and backslashes directly before a control string are doubled. A turn is first
rendered as it is and parsed again; where the parser does not give the same
role and text back, more of the control strings are escaped, until it does.
Texts without control strings are never changed. Turns are self-delimiting, so
parsing a conversation is parsing its turns one after the other.

The loss mask is the span of the text of each assistant turn, in code points
of the rendered turn.

Rendering and parsing work turn by turn, without grouping. Only the digests
need a conversation's turns in order: rows are dealt by conversation, sorted
inside the partition and streamed, so a conversation of any length needs no
more memory than a batch (its SHA-256 is sequential by definition).

Defined results: null texts and roles count as empty; a null conversation id is
one conversation, null turns come first, equal turns are ordered by role and
rendered text; repeated rows are turns of their own; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitstat.llm.common import batches

LOSS_ROLE = "assistant"
OPEN, MIDDLE, CLOSE = "### ", ": ", "\n</turn>\n"
CONTROLS = ("</turn>", "###")
# Escapes tried in turn; the last one always round-trips.
LEVELS = ((), CONTROLS[:1], CONTROLS)
_ROLE = {"\\": "\\\\", ":": "\\c", "\n": "\\n"}
_ANY = re.compile(r"(\\*)(###|</turn>)")


class GrammarError(ValueError):
    """The text is not a sequence of rendered turns."""


def escape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    if not controls:
        return text
    return re.sub(r"(\\*)(" + "|".join(map(re.escape, controls)) + ")", lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    """The text behind an escaped one; an unescaped control string is an error."""
    def plain(m: re.Match) -> str:
        if len(m[1]) % 2 == 0:
            raise GrammarError(f"control string {m[2]!r} inside a text")
        return m[1][:len(m[1]) // 2] + m[2]
    return _ANY.sub(plain, text)


def render(role: str, text: str, controls: tuple[str, ...]) -> tuple[str, int, int]:
    """The rendered turn and the span of its text."""
    head = OPEN + "".join(_ROLE.get(c, c) for c in role) + MIDDLE
    body = escape(text, controls)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn, the span being that of the text as rendered."""
    at = 0
    while at < len(rendered):
        middle = rendered.find(MIDDLE, at)
        if not rendered.startswith(OPEN, at) or middle < 0:
            raise GrammarError(f"no turn starts at {at}")
        start = middle + len(MIDDLE)
        role = re.sub(r"\\(.)", lambda m: {"c": ":", "n": "\n"}.get(m[1], m[1]), rendered[at + len(OPEN):middle])
        end = rendered.find(CLOSE, start)
        if end < 0:
            raise GrammarError(f"the turn at {at} does not end")
        yield role, unescape(rendered[start:end]), start, end
        at = end + len(CLOSE)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn with the fewest escapes that parses back to the same role and text."""
    for controls in LEVELS:
        out, start, end = render(role, text, controls)
        try:
            if list(parse(out)) == [(role, text, start, end)]:
                return out, start, end
        except GrammarError:
            continue
    raise GrammarError("the fully escaped turn does not round-trip")     # excluded by the grammar


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """conv_id, turn, rendered, loss_start, loss_end (null outside the mask): one row per turn."""
    empty = F.lit("")
    src = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                       F.coalesce(F.col(f"`{role}`"), empty).alias("role"), F.coalesce(F.col(f"`{text}`"), empty).alias("text"))
    schema = T.StructType([src.schema["conv_id"], src.schema["turn"], T.StructField("rendered", T.StringType()),
                           T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            roles = b["role"].to_pylist()
            got = [format_turn(r, t) for r, t in zip(roles, b["text"].to_pylist())]
            loss = [r == LOSS_ROLE for r in roles]
            yield pa.RecordBatch.from_arrays(
                [b["conv_id"], b["turn"], pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] if x else None for g, x in zip(got, loss)], pa.int64()),
                 pa.array([g[2] if x else None for g, x in zip(got, loss)], pa.int64())], [f.name for f in schema])

    return src.mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, parsed from the formatted turns: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256 and formatted_chars."""
    kind = formatted.schema["conv_id"].dataType
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()),
                           T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                           T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, state, arrow = [], None, None, None

        def flush(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], arrow), pa.array(cols[1], pa.int64()), pa.array([h.hexdigest() for h in cols[2]]),
                 pa.array(cols[3], pa.int64()), pa.array([h.hexdigest() for h in cols[4]]), pa.array(cols[5], pa.int64())],
                [f.name for f in schema])

        for b in batches(it):
            arrow = b["conv_id"].type
            for conv, out, start, end in zip(*(b[c].to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_end"))):
                if state is None or conv != key:
                    if state:
                        done.append(state)
                    key, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, *_ in parse(out):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    masked = unescape(out[start:end])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(out)
            if len(done) >= 4096:
                yield flush(done)
                done = []
        if state:
            yield flush([*done, state])

    return ordered.mapInArrow(run, schema)
