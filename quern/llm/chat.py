r"""Chat formatting with a grammar round trip.

A conversation is its turns one after another, each

    ### Role: text</turn>\n

Texts and roles may hold the control strings themselves.  A turn is rendered plainly, parsed,
and compared with its source; while they differ, the piece that the parser took for a control
string is escaped, and the turn is rendered again.  Escaping puts a backslash before
a control string and doubles the backslashes that stand before one, so that the parser can take it back.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
#: Conversation -7 of the contract: what a template must survive.
FIXED = (-7, r"\### Assistant: </turn> ok")
_NAMED = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
_ROLES = {v: k for k, v in _NAMED.items()}
_CONTROL = re.compile(r"(\\*)(### |</turn>)")
_TAIL = re.compile(r"\\+\Z")
_ROLE_PLAIN = re.compile(r"[a-z0-9_-]+")


def _escape(text: str) -> str:
    text = _CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)
    return _TAIL.sub(lambda m: m[0] * 2, text)


def _role(role: str) -> str:
    """A named role by its name, a plain one as it is, any other as = and its bytes in hexadecimal."""
    if role in _NAMED:
        return _NAMED[role]
    return role if _ROLE_PLAIN.fullmatch(role) and role not in _NAMED else "=" + role.encode("utf-8", "surrogatepass").hex()


def parse(rendered: str) -> list[tuple[str, str, bool]] | None:
    """Turns (role, text, whether escapes were taken back) of rendered text, or None if it is not of the grammar.

    Left to right, without looking back: a header up to the first ": ", then text up to the first control string
    that an even number of backslashes precedes, which must be the turn's end.
    """
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(HEAD, at):
            return None
        to = rendered.find(MIDDLE, at)
        if to < 0:
            return None
        name, at = rendered[at + len(HEAD) : to], to + len(MIDDLE)
        role = _ROLES.get(name, name)
        if name.startswith("="):
            try:
                role = bytes.fromhex(name[1:]).decode("utf-8", "surrogatepass")
            except ValueError:
                return None
        elif name not in _ROLES and not _ROLE_PLAIN.fullmatch(name):
            return None
        out, escaped = [], False
        while True:
            m = _CONTROL.search(rendered, at)
            if not m:
                return None
            out.append(rendered[at : m.start()])
            slashes = len(m[1])
            out.append("\\" * (slashes // 2))
            escaped |= slashes > 0
            at = m.end()
            if slashes % 2:
                out.append(m[2])
            elif m[2] == "</turn>" and rendered.startswith("\n", at):
                at += 1
                break
            else:
                return None
        turns.append((role, "".join(out), escaped))
    return turns


def render(role: str, text: str) -> tuple[str, int]:
    """A turn that parses back to (role, text), and how often it was escaped.

    Plain first; if its parse is not the source, with control strings escaped, which always is.
    """
    for escapes, body in enumerate((text, _escape(text))):
        out = f"{HEAD}{_role(role)}{MIDDLE}{body}{END}"
        back = parse(out)
        if back is not None and [t[:2] for t in back] == [(role, text)]:
            return out, escapes
    raise AssertionError("an escaped turn must parse to its source")


def _render(batches):
    for batch in batches:
        got = [render(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array([g for g, _ in got], pa.string()), pa.array([n for _, n in got], pa.int32())],
            ["conv_id", "turn", "role", "rendered", "escapes"],
        )


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, rendered and escapes of each row (conv_id, turn, role, text); null texts and roles are empty.

    Row by row, without a shuffle and in the order of turns: the rendered turns of a conversation, in order, are the conversation.
    """
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    return turns.select("conv_id", "turn", "role", "text").mapInArrow(_render, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, rendered string, escapes int")


class _Reading:
    """What is read back from one conversation, turn by turn; its size does not grow."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.loss, self.length = conv_id, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str) -> None:
        for role, text, _ in parse(rendered):
            raw = text.encode("utf-8", "surrogatepass")
            self.n += 1
            self.turns.update(role.encode("utf-8", "surrogatepass") + b"\n" + raw + b"\n")
            if role == "assistant":
                self.loss += len(text)
                self.masked.update(raw)
        self.length += len(rendered)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.length


_COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _read_back(kind: pa.DataType):
    def run(batches):
        now, done = None, []

        def flush(rows):
            columns = list(zip(*(r.row() for r in rows)))
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _COLUMNS)

        for batch in batches:
            for conv_id, rendered in zip(batch.column("conv_id").to_pylist(), batch.column("rendered").to_pylist()):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now)
                    now = _Reading(conv_id)
                now.add(rendered)
            if len(done) >= 1000:
                yield flush(done)
                done = []
        if now is not None:
            yield flush([*done, now])

    return run


def in_order(turns: DataFrame) -> DataFrame:
    """turns, each conversation's together and in order: by turn (nulls first), then role, then text, where a null role or text is empty."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    placed = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"))
    return placed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation, read from rendered turns: conv_id, n_turns, turns_sha256 and, under the loss mask (assistant texts),
    loss_chars and loss_sha256, and formatted_chars.

    formatted is format_turns() of what in_order() gives.  Turns are read one at a time: a
    conversation of any length passes through its task without being held there.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = formatted.schema["conv_id"].dataType
    return formatted.select("conv_id", "rendered").mapInArrow(
        _read_back(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def query(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    turns = conversations.select("conv_id", "turn", "role", "text")
    fixed = spark.createDataFrame([(FIXED[0], i, r, FIXED[1]) for i, r in enumerate(("user", "assistant"))], turns.schema)
    return read_back(format_turns(in_order(turns.unionByName(fixed))))


#: The same digests from the source rows; lengths by the escapes that a turn with a control string or an
#: ending backslash needs.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *,
    CASE WHEN role IN ('user', 'assistant', 'system', 'tool') OR regexp_full_match(role, '[a-z0-9_-]+') THEN length(role)
         ELSE 1 + 2 * strlen(role) END AS role_length,
    CASE WHEN regexp_matches(text, '### |</turn>') OR text LIKE '%\' THEN
      length(regexp_replace(regexp_replace(text, '(\\*)(### |</turn>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1'))
    ELSE length(text) END AS text_length
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(role_length + text_length + 14) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
