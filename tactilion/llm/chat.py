"""Chat formatting: a finite-state machine over roles and a declarative template.

The template gives each role a head, a tail and a loss flag. Control strings and the escape character inside
texts are escaped, so the formatted conversation can be read back without loss. Every turn is formatted;
the machine's verdict is a column of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactilion.llm.common import arrow_limit


@dataclass(frozen=True)
class Template:
    """``head`` and ``tail`` mark a turn; ``{role}`` is the escaped role. ``loss`` names the roles that are trained on."""

    head: str = "### {role}: "
    tail: str = "</turn>\n"
    names: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"), ("tool", "Tool"))
    loss: tuple[str, ...] = ("assistant",)
    escape: str = "\\"
    control: tuple[str, ...] = ("###", "</turn>", ": ")
    #: Allowed steps of the machine: state (the last role) to the roles that may follow.
    steps: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("", ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user", "tool")), ("tool", ("assistant", "tool")),
    )
    final: tuple[str, ...] = ("assistant",)

    def guard(self, text: str) -> str:
        """``text`` with the escape character doubled and put before the first character of each control string."""
        marks = "|".join(re.escape(c) for c in (self.escape, *self.control))
        return re.sub(marks, lambda m: self.escape + m[0], text)

    def unguard(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Text segments of a turn, each with its loss flag."""
        trained = role in self.loss
        return [(self.head.replace("{role}", self.name(role)), False), (self.guard(text), trained), (self.tail, False)]

    def name(self, role: str) -> str:
        """What stands for a role in the head; a role that is spelled like another's name is escaped."""
        marks = {k: self.guard(v) for k, v in self.names}
        if role in marks:
            return marks[role]
        own = self.guard(role)
        return self.escape + own if own in marks.values() else own

    def turns(self, text: str) -> tuple[list[tuple[str, str]], str]:
        """Roles and texts of the whole turns at the start of ``text``, and the rest."""
        turn, role_of = _reader(self)
        out, at = [], 0
        while m := turn.match(text, at):
            out.append((role_of[m[1]] if m[1] in role_of else self.unguard(m[1]), self.unguard(m[2])))
            at = m.end()
        return out, text[at:]

    def read(self, text: str) -> list[tuple[str, str]]:
        """Roles and texts of a formatted conversation."""
        out, rest = self.turns(text)
        if rest:
            raise ValueError(f"no turn at {len(text) - len(rest)}")
        return out


@lru_cache(16)
def _reader(t: Template) -> tuple[re.Pattern, dict[str, str]]:
    before, after = t.head.split("{role}")
    e = re.escape(t.escape)
    body = rf"((?:{e}.|[^{e}])*?)"
    return re.compile(re.escape(before) + body + re.escape(after) + body + re.escape(t.tail), re.S), {t.guard(v): k for k, v in t.names}


DEFAULT = Template()


@dataclass
class _Conversation:
    template: Template
    key: int | None
    turns: int = 0
    added: int = 0
    loss_chars: int = 0
    formatted_chars: int = 0
    segments: int = 0
    state: str = ""
    bad_turn: int | None = None
    unread: str = ""
    all: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)

    def add(self, role: str, text: str) -> list[tuple[str, bool]]:
        t = self.template
        parts = t.segments(role, text)
        self.formatted_chars += sum(len(s) for s, _ in parts)
        self.segments += len(parts)
        # the formatted conversation is one stream: what a turn leaves unread stands before the next
        found, self.unread = t.turns(self.unread + "".join(s for s, _ in parts))
        for role_back, text_back in found:
            self.all.update(f"{role_back}\n{text_back}\n".encode("utf-8", "surrogatepass"))
            self.turns += 1
        for s, trained in parts:
            if trained:
                plain = t.unguard(s)
                self.loss_chars += len(plain)
                self.loss.update(plain.encode("utf-8", "surrogatepass"))
        if self.bad_turn is None and role not in dict(t.steps).get(self.state, ()):
            self.bad_turn = self.added
        self.state = role
        self.added += 1
        return parts

    def row(self) -> tuple:
        if self.unread:
            raise ValueError(f"conversation {self.key} cannot be read back")
        bad = self.bad_turn if self.bad_turn is not None else None if self.state in self.template.final else self.turns
        return self.key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.segments, bad is None, bad


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = arrow_limit(conversations).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


_SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_segments long, valid boolean, bad_turn long"


def summarize(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row for each conversation, read back from its formatted turns.

    Turns stream through in order and only digests are kept, so a conversation of any length takes
    bounded memory. Rows with equal turn numbers are ordered by role and text; null roles and texts count as empty;
    rows with a null ``conv_id`` form one conversation. ``bad_turn`` is the first turn that the machine refuses, or
    the number of turns if the conversation ends in a state that is not final.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        names = [f.split()[0] for f in _SUMMARY.split(", ")]

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            columns = list(zip(*out)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for key, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if now is None or now.key != key:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(template, key)
                now.add(role, text.as_py())
            if len(out) > 10_000:
                yield flush()
                out = []
        if now is not None:
            out.append(now.row())
        yield flush()

    return _sorted(conversations).mapInArrow(run, _SUMMARY)


def segments(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """The formatted output itself: ``conv_id, turn, segment, text, loss``, three segments for each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (c, t, i, s, trained)
                for c, t, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)))
                for i, (s, trained) in enumerate(template.segments(role, text))
            ]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "turn", "segment", "text", "loss"])

    return _sorted(conversations).mapInArrow(run, "conv_id long, turn long, segment int, text string, loss boolean")


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -7, whose texts hold control strings and the escape character."""
    text = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), steps AS (
  SELECT *, row_number() OVER w - 1 AS n, coalesce(lag(role) OVER w, '') AS before,
    regexp_replace(text, '(\\|###|</turn>|: )', '\\\1', 'g') AS safe,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'tool' THEN 'Tool'
      WHEN 'System' THEN '\System' WHEN 'User' THEN '\User' WHEN 'Assistant' THEN '\Assistant' WHEN 'Tool' THEN '\Tool'
      ELSE regexp_replace(role, '(\\|###|</turn>|: )', '\\\1', 'g') END AS name
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), checked AS (
  SELECT *, (before = '' AND n = 0 AND role IN ('system', 'user')) OR (n > 0 AND ((before = 'system' AND role = 'user')
    OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role IN ('user', 'tool'))
    OR (before = 'tool' AND role IN ('assistant', 'tool')))) AS fine
  FROM steps
), folded AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(length(name) + length(safe) + 14) AS formatted_chars, 3 * count(*) AS n_segments,
    min(n) FILTER (WHERE NOT fine) AS first_bad, max_by(role, n) AS last_role
  FROM checked GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, loss_chars::BIGINT AS loss_chars, loss_sha256, formatted_chars::BIGINT AS formatted_chars, n_segments,
  first_bad IS NULL AND last_role = 'assistant' AS valid,
  CASE WHEN first_bad IS NOT NULL THEN first_bad WHEN last_role <> 'assistant' THEN n_turns END AS bad_turn
FROM folded
"""
