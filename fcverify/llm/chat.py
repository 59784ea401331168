"""Chat formatting by schema fingerprints.

A record's fingerprint is a hash of its nested field paths (lists as ``[]``). It selects a
declarative mapping: where the turns are, or which fields are turns of which role. So
prompts with responses, instructions with inputs, lists of messages and rows of single
turns all become canonical turns (role, text) without anyone looking at values.

The formatted text of a turn is ``<turn ROLE>``, a line feed, the text, ``</turn>``, a line
feed. In texts and roles a backslash stands before every backslash and every ``<`` that a
mark could begin with, so whatever a text says, marks are marks; reading takes it out
again. The loss mask covers what stands between the marks of an assistant's turn.

Turns are rows: a conversation of any length is streamed in order, never held at once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fcverify.llm.store import ready


@dataclass(frozen=True)
class Mapping:
    """``turns``: (role, field) for each turn in order; or ``items``: path of a list whose entries have ``role`` and ``text``.

    A role that begins with ``$`` is read from that field. ``id`` and ``turn`` are the fields of
    the conversation's id and of the turn's place. Optional turns (``?``) are left out when empty.
    ``rename``: roles have other names in this layout (``ROLES``).
    """

    turns: tuple[tuple[str, str], ...] = ()
    items: str | None = None
    role: str = "role"
    text: str = "text"
    id: str = "conv_id"
    turn: str | None = None
    rename: bool = False

    def needs(self) -> frozenset[str]:
        """The fields of a record that the turns are made of."""
        if self.items is not None:
            return frozenset({self.items})
        return frozenset(f for role, field in self.turns for f in (role[1:] if role[0] == "$" else None, field if field[0] != "?" else None) if f)


#: Names that other layouts give to the roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

_PATHS = {
    ("conv_id", "role", "text", "turn"): Mapping((("$role", "text"),), turn="turn"),
    ("conv_id", "messages", "messages[].content", "messages[].role"): Mapping(items="messages", text="content"),
    ("conv_id", "messages", "messages[].role", "messages[].text"): Mapping(items="messages"),
    ("conversations", "conversations[].from", "conversations[].value", "conv_id"): Mapping(items="conversations", role="from", text="value", rename=True),
    ("conv_id", "prompt", "response"): Mapping((("user", "prompt"), ("assistant", "response"))),
    ("conv_id", "prompt", "response", "system"): Mapping((("system", "?system"), ("user", "prompt"), ("assistant", "response"))),
    ("conv_id", "instruction", "output"): Mapping((("user", "instruction"), ("assistant", "output"))),
    ("conv_id", "input", "instruction", "output"): Mapping((("user", "instruction"), ("user", "?input"), ("assistant", "output"))),
}


def paths(record, at: str = "") -> set[str]:
    """Nested field paths of a record; an empty list or object has no paths below its own."""
    if isinstance(record, dict):
        found = set()
        for name, value in record.items():
            own = f"{at}.{name}" if at else name
            found |= {own} | paths(value, own)
        return found
    if isinstance(record, list):
        return set().union(*[paths(x, f"{at}[]") for x in record]) if record else set()
    return set()


def fingerprint(found) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(found)))


MAPPINGS = {fingerprint(k): m for k, m in _PATHS.items()}


def turns_of(record: dict, mapping: Mapping) -> Iterator[tuple[int, str, str]]:
    """Place, role and text of each turn. Null texts are empty, null roles too; other values are written as JSON.

    An entry of a list that is no object is a turn without a role. A list that is none has no turns.
    """
    def plain(value) -> str:
        return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)

    start = record.get(mapping.turn) if mapping.turn else None
    if mapping.items is not None:
        items = record.get(mapping.items)
        rows = [(plain(x.get(mapping.role)), plain(x.get(mapping.text))) if isinstance(x, dict) else ("", plain(x))
                for x in (items if isinstance(items, list) else [])]
    else:
        rows = [(plain(record.get(role[1:])) if role[0] == "$" else role, plain(record.get(field.lstrip("?"))))
                for role, field in mapping.turns if field[0] != "?" or plain(record.get(field[1:]))]
    for number, (role, text) in enumerate(rows):
        yield (number if mapping.turn is None else start), ROLES.get(role, role) if mapping.rename else role, text


def mapping_of(record: dict, known: dict[int, Mapping]) -> Mapping | None:
    """The mapping of the record's fingerprint; else, of those whose fields the record has, the one with the most.

    So further fields are passed over, and an empty list or one with odd entries is read by the layout that has it.
    """
    exact = known.get(fingerprint(paths(record)))
    if exact is not None:
        return exact
    fit = [m for m in known.values() if m.needs() <= record.keys()]
    return max(fit, key=lambda m: (len(m.needs()), repr(m)), default=None)


def _whole(value) -> int | None:
    """An id or place as a long; null if it is none."""
    if isinstance(value, str) and re.fullmatch(r"[+-]?[0-9]{1,18}", value):
        return int(value)
    return value if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 63 else None


_TURN = "conv_id long, turn long, item int, role string, text string"


def canonical_turns(records: DataFrame, column: str = "record", mappings: dict[int, Mapping] | None = None) -> DataFrame:
    """``conv_id``, ``turn``, ``item``, ``role``, ``text`` of every turn of JSON records in any known layout.

    A record of another layout (``mapping_of``), or text that is no JSON object, fails the job with its paths or its
    beginning, so no record is lost unseen. Null records have no turns. An id or place that is no whole number is null.
    """
    known = MAPPINGS if mappings is None else mappings

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for line in batch.column(0).to_pylist():
                if line is None:
                    continue
                try:
                    record = json.loads(line)
                except ValueError:
                    record = None
                if not isinstance(record, dict):
                    raise ValueError(f"no JSON object: {line[:80]!r}")
                mapping = mapping_of(record, known)
                if mapping is None:
                    raise ValueError(f"no mapping for a record with the paths {sorted(paths(record))}")
                rows += [(_whole(record.get(mapping.id)), _whole(turn), item, role, text)
                         for item, (turn, role, text) in enumerate(turns_of(record, mapping))]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)],
                                             names=["conv_id", "turn", "item", "role", "text"])

    return records.select(column).mapInArrow(work, _TURN)


_ESCAPE = re.compile(r"\\|<(?=/?turn)")
_PLAIN = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Backslashes and the beginnings of marks get a backslash in front. ``unescape`` takes it out."""
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and begin and end of the text in it that counts for the loss (equal if none does)."""
    head = f"<turn {escape(role).replace('>', chr(92) + '>')}>\n"
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body) * (role == "assistant")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns. Anything but turns raises ValueError."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith("<turn ", at):
            raise ValueError("a turn does not begin with its mark")
        end = _unescaped(formatted, ">\n", at + 6)
        close = _unescaped(formatted, "</turn>\n", end + 2)
        out.append((unescape(formatted[at + 6:end]), unescape(formatted[end + 2:close])))
        at = close + 8
    return out


def _unescaped(text: str, mark: str, at: int) -> int:
    """Where ``mark`` stands next, not behind an odd number of backslashes."""
    while (at := text.find(mark, at)) >= 0:
        back = at
        while text[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            return at
        at += 1
    raise ValueError("a turn does not end")


_FORMATTED = "conv_id long, turn long, item int, formatted string, loss_start long, loss_end long"


def formatted_turns(turns: DataFrame) -> DataFrame:
    """Each turn with its ``formatted`` text and its loss span in it. A conversation's text is its turns' in order."""
    ready(turns.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turn(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "turn", "item")), pa.array([m[0] for m in made], pa.string()),
                 *(pa.array([m[i] for m in made], pa.int64()) for i in (1, 2))],
                names=["conv_id", "turn", "item", "formatted", "loss_start", "loss_end"])

    return turns.mapInArrow(work, _FORMATTED)


_DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from formatted turns: what was said, and what the loss mask covers.

    Turns come in the order of ``turn`` (nulls first), then of their place in the record, then of
    their text. A conversation is streamed, so its length does not matter for memory.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, state, done = None, None, []

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*done)) or [()] * 6, (
                    pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return out

        def close():
            if state:
                done.append((open_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, text, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if state is None or conv != open_id:
                    close()
                    open_id, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                covered = unescape(text[a:b])
                state[2] += len(covered)
                state[3].update(covered.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield flush()
        close()
        yield flush()

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "item", "formatted")]
    return formatted.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(work, _DIGEST)
