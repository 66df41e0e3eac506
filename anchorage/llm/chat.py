"""Chat formatting by schema fingerprints.

Each record is a JSON text.  The sorted paths of its nested fields are hashed to a
fingerprint, which selects a declarative mapping; the mapping says where the turns
are and which fields hold role and text.  ``turns`` gives canonical turns
(conv_id, turn, role, text), ``render`` puts a template around each, ``parse``
reads them back.

A conversation is a run of rows, one for each turn, so that no task holds a
whole conversation, however long; the formatted text is their concatenation in
the order of ``seq``.  ``digests`` streams over sorted turns.

Null and missing texts and roles are empty.  A record without a known mapping
raises an error that shows its paths.  Turns that tie are ordered by role and text;
repeated rows are repeated turns.  An empty table gives no rows.  Columns other than
those named are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import strings

TURNS = "conv_id long, turn long, part long, role string, text string"
FORMATTED = "conv_id long, turn long, part long, formatted string, loss array<struct<start:int,stop:int>>"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps things; paths are dotted, ``[]`` is an element of a list.

    ``turn_list`` with ``role`` and ``text`` inside it, or ``fixed`` pairs of a
    role and the fields whose texts, joined by empty lines, are its turn.
    """

    paths: tuple[str, ...]
    conversation: str = "conv_id"
    number: str | None = None
    turn_list: str | None = None
    role: str = "role"
    text: str = "text"
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


#: Fixed names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

MAPPINGS = (
    Mapping(("conv_id", "role", "text", "turn"), number="turn"),
    Mapping(("conv_id", "messages[].content", "messages[].role"), turn_list="messages", text="content"),
    Mapping(("conv_id", "conversations[].from", "conversations[].value"), turn_list="conversations", role="from", text="value"),
    Mapping(("conv_id", "completion", "prompt"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(("conv_id", "prompt", "response", "system"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("conv_id", "prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("conv_id", "messages[]"), turn_list="messages"),
    Mapping(("conv_id", "input", "instruction", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("conv_id", "instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
)


def field_paths(value: object, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) or {f"{at}[]"}
    return {at}


def fingerprint(paths: set[str] | tuple[str, ...]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).digest(), "big")


def canonical(record: dict, mapping: Mapping) -> Iterator[tuple[int, int, str, str]]:
    """(turn, part, role, text) of a record; part numbers the turns of one row."""
    own = record.get(mapping.number) if mapping.number else None
    first = 0 if own is None else own
    if mapping.turn_list:
        found = [(m.get(mapping.role), m.get(mapping.text)) for m in record[mapping.turn_list]]
    elif mapping.fixed:
        found = [(role, "\n\n".join(x for f in fields if (x := record.get(f)))) for role, fields in mapping.fixed]
        found = [(role, text) for role, text in found if role != "system" or text]
    else:
        found = [(record.get(mapping.role), record.get(mapping.text))]
    for part, (role, text) in enumerate(found):
        role = "" if role is None else str(role)
        yield first, part, ROLES.get(role, role), "" if text is None else str(text)


class Layouts:
    """Chooses the mapping of a record by its fingerprint.

    Fields that no mapping names are ignored; an exact match of all fields comes first.
    """

    def __init__(self, mappings: tuple[Mapping, ...]):
        self.by_print = {fingerprint(m.paths): m for m in mappings}
        self.known = {p for m in mappings for p in m.paths}

    def open(self, raw: str) -> tuple[dict | None, Mapping | None, str]:
        """The record, its mapping, and why there is none."""
        try:
            record = json.loads(raw)
        except ValueError:
            return None, None, "not a JSON record"
        if not isinstance(record, dict):
            return None, None, "not a JSON object"
        paths = field_paths(record)
        mapping = self.by_print.get(fingerprint(paths)) or self.by_print.get(fingerprint(paths & self.known))
        if mapping is None:
            return record, None, "no mapping for the fields " + ", ".join(sorted(paths))
        if not isinstance(record[mapping.conversation], int | None):
            return record, None, "the conversation is no number"
        return record, mapping, ""


def turns(records: DataFrame, column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical turns of JSON records of any mapped layout; ``unmapped`` tells the others."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = Layouts(mappings)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["conv_id", "turn", "part", "role", "text"]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for raw in batch.column(0).slice(at, 500).to_pylist():
                    record, mapping, _ = layouts.open(raw) if raw is not None else (None, None, "")
                    if mapping:
                        out += [(record[mapping.conversation], *x) for x in canonical(record, mapping)]
                columns = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return records.select(column).mapInArrow(convert, TURNS)


def unmapped(records: DataFrame, column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """record and reason of every record that ``turns`` has no mapping for; null records are none."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = Layouts(mappings)
        for batch in batches:
            raws = [x for x in batch.column(0).to_pylist() if x is not None]
            rows = [(raw, reason) for raw in raws if (reason := layouts.open(raw)[2])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["record", "reason"])

    return records.select(column).mapInArrow(tell, "record string, reason string")


#: Strings that steer chat templates, fixed values; none is left in an escaped text.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>")
_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)</s>\n", re.DOTALL)


def escape(text: str) -> str:
    """A backslash becomes two; one more goes after the first character of a control string."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turn and the code points of it that a model is trained on: the assistant's text."""
    head, own = f"<|{escape(role)}|>\n", escape(text)
    loss = [(len(head), len(head) + len(own))] if role == "assistant" else []
    return f"{head}{own}</s>\n", loss


def parse_turn(formatted: str) -> tuple[str, str]:
    if not (found := _TURN.fullmatch(formatted)):
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


def render(canonical_turns: DataFrame) -> DataFrame:
    """The template around every turn, and its loss spans."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            done = [render_turn(r, t) for r, t in zip(strings(batch.column("role")), strings(batch.column("text")))]
            loss = [[{"start": a, "stop": b} for a, b in spans] for _, spans in done]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("conv_id", "turn", "part")), pa.array([x for x, _ in done], pa.string()), pa.array(loss, span)],
                ["conv_id", "turn", "part", "formatted", "loss"],
            )

    return canonical_turns.select("conv_id", "turn", "part", "role", "text").mapInArrow(write, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from formatted turns: counts and digests of turns and of the loss text.

    Turns are sorted within partitions and streamed, so memory is bounded by a turn.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, begun, all_turns, loss = None, False, hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = 0
        out: list[tuple] = []

        def told() -> tuple:
            return now, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for conv, text, spans in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss"))):
                if not begun or conv != now:
                    if begun:
                        out.append(told())
                    now, begun, all_turns, loss = conv, True, hashlib.sha256(), hashlib.sha256()
                    n = loss_chars = chars = 0
                role, own = parse_turn(text)
                all_turns.update(f"{role}\n{own}\n".encode())
                n, chars = n + 1, chars + len(text)
                for span in spans:
                    part = unescape(text[span["start"] : span["stop"]])
                    loss.update(part.encode())
                    loss_chars += len(part)
            if len(out) >= 1000:
                yield rows()
                out = []
        if begun:
            out.append(told())
        yield rows()

    order = ["conv_id", "turn", "part", "formatted"]
    return formatted.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(stream, DIGESTS)
