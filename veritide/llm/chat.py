"""Chat formatting by schema fingerprints.

A record's nested field paths are hashed; the fingerprint selects a declarative
mapping, which names where turns, roles and texts are. So prompt/completion pairs,
instruction layouts, message lists and single-turn rows all become canonical turns
(role, text). The template marks turns with control strings; the same strings inside
texts are escaped reversibly, so what is formatted can be read back exactly.

Each turn is rendered on its own as one segment; a conversation is the concatenation
of its segments in order. A conversation of any length is therefore never gathered:
the reader streams over sorted segments.

Defined results: null texts and roles count as empty; missing optional fields and
empty lists give no turn; equal rows are turns each; turns of one number are ordered
by role and text; fields beside those of a known layout are ignored, and of several layouts
that fit the one with most fields counts; records of an unknown layout give no turns,
and ``quarantine`` lists them with their fingerprint and paths, as it does text that is
no JSON object; extra columns of a table of turns are ignored; an empty table gives no
conversations.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SEGMENT_SCHEMA = "conv_id long, turn long, part int, segment string, loss_start int, loss_end int"


def field_paths(record, at: str = "") -> frozenset[str]:
    """Paths of all leaves, list items under ``[]``; nulls are leaves too."""
    if isinstance(record, dict):
        return frozenset().union(*(field_paths(v, f"{at}.{k}" if at else str(k)) for k, v in record.items()))
    if isinstance(record, list):
        return frozenset().union({f"{at}[]"} if not record else (), *(field_paths(v, f"{at}[]") for v in record))
    return frozenset({at})


def fingerprint(paths: frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Where turns are: fixed fields with their roles in order, then a list of messages."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    fields: tuple[tuple[str, str], ...] = ()  # (role, path); fields of one role in a row are joined by a blank line
    messages: str = ""
    role: str = ""
    text: str = ""

    def layouts(self) -> Iterator[frozenset[str]]:
        for n in range(len(self.optional) + 1):
            for some in combinations(self.optional, n):
                yield frozenset(self.required) | frozenset(some)


# The layouts of common public instruction and chat sets.
MAPPINGS = (
    Mapping("turn row", ("role", "text"), messages=".", role="role", text="text"),
    Mapping("messages", ("messages[].role", "messages[].content"), ("system", "messages[].name", "messages[].weight", "id"), (("system", "system"),), "messages", "role", "content"),
    Mapping("no messages", ("messages[]",), ("system", "id"), (("system", "system"),), "messages", "role", "content"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), ("system", "id"), (("system", "system"),), "conversations", "from", "value"),
    Mapping("instruction", ("instruction", "output"), ("input", "system", "id"), (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("prompt and completion", ("prompt", "completion"), ("system", "id"), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and response", ("prompt", "response"), ("system", "id"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question and answer", ("question", "answer"), ("context", "id"), (("user", "context"), ("user", "question"), ("assistant", "answer"))),
    Mapping("nested", ("conversation.turns[].speaker", "conversation.turns[].utterance"), ("conversation.id", "id"), (), "conversation.turns", "speaker", "utterance"),
)
# Names of roles in those layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
BY_FINGERPRINT = {fingerprint(p): m for m in MAPPINGS for p in m.layouts()}


@lru_cache(4096)
def mapping_of(paths: frozenset[str]) -> Mapping | None:
    """The mapping of this fingerprint, or of the largest known layout within the paths."""
    found = BY_FINGERPRINT.get(fingerprint(paths))
    if found is None:
        within = [(len(p & paths), -i, m) for i, m in enumerate(MAPPINGS) for p in (frozenset(m.required),) if p <= paths]
        found = max(within, key=lambda x: x[:2])[2] if within else None
    return found


def at_path(record, path: str):
    for key in path.split("."):
        if key:
            record = record.get(key) if isinstance(record, dict) else None
    return record


def as_text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def record_of(value: str) -> dict | None:
    """A JSON object; None for any other text."""
    try:
        record = json.loads(value)
    except ValueError:
        return None
    return record if isinstance(record, dict) else None


def canonical(record: dict | None) -> list[tuple[str, str]]:
    """The turns of one record by the mapping that its fingerprint selects; none of an unknown layout."""
    m = mapping_of(field_paths(record)) if record is not None else None
    if m is None:
        return []
    turns: list[tuple[str, str]] = []
    for role, path in m.fields:
        if text := as_text(at_path(record, path)):
            if turns and turns[-1][0] == role:
                turns[-1] = (role, f"{turns[-1][1]}\n\n{text}")
            else:
                turns.append((role, text))
    if m.messages:
        found = at_path(record, m.messages.strip("."))
        for x in found if isinstance(found, list) else [found]:
            x = x if isinstance(x, dict) else {}
            role = as_text(x.get(m.role))
            turns.append((ROLES.get(role, role), as_text(x.get(m.text))))
    return turns


def escape(text: str) -> str:
    r"""``<|`` becomes ``<\|``, and each ``<\…\|`` gets one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment, and where in it the loss mask lies (code points; empty unless an assistant's)."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    mask = (len(head), len(head) + len(body)) if role == "assistant" else (len(head), len(head))
    return f"{head}{body}{END}\n", *mask


SEGMENT = re.compile(rf"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, unescaped; it must hold nothing else."""
    turns, at = [], 0
    while at < len(formatted):
        m = SEGMENT.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def format_turns(turns: DataFrame) -> DataFrame:
    """Segments of a table with a row for each turn (conv_id, turn, role, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(conv, turn, k, *render(*x)) for k, x in enumerate(canonical({"role": role, "text": text}))]
            yield segments(rows)

    columns = (F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return turns.select(*columns).mapInArrow(run, SEGMENT_SCHEMA)


def format_records(records: DataFrame, record: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """Segments of a table with a JSON record for each conversation, of any known layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, value in zip(*(c.to_pylist() for c in batch.columns)):
                if value is not None:
                    rows += [(conv, k, 0, *render(*x)) for k, x in enumerate(canonical(record_of(value)))]
            yield segments(rows)

    return records.select(F.col(conv_id).cast("long"), F.col(record).cast("string")).mapInArrow(run, SEGMENT_SCHEMA)


QUARANTINE_SCHEMA = "conv_id long, fingerprint string, paths array<string>, record string"


def quarantine(records: DataFrame, record: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """Records without a mapping: their fingerprint and field paths (none if they are no JSON object)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, value in zip(*(c.to_pylist() for c in batch.columns)):
                if value is not None:
                    found = record_of(value)
                    paths = frozenset() if found is None else field_paths(found)
                    if found is None or mapping_of(paths) is None:
                        rows.append((conv, fingerprint(paths), sorted(paths), value))
            kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, kinds)], [x.split()[0] for x in QUARANTINE_SCHEMA.split(", ")])

    return records.select(F.col(conv_id).cast("long"), F.col(record).cast("string")).mapInArrow(run, QUARANTINE_SCHEMA)


def segments(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32())
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")])


def ordered(of: DataFrame) -> DataFrame:
    """Segments so that each conversation is in one task, in order."""
    return of.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "segment")


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(of: DataFrame) -> DataFrame:
    """Per conversation, from its formatted segments read back: digests of turns and of masked text.

    One conversation is hashed by one task, as a digest must be, segment by segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []

        def ended() -> tuple:
            conv, n, turns, chars, loss, size = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*rows)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in DIGEST_SCHEMA.split(", ")])

        for batch in batches:
            rows = []
            for conv, segment, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5))):
                if not state or state[0] != conv:
                    if state:
                        rows.append(ended())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                masked = unescape(segment[start:end])
                for role, text in read_back(segment):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5] += len(segment)
            yield batch_of(rows)
        if state:
            yield batch_of([ended()])

    return ordered(of).mapInArrow(run, DIGEST_SCHEMA)
