r"""Chat formatting: schema fingerprints choose declarative mappings from heterogeneous layouts to canonical turns.

A record's nested field paths (arrays as `[]`) that some mapping knows are sorted and hashed; the hash selects the mapping. A mapping is
plain data: which paths it needs, which it may have, where its turns come from, and what its roles are called. `canonical_turns` applies this to JSON
records of any mix of layouts, one per row; `turn_rows` does the same once for a table whose rows are turns. `as_records` writes turns as
records of three layouts, as a corpus from several origins holds them.

`format_turns` writes each conversation as a string: a turn is `<turn>`, its role, a newline, its text, `</turn>` and a newline. Backslashes
and the two marks inside roles and texts are preceded by a backslash, as are newlines inside roles, so any text comes back as it was.
The loss mask is a list of (start, end) offsets of code points: the escaped texts of the assistant's turns. `read_formatted` parses it back.

Conversations are dealt by id and sorted by turn; a conversation streams through its task in parts of about `PART` characters, so no
conversation is held in memory as a whole. Digests of a sequence are sequential by nature, so one conversation stays in one task.

Defined results: null text or role: empty; null turn: before all others; equal turns: by role, then text; null conv_id: one conversation; an empty
table: no conversations. Other columns are ignored. JSON that is broken, nested beyond reading, not an object, of no known layout, or with something else
than records among its turns, gives a null layout and no turns; a lone surrogate becomes U+FFFD. A text of any length is one string in its task.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE, LEARNED = "<turn>", "</turn>", "assistant"
#: Characters of a formatted part, after which the next turn starts a new one.
PART = 1 << 20

# ---- fingerprints and mappings ------------------------------------------------------------------------

ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
#: turns: "row" (the record is a turn of a table), "list" (a list of turns at `at`), "fields" (a fixed sequence of (role, path)); roles: other names of roles.
MAPPINGS = (
    {"name": "turn-rows", "need": ["conv_id", "turn", "role", "text"], "may": [], "turns": "row", "role": "role", "text": "text"},
    {"name": "messages", "need": ["messages[].role", "messages[].content"], "may": ["messages[].name"], "turns": "list", "at": "messages", "role": "role", "text": "content"},
    {"name": "conversations", "need": ["conversations[].from", "conversations[].value"], "may": ["id", "system"], "turns": "list", "at": "conversations", "role": "from", "text": "value", "first": [("system", "system")], "roles": ROLES},
    {"name": "instruction", "need": ["instruction", "output"], "may": ["input", "system"], "turns": "fields", "fields": [("system", "system"), ("user", "instruction", "input"), ("assistant", "output")]},
    {"name": "prompt-response", "need": ["prompt", "response"], "may": ["system"], "turns": "fields", "fields": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"name": "prompt-completion", "need": ["prompt", "completion"], "may": [], "turns": "fields", "fields": [("user", "prompt"), ("assistant", "completion")]},
    {"name": "question-answer", "need": ["question", "answer"], "may": ["context"], "turns": "fields", "fields": [("user", "context", "question"), ("assistant", "answer")]},
)
_MARKS = re.compile(r"[\\.\[\]]")


def paths_of(value) -> set[str]:
    """The paths of a JSON value's leaves; an array's elements count together; nulls are leaves. Dots and brackets of a key are escaped, so that it is no path."""
    found, todo = set(), [(value, "")]
    while todo:
        v, at = todo.pop()
        if isinstance(v, dict) and v:
            todo += ((x, f"{at}.{k}" if at else k) for k, x in ((_MARKS.sub(r"\\\g<0>", k), x) for k, x in v.items()))
        elif isinstance(v, list) and v:
            todo += ((x, f"{at}[]") for x in v)
        else:
            found.add(f"{at}[]" if isinstance(v, list) else at)
    return found


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return {p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _whole(s: str) -> str:
    """Without lone surrogates, which no UTF-8 holds."""
    return s if s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Mappings:
    """Fingerprint to mapping. Paths that no mapping knows don't count, so extra columns change nothing."""

    def __init__(self, mappings=MAPPINGS):
        self.known = {p for m in mappings for p in (*m["need"], *m["may"])}
        self.by: dict[str, dict] = {}
        for m in mappings:
            for k in range(1 << len(m["may"])):
                own = {*m["need"], *(p for i, p in enumerate(m["may"]) if k >> i & 1)}
                self.by.setdefault(fingerprint(own), m)

    def find(self, paths: set[str]) -> dict | None:
        return self.by.get(fingerprint(paths & self.known))

    def turns(self, record: dict) -> tuple[str | None, list[tuple[str, str]]]:
        """The mapping's name and the canonical (role, text) pairs; (None, []) for an unknown layout."""
        m = self.find(paths_of(record))
        if m is None:
            return None, []
        text = lambda v: "" if v is None else _whole(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))
        role = lambda v: m.get("roles", {}).get(text(v), text(v))
        if m["turns"] == "list" and not all(isinstance(x, dict) for x in record[m["at"]]):
            return None, []
        if m["turns"] == "row":
            return m["name"], [(role(record[m["role"]]), text(record[m["text"]]))]
        fields = m.get("fields", m.get("first", []))
        found = [(r, "\n\n".join(x for p in ps if (x := text(record.get(p))))) for r, *ps in fields]
        found = [(r, x) for r, x in found if x or r != "system"]
        if m["turns"] == "list":
            found += [(role(x.get(m["role"])), text(x.get(m["text"]))) for x in record[m["at"]]]
        return m["name"], found


def canonical_turns(records: DataFrame, keep: tuple[str, ...], column: str, mappings=MAPPINGS) -> DataFrame:
    """JSON records to (kept columns, layout, turns array<struct<role, text>>)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*keep).schema)

    def run(batches):
        m = Mappings(mappings)
        for b in batches:
            rows = []
            for x in b.column(len(keep)):
                try:
                    value = json.loads(x.as_py() or "null")
                except (ValueError, RecursionError):
                    value = None
                name, turns = m.turns(value) if isinstance(value, dict) else (None, [])
                rows.append((name, [{"role": r, "text": t} for r, t in turns]))
            turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], turn)], names=[*keep, "layout", "turns"])

    return records.select(*keep, F.col(column)).mapInArrow(run, f"{kinds}, layout string, turns array<struct<role string, text string>>")


def as_records(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, record): each turn as a JSON record of one of three layouts, dealt by a hash of the row: a message list, a list of speakers with their own
    names of the roles (only where these can be told back), or a row."""
    spoken = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))[F.col("role")]
    part = F.pmod(F.xxhash64("conv_id", "turn", "role"), F.lit(3))
    written = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    one = lambda name, role, text: F.array(F.struct(role, text)).alias(name)
    record = F.when(part == 0, written(one("messages", F.col("role"), F.col("text").alias("content")))).when(
        (part == 1) & spoken.isNotNull(), written(one("conversations", spoken.alias("from"), F.col("text").alias("value")))
    ).otherwise(written("conv_id", "turn", "role", "text"))
    return turns.select("conv_id", "turn", record.alias("record"))


def table_of(records: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """Records of any known layouts as a table of turns, those of one record in their order."""
    turns = canonical_turns(records, ("conv_id", "turn"), "record", mappings)
    return turns.select("conv_id", "turn", F.inline("turns")).select("conv_id", "turn", "role", "text")


def turn_rows(table: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """A table whose rows are turns, chosen by its schema's fingerprint, as (conv_id, turn, role, text)."""
    m = Mappings(mappings).find(schema_paths(table.select([f.name for f in table.schema]).schema))
    if m is None or m["turns"] != "row":
        raise ValueError(f"no mapping for rows of {sorted(schema_paths(table.schema))}")
    conv, turn = m["need"][:2]
    return table.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(m["role"]), F.lit("")).alias("role"), F.coalesce(F.col(m["text"]), F.lit("")).alias("text"))


# ---- the template ------------------------------------------------------------------------------------

_TEXT, _ROLE, _BACK = re.compile(r"\\|</?turn>"), re.compile(r"\\|</?turn>|\n"), re.compile(r"\\(.)", re.S)
_NEXT = re.compile(r"(?:[^\\\n]|\\.)*", re.S)
_UNTIL = re.compile(r"(?:[^\\<]|\\.|<(?!/turn>))*+", re.S)


def escape(text: str, pattern: re.Pattern = _TEXT) -> str:
    return pattern.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int]:
    """A turn, and where its text starts in it."""
    head = f"{OPEN}{escape(role, _ROLE)}\n"
    return f"{head}{escape(text)}{CLOSE}\n", len(head)


def parse(formatted: str):
    """Yields (role, text, start of the escaped text, its end) for each turn."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        head = _NEXT.match(formatted, at + len(OPEN))
        body = _UNTIL.match(formatted, head.end() + 1)
        if not formatted.startswith(CLOSE + "\n", body.end()):
            raise ValueError(f"no end of the turn at {at}")
        yield unescape(head[0]), unescape(body[0]), body.start(), body.end()
        at = body.end() + len(CLOSE) + 1


_PARTS = "conv_id {}, part int, last boolean, formatted string, loss array<struct<start: int, end: int>>"


def format_turns(table: DataFrame, mappings=MAPPINGS, part: int = PART, learned: str = LEARNED) -> DataFrame:
    """Rows (conv_id, part, last, formatted, loss) for each conversation; one part unless it is longer than `part`. Offsets are the part's own."""
    rows = turn_rows(table, mappings).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        out, now, pieces, size, loss, number, ident = [], None, [], 0, [], 0, None

        def close(last):
            nonlocal pieces, size, loss, number
            out.append((ident, number, last, "".join(pieces), loss))
            pieces, size, loss, number = [], 0, [], 0 if last else number + 1

        def batch():
            nonlocal out
            cols, out = list(zip(*out)), []
            spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            types = (id_type, pa.int32(), pa.bool_(), pa.string(), spans)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["conv_id", "part", "last", "formatted", "loss"])

        for b in batches:
            id_type = b.column(0).type
            for i, role, text in zip(b.column(0), b.column(2), b.column(3)):
                i = (i.as_py(),)
                if now is not None and i != now:
                    close(True)
                elif size >= part:
                    close(False)
                now, ident = i, i[0]
                turn, start = render(role.as_py(), text.as_py())
                if role.as_py() == learned:
                    loss.append({"start": size + start, "end": size + len(turn) - len(CLOSE) - 1})
                pieces.append(turn)
                size += len(turn)
                if sum(len(x[3]) for x in out[-8:]) > 4 * part or len(out) >= 1000:
                    yield batch()
        if now is not None:
            close(True)
        if out:
            yield batch()

    return rows.mapInArrow(run, _PARTS.format(kind))


def read_formatted(parts: DataFrame) -> DataFrame:
    """Parses what format_turns() wrote, in any order, and digests it: a row for each conversation."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        def fresh():
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        s = fresh()
        for b in batches:
            rows = []
            for i, last, formatted, loss in zip(b.column(0), b.column(2), b.column(3), b.column(4)):
                formatted = formatted.as_py()
                for role, text, _, _ in parse(formatted):
                    s[0] += 1
                    s[1].update(f"{role}\n{text}\n".encode())
                for span in loss.as_py():
                    text = unescape(formatted[span["start"] : span["end"]])
                    s[2] += len(text)
                    s[3].update(text.encode())
                s[4] += len(formatted)
                if last.as_py():
                    rows.append((i.as_py(), s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]))
                    s = fresh()
            if rows:
                types = (b.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The query's own conversation, with the template's marks and another's inside its texts.
PROBE = r"\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    spark, kinds = conversations.sparkSession, dict(conversations.dtypes)
    probe = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, len(regexp_replace(role, '(\\|</?turn>|\n)', '\\\1', 'g')) + len(regexp_replace(text, '(\\|</?turn>)', '\\\1', 'g')) + 15 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
