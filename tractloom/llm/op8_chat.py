r"""Chat formatting: schema fingerprints select the mapping that turns a record into canonical turns.

A record's nested field paths are hashed; the hash names a declarative layout, which says where roles
and texts are. Each turn is formatted on its own as ``<|turn|>role\ntext<|end|>\n``, so a conversation of any
length is just the concatenation of its rows. Control strings inside texts are broken by a backslash
after their first character and backslashes are doubled, which the reader undoes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tractloom.llm.common import read

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Strings that chat templates use as marks; none may appear whole inside a formatted text. Fixed values.
CONTROL = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
           "<|startoftext|>", "<|user|>", "<|assistant|>", "<|system|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>")
LEARNED_ROLE = "assistant"

_BREAK = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ").", re.S)
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record are: in a list (``each``, or the record itself), or one per entry of ``parts``."""
    name: str
    paths: tuple[str, ...]
    each: str | None = None
    role: str = "role"
    text: str = "content"
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


_HUMAN = {"human": "user", "gpt": "assistant", "bot": "assistant", "prompter": "user"}
LAYOUTS = (
    Layout("turn", ("role", "text"), text="text"),
    Layout("messages", ("messages", "messages[].role", "messages[].content"), each="messages"),
    Layout("from_value", ("conversations", "conversations[].from", "conversations[].value"), each="conversations", role="from", text="value", roles=_HUMAN),
    Layout("prompt_completion", ("prompt", "completion"), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system_prompt_response", ("system", "prompt", "response"), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", ("instruction", "input", "output"), parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question_answer", ("question", "answer"), parts=(("user", ("question",)), ("assistant", ("answer",)))),
)


def field_paths(value, at: str = "") -> set[str]:
    """All field paths of a nested record; list elements share the path ``name[]``."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in ({f"{at}.{k}" if at else k} | field_paths(v, f"{at}.{k}" if at else k))}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, at + "[]")}
    return set()


def fingerprint(paths) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)))


BY_FINGERPRINT = {fingerprint(layout.paths): layout for layout in LAYOUTS}


def canonical(record: dict) -> tuple[str | None, list[tuple[str, str]]]:
    """(layout name, turns as (role, text)); (None, []) for a record of no known layout. Missing roles and texts are empty."""
    layout = BY_FINGERPRINT.get(fingerprint(field_paths(record)))
    if layout is None:
        return None, []
    said = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if layout.parts:
        return layout.name, [(role, "\n\n".join(t for k in keys if (t := said(record[k])))) for role, keys in layout.parts]
    rows = [record] if layout.each is None else record[layout.each]
    return layout.name, [(layout.roles.get(said(r.get(layout.role)), said(r.get(layout.role))), said(r.get(layout.text))) for r in rows]


def escape(text: str) -> str:
    return _BREAK.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where in it the text that is learned from starts and ends (equal: nothing)."""
    head = OPEN + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    end = len(head) + len(body) if role == LEARNED_ROLE else len(head)
    return head + body + CLOSE, len(head), end


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn in formatted text; anything between turns is an error."""
    at = 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        role = re.sub(r"\\(\\|n|)", lambda e: {"\\": "\\", "n": "\n", "": ""}[e[1]], m[1])
        yield role, unescape(m[2])
    if at != len(formatted):
        raise ValueError(f"not a formatted turn at character {at}")


def format_records(records: DataFrame) -> DataFrame:
    """One row per turn of ``records`` (conv_id, turn, record: JSON), in no particular order.

    Returns conv_id, turn, part (place within the record), layout, formatted, loss_start and loss_end
    (code points of ``formatted``). A conversation's text is its rows' ``formatted`` in the order of turn and part.
    A null record and one of no known layout give one row with null layout and formatted, so nothing goes missing.
    """
    names = ["conv_id", "turn", "part", "layout", "formatted", "loss_start", "loss_end"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for conv, turn, record in zip(*(c.to_pylist() for c in batch.columns)):
                layout, turns = canonical(json.loads(record)) if record else (None, [])
                if layout is None:
                    rows.append((conv, turn, 0, None, None, None, None))
                rows += [(conv, turn, k, layout, *format_turn(role, text)) for k, (role, text) in enumerate(turns)]
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

    return records.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "record").mapInArrow(
        run, "conv_id long, turn long, part int, layout string, formatted string, loss_start long, loss_end long")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted rows: numbers of turns and characters, and digests.

    Rows are sorted within the partition and hashed as they stream by; of a conversation only the state of
    two digests is held, however long it is.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        key, state, done = None, None, []

        def close():
            done.append((key, state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

        for batch in batches:
            for conv, formatted_, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if state is None or conv != key:
                    if state is not None:
                        close()
                    key, state = conv, {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                for role, text in parse(formatted_):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                learned = unescape(formatted_[start:end])
                state["loss"].update(learned.encode())
                state["loss_chars"] += len(learned)
                state["chars"] += len(formatted_)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*done), types)], names=names)
                done = []
        if state is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*done), types)], names=names)

    ordered = formatted.where("formatted is not null").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "formatted")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    record = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    return digests(format_records(rows.select("conv_id", "turn", record.alias("record"))))


SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '{control}', '\\1' || chr(92) || chr(92) || '\\2', 'g') AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + length(role) + 1 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""".replace("{control}", "(<|\\[)(" + "|".join(re.escape(c[1:]).replace("<", "[<]") for c in CONTROL) + ")")
