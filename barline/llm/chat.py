"""Op 5: chat formatting by incremental black-box rendering.

A template is any function render(turns, prompt) -> str of a list of (role, text) turns; prompt asks for the header of a
coming assistant turn. The formatter knows nothing of its insides: it renders successive prefixes of a conversation and
compares consecutive outputs. What a prefix adds is its last turn's span; if an output does not begin with the one before
it, the template rewrites history and the conversation is marked so and gets no loss mask. Inside an assistant turn the
text lies between the header (what `prompt` adds) and the trailer (what the turn adds when its text is empty, less the
header): that is the loss span.

Defined results: a null text or role is empty; turns are ordered by number, null first, ties by role and text; repeated
rows are repeated turns; rows with a null conv_id form one conversation with a null id; a conversation is one task's work,
and all its prefixes are rendered whatever its length. The query adds conversation -7: where a table holds turns of that id
already, they and the added ones are one conversation. An empty table gives conversation -7 alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

START, STOP = "### ", " </turn>\n"
COLON = ": "
KEPT_CHARS = 32 << 20
#: Conversation -7, which the query adds: its texts look like the template's own marks.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
SCHEMA = "conv_id bigint, n_turns bigint, rewritten boolean, formatted string, turn_spans array<struct<start: bigint, end: bigint>>, loss_spans array<struct<start: bigint, end: bigint>>"

Turns = list[tuple[str, str]]


def escape(text: str) -> str:
    """No mark of the template is left in the result: backslashes are doubled, '#', ':' and '<' get one before them."""
    return re.sub(r"([\\#:<])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class _Lines(dict):
    """(role, text) -> its line in the default template, kept while a conversation's prefixes are rendered; forgets all beyond KEPT_CHARS."""

    chars = 0

    def __missing__(self, turn: tuple[str, str]) -> str:
        if self.chars > KEPT_CHARS:
            self.clear()
            self.chars = 0
        self[turn] = line = START + escape(turn[0]) + COLON + escape(turn[1]) + STOP
        self.chars += len(line) + 100
        return line


_lines = _Lines()


def render(turns: Turns, prompt: bool = False) -> str:
    """The default template: '### Role: text </turn>' lines."""
    return "".join(map(_lines.__getitem__, turns)) + (START + "assistant" + COLON) * prompt


def parse(formatted: str) -> Turns:
    """The turns read back from the default template's output."""
    out = []
    for line in formatted.split(STOP)[:-1]:
        role, _, text = line.removeprefix(START).partition(COLON)
        while role.endswith("\\") and (len(role) - len(role.rstrip("\\"))) % 2:
            more, _, text = text.partition(COLON)
            role += COLON + more
        out.append((unescape(role), unescape(text)))
    return out


def format_turns(turns: Turns, template: Callable[[Turns, bool], str] = render) -> dict:
    """formatted, turn_spans and loss_spans of one conversation, and whether the template rewrote history."""
    before, spans, loss = template([], False), [], []
    for k, (role, text) in enumerate(turns):
        now = template(turns[: k + 1], False)
        if not now.startswith(before):
            return {"rewritten": True, "formatted": template(turns, False), "turn_spans": [], "loss_spans": []}
        spans.append((len(before), len(now)))
        if role == "assistant":
            opened, bare = template(turns[:k], True), template([*turns[:k], (role, "")], False)
            if not (now.startswith(opened) and bare.startswith(opened)):
                return {"rewritten": True, "formatted": template(turns, False), "turn_spans": [], "loss_spans": []}
            loss.append((len(opened), len(now) - (len(bare) - len(opened))))
        before = now
    return {"rewritten": False, "formatted": before, "turn_spans": spans, "loss_spans": loss}


def format_conversations(turns: DataFrame, template: Callable[[Turns, bool], str] = render) -> DataFrame:
    """A row for each conversation, with the columns of SCHEMA; offsets count characters.

    Rows are dealt by conversation and sorted, and a task streams through them, one conversation in memory at a time.
    """
    own = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("rewritten", pa.bool_()), ("formatted", pa.string()), *((c, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))) for c in ("turn_spans", "loss_spans"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(conv, ts):
            x = format_turns(ts, template)
            return {"conv_id": conv, "n_turns": len(ts)} | x | {c: [{"start": a, "end": b} for a, b in x[c]] for c in ("turn_spans", "loss_spans")}

        conv, ts, rows, size = None, [], [], 0
        for batch in batches:
            for c, r, t in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if ts and c != conv:
                    rows.append(done(conv, ts))
                    size += len(rows[-1]["formatted"])
                    ts = []
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                conv = c
                ts.append((r, t))
        if ts:
            rows.append(done(conv, ts))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    spark = turns.sparkSession
    dealt = own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, both read from the formatted text of the default template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.select(["conv_id", "formatted", "loss_spans"]).to_pylist():
                turns, whole, loss, n = parse(r["formatted"]), hashlib.sha256(), hashlib.sha256(), 0
                for role, text in turns:
                    whole.update(f"{role}\n{text}\n".encode())
                for s in r["loss_spans"]:
                    text = unescape(r["formatted"][s["start"] : s["end"]])
                    n += len(text)
                    loss.update(text.encode())
                rows.append((r["conv_id"], len(turns), whole.hexdigest(), n, loss.hexdigest(), len(r["formatted"])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op5_chat(spark, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -7, read back from the formatted text."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(turns.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, role || chr(10) || text || chr(10) AS whole, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
        15 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\#:<]', '', 'g')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(whole, '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(learned)) AS BIGINT) AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
