"""Chat formatting with typed content parts.

A turn is a role and ordered parts: text, image, audio or document. A visitor flattens the parts into one text with placeholders in
their order, records each attachment's reference, and counts tokens with placeholders expanded. A turn's formatted text depends on
that turn alone, so formatting is a map without a shuffle; reading back orders turns of a conversation and streams through them,
holding one turn at a time.

Template: ``<|turn|>ROLE\\nTEXT<|end|>\\n``. In roles and texts every ``\\``, ``<`` and ``[`` gets a ``\\`` before it, so no control
string - this template's or another's, like ``</s>`` or ``[INST]`` - survives inside them, and taking these off again restores them.
Line breaks of a role are written ``\\n``. Loss falls on the text of assistant turns.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import tokens

TURN, END = "<|turn|>", "<|end|>\n"
LOSS_ROLE = "assistant"
_CONTROL = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"\\(.)", re.S)
FORMATTED = "conv_id long, turn long, formatted string, loss_start int, loss_end int, n_tokens long, attachments array<struct<kind:string,ref:string,position:int,tokens:long>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


class PartVisitor:
    """Flattens typed parts. Subclasses may change the expansions; unknown kinds are documents."""

    def __init__(self, count_tokens, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 512):
        self.count_tokens, self.patch, self.audio_rate, self.page_tokens = count_tokens, patch, audio_rate, page_tokens

    def flatten(self, parts: list[dict]) -> tuple[str, list[dict], int]:
        """The text with placeholders, the attachments, and the count of expanded tokens."""
        text, attachments, total = [], [], 0
        for part in parts:
            kind = part.get("type") or "text"
            if kind == "text":
                piece, n = self.visit_text(part)
            else:
                n = getattr(self, f"visit_{kind}", self.visit_document)(part)
                piece = f"<|{re.sub(r'[^a-z_]', '_', kind.lower())}:{len(attachments)}|>"
                attachments.append({"kind": kind, "ref": part.get("ref") or part.get("url"), "position": sum(map(len, text)), "tokens": n})
            text.append(piece)
            total += n
        return "".join(text), attachments, total

    def visit_text(self, part: dict) -> tuple[str, int]:
        text = part.get("text") or ""
        return escape(text), self.count_tokens(text)

    def visit_image(self, part: dict) -> int:
        sides = (part.get("width") or 224, part.get("height") or 224)
        return math.prod(math.ceil(x / self.patch) for x in sides)

    def visit_audio(self, part: dict) -> int:
        return math.ceil((part.get("seconds") or 0) * self.audio_rate)

    def visit_document(self, part: dict) -> int:
        return (part.get("pages") or 1) * self.page_tokens


def format_turn(role: str, parts: list[dict], visitor: PartVisitor) -> tuple[str, int, int, int, list[dict]]:
    """The formatted turn, its loss span in code points (empty but for assistants), its expanded tokens and attachments."""
    text, attachments, n = visitor.flatten(parts)
    head = TURN + escape(role).replace("\n", "\\n") + "\n"
    start = len(head)
    end = start + len(text) if role == LOSS_ROLE else start
    for x in attachments:
        x["position"] += start
    return head + text + END, start, end, n, attachments


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders stay as they are."""
    if not (formatted.startswith(TURN) and formatted.endswith(END)):
        raise ValueError("not a formatted turn")
    role, _, text = formatted[len(TURN) : -len(END)].partition("\n")
    return unescape(re.sub(r"\\(n|.)", lambda m: "\\\n" if m[1] == "n" else m[0], role)), unescape(text)


def _format(tokenizer: str):
    def run(batches):
        enc = tokens.encoder(tokenizer)
        visitor = PartVisitor(lambda text: len(enc.encode([text])[0]) // 4)
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("n_tokens", pa.int64()), ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int32()), ("tokens", pa.int64())])))])
        for batch in tokens.trimmed(batches):
            for at in range(0, batch.num_rows, 512):
                rows = []
                for conv_id, turn, role, text, parts in zip(*(batch.column(i).slice(at, 512).to_pylist() for i in range(5)), strict=True):
                    parts = json.loads(parts) if parts else [{"type": "text", "text": text}]
                    formatted, a, b, n, attachments = format_turn(role or "", parts, visitor)
                    rows.append({"conv_id": conv_id, "turn": turn, "formatted": formatted, "loss_start": a, "loss_end": b, "n_tokens": n, "attachments": attachments})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def format_turns(turns: DataFrame, parts: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """A formatted row for each row of ``turns`` (conv_id, turn, role, text), see FORMATTED.

    ``parts`` names a column of JSON arrays of typed parts; where it is null, or not given, the text is the only part. Null text and
    null role are empty; null conv_id and turn stay null (null turns come first). Empty tables give empty results.
    """
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    columns.append((F.col(parts) if parts else F.lit(None)).cast("string").alias("parts"))
    return turns.select(*columns).mapInArrow(_format(tokenizer or tokens.default_tokenizer()), FORMATTED)


def _digests(batches):
    """Streams over formatted turns in order; hashes go along, so a conversation of any length holds one turn in memory."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    now, state, done = None, None, []

    def close():
        n, turns, chars, loss, size, count = state
        done.append((now[0], n, turns.hexdigest(), chars, loss.hexdigest(), size, count))

    for batch in batches:
        for conv_id, formatted, a, b, count in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end", "n_tokens")), strict=True):
            if now is None or now[0] != conv_id:
                if now is not None:
                    close()
                now, state = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            role, text = parse_turn(formatted)
            masked = unescape(formatted[a:b])
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(masked)
            state[3].update(masked.encode())
            state[4] += len(formatted)
            state[5] += count
        if len(done) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done.clear()
    if now is not None:
        close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from formatted turns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens.

    Turns that repeat a turn number are taken in the order of their formatted text. Rows of null conv_id are one conversation.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back: see conversation_digests."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return conversation_digests(format_turns(turns)).drop("n_tokens")


SQL = {
    "op9_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(17 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
}
