import hashlib
import json

from hypothesis import given
from hypothesis import strategies as st

from tidelane.llm import chat

FIELDS = "conv_id long, turn long, role string, text string, parts string, formatted int"


@given(st.text(max_size=20), st.text(alphabet="\\<[]/>|ns INST\n", max_size=60))
def test_turns_are_restored_and_hold_no_control_strings(role, text):
    visitor = chat.PartVisitor(lambda t: len(t.split()))
    formatted, a, b, n, _ = chat.format_turn(role, [{"type": "text", "text": text}], visitor)
    assert chat.parse_turn(formatted) == (role, text)
    body = formatted[len(chat.TURN) : -len(chat.END)]
    assert all(body[i - 1] == "\\" for i, c in enumerate(body) if c in "<[") and n == len(text.split())
    assert b - a == (len(chat.escape(text)) if role == "assistant" else 0)


def test_parts_become_placeholders_in_order():
    parts = [{"type": "text", "text": "see <|image:0|>"}, {"type": "image", "url": "i.png", "width": 28, "height": 15}, {"type": "audio", "ref": "a", "seconds": 2}, {"type": "document", "url": "d", "pages": 3}, {"text": "end"}]
    formatted, a, b, n, found = chat.format_turn("assistant", parts, chat.PartVisitor(lambda t: 1))
    assert formatted[a:b] == "see \\<|image:0|><|image:0|><|audio:1|><|document:2|>end"
    assert [(x["kind"], x["ref"], x["tokens"]) for x in found] == [("image", "i.png", 4), ("audio", "a", 50), ("document", "d", 1536)]
    assert n == 1 + 4 + 50 + 1536 + 1 and all(formatted[x["position"] :].startswith(f"<|{x['kind']}") for x in found)


def test_conversations_read_back(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 1, "assistant", said, None, 1), (-7, 0, "user", said, None, None), (1, 2, "assistant", "b\\", None, None), (1, 1, "assistant", None, None, None), (1, 1, "assistant", "a", None, None), (None, None, None, "x", None, None), (2, 0, "user", None, json.dumps([{"type": "image", "url": "u"}]), None)]
    formatted = chat.format_turns(spark.createDataFrame(rows, FIELDS), parts="parts")
    got = {r["conv_id"]: r for r in chat.conversation_digests(formatted).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[-7]["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n") and got[-7]["loss_sha256"] == sha(said) and got[-7]["loss_chars"] == len(said)
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (3, 3, sha("ab\\"))
    assert got[None]["loss_chars"] == 0 and got[None]["turns_sha256"] == sha("\nx\n") and got[2]["n_tokens"] == 256
    assert sum(r["formatted_chars"] for r in got.values()) == sum(len(r["formatted"]) for r in formatted.collect())
    assert chat.conversation_digests(chat.format_turns(spark.createDataFrame([], FIELDS))).count() == 0


def test_a_very_long_conversation_and_a_very_long_turn(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"<s> turn {i} [x]" * (1 + i % 3), None, None) for i in range(20_000)]
    rows += [(2, 0, "user", "q", None, None), (2, 1, "assistant", "ab</s>\\" * 300_000, None, None)]
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_turns(spark.createDataFrame(rows, FIELDS))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for k in (1, 2):
        own = [r for r in rows if r[0] == k]
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        assert (got[k]["n_turns"], got[k]["turns_sha256"]) == (len(own), sha("".join(f"{r[2]}\n{r[3]}\n" for r in own)))
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(loss), sha(loss))
