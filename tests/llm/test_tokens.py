import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelane.llm import packing, token_files, tokens

DOCS = "doc_id long, text string, lang string, start long, sequence_id string"


def library(texts):
    return [np.array(x.ids, "<u4") for x in tokens.encoder(tokens.default_tokenizer()).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def rows():
    texts = ["Hello, World's end 12 <|endoftext|> x", None, "", "  \n", "ÀÉ o'clock 'S 's", "İstanbul ΣΑΣ ² á", "dup", "dup", "na\xa0me \x1c x", "word " * 9001]
    return [(i if i != 7 else 6, t, None, None, "x") for i, t in enumerate(texts)] + [(None, "no id", None, 1, None)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcXYZ'’stre dm\n\t.,!-_0²éßÀİΣ<|>\x85\xa0", max_size=40))
def test_cached_encoding_equals_the_library(text):
    enc = tokens.encoder(tokens.default_tokenizer())
    assert enc.encode([text, text + " again"]) == [x.tobytes() for x in library([text, text + " again"])]


def test_cache_overflow_keeps_results(monkeypatch):
    monkeypatch.setattr(tokens, "STRETCHES", 2)
    monkeypatch.setattr(tokens, "PIECES", 1)
    enc = tokens.Encoder(tokens.default_tokenizer())
    for text in ("a b c d", "c d e f g", "a z"):
        assert enc.encode([text]) == [library([text])[0].tobytes()]


def test_which_tokenizers_are_cached_by_stretches(tmp_path):
    """A renamed copy is judged by its settings; one whose pattern looks around, or that doesn't lower-case, goes through the library whole."""
    import json

    with open(tokens.default_tokenizer(), encoding="utf-8") as f:
        spec = json.loads(f.read())
    texts = ["It's 12 O'CLOCK, c_d!\t\xe9\xc9", "a  b", None, "dup dup <|endoftext|>"]

    def made(name, change):
        own = json.loads(json.dumps(spec))
        change(own)
        path = tmp_path / name
        path.write_text(json.dumps(own), encoding="utf-8")
        enc = tokens.Encoder(str(path))
        want = [np.array(x.ids, "<u4").tobytes() for x in enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert enc.encode(texts) == want
        return enc.by_stretches

    assert made("renamed.json", lambda s: None)
    assert not made("word_bpe_49k.json", lambda s: s["normalizer"]["normalizers"].pop())
    assert not made("other.json", lambda s: s["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"\s?\p{L}+|\S"))
    assert not made("looks.json", lambda s: s["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"\p{L}+(?= )|\S"))


def test_files_round_trip(spark, rows, tmp_path):
    path = f"file://{tmp_path}/files"
    manifest = token_files.write_token_files(spark.createDataFrame(rows, DOCS), path)
    assert manifest == token_files.read_manifest(path) and manifest["dtype"] == "<u2"
    got = sorted(map(tuple, token_files.read_token_files(spark, path).drop("shard").collect()), key=lambda x: x[1])
    assert [x[0] for x in got] == [None, 0, 1, 2, 3, 4, 5, 6, 6, 8, 9]
    text = {r[0]: r[1] for r in rows}
    start = 0
    for doc_id, at, n, crc in got:
        ids = np.append(library([text[doc_id]])[0], np.uint32(2)).astype("<u4")
        assert (at, n, crc) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += n
    flat = np.concatenate([token_files.open_shard(path, x, manifest["dtype"])[0] for x in manifest["shards"]])
    assert len(flat) == start


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    assert token_files.write_token_files(empty, f"file://{tmp_path}/none")["shards"] == []
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none").count() == 0
    assert packing.pack(packing.cut_pieces(empty)).count() == 0


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=300, deadline=None)
@given(st.integers(3, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_runs_are_best_fit_decreasing(case):
    capacity, lengths = case
    histogram = {n: lengths.count(n) for n in set(lengths)}
    bins: dict[int, list] = {}
    seen = {n: set() for n in histogram}
    for length, rank, count, first, each, offset in packing.plan_runs(histogram, capacity):
        for i in range(count):
            seen[length].add(rank + i)
            bins.setdefault(first + i // each, []).append((offset + i % each * length, length))
    assert all(seen[n] == set(range(k)) for n, k in histogram.items())
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(capacity - sum(n for _, n in x) for x in bins.values()) == best_fit_decreasing(lengths, capacity)


def test_packed_pieces_hold_every_token_once(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    packed = packing.pack(packing.cut_pieces(docs, capacity=64, with_ids=True), capacity=64).collect()
    by_doc: dict = {}
    bins: dict = {}
    for r in sorted(packed, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["piece"], r["sequence_id"])):
        assert r["length"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        if r["doc_id"] != 6:
            part = by_doc.get(r["doc_id"], b"")
            assert r["start"] == len(part) // 4
            by_doc[r["doc_id"]] = part + bytes(r["ids"])
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc == {r[0]: np.append(library([r[1]])[0], np.uint32(1)).astype("<u4").tobytes() for r in rows if r[0] != 6}
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 64


def test_stores_that_cannot_be_mapped_are_read_by_ranges(spark, rows, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/files"
    manifest = token_files.write_token_files(spark.createDataFrame(rows, DOCS), path)
    for x in manifest["shards"]:
        mapped = token_files.open_shard(path, x, manifest["dtype"])
        store, at = token_files.open_store(f"{path}/{x['name']}.ids")
        ranged = token_files.RangedFile(store, at, manifest["dtype"])
        assert len(ranged) == len(mapped[0]) and (ranged[:] == mapped[0]).all() and (ranged[3:9] == mapped[0][3:9]).all() and len(ranged[5:5]) == 0


def test_a_worker_keeps_more_pieces_than_stretches_between_tasks(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 3)
    monkeypatch.setattr(tokens, "KEPT_PIECES", 7)
    path = tokens.default_tokenizer()
    monkeypatch.setattr(tokens, "_ENCODERS", {path: tokens.Encoder(path)})
    texts = ["one, two, three, four, five, six, seven, eight, nine, ten"]
    enc = tokens.encoder(path)
    first = [enc.encode(texts) for _ in tokens.trimmed(iter([None]))]
    assert (len(enc.stretches), len(enc.pieces)) == (3, 7)
    assert [enc.encode(texts)] == first == [enc._whole(texts)]
