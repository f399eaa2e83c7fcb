"""Byte-level BPE: ids as the library gives them for the whole text, whatever the parts; bytes come back."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

import __spark_entry__ as entry
from taskweave.llm import bytepairs

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MIX = ["a", "b", "Z", "'", "'s", "'ll", " ", "  ", "\n", "\t", " ", "　", "\x1c", "1", "23", "é", "ж", "中", "。", ".", "!?", "😀",
       "<|endoftext|>", "_", "́", "ſ", "ﬁ", "٣", "​", "\u0085"]


def table_of_ranks():
    with open(RANKS, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_of_ranks(), special_tokens={})


@pytest.fixture(scope="module")
def model():
    return bytepairs.ranks_of(RANKS, public_tokenizers.PATTERN)


def by_hand(text, ranks):
    """Each match of the pattern merged pair by pair, the lowest rank first."""
    out = []
    for match in regex.finditer(public_tokenizers.PATTERN, text):
        parts = [bytes([b]) for b in match.group().encode()]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[p] for p in parts]
    return out


@pytest.mark.parametrize("part", [1, 3, 17])
def test_parts_give_the_ids_of_the_whole(model, library, part):
    rng = random.Random(part)
    for _ in range(1500):
        text = "".join(rng.choices(MIX, k=rng.randint(0, 90)))
        assert model.encode_whole(text, part, bytepairs.SAFE).tolist() == library.encode_ordinary(text)
        assert model.decode(np.asarray(library.encode_ordinary(text), np.int32)) == text.encode()


def test_against_merging_by_hand(model):
    ranks, rng = table_of_ranks(), random.Random(4)
    for _ in range(100):
        text = "".join(rng.choices(MIX + ["the ", "don't", " water"], k=rng.randint(0, 40)))
        assert model.encode_whole(text, 5, bytepairs.SAFE).tolist() == by_hand(text, ranks)


def test_white_space_beyond_the_matcher(model, library, monkeypatch):
    monkeypatch.setattr(bytepairs, "_LONG_WHITE", regex.compile(f"[{bytepairs._WHITE}]{{3,}}"))
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choices([" ", "\n", "　", "\x85", "a", ".", "1", " "], k=rng.randint(0, 30)))
        assert model.encode_whole(text, 2, bytepairs.SAFE).tolist() == library.encode_ordinary(text)
    monkeypatch.undo()
    giant = " " * 1_500_000
    assert model.decode(model.encode(giant + "x")) == (giant + "x").encode()


def test_rows(spark, library):
    rows = [
        (1, None, "a"),
        (2, "", "b"),
        (3, "Hello 'world' 12ab! " * 2000, "c"),
        (3, "Hello 'world' 12ab! " * 2000, "c"),
        (4, "日本語。" * 3000, None),
        (None, "no spaces" + "x" * 9000, "d"),
        (5, "<|endoftext|> plain", "e"),
    ]
    df = spark.createDataFrame(rows, "part long, text string, ids string").repartition(3)
    for spread in (2000, 1 << 30):  # parts dealt over the tasks, and not
        out = bytepairs.encode_texts(df, RANKS, part=100, spread=spread)
        assert out.columns == ["part", "text", "ids"]
        back = bytepairs.decode_ids(out, RANKS).collect()
        key = lambda r: (str(r[0]), str(r[1]), str(r[2]))
        want = sorted([(p, t, None if t is None else library.encode_ordinary(t)) for p, t, _ in rows], key=key)
        assert sorted([(r.part, r.text, r.ids) for r in back], key=key) == want
        assert all((r.bytes is None) if r.text is None else bytes(r.bytes) == r.text.encode() for r in back)


def test_broken_bytes_unknown_ids_and_empty(spark):
    raw = spark.createDataFrame([(b"ok \xff\xfe",)], "raw binary").selectExpr("cast(raw as string) AS text")
    assert bytes(bytepairs.decode_ids(bytepairs.encode_texts(raw, RANKS), RANKS).first().bytes) == "ok ��".encode()
    ids = spark.createDataFrame([([0, 50256, None, -4],), (None,)], "ids array<int>")
    got = [r.bytes and bytes(r.bytes) for r in bytepairs.decode_ids(ids, RANKS).collect()]
    assert got[1] is None and got[0] == b"!" + "�".encode() * 3
    empty = spark.createDataFrame([], "text string, bytes long")
    out = bytepairs.decode_ids(bytepairs.encode_texts(empty, RANKS), RANKS)
    assert out.columns == ["text", "ids", "bytes"] and out.count() == 0
    with pytest.raises(ValueError):
        bytepairs.decode_ids(empty, RANKS, ids="bytes")


def test_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = entry.queries()["op12_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
