"""The small helpers of the training-data operators against their definitions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from taskweave.llm import linededup, orderminhash, packing, pii, repeats, sentencepieces, substrings, suffixes


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, times, letters):
    out = list(text)
    for _ in range(times):
        at = rng.randint(0, len(out))
        kind = rng.random()
        if kind < 0.4:
            out.insert(at, rng.choice(letters))
        elif out:
            at = min(at, len(out) - 1)
            out[at : at + 1] = [] if kind < 0.7 else [rng.choice(letters)]
    return out


def test_banded_edit_distance():
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 20)))
        b = "".join(edited(rng, a, rng.randint(0, 8), "abé"))
        most = rng.randint(0, 5)
        assert linededup.edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)


def test_lines_within_the_threshold_share_a_key():
    rng = random.Random(2)
    for _ in range(4000):
        threshold = rng.randint(1, 4)
        a = "".join(rng.choice("abé") for _ in range(rng.randint(threshold + 1, 30)))
        b = "".join(edited(rng, a, threshold, "abé"))
        if len(b) > threshold:
            assert set(linededup._keys(a, threshold)) & set(linededup._keys(b, threshold))


def test_banded_alignment():
    rng = random.Random(3)
    for _ in range(2000):
        a = [rng.randint(0, rng.choice([2, 50])) for _ in range(rng.randint(0, 30))]
        b = edited(rng, a, rng.randint(0, 8), [0, 1, 60])
        most = rng.randint(0, 25)
        expected = min(len(a) + len(b) - 2 * lcs(a, b), most + 1)
        assert orderminhash.distance(np.array(a, np.uint64), np.array(b, np.uint64), most) == expected


def test_order_matters_to_sketches():
    words = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 % 2**63)
    turned = np.concatenate([words[200:], words[:200]])
    same = (orderminhash.sketches(words) == orderminhash.sketches(words.copy())).mean()
    moved = (orderminhash.sketches(words) == orderminhash.sketches(turned)).mean()
    assert same == 1 and moved < 0.8


@pytest.mark.parametrize("window", [3, 7, 50])
def test_merged_transforms_give_first_holders(window):
    rng = random.Random(window)
    for _ in range(40):
        letters = rng.choice([b"ab", b"abc", bytes(range(256))])
        contents = {bytes(rng.choice(letters) for _ in range(rng.randint(window, window + 20))) for _ in range(rng.randint(1, 12))}
        contents = sorted(contents)
        docs = np.array([rng.randint(-3, 9) for _ in contents], np.int64)
        first: dict[bytes, int] = {}
        for c, d in zip(contents, docs.tolist()):
            for i in range(len(c) - window + 1):
                first[c[i : i + window]] = min(first.get(c[i : i + window], d), d)
        got = suffixes.first_docs(contents, docs, window, shards=rng.choice([1, 2, 8]))
        for c, g in zip(contents, got):
            assert g.tolist() == [first[c[i : i + window]] for i in range(len(c) - window + 1)]


def test_contents_of_a_group_meet_by_anchor_and_keep_their_smallest_document():
    rng = random.Random(8)
    bodies = [bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 80))) for _ in range(30)]
    rows = [(d, a, k, s, bodies[k]) for k in range(30) for a, s in ((k % 7, 0), (100 + k, 3)) for d in rng.sample(range(-40, 40), 3)]
    rng.shuffle(rows)
    group = pa.table(dict(zip(("doc_id", "anchor", "content_id", "shift", "content"), zip(*rows))))
    holder: dict[bytes, int] = {}
    for d, _, _, _, body in [r for r in rows if r[1] < 100]:
        for i in range(len(body) - 49):
            holder[body[i : i + 50]] = min(d, holder.get(body[i : i + 50], d))
    alone = {r[1]: min(x[0] for x in rows if x[1] == r[1]) for r in rows if r[1] >= 100}
    got: dict[tuple, int] = {}
    for r in suffixes.merge_group(group).to_pylist():
        for i in range(r["low"], r["high"]):
            assert got.setdefault((r["anchor"], r["content_id"], i), r["first_doc"]) == r["first_doc"]
    expected = {(k % 7, k, i): holder[bodies[k][i : i + 50]] for k in range(30) for i in range(len(bodies[k]) - 49)}
    expected |= {(100 + k, k, i + 3): alone[100 + k] for k in range(30) for i in range(len(bodies[k]) - 49)}
    assert got == expected


def test_spans_of_a_batch_are_told_at_once():
    rng = random.Random(9)
    lengths = [0, 7, 0, 50, 49, *(rng.randint(0, 400) for _ in range(60)), 0]
    spans = [[(0, repeats.WHOLE)] if rng.random() < 0.2 else sorted((a := rng.randint(0, n), rng.randint(a, n)) for _ in range(rng.randint(0, 4))) for n in lengths]
    spans[5] = None
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    column = pa.array([s and [{"start": a, "end": b} for a, b in s] for s in spans], kind)
    gone = []
    for n, told in zip(lengths, spans):
        mask = [False] * n
        for a, b in told or ():
            if b != repeats.WHOLE or n >= 50:
                mask[a:b] = [True] * (min(b, n) - a)
        gone += mask
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for at_once in (1, 500, 1 << 20):
        assert repeats.covered_masks(starts, column, 50, at_once).tolist() == gone
    assert repeats.covered_masks(starts[:1], column.slice(0, 0), 50).tolist() == []


def test_rotations_are_sorted_whether_or_not_keys_and_places_fit_in_a_word():
    rng = np.random.default_rng(10)
    for letters, n in ((2, 3000), (256, 3000), (1, 500), (40, 1)):
        text = rng.integers(0, letters, n).astype(np.uint8)
        twice = bytes(text) * (1 + -(-50 // n))
        order = suffixes.sorted_rotations(text, 50)
        keys = [twice[i : i + 50] for i in order.tolist()]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(n))
    key = rng.integers(0, 1 << 60, 1000).astype(np.uint64) >> np.uint64(52)
    (small, ranks), (large, same) = suffixes._ranked(key, 8), suffixes._ranked(key, 64)
    assert (small == large).all() and (ranks == same).all() and (key[small] == np.sort(key)).all()


def test_automaton_knows_first_documents():
    rng = random.Random(5)
    for _ in range(60):
        window = rng.randint(1, 6)
        texts = [[rng.randint(0, 2) for _ in range(rng.randint(0, 25))] for _ in range(6)]
        automaton, first = substrings.SuffixAutomaton(), {}
        for doc, words in enumerate(texts):
            automaton.add(words, doc)
            for i in range(len(words) - window + 1):
                first.setdefault(tuple(words[i : i + window]), doc)
        for words in texts + [[rng.randint(0, 3) for _ in range(20)]]:
            expected = [first.get(tuple(words[i : i + window])) for i in range(len(words) - window + 1)]
            assert automaton.firsts(words, window) == expected


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(6)
    units = repeats.mix(rng.integers(0, 4, 3000).astype(np.uint64))
    a, b = units[:1000], np.concatenate([units[1000:1400], units[200:700], units[1400:2000]])
    both = np.concatenate([a, b])
    starts = np.array([0, len(a), len(both)])
    low, first, end = repeats.anchored(both, starts, 50, 20)
    anchor = {}
    for v, i, j in zip(low.tolist(), first.tolist(), end.tolist()):
        for p in range(i, j):
            anchor[p] = v
    assert set(anchor) == {*range(0, 951), *range(1000, len(both) - 49)}
    assert [anchor[p] for p in range(200, 651)] == [anchor[p + 1200] for p in range(200, 651)]


@pytest.mark.parametrize("operator", [substrings.WORDS, suffixes.BYTES])
def test_buckets_of_anchors_are_even(operator):
    rng = random.Random(13)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20000))
    table = pa.table({"chunk": [0], "doc_id": [1], "text_hash": [1], "text": [text]})
    sent = repeats._send(table, table.select(["doc_id", "text_hash"]).slice(1), operator, 8)
    sizes = [len(a) for a in sent.column("anchors").to_pylist()]
    assert sent.column("bucket").to_pylist() == list(range(8)) and max(sizes) < 2 * sum(sizes) / 8


def test_anchors_are_sent_in_less_than_half_of_their_bytes():
    rng = np.random.default_rng(14)
    values = np.unique(np.concatenate([rng.integers(0, 1 << 64, 50000, np.uint64), np.array([0, 2**64 - 1], np.uint64)]))
    sent = repeats._squeezed(values)
    assert len(sent) < 0.55 * values.nbytes
    assert (repeats._stretched(sent, len(values)) == values >> np.uint64(20) << np.uint64(20)).all()
    text = "".join(rng.choice(list("abcdefgh ")) for _ in range(60000))
    table = pa.table({"chunk": [0], "doc_id": [1], "text_hash": [1], "text": [text]})
    rows = repeats._send(table, table.select(["doc_id", "text_hash"]).slice(1), suffixes.BYTES, 2)
    assert sum(len(a) for a in rows.column("anchors").to_pylist()) < 0.6 * 8 * sum(rows.column("n").to_pylist())


def plain_spans(text):
    found = []
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(digits[::-1])]
            if {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]:
                found.append((m.start(), kind, m.end()))
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[1])))


def test_detectors_equal_the_patterns():
    rng = random.Random(7)
    for _ in range(20000):
        text = "".join(rng.choice("a.@@+1 23-4()55..٣x_é\n") for _ in range(rng.randint(0, 40)))
        assert pii.detect(text) == plain_spans(text)
    for text in ("4111 1111 1111 1111", "+1 (784) 555-8120 x", "1.2.3.4.5.6.7.8", "a@b.c@d.e"):
        assert pii.detect(text) == plain_spans(text)


@pytest.mark.parametrize(
    "text, spans",
    [
        ("mail john [at] example [dot] com now", "email:5:32"),
        ("john at mail dot example dot org", "email:0:32"),
        ("call plus one five five five one two three four five six seven ok", "phone:5:62"),
        ("ip one nine two dot one six eight dot one dot two", "ip:3:49"),
        ("ｊｏｈｎ@ｅｘample.com", "email:0:16"),
        ("jоhn@exаmple.com", "email:0:16"),
        ("192.168.1.​20", "ip:0:13"),
        ("４１１１ 1111 1111 1111", "card:0:19"),
        ("we sat at home. one dot. zero, ciao", ""),
        ("", ""),
    ],
)
def test_disguises(text, spans):
    base, every = pii.find_spans(text)
    assert pii.as_text(every) == spans and set(base) <= set(every)


def test_redaction_merges_overlaps():
    assert pii.redact("abcdef", [(1, "ip", 3), (2, "card", 5)]) == "a<IP>f"


def test_best_fit_wastes_no_room_that_fits():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 1024, 3000)
    bins = packing.best_fit(sizes, 1024)
    filled = np.bincount(bins, sizes)
    assert filled.max() <= 1024 and len(filled) <= 1.02 * -(-sizes.sum() // 1024)


def test_pieces_of_a_long_document():
    assert list(packing.cut(1024, 1024)) == [(0, 1024)]
    assert list(packing.cut(2500, 1024)) == [(0, 452), (452, 1024), (1476, 1024)]
    assert list(packing.cut(1, 1024)) == [(0, 1)]


@pytest.fixture(scope="module")
def bpe():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.json")


def test_fast_ids_equal_the_tokenizer(bpe):
    from tokenizers import Tokenizer

    slow, fast, rng = Tokenizer.from_file(bpe), packing.byte_bpe(bpe), random.Random(9)
    parts = ["the", " of", "  ", "\n", "é", "中文", "😀", "1234", "'s", "　", "<|endoftext|>", "x" * 40, "\x00", "..."]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        assert list(fast(text)) == slow.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def pieces():
    tokenizers = pytest.importorskip("public_tokenizers")
    return sentencepieces.load(tokenizers.path("piece_bpe_32k.model"))


def in_chunks(pieces, text, size):
    whole, reach, spans = sentencepieces._normal(text), 2 * pieces.longest, []
    ends = sentencepieces.cuts(whole, size, pieces.longest)
    for a, b in zip(ends[:-1], ends[1:]):
        left = whole[max(0, a - reach) : a]
        spans.append((left + whole[a:b] + whole[b : b + reach], len(left), len(left) + b - a))
    way = sentencepieces.chosen_states([sentencepieces.chunk_matrix(pieces, *s) for s in spans])
    return [i for s, p, q in zip(spans, way[:-1], way[1:]) for i in sentencepieces.chunk_ids(pieces, *s, p, q)], len(spans)


def test_pieces_equal_the_library(pieces):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(10)
    alphabets = [
        ["the", "ing ", " ", "  ", "\n", "er", "é", "ß", "中文", "😀", "\t", "tion", "s", "=="],
        ["ab", "ba", "a"],
        ["中", "国", "文", "字", "的", "x"],
    ]
    several = 0
    for _ in range(400):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 300)))
        expected = library.encode(text)
        assert pieces.encode(sentencepieces._normal(text)) == expected
        if text:
            got, n = in_chunks(pieces, text, rng.choice([70, 150]))
            several += n > 1
            assert got == expected
        assert pieces.decode(expected) == text
    assert several > 50
    for spaces in range(40):
        assert pieces.encode(sentencepieces._normal(" " * spaces + "a")) == library.encode(" " * spaces + "a")


def test_remembered_words_and_steps_are_bounded(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    pieces = sentencepieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    text = sentencepieces._normal(" ".join(f"word{i} z{i * i}" for i in range(400)))
    whole = pieces.encode(text)
    steps = [(f"a{i}", f"{i}b") for i in range(300)]
    follows = [pieces.may_follow(*s) for s in steps]
    monkeypatch.setattr(sentencepieces, "_REMEMBERED", 50, raising=False)
    pieces.units.clear()
    pieces.allowed.clear()
    assert pieces.encode(text) == whole and len(pieces.units) <= 50
    assert [pieces.may_follow(*s) for s in steps] == follows and len(pieces.allowed) <= 50


def test_new_words_are_merged_together(pieces, monkeypatch):
    rng = random.Random(4)
    letters = "ab e\u2581\u00e9\u00f1\u4e16\u754c\U0001f600\0\t\nthing\u017a\ud800"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["\u2581" * 40, "aa" * 16]
    got = {w: ids for some, found in pieces.ids_of_words(words) for w, ids in zip(some, found)}
    assert got == {w: tuple(pieces.ids_of(pieces.merge(w))) for w in words}
    text = sentencepieces._normal(" ".join(f"new{i} z{i * i}" for i in range(400)))
    expected = [i for unit in sentencepieces._UNIT.findall(text) for i in pieces.ids_of(pieces.merge(unit))]
    pieces.units.clear()
    monkeypatch.setattr(pieces, "_merge_short", None)
    assert pieces.encode(text) == expected


def test_rows_are_decoded_together(pieces):
    texts = ["two words", "", " a", "\u4e16 \U0001f600", None, "x" * 300]
    ids = pa.array([None if t is None else pieces.encode(sentencepieces._normal(t)) for t in texts], pa.list_(pa.int32()))
    assert pieces.decode_all(ids) == texts
    for a in range(len(texts)):
        assert pieces.decode_all(ids.slice(a, 2)) == texts[a : a + 2]
    assert pieces.decode_all(pa.array([[], None], pa.list_(pa.int32()))) == ["", None]
    assert pieces.decode([pieces.bytes[0xE4], pieces.bytes[0xB8]]) == "\ufffd"


def test_chunks_that_no_piece_reaches_into_are_traced_alone(pieces):
    text = sentencepieces._normal("some words and " * 40 + "w" * 300)
    ends = sentencepieces.cuts(text, 100, pieces.longest)
    assert [sentencepieces.closed(text, a) for a in ends] == [len(sentencepieces.states(pieces, text, a)) == 1 for a in ends[:-1]] + [True]
    spans = [(text, a, b) for a, b in zip(ends[:-1], ends[1:])]
    matrices = [sentencepieces.chunk_matrix(pieces, *s) for s in spans]
    alone = [i for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if sentencepieces.closed(text, a) and sentencepieces.closed(text, b)]
    assert 2 < len(alone) < len(spans) and all(matrices[i].shape == (1, 1) and matrices[i][0, 0] == 0 for i in alone)
    way = sentencepieces.chosen_states(matrices)
    rest = [i for i in range(len(spans)) if i not in alone]
    part = sentencepieces.chosen_states([matrices[i] for i in rest])
    assert [(way[i], way[i + 1]) for i in rest] == list(zip(part[:-1], part[1:]))


def test_keys_of_lines_of_all_lengths_at_once(monkeypatch):
    rng = random.Random(7)
    lines = ["".join(rng.choice("ab \u00e9\U0001f600") for _ in range(n)) for n in [*range(0, 300), *range(0, 300, 3)]]
    singly = [linededup.keys_of([line], linededup.BANDS)[0] for line in lines]
    assert [len(k) for k in singly] == [len(linededup.probes(len(line), linededup.BANDS)) for line in lines]
    mixed, calls = linededup._mixed, []
    monkeypatch.setattr(linededup, "_mixed", lambda x: calls.append(len(x)) or mixed(x))
    keys, places = linededup.keys_of(lines, linededup.BANDS)
    assert len(calls) == 1
    for i, own in enumerate(singly):
        assert np.array_equal(keys[places == i], own)
    assert [len(x) for x in linededup.keys_of([], linededup.BANDS)] == [0, 0]


def test_sieve_counts_characters_of_every_width():
    lines = ["plain ascii line", "plain \u00e9scii line", "", "\u4e16\u754c \U0001f600 and more", "\u4e16\u754c \U0001f601 and more"]
    for some in (lines, lines[:1] * 2, [""]):
        may = linededup.near_enough(pa.array(["x", *some]).slice(1), linededup.BANDS)
        for i, x in enumerate(some):
            for j, y in enumerate(some):
                assert may(np.array([i]), np.array([j]))[0] or not linededup.linked(x, y, linededup.BANDS)


def test_distinct_rows_are_those_of_unique():
    rnd = np.random.default_rng(3)
    for n, top in ((0, 5), (1, 5), (500, 9), (3000, 1 << 62)):
        rows = rnd.integers(-top, top, (n, 2))
        rows = np.concatenate([rows, rows[: n // 3]])
        assert np.array_equal(linededup._distinct(rows), np.unique(rows, axis=0))
