"""The training-data operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import dataclasses
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskweave.llm import chat, linededup, linkage, orderminhash, packing, pii, quality, sentencepieces, substrings, suffixes, vectors

SPACES = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, chunk long, bucket string, id long, source string"


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "té", "ru", "no"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line, long = prose(70), prose(12) + ".", prose(3000)
    near = prose(200).split()
    rows = [
        (1, f"{prose(60)}\n{line}\n{passage} {prose(20)}"),
        (2, f"{passage}\n{line}\n{prose(30)}"),
        (3, line + "\n" + line.replace("a", "o", 1) + "\n" + prose(80)),
        (4, f"{prose(30)} {passage}  \t{passage} {prose(5)}"),
        (5, " ".join(near)),
        (6, " ".join(near[:100] + [word()] + near[101:])),
        (7, " ".join(near[1:])),
        (8, " ".join(near[100:] + near[:100])),
        (9, long),
        (10, long),
        (11, long[:5000] + prose(40)),
        (12, None),
        (13, ""),
        (14, " \n\t "),
        (15, "a"),
        (15, "a"),
        (16, f"{line}"),
        (16, f"{prose(55)}"),
        (None, f"{passage} of no one"),
        (None, None),
        (-5, f"{passage}"),
        (17, "aaaa " * 200),
        (18, "aaaa " * 150),
        (19, "mail me@site.org or +1 (784) 555-8120 from 10.0.0.1 now"),
    ]
    return [(i, t, 0, "x", 7, "s") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_windows_against_brute_force(docs, none):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(docs).collect())
    first = {}
    texts = [(r[0], SPACES.findall(r[1] or "")) for r in corpus()]
    for i, ws in texts:
        for p in range(len(ws) - 49) if i is not None else ():
            first[tuple(ws[p : p + 50])] = min(i, first.get(tuple(ws[p : p + 50]), i))
    expected = []
    for i, ws in texts:
        gone = {p + k for p in range(len(ws) - 49) if i is not None and first[tuple(ws[p : p + 50])] < i for k in range(50)}
        expected.append((i is None, i or 0, len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone)))
    assert got == sorted(expected)
    assert substrings.without_repeats(none).count() == 0


def test_byte_windows_against_brute_force(docs, none):
    got = sorted(
        (r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept)))
        for r in suffixes.without_repeats(docs).collect()
    )
    first, texts = {}, [(r[0], (r[1] or "").encode()) for r in corpus()]
    for i, x in texts:
        for p in range(len(x) - 49) if i is not None else ():
            first[x[p : p + 50]] = min(i, first.get(x[p : p + 50], i))
    expected = []
    for i, x in texts:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - 49) if i is not None else ():
            if first[x[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        expected.append((i is None, i or 0, len(x), int(gone.sum()), spans, sha(kept)))
    assert got == sorted(expected)
    assert suffixes.without_repeats(none).count() == 0


def test_crowded_anchors_are_cut_finer(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(12)]
    rows = []
    for i in range(60):
        ws = [word() for _ in range(60)] + common + [word() for _ in range(60)]
        rows.append((i, " ".join(ws)))
    rows.append((100, rows[7][1][200:] + " end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: r.n_removed for r in substrings.without_repeats(docs).collect()}
    real = substrings.spans_of_repeats
    from taskweave.llm import repeats

    few = repeats.first_holders
    monkeypatch.setattr(repeats, "first_holders", lambda *a, **k: few(*a, most_contents=3, **k))
    assert real is substrings.spans_of_repeats
    cut = {r.doc_id: r.n_removed for r in substrings.without_repeats(docs).collect()}
    assert cut == plain and cut[100] > 60 and sum(v for k, v in cut.items() if k != 100) == 0


@pytest.mark.parametrize("operator", [substrings, suffixes])
def test_no_party_of_the_engine_is_crowded(spark, monkeypatch, operator):
    from collections import Counter

    from taskweave.llm import repeats

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, same = " ".join(word() for _ in range(56)), "aaaaa " * 60
    rows = [(i, " ".join(word() for _ in range(50)) + f" {passage} {same}" + " ".join(word() for _ in range(50))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(tuple(r) for r in operator.without_repeats(docs).collect())
    few, cap = repeats.first_holders, 3

    def bounded(found, units, engine, shard_units):
        def watched(shard):
            assert max(Counter(shard.column("content").to_pylist()).values()) <= cap
            return engine(shard)

        return few(found, units, watched, shard_units, most_contents=cap)

    monkeypatch.setattr(repeats, "first_holders", bounded)
    cut = sorted(tuple(r) for r in operator.without_repeats(docs).collect())
    assert cut == plain and cut[0][2] == 0 and all(r[2] > 100 for r in cut[1:])


def test_an_anchor_whose_contents_fit_in_a_shard_is_not_crowded(spark, monkeypatch):
    from taskweave.llm import repeats

    rng = random.Random(15)
    line = "".join(rng.choice("abcdefgh") for _ in range(40))
    new = lambda: "".join(rng.choice("0123456789") for _ in range(90))
    rows = [(i, f"{new()}{line}{new()}") for i in range(1800)]
    rows.append((5000, rows[3][1][60:150]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut, crowded = repeats._crowded_holders, []
    monkeypatch.setattr(repeats, "_crowded_holders", lambda *a: crowded.append(1) or cut(*a))
    chunk = dataclasses.replace(suffixes.BYTES, chunk_bytes=100_000)
    monkeypatch.setattr(suffixes, "BYTES", chunk)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.without_repeats(docs).collect()}
    assert got == {i: (0, 0) for i in range(1800)} | {5000: (90, 1)} and not crowded
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.without_repeats(docs, group_bytes=60_000).collect()}
    assert got == {i: (0, 0) for i in range(1800)} | {5000: (90, 1)} and crowded


def test_texts_are_shuffled_compressed_and_come_back(spark):
    from taskweave.llm import repeats

    texts = ["", "é\x00 x", "many words " * 500, "a" * 49]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, text_hash long, text string")
    rows = repeats.packed(docs).orderBy("doc_id").toArrow()
    assert len(rows.column("text")[2].as_py()) < 200
    assert repeats.unpacked(rows.column("text"), rows.column("n_bytes")).to_pylist() == texts
    spans = spark.createDataFrame([], "doc_id long, text_hash long, spans array<struct<start:int,end:int>>")
    assert dict(repeats.with_spans(docs, spans).dtypes)["text"] == "binary"


def test_repeated_lines_against_brute_force(docs, none):
    out = linededup.drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "__removed"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in out.collect())
    key = {}
    for i, t, *_ in corpus():
        if i is not None and t is not None:
            order = spark_hash(docs, t)
            for place, line in enumerate(t.split("\n")):
                if SPACES.search(line):
                    spot = (i, order, place)
                    key[line] = min(spot, key.get(line, spot))
    head = heads_by_hand(key)
    expected = []
    for i, t, *_ in corpus():
        if i is not None and t is not None:
            order = spark_hash(docs, t)
            kept = [
                line
                for place, line in enumerate(t.split("\n"))
                if line not in key or (head[line] == line and key[line] == (i, order, place))
            ]
            t = "\n".join(kept)
        expected.append((i is None, i or 0, t is None, t or ""))
    assert got == sorted(expected)
    assert linededup.drop_repeated_lines(none).count() == 0


def edits_by_hand(length):
    """The documented bands."""
    return 4 if length >= 256 else 3 if length >= 128 else 2 if length >= 24 else 1 if length >= 10 else 0


def heads_by_hand(key):
    """The line that stays for each line, from the first place of each: itself, or the first of its group if that is close."""
    from test_llm_parts import levenshtein

    lines = sorted(key, key=key.get)

    def close(a, b):
        most = edits_by_hand(min(len(a), len(b)))
        return most > 0 and abs(len(a) - len(b)) <= most and levenshtein(a, b) <= most

    group = {x: x for x in lines}
    for i, b in enumerate(lines):
        for a in lines[:i]:
            if group[a] != group[b] and close(a, b):
                low, high = sorted((group[a], group[b]), key=key.get)
                group = {x: low if g == high else g for x, g in group.items()}
    return {x: g if g == x or close(g, x) else x for x, g in group.items()}


def test_repeated_lines_of_every_length(spark):
    from test_llm_parts import edited

    rng = random.Random(11)
    lines = ["a", "b", "ab", "ac", "No. 7", "No. 8", "(c) 2019 Foo", "(c) 2021 Foo", "It was a sunny day.", "It was a suny day."]
    for n in (1, 2, 3, 5, 8, 9, 10, 11, 15, 16, 17, 20, 23, 24, 60, 126, 127, 128, 129, 200, 255, 256, 257, 300):
        base = "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
        lines += [base, *("".join(edited(rng, base, k, "xyz")) for k in (1, 2, 2, 3, 4, 4, 5))]
    lines = list(dict.fromkeys(line for line in lines if line))
    rng.shuffle(lines)
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string").repartition(3)
    head = heads_by_hand({line: i for i, line in enumerate(lines)})
    got = {i: n for i, _, n in linededup.drop_repeated_lines(docs).collect()}
    assert got == {i: int(head[line] != line) for i, line in enumerate(lines)}
    assert sum(got.values()) > 25


def test_lines_that_are_no_repeats_stay(spark):
    lines = ["yes", "yet", "cat", "car", "12", "13", "2021", "2022", "Price: 10", "Price: 95", *map(str, range(10, 100))]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    removed = {r.doc_id: r["__removed"] for r in linededup.drop_repeated_lines(docs).collect()}
    assert sorted(lines[i] for i, n in removed.items() if n) == ["12", "13"]  # the second ones, which are equal


def test_a_chain_does_not_carry_lines_away(spark):
    base = "the quick brown fox jumps over it"
    chain = [base, base.replace("quick", "quikk"), base.replace("quick", "quukk"), base.replace("quick", "zuukk"), base.replace("quick", "zuuxx")]
    docs = spark.createDataFrame(list(enumerate([*chain, base])), "doc_id long, text string")
    removed = {r.doc_id: r["__removed"] for r in linededup.drop_repeated_lines(docs).collect()}
    assert removed == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0, 5: 1}


def test_line_dedup_and_names_of_the_caller(spark):
    rows = [("1", "same line of text", 5, "x"), ("2", "same line of text\nother", 6, "y")]
    docs = spark.createDataFrame(rows, "doc_id string, __id string, __hash int, __removed string")
    out = linededup.drop_repeated_lines(docs, key="doc_id", text="__id")
    assert out.columns == ["doc_id", "__id", "__hash", "__removed"]
    assert sorted(tuple(r) for r in out.collect()) == [("1", "same line of text", 5, 0), ("2", "other", 6, 1)]


def test_shared_buckets_over_batches():
    import pyarrow as pa

    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.randint(0, 9), rng.randint(0, 3)) for _ in range(rng.randint(0, 40))]
        packs = sorted((b // 3, np.array([(x, y) for x, y in rows[i::3] if x // 3 == b // 3], np.int64).tobytes()) for b in (0, 3, 6, 9) for i in range(3))
        batches = (pa.RecordBatch.from_pydict({"range": [r for r, _ in packs[k::1][:1]], "data": [d for _, d in packs[k::1][:1]]},
                   schema=pa.schema([("range", pa.int64()), ("data", pa.binary())])) for k in range(len(packs)))
        got = [tuple(r.values()) for b in linededup._shared(batches) for r in b.to_pylist()]
        names = {}
        for b, h in rows:
            names.setdefault(b, set()).add(h)
        assert sorted(got) == sorted((b, h) for b, hs in names.items() if len(hs) > 1 for h in hs)


def test_the_sieve_lets_every_link_through():
    import pyarrow as pa
    from test_llm_parts import edited

    rng = random.Random(6)
    for _ in range(60):
        base = "".join(rng.choice("abcdéfgh中 ") for _ in range(rng.choice([9, 10, 30, 130, 260])))
        lines = [base, *("".join(edited(rng, base, k, "xyz é")) for k in range(6)), base[::-1], "other " * 9]
        may = linededup.near_enough(pa.array(["before", *lines]).slice(1), linededup.BANDS)
        every = np.arange(len(lines))
        for i in every.tolist():
            through = may(np.full(len(lines), i), every)
            assert all(through[j] or not linededup.linked(lines[i], lines[j], linededup.BANDS) for j in every.tolist())
        assert not may(np.array([0]), every[-1:])[0]


_HASHES = {}


def spark_hash(docs, text):
    """Rows that share an id are ordered by this."""
    if not _HASHES:
        for r in docs.select("text", F.xxhash64("text").alias("h")).collect():
            _HASHES[r.text] = r.h
    return _HASHES[text]


def test_near_duplicates_against_brute_force(docs, none):
    from test_llm_parts import lcs

    got = {(r.doc_id, r.component, r.kept) for r in orderminhash.near_duplicates(docs).collect()}
    texts = [(r[0], SPACES.findall(r[1] or "")) for r in corpus() if r[0] is not None]
    group = {i: i for i, _ in texts}
    shingles = [(i, ws, [tuple(ws[p : p + 5]) for p in range(len(ws) - 4)]) for i, ws in texts]
    for i, v, a in shingles:
        for j, w, b in shingles:
            same = v and v == w
            close = a and b and abs(len(a) - len(b)) * 9 <= len(a) + len(b)
            if i < j and group[i] != group[j] and (same or (close and (len(a) + len(b) - 2 * lcs(a, b)) * 9 <= len(a) + len(b))):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert got == {(i, g, i == g) for i, g in group.items()} | {(None, None, True)}
    assert group[6] == 5 and group[7] == 5 and group[8] == 8 and group[10] == 9
    kept = orderminhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r[0] is None or group[r[0]] == r[0] for r in corpus())
    assert orderminhash.near_duplicates(none).count() == 0


def test_groups_equal_those_of_all_pairs(spark):
    rng = random.Random(4)
    points = {i: rng.randint(0, 300) for i in range(150)}
    members = [(b, i, 0) for i in points for b in rng.sample(range(6), 2)]

    texts = spark.createDataFrame([(i, str(x)) for i, x in points.items()], "id long, text string")

    def verify(pairs, texts):
        left, right = texts.toDF("a", "x"), texts.toDF("b", "y")
        near = F.abs(F.col("x").cast("long") - F.col("y").cast("long")) <= 3
        return pairs.join(left, "a").join(right, "b").where(near)

    def compare(found):
        return lambda i, j: abs(int(found[i]) - int(found[j])) <= 3

    got = linkage.linked_groups(
        spark.createDataFrame([m[:2] for m in members], "bucket long, id long"), lambda ids: texts.join(ids, "id"), verify, compare, tile=7
    )
    group = {i: i for i in points}
    for b, i, _ in members:
        for c, j, _ in members:
            if b == c and i < j and abs(points[i] - points[j]) <= 3 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    found = {r.id: r.component for r in got.collect()}
    assert {i: found.get(i, i) for i in points} == group

    def sieve(column):
        values = np.array(column.to_pylist(), np.int64)
        return lambda i, j: np.abs(values[i] - values[j]) <= 5

    buckets = spark.createDataFrame([m[:2] for m in members], "bucket long, id long")
    sieved, _ = linkage.linked_groups_and_texts(buckets, lambda ids: texts.join(ids, "id"), verify, compare, tile=7, sieve=sieve)
    assert sorted(map(tuple, sieved.collect())) == sorted(map(tuple, got.collect()))


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(50 + i, 50 + (i + 1) % 9) for i in range(9)] + [(99, 90), (99, 95), (7, 7)]
    got = {r.id: r.component for r in linkage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    several = linkage.components(spark.createDataFrame(edges, "a long, b long").repartition(4), edges_of_a_task=10)
    assert {r.id: r.component for r in several.collect()} == got
    assert got == {i: 0 for i in range(41)} | {i: 50 for i in range(50, 59)} | {99: 90, 90: 90, 95: 90}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 24))
    rows = [(i, (base[i % 12] + rng.normal(size=24) * 0.18).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(300, None), (301, [0.0] * 24), (302, [float("nan")] * 24)]
    rows += [(303, [None] * 24), (304, [1.0]), (305, []), (None, rows[3][1]), (306, [float("inf")] + [0.0] * 23), (306, rows[4][1])]
    table = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<double>, cell int, id string")
    out = vectors.near_duplicates(table, tile=16).collect()
    good = [(k, i, np.array(v)) for k, (i, v) in enumerate(rows) if i is not None and v and len(v) == 24 and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = np.array([v / np.sqrt(v @ v) for _, _, v in good])
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    ids = np.array([i for _, i, _ in good])
    least = ids.copy()
    for _ in range(200):
        new = np.array([min(least[j] for j in [k, *np.flatnonzero(links[k])]) for k in range(len(ids))])
        if (new == least).all():
            break
        least = new
    expected = sorted((int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, links.sum(1), least))
    expected += [(i, 0, i, True) for i, _ in (rows[155], rows[156], rows[157], rows[158], rows[159], rows[160], rows[162])]
    assert sorted(tuple(r) for r in out if r.vec_id is not None) == sorted(expected)
    assert [tuple(r) for r in out if r.vec_id is None] == [(None, 0, None, True)]
    assert vectors.near_duplicates(table.where("false")).count() == 0


def test_packing_places_every_piece(docs, none):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = packing.byte_bpe(path)
    for limits in ({}, {"items_per_task": 4}):
        out = packing.pack_documents(docs, path, **limits).collect()
        ids = [(r[0], [*encode(r[1] or ""), 2]) for r in corpus()]
        expected = sorted(
            (i is None, i or 0, k, at, n, zlib.crc32(np.array(x[at : at + n], "<u4").tobytes()))
            for i, x in ids
            for k, (at, n) in enumerate(packing.cut(len(x), 1024))
        )
        assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
        rows = {}
        for r in out:
            rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in rows.values():
            parts.sort()
            assert [p for p, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
            assert sum(n for _, n in parts) <= 1024
    assert packing.pack_documents(none, path).count() == 0


def test_personal_data_rows(docs, none):
    rows = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    r = rows[19]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 1)
    assert r.spans == "email:5:16,phone:20:37,ip:43:51" and r.base_sha256 == sha(r.spans)
    assert rows[12].spans == "" and rows[12].base_sha256 == sha("")
    redacted = pii.redact_documents(docs)
    assert redacted.schema == docs.schema and redacted.count() == len(corpus())
    assert redacted.where("doc_id = 19").first().text == "mail <EMAIL> or <PHONE> from <IP> now"
    assert pii.find_personal_data(none).count() == 0 and pii.redact_documents(none).count() == 0


def test_quality_edges(docs, none):
    out = {}
    for r in quality.judge_documents(docs).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert out[12][0].cleaned is None and out[12][0].base_failed and not out[12][0].kept
    assert out[13][0].cleaned == "" and out[13][0].n_words == 0 and out[14][0].n_lines == 0
    assert len(out[15]) == 2 and out[17][0].n_repeat_words == 200 and out[17][0].base_failed
    kept = quality.clean_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 5}
    assert quality.judge_documents(none).count() == 0 and quality.clean_documents(none).count() == 0


def test_sentencepiece_rows(docs, none, spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    out = sentencepieces.decode_ids(sentencepieces.encode_texts(docs, path, chunk=300), path)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(corpus())
    for r in rows:
        assert r.ids == (None if r.text is None else library.encode(r.text)) and r.decoded == r.text
    assert sentencepieces.encode_texts(none, path).count() == 0


def test_chat_edges(spark):
    mark = "</s>[INST] <|end|>\\ <\\| [/INST]"
    rows = [(1, 0, "system", mark), (1, 1, "user", None), (1, 2, "assistant", mark), (1, 3, "assistant", ""), (1, 4, "user", "x")]
    rows += [(2, 0, "user", "only"), (None, 0, None, "?"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example int")
    examples = chat.format_chat(turns)
    assert examples.count() == 3 + 1 + 1 + 2
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha(whole), len(loss), sha(loss))
    only = examples.where("conv_id = 1 AND example = 3").first()
    assert only.formatted[only.loss_start : only.loss_end].replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") == mark
    assert chat.read_back(chat.format_chat(turns.where("false"))).count() == 0


def test_pipeline_stages(spark, docs, none):
    import corpus_pipeline as pipeline

    table = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
    assert [name for name, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "personal_data", "packing"]
    rows = table
    for name, work in pipeline.STAGES[:-1]:
        out = work(spark, rows, "")
        assert out.schema.names == table.schema.names, name
        rows = spark.createDataFrame(out.collect(), table.schema)
    ids = {r.doc_id for r in rows.collect()}
    # the first of near copies stays, later ones and what the rules reject go
    assert {1, 5, 8, 9} <= ids and not ids & {6, 7, 10, 12, 13, 14, 15, 17, 18}
    packed = pipeline.STAGES[-1][1](spark, rows, "")
    assert {r.doc_id for r in packed.collect()} == ids
    empty = none.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(1).cast("long").alias("n_chars"))
    for _, work in pipeline.STAGES:
        assert work(spark, empty, "").count() == 0


def test_vectors_of_every_length_and_size(spark):
    rng = np.random.default_rng(8)
    rows = []
    for size in (1, 2, 3, 17):
        for _ in range(12):
            v = rng.normal(size=size)
            scale = 10.0 ** rng.choice([-300, -200, 0, 5, 200, 300])
            rows += [v * scale, (v + rng.normal(size=size) * 0.1) * 10.0 ** rng.choice([-250, 0, 250])]
    rows += [np.array([1e200, 0, 0]), np.array([1e-200, 0, 0]), np.array([1.0, 0, 0]), np.array([1.0, 1.0]), np.array([1.0, 1.0])]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3)
    scaled = [v / np.abs(v).max() for v in rows]
    unit = [v / np.sqrt(v @ v) for v in scaled]
    links = [[j for j, w in enumerate(unit) if i != j and len(v) == len(w) and v @ w >= 0.9] for i, v in enumerate(unit)]
    least = list(range(len(rows)))
    while True:
        new = [min(least[j] for j in [i, *own]) for i, own in enumerate(links)]
        if new == least:
            break
        least = new
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(table).collect()}
    assert got == {i: (len(links[i]), least[i], least[i] == i) for i in range(len(rows))}
    assert got[len(rows) - 1][0] > 0 and got[len(rows) - 3][0] > 1


def test_phrases_are_whole_words_of_short_lines(spark):
    words = " ".join(f"word{i}" for i in range(60)) + "."
    lines = ["The new design in Paris was plain.", "Please spread more butter on it.", "A dialog in the film is short."]
    paragraph = words + " Please read more of it, and log in."
    rows = [(0, "\n".join([words, *lines])), (1, words + "\nSign in to read more."), (2, paragraph)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_phrase_failed, r.kept) for r in quality.judge_documents(docs).collect()}
    assert got == {0: (0, True), 1: (1, True), 2: (0, True)}


def _linked_by_brute_force(ids, rows):
    unit = rows.astype(np.float64) / np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))[:, None]
    links = unit @ unit.T >= vectors.COSINE
    np.fill_diagonal(links, False)
    least = ids.copy()
    while True:
        new = np.array([min(least[k], *least[own]) if own.any() else least[k] for k, own in enumerate(links)])
        if (new == least).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, links.sum(axis=1), least)}
        least = new


def _vectors_in_groups(rng, n, size):
    """Vectors of even spread, pairs of near copies, and a tenth of all in one group that is not linked throughout."""
    rows = rng.normal(size=(n, size))
    rows[1::10] = rows[::10] + rng.normal(size=rows[::10].shape) * rng.uniform(0.2, 0.6, size=(len(rows[::10]), 1))
    rows[5::10] = rows[5] + rng.normal(size=rows[5::10].shape) * 0.35
    return rows.astype(np.float32)


def test_vectors_are_written_once(spark, tmp_path, monkeypatch):
    rows = np.random.default_rng(2).normal(size=(4_000, 64))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    monkeypatch.setattr("taskweave.staging.shared_folder", lambda _: str(tmp_path))
    assert vectors.near_duplicates(table).count() == len(rows)
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 2 * rows.astype(np.float32).nbytes


def test_vectors_by_slices(spark):
    rng = np.random.default_rng(11)
    rows = _vectors_in_groups(rng, 700, 24)
    ids = rng.permutation(5_000)[: len(rows)].astype(np.int64)
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, rows)], "vec_id long, embedding array<float>")
    expected = _linked_by_brute_force(ids, rows)
    assert len({c for _, c in expected.values()}) > 500 and max(n for n, _ in expected.values()) > 30
    for parts, held in ((1, 90), (5, 200), (3, 100_000)):
        out = vectors.near_duplicates(table.repartition(parts), tile=16, held=held * 24 * 4).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in out} == expected


def test_both_looks_at_vectors_find_each_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    given = _vectors_in_groups(rng, 900, 40)
    table = spark.createDataFrame([(v.tobytes(),) for v in given], "vector binary")
    spaces = vectors.subspaces(table, 40, 0.9, "<f4", 16)
    assert len(spaces.radii) == 3 and len(spaces.lead) < 40
    ids = rng.permutation(len(given))
    left, right = (vectors._Side(ids[at], np.ones(len(ids[at]), np.int64), given[at], spaces, 2, 16) for at in (slice(300, 900), slice(0, 500)))
    unit = vectors._unit(given)
    links = (unit[300:] @ unit[:500].T >= 0.9) & (left.ids[:, None] > right.ids[None, :])
    for looks in vectors._choices(spaces, 1e-5, 0.9):
        monkeypatch.setattr(vectors, "_looks", lambda *_: looks)
        for dense in (1, 1e9):
            monkeypatch.setattr(vectors, "_DENSE", dense)
            pairs = [p for r, c in vectors._links(left, right, spaces, 0.9) for p in zip(r.tolist(), c.tolist())]
            assert sorted(pairs) == list(zip(*(x.tolist() for x in np.nonzero(links))))
