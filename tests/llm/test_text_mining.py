"""Byte-level BPE, phrases by quotient filters, and the audit of filter orders."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import public_tokenizers
import tiktoken

from tariffgrid.llm import byte_bpe as bpe
from tariffgrid.llm import collocations as col
from tariffgrid.llm import filter_audit as audit
from tariffgrid.llm import quotient_filter as cqf
from tariffgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, score string, rank string, ids string, part string"


def table(spark, rows):
    """Documents (id, text, lang, source) with extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, "x", "y", "z", "p") for r in rows], KIND)


# Byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return bpe.ByteEncoder(ranks, public_tokenizers.PATTERN)


SCRAPS = "a aa b e th the ing in ' 's 'll 'L 1 22 é ß 中 文 ا 🙂 ! ?? - <|endoftext|> \x00 \x1c \x85 \xa0 　 ́ ‍".split(" ") + [" ", "  ", "\n", "\t", "\r\n"]


def scraps(seed, n, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(SCRAPS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_byte_characters_are_one_to_one():
    shown = bpe.byte_characters()
    assert len(set(shown)) == 256 and shown[ord("a")] == "a" and shown[32] == "Ġ" and not any(c.isspace() for c in shown)


def test_encoding_equals_the_rank_library(encoder, plain):
    texts = scraps(1, 3000) + [c * n for c in "abe1 -\n!é中" for n in (1, 2, 3, 7, 64, 333)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == plain.encode_ordinary(text), text


def test_every_character_splits_alike(encoder, plain):
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}" for c in [*range(0x3100), *range(0xA000, 0xAC00), *range(0xF900, 0x10400), *range(0x1F000, 0x1FA00)]]
    want = plain.encode_ordinary_batch(texts, num_threads=1)
    assert [ids.tolist() for ids in encoder.encode(texts)] == want


def test_bounds_change_nothing(ranks, encoder):
    """A few texts, matches and remembered ones at a time, or all at once."""
    small = bpe.ByteEncoder(ranks, public_tokenizers.PATTERN, call=10, known=7, matches=3)
    texts = scraps(2, 1500, 80) + ["x" * 500, " " * 300, "don't we'll they've " * 20, "é" * 99]
    for text, ids, ids2 in zip(texts, encoder.encode(texts), small.encode(texts)):
        assert ids.tolist() == ids2.tolist(), text
        assert encoder.spans(text).tolist() == small.spans(text).tolist() and len(encoder.spans(text)) == len(ids)
    assert len(small.known) <= 7 and all(len(m) <= bpe.KNOWN_CHARS for m in encoder.known)


def test_offsets_cover_the_text_and_split_characters_share_theirs(ranks, encoder):
    text = "naïve 🙂 中文 ok"
    (ids,), spans = encoder.encode([text]), encoder.spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    names = {r: t for t, r in ranks.items()}
    for i, (a, b) in zip(ids.tolist(), spans.tolist()):
        assert names[i] in text[a:b].encode()
    face = [tuple(s) for i, s in zip(ids.tolist(), spans.tolist()) if s[0] <= text.index("🙂") < s[1]]
    assert len(face) > 1 and len({b for _, b in face}) == 1


def test_decoding_any_slice_gives_exact_bytes(ranks, encoder):
    decoder = bpe.ByteDecoder(ranks)
    for text, ids in zip(texts := scraps(3, 300), encoder.encode(texts)):
        for cut in range(0, len(ids), 3):
            assert decoder.decode(ids[:cut].tolist()) + decoder.decode(ids[cut:].tolist()) == text.encode()


def test_encode_and_decode_tables(spark, plain):
    long = "one two three, naïve 🙂 中文! " * 400
    rows = [(1, "Hello  world", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "x", "en", "s"), (4, long, "en", "s"), (5, "Hello  world", "en", "s"), (5, "Hello  world", "en", "s")]
    docs = table(spark, rows)
    got = bpe.encode_texts(docs, offsets=True, call=1000).collect()
    want = Counter((k, tuple(plain.encode_ordinary(t or ""))) for k, t, *_ in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert all(len(r.ids) == len(r.starts) == len(r.ends) for r in got)
    back = bpe.decode_ids(bpe.encode_texts(docs, call=1000)).collect()
    assert Counter((r.doc_id, r.decoded_text) for r in back) == Counter((k, t or "") for k, t, *_ in rows)
    assert all(bytes(r.decoded).decode() == r.decoded_text for r in back)
    assert bpe.decode_ids(bpe.encode_texts(docs.limit(0))).collect() == []


def test_slices_inside_a_character_become_replacement_characters(spark, plain):
    ids = plain.encode_ordinary("🙂")
    assert len(ids) > 1
    cut = spark.createDataFrame([(1, ids[:1]), (2, None), (3, ids)], "doc_id long, ids array<int>")
    got = {r.doc_id: r for r in bpe.decode_ids(cut).collect()}
    assert "�" in got[1].decoded_text and bytes(got[1].decoded) == "🙂".encode()[: len(got[1].decoded)]
    assert bytes(got[2].decoded) == b"" and got[3].decoded_text == "🙂"


def test_op11_query_equals_the_rank_library(spark, plain):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = plain.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r[1:]) for r in QUERIES["op11_byte_bpe"](spark, SF).collect()} == want


# Quotient filters and phrases


@pytest.mark.parametrize("bits", [1, 3, 13, 17, 25, 32])
@pytest.mark.parametrize("n", [2, 3, 5])
def test_filters_lose_nothing(bits, n):
    rng = np.random.default_rng(bits * 10 + n)
    few = min(bits, 3)
    ids = rng.integers(0, 1 << few, 3000).astype(np.int64) * (((1 << bits) - 1) // ((1 << few) - 1))
    keys = cqf.NgramKeys(n, bits)
    packed = keys.pack(ids, np.arange(len(ids) - n + 1))
    mixed = keys.permute(packed)
    assert all((a == b).all() for a, b in zip(keys.restore(mixed), packed))
    limbs, counts = cqf.counted(mixed)
    part_bits = min(2, keys.widths[0])
    of, back = keys.quotient(limbs, part_bits), []
    for part in np.unique(of):
        at = of == part
        back.append(cqf.from_block(keys, cqf.to_block(keys, [x[at] for x in limbs], counts[at] * 200, part_bits), int(part), part_bits))
    both, twice = cqf.merged(back + back)
    got = {tuple(k): c for k, c in zip(keys.unpack(keys.restore(both)).tolist(), twice.tolist())}
    assert got == {k: 400 * c for k, c in Counter(zip(*(ids[i : len(ids) - n + 1 + i].tolist() for i in range(n)))).items()}


def plain_phrases(rows, least=100, longest=5, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) counted with dictionaries of tuples."""
    count, size = {}, Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    count[key] = count.get(key, 0) + 1
    found = {}
    longer = [(lang, w, f) for (lang, w), f in count.items() if f >= least and len(w) > 2]
    for (lang, w), a in count.items():
        if a < least or len(w) < 2:
            continue
        if any(of == lang and len(x) > len(w) and f * 100 >= a * 100 and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1)) for of, x, f in longer):
            continue
        score, k = min((1000 * a * size[lang] // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w)))
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]], size[lang]))
    return {
        (lang, i + 1, phrase.decode(), -a, left, right, n, -score)
        for lang, rows in found.items()
        for i, (score, a, phrase, left, right, n) in enumerate(sorted(rows)[:top])
    }


def babble(seed, n):
    rng = random.Random(seed)
    words = "new york city Ünï of the at in a b x-y straße 中 it's \x1c New".split(" ")
    rows = []
    for k in range(n):
        said = []
        for _ in range(rng.randint(0, 120)):
            said += ["new", "york", "city", "hall"] if rng.random() < 0.1 else [rng.choice(words)]
            said.append(rng.choice([" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\r", "\x0b", "; ", "!"]))
        rows.append((k if k % 7 else None, "".join(w if w.strip() == "" or w[-1] in " ,\n" else w + " " for w in said), rng.choice(["en", "en", "de", None, "und"]), "s"))
    return rows


@pytest.mark.parametrize("broadcast_words", [col.BROADCAST_WORDS, 0])
def test_phrases_equal_plain_counts(spark, broadcast_words):
    rows = babble(4, 400) + [(9, None, "en", "s"), (10, "", "fr", "s"), (11, "w " * 5000, "hot", "s"), (12, "x" * 30_000, "en", "s")]
    want = plain_phrases(rows, least=20, top=60)
    got = col.collocations(table(spark, rows), least=20, top=60, broadcast_words=broadcast_words)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_phrases_do_not_depend_on_buffers_ranges_or_the_map(spark, monkeypatch):
    rows = babble(5, 150)
    want = plain_phrases(rows, least=10, top=50)
    assert {tuple(r) for r in col.collocations(table(spark, rows), least=10, top=50, map_bits=3).collect()} == want  # a map that lets nearly all through
    monkeypatch.setattr(col, "RANGE_ENTRIES", 16)
    assert {tuple(r) for r in col.collocations(table(spark, rows), least=10, top=50).collect()} == want


def test_small_buffers_spill_filters(monkeypatch):
    monkeypatch.setattr(col, "BUFFER", 64)
    monkeypatch.setattr(col, "HELD", 100)
    import pyarrow as pa

    rng = np.random.default_rng(1)
    lists = [np.append(rng.integers(0, 6, 500), 0).astype(np.int32).tolist() for _ in range(5)]
    keys = cqf.NgramKeys(3, 3)
    blocks = list(col._shards(keys, 4, None)(iter([pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32()))], names=["ids"])])))
    assert len(blocks) > 1  # spilled more than once
    rows = sorted((p, b) for x in blocks for p, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist()))
    dealt = pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["part", "block"])
    got = {tuple(i): f for x in col._merge(keys, 4, 2, 9)(iter([dealt])) for i, f in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}
    want = Counter(t for ids in lists for t in zip(ids, ids[1:], ids[2:]) if all(t))
    assert got == {k: c for k, c in want.items() if c >= 2}


def test_phrases_of_one_word(spark):
    rows = [(1, "w " * 300, "en", "s"), (2, "w w. x", None, "s")]
    assert {tuple(r) for r in col.collocations(table(spark, rows)).collect()} == plain_phrases(rows) != set()


def test_no_phrases(spark):
    for rows in ([], [(1, None, None, None)], [(1, "a b c", "en", "s")]):
        assert col.collocations(table(spark, rows)).collect() == []


# Filter orders


def test_ranks_are_lexicographic():
    orders = ["".join(p) for p in permutations("ABCDE")]
    assert [audit.lehmer_rank(o, "ABCDE") for o in orders] == list(range(120))
    assert audit.lehmer_rank("CB", "ABCDE") == orders.index("CBADE")


def test_intervals_tell_the_step_of_every_order():
    orders = ["".join(p) for p in permutations("ABCDE")]
    told = {}
    for mask, step, lo, hi in audit.removal_intervals("ABCDE"):
        for rank in range(lo, hi):
            assert told.setdefault((mask, rank), step) == step
    for mask in range(1, 32):
        inside = {c for i, c in enumerate("ABCDE") if mask >> i & 1}
        for rank, order in enumerate(orders):
            assert told[mask, rank] == 1 + min(order.index(c) for c in inside)


def plain_audit(rows, labels):
    docs = [(k, t or "", s or "") for k, t, _, s in rows]
    label = {}
    for k, quality, toxic in labels:
        good, bad = label.get(k, (0, 0))
        label[k] = (max(good, quality == 1), max(bad, toxic == 1))
    failing = []
    for k, t, part in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        fails += "E" * (k is not None and any(j is not None and j < k and u == t for j, u, _ in docs))
        failing.append((part, fails, *(label.get(k, (0, 0)) if k is not None else (0, 0))))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for _, _, p in docs}:
            left = [f for f in failing if f[0] == part]
            total = left
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                shapley[part, c] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(c in f[1] for f in total) - len(gone), sum(f[1] == c for f in total), sum(f[2] for f in gone), sum(f[3] for f in gone)]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_every_order_by_hand(spark):
    rng = random.Random(8)
    texts = [None, "", "A B C D", "word " * 60, "w" * 500, "a # b", "copy of all"] + [" ".join(rng.choice(["Abc", "def", "x$", *map(str, range(200))]) for _ in range(rng.randint(0, 120))) for _ in range(12)]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), "en", rng.choice(["hot", "hot", "hot", "b", None, ""])) for _ in range(160)]
    rows += [(500, "copy of all", "en", "late")] * 2 + [(1, "copy of all", "en", "early")] * 2
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in list(range(0, 40, 2)) * 2] + [(None, 1, 1)]
    got = audit.audit_filters(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert Counter(tuple(r) for r in got.collect()) == Counter(dict.fromkeys(plain_audit(rows, labels), 1))


def test_audit_of_no_documents_and_of_other_filters(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_filters(table(spark, []), labels).collect() == []
    two = {k: audit.FILTERS[k] for k in "AD"}
    got = {tuple(r)[:5] for r in audit.audit_filters(table(spark, [(1, "a # b", "en", "s"), (2, "a", "en", "s")]), labels, filters=two, copies=None).collect()}
    assert got == {("s", "AD", 1, 0, 2), ("s", "AD", 2, 0, 0), ("s", "DA", 1, 1, 1), ("s", "DA", 2, 0, 1)}
    with pytest.raises(ValueError):
        audit.audit_filters(table(spark, []), labels, copies="A")
