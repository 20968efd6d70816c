"""Operators that look at the whole corpus, against brute force on small tables."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tariffgrid.llm import decontaminate as leaks
from tariffgrid.llm import near_dedup as near
from tariffgrid.llm import source_mix as mix
from tariffgrid.llm.components import connected_components
from tariffgrid.llm.dart_minhash import sketch
from tariffgrid.llm.decontaminate import common_in_order, drop_leaks, find_leaks
from tariffgrid.llm.queries import QUERIES
from tariffgrid.llm.shingles import jaccard_counts, text_shingles

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    """Documents with an extra column that clashes with results."""
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, class_id string")


def doc(k, text, source="s", lang="en"):
    return k, text, lang, source, len(text or "")


# Mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Resharing the excess round by round, as the rule is told."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target | {s: float(most * sizes[s]) for s in capped}
        capped |= over


def mixed(spark, rows):
    return mix.mix_sources(frame(spark, rows)).collect()


def test_mix_follows_the_rule(spark):
    rng = random.Random(1)
    rows, k = [], 0
    for source, n in (("a", 300), ("b", 3), ("é", 40), ("Z", 20), (None, 25), ("zero", 2)):
        for _ in range(n):
            rows.append(doc(k, None if source == "zero" else " ".join(["w"] * rng.randrange(1, 60)), source))
            k += 1
    rows += [doc(0, rows[0][1], "a"), doc(None, "x y", "b")]
    got = mixed(spark, rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    by_id = {r[0]: r for r in rows}
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    target = plain_targets(sizes)
    for r in got:
        source = by_id[r["doc_id"]][3]
        assert r["size"] == len((by_id[r["doc_id"]][1] or "").split()) and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(target[source]) and r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    assert len(got) == len(rows) and sum(target.values()) == pytest.approx(sum(sizes.values()))
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 2 * largest[source], source
    assert sorted(map(tuple, mixed(spark, rows[::-1])), key=str) == sorted(map(tuple, got), key=str)


def test_larger_targets_keep_what_smaller_ones_keep(spark):
    rows = [doc(k, "w " * (1 + k % 7), "a" if k % 3 else "b") for k in range(200)]
    small = {r["doc_id"] for r in mix.mix_sources(frame(spark, rows), weights=(1, 9)).collect() if r["taken"]}
    large = {r["doc_id"]: r for r in mix.mix_sources(frame(spark, rows), weights=(3, 9)).collect()}
    assert small and all(large[k]["taken"] for k in small if k % 3)


def test_mix_edges(spark):
    assert mixed(spark, []) == []
    assert [(r["size"], r["taken"]) for r in mixed(spark, [doc(1, None), doc(2, "")])] == [(0, 0), (0, 0)]
    assert [r["taken"] for r in mixed(spark, [doc(1, "one two three")])] == [3]
    many = mix.mix_sources(frame(spark, [doc(k, "w w", f"s{k % 40}") for k in range(400)]))
    few, mix.BROADCAST_SOURCES = mix.BROADCAST_SOURCES, 5
    try:
        joined = mix.mix_sources(frame(spark, [doc(k, "w w", f"s{k % 40}") for k in range(400)]))
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, many.collect()))
    finally:
        mix.BROADCAST_SOURCES = few


def test_rows_alike_are_taken_as_often_as_needed(spark):
    """100 equal rows of a source: so many of them are taken as its target needs."""
    rows = [doc(1, "w " * 10, "a") for _ in range(100)] + [doc(k, "w " * 7, "b") for k in range(2, 60)] + [doc(70, None, "a")] * 3
    got = mixed(spark, rows)
    taken = sum(r["taken"] for r in got if r["source_size"] == 1000)
    assert len(got) == len(rows) and abs(taken - next(r["target"] for r in got if r["source_size"] == 1000)) <= 5 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(tuple, mixed(spark, rows[::-1])), key=str) == sorted(map(tuple, got), key=str)


def test_targets_of_many_sources(spark):
    rng = random.Random(7)
    sizes = {f"{rng.choice('aZé日')}{k}": rng.choice([0, 1, 5, 40, 1000, 10**12]) for k in range(60)} | {None: 12}
    got = mix.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)).collect()
    want = plain_targets(sizes)
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == want and len(got) == 61


# Near duplicates


def plain_classes(rows, similarity=0.8):
    """Components of all pairs, each compared by its sets of five-word shingles."""

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return {r[0]: least[root(i)] for i, r in enumerate(rows)}


def corpus(seed, n_base=40):
    """Texts with exact copies, copies edited more and less, chains of edits, and a shared passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = []
    for k in range(n_base):
        words = [word() for _ in range(rng.choice([4, 12, 60, 150]))] + (passage if k % 3 == 0 else [])
        texts.append(" ".join(words))
        if k % 2:
            texts += [" ".join(words).upper(), "  ".join(words)]
        for _ in range(rng.choice([0, 1, 6, 25 if k == 1 else 3])):
            edited = list(words)
            for _ in range(rng.choice([1, 2, 3, 6])):
                edited[rng.randrange(len(edited))] = word()
            texts.append(" ".join(edited))
            if rng.random() < 0.3:
                words = edited
    rng.shuffle(texts)
    return [doc(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_those_of_all_pairs(spark, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicate_classes(frame(spark, rows)).collect()}
    assert got == plain_classes(rows)


def test_blocks_of_the_exact_rest(spark, monkeypatch):
    monkeypatch.setattr(near, "STAR_ROUNDS", 1)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 400)
    rows = corpus(3)
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicate_classes(frame(spark, rows)).collect()}
    assert got == plain_classes(rows)


def test_classes_on_the_test_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r["doc_id"]: r["class_id"] for r in QUERIES["op7_near_dedup"](spark, SF).collect()} == plain_classes(rows)


def test_near_edges(spark):
    rows = [doc(1, None), doc(2, ""), doc(3, "a b"), doc(4, "A  b"), doc(4, "A  b"), doc(None, "a b"), doc(5, " \n")]
    classes = near.near_duplicate_classes(frame(spark, rows))
    assert sorted(map(tuple, classes.collect()), key=str) == sorted([(1, 1), (2, 2), (3, 3), (4, 3), (4, 3), (None, None), (5, 5)], key=str)
    twice = [*rows, doc(1, None)]
    kept = near.keep_first_of_class(frame(spark, twice), near.near_duplicate_classes(frame(spark, twice)))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 5, None], key=str) and "class_id" in kept.columns
    assert near.near_duplicate_classes(frame(spark, [])).count() == 0


def test_an_id_with_several_texts_is_one_document(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [doc(3, a), doc(5, a), doc(5, b), doc(9, b), doc(9, None), doc(11, c), doc(12, ""), doc(12, c)]
    classes = near.near_duplicate_classes(frame(spark, rows))
    assert sorted(map(tuple, classes.collect())) == [(3, 3), (5, 3), (5, 3), (9, 3), (9, 3), (11, 11), (12, 11), (12, 11)]
    assert sorted(r["doc_id"] for r in near.keep_first_of_class(frame(spark, rows), classes).collect()) == [3, 11]
    names = frame(spark, [doc(k, t) for k, t in enumerate([a, b, a])]).withColumn("doc_id", F.concat(F.lit("n"), F.col("doc_id")))
    assert sorted(map(tuple, near.near_duplicate_classes(names).collect())) == [("n0", "n0"), ("n1", "n1"), ("n2", "n0")]
    kept = [near.keep_first_of_class(frame(spark, x), near.near_duplicate_classes(frame(spark, x))).collect() for x in ([doc(1, a), doc(1, b)], [doc(1, b), doc(1, a)])]
    assert kept[0] == kept[1] and len(kept[0]) == 1


def test_templates_are_not_compared_in_the_rest(spark, monkeypatch):
    """Texts that share 60 percent share buckets, but none of the rare shingles by which alike ones are found."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    template = [word() for _ in range(120)]
    rows = [doc(k, " ".join(template + [word() for _ in range(40)])) for k in range(60)]
    rows += [doc(100 + k, rows[k][1] + " " + word()) for k in range(5)]
    seen, find = [], near._sharing_rare

    def spied(*x):
        rare = find(*x)
        seen.append([r["node"] for r in rare.collect()])
        return rare

    monkeypatch.setattr(near, "_sharing_rare", spied)
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicate_classes(frame(spark, rows)).collect()}
    assert got == plain_classes(rows) and len(set(got.values())) == 60 and len(set(seen[0])) <= 10


def test_sketches_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 5, 300).astype(float) / 2, rng.integers(1, 5, 300).astype(float) / 2
    s = sketch([elements, elements], 2000, [a, b])
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    plain = sketch([elements[:200], elements[100:]], 2000)
    assert abs((plain[0] == plain[1]).mean() - 1 / 3) < 0.04
    assert (sketch([elements[:1]], 64) != 0).all()


def test_shingles_of_long_texts_do_not_depend_on_blocks(monkeypatch):
    from tariffgrid.llm import shingles

    text = " ".join(f"w{k % 997}" for k in range(3000))
    whole = text_shingles(text)
    monkeypatch.setattr(shingles, "_BLOCK_WORDS", 100)
    assert (text_shingles(text) == whole).all() and len(whole) == 997 and jaccard_counts(whole, whole) == (997, 997)


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (8, 9)] + [(100 + k, 200) for k in range(30)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [got[k] for k in (1, 2, 3, 4, 5)] == [1] * 5 and got[9] == got[8] == 8 and {got[100 + k] for k in range(30)} | {got[200]} == {100}


# Decontamination


def planted(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 4, 5])))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(k, f"{sentence(14)} {sentence(12)} {sentence(6)}") for k in range(30)]
    rows, leaks = [], set()
    for k in range(200):
        body = [sentence(rng.randrange(5, 20)) for _ in range(rng.randrange(1, 25))]
        if k % 5 == 0:
            item, text = items[k // 5 % 30]
            words = text.split()
            if k % 10 == 0:  # reworded here and there
                for _ in range(4):
                    words[rng.randrange(len(words))] = word()
            body.insert(rng.randrange(len(body) + 1), " ".join(words).upper() if k % 15 == 0 else " ".join(words))
            leaks.add((k, item))
        rows.append(doc(k, "\n".join(body)))
    return rows, items, leaks


def test_planted_items_are_found_and_nothing_else(spark):
    rows, items, leaks = planted()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = find_leaks(frame(spark, rows), benchmark)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == leaks
    kept = drop_leaks(frame(spark, rows), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in leaks} and "class_id" in kept.columns


def test_leaks_on_the_test_table_equal_a_plain_search(spark):
    words = lambda t: re.sub(r"[.,;:!?\"'()\[\]{}*#%&$|<>]", "", re.sub("[-_/]", " ", (t or "").lower())).split()
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    plain = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = f" {' '.join(words(r['text']))} "
        plain |= {(r["doc_id"], k) for k, w in items.items() if f" {' '.join(w)} " in text}
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_decontamination"](spark, SF).collect()}
    assert plain <= found and len(found - plain) <= max(1, len(plain) // 5)


def test_an_item_in_most_documents_is_found(spark):
    rows, items, _ = planted(9)
    rows = [doc(r[0], f"{r[1]} {items[0][1]}") if r[0] % 3 else r for r in rows]
    found = {r["doc_id"] for r in find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).where("item_id = 0").collect()}
    assert {r[0] for r in rows if r[0] % 3} <= found


def plain_share(item, words):
    """Most words of the item in order in any window of the text that is three times as long."""
    n = len(item)
    return max((common_in_order(item, words[max(0, k - n) : k + 2 * n]) for k in range(0, max(1, len(words)), max(1, n // 4))), default=0) / n


def test_paraphrases_by_grade(spark):
    """Items with a growing share of words replaced, dropped or added: found as long as the whole-text check holds them."""
    rng = random.Random(21)
    words = [leaks.words_of(r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    prose = [w for ws in words for w in ws]
    cut = lambda n: [prose[(at := rng.randrange(len(prose) - n)) + k] for k in range(n)]
    items = [cut(rng.randrange(16, 80)) for _ in range(150)]
    rows, changed = [], []
    for k in range(600):
        item, share = items[k % 150], (0.0, 0.1, 0.2, 0.25)[k // 150]
        text = [w if rng.random() >= share else rng.choice([[], [rng.choice(prose)], [w, rng.choice(prose)]]) for w in item]
        flat = [x for w in text for x in ([w] if isinstance(w, bytes) else w)]
        body = cut(rng.randrange(0, 300)) + flat + cut(rng.randrange(0, 300))
        rows.append(doc(k, b" ".join(body).decode()))
        changed.append((k, k % 150, plain_share(item, body)))
    benchmark = spark.createDataFrame([(f"i{k}", b" ".join(w).decode()) for k, w in enumerate(items)], "item_id string, text string")
    found = {(r["doc_id"], int(r["item_id"][1:])) for r in find_leaks(frame(spark, rows), benchmark, max_fit_docs=200).collect()}
    due = {(d, i) for d, i, s in changed if s >= leaks.ORDER}
    assert len(due) > 450 and due <= found


def test_a_long_item_across_pieces_and_its_place(spark, monkeypatch):
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    item, short = [word() for _ in range(400)], [word() for _ in range(20)]
    text = [word() for _ in range(900)] + item + [word() for _ in range(500)] + short + [word() for _ in range(100)]
    wanted = leaks.Items.of([{"id": 1, "text": " ".join(item)}, {"id": 2, "text": " ".join(short)}], None)
    vectors = np.random.default_rng(1).standard_normal((len(wanted.vocabulary()), 8)).astype(np.float32)
    whole = sorted(leaks.Search(wanted, wanted.vocabulary(), vectors, 0.45, 0.7, 0.6, 0.8).hits([" ".join(text)]))
    assert [(i, share, first) for _, i, _, share, _, first in whole] == [(0, 1.0, 900), (1, 1.0, 1800)]
    for chars in (300, 2000, 6500, 7001):
        monkeypatch.setattr(leaks, "_PIECE_CHARS", chars)
        pieces = list(leaks.pieces_of(" ".join(text), 70))
        assert len(pieces) > 1 and all(ws == [w.encode() for w in text[at : at + len(ws)]] for at, ws in pieces)
        got = sorted(leaks.Search(wanted, wanted.vocabulary(), vectors, 0.45, 0.7, 0.6, 0.8).hits([" ".join(text)]))
        assert [(i, share, first) for _, i, _, share, _, first in got] == [(0, 1.0, 900), (1, 1.0, 1800)]
    assert leaks.last_start([b"a", b"b"], [b"a", b"x", b"a", b"y", b"b", b"z"]) == 2


def test_passes_share_one_scan_of_frequencies_and_one_of_the_sample(spark, monkeypatch):
    table, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = lambda df: {(r["doc_id"], r["item_id"], r["order_share"] if "order_share" in df.columns else None) for r in df.collect()}
    whole = rows(leaks.find_leaks(table, items))
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    watched = table.withColumn("text", F.udf(seen).asNondeterministic()("text"))
    monkeypatch.setattr(leaks, "BYTES_A_PASS", 3000)
    monkeypatch.setattr(leaks, "ITEMS_A_PASS", 15)
    bytes_, n = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    passes = max(-(-bytes_ // 3000), -(-n // 15))
    monkeypatch.setattr(leaks, "WORDS_HELD", 500)  # words are passed on several times
    found = leaks.find_leaks(watched, items)
    assert passes > 2 and read.value == 2 * table.count()
    assert rows(found) == whole and read.value == (2 + passes) * table.count() and whole
    counts = leaks.all_frequencies(table, items)
    vocabulary = {w: k for k, w in enumerate(sorted({w for r in items.collect() for w in leaks.words_of(r["text"])}))}
    n0, df0 = leaks.document_frequencies(table, vocabulary)
    n1, df1 = leaks.frequencies_of(counts, vocabulary)
    assert n0 == n1 and df0.tolist() == df1.tolist()


def test_the_space_is_fitted_on_every_text(spark, monkeypatch):
    """Each text counts, copies and nulls included, however many there are, in one pass or several."""
    texts = spark.range(10_600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("one two three four "), F.col("id") % 7000)).alias("text"))
    items = spark.createDataFrame([(1, "one two 1 three 2 four 3"), (2, "four 5 six seven 4")], "item_id long, text string")
    fitted, fit = [], leaks.latent_basis
    monkeypatch.setattr(leaks, "latent_basis", lambda on, *rest: (fitted.append(on.agg(F.count("*"), F.count("text")).first()), fit(on, *rest))[1])
    leaks.find_leaks(texts, items)
    monkeypatch.setattr(leaks, "ITEMS_A_PASS", 1)
    leaks.find_leaks(texts, items)
    assert len(fitted) > 1 and set(map(tuple, fitted)) == {(10_600, texts.where("text is not null").count())}


def test_the_product_over_all_texts_equals_the_dense_one(spark, monkeypatch):
    rows, items, _ = planted(6)
    wanted = leaks.Items.of([{"id": k, "text": t} for k, t in items], None)
    vocabulary = wanted.vocabulary()
    texts = [r[1] for r in rows] + [rows[0][1]] * 70 + [None, "", "none of them", f"{items[0][1]} " * 90]
    table = frame(spark, [doc(k, t) for k, t in enumerate(texts)]).select("text").repartition(5)
    idf = np.random.default_rng(2).uniform(0, 3, len(vocabulary))
    idf[::5] = 0
    row, term, tf, n = leaks._tf_rows([leaks._ids(leaks.words_of(t or ""), vocabulary) for t in texts], len(vocabulary))
    a = np.zeros((n, len(vocabulary)))
    a[row, term] = tf * idf[term]
    vectors = np.random.default_rng(1).standard_normal((len(vocabulary), 24)).astype(np.float32)
    for tasks, words in ((32, 1 << 18), (2, 100)):
        monkeypatch.setattr(leaks, "_PART_TASKS", tasks)
        monkeypatch.setattr(leaks, "_FIT_WORDS", words)
        assert np.allclose(leaks._corpus_gram(table, vocabulary, idf, vectors), a.T @ (a @ vectors), rtol=1e-3, atol=1e-2)
    few = leaks.Items.of([{"id": 1, "text": " ".join(items[0][1].split()[:20])}], None)  # no more terms than columns: nothing is left out
    known = few.vocabulary()
    weight = np.linspace(1, 3, len(known))
    basis = leaks.latent_basis(table, few, known, weight, 96).astype(float)
    parts = []
    for lists in ([leaks._ids(leaks.words_of(t or ""), known) for t in texts], [leaks._ids(few.words[0], known)]):
        row, term, tf, n = leaks._tf_rows(lists, len(known))
        parts.append(np.zeros((n, len(known))))
        parts[-1][row, term] = tf * weight[term]
    grams = [p.T @ p for p in parts]
    omega = np.linalg.qr(np.random.default_rng(7).standard_normal((len(known), len(known))))[0]
    whole = grams[0] + grams[1] * np.linalg.norm(grams[0] @ omega) / np.linalg.norm(grams[1] @ omega)
    values, turned = np.linalg.eigh(whole)
    some = values > values.max() * 1e-5
    wanted_root = (turned[:, some] / np.sqrt(values[some])) @ turned[:, some].T
    assert some.sum() > 10 and np.allclose(basis @ basis.T, wanted_root, rtol=1e-2, atol=1e-3 * np.abs(wanted_root).max())


def test_leak_edges(spark):
    benchmark = spark.createDataFrame([(1, "some words of an item that is here for the test to find them all."), (2, None), (3, ""), (None, "x y z"), (1, "some words")], "item_id long, text string")
    text = "Before. Some words of an item, that is here for the test to find them all; after."
    rows = [doc(1, None), doc(2, ""), doc(3, text), doc(3, text), doc(None, text), doc(4, "pad " * 3000 + text)]
    got = find_leaks(frame(spark, rows), benchmark).where("order_share = 1").select("doc_id").collect()
    assert {r["doc_id"] for r in got} == {3, None, 4} and sum(r["doc_id"] == 3 for r in got) >= 2
    clash = frame(spark, rows).withColumn("cosine", F.lit("x")).withColumn("item_id", F.lit("y")).withColumn("id", F.lit("z"))
    assert sorted(r["doc_id"] for r in find_leaks(clash, benchmark).where("order_share = 1 and doc_id is not null").collect()) == sorted(r["doc_id"] for r in got if r["doc_id"] is not None)
    assert drop_leaks(clash, benchmark).columns == clash.columns
    assert find_leaks(frame(spark, []), benchmark).count() == 0 and find_leaks(frame(spark, rows), benchmark.limit(0)).count() == 0


def test_products_in_bounded_runs_equal_whole_ones(monkeypatch):
    rows, items, _ = planted(5)
    wanted = leaks.Items.of([{"id": k, "text": t} for k, t in items], None)
    vocabulary = wanted.vocabulary()
    texts = [r[1] for r in rows] + [None, ""]
    vectors = np.random.default_rng(1).standard_normal((len(vocabulary), 24)).astype(np.float32)
    row, term, tf, n = leaks._tf_rows([leaks._ids(leaks.words_of(t or ""), vocabulary) for t in texts], len(vocabulary))
    dense = np.zeros((n, len(vocabulary)))
    dense[row, term] = tf

    def hits():
        return sorted((t, i, round(c, 4), *rest) for t, i, c, *rest in leaks.Search(wanted, vocabulary, vectors, 0.45, 0.7, 0.6, 0.8).hits(texts))

    whole = hits()
    for terms, cosines in ((1, 1), (50, 400)):
        monkeypatch.setattr(leaks, "_TERMS_AT_ONCE", terms)
        monkeypatch.setattr(leaks, "_COSINES_AT_ONCE", cosines)
        assert len(list(leaks._runs(row))) > 10 and hits() == whole and whole
        assert np.allclose(leaks._gram_times(row, term, tf, vectors), dense.T @ (dense @ vectors), rtol=1e-3, atol=1e-2)


def test_candidates_do_not_depend_on_what_the_latent_space_tells_apart(monkeypatch):
    """No passage is near in it here; of 900 items, most cut from the texts, every occurrence is found all the same."""
    rows, items, planted_leaks = planted(11)
    rng = random.Random(12)
    texts = [leaks.words_of(r[1]) for r in rows] + [[]]
    while len(items) < 900:
        words = texts[rng.randrange(200)]
        if len(words) > 30:
            start, n = rng.randrange(len(words) - 15), rng.randrange(10, 40)
            items.append((len(items), b" ".join(words[start : start + n]).decode()))
    wanted = leaks.Items.of([{"id": k, "text": t} for k, t in items], None)
    joined = [f" {b' '.join(w).decode()} " for w in texts]
    plain = {(t, k) for t, text in enumerate(joined) for k, w in enumerate(wanted.words) if f" {b' '.join(w).decode()} " in text}
    vectors = np.random.default_rng(1).standard_normal((len(wanted.vocabulary()), 8)).astype(np.float32)
    search = leaks.Search(wanted, wanted.vocabulary(), vectors, 2.0, 0.7, 0.6, 0.8)
    hits = sorted(search.hits([r[1] for r in rows] + [None]))
    assert len(plain) > 800 and plain | planted_leaks <= {(t, k) for t, k, *_ in hits}
    assert {(t, k) for t, k, *_, first in hits if k < 30} == planted_leaks
    monkeypatch.setattr(leaks, "_PLACES_AT_ONCE", 40)
    assert sorted(search.hits([r[1] for r in rows] + [None])) == hits


def test_common_in_order_equals_the_table_method():
    rng = random.Random(6)
    for _ in range(100):
        a, b = ([rng.choice([b"x", b"y", b"z", b"w"]) for _ in range(rng.randrange(0, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [0] * len(b) if not b else _next(row, x, b)
        assert common_in_order(a, b) == row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


# Pipeline


def test_pipeline_stages_equal_plain_python(spark):
    """Each stage is held against a plain version of its decision on the rows the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "decontamination", "source_mix"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        kept[name] = (before, {r["doc_id"] for r in docs.collect()})
        if name != "source_mix":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = kept["language_id"]
    assert after == {k for k, r in before.items() if any(c.isalpha() for c in r["text"] or "")}
    before, after = kept["quality_rules"]
    assert all(len(before[k]["text"].split()) >= 20 for k in after)
    before, after = kept["near_dedup"]
    classes = plain_classes([(k, r["text"]) for k, r in before.items()])
    assert after == {k for k, c in classes.items() if k == c}
    before, after = kept["decontamination"]
    leaked = {r["doc_id"] for r in find_leaks(frame(spark, [doc(k, r["text"]) for k, r in before.items()]), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert after == set(before) - leaked and leaked
    assert kept["source_mix"][1] == after
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == after


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows and columns whose names clash with results go through all stages."""
    import shutil

    shutil.copy(f"{SF}/benchmark.parquet", tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, 0), (1, None, "en", None, 0), (2, "", None, "s", 0)], docs.schema)
    unnamed = docs.where("n_chars > 1000").limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    every = docs.unionByName(docs.limit(20)).unionByName(odd).unionByName(unnamed)
    for name in ("lang_pred", "score", "quality", "kept", "class_id", "cosine", "size", "taken", "h", "id", "node"):
        every = every.withColumn(name, F.lit("clash"))
    every.write.parquet(str(tmp_path / "documents.parquet"))
    plain = {r["doc_id"]: r["size"] for r in corpus_pipeline.run(spark, SF).collect()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({r["doc_id"] for r in got}) == len(got) and set(plain) - {1, 2} <= {r["doc_id"] for r in got} | {1, 2} and any(r["doc_id"] is None for r in got)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import shutil

    shutil.copy(f"{SF}/benchmark.parquet", tmp_path / "benchmark.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
