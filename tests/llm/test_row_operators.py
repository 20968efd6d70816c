"""Operators that work row by row: tokens, licenses, html, chat, toxicity, language, quality."""

import functools
import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tariffgrid.llm import chat_format as chat
from tariffgrid.llm import html_extract as pages
from tariffgrid.llm import language_id as lang
from tariffgrid.llm import license_scan as lic
from tariffgrid.llm import quality_rules as rules
from tariffgrid.llm import token_count as tok
from tariffgrid.llm import toxicity as tox
from tariffgrid.llm.common import is_held_out, unit_hash
from tariffgrid.llm.queries import ORACLES, QUERIES
from tests.oracle import duck, rows_of, spark_rows

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, score string, quality string"


def docs(spark, *texts, lang="en"):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(k, t, lang, "s", "x", "y") for k, t in enumerate(texts)], KIND)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == rows_of(duck(SF), ORACLES[name])


# Quality rules


def plain_repeat_words(words, n=8):
    seen, covered = {}, set()
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(p + k for p in places for k in range(n))
    return len(covered)


def test_quality_counts_match_plain_python(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a b c", "x" * 3000, "# * $ % & | < >", "same line\nsame line\n\nsame line", "Ünï çødé " * 40]
    texts += [" ".join(rng.choice("a b c d".split()) for _ in range(n)) for n in (7, 8, 9, 40, 300)] + ["\n".join(rng.choice(["one two", " one two", "three", ""]) for _ in range(30))]
    got = {r["doc_id"]: r for r in rules.quality_report(docs(spark, *texts)).collect()}
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        repeat = plain_repeat_words(words)
        assert (got[k]["n_words"], got[k]["word_chars"], got[k]["n_repeat_words"]) == (len(words), sum(map(len, words)), repeat)
        assert got[k]["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "") and got[k]["n_dup_lines"] == len(lines) - len(set(lines))
        assert got[k]["base_failed"] == (len(words) < 20 or 100 * repeat > 30 * len(words)) and not (got[k]["base_failed"] and got[k]["kept"])


def test_quality_keeps_columns_and_runs_no_python(spark):
    prose = "The cat sat on the mat and looked at the birds that were in the tree for most of the day before it went home."
    df = docs(spark, prose, "&&& $$$ " * 30, None)
    kept = rules.keep_good(df)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [0] and kept.first()["quality"] == "y"
    assert rules.quality_report(df.limit(0)).count() == 0
    assert not re.search("Python|Arrow|Pandas|Exchange", rules.quality_report(df)._jdf.queryExecution().executedPlan().toString())


def test_a_rule_table_is_a_parameter(spark):
    long_words = rules.Rule("mean_word_chars", 9.0, None)
    text = " ".join(f"wonderfully{k} extraordinary{k}" for k in range(15))
    assert rules.keep_good(docs(spark, text), rules=(long_words,)).count() == 1
    assert rules.keep_good(docs(spark, "a bc " * 3 + " ".join(f"w{k}" for k in range(20))), rules=(long_words,)).count() == 0


# Language


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op3_language_id"](spark, SF).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)


def test_language_backs_off_to_shorter_ngrams():
    rows = [(0, "a", "known", 9), (0, "b", "other", 9), (4, "a", "<quo", 5), (3, "b", "<zu", 7), (3, "a", "zug", 1), (1, "a", "e", 4), (1, "b", "e", 1)]
    model = lang.LanguageModel.of(rows)

    def plain(kind, term):
        """Smoothed log frequencies straight from the rows."""
        terms = {t for k, _, t, _ in rows if k == kind}
        count = {(x, t): n for k, x, t, n in rows if k == kind}
        return [math.log((count.get((x, term), 0) + 0.5) / sum(count.get((x, t), 0) + 0.5 for t in terms)) for x in "ab"]

    got = model.unseen(["quota", "zug", "e", "xx", "known"])
    want = [plain(4, "<quo"), [(p + q) / 2 for p, q in zip(plain(3, "<zu"), plain(3, "zug"))], plain(1, "e"), [0, 0], plain(0, "known")]
    assert np.allclose(got, want)
    assert model.predict("known")[0] == "a" and model.predict("zun")[0] == "b" and model.predict("other quota")[0] == "b"
    assert model.predict(None) == model.predict("") == model.predict("12 34 !?") == ("und", 0.0)
    assert model.predict("xx") == ("a", 0.5)  # of equals the first by name


def test_language_query_equals_plain_counts(spark):
    """The query against a dictionary model counted from the same texts, words first and then ever shorter n-grams."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts = defaultdict(Counter)
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            words = re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
            counts[0].update((r["lang"], w) for w in words)
            for n in lang.ORDERS:
                counts[n].update((r["lang"], m[i : i + n]) for w in words if (m := f"<{w}>") for i in range(len(m) - n + 1))
    counts[0] = Counter({k: n for k, n in counts[0].items() if n > 1})
    languages = sorted({x for x, _ in counts[1]})
    terms = {k: {t for _, t in of} for k, of in counts.items()}
    total = {k: {x: sum(n for (y, _), n in of.items() if y == x) + 0.5 * len(terms[k]) for x in languages} for k, of in counts.items()}
    value = lambda k, t: [math.log((counts[k][x, t] + 0.5) / total[k][x]) for x in languages]

    @functools.cache
    def word(w):
        if w in terms[0]:
            return value(0, w)
        for n in lang.ORDERS:
            if known := [value(n, g) for i in range(len(w) + 3 - n) if (g := f"<{w}>"[i : i + n]) in terms[n]]:
                return [sum(c) / len(known) for c in zip(*known)]
        return [0.0] * len(languages)

    got = {r["doc_id"]: r for r in QUERIES["op3_language_id"](spark, SF).collect()}
    for r in rows:
        words = re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        if not words:
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        mean = [sum(c) / len(words) for c in zip(*map(word, words))]
        odds = [math.exp((m - max(mean)) * min(len(words), 20)) for m in mean]
        assert got[r["doc_id"]]["score"] == pytest.approx(max(odds) / sum(odds), abs=1e-4)
        assert max(odds) / sum(odds) < 0.51 or got[r["doc_id"]]["lang_pred"] == languages[odds.index(max(odds))]


def test_language_of_odd_rows(spark):
    rows = [(None, "der Hund und die Katze", "de"), (1, "the cat and the dog", "en"), (1, "the cat and the dog", "en"), (3, None, "en"), (4, "", None), (5, "the cat " * 200_000, None), (6, "12 34", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("y"))
    got = [(r["doc_id"], r["lang_pred"]) for r in lang.predict_languages(df, lang.fit_language_model(df, usable=F.lit(True))).collect()]
    assert sorted(got, key=str) == sorted([(None, "de"), (1, "en"), (1, "en"), (3, "und"), (4, "und"), (5, "en"), (6, "und")], key=str)


def test_many_languages_and_small_shares(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = [["".join(rng.choice(letters) for _ in range(5)) for _ in range(8)] for _ in range(300)]
    rows = [(k, " ".join(rng.choice(own[k % 300]) for _ in range(20)), f"l{k % 300:03}") for k in range(1200)]
    rows += [(5000 + k, " ".join(rng.choice(own[0]) for _ in range(20)), "l000") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang.fit_language_model(df, usable=F.lit(True), max_docs=900, max_words=6000, max_grams=3000)
    assert len(model.languages) == 300 and len(model.words.count) <= 6000 and all(len(t.count) <= 3000 for t in model.grams.values())
    got = lang.predict_languages(df, model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got)
    assert lang.fair_shares({"a": 5, "b": 100, "c": 1000, "d": 2}, 107) == {"d": 2, "a": 5, "b": 50, "c": 50}
    u = [r["u"] for r in spark.range(2000).select(unit_hash(F.col("id")).alias("u")).collect()]
    assert 0 <= min(u) < 0.01 and 0.99 < max(u) <= 1 and abs(sum(u) / 2000 - 0.5) < 0.03


def test_language_edges(spark):
    df = docs(spark, "the cat and the dog", None, "", "123").unionByName(docs(spark, "der Hund und die Katze", lang="de")).withColumn("doc_id", F.monotonically_increasing_id())
    kept = lang.identify_languages(df, usable=F.lit(True))
    assert {r["lang_pred"] for r in kept.collect()} == {"en", "de"} and set(kept.columns) == {*df.columns, "lang_pred"}
    assert lang.identify_languages(df.limit(0)).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert lang.predict_languages(unlabelled, lang.fit_language_model(unlabelled)).where("lang_pred <> 'und'").count() == 0


# Tokens


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path(tok.VOCABULARY)


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 4), (200, 16), (1000, 64)])
def test_chunked_counts_equal_whole_counts(vocabulary, chunk, overlap):
    rng = random.Random(chunk)
    texts = ["a" * 700, " " * 300, "    x" * 90, "日本語テキスト" * 60, "😀é ü\n\n\t" * 80, "<s></s><unk>" * 40, "thtionre of the andanwhorat " * 30, "no-spaces" * 100]
    texts += ["".join(rng.choice("ab  \n.é日😀-") for _ in range(600)) for _ in range(30)]
    counter = tok.PieceCounter(vocabulary, chunk, overlap, chunk)
    assert [counter.count_long(t) for t in texts] == [len(x) for x in counter.model.encode(texts)]


def test_chunks_without_a_boundary_stay_linear(vocabulary):
    counter = tok.PieceCounter(vocabulary)
    encoded, starts = [], counter.starts
    counter.starts = lambda text, a, b: encoded.append(b - a) or starts(text, a, b)
    rng = random.Random(4)
    for text in ("a" * 1_000_000, "".join(rng.choice("abcdefgh") for _ in range(300_000)), "the of and " * 20_000):
        encoded.clear()
        assert counter.count_long(text) == len(counter.model.encode(text)) and sum(encoded) < 4 * len(text)


def test_token_query_equals_the_library(spark, vocabulary):
    model = tok.PieceCounter(vocabulary).model
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op4_token_count"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n = len(model.encode(r["text"] or ""))
        assert got[r["doc_id"]] == (len((r["text"] or "").encode()), n, n > 4096)


def test_token_edges(spark, vocabulary):
    got = {r["doc_id"]: tuple(r)[1:] for r in tok.count_tokens(docs(spark, None, "", "é", "word " * 9000)).collect()}
    assert got[0] == got[1] == (0, 0, False) and got[2][0] == 2
    counter = tok.PieceCounter(vocabulary)
    assert got[3] == (45000, len(counter.model.encode("word " * 9000)), True)
    assert tok.count_tokens(docs(spark, "a").limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    assert sorted(map(tuple, tok.count_tokens(odd).collect()), key=str) == sorted([(None, 3, 2, False), (1, 3, 2, False), (1, 3, 2, False)], key=str)


# Chat


def test_chat_round_trip_of_control_strings():
    texts = ["", "plain", "<|end|>\n", "\\", "\\<|", "<\\|", "<|turn user|>\nx\n<|end|>\n", "a<", "|>", "\\n\\p\\\\", "\n<|end|>\n<|turn assistant|>\n"]
    for text in texts:
        for role in ("user", "assistant", "odd|>\n\\role", ""):
            formatted, start, end, _ = chat.format_turn(role, [{"type": "text", "text": text}])
            body = formatted.removeprefix(chat.HEAD)
            head, _, rest = body.partition(chat.MIDDLE)
            assert (chat.unescape(head), chat.unescape(rest.removesuffix(chat.END))) == (role, text)
            assert formatted.count("<|") == 2 and (start is None) == (role != "assistant")
            assert start is None or chat.unescape(formatted[start:end]) == text


def test_typed_parts_become_ordered_placeholders(spark):
    parts = [("text", "see <|x", None, None, None, None, None), ("image", None, "i.png", 56, 57, None, None), ("audio", None, "a.wav", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 2), ("odd", None, "o", None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, None, None)], f"conv_id long, turn long, role string, parts array<struct<{chat.PART_SCHEMA}>>".replace("type string", "type: string"))
    first, second = chat.format_conversations(df).orderBy("turn").collect()
    assert first["formatted"] == "<|turn user|>\nsee <\\|x<|image 0|><|audio 1|><|document 2|><|other 3|>\n<|end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in first["attachments"]] == [("image", "i.png", 6), ("audio", "a.wav", 38), ("document", "d.pdf", 800), ("other", "o", 0)]
    assert second["formatted"] == "<|turn |>\n\n<|end|>\n" and second["attachments"] == []


def test_conversations_read_back_in_order(spark):
    rows = [(5, 1, "assistant", "B"), (5, 0, "user", "A"), (5, None, "system", None), (None, 0, "assistant", "z"), (5, 2, "assistant", "C"), (5, 2, "assistant", "C")]
    part = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", part)
    df = df.withColumn("formatted", F.lit("clash")).withColumn("n_turns", F.lit("clash")).withColumn("loss_start", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[5]["n_turns"], got[5]["loss_chars"], got[5]["loss_sha256"]) == (5, 3, sha("BCC"))
    assert got[5]["turns_sha256"] == sha("system\n\nuser\nA\nassistant\nB\nassistant\nC\nassistant\nC\n") and got[None]["n_turns"] == 1
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# Toxicity


def test_toxicity_held_out_and_folding(spark):
    rng = random.Random(5)
    common = [f"word{chr(97 + a)}{chr(97 + b)}" for a in range(8) for b in range(8)]
    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        words = [rng.choice(common) for _ in range(60)]
        if bad:
            words[rng.randrange(60)] = rng.choice(["vileword", "nastyone", f"grubb{rng.choice(common)[4:]}"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = tox.fit_lexicon(df, marks)
    got = tox.score_toxicity(df, lexicon).join(marks.where("toxic is not null"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and all(r["predicted"] == r["toxic"] for r in got)
    matcher = lexicon.matcher()
    for text in ("you V1LEWORD", "you vіlewоrd", "a n@styone here", "grubbxyz"):
        assert lexicon.score(matcher, text) >= tox.CUT, text
    assert lexicon.score(matcher, None) == lexicon.score(matcher, "") == lexicon.score(matcher, "12345 wordaa") == 0.0
    spared = tox.Lexicon(lexicon.terms, lexicon.prior, ("vileword club",))
    assert spared.score(spared.matcher(), "the vileword club") == 0.0 < spared.score(spared.matcher(), "the vileword house")
    longer = " ".join(["wordaa"] * 20000)
    assert lexicon.score(matcher, f"vileword {longer}") < lexicon.score(matcher, "vileword")


def test_copies_of_a_toxic_document_are_no_evidence(spark):
    rng = random.Random(8)
    common = [f"word{chr(97 + a)}{chr(97 + b)}" for a in range(16) for b in range(16)]
    rows, labels = [], []
    for k in range(800):
        words = [rng.choice(common) for _ in range(40)]
        if k % 8 == 0:
            words[rng.randrange(40)] = "vileword"
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 8 == 0)))
    copied = " ".join([rows[0][1]] + [f"harmless{w}" for w in common[:20]])
    rows += [(1000 + k, copied if k % 2 else copied.upper().replace("VILE", "V1LE")) for k in range(400)]
    labels += [(1000 + k, 1) for k in range(400)]
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = tox.fit_lexicon(df, marks)
    got = tox.score_toxicity(df, lexicon).join(marks, "doc_id").where("held_out").collect()
    assert len(got) > 200 and all(r["predicted"] == r["toxic"] for r in got)
    assert lexicon.terms and all(t.startswith(" vile") for t in lexicon.terms)


def test_toxicity_query_equals_a_plain_search(spark):
    """The automaton's matches against a look at every word; learned from the same table."""
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    lexicon = tox.fit_lexicon(table, spark.read.parquet(f"{sf}/labels.parquet"))
    assert lexicon.terms

    def plain(text):
        words = tox.folded_words(text)
        spared = {i + k for p in lexicon.exceptions for i in range(len(words)) if words[i : i + len(p.split())] == p.split() for k in range(len(p.split()))}
        n, evidence = Counter(), -lexicon.prior
        for word, i in {word: i for i, word in enumerate(words) if i not in spared}.items():
            fits = [(often / share, t) for t, (often, share, _) in lexicon.terms.items() if f" {word} ".startswith(t)]
            if fits and i not in spared:
                n[max(fits)[1]] += 1
        for t, k in n.items():
            often, share, present = lexicon.terms[t]
            each = math.log(1 + often / (share * (len(words) + 20)))
            evidence += max(0.0, min(k * each - often, present + (k - 1) * each))
        return 1.0 - math.exp(-max(0.0, evidence) / 8) if n else 0.0

    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    for r in QUERIES["op6_toxicity"](spark, sf).collect():
        assert r["score"] == pytest.approx(plain(texts[r["doc_id"]])) and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    matcher = lexicon.matcher()
    term = max(lexicon.terms, key=lambda t: lexicon.terms[t][0] / lexicon.terms[t][1]).strip()
    for text in (f"the {term} trash can {term} idiot proof", "trash can", f"{term}{term}", " ".join([term, "word"] * 30_000)):
        assert lexicon.score(matcher, text) == pytest.approx(plain(text))


def test_held_out_toxicity_in_every_language(spark):
    """Of each language 0.9 of the toxic documents or more, and few false alarms; words that only share letters with a term score 0."""
    sf = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lexicon = tox.fit_lexicon(table, labels)
    marked = table.join(labels, "doc_id").where(is_held_out(F.col("doc_id"))).select("doc_id", "text", "lang", F.col("toxic").alias("label"))
    got = tox.score_toxicity(marked, lexicon).join(marked, "doc_id").groupBy("lang").agg(F.count_if(F.expr("label = 1 and predicted = 1")).alias("hit"), F.count_if(F.expr("label = 1")).alias("all"), F.count_if(F.expr("label = 0 and predicted = 1")).alias("false"))
    told = {r["lang"]: (r["hit"], r["all"], r["false"]) for r in got.collect()}
    assert set(told) == {"en", "de", "fr", "es"} and all(hit >= 0.9 * n for hit, n, _ in told.values()), told
    assert sum(f for *_, f in told.values()) <= 3, told
    matcher = lexicon.matcher()
    for text in ("the path to the hill", "a worthy cause", "a pathologist from Morocco", "a lost idea of stupor and disgust"):
        assert lexicon.score(matcher, text) == 0.0, text


def test_terms_have_occurrences_of_their_own():
    significance = lambda a, b: float(a - 10 * b)
    one_word = {" pathetic ": (50, 0), " pathetic": (50, 0), " path": (50, 0), " pat": (51, 3)}
    assert tox.separate_terms(one_word, significance, 5.0) == {" pathetic "}
    endings = {" grub": (60, 1), " grubaa ": (20, 0), " grubab ": (20, 0), " grubac ": (20, 0), " gru": (64, 30)}
    assert tox.separate_terms(endings, significance, 5.0) == {" grub"}
    assert tox.separate_terms({" abc": (9, 0)}, significance, 10.0) == set()


def test_folding_of_foreign_letters():
    assert tox.folded_words("ＶＩＬＥ 𝐯𝐢𝐥𝐞 𝓿𝓲𝓵𝓮 v\u200bi\u00adle VІLЕ vıle ᴠɪle".replace("ɪ", "i")) == ["vile"] * 7
    assert tox.folded_words("naïve façade Straße 1234 x86") == ["naïve", "façade", "straße", "1234", "xbb"]


def test_the_sample_of_labels_is_bounded_at_any_size(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.when(F.col("id") % 4 == 0, "vileword x").otherwise("y z"), F.lit(" "), F.col("id")).alias("text"))
    marks = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    lexicon = tox.fit_lexicon(df, marks, max_docs=150)
    assert " vileword " in lexicon.terms and not any(t.strip() in ("word", "y", "z") for t in lexicon.terms)


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = tox.score_toxicity(docs(spark, None, "", "text"), tox.fit_lexicon(docs(spark, "a"), none)).collect()
    assert [(r["score"], r["predicted"]) for r in got] == [(0.0, 0)] * 3
    assert tox.score_toxicity(docs(spark, "a").limit(0), tox.Lexicon({})).count() == 0
    odd = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert [r["held_out"] for r in tox.score_toxicity(odd, tox.Lexicon({" a ": (2.0, 1e-6, 9.0)})).where("doc_id is null").collect()] == [False]
    assert tox.score_toxicity(odd, tox.Lexicon({" a ": (2.0, 1e-6, 9.0)})).where("predicted = 1").count() == 3
    ids = spark.range(50)
    assert [r["h"] for r in ids.select(is_held_out(F.col("id")).alias("h")).collect()] == [zlib.crc32(str(k).encode()) % 4 == 2 for k in range(50)]


# Pages


def test_article_without_its_surroundings():
    prose = "It was the best of the days for a walk in the park with the dog, and the sun was out over the hill as the bells of the town rang for noon."
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>x";</script></head><body class="no-sidebar">
    <header><p>{prose}</p></header><nav><ul><li><a href=1>Home</a></li></ul></nav><!-- <p>{prose}</p> --><div class="ad">{prose}</div><div id="cookie-notice">{prose}</div>
    <article><header><h1>Title &amp; more</h1></header><p><b>{prose}<br>And&nbsp;with.<p>Short one.</p><p>{prose}</p><p class="share-buttons">Tell your friends of it in the park</p>
    <ul><li>first thing<li>second thing</ul><form><p>{prose}</p></form></article><aside>{prose}</aside><section class="comments"><p>{prose}</p></section><footer>&copy; me</footer>"""
    want = ["Title & more", f"{prose} And with.", "Short one.", prose, "first thing", "second thing"]
    assert pages.main_text(page) == "\n\n".join(want)


@pytest.mark.parametrize("name", ["layout has-sidebar", "content with-sidebar", "no-sidebar", "layout sidebar", "header"])
def test_a_wrapper_does_not_silence_the_article(name):
    prose = "It was the best of the days for a walk in the park with the dog, and the sun was out over the hill as the bells of the town rang for noon."
    parts = f'<div class="comments"><p>{prose}</p></div><div class="related-posts"><article><p>{prose}</p></article></div>'
    assert pages.main_text(f'<body><div class="{name}"><article><h1>Title</h1><p>{prose}</p><p>{prose}</p></article>{parts}</div>') == f"Title\n\n{prose}\n\n{prose}"
    assert pages.main_text(f'<body><div class="{name}"><p>{prose}</p><p>{prose}</p></div><div class="comments"><p>{prose}</p></div>') == f"{prose}\n\n{prose}"


def test_sections_and_headings_named_for_what_they_hold_stay():
    prose = "It was the best of the days for a walk in the park with the dog, and the sun was out over the hill as the bells of the town rang for noon."
    names = ["related-work", "search-results-analysis", "market-share", "social-history", "navier-stokes", "search"]
    inside = "".join(f'<section id="{n}"><h2 id="{n}">About {n}</h2><p>{prose}</p></section>' for n in names)
    assert pages.main_text(f"<article>{inside}</article>") == "\n\n".join(f"About {n}\n\n{prose}" for n in names)
    comments = f'<div class="comment-list">{"".join(f"<article class=comment-body><p>{prose}</p></article>" for _ in range(5))}</div>'
    assert pages.main_text(f"<main><article><p>{prose}</p></article><section id='comments'><p>{prose}</p></section>{comments}</main>") == prose
    assert pages.main_text(f'<div class="post"><p>{prose}</p></div><div class="comments"><p>{prose}</p><p>{prose}</p></div>') == prose


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("just words", ""), ("<p", ""), ("<article>Hi &amp;&#x41;&lt;b&gt; there</artic", "Hi &A<b> there"), ("<script>x", ""), ("<article><p>a<!-- b", "a"), ("<main><p title='a>b'>c  d\n e</p>", "c d e")])
def test_odd_pages(page, text):
    assert pages.main_text(page) == text


PROSE = "It was the best of the days for a walk in the park with the dog, and the sun was out over the hill as the bells of the town rang for noon."
CAT = "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所でニャーニャー泣いていた事だけは記憶している。"
DAY = "Это был лучший из дней для прогулки в парке с собакой, и солнце светило над холмом, когда колокола города пробили полдень для всех жителей этого места."
DZIEN = "Był to najlepszy dzień na spacer po parku z psem, słońce świeciło nad wzgórzem, gdy dzwony miasta wybiły południe, a wszyscy mieszkańcy tego miejsca szli razem drogą nad rzeką."


@pytest.mark.parametrize(("page", "text"), [
    (f'<article><header class="entry-header"><h1>Title</h1><p class="meta">By me</p></header><p>{PROSE}</p></article>', f"Title\n\nBy me\n\n{PROSE}"),
    (f'<div id="search-results-page"><main><p>{PROSE}</p></main></div>', PROSE), (f'<section class="social-science"><article><p>{PROSE}</p></article></section>', PROSE),
    ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2 in tex</annotation></math> then.</p></article>", "So x=2 then."),
    (f'<nav><a href="/">家</a></nav><div class="text"><p>{CAT}</p><p>短い。</p><p>{CAT}</p></div><div class="comments"><p>{CAT}</p></div><footer>{CAT}</footer>', f"{CAT}\n\n短い。\n\n{CAT}"),
    (f"<p>{DAY}</p><p>{DAY}</p>", f"{DAY}\n\n{DAY}"), (f"<p>{DZIEN}</p>", DZIEN), (f"<p>{' '.join(f'key{k}' for k in range(60))}</p><p>{PROSE}</p>", PROSE),
    ("<article><p>" + "word of it " * 60_000 + "</p></article>", ("word of it " * 60_000).strip()),
])
def test_pages_of_other_makes(page, text):
    assert pages.main_text(page) == text


def test_ambiguous_blocks_follow_their_neighbours():
    good = "It was the best of the days for a walk in the park with the dog, and the sun was out over the hill as the bells of the town rang for noon."
    bad = " ".join(f"<a href={k}>Link number {k}</a>" for k in range(9))
    assert pages.main_text(f"<div>{bad}</div><div>lost</div><div>{bad}</div><p>{good}</p><p>between</p><p>{good}</p>") == f"{good}\n\nbetween\n\n{good}"


PROSE = "It was the best of the days for a walk in the park with the dog, and the sun was out over the hill as the bells of the town rang for noon."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>{PROSE}</p><ul><li><a href=1>See the docs</a></li></ul><p><a href=2>The full report</a></p><p>{PROSE}</p></article>", [PROSE, "See the docs", "The full report", PROSE]),
        (f"<article><p><a href=1>{PROSE}</a></p></article>", [PROSE]),
        (f"<main><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><p>{PROSE}</p><p><a>The report</a></p><p>{PROSE}</p></main>", [PROSE, "The report", PROSE]),
        (f"<article><p>{PROSE}</p></article><div class='discussion'><p>{PROSE}</p></div>", [PROSE]),
        (f"<article><p>{PROSE}</p></article><div class='reader-responses'><p>{PROSE}</p></div>", [PROSE]),
        (f"<h1>Title</h1><article><p>{PROSE}</p><p>{PROSE}</p></article><div class='what-you-said'><p>{PROSE}</p></div>", ["Title", PROSE, PROSE]),
        (f"<div class=post><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div><div class='talkback'><p>{PROSE}</p></div>", ["T", PROSE, PROSE]),
        (f"<body><form id=aspnetForm><nav><a>Home</a></nav><div><h1>T</h1><p>{PROSE}</p></div></form>", ["T", PROSE]),
        (f"<body><form id=aspnetForm><article><p>{PROSE}</p></article></form>", [PROSE]),
        (f"<article><p>{PROSE}</p><form><p>{PROSE}</p></form><p>{PROSE}</p></article>", [PROSE, PROSE]),
        (f"<body><header class=post-header><h1>Title</h1></header><div class=post><p>{PROSE}</p></div>", ["Title", PROSE]),
        (f"<body><header class=site-header><h1>Site</h1></header><div class=post><p>{PROSE}</p></div>", [PROSE]),
        (f"<article><p><![CDATA[{PROSE} <b> & x]]></p></article>", [f"{PROSE} <b> & x"]),
    ],
)
def test_links_comments_forms_and_titles(page, text):
    assert pages.main_text(page) == "\n\n".join(text)


def test_many_hints_are_read_in_one_pass():
    began = time.perf_counter()
    nested = "<div class=comments>" * 10_000 + f"<p>{PROSE}</p>" + "</div>" * 10_000
    assert pages.main_text(f"<body><div><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div>{nested}") == f"T\n\n{PROSE}\n\n{PROSE}"
    flat = f"<div class=comments><p>{PROSE}</p></div>" * 4000
    assert pages.main_text(f"<article><p>{PROSE}</p></article>{flat}") == PROSE
    assert time.perf_counter() - began < 6  # a fraction of this, on a machine that does nothing else


def test_pages_edges(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<article>é</article>", "y"), (1, None, None, "x")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, pages.extract_pages(df).collect()), key=str) == sorted([(1, None, "", 0), (None, "u", "é", 1), (1, None, "", 0)], key=str)
    assert pages.extract_pages(df.limit(0)).count() == 0


def test_every_test_page_gives_its_article(spark):
    for row in QUERIES["op8_html_extract"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", row["html"], re.S)[1]
        words = re.sub(r"<[^>]*>", " ", inside).replace("&amp;", "&").replace("&quot;", '"').split()
        assert row["text"].split() == words and row["n_chars"] == len(row["text"])


# Licenses


def plain_license_counts(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [k for p in lic.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    labels = {lic.PHRASES[p] for p in lic.PHRASES if any(words[k : k + len(p.split())] == p.split() for k in range(len(words)))}
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_phrases_match_plain_python(spark):
    texts = [None, "", "CC-BY 4.0, cc by cc by", "the GNU General-Public  License!", "All rights\nreserved. ALL RIGHTS RESERVED", "allrights reserved", "É cc by", "K cc by"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for k, row in enumerate(lic.scan_licenses(docs(spark, *texts)).orderBy("doc_id").collect()):
        assert tuple(row)[1:6] == plain_license_counts(texts[k]), texts[k]
        assert set(filter(None, row["base_labels"].split(","))) <= set(filter(None, row["labels"].split(","))) and 0 <= row["score"] <= 1


@pytest.mark.parametrize(("template", "text", "found"), [
    ("a b <<opt>>c d<</opt>> e", "x a b e", True), ("a b <<opt>>c d<</opt>> e", "a b c d e", True), ("a b <<opt>>c d<</opt>> e", "a b c e", False),
    ("a <<var 2>> z", "a z", True), ("a <<var 2>> z", "a x y z", True), ("a <<var 2>> z", "a w x y z", False), ("<<opt>>the<</opt>> a <<opt>>b <<opt>>c<</opt>><</opt>> d", "a b d", True),
    ("<<opt>>the<</opt>> a <<opt>>b <<opt>>c<</opt>><</opt>> d", "a c d", False), ("a a b", "a a a b", True),
])
def test_template_automata(template, text, found):
    assert lic.TokenAutomaton(template).found_in(text.encode().split()) is found


def plain_template(template):
    """The template as a regular expression over words joined by single spaces."""
    out = ""
    for part in re.findall(r"<<[^>]*>>|[^<\s]+", template):
        if part == "<<opt>>":
            out += "(?:"
        elif part == "<</opt>>":
            out += ")?"
        elif part.startswith("<<var"):
            out += r"(?: [^ ]+){0,%s}" % part[6:-2]
        else:
            out += " " + re.escape(part)
    return re.compile(out + "(?= |$)")


def test_license_labels_equal_regular_expressions(spark):
    """Texts made from each template, as they are and with a word changed, by another matcher."""
    rng = random.Random(9)
    texts = []
    for of in lic.TEMPLATES.values():
        for template in of:
            words = [w for part in re.findall(r"<<[^>]*>>|[^<\s]+", template) for w in (["any", "one"] if part.startswith("<<var") else [] if part.startswith("<<") else [part])]
            short = re.sub(r"<<opt>>[^<]*<</opt>>", "", template)
            texts += [" ".join(words), re.sub(r"<<var \d+>>", "x", short) if "<<opt" not in short else " ".join(words)]
            changed = list(words)
            changed[rng.randrange(len(changed))] = "other"
            texts.append("Before, " + " ".join(changed).upper() + "; after")
    texts += [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    patterns = {label: [plain_template(t) for t in of] for label, of in lic.TEMPLATES.items()}
    found = set()
    for r in lic.scan_licenses(docs(spark, *texts), headings={}).collect():
        joined = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r["doc_id"]].lower()))
        want = {label for label, of in patterns.items() if any(p.search(joined) for p in of)}
        base = set(filter(None, r["base_labels"].split(",")))
        assert set(filter(None, r["labels"].split(","))) == want | base, texts[r["doc_id"]][:200]
        assert r["score"] == (1.0 if want else 0.5 if base else 0.0)
        found |= want
    assert found == set(lic.TEMPLATES)


@pytest.mark.parametrize(("text", "label"), [
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n\n TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "apache-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3.0"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "lgpl-2.1"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl-2.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"), ("licensed under CC BY-NC-SA 3.0", "cc-by-nc-sa-3.0"),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unlicense"),
])
def test_common_notices(text, label):
    assert label in lic.Scanner().scan(text)[5].split(",")


@pytest.mark.parametrize(("text", "labels"), [
    ("Content is available under CC BY-SA 4.0 unless said otherwise", "cc-by,cc-by-sa-4.0"), ("under the Attribution-ShareAlike License 4.0", "cc-by-sa-4.0"), ("CC0 1.0 Universal", "cc0-1.0"),
    ("MIT License\n\nCopyright (c) 2020 A. Person", "mit"), ("Apache License 2.0", "apache-2.0"), ("it is not the Apache License 2.0, though", ""),
    ("Released under the GNU GPL v3", "gpl-3.0"), ("licensed under GPLv2", "gpl-2.0"), ("distributed under LGPL v2.1", "lgpl-2.1"), ("under the terms of the GNU Affero General Public License v3", "agpl-3.0,gpl"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.", "gpl,gpl-3.0"),
    ("It is not licensed under the MIT License.", ""), ("never released under the MIT License", ""), ("Not this one, which is licensed under the MIT License", "mit"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2.0,mit"), ("// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause */", "bsd-3-clause,classpath-exception-2.0,gpl-2.0"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0-or-later"), ("SPDX-License-Identifier: LGPL-2.1+ here it ends", "lgpl-2.1-or-later"), ("SPDX-License-Identifier: EUPL-1.2", "eupl-1.2"), ("SPDX-License-Identifier:", ""),
    ("distributed under the Boost Software License, Version 1.0.", "bsl-1.0"), ("Licensed under the Eclipse Public License v2.0", "epl-2.0"),
])
def test_common_wordings(text, labels):
    assert lic.Scanner().scan(text)[5] == labels


def test_typographic_signs_hinder_no_template():
    plain = re.sub(r"<<opt>>([^<]*)<</opt>>", r"\1", re.sub(r"<<var \d+>>", "the authors", lic.TEMPLATES["mit-text"][0])).replace("the software to deal", "(the “Software”) to deal").replace("as is", "“as is”")
    n_words, *_, labels, score = lic.Scanner().scan(plain)
    assert labels == "mit-text" and score == 1.0 and n_words == len(plain.replace("(", "").split())


def test_license_labels_and_edges(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    got = [r["labels"] for r in lic.scan_licenses(docs(spark, "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", mit)).orderBy("doc_id").collect()]
    assert got == ["cc-by,cc-by-nc-4.0", "gpl,gpl-3.0", "mit", ""]
    assert lic.scan_licenses(docs(spark, "a").limit(0)).count() == 0 and json.dumps(got)
    odd = spark.createDataFrame([(None, "cc by"), (1, "cc by"), (1, "cc by"), (2, "pad " * 100_000 + "cc by")], "doc_id long, text string").withColumn("labels", F.lit("x"))
    assert sorted((r["n_words"], r["first_word"], r["labels"]) for r in lic.scan_licenses(odd).collect()) == [(2, 0, "cc-by")] * 3 + [(100_002, 100_000, "cc-by")]
