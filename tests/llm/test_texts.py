import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from termloom.llm import leakage, pii, pii_training, tokens

TEXTS = ["Hello  world\n\n it's 42's!", "", None, " ", "naïve café — Zoë’s 🙂👩‍🔬 １２３", "<|endoftext|> is text", "a\xa0b c​d　e", "x" * 30_000, "tab\t\tend \r\n", "ࡰ\U000323af new letters 1", "中文摘要：样本数为 27", "Hello  world\n\n it's 42's!", "ё" * 500 + " 12½ ²"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i % 12, t, "c", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, word string, codes int")


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokens.vocabulary())
    t.encode_special_tokens = True
    return [None if x is None else t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("head", [32_768, 3])
def test_ids_equal_the_tokenizer(spark, docs, monkeypatch, head):
    monkeypatch.setattr(tokens, "HEAD_WORDS", head)
    got = [(r.doc_id, r.ids) for r in tokens.encode_corpus(docs, "doc_id", "text").collect()]
    want = [(i % 12, ids) for i, ids in enumerate(whole(TEXTS))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_decoding(spark, docs):
    one = docs.dropDuplicates(["doc_id"])
    back = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(one, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {r.doc_id: r.text for r in one.collect()}
    assert tokens.encode_corpus(docs.limit(0), "doc_id", "text").count() == 0


def test_decoding_of_any_ids(spark):
    ids = [tokens.pieces().index(b) for b in ("é".encode()[:1], "é".encode()[1:], b"a")]
    df = spark.createDataFrame([(1, [ids[0], ids[1], ids[2]]), (1, [ids[0]]), (2, []), (None, None), (3, [10**6, -5, None, ids[2]])], "k long, ids array<int>")
    assert sorted(((r.k, r.text) for r in tokens.decode_corpus(df, "k", "ids").collect()), key=repr) == sorted([(1, "éa"), (1, "\ufffd"), (2, ""), (None, None), (3, "a")], key=repr)


def test_head_is_bounded_and_takes_long_frequent_words(spark, monkeypatch):
    rule = "-" * 5000
    df = spark.createDataFrame([(i, f"{rule} w{i}") for i in range(64)], "row long, text string")
    got = {r.row: r.ids for r in tokens.encode_corpus(df, "row", "text").collect()}
    assert got == dict(enumerate(whole([f"{rule} w{i}" for i in range(64)])))
    table = tokens.distinct_words(df, "text", tokens.vocabulary()).cache()
    assert {r.word for r in tokens.head_of(table).collect()} >= {rule, " w"}
    monkeypatch.setattr(tokens, "HEAD_WORDS", 5)
    some = {r.word for r in tokens.head_of(table).collect()}
    assert some >= {rule, " w"} and len(some) <= 5
    monkeypatch.setattr(tokens, "HEAD_BYTES", 100)
    assert tokens.head_of(table).count() == 0


def brute_leaks(text, items, n):
    words = leakage.WORD.findall(leakage.normalised(text))
    mine = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    out = set()
    for k, t in items:
        w = leakage.WORD.findall(leakage.normalised(t))
        if any(tuple(w[i : i + n]) in mine for i in range(len(w) - n + 1)):
            out.add(k)
    return out


def found_in(automaton, texts):
    matcher = leakage.Matcher("")
    matcher.only = [leakage.Block(automaton.packed())]
    return matcher.find(texts)


def test_places_of_words():
    for t in ("a b-c", "ΠΡΟΣ ΛΟΓΟΣ x", "ﬁne ½ e\u0301te\u0301 ①", "", "Zu\u0308rich—ﬃ\u00a0x"):
        places = leakage.word_places(t)
        words = leakage.WORD.findall(leakage.normalised(t))
        assert len(places) == len(words) and all(leakage.normalised(t[a:b]).find(w) >= 0 or w in leakage.normalised(t) for (a, b), w in zip(places, words, strict=True))
    t = "ΛΟΓΟΣ then x"
    assert [t[a:b] for a, b in leakage.word_places(t)] == ["ΛΟΓΟΣ", "then", "x"]


def test_cleaning_rows_with_null_or_repeated_keys(spark):
    items = spark.createDataFrame([(10, PASSAGE)], "item_id long, text string")
    rest = "and then a good deal more of text that stands alone here for the rest of it, twenty words or so to keep the share low ΛΟΓΟΣ."
    docs = spark.createDataFrame([(None, f"{PASSAGE} {rest}"), (1, f"{PASSAGE} {rest}"), (1, rest)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_removed, r.dropped) for r in leakage.cleaned(docs, "doc_id", "text", items, "item_id", "text").collect()), key=repr)
    assert got == sorted([(None, f" {rest}", 18, False), (1, f" {rest}", 18, False), (1, rest, 0, False)], key=repr)


def test_text_item_keys(spark, leak_docs):
    items = spark.createDataFrame([("q-1", PASSAGE)], "item_id string, text string")
    assert {r.item_id for r in leakage.leaks(leak_docs, "doc_id", "text", items, "item_id", "text").collect()} == {"q-1"}


def test_automaton_against_brute_force():
    r = random.Random(8)
    for n in (1, 2, 4):
        for _ in range(60):
            items = [(k, " ".join(r.choices("abc", k=r.randint(0, 14)))) for k in range(5)]
            text = " ".join(r.choices("abcd", k=40))
            texts = [text, " ".join(r.choices("abcd", k=9)), text]
            found = found_in(leakage.Automaton(items, n), texts)
            assert [{x[0] for x in f} for f in found] == [brute_leaks(t, items, n) for t in texts] and found[0] == found[2]
            for t, runs in zip(texts, found, strict=True):
                words = t.split()
                for item, s, e in runs:
                    grams = dict(items)[item].split()
                    tied = [any(words[i : i + n] == grams[j : j + n] for j in range(len(grams))) for i in range(len(words) - n + 1)]
                    assert all(tied[s : e - n + 1]) and (s == 0 or not tied[s - 1]) and (e - n + 1 == len(tied) or not tied[e - n + 1])
                    assert all(any(words[i : i + n] == grams[j : j + n] for j in range(len(grams))) for i in range(s, e - n + 1))


PASSAGE = "The quick brown fox of Zürich jumps over 13 lazy dogs while the ﬁrst bell rings at noon"


@pytest.fixture(scope="module")
def leak_docs(spark):
    rows = [(1, f"Before. {PASSAGE.upper().replace(' ', '  -- ')} After all of it, and then a good deal more of text that stands alone here for the rest of it, twenty words or so to keep the share low."), (2, PASSAGE), (3, " ".join(PASSAGE.split()[:11])), (4, None), (5, ""), (6, unicodedata.normalize("NFD", f"Ä {PASSAGE} ö " + "w " * 60))]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(-1))


def test_leaks_and_cleaning(spark, leak_docs):
    items = spark.createDataFrame([(10, PASSAGE), (11, "too short"), (12, None)], "item_id long, text string")
    got = leakage.leaks(leak_docs, "doc_id", "text", items, "item_id", "text")
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 10), (2, 10), (6, 10)]
    clean = {r.doc_id: r for r in leakage.cleaned(leak_docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert clean[1].text.startswith("Before.  After") and clean[1].n_removed == 18 and not clean[1].dropped
    assert clean[2].dropped and clean[2].text is None and clean[2].coverage == 1.0
    assert clean[3].text and clean[4].text is None and not clean[4].dropped and clean[5].text == ""
    assert unicodedata.normalize("NFC", clean[6].text).startswith("Ä  ö w")
    assert leakage.leaks(leak_docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert leakage.leaks(leak_docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


def test_items_in_blocks(spark, leak_docs, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 5)
    items = spark.createDataFrame([(10, PASSAGE), (11, PASSAGE + " again")], "item_id long, text string")
    got = leakage.leaks(leak_docs, "doc_id", "text", items, "item_id", "text")
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(d, i) for d in (1, 2, 6) for i in (10, 11)}


def test_details_in_context():
    text = 'Dr. Novotny disagreed. Name: Zoë M. de Okafor\nAddress: 12b Mill-End Close, Town 12345\nPhone: (617) 555-0177\nE-mail: zoe_g [at] lab [dot] example [dot] org\nSSN: 000-12-3456, plates 12-345-678, @user_feed, https://x.example.org/item/5, Szabo et al. (1999), The Volkov Institute; MRN 12-345-678. Thanks to Tanaka, Anna, B. TANAKA and paul mensah.'
    got = [(k, text[s:e]) for s, e, k in pii.SemiCrf.load().decode(text)]
    assert got == [("person_name", "Zoë M. de Okafor"), ("street_address", "12b Mill-End Close"), ("phone", "(617) 555-0177"), ("email", "zoe_g [at] lab [dot] example [dot] org"), ("id_number", "000-12-3456"), ("id_number", "12-345-678"), ("person_name", "Tanaka, Anna"), ("person_name", "B. TANAKA"), ("person_name", "paul mensah")]


def test_accuracy_on_other_texts_of_the_same_sentences():
    for kind, (precision, recall) in pii_training.accuracy(pii.SemiCrf.load(), pii_training.Maker(99), 200).items():
        assert precision > 0.94 and recall > 0.87, kind


def test_gradient_is_that_of_the_likelihood():
    text, gold = pii_training.Maker(5).text()
    model = pii.SemiCrf({"n": 0.3, "p": -0.2, "e": 0.5, "i": 0.1, "s": 0.4}, pii.Words.load())
    _, grad = model.gradient(text, gold)
    for f in ("n", "p", "e"):
        if f in grad:
            w = model.weights[f]
            model.weights[f] = w + 1e-5
            up = model.gradient(text, gold)[0]
            model.weights[f] = w - 1e-5
            down = model.gradient(text, gold)[0]
            model.weights[f] = w
            assert (up - down) / 2e-5 == pytest.approx(grad[f], abs=1e-4)


def test_fitting_is_repeatable_and_learns():
    one = pii_training.fit(150, 2, 3)
    assert one.weights == pii_training.fit(150, 2, 3).weights
    assert all(r > 0.6 for _, r in pii_training.accuracy(one, pii_training.Maker(4), 80).values())


def test_find_and_redact(spark):
    long = "word " * 40_000 + "write to a.b@example.org now"
    df = spark.createDataFrame([(1, "Call +44 20 7946 0018, Ruth Novotny."), (1, "Call +44 20 7946 0018, Ruth Novotny."), (2, None), (3, ""), (4, long)], "doc_id long, text string").withColumn("kind", F.lit("clash"))
    found = pii.find(df, "doc_id", "text").collect()
    assert sorted({(r.doc_id, r.kind, r.val) for r in found}) == [(1, "person_name", "Ruth Novotny"), (1, "phone", "+44 20 7946 0018"), (4, "email", "a.b@example.org")]
    assert len(found) == 5 and next(r.start for r in found if r.doc_id == 4) == 200_009
    clean = [(r.doc_id, r.text) for r in pii.redact(df, "doc_id", "text").collect()]
    assert clean[0] == (1, "Call [PHONE], [PERSON_NAME].") and (2, None) in clean and (3, "") in clean
    assert pii.find(df.limit(0), "doc_id", "text").count() == 0
