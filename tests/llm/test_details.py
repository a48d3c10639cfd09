import pytest

from termloom.llm import pii, pii_training


@pytest.fixture(scope="module")
def model():
    return pii.SemiCrf.load()


def said(model, text):
    return [(k, text[s:e]) for s, e, k in model.decode(text)]


@pytest.mark.parametrize("number", ["AB-1234567", "AB.1234567", "AB/1234567", "X-1234567-L", "1234567-L"])
def test_letter_groups_behind_a_separator_belong_to_the_number(model, number):
    text = f"see passport {number}, please"
    assert number in {text[s:e] for s, e, k, _ in pii.number_candidates(text) if k == "id_number"}
    assert said(model, text) == [("id_number", number)]


@pytest.mark.parametrize("name", ["Marek Novotny", "Wei Li", "Sean O'Brien", "Anna Maria Schmidt", "Jean-Pierre Martin", "Priya Patel", "Wei Zhang", "Ahmed Khan", "Mohammed Al-Farsi", "Okafor, Ngozi", "J. R. van der Meer"])
def test_names_of_any_origin(model, name):
    assert said(model, f"Name: {name}\nPhone: (617) 555-0177") == [("person_name", name), ("phone", "(617) 555-0177")]
    assert said(model, f"The patient, {name}, came back.") == [("person_name", name)]


def test_small_letters_behind_a_title_or_a_known_word(model):
    assert said(model, "we saw Dr. ahmed khan and mrs marta nowak") == [("person_name", "ahmed khan"), ("person_name", "marta nowak")]


@pytest.mark.parametrize("text,found", [("He lives at 221B Baker Street.", ("street_address", "221B Baker Street")), ("ID 12 345 678 901", ("id_number", "12 345 678 901")), ("write to jane.roe at example dot org now", ("email", "jane.roe at example dot org")), ("Wir wohnen in der Alte Schönhauser Str. 12, Ort.", ("street_address", "Alte Schönhauser Str. 12")), ("Send it to 12 rue de la Grande Fontaine, please", ("street_address", "12 rue de la Grande Fontaine")), ("They met at 5 Old Mill House Lane today", ("street_address", "5 Old Mill House Lane")), ("Tel. 00 44 20 79 46 09 58 12", ("phone", "00 44 20 79 46 09 58 12"))])
def test_extents(model, text, found):
    assert said(model, text) == [found]


@pytest.mark.parametrize("text", ["Dr. Hansen did not agree.", "The Hansen Institute opened.", "Hansen et al. (1999) disagree.", "Hansen's disease is rare.", "Lot 4411-23, grant 12-345.", "It rose from 1980-01-02 to 1990-03-04.", "Enzymes, Alkaline | Lipids, Neutral, Type II", "@carla_9 wrote; see https://x.org/a/1234567"])
def test_what_is_no_detail(model, text):
    assert said(model, text) == []


def test_recall_on_sentences_and_names_that_were_not_fitted(model):
    assert not set(pii_training.HELD_GIVEN) & set(pii_training.GIVEN) and not set(pii_training.HELD_FAMILY) & set(pii_training.FAMILY)
    assert not set(pii_training.HELD_WITH) & set(pii_training.WITH) and not set(pii_training.HELD_WITHOUT) & set(pii_training.WITHOUT)
    got = pii_training.accuracy(model, pii_training.held_out(99), 300)
    assert all(p > 0.93 and r > 0.85 for p, r in got.values()), got


def test_no_word_of_a_name_carries_weight(model):
    assert not any(x.lower() in f.lower().split("=")[-1].split(",") for f in model.weights for x in (*pii_training.GIVEN, *pii_training.FAMILY) if len(x) > 3)


def test_regions_lose_no_candidate_of_a_scan_over_all_groups():
    import random
    import re

    between = {"", " ", ".", "-", "/", ") ", ")", " (", "(", "-(", "\xa0"}
    r = random.Random(5)
    for _ in range(400):
        text = "".join(r.choice(["12", "345", "6", "A", "QB", "XYZ", "ab", "Ab", " ", "-", ".", "/", ") ", " (", "x", ", "]) for _ in range(24))
        atoms = [m.span() for m in re.finditer(r"\d+|(?<![A-Za-z])[A-Z]{1,2}(?![A-Za-z])", text)]
        want = set()
        for i, (s, _) in enumerate(atoms):
            digits = letters = 0
            for j in range(i, min(i + pii.MAX_ATOMS, len(atoms))):
                if j > i and text[atoms[j - 1][1] : atoms[j][0]] not in between:
                    break
                a, b = atoms[j]
                digits, letters = digits + (b - a) * text[a].isdigit(), letters + (not text[a].isdigit())
                if letters > 3 or digits > pii.MAX_DIGITS:
                    break
                if digits >= 6 + (letters == 0) and "(" not in text[s:b] and ")" not in text[s:b] and text[s - 1 : s] not in ("(", "+"):
                    want.add((s, b))
        assert want <= {(s, e) for s, e, _, _ in pii.number_candidates(text)}


def test_null_empty_and_long_texts(spark):
    long = "word " * 200_000 + "Name: Priya Patel"
    df = spark.createDataFrame([(1, None), (2, ""), (3, long), (None, "Name: Wei Li\n"), (3, long)], "doc_id long, text string")
    got = sorted(map(tuple, pii.find(df, "doc_id", "text").select("doc_id", "kind", "val").collect()), key=str)
    assert got == [(3, "person_name", "Priya Patel"), (3, "person_name", "Priya Patel"), (None, "person_name", "Wei Li")]
    assert pii.find(df.limit(0), "doc_id", "text").count() == 0
    red = {r["doc_id"]: r["text"] for r in pii.redact(df.where("doc_id < 3"), "doc_id", "text").collect()}
    assert red == {1: None, 2: ""}
