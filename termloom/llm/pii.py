"""Personal information inside free text: a semi-Markov conditional random field over candidate segments.

A text is a sequence of segments: stretches without personal details (score 0) and entities of at most ``MAX_CHARS``
characters. Candidate entities are proposed generously, with every boundary alternative; each is scored as a whole from
features of the span and of what stands around it; dynamic programming over the boundaries chooses the best-scoring
non-overlapping set, so boundaries and types are settled jointly. The weights are fitted by ``pii_training``.

No list of names is used. A word counts as common or proper by what a public tokenizer's vocabulary says of it: whether it
became a token in lower case or with a capital first. What stands before and after a span, and its shape, do the rest.

Bounds of a candidate: ``MAX_CHARS`` characters; numbers of at most ``MAX_ATOMS`` groups and ``MAX_DIGITS`` digits (telephone numbers
have 15 at most, bank and insurance numbers 24 or so); names of at most ``MAX_WORDS`` capitalised words; street names of at most
four words. Names in small letters are looked for only behind a title, a relation, a role or a
label, and where they begin with a word known as proper.
"""

from __future__ import annotations

import base64
import json
import math
import os
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

import termloom.session  # noqa: F401

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
MAX_CHARS, MAX_ATOMS, MAX_DIGITS, MAX_WORDS = 90, 12, 24, 4
WEIGHTS = Path(__file__).with_name("pii_weights.json")
#: Public vocabularies (paths, or names of the installed public tokenizers) that tell common from proper words.
VOCABULARIES = ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken")

#: A word is proper when its form in small letters came this many times later than that with a capital, or never.
PROPER = 3
#: Particles of family names; words that stand before names, by what they are; words that follow names.
PARTICLES = "de van von der den di da du del la le dos das el ben bin al ter ten zu".split()
BEFORE = {
    "title": "dr prof professor mr mrs ms miss sir frau herr herrn mme mlle monsieur madame sr sra srta señor señora don doña doktor doctor docteur rev fr sig dra",
    "kin": "mother father sister brother wife husband son daughter spouse partner uncle aunt cousin parent guardian kin relative mutter vater schwester bruder ehefrau ehemann tochter sohn mère père sœur soeur frère épouse mari fille fils madre padre hermana hermano esposa esposo marido hija hijo",
    "role": "patient patiente patientin paciente participant volunteer subject proband probandin donor nurse physician surgeon technician pharmacist investigator author assistant secretary colleague student researcher supervisor coordinator manager director teacher witness reviewer editor reporter client tenant employee applicant caller neighbour neighbor midwife therapist carer infirmière médecin enfermera médico krankenschwester arzt ärztin",
    "label": "name names nom nombre contact kontakt contacto attn attention correspondence signed signature sender recipient from to cc bcc applicant holder owner",
    "and": "and und et y e & or oder ou o",
    "greet": "dear hello hi hey liebe lieber cher chère estimado estimada querido querida regards wishes sincerely faithfully yours thanks cheers greetings grüßen grüße cordialement saludos atentamente",
    "self": "it's i'm am named called heiße heißt m'appelle s'appelle llamo llama",
    "ask": "ask asks asked call calls called ring phone speak spoke spoken meet met see interview interviewed thank thanked contact write wrote letter mail",
    "article": "the a an this that these der die das ein eine le la les un une el los las",
}
PREPOSITIONS = "by with from for to of de von par durch bei an con por mit avec pour für para at in on into al du des del zur zum".split()
AFTER = {
    "bio": "born aged age geb geboren né née nacido nacida wohnhaft demeurant domiciliado domiciliada domicilio living residing lives tel telephone phone mobile fax email mail passport ssn nhs id mrn insurance who whose con",
    "article": "the a an this der die das ein eine le la les un une el los las our his her my your",
    "verb": "will would can could has have had is was are were does did said says wrote writes called calls asked asks signed came left lives works told gave took brings sent again hat ist war wird sagte schrieb est était dit es fue dijo tiene",
    "and": "and und et y &",
}
INSTITUTIONS = "institute institut instituto foundation society group committee atlas board office university hospital clinic trust agency council ministry journal company union museum school college association laboratory department centre center bank church library gallery airport station river lake mountain tower bridge street road lane avenue survey report survey project programme program database registry disease syndrome reaction test kinase receptor protein gene cell cells tissue acid model method type phase".split()
ENDINGS_OF_TERMS = "ine ase ide ate one itis osis oma emia phagy gen cyte cytes ium ous tion tions ing ment ments ness ity ism ology ies ics ions".split()
STREET_AFTER = "road|rd|lane|ln|close|drive|dr|street|st|avenue|ave|boulevard|blvd|court|ct|way|terrace|crescent|square|place"
STREET_BEFORE = "rue|avenue|boulevard|place|chemin|calle|avenida|plaza|via"

_before = {w: k for k, v in BEFORE.items() for w in v.split()} | {w: f"by:{w}" for w in PREPOSITIONS if w not in "from to"}
_after = {w: k for k, v in AFTER.items() for w in v.split()}
_asking = frozenset([*BEFORE["ask"].split(), "signed", "written", "reviewed", "checked", "thanks", "care", "talked", "talk", "name", "names", "case", "visit"])
_institutions = frozenset(INSTITUTIONS)
_term_endings = tuple(ENDINGS_OF_TERMS)
_particles = "|".join(PARTICLES)
_capital = regex.compile(r"(?<![\w@_])\p{Lu}(?:[\p{L}\p{M}]|['’](?=\p{L}{2}))*(?![\p{L}\p{M}\d_@])\.?")
_small_name = re.compile(rf"([^\W\d_]{{2,}}|[^\W\d_]\.)( [^\W\d_]\.)?((?: (?:{_particles})){{0,2}}) ([^\W\d_]{{2,}}(?:-[^\W\d_]{{2,}})?)(?![\w@])")
_cues = frozenset(f(w) for k in ("title", "kin", "role") for w in [*BEFORE[k].split(), "name", "contact"] for f in (str, str.capitalize, str.upper))
_cue_gap = re.compile(r"(?:\. |, | \(| ?: | )(?=[^\W\d_])")
_letters = re.compile(r"[^\W\d_]+")
_gap = re.compile(rf"[ \xa0\u2009\u202f]{{1,2}}((?:(?:{_particles}) ){{0,2}})$")
_marks = " \t\r\n.,:;!?()[]{}<>|\"'“”„«»‘’*-–—/&\xa0\u2009\u202f"
_at = re.compile(r"@|\s?[\[({]\s?(?i:at)\s?[\])}]\s?|\s(?i:at)\s(?=[\w\-]+\s(?i:dot)\s)")
_local = re.compile(r"[\w.+\-]{1,64}$")
_dot_form = r"(?:\.|\s?[\[({]\s?[dD][oO][tT]\s?[\])}]\s?|\s[dD][oO][tT]\s)"
_domain = re.compile(rf"[\w\-]+(?:{_dot_form}[\w\-]+)*")
_dot = re.compile(_dot_form)
_at_forms = ("at)", "at]", "at}", "at )", "at ]", "at }", " dot ")
_group = r"(?:\d+|[A-Z]{1,2}(?![A-Za-z]))"
_region = re.compile(rf"(?:\d+|(?<![A-Za-z])[A-Z]{{1,2}}(?![A-Za-z]))(?:(?:\) | \(|-\(|[ .\-/()\xa0\u2009\u202f])?{_group})*")
_atom = re.compile(r"\d+|[A-Z]+")
_name_part = r"[^\W\d_][^\W\d_]+(?:-[^\W\d_]+)*"
_of = r"(?:(?:de la|de los|de|du|des|del) )?"
_street = [
    ("after", re.compile(rf"(?<![\w.,\-])\d{{1,4}}[a-zA-Z]? (?:[NSEW]\. )?({_name_part}(?: {_name_part}){{0,3}}?) ({STREET_AFTER})\b\.?", re.I)),
    ("before", re.compile(rf"(?<![\w.,\-])\d{{1,4}}[a-z]?,? ({STREET_BEFORE}) {_of}({_name_part}(?: {_name_part}){{0,3}})", re.I)),
    ("number_last", re.compile(rf"({STREET_BEFORE}) {_of}({_name_part}(?: {_name_part}){{0,3}}?),? \d{{1,4}}[a-z]?\b", re.I)),
    ("compound", re.compile(rf"(?<![\w.\-])({_name_part}(?:straße|strasse|weg|gasse|allee|platz)|(?:{_name_part} ){{1,4}}(?:Str\.|Straße|Strasse|Weg|Allee|Platz)) \d{{1,4}}[a-z]?\b", re.I)),
]
_before_hints = tuple(f"{w} " for w in STREET_BEFORE.split("|"))
_compound_tail = re.compile(r"(?:straße|strasse|weg|gasse|allee|platz|str\.) \d")
_after_hints = tuple(f" {w}" for w in STREET_AFTER.split("|"))
_compound_hints = ("straße ", "strasse ", "weg ", "gasse ", "allee ", "platz ", "str. ")
_phone_cue = re.compile(r"(?i)\b(tel|tél|telefon|teléfono|téléphone|telephone|phone|fax|call|ring|dial|mobile|cell|reach\w*|under|unter|rufen?|llam[ea]r?|al|appel\w*|at|number)\b[\W_]{0,8}(?:me |us |on |at )?[\W_]{0,3}$")
_id_cue = re.compile(r"(?i)(ssn|\bni|soc\.? sec\.?|social security|nhs|insurance|versicherungs|sozialversicherungs|pension|passport|reisepass|passeport|pasaporte|mrn|medical record|hospital|patient|national|member|steuer|identity|\bdni|\bnir|sécu\w*|licen[cs]e)[ .\-]{0,2}(?:no|number|nummer|número|numéro|nr|id|card)?[ .:#]{0,3}$")
_other_cue = re.compile(r"(?i)\b(accession|plates?|cat\. no\.|catalogu?e?|grant|lot|batch|serial|order|invoice|isbn|ref|protocol|section|item|record|doi:[\w./]*|from|to|ci|fold|version|on|between|figure|table)\W{0,2}$")
_id_label = re.compile(r"(?:ID|NI|NO|NR|MR|NHS|SSN) ")
_after_bad = re.compile(r"(?i)\s?(et al|et coll|u\. ?a\.|und mitarb|y otros|y col|institut|reaction|syndrom|disease|test\b|road\b|street\b|lane\b|close\b|drive\b|ave\b|avenue\b|blvd\b|st\.|str\.|–|['’]s (?:disease|syndrome))")


class Words:
    """Common (``c``) or proper (``p``) by what became a token of a public vocabulary first; other words are unknown (``u``)."""

    def __init__(self, kinds: dict[str, str]):
        self.kinds = kinds
        self.proper = frozenset(w for w, k in kinds.items() if k == "p")
        self.hot = self.proper | _cues
        self.seen: dict[str, tuple[str, bool, str, bool, bool]] = {}

    @classmethod
    def load(cls, names: tuple[str, ...] = VOCABULARIES) -> Words:
        """From vocabulary files: the first decides, the others add common words that it lacks."""
        kinds: dict[str, str] = {}
        for n, name in enumerate(names):
            rank = _ranks(name)
            for w, at in rank.items():
                low = w.lower()
                if low in kinds or len(low) < 2:
                    continue
                small, capital = rank.get(low), rank.get(low.capitalize())
                if small is not None and (capital is None or small < PROPER * capital):
                    kinds[low] = "c"
                elif capital is not None and not n and len(low) > 3:
                    kinds[low] = "p"
        return cls(kinds)

    def of(self, word: str) -> tuple[str, bool, str, bool, bool]:
        """(lower case, initial, kind, ending of a technical or derived word, full stop at its end), kept for the next time."""
        got = self.seen.get(word)
        if got is None:
            dotted = word[-1] == "."
            low = unicodedata.normalize("NFC", word).lower().rstrip(".")
            kind = "f" if low in _before or low in _after else self.kinds.get(low, "u")
            got = (low, len(low) == 1, kind, len(low) > 4 and low.endswith(_term_endings), dotted)
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = got
        return got


def _ranks(name: str) -> dict[str, int]:
    """Words of a vocabulary file that begin a word, with their place: earlier is more frequent."""
    if not os.path.exists(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    out: dict[str, int] = {}
    with open(name, encoding="utf-8") as f:
        if name.endswith(".json"):
            for w, at in json.load(f)["model"]["vocab"].items():
                if w[0] == "Ġ" and w[1:].isascii() and w[1:].isalpha():
                    out[w[1:]] = at
        else:
            for line in f:
                piece, at = line.split()
                w = base64.b64decode(piece).decode("utf-8", "ignore")
                if w[:1] == " " and w[1:].isalpha():
                    out[w[1:]] = int(at)
    return out


_punct = {" ": "_", "": "", ", ": ",", ": ": ":", " (": "(", ' "': "q", '": "': "json", " - ": "-", " – ": "-", " — ": "-", "| ": "bar", " | ": "bar", ". ": ".", "; ": ";"}


def _mark(marks: str) -> str:
    """What stands between a word and a span."""
    got = _punct.get(marks)
    if got is not None:
        return got
    if "\n" in marks:
        return "nl"
    bare = marks.strip()
    return "_" if not bare else "tag" if ">" in bare or "<" in bare else "bar" if "|" in bare else bare[-1] if marks[-1] != bare[0] else bare[0]


def _context_before(text: str, s: int, words: Words) -> str:
    left = text[max(0, s - 32) : s]
    bare = left.rstrip(_marks)
    mark = _mark(left[len(bare) :])
    if not bare:
        return f"start{mark}"
    at = max(bare.rfind(" "), bare.rfind("\n"), bare.rfind('"'), bare.rfind(">"), bare.rfind("("), bare.rfind("."))
    word = bare[at + 1 :].lstrip(_marks)
    low, _, kind, _, _ = words.of(word) if word else ("", False, "u", False, False)
    group = _before.get(low)
    if mark == "." and group != "title":
        return "sentence"
    if mark == "nl" and group not in ("greet", "label"):
        return "line"
    if word.isdigit():
        group = "num"
    elif group and group[:3] == "by:" and mark == "_":
        earlier = bare[: max(at, 0)].rstrip(_marks)
        verb = earlier[earlier.rfind(" ") + 1 :].lstrip(_marks).lower()
        if verb in _asking:
            group = "ask+by"
    return f"{group or (word[:1].isupper() and 'Cap' or kind)}|{'_' if group == 'title' else mark}"


def _context_after(text: str, e: int, words: Words) -> str:
    right = text[e : e + 28]
    bare = right.lstrip(_marks)
    mark = _mark(right[: len(right) - len(bare)])
    if not bare:
        return f"{mark}|end"
    if mark in ("nl", "tag", "bar"):
        return mark
    token = bare.split(None, 1)[0]
    if token[0].isdigit() or token[0] == "+":
        return f"{mark}|num"
    if "@" in token:
        return f"{mark}|mail"
    word = token.rstrip(_marks)
    low = word.lower()
    group = _after.get(low)
    if group is None:
        group = "title" if _before.get(low) in ("title", "role", "kin") else "cap" if word[:1].isupper() else "ed" if low.endswith(("ed", "te", "ó")) else "low"
    return f"{mark}|{group}"


def name_candidates(text: str, words: Words) -> Iterator[tuple[int, int, str, tuple]]:
    """Spans that may be a given name or initial with a family name, in either order, with their facts."""
    found = [(m.start(), m.end(), m[0]) for m in _capital.finditer(text)]
    n = len(found)
    seen = words.seen
    about = [seen.get(w[2]) or words.of(w[2]) for w in found]
    # how each capitalised word is tied to the next: space, particles, hyphen, comma, or not at all
    ties: list[str] = []
    for i in range(n - 1):
        end = found[i][1] - (about[i][4] and not about[i][1])
        gap = text[end : found[i + 1][0]]
        if gap == " ":
            ties.append("s")
        elif gap == ", ":
            ties.append("c")
        elif gap == "-":
            ties.append("-")
        elif len(gap) > 16 or not gap:
            ties.append("s" if not gap and about[i][1] else "")
        else:
            m = _gap.match(gap)
            ties.append("" if not m else "p" if m[1] else "w")
    ties.append("")
    tied = ["", *(t and t + about[i][2] for i, t in enumerate(ties))]
    for i in range(n - 1):
        if not ties[i]:
            continue
        tokens, form, real, commas = [i], "I" if about[i][1] else "W", not about[i][1], 0
        for j in range(i + 1, min(n, i + MAX_WORDS + 1)):
            tie = ties[j - 1]
            if not tie:
                break
            if tie == "c":
                commas += 1
                if commas > 1 or not real or len(tokens) > 2:
                    break
            tokens.append(j)
            form += {"s": " ", "w": "_", "p": " p ", "-": "-", "c": ", "}[tie] + ("I" if about[j][1] else "W")
            real = real or not about[j][1]
            if len(tokens) > MAX_WORDS:
                break
            if not real or form in ("W-W", "I-W", "W-I") or (about[j][1] and not commas):
                continue
            s, e = found[i][0], found[j][1] - (about[j][4] and not about[j][1])
            yield s, e, "person_name", _name_facts(text, s, e, form, [found[k][2].rstrip(".") for k in tokens], [about[k] for k in tokens], tied[i], ties[j] and ties[j] + about[j + 1][2], words)
    starts = set()
    for word in words.hot.intersection(_letters.findall(text)):
        at = text.find(word)
        while at >= 0:
            end = at + len(word)
            if not (text[end : end + 1].isalpha() or at and text[at - 1].isalpha()):
                if word in words.proper:
                    starts.add(at)
                elif gap := _cue_gap.match(text, end):
                    starts.add(gap.end())
            at = text.find(word, end)
    for at in starts:
        m = _small_name.match(text, at)
        if m and not m[1][0].isupper() and not m[4][0].isupper():
            parts = [m[1].rstrip("."), m[4]]
            form = ("I" if len(parts[0]) == 1 else "W") + (" I" if m[2] else "") + (" p " if m[3] else " ") + "W"
            yield m.start(), m.end(), "person_name", _name_facts(text, m.start(), m.end(), form, parts, [words.of(p) for p in parts], "", "", words)


def _name_facts(text: str, s: int, e: int, form: str, parts: list[str], about: list, before: str, after: str, words: Words) -> tuple:
    """What the features of a name are made of. ``before`` and ``after`` tell how it is tied to the words beside it, and their kind."""
    real = [a for a in about if not a[1]]
    case = "T"
    if parts[0][-1].isupper() or len(parts[0]) == 1:
        long = [p for p in parts if len(p) > 1]
        if all(map(str.isupper, long)) and max(map(len, long)) > 2:
            case = "U"
    elif not parts[0][0].isupper() and all(map(str.islower, parts)):
        case = "l"
    first, last = real[0], real[-1]
    edge = text[e : e + 14]
    return (
        "n", form, case, first[2] if len(real) > 1 else "-", last[2], _context_before(text, s, words), _context_after(text, e, words), before, after,
        (first[3] and first[2] != "p") + 2 * (last[3] and last[2] != "p"), len(real) > 2 and any(a[2] in "cf" for a in real[1:-1]), not _institutions.isdisjoint([a[0] for a in real]), min(len(a[0]) for a in real) == 2,
        (_after_bad.match(edge) is not None) + 2 * (edge[:1] == "-" or edge[:1].isalnum()) + 4 * (s > 0 and (text[s - 1] in "-–'’" or text[s - 1].isalnum())),
    )


def _name_features(facts: tuple) -> list[str]:
    _, form, case, first, last, left, right, before, after, terms, inside, institution, short, edges = facts
    kinds = first + last
    strong = left.partition("|")[0] in ("title", "kin", "role", "label", "self", "greet", "ask") or left.startswith(("by:by", "ask+by")) or left.endswith(("|q", "|json", "|-"))
    f = ["n", f"n:form={form}", f"n:form={form},last={last}", f"n:case={case}", f"n:kinds={kinds}", f"n:kinds={kinds},case={case}", f"n:left={left}", f"n:right={right}", f"n:strong={strong:d},kinds={kinds}", f"n:strong={strong:d},case={case}"]
    f += [x for x, bit in (("n:first ends like a term", 1), ("n:last ends like a term", 2)) if terms & bit]
    f += [x for x, yes in (("n:common word inside", inside), (f"n:institution,strong={strong:d}", institution), ("n:function word at an end", "f" in kinds), ("n:two letters", short)) if yes]
    if before:
        f.append(f"n:tied before={before}")
    if after:
        f += [f"n:tied after={after}", f"n:tied after={after},strong={strong:d}"]
    if "," in form:
        f += [f"n:comma,strong={strong:d}", f"n:comma,right={right}"]
    if left in ("sentence", "line") or left.startswith("start"):
        f += [f"n:begins,right={right}", f"n:begins,kinds={kinds}"]
        if right.partition("|")[0] in ("nl", "") and right != "|cap":
            f.append("n:alone on its line")
    return f + [x for x, bit in (("n:wrong word after", 1), ("n:goes on after", 2), ("n:goes on before", 4)) if edges & bit]


def number_candidates(text: str) -> Iterator[tuple[int, int, str, tuple]]:
    """Runs of up to ``MAX_ATOMS`` groups of digits and capitals, each as a phone and as an identity number."""
    for m in _region.finditer(text):
        s, e = m.span()
        if e - s >= 6 and sum(map(str.isdigit, m[0])) >= 6:
            atoms = [x.span() for x in _atom.finditer(text, s, e)]
            yield from _numbers_in(text, atoms, [text[a].isdigit() for a, _ in atoms])


def _numbers_in(text: str, atoms: list[tuple[int, int]], digit: list[bool]) -> Iterator[tuple[int, int, str, tuple]]:
    for i, (s, first_end) in enumerate(atoms):
        if not digit[i] and (first_end - s > 2 or _id_label.match(text, s)):
            continue
        digits = letters = 0
        for j in range(i, min(i + MAX_ATOMS, len(atoms))):
            a, b = atoms[j]
            if digit[j]:
                digits += b - a
            else:
                letters += 1
                if b - a > 2 or letters > 3:
                    break
            if digits > MAX_DIGITS:
                break
            if digits < 6 + (letters == 0):
                continue
            start = s
            if text[start - 1 : start] == "(" and ")" in text[s:b]:
                start -= 1
            if text[start - 1 : start] == "+":
                start -= 1
            span = text[start:b]
            if span.count("(") != span.count(")"):
                continue
            left, before, after = text[max(0, start - 30) : start], text[start - 1 : start] if start else "", text[b : b + 2]
            flags = span.isdigit() + 2 * (letters > 0) + 4 * bool(before and (before.isalnum() or before in "+-/.@_" or before == "," and text[start - 2 : start - 1].isdigit())) + 8 * (i > 0 and re.search(r"\d[ .\-/]$", left) is not None)
            flags += 16 * (after[:1].isalnum() or after[:1] in ("@", "_") or (after[:1] in ("-", "/", ".") and after[1:2].isalnum())) + 32 * (re.match(r"[ \-/.]?\d", after) is not None)
            cue = "phone" if _phone_cue.search(left) else "id" if _id_cue.search(left) else "other" if _other_cue.search(left) else "none"
            sig = span.translate(_shapes)
            for kind in ("phone", "id_number"):
                yield start, b, kind, (kind, sig, cue, "00" if span.startswith("00") else "0" if span[0] == "0" else sig[0], min(digits, 17), min(j - i + 1, 6), flags)


_flags = ("plain", "letters", "goes on before", "digits before", "goes on after", "digits after")


def _number_features(facts: tuple) -> list[str]:
    kind, sig, cue, first, digits, groups, flags = facts
    k = kind[0]
    return [k, f"{k}:sig={sig}", f"{k}:cue={cue}", f"{k}:first={first}", f"{k}:digits={digits}", f"{k}:groups={groups},cue={cue}", *(f"{k}:{x}" for n, x in enumerate(_flags) if flags >> n & 1)]


_shapes = {ord(c): "9" for c in "0123456789"} | {ord(c): "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {0xA0: " ", 0x2009: " ", 0x202F: " "}


def email_candidates(text: str) -> Iterator[tuple[int, int, str, tuple]]:
    """Addresses, also with the at sign or the dots written out."""
    low = text.lower()
    if "@" not in text and not any(x in low for x in _at_forms):
        return
    for at in _at.finditer(text):
        domain = _domain.match(text, at.end())
        if not domain:
            continue
        local = _local.search(text, max(0, at.start() - 64), at.start())
        labels = [x for x in _dot.split(domain[0]) if x]
        tld = labels[-1] if labels else ""
        start = local.start() if local else at.start()
        f = [f"e:at={'@' if at[0] == '@' else 'plain word' if at[0].strip().lower() == 'at' else 'word'}", f"e:local={'none' if not local else 'digits' if local[0].isdigit() else 'text'}", f"e:labels={min(len(labels), 4)}", f"e:tld={'alpha' if tld.isalpha() and len(tld) > 1 else 'other'}"]
        if "://" in text[max(0, start - 12) : start]:
            f.append("e:url before")
        yield start, domain.end(), "email", ("e", *f)


def _word_places(text: str, low: str, hints: tuple[str, ...]) -> Iterator[int]:
    """Where one of ``hints`` begins a word of the text; ``low`` is the text in small letters."""
    if len(low) != len(text):  # small letters of another length: keep places by single characters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for hint in hints:
        at = low.find(hint)
        while at >= 0:
            if not at or not (low[at - 1].isalnum() or low[at - 1] in "_.-"):
                yield at
            at = low.find(hint, at + 1)


def street_candidates(text: str) -> Iterator[tuple[int, int, str, tuple]]:
    """Street names with a house number; of names of several words every shorter reading too."""
    low = text.lower()
    after = any(map(low.__contains__, _after_hints))
    starts = sorted(_word_places(text, low, _before_hints))
    compound = any(map(low.__contains__, _compound_hints)) and _compound_tail.search(low) is not None
    for form, pattern in _street:
        if not (after if form == "after" else compound if form == "compound" else starts):
            continue
        for m in filter(None, (pattern.match(text, at) for at in starts)) if form == "number_last" else pattern.finditer(text):
            name = m[2] if form in ("before", "number_last") else m[1]
            parts = name.split(" ")
            kind_word = m[1] if form in ("before", "number_last") else ""
            spans = [(m.start(), m.end(), parts)]
            if form == "before":
                spans = [(m.start(), m.start(2) + len(" ".join(parts[:k])), parts[:k]) for k in range(1, len(parts) + 1)]
            elif form == "compound":
                spans = [(m.start() + len(" ".join(["", *parts[:k]])), m.end(), parts[k:]) for k in range(max(1, len(parts) - 1))]
            for start, end, used in spans:
                capital = used[0][0].isupper() or kind_word[:1].isupper()
                f = [f"s:form={form}", f"s:capital={capital:d}", f"s:names={len(used)}", f"s:all capital={all(p[0].isupper() for p in used):d}"]
                if form == "before" and len(used) < len(parts):
                    f.append(f"s:next capital={parts[len(used)][0].isupper():d}")
                if form == "compound" and len(used) < len(parts):
                    f.append(f"s:capital before={parts[len(parts) - len(used) - 1][0].isupper():d}")
                if form == "after":
                    f += [f"s:word={m[2].lower()}", f"s:dot={m[0].endswith('.'):d},{m[2].lower() if len(m[2]) < 5 else 'long'}"]
                    if m[2][0].islower() and used[-1][0].isupper():
                        f.append("s:word small")
                yield start, end, "street_address", ("s", *f)
                if form == "after" and m[0].endswith("."):
                    f = [x for x in f if not x.startswith("s:dot")] + [f"s:dot=0,{m[2].lower() if len(m[2]) < 5 else 'long'}", "s:dot left out"]
                    yield start, end - 1, "street_address", ("s", *f)


def candidates(text: str, words: Words) -> list[tuple[int, int, str, tuple]]:
    """All proposed entities as (start, end, kind, facts), by end."""
    found = [*email_candidates(text), *number_candidates(text), *street_candidates(text), *name_candidates(text, words)]
    return sorted((c for c in found if c[1] - c[0] <= MAX_CHARS), key=lambda c: (c[1], c[0], c[2]))


def features(facts: tuple) -> list[str]:
    """The names of the features of a span."""
    return _name_features(facts) if facts[0] == "n" else _number_features(facts) if facts[0] in KINDS else list(facts)


class SemiCrf:
    """Weights of whole-span features; decoding, likelihood and gradient over a segment lattice."""

    def __init__(self, weights: dict[str, float], words: Words):
        self.weights, self.words = weights, words
        self.known: dict[tuple, float] = {}

    @classmethod
    def load(cls, path: Path = WEIGHTS, vocabularies: tuple[str, ...] = VOCABULARIES) -> SemiCrf:
        return cls(json.loads(path.read_text(encoding="utf-8")), Words.load(vocabularies))

    def score(self, facts: tuple) -> float:
        """The weights of a span added up; spans with the same facts are worked out once."""
        got = self.known.get(facts)
        if got is None:
            get = self.weights.get
            got = sum(get(f, 0.0) for f in features(facts))
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[facts] = got
        return got

    def decode(self, text: str) -> list[tuple[int, int, str]]:
        """The best segmentation: its entities as (start, end, kind), in order."""
        scored = [(s, e, k, v) for s, e, k, f in candidates(text, self.words) if (v := self.score(f)) > 0]
        ends: list[int] = []
        best: list[float] = []
        back: list[tuple[int, int, str, int] | None] = []
        for s, e, k, v in scored:
            at = bisect_left(ends, s + 1) - 1  # last boundary not after s
            total = v + (best[at] if at >= 0 else 0.0)
            before = best[-1] if best else 0.0
            if ends and ends[-1] == e:
                if total > best[-1]:
                    best[-1], back[-1] = total, (s, e, k, at)
            elif total > before:
                ends.append(e), best.append(total), back.append((s, e, k, at))
        out = []
        at = len(ends) - 1
        while at >= 0:
            s, e, k, at = back[at]
            out.append((s, e, k))
        return out[::-1]

    def gradient(self, text: str, gold: set[tuple[int, int, str]]) -> tuple[float, dict[str, float]]:
        """Log-likelihood of the gold segmentation and its gradient, by forward and backward sums over the lattice."""
        spans = candidates(text, self.words)
        marks = sorted({0, len(text), *(c[0] for c in spans), *(c[1] for c in spans)})
        place = {m: i for i, m in enumerate(marks)}
        named, get = [features(c[3]) for c in spans], self.weights.get
        scores = [sum(get(f, 0.0) for f in x) for x in named]
        add = lambda a, b: b if a == -math.inf else a if b == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))
        ahead, behind = [-math.inf] * len(marks), [-math.inf] * len(marks)
        ahead[0] = behind[-1] = 0.0
        ending, starting = {}, {}
        for n, c in enumerate(spans):
            ending.setdefault(place[c[1]], []).append(n)
            starting.setdefault(place[c[0]], []).append(n)
        for i in range(1, len(marks)):
            ahead[i] = ahead[i - 1]
            for n in ending.get(i, ()):
                ahead[i] = add(ahead[i], ahead[place[spans[n][0]]] + scores[n])
        for i in range(len(marks) - 2, -1, -1):
            behind[i] = behind[i + 1]
            for n in starting.get(i, ()):
                behind[i] = add(behind[i], behind[place[spans[n][1]]] + scores[n])
        z, like, grad = ahead[-1], 0.0, {}
        for n, (s, e, k, _) in enumerate(spans):
            p = math.exp(min(0.0, ahead[place[s]] + scores[n] + behind[place[e]] - z))
            d = -p
            if (s, e, k) in gold:
                like += scores[n]
                d += 1.0
            if abs(d) > 1e-9:
                for x in named[n]:
                    grad[x] = grad.get(x, 0.0) + d
        return like - z, grad


def _shared(df: DataFrame, vocabularies: tuple[str, ...]):
    """Weights and kinds of words (as many as the vocabularies have, some 1 MB), sent to every task."""
    model = SemiCrf.load(vocabularies=vocabularies)
    return df.sparkSession.sparkContext.broadcast((model.weights, model.words.kinds))


def find(df: DataFrame, key: str, text: str, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """``key, start, length, kind, val``: every personal detail with its place (code points from 0). Null and empty: none.

    Map-only, whole texts, rows in any order; repeated rows give repeated results. ``vocabularies`` are the files that tell
    common from proper words.
    """
    key_type = df.schema[key].dataType.simpleString()
    shared = _shared(df, vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiCrf(shared.value[0], Words(shared.value[1]))
        for batch in batches:
            rows, hits = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    for s, e, k in model.decode(t):
                        rows.append(i)
                        hits.append((s, e - s, k, t[s:e]))
            cols = [batch.column(0).take(pa.array(rows, pa.int64()))]
            cols += [pa.array([h[n] for h in hits], kind) for n, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "start", "length", "kind", "val"])

    return df.select(key, text).mapInArrow(run, f"{key} {key_type}, start int, length int, kind string, val string")


def redact(df: DataFrame, key: str, text: str, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """``key, text, n_redacted``: every text with a typed placeholder in place of each detail; null stays null."""
    key_type = df.schema[key].dataType.simpleString()
    shared = _shared(df, vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiCrf(shared.value[0], Words(shared.value[1]))
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(1).to_pylist():
                out, at, spans = [], 0, model.decode(t) if t else []
                for s, e, k in spans:
                    out += [t[at:s], PLACEHOLDER[k]]
                    at = e
                texts.append(None if t is None else "".join(out) + t[at:])
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[key, text, "n_redacted"])

    return df.select(key, text).mapInArrow(run, f"{key} {key_type}, {text} string, n_redacted int")
