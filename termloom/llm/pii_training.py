"""Fits the weights of the semi-Markov field on invented, labelled texts: ``python -m termloom.llm.pii_training``.

Texts are put together from the sentence patterns below; a slot ``{kind}`` becomes an entity of that kind, other slots become
the numbers, capitalised words and codes that must not be taken for one. Names come from common given and family names of many
countries and, half of the time, from random syllables, so that no single name carries weight. ``HELD_*`` are patterns and
names that are not fitted; precision and recall are measured on them. Fitting is stochastic gradient ascent on the conditional
log-likelihood with a small L2 penalty. ``N_TEXTS`` bounds the sample.
"""

from __future__ import annotations

import json
import random

from termloom.llm.pii import WEIGHTS, SemiCrf, Words

N_TEXTS, ROUNDS, RATE, L2, SEED = 20_000, 4, 0.1, 1e-4, 11

#: Common given and family names of many countries.
GIVEN = """James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen
Lukas Anna Leon Emma Finn Mia Jonas Hannah Paul Lena Klaus Ursula Günter Renate Jean Marie Pierre Camille Louis Chloé Hugo Inès Antoine Océane
Antonio Carmen Manuel Ana José María Javier Lucía Diego Sofía Giovanni Francesca Luca Chiara Piotr Katarzyna Jan Zofia Ivan Olga Sven Ingrid Lars Astrid
Mohamed Fatma Ali Zeynep Raj Anjali Hiroko Kenji Xin Jun Adebayo Chinwe Thabo Naledi Ciara Declan Owen Megan""".split()
FAMILY = """Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Harris Clark Lewis Walker Hall Young King Wright
Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Schröder Dubois Moreau Laurent Lefebvre Leroy
Roux Fournier Girard Bonnet Mercier García Fernández González López Martínez Pérez Gómez Ruiz Hernández Álvarez Russo Esposito Bianchi Romano Colombo
Nowak Wiśniewski Kamiński Petrov Sokolov Popov Hansen Olsen Larsen Lindberg Nilsson Yılmaz Demir Kumar Singh Gupta Sato Suzuki Kim Park Wang Zhang Chen Adeyemi Okonkwo Nkosi""".split()
#: Names of the measurement; none stands above.
HELD_GIVEN = """Marek Wei Sean Aisha Priya Yuki Chidi Fatima Oleksandr Ngozi Dmitri Siobhan Rajesh Mei Giulia Matteo Agnieszka Zoltan Eszter Amara
Kwame Leila Omar Hiroshi Thandiwe Bogdan Ewa Ibrahim Catarina Joao Pekka Aino Tuan Linh Nasrin Farid Gareth Rhys Bronwen Tariq Ahmed Mohammed""".split()
HELD_FAMILY = """Novotny Li O'Brien Okafor Sharma Tanaka Wu Haddad Kovalenko Nwosu Volkov D'Angelo Patel Ng Rossi Ferrari Kowalski Nagy Szabo Mensah Khan
Boateng Tehrani Farouk Yamamoto Dlamini Ionescu Wozniak Diallo Sousa Pereira Virtanen Nguyen Tran Rahman Akhtar Davies Pugh Llewellyn Yu Qureshi Al-Farsi""".split()

#: Sentences with details, and without, of the fit.
WITH = [
    "Full name: {person_name}\nStreet: {street_address}\nCity: {code} {town}\nMobile: {phone}\nE-mail: {email}", "Applicant: {person_name}, {idlabel}{id_number}", "Contact person: {person_name}, {phone}, {email}",
    "Please forward the invoice to {person_name} ({email}) by Friday.", "For details write to {email} or phone {phone}.", "I spoke with {person_name} yesterday and {person_name} agreed.", "Best regards,\n{person_name}\n{street_address}\n{code} {town}",
    "Kind regards,\n{person_name}\n\nTel: {phone}", "Sincerely, {person_name}", "Dear {person_name},", "Dear Mrs. {person_name}, thank you for your letter.", "Dr. {person_name} and Prof. {person_name} chaired the meeting.",
    "The claimant, {person_name}, {idlabel}{id_number}, appealed.", "Our neighbour {person_name} moved to {street_address}, {town}.", "His wife {person_name} can be reached on {phone}.", "Her brother, {person_name}, lives at {street_address} in {town}.",
    "{person_name} was born in {town} and worked there as a baker.", "{person_name} joined the club in {year}.", "{person_name} complained of headaches and was sent home.", "{person_name} reported pain in the left knee.", "Yesterday {person_name} called again.", "Signed by {person_name} on {n}.{n}.{year}",
    "The contract was signed by {person_name} and {person_name}.", "Photographs by {person_name}.", "Letter from {person_name}, {street_address}, {code} {town}", "A parcel for {person_name} arrived at {street_address}.", "Ask {person_name} for the keys.", "ask for {person_name} at the desk", "Interview with {person_name}, aged {n}, a driver from {town}.",
    "Participant {n} ({person_name}, aged {n}) dropped out.", "case {n} ({person_name}, {idlabel}{id_number}) was closed", "The nurse, {person_name}, wrote it down.", "The engineer {person_name} fixed it.", "Many thanks to {person_name}, {person_name} and {person_name}.", "We thank {person_name} for the photographs and {person_name} for advice.",
    "| {person_name} | {email} | {phone} |", "{person_name} | {phone} | {town}", "<li>{person_name}</li><li>{street_address}</li><li>{phone}</li>", '{"customer": "{person_name}", "phone": "{phone}", "address": "{street_address}"}', '{"name": "{person_name}", "id": "{id_number}", "email": "{email}"}',
    'The note said "{person_name}, {phone}" and nothing else.', "hello, {person_name} here, my number is {phone}", "it's {person_name}, please send it to {email}", "ok then, {person_name} will pick it up", "Right, {person_name} has the list.", "see you soon - {person_name}", "The car is ready — {person_name}", "cheers, {person_name}",
    "Frau {person_name}, Tel. {phone}, E-Mail {email}", "Herr {person_name} wohnt in der {street_address}, {code} {town}.", "Der Antrag stammt von {person_name}, geboren am {n}.{n}.{year}.", "Mit freundlichen Grüßen\n{person_name}", "Ansprechpartnerin: {person_name}, Telefon {phone}", "{person_name}, wohnhaft in {town}, {street_address}, erschien nicht.",
    "Monsieur {person_name} habite {street_address}, {code} {town}.", "Appelez {person_name} au {phone}.", "La cliente, {person_name}, est née à {town}.", "Courriel : {email}, téléphone : {phone}", "Le dossier de {person_name}, demeurant {street_address}, est complet.", "Le témoin, {person_name}, a signé.",
    "La señora {person_name} vive en {street_address}, {code} {town}.", "Llame a {person_name} al {phone}.", "El alumno, {person_name}, no vino.", "La carta es de {person_name}, con pasaporte {id_number}.", "Atentamente,\n{person_name}", "Correo: {email}; teléfono: {phone}",
    "{idlabel}{id_number}", "Her {idlabel}{id_number} was on the envelope.", "{idlabel}{id_number}; emergency contact {person_name}, {phone}", "phone {phone}, fax {phone}", "{phone}, {person_name}.", "{phone} {person_name}", "{email}, {person_name}; {phone}", "{street_address}, {person_name}", "Questions: {email}", "from: {email} to: {email}", "<{email}> wrote:", "[{email}] fine, {person_name} comes too.", "Mother: {person_name} ({phone})", "Next of kin: {person_name}", "emergency contact {person_name}, {phone}",
    "Deliver to {street_address}, {code} {town}, c/o {person_name}.", "Send the keys to {street_address}, {town} (attn. {person_name}).", "The office moved to {street_address}; call {phone}.", "Deliveries: {town}, {street_address}, second floor, ask for {person_name}", "Call me ({phone}) tomorrow - {person_name}", "{person_name}", "{person_name}, {person_name}", "Patient: {person_name}\n{idlabel}{id_number}", "The patient {person_name} slept well.",
    "The clerk's father, {person_name}, agreed by phone ({phone}).", "His sister, {person_name}, gave her word on the telephone ({phone}).", "{person_name} wrote from {street_address}.", "{person_name} lives at {street_address}, {town}.", "Checked by {person_name} and Mr {person_name}.", "Prof. {person_name} and Mrs {person_name} met.", "My colleague {person_name} counted the boxes twice.",
]
WITHOUT = [
    "Dr. {family} did not agree.", "Mr {family} left the room.", "The {family} Foundation paid for it.", "The {family} Museum opened in {year}.", "{family} et al. ({year}) found the opposite.", "{family} and {family} ({year}) found nothing.", "{family} und Mitarbeiter ({year}) fanden nichts.", "{family} et coll. ({year}) n'ont rien trouvé.", "{family} y cols. ({year}) no hallaron nada.",
    "{family}'s disease is rare.", "The {family}-{family} test was positive.", "{family}'s syndrome runs in families.", "Order {long}-{n}, invoice {n3}-{n3}-{n}, batch {n4}/{n}.", "Accession no. {n}-{n}-{long}; see section {n}.{n}.", "ISBN 978-{d}-{n}-{n3}{n3}-{d}", "Licence plate {u2} {n4}, grant {n3}-{n3}.", "Between {year}-0{d}-{n} and {year}-1{d}-{n} it rained.",
    "On {n}.0{d}.{year} the plates {n}-{n3}-{n3} were counted.", "doi:10.1000/{low}.{year}.{n}", "See https://www.example.org/{low}/{n3} and item {n3}{n4}.", "@{low}{d} liked it ({n}:{n}).", "Speed {up}{n}@{n}.{n} was logged by {low}{d}@{n}.", "It rose {d}.{n3}-fold ({n}.{n}–{n}.{n3}).", "Room {n}, Floor {d}, Building {up}{d}", "{bignum}", "{bignum}\n{bignum}", "Count: {bignum}",
    "{cap} Green and {cap} Red were used.", "The {cap} Tower stands in {town}.", "{cap} {cap} is a mineral.", "The National {cap} Survey lists {n} towns.", "The Annual Report of the Budget Committee was late.", "The Open Data Group and the Quality Board met.", "{cap} proteins, {cap} receptors and {cap} cells differ.", "{low}, {cap} was measured.", "Acids, {cap}, were removed.", "Enzymes, {cap} | Lipids, {cap}, Type II | Salts; {cap}",
    "{cap} Kinase binds {cap} at pH {d}.", "{cap} Syndrome, Chronic", "Fibres, {cap}, Upper and Bones, {cap}", "Why {cap} Matters For {cap} Research In {town}", "{cap} AND {cap} IN THE LIVER OF MICE", "SUPPLEMENT {d}: {UPCAP} LEVELS", "Read More | About Us | Log In | Sign Up", "Home > News > Sport", "Skip to content  Main Menu  Search", "© {year} {cap} Media. All Rights Reserved.", "Photo Gallery ({n})",
    "Table {d}. {cap} values by {cap} group", "Figure {n} shows {cap} Levels.", "Lake {cap} and Mount {cap} are near {town}.", "United {cap} Airlines flew to {town}.", "In {town} {cap} is common.", "From {cap} one gets {n}.{d} units.", "With {cap} {n} it took {d} h.", "By {cap} methods, {n} were found.", "For {cap} Type {d} see Part II.", "Of {cap} cells, {n} % died.", "Patient Safety First", "Dear Sir or Madam,", "Dear {cap} Members,", "Name: {low}", "Contact: Customer Services", "Best Practice Guide",
    "Note to the manager: The {family} Society met.", "Reviewer: The {cap} {low} is odd.", "Advice for the patient: Take {low} daily.", "Letter to the author: Whether {cap} {low} helps is open.", "Teacher: No {cap} was seen.", "Caller: In {cap} it rains.", "Nurse: {cap} levels, please.",
    "If {cap}, {low}, is added, it stops.", "Unless {cap} fails, {low} stays.", "Wenn {cap}, {low}, fehlt, endet es.", "Dass {cap} hilft, ist offen.", "Si {cap}, {low}, manque, tout cesse.", "Cuando {cap}, {low}, falta, cesa.", "When {cap} meets {cap}, both change.", "Both {cap}, {low} and {cap} differ.", "Order {n3}-{n}-{n4} was shipped.", "model {n3}-{n}-{n4}", "Part {u1}{n4}{n4} is here.",
    "No {cap} was found in {cap} {cap}.", "Kein {cap} {cap} war da.", "Aucun {cap} n'est {low}.", "La {cap} {low} fue alta.", "the mother was told", "the patient with {low} was seen", "nurse on duty", "author for correspondence", "a donor with blood group O", "it's very late", "He walked along the road for {n} weeks.", "{n} pupils live close by", "In {n} cases the way was closed.", "{n} boxes stood in the open square", "{cap} Lane is quiet.",
    "{cap} {cap}", "{cap} {cap}: a review", "{cap} of {cap}", "Alpha {cap} {n}", "{cap}-{cap} bonds", "{cap} {cap} was kept.", "A {cap} point was dropped.", "{low} {low} {cap} {low}", '"It is {low}," the board wrote in {year}.', "{cap}\n\n{cap} {low} {low}.", "Total {n4}, mean {d}.{n}, range {long}-{long}.", "Sample {n3}-{n3} at {n}:{n}", "Version {d}.{n}.{n4} of {year}-{n}-{n}",
]
#: Words of sentences without details: how they begin, what follows, and nouns and verbs, by language.
PLAIN = {
    "en": ("The A In Whether If Both Of These However, Later, Our We Here No For Among After Before When Most Each Some", "group result house water market value report system level method study cell table", "was were had showed reached kept stayed changed with of in and or for than the a", "Group Committee Board Atlas Survey Society Institute Project Journal Model Cells Protein"),
    "de": ("Die Der Das Ein Eine Für Bei Ob Wenn Im In Keine Nach Mit Von Auch Es Zwei Viele Ohne", "Gruppe Werte Frage Arbeit Zeit Messung Kinder Ergebnis Versuch Regel Lösung Tabelle Methode Wirkung", "war waren ist wird blieb zeigte von mit und oder der die das eine nach nicht", "Gesellschaft Anstalt Verein Verband Amt Institut"),
    "fr": ("Les La Le Une Un Dans Pour Aucune Si Cette Des Après Selon Aucun Chez Ce", "maison groupe valeur méthode marché eau question niveau résultat étude", "est était a ont de du des et ou dans avec la le les une peu", "Société Institut Musée Conseil Comité"),
    "es": ("El La Los Las En Con Para Ningún Según Una Un Este Tras No Si Al", "casa grupo valor método mercado agua pregunta nivel resultado estudio", "es fue era ha de del y o en con la el los una muy", "Sociedad Instituto Museo Consejo Comité"),
}
#: Sentences of the measurement.
HELD_WITH = [
    "Tenant of record: {person_name}, {street_address}, {code} {town}", "Could you ring {person_name} on {phone}?", "We met {person_name} at the station.", "The prize went to {person_name}.", "{person_name} studied law in {town}.", "Yours truly,\n{person_name}", "Her lawyer, {person_name}, can be mailed at {email}.", "Coach {person_name} resigned.", "Testigo: {person_name}, teléfono {phone}",
    "Zeugin: {person_name}, {street_address}, {code} {town}", "Témoin : {person_name} ({email})", "Witness {person_name} spoke.", "Carried out under {person_name} in {year}.", "Owner: {person_name}; {idlabel}{id_number}", "<p>{person_name}, {street_address}</p>", "Thank you, {person_name}!", "Mr. {person_name} holds {idlabel}{id_number}.", "The pupil's aunt, {person_name}, came.",
]
HELD_WITHOUT = [
    "Miss {family} sang.", "The {family} Gallery is shut.", "{family} et al. ({year}) disagree.", "Part {n3}-{n}-{n4} is out of stock.", "Platform {d}, Gate {n}", "The {cap} River Trust met in {town}.", "{cap} Oxide and {cap} Sulphate were bought.", "Terms Of Use | Privacy", "Moths, {cap}, and Bees, {cap}", "They walked {n} km along the lane.", "{cap} {cap} grows in sand.", "Total: {bignum}",
]
IDS = {
    "ssn": (["SSN ", "SSN: ", "soc. sec. no. ", "social security number "], ["{n3}-{n}-{n4}", "{n3} {n} {n4}"]),
    "nhs": (["NHS no. ", "NHS number ", "health number "], ["{n3} {n3} {n4}"]),
    "ni": (["insurance number ", "Insurance No: ", "national ID ", "NI no. "], ["{u2}{n3}{n3}{u1}", "{u2} {n} {n} {n} {u1}"]),
    "passport": (["passport ", "passport no. ", "Passport: ", "passport number ", "Reisepass "], ["{u1}{n4}{n4}", "{u2}-{n4}{n3}", "{u1}-{n4}{n3}-{u1}"]),
    "mrn": (["MRN ", "MRN: ", "hospital number ", "patient ID ", "member no. "], ["{n}-{n3}-{n3}", "{n4}{n3}", "{n} {n3} {n3} {n3}"]),
    "pension": (["Versicherungsnummer ", "pension number ", "Sozialversicherungsnummer "], ["{n} {n3}{n3} {u1} {n3}"]),
}
PHONES = ["+1 {n3} 555 {n4}", "+1-{n3}-555-{n4}", "({n3}) 555-{n4}", "{n3}.555.{n4}", "{n3}-555-{n4}", "+44 20 {n4} {n4}", "020 {n4} {n4}", "+33 1 {n} {n} {n} {n}", "01 {n} {n} {n} {n}", "01.{n}.{n}.{n}.{n}", "+49 30 {n4}{d} {n3}", "030/{n4}{d}-{n3}", "0049 30 {n4}{n4}", "+34 9{n} {n3} {n3}", "+353 {n} {n3} {n4}", "00 {n} {n} {n} {n} {n} {n}", "00{n} {n} {n} {n} {n} {n} {n}", "+{n} {n} {n} {n} {n} {n}", "+{n} {n3} {n3} {n3}", "0{n3} {n4}{n3}", "0{n3}-{n4}{n3}"]


class Maker:
    """Texts with names from ``given`` and ``family`` and sentences from ``with_details`` and ``without``."""

    def __init__(self, seed: int, given: list[str] = GIVEN, family: list[str] = FAMILY, with_details: list[str] = WITH, without: list[str] = WITHOUT, invented: float = 0.5, plain: float = 0.3):
        self.r = random.Random(seed)
        self.given_names, self.family_names, self.with_details, self.without, self.invented, self.plain_share = given, family, with_details, without, invented, plain

    def word(self, least: int = 2, most: int = 3) -> str:
        onset = lambda: self.r.choice(["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "z", "br", "st", "tr", "kl", "sch", "gr", "ch", "h", "j"])
        return "".join(onset() + self.r.choice(["a", "e", "i", "o", "u", "ie", "ea", "ó", "ü"][: 9 if self.r.random() < 0.1 else 7]) + self.r.choice(["", "", "n", "r", "l", "s", "t", "ck", "nd"]) for _ in range(self.r.randint(least, most)))

    def given(self) -> str:
        return self.word(1, 3).capitalize() if self.r.random() < self.invented else self.r.choice(self.given_names)

    def family(self) -> str:
        return self.word(2, 4).capitalize() if self.r.random() < self.invented else self.r.choice(self.family_names)

    def person(self) -> str:
        r = self.r
        given, family, extra = self.given(), self.family(), r.random()
        if extra < 0.04:
            given += " " + self.given()
        elif extra < 0.08:
            given += "-" + self.given()
        elif extra < 0.11:
            family = r.choice(["O'", "D'", "O’"]) + family
        elif extra < 0.13:
            family = r.choice("LWNHGXY") + r.choice("iueoga")
        if r.random() < 0.07:
            family += "-" + self.family()
        if r.random() < 0.07:
            family = r.choice(["de ", "van ", "von ", "van der ", "de la "]) + family
        initial, kind = r.choice("ABCDEFGHJKLMNOPRST") + ".", r.random()
        name = f"{initial} {family}" if kind < 0.12 else f"{family}, {given}" if kind < 0.24 and " " not in family else f"{given} {initial} {family}" if kind < 0.34 else f"{family}, {given} {initial}" if kind < 0.36 and " " not in family else f"{given} {family}"
        case = r.random()
        return name.upper() if case < 0.08 else name.lower() if case < 0.14 else name

    def street(self) -> str:
        r = self.r
        name, n = self.word(2, 3).capitalize(), str(r.randint(1, 999))
        if r.random() < 0.2:
            name += r.choice(["-", " "]) + self.word().capitalize()
        small = n[:2] + r.choice(["", "", "a", "b"])
        forms = [f"{n}{r.choice(['', '', 'a', 'c', 'B'])} {name} {r.choice(['Close', 'Road', 'Lane', 'Drive', 'Street', 'Ave', 'Blvd', 'St.', 'Avenue', 'Court', 'Way'])}", f"{n} {r.choice('NSEW')}. {name} Road", f"{n[:2]} rue de {name}", f"{n[:2]}, avenue {name}", f"Calle {name} {n[:2]}", f"{name}er Str. {small}", f"{name.split(' ')[0]}straße {small}"]
        return r.choice(forms)

    def email(self) -> str:
        r = self.r
        who = r.choice([f"{self.word()}.{self.word()}", f"{self.word()}-{self.word()}", f"{self.word()}{r.randint(1, 99)}", f"{self.word()}_{r.choice('abc')}", f"{self.word()}.{self.word()}+{self.word(1, 1)}"])
        parts = [*([self.word(1, 2)] if r.random() < 0.4 else []), self.word(), r.choice(["com", "org", "net", "test", "example", "invalid", "edu"])]
        form = r.random()
        mail = f"{who}@{'.'.join(parts)}" if form < 0.8 else f"{who}(at){'.'.join(parts)}" if form < 0.87 else f"{who} at {' dot '.join(parts)}" if form < 0.91 else f"{who} [at] {' [dot] '.join(parts)}"
        case = r.random()
        return mail.upper() if case < 0.06 else mail.title() if case < 0.1 and form < 0.8 else mail

    def fill(self, pattern: str) -> str:
        """Numbers, words and codes that are no details."""
        r = self.r
        term = lambda: self.word(2, 3) + r.choice(["ine", "ol", "ase", "ide", "in", "itis", "osis", "gen", "ium", "ic", "al", "", "", ""])
        common = ["Working", "Tissue", "Central", "Public", "Market", "Green", "Messenger", "Reader", "Methods", "Health", "Lower", "Group", "Data", "Water", "Cell", "Chronic", "Society", "Model", "Results", "Background", "Patch"]
        made = {"n": lambda: f"{r.randint(10, 99)}", "d": lambda: f"{r.randint(1, 9)}", "n3": lambda: f"{r.randint(0, 999):03d}", "n4": lambda: f"{r.randint(0, 9999):04d}", "year": lambda: str(r.randint(1970, 2024)), "long": lambda: str(r.randint(100, 99999)), "code": lambda: f"{r.randint(10000, 99999)}", "bignum": lambda: str(r.randint(1, 9)) + "".join(r.choice("0123456789") for _ in range(r.randint(8, 13))), "u1": lambda: r.choice("ABCDTVXZ"), "u2": lambda: r.choice(["QB", "XK", "VX", "QD"]), "low": term, "up": lambda: self.word(2, 2).upper()[:4], "cap": lambda: r.choice(common) if r.random() < 0.35 else term().capitalize(), "UPCAP": lambda: self.word().upper(), "town": lambda: self.word().capitalize() + r.choice(["", "", "-Mere", "fell", "ville", "berg"]), "family": self.family}
        for slot, make in made.items():
            while "{" + slot + "}" in pattern:
                pattern = pattern.replace("{" + slot + "}", make(), 1)
        return pattern

    def sentence(self, pattern: str) -> tuple[str, list[tuple[int, int, str]]]:
        out, spans, rest = "", [], pattern
        id_kind = self.r.choice(list(IDS))
        entity = {"person_name": self.person, "street_address": self.street, "email": self.email, "phone": lambda: self.fill(self.r.choice(PHONES)), "id_number": lambda: self.fill(self.r.choice(IDS[id_kind][1]))}
        while True:
            at = min((rest.find("{" + k + "}") for k in entity if "{" + k + "}" in rest), default=-1)
            head = rest if at < 0 else rest[:at]
            out += self.fill(head.replace("{idlabel}", self.r.choice(IDS[id_kind][0])))
            if at < 0:
                return out, spans
            kind = rest[at + 1 : rest.index("}", at)]
            made = entity[kind]()
            spans.append((len(out), len(out) + len(made), kind))
            out += made
            rest = rest[at + len(kind) + 2 :]

    def plain(self) -> str:
        """A sentence-like row of words without details."""
        r = self.r
        starts, nouns, rest, bodies = (x.split() for x in PLAIN[r.choice(["en", "en", "en", "de", "fr", "es"])])
        out = [r.choice(starts)]
        for _ in range(r.randint(3, 10)):
            x = r.random()
            out.append(self.fill("{cap}") if x < 0.14 else self.fill("{low}") if x < 0.26 else r.choice(nouns) if x < 0.5 else r.choice(rest) if x < 0.9 else f"{self.family()} {r.choice(bodies)}" if x < 0.95 else self.fill(r.choice(["{n}", "{up}{d}", "{cap},", "{low},", "({cap})"])))
        text = " ".join(out) + r.choice([".", ".", ";", ":", "?", ""])
        case = r.random()
        return text.upper() if case < 0.04 else text.title() if case < 0.1 else text

    def text(self) -> tuple[str, set[tuple[int, int, str]]]:
        out, spans = "", set()
        for _ in range(self.r.randint(2, 5)):
            x = self.r.random()
            s, found = (self.plain(), []) if x < self.plain_share else self.sentence(self.r.choice(self.with_details if x < 0.65 else self.without))
            spans |= {(a + len(out), b + len(out), k) for a, b, k in found}
            out += s + self.r.choice([" ", " ", ". ", "  ", "\n", "\n- ", "\n\n"])
        return out, spans


def held_out(seed: int) -> Maker:
    """Texts of names and sentences that are not fitted."""
    return Maker(seed, HELD_GIVEN, HELD_FAMILY, HELD_WITH, HELD_WITHOUT, 0.0, 0.0)


def fit(n_texts: int = N_TEXTS, rounds: int = ROUNDS, seed: int = SEED) -> SemiCrf:
    maker = Maker(seed)
    data = [maker.text() for _ in range(n_texts)]
    weights: dict[str, float] = {}
    model = SemiCrf(weights, Words.load())
    for turn in range(rounds):
        maker.r.shuffle(data)
        rate = RATE / (1 + turn)
        for text, gold in data:
            for f, g in model.gradient(text, gold)[1].items():
                weights[f] = weights.get(f, 0.0) * (1 - rate * L2) + rate * g
    return SemiCrf({f: round(v, 3) for f, v in sorted(weights.items()) if abs(v) >= 0.1}, model.words)


def accuracy(model: SemiCrf, maker: Maker, n_texts: int = 400) -> dict[str, tuple[float, float]]:
    """Precision and recall by kind on texts of ``maker``."""
    right, said, true = {}, {}, {}
    for _ in range(n_texts):
        text, gold = maker.text()
        got = set(model.decode(text))
        for group, into in ((got & gold, right), (got, said), (gold, true)):
            for _, _, k in group:
                into[k] = into.get(k, 0) + 1
    return {k: (right.get(k, 0) / max(1, said.get(k, 0)), right.get(k, 0) / n) for k, n in sorted(true.items())}


if __name__ == "__main__":
    fitted = fit()
    WEIGHTS.write_text(json.dumps(fitted.weights, ensure_ascii=False, indent=0) + "\n", encoding="utf-8")
    for name, maker in (("same sentences, other seed", Maker(SEED + 1)), ("other sentences and names", held_out(SEED + 1))):
        print(name, {k: tuple(round(x, 3) for x in v) for k, v in accuracy(fitted, maker).items()}, len(fitted.weights))
