"""Made-up sentences with marked personal information, to train the span classifiers on."""

from __future__ import annotations

import random

# Parts of invented names, streets and towns.
GIVEN = "Anna Björn Carla Dmitri Elena Farid Greta Hugo Irène João Karin Lorenzo Märta Niels Olga Pablo Renée Søren Tamara Ursula Viktor Wanda Yusuf Zoë Marie-Luise Jean-Paul Aoife Kwame Ingrid Rafael Ayşe Łukasz Siân Ömer Éva Ángel Theodora Cornelius Apolline Leonhard".split()
FAMILY = "Abelin Bergqvist Costaldi Drechsler Engstrand Fontanet Grabowski Haverkamp Ibarrola Jankovic Kowalczyk Lundgren Marchetti Nakagawa Okonkwo Pettersen Quintana Rasmussen Schönfeld Thorsen Ullmann Villanueva Wesselink Yilmaz Zeller O'Brannan Müller-Lang D'Ambrosi Sørholt Petrescu Varga Holloway Castellane Birkeland Ashdown Trevanion Lestrade Ferreiro".split()
ENGLISH_STREETS = "Mill Church Station Harbour Orchard Oakfield Northgate Willow Castle Fern Abbey Kingsway Larch Meadow Bridge Copse".split()
ENGLISH_KINDS = "Street St. Road Rd. Lane Drive Court Avenue Ave. Close Terrace Mews Way Blvd Place Square".split()
GERMAN_STEMS = "Haupt Bahnhof Linden Schul Kirch Wald Rosen Berg Mühlen Garten Eichen See".split()
GERMAN_KINDS = "straße str. weg allee gasse platz ring".split()
FRENCH_STREETS = ["rue de la Paix", "avenue des Lilas", "allée du Lac", "boulevard Saint-Michel", "place de l'Église", "chemin des Vignes", "quai du Port", "impasse des Roses"]
SPANISH_STREETS = ["Calle Mayor", "Avenida del Puerto", "Plaza de la Fuente", "Paseo de los Olmos", "Camino Real", "Calle de las Flores"]
TOWNS = "Ashford Lindau Marolles Torrevale Brookhaven Sankt-Aldric Nordby Villafranca Eastbourne Greifstadt Montclair Riverton Kaltenbach Oldmere Saint-Clair Winterfell".split()
DOMAINS = ["example.com", "mail.example.org", "uni-west.example", "dept.physics.test", "lab.test", "corp.example.net", "posteo.example"]
WORDS = "module parser cache table index buffer batch layer split kernel report column metric value job node test record panel queue snapshot threshold token".split()

SENTENCES = [
    "The {w} still fails after the {w} was moved.", "We compared {n} runs and the {w} score fell by {d} points.", "Could someone look at this {w}?", "Please rename `{w}` to `{w}_{w}`.", "Running the {w} job took {d} minutes.", "I think we should split the {w} first.",
    "Der {W} schlägt seit gestern fehl.", "Die Funktion `{w}` verwirft den {W}.", "En el informe falta el {w}.", "Le {w} échoue encore après {n} essais.", "Nobody has looked at the {w} since the release.", "My guess is that the {w} is stale.", "See the {w} for details.", "Tokens are counted on the {w}.",
    "Kann jemand den {W} prüfen?", "Once the {w} is warm it runs at {n} rows per second.", "No objection from my side.", "This changes the {w} default from {n} to {d}.", "After the last merge the {w} is slow.", "Threshold {d} works for {w} features.", "Bei {n} Paaren dauerte der Lauf etwa {d} Minuten.",
]
NAME_FRAMES = [
    "Signed-off-by: {x}", "Signed-off-by: {x} <{e}>", "Co-authored-by: {x} <{e}>", "Reviewed-by: {x}", "Tested-by: {x} <{e}>", "Thanks to {x} for the fix.", "Reported by {x}.", "I talked to {x} about the plan.", "I spoke with {x} yesterday.", "My name is {x} and I work on the parser.", "According to {x}, it is done.",
    "# author: {x}", "@author {x}", "Maintainer: {x} ({e})", "Contact {x} before the merge.", "Dr. {x} asked for the scores.", "Prof. {x} wrote this.", "Mr. {x} called again.", "Annotator: {x}", "Labelled by: {x}", "Regards, {x}", "Best wishes, {x}", "Viele Grüße, {x}", "Saludos, {x}", "Cordialement, {x}",
    "Gemeldet von {x}.", "Reportado por {x}.", "Signalé par {x}.", "{x} asked for the raw data.", "{x} wrote the first version.", "--\n{x}\n{a}", "--\n{x}\nT {p}", "{x}\n{e}", "cc {x}, who owns it.", "Frau {x} hat angerufen.", "written by {x} in spring", "assigned to {x}", "please ask {x} about it", "Patient {x} signed the form.",
]
PHONE_FRAMES = ["Tel.: {x}", "Phone {x};", "Call {x} when the node is down.", "Mobile: {x}", "The hotline is {x}, day and night.", "reach me on {x}", "{x} is my mobile.", "T {x}", "Fax {x}", "ring {x} first", "WhatsApp {x}", "Telefon {x}", "Tél. {x}", "my number is {x}.", "{x}", "ring me on {x}", "Fax/Phone {x};", "Call {x} after six.", "T {x}\n"]
ID_FRAMES = ["{k} {x}", "{k}: {x}", "The form lists {k} {x} by mistake.", "someone pasted {k} {x} into the file", "Participant record: {k} {x}.", "- {k} {x}", "it says {x} on the card", "the form has {x}.", "ID {x} was in the log", "Participant record: it says {x}.", "- {x}", "someone pasted {x} into the file", "- {k} {x}", "Participant record: {x}."]
ADDRESS_FRAMES = ["Office: {x}", "Send it to {x}.", "Postal address is {x}; please update.", "She lives at {x}.", "Ship the disk to {x}.", "Address: {x}", "{x}", "We moved to {x} last year.", "--\n{n}\n{x}"]
EMAIL_FRAMES = ["Contact: <{x}>", "You can reach me at {x}.", "Send the logs to {x} please.", "mailto:{x}", '__author_email__ = "{x}"', "cc {x}, who owns it.", "My address is {x}, mail me.", "{x}", "Escríbeme a {x}, por favor.", "Bitte an {x} schicken.", "Merci d'écrire à {x}."]
NEGATIVES = [
    "Pinned {w}-lib@{v} for now.", "git clone git@code.{w}.example:{w}/{w}.git", "ssh deploy@host.{w}.example:22/{w}.git", "Use @{w}.setter or @property there.", "Ran with user@HOST as placeholder on {date}.", "npm install {w}@{v}", '"{{}}@@{{}}".format({w}, {w})', "contact user@domain.tld as a placeholder", "write to <your-email@...> here",
    "The node at {ip} was slow.", "Seed {n9} and line {n6}.", "The run {run} is the one to keep.", "Scores 0.{n4}-0.{n4} over {n3} {n3} rows.", "Ticket {T}-{n2}-{n4} has the details.", "Module {C} {C} v{d} ships in release {n4}-{n2}.", "Build {n4}.{n3}.{n4} passed.", "Commit {hex} differs from {hex}.", "released on {date}",
    "from 2021-03-04 to 2022-05-06", "rows {n4}-{n4} are bad", "version {v}-{n4}", "{n3}-{n4} lines", "port {n4}, pid {n6}", "The {C} {C} library is old.", "{C} {C} is the new release name.", "Project {C} {C} uses it.", "see Figure {n2} and Table {n2}", "Traceback (most recent call last):", 'File "{w}/{w}.py", line {n3}, in {w}', "ValueError: {w} {w}",
    "{n2} Main Steps, Part {n2}", "chapter {n2}, page {n3}, line {n2}", "About {n3} files in {C} {C} hold it.", "Issue {n4}, {C} release", "The {W} Street dataset has {n3} rows", "model {C}-{n2}B-{n4} at {n4} tokens", "sha256 {hex}{hex}", "timestamp {n9}{n3}", "grid of {n3} {n3} {n3} cells", "part {T}{n6}", "order {T}-{n4}-{n4}", "error code E{n4}-{n3}",
    "The {C} {C} and the {C} Job are green.", "the {C} {C} is stuck", "Check the {W} {W} and the {W} {W} first.", "A {C} {C} asked for it.", "Our {W} Queue holds {n3} jobs.", "Kind Regards Team", "Good Morning Everyone", "Open Source Software", "Python Software Foundation released it.", "The Random Forest model", "Apache License Version {n2}", "Please See Below", "Steps To Reproduce", "Expected Behaviour and Actual Result", "Der Neue Bericht Fehlt", "Thanks to Continuous Integration for the catch.", "Reported by Static Analysis.", "Merged by Release Bot.", "according to Table Two",
]


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _word(rng: random.Random) -> str:
    return rng.choice(WORDS)


def fill(rng: random.Random, frame: str) -> str:
    """A frame with its plain slots filled."""
    for slot, make in (
        ("{date}", lambda: f"{rng.randrange(1, 29)}-{rng.randrange(1, 13):02d}-20{rng.randrange(10, 30)}"), ("{ip}", lambda: ".".join(str(rng.randrange(256)) for _ in range(4))), ("{run}", lambda: f"20{rng.randrange(20, 27)}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}-{_digits(rng, 6)}-{_digits(rng, 6)}"),
        ("{hex}", lambda: "%012x" % rng.getrandbits(48)), ("{n9}", lambda: _digits(rng, 9)), ("{n6}", lambda: _digits(rng, 6)), ("{n4}", lambda: _digits(rng, 4)), ("{n3}", lambda: str(rng.randrange(100, 1000))), ("{n2}", lambda: f"{rng.randrange(1, 100):02d}"), ("{n}", lambda: str(rng.randrange(2, 1000))),
        ("{d}", lambda: f"{rng.random() * 40:.2f}"), ("{v}", lambda: f"{rng.randrange(10)}.{rng.randrange(20)}.{rng.randrange(10)}"), ("{w}", lambda: _word(rng)), ("{W}", lambda: _word(rng).capitalize()), ("{C}", lambda: rng.choice(["Atlas", "Core", "Vega", "Orion", "Delta", "Prime", "North", "Summit", "Quartz", "Falcon", "Data", "Lake"])), ("{T}", lambda: "".join(rng.choice("ABCDEFGHJKLMNPRSTVW") for _ in range(rng.choice((2, 3))))),
    ):
        while slot in frame:
            frame = frame.replace(slot, make(), 1)
    return frame


def name(rng: random.Random) -> str:
    g, f = rng.choice(GIVEN), rng.choice(FAMILY)
    return rng.choices([f"{g} {f}", f"{g[0]}. {f}", f"{f}, {g}", f"{g} {rng.choice('ABEHJKLMRT')}. {f}", f"{g} {rng.choice(['van', 'de', 'von'])} {f}"], [10, 3, 2, 2, 1])[0]


def email(rng: random.Random) -> str:
    import unicodedata

    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if c.isascii() and c.isalpha()) or "user"
    g, f, host = plain(rng.choice(GIVEN)), plain(rng.choice(FAMILY)), rng.choice(DOMAINS)
    local = rng.choice([f"{g}.{f}", f"{g[0]}{f}", f"{g}{rng.randrange(99)}", f"{f}_{g[0]}", f"{g}-{f}+lists", f"{f}.{g[0]}{rng.randrange(9)}"])
    form = rng.random()
    if form < 0.65:
        return f"{local}@{host}"
    if form < 0.75:
        return f"{local}@{host}".upper()
    at, dot = rng.choice([(" [at] ", " [dot] "), (" AT ", " DOT "), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]")])
    return local + at + host.replace(".", dot)


def phone(rng: random.Random) -> str:
    d = lambda n: _digits(rng, n)
    return rng.choice([f"+1 {rng.randrange(201, 990)}-{d(3)}-{d(4)}", f"+44 {rng.randrange(1000, 9999)} {d(6)}", f"+33 {rng.randrange(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+49 (0){rng.randrange(30, 99)} {d(5)}-{d(3)}", f"+49 {rng.randrange(30, 99)} {d(8)}", f"({rng.randrange(201, 990)}) {d(3)}-{d(4)}", f"(0{rng.randrange(30, 99)}) {d(5)} {d(3)}", f"{rng.randrange(201, 990)}.{d(3)}.{d(4)}", f"{rng.randrange(201, 990)}-{d(3)}-{d(4)}", f"07{d(3)} {d(6)}", f"0{rng.randrange(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"00{rng.randrange(31, 49)}-{rng.randrange(10, 99)}-{d(5)}-{d(3)}", f"{rng.choice((555, 555, rng.randrange(200, 999)))}-{d(4)}", f"555-01{d(2)}", f"+34 {rng.randrange(600, 700)} {d(3)} {d(3)}"])


def identity(rng: random.Random) -> tuple[str, str]:
    d = lambda n: _digits(rng, n)
    up = lambda n: "".join(rng.choice("ABCDEGHJKLMNPQRSTWXYZ") for _ in range(n))
    return rng.choice([
        ("SSN", f"{rng.choice(('000', '666', d(3)))}-{d(2)}-{d(4)}"), ("social security number", f"{rng.choice(('666', d(3)))} {d(2)} {d(4)}"), ("NINO", f"{up(2)}{d(6)}{rng.choice('ABCD')}"), ("NI number", f"{up(2)} {d(2)} {d(2)} {d(2)} {rng.choice('ABCD')}"), ("national insurance no.", f"{up(2)}{d(6)}{rng.choice('ABCD')}"),
        ("DNI", f"{d(8)}{up(1)}"), ("national id", f"{d(6)}-{d(4)}"), ("personal number", f"{d(6)}-{d(4)}"), ("Steuer-ID", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("passport no.", f"{up(2)}{d(7)}"), ("passport", f"{up(1)}{d(8)}"), ("driving licence", f"{up(1)}{d(3)}-{d(4)}-{d(4)}"), ("licence no.", f"{up(1)}{d(3)}-{d(4)}-{d(4)}"),
    ])


def address(rng: random.Random) -> str:
    n, town, post = rng.randrange(1, 260), rng.choice(TOWNS), _digits(rng, 5)
    kind = rng.randrange(6)
    if kind == 0:
        return f"{n} {rng.choice(ENGLISH_STREETS)} {rng.choice(ENGLISH_KINDS)}, {town}"
    if kind == 1:
        return f"{n} {rng.choice(ENGLISH_STREETS)} {rng.choice(ENGLISH_KINDS)}, Apt {rng.randrange(40)}, {town} {post}"
    if kind == 2:
        return f"Flat {rng.randrange(1, 30)}, {n} {rng.choice(ENGLISH_STREETS)} {rng.choice(ENGLISH_KINDS)}, {town} {rng.choice('ZAB')}{rng.choice('ZEN')}{rng.randrange(1, 9)} {rng.randrange(1, 9)}{rng.choice('ZAB')}{rng.choice('ZEN')}"
    if kind == 3:
        return f"{rng.choice(GERMAN_STEMS)}{rng.choice(GERMAN_KINDS)} {n}{rng.choice(['', 'a', 'b'])}, {post} {town}"
    if kind == 4:
        return f"{n}, {rng.choice(FRENCH_STREETS)}, {post} {town}"
    return f"{rng.choice(SPANISH_STREETS)} {n}, {post} {town}"


def documents(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with the (begin, end, type) of all personal information in them."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        text, marks = "", []
        for _ in range(rng.randrange(3, 8)):
            roll = rng.random()
            parts: list[tuple[str, str]] = []  # slot value, type
            if roll < 0.3:
                piece = fill(rng, rng.choice(SENTENCES))
            elif roll < 0.5:
                piece = fill(rng, rng.choice(NEGATIVES))
            elif roll < 0.66:
                piece = rng.choice(NAME_FRAMES)
                parts = [("{x}", "name"), ("{e}", "email"), ("{a}", "address"), ("{p}", "phone")]
            elif roll < 0.75:
                piece, parts = rng.choice(PHONE_FRAMES), [("{x}", "phone")]
            elif roll < 0.84:
                piece, parts = rng.choice(ID_FRAMES), [("{x}", "id_number")]
            elif roll < 0.92:
                piece, parts = rng.choice(ADDRESS_FRAMES), [("{x}", "address"), ("{n}", "name")]
            else:
                piece, parts = rng.choice(EMAIL_FRAMES), [("{x}", "email")]
            spans = []
            if parts:
                kind_word, number = identity(rng)
                piece = piece.replace("{k}", kind_word)
                made = {"name": name, "email": email, "phone": phone, "address": address}
                for slot, kind in parts:
                    if slot in piece:
                        value = number if kind == "id_number" else made[kind](rng)
                        at = piece.index(slot)
                        piece = piece[:at] + value + piece[at + len(slot) :]
                        spans = [(b + len(value) - len(slot), e + len(value) - len(slot), k) if b > at else (b, e, k) for b, e, k in spans] + [(at, at + len(value), kind)]
            marks += [(b + len(text), e + len(text), k) for b, e, k in spans]
            text += piece + rng.choice([" ", "\n", "\n", "\n\n", "\r\n"])
        out.append((text, marks))
    return out
