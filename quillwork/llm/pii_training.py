"""Training of the personal-information model: python -m quillwork.llm.pii_training REVIEWS.parquet

Labelled sentences are generated: frames are filled with invented items of each kind, or with things that merely look
like them. Names are words made letter by letter from common given and family names, those names themselves, words
seen as proper nouns, and surnames that are ordinary words; so the model learns what surrounds a name and how it is
put together, not a list. The words of a corpus (common ones and proper nouns, with how often they occur) come from a
bounded random sample of its texts. The conditional random field is fitted by stochastic gradient (AdaGrad) on the
log-likelihood of whole segmentations.
"""

from __future__ import annotations

import json
import math
import random
import re
import sys
import unicodedata
from collections import Counter, defaultdict

from quillwork.llm import pii

SAMPLE_ROWS = 50_000  # bound of the sample for the vocabulary, drawn at random
SENTENCES = 60_000
EPOCHS = 4
LEAST_SEEN = 6  # small letters, within sentences
LEAST_PROPER = 15  # capitalised, within sentences

# fixed values: common given names of several languages
GIVEN = """james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark steven paul andrew kevin brian george edward jason jeffrey ryan jacob gary nicholas eric
jonathan stephen larry scott brandon benjamin samuel gregory patrick jack tyler aaron adam henry peter mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty sandra ashley
emily kimberly margaret donna michelle carol amanda melissa deborah stephanie rebecca laura helen anna nicole emma olivia sophia chloe josé juan carlos luis jorge manuel pedro alejandro maría carmen ana isabel
lucía elena rosa pilar pierre jean michel philippe nicolas luc antoine camille juliette claire sophie hélène hans jürgen klaus wolfgang stefan matthias ursula monika petra sabine heike anja mohammed ahmed ali
omar hassan fatima aisha wei li mei yuki hiroshi kenji priya raj anil sunita ivan olga dmitri tatiana giovanni marco francesca giulia""".split()
# fixed values: common family names of several languages
FAMILY = """smith johnson williams jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson taylor moore jackson martin lee perez thompson harris sanchez clark ramirez lewis robinson
allen wright torres nguyen flores adams nelson mitchell campbell carter roberts gomez phillips evans turner diaz parker cruz edwards collins reyes stewart morris morales murphy rogers gutierrez ortiz morgan
kelly howard kim cox ramos peterson watson brooks kelley sanders bennett hughes patel myers fernandez dubois moreau laurent lefebvre bertrand roux fournier girard müller schmidt schneider fischer weber meyer
wagner becker schulz hoffmann koch richter klein wolf schröder neumann schwarz zimmermann braun krüger hartmann lange werner krause lehmann rossi russo ferrari esposito bianchi romano colombo ricci silva santos
oliveira pereira ivanov petrov volkov novak kowalski nowak hansen larsen olsen johansson nilsson tanaka suzuki watanabe yamamoto chen wang zhang singh khan kumar sharma okafor mensah""".split()
# fixed values: family names that are ordinary words too
WORDY = "baker young brown green king wood hill stone cook fisher walker white black gray bell field rose winter summer knight page price rice bush marsh lane banks wells woods rivers forest sharp small long strong best noble church temple carpenter mason hunter porter butler potter shepherd".split()
PLACES = "Elmsworth Northgate Pinehurst Stonebridge Lakewood Riverton Easton Fairmont Kingsport Brookside Hillcrest Maplewood".split() + ["Cedar Point", "Long Pier", "Glen Arbor", "Saint Ives", "East Quay", "Eagle Ridge", "Bay View", "White Sands"]
ROADS = "Maple Oak Washington Jefferson Sunset Park Church Franklin Highland Chestnut Madison Walnut Lincoln Prospect Willow Spring Main Bridge Station Victoria Queens Heron Pembroke Larkspur".split() + ["River View", "Cherry Tree", "Saint James", "Old Mill", "Martin Luther King", "Elm Park", "Twin Oaks"]
KINDS_OF_ROAD = "St Street Ave Avenue Rd Road Dr Drive Blvd Boulevard Ln Lane Pl Place Ct Court Way Terrace Square Parkway Crescent Close".split()
HOSTS = "mail inbox post webmail cornershop greenline bluehill citynet homebase longview redbrick northstar quickmail papertrail letterbox".split()

# frames of the sentences, by kind; {} is an item of the kind
FRAMES = {
    "email": """You can write to {} about it.|My address is {} for the reply.|Email me: {}|E-mail: {}|Please forward this to {}, thank you.|They kept sending offers to {}.|The voucher was mailed to {} last week.|Questions? {}|Answer to {} if this was you.|For pictures ask {}.|I registered as {}.
Send me the menu at {}|contact {} to get the refund|({})|{}|Mi correo es {}.|Escríbame a {} por favor.|Manden la factura a {}.|Mon adresse : {}|Envoyez la facture à {} svp.|Schreiben Sie an {}.|Meine Adresse lautet {}.|Die Rechnung kam an {}.|{} / {phone}|{person}, {}|{phone}, {}|{id_number}; {}|cc {} next time|the owner's mail, {}, bounces""",
    "phone": """Give me a ring at {}.|My number is {}.|You can reach me under {} in the evening.|Phone: {}|Tel: {}|Cell {}|Fax {}|Please call back: {}|I rang {} twice.|Text me on {} about it.|WhatsApp {}|The number {} is always busy.|{} is the number on the door.|They called from {} at midnight.|Dial {} for a table.|Reservations under {} only.
The host gave us {} in case we get lost.|Nobody picks up at {}.|{}|({})|Mi teléfono es {}.|Llámenme al {}.|Contesten al {}, gracias.|Appelez-moi au {}.|Mon téléphone : {}|Rufen Sie mich an: {}|Meine Handynummer: {}|Telefonisch unter {} erreichbar.|{person}: {}|{} / {email}|{id_number}, {}|{address} - {}|{} was scribbled on the bag|my mobile's {} by the way""",
    "id_number": """My {} stands on the form.|They asked for my {} at the door.|Why would they need my {}?|The clerk noted {} in the guest book.|I gave them {} and regret it.|Somebody could read {} over my shoulder.|They photographed my {}.|{} was visible to everyone.|Please remove {} from your files.|The contract lists {}.|Identification: {}|She repeated my {} aloud.|{}|{} ({person})|{person} - {}
{phone}, {}|{email} / {}|They insisted on my {} for a free coffee.|My {} was left on the counter.|En el formulario figura mi {}.|Me pidieron el {} en la puerta.|Ils ont noté mon {}.|Mon {} est affiché.|Man verlangte meine {}.|Auf dem Zettel stand {}.|Typing in {} took forever.|a copy with {} lay around|the wrong {} is on my bill""",
    "address": """We moved to {} in spring.|The parcel ended up at {}.|Deliver to {} please.|Our flat is at {}.|I live at {}.|Their van blocked {} all morning.|They came to {} within an hour.|Address: {}|Send the bill to {}.|Pick me up from {}.|The new shop is at {}.|My parents live at {}, ten minutes away.|Sent back to {} twice.|{}|From {} you walk five minutes.|Invoice address is {}.
Mi casa está en {}.|Mandaron la comida a {}.|Vivo en {}, cerca del parque.|J'habite {}.|Le colis est parti au {}.|Ich wohne {}.|Die Lieferung ging an {}.|{person}, {}|{phone} - {}|{} - {email}|Our office at {} ordered lunch.|he dropped the food at {} and left|The old lady of {} complained.""",
    "person": """I spoke to {} about it.|Ask for {} when you call.|The table was booked by {}.|Our server was {}.|{} took our order.|{} cooked for us.|My boss {} loves it.|My friend {} said so too.|Many thanks to {} for the help.|Best regards, {}|Yours, {}|- {}|{}|It was {} who helped us.|The owner, {}, came out to greet us.|Please thank {} from us.|The invoice names {}.|We met {} at the bar.|{} was rude to my mother.|{} runs the kitchen now.
Reservation for {}, four people.|I asked {} to call a taxi.|The manager {} apologised.|Booked as {}.|Nos atendió {}.|La mesa estaba reservada por {}.|Gracias a {} por todo.|{} cocina muy bien.|La réservation de {} était introuvable.|{} nous a accueillis.|Merci {} !|Herzlichen Dank an {}.|{} hat uns bedient.|Der Tisch war für {} reserviert.|With {} as guide it went fast.|{phone}, {}|{}, {email}|{} ({id_number})|{} - {address}
Signed by {}.|To {}: never again.|Is {} still the chef?|According to {} it was my fault.|My lawyer {} will write to you.|the card belongs to {}|tell {} i said hi|he told me to ask {} instead|{} knows every guest by name""",
}
FRAMES = {k: [f for line in v.split("\n") for f in line.split("|") if f] for k, v in FRAMES.items()}
# frames without an item; <given>, <proper>, <Word>, <word>, <odd> are filled with such words
PLAIN = """The soup was cold and the bread was stale.|We paid $43.20 for two and left hungry.|Open from 11:30 to 22:00, closed on Mondays.|Been coming here since 2011.|It took 35 minutes to get a table for 6.|The corner of <proper> and <proper> is hard to park at.|<given> was our waiter and did well.|<given> and <given> both loved it.
Chef <given> knows his fish.|Aunt <given> would approve.|The <proper> <proper> is better than the <proper>.|Try the <proper> with a <proper> on the side.|Near <proper> there is nothing like it.|In <proper> everyone knows the place.|La comida estaba fría y el servicio lento.|Los precios subieron en 2015.|Le service est lent mais le vin est bon.|Depuis 2008 rien n'a changé.
Das Essen war kalt und die Bedienung langsam.|Seit 2013 ist der Laden besser.|<given> hinter dem Tresen ist nett.|<given> en la barra es simpático.|<given> derrière le bar est gentil.|<proper> <proper> tastes like home.|<Word> <Word> was the best dish.|Order the <word> <word> and a <Word> beer.|Happy Hour at the <Word> Room ends at 7.|The <odd> was fresh.|We had <odd> and <odd> with rice.|A place called <Odd> on the hill.
The <Odd> Grill is next door.|<Odd>'s is overrated.|The <proper> <Word> is next door.|<given>'s <Word> is cheaper.|BEST <WORD> IN TOWN|<given> Was Great And The <Word> Too|Dr Pepper and fries for $6.|Ms Pac-Man in the corner still works.|Mr Coffee could brew it better.|Room 311 and room 1204 were loud.|Bus 14 stops 200 m away.|Visited 03/12/2019 and 2021-07-30.|Score 8.5 of 10 from 1,240 people.|Table for 12 at 19:45, seated 20:30.|The bus <proper> to <proper> stops here.
They close at 9.|Two <word> for 5 euros.|No <word> in sight.|<Word> y <Odd> son las mejores tapas.|Die <Odd> mit <Word> war gut.|Le <odd> du chef est divin.|<given> <word> my order twice.|<given> <word> the <word>.|thanks <given> for the <word> and the <word>|<proper> <word> is near|<given> from <proper> <word> us well"""
PLAIN = [f for line in PLAIN.split("\n") for f in line.split("|") if f]
BAD_LABELS = "order|order number|order no.|order #|ticket|ticket no.|ticket number|booking|booking ref|booking code|reservation number|gift card|gift card number|loyalty number|loyalty card|member number|invoice|invoice no.|bill|receipt|receipt no.|check|confirmation|confirmation code|confirmation number|tracking number|tracking|coupon|coupon code|voucher|voucher code|locker code|wifi password|item|item no.|SKU|article number|model|part number|lot|batch|flight|plate|case|case number|pedido|pedido número|factura|reserva|tarjeta regalo|commande|commande n°|facture|carte cadeau|billet|Bestellung|Bestellnummer|Rechnung|Gutschein|Ticketnummer|Buchung".split("|")
BAD_NUMBERS = "999-9999-99|999-9999-999|999-9999999-9999999|9999 9999 9999|9999 9999 9999 9999|9999-9999-9999|999999999|99999999|9999999|999999|9999999999|2099-99-9999|2099-99999|20999999-999|#99999|?9999|??999999|?-99999|99-99-9999|99-9999-99|9999-9999|999 999 99|A99-99999|9999/99|#999-9999-99|999-999-9".split("|")


class Maker:
    """Invents items of each kind and things that look like them."""

    def __init__(self, seed: int, common: dict, proper: dict):
        self.r = random.Random(seed)
        self.common, self.proper = [w for w in sorted(common) if w.isalpha() and len(w) > 3] or ["soup"], [w for w in sorted(proper) if w.isalpha() and len(w) > 2] or ["lakewood"]
        self.given_letters, self.family_letters, self.odd_letters = pii.Letters(GIVEN), pii.Letters(FAMILY), pii.Letters(self.common)

    def d(self, pattern: str) -> str:
        """A pattern with each 9 replaced by a digit and each ? by a capital letter."""
        return "".join(str(self.r.randrange(10)) if c == "9" else self.r.choice("ABCDEGHJKLMNPRSTXYZQ") if c == "?" else c for c in pattern)

    def one(self, *xs):
        return self.r.choice(xs)

    def given(self) -> str:
        how = self.r.random()
        w = self.r.choice(GIVEN) if how < 0.33 else self.r.choice(self.proper) if how < 0.62 else self.given_letters.word(self.r, 3, 9)
        return w.capitalize()

    def family(self) -> str:
        how = self.r.random()
        if how < 0.25:
            w = self.family_letters.word(self.r)
        elif how < 0.5:  # any stem with the ending of a family name
            w = self.one(self.odd_letters, self.family_letters, self.given_letters).word(self.r, 3, 7) + self.r.choice(pii.ENDINGS)
        elif how < 0.6:
            w = self.odd_letters.word(self.r, 3, 6) + self.one(self.odd_letters, self.family_letters).word(self.r, 3, 6)
        elif how < 0.7:
            w = self.odd_letters.word(self.r, 4, 9)
        elif how < 0.74:
            return self.one("O'", "D'", "Mac", "Mc", "L'") + self.family_letters.word(self.r).capitalize()
        elif how < 0.9:
            w = self.r.choice(FAMILY)
        else:
            w = self.r.choice(WORDY)
        return w.capitalize()

    def email(self) -> str:
        plain = lambda s: re.sub(r"[^a-z\-]", "", unicodedata.normalize("NFD", s.lower().replace("ß", "ss").replace("ł", "l").replace("ø", "o"))) or "me"
        g, f = plain(self.given()), plain(self.family())
        w = self.r.choice(self.common)
        user = self.one(f"{g}.{f}", f"{f}.{g}", f"{g[0]}{f}", f"{g}{f}", self.d(f"{g}99"), self.d(f"{g}1999"), f"{g}_{f}", self.d(f"{f}_{g[0]}99"), f"{g}+{w}", f"the-{f}s", f"{w}.{f}", self.d(f"{w}99"), f"info")
        host = self.one("", "", "", "mx.", "mail.", "m2.") + self.one(self.r.choice(HOSTS), plain(f), self.r.choice(HOSTS) + "-" + w) + self.one(".", ".", ".", ".co.") + self.one("example", "invalid", "test", "com", "org", "net", "de", "es", "fr")
        how = self.r.random()
        if how < 0.6:
            return f"{user}@{host}"
        if how < 0.68:
            return f"{user} @ {host}"
        if how < 0.74:
            return f"<{user}@{host}>"
        at, dot = self.one(("[at]", "[dot]"), ("(at)", "."), ("at", "dot"), ("(at)", "(dot)"), ("AT", "DOT"), ("{at}", "{dot}"), ("@", "dot"))
        return f"{user} {at} {host.replace('.', f' {dot} ' if dot != '.' else '.')}"

    def phone(self) -> str:
        if self.r.random() < 0.05:
            names = "zero one two three four five six seven eight nine".split()
            return " ".join(names[int(c)] for c in self.d("9999999999"))
        s = self.d(self.one(
            "999-999-9999", "999-999-9999", "999.999.9999", "(999) 999-9999", "(999) 999 9999", "1 (999) 999 9999", "1-999-999-9999", "+1-999-999-9999", "+1 999 999 9999", "+1 (999) 999-9999", "9999999999", "999 999 9999", "999 – 999 – 9999", "999/999-9999",
            "099/99999-999", "099/9999999", "0999 9999999", "+49 99 99999 999", "+49 999 9999999", "+44 9999 999999", "+44 99 9999 9999", "07999 999999", "020 9999 9999", "09 99 99 99 99", "+33 9 99 99 99 99", "09.99.99.99.99", "999 99 99 99", "699 999 999", "+34 999 999 999", "+34 999 99 99 99", "09999/999999",
        ))
        if self.r.random() < 0.15:
            s += self.d(self.one(" x9", " x99", " x999", " ext. 999", " ext 99", ", ext. 9", " extension 99"))
        return s

    def id_number(self) -> tuple[str, str]:
        """(label, number)."""
        f = self.family()[:5].upper().ljust(5, "9")
        label, forms = self.one(
            ("social security number |SSN |SSN: |SS# |ss no |social |social is |social security no. |ssn ||", "999-99-9999|999 99 9999|999999999|999-99-9999|999.99.9999|999-99-9999"), ("|tax ID |taxpayer number |EIN |TIN ", "99-9999999|999-99-9999"),
            ("Steuer-ID |Steuernummer |IdNr. |tax number ", "99 999 999 999|99999999999"), ("driver's license |driver license no. |DL # |licence no. |driving licence |permis de conduire |Führerschein |carnet de conducir ", "?9999999|?999-9999-9999|?99999999|99999999"),
            ("passport |passport no. |passport number |pasaporte |passeport |Reisepass |Pass-Nr. ", "?99999999|?9999999|??999999|??9999999|999999999|99??99999"), ("NI number |national insurance |NINO |NI no. ", "?? 99 99 99 ?|??999999?"),
            ("DNI |NIE |DNI número ", "99999999-?|99.999.999-?|99999999?|?-9999999-?"), ("driving licence |licence number |licence ", f"{f}999999?A9??|{f}999999??9??"), ("national ID |ID card no. |identity card |Personalausweis |carte d'identité |ID number ", "9999 9999 9999|99999999-?|?99999999|999999999999"),
        )
        return self.r.choice(label.split("|")), self.d(self.r.choice(forms.split("|")))

    def address(self) -> str:
        road, place = f"{self.road()} {self.r.choice(KINDS_OF_ROAD)}", self.r.choice(PLACES)
        n, w = str(self.r.randrange(1, 9999)), self.road()
        return self.one(
            f"{n} {road}", f"{n} {road}", f"{n} {self.one('N.', 'S', 'W.', 'East', 'North')} {road}", f"PO Box {n}", f"P.O. Box {n}, {place}", f"P. O. Box {n}", f"Unit {self.d('99')}, {n} {road}", f"{n} {road}, {place}", f"{n} {road} #{self.d('99')}, {place}, OH {self.d('99999')}",
            f"{n} {road}, Apt {self.d('9')}B", f"{self.d('99')} rue {self.one('de la Paix', 'des Lilas', 'du Moulin', 'Victor Hugo', 'de l’Église', 'des ' + w + 's')}", f"{self.d('99')}, {self.one('boulevard', 'bd.', 'avenue', 'place', 'chemin', 'allée')} {self.one('du', 'des', 'de la')} {w}",
            f"Calle {self.one('Mayor', 'del Sol', 'de Alcalá', 'Los Pinos', w)} {self.d('99')}", f"C/ {self.one('San Juan', 'Real', 'Nueva', w)} {self.d('99')}, {self.d('9')}º {self.one('A', 'B', 'dcha')}", f"{self.one('Avda.', 'Avenida', 'Plaza', 'Paseo')} {self.one('de', 'del', 'de la')} {w} {self.d('99')}",
            f"{self.one('Haupt', 'Bahnhof', 'Garten', 'Kirch', 'Schiller', 'Goethe', 'Wald', w)}{self.one('straße', 'str.', 'weg', 'gasse', 'platz', 'allee')} {self.d('99')}{self.one('', 'a', 'b')}", f"Postfach {self.d('9999')}", f"{self.one('Via', 'Viale', 'Rua', 'Piazza')} {w} {self.d('99')}",
        )

    def road(self) -> str:
        return self.r.choice(ROADS) if self.r.random() < 0.6 else self.family() if self.r.random() < 0.5 else self.r.choice(self.proper).capitalize()

    def person(self) -> str:
        g, f = self.given(), self.family()
        i = self.r.choice("ABCDEFGHIJKLMNOPRSTUVWYZ")
        title = self.one("Mr", "Mrs", "Ms", "Dr", "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Miss", "Herr", "Frau", "Madame", "Monsieur", "Señora", "Señor", "Sra.", "Sr.")
        return self.one(
            f"{g} {f}", f"{g} {f}", f"{g} {f}", f"{g} {f}", f"{g}-{self.given()} {f}", f"{g} {self.given()} {f}", f"{g} {f}-{self.family()}", f"{g} {f} {self.family()}", f"{f}, {g}", f"{i}. {f}", f"{i}. {self.r.choice('ABCDEJKLMR')}. {f}", f"{g} {i}. {f}",
            f"{g} {self.one('van', 'von', 'de la', 'de', 'al', 'van der', 'di')} {f}", f"{g} al-{f}", f"{title} {f}", f"{title} {f}", f"{title} {g} {f}", f"{title} {i}. {f}",
        )

    def word(self, how: str) -> str:
        if how in ("given", "proper"):
            return self.given() if how == "given" else self.r.choice(self.proper).capitalize()
        w = self.r.choice(self.common) if how.lower() == "word" else self.odd_letters.word(self.r)
        return w.upper() if how == "WORD" else w.capitalize() if how[0].isupper() else w

    def plain(self, frame: str) -> str:
        return re.sub(r"<(\w+)>", lambda m: self.word(m.group(1)), frame)

    def decoy(self, kind: str) -> str:
        g = self.given()
        number = f"{self.r.choice(BAD_LABELS)} {self.d(self.r.choice(BAD_NUMBERS))}"
        return {
            "email": lambda: self.one("the front desk", f"@{g.lower()}eats", "@ the office", "their web form", "the usual place", "me at home", "@ 8", "at dot", self.plain("the <word>")),
            "phone": lambda: self.one(number, number, number, self.d("2029-99-99"), self.d("99/99/2099"), self.d("extension 999"), self.d("99:99"), self.d("$9,999.99"), "a landline", self.d("channel 99")),
            "id_number": lambda: self.one(number, number, number, number, "shoe size", "table number", self.d("room 999"), self.d("99.99.2099")),
            "address": lambda: self.one("the back door", "the whole street", self.r.choice(PLACES), f"{self.road()} Road", f"the {self.road()} Street entrance", f"the corner of {self.road()} and {self.road()}", "a P.O. box", self.d("gate 99"), self.d("99 people on the drive"), self.d("99 minutes by road"), self.d("the 99 bus"), self.d("9 blocks off the road"), self.d("99 different places")),
            "person": lambda: self.one(g, g, g, f"Chef {g}", f"Uncle {g}", f"Grandma {g}", f"{g} and {self.given()}", "the barista", "the manager", self.plain("the <Word> <Word>"), self.plain("<proper> <proper>"), self.plain("the <Odd> Café"), self.plain("<Word> <Word>"), self.plain("<Word> <proper>"), self.plain("<proper>"), f"{g}'s {self.word('Word')}"),
        }[kind]()

    def filled(self, frame: str, kind: str, spans: list) -> str:
        out = ""
        for part in re.split(r"(\{\w*\})", frame):
            if not part.startswith("{"):
                out += part
                continue
            k = part[1:-1] or kind
            if k == kind and self.r.random() < 0.38:
                out += self.decoy(k)
                continue
            label, item = self.id_number() if k == "id_number" else ("", getattr(self, k)())
            out += label
            bracket = item.startswith("<") and item.endswith(">")
            core = item.strip("<>") if bracket else item
            start = len(out) + bracket
            spans.append((start, start + len(core), k))
            out += item
        return out

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        out, spans = "", []
        for _ in range(self.r.choice((1, 1, 2, 3))):
            own: list = []
            kind = self.r.choice((*pii.KINDS, "person"))
            s = self.plain(self.r.choice(PLAIN)) if self.r.random() < 0.4 else self.filled(self.r.choice(FRAMES[kind]), kind, own)
            if self.r.random() < 0.12 and len(s.lower()) == len(s):
                s = s.lower()
            gap = self.one(" ", " ", "\n", "  ") if out else ""
            spans += [(a + len(out) + len(gap), b + len(out) + len(gap), k) for a, b, k in own]
            out += gap + s
        if self.r.random() < 0.07 and len(out.upper()) == len(out):
            out = out.upper()
        return out, spans


def vocabulary(texts: list[str]) -> tuple[dict[str, int], dict[str, int]]:
    """(common, proper): the words of a sample with the power of two of their frequency. Only words within sentences
    count, where capitals mean something; a proper noun is one that stands capitalised there most of the time. Words
    that touch an address of mail don't count."""
    small, large, first = Counter(), Counter(), Counter()
    for t in texts:
        if t and sum(map(str.islower, t)) > sum(map(str.isupper, t)):
            for w in re.findall(r"(?<=[\w,] )[^\W\d_]+(?:['’][^\W\d_]+)*(?![\w@+\-]|\.\w)", t):
                if w.islower():
                    small[w] += 1
                elif w[1:].islower():
                    large[w.lower()] += 1
            for w in set(re.findall(r"(?<![\w@.+\-])[^\W\d_]+(?![\w@+\-]|\.\w)", t)):
                if w.islower():
                    small[w] += 1
            first.update(w.lower() for w in re.findall(r"(?:^|(?<=[.!?\n] ))[A-ZÀ-Ý][^\W\d_]+(?![\w@+\-]|\.\w)", t))
    proper = {w for w, n in large.items() if n >= LEAST_PROPER and n > 1.5 * small[w]}
    common = {w for w in small.keys() | large.keys() if small[w] + large[w] >= LEAST_SEEN and small[w] >= 3} - proper
    common |= {w for w, n in first.items() if n >= LEAST_PROPER and not large[w]}
    drop = set(GIVEN) | pii.TITLES | pii.PARTICLES
    level = lambda w: int(math.log2(small[w] + large[w] + first[w]))
    return {w: level(w) for w in sorted(common - drop)}, {w: level(w) for w in sorted(proper - drop)}


def _gold(cands: list, spans: list) -> set[int]:
    """The candidate that covers each labelled span best."""
    out = set()
    for s, e, k in spans:
        near = [(min(e, c[1]) - max(s, c[0]), -(c[1] - c[0]), i) for i, c in enumerate(cands) if c[2] == k and min(e, c[1]) > max(s, c[0])]
        if near:
            out.add(max(near)[2])
    return out


def thinned(feats: list[str], kind: str, r: random.Random) -> list[str]:
    """The features of a span, those of the words around a person mostly left out: the frames here are few, and what
    stands beside a name elsewhere is not among them."""
    if kind != "person" or r.random() < 0.4:
        return feats
    return [f for f in feats if not f.startswith(("person|L", "person|R1"))]


def frame_words() -> dict[str, int]:
    """The ordinary words of the frames and labels: they belong to what a model knows, as those of the corpus do."""
    texts = [*PLAIN, *BAD_LABELS, *(f for fs in FRAMES.values() for f in fs), "Café Grill Room the back door the whole street the front desk their web form the usual place social security driver's license"]
    words = {w.lower() for t in texts for w in pii.WORD.findall(re.sub(r"<\w+>|\{\w*\}", " ", t))}
    return {w: 3 for w in sorted(words - set(GIVEN) - pii.TITLES - pii.PARTICLES) if len(w) > 1}


def train(common: dict[str, int], proper: dict[str, int], seed: int = 7, sentences: int = SENTENCES, epochs: int = EPOCHS) -> dict:
    maker = Maker(seed, common, proper)
    common = {w: n for w, n in frame_words().items() if w not in proper} | common
    # a corpus knows its places and roads as proper nouns; here those of the generator stand for them
    places = {w.lower(): 5 for x in [*PLACES, *ROADS] for w in x.split() if w.lower() not in common}
    m = pii.prepared({"given": GIVEN, "family": FAMILY, "common": common, "proper": proper | places, "weights": {}})
    data = []
    for _ in range(sentences):
        text, spans = maker.text()
        cands = list(pii.candidates(text, m))
        if cands:
            data.append(([(*c[:3], thinned(c[3], c[2], maker.r)) for c in cands], _gold(cands, spans)))
    w, g2 = defaultdict(float), defaultdict(lambda: 1.0)
    for _ in range(epochs):
        maker.r.shuffle(data)
        for cands, gold in data:
            p, _z = pii.marginals([(s, e, sum(w[f] for f in feats)) for s, e, _, feats in cands])
            for i, c in enumerate(cands):
                step = (i in gold) - p[i]
                if abs(step) > 1e-4:
                    for f in c[3]:
                        g2[f] += step * step
                        w[f] += 0.3 * step / math.sqrt(g2[f]) - 1e-5 * w[f]
    weights = {f: round(x, 3) for f, x in sorted(w.items()) if abs(x) >= 0.03}
    return {"given": sorted(m["given"]), "family": sorted(m["family"]), "common": common, "proper": proper, "weights": weights}


def score(m: dict, seed: int = 99, sentences: int = 3000) -> dict[str, tuple[float, float]]:
    """Precision and recall of spans by kind on newly generated texts (a span counts if it overlaps one of its kind)."""
    maker, hit, said, true = Maker(seed, m["common"], m["proper"]), Counter(), Counter(), Counter()
    for _ in range(sentences):
        text, spans = maker.text()
        got = pii.spans_of(text, m)
        for k in pii.KINDS:
            a, b = [x for x in got if x[2] == k], [x for x in spans if x[2] == k]
            said[k] += len(a)
            true[k] += len(b)
            hit[k] += sum(any(min(x[1], y[1]) > max(x[0], y[0]) for y in b) for x in a)
    return {k: (hit[k] / max(1, said[k]), hit[k] / max(1, true[k])) for k in pii.KINDS}


def main(path: str) -> None:
    import pyarrow.parquet as pq

    texts = pq.read_table(path, columns=["text"])["text"].to_pylist()
    m = train(*vocabulary(random.Random(7).sample(texts, min(SAMPLE_ROWS, len(texts)))))
    pii.MODEL.write_text(json.dumps(m, ensure_ascii=False, indent=0), encoding="utf-8")
    pii.model.cache_clear()
    print(score(pii.model()))


if __name__ == "__main__":
    main(sys.argv[1])
