"""The small labelled table that the tagger of personal information is trained on.

Letters, forms and notes with slots; slots are filled with invented values. Each slot is one labelled item,
everything else is unlabelled, including the look-alikes (order numbers, companies, amounts). Frames, goods,
trades and values are made here and belong to no given table; labels of forms are the usual ones. Every fifth
frame can be held out, to measure on frames that were not trained on.
"""

from __future__ import annotations

import random

# Common given names of several countries and street words, used in samples and as word lists of the features.
GIVEN = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Donald Steven Paul Andrew Joshua "
    "Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Benjamin Samuel "
    "Gregory Frank Alexander Raymond Patrick Jack Dennis Jerry Peter Henry Arthur Walter Oliver Theodore Frederick Simon Martin Philip Hugh Ian "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Kimberly Emily Donna Michelle "
    "Carol Amanda Dorothy Melissa Deborah Stephanie Rebecca Sharon Laura Cynthia Kathleen Amy Angela Anna Emma Helen Ruth Katherine Catherine Alice "
    "Jean Pierre Michel André Philippe Alain Nicolas François Julien Camille Chloé Hélène Renée Zoë Claire Monique Sylvie Jürgen Hans Klaus Wolfgang "
    "Stefan Karl Friedrich Ursula Ingrid Monika Sabine Petra Heike José Antonio Manuel Francisco Juan Javier Carlos Miguel María Carmen Ana Isabel "
    "Lucía Pilar Teresa João Pedro Luís Rita Giuseppe Giovanni Mario Luigi Paolo Marco Giulia Chiara Francesca Piet Willem Anneke Lars Erik Søren "
    "Bjørn Astrid Ewa Piotr Agnieszka Łukasz Ivan Dmitri Sergei Olga Natalia Tatiana Ali Omar Fatima Aisha Mei Wei Hiroshi Yuki Priya Raj Bob Tom Kate"
).split()
STREETS = "Street Avenue Road Lane Drive Court Way Place Terrace Crescent Boulevard Highway Square Close Parkway Plaza St. Ave. Rd. Ave Rd Blvd Dr. Ln. Ct.".split()
ROMANCE_STREETS = "rue|avenue|boulevard|place|chemin|allée|impasse|quai|calle|avenida|plaza|paseo|camino|via|viale|piazza|corso|rua|travessa|largo".split("|")
GERMAN_STREETS = "straße strasse weg allee gasse platz ring damm ufer".split()
TRADES = (
    "Bakery|Plumbing|Timber Yard|Optics|Dairy|Textiles|Glassworks|Marine Supplies|Roofing|Garden Centre|Dental Clinic|Book Sellers|Auto Parts|Cold Storage|Film Studios|Stationers|"
    "Pharmacy|Shoe Repair|Coach Hire|Software House|Brewery|Stone Masons|Flooring|Sign Writers|Seed Merchants|Upholstery|Fisheries|Tea Importers|Toy Makers|Rubber Goods|Bridge Builders|Veterinary Surgeons"
).split("|")
FORMS = "Inc. LLC Ltd Limited Corporation Company PLC GmbH B.V. S.A. LLP Co. AG".split()
MONTHS = "January February March April May June July August September October November December".split()
GOODS = (
    "garden hose|desk lamp|water filter|spare tyre|printer ribbon|oak table|rain coat|kettle lid|brass hinge|paint roller|bicycle pump|steel ladder|wall clock|door mat|window blind|"
    "coffee grinder|picture frame|lawn mower|fire blanket|snow shovel|torch battery|curtain rail|kitchen scale|paper shredder|tool chest"
).split("|")
KINDS = "blue heavy spare second-hand wooden folding portable broken cheap imported sturdy narrow rusty painted compact vintage".split()
TEAMS = "despatch stores laundry catering reception studio workshop library kitchen transport nursery canteen showroom".split()
VERBS = "sold bought painted washed carried climbs sings fed mended hides folded opens lost found weighs kept wants returned borrowed missed likes fills drew shows locked".split()
# Usual labels of identity numbers.
ID_LABELS = (
    "SSN|SSN:|Social Security|Social Security No.|Social Security Number:|social security number|Soc. Sec. No.|Soc Sec|S.S.N.|National Insurance|National Insurance No.|National Insurance number|NI number|NI No.|NINO|NINO:|Nat. Ins. No.|"
    "passport|Passport:|Passport No.|passport no.|passport number|DNI|DNI:|NIE|NIE:|NIF|CPF|BSN|PESEL|national ID|national ID no.|ID card no.|identity card|identity card no.|driving licence|driving licence no.|driver's license|"
    "Driver's Lic. #|DL No.|DL no.|Steuer-ID|codice fiscale|tax ID|personal tax ID|TIN|taxpayer ID|taxpayer ID:|taxpayer identification number|personal number"
).split("|")

_SYLLABLES = "ba be bo bri bru da de di do dra dro fa fe fi fo fu ga ge go gra gro ha he hi ho hu ka ke kla klo ko la le li lo lu ma me mi mo mu na ne ni no nu pa pe pi po ra re ri ro ru sa se si so su ta te ti to tra tri tu va ve vi vo vu za ze zi zo zu".split()
_ENDINGS = "n r s t x ck nd st rt l m ff tt son sen man er berg ez is ard".split()

_PLACES = "New|Port|Saint|Fort|Lake|North|West|Mount".split("|")


class Maker:
    """Invented values, drawn with a fixed seed."""

    def __init__(self, seed: int = 11):
        self.r = random.Random(seed)
        #: Given names that no list knows.
        self.pool = sorted({self.made(1, 2) for _ in range(120)})

    def pick(self, items):
        return self.r.choice(items)

    def digits(self, n: int) -> str:
        return "".join(self.pick("0123456789") for _ in range(n))

    def made(self, least: int = 2, most: int = 3) -> str:
        word = "".join(self.pick(_SYLLABLES) for _ in range(self.r.randint(least, most))) + self.pick(_ENDINGS + [""] * 6)
        if self.r.random() < 0.12:
            word = word.replace("o", "ö", 1) if self.r.random() < 0.5 else word.replace("e", "é", 1)
        return word.capitalize()

    def given(self) -> str:
        return self.pick(GIVEN) if self.r.random() < 0.6 else self.pick(self.pool)

    def surname(self) -> str:
        s = self.made()
        if self.r.random() < 0.07:
            s += "-" + self.made()
        if self.r.random() < 0.08:
            s = self.pick(["van der ", "de ", "von ", "van ", "di ", "da ", "O'", "Mc", "de la "]) + s
        return s

    def NAME(self) -> str:
        x, g, s = self.r.random(), self.given() if self.r.random() < 0.95 else self.made(1, 2), self.surname()
        if x < 0.5:
            n = f"{g} {s}"
        elif x < 0.64:
            n = f"{g} {self.pick('ABCDEFGHJKLMPRSTVW')}. {s}"
        elif x < 0.76:
            n = f"{self.pick('ABCDEFGHJKLMPRSTVW')}. {s}"
        elif x < 0.87:
            n = f"{s}, {g}" + (f" {self.pick('ABCDEFGHJKLM')}." if self.r.random() < 0.15 else "")
        elif x < 0.95:
            n = f"{s}"
            return self.pick(["Mr ", "Mrs ", "Ms ", "Dr ", "Mr. ", "Mrs. ", "Dr. ", "Prof. "]) + "\1" + n
        else:
            n = f"{self.pick('ABCDEFGHJKLMPRSTVW')}. {self.pick('ABCDEFGHJKLM')}. {s}"
        if self.r.random() < 0.15:
            n = n.upper()
        return (self.pick(["Mr ", "Ms ", "Dr. ", "Mrs. "]) + "\1" + n) if self.r.random() < 0.04 else n

    def FIRST(self) -> str:
        return self.given()

    def COMPANY(self) -> str:
        x = self.r.random()
        if x < 0.18:
            return f"{self.made()} & {self.pick(['Partners', 'Sons', self.made(), 'Brothers'])} {self.pick(['LLP', 'Ltd', 'Inc.'])}"
        if x < 0.24:
            return f"{self.given()} {self.made()} {self.pick(FORMS)}"
        if x < 0.27:
            return "ООО " + "".join(self.pick("ба во ги ду жи зо ка ле ми но пу ра су ти фо ху".split()) for _ in range(4)).capitalize()
        c = f"{self.pick(['The ', 'Port ', '', '', '', ''])}{self.made()} {self.pick(TRADES)}"
        c += " " + self.pick(FORMS) if self.r.random() < 0.75 else ""
        if self.r.random() < 0.12:
            words = c.split(" ")
            k = self.r.randrange(1, len(words))
            c = " ".join(words[:k]) + "\n" + " ".join(words[k:])
        return c.upper() if self.r.random() < 0.05 else c

    def ADDRESS(self) -> str:
        x, n = self.r.random(), str(self.r.randint(1, self.pick([19, 99, 399, 999, 9999, 9999, 9999])))
        if x < 0.5:
            if self.r.random() < 0.2:
                n = self.pick("One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve".split())
            elif self.r.random() < 0.08:
                n += f"-{int(n) + 2}"
            elif self.r.random() < 0.08:
                n += self.pick("ABC")
            side = self.pick(["North ", "West ", "E. ", "N. ", "S. ", "W. ", "E ", "W ", "Old ", "Upper ", "Lower ", "South "]) if self.r.random() < 0.25 else ""
            a = f"{n} {side}{self.made()} {self.pick(STREETS)}"
        elif x < 0.8:
            kind, n = self.pick(ROMANCE_STREETS[:4] * 2 + ROMANCE_STREETS), str(self.r.randint(1, 250))
            a = f"{n}{self.pick([', ', ' ', ' bis, ', ' bis, ', ' ter, '])}{kind} {self.pick(['de ', 'du ', 'des ', 'de la ', '', ''])}{self.made()}"
            if self.r.random() < 0.4:
                a = f"{self.pick(ROMANCE_STREETS).capitalize()} {self.pick(['de ', '', ''])}{self.made()}{self.pick([' ', ', ', ', '])}{n}"
        else:
            a = f"{self.made()}{self.pick(GERMAN_STREETS)} {n}{self.pick(['', '', '', 'a', 'b'])}"
        return a.upper() if self.r.random() < 0.05 else a

    def UNIT(self) -> str:
        return self.pick(["", "", "", ", Suite 400", ", Unit 7", ", 3rd Floor", ", Apt. 12", ", Floor 2", ", Suite 120"])

    def CITY(self) -> str:
        city = (self.pick(_PLACES) + " " if self.r.random() < 0.6 else "") + self.made()
        gap = "\n" if self.r.random() < 0.16 else " "
        if self.r.random() < 0.06:
            city = city.replace(" ", "\n")
        return f"{city},{gap}{self.pick('ABCDEFGKLMNQVXZ')}{self.pick('ABCDJKLNWXYZ')} {self.digits(5)}"

    def PHONE(self) -> str:
        d = self.digits
        x, lead = self.r.random(), self.pick("23456789")
        if x < 0.5:
            return self.pick(
                [f"({d(3)}) {lead}{d(2)}-{d(4)}", f"{d(3)}-{lead}{d(2)}-{d(4)}", f"{d(3)}.{lead}{d(2)}.{d(4)}", f"{d(3)} {lead}{d(2)} {d(4)}", f"({d(3)}) {lead}{d(2)} {d(4)}", f"{d(3)}/{lead}{d(2)}-{d(4)}", f"1-{d(3)}-{lead}{d(2)}-{d(4)}", f"+1 {d(3)} {lead}{d(2)} {d(4)}", f"+1 {d(3)} {lead}{d(2)}-{d(4)}"]
            )
        if x < 0.62:
            return self.pick([f"{lead}{d(2)}-{d(4)}", f"{lead}{d(2)} {d(4)}"])
        return self.pick(
            [f"+44 {d(2)} {d(4)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(4)} {d(6)}", f"+44 {d(4)} {d(3)} {d(3)}", f"+33 {lead} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{lead} {d(2)} {d(2)} {d(2)} {d(2)}", f"+49 {d(2)} {d(5)} {d(3)}", f"0049 {d(2)} {d(5)} {d(3)}",
             f"0{d(2)}/{d(5)}-{d(3)}", f"+61 ({lead}) {d(4)} {d(4)}", f"(0{lead}) {d(4)} {d(4)}", f"+34 {d(2)} {d(3)} {d(2)} {d(2)}", f"+351 {d(2)} {d(3)} {d(4)}", f"+{d(11)}", f"{d(10)}"]
        )

    def _host(self) -> list[str]:
        low = lambda: self.made().lower().replace("ö", "o").replace("é", "e")
        host = low() + (f"-{low()}" if self.r.random() < 0.35 else "")
        return ([self.pick(["mail", "uk", "ap", "sales"])] if self.r.random() < 0.12 else []) + [host] + self.pick([["example"], ["example", "com"], ["example", "org"], ["example", "net"], ["test"], ["invalid"], ["com"], ["org"], ["de"], ["fr"]])

    def EMAIL(self) -> str:
        g, s = self.pick(GIVEN).lower(), self.made().lower().replace("ö", "o").replace("é", "e")
        box = self.pick([f"{g}.{s}", f"{s}.{g}", f"{g[0]}{s}", f"{s}_{g[0]}", f"{g}{self.digits(2)}", f"{s}-ap", f"{g}.{s}+bills", f"{g[:2]}.{s}", f"{s}"])
        host, x = self._host(), self.r.random()
        if x < 0.66:
            e = f"{box}@{'.'.join(host)}"
        elif x < 0.74:
            e = f"{box} @ {'.'.join(host)}"
        elif x < 0.78:
            e = f"{box} @{'.'.join(host)}"
        elif x < 0.84:
            e = f"{box}{self.pick(['[at]', ' [at] ', ' (at) ', '(at)'])}{'.'.join(host)}"
        else:
            e = f"{box} at {' dot '.join(host)}"
        return e.upper() if self.r.random() < 0.06 else e

    def ID(self) -> str:
        d, u = self.digits, lambda: self.pick("ABCDEFGHJKLMNPQRSTXYZ")
        return self.pick(
            [f"{d(3)}-{d(2)}-{d(4)}"] * 4 + [f"{d(3)} {d(2)} {d(4)}"] * 3 + [d(9)] * 2
            + [f"{u()}{u()}{d(7)}", f"{u()}{u()} {d(2)} {d(2)} {d(2)} {u()}", f"{u()}{u()}{d(6)}{u()}", f"{d(8)}{u()}", f"{d(8)}{u()}", f"{u()}{d(4)}-{d(5)}-{d(2)}",
               f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11), f"{u()}{d(8)}", f"{u()}{d(7)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}"]
        )

    def LABEL(self) -> str:
        whose = self.pick(["her ", "his ", "my ", "your "]) if self.r.random() < 0.12 else ""
        return whose + self.pick(ID_LABELS) if self.r.random() < 0.8 else whose + self.pick(["SSN", "NI number", "Passport No.", "DNI"])

    def REF(self) -> str:
        d = self.digits
        return self.pick([f"PO{d(6)}", d(6), f"{d(4)}-{self.pick('ABCD')}", f"{d(3)}/{d(3)}", f"{d(3)}-{d(4)}" if self.r.random() < 0.4 else d(7), d(11), d(12), f"{d(3)}-{d(2)}-{d(4)}", f"{self.pick('ABCDFGHKLMNPQ')}{self.pick('BCDFGHKLMXZ')}-{d(6)}", d(10), f"{d(4)}-555-{d(3)}"])

    def MONEY(self) -> str:
        return self.pick(["$", "$", "£", "USD ", "", "€"]) + f"{self.r.randint(1, 9999):,}.{self.digits(2)}"

    def DATE(self) -> str:
        y, m, d = self.r.randint(1994, 2024), self.r.randint(1, 12), self.r.randint(1, 28)
        return self.pick([f"{d} {MONTHS[m - 1]} {y}", f"{MONTHS[m - 1]} {d}, {y}", f"{m}/{d}/{y}", f"{d:02}.{m:02}.{y}", f"{y}-{m:02}-{d:02}", f"{d} {MONTHS[m - 1][:3]} {y}"])

    def GOOD(self) -> str:
        return f"{self.pick(KINDS)} {self.pick(GOODS)}"

    def TEAM(self) -> str:
        return self.pick(TEAMS)

    def VERB(self) -> str:
        return self.pick(VERBS)

    def NUM(self) -> str:
        return str(self.r.randint(1, 99))

    def BOX(self) -> str:
        return self.pick(["P.O. Box", "PO Box", "P.O. Box", "Postfach"]) + " " + self.digits(4)

    def STREETISH(self) -> str:
        return self.made()


#: Slots that are labelled, by kind.
LABELLED = {"NAME": "name", "FIRST": "name", "ADDRESS": "address", "PHONE": "phone", "EMAIL": "email", "ID": "identity"}

HEADS = [
    "{COMPANY}\n{ADDRESS}{UNIT}\n{CITY}\n", "{NAME}\n{ADDRESS}{UNIT}\n{CITY}\n", "{COMPANY}\n{BOX}, {CITY}\n", "{NAME}\n{BOX}, {CITY}\n", "{NAME}\nFax {PHONE}\n", "{NAME}\nTel. {PHONE}\n", "{NAME}\nINVOICE\n",
    "{COMPANY}\nTelephone: {PHONE}\n", "{COMPANY}\nPhone {PHONE}\n", "{COMPANY}\n{PHONE}\n", "{COMPANY}\nE-mail: {EMAIL}\n", "{COMPANY}\n{EMAIL}\n", "{COMPANY}\nmail {EMAIL}\n", "{COMPANY} - {GOOD}\n", "{ADDRESS}{UNIT}\n{CITY}\nTel. {PHONE}\n", "{COMPANY}\n{GOOD} list\n", "{GOOD} report\n{NAME}\n",
    "{ADDRESS}{UNIT}\n{CITY}\n{EMAIL}\n", "Page {NUM} of {NUM}\n{NAME}\n{ADDRESS}{UNIT}\n", "- {NUM} -\n{COMPANY}\n{NAME}\n", "{COMPANY}\n{COMPANY}\n{ADDRESS}{UNIT}\n{CITY}\n", "{TEAM} sheet {REF}   {DATE}\n{NAME}\n", "{TEAM} sheet {REF}   {DATE}\n{COMPANY}\n",
    "New {STREETISH}, {STREETISH} {NUM}\n", "PRIVATE / {GOOD}\n{NAME}\n", "{COMPANY}\nFORM {REF}\n", "{TEAM} RECORD {REF}\n",
]
FIELDS = [
    "Bill To: {NAME}\n", "Bill To: {COMPANY}\n", "Bill To: {COMPANY}\nAttn: {NAME}\n{ADDRESS}{UNIT}\n{CITY}\n", "Sold to {NAME}\n", "Sold to {COMPANY}\n", "Ship To: {NAME}\nAttn: {NAME}\n", "Customer: {NAME}\n", "Client: {COMPANY}\n", "Client: {NAME}\n", "To: {NAME}\n", "To: {COMPANY}\n", "Invoice to {COMPANY}\n", "Invoice to {NAME}\n",
    "Attn: {NAME}\n", "Attention: {NAME}\n{BOX}, {CITY}\n", "Attn: {NAME}\nTel. {PHONE}\n", "c/o {NAME}\n{ADDRESS}\n", "From: {NAME} <{EMAIL}>\nTo: {NAME}\nDate: {DATE}\nSubject: {GOOD} {REF}\n", "From: {NAME} {EMAIL}\nTo: {NAME}\n", "From: {NAME}\nTo: {NAME}\nCc: {NAME}\n", "From: {NAME} <{EMAIL}>\nTo: {FIRST}\nCc: {NAME} <{EMAIL}>\n", "Sent: {DATE}\nSubject: {GOOD} for {COMPANY}\n",
    "Tenant: {NAME}\n", "Employee: {NAME}\n{LABEL} {ID}\n", "Name: {NAME}\n", "Full name: {NAME}\n{LABEL} {ID}\n{ADDRESS}{UNIT}\n{CITY}\nTel. {PHONE}\n", "1. Name {NAME}\n", "3. Name {NAME}\n4. Address {ADDRESS}\n", "2. Phone {PHONE}\n3. E-mail {EMAIL}\n", "Applicant: {NAME}\n", "Applicant {NAME}\n{LABEL} {ID}\n", "Name of tenant: {NAME}\n{LABEL} {ID}\n",
    "Contact: {NAME}\n", "Ordered by {NAME}\n", "Signature: {NAME}\n", "Signed {NAME}\n", "Employee: {NAME}\n{ADDRESS}{UNIT}\n{CITY}\n", "Ordered by {NAME}\n{LABEL} {ID}\n", "Manager: {NAME}, {PHONE}\n", "Phone {PHONE}\n", "Tel. {PHONE}\n", "Telephone: {PHONE}\n", "Telephone {PHONE}\n", "Fax {PHONE}\n", "Fax: {PHONE}\n", "Mobile: {PHONE}\n", "Tel {PHONE} ext. {NUM}\n", "Phone {PHONE} x{NUM}\n", "Phone/Fax {PHONE}\n", "E-mail: {EMAIL}\n", "Email {EMAIL}\n", "mail {EMAIL}\n", "{EMAIL}\n", "{PHONE}\n", "Office {PHONE}\nMobile {PHONE}\n",
    "{LABEL} {ID}\n", "{LABEL} {ID}\n{BOX}, {CITY}\n", "{LABEL} {ID}\n{ADDRESS}\n", "{LABEL} ({COMPANY}) {REF}\n", "Prepared by {NAME}\n", "Approved by {NAME}\n", "Checked by {NAME}\n", "Your cook was {FIRST}\n", "Your driver today was {FIRST}\n{GOOD}\n", "Till operator: {FIRST}\n", "Cashier {FIRST}\n", "Packed by {FIRST}\n", "Poured by {FIRST}\n{GOOD}\n", "Best regards, {NAME}\n", "Reported by {NAME}\n", "Inspector: {NAME}\n", "Address: {ADDRESS}\n", "Address {ADDRESS}{UNIT}\n{CITY}\n", "Deliver to {ADDRESS}\n",
    "Invoice No. {REF}   Date {DATE}\n", "Invoice # {REF}   Date {DATE}\n", "No. {REF}   {DATE}\n", "Your ref. {REF}   Date {DATE}\n", "Ticket {REF} {DATE}\n", "{GOOD} SHEET {REF}\n", "{TEAM} note: {GOOD}\n", "{TEAM} number: {REF}\n", "{TEAM} budget: {MONEY}\n", "Quotation {REF} of {DATE}\n", "Serial No. {REF}\n", "Shipment {REF}\n", "Lot {REF}\n", "Company No. {REF}\n",
    "{NUM} {GOOD} {MONEY} {MONEY}\n", "{REF} | {GOOD} | {NUM} | {MONEY}\n", "{GOOD}  {NUM} x {MONEY}  {MONEY}\n", "Total {MONEY}\n", "Amount due {MONEY}\n", "TOTAL {MONEY}\n", "Subtotal {MONEY}\n", "Sum {MONEY}\n", "{NUM}\n", "Page {NUM}\n", "{COMPANY}    [{NUM}]\n", "{COMPANY} - {GOOD}\n", "VAT No. {REF}\n", "Tracking No. {REF}\n", "Waybill number {REF}\n", "Batch number {REF}\n", "Meter number {REF}\n", "Change {MONEY}\n",
    "LIST OF PARTS\n", "INVOICE\n", "QUOTATION\n", "Paid {DATE}\n", "PAID {DATE}\n", "{COMPANY}    Page {NUM}\n", "{TEAM} DESK {NUM} {DATE}\n", "Parcel number {REF}\n", "Cash on delivery. Prepared by {NAME}\n", "Net {NUM} days\n", "Terms: cash\n{NAME}\n", "Due {DATE}. {NAME}\n", "Net {NUM} days. {NAME}\n", "Discount {NUM} %\n{NAME}\n",
    "Regards,\n{NAME}\n", "Sincerely, {NAME}\n", "Best wishes, {FIRST}\n", "Regards, {NAME}\n", "Regards {NAME}\n{TEAM}\n", "Kind regards\n{NAME}\n", "- {NAME}\n", "Yours truly,\n{NAME}\n", "{FIRST}\n{TEAM}, {PHONE}\n", "Cheers,\n{FIRST}\n", "Many thanks, {FIRST}\n{TEAM} office\n", "Sincerely,\n{NAME}\n{TEAM} department, {PHONE}\n",
    "Dear {FIRST},\n", "Dear {NAME},\n", "Hi {FIRST},\n", "Hello {FIRST},\n", "Dear Sirs,\n", "Dear Sir or Madam,\n", "{FIRST},\n", "Good evening {FIRST},\n", "Dear Customer,\n",
]
SENTENCES = [
    "The claim by {NAME} ({LABEL} {ID}) has been paid. ", "A parcel for {NAME} (her {LABEL} {ID}) is waiting. ", "A parcel for {NAME} (his {LABEL} {ID}) is waiting. ", "The tenant wrote {LABEL} {ID} on the back of the {GOOD}. ", "Add {LABEL} {ID} to the card. ", "They need your {LABEL}, which was {ID} last year. ",
    "A {GOOD} was lent to {NAME} on {DATE}. ", "Give our best to {NAME} and everybody in the {TEAM}. ", "{NAME} now lives at {ADDRESS} with a dog. ", "In the view of {NAME}, the {GOOD} looks fine. ", "Leave the {GOOD} at {ADDRESS}{UNIT}, {CITY}. ", "The {GOOD} belongs at {ADDRESS}{UNIT}. ", "Our old shop in {ADDRESS} has closed. ",
    "Guests of {ADDRESS} may use the garden. ", "Bring two of them to {ADDRESS}, {CITY}. ", "Post it to {EMAIL} or fax {PHONE}. ", "For a {GOOD} ask {EMAIL}. ", "For a {GOOD} ask {EMAIL} first. ", "Dial {PHONE} when you arrive. ", "Ask {NAME} on {PHONE}. ", "Try {NAME} at {PHONE} or {EMAIL}. ", "Mail {EMAIL} until {DATE}. ", "We moved from {ADDRESS} to {ADDRESS} in spring. ",
    "Just dial {PHONE} if the kettle leaks again. ", "{NAME} rang twice from {PHONE}. ", "Answers to {EMAIL}, thanks. ", "The form is at mailto:{EMAIL} too. ", "Text {PHONE} or knock loudly. ", "Our fax is {PHONE}, the phone {PHONE}. ", "Use {EMAIL} (office) or {EMAIL} (home). ",
    "Dial {PHONE} ext. {NUM} and wait for the tone. ", "The {TEAM} picks up at {PHONE} x{NUM} most evenings. ", "{NAME} of the {TEAM} knows more, phone {PHONE}. ", "{FIRST} from the {TEAM} knows more, phone {PHONE}. ", "Dial {PHONE} after lunch. ", "Ordered by {NAME}. ", "Signature: {NAME} ", "Both {NAME} and {NAME} were late. ", "{NAME} {VERB} the {GOOD}. ", "{NAME} {VERB} the boat. ", "{NAME} {VERB} it on {DATE}. ", "{FIRST} {VERB} one. ", "{NAME} of the {TEAM} {VERB} a {GOOD}. ", "Mr and Mrs {NAME} {VERB} it. ", "{NAME} {VERB} {LABEL} {ID} on the form. ", "The guest {VERB} {LABEL} {ID} for the {GOOD}. ", "Nobody {VERB} {LABEL} {ID}. ", "The {GOOD} {VERB} a {GOOD}. ", "A {GOOD} {VERB} the {TEAM} where one {VERB} little. ", "{NAME} agrees with us. ", "{NAME} at the {TEAM} has the key. ", "{NAME} came from {ADDRESS} by train. ", "{FIRST} at the {TEAM} has the key. ", "The wages of {NAME} ({LABEL} {ID}) are late. ", "In the purse of {NAME} ({LABEL} {ID}) lay a ticket. ", "He showed {LABEL} {ID} at the gate. ", "She wrote {LABEL} {ID} below. ", "I met {FIRST} near the {GOOD}. ", "Has {FIRST} seen this? ", "The keys are with {NAME}; take care. ", "Ms {NAME} left early. ",
    "Our lease with {COMPANY} is up on {DATE}. ", "{COMPANY} sold us a {GOOD} for {MONEY}. ", "Nobody found the {GOOD} under number {REF}. ", "Machine {REF} stood idle; look at page {NUM}. ", "Model {REF} comes after model {REF}. ", "Parcel {REF} got lost. ", "Waybill number {REF} was read twice. ", "Meter number {REF} is out of order. ", "Tracking code {REF} says nothing. ", "Batch number {REF}, box {REF}. ", "Thanks to {NAME}, Everything is ready. ", "Unlike {NAME}, We stay at home. ", "With {NAME}, Saturday would be fine. ", "After {NAME}, The next one sings. ", "Thanks to {NAME}, As usual, it works. ", "Besides {NAME}, Nobody came. ", "You still owe {MONEY} on card {REF}. ", "A cousin of ours works for {COMPANY}, near the river. ", "Delivered by {COMPANY} for {COMPANY}. ", "Part {REF} fits lot {REF}. ", "Order {REF} has {NUM} boxes. ",
    "There are {NUM} chairs @ {MONEY} apiece. ", "The plan {REF} now sits with the {TEAM}. ", "Take {MONEY} off the {GOOD}. ", "One {GOOD} from box {REF} weighs {NUM} pounds. ", "Dear Sirs, open drawer {REF}. ", "{NUM} crates with a {GOOD} stood in the yard. ", "Yesterday the {TEAM} gave a {GOOD} to the neighbour. ", "Between {DATE} and {DATE} it rained on {NUM} days. ", "Sadly the {GOOD} broke between {DATE} and {DATE}. ", "Somebody from the {TEAM} painted a {GOOD} green. ",
    "As far as we know, the {TEAM} forgot the {GOOD} again. ", "Keep a photo under {REF} as in rule {NUM}. ", "The {TEAM} shut its doors at noon. ", "You get {MONEY} back since {DATE}. ", "In short, bring two pairs of gloves to the {TEAM}. ", "Do you want the {GOOD} of {DATE}? ", "Wash the {GOOD} and dry the rest. ", "Mind that the {TEAM} choir sings on Sunday. ",
    "Bill {REF} comes instead of {REF}. ", "The mill by the bridge is at the end of the road. ", "Your order {REF} of {DATE} is on the way. ", "A young baker saw {NUM} cracks in the {GOOD}. ", "So the {GOOD} went into the {TEAM} book, though the {GOOD} was not there. ", "Besides, new prices hold from {DATE}. ", "People from {COMPANY} will come on {DATE}. ", "What a {GOOD}! ", "It will cost about {MONEY}, maybe less. ", "Every {GOOD} needs oil and some patience before winter. ",
]
HOLD = 5  # every so many frames one can be held out


def frames(which: str = "all") -> tuple[list[str], list[str], list[str]]:
    """Frames of all kinds: all, those to train on if some are held out, or those held out."""
    keep = {"all": lambda i: True, "train": lambda i: i % HOLD != HOLD - 1, "held": lambda i: i % HOLD == HOLD - 1}[which]
    return tuple([f for i, f in enumerate(group) if keep(i)] for group in (HEADS, FIELDS, SENTENCES))


def fill(template: str, m: Maker) -> tuple[str, list[tuple[int, int, str]]]:
    """Text of a template and its labelled spans."""
    text, spans = "", []
    rest = template
    while rest:
        before, brace, after = rest.partition("{")
        text += before
        if not brace:
            break
        slot, _, rest = after.partition("}")
        value = getattr(m, slot)()
        title, mark, item = value.partition("\1")
        if mark:
            text += title
            value = item
        if slot in LABELLED:
            spans.append((len(text), len(text) + len(value), LABELLED[slot]))
        text += value
        if slot == "LABEL" and value[-1:].isalpha() and m.r.random() < 0.25:
            text += m.pick([":", " no.", " #", " is", " number is", " (renewed)", " (new one)", " of the tenant", " number"])
    return text, spans


def _wrap(text: str, spans: list[tuple[int, int, str]], m: Maker) -> tuple[str, list[tuple[int, int, str]]]:
    """Lines broken at spaces, at times within a word with a hyphen."""
    width, column, out, at = m.r.randint(35, 90), 0, [], []
    for i, c in enumerate(text):
        at.append(len(out))
        column = 0 if c == "\n" else column + 1
        if c == " " and (column > width - m.r.randint(0, 12) or m.r.random() < 0.012):
            out.append("\n")
            column = 0
        else:
            out.append(c)
            if column > width and text[i - 2 : i + 3].isalpha() and m.r.random() < 0.3:
                out += ["-", "\n"]
                column = 0
    at.append(len(out))
    return "".join(out), [(at[a], at[b], k) for a, b, k in spans]


def samples(n: int = 1500, seed: int = 11, which: str = "all") -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` short documents with their labelled spans."""
    m = Maker(seed)
    heads, fields, sentences = frames(which)
    out = []
    for _ in range(n):
        parts = [m.pick(heads)] if m.r.random() < 0.7 else []
        parts += [m.pick(fields) for _ in range(m.r.randint(1, 5))]
        parts += [m.pick(sentences) for _ in range(m.r.randint(1, 6))]
        if m.r.random() < 0.5:
            parts += ["\n", m.pick(fields)]
        text, spans = "", []
        shout = m.r.random() < 0.07
        for p in parts:
            piece, found = fill(p, m)
            spans += [(a + len(text), b + len(text), k) for a, b, k in found]
            text += piece
        text, spans = _wrap(text, spans, m)
        out.append((text.upper() if shout and len(text.upper()) == len(text) else text, spans))
    return out
