"""Labelled notes for training the span finder, made by a grammar. A note is a run of clauses; a clause puts a mention, or
something that only looks like one, after a label, into the place of a subject or an object, or by itself, among
everyday words. So the finder has to learn how mentions are built and where they stand, not how certain notes are
worded. Names, streets and towns come from the lists the caller gives and from lists below."""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "id_number", "street_address", "person_name")

# Everyday words of which clauses are made, English and Spanish, and labels of mentions.
LABELS = {
    "p": "phone|ph|ph#|tel|telephone|cell|cellphone|mobile|mobile no|fax|fax no|work line|landline|best number|alt number|contact no|number|call-back number|text|sms|whatsapp|voicemail|direct|celular|telefono|numero|movil|llamar",
    "e": "email|e-mail|mail|email addr|contact email|email on record|web login|username|send docs|correo|correo electronico|escribir",
    "s": "ssn|ss number|soc sec|social|social sec. number|tax id|taxpayer id|itin|last known ssn|no. de seguro|nss",
    "m": "mbi|medicare id|medicare number|medicare card no|new mbi|card id|medicare|tarjeta medicare|numero de medicare",
    "x": "passport|passport no|passport number|pp no|travel document|pasaporte|pasaporte no|no. de pasaporte",
    "d": "dl|d/l|driver lic|driving licence|drivers license no|license number|state id|licencia de conducir|id del estado|operator licence",
    "a": "address|addr|mailing address|home address|residence|lives at|location|billing address|physical addr|ship to|moved to|new place|deliver to|property|direccion|dir|domicilio nuevo|reside en|vive ahora en|casa",
    "n": "name|contact|primary contact|spouse|in an emergency|poa|power of attorney|guardian|trustee|payer|subscriber|insured|beneficiary|caller|witness|attn|c/o|agent of record|daughter|son|wife|husband|mother|father|sister|brother|partner|landlord|"
         "nombre|contacto|beneficiario|hija|hijo|madre|padre|hermano|hermana|vecina",
}
SEPARATORS = (": ", ": ", " ", " ", " - ", " = ", " is ", " was ", " es ", ":", " -> ", " > ", " (", "; ")
BEFORE_PERSON = "ask|ask for|w/|spoke to|talk to|talked with|lives with|wait for|called|met|emailed|texted|visited|saw|phoned|reached|told|asked|thanked|reminded|with|for|from|to|by|via|about|and|per|says|cc|copied|married|replaced|helping|care of|signed by|sent by|payment from|gift for|llame a|con|para|de parte de|hable con|segun|habla".split("|")
AFTER_PERSON = ("co-signed|takes calls|answers it|called|phoned|wrote|said no|said yes|agreed|signed|declined|moved|is away|is retired|is the executor|was rude|will pay|will decide|wants a quote|has questions|has moved|asked why|needs help|needs a ride|came by|left early|lives next door|"
                "picks up|pays the bill|speaks Spanish|is hard of hearing|got married|turned 65|can sign|forgot|cannot drive|works nights|llamo ayer|quiere cambiar|no contesta|firmo|vive sola|paga todo").split("|")
BEFORE_VALUE = {
    "p": "dial|ring|try|use|text|reach me on|leave a message on|she picks up|get him on|wrong number was|disconnected:|new line|ask at|marque|numero nuevo|contesta en|forwarded to|returned call from|missed call".split("|"),
    "e": "write to|reply to|forward to|send it to|invite|bounced from|subscribed as|contact via|copy goes to|escriba a|mandar a|enviar a|login".split("|"),
    "a": "moving to|relocated to|drop off at|meet at|came back from|sent to|mail for|the house on|rents|owns|sold|bought|stays at|inherited|inspects|visit at|package went to|se muda a|enviar todo a|queda en|leased".split("|"),
    "i": "verified|showed|copied|scanned|typed|matched|misread|on the card|on the form|reads|ends with his full|presented|entered|enrolled under|mostro|confirmo|recorded as|belongs to".split("|"),
}
AFTER_VALUE = ("is wrong|is right|is the new one|after six|before noon|only mornings|if urgent|no answer|never worked|is best|please|today|next week|until fall|as backup|and hang up|for now|thanks|was typed twice|fails the check|was rejected|is for sale|is empty|"
               "por favor|es mejor|ya no sirve|manana").split("|")
WORDS = ("the a an this that our your his her their new old other next last first second final open closed late early small large blue green north several many few both same wrong right good bad quick slow paper letter packet card bill notice form folder "
         "page copy file claim plan policy premium deductible copay quote renewal rider benefit network pharmacy doctor clinic dentist hospital seminar webinar office desk branch carrier broker agent client member household family account bank draft check "
         "refund payment balance credit fee rate tier drug pill generic brand test scan visit surgery cane walker car boat garden dog cat church school library lunch coffee weather snow rain traffic holiday birthday vacation trip cruise weekend morning evening "
         "today tomorrow yesterday soon later again twice once never always maybe still already almost about around before after during without within because while though unless if when where why how and but or so then also only just very too not no yes "
         "wants needs likes hates asked asks said says told will would can cannot could should may might has had have is was were be been gets got sent send mailed mail faxed got paid pays owes lost found broke moved kept changed dropped added removed signed "
         "canceled waiting reviewing comparing thinking reading driving walking sleeping working retired deaf blind tired happy angry worried confused busy sick better worse fine ok "
         "para con sin sobre entre desde hasta porque cuando donde como pero tambien muy mas menos nuevo vieja casa carta tarjeta poliza prima pago banco oficina medico farmacia manana tarde noche semana mes ano quiere necesita dice llama paga cambia espera recibe pregunta").split()
#: Whole sentences, written for this list: {n} a person, {f} a first name, {l} a surname, {e} {p} {s} {m} {x} {d} {a} other mentions,
#: {D} a date, {K} a carrier or company, {T} something that only looks like a mention.
SENTENCES = """
Left two messages this week and heard nothing.|Quoted three drug plans, he picks one by Friday.|Not interested until the fall.|Hearing aids are what she cares about.|Dental was the deciding factor.|Doctor dropped out of the {K} network.
Applied for help with drug costs.|Card arrived damaged, ordered another.|Autopay failed, card expired.|Evenings suit this client.|Do not call at work.|Bad line, could hardly hear.|Wants everything by post.|Reviewed the summary of benefits together.
Medication list updated {D}.|Application accepted by {K}.|{K} asks for a signature on page two.|Waiting on {K} to post the payment.|Switched from {K} to {K} on {D}.|{K} denied the appeal.|Sent the kit through {K}, {T}.|Complaint filed with {K}, {T}.
Keep an eye on the rate increase.|Voicemail is full.|Gate code changed, park in the back.|Needs an interpreter for the meeting.|Birthday in {D}, send a card.|Snowbird, gone from November through March.|Rents out the lower floor.|New roof, asks about home insurance.
Tier exception granted, good through {D}.|Met at the {T} booth.|Came to the workshop at {T}.|Has a pension from {K}.|Retires {D}.|Turns sixty-five in {D}.|Lost coverage {D}, special period applies.|Paid {T} by check.|Copay went up to {T}.|{T} closed, {T} open.
Nothing new.|Same plan again.|All good here.|Asked for a manager.|Documents scanned and filed.|Signature missing, mailed back {D}.|Quick chat, will think it over.|Returned mail, see above.|Duplicate entry merged.|Please verify before closing.|Two policies, one household.
No quiere cambiar nada.|Pidio una cita para la tarde.|Entregamos los papeles el {D}.|Falta la firma.|Prefiere hablar en persona.|La prima subio {T}.|Cliente satisfecha con {K}.|Ya tiene cobertura con {K}.|Vuelve en {D}.|Revisamos los beneficios juntos.|Esperando respuesta de {K}.
{n} asked us to stop calling.|{n} does all the forms.|Meeting with {n} on {D}.|We need a form from {n}.|{f} forgot the password again.|{f} is home after surgery.|Saw {f} and {f} at the fair.|My call with {n} was cut off.|The caller, {n}, would not give a date of birth.
{n} has power of attorney since {D}.|Authorized to talk: {n}.|Policy was written by {n}, now retired.|Try {f} first, then {n}.|{f} will bring the checks.|Neighbor {n} waters the plants and gets the mail.|Her son {f} drives her.|Talked it over with {f}.|{n} (daughter) lives abroad.
Dr. {l} prescribes the insulin.|Appointment with Dr. {l} moved to {D}.|Mr. {l} hung up.|Mrs. {l} would like a paper copy.|Ms. {l} at {K} confirmed it.|Thank {f} for the referral.|Refund goes to {n}, {a}.|Estate of {n}, contact {n}.|Premium paid by {n} since {D}.
Number on the account is {p}.|Fax the letter to {p}.|{p} rings and rings.|Best reached under {p} after lunch.|Use {p} instead of {p}.|He gave {p} as a second number.|{f} can be reached at {p}.|Her new line: {p}.|Sister at {p}.|Bank wants a call: {p}.
Confirmation goes to {e}.|{e} is no longer in use.|Please invite {e} to the portal.|Typo in the email, should be {e}.|{n}, {e}, {p}.|He reads {e} once a week.|Emailed the quote to {e} on {D}.|Two logins: {e} and {e}.
Social on the application was {s}.|Typed {s} by mistake.|Bank form lists {s}.|Medicare letter shows {m}.|Part A starts {D}, number {m}.|Old card said {m}, new one {m}.|Passport {x} expires {D}.|Looked at driver license {d}, fine.|Photo id {d} on file.|Their W-9 has {s}.
Delivered to {a}.|Forwarding address {a}.|They winter at {a}.|Spends the summer at {a}.|Sold the place at {a} in {D}.|{a} is a vacant lot.|Card was mailed to {a} by {K}.|Her daughter lives at {a}.|Wrong house: {a}. Right one: {a}.|Office moved to {a}.
{n} firmo los papeles.|Hable con {f} sobre la tarjeta.|El numero de {f} es {p}.|La carta llego a {a}.|Se mudo a {a} en {D}.|El hijo, {n}, maneja todo.|Mande la cotizacion a {e}.|Su tarjeta de Medicare dice {m}.|Dra. {l} ya no acepta {K}.|{f} vive con su nieta {f}.
""".replace("\n", "|").strip("|").split("|")
#: Capitalised words and pairs that are no people.
THINGS = ("Blue Ridge Plan|Golden Years|Silver Script|Part B|Part D|Plan G|Plan N|Open Enrollment|Extra Help|Social Security office|Medicare Advantage|Welcome Kit|Star Rating|Annual Notice|Grace Period|Summer Fair|Rotary Club|Senior Center|Red Cross|"
          "Main Library|Oak Hill Clinic|St. Luke Hospital|Mercy General|Union Bank|First National|Lake County|Orange County|New Mexico|North Dakota|Kansas City|Salt Lake City|Grand Rapids|San Antonio|Santa Fe|Baton Rouge|Palm Beach|Puerto Rico|Costa Rica|"
          "Fourth of July|Labor Day|Mother's Day|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|Spanish|English|Walmart|Walgreens|Costco|Zoom|Excel|Outlook|DocuSign|HMO|PPO|PDP|CRM|AEP|OEP|SEP|IRS|DMV|AARP").split("|")
SIGN_OFFS = ("", "", "", "", " (ok)", " (old)", " !!", "!", " ...", " ??", " - done", ", see scan", " as agreed", " [todo]", " / urgent", " *new*")
OPENERS = ("", "", "", "", "", "note: ", "fyi ", "todo - ", "* ", "-- ", "Hi, ", "RE ", "ps. ", "{D}: ", "{D} - ", "update {D}. ", "nota: ", "ojo, ", "1) ", "Q: ")
JOINS = (" ", ". ", "; ", ", ", "\n", " | ", " + ", " - ", " / ", ".  ", "\n- ", " & ")
# Names from elsewhere, beside those of the lists the caller gives.
MORE_FIRSTS = ("Nguyen Thi Minh Linh Duc Hong Wei Mei Xiu Jun Hiroshi Yuki Keiko Min-jun Ji-woo Priya Anil Sanjay Lakshmi Arjun Fatima Omar Ahmed Yusuf Layla Amina Kwame Abena Chidi Ngozi Tunde Ifeoma Olga Dmitri Svetlana Pavel Katarzyna Zbigniew Ivana Marko "
               "Giulia Lorenzo Francois Amelie Jean-Luc Ingrid Bjorn Sven Astrid Siobhan Declan Rhys Eluned Xochitl Itzel Kai Leilani Bartholomew Ezekiel Prudence Thaddeus Winifred Esperanza Guadalupe Ximena Joaquin Anselmo").split()
MORE_LASTS = ("Nguyen Tran Pham Le Vo Chen Wang Zhang Liu Kim Park Choi Tanaka Suzuki Patel Sharma Singh Gupta Reddy Khan Hussain Al-Masri Haddad Rahman Okafor Adeyemi Mensah Nkrumah Diallo Ivanova Petrov Sokolov Kowalczyk Nowak Novak Horvat Rossi Bianchi "
              "Dubois Lefebvre Moreau Johansson Lindqvist Andersen O'Sullivan MacGregor McAllister Llewellyn Kealoha Begay Tsosie Van-Dyke Weatherby Featherstone Abernathy Goldfarb Rosenzweig Szymanski Papadopoulos Castellanos Villanueva Zuniga Ibarra").split()
MORE_STREETS = ("Massachusetts Pennsylvania Michigan Jefferson Lincoln Washington Franklin Madison Maple Cedar Elm Walnut Chestnut Birch Sycamore Magnolia Church School Mill River Lake Park Main Market Front Water High Union Broadway Spruce Prospect "
                "Sunset Highland Meadow Orchard Valley Canyon Desert Harbor Ocean Bay Rosewood Foxglove Heron Falcon Saddle Wagon Pioneer Liberty Independence Martin Luther King San Pedro Camino Real Del Sol Mesa Verde").split()
CARRIERS = ("Humble Oak Life", "Carver Mutual", "Bluestem Health", "Pinnacle Care", "Golden Harbor", "Redwood Shield", "Tidewater", "Summit Senior", "Union Prairie", "Beacon Life")
MONTHS = "January February March April May June July August September October November December Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec enero marzo abril mayo agosto".split()
KIN = "niece sister daughter son grandson brother neighbor nephew wife husband cousin aunt uncle grandmother stepson roommate friend".split()
TITLES = ("Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Mr ", "Mrs ", "Dr ", "Sr. ", "Sra. ", "Miss ", "Don ", "Doña ", "Rev. ", "Prof. ")
TYPES = "Way Trail Trl Loop Row Alley Plaza Square Rd Road St Street Ave Avenue Ct Court Pkwy Parkway Hwy Highway Ln Lane Cir Circle Blvd Boulevard Ter Terrace Dr Drive Pl Place".split()
DIRS = ("", "", "N ", "S ", "E ", "W ", "N. ", "S. ", "E. ", "W. ", "North ", "South ", "West ", "East ", "NE ", "SW ")
ENDS = ("park", "bend", "ridge", "glen", "hill", "hollow", "field", "creek", "spring", "run")
TOWN_STARTS = ("", "", "North ", "South ", "East ", "West ", "Port ", "Fort ", "Lake ", "Saint ", "St. ", "Mount ", "Upper ", "Old ", "New ", "Point ")
CODES = "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()
HOSTS = ("gmail.com", "yahoo.com", "outlook.com", "aol.com", "my-agency.biz", "school.k12.us", "correo.mx", "co.uk.example", "example.com", "example.net", "example.org", "mail.example", "home.example", "inbox.test", "post.example")


class Filler:
    def __init__(self, firsts: list[str], lasts: list[str], streets: list[str], towns: list[str], seed: int, words: list[str] | None = None):
        names = {w.lower() for x in (*firsts, *lasts, *MORE_FIRSTS, *MORE_LASTS) for w in x.split()}
        self.words = [w for w in words or WORDS if w not in names]
        self.r, self.firsts, self.lasts, self.streets, self.towns = random.Random(seed), firsts, lasts, streets, towns
        self.odd = [l for l in lasts if not re.fullmatch(r"[A-Za-z]+", l)] or lasts
        self.streets = streets + MORE_STREETS * max(1, len(streets) // (2 * len(MORE_STREETS)))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def date(self) -> str:
        r = self.r
        m, d, y = r.randint(1, 12), r.randint(1, 28), r.choice(("25", "2025", "26", "2026", "1951", "48"))
        return r.choice((f"{m}/{d}", f"{m}/{d}", f"{m}/{d}/{y}", f"{m}-{d}-{y}", f"20{r.randint(10, 27)}-{m:02}-{d:02}", f"{r.choice(MONTHS)} {d}", f"{d} {r.choice(MONTHS)}", f"{r.choice(MONTHS)} {d}, 20{r.randint(10, 27)}"))

    def invented(self, like: str) -> str:
        """A word of the same build as `like`, so that the finder learns where names stand, not only which."""
        r, out = self.r, ""
        for c in like.lower():
            out += r.choice("aeiou") if c in "aeiou" else c if not c.isalpha() or r.random() < 0.4 else r.choice("bcdfghlmnprstvwz")
        return out[:1].upper() + out[1:]

    def first(self) -> str:
        f = self.r.choice(self.firsts if self.r.random() < 0.72 else MORE_FIRSTS)
        return self.invented(f) if self.r.random() < 0.12 else f

    def last(self) -> str:
        x = self.r.random()
        l = self.r.choice(self.lasts if self.r.random() < 0.75 else MORE_LASTS)
        if x < 0.04:
            l = self.r.choice(("de la ", "de ", "Le ", "la ", "del ", "O'", "D'", "Mc", "van ", "Van der ")) + l.split()[-1]
        elif x < 0.08:
            l = self.r.choice(self.odd)
        l = self.invented(l) if self.r.random() < 0.12 else l
        return f"{l}-{self.r.choice(self.lasts)}" if self.r.random() < 0.05 else l

    def cased(self, s: str) -> str:
        x = self.r.random()
        return s.upper() if x < 0.1 else s.lower() if x < 0.2 else s

    def name(self) -> str:
        r, f, l = self.r, self.first(), self.last()
        x = r.random()
        if x < 0.16:
            return self.cased(f"{l}, {f}")
        if x < 0.24:
            return self.cased(f"{f[0]}. {l}")
        if x < 0.34:
            return self.cased(f"{f} {r.choice('ABCDEFGHJKLMNRST')}{r.choice(('.', '.', ''))} {l}")
        if x < 0.42:
            return self.cased(f"{f} {self.first()} {l}" if r.random() < 0.5 else f"{l} {f} {self.first()}")
        if x < 0.45:
            return self.cased(f"{f} {l}{r.choice((' Jr', ' Sr', ' III', ', Jr.'))}")
        return self.cased(f"{f} {l}")

    def email(self) -> str:
        r, f, l = self.r, self.first().lower(), re.sub(r"[^a-z]", "", self.last().lower())
        user = r.choice((f"{f}.{l}", f"{f}_{l}", f"{f}{r.randint(1, 99)}", f"{f}-{l[:1]}", f"{f[0]}{l}", f"{l}+mail", f"{l}{r.randint(1, 99)}"))
        host, x = r.choice(HOSTS), r.random()
        if x < 0.1:
            return f"{user}{r.choice((' (at) ', '(at)', ' [at] ', '[at]'))}{host}"
        if x < 0.24:
            return f"{user} at {host.replace('.', ' dot ')}"
        if x < 0.28:
            return f"{user} arroba {host.replace('.', ' punto ')}"
        return f"{user}@{host}".upper() if x < 0.33 else f"{user}@{host}"

    def phone(self) -> str:
        r = self.r
        a, b, c = self.digits(3).replace("0", "2", 1), r.choice(("555", self.digits(3))), self.digits(4)
        if r.random() < 0.12:
            return r.choice((f"+44 20 {self.digits(4)} {c}", f"+44 7{self.digits(3)} {self.digits(6)}", f"+52 55 {self.digits(4)} {c}", f"+34 {self.digits(3)} {self.digits(2)} {self.digits(2)} {self.digits(2)}", f"+49 30 {self.digits(7)}",
                             f"011 52 {self.digits(3)} {self.digits(3)} {c}", f"+{r.randint(2, 98)} {self.digits(3)} {self.digits(3)} {self.digits(3)}", f"+91-{self.digits(5)}-{self.digits(5)}", f"0044 {self.digits(4)} {self.digits(6)}"))
        tail = r.choice(("", "", "", "", f" x{r.randint(2, 4999)}", f" ext {r.randint(2, 499)}", f" ext. {r.randint(2, 499)}", f" extension {r.randint(2, 499)}", f"x{r.randint(10, 99)}")) if r.random() < 0.5 else ""
        return r.choice((f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"+1 {a} {b} {c}", f"1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+1{a}{b}{c}", f"1 {a} {b} {c}",
                         f"{a}/{b}-{c}", f"{b}-{c}", f"{a}{b}{c}", f"{a} {b}-{c}", f"{a}-{b}.{c}")) + tail

    def ssn(self) -> str:
        a, b, c = self.r.choice(("9", "9", self.r.choice("12345678"))) + self.digits(2), self.digits(2), self.digits(4)
        sep = self.r.choice(("-", "-", ".", " ", ""))
        return f"{a}{sep}{b}{sep}{c}"

    def mbi(self) -> str:
        r, L = self.r, "ACDEFGHJKMNPQRTUVWXY"
        L1 = lambda: r.choice(L)
        head, mid, end = f"{r.choice('12345')}{r.choice(('EG', L1() + L1()))}{r.randint(0, 9)}", f"{L1()}{r.choice(L + '0123456789')}{r.randint(0, 9)}", f"{L1()}{L1()}{self.digits(2)}"
        s = "-".join((head, mid, end)) if r.random() < 0.35 else head + mid + end
        return s.lower() if r.random() < 0.2 else s

    def passport(self) -> str:
        r = self.r
        return r.choice((r.choice("XABCPGEY") + self.digits(8), r.choice("XABCPGEY") + self.digits(8), r.choice("ABCXG") + self.digits(7), self.digits(9), "".join(r.choice("ABCGHKLM") for _ in "ab") + self.digits(7)))

    def licence(self) -> str:
        """Layouts of driving licences of several states."""
        r, L = self.r, self.r.choice("ABCDEFGHJKLMNPRSTVWYZ")
        d = self.digits
        return r.choice((f"{L}{d(3)}-{d(4)}-{d(4)}", f"{L}{d(3)}-{d(4)}-{d(4)}", f"{L}{d(3)}-{d(3)}-{d(2)}-{d(3)}-{d(1)}", f"{L}{d(7)}", f"{L}{d(8)}", f"{d(3)} {d(3)} {d(3)}", f"{d(8)}", f"{L}{L}{d(6)}", f"{L}{d(2)}-{d(2)}-{d(4)}", f"{L}{d(12)}"))

    def address(self) -> str:
        r, x = self.r, self.r.random()
        if x < 0.14:
            s = r.choice(("PO Box ", "P.O. Box ", "P O Box ", "POB ", "Box ", "P.O.Box ", "Post Office Box ", "RR 2 Box ")) + str(r.randint(1, 9999))
        elif x < 0.2:
            s = f"{r.randint(1, 29999)} " + r.choice(("Highway ", "Hwy ", "Route ", "County Road ", "CR ", "State Rd ", "US ", "Rte ")) + str(r.randint(1, 999))
        else:
            street = r.choice(self.streets).title() if r.random() < 0.8 else self.invented(r.choice(self.streets))
            if r.random() < 0.5:
                street += r.choice((" ", " ", "")) + (e.title() if (e := r.choice(ENDS)) and street[-1:].isalpha() and r.random() < 0.7 else e)
            elif r.random() < 0.15:
                n = r.randint(1, 120)
                street = f"{n}{'th' if n % 100 in (11, 12, 13) else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"
            kind = r.choice(TYPES)
            s = f"{r.randint(1, 9999)}{r.choice(('', '', '', '', 'B', '-A'))} {r.choice(DIRS)}{street} {kind}{r.choice(('', '', '', '.'))}"
            if r.random() < 0.1:
                s += r.choice((" N", " SW", " East", " NE"))
            if r.random() < 0.32:
                s += r.choice((" Apt ", " #", " Unit ", ", Apt ", ", Unit ", " Ste ", " Suite ", " Rm ", " Lot ", " apt ", ", #", " Apt. ", " No. ", " Floor ", " Bldg ")) + r.choice((str(r.randint(1, 800)), f"{r.randint(1, 20)}{r.choice('ABCD')}", r.choice("ABCDEF"), f"{r.choice('ABC')}-{r.randint(1, 30)}"))
        x = r.random()
        if x < 0.55:
            town = r.choice(self.towns).title() if r.random() < 0.65 else (r.choice(TOWN_STARTS) + self.invented(r.choice(self.towns)).split()[-1].title())
            s += r.choice((", ", ", ", ", ", " ", " in ") if x < 0.03 else (", ", ", ", " ")) + town + r.choice((f", {r.choice(CODES)} {self.digits(5)}", f", {r.choice(CODES)} {self.digits(5)}", f" {r.choice(CODES)} {self.digits(5)}", f", {r.choice(CODES)} {self.digits(5)}-{self.digits(4)}", f" {r.choice(CODES)}", f", {r.choice(CODES)}", ""))
        elif x < 0.62:
            s += r.choice((f" {self.digits(5)}", f", {self.digits(5)}", f", {r.choice(CODES)}", f" {r.choice(CODES)} {self.digits(5)}"))
        return s.upper() if r.random() < 0.06 else s.lower() if r.random() < 0.06 else s

    def thing(self) -> str:
        """What looks like a mention and is none: numbers of plans, policies, cases and orders, amounts, dates, places, carriers."""
        r, d = self.r, self.digits
        x = r.random()
        if x < 0.34:
            if r.random() < 0.4:
                return self.company()
            return r.choice((f"{r.choice(CARRIERS)}", f"{r.choice(CARRIERS)} {r.choice(('HMO', 'PPO', 'Plan N', 'plan', 'drug plan', 'rep'))}", r.choice(THINGS), r.choice(THINGS), r.choice(THINGS), r.choice(MONTHS), r.choice(self.towns).title(), f"{r.choice(self.towns).title()}, {r.choice(CODES)}", r.choice(CODES)))
        if x < 0.5:
            return self.date()
        if x < 0.62:
            return r.choice((f"${d(2)}.{d(2)}", f"${r.randint(1, 9)},{d(3)}", f"${d(3)}", f"{r.randint(2, 90)} days", f"{r.randint(2, 40)} min", f"{r.randint(1, 99)}%", f"age {r.randint(60, 99)}", f"{r.randint(1, 12)}:{d(2)} pm", f"20{r.randint(10, 27)}", f"{r.randint(2, 12)} of {r.randint(12, 30)}", f"page {r.randint(1, 90)}"))
        label = r.choice(("policy ", "Policy no. ", "policy# ", "case ", "case # ", "ticket ", "order ", "order no. ", "claim ", "claim# ", "ref ", "ref. ", "conf # ", "invoice ", "agent ", "NPN ", "npn: ", "group ", "member id ", "Plan ", "contract ", "form ", "batch ", "acct ", "poliza ", "caso ", "tracking ", "check # ", "room ", "zip ", "confirmation "))
        return label + r.choice((f"P-{d(8)}", f"{r.choice('HRS')}{d(4)}-{d(3)}", f"{r.choice('HRS')}{d(4)}-{d(3)}-{d(3)}", d(4), d(5), d(6), d(7), d(8), d(9), f"{d(3)}-{d(4)}-{d(2)}", f"{d(4)}-{d(4)}", f"{r.choice('ABCDEJKQRSW')}{r.choice('ABCDEJKQRSW')}{d(6)}", f"{r.choice('CDJQ')}{d(6)}{r.choice(('', 'K', 'X'))}", f"{d(2)}-{d(6)}", f"20{d(2)}-{d(4)}-{d(3)}", f"#{d(5)}", f"{d(3)}-{d(2)}-{d(2)}", f"1{d(7)}", f"2{d(8)}"))

    def company(self) -> str:
        r = self.r
        head = [r.choice((self.last, lambda: self.invented(r.choice(self.lasts)), lambda: r.choice(self.words).title(), lambda: r.choice(self.streets).title()))() for _ in range(r.choice((1, 1, 2)))]
        return " ".join(head) + " " + r.choice(("Health", "Life", "Mutual", "Care", "Shield", "Insurance", "Group", "Bank", "Clinic", "Company", "Plan", "Advantage", "Medical Center", "Pharmacy", "Seminar", "Office", "Senior Care", "Inc", "LLC", "HMO", "PPO", "Hospital", "Agency", "County"))

    def chatter(self, least: int, most: int) -> str:
        """Everyday words in no order, some with a capital; some things among them."""
        r = self.r
        out = []
        for _ in range(r.randint(least, most)):
            x = r.random()
            w = r.choice(WORDS) if x < 0.4 else r.choice(self.words) if x < 0.93 else self.thing()
            out.append(w.title() if x < 0.93 and r.random() < 0.06 else w)
        s = " ".join(out)
        return s[:1].upper() + s[1:] if r.random() < 0.5 else s

    def mention(self, k: str) -> tuple[str, str]:
        return {
            "n": lambda: (self.name(), "person_name"), "f": lambda: (self.cased(self.first()), "person_name"), "l": lambda: (self.last(), "person_name"), "e": lambda: (self.email(), "email"), "p": lambda: (self.phone(), "phone"),
            "s": lambda: (self.ssn(), "id_number"), "m": lambda: (self.mbi(), "id_number"), "x": lambda: (self.passport(), "id_number"), "d": lambda: (self.licence(), "id_number"), "a": lambda: (self.address(), "street_address")}[k]()

    def sentence(self) -> list[str | tuple[str, str]]:
        """A whole sentence with its slots filled."""
        out = []
        for part in re.split(r"\{(\w)\}", self.r.choice(SENTENCES)):
            if len(part) == 1 and part in "nflepsmxda" and len(out) % 2:
                out.append(self.mention(part))
            elif len(part) == 1 and part in "DKT" and len(out) % 2:
                out.append({"D": self.date, "K": lambda: self.r.choice((self.company, lambda: self.r.choice(CARRIERS), lambda: self.invented(self.r.choice(self.lasts))))(), "T": self.thing}[part]())
            else:
                out.append(part)
        return out

    def clause(self) -> list[str | tuple[str, str]]:
        """Texts and mentions (text, kind) of one clause."""
        r, x = self.r, self.r.random()
        if r.random() < 0.5:
            return self.sentence()
        if x < 0.07:  # where a mention might stand there is none
            lead = r.choice(BEFORE_PERSON) if r.random() < 0.6 else r.choice(LABELS[r.choice("nnpea")].split("|")) + r.choice(SEPARATORS[:4])
            return [lead.capitalize() if r.random() < 0.5 else lead, " ", self.thing() if r.random() < 0.5 else self.chatter(1, 3), *((" ", r.choice(AFTER_PERSON)) if r.random() < 0.2 else ())]
        if x < 0.34:
            return [self.chatter(3, 9)] if r.random() < 0.6 else [self.chatter(1, 4), " ", self.thing(), *((" ", self.chatter(1, 3)) if r.random() < 0.5 else ())]
        k = r.choices("nfleapsmxd", (26, 9, 5, 11, 15, 14, 6, 5, 3, 3))[0]
        m = self.mention(k)
        first = [self.chatter(1, 4), r.choice((" ", " ", ", ", ": "))] if r.random() < 0.25 else []
        last = [r.choice((" ", ", ", " ", " - ")), self.chatter(1, 4)] if r.random() < 0.3 else []
        kind = "i" if k in "smxd" else "n" if k in "nfl" else k
        way = r.random()
        if k == "l" or (k in "nf" and way < 0.07):
            return [*first, r.choice(TITLES), self.mention("l") if k == "l" else m, " ", r.choice(AFTER_PERSON), *last]
        if way < 0.34 or (kind == "i" and way < 0.62):
            label = r.choice(LABELS["n" if kind == "n" else k].split("|"))
            sep = r.choice(SEPARATORS)
            label = label.upper() if r.random() < 0.15 else label.capitalize() if r.random() < 0.4 else label
            return [*first, label, sep, m, *((")",) if sep == " (" else ()), *last]
        if kind == "n":
            if way < 0.6:
                verb = r.choice(BEFORE_PERSON)
                return [*first, verb.capitalize() if not first and r.random() < 0.4 else verb, " ", m, *((r.choice((" and ", " y ", " or ", " & ", ", ")), self.mention(r.choice("nf"))) if r.random() < 0.2 else ()), *last]
            if way < 0.85:
                return [*first, m, " ", r.choice(AFTER_PERSON), *last]
            if way < 0.95:
                whose = r.choice(KIN)
                return [*first, r.choice(("her ", "his ", "my ", "the ", "su ", "")), whose, r.choice((" ", " ", ", ", " named ")), m, *((" ", r.choice(AFTER_PERSON)) if r.random() < 0.6 else ()), *last]
            return [m]
        if way < 0.7:
            return [*first, r.choice(BEFORE_VALUE[kind]), " ", m, *((" ", r.choice(AFTER_VALUE)) if r.random() < 0.4 else ()), *last]
        if way < 0.82:
            return [m, " ", r.choice(AFTER_VALUE), *last]
        if way < 0.92:  # a person with it
            return [*first, self.mention(r.choice("nf")), r.choice((" at ", " ", " (", ", ", " <", " - ", ": ", " on ")), m, *last]
        return [m]


def notes(count: int, firsts: list[str], lasts: list[str], streets: list[str], towns: list[str], seed: int = 1, words: list[str] | None = None):
    """(text, [(start, end, kind)]) of `count` invented notes. words are everyday ones beside those above, so that a word
    the finder has not met is no name for that alone."""
    fill = Filler(firsts, lasts, streets, towns, seed, words)
    r = fill.r
    for _ in range(count):
        text, spans = "", []
        for k in range(r.choice((1, 1, 2, 2, 3, 4))):
            if k:
                text += r.choice(JOINS)
            opener = r.choice(OPENERS)
            for part in [opener.replace("{D}", fill.date()), *fill.clause(), r.choice(SIGN_OFFS)]:
                if isinstance(part, tuple):
                    spans.append((len(text), len(text) + len(part[0]), part[1]))
                    part = part[0]
                text += part
        if r.random() < 0.04:
            text = text.upper()
        yield text, spans
