"""Personal information inside free text (problem 1): weak supervision and a span classifier.

Candidate spans are proposed wide, on the consistent form of the text (see ``lookalike``):
anything like an address of e-mail, every number of five digits or more, every token that
mixes letters and digits, street-like phrases, and runs of words that may be a name.
Nothing is dropped before the vote. Labelers of four kinds look at each candidate:
patterns (shape, check digits of national numbers), gazetteers (given names, endings of
family names), a lexicon (which words a public vocabulary knows in lower case, as a
capitalised word, or not at all) and context (the cue before or behind it, what follows).
Each votes for, against, or abstains. The votes of all candidates are counted by pattern
on the executors; expectation-maximisation over these counts estimates each labeler's
reliability without any labels, and a logistic model over votes and shape is trained on
the resulting probabilities. The model alone decides which spans are kept; it scores any
pattern of votes, seen or not, and can be saved and applied to new text.

The number of vote patterns is bounded by the labelers, not by the data, so what reaches
the driver doesn't grow with the corpus.
"""

from __future__ import annotations

import base64
import json
import math
import os
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookalike import default_normalizer
from .storage import publish, texts_in, written

TYPES = ("EMAIL", "PHONE", "ADDRESS", "PERSON", "ID_NUMBER")
#: Public vocabularies the lexicon is derived from (a parameter; without the files the lexicon is empty).
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

PHONE, ID, OTHER, PERSON, TITLE, GIVEN, COMMON, PROPER, FUNCTION, STREET, PARTICLE, MAIL, PLACE, ACTS, PREFIX = (1 << i for i in range(15))

# Single words by what they announce or are, in the languages of the cues.
WORDS = {
    PHONE: """call phone tel telephone cell cellphone mobile text sms fax voice callback hotline whatsapp ring dial landline switchboard picks telefon rückruf handy
        handynummer mobil mobilnummer anrufen teléfono móvil celular llame llama llámame llamar llamen téléphone tél appelez appeler portable telefono cellulare telefone telemóvel bel telefoon
        mobiel zadzwoń komórka телефон звоните позвоните мобильный τηλέφωνο κινητό""",
    ID: """ssn nino ni nin dl travel itin tin social soc insurance passport passports national identity identification citizen licence license licenses driving driver driver's taxpayer tax
        steuer-id steuernummer steueridentifikationsnummer sozialversicherungsnummer reisepass pass personalausweis ausweis ausweisnummer führerschein führerscheinnummer dni nie nif pasaporte
        cédula curp conducir sécurité sociale passeport identité conduire fiscale fiscal identità passaporte patente passaporto aadhaar aadhar pan sin pesel cpf
        bsn rijbewijs paspoort dowód paszport personnummer паспорт снилс инн διαβατήριο ταυτότητα""",
    OTHER: """card kreditkarte karte tarjeta carte iban account konto cuenta compte order orders ticket tickets invoice rechnung factura facture commande bestellung pedido project projekt
        proyecto projet reference referencia référence ref case dossier vorgang expediente part parts version release releases flight room port model modell born birth birthday geboren gateway requests host device
        adapter budget between index serial sku tracking isbn batch build commit amount total price booking reservation section page gate server ip mac заявка заказ
        счёт αίτημα παραγγελία 番号""",
    PERSON: """name named called spoke speak talk talked met meet ask contact dear attn attention regards sincerely thanks cheers signed letter customer client patient tenant
        landlord employee colleague manager author defendant belongs owner holder behalf loop hi hello tell heiße heisse heiss kollege kollegin kunde kundin ansprechpartner läuft informieren grüße gruß
        llamo nombre titular avise paciente cliente saludos atentamente appelle nom prévenir contacter cordialement bonjour cher chère chiamo nome gentile
        saluti chamo cumprimentos heet naam groeten nazywam imię pozdrawiam зовут имя λένε όνομα""",
    TITLE: "mr mrs ms miss dr prof professor sir madam herr frau monsieur madame mme mlle señor señora sr sra signor signora dott pan pani mevrouw meneer",
    STREET: """street st avenue ave road rd lane ln drive dr court ct close blvd boulevard way terrace row crescent square place pl hill gardens walk parade mews rue
        chemin allée impasse quai calle c avenida avda plaza paseo camino ronda travesía carrera via viale piazza corso rua travessa praça ul ulica aleja ulitsa ул улица""",
    PARTICLE: "van von de der den del della di da dos du la le al el bin ibn ben ter ten zu",
    MAIL: """e-mail email mail e-mails mails mailto reply write back cc forward reach login user adresse correo courriel antwort répondez responda correio poczta scrivi odpisz arrived
        почта""",
    PLACE: """live lives living ship moved address billing pick deliver delivery livrez habite vivo envíen envíe wohne wohnen liefern lieferung anschrift abito mieszkam woon moro
        courier located home office visit""",
    ACTS: "will said says say called calls wrote writes asked asks lives works has had joined joins replied agreed wants needs is was and gave gives does did reviewed signed",
    PREFIX: "the a an our this these each every any no some der die das ein eine den dem el la los las un una le les une il lo gli",
    FUNCTION: """a an and the of for to in on at by with from about as or but if so than then it its is are was were be been am will would can could may must shall should do does did has have
        had not no yes who whom whose which what when where why how please whether that this these those there here i me my mine we us our you your he him his she her they them their please
        und oder der die das ein eine den dem des im in ist sind war nicht mit für auf von zu bitte sie er es ich mein meine ihr wir bei y o el la los las un una de del que en es con por para
        favor mi tu su me se no et ou le la les des une dans est que qui sur pas avec du au aux pour mon ma ton je il elle nous vous à merci é e o a os as um uma do da na em il lo gli di che
        per non sono si van het een en is niet met voor op mijn ik w z na i to jest się nie моя мое меня мне и в на с по это και το η ο του της με σε""",
}
# Common given names of many languages, without accents.
GIVEN_NAMES = """abel adam agnieszka ahmed alejandro alessandro alexander ali alice amara amina ana anais anders andre andrea andrew angela anna anne antonio arjun astrid barbara
    beatrix ben bjorn bob carlos carol caroline catherine charles chloe christian christine clara claire daniel dario david deborah dennis diego dmitri dorothy edward eleanor elena elin
    elizabeth ella emily emma eric eva fatima felix fernando francesca frank frederik friederike gabriel george giulia giovanni grace greta guadalupe hamish hannah hans haruto heinrich helen
    henry hiroshi hugo ibrahim ines ingrid isabel ivan jack jacob jakub james jan jane javier jean jennifer jerome jim joan joanna joao joe john jonas jose joseph juan julia julie karen karl
    kate katarzyna kevin kofi laila lakshmi lars laura lea lena leo liam linda lisa louis luca lucas lucia lucja luis magdalena marco margaret maria marie mariam mark marla marta martin mary mateo
    matthew max mehmet mei mia michael miguel mike mohamed muhammad nadia natalia niko nina noah noor olga oliver omar owen pablo patricia paul pedro peter pia pierre priya rachel raj robert
    rodrigo rosa ruth sanjay sara sarah sean sofia soren stefan steve susan svetlana tessa theo thibault thomas tom tomasz uwe victor viktor wei willem william ximena yara yuki yusuf zoe""".split()
# Endings that family names share.
FAMILY_ENDINGS = ("son", "sen", "ström", "strom", "berg", "ford", "ley", "by", "worth", "wick", "dale", "mere", "mann", "ović", "ova", "ska", "ski", "etti", "ano", "ez", "nik", "sson", "stein", "man", "ton", "oni", "elli")
# Endings of street names written in one word.
STREET_ENDINGS = ("straße", "strasse", "str", "gasse", "weg", "platz", "allee", "ufer", "damm", "graben", "steig", "straat", "laan", "gracht", "plein", "gatan", "vägen", "vej", "veien")
CURRENCY = r"eur|usd|gbp|chf|euros?|dollars?|yen|pounds?|€|\$|£|percent|%|volts?|seconds?|hours?|minutes?|m²|lines?|rows?|bytes?"

_STOP = FUNCTION | TITLE


def _strip_accents(word: str) -> str:
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("ł", "l").replace("ø", "o")


def read_lexicon(vocabularies: Iterable[str] = VOCABULARIES) -> dict[str, int]:
    """Word -> what it is, as bits: cues and gazetteers, and from public vocabularies COMMON or PROPER.

    A word is common if the vocabulary has it in lower case (and not sooner capitalised),
    proper if it has it capitalised only. Cues also stand in the form the look-alike rewrite gives them.
    """
    best: dict[str, list[float]] = {}
    for path in vocabularies:
        if not os.path.exists(path):
            continue
        with open(path, "rb") as f:
            for piece, rank in map(bytes.split, f):
                word = base64.b64decode(piece).decode("utf8", "ignore")
                if len(word) > 3 and word[0] == " " and word[1:].isalpha():
                    word = word[1:]
                    place = 0 if word.islower() else 1 if word.istitle() else 2
                    ranks = best.setdefault(word.lower(), [math.inf] * 3)
                    ranks[place] = min(ranks[place], int(rank))
    out = {w: COMMON if low <= cap else PROPER for w, (low, cap, _) in best.items() if min(low, cap) < math.inf}
    rewrite = default_normalizer().rewrite
    for bit, words in WORDS.items():
        for w in words.split():
            for form in {w, rewrite(w).lower(), rewrite(w.capitalize()).lower(), rewrite(w.upper()).lower(), _strip_accents(w)}:
                out[form] = out.get(form, COMMON if bit not in (TITLE, PARTICLE) else 0) | bit
    for w in GIVEN_NAMES:
        out[w] = out.get(w, 0) & ~COMMON | GIVEN
    return out


def _twice(pattern: str, flags: int = 0) -> tuple[re.Pattern, re.Pattern]:
    """A pattern for any text and its equal, faster form for ASCII text."""
    return re.compile(pattern, flags), re.compile(pattern, flags | re.A)


_WORDS = re.compile(r"([^\W\d_]+(?:['’-][^\W\d_]+)*)"), re.compile(r"([A-Za-z]+(?:['-][A-Za-z]+)*)")
_CURRENCY_NEXT = re.compile(rf"\s*(?:{CURRENCY})(?!\w)", re.I)
_AT = r"(?:@|\s*[\[({<]\s*(?:at|@|a)\s*[\])}>]\s*)"
_DOT = r"(?:\.|\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*)"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_EMAIL = _twice(
    rf"(?<![\w.+'%-])[^\W_][\w.+'%-]*(?:{_AT}{_LABEL}(?:(?:{_DOT}|\s+dot\s+){_LABEL})+|\s+at\s+{_LABEL}(?:(?:\.|\s+dot\s+){_LABEL})+(?![\w.+'%-]*(?:\s+at\s|\s*(?:@|[\[({{<]))))", re.I
)
_MAYBE_MAIL = _twice(r"[\[({<]\s*(?:at|a)\s*[\])}>]|\sat\s+[\w-]+(?:\.\w|\s+dot\s)")
_HOST = re.compile(rf"{_AT}|\s+at\s+", re.I)
_SPELLED = re.compile(r"[\[({<]|\sdot\s", re.I)
_TLD = re.compile(r"(?:\.|dot[\])}>]?\s*|[\[({<]\s*\.\s*[\])}>]\s*)([^\W\d_]{2,})$", re.I)
_LINK_BEFORE = re.compile(r"://\S*$")
_NUMBER = _twice(r"(?<![\w#@])(?<!\d[./:-])(?:\+\s?)?\(?\d(?:[ \t\n\r().\-/]{0,3}\d){4,}(?:\s*(?:x|ext\.?|extension)\s*\d{1,5})?(?![\w@])", re.I)
_EXTENSION = re.compile(r"\s*(?:x|ext\.?|extension)\s*\d{1,5}$", re.I)
_CODED = _twice(
    r"(?<![\w#@/])(?=[A-Za-z]{0,6}[ -]?\d)(?:[A-Za-z]{2}(?: ?\d{2}){3} ?[A-Za-z]|[XYZxyz]-?\d{7}-?[A-Za-z]|\d{8}-?[A-Za-z]|[A-Za-z]{1,3}-?\d{5,9}"
    r"|\d \d{2} \d{2} (?:\d{2}|2[ABab]) \d{3} \d{3}(?: \d{2})?|(?=[A-Za-z]*\d[A-Za-z\d]*\d)(?=\d*[A-Za-z])[A-Za-z\d]{6,})(?![\w@-])"
)
_BEHIND_ID = re.compile(r"[\s\"':=#(,.-]*(?P<id>(?=[^\W_]*\d|[^\W\d_]+[./-]\d)[^\W_]+(?:[ ./-][^\W_]*\d[^\W_]*)*)(?![\w@])")
_STREET = _twice(
    r"(?<![\w.,-])\d{1,5}(?:\s*(?:bis|ter|quater))?,?\s+(?:rue|avenue|boulevard|chemin|all[ée]e|impasse|place|quai|route|cours)\s+(?:(?:de|du|des|la|le|les|d'|l')\s*)*[^\W\d_][\w'’-]*"
    r"|(?<![\w.,-])\d{1,5}\s?[a-z]?\s+(?:(?:n|s|e|w|north|south|east|west)\.?\s+)?(?:[^\W\d_][\w'’-]*\s+){1,3}?(?:street|st|avenue|ave|road|rd|lane|ln|drive|dr|court|ct|close|blvd|boulevard|way|terrace|row|crescent|square|place|pl|hill|gardens|walk|parade|mews)(?!\w)"
    r"|(?<!\w)(?:calle|c/|avenida|avda\.?|plaza|paseo|camino|ronda|traves[íi]a|carrera|via|viale|piazza|corso|rua|travessa|pra[çc]a|ul\.?|ulica|aleja|ул\.?)\s+(?:[^\W\d_][\w'’.-]*\s*){1,4},?\s*(?:n[º°.]\s*)?\d{1,4}(?!\w)"
    r"|(?<!\w)(?:(?:am|an der|auf der|zum|zur|im)\s+)?[^\W\d_][\w.'’-]*(?:stra(?:ß|ss)e|str\.|weg|platz|allee|gasse|ufer|damm|graben|steig|straat|laan|gracht|plein|gatan|v[äa]gen|vej|veien)\s+\d{1,4}\s?[a-z]?(?!\w)",
    re.I,
)
_STREET_TAIL = re.compile(r"\.?[ ,]+(?:apt|flat|unit|suite|#)|\.?,? (?:[^\W\d_][\w-]* ){0,3}(?:[a-z]{1,2}-)?\d{4,5}|,? \d+º|,\s+[^\W\d_]{3,}", re.I)
_INNER = frozenset("the and for to on is with in at from after before was were are down of".split())
_DATE = re.compile(r"\d{4}([-./])\d{1,2}\1\d{1,2}|\d{1,2}([-./])\d{1,2}\2\d{4}")
_DOTTED = re.compile(r"\d{1,5}(?:\.\d{1,5}){2,3}")
_SSN = re.compile(r"\d{3}([-. ])\d{2}\1\d{4}")
_SSN_DOTS = re.compile(r"\d{3}\.\d{2,3}\.\d{4}")
_LONG_PAIR = re.compile(r"\d{4}[-/]\d{3,6}(?:[-/]\d{4})?|\d{1,3}(?:,\d{3})+|\d{8}-\d{3}")
_CARD = re.compile(r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}")
_PHONE_SHAPES = re.compile(
    r"(?:\+?1[-. ]?)?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}"  # North America
    r"|(?:\+|00)\s?[1-9][\d\s().\-/]{6,18}"  # international
    r"|\(?0\d{1,4}\)?[\s./-]?\d[\d\s./-]{4,11}"  # trunk prefix
    r"|[6-9]\d{2}(?:[ -]?\d{3}){2}|[6-9]\d{2}(?:[ -]\d{2}){3}"  # nine digits in groups
)
_ID_SHAPES = re.compile(
    r"\d{3}([-. ])\d{2}\1\d{4}|[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d]|[a-z]-?\d{7,8}|[xyz]-?\d{7}-?[a-z]|\d{8}-?[a-z]|\d{2} \d{3} \d{3} \d{3}|[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?|c[0-9a-z]{8}"
    r"|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{4} \d{4} \d{4}|[a-z]{6}\d{2}[a-z]\d{2}[a-z]\d{3}[a-z]|[a-z]{5}\d{4}[a-z]|[a-z]{4}\d{6}[a-z]{6}[a-z\d]\d|[a-z9]{5}\d{6}[a-z\d]{5}|[a-z]{3}\d{6}|\d{2}[a-z]{2}\d{5}",
    re.I,
)
_ID_LINK = re.compile(r"(?:\W|no|nr|num|number|nummer|n[uú]mero|num[ée]ro|is|was|ist|lautet|es|est|card|id|licen[cs]e|security|insurance|document|sec|[ée] il|el|le|la)*", re.I)


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _weighted(digits: str, weights: tuple[int, ...]) -> int:
    return sum(int(d) * w for d, w in zip(digits, weights))


def _iso7064_11_10(digits: str) -> bool:
    product = 10
    for d in digits[:-1]:
        total = (int(d) + product) % 10 or 10
        product = 2 * total % 11
    return (11 - product) % 10 == int(digits[-1])


def _cpf(digits: str) -> bool:
    for n in (9, 10):
        rest = 10 * sum(int(d) * (n + 1 - i) for i, d in enumerate(digits[:n])) % 11 % 10
        if rest != int(digits[n]):
            return False
    return len(set(digits)) > 1


@lru_cache(maxsize=1)
def _dihedral() -> tuple[list[list[int]], list[list[int]]]:
    """Multiplication of the dihedral group of ten elements, and the powers of Verhoeff's permutation."""
    times = [[(a + b) % 5 if a < 5 and b < 5 else (a + b) % 5 + 5 if a < 5 else (a - b) % 5 + 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
    powers, step = [list(range(10))], [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    for _ in range(7):
        powers.append([powers[-1][step[i]] for i in range(10)])
    return times, powers


def _verhoeff(digits: str) -> bool:
    times, powers = _dihedral()
    c = 0
    for i, d in enumerate(reversed(digits)):
        c = times[c][powers[i % 8][int(d)]]
    return c == 0


_SEPARATORS = str.maketrans("", "", " -./()+\t\n\r")
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def checked(span: str) -> bool:
    """Whether the check digits (or letter) of some national number of this length hold."""
    plain = span.translate(_SEPARATORS)
    if len(plain) not in (9, 11, 12, 15) or not plain.isascii():
        return False
    plain = plain.upper()
    if plain.isdigit():
        n = len(plain)
        if n == 9:
            return _luhn(plain) or _weighted(plain, (9, 8, 7, 6, 5, 4, 3, 2, -1)) % 11 == 0
        if n == 11:
            return _iso7064_11_10(plain) or _cpf(plain) or _weighted(plain, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1)) % 10 == 0
        if n == 12:
            return _verhoeff(plain)
        if n == 15:
            return 97 - int(plain[:13]) % 97 == int(plain[13:])
        return False
    if len(plain) == 9 and plain[-1] in _DNI and plain[1:8].isdigit() and (plain[0].isdigit() or plain[0] in "XYZ"):
        return _DNI[int(plain[:8].translate(str.maketrans("XYZ", "012"))) % 23] == plain[-1]
    return False


Candidate = tuple[str, int, int, tuple[int, ...], tuple[int, ...]]


def _unlisted(word: str, lexicon: dict[str, int]) -> int:
    """What a word is that isn't listed as it stands: without accents, or by the parts of a double name."""
    if not word.isascii():
        plain = _strip_accents(word)
        found = lexicon.get(plain, 0) & (GIVEN | TITLE | STREET)
        if found:
            return found
        word = plain if "-" in plain else word
    if "'" in word or "’" in word:
        return lexicon.get(word.replace("’", "'").rsplit("'", 1)[1], 0) & ~GIVEN
    if "-" in word:
        parts = [lexicon.get(p, 0) for p in word.split("-")]
        return GIVEN if any(p & GIVEN for p in parts) else COMMON if all(p & COMMON for p in parts) else 0
    return 0


class _Text:
    """One text with its words, what the lexicon says of them, and where they are."""

    __slots__ = ("text", "low", "parts", "words", "lows", "flags", "ends", "lexicon", "latin")

    def __init__(self, text: str, lexicon: dict[str, int]) -> None:
        self.text, self.low, self.lexicon = text, text.lower(), lexicon
        self.parts = _WORDS[text.isascii()].split(text)
        self.words = self.parts[1::2]
        self.lows = [w.lower() for w in self.words]
        known = lexicon.get
        self.flags = [known(w, 0) for w in self.lows] if text.isascii() and "-" not in text and "'" not in text else [known(w) or (0 if w.isascii() and w.isalpha() else _unlisted(w, lexicon)) for w in self.lows]
        self.ends = list(accumulate(map(len, self.parts)))
        self.latin = text.isascii()

    def start(self, i: int) -> int:
        return self.ends[2 * i]

    def end(self, i: int) -> int:
        return self.ends[2 * i + 1]

    def cue(self, start: int, end: int, reach: int = 6) -> tuple[int, bool]:
        """(PHONE, ID, OTHER or 0, whether it stands right before): the nearest cue before a number, else the nearest behind it."""
        flags, text = self.flags, self.text
        i, steps, broken = self._before(start), 0, False
        gap_from = start
        while i >= 0 and steps < reach:
            f = flags[i] & (PHONE | ID | OTHER)
            between = text[self.end(i) : gap_from]
            if not between.isspace() or "\n" in between:
                if ";" in between or "|" in between or ". " in between and len(self.words[i]) > 4 and not f:
                    break
                broken = broken or "\n" in between
            if f:
                if self.lows[i] == "card" and i and flags[i - 1] & ID:
                    f = ID
                linked = bool(_ID_LINK.fullmatch(text, self.end(i), start))
                if broken and not linked:  # a cue of another line counts if nothing but linking words follow it
                    break
                return PHONE if f & PHONE else ID if f & ID else OTHER, linked
            gap_from = self.start(i)
            i -= 1
            steps += 1
        for i in range(self._before(start) + 1, min(self._before(start) + 5, len(self.words))):
            if self.start(i) < end:
                continue
            if text.find("\n", end, self.start(i)) >= 0 or text.find(". ", end, self.start(i)) >= 0 or text.find(";", end, self.start(i)) >= 0:
                break
            f = flags[i] & (PHONE | ID)
            if f:
                return (PHONE if f & PHONE else ID), False
        return 0, False

    def _before(self, position: int) -> int:
        """Index of the last word that starts before a position."""
        return (bisect_left(self.ends, position) + 1) // 2 - 1 if self.words else -1


def _emails(t: _Text) -> Iterator[Candidate]:
    text, known = t.text, t.lexicon.get
    for m in _EMAIL[t.latin].finditer(text):
        span = m.group()
        plain = "@" in span
        spelled = bool(_SPELLED.search(span))
        end = _TLD.search(span)
        local = _HOST.split(span, 1)[0].lower()
        i = t._before(m.start())
        cued = any(t.flags[k] & MAIL for k in range(max(0, i - 3), i + 1))
        votes = (
            1 if plain or spelled else -1,
            1 if cued else 0 if plain or spelled else -1,
            -1 if not end or _LINK_BEFORE.search(text, max(0, m.start() - 200), m.start()) else 1,
            0 if plain or spelled else -1 if known(local, 0) & COMMON else 1,
        )
        yield "EMAIL", m.start(), m.end(), votes, (int(plain), int(spelled))


def _numbers(t: _Text) -> Iterator[Candidate]:
    text = t.text
    for m in _NUMBER[t.latin].finditer(text):
        span = m.group()
        start, end = m.span()
        whole = core = span
        if span[-1].isdecimal() and ("x" in span or "X" in span):
            core = _EXTENSION.sub("", span)
        digits = sum(map(str.isdecimal, core))
        cue, linked = t.cue(start, end)
        date = bool(_DATE.fullmatch(core))
        ssn = bool(_SSN.fullmatch(core))
        card = digits == 16 and bool(_CARD.fullmatch(core))
        odd = bool(_CURRENCY_NEXT.match(text, end)) or bool(_LONG_PAIR.fullmatch(core)) or bool(_DOTTED.fullmatch(core) and not _SSN_DOTS.fullmatch(core)) or text[end : end + 1] == ","and text[end + 1 : end + 2].isdecimal()
        phone = not date and not ssn and bool(_PHONE_SHAPES.fullmatch(core))
        votes = (
            1 if cue == PHONE else -1 if cue else 0,
            1 if phone else -1 if ssn or card else 0,
            -1 if date or odd or not 7 <= digits <= 15 else 0,
            1 if core is not whole and core != span or core[0] in "+(" else 0,
            1 if cue == PHONE and not date and not ssn and digits > 5 else 0,
        )
        yield "PHONE", start, end, votes, (int(cue == PHONE), int(9 <= digits <= 13), int(cue in (ID, OTHER)))
        yield _id_candidate(t, start, start + len(core), core, cue, linked, date or odd or card, digits)


def _id_candidate(t: _Text, start: int, end: int, span: str, cue: int, linked: bool, odd: bool, digits: int) -> Candidate:
    # Right behind another cue the shape has no say: order codes may look like anything.
    shaped = not (cue in (OTHER, PHONE) and linked) and bool(_ID_SHAPES.fullmatch(span))
    votes = (
        1 if cue == ID and linked else -1 if cue in (OTHER, PHONE) else 0,
        1 if shaped else 0,
        1 if checked(span) else 0,
        -1 if odd or span[0] in "+(" or not 6 <= sum(map(str.isalnum, span)) <= 18 or digits < 2 else 0,
        1 if cue == ID and not odd else 0,
    )
    return "ID_NUMBER", start, end, votes, (int(cue == ID), int(shaped), int(cue == 0))


def _coded(t: _Text) -> Iterator[Candidate]:
    for m in _CODED[t.latin].finditer(t.text):
        span = m.group()
        cue, linked = t.cue(m.start(), m.end())
        yield _id_candidate(t, m.start(), m.end(), span, cue, linked, False, sum(map(str.isdecimal, span)))


def _behind_id_cues(t: _Text, taken: list[Candidate]) -> Iterator[Candidate]:
    """Whatever holds digits behind an ID cue, of any shape, where no ID is proposed yet."""
    for i, f in enumerate(t.flags):
        if not f & ID:
            continue
        j, k = i, t.end(i)
        for j in range(i, min(i + 4, len(t.words))):
            k = t.end(j)
            m = _BEHIND_ID.match(t.text, k)
            if m:
                break
            if j > i and t.flags[j] & (OTHER | PHONE):
                break
        else:
            continue
        if not m:
            continue
        start, end, span = m.start("id"), m.end("id"), m.group("id")
        cue, linked = t.cue(start, end)
        digits = sum(map(str.isdecimal, span))
        if any(x[0] == "ID_NUMBER" and x[1] < end and start < x[2] for x in taken):
            continue
        date = bool(_DATE.fullmatch(span))
        odd = date or bool(_DOTTED.fullmatch(span)) or bool(_CURRENCY_NEXT.match(t.text, end))
        yield _id_candidate(t, start, end, span, cue, linked, odd, digits)


def _addresses(t: _Text) -> Iterator[Candidate]:
    text, flags = t.text, t.flags
    for m in _STREET[t.latin].finditer(text):
        start, end = m.span()
        i = t._before(start) + 1
        own = []
        while i < len(t.words) and t.start(i) < end:
            own.append(t.lows[i])
            i += 1
        inner = not _INNER.isdisjoint(own[1:-1]) or own[0] in _INNER if own else True
        before = t._before(start)
        gap = text[t.end(before) : start] if before >= 0 else ""
        cued = any(flags[k] & PLACE for k in range(max(0, before - 4), before + 1)) and "\n" not in gap and ";" not in gap and "|" not in gap
        votes = (
            1 if cued else 0,
            1 if len(own) <= 5 else 0,
            -1 if inner else 1,
            1 if _STREET_TAIL.match(text, end) else 0,
        )
        yield "ADDRESS", start, end, votes, (int(inner), int(len(own) <= 5))


#: A word that touches one of these is part of a code, a handle or an address, not a word of its own.
_GLUE = frozenset("0123456789@#_/")


def _joins(gap: str, last: str) -> bool:
    """Whether two words with this between them can belong to one name."""
    if gap.isspace():
        return len(gap) <= 4
    return len(last) == 1 and gap[0] == "." and gap[1:].isspace()


def _title_gap(gap: str) -> bool:
    return gap.isspace() or gap[0] == "." and (len(gap) == 1 or gap[1:].isspace())


def _persons(t: _Text) -> Iterator[Candidate]:
    words, flags, parts, text = t.words, t.flags, t.parts, t.text
    n = len(words)
    # Where nearly all words or none are capitalised, capitals say nothing.
    capitals = [w[0].isupper() for w in words]
    mixed = 0 < sum(capitals) <= 0.7 * n + 1
    stop = _STOP | PERSON
    i = 0
    while i < n:
        f, capital = flags[i], capitals[i]
        if not (f & GIVEN or capital and not f & stop or not capital and not f & (COMMON | stop) and i and flags[i - 1] & (PERSON | TITLE | FUNCTION)):
            i += 1
            continue
        if len(words[i]) == 1 or parts[2 * i] and parts[2 * i][-1] in _GLUE or parts[2 * i + 2] and parts[2 * i + 2][0] in _GLUE:  # part of a code or handle
            i += 1
            continue
        title = i > 0 and flags[i - 1] & TITLE and _title_gap(parts[2 * i])
        cue = _cued(t, i - 1 if title else i)
        if not (f & GIVEN or title or cue or capital):
            i += 1
            continue
        j = i + 1
        while j < n and j - i < 6 and _joins(parts[2 * j], words[j - 1]):
            g = flags[j]
            if g & PARTICLE:
                # "van den Berg": particles belong to a name if a name goes on behind them.
                k = j
                while k < n and k - j < 2 and flags[k] & PARTICLE:
                    k += 1
                if k < n and words[k][0].isupper() and not flags[k] & _STOP and parts[2 * k].isspace() and mixed:
                    j = k + 1
                    continue
            if g & stop and not g & GIVEN or parts[2 * j + 2] and parts[2 * j + 2][0] in _GLUE:
                break
            if mixed and capital:
                if not capitals[j]:
                    break
            elif g & COMMON:
                break
            j += 1
        core = [k for k in range(i, j) if flags[k] & GIVEN or not flags[k] & (COMMON | FUNCTION)]
        comma = False
        if core:
            # Behind a cue or title the name starts at once; elsewhere common words before it are left out.
            a, b = i if (cue or title) and capital else core[0], core[-1] + 1
            if flags[core[-1]] & GIVEN and b < j:
                b += 1
            if b - a == 1 and b < n and flags[b] & GIVEN and parts[2 * b].strip() == "," and not flags[a] & GIVEN:
                b, comma = b + 1, True
        else:
            a, b = i, j
        single = b - a == 1
        if single and not (title or cue or flags[a] & GIVEN) or not core and not (title or cue) and not mixed:
            i = max(j, i + 1)
            continue
        own = range(a, b)
        before, behind = parts[2 * a], parts[2 * b]
        given = any(flags[k] & GIVEN for k in own)
        known = sum(1 for k in own if flags[k] & COMMON and not flags[k] & GIVEN)
        listed = known or not title and any(flags[k] & PROPER and not flags[k] & GIVEN for k in own)
        if not listed and not given and not t.latin and any(c > "\u024f" for k in own for c in words[k]):
            listed = True  # the lexicon doesn't speak for other scripts
        # A name does not follow a number or a street, and is not part of a handle.
        street = any(flags[k] & STREET for k in range(max(0, a - 5), min(n, b + 1))) and not title and not given
        numbered = before.rstrip()[-1:].isdecimal() or behind[:3].strip()[:1].isdecimal() and not title and not given
        led = a > 0 and (flags[a - 1] & PREFIX and before.isspace() or flags[a - 1] & OTHER or a > 1 and flags[a - 2] & OTHER and t.lows[a - 1] in ("no", "nr", "number"))
        follows = b < n and behind.isspace() and flags[b] & ACTS
        votes = (
            -1 if street or led and not title else 1 if cue else 0,
            1 if title else 0,
            1 if given else 0,
            1 if any(_family(t.lows[k]) for k in own if not flags[k] & COMMON) else 0,
            -1 if known == b - a else 0 if listed else 1,
            1 if comma or mixed and not single and known < b - a and words[a][0].isupper() and words[b - 1][0].isupper() else 0 if not single or title or cue and (capital or not mixed) else -1,
            -1 if numbered or street else 1 if follows else 0,
        )
        yield "PERSON", t.start(a), t.end(b - 1), votes, (int(words[a][0].isupper()), int(not single), int(known > 0))
        i = max(b, j)


#: What between a cue and a name says that they don't belong together.
_APART = frozenset(".!?;|0123456789")


def _cued(t: _Text, i: int) -> bool:
    """Whether a cue for a person stands before word i, with nothing but linking words between."""
    for k in range(i - 1, max(-1, i - 5), -1):
        gap = t.parts[2 * (k + 1)]
        if not gap.isspace():
            if not _APART.isdisjoint(gap) or "\n" in gap and "," not in gap:
                return False
        if t.flags[k] & PERSON:
            return True
        if not t.flags[k] & (FUNCTION | PARTICLE) and t.lows[k] != "person":
            return False
    return False


def _family(word: str) -> bool:
    return len(word) > 4 and word.endswith(FAMILY_ENDINGS)


_DIGIT = re.compile(r"\d")


def candidates(text: str, lexicon: dict[str, int] | None = None) -> list[Candidate]:
    """Candidate spans of a text in its consistent form: (type, start, end, votes, shape)."""
    t = _Text(text, default_lexicon() if lexicon is None else lexicon)
    out: list[Candidate] = []
    if "@" in text or ("at" in t.lows or "a" in t.lows) and _MAYBE_MAIL[t.latin].search(t.low):
        out = list(_emails(t))
    mails = [(m[1], m[2]) for m in out]
    if _DIGIT.search(text):
        numbers = [*_numbers(t), *_coded(t)]
        out += numbers
        some = 0
        for f in t.flags:
            some |= f
        if some & ID:
            out += _behind_id_cues(t, numbers)
        if some & STREET or any([e in t.low for e in STREET_ENDINGS]):
            out += _addresses(t)
    people = _persons(t)
    out += [p for p in people if not any(s < p[2] and p[1] < e for s, e in mails)] if mails else people
    return out


@lru_cache(maxsize=1)
def default_lexicon() -> dict[str, int]:
    return read_lexicon()


_NAMES: dict[tuple, str] = {}


def pattern(kind: str, votes: tuple[int, ...], shape: tuple[int, ...]) -> str:
    """How a candidate's votes and shape are written: ``PERSON|+0-0000|110``."""
    key = (kind, votes, shape)
    name = _NAMES.get(key)
    if name is None:
        name = _NAMES[key] = f"{kind}|{''.join('-0+'[v + 1] for v in votes)}|{''.join(map(str, shape))}"
    return name


def patterns_of(text: str, lexicon: dict[str, int]) -> list[str]:
    return [pattern(k, v, x) for k, _, _, v, x in candidates(text, lexicon)]

#: P(vote against, abstain, for | false, true) assumed of a labeler before any data, and what it weighs in candidates.
ASSUMED, PSEUDO = ((0.5, 0.1), (0.4, 0.4), (0.1, 0.5)), 25.0


def estimate_reliability(votes: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: P(true) per pattern, P(vote | class) per labeler as (L, 3, 2), P(true).

    ``votes`` is (patterns, labelers) in {-1, 0, 1}; ``weight`` counts each pattern.
    Started from the vote sums; ``PSEUDO`` assumed candidates keep small collections from drifting.
    """
    p = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    table = np.zeros((votes.shape[1], 3, 2))
    prior = 0.5
    for _ in range(rounds):
        w1, w0 = weight * p, weight * (1 - p)
        prior = float(np.clip((w1.sum() + PSEUDO / 2) / (weight.sum() + PSEUDO), 0.02, 0.98))
        for lab in range(votes.shape[1]):
            for v in (-1, 0, 1):
                hit = votes[:, lab] == v
                assumed = ASSUMED[v + 1]
                table[lab, v + 1] = (w0[hit].sum() + PSEUDO * assumed[0]) / (w0.sum() + PSEUDO), (w1[hit].sum() + PSEUDO * assumed[1]) / (w1.sum() + PSEUDO)
            # A vote for may not lower the odds, nor a vote against raise them: labelers are better than chance.
            for v, sign in ((-1, -1), (1, 1)):
                a, b = table[lab, v + 1]
                if sign * (b - a) < 0:
                    table[lab, v + 1] = (a + b) / 2
        odds = math.log(prior / (1 - prior)) + sum(np.log(table[lab, votes[:, lab] + 1, 1] / table[lab, votes[:, lab] + 1, 0]) for lab in range(votes.shape[1]))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, table, prior


def _features(votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(votes), 1)), votes == 1, votes == -1, shape]).astype(float)


def train_classifier(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on probabilistic labels by Newton's method with a ridge penalty."""
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (target - q)) - ridge * beta
        hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


class SpanModel:
    """The final span classifier: per type the weights of a logistic model over votes and shape."""

    def __init__(self, weights: dict[str, list[float]]) -> None:
        self.weights = {k: np.array(w, float) for k, w in weights.items()}

    def score(self, name: str) -> float:
        """Probability that a candidate of this pattern, seen in training or not, is what its type says."""
        kind, votes, shape = name.split("|")
        if kind not in self.weights:
            return 0.0
        v = np.array([["-0+".index(c) - 1 for c in votes]])
        x = _features(v, np.array([[int(c) for c in shape]]))[0]
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ self.weights[kind]))))))

    def save(self, spark: SparkSession, folder: str, name: str = "span-model") -> None:
        publish(spark, folder, name, json.dumps({k: w.tolist() for k, w in self.weights.items()}))

    @classmethod
    def load(cls, spark: SparkSession, folder: str, name: str = "span-model") -> SpanModel:
        return cls(json.loads(texts_in(spark, folder)[name]))


def fit(patterns: Iterable[tuple[str, int]]) -> SpanModel:
    """The classifier, trained type by type on the probabilities EM gives the patterns of votes."""
    weights: dict[str, list[float]] = {}
    rows = sorted(patterns)
    for kind in TYPES:
        own = [(p, n) for p, n in rows if p.split("|")[0] == kind]
        if not own:
            continue
        votes = np.array([["-0+".index(c) - 1 for c in p.split("|")[1]] for p, _ in own])
        shape = np.array([[int(c) for c in p.split("|")[2]] for p, _ in own])
        weight = np.array([float(n) for _, n in own])
        label, _, _ = estimate_reliability(votes, weight)
        weights[kind] = train_classifier(_features(votes, shape), label, weight).tolist()
    return SpanModel(weights)


def _proposer(spark: SparkSession, lexicon: dict[str, int]):
    """Text column -> array of the patterns of its candidates (null gives null). The lexicon is broadcast; its size is the vocabularies'."""
    shared = spark.sparkContext.broadcast(lexicon)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def propose(texts: pa.Array) -> pa.Array:
        rewrite, known = default_normalizer().rewrite, shared.value
        return pa.array([None if x is None else patterns_of(rewrite(x), known) for x in texts.to_pylist()], pa.list_(pa.string()))

    return propose.asNondeterministic()


def proposed(records: DataFrame, text_col: str, lexicon: dict[str, int] | None = None) -> DataFrame:
    """The other input columns plus ``spans``, the vote patterns of the candidates; written once, without any text, so that Python runs once per text."""
    propose = _proposer(records.sparkSession, default_lexicon() if lexicon is None else lexicon)
    return written(records.withColumn("spans", propose(F.col(text_col))).drop(text_col), "pii-votes")


def _counted(spans: DataFrame) -> DataFrame:
    return spans.select(F.explode("spans").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


def learn(spans: DataFrame) -> SpanModel:
    """The classifier learned from all candidates of ``proposed``."""
    return fit((r["pattern"], r["n"]) for r in _counted(spans).collect())


def accepted(spans: DataFrame, model: SpanModel, threshold: float = 0.5) -> DataFrame:
    """Adds ``kept``: the types of the spans the classifier accepts. All patterns of these spans are scored, those training didn't see too."""
    seen = [r["pattern"] for r in _counted(spans).select("pattern").collect()]
    good = sorted(p for p in seen if model.score(p) >= threshold)
    keep = F.filter("spans", lambda s: s.isin(good)) if good else F.expr("filter(spans, s -> false)")
    return spans.withColumn("kept", F.array_distinct(F.transform(keep, lambda s: F.substring_index(s, "|", 1))))


def found_types(records: DataFrame, keys: list[str], text_col: str, model: SpanModel | None = None, lexicon: dict[str, int] | None = None) -> DataFrame:
    """(keys, pii_type): a row for each record and type its text holds; without a model, one is learned from these records.

    Null, empty and blank texts hold nothing; very long texts are read whole; repeated rows
    give their rows once; an empty table gives an empty result; extra columns are ignored.
    """
    spans = proposed(records.select(*keys, F.col(text_col).alias("_text")).where("_text is not null"), "_text", lexicon)
    return accepted(spans, model or learn(spans)).select(*keys, F.explode("kept").alias("pii_type")).distinct()


def redact(text: str, model: SpanModel, lexicon: dict[str, int], threshold: float = 0.5, scores: dict[str, float] | None = None) -> str:
    """The text with every accepted span replaced by ``[TYPE]``; what lies between stays as it was written."""
    scores = {} if scores is None else scores
    clean, places = default_normalizer().aligned(text)
    chosen = []
    for kind, start, end, votes, shape in candidates(clean, lexicon):
        name = pattern(kind, votes, shape)
        q = scores.get(name)
        if q is None:
            q = scores[name] = model.score(name)
        if q >= threshold:
            chosen.append((start, -end, -q, kind))
    out, last, reached = [], 0, -1
    for start, end, _, kind in sorted(chosen):
        if start >= reached:
            reached = -end
            a, b = places.start(start), places.end(reached)
            out += (text[last:a], f"[{kind}]")
            last = b
    return "".join(out) + text[last:]


def redacted(records: DataFrame, keys: list[str], text_col: str, model: SpanModel | None = None, lexicon: dict[str, int] | None = None) -> DataFrame:
    """(keys, redacted): each text with its spans replaced by ``[TYPE]``, the rest unchanged; null stays null.

    Without a model, one is learned from these records first; no text is written on the way.
    """
    known = default_lexicon() if lexicon is None else lexicon
    spark = records.sparkSession
    rows = records.select(*keys, F.col(text_col).alias("_text"))
    if model is None:
        model = learn(rows.where("_text is not null").select(_proposer(spark, known)("_text").alias("spans")))
    shared = spark.sparkContext.broadcast((model.weights, known))

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        weights, words = shared.value
        own, scores = SpanModel(weights), {}
        return pa.array([None if x is None else redact(x, own, words, scores=scores) for x in texts.to_pylist()], pa.string())

    return rows.select(*keys, run("_text").alias("redacted"))
