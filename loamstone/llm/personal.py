"""Personal information in free text: found, and replaced by typed placeholders.

A placeholder tells the kind and holds a pseudonym. Those of numbers are keyed Feistel permutations inside the number's own format,
so that equal values stay linked in all documents and nobody without the key can tell what they were.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.session import strip_clash

#: A lexicon longer than this isn't sent with tasks.
MAX_LEXICON = 200_000

_B, _E = r"(?<![A-Za-zÀ-ɏ0-9_])", r"(?![A-Za-zÀ-ɏ0-9_])"

# addresses of electronic mail

EMAIL = re.compile(rf"(?<![A-Za-zÀ-ɏ0-9_.+%/@-])[A-Za-z0-9À-ɏ_%+'-]+(?:\.[A-Za-z0-9À-ɏ_%+'-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{{2,24}}{_E}(?![-@])")
_DOT = r"(?:\s*[\[({<]\s*(?i:dot)\s*[\])}>]\s*|\s+(?:DOT|dot)\s+)"
SPELLED_EMAIL = re.compile(
    rf"(?<![A-Za-z0-9_.+%/@-])[A-Za-z0-9À-ɏ_%+-]+(?:(?:\.|{_DOT})[A-Za-z0-9À-ɏ_%+-]+)*?(?:\s*[\[({{<]\s*(?i:at)\s*[\])}}>]\s*[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)+|\s+(?:AT|at)\s+[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+|@[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+){_E}"
)

# numbers

PHONES = (
    re.compile(r"(?<![\w+.])\+\d{1,3}(?:[ .\-]?\(0?\d{0,3}\))?(?:[ .\-/]?\d){6,13}(?!\d)"),
    re.compile(r"(?<![\w+.\-/])00[1-9]\d{0,2}[ .\-]?(?:\(0\)[ .\-]?)?\d{1,4}(?:[ .\-/]\d{2,4}){1,4}(?![\w-])"),
    re.compile(r"(?<![\w.\-/])\([2-9]\d{2}\)[ .\-]?\d{3}[ .\-]\d{4}(?![\w-])"),
    re.compile(r"(?<![\w.\-/+])[2-9]\d{2}([.\- ])\d{3}\1\d{4}(?![\w.-]\d|[\w-])"),
    re.compile(r"(?<![\w.\-/+])0\d{2,4}[ /-]\d{3,4}[ -]\d{3,4}(?![\w-])"),
)
#: A number of seven digits is one before an extension, which is looked for behind the part of the text that is searched.
LOCAL_PHONE = re.compile(r"(?<![\w.\-/+])\d{3}-\d{4}")
EXTENSION = re.compile(r"\s*(?:ext\.?|x|extension)\s*\d")
#: A short number is a telephone number only behind a word that says so.
SHORT_PHONE = re.compile(r"(?<![\w.+/-])(?:\d{3}[- ]\d{4}|\d{6,11})(?![\w-])")
PHONE_WORDS = re.compile(r"(?i)(?:\btel(?:[eé]fono|[eé]phone|efone|efon|\.)?|\bphone|\bcall|\bfax|\bmobile|\bpager|\bnumber is|致电|电话)[^\n\d]{0,24}$")
#: Every number that its own form tells has one of these in it, so the patterns above and below are tried around them only. A number that the words before it tell may have none.
NUMBER = re.compile(r"\d[\d ()./-]{4,}\d|\d{6,}|[A-Z]\d{2}[A-Z]\d{4}")
AROUND = 20
ID_NUMBERS = (
    re.compile(rf"(?<![\w.\-/+])\d{{3}}([- ])\d{{2}}\1\d{{4}}(?![\w-]|\.\d)"),
    re.compile(rf"{_B}[XYZ][- ]?\d{{7}}[- ]?[A-Z]{_E}(?!-)"),
    re.compile(rf"(?<![\w.\-/])\d{{8}}-?[A-Z]{_E}(?!-)"),
    re.compile(rf"{_B}[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D]{_E}|{_B}QQ ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D]{_E}"),
    re.compile(r"(?<![\w./-])\d{2,3}/\d{3}/\d{4,5}(?![\w/-])"),
    re.compile(r"(?<![\w./+-])\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[-+]\d{4}(?![\w-])"),
    re.compile(rf"{_B}[A-Z]\d{{2}}[A-Z]\d{{4}}[A-Z]\d{_E}"),
)
#: Words before a personal number, and what may join them.
ID_WORDS = re.compile(
    r"(?i)(?:passport(?: number| no(?:\.|(?!\w)))?|national id(?:entity)?(?: number)?|(?:personal )?identity number|tax (?:id|number)|\bssn|social security number|ausweisnummer|personalausweis|steuernummer|steuer-?id|num[ée]ro d['’]identit[ée]|documento de identidade?|\bdni|\bnif|\bnie|\bcpf|证件号码?|身份证号?|护照号?)\s*(?:(?:is|ist|est|es|é)(?!\w)|:|：|#|no(?:\.|(?!\w)))?\s*"
)
#: What these words start with, in lower case: they're tried there only.
_ID_STARTS = ahocorasick.Automaton()
for _x in ("passport", "national id", "identity number", "tax id", "tax number", "ssn", "social security number", "ausweisnummer", "personalausweis", "steuernummer", "steuerid", "steuer-id", "numéro d", "numero d", "documento de identidad", "dni", "nif", "nie", "cpf", "证件号", "身份证", "护照"):
    _ID_STARTS.add_word(_x, len(_x))
_ID_STARTS.make_automaton()
ID_VALUE = re.compile(r"(?=[A-Z0-9./ -]*\d[A-Z0-9./ -]*\d[A-Z0-9./ -]*\d)[A-Z0-9]+(?:[ ./-][A-Z0-9]{1,8}){0,4}")

# street addresses

_STREET_WORD = r"(?:[A-ZÀ-Þ][a-zß-ɏ'’]+(?:-[A-ZÀ-Þ]?[a-zß-ɏ]+)*)"
#: What streets are called.
_ENGLISH = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Drive|Dr\.?|Court|Ct\.?|Close|Place|Pl\.?|Square|Sq\.?|Terrace|Way|Crescent|Row|Mews|Hill|Parkway|Pkwy\.?|Highway|Hwy\.?|Gardens|Grove)"
_UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Ste\.?|Room|Floor)\s*#?\d+\s?[A-Za-z]?,?\s+"
_HOUSE = r"\d{1,5}(?:\s?[a-zA-Z](?![A-Za-z]))?(?:[-/]\d{1,4})?"
_PLACE = rf"(?:\d{{4,6}}\s+)?{_STREET_WORD}"
ADDRESSES = (
    re.compile(rf"(?<![\w.])(?:{_UNIT})?{_HOUSE},?\s+(?:[NSEW]{{1,2}}\.?\s+)?(?:{_STREET_WORD}\s+){{1,3}}{_ENGLISH}(?![A-Za-z])"),
    re.compile(rf"(?<![\w.])(?:{_UNIT})?{_HOUSE}\s?,?\s+(?:bis\s+|ter\s+)?(?:rue|avenue|boulevard|place|chemin|impasse|all[ée]e|quai)\s+(?:(?:de la|de l['’]|des|du|de|d['’])\s*)?{_STREET_WORD}(?:[ -]{_STREET_WORD})?"),
    re.compile(rf"(?<![\w.])(?:Calle|Avenida|Avda\.?|Paseo|Plaza|Camino|Carrera|Rua|Travessa|Largo|Via|Viale|Piazza|Corso|C/)\s+(?:(?:de la|de los|de las|del|de|da|do|dos|das|di|della)\s+)?{_STREET_WORD}(?:\s+{_STREET_WORD})?,?\s+(?:n[ºo°.]\s?)?{_HOUSE}"),
    re.compile(rf"(?<![\w.])(?:[A-ZÄÖÜ][a-zäöüß]+(?:[ -][A-ZÄÖÜ][a-zäöüß]+)*?(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|ring|damm)|[A-ZÄÖÜ][a-zäöüß]+(?:er|en)? (?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ufer|Ring|Damm))\s+{_HOUSE}"),
    re.compile(r"[一-鿿]{2,12}(?:路|街|大道|巷)\s?\d+\s?号"),
)
#: Of these a text needs one for each pattern.
_STREET_SIGNS = (
    (" Street", " St", " Road", " Rd", " Lane", " Ln", " Ave", " Boulevard", " Blvd", " Drive", " Dr", " Court", " Ct", " Close", " Pl", " Sq", " Terrace", " Way", " Crescent", " Row", " Mews", " Hill", " Parkway", " Pkwy", " Highway", " Hwy", " Gardens", " Grove"),
    (" rue ", " avenue ", " boulevard ", " place ", " chemin ", " impasse ", " allée ", " allee ", " quai "),
    ("Calle ", "Avenida ", "Avda", "Paseo ", "Plaza ", "Camino ", "Carrera ", "Rua ", "Travessa ", "Largo ", "Via ", "Viale ", "Piazza ", "Corso ", "C/ "),
    ("straße", "strasse", "str.", "weg ", "gasse", "platz", "allee", "ufer", "ring ", "damm", " Straße", " Strasse", " Str.", " Weg ", " Gasse", " Platz", " Allee", " Ufer", " Ring", " Damm"),
    ("号",),
)
#: A place or a postal code has to follow, in the line or the next one.
AFTER_STREET = re.compile(rf"(?:,?\s*{_UNIT.rstrip('+').rstrip(chr(92) + 's').rstrip(',?')})?,?[ \t]*(?:\r?\n[ \t>#*/|]*|[ \t])(?:\d{{4,6}}\b|[A-ZÀ-Þ][\w'’ß-]+)")

#: Which of these say enough by themselves: those with a flat, and street words that hardly mean anything else. Others need a place or the end of the text behind them.
_STRONG = (
    re.compile(rf"{_UNIT}|.*\s(?:Street|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Terrace|Crescent|Mews|Parkway|Pkwy\.?|Highway|Hwy\.?|Gardens|Grove)$", re.S),
    re.compile(rf"{_UNIT}|.*\s(?:rue|boulevard|chemin|impasse|all[ée]e|quai)\s", re.S),
    re.compile(r"(?:Calle|Avenida|Avda|Paseo|Rua|Travessa|Viale|Piazza|Corso)"),
    re.compile(r".*(?:[Ss]traße|[Ss]trasse|[Ss]tr\.|[Gg]asse|[Aa]llee)\s", re.S),
    re.compile(r""),
)
#: What stands before a Chinese street's name and is no part of it.
_CHINESE_BEFORE = re.compile(r".*(?:[在于到至往寄住是为址]|位于|地址)(?=.{2,}(?:路|街|大道|巷))")

# names

#: Titles, which are no part of a name.
TITLES = r"(?:Dr|Mr|Mrs|Ms|Miss|Prof|Herr|Frau|Se[ñn]ora?|Sra?|Mme|Mlle|Monsieur|Madame|Sir|Dame|Rev|Hr|Fr|Dra|Dona|Dom)\.?"
_PART = r"[^\W\d_]{2,}(?:['’][^\W\d_]+)?"
_PARTS = rf"{_PART}(?:-{_PART})?"
PERSON = rf"(?:(?:{_PARTS}),[ \t]+{_PARTS}(?:[ \t]+[^\W\d_]\.)?|(?:[^\W\d_]\.[ \t]?)+{_PARTS}|{_PARTS}(?:[ \t]+[^\W\d_]\.)?(?:[ \t\n]+{_PARTS})?)"
#: What stands before or after a person's name. With the first group a name may be a single part.
_CUES = (
    (rf"\b{TITLES}[ \t]+", "", True),
    (r"\b(?:Hi|Hello|Hey|Dear|Hallo|Liebe[r]?|Hola|Bonjour|Salut|Ol[áa]|Ciao)[ \t]+(?=[A-ZÀ-Þ])", r"(?=[ \t]*[,!\n])", True),
    (r"(?:^|\n|[ \t.!?])(?:Thanks|Thank you|Cheers|Regards|Best|Best regards|Danke|Gr[üu](?:ß|ss)e|Merci|Gracias|Saludos|Obrigad[oa]|谢谢)[,!，]?[ \t]*\n?[ \t]*(?=[A-ZÀ-Þ])", r"(?=[ \t]*[.!]?[ \t]*(?:\r?\n|$))", True),
    (r"(?:^|\n)[ \t]*(?:Author|Co-authored-by|Reviewed-by|Signed-off-by|Tested-by|Acked-by|Reported-by|Committer|From|Owner|Assignee|Reporter|Contact|Name)[ \t]*:[ \t]*", r"(?=[ \t]*(?:<|\(|\r?\n|$|[A-Z.]))", False),
    (r"\b(?:Author|Co-authored-by|Reviewed-by|Signed-off-by|Tested-by|Acked-by|Reported-by)[ \t]*:[ \t]*", "", False),
    (r"\b(?:TODO|FIXME|XXX|HACK|NOTE)\(", r"(?=\)[ \t]*:?)", False),
    (r"\b(?:[Rr]eported by|[Gg]emeldet von|[Ss]ignal[ée] par|[Aa]vis[óo] de|[Aa]vis[óo]|[Rr]eportado por|[Cc]ontact|[Cc]/o|[Ww]ritten by|[Ss]ent by|confirmed by)[ \t]+", "", False),
    (r"(?:\b[Aa]ttention(?: of)?|\b[Aa]ttn\.?:?|\bzu H[äa]nden(?: von)?|\bà l['’]attention de|\ba la atenci[óo]n de|\baos cuidados de)[ \t]+", "", False),
    (r"\b(?:national id|tax id|passport number|Ausweisnummer|num[ée]ro d['’]identit[ée]|documento de identidade?)[ \t]+[A-Z0-9][A-Z0-9 /.-]{4,16}[A-Z0-9][ \t]+(?:of|von|de|do|da)[ \t]+", "", False),
    (r"(?:提交人|联系人|作者|姓名)[：:][ \t]*", r"(?=[，,。；;\s])", False),
    (r"[\"'](?:name|full_?name|contact|user|owner|author)[\"'][ \t]*:[ \t]*[\"']", r"(?=[\"'])", False),
    (r"\b(?:[Pp]asted|[Ss]hared|[Pp]osted|[Ff]orwarded|[Dd]etails|[Cc]ustomer|[Rr]equester|[Cc]aller)\b[^:\n]{0,40}:[ \t]*", r"(?=[ \t]*[;,(\n]|[ \t]*$)", False),
    (r"(?:^|\n)-- ?\r?\n[ \t]*", r"(?=[ \t]*(?:\r?\n|$))", False),
    (r"(?:\d|\.)[ \t]*\(", r"(?=\))", False),
    (r"\bas[ \t]+", r"(?=[ \t]+(?:confirmed|said|wrote|told|reported|mentioned)\b)", False),
    (r"\bAsk[ \t]+", r"(?=[ \t]+(?:or|before|and|about)\b)", False),
    (r"\b(?:or|and|to|with|by|from)[ \t]+", r"(?=[ \t]+(?:before|first|if|when|about)\b)", False),
    (r"(?:^|[\n.!?:>\-*][ \t]*)(?=[^\W\d_])", r"(?=[ \t]+(?:wrote|said|confirmed|reported|replied|asked|schrieb|escribió|a écrit|escreveu)\b)", False),
)
_CUE_RX = [(re.compile(f"{before}(?P<name>{PERSON}){after}"), single) for before, after, single in _CUES]
#: The cues after which two words may be a name even if both are unknown and in lower case; and fixed values, words that they aren't.
_SURE_CUES = (4, 5, 7, 8, 9, 10)
_NO_NAMES = frozenset("the a an this that these those my your his her its our their all any some each every no not to for of in on at by with from as is are was it we you they he she der die das den dem ein eine la le les el los las un une una o os as um uma de do da que und y et e is was".split())
_TITLE_WORDS = ("Dr", "Mr", "Mrs", "Ms", "Miss", "Prof", "Herr", "Frau", "Señor", "Senor", "Señora", "Senora", "Sr", "Sra", "Mme", "Mlle", "Monsieur", "Madame", "Sir", "Dame", "Rev", "Hr", "Fr", "Dra", "Dona", "Dom")
_SAYING = tuple(b + w for b in (" ", "\t") for w in ("wrote", "said", "confirmed", "reported", "replied", "asked", "told", "mentioned", "schrieb", "escribió", "a écrit", "escreveu"))
#: Each cue's literals: one of them stands in every match, so a cue is tried around them only. None means everywhere.
_ANCHORS = (
    tuple(t + e for t in _TITLE_WORDS for e in (".", " ", "\t")),
    tuple(t + e for t in ("Hi", "Hello", "Hey", "Dear", "Hallo", "Liebe", "Lieber", "Hola", "Bonjour", "Salut", "Ola", "Olá", "Ciao") for e in (" ", "\t")),
    ("Thanks", "Thank you", "Cheers", "Regards", "Best", "Danke", "Grüße", "Grüsse", "Gruße", "Grusse", "Merci", "Gracias", "Saludos", "Obrigado", "Obrigada", "谢谢"),
    ("Author", "-by", "Committer", "From", "Owner", "Assignee", "Reporter", "Contact", "Name"),
    ("Author", "-by"),
    ("TODO(", "FIXME(", "XXX(", "HACK(", "NOTE("),
    ("eported by", "emeldet von", "ignalé par", "ignale par", "viso de", "visó de", "viso ", "visó ", "visó\t", "viso\t", "eportado por", "ontact ", "ontact\t", "c/o", "C/o", "ritten by", "ent by", "confirmed by"),
    ("ttention", "ttn", "Händen", "Handen", "attention de", "atención de", "atencion de", "cuidados de"),
    ("national id", "tax id", "passport number", "Ausweisnummer", "identité", "identite", "identidad"),
    ("提交人", "联系人", "作者", "姓名"),
    tuple(f"{n}{q}" for n in ("name", "contact", "user", "owner", "author") for q in ("\"", "'")),
    ("asted", "hared", "osted", "orwarded", "etails", "ustomer", "equester", "aller"),
    ("-- \n", "-- \r\n", "--\n", "--\r\n"),
    None,
    tuple(x for x in _SAYING if x[1:] in ("confirmed", "said", "wrote", "told", "reported", "mentioned")),
    ("Ask ", "Ask\t"),
    tuple(b + w for b in (" ", "\t") for w in ("before", "first", "if", "when", "about")),
    tuple(x for x in _SAYING if x[1:] not in ("told", "mentioned")),
)
#: How far before and behind such a literal a match reaches, long runs of blanks aside: no name and cue are longer.
_REACH = 160
_FINDER = ahocorasick.Automaton()
for _k, _literals in enumerate(_ANCHORS):
    for _x in _literals or ():
        _FINDER.add_word(_x, (*_FINDER.get(_x, (len(_x),)), _k))
_FINDER.make_automaton()


def _around(text: str, start: int, end: int, reach: int) -> tuple[int, int]:
    """The part of text around start to end, with reach characters on either side, and more where half of them or more are blank."""
    far = reach
    while (lo := max(0, start - far)) and 2 * sum(map(len, text[lo:start].split())) <= reach:
        far *= 2
    far = reach
    while (hi := min(len(text), end + far)) < len(text) and 2 * sum(map(len, text[end:hi].split())) <= reach:
        far *= 2
    return lo, hi


def _cue_windows(text: str) -> dict[int, list[tuple[int, int]]]:
    """The parts of text in which each cue may match, in order and apart."""
    out: dict[int, list[tuple[int, int]]] = {k: [(0, len(text))] for k, literals in enumerate(_ANCHORS) if literals is None}
    found: dict[int, list[tuple[int, int]]] = {}
    for end, (size, *cues) in _FINDER.iter(text):
        part = _around(text, end - size + 1, end + 1, _REACH)
        for k in cues:
            found.setdefault(k, []).append(part)
    for k, parts in found.items():
        out[k] = list(_apart(parts))
    return out


def _apart(parts: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Parts of a text in order, those that meet as one."""
    lo = hi = -1
    for a, b in sorted(parts):
        if a > hi:
            if hi >= 0:
                yield lo, hi
            lo, hi = a, b
        hi = max(hi, b)
    if hi >= 0:
        yield lo, hi


#: A mail address in angle brackets, behind the name it belongs to.
_BRACKET = re.compile(r"[ \t]*<[^<>\s@]{1,64}(?:@|[ \t]?[\[(](?i:at)|[ \t]+AT[ \t])")
_BEFORE_BRACKET = re.compile(rf"(?:^|[\s(:])(?P<name>{PERSON})$")
#: What makes a name of a person one of software or of a thing, behind it.
THINGS = "Cache|Scheduler|Service|Server|Engine|Library|Framework|Client|Queue|Router|Store|Index|Worker|Handler|Module|Plugin|Pipeline|Database|API|SDK|CLI|release|Release|train|branch|cluster|build|module|project|team|board|library|service|server|milestone|environment"
THING = re.compile(rf"[ \t]+(?:{THINGS})\b")
_THINGS = frozenset(THINGS.casefold().split("|"))
_TITLE_CASE = re.compile(r"^[^\W\d_a-z][^\W\d_]*(?:['’-][^\W\d_]+)*$")
_LOOSE = re.compile(rf"{_B}(?:{_PARTS},[ \t]+{_PARTS}|(?:[A-ZÀ-Þ]\.[ \t]?)+{_PARTS}|{_PARTS}(?:[ \t]+[A-ZÀ-Þ]\.)?[ \t]+{_PARTS}){_E}")


class Lexicon:
    """Known name parts by kind, without case; and those that are ordinary words too, which count only where they are written like names beside another part."""

    #: Name parts that are ordinary English words.
    ORDINARY = frozenset("will mark grace hunter chase ruby amber olive pearl jasper field wood stone rivers baker may june april rose dawn hope faith joy iris lily violet ivy bill rob pat art frank grant miles dean earl duke young long short brown green white black king price page hall park banks brooks cook cooper mason parker potter sawyer taylor turner walker weaver wright read love bush bond cash case cross day drew gene guy jack jay jean joe ray rich skip sue trey van wade ward west".split())

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.given = frozenset(t.casefold() for t, k in rows if t and k == "given")
        self.family = frozenset(t.casefold() for t, k in rows if t and k == "family")
        self.known = self.given | self.family
        self.places = ahocorasick.Automaton()
        # a text is searched in lower case, which isn't case folding for every letter
        for p in self.known | {t.lower() for t, k in rows if t and k in ("given", "family")}:
            self.places.add_word(p, len(p))
        if self.known:
            self.places.make_automaton()

    def windows(self, text: str, low: str, reach: int = 48) -> Iterator[tuple[int, int]]:
        """The parts of text around known name parts, in order and apart."""
        if not self.known:
            return
        if len(low) != len(text):
            yield 0, len(text)
            return
        parts = []
        for end, size in self.places.iter(low):
            a, b = end - size + 1, end + 1
            if a and (low[a - 1].isalpha() and low[a - 1] < "\u2e80") or b < len(low) and low[b].isalpha() and low[b] < "\u2e80":
                continue
            parts.append(_around(text, a, b, reach))
        yield from _apart(parts)

    def has(self, part: str) -> bool:
        p = part.casefold()
        return p in self.known or "-" in p and any(x in self.known for x in p.split("-"))

    def ordinary(self, part: str) -> bool:
        return part.casefold() in self.ORDINARY


def _split(name: str) -> list[str]:
    return [p for p in re.split(r"[,\s]+", name) if p]


def _words(parts: list[str]) -> list[str]:
    return [p for p in parts if not re.fullmatch(r"(?:[^\W\d_]\.)+", p)]


def _plausible(name: str, lexicon: Lexicon, single: bool, sure: bool = False) -> bool:
    """Whether what stands at a place for a name is one: written like a name, or known. sure: two unknown words in lower case will do."""
    parts = _split(name)
    words = _words(parts)
    if not words or len(words) == 1 and len(parts) == 1 and not single:
        return False
    if any(w.islower() for w in words):
        if sure and len(words) == 2 and all(w.islower() and len(w) > 2 and w not in _NO_NAMES for w in words):
            return True
        return all(w.islower() for w in words) and sum(map(lexicon.has, words)) >= max(1, len(words) - 1) and not all(lexicon.ordinary(w) for w in words)
    return all(_TITLE_CASE.match(w) for w in words)


def _cut(name: str, lexicon: Lexicon, single: bool, sure: bool = False) -> str | None:
    """The name at the start of a match, which may have taken a word too many."""
    if _plausible(name, lexicon, single, sure):
        return name
    m = re.match(rf"{_PARTS}(?=[,\s])", name)
    if single and m and _plausible(m[0], lexicon, True):
        return m[0]
    return None


def names_in(text: str, low: str, lexicon: Lexicon, gated: bool = True) -> list[tuple[int, int]]:
    """Spans of persons' names: those at places where a name is told, and known full names anywhere."""
    spans: list[tuple[int, int]] = []
    if "<" in text:
        for m in _BRACKET.finditer(text):
            lo = max(0, m.start() - 80)
            n = _BEFORE_BRACKET.search(text[lo : m.start()])
            if n and _plausible(n["name"], lexicon, False):
                spans.append((lo + n.start("name"), lo + n.end("name")))
    for k, parts in (_cue_windows(text) if gated else {k: [(0, len(text))] for k in range(len(_CUE_RX))}).items():
        rx, single = _CUE_RX[k]
        for m in (m for lo, hi in parts for m in rx.finditer(text, lo, hi)):
            raw = m["name"]
            name = _cut(raw, lexicon, single, k in _SURE_CUES)
            if name is None:
                continue
            start = m.start("name")
            words = _words(_split(name))
            if single and len(words) == 2 and not ("," in name) and words[1] and not lexicon.has(words[1]) and (lexicon.has(words[0]) or words[1].islower() or "\n" in name):
                # a title or greeting before one part, and the sentence goes on
                cut = re.match(_PARTS, name)
                if cut and (words[1].islower() or "\n" in name):
                    name = cut[0]
            if single and len(_words(_split(name))) == 1 and "," in name:
                name = name.split(",")[0]
            if THING.match(text, start + len(name)):
                continue
            spans.append((start, start + len(name)))
    for lo, hi in lexicon.windows(text, low) if gated else [(0, len(text))]:
        spans += _known_names(text, lo, hi, lexicon)
        spans += _single_names(text, lo, hi, lexicon)
    return spans


def _known_names(text: str, lo: int, hi: int, lexicon: Lexicon) -> Iterator[tuple[int, int]]:
    """Full names of known parts in text from lo to hi."""
    at = lo
    while m := _LOOSE.search(text, at, hi):
        name = m[0]
        parts = _split(name)
        words = _words(parts)
        known = [lexicon.has(w) for w in words]
        ok = False
        if not _THINGS.isdisjoint(w.casefold() for w in words):
            pass
        elif "," in name:
            ok = len(words) == 2 and all(known) and words[0].casefold().split("-")[0] in lexicon.family and words[1].casefold() in lexicon.given and _same_case(words)
        elif len(words) == 2:
            both = all(known) and _same_case(words) and not (words[0].islower() and any(map(lexicon.ordinary, words)))
            mixed = any(known) and all(_TITLE_CASE.match(w) for w in words) and not any(lexicon.ordinary(w) for w, k in zip(words, known, strict=True) if k) and words[0].casefold() in lexicon.given
            ok = both or mixed and len(words[1]) > 3 and not _common(words[1], text)
        elif len(words) == 1:
            ok = known[0] and _TITLE_CASE.match(words[0]) is not None and words[0].casefold().split("-")[0] in lexicon.family
        if ok and not THING.match(text, m.end()):
            yield m.start(), m.end()
            at = m.end()
        else:
            # go on behind the first part
            first = re.match(r"[^\W\d_.]+\.?", name)
            at = m.start() + max(1, first.end() if first else 1)


#: A part of a name by itself: no other capitalised word, initial or sign of code beside it.
_SINGLE = re.compile(rf"(?<![\w.@/\\#$&+=~<>:`'\"_-]){_PARTS}(?![\w@/\\(\[=<_`-]|\.\w|['’]\w{{2}}|:\w)")
#: Words before a thing of that name; and a word or initial that may be the rest of a name, in mid-sentence.
_OF_THINGS = re.compile(r"(?i)\b(?:the|a|an|this|that|our|your|their|its|every|each|any|no|der|die|das|dem|den|el|la|le|les|los|las|o|os|project|module|service|library|package|branch|release|class|version|install|deploy|upgrade|restart|run|use|using|via|on|in)[ \t]+$")
_OTHER_PART = re.compile(r"[^\s.!?:;][ \t]+[A-ZÀ-Þ][\w'’-]*,?[ \t]+$|\b[A-ZÀ-Þ]\.[ \t]*$")
_GOES_ON = re.compile(r"[ \t]+[A-ZÀ-Þ]|,[ \t]+[A-ZÀ-Þ][\w'’-]+[ \t]*(?:[,.;)\n]|$)")


def _single_names(text: str, lo: int, hi: int, lexicon: Lexicon) -> Iterator[tuple[int, int]]:
    """Known parts that stand alone for a person in text from lo to hi: written like a name, no ordinary word, no thing's name, and no part of a longer one."""
    for m in _SINGLE.finditer(text, lo, hi):
        word = m[0]
        if not lexicon.has(word) or lexicon.ordinary(word) or not _TITLE_CASE.match(word) or word.isupper() or THING.match(text, m.end()):
            continue
        before = text[max(0, m.start() - 60) : m.start()]
        if not (_OF_THINGS.search(before) or _OTHER_PART.search(before) or _GOES_ON.match(text, m.end())):
            yield m.start(), m.end()


def _same_case(words: list[str]) -> bool:
    return all(w.isupper() for w in words) or all(w.islower() for w in words) or all(_TITLE_CASE.match(w) and not w.isupper() for w in words)


def _common(word: str, text: str) -> bool:
    """Whether the text uses the word in lower case too."""
    return re.search(rf"\b{re.escape(word.lower())}\b", text) is not None


# all kinds


def _windows(rx: re.Pattern, text: str, around: int) -> Iterator[tuple[int, int]]:
    """The parts of text around the matches of rx, in order and apart."""
    lo = hi = -1
    for m in rx.finditer(text):
        if m.start() - around > hi:
            if hi >= 0:
                yield lo, hi
            lo = max(0, m.start() - around)
        hi = min(len(text), m.end() + around)
    if hi >= 0:
        yield lo, hi


_AT_SIGN = re.compile(r"[\[({<]\s*(?i:at)\s*[\])}>]")
_DOT_SIGN = re.compile(r"[\[({<]\s*(?i:dot)\s*[\])}>]|\s(?:DOT|dot)\s")


def _id_words(text: str, low: str, gated: bool) -> Iterator[re.Match]:
    """Matches of ID_WORDS."""
    if not gated or len(low) != len(text):
        yield from ID_WORDS.finditer(text)
        return
    for end, size in _ID_STARTS.iter(low):
        if m := ID_WORDS.match(text, end - size + 1):
            yield m


def find(text: str, lexicon: Lexicon, gated: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each case, in order, without overlaps: of two that overlap, the kind that comes first in email, address, id_number, phone, name; then the earlier, then the longer. gated: patterns are tried only where what each of their matches needs is met, with the same result."""
    cases: list[tuple[int, int, int, str]] = []
    low = text.lower()

    def add(rank: int, start: int, end: int, kind: str) -> None:
        cases.append((rank, start, end, kind))

    if "@" in text:
        for m in EMAIL.finditer(text):
            before, after = text[max(0, m.start() - 3) : m.start()], text[m.end() : m.end() + 2]
            if before.endswith("://") or re.match(r":[\w~/]", after) or re.search(r"://\S*$", text[max(0, m.start() - 200) : m.start()]):
                continue
            add(0, m.start(), m.end(), "email")
    if not gated or _AT_SIGN.search(text) or "dot" in low and _DOT_SIGN.search(text):
        for m in SPELLED_EMAIL.finditer(text):
            add(0, m.start(), m.end(), "email")
    squeezed = " ".join(text.split())
    for rx, signs, strong in zip(ADDRESSES, _STREET_SIGNS, _STRONG, strict=True):
        if gated and not any(x in squeezed for x in signs):
            continue
        for m in rx.finditer(text):
            if strong.match(m[0]) or AFTER_STREET.match(text, m.end()) or m.end() == len(text.rstrip()):
                before = _CHINESE_BEFORE.match(m[0]) if signs == ("号",) else None
                add(1, before.end() + m.start() if before else m.start(), m.end(), "address")
    for lo, hi in _windows(NUMBER, text, AROUND) if gated else [(0, len(text))]:
        for k, rx in enumerate(ID_NUMBERS):
            for m in rx.finditer(text, lo, hi):
                if k == 4 and not 7 <= sum(c.isdigit() for c in m[0]) <= 11:
                    continue
                add(2, m.start(), m.end(), "id_number")
        for rx in PHONES:
            for m in rx.finditer(text, lo, hi):
                add(3, m.start(), m.end(), "phone")
        for m in SHORT_PHONE.finditer(text, lo, hi):
            if PHONE_WORDS.search(text[max(0, m.start() - 40) : m.start()]):
                add(3, m.start(), m.end(), "phone")
        for m in LOCAL_PHONE.finditer(text, lo, hi):
            if EXTENSION.match(text, m.end()):
                add(3, m.start(), m.end(), "phone")
    for m in _id_words(text, low, gated):
        v = ID_VALUE.match(text, m.end())
        if v and sum(c.isdigit() for c in v[0]) >= 5:
            add(2, v.start(), v.end(), "id_number")
    for start, end in names_in(text, low, lexicon, gated):
        add(4, start, end, "name")
    taken: list[tuple[int, int, str]] = []
    for _, start, end, kind in sorted(cases, key=lambda c: (c[0], c[1], c[1] - c[2])):
        if all(end <= a or start >= b for a, b, _ in taken):
            taken.append((start, end, kind))
    return sorted(taken)


# pseudonyms


def _keyed(key: bytes, data: bytes) -> bytes:
    """Twelve bytes that nobody without the key can tell."""
    return hashlib.blake2b(data, key=key if len(key) <= 64 else hashlib.sha256(key).digest(), digest_size=12).digest()


def feistel(value: int, size: int, key: bytes, tweak: bytes, rounds: int = 10) -> int:
    """A keyed permutation of 0 .. size - 1: an unbalanced Feistel network over the two parts of a rectangle that holds the range, walked until the result lies in it."""
    if size < 2:
        return value
    a = max(2, int(size**0.5))
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for r in range(rounds):
            n = int.from_bytes(_keyed(key, tweak + bytes([r]) + (right if r % 2 == 0 else left).to_bytes(16, "big")), "big")
            if r % 2 == 0:
                left = (left + n) % a
            else:
                right = (right + n) % b
        value = left * b + right
        if value < size:
            return value


#: Calling codes of one digit, and first digits of those of two that have only them; all others have three.
_ONE_DIGIT = ("1", "7")
_TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: The control letters of Spanish numbers, by the number's rest by 23.
_CONTROL = "TRWAGMYFPDXBNJZSQVHLCKE"
_SPANISH = re.compile(r"([XYZ]?)[- ]?(\d{7,8})[- ]?([A-Z])$")
_DATED = re.compile(r"(\d{2})(\d{2})(\d{2})([-+])(\d{4})$")
_DAYS = 36_525  # of a century, in which a year of two digits repeats


def country_code(digits: str) -> int:
    """How many of the digits of an international number are its calling code."""
    return 1 if digits[:1] in _ONE_DIGIT else 2 if digits[:2] in _TWO_DIGITS else 3


def _refill(value: str, digits: str, letters: str = "") -> str:
    """value with its digits and letters replaced in order; case and other characters stay."""
    new_digits, new_letters = iter(digits), iter(letters)
    return "".join(next(new_digits) if c.isascii() and c.isdigit() else (lambda x: x if c.isupper() else x.lower())(next(new_letters)) if letters and c.isascii() and c.isalpha() else c for c in value)


def _permuted(digits: str, key: bytes, tweak: bytes) -> str:
    return str(feistel(int(digits), 10 ** len(digits), key, tweak)).zfill(len(digits)) if digits else ""


def _day(year: int, month: int, day: int) -> int | None:
    """The day of the century of a date of two-digit year, if there is such a day."""
    try:
        return (datetime.date(2000 + year, month, day) - datetime.date(2000, 1, 1)).days
    except ValueError:
        return None


def phone_pseudonym(value: str, key: bytes) -> str:
    """A telephone number whose digits behind the calling code are permuted. Only digits count, so a number has the same pseudonym however it's written; a trunk zero in brackets stays."""
    plain = value.replace("(0)", "\ue000")
    digits = "".join(c for c in plain if c.isascii() and c.isdigit())
    keep = 0
    if plain.lstrip().startswith("+"):
        keep = country_code(digits)
    elif digits.startswith("00"):
        keep = 2 + country_code(digits[2:])
    head = digits[:keep].removeprefix("00")
    return _refill(plain, digits[:keep] + _permuted(digits[keep:], key, b"phone" + head.encode())).replace("\ue000", "(0)")


def id_pseudonym(value: str, key: bytes) -> str | None:
    """A personal number permuted within its format, if its form is one whose validity can be told and it's valid: with a right control letter (which the pseudonym has too), with a date that exists (a date again), or of digits alone. None if it isn't: its format says nothing then."""
    if m := _SPANISH.fullmatch(value):
        lead, body, letter = m.groups()
        number = str("XYZ".index(lead)) + body if lead else body
        if len(number) != 8 or _CONTROL[int(number) % 23] != letter:
            return None
        new = _permuted(body, key, b"es" + lead.encode())
        control = _CONTROL[int((str("XYZ".index(lead)) if lead else "") + new) % 23]
        return _refill(value, new, lead + control)
    if m := _DATED.fullmatch(value):
        a, b, c, _, serial = m.groups()
        # year first or day first
        if (day := _day(int(a), int(b), int(c))) is not None:
            d = datetime.date(2000, 1, 1) + datetime.timedelta(feistel(day, _DAYS, key, b"ymd"))
            new = f"{d.year % 100:02}{d.month:02}{d.day:02}"
        elif (day := _day(int(c), int(b), int(a))) is not None:
            d = datetime.date(2000, 1, 1) + datetime.timedelta(feistel(day, _DAYS, key, b"dmy"))
            new = f"{d.day:02}{d.month:02}{d.year % 100:02}"
        else:
            return None
        return _refill(value, new + _permuted(serial, key, b"serial"))
    digits = "".join(c for c in value if c.isascii() and c.isdigit())
    if any(c.isalpha() for c in value) or not digits:
        return None
    return _refill(value, _permuted(digits, key, b"id" + str(len(digits)).encode()))


def lettered_pseudonym(value: str, key: bytes) -> str:
    """A number with letters whose validity can't be told: digits and letters permuted each, as one number."""
    digits = "".join(c for c in value if c.isascii() and c.isdigit())
    letters = "".join(c.upper() for c in value if c.isascii() and c.isalpha())
    shape = "".join("9" if c.isdigit() else "A" for c in value if c.isascii() and c.isalnum()).encode()
    new = ""
    if letters:
        n = 0
        for c in letters:
            n = n * 26 + ord(c) - 65
        n = feistel(n, 26 ** len(letters), key, b"letters" + shape)
        for _ in letters:
            n, c = divmod(n, 26)
            new = chr(65 + c) + new
    return _refill(value, _permuted(digits, key, b"digits" + shape), new)


def pseudonym(value: str, key: bytes, kind: str) -> str:
    """value as a keyed permutation inside its own format: equal values give equal pseudonyms, whatever signs part their digits."""
    if kind == "phone":
        return phone_pseudonym(value, key)
    return id_pseudonym(value, key) or lettered_pseudonym(value, key)


def _said(value: str, kind: str) -> str:
    """What of a value without a format counts: not case and space, for names not the order of the parts, for addresses of mail not how they're spelled out."""
    value = " ".join(value.casefold().split())
    if kind == "name":
        return " ".join(sorted(value.replace(",", " ").split()))
    if kind == "email":
        value = re.sub(r"\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+", "@", value)
        return re.sub(r"\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+", ".", value)
    return value


def tag(value: str, key: bytes, kind: str) -> str:
    """A keyed tag of a value that has no format, of 24 hexadecimal digits: among ten billion values two alike are less likely than one in a billion."""
    return _keyed(key, kind.encode() + b"\0" + _said(value, kind).encode("utf-8", "replace")).hex()


def replace(text: str, cases: list[tuple[int, int, str]], key: bytes) -> tuple[str, list[str]]:
    """text with each case as [KIND pseudonym], and the pseudonyms; everything else stays."""
    out, made, at = [], [], 0
    for start, end, kind in cases:
        value = text[start:end]
        made.append(pseudonym(value, key, kind) if kind in ("phone", "id_number") else tag(value, key, kind))
        out += [text[at:start], f"[{kind.upper()} {made[-1]}]"]
        at = end
    return "".join([*out, text[at:]]), made


_LATEST: list = []


def _lexicon(rows: list[tuple[str, str]]) -> Lexicon:
    if not _LATEST or _LATEST[0] is not rows:
        _LATEST[:] = rows, Lexicon(rows)
    return _LATEST[1]


FOUND = "doc_id long, starts array<int>, kinds array<string>, pseudonyms array<string>, clean string"


def _search(sent, key: bytes, with_text: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(sent.value)
        for batch in batches:
            ids, starts, kinds, made, clean = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cases = find(text, lexicon)
                if cases:
                    out, names = replace(text, cases, key)
                    ids.append(doc_id)
                    starts.append([c[0] + 1 for c in cases])
                    kinds.append([c[2] for c in cases])
                    made.append(names)
                    clean.append(out if with_text else None)
            types = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, starts, kinds, made, clean), types, strict=True)], names=["doc_id", "starts", "kinds", "pseudonyms", "clean"])

    return search


def personal_information(documents: DataFrame, lexicon: DataFrame, key: bytes, with_text: bool = True) -> DataFrame:
    """FOUND: of each document with personal information, where each case starts (from 1), its kind, its pseudonym under the key, and the text with placeholders (null without with_text).

    Null and blank texts have none; a null doc_id stays null; rows with a null token or kind in the lexicon are left out; repeated
    documents are searched each. Empty tables give an empty result, without a lexicon names are found by what stands around them.
    Other columns are ignored. One narrow pass without a shuffle; the lexicon goes with each task and may have MAX_LEXICON rows.
    """
    spark = documents.sparkSession
    rows = [(r.token, r.kind) for r in strip_clash(lexicon, {"token": "token", "kind": "kind"}).filter("token IS NOT NULL AND kind IS NOT NULL").distinct().limit(MAX_LEXICON + 1).collect()]
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"the lexicon has more than {MAX_LEXICON} rows")
    docs = strip_clash(documents, {"doc_id": "doc_id", "text": "text"}).filter(F.length("text") > 0)
    return docs.mapInArrow(_search(spark.sparkContext.broadcast(rows), key, with_text), FOUND)


def occurrences(documents: DataFrame, lexicon: DataFrame, key: bytes) -> DataFrame:
    """doc_id, kind, start_pos, pseudonym of each case. Rows of equal kind and pseudonym are one value, in whatever documents and formats."""
    found = personal_information(documents, lexicon, key, with_text=False)
    case = F.explode(F.arrays_zip("kinds", "starts", "pseudonyms")).alias("c")
    return found.select("doc_id", case).select("doc_id", F.col("c.kinds").alias("kind"), F.col("c.starts").alias("start_pos"), F.col("c.pseudonyms").alias("pseudonym")).distinct()
