"""Credentials in source code: found with a trigram index and verified regular expressions, redacted in place."""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.grams import GramTable, literals_of, required_trigrams
from loamstone.session import strip_clash

#: The detectors. A detector's regular expression finds a place; `value` is the group that is redacted.
DETECTORS = {
    "private_key": r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----",
    "aws_access_key": r"(?<![A-Za-z0-9])(?P<value>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])",
    "github_token": r"(?<![A-Za-z0-9])(?P<value>(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})(?![A-Za-z0-9])",
    "gitlab_token": r"(?<![A-Za-z0-9])(?P<value>glpat-[A-Za-z0-9_-]{18,})(?![A-Za-z0-9_-])",
    "slack_token": r"(?<![A-Za-z0-9])(?P<value>xox[abeoprs]-[A-Za-z0-9-]{16,})",
    "payment_key": r"(?<![A-Za-z0-9])(?P<value>(?:sk|rk|pk)_live_[A-Za-z0-9]{16,})(?![A-Za-z0-9])",
    "registry_token": r"(?<![A-Za-z0-9])(?P<value>npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{40,}|dckr_pat_[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])",
    "cloud_key": r"(?<![A-Za-z0-9])(?P<value>AIza[A-Za-z0-9_-]{35}|dop_v1_[a-f0-9]{64}|SG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{16,}|hf_[A-Za-z0-9]{30,40})(?![A-Za-z0-9])",
    "version_token": r"(?<![A-Za-z0-9.])(?P<value>[a-z]{2,4}v[1-4]\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{4,})(?![A-Za-z0-9])",
    "jwt": r"(?<![A-Za-z0-9])(?P<value>eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{8,})",
    "url_password": r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@\"'`<>]*:(?P<value>[^\s/@\"'`<>]{3,})@[\w.\[-]",
    "url_parameter": r"[?&](?:api[_-]?key|access[_-]?token|auth[_-]?token|token|sig|signature|client[_-]?secret|secret|password|passwd|pwd|key)=(?P<value>[^\s&\"'`<>#]{8,})",
    "authorization": r"(?i:authorization)[\"']?\]?\s*[:=,]\s*(?:[frb]{0,2}[\"'`])?(?i:bearer|token|basic|apikey)\s+(?P<value>[A-Za-z0-9+/_.~=-]{8,})",
    "key_header": r"(?i:x-(?:api-key|auth-token|access-token|api-token|secret-key|client-secret))[\"']?\]?\s*[:=,]\s*(?:[frb]{0,2}[\"'`])?(?P<value>[A-Za-z0-9+/_.~=-]{8,})",
    "netrc": r"\bmachine\s+\S+\s+login\s+\S+\s+password\s+(?P<value>[^\s\"'`]{6,})",
    "registry_auth": r"_auth(?:Token)?\s?=\s?[\"']?(?P<value>[A-Za-z0-9+/=_.-]{16,})",
    "password_option": r"\bsshpass\s+-p\s?[\"']?(?P<value>[^\s\"'`]{6,})|\bmysql\w*\s[^\n|;]{0,200}?-p(?P<other>[^\s\"'`-][^\s\"'`]{5,})",
    "user_option": r"\bcurl\s[^\n|;]{0,300}?(?:-u|--user)[ =][\"']?[^\s:\"'`]{1,64}:(?P<value>[^\s\"'`]{6,})",
}
#: Words that make a name one of a credential. Found in names and comments, where what stands beside decides.
KEYWORDS = r"(?i:passw(?:or)?d|passphrase|passwort|pwd|_pass\b|\bpass\b|smtp_?pass|mysql_pwd|pgpassword|secret|api[ _.-]?key|access[ _.-]?key|auth[ _.-]?key|private[ _.-]?key|secret[ _.-]?key|(?:encryption|signing|hmac|billing|deploy|master|shared|account|license|service|storage|consumer|cookie|tls|ssh)[ _.-]?key|token|credential|bearer|registry[ _.-]?auth|redis[ _.-]?auth|_auth\b|auth=\(|auth = \(|\blogin\b|upload[ _.-]?handle|session)"
DETECTORS["named_value"] = KEYWORDS

#: Names that hold no credential though a keyword is in them.
BENIGN_NAME = re.compile(r"(?i)(?:hash|sha\d*|digest|checksum|fingerprint|etag|commit|revision|uuid|guid|(?<![a-z])ids?$|[a-z]Id$|_id$|public|pub_?key|certificate|label|field|header_name|_name$|count|limit|length|size|ttl|expir|timeout|url$|uri$|path$|file$|version|placeholder)")
KEY_OF_ID = re.compile(r"(?i)access[._-]?key[._-]?id$|client[._-]?secret[._-]?id$")
PLACEHOLDER = re.compile(
    r"(?ix)^(?:[x*.•#?\-_=0]+ | <[^>]*>? | \$\{[^}]*\}? | \$\(.*\)? | \$\w+ | %\w+% | %\(?\w*\)?[sd] | \{\{.*\}\}? | \{\w*\} | \[\w*\] | @\w+@ | "
    r"(?!.*\d)(?:your|my|the|some|an?|insert|enter|put|add|replace|change|dummy|fake|sample|example|test|todo|fixme|redacted|removed|hidden|masked|null|none|nil|undefined|true|false|empty|n/?a|default|secret|password|passwd|token|user|username|changeme|foo|bar|value|string)(?:[\s_\-].*|me.*|ed)?)$"
)
#: Names whose value is a password itself.
OF_PASSWORD = re.compile(r"(?i)(?:passw(?:or)?d|passphrase|passwort|pwd|[._-]pass|^pass)$")
UUID = re.compile(r"(?i)^\{?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}?$")
HEX = re.compile(r"^(?:0x)?[0-9a-fA-F]+$")
CLEAN_NAME = re.compile(r"^(?:[a-z]+(?:[A-Z][a-z]+)*\d{0,3}|(?:[A-Z][a-z]+)+\d{0,3}|[a-z][a-z]*(?:[_.][a-z0-9]+)*|[A-Z]+(?:_[A-Z0-9]+)*|v?\d+(?:\.\d+)*|[a-z]+(?:-[a-z]+)*)$")
PATHLIKE = re.compile(r"^(?:[.~]{0,2}/|[A-Za-z]:\\|[a-z+]{2,12}://|[\w.-]+\.(?:py|js|ts|go|rs|java|c|h|cpp|css|html|sql|sh|yaml|yml|json|toml|ini|cfg|txt|md|pem|key|crt|example|test|invalid|local|com|org|net|io)$)|^data:")
CONFIG_FILE = re.compile(r"(?i)\.(?:ya?ml|ini|toml|properties|cfg|conf|env|sh|bash|txt|envrc|tfvars)$|(?:^|/)\.env[\w.]*$")
COMMENT = re.compile(r"(?:^|\s)(?:#(?!define\b|include\b)|//|--\s|/\*|<!--|;;?\s|\*\s)(.*)$")

QUOTED = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`")
NAME_BEFORE = re.compile(r"([A-Za-z_$][\w.$-]*)[\"'`]?\s*\]?\s*\)?\s*(?::=|\|\|=|\?\?=|=>|==?|:(?!:)|,|\(|\s)\s*(?:[frbuFRBUL]{0,2}|new \w+\()?$")
BARE = re.compile(r"(?:^|[\s{(,])(?:export\s+|set\s+|-{1,2})?([A-Za-z_][\w.-]*)\s*(?:=|:\s)\s*([^\s\"'`,;#(){}\[\]<>$][^\s\"'`,;<>]*)")
LOGIN_CALL = re.compile(r"(?i)\blog_?in\s*\([^()]*,\s*$")
#: A comment that tells a value: "password for the demo account is ...", "old token, rotate later: ...", "remove api key ...", "db_password ...".
TOLD = re.compile(r"(?i)(?:(?:passw(?:or)?d|passphrase|pwd|secret|api[ _-]?key|token)s?(?:\s+(?:for|of|on)\s+[\w .-]{1,40}?\s+(?:is|was)|\s*,\s*[\w ]{1,30}:|\s+(?:is|was|=)|\s*[:=])?|\b(?:remove|rotate|revoke|drop|delete)\s+(?:the\s+)?(?:passw(?:or)?d|secret|api[ _-]?key|token))\s+(?P<value>[^\s\"'`(),;<>]{8,})\s*(?:\*/|-->)?\s*$")
#: A value beside a name: a word in prose, which must look like a password by itself.
PROSE_WORD = re.compile(r"[^\s\"'`(),;<>]+")


def kinds_of_chars(v: str) -> int:
    return bool(re.search("[a-z]", v)) + bool(re.search("[A-Z]", v)) + bool(re.search(r"\d", v)) + bool(re.search(r"[^A-Za-z0-9]", v))


def is_placeholder(v: str) -> bool:
    return bool(PLACEHOLDER.match(v)) or "EXAMPLE" in v or "${" in v or "{{" in v or "$(" in v or len(set(v)) <= 3 or bool(re.match(r"(?i)your[_\- ]|.*(?:_here|_me)$", v))


def secret_like(v: str, least: int = 8, named: bool = False) -> bool:
    """A value that someone chose or a machine drew: no placeholder, identifier, path or id; letters and digits, or very mixed letters. named: a name says that it's a credential, so it may be written like a name of code, if it has capitals and digits."""
    mixed = sum(c.isupper() for c in v) >= 3 and sum(c.islower() for c in v) >= 3 and sum(c.isdigit() for c in v) >= 2
    if len(v) < least or is_placeholder(v) or UUID.match(v) or PATHLIKE.search(v) and not (mixed and re.fullmatch(r"[A-Za-z0-9+/]{24,}={0,2}", v)) or CLEAN_NAME.match(v) and not (named and len(v) >= 8 and kinds_of_chars(v) >= 3) or re.search(r"\s", v):
        return False
    letters, digits = sum(c.isalpha() for c in v), sum(c.isdigit() for c in v)
    if not letters or not digits:
        return len(v) >= 24 and kinds_of_chars(v) >= 2 and not re.match(r"^[A-Za-z]+(?:[._/-][A-Za-z]+)*$", v) or letters >= 20 and bool(re.search(r"[a-z][A-Z].*[a-z][A-Z].*[A-Z][A-Z]", v))
    return True


def named_secret(name: str, v: str) -> bool:
    """Whether a literal beside a credential's own name is its value: like a secret, or, under a name of a password, a number or words with signs."""
    if HEX.match(v) and len(v) in (32, 40, 48, 56, 64, 96, 128) or secret_like(v, 6, True):
        return True
    if not OF_PASSWORD.search(name) or len(v) < 6 or is_placeholder(v) or UUID.match(v) or PATHLIKE.search(v) or CLEAN_NAME.match(v) and not v.isdigit() or re.search(r"\s", v):
        return False
    return v.isdigit() or bool(re.search(r"[A-Za-z]", v)) and kinds_of_chars(v) >= 3 and not re.search(r"[(){}\[\]<>=:;,%$/\\]", v)


def password_word(v: str) -> bool:
    """A word that looks like a password even in prose: digits amid letters with another sign or a change of case, or words and a number joined by dashes."""
    if not secret_like(v) or HEX.match(v) and len(v) >= 7 and not re.search(r"[g-zG-Z]", v):
        return False
    if re.fullmatch(r"[a-z]{3,}(?:-[a-z]{3,})+-\d{1,4}", v):
        return True
    if re.search(r"[/\\(){}\[\]=:,]|\.\w+$|^\W|\.\d", v) or re.fullmatch(r"\w+_\w+", v) and v.islower():
        return False
    return bool(re.search(r"[A-Za-z]\d+[A-Za-z]|[A-Za-z]\d*[^\w\s.]+\w*|\d+[^\w\s.-][A-Za-z]", v)) and kinds_of_chars(v) >= 3


def _named(name: str) -> bool:
    """Whether a name is one of a credential."""
    if KEY_OF_ID.search(name):
        return True
    return bool(re.search(KEYWORDS, name)) and not BENIGN_NAME.search(name)


def _line_spans(line: str, config: bool) -> list[tuple[int, int, str]]:
    """Values of a line that has a keyword: (start, end, kind)."""
    spans: list[tuple[int, int, str]] = []
    quoted = [(m.start(), m.end(), next(i for i in (1, 2, 3) if m[i] is not None), m) for m in QUOTED.finditer(line)]
    comment = COMMENT.search(line)
    in_words = bool(re.search(r"(?i)\b(?:passw(?:or)?d|passphrase|secret|token|api[ _-]?key|credential)s?\b", re.sub(r"\w*_\w*", lambda m: m[0] if re.search(r"(?i)pass", m[0]) else " ", QUOTED.sub(" ", line))))
    in_comment = bool(comment and re.search(r"(?i)\b(?:password|passphrase|secret|api key|token)\b", comment[1]))
    k = 0
    while k < len(quoted):
        # literals that are joined are one value
        run = [quoted[k]]
        while k + len(run) < len(quoted) and re.fullmatch(r"\s*\+\s*", line[run[-1][1] : quoted[k + len(run)][0]]):
            run.append(quoted[k + len(run)])
        k += len(run)
        start = run[0][0]
        v = "".join(m[g] for _, _, g, m in run)
        own = [(m.start(g), m.end(g), "value") for _, _, g, m in run]
        head = line[max(0, start - 240) : start]
        before = NAME_BEFORE.search(head[-160:])
        name = before[1] if before else ""
        if name and re.search(r",\s*$", head):
            name = ""
        # a pair of quoted name and quoted value: setProperty("a.password", "..."), name="x" content="..."
        pair = re.search(r"[\"']([\w.\-]+)[\"']\s*(?:,|:|=>|\]\s*=|\)\s*=)\s*$", head) or re.search(r"name=[\"']([\w.\-]+)[\"']\s+(?:content|value)=$", head)
        if pair and (_named(pair[1]) or not head.rstrip().endswith(",")):
            name = pair[1]
        if name.lower() in ("f", "b", "r", "content", "value") and not pair:
            name = ""
        if name and _named(name):
            if named_secret(name, v):
                spans += own
                continue
        elif (in_words or comment and re.search(KEYWORDS, comment[1])) and not (name and BENIGN_NAME.search(name)) and (password_word(v) or (LOGIN_CALL.search(head) or in_comment) and secret_like(v, 8, True) and kinds_of_chars(v) >= 3):
            spans += own
            continue
        # a pair of user and password: auth=("name", "...")
        if re.search(r"(?i)\bauth\s*=\s*\(\s*[\"'][^\"']*[\"']\s*,\s*$", head) and secret_like(v, 6):
            spans += own
        # SQL: PASSWORD '...'
        if re.search(r"(?i)\b(?:password|identified by)\s*$", head) and secret_like(v, 6):
            spans += own
    if config and (m := re.search(r"(?i)\b(?:login|auth|credentials?)\s*[:=]\s*\[?\s*[\w.@-]+\s*,\s*([^\s,\]\"']+)", line)) and password_word(m[1]):
        spans.append((m.start(1), m.end(1), "value"))
    plain = QUOTED.sub(lambda m: " " * len(m[0]), line)
    if config or comment or re.search(r"(?:^|\s)--?\w*(?:pass|pwd|token|secret|key)\w*[= ]", line):
        for m in BARE.finditer(plain):
            if _named(m[1]) and (config or comment and m.start(1) >= comment.start() or m[0].lstrip().startswith("-")):
                v = m[2].rstrip("*/").rstrip() if comment and m.start(2) >= comment.start() else m[2]
                if HEX.match(v) and len(v) in (32, 40, 48, 56, 64, 96, 128) or secret_like(v, 6, True) and not re.search(r"[(){}]", v):
                    spans.append((m.start(2), m.start(2) + len(v), "value"))
    if comment and re.search(KEYWORDS, comment[1]):
        word = re.search(KEYWORDS, comment[1])
        for m in TOLD.finditer(plain, comment.start(1)):
            v = m["value"].rstrip(".:")
            if secret_like(v, 6, True) and any(c.isdigit() for c in v):
                spans.append((m.start("value"), m.start("value") + len(v), "value"))
        for m in PROSE_WORD.finditer(plain, comment.start(1) + word.end()):
            v = m[0].rstrip(".:")
            if password_word(v):
                spans.append((m.start(), m.start() + len(v), "value"))
    return spans


def _basic(v: str) -> bool:
    try:
        return b":" in base64.b64decode(v + "=" * (-len(v) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False


#: An assignment whose value starts on a later line: to a name or a quoted one, an opening bracket or a sign of a block of YAML last. And a literal on a line of its own.
_OPEN_ASSIGNMENT = re.compile(r"([A-Za-z_$][\w.$-]*)[\"'`]?\s*\]?\s*(?::=|=>|(?<![=!<>])=|:)\s*(?:\(|\\|([>|][-+0-9]{0,2}))?\s*$")
_NEXT_LITERAL = re.compile(r"\s*(?:\\\s*)?(?:\+\s*)?[frbuFRBUL]{0,2}(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)(?!\s*:)")
_BLOCK_LINE = re.compile(r"\n([ \t]+)(\S[^\n]*)")


def _later_lines(text: str, lo: int, hi: int, config: bool) -> list[tuple[int, int, str]]:
    """The value, on the lines behind, of an assignment left open at the end of the line from lo to hi; parts of it after the first have the kind key_body."""
    line = text[lo:hi].rstrip("\r")
    m = _OPEN_ASSIGNMENT.search(line[-240:])
    if not m or not _named(m[1]):
        return []
    own: list[tuple[int, int]] = []
    if m[2]:
        indent, at = len(line) - len(line.lstrip(" \t-")), hi
        while config and (b := _BLOCK_LINE.match(text, at)) and len(b[1]) > indent:
            own.append((b.start(2), b.start(2) + len(b[2].rstrip())))
            at = b.end()
    else:
        at = hi
        while q := _NEXT_LITERAL.match(text, at):
            group = next(i for i in (1, 2, 3) if q[i] is not None)
            own.append((q.start(group), q.end(group)))
            at = q.end()
    if not own or not named_secret(m[1], "".join(text[a:b] for a, b in own)):
        return []
    return [(a, b, "password" if k == 0 else "key_body") for k, (a, b) in enumerate(own)]


_RX = {k: re.compile(p) for k, p in DETECTORS.items()}
_WORDS = ahocorasick.Automaton()
for _w in literals_of(KEYWORDS):
    _WORDS.add_word(_w, len(_w))
_WORDS.make_automaton()


def _keyword_places(text: str) -> Iterator[int]:
    """Where keywords end, with one automaton over the text in lower case."""
    low = text.lower()
    if len(low) != len(text):
        return (m.end() - 1 for m in _RX["named_value"].finditer(text))
    return (end for end, _ in _WORDS.iter(low))


_PEM_BODY = re.compile(r"(?:(?:\s|\\n|[\"'+,])*[A-Za-z0-9+/=]{16,})*")
_PEM_RUN = re.compile(r"(?:(?<=\\n)|(?<![A-Za-z0-9+/=\\]))[A-Za-z0-9+/=]{16,}(?![\w.-])")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")


def spans_of(text: str, path: str | None = None, detectors: tuple[str, ...] = tuple(DETECTORS)) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every credential's value in text, in order, without overlaps. A private key has a span for its BEGIN mark, private_key, and one of kind key_body for each run of its text; other code may lie between."""
    out: list[tuple[int, int, str]] = []
    config = bool(path and CONFIG_FILE.search(path.replace("\\", "/")))
    for kind in detectors:
        rx = _RX[kind]
        if kind == "private_key":
            for m in rx.finditer(text):
                end = _PEM_END.search(text, m.end())
                other = rx.search(text, m.end())
                if end is None or other and other.start() < end.start():
                    stop = _PEM_BODY.match(text, m.end()).end()  # cut off: the key goes as far as its lines do
                else:
                    stop = end.start()
                body = [(r.start(), r.end(), "key_body") for r in _PEM_RUN.finditer(text, m.end(), stop)]
                if end is not None and not body:
                    continue
                out.append((m.start(), m.end(), kind))
                out += body
        elif kind == "named_value":
            done = -1
            for at in _keyword_places(text):
                if at < done:
                    continue
                lo = text.rfind("\n", 0, at) + 1
                hi = text.find("\n", at)
                hi = len(text) if hi == -1 else hi
                done = hi
                if _RX[kind].search(text, lo, hi) is None:
                    continue
                out += [(lo + a, lo + b, "password") for a, b, _ in _line_spans(text[lo:hi].rstrip("\r"), config)]
                out += _later_lines(text, lo, hi, config)
        else:
            for m in rx.finditer(text):
                group = "value" if m["value"] is not None else "other"
                v = m[group]
                if is_placeholder(v) or v.startswith("$"):
                    continue
                if kind == "url_password" and not (secret_like(v, 4) or kinds_of_chars(v) >= 2 and len(v) >= 6):
                    continue
                if kind == "authorization" and not (_basic(v) or secret_like(v, 8)):
                    continue
                if kind in ("url_parameter", "key_header", "netrc", "password_option", "user_option") and not secret_like(v, 6):
                    continue
                if kind == "registry_auth" and not (secret_like(v, 16) or HEX.match(v)):
                    continue
                out.append((m.start(group), m.end(group), kind))
    out.sort(key=lambda s: (s[0], s[2] == "key_body", -s[1]))
    kept: list[tuple[int, int, str]] = []
    for s in out:
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each value replaced by its kind in capitals. The marks of a private key stay, and of its lines only what is the key goes, so no line moves."""
    parts, at = [], 0
    for start, end, kind in spans:
        parts += [text[at:start], text[start:end] if kind == "private_key" else f"REDACTED_{kind.upper()}"]
        at = end
    return "".join([*parts, text[at:]])


_NAMES = tuple(DETECTORS)
_CONDITIONS = [required_trigrams(p) for p in DETECTORS.values()]
_TABLE: list[GramTable] = []


def _segment(texts: pa.Array) -> dict[int, tuple[str, ...]]:
    """The detectors whose postings each text of a batch meets."""
    if not _TABLE:
        _TABLE.append(GramTable(_CONDITIONS))
    posted = _TABLE[0].postings(texts)
    out: dict[int, tuple[str, ...]] = {}
    for name, condition in zip(_NAMES, _CONDITIONS, strict=True):
        for row in _TABLE[0].candidates(posted, condition).nonzero()[0].tolist():
            out[row] = (*out.get(row, ()), name)
    return out


FOUND = "chunk_id string, lines array<int>, kinds array<string>, redacted string"


def _search(with_text: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines, kinds, texts = [], [], [], []
            contents = batch.column(2).fill_null("")
            for row, names in _segment(contents).items():
                text = contents[row].as_py()
                spans = spans_of(text, batch.column(1)[row].as_py(), names)
                places = [s for s in spans if s[2] != "key_body"]
                if not places:
                    continue
                breaks = [m.start() for m in re.finditer("\n", text)]
                ids.append(batch.column(0)[row].as_py())
                lines.append([bisect_right(breaks, s[0] - 1) + 1 for s in places])
                kinds.append([s[2] for s in places])
                texts.append(redact(text, spans) if with_text else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lines, pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["chunk_id", "lines", "kinds", "redacted"])

    return search


def find_credentials(chunks: DataFrame, with_text: bool = False) -> DataFrame:
    """chunk_id, lines, kinds of the credentials in each chunk that has any, and its redacted content if with_text.

    Each Arrow batch is a segment of the trigram index, so the pass is narrow: nothing but the few hits is shuffled, to count
    repeated rows once. Null and empty contents have none; a null file_path is no configuration file; other columns are ignored.
    """
    rows = strip_clash(chunks, {"chunk_id": "chunk_id", "file_path": "file_path", "content": "content"})
    return rows.filter(F.length("content") > 0).mapInArrow(_search(with_text), FOUND).distinct()


def credential_lines(chunks: DataFrame) -> DataFrame:
    """chunk_id, line_no of each line on which a credential starts."""
    return find_credentials(chunks).select("chunk_id", F.explode("lines").alias("line_no")).distinct()
