"""Broken prompt and response pairs: which defect an answer has, if any."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loamstone.llm.conversations import question_answer_pairs

#: What stands in for no text, without case, brackets and outer punctuation.
STAND_INS = frozenset(
    "none|null|nil|undefined|nan|n/a|na|empty|blank|void|tbd|todo|no answer|no response|no reply|no output|no text|no content|not available|not applicable|nothing|answer missing|empty answer|empty response|"
    "response missing|missing|placeholder|keine antwort|leer|sin respuesta|vacío|sans réponse|vide|sem resposta|vazio|无|空|无回答|无内容".split("|")
)

#: Refusals in words of the normal form below; * stands for up to eight words of any kind, a/b for one of several.
REFUSALS = """
i am unable/afraid to/i assist/help/answer/discuss/provide/share/comply/explain/cannot *
i am not able/allowed/permitted/authorized to assist/help/answer/discuss/provide/share/comply/explain/talk/go/comment *
i cannot help/assist/answer/discuss/comply/provide/share/disclose/comment *
i cannot do that/this
i cannot explain/describe/talk/speak/fulfill/fulfil about/on/that/this/your/the *
i cannot go into *
i will not/never be able to assist/help/answer/discuss/provide/share/explain *
i will not answer/help/assist/discuss/provide/share/explain/comment *
i must/have respectfully/to decline/refuse *
i must/should/would/will/have/rather to/not decline/refuse *
i decline/refuse to *
i have to decline/pass/refuse
i am sorry but i cannot *
this/that/it falls/is/lies outside/beyond what i am allowed/permitted/able to *
it/this/that/which goes/is against my guidelines/rules/policy/policies/instructions
request cannot/can be/not fulfilled/answered/completed/met by me
answering/doing/discussing this/that/it would not be appropriate
not be appropriate for me to *
no me está/es permitido/posible hablar/responder/ayudar/contestar/decir *
no puedo ayudar/responder/contestar/hablar/explicar/dar *
debo rechazar/negarme/declinar *
tengo que rechazar/negarme/declinar *
me niego a *
dabei/damit/hierbei kann ich nicht/leider nicht/helfen *
kann/darf ich nicht/keine/leider helfen/beantworten/auskunft/antworten/nicht *
ich kann/darf nicht/keine/leider/dabei/dir/ihnen helfen/beantworten/auskunft/antworten/nicht *
muss ich leider ablehnen
ich muss * ablehnen
je ne peux/puis/suis pas vous/t/répondre/aider/en/autorisé/autorisée aider/répondre/à/mesure/discuter/avec/sur *
je dois/vais refuser/décliner de/cette *
je refuse de *
il m est interdit de *
não posso ajudar/responder/falar/explicar/discutir *
não me é permitido *
não estou autorizado a *
devo/preciso recusar/negar *
tenho de/que recusar *
无 法 协 助 *
无 法 回 答 *
无 法 提 供 *
无 法 处 理 *
不 能 回 答 *
不 能 协 助 *
不 能 帮 *
不 便 回 答 *
拒 绝 回 答 *
""".strip().splitlines()

#: Function words by language. A word of several languages counts for each of them with a share of its weight.
WORDS = {
    "en": "the and of to is in that it for was were with by not are this from we which when than be as at or an has have had can could would should will what why how where who does do did if then there their they its on you your all only because before after until most more no nobody explain describe list find write summarize between happens which safe remove please into",
    "de": "der die das und ist nicht wird noch von den dem des in auf sich eine ein einen zu dass es werden bei ohne mit für aus an im am als wenn nur auch oder so wie was wo wer warum welche welcher wird wurde hat haben kann kannst man denn nach ab vor zuerst wieder durch um nichts liefert erklären sind dann beim zum zur über weil deshalb kein keine etwa gibt gelesen",
    "es": "el la los las que de en no se una un unos es por para con su sus está están lo al del como más pero o y cuando donde dónde qué quién cómo función puedes explicar hace partir desde ya antes después sin este esta estos cada si pues tras mejor conviene primero línea hay eso nada está vacía llama segura eliminar",
    "fr": "le la les des est que de du dans et il elle ne pas une un pour sur au aux plus ce cette ces qui se sa son en par avec sans après avant quand où quoi pourquoi comment quelle quel peux tu expliquer fait partir ligne rien ou mais donc car puis doit encore sont être soit vous je d l n s qu c supprimer sûr appelle",
    "pt": "o a os as que de em não é uma um para do da dos das no na nos nas se foi com por ao à mais mas ou e quando onde quem como porque qual função você pode explicar faz partir linha nada antes depois sem este esta esse essa cada já ser está são pois isso pela pelo primeiro preciso vazia chama seguro remover quê",
}
LANGUAGES = tuple(WORDS)
_WEIGHT: dict[str, dict[str, float]] = {}
for _lang, _words in WORDS.items():
    for _w in set(_words.split()):
        _WEIGHT.setdefault(_w, {})[_lang] = 0.0
for _w, _by in _WEIGHT.items():
    for _lang in _by:
        _by[_lang] = 1.0 / len(_by) ** 2
#: Letters that speak for a language.
LETTERS = {"de": "äöüß", "es": "ñ¿¡íóáú", "fr": "èêëîïôûœç", "pt": "ãõâêç"}
_LETTERS = {lang: frozenset(letters) for lang, letters in LETTERS.items()}
#: Names of the languages, in each of them.
NAMES = {
    "en": "english englisch inglés inglês anglais 英语 英文",
    "de": "german deutsch alemán alemão allemand 德语 德文",
    "es": "spanish spanisch español espanhol espagnol castellano 西班牙语",
    "fr": "french französisch francés francês français 法语 法文",
    "pt": "portuguese portugiesisch portugués português portugais 葡萄牙语",
    "zh": "chinese chinesisch chino chinês chinois mandarin 中文 汉语",
}
_NAME = {n: lang for lang, names in NAMES.items() for n in names.split()}
ASK = re.compile(r"(?i)\b(?:answer|reply|respond|write|explain|say|translate|antworte|antworten|schreib\w*|übersetz\w*|auf|responde|respond[ea]\w*|contesta|traduce|traduza|escribe|escreva|répond\w*|écri\w*|tradui\w*|in|into|en|em)\b|用|以|请用")

INVISIBLE = re.compile(r"[\s\x00-\x1f\x7f-\x9f­͏؜ᅟᅠ឴឵᠎​-‏ -  -⁯⠀　ㅤ﻿ﾠ]+")
WORD = re.compile(r"[一-鿿぀-ヿ가-힯]|[^\W_]+(?:_[^\W_]+)*", re.U)
FENCE = re.compile(r"^[ \t>]*(`{3,}|~{3,})([^\n]*)$", re.M)
CODE = re.compile(r"(?s)^[ \t>]*(`{3,}|~{3,}).*?(?:^[ \t>]*\1[`~]*[ \t]*$|\Z)|<(pre|code|syntaxhighlight|source)\b.*?(?:</\2>|\Z)|\\begin\{(verbatim|lstlisting|minted)\}.*?(?:\\end\{\3\}|\Z)|`[^`\n]*`", re.M | re.I)
NOT_PROSE = re.compile(r"<[^<>\n]{1,200}>|\bhttps?://\S+|\S*[\\/_=<>{}()\[\]|]\S*|\b\w*[a-z][A-Z]\w*\b|&#?\w+;|\\[a-zA-Z]+")
OPENERS = (("<pre", "</pre>"), ("<syntaxhighlight", "</syntaxhighlight>"), ("<source", "</source>"), ("\\begin{verbatim}", "\\end{verbatim}"), ("\\begin{lstlisting}", "\\end{lstlisting}"), ("\\begin{minted}", "\\end{minted}"))
LAST_LINE_FINE = re.compile(r"^\s*(?:[|!].*|.*\|\s*|[-=*_~`]{3,}|.*</?\w+[^>]*>|\\end\{\w+\*?\}|.*\\\]|.*\$[^$]+\$\$?|\{\{.*\}\}|\|\}|\[\[.*\]\]|={2,}.*={2,}|#{1,6}\s.*|\[[^\]]+\]:\s*\S+|.*https?://\S+)\s*$")
LIST_ITEM = re.compile(r"^\s*(?:[-*+•#]+|\d+[.)])\s+(?:\[[ xX]\]\s+)?")
CLOSERS = "\"'”’»›)]}*_~`>」』）】|"
TERMINAL = ".!?…。！？"
CONTRACTIONS = (("can't", "cannot"), ("won't", "will not"), ("n't", " not"), ("i'm", "i am"), ("i'd", "i would"), ("i'll", "i will"), ("i've", "i have"), ("can not", "cannot"), ("could not", "cannot"))


def is_empty(answer: str | None) -> bool:
    """Null, nothing to see, or only a stand-in for no text."""
    if answer is None:
        return True
    text = INVISIBLE.sub(" ", answer).strip()
    if not any(c.isalnum() for c in text):
        return True
    return text.strip("<>[](){}\"'`*_.!- ").casefold() in STAND_INS


def words(text: str) -> list[str]:
    return WORD.findall(text.casefold())


def shingles(tokens: list[str], n: int = 3) -> set[tuple]:
    return {tuple(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))}


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: one row of bits for a, one step for each token of b."""
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        u = row & where.get(t, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def is_copy(question: str | None, answer: str) -> bool:
    """Nothing but the question or its first paragraph, once or several times, with at most a few words to introduce it.

    The shingles of the answer must lie in the question; then the longest common subsequence of the answer with so many
    repetitions of the source tells how many words are left over.
    """
    if not question:
        return False
    a = words(answer)
    if not a:
        return False
    for source in dict.fromkeys((question, question.strip().split("\n\n")[0])):
        q = words(source)
        if len(q) < 2 or len(a) < 0.9 * len(q):
            continue
        sq, sa = shingles(q), shingles(a)
        if len(sq & sa) < 0.8 * len(sq):
            continue
        # what isn't the source: an introduction, joints of repetitions
        times = max(1, round(len(a) / len(q)))
        if len(a) > times * len(q) + 8:
            continue
        left = len(a) - lcs(a, q * times)
        if left <= min(6, 1 + 0.5 * len(q)):
            return True
    return False


_TEMPLATES = [[frozenset(w.split("/")) if w != "*" else None for w in t.split()] for t in REFUSALS]
_FIXED = [[t for t in template if t is not None] for template in _TEMPLATES]
_TRIGGER = frozenset("cannot decline refuse unable allowed permitted guidelines appropriate pass fulfilled sorry afraid authorized able refuser refuse puedo permitido rechazar negarme niego declinar helfen auskunft ablehnen beantworten darf décliner peux puis interdit posso permitido recusar autorizado 无 不 拒".split()) | {"not"}


def _normal(text: str) -> list[str]:
    t = text.casefold().replace("’", "'")
    for a, b in CONTRACTIONS:
        t = t.replace(a, b)
    return WORD.findall(t)


#: Words of which one says no; an alignment never misses one.
_NEGATIVE = frozenset("not cannot never decline refuse pass unable afraid outside beyond against no niego negarme declinar rechazar nicht keine ablehnen ne pas refuser décliner interdit não recusar negar 无 不 拒".split())
#: Words that name nothing but the request itself; and those with which a reason or an aside starts.
_REQUEST = frozenset(
    "a about all an any anything at can discuss do further for from here help i in into it kind me more my of on or out please question questions request requests such task that the them these they thing things this those to topic unfortunately with you your "
    "anfrage aufgabe bei damit dabei das dazu dem den der die dies diese diesen dieser dir frage hierbei hierzu ich ihnen ihre in leider mit nicht weiter "
    "a ayudar ayudarte ayudarle con de ello en esa ese eso esta este esto la lo pedido petición pregunta solicitud su sobre tema tu "
    "aider avec ce cela cette ça de demande la le question répondre requête sujet sur t vous votre à "
    "ajudar com de essa esse isso esta este isto no na nesse nessa o pedido pergunta sobre solicitação "
    "个 事 件 任 关 务 协 助 您 您 的 你 回 帮 忙 您 此 求 理 答 处 提 供 这 该 请 问 题 项".split()
)
_ASIDE = frozenset("because since as so due but even hope regardless although though which until unless without denn weil da obwohl porque pues ya car parce pois 因 为 所 但 抱 希".split())
CODE_BLOCK = re.compile(r"(?ms)^[ \t>]*(`{3,}|~{3,}).*?(?:^[ \t>]*\1[`~]*[ \t]*$|\Z)")
SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n\s*\n")
#: Words of courtesy, of the speaker and of the one spoken to; a sentence with one of them states nothing of the matter.
_COURTESY = frozenset("i me my you your we please sorry thanks thank hello hi apologies ich mir mich sie ihnen ihre du dir bitte danke leider yo me usted tu te por favor gracias lamento je me vous votre merci désolé eu me você seu obrigado obrigada desculpe lamento 我 您 你 请 谢 抱".split())


def _align(template: list, tokens: list[str]) -> tuple[float, int]:
    """(the best share of the template's words met in order by a run of tokens in which nothing but slots may lie between them, where that run ends); one word may differ, but none that says no."""
    fixed = [t for t in template if t is not None]
    slot_after = [i + 1 < len(template) and template[i + 1] is None for i, t in enumerate(template) if t is not None]
    best, end = 0, 0
    for start in range(len(tokens)):
        i, met, missed, free = start, 0, 0, 0
        for k, options in enumerate(fixed):
            j = i
            while j < len(tokens) and j - i <= free and tokens[j] not in options:
                j += 1
            if j < len(tokens) and tokens[j] in options:
                met, i = met + 1, j + 1
            else:
                missed += 1
                if missed > 1 or options <= _NEGATIVE:
                    break
            free = 8 if slot_after[k] else 1
        if met > best:
            best, end = met, i
        if best == len(fixed):
            break
    return best / len(fixed), end


def _declines(sentence: str) -> tuple[bool, bool]:
    """(whether a sentence declines, whether it declines the request as a whole and not a thing that it names)."""
    tokens = _normal(sentence)
    present = set(tokens)
    if _TRIGGER.isdisjoint(present) or _NEGATIVE.isdisjoint(present):
        return False, False
    declines = False
    for template, fixed in zip(_TEMPLATES, _FIXED, strict=True):
        # an alignment misses one word at most
        if sum(present.isdisjoint(options) for options in fixed) > 1:
            continue
        share, end = _align(template, tokens)
        if share >= (1.0 if len(fixed) < 6 else 0.8):
            declines = True
            rest = tokens[end:]
            stop = next((k for k, t in enumerate(rest) if t in _ASIDE), len(rest))
            if _REQUEST.issuperset(rest[:stop]):
                return True, True
    return declines, False


def is_refusal(answer: str) -> bool:
    """Whether a sentence of the answer, anywhere in it, aligns with a refusal and says so of the speaker, and the answer gives nothing else.

    One that declines the request as a whole is enough. If it declines a thing that it names, the answer is sound if it holds a
    block of code or states two things of the matter besides.
    """
    text = CODE_BLOCK.sub("\n\n", answer)
    has_code = text != answer
    sentences = [s for s in SENTENCE_END.split((text if text.strip() else answer).strip()) if s]
    found, stated = False, 0
    for sentence in sentences:
        declines, whole = _declines(sentence)
        if whole:
            return True
        found |= declines
        stated += not declines and not sentence.rstrip().endswith(("?", "？")) and _COURTESY.isdisjoint(tokens := _normal(sentence)) and len(tokens) > 2
    return found and stated < 2 and not has_code


def _left_open(mark: str, text: str) -> bool:
    """Whether a mark that stands alone at the end of text opens something, since no earlier one of its kind in the paragraph waits to be closed."""
    if mark[0] in "([{“":
        return True
    before = text[text.rfind("\n\n") + 1 : len(text) - len(mark)]
    kind = re.escape(mark[0])
    waits = False
    for m in re.finditer(rf"(?<!{kind}){re.escape(mark)}(?!{kind})", before):
        after_word = before[m.start() - 1 : m.start()].isalnum()
        if after_word and before[m.end() : m.end() + 1].isalnum():
            continue
        waits = not waits and not after_word
    return not waits


def is_truncated(answer: str) -> bool:
    """Inside code that is still open, or in mid-sentence."""
    text = answer.rstrip()
    mark = None
    for m in FENCE.finditer(text):
        if mark is None:
            mark = m[1]
        elif m[1][0] == mark[0] and len(m[1]) >= len(mark) and not m[2].strip():
            mark = None
    if mark is not None:
        return True
    low = text.lower()
    for opening, closing in OPENERS:
        if low.rfind(opening) > low.rfind(closing):
            return True
    last = text.rsplit("\n", 1)[-1]
    if LAST_LINE_FINE.match(last) or FENCE.match(last):
        return False
    core = last.rstrip()
    ended = core.rstrip(CLOSERS + " ")
    if not ended:
        return core[-1:] in "([{"
    if ended[-1] in TERMINAL:
        return False
    if core != ended and core[-1] not in "([{":
        # a closed span or quotation without a full stop ends a list item or a quotation, not a sentence
        last_word = core.rsplit(None, 1)[-1]
        word = last_word.lstrip("([{\"'“*")
        if not word.strip("`_~"):
            return _left_open(last_word, text)
        return word[-1] == "_" and not word.startswith("_") and not LIST_ITEM.match(last)
    return True


def prose(text: str) -> str:
    return NOT_PROSE.sub(" ", CODE.sub(" ", text))


def language(text: str | None) -> str | None:
    """The language of the prose of a text, None if too little speaks for any."""
    if not text:
        return None
    plain = prose(text)
    han = sum("一" <= c <= "鿿" for c in plain)
    tokens = re.findall(r"[^\W\d_]+", plain.lower())
    latin = [t for t in tokens if not "一" <= t[0] <= "鿿"]
    if han >= 4 and han >= 2 * len(latin):
        return "zh"
    score = dict.fromkeys(LANGUAGES, 0.0)
    for t in latin:
        for lang, w in _WEIGHT.get(t, {}).items():
            score[lang] += w
        if not t.isascii():
            for lang, letters in _LETTERS.items():
                if not letters.isdisjoint(t):
                    score[lang] += 0.5
    low = plain.lower()
    for lang, mark in (("es", "¿"), ("es", "¡")):
        score[lang] += 1.5 * (mark in low)
    first, second = sorted(score.values(), reverse=True)[:2]
    if first < 0.9 or first < 1.3 * second:
        return "zh" if han >= 4 else None
    return max(score, key=score.get)


def asked_language(question: str) -> str | None:
    """The language that a line of the question asks for, if any."""
    for line in reversed(question.splitlines()):
        low = line.lower()
        for name, lang in _NAME.items():
            if name in low and ASK.search(line):
                return lang
    return None


def is_other_language(question: str | None, answer: str) -> bool:
    """Another language than the question's, unless the question asks for it."""
    if not question:
        return False
    own = language(answer)
    if own is None:
        return False
    wanted = asked_language(question)
    if wanted is not None:
        return own != wanted and own != language(question)
    first = question.strip().split("\n\n")[0]
    theirs = language(first) or language(question)
    return theirs is not None and own != theirs


def defect(question: str | None, answer: str | None) -> str | None:
    """One of empty, copy, refusal, truncated, language, in this order; None for a sound answer."""
    if is_empty(answer):
        return "empty"
    if is_copy(question, answer):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    if is_truncated(answer):
        return "truncated"
    if is_other_language(question, answer):
        return "language"
    return None


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found = [], []
        for q, a, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            d = defect(q, a)
            if d:
                ids.append(i)
                found.append(d)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.string())], names=["message_id", "defect"])


def defective_answers(messages: DataFrame) -> DataFrame:
    """message_id, defect of each answer that has one.

    Pairs come from question_answer_pairs: repeated rows count once, rows without created_at or conversation_id pair with nothing.
    A null or blank question can't be copied or have a language; its answer is still judged by itself. Empty tables give an empty
    result; other columns are ignored. Time is linear in the texts but for the common subsequence, which is taken only where
    shingles agree, with a machine word's worth of the answer at a time.
    """
    return question_answer_pairs(messages).select("question", "answer", "answer_id").mapInArrow(_flag, "message_id string, defect string")
