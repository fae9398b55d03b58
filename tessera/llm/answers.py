"""Problem 6: answers that are no usable query, with their type of defect.

One pushdown parser takes an answer out of its wrapping: code fences, markup tags, block quotes and list items are frames on
its stack, and a fence or tag that is never closed is a sign of truncation.  A second one reads the query: quotes, comments,
brackets, CASE..END and what each keyword still needs; what is left open at its end means truncation, and so does the
engine's own word for it in the error message.  Answers without a query are held against the question by greedy string
tiling (tiles of three words and more are the anchors, words between them are aligned in order), then against a refusal
grammar whose rules are built from the parts of speech of several languages, and last against script and language checks.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tiling import chain, tiles

COPIED_SHARE = 0.8  # of the question's words, in order: stated by the problem
TILE_WORDS = 3  # shorter matches are no tiles

COMMENT = re.compile(r"('(?:[^']|'')*'|\"[^\"\n]*\"|`[^`\n]*`)|--[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
MARKS = re.compile(r"--+|/\*+|\*+/|[;#]|[\s​﻿]+")
PLACEHOLDER = re.compile(r"[\s\"'`(\[<{]*(?:error|null|none)[\s\"'`)\]>};.:!]*", re.I)
WORD = re.compile(r"[^\W_]+")
QUERY = re.compile(r"\(*\s*(?:select\b|with\s+(?:recursive\s+)?[\w\"`\[]+\s*(?:\(|as\b)|with\s*$|with\s+\w+\s*$|(?:insert|replace)\s+into\b|update\s+\S+\s+set\b|delete\s+from\b|create\s+(?:temp\w*\s+)?(?:table|view|index)\b|values\s*\(|explain\s|pragma\s)", re.I)
START = re.compile(r"(?:\A|\n|[:：]|[>=|]\s)\s*(?=(?:select|with)\b)", re.I)
TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\[[^\]]*\]|[^\W\d]\w*|\d+(?:\.\d*)?(?:e[+-]?\d+)?|<>|<=|>=|!=|==|\|\||[^\s]", re.I)

#: Words after which a query cannot end, because something must follow.
NEEDS_MORE = frozenset(
    "select distinct all from where and or not on by group order having join inner left right full outer cross natural union except intersect "
    "as in like glob regexp between is case when then else with limit offset set values using exists cast partition over escape collate into recursive".split()
)
SIGNS_NEED_MORE = frozenset(["=", "<", ">", "<=", ">=", "<>", "!=", "==", "+", "-", "/", "%", "||", ",", ".", "(", "|", "&", "~"])
KEYWORDS = NEEDS_MORE | {"end", "asc", "desc", "null", "true", "false", "nulls", "first", "last"}

#: Marks of wrapping, and the tags that are markup rather than comparisons.
FENCE = re.compile(r"```|~~~")
INFO = re.compile(r"(?:sql|sqlite|text|python|js)?", re.I)
TAG = re.compile(r"<(/?)(sql|query|answer|code|pre|p|b|i|em|strong|div|span)(?:\s[^<>]*)?>", re.I)
ITEM = re.compile(r"[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]+")
BLOCK_QUOTE = re.compile(r"[ \t]*>[ \t]?")
BEGINS = re.compile(r"\s*\(*\s*(?:select|with)\b", re.I)

#: Parts of speech of refusals.  A rule of the grammar puts them in order within a sentence.
SPEECH = {
    "en": {
        "subject": r"(?:i|we|this (?:assistant|model|system))",
        "denial": r"(?:cannot|can't|can ?not|could not|couldn't|won't|will not|would not|wouldn't|unable|not able|must decline|have to decline|need to decline|declined?|(?:must )?refuse|(?:am|are) not (?:allowed|permitted|going)|(?:don't|do not) (?:have|know|feel)|not comfortable|regret)",
        "apology": r"(?:sorry|apologi[sz]e|my apologies|regrettably|unfortunately)",
        "object": r"(?:request|question|query|this|that|it)",
        "rejection": r"(?:falls? outside|out of scope|beyond (?:the|my) scope|against (?:the|our|my) polic|violates?|can(?:not|'t) be (?:answered|done|written|fulfilled|processed|honou?red|served|met)|(?:has been |is |was )?(?:declined|refused|denied|rejected))",
    },
    "de": {"subject": r"(?:ich|wir)", "denial": r"(?:kann|können|darf|dürfen|bedauere?|verweiger\w*)", "apology": r"(?:leider|tut mir leid|entschuldigung)"},
    "es": {"denial": r"(?:no puedo|no podemos|no es posible|me niego)", "apology": r"(?:lo siento|lo lamento|disculpa)"},
    "fr": {"denial": r"(?:je ne (?:peux|puis)|nous ne pouvons|je refuse|impossible de|je suis dans l'impossibilité)", "apology": r"(?:désolée?|je regrette)"},
    "it": {"denial": r"(?:non posso|non possiamo)", "apology": r"mi dispiace"},
    "pt": {"denial": r"(?:não posso|não é possível)", "apology": r"(?:sinto muito|desculpe)"},
    "nl": {"denial": r"ik kan (?:deze|dit|niet|geen)", "apology": r"het spijt me"},
    "pl": {"denial": r"nie mogę", "apology": r"przepraszam"},
    "ru": {"denial": r"(?:не могу|не можем|невозможно|отказываюсь)", "apology": r"(?:к сожалению|извините|простите)"},
    "zh": {"denial": r"(?:無法|无法|不能(?:回答|提供|编写|生成|帮)|拒绝|拒絕|不便(?:回答|提供))", "apology": r"(?:抱歉|对不起|對不起|很遗憾)"},
    "ja": {"denial": r"(?:できません|お答えでき)", "apology": r"(?:申し訳|すみません)"},
    "ko": {"denial": r"(?:할 수 없|불가능)", "apology": r"죄송"},
}
#: What follows an apology when it declines, in any of the languages.
ACTS = r"(?:answer|writ|produc|provid|giv|help|assist|build|creat|generat|offer|shar|comply|work|support|\bno\b|\bnot\b|n't\b|without|missing|lacks?|unable|kein|nicht|para|sobre|pour|consulta|requ|для|запрос)"


def _grammar() -> list[re.Pattern]:
    """Rules: apology and act; subject and denial; denial by itself where the language marks it; object and rejection; impersonal forms."""
    rules = []
    for tongue, part in SPEECH.items():
        edge = "" if tongue in ("zh", "ja", "ko") else r"\b"
        denial = f"{edge}{part['denial']}{edge if not part['denial'].endswith('*)') else ''}"
        if tongue == "en":
            rules.append(rf"\b{part['subject']}\b[^.!?\n]{{0,40}}?{denial}")
            rules.append(rf"\b{part['object']}\b[^.!?\n]{{0,30}}\b{part['rejection']}")
        elif tongue == "de":
            rules.append(rf"\b(?:{part['denial']}\b[^.!?\n]{{0,20}}\b{part['subject']}|{part['subject']}\b[^.!?\n]{{0,20}}\b{part['denial']})\b[^.!?\n]{{0,80}}?\b(?:kein\w*|nicht|verweiger\w*|möglich|ablehnen)\b")
        else:
            rules.append(denial)
        rules.append(rf"{edge}{part['apology']}{edge}[^.!?\n。！]{{0,160}}?(?:{denial}|{ACTS})")
    rules += [
        r"\b(?:no|not any) (?:query|sql|answer|statement|response|result)s? (?:can|could|may|will|is|shall)\b|\bthere is (?:not enough|insufficient|no) (?:information|data|context|way)\b|\bnot enough information\b|\binsufficient (?:information|context|data)\b",
        r"\b(?:would|is|it's|it is|be) (?:not (?:be )?)?(?:in)?appropriate\b|\bnot (?:be )?(?:appropriate|possible|allowed|permitted)\b|\bimpossible to (?:answer|write|say|produce|build)\b",
        r"\b(?:declined|refused|denied|rejected|withheld)\b\s*(?:\(|[.!;:]|$)|\bunder (?:the )?(?:present|current|this) policy\b|\bcontent policy\b|\baccess denied\b|\bpolicy (?:forbids|prohibits|does not)\b",
    ]
    return [re.compile(r, re.I) for r in rules]


REFUSALS = _grammar()

#: Scripts by their letters, and what programs look like.
SCRIPTS = {
    "han": re.compile(r"[\u3400-\u4dbf\u4e00-\u9fff]"), "kana": re.compile(r"[\u3040-\u30ff]"), "hangul": re.compile(r"[\uac00-\ud7af]"), "cyrillic": re.compile(r"[\u0400-\u04ff]"),
    "greek": re.compile(r"[\u0370-\u03ff]"), "arabic": re.compile(r"[\u0600-\u06ff]"), "hebrew": re.compile(r"[\u0590-\u05ff]"), "devanagari": re.compile(r"[\u0900-\u097f]"), "thai": re.compile(r"[\u0e00-\u0e7f]"),
}
PROGRAM = re.compile(r"\w\s*\([^()]*\)|=>|->|<-|%>%|::|[{};]|\b(?:import|def|const|let|var|function|return|print|lambda|class|library|for \w+ in)\b|\w\.\w+\(|\[['\"]\w")
LETTERS = re.compile(r"[^\W\d_]+")


def longest_in_order(question: list[str], answer: list[str]) -> int:
    """Length of the longest common subsequence of words."""
    row = [0] * (len(answer) + 1)
    for q in question:
        last = 0
        for j, a in enumerate(answer, 1):
            keep = row[j]
            row[j] = last + 1 if q == a else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def tiled_words(question: list[str], answer: list[str], least: int = 1) -> int:
    """Words of the question covered by greedy string tiling with tiles of at least ``least`` words."""
    return sum(k for _, _, k in tiles(*_numbered(question, answer), least))


def _numbered(question: list[str], answer: list[str]) -> tuple[np.ndarray, np.ndarray]:
    number: dict[str, int] = {}
    q, a = (np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in (question, answer))
    return q, a


def anchored_words(question: list[str], answer: list[str]) -> int:
    """Words of the question in order in the answer: the tiles that keep the order, and between neighbours of these the
    longest common subsequence.  Never more than the longest common subsequence of the whole."""
    anchors = chain(tiles(*_numbered(question, answer), TILE_WORDS))
    total, i, j = 0, 0, 0
    for p, q, k in [*anchors, (len(question), len(answer), 0)]:
        total += longest_in_order(question[i:p], answer[j:q]) + k
        i, j = p + k, q + k
    return total


def copies_question(question: str | None, body: str) -> bool:
    """Whether at least ``COPIED_SHARE`` of the question's words come back in order.

    Tiles decide most answers; one that they leave below the share is aligned as a whole, as anchors may stand in the way.
    """
    q = WORD.findall((question or "").lower())
    if not q:
        return False
    need, have = COPIED_SHARE * len(q) - 1e-9, Counter(q)
    a = [w for w in WORD.findall(body.lower()) if w in have]  # other words match nothing
    if sum((have & Counter(a)).values()) < need:
        return False
    return anchored_words(q, a) >= need or longest_in_order(q, a) >= need


def unwrap(answer: str) -> tuple[str, list[str]]:
    """The text of an answer without its wrapping, and the frames that are still open at its end.

    Fences and tags are pushed where they open and popped where they close.  List and quote marks are frames of one line;
    they are taken for wrapping as long as no query has begun, since a query may go on with a star or a comparison.
    """
    stack: list[str] = []
    out: list[str] = []
    begun = False
    for line in answer.split("\n"):
        while not begun and (m := BLOCK_QUOTE.match(line) or ITEM.match(line)) and m.end():
            line = line[m.end() :]
        at, part = 0, []
        while m := FENCE.search(line, at):
            mark = m.group()
            part.append(line[at : m.start()])
            at = m.end()
            if mark in stack:
                while stack.pop() != mark:
                    pass
            else:
                stack.append(mark)
            if not line[: m.start()].strip() and "`" not in line[at:]:
                at = len(line)  # the info string of a fence that stands alone
            elif mark == "```":
                at = INFO.match(line, at).end()
            part.append("\n")
        part.append(line[at:])
        text = "".join(part)
        if "<" in text:
            at, part = 0, []
            for m in TAG.finditer(text):
                part.append(text[at : m.start()])
                at, name = m.end(), m.group(2).lower()
                if m.group(1) and name in stack:
                    while stack.pop() != name:
                        pass
                elif not m.group(1) and not begun and not BEGINS.match("".join(part)):
                    stack.append(name)
                else:
                    part.append(m.group())  # a comparison within a query
                    continue
                part.append(" ")
            text = "".join(part) + text[at:]
        begun = begun or bool(BEGINS.match(text))
        out.append(text)
    return "\n".join(out), stack


def tongue(text: str) -> str | None:
    """The script, kind of program or plain words that a text is written in; None for marks, numbers and a lone letter."""
    found = {name: len(p.findall(text)) for name, p in SCRIPTS.items()}
    script = max(found, key=found.__getitem__)
    words = LETTERS.findall(text)
    if found[script] and found[script] * 4 >= sum(map(len, words)):
        return script
    if PROGRAM.search(text) and words:
        return "program"
    return "words" if len(words) > 1 or any(len(w) > 1 for w in words) else None


def without_comments(text: str) -> str:
    return COMMENT.sub(lambda m: m.group(1) or " ", text)


def query_in(text: str) -> str | None:
    """The query of a text without comments: from its first line, or after a lead-in, that begins like one."""
    body = text.strip()
    if body[:1] in "\"'`" and (unwrapped := body[1:].lstrip()) and QUERY.match(unwrapped):
        return unwrapped.rstrip().removesuffix(body[0])
    if QUERY.match(body):
        return body
    for m in START.finditer(text):
        rest = text[m.end() :]
        if QUERY.match(rest):
            return rest
    return None


def stops_early(query: str) -> bool:
    """Whether a query ends before it can be complete.

    The stack holds open brackets and CASEs.  At the end it must be empty, the last token must not call for more, every
    BETWEEN needs its AND, ORDER and GROUP their BY, JOIN its table, SELECT a FROM if it names columns of aliases, WITH a SELECT.
    """
    stack: list[str] = []
    between = 0
    last, last_word, words = "", "", 0
    seen_select = seen_from = qualified = False
    aliases: set[str] = set()
    used: set[str] = set()
    before = ["", ""]
    for m in TOKEN.finditer(query):
        t = m.group()
        c = t[0]
        if c in "'\"`[" and (len(t) == 1 or not t.endswith("]" if c == "[" else c)):
            return True
        w = t.lower() if c.isalpha() or c == "_" else t
        if t == "(":
            stack.append("(")
        elif t == ")":
            if not stack or stack[-1] != "(":
                if stack and stack[-1] == "case":
                    return True
            else:
                stack.pop()
        elif w == "case":
            stack.append("case")
        elif w == "end" and stack and stack[-1] == "case":
            stack.pop()
        elif w == "between":
            between += 1
        elif w == "and" and between:
            between -= 1
        elif w == "select":
            seen_select = True
        elif w == "from":
            seen_from = True
        elif t == ".":
            if re.fullmatch(r"[\w]+", last_word):
                used.add(last_word)
            qualified = True
        if before[1] in ("from", "join", "as") or (before[0] in ("from", "join") and w not in KEYWORDS):
            aliases.add(w.strip("\"`[]"))
        if t != ".":
            last_word = w.strip("\"`[]")
        before = [before[1], w]
        last = w
        words += 1
    last = last if last != ";" else before[0]
    if stack or between:
        return True
    if last in SIGNS_NEED_MORE or last in NEEDS_MORE:
        return True
    if not seen_select and re.match(r"\(*\s*with\b", query, re.I):
        return True
    if seen_select and not seen_from and qualified:
        return True
    if seen_from and used - aliases and re.fullmatch(r"(?:t\d+)", next(iter(sorted(used - aliases)))):
        return True  # an alias is used that the query never came to declare
    if last == "*" and before[0] not in ("select", "distinct", "all", ",", ".", "("):
        return True
    return False


def defect_of(question: str | None, answer: str | None, error: str | None = None) -> str | None:
    """The first defect that applies, or None for an answer that holds a query (which may be wrong).

    ``error`` is what the engine said of the query, if anything.  Marks and numbers that are in no language are no case.
    """
    if answer is None:
        return "empty"
    body, frames = (answer, []) if PLAIN.match(answer) else unwrap(answer)
    plain = MARKS.sub("", body)
    if not plain or PLACEHOLDER.fullmatch(plain):
        return "empty"
    code = without_comments(body) if "--" in body or "/*" in body else body
    query = query_in(code)
    if query is None and ("--" in body or "/*" in body):
        if (said := query_in(MARKS.sub(" ", body))) is not None and not WORD.search(code):
            query = said if " from " in said.lower() else None
    if query is not None:
        if speaks(query):
            return "refusal"
        return "truncated" if frames or (error and INCOMPLETE.search(error)) or stops_early(query) else None
    spoken = re.sub(r"--+|/\*+|\*+/", " ", body)
    if copies_question(question, spoken):
        return "refusal" if refuses_beside(spoken, question) else "copied_question"
    if any(p.search(spoken) for p in REFUSALS):
        return "refusal"
    return "other_language" if tongue(spoken) else None


#: An answer that begins like a query and has no mark of wrapping: nothing to unwrap.
PLAIN = re.compile(r"\s*\(?(?:select|with)\b(?:(?!```|~~~|</?[a-z]+>)[\s\S])*\Z", re.I)
INCOMPLETE = re.compile(r"\bincomplete input\b", re.I)  # fixed value: the message of SQLite for a statement that stops early


def refuses_beside(spoken: str, question: str | None) -> bool:
    """A refusal that merely repeats the question: it declines in words that the question does not have."""
    return any((m := p.search(spoken)) and (question is None or m.group().lower() not in question.lower()) for p in REFUSALS)


STRING = re.compile(r"'((?:[^']|'')*)'|\"([^\"]*)\"")


def speaks(query: str) -> bool:
    """A query that only selects a sentence which declines: SELECT 'I cannot answer ...'."""
    if re.search(r"\bfrom\b", STRING.sub(" ", query), re.I):
        return False
    return any(p.search((a or b).replace("''", "'")) for a, b in STRING.findall(query) for p in REFUSALS)


@F.pandas_udf(T.StringType())
def defect_udf(question: pd.Series, answer: pd.Series, error: pd.Series) -> pd.Series:
    none = lambda x: None if x is None or x != x else x
    return pd.Series([defect_of(none(q), none(a), none(e)) for q, a, e in zip(question, answer, error)], dtype=object)


def defective(rows: DataFrame, id_col: str, question_col: str, answer_col: str, error_col: str | None = None) -> DataFrame:
    """(id, defect) of the defective answers.  A null question copies nothing; a null answer is empty; repeated rows are each judged."""
    error = F.col(error_col) if error_col else F.lit(None).cast("string")
    return rows.select(F.col(id_col), defect_udf(F.col(question_col), F.col(answer_col), error).alias("defect")).where("defect is not null")
