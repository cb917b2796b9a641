"""Per-document text quality statistics and structure.

Method: a text is cut into stretches of lines of like form.  Of each stretch the distribution of word classes
(function words of its language, other words, numbers, marks ...) and of character classes is compared with structural
profiles - prose of several languages, lists, tables, kinds of junk, code - by Jensen-Shannon divergence, and the
nearest profile gives the stretch its structure.  Its language is the one whose own distribution of function words
diverges least from the stretch's.  Basic counts stand beside.  A text counts as the structure most of its characters
belong to.

The structural profiles that everything starts from are set by hand.  The prose profiles of the languages, and how often each
uses its function words, are fitted to the prose of all the very documents, in a pass of their own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = ("function", "word", "odd", "number", "stop", "pause", "symbol", "link", "mark", "again")
CHARS = ("vowel", "consonant", "rare", "upper", "digit", "space", "stop", "pause", "symbol", "letter", "sign")

# Structural profiles: (structure, word classes, character classes), in parts of a whole; set by hand from what the
# structures are made of, prose with the share of function words of each language (the lists hold the frequent half).
_PROSE_CHARS = dict(vowel=0.30, consonant=0.42, rare=0.05, upper=0.02, digit=0.004, space=0.175, stop=0.012, pause=0.012, symbol=0.002, letter=0.004, sign=0.001)
_LIST_CHARS = dict(vowel=0.30, consonant=0.45, rare=0.05, upper=0.01, digit=0.01, space=0.14, stop=0.003, pause=0.02, symbol=0.02, letter=0.003, sign=0.004)


def _chars(base: dict[str, float], **change: float) -> dict[str, float]:
    return {**base, **change}


PROFILES: list[tuple[str, dict[str, float], dict[str, float]]] = [
    ("prose", dict(function=0.46, word=0.43, stop=0.06, pause=0.04, number=0.01), _PROSE_CHARS),  # English
    ("prose", dict(function=0.38, word=0.50, stop=0.06, pause=0.05, number=0.01), _chars(_PROSE_CHARS, letter=0.015, upper=0.035)),  # German
    ("prose", dict(function=0.42, word=0.46, stop=0.06, pause=0.05, number=0.01), _chars(_PROSE_CHARS, letter=0.03)),  # Spanish, French
    ("prose", dict(function=0.28, word=0.58, stop=0.07, pause=0.06, number=0.01), _PROSE_CHARS),  # terse
    ("prose", dict(function=0.12, word=0.66, stop=0.12, pause=0.09, number=0.01), _chars(_PROSE_CHARS, stop=0.03, upper=0.03)),  # other languages
    ("prose", dict(function=0.10, word=0.50, stop=0.32, pause=0.08), _chars(_PROSE_CHARS, stop=0.10, upper=0.10, space=0.08)),  # a short answer
    ("prose", dict(function=0.04, word=0.80, stop=0.10, pause=0.06), dict(letter=0.76, upper=0.03, space=0.16, stop=0.03, pause=0.02)),  # other scripts
    ("prose", dict(function=0.02, word=0.69, stop=0.08, pause=0.21), _chars(_PROSE_CHARS, pause=0.05, stop=0.018, upper=0.02)),  # short instructions
    ("code", dict(function=0.05, word=0.40, odd=0.04, number=0.05, symbol=0.15, pause=0.29, stop=0.02), dict(vowel=0.21, consonant=0.36, rare=0.05, upper=0.03, digit=0.03, space=0.18, stop=0.02, pause=0.08, symbol=0.04)),
    ("code", dict(function=0.05, word=0.45, odd=0.10, symbol=0.25, pause=0.12, stop=0.03), dict(vowel=0.23, consonant=0.40, rare=0.05, upper=0.02, digit=0.02, space=0.16, stop=0.02, pause=0.03, symbol=0.07)),  # commands
    ("code", dict(function=0.06, word=0.62, number=0.04, symbol=0.10, pause=0.18), dict(vowel=0.18, consonant=0.27, rare=0.04, upper=0.20, digit=0.02, space=0.20, pause=0.05, symbol=0.04)),  # queries
    ("list", dict(function=0.02, word=0.68, mark=0.28, number=0.01, pause=0.01), _LIST_CHARS),
    ("list", dict(function=0.01, word=0.50, mark=0.30, number=0.10, pause=0.09), _chars(_LIST_CHARS, digit=0.03, pause=0.06, symbol=0.04)),
    ("list", dict(function=0.02, word=0.97, pause=0.01), _chars(_LIST_CHARS, symbol=0.0, space=0.15)),
    ("list", dict(function=0.02, word=0.72, pause=0.26), _chars(_LIST_CHARS, pause=0.06, symbol=0.0)),
    ("list", dict(link=0.97, mark=0.03), dict(vowel=0.26, consonant=0.40, rare=0.05, digit=0.06, upper=0.01, stop=0.05, symbol=0.12, pause=0.05)),
    ("list", dict(link=0.50, mark=0.50), dict(vowel=0.26, consonant=0.40, rare=0.05, digit=0.06, upper=0.01, stop=0.05, symbol=0.12, pause=0.05)),
    ("table", dict(word=0.25, number=0.35, mark=0.40), _chars(_LIST_CHARS, digit=0.18, space=0.20, symbol=0.12, stop=0.03, vowel=0.18, consonant=0.27)),
    ("table", dict(word=0.40, number=0.25, mark=0.30, pause=0.05), _chars(_LIST_CHARS, digit=0.12, space=0.40, symbol=0.02, vowel=0.16, consonant=0.22)),
    ("table", dict(word=0.30, number=0.30, pause=0.10, mark=0.30), _chars(_LIST_CHARS, digit=0.22, space=0.06, pause=0.14, vowel=0.20, consonant=0.28, stop=0.04)),
    ("table", dict(mark=0.60, symbol=0.40), dict(symbol=0.80, space=0.20)),
    ("junk", dict(again=0.90, stop=0.05, symbol=0.05), _LIST_CHARS),  # spam
    ("junk", dict(again=0.85, stop=0.15), dict(upper=0.50, space=0.20, stop=0.10, vowel=0.08, consonant=0.12)),
    ("junk", dict(odd=0.60, word=0.25, pause=0.10, function=0.05), dict(vowel=0.16, consonant=0.40, rare=0.25, space=0.14, pause=0.05)),  # random letters
    ("junk", dict(odd=0.45, word=0.35, stop=0.20), dict(vowel=0.25, consonant=0.15, rare=0.10, digit=0.20, space=0.15, stop=0.15)),  # filler
    ("junk", dict(symbol=0.45, word=0.40, odd=0.15), dict(stop=0.42, vowel=0.12, consonant=0.14, rare=0.05, digit=0.09, space=0.18)),
    ("junk", dict(symbol=0.85, stop=0.10, pause=0.05), dict(symbol=0.80, stop=0.08, space=0.07, pause=0.05)),  # noise of signs
    ("junk", dict(odd=0.95, symbol=0.05), dict(vowel=0.08, consonant=0.25, rare=0.12, upper=0.38, digit=0.15, symbol=0.02)),  # encoded bytes
    ("junk", dict(odd=0.55, number=0.35, word=0.10), dict(vowel=0.12, consonant=0.13, digit=0.42, space=0.33)),  # hexadecimal
    ("junk", dict(odd=0.60, symbol=0.35, word=0.05), dict(letter=0.40, sign=0.40, space=0.12, rare=0.08)),  # broken encoding
    ("junk", dict(word=0.60, symbol=0.40), _chars(_LIST_CHARS, upper=0.12, sign=0.06, symbol=0.04, space=0.20)),  # menu
    ("junk", dict(mark=0.25, function=0.06, word=0.30, number=0.06, pause=0.25, symbol=0.04, odd=0.04), _chars(_LIST_CHARS, digit=0.03, upper=0.05, pause=0.08, space=0.20)),  # stack trace
    ("junk", dict(number=0.30, odd=0.15, word=0.25, symbol=0.20, pause=0.10), _chars(_LIST_CHARS, digit=0.35, upper=0.06, symbol=0.09, pause=0.07, vowel=0.12, consonant=0.20, space=0.10)),  # log
]

_TOKENS = re.compile(  # a link, number, word, stop, pause (a dash before a blank is one), or other signs, in this order
    r"(?:https?://|www\.)[^\s<>]+|[-+]?\d[\d.,:/%-]*(?!\w)|\w+(?:['’-]\w+)*|[.!?…¿¡。！？]+|[,;:()\"“”„«'’‘\[\]、，–—]|-\s|[^\s\w]+"
)
_NUMBER = re.compile(r"[-+]?\d[\d.,:/%-]*\Z")
_STOPS, _PAUSES = frozenset(".!?…¿¡。！？"), frozenset(",;:()\"“”„«'’‘[]、，–—")
# What is left of a text whose bytes were decoded wrongly: lead bytes as letters with what follows, lone marks.
_BROKEN = re.compile(r"Ã[\u0080-\u00bf\u0152-\u017e\u02c6\u02dc\u2013-\u203a\u20ac\u2122]|Â[\s\u00a0-\u00bf]|â€.?|\ufffd|[¿¡](?=\s|$)")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\Z")
_VOWEL = re.compile(r"[aeiouyà-æè-ïò-öø-üœ]", re.I)
_MIXED = re.compile(r"[a-zà-ÿ][A-ZÀ-Þ]")
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}", re.I)
_BULLET = re.compile(r"\s*(?:[-*+•·‣▪–—]\s+|\(?\d{1,4}[.)]\s+|\(?[A-Za-z][.)]\s+|\[[ xX]?\]\s+)")
_BULLETS = re.compile(r"^[^\S\n]*(?:[-*+•·‣▪–—]\s+|\(?\d{1,4}[.)]\s+|\(?[A-Za-z][.)]\s+|\[[ xX]?\]\s+)", re.M)
_BORDER = re.compile(r"[|+][-=+|: ]{3,}\Z|[-=_*]{4,}\Z")
_GAP = re.compile(r"\S(?:\t|\s{2,})(?=\S)")
_STAMP = re.compile(r"\s*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
_LINK = re.compile(r"(?:https?://|www\.)\S+")
_FENCED = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)|<pre\b.*?(?:</pre>|\Z)", re.S | re.M | re.I)
_ENDS = re.compile(r"(?<![\s.!?:;…])[.!?:;…。！？][\"'”’)\]]*\s*$")  # one mark, right after a word
_TRIPLE = re.compile(r"([^\W\d_])\1\1", re.I)
_SENTENCE = re.compile(r"\s*[\"'“«(¿¡]?[^\W\d_a-z].*[.!?…。！？][\"'”’»)\]]*\s*\Z", re.S)
_INDENT = re.compile(r"(?: {4}|\t)\s*\S")
_STATEMENT = re.compile(r"(?=.{4,120}$)(?:  |\t)\s*(?=.*[A-Za-z_]{2})(?:.*(?:\w\(|[;{}]\s*$|\w = \w|=> )|(?:\$ |//|# |\}|export |rm |cat |cd |def |return\b|if |for |else\b|let |const |import |select |left join |order by |group by ).*[\w;:)}\]]$)", re.I)
_TRACE = re.compile(r"\s*(?:Traceback \(most recent|File \"[^\"]+\", line \d+|at [\w.$<>]+\([^)]*\)|Caused by: |(?:[\w.]+\.)?[A-Z]\w+(?:Error|Exception)\b)")
_SYNTAX = re.compile(  # a line that is a statement of a program, wherever it begins
    r"\s*(?:(?:async )?def \w+\(.*|class \w+[(:{].*|(?:export )?function\b.*[{(].*|#include\b.*|import [\w.{*].*|from [\w.]+ import .*|(?:const|let|var) \w+ ?=.*|return\b.*[\w;)\]]|(?:for|if|while|elif|switch)\b.*[:{]"
    r"|(?:else|try|finally)\s*[:{]|\}[\w;,)\s]*|(?:int|void|char|double|public|static)\b.*[{;]|\w[\w.]*\([^.!?]*\);?|\w[\w.]*\(.*\);|\w[\w.\[\]]* [-+*/]?= .+|\$ \w.*"
    r"|(?:SELECT|FROM|WHERE|GROUP BY|ORDER BY|INSERT INTO|UPDATE|(?:LEFT |INNER )?JOIN|HAVING|LIMIT)\b.*)\s*\Z"
)
_CODEISH = re.compile(r"[{};=()<>$]|^\s*(?:#|//|--)|\b(?:def|return|select|from|export|import|rm|for|if|let|const|var|end|fi|done|else|order by|join|where)\b", re.I)


def _form(line: str, table_cells: int) -> str:
    """The outer form of a line; lines of one form that follow one another are one stretch."""
    if _BORDER.match(line.strip()) or line.count("|") >= 2:
        return "pipe"
    if "//" in line or "www." in line:
        rest, links = _LINK.subn(" ", line)
        if links and len(rest.split()) <= 3:
            return "link"
    if _BULLET.match(line):
        return "bullet"
    if _STAMP.match(line):
        return "stamp"
    if len(_GAP.findall(line)) >= 2 and not _ENDS.search(line):
        return "gap"
    if table_cells >= 3:
        return "cells"
    if _TRACE.match(line):
        return "trace"
    if _INDENT.match(line) and _CODEISH.search(line) or _STATEMENT.match(line) or _SYNTAX.match(line):
        return "code"
    return "plain"


def _cells(line: str) -> int:
    """Cells of a line of separated values: several short ones, one of them a number or none with a blank after the comma."""
    for mark in (",", ";", "\t"):
        parts = line.split(mark)
        if len(parts) >= 3 and all(len(p) <= 40 for p in parts) and not any(p.startswith(" ") for p in parts[1:]) and all(p.strip() for p in parts):
            return len(parts)
    return 0


def stretches(text: str) -> Iterator[tuple[str, str]]:
    """(form, text) of the stretches of a text, without blank lines; code in fences is of form ``fence``."""
    at = 0
    for m in [*_FENCED.finditer(text), None]:
        end = len(text) if m is None else m.start()
        form, held = "", []
        for line in text[at:end].split("\n"):
            if not line.strip():
                if held:
                    yield form, "\n".join(held)
                form, held = "", []
                continue
            own = _form(line, _cells(line))
            joins = held and own == form and not (own == "plain" and (_ENDS.search(held[-1])))
            if not joins:
                if held:
                    yield form, "\n".join(held)
                form, held = own, []
            held.append(line)
        if held:
            yield form, "\n".join(held)
        if m is not None:
            yield "fence", m.group()
            at = m.end()


def _odd(w: str) -> bool:
    """No word of any language: digits inside, no vowel, capitals inside, or letters nobody could say."""
    if not _LETTERS.match(w):
        return True
    if not w.isascii():
        return len(w) > 24 and " " not in w and all(ord(c) < 0x250 for c in w)
    if len(w) > 28 or _MIXED.search(w) or _CLUSTER.search(w) or _TRIPLE.search(w):
        return True
    return len(w) > 1 and not _VOWEL.search(w) and not w.isupper()


class _Classes(dict):
    """Tokens seen: a word in lower case, or the place of its class among WORDS."""

    def __missing__(self, token: str) -> str | int:
        if len(self) > 200_000:
            self.clear()
        first = token[0]
        if token.startswith(("http://", "https://", "www.")):
            kind: str | int = WORDS.index("link")
        elif _NUMBER.match(token):
            kind = WORDS.index("number")
        elif first.isalnum() or first == "_":
            kind = WORDS.index("odd") if _odd(token) else token.lower()
        elif first in _STOPS:
            kind = WORDS.index("stop" if len(token) <= 3 else "symbol")
        else:
            kind = WORDS.index("pause" if first in _PAUSES or (first == "-" and token[-1].isspace()) else "symbol")
        self[token] = kind
        return kind


_CLASS_OF = _Classes()


@dataclass
class Languages:
    """Function words by language, and how often prose of the language uses each (parts of all words)."""

    words: dict[str, frozenset[str]]
    used: dict[str, dict[str, float]] = field(default_factory=dict)
    of: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for lang, words in sorted(self.words.items()):
            for w in words:
                self.of[w] = (*self.of.get(w, ()), lang)
            self.used.setdefault(lang, {w: 0.45 / max(len(words), 1) for w in words})

    def nearest(self, counts: Counter[str], n: int) -> tuple[str, int]:
        """(language, its function words among the ``n`` words counted): of the languages with nearly as many as the one
        with most, the one whose distribution of function words (and of the rest) diverges least."""
        hits: dict[str, int] = {}
        found: list[tuple[str, int, tuple[str, ...]]] = []
        for w, k in counts.items():
            langs = self.of.get(w)
            if langs:
                found.append((w, k, langs))
                for lang in langs:
                    hits[lang] = hits.get(lang, 0) + k
        if not hits:
            return "", 0
        most = max(hits.values())
        close = [lang for lang in hits if 5 * hits[lang] >= 4 * most]
        if len(close) == 1:
            return close[0], hits[close[0]]
        best, least = "", math.inf
        for lang in sorted(close):
            used, d, covered = self.used[lang], 0.0, 0.0
            pairs = [(k / n, used.get(w, 0.0)) for w, k, langs in found if lang in langs]
            pairs.append((1 - hits[lang] / n, max(1.0 - sum(used.values()), 0.0)))
            for p, q in pairs:
                m = (p + q) / 2
                covered += q
                d += (p * math.log2(p / m) if p else 0.0) + (q * math.log2(q / m) if q else 0.0)
            d += 1.0 - covered  # function words that are not there
            if d < least - 1e-12:
                best, least = lang, d
        return best, hits[best]


def word_classes(text: str, form: str, languages: Languages) -> tuple[list[float], str, list[str]]:
    """Counts by word class, the language, and the words."""
    n = [0.0] * len(WORDS)
    odd = 0
    lines = text.count("\n") + 1
    if form == "bullet":  # the mark is counted as such
        text = _BULLETS.sub("", text)
    if not text.isascii():
        text, odd = _BROKEN.subn(" ", text)
    tokens = [_CLASS_OF[t] for t in _TOKENS.findall(text)]
    words = [t for t in tokens if t.__class__ is str]
    if len(words) < len(tokens):
        for kind, k in Counter([t for t in tokens if t.__class__ is int]).items():
            n[kind] += k
    n[_ODD] += odd
    if n[_ODD] == 1 and not odd and form == "plain" and 2 <= len(words) <= 12:  # one abbreviation in a short sentence is a word
        short = next(t for t in _TOKENS.findall(text) if _CLASS_OF[t] == _ODD)
        if len(short) <= 4 and short.isalpha():
            words.append(short.lower())
            n[_ODD] = 0.0
    odd = n[_ODD]
    counts = Counter(words)
    best, most = languages.nearest(counts, len(words))
    if len(words) >= 8 and form == "plain" and _repeats(words, counts, most):
        n[_AGAIN] = float(len(words))
    else:
        if form == "plain" and odd * 8 < len(words) and _SENTENCE.match(text):
            # A sentence of a language without a list: words of one or two letters are function words anywhere.
            most = max(most, sum(k for w, k in counts.items() if len(w) <= 2))
        n[_FUNCTION], n[_WORD_] = float(most), float(len(words) - most)
    if form in ("bullet", "link", "trace"):
        n[_MARK] = float(lines) * (3 if form == "trace" else 1)
    elif form == "pipe":
        n[_MARK] = text.count("|") + text.count("+") + 1.0
        n[_SYMBOL] = max(0.0, n[_SYMBOL] - n[_MARK])
    elif form == "gap":
        n[_MARK] = float(len(_GAP.findall(text)))
    elif form == "cells":
        n[_MARK] = n[_PAUSE] or float(lines)
        n[_PAUSE] = 0.0
    return n, best, words


_FUNCTION, _WORD_, _ODD, _PAUSE, _SYMBOL, _MARK, _AGAIN = (WORDS.index(c) for c in ("function", "word", "odd", "pause", "symbol", "mark", "again"))


def _repeats(words: list[str], counts: Counter[str], function: int) -> bool:
    """One phrase over and over: few different words among fifty on end, or, where function words are few (a sentence
    may be said twice), three words in a row that mostly came before."""
    parts = [words[i : i + 50] for i in range(0, len(words), 50)]
    if sum(len(set(p)) - 4 - len(p) / 25 for p in parts if len(p) >= 8) <= 0:
        return True
    if len(words) < 12 or 2 * len(counts) > len(words) or (5 * function > len(words) and 6 * len(counts) > len(words)):
        return False
    threes = list(zip(words, words[1:], words[2:]))
    return 5 * len(set(threes)) <= 3 * len(threes)


_VOWELS, _RARE = frozenset("aeiou"), frozenset("jqxzvwky")


def _char_kind(c: str) -> int:
    if c.isspace():
        k = "space"
    elif c.isascii():
        if c.isalpha():
            k = "upper" if c.isupper() else "vowel" if c in _VOWELS else "rare" if c in _RARE else "consonant"
        else:
            k = "digit" if c.isdigit() else "stop" if c in ".!?" else "pause" if c in ",;:()'\"-[]" else "symbol"
    else:
        k = "letter" if c.isalpha() else "sign"
    return CHARS.index(k)


_FIRST_KINDS = np.array([_char_kind(chr(i)) for i in range(0x2100)], np.uint8)


def char_classes(text: str) -> list[float]:
    at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not text.isascii() and (far := at >= len(_FIRST_KINDS)).any():
        values, where = np.unique(at[far], return_inverse=True)
        kinds = np.zeros(len(at), np.uint8)
        kinds[~far] = _FIRST_KINDS[at[~far]]
        kinds[far] = np.array([_char_kind(chr(x)) for x in values], np.uint8)[where]
    else:
        kinds = _FIRST_KINDS[at]
    return np.bincount(kinds, minlength=len(CHARS)).tolist()


def divergence(p: list[float], q: list[float]) -> float:
    """Jensen-Shannon divergence in bits of two distributions."""
    d = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        if a:
            d += a * math.log2(a / m)
        if b:
            d += b * math.log2(b / m)
    return d / 2


def _distribution(n: list[float]) -> list[float]:
    total = sum(n) or 1.0
    return [x / total for x in n]


@dataclass
class Profiles:
    """Structural profiles as rows of word classes and character classes, and the languages they go with."""

    languages: Languages
    kinds: list[str] = field(default_factory=lambda: [kind for kind, *_ in PROFILES])
    table: np.ndarray = field(default_factory=lambda: np.array([_distribution([w.get(c, 0.0) for c in WORDS]) + _distribution([c_.get(c, 0.0) for c in CHARS]) for _, w, c_ in PROFILES]))

    def nearest(self, forms: list[str], own: np.ndarray) -> list[str]:
        """The structure of each stretch: of the nearest profile by the sum of both divergences.  Lines that look like
        statements may be code or prose; what stands in fences is code, as its author says."""
        if not forms:
            return []
        entropy = (self.table * np.log2(self.table, where=self.table > 0, out=np.zeros_like(self.table))).sum(axis=1) / 2
        is_code, of_prose = (np.array([k == x for k in self.kinds]) for x in ("code", "prose"))
        out: list[str] = []
        for i in range(0, len(forms), 2000):
            middle = (own[i : i + 2000, None, :] + self.table) / 2  # both divergences at once: H(m) - (H(p) + H(q)) / 2, summed over both parts
            far = entropy - (middle * np.log2(middle, where=middle > 0, out=np.zeros_like(middle))).sum(axis=2)
            code_form = np.array([f == "code" for f in forms[i : i + 2000]])
            far = np.where(np.where(code_form[:, None], is_code | of_prose, ~is_code), far, np.inf)
            out += [self.kinds[k] for k in far.argmin(axis=1)]
        return ["code" if f == "fence" else k for f, k in zip(forms, out)]


def measure(part: str, form: str, languages: Languages) -> tuple[list[float], str, list[str]]:
    """Both distributions of a stretch on end, its language and words; of a fenced one nothing is measured."""
    if form == "fence":
        return [1.0] + [0.0] * (len(WORDS) + len(CHARS) - 1), "", []
    n, lang, words = word_classes(part, form, languages)
    return _distribution(n) + _distribution(char_classes(part)), lang, words


def fit_profiles(texts: Iterable[str | None], common_words: dict[str, Iterable[str]], least: int = 20) -> Profiles:
    """The profiles set by hand, and for every language with at least ``least`` stretches of eight or more words that
    are nearest to prose: their mean distributions as a further prose profile, and how often they use each of the
    language's function words."""
    profiles = hand_set(common_words)
    return _fitted(profiles, _prose(list(texts), profiles), least)


_UNIT = 2**40  # shares are added as whole numbers of this part, so the sum does not depend on the order


def hand_set(common_words: dict[str, Iterable[str]]) -> Profiles:
    return Profiles(Languages({lang: frozenset(words) for lang, words in common_words.items()}))


def _prose(texts: list[str | None], profiles: Profiles) -> Counter[tuple[str, str, str]]:
    """Of the stretches nearest to prose, by language: ``count``, ``words``, ``share`` sums by place, ``used`` by function word."""
    parts = [(form, part) for text in texts for form, part in stretches(_lines(text)) if form != "fence"]
    measured = [measure(part, form, profiles.languages) for form, part in parts]
    table = np.array([m[0] for m in measured])
    prose: dict[str, list[int]] = {}
    for i, (kind, (_, lang, words)) in enumerate(zip(profiles.nearest([form for form, _ in parts], table), measured)):
        if kind == "prose" and lang and len(words) >= 8:
            prose.setdefault(lang, []).append(i)
    out: Counter[tuple[str, str, str]] = Counter()
    for lang, which in prose.items():
        counts = Counter(chain.from_iterable(measured[i][2] for i in which))
        out[lang, "count", ""], out[lang, "words", ""] = len(which), counts.total()
        out.update({(lang, "share", str(i)): int(n) for i, n in enumerate(np.rint(table[which] * _UNIT).astype(np.int64).sum(axis=0)) if n})
        out.update({(lang, "used", w): counts[w] for w in profiles.languages.words[lang] & counts.keys()})
    return out


def _fitted(profiles: Profiles, sums: dict[tuple[str, str, str], int], least: int = 20) -> Profiles:
    languages = profiles.languages
    rows, used = [], {}
    for lang in sorted(languages.words):
        n = sums.get((lang, "count", ""), 0)
        if n and n >= least:
            rows.append(np.array([sums.get((lang, "share", str(i)), 0) / (n * _UNIT) for i in range(len(WORDS) + len(CHARS))]))
            used[lang] = {w: sums.get((lang, "used", w), 0) / sums[lang, "words", ""] for w in languages.words[lang]}
    table = np.vstack([profiles.table, *rows]) if rows else profiles.table
    return Profiles(Languages(languages.words, used), profiles.kinds + ["prose"] * len(rows), table)


def fit_documents(df: DataFrame, text: str, common_words: dict[str, list[str]]) -> Profiles:
    """:func:`fit_profiles` over all rows: sums per batch beside the scan, then per language and word; the driver gets one row of each."""
    profiles = hand_set(common_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: Counter[tuple[str, str, str]] = Counter()
            for at in range(0, batch.num_rows, 1000):
                sums.update(_prose(batch.column(0).slice(at, 1000).to_pylist(), profiles))
            if sums:
                yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in sums], pa.string()) for i in range(3)], pa.array(sums.values(), pa.int64())], ["lang", "what", "name", "n"])

    own = df.where(F.col(text).isNotNull()).select(F.col(text).cast("string")).mapInArrow(run, "lang string, what string, name string, n long")
    found = own.groupBy("lang", "what", "name").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n")).collect()
    return _fitted(profiles, {(r["lang"], r["what"], r["name"]): int(r["n"]) for r in found})


STRUCTURE = "language string, prose_chars long, list_chars long, table_chars long, junk_chars long, code_chars long, structure string"


def _lines(text: str | None) -> str:
    return (text or "").replace("\r\n", "\n").replace("\r", "\n")


def describe(texts: list[str | None], profiles: Profiles) -> list[tuple]:
    """Language, characters by structure and structure of every text."""
    parts = [(i, form, part) for i, text in enumerate(texts) if text for form, part in stretches(_lines(text))]
    measured = [measure(part, form, profiles.languages) for _, form, part in parts]
    kinds = profiles.nearest([form for _, form, _ in parts], np.array([m[0] for m in measured]))
    names = ("prose", "list", "table", "junk", "code")
    chars = [dict.fromkeys(names, 0) for _ in texts]
    tongues: list[dict[str, int]] = [{} for _ in texts]
    links: dict[int, list[str]] = {}
    for (i, form, part), kind, (_, lang, _) in zip(parts, kinds, measured):
        if form == "link" and part.count("\n") < 2:  # one or two links beside sentences go with them
            links.setdefault(i, []).append(part)
            continue
        chars[i][kind] += len(part)
        if kind == "prose" and lang:
            tongues[i][lang] = tongues[i].get(lang, 0) + len(part)
    for i, held in links.items():
        beside = chars[i]["prose"] or chars[i]["code"] or sum(part.count("\n") + 1 for part in held) < 2
        chars[i]["prose" if beside else "list"] += sum(map(len, held))
    out = []
    for c, tongue in zip(chars, tongues):
        best = max(c, key=lambda k: c[k]) if any(c.values()) else "empty"
        out.append((max(sorted(tongue), key=lambda k: tongue[k]) if tongue else None, *c.values(), best))
    return out


def text_statistics(text: Column, common_words: dict[str, list[str]]) -> dict[str, Column]:
    """The basic counts as Spark expressions: n_words, mean_word_length, symbol_ratio (of the characters that are not
    blank), lines_ending_in_punctuation (share of the lines that are not blank), common_word_share (in the language with
    the most).  Null and empty texts have 0 everywhere."""
    text = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "\r\n?", "\n")
    letters = "A-Za-zÀ-ÖØ-öø-ÿ"
    bare = F.trim(F.regexp_replace(text, f"[^{letters}]+", " "))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(bare), " "))
    n = F.size(words)
    dense = F.length(F.regexp_replace(text, r"[\s\x1c-\x1f\x85\p{Z}]", ""))
    symbols = F.length(F.regexp_replace(text, r"[\s\x1c-\x1f\x85\p{Z}\p{L}\p{N}]", ""))
    lines = F.regexp_count(text, F.lit(r"(?m)^.*\S.*$"))
    ended = F.regexp_count(text, F.lit(r"(?m)[.!?:;,…][\"'”’)]*[^\S\n]*$"))
    within = lambda own: F.size(F.filter(words, lambda w: w.isin(list(own))))
    share = [within(own) for own in common_words.values() if own]
    best = F.greatest(*share) if len(share) > 1 else share[0] if share else F.lit(0)
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "n_words": n.cast("long"), "mean_word_length": part(F.length(F.regexp_replace(bare, " ", "")), n), "symbol_ratio": part(symbols, dense),
        "lines_ending_in_punctuation": part(ended, lines), "common_word_share": part(best, n),
    }


def text_quality(df: DataFrame, key: str, text: str, common_words: dict[str, list[str]], counts: bool = True, structure: bool = True) -> DataFrame:
    """``key`` and, for every row: with ``counts`` those of :func:`text_statistics`; with ``structure`` the language (of
    most prose), the characters of each structure, and the structure with most.

    The whole text is read.  Null and empty texts have counts and shares 0, no language and structure ``empty``.
    Rows are described one by one: repeated rows and further columns change nothing; an empty table gives no rows.
    Two passes beside the scan, the first to fit; counts are Spark expressions, only the structure is found in Python.
    ``common_words``: the frequent words of each language, a fixed list.

    Language profiles are fitted to all rows (:func:`fit_documents`); the driver gets one row per language and function word.
    """
    statistics = text_statistics(F.col(text), common_words) if counts else {}
    rows = df.select(F.col(key), *[c.alias(n) for n, c in statistics.items()], F.col(text).cast("string").alias("_text"))
    if not structure:
        return rows.drop("_text")
    profiles = fit_documents(df, text, common_words)
    names = [x.split()[0] for x in STRUCTURE.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in STRUCTURE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                columns = zip(*describe(piece.column(piece.num_columns - 1).to_pylist(), profiles))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *[pa.array(c, k) for c, k in zip(columns, kinds)]], [*piece.schema.names[:-1], *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, {STRUCTURE}")
