"""Sentence boundaries across languages and scripts.

A document is read line by line, as a line break always ends a sentence. In a line, every mark that could end a
sentence is a candidate. Most are settled by form (marks of scripts without abbreviations, ``!`` and ``?``, marks
inside numbers, addresses and quotations). A period is ambiguous, and is settled by evidence on the words around it:

* document-centred: unambiguous occurrences elsewhere in the same document tell whether a word is a proper name (it is
  capitalised inside sentences), an ordinary word (it occurs in lower case) or an abbreviation (it is followed by a
  period inside a sentence);
* corpus fallback: the same counts over all documents, for words the document says nothing about. The ``HELD_WORDS``
  commonest words go to every task; a document that asks for another one is settled in a second round, with the counts
  of its own words joined to it, so that no word is without its counts;
* short lists of common abbreviations, by what follows them, for words without evidence. Whether a listed word is an
  abbreviation at all is decided by how often it is written with and without a period, where it occurs.

The counts of all documents hold those of each, so a document's own words are counted only once the corpus has some.

Defined cases: null and blank texts have no sentences; a quotation or bracket that is not closed on its line is taken
for ordinary text; positions are code points of the text as given, end exclusive, without white space at either end.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, enough_tasks

#: Words whose counts go to every task (some 15 MB); those of other words are joined to the documents that need them.
HELD_WORDS = 100_000
#: Characters counted at a time.
STRETCH = 1_000_000

# Abbreviations in lower case without their last period.
# Followed by a name, or by what they stand before: never the end of a sentence.
TITLES = frozenset("""
mr mrs ms dr prof st rev hon gen col maj capt lt sgt sr sra srta dra d dña mme mlle mgr me m mm hr fr frau herr dipl ing jr
डॉ श्री श्रीमती د أ م г ул д тов им проф
""".split())
# Followed by a number or a word they belong to.
LEADS = frozenset("""
no nos nr num núm p pp pág págs s art fig figs vol vols abt ca approx est vs cf e.g i.e z.b d.h u.a bzw bspw vgl inkl exkl zzgl
evtl ggf max min tel av avda c bd ch ver rev ed eds str bsp sog z d u i.d.r o.ä v.a p.ej aprox incl excl env réf
""".split())
# May stand at the end of a sentence.
ENDS = frozenset("""
etc co inc ltd corp llc bros a.m p.m u.s u.k u.s.a e.u usw mwst gmbh kg st rd ave blvd dept dpt apt jan feb mar apr jun jul
aug sep sept oct nov dec min sec hrs hr ft lb oz cm mm km kg ph.d m.d b.a u.ä usf ud uds ee.uu cía s.a s.l cie ltda c.v a.c d.c
""".split())
# Ordinary words that a period may well follow, though a title or lead is spelled alike.
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember".split()

WHITE = r"[\s​⁠﻿]"
MARKS = "。！？!?؟।॥۔…｡.．‼⁇⁈⁉።᙮"
HARD = frozenset("。！？!?؟।॥۔｡‼⁇⁈⁉።᙮")
OPEN = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "‚": "‘’", "(": ")", "（": "）", "[": "]", "【": "】", "〈": "〉", "《": "》", "»": "«", "‘": "’"}
BRACKETS = frozenset("([（【")
CLOSE = "\"'”’»›」』)）]】〉》“"
EMOJI = regex.compile(r"(?:(?:\p{Extended_Pictographic}|\p{Regional_Indicator}{2})(?:[️‍\U0001f3fb-\U0001f3ff⃣]|‍\p{Extended_Pictographic})*)+")
EMOTICON = regex.compile(r"(?:[:;=8xX][-o'^]?[)(\]\[DdPpOo3/\\|*]+|<3+|\^_*\^|[)(][-']?[:;=]|[xX]D+|¯\\_\(ツ\)_/¯)(?![\p{L}\p{N}])")
TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}.'’\-]*")
WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’\-]*")
LINES = regex.compile(r"[^\r\n\v\f\x1c-\x1e\x85  ]+")
ADDRESS = regex.compile(
    r"(?:[Hh]ttps?://|[Ww]{3}\.)\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
    # Bare domains and file names: only endings in lower case that are no words of their own.
    r"|\b[\w-]+(?:\.[\w-]+)*\.(?:com|org|net|io|html?|php|example|edu|gov|info|fr|uk|cn|jp|ru|pdf|txt|csv|zip|exe|py|js)\b(?:/[\w./?=&%#+-]*)?"
    r"|\b[\w-]+(?:\.[\w-]+)+/[\w./?=&%#+-]*"
)
THAI = regex.compile(r"(?<=\p{Thai})[  　​⁠]*[  　][  　​⁠]*(?=\p{Thai})")
MARK = regex.compile("[" + regex.escape(MARKS) + "]")
OPENER = regex.compile("[\"'" + regex.escape("".join(OPEN)) + "]")
INNER = regex.compile(r"[\w/:]\.[\w/]|[:.]//")
#: "3. " or "3) " at the start of a line, where no digit follows.
LIST_NUMBER = regex.compile(rf"{WHITE}*\d{{1,3}}[.．、)]{WHITE}*(?=[^\s\d])")
QUOTE_END = regex.compile(r"'(?![\p{L}\p{N}])")
CASED = regex.compile(r"\p{Lu}")
LOWER = regex.compile(r"\p{Ll}")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
BLANK = frozenset(" \t             ​  ⁠　﻿\x1f")


PARTS = regex.compile("(" + TOKEN.pattern + ")")
BREAK = regex.compile(r"[\r\n\v\f\x1c-\x1e\x85\u2028\u2029]")
#: The first word of a line, or after a mark that always ends a sentence.
FRESH = regex.compile(r"(?:^|[!?\r\n\v\f\x1c-\x1e\x85\u2028\u2029])[" + regex.escape("".join(sorted(BLANK)) + CLOSE + "¿¡«„") + "]*+(" + WORD.pattern + ")")
THAI_LETTER = regex.compile(r"\p{Thai}")
PAIRED = {c: regex.compile("[" + regex.escape(c + OPEN[c]) + "]") for c in OPEN}
QUERY = regex.compile(r"[\w=&/?]")
DOTTED = regex.compile(r"(?:\p{L}\.)+\p{L}")
LAST_TOKEN = regex.compile(r"[\p{L}\p{M}.]*$")

#: Counts on words in lower case: ``lower`` (inside a sentence, lower case), ``name`` (inside a sentence, capitalised),
#: ``start`` (at an unambiguous start), ``short`` (followed by a period inside a sentence), ``plain`` and ``dot``
#: (without and with a period), ``pause`` and ``stop`` (before an ellipsis with the sentence going on, or ending).
KINDS = ("lower", "name", "start", "short", "plain", "dot", "pause", "stop")
LOWER_CASE, NAME, START, SHORT, PLAIN, DOT, PAUSE, STOP = range(len(KINDS))


def _is_cased(text: str) -> bool:
    """Whether the text uses capitals, so that a word in lower case after a period says something."""
    return CASED.search(text) is not None


class _Gaps(dict):
    """What stands between two tokens: 0 white space, 1 a mark that ends sentences, 2 a line break, 3 anything else."""

    def __missing__(self, gap: str) -> int:
        kind = 2 if BREAK.search(gap) else 1 if any(c in "!?。！？" for c in gap) and not any(c in CLOSE for c in gap) else 0 if not gap.strip("".join(BLANK)) else 3
        if len(self) < 10_000:
            self[gap] = kind
        return kind


@dataclass(eq=False)
class Evidence:
    """Unambiguous occurrences of words: first as tokens with what stands before them, then as counts of each word."""

    tokens: Counter = field(default_factory=Counter)  # (gap, whether a period is before it, token)
    periods: Counter = field(default_factory=Counter)  # (token with a period, first letter of the token after it)
    fresh: Counter = field(default_factory=Counter)
    gaps: _Gaps = field(default_factory=_Gaps)

    def __len__(self) -> int:
        return len(self.tokens) + len(self.periods) + len(self.fresh)

    def add(self, text: str) -> None:
        """Count ``text``; texts with capitals and without them must be added apart."""
        if not _is_cased(text):
            # Without capitals only starts after marks that are always ends say something.
            self.fresh.update(FRESH.findall(text))
            return
        parts = PARTS.split(text)
        tokens = parts[1::2]
        if not tokens:
            return
        kinds = list(map(self.gaps.__getitem__, parts[0:-1:2]))
        kinds[0] = 2
        dots = [t[-1] == "." for t in tokens]
        self.tokens.update(zip(kinds, [False, *dots], tokens))
        self.periods.update((tokens[i], tokens[i + 1][0]) for i in range(len(tokens) - 1) if dots[i] and kinds[i + 1] == 0)

    def counts(self) -> dict[str, list[int]]:
        """The counts of each word, in the order of ``KINDS``."""
        found: dict[str, list[int]] = {}

        def count(word: str, kind: int, n: int) -> None:
            if word not in found:
                found[word] = [0] * len(KINDS)
            found[word][kind] += n

        for (gap, after_dot, raw), n in self.tokens.items():
            word = raw.rstrip(".'’-")
            low, first = word.lower(), word[:1]
            if first.isalpha():
                if gap in (1, 2):
                    count(low, START, n)
                elif gap == 0 and not after_dot:
                    count(low, LOWER_CASE if first.islower() else NAME, n)
            count(low, DOT if raw[-1] == "." else PLAIN, n)
        for (raw, first), n in self.periods.items():
            if first.isalpha():
                base = raw.rstrip(".").lower()
                if raw.endswith(".."):
                    count(base, PAUSE if first.islower() else STOP, n)
                elif first.islower():
                    count(base, SHORT, n)
        for word, n in self.fresh.items():
            count(word.lower(), START, n)
        return found


def _stretches(text: str) -> Iterator[str]:
    """A long text in stretches that end at line breaks, or at white space in a line that is longer than one."""
    at = 0
    while len(text) - at > STRETCH:
        end = next((m.end() for m in BREAK.finditer(text, at + STRETCH // 2, at + STRETCH)), 0) or next((k for k in range(at + STRETCH, at + STRETCH // 2, -1) if text[k].isspace()), at + STRETCH)
        yield text[at:end]
        at = end
    yield text[at:]


def evidence(texts: Iterator[str], into: Evidence) -> None:
    """Count many texts, joined to stretches of bounded length; a line break sets them apart."""
    held: dict[bool, list[str]] = {True: [], False: []}
    size = 0
    for text in texts:
        held[_is_cased(text)].append(text)
        size += len(text)
        if size > STRETCH:
            for parts in held.values():
                for part in _stretches("\n".join(parts)):
                    into.add(part)
                parts.clear()
            size = 0
    for parts in held.values():
        for part in _stretches("\n".join(parts)):
            into.add(part)


NONE = (0,) * len(KINDS)


@dataclass(eq=False)
class Splitter:
    """Splits texts with what the corpus tells of words: ``corpus`` has the counts of each word, ``more`` those of words
    of the current text. If not ``complete``, ``asked`` tells whether a word without counts was asked for."""

    corpus: dict[str, Any] = field(default_factory=dict)
    complete: bool = True
    more: dict[str, Any] = field(default_factory=dict)
    asked: bool = False
    text: str = ""

    def _known(self, low: str) -> Any:
        found = self.corpus.get(low) or self.more.get(low)
        if found is None and not self.complete:
            self.asked = True
            return self._own().get(low, NONE)
        return found or NONE

    def _own(self) -> dict[str, list[int]]:
        if self.own is None:
            held = Evidence()
            evidence([self.text], held)
            self.own = held.counts()
        return self.own

    def _count(self, kind: int, word: str) -> int:
        all_of = self._known(word)[kind]
        return all_of + 4 * self._own().get(word, NONE)[kind] if all_of else 0

    def _ordinary(self, word: str) -> bool:
        """Whether a capitalised word would be in lower case inside a sentence (as opposed to a name)."""
        low = word.lower()
        if word == "I" or low in TITLES:
            return True
        known = self._known(low)
        if known[LOWER_CASE] or known[NAME]:
            own = self._own().get(low, NONE)
            if own[LOWER_CASE] or own[NAME]:
                return own[LOWER_CASE] >= own[NAME]
        return known[START] > 0 and known[START] >= known[NAME] or known[LOWER_CASE] > known[NAME]

    def _starter(self, word: str) -> bool:
        """Whether a word without capitals begins sentences rather than going on with them."""
        low = word.lower()
        start = self._count(START, low)
        return start > 0 and start * 3 >= self._count(LOWER_CASE, low)

    def _listed(self, low: str, words: frozenset[str]) -> bool:
        """Whether a word is a listed abbreviation: evidence says so, or there is none and the list does. A single
        letter, or letters with periods between them, have no ordinary use to be told from."""
        if low not in words:
            return False
        if len(low) < 2 or "." in low:
            return True
        return self._count(DOT, low) >= 2 * self._count(PLAIN, low)

    def spans(self, text: str) -> list[tuple[int, int]]:
        if not text or text.isspace():
            return []
        self.text, self.own, self.asked = text, None, False
        self.cased = _is_cased(text)
        self.plain = text.isascii()
        self.thai = not self.plain and THAI_LETTER.search(text) is not None
        self.emoji = not self.plain and EMOJI.search(text) is not None
        self.quoted = OPENER.search(text) is not None
        self.inner = "@" in text or INNER.search(text) is not None
        found: list[tuple[int, int]] = []
        for line in LINES.finditer(text):
            self._line(line.group(), line.start(), found)
        return found

    def _line(self, s: str, offset: int, found: list[tuple[int, int]]) -> None:
        start = 0
        for cut in self._cuts(s):
            # Most sentences start one space after the last.
            begin = start + 1 if start and s[start] == " " else start
            if s[begin].isspace() or s[cut - 1].isspace():
                self._add(s, start, cut, offset, found)
            else:
                found.append((offset + begin, offset + cut))
            start = cut
        if start < len(s):
            self._add(s, start, len(s), offset, found)

    @staticmethod
    def _add(s: str, start: int, end: int, offset: int, found: list[tuple[int, int]]) -> None:
        part = s[start:end]
        left = len(part) - len(part.lstrip())
        part = part.strip()
        if part:
            found.append((offset + start + left, offset + start + left + len(part)))

    # Cuts of one line

    def _cuts(self, s: str) -> list[int]:
        self.fixed = [m.span() for m in ADDRESS.finditer(s)] if self.inner and (INNER.search(s) or "@" in s) else []
        spaces = {m.start(): m.end() for m in THAI.finditer(s)} if self.thai else {}
        cuts: list[int] = []
        fixed, quotes, cased = self.fixed, self._quotes(s), self.cased
        emoji = {m.start(): m.end() for m in EMOJI.finditer(s)} if self.emoji else {}
        places = [m.start() for m in MARK.finditer(s)]
        if spaces or quotes or emoji:
            places = sorted({*places, *spaces, *quotes, *emoji})
        i, begin, address = 0, self._skip(s, 0), 0
        if s[begin : begin + 1].isdigit() and (number := LIST_NUMBER.match(s)):
            i = number.end()  # the number of a list entry
        for at in places:
            if at < i:
                continue
            if fixed:
                while address < len(fixed) and fixed[address][1] <= at:
                    address += 1
                if address < len(fixed) and fixed[address][0] <= at:
                    i = fixed[address][1]
                    continue
            if at == len(s) - 1:
                break  # the line ends the sentence anyway
            if begin < at and at not in quotes:
                mark, after = s[at], s[at + 1]
                if mark == ".":
                    # Inside a number, or before a word in lower case where sentences begin with capitals: no end.
                    if after.isdigit() or cased and after == " " and "a" <= s[at + 2 : at + 3] <= "z":
                        i = at + 1
                        continue
                    plain = after == " " and self._is_plain_end(s, at, begin)
                elif mark in "!?":
                    plain = after == " " and self._is_plain_end(s, at, begin)
                elif mark in HARD and after.isalpha() and not after.isascii():
                    cuts.append(at + 1)
                    i = begin = at + 1
                    continue
                else:
                    plain = False
                if plain:
                    cuts.append(at + 1)
                    i = begin = at + 2
                    continue
            if at in spaces:
                end = at
            elif at in quotes:
                i = quotes[at] + 1
                end = self._after_quote(s, at, quotes[at], begin)
                if end is None:
                    continue
            elif at in emoji:
                end = self._tail(s, emoji[at])
            else:
                i = at + 1
                while i < len(s) and s[i] in MARKS:
                    i += 1
                self.begin = begin
                if not self._ends(s, at, i, begin):
                    continue
                end = self._tail(s, i)
            cuts.append(end)
            i = begin = self._skip(s, end)
        return cuts

    def _is_plain_end(self, s: str, at: int, begin: int) -> bool:
        """The commonest case, settled without the general rules: a single mark, one space and a Latin letter."""
        if s[at + 1 : at + 2] != " " or (nxt := s[at + 2 : at + 3]) in ("x", "X") or not (nxt.isascii() and nxt.isalpha()):
            return False
        if s[at] in "!?":
            return True
        if s[at] != "." or not nxt.isupper() or not s[at + 3 : at + 4].islower():
            return False
        token = s[max(s.rfind(" ", begin, at) + 1, begin) : at]
        if not (token.isalpha() and token.isascii()):
            self.begin = begin
            token = self._token(s, at)
        low = token.lower()
        return len(token) > 1 and token.isalpha() and low not in TITLES and low not in LEADS and low not in ENDS and not self._abbreviates(low)

    @staticmethod
    def _skip(s: str, i: int) -> int:
        while i < len(s) and (s[i] in BLANK or s[i].isspace()):
            i += 1
        return i

    def _tail(self, s: str, i: int) -> int:
        """End of the closing quotes and brackets, emoji, emoticons and repeated marks that follow a mark."""
        end = i
        while True:
            j = self._skip(s, end)
            if j >= len(s) or s[j].isascii() and s[j].isalpha() and s[j] not in "xX":
                return end
            if j == end and s[j] in CLOSE and not (s[j] in OPEN and j in self.opened):
                end = j + 1
                continue
            m = EMOTICON.match(s, j) if s[j] in ":;=8xX<^)(¯" else None if s[j].isalnum() else EMOJI.match(s, j)
            if m:
                end = m.end()
                continue
            if s[j] in MARKS and s[j] not in "¿¡" and (j == end or s[j] in "!?！？"):
                end = j + 1
                continue
            # A closing guillemet set off by a space belongs to what it closes.
            if s[j] in "»" and j - end <= 1 and j not in self.opened:
                end = j + 1
                continue
            return end

    def _quotes(self, s: str) -> dict[int, int]:
        """Opening place of each outermost quotation or bracket of the line, and the place that closes it."""
        found: dict[int, int] = {}
        self.opened = set()
        if not self.quoted:
            return found
        pairs: dict[str, dict[int, int]] = {}
        singles: list[int] | None = None
        i = 0
        for m in OPENER.finditer(s):
            at, c, close = m.start(), m.group(), -1
            if at < i:
                continue
            if c == '"':
                close = s.find('"', at + 1)
            elif c == "'":
                if (at == 0 or not s[at - 1].isalnum()) and s[at + 1 : at + 2].isalnum():
                    if singles is None:
                        singles = [e.start() for e in QUOTE_END.finditer(s)]
                    k = bisect_right(singles, at)
                    close = singles[k] if k < len(singles) and singles[k] - at > 2 else -1
            elif not (c == "»" and s.rfind("«", 0, at) > s.rfind("»", 0, at)) and not (EMOTICON.match(s, max(0, at - 1)) or EMOTICON.match(s, max(0, at - 2))):
                if c not in pairs:
                    pairs[c] = self._pairs(s, c)
                close = pairs[c].get(at, -1)
            if close > at:
                found[at] = close
                self.opened.add(at)
                i = close + 1
        return found

    @staticmethod
    def _pairs(s: str, c: str) -> dict[int, int]:
        """Where each quotation or bracket opened by ``c`` is closed on the line, in one pass."""
        stack: list[int] = []
        found: dict[int, int] = {}
        for m in PAIRED[c].finditer(s):
            if m.group() == c and c not in OPEN[c]:
                stack.append(m.start())
            elif stack:
                found[stack.pop()] = m.start()
        return found

    def _next_word(self, s: str, i: int) -> str:
        m = WORD.match(s, self._lead(s, i))
        return m.group() if m else ""

    def _lead(self, s: str, i: int) -> int:
        """First place from ``i`` that is no white space, opening quote or the like."""
        while i < len(s) and (s[i] in BLANK or s[i].isspace() or s[i] in "\"'“„«‹「『¿¡([（【*_"):
            i += 1
        return i

    def _after_quote(self, s: str, i: int, close: int, begin: int) -> int | None:
        """Where the sentence ends if it ends with the quotation or bracket ``s[i:close + 1]``."""
        inner = s[i + 1 : close].rstrip()
        last = inner[-1:] if inner else ""
        if not last or not (last in MARKS or EMOJI.search(inner[-2:])):
            return None
        end = self._tail(s, close + 1)
        j = self._skip(s, end)
        if j >= len(s):
            return end
        nxt = s[j]
        if nxt in ",;:،、，；：)—–-" or nxt in MARKS:
            return None
        before = s[max(begin, i - 80) : i].rstrip()
        if end > close + 1 and EMOJI.search(s[close + 1 : end]):
            return end
        if s[i] in BRACKETS:
            # A sentence in brackets ends with them; a remark in brackets goes on unless a new sentence is plain.
            if not before:
                return end
            return end if (last in HARD or last == ".") and self._begins(s, j, False) and last == "." and not self._short_before(inner) else None
        if last in ".．" and self._short_before(inner) and not before.endswith((":", "：")):
            return None
        if before.endswith((":", "：", ",", "，")):
            if nxt.islower() and self.cased:
                return None
            return end
        if not before:
            # A quotation at the start is followed by who said it, unless a new sentence is plain.
            if nxt.islower() or not nxt.isalpha() and not nxt.isdigit():
                return None if nxt.islower() else (end if nxt in "\"“„«「『¿¡(" and self.cased else None)
            if nxt.isupper():
                word = self._next_word(s, j)
                return end if self._ordinary(word) else None
            return None
        if nxt.isupper():
            return end if self._ordinary(self._next_word(s, j)) else None
        if nxt in "\"“„«「『¿¡(" and self.cased:
            return end
        return None

    def _short_before(self, text: str) -> bool:
        """Whether ``text`` ends with an abbreviation and its period."""
        if not text.endswith("."):
            return False
        low = LAST_TOKEN.search(text[:-1]).group().lower()
        return any(self._listed(low, words) for words in (TITLES, LEADS, ENDS))

    def _token(self, s: str, i: int) -> str:
        """The token of the current sentence that ends before ``i``, with the periods inside it."""
        j = i
        while j > self.begin and (s[j - 1].isalnum() or s[j - 1] in ".'’-" or not s[j - 1].isascii() and unicodedata.category(s[j - 1])[0] == "M"):
            j -= 1
        return s[j:i].lstrip(".'’-")

    def _begins(self, s: str, j: int, weak: bool) -> bool:
        """Whether what stands at ``j`` looks like the start of a sentence; ``weak``: only on good grounds."""
        k = self._lead(s, j)
        if k >= len(s):
            return True
        c = s[k]
        if c.isdigit():
            return not weak
        if not c.isalpha():
            return not weak and c not in ",;:)%/&+=<>°"
        word = self._next_word(s, k)
        if c.isupper():
            return self._ordinary(word) if weak else True
        if c.islower():
            if self.cased:
                return False
            return self._starter(word) if weak else True
        return not weak  # a script without case

    def _ends(self, s: str, i: int, stop: int, begin: int) -> bool:
        """Whether the marks ``s[i:stop]`` end a sentence."""
        marks = s[i:stop]
        before, after = s[i - 1] if i else "", s[stop] if stop < len(s) else ""
        if self._skip(s, begin) >= i:
            return False  # marks without a sentence before them
        if any(c in HARD for c in marks):
            if marks[0] in "!?" and after and (after.isalnum() and after.islower() and before and self.cased and not marks[-1] in "。！？") and QUERY.match(after) and s[i - 1].isalnum() and "=" in s[stop : stop + 12]:
                return False
            j = self._skip(s, stop)
            if j < len(s) and s[j] in ",;،，、":
                return False
            return True
        j = self._skip(s, self._tail(s, stop))
        if j >= len(s):
            return True
        nxt = s[j]
        if nxt in ",;:،，；：、)）":
            return False
        if "…" in marks or len(marks) > 1:
            return self._ellipsis(s, i, j, j > stop)
        return self._period(s, i, stop, j, begin)

    def _ellipsis(self, s: str, i: int, j: int, spaced: bool) -> bool:
        """An ellipsis is a pause unless a new sentence begins after it."""
        k = self._lead(s, j)
        c = s[k] if k < len(s) else ""
        if c.isupper():
            return True
        if c.islower():
            if self.cased:
                return False
            word = self._token(s, i).lower()
            pause, stop = self._count(PAUSE, word), self._count(STOP, word)
            if pause or stop:
                return stop > pause
            return spaced and self._starter(self._next_word(s, k)) and self._sentence_length(s, i) > 2
        if c.isdigit():
            return spaced
        return False

    def _sentence_length(self, s: str, i: int) -> int:
        return len(s[max(0, i - 80) : i].split()[-4:])

    def _period(self, s: str, i: int, stop: int, j: int, begin: int) -> bool:
        before, after = s[i - 1] if i else "", s[stop] if stop < len(s) else ""
        spaced = j > stop
        token = self._token(s, i)
        low = token.lower()
        if CJK.match(before) and s[i] in ".．":
            return not after.isdigit()
        if not spaced:
            return self._glued(s, i, stop, token)
        k = self._lead(s, j)
        nxt = s[k] if k < len(s) else ""
        if low not in ENDS and self._listed(low, TITLES) and not token.isdigit():
            return False
        if low in LEADS and low not in ENDS and (nxt.isdigit() or self._listed(low, LEADS)):
            return nxt.isupper() and len(token) > 2 and low not in ("z.b", "d.h", "e.g", "i.e") and not self._abbreviates(low) and self._ordinary(self._next_word(s, k))
        unit = s[max(0, i - len(token) - 2) : i - len(token)].rstrip()[-1:].isdigit()
        if len(token) == 1 and token.isalpha() and not unit and (token.isupper() or not self.cased):
            # An initial, unless an ordinary word begins after it.
            single = self._initial(s, i, begin)
            word = self._next_word(s, k)
            if nxt.isdigit():
                return True
            if single and not self._begins(s, j, True):
                return False
            if len(word) == 1 and s[k + 1 : k + 2] == ".":
                return False
            return self._begins(s, j, True) or not nxt.isalpha()
        if DOTTED.fullmatch(token) or low in ENDS:
            if nxt.isdigit():
                return not low.endswith(("a.m", "p.m")) and low not in ("jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec")
            return self._begins(s, j, True)
        if token.isdigit():
            return self._number(s, i, token, j, k, begin)
        if self._abbreviates(low):
            return self._begins(s, j, True)
        return self._begins(s, j, False)

    def _abbreviates(self, low: str) -> bool:
        """Whether a word not in the lists is shown to be an abbreviation by periods inside sentences."""
        short = self._count(SHORT, low)
        return short > 0 and short * 2 > self._count(PLAIN, low) and len(low) <= 6 and not low.isdigit()

    @staticmethod
    def _initial(s: str, i: int, begin: int) -> bool:
        return i - 1 <= begin or s[i - 2] in BLANK or s[i - 2] in ".-(\"“„"

    def _number(self, s: str, i: int, token: str, j: int, k: int, begin: int) -> bool:
        """A period after digits: an ordinal if what follows neither begins sentences nor is a number."""
        nxt = s[k] if k < len(s) else ""
        word = self._next_word(s, k)
        at = i - len(token)
        if at <= begin and len(token) <= 3 and s[begin:at].strip() == "":
            return False  # "3. ..." at the start of a sentence
        if len(token) > 2 or s[max(0, at - 1) : at] in (".", ",", ":", "-", "/", "v", "V"):
            return self._begins(s, j, False)
        if word.lower() in MONTHS:
            return False
        if nxt.isupper():
            low = word.lower()
            # German ordinals stand before capitalised nouns, which hardly ever begin a sentence.
            start, inside = self._count(START, low), self._count(NAME, low)
            known = start + inside + self._count(LOWER_CASE, low)
            return not (self._german(s, at) and (inside > start or not known))
        if nxt.islower():
            if self.cased:
                return False
            if self._german(s, at):
                return self._starter(word) and self._count(START, word.lower()) > self._count(NAME, word.lower())
            return self._starter(word) or not self._german(s, at)
        return self._begins(s, j, False)

    @staticmethod
    def _german(s: str, at: int) -> bool:
        """Whether the words before a number are those before German ordinals."""
        words = WORD.findall(s[max(0, at - 24) : at].lower())
        return bool(words) and words[-1] in ("am", "im", "der", "die", "das", "den", "dem", "des", "vom", "zum", "beim", "bis", "ab", "seit", "und", "ein", "einen", "einem", "mein", "meinem", "jeder", "jeden", "jedes", "zur")

    def _glued(self, s: str, i: int, stop: int, token: str) -> bool:
        """A period with no space after it."""
        after = s[stop]
        before = s[i - 1] if i else ""
        if not after.isalpha() and after not in "\"'“„«([¿¡「『*":
            return False
        if after in "\"'“„«([¿¡「『*":
            return self._begins(s, stop, False)
        word = self._next_word(s, stop)
        low = token.lower()
        if CJK.match(after) or not (after.isupper() or after.islower()):
            return before.isalpha() and before != "." and not before.isupper() or CJK.match(after) is not None and not token.isdigit()
        if low in TITLES or "." in token and len(token.split(".")[-1]) < 2 and not token.replace(".", "").isdigit():
            # e.g. U.S.A or p.m.It
            tail = s[stop + 1 : stop + 2]
            return after.isupper() and tail.islower() and low in ENDS and self._ordinary(word)
        if len(token) == 1 and token.isalpha():
            return False
        end = stop + len(word)
        if end < len(s) and s[end] in "@/" or end + 1 < len(s) and s[end] == "." and s[end + 1].isalnum() and not s[end + 1].isupper():
            return False
        if after.isupper():
            if len(word) == 1 and end < len(s) and s[end] == "." and not (len(token) > 2 and before.islower()):
                return False
            return before.islower() or before.isdigit() and self._ordinary(word) and len(word) > 1 or (not before.isupper() and not before.isdigit()) or (before.isupper() and self._ordinary(word) and len(token) > 3) or low in ENDS
        if self.cased:
            return False
        return before.islower() and len(token) > 1 and self._count(START, word.lower()) > 0


COUNTS = ", ".join(f"{k} bigint" for k in KINDS)


def statistics(texts: DataFrame) -> DataFrame:
    """(word, its counts, n): the evidence on every word of the column ``text`` over all documents."""
    counted = texts.mapInArrow(_collect, "word string, " + COUNTS)
    counts = counted.groupBy("word").agg(*[F.sum(k).alias(k) for k in KINDS])
    return counts.withColumn("n", sum((F.col(k) for k in KINDS), F.lit(0)))


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Evidence()

    def flush() -> pa.RecordBatch:
        found = held.counts()
        columns = list(zip(*found.values(), strict=True)) or [()] * len(KINDS)
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["word", *KINDS])

    for batch in batches:
        evidence((t for t in batch.column(0).to_pylist() if t), held)
        if len(held) > 400_000:
            yield flush()
            held = Evidence()
    yield flush()


def _spans(ids: list, starts: list, ends: list, open_ids: list, texts: list, words: list) -> pa.RecordBatch:
    none = [None] * len(open_ids)
    columns = [pa.array(ids + open_ids, pa.int64()), pa.array(starts + none, pa.int32()), pa.array(ends + none, pa.int32()), pa.array([None] * len(ids) + texts, pa.large_string()), pa.array([None] * len(ids) + words, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start_pos", "end_pos", "text", "words"])


def _words_of(text: str) -> list[str]:
    """Every form in which a word of the text can be asked for."""
    tokens = TOKEN.findall(text)
    return list({*(t.rstrip(".'’-").lower() for t in tokens), *(t.rstrip(".").lower() for t in tokens), *(w.lower() for w in WORD.findall(text))})


def _split(corpus: Broadcast, complete: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sentences of each text; a text that asks for a word ``corpus`` lacks comes back itself, with its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(corpus.value, complete)
        for batch in batches:
            ids, starts, ends, open_ids, texts, words = [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = splitter.spans(text or "")
                if splitter.asked:
                    open_ids.append(key)
                    texts.append(text)
                    words.append([w for w in _words_of(text) if w not in corpus.value])
                    splitter.asked = False
                    continue
                for a, b in spans:
                    ids.append(key)
                    starts.append(a)
                    ends.append(b)
            yield _spans(ids, starts, ends, open_ids, texts, words)

    return run


def _split_again(corpus: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(corpus.value)
        for batch in batches:
            ids, starts, ends = [], [], []
            for key, text, more in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                splitter.more = {w["word"]: [w[k] for k in KINDS] for w in more or ()}
                for a, b in splitter.spans(text):
                    ids.append(key)
                    starts.append(a)
                    ends.append(b)
            yield _spans(ids, starts, ends, [], [], []).select(["doc_id", "start_pos", "end_pos"])

    return run


def sentences(documents: DataFrame, held_words: int = HELD_WORDS) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence of every document. ``held_words`` changes the plan, not the rows."""
    c, spark = F.col, documents.sparkSession
    texts = enough_tasks(documents).select(c("doc_id").cast("bigint").alias("doc_id"), c("text").cast("string").alias("text"))
    counts = cut_lineage(statistics(texts.select("text")))
    common = counts.orderBy(c("n").desc(), "word").limit(held_words + 1).collect()
    complete = len(common) <= held_words
    corpus = spark.sparkContext.broadcast({r[0]: tuple(r[1:-1]) for r in common[:held_words]})
    found = texts.mapInArrow(_split(corpus, complete), "doc_id bigint, start_pos int, end_pos int, text string, words array<string>")
    if complete:
        return found.select("doc_id", "start_pos", "end_pos")
    found = cut_lineage(found)
    # A text's sentences depend on the text alone, so texts are told apart by their digest.
    unsettled = found.filter(c("text").isNotNull()).withColumn("digest", F.sha2("text", 256))
    asked = unsettled.select("digest", F.explode("words").alias("word")).distinct()
    more = asked.join(counts, "word").groupBy("digest").agg(F.collect_list(F.struct("word", *KINDS)).alias("more"))
    again = unsettled.join(more, "digest", "left").select("doc_id", "text", "more").mapInArrow(_split_again(corpus), "doc_id bigint, start_pos int, end_pos int")
    return found.filter(c("start_pos").isNotNull()).select("doc_id", "start_pos", "end_pos").unionByName(again)
