"""Problem 9: the sentences of texts in many languages and scripts, as character spans.

Method: a hidden-event n-gram language model. A text is a sequence of tokens with unseen boundary tokens between some of
them; a trigram model over tokens and boundaries gives every sequence of events a probability, and the posteriors of
forward-backward decide every boundary within a block; only blank lines are boundaries by definition.

Every position between two words of a text is scored, by one of two such models. They are trained here without labels, over
all distinct texts:

* ``Model`` for the positions after a terminator or, in Thai and its like, a blank. Stretches around them are tokenised, counted
  and scored: two tokens before each place, two after it, longer where places touch. First events come from signs that need
  no model (words that never end a paragraph although they often stand before a period are abbreviations); then the model
  is estimated, and its own decisions are used to estimate it again, ``ROUNDS`` times. As stretches repeat, this runs
  over the distinct ones with their counts.
* ``Unpunctuated`` for all other positions: between any two words an event may stand. It is trained on the sentences of the
  first model with all signs taken off. Blocks without any terminator (scripts that have none, or text that lost them) are scored
  as they are; in blocks with terminators the odds of an event are multiplied by how much more often what stands between the
  two words (nothing, a comma, ...) is seen at the end of such blocks than within sentences.

Speech or brackets that are still open never hold a boundary, nor do letters of a script that parts sentences by blanks, or
blanks between them and a number.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.runtime import BLANKS, cut, require, spread

ROUNDS, RARE = 2, 4
#: Most words, pairs and triples of tokens of the model that is sent to the workers; entries of a worker's counter.
WORDS, PAIRS, TRIPLES, FLUSH = 100_000, 200_000, 400_000, 200_000
#: Stretches whose posteriors a worker remembers.
MEMO = 1 << 17
#: Characters of the texts whose words are scored at once (a longer text goes alone), and the least share of boundaries that lost their sign.
AT_ONCE, LOST = 1 << 20, 0.01

# Abbreviations before a period that do not end a sentence, as a start for small collections.
ABBREVIATIONS = set(
    "Dr Prof Mr Mrs Ms St Messrs Co al cf Eq Eqs Ref Refs No Nos Sec Secs Fig Figs approx vs pct e g i Abb bzw ca vgl Nr Gl z B d h u usw "
    "env éq fig p ex M Mme MM Sr Sra Dra ej EE UU núm aprox pág т е д п См см рис табл ок Βλ Εικ βλ εικ π χ डॉ د vol pp ed Vol".split()
)
TERMINATORS = ".!?…。！？।؟．"
_PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")）", "（": "）)", "[": "]", "【": "】"}
_CLOSERS = frozenset("\"”“»」』)）]】")
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_BLANK_SCRIPTS = r"\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_IN_WORD = rf"[[\p{{L}}\p{{M}}]--[{_UNSPACED}]]"
_TOKEN = regex.compile(
    rf"(?P<n>\p{{N}}+(?:[.,:/-]\p{{N}}+)*)|(?P<c>\p{{Lu}}-?\p{{N}}+\p{{Lu}}?\b)|(?P<u>[{_UNSPACED}])"
    rf"|(?P<w>{_IN_WORD}+(?:['’_/-][[\p{{L}}\p{{M}}\p{{N}}]--[{_UNSPACED}]]+)*)|(?P<t>[.!?…。！？।؟．]+|(?<=\p{{Greek}});|\u037e)|(?P<p>[^\s])",
    regex.V1,
)
#: All that opens or closes a place: terminators, quotation marks and brackets, blanks beside scripts that part sentences by them.
_SPECIAL = regex.compile(
    rf"(?P<t>[.!?…。！？।؟．]+|(?<=\p{{Greek}});|\u037e)|(?P<q>[“”„«»「」『』()（）\[\]【】\"])|(?P<b>(?<=[{_BLANK_SCRIPTS}])\s+(?=[[\p{{L}}\p{{M}}]--[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]])|(?<={_IN_WORD})\s+(?=[{_BLANK_SCRIPTS}]))",
    regex.V1,
)
#: The same for texts without such a script, faster.
_SIGNS = re.compile(r"(?P<t>[.!?…。！？।؟．]+|[;\u037e])|(?P<q>[“”„«»「」『』()（）\[\]【】\"])")
_BLANK_SCRIPT = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u19e0-\u19ff\ua9e0-\ua9fe\uaa60-\uaa7f]")
_GREEK = regex.compile(r"\p{Greek}")
_BLANK_LINE = regex.compile(r"\n[ \t\r]*(?:\n[ \t\r]*)+")
_VISIBLE = regex.compile(r"[^\s\p{C}]")
_THAI = regex.compile(rf"[{_BLANK_SCRIPTS}]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}。！？」』”）]")
_NEXT = regex.compile(r"\S")
_WORDS = regex.compile(rf"\p{{N}}+(?:[.,:/-]\p{{N}}+)*|\p{{Lu}}-?\p{{N}}+\p{{Lu}}?\b|[{_UNSPACED}]|{_IN_WORD}+(?:['’_/-][[\p{{L}}\p{{M}}\p{{N}}]--[{_UNSPACED}]]+)*", regex.V1)
EDGE = "<s>"
#: Signs that part the tokens, fields and stretches of a text in a column of strings.
_T, _F, _S = "\x1f", "\x1e", "\x1d"
_SAFE = str.maketrans("\x1d\x1e\x1f", "???")
#: Tokens for a blank between letters of a script that parts sentences by blanks, and between such a letter and another one.
BETWEEN, BESIDE = "<b>", "<m>"

Token = tuple[str, str, int]  # text, kind, start


def _token(m) -> Token:
    k = m.lastgroup
    return ("<n>" if k == "n" else "<c>" if k == "c" else m.group(), k, m.start())


def _before(text: str, lo: int, p: int) -> Token | None:
    """The last token that ends before ``p``."""
    while p > lo and text[p - 1].isspace():
        p -= 1
    if p == lo:
        return None
    a = max(lo, text.rfind(" ", lo, p) + 1, text.rfind("\n", lo, p) + 1)  # no token goes over a blank
    if p - a <= 24:
        part = text[a:p]
        got = _ends.get(part)
        if got is None:
            m = None
            for m in _TOKEN.finditer(part):
                pass
            if len(_ends) > MEMO:
                _ends.clear()
            got = _ends[part] = _token(m) if m else ("", "", 0)
        if got[1]:
            return got[0], got[1], a + got[2]
    size = 24
    while True:
        a, m, n = max(lo, p - size), None, 0
        for m in _TOKEN.finditer(text, a, p):
            n += 1
        if a == lo or n > 1:  # the first one may be the rest of a longer token
            return _token(m) if m else None
        size *= 4


#: Last tokens of stretches without blanks, as a worker remembers them.
_ends: dict[str, Token] = {}


def _after(text: str, p: int, hi: int, k: int = 3) -> list[Token]:
    """The first ``k`` tokens from ``p`` on."""
    out = []
    for m in _TOKEN.finditer(text, p, hi):
        out.append(_token(m))
        if len(out) == k:
            break
    return out


class Place:
    """A possible boundary before position ``at``: the two tokens before it, up to three after, and a first guess."""

    __slots__ = ("at", "u", "v", "after", "guess", "word", "blank")

    def __init__(self, at: int, u: Token, v: Token, after: list[Token], guess: int, word: str | None, blank: bool = False):
        self.at, self.u, self.v, self.after, self.guess, self.word, self.blank = at, u, v, after, guess, word, blank


_START: Token = (EDGE, "s", -1)


def _brackets(marks: list) -> tuple[dict[int, int], dict[int, int]]:
    """Matched quotation marks and brackets: opener -> closer and closer -> opener, as positions."""
    stack: list[tuple[str, int]] = []
    closer_of, opener_of = {}, {}
    for m in marks:
        t, at = m.group(), m.start()
        own = next((k for k in reversed(range(len(stack))) if t in _PAIRS.get(stack[k][0], stack[k][0])), None) if t in _CLOSERS else None
        if own is not None:
            closer_of[stack[own][1]], opener_of[at] = at, stack[own][1]
            del stack[own:]
        elif t in _PAIRS or t == '"':
            stack.append((t, at))
    return closer_of, opener_of


class Block:
    """A stretch between blank lines: its possible boundaries, and what its terminators show."""

    __slots__ = ("text", "lo", "hi", "places", "signs", "still", "bare", "held")

    def __init__(self, text: str, lo: int, hi: int):
        self.text, self.lo, self.hi = text, lo, hi
        self.places: list[Place] = []
        self.signs: list[tuple[str, bool, bool]] = []  # (word before a period, at the block's end, small letter next)
        self.still: list[tuple[Token, Token, Token]] = []  # around a terminator that is no place
        self.bare = True  # no terminator, and no blank that may be a boundary
        self.held: list[int] = []  # first and last position of speech and brackets, the outermost
        self._find()

    def _find(self) -> None:
        text, lo, hi = self.text, self.lo, self.hi
        if _BLANK_SCRIPT.search(text, lo, hi):
            found = list(_SPECIAL.finditer(text, lo, hi))
        else:
            found = [m for m in _SIGNS.finditer(text, lo, hi) if m.group() != ";" or (m.start() > lo and _GREEK.match(text, m.start() - 1))]
        if not found:
            return
        marks = [m for m in found if m.lastgroup == "q"]
        closer_of, opener_of = _brackets(marks) if len(marks) > 1 else ({}, {})
        for o, c in sorted(closer_of.items()):
            if not self.held or o > self.held[-1]:
                self.held += [o, c]
        depth, done, last = 0, lo, lo
        for m in found:
            s, e = m.span()
            if s < done:
                continue  # a closer that belongs to the terminator before
            kind = m.lastgroup
            if kind == "q":
                depth += (s in closer_of) - (s in opener_of)
                continue
            if kind == "b":
                self.bare = False
                if depth == 0:
                    both = bool(_THAI.match(text, s - 1)) and bool(_THAI.match(text, e))
                    self.places.append(Place(e, _before(text, lo, s), (BETWEEN if both else BESIDE, "p", s), _after(text, e, hi), int(both), None, True))
                    last = e if both else last
                continue
            end = m.group()
            if end == "." and lo < s and e < hi and text[s - 1].isdigit() and text[e].isdigit():
                continue  # within a number
            self.bare = False
            before = _before(text, lo, s)
            word = before is not None and before[1] == "w"
            at, d, opened, tail = e, depth, None, [before or _START, (end, "t", s)]
            while (x := _NEXT.search(text, at, hi)) and x.start() in opener_of:
                opened, d, at = opener_of[x.start()], d - 1, x.end()
                tail.append((x.group(), "p", x.start()))
            depth, done = d, at
            if end == "." and word:
                following = _after(text, e, hi, 1)
                self.signs.append((before[0], not following, bool(following) and following[0][1] in "wnc" and not following[0][0][0].isupper()))
            if not x:
                continue
            after = _after(text, at, hi)
            nxt, kind, start = after[0]
            nospace = start == at
            is_place = False
            if d == 0:
                cjk = end[-1] in "。！？．" or bool(_CJK.match(text, at - 1)) and bool(_CJK.match(text, start))
                glued = nospace and not cjk
                joined = glued and end == "." and opened is None and word and len(before[0]) > 1 and before[0][-1].islower() and kind == "w" and nxt[0].isupper()
                is_place = (not glued or joined or (nospace and kind == "p" and nxt in "“„«「(（" and cjk)) and not (kind == "p" and nxt in ",:;%，、；：")
            if is_place:
                p = Place(start, tail[-2], tail[-1], after, self._guess(before, end, opened, nxt, kind, last), before[0] if end == "." and opened is None and before else None)
                self.places.append(p)
                last = start if p.guess else last
            else:
                self.still.append((tail[-2], tail[-1], after[0]))

    def _guess(self, before: Token | None, end: str, opened: int | None, nxt: str, kind: str, last: int) -> int:
        word = kind == "w"
        lower = word and nxt[0].islower()
        if set(end) == {"…"} or end == "...":
            return int(word and nxt[0].isupper())
        if opened is not None:
            intro = _before(self.text, self.lo, opened)
            first = not self.text[last:opened].strip() and opened >= last
            if self.text[opened] in "(（[【":
                return int(first or intro is None or intro[1] == "t")
            if intro and intro[0] in (":", "："):
                return 1
            if end[0] in ".。।":
                return int(not lower and nxt not in ("と",) and (not intro or intro[0] != "は"))
            return int(not (lower or nxt in ("—", "–", "-") or kind == "u" or (word and not nxt[0].isupper())))
        if end == "." and before is not None and before[1] == "w" and (before[0] in ABBREVIATIONS or (len(before[0]) == 1 and before[0].isupper())):
            return 0
        return 1

    def runs(self) -> list[tuple[list[Token], list[int], list[Place]]]:
        """Tokens around places that touch, the index of the token after each place, and the places."""
        out = []
        for p in self.places:
            if out:
                tokens, at, own = out[-1]
                q = own[-1]
                between = [t for t in q.after if t[2] < p.at]
                if len(between) < len(q.after) and q.after[len(between)][2] == p.at or (len(between) == len(q.after) < 3):
                    steps = between + [p.v] * p.blank
                    if len(steps) <= 2:
                        del tokens[at[-1] :]
                        tokens += steps
                        at.append(len(tokens))
                        own.append(p)
                        tokens += p.after[:2]
                        continue
            out.append(([p.u or _START, p.v, *p.after[:2]], [2], [p]))
        return out


def blocks(text: str) -> list[Block]:
    out, at = [], 0
    for m in [*_BLANK_LINE.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at and _NEXT.search(text, at, end):
            out.append(Block(text, at, end))
        at = m.end() if m else end
    return out


def words_of(text: str, lo: int, hi: int) -> list[Token]:
    """Words, numbers and single letters of unspaced scripts, without any signs."""
    return [_token(m) for m in _TOKEN.finditer(text, lo, hi) if m.lastgroup not in "tp"]


def _key(tokens: list[Token], at: list[int] = (), places: list[Place] = ()) -> str:
    """A stretch as a string: tokens, kinds, places, first guesses, words before a period."""
    text = _T.join([t[0] for t in tokens])
    if text.count(_T) >= len(tokens) or _F in text or _S in text:
        text = _T.join([t[0].translate(_SAFE) for t in tokens])
    return _F.join((text, "".join([t[1] for t in tokens]), " ".join(map(str, at)), "".join([str(p.guess) for p in places]), _T.join([(p.word or "").translate(_SAFE) for p in places])))


def scan(text: str) -> tuple[list[int], list[str], list[int], list[int], list[str]]:
    """What the models need of a text: (start, end, whether bare) of each block; the stretches with places and the places'
    positions; (first, last) position of speech and brackets; stretches without places and, for each word before a period,
    whether a block ends and a small letter follows."""
    own, keys, at, held, more = [], [], [], [], []
    for b in blocks(text):
        own += [b.lo, b.hi, int(b.bare)]
        held += b.held
        for tokens, index, places in b.runs():
            keys.append(_key(tokens, index, places))
            at += [p.at for p in places]
        more += [_key(x) for x in b.still]
        more.append(_key([_START, _START, *_after(text, b.lo, b.hi, 2)]))
        if not b.bare:
            last = _before(text, b.lo, b.hi)
            more.append(_key([_before(text, b.lo, last[2]) or _START, last, _START]))
        more += [_F.join((w.translate(_SAFE), "!", f"{int(end)}{int(low)}")) for w, end, low in b.signs]
    return own, keys, at, held, more


class Model:
    """Interpolated trigram model (Witten-Bell) over tokens and the boundary token."""

    def __init__(self, words: set[str]):
        self.c1, self.c2, self.c3 = Counter(), Counter(), Counter()
        self.n1, self.n2, self.n3 = 0, Counter(), Counter()
        self.k1, self.t2, self.t3 = 0, Counter(), Counter()
        self.words = words
        self.plain: Model | None = None
        self.memo: dict = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.memo = {}

    def shape(self, token: str, kind: str) -> str:
        if kind not in "wu" or token in self.words:
            return token
        if kind == "u":
            return "<u>"
        return "<Cap>" if token[0].isupper() else "<low>" if token[0].islower() else "<oth>"

    def edge(self, u: str, v: str) -> float:
        """Probability of a boundary after u, v."""
        p = (self.c1.get(EDGE, 0) + 0.5) / (self.n1 + 1)
        p = (self.c2.get((v, EDGE), 0) + 2 * p) / (self.n2.get(v, 0) + 2)
        return (self.c3.get((u, v, EDGE), 0) + 0.1 * p) / (self.n3.get((u, v), 0) + 0.1)

    def _p2(self, v: str, w: str) -> float:
        p1 = (self.c1.get(w, 0) + 0.5) / (self.n1 + 0.5 * (self.k1 + 1))
        n, t = self.n2.get(v, 0) - self.c2.get((v, EDGE), 0), self.t2.get(v, 0)
        return (self.c2.get((v, w), 0) + t * p1) / (n + t) if n > 0 else p1

    def p(self, u: str, v: str, w: str) -> float:
        """Probability of token w after u, v, no boundary being between them (v itself may be one)."""
        p2 = self._p2(v, w)
        n, t = self.n3.get((u, v), 0) - self.c3.get((u, v, EDGE), 0), self.t3.get((u, v), 0)
        return (self.c3.get((u, v, w), 0) + t * p2) / (n + t) if n > 0 else p2

    def posteriors(self, tok: tuple[str, ...], places: tuple[int, ...]) -> list[float]:
        """Probability of a boundary before each of the ``places`` (indices into ``tok``, from 2 on), by forward-backward."""
        here, a, b = set(places), places[0], min(len(tok), places[-1] + 2)
        # State: whether a boundary stands before the previous token. alpha is scaled at each step.
        alpha, forward, steps = (1.0, 0.0), [], []
        for t in range(a, b):
            v, w, new, moves = tok[t - 1], tok[t], [0.0, 0.0], []
            for s in (0, 1):
                if alpha[s]:
                    u = EDGE if s else tok[t - 2]
                    e = self.edge(u, v) if t in here else 0.0
                    moves.append((s, 0, (1 - e) * self.p(u, v, w)))
                    if t in here:
                        moves.append((s, 1, e * self.p(v, EDGE, w)))
            for s, to, p in moves:
                new[to] += alpha[s] * p
            z = new[0] + new[1] or 1e-300
            forward.append(alpha)
            steps.append((moves, z))
            alpha = (new[0] / z, new[1] / z)
        beta, out = (1.0, 1.0), []
        for t in range(b - 1, a - 1, -1):
            moves, z = steps[t - a]
            old, down, at = [0.0, 0.0], 0.0, forward[t - a]
            for s, to, p in moves:
                x = p * beta[to] / z
                old[s] += x
                if to:
                    down += at[s] * x
            if t in here:
                total = at[0] * old[0] + at[1] * old[1]
                out.append(down / total if total else 0.0)
            beta = (old[0], old[1])
        out.reverse()
        return out

    def decide(self, own: list[int], keys: list[str], at: list[int]) -> list[int]:
        """Positions where a sentence starts as to this model, from what ``scan`` found in a text."""
        out, i, memo = list(own[::3]), 0, self.memo
        for k in keys:
            d = memo.get(k)
            if d is None:
                tok, kind, index, *_ = k.split(_F)
                d = [q > 0.5 for q in self.posteriors(tuple(map(self.shape, tok.split(_T), kind)), tuple(map(int, index.split())))]
                if len(memo) > MEMO:
                    memo.clear()
                memo[k] = d
            for x in d:
                if x:
                    out.append(at[i])
                i += 1
        return out

    def decide_all(self, rows: list[tuple]) -> list[list[int]]:
        """Positions where a sentence starts in each of ``rows`` (text, own, keys, at, held), as to both models."""
        starts = [self.decide(own, keys, at) for _, own, keys, at, _ in rows]
        if self.plain is not None:
            for i, at in self.plain.split(rows, starts):
                starts[i].append(at)
        return [sorted(set(x)) for x in starts]


#: Items of a text beside its words (0 and up, numbers of the vocabulary) and signs (-``SIGN`` less the character and below): a block starts,
#: without or with terminators; a sentence starts; no boundary before the next word, as the first model says; speech starts; speech ends.
BARE, BLOCK, SENT, SHUT, HELD, FREE, SIGN = -1, -2, -3, -4, -5, -6, 10
#: Items by the string that stands for them among the chunks of a text; no chunk has this blank.
_ITEM = {k: f"\x1c{-k}" for k in (BARE, BLOCK, SENT, SHUT, HELD, FREE)}
SHAPES = [EDGE, "<n>", "<c>", "<u>", "<Cap>", "<low>", "<oth>"]
_CHUNK = re.compile(r"\S+")
#: What stands between two words: a blank, nothing (or signs) within a chunk, nothing beside an unspaced script, the start of speech or
#: brackets, else 4 and the sign.
_SPACE, _GLUED, _JOINED, _OPENED = 0, 1, 2, 3


def _signs(signs: str) -> list[tuple[int, int, int]]:
    """Items of the signs between two words: a terminator among them, and the last one."""
    end = next((x for x in signs if x in TERMINATORS or x == "\u037e"), "")
    return [(-SIGN - ord(x), 0, 0) for x in dict.fromkeys(end + signs[-1:])]


_ENDING = np.array([-SIGN - ord(x) for x in TERMINATORS + "\u037e"])


class Chunks(dict):
    """Chunks without blanks with a number each; their words and signs as numbers, whether words are of an unspaced script (1; 2 if
    it parts sentences by blanks), and offsets. A worker remembers up to ``MEMO`` chunks."""

    def __init__(self, ids: dict[str, int], shape):
        self.ids, self.shape = ids, shape
        self.letters: dict[str, tuple[int, int]] = {}  # number and kind of letters of unspaced scripts
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.items, self.kinds, self.offsets, self.ends = array("i"), array("b"), array("i"), array("q", [0])
        for code, x in _ITEM.items():
            self._add(x, [(code, 0, 0)])

    def _add(self, chunk: str, found: list[tuple[int, int, int]]) -> int:
        for column, x in zip((self.items, self.kinds, self.offsets), zip(*found)):
            column.extend(x)
        self.ends.append(len(self.items))
        self[chunk] = n = len(self)
        return n

    def __missing__(self, chunk: str) -> int:
        found, signs, letters = [], "", self.letters
        for m in _TOKEN.finditer(chunk):
            k = m.lastgroup
            if k in "tp":
                t = m.group()
                signs += "\u037e" if k == "t" and t == ";" else t  # a Greek question mark, not a semicolon
                continue
            if signs:
                found += _signs(signs)
                signs = ""
            if k == "u":
                x = letters.get(t := m.group())
                if x is None:
                    x = letters[t] = self.ids[self.shape(t, k)], 1 + bool(_THAI.match(t))
                found.append((*x, m.start()))
            else:
                t, k, at = _token(m)
                found.append((self.ids[self.shape(t, k)], 0, at))
        return self._add(chunk, found + _signs(signs))

    def read(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Items, kinds, offsets of all ``chunks``, and the index of the chunk of each."""
        if len(self) > MEMO or len(self.items) > 8 * MEMO:
            self.reset()
        of = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        ends = np.array(self.ends)
        n = ends[of + 1] - ends[of]
        chunk = np.repeat(np.arange(len(chunks)), n)
        at = np.arange(len(chunk)) + np.repeat(ends[of] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return np.array(self.items)[at], np.array(self.kinds)[at], np.array(self.offsets)[at], chunk


class Gaps:
    """All words of texts in order, and all positions between two words of one sentence (of the first model)."""

    def __init__(self, chunks: Chunks, rows: list[tuple], starts: list[list[int]]):
        parts, self.pieces, self.first = [], [], []  # pieces: (row, from, to); first: number of its first chunk
        for i, ((text, own, _, at, held), begins) in enumerate(zip(rows, starts)):
            marks = [(p, 2, SHUT) for p in at] + [(p, 1, SENT) for p in begins]
            marks += [(own[j], 0, BARE if own[j + 2] else BLOCK) for j in range(0, len(own), 3)]
            marks += [(p, 3, FREE if j % 2 else HELD) for j, p in enumerate(held)]
            marks.sort()
            marks.append((len(text), 4, 0))
            for (a, rank, code), (e, _, _) in zip(marks, marks[1:]):
                if rank != 2 or not (parts and parts[-1] in (_ITEM[SENT], _ITEM[BARE], _ITEM[BLOCK])):
                    parts.append(_ITEM[code])
                if e > a:
                    self.pieces.append((i, a, e))
                    self.first.append(len(parts))
                    parts += text[a:e].split()
        parts.append(_ITEM[BLOCK])
        items, kinds, self.offsets, chunk = chunks.read(parts)
        index = np.arange(len(items))
        last = lambda found: np.maximum.accumulate(np.where(found, index, -1))
        at = np.flatnonzero(items >= 0)
        block = (items == BARE) | (items == BLOCK)
        bare = items[last(block)] == BARE
        state = last(block | (items == HELD) | (items == FREE))
        held = items[state] == HELD
        shut, opened = np.cumsum(items == SHUT), np.cumsum(items == HELD)
        sentence = np.cumsum(block | (items == SENT))
        sign = last(items <= -SIGN)
        self.at, self.chunk = at, chunk[at]
        self.word, self.kind, self.bare, self.sentence = items[at].astype(np.int64), kinds[at], bare[at], sentence[at]
        #: Of each word whether its sentence starts with it.
        self.begin = np.ones(len(at), bool)
        self.begin[1:] = self.sentence[1:] != self.sentence[:-1]
        #: The gaps by the word after them: what stands there, whether beside an unspaced script, whether an event is impossible.
        g = self.gap = np.flatnonzero(~self.begin)
        self.unspaced, self.between = self._between(items, sign[at[g]], at[g - 1], self.chunk[g] == self.chunk[g - 1], np.maximum(self.kind[g], self.kind[g - 1]))
        self.into = held[at[g]] & (opened[at[g]] != opened[at[g - 1]])
        self.between[self.into] = _OPENED
        self.closed = (shut[at[g]] != shut[at[g - 1]]) | (held[at[g]] & ~self.into) | (self.kind[g] == 2) | (self.kind[g - 1] == 2)
        #: What stands at the starts of sentences in blocks with terminators.
        first = at[self.begin & ~self.bare]
        self.head = np.where(held[first] & (last(items == HELD)[first] > last(block | (items == SENT))[first]), _OPENED, _SPACE)
        #: What stands at the ends of blocks with terminators.
        ends = np.flatnonzero(block)
        final = np.flatnonzero(np.diff(np.searchsorted(ends, at), append=len(ends) + 1) > 0)
        final = final[~self.bare[final] & (self.kind[final] < 2)]
        to = ends[np.searchsorted(ends, at[final])]
        ending = last(np.isin(items, _ENDING))[to]
        self.tail = self._between(items, np.where(ending > at[final], ending, sign[to]), at[final], np.zeros(len(final), bool), self.kind[final])

    @staticmethod
    def _between(items, sign, before, same, kind):
        got = np.where(sign > before, -SIGN - items[sign].astype(np.int64) + 4, np.where(kind > 0, _JOINED, _SPACE))
        return (kind > 0).astype(np.int64), np.where(same & (kind == 0), _GLUED, got)

    def position(self, rows: list[tuple], gap: int) -> tuple[int, int]:
        """Row and place in its text of the boundary in a gap: before the next word's chunk, if it is the first word there, or where speech starts."""
        k = int(self.gap[gap])
        c = int(self.chunk[k])
        i, a, e = self.pieces[p := int(np.searchsorted(self.first, c, "right")) - 1]
        if self.into[gap]:
            return i, a
        for n, m in enumerate(_CHUNK.finditer(rows[i][0], a, e)):
            if n == c - self.first[p]:
                break
        return i, m.start() + (int(self.offsets[self.at[k]]) if self.chunk[k - 1] == c else 0)


class Unpunctuated(Model):
    """Of the trigrams only those with a boundary among the first two or at the end; other contexts are of one word. ``signs``
    counts what stands between words in text with terminators: (beside an unspaced script, what) -> [within sentences, at block ends];
    ``heads`` counts what sentences start with there."""

    def __init__(self, words: set[str]):
        super().__init__(words)
        self.signs: dict[tuple[int, int], list[int]] = {}
        self.heads: Counter = Counter()
        self.tables: dict | None = None
        self.chunks: Chunks | None = None

    def __getstate__(self):
        if self.tables is None:
            self.tables = self._tables()
        return {"words": None, "tables": self.tables, "plain": None}

    def __setstate__(self, state):
        super().__setstate__(state)
        self.chunks = None

    def _tables(self) -> dict:
        """The probabilities as arrays over the vocabulary, and over pairs of its words in order."""
        names = [*SHAPES, *sorted(self.words - set(SHAPES))]
        ids, size = {x: i for i, x in enumerate(names)}, len(names)
        column = lambda c, key=lambda x: x: np.array([c.get(key(x), 0) for x in names], float)
        p1 = (column(self.c1) + 0.5) / (self.n1 + 0.5 * (self.k1 + 1))
        n2, ended, t2 = column(self.n2), column(self.c2, lambda v: (v, EDGE)), column(self.t2)
        first = (self.c1.get(EDGE, 0) + 0.5) / (self.n1 + 1)
        edge2 = (ended + 2 * first) / (n2 + 2)
        n3, ended3, t3 = column(self.n3, lambda v: (EDGE, v)), column(self.c3, lambda v: (EDGE, v, EDGE)), column(self.t3, lambda v: (EDGE, v))
        pairs: dict[int, list[float]] = {}
        for i, counts, key in ((0, self.n3, lambda k: k), (1, self.c3, lambda k: k[2] == EDGE and k[:2]), (2, self.c2, lambda k: k), (3, self.c3, lambda k: k[0] == EDGE and k[1:])):
            for k, n in counts.items():
                if k := key(k):
                    pairs.setdefault(ids[k[0]] * size + ids[k[1]], [0.0] * 4)[i] = n
        keys = np.array(sorted(pairs), np.int64)
        values = np.array([*(pairs[k] for k in keys.tolist()), [0.0] * 4], np.float32)
        own = np.array([self.c2.get((EDGE, w), 0) for w in names], float)
        n = n2[0] - ended[0]
        start = (own + t2[0] * p1) / (n + t2[0]) if n > 0 else p1
        ratio = {(0, _SPACE): LOST, (1, _JOINED): LOST}
        for s in (0, 1):
            within, ending = [max(1, sum(n[i] for (x, _), n in self.signs.items() if x == s)) for i in (0, 1)]
            for (z, x), (a, b) in self.signs.items():
                if z == s:
                    r = (b / ending or 0.01 / (ending + 1)) * (within + 1) / (a + 1)
                    ratio[s, x] = max(r, LOST) if x in (_SPACE, _JOINED) else r if b else min(r, LOST)
        within = [sum(n[0] for (_, x), n in self.signs.items() if x == _OPENED), sum(n[0] for n in self.signs.values())]
        opening = (self.heads[_OPENED] + 0.1) / (self.heads.total() + 1) * (within[1] + 1) / (within[0] + 1)
        ratio |= {(0, _OPENED): ratio[0, _SPACE] * opening, (1, _OPENED): ratio[1, _JOINED] * opening}
        return dict(names=names, p1=p1, edge2=edge2, left=n2 - ended, t2=t2, edge1=(ended3 + 0.1 * edge2) / (n3 + 0.1), left3=n3 - ended3, t3=t3, start=start, keys=keys, values=values, ratio=ratio, opening=opening)

    def _factors(self, gaps: Gaps) -> tuple[np.ndarray, ...]:
        """Of each gap the probability of an event and of the next word without one, after no boundary and after one; and of the next word after an event."""
        t, g = self.tables, gaps.gap
        v, w = gaps.word[g - 1], gaps.word[g]
        pair = np.full(len(gaps.word), len(t["keys"]))
        if len(t["keys"]):
            key = v * len(t["names"]) + w
            at = np.searchsorted(t["keys"], key)
            at[at == len(t["keys"])] = 0
            pair[g] = np.where(t["keys"][at] == key, at, len(t["keys"]))
        before, here = t["values"][pair[g - 1]], t["values"][pair[g]]  # of the two words before the gap, and the two beside it
        e0 = (before[:, 1] + 0.1 * t["edge2"][v]) / (before[:, 0] + 0.1)
        e1 = t["edge1"][v]
        mixed = lambda n, left, more, less: np.where(left > 0, (n + more * less) / np.maximum(left + more, 1), less)
        q0 = mixed(here[:, 2], t["left"][v], t["t2"][v], t["p1"][w])
        q1 = mixed(here[:, 3], t["left3"][v], t["t3"][v], q0)
        code = gaps.between * 2 + gaps.unspaced
        kinds, of = np.unique(code, return_inverse=True)
        odds = np.array([t["ratio"].get((k % 2, k // 2), LOST) for k in kinds.tolist()])[of] if len(kinds) else np.ones(0)
        odds = np.where(gaps.closed, 0, np.where(gaps.bare[g], np.where(gaps.into, t["opening"], 1), odds))
        e0, e1 = (e * odds / (e * odds + 1 - e) for e in (np.minimum(e0, 1 - 1e-9), np.minimum(e1, 1 - 1e-9)))
        return e0, e1, q0, q1, t["start"][w]

    def boundaries(self, gaps: Gaps) -> np.ndarray:
        """Posterior of a boundary in each gap, by forward-backward over all sentences at once."""
        e0, e1, q0, q1, qb = self._factors(gaps)
        n = len(e0)
        to00, to10, to01, to11 = (1 - e0) * q0, (1 - e1) * q1, e0 * qb, e1 * qb
        head = np.flatnonzero(np.diff(gaps.sentence[gaps.gap], prepend=-1))
        size = np.diff(head, append=n)
        order = np.argsort(-size, kind="stable")
        head, size = head[order], size[order]
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right") if n else []
        f0, f1 = np.zeros(n), np.zeros(n)
        a0, a1 = np.zeros(len(head)), np.ones(len(head))
        for step, m in enumerate(active):
            i = head[:m] + step
            x0, x1 = a0[:m], a1[:m]
            y0, y1 = x0 * to00[i] + x1 * to10[i], x0 * to01[i] + x1 * to11[i]
            z = np.maximum(y0 + y1, 1e-300)
            a0, a1 = y0 / z, y1 / z
            f0[i], f1[i] = a0, a1
        b0, b1, out = np.ones(len(head)), np.ones(len(head)), np.zeros(n)
        for step in range(len(active) - 1, -1, -1):
            m = active[step]
            i = head[:m] + step
            x0, x1 = b0[:m], b1[:m]
            one = f1[i] * x1
            out[i] = one / np.maximum(f0[i] * x0 + one, 1e-300)
            y0, y1 = to00[i] * x0 + to01[i] * x1, to10[i] * x0 + to11[i] * x1
            z = np.maximum(y0 + y1, 1e-300)
            b0[:m], b1[:m] = y0 / z, y1 / z
        return out

    def read(self, rows: list[tuple], starts: list[list[int]]) -> Gaps:
        if self.tables is None:
            self.tables = self._tables()
        if self.chunks is None:
            self.words = set(self.tables["names"][len(SHAPES) :])
            self.chunks = Chunks({x: i for i, x in enumerate(self.tables["names"])}, self.shape)
        return Gaps(self.chunks, rows, starts)

    def split(self, rows: list[tuple], starts: list[list[int]]) -> Iterator[tuple[int, int]]:
        """(row, position) of the boundaries that this model finds within the sentences of the first model."""
        gaps = self.read(rows, starts)
        for gap in np.flatnonzero(self.boundaries(gaps) > 0.5).tolist():
            yield gaps.position(rows, gap)


class Signs:
    """What needs no model: words that do not, or may or may not, end a sentence before a period."""

    def __init__(self, found: set[str], either: set[str], ending: set[str]):
        self.found, self.either, self.ending = found, either, ending

    def mark(self, guess: int, word: str | None, nxt: str, kind: str) -> int:
        if word in self.found:
            return 0
        if word in self.either and kind == "w":
            if nxt[0].islower():
                return 0
            if word in ABBREVIATIONS and word in self.ending and nxt[0].isupper():
                return 1
        return guess


_COUNTED = pa.schema([("key", pa.string()), ("n", pa.int64())])
_GRAMS = pa.schema([("u", pa.string()), ("v", pa.string()), ("w", pa.string()), ("n", pa.int64())])
_FOUND = ["text", "own", "keys", "at", "held"]


def _flushed(c: Counter, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*((*(k if isinstance(k, tuple) else (k,)), n) for k, n in c.items()))) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    kind = {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint", pa.list_(pa.string()): "array<string>", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{f.name} {kind[f.type]}" for f in schema)


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) with what ``scan`` finds in each text; texts without a visible character are left out."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                texts = part.column(1).to_pylist()
                seen = [bool(_VISIBLE.search(t)) for t in texts]
                part = part.filter(pa.array(seen, pa.bool_()))
                found = [scan(t) for t, x in zip(texts, seen) if x]
                ints = lambda i: pa.array([f[i] for f in found], pa.list_(pa.int32()))
                strings = lambda i: pa.array([_S.join(f[i]) for f in found], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, ints(0), strings(1), ints(2), ints(3), strings(4)], names=["id", *_FOUND, "more"])

    x = docs.where("text is not null").mapInArrow(run, f"id {id_type}, text string, own array<int>, keys string, at array<int>, held array<int>, more string")
    return x.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.md5("text"))


def _lists(column: pa.Array) -> list[list[int]]:
    flat, ends = column.flatten().to_pylist(), column.offsets.to_pylist()
    return [flat[a - ends[0] : e - ends[0]] for a, e in zip(ends, ends[1:])]


def _rows(b: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Text and findings of each row of ``_FOUND``, in lists of texts with about ``AT_ONCE`` characters."""
    out, size = [], 0
    for text, own, keys, at, held in zip(b.column(0).to_pylist(), _lists(b.column(1)), b.column(2).to_pylist(), _lists(b.column(3)), _lists(b.column(4))):
        if out and size + len(text) > AT_ONCE:
            yield out
            out, size = [], 0
        out.append((text, own, keys.split(_S) if keys else [], at, held))
        size += len(text)
    if out:
        yield out


def stretches(texts: DataFrame) -> DataFrame:
    """(key, n): how often each stretch, or word before a period, occurs in ``texts`` (keys, more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for column in b.columns:
                for x in column.to_pylist():
                    if x:
                        c.update(x.split(_S))
                    if len(c) > FLUSH:
                        yield _flushed(c, _COUNTED)
                        c.clear()
        yield _flushed(c, _COUNTED)

    return texts.select("keys", "more").mapInArrow(run, _ddl(_COUNTED)).groupBy("key").agg(F.sum("n").alias("n"))


def _first(df: DataFrame, by: str, k: int, *keys: str) -> list[tuple]:
    """The ``k`` rows with the largest ``by``."""
    return list(zip(*(x.to_pylist() for x in df.orderBy(F.desc(by), *keys).limit(k).toArrow().columns)))


def _column(df: DataFrame, by: str, k: int, name: str) -> list[str]:
    return [x[0] for x in _first(df.select(name, by), by, k, name)]


def signs(found: DataFrame) -> Signs:
    """Counted over all stretches; each set has at most ``WORDS`` words, the most frequent."""
    field = F.split("key", _F)
    told = found.select("n", field[0].alias("word"), field[1].alias("kind"), field[2].alias("is")).where("kind = '!'")
    is_ = lambda i: F.sum(F.when(F.substring("is", i, 1) == "1", F.col("n")).otherwise(0))
    words = cut(told.groupBy("word").agg(F.sum("n").alias("before_dot"), is_(1).alias("at_end"), is_(2).alias("lower_next")))
    total = words.agg(F.sum("at_end").alias("a"), F.sum("before_dot").alias("b")).first()
    rate = (total["a"] or 0) / max(1, total["b"] or 0)
    most = lambda where: set(_column(words.where(where).select("word", "before_dot"), "before_dot", WORDS, "word"))
    # Words that often stand before a period but never at the end of a paragraph; words that also end paragraphs, but mostly
    # have a small letter after the period, may or may not end a sentence.
    either = "lower_next > 0.25 * before_dot and before_dot >= 5"
    return Signs(most((F.col("before_dot") > 0) & (F.col("at_end") == 0) & (F.col("before_dot") * rate >= 4)), most(either), most(f"{either} and at_end > 0"))


def vocabulary(found: DataFrame) -> set[str]:
    """Words that stand at least ``RARE`` times in stretches, at most ``WORDS``, the most frequent."""
    field = F.split("key", _F)
    x = found.select("n", F.split(field[0], _T).alias("tok"), field[1].alias("kind")).where("kind <> '!'")
    x = x.select("n", F.explode(F.expr("transform(tok, (t, i) -> named_struct('t', t, 'k', substring(kind, i + 1, 1)))")).alias("x")).where("x.k in ('w', 'u')")
    return set(_column(x.groupBy(F.col("x.t").alias("word")).agg(F.sum("n").alias("n")).where(F.col("n") >= RARE), "n", WORDS, "word"))


def shaped(found: DataFrame, known: Signs, words: set[str]) -> DataFrame:
    """(tok, at, mark, n): distinct stretches with rare words as shapes, and first events."""
    own = found.sparkSession.sparkContext.broadcast((known, Model(words)))  # bounded by WORDS
    schema = pa.schema([("tok", pa.list_(pa.string())), ("at", pa.list_(pa.int32())), ("mark", pa.list_(pa.int32())), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = own.value
        c: Counter = Counter()
        for b in batches:
            for key, n in zip(*(x.to_pylist() for x in b.columns)):
                tok, kind, at, *more = key.split(_F)
                if kind == "!":
                    continue
                tok, at = tok.split(_T), tuple(map(int, at.split()))
                marks = tuple([known.mark(int(g), w, tok[i], kind[i]) for i, g, w in zip(at, more[0], more[1].split(_T))])
                c[tuple(map(model.shape, tok, kind)), at, marks] += n
            if len(c) > FLUSH:
                yield _flushed(c, schema)
                c.clear()
        yield _flushed(c, schema)

    return found.mapInArrow(run, _ddl(schema)).groupBy("tok", "at", "mark").agg(F.sum("n").alias("n"))


def _fill(model: Model, c3: DataFrame, c2: DataFrame) -> Model:
    """``model`` with the most frequent ``TRIPLES`` and ``PAIRS`` of the counts."""
    same: dict[str, str] = {}
    one = lambda x: same.setdefault(x, x)
    sums = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("t"))
    for u, v, n, t in _first(sums(c3, "u", "v"), "n", PAIRS, "u", "v"):
        model.n3[one(u), one(v)], model.t3[u, v] = n, t
    for u, v, w, n in _first(c3.select("u", "v", "w", "n"), "n", TRIPLES, "u", "v", "w"):
        if (u, v) in model.n3:
            model.c3[one(u), one(v), one(w)] = n
    for v, n, t in _first(sums(c2, "v"), "n", PAIRS, "v"):
        model.n2[one(v)], model.t2[v] = n, t
    for v, w, n in _first(c2.select("v", "w", "n"), "n", TRIPLES, "v", "w"):
        if v in model.n2:
            model.c2[one(v), one(w)] = n
    c1 = c2.groupBy("w").agg(F.sum("n").alias("n"))
    for w, n in _first(c1, "n", PAIRS, "w"):
        model.c1[one(w)] = n
    total = c1.agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
    model.n1, model.k1 = total["n"] or 0, total["k"]
    return model


def _estimate(found: DataFrame, words: set[str], before: Model | None) -> Model:
    """A model from the first events, or those that the model before sees, in all stretches."""
    own = found.sparkSession.sparkContext.broadcast(before)  # bounded by WORDS, PAIRS and TRIPLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = own.value
        c: Counter = Counter()
        for b in batches:
            for tok, at, mark, n in zip(*(x.to_pylist() for x in b.columns)):
                if at and model is not None:
                    mark = [int(q > 0.5) for q in model.posteriors(tuple(tok), tuple(at))]
                here, s = {i for i, x in zip(at, mark) if x}, []
                for i, x in enumerate(tok):
                    if i in here:
                        s.append(EDGE)
                    s.append(x)
                for k in zip(s, s[1:], s[2:]):
                    c[k] += n
            if len(c) > FLUSH:
                yield _flushed(c, _GRAMS)
                c.clear()
        yield _flushed(c, _GRAMS)

    c3 = cut(found.mapInArrow(run, _ddl(_GRAMS)).groupBy("u", "v", "w").agg(F.sum("n").alias("n")))
    model = _fill(Model(words), c3, c3.groupBy("v", "w").agg(F.sum("n").alias("n")))
    own.unpersist()
    return model


def plain_vocabulary(texts: DataFrame) -> set[str]:
    """Words that stand at least ``RARE`` times in all of ``texts``, at most ``WORDS``, the most frequent."""

    def words(c: Counter) -> pa.RecordBatch:
        out: Counter = Counter()
        for chunk, n in c.items():
            for m in _TOKEN.finditer(chunk):
                if m.lastgroup in "wu":
                    out[m.group()] += n
        return _flushed(out, _COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                c.update(text.split())
                if len(c) > FLUSH:
                    yield words(c)
                    c.clear()
        yield words(c)

    counted = texts.select("text").mapInArrow(run, _ddl(_COUNTED)).groupBy("key").agg(F.sum("n").alias("n"))
    return set(_column(counted.where(F.col("n") >= RARE), "n", WORDS, "key"))


class _Sums:
    """Counts of numbers, kept as sorted arrays."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > FLUSH and len(self.parts) > 8:
            self.parts = [self.take()]
            self.size = len(self.parts[0][0])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, of = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, of, np.concatenate([x for _, x in self.parts]))
        self.parts, self.size = [], 0
        return keys, n


#: Stands for the first word in rows that count what stands between words.
_BETWEEN = "\x1c"


def train_unpunctuated(texts: DataFrame, model: Model) -> Unpunctuated:
    """The model of text without signs, from the sentences of all ``texts`` (``_FOUND``); a block without terminators is one sentence.

    Of pairs all are counted, of triples those with a boundary (after two words, or before the first of two); u is null in pairs.
    """
    words = plain_vocabulary(texts)
    own = texts.sparkSession.sparkContext.broadcast((model, Unpunctuated(words)))  # bounded by WORDS, PAIRS and TRIPLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, plain = own.value
        pairs, begun, ended, within, tails, heads = sums = [_Sums() for _ in range(6)]
        size = len(plain.tables["names"])
        names = pa.array(plain.tables["names"], pa.string())

        def flushed() -> Iterator[pa.RecordBatch]:
            word = lambda ids: names.take(pa.array(ids))
            fixed = lambda x, k: pa.array([x] * len(k), pa.string())
            for s, columns in (
                (pairs, lambda k: (fixed(None, k), word(k // size), word(k % size))),
                (begun, lambda k: (fixed(EDGE, k), word(k // size), word(k % size))),
                (ended, lambda k: (word(k // size), word(k % size), fixed(EDGE, k))),
                (within, lambda k: (fixed(_BETWEEN, k), pa.array(map(str, k.tolist()), pa.string()), fixed("0", k))),
                (tails, lambda k: (fixed(_BETWEEN, k), pa.array(map(str, k.tolist()), pa.string()), fixed("1", k))),
                (heads, lambda k: (fixed(_BETWEEN, k), pa.array(map(str, k.tolist()), pa.string()), fixed("2", k))),
            ):
                k, n = s.take()
                yield pa.RecordBatch.from_arrays([*columns(k), pa.array(n)], schema=_GRAMS)

        for b in batches:
            for rows in _rows(b):
                gaps = plain.read(rows, [model.decide(o, k, at) for _, o, k, at, _ in rows])
                w, g, first = gaps.word, gaps.gap, np.flatnonzero(gaps.begin)
                final = np.append(first[1:], len(w)) - 1 if len(w) else first
                pairs.add(w[g - 1] * size + w[g])
                pairs.add(w[first])  # EDGE is number 0
                pairs.add(w[final] * size)
                more = final > first
                begun.add(w[first] * size + np.where(more, w[np.minimum(first + 1, max(0, len(w) - 1))], 0))
                ended.add(w[final[more] - 1] * size + w[final[more]])
                told = ~gaps.bare[g] & ~gaps.closed
                within.add(gaps.between[told] * 2 + gaps.unspaced[told])
                tails.add(gaps.tail[1] * 2 + gaps.tail[0])
                heads.add(gaps.head * 2)
            if sum(s.size for s in sums) > 4 * FLUSH:
                yield from flushed()
        yield from flushed()

    every = cut(texts.select(*_FOUND).mapInArrow(run, _ddl(_GRAMS)).groupBy("u", "v", "w").agg(F.sum("n").alias("n")))
    grams = every.where(F.col("u").isNull() | (F.col("u") != _BETWEEN))
    plain = _fill(Unpunctuated(words), grams.where("u is not null"), grams.where("u is null").select("v", "w", "n"))
    for u, v in list(plain.n3):  # what follows two words was counted at boundaries only; their own number is that of the pair
        if u != EDGE:
            plain.n3[u, v] = max(plain.n3[u, v], plain.c2.get((u, v), 0))
    for r in every.where(F.col("u") == _BETWEEN).collect():  # at most three rows for each sign there is
        unspaced, what = int(r.v) % 2, int(r.v) // 2
        if r.w == "2":
            plain.heads[what] += r.n
        else:
            plain.signs.setdefault((unspaced, what), [0, 0])[int(r.w)] += r.n
    own.unpersist()
    return plain


def train(found: DataFrame) -> Model:
    """Fit both models to the distinct texts of ``found`` (as ``scanned`` gives it), without labels."""
    first = found.groupBy("digest").agg(F.min("row").alias("row")).select("row")
    texts = cut(found.join(first, "row", "left_semi").select(*_FOUND, "more"))
    counted = cut(stretches(texts))
    words = vocabulary(counted)
    distinct, model = cut(shaped(counted, signs(counted), words)), None
    for _ in range(ROUNDS + 1):
        model = _estimate(distinct, words, model)
    model.plain = train_unpunctuated(texts, model)
    return model


def spans(text: str, starts: list[int]) -> list[tuple[int, int]]:
    """(start, end) of the sentences from their starts, without outer blanks."""
    out = []
    for a, e in zip(starts, [*starts[1:], len(text)]):
        part = text[a:e]
        core = part.strip(BLANKS)
        if core:
            s = a + len(part) - len(part.lstrip(BLANKS))
            out.append((s, s + len(core)))
    return out


def sentences(text: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each sentence, without outer blanks; what lies between them is blank."""
    if not text or not _VISIBLE.search(text):
        return []
    return spans(text, model.decide_all([(text, *scan(text)[:4])])[0])


def sentence_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sent_start, sent_end): one row per sentence, in characters from 0, the end exclusive.

    Null, empty and blank texts and texts without a visible character have no rows; every other character that isn't blank
    lies in exactly one sentence. The model is fitted on all distinct texts.
    """
    x = require(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = x.schema["id"].dataType.simpleString()
    found = cut(scanned(spread(x)))
    model = docs.sparkSession.sparkContext.broadcast(train(found))  # bounded by WORDS, PAIRS and TRIPLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for b in batches:
            starts, ends, rows, i = [], [], [], 0
            for part in _rows(b):
                for (text, *_), at in zip(part, own.decide_all(part)):
                    for s, e in spans(text, at):
                        rows.append(i)
                        starts.append(s)
                        ends.append(e)
                    i += 1
            yield pa.RecordBatch.from_arrays([b.column(5).take(pa.array(rows, pa.int32())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["id", "sent_start", "sent_end"])

    return found.select(*_FOUND, "id").mapInArrow(run, f"id {id_type}, sent_start int, sent_end int").withColumnRenamed("id", id_col)
