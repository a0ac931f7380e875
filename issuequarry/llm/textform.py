"""One stored form for texts that look the same (problem 4).

Steps, each a function of what a reader sees and never of the stored variant:

1. compatibility normalization of width, ligature and font variants, decomposition, one kind of space and of line break;
   super- and subscripts, circled and fractional signs stay, since they look different;
2. deletion of ignorable characters (a joiner between two pictographs stays: it changes the picture);
3. every letter is read as its look-alike class (LOOKALIKES, and where a session is at hand the confusable letters of further scripts, lookalike.py); a word is a lattice of the members of the classes of its letters, and a
   Viterbi search takes the path with the best script-consistent character n-gram score. The stored member of a class
   never enters the score, so texts that look the same get the same path;
4. canonical composition.

A text whose classes all have an ASCII member, with no letter outside, is written in ASCII without a search.
"""

from __future__ import annotations

import re
import unicodedata

# Letters that look the same. Latin member first, then Cyrillic, Greek and Armenian ones, then variants that
# are never written in the consistent form.
LOOKALIKES = {
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ",
    "l": "ӏ", "o": "оοօ", "p": "р", "q": "ԛ", "s": "ѕ", "v": "ѵν", "w": "ԝ",
    "x": "х", "y": "у", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ",
    "H": "НΗ", "I": "ІӀΙ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν",
    "O": "ОΟՕ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ",
    "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
# Members that only stand in for their Latin letter.
STAND_INS = "ɡϲϳϹͿѵѴԛԝԜԁһҮӀ"

# Letters of the scripts other than Latin, for regular expressions.
RANGES = {
    "C": "\u0400-\u052f", "G": "\u0370-\u03e1\u03f0-\u03ff\u1f00-\u1fff", "A": "\u0530-\u058f", "K": "\u2c80-\u2cff\u03e2-\u03ef", "H": "\u13a0-\u13ff\uab70-\uabbf", "S": "\ua4d0-\ua4f7",
}
_MEMBERS = frozenset("".join(LOOKALIKES.values()))
SCRIPTS = "LCGAKHS"  # in this order where scores are equal
SWITCH = -12.0  # another script inside a word
PRIOR = 3.0  # the script that leads in the text

_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")


def script_of(ch: str) -> str:
    """L(atin), C(yrillic), G(reek), A(rmenian), K (Coptic), H (Cherokee), S (Lisu) or '' for other characters."""
    cp = ord(ch)
    if cp < 0x250 or 0x250 <= cp < 0x2B0 or 0x1E00 <= cp < 0x1F00:
        return "L" if ch.isalpha() else ""
    if 0x370 <= cp < 0x3E2 or 0x3F0 <= cp < 0x400 or 0x1F00 <= cp < 0x2000:
        return "G"
    if 0x400 <= cp < 0x530:
        return "C"
    if 0x530 <= cp < 0x590:
        return "A"
    if 0x2C80 <= cp < 0x2D00 or 0x3E2 <= cp < 0x3F0:
        return "K"
    if 0x13A0 <= cp < 0x1400 or 0xAB70 <= cp < 0xABC0:
        return "H"
    return "S" if 0xA4D0 <= cp < 0xA4F8 else ""


def rare(ch: str) -> bool:
    """A Cyrillic or Greek letter outside the common alphabets: it may stand for its class, but no word is read with it."""
    s = script_of(ch)
    return s == "C" and not 0x410 <= ord(ch) <= 0x45F or s == "G" and not 0x386 <= ord(ch) <= 0x3CE


def is_pictograph(cp: int) -> bool:
    return 0x1F000 <= cp < 0x1FB00 or 0x2600 <= cp < 0x27C0 or cp == 0x2642 or cp == 0x2640


def fold_point(cp: int) -> str:
    """What one code point folds to: decomposed, '' if it is ignorable."""
    ch = chr(cp)
    cat = unicodedata.category(ch)
    if cp in (0x0A, 0x09):
        return ch
    if cp in (0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029):
        return "\n"
    if cat == "Zs":
        return " "
    if cp in (0x2010, 0x2011):
        return "-"
    if cat == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
        return ""
    d = unicodedata.decomposition(ch)
    if not d:
        return unicodedata.normalize("NFD", ch)
    if d[0] == "<" and ch in _MEMBERS:
        return ch
    if d[0] == "<":
        tag, rest = d.split(" ", 1)
        if tag in _TAGS or tag == "<compat>" and (cat[0] == "L" or cat == "Nl") and not 0x3131 <= cp <= 0x318E:
            return "".join(fold_point(int(x, 16)) for x in rest.split())
        return ch
    return "".join(fold_point(int(x, 16)) for x in d.split())


class _Fold(dict):
    """str.translate table, filled as code points turn up (at most one entry each)."""

    def __missing__(self, cp: int) -> str:
        self[cp] = v = fold_point(cp)
        return v


class ConsistentForm:
    """A callable from text to its consistent form. bigrams: log scores of letter pairs by script, or None for script consistency alone."""

    def __init__(self, bigrams: dict[str, float] | None = None, more: dict[str, str] | None = None):
        """more: further members by class, or classes without a Latin member (first member as their name)."""
        self.bigrams, self.more = bigrams, more or {}
        self.start()

    def start(self) -> None:
        self.fold, self.words = _Fold(), {}
        self.proto, self.readings = {}, {}
        for table in (LOOKALIKES, self.more):
            for first, others in table.items():
                own = self.readings.setdefault(first, [(script_of(first), first)])
                for o in others:
                    self.proto[ord(o)] = first
                    if o not in STAND_INS and (table is LOOKALIKES or not rare(o)):
                        own.append((script_of(o), o))
        self.joined = re.compile("(?<=[\u2600-\u27bf\U0001f000-\U0001faff\u2640\u2642\ufe0f])\u200d(?=[\u2600-\u27bf\U0001f000-\U0001faff\u2640\u2642])")
        self.word = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036f])*")
        self.spelt = re.compile(f"[{''.join(RANGES.values())}]")
        self.can: dict[str, frozenset[str]] = {}
        ascii_ = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
        spelt = {c: {s for s, _ in self.readings.get(c, ())} for c in ascii_}
        self.not_in = {s: re.compile("[" + "".join(c for c in ascii_ if s not in spelt[c]) + "ßłŁøđıæœ]") for s in RANGES}  # Latin letters that a script lacks
        self.latin_only = re.compile("[" + "".join(c for c in ascii_ if not spelt[c] & {"C", "G"}) + "ßłŁøđıæœ]")

    def __getstate__(self) -> dict:
        return {"bigrams": self.bigrams, "more": self.more}

    def __setstate__(self, s: dict) -> None:
        self.__init__(s["bigrams"], s["more"])

    def classes(self, text: str) -> str:
        """Steps 1 and 2, then every letter as the first member of its look-alike class: equal exactly for texts that look the same."""
        if text.isascii() and not any(c in text for c in "\r\x0b\x0c\x1c\x1d\x1e\x1f"):
            return text
        text = text.replace("\r\n", "\n")
        if "\u200d" in text:
            text = self.joined.sub("\ue000", text)
        text = text.translate(self.fold)
        if "\ue000" in text:
            text = text.replace("\ue000", "\u200d")
        return text if text.isascii() else unicodedata.normalize("NFD", text).translate(self.proto)

    def spellers(self, word: str) -> frozenset[str]:
        """The scripts other than Latin that can spell all letters of a word that Latin can't; those of its first such letter if none can."""
        if (known := self.can.get(word)) is None:
            each = [frozenset(s for s, _ in self.readings.get(c) or [(script_of(c), c)]) - {"L"} for c in word if self.spelt.match(c)]
            if len(self.can) > 500_000:
                self.can.clear()
            known = self.can[word] = frozenset.intersection(*each) or each[0]
        return known

    def leading(self, classes: str) -> str:
        """The script that can spell the most words which Latin can't, if these are no fewer than the words that only Latin can spell; else Latin."""
        n = dict.fromkeys(RANGES, 0)
        latin = []
        for w in self.word.findall(classes):
            if w.isascii() or not self.spelt.search(w):
                latin.append(w)
            else:
                for s in self.spellers(w):
                    n[s] += 1
        best = max(RANGES, key=lambda s: n[s])
        return best if n[best] > 0 and n[best] >= sum(bool(self.not_in[best].search(w)) for w in latin) else "L"

    def read(self, word: str, leading: str) -> str:
        """The best path through the lattice of one word of classes."""
        layers = [self.readings.get(c) or [(script_of(c), c)] for c in word]
        if all(len(x) == 1 for x in layers):
            return word
        score = self.bigrams
        best: list[tuple[float, str, str, str]] = [(PRIOR if s == leading else 1.0 if s == "L" else 0.0, s, c, c) for s, c in layers[0]]
        for layer in layers[1:]:
            step = []
            for s, c in layer:
                if not s:  # marks and letters of other scripts go with any path
                    step += [(v, ps, pc, path + c) for v, ps, pc, path in best]
                    continue
                found = None
                for v, ps, pc, path in best:
                    if ps and ps != s:
                        v += SWITCH
                    elif score is not None:
                        v += score.get(pc + c, score["other"])
                    if found is None or v > found[0]:
                        found = (v, s, c, path + c)
                step.append(found)
            best = step
        return max(best, key=lambda x: (x[0], -SCRIPTS.index(x[1] or "S"), x[3]))[3]

    def __call__(self, text: str) -> str:
        c = self.classes(text)
        if c.isascii():
            return c
        leading = self.leading(c)
        if len(self.words) > 500_000:
            self.words.clear()
        seen = self.words

        def one(m: re.Match) -> str:
            key = (m[0], leading)
            if (r := seen.get(key)) is None:
                seen[key] = r = self.read(*key)
            return r

        return unicodedata.normalize("NFC", self.word.sub(one, c))


def count_bigrams(texts, form: ConsistentForm, counts: dict[str, int]) -> None:
    """Adds the letter pairs of words that one script alone can spell; the stored words are read by script consistency."""
    for t in texts:
        if not t:
            continue
        c = form(t)
        for w in form.word.findall(unicodedata.normalize("NFD", c)):
            if w.isascii():
                if not form.latin_only.search(w):
                    continue
            elif not (form.spelt.search(w) or form.latin_only.search(w)):
                continue
            for i in range(len(w) - 1):
                a, b = w[i], w[i + 1]
                if script_of(a) and script_of(a) == script_of(b):
                    counts[a + b] = counts.get(a + b, 0) + 1
