"""Which characters of a subtitle text are keywords, links or product tags, line by line.

The words of speech of the page's language are given, as its curve of prose tells them.
Where it has none (known is false), a line is judged by its form and repeats alone.
"""

from __future__ import annotations

import re
from collections import Counter

_CUE = re.compile(r"\s*[\[{(]?\d{1,2}:\d\d(?::\d\d)?[.,:]\d{1,3}\b.*\d:\d\d|\s*\{\d+\}\{\d+\}")
#: The patterns are linear: what may be long is possessive and stops where the next match may begin.
_MARK = re.compile(r"</?\s*+(?:i|b|u|s|font|br|p|span)\b[^<>]*+>|\{\\[^{}]*+\}", re.I)
_PART = r"[^\s<>\"\[\](){}]"
#: A dot, also spelled out.
_APART = r"(?:\s\.\s|\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?|\sdot\s)"
_DOT = rf"(?:[.,]|{_APART})"
#: Whatever begins as an address, and bare domains with the dot spelled out.
_URL = re.compile(rf"(?:h(?:tt|xx)ps?\s?:?\s?//\s?|\bwww\s?{_DOT}?){_PART}*+(?:{_APART}{_PART}++)*+|(?<![\w-])[\w-]{{1,63}}(?:{_APART}[\w-]{{1,63}}){{0,4}}{_APART}[^\W\d_]{{2,24}}(?=[/\s]|$)(?:/{_PART}*+)?", re.I)
#: Bare domains by their structure, with any last label, where a blank, slash, separator or nothing follows.
_BARE = re.compile(rf"(?<![\w.@-])((?:[\w-]{{1,63}}\.){{1,126}})([a-zа-яё가-힣][A-Za-zА-яЁё가-힣]{{1,23}}|[A-Z]{{2,24}})(?=[\s/,;|)\]>\"»]|$)(?:/{_PART}*+)?")
_ANCHOR = re.compile(r"<a\s[^<>]++>|\[url[^\[\]]*+\]|\[[^\[\]]*+\]\([^)\[]", re.I)
#: Without this no address is in a line; it costs far less than the search for one.
_MAYBE = re.compile(rf"//|www|\[|<a|{_APART}\w|\w\.[^\W\d_]{{2}}", re.I)
_HASHTAG = re.compile(r"#[^\s\d#.,!?][^ \t#]*")
_GOODS = re.compile(r"\d[.,][\dOol]{2}\s?(?:€|\$|£|₩|USD|EUR|GBP|KRW|â‚¬|\S{1,6}$)|\bSKU\b|\b\d+\s?GB\b|-\s?\d+\s?%", re.I)
_SPLIT = re.compile(r"(?<![;•|·,!?.])[;•|·,!?.]++\s|\s[/\-–—|»«]\s|[;•|·]")
#: What a wrong encoding leaves of letters.
_LEFT = re.compile("[\x80-\u02ff\ufffd\u2000-\u25ff]+")
#: So many lines in a row without speech or a sentence's end are a list, whatever their words.
_RUN = 8
_ENDS = re.compile(r"[.!?…。][\"'»”)\]\s]*$|^\s*[-–—]")
_STRIP = " \t.,;:!?|•·*♪♫\"'()[]<>«»„“”-–—…/¿¡#"
_MUSIC = ("♪", "♫", "â™ª", "â\x99ª", "âª", "Ã¢Â\x99Âª", "Ã¢Â™Âª", "в™Є", "ΓÖ¬", "¢Ü")
#: A speaker's name before the words; lyrics whose notes became other signs, and sounds.
_SPEAKER = re.compile(r"^\s*(?:-\s*)?\w{1,30}\s?[|:]\s")
_SOUND = re.compile(r"^\s*(?:[?*#¶]\s|[\[(*].*[\])*]\W*$)")


def text_lines(text: str) -> list[tuple[str, int]]:
    """(line, number of the cue) without the numbers and times of cues."""
    out, cue = [], 0
    for line in re.split(r"\r\n|\r|\n|\u2028", text):
        line = line.replace("﻿", "").replace("​", "").strip()
        bare = line.strip("ï»¿ ")
        if not line or bare == "WEBVTT":
            continue
        if "-->" in line or (":" in line or line[0] == "{") and _CUE.match(line):
            cue += 1
            continue
        if bare.isdigit() or not (any(map(str.isalnum, bare)) or "\ufffd" in bare):
            continue
        out.append((line, cue))
    return out


class _Bare(dict):
    """A word as written -> in lower case, without signs around it."""

    def __missing__(self, x: str) -> str:
        out = x.strip(_STRIP).lower()
        if len(self) > 200_000:  # starts anew, with the same results
            self.clear()
        if len(x) < 64:
            self[x] = out
        return out


_bare = _Bare()


def _words(s: str) -> list[str]:
    return [w for w in map(_bare.__getitem__, s.split(" ")) if w]


def _speech(words: list[str], speech: frozenset) -> float:
    return sum(w in speech for w in words) / len(words) if words else 0.0


def _site(m: re.Match, speech: frozenset) -> bool:
    """False where a blank is missing after a sentence, as words of speech on both sides or a longer one after the dot tell."""
    before, last = m[1].lower().split(".")[-2], m[2].lower()
    return any(map(str.isalpha, before)) and not (last in speech and (len(last) > 2 or before in speech))


def _may_link(line: str) -> bool:
    """Most spoken lines have none of the signs of an address, or a dot at their end only."""
    low = line.lower()
    if not ("." in low[:-2] or "//" in low or "[" in low or "(" in low or "{" in low or "<a" in low or "www" in low or " dot " in low):
        return False
    return _MAYBE.search(line) is not None


def _link(line: str, speech: frozenset) -> bool:
    """A list entry with a link, not speech or a credit that names a site."""
    if _ANCHOR.search(line):
        return True
    found = _URL.findall(line)
    rest = _URL.sub(" ", line)
    if "." in rest:
        bare = [m for m in _BARE.finditer(rest) if _site(m, speech)]
        found += [m[0] for m in bare]
        for m in reversed(bare):
            rest = f"{rest[: m.start()]} {rest[m.end() :]}"
    if not found:
        return False
    rest = _words(rest)
    if len(found) > 1 and len(rest) <= 3 * len(found):
        return True
    if line.rstrip("♪ </i>").endswith("?") and "//" not in line and len(rest) <= 2:
        return False  # somebody is asked about a site
    return len(rest) <= 4 and sum(w in speech for w in rest) * 3 < max(1, len(rest))


def _parts(line: str) -> list[str]:
    """Two speakers' sentences put into one line count apiece."""
    if "/" not in line and "<br" not in line:
        return [line]
    parts = re.split(r"\s/\s|<br\s*/?>", line)
    return parts if 1 < len(parts) <= 3 else [line]


def _repeats(words: list[str]) -> float:
    return 1 - len(set(words)) / len(words) if words else 0.0


def broken(text: str) -> bool:
    """True if the letters are mostly those that a wrong encoding leaves, so that words of speech can't be known."""
    bad = len(text) - len(_LEFT.sub("", text))
    return bad > 0.3 * max(1, sum(map(str.isalpha, text)))


def classify(line: str, speech: frozenset = frozenset(), unreadable: bool = False) -> str:
    """link, tags, goods, list (several items without speech), item (one short item without speech) or speech.

    unreadable: a list then needs twice the words, as the words of speech don't tell.
    """
    if _may_link(line) and _link(line, speech):
        return "link"
    tags = _HASHTAG.findall(line) if "#" in line else ()
    if len(tags) >= 2 and sum(map(len, tags)) > 0.6 * len(line.replace(" ", "")):
        return "tags"
    plain = _MARK.sub(" ", line) if "<" in line or "{" in line else line
    bare = _SPEAKER.sub("", plain)
    words = _words(bare)
    spoken = _speech(words, speech)
    if spoken >= 0.2:
        return "speech"
    if len(words) >= 3 and _GOODS.search(plain):
        return "goods"
    if any(m in line for m in _MUSIC) or _SOUND.search(bare):
        return "speech"
    items = [x for x in _SPLIT.split(plain) if x.strip(_STRIP)]
    if len(words) >= (12 if unreadable else 6) and spoken < 0.15 and _repeats(words) >= 0.15:
        return "list"
    if len(items) >= 4 and (not unreadable or len(items) >= 5 and _repeats(words) >= 0.15) and spoken < 0.1 and len(words) <= 5 * len(items) and len(set(map(str.lower, items))) > 1:
        return "list"
    return "item" if 0 < len(words) <= 6 else "speech"


def _in_list(part: str, speech: frozenset) -> bool:
    """True if a short item has no word of speech and neither ends nor begins like a spoken line."""
    return not _ENDS.search(part) and not any(w in speech for w in _words(part))


def _is_list(run: list[str]) -> bool:
    """Whether items in a row are a list: several words apiece, or different single words, so that called or echoed words are none."""
    words = [w for p in run for w in _words(p)]
    return len(run) >= _RUN and (len(words) >= 2 * len(run) and len(set(run)) > 0.5 * len(run) or _repeats(words) < 0.1)


def spam_share(text: str | None, speech: frozenset = frozenset(), known: bool = True) -> float:
    """Share of the text's characters, cue numbers and times aside, in lines of keywords, links or product tags."""
    if not text:
        return 0.0
    whole, spam = 0, 0
    unreadable = not known or broken(text)
    if text.count("?") > 0.2 * len(text):  # letters became question marks: runs of them stand for words
        text, unreadable = re.sub(r"\?{2,}", lambda m: "x" * len(m[0]), text), True
    items: list[tuple[str, int]] = []
    runs: list[list[int]] = [[]]  # places in items of those that follow each other without a line of speech
    for line, cue in text_lines(text):
        for part in _parts(line):
            n = len(part)
            whole += n
            kind = classify(part, speech, unreadable)
            if kind == "item":
                if unreadable or not _in_list(part, speech):
                    runs.append([])
                else:
                    runs[-1].append(len(items))
                items.append((part, cue))
            elif kind != "speech":
                spam += n
            else:
                runs.append([])
    # Short items are keywords only where they stand in lists: many in a row,
    listed = {i for run in runs if _is_list([items[i][0] for i in run]) for i in run}
    # or many to a cue or of several words, and of few different words.
    per_cue = Counter(c for _, c in items)
    few = [i for i, (p, c) in enumerate(items) if per_cue[c] >= 4 or not unreadable and len(_words(_SPEAKER.sub("", p))) >= 3]
    words = [w for i in few for w in _words(items[i][0])]
    top = sum(v for _, v in Counter(words).most_common(10))
    if words and top >= (0.75 if unreadable else 0.5) * len(words) and _repeats(words) >= 0.3:
        listed.update(few)
    spam += sum(len(items[i][0]) for i in listed)
    return spam / whole if whole else 0.0
