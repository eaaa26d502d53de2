"""What a reader sees of a page written in wiki markup, as streams of text.

A page becomes one main stream and one stream for each place whose text stands
apart from the text around it: an argument of a template, a footnote, the caption of
a file. Within a stream the text reads on across what the reader doesn't see as
part of it: comments, formatting, link targets, footnotes and templates.

One pass over the markup with a stack; every character is looked at a bounded number of
times, whatever the page holds. Markup that is never closed (cut pages) ends with
the page: nothing of its text is lost.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

# Tags that the wiki renders, namespaces whose links show nothing or only a caption.
_BLOCK_TAGS = "br|p|div|li|ul|ol|dl|dt|dd|tr|td|th|table|caption|thead|tbody|h[1-6]|hr|blockquote|center|poem|pre|gallery|references"
_INLINE_TAGS = (
    "b|i|u|s|em|strong|small|big|sup|sub|span|font|tt|code|cite|q|abbr|del|ins|mark|kbd|var|samp|bdi|bdo|strike|wbr|ruby|rb|rt|rp|rtc|data|time|"
    "nowiki|includeonly|noinclude|onlyinclude|section|syntaxhighlight|source|math|chem|score|timeline|imagemap|templatestyles|langconvert|translate|tvar"
)
_HIDDEN_NAMESPACES = "category|kategorie|catégorie|categoría|categoria"
_FILE_NAMESPACES = "file|image|media|datei|bild|fichier|archivo|imagen"

# Where markup can begin; everything between is text and isn't looked at again. A line break counts where a table may begin or go on.
_SPECIAL = re.compile(r"<(?=[!/a-zA-Z])|\{\{|\}\}|\[\[|\[(?=https?:|ftp:|mailto:|//)|\]\]|''|\||!(?=!)|__(?=[A-Z])|\n(?=[ \t:]*\{\||[ \t]*[|!])", re.IGNORECASE)
_TOKEN = re.compile(
    r"""
      (?P<comment><!--(?s:.*?)(?:-->|\Z))
    | (?P<nowiki><nowiki\s*>)
    | (?P<refself><ref\b[^<>]*/\s*>)
    | (?P<refopen><ref(?:\s[^<>]*)?>)
    | (?P<refclose></ref\s*>)
    | (?P<block></?(?:%s)(?:\s[^<>]*)?/?>)
    | (?P<inline></?(?:%s)(?:\s[^<>]*)?/?>)
    | (?P<open>\{{2,})
    | (?P<close>\}{2,})
    | (?P<linkopen>\[\[)
    | (?P<linkclose>\]\])
    | (?P<url>\[(?:(?:https?|ftp)://|mailto:|//)[^\s\[\]]*)
    | (?P<quotes>'{2,})
    | (?P<sep>\|\||!!)
    | (?P<bar>\|)
    | (?P<magic>__[A-Z]+__)
    """
    % (_BLOCK_TAGS, _INLINE_TAGS),
    re.VERBOSE | re.IGNORECASE,
)
# Table markup at the start of a line; all but the first only inside a table.
_TABLE_OPEN = re.compile(r"[ \t:]*\{\|[^\n]*")
_TABLE_LINE = re.compile(r"[ \t]*(?:(?P<tableclose>\|\}(?!\}))|(?P<row>\|-[^\n]*)|(?P<cell>\|\+|\||!))")
_PAIR = r"""[\w:-]+\s*=\s*(?:"[^"\n]*"|'[^'\n]*'|[^\s|"'\[\]{}]+)"""
_ATTRIBUTES = re.compile(rf"\s*{_PAIR}(?:\s+{_PAIR})*\s*\|(?!\|)")
_NAME = re.compile(r"\s*[^\s=|{}\[\]<>]{1,40}(?:[ _-][^\s=|{}\[\]<>]{1,40}){0,2}\s*=")
_HIDDEN = re.compile(rf"\s*(?:{_HIDDEN_NAMESPACES})\s*:|[a-z]{{2,3}}(?:-[a-z]+)?:(?=\S)", re.IGNORECASE)
_FILE = re.compile(rf"\s*(?:{_FILE_NAMESPACES})\s*:", re.IGNORECASE)
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")

# Kinds of open markup on the stack.
_TEMPLATE, _PARAM, _LINK, _REF, _TABLE = range(5)


class _Stream:
    __slots__ = ("parts", "named")

    def __init__(self, named: bool = False) -> None:
        self.parts: list[str] = []
        self.named = named  # may begin with the name of an argument

    def text(self) -> str:
        t = "".join(self.parts)
        if self.named and (m := _NAME.match(t)):
            t = t[m.end() :]
        if "&" in t:
            t = html.unescape(t)
        return t if t.isascii() else unicodedata.normalize("NFC", _INVISIBLE.sub("", t))


def streams(page: str | None) -> list[str]:
    """The visible text of a page: the main stream first, the others in the order in which they begin."""
    return [t for i, t in enumerate(_read(page)[0]) if t and (i == 0 or not t.isspace())] if page else []


class Pieces:
    """Pages read paragraph by paragraph; a paragraph that leaves nothing open is read once, however many pages hold it.

    A page's streams are those of its pieces: the first texts of all pieces, with an empty line between them, are the main stream.
    """

    def __init__(self, made: Callable[[list[str]], object] = list, most: int = 50_000) -> None:
        self.made, self.most = made, most
        self.known: dict[str, object] = {}

    def __call__(self, page: str | None) -> list:
        """What ``made`` gives for the texts of each piece, the piece's part of the main stream first."""
        out: list = []
        if not page:
            return out
        parts, known = page.split("\n\n"), self.known
        for i, p in enumerate(parts):
            piece = known.get(p)
            if piece is None:
                if len(known) > self.most:
                    known.clear()
                texts, closed = _read(p) if _alone(p) else ([], False)
                piece = known[p] = self.made(texts) if closed else False
            if piece is False:  # something goes on after the paragraph: the rest of the page is one piece
                out.append(self.made(_read("\n\n".join(parts[i:]))[0]))
                break
            out.append(piece)
        return out


def _alone(paragraph: str) -> bool:
    """Whether no tag, comment or literal text can go on after the paragraph."""
    comment = paragraph.rfind("<!--")
    return paragraph.rfind("<") <= paragraph.rfind(">") and (comment < 0 or paragraph.find("-->", comment + 4) >= 0) and "nowiki" not in paragraph.lower()


def _read(page: str) -> tuple[list[str], bool]:
    """The texts of all streams, and whether all markup is closed at the end."""
    out = [_Stream()]
    # Each entry: kind, the stream to go back to, where in it the markup began, and for links the text of the target.
    stack: list[list] = []
    here = out[0]
    open_ = [0] * 5
    at = 0

    def enter(kind: int, began: int = 0) -> None:
        stack.append([kind, here, began, None])
        open_[kind] += 1

    def leave() -> None:
        nonlocal here
        kind, back, began, target = stack.pop()
        open_[kind] -= 1
        if kind == _LINK:
            _shown(back, began, target, out)
        elif kind == _TEMPLATE:
            here = back
            here.parts.append(" ")
        elif kind == _REF:
            here = back
            here.parts.append(" ")
        elif kind == _PARAM and target is None and _is_name(back.parts, began):
            del back.parts[began:]  # a parameter without a default shows nothing

    for special in _SPECIAL.finditer("\n" + page):
        start = special.start() - 1
        if start < at - (special.group() == "\n"):  # inside markup already read
            continue
        top = stack[-1][0] if stack else None
        if special.group() == "\n":
            start += 1
            if m := _TABLE_OPEN.match(page, start):
                kind = "tableopen"
            elif open_[_TABLE] and top == _TABLE and (m := _TABLE_LINE.match(page, start)):
                kind = m.lastgroup
            else:
                continue
        elif m := _TOKEN.match(page, start):
            kind = m.lastgroup
        else:
            continue
        if start > at:
            here.parts.append(page[at:start])
        at = m.end()
        if kind == "nowiki":
            if (end := page.find("</nowiki", at)) >= 0:
                here.parts.append(page[at:end])
                at = page.find(">", end) + 1 or len(page)
        elif kind in ("refself", "block", "sep"):
            if kind == "sep" and top == _TEMPLATE and m.group() == "||":
                here = _Stream(True)
                out.append(here)
            else:
                here.parts.append(" ")
                if kind == "sep" and open_[_TABLE] and (a := _ATTRIBUTES.match(page, at)):
                    at = a.end()
        elif kind == "refopen":
            enter(_REF)
            here.parts.append(" ")
            here = _Stream()
            out.append(here)
        elif kind == "refclose":
            if open_[_REF]:
                while stack[-1][0] != _REF:
                    leave()
                leave()
        elif kind == "open":
            n = len(m.group())
            pairs = {0: 0, 1: 2, 2: 1}[n % 3]  # runs are read as pairs first, then threes
            for _ in range(pairs):
                enter(_TEMPLATE)
                here.parts.append(" ")
                here = _Stream()
                out.append(here)
            for _ in range((n - 2 * pairs) // 3):
                enter(_PARAM, len(here.parts))
        elif kind == "close":
            n = len(m.group())
            while n >= 2 and open_[_TEMPLATE] + open_[_PARAM]:
                while stack[-1][0] not in (_TEMPLATE, _PARAM):
                    leave()
                n -= 3 if stack[-1][0] == _PARAM else 2
                leave()
        elif kind == "linkopen":
            enter(_LINK, len(here.parts))
        elif kind == "linkclose":
            if top == _LINK:
                leave()
        elif kind == "bar":
            while stack and stack[-1][0] in (_LINK, _PARAM) and stack[-1][3] is None and not _is_name(here.parts, stack[-1][2]):
                open_[stack.pop()[0]] -= 1  # never closed; what follows it is text
            frame = stack[-1] if stack else [None]
            if frame[0] == _TEMPLATE:
                here = _Stream(True)
                out.append(here)
            elif frame[0] not in (_LINK, _PARAM):
                here.parts.append(" ")
            elif frame[3] is None:
                frame[3] = "".join(here.parts[frame[2] :])
                del here.parts[frame[2] :]
            elif frame[0] == _LINK and _FILE.match(frame[3]):
                del here.parts[frame[2] :]  # an option of the file; the caption is last
            else:
                here.parts.append(" ")
        elif kind == "tableopen":
            enter(_TABLE)
            here.parts.append(" ")
        elif kind == "tableclose":
            here.parts.append(" ")
            if top == _TABLE:
                leave()
        elif kind in ("row", "cell"):
            here.parts.append(" ")
            if kind == "cell" and (a := _ATTRIBUTES.match(page, at)):
                at = a.end()
        # comments, formatting, the address of an external link and behaviour switches show nothing
    if at < len(page):
        here.parts.append(page[at:])
    return [s.text() for s in out], not stack


def _is_name(parts: list[str], began: int) -> bool:
    """Whether what was read since ``began`` can be the target of a link or the name of a parameter."""
    length = 0
    for part in parts[began:]:
        length += len(part)
        if length > 300 or "\n\n" in part or "\n" in part.strip():
            return False
    return True


def _shown(stream: _Stream, began: int, target: str | None, out: list[_Stream]) -> None:
    """Leaves of a link what the reader sees."""
    label = "".join(stream.parts[began:])
    place = target if target is not None else label
    if place.startswith(":"):
        if target is None:
            del stream.parts[began:]
            stream.parts.append(label[1:])
        return
    if _HIDDEN.match(place):
        del stream.parts[began:]
    elif _FILE.match(place):
        del stream.parts[began:]
        if target is not None:
            caption = _Stream()
            caption.parts.append(label)
            out.append(caption)
    elif target is not None and not label.strip():
        stream.parts.append(place)  # [[name|]] shows the name


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


def page_words(page: str | None) -> list[list[str]]:
    """The words of each stream."""
    return [w for s in streams(page) if (w := words(s))]


def plain_words(text: str | None) -> list[str]:
    """The words of a text without markup."""
    if not text:
        return []
    return words(text if text.isascii() else unicodedata.normalize("NFC", _INVISIBLE.sub("", text)))
