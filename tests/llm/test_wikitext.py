from __future__ import annotations

import random
import time

import pytest

from cairn.llm.wikitext import page_words, plain_words, streams

CASES = [
    ("a '''un'''usual ''[[cat]]s'' here", ["a unusual cats here"]),
    ("one {{cn|date=1}} two<!-- x -->three <ref>n [[A|b]] note</ref> end", ["one two three end".replace("two three", "twothree"), "cn", "1", "n b note"]),
    ("[[Target page|label text]] and [[Plain]] and [[name|]]", ["label text and plain and name"]),
    ("[[Category:Hidden]] x [[Kategorie:Y]] [[:Category:Shown]] [[de:Other]]", ["x category shown"]),
    ("[[File:a.png|thumb|left|the caption [[B|c]]]] y", ["y", "the caption c"]),
    ("caf&eacute; &#233;t&#xe9; a&nbsp;b &amp; c", ["café été a b c"]),
    ("{{quote|text=some {{cn}} words|by [[X|him]]}} z", ["z", "quote", "some words", "cn", "by him"]),
    ("{{lang|xx|{{{orig|}}}}} {{{p|shown}}} {{{q}}} t", ["shown t", "lang", "xx"]),
    ("{| class=\"w\"\n|+ cap\n! A !! B\n|-\n| x || y\n|-\n| style=\"a:b\" | q || colspan=2 | r\n|}\nrest", ["cap a b x y q r rest"]),
    ("* item one\n# item two\n: item three\n== Head ==", ["item one item two item three head"]),
    ("see [https://example.org/a_b the label] x", ["see the label x"]),
    ("a<br/>b <span class=\"x\">in</span>side <unknown>", ["a b inside unknown"]),
    ("<nowiki>[[raw]] '''text'''</nowiki> x", ["raw text x"]),
    ("cut {{quote|foo bar [[baz", ["cut", "quote", "foo bar baz"]),
    ("cut <ref>foo bar", ["cut", "foo bar"]),
    ("x <!-- never closed", ["x"]),
    ("a ]] b }} c </ref> d |} e", ["a b c d e"]),
    ("so­ft zero​width", ["soft zerowidth"]),
    ("a | b\n| c", ["a b c"]),
    ("x[[\n\nlong text here | more", ["x long text here more"]),
]


@pytest.mark.parametrize("page,wanted", CASES)
def test_what_a_reader_sees(page, wanted):
    assert [" ".join(w) for w in page_words(page)] == wanted


def test_empty():
    assert streams(None) == streams("") == page_words(" ") == plain_words(None) == []


def test_plain_words():
    assert plain_words("L'Été_de 2001, ÉTÉ") == ["l", "été", "de", "2001", "été"]


def test_plain_text_is_kept():
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 8))) for _ in range(500))
    assert page_words(text) == [plain_words(text)]


@pytest.mark.parametrize("piece", ["{{", "}}", "[[", "]]", "<ref>", "</ref>", "|", "'''", "{{{", "<nowiki>", "a=", "<!--", "\n{|", "[[a|", "{{a|", "x" * 50, "&amp;", "{|\n|a=a=a="])
def test_long_pages_take_linear_time(piece):
    began = time.time()
    streams(piece * 20_000)
    assert time.time() - began < 10


def test_any_markup_is_read_without_failing():
    rnd = random.Random(7)
    pieces = ["{{", "}}", "{{{", "}}}", "[[", "]]", "|", "||", "\n|", "\n|-", "\n{|", "\n|}", "!", "!!", "<ref>", "</ref>", "<ref name=a/>", "''", "<!--", "-->", "=", "a", "b c", "File:", "Category:", "&lt;", "<b>", "<nowiki>", "</nowiki>", "\n"]
    for _ in range(3000):
        page_words("".join(rnd.choice(pieces) for _ in range(rnd.randrange(30))))


def test_pieces_are_the_streams():
    import random

    from cairn.llm.wikitext import Pieces, streams

    rnd = random.Random(5)
    bits = ["{{", "}}", "{|", "|}", "|-", "|", "||", "!!", "!", "[[", "]]", "[http://x", "]", "'" * 3, "\n", "\n\n", "\n\n", "\n\n\n", "\n|", " ", "a", "b ", "<ref>", "</ref>", "<ref name=", ">", "<", "<br>", "<!--", "-->", "<nowiki>", "</nowiki>", "__TOC__", "&am", "p;", "=x=", "File:x|", "{{{", "}}}", "e\u0301", "\u0301"]
    pieces = Pieces()
    for _ in range(20_000):
        page = "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25)))
        read = pieces(page)
        whole = ["\n\n".join(p[0] for p in read), *(t for p in read for t in p[1:])]
        assert [t for i, t in enumerate(whole) if t and (i == 0 or not t.isspace())] == streams(page)
