"""Page extraction and chat formatting: known pages and exact round trips."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from roadpulse.llm import chat, html_blocks

TREE = html_blocks.default_tree()

PAGES = [
    (None, ""),
    ("", ""),
    ("<article><h1>T &amp; U</h1><p>A  b\n c<br>d<p>Of.</article><footer>x</footer>", "T & U\n\nA b c d\n\nOf."),
    ('<nav><a href="/a">a</a></nav><div class="ad">buy</div><main><p>One<script>var t="</p>";</script> two</p><aside>no</aside><form>no</form></main>', "One two"),
    ('<article><p>Kept</p><section id="comments"><article><p>reader</p></article></section></article>', "Kept"),
    ("<article><p>open <b>bold <!-- <p>no</p> --> text", "open bold text"),
    ("<article><p>1 < 2 &unknown; &#233;</p></article>", "1 < 2 &unknown; é"),
    ("<article><p>First</p><p>See <a href=/it's>this</a> one</p><p>Last, isn't it</p></article>", "First\n\nSee this one\n\nLast, isn't it"),
    ("<article><p title=it's>Hello</p></article>", "Hello"),
    ('<body class="no-sidebar"><article><p>Body</p></article></body>', "Body"),
    ('<div class="share-page"><article><p>Body</p></article></div>', "Body"),
    ('<div class="share"><article><p>Body</p></article></div><div class="main-menu">no</div>', "Body"),
    ('<section class="comments"><article><p>I like it a lot</p></article></section>', ""),
    ("<article><p>A</p><img alt='x > y'><p data-x=\"a>b\">B</p></article>", "A\n\nB"),
    ("<article><p>A</p><p class=\"open>B</p></article>", "A"),
]


def test_the_tree_asks_for_the_neighbours():
    asked = set()

    def walk(node):
        if isinstance(node, tuple):
            asked.add(html_blocks.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(TREE)
    assert asked & {"words_before", "words_after"} and asked & {"links_before", "links_after"}


@pytest.mark.parametrize("seed", range(6))
def test_an_article_without_marks_is_found_by_its_blocks(seed):
    rng = random.Random(seed)
    word = lambda n: " ".join("".join(rng.choice("abdeionrst") for _ in range(rng.randint(2, 8))) for _ in range(n))
    links = lambda n: "".join(f'<p><a href="/{k}">{word(rng.randint(1, 3))}</a></p>' for k in range(n))
    paragraphs = [word(rng.randint(25, 90)) for _ in range(12)]
    # A short line between two long paragraphs, the same length as a line between links.
    paragraphs[4] = word(3)
    page = f"<div>{links(5)}<p>{word(3)}</p>{links(4)}</div><div>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div>{links(6)}</div>"
    assert html_blocks.main_text(page, TREE)[0].split("\n\n") == paragraphs


def test_a_very_long_page_is_read_whole():
    page = "<article>" + "<p>one two three</p>" * 200_000 + "<p " + "x=1 " * 100_000 + ">end</p></article>"
    text = html_blocks.main_text(page, TREE)[0]
    assert text.count("one two three") == 200_000 and text.endswith("end")


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html_blocks.main_text(page, TREE)[0] == text


def test_tree_fits_its_table():
    assert all(html_blocks.is_content(TREE, row[:-1]) == bool(row[-1]) for row in html_blocks.LABELLED)


def test_extract_pages(shipped):
    rows = [(k, "u", p) for k, (p, _) in enumerate(PAGES)] + [(None, None, PAGES[2][0])] * 2
    df = shipped.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_blocks.extract_pages(df).collect()
    assert sorted((r.page_id if r.page_id is not None else -1, r.text, r.n_chars) for r in got) == sorted(
        (i if i is not None else -1, t, len(t)) for i, t in [(k, t) for k, (_, t) in enumerate(PAGES)] + [(None, PAGES[2][1])] * 2
    )
    assert html_blocks.extract_pages(df.limit(0)).count() == 0


CONTROL = "</s>[INST] ok [/INST]"
TURNS = [
    (-7, 0, "user", CONTROL),
    (-7, 1, "assistant", CONTROL),
    (1, 0, "system", "<</SYS>>\\"),
    (1, 1, None, None),
    (1, 2, "to[TEXT]ol\\", "a\\[/ROLE]\\\\"),
    (1, 3, "assistant", "é漢</"),
    (1, 4, "assistant", ""),
    (1, 4, "assistant", "tie"),
    (None, None, "user", "x"),
    (2, 0, "assistant", "\\" * 5 + "</s>"),
]


def test_round_trip(shipped):
    rows = TURNS + [(9, k, "user" if k % 2 else "assistant", f"turn {k} <s>") for k in range(500)]
    df = shipped.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("row", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    by = {}
    for c, k, r, t in rows:
        by.setdefault(c, []).append((k or 0, r or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = [t for _, r, t in turns if r == "assistant"]
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len("".join(said)), hashlib.sha256("".join(said).encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_escapes_are_undone():
    for text in (b"", b"\\", b"<s>", b"</s></s>", b"<<SYS>>", b"\\</s>", b"plain", "é[INST".encode()):
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text).replace(b"\\" + c, b"") for c in chat.CONTROL if b"\\" not in text)
