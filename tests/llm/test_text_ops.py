"""Operators on single texts: packing, BPE, pages, chats."""

import hashlib
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from auditlake.llm.bytebpe import byte_bpe, encode_decode
from auditlake.llm.chat import GrammarError, Parser, _Conversation, conversation_digests, format_turns, parse, render_turn
from auditlake.llm.packing import pack_documents, sum_of_squares
from auditlake.llm.pagetext import extract_text, parse_page

TEXTS = ["", None, "one", "A quick brown fox's tale; 12 34!", "é è ß Ünïcode\n\ttabs  two  spaces ", "x" * 30_000, "日本 語   text 😀", "word " * 5000, "<|endoftext|> '' 's"]
DOCS = "doc_id long, text string, lang string, sequence_id string"


def docs(spark):
    rows = [(i, t, "en", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", None, None)], DOCS)


def test_pack(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = pack_documents(docs(spark), group_docs=4).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(TEXTS)}
    ids[None] = [*tokenizer.encode("no id", add_special_tokens=False).ids, 0]
    for r in rows:
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["start"] == 2048 * r["piece"]
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values())) + len(ids[3])
    bins: dict = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 2048
    assert pack_documents(docs(spark).limit(0)).count() == 0


def test_pack_keeps_ids_beside_null_ids(spark):
    big = 2**53 + 1
    table = spark.createDataFrame([(None, "a"), (big, "b"), (-big, "c"), (big, "b")], "doc_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in pack_documents(table).collect()) == [-big, 0, big, big]


def naive_sum_of_squares(lengths, capacity):
    """The method as its definition has it: try every open bin, take the smallest sum; new bins only where nothing fits."""
    bins = []
    for s in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= s]
        if not fits:
            bins.append(capacity - s)
            continue

        def cost(b):
            gaps = Counter(g - s if i == b else g for i, g in enumerate(bins))
            return sum(n * n for g, n in gaps.items() if g), bins[b]

        bins[min(fits, key=cost)] -= s
    return Counter(bins)


@pytest.mark.parametrize("seed", range(8))
def test_sum_of_squares_is_the_naive_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 40, 100])
    lengths = np.array([rng.randint(1, capacity) for _ in range(rng.randint(0, 70))], np.int64)
    place, offset, opened = sum_of_squares(lengths, capacity)
    left = [capacity] * opened
    for i in np.argsort(-lengths, kind="stable"):
        assert offset[i] == capacity - left[place[i]]
        left[place[i]] -= int(lengths[i])
    assert Counter(left) == naive_sum_of_squares(lengths.tolist(), capacity)


def test_sum_of_squares_is_near_the_bound():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2048, 3000), np.full(100, 1024), np.full(10, 2047), np.empty(0, np.int64)):
        place, offset, opened = sum_of_squares(lengths, 2048)
        assert opened <= -(-int(lengths.sum()) // 2048) * 1.05 + 10 or lengths.min() > 1024
        used = np.bincount(place, lengths, minlength=opened) if len(lengths) else np.zeros(0)
        assert (used <= 2048).all()


def test_bpe_is_tiktoken(spark):
    bpe = byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for r in encode_decode(docs(spark), keep_ids=True).collect():
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = known.encode_ordinary(text)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    rng = random.Random(5)
    alphabet = ["a", "b", "é", "中", "😀", " ", "  ", "\n", "\xa0", " ", "1", "²", "'s", "\x1c", "̀", "."]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, bpe.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text), repr(text)

    def any_char():
        """Of all planes, newer letters than Python knows included."""
        if rng.random() < 0.3:
            return rng.choice(alphabet)
        c = rng.randrange(0x110000 if rng.random() < 0.5 else 0x33480)
        return "x" if 0xD800 <= c < 0xE000 else chr(c)

    texts = ["".join(any_char() for _ in range(rng.randint(1, 25))) for _ in range(50_000)]
    assert sum(np.frombuffer(ids, "<u4").tolist() != known.encode_ordinary(text) for text, ids in zip(texts, bpe.encode_all(texts))) == 0
    long = "ab" * 20_000
    assert bpe.merge(long.encode()) == known.encode_ordinary(long)
    assert encode_decode(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("", []),
        ("plain < text &amp; <b>x", ["plain < text & x"]),
        ("<article><h1>T</h1><p>a<br>b&nbsp; c<p>d</article><footer>f</footer>", ["T", "a b c", "d"]),
        ("<main><article><header><h1>T</h1></header><p>x</p><aside>y</aside><div class='newsletter'>n</div><section class=comments><article><p>c</p></article></section></article></main><nav>m", ["T", "x"]),
        ("<body class='with-sidebar'><div class=site-header><h1>S</h1></div><div id=content><p>long enough to be the page's own text</div><div class='cookie-notice'>We use</div><form><input>Go</form>", ["long enough to be the page's own text"]),
        ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no --><p>yes", ["yes"]),
        ("<div>" * 3000 + "deep", ["deep"]),
        ("<p title=\"a>b\">q</p><p 'broken>r</p>", ["q", "r"]),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", ["a", "b", "c d", "e"]),
    ],
)
def test_page(page, blocks):
    assert parse_page(page)[0] == blocks


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("<body><form><select><option>A<option>B</select></form><p>text", ["text"]),
        ("<p>a</p><select><optgroup label=x><option>A<optgroup label=y><option>B</select><p>b", ["a", "b"]),
        ("<input list=d><datalist id=d><option>A<option>B</datalist><p>text", ["text"]),
        ("<div><select><option>A<option>B</div><p>text</p><select><option>C</select>end", ["text", "end"]),
        ("<select><option>A<option>B<p>text", ["text"]),
        ("<html><head><title>T</title><meta charset=utf-8><link rel=x><p>text<p>more", ["text", "more"]),
        ("<head><script>x</script>plain text", ["plain text"]),
        ("<head><title>T</title><body><p>text", ["text"]),
        ("<div><button>Menu</div><p>text</p><button>Send</button>", ["Menu", "text"]),
        ("<button>Menu<p>text</p><button>Send</button><p>end", ["Menu", "text", "end"]),
        ("<p><object data=x></p><p>text</p>", ["text"]),
        ("<div>" + "<object>" * 20_000 + "</div><p>text", ["text"]),
        ("<body><canvas id=c><p>text</p></body>", ["text"]),
        ("<map name=m><area href=x><p>text <svg><text>no</text></svg>more", ["text more"]),
        ("<div><svg><foreignObject><body><div>no</div></body></foreignObject><text>no</text></svg>text</div>", ["text"]),
        ("<object><object>no</object>no</object><p>text", ["text"]),
        ("<video src=x><p>no</p></video><button><div>no</button><p>text", ["text"]),
    ],
)
def test_page_without_end_tags(page, blocks):
    assert parse_page(page)[0] == blocks


LONG = "<article><p>a comment that is a good deal longer than the text it is about</p></article>" * 3


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("<p>short text</p><div class=comments>" + LONG + "</div>", ["short text"]),
        ("<p>short text</p><div id=sidebar><p>a long list of links</p><p>and more links</p></div>", ["short text"]),
        ("<nav><p>a long list of links</p><p>and more links</p></nav><p>text", ["text"]),
        ("<div class=comments><p>all that the page</p><p>has</p></div>", ["all that the page", "has"]),
        ("<div class=content-with-sidebar><article><p>a</p><p>b</p></article></div><p>c", ["a", "b"]),
        ("<div class=sidebar-right><main><p>a</p><p>b</p></main></div><p>c", ["a", "b"]),
        ("<p>skip</p><form id=aspnet><p>the whole page's text</p><p>more of it</p></form>", ["skip", "the whole page's text", "more of it"]),
    ],
)
def test_boilerplate_of_any_size(page, blocks):
    assert parse_page(page)[0] == blocks


def test_rare_and_large_templates(spark):
    """A notice on 6 of 800 pages, and one that is longer than the text it stands beside."""
    notice, links = "<div><p>A notice</p><p>of few pages</p></div>", "<div><p>a list of links that is a good deal longer</p><p>than the text of the page</p></div>"
    rows = [(i, f"https://a.example/{i}", f"<body>{notice if i < 6 else ''}<div><p>own words of page {i}</p></div>") for i in range(800)]
    rows += [(1000 + i, f"https://b.example/{i}", f"<body>{links}<div><p>own words {i}</p></div>") for i in range(6)]
    text = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert text[3] == "own words of page 3" and text[700] == "own words of page 700" and text[1003] == "own words 3"


def test_templates_by_a_plain_counter(spark):
    """Random trees; the counter has nested tuples instead of hashes and plain sets instead of joins."""
    rng = random.Random(12)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return ("p", f"text {rng.randrange(12 if rng.random() < 0.3 else 300)}")
        return ("div", *(tree(depth - 1) for _ in range(rng.randint(1, 3))))

    def markup(node):
        return f"<{node[0]}>{''.join(x if isinstance(x, str) else markup(x) for x in node[1:])}</{node[0]}>"

    def subtrees(node):
        yield node
        for x in node[1:]:
            if not isinstance(x, str):
                yield from subtrees(x)

    def words(node, gone):
        if node in gone:
            return []
        return [x for c in node[1:] for x in ([c] if isinstance(c, str) else words(c, gone))]

    pages = [(i, f"h{i % 3}", tuple(tree(3) for _ in range(rng.randint(0, 3)))) for i in range(150)]
    pages += [(150 + i, "h0", pages[0][2]) for i in range(10)]
    seen = {}
    for _, host, body in pages:
        content = tuple(words(("body", *body), ()))
        for node in {x for top in body for x in subtrees(top)}:
            seen.setdefault((host, node), set()).add(content)
    rows = [(i, f"http://{host}/{i}", "<body>" + "".join(map(markup, body)) + "</body>") for i, host, body in pages]
    found = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), min_pages=5).collect()}
    kept = 0
    for i, host, body in pages:
        gone = {n for (h, n), c in seen.items() if h == host and len(c) >= 5}
        want = "\n".join(words(("body", *body), gone))
        kept += want != ""
        assert found[i] == want, i
    assert 10 < kept < len(pages) - 5


def test_templates(spark):
    foot = "<div><p>About this site</p><p>All pages</p></div>"
    rows = [(i, f"https://a.example/{i}", f"<body>{foot}<div><p>own words of page {i} which are the longest part of it by far</p></div>", "x") for i in range(8)]
    rows += [(100 + i, f"https://b.example/{i}", f"<body>{foot}<div><p>copied words which are the longest part of the page by far</p></div>", "x") for i in range(8)]
    rows += [(200, None, None, None), (None, "bad url", "<p>t", None), rows[0]]
    rows += [(300 + i, f"https://c.example/{i}", f"<article><p>A sentence that everyone quotes.</p><p>own {i}</p></article>", "x") for i in range(8)]
    found = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    text = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows) and text[3] == "own words of page 3 which are the longest part of it by far"
    assert text[101].startswith("About this site")  # copies of one page are no template
    assert text[200] == "" and text[None] == "t" and text[305] == "A sentence that everyone quotes.\nown 5"
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(1)
    parts = ["<|", "\\", "im_end|>", "<|im_end|>", "<|im_start|>", "a", "\n", "%", "%0A", "assistant", "😀"]
    for _ in range(20_000):
        role, text = ("".join(rng.choices(parts, k=rng.randint(0, n))) for n in (4, 8))
        formatted = render_turn(role, text)
        assert [x[:2] for x in parse(formatted + formatted)] == [(role, text)] * 2
    with pytest.raises(GrammarError):
        parse("<|im_start|>user\nopen")
    for bad in ("<|im_start|>a<|im_end|>\n", "<|im_start|>a\nb<|im_end|>x", "x", "<|im_start|>a\n<|im_start|>b<|im_end|>\n", "<|im_start|>a<|im_end|>b\nc<|im_end|>\n", "<|im_start|>a\nb<|im_end|>"):
        with pytest.raises(GrammarError):
            parse(bad)
    whole = "".join(render_turn(r, t) for r, t in (("user", "a<|im_end|>"), ("assistant", "")) * 3)
    parser = Parser()
    assert [x for i in range(0, len(whole), 7) for x in parser.feed(whole[i : i + 7])] == parse(whole)
    rows = [(1, 1, "assistant", "<|im_end|><|im_start|>assistant ok", "x"), (1, 0, "user", None, "x"), (None, 0, None, "t", None), (2, 0, "assistant", "w" * 100_000, None), (2, 0, "assistant", "w" * 100_000, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    found = {r["conv_id"]: r for r in conversation_digests(df).collect()}
    assert found[1]["turns_sha256"] == hashlib.sha256("user\n\nassistant\n<|im_end|><|im_start|>assistant ok\n".encode()).hexdigest()
    assert found[1]["loss_sha256"] == hashlib.sha256(b"<|im_end|><|im_start|>assistant ok").hexdigest() and found[1]["loss_chars"] == 34
    assert found[2]["n_turns"] == 2 and found[2]["loss_chars"] == 200_000 and found[None]["n_turns"] == 1
    turns = format_turns(df).filter("conv_id = 1").orderBy("turn").collect()
    assert turns[0]["mask_end"] == 0 and turns[1]["formatted"][turns[1]["mask_start"] : turns[1]["mask_end"]].count("\\") == 2
    assert conversation_digests(df.limit(0)).count() == 0


def peak_mb(call):
    """Result of a call and the most memory that Python objects took meanwhile."""
    tracemalloc.start()
    try:
        out = call()
        return out, tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_chat_of_a_very_long_text():
    text = "word <|im_end|> " * 3_200_000  # 51 million characters, all to be escaped
    conversation = _Conversation(1)
    _, mb = peak_mb(lambda: conversation.add("assistant", text[:16] + "x" * 50_000_000))
    assert conversation.row()[3] == 50_000_016 and mb < 400
    assert parse(render_turn("user", text))[0][1] == text


@pytest.mark.parametrize(
    "page",
    [
        "<span class=ad>x " * 40_000,
        "<span class=ad>x " * 40_000 + "</span>",
        "<div>" * 20_000 + "x</p></b>" * 20_000,
        "<div class=ad>" * 20_000 + "x" + "</div>" * 20_000,
        "".join(f"<div class=ad><p>a{i}</div>" for i in range(20_000)),
        "<article><p>x</article>" * 20_000 + "<nav><p>y</nav>" * 20_000,
        "<object>" * 20_000 + "<p>x</p>" + "</div>" * 20_000,
    ],
)
def test_adversarial_pages_take_linear_time(page):
    start = time.process_time()
    parse_page(page)
    assert time.process_time() - start < 4


def test_page_of_50_mb():
    page = "<nav><p>menu</nav>" + "<p>" + "some words of a very long text " * 1_600_000
    (blocks, spans, _), mb = peak_mb(lambda: parse_page(page))
    assert len(blocks) == 1 and len(blocks[0]) > 49_000_000 and mb < 900


def test_templates_go_before_rules(spark):
    """Recurring subtrees go by their count, whatever their names; rules take what recurs too seldom."""
    neutral = "<div class='x1'><section>Home</section><section>About us</section></div>"
    page = lambda i, top, end: f"<html><body>{top}<div class='x2'><p>Article {i} says {'word ' * (i + 3)}</p><p>Second part {i}</p></div>{end}</body></html>"
    rows = [(i, f"http://plain.example/{i}", page(i, neutral, "<div class='x3'>Imprint</div>")) for i in range(8)]
    rows += [(100 + i, f"http://named.example/{i}", page(i, "<nav>Menu of the site</nav>", f"<footer>Only on page {i}</footer>")) for i in range(8)]
    rows += [(200 + i, f"http://few.example/{i}", page(i, neutral, "<nav>Menu of the site</nav>")) for i in range(4)]
    got = {r.page_id: r for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        article = f"Article {i} says {'word ' * (i + 3)}".strip() + f"\nSecond part {i}"
        assert (got[i].text, got[i].n_template, got[i].n_rules) == (article, 3, 0)
        assert (got[100 + i].text, got[100 + i].n_template, got[100 + i].n_rules) == (article, 1, 1)
    for i in range(4):
        assert got[200 + i].text.startswith("Home\nAbout us\nArticle") and (got[200 + i].n_template, got[200 + i].n_rules) == (0, 1)
