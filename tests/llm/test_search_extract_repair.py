"""Ranked search, main text of pages and repair of conversations against brute force and planted pages."""

import hashlib
import heapq
import html
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import extract, lexical, repair
from lectern.llm.queries import op12_extract_text, op13_repair_conversations

TERM = re.compile(lexical.TERM)
terms = lambda t: TERM.findall(t.translate(str.maketrans(lexical.UPPER, lexical.LOWER)))


def slow_search(docs, items, k, b=90):
    docs = [(i, terms(t)) for i, t in docs if t and terms(t)]
    n, total = len(docs), sum(len(t) for _, t in docs)
    df = Counter(x for _, t in docs for x in set(t))
    out, asked = [], {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t or ""))
    for i, q in asked.items():
        scores = []
        for d, t in docs:
            tf, m = Counter(t), 100 - b + (b * len(t) * n) // total
            scores.append((sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in q if tf[x]), d))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is not None, s[1] or 0))[:k]
        out += [(i, r, d, s) for r, (s, d) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize(("part", "block"), [(2048, 1 << 17), (4, 6)])
def test_search_equals_brute_force(spark, monkeypatch, part, block):
    """Ties, repeated rows and ids, nulls, empty and very long texts; strata in parts, items in several blocks."""
    monkeypatch.setattr(lexical, "PART", part)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "SEGMENT", 200 if part < 9 else lexical.SEGMENT)
    rng = random.Random(part)
    words = ["alpha", "Beta", "été", "x1", "İ", "Ünder", "the", "of", "a-b", "zz", "ÉTÉ", "rare"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + rng.choice(["", ".", "\n", " <b>"])
    docs = [(i, text(rng.choice([1, 3, 3, 8, 20]))) for i in range(60)] + [(60, None), (61, ""), (62, "..."), (None, "the rare"), (5, "the rare"), (5, "the rare"), (63, "the " * 30_000 + "rare"), (64, "lonely")]
    items = [(1, "THE rare, rare beta"), (2, None), (3, "..."), (4, "unknown"), (5, "été ÉTÉ x1"), (None, "of alpha"), (6, "lonely"), (5, "zz"), (7, "the of a b")]
    df = spark.createDataFrame([(*d, 7, "p") for d in docs], "doc_id long, text string, score int, term string").repartition(3)
    asked = spark.createDataFrame(items, "item_id int, text string")
    got = lexical.search(lexical.build_index(df), asked, k=5).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == sorted(slow_search(docs, items, 5), key=str)
    empty = lexical.build_index(df.limit(0))
    assert lexical.search(empty, asked).count() == 0 and lexical.search(lexical.build_index(df), asked.limit(0)).count() == 0


def test_maximum_flow_is_a_least_cut():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 8)
        terminals = [(rng.randrange(9), rng.randrange(9)) for _ in range(n)]
        edges = [(a, b, rng.randrange(1, 6)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda own: sum(t if x else s for (s, t), x in zip(terminals, own, strict=True)) + sum(c for a, b, c in edges if own[a] != own[b])
        every = [(cost(own), -sum(own), own) for own in itertools.product((False, True), repeat=n)]
        got = extract.maximum_flow(n, terminals, edges)
        assert (cost(got), -sum(got)) == min(every)[:2]


def plain_article(page):
    """The article of pages whose blocks are h1 and p alone."""
    out = []
    for block in re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", page, re.S)[1]):
        said = " ".join(html.unescape(re.sub(r"</?[a-z]+[^>]*>", lambda m: " " if m[0] == "<br>" else "", block)).split())
        out += [said] if said else []
    return "\n\n".join(out)


def test_op12_equals_the_articles(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op12_extract_text(spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain_article(pages[r.page_id].html), len(r.text))


ARTICLE = ["Title of it", "First of some paragraphs, with a link and more.", "Short.", "Item one is here.", "Item two", "A quote & more"]
BODY = "<h1>Title of it</h1><p>First of some paragraphs,\n with <a href=x>a link</a> and more.<p>Short.<ul><li>Item one is here.<li>Item two</ul><blockquote>A quote &amp; more</blockquote>"
PROSE = "Long prose that reads like an article does, with many words in a row, and sentences. Honest."
OTHERS = {
    "menu": '<nav><ul><li><a href="/">Home</a><li><a href="/b">News</a></ul></nav>',
    "header": f'<header class="site-header"><p>{PROSE}</p></header>',
    "footer": f"<footer><p>{PROSE}</p><p>&copy; 2020 Us</p></footer>",
    "sidebar": f'<aside><h3>Related</h3><p>{PROSE}</p></aside><div id="sidebar-right"><p>{PROSE}</p></div>',
    "notice": f'<div class="cookie-banner" role="dialog"><p>{PROSE}</p><button>Accept</button></div>',
    "advert": f'<div class="ad">{PROSE}</div><div class="adsbygoogle"><p>{PROSE}</p></div><p class="advertisement">{PROSE}</p>',
    "form": "<form action=/s><label>Your name</label><input><textarea>Write here please.</textarea><select><option>One</option></select><p>Send it to us now.</p></form>",
    "script": "<script>if (a<b && c>'x>y') { document.write('<p>no</p>') }</script><style>p > a { color: red }</style><noscript>Enable scripts.</noscript><template><p>No.</p></template><!-- <p>no</p> -->",
    "comments": f'<section id="comments"><h2>2 comments</h2><article class="comment"><p>{PROSE}</p></article><ol class="commentlist"><li>{PROSE}</li></ol></section>',
    "hidden": f'<p hidden>{PROSE}</p><div style="display: none">{PROSE}</div>',
}


@pytest.mark.parametrize("frame", ["<article>{}</article>", '<main><div class="post-content">{}</div></main>', '<div id="page" class="layout with-sidebar"><article class="entry">{}</article></div>', '<div class="content">{}</div>'])
def test_planted_pages(frame):
    own = "\n\n".join(ARTICLE)
    for names in [(n,) for n in OTHERS] + [tuple(OTHERS)]:
        others = "".join(OTHERS[n] for n in names)
        for page in (f"<!DOCTYPE html><html><head><title>T</title></head><body class=\"has-sidebar\">{others}{frame.format(BODY)}</body></html>", f"<body>{frame.format(BODY)}{others}"):
            assert extract.extract(page) == own, (names, extract.extract(page))
    inside = frame.format(BODY + OTHERS["advert"] + OTHERS["comments"] + '<div class="share-links"><a href=#>Post it</a></div>')
    assert extract.extract(inside) == own


def test_extraction_of_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain words without any markup, a sentence of them."), (4, "u", "<p"), (5, "u", "<article><p>a&nbsp;&eacute;&#x41;&bogus; b</article>"), (5, "u", "<article><p>x y z.</article>"), (6, "u", "<nav>x</nav>")]
    df = spark.createDataFrame([(*r, "mine", 3) for r in rows], "page_id long, url string, html string, text string, _html int")
    out = extract.main_text(df)
    assert sorted(out.columns) == sorted(df.columns)
    assert sorted((r.page_id, r.text, r._html) for r in out.collect()) == [(1, "", 3), (2, "", 3), (3, rows[2][2], 3), (4, "", 3), (5, "a éA&bogus; b", 3), (5, "x y z.", 3), (6, "", 3)]
    assert extract.main_text(df.limit(0)).count() == 0
    began = time.time()
    for page in ("<div>" * 50_000 + "x", '<p a="' * 50_000, "<" * 100_000, "<b>x</p>" * 50_000, "<!--" * 50_000, "</i>" * 50_000, "<p>Some words here, yes.</p>" * 20_000):
        extract.extract(page)
    assert time.time() - began < 60


def slow_repair(rows):
    """(cost, edits, texts) by uniform-cost search over (cost, edits)."""
    seen, heap, n = set(), [(0, "", 0, 0, ())], len(rows)
    while True:
        cost, edits, i, state, said = heapq.heappop(heap)
        if i == n and state in (0, 3):
            return cost, edits, said
        if (i, state) in seen:
            continue
        seen.add((i, state))
        turn = (2, 2, 3, 2)[state]
        name = {2: "user", 3: "assistant"}[turn]
        heapq.heappush(heap, (cost + 3, edits + "I", i, turn, (*said, f"{name}:")))
        if i < n:
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, state, said))
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + 3 + late, edits + "R", i + 1, turn, (*said, f"{name}:{text}")))
                if role[:1] and role[:1] in ("su", "u", "a", "u")[state]:
                    heapq.heappush(heap, (cost + late, edits + "K", i + 1, {"s": 1, "u": 2, "a": 3}[role[0]], (*said, f"{role}:{text}")))


def slow_op13(rows):
    text_of = lambda x: " " if x is None else str(x)
    kept = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            said = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, edits, said = slow_repair([(r, t, f) for (_, r, t), f in zip(own, faults, strict=True)])
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def check_repair(rows, got):
    want = slow_op13(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_op13(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_repair(rows, op13_repair_conversations(spark, sf_dir).collect())


@pytest.mark.parametrize("segment", [24, 3])
def test_repair_edge_cases(spark, monkeypatch, segment):
    """Nulls anywhere, repeated rows, odd roles, very long texts, long conversations in segments, clashing columns."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = random.Random(segment)
    roles = ["user", "assistant", "system", "tool", "", None, "assistant", "user"]
    texts = ["One.", "Two", "Three!", " ", None, "", "One.", "Four?\t", "é" * 3, "Five\n."]
    rows = [(c if c else None, rng.choice([t, t, t * 2, None, 3]), rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, rng.choice(["user", "assistant", "user", "system"]), rng.choice([*texts, f"Turn {t}."])) for t in range(60)]
    rows += [(101, 0, "user", "w " * 200_000), (101, 1, "assistant", "w. " * 200_000), (102, 5, "user", "Same."), (102, 5, "user", "Same."), (102, 5, "user", "Same.")]
    rows += [(200 + i, 0, "user", "Alone.") for i in range(40)]
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, seg int, fault string").repartition(5)
    check_repair(rows, repair.repair(repair.damage(df), df).collect())
    assert repair.repair(repair.damage(df.limit(0)), df.limit(0)).count() == 0
    none = repair.repair(repair.damage(df).limit(0), df.where(F.col("conv_id") == 100)).collect()
    assert [tuple(r) for r in none] == [(100, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
