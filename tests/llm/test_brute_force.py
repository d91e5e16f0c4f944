"""Queries against plain versions of what they compute, on the smallest tables."""

import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from glycospark.llm import chunk_dedup, decontaminate, edit_embedding, minhash, packing, secrets, substring_dedup
from glycospark.llm.catalog import all_queries
from glycospark.llm.common import settle

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")
QUERIES, SQL = all_queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables.get(t, f'{FOLDER}/{t}.parquet')}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return sorted(repr(sorted(zip(names, r))) for r in cur.fetchall())


def spark_rows(df):
    return sorted(repr(sorted(r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == sql_rows(SQL[name])


def components(texts):
    """Smallest id that links lead to, by comparing all pairs that share a shingle."""
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    owners = collections.defaultdict(list)
    for i in sorted(texts):
        shared = collections.Counter(j for s in sets[i] for j in owners[s])
        for j, k in shared.items():
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            owners[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_classes(spark, texts, monkeypatch):
    want = components(texts)
    for crowd in (minhash.CROWD, 1):  # with 1, all bands count as crowded
        monkeypatch.setattr(minhash, "CROWD", crowd)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op3_minhash_classes"](spark, FOLDER).collect()}
        assert got == want


def test_family_of_near_copies(spark):
    """Copies with 1 to 20 % of the words replaced, none of them equal."""
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(200)]
    family = {}
    for i in range(120):
        words = list(base)
        for k in rng.choice(200, int(rng.integers(1, 12)), replace=False):
            words[k] = f"n{i}x{k}"
        family[i] = " ".join(words)
    df = spark.createDataFrame(list(family.items()), "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_classes(df).collect()}
    assert got == components(family)


@pytest.mark.parametrize("crowd", [substring_dedup.CROWD, 1])
def test_repeated_strings(documents, texts, crowd):
    raws = {i: t.encode() for i, t in texts.items()}
    count = collections.Counter(hash(t[p : p + 200]) for t in raws.values() for p in range(len(t) - 199))
    got = {r.doc_id: r for r in substring_dedup.substring_report(documents, crowd=crowd).collect()}
    for i, t in raws.items():
        gone = np.zeros(len(t) + 1, dtype=bool)
        for p in range(len(t) - 199):
            if count[hash(t[p : p + 200])] > 1:
                gone[p : p + 200] = True
        kept = np.frombuffer(t, dtype=np.uint8)[~gone[:-1]].tobytes()
        spans = np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), gone.sum(), spans, hashlib.sha256(kept).hexdigest())


def test_repeated_passages(documents, texts):
    got = {r.doc_id: r for r in chunk_dedup.passage_report(documents).collect()}
    owners = collections.defaultdict(set)
    for i, t in texts.items():
        w = t.split()
        for k in range(len(w) - 49):
            owners[tuple(w[k : k + 50])].add(i)
    shared = [ids for ids in owners.values() if len(ids) > 1]
    assert shared and all(got[i].n_shared for ids in shared for i in ids)
    assert all(got[i].n_removed for ids in shared for i in ids if i != min(ids))
    kept = {r.doc_id: r.text for r in chunk_dedup.drop_repeats(documents).collect()}
    assert all(len(kept[i].encode()) == len(texts[i].encode()) - got[i].n_removed for i in texts)


def test_short_whole_texts_are_repeats(spark):
    short = ["a short text of some forty bytes or so, ok", "tiny", "another text, which comes twice here, of eighty bytes or so, more or less, I think"]
    rows = [(1, short[0]), (2, short[0]), (3, short[1]), (4, short[2]), (5, short[2]), (6, short[1]), (7, "only once"), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shared, r.n_removed) for r in chunk_dedup.passage_report(docs).collect()}
    again = {2, 5, 6}
    assert got == {i: (0 if i > 6 else len(t), len(t) if i in again else 0) for i, t in rows}
    kept = {r.doc_id: r.text for r in chunk_dedup.drop_repeats(docs).collect()}
    assert kept == {i: "" if i in again else t for i, t in rows}


def test_chunks_resist_insertions():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    moved = np.concatenate([data[:1000], np.full(7, 65, dtype=np.uint8), data[1000:]])
    a, b = set(chunk_dedup.cuts(data)), {c - 7 for c in chunk_dedup.cuts(moved)}
    assert {c for c in a if c > 1300} == {c for c in b if c > 1300}


def test_fingerprints(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op1_edit_embedding"](spark, FOLDER).collect()}
    order = sorted(texts, reverse=True)
    for i, j in zip(order, [*order[1:], order[0]]):
        half = len(texts[i]) // 2
        text = texts[i][: len(texts[i]) - half] + texts[j][:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(texts[i]), hashlib.sha256(text.encode()).hexdigest())
        assert got[i].near_edited > got[i].near_next or texts[i] == texts[j]
    prints = {}
    assert all(prints.setdefault(texts[i], got[i].fingerprint) == got[i].fingerprint for i in texts)


def plain_walk(text, bits, steps):
    """What the walk writes, one step at a time."""
    out, at = [], 0
    while at < len(text) and len(out) < steps:
        out.append(text[at])
        at += bits[ord(text[at]) * 0x9E3779B1 % 2**32 >> 24, (len(out) - 1) % edit_embedding.PERIOD]
    return out


def test_walk_matches_single_steps():
    rng = np.random.default_rng(1207)
    bits = rng.random((edit_embedding.CLASSES, edit_embedding.PERIOD)) < 0.5
    bits[:, -1] = True
    texts = ["", "a", "abc déjà 🙂" * 40, "x" * 1500]
    for text, (rate, when, marks) in zip(texts, edit_embedding.Embedder().fingerprints(texts)):
        written = plain_walk(text, bits.astype(int), 10**9)
        seen = np.array([ord(written[t]) for t in when], dtype=np.uint64)
        from glycospark.llm.hashing import mix

        assert (marks == mix(seen ^ when.astype(np.uint64) << np.uint64(24)) >> np.uint64(60)).all()
        assert len(written) >> rate < 2 * edit_embedding.SAMPLES


def test_near_fingerprints_meet(spark):
    base = " ".join(f"word{k * k % 97}" for k in range(300))
    rows = [(1, base), (2, base[:900] + base[905:]), (3, base[::-1]), (4, ""), (5, None)]
    got = {r.id: r.component_id for r in edit_embedding.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def plain_likeness(texts, pairs):
    """Of the walks themselves, at the coarser of both rates."""
    embedder = edit_embedding.Embedder()
    prints = dict(zip(texts, embedder.fingerprints(list(texts.values()))))
    out = {}
    for i, j in pairs:
        (ra, wa, ma), (rb, wb, mb) = prints[i], prints[j]
        rate = max(ra, rb)
        a = {w: m for w, m in zip(wa.tolist(), ma.tolist()) if embedder.depth[w] >= rate}
        b = {w: m for w, m in zip(wb.tolist(), mb.tolist()) if embedder.depth[w] >= rate}
        n = max(len(a), len(b))
        out[i, j] = sum(a[w] == b[w] for w in a.keys() & b.keys()) / n if n else float(len(wa) == len(wb) == 0)
    return out


def test_near_values_match_plain_walks(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op1_edit_embedding"](spark, FOLDER).collect()}
    order = sorted(texts, reverse=True)
    following = dict(zip(order, [*order[1:], order[0]]))
    changed = {i: texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[j][: len(texts[i]) // 2] for i, j in following.items()}
    next_ = plain_likeness(texts, following.items())
    edited = plain_likeness({("a", i): t for i, t in texts.items()} | {("b", i): t for i, t in changed.items()}, [(("a", i), ("b", i)) for i in texts])
    for i, j in following.items():
        assert got[i].near_next == pytest.approx(next_[i, j]) and got[i].near_edited == pytest.approx(edited[("a", i), ("b", i)])


@pytest.mark.parametrize("crowd", [edit_embedding.CROWD, 1])
def test_near_text_classes_match_all_pairs(spark, crowd):
    """Edits of a few texts at likenesses on both sides of the threshold, and crowds of texts that begin alike."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8)))
    texts, opening = {}, " ".join(word() for _ in range(40))
    for k in range(12):
        base = [word() for _ in range(rng.integers(30, 250))]
        for copy in range(6):
            words = [w if rng.random() > rng.choice([0.0, 0.003, 0.01, 0.04]) else word() for w in base]
            texts[100 * k + copy] = " ".join(words)
    for k in range(80):
        texts[5000 + k] = opening + " " + " ".join(word() for _ in range(60))
    texts[9000] = texts[0]
    rows = [(i, t) for i, t in texts.items()] + [(1, texts[1]), (9500, None), (9501, ""), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS id", "1 AS node", "2 AS band", "3 AS rate", "4 AS root")
    got = {r.id: r.component_id for r in edit_embedding.near_classes(docs, crowd=crowd).collect()}
    ids = sorted(texts)
    alike = plain_likeness(texts, [(i, j) for i in ids for j in ids if i < j])
    root = {i: i for i in ids} | {9500: 9500, 9501: 9501}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [p for p, v in alike.items() if v >= edit_embedding.NEAR]
    assert len(links) > 40
    for i, j in links:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    assert got == {i: find(i) for i in root}
    if crowd > 1:
        named = edit_embedding.fingerprints_in_order(docs, classes=edit_embedding.near_classes(docs)).collect()
        assert len(named) == len(rows) and all(r.component_id == (None if r.doc_id is None else find(r.doc_id)) for r in named)


def check_packing(rows, texts, capacity=packing.CAPACITY):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, parts in pieces.items():
        ids = np.array([*encode.encode(texts[i], add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for k, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // capacity) + 1  # as few as can be, or one more


def test_plan_pairs_large_pieces_only():
    counts = {size: 15 for size in range(684, 1025)}
    rows = sorted(map(tuple, packing.plan(counts)))
    fill = collections.Counter()
    for (size, rank, per_bin, first, _), after in zip(rows, [*rows[1:], None]):
        upto = after[1] if after and after[0] == size else counts[size]
        for r in range(rank, upto):
            fill[first + (r - rank) // per_bin] += size
    assert sum(fill.values()) == sum(s * n for s, n in counts.items()) and max(fill.values()) <= packing.CAPACITY
    assert len(fill) == -(-sum(counts.values()) // 2)


@pytest.mark.parametrize("group", [packing.GROUP, 2])  # with 2, most lengths are ranked in several groups
def test_packing(spark, texts, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    check_packing(QUERIES["op6_best_fit_packing"](spark, FOLDER).collect(), texts)


def test_quality_on_held_out_labels(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert sum(held) / len(held) > 0.97


def test_main_text_of_pages(spark):
    """The pages' template: everything in the article element, block by block."""
    import html

    for page in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", page.html)[1]
        blocks = re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:p|h1)>", "\n\n", article)).split("\n\n")
        want = "\n".join(" ".join(html.unescape(b).split()) for b in blocks if b.strip())
        from glycospark.llm.html_text import main_text

        assert main_text(page.html) == want


def test_main_text_of_other_layouts():
    from glycospark.llm.html_text import main_text

    story = "<p>First paragraph, with commas, and enough words to count as a paragraph.</p><p>Second one &mdash; also long enough, I would say, to be counted.</p>"
    want = "First paragraph, with commas, and enough words to count as a paragraph.\nSecond one — also long enough, I would say, to be counted."
    for page in (
        f'<div id="sidebar"><p>Many words, many commas, but in, a sidebar, so, no, really, not wanted here.</p></div><div class="post-body">{story}</div>',
        f'<header><h1>Site</h1></header><main>{story}<section class="comments"><p>Great, great, great, great, great, great, great post, indeed, thanks!</p></section></main><footer>x</footer>',
        f'<div class="cookie-notice">We use cookies, and more cookies, and even more of them, yes.</div><form><p>Name, address, city, and so on and so forth</p></form><div><div>{story}</div></div>',
        f'<table><tr><td class="menu"><a href="/">Home</a> <a href="/a">About us</a></td><td>{story}</td></tr></table>',
    ):
        assert main_text(f"<html><head><title>t</title></head><body>{page}</body></html>") == want


STORY = "<p>First paragraph, with commas, and enough words to count as a paragraph.</p><p>Second one, also long enough, I would say, to be counted.</p>"
STORY_TEXT = "First paragraph, with commas, and enough words to count as a paragraph.\nSecond one, also long enough, I would say, to be counted."


@pytest.mark.parametrize(
    "page",
    [
        f'<body><p class="notice">We use cookies, and more.{STORY}',
        f'<body><ul><li class="share">Share</ul><div>{STORY}</div>',
        f'<body><div><ul><li class="share">Share <ul><li>here<li>there</ul></ul>{STORY}</div>',
        f'<table><tr><td class="menu">Home<td>{STORY}<tr><td class="menu">Foot</table>',
        f"<head><title>t</title><meta charset=utf-8><body><div>{STORY}</div>",
        f"<head><title>t</title><article>{STORY}</article>",
        f'<article><svg viewBox="0 0 1 1"/>{STORY}</article>',
        f"<article><svg><g><path/><title>Icon</title></g>{STORY}</article>",
        f'<article><div><nav><a href="/">Home</div>{STORY}</article>',
        f'<article><h2 class="share">Share</h3>{STORY}</article>',
        f'<article><div class="share"><div>Share</div> it</div><span class="share">Share <span>it</span> now</span>{STORY}</article>',
        f'<article>{STORY[:-4]} <span class="share">Share</article><p>',
    ],
)
def test_skipped_elements_end_as_in_a_browser(page):
    from glycospark.llm.html_text import main_text

    assert main_text(page) == STORY_TEXT


COMMENT = "No, no, no, no, no, no, no, no, no, no, no, no, no, this is not, not at all, the text that is wanted."


@pytest.mark.parametrize(
    ("page", "before"),
    [
        (f'<div><h1>Title</h1><p>Short lead.</p><div class="content">{STORY}</div></div>', "Title\nShort lead.\n"),
        (f'<div><h1>Title</h1><div>Short lead.</div><div class="content">{STORY}</div><div>Imprint</div></div>', "Title\nShort lead.\n"),
        (f'<div><h1><a href="/">Site</a></h1><div class="content">{STORY}</div></div>', ""),
        (f'<div class="content has-sidebar">{STORY}<div class="sidebar">{COMMENT}</div></div>', ""),
        (f'<div class="post no-sidebar">{STORY}</div><div class="post-share">{COMMENT}</div>', ""),
        (f'<div class="entry share-enabled">{STORY}</div>', ""),
        (f'<div class="has-sidebar"><article>{STORY}</article><div class="comments"><article>{COMMENT}</article></div></div>', ""),
        (f'<div class="related"><article>Short one</article></div><div class="has-sidebar"><article>{STORY}</article></div>', ""),
        (f'<div class="has-sidebar"><div>{STORY}</div></div>', ""),
        (f'<div class="post">{STORY}</div><div class="comments"><article>{COMMENT}</article></div>', ""),
    ],
)
def test_article_wins_over_noise_names_and_lengths(page, before):
    from glycospark.llm.html_text import main_text

    assert main_text(f"<body>{page}</body>") == before + STORY_TEXT


@pytest.mark.parametrize(
    "broken",
    [
        "<![foo[x]]>", "<![ x]>", "<![endif]-->", "<!-->", "<!--->", "<!-- a -- b --!>", "<!x y>", "<?php echo 1 ?>", "</ x>", "</>", "<!doctype>", "<![CDATA[x]]>", "&#99999999999;",
        "<img / alt=x>", '<img alt="a"b=c/d>', "<img =>", "<textarea></div></article></textarea>", "<!>", "<?>", "</3>",
    ],
)
def test_broken_markup_is_a_comment_or_a_tag(broken):
    from glycospark.llm.html_text import main_text

    for page in (f"{broken}<body><article>{STORY}</article>", f"<body><article>{STORY[:-4]}</p>{broken}</article>", f"<body><div>{STORY}</div>{broken}"):
        assert main_text(page).replace("\n\ufffd", "") == STORY_TEXT
    assert main_text(f"<article>{STORY}</article>" + broken[:3]) in (STORY_TEXT, STORY_TEXT + "\n" + broken[:3])


@pytest.mark.parametrize("open_end", ["<!-- never closed <p>No, no, and no</p>", "<p class='x", '<a href="', "</p", "<![CDATA[ no, no", "<?x", "<!", "<script>var no = 1;", "<style>p {}", "<textarea><p>No, no, no</p>"])
def test_what_never_ends_is_no_text(open_end):
    from glycospark.llm.html_text import main_text

    assert main_text(f"<article>{STORY}{open_end}") == STORY_TEXT


def test_numbers_of_any_length():
    from glycospark.llm.html_text import main_text

    assert main_text("<p>a&#65;b&#0000000000000065;c&#x41;d</p>") == "aAbAcAd"
    assert main_text(f"<p>a&#{'9' * 5000};b&#{'0' * 5000}66;</p>") == "a\ufffdbB"


def test_given_pages_survive_mutations(spark):
    """Random changes of bytes, cuts and copied pieces: no error, and only code points that the page has or stands for."""
    import random

    from glycospark.llm.html_text import main_text

    pages = [r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    rng = random.Random(4)
    for k in range(1500):
        page = list(rng.choice(pages))
        for _ in range(rng.choice([1, 5, 60])):
            at = rng.randrange(len(page))
            what = rng.random()
            if what < 0.5:
                page[at] = rng.choice("<>/!-[]&;#\"'= \x00?ap")
            elif what < 0.8:
                del page[at : at + rng.randrange(1, 30)]
            else:
                page[at:at] = rng.choice(["<![", "<!--", "]]>", "</", "<div ", "&#", "<svg>", "<table><td>", "<template>", "-->"])
        assert isinstance(main_text("".join(page)), str)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><header><h1>Title</h1><p>By A. Writer</p></header>{STORY}</article>", "Title\nBy A. Writer\n" + STORY_TEXT),
        (f'<header><h1>Site</h1></header><article><header><nav><a href="/">Up</a></nav><h1>Title</h1></header>{STORY}</article>', "Title\n" + STORY_TEXT),
        (f'<form id="aspnetForm"><div>{STORY}</div></form>', STORY_TEXT),
        (f'<form id="f"><div class="content">{STORY}</div><div class="comments"><p>{"No, no, no, not at all. "}</p></div></form>', STORY_TEXT),
        (f'<form id="aspnetForm"><article>{STORY}</article><form class="search"><p>Find it, here, or elsewhere, or not.</p></form></form>', STORY_TEXT),
        (f'<article>{STORY}<ul><li><a href="/s">A long title of a source, and its year</a></li><li><a href="/t">Another</a></li></ul></article>', STORY_TEXT + "\nA long title of a source, and its year\nAnother"),
        (f'<article>{STORY}<p class="alert">Mind the gap.</p><div class="review">Five stars.</div></article>', STORY_TEXT + "\nMind the gap.\nFive stars."),
        (f'<article>{STORY}<div class="ad">Buy, buy, buy</div><section id="comments"><p>No, no, no, not at all, not that, I say.</p></section></article>', STORY_TEXT),
        (f'<div class="alert">Site notice, closing on Monday</div><div>{STORY}</div>', STORY_TEXT),
        ("<div class=sidebar>" * 200 + f"<div>{STORY}</div>", STORY_TEXT),
    ],
)
def test_what_belongs_to_the_article_stays(page, want):
    from glycospark.llm.html_text import main_text

    assert main_text(f"<html><body>{page}</body></html>") == want


@pytest.mark.parametrize("opened", ["<div>", "<div class=x>", "<b>", "<div class=sidebar>", "<table><tr><td>", "<ul><li>", "<form>", "<p><a href=x>", "<!--", "<svg>", "<h1>", "<span class=share>"])
def test_deep_pages_take_time_in_proportion(opened):
    import time

    from glycospark.llm.html_text import main_text

    n = 50_000
    page = "<body>" + opened * n + STORY + "x, and y, " * 10
    start = time.perf_counter()
    assert isinstance(main_text(page), str)
    assert time.perf_counter() - start < 6  # quadratic work takes minutes


def test_pipeline_stage_by_stage(spark, documents, tmp_path):
    """Each stage against a plain version, on what the stage before has kept."""
    docs, tables, stages = documents, [], dict(corpus_pipeline.STAGES)
    for name, stage in list(stages.items())[:-1]:
        out = settle(stage(spark, docs, FOLDER), "stage")
        assert out.columns == documents.columns
        tables.append({r.doc_id: r.text for r in out.collect()})
        if name == "benchmark decontamination":
            path = str(tmp_path / "before")
            docs.coalesce(1).write.parquet(path)
            verdict = duckdb.connect()
            for t in ("documents", "benchmark"):
                verdict.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if t == 'documents' else f'{FOLDER}/{t}.parquet'}'")
            clean = verdict.execute(f"SELECT doc_id FROM ({SQL['op7_decontamination']}) WHERE NOT contaminated").fetchall()
            assert set(tables[-1]) == {i for (i,) in clean}
        docs = out
    good, single, _, masked = tables
    predicted = {r.doc_id for r in QUERIES["op10_quality_classifier"](spark, FOLDER).collect() if r.predicted}
    assert set(good) == predicted
    assert set(single) == {i for i, (_, root) in components(good).items() if i == root}
    before = tables[2]
    for i, text in masked.items():
        spans = [m.span() for rule in secrets.RULES for m in re.finditer(rule.pattern, before[i], re.A) if len(m[rule.group]) >= rule.least]
        if not spans:
            assert text == before[i]
        else:
            assert text.count(secrets.MASK) >= 1 and all(before[i][a:b] not in text for a, b in spans if b - a > 12)
    check_packing(stages["packing"](spark, docs, FOLDER).collect(), masked)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_windows_of_all_lengths(spark, texts, monkeypatch, limit):
    """Items of 1 to 16 words from the documents themselves, by broadcast and by sieve, against plain windows."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    words = {i: [w for w in re.split(decontaminate.SEPARATORS, re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w] for i, t in texts.items()}
    long = sorted(i for i, w in words.items() if len(w) > 40)
    items = {n: words[long[n]][n : 2 * n] for n in range(1, 17)}
    found = decontaminate.contamination(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id bigint, text string"))
    windows = collections.defaultdict(set)
    for n, w in items.items():
        for p in range(len(w) - min(n, 13) + 1):
            windows[tuple(w[p : p + 13])].add(str(n))
    sizes = {len(w) for w in windows}
    for row in found.collect():
        own = words[row.doc_id]
        met = [(p, n) for n in sizes for p in range(len(own) - n + 1) if tuple(own[p : p + n]) in windows]
        assert row.n_words == len(own) and row.n_hit == len({q for p, n in met for q in range(p, p + n)})
        assert row["items"] == sorted(set().union(*(windows[tuple(own[p : p + n])] for p, n in met)))
